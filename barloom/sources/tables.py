"""Sources and sinks: declared schemas, incremental loads, logs, and triples as lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructType, TimestampNTZType, TimestampType


def scan_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A CSV file with a header, read once: the schema is given, not inferred."""
    return spark.read.schema(schema).option("header", True).csv(path)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Replace a Parquet table."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def dates_to_text(df: DataFrame, fmt: str = "yyyy-MM-dd HH:mm:ss") -> DataFrame:
    return df.withColumns({f.name: F.date_format(f.name, fmt) for f in df.schema if isinstance(f.dataType, (TimestampType, TimestampNTZType))})


def conform(df: DataFrame, schema: StructType) -> tuple[DataFrame, list[str]]:
    """df cast to the schema's long, double, boolean or string columns, bad values to null; and the columns it lacks."""
    lacks = [f.name for f in schema if f.name not in df.columns]
    kinds = (LongType, DoubleType, BooleanType, StringType)
    cast = lambda f: (F.lit(None) if f.name in lacks else F.col(f.name)).try_cast(f.dataType if isinstance(f.dataType, kinds) else StringType()).alias(f.name)
    return df.select(*map(cast, schema)), lacks


def coerce_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text that is no number becomes null."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in columns})


def check_inputs(tables: dict[str, DataFrame | None]) -> dict[str, str]:
    """What is wrong with each input: missing or empty; nothing for those in order."""
    return {n: "missing" if df is None else "empty" for n, df in tables.items() if df is None or df.isEmpty()}


def new_rows(old: DataFrame, new: DataFrame, key: str = "Company", date: str = "Date") -> DataFrame:
    """Rows of new that lie after the last date of their key in old; blank keys go."""
    seen = old.groupBy(key).agg(F.max(date).alias("_seen"))
    fresh = new.where(F.col(key).isNotNull() & (F.trim(F.col(key).cast("string")) != ""))
    return fresh.join(seen, key, "left").where(F.col("_seen").isNull() | (F.col(date) > F.col("_seen"))).drop("_seen")


def upsert_bars(old: DataFrame, new: DataFrame, key: str = "Company", date: str = "Date", order: str = "load") -> DataFrame:
    """Old rows and later new ones; of rows of equal key and date the last loaded stays."""
    both = old.unionByName(new_rows(old, new, key, date))
    w = Window.partitionBy(key, date).orderBy(F.col(order).desc())
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def wide_to_long(df: DataFrame, date: str, keys: list[str], fields: list[str], carried: list[str] = ()) -> DataFrame:
    """Columns <field>_<key> as rows (carried, ticker, date, fields); rows without any value go."""
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("ticker"), *(F.col(f"{f}_{k}").alias(f) for f in fields)) for k in keys)))
    return df.select(*carried, date, rows.alias("r")).select(*carried, "r.ticker", date, *(f"r.{f}" for f in fields)).dropna("all", subset=fields)


def write_results(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite").format(fmt).option("header", True)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def metrics_row(metrics: DataFrame, name: str) -> DataFrame:
    """(metric_name, metric_value as one JSON document, timestamp)."""
    return metrics.select(F.lit(name).alias("metric_name"), F.to_json(F.struct(*metrics.columns)).alias("metric_value"), F.current_timestamp().alias("timestamp"))


#: How N-Triples writes characters that a quoted literal cannot hold; \b, \f and \' are only read.
ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t"}
READ_ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}
#: Fixed values, the grammar of N-Triples: characters by number (no surrogates), IRIs, blank nodes, language tags.
_HEX = "[0-9A-Fa-f]"
_BMP = f"(?:[0-9A-CE-Fa-ce-f]{_HEX}{{3}}|[dD][0-7]{_HEX}{{2}})"
NUMBERED = rf"\\u{_BMP}|\\U(?:0000{_BMP}|000[1-9A-Fa-f]{_HEX}{{4}}|0010{_HEX}{{4}})"
ESCAPED = rf"""{NUMBERED}|\\[tbnrf"'\\]"""
IRI_NOT = r'\x00-\x20<>"{}|^`\\'
IRI = rf"<((?:[^{IRI_NOT}]++|{NUMBERED})*+)>"
BLANK = r"(_:[\p{L}\p{N}_](?:[\p{L}\p{N}_.\-\u00B7]*[\p{L}\p{N}_\-\u00B7])?)"
TAG = r"(@[a-zA-Z]+(?:-[a-zA-Z0-9]+)*)"


def triple_lines(triples: DataFrame) -> DataFrame:
    """N-Triples text of (s, p, o, o_kind, o_type): o_kind is iri, blank or literal, o_type a datatype or a language tag (@en).

    Subjects and objects that begin with _: are blank nodes. Characters that an IRI cannot hold are written by number.
    """
    quoted = F.col("o")
    for plain, escaped in ESCAPES.items():  # the backslash first
        quoted = F.replace(quoted, F.lit(plain), F.lit(escaped))

    def iri(c: Column) -> Column:
        each = F.transform(F.split(c, ""), lambda x: F.when(x.rlike(f"^[{IRI_NOT}]$"), F.concat(F.lit("\\u"), F.lpad(F.hex(F.ascii(x)), 4, "0"))).otherwise(x))
        return F.concat(F.lit("<"), F.when(c.rlike(f"[{IRI_NOT}]"), F.array_join(each, "")).otherwise(c), F.lit(">"))

    node = lambda c: F.when(F.startswith(c, F.lit("_:")), c).otherwise(iri(c))
    kind = F.col("o_type")
    literal = F.concat(F.lit('"'), quoted, F.lit('"'), F.when(kind.isNull(), "").when(F.startswith(kind, F.lit("@")), kind).otherwise(F.concat(F.lit("^^"), iri(kind))))
    end = F.when(F.col("o_kind") == "literal", literal).otherwise(node(F.col("o")))
    return triples.select(F.concat(node(F.col("s")), F.lit(" "), iri(F.col("p")), F.lit(" "), end, F.lit(" .")).alias("value"))


def write_triples(triples: DataFrame, path: str) -> None:
    triple_lines(triples).write.mode("overwrite").text(path)


def unescaped(text: Column) -> Column:
    """Escapes undone: what stands between them is cut out whole, and each is looked up by itself."""

    def one(x: Column) -> Column:
        number = F.lpad(F.substr(x, F.lit(3)), 8, "0")
        plain = x
        for letter, char in READ_ESCAPES.items():
            plain = F.when(x == "\\" + letter, F.lit(char)).otherwise(plain)
        return F.when(x.rlike(r"^\\[uU]"), F.decode(F.unhex(number), "UTF-32")).otherwise(plain)

    pieces = F.regexp_extract_all(text, F.lit(rf"({ESCAPED}|[^\\]+)"), 1)
    return F.when(F.contains(text, F.lit("\\")), F.array_join(F.transform(pieces, one), "")).otherwise(text)


def _parsed(lines: DataFrame) -> DataFrame:
    """Each line that is neither blank nor a comment, with its parts, and where it stops being a triple (null: nowhere)."""
    head = rf"^[ \t]*(?:{IRI}|{BLANK})[ \t]*{IRI}[ \t]*"
    end = r"[ \t]*\.[ \t]*(?:#.*)?$"
    # a literal is all up to its last quote; what is in it is looked at by itself, as texts may be very long
    long = rf'{head}"(.*)"(?:\^\^{IRI}|{TAG})?[ \t]*\.[ \t]*$'
    short = rf'{head}"([^"\\]*+(?:\\.[^"\\]*+)*+)"(?:\^\^{IRI}|{TAG})?{end}'
    node = rf"{head}(?:{IRI}|{BLANK}){end}"
    value = F.col("value")
    sound = lambda text: ~F.regexp_replace(text, ESCAPED, "").rlike(r'["\\]')
    rows = lines.select("value").where(~value.rlike(r"^[ \t]*(?:#.*)?$"))
    rows = rows.withColumn("_text", F.when(value.rlike(long), F.regexp_extract("value", long, 4)))
    form = F.when(F.col("_text").isNotNull() & sound(F.col("_text")), "long").when(value.rlike(node), "node").when(F.contains("value", F.lit("#")) & value.rlike(short) & sound(F.regexp_extract("value", short, 4)), "short")
    rows = rows.withColumn("_form", form)
    part = lambda i: F.when(F.col("_form") == "long", F.regexp_extract("value", long, i)).when(F.col("_form") == "short", F.regexp_extract("value", short, i))
    begins = lambda i: F.regexp_extract("value", head, i)
    subject, blank = begins(1), begins(2)
    tail, tail_blank = (F.regexp_extract("value", node, i) for i in (4, 5))
    is_node = F.col("_form") == "node"
    stops = F.when(F.col("_form").isNotNull(), None).when(~value.rlike(rf"^[ \t]*(?:{IRI}|{BLANK})"), "subject").when(~value.rlike(head), "predicate").otherwise("object or end")
    return rows.select(
        "value", stops.alias("stops"),
        F.when(blank != "", blank).otherwise(unescaped(subject)).alias("s"), unescaped(begins(3)).alias("p"),
        F.when(~is_node, unescaped(part(4))).when(tail_blank != "", tail_blank).otherwise(unescaped(tail)).alias("o"),
        F.when(~is_node, "literal").when(tail_blank != "", "blank").otherwise("iri").alias("o_kind"),
        F.when(~is_node, F.coalesce(F.nullif(part(6), F.lit("")), F.nullif(unescaped(part(5)), F.lit("")))).alias("o_type"),
    )


def parse_triples(lines: DataFrame) -> DataFrame:
    """(s, p, o, o_kind, o_type) of N-Triples lines: IRIs, blank nodes, literals with datatype or language, escapes by letter
    and by number, any spaces and tabs, comments. Blank lines and comments are nothing; other lines are in rejected_lines."""
    return _parsed(lines).where("stops is null").select("s", "p", "o", "o_kind", "o_type")


def rejected_lines(lines: DataFrame) -> DataFrame:
    """(value, stops): lines that are no triples, and the part at which each stops being one."""
    return _parsed(lines).where("stops is not null").select("value", "stops")


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    return parse_triples(spark.read.text(path))


def union_graphs(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).dropDuplicates()


def indicator_rows(payloads: DataFrame, column: str = "value") -> DataFrame:
    """(iso3, value) of JSON payloads [meta, rows]; rows without a value go."""
    rows = F.from_json(F.get_json_object(column, "$[1]"), "array<struct<countryiso3code string, value double>>")
    return payloads.select(F.explode(rows).alias("r")).select(F.col("r.countryiso3code").alias("iso3"), F.col("r.value").alias("value")).where("value is not null")


def read_indicator_json(spark: SparkSession, path: str) -> DataFrame:
    return indicator_rows(spark.read.text(path, wholetext=True))
