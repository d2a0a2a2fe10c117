"""Canonical exact fingerprints, natively: normalise, fold, hash wide, and compare bytes inside equal buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm._common import bitmap_prefilter, materialize, with_range_cells

#: Characters of text that a cell of neighbours holds, about; a cell sorts in one task and may spill.
CELL_CHARS = 32_000_000
#: Members of one bucket that are compared in one task, about.
SALT_ROWS = 1_000


def canonical(text: Column) -> Column:
    """NFKC, full case folding, NFKC again, white space runs to one space, none at the ends; null is the empty text.

    Normalisation and folding are the JVM's ICU functions, called by the SQL function reflect.
    """
    compose = lambda x: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(True))
    fold = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), compose(F.coalesce(text, F.lit(""))), F.lit(True))
    return F.trim(F.regexp_replace(compose(fold), r"(?U)\s+", " "))


def digest(canon: Column) -> tuple[Column, Column]:
    """Two 64-bit lanes of 128 bits."""
    return F.xxhash64(canon), F.xxhash64(F.lit(1), canon)


def fingerprint(a: str, b: str) -> Column:
    return F.concat(*(F.lpad(F.lower(F.hex(F.col(x))), 16, "0") for x in (a, b)))


def _printed(texts: DataFrame, text: str, a: str, b: str, keep: str | None = None) -> DataFrame:
    """reflect is not marked deterministic, so its value gets a projection of its own before it is used twice."""
    named = texts.withColumn("_canon", canonical(F.col(text)))
    x, y = digest(F.col("_canon"))
    named = named.withColumns({a: x, b: y})
    return named.withColumnRenamed("_canon", keep) if keep else named.drop("_canon")


def exact_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, a, b, fingerprint, class_id): class_id is the smallest id among the documents of byte-equal canonical text.

    Buckets of equal digests are found without the texts; only documents in buckets of two or more send theirs, dealt
    by bucket and salt, to be compared with the bucket's first. Those that differ (a collision) are grouped by their
    text itself. Rows of null id take the class of their text (null if it has no id); one row per input row.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    prints = materialize(_printed(texts, "text", "a", "b").select("doc_id", "a", "b"))
    # a table of its own: the joins with it are then plain exchanges on both sides, of which a hot bucket can be split
    buckets = materialize(prints.groupBy("a", "b").agg(F.count("*").alias("c"), F.min("doc_id").alias("head")).where("c > 1 and head is not null"))
    wanted = prints.join(buckets, ["a", "b"], "left_semi").select("doc_id")
    # texts of null id are few or none; they take part as the id null
    moved = bitmap_prefilter(texts.withColumn("_key", F.coalesce("doc_id", F.lit(-1))), "_key", wanted.select(F.coalesce("doc_id", F.lit(-1)).alias("_key"))).drop("_key")
    members = _printed(moved, "text", "a", "b", "canon").select("doc_id", "a", "b", "canon")
    sized = buckets.select("a", "b", "head", (F.floor(F.col("c") / SALT_ROWS) + 1).alias("salts"))
    members = materialize(members.join(sized, ["a", "b"]).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("salts"))))
    first = members.where("doc_id = head").dropDuplicates(["a", "b"]).select("a", "b", F.col("canon").alias("first"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    compared = members.join(first, ["a", "b", "salt"]).withColumn("same", F.col("canon") == F.col("first"))
    other = compared.where("not same").withColumn("class_id", F.min("doc_id").over(Window.partitionBy("a", "b", "canon")))
    classed = compared.where("same").select("doc_id", "a", "b", F.col("head").alias("class_id")).union(other.select("doc_id", "a", "b", "class_id"))
    classed = classed.dropDuplicates(["doc_id", "a", "b"])
    return (
        prints.alias("p").join(classed.alias("c"), F.expr("p.doc_id <=> c.doc_id and p.a = c.a and p.b = c.b"), "left")
        .select("p.doc_id", "p.a", "p.b", F.coalesce("c.class_id", "p.doc_id").alias("class_id"))
        .withColumn("fingerprint", fingerprint("a", "b"))
    )


def with_next(texts: DataFrame, carried: list[str]) -> DataFrame:
    """texts (doc_id, text, ...) with next_<c> of each carried column: the next row's by descending doc_id, the first row's after the last.

    Rows meet their neighbours in cells of the id range that hold like numbers of rows, however the ids are spread; each
    is sorted by its own task, and the first row of every cell visits the cell before it. Rows of equal id follow one
    another by text hash. Null ids come last; theirs are cells of the range of text hashes, as many as all other cells.
    """
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    cells = -(-chars // CELL_CHARS)
    texts = with_range_cells(texts, "doc_id", cells)
    bits = max(0, int(cells) - 1).bit_length()
    # cells are numbered against the order: the null ones from -1 down, by ascending hash
    texts = texts.withColumn("cell", F.when(F.col("doc_id").isNull(), -1 - F.shiftright("tie", 64 - bits) - 2**bits // 2 if bits else F.lit(-1)).otherwise(F.col("cell")).cast("long"))
    place = F.struct(F.bitwise_not("doc_id").alias("id"), F.col("tie").alias("tie"))  # ascending, without overflow
    heads = texts.groupBy("cell").agg(F.min(place).alias("head"))
    # one row for each CELL_CHARS of input: the one unpartitioned window is over these alone
    order = Window.orderBy("cell")
    heads = heads.withColumn("to", F.lead("cell").over(order)).withColumn("low", F.min("cell").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    heads = materialize(heads.select("cell", F.col("head.id").alias("head_id"), F.col("head.tie").alias("head_tie"), F.coalesce("to", "low").alias("to")))
    visitors = texts.alias("t").join(heads.alias("h"), F.expr("t.cell = h.cell and ~t.doc_id <=> h.head_id and t.tie = h.head_tie")).select(*(f"t.{c}" for c in texts.columns if c != "cell"), F.col("h.to").alias("cell"))
    rows = texts.withColumn("visits", F.lit(False)).unionByName(visitors.withColumn("visits", F.lit(True)))
    w = Window.partitionBy("cell").orderBy("visits", F.col("doc_id").desc_nulls_last(), "tie")
    return rows.withColumns({f"next_{c}": F.lead(c).over(w) for c in carried}).where("not visits").drop("cell", "visits")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, class_id.

    The edited text has its last floor(n_chars / 3) code points replaced by as many first ones (or all) of the next
    document by descending id. The fingerprint is an exact digest, so a likeness is 1 if two are equal and 0 if not.
    A null text is the empty one. A single row is its own next. Other columns are ignored; an empty table gives none.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    texts = texts.withColumn("tie", F.xxhash64("text"))
    pairs = with_next(_printed(texts, "text", "a", "b"), ["text", "a", "b"])
    cut = F.floor(F.length("text") / 3).cast("int")
    pairs = pairs.withColumn("edited", F.concat(F.substr("text", F.lit(1), F.length("text") - cut), F.substr("next_text", F.lit(1), cut)))
    pairs = _printed(pairs.withColumns({"n_chars": F.length("text").cast("long"), "edited_sha256": F.sha2("edited", 256)}), "edited", "ea", "eb")
    like = lambda x, y: F.when((F.col("a") == F.col(x)) & (F.col("b") == F.col(y)), 1.0).otherwise(0.0)
    pairs = pairs.select(
        "doc_id", "a", "b", "n_chars", "edited_sha256", fingerprint("a", "b").alias("fingerprint"), fingerprint("ea", "eb").alias("edited_fingerprint"),
        like("ea", "eb").alias("near_edited"), like("next_a", "next_b").alias("near_next"),
    )
    classes = exact_classes(docs, id_col, text_col).select("doc_id", "a", "b", "class_id").dropDuplicates(["doc_id", "a", "b"])
    joined = pairs.alias("p").join(classes.alias("c"), F.expr("p.doc_id <=> c.doc_id and p.a = c.a and p.b = c.b"), "left")
    return joined.select(*(f"p.{c}" for c in pairs.columns if c not in ("a", "b")), "c.class_id")
