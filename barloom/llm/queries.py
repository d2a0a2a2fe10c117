"""The queries opN_<name> over the given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm._common import table
from barloom.llm import chat_format, exact_dedup, fingerprint, hard_negatives, license_scan, packing, quality_rules, ranked_search, sentencepiece_codec, toxicity, url_filter, warc
from barloom.llm.ngram_join import ngram_jaccard_join


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(table(spark, sf_dir, "pages"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.round_trip(table(spark, sf_dir, "documents"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents"), k=3, threshold=(90, 100))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = table(spark, sf_dir, "conversations")
    calls, results = chat_format.derived_calls(messages)
    return chat_format.format_conversations(messages, calls, results, chat_format.SCHEMAS)


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine_relabelled(table(spark, sf_dir, "embeddings"))


def queries() -> dict:
    return {
        "op1_fingerprints": op1_fingerprints,
        "op2_toxicity": op2_toxicity,
        "op3_license_scan": op3_license_scan,
        "op4_url_filter": op4_url_filter,
        "op5_quality_rules": op5_quality_rules,
        "op6_best_fit_packing": op6_best_fit_packing,
        "op7_warc": op7_warc,
        "op8_sentencepiece": op8_sentencepiece,
        "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
        "op10_chat_format": op10_chat_format,
        "op11_ranked_search": op11_ranked_search,
        "op12_exact_dedup": op12_exact_dedup,
        "op13_hard_negatives": op13_hard_negatives,
    }


def _has_term(term: str) -> str:
    return f"regexp_matches(low, '(^|[^a-z0-9]){term}([^a-z0-9]|$)')"


def _url_filter_sql() -> str:
    """Rules and terms as plain conditions over each url."""
    rules = []
    for verdict, rule in sorted(url_filter.RULES, key=lambda r: -len(r[1])):
        name, slash, rest = rule.partition("/")
        fits = f"(host = '{name}' or host like '%.{name}') and starts_with(path, '{slash + rest}')"
        rules.append((fits, rule, verdict))
    strict = " or ".join(_has_term(t) for t in url_filter.STRICT)
    soft = " + ".join(f"cast({_has_term(t)} as int)" for t in url_filter.SOFT)
    cases = lambda j: " ".join(f"when {r[0]} then '{r[j]}'" for r in rules)
    return f"""
        with cut as (
            select page_id, coalesce(url, '') as url, instr(coalesce(url, ''), '://') as i from pages
        ), rest as (
            select page_id, translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low, case when i > 0 then substr(url, i + 3) else '' end as tail from cut
        ), parts as (
            select page_id, low, regexp_extract(tail, '^[^/?#]*') as host0, regexp_extract(tail, '^[^/?#]*([^?#]*)', 1) as path from rest
        ), named as (
            select page_id, low, translate(host0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, path from parts
        )
        select page_id, host, path, case {cases(1)} end as rule,
            case {cases(2)} when {strict} then 'block' when {soft} >= {url_filter.SOFT_HITS} then 'block' else 'allow' end as verdict
        from named
    """


LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_TERMS = rf"unnest(regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term"
RANKED_SEARCH = f"""
    with said as (select doc_id, {_TERMS} from documents), asked as (select item_id, {_TERMS} from benchmark),
    tf as (select doc_id, term, count(*) as tf from said group by all), lengths as (select doc_id, sum(tf) as n from tf group by all),
    whole as (select count(*) as docs, cast(sum(n) as bigint) as terms from lengths),
    weights as (select term, cast(floor(1000 * ln(cast(2 * any_value(docs) + 2 as double) / (2 * count(*) + 1))) as bigint) as w from tf, whole group by term),
    norms as (select doc_id, cast(75 + (25 * cast(n as bigint) * docs) // terms as bigint) as m from lengths, whole),
    scores as (
        select item_id, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m))) as bigint) as score
        from asked join weights using (term) join tf using (term) join norms using (doc_id) group by all
    )
    select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank, doc_id, score from scores where score > 0 qualify rank <= 20
"""

EXACT_DEDUP = f"""
    with said as (select doc_id, {LOWERED} as low from documents),
    groups as (select doc_id, low, max(doc_id) over (partition by low) as keep_id, count(*) over (partition by low) as group_size from said)
    select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(low) as text_sha256 from groups
"""

HARD_NEGATIVES = """
    with whole as (
        select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
        from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    ), scored as (
        select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same, cast(list_inner_product(a.v, b.v) as bigint) as score
        from whole a join whole b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id
    ), positives as (
        select anchor_id, id as positive_id, score as positive_score from scored where same qualify row_number() over (partition by anchor_id order by score desc, id) <= 5
    )
    select anchor_id, positive_id, cast(row_number() over (partition by anchor_id, positive_id order by score desc, id) as integer) as rank, id as negative_id, positive_score, score as negative_score
    from positives join scored using (anchor_id) where not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score qualify rank <= 3
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op4_url_filter": _url_filter_sql(),
        "op11_ranked_search": RANKED_SEARCH,
        "op12_exact_dedup": EXACT_DEDUP,
        "op13_hard_negatives": HARD_NEGATIVES,
    }
