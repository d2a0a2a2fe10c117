"""A corpus pipeline over documents: quality rules, toxicity, n-gram Jaccard join, best-fit packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. The first three return the
columns of documents; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barloom.llm import packing, quality_rules, toxicity
from barloom.llm._common import materialize, table
from barloom.llm.ngram_join import keep_first


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, with all their columns.

    Null, empty and wordless texts go (they fail the word count); texts of any length are measured whole. Rows that
    repeat stay or go together, null ids change nothing, further columns of any name stay as they are, and an empty
    table stays empty.
    """
    return quality_rules.keep_good(docs)


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.3, with all their columns.

    Null and empty texts have no evidence and stay; texts of any length are scored whole. Rows that repeat stay or go
    together, rows without id are scored like others but teach nothing, and an empty table stays empty.
    """
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def single_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that five-word shingles link at a similarity of 0.8, the row of the smallest doc_id.

    Of rows of that doc_id in the group, one stays. Groups are of texts: rows that share a doc_id but not a group are
    judged apart. Rows without doc_id come after all others; null and wordless texts are linked with nothing and stay.
    Further columns of any name stay as they are, and an empty table stays empty.
    """
    return keep_first(docs, k=5, threshold=(80, 100))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of at most 2048 tokens.

    A null or empty text is id 0 alone, a long one is cut into pieces, rows that repeat are packed as often, null ids
    are kept, further columns are left out, and an empty table gives no rows.
    """
    return packing.pack(docs)


STAGES = [
    ("quality_rules", good_documents),
    ("toxicity", clean_documents),
    ("ngram_jaccard_join", single_documents),
    ("best_fit_packing", packed_sequences),
]

#: EM, a trained score and a greedy packing are not expressible in SQL; tests/llm hold the stages against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if i == 0 else materialize(docs), sf_dir)
    return docs
