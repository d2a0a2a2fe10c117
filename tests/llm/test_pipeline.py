"""The pipeline's stages one after another, each against its operator's own result on its input."""

from pyspark.sql import functions as F

import corpus_pipeline as P
from barloom.llm import quality_rules, toxicity
from barloom.llm._common import materialize, table
from barloom.llm.ngram_join import ngram_jaccard_join

DIRECTORY = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, DIRECTORY, "documents")
    kept = []
    for i, (_, stage) in enumerate(P.STAGES):
        out = materialize(stage(spark, docs, DIRECTORY))
        if i < 3:
            assert out.columns == docs.columns
            before = {r["doc_id"] for r in docs.collect()}
            after = {r["doc_id"] for r in out.collect()}
            if i == 0:
                want = {r["doc_id"] for r in quality_rules.judge(docs).where("kept").collect()}
            elif i == 1:
                want = {r["doc_id"] for r in toxicity.score(docs, table(spark, DIRECTORY, "labels")).where("predicted = 0").collect()}
            else:
                want = {r["component_id"] for r in ngram_jaccard_join(docs).collect()}
            assert after == want and after <= before
            kept.append(len(after))
            docs = out
        else:
            assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in docs.collect()}
    assert kept == sorted(kept, reverse=True) and kept[-1] > 100
    empty = table(spark, DIRECTORY, "documents").where("false")
    for _, stage in P.STAGES:
        assert stage(spark, empty, DIRECTORY).count() == 0


def test_stages_keep_odd_rows_and_names(spark):
    good = " ".join(f"word{i} stands here in its line" for i in range(20))
    rows = [(1, good, 0), (1, good, 1), (2, good + " end", 2), (3, None, 3), (4, "", 4), (5, " \n", 5), (None, "other " + good[::-1], 6), (6, ("long text " * 3 + good) * 500, 7), (7, "x" * 1_000_000, 8)]
    names = "n_words quality kept score vote_length measures component_id stays hit key2 sequence_id length".split()
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").selectExpr("*", *(f"{i} as {c}" for i, c in enumerate(names)))
    for name, stage in P.STAGES[:3]:
        out = stage(spark, df, DIRECTORY)
        assert out.columns == df.columns and out.dtypes == df.dtypes
        got = out.collect()
        assert all(r[c] == i for r in got for i, c in enumerate(names))
        here = sorted(r["n_chars"] for r in got)
        if name == "quality_rules":
            judged = quality_rules.judge(df.select(F.col("n_chars").alias("doc_id"), "text"))
            assert here == sorted(r["doc_id"] for r in judged.where("kept").collect()) and not {3, 4, 5} & set(here)
        elif name == "toxicity":
            assert here == list(range(9))
        else:
            # 2 and 7 have the shingles of the first text and few others
            assert here in ([0, 3, 4, 5, 6, 8], [1, 3, 4, 5, 6, 8])
    packed = P.STAGES[3][1](spark, df, DIRECTORY)
    assert packed.count() >= len(rows) and packed.where("length > 2048").isEmpty()
