"""Weak supervision of quality: rules vote or abstain, EM estimates how far each can be trusted, a posterior decides."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm._common import free_name, materialize

_SYMBOLS = b"#*$%&|<>"
_WORD_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]

#: Texts that a Python worker holds as objects at a time.
SLICE = 500

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_upper long, n_letters long, n_marks long, n_plain_words long, n_distinct_words long"


def repeated_words(words: list[bytes], size: int = 5) -> int:
    """Words that stand in a window of `size` words which the text has twice or more, the first one included."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.uint64, len(words))
    h = np.zeros(n, np.uint64)
    for j in range(size):
        x = (w[j : j + n] + np.uint64(j + 1)) * _WORD_MIX[j % len(_WORD_MIX)]
        h = (h ^ x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    _, inverse, counts = np.unique(h, return_inverse=True, return_counts=True)
    again = np.flatnonzero(counts[inverse] > 1)
    steps = np.zeros(len(words) + 1, np.int64)
    np.add.at(steps, again, 1)
    np.add.at(steps, again + size, -1)
    return int((np.cumsum(steps[:-1]) > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The numbers of MEASURES. Words lie between ASCII white space; a letter's case counts for A-Z and a-z alone."""
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return (0,) * 10
    octets = np.frombuffer(raw, np.uint8)
    seen = np.bincount(octets, minlength=256)
    white = int(seen[9:14].sum() + seen[32])
    starts = int(seen[:128].sum() + seen[192:].sum())  # bytes that begin a code point
    upper, lower = int(seen[65:91].sum()), int(seen[97:123].sum())
    lines, dup = set(), 0
    for line in raw.split(b"\n"):
        if line in lines:
            dup += bool(line.split())
        else:
            lines.add(line)
    plain = sum(map(bytes.isalpha, (w.strip(b".,;:") for w in words))) if raw.isascii() else sum(map(str.isalpha, (w.strip(".,;:") for w in text.split())))
    return (len(words), starts - white, int(seen[list(_SYMBOLS)].sum()), dup, repeated_words(words), upper, upper + lower, raw.count(b"!!"), plain, len(set(words)))


def _measured(text: pa.Array) -> pa.Array:
    names = [x.split()[0] for x in MEASURES.split(", ")]
    rows = [np.array([measure(t) for t in text[i : i + SLICE].to_pylist()], np.int64) for i in range(0, len(text), SLICE)]
    table = np.concatenate(rows) if rows else np.zeros((0, len(names)), np.int64)
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(table[:, j])) for j in range(len(names))], names=names)


def measures(text: str) -> Column:
    """A struct of MEASURES of a text column. Only the text goes to Python; the row's other columns stay where they are."""
    return F.arrow_udf(_measured, MEASURES)(F.col(text).cast("string"))


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules(of: str = "") -> dict[str, Column]:
    """-1: a bad document, 1: a good one, 0: the rule abstains. of: a prefix of the columns of MEASURES.

    Lengths enter as shares of the words, but for variety: the logarithm of the distinct words, as a share of that of
    all words, hardly falls as natural texts get longer. Of fewer than 20 words it says nothing.
    """
    c = lambda name: F.col(f"{of}{name}")
    n, various = c("n_words"), F.log(c("n_distinct_words").cast("double")) / F.log(c("n_words").cast("double"))
    return {
        "length": _vote(n < 10, n >= 40),
        "symbols": _vote(c("n_symbols") > 0.1 * n, c("n_symbols") <= 0.02 * n),
        "repeats": _vote(c("n_repeat_words") > 0.2 * n, c("n_repeat_words") <= 0.05 * n),
        "lines": _vote((c("n_dup_lines") > 3) & (10 * c("n_dup_lines") > 0.3 * n), c("n_dup_lines") == 0),
        "capitals": _vote(c("n_upper") > 0.3 * c("n_letters"), c("n_upper") <= 0.12 * c("n_letters")),
        "marks": _vote(c("n_marks") > 0.05 * n, c("n_marks") <= 0.005 * n),
        "word_size": _vote((c("word_chars") < 2.5 * n) | (c("word_chars") > 12 * n), c("word_chars").between(3 * n, 9 * n)),
        "plain": _vote(c("n_plain_words") < 0.7 * n, c("n_plain_words") >= 0.9 * n),
        "variety": F.when(n < 20, 0).otherwise(_vote(various < 0.65, various >= 0.8)),
    }


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 200) -> tuple[float, np.ndarray]:
    """EM over vote patterns and their counts: (share of good documents, p[class, rule, vote + 1]), class 1 is good.

    Each rule has its own chances of voting bad, abstaining and voting good in either class (one pseudo-count each).
    The start takes a document with any bad vote as likely bad, which names the classes; a rule is not let to be
    likelier to vote bad on good documents than on bad ones.
    """
    m = len(patterns[0][0]) if patterns else 0
    if not patterns:
        return 0.5, np.full((2, m, 3), 1 / 3)
    votes = np.array([p for p, _ in patterns]) + 1
    weight = np.array([n for _, n in patterns], float)
    bad = np.where((votes == 0).any(axis=1), 0.9, 0.02)
    one = np.stack([votes == v for v in range(3)], axis=2).astype(float)  # pattern, rule, vote
    for _ in range(rounds):
        share = np.stack([bad, 1 - bad]) * weight  # class, pattern
        p = np.einsum("cp,prv->crv", share, one) + 1
        p /= p.sum(axis=2, keepdims=True)
        wrong = p[0, :, 0] < p[1, :, 0]
        p[:, wrong] = p[:, wrong].mean(axis=0)
        good = float((share[1].sum() + 1) / (weight.sum() + 2))
        log = np.einsum("prv,crv->cp", one, np.log(p)) + np.log([[1 - good], [good]])
        now = 1 / (1 + np.exp(np.clip(log[1] - log[0], -700, 700)))
        if np.abs(now - bad).max() < 1e-9:
            break
        bad = now
    return good, p


def learn(measured: DataFrame, of: str = "") -> tuple[float, np.ndarray] | None:
    """fit() on the vote patterns of all rows, of which there are at most 3 to the number of rules."""
    votes = rules(of)
    counted = measured.select(*(v.alias(k) for k, v in votes.items())).groupBy(*votes).agg(F.count("*").alias("n"))
    patterns = [(tuple(r[k] for k in votes), r["n"]) for r in counted.collect()]
    return fit(sorted(patterns)) if patterns else None


def quality(learned: tuple[float, np.ndarray] | None, of: str = "") -> Column:
    """The posterior of being good."""
    votes = rules(of)
    good, p = learned or (0.5, np.full((2, len(votes), 3), 1 / 3))
    log = F.lit(float(np.log(good) - np.log(1 - good)))
    for v, r in zip(votes.values(), np.log(p[1]) - np.log(p[0]), strict=True):
        log = log + F.when(v == -1, float(r[0])).when(v == 0, float(r[1])).otherwise(float(r[2]))
    return 1 / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), log))))


def failed(of: str = "") -> Column:
    n = F.col(f"{of}n_words")
    return (n < 10) | (100 * F.col(f"{of}n_repeat_words") > 20 * n)


def judge(docs: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the measures, each rule's vote, quality (posterior of being good), base_failed and kept.

    kept needs quality >= threshold and not base_failed (n_words < 10, or 100 * n_repeat_words > 20 * n_words). Votes of
    all rows are counted by pattern; EM runs on those counts. A null or wordless text has zeros and is not kept.
    Repeated rows are judged alike, null ids are kept as they are, other columns are ignored, and an empty table gives
    no rows.
    """
    measured = docs.select(F.col(id_col).cast("long").alias("doc_id"), measures(text_col).alias("m")).select("doc_id", "m.*")
    measured = materialize(measured)
    learned = learn(measured)
    judged = measured.withColumns({f"vote_{k}": v for k, v in rules().items()} | {"quality": quality(learned), "base_failed": failed()})
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))


def keep_good(docs: DataFrame, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns, whatever these are called.

    Texts are measured once: docs and their measures are written, the rules learn from the measures, and the kept rows
    are read back.
    """
    own = free_name(docs, "measures")
    measured = materialize(docs.withColumn(own, measures(text_col)))
    of = f"{own}."
    learned = learn(measured, of)
    return measured.where(~failed(of) & (quality(learned, of) >= threshold)).drop(own)
