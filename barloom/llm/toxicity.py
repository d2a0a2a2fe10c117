"""Toxicity of texts whose words may be disguised: a noisy channel restores them, a trained score judges the result.

A character trigram model is counted over all documents. Words with letters written as digits or signs, stretched
letters, or single letters set apart form lattices, and a Viterbi decoder picks the reading that the model and the
channel's costs make likeliest. Word features of the restored text are weighed by label counts, and a small logistic
regression over the strongest evidence of a document gives its score.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm._common import bitmap_prefilter, free_name, materialize, release, small_batches, worker_cache

#: What a sign may stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "li", "+": "t", "€": "e", "(": "c"}
#: Costs of the channel, in nats.
SUBSTITUTION, STRETCH, DOUBLED, GAP = 0.7, 0.3, 2.5, 0.5
#: A doubled letter whose log probability in its place is below this is looked into.
RARE_DOUBLE = -5.0
CLASSES = 52
#: What a worker remembers of words, about, in bytes; pieces over LONG_PIECE characters are not remembered.
CACHED_BYTES, LONG_PIECE = 48_000_000, 64
#: Texts that a worker holds as objects at a time.
SLICE = 100
#: Defaults of least_docs and least_share: a feature must occur in so many toxic documents, and in this share of them.
LEAST_DOCS, LEAST_SHARE = 5, 0.002
#: Parts of the taught rows: the regression sees a part's evidence under weights that the other parts gave.
FOLDS = 4
#: Documents' worth of prior belief that a feature tells nothing.
PRIOR_DOCS = 10.0

_CLASS_OF = np.full(65536, 51, np.uint8)
for _c in range(128, 65536):
    if chr(_c).isalpha():
        _CLASS_OF[_c] = 27 + _c % 24
_CLASS_OF[[9, 10, 11, 12, 13, 32]] = 0
_CLASS_OF[97:123] = np.arange(1, 27)

_APART = re.compile(r"(?<!\S)\S(?: {1,2}\S){2,}(?!\S)")
#: What every such run has after a space is put in front; found at a fraction of the cost.
_MAYBE_APART = re.compile(r" \S {1,2}\S {1,2}\S")
_GAPS = " .-_*"
_SPELLED = re.compile(r"\w[.\-_*]+\w")
_STRETCHED = re.compile(r"([^\W\d_])\1")
_EDGES = ".,;:?!\"'()[]{}*#%&<>|~`"


def _classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return _CLASS_OF[np.minimum(points, 65535)].astype(np.int64)


def _count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(CLASSES**3, np.int64)
    for b in batches:
        texts = [x for x in b.column("text").to_pylist() if x]
        for i in range(0, len(texts), 200):
            c = _classes(" ".join(["", *texts[i : i + 200], ""]).lower())
            total += np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=len(total))
    found = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["gram", "n"])


def language_model(texts: DataFrame) -> np.ndarray:
    """log P(third class | first two), of shape (CLASSES,) * 3, from all texts; its size depends on CLASSES alone."""
    counts = texts.select("text").mapInArrow(_count_trigrams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    n3 = np.zeros(CLASSES**3)
    with small_batches(texts.sparkSession):
        for r in counts.collect():  # at most CLASSES**3 rows
            n3[r["gram"]] = r["n"]
    n3 = n3.reshape((CLASSES,) * 3)
    n2 = n3.sum(axis=0)
    p1 = (n2.sum(axis=0) + 1) / (n2.sum() + CLASSES)
    p2 = (n2 + 20 * p1) / (n2.sum(axis=1, keepdims=True) + 20)
    return np.log((n3 + 5 * p2[None]) / (n3.sum(axis=2, keepdims=True) + 5)).astype(np.float32)


def decode(span: str, lm: np.ndarray, gaps: bool) -> str:
    """The likeliest reading of a lower-case span. States are the last two classes read; each keeps its best path.

    A letter may be what a sign stands for, the second of two equal letters may be a stretch, and with gaps a separator
    may be nothing; anything may be itself. Paths are linked backwards, so a span costs time in proportion to its length.
    """
    best = {(0, 0): (0.0, None)}
    before = ""
    for i, c in enumerate(span):
        cls = int(_CLASS_OF[min(ord(c), 65535)])
        arcs = [(c, 0.0)] if c not in LEET else [(x, SUBSTITUTION) for x in LEET[c]] + [(c, 0.0)]
        arcs = [(x, cost, int(_CLASS_OF[min(ord(x), 65535)])) for x, cost in arcs]
        drop = None
        if gaps and c in _GAPS:
            drop = GAP
        elif c == before and cls not in (0, 51):
            drop = STRETCH if c in (span[i - 2 : i - 1], span[i + 1 : i + 2]) else DOUBLED
        before = c
        now: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, path) in best.items():
            if drop is not None and score - drop > now.get((a, b), (-1e30,))[0]:
                now[a, b] = score - drop, path
            for letter, cost, k in arcs:
                s = score - cost + float(lm[a, b, k])
                if s > now.get((b, k), (-1e30,))[0]:
                    now[b, k] = s, (letter, path)
        best = now
    _, _, path = max(((score + float(lm[a, b, 0]), (a, b), path) for (a, b), (score, path) in best.items()), key=lambda x: x[:2])
    letters = []
    while path:
        letter, path = path
        letters.append(letter)
    return "".join(reversed(letters))


def _odd_doubles(word: str, lm: np.ndarray) -> bool:
    """Whether a letter stands twice where that is rare (or three times): only then is a reading without it worth a search."""
    for m in _STRETCHED.finditer(word):
        i = m.start()
        if word[i + 2 : i + 3] == word[i]:
            return True
        a, k = (int(_CLASS_OF[min(ord(c), 65535)]) for c in (word[i - 1] if i else " ", word[i]))
        if lm[a, k, k] < RARE_DOUBLE:
            return True
    return False


def restore_word(word: str, lm: np.ndarray) -> str:
    """A lower-case word without the punctuation around it, and decoded if it has anything to decode."""
    core = word.strip(_EDGES)
    bare = core.rstrip("$") if core.endswith("$$") else core
    if bare.isalpha():
        return decode(bare, lm, False) if _odd_doubles(bare, lm) else bare
    if not any(map(str.isalpha, bare)):
        return bare
    if word[:1] in "!|(" and len(word) > 1 and word[1].isalnum():
        bare = word[0] + bare  # a leading sign may be a letter
    spelled = bool(_SPELLED.search(bare))
    if spelled or any(c in LEET for c in bare) or _odd_doubles(bare, lm):
        return decode(bare, lm, spelled)
    return bare


def _pieces(text: str | None) -> list[str]:
    """Lower-case words of the text; runs of three or more single letters, one or two spaces apart, are one piece."""
    low = (text or "").lower()
    if not _MAYBE_APART.search(" " + low):
        return low.split()
    words: list[str] = []
    at = 0
    for m in _APART.finditer(low):
        words += low[at : m.start()].split()
        words.append(m[0])
        at = m.end()
    return words + low[at:].split()


def restored_words(text: str | None, restore) -> list[str]:
    """Words of the text as restore() gives them; set-apart letters are decoded together."""
    return [w for piece in map(restore, _pieces(text)) for w in piece.split()]


def features(word: str) -> set[str]:
    """The word (=), its beginnings of 4 to 6 letters (<) and its ends of 4 and 5 (>)."""
    return {f"={word}"} | {f"<{word[:k]}" for k in (4, 5, 6) if len(word) > k} | {f">{word[-k:]}" for k in (4, 5) if len(word) > k}


def _weigher(weights: dict[str, float]):
    """The largest weight of a word's features, 0 without any."""
    whole, starts, ends = ({x[1:]: w for x, w in weights.items() if x[0] == kind} for kind in "=<>")

    def weigh(word: str) -> float:
        n = len(word)
        found = whole.get(word, 0.0)
        if n > 4:
            found = max(found, starts.get(word[:4], 0.0), ends.get(word[-4:], 0.0))
            if n > 5:
                found = max(found, starts.get(word[:5], 0.0), ends.get(word[-5:], 0.0))
                if n > 6:
                    found = max(found, starts.get(word[:6], 0.0))
        return found

    return weigh


class _Cached(dict):
    """Values by word, up to CACHED_BYTES of them; then it starts anew."""

    def __init__(self, make):
        self.make, self.held = make, 0

    def __missing__(self, key):
        value = self.make(key)
        if len(key) > LONG_PIECE:
            return value
        if self.held > CACHED_BYTES:
            self.clear()
            self.held = 0
        self.held += 200 + (sum(70 + len(x) for x in value) if isinstance(value, tuple) else 0)
        self[key] = value
        return value


def _worker(model: dict, kind: str, make) -> _Cached:
    """What a Python worker remembers of words under a model, of one kind at a time."""
    return worker_cache(f"{kind} {model['name']}", lambda: _Cached(make))


def _restorer(model: dict):
    lm = model["lm"]
    return lambda w: decode(w, lm, True) if " " in w else restore_word(w, lm)


def _named(**model) -> dict:
    digest = hashlib.sha1(model["lm"].tobytes() + repr(sorted(model.get("weights", {}).items())).encode()).hexdigest()
    return model | {"name": digest}


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[str | None, int]]]:
    """Texts and their folds, a slice at a time."""
    for b in batches:
        for i in range(0, len(b), SLICE):
            part = b.slice(i, SLICE)
            yield list(zip(part.column("text").to_pylist(), part.column("fold").to_pylist(), strict=True))


def _counted(counts: list[Counter]) -> pa.RecordBatch:
    rows = [(x, fold, n) for fold, own in enumerate(counts) for x, n in own.items()]
    return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.string(), pa.int32(), pa.int64()))], names=["feature", "fold", "n"])


def _toxic_features(model: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _worker(model, "words", _restorer(model)).__getitem__
        for texts in _sliced(batches):
            counts: list[Counter] = [Counter() for _ in range(FOLDS)]
            for text, fold in texts:
                words = {w for r in map(known, set(_pieces(text))) for w in ((r,) if " " not in r else r.split())}
                counts[fold].update(set().union(*map(features, words - {""})))
            yield _counted(counts)

    return run


def _clean_features(model: dict, wanted: frozenset):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore = _restorer(model)
        known = _worker(model, "features", lambda piece: tuple(x for r in restore(piece).split() for x in features(r) if x in wanted))
        counts: list[Counter] = [Counter() for _ in range(FOLDS)]
        for texts in _sliced(batches):
            for text, fold in texts:
                counts[fold].update(set().union(*map(known.__getitem__, set(_pieces(text)))))
        yield _counted(counts)

    return run


EVIDENCE = ("strongest", "three", "strong", "rate")


def evidence(weights: np.ndarray) -> tuple[float, float, float, float]:
    """The strongest weight, the mean of the three strongest, how many are over 2 (log) and their share."""
    if not len(weights):
        return 0.0, 0.0, 0.0, 0.0
    top = np.sort(weights[weights > 0])[::-1][:3]
    strong = int((weights > 2).sum())
    return float(top[0]) if len(top) else 0.0, float(top.sum() / 3), float(np.log1p(strong)), float(np.sqrt(strong / len(weights)))


def _evidence(model: dict):
    def run(text: pa.Array) -> pa.Array:
        restore, weigh = _restorer(model), _weigher(model["weights"])

        def heaviest(piece: str) -> float:
            r = restore(piece)
            return weigh(r) if " " not in r else max(map(weigh, r.split()), default=0.0)

        weight = _worker(model, "weights", heaviest).__getitem__
        rows = []
        for i in range(0, len(text), SLICE):
            for words in map(_pieces, text[i : i + SLICE].to_pylist()):
                rows.append(evidence(np.fromiter(map(weight, words), float, len(words))))
        return pa.StructArray.from_arrays([pa.array([r[j] for r in rows], pa.float64()) for j in range(len(EVIDENCE))], names=list(EVIDENCE))

    return F.arrow_udf(run, ", ".join(f"{c} double" for c in EVIDENCE))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _by_fold(found: DataFrame) -> DataFrame:
    """feature, ns: its documents in each fold, from counts (feature, fold, n) of tasks."""
    ns = F.array(*(F.coalesce(F.sum(F.when(F.col("fold") == f, F.col("n"))), F.lit(0)) for f in range(FOLDS)))
    return found.groupBy("feature").agg(ns.alias("ns"))


def _collected(spark: SparkSession, found: DataFrame) -> dict[str, np.ndarray]:
    with small_batches(spark):
        return {r["feature"]: np.array(r["ns"]) for r in found.collect()}


def _weights(positive: dict[str, np.ndarray], negative: dict[str, np.ndarray], taught: np.ndarray, least_docs: int, least_share: float, without: int | None = None) -> dict[str, float]:
    """Log odds of features over the folds (but one); taught: rows by class and fold."""
    used = np.arange(FOLDS) != (-1 if without is None else without)
    clean, toxic = taught[:, used].sum(axis=1).tolist()
    if not clean or not toxic:
        return {}
    base, least, none = toxic / (clean + toxic), _least(toxic, least_docs, least_share), np.zeros(FOLDS, int)
    counts = ((x, int(ns[used].sum()), int(negative.get(x, none)[used].sum())) for x, ns in positive.items())
    odds = {x: float(np.log((k + PRIOR_DOCS * base) / (n + PRIOR_DOCS * (1 - base))) - np.log(base / (1 - base))) for x, k, n in counts if k >= least}
    return {x: w for x, w in odds.items() if w > 0.5}


def _least(toxic: int, least_docs: int, least_share: float) -> int:
    """Toxic documents that a feature needs; where there are fewer than least_docs, all of them."""
    return max(1, min(least_docs, toxic), int(least_share * toxic))


def fit(texts: DataFrame, labels: DataFrame, least_docs: int = LEAST_DOCS, least_share: float = LEAST_SHARE) -> tuple[dict, list[float]] | None:
    """(word model, intercept and coefficients of EVIDENCE) from texts (doc_id, text) and labels; None without both classes.

    The regression is cross-fitted: a row's evidence comes from weights that rows of other folds gave, as it will for a
    text that taught nothing. The weights that are returned come from all folds. A feature needs least_docs toxic
    documents (all, if there are fewer) and the least_share of them: that share bounds what the driver collects.
    """
    taught = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    taught = taught.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # labels grow with the documents, so the texts meet them in a shuffle join, once; a text taught twice is one teacher
    known = bitmap_prefilter(texts.where("doc_id is not null"), "doc_id", taught.select("doc_id")).join(taught.hint("merge"), "doc_id")
    known = known.withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(1), "text")})
    fold = F.pmod("k1", F.lit(FOLDS)).cast("int")
    taught = materialize(known.groupBy("k1", "k2", "toxic").agg(F.first("text").alias("text")).select("text", "toxic", fold.alias("fold")))
    n = np.zeros((2, FOLDS), int)
    for r in taught.where("toxic in (0, 1)").groupBy("toxic", "fold").count().collect():
        n[r["toxic"], r["fold"]] = r["count"]
    if not n.sum(axis=1).all():
        return None

    spark, lm = texts.sparkSession, language_model(texts)
    model = _named(lm=lm)
    least = _least(int(n[1].sum()), least_docs, least_share)
    # at most (features of a document) / least_share can pass, whatever the size of the corpus
    found = _by_fold(taught.where("toxic = 1").select("text", "fold").mapInArrow(_toxic_features(model), "feature string, fold int, n long"))
    positive = _collected(spark, found.where(F.aggregate("ns", F.lit(0).cast("long"), lambda total, x: total + x) >= least))
    clean = taught.where("toxic = 0").select("text", "fold").mapInArrow(_clean_features(model, frozenset(positive)), "feature string, fold int, n long")
    negative = _collected(spark, _by_fold(clean))

    def weighed(without: int | None = None) -> dict:
        return _named(lm=lm, weights=_weights(positive, negative, n, least_docs, least_share, without))

    parts = [taught.where(F.col("fold") == f).select("toxic", _evidence(weighed(f))("text").alias("e")) for f in range(FOLDS)]
    rows = materialize(reduce(DataFrame.unionByName, parts).select("toxic", "e.*"))
    assembled = VectorAssembler(inputCols=list(EVIDENCE), outputCol="x").transform(rows)
    fitted = LogisticRegression(featuresCol="x", labelCol="toxic", regParam=0.001).fit(assembled)
    release(taught, rows)
    return weighed(), [float(fitted.intercept), *map(float, fitted.coefficients)]


def apply(docs: DataFrame, fitted: tuple[dict, list[float]] | None, name: str = "score") -> DataFrame:
    """docs (with a text column) and its score as the column `name`; only the text goes to Python, nothing is shuffled."""
    if fitted is None:
        return docs.withColumn(name, F.lit(0.0))
    model, (intercept, *coefficients) = fitted
    seen = docs.withColumn(name, _evidence(model)(F.col("text").cast("string")))
    z = F.lit(intercept)
    for c, k in zip(EVIDENCE, coefficients, strict=True):
        z = z + F.col(f"{name}.{c}") * k
    return seen.withColumn(name, 1 / (1 + F.exp(-z)))


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1), predicted (1 if score >= threshold).

    labels (doc_id, toxic) teach only where crc32(doc_id as text) mod 4 is not 2; every such text teaches, equal texts of
    one label once. Only the text enters a score. Null and empty texts get the score of no evidence; without toxic and
    clean labelled rows every score is 0. Null labels and ids teach nothing, repeated rows score alike, other columns
    are ignored, and an empty table gives no rows. Words broken by a single space are not put together again.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = apply(texts, fit(texts, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of docs (doc_id, text) with a score below threshold, with all their columns, whatever these are called."""
    own = free_name(docs, "score")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return apply(docs, fit(texts, labels), own).where(F.col(own) < threshold).drop(own)
