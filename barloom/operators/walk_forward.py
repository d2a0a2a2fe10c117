"""Walk-forward evaluation: models that are fitted on the past of each fold alone, and the rows they predict there.

Rows are stored once, and blocks of dates follow from the blocks' last dates. Fold k learns from the blocks before the
k-th and predicts the k-th from `embargo_days` after the last date that it learnt from. Scaling, penalties
and early stopping are learnt within a fold's training rows. Fits of Spark ML run several at a time, each over all cores.

Ridge needs no fit of its own for a fold, feature set or penalty: sums of products by block are gathered in one pass
(a few numbers a block, whatever its rows), the folds' sums follow by adding blocks up, and one decomposition of a
fold's matrix gives the weights for every penalty. A second pass sums the exact leave-one-out errors of all of them.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator
from functools import reduce
from multiprocessing.pool import ThreadPool
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.ranges import average_rank
from barloom.operators.evaluate import assemble, spread, standard_scale, temporal_split
from barloom.sources.scratch import release, written

#: The penalties that ridge is tried with, and those of the model over models.
PENALTIES = (0.01, 0.1, 1.0, 10.0, 100.0, 1000.0)
STACK_PENALTIES = (0.1, 1.0, 10.0)


class Fold(NamedTuple):
    """It learns from block 0 to number - 1, up to train_end, and predicts the block `number` from test_start on."""

    number: int
    train_end: datetime.date
    test_start: datetime.date


class Folds:
    """Rows with their block, and the folds over them that have `least` rows on either side.

    rows has a date and whatever else is wanted; days fall into folds + 1 blocks of as many dates each, the last one
    with what remains. The blocks' ends and row counts are all that the driver sees. release(folds.rows) deletes the
    stored rows.
    """

    def __init__(self, rows: DataFrame, folds: int = 5, embargo_days: int = 30, least: int = 100, date: str = "Date"):
        kept = written(rows)  # computed once, however much stands behind it
        days = kept.groupBy(date).agg(F.count("*").alias("_n"))
        w = Window.orderBy(date)  # one row a date
        size = F.greatest(F.floor(F.count("*").over(Window.partitionBy()) / (folds + 1)), F.lit(1))
        days = written(days.withColumn("block", F.least(F.floor((F.row_number().over(w) - 1) / size), F.lit(folds)).cast("int")))
        ends = {r["block"]: (r["end"], r["n"]) for r in days.groupBy("block").agg(F.max(date).alias("end"), F.sum("_n").alias("n")).collect()}
        starts = {k + 1: end + datetime.timedelta(days=embargo_days) for k, (end, _) in ends.items()}
        tested = {}
        if starts:
            start = F.create_map(*(F.lit(x) for kv in starts.items() for x in kv))[F.col("block")]
            tested = {r["block"]: r["n"] for r in days.where(F.col(date) >= start).groupBy("block").agg(F.sum("_n").alias("n")).collect()}
        learnt = lambda k: sum(n for b, (_, n) in ends.items() if b < k)
        self.date = date
        self.folds = [Fold(k, ends[k - 1][0], starts[k]) for k in sorted(tested) if k and learnt(k) >= least and tested[k] >= least]
        block = reduce(lambda x, k: F.when(F.col(date) <= F.lit(ends[k][0]), k).otherwise(x), sorted(ends, reverse=True)[1:], F.lit(max(ends, default=0)))
        self.rows = kept.where(F.col(date).isNotNull()).withColumn("block", block.cast("int"))
        self.rows._written = kept._written
        release(days)

    def train(self, fold: Fold) -> DataFrame:
        return self.rows.where(F.col(self.date) <= F.lit(fold.train_end))

    def test(self, fold: Fold) -> DataFrame:
        return self.rows.where((F.col("block") == fold.number) & (F.col(self.date) >= F.lit(fold.test_start)))


def _blocks(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Block numbers and columns (null: 0) of each batch."""
    for b in batches:
        wide = np.column_stack([np.nan_to_num(b.column(c).to_numpy(zero_copy_only=False).astype("f8"), nan=0.0) for c in columns]) if len(b) else np.zeros((0, len(columns)))
        yield b.column("block").to_numpy(zero_copy_only=False), wide


def block_moments(rows: DataFrame, columns: list[str], shift: np.ndarray) -> dict[int, np.ndarray]:
    """By block, the sums of products of (1, columns - shift): a square matrix. Each task sends one for each of its blocks."""
    n = len(columns) + 1

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for blocks, x in _blocks(batches, columns):
            x = np.column_stack([np.ones(len(x)), x - shift])
            for k in np.unique(blocks).tolist():
                own = x[blocks == k]
                held[k] = held.get(k, 0) + own.T @ own
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([m.ravel() for m in held.values()], pa.list_(pa.float64()))], names=["block", "m"])

    parts = rows.select("block", *(F.col(c).cast("double").alias(c) for c in columns)).mapInArrow(gather, "block int, m array<double>")
    sums = parts.select("block", F.posexplode("m")).groupBy("block", "pos").agg(F.sum("col").alias("v"))
    out: dict[int, np.ndarray] = {}
    for r in sums.collect():  # a matrix for each block
        out.setdefault(r["block"], np.zeros(n * n))[r["pos"]] = r["v"]
    return {k: m.reshape(n, n) for k, m in out.items()}


class Ridge(NamedTuple):
    """A fold's standardised problem for one feature set, decomposed: weights for any penalty are turned @ (pull / (values + penalty))."""

    fold: int
    name: str
    at: list[int]
    n: float
    mean: np.ndarray
    scale: np.ndarray
    level: float
    values: np.ndarray
    turned: np.ndarray
    pull: np.ndarray

    def weights(self, penalty: float) -> tuple[np.ndarray, float]:
        """For columns as they are: factors and what is added."""
        w = self.turned @ (self.pull / (self.values + penalty)) / self.scale
        return w, self.level - float(w @ self.mean)


def _problem(fold: int, name: str, at: list[int], m: np.ndarray, shift: np.ndarray, y: int) -> Ridge:
    n, mean = m[0, 0], m[0, 1:] / m[0, 0]
    c = m[1:, 1:] - n * np.outer(mean, mean)
    deviation = np.sqrt(np.maximum(np.diag(c)[at], 0) / n)
    scale = np.where(deviation > 1e-12, deviation, 1.0)
    values, turned = np.linalg.eigh(c[np.ix_(at, at)] / np.outer(scale, scale))
    return Ridge(fold, name, at, n, (mean + shift)[at], scale, float(mean[y] + shift[y]), np.maximum(values, 0), turned, turned.T @ (c[at, y] / scale))


def _left_out(rows: DataFrame, columns: list[str], problems: list[Ridge], penalties: tuple[float, ...]) -> dict[tuple[int, str], np.ndarray]:
    """By fold and feature set, for each penalty the sum of squared leave-one-out errors of the training rows: exact, in one pass."""
    by_fold: dict[int, list[tuple[int, Ridge]]] = {}
    for i, p in enumerate(problems):
        by_fold.setdefault(p.fold, []).append((i, p))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(problems), len(penalties)))
        for blocks, x in _blocks(batches, columns):
            for fold, its in by_fold.items():
                past = x[blocks < fold]
                for i, p in its:
                    u = past[:, p.at] @ (p.turned / p.scale[:, None]) - (p.mean / p.scale) @ p.turned
                    shrunk = 1 / (p.values[:, None] + np.array(penalties))  # a column for each penalty
                    off = past[:, -1:] - p.level - u @ (p.pull[:, None] * shrunk)
                    off /= np.maximum(1 - 1 / p.n - (u * u) @ shrunk, 1e-9)
                    sums[i] += np.einsum("ij,ij->j", off, off)
        yield pa.RecordBatch.from_arrays([pa.array(list(range(len(problems))), pa.int32()), pa.array(list(sums), pa.list_(pa.float64()))], names=["i", "s"])

    parts = rows.select("block", *(F.col(c).cast("double").alias(c) for c in columns)).mapInArrow(gather, "i int, s array<double>")
    out = {(p.fold, p.name): np.zeros(len(penalties)) for p in problems}
    for r in parts.select("i", F.posexplode("s")).groupBy("i", "pos").agg(F.sum("col").alias("v")).collect():
        out[problems[r["i"]].fold, problems[r["i"]].name][r["pos"]] = r["v"]
    return out


def ridge(folds: Folds, feature_sets: dict[str, list[str]], label: str, penalties: tuple[float, ...] = PENALTIES) -> list[dict]:
    """For each fold and feature set: fold, feature_set, penalty (of the least leave-one-out error, then the smallest), columns, weights, intercept, error.

    Columns are standardised by the training rows' mean and population deviation (a constant one is only centred), the
    intercept is not penalised, null counts as 0.
    """
    columns = sorted({c for cs in feature_sets.values() for c in cs}) + [label]
    means = folds.rows.agg(*(F.avg(F.coalesce(F.col(c).cast("double"), F.lit(0.0))) for c in columns)).first()
    shift = np.array([x or 0.0 for x in means])
    by_block = block_moments(folds.rows, columns, shift)
    problems = []
    for f in folds.folds:
        m = sum(by_block[k] for k in by_block if k < f.number)
        problems += [_problem(f.number, name, [columns.index(c) for c in cs], m, shift, len(columns) - 1) for name, cs in feature_sets.items()]
    errors = _left_out(folds.rows, columns, problems, penalties)
    found = []
    for p in problems:
        error = errors[p.fold, p.name]
        best = int(np.argmin(np.round(error / p.n, 12)))
        w, level = p.weights(penalties[best])
        found.append({"fold": p.fold, "feature_set": p.name, "penalty": penalties[best], "columns": feature_sets[p.name], "weights": w.tolist(), "intercept": level, "error": float(error[best] / p.n)})
    return found


def ridge_predictions(folds: Folds, feature_sets: dict[str, list[str]], label: str, keep: list[str], penalties: tuple[float, ...] = PENALTIES, model: str = "Ridge") -> DataFrame:
    """fold, feature_set, model, keep, pred: the test rows of every fold as the ridge of its past sees them."""
    wide = ridge_columns(folds, feature_sets, label, keep, penalties)
    rows = F.inline(F.array(*(F.struct(F.lit(name).alias("feature_set"), F.col(name).alias("pred")) for name in feature_sets)))
    return wide.select("fold", *keep, rows).select("fold", "feature_set", F.lit(model).alias("model"), *keep, "pred")


def ridge_columns(folds: Folds, feature_sets: dict[str, list[str]], label: str, keep: list[str], penalties: tuple[float, ...] = PENALTIES) -> DataFrame:
    """fold, keep and a column for each feature set: the test rows of every fold as the ridge of its past sees them, in one pass."""
    preds: dict[str, dict[int, Column]] = {name: {} for name in feature_sets}
    for r in ridge(folds, feature_sets, label, penalties):
        pred = F.lit(r["intercept"])
        for c, w in zip(r["columns"], r["weights"], strict=True):
            pred = pred + F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * w
        preds[r["feature_set"]][r["fold"]] = pred
    tested = reduce(lambda x, f: x | ((F.col("block") == f.number) & (F.col(folds.date) >= F.lit(f.test_start))), folds.folds, F.lit(False))
    of = lambda by: reduce(lambda x, kv: F.when(F.col("block") == kv[0], kv[1]).otherwise(x), by.items(), F.lit(None).cast("double"))
    return folds.rows.where(tested).select(F.col("block").alias("fold"), *keep, *(of(by).alias(name) for name, by in preds.items()))


def boosted(seed: int = 0, label: str = "label", rounds: int = 300) -> dict:
    """Boosted trees of depth 4 and rate 0.02 three ways, as three libraries set them: all rows and columns, four fifths of
    either, and four fifths with at least 20 rows a leaf. They stop when the last tenth of the dates gains no more."""
    from pyspark.ml.regression import GBTRegressor

    given = dict(labelCol=label, maxDepth=4, stepSize=0.02, maxIter=rounds, validationIndicatorCol="validation", maxMemoryInMB=1024)
    return {
        "BoostedWhole": GBTRegressor(seed=seed, **given),
        "BoostedSampled": GBTRegressor(seed=seed + 1, subsamplingRate=0.8, featureSubsetStrategy="0.8", **given),
        "BoostedLeaves": GBTRegressor(seed=seed + 2, subsamplingRate=0.8, featureSubsetStrategy="0.8", minInstancesPerNode=20, **given),
    }


def predictions(folds: Folds, feature_sets: dict[str, list[str]], estimators: dict, keep: list[str], at_a_time: int = 4, only: list[Fold] | None = None, scaled: bool = False) -> DataFrame:
    """fold, feature_set, model, keep, pred: what Spark ML estimators, fitted on each fold's past, say of its test rows.

    An estimator gets the columns `features` (scaled by its training rows if asked for; null counts as 0) and `validation`
    (the last tenth of its training rows by date). A fold's training rows are dealt and stored once for all its models, with
    the columns that those read alone. at_a_time fits run side by side; what they predict is written, and a fit that lost
    executors starts from the stored rows again.
    """
    from pyspark import inheritable_thread_target

    labels = sorted({e.getOrDefault("labelCol") for e in estimators.values()})

    def prepared(fold: Fold, name: str) -> DataFrame:
        needed = list(dict.fromkeys([*feature_sets[name], *labels]))
        train = folds.train(fold).select(folds.date, *(c for c in needed if c != folds.date))
        train = temporal_split(train, 0.9, folds.date).withColumn("validation", F.col("side") == "test")
        return written(spread(train.select(*needed, "validation"), folds.train(fold).count()))

    def cell(fold: Fold, name: str, model: str) -> DataFrame:
        columns = feature_sets[name]
        train, test = assemble(stored[fold.number, name], columns), assemble(folds.test(fold), columns)
        if scaled:
            train, test = (x.drop("features").withColumnRenamed("scaled", "features") for x in standard_scale(train, test))
        fitted = estimators[model].copy().fit(train)
        return written(fitted.transform(test).select(F.lit(fold.number).alias("fold"), F.lit(name).alias("feature_set"), F.lit(model).alias("model"), *keep, F.col("prediction").alias("pred")))

    sides = [(f, name) for f in (folds.folds if only is None else only) for name in feature_sets]
    cells = [(f, name, model) for f, name in sides for model in estimators]
    with ThreadPool(max(1, min(at_a_time, len(cells)))) as pool:
        each = lambda of, items: pool.map(inheritable_thread_target(folds.rows.sparkSession)(lambda x: of(*x)), items)
        stored = {(f.number, name): table for (f, name), table in zip(sides, each(prepared, sides), strict=True)}
        parts = each(cell, cells)
    release(*stored.values())
    out = None
    for part in parts:
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("there is no fold with enough rows")
    return out


def stacked(oof: DataFrame, keys: list[str], truth: str, models: list[str], penalties: tuple[float, ...] = STACK_PENALTIES) -> DataFrame:
    """fold, feature_set, keys, truth, pred: a ridge over the models' out-of-fold predictions.

    That of fold k learns from the predictions of the folds before it, none of which saw the row, and whose dates all lie
    before its embargo; the first fold has none and takes the models' mean. The penalty is that of the least
    leave-one-out error. Rows that a model lacks are left out.
    """
    wide = oof.groupBy("fold", "feature_set", *keys, truth).pivot("model", models).agg(F.max("pred")).dropna(subset=models)
    wide = written(wide.withColumn("block", F.col("fold")), "block")
    mean = sum((F.col(m) for m in models[1:]), F.col(models[0])) / len(models)
    out = None
    for name in sorted(r[0] for r in wide.select("feature_set").distinct().collect()):  # one row a feature set
        own = wide.where(F.col("feature_set") == name)
        numbers = sorted(r[0] for r in own.select("fold").distinct().collect())
        past = Folds.__new__(Folds)
        past.rows, past.folds, past.date = own, [Fold(k, None, None) for k in numbers[1:]], ""
        found = {r["fold"]: r for r in ridge(past, {name: models}, truth, penalties)} if past.folds else {}
        pred = mean
        for k, r in found.items():
            pred = F.when(F.col("fold") == k, sum((F.col(c) * w for c, w in zip(r["columns"], r["weights"], strict=True)), F.lit(r["intercept"]))).otherwise(pred)
        rows = own.select("fold", "feature_set", *keys, truth, pred.alias("pred"))
        out = rows if out is None else out.unionByName(rows)
    return wide.select("fold", "feature_set", *keys, truth, mean.alias("pred")).where("false") if out is None else out


def ranked(oof: DataFrame) -> DataFrame:
    """oof with pred as its rank within the fold, feature set and model (ties averaged), as a share."""
    return average_rank(oof, "pred", ["fold", "feature_set", "model"], "pred")
