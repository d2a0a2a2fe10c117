"""Training by pairs of blocks: what a task holds, and how many pairs it gets."""

import tracemalloc

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from barloom.operators import graph as G


def test_a_task_holds_the_work_of_few_edges_at_once():
    rng, many, edges = np.random.default_rng(0), 200, 20_000
    own = pd.DataFrame({"h": rng.integers(0, many, edges), "r": rng.integers(0, 3, edges), "t": rng.integers(0, many, edges), "pair": 0})
    params = pd.DataFrame(
        [(0, i, np.r_[rng.normal(size=64), np.zeros(128)], 0) for i in range(many)] + [(1, i, np.r_[rng.normal(size=32), np.zeros(64)], 0) for i in range(3)],
        columns=["kind", "id", "state", "pair"],
    )
    tracemalloc.start()
    G._local_epochs(0.01, 6.0, 4, 0, 1, 1)(own, params)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40e6  # all edges at once take several arrays of 20,000 x 5 x 32 numbers, 26 MB each


def test_each_pair_of_blocks_is_a_task(spark):
    for n in (1, 3, 8, 20):
        slots = spark.createDataFrame([(x,) for x in G._slots(spark, n)], "pair int").repartition(n, "pair")
        assert slots.select(F.spark_partition_id()).distinct().count() == n


def test_single_precision_and_summed_ends_follow_the_gradient():
    """One step of a task against differences of its loss: own ends, drawn ends and relations all move against their gradient."""
    rng, many = np.random.default_rng(0), 12
    own = pd.DataFrame({"h": rng.integers(0, many, 30), "r": rng.integers(0, 2, 30), "t": rng.integers(0, many, 30), "pair": 0})
    start = [(0, i, rng.normal(size=8)) for i in range(many)] + [(1, i, rng.normal(size=4)) for i in range(2)]

    def run(values, rate):
        params = pd.DataFrame([(k, i, np.r_[x, np.zeros(2 * len(x))], 0) for k, i, x in values], columns=["kind", "id", "state", "pair"])
        return G._local_epochs(rate, 6.0, 4, 0, 1, 1)(own, params)

    out = run(start, 0.0)
    moments = {(r.kind, r.id): r.state for r in out[out.kind < 2].itertuples()}
    before = out[out.kind == 2]["state"].iloc[0][0]
    for at in (0, 5, 11, 12):
        kind, i, x = start[at]
        grad = moments[kind, i][len(x) : 2 * len(x)] / 0.1
        step = 1e-2 / max(np.abs(grad).max(), 1e-6)
        moved = [list(v) for v in start]
        moved[at][2] = x - step * grad
        after = run(moved, 0.0)
        assert np.abs(grad).max() > 1e-3 and after[after.kind == 2]["state"].iloc[0][0] < before


def test_an_edge_scatters_its_own_ends_once(monkeypatch):
    """An edge sends one row for each own end and one for each draw: 2 + n, where it sent 2 (n + 1)."""
    sent = []
    add = G._add
    monkeypatch.setattr(G, "_add", lambda total, at, rows: sent.append(at.size) or add(total, at, rows))
    rng = np.random.default_rng(0)
    own = pd.DataFrame({"h": rng.integers(0, 9, 40), "r": 0, "t": rng.integers(0, 9, 40), "pair": 0})
    params = pd.DataFrame([(0, i, np.r_[rng.normal(size=8), np.zeros(16)], 0) for i in range(9)] + [(1, 0, np.zeros(12), 0)], columns=["kind", "id", "state", "pair"])
    G._local_epochs(0.01, 6.0, 4, 0, 1, 1)(own, params)
    assert sum(sent) == 40 * (1 + 2 + 4)
