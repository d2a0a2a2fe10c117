"""A knowledge graph as a table of triples (s, p, o, o_kind, o_type), and patterns over it as joins."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.sources.scratch import release, written

COLUMNS = ("s", "p", "o", "o_kind", "o_type")
BASE = "ex:"


def mint_iri(prefix: str, label: str | Column) -> Column:
    """prefix and the label with spaces as underscores, percent-encoded but for slashes."""
    label = F.col(label) if isinstance(label, str) else label
    return F.concat(F.lit(prefix), F.replace(F.url_encode(F.replace(label.cast("string"), F.lit(" "), F.lit("_"))), F.lit("%2F"), F.lit("/")))


def iri(s: Column, p: str, o: Column) -> Column:
    return F.struct(s.alias("s"), F.lit(BASE + p).alias("p"), o.alias("o"), F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("o_type"))


def literal(s: Column, p: str, o: Column, kind: str | None = None) -> Column:
    return F.struct(s.alias("s"), F.lit(BASE + p).alias("p"), o.cast("string").alias("o"), F.lit("literal").alias("o_kind"), F.lit(kind).cast("string").alias("o_type"))


def triples(df: DataFrame, *rows: Column) -> DataFrame:
    """One triple for each row and expression; those without an object are left out. One pass, no shuffle."""
    return df.select(F.inline(F.array(*rows))).where("o is not null and s is not null")


def _known(c: str) -> Column:
    return F.when(~F.startswith(F.col(c), F.lit("Unknown")), F.col(c))


def company_triples(base: DataFrame) -> DataFrame:
    """Of (Symbol, Sector, Industry, size_class, volatility_class, Country, Region); unknown classes are skipped."""
    c, country = mint_iri(f"{BASE}company/", "Symbol"), mint_iri(f"{BASE}country/", "Country")
    return triples(
        base, iri(c, "type", F.lit(f"{BASE}Company")), iri(c, "belongsToSector", mint_iri(f"{BASE}sector/", "Sector")), iri(c, "inIndustry", mint_iri(f"{BASE}industry/", "Industry")),
        iri(c, "hasSize", mint_iri(f"{BASE}size/", _known("size_class"))), iri(c, "hasVolatility", mint_iri(f"{BASE}volatility/", _known("volatility_class"))),
        iri(c, "headquarteredIn", country), iri(country, "inRegion", mint_iri(f"{BASE}region/", "Region")),
    ).dropDuplicates()


def border_triples(borders: DataFrame) -> DataFrame:
    return triples(borders, iri(mint_iri(f"{BASE}country/", "country"), "sharesBorderWith", mint_iri(f"{BASE}country/", "neighbour"))).dropDuplicates()


def observation_triples(obs: DataFrame) -> DataFrame:
    """Of (Company, Date, Close, Volume, up, EUR): five for each observation, and the rate once for each date."""
    day = F.concat(F.lit(f"{BASE}date/"), F.col("Date").cast("string"))
    o = F.concat(F.lit(f"{BASE}obs/"), F.col("Company").cast("string"), F.lit("_"), F.col("Date").cast("string"))
    named = obs.withColumns({"_o": o, "_day": day, "_c": mint_iri(f"{BASE}company/", "Company")})  # each text is made once a row
    o = F.col("_o")
    each = triples(
        named, iri(F.col("_c"), "hasObservation", o), iri(o, "recordedOn", F.col("_day")), literal(o, "closePrice", F.col("Close"), "xsd:float"),
        literal(o, "tradeVolume", F.col("Volume"), "xsd:float"), literal(o, "target7dUp", F.col("up"), "xsd:integer"),
    )
    rates = triples(obs.select("Date", "EUR").distinct(), literal(day, "eurExchangeRate", F.col("EUR"), "xsd:float"))
    return each.unionByName(rates)


def acquisition_triples(acq: DataFrame, parents: dict | None = None) -> DataFrame:
    """Of (Symbol, acquired, yr, price): blank and '-' prices are skipped; parents maps names to symbols."""
    parent = F.col("Symbol").cast("string")
    if parents:
        parent = F.coalesce(F.create_map(*(F.lit(x) for kv in parents.items() for x in kv))[parent], parent)
    a = F.concat(F.lit(f"{BASE}acquisition/"), F.concat_ws("_", "Symbol", "acquired", "yr", F.coalesce(F.col("price").cast("string"), F.lit("none"))))
    price = F.when(~F.trim(F.col("price").cast("string")).isin("", "-"), F.col("price"))
    return triples(acq, iri(mint_iri(f"{BASE}company/", parent), "acquired", a), literal(a, "acquisitionYear", F.col("yr"), "xsd:integer"), literal(a, "acquisitionPrice", price, "xsd:float")).dropDuplicates()


def macro_triples(macro: DataFrame, borders: DataFrame, tensions: DataFrame) -> DataFrame:
    c = mint_iri(f"{BASE}country/", "country")
    own = triples(macro, iri(c, "type", F.lit(f"{BASE}Country")), literal(c, "gdpUsd", F.col("gdp_usd"), "xsd:float"))
    tense = triples(tensions, iri(c, "hasTensionWith", mint_iri(f"{BASE}country/", "rival")))
    return own.unionByName(border_triples(borders)).unionByName(tense).dropDuplicates()


def counts(graph: DataFrame, by: str = "p") -> DataFrame:
    return graph.groupBy(by).agg(F.count("*").alias("n"))


def local_name(c: str | Column) -> Column:
    return F.regexp_replace(c, r"^.*[:/#]", "")


def relation_summary(graph: DataFrame, k: int = 3) -> DataFrame:
    """(relation, s, o, n): up to k examples of each predicate in order of subject and object."""
    w = Window.partitionBy("p").orderBy("s", "o")
    return graph.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).select(local_name("p").alias("relation"), local_name("s").alias("s"), local_name("o").alias("o"), "n")


def str_after(c: str | Column, mark: str) -> Column:
    """What follows the first mark; '' without one."""
    c = F.col(c) if isinstance(c, str) else c
    at = F.instr(c, mark)
    return F.when(at > 0, F.substr(c, at + len(mark))).otherwise("")


def triples_to_wide(graph: DataFrame, names: list[str]) -> DataFrame:
    """One row per subject with a number column for each named predicate; rows without any go; _ in names becomes a space."""
    rows = graph.withColumns({"country": F.replace(local_name("s"), F.lit("_"), F.lit(" ")), "_p": local_name("p")})
    wide = rows.groupBy("country").pivot("_p", names).agg(F.max("o"))
    return wide.withColumns({n: F.col(n).try_cast("double") for n in names}).dropna("all", subset=names)


def structural_edges(graph: DataFrame, relations: list[str]) -> DataFrame:
    return graph.where(F.col("p").isin([BASE + r for r in relations]) & (F.col("o_kind") == "iri")).select("s", "p", "o").distinct()


def dictionary_encode(values: DataFrame, column: str) -> DataFrame:
    """(column, id): dense ids in order. Range partitions are sorted apart and counted on from one another."""
    distinct = values.select(column).where(F.col(column).isNotNull()).distinct()
    ranged = distinct.repartitionByRange(column).sortWithinPartitions(column).withColumn("_m", F.monotonically_increasing_id())
    ranged = ranged.withColumns({"_part": F.shiftright("_m", 33), "_at": F.col("_m").bitwiseAND(F.lit(2**33 - 1))})
    sizes = ranged.groupBy("_part").count()
    before = sizes.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"))  # one row a partition
    return ranged.join(before, "_part").select(column, (F.col("_before") + F.col("_at")).alias("id"))


def with_inverse_edges(edges: DataFrame, relations: int) -> DataFrame:
    return edges.select("h", "r", "t").unionByName(edges.select(F.col("t").alias("h"), (F.col("r") + relations).alias("r"), F.col("h").alias("t")))


def relation_mean(edges: DataFrame, vectors: DataFrame) -> DataFrame:
    """(node, dim, value): for each relation the mean of a node's sources over its incoming edges, summed over relations."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    sources = edges.join(vectors.select(F.col("id").alias("h"), array_to_vector(F.col("v").cast("array<double>")).alias("x")), "h")
    means = sources.groupBy("t", "r").agg(Summarizer.mean(F.col("x")).alias("x")).groupBy("t").agg(Summarizer.sum(F.col("x")).alias("x"))
    return means.select(F.col("t").alias("node"), F.posexplode(vector_to_array("x")).alias("dim", "value"))


def halves(v: str, dims: int) -> tuple[Column, Column]:
    as_double = F.transform(F.col(v), lambda x: x.cast("double"))
    return F.slice(as_double, 1, dims), F.slice(as_double, dims + 1, dims)


def rotated(edges: DataFrame, vectors: DataFrame, phases: DataFrame) -> DataFrame:
    """edges with arrays: the head's parts, the phase, and the difference (dre, dim) of the rotated head from the tail."""
    h = vectors.select(F.col("id").alias("h"), F.col("re").alias("hre"), F.col("im").alias("him"))
    t = vectors.select(F.col("id").alias("t"), F.col("re").alias("tre"), F.col("im").alias("tim"))
    joined = edges.join(h, "h").join(t, "t").join(phases, "r")
    zipped = F.arrays_zip("hre", "him", "tre", "tim", "phase")
    return joined.withColumns({
        "dre": F.transform(zipped, lambda z: z["hre"] * F.cos(z["phase"]) - z["him"] * F.sin(z["phase"]) - z["tre"]),
        "dim": F.transform(zipped, lambda z: z["hre"] * F.sin(z["phase"]) + z["him"] * F.cos(z["phase"]) - z["tim"]),
    })


def distance(dre: str = "dre", dim: str = "dim") -> Column:
    return F.aggregate(F.zip_with(dre, dim, lambda x, y: F.sqrt(x * x + y * y + 1e-12)), F.lit(0.0), lambda a, x: a + x)


def negative_samples(edges: DataFrame, entities: int, n: int = 8, seed: int = 0) -> DataFrame:
    """n corruptions of each edge, of its head or its tail, drawn by MD5: the same whatever the partitions."""
    each = edges.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(n))))
    number = lambda at: F.conv(F.substr(F.md5(F.concat_ws(":", "h", "r", "t", "k", F.lit(seed)).cast("binary")), F.lit(at), F.lit(8)), 16, 10).cast("long")
    draw, head = number(1) % entities, number(9) % 2 == 0
    return each.select(F.struct("h", "r", "t").alias("edge"), "k", F.when(head, draw).otherwise(F.col("h")).alias("h"), "r", F.when(head, F.col("t")).otherwise(draw).alias("t"))


def log_sigmoid(x: Column) -> Column:
    return -F.log1p(F.exp(-F.abs(x))) + F.least(x, F.lit(0.0))


def rotate_loss(positive: DataFrame, negative: DataFrame, gamma: float = 6.0, temperature: float = 1.0) -> DataFrame:
    """One row, loss: positive (h, r, t, d), negative (edge, d) with softmax-weighted negatives."""
    score = F.lit(gamma) - F.col("d")
    w = Window.partitionBy("edge")
    weighed = negative.withColumn("_w", F.exp(temperature * score)).withColumn("_w", F.col("_w") / F.sum("_w").over(w))
    lost = weighed.groupBy("edge").agg(F.sum(F.col("_w") * log_sigmoid(-score)).alias("neg"))
    both = positive.select(F.struct("h", "r", "t").alias("edge"), log_sigmoid(score).alias("pos")).join(lost, "edge")
    return both.agg((-(F.avg("pos") + F.avg("neg")) / 2).alias("loss"))


#: Edges of which a task holds all differences and gradients at once.
CHUNK = 512


def _add(total: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """total[at] += rows, where `at` repeats; number by number, for which numpy has a fast way, as it has none for rows."""
    width = total.shape[1]
    np.add.at(total.reshape(-1), (at.ravel()[:, None] * width + np.arange(width)).ravel(), rows.ravel())


def _local_epochs(rate: float, gamma: float, n: int, seed: int, first: int, epochs: int):
    """Adam over one task's edges for some epochs: (kind, id, state, n) of its entities and relations, and the losses. Beside
    those a task holds its edges, n draws for each, and the work of CHUNK edges."""

    def train(edges: pd.DataFrame, params: pd.DataFrame) -> pd.DataFrame:
        ent, rel = (params[params["kind"] == k].sort_values("id") for k in (0, 1))
        ids, rels = ent["id"].to_numpy(), rel["id"].to_numpy()
        (xe, me, ve), (xr, mr, vr) = (np.split(np.stack(x["state"].to_list()).astype(float), 3, axis=1) if len(x) else (np.zeros((0, 0)),) * 3 for x in (ent, rel))
        losses: list[float] = []
        if len(edges):
            edges = edges.sort_values(["h", "r", "t"])
            dims = xr.shape[1]
            h, t = (np.searchsorted(ids, edges[c].to_numpy()) for c in ("h", "t"))
            r = np.searchsorted(rels, edges["r"].to_numpy())
            draw = np.random.default_rng([seed, first, int(params["pair"].iloc[0])])
            sign = np.where(np.arange(n + 1) == 0, 1.0, -1.0)
        for epoch in range(first, first + epochs) if len(edges) else ():
            heads = draw.random((len(h), n)) < 0.5
            other = draw.integers(len(ids), size=(len(h), n))
            ge, gr, lost = np.zeros_like(xe, "f4"), np.zeros_like(xr, "f4"), 0.0
            single, cos, sin = xe.astype("f4"), np.cos(xr).astype("f4"), np.sin(xr).astype("f4")
            for at in range(0, len(h), CHUNK):
                part = slice(at, at + CHUNK)
                h1, t1 = h[part, None], t[part, None]
                hh = np.concatenate([h1, np.where(heads[part], other[part], h1)], axis=1)
                tt = np.concatenate([t1, np.where(heads[part], t1, other[part])], axis=1)
                head, tail = single[hh], single[tt]
                re, im, c, s = head[..., :dims], head[..., dims:], cos[r[part], None], sin[r[part], None]
                turned = np.concatenate([re * c - im * s, re * s + im * c], axis=2)
                dre, dim = (both := turned - tail)[..., :dims], both[..., dims:]
                q = np.sqrt(dre * dre + dim * dim + np.float32(1e-12))
                score = gamma - q.sum(axis=2, dtype="f8")
                share = np.exp(score[:, 1:] - score[:, 1:].max(axis=1, keepdims=True))
                share = np.concatenate([np.ones((len(hh), 1)), share / share.sum(axis=1, keepdims=True)], axis=1)
                signed = sign * score
                lost += float((share * np.logaddexp(0, -signed)).sum() / 2)
                g = (share * sign / (1 + np.exp(np.clip(signed, -500, 500))) / 2).astype("f4")[:, :, None] / q
                dre *= g
                dim *= g
                _add(gr, r[part], (dim * turned[..., :dims] - dre * turned[..., dims:]).sum(axis=1))
                down = np.concatenate([dre * c + dim * s, dim * c - dre * s], axis=2)
                drawn = heads[part][:, :, None]  # of an edge and its draws, what falls to its own two ends is one row each
                _add(ge, other[part], np.where(drawn, down[:, 1:], -both[:, 1:]))
                _add(ge, h[part], down[:, 0] + np.where(drawn, np.float32(0), down[:, 1:]).sum(axis=1))
                _add(ge, t[part], np.where(drawn, -both[:, 1:], np.float32(0)).sum(axis=1) - both[:, 0])
            losses.append(lost)
            for x, m, v, grad in ((xe, me, ve, ge), (xr, mr, vr, gr)):
                m += 0.1 * (grad - m)
                v += 0.001 * (grad**2 - v)
                x -= rate * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.999**epoch)) + 1e-8)
        weight = float(len(edges))
        out = [(0, i, x, 1.0) for i, x in zip(ids, np.concatenate([xe, me, ve], axis=1), strict=True)]
        out += [(1, i, x, weight) for i, x in zip(rels, np.concatenate([xr, mr, vr], axis=1), strict=True)]
        out += [(2, first + i, np.array([x, weight], float), 1.0) for i, x in enumerate(losses)]
        return pd.DataFrame(out, columns=["kind", "id", "state", "n"])

    return train


def partner(block: Column, turn: int, blocks: int) -> Column:
    """The block that meets this one in a turn: over blocks - 1 turns (an even number of blocks) each two meet once."""
    mate = F.pmod(F.lit(2 * turn) - block, F.lit(blocks - 1))
    return F.when(block == blocks - 1, F.lit(turn)).when(mate == block, F.lit(blocks - 1)).otherwise(mate)


def _mate(block: int, turn: int, blocks: int) -> int:
    """partner() of a number."""
    mate = (2 * turn - block) % (blocks - 1)
    return turn if block == blocks - 1 else blocks - 1 if mate == block else mate


def _slots(spark, n: int) -> list[int]:
    """n numbers that a repartition into n partitions deals to one partition each, so that no task has two pairs of blocks."""
    wide = spark.range(64 * n).select("id", F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("at"))
    found = {r["at"]: r["id"] for r in wide.groupBy("at").agg(F.min("id").alias("id")).collect()}
    return [found.get(i, 64 * n + i) for i in range(n)]


def train_rotate(edges: DataFrame, vectors: DataFrame, phases: DataFrame, epochs: int = 250, rate: float = 0.01, gamma: float = 6.0, n: int = 4, patience: int = 20, seed: int = 0, sync: int = 25, task_edges: int = 50_000, task_entities: int = 100_000) -> tuple[DataFrame, DataFrame, list[float]]:
    """Entities (id, re, im), phases (r, phase) and the loss by epoch, after training with Adam and softmax-weighted corruptions.

    Entities are dealt to blocks by hash. In a turn every block meets one other, and a task has the edges between and (in
    the first turn) within its two blocks, with the parameters of those blocks alone; corruptions are drawn from all their
    entities. So an entity is trained by one task at a time and nothing of it is averaged; relations are few, go to all
    tasks, and are the mean by edges after a turn. Over a cycle of turns each edge trains `sync` epochs. There are as many
    blocks as keep a task at task_edges and task_entities, each pair of blocks in a task of its own; a graph of up to
    task_edges is two blocks that always meet, which is plain training on all edges. It stops when the loss has not fallen for `patience` epochs.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    # in the first turn a task has the edges of four of the blocks x blocks cells: two blocks' own, and those between them
    blocks = max(math.ceil(math.sqrt(4 * edges.count() / task_edges)), math.ceil(2 * vectors.count() / task_entities), 2)
    blocks += blocks % 2
    slots = _slots(edges.sparkSession, blocks // 2)
    block = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(blocks)).cast("int")
    dealt = written(edges.select(*(F.col(c).cast("long").alias(c) for c in ("h", "r", "t")), block("h").alias("bh"), block("t").alias("bt")))
    start = lambda x: F.concat(x, F.array_repeat(F.lit(0.0), 2 * F.size(x)))
    state = written(
        vectors.select(F.lit(0).alias("kind"), F.col("id").cast("long").alias("id"), start(F.concat("re", "im")).alias("state"))
        .unionByName(phases.select(F.lit(1).alias("kind"), F.col("r").cast("long").alias("id"), start(F.col("phase")).alias("state")))
    )
    held, losses = [state], []
    while len(losses) < epochs and (len(losses) < patience or min(losses[-patience:]) <= min(losses)):
        first, now = len(losses) + 1, min(sync, epochs - len(losses))
        seen: dict[int, list[float]] = {}
        for turn in range(blocks - 1):
            mate = lambda c: partner(F.col(c), turn, blocks)  # noqa: B023, E731
            meets = (F.col("bt") == mate("bh")) | ((F.col("bh") == F.col("bt")) & F.lit(turn == 0))
            lower = [b for b in range(blocks) if b < _mate(b, turn, blocks)]
            slot = F.create_map(*(F.lit(x) for kv in zip(lower, slots, strict=True) for x in kv))  # noqa: B023
            apart = lambda df: df.repartition(blocks // 2, "pair")
            own = dealt.where(meets).select("h", "r", "t", slot[F.least(F.col("bh"), mate("bh"))].alias("pair"))
            entities = state.where("kind = 0").withColumn("_b", block("id")).withColumn("pair", slot[F.least(F.col("_b"), mate("_b"))]).drop("_b")
            params = entities.unionByName(state.where("kind = 1").withColumn("pair", F.explode(F.array(*map(F.lit, slots)))))
            run = written(apart(own).groupBy("pair").cogroup(apart(params).groupBy("pair")).applyInPandas(_local_epochs(rate, gamma, n, seed, first, now), "kind int, id long, state array<double>, n double"))
            mean = run.where("kind = 1").groupBy("id").agg(Summarizer.mean(array_to_vector("state"), F.greatest(F.col("n"), F.lit(1e-9))).alias("m")).select(F.lit(1).alias("kind"), "id", vector_to_array("m").alias("state"))
            for r in run.where("kind = 2").groupBy("id").agg(F.sum(F.get("state", F.lit(0))).alias("lost"), F.sum(F.get("state", F.lit(1))).alias("n")).collect():  # a row an epoch
                have = seen.setdefault(r["id"], [0.0, 0.0])
                have[0], have[1] = have[0] + r["lost"], have[1] + r["n"]
            rest = written(mean)  # a row a relation
            state = run.where("kind = 0").select("kind", "id", "state").unionByName(rest)
            release(*held)
            held = [run, rest]
        if not seen:
            break
        losses += [seen[i][0] / seen[i][1] for i in sorted(seen)]
    dims = F.size("state") / 3
    part = lambda at, of: F.slice("state", (dims / of * at + 1).cast("int"), (dims / of).cast("int"))
    release(dealt)
    return state.where("kind = 0").select("id", part(0, 2).alias("re"), part(1, 2).alias("im")), state.where("kind = 1").select(F.col("id").cast("int").alias("r"), part(0, 1).alias("phase")), losses


def company_vectors(named: DataFrame, name: str = "name") -> DataFrame:
    return named.where(~F.contains(local_name(name), F.lit("_")))


def pca(vectors: DataFrame, k: int = 16, seed: int = 0) -> tuple[DataFrame, list[float]]:
    """(id, projection) of centred vectors, and the share of variance of each component."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    df = vectors.select("id", array_to_vector(F.col("v").cast("array<double>")).alias("x"))
    centred = StandardScaler(withMean=True, withStd=False, inputCol="x", outputCol="c").fit(df).transform(df)
    model = PCA(k=k, inputCol="c", outputCol="p").fit(centred)
    return model.transform(centred).select("id", vector_to_array("p").alias("projection")), list(map(float, model.explainedVariance))


def attach_vectors(obs: DataFrame, vectors: DataFrame, key: str = "Company") -> tuple[DataFrame, DataFrame]:
    """Observations that have a vector, and (kept, dropped) counts."""
    joined = obs.join(vectors, key, "left")
    return joined.where("v is not null"), joined.agg(F.count("v").alias("kept"), F.count_if(F.col("v").isNull()).alias("dropped"))


def vintage_scale(vectors: DataFrame, acq: DataFrame, year: int, factor: float = 0.92) -> DataFrame:
    """(id, v): each vector times factor for every acquisition of its company after the year."""
    later = acq.where(F.col("yr") > year).groupBy(F.col("Symbol").alias("id")).agg(F.count("*").alias("_n"))
    scale = F.pow(F.lit(factor), F.coalesce("_n", F.lit(0)))
    return vectors.join(later, "id", "left").select("id", F.transform("v", lambda x: x * scale).alias("v"))
