"""Graph patterns over encoded triples.

A graph is stored by predicate, with a 64-bit number for each term beside the term itself. Patterns join on the numbers;
the terms are columns that a scan only reads where a result names them, so no dictionary is joined. Terms that share a
number would be an error of the store, and are looked for when it is written. What is known of each predicate (rows, and
about how many subjects and objects) orders the joins: the pattern that gives fewest rows first, then always the
smallest of those that share a variable with what is bound, so the largest predicate is joined last. Where a predicate is
large and the bindings are few, Spark filters its scan by them at run time.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators.graph import BASE, COLUMNS

Pattern = tuple[str, str, str]


class Known(NamedTuple):
    rows: int
    subjects: int
    objects: int


def number(term: Column | str, kind: Column | str = "iri", seed: int = 0) -> Column:
    """What stands for a term: IRIs and blank nodes by their text, literals by text and type."""
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.xxhash64(as_column(term), as_column(kind), F.lit(seed))


def encoded(graph: DataFrame, seed: int = 0) -> DataFrame:
    """(p, s, o, s_term, o_term, o_kind, o_type): triples with the numbers of their subjects and objects."""
    kind = F.when(F.col("o_kind") == "literal", F.concat(F.lit("literal "), F.coalesce("o_type", F.lit("")))).otherwise(F.lit("iri"))
    return graph.select("p", number(F.col("s"), seed=seed).alias("s"), number(F.col("o"), kind, seed).alias("o"), F.col("s").alias("s_term"), F.col("o").alias("o_term"), "o_kind", "o_type")


def _ends(edges: DataFrame) -> DataFrame:
    """(n, t): the number and the text of each end of each edge."""
    ends = [edges.select(F.col(c).alias("n"), F.concat_ws("\n", f"{c}_term", *extra).alias("t")) for c, extra in (("s", ()), ("o", (F.when(F.col("o_kind") == "literal", F.concat(F.lit("literal "), F.coalesce("o_type", F.lit("")))),)))]
    return ends[0].unionByName(ends[1])


def shared_numbers(edges: DataFrame) -> DataFrame:
    """(n, a, b): numbers that two different terms have; none, but for one store in many millions of graphs."""
    return _ends(edges).groupBy("n").agg(F.min("t").alias("a"), F.max("t").alias("b")).where("a <> b")


def look_through(edges: DataFrame) -> DataFrame:
    """edges, if no two of their terms share a number, else an error.

    Terms are told apart by a second number, so that none moves: a row's ends are listed together, and a task sends each
    number that it meets once.
    """
    literal = F.when(F.col("o_kind") == "literal", F.concat(F.lit("literal "), F.coalesce("o_type", F.lit(""))))
    second = lambda *t: F.xxhash64(*t, F.lit("second"))
    ends = F.array(F.struct(F.col("s").alias("n"), second(F.col("s_term"), F.lit("iri")).alias("h")), F.struct(F.col("o").alias("n"), second(F.col("o_term"), F.coalesce(literal, F.lit("iri"))).alias("h")))
    if not edges.select(F.inline(ends)).groupBy("n").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").isEmpty():
        raise ValueError("two terms share a number: store the graph with another seed")
    return edges


#: What is known of the predicates of a stored table, by its path, which is never written again.
_KNOWN: dict[str, dict[str, Known]] = {}


class PatternGraph:
    """A stored table of encoded() triples, by predicate. seed is that of its numbers; checked: they were looked through when it was written."""

    def __init__(self, edges: DataFrame, seed: int = 0, checked: bool = False):
        self.edges, self.seed = edges, seed
        path = getattr(edges, "_written", None)
        if path not in _KNOWN or path is None:
            if not checked:
                look_through(edges)
            found = edges.groupBy("p").agg(F.count("*").alias("n"), F.approx_count_distinct("s").alias("s"), F.approx_count_distinct("o").alias("o")).collect()  # a row a predicate
            known = {r["p"]: Known(r["n"], max(1, r["s"]), max(1, r["o"])) for r in found}
            if path is not None:
                _KNOWN[path] = known
            self.known = known
        else:
            self.known = _KNOWN[path]

    def triples(self) -> DataFrame:
        return self.edges.select(F.col("s_term").alias("s"), "p", F.col("o_term").alias("o"), *COLUMNS[3:])

    def rows(self, pattern: Pattern) -> float:
        """About how many rows a pattern gives by itself."""
        s, p, o = pattern
        k = self.known.get(BASE + p, Known(0, 1, 1))
        return k.rows / (1 if s.startswith("?") else k.subjects) / (1 if o.startswith("?") else k.objects)

    def order(self, patterns: list[Pattern]) -> list[Pattern]:
        """The fewest rows first, then always the fewest of those that share a variable with the ones before."""
        left = sorted(patterns, key=lambda x: (self.rows(x), x))
        chosen = [left.pop(0)]
        while left:
            bound = {t for x in chosen for t in (x[0], x[2]) if t.startswith("?")}
            near = next((x for x in left if bound & {x[0], x[2]}), None)
            if near is None:
                raise ValueError(f"{left[0]} shares no variable with the other patterns")
            left.remove(near)
            chosen.append(near)
        return chosen

    def _one(self, pattern: Pattern) -> DataFrame:
        s, p, o = pattern
        df = self.edges.where(F.col("p") == BASE + p)
        for c, term in (("s", s), ("o", o)):
            if not term.startswith("?"):
                df = df.where((F.col(c) == number(term, seed=self.seed)) & (F.col(f"{c}_term") == term))
        if s == o:
            df = df.where("s = o")
        ends = {t: c for c, t in (("o", o), ("s", s)) if t.startswith("?")}
        return df.select(*(F.col(x).alias(n) for t, c in ends.items() for x, n in ((c, t[1:]), (f"{c}_term", f"{t[1:]}_term"))))

    @staticmethod
    def _joined(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
        keys = [c for c in a.columns if c in b.columns and not c.endswith("_term")]
        return a.join(b.drop(*(f"{c}_term" for c in keys)), keys, how)

    def match(self, *patterns: Pattern) -> DataFrame:
        """Bindings of a basic graph pattern: for each variable ?x the number x and the term x_term. Objects that are given are IRIs."""
        return reduce(self._joined, (self._one(x) for x in self.order(list(patterns))))

    def optional(self, df: DataFrame, *patterns: Pattern) -> DataFrame:
        return self._joined(df, self.match(*patterns), "left")

    def not_exists(self, df: DataFrame, *patterns: Pattern) -> DataFrame:
        return self._joined(df, self.match(*patterns), "left_anti")

    def node(self, term: Column) -> Column:
        """The number of a node that a query makes up."""
        return number(term, seed=self.seed)
