"""URL filter: host and path rules, then a weighted vocabulary counted by an Aho-Corasick automaton."""

from __future__ import annotations

import string
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values: (verdict, host and path).
RULES = [
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
]

#: One strict term rejects a url.
STRICT = ["porn", "xxx", "hentai", "milf", "camgirl", "escort", "warez", "keygen", "torrent", "phishing"]
#: SOFT_HITS distinct ones do.
SOFT = ["adult", "sexy", "nude", "dating", "casino", "poker", "betting", "jackpot", "slots", "loan", "cheap", "viagra", "pills", "crack", "download", "free", "track", "click", "popup", "feed"]
SOFT_HITS = 2
_ALNUM = frozenset(string.ascii_lowercase + string.digits)


def host(url: Column) -> Column:
    """After the first ://, up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """After the host, up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


class _Automaton:
    """Counts distinct terms that stand between characters other than ASCII letters and digits."""

    def __init__(self, strict: list[str], soft: list[str]):
        self.found = ahocorasick.Automaton()
        for weight, terms in ((1, soft), (2, strict)):  # a term in both is strict
            for term in terms:
                self.found.add_word(term.lower(), (weight, term.lower()))
        if strict or soft:
            self.found.make_automaton()
        self.any = bool(strict or soft)

    def count(self, url: str | None) -> tuple[int, int]:
        if not url or not self.any:
            return 0, 0
        low = "".join(c.lower() if c.isascii() else c for c in url)
        hits = set()
        for end, (weight, term) in self.found.iter(low):
            start = end - len(term) + 1
            if (start == 0 or low[start - 1] not in _ALNUM) and (end + 1 == len(low) or low[end + 1] not in _ALNUM):
                hits.add((weight, term))
        strict = sum(w == 2 for w, _ in hits)
        return strict, len(hits) - strict


class _Rules:
    """The longest rule that fits: rules of each host, longest first."""

    def __init__(self, rules: list[tuple[str, str]]):
        self.by: dict[str, list[tuple[str, str, str]]] = {}
        for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
            name, slash, rest = rule.partition("/")
            self.by.setdefault(name, []).append((slash + rest, rule, verdict))

    def find(self, name: str, where: str) -> tuple[str | None, str | None]:
        best: tuple[str | None, str | None] = (None, None)
        if not name:
            return best
        parts = name.split(".")
        for i in range(len(parts)):
            for start, rule, verdict in self.by.get(".".join(parts[i:]), ()):
                if where.startswith(start):
                    if best[0] is None or len(rule) > len(best[0]):
                        best = rule, verdict
                    break
        return best


def _judged(rules, strict, soft, soft_hits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, table = _Automaton(strict, soft), _Rules(rules)
        for b in batches:
            rows = []
            for url, name, where in zip(*(b.column(c).to_pylist() for c in ("url", "host", "path")), strict=True):
                rule, verdict = table.find(name, where)
                s, t = terms.count(url)
                rows.append((rule, verdict or ("block" if s >= 1 or t >= soft_hits else "allow"), s, t))
            new = [pa.array([r[j] for r in rows], kind) for j, kind in enumerate((pa.string(), pa.string(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("host"), b.column("path"), *new], names=["page_id", "host", "path", "rule", "verdict", "n_strict", "n_soft"])

    return run


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, strict: list[str] = STRICT, soft: list[str] = SOFT, soft_hits: int = SOFT_HITS, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, n_strict, n_soft.

    A rule fits its host and all subdomains if the path starts with the rule's; the longest wins. Without one, one
    strict or soft_hits distinct soft terms block, in any letter case and with no ASCII letter or digit on either side.
    A null url or one without :// has an empty host and path and meets no rule; a null one has no terms either and is
    allowed. Repeated rows are judged alike, other columns are ignored, and an empty table gives no rows. Rules and
    terms go to every task, so they are lists.
    """
    urls = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    parts = urls.withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    return parts.mapInArrow(_judged(rules, strict, soft, soft_hits), "page_id long, host string, path string, rule string, verdict string, n_strict int, n_soft int")
