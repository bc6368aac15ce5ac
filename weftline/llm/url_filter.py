"""URL filters: a Bloom filter cascade over the corpus's own key universe.

A rule is (host, path, verdict).  Its key is host + path; a url's candidate
keys are each suffix of its host (cut at dots) that has as many labels as some
rule's host, with each prefix of its path that is as long as some rule's path.  The listed keys L and the complete set
U of candidate keys in the corpus are known, so a cascade of Bloom filters
answers membership of every key in U exactly: level 1 encodes L, level 2 the
keys of U outside L that level 1 lets through, level 3 the keys of L that
level 2 lets through, and so on until nothing is let through wrongly.

Everything runs as DataFrame functions; the filters are literals in the plan
(their size follows the rule list, not the corpus: see ``_shape``), so judging
a url needs neither a join nor a shuffle.

Defined results: a null url, or one without ``://``, has empty host and path;
a host or path of any length is judged whole; equal urls and repeated rows are
judged alike; other columns pass through; an empty table gives an empty result.  Of several fitting rules the longest key wins, between equal
lengths the longer host, then the later key.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """Behind the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def candidate_keys(host: Column, path: Column, path_lengths: list[int], label_counts: list[int]) -> Column:
    """Every key under which a rule could list this url."""
    suffixes = F.array(*(F.substring_index(host, ".", -n) for n in label_counts))
    prefixes = F.array(*(F.substring(path, 1, n) for n in path_lengths))
    return F.array_distinct(F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p)))))


@dataclass(frozen=True)
class Level:
    bits: int
    hashes: int
    salt: int
    words: tuple[int, ...]  # 32 bits in each

    def lets_through(self, key: Column) -> Column:
        words = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")
        test = F.lit(True)
        for p in positions(key, self.bits, self.hashes, self.salt):
            word = F.element_at(words, (F.shiftright(p, 5) + 1).cast("int"))
            test &= F.call_function("shiftrightunsigned", word, p.bitwiseAND(F.lit(31)).cast("int")).bitwiseAND(F.lit(1)) == 1
        return test


def positions(key: Column, bits: int, hashes: int, salt: int) -> list[Column]:
    """Double hashing; both hashes are reduced first, so nothing overflows."""
    a = F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(bits))
    b = F.pmod(F.xxhash64(key, F.lit(-1 - salt)), F.lit(bits))
    return [F.pmod(a + b * i + F.lit(i * i), F.lit(bits)) for i in range(hashes)]


def _shape(listed: int, others: int) -> tuple[int, int]:
    """Bits and hash count so that about half as many of ``others`` pass as are
    listed: log2(2 others / listed) / ln 2 bits a listed key, whatever the corpus."""
    rate = min(0.5, max(listed, 1) / (2 * max(others, 1)))
    hashes = max(1, round(-math.log2(rate)))
    return max(64, math.ceil(max(listed, 1) * hashes / math.log(2))), hashes


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def holds(self, key: Column) -> Column:
        """Exact for every key of the universe it was built over."""
        found = F.lit(len(self.levels) % 2 == 1)
        for depth in range(len(self.levels), 0, -1):
            passed = self.levels[depth - 1].lets_through(key)
            found = (passed & found) if depth % 2 else (~passed | found)
        return found


def build_level(keys: DataFrame, bits: int, hashes: int, salt: int) -> Level:
    """``keys`` has one column ``key``.  At most bits / 32 rows reach the driver."""
    at = keys.select(F.explode(F.array(*positions(F.col("key"), bits, hashes, salt))).alias("p"))
    rows = (
        at.groupBy(F.shiftright("p", 5).alias("w"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("p").bitwiseAND(F.lit(31)).cast("int"))).alias("v"))
        .collect()
    )
    words = [0] * (bits // 32 + 1)
    for r in rows:
        words[r.w] = r.v
    return Level(bits, hashes, salt, tuple(words))


def build_cascade(universe: DataFrame, listed: DataFrame, size: int, most_levels: int = 40) -> Cascade:
    """``universe`` and ``listed``: one column ``key``; ``size``: about how many
    distinct keys the universe has.  The first level is tested in the scan of the
    universe; only the few keys it lets through wrongly are ever shuffled.  Each
    level halves what is left or better; should ``most_levels`` not close it, it
    fails, as its answers would not be exact."""
    n = listed.count()
    levels, cuts = [build_level(listed, *_shape(n, size), 0)], []
    inside = listed
    outside = cut(universe.filter(levels[0].lets_through(F.col("key"))).distinct().join(listed, "key", "left_anti"), "fp")
    cuts.append(outside)
    while (wrong := outside.count()) and len(levels) < most_levels:
        depth = len(levels)
        levels.append(build_level(outside, *_shape(wrong, n), depth))
        inside = cut(inside.filter(levels[-1].lets_through(F.col("key"))), "fp")
        cuts.append(inside)
        inside, outside, n = outside, inside, wrong
    for c in cuts:
        drop(c)
    if wrong:
        raise RuntimeError("the cascade did not close")
    return Cascade(tuple(levels))


def _weighed(verdict: str):
    """A key as a struct that sorts by precedence."""

    def of(key: Column) -> Column:
        return F.struct(F.length(key).alias("n"), F.length(F.substring_index(key, "/", 1)).alias("h"), key.alias("rule"), F.lit(verdict).alias("verdict"))

    return of


class UrlFilter:
    """Rules (host, path, verdict) fitted to a table of urls."""

    def __init__(self, rules: list[tuple[str, str, str]], default: str = "allow"):
        by_key: dict[str, tuple[str, str, str]] = {}
        for host, path, verdict in rules:
            if verdict not in ("allow", "block"):
                raise ValueError(f"{verdict}: a verdict is allow or block")
            if by_key.setdefault(host + path, (host, path, verdict))[2] != verdict:
                raise ValueError(f"{host + path} has two verdicts")
        self.rules, self.default = list(by_key.values()), default
        self.path_lengths = sorted({len(p) for _, p, _ in self.rules}) or [0]
        self.label_counts = sorted({h.count(".") + 1 for h, _, _ in self.rules}) or [1]
        self.cascades: dict[str, Cascade] = {}

    def fit(self, urls: DataFrame, column: str = "url") -> UrlFilter:
        """Build one cascade a verdict over all candidate keys in ``urls``."""
        spark: SparkSession = urls.sparkSession
        url = F.col(column)
        keys = urls.select(F.explode(candidate_keys(host_of(url), path_of(url), self.path_lengths, self.label_counts)).alias("key"))
        size = keys.agg(F.approx_count_distinct("key").alias("n")).first().n
        for verdict in ("block", "allow"):
            own = [(h + p,) for h, p, v in self.rules if v == verdict]
            if own:
                self.cascades[verdict] = build_cascade(keys, spark.createDataFrame(own, "key string"), size)
        return self

    def judge(self, urls: DataFrame, column: str = "url") -> DataFrame:
        """``urls`` with host, path, rule and verdict (replaced if there already)."""
        clear = [c for c in urls.columns if c.lower() not in ("host", "path", "rule", "verdict")]
        url = F.col(column)
        out = urls.select(*(F.col(f"`{c}`") for c in clear), host_of(url).alias("host"), path_of(url).alias("path"))
        keys = candidate_keys(F.col("host"), F.col("path"), self.path_lengths, self.label_counts)
        fitting = []
        for verdict, cascade in self.cascades.items():
            fitting.append(F.transform(F.filter(keys, cascade.holds), _weighed(verdict)))
        none = F.lit(None).cast("struct<n:int,h:int,rule:string,verdict:string>")
        best = F.array_max(F.concat(*fitting)) if fitting else none
        names = [*clear, "host", "path"]
        return out.select(F.struct("*").alias("own"), best.alias("best")).select(*(F.col(f"own.`{c}`") for c in names), F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(self.default)).alias("verdict"))
