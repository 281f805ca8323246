"""Order statistics by narrowing: no sort, no exchange and no copy of the table.

A rank's value is enclosed between two values.  A mergeable rank summary
(``percentile_approx``, whose rank error is bounded) shrinks the enclosure by a
factor of some thousands a round, an exact count says how many rows lie below,
on and strictly inside its ends, and once few distinct rows are inside, they are
collected and counted.  Every round is one aggregate over the table for all
columns and ranks together; two rounds do for ten million rows.  Only
counts and enclosures, and at the end ``FEW`` values a rank, reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACCURACY = 10_000   # of the rank summary: ranks are off by a ten-thousandth of the rows at most
FEW = 2_000         # rows inside an enclosure that are looked at one by one


@dataclass
class _Search:
    """Ranks of one column (0-based, one or two neighbours) and what encloses them."""
    col: str
    ranks: list[int]
    low: float
    high: float
    below: int = 0
    on_low: int = 0
    inside: int = 0
    slack: int = 2
    found: dict = field(default_factory=dict)

    def settle(self, below: int, on_low: int, inside: int) -> bool:
        """Take the counts of the enclosure; false if it misses a rank."""
        if any(r < below for r in self.ranks):
            return False
        self.below, self.on_low, self.inside = below, on_low, inside
        for r in self.ranks:
            if r < below + on_low:
                self.found[r] = self.low
            elif r >= below + on_low + inside:
                self.found[r] = self.high
        return True

    @property
    def left(self) -> list[int]:
        return [r for r in self.ranks if r not in self.found]

    def fractions(self) -> list[float]:
        """Where to look inside the enclosure for values around the ranks that are left."""
        first = self.below + self.on_low
        margin = self.slack * self.inside / ACCURACY + 1
        return [min(1.0, max(0.0, (x - first) / self.inside)) for x in (self.left[0] - margin, self.left[-1] + 1 + margin)]


def _within(v: Column, low: float, high: float) -> Column:
    return (v > F.lit(low)) & (v < F.lit(high))


def _counts(data: DataFrame, searches: list[_Search]) -> list[tuple[int, int, int, int]]:
    aggs = []
    for i, s in enumerate(searches):
        v = F.col(s.col)
        aggs += [F.count_if(v < F.lit(s.low)).alias(f"b{i}"), F.count_if(v == F.lit(s.low)).alias(f"l{i}"),
                 F.count_if(_within(v, s.low, s.high)).alias(f"m{i}"), F.count_if(v > F.lit(s.high)).alias(f"a{i}")]
    r = data.agg(*aggs).first()
    return [(r[f"b{i}"], r[f"l{i}"], r[f"m{i}"], r[f"a{i}"]) for i in range(len(searches))]


def order_statistics(df: DataFrame, cols: list[str], ranks_of: Callable[[int], list[list[int]]]) -> dict[str, tuple[int, dict[int, float]]]:
    """{column: (rows, {rank: value})} for groups of neighbouring 0-based ranks given by the number of rows.

    Nulls and NaN are left out, as other quantiles here do.
    """
    names = [f"v{i}" for i in range(len(cols))]
    data = df.select(*[F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double")).alias(v) for c, v in zip(cols, names)])
    data = data.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        ends = data.agg(*[f(v).alias(f"{n}_{v}") for v in names for n, f in (("n", F.count), ("l", F.min), ("h", F.max))]).first()
        searches = [_Search(v, ranks, ends[f"l_{v}"], ends[f"h_{v}"]) for v in names if ends[f"n_{v}"] for ranks in ranks_of(ends[f"n_{v}"])]
        open_ = list(searches)
        for s, (below, on_low, inside, _) in zip(open_, _counts(data, open_) if open_ else []):
            s.settle(below, on_low, inside)
        while open_ := [s for s in open_ if s.left and s.inside > FEW]:
            tighter = data.agg(*[F.percentile_approx(F.when(_within(F.col(s.col), s.low, s.high), F.col(s.col)), s.fractions(), ACCURACY).alias(f"p{i}")
                                 for i, s in enumerate(open_)]).first()
            tried = [_Search(s.col, s.left, *tighter[f"p{i}"]) for i, s in enumerate(open_)]
            for s, t, (below, on_low, inside, above) in zip(open_, tried, _counts(data, tried)):
                n = ends[f"n_{s.col}"]
                ok = t.left[-1] < n - above and t.settle(below, on_low, inside)
                if ok and (t.inside < s.inside or not t.left):
                    s.low, s.high, s.below, s.on_low, s.inside = t.low, t.high, t.below, t.on_low, t.inside
                    s.found.update(t.found)
                else:  # the summary was off by more than it promises
                    s.slack *= 4
        last = [s for s in searches if s.left]
        if last:
            pick = F.array(*[F.when(_within(F.col(s.col), s.low, s.high), F.struct(F.lit(i).alias("i"), F.col(s.col).alias("v")))
                             for i, s in enumerate(last)])
            rows = (data.select(F.explode(F.array_compact(pick)).alias("x")).groupBy("x.i", "x.v").agg(F.count(F.lit(1)).alias("c"))
                    .orderBy("i", "v").collect())  # FEW values a search at most
            for i, s in enumerate(last):
                at = s.below + s.on_low
                for r in (r for r in rows if r.i == i):
                    s.found.update({x: r.v for x in s.left if at <= x < at + r.c})
                    at += r.c
        out = {c: (ends[f"n_{v}"], {}) for c, v in zip(cols, names)}
        for s in searches:
            out[cols[names.index(s.col)]][1].update(s.found)
        return out
    finally:
        data.unpersist()


def quantiles(df: DataFrame, cols: list[str], probs: list[float]) -> dict[str, list[float | None]]:
    """Exact quantiles of each column with linear interpolation (as NumPy, pandas and DuckDB's quantile_cont); no rows: nulls."""
    def places(n):
        return [(math.floor((n - 1) * p), min(math.floor((n - 1) * p) + 1, n - 1), (n - 1) * p - math.floor((n - 1) * p)) for p in probs]

    got = order_statistics(df, cols, lambda n: [sorted({a, b}) for a, b, _ in places(n)])
    return {c: [at[a] + (at[b] - at[a]) * f if at[a] != at[b] else at[a] for a, b, f in places(n)] if n else [None] * len(probs)
            for c, (n, at) in got.items()}


def _kth_strings(df: DataFrame, wanted: list[tuple[Column, int]], name: str) -> list[str]:
    """For each (rows, k) the k-th smallest (0-based) string ``name`` among the rows, two characters at a time."""
    prefix, k, done = [""] * len(wanted), [w[1] for w in wanted], [False] * len(wanted)
    c = F.col(name)
    while not all(done):
        open_ = [i for i, d in enumerate(done) if not d]
        parts = [F.when(wanted[i][0] & c.startswith(prefix[i]), F.struct(F.lit(i).alias("i"), F.substring(c, len(prefix[i]) + 1, 2).alias("next")))
                 for i in open_]
        rows = df.select(F.explode(F.array_compact(F.array(*parts))).alias("x")).groupBy("x.i", "x.next").agg(F.count(F.lit(1)).alias("n")).collect()
        for i in open_:
            for r in sorted((r for r in rows if r.i == i), key=lambda r: r.next.encode()):
                if k[i] < r.n:
                    prefix[i] += r.next
                    done[i] = len(r.next) < 2
                    break
                k[i] -= r.n
    return prefix


def rank_cuts(df: DataFrame, col: str, tie: str, positions: Callable[[int], list[int]]) -> list[tuple[float, object]]:
    """(value, tie) of the rows at given 0-based positions in the order of ``col``, then ``tie`` (a string); nulls first, NaN last."""
    inf = float("inf")
    x = F.coalesce(F.nanvl(F.col(col).cast("double"), F.lit(inf)), F.lit(-inf))
    data = df.select(x.alias("x"), F.col(tie).cast("string").alias("t")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n, at = order_statistics(data, ["x"], lambda n: [[p] for p in positions(n)])["x"]
        if not n:
            return []
        places = positions(n)
        values = [at[p] for p in places]
        below = data.agg(*[F.count_if(F.col("x") < F.lit(v)).alias(f"b{i}") for i, v in enumerate(values)]).first()
        ties = _kth_strings(data, [(F.col("x") == F.lit(v), p - below[f"b{i}"]) for i, (v, p) in enumerate(zip(values, places))], "t")
        return list(zip(values, ties))
    finally:
        data.unpersist()
