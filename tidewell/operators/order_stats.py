"""Exact order statistics of many columns in a few passes, without a sort of their values.

Each pass reads the rows once for all wanted positions together. A row falls into one of ``BINS``
bins of each column, however many positions of it are sought, by a function that never decreases as the value grows, so rows combine to one
count per bin and task. Counts tell which bin holds the position, and the next pass looks at that
bin alone, from the smallest to the largest value found in it. The first bins are logarithmic, since
the range is not known yet; later ones divide the range evenly. A bin of one value ends the search.
Values of doubles take four passes in all but odd cases, however many columns there are, and every
result is exact: rounding may move a value to another bin, but never past a smaller one.

With a ``tie`` the position is one of rows ordered by (value, tie), and the tie is sought in the same
way among rows of the value.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.casts import column_type

BINS = 1 << 16
LOG_BINS = 512              # per factor of e, in the first pass


@dataclass(frozen=True)
class Wanted:
    """A position in the sorted non-NULL values of a numeric column.

    ``place`` maps the number of values to a 0-based place; one outside finds nothing.
    """

    value: Column
    place: Callable[[Column], Column]
    tie: Column | None = None


def at_fraction(value: Column, p: float) -> Wanted:
    """Place ``floor(p * n)``, kept inside the list."""
    return Wanted(value, lambda n: F.least(n - 1, F.floor(F.lit(float(p)) * n)))


def at_place(value: Column, k: int) -> Wanted:
    return Wanted(value, lambda n: F.lit(k))


def log_bin(value: Column) -> Column:
    """A whole number that does not decrease as the value grows; the largest for NaN."""
    v = value.cast("double")
    size = F.floor(F.log1p(F.least(F.abs(v), F.lit(1.7976931348623157e308))) * LOG_BINS)
    far = F.when(F.abs(v) == F.lit(float("inf")), F.lit(1)).otherwise(F.lit(0))
    return F.when(F.isnan(v), F.lit(1 << 40)).otherwise(F.signum(v).cast("long") * (size + far))


def even_bin(value: Column, low, high, bins: int = BINS) -> Column:
    """Bin of a value from ``low`` to ``high``, which differ."""
    share = (value - F.lit(low)).cast("double") / (F.lit(high) - F.lit(low)).cast("double")
    return F.least(F.floor(share * bins), F.lit(bins - 1).cast("long"))


def halved(n: int, beyond: Callable[[Column], Column]) -> Column:
    """For how many of the items 0, 1, ... n - 1 ``beyond`` holds, if it holds for the first ones.

    Found by halving, so a row is compared with a few items only.
    """
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(n.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        (at + step <= n) & beyond(at + step - 1), at + step).otherwise(at))


@dataclass
class _Search:
    """How far the search for one position has come: at first ``bounds`` is not known."""

    wanted: Wanted
    k: int | None = None                # place among the rows within the bounds
    bounds: tuple | None = None         # of the value, then of the tie
    ties: tuple | None = None

    @property
    def settled(self) -> bool:
        return self.bounds is not None and self.bounds[0] == self.bounds[1] and (
            self.wanted.tie is None or self.ties[0] == self.ties[1])

    def place(self, n: Column) -> Column:
        return self.wanted.place(n).cast("long") if self.k is None else F.lit(self.k)


@dataclass
class _Group:
    """Searches in one column. Their bounds are equal or apart, so a row is in one of them at most."""

    searches: dict[str, _Search]

    @property
    def bounds(self) -> list[tuple]:
        """(low, high, tie low, tie high) in ascending order; the tie is None while values differ."""
        return sorted({self.key(s) for s in self.searches.values()} - {None},
                      key=lambda b: (b[0], b[2] or 0))

    @staticmethod
    def key(s: _Search) -> tuple | None:
        if s.bounds is None:
            return None
        return (*s.bounds, *(s.ties if s.bounds[0] == s.bounds[1] else (None, None)))

    def at(self, v: Column, t: Column) -> Column:
        """Number of the bounds that a row can be in."""
        bounds = self.bounds
        if len(bounds) < 2:
            return F.lit(0)
        ends, last = (F.array(*[F.lit(b[i]) for b in bounds]) for i in (1, 3))
        return halved(len(bounds), lambda i: (v > F.get(ends, i)) | (
            (v == F.get(ends, i)) & (t > F.get(last, i))))

    def bin(self, v: Column, t: Column, at: Column) -> Column:
        """Bin of a row, NULL outside the bounds."""
        bounds = self.bounds
        if not bounds:
            return F.when(v.isNotNull(), log_bin(v))
        low, high, t_low, t_high = (
            F.lit(column[0]) if len(bounds) == 1 else F.get(F.array(*map(F.lit, column)), at)
            for column in zip(*bounds))
        bins = BINS if len(bounds) == 1 else max(1024, 4 * BINS // len(bounds))
        inside = F.when((low != high) & v.between(low, high), even_bin(v, low, high, bins))
        if all(b[0] != b[1] for b in bounds):
            return inside
        return inside.when((low == high) & (v == low) & t.between(t_low, t_high),
                           even_bin(t, t_low, t_high, bins))


def _pass(df: DataFrame, searches: dict[str, _Search]) -> dict[str, tuple]:
    """Per search: the bin with its place, as (rows before it, low, high, tie low, tie high, k).

    A row is counted once per column, in the bounds that it is in, however many places are sought.
    """
    names, grouped = list(searches), {}
    for name, s in searches.items():
        grouped.setdefault((id(s.wanted.value), id(s.wanted.tie)), {})[name] = s
    groups = [_Group(own) for own in grouped.values()]
    wanted = [next(iter(g.searches.values())).wanted for g in groups]
    none = F.lit(None).cast("long")
    rows = df.select(*[c for i, w in enumerate(wanted) for c in (
        w.value.alias(f"v{i}"), (none if w.tie is None else w.tie).alias(f"t{i}"))])
    ends = [(F.col(f"v{i}"), F.col(f"t{i}"), F.col(f"at{i}")) for i in range(len(groups))]
    rows = rows.withColumns({f"at{i}": g.at(*ends[i][:2]) for i, g in enumerate(groups)})
    # numbers of bounds, those of a column after those of the columns before it
    first = [sum(max(len(g.bounds), 1) for g in groups[:i]) for i in range(len(groups))]
    cells = [F.struct((F.lit(first[i]) + at).alias("w"), g.bin(v, t, at).alias("bin"),
                      v.alias("v"), t.alias("t"))
             for i, (g, (v, t, at)) in enumerate(zip(groups, ends))]
    bins = (rows.select(F.inline(F.array(*cells))).where(F.col("bin").isNotNull())
            .groupBy("w", "bin").agg(
                F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"),
                F.min("t").alias("t_low"), F.max("t").alias("t_high")))
    # a few thousand bins of one search in each group
    own = Window.partitionBy("w")
    counted = bins.withColumns({
        "upto": F.sum("n").over(own.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)),
        "total": F.sum("n").over(own)})
    sought: dict[int, list[Column]] = {}
    for start, g in zip(first, groups):
        number = {b: start + i for i, b in enumerate(g.bounds)}
        for name, s in g.searches.items():
            sought.setdefault(number.get(g.key(s), start), []).append(F.struct(
                F.lit(names.index(name)).alias("s"), s.place(F.col("total")).alias("k")))
    places = F
    for w, own_places in sought.items():
        places = places.when(F.col("w") == w, F.array(*own_places))
    hit = (counted.select("*", F.inline(places))
           .where((F.col("k") < F.col("upto")) & (F.col("k") >= F.col("upto") - F.col("n"))))
    return {names[r["s"]]: (r["upto"] - r["n"], r["low"], r["high"], r["t_low"], r["t_high"], r["k"])
            for r in hit.collect()}


def located(df: DataFrame, wanted: dict[str, Wanted]) -> dict[str, tuple]:
    """(value, tie) at each wanted position; None for positions that no row has."""
    found: dict[str, tuple] = {name: (None, None) for name in wanted}
    # values of one type at a time, so that none is rounded to another's type
    kinds: dict[str, list[str]] = {}
    for name, w in wanted.items():
        probe = df.select(w.value.alias("v"), (F.lit(0) if w.tie is None else w.tie).alias("t"))
        kinds.setdefault(str([column_type(probe, c) for c in probe.columns]), []).append(name)
    for names in kinds.values():
        searches = {name: _Search(wanted[name]) for name in names}
        while searches:
            hits = _pass(df, searches)
            for name in list(searches):
                if name not in hits:
                    del searches[name]
                    continue
                before, low, high, t_low, t_high, k = hits[name]
                s = searches[name]
                s.k, s.bounds, s.ties = k - before, (low, high), (t_low, t_high)
                if s.settled or low != low:             # NaN is one value
                    found[name] = (low, t_low)
                    del searches[name]
    return found


def positions(df: DataFrame, wanted: dict[str, Wanted]) -> dict[str, object]:
    """Value at each wanted position; None for a column without values."""
    return {name: value for name, (value, _) in located(df, wanted).items()}


@dataclass(frozen=True)
class Cut:
    """A row of an (order, tie) sorted table: its neighbours are before or after it."""

    order: object
    tie: object

    def head(self, order: Column, tie: Column) -> Column:
        o = F.lit(self.order)
        return (order < o) | ((order == o) & (tie <= F.lit(self.tie)))

    def tail(self, order: Column, tie: Column) -> Column:
        o = F.lit(self.order)
        return (order > o) | ((order == o) & (tie >= F.lit(self.tie)))


def cuts(df: DataFrame, order: Column, tie: Column,
         places: dict[str, Callable[[Column], Column]]) -> dict[str, Cut] | None:
    """The rows at places, given by the number of rows, of rows sorted by (order, tie).

    ``tie`` must tell rows with equal ``order`` apart. None if there is no such row.
    """
    found = located(df, {name: Wanted(order, place, tie) for name, place in places.items()})
    if any(value is None for value, _ in found.values()):
        return None
    return {name: Cut(*at) for name, at in found.items()}
