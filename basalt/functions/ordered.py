"""Exact quantiles and running sums over ordered values, without one task for all of them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Accuracy of the approximate quantiles that bracket the exact ones: a rank is off by a share of 1 / ACCURACY at most.
ACCURACY = 10_000
#: Rows between two brackets that are few enough to be counted by value.
FEW = 200_000


def exact_quantiles(df: DataFrame, columns: list[str], at: list[float], discrete: bool = False) -> dict[str, list[float] | None]:
    """Quantiles of each column, interpolated between neighbours (or the least value that reaches the share, if ``discrete``); None for a column without values.

    Approximate quantiles a little below and above each wanted rank bracket it;
    rows below and inside the brackets are counted, and brackets with many rows
    are narrowed again.  What stays is counted by value.  Every pass is an
    aggregation over all columns with map-side sums, and no sort.
    """
    if not columns:
        return {}
    value = {c: F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")) for c in columns}
    # One pass gives sizes, ends and first brackets.
    inner = sorted({p for p in at if 0 < p < 1})
    near = [max(0.0, min(1.0, p + s * 3 / ACCURACY)) for p in inner for s in (-1, 1)]
    first = df.agg(*[f.alias(f"{n}{i}") for i, v in enumerate(value.values()) for n, f in (("n", F.count(v)), ("lo", F.min(v)), ("hi", F.max(v)), *([("near", F.percentile_approx(v, near, ACCURACY))] if near else []))]).first()
    size = {c: first[f"n{i}"] for i, c in enumerate(columns)}
    ends_of = {c: {0: first[f"lo{i}"], 1: first[f"hi{i}"]} for i, c in enumerate(columns)}
    asked = [(c, p) for c in columns if size[c] for p in inner]
    bounds: dict[tuple[str, float], list] = {k: [float("-inf"), float("inf"), 0, size[k[0]]] for k in asked}  # from, to, rows below, rows inside

    def rank(key: tuple[str, float]) -> float:
        n = size[key[0]]
        return max(1, n - math.floor(n - key[1] * n)) - 1 if discrete else key[1] * (n - 1)

    def ranks(key: tuple[str, float]) -> tuple[int, int]:
        return math.floor(rank(key)), math.ceil(rank(key))

    for turn in range(6):
        wide = [k for k in asked if bounds[k][3] > FEW and bounds[k][0] < bounds[k][1]]
        if not wide:
            break
        inside = [F.when(value[c].between(F.lit(bounds[c, p][0]), F.lit(bounds[c, p][1])), value[c]) for c, p in wide]
        shares = [[min(max((r - bounds[k][2] + d) / bounds[k][3] + s * 2 / ACCURACY, 0.0), 1.0) for r, d, s in zip(ranks(k), (0, 1), (-1, 1), strict=True)] for k in wide]
        if turn:
            found = df.agg(*[F.percentile_approx(v, s, ACCURACY).alias(str(i)) for i, (v, s) in enumerate(zip(inside, shares, strict=True))]).first()
            ends = [tuple(found[i]) for i in range(len(wide))]
        else:
            ends = [tuple(first[f"near{columns.index(c)}"][2 * inner.index(p) :][:2]) for c, p in wide]
        counted = df.agg(*[f(e).alias(f"{n}{i}") for i, (k, (a, b)) in enumerate(zip(wide, ends, strict=True)) for n, f, e in (("b", F.count_if, value[k[0]] < a), ("i", F.count_if, value[k[0]].between(a, b)))]).first()
        for i, (k, (a, b)) in enumerate(zip(wide, ends, strict=True)):
            bounds[k] = [a, b, counted[f"b{i}"], counted[f"i{i}"]]
    found_at: dict[tuple[str, float], float] = {(c, p): ends_of[c][p] for c in columns if size[c] for p in at if p in (0, 1)}
    told = lambda: {c: [found_at[c, p] for p in at] if size[c] else None for c in columns}
    if not asked:
        return told()
    held = F.array(*[F.struct(F.lit(i).alias("i"), F.when(value[c].between(F.lit(bounds[c, p][0]), F.lit(bounds[c, p][1])), value[c]).alias("v")) for i, (c, p) in enumerate(asked)])
    by_value = df.select(F.explode(F.filter(held, lambda x: x["v"].isNotNull())).alias("x")).groupBy("x.i", "x.v").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("i").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wanted = F.element_at(F.array(*[F.array(*[F.lit(r - bounds[k][2]) for r in ranks(k)]) for k in asked]), F.col("i") + 1)
    near = by_value.withColumns({"before": before, "wanted": wanted}).where("(before <= wanted[0] and wanted[0] < before + n) or (before <= wanted[1] and wanted[1] < before + n)")
    picked: dict[int, list] = {}
    for r in near.collect():  # at most two for each quantile
        picked.setdefault(r.i, []).append((r.before, r.v))
    for i, k in enumerate(asked):
        (_, low), (_, high) = min(picked[i]), max(picked[i])
        r = rank(k)
        found_at[k] = low if low == high else (math.ceil(r) - r) * low + (r - math.floor(r)) * high
    return told()


def block_of(df: DataFrame, order: str, blocks: int = 128, by: tuple[str, ...] = ()) -> Column:
    """Blocks of rows that follow each other in the order of a column of distinct values (distinct inside each group ``by``); null comes first, in block -1.

    The bounds are values of a sample by hash, so they are the same in every use.
    """
    keys = [*by, order]
    sample = [tuple(r) for r in df.where(F.col(order).isNotNull()).select(*keys).orderBy(F.xxhash64(*keys), *keys).limit(32 * blocks).collect()]
    sample.sort(key=lambda r: [(v is not None, v) for v in r])
    edges = list(dict.fromkeys(sample[:: max(1, len(sample) // blocks)])) if len(sample) > blocks else []
    if not edges:
        return F.when(F.col(order).isNull(), F.lit(-1)).otherwise(F.lit(0))
    kinds = [df.schema[k].dataType for k in keys]
    edge = lambda r: F.struct(*[F.lit(v).cast(t).alias(f"k{i}") for i, (v, t) in enumerate(zip(r, kinds, strict=True))])
    own = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    # Edges up to the row's own, by bisection: a look at each of them would take over a hundred comparisons a row.
    ordered, steps = F.sort_array(F.array(*map(edge, edges))), [1 << i for i in reversed(range(len(edges).bit_length()))]
    reached = lambda at: F.when(at <= len(edges), F.get(ordered, at - 1) <= own).otherwise(False)
    inside = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(reached(at + step), at + step).otherwise(at))
    return F.when(F.col(order).isNull(), F.lit(-1)).otherwise(inside)


def running_sums(df: DataFrame, order: str, sums: list[str], descending: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """``df``, one row for each value of ``order`` (in each group ``by``), with ``{c}_before``, the sum of ``c`` over the rows before, and ``{c}_total``.

    Sums by block go through an ordered window of at most a few hundred rows (and
    one for each group); the rows of a block are added up in a window of their own.
    """
    direction = F.desc if descending else F.asc
    blocked = df.withColumn("__block", block_of(df, order, by=by))
    names = [f"__by{i}" for i in range(len(by))]
    by_block = blocked.groupBy(*[F.col(c).alias(n) for c, n in zip(by, names, strict=True)], F.col("__block").alias("__of_block")).agg(*[F.sum(c).alias(c) for c in sums])
    earlier = Window.partitionBy(*names).orderBy(direction("__of_block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*names)
    ends = by_block.select(*names, "__of_block", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"__earlier_{c}") for c in sums], *[F.sum(c).over(every).alias(f"{c}_total") for c in sums])
    inner = Window.partitionBy(*by, "__block").orderBy(direction(order)).rowsBetween(Window.unboundedPreceding, -1)
    inside = blocked.withColumns({f"{c}_inner": F.coalesce(F.sum(c).over(inner), F.lit(0)) for c in sums})
    same = F.col("__block") == F.col("__of_block")
    for c, n in zip(by, names, strict=True):
        same &= F.col(c).eqNullSafe(F.col(n))
    out = inside.join(ends if by else F.broadcast(ends), same)  # without groups a row for each block
    return out.select(*df.columns, *[(F.col(f"{c}_inner") + F.col(f"__earlier_{c}")).alias(f"{c}_before") for c in sums], *[f"{c}_total" for c in sums])
