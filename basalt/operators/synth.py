"""Feature synthesis: guarded transforms, group deviations, text features, recipes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distributions import digamma
from ..functions.expressions import bucket, safe_ratio, words
from ..functions.ordered import exact_quantiles
from .profile import stack


def zero_variance(df: DataFrame, columns: list[str]) -> DataFrame:
    agg = df.agg(*[F.countDistinct(c).alias(f"{c}__d") for c in columns], *[F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"{c}__s") for c in columns])
    return stack(agg, [{"column_name": F.lit(c), "distinct_values": F.col(f"{c}__d"), "varies": (F.col(f"{c}__d") > 1) & (F.col(f"{c}__s") > 1e-9)} for c in columns])


def log1p_features(df: DataFrame, columns: list[str], least_skew: float = 1.5) -> DataFrame:
    """``log1p_{c}`` for columns that are never negative and skewed."""
    row = df.agg(*[F.min(c).alias(f"{c}__m") for c in columns], *[F.skewness(c).alias(c) for c in columns]).first()
    chosen = [c for c in columns if row[c] is not None and row[f"{c}__m"] >= 0 and abs(row[c]) > least_skew]
    return df.withColumns({f"log1p_{c}": F.log1p(F.greatest(F.col(c), F.lit(0.0))) for c in chosen}) if chosen else df


def ratio_features(df: DataFrame, columns: list[str], most: int = 5) -> DataFrame:
    own = columns[:most]
    return df.withColumns({f"{a}_per_{b}": safe_ratio(F.col(a), F.col(b)) for i, a in enumerate(own) for b in own[i + 1 :]})


def group_means(train: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """Means by group of training rows, with the overall means beside them."""
    overall = train.agg(*[F.avg(c).alias(f"{c}__all") for c in columns])
    return train.groupBy(F.col(group).alias("__g")).agg(*[F.avg(c).alias(f"{c}__mean") for c in columns]).join(overall, how="cross")


def group_deviation(df: DataFrame, train: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """``{c}_dev``: value minus its group's training mean; groups not seen use the overall mean."""
    means = group_means(train, group, columns)
    overall = train.agg(*[F.avg(c).alias(f"{c}__base") for c in columns])
    joined = df.join(means, F.col(group) == F.col("__g"), "left").join(overall, how="cross")
    made = {f"{c}_dev": F.col(c) - F.coalesce(F.col(f"{c}__mean"), F.col(f"{c}__base")) for c in columns}
    return joined.withColumns(made).drop("__g", *[f"{c}__{s}" for c in columns for s in ("mean", "all", "base")])


def group_columns(df: DataFrame, columns: list[str], least: int = 2, most: int = 15) -> list[str]:
    """The categorical columns of 2 to 15 values, which group deviations are taken in."""
    row = df.agg(*[F.countDistinct(c).alias(c) for c in columns]).first()
    return [c for c in columns if least <= row[c] <= most]


def synthesis_audit(df: DataFrame, numbers: list[str], categories: list[str], selected: list[str], least_skew: float = 1.5) -> DataFrame:
    """Every candidate feature with its type, formula and whether it was selected."""
    row = df.agg(*[F.min(c).alias(f"{c}__m") for c in numbers], *[F.skewness(c).alias(c) for c in numbers]).first()
    rows = [(f"log1p_{c}", "log transform", f"log1p({c})") for c in numbers if row[c] is not None and row[f"{c}__m"] >= 0 and abs(row[c]) > least_skew]
    rows += [(f"{a}_per_{b}", "ratio", f"{a} / {b}") for i, a in enumerate(numbers[:5]) for b in numbers[i + 1 : 5]]
    rows += [(f"{c}_dev_from_{g}_avg", "group deviation", f"{c} - mean({c} by {g})") for g in group_columns(df, categories) for c in numbers[:3]]
    return df.sparkSession.createDataFrame([(*r, r[0] in selected) for r in rows], "feature string, type string, formula string, selected boolean")


def mi_scores(df: DataFrame, columns: list[str], target: str, bins: int = 10) -> DataFrame:
    """Mutual information (nats) of each column, in quantile bins, with a discrete target."""
    cuts = exact_quantiles(df, columns, [i / bins for i in range(1, bins)])
    edges = df.sparkSession.createDataFrame([(c, e) for c, e in cuts.items() if e], "column_name string, edges array<double>")
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("x")) for c in columns])
    long = df.select(F.explode(pairs).alias("p"), F.col(target).alias("y")).select("p.*", "y").where("x is not null and y is not null")
    binned = long.join(F.broadcast(edges), "column_name").withColumn("b", F.size(F.filter("edges", lambda e: e < F.col("x"))))  # one row for each column
    cell = binned.groupBy("column_name", "b", "y").agg(F.count("*").alias("n"))
    total = lambda *by: F.sum("n").over(Window.partitionBy("column_name", *by))
    cell = cell.select("column_name", F.col("n").alias("n"), total().alias("t"), total("b").alias("nb"), total("y").alias("ny"))
    return cell.groupBy("column_name").agg(F.round(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("nb") * F.col("ny")))), 4).alias("mi"))


#: Bits of a value's place between the ends of its column, and of the noise that orders equal values.
VALUE_BITS, NOISE_BITS = 36, 26


def mi_nearest(df: DataFrame, columns: list[str], target: str, key: list[str], k: int = 3, block: int = 250_000) -> DataFrame:
    """Mutual information (nats) of each number with a discrete target, by nearest neighbours (Ross, "Mutual information between discrete and continuous data sets").

    A row's radius reaches to its k-th neighbour of the same class (or as many as
    there are) along one column, and m rows of any class lie nearer; the estimate is
    digamma(N) + mean(digamma(k) - digamma(class size) - digamma(m)), at least 0.
    Values become integers between the column's ends, and equal ones are set apart
    by a hash of the row's ``key``, so the result is the same for any partitioning.

    Each column is cut into blocks of about ``block`` rows that follow each other
    (the cuts are those of a sample, and the result doesn't depend on them), and
    rows meet once, in their block.  A place with k places of its class on either
    side in the block has its radius and every row inside it there.  The first and
    last k places of a class in a block look at the class's places of other blocks,
    of which the first and last 2k suffice; those are found before, inside the
    tasks that read the rows.  The two ends of such a radius are sent to the blocks
    they lie in, which count the rows up to them.

    Null and NaN values and null targets are left out, and so are classes of one
    row; a constant column has 0.
    """
    value = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in columns}
    ends = df.where(F.col(target).isNotNull()).agg(*[f(v).alias(f"{n}{i}") for i, v in enumerate(value.values()) for n, f in (("lo", F.min), ("hi", F.max), ("n", F.count))]).first()
    wide = [(i, c) for i, c in enumerate(columns) if ends[f"lo{i}"] is not None and ends[f"lo{i}"] < ends[f"hi{i}"]]
    schema = "column_name string, mi double"
    if not wide:
        return df.sparkSession.createDataFrame([(c, 0.0) for c in columns], schema)
    row = F.concat_ws(",", *[F.col(c).cast("string") for c in key])
    noise = lambda c: bucket(F.concat(row, F.lit(f",{c}")), 1 << NOISE_BITS)
    place = lambda i, c: F.floor((value[c] - ends[f"lo{i}"]) / (ends[f"hi{i}"] - ends[f"lo{i}"]) * ((1 << VALUE_BITS) - 1)).cast("long")
    places = lambda some: some.where(F.col(target).isNotNull()).select(F.col(target).alias("y"), *[(F.shiftleft(place(i, c), NOISE_BITS) + noise(c)).alias(f"x{j}") for j, (i, c) in enumerate(wide)])
    rows = places(df)
    kind = rows.schema["y"].dataType.simpleString()

    # Cuts of each column, and the number of its first block.
    sizes = [ends[f"n{i}"] for i, _ in wide]
    sample = places(df.sample(min(1.0, 32 / block), 42)).drop("y").toArrow() if max(sizes) > block else None
    edges = []
    for j, n in enumerate(sizes):
        seen = np.sort(sample.column(j).drop_null().to_numpy()) if sample is not None else np.zeros(0, np.int64)
        blocks = math.ceil(n / block)
        edges.append(np.unique(seen[np.arange(1, blocks) * len(seen) // blocks]) if len(seen) else seen)
    base = np.concatenate([[0], np.cumsum([len(e) + 1 for e in edges])])

    def dealt(batch: pa.RecordBatch) -> Iterator[tuple]:
        """Block, place and class of a batch's rows, column by column."""
        for j, cuts in enumerate(edges):
            x = batch.column(f"x{j}")
            there = x.is_valid()
            x = x.filter(there).to_numpy()
            yield (base[j] + np.searchsorted(cuts, x, "right")).astype(np.int32), x, batch.column("y").filter(there)

    def groups(*keys: np.ndarray) -> np.ndarray:
        """Where runs of equal keys start."""
        new = np.ones(len(keys[0]), bool)
        new[1:] = np.logical_or.reduce([a[1:] != a[:-1] for a in keys])
        return np.flatnonzero(new)

    def ranks(starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each of n places, how many come before and after it in its run."""
        length = np.diff(np.append(starts, n))
        before = np.arange(n) - np.repeat(starts, length)
        return before, np.repeat(length, length) - 1 - before

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first and last 2k places of each class in each block, of a task's rows; the first of them carries the number of rows."""
        kept: list[tuple] = []

        def reduced() -> tuple:
            b, x, n, rows = (np.concatenate([t[i] for t in kept]) for i in (0, 1, 3, 4))
            y = pa.concat_arrays([t[2] for t in kept])
            code = y.dictionary_encode().indices.to_numpy()
            order = np.lexsort((x, code, b))
            b, x, code, n, rows = b[order], x[order], code[order], n[order], rows[order]
            at = groups(b, code, x)
            n, rows, order, b, x, code = np.add.reduceat(n, at), np.add.reduceat(rows, at), order[at], b[at], x[at], code[at]
            starts = groups(b, code)
            before, after = ranks(starts, len(b))
            every = np.zeros(len(b), np.int64)
            every[starts] = np.add.reduceat(rows, starts)
            near = np.minimum(before, after) < 2 * k
            return b[near], x[near], y.take(pa.array(order[near])), n[near], every[near]

        for batch in batches:
            for b, x, y in dealt(batch):
                if len(b):
                    kept.append((b, x, y, np.ones(len(b), np.int64), np.ones(len(b), np.int64)))
            if sum(len(t[0]) for t in kept[1:]) >= 1 << 20:
                kept = [reduced()]
        if kept:
            b, x, y, n, every = reduced()
            for i in range(0, len(b), 1 << 16):
                part = slice(i, i + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(b[part]), y.slice(i, 1 << 16), pa.array(x[part]), pa.array(n[part]), pa.array(every[part])], names=["block", "y", "x", "n", "rows"])

    own = Window.partitionBy("block", "y")
    met = rows.mapInArrow(outer, f"block int, y {kind}, x long, n long, rows long")
    met = met.groupBy("block", "y", "x").agg(F.sum("n").alias("n"), F.sum("rows").alias("rows"))
    met = met.withColumns({"before": F.row_number().over(own.orderBy("x")), "after": F.row_number().over(own.orderBy(F.desc("x"))), "every": F.sum("rows").over(own)})
    met = met.where(F.least("before", "after") <= 2 * k).withColumns({"j": sum((F.when(F.col("block") >= int(b), 1).otherwise(0) for b in base[1:-1]), F.lit(0)), "rows": F.when(F.col("before") == 1, F.col("every")).otherwise(0)})
    line = Window.partitionBy("j", "y").orderBy("x")
    beside = [F.struct(F.abs(f("x", s).over(line) - F.col("x")).alias("d"), f("n", s).over(line).alias("n")) for s in range(1, k + 1) for f in (F.lag, F.lead)]
    others = F.array_sort(F.filter(F.array(F.struct(F.lit(0).cast("long").alias("d"), (F.col("n") - 1).alias("n")), *beside), lambda b: b["d"].isNotNull()))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("d"))
    radius = lambda kth: F.aggregate("others", start, lambda s, b: F.when(s["n"] >= kth, s).otherwise(F.struct((s["n"] + b["n"]).alias("n"), b["d"].alias("d"))), lambda s: s["d"])
    met = met.withColumns({"others": others, "size": F.sum("rows").over(Window.partitionBy("j", "y"))}).withColumn("reach", F.least(F.lit(k), F.col("size") - 1))
    met = met.withColumn("half", F.when((F.least("before", "after") <= k) & (F.col("size") > 1), F.greatest(radius(F.col("reach")) - 1, F.lit(0).cast("long")))).drop("others").persist()
    inside = dict(tuple(r) for r in met.where("size > 1").groupBy("block").agg(F.sum("rows")).collect())  # a row for each block
    totals = np.array([inside.get(b, 0) for b in range(base[-1])], np.int64)
    earlier = np.concatenate([np.cumsum(totals[a:b]) - totals[a:b] for a, b in zip(base, base[1:], strict=False)])

    fields = f"block int, sign int, x long, y {kind}, own long, n long"
    names = ["block", "sign", "x", "y", "own", "n"]

    def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, x, y in dealt(batch):
                yield pa.RecordBatch.from_arrays([pa.array(b), pa.array(np.zeros(len(b), np.int32)), pa.array(x), y, pa.nulls(len(b), pa.int64()), pa.nulls(len(b), pa.int64())], names=names)

    def ends_to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            j, x = batch.column("j").to_numpy(), batch.column("x").to_numpy()
            b = np.zeros(len(x), np.int32)
            for i, cuts in enumerate(edges):
                b[j == i] = base[i] + np.searchsorted(cuts, x[j == i], "right")
            yield pa.RecordBatch.from_arrays([pa.array(b), *(batch.column(c) for c in names[1:])], names=names)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many rows lie inside the radius of each place whose class goes on for k places on either side (m, and how many rows have it), and how many lie up to each end sent here."""
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        block, sign, x = (table.column(c).to_numpy() for c in ("block", "sign", "x"))
        y = table.column("y").combine_chunks()
        code = y.dictionary_encode().indices.to_numpy()
        order = np.lexsort((x, block))
        starts = groups(block[order])
        for a, b in zip(starts, np.append(starts[1:], len(order)), strict=True):
            at = order[a:b]
            number = int(block[at[0]])
            j = int(np.searchsorted(base, number, "right")) - 1
            line = at[(sign[at] == 0) | (sign[at] == 2)]
            xs, upto = x[line], np.concatenate([[0], np.cumsum(np.where(sign[line] == 0, 1, -1))])
            reached = lambda p: upto[np.searchsorted(xs, p, "right")]  # noqa: B023, E731
            real = line[sign[line] == 0]
            real = real[np.argsort(code[real], kind="stable")]
            if len(real):
                first = groups(code[real], x[real])
                px, pc, n = x[real][first], code[real][first], np.diff(np.append(first, len(real)))
                near = np.flatnonzero(np.minimum(*ranks(groups(pc), len(px))) >= k)
                if len(near):
                    spot = near[:, None] + np.array([0, *(s for i in range(1, k + 1) for s in (-i, i))])
                    d, others = np.abs(px[spot] - px[near][:, None]), n[spot]
                    others[:, 0] -= 1
                    by = np.argsort(d, axis=1, kind="stable")
                    d, others = np.take_along_axis(d, by, 1), np.cumsum(np.take_along_axis(others, by, 1), axis=1)
                    half = np.maximum(d[np.arange(len(near)), (others >= k).argmax(1)] - 1, 0)
                    m, which = np.unique(reached(px[near] + half) - reached(px[near] - half - 1), return_inverse=True)
                    rows = np.bincount(which, n[near]).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), j, np.int32)), pa.nulls(len(m), y.type), pa.array(m), pa.array(rows), pa.nulls(len(m), pa.int64())], names=["j", "y", "x", "n", "m"])
            asked = at[np.abs(sign[at]) == 1]
            if len(asked):
                m = sign[asked] * (earlier[number] + reached(x[asked]))
                taken = pa.array(asked)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), j, np.int32)), y.take(taken), table.column("own").take(taken).combine_chunks(), table.column("n").take(taken).combine_chunks(), pa.array(m)], names=["j", "y", "x", "n", "m"])

    # Places whose radius may leave their block ask at both ends of it; the only row of a class is taken back.
    whole = lambda v: F.lit(v).cast("long")
    asked = met.where("half is not null").select("j", F.explode(F.array(F.struct(F.lit(1).alias("sign"), (F.col("x") + F.col("half")).alias("at"), F.col("n").alias("n")), F.struct(F.lit(-1).alias("sign"), (F.col("x") - F.col("half") - 1).alias("at"), whole(0).alias("n")))).alias("e"), "y", "x")
    asked = asked.select("j", "e.sign", F.col("e.at").alias("x"), "y", F.col("x").alias("own"), "e.n")
    alone = met.where("size = 1").select("j", F.lit(2).alias("sign"), "x", "y", whole(None).alias("own"), whole(None).alias("n"))
    sent = rows.mapInArrow(to_blocks, fields).unionByName(asked.unionByName(alone).mapInArrow(ends_to_blocks, fields))
    found = sent.repartitionById(int(base[-1]), F.col("block")).mapInArrow(counted, f"j int, y {kind}, x long, n long, m long")
    # A radius of one block comes as (null, m, rows); one of ends as two counts, whose difference is m.
    found = found.groupBy("j", "y", "x").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).select("j", "n", F.when(F.col("y").isNull(), F.col("x")).otherwise(F.col("m")).cast("double").alias("m"))
    # Whole billionths add up to the same sum in any order.
    billionths = lambda v: F.round(v * 1e9).cast("decimal(20,0)")
    psi = lambda c: digamma(F.col(c).cast("double"))
    classes = met.where("size > 1 and rows > 0").groupBy("j", "y").agg(F.max("size").alias("n"), F.max("reach").alias("reach"))
    terms = found.select("j", whole(0).alias("total"), (F.col("n") * billionths(-psi("m"))).alias("t")).unionByName(classes.select("j", F.col("n").alias("total"), (F.col("n") * billionths(psi("reach") - psi("n"))).alias("t")))
    made = terms.groupBy("j").agg(F.sum("total").alias("total"), (F.sum("t").cast("double") / 1e9).alias("terms"))
    mi = F.round(F.greatest(psi("total") + F.col("terms") / F.col("total"), F.lit(0.0)), 4)
    told = {wide[r.j][1]: r.mi for r in made.select("j", mi.alias("mi")).collect()}  # a row for each column
    met.unpersist()
    return df.sparkSession.createDataFrame([(c, told.get(c, 0.0)) for c in columns], schema)


def mi_gate(scores: DataFrame, k: int = 6) -> DataFrame:
    return scores.orderBy(F.desc("mi"), "column_name").limit(k)


# -- text -------------------------------------------------------------------------------


def text_columns(df: DataFrame, least: float = 10.0) -> DataFrame:
    names = [c for c, k in df.dtypes if k == "string"]
    agg = df.agg(*[F.avg(F.length(c)).alias(c) for c in names])
    return stack(agg, [{"column_name": F.lit(c), "mean_length": F.round(F.col(c), 4), "is_text": F.coalesce(F.col(c) > least, F.lit(False))} for c in names])


def _share(text: Column, kept: str) -> Column:
    return F.when(F.length(text) > 0, F.length(F.regexp_replace(text, kept, "")) / F.length(text)).otherwise(0.0)


def text_features(df: DataFrame, text: str, script: str = "가-힣") -> DataFrame:
    """Length, words, mean word length, shares of digits and of a script, and a question flag."""
    t = F.coalesce(F.col(text), F.lit(""))
    w = words(t)
    return df.withColumns({
        f"{text}_length": F.length(t), f"{text}_words": F.size(w),
        f"{text}_word_length": F.when(F.size(w) > 0, F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x)) / F.size(w)).otherwise(0.0),
        f"{text}_digit_ratio": _share(t, r"[^\p{Nd}]"), f"{text}_script_ratio": _share(t, f"[^{script}]"), f"{text}_has_question": t.contains("?").cast("int"),
    })


def pair_features(df: DataFrame, a: str, b: str) -> DataFrame:
    """Length ratio and word Jaccard similarity of two texts (0 if either has no word)."""
    wa, wb = F.array_distinct(words(F.coalesce(F.col(a), F.lit("")))), F.array_distinct(words(F.coalesce(F.col(b), F.lit(""))))
    ratio = F.length(F.coalesce(F.col(a), F.lit(""))) / (F.length(F.coalesce(F.col(b), F.lit(""))) + 1)
    return df.withColumns({"length_ratio": ratio, "jaccard": F.when((F.size(wa) > 0) & (F.size(wb) > 0), F.size(F.array_intersect(wa, wb)) / F.size(F.array_union(wa, wb))).otherwise(0.0)})


# -- presets and recipes ----------------------------------------------------------------


def candidate_columns(df: DataFrame, patterns: list[str], ids: list[str] = ()) -> list[str]:
    """Columns that a preset's patterns hit; with fewer than three, numbers too; else all."""
    from ..functions.expressions import numeric_columns

    own = [c for c in df.columns if c not in ids]
    hits = [c for c in own if any(p in c.lower() for p in patterns)]
    if len(hits) < 3:
        hits += [c for c in own if c in numeric_columns(df) and c not in hits]
    return hits or own


def at_risk_features(df: DataFrame, fails: str, attendance: str, gpa: str) -> DataFrame:
    return df.withColumns({"has_fail": (F.col(fails) > 0).cast("int"), "attendance_gap": F.greatest(F.lit(0.0), 80 - F.col(attendance)), "low_gpa": (F.col(gpa) < 2).cast("int")})


def activity_breadth(df: DataFrame, activities: list[str], courses: list[str]) -> DataFrame:
    total = sum((F.coalesce(F.col(c), F.lit(0)) for c in activities), F.lit(0))
    taken = sum(((F.coalesce(F.col(c), F.lit(0)) > 0).cast("int") for c in courses), F.lit(0))
    return df.withColumns({"activity_total": total, "course_breadth": taken})


def safe_gpa_ratio(df: DataFrame, major: str, overall: str) -> DataFrame:
    return df.withColumn("gpa_ratio", F.col(major) / F.greatest(F.col(overall), F.lit(0.1)))


def recipe_features(df: DataFrame, entity: str, order: list[str], value: str, part: str, whole: str) -> DataFrame:
    """Drop against the entity's previous value, a crisis flag, and a safe share of two amounts."""
    before = F.lag(value).over(Window.partitionBy(entity).orderBy(*order))
    drop = F.coalesce(before - F.col(value), F.lit(0.0))
    return df.withColumns({"value_drop": drop, "crisis": ((drop > 0) & (F.col(value) <= 8)).cast("int"), "part_share": F.when(F.col(whole) != 0, F.col(part) / F.col(whole)).otherwise(0.0)})
