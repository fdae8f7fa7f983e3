"""Interval joins and interval algebra. Intervals are closed: start and end belong to them; start > end is no interval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Widths of bins; an interval has those of the first width that it isn't longer than, so two at most below the last.
WIDTHS = [64, 4096, 262_144, 16_777_216]


def _width(start: Column, end: Column, widths: list[int]) -> Column:
    out = F.lit(widths[-1]).cast("long")
    for w in reversed(widths[:-1]):
        out = F.when(end - start < w, F.lit(w).cast("long")).otherwise(out)
    return out


def _widths(df: DataFrame) -> list[int]:
    """Those that rows of df have."""
    return sorted(r[0] for r in df.where("start <= end").select(_width(F.col("start"), F.col("end"), WIDTHS)).distinct().collect()) or WIDTHS[:1]


def _bins(start: Column, end: Column, own: list[int], other: list[int], swap: bool = False) -> Column:
    """A row for each place where an interval can meet others: the widths of both sides and the bin, by the larger width."""
    mine = _width(start, end, own)

    def places(theirs: int) -> Column:
        most = F.greatest(mine, F.lit(theirs).cast("long"))
        one, two = mine, F.lit(theirs).cast("long")
        if swap:
            one, two = two, one
        return F.transform(F.sequence(F.floor(start / most), F.floor(end / most)), lambda k: F.struct(one.alias("a"), two.alias("b"), k.alias("at")))

    return F.explode(F.flatten(F.array(*[places(w) for w in other])))


def overlap_join(a: DataFrame, b: DataFrame, on: str = "contig", width: int | None = None, how: str = "inner") -> DataFrame:
    """Rows of a with the overlapping rows of b; b's columns get the suffix _b. Both need start and end; how: inner, left, left_semi or left_anti.

    Both sides are dealt by contig and bin, so a long contig spreads over many tasks; a pair that shares several bins is kept in the first one only. Bins are
    of the given width, or by the intervals' own lengths: short ones meet in narrow bins, so that few pairs are looked at in vain, and a pair with a long one in that one's bins.
    """
    one, two = ([width], [width]) if width else (_widths(a), _widths(b))
    left = a.where("start <= end").withColumn("_bin", _bins(F.col("start"), F.col("end"), one, two))
    right = b.where("start <= end").select(*[F.col(c).alias(f"{c}_b") for c in b.columns]).withColumn("_bin_b", _bins(F.col("start_b"), F.col("end_b"), two, one, swap=True))
    met = (F.col(on) == F.col(f"{on}_b")) & (F.col("_bin") == F.col("_bin_b")) & (F.col("start") <= F.col("end_b")) & (F.col("start_b") <= F.col("end"))
    once = F.col("_bin.at") == F.floor(F.greatest("start", "start_b") / F.greatest("_bin.a", "_bin.b"))
    inner = left.join(right, met & once).drop("_bin", "_bin_b")
    if how == "inner":
        return inner
    # whether a row overlaps depends on its place alone, so places are looked up, and rows of any type, repeated ones too, by their places
    place = [on, "start", "end"]
    spans = a.select(*place).where("start <= end").distinct().withColumn("_bin", _bins(F.col("start"), F.col("end"), one, two))
    hits = spans.join(right, met, "left_semi").select(*place).distinct()
    if how == "left_semi":
        return a.join(hits, place, "left_semi").select(*a.columns)
    misses = a.join(hits, [a[c].eqNullSafe(hits[c]) for c in place], "left_anti")
    if how == "left_anti":
        return misses
    return inner.unionByName(misses.select(*a.columns, *[F.lit(None).cast(b.schema[c].dataType).alias(f"{c}_b") for c in b.columns]))


#: Positions of a block; sums run within blocks, and over a row for each block, so a contig is no single task.
BLOCK = 1 << 20


def _sweep(*sets: DataFrame, on: str) -> DataFrame:
    """on, start, end and d0, d1, ...: the depth of each set over each stretch between two ends."""
    events = None
    for k, s in enumerate(sets):
        ok = s.where("start <= end")
        for edge, step in (("start", 1), (F.col("end") + 1, -1)):
            own = ok.select(F.col(on), (F.col(edge) if isinstance(edge, str) else edge).cast("long").alias("at"), *[F.lit(step if j == k else 0).alias(f"s{j}") for j in range(len(sets))])
            events = own if events is None else events.unionByName(own)
    steps = events.groupBy(on, "at").agg(*[F.sum(f"s{j}").alias(f"s{j}") for j in range(len(sets))])
    depths = [f"s{j}" for j in range(len(sets))]
    steps = steps.withColumn("_blk", F.floor(F.col("at") / BLOCK))
    every = Window.partitionBy(on).orderBy("_blk")
    sums = steps.groupBy(on, "_blk").agg(*[F.sum(d).alias(d) for d in depths], F.min("at").alias("first"))
    before = sums.select(on, "_blk", F.lead("first").over(every).alias("_next"), *[F.coalesce(F.sum(d).over(every.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"_o{j}") for j, d in enumerate(depths)])
    order = Window.partitionBy(on, "_blk").orderBy("at")
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    out = steps.join(before, [on, "_blk"]).select(
        on, F.col("at").alias("start"), (F.coalesce(F.lead("at").over(order), "_next") - 1).alias("end"), *[(F.sum(d).over(run) + F.col(f"_o{j}")).alias(f"d{j}") for j, d in enumerate(depths)]
    )
    return out.where("end is not null")


def _joined(stretches: DataFrame, on: str) -> DataFrame:
    """Stretches of one contig that touch as one."""
    rows = stretches.select(on, "start", "end", F.floor(F.col("start") / BLOCK).alias("_blk"))
    every, own = Window.partitionBy(on).orderBy("_blk"), Window.partitionBy(on, "_blk").orderBy("start")
    ends = rows.groupBy(on, "_blk").agg(F.max("end").alias("last")).select(on, "_blk", F.lag("last").over(every).alias("_last"))
    fresh = F.when(F.col("start") == F.coalesce(F.lag("end").over(own), "_last") + 1, 0).otherwise(1)
    marked = rows.join(ends, [on, "_blk"]).withColumn("_new", fresh)
    counts = marked.groupBy(on, "_blk").agg(F.sum("_new").alias("n")).select(on, "_blk", F.coalesce(F.sum("n").over(every.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    numbered = marked.join(counts, [on, "_blk"]).withColumn("_no", F.sum("_new").over(own.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_off"))
    return numbered.groupBy(on, "_no").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_no")


def merged(a: DataFrame, on: str = "contig") -> DataFrame:
    """The union, with touching stretches joined."""
    return _joined(_sweep(a, on=on).where("d0 > 0"), on)


def intersected(a: DataFrame, b: DataFrame, on: str = "contig") -> DataFrame:
    return _joined(_sweep(a, b, on=on).where("d0 > 0 and d1 > 0"), on)


def subtracted(a: DataFrame, b: DataFrame, on: str = "contig") -> DataFrame:
    return _joined(_sweep(a, b, on=on).where("d0 > 0 and d1 = 0"), on)


def shared_by_all(*sets: DataFrame, on: str = "contig") -> DataFrame:
    cover = " and ".join(f"d{j} > 0" for j in range(len(sets)))
    return _joined(_sweep(*sets, on=on).where(cover), on)


def covered(a: DataFrame) -> DataFrame:
    """bases: the sum of lengths of disjoint intervals."""
    return a.agg(F.coalesce(F.sum(F.col("end") - F.col("start") + 1), F.lit(0)).cast("long").alias("bases"))


def deep_enough(reads: DataFrame, least: int, on: str = "contig") -> DataFrame:
    """Stretches that at least that many intervals cover."""
    return _joined(_sweep(reads, on=on).where(F.col("d0") >= least), on)


def callable_in(df: DataFrame, sources: list[DataFrame], every: bool = False, on: str = "contig") -> DataFrame:
    """Rows that overlap any (or every) source; all rows without sources."""
    if not sources:
        return df
    out = done = None
    for s in sources:
        hit = overlap_join(df if out is None or not every else out, s, on, how="left_semi")
        out = hit if out is None or every else out.unionByName(overlap_join(hit, done, on, how="left_anti"))
        done = s.select(on, "start", "end") if done is None else done.unionByName(s.select(on, "start", "end"))
    return out


def best_match(a: DataFrame, b: DataFrame, key: str, other: str, on: str = "contig") -> DataFrame:
    """For each row of a the row of b with the most shared positions; ties by other."""
    shared = F.least("end", "end_b") - F.greatest("start", "start_b") + 1
    pairs = overlap_join(a, b, on).withColumn("shared", shared)
    order = Window.partitionBy(key).orderBy(F.desc("shared"), f"{other}_b")
    return pairs.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")
