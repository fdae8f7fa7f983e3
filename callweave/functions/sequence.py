"""Functions of base strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callweave.operators.sizes import dealt

#: Letters whose pairs one task counts.
LETTERS = 1_000_000


def dimer_entropy(df: DataFrame, key: str, seq: str) -> DataFrame:
    """key and entropy: Shannon entropy in bits of the overlapping pairs of letters. Keys are dealt first, by the letters there are, so a task's counts stay few; a long sequence has few pairs."""
    known = df.where(F.length(seq) > 1).select(key, seq)
    letters = known.agg(F.sum(F.length(seq))).first()[0] or 0
    pairs = dealt(known, key, work=letters, most=LETTERS).select(key, F.explode(F.transform(F.sequence(F.lit(1), F.length(seq) - 1), lambda i: F.substr(F.col(seq), i, F.lit(2)))).alias("pair"))
    counts = pairs.groupBy(key, "pair").count()
    total = F.sum("count").over(Window.partitionBy(key))
    share = counts.withColumn("p", F.col("count") / total)
    return share.groupBy(key).agg((-F.sum(F.col("p") * F.log2("p"))).alias("entropy"))


def gc_content(seq: Column) -> Column:
    """Percent of G and C among unambiguous bases."""
    gc = F.length(F.regexp_replace(F.upper(seq), "[^GC]", ""))
    known = F.length(F.regexp_replace(F.upper(seq), "[^ACGT]", ""))
    return F.when(known > 0, 100.0 * gc / known)


def flank(seq: Column, at: Column, width: int) -> Column:
    """Letters within width of a 1-based place; null where they'd leave the sequence."""
    return F.when((at > width) & (at + width <= F.length(seq)), F.substr(seq, at - width, F.lit(2 * width + 1)))


def shared_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix."""
    n = F.least(F.length(a), F.length(b))
    first = F.array_position(F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(a, i, F.lit(1)) == F.substr(b, i, F.lit(1))), F.lit(False))
    return F.when(n < 1, 0).when(first == 0, n).otherwise((first - 1).cast("int"))


def strip_indel(df: DataFrame, start: str = "start", ref: str = "ref", alt: str = "alt") -> DataFrame:
    """Drops shared leading bases beyond one anchor and moves the start."""
    cut = F.greatest(shared_prefix(F.col(ref), F.col(alt)) - 1, F.lit(0))
    out = df.withColumn("_cut", cut)
    return out.withColumns({start: F.col(start) + F.col("_cut"), ref: F.substr(F.col(ref), F.col("_cut") + 1), alt: F.substr(F.col(alt), F.col("_cut") + 1)}).drop("_cut")


def split_mnp(df: DataFrame, start: str = "start", ref: str = "ref", alt: str = "alt") -> DataFrame:
    """A row for each run of differing bases of equally long alleles, numbered by piece; later pieces are phased with the first."""
    differ = F.filter(F.sequence(F.lit(1), F.length(ref)), lambda i: F.substr(F.col(ref), i, F.lit(1)) != F.substr(F.col(alt), i, F.lit(1)))
    runs = df.withColumn("_at", F.when(F.length(ref) == F.length(alt), differ).otherwise(F.array(F.lit(1))))
    firsts = F.filter("_at", lambda i: ~F.array_contains(F.col("_at"), i - 1))
    lasts = F.filter("_at", lambda i: ~F.array_contains(F.col("_at"), i + 1))
    pieces = runs.select(*df.columns, F.posexplode(F.arrays_zip(firsts.alias("lo"), lasts.alias("hi"))).alias("piece", "_r"))
    equal = F.length(ref) == F.length(alt)
    size = F.col("_r.hi") - F.col("_r.lo") + 1
    new = {
        start: F.col(start) + F.when(equal, F.col("_r.lo") - 1).otherwise(0),
        ref: F.when(equal, F.substr(F.col(ref), F.col("_r.lo"), size)).otherwise(F.col(ref)),
        alt: F.when(equal, F.substr(F.col(alt), F.col("_r.lo"), size)).otherwise(F.col(alt)),
    }
    return pieces.withColumns(new).withColumn("phased", F.col("piece") > 0).drop("_r")


def left_align(ref: str, alt: str, start: int, before: str) -> tuple[int, str, str]:
    """A simple indel moved left through the repeat it lies in. before: the bases up to start, the anchor included, as far as the look-back goes."""
    if len(ref) == len(alt) or min(len(ref), len(alt)) != 1 or ref[0] != alt[0]:
        return start, ref, alt
    longer, k = (ref if len(ref) > len(alt) else alt)[1:], len(before)
    moved = 0
    while k > 1 and longer[-1] == before[k - 1]:
        longer, k, moved = longer[-1] + longer[:-1], k - 1, moved + 1
    anchor = before[k - 1] if k else ref[0]
    return (start - moved, anchor + longer, anchor) if len(ref) > len(alt) else (start - moved, anchor, anchor + longer)
