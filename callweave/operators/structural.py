"""Matching of structural variants by type and confidence intervals."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.functions import genotypes as G
from callweave.operators.intervals import overlap_join


def with_bounds(df: DataFrame, table: list[tuple[int, int]] = G.INTERVALS) -> DataFrame:
    """Adds the bounds of start and end. df: start, length, ci (half-width or null; 0 counts as null)."""
    width = F.when(F.coalesce("ci", F.lit(0)) > 0, F.col("ci")).otherwise(G.half_width(F.col("length"), table))
    end = F.greatest(F.col("start") + F.col("length"), F.col("end"))
    return df.withColumns({"lo": F.col("start") - width, "hi": F.col("start") + width, "end_lo": end - width, "end_hi": end + width})


def candidates(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of one type (CNV matches nothing) whose bounds of start and of end overlap, and the positions that they share."""
    spread = lambda d: d.withColumns({"own_start": F.col("start"), "own_end": F.col("end"), "start": F.col("lo"), "end": F.col("hi")})
    met = overlap_join(spread(a), spread(b)).where("type = type_b and type <> 'CNV' and end_lo <= end_hi_b and end_lo_b <= end_hi")
    shared = F.greatest(F.lit(0), F.least("own_end", "own_end_b") - F.greatest("own_start", "own_start_b") + 1)
    return met.select("contig", "id", "id_b", F.col("own_start").alias("start"), shared.alias("shared"))


def matched(a: DataFrame, b: DataFrame) -> DataFrame:
    """contig, id, id_b: each row of a, in order of start, takes the free row of b with which it shares most; greedy and one to one.

    The choice depends on the order within a contig, so a contig's candidate pairs, ids and a count each, are one group; structural variants are few.
    """
    pairs = candidates(a, b)

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        used, done, out = set(), set(), []
        for r in pdf.sort_values(["start", "id", "shared", "id_b"], ascending=[True, True, False, True]).itertuples():
            if r.id not in done and r.id_b not in used:
                done.add(r.id)
                used.add(r.id_b)
                out.append((r.contig, r.id, r.id_b))
        return pd.DataFrame(out, columns=["contig", "id", "id_b"])

    return pairs.groupBy("contig").applyInPandas(greedy, "contig string, id long, id_b long")


def outside_deletions(calls: DataFrame, others: DataFrame) -> DataFrame:
    """Small calls that start in no deletion of the other set."""
    points = calls.withColumns({"_end": F.col("end"), "end": F.col("start")})
    spans = others.where("type = 'DEL'").select("contig", "start", "end")
    return overlap_join(points, spans, how="left_anti").withColumn("end", F.col("_end")).drop("_end")


def merged_into(calls: DataFrame, variants: DataFrame) -> DataFrame:
    """Small calls outside the structural variants, and those: contig, start, end and the columns that both have."""
    shared = [c for c in calls.columns if c in variants.columns]
    outside = overlap_join(calls, variants.select("contig", "start", "end"), how="left_anti")
    return outside.select(*shared).unionByName(variants.select(*shared))


def overlapping(df: DataFrame, key: str) -> DataFrame:
    """Each row with the first other row, by start and key, that it overlaps: key and key_b."""
    met = overlap_join(df, df).where(F.col(key) != F.col(f"{key}_b"))
    return met.groupBy(key).agg(F.min(F.struct("start_b", f"{key}_b")).alias("m")).select(key, F.col(f"m.{key}_b").alias(f"{key}_b"))


def bed_regions(df: DataFrame) -> DataFrame:
    """chr, start, end of deletions and insertions, widened to the bounds of with_bounds()."""
    return df.where("type in ('DEL', 'INS')").select(F.col("contig").alias("chr"), F.greatest(F.lit(1), "lo").alias("start"), F.when(F.col("type") == "INS", F.col("hi")).otherwise(F.col("end_hi")).alias("end"))
