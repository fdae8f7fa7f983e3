"""Phase blocks and haplotype comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def blocks(df: DataFrame, contig: str, order: list[str], continues) -> DataFrame:
    """Adds block (from 1 within a contig): a row goes on its predecessor's block where continues holds; continues may use prev_end, the end before."""
    by = Window.partitionBy(contig).orderBy(*order)
    marked = df.withColumn("prev_end", F.lag("end").over(by)).withColumn("_new", F.when(F.coalesce(continues, F.lit(False)) & F.col("prev_end").isNotNull(), 0).otherwise(1))
    return marked.withColumn("block", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("_new", "prev_end")


def summary(df: DataFrame, contig: str) -> DataFrame:
    return df.groupBy(contig, "block").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n"))


def between(found: DataFrame, truth: DataFrame, contig: str) -> DataFrame:
    """Truth rows that lie in no block: before the first, between two or after the last one."""
    from callweave.operators.intervals import overlap_join

    spans = found.select(F.col(contig).alias("contig"), "start", "end")
    return overlap_join(truth.withColumnRenamed(contig, "contig"), spans, "contig", how="left_anti").withColumnRenamed("contig", contig)


def score(calls: DataFrame, truth: DataFrame, contig: str = "contig") -> DataFrame:
    """Classes of truth records and extra calls: concordant, ref-concordant, phasing-error or discordant.

    calls: contig, block, start, end, ref, alleles. truth: contig, start, end, ref, allele. Each block's haplotype is the index that most calls match truth by, the smaller of
    equals; a call without truth votes for the reference. Calls without truth inside a truth deletion are left out.
    """
    at_start = truth.select(contig, "start", F.col("ref").alias("t_ref"), F.col("allele").alias("t_allele"), F.lit(True).alias("known"))
    by = Window.partitionBy(contig, "start").orderBy("block", "end", "ref")
    paired = calls.withColumn("_n", F.row_number().over(by)).join(at_start, [contig, "start"], "left")
    paired = paired.withColumn("known", F.coalesce("known", F.lit(False)) & (F.col("_n") == 1))
    wanted = F.when(F.col("known"), F.col("t_allele")).otherwise(F.col("ref"))
    vote = F.when(F.size("alleles") == 1, 0).otherwise(F.array_position("alleles", wanted) - 1)
    votes = paired.withColumn("vote", vote.cast("int")).where("vote >= 0")
    chosen = votes.groupBy(contig, "block", "vote").count().groupBy(contig, "block").agg(F.min_by("vote", F.struct(-F.col("count"), F.col("vote"))).alias("hap"))
    judged = paired.join(chosen, [contig, "block"], "left").withColumn("called", F.expr("get(alleles, hap)"))
    same_ref = F.col("ref") == F.col("t_ref")
    kind = (
        F.when(F.col("called").isNull(), "discordant")
        .when((F.col("called") == F.col("ref")) & (~F.col("known") | (same_ref & (F.col("t_allele") == F.col("called")))), "ref-concordant")
        .when(~F.col("known"), "discordant").when(same_ref & (F.col("t_allele") == F.col("called")), "concordant")
        .when(same_ref & F.array_contains("alleles", F.col("t_allele")), "phasing-error").otherwise("discordant")
    )
    out = judged.select(contig, "block", "start", "known", kind.alias("comparison"))
    deleted = truth.where(F.length("ref") > F.length("allele")).select(F.col(contig).alias("dc"), (F.col("start") + 1).alias("ds"), F.col("end").alias("de"))
    extra = out.where(~F.col("known")).join(deleted, (F.col(contig) == F.col("dc")) & (F.col("start") >= F.col("ds")) & (F.col("start") <= F.col("de")), "left_anti")
    missed = truth.join(out.where("known").select(contig, "start"), [contig, "start"], "left_anti").select(contig, F.lit(None).cast("long").alias("block"), "start", F.lit(True).alias("known"), F.lit("discordant").alias("comparison"))
    return out.where("known").unionByName(extra).unionByName(missed)


def variant_kind(types: list[str]):
    """indel if any record involved is one, snp if all are single bases, else unknown; an aggregate over rows with those columns, whose nulls don't count."""
    any_indel = F.lit(False)
    all_snp = F.lit(True)
    for t in types:
        any_indel = any_indel | F.coalesce(F.col(t).isin("INDEL", "MIXED"), F.lit(False))
        all_snp = all_snp & F.coalesce(F.col(t) == "SNP", F.lit(True))
    return F.when(F.bool_or(any_indel), "indel").when(F.bool_and(all_snp), "snp").otherwise("unknown")


def other_alternate(alleles, ref, matched) -> object:
    """True for a heterozygous call that has a second alternate beside the matched allele."""
    return (F.size(F.array_distinct(alleles)) > 1) & F.exists(alleles, lambda a: (a != ref) & (a != matched))


def metrics(scored: DataFrame) -> DataFrame:
    """comparison, kind, n and blocks: records and distinct blocks by outcome and kind of variant. scored: comparison, kind, contig, block."""
    return scored.groupBy("comparison", "kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("contig", "block").alias("blocks"))


#: Outputs of a phased comparison by outcome, in a comparison and in a grading.
COMPARE_OUTPUTS = {"concordant": "concordant", "ref-concordant": "concordant", "phasing-error": "discordant", "discordant": "discordant"}
GRADE_OUTPUTS = {"concordant": "concordant", "ref-concordant": "concordant", "phasing-error": "phasing-error", "discordant": "discordant"}


def outputs(scored: DataFrame, grade: bool = False) -> DataFrame:
    """Scored rows with output: the file that each goes to; in a grading, truth without a call goes to discordant-missing. scored: comparison, known, block."""
    table = GRADE_OUTPUTS if grade else COMPARE_OUTPUTS
    out = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[F.col("comparison")]
    if grade:
        out = F.when((F.col("comparison") == "discordant") & F.col("known") & F.col("block").isNull(), "discordant-missing").otherwise(out)
    return scored.withColumn("output", out)
