"""Cleaning and normalising of call sets to one representation."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.functions.sequence import left_align
from callweave.operators.sizes import sent


def contig_names(order: list[str]) -> dict[str, str]:
    """Other spellings of reference contigs: with and without chr, M and MT, and version or random suffixes in either style."""
    out = {}
    for name in order:
        bare = name.removeprefix("chr")
        for other in {name, bare, f"chr{bare}", bare.replace("_", "-"), bare.split(".")[0], *({"M", "chrM", "MT", "chrMT"} if bare in ("M", "MT") else ())}:
            out.setdefault(other, name)
    return out


#: Fixed names of alternate haplotypes in the two spellings; those of the MHC follow a rule.
HAPLOTYPES = {"chr17_ctg5_hap1": "HSCHR17_1", "chr4_ctg9_hap1": "HSCHR4_1"}


def unplaced_name(name: str) -> str | None:
    """The accession of an unplaced, unlocalised or haplotype contig that is named in the style of chr, without version; null for other names."""
    if m := re.fullmatch(r"chr[0-9A-Za-z]+_gl([0-9]{6})(_random)?", name):
        return f"GL{m[1]}"
    if m := re.fullmatch(r"chr6_([a-z]+)_hap[0-9]", name):
        return f"HSCHR6_MHC_{m[1].upper()}"
    return HAPLOTYPES.get(name)


def resolved(names: list[str], order: list[str]) -> dict[str, str]:
    """The reference's name of each contig name that it knows under any spelling, whichever style either is in."""
    spelled = contig_names(order) | {other: o for o in order if (other := unplaced_name(o))}
    out = {n: spelled.get(n) or spelled.get(unplaced_name(n) or "") or spelled.get(n.split(".")[0]) for n in names}
    return {n: o for n, o in out.items() if o}


def renamed_contigs(df: DataFrame, order: list[str], column: str = "chr") -> DataFrame:
    """Contigs by the reference's names; rows of unknown ones go. The distinct names of a call set are few and resolved on the driver."""
    found = resolved([r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().collect()], order)
    table = df.sparkSession.createDataFrame(list(found.items()), "old string, new string")
    return remapped(df, table, column)


def remapped(df: DataFrame, mapping: DataFrame, column: str = "chr") -> DataFrame:
    """Contigs renamed by mapping (old, new), a row for each contig; rows of unknown ones go."""
    names = sent(mapping.select(F.col("old").alias(column), "new"))
    return df.join(names, column).drop(column).withColumnRenamed("new", column).select(*df.columns)


def unmapped(df: DataFrame, mapping: DataFrame, column: str = "chr") -> DataFrame:
    return df.join(sent(mapping.select(F.col("old").alias(column))), column, "left_anti")


def cleaned(df: DataFrame) -> DataFrame:
    """Gap characters leave alleles; rows with an alternate equal to the reference or twice, other than printable characters or a negative quality go."""
    strip = lambda x: F.regexp_replace(x, "[-.]", "")
    df = df.withColumns({"ref": strip(F.col("ref")), "alts": F.transform("alts", lambda a: F.when(a.rlike(r"[<\[\]]"), a).otherwise(strip(a)))})
    ok = ~F.array_contains("alts", F.col("ref")) & (F.size(F.array_distinct("alts")) == F.size("alts")) & ~F.coalesce(F.col("id"), F.lit("")).rlike("[^\\x20-\\x7E]")
    return df.where(ok & (F.coalesce(F.col("qual"), F.lit(1.0)) >= 0))


def reference_agrees(df: DataFrame, bases: DataFrame) -> DataFrame:
    """Drops rows whose reference allele differs from the sequence, where both are pure ACGT. bases: key, seq."""
    both = df.join(bases, "key", "left")
    pure = F.col("ref").rlike("^[ACGT]+$") & F.coalesce(F.col("seq"), F.lit("")).rlike("^[ACGT]+$")
    return both.where(~pure | (F.col("ref") == F.col("seq"))).drop("seq")


def padded(df: DataFrame) -> DataFrame:
    """Indels without a common first base get the base before (column before) and start there."""
    plain = ~F.exists("alts", lambda a: a.rlike(r"[<\[\]]"))
    bare = plain & F.forall("alts", lambda a: F.substr(a, F.lit(1), F.lit(1)) != F.substr(F.col("ref"), F.lit(1), F.lit(1))) & F.exists("alts", lambda a: F.length(a) != F.length("ref")) & F.col("before").isNotNull()
    out = df.withColumn("_pad", bare)
    return out.withColumns({"start": F.when(F.col("_pad"), F.col("start") - 1).otherwise(F.col("start")), "ref": F.when(F.col("_pad"), F.concat("before", "ref")).otherwise(F.col("ref")), "alts": F.when(F.col("_pad"), F.transform("alts", lambda a: F.concat("before", a))).otherwise(F.col("alts"))}).drop("_pad")


def with_ploidy(df: DataFrame, n: int = 2) -> DataFrame:
    """Single alleles repeated n times; genotypes of n alleles stay, others are an error."""
    def fixed(g):
        alleles = F.when(F.size(g["alleles"]) == n, g["alleles"]).when(F.size(g["alleles"]) == 1, F.array_repeat(g["alleles"][0], n)).otherwise(F.raise_error(F.lit("a genotype of another ploidy")).cast("array<string>"))
        return g.withField("alleles", alleles)

    return df.withColumn("genotypes", F.transform("genotypes", fixed))


def without_no_calls(df: DataFrame, kinds: tuple[str, ...] = ("NO_CALL", "UNAVAILABLE")) -> DataFrame:
    """Single-sample rows whose genotype is of those kinds go."""
    return df.where((F.col("num_samples") != 1) | ~F.coalesce(F.expr("get(genotypes, 0).gt_type"), F.lit("")).isin(*kinds))


def renamed_sample(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn("genotypes", F.when(F.size("genotypes") == 1, F.transform("genotypes", lambda g: g.withField("sample", F.lit(name)))).otherwise(F.col("genotypes")))


def without_end(df: DataFrame) -> DataFrame:
    return df.withColumn("info", F.when(F.col("type") == "SYMBOLIC", F.col("info")).otherwise(F.map_filter("info", lambda k, v: k != "END")))


def left_aligned(df: DataFrame) -> DataFrame:
    """df: start, ref, alt and before, the bases up to the anchor (200 at most looked at); simple indels move left, others stay."""
    schema = df.schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            moved = [left_align(r, a, int(s), (b or "")[-200:]) for r, a, s, b in zip(pdf["ref"], pdf["alt"], pdf["start"], pdf["before"], strict=True)]
            yield pdf.assign(start=[m[0] for m in moved], ref=[m[1] for m in moved], alt=[m[2] for m in moved])

    return df.mapInPandas(run, schema)


def to_reference(df: DataFrame) -> DataFrame:
    return df.withColumn("genotypes", F.transform("genotypes", lambda g: g.withField("alleles", F.transform(g["alleles"], lambda a: F.col("ref"))).withField("gt_type", F.lit("HOM_REF"))))


def in_contig_order(df: DataFrame, order: list[str], column: str = "chr") -> DataFrame:
    """Sorted by the contigs' order, then by place: a range sort, which spills."""
    place = F.create_map(*[x for k, name in enumerate(order) for x in (F.lit(name), F.lit(k))])
    return df.orderBy(place[F.col(column)].asc_nulls_last(), "start")
