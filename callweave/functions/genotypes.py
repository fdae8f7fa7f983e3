"""Classes of variants and genotypes, likelihoods and attributes as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def variant_class(ref: Column, alts: Column) -> Column:
    """NO_VARIATION, SYMBOLIC, SNP, MNP, INDEL or MIXED."""
    odd = F.exists(alts, lambda a: a.rlike(r"[<>\[\]*]"))
    kinds = F.array_distinct(F.transform(alts, lambda a: F.when(F.length(a) != F.length(ref), "INDEL").when(F.length(a) == 1, "SNP").otherwise("MNP")))
    return F.when(F.size(alts) == 0, "NO_VARIATION").when(odd, "SYMBOLIC").when(F.size(kinds) > 1, "MIXED").otherwise(kinds[0])


def genotype_class(alleles: Column, ref: Column) -> Column:
    called = F.array_compact(alleles)
    return (
        F.when(F.size(alleles) <= 0, "UNAVAILABLE").when(F.size(called) == 0, "NO_CALL").when(F.size(called) < F.size(alleles), "MIXED")
        .when(F.size(F.array_distinct(called)) > 1, "HET").when(called[0] == ref, "HOM_REF").otherwise("HOM_VAR")
    )


def match_class(a: Column, b: Column, phased: Column) -> Column:
    """How two allele lists agree: concordant, phasing-mismatch, no-call, partial-mismatch or discordant."""
    called = F.array_compact(a)
    return (
        F.when(a == b, "concordant").when((a == F.reverse(b)) & phased, "phasing-mismatch").when((F.size(called) == 0) | (F.size(F.array_compact(b)) == 0), "no-call")
        .when(F.arrays_overlap(a, b), "partial-mismatch").otherwise("discordant")
    )


MATCH_SCORES = {"concordant": 1.0, "phasing-mismatch": 1.0, "partial-mismatch": 0.5, "no-call": 0.0, "discordant": 0.0}


def match_score(kind: Column) -> Column:
    out = F.lit(0.0)
    for name, value in MATCH_SCORES.items():
        out = F.when(kind == name, value).otherwise(out)
    return out


def allele_deviation(kind: Column, ref_count: Column, alt_count: Column) -> Column:
    """Distance of the alternate share from the one that the genotype leads to expect; null without reads."""
    expected = F.when(kind == "HOM_VAR", 1.0).when(kind == "HET", 0.5).when(kind == "HOM_REF", 0.0)
    total = ref_count + alt_count
    return F.when(total > 0, F.abs(expected - alt_count / total))


def strand_quality_ratio(ref_quality: Column, alt_quality: Column, ref_count: Column, alt_count: Column) -> Column:
    """Percent difference of mean base qualities of reference and alternate reads; 0 without reads of either."""
    qr, qa = ref_quality / F.nullif(ref_count, F.lit(0)), alt_quality / F.nullif(alt_count, F.lit(0))
    return F.when((ref_count > 0) & (alt_count > 0) & (F.greatest(qr, qa) > 0), 100.0 * (qr - qa) / F.greatest(qr, qa)).otherwise(0.0)


def call_likelihood(kind: Column, pl: Column) -> Column:
    """log10 likelihood against the call: of the reference genotype, or for a reference call the best other one."""
    others = F.slice(pl, 2, F.greatest(F.size(pl) - 1, F.lit(0)))
    return F.when(kind == "HOM_REF", -F.array_min(others) / 10.0).otherwise(-pl[0] / 10.0)


def likelihood_ratio(kind: Column, pl: Column) -> Column:
    """Reference likelihood over the best other one that wasn't called, which counts as -1 at most; null for reference calls."""
    rest = F.when(kind == "HET", F.array(pl[2])).otherwise(F.array(pl[1]))
    return F.when(kind != "HOM_REF", (-pl[0] / 10.0) / F.least(F.lit(-1.0), -F.array_min(rest) / 10.0))


def phred_of_p(p: Column) -> Column:
    return F.greatest(10 * F.log10(p), F.lit(-255.0))


def probabilities(pl: Column) -> Column:
    """Genotype probabilities from phred likelihoods, normalised."""
    raw = F.transform(pl, lambda x: F.pow(F.lit(10.0), -x / 10.0))
    total = F.aggregate(raw, F.lit(0.0), lambda s, x: s + x)
    return F.transform(raw, lambda x: x / total)


#: Limits under which a heterozygous call can't be read as a haploid one, by kind of variant: of the variant's and the reference's probability.
HAPLOID_LIMITS = {"SNP": (1e-5, 1e-20), "other": (1e-50, 1e-200)}


def haploid_call(kind: Column, variant: Column, pl: Column) -> Column:
    """unchanged, variant or no-call for the haploid reading of a diploid call."""
    p = probabilities(pl)
    low = F.when(variant == "SNP", HAPLOID_LIMITS["SNP"][0]).otherwise(HAPLOID_LIMITS["other"][0])
    ref = F.when(variant == "SNP", HAPLOID_LIMITS["SNP"][1]).otherwise(HAPLOID_LIMITS["other"][1])
    return F.when(kind != "HET", "unchanged").when((p[2] > low) | (p[0] < ref), "variant").otherwise("no-call")


def sv_type(ref: Column, alt: Column, info: Column, max_indel: int = 5000) -> Column:
    """DEL, INS, DUP, INV, BND, CNV or another symbol's name; null for small variants."""
    symbol = F.nullif(F.regexp_extract(alt, r"^<(\w+)", 1), F.lit(""))
    change = F.length(alt) - F.length(ref)
    return F.coalesce(F.when(alt.rlike(r"[\[\]]"), "BND"), symbol, F.when(F.abs(change) > max_indel, F.when(change < 0, "DEL").otherwise("INS")), F.when(info["SVTYPE"].isNotNull() & (info["SVTYPE"] == "BND"), "BND"))


def sv_length(ref: Column, alt: Column, start: Column, end: Column, info: Column) -> Column:
    """The longest that SVLEN, the span and the alleles say."""
    said = F.abs(F.expr("0").cast("int")) if info is None else F.coalesce(F.abs(F.split(info["SVLEN"], ",")[0].try_cast("int")), F.lit(0))
    text = F.when(alt.rlike(r"[<\[\]]"), F.lit(0)).otherwise(F.abs(F.length(alt) - F.length(ref)))
    return F.greatest(said, text, F.coalesce(end - start, F.lit(0)))


#: (length up to, half-width) of the default confidence interval; longer variants take the first entry's.
INTERVALS = [(200, 10), (500, 100), (1000, 200), (1_000_000, 500)]


def half_width(length: Column, table: list[tuple[int, int]] = INTERVALS) -> Column:
    out = F.lit(table[0][1])
    for most, width in reversed(table):
        out = F.when(length <= most, width).otherwise(out)
    return out
