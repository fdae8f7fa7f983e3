"""Attributes of variant records by name, as columns; ATTRIBUTES is the registry that further ones join."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from callweave.functions import genotypes as G

#: name to a builder of the column, over a row with info (map) and genotypes.
ATTRIBUTES: dict[str, Callable[[], Column]] = {}


def attribute(name: str):
    def add(make: Callable[[], Column]) -> Callable[[], Column]:
        ATTRIBUTES[name] = make
        return make

    return add


def value(name: str) -> Column:
    """The attribute of that name; one that isn't registered is the info value as a number, or null."""
    return ATTRIBUTES[name]() if name in ATTRIBUTES else number(F.col("info")[name])


def text(name: str) -> Column:
    """The info value as it stands."""
    return F.col("info")[name]


def number(raw: Column) -> Column:
    return raw.try_cast("double")


def list_number(raw: Column, at: int = 0) -> Column:
    """The absolute value of one entry of a comma-separated text, 0 where there is none."""
    return F.coalesce(F.abs(F.get(F.split(raw, ","), F.lit(at)).try_cast("int")), F.lit(0))


def record_numbers() -> Column:
    """All info values that are numbers, by name."""
    return F.map_filter(F.transform_values("info", lambda k, v: v.try_cast("double")), lambda k, v: v.isNotNull())


def n_sets(label: Column, n: int) -> Column:
    """How many call sets a label of provenance names; all of n for Intersection, none for FilteredInAll or null."""
    return F.when(label.isNull() | (label == "FilteredInAll"), 0).when(label == "Intersection", n).otherwise(F.size(F.split(label, "-")))


def set_callers(label: Column, every: list[str]) -> Column:
    """The call sets that a label of provenance names, sorted: pairs named by AND are taken apart, filtered ones left out."""
    parts = F.filter(F.split(F.regexp_replace(label, "AND", "-"), "-"), lambda x: (x != "") & ~F.startswith(x, F.lit("filter")))
    return F.when(label.isNull() | (label == "FilteredInAll"), F.array().cast("array<string>")).when(label == "Intersection", F.lit(sorted(every))).otherwise(F.array_sort(F.array_distinct(parts)))


def contig_of(breakend: Column) -> Column:
    """The mate's contig of a breakend's text, null for other alleles."""
    return F.nullif(F.regexp_extract(breakend, r"[\[\]]([^:\[\]]+):[0-9]+[\[\]]", 1), F.lit(""))


def _middle(values: Column) -> Column:
    """The median of an array's values, nulls left out."""
    v = F.array_sort(F.array_compact(values))
    n = F.size(v)
    lo, hi = F.get(v, F.floor((n - 1) / 2).cast("int")), F.get(v, F.floor(n / 2).cast("int"))
    return F.when(n > 0, (lo + hi) / 2)


def _counts(g: Column) -> tuple[Column, Column]:
    """(reference, alternate) read counts of a genotype: from AO and DP where there is AO, else from AD."""
    ao = F.aggregate(F.split(g["attrs"]["AO"], ","), F.lit(0), lambda s, x: s + F.coalesce(x.try_cast("int"), F.lit(0)))
    total = F.aggregate(g["ad"], F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))
    first = F.coalesce(F.get(g["ad"], F.lit(0)), F.lit(0))
    has = g["attrs"]["AO"].isNotNull()
    return F.when(has, g["dp"] - ao).otherwise(first), F.when(has, ao).otherwise(total - first)


@attribute("AD")
@attribute("format AD")
def allele_deviation() -> Column:
    """The median over samples; null for genotypes of more than two alleles."""
    def one(g):
        ref, alt = _counts(g)
        return F.when(F.size(g["alleles"]) <= 2, G.allele_deviation(g["gt_type"], ref, alt))

    return _middle(F.transform("genotypes", one))


@attribute("QUAL")
def quality() -> Column:
    return F.col("qual")


@attribute("PL")
def likelihood() -> Column:
    """Of the first sample; callers that give a p-value have it as the likelihood."""
    g = F.get("genotypes", F.lit(0))
    p = g["attrs"]["PVAL"].try_cast("double")
    return F.when(F.size(g["pl"]) > 1, G.call_likelihood(g["gt_type"], g["pl"])).when(p > 0, G.phred_of_p(p))


@attribute("PLratio")
def likelihood_ratio() -> Column:
    g = F.get("genotypes", F.lit(0))
    return F.when(F.size(g["pl"]) > 2, G.likelihood_ratio(g["gt_type"], g["pl"]))


@attribute("QR_QA")
def strand_ratio() -> Column:
    g = F.get("genotypes", F.lit(0))
    ref, alt = _counts(g)
    total = lambda name: F.aggregate(F.split(g["attrs"][name], ","), F.lit(0.0), lambda s, x: s + F.coalesce(x.try_cast("double"), F.lit(0.0)))
    return G.strand_quality_ratio(total("QR"), total("QA"), ref, alt)


def sample_depth(g: Column) -> Column:
    """Of a genotype: DP, else the sums of AD or COV, else DPU or DPI; -1 and empty values count as missing."""
    total = lambda name: F.aggregate(F.split(g["attrs"][name], ","), F.lit(None).cast("int"), lambda s, x: F.coalesce(s + x.try_cast("int"), s, x.try_cast("int")))
    known = lambda c: F.when(c >= 0, c)
    return F.coalesce(known(g["attrs"]["DP"].try_cast("int")), known(total("AD")), known(total("COV")), known(g["attrs"]["DPU"].try_cast("int")), known(g["attrs"]["DPI"].try_cast("int")))


@attribute("format DP")
def format_depth() -> Column:
    """Summed over the samples that have one."""
    all_ = F.array_compact(F.transform("genotypes", sample_depth))
    return F.when(F.size(all_) > 0, F.aggregate(all_, F.lit(0), lambda s, x: s + x)).cast("double")


@attribute("DP")
def depth() -> Column:
    return F.coalesce(format_depth(), number(F.col("info")["DP"]))


@attribute("Context")
def methylation_context() -> Column:
    """The second part of the info value, after a comma, or the whole."""
    parts = F.split(F.col("info")["Context"], ",")
    return F.coalesce(F.get(parts, F.lit(1)), F.get(parts, F.lit(0)))


@attribute("CM")
def methylated() -> Column:
    """Share of methylated reads: CM over CM and CU; null without reads."""
    g = F.get("genotypes", F.lit(0))
    cm, cu = (g["attrs"][n].try_cast("double") for n in ("CM", "CU"))
    return F.when(cm + cu > 0, cm / (cm + cu))


@attribute("CU")
def unmethylated() -> Column:
    return F.get("genotypes", F.lit(0))["attrs"]["CU"].try_cast("double")


#: Fixed meanings of annotation values: what a missing value stands for, and words for codes.
DEFAULTS = {"sift_score": 1.0, "polyphen_score": 0.0, "gms_illumina": 100.0, "gms_solid": 100.0, "gms_iontorrent": 100.0}
SUBTYPES = {"ts": "transition", "tv": "transversion", "ins": "insertion", "del": "deletion"}


def annotation(name: str, raw: Column) -> Column:
    """A looked-up annotation in the form that metrics show."""
    if name in DEFAULTS:
        return F.coalesce(raw.try_cast("double"), F.lit(DEFAULTS[name]))
    if name == "in_cse":
        return F.when(raw.try_cast("int") == 1, "error-prone").otherwise("standard")
    if name == "rmsk":
        return F.when(raw.isNull(), "non-repeat").otherwise("repeat")
    if name == "is_coding":
        return F.when(raw.try_cast("int") == 1, "coding").otherwise("noncoding")
    if name == "sub_type":
        return F.coalesce(F.create_map(*[F.lit(x) for kv in SUBTYPES.items() for x in kv])[raw], raw)
    return raw


def public_names(counts: dict[str, Column]) -> Column:
    """Names of the public sets with a positive count, or unique."""
    names = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(0)) > 0, F.lit(n)) for n, c in counts.items()]))
    return F.when(F.size(names) > 0, names).otherwise(F.array(F.lit("unique")))
