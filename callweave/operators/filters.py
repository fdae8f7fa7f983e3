"""Hard, soft, format and range filters, and named rules."""

from __future__ import annotations

import operator
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OPERATORS = {">": operator.gt, "<": operator.lt, ">=": operator.ge, "<=": operator.le, "==": operator.eq, "!=": operator.ne}


def parsed(text: str) -> tuple[str, str, float]:
    m = re.fullmatch(r"\s*(\w+)\s*(>=|<=|==|!=|>|<)\s*(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)\s*", text)
    if not m:
        raise ValueError(f"not of the form NAME operator number: {text!r}")
    return m[1], m[2], float(m[3])


def condition(text: str, column=F.col) -> Column:
    name, op, value = parsed(text)
    return _OPERATORS[op](column(name), F.lit(value))


def marked(df: DataFrame, passes: Column, name: str) -> DataFrame:
    """Adds a filter name to the rows that fail; a null counts as failing."""
    return df.withColumn("filters", F.when(F.coalesce(passes, F.lit(False)), F.col("filters")).otherwise(F.array_sort(F.array_union("filters", F.array(F.lit(name))))))


def hard(df: DataFrame, expressions: list[str], column=F.col) -> DataFrame:
    """A row that meets an expression gets the filter <name>Filter; a missing value doesn't meet it."""
    for e in expressions:
        df = marked(df, ~F.coalesce(condition(e, column), F.lit(False)), parsed(e)[0] + "Filter")
    return df


def by_format(df: DataFrame, expressions: list[str], column=F.col) -> DataFrame:
    """A row passes if it meets none of the expressions; a missing value fails."""
    ok = reduce(operator.and_, [F.coalesce(~condition(e, column), F.lit(False)) for e in expressions], F.lit(True))
    return marked(df, ok, "FormatRanges")


def in_ranges(df: DataFrame, ranges: dict, remove: bool = False) -> DataFrame:
    """ranges: name to (low, high), None for open ends, or to a set of values, of which an empty one passes all."""
    ok = F.lit(True)
    for name, allowed in ranges.items():
        if isinstance(allowed, (set, frozenset)):
            ok = ok & (F.col(name).isin(sorted(allowed)) if allowed else F.lit(True))
        else:
            low, high = allowed
            ok = ok & (F.lit(True) if low is None else F.col(name) >= low) & (F.lit(True) if high is None else F.col(name) <= high)
    return df.where(ok) if remove else marked(df, ok, "ManualRanges")


def passes() -> Column:
    return F.size("filters") == 0


def non_reference() -> Column:
    return F.forall("genotypes", lambda g: g["gt_type"].isin("HET", "HOM_VAR"))


def _when(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


#: Rules over the columns id, type, zygosity, pl, pl_ratio, dp, mq, ad, callers, n_sets and filters.
RULES = {
    "below-call-support": lambda: _when(F.size("callers") - 1 <= F.ceil(0.4 * (F.col("n_sets") - 1))),
    "all-callers": lambda: _when(F.size("callers") == F.col("n_sets")),
    "novel": lambda: F.col("id").isNull() | (F.col("id") == "."),
    "het-snp": lambda: _when((F.col("zygosity") == "HET") & (F.col("type") == "SNP")),
    "het-indel": lambda: _when((F.col("zygosity") == "HET") & (F.col("type") != "SNP")),
    "novel-het-indel": lambda: RULES["novel"]() & RULES["het-indel"](),
    "low-confidence": lambda: _when(F.col("pl").isNotNull() & ((F.col("pl") > -7.5) | F.coalesce(F.col("pl_ratio") < 0.25, F.lit(False)))),
    "flex-low-confidence": lambda: _when(F.col("pl") > -20),
    "good-pl": lambda: _when(F.col("pl_ratio") > 0.4),
    "low-confidence-novel-het-snp": lambda: RULES["low-confidence"]() & RULES["novel"]() & RULES["het-snp"](),
    "low-depth": lambda: _when(F.col("dp") < 25),
    "high-map-quality": lambda: _when(F.col("mq") > 50),
    "problem-allele-balance": lambda: _when(F.col("ad") > 0.35),
    "passes-filter": lambda: F.size("filters") == 0,
}


def checker(yes: list[str], no: list[str]) -> Column:
    """All of yes hold and none of no."""
    return reduce(operator.and_, [*(RULES[r]() for r in yes), *(~RULES[r]() for r in no)], F.lit(True))


#: Fixed values of the FreeBayes filter. Each line drops calls of a zygosity that meet all its limits: column, operator, value.
FREEBAYES_DROPS = [
    ("HET", [("dp", "<", 4)]),
    ("HET", [("dp", "<", 13), ("qual", "<", 20), ("ad", ">", 0.1), ("ratio", ">", 10)]),
    ("HOM_VAR", [("dp", "<", 4), ("qual", "<", 50)]),
    ("HOM_VAR", [("dp", "<", 13), ("ad", ">", 0.1)]),
    ("HOM_VAR", [("dp", "<", 13), ("ratio", ">", -90)]),
]


def freebayes_filter(kind: Column, **values: Column) -> Column:
    """True for FreeBayes calls to drop; values: dp, qual, ad (allele deviation) and ratio (of strand qualities), of which a null keeps the call."""
    lines = [reduce(operator.and_, [_OPERATORS[op](values[name], F.lit(limit)) for name, op, limit in limits], kind == zygosity) for zygosity, limits in FREEBAYES_DROPS]
    known = reduce(operator.and_, [v.isNotNull() for v in values.values()])
    return _when(known & reduce(operator.or_, lines))


#: Filters that a configuration names.
CUSTOM = {"freebayes": freebayes_filter}


def poor_support(dp: Column, ad: Column) -> Column:
    """Few reads and an allele share that the genotype doesn't lead to expect; nulls aren't poor."""
    return _when((dp < 100) & (ad > 0.05))


def diploid(df: DataFrame) -> DataFrame:
    """Rows whose genotypes have two alleles at most, and one of them has two."""
    return df.where(F.array_max(F.transform("genotypes", lambda g: F.size(g["alleles"]))) == 2)


def low_mappability(scores: Column, least: float) -> Column:
    """True if any of an array of scores lies above 0 and below least."""
    return _when(F.exists(scores, lambda s: F.coalesce((s > 0) & (s < least), F.lit(False))))


def of_sample(df: DataFrame, sample: str, non_reference_only: bool = False) -> DataFrame:
    """Rows with the genotype of one sample alone; a name that is part of one sample's name stands for it. Rows without the sample go."""
    own = lambda g: F.contains(g["sample"], F.lit(sample))
    exact = lambda g: g["sample"] == sample
    chosen = F.when(F.exists("genotypes", exact), F.filter("genotypes", exact)).otherwise(F.slice(F.filter("genotypes", own), 1, 1))
    out = df.withColumn("genotypes", chosen).withColumn("num_samples", F.size("genotypes")).where("num_samples > 0")
    return out.where(non_reference()) if non_reference_only else out


def without_filters(df: DataFrame) -> DataFrame:
    return df.withColumn("filters", F.array().cast("array<string>"))


def validation(forward: Column, reverse: Column, forward_call: Column, reverse_call: Column, ref: Column) -> Column:
    """What two sequencing directions say of a variant: the allele that they confirm, the reference, or null.

    A direction says Pass_<allele>, Fail or NA. An allele counts where both pass alike or one passes and the other is NA; the reference where both
    fail and either call is a comma or a full stop.
    """
    passed = lambda x: F.startswith(x, F.lit("Pass"))
    alike = passed(forward) & (forward == reverse)
    allele = F.regexp_replace(F.split(F.when(passed(forward), forward).otherwise(reverse), ",")[0], "Pass_", "")
    as_ref = (forward == "Fail") & (reverse == "Fail") & (forward_call.isin(",", ".") | reverse_call.isin(",", "."))
    return F.when(alike | (passed(forward) & (reverse == "NA")) | (passed(reverse) & (forward == "NA")), allele).when(as_ref, ref)


def _any_of(yes_no: list[tuple[list[str], list[str]]]) -> Column:
    """Any of several pairs of rules that must hold and rules that mustn't."""
    return reduce(operator.or_, [checker(yes, no) for yes, no in yes_no], F.lit(False))


#: Rules that choose training rows, by set and round: any of the pairs holds, and none of the pairs under "but".
TRAINING = {
    ("fps", 1): {"any": [(["below-call-support", "high-map-quality", "het-snp", "low-confidence"], []), (["below-call-support", "high-map-quality", "novel"], []), (["below-call-support", "high-map-quality", "low-confidence"], ["novel"])], "but": []},
    ("tps", 1): {"any": [(["all-callers", "flex-low-confidence"], [])], "but": []},
    ("tps", 2): {
        "any": [(["below-call-support", "passes-filter"], ["problem-allele-balance", "low-confidence-novel-het-snp"]), (["below-call-support", "het-snp", "good-pl"], ["problem-allele-balance", "novel"])],
        "but": [(["below-call-support", "het-snp", "novel", "low-depth"], [])],
    },
    ("fps", 2): {"any": [(["below-call-support", "high-map-quality"], ["passes-filter"]), (["below-call-support", "high-map-quality", "het-snp", "low-confidence", "novel"], [])], "but": [(["below-call-support", "het-snp"], ["novel", "low-depth"])]},
}


def training(df: DataFrame, which: str, turn: int) -> DataFrame:
    """Rows (with the rules' columns) to train on as true (tps) or false (fps) positives in round 1 or 2; the second goes by the filters of the first."""
    rules = TRAINING[which, turn]
    return without_filters(df.where(_any_of(rules["any"]) & ~_any_of(rules["but"])))
