"""Comparison of call sets: two-way, n-way, by consensus and against truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callweave.functions import genotypes as G
from callweave.operators.sizes import sent


def by_category(a: DataFrame, b: DataFrame, keys: list[str], payload: list[str] | None = None) -> DataFrame:
    """keys, category (concordant, a_only, b_only) and payload, which concordant sites have from b."""
    payload = payload or []
    left, right = a.select(*keys, *payload).dropDuplicates(keys), b.select(*keys, *payload).dropDuplicates(keys)
    left = left.select(*keys, *[F.col(c).alias(f"_a_{c}") for c in payload], F.lit(True).alias("_in_a"))
    right = right.select(*keys, *[F.col(c).alias(f"_b_{c}") for c in payload], F.lit(True).alias("_in_b"))
    both = left.join(right, keys, "full_outer")
    kind = F.when(F.col("_in_a") & F.col("_in_b"), "concordant").when(F.col("_in_a"), "a_only").otherwise("b_only")
    return both.select(*keys, kind.alias("category"), *[F.when(F.col("_in_b"), F.col(f"_b_{c}")).otherwise(F.col(f"_a_{c}")).alias(c) for c in payload])


def split_by_match(calls: DataFrame, site: list[str], genotype: str) -> DataFrame:
    """site and concordant: whether all calls there have the same genotype."""
    return calls.groupBy(*site).agg((F.min(genotype) == F.max(genotype)).alias("concordant"), F.count(F.lit(1)).alias("n_calls"))


def quick(base: DataFrame, other: DataFrame, site: list[str], alleles: str) -> DataFrame:
    """concordant, discordant and percent over the sites that both have; the last of repeated calls of a site, by alleles, counts."""
    one, two = (d.groupBy(*site).agg(F.max(alleles).alias(n)) for d, n in ((base, "_x"), (other, "_y")))
    both = one.join(two, site)
    same = F.count_if(F.col("_x") == F.col("_y"))
    return both.agg(same.alias("concordant"), F.count_if(F.col("_x") != F.col("_y")).alias("discordant"), F.round(100.0 * same / F.nullif(F.count(F.lit(1)), F.lit(0)), 4).alias("percent"))


def approximate(a: DataFrame, b: DataFrame, site: list[str], alleles: str) -> DataFrame:
    """Rows of a that share a site and any allele with a row of b."""
    other = b.select(*site, F.explode(alleles).alias("_x")).distinct()
    mine = a.withColumn("_x", F.explode(alleles))
    return mine.join(other, [*site, "_x"], "left_semi").drop("_x").dropDuplicates()


def sample_scores(a: DataFrame, b: DataFrame, site: list[str], sample: str, alleles: str, least: float = 1.0) -> DataFrame:
    """site, score (the mean over a's samples of how their genotypes agree) and concordant."""
    other = b.select(*site, sample, F.col(alleles).alias("_other"), F.lit(True).alias("_there"))
    kind = F.when(F.col("_there"), G.match_class(F.col(alleles), F.col("_other"), F.lit(False))).otherwise("discordant")
    out = a.join(other, [*site, sample], "left").groupBy(*site).agg(F.avg(G.match_score(kind)).alias("score"))
    return out.withColumn("concordant", F.col("score") >= least)


def provenance(calls: DataFrame, site: list[str], caller: str) -> DataFrame:
    """site, callers (sorted) and n_callers."""
    return calls.groupBy(*site).agg(F.array_sort(F.collect_set(caller)).alias("callers")).withColumn("n_callers", F.size("callers"))


def set_label(callers: Column, n: int) -> Column:
    return F.when(F.size(callers) == n, "Intersection").otherwise(F.array_join(callers, "-"))


def combined(calls: DataFrame, site: list[str], caller: str, priority: dict, payload: list[str]) -> DataFrame:
    """One row for each site: the payload of the first caller by priority, and all callers."""
    rank = F.create_map(*[x for k, v in priority.items() for x in (F.lit(k), F.lit(v))])[F.col(caller)]
    order = F.struct(F.coalesce(rank, F.lit(1 << 30)), F.col(caller), *payload)
    return calls.groupBy(*site).agg(*[F.min_by(c, order).alias(c) for c in payload], F.array_sort(F.collect_set(caller)).alias("callers"))


def overlap_flags(calls: DataFrame, site: list[str], caller: str, genotype: str, callers: list) -> DataFrame:
    """For each site the callers by genotype: from it follow all pairwise comparisons without a join for each pair.

    c_<x>: whether x called the site; agree_all: whether all callers did with one genotype.
    """
    flags = [F.max(F.when(F.col(caller) == c, F.col(genotype))).alias(f"g_{c}") for c in callers]
    return calls.where(F.col(caller).isin(callers)).groupBy(*site).agg(*flags)


def n_way(calls: DataFrame, site: list[str], caller: str, genotype: str, callers: list, target) -> DataFrame:
    """site and verdict: TP (all agree), FN (all others agree, the target differs or misses it), FP (only the target has it) or other."""
    wide = overlap_flags(calls, site, caller, genotype, callers)
    others = [c for c in callers if c != target]
    same = F.lit(True)
    for c in others[1:]:
        same = same & (F.col(f"g_{c}") == F.col(f"g_{others[0]}"))
    same = F.coalesce(same & F.col(f"g_{others[0]}").isNotNull(), F.lit(False))
    mine = F.col(f"g_{target}")
    with_target = F.coalesce(mine == F.col(f"g_{others[0]}"), F.lit(False))
    unlike = F.lit(True)
    for c in others:
        unlike = unlike & ~F.coalesce(F.col(f"g_{c}") == mine, F.lit(False))
    verdict = F.when(same & with_target, "TP").when(same, "FN").when(mine.isNotNull() & unlike, "FP").otherwise("other")
    return wide.select(*site, verdict.alias("verdict"))


def low_support(calls: DataFrame, site: list[str], caller: str, target, n_callers: int, fp_freq: float = 0.4) -> DataFrame:
    """The target's sites with at most ceil(fp_freq * (n - 1)) other callers."""
    seen = calls.groupBy(*site).agg(F.size(F.array_except(F.collect_set(caller), F.array(F.lit(target)))).alias("others"), F.max(F.col(caller) == target).alias("mine"))
    return seen.where(F.col("mine") & (F.col("others") <= F.ceil(F.lit(fp_freq) * (n_callers - 1)))).select(*site, "others")


def _different(value: str) -> Column:
    """The number of different values, by their set: several distinct counts would repeat each row for each of them and deal all again."""
    return F.size(F.collect_set(value))


def trusted(calls: DataFrame, meta: DataFrame, site: list[str], caller: str, least: dict[str, float]) -> DataFrame:
    """Sites where any metadata key has enough distinct values among the callers: a count above 1, else a share of all values."""
    totals = meta.agg(*[F.countDistinct(k).alias(k) for k in least]).first()
    seen = calls.join(sent(meta), caller).groupBy(*site).agg(*[_different(k).alias(k) for k in least])
    ok = F.lit(False)
    for k, v in least.items():
        ok = ok | (F.col(k) >= (v if v > 1 else v * totals[k]))
    return seen.where(ok).select(*site)


def specific(calls: DataFrame, meta: DataFrame, site: list[str], caller: str, technology: str) -> DataFrame:
    """site and kind: technology (one technology, several callers) or caller (one caller, where several technologies were looked at)."""
    seen = calls.join(sent(meta), caller).groupBy(*site).agg(_different(technology).alias("t"), _different(caller).alias("c"))
    return seen.where("(t = 1 and c > 1) or (c = 1 and t > 1)").select(*site, F.when(F.col("t") == 1, technology).otherwise(caller).alias("kind"))


def consensus(calls: DataFrame, site: list[str], caller: str, alleles: str, quality: str, het: str) -> DataFrame:
    """The best supported alleles: by number of callers, homozygous ones first, then summed quality, then the smaller text."""
    groups = calls.groupBy(*site, alleles).agg(F.countDistinct(caller).alias("support"), F.max(F.when(F.col(het), 0).otherwise(1)).alias("homozygous"), F.round(F.sum(quality), 6).alias("quality"))
    order = Window.partitionBy(*site).orderBy(F.desc("support"), F.desc("homozygous"), F.desc("quality"), F.asc(alleles))
    return groups.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r", "homozygous")


def most_frequent(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """The most frequent value, the smallest of equals."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*key, value).count()
    return counts.groupBy(*key).agg(F.min_by(value, F.struct(-F.col("count"), F.col(value))).alias(value))


def grade(discordant: DataFrame, truth: DataFrame, site: list[str], ref: str, alleles: str) -> DataFrame:
    """grade: extra (no truth there), missing (an all-reference call), hethom (shares a non-reference allele) or vardiff."""
    known = truth.select(*site, F.col(alleles).alias("_truth"), F.lit(True).alias("_there"))
    own = F.filter(F.col(alleles), lambda x: x != F.col(ref))
    kind = F.when(F.col("_there").isNull(), "extra").when(F.size(own) == 0, "missing").when(F.arrays_overlap(own, F.filter("_truth", lambda x: x != F.col(ref))), "hethom").otherwise("vardiff")
    return discordant.join(known, site, "left").withColumn("grade", kind).drop("_truth", "_there")


def reason(depth: Column, error_prone: Column, repeat: Column) -> Column:
    """Why a discordant call may differ; a missing depth counts as deep."""
    return F.when(F.coalesce(depth, F.lit(500)) < 13, "low-coverage").when(F.coalesce(error_prone, F.lit(False)), "error-prone").when(F.coalesce(repeat, F.lit(False)), "repeat").otherwise("other")


PENALTIES = {"snp": 1.0, "indel": 2.0, "sv": 2.0}


def accuracy(errors: DataFrame, kind: str, n: str, bases: str) -> DataFrame:
    """score: percent of bases without errors, weighted by kind."""
    weight = F.lit(0.0)
    for k, v in PENALTIES.items():
        weight = F.when(F.col(kind) == k, v).otherwise(weight)
    total = F.max(bases)
    return errors.agg(F.round(100.0 * (total - F.sum(weight * F.col(n))) / total, 4).alias("score"))


#: Ways to compare two call sets, by the name that a configuration gives: a condition on a record (columns as they are) and one of the other set (columns with _b).
APPROACHES: dict = {}


def approach(name: str):
    def add(make):
        APPROACHES[name] = make
        return make

    return add


def _same_site() -> Column:
    return (F.col("start") == F.col("start_b")) & (F.col("end") == F.col("end_b")) & (F.col("ref") == F.col("ref_b"))


@approach("exact")
def _exact() -> Column:
    """One site and the same alleles in the same order."""
    return _same_site() & (F.col("alleles") == F.col("alleles_b"))


@approach("approximate-snp")
def _shares_allele() -> Column:
    """One site and any allele in common."""
    return _same_site() & F.arrays_overlap("alleles", "alleles_b")


@approach("approximate-indel")
def _indel_near() -> Column:
    """The other record starts within this one, and both references are of one base or both of several."""
    return (F.col("start_b") >= F.col("start")) & (F.col("start_b") <= F.col("end")) & ((F.length("ref") == 1) == (F.length("ref_b") == 1))


@approach("approximate")
def _approximate() -> Column:
    """By the type of variant, which must agree: single bases by a common allele, indels by place, others exactly."""
    own = F.when(F.col("type") == "SNP", _shares_allele()).when(F.col("type") == "INDEL", _indel_near()).otherwise(_exact())
    return (F.col("type") == F.col("type_b")) & own


def flexible(a: DataFrame, b: DataFrame, method: str = "approximate") -> DataFrame:
    """contig, id, category: concordant and a_only for records of a, b_only for those of b that no record of a matches.

    a, b: contig, start, end, ref, alleles, type, id. A record of b goes to the first record of a, by start and id, that it matches, so an early
    record of a uses it up; a record of a may use several. Candidates of both sides meet by contig and bin.
    """
    from callweave.operators.intervals import overlap_join

    pairs = overlap_join(a, b).where((F.col("start_b") >= F.col("start")) & F.coalesce(APPROACHES[method](), F.lit(False)))
    first = pairs.groupBy("contig", F.col("id_b")).agg(F.min(F.struct("start", "id")).alias("m")).select("contig", F.col("m.id").alias("id"), "id_b")
    used = first.select("contig", "id").distinct().withColumn("_in", F.lit(True))
    mine = a.select("contig", "id").join(used, ["contig", "id"], "left").select("contig", "id", F.when(F.col("_in"), "concordant").otherwise("a_only").alias("category"))
    rest = b.select("contig", "id").join(first.select("contig", F.col("id_b").alias("id")), ["contig", "id"], "left_anti")
    return mine.unionByName(rest.select("contig", "id", F.lit("b_only").alias("category")))


def route(a_haploid: bool, b_haploid: bool, n_samples: int, structural_done: bool = True) -> list[str]:
    """The comparisons that two call sets go through, in order: structural first unless that is done, then phased, flexible or standard."""
    last = "phased" if a_haploid or b_haploid else "flexible" if n_samples > 1 else "standard"
    return ([] if structural_done else ["structural"]) + [last]


def pairs(names: list[str]) -> list[tuple[str, str]]:
    """All pairs of call sets, in order."""
    return [(x, y) for k, x in enumerate(names) for y in names[k + 1 :]]


def pair_lookup(found: dict[tuple[str, str], object], ignore: tuple[str, ...] = (), suffix: str = "-recal") -> dict[tuple[str, str], object]:
    """Comparisons by names of both call sets, without a suffix that a later step added, and without pairs of an ignored set."""
    bare = lambda n: n.removesuffix(suffix)
    return {(bare(x), bare(y)): v for (x, y), v in found.items() if not {bare(x), bare(y)} & set(ignore)}


def training_cases(discordant: list[DataFrame], site: list[str]) -> DataFrame:
    """Sites that all of several sets of discordant calls have."""
    out = discordant[0].select(*site).distinct()
    for d in discordant[1:]:
        out = out.join(d.select(*site), site, "left_semi")
    return out


def shared_discordant(extra: DataFrame, truth: DataFrame, site: list[str], alleles: str) -> DataFrame:
    """site and kind of each extra call: hethom where the truth has one of its alleles there, shared where it has others, else unique."""
    known = truth.groupBy(*site).agg(F.flatten(F.collect_set(alleles)).alias("_t"))
    kind = F.when(F.col("_t").isNull(), "unique").when(F.arrays_overlap(F.col(alleles), F.col("_t")), "hethom").otherwise("shared")
    return extra.join(known, site, "left").select(*site, kind.alias("kind"))


def with_lookup(calls: DataFrame, table: DataFrame, keys: list[str], defaults: dict[str, object], shift: int = 0, place: str | None = None) -> DataFrame:
    """Calls with columns of a table by one left join, and defaults where it has none; shift is added to the table's place (0-based tables have 1). The first of repeated rows counts."""
    own = table.withColumn(place, F.col(place) + shift) if place else table
    one = own.groupBy(*keys).agg(*[F.min(c).alias(c) for c in defaults])
    out = calls.join(one, keys, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(d)) for c, d in defaults.items() if d is not None})


def combined_metrics(base: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Metrics of two tables by key; where both have a column, the base's value stands unless it is null."""
    shared = [c for c in other.columns if c in base.columns and c not in keys]
    right = other.select(*keys, *[F.col(c).alias(f"_{c}") if c in shared else F.col(c) for c in other.columns if c not in keys])
    out = base.join(right, keys, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.col(f"_{c}")) for c in shared}).drop(*(f"_{c}" for c in shared)) if shared else out


def truth_filter(calls: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """key and reason: the filters of the first truth record that overlaps a call, ref-call if that is an unfiltered reference call, pass if unfiltered, no-call without one.

    calls: contig, start, end, key; truth: contig, start, end, filters (array), reference (boolean).
    """
    from callweave.operators.intervals import overlap_join

    met = overlap_join(calls.select("contig", "start", "end", key), truth.select("contig", "start", "end", "filters", "reference"))
    first = met.groupBy(key).agg(F.min(F.struct("start_b", "end_b", F.array_join("filters_b", ";").alias("f"), F.col("reference_b").alias("r"))).alias("m"))
    reason = F.when(F.col("m").isNull(), "no-call").when(F.col("m.f") != "", F.col("m.f")).when(F.col("m.r"), "ref-call").otherwise("pass")
    return calls.select(key).join(first, key, "left").select(key, reason.alias("reason"))


def merged_consensus(calls: DataFrame, site: list[str], caller: str, alleles: str, likelihood: str, het: str, info: str, order: dict) -> DataFrame:
    """site, alleles (the best supported list), support, info (of all callers merged, the first caller's values first) and callers.

    Lists of alleles are ranked by callers, homozygous before heterozygous, least sum of likelihoods, then by text.
    """
    votes = calls.groupBy(*site, alleles).agg(F.countDistinct(caller).alias("support"), F.max(F.when(F.col(het), 0).otherwise(1)).alias("_hom"), F.round(F.sum(likelihood), 6).alias("_sum"))
    best = votes.groupBy(*site).agg(F.min(F.struct(-F.col("support"), -F.col("_hom"), F.col("_sum"), F.col(alleles))).alias("_b"))
    rank = F.create_map(*[x for k, v in order.items() for x in (F.lit(k), F.lit(v))])[F.col(caller)]
    maps = F.transform(F.reverse(F.array_sort(F.collect_list(F.struct(F.coalesce(rank, F.lit(1 << 30)).alias("k"), F.col(caller).cast("string").alias("c"), F.map_entries(info).alias("m"))))), lambda x: x["m"])
    # the later of equal keys stays, so the first caller's entries come last
    entries = F.flatten(maps)
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["key"] == e["key"]))
    merged = calls.groupBy(*site).agg(F.map_from_entries(last).alias(info), F.array_sort(F.collect_set(caller)).alias("callers"))
    return best.select(*site, F.col(f"_b.{alleles}").alias(alleles), (-F.col("_b.col1")).alias("support")).join(merged, site)


def call_summary(calls: DataFrame, truth: DataFrame, site: list[str]) -> DataFrame:
    """One row: sites that both sets have, and those of one alone."""
    both = by_category(calls, truth, site)
    count = lambda name: F.count_if(F.col("category") == name)
    n = count("concordant")
    return both.agg(n.alias("concordant"), count("a_only").alias("discordant1"), count("b_only").alias("discordant2"), F.round(n / F.nullif(n + count("b_only"), F.lit(0)), 6).alias("sensitivity"))
