"""Metric distributions, normalisation, top-k, sampling, read-based annotations and classifiers."""

from __future__ import annotations

import math
import random
import re
from collections.abc import Callable

from pyspark.ml.classification import DecisionTreeClassifier, LinearSVC, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Groups up to which each is taken apart for its quantiles; more are groups of one task each.
MOST_GROUPS = 1000
#: Points are looked for at this distance of shares about a quantile, at an error of less.
NEAR, ACCURACY = 0.0005, 5000


def quantiles(df: DataFrame, by: list[str], value: str, shares: list[float]) -> DataFrame:
    """q_<percent> by interpolation, exact.

    Approximate points about each quantile are followed by exact counts of the rows up to each point; only rows between the two points that hold a
    quantile's ranks, some thousandth of all, are sorted. Whatever the points, the ranks lie between those chosen, or beyond the outermost ones.
    """
    names = [f"q_{round(100 * s)}" for s in shares]
    if by and df.select(*by).distinct().limit(MOST_GROUPS + 1).count() > MOST_GROUPS:
        return df.groupBy(*by).agg(*[F.percentile(value, s).alias(n) for s, n in zip(shares, names, strict=True)])
    rows = df.select((F.struct(*by) if by else F.lit(0)).alias("_g"), F.col(value).cast("double").alias("_v"))
    about = sorted({min(1.0, max(0.0, s + d)) for s in shares for d in (-NEAR, NEAR)})
    points = rows.groupBy("_g").agg(F.count("_v").alias("_n"), F.percentile_approx("_v", about, ACCURACY).alias("_p"))
    upto = [F.count_if(F.col("_v") <= F.col("_p")[j]).alias(f"_c{j}") for j in range(len(about))]
    counts = rows.join(F.broadcast(points), "_g").groupBy("_g", "_n", "_p").agg(*upto)
    at = [(F.col("_n") - 1) * F.lit(float(s)) for s in shares]
    each = F.array(*[F.struct(F.col("_p")[j].alias("v"), F.col(f"_c{j}").alias("c")) for j in range(len(about))])

    def between(k: int, x: Column) -> Column:
        """The last point below the ranks and the first one that is not."""
        low, high = F.filter(each, lambda e: e["c"] <= F.floor(x)), F.filter(each, lambda e: e["c"] > F.ceil(x))
        return F.struct(F.lit(k).alias("k"), F.col("_n").alias("n"), F.array_max(low).alias("lo"), F.array_min(high).alias("hi")).alias(f"_b{k}")

    bounds = counts.select("_g", *[between(k, x) for k, x in enumerate(at)])
    inside = lambda b: F.col("_v").isNotNull() & (F.col(f"{b}.lo").isNull() | (F.col("_v") > F.col(f"{b}.lo.v"))) & (F.col(f"{b}.hi").isNull() | (F.col("_v") <= F.col(f"{b}.hi.v")))
    found = F.array_compact(F.array(*[F.when(inside(f"_b{k}"), F.struct(F.lit(k).alias("k"), F.col(f"_b{k}.n").alias("n"), F.coalesce(F.col(f"_b{k}.lo.c"), F.lit(0)).alias("below"))) for k in range(len(shares))]))
    # rows outside stay as one row of their group, so that groups without values do
    met = rows.join(F.broadcast(bounds), "_g").select("_g", "_v", F.explode_outer(found).alias("_h")).groupBy("_g", "_h", F.when(F.col("_h").isNotNull(), F.col("_v")).alias("_v")).count()
    run = met.withColumn("_upto", F.col("_h.below") + F.sum("count").over(Window.partitionBy("_g", "_h").orderBy("_v")))
    out = []
    for k, (s, name) in enumerate(zip(shares, names, strict=True)):
        place = (F.col("_h.n") - 1) * F.lit(float(s))
        own = F.col("_h.k") == k
        low, high = (F.min(F.when(own & (F.col("_upto") > r), F.col("_v"))) for r in (F.floor(place), F.ceil(place)))
        x = F.max(F.when(own, place))
        out.append(F.when(low == high, low).otherwise((F.ceil(x) - x) * low + (x - F.floor(x)) * high).alias(name))
    return run.groupBy("_g").agg(*out).select(*[F.col("_g")[c].alias(c) for c in by], *names) if by else run.agg(*out)


def min_max(df: DataFrame, value: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Adds <value>_scaled: 0 at the low quantile, 1 at the high one, clipped."""
    q = dict(zip("ab", quantiles(df, [], value, [low, high]).first(), strict=True))
    if q["a"] is None or q["a"] == q["b"]:
        return df.withColumn(f"{value}_scaled", F.lit(0.0))
    return df.withColumn(f"{value}_scaled", F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col(value) - q["a"]) / (q["b"] - q["a"]))))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int = 100) -> DataFrame:
    """bin (from 0), n and share; values outside go to the end bins."""
    at = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col(value) - low) / ((high - low) / bins)))).cast("int")
    counts = df.where(F.col(value).isNotNull()).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))  # a row for each bin
    return counts.withColumn("share", F.col("n") / total)


def top_sites(df: DataFrame, site: list[str], order: list[Column], n: int) -> DataFrame:
    """All rows at the sites of the n first rows."""
    first = df.orderBy(*order).limit(n).select(*site).distinct()
    return df.join(first, site, "left_semi")


def random_rows(df: DataFrame, key: list[str], n: int) -> DataFrame:
    """n rows chosen by a digest of their key, the same in every run."""
    return df.orderBy(F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key])), *key).limit(n)


def random_share(df: DataFrame, key: list[str], share: float) -> DataFrame:
    """The rows of the given share of keys, chosen by a digest of the key, without a sort."""
    digest = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key])), 1, 8), 16, 10).cast("long")
    return df.where(digest < int(share * (1 << 32)))


def cluster_sample(df: DataFrame, key: str, values: list[str], n: int, seed: int = 1) -> DataFrame:
    """The first row, by key, of each of n clusters of standardised values."""
    vectors = VectorAssembler(inputCols=values, outputCol="_raw", handleInvalid="skip").transform(df)
    vectors = StandardScaler(inputCol="_raw", outputCol="_v").fit(vectors).transform(vectors)
    model = KMeans(k=n, seed=seed, featuresCol="_v", predictionCol="cluster").fit(vectors)
    return model.transform(vectors).groupBy("cluster").agg(F.min(key).alias(key))


#: Costs of the support vector machines and the width of the radial kernel.
LINEAR_COST, RADIAL_COST, RADIAL_GAMMA, RADIAL_FEATURES = 100.0, 1e5, 0.01, 128


def _assembled(df: DataFrame, values: list[str], invalid: str) -> DataFrame:
    return VectorAssembler(inputCols=values, outputCol="features", handleInvalid=invalid).transform(df)


def radial(df: DataFrame, values: list[str], n: int = RADIAL_FEATURES, gamma: float = RADIAL_GAMMA, seed: int = 7) -> tuple[DataFrame, list[str]]:
    """df with n random Fourier features of values, whose products approach the radial kernel exp(-gamma * distance ** 2), and their names."""
    rng = random.Random(seed)
    names = [f"_r{k}" for k in range(n)]
    wave = lambda: sum((F.col(v) * rng.gauss(0, (2 * gamma) ** 0.5) for v in values), F.lit(rng.uniform(0, 2 * math.pi)))
    return df.withColumns({name: F.cos(wave()) * (2 / n) ** 0.5 for name in names}), names


def classifier(df: DataFrame, values: list[str], label: str, kind: str = "svm"):
    """A fitted model: svm (linear), svm-rbf (on the radial features, which the caller adds) or random-forest (50 trees).

    A cost C for each row is a penalty of 1 / (n * C) on the mean loss.
    """
    vectors = _assembled(df, values, "skip")
    if kind == "random-forest":
        return RandomForestClassifier(numTrees=50, featureSubsetStrategy="sqrt", seed=1, labelCol=label).fit(vectors)
    cost = LINEAR_COST if kind == "svm" else RADIAL_COST
    return LinearSVC(regParam=1 / (max(1, vectors.count()) * cost), maxIter=50, labelCol=label).fit(vectors)


def classifier_group(kind: Column, zygosity: Column) -> Column:
    """Which of the models a call goes to: snp or complex, het or hom."""
    return F.concat_ws("_", F.when(kind == "SNP", "snp").otherwise("complex"), F.when(zygosity == "HET", "het").otherwise("hom"))


GROUPS = ["snp_hom", "snp_het", "complex_hom", "complex_het"]


def group_models(train: DataFrame, attributes: dict[str, list[str]], label: str, group: str = "group", kind: str = "svm") -> dict:
    """(attribute group, call group) to a model, where the training rows hold both labels. Sixteen small fits at most for four attribute groups."""
    have = {r[0] for r in train.groupBy(group).agg(F.countDistinct(label).alias("n")).where("n = 2").select(group).collect()}
    return {(name, g): classifier(train.where(F.col(group) == g), values, label, kind) for name, values in attributes.items() for g in GROUPS if g in have}


def scored_filter(df: DataFrame, models: dict, attributes: dict[str, list[str]], group: str, trusted: Column, specific: Column) -> DataFrame:
    """Adds cfilters, the attribute groups whose model says fail (label 1), and CScoreFilter to the filters of calls with any.

    Trusted calls pass and specific ones fail, whatever the models say; calls without a model pass.
    """
    out = df.withColumn("cfilters", F.array().cast("array<string>"))
    for (name, g), model in models.items():
        vectors = _assembled(out.withColumns({v: F.coalesce(v, F.lit(0.0)) for v in attributes[name]}), attributes[name], "keep")
        got = model.transform(vectors).drop("features", "rawPrediction", "probability")
        out = got.withColumn("cfilters", F.when((F.col(group) == g) & (F.col("prediction") == 1), F.array_union("cfilters", F.array(F.lit(name)))).otherwise(F.col("cfilters"))).drop("prediction")
    bad = F.when(trusted, False).when(specific, True).otherwise(F.size("cfilters") > 0)
    return out.withColumn("filters", F.when(bad, F.array(F.lit("CScoreFilter"))).otherwise(F.array().cast("array<string>")))


def feature_ranking(df: DataFrame, values: list[str], label: str, depth: int = 5) -> list[str]:
    """The values that a decision tree splits by, in the order in which its levels first do."""
    model = DecisionTreeClassifier(maxDepth=depth, labelCol=label, impurity="entropy").fit(_assembled(df, values, "skip"))
    first: dict[int, int] = {}
    for line in model.toDebugString.splitlines():
        if m := re.match(r"(\s*)If \(feature (\d+)", line):
            first[int(m[2])] = min(first.get(int(m[2]), 1 << 30), len(m[1]))
    return [values[k] for k in sorted(first, key=lambda k: (first[k], k))]


def interleaved(lists: list[list]) -> list:
    """Ranked lists as one, by rank and then by list, each entry once."""
    out: dict = {}
    for rank in range(max(map(len, lists), default=0)):
        for own in lists:
            if rank < len(own):
                out.setdefault(own[rank])
    return list(out)


def classified(df: DataFrame, model, values: list[str]) -> DataFrame:
    return model.transform(VectorAssembler(inputCols=values, outputCol="features", handleInvalid="keep").transform(df)).drop("features", "rawPrediction", "probability")


def read_annotations(pileup: DataFrame, site: str) -> DataFrame:
    """Of pileup (site, base_qual, offset, read_len, is_alt, is_reverse): depth, mean length, relative position and distance to the nearer end, and the 2x2 table of alleles and strands."""
    near = F.when(F.col("offset") > F.col("read_len") / 2, F.col("read_len") - F.col("offset") - 1).otherwise(F.col("offset"))
    cell = lambda alt, rev: F.count_if((F.col("is_alt") == alt) & (F.col("is_reverse") == rev))
    return pileup.groupBy(site).agg(
        F.count(F.lit(1)).alias("depth"), F.avg("read_len").alias("mean_len"), F.avg(F.col("offset") / F.col("read_len")).alias("mean_pos"), F.avg(near).alias("end_distance"),
        cell(False, False).alias("ref_fwd"), cell(False, True).alias("ref_rev"), cell(True, False).alias("alt_fwd"), cell(True, True).alias("alt_rev"),
    )


def rank_sum(df: DataFrame, site: str, value: str, is_alt: str) -> DataFrame:
    """u and z of alternate against reference values, with mean ranks for ties."""
    counts = df.groupBy(site, value).agg(F.count_if(F.col(is_alt)).alias("alt"), F.count(F.lit(1)).alias("all"))
    below = F.sum("all").over(Window.partitionBy(site).orderBy(value)) - F.col("all")
    ranked = counts.withColumn("rank", below + (F.col("all") + 1) / 2)
    sums = ranked.groupBy(site).agg(F.sum(F.col("alt") * F.col("rank")).alias("r"), F.sum("alt").alias("n1"), F.sum(F.col("all") - F.col("alt")).alias("n2"))
    u = F.col("r") - F.col("n1") * (F.col("n1") + 1) / 2
    mean, sd = F.col("n1") * F.col("n2") / 2.0, F.sqrt(F.col("n1") * F.col("n2") * (F.col("n1") + F.col("n2") + 1) / 12.0)
    return sums.where("n1 > 0 and n2 > 0").select(site, u.alias("u"), ((u - mean) / sd).alias("z"))


def _upto(n: Column) -> Column:
    """1 to n, empty for 0."""
    return F.when(n > 0, F.sequence(F.lit(1).cast("bigint"), n.cast("bigint"))).otherwise(F.array().cast("array<bigint>"))


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def fisher_phred(a: Column, b: Column, c: Column, d: Column) -> Column:
    """-10 log10 of the two-sided exact p of a 2x2 table: sums the tables with its margins that are no likelier.

    Rows and columns are swapped so that the first of each is the smaller; the first cell then runs from 0, and each table's likelihood, as a share of the
    first's, follows from the one before. They are run through twice, for the own and the largest one and for the sums, so the work grows with the smaller
    margin alone; sums are of logarithms' differences, so no p is too small.
    """

    def swapped(t):
        rows, cols = t["a"] + t["b"] > t["c"] + t["d"], t["a"] + t["c"] > t["b"] + t["d"]
        first = F.when(rows & cols, t["d"]).when(rows, t["c"]).when(cols, t["b"]).otherwise(t["a"])
        n = t["a"] + t["b"] + t["c"] + t["d"]
        r1, c1 = F.when(rows, t["c"] + t["d"]).otherwise(t["a"] + t["b"]), F.when(cols, t["b"] + t["d"]).otherwise(t["a"] + t["c"])
        return F.struct(first.alias("x"), r1.alias("r"), c1.alias("c"), (n - r1 - c1).alias("rest"))

    step = lambda m, x: F.ln((m["r"] - x + 1) * (m["c"] - x + 1) / (x * (m["rest"] + x)))
    every = lambda m: _upto(F.least(m["r"], m["c"]))
    struct = lambda **named: F.struct(*[v.alias(k) for k, v in named.items()])
    zero = F.lit(0.0)

    def peaks(m):
        def more(s, x):
            return _bound(s["l"] + step(m, x), lambda now: struct(l=now, own=F.when(x == m["x"], now).otherwise(s["own"]), most=F.greatest(s["most"], now)))

        return struct(m=m, at=F.aggregate(every(m), struct(l=zero, own=zero, most=zero), more))

    def phred(v):
        own, most = v["at"]["own"], v["at"]["most"]
        tail, share = lambda now: F.when(now <= own + 1e-7, F.exp(now - own)).otherwise(0.0), lambda now: F.exp(now - most)

        def more(s, x):
            return _bound(s["l"] + step(v["m"], x), lambda now: struct(l=now, tail=s["tail"] + tail(now), all=s["all"] + share(now)))

        log = F.aggregate(every(v["m"]), struct(l=zero, tail=tail(zero), all=share(zero)), more, lambda s: own - most + F.ln(s["tail"]) - F.ln(s["all"]))
        return F.least(zero, log) * (-10 / math.log(10))

    table = struct(a=a.cast("bigint"), b=b.cast("bigint"), c=c.cast("bigint"), d=d.cast("bigint"))
    return _bound(_bound(_bound(table, swapped), peaks), phred)


def strand_bias(pileup: DataFrame, site: str, least: int = 17) -> DataFrame:
    """site and fs: the larger exact phred of two tables of alleles and strands, of all reads and of those whose base and mapping quality are at least least."""
    cell = lambda alt, rev, ok: F.count_if((F.col("is_alt") == alt) & (F.col("is_reverse") == rev) & ok)
    sure = (F.col("base_qual") >= least) & (F.col("map_qual") >= least)
    corners = [(False, False), (False, True), (True, False), (True, True)]
    counts = pileup.groupBy(site).agg(*[cell(x, y, ok).alias(f"{name}{k}") for name, ok in (("n", F.lit(True)), ("q", sure)) for k, (x, y) in enumerate(corners)])
    return counts.select(site, F.greatest(*[fisher_phred(*[F.col(f"{name}{k}") for k in range(4)]) for name in ("n", "q")]).alias("fs"))


def lower_tail(z: Column) -> Column:
    """The probability that a normal variable lies below z, to some 1e-7."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * series
    return F.when(z < 0, upper).otherwise(1 - upper)


def probable_genotypes(pileup: DataFrame, site: str) -> DataFrame:
    """site, three ratios of log10 likelihoods (each genotype to the likelier of the others) and the three negated likelihoods, for alternate shares of 0, 1/2 and 1.

    pileup: base_qual, matches_ref; a read that matches has, at share v of the reference, the chance v (1 - e) + (1 - v) e for an error rate e.
    """
    e = F.pow(F.lit(10.0), -F.col("base_qual") / 10.0)
    chance = lambda v: v * (1 - e) + (1 - v) * e
    log = lambda v: F.sum(F.log10(F.when(F.col("matches_ref"), chance(v)).otherwise(1 - chance(v))))
    sums = pileup.groupBy(site).agg(log(1.0).alias("hom_ref"), log(0.5).alias("het"), log(0.0).alias("hom_var"))
    ratio = lambda own, *others: (F.col(own) - F.greatest(*others)).alias(f"{own}_ratio")
    return sums.select(site, ratio("hom_ref", "het", "hom_var"), ratio("het", "hom_ref", "hom_var"), ratio("hom_var", "hom_ref", "het"), *[(-F.col(n)).alias(n) for n in ("hom_ref", "het", "hom_var")])


def neighbour_quality(pileup: DataFrame, site: str, flank: int = 5) -> DataFrame:
    """site and nbq: the mean base quality from flank bases before to flank - 1 after the place in the reads that have the alternate there; 0 without any.

    pileup: offset (from 0, along the read as sequenced), quals (array, likewise), supports_alt.
    """
    near = F.filter(F.transform(F.sequence(F.col("offset") - flank, F.col("offset") + flank - 1), lambda k: F.when(k >= 0, F.get("quals", k.cast("int")))), lambda q: q.isNotNull())
    own = pileup.select(site, F.when(F.col("supports_alt"), near).otherwise(F.array().cast(pileup.schema["quals"].dataType)).alias("q"))
    sums = own.groupBy(site).agg(F.sum(F.aggregate("q", F.lit(0.0), lambda s, x: s + x)).alias("s"), F.sum(F.size("q")).alias("n"))
    return sums.select(site, F.round(F.when(F.col("n") > 0, F.col("s") / F.col("n")).otherwise(0.0), 2).alias("nbq"))


def balance_interval(df: DataFrame, site: str, ref_count: str, alt_count: str) -> DataFrame:
    """5, 50 and 95 percent points of the alternate share's posterior, over 101 steps; within the row, by array functions."""
    share = lambda k: F.greatest(F.lit(0.001), F.least(F.lit(0.999), k / 100))
    logs = F.transform(F.sequence(F.lit(0), F.lit(100)), lambda k: F.col(alt_count) * F.log10(share(k)) + F.col(ref_count) * F.log10(1 - share(k)))
    mass = df.withColumn("_l", logs).withColumn("_p", F.transform("_l", lambda x: F.pow(F.lit(10.0), x - F.array_max("_l"))))
    running = F.aggregate("_p", F.struct(F.lit(0.0).alias("s"), F.array().cast("array<double>").alias("all")), lambda a, x: F.struct((a["s"] + x).alias("s"), F.array_append(a["all"], a["s"] + x).alias("all")), lambda a: a["all"])
    upto = mass.withColumn("_c", running)
    point = lambda q: (F.size(F.filter("_c", lambda c: c < q * F.element_at("_c", -1))) / 100)
    return upto.select(site, point(0.05).alias("p5"), point(0.5).alias("p50"), point(0.95).alias("p95"))


TRANSITIONS = ["AG", "GA", "CT", "TC"]


def evaluation(df: DataFrame) -> DataFrame:
    """One row of counts over records (type, ref, alts, zygosity, novel): snps, transitions over transversions, het and hom calls, insertions, deletions and the share of novel ones."""
    alt = F.get("alts", F.lit(0))
    snp = F.col("type") == "SNP"
    ts = snp & F.concat("ref", alt).isin(TRANSITIONS)
    indel = F.col("type") == "INDEL"
    return df.agg(
        F.count_if(snp).alias("n_snps"), F.round(F.count_if(ts) / F.nullif(F.count_if(snp & ~ts), F.lit(0)), 6).alias("ti_tv"), F.count_if(F.col("zygosity") == "HET").alias("hets"), F.count_if(F.col("zygosity") == "HOM_VAR").alias("homs"),
        F.count_if(indel & (F.length(alt) > F.length("ref"))).alias("insertions"), F.count_if(indel & (F.length(alt) < F.length("ref"))).alias("deletions"), F.round(F.count_if(F.col("novel")) / F.nullif(F.count(F.lit(1)), F.lit(0)), 6).alias("novelty"),
    )


def available(df: DataFrame, names: list[str]) -> DataFrame:
    """name of the metrics that have any value, by one aggregation."""
    row = df.agg(*[F.max(F.col(n).isNotNull()).alias(n) for n in names])
    return row.select(F.explode(F.filter(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("any")) for n in names]), lambda x: x["any"])).alias("x")).select("x.name")


def choices(df: DataFrame, names: list[str]) -> DataFrame:
    """name and choices: the distinct values, sorted, of category metrics (arrays of text)."""
    each = df.select(F.explode(F.map_from_entries(F.array(*[F.struct(F.lit(n).alias("k"), F.col(n).alias("v")) for n in names]))).alias("name", "values"))
    return each.select("name", F.explode("values").alias("v")).groupBy("name").agg(F.array_sort(F.collect_set("v")).alias("choices"))


def score_frequencies(df: DataFrame, score: str = "qual", width: float = 1.0) -> DataFrame:
    """at and n: how many records have a score in each step of the given width; records without one don't count."""
    return df.where(F.col(score).isNotNull()).groupBy((F.floor(F.col(score) / width) * width).alias("at")).agg(F.count(F.lit(1)).alias("n"))
