"""What a user runs: comparisons, ensembles, filters and metrics of call sets, from a configuration file or by name; python -m callweave.service <command> <arguments>."""

from __future__ import annotations

import json
import os
import sys
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.functions import attributes
from callweave.functions import genotypes as G
from callweave.operators import compare, filters, intervals, metrics, normalize, phasing, records
from callweave.sources import tables, vcf

SITE = ["chr", "start", "ref", "alleles"]
#: Steps after all pairs are compared, and ways to choose calls to validate, by the name that a configuration gives.
FINALIZERS: dict[str, Callable] = {}
VALIDATION: dict[str, Callable] = {}


def finalizer(name: str):
    def add(run: Callable) -> Callable:
        FINALIZERS[name] = run
        return run

    return add


def strategy(name: str):
    def add(run: Callable) -> Callable:
        VALIDATION[name] = run
        return run

    return add


def keyed(df: DataFrame) -> DataFrame:
    """Records with alleles, the sorted text of the first sample's alleles (the alternates where there are no samples), which with the site names a call."""
    own = F.when(F.size("genotypes") > 0, F.array_join(F.array_sort(F.array_compact(F.get("genotypes", F.lit(0))["alleles"])), "/")).otherwise(F.array_join(F.array_sort("alts"), "/"))
    return df.withColumn("alleles", own)


def read_call(spark: SparkSession, call: dict[str, Any], experiment: tables.Experiment) -> DataFrame:
    """The call set of a configuration's call: read, prepared and filtered as its options say, inside the experiment's regions if it has any."""
    files = call["file"] if isinstance(call["file"], list) else [call["file"]]
    df = None
    for path in files:
        own = vcf.read_vcf(spark, path, call["name"])
        df = own if df is None else df.unionByName(own)
    if call.get("preclean"):
        df = normalize.cleaned(df)
    if call.get("prep"):
        df = records.prepared(df, sample=experiment.sample, ploidy=call.get("prep-allele-count", 2), keep_reference=not call.get("remove-refcalls", False), structural=call.get("prep-sv-genotype", False))
    elif call.get("remove-refcalls"):
        df = normalize.without_no_calls(df, ("HOM_REF", "NO_CALL", "UNAVAILABLE"))
    if call.get("make-haploid"):
        df = records.haploid(df).drop("route")
    if call.get("normalize", True):
        df = records.normalised(df)
    if call.get("filters"):
        df = filters.hard(df, call["filters"], lambda name: attributes.value(name))
    if call.get("format-filters"):
        df = filters.by_format(df, call["format-filters"], lambda name: attributes.value(f"format {name}") if f"format {name}" in attributes.ATTRIBUTES else attributes.value(name))
    regions = call.get("intervals") or experiment.rest.get("intervals")
    if regions:
        inside = [tables.read_bed(spark, r).withColumnRenamed("chr", "contig") for r in (regions if isinstance(regions, list) else [regions])]
        df = intervals.callable_in(df.withColumnRenamed("chr", "contig"), inside, every=True).withColumnRenamed("contig", "chr")
    return df


def compared(one: DataFrame, two: DataFrame, approach: str = "exact") -> DataFrame:
    """Sites of two call sets with category (concordant, a_only, b_only): exactly, or by one of the flexible ways."""
    if approach == "exact":
        return compare.by_category(keyed(one), keyed(two), SITE, ["type"])
    as_set = lambda d: d.select(F.col("chr").alias("contig"), "start", "end", "ref", F.concat(F.array("ref"), "alts").alias("alleles"), "type", F.concat_ws(":", "start", "ref", F.array_join("alts", ",")).alias("id"))
    return compare.flexible(as_set(one), as_set(two), approach)


def summary(categories: DataFrame) -> DataFrame:
    """category and number of sites."""
    return categories.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def run_config(spark: SparkSession, path: str, out: str) -> dict[str, dict[tuple[str, str], DataFrame]]:
    """Runs the experiments of a configuration: every pair of call sets compared, finalizers after them. Writes parquet under out and a summary as CSV.

    Returns for each experiment (by sample) its comparisons by pair of names.
    """
    done = {}
    for exp in tables.load_config(path):
        calls = {c["name"]: read_call(spark, c, exp) for c in exp.calls}
        found = {}
        folder = os.path.join(out, str(exp.sample))
        for one, two in compare.pairs(list(calls)):
            target = f"{folder}/{one}-{two}"
            haploid = [records.is_haploid(calls[n]) for n in (one, two)]
            way = compare.route(*haploid, n_samples=1)[-1]
            cmp = phased(calls[one], calls[two], haploid, exp.approach) if way == "phased" else compared(calls[one], calls[two], exp.params.get("compare-approach", "exact"))
            cmp.write.mode("overwrite").partitionBy("category").parquet(target)
            found[one, two] = spark.read.parquet(target)
            summary(found[one, two]).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{target}-summary")  # a row for each category
        for step in exp.finalize:
            result = FINALIZERS[step["method"]](calls, found, step, exp)
            result.write.mode("overwrite").parquet(f"{folder}/{step['method']}")
        done[str(exp.sample)] = found
    return done


def phased(one: DataFrame, two: DataFrame, haploid: list[bool], approach: str) -> DataFrame:
    """Comparison of a diploid call set with a haploid one by phase blocks; category as in phasing.outputs()."""
    truth, calls = (one, two) if haploid[0] else (two, one)
    g = F.get("genotypes", F.lit(0))
    rows = calls.select(F.col("chr").alias("contig"), "start", "end", "ref", g["alleles"].alias("alleles"), g["phased"].alias("phased"))
    goes_on = (F.size("alleles") == 1) | F.col("phased") | (F.col("start") <= F.col("prev_end"))
    blocks = phasing.blocks(rows, "contig", ["start"], goes_on)
    known = truth.select(F.col("chr").alias("contig"), "start", "end", "ref", g["alleles"][0].alias("allele"))
    return phasing.outputs(phasing.score(blocks, known), approach == "grade").withColumnRenamed("output", "category")


def _target(step: dict[str, Any]) -> str:
    return step["target"][0] if isinstance(step["target"], list) else step["target"]


@finalizer("multiple")
def multiple(calls: dict[str, DataFrame], found: dict, step: dict, exp: tables.Experiment) -> DataFrame:
    """Verdicts (TP, FN, FP, other) of the target among all call sets but the ignored ones."""
    names = [n for n in calls if n not in step.get("ignore", [])]
    every = None
    for n in names:
        own = keyed(calls[n]).select("chr", "start", "ref", F.lit(n).alias("caller"), "alleles")
        every = own if every is None else every.unionByName(own)
    return compare.n_way(every, ["chr", "start", "ref"], "caller", "alleles", names, _target(step))


@finalizer("recal-filter")
def recalibrate(calls: dict[str, DataFrame], found: dict, step: dict, exp: tables.Experiment) -> DataFrame:
    """The target's calls with filters of classifiers that are trained on what its pair agrees on and what it alone has."""
    one, two = step["target"]
    params = step.get("params", {})
    return recalibrated(filters.without_filters(calls[one]), found[(one, two)] if (one, two) in found else compared(calls[one], calls[two]), params.get("classifiers", {"all": ["QUAL", "DP", "AD"]}), params.get("filters", []), params.get("classifier-type", "svm"))


def recalibrated(target: DataFrame, categories: DataFrame, classifiers: dict[str, list[str]], hard: list[str] = (), kind: str = "svm") -> DataFrame:
    """Calls with hard filters and then classifier filters; models are fitted to the concordant calls as good and the target's own as bad, by type and zygosity."""
    names = sorted({a for values in classifiers.values() for a in values})
    rows = filters.hard(keyed(target), list(hard), lambda name: attributes.value(name)).withColumns({f"_{n}": F.coalesce(attributes.value(n).cast("double"), F.lit(0.0)) for n in names})
    rows = rows.withColumn("group", metrics.classifier_group(F.col("type"), F.coalesce(F.get("genotypes", F.lit(0))["gt_type"], F.lit("HOM_VAR"))))
    told = rows.join(categories.where("category in ('concordant', 'a_only')").select(*SITE, "category"), SITE).withColumn("label", F.when(F.col("category") == "concordant", 0.0).otherwise(1.0))
    values = {k: [f"_{a}" for a in v] for k, v in classifiers.items()}
    models = metrics.group_models(told, values, "label", kind=kind)
    before = rows.withColumn("hard", F.col("filters"))
    out = metrics.scored_filter(before, models, values, "group", F.lit(False), F.lit(False))
    return out.withColumn("filters", F.array_union("hard", "filters")).drop("hard", "group", "alleles", *(f"_{n}" for n in names))


@strategy("top")
def top(df: DataFrame, step: dict) -> DataFrame:
    name, mod = step["top-metric"][0]["name"], step["top-metric"][0].get("mod", 1)
    return metrics.top_sites(df, ["chr", "start"], [F.desc(F.coalesce(attributes.value(name) * mod, F.lit(-1000.0))), F.col("chr"), F.col("start")], step["count"])


@strategy("random")
def at_random(df: DataFrame, step: dict) -> DataFrame:
    return metrics.random_rows(df, ["chr", "start"], step["count"])


@finalizer("validate")
def validate(calls: dict[str, DataFrame], found: dict, step: dict, exp: tables.Experiment) -> DataFrame:
    """The target's calls that pass, as final, and those of the others that a strategy chooses to validate: column destiny."""
    params = step.get("params", {})
    df = filters.hard(calls[_target(step)], params.get("filters", {}).get("keep", []), lambda name: attributes.value(name))
    rest = VALIDATION[params.get("validate", {}).get("approach", "top")](df.where(~filters.passes()), params["validate"])
    return df.where(filters.passes()).withColumn("destiny", F.lit("final")).unionByName(rest.withColumn("destiny", F.lit("validate")))


def ensemble(call_sets: dict[str, DataFrame], trusted_share: float = 0.65, priority: list[str] | None = None) -> DataFrame:
    """chr, start, ref, alleles, support and callers: the best supported call of each site, of as many call sets as the share asks for; ties by the order of names."""
    order = {n: k for k, n in enumerate(priority or list(call_sets))}
    every = None
    for name, df in call_sets.items():
        first = F.get("genotypes", F.lit(0))
        own = keyed(df).select("chr", "start", "ref", "alleles", F.lit(name).alias("caller"), F.coalesce(attributes.value("PL"), F.lit(0.0)).alias("likelihood"), (F.coalesce(first["gt_type"], F.lit("HOM_VAR")) == "HET").alias("het"), "info")
        every = own if every is None else every.unionByName(own)
    out = compare.merged_consensus(every, ["chr", "start", "ref"], "caller", "alleles", "likelihood", "het", "info", order)
    return out.where(F.col("support") >= trusted_share * len(call_sets))


def site_records(df: DataFrame, name: str, info: list[str]) -> DataFrame:
    """Sites (chr, start, ref, alts and further columns) as records without samples, with the named columns as info: of confirmed sequencing results, say, or of mappability scores."""
    entries = F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v")) for c in info])
    values = F.map_from_entries(F.filter(entries, lambda e: e["v"].isNotNull()))
    end = (F.col("start") + F.length("ref") - 1).cast("int")
    return df.select(
        F.lit(name).alias("fname"), "chr", F.col("start").cast("int").alias("start"), end.alias("end"), F.lit(None).cast("string").alias("id"), "ref", "alts", G.variant_class(F.col("ref"), F.col("alts")).alias("type"),
        F.lit(None).cast("double").alias("qual"), F.array().cast("array<string>").alias("filters"), values.alias("info"), F.lit(0).alias("num_samples"),
    )


def sequencing_records(spark: SparkSession, path: str) -> DataFrame:
    """The confirmed results of a sheet of sequencing as records."""
    rows = tables.read_sanger(spark, path).select(F.col("chrom").alias("chr"), "start", "ref", "alts", F.col("val").alias("valallele"), F.col("group").alias("valgroup"))
    return site_records(rows, "sequencing", ["valallele", "valgroup"])


def low_score_records(scores: dict[str, DataFrame], bases: DataFrame, least: float = 50.0) -> DataFrame:
    """Places whose score is low in any technology, as records with the scores as info. bases: chr, start, ref."""
    names = [f"gms_{n}" for n in scores]
    low = tables.joined_scores(scores).where(filters.low_mappability(F.array(*names), least)).select(F.col("chrom").alias("chr"), F.col("pos").alias("start"), *names)
    return site_records(low.join(bases, ["chr", "start"]).withColumn("alts", F.array().cast("array<string>")), "scores", names)


def prepared_folder(spark: SparkSession, folder: str, sample: str, order: list[str] | None = None) -> DataFrame:
    """All call files of a folder as one prepared call set of one sample, each record once; single bases, indels and structural variants often come in files of their own."""
    df = vcf.read_vcf(spark, folder, sample)
    df = normalize.renamed_contigs(df, order) if order else df
    return records.last_by_place(records.prepared(normalize.cleaned(df), sample=sample, structural=True), ["chr", "start", "ref", "alts"], ["qual"])


def background(call_sets: dict[str, DataFrame]) -> DataFrame:
    """Sites of several populations' call sets as one table: chr, start, ref, alts (of all) and callers."""
    every = None
    for name, df in call_sets.items():
        own = df.select("chr", "start", "ref", F.explode("alts").alias("alt"), F.lit(name).alias("caller"))
        every = own if every is None else every.unionByName(own)
    return every.groupBy("chr", "start", "ref").agg(F.array_sort(F.collect_set("alt")).alias("alts"), F.array_sort(F.collect_set("caller")).alias("callers"))


def check_headers(headers: dict[str, list[str]]) -> None:
    """Raises if call sets differ in their samples. headers: name to sample names."""
    if len({tuple(sorted(h)) for h in headers.values()}) > 1:
        raise ValueError(f"call sets of different samples: {headers}")


def metric_table(df: DataFrame, names: list[str]) -> DataFrame:
    """chr, start, ref and a column for each metric: what the index of a call set holds."""
    return df.select("chr", "start", "ref", *[attributes.value(n).alias(n) for n in names])


def plot_metrics(table: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """metric, bin, n and share: histograms over the stated ranges of the metrics that have values."""
    out = None
    have = [r["name"] for r in metrics.available(table, list(ranges)).collect()]  # a row for each metric
    for name in have:
        own = metrics.histogram(table, name, *ranges[name]).withColumn("metric", F.lit(name))
        out = own if out is None else out.unionByName(own)
    return out


def run_filter(df: DataFrame, ranges: dict) -> DataFrame:
    """Calls with the filter ManualRanges outside ranges of metrics, as a user of the service sets them."""
    names = list(ranges)
    rows = df.withColumns({f"_{n}": attributes.value(n) for n in names})
    return filters.in_ranges(rows, {f"_{n}": r for n, r in ranges.items()}).drop(*(f"_{n}" for n in names))


def score(one: DataFrame, truth: DataFrame, bases: int) -> dict[str, Any]:
    """Counts by category and the accuracy over so many bases, for an entry held against the truth."""
    found = compared(one, truth)
    errors = found.where("category <> 'concordant'").withColumn("kind", F.when(F.col("type") == "SNP", "snp").otherwise("indel")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    got = errors.withColumn("bases", F.lit(float(bases)))
    value = compare.accuracy(got, "kind", "n", "bases").first()["score"]
    return {"accuracy": 100.0 if value is None else value, **{r["category"]: r["n"] for r in summary(found).collect()}}


def score_report(found: dict[str, Any]) -> str:
    """A score as lines of tab-separated text."""
    return "\n".join(f"{k}\t{v}" for k, v in found.items())


def log_analysis(spark: SparkSession, path: str, row: dict[str, str]) -> None:
    """Appends a run (username, type, description, location) to the table of analyses."""
    spark.createDataFrame([row], ", ".join(f"{k} string" for k in row)).withColumn("created", F.current_timestamp()).write.mode("append").parquet(path)


def analyses(spark: SparkSession, path: str, username: str) -> DataFrame:
    """A user's runs, the latest first."""
    return spark.read.parquet(path).where(F.col("username") == username).orderBy(F.desc("created"))


def main(arguments: list[str]) -> int:
    """compare config.yaml out | prep in.vcf out | ensemble out in1 in2 ... | filter name in.vcf out | haploid in.vcf out | score in.vcf truth.vcf bases"""
    command, *rest = arguments
    spark = SparkSession.builder.getOrCreate()
    read = lambda path: vcf.read_vcf(spark, path)
    if command == "compare":
        run_config(spark, rest[0], rest[1])
    elif command == "prep":
        records.fully_prepared(read(rest[0])).write.parquet(rest[1])
    elif command == "ensemble":
        ensemble({os.path.basename(p): read(p) for p in rest[1:]}).write.parquet(rest[0])
    elif command == "filter":
        value = attributes.value
        drop = filters.CUSTOM[rest[0]](F.get("genotypes", F.lit(0))["gt_type"], dp=value("DP"), qual=value("QUAL"), ad=value("AD"), ratio=value("QR_QA"))
        filters.marked(read(rest[1]), ~drop, f"{rest[0].title()}Filter").write.parquet(rest[2])
    elif command == "haploid":
        records.haploid(read(rest[0])).write.parquet(rest[1])
    elif command == "score":
        print(json.dumps(score(read(rest[0]), read(rest[1]), int(rest[2]))))
    else:
        print(main.__doc__)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
