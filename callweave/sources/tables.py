"""BED, reference sequence, sequence dictionary, annotation tables and configuration files."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """chr, start, end (1-based, inclusive), name, score, strand."""
    p = F.split("value", "\t")
    lines = spark.read.text(path).where(~F.col("value").rlike("^(track|browser|#)") & (F.length(F.trim("value")) > 0)).select(p.alias("p"))
    return lines.select(
        F.expr("p[0]").alias("chr"), F.expr("cast(p[1] as int) + 1").alias("start"), F.expr("cast(p[2] as int)").alias("end"), F.expr("try_element_at(p, 4)").alias("name"), F.expr("try_cast(try_element_at(p, 5) as double)").alias("score"), F.expr("try_element_at(p, 6)").alias("strand"),
    )


def bed_lines(df: DataFrame) -> DataFrame:
    return df.select(F.concat_ws("\t", "chr", (F.col("start") - 1).cast("string"), F.col("end").cast("string")).alias("value"))


def read_fai(spark: SparkSession, path: str) -> DataFrame:
    """contig, length and its place in the file, read in one task as the file is one line for each contig."""
    lines = spark.read.text(path, wholetext=True)
    rows = lines.select(F.posexplode(F.filter(F.split("value", "\n"), lambda x: x != "")).alias("place", "line"))
    return rows.select(F.split("line", "\t")[0].alias("contig"), F.split("line", "\t")[1].cast("int").alias("length"), "place")


def read_dict(spark: SparkSession, path: str) -> DataFrame:
    """contig, length and place of a sequence dictionary (.dict)."""
    lines = spark.read.text(path, wholetext=True)
    rows = lines.select(F.posexplode(F.filter(F.split("value", "\n"), lambda x: x.startswith("@SQ"))).alias("place", "line"))
    tag = lambda name: F.regexp_extract("line", f"\t{name}:([^\t]+)", 1)
    return rows.select(tag("SN").alias("contig"), tag("LN").cast("long").alias("length"), "place")


def dict_lines(fai: DataFrame) -> DataFrame:
    """The lines of the dictionary of an index's contigs."""
    return fai.orderBy("place").select(F.concat(F.lit("@SQ\tSN:"), "contig", F.lit("\tLN:"), F.col("length").cast("string")).alias("value"))


def read_fasta(spark: SparkSession, path: str, index: str) -> DataFrame:
    """contig, line_start (1-based), bases: a row for each line of the file, read as text and in splits, so no task holds a sequence.

    The index says which lines are whose: the lines before a contig's first are those of the contigs before and one header for each. Rows are numbered by
    the lines that stand before theirs in the file: counts by split, summed over splits, and the place within the split.
    """
    contigs = [r["value"].split("\t") for r in spark.read.text(index).where("value <> ''").collect()]  # a line for each contig
    rows, at = [], 0
    for name, length, _, per_line, _ in (c[:5] for c in contigs):
        n = -(-int(length) // int(per_line))
        rows.append((name, at + 1, at + n, int(per_line)))
        at += n + 1
    lines = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    counts = lines.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first"))  # a row for each split
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = lines.join(F.broadcast(before.select("block", "before", "first")), "block").withColumn("line", F.col("before") + F.col("row") - F.col("first"))
    named = spark.createDataFrame(rows, "contig string, lo long, hi long, per_line long")
    inside = numbered.join(F.broadcast(named), (F.col("line") >= F.col("lo")) & (F.col("line") <= F.col("hi")))
    return inside.select("contig", ((F.col("line") - F.col("lo")) * F.col("per_line") + 1).alias("line_start"), F.upper("value").alias("bases"))


def subsequence(reference: DataFrame, asked: DataFrame, chunk: int) -> DataFrame:
    """asked (key, contig, start, end) with seq: the bases there, or null outside the contig. reference: lines of chunk bases."""
    wanted = asked.withColumn("line_start", F.explode(F.expr(f"sequence(((start - 1) div {chunk}) * {chunk} + 1, ((end - 1) div {chunk}) * {chunk} + 1, {chunk})")))
    hit = wanted.join(reference, ["contig", "line_start"]).groupBy("key", "contig", "start", "end").agg(F.array_sort(F.collect_list(F.struct("line_start", "bases"))).alias("l"))
    seq = F.expr("substring(array_join(transform(l, x -> x.bases), ''), start - l[0].line_start + 1, end - start + 1)")
    got = hit.select("key", F.when(F.length(seq) == F.col("end") - F.col("start") + 1, seq).alias("seq"))
    return asked.join(got, "key", "left")


def read_commented(spark: SparkSession, path: str, least: int = 2) -> DataFrame:
    """Tab-separated annotation rows under a header that starts with >; comment and short rows are dropped."""
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.size(F.split("value", "\t")) >= least))
    head = lines.where(F.col("value").startswith(">")).first()
    names = head["value"][1:].split("\t") if head else []
    rows = lines.where(~F.col("value").startswith(">")).select(F.split("value", "\t").alias("p"))
    return rows.select(*[F.expr(f"try_element_at(p, {k + 1})").alias(n) for k, n in enumerate(names)])


def read_report(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Rows of one table of a report file, in which a table is a line #:GATKTable:<name>:..., a line of column names and rows up to an empty line. Columns are text."""
    lines = spark.read.text(path, wholetext=True)
    block = F.regexp_extract("value", rf"(?s)#:GATKTable:{table}:[^\n]*\n(.*?)(?:\n\s*\n|$)", 1)
    rows = lines.select(F.posexplode(F.filter(F.split(block, "\n"), lambda x: x != "")).alias("at", "line")).select("at", F.split(F.trim("line"), r"\s+").alias("p"))
    head = rows.where("at = 0").first()
    return rows.where("at > 0").select(*[F.expr(f"try_element_at(p, {k + 1})").alias(n) for k, n in enumerate(head["p"] if head else [])])


def joined_scores(tables: dict[str, DataFrame]) -> DataFrame:
    """chrom, pos and a score column for each technology (tables of chrom, pos, score), 100.0 where a technology has none: one grouping for any number of them."""
    every = None
    for name, t in tables.items():
        own = t.select("chrom", "pos", F.lit(name).alias("tech"), F.col("score").cast("double").alias("score"))
        every = own if every is None else every.unionByName(own)
    cols = [F.coalesce(F.max(F.when(F.col("tech") == n, F.col("score"))), F.lit(100.0)).alias(f"gms_{n}") for n in tables]
    return every.groupBy("chrom", "pos").agg(*cols)


def read_sanger(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start, ref, alts, val and group of the confirmed rows of a sheet of sequencing results, saved as CSV with its header."""
    from callweave.operators.filters import validation

    rows = spark.read.option("header", True).csv(path)
    val = validation(*(F.col(f"`{c}`") for c in ("forward validated", "reverse validated", "CE validation forward", "CE validation reverse", "vcf ref")))
    key = F.split("key", "_")
    return rows.select(key[0].alias("chrom"), key[1].cast("int").alias("start"), F.col("`vcf ref`").alias("ref"), F.split("vcf allele", ",").alias("alts"), val.alias("val"), F.col("set").alias("group")).where("val is not null")


def read_sqlite(spark: SparkSession, path: str, table: str, columns: list[str], rows: int = 100_000) -> DataFrame:
    """Columns of a table of a SQLite file that all tasks can open, as text, read in ranges of rowid."""
    import sqlite3

    with sqlite3.connect(path) as con:
        last = con.execute(f"select coalesce(max(rowid), 0) from {table}").fetchone()[0]
    query = f"select {', '.join(columns)} from {table} where rowid > ? and rowid <= ?"

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for lo in pdf["id"].tolist():
                with sqlite3.connect(path) as own:
                    found = own.execute(query, (lo, lo + rows)).fetchall()
                yield pd.DataFrame([[None if v is None else str(v) for v in r] for r in found], columns=columns)

    return spark.range(0, max(1, last), rows, max(1, -(-last // rows))).mapInPandas(run, ", ".join(f"{c} string" for c in columns))


CALL_KEYS = {"name", "file", "align", "ref", "type", "intervals", "metadata", "filters", "format-filters", "recall", "annotate", "normalize", "prep", "prep-sort-pos", "fix-sample-header", "prep-sv-genotype", "prep-allele-count", "preclean", "remove-refcalls", "make-haploid", "summary", "dir", "fp-freq", "platform"}
EXPERIMENT_KEYS = {"sample", "ref", "intervals", "exclude-intervals", "align", "summary-level", "params", "approach", "calls", "finalize"}


@dataclass
class Experiment:
    sample: str | None
    calls: list[dict[str, Any]]
    approach: str = "compare"
    params: dict[str, Any] = field(default_factory=dict)
    finalize: list[dict[str, Any]] = field(default_factory=list)
    rest: dict[str, Any] = field(default_factory=dict)


def load_config(path: str) -> list[Experiment]:
    """Experiments of a YAML file: keys checked, names unique, paths made absolute."""
    import yaml

    with open(path) as f:
        raw = yaml.safe_load(f)
    base = (raw.get("dir") or {}).get("base") or os.path.dirname(os.path.abspath(path))
    out = []
    for exp in raw.get("experiments", []):
        if odd := set(exp) - EXPERIMENT_KEYS:
            raise ValueError(f"unknown options of an experiment: {sorted(odd)}")
        names = [c.get("name") for c in exp.get("calls", [])]
        if len(names) != len(set(names)):
            raise ValueError(f"two calls share a name: {names}")
        calls = []
        for call in exp.get("calls", []):
            if odd := set(call) - CALL_KEYS:
                raise ValueError(f"unknown options of a call: {sorted(odd)}")
            absolute = lambda x: os.path.join(base, x) if isinstance(x, str) and not os.path.isabs(x) else x
            calls.append({k: ([absolute(x) for x in v] if isinstance(v, list) else absolute(v)) if k in ("file", "align", "intervals") else v for k, v in call.items()})
        out.append(Experiment(exp.get("sample"), calls, exp.get("approach", "compare"), exp.get("params") or {}, exp.get("finalize") or [], {k: v for k, v in exp.items() if k not in ("sample", "calls", "approach", "params", "finalize")}))
    return out
