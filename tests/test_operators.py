import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from callweave.functions import genotypes as G
from callweave.functions import sequence
from callweave.functions.sequence import left_align
from callweave.operators import filters, intervals, metrics, phasing, sizes, structural
from callweave.plans import catalog, record_queries  # noqa: F401
from callweave.sources import tables, vcf

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


def _rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    clean = lambda v: None if v is None or v != v else round(float(v), 5) if isinstance(v, float) else v if isinstance(v, (str, bool)) else int(v) if hasattr(v, "__int__") else v
    return sorted((tuple(clean(v) for v in r) for r in frame.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), con.execute(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_interval_algebra_against_positions(spark):
    rng = random.Random(4)
    make = lambda: [(rng.choice("xy"), s := rng.randint(1, 60), s + rng.randint(-1, 9)) for _ in range(25)]
    one, two = make(), make()
    a, b = (spark.createDataFrame(r, "contig string, start long, end long") for r in (one, two))
    cover = lambda rows: {(c, p) for c, s, e in rows for p in range(s, e + 1)}
    found = lambda df: cover([tuple(r) for r in df.select("contig", "start", "end").collect()])
    assert found(intervals.merged(a)) == cover(one)
    assert found(intervals.intersected(a, b)) == cover(one) & cover(two)
    assert found(intervals.subtracted(a, b)) == cover(one) - cover(two)
    pairs = sorted((x, y) for x in one for y in two if x[0] == y[0] and x[1] <= x[2] and y[1] <= y[2] and x[1] <= y[2] and y[1] <= x[2])
    got = sorted(((r[0], r[1], r[2]), (r[3], r[4], r[5])) for r in intervals.overlap_join(a, b, width=8).collect())
    assert got == pairs


def test_genotype_and_variant_classes(spark):
    row = spark.range(1).select(
        G.genotype_class(F.array(F.lit("A"), F.lit("A")), F.lit("A")), G.genotype_class(F.array(F.lit("A"), F.lit("C")), F.lit("A")), G.genotype_class(F.array(F.lit("C"), F.lit("C")), F.lit("A")), G.genotype_class(F.array(F.lit(None).cast("string"), F.lit("C")), F.lit("A")),
        G.variant_class(F.lit("A"), F.array(F.lit("C"))), G.variant_class(F.lit("AT"), F.array(F.lit("CG"))), G.variant_class(F.lit("A"), F.array(F.lit("AT"))), G.variant_class(F.lit("A"), F.array(F.lit("<DEL>"))), G.variant_class(F.lit("A"), F.array(F.lit("C"), F.lit("AT"))),
        F.round(G.call_likelihood(F.lit("HOM_VAR"), F.array(F.lit(5820), F.lit(645), F.lit(0))), 3), F.round(G.likelihood_ratio(F.lit("HOM_VAR"), F.array(F.lit(5820), F.lit(645), F.lit(0))), 3),
    ).first()
    assert list(row) == ["HOM_REF", "HET", "HOM_VAR", "MIXED", "SNP", "MNP", "INDEL", "SYMBOLIC", "MIXED", -582.0, 9.023]


def test_left_alignment():
    assert left_align("CAAA", "C", 5, "GGGTC") == (5, "CAAA", "C")
    assert left_align("ATA", "A", 6, "GCTATA") == (2, "CTA", "C")
    assert left_align("A", "C", 3, "GGA") == (3, "A", "C")


def test_vcf_and_bed(spark, tmp_path):
    (tmp_path / "a.vcf").write_text("##fileformat=VCFv4.1\n##INFO=<ID=DP,Number=1,Type=Integer,Description=\"Depth, all\">\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\nMT\t73\t.\tA\tG\t10.5\tPASS\t;DP=250;DB\tGT:AD:DP:GQ:PL\t1/1:0,250:250:99:5820,645,0\n")
    row = vcf.read_vcf(spark, str(tmp_path / "a.vcf"), "x").first()
    assert (row["chr"], row["start"], row["end"], row["type"], row["info"]["DP"], row["info"]["DB"]) == ("MT", 73, 73, "SNP", "250", "true")
    g = row["genotypes"][0]
    assert (g["sample"], g["gt_type"], g["ad"], g["pl"], g["gq"]) == ("S1", "HOM_VAR", [0, 250], [5820, 645, 0], 99)
    assert vcf.vcf_lines(vcf.read_vcf(spark, str(tmp_path / "a.vcf"))).first()["value"].startswith("MT\t73\t.\tA\tG\t10.5\tPASS\tDB;DP=250\tGT\t1/1")
    (tmp_path / "a.bed").write_text("track x\n22\t7\t27\tn\n")
    assert tuple(tables.read_bed(spark, str(tmp_path / "a.bed")).first())[:4] == ("22", 8, 27, "n")
    (tmp_path / "r.fa").write_text(">c1\nACGTA\nCG\n>c2\nTTT\n")
    (tmp_path / "r.fa.fai").write_text("c1\t7\t4\t5\t6\nc2\t3\t17\t5\t6\n")
    ref = tables.read_fasta(spark, str(tmp_path / "r.fa"), str(tmp_path / "r.fa.fai"))
    asked = spark.createDataFrame([(1, "c1", 4, 7), (2, "c2", 1, 3), (3, "c2", 2, 5)], "key int, contig string, start long, end long")
    assert {r["key"]: r["seq"] for r in tables.subsequence(ref, asked, 5).collect()} == {1: "TACG", 2: "TTT", 3: None}


def test_filters_and_rules(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 50.0), (3, None)], "id int, dp double").withColumn("filters", F.array().cast("array<string>"))
    assert {r["id"]: r["filters"] for r in filters.hard(df, ["dp < 10"]).collect()} == {1: ["dpFilter"], 2: [], 3: []}
    assert {r["id"]: r["filters"] for r in filters.by_format(df, ["dp < 10"]).collect()} == {1: ["FormatRanges"], 2: [], 3: ["FormatRanges"]}
    with pytest.raises(ValueError):
        filters.parsed("__import__('os')")


def test_phase_blocks_and_scores(spark):
    calls = spark.createDataFrame([("c", 1, 10, 10, "A", ["A", "G"]), ("c", 1, 20, 20, "C", ["C", "T"]), ("c", 1, 30, 30, "G", ["T", "G"]), ("c", 1, 40, 40, "G", ["A", "G"])], "contig string, block long, start long, end long, ref string, alleles array<string>")
    truth = spark.createDataFrame([("c", 10, 10, "A", "G"), ("c", 20, 20, "C", "T"), ("c", 30, 30, "G", "T"), ("c", 90, 90, "A", "C")], "contig string, start long, end long, ref string, allele string")
    assert {r["start"]: r["comparison"] for r in phasing.score(calls, truth).collect()} == {10: "concordant", 20: "concordant", 30: "phasing-error", 40: "ref-concordant", 90: "discordant"}


def test_structural_match_is_one_to_one(spark):
    cols = "contig string, id long, start long, end long, length long, type string, ci int"
    a = spark.createDataFrame([("c", 1, 100, 300, 200, "DEL", None), ("c", 2, 105, 300, 195, "DEL", None)], cols)
    b = spark.createDataFrame([("c", 7, 101, 301, 200, "DEL", 0), ("c", 8, 5000, 5200, 200, "DEL", 0)], cols)
    assert [tuple(r) for r in structural.matched(structural.with_bounds(a), structural.with_bounds(b)).collect()] == [("c", 1, 7)]


def test_fisher_against_sums(spark):
    from math import comb, log10

    for t in [(3, 1, 2, 6), (10, 0, 0, 10), (0, 0, 0, 0), (5, 5, 5, 5)]:
        a, b, c, d = t
        own = [comb(a + b, x) * comb(c + d, a + c - x) for x in range(max(0, a - d), min(a + b, a + c) + 1)]
        p = sum(v for v in own if v <= own[a - max(0, a - d)]) / comb(a + b + c + d, a + c)
        got = spark.range(1).select(metrics.fisher_phred(*[F.lit(v).cast("bigint") for v in t])).first()[0]
        assert got == pytest.approx(-10 * log10(p), abs=1e-5)


def test_fisher_of_a_strong_bias(spark):
    """A p below the least double has a phred too, and the work grows with the margin alone."""
    from math import lgamma, log

    n = 2000
    got = spark.range(1).select(metrics.fisher_phred(*[F.lit(v).cast("bigint") for v in (0, n, n, 0)])).first()[0]
    p = log(2) + 4 * lgamma(n + 1) - lgamma(2 * n + 1) - 2 * lgamma(n + 1)
    assert got == pytest.approx(-10 * p / log(10), rel=1e-9)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_letters_are_counted_by_key(spark):
    """Keys are dealt before their pairs are counted, by the letters there are; repeated keys count as one."""
    df = spark.createDataFrame([("a", "ABAB"), ("a", "AB"), ("b", "AAA"), ("c", "A"), ("d", None)], "k string, s string")
    got = sequence.dimer_entropy(df, "k", "s")
    plan = _plan(got)
    assert {r["k"]: round(r["entropy"], 6) for r in got.collect()} == {"a": 0.811278, "b": 0.0}
    assert plan.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in plan


@pytest.mark.parametrize("name", ["trusted_sites", "xspecific_sites", "consensus_vote"])
def test_lines_of_a_site_are_dealt_once(spark, name):
    """By a number of tasks that follows from the lines, where a session has too few partitions for them."""
    plan = _plan(catalog.QUERIES[name](spark, SF))
    assert plan.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in plan
    assert sizes.dealt(spark.range(10), "id", work=95, most=10).rdd.getNumPartitions() == 10


def test_bins_follow_the_lengths(spark):
    """Intervals of all lengths against all pairs; short ones alone meet in bins of 64."""
    rng = random.Random(5)
    make = lambda: [(rng.choice("xy"), s := rng.randint(1, 400_000), s + rng.choice([-1, 0, 5, 63, 64, 300, 5000, 300_000, 20_000_000])) for _ in range(60)]
    one, two = make(), make()
    a, b = (spark.createDataFrame(r, "contig string, start long, end long") for r in (one, two))
    good = [(x, y) for x in one for y in two if x[0] == y[0] and x[1] <= x[2] and y[1] <= y[2] and x[1] <= y[2] and y[1] <= x[2]]
    assert sorted(((r[0], r[1], r[2]), (r[3], r[4], r[5])) for r in intervals.overlap_join(a, b).collect()) == sorted(good)
    assert sorted(tuple(r) for r in intervals.overlap_join(a, b, how="left_anti").collect()) == sorted(x for x in one if not any(x == g for g, _ in good))
    assert intervals._widths(a.where("end - start < 64")) == [64]


def test_quantiles_are_exact_without_a_task_for_a_group(spark):
    """Against Spark's own over repeated, skewed and missing values; the plan has no exact percentile, which one task would hold."""
    rng = random.Random(6)
    rows = [("a", rng.gauss(0, 1)) for _ in range(6000)] + [("b", float(rng.randint(0, 3))) for _ in range(3000)] + [(None, 10 ** rng.uniform(-300, 300)) for _ in range(999)] + [("c", None), ("d", 5.0), ("d", 6.0)]
    df, shares = spark.createDataFrame(rows, "k string, v double"), [0.0, 0.05, 0.5, 0.95, 1.0]
    got = metrics.quantiles(df, ["k"], "v", shares)
    want = df.groupBy("k").agg(*[F.percentile("v", s).alias(f"q_{round(100 * s)}") for s in shares])
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert repr(metrics.quantiles(df, [], "v", shares).first()) == repr(df.agg(*[F.percentile("v", s).alias(f"q_{round(100 * s)}") for s in shares]).first())
    assert list(metrics.quantiles(df.where("false"), [], "v", [0.5]).first()) == [None]
    assert "percentile(" not in _plan(got)
