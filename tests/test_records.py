import json
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from callweave import service
from callweave.functions.alignment import aligned, pieces
from callweave.operators import compare, intervals, metrics, normalize, records
from callweave.sources import files, tables, vcf

HEAD = '##fileformat=VCFv4.1\n##INFO=<ID=DP,Number=1,Type=Integer,Description="Depth">\n##contig=<ID=1>\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t{}\n'


def _vcf(path, sample, lines):
    path.write_text(HEAD.format(sample) + "".join("\t".join(x) + "\n" for x in lines))
    return str(path)


def _line(pos, ref, alt, gt, dp=50, qual="90", more=""):
    return ("1", str(pos), ".", ref, alt, qual, "PASS", f"DP={dp}{more}", "GT:AD:DP:PL", f"{gt}:.,7:{dp}:90,10,0")


def test_alignment_splits_spell_the_alternates():
    rng = random.Random(1)
    assert aligned("TAAAC", "TAAC") == ("TAAAC", "T-AAC")
    assert pieces("ACG", ["TCA"]) == [(0, ["A", "T"]), (2, ["G", "A"])] and pieces("TAAAC", ["TAAC"]) == [(0, ["TA", "T"])]
    for _ in range(300):
        ref, *alts = ["".join(rng.choice("ACGT") for _ in range(rng.randint(2, 12))) for _ in range(rng.randint(2, 3))]
        for k, alt in enumerate(alts):
            out, at = "", 0
            for offset, alleles in pieces(ref, alts):
                out, at = out + ref[at:offset] + alleles[k + 1], offset + len(alleles[0])
            assert out + ref[at:] == alt


def test_samples_are_named_by_file_and_missing_counts_stay(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("S1", "OTHER"):
        _vcf(tmp_path / "in" / f"{name}.vcf", name, [_line(10, "A", "G", "0/1")])
    rows = vcf.read_vcf(spark, str(tmp_path / "in")).collect()
    assert {(r["fname"], r["genotypes"][0]["sample"]) for r in rows} == {("S1.vcf", "S1"), ("OTHER.vcf", "OTHER")}
    assert rows[0]["genotypes"][0]["ad"] == [None, 7]
    assert {(r["fname"], r["sample"]) for r in vcf.samples(spark, str(tmp_path / "in")).collect()} == {("S1.vcf", "S1"), ("OTHER.vcf", "OTHER")}


def test_written_vcf_reads_back(spark, tmp_path):
    path = _vcf(tmp_path / "a.vcf", "S1", [_line(p, "A", "G", "0/1") for p in (30, 10, 20)] + [_line(40, "C", "CT", "1/1")])
    df = vcf.read_vcf(spark, path)
    head = vcf.header_lines(vcf.header(spark, path), ["S1"])
    assert vcf.repaired_header(["##INFO=<ID=X,Number=-1,Type=Float>"]) == ['##INFO=<ID=X,Number=.,Type=Float,Description="">']
    vcf.write_vcf(df, str(tmp_path / "out"), head)
    again = vcf.read_vcf(spark, str(tmp_path / "out"))
    key = lambda d: sorted((r["chr"], r["start"], r["ref"], r["alts"], r["genotypes"][0]["alleles"], r["genotypes"][0]["sample"]) for r in d.collect())
    assert key(again) == key(df)
    vcf.write_vcf(df.withColumn("kind", F.col("type")), str(tmp_path / "split"), head, category="kind")
    assert vcf.read_vcf(spark, str(tmp_path / "split" / "category=INDEL")).count() == 1
    vcf.write_index(df, str(tmp_path / "index"))
    assert [r["start"] for r in vcf.read_region(spark, str(tmp_path / "index"), "1", 15, 30).orderBy("start").collect()] == [20, 30]
    assert vcf.sites_only(df).first()["num_samples"] == 0 and vcf.per_sample(df).count() == 4


def test_semi_and_anti_joins_keep_rows_of_any_type(spark, tmp_path):
    df = vcf.read_vcf(spark, _vcf(tmp_path / "a.vcf", "S1", [_line(10, "A", "G", "0/1"), _line(10, "A", "G", "0/1"), _line(90, "A", "G", "0/1")])).withColumnRenamed("chr", "contig")
    near = spark.createDataFrame([("1", 5, 12), ("1", 8, 15)], "contig string, start int, end int")
    assert intervals.overlap_join(df, near, how="left_semi").count() == 2 and [r["start"] for r in intervals.overlap_join(df, near, how="left_anti").collect()] == [90]
    assert intervals.callable_in(df, [near, near]).count() == 2 and intervals.callable_in(df, [near, near], every=True).count() == 2


def test_intervals_across_blocks(spark):
    far = intervals.BLOCK
    a = spark.createDataFrame([("c", 5, 3 * far + 7), ("c", 3 * far + 8, 3 * far + 9), ("c", 9 * far, 9 * far + 1)], "contig string, start long, end long")
    assert [tuple(r)[1:] if r[0] == "c" else tuple(r) for r in intervals.merged(a).select("contig", "start", "end").orderBy("start").collect()] == [(5, 3 * far + 9), (9 * far, 9 * far + 1)]
    cut = spark.createDataFrame([("c", far, 2 * far)], "contig string, start long, end long")
    assert [tuple(r) for r in intervals.subtracted(a, cut).select("start", "end").orderBy("start").collect()] == [(5, far - 1), (2 * far + 1, 3 * far + 9), (9 * far, 9 * far + 1)]


def test_tables(spark, tmp_path):
    (tmp_path / "r.fa").write_text(">c1 x\nACGTA\nCG\n>c2\nTTT\n")
    (tmp_path / "r.fa.fai").write_text("c1\t7\t6\t5\t6\nc2\t3\t19\t5\t6\n")
    got = {(r["contig"], r["line_start"]): r["bases"] for r in tables.read_fasta(spark, str(tmp_path / "r.fa"), str(tmp_path / "r.fa.fai")).collect()}
    assert got == {("c1", 1): "ACGTA", ("c1", 6): "CG", ("c2", 1): "TTT"}
    (tmp_path / "r.dict").write_text("\n".join(r["value"] for r in tables.dict_lines(tables.read_fai(spark, str(tmp_path / "r.fa.fai"))).collect()) + "\n")
    assert [tuple(r)[:2] for r in tables.read_dict(spark, str(tmp_path / "r.dict")).orderBy("place").collect()] == [("c1", 7), ("c2", 3)]
    (tmp_path / "report.txt").write_text("#:GATKReport.v1.1:1\n#:GATKTable:Counts:x\nName  n\na  1\nb  2\n\n#:GATKTable:Other:y\nq\n1\n")
    assert [tuple(r) for r in tables.read_report(spark, str(tmp_path / "report.txt"), "Counts").collect()] == [("a", "1"), ("b", "2")]
    with sqlite3.connect(tmp_path / "x.db") as con:
        con.execute("create table m (contig text, n int)")
        con.executemany("insert into m values (?, ?)", [("c", k) for k in range(25)])
    assert tables.read_sqlite(spark, str(tmp_path / "x.db"), "m", ["contig", "n"], rows=10).count() == 25
    (tmp_path / "s.csv").write_text("key,vcf ref,vcf allele,set,forward validated,reverse validated,CE validation forward,CE validation reverse\n1_10,A,G,x,Pass_G,Pass_G,,\n1_11,A,G,x,Fail,Pass_G,,\n1_12,A,G,y,Fail,Fail,.,G\n")
    assert [(r["start"], r["val"]) for r in tables.read_sanger(spark, str(tmp_path / "s.csv")).orderBy("start").collect()] == [(10, "G"), (12, "A")]
    files.stored(spark, str(tmp_path / "s.csv"), str(tmp_path / "copy" / "s.csv"))
    assert [p.rsplit("/", 1)[1] for p in files.listed(spark, str(tmp_path / "copy"), ".csv")] == ["s.csv"]
    assert files.unique_names(["/a/x.vcf", "/b/x.vcf", "/c/y.vcf"]) == {"/a/x.vcf": "a-x.vcf", "/b/x.vcf": "b-x.vcf", "/c/y.vcf": "y.vcf"}


def test_configured_run(spark, tmp_path):
    one = _vcf(tmp_path / "one.vcf", "S", [_line(10, "A", "G", "0/1"), _line(20, "C", "T", "1/1"), _line(30, "G", "A", "0/1", dp=5), _line(50, "A", "T", "0/1", qual="3")])
    two = _vcf(tmp_path / "two.vcf", "S", [_line(10, "A", "G", "0/1"), _line(20, "C", "T", "0/1"), _line(40, "G", "A", "0/1")])
    three = _vcf(tmp_path / "three.vcf", "S", [_line(10, "A", "G", "0/1"), _line(40, "G", "A", "0/1")])
    calls = [{"name": n, "file": p} for n, p in (("one", one), ("two", two), ("three", three))]
    validate = {"method": "validate", "target": "one", "params": {"filters": {"keep": ["DP < 10", "QUAL < 10"]}, "validate": {"approach": "top", "count": 1, "top-metric": [{"name": "QUAL"}]}}}
    config = {"experiments": [{"sample": "S", "calls": calls, "finalize": [{"method": "multiple", "target": "one"}, validate, {"method": "recal-filter", "target": ["one", "two"], "params": {"classifiers": {"all": ["DP"]}}}]}]}
    (tmp_path / "c.yaml").write_text(json.dumps(config))
    found = service.run_config(spark, str(tmp_path / "c.yaml"), str(tmp_path / "out"))["S"]
    assert {r["category"]: r["n"] for r in service.summary(found["one", "two"]).collect()} == {"concordant": 1, "a_only": 3, "b_only": 2}
    verdicts = {(r["start"], r["verdict"]) for r in spark.read.parquet(str(tmp_path / "out/S/multiple")).collect()}
    assert {(10, "TP"), (40, "FN"), (30, "FP"), (50, "FP")} <= verdicts
    destiny = {r["start"]: r["destiny"] for r in spark.read.parquet(str(tmp_path / "out/S/validate")).collect()}
    assert destiny == {10: "final", 20: "final", 30: "validate"}
    assert spark.read.parquet(str(tmp_path / "out/S/recal-filter")).count() == 4
    read = {n: vcf.read_vcf(spark, p) for n, p in (("one", one), ("two", two), ("three", three))}
    best = {r["start"]: (r["alleles"], r["support"]) for r in service.ensemble(read).collect()}
    assert best == {10: ("A/G", 3), 40: ("A/G", 2)}
    assert service.score(read["one"], read["one"], 10)["accuracy"] == 100.0
    got = service.score(read["one"], read["two"], 100)
    assert got["accuracy"] == 95.0 and got["concordant"] == 1 and "accuracy\t95.0" in service.score_report(got)
    table = service.metric_table(read["one"], ["DP", "QUAL", "none"])
    assert {r["metric"] for r in service.plot_metrics(table, {"DP": (0, 100), "QUAL": (0, 100), "none": (0, 1)}).collect()} == {"DP", "QUAL"}
    assert [r["start"] for r in service.run_filter(read["one"], {"DP": (10, None)}).where("size(filters) > 0").collect()] == [30]
    with pytest.raises(ValueError):
        service.check_headers({"a": ["x"], "b": ["y"]})
    service.log_analysis(spark, str(tmp_path / "log"), {"username": "u", "type": "filter", "description": "d", "location": "l"})
    assert service.analyses(spark, str(tmp_path / "log"), "u").count() == 1


def test_prepared_sets_and_driver_helpers(spark, tmp_path):
    df = vcf.read_vcf(spark, _vcf(tmp_path / "a.vcf", "S1", [_line(5, "A", "G", "1"), _line(7, "CAAA", "C", "0/1"), _line(9, "ACG", "TCA,ACA", "1/2")]))
    assert not records.is_haploid(df) and records.is_haploid(df.where("start = 5"))
    assert records.best_reference(df, {"x": ["chr1"], "y": ["1"]}) == "y"
    out = records.normalised(df, spark.createDataFrame([("1", 7, "GTACAAAC")], "chr string, start int, before string"))
    assert sorted((r["start"], r["ref"], r["alts"]) for r in out.collect()) == [(5, "A", ["G"]), (7, "CAAA", ["C"]), (9, "A", ["T"]), (11, "G", ["A"])]
    assert [g["alleles"] for r in out.orderBy("start").collect()[2:] for g in r["genotypes"]] == [["T", "A"], ["A", "A"]]
    assert [r["start"] for r in records.sorted_regions(df.select("chr", "start", "end"), ["1"]).collect()] == [5, 7, 9]
    assert compare.pair_lookup({("a-recal", "b"): 1, ("a", "c"): 2}, ("c",)) == {("a", "b"): 1}
    assert metrics.interleaved([["a", "b"], ["c", "a", "d"]]) == ["a", "c", "b", "d"]
    assert records.split_samples([{"name": "n", "file": "f"}], {"f": ["x", "y"]}) == [{"name": "n-x", "file": "f", "sample": "x"}, {"name": "n-y", "file": "f", "sample": "y"}]
    two = df.withColumn("genotypes", F.concat("genotypes", F.transform("genotypes", lambda g: g.withField("sample", F.lit("B")))))
    assert [g["sample"] for g in records.ordered_samples(two, ["B"]).first()["genotypes"]] == ["B", "S1"]


def test_radial_features_and_ranking(spark):
    rng = random.Random(2)
    rows = [(x := rng.uniform(-2, 2), y := rng.uniform(-2, 2), rng.random(), float(x * x + y * y < 1.5)) for _ in range(400)]
    df = spark.createDataFrame(rows, "x double, y double, noise double, label double")
    wide, names = metrics.radial(df, ["x", "y"], 64, gamma=0.8)
    right = metrics.classified(wide, metrics.classifier(wide, names, "label", "svm-rbf"), names).where("prediction = label").count()
    assert right > 360
    assert metrics.feature_ranking(df.withColumn("label", (F.col("x") > 0).cast("double")), ["noise", "x", "y"], "label")[0] == "x"


def test_contig_names_of_either_style():
    order = ["1", "MT", "GL000191.1", "HSCHR6_MHC_COX", "HSCHR17_1"]
    names = ["chr1", "chrM", "chr1_gl000191_random", "chr6_cox_hap2", "chr17_ctg5_hap1", "chr99"]
    assert normalize.resolved(names, order) == dict(zip(names, order, strict=False))
    assert normalize.resolved(["GL000191.1", "1", "HSCHR6_MHC_COX"], ["chr1", "chr1_gl000191_random", "chr6_cox_hap2"]) == {"GL000191.1": "chr1_gl000191_random", "1": "chr1", "HSCHR6_MHC_COX": "chr6_cox_hap2"}


def test_records_of_other_tables(spark, tmp_path):
    (tmp_path / "s.csv").write_text("key,vcf ref,vcf allele,set,forward validated,reverse validated,CE validation forward,CE validation reverse\n1_10,A,G,x,Pass_G,Pass_G,,\n")
    assert [(r["start"], r["type"], r["info"]) for r in service.sequencing_records(spark, str(tmp_path / "s.csv")).collect()] == [(10, "SNP", {"valallele": "G", "valgroup": "x"})]
    score = lambda rows: spark.createDataFrame(rows, "chrom string, pos int, score double")
    low = service.low_score_records({"a": score([("1", 5, 30.0), ("1", 6, 90.0)]), "b": score([("1", 5, 80.0)])}, spark.createDataFrame([("1", 5, "A"), ("1", 6, "C")], "chr string, start int, ref string"))
    assert [(r["start"], r["info"]) for r in low.collect()] == [(5, {"gms_a": "30.0", "gms_b": "80.0"})]
    (tmp_path / "calls").mkdir()
    _vcf(tmp_path / "calls" / "snps.vcf", "S", [("chr1", *_line(5, "A", "G", "0/1")[1:])])
    _vcf(tmp_path / "calls" / "indels.vcf", "S", [("chr1", *_line(9, "A", "AT", "0/1")[1:]), ("chr1", *_line(5, "A", "G", "0/1")[1:])])
    got = service.prepared_folder(spark, str(tmp_path / "calls"), "N", ["1"])
    assert sorted((r["chr"], r["start"], r["genotypes"][0]["sample"]) for r in got.collect()) == [("1", 5, "N"), ("1", 9, "N")]
    assert [tuple(r) for r in service.background({"x": got, "y": got.where("start = 9")}).orderBy("start").collect()] == [("1", 5, "A", ["G"], ["x"]), ("1", 9, "A", ["AT"], ["x", "y"])]
