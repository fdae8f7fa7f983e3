"""Registered queries over whole variant records, which are made of orders: a record for each order, its contig and alleles by the customer, its genotype by the order's key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.functions import attributes
from callweave.functions import genotypes as G
from callweave.operators import compare, filters, intervals, metrics, normalize, phasing, records, structural
from callweave.plans.catalog import query
from callweave.sources import tables, vcf

_REC = (
    "rec as (select o_orderkey as id, 'chr' || cast(min(o_custkey) % 4 as varchar) as chr, cast(o_orderkey as bigint) as start, substr('ACGT', cast(1 + min(o_custkey) % 4 as int), 1) as r, substr('ACGT', cast(1 + (min(o_custkey) + 1 + o_orderkey % 3) % 4 as int), 1) as a, "
    "o_orderkey % 5 as k, o_orderkey % 7 as q, round(min(o_totalprice) / 1000, 3) as qual, cast(floor(min(o_totalprice)) as bigint) % 60 as dp from orders group by 1)"
)


def _base(t) -> DataFrame:
    rows = t.orders.groupBy(F.col("o_orderkey").alias("id")).agg(F.min("o_custkey").alias("c"), F.min("o_totalprice").alias("p"))
    letter = lambda n: F.substr(F.lit("ACGT"), (n % 4 + 1).cast("int"), F.lit(1))
    return rows.select(
        "id", F.concat(F.lit("chr"), (F.col("c") % 4).cast("string")).alias("chr"), F.col("id").cast("long").alias("start"), letter(F.col("c")).alias("ref"), letter(F.col("c") + 1 + F.col("id") % 3).alias("alt"),
        (F.col("id") % 5).alias("k"), (F.col("id") % 7).alias("q"), F.round(F.col("p") / 1000, 3).alias("qual"), (F.floor("p") % 60).cast("long").alias("dp"),
    )


def _records(t) -> DataFrame:
    """k, the last digit base 5 of the key, says the genotype: reference, heterozygous, homozygous, not called, haploid."""
    rows = _base(t)
    ref, alt, none = F.col("ref"), F.col("alt"), F.lit(None).cast("string")
    alleles = F.when(F.col("k") == 0, F.array(ref, ref)).when(F.col("k") == 1, F.array(ref, alt)).when(F.col("k") == 2, F.array(alt, alt)).when(F.col("k") == 3, F.array(none, none)).otherwise(F.array(alt))
    pl = F.array(*[((F.col("dp") * (j + 1) + F.col("q") * 10) % 99).cast("int") for j in range(3)])
    text = lambda c: c.cast("string")
    # depth stands in DP, AD or COV, or nowhere
    field = lambda name, value, when: F.when(when, F.struct(F.lit(name).alias("k"), value.alias("v")))
    yes = F.lit(True)
    attrs = F.map_from_entries(F.array_compact(F.array(
        field("DP", text(F.col("dp")), F.col("q") < 2), field("AD", F.concat_ws(",", text(F.col("dp")), text(F.col("q"))), F.col("q") < 4), field("COV", F.concat_ws(",", text(F.col("dp")), F.lit("1")), F.col("q") == 4),
        field("CM", text(F.col("q")), yes), field("CU", text(F.col("k")), yes),
    )))
    g = F.struct(F.lit("S1").alias("sample"), G.genotype_class(alleles, ref).alias("gt_type"), F.lit(False).alias("phased"), alleles.alias("alleles"), attrs.alias("attrs"), F.array(F.col("dp").cast("int"), F.col("q").cast("int")).alias("ad"), pl.alias("pl"), F.col("dp").cast("int").alias("dp"), F.lit(9).alias("gq"))
    info = F.map_from_arrays(F.array(F.lit("DP"), F.lit("END"), F.lit("set")), F.array(text(F.col("dp") + 1000), text(F.col("start")), F.when(F.col("k") == 0, "Intersection").when(F.col("k") == 1, "x-y").when(F.col("k") == 2, "filterIny-x").when(F.col("k") == 3, "FilteredInAll").otherwise("y")))
    return rows.select(
        F.lit("calls").alias("fname"), "chr", "start", F.col("start").alias("end"), F.when(F.col("q") > 2, text(F.col("id"))).alias("id"), "ref", F.array(alt).alias("alts"), F.lit("SNP").alias("type"), "qual", F.when(F.col("q") == 6, F.array(F.lit("LowQual"))).otherwise(F.array().cast("array<string>")).alias("filters"),
        info.alias("info"), F.lit(1).alias("num_samples"), F.array(g).alias("genotypes"),
    )


def _zygosity():
    return F.get("genotypes", F.lit(0))["gt_type"]


@query(f"with {_REC} select start, chr from rec where k in (1, 2) or k = 4 and r <> a")
def non_reference_records(t):
    return _records(t).where(filters.non_reference()).select("start", "chr")


@query(f"with {_REC} select start from rec where q <> 6")
def unfiltered_records(t):
    return _records(t).where(filters.passes()).select("start")


@query(f"with {_REC} select start from rec where k <> 4")
def diploid_records(t):
    return filters.diploid(_records(t)).select("start")


@query(f"with {_REC} select start from rec where k in (1, 2, 4)")
def records_of_sample(t):
    return filters.of_sample(_records(t), "S1", True).select("start")


@query(f"with {_REC} select start, dp < 100 and qual / 1000 > 0.05 as poor from rec")
def poor_support(t):
    return _base(t).select("start", filters.poor_support(F.col("dp"), F.col("qual") / 1000).alias("poor"))


@query("select l_orderkey, l_linenumber, (l_discount > 0 and l_discount < 0.03) or (l_tax > 0 and l_tax < 0.03) as low from lineitem")
def low_mappability(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", filters.low_mappability(F.array("l_discount", "l_tax"), 0.03).alias("low"))


@query(f"with {_REC} select start, case when k in (0, 1) then 'A' when k = 2 then 'T' when k = 3 and q = 0 then r end as allele from rec")
def sequencing_validation(t):
    k, q = F.col("k"), F.col("q")
    forward = F.when(k <= 1, "Pass_A").when(k == 2, "NA").when(k == 3, "Fail").otherwise("Pass_A")
    reverse = F.when(k == 0, "Pass_A").when(k == 1, "NA").when(k == 2, "Pass_T,x").when(k == 3, "Fail").otherwise("Fail")
    return _base(t).select("start", filters.validation(forward, reverse, F.when(q == 0, ".").otherwise("G"), F.lit("C"), F.col("ref")).alias("allele"))


def _ruled(t):
    rows = _base(t)
    return rows.select(
        "start", F.when(F.col("q") < 3, None).otherwise("rs1").alias("id"), F.when(F.col("q") == 1, "INDEL").otherwise("SNP").alias("type"), F.when(F.col("k") < 3, "HET").otherwise("HOM_VAR").alias("zygosity"), (-F.col("dp")).alias("pl"), (F.col("dp") / 60).alias("pl_ratio"),
        F.col("dp"), (F.col("q") * 12).alias("mq"), (F.col("k") / 10).alias("ad"), F.slice(F.array(F.lit("a"), F.lit("b"), F.lit("c"), F.lit("d")), 1, (F.col("k") % 4 + 1).cast("int")).alias("callers"), F.lit(4).alias("n_sets"), F.when(F.col("q") == 6, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("filters"),
    )


_RULED = f"with {_REC}, u as (select start, q < 3 as novel, q = 1 as indel, k < 3 as het, -dp as pl, dp / 60.0 as ratio, dp, q * 12 > 50 as mapped, k / 10.0 as ad, k % 4 as others, q = 6 as filtered from rec), v as (select *, (pl > -7.5 or ratio < 0.25) as lowc, others <= 2 as below, het and not indel as hets from u) "


@query(_RULED + "select 'fps' as which, 1 as turn, start from v where (below and mapped and hets and lowc) or (below and mapped and novel) or (below and mapped and lowc and not novel) union all select 'tps', 1, start from v where others = 3 and pl > -20 "
       "union all select 'tps', 2, start from v where ((below and not filtered and not ad > 0.35 and not (lowc and novel and hets)) or (below and hets and ratio > 0.4 and not ad > 0.35 and not novel)) and not (below and hets and novel and dp < 25) "
       "union all select 'fps', 2, start from v where ((below and mapped and filtered) or (below and mapped and hets and lowc and novel)) and not (below and hets and not novel and not dp < 25)")  # fmt: skip
def training_selection(t):
    rows, out = _ruled(t), None
    for which, turn in (("fps", 1), ("tps", 1), ("tps", 2), ("fps", 2)):
        own = filters.training(rows, which, turn).select(F.lit(which).alias("which"), F.lit(turn).alias("turn"), "start")
        out = own if out is None else out.unionByName(own)
    return out


@query(f"with {_REC} select start, cast(case when q < 2 then dp when q < 4 then dp + q when q = 4 then dp + 1 else dp + 1000 end as double) as depth from rec")
def attr_depth(t):
    return _records(t).select("start", attributes.value("DP").alias("depth"))


@query(f"with {_REC} select start, round(case when k = 3 or dp + q = 0 then null when k = 0 then q / (dp + q) when k = 1 and r <> a then abs(0.5 - q / (dp + q)) when r = a then q / (dp + q) else abs(1.0 - q / (dp + q)) end, 6) as ad from rec")
def attr_deviation_of_records(t):
    return _records(t).select("start", F.round(attributes.value("AD"), 6).alias("ad"))


@query(f"with {_REC} select start, round(case when q + k > 0 then q / (q + k) end, 6) as cm, cast(k as double) as cu from rec")
def attr_methylation(t):
    return _records(t).select("start", F.round(attributes.value("CM"), 6).alias("cm"), attributes.value("CU").alias("cu"))


@query(f"with {_REC} select start, dp + 1000.0 as info_dp, cast(null as double) as info_set, 2 as n_numbers from rec")
def attr_default(t):
    rows = _records(t)
    own = rows.withColumn("n", F.size(attributes.record_numbers()))
    return own.select("start", attributes.number(attributes.text("DP")).alias("info_dp"), attributes.value("set").alias("info_set"), F.col("n").alias("n_numbers"))


@query(f"with {_REC} select start, case k when 0 then 'x,y,z' when 1 then 'x,y' when 2 then 'x' when 3 then '' else 'y' end as callers, case k when 0 then 3 when 1 then 2 when 2 then 2 when 3 then 0 else 1 end as n from rec")
def set_provenance(t):
    return _records(t).select("start", F.array_join(attributes.set_callers(attributes.text("set"), ["z", "y", "x"]), ",").alias("callers"), attributes.n_sets(attributes.text("set"), 3).alias("n"))


@query("select p_partkey, coalesce(p_retailprice, 100.0) as gms, case when p_size % 2 = 1 then 'error-prone' else 'standard' end as cse, case when p_size % 3 = 0 then 'transition' else 'deletion' end as kind, case when p_size > 40 then 'a,b' when p_size > 20 then 'b' else 'unique' end as public from part")
def annotation_values(t):
    p = t.part
    size = F.col("p_size")
    return p.select(
        "p_partkey", attributes.annotation("gms_illumina", F.col("p_retailprice").cast("string")).alias("gms"), attributes.annotation("in_cse", (size % 2).cast("string")).alias("cse"), attributes.annotation("sub_type", F.when(size % 3 == 0, "ts").otherwise("del")).alias("kind"),
        F.array_join(attributes.public_names({"a": F.when(size > 40, 1), "b": F.when(size > 20, 1)}), ",").alias("public"),
    )


@query("select o_orderkey, abs(o_custkey) as first, 0 as second from orders")
def attr_list_number(t):
    raw = F.concat(F.lit("-"), F.col("o_custkey").cast("string"), F.lit(",x"))
    return t.orders.select("o_orderkey", attributes.list_number(raw).cast("long").alias("first"), attributes.list_number(raw, 1).alias("second"))


@query("select o_orderkey, case when o_orderkey % 2 = 0 then cast(o_custkey as varchar) end as mate from orders")
def breakend_contig(t):
    text = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("N["), F.col("o_custkey").cast("string"), F.lit(":17["))).otherwise("<DEL>")
    return t.orders.select("o_orderkey", attributes.contig_of(text).alias("mate"))


@query(f"with {_REC} select start, round(-least(case when k = 4 then 0.0 else 99.0 end, dp) / 10.0, 6) as pl, round(pow(10, -dp / 10.0), 9) as p, round(greatest(10 * log10(pow(10, -dp / 10.0)), -255), 6) as phred from rec")
def phred_and_probability(t):
    first = F.least(F.when(F.col("k") == 4, 0.0).otherwise(99.0), "dp")
    p = F.pow(F.lit(10.0), -F.col("dp") / 10.0)
    return _base(t).select("start", F.round(records.likelihood_map(F.array(first, F.lit(1)))["HOM_REF"], 6).alias("pl"), F.round(p, 9).alias("p"), F.round(G.phred_of_p(p), 6).alias("phred"))


@query(f"with {_REC} select start, case k when 0 then r || '/' || r when 1 then r || '/' || a when 2 then a || '/' || a when 3 then a || '/' || a else a end as gt from rec")
def structural_genotype(t):
    out = records.with_structural_genotype(_records(t))
    return out.select("start", F.array_join(F.get("genotypes", F.lit(0))["alleles"], "/").alias("gt"))


@query(f"with {_REC} select start, case k when 0 then r || '/' || r when 1 then r || '/' || a when 2 then a || '/' || a when 4 then a || '/' || a end as gt from rec where k <> 3")
def prepared_records(t):
    names = t.nation.select(F.concat(F.lit("chr"), F.col("n_nationkey").cast("string")).alias("old"), F.col("n_nationkey").cast("string").alias("new"))
    out = records.prepared(_records(t), names, "NEW", keep_reference=True).where("not map_contains_key(info, 'END')").where("genotypes[0].sample = 'NEW' and chr in ('0', '1', '2', '3')")
    return out.select("start", F.array_join(F.get("genotypes", F.lit(0))["alleles"], "/").alias("gt"))


@query(f"with {_REC} select start from rec where k in (1, 2, 4) and r <> a")
def cleaned_and_prepared(t):
    return records.fully_prepared(_records(t)).select("start")


@query(f"with {_REC} select start, r = a as same from rec")
def unchanged_records(t):
    return _records(t).select("start", records.unchanged(F.col("ref"), F.col("alts")).alias("same"))


_PL = f"with {_REC}, l as (select *, (dp + q * 10) % 99 as l0, (dp * 2 + q * 10) % 99 as l1, (dp * 3 + q * 10) % 99 as l2 from rec), p as (select *, pow(10, -l0 / 10.0) + pow(10, -l1 / 10.0) + pow(10, -l2 / 10.0) as s from l) "


@query(_PL + "select start, case when k = 0 then r when k in (2, 4) then a when k = 1 and r = a then r when k = 1 and (pow(10, -l2 / 10.0) / s > 1e-5 or pow(10, -l0 / 10.0) / s < 1e-20) then a end as allele, case when k = 4 then 'unchanged' else 'haploid' end as route from p")
def haploid_records(t):
    return records.haploid(_records(t)).select("start", F.get("genotypes", F.lit(0))["alleles"][0].alias("allele"), "route")


@query(_PL + "select start, round(pow(10, -l2 / 10.0) / s, 9) as hom_var from p where k = 1 and r <> a")
def het_likelihoods(t):
    return records.het_likelihoods(_records(t)).select("start", F.round("hom_var", 9).alias("hom_var"))


@query(f"with {_REC} select start, case when k = 3 and start % 1000 <= 500 then 'HOM_REF' when k = 3 then 'NO_CALL' when k = 0 then 'HOM_REF' when k = 1 and r <> a then 'HET' when r = a then 'HOM_REF' else 'HOM_VAR' end as kind, k = 3 and start % 1000 > 500 as filtered from rec")
def called_by_coverage(t):
    regions = _base(t).select("chr", (F.floor(F.col("start") / 1000) * 1000).alias("start")).distinct().withColumn("end", F.col("start") + 500)
    out = records.called_by_coverage(_records(t), regions)
    return out.select("start", _zygosity().alias("kind"), F.array_contains("filters", "NotCallable").alias("filtered"))


@query(f"with {_REC} select start, k = 3 and q = 1 as pl_kept, 3 - (case when q < 4 then 0 else 1 end) + (case when q < 2 then 1 else 0 end) - 1 as n from rec where k = 3 and q = 1")
def rebuilt_genotypes(t):
    out = records.rebuilt_genotypes(_records(t).where("start % 5 = 3 and start % 7 = 1"), ["DP", "AD", "PL"])
    return out.select("start", F.get("genotypes", F.lit(0))["pl"].isNotNull().alias("pl_kept"), (F.size(F.get("genotypes", F.lit(0))["attrs"]) + 1).alias("n"))


@query("with p as (select l_suppkey as site, l_returnflag as ref, l_linestatus as alt, count(*) as n from lineitem group by 1, 2, 3), o as (select *, row_number() over (partition by site order by n desc, length(ref), ref, alt) as k from p) select site, ref, alt from o where k = 1")
def frequent_alleles(t):
    calls = t.lineitem.select(F.col("l_suppkey").alias("site"), F.col("l_returnflag").alias("ref"), F.array("l_linestatus").alias("alts"))
    return records.most_frequent_alleles(calls, ["site"])


@query(f"with {_REC} select floor(start / 10000000) * 10000000 as block, count(*) as n from rec group by 1")
def ten_megabase_blocks(t):
    return _base(t).groupBy(records.block_of(F.col("start")).cast("double").alias("block")).agg(F.count(F.lit(1)).alias("n"))


@query("select o_custkey as contig, o_orderkey as id from orders where o_custkey in (select c_custkey from customer where c_nationkey < 5)")
def limited_regions(t):
    regions = t.orders.select(F.col("o_custkey").alias("chr"), F.col("o_orderkey").alias("id"))
    return records.limited_regions(regions, t.customer.where("c_nationkey < 5").select(F.col("c_custkey").alias("chr"))).select(F.col("chr").alias("contig"), "id")


_PIECES = "v as (select p_partkey, case p_partkey % 3 when 0 then 'ACG' when 1 then 'TAAAC' else 'GA' end as ref, case p_partkey % 3 when 0 then 'TCA' when 1 then 'TAAC' else 'GATT' end as alt from part)"


@query(f"with {_PIECES} select p_partkey, case when p_partkey % 3 = 0 then x - 1 else 0 end + case when p_partkey % 3 = 2 then 0 else 0 end as piece, 1000 + case when p_partkey % 3 = 0 then (x - 1) * 2 when p_partkey % 3 = 2 then 1 else 0 end as start, "
       "case when p_partkey % 3 = 0 then case when x = 1 then 'A' else 'G' end when p_partkey % 3 = 1 then 'TA' else 'A' end as ref, case when p_partkey % 3 = 0 then case when x = 1 then 'T' else 'A' end when p_partkey % 3 = 1 then 'T' else 'ATT' end as alt from v, range(1, 3) r(x) where x = 1 or p_partkey % 3 = 0")  # fmt: skip
def complex_split(t):
    """Two bases changed, a base of a run deleted, and two inserted: each record gives its simple variants."""
    kind = F.col("p_partkey") % 3
    pick = lambda x, y, z: F.when(kind == 0, x).when(kind == 1, y).otherwise(z)
    ref, alt = pick("ACG", "TAAAC", "GA"), pick("TCA", "TAAC", "GATT")
    rows = _records(t).limit(1).select("fname", "chr", "id", "qual", "filters", "info", "num_samples", "genotypes").crossJoin(t.part.select("p_partkey", ref.alias("ref"), F.array(alt).alias("alts")))  # one row on the left
    rows = rows.withColumns({"start": F.lit(1000).cast("long"), "end": F.lit(1000).cast("long"), "type": F.lit("MIXED")})
    rows = rows.withColumn("genotypes", F.transform("genotypes", lambda g: g.withField("alleles", F.array(F.col("ref"), F.get("alts", F.lit(0))))))
    out = records.split_complex(rows).where("genotypes[0].alleles[0] = ref and genotypes[0].alleles[1] = alts[0] and genotypes[0].phased = (piece > 0)")
    return out.select("p_partkey", F.col("piece").cast("long").alias("piece"), "start", "ref", F.get("alts", F.lit(0)).alias("alt"))


def _mates(t, n: int) -> DataFrame:
    """A call set: one in n records, moved or with other alleles by the order's key."""
    rows = _base(t).where(F.col("id") % n != 0)
    indel = F.col("q") < 3
    return rows.select(
        F.col("chr").alias("contig"), (F.col("start") + F.when(indel, F.col("k")).otherwise(0) * (n - 3)).alias("start"), "id", F.when(indel, F.concat("ref", F.lit("TTTT"))).otherwise(F.col("ref")).alias("ref"),
        F.when(indel, F.array(F.concat("ref", F.lit("TTTT")), "ref")).otherwise(F.array("ref", F.when(F.col("k") == n - 3, F.lit("N")).otherwise(F.col("alt")))).alias("alleles"), F.when(indel, "INDEL").otherwise("SNP").alias("type"),
    ).withColumn("end", F.col("start") + F.length("ref") - 1)


_MATE = "select chr as contig, start + case when q < 3 then k else 0 end * ({n} - 3) as start, id, case when q < 3 then r || 'TTTT' else r end as ref, case when q < 3 then 'INDEL' else 'SNP' end as type, r, case when k = {n} - 3 then 'N' else a end as a, start + case when q < 3 then k else 0 end * ({n} - 3) + case when q < 3 then 4 else 0 end as fin from rec where id % {n} <> 0"
_FLEX = (
    f"with {_REC}, x as ({_MATE.format(n=3)}), y as ({_MATE.format(n=4)}), m as (select x.contig, x.id, y.id as id_b, row_number() over (partition by y.contig, y.id order by x.start, x.id) as k from x join y on x.contig = y.contig and y.start between x.start and x.fin and x.type = y.type "
    "and (x.type = 'INDEL' and (length(x.ref) = 1) = (length(y.ref) = 1) or x.type = 'SNP' and x.start = y.start and x.ref = y.ref)), f as (select * from m where k = 1) "
)


@query(_FLEX + "select contig, id, case when id in (select id from f) then 'concordant' else 'a_only' end as category from x union all select contig, id, 'b_only' from y where id not in (select id_b from f)")
def flexible_compare(t):
    return compare.flexible(_mates(t, 3), _mates(t, 4))


@query(f"with {_REC}, x as ({_MATE.format(n=3)}), y as ({_MATE.format(n=4)}) select x.contig, x.id, y.id as id_b from x join y on x.contig = y.contig and y.start between x.start and x.fin and (length(x.ref) = 1) = (length(y.ref) = 1)")
def approx_indel(t):
    met = intervals.overlap_join(_mates(t, 3), _mates(t, 4)).where(compare.APPROACHES["approximate-indel"]())
    return met.select("contig", "id", "id_b")


@query(f"with {_REC}, h as (select chr, start, k, row_number() over (order by chr, start, r) as n from rec), z as (select count(*) = sum(case when k = 4 then 1 else 0 end) as hap from h where n <= 10) select case when hap then 'phased' else 'flexible' end as way, false as structural from z")
def compare_router(t):
    rows = _records(t)
    way = compare.route(records.is_haploid(rows), False, 2)
    return t.spark.createDataFrame([(way[-1], "structural" in way)], "way string, structural boolean")


_TWO = f"with {_REC}, x as (select start, r, a from rec where id % 3 <> 0), y as (select start, r, case when k = 1 then 'N' else a end as a from rec where id % 4 <> 0) "


def _two(t):
    rows = _base(t)
    one = rows.where("id % 3 <> 0").select("start", "ref", "alt")
    return one, rows.where("id % 4 <> 0").select("start", "ref", F.when(F.col("k") == 1, "N").otherwise(F.col("alt")).alias("alt"))


@query(_TWO + ", c as (select count(*) filter (where y.start is not null and x.start is not null) as c, count(*) filter (where y.start is null) as d1, count(*) filter (where x.start is null) as d2 from x full join y on x.start = y.start and x.r = y.r and x.a = y.a) select c as concordant, d1 as discordant1, d2 as discordant2, round(c / (c + d2), 6) as sensitivity from c")
def one_line_summary(t):
    return compare.call_summary(*_two(t), ["start", "ref", "alt"])


@query(_TWO + "select x.start, case when y.start is null then 'unique' when x.a = y.a then 'hethom' else 'shared' end as kind from x left join y using (start)")
def discordance_lookup(t):
    one, two = (d.withColumn("al", F.array("alt")) for d in _two(t))
    return compare.shared_discordant(one, two, ["start"], "al").select("start", "kind")


@query(_TWO + "select start from x intersect select start from y intersect select start from rec where q = 1")
def training_cases(t):
    return compare.training_cases([*_two(t), _base(t).where("q = 1")], ["start"])


@query("select o_orderkey, coalesce(f, 0.0) as af, coalesce(n, 0) as n from orders left join (select p_partkey as k, min(p_retailprice) as f, min(p_size) as n from part where p_size > 10 group by 1) on o_custkey = k")
def population_lookup(t):
    table = t.part.where("p_size > 10").select(F.col("p_partkey").alias("o_custkey"), F.col("p_retailprice").alias("af"), F.col("p_size").cast("long").alias("n"))
    return compare.with_lookup(t.orders.select("o_orderkey", "o_custkey"), table, ["o_custkey"], {"af": 0.0, "n": 0}).select("o_orderkey", "af", "n")


@query("select o_orderkey, coalesce(p_size, -1) as score from orders left join (select p_partkey + 1 as k, min(p_size) as p_size from part group by 1) on o_custkey = k")
def shifted_lookup(t):
    """A 0-based table, joined one place on."""
    table = t.part.select(F.col("p_partkey").alias("place"), F.col("p_size").alias("score"))
    calls = t.orders.select("o_orderkey", F.col("o_custkey").alias("place"))
    return compare.with_lookup(calls, table, ["place"], {"score": -1}, shift=1, place="place").select("o_orderkey", "score")


@query("select s_suppkey, coalesce(s_acctbal, c_acctbal) as s_acctbal, c_nationkey from supplier left join (select c_custkey, c_acctbal, c_nationkey from customer) on c_custkey = s_suppkey")
def combined_metrics(t):
    other = t.customer.select(F.col("c_custkey").alias("s_suppkey"), F.col("c_acctbal").alias("s_acctbal"), "c_nationkey")
    return compare.combined_metrics(t.supplier.select("s_suppkey", "s_acctbal"), other, ["s_suppkey"])


_SP = "sp as (select o_orderkey as id, min(o_custkey) as contig, min(date_diff('day', date '1992-01-01', cast(o_orderdate as date))) as start from orders group by 1)"


@query(f"with {_SP}, m as (select a.id, b.start, b.start + 5 as fin, case when b.id % 3 = 0 then 'f' else '' end as f, b.id % 2 = 0 as r, row_number() over (partition by a.id order by b.start, case when b.id % 3 = 0 then 'f' else '' end, b.id % 2 = 0) as k from sp a join sp b on a.contig = b.contig and b.id % 5 < 2 and a.start <= b.start + 5 and b.start <= a.start + 30) "
       "select sp.id, case when m.id is null then 'no-call' when f <> '' then f when r then 'ref-call' else 'pass' end as reason from sp left join m on sp.id = m.id and k = 1")  # fmt: skip
def truth_filters(t):
    truth = t.spans().where("id % 5 < 2").select("contig", "start", (F.col("start") + 5).alias("end"), F.when(F.col("id") % 3 == 0, F.array(F.lit("f"))).otherwise(F.array().cast("array<string>")).alias("filters"), (F.col("id") % 2 == 0).alias("reference"))
    return compare.truth_filter(t.spans(), truth, "id")


@query(f"with {_SP} select id from sp a where id % 2 = 0 and not exists (select 1 from sp b where b.id % 7 = 0 and b.contig = a.contig and a.start <= b.start + 30 and b.start <= a.start + 30) union all select id from sp where id % 7 = 0")
def merged_structural(t):
    return structural.merged_into(t.spans().where("id % 2 = 0"), t.spans().where("id % 7 = 0")).select("id")


@query(f"with {_SP}, m as (select a.id, b.id as id_b, row_number() over (partition by a.id order by b.start, b.id) as k from sp a join sp b on a.contig = b.contig and a.id <> b.id and a.start <= b.start + 30 and b.start <= a.start + 30) select id, id_b from m where k = 1")
def overlapping_structural(t):
    return structural.overlapping(t.spans(), "id")


@query(f"with {_SP} select cast(contig as varchar) as chr, greatest(1, start - 10) as start, start + case when id % 3 = 0 then 10 else 40 end as fin from sp where id % 3 <> 2")
def structural_bed(t):
    rows = t.spans().withColumn("contig", F.col("contig").cast("string")).withColumns({"length": F.lit(30), "ci": F.lit(None).cast("int"), "type": F.when(F.col("id") % 3 == 0, "INS").when(F.col("id") % 3 == 1, "DEL").otherwise("DUP")})
    out = structural.bed_regions(structural.with_bounds(rows))
    return out.select("chr", "start", F.col("end").alias("fin"))


@query(f"with {_SP}, p as (select *, start % 40 = 0 as del from sp) select id from p a where id % 2 = 1 and not exists (select 1 from p b where b.del and b.contig = a.contig and a.start between b.start and b.start + 30)")
def outside_deletions(t):
    others = t.spans().where("start % 40 = 0").withColumn("type", F.lit("DEL"))
    return structural.outside_deletions(t.spans().where("id % 2 = 1"), others).select("id")


@query(f"with {_REC} select case k when 0 then 'concordant' when 1 then 'concordant' when 2 then 'phasing-error' when 3 then 'discordant-missing' else 'discordant' end as output, count(*) as n from rec group by 1")
def phased_outputs(t):
    kind = F.when(F.col("k") == 0, "concordant").when(F.col("k") == 1, "ref-concordant").when(F.col("k") == 2, "phasing-error").otherwise("discordant")
    rows = _base(t).select(kind.alias("comparison"), (F.col("k") == 3).alias("known"), F.when(F.col("k") != 3, F.lit(1)).alias("block"))
    return phasing.outputs(rows, grade=True).groupBy("output").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_REC} select k as comparison, case when q = 0 then 'indel' else 'snp' end as kind, count(*) as n, count(distinct chr || '-' || cast(start % 9 as varchar)) as blocks from rec group by 1, 2")
def phasing_metrics(t):
    rows = _base(t).select(F.col("k").alias("comparison"), F.when(F.col("q") == 0, "indel").otherwise("snp").alias("kind"), F.col("chr").alias("contig"), (F.col("start") % 9).alias("block"))
    return phasing.metrics(rows)


@query(f"with {_REC} select chr, case when count(*) filter (where q = 0 or k = 4) > 0 then 'indel' when count(*) filter (where q = 1) = 0 then 'snp' else 'unknown' end as kind from rec group by 1")
def variant_kinds(t):
    types = _base(t).select("chr", F.when(F.col("q") == 0, "INDEL").when(F.col("q") == 1, "MNP").otherwise("SNP").alias("x"), F.when(F.col("k") == 4, "MIXED").alias("y"))
    return types.groupBy("chr").agg(phasing.variant_kind(["x", "y"]).alias("kind"))


@query(f"with {_REC} select count(*) as n_snps, round(count(*) filter (where r || a in ('AG', 'GA', 'CT', 'TC')) / nullif(count(*) filter (where r || a not in ('AG', 'GA', 'CT', 'TC')), 0), 6) as ti_tv, count(*) filter (where k = 1 and r <> a) as hets, count(*) filter (where k in (2, 4) and r <> a) as homs, 0 as insertions, 0 as deletions, round(count(*) filter (where q <= 2) / count(*), 6) as novelty from rec")
def evaluation_metrics(t):
    return metrics.evaluation(_records(t).select("type", "ref", "alts", _zygosity().alias("zygosity"), filters.RULES["novel"]().alias("novel")))


@query("select unnest(['o_custkey', 'o_totalprice']) as name")
def available_metrics(t):
    return metrics.available(t.orders.withColumn("none", F.lit(None).cast("int")), ["o_custkey", "none", "o_totalprice"])


@query("select 'flag' as name, string_agg(distinct l_returnflag, ',' order by l_returnflag) as choices from lineitem union all select 'both', string_agg(distinct v, ',' order by v) from (select l_linestatus as v from lineitem union all select l_returnflag from lineitem)")
def category_choices(t):
    rows = t.lineitem.select(F.array("l_returnflag").alias("flag"), F.array("l_linestatus", "l_returnflag").alias("both"))
    return metrics.choices(rows, ["flag", "both"]).select("name", F.array_join("choices", ",").alias("choices"))


@query("with w as (select l_suppkey as site, sum(log10(case when l_linenumber % 2 = 0 then 1 - pow(10, -l_quantity / 10) else pow(10, -l_quantity / 10) end)) as hr, sum(log10(0.5)) as he, sum(log10(case when l_linenumber % 2 = 0 then pow(10, -l_quantity / 10) else 1 - pow(10, -l_quantity / 10) end)) as hv from lineitem group by 1) "
       "select site, round(hr - greatest(he, hv), 4) as hom_ref_ratio, round(he - greatest(hr, hv), 4) as het_ratio, round(hv - greatest(hr, he), 4) as hom_var_ratio from w")  # fmt: skip
def probable_genotypes(t):
    reads = t.lineitem.select(F.col("l_suppkey").alias("site"), F.col("l_quantity").alias("base_qual"), (F.col("l_linenumber") % 2 == 0).alias("matches_ref"))
    return metrics.probable_genotypes(reads, "site").select("site", *[F.round(c, 4).alias(c) for c in ("hom_ref_ratio", "het_ratio", "hom_var_ratio")])


@query("with q as (select l_suppkey as site, case when l_linenumber = 1 then (l_quantity + l_tax * 100) end as s, case when l_linenumber = 1 then 2 else 0 end as n from lineitem) select site, round(case when sum(n) > 0 then sum(s) / sum(n) else 0 end, 2) as nbq from q group by 1")
def neighbour_quality(t):
    reads = t.lineitem.select(F.col("l_suppkey").alias("site"), F.lit(1).alias("offset"), F.array("l_quantity", F.round(F.col("l_tax") * 100)).alias("quals"), (F.col("l_linenumber") == 1).alias("supports_alt"))
    return metrics.neighbour_quality(reads, "site")


@query("with r as (select l_suppkey as site, l_returnflag = 'A' as alt, rank() over w + (count(*) over (partition by l_suppkey, l_quantity) - 1) / 2.0 as rk from lineitem window w as (partition by l_suppkey order by l_quantity)), s as (select site, sum(rk) filter (where alt) as r, count(*) filter (where alt) as n1, count(*) filter (where not alt) as n2 from r group by 1), "
       "z as (select site, (r - n1 * (n1 + 1) / 2.0 - n1 * n2 / 2.0) / sqrt(n1 * n2 * (n1 + n2 + 1) / 12.0) as z from s where n1 > 0 and n2 > 0) select site, round(z, 5) as z, z > 0 as right_side from z")  # fmt: skip
def rank_sum_side(t):
    out = metrics.rank_sum(t.lineitem.withColumn("alt", F.col("l_returnflag") == "A"), "l_suppkey", "l_quantity", "alt")
    return out.select(F.col("l_suppkey").alias("site"), F.round("z", 5).alias("z"), (metrics.lower_tail(F.col("z")) > 0.5 + 1e-9).alias("right_side"))


@query("select l_suppkey as site, count(*) as n, count(*) filter (where l_quantity >= 17 and l_linenumber >= 2) as sure from lineitem group by 1")
def strand_bias_inputs(t):
    reads = t.lineitem.select(F.col("l_suppkey").alias("site"), (F.col("l_returnflag") == "A").alias("is_alt"), (F.col("l_linestatus") == "F").alias("is_reverse"), F.col("l_quantity").alias("base_qual"), F.when(F.col("l_linenumber") >= 2, 60).otherwise(0).alias("map_qual"))
    bias = metrics.strand_bias(reads, "site").where("fs >= -1e-9").select("site")
    return reads.join(bias, "site").groupBy("site").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("base_qual") >= 17) & (F.col("map_qual") >= 17)).alias("sure"))


@query("select case when l_returnflag = 'A' then 'snp' else 'complex' end || case when l_linestatus = 'F' then '_het' else '_hom' end as kind, count(*) as n from lineitem group by 1")
def classifier_groups(t):
    kind = metrics.classifier_group(F.when(F.col("l_returnflag") == "A", "SNP").otherwise("INDEL"), F.when(F.col("l_linestatus") == "F", "HET").otherwise("HOM_VAR"))
    return t.lineitem.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("select l_orderkey, l_linenumber, l_linenumber = 2 or l_linenumber <> 1 and l_quantity > 25 as dropped from lineitem")
def classified_filters(t):
    """A linear model of a label that quantity alone decides; trusted calls pass, specific ones fail."""
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", (F.col("l_quantity") > 25).cast("double").alias("label"), F.lit("snp_hom").alias("group"))
    models = metrics.group_models(rows, {"q": ["l_quantity"]}, "label")
    out = metrics.scored_filter(rows, models, {"q": ["l_quantity"]}, "group", F.col("l_linenumber") == 1, F.col("l_linenumber") == 2)
    return out.select("l_orderkey", "l_linenumber", (F.size("filters") > 0).alias("dropped"))


@query("select o_orderkey from orders where cast('0x' || substr(md5(cast(o_orderkey as varchar)), 1, 8) as bigint) < 429496729 group by 1")
def random_share(t):
    return metrics.random_share(t.orders.select("o_orderkey").distinct(), ["o_orderkey"], 0.1)


@query("select l_suppkey as pos, max(l_discount) filter (where l_linenumber = 1) is null as first_missing, coalesce(max(l_discount) filter (where l_linenumber = 2), 100.0) as second from lineitem where l_linenumber in (1, 2) group by 1")
def technology_scores(t):
    own = lambda n: t.lineitem.where(F.col("l_linenumber") == n).select(F.lit("1").alias("chrom"), F.col("l_suppkey").alias("pos"), F.col("l_discount").alias("score"))
    out = tables.joined_scores({"first": own(1), "second": own(2)})
    return out.select("pos", (F.col("gms_first") == 100.0).alias("first_missing"), F.col("gms_second").alias("second"))


@query(f"with {_REC} select chr || chr(9) || cast(start as varchar) || chr(9) || '.' || chr(9) || r || chr(9) || a as head from rec where q <= 2")
def vcf_text(t):
    lines = vcf.vcf_lines(_records(t).where("id is null")).select(F.split("value", "\t").alias("p"))
    return lines.select(F.array_join(F.slice("p", 1, 5), "\t").alias("head"))


@query(f"with {_REC} select substr(chr, 4) || '|' || cast(start as varchar) as place, 'A_B=1' as info from rec where chr in ('chr1', 'chr2')")
def vcf_line_fixes(t):
    line = F.concat_ws("\t", "chr", F.col("start").cast("string"), F.lit("."), "ref", "alt", F.lit("9"), F.lit("PASS"), F.lit(";A B=1"))
    names = t.nation.where("n_nationkey in (1, 2)").select(F.concat(F.lit("chr"), F.col("n_nationkey").cast("string")).alias("old"), F.col("n_nationkey").cast("string").alias("new"))
    p = F.split("value", "\t")
    return vcf.with_genotypes(vcf.fixed_lines(_base(t).select(line.alias("value")), names)).where("value like '%\tGT\t1/1'").select(F.concat_ws("|", p[0], p[1]).alias("place"), p[7].alias("info"))


@query(f"with {_REC} select start, k <> 3 as called from rec where k <> 0")
def reference_and_no_calls(t):
    out = normalize.without_no_calls(_records(t), ("HOM_REF",)).where("start % 5 <> 0")
    return out.unionByName(_records(t).where("start % 5 <> 0 and genotypes[0].gt_type = 'HOM_REF'")).select("start", (_zygosity() != "NO_CALL").alias("called"))


@query(f"with {_REC} select start from rec where k <> 3")
def reference_calls(t):
    out = normalize.to_reference(_records(t).where("genotypes[0].gt_type <> 'NO_CALL'")).where("genotypes[0].gt_type = 'HOM_REF' and forall(genotypes[0].alleles, a -> a = ref)")
    return out.select("start")


@query("select o_orderkey, case when o_orderkey % 2 = 0 then 99 else 100 end as start, case when o_orderkey % 2 = 0 then 'GAT' else 'AT' end as ref, case when o_orderkey % 2 = 0 then 'GC' else 'ACC' end as alt from orders group by 1")
def padded_indels(t):
    rows = t.orders.select("o_orderkey").distinct().withColumns({"start": F.lit(100), "ref": F.lit("AT"), "alts": F.array(F.when(F.col("o_orderkey") % 2 == 0, "C").otherwise("ACC")), "before": F.lit("G")})
    return normalize.padded(rows).select("o_orderkey", "start", "ref", F.col("alts")[0].alias("alt"))


@query("select o_orderkey from orders where o_orderkey % 3 <> 1 group by 1")
def reference_agrees(t):
    rows = t.orders.select("o_orderkey").distinct().select("o_orderkey", F.col("o_orderkey").alias("key"), F.when(F.col("o_orderkey") % 3 == 2, "N").otherwise("A").alias("ref"))
    bases = rows.select("key", F.when(F.col("key") % 3 == 0, "A").otherwise("C").alias("seq"))
    return normalize.reference_agrees(rows, bases).select("o_orderkey")


@query("select o_orderkey, case when o_orderkey % 2 = 0 then 2 else 6 end as start from orders group by 1")
def left_aligned(t):
    even = F.col("o_orderkey") % 2 == 0
    rows = t.orders.select("o_orderkey").distinct().withColumns({"start": F.lit(6), "ref": F.when(even, "ATA").otherwise("C"), "alt": F.when(even, "A").otherwise("CG"), "before": F.when(even, "GCTATA").otherwise("TTTTAC")})
    return normalize.left_aligned(rows).select("o_orderkey", "start")


@query("select l_orderkey as site, case count(distinct l_linenumber) when 7 then 'Intersection' else string_agg(distinct cast(l_linenumber as varchar), '-' order by cast(l_linenumber as varchar)) end as label from lineitem group by 1")
def set_labels(t):
    rows = t.lineitem.groupBy(F.col("l_orderkey").alias("site")).agg(F.array_sort(F.collect_set(F.col("l_linenumber").cast("string"))).alias("callers"))
    return rows.select("site", compare.set_label(F.col("callers"), 7).alias("label"))


@query("select o_custkey as contig, count(*) as n from (select distinct o_custkey, o_orderkey from orders where o_orderkey % 2 = 0 and o_orderkey % 3 = 0) group by 1")
def shared_regions(t):
    region = lambda n: t.orders.where(F.col("o_orderkey") % n == 0).select(F.col("o_custkey").alias("contig"), (F.col("o_orderkey") * 10).alias("start"), (F.col("o_orderkey") * 10 + 3).alias("end")).distinct()
    return intervals.shared_by_all(region(2), region(3), region(1)).groupBy("contig").agg(F.count(F.lit(1)).alias("n"))


_VOTED = "v as (select l_suppkey as site, l_linenumber as caller, min(l_returnflag) as al, min(l_quantity) as pl from lineitem group by 1, 2), g as (select site, al, count(distinct caller) as n, max(case when al = 'A' then 0 else 1 end) as hom, round(sum(pl), 6) as s from v group by 1, 2), o as (select *, row_number() over (partition by site order by n desc, hom desc, s, al) as k from g)"


@query(f"with {_VOTED}, f as (select site, min(caller) as caller from v group by 1) select o.site, o.al, o.n as support, cast(f.caller as varchar) as first from o join f using (site) where k = 1")
def consensus_with_info(t):
    calls = t.lineitem.groupBy(F.col("l_suppkey").alias("site"), F.col("l_linenumber").alias("caller")).agg(F.min("l_returnflag").alias("al"), F.min("l_quantity").alias("pl"))
    calls = calls.withColumn("het", F.col("al") == "A").withColumn("info", F.create_map(F.lit("from"), F.col("caller").cast("string")))
    out = compare.merged_consensus(calls, ["site"], "caller", "al", "pl", "het", "info", {k: k for k in range(1, 8)})
    return out.select("site", "al", "support", F.col("info")["from"].alias("first"))


@query(f"with {_REC} select cast(floor(qual / 5) * 5 as double) as at, count(*) as n from rec group by 1")
def score_frequencies(t):
    out = metrics.score_frequencies(_base(t), "qual", 5.0)
    return out.select(F.col("at").cast("double").alias("at"), "n")


@query(f"with {_REC} select substr(chr, 4) as chr, count(*) as n from rec where chr <> 'chr0' group by 1")
def renamed_contigs(t):
    return normalize.renamed_contigs(_records(t), ["1", "2", "3", "GL000191.1"]).groupBy("chr").agg(F.count(F.lit(1)).alias("n"))
