"""Registered queries: the operators over the star-schema tables, and their SQL.

Roles: a call is a line of an order (site), by its line number (caller), with flag and status as genotype; an interval is the 30 days from an order's date on its customer;
a point is a ship date on the order's customer; states along time are events by user.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callweave.functions import genotypes as G
from callweave.functions import sequence as S
from callweave.operators import compare, filters, intervals, metrics, normalize, phasing
from callweave.operators.sizes import dealt

#: Lines whose calls one task holds.
LINES = 500_000

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def calls(self) -> DataFrame:
        """A row for each call. Lines are dealt by site, so groupings by site and caller, and by site, need no further exchange."""
        line = dealt(self.lineitem, "l_orderkey", work=self.lineitem.count(), most=LINES)
        return line.groupBy(F.col("l_orderkey").alias("site"), F.col("l_linenumber").alias("caller")).agg(
            F.min(F.concat("l_returnflag", "l_linestatus")).alias("gt"), F.max("l_quantity").alias("qual"), F.max(F.col("l_extendedprice") / 1000).alias("depth"), F.max("l_discount").alias("disc"), F.max("l_tax").alias("tax")
        )

    def spans(self) -> DataFrame:
        day = F.datediff("o_orderdate", F.lit("1992-01-01").cast("date")).cast("long")
        return self.orders.groupBy(F.col("o_orderkey").alias("id")).agg(F.min("o_custkey").alias("contig"), F.min(day).alias("start")).withColumn("end", F.col("start") + 30)

    def points(self) -> DataFrame:
        owner = self.orders.groupBy(F.col("o_orderkey").alias("l_orderkey")).agg(F.min("o_custkey").alias("contig"))
        day = F.datediff("l_shipdate", F.lit("1992-01-01").cast("date")).cast("long")
        return self.lineitem.join(owner, "l_orderkey").select("contig", day.alias("start"), day.alias("end")).distinct()


_CALLS = "calls as (select l_orderkey as site, l_linenumber as caller, min(l_returnflag || l_linestatus) as gt, max(l_quantity) as qual, max(l_extendedprice / 1000) as depth, max(l_discount) as disc, max(l_tax) as tax from lineitem group by 1, 2)"
_SPANS = "spans as (select o_orderkey as id, min(o_custkey) as contig, min(date_diff('day', date '1992-01-01', cast(o_orderdate as date))) as start, min(date_diff('day', date '1992-01-01', cast(o_orderdate as date))) + 30 as fin from orders group by 1)"
_POINTS = "points as (select distinct contig, date_diff('day', date '1992-01-01', cast(l_shipdate as date)) as at from lineitem join (select o_orderkey, min(o_custkey) as contig from orders group by 1) on l_orderkey = o_orderkey)"


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _of(calls: DataFrame, caller: int) -> DataFrame:
    return calls.where(F.col("caller") == caller)


_PAIR = f"with {_CALLS}, a as (select site, gt from calls where caller = 1), b as (select site, gt from calls where caller = 2) "


@query(_PAIR + "select site, gt from a intersect select site, gt from b")
def concordance_exact(t):
    return compare.by_category(_of(t.calls(), 1), _of(t.calls(), 2), ["site", "gt"]).where("category = 'concordant'").drop("category")


@query(_PAIR + "select site, gt from a except select site, gt from b")
def discordance_a(t):
    return compare.by_category(_of(t.calls(), 1), _of(t.calls(), 2), ["site", "gt"]).where("category = 'a_only'").drop("category")


@query(_PAIR + "select site, gt from b except select site, gt from a")
def discordance_b(t):
    return compare.by_category(_of(t.calls(), 1), _of(t.calls(), 2), ["site", "gt"]).where("category = 'b_only'").drop("category")


@query(_PAIR + "select case when a.site is not null and b.site is not null then 'concordant' when a.site is not null then 'a_only' else 'b_only' end as category, count(*) as n from a full join b on a.site = b.site and a.gt = b.gt group by 1")
def category_counts(t):
    return compare.by_category(_of(t.calls(), 1), _of(t.calls(), 2), ["site", "gt"]).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_CALLS} select site, min(gt) = max(gt) as concordant, count(*) as n_calls from calls group by 1")
def split_by_match(t):
    return compare.split_by_match(t.calls(), ["site"], "gt")


@query(_PAIR + "select count(*) filter (where a.gt = b.gt) as concordant, count(*) filter (where a.gt <> b.gt) as discordant, round(100.0 * count(*) filter (where a.gt = b.gt) / count(*), 4) as percent from a join b using (site)")
def quickcompare_counts(t):
    return compare.quick(_of(t.calls(), 1), _of(t.calls(), 2), ["site"], "gt")


@query(f"with {_CALLS} select site, string_agg(cast(caller as varchar), '-' order by caller) as callers, count(*) as n_callers from calls group by 1")
def nway_provenance(t):
    return compare.provenance(t.calls(), ["site"], "caller").select("site", F.array_join(F.transform("callers", lambda c: c.cast("string")), "-").alias("callers"), F.col("n_callers").cast("long").alias("n_callers"))


@query(f"with {_CALLS} select site from calls group by 1 having count(*) = 7")
def nway_intersection(t):
    return compare.provenance(t.calls(), ["site"], "caller").where("n_callers = 7").select("site")


@query(f"with {_CALLS} select site, count(*) - 1 as others from calls group by 1 having count(*) filter (where caller = 3) > 0 and count(*) > 1")
def target_overlap(t):
    return compare.provenance(t.calls(), ["site"], "caller").where(F.array_contains("callers", 3) & (F.col("n_callers") > 1)).select("site", (F.col("n_callers") - 1).cast("long").alias("others"))


@query(f"with {_CALLS}, r as (select *, row_number() over (partition by site order by case caller when 4 then 0 when 2 then 1 when 1 then 2 else 9 end, caller) as k from calls) select site, gt, qual from r where k = 1")
def combine_priority(t):
    return compare.combined(t.calls(), ["site"], "caller", {4: 0, 2: 1, 1: 2}, ["gt", "qual"]).select("site", "gt", "qual")


_WIDE = f"with {_CALLS}, w as (select site, max(gt) filter (where caller = 1) as g1, max(gt) filter (where caller = 2) as g2, max(gt) filter (where caller = 3) as g3 from calls where caller in (1, 2, 3) group by 1) "


def _n_way(t, verdict):
    return compare.n_way(t.calls(), ["site"], "caller", "gt", [1, 2, 3], 3).where(F.col("verdict") == verdict).select("site")


@query(_WIDE + "select site from w where g1 = g2 and g1 = g3")
def true_positives(t):
    return _n_way(t, "TP")


@query(_WIDE + "select site from w where g1 = g2 and (g3 is null or g3 <> g1)")
def false_negatives(t):
    return _n_way(t, "FN")


@query(_WIDE + "select site from w where g3 is not null and g1 is distinct from g3 and g2 is distinct from g3 and not coalesce(g1 = g2, false)")
def false_positives(t):
    return _n_way(t, "FP")


@query(f"with {_CALLS} select site, count(*) - 1 as others from calls group by 1 having count(*) filter (where caller = 3) > 0 and count(*) - 1 <= ceil(0.4 * 6)")
def low_support_fp(t):
    return compare.low_support(t.calls(), ["site"], "caller", 3, 7).select("site", F.col("others").cast("long").alias("others"))


def _meta(t):
    return t.spark.range(1, 8).select(F.col("id").cast("int").alias("caller"), (F.col("id") % 2).alias("technology"), F.floor((F.col("id") - 1) / 3).alias("center"))


@query(f"with {_CALLS} select site from calls group by 1 having count(*) >= 5 or count(distinct (caller - 1) // 3) >= 0.65 * 3")
def trusted_sites(t):
    meta = _meta(t).withColumn("total", F.col("caller"))
    return compare.trusted(t.calls(), meta, ["site"], "caller", {"total": 5, "center": 0.65})


@query(f"with {_CALLS} select site, case when count(distinct caller % 2) = 1 then 'technology' else 'caller' end as kind from calls group by 1 having (count(distinct caller % 2) = 1 and count(distinct caller) > 1) or (count(distinct caller) = 1 and count(distinct caller % 2) > 1)")
def xspecific_sites(t):
    return compare.specific(t.calls(), _meta(t), ["site"], "caller", "technology")


_VOTE = "g as (select site, gt, count(distinct caller) as support, max(case when gt like 'N%' then 0 else 1 end) as hom, round(sum(qual), 6) as quality from calls group by 1, 2), v as (select *, row_number() over (partition by site order by support desc, hom desc, quality desc, gt) as k from g)"


def _voted(t):
    return compare.consensus(t.calls().withColumn("het", F.col("gt").startswith("N")), ["site"], "caller", "gt", "qual", "het")


@query(f"with {_CALLS}, {_VOTE} select site, gt, support, quality from v where k = 1")
def consensus_vote(t):
    return _voted(t)


@query("with c as (select l_suppkey, l_shipmode_, count(*) as n from (select l_suppkey, l_returnflag as l_shipmode_ from lineitem) group by 1, 2), r as (select *, row_number() over (partition by l_suppkey order by n desc, l_shipmode_) as k from c) select l_suppkey, l_shipmode_ as l_returnflag from r where k = 1")
def mode_tiebreak(t):
    return compare.most_frequent(t.lineitem, ["l_suppkey"], "l_returnflag")


_LISTS = f"with {_CALLS}, x as (select site, caller, list_value(substr(gt, 1, 1), substr(gt, 2, 1)) as al from calls) "


def _alleles(t):
    return t.calls().withColumn("al", F.array(F.substring("gt", 1, 1), F.substring("gt", 2, 1)))


@query(_LISTS + ", p as (select a.site, case when a.al = b.al then 'concordant' when a.al[1] = b.al[2] and a.al[2] = b.al[1] then 'phasing-mismatch' when list_has_any(a.al, b.al) then 'partial-mismatch' else 'discordant' end as kind from x a join x b on a.site = b.site and a.caller = 1 and b.caller = 2) select kind, count(*) as n from p group by 1")
def genotype_match_class(t):
    a, b = _of(_alleles(t), 1), _of(_alleles(t), 2).select("site", F.col("al").alias("bl"))
    return a.join(b, "site").select(G.match_class(F.col("al"), F.col("bl"), F.lit(True)).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(_LISTS + ", s as (select a.site, avg(case when b.al is null then 0.0 when a.al = b.al then 1.0 when list_has_any(a.al, b.al) then 0.5 else 0.0 end) as score from (select * from x where caller <= 3) a left join (select site, caller - 3 as caller, al from x where caller > 3 and caller <= 6) b on a.site = b.site and a.caller = b.caller group by 1) select site, round(score, 6) as score, score >= 1 as concordant from s")
def multi_sample_score(t):
    x = _alleles(t)
    b = x.where("caller > 3 and caller <= 6").withColumn("caller", (F.col("caller") - 3).cast("int"))
    return compare.sample_scores(x.where("caller <= 3"), b, ["site"], "caller", "al").select("site", F.round("score", 6).alias("score"), "concordant")


@query(_LISTS + "select a.site from x a join x b on a.site = b.site and a.caller = 1 and b.caller = 2 where list_has_any(a.al, b.al)")
def approx_allele_overlap(t):
    return compare.approximate(_of(_alleles(t), 1), _of(_alleles(t), 2), ["site"], "al").select("site")


@query(f"with {_SPANS}, {_POINTS} select count(*) as n, sum(s.id) as ids from spans s join points p on s.contig = p.contig and p.at between s.start and s.fin")
def interval_join_count(t):
    return intervals.overlap_join(t.spans(), t.points(), width=64).agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


@query(f"with {_SPANS}, {_POINTS} select id from spans s where exists (select 1 from points p where s.contig = p.contig and p.at between s.start and s.fin)")
def interval_semi(t):
    return intervals.callable_in(t.spans(), [t.points()]).select("id")


@query(f"with {_SPANS}, {_POINTS} select id from spans s where not exists (select 1 from points p where s.contig = p.contig and p.at between s.start and s.fin)")
def interval_anti(t):
    return intervals.overlap_join(t.spans(), t.points(), width=64, how="left_anti").select("id")


_MERGED = ", o as (select *, max(fin) over (partition by contig order by start, fin, id rows between unbounded preceding and 1 preceding) as before from spans), i as (select *, sum(case when before is null or start > before + 1 then 1 else 0 end) over (partition by contig order by start, fin, id rows unbounded preceding) as k from o), m as (select contig, min(start) as start, max(fin) as fin from i group by contig, k)"


@query(f'with {_SPANS}{_MERGED} select contig, start, fin as "end" from m')
def interval_merge(t):
    return intervals.merged(t.spans())


@query(f"with {_SPANS}{_MERGED} select sum(fin - start + 1)::bigint as bases from m")
def covered_bases(t):
    return intervals.covered(intervals.merged(t.spans()))


_DAYS = ", d as (select distinct contig, unnest(range(start, fin + 1)) as day, id % 2 as half from spans), x as (select contig, day, max(half) = 1 as odd, min(half) = 0 as even from d group by 1, 2)"


@query(f"with {_SPANS}{_DAYS} select count(*) as bases from x where odd and even")
def interval_intersect(t):
    s = t.spans()
    return intervals.covered(intervals.intersected(s.where("id % 2 = 1"), s.where("id % 2 = 0")))


@query(f"with {_SPANS}{_DAYS} select count(*) as bases from x where odd and not even")
def interval_subtract(t):
    s = t.spans()
    return intervals.covered(intervals.subtracted(s.where("id % 2 = 1"), s.where("id % 2 = 0")))


@query(f"with {_SPANS}, {{}} select count(*) as bases from (select contig, day from (select contig, id, unnest(range(start, fin + 1)) as day from spans) group by 1, 2 having count(*) >= 2)".replace(", {}", ""))
def callable_depth(t):
    return intervals.covered(intervals.deep_enough(t.spans(), 2))


@query(f"with {_SPANS}, p as (select a.id, b.id as id_b, least(a.fin, b.fin) - greatest(a.start, b.start) + 1 as shared from spans a join spans b on a.contig = b.contig and a.start <= b.fin and b.start <= a.fin and a.id % 2 = 0 and b.id % 2 = 1), r as (select *, row_number() over (partition by id order by shared desc, id_b) as k from p) select id, id_b, shared from r where k = 1")
def best_interval_match(t):
    s = t.spans()
    return intervals.best_match(s.where("id % 2 = 0"), s.where("id % 2 = 1"), "id", "id").select("id", "id_b", "shared")


@query(f"with {_SPANS}, {_POINTS} select id, exists (select 1 from points p where s.contig = p.contig and p.at between s.start and s.fin)::int as flag from spans s")
def interval_flags(t):
    hit = intervals.overlap_join(t.spans(), t.points(), width=64, how="left_semi").select("id", F.lit(1).alias("flag"))
    return t.spans().select("id").join(hit, "id", "left").select("id", F.coalesce("flag", F.lit(0)).alias("flag"))


@query("select p_partkey, p_size, case when p_size <= 10 then 10 when p_size <= 20 then 100 when p_size <= 40 then 200 else 10 end as ci from part")
def default_ci_ladder(t):
    return t.part.select("p_partkey", "p_size", G.half_width(F.col("p_size"), [(10, 10), (20, 100), (40, 200)]).alias("ci"))


_TYPES = "case p_size % 5 when 0 then '<DEL>' when 1 then '<DUP:TANDEM>' when 2 then 'A]2:5]' when 3 then repeat('A', p_size * 3) else 'C' end"


@query(f"with v as (select p_partkey, p_size, {_TYPES} as alt from part) select p_partkey, case when alt like '%]%' then 'BND' when alt like '<DEL%' then 'DEL' when alt like '<DUP%' then 'DUP' when length(alt) - 1 > 100 then 'INS' end as sv from v")
def sv_type_case(t):
    v = t.part.select("p_partkey", F.expr(_TYPES).alias("alt"))
    return v.select("p_partkey", G.sv_type(F.lit("A"), F.col("alt"), F.create_map().cast("map<string,string>"), 100).alias("sv"))


_EVENTS = "ev as (select user_id, event_id, cast(floor(epoch(ts)) as bigint) as pos, event_type from events)"


@query(f"with {_EVENTS}, l as (select *, lag(pos) over (partition by user_id order by pos, event_id) as prev from ev), b as (select *, sum(case when prev is not null and pos - prev <= 86400 then 0 else 1 end) over (partition by user_id order by pos, event_id rows unbounded preceding) as block from l) select user_id, block::bigint as block, min(pos) as start, max(pos) as \"end\", count(*) as n from b group by 1, 2")
def phase_blocks(t):
    e = t.events.select("user_id", "event_id", F.unix_timestamp("ts").alias("start"), F.unix_timestamp("ts").alias("end"))
    found = phasing.blocks(e, "user_id", ["start", "event_id"], F.col("start") - F.col("prev_end") <= 86400)
    return phasing.summary(found, "user_id").select("user_id", F.col("block").cast("long").alias("block"), "start", "end", "n")


@query(f"with {_SPANS}{_MERGED}, {_POINTS} select p.contig, p.at from points p where not exists (select 1 from m where m.contig = p.contig and p.at between m.start and m.fin)")
def inter_block_missing(t):
    return phasing.between(intervals.merged(t.spans()), t.points(), "contig").select("contig", F.col("start").alias("at"))


@query(f"with {_CALLS} select site, caller, concat_ws(';', case when depth < 5 then 'depthFilter' end, case when qual < 20 then 'qualFilter' end) as filters from calls")
def soft_filter_names(t):
    out = filters.hard(t.calls().withColumn("filters", F.array().cast("array<string>")), ["qual < 20", "depth < 5"])
    return out.select("site", "caller", F.array_join("filters", ";").alias("filters"))


@query(f"with {_CALLS} select count(*) as n from calls where not depth < 5 and not qual < 20")
def hard_filter(t):
    out = filters.hard(t.calls().withColumn("filters", F.array().cast("array<string>")), ["qual < 20", "depth < 5"])
    return out.where(filters.passes()).agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_CALLS} select site, caller, not coalesce(nullif(disc, 0.0) >= 0.02, false) as filtered from calls")
def format_filter_missing(t):
    c = t.calls().withColumns({"filters": F.array().cast("array<string>"), "d": F.nullif("disc", F.lit(0.0))})
    return filters.by_format(c, ["d < 0.02"]).select("site", "caller", (~filters.passes()).alias("filtered"))


@query(f"with {_CALLS} select site, caller from calls where qual between 10 and 30 and tax >= 0.02 and gt in ('AF', 'RF')")
def range_category_filter(t):
    return filters.in_ranges(t.calls(), {"qual": (10, 30), "tax": (0.02, None), "gt": {"AF", "RF"}, "caller": set()}, remove=True).select("site", "caller")


@query(f"with {_CALLS}, s as (select site, count(*) as n from calls group by 1) select c.site, caller from calls c join s using (site) where depth < 25 and n - 1 <= ceil(0.4 * 6) and not coalesce(disc > 0.035, false)")
def rule_yes_no(t):
    seen = compare.provenance(t.calls(), ["site"], "caller").select("site", "callers")
    c = t.calls().join(seen, "site").withColumns({"dp": F.col("depth"), "n_sets": F.lit(7), "ad": F.col("disc") * 10})
    return c.where(filters.checker(["low-depth", "below-call-support"], ["problem-allele-balance"])).select("site", "caller")


@query(f"with {_CALLS} select site, caller, case when gt like 'N%' then depth < 4 or (depth < 13 and qual < 20 and disc > 0.1 and tax * 1000 > 10) else (depth < 4 and qual < 50) or (depth < 13 and (disc > 0.1 or tax * 1000 > -90)) end as dropped from calls")
def custom_caller_filter(t):
    kind = F.when(F.col("gt").startswith("N"), "HET").otherwise("HOM_VAR")
    return t.calls().select("site", "caller", filters.freebayes_filter(kind, dp=F.col("depth"), qual=F.col("qual"), ad=F.col("disc"), ratio=F.col("tax") * 1000).alias("dropped"))


@query(f"with {_CALLS} select site, caller, round(abs(case when gt like 'N%' then 0.5 when gt like 'A%' then 1.0 else 0.0 end - depth / (depth + qual)), 6) as ad from calls where depth + qual > 0")
def attr_allele_deviation(t):
    kind = F.when(F.col("gt").startswith("N"), "HET").when(F.col("gt").startswith("A"), "HOM_VAR").otherwise("HOM_REF")
    return t.calls().select("site", "caller", F.round(G.allele_deviation(kind, F.col("qual"), F.col("depth")), 6).alias("ad"))


@query(f"with {_CALLS} select site, caller, round(case when qual > 0 and depth > 0 and greatest(disc / qual, tax / depth) > 0 then 100.0 * (disc / qual - tax / depth) / greatest(disc / qual, tax / depth) else 0.0 end, 6) as ratio from calls")
def attr_strand_ratio(t):
    return t.calls().select("site", "caller", F.round(G.strand_quality_ratio(F.col("disc"), F.col("tax"), F.col("qual"), F.col("depth")), 6).alias("ratio"))


@query(f"with {_CALLS} select site, caller, round((-qual / 10) / least(-1.0, -depth / 10), 6) as ratio from calls")
def attr_pl_ratio(t):
    pl = F.array(F.col("qual"), F.col("depth"), F.lit(0.0))
    return t.calls().select("site", "caller", F.round(G.likelihood_ratio(F.lit("HOM_VAR"), pl), 6).alias("ratio"))


@query("select l_returnflag, round(quantile_cont(l_extendedprice, 0.05), 4) as q_5, round(quantile_cont(l_extendedprice, 0.95), 4) as q_95 from lineitem group by 1")
def quantile_ranges(t):
    return metrics.quantiles(t.lineitem, ["l_returnflag"], "l_extendedprice", [0.05, 0.95]).select("l_returnflag", F.round("q_5", 4).alias("q_5"), F.round("q_95", 4).alias("q_95"))


@query("select round(quantile_cont(l_quantity, 0.0), 4) as q_0, round(quantile_cont(l_quantity, 0.25), 4) as q_25, round(quantile_cont(l_quantity, 0.5), 4) as q_50, round(quantile_cont(l_quantity, 0.75), 4) as q_75, round(quantile_cont(l_quantity, 1.0), 4) as q_100 from lineitem")
def summary_stats(t):
    out = metrics.quantiles(t.lineitem, [], "l_quantity", [0.0, 0.25, 0.5, 0.75, 1.0])
    return out.select(*[F.round(c, 4).alias(c) for c in out.columns])


@query("with q as (select quantile_cont(o_totalprice, 0.05) as a, quantile_cont(o_totalprice, 0.95) as b from orders) select o_orderkey, round(sum(least(1.0, greatest(0.0, (o_totalprice - a) / (b - a)))), 6) as scaled, round(sum(ln(o_totalprice)), 4) as logged from orders, q group by 1")
def minmax_and_log(t):
    return metrics.min_max(t.orders, "o_totalprice").groupBy("o_orderkey").agg(F.round(F.sum("o_totalprice_scaled"), 6).alias("scaled"), F.round(F.sum(F.ln("o_totalprice")), 4).alias("logged"))


@query("with b as (select least(99, greatest(0, floor(l_extendedprice / 500.0)))::int as bin, count(*) as n from lineitem group by 1) select bin, n, round(n / sum(n) over (), 8) as share from b")
def histogram_relfreq(t):
    return metrics.histogram(t.lineitem, "l_extendedprice", 0, 50_000).select("bin", "n", F.round("share", 8).alias("share"))


@query("with k as (select distinct o_custkey from (select o_custkey from orders order by o_totalprice desc, o_orderkey limit 20)) select o_custkey, count(*) as n, round(sum(o_totalprice), 2) as total from orders where o_custkey in (select o_custkey from k) group by 1")
def topk_then_sites(t):
    rows = metrics.top_sites(t.orders, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 20)
    return rows.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("select coalesce(l_returnflag, 'all') as kind, coalesce(l_linestatus, 'all') as status, count(*) as n from lineitem group by grouping sets ((l_returnflag, l_linestatus), (l_returnflag), ())")
def type_counts_rollup(t):
    out = t.lineitem.rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.coalesce("l_returnflag", F.lit("all")).alias("kind"), F.coalesce("l_linestatus", F.lit("all")).alias("status"), "n")


@query("select l_returnflag, metric, value from (select l_returnflag, count(*)::double as total, count(*) filter (where l_quantity < 10)::double as snp, count(*) filter (where l_quantity >= 40)::double as indel from lineitem group by 1) unpivot (value for metric in (total, snp, indel))")
def summary_long(t):
    wide = t.lineitem.groupBy("l_returnflag").agg(*[n.cast("double").alias(a) for a, n in (("total", F.count(F.lit(1))), ("snp", F.count_if(F.col("l_quantity") < 10)), ("indel", F.count_if(F.col("l_quantity") >= 40)))])
    return wide.unpivot("l_returnflag", ["total", "snp", "indel"], "metric", "value")


@query("select part, count(*) as n from (select unnest(string_split(p_type, ' ')) as part from part) group by 1")
def tally_by_part(t):
    return t.part.select(F.explode(F.split("p_type", " ")).alias("part")).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query("select round(100.0 * (1e7 - sum(case when l_returnflag = 'A' then 1 when l_returnflag = 'N' then 2 else 2 end * q)) / 1e7, 4) as score from (select l_returnflag, sum(l_quantity) as q from lineitem group by 1)")
def accuracy_score(t):
    kind = F.when(F.col("l_returnflag") == "A", "snp").when(F.col("l_returnflag") == "N", "indel").otherwise("sv")
    errors = t.lineitem.groupBy("l_returnflag").agg(F.sum("l_quantity").alias("q")).select(kind.alias("kind"), "q", F.lit(1e7).alias("bases"))
    return compare.accuracy(errors, "kind", "q", "bases")


@query(_LISTS + ", p as (select a.site, a.al, b.al as bl, b.site as there from x a left join x b on a.site = b.site and b.caller = 2 where a.caller = 1) select site, case when there is null then 'extra' when len(list_filter(al, lambda z: z <> 'N')) = 0 then 'missing' when list_has_any(list_filter(al, lambda z: z <> 'N'), list_filter(bl, lambda z: z <> 'N')) then 'hethom' else 'vardiff' end as grade from p")
def grade_categories(t):
    x = _alleles(t).withColumn("ref", F.lit("N"))
    return compare.grade(_of(x, 1), _of(x, 2).select("site", "al"), ["site"], "ref", "al").select("site", "grade")


@query(f"with {_CALLS} select case when coalesce(depth, 500) < 13 then 'low-coverage' when disc > 0.08 then 'error-prone' when tax > 0.06 then 'repeat' else 'other' end as reason, count(*) as n from calls group by 1")
def discordance_reasons(t):
    return t.calls().select(compare.reason(F.col("depth"), F.col("disc") > 0.08, F.col("tax") > 0.06).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("select s_suppkey, coalesce(f, 0.0) as freq from supplier left join (select l_suppkey, round(avg(l_discount), 6) as f from lineitem where l_discount > 0.05 group by 1) on s_suppkey = l_suppkey")
def left_join_defaults(t):
    freq = t.lineitem.where("l_discount > 0.05").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.round(F.avg("l_discount"), 6).alias("f"))
    return t.supplier.select("s_suppkey").join(freq, "s_suppkey", "left").select("s_suppkey", F.coalesce("f", F.lit(0.0)).alias("freq"))


def _names(t):
    return t.nation.where("n_nationkey < 15").select(F.col("n_nationkey").alias("old"), (F.col("n_nationkey") + 100).alias("new"))


@query("select c_custkey, c_nationkey + 100 as c_nationkey from customer where c_nationkey < 15")
def contig_remap(t):
    return normalize.remapped(t.customer, _names(t), "c_nationkey").select("c_custkey", "c_nationkey")


@query("select c_custkey from customer where c_nationkey >= 15")
def drop_unmapped(t):
    return normalize.unmapped(t.customer, _names(t), "c_nationkey").select("c_custkey")


@query("with v as (select p_partkey, replace(p_brand, '#', '') as ref, list_value(replace(p_brand, '#', ''), p_type) as alts from part) select p_partkey from part where p_partkey % 3 <> 0 and p_retailprice >= 0")
def clean_rows(t):
    alts = F.when(F.col("p_partkey") % 3 == 0, F.array(F.lit("C"), F.lit("A"))).otherwise(F.array(F.lit("C"), F.lit("G")))
    v = t.part.select("p_partkey", F.lit("A").alias("ref"), alts.alias("alts"), F.lit(None).cast("string").alias("id"), F.col("p_retailprice").alias("qual"))
    return normalize.cleaned(v).select("p_partkey")


_PAIRS = "m as (select a.p_partkey, a.p_brand as ref, b.p_brand as alt from part a join part b on b.p_partkey = a.p_partkey + 1)"


def _brands(t):
    b = t.part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_brand").alias("alt"))
    return t.part.select("p_partkey", F.col("p_brand").alias("ref")).join(b, "p_partkey").withColumn("start", F.lit(1))


@query(f"with {_PAIRS}, c as (select p_partkey, ref, alt, unnest(range(1, length(ref) + 1)) as i from m where length(ref) = length(alt)), d as (select p_partkey, i, substr(ref, i, 1) as r, substr(alt, i, 1) as a, i - row_number() over (partition by p_partkey order by i) as k from c where substr(ref, i, 1) <> substr(alt, i, 1)) select p_partkey, min(i) as start, string_agg(r, '' order by i) as ref, string_agg(a, '' order by i) as alt from d group by p_partkey, k")
def mnp_split(t):
    out = S.split_mnp(_brands(t).where(F.length("ref") == F.length("alt")))
    return out.select("p_partkey", F.col("start").cast("long").alias("start"), "ref", "alt")


@query(f"with {_PAIRS}, p as (select *, (select count(*) from range(1, least(length(ref), length(alt)) + 1) r(i) where substr(ref, 1, i) = substr(alt, 1, i)) as same from m) select p_partkey, greatest(same - 1, 0) + 1 as start, substr(ref, greatest(same - 1, 0) + 1) as ref, substr(alt, greatest(same - 1, 0) + 1) as alt from p")
def indel_prefix_strip(t):
    return S.strip_indel(_brands(t)).select("p_partkey", F.col("start").cast("long").alias("start"), "ref", "alt")


@query("with d as (select p_partkey, substr(p_name, i, 2) as pair from (select p_partkey, p_name, unnest(range(1, length(p_name))) as i from part)), c as (select p_partkey, pair, count(*) as n from d group by 1, 2), s as (select *, n / sum(n) over (partition by p_partkey) as p from c) select p_partkey, round(-sum(p * log2(p)), 6) as entropy from s group by 1")
def dimer_entropy(t):
    return S.dimer_entropy(t.part, "p_partkey", "p_name").select("p_partkey", F.round("entropy", 6).alias("entropy"))


@query("select p_partkey, round(100.0 * length(regexp_replace(upper(p_type), '[^GC]', '', 'g')) / nullif(length(regexp_replace(upper(p_type), '[^ACGT]', '', 'g')), 0), 6) as gc from part")
def gc_content(t):
    return t.part.select("p_partkey", F.round(S.gc_content(F.col("p_type")), 6).alias("gc"))


@query("select p_partkey, case when 4 + 3 <= length(p_type) then substr(p_type, 1, 7) end as window_bases from part")
def flank_window(t):
    return t.part.select("p_partkey", S.flank(F.col("p_type"), F.lit(4), 3).alias("window_bases"))


def _pileup(t):
    return t.lineitem.select(F.col("l_suppkey").alias("site"), F.col("l_quantity").alias("offset"), F.lit(60.0).alias("read_len"), (F.col("l_returnflag") == "A").alias("is_alt"), (F.col("l_linestatus") == "F").alias("is_reverse"))


@query("select l_suppkey as site, count(*) as depth, round(avg(l_quantity / 60), 6) as mean_pos, round(avg(case when l_quantity > 30 then 60 - l_quantity - 1 else l_quantity end), 6) as end_distance, count(*) filter (where l_returnflag = 'A' and l_linestatus = 'F') as alt_rev from lineitem group by 1")
def pileup_annotations(t):
    out = metrics.read_annotations(_pileup(t), "site")
    return out.select("site", "depth", F.round("mean_pos", 6).alias("mean_pos"), F.round("end_distance", 6).alias("end_distance"), "alt_rev")


@query("with r as (select l_suppkey as site, l_returnflag = 'A' as alt, rank() over w + (count(*) over (partition by l_suppkey, l_quantity) - 1) / 2.0 as rk from lineitem window w as (partition by l_suppkey order by l_quantity)), s as (select site, sum(rk) filter (where alt) as r, count(*) filter (where alt) as n1 from r group by 1 having count(*) filter (where alt) > 0 and count(*) filter (where not alt) > 0) select site, round(r - n1 * (n1 + 1) / 2.0, 4) as u from s")
def rank_sum_u(t):
    return metrics.rank_sum(t.lineitem.withColumn("alt", F.col("l_returnflag") == "A"), "l_suppkey", "l_quantity", "alt").select(F.col("l_suppkey").alias("site"), F.round("u", 4).alias("u"))


_TABLE = "t as (select o_custkey as site, count(*) filter (where o_orderstatus = 'F' and o_orderkey % 2 = 0) as a, count(*) filter (where o_orderstatus = 'F' and o_orderkey % 2 = 1) as b, count(*) filter (where o_orderstatus <> 'F' and o_orderkey % 2 = 0) as c, count(*) filter (where o_orderstatus <> 'F' and o_orderkey % 2 = 1) as d from orders group by 1)"
_LOG = "lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1)"
_ONE = "exp(k - lgamma({x} + 1) - lgamma(a + b - {x} + 1) - lgamma(a + c - {x} + 1) - lgamma(d - a + {x} + 1))"


@query(f"with {_TABLE}, l as (select *, {_LOG} as k, unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) as x from t), p as (select site, {_ONE.format(x='x')} as p, {_ONE.format(x='a')} as own from l) select site, round(-10 * log10(least(1.0, sum(p) filter (where p <= own * 1.0000001))), 4) + 0.0 as fs from p group by 1")
def fisher_phred(t):
    cell = lambda f, k: F.count_if(((F.col("o_orderstatus") == "F") == f) & (F.col("o_orderkey") % 2 == k))
    n = t.orders.groupBy(F.col("o_custkey").alias("site")).agg(cell(True, 0).alias("a"), cell(True, 1).alias("b"), cell(False, 0).alias("c"), cell(False, 1).alias("d"))
    return n.select("site", (F.round(metrics.fisher_phred(F.col("a"), F.col("b"), F.col("c"), F.col("d")), 4) + 0.0).alias("fs"))


@query("with n as (select l_suppkey as site, count(*) filter (where l_linenumber = 1) as alt, count(*) filter (where l_linenumber = 2) as ref from lineitem group by 1), s as (select *, k, greatest(0.001, least(0.999, k / 100)) as f from n, range(0, 101) r(k)), l as (select *, alt * log10(f) + ref * log10(1 - f) as l from s), m as (select *, pow(10.0, l - max(l) over (partition by site)) as p from l), u as (select *, sum(p) over (partition by site order by k rows unbounded preceding) / sum(p) over (partition by site) as c from m) select site, min(k) filter (where c >= 0.05) / 100 as p5, min(k) filter (where c >= 0.5) / 100 as p50, min(k) filter (where c >= 0.95) / 100 as p95 from u group by 1")
def allele_balance_ci(t):
    n = t.lineitem.groupBy(F.col("l_suppkey").alias("site")).agg(F.count_if(F.col("l_linenumber") == 1).alias("alt"), F.count_if(F.col("l_linenumber") == 2).alias("ref"))
    return metrics.balance_interval(n, "site", "ref", "alt")


@query(f"with {_CALLS} select site, round(avg(qual) filter (where gt not like 'R%'), 6) as mean_qual from calls group by 1")
def sample_means(t):
    return t.calls().groupBy("site").agg(F.round(F.avg(F.when(~F.col("gt").startswith("R"), F.col("qual"))), 6).alias("mean_qual"))


@query(f"with {_CALLS}, c as (select gt, count(*) as n from calls group by 1) select gt, n, row_number() over (order by n desc, gt) as place from c")
def culprit_counts(t):
    n = t.calls().groupBy("gt").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "gt")).cast("long"))  # a row for each genotype


@query(f"with {_CALLS} select site, 'p_' || (case when max(disc) > 0.05 then 'yes' else 'no' end) as public, max(disc) is not null as has_disc from calls group by 1")
def annotation_lookup(t):
    return t.calls().groupBy("site").agg(F.concat(F.lit("p_"), F.when(F.max("disc") > 0.05, "yes").otherwise("no")).alias("public"), F.max("disc").isNotNull().alias("has_disc"))


@query("select o_orderkey, min(o_totalprice) as o_totalprice from orders group by 1 order by md5(cast(o_orderkey as varchar)), o_orderkey limit 500")
def random_subset(t):
    return metrics.random_rows(t.orders.select("o_orderkey", "o_totalprice").dropDuplicates(["o_orderkey"]), ["o_orderkey"], 500)


@query(None)
def svm_scores(t):
    rows = t.lineitem.select(F.col("l_orderkey"), "l_quantity", "l_discount", "l_tax", (F.col("l_extendedprice") > 40_000).cast("double").alias("label"))
    values = ["l_quantity", "l_discount", "l_tax"]
    return metrics.classified(rows, metrics.classifier(rows, values, "label"), values).groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))


@query(None)
def kmeans_subsample(t):
    return metrics.cluster_sample(t.orders.select("o_orderkey", "o_totalprice"), "o_orderkey", ["o_totalprice"], 20)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Callers and consensus of each site, with the median quality of its genotype."""
    t = Tables(spark, sf_dir)
    middle = metrics.quantiles(t.calls(), ["gt"], "qual", [0.5])
    return _voted(t).join(compare.provenance(t.calls(), ["site"], "caller"), "site").join(middle, "gt").select("site", "gt", "support", "quality", "n_callers", "q_50")
