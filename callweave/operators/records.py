"""Whole records normalised: genotypes, ploidy, splitting of complex variants, preparation of a call set."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callweave.functions import genotypes as G
from callweave.functions.alignment import pieces
from callweave.operators import normalize
from callweave.operators.intervals import overlap_join


def unchanged(ref: Column, alts: Column) -> Column:
    """True where the alternates are the reference allele itself."""
    return (F.size(alts) == 1) & (alts[0] == ref)


def _typed(df: DataFrame) -> DataFrame:
    """Brings the genotypes' classes up to date."""
    return df.withColumn("genotypes", F.transform("genotypes", lambda g: g.withField("gt_type", G.genotype_class(g["alleles"], F.col("ref")))))


def with_structural_genotype(df: DataFrame, sample: str = "sample") -> DataFrame:
    """Rows without genotypes, or with one that isn't called, are homozygous for the first alternate; one that is half called is of its called alleles."""
    alt = F.get("alts", F.lit(0))
    def fixed(g):
        called = F.array_compact(g["alleles"])
        return g.withField("alleles", F.when(F.size(called) == 0, F.array(alt, alt)).when(F.size(called) < F.size(g["alleles"]), called).otherwise(g["alleles"]))

    empty = df.schema["genotypes"].dataType.elementType
    made = F.struct(*[(F.lit(sample) if f.name == "sample" else F.array(alt, alt) if f.name == "alleles" else F.lit(None)).cast(f.dataType).alias(f.name) for f in empty])
    out = df.withColumn("genotypes", F.when(F.size("genotypes") == 0, F.array(made)).otherwise(F.transform("genotypes", fixed)))
    return _typed(out.withColumn("num_samples", F.size("genotypes")))


def n_likelihoods(alleles: Column, ploidy: Column) -> Column:
    """Number of genotypes of so many alleles: the combinations with repetition."""
    top = alleles + ploidy - 1
    return F.when(ploidy == 1, alleles).when(ploidy == 2, alleles * (alleles + 1) / 2).otherwise(F.factorial(top.cast("int")) / (F.factorial(ploidy.cast("int")) * F.factorial((alleles - 1).cast("int")))).cast("long")


def rebuilt_genotypes(df: DataFrame, keep: list[str]) -> DataFrame:
    """Genotypes with the named attributes alone, and without likelihoods whose number doesn't fit the alleles."""
    fits = lambda g: F.size(g["pl"]) == n_likelihoods(F.size("alts") + 1, F.size(g["alleles"]))
    def fixed(g):
        return g.withField("attrs", F.map_filter(g["attrs"], lambda k, v: k.isin(keep) & ((k != "PL") | fits(g)))).withField("pl", F.when(fits(g), g["pl"]))

    return df.withColumn("genotypes", F.transform("genotypes", fixed))


def haploid(df: DataFrame) -> DataFrame:
    """Diploid genotypes as haploid ones: homozygous calls by their allele, heterozygous ones as the alternate where the likelihoods allow it, else no call.

    Adds route: haploid where a genotype changed, else unchanged.
    """
    def one(g):
        kind = G.haploid_call(g["gt_type"], F.col("type"), g["pl"])
        allele = F.when(g["gt_type"].isin("HOM_REF", "HOM_VAR"), g["alleles"][0]).when((g["gt_type"] == "HET") & (kind == "variant"), F.get(F.filter(g["alleles"], lambda a: a != F.col("ref")), F.lit(0)))
        return F.when(F.size(g["alleles"]) == 2, g.withField("alleles", F.array(allele))).otherwise(g)

    out = df.withColumn("route", F.when(F.exists("genotypes", lambda g: F.size(g["alleles"]) == 2), "haploid").otherwise("unchanged"))
    return _typed(out.withColumn("genotypes", F.transform("genotypes", one)))


def het_likelihoods(df: DataFrame) -> DataFrame:
    """chr, start and the probability of the homozygous alternate for heterozygous calls of the first sample."""
    g = F.get("genotypes", F.lit(0))
    return df.where((g["gt_type"] == "HET") & (F.size(g["pl"]) == 3)).select("chr", "start", G.probabilities(g["pl"])[2].alias("hom_var"))


def likelihood_map(pl: Column) -> Column:
    """Likelihoods by genotype class, as log10: of two values the homozygous ones, of more the three classes."""
    log = F.transform(pl, lambda x: -x / 10.0)
    two = F.map_from_arrays(F.lit(["HOM_REF", "HOM_VAR"]), F.slice(log, 1, 2))
    return F.when(F.size(pl) == 2, two).when(F.size(pl) > 2, F.map_from_arrays(F.lit(["HOM_REF", "HET", "HOM_VAR"]), F.slice(log, 1, 3)))


def called_by_coverage(df: DataFrame, regions: DataFrame) -> DataFrame:
    """Genotypes that aren't called are the reference where the record lies in a region, else the record gets the filter NotCallable. regions: chr, start, end."""
    spans = df.select(F.col("chr").alias("contig"), "start", "end")
    inside = overlap_join(spans, regions.select(F.col("chr").alias("contig"), "start", "end"), "contig", how="left_semi").distinct().select(F.col("contig").alias("chr"), "start", "end", F.lit(True).alias("_in"))
    bare = lambda g: g["gt_type"].isin("NO_CALL", "UNAVAILABLE")
    out = df.join(inside, ["chr", "start", "end"], "left").select(*df.columns, "_in").withColumn("_in", F.coalesce("_in", F.lit(False))).withColumn("_bare", F.exists("genotypes", bare))
    fixed = F.transform("genotypes", lambda g: F.when(bare(g) & F.col("_in"), g.withField("alleles", F.array(F.col("ref"), F.col("ref")))).otherwise(g))
    out = out.withColumn("genotypes", fixed).withColumn("filters", F.when(F.col("_bare") & ~F.col("_in"), F.array_sort(F.array_union("filters", F.array(F.lit("NotCallable"))))).otherwise(F.col("filters")))
    return _typed(out.drop("_in", "_bare"))


def most_frequent_alleles(calls: DataFrame, site: list[str], ref: str = "ref", alts: str = "alts") -> DataFrame:
    """site, ref, alt: of all pairs of reference and alternate there the most frequent, then the one of the shortest reference, then the smaller text."""
    pairs = calls.select(*site, F.col(ref).alias("ref"), F.explode(alts).alias("alt")).groupBy(*site, "ref", "alt").count()
    best = F.min_by(F.struct("ref", "alt"), F.struct(-F.col("count"), F.length("ref"), "ref", "alt"))
    return pairs.groupBy(*site).agg(best.alias("b")).select(*site, "b.*")


def ordered_samples(df: DataFrame, names: list[str]) -> DataFrame:
    """Genotypes in the order of names, others after them by name."""
    rank = F.create_map(*[x for k, n in enumerate(names) for x in (F.lit(n), F.lit(k))])
    keyed = F.transform("genotypes", lambda g: F.struct(F.coalesce(rank[g["sample"]], F.lit(len(names))).alias("k"), g["sample"].alias("s"), g.alias("g")))
    order = F.array_sort(F.transform(keyed, lambda x: F.struct(x["k"], x["s"])))
    return df.withColumn("genotypes", F.transform(order, lambda o: F.filter("genotypes", lambda g: g["sample"].eqNullSafe(o["s"]))[0]))


def split_complex(df: DataFrame) -> DataFrame:
    """Records of several bases in the reference and each alternate as one record for each simple variant in them; piece from 0, later ones phased.

    Genotypes follow by the index of their alleles. Equal lengths are compared in place, others after alignment, in Arrow batches.
    """
    several = (F.length("ref") > 1) & F.forall("alts", lambda a: (F.length(a) > 1) & a.rlike("^[A-Za-z]+$"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(ref, alts, n, at, alleles[0], alleles[1:]) for ref, alts in zip(*(c.to_pylist() for c in b.columns), strict=True) for n, (at, alleles) in enumerate(pieces(ref, alts))]
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            types = (pa.string(), pa.list_(pa.string()), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["ref", "alts", "piece", "at", "new_ref", "new_alts"])

    # each pair of reference and alternates is taken apart once, however many records have it
    split = df.where(several).select("ref", "alts").distinct().mapInArrow(run, "ref string, alts array<string>, piece int, at long, new_ref string, new_alts array<string>")
    out = df.where(several).join(split, ["ref", "alts"])
    old, new = F.concat(F.array("ref"), "alts"), F.concat(F.array("new_ref"), "new_alts")
    renamed = lambda g: g.withField("alleles", F.transform(g["alleles"], lambda a: F.when(a.isNotNull(), F.get(new, (F.array_position(old, a) - 1).cast("int")))))
    phased = lambda g: g.withField("phased", F.when(F.col("piece") > 0, F.lit(True)).otherwise(g["phased"]))
    out = out.withColumn("genotypes", F.transform("genotypes", lambda g: phased(renamed(g))))
    out = out.withColumns({"start": (F.col("start") + F.col("at")).cast(df.schema["start"].dataType), "ref": F.col("new_ref")})
    # alternates that are the reference in this piece, or twice the same, are no alternates there
    out = out.withColumn("alts", F.array_distinct(F.filter("new_alts", lambda a: a != F.col("ref"))))
    out = out.withColumn("end", (F.col("start") + F.length("ref") - 1).cast(df.schema["end"].dataType)).withColumn("type", G.variant_class(F.col("ref"), F.col("alts")))
    rest = df.where(~F.coalesce(several, F.lit(False))).withColumn("piece", F.lit(0))
    return _typed(out.select(*df.columns, "piece").unionByName(rest.select(*df.columns, "piece")))


def stripped(df: DataFrame) -> DataFrame:
    """Bases that the reference shares with all alternates leave the front, but for one where lengths differ. Genotypes follow."""
    plain = F.forall("alts", lambda a: a.rlike("^[A-Za-z]+$")) & (F.size("alts") > 0)
    n = F.least(F.length("ref"), F.array_min(F.transform("alts", F.length)))
    same = lambda i: F.forall("alts", lambda a: F.substr(a, i, F.lit(1)) == F.substr(F.col("ref"), i, F.lit(1)))
    differ = F.filter(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: ~same(i))
    cut = F.when(plain, F.greatest(F.coalesce(F.get(differ, F.lit(0)), n + 1) - 2, F.lit(0))).otherwise(0)
    out = df.withColumn("_cut", F.least(cut, n - 1))
    short = lambda a: F.when(F.col("_cut") > 0, F.substr(a, F.col("_cut") + 1)).otherwise(a)
    fixed = {"start": (F.col("start") + F.col("_cut")).cast(df.schema["start"].dataType), "genotypes": F.transform("genotypes", lambda g: g.withField("alleles", F.transform(g["alleles"], short))), "ref": short(F.col("ref")), "alts": F.transform("alts", short)}
    return out.withColumns(fixed).withColumn("type", G.variant_class(F.col("ref"), F.col("alts"))).drop("_cut")


def normalised(df: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """The normal form of a call set: complex variants split, shared bases stripped and, with the bases before each site, simple indels moved left.

    before: chr, start, before (up to 200 bases that end with the first of the site's).
    """
    out = stripped(split_complex(df).drop("piece"))
    if before is None:
        return out
    simple = (F.size("alts") == 1) & (F.length("ref") != F.length(F.get("alts", F.lit(0))))
    keyed = out.join(before, ["chr", "start"], "left").withColumn("_alt", F.when(simple, F.get("alts", F.lit(0))))
    moved = normalize.left_aligned(keyed.where("_alt is not null and before is not null").select("start", "ref", F.col("_alt").alias("alt"), "before", F.col("start").alias("_s"), F.col("ref").alias("_r0"), F.col("_alt").alias("_a0")).distinct())
    moved = moved.select(F.col("_s").alias("start"), F.col("_r0").alias("ref"), F.col("_a0").alias("_alt"), "before", F.col("start").alias("_s"), F.col("ref").alias("_r"), F.col("alt").alias("_a"))
    joined = keyed.join(moved, ["start", "ref", "_alt", "before"], "left").drop("before", "_alt")
    new = lambda a: F.when(F.col("_r").isNull(), a).when(a == F.col("ref"), F.col("_r")).when(a == F.get("alts", F.lit(0)), F.col("_a"))
    fixed = {"genotypes": F.transform("genotypes", lambda g: g.withField("alleles", F.transform(g["alleles"], new))), "start": F.coalesce("_s", "start").cast(df.schema["start"].dataType), "alts": F.when(F.col("_a").isNotNull(), F.array("_a")).otherwise(F.col("alts")), "ref": F.coalesce("_r", "ref")}
    done = joined.withColumns(fixed).withColumn("end", (F.col("start") + F.length("ref") - 1).cast(df.schema["end"].dataType))
    return done.select(*df.columns)


def prepared(df: DataFrame, names: DataFrame | None = None, sample: str | None = None, ploidy: int = 2, keep_reference: bool = False, structural: bool = False) -> DataFrame:
    """A call set made ready: contigs renamed by names (old, new), rows without a call (and reference calls) dropped, genotypes of one ploidy, one sample name, no END."""
    out = normalize.remapped(df, names, "chr") if names is not None else df
    out = with_structural_genotype(out) if structural else out
    kinds = ("NO_CALL", "UNAVAILABLE") if keep_reference else ("NO_CALL", "UNAVAILABLE", "HOM_REF")
    out = normalize.without_end(normalize.with_ploidy(normalize.without_no_calls(out, kinds), ploidy))
    return normalize.renamed_sample(out, sample) if sample else out


def fully_prepared(df: DataFrame, names: DataFrame | None = None, sample: str | None = None, before: DataFrame | None = None, **options) -> DataFrame:
    """Cleaned, prepared and normalised."""
    return normalised(prepared(normalize.cleaned(df), names, sample, **options), before)


def best_reference(df: DataFrame, references: dict[str, list[str]]) -> str | None:
    """The first of references (name to contigs) that has the contig of the first record by place."""
    row = df.orderBy("chr", "start").select("chr").first()
    return next((name for name, contigs in references.items() if row and row["chr"] in contigs), None)


def is_haploid(df: DataFrame, mito: tuple[str, ...] = ("MT", "M", "chrM"), n: int = 10) -> bool:
    """Whether the first n records by place, outside mitochondria, all have genotypes of one allele."""
    rows = df.where(~F.col("chr").isin(*mito)).orderBy("chr", "start", "ref").limit(n)
    sizes = rows.select(F.array_max(F.transform("genotypes", lambda g: F.size(g["alleles"]))).alias("p")).agg(F.count(F.lit(1)).alias("n"), F.max("p").alias("p")).first()
    return bool(sizes["n"]) and sizes["p"] == 1


def block_of(start: Column, width: int = 10_000_000) -> Column:
    """Start of the block of so many bases that a place lies in."""
    return F.floor(start / width) * width


def sorted_regions(df: DataFrame, order: list[str]) -> DataFrame:
    """Regions in the order of contigs, then by start and end."""
    place = F.create_map(*[x for k, name in enumerate(order) for x in (F.lit(name), F.lit(k))])
    return df.orderBy(place[F.col("chr")].asc_nulls_last(), "start", "end")


def limited_regions(regions: DataFrame, calls: DataFrame) -> DataFrame:
    """Regions on contigs that the calls have."""
    return regions.join(calls.select("chr").distinct(), "chr", "left_semi")


def split_samples(calls: list[dict], samples: dict[str, list[str]]) -> list[dict]:
    """Calls of a configuration with one entry for each sample of a file that has several. samples: file to its sample names."""
    return [{**c, "name": f"{c['name']}-{s}" if len(samples.get(c["file"], [])) > 1 else c["name"], "sample": s} for c in calls for s in samples.get(c["file"], [None])]




def last_by_place(df: DataFrame, site: list[str], order: list[str]) -> DataFrame:
    """One row for each site, the last by order."""
    by = Window.partitionBy(*site).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_k", F.row_number().over(by)).where("_k = 1").drop("_k")
