"""VCF text as typed rows, and rows as VCF text. Coordinates are 1-based and inclusive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callweave.functions import genotypes as G


def read_vcf(spark: SparkSession, path: str, callset: str | None = None) -> DataFrame:
    """One row for each record of a file, folder or glob (gzip too): fname, chr, start, end, id, ref, alts, type, qual, filters, info, num_samples, genotypes."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("file_name"))
    part = F.split("value", "\t")
    # a row for each file; more files than go to every task are joined by their paths
    names = lines.where(F.col("value").startswith("#CHROM")).select("file", F.slice(part, 10, F.size(part)).alias("names"))
    rows = lines.where(~F.col("value").startswith("#") & (F.length("value") > 0)).join(names, "file", "left")
    rows = rows.select((F.lit(callset) if callset else F.col("file_name")).alias("fname"), F.coalesce("names", F.array().cast("array<string>")).alias("names"), part.alias("p"))
    info = F.expr("if(get(p, 7) = '.', map(), map_from_entries(transform(filter(split(ltrim(';', get(p, 7)), ';'), x -> x <> ''), x -> struct(split_part(x, '=', 1) as k, if(instr(x, '=') > 0, substring(x, instr(x, '=') + 1), 'true') as v))))")
    named = rows.select(
        "fname", "names", F.expr("get(p, 0)").alias("chr"), F.expr("cast(get(p, 1) as int)").alias("start"), F.expr("nullif(get(p, 2), '.')").alias("id"), F.expr("upper(get(p, 3))").alias("ref"), F.expr("filter(split(get(p, 4), ','), a -> a <> '.')").alias("alts"),
        F.expr("try_cast(get(p, 5) as double)").alias("qual"), F.expr("array_sort(array_distinct(filter(split(get(p, 6), ';'), f -> f not in ('.', 'PASS', ''))))").alias("filters"), info.alias("info"),
        F.expr("if(size(p) > 9, split(get(p, 8), ':'), cast(array() as array<string>))").alias("fmt"), F.expr("if(size(p) > 9, slice(p, 10, size(p)), cast(array() as array<string>))").alias("calls"),
    )
    geno = (
        "transform(calls, (c, i) -> named_struct('sample', get(names, i), 'attrs', map_from_arrays(slice(fmt, 1, least(size(fmt), size(split(c, ':')))), slice(split(c, ':'), 1, least(size(fmt), size(split(c, ':')))))))"
    )
    typed = (
        "transform(g0, g -> named_struct('sample', g.sample, 'phased', instr(coalesce(g.attrs['GT'], ''), '|') > 0, "
        "'alleles', transform(split(coalesce(g.attrs['GT'], '.'), '[/|]'), k -> if(k = '.', null, concat(array(ref), alts)[cast(k as int)])), 'attrs', g.attrs, "
        "'ad', if(g.attrs['AD'] = '.', cast(array() as array<int>), transform(split(g.attrs['AD'], ','), x -> try_cast(x as int))), "
        "'pl', if(g.attrs['PL'] = '.', cast(array() as array<int>), transform(split(g.attrs['PL'], ','), x -> try_cast(x as int))), "
        "'dp', try_cast(g.attrs['DP'] as int), 'gq', try_cast(g.attrs['GQ'] as int)))"
    )
    out = named.withColumn("g0", F.expr(geno)).withColumn("genotypes", F.expr(typed))
    end = F.coalesce(F.expr("try_cast(info['END'] as int)"), F.col("start") + F.length("ref") - 1)
    out = out.withColumn("end", end).withColumn("type", G.variant_class(F.col("ref"), F.col("alts"))).withColumn("num_samples", F.size("genotypes"))
    out = out.withColumn("genotypes", F.transform("genotypes", lambda g: g.withField("gt_type", G.genotype_class(g["alleles"], F.col("ref")))))
    return out.select("fname", "chr", "start", "end", "id", "ref", "alts", "type", "qual", "filters", "info", "num_samples", "genotypes")


def samples(spark: SparkSession, path: str) -> DataFrame:
    """fname, place and sample of the header line of each file."""
    part = F.split("value", "\t")
    lines = spark.read.text(path).where(F.col("value").startswith("#CHROM")).select(F.col("_metadata.file_name").alias("fname"), F.slice(part, 10, F.size(part)).alias("names"))
    return lines.select("fname", F.posexplode("names").alias("place", "sample"))


def header(spark: SparkSession, path: str) -> DataFrame:
    """kind, id, number, type, description of the header's declarations, each once."""
    lines = spark.read.text(path).where(F.col("value").rlike("^##(INFO|FORMAT|FILTER|ALT|contig)="))
    take = lambda name: F.nullif(F.regexp_extract("value", rf"[<,]{name}=\"?([^,\">]*)", 1), F.lit(""))
    return lines.select(F.regexp_extract("value", "^##(\\w+)=", 1).alias("kind"), take("ID").alias("id"), take("Number").alias("number"), take("Type").alias("type"), F.regexp_extract("value", 'Description="([^"]*)"', 1).alias("description")).dropDuplicates(["kind", "id"])


def merged_headers(*headers: DataFrame) -> DataFrame:
    out = headers[0]
    for h in headers[1:]:
        out = out.unionByName(h)
    return out.dropDuplicates(["kind", "id"])


def vcf_lines(df: DataFrame, category: str | None = None) -> DataFrame:
    """chr, start and the text line of each row, with its category if one is named; sites only where there are no genotypes."""
    info = F.expr("if(size(info) = 0, '.', array_join(array_sort(transform(map_entries(info), e -> if(e.value = 'true', e.key, concat(e.key, '=', e.value)))), ';'))")
    fields = ["chr", F.col("start").cast("string"), F.coalesce("id", F.lit(".")), "ref", F.expr("if(size(alts) = 0, '.', array_join(alts, ','))"), F.coalesce(F.col("qual").cast("string"), F.lit(".")), F.expr("if(size(filters) = 0, 'PASS', array_join(filters, ';'))"), info]
    calls = "transform(genotypes, g -> array_join(transform(g.alleles, a -> if(a is null, '.', cast(array_position(concat(array(ref), alts), a) - 1 as string))), if(g.phased, '|', '/')))"
    line = F.concat_ws("\t", *fields) if "genotypes" not in df.columns else F.expr("array_join(concat(array(base), if(size(genotypes) > 0, array('GT'), cast(array() as array<string>)), " + calls + "), '\t')")
    out = df.withColumn("base", F.concat_ws("\t", *fields)) if "genotypes" in df.columns else df
    return out.select(*([F.col(category).alias("category")] if category else []), "chr", "start", line.alias("value"))


COLUMNS = ["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO"]


def header_lines(declared: DataFrame, names: list[str], more: list[str] = ()) -> list[str]:
    """The text of a header: declarations of header() in order of kind and id, further lines, and the line of columns. A handful of rows is collected."""
    rows = declared.orderBy("kind", "id").collect()
    field = lambda r: ",".join(f"{k}={v}" for k, v in (("ID", r["id"]), ("Number", r["number"]), ("Type", r["type"])) if v is not None) + (f',Description="{r["description"]}"' if r["description"] else "")
    return ["##fileformat=VCFv4.1", *(f"##{r['kind']}=<{field(r)}>" for r in rows), *more, "\t".join([*COLUMNS, *(["FORMAT", *names] if names else [])])]


def repaired_header(lines: list[str]) -> list[str]:
    """Header lines that old tools wrote made valid: a type for ALT, -1 as a number of values and missing descriptions."""
    out = []
    for line in lines:
        if line.startswith(("##INFO", "##FORMAT")):
            line = line.replace("Number=-1", "Number=.")
            line = line if "Description=" in line else line[:-1] + ',Description=""' + line[-1]
        if line.startswith("##ALT") and "Description=" not in line:
            line = line[:-1] + ',Description=""' + line[-1]
        out.append(line)
    return out


def write_vcf(df: DataFrame, path: str, head: list[str], category: str | None = None, order: list[str] | None = None) -> None:
    """VCF text under path: a folder of parts sorted by contig and place, each with the header; with a category, one such folder for each of its values, in one pass."""
    place = F.create_map(*[x for k, name in enumerate(order) for x in (F.lit(name), F.lit(k))])[F.col("chr")] if order else F.col("chr")
    own = ["category"] if category else []
    lines = vcf_lines(df, *([category] if category else [])).withColumn("place", place)
    ranged = lines.repartitionByRange(*own, "place", "start").sortWithinPartitions(*own, "place", "start")
    first = ranged.select(*own, "value", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row"))
    # the header stands before the first row of each part, and each part of a category is a file
    before = F.lag("part").over(Window.partitionBy(*own, "part").orderBy("row"))
    top = F.when(before.isNull(), F.lit("\n".join(head) + "\n")).otherwise("")
    out = first.withColumn("value", F.concat(top, "value")).sortWithinPartitions(*own, "part", "row").select(*own, "value")
    writer = out.write.mode("overwrite").option("lineSep", "\n")
    (writer.partitionBy("category") if category else writer).text(path)


def write_split(df: DataFrame, path: str, category: str = "category") -> None:
    """Routes records to one folder for each category in one pass, as parquet."""
    df.write.mode("overwrite").partitionBy(category).parquet(path)


def write_index(df: DataFrame, path: str) -> None:
    """The indexed form of a call set: parquet by contig, sorted by place, so a region reads the row groups that hold it."""
    df.repartitionByRange("chr", "start").sortWithinPartitions("chr", "start").write.mode("overwrite").partitionBy("chr").parquet(path)


def read_region(spark: SparkSession, path: str, contig: str, start: int, end: int) -> DataFrame:
    """Records of a written index that overlap a region."""
    return spark.read.parquet(path).where((F.col("chr") == contig) & (F.col("start") <= end) & (F.col("end") >= start))


def sites_only(df: DataFrame) -> DataFrame:
    return df.drop("genotypes").withColumn("num_samples", F.lit(0))


def per_sample(df: DataFrame) -> DataFrame:
    """A row for each record and sample."""
    return df.withColumn("g", F.explode("genotypes")).select("*", "g.*").drop("g", "genotypes")


def with_genotypes(lines: DataFrame, sample: str = "sample", ploidy: int = 2) -> DataFrame:
    """Text lines of eight columns get a genotype of the first alternate; others stay. lines: value."""
    eight = F.size(F.split("value", "\t")) == 8
    return lines.withColumn("value", F.when(eight, F.concat_ws("\t", "value", F.lit("GT"), F.lit("/".join(["1"] * ploidy)))).otherwise(F.col("value")))


def fixed_lines(lines: DataFrame, names: DataFrame) -> DataFrame:
    """Text lines with contigs renamed by names (old, new), a leading ; off the INFO column and blanks in it as _; lines of other contigs go. names: a row for each contig."""
    p = F.split("value", "\t")
    rows = lines.where(~F.col("value").startswith("#")).select(p.alias("p")).join(names.select(F.col("old").alias("_old"), "new"), F.col("p")[0] == F.col("_old"))
    info = F.regexp_replace(F.regexp_replace(F.col("p")[7], "^;+", ""), " ", "_")
    return rows.select(F.concat_ws("\t", F.array(F.col("new")), F.slice("p", 2, 6), F.array(info), F.slice("p", 9, F.size("p"))).alias("value"))
