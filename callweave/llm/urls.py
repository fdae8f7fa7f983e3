"""URL filter by association rules: stated host and path rules first, then rules mined by FP-growth from labelled pages.

A page is labelled by the row of labels with its id (doc_id = page_id): bad if quality is 0 or toxic is 1. FP-growth finds the token combinations that
LEAST_PAGES bad pages or more have, whatever the number of pages; counted against all labelled pages, those of enough confidence are rules, and one that
contains a rule is left out, as it adds nothing. Tokens that always come together (a host and its parts, say) count as one, the first by name, so no
combinations of them are listed. Each rule stands in an inverted index under its rarest token; a URL looks up its own tokens and is blocked if it has all
tokens of a rule found there.

Cases. Null URL or one without ://: empty host and path, no tokens, allowed. Repeated rows: judged alike. Labels of a page that differ: bad if any is.
Empty tables or no bad pages: no rules. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.llm.common import written

#: (verdict, rule): a rule fits its host and all subdomains where the path starts with the rule's; the longest wins.
RULES = [
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
]
#: A rule needs that many bad pages with its tokens, and that share of bad ones among all with them.
LEAST_PAGES, CONFIDENCE = 25, 0.75
#: Rules go to all tasks up to that number; more are dealt by their tokens.
SENT_RULES = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def fits(host_name: Column, path_name: Column, rule: str) -> Column:
    own, _, tail = rule.partition("/")
    return ((host_name == own) | F.endswith(host_name, F.lit("." + own))) & F.startswith(path_name, F.lit("/" + tail))


def tokens(url: Column) -> Column:
    """Marked tokens: scheme, host, its parts and their words, path segments, names of query fields, a fragment. Numbers are #."""
    h, p = host(url), path(url)
    marked = lambda mark, parts: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(mark), F.regexp_replace(x, "[0-9]+", "#")))
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    names = F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, "^[^=]*", 0))
    some = F.concat(
        marked("scheme:", F.array(F.regexp_extract(url, "^([A-Za-z]+)://", 1))), marked("host:", F.array(h)), marked("part:", F.split(h, r"\.")), marked("word:", F.flatten(F.transform(F.filter(F.split(h, r"\."), lambda x: F.contains(x, F.lit("-"))), lambda x: F.split(x, "-")))),
        marked("path:", F.split(p, "/")), marked("field:", names), F.when(F.contains(_rest(url), F.lit("#")), F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>")),
    )
    return F.coalesce(F.array_distinct(some), F.array().cast("array<string>"))


def _told_apart(baskets: DataFrame) -> DataFrame:
    """page, bad and tokens, of tokens that the very same pages have the first by name. Sets of pages are compared by their number and two 64-bit sums of hashes."""
    each = baskets.select("page", F.explode("tokens").alias("token"))
    marks = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("page")).alias("x"), F.bit_xor(F.xxhash64(F.lit(3), "page")).alias("y"))
    first = marks.groupBy("n", "x", "y").agg(F.min("token").alias("token")).select("token")
    some = each.join(first, "token", "left_semi").groupBy("page").agg(F.array_sort(F.collect_list("token")).alias("tokens"))
    return baskets.select("page", "bad").join(some, "page")


def mined(pages: DataFrame, labels: DataFrame, least_pages: int = LEAST_PAGES, confidence: float = CONFIDENCE) -> DataFrame:
    """rule (its tokens, sorted), anchor (the rarest of them), confidence; empty if nothing was learnt."""
    spark = pages.sparkSession
    bad = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).cast("int")).alias("bad"))
    marked = pages.select("page_id", "url").join(bad, pages["page_id"] == bad["doc_id"]).withColumn("page", F.monotonically_increasing_id())
    baskets = written(_told_apart(written(marked.select("page", "bad", tokens(F.col("url")).alias("tokens")).where(F.size("tokens") > 0))))
    worst = baskets.where("bad = 1").select("tokens")
    n = worst.count()
    if n < least_pages:
        return spark.createDataFrame([], "rule array<string>, anchor string, confidence double")
    sets = FPGrowth(itemsCol="tokens", minSupport=(least_pages - 0.5) / n).fit(worst).freqItemsets.select(F.array_sort("items").alias("rule"), F.col("freq").alias("worst"))
    pages_with = baskets.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("pages"))
    anchored = sets.select("rule", "worst", F.explode("rule").alias("token")).join(pages_with, "token").groupBy("rule", "worst").agg(F.min_by("token", F.struct("pages", "token")).alias("anchor"))
    anchored = written(anchored)
    counts = _having(baskets.select("tokens"), anchored).groupBy("rule").agg(F.count(F.lit(1)).alias("all"))
    good = anchored.join(counts, "rule").withColumn("confidence", F.col("worst") / F.col("all")).where(F.col("confidence") >= confidence)
    # a rule that contains another one is found under one of its own tokens, which is the other one's anchor
    wide = good.select(F.col("rule").alias("wide"), F.explode("rule").alias("anchor"))
    spare = wide.join(good.select("anchor", F.col("rule").alias("narrow")), "anchor").where((F.size("narrow") < F.size("wide")) & (F.size(F.array_except("narrow", "wide")) == 0))
    return written(good.join(spare.select(F.col("wide").alias("rule")).distinct(), "rule", "left_anti").select("rule", "anchor", "confidence"))


def _having(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """rows (with tokens) and a rule whose tokens they all have, found under its anchor: a row for each such rule."""
    index = rules.select("anchor", "rule")
    index = F.broadcast(index) if rules.limit(SENT_RULES + 1).count() <= SENT_RULES else index
    return rows.withColumn("anchor", F.explode("tokens")).join(index, "anchor").where(F.size(F.array_except("rule", "tokens")) == 0)


def matched(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """The distinct URLs that have all tokens of a rule."""
    urls = pages.select("url").where("url is not null").distinct().withColumn("tokens", tokens(F.col("url")))
    return _having(urls, rules).select("url").distinct()


def judged(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule (the stated rule that fits best, or null) and verdict (allow or block)."""
    hit = matched(pages, mined(pages, labels)).select(F.col("url").alias("hit_url"), F.lit(True).alias("hit"))
    out = pages.select("page_id", "url").join(hit, F.col("url") == F.col("hit_url"), "left").withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    rule, verdict = F.lit(None).cast("string"), F.when(F.col("hit"), "block").otherwise("allow")
    for said, text in sorted(rules, key=lambda r: len(r[1])):
        fit = fits(F.col("host"), F.col("path"), text)
        rule, verdict = F.when(fit, F.lit(text)).otherwise(rule), F.when(fit, F.lit(said)).otherwise(verdict)
    return out.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))
