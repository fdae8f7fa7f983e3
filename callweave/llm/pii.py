"""Personal data by candidate gradient boosting, in DataFrame and SQL functions only.

Strict patterns with their checks give the base spans. High-recall generators propose further spans, which may overlap, among them secrets (keys and tokens),
for which there is no strict pattern; boosted trees judge these by their format and context, and each kind has a threshold above which a proposal is selected.

The trees can't learn from which proposals meet a base span, as those that don't are what they are for. They learn from evidence that is then hidden: base spans
of all documents in disguise (another spelling or other separators, which the strict patterns miss) are examples for, and so are strings that a word such as
token or password introduces, with that word kept or hidden; against are the same values spoilt (a check digit, a number over 255, too few digits, a
sentence for an address), proposals that fail their kind's check, or that are a base span of another kind, cards and addresses taken for phones, and strings made of words. A small set of made-up
values, the same for any table, goes the same way, so trees stand for every kind even where a corpus holds nothing. They are fitted to a bounded sample of the
examples; the thresholds are calibrated on all examples of documents that the trees were not fitted to. The trees become one SQL expression.

Cases. Null or empty text: no spans. Repeated rows: each has its own result. Null doc_id: kept. Empty table: no rows. Other columns, whatever their names, are
ignored by found(), kept by redacted(). Positions count code points from 0, the end is exclusive. The patterns take time linear in the text, whatever its runs
of digits or letters; places are summed in blocks, so many matches in a long text stay cheap.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.llm.common import dropped, written

KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
#: A match starts at the end of the one before or where no character of its first class stands before; so a run is entered once.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\s?(?:@|\(at\)|\[at\])\s?[A-Za-z0-9-]{1,63}+(?:\s?(?:\.|\(dot\)|\[dot\])\s?[A-Za-z0-9-]{1,63}+){1,8}+",
    "ip": r"(?<![0-9])[0-9]{1,3}(?:\s?[.,]\s?[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[\x20./_-]{0,2}[0-9]){12,18}(?![0-9])",
    "phone": r"(?<![0-9])(?:\+|00)?\(?[0-9]{1,4}\)?(?:[\x20./()-]{1,3}[0-9]{2,5}){2,4}(?![0-9])",
    "secret": r"(?<![A-Za-z0-9_+/=.-])(?=[A-Za-z_+/.-]*+[0-9])(?=[0-9_+/.-]*+[A-Za-z])[A-Za-z0-9_+/.-]{16,}+={0,2}+",
}
#: A document outside this has no match of any pattern.
HINT = r"[0-9@]|\(at\)|\[at\]"
#: Examples that the trees are fitted to at most (in expectation; those of the smallest hash); the made-up values come on top.
FIT_ROWS, PRIOR_VALUES = 40_000, 150
TREES, DEPTH, PRECISION = 20, 4, 0.98
_BLOCK = 512
_WORDS = {
    "email": "mail|contact|write", "ip": "host|server|address|node|login", "card": "card|visa|credit|karte|carte|tarjeta", "phone": "phone|tel|call|fax|mobil",
    "secret": "token|secret|passw|pwd|api|key|auth|bearer|credential",
}
#: A context that introduces a secret, as a SQL literal.
_ASSIGNED = r"""'(?i)(token|secret|passw|pwd|key|auth|bearer|credential)[a-z_-]*["`]?\\s*[=: ]\\s*["`]?$'"""
_DIGITS = "regexp_replace(x.v, '[^0-9]', '')"
_LUHN = f"aggregate(transform(split(reverse({_DIGITS}), ''), (d, i) -> if(i % 2 = 0, cast(d as int), cast(d as int) * 2 - if(cast(d as int) > 4, 9, 0))), 0, (s, d) -> s + d) % 10 = 0"
_VALID = {
    "email": "true",
    "ip": "forall(split(x.v, '[.]'), p -> char_length(ltrim('0', p)) <= 3 and cast(substring(concat('0', ltrim('0', p)), -4) as int) <= 255)",
    "card": f"char_length({_DIGITS}) between 16 and 19 and {_LUHN}",
    "phone": f"char_length({_DIGITS}) between 8 and 15",
}
_COUNT = "cast(char_length(regexp_replace(x.v, '{}', '')) as double)"
#: Features of a candidate x (kind, v, before, after), as SQL.
FEATURE_SQL = {
    **{f"is_{k}": f"cast(x.kind = '{k}' as double)" for k in ALL_KINDS},
    "n_chars": "cast(char_length(x.v) as double)", "n_digits": _COUNT.format("[^0-9]"), "n_dots": _COUNT.format("[^.]"), "n_dashes": _COUNT.format("[^-]"), "n_blanks": _COUNT.format("[^ ]"), "n_brackets": _COUNT.format("[^()]"),
    "n_slashes": _COUNT.format("[^/_]"), "n_commas": _COUNT.format("[^,]"), "not_hex": _COUNT.format("[0-9a-fA-F]"),
    "plus": "cast(x.v rlike '^[+]|^00' as double)", "at": "cast(x.v rlike '[(\\\\[]at' as double)", "luhn": f"cast(char_length({_DIGITS}) between 13 and 19 and {_LUHN} as double)",
    "over": "cast(exists(split(x.v, '[^0-9]+'), p -> char_length(p) > 3 or coalesce(try_cast(p as int), 0) > 255) as double)", "top": "cast(x.v rlike '(\\\\.|[(\\\\[]dot[)\\\\]]) ?[A-Za-z]{2,24}$' as double)",
    "sentence": "cast(x.v rlike '[.] [A-Z]' as double)", "longest": "cast(array_max(transform(split(x.v, '[^A-Za-z]+'), p -> char_length(p))) as double)", "mixes": "cast(size(regexp_extract_all(x.v, '[A-Za-z][0-9]|[0-9][A-Za-z]', 0)) as double)", "changes": "cast(char_length(regexp_replace(regexp_replace(x.v, '[A-Za-z]+', 'a'), '[0-9]+', '9')) as double)",
    "before_word": "cast(x.before rlike '[A-Za-z0-9]$' as double)", "after_word": "cast(x.after rlike '^[A-Za-z0-9]' as double)", "before_sign": "cast(x.before rlike '[=:\"#$/.-] ?$' as double)", "after_sign": "cast(x.after rlike '^[-=:\"#$/.,%]?[0-9]' as double)",
    **{f"near_{k}": f"cast(lower(x.before) rlike '{w}' as double)" for k, w in _WORDS.items()},
}
FEATURES = list(FEATURE_SQL)


def _pairs(df: DataFrame, text: str, name: str, pattern: str) -> DataFrame:
    """Adds name: array of (start, end, v) of the pattern's matches, leftmost and not overlapping."""
    at, gap = f"{name}_m", f"{name}_g"
    df = df.withColumn(at, F.when(F.col("hinted"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))).withColumn(gap, F.when(F.size(at) > 0, F.split(text, pattern, -1)))
    steps = f"zip_with({gap}, {at}, (g, m) -> named_struct('g', char_length(g), 'm', char_length(m), 'v', m))"
    df = df.withColumn(f"{name}_s", F.when(F.size(at) > 0, F.expr(f"filter({steps}, x -> x.v is not null)")))
    blocks = f"transform(sequence(0, cast((size({name}_s) - 1) / {_BLOCK} as int)), b -> slice({name}_s, b * {_BLOCK} + 1, {_BLOCK}))"
    df = df.withColumn(f"{name}_b", F.when(F.size(at) > 0, F.expr(blocks)))
    firsts = f"aggregate({name}_b, named_struct('at', 0, 'all', cast(array() as array<int>)), (a, b) -> named_struct('at', a.at + aggregate(b, 0, (s, x) -> s + x.g + x.m), 'all', array_append(a.all, a.at)), a -> a.all)"
    df = df.withColumn(f"{name}_f", F.when(F.size(at) > 0, F.expr(firsts)))
    spans = (
        f"flatten(zip_with({name}_b, {name}_f, (b, f) -> aggregate(b, named_struct('at', f, 'all', cast(array() as array<struct<start: int, end: int, v: string>>)), "
        "(a, x) -> named_struct('at', a.at + x.g + x.m, 'all', array_append(a.all, named_struct('start', a.at + x.g, 'end', a.at + x.g + x.m, 'v', x.v))), a -> a.all)))"
    )
    none = F.expr("cast(array() as array<struct<start: int, end: int, v: string>>)")
    return df.withColumn(name, F.when(F.size(at) > 0, F.expr(spans)).otherwise(none)).drop(at, gap, f"{name}_s", f"{name}_b", f"{name}_f")


def _with_base(df: DataFrame) -> DataFrame:
    """df: t, the text; adds hinted and the base spans of each kind."""
    df = df.withColumn("hinted", F.col("t").rlike(HINT))
    for kind in KINDS:
        df = _pairs(df, "t", f"strict_{kind}", STRICT[kind])
        df = df.withColumn(f"strict_{kind}", F.expr(f"filter(strict_{kind}, x -> {_VALID[kind]})"))
    return df


_PLACED = "'start', x.start, 'end', x.end, 'v', x.v, 'before', substring(t, greatest(1, x.start - 23), least(24, x.start)), 'after', substring(t, x.end + 1, 4)"


def _with_proposals(df: DataFrame) -> DataFrame:
    """Adds proposed: array of (kind, start, end, v, before, after, met: the kinds of base spans that it overlaps)."""
    for kind in ALL_KINDS:
        df = _pairs(df, "t", f"loose_{kind}", LOOSE[kind])
    # base spans stand twice, or the optimiser would put their making inside the function for each proposal
    met = ", ".join(f"if(size(strict_{k}) > 0 and exists(strict_{k}, y -> y.start < x.end and x.start < y.end), '{k}', null)" for k in KINDS)
    each = ", ".join(f"transform(loose_{k}, x -> named_struct('kind', '{k}', {_PLACED}, 'met', array_compact(array({met}))))" for k in ALL_KINDS)
    return df.withColumn("proposed", F.expr(f"concat({each})")).drop(*(f"loose_{k}" for k in ALL_KINDS))


#: Disguises of a base span and ways to spoil it, as SQL; each form is an example for, or against.
_DISGUISED = {
    "email": ["x.v", "replace(replace(x.v, '@', ' (at) '), '.', ' (dot) ')", "replace(x.v, '@', '[at]')", "replace(x.v, '@', ' @ ')"],
    "ip": ["x.v", "replace(x.v, '.', ' . ')", "replace(x.v, '.', '. ')"],
    "card": ["x.v", *(f"regexp_replace({_DIGITS}, '([0-9]{{4}})(?=[0-9])', '$1{s}')" for s in (".", "/", "_", "  "))],
    "phone": ["x.v", "substring(x.v, 2)", "concat('00', substring(x.v, 2))", "regexp_replace(substring(x.v, 2), '[^0-9]+', '.')"],
    "secret": ["x.v"],
}
_OTHER_CHECK = f"concat(substring({_DIGITS}, 1, char_length({_DIGITS}) - 1), (cast(substring({_DIGITS}, -1) as int) + 3) % 10)"
_SPOILT = {
    "email": ["concat(substring_index(x.v, '@', 1), ' @ ', 'the. Then')", "concat(substring_index(x.v, '@', 1), ' @ 3.', char_length(x.v))"],
    "ip": ["concat(x.v, '7', '3')", "replace(x.v, '.', ', ')", "replace(x.v, '.', ',')", "concat('3', x.v, '9')"],
    "card": [_OTHER_CHECK, *(f"regexp_replace({_OTHER_CHECK}, '([0-9]{{4}})(?=[0-9])', '$1{s}')" for s in (".", "/", "_", "  ", " ")), f"substring({_DIGITS}, 1, 14)", f"regexp_replace(substring({_DIGITS}, 1, 13), '([0-9]{{3}})(?=[0-9])', '$1.')"],
    "phone": [f"regexp_replace(substring({_DIGITS}, 1, 6), '([0-9]{{2}})(?=[0-9])', '$1-')", f"concat(substring({_DIGITS}, 1, 4), '-', substring({_DIGITS}, 5, 2), '-', substring({_DIGITS}, 7, 2))", f"concat(substring({_DIGITS}, 1, 3), '.', substring({_DIGITS}, 4, 3), '.', substring({_DIGITS}, 7, 2))", f"concat(substring({_DIGITS}, 1, 1), '.', substring({_DIGITS}, 2, 2), '.', substring({_DIGITS}, 4, 3), '.', substring({_DIGITS}, 7, 4))"],
    "secret": [
        f"concat('{a}', char_length(x.before) + ascii(x.v) % {m}, '{b}')"
        for a, m, b in (
            ("chapter-", 90, "-of-the-novel"), ("example/site/page", 40, "/about"), ("12.", 30, ".345.678.901a"), ("section_", 60, "_results_of_the_year"), ("www.example.org/", 70, "/a-very-long-title"), ("the-", 50, "-best-ways-to-go"),
            ("IMG_202405", 20, "_holiday.jpg"), ("covid-", 10, "-pandemic-response"), ("version-", 30, ".0.1-beta-release"), ("report_v", 9, "_final_copy"), ("road-to-", 80, "-in-a-day"), ("item/", 99, "/of/the/list/and/more"),
        )
    ],
}


def _forms(values: DataFrame) -> DataFrame:
    """values: fold, x (kind, v, before, after). Rows of examples: fold, label, x in every form, with its context and, once, without."""
    arrays = []
    for forms, label in ((_DISGUISED, "1.0D"), (_SPOILT, "0.0D")):
        each = " ".join(f"when '{k}' then array({', '.join(f'cast({e} as string)' for e in forms[k])})" for k in ALL_KINDS)
        arrays.append(f"transform(case x.kind {each} end, v -> named_struct('label', {label}, 'kind', x.kind, 'v', v))")
    mistaken = " ".join(f"when '{k}' then array({', '.join(_DISGUISED[k])})" for k in ("card", "ip"))
    arrays.append(f"transform(case x.kind {mistaken} else array() end, v -> named_struct('label', 0.0D, 'kind', 'phone', 'v', v))")
    out = values.select("fold", "x", F.explode(F.expr(f"concat({', '.join(arrays)})")).alias("f"))
    hidden = F.when((F.col("x.kind") == "secret") & (F.col("f.label") == 1), F.array(F.col("x.before"), F.lit("as in "))).otherwise(F.array(F.col("x.before")))
    out = out.select("fold", "f", "x", F.explode(hidden).alias("before"))
    return out.select("fold", F.col("f.label").alias("label"), F.struct(F.col("f.kind").alias("kind"), F.col("f.v").alias("v"), "before", F.col("x.after").alias("after")).alias("x"))


def _prior(spark: SparkSession) -> DataFrame:
    """The made-up values: fold, x."""
    n = "abs(xxhash64(id, {}))"
    body = f"lpad(cast({n.format(1)} % 1000000000000000 as string), 15, '4')"
    check = f"(10 - aggregate(transform(split(reverse({body}), ''), (d, i) -> if(i % 2 = 1, cast(d as int), cast(d as int) * 2 - if(cast(d as int) > 4, 9, 0))), 0, (s, d) -> s + d) % 10) % 10"
    values = {
        "email": f"concat(element_at(array('anna', 'jo.smith', 'k_lee', 'info', 'p.durand', 'mueller', 'x1', 'sales+eu', 'hr', 'team-lead'), cast(id % 10 + 1 as int)), if({n.format(2)} % 3 = 0, cast({n.format(2)} % 100 as string), ''), '@', element_at(array('mail', 'example', 'post7', 'uni-bonn', 'firma', 'shop9', 'b'), cast({n.format(9)} % 7 + 1 as int)), '.', element_at(array('com', 'org', 'net', 'fr', 'de', 'co.uk', 'example.com'), cast({n.format(10)} % 7 + 1 as int)))", "ip": "concat_ws('.', " + ", ".join(f"{n.format(s)} % 254 + 1" for s in (3, 4, 5, 6)) + ")",
        "card": f"concat({body}, {check})", "phone": f"concat('+', id % 60 + 1, ' (', lpad({n.format(7)} % 1000, 3, '0'), ') 555-', lpad({n.format(8)} % 10000, 4, '0'))",
        "secret": f"case id % 3 when 0 then sha1(cast(id as string)) when 1 then substring(base64(cast(sha2(cast(id as string), 256) as binary)), 1, 40) else concat('sk_live_', substring(md5(cast(id as string)), 1, 24)) end",
    }
    befores = {"email": "write to ", "ip": "the server ", "card": "visa card ", "phone": "call "} | {"secret": 'token = "'}
    structs = ", ".join(f"named_struct('kind', '{k}', 'v', {values[k]}, 'before', if(id % 2 = 0 or '{k}' = 'secret', '{befores[k]}', 'and so it is '), 'after', if('{k}' = 'secret', '\" an', ' and'))" for k in ALL_KINDS)
    return spark.range(PRIOR_VALUES).select(F.pmod(F.xxhash64("id"), F.lit(4)).alias("fold"), F.expr(f"explode(array({structs}))").alias("x"))


def examples(documents: DataFrame) -> DataFrame:
    """fold, label and candidate x of the examples for and against that the documents hold."""
    texts = documents.select(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(4)).alias("fold"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    df = _with_proposals(_with_base(texts.where(F.col("t").rlike(HINT))))
    base = ", ".join(f"transform(strict_{k}, x -> named_struct('kind', '{k}', {_PLACED}))" for k in KINDS)
    digits = "char_length(regexp_replace(x.v, '[^0-9]', ''))"
    against = (
        "case when size(x.met) > 0 then not array_contains(x.met, x.kind) when x.kind = 'ip' then exists(split(x.v, '[^0-9]+'), p -> coalesce(try_cast(p as int), 0) > 255) "
        f"when x.kind = 'card' then not ({_LUHN}) when x.kind = 'phone' then {digits} < 8 or {digits} > 15 when x.kind = 'secret' then x.v rlike '[A-Za-z]{{7,}}' and not x.v rlike '[A-Za-z][0-9][A-Za-z]' and not x.before rlike {_ASSIGNED} else false end"
    )
    kept = "named_struct('kind', x.kind, 'start', x.start, 'end', x.end, 'v', x.v, 'before', x.before, 'after', x.after)"
    secrets = f"transform(filter(proposed, x -> x.kind = 'secret' and size(x.met) = 0 and x.before rlike {_ASSIGNED}), x -> {kept})"
    df = df.select("fold", F.expr(f"concat({base}, {secrets})").alias("good"), F.expr(f"transform(filter(proposed, x -> {against}), x -> {kept})").alias("bad"))
    both = df.select("fold", F.explode(F.expr("concat(transform(good, x -> named_struct('good', true, 'x', x)), transform(bad, x -> named_struct('good', false, 'x', x)))")).alias("e"))
    plain = both.select("fold", "e.good", F.struct(*(F.col(f"e.x.{c}").alias(c) for c in ("kind", "v", "before", "after"))).alias("x"))
    return _forms(plain.where("good").drop("good")).unionByName(plain.where("not good").select("fold", F.lit(0.0).alias("label"), "x"))


class Judge:
    """margin: SQL of the trees' sum for a proposal x; least: the threshold of each kind that selects any."""

    def __init__(self, margin: str = "0.0D", least: dict[str, float] | None = None):
        self.margin, self.least = margin, least or {}

    def chance(self) -> str:
        return f"round(1 / (1 + exp(-2 * ({self.margin}))), 3)"


def _tree_sql(text: str) -> str:
    """A regression tree's printed form as nested CASE expressions over f, the array of features."""
    lines = [x.strip() for x in text.splitlines() if re.match(r"\s*(If|Else|Predict)", x)]

    def node(at: int) -> tuple[str, int]:
        if m := re.match(r"Predict: (\S+)", lines[at]):
            return f"{float(m[1])!r}D", at + 1
        feature, limit = re.match(r"If \(feature (\d+) <= (\S+)\)", lines[at]).groups()
        low, at = node(at + 1)
        high, at = node(at + 1)
        return f"(case when f[{feature}] <= {float(limit)!r}D then {low} else {high} end)", at

    return node(0)[0]


_FEATURES = "array(" + ", ".join(FEATURE_SQL.values()) + ")"


def fitted(documents: DataFrame, fit_rows: int = FIT_ROWS, trees: int = TREES, precision: float = PRECISION) -> Judge:
    """The trees and thresholds for the documents; see the module."""
    spark = documents.sparkSession
    table = written(examples(documents).unionByName(_forms(_prior(spark))).select("fold", "label", F.col("x.kind").alias("kind"), F.expr(_FEATURES).alias("f")))
    learn = table.where("fold <> 0")
    share = min(1.0, fit_rows / max(1, learn.count()))
    hashed = F.pmod(F.xxhash64("kind", "label", "f", F.monotonically_increasing_id() if share < 1 else F.lit(0)), F.lit(1_000_000))
    rows = learn.where(hashed < int(share * 1_000_000) + 1).select("label", *[F.col("f")[k].alias(n) for k, n in enumerate(FEATURES)])
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows.repartition(4))
    model = GBTClassifier(maxIter=trees, maxDepth=DEPTH, stepSize=0.3, seed=11, featuresCol="features", labelCol="label").fit(vectors)
    margin = " + ".join(f"{float(w)!r}D * {_tree_sql(t.toDebugString)}" for w, t in zip(model.treeWeights, model.trees, strict=True))
    judge = Judge(margin)
    counts = table.where("fold = 0").withColumn("p", F.expr(judge.chance())).groupBy("kind", "p").agg(F.sum("label").alias("good"), F.count(F.lit(1)).alias("n")).collect()
    dropped(table)
    for kind in ALL_KINDS:  # at most 1001 values of p for each
        good = total = 0.0
        for r in sorted((r for r in counts if r["kind"] == kind), key=lambda r: -r["p"]):
            good, total = good + r["good"], total + r["n"]
            if good / total < precision:
                break
            judge.least[kind] = float(r["p"])
    return judge


def _with_spans(df: DataFrame, judge: Judge) -> DataFrame:
    """df: t, the text; adds base and spans: arrays of (n, start, end), by kind as listed, then start, then end."""
    df = _with_base(df)
    parts = ", ".join(f"transform(strict_{k}, x -> named_struct('n', {i}, 'start', x.start, 'end', x.end))" for i, k in enumerate(KINDS))
    df = df.withColumn("base", F.expr(f"concat({parts})"))
    if judge.least:
        least = "case x.kind " + " ".join(f"when '{k}' then {v}D" for k, v in judge.least.items()) + " else 2.0D end"
        number = "case x.kind " + " ".join(f"when '{k}' then {i}" for i, k in enumerate(ALL_KINDS)) + " end"
        told = f"transform(filter(proposed, x -> size(x.met) = 0), x -> named_struct('n', {number}, 'start', x.start, 'end', x.end, 'least', {least}, 'f', {_FEATURES}))"
        df = _with_proposals(df).withColumn("told", F.expr(told))
        chance = re.sub(r"\bf\[", "c.f[", judge.chance())
        more = f"transform(filter(told, c -> {chance} >= c.least), c -> named_struct('n', c.n, 'start', c.start, 'end', c.end))"
        df = df.withColumn("spans", F.expr(f"array_sort(array_union(base, {more}))"))
    else:
        df = df.withColumn("spans", F.col("base"))
    return df


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")).alias("t")


_NAMES = "element_at(array(" + ", ".join(f"'{k}'" for k in ALL_KINDS) + "), s.n + 1)"


def _listed(name: str) -> Column:
    return F.expr(f"array_join(transform({name}, s -> concat_ws(':', {_NAMES}, cast(s.start as string), cast(s.end as string))), ',')")


def found(documents: DataFrame, judge: Judge | None = None) -> DataFrame:
    """doc_id, the number of base spans of each kind, the digest of the base spans and all spans as text."""
    df = _with_spans(documents.select("doc_id", _text("text")), judge or fitted(documents))
    counts = [F.expr(f"cast(size(filter(base, s -> s.n = {i})) as bigint)").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return df.select("doc_id", *counts, F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("spans").alias("spans"))


def redacted(documents: DataFrame, judge: Judge | None = None) -> DataFrame:
    """The documents with each selected span replaced by its kind in brackets (overlapping spans by the first one's) and n_chars brought up to date."""
    names = documents.columns
    rows = documents.select(F.struct(*(documents[f"`{c}`"].alias(f"c{k}") for k, c in enumerate(names))).alias("row"), _text("text"))
    df = _with_spans(rows, judge or fitted(documents))
    df = df.withColumn("ordered", F.expr("array_sort(transform(spans, s -> named_struct('start', s.start, 'end', s.end, 'n', s.n)))"))
    parts = (
        "aggregate(ordered, named_struct('at', 0, 'out', cast(array() as array<string>)), (a, s) -> if(s.start >= a.at, "
        f"named_struct('at', s.end, 'out', concat(a.out, array(substring(t, a.at + 1, s.start - a.at), concat('[', upper({_NAMES}), ']')))), "
        "named_struct('at', greatest(a.at, s.end), 'out', a.out)), a -> array_join(array_append(a.out, substring(t, a.at + 1)), ''))"
    )
    some = F.size("spans") > 0
    df = df.withColumn("clean", F.when(some, F.expr(parts)))
    new = {"text": lambda old: F.when(some, F.col("clean")).otherwise(old), "n_chars": lambda old: F.when(some, F.length("clean").cast("long")).otherwise(old)}
    return df.select(*(new.get(c, lambda old: old)(F.col(f"row.c{k}")).alias(c) for k, c in enumerate(names)))
