"""Near-duplicate texts by improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard similarity.

Shingles are runs of five words. The weight of a shingle in a text is (1 + ln tf) * idf. Document frequencies are exact and over all documents: a shingle found in
more than the share COMMON of them must be that frequent in some chunk of documents too, so a first pass names the candidates of each chunk, a second
one counts them everywhere. idf falls from 1 + SPAN, for shingles up to that share, to 1, for one that all documents have; the narrow span keeps
a template's copies alike even where they are a third of the corpus.

Equal texts are one node, named by the hash of the text. A node's signature has BANDS * ROWS samples; nodes that agree in a band meet. In each bucket every node
is paired with the smallest one and with the one that meets the most nodes in all; pairs are compared by their whole texts, links joined to components. Then, in
buckets whose nodes still lie in several components, each node outside the bucket's largest component is paired with all those of other components,
and compared too, in blocks that emit links only, unless the sums of weights or longer signatures of those nodes rule it out (a pair at the threshold
fails that test once in some 100,000 times; it shares no band once in 600). So no bucket's pairs are ever listed, and a node is left apart only if it was held against all it met.

Cases. Null text counts as empty. Texts without words link with nothing and are kept. A text of one to four words is one shingle. Rows that repeat both id and text are one
document; one id with several texts is several documents, and of those with the smallest id of a class the one of the smallest text hash stays.
Rows without id have a class of their own text and no class_id, unless the class has an id. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.llm.common import bounded_batches, collected, components, dropped, joined_once, trimmed, written
from callweave.llm.textblocks import grams, mixed, word_slices

SHINGLE, LEAST = 5, 0.8
BANDS, ROWS = 9, 3
COMMON, SPAN = 0.001, 0.1
#: Documents of a chunk in which candidates for common shingles are looked for; and candidates counted in one pass.
CHUNK_DOCUMENTS, PASS_CANDIDATES = 8000, 1_000_000
#: Samples that two signatures, and two of LONG samples, must share before residual pairs are compared.
AGREE, LONG, LONG_AGREE = 12, 128, 80
#: Nodes of either side of a block of a bucket.
BLOCK_OTHERS, BLOCK_NODES = 128, 512
CALL_ROWS = 2000
_BLOCK = ["band", "key", "bx", "by"]


def _distinct(shingles: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each shingle once for its document, with its count, in the order of documents."""
    _, first, count = np.unique(shingles ^ mixed(doc.astype(np.uint64) + np.uint64(1)), return_index=True, return_counts=True)
    times = np.zeros(len(shingles), np.int64)
    times[first] = count
    at = times > 0
    return shingles[at], doc[at], times[at]


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    documents = 0
    spare: tuple[list[np.ndarray], int] = ([], 0)

    def out(parts: list[np.ndarray], n: int) -> pa.RecordBatch:
        unique, count = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        return pa.RecordBatch.from_arrays([pa.array(unique[count > COMMON * n].view(np.int64))], names=["h"])

    for batch in batches:
        for words in word_slices(batch.column(0)):
            shingles, doc = grams(words, SHINGLE)
            held.append(_distinct(shingles, doc)[0])
            documents += words.hi - words.lo
            if documents >= CHUNK_DOCUMENTS:
                if spare[1]:
                    yield out(*spare)
                spare, held, documents = (held, documents), [], 0
    yield out(spare[0] + held, spare[1] + documents)


def common_shingles(documents: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """(hashes, sorted; their document frequencies; number of documents). At most mean shingles / COMMON hashes are common, however large the corpus."""
    spark = documents.sparkSession
    texts = documents.select(F.col("text").cast("string").alias("text"))
    n = texts.count()
    few = texts.coalesce(max(1, n // CHUNK_DOCUMENTS))
    candidates = written(few.mapInArrow(trimmed(_candidates), "h long").distinct())
    passes = max(1, -(-candidates.count() // PASS_CANDIDATES))
    keys, counts = [], []
    for part in range(passes):
        chosen = candidates.where(F.pmod("h", F.lit(passes)) == part).toPandas()["h"].to_numpy(np.int64).view(np.uint64)
        sent = spark.sparkContext.broadcast(np.sort(chosen))

        def count(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            table = sent.value
            total = np.zeros(len(table), np.int64)
            for batch in batches:
                for words in word_slices(batch.column(0)) if len(table) else ():
                    shingles, doc = grams(words, SHINGLE)
                    at = np.minimum(np.searchsorted(table, shingles), len(table) - 1)
                    hit = table[at] == shingles
                    total += np.bincount(np.searchsorted(table, _distinct(shingles[hit], doc[hit])[0]), minlength=len(table))
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(table[some].view(np.int64)), pa.array(total[some])], names=["h", "c"])

        if len(chosen):
            got = texts.mapInArrow(trimmed(count), "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") > COMMON * n).toPandas()
            keys.append(got["h"].to_numpy(np.int64).view(np.uint64))
            counts.append(got["c"].to_numpy(np.int64))
    keys, counts = (np.concatenate(keys), np.concatenate(counts)) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    order = np.argsort(keys)
    return keys[order], counts[order], n


class Weights:
    def __init__(self, keys: np.ndarray, counts: np.ndarray, documents: int):
        self.keys = keys
        self.idf = 1 + SPAN * np.log(np.maximum(1, documents) / np.maximum(1, counts)) / np.log(1 / COMMON)

    def __call__(self, words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(shingle, document, weight), by document."""
        shingles, doc, times = _distinct(*grams(words, SHINGLE))
        idf = np.full(len(shingles), 1 + SPAN)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, shingles), len(self.keys) - 1)
            hit = self.keys[at] == shingles
            idf[hit] = self.idf[at[hit]]
        return shingles, doc, (1 + np.log(times)) * idf


def samples(shingles: np.ndarray, weight: np.ndarray, starts: np.ndarray, number: int) -> np.ndarray:
    """Improved consistent weighted samples: a row of number hashes for each group of shingles that begins at starts.

    For shingle s and sample k, uniform draws that depend on both give r and c, gamma of shape 2, and b; t = floor(ln w / r + b), ln a = ln c - r (t - b) - r.
    The shingle of the least a, together with t, is the sample: two groups share it with the probability of their weighted Jaccard similarity.
    """
    out = np.empty((len(starts), number), np.uint64)
    log_w = np.log(weight).astype(np.float32)
    scale = np.float32(2.0**-24)
    for k in range(number):
        x = mixed(shingles + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        y = mixed(x ^ np.uint64(0xD1B54A32D192ED03))
        u = [((v >> np.uint64(s)) & np.uint64(0xFFFFFF)).astype(np.float32) * scale + scale for v, s in ((x, 0), (x, 24), (y, 0), (y, 24))]
        b = ((x >> np.uint64(48)) ^ ((y >> np.uint64(48)) << np.uint64(8))).astype(np.uint64) & np.uint64(0xFFFFFF)
        b = b.astype(np.float32) * scale
        r = -np.log(np.minimum(u[0] * u[1], np.float32(0.9999999)))
        c = -np.log(np.minimum(u[2] * u[3], np.float32(0.9999999)))
        t = np.floor(log_w / r + b)
        a = np.log(c) - r * (t - b) - r
        bits = a.view(np.int32).astype(np.int64)
        rank = (np.where(bits < 0, -(bits & 0x7FFFFFFF), bits) + (1 << 31)).astype(np.uint64) << np.uint64(31)
        mark = mixed(shingles ^ mixed(t.astype(np.int64).astype(np.uint64) + np.uint64(k)))
        out[:, k] = np.minimum.reduceat(rank | (mark >> np.uint64(33)), starts)
    return out & np.uint64(0x7FFFFFFF)


def _signed(weights) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigh = weights.value
        for batch in batches:
            for words in word_slices(batch.column(2)):
                shingles, doc, weight = weigh(words)
                if not len(doc):
                    continue
                starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
                rows = doc[starts]
                sig = samples(shingles, weight, starts, BANDS * ROWS)
                bands = np.empty((len(rows), BANDS), np.uint64)
                for b in range(BANDS):
                    key = np.full(len(rows), b + 1, np.uint64)
                    for c in range(b * ROWS, (b + 1) * ROWS):
                        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, c])
                    bands[:, b] = key
                at = pa.array(rows + words.lo)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array(np.add.reduceat(weight, starts)), pa.array(list(bands.view(np.int64)), pa.list_(pa.int64())), pa.array(list(sig.astype(np.int32)), pa.list_(pa.int32()))],
                    names=["node", "doc_id", "sum", "bands", "signature"],
                )

    return run


def _similar(weights, least: float) -> object:
    """Of rows (a, b, text a, text b) the pairs whose weighted Jaccard similarity is least or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigh = weights.value
        for batch in batches:
            sizes = np.cumsum(np.add(*(np.diff(np.frombuffer(c.cast(pa.large_string()).buffers()[1], np.int64)[c.offset : c.offset + len(c) + 1]) if len(c) else np.zeros(0, np.int64) for c in (batch.column(2), batch.column(3)))))
            lo, good = 0, []
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + (1 << 21), "right")))
                n = hi - lo
                sides = [weigh(next(word_slices(batch.column(c).slice(lo, n), 1 << 62))) for c in (2, 3)]
                keys = np.concatenate([s ^ mixed(d.astype(np.uint64) + np.uint64(1)) for s, d, _ in sides])
                row = np.concatenate([d for _, d, _ in sides])
                unique, first, back = np.unique(keys, return_index=True, return_inverse=True)
                cut = len(sides[0][0])
                left = np.bincount(back[:cut], weights=sides[0][2], minlength=len(unique))
                right = np.bincount(back[cut:], weights=sides[1][2], minlength=len(unique))
                shared = np.bincount(row[first], weights=np.minimum(left, right), minlength=n)
                union = np.bincount(row[first], weights=np.maximum(left, right), minlength=n)
                good.append(lo + np.flatnonzero(shared >= (least - 1e-9) * np.maximum(union, 1e-300)))
                lo = hi
            at = pa.array(np.concatenate(good) if good else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], names=["a", "b"])

    return run


def _texts(documents: DataFrame, nodes: DataFrame, needed: DataFrame) -> DataFrame:
    """node and text of the needed nodes, each from the row of its smallest id, so the copies of a text are dealt by their ids and never meet."""
    first = nodes.select("node", "doc_id").join(needed, "node", "left_semi").select(F.col("node").alias("_n"), F.col("doc_id").alias("_d"))
    own = documents.select(F.xxhash64("text").alias("node"), "doc_id", "text")
    one = own.join(first, (F.col("node") == F.col("_n")) & F.col("doc_id").eqNullSafe(F.col("_d")), "left_semi")
    return one.groupBy("node").agg(F.first("text").alias("text"))


def _links(pairs: DataFrame, documents: DataFrame, nodes: DataFrame, weights, least: float) -> DataFrame:
    """The pairs (a, b) of nodes that are similar; a written table. Each node's text is read once, then goes to its pairs."""
    pairs = written(pairs)
    needed = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    texts = written(_texts(documents, nodes, needed))
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    collected(pairs.sparkSession)
    out = written(both.select("a", "b", "text_a", "text_b").mapInArrow(trimmed(_similar(weights, least)), "a long, b long"))
    dropped(texts)
    dropped(pairs)
    return out


def classes(documents: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, node, class_id, the smallest id of the class, and class_node, the node of that id that stays, of every row; rows in the order of no column."""
    spark = documents.sparkSession
    bounded_batches(spark)
    texts = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    weights = spark.sparkContext.broadcast(Weights(*common_shingles(texts)))
    rows = written(texts.select(F.xxhash64("text").alias("node"), "doc_id", "text").mapInArrow(trimmed(_signed(weights)), f"node long, doc_id {kind}, sum double, bands array<long>, signature array<int>"))
    nodes = written(rows.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), F.min(F.struct("sum", "bands", "signature")).alias("s")).select("node", "doc_id", "copies", "s.*"))
    entries = nodes.select("node", "sum", F.posexplode("bands").alias("band", "key"))
    shared = entries.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = written(joined_once(entries, shared.withColumn("copies", F.col("n")), ["band", "key"]))
    known = met.groupBy("node").agg(F.sum("n").alias("meets"))
    ends = met.join(known, "node").groupBy("band", "key").agg(F.min(F.struct("node", "sum")).alias("low"), F.max(F.struct("meets", "node", "sum")).alias("hub"), F.count(F.lit(1)).alias("copies"))
    ends = written(ends.select("band", "key", "low", F.struct("hub.node", "hub.sum").alias("hub"), "copies"))
    near = lambda one, two: F.least(one, two) >= (least - 1e-9) * F.greatest(one, two)
    ended = joined_once(met, ends, ["band", "key"]).select("node", "sum", F.explode(F.array_distinct(F.array("low", "hub"))).alias("e")).where((F.col("node") != F.col("e.node")) & near(F.col("sum"), F.col("e.sum")))
    first = ended.select(F.least("node", "e.node").alias("a"), F.greatest("node", "e.node").alias("b")).distinct()
    found = _links(first, texts, nodes, weights, least)
    parts = written(components(found))
    collected(spark)
    more = written(_residual(nodes.select("node", "signature").join(met.drop("n"), "node"), parts, texts, nodes, weights, least))
    parts = written(components(found.unionByName(more))) if more.head(1) else parts
    collected(spark)
    named = nodes.join(parts, F.col("node") == F.col("id"), "left").select("node", "doc_id", "copies", F.coalesce("component", "node").alias("component"))
    ids = named.groupBy("component").agg(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "node"))).alias("first"))
    by_node = named.join(ids, "component").select("node", "copies", F.col("first.doc_id").alias("class_id"), F.col("first.node").alias("class_node"))
    out = joined_once(rows.select("node", "doc_id"), by_node, ["node"])
    out = out.select("doc_id", "node", "class_id", "class_node")
    node = F.xxhash64("text")
    empty = texts.where(~F.col("text").rlike("[^\\x20\\x09-\\x0D]")).select("doc_id", node.alias("node"), F.col("doc_id").alias("class_id"), node.alias("class_node"))
    return out.unionByName(empty)


def _residual(met: DataFrame, parts: DataFrame, texts: DataFrame, nodes: DataFrame, weights, least: float) -> DataFrame:
    """Links between nodes that meet in a bucket and lie in different components, one of them outside the bucket's largest component."""
    full = met.join(parts, F.col("node") == F.col("id"), "left").select("band", "key", "node", "sum", "signature", F.coalesce("component", "node").alias("component"))
    sizes = full.groupBy("band", "key", "component").count()
    bulk = sizes.groupBy("band", "key").agg(F.max(F.struct("count", "component")).alias("top"), F.count(F.lit(1)).alias("parts"), F.sum("count").alias("n")).where("parts > 1")
    bulk = bulk.select("band", "key", F.col("top.component").alias("bulk"), F.ceil((F.col("n") - F.col("top.count")) / BLOCK_OTHERS).alias("nx"), F.ceil(F.col("n") / BLOCK_NODES).alias("ny"))
    apart = written(full.join(bulk, ["band", "key"]))
    # only nodes whose short signatures leave a pair open get longer ones and bring their shingles
    open_ = written(_blocks(apart, []).applyInArrow(_block_open(least), "node long").distinct())
    ready = written(_texts(texts, nodes, open_).mapInArrow(trimmed(_prepared(weights)), "node long, long binary, keys binary, odd binary, values binary"))
    return _blocks(apart.join(ready, "node"), ["long", "keys", "odd", "values"]).applyInArrow(_block_links(least), "a long, b long").distinct()


def _blocks(apart: DataFrame, more: list[str]):
    """The nodes outside each bucket's largest component, and all its nodes, in blocks of bounded size, each of one with each of the other."""
    columns = ["node", "sum", "signature", "component", *more]
    others = apart.where("component <> bulk").select("band", "key", F.pmod("node", "nx").alias("bx"), F.explode(F.expr("sequence(0L, ny - 1)")).alias("by"), *columns)
    members = apart.select("band", "key", F.explode(F.expr("sequence(0L, nx - 1)")).alias("bx"), F.pmod("node", "ny").alias("by"), *columns)
    # most blocks are tiny, so a task's call gets many of them
    calls = max(1, members.count() // CALL_ROWS)
    others, members = (d.withColumn("call", F.pmod(F.xxhash64(*_BLOCK), F.lit(calls))) for d in (others, members))
    others = others.toDF(*(f"x_{c}" for c in others.columns))
    return others.groupBy("x_call").cogroup(members.groupBy("call"))


class _Side:
    def __init__(self, table: pa.Table):
        self.nodes, self.sums, self.parts = (table[c].to_numpy() for c in ("node", "sum", "component"))
        self.short = table["signature"].combine_chunks().flatten().to_numpy().reshape(-1, BANDS * ROWS)

    def only(self, rows: np.ndarray) -> _Side:
        out = copy.copy(self)
        out.nodes, out.sums, out.parts, out.short = self.nodes[rows], self.sums[rows], self.parts[rows], self.short[rows]
        return out

    def open_to(self, other: _Side, j: int, band: int, least: float) -> np.ndarray:
        """Rows that row j of other may be linked to; pairs that met in an earlier band are that one's."""
        same = self.short == other.short[j]
        at = np.flatnonzero((same.sum(1) >= AGREE) & (self.parts != other.parts[j]) & (np.minimum(self.sums, other.sums[j]) >= (least - 1e-9) * np.maximum(self.sums, other.sums[j])))
        return at[~same[at].reshape(len(at), BANDS, ROWS).all(2)[:, :band].any(1)]


def _named(table: pa.Table) -> pa.Table:
    return table.rename_columns([c.removeprefix("x_") for c in table.column_names])


def _each_block(left: pa.Table, right: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(band, rows of left, rows of right) of the blocks that both have."""
    sides = [t.select(_BLOCK).to_pandas().groupby(_BLOCK).indices for t in (left, right)]
    for key, rows in sides[0].items():
        if key in sides[1]:
            yield key[0], rows, sides[1][key]


def _block_open(least: float) -> object:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[np.ndarray] = []
        if left.num_rows and right.num_rows:
            left = _named(left)
            one, two = _Side(left), _Side(right)
            for band, rows, others in _each_block(left, right):
                here, there = one.only(rows), two.only(others)
                for j in range(len(rows)):
                    at = there.open_to(here, j, band, least)
                    if len(at):
                        found += [there.nodes[at], here.nodes[j : j + 1]]
        return pa.table([pa.array(np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64))], names=["node"])

    return run


def _prepared(weights) -> object:
    """Long signature, shingles in order, and places and weights of those that don't weigh 1 + SPAN, as those do that are rare and stand once, of each text, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in word_slices(batch.column(1)):
                shingles, doc, weight = weights.value(words)
                starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
                long = samples(shingles, weight, starts, LONG).astype(np.int32)
                order = np.lexsort((shingles, doc))
                shingles, weight, ends = shingles[order], weight[order], np.append(starts[1:], len(doc))
                rare = weight != 1 + SPAN
                parts = [
                    (row.tobytes(), shingles[lo:hi].tobytes(), np.flatnonzero(rare[lo:hi]).astype(np.int32).tobytes(), weight[lo:hi][rare[lo:hi]].tobytes())
                    for row, lo, hi in zip(long, starts, ends, strict=True)
                ]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc[starts] + words.lo)), *(pa.array(list(c), pa.binary()) for c in zip(*parts, strict=True))], names=["node", "long", "keys", "odd", "values"])

    return run


def _block_links(least: float) -> object:
    def read(table: pa.Table) -> tuple[np.ndarray, list, list]:
        long = np.frombuffer(b"".join(table["long"].to_pylist()), np.int32).reshape(-1, LONG)
        return long, table["keys"].to_pylist(), list(zip(table["odd"].to_pylist(), table["values"].to_pylist(), strict=True))

    def shingles(keys: bytes, odd: tuple[bytes, bytes]) -> tuple[np.ndarray, np.ndarray]:
        own = np.frombuffer(keys, np.uint64)
        weight = np.full(len(own), 1 + SPAN)
        weight[np.frombuffer(odd[0], np.int32)] = np.frombuffer(odd[1])
        return own, weight

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int]] = []
        if left.num_rows and right.num_rows:
            left = _named(left)
            one_all, two_all, (long_one, keys_one, values_one), (long_two, keys_two, values_two) = _Side(left), _Side(right), read(left), read(right)
            for band, rows, others in _each_block(left, right):
                one, two = one_all.only(rows), two_all.only(others)
                for j, row in enumerate(rows.tolist()):
                    at = two.open_to(one, j, band, least)
                    if not len(at):
                        continue
                    keys, values = shingles(keys_one[row], values_one[row])
                    for k in at[(long_two[others[at]] == long_one[row]).sum(1) >= LONG_AGREE]:
                        other, more = shingles(keys_two[others[k]], values_two[others[k]])
                        place = np.minimum(np.searchsorted(keys, other), len(keys) - 1)
                        hit = keys[place] == other
                        shared = np.minimum(values[place[hit]], more[hit]).sum()
                        if shared >= (least - 1e-9) * (one.sums[j] + two.sums[k] - shared):
                            out.append((int(min(one.nodes[j], two.nodes[k])), int(max(one.nodes[j], two.nodes[k]))))
        return pa.table([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["a", "b"])

    return run


def _judged(documents: DataFrame, least: float) -> DataFrame:
    """classes() and kept: whether the row's document, its id and text, is the one of its class that stays."""
    same = (F.col("doc_id") == F.col("class_id")) & (F.col("node") == F.col("class_node"))
    return classes(documents, least).withColumn("kept", F.col("doc_id").isNull() | F.coalesce(same, F.lit(False)))


def near_duplicates(documents: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, class_id and kept: whether the row's document is the one of its class that stays (rows without id always stay)."""
    return _judged(documents, least).select("doc_id", "class_id", "kept")


def deduplicated(documents: DataFrame, least: float = LEAST) -> DataFrame:
    """The documents that stay, one of each class, with all their columns; rows that repeat id and text are one."""
    gone = _judged(documents, least).where(~F.col("kept")).select("doc_id", "node").distinct()
    names = documents.columns
    row = F.struct(*(documents[f"`{c}`"].alias(f"c{k}") for k, c in enumerate(names)))
    rows = documents.select(row.alias("row"), "doc_id", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("node"))
    stay = rows.join(gone, ["doc_id", "node"], "left_anti")
    ids = rows.where("doc_id is not null").select("doc_id")
    if ids.count() != ids.distinct().count():
        stay = stay.where("doc_id is not null").dropDuplicates(["doc_id", "node"]).unionByName(stay.where("doc_id is null"))
    return stay.select(*(F.col(f"row.c{k}").alias(c) for k, c in enumerate(names)))
