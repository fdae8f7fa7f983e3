"""Language-model scoring with a log-bilinear model trained in numpy by noise-contrastive estimation.

Words fall into classes: each of the most frequent ones has its own, the closing token too, and the others share classes by their last three bytes; classes are
dealt to groups. The model predicts the next token's group and then its class within the group from the CONTEXT classes before it: the context vector is the
sum of their vectors, each weighted by its place; a group, and a class in its group, scores its product with that vector plus a bias. Each level is
normalised by batched matrix products; multiplied by the smoothed share of the word within its class that is a proper distribution over all known words and
one unknown word in each class.

Training goes in rounds over all training tokens. A hash of id and text deals each document to a round and there to a shard of about SHARD_TOKENS tokens; every
shard is learnt from the round's start in the order of that hash, and the mean of the shards' parameters, weighted by tokens, starts the next round. So the
model depends on the documents alone, not on how they lie in files or tasks.

The smoothed unigram score stands beside it. Counts are exact and over all training documents, keyed by a 64-bit hash of the word. The words above a stated share
of all tokens, at most the inverse of that share in number, go to every task; the counts of the others are joined by hash.

Cases. Null or empty text: the closing token alone. Repeated rows: each is counted and scored; copies of one row that make up more than the share HOT of all
are dealt to several shards. Null doc_id: fold 0, a training document. No training documents: N and V are 0, the base score of a token is that of 1 / 1, the
model is uniform over classes. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.llm.common import HOT, bounded_batches, crc_fold, trimmed, written
from callweave.llm.textblocks import mixed, word_slices

GROUPS, MEMBERS, SHARED, WIDTH, CONTEXT = 16, 64, 256, 24, 6
CLASSES = GROUPS * MEMBERS
OWN, END = CLASSES - SHARED - 1, CLASSES - 1
NOISE, BATCH, RATE = 16, 4096, 0.2
ROUNDS, SHARD_TOKENS = 4, 1_000_000
#: Words of at least this share of all training tokens go to every task; so at most a million.
FREQUENT = 1e-6
_MERGE = 3_000_000


def _summed(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys = np.concatenate([p[0] for p in parts])
    unique, at, back = np.unique(keys, return_index=True, return_inverse=True)
    return unique, np.bincount(back, weights=np.concatenate([p[1] for p in parts]), minlength=len(unique)).astype(np.int64), np.concatenate([p[2] for p in parts])[at]


def _shared_class(words) -> np.ndarray:
    """OWN + the class of the word's last three bytes, A-Z lower-cased."""
    value = np.zeros(len(words.begin), np.uint64)
    for back in range(3):
        at = words.end - back
        byte = np.where(at >= words.begin, words.data[np.maximum(at, 0)], 0).astype(np.uint64)
        byte += np.where((byte >= 65) & (byte <= 90), np.uint64(32), np.uint64(0))
        value = value * np.uint64(256) + byte
    return (OWN + (mixed(value + np.uint64(1)) % np.uint64(SHARED)).astype(np.int64)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, ...]] = []

    def out(part):
        return pa.RecordBatch.from_arrays([pa.array(part[0].view(np.int64)), pa.array(part[1]), pa.array(part[2].astype(np.int32))], names=["h", "c", "class"])

    for batch in batches:
        for words in word_slices(batch.column(0)):
            if len(words.hashes):
                held.append(_summed([(words.hashes, np.ones(len(words.hashes)), _shared_class(words))]))
        if sum(len(p[0]) for p in held) > _MERGE:
            held = [_summed(held)]
            if len(held[0][0]) > _MERGE // 2:
                yield out(held.pop())
    if held:
        yield out(_summed(held))


class Classes:
    """Numbers of words' own classes."""

    def __init__(self, own: list[int]):
        keys = np.array(own, np.int64).view(np.uint64)
        order = np.argsort(keys)
        self.keys, self.number = keys[order], np.arange(len(keys))[order]

    def of(self, words) -> np.ndarray:
        out = _shared_class(words)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, words.hashes), len(self.keys) - 1)
            own = self.keys[at] == words.hashes
            out[own] = self.number[at[own]]
        return out

    def sequence(self, words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(class, the CONTEXT classes before it, document) of all tokens, each document closed by END; END stands before its start too."""
        n = len(words.counts)
        size = words.counts + 1
        ends = np.cumsum(size) - 1
        total = int(size.sum())
        target = np.full(total, END, np.int64)
        inner = np.ones(total, bool)
        inner[ends] = False
        target[inner] = self.of(words)
        place = np.arange(total) - np.repeat(ends - size + 1, size)
        before = np.full((total, CONTEXT), END, np.int64)
        for k in range(min(CONTEXT, total)):
            before[k + 1 :, k] = np.where(place[k + 1 :] > k, target[: total - k - 1], END)
        return target, before, np.repeat(np.arange(n), size)


class Bilinear:
    """vectors: of classes in contexts; places: weights of the places before; tops, top_bias: of groups; outs, bias: of classes within their group.

    Class c is member c // GROUPS of group c % GROUPS, so groups have much the same share of tokens.
    """

    def __init__(self, prior: np.ndarray):
        rng = np.random.default_rng(3)
        of_group = prior.reshape(MEMBERS, GROUPS)
        self.top_noise = of_group.sum(0)
        self.noise = of_group / self.top_noise
        draw = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        self.vectors, self.places, self.tops, self.outs = draw(CLASSES, WIDTH), np.ones((CONTEXT, WIDTH), np.float32), draw(GROUPS, WIDTH), draw(MEMBERS, GROUPS, WIDTH)
        self.top_bias, self.bias = np.log(self.top_noise).astype(np.float32), np.log(self.noise).astype(np.float32)
        self.squares = [np.full_like(p, 1e-4) for p in self._all()]

    def _all(self) -> list[np.ndarray]:
        return [self.vectors, self.places, self.tops, self.outs, self.top_bias, self.bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self._all()]).astype(np.float64)

    def load(self, values: np.ndarray) -> None:
        at = 0
        for p in self._all():
            p[...] = values[at : at + p.size].reshape(p.shape)
            at += p.size

    def context(self, before: np.ndarray) -> np.ndarray:
        """The context vectors: the classes' vectors are weighted first, as there are fewer of them than tokens."""
        q = (self.vectors * self.places[0]).take(before[:, 0], axis=0)
        for k in range(1, CONTEXT):
            q += (self.vectors * self.places[k]).take(before[:, k], axis=0)
        return q

    @staticmethod
    def _contrast(q, target, noise, out, bias, prior, d_out, d_bias) -> np.ndarray:
        """Noise-contrastive estimation for rows q that all draw on the same outputs: target rows are told from the noise drawn. Adds gradients, returns that of q."""
        shift = np.log(len(noise) * prior).astype(np.float32)
        own, level = out.take(target, axis=0), bias - shift
        good = 1 - _sigmoid(np.einsum("ij,ij->i", q, own) + level.take(target))
        bad = -_sigmoid(q @ out[noise].T + level[noise])
        np.add.at(d_out, noise, bad.T @ q)
        hot = np.zeros((len(out), len(target)), np.float32)
        hot[target, np.arange(len(target))] = good
        d_out += hot @ q
        d_bias += hot.sum(1)
        np.add.at(d_bias, noise, bad.sum(0))
        own *= good[:, None]
        own += bad @ out[noise]
        return own

    def learn(self, target: np.ndarray, before: np.ndarray, rng: np.random.Generator) -> None:
        """One step over a batch of tokens: groups, and in each group its classes, are told from draws of their shares, which the batch meets together."""
        # tokens of a group stand together
        group = target % GROUPS
        order = np.argsort(group.astype(np.int16), kind="stable")
        group, member, before = group.take(order), (target // GROUPS).take(order), before.take(order, axis=0)
        n, q = len(target), self.context(before)
        grads = [np.zeros_like(p) for p in self._all()]
        d_vectors, d_places, d_tops, d_outs, d_top_bias, d_bias = grads
        dq = self._contrast(q, group, rng.choice(GROUPS, NOISE, p=self.top_noise), self.tops, self.top_bias, self.top_noise, d_tops, d_top_bias)
        ends = np.cumsum(np.bincount(group, minlength=GROUPS))
        draws = rng.random((GROUPS, NOISE))
        for g in range(GROUPS):
            rows = slice(ends[g - 1] if g else 0, ends[g])
            if rows.start < rows.stop:
                noise = np.minimum(np.searchsorted(np.cumsum(self.noise[:, g]), draws[g]), MEMBERS - 1)
                dq[rows] += self._contrast(q[rows], member[rows], noise, self.outs[:, g], self.bias[:, g], self.noise[:, g], d_outs[:, g], d_bias[:, g])
        for k in range(CONTEXT):
            at = before[:, k].astype(np.int16)
            by = np.argsort(at, kind="stable")
            at = at[by]
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            met, sums = at[first], np.add.reduceat(dq.take(by, axis=0), first, axis=0)
            d_places[k] = np.einsum("ij,ij->j", sums, self.vectors[met])
            sums *= self.places[k]
            d_vectors[met] += sums
        for p, s, d in zip(self._all(), self.squares, grads, strict=True):
            d /= n
            s += d * d
            p += RATE * d / np.sqrt(s)

    def log10_probabilities(self, target: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Of each target, normalised over groups and over the classes of its group."""
        out = np.empty(len(target))
        for lo in range(0, len(target), 16_384):
            own, q = target[lo : lo + 16_384], self.context(before[lo : lo + 16_384])
            group, member = own % GROUPS, own // GROUPS
            part = _log_share(self.tops @ q.T + self.top_bias[:, None], group)
            order = np.argsort(group.astype(np.int16), kind="stable")
            ends = np.cumsum(np.bincount(group, minlength=GROUPS))
            for g in range(GROUPS):
                rows = order[(ends[g - 1] if g else 0) : ends[g]]
                if len(rows):
                    part[rows] += _log_share(self.outs[:, g] @ q.take(rows, axis=0).T + self.bias[:, g, None], member[rows])
            out[lo : lo + 16_384] = part
        return out / math.log(10)


def _log_share(scores: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """scores: a row for each outcome, a column for each token, so that sums and maxima run along whole rows."""
    top = scores.max(0)
    mine = scores[chosen, np.arange(len(chosen))]
    scores -= top
    return mine.astype(np.float64) - top - np.log(np.add.reduce(np.exp(scores, out=scores), axis=0, dtype=np.float64))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(-x)); beyond 80 it is 0 or 1 in single precision anyway."""
    np.clip(x, -80, 80, out=x)
    np.exp(np.negative(x, out=x), out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Model:
    """What tasks need to score: the classes, the network, the frequent words' counts and the sizes of the shared classes."""

    def __init__(self, classes: Classes, net: Bilinear, keys: np.ndarray, counts: np.ndarray, least: int, tokens: int, distinct: int, class_tokens: np.ndarray, class_words: np.ndarray, closings: int):
        order = np.argsort(keys.view(np.uint64))
        self.classes, self.net, self.keys, self.counts = classes, net, keys.view(np.uint64)[order], counts[order]
        self.least, self.tokens, self.distinct, self.closings = least, tokens, distinct, closings
        self.class_norm = np.log10(class_tokens + class_words + 1.0)


def fit(documents: DataFrame, counts: DataFrame, closings: int) -> Model:
    """documents: those to learn from; counts: h, c, class of all their words, a written table; closings: their number."""
    spark = documents.sparkSession
    facts = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    tokens, distinct = int(facts["n"]) + closings, int(facts["v"]) + (closings > 0)
    own = [(r["h"], r["c"]) for r in counts.orderBy(F.desc("c"), "h").limit(OWN).collect()]
    classes = Classes([h for h, _ in own])
    class_tokens, class_words = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in counts.groupBy("class").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect():
        class_tokens[r["class"]], class_words[r["class"]] = r["c"], r["v"]
    inside = {r["h"]: r["class"] for r in counts.where(F.col("h").isin([h for h, _ in own])).collect()} if own else {}
    for k, (h, c) in enumerate(own):
        class_tokens[k] = c
        class_tokens[inside[h]] -= c
        class_words[inside[h]] -= 1
    class_tokens[END] = closings
    net = Bilinear((class_tokens + 1) / (class_tokens + 1).sum())
    dealt = _dealt(documents, max(1, -(-tokens // (ROUNDS * SHARD_TOKENS))))
    for at in range(ROUNDS):
        _round(dealt.where(F.col("round") == at).select("shard", "h", "text"), classes, net)
    least = max(1, math.ceil(tokens * FREQUENT))
    often = counts.where(F.col("c") >= least).select("h", "c").toPandas()
    return Model(classes, net, often["h"].to_numpy(np.int64), often["c"].to_numpy(np.int64), least, tokens, distinct, class_tokens, class_words, closings)


def _dealt(documents: DataFrame, shards: int) -> DataFrame:
    """text, h (a hash of id and text), round and shard of the documents."""
    rows = documents.select(F.xxhash64("doc_id", F.lit(11), "text").alias("h"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("salt", F.lit(0).cast("long"))
    if shards > 1:
        most = max(2.0, HOT * documents.count())
        hot = written(rows.groupBy("h").agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") >= most))  # 1 / HOT at most; counted once for all rounds
        rows = rows.join(F.broadcast(hot), "h", "left").withColumn("salt", F.when(F.col("copies").isNotNull(), F.pmod(F.monotonically_increasing_id(), F.lit(shards))).otherwise(0)).drop("copies")
    return rows.select("text", "h", F.pmod(F.xxhash64("h", "salt", F.lit(1)), F.lit(ROUNDS)).alias("round"), F.pmod(F.xxhash64("h", "salt", F.lit(2)), F.lit(shards)).alias("shard"))


def _round(rows: DataFrame, classes: Classes, net: Bilinear) -> None:
    """Trains net on the shards of a round's rows and loads the mean."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast((classes, net))

    def train(table: pa.Table) -> pa.Table:
        known, start = sent.value
        own = Bilinear.__new__(Bilinear)
        own.__dict__ = {k: [x.copy() for x in v] if isinstance(v, list) else v.copy() for k, v in start.__dict__.items()}
        table = table.sort_by("h")
        rng, seen = np.random.default_rng(int(table["shard"][0].as_py()) + 1), 0
        for words in word_slices(pa.concat_arrays(table["text"].cast(pa.large_string()).chunks)):
            target, before, _ = known.sequence(words)
            order = rng.permutation(len(target))
            for lo in range(0, len(target), BATCH):
                part = order[lo : lo + BATCH]
                own.learn(target.take(part), before.take(part, axis=0), rng)
            seen += len(target)
        values = np.append(own.flat() * seen, seen)
        squares = np.concatenate([x.ravel() for x in own.squares]).astype(np.float64) * seen
        values = np.concatenate([values, squares])
        return pa.table([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], names=["i", "v"])

    got = rows.groupBy("shard").applyInArrow(train, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas().sort_values("i")["v"].to_numpy()
    if len(got):
        n = sum(p.size for p in net._all())
        net.load(got[:n] / got[n])
        lo = n + 1
        for x in net.squares:
            x[...] = (got[lo : lo + x.size] / got[n]).reshape(x.shape)
            lo += x.size


def word_counts(documents: DataFrame) -> DataFrame:
    """h, c, class: exact counts of all words, a written table."""
    return written(documents.select(F.col("text").cast("string")).mapInArrow(trimmed(_count), "h long, c long, class int").groupBy("h").agg(F.sum("c").alias("c"), F.min("class").alias("class")))


def scored(documents: DataFrame, folds: int = 7, held: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    bounded_batches(documents.sparkSession)
    learn = documents.where(crc_fold(F.col("doc_id"), folds) != held)
    counts = word_counts(learn)
    model = fit(learn, counts, learn.count())
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for words in word_slices(batch.column(2)):
                n = words.hi - words.lo
                target, before, doc = m.classes.sequence(words)
                model_part = np.bincount(doc, weights=m.net.log10_probabilities(target, before), minlength=n)
                word_doc, own = words.doc_of_word(), m.classes.of(words)
                at = np.minimum(np.searchsorted(m.keys, words.hashes), max(0, len(m.keys) - 1))
                frequent = m.keys[at] == words.hashes if len(m.keys) else np.zeros(len(words.hashes), bool)
                c = np.where(frequent, m.counts[at], 0) if len(m.keys) else np.zeros(len(words.hashes), np.int64)
                logs = np.log10(c + 1.0)
                shared = own >= OWN
                base = np.bincount(word_doc, weights=logs, minlength=n) + math.log10(m.closings + 1)
                inner = np.bincount(word_doc, weights=np.where(shared, logs - m.class_norm[own], 0.0), minlength=n)
                known = np.bincount(word_doc, weights=c > 0, minlength=n).astype(np.int64) + (m.closings > 0)
                rare = ~frequent if m.least > 1 else np.zeros(len(frequent), bool)
                sizes = np.bincount(word_doc[rare], minlength=n)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(words.hashes[rare].view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(words.lo, n), batch.column(1).slice(words.lo, n), pa.array(words.counts + 1), pa.array(known), pa.array(base), pa.array(model_part + inner), lists],
                    names=["row", "doc_id", "n_tokens", "n_known", "base", "model", "rare"],
                )

    numbered = documents.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id"), F.col("text").cast("string").alias("text"))
    kind = numbered.schema["doc_id"].dataType.simpleString()
    table = written(numbered.mapInArrow(trimmed(measure), f"row long, doc_id {kind}, n_tokens long, n_known long, base double, model double, rare array<long>"))
    # a rare word is never one of its own class, unless all are rare; then none is in the list
    looked = table.select("row", F.explode("rare").alias("h")).join(counts.where(F.col("c") < model.least).select("h", "c"), "h")
    more = looked.groupBy("row").agg(F.sum(F.log10(F.col("c") + 1.0)).alias("logs"), F.count(F.lit(1)).alias("known"))
    out = table.drop("rare").join(more, "row", "left")
    norm = math.log10(model.tokens + model.distinct + 1)
    return out.select(
        "doc_id", (crc_fold(F.col("doc_id"), folds) == held).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("logs", F.lit(0.0)) - F.col("n_tokens") * norm).alias("base_score"), (F.col("model") + F.coalesce("logs", F.lit(0.0))).alias("score"),
    )
