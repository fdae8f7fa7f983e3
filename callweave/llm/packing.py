"""Best-fit packing of token sequences.

The rounds run in bulk, one for each length, the longest first. Range-sorted, the documents are runs of equal lengths and the gaps runs of
equal sizes: at most CAPACITY runs of either, whatever the size of the corpus. In its round a length sweeps over the gaps from its successor
(the smallest gap that holds it) upwards; where many documents want one gap, their rank within their length decides who gets it; the rest
go on to the next gap and, at last, to new sequences; then the gaps shrink and the next round begins. The sweeps need the runs only, so they
pass over a table of that bounded size. Ranks and places of documents are found by all tasks: ranks by (length, hash) with the counts before
each, places by a join of the documents with the runs' moves.

Cases. Null or empty text: the closing id alone. Repeated rows: each is packed. Null doc_id: kept. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import os
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callweave.llm.common import bounded_batches, shuffle_partitions, trimmed, written
from callweave.llm.textblocks import LET_GO, buffers, dealt, taken

CAPACITY, CLOSING = 4096, 1
#: Words whose ids a worker keeps at once.
KEPT_WORDS = 250_000
#: Marks, a run of which after letters is a word of its own to the tokenizer; characters of which words that are lower-cased here have none.
MARKS, NOT_LATIN = string.punctuation, r"[^\x{0}-\x{12F}\x{131}-\x{24F}]"
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordIds:
    """Ids of a column of texts; distinct words between blanks and line ends are encoded once and then looked up.

    Those two characters are white space to the tokenizer, which never joins across it, so the ids of a text are those of its words in turn. Words of Latin
    letters, which it lower-cases, share the ids of their lower-cased form, a run of marks after them is a word of its own to it, and many such words
    are encoded at a time, as each ends with an id that ends a word. Texts in ASCII are lower-cased whole, but for those that may hold a special token.
    Words are told apart by Arrow, so only distinct ones of a batch become Python's strings.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.known = {"": 0}  # places of words in begin and size, which say where their ids stand in store
        self.begin, self.size, self.store = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, "<u4")

    def _keep(self, words: list[str], sizes: np.ndarray, ids: np.ndarray) -> None:
        self.known.update(zip(words, range(len(self.size), len(self.size) + len(words)), strict=True))
        self.begin = np.concatenate([self.begin, len(self.store) + np.cumsum(sizes) - sizes])
        self.size, self.store = np.concatenate([self.size, sizes]), np.concatenate([self.store, ids])

    def _encoded(self, texts: list[str]) -> list[list[int]]:
        return [got.ids for at in range(0, len(texts), 5000) for got in self.tokenizer.encode_batch_fast(texts[at : at + 5000], add_special_tokens=False)]

    def _whole(self, words: list[str]) -> None:
        rows = self._encoded(words)
        self._keep(words, np.fromiter(map(len, rows), np.int64, len(rows)), np.fromiter(itertools.chain.from_iterable(rows), "<u4"))

    def _joined(self, words: list[str]) -> None:
        """words: of lower-case Latin letters."""
        rows = self._encoded([" ".join(words[k : k + 200]) for k in range(0, len(words), 200)])
        ids = np.fromiter(itertools.chain.from_iterable(rows), "<u4")
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(words) or len(ids) and ends[-1] != len(ids):
            raise ValueError("a word of letters alone has ids of one word")
        self._keep(words, np.diff(ends, prepend=0), ids)

    def _places(self, column: pa.Array, letters: np.ndarray | None = None) -> np.ndarray:
        """Places of words; letters: which of them are of lower-case Latin letters."""
        coded = column.dictionary_encode()
        words, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        places = np.fromiter(map(self.known.get, words, itertools.repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(places < 0)
        if len(new):
            joined = np.zeros(len(words), bool)
            if letters is not None:
                joined[codes[letters]] = True
            for chosen, encode in ((new[joined[new]], self._joined), (new[~joined[new]], self._whole)):
                places[chosen] = np.arange(len(self.size), len(self.size) + len(chosen))
                encode([words[i] for i in chosen.tolist()])
        return places[codes]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(unsigned 32-bit ids of all texts in turn, where those of each text end). Null counts as empty."""
        if len(self.known) > KEPT_WORDS:
            self.forget()
        texts = pc.replace_substring(texts.cast(pa.large_string()).fill_null(""), "\n", " ")
        plain = pc.and_(pc.string_is_ascii(texts), pc.invert(pc.match_substring(texts, "<|")))
        split = pc.split_pattern(pc.if_else(plain, pc.ascii_lower(texts), texts), " ")
        ends = np.cumsum(pc.list_value_length(split).to_numpy())
        coded = split.flatten().dictionary_encode()
        del texts, split
        words, codes = coded.dictionary, coded.indices.to_numpy()
        stems = pc.utf8_rtrim(words, MARKS)
        fit = pc.and_(pc.utf8_is_alpha(stems), pc.invert(pc.match_substring_regex(stems, NOT_LATIN)))
        letters = fit.to_numpy(zero_copy_only=False)
        data, offsets = buffers(words)
        skip = np.where(letters, pc.binary_length(stems).to_numpy(), np.diff(offsets))
        tails = taken(data, offsets[:-1] + skip, np.diff(offsets) - skip)
        tails = pa.LargeStringArray.from_buffers(len(words), pa.py_buffer(offsets - offsets[0] - np.concatenate([[0], np.cumsum(skip)])), pa.py_buffer(tails))
        # places of each distinct word's stem, which is the word itself if it isn't of letters, and of its marks
        places = np.stack([self._places(pc.if_else(fit, pc.utf8_lower(stems), words), letters), self._places(tails)], 1)
        store, size = taken(self.store, self.begin[places].ravel(), self.size[places].ravel()), self.size[places].sum(1)
        ids, stop = dealt(store, np.cumsum(size) - size, size, codes)
        return ids, stop[ends]


@functools.lru_cache(maxsize=1)
def _word_ids(path: str) -> WordIds:
    """One for all tasks of a worker, until it turns to another operator."""
    return WordIds(path)


LET_GO.append(_word_ids.cache_clear)


def pieces(documents: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the ids of each whole text and the closing id, cut where longer than CAPACITY."""

    bounded_batches(documents.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, closing = _word_ids(tokenizer), np.array([CLOSING], "<u4").tobytes()
        for batch in batches:
            for lo, hi in _runs(batch.column(1)):
                own, out, first = batch.column(0).slice(lo, hi - lo).to_pylist(), [], 0
                ids, ends = encode(batch.column(1).slice(lo, hi - lo))
                for doc, end in zip(own, ends.tolist(), strict=True):
                    n = end - first + 1  # with the closing id
                    for k, at in enumerate(range(0, n, CAPACITY)):
                        length = min(CAPACITY, n - at)
                        crc = zlib.crc32(ids[first + at : min(end, first + at + length)])
                        out.append((doc, k, at, length, zlib.crc32(closing, crc) if at + length == n else crc))
                    first = end
                columns = zip(*out, strict=True) if out else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(trimmed(cut), _PIECES)


def _runs(column: pa.Array, most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Row ranges of about most bytes."""
    sizes = np.concatenate([[0], np.cumsum(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False))])
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(sizes, sizes[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


def moves(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, documents to a sequence, offset) for counts of documents by length."""
    gaps: dict[int, list[tuple[int, int]]] = {}
    sizes: list[int] = []
    out: list[tuple[int, int, int, int, int, int]] = []
    fresh = 0

    def free(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                bisect.insort(sizes, gap)
                gaps[gap] = []
            gaps[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(sizes, length)
            if at < len(sizes):
                gap = sizes[at]
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], sizes[at]
            else:
                gap, first, n = capacity, fresh, -(-left // (capacity // length))
                fresh += n
            each = gap // length
            full = min(n, left // each)
            if full:
                out.append((length, rank, rank + full * each, first, each, capacity - gap))
                free(gap - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if left and full < n:
                out.append((length, rank, rank + left, first + full, left, capacity - gap))
                free(gap - left * length, first + full, 1)
                free(gap, first + full + 1, n - full - 1)
                rank, left = rank + left, 0
            elif full < n:
                free(gap, first + full, n - full)
    return out


def packed(table: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to a written table of pieces."""
    spark = table.sparkSession
    counts = {r["length"]: r["count"] for r in table.groupBy("length").count().collect()}  # a row for each length: capacity at most
    plan = spark.createDataFrame(moves(counts, capacity), "length long, low long, high long, first long, each long, base long")
    spread = table.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(max(8, shuffle_partitions(spark)))))
    before = spread.groupBy("length", "part").count().withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("part")) - F.col("count")).drop("count")
    ranked = spread.withColumn("own", F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")) - 1).join(before, ["length", "part"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("own"))
    runs = plan.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("low", "high", "first", "each", "base"))).alias("runs"))
    placed = ranked.join(F.broadcast(runs), "length").withColumn("run", F.filter("runs", lambda r: (r["low"] <= F.col("rank")) & (F.col("rank") < r["high"]))[0])
    turn = F.col("rank") - F.col("run.low")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("run.first") + F.floor(turn / F.col("run.each"))).cast("long").alias("sequence_id"),
        (F.col("run.base") + turn % F.col("run.each") * F.col("length")).cast("long").alias("offset"),
    )


def pack(documents: DataFrame, tokenizer: str) -> DataFrame:
    return packed(written(pieces(documents, tokenizer)))


def count_sequences(lengths: list[int], capacity: int = CAPACITY) -> int:
    """Sequences that plain best fit, longest first, needs; for comparison."""
    gaps: list[int] = []
    for length in sorted(lengths, reverse=True):
        at = bisect.bisect_left(gaps, length)
        gap = gaps.pop(at) if at < len(gaps) else capacity
        bisect.insort(gaps, gap - length)
    return len(gaps)
