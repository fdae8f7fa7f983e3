"""SentencePiece encoding and decoding, and sampling of distinct segmentations without replacement by Gumbel top-k.

The lattice of a text is the chain of its words' lattices, cut only where no piece goes across: before a blank, unless some piece has that blank after the
character before it (as in runs of blanks, which stay with the word after them), and at characters that stand in no longer piece. Edges are
the vocabulary's pieces; a character without a piece is the edge of its bytes. The model is one of merges, whose scores are ranks, so a piece's
log-weight is -SHARPNESS * ln(rank + 2), Zipf's law. A backward sum over each lattice gives every edge its probability.

The search is A-star with perturbed bounds: the agenda holds sets of segmentations that share a path up to a node and leave it by edges not yet taken.
The bound of a set is the largest perturbed log-probability in it, a Gumbel variable located at the set's log-mass, known exactly; so the best set on
the agenda holds the next sample. It is opened along sampled edges, on which the bound stays, and every node passed puts its other edges back as
a set whose bound is drawn below that one. All nodes of a run of untouched words share a set; when that is opened, the first word to differ is drawn
by its share of the set's mass, and the words before it and behind it are sets of their own. The k samples are thus k draws without
replacement; the bound left on top, the threshold, gives the probability that a segmentation is among them. Draws depend on the row's key alone.

coded() has the samples with their ids and the model's own encoding, each decoded again; encode() and decode() are the operators for any table.

Cases. Null or empty text: one segmentation, without pieces. Fewer than k segmentations: all there are. Repeated rows, or null keys: the same draws for the same key and
text. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import bisect
import functools
import heapq
import itertools
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callweave.llm.common import bounded_batches, trimmed
from callweave.llm.textblocks import dealt, mixed, taken

SAMPLES, SHARPNESS = 3, 1.0
SLICE_CHARS = 1 << 21
#: Words whose lattices are made at once.
BLOCK_WORDS = 4096
#: Ids decoded at once.
DECODED_IDS = 1 << 20
_MASK, _TOP_BITS, _SPREAD = (1 << 64) - 1, 20, np.uint64(0x9E3779B97F4A7C15)
_BLANK = "▁"


class Vocabulary:
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.processor = SentencePieceProcessor(model_file=path)
        size = self.processor.get_piece_size()
        plain = [i for i in range(size) if not (self.processor.is_control(i) or self.processor.is_unknown(i) or self.processor.is_byte(i))]
        self.pieces = {self.processor.id_to_piece(i): i for i in plain}
        self.pieces_by_id = {i: p for p, i in self.pieces.items()}
        self.first_byte = self.processor.piece_to_id("<0x00>")
        self.longest = max(map(len, self.pieces))
        joined = {c for p in self.pieces if len(p) > 1 for c in p}
        #: Line ends and other characters inside texts at which lattices fall apart.
        self.breaks = "".join(c for c in "\n\t\r" if c not in joined)
        self.broken = re.compile(f"[{self.breaks}]" if self.breaks else "(?!)").search
        #: Characters that some piece has before a blank; after these a blank is no cut.
        held = {a for p in self.pieces for a, b in itertools.pairwise(p) if b == _BLANK}
        self.held_apart = held <= {_BLANK}
        self.cut = re.compile(f"(?<![{re.escape(''.join(sorted(held)))}])(?={_BLANK})(?!^)" if held else f"(?={_BLANK})(?!^)")
        # all prefixes of pieces by hash; those that are no piece have no id
        starts = {p[:n]: -1 for p in self.pieces for n in range(1, len(p))} | self.pieces
        hashes = np.array([_hash_of(p) for p in starts], np.uint64) * _SPREAD
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], np.array(list(starts.values()))[order]
        # first place of each value of a hash's top bits; few hashes share them
        top = self.hashes >> np.uint64(64 - _TOP_BITS)
        self.first = np.searchsorted(top, np.arange((1 << _TOP_BITS) + 1, dtype=np.uint64)).astype(np.int32)
        self.crowd = int(np.diff(self.first).max())
        scores = np.array([self.processor.get_score(int(i)) if i >= 0 else 0.0 for i in self.ids])
        self.weights = -SHARPNESS * np.log(2 + np.minimum(-np.minimum(scores, 0), size))
        self.byte_weight = -SHARPNESS * math.log(2 + size)
        #: Weights by id, bytes included.
        self.weight_of = np.full(size, self.byte_weight)
        self.weight_of[self.ids[self.ids >= 0]] = self.weights[self.ids >= 0]
        #: Characters by id; one for bytes, and for the mark -1 of a character without a piece, which is the last.
        self.chars_of = np.ones(size + 1, np.int64)
        self.chars_of[list(self.pieces_by_id)] = [len(p) for p in self.pieces_by_id.values()]
        # the bytes that each id stands for in a text; ids without any (marks of the model) are left to the model
        parts = [b"" if i not in self.pieces_by_id and not self.processor.is_byte(i) else bytes([i - self.first_byte]) if self.processor.is_byte(i) else self.pieces_by_id[i].replace(_BLANK, " ").encode() for i in range(size)]
        self.sizes = np.array([len(p) for p in parts])
        self.bytes_of = pa.array(parts, pa.large_binary())
        self.blank_first = np.array([p[:1] == b" " and i in self.pieces_by_id for i, p in enumerate(parts)])

    def find(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether each hash is known, its place)."""
        value, last = value * _SPREAD, len(self.hashes) - 1
        at = np.minimum(self.first.take((value >> np.uint64(64 - _TOP_BITS)).view(np.int64)), last)
        hit = self.hashes.take(at) == value
        miss = np.flatnonzero(~hit)
        for _ in range(self.crowd - 1):
            more = np.minimum(at[miss] + 1, last)
            go = self.hashes.take(more) >> np.uint64(64 - _TOP_BITS) == value[miss] >> np.uint64(64 - _TOP_BITS)
            miss, more = miss[go], more[go]
            if not len(miss):
                break
            at[miss] = more
            hit[miss] = self.hashes.take(more) == value[miss]
            miss = miss[~hit[miss]]
        return hit, at

    def split(self, text: str) -> list[str]:
        """Words whose lattices make up the text's; each blank is the mark at a word's start, and the text gets one before it."""
        if not text:
            return []
        if self.held_apart and "  " not in text and text[0] != " " and _BLANK not in text:
            words = (_BLANK + text.replace(" ", " " + _BLANK)).split(" ")
        else:
            words = self.cut.split(_BLANK + text.replace(" ", _BLANK))
        return self.parted(words) if self.broken(text) else words

    def parted(self, words: list[str]) -> list[str]:
        """The words cut at line ends and the like."""
        for c in self.breaks:
            words = [p for w in words for p in ((w,) if c not in w else _parted(w, c))]
        return words


@functools.lru_cache(maxsize=1)
def _vocabulary(path: str) -> Vocabulary:
    """One for all tasks of a worker."""
    return Vocabulary(path)


def _parted(word: str, c: str) -> list[str]:
    out = []
    for k, part in enumerate(word.split(c)):
        out += ([c] if k else []) + ([part] if part else [])
    return out


def _hash_of(text: str) -> int:
    value = 0
    for c in text:
        value = (value * 0x100000001B3 + ord(c) + 0x9E3779B97F4A7C15) & _MASK
    return value


class Lattices:
    """Of distinct words: edge probabilities, their logarithms and sums, a row for each node and a column for each edge length; and the edges' ids."""

    def __init__(self, words: list[str], vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-lengths, kind="stable")
        self.rank = np.empty(len(words), np.int64)
        self.rank[order] = np.arange(len(words))
        self.lengths = lengths[order]
        self.base = np.concatenate([[0], np.cumsum(self.lengths + 1)])[:-1]
        self.chars = np.frombuffer("\0".join([*map(words.__getitem__, order.tolist()), ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(self.chars)
        # in blocks of words, whose arrays stay in the processor's caches
        blocks = [range(lo, min(lo + BLOCK_WORDS, len(words))) for lo in range(0, len(words), BLOCK_WORDS)]
        bounds = [(int(self.base[w.start]), int(self.base[w.stop - 1] + self.lengths[w.stop - 1] + 1)) for w in blocks]
        hits = [self._matches(*own) for own in bounds]
        wide = max([1, *(k + 1 for own in hits for k, h in enumerate(own) if len(h[0]))])
        self.ids, self.has_bare = np.full((n, wide), -1, np.int32), np.zeros(len(words), bool)
        # cells without an edge stay 0 in the sums, which no draw is below
        self.log_chance, self.upto = np.full((n, wide), -np.inf, np.float32), np.zeros((n, wide), np.float32)
        for w, own, found in zip(blocks, bounds, hits, strict=True):
            self._fill(w, *own, found)

    def _matches(self, lo: int, hi: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each length the nodes from lo to hi, counted from lo, from which a piece of it goes on, and the pieces."""
        vocabulary, chars, hits = self.vocabulary, self.chars[lo:hi].astype(np.uint64), []
        alive = np.flatnonzero(chars)
        value = np.zeros(len(alive), np.uint64)
        for k in range(vocabulary.longest):
            more = chars.take(alive + k)
            value *= np.uint64(0x100000001B3)
            value += more
            value += np.uint64(0x9E3779B97F4A7C15)
            go, at = vocabulary.find(value)
            go = np.flatnonzero(go & (more != 0))
            alive, value, at = alive.take(go), value.take(go), at.take(go)
            if not len(alive):
                break
            own = vocabulary.ids.take(at)
            full = np.flatnonzero(own >= 0)
            hits.append((alive.take(full), own.take(full)))
        return hits

    def _fill(self, words: range, lo: int, hi: int, hits: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """The rows of the nodes from lo to hi, those of a block of words."""
        vocabulary, chars, ids, wide = self.vocabulary, self.chars[lo:hi], self.ids[lo:hi], self.ids.shape[1]
        base, lengths = self.base[words.start : words.stop] - lo, self.lengths[words.start : words.stop]
        flat_ids = ids.ravel()
        for k, (node, own) in enumerate(hits[:wide]):
            flat_ids[node * wide + k] = own
        bare = np.flatnonzero((ids[:, 0] < 0) & (chars != 0))
        size = np.where(chars[bare] < 0x80, 1, np.where(chars[bare] < 0x800, 2, np.where(chars[bare] < 0x10000, 3, 4)))
        ids[bare, 0] = vocabulary.first_byte + np.minimum(chars[bare], 0x7F).astype(np.int32)
        strange = bare[size > 1]
        self.has_bare[words.start + np.searchsorted(base, strange, "right") - 1] = True
        # the edges there are, as cells of the table of nodes and lengths; nodes go from the words' last places to the first, so a level is a run of edges
        longest = int(lengths[0])
        level = np.searchsorted(-lengths, -np.arange(longest), "left")[::-1].tolist()
        nodes = np.concatenate([np.zeros(0, np.int64), *(base[:c] + p for p, c in zip(range(longest - 1, -1, -1), level, strict=True))])
        cells = np.flatnonzero(flat_ids >= 0)
        of_node = np.bincount(cells // wide, minlength=hi - lo)
        count = of_node.take(nodes)
        stop = np.cumsum(count)
        head = stop - count
        cells = taken(cells, (np.cumsum(of_node) - of_node).take(nodes), count)
        row = np.repeat(np.arange(len(nodes)), count)
        log_chance = vocabulary.weight_of.take(flat_ids.take(cells))
        if len(strange):
            place = np.empty(hi - lo, np.int64)
            place[nodes] = head
            log_chance[place[strange]] *= size[size > 1]
        behind, chance, end = np.zeros(hi - lo + 1), np.empty(len(cells)), cells - nodes.take(row) * (wide - 1) + 1
        last = 0
        for c in level:
            own, first = slice(last, last + c), int(head[last])
            edges, last = slice(first, int(stop[last + c - 1])), last + c
            at, of = head[own] - first, row[edges] - own.start
            value = log_chance[edges]
            value += behind.take(end[edges])
            # every node has an edge of one character, which is near enough to the largest to keep exp within range
            top = value.take(at)
            value -= top.take(of)
            e = np.exp(value, out=chance[edges])
            total = np.add.reduceat(e, at)
            e /= total.take(of)
            np.log(total, out=total)
            value -= total.take(of)
            total += top
            behind[nodes[own]] = total
        self.log_chance[lo:hi].ravel()[cells] = np.minimum(log_chance, 0.0, out=log_chance)
        for k in range(1, int(count.max(initial=0))):
            edge = head[count > k] + k
            chance[edge] += chance[edge - 1]
        chance[stop - 1] = 2
        self.upto[lo:hi].ravel()[cells] = chance
        ids[strange, 0] = -1

    def chances(self, node) -> np.ndarray:
        return np.exp(self.log_chance[node].astype(np.float64))

    def walk(self, word: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each token (rank of its word, 64-bit key) a sampled path: (pieces, log-probability), and all tokens' (ids, lengths) in turn."""
        count, log_p, ids = self.paths(self.base[word], self.lengths[word], key)
        return count, np.bincount(np.repeat(np.arange(len(word)), count), weights=log_p, minlength=len(word)), ids, self.vocabulary.chars_of[ids]

    def paths(self, node: np.ndarray, left: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A sampled path from each node on, over as many characters as are left: pieces of each, and all their (log-probabilities, ids) in turn."""
        count, wide = np.zeros(len(node), np.int64), self.upto.shape[1]
        alive, steps = np.flatnonzero(left), []
        if len(alive) < len(node):
            node, left, key = node.take(alive), left.take(alive), key.take(alive)
        while len(alive):
            u = _uniform(mixed(key + np.uint64((len(steps) + 1) * 0xC2B2AE3D27D4EB4F & _MASK)))
            k = (self.upto.take(node, axis=0) > u.astype(np.float32)[:, None]).argmax(1)
            edge = node * wide
            edge += k
            k += 1
            steps.append((alive, edge))
            count[alive] = len(steps)
            left = left - k
            go = np.flatnonzero(left)
            k += node
            alive, node, left, key = alive.take(go), k.take(go), left.take(go), key.take(go)
        first, edges = np.cumsum(count) - count, np.empty(int(count.sum()), np.int64)
        for s, (own, edge) in enumerate(steps):
            at = first.take(own)
            at += s
            edges[at] = edge
        return count, self.log_chance.ravel().take(edges), self.ids.ravel().take(edges)


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


class _Draws:
    """Uniform numbers of one row, in turn."""

    def __init__(self, key: int):
        self.state = key & _MASK

    def __call__(self) -> float:
        self.state = (self.state + 0x9E3779B97F4A7C15) & _MASK
        h = self.state
        h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
        h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & _MASK
        return (((h ^ (h >> 31)) >> 11) + 0.5) * 2.0**-53


def _below(location: float, bound: float, u: float) -> float:
    """A Gumbel variable at location, given that it is at most bound."""
    x = location - bound
    return location - (x + math.log1p(-math.log(u) * math.exp(-x)) if x > 0 else math.log(math.exp(x) - math.log(u)))


class Sample:
    """counts: pieces of tokens; log_p, ids: of pieces; perturbed: the bound reached; cost: minus the log-probability before each piece, and of all."""

    def __init__(self, counts, log_p, ids, perturbed):
        self.counts, self.log_p, self.ids, self.perturbed = counts, log_p, ids, perturbed
        self.cost = np.zeros(len(log_p) + 1)
        np.cumsum(log_p, dtype=np.float64, out=self.cost[1:])
        np.negative(self.cost, out=self.cost)

    def token_of(self, piece: int) -> tuple[int, int]:
        """The token of a piece, and its first piece."""
        ends = np.cumsum(self.counts)
        token = int(ends.searchsorted(piece, "right"))
        return token, int(ends[token] - self.counts[token])


class _Search:
    """The agenda of one row."""

    def __init__(self, lattices: Lattices, words: np.ndarray, key: int):
        self.lattices, self.words, self.key = lattices, words, key
        self.draw, self.samples, self.agenda, self.order = _Draws(key ^ 0x5851F42D4C957F2D), [], [], 0

    def push(self, location: float, bound: float, *what) -> None:
        """Puts a set of that log-mass on the agenda, its bound drawn below the one given."""
        self.order += 1
        heapq.heappush(self.agenda, (-_below(location, bound, self.draw()), self.order, what))

    def add(self, sample: Sample, begin: int) -> None:
        """Takes a sample whose pieces from begin on are fresh; the other paths along these become a set."""
        self.samples.append(sample)
        self.span(len(self.samples) - 1, begin, len(sample.ids), sample.perturbed)

    def span(self, parent: int, lo: int, hi: int, bound: float) -> None:
        """The set of the paths that leave the sample first at a piece from lo to hi."""
        cost = self.samples[parent].cost
        before, inner = float(cost[lo]), float(cost[hi] - cost[lo])
        if inner > 1e-15:
            self.push(math.log(-math.expm1(-inner)) - before, bound, parent, lo, hi, 0, ())

    def first_to_differ(self, parent: int, lo: int, hi: int) -> int:
        """A piece of the span, drawn by the mass of the paths that leave the sample first there."""
        cost = self.samples[parent].cost
        own, before = cost[lo + 1 : hi + 1], float(cost[lo])
        at = int(own.searchsorted(before - math.log1p(self.draw() * math.expm1(before - float(cost[hi]))), "right"))
        # a draw rounded up to the whole: the last piece beside which there are others
        return lo + (at if at < len(own) else int(own.searchsorted(own[-1], "left")))

    def threshold(self) -> float:
        return -self.agenda[0][0] if self.agenda else -math.inf

    def open(self) -> tuple | None:
        """(sample that is left, piece, its token, the first piece of that, its characters up to behind the new edge, id and log-probability of this, bound) of the best set; None with no more."""
        while self.agenda:
            bound, _, (parent, lo, hi, node, taken_) = heapq.heappop(self.agenda)
            bound, sample, at = -bound, self.samples[parent], lo
            if not taken_:
                at = self.first_to_differ(parent, lo, hi)
                self.span(parent, lo, at, bound)
                self.span(parent, at + 1, hi, bound)
            token, begin = sample.token_of(at)
            base = int(self.lattices.base[self.words[token]])
            if not taken_:
                sizes = self.lattices.vocabulary.chars_of[sample.ids[begin : at + 1]].tolist()
                node, taken_ = base + sum(sizes[:-1]), (sizes[-1] - 1,)
            chance = self.lattices.chances(node).tolist()
            for k in taken_:
                chance[k] = 0.0
            upto = list(itertools.accumulate(chance))
            if not upto[-1]:
                continue
            k = bisect.bisect_right(upto, self.draw() * upto[-1])
            if k == len(upto):  # a draw rounded up to the whole: the last edge there is
                k = max(i for i, c in enumerate(chance) if c)
            own, chance[k] = chance[k], 0.0
            rest = sum(chance)
            if rest > 1e-15:
                self.push(math.log(rest) - float(sample.cost[at]), bound, parent, at, at + 1, node, (*taken_, k))
            return parent, at, token, begin, node + k + 1 - base, int(self.lattices.ids[node, k]), math.log(own), bound
        return None


def _told_apart(texts: list[str]) -> tuple[list[bool], pa.Array, np.ndarray, np.ndarray]:
    """(whether each text has single blanks alone, and between words, the words of those that do, each once, the number of each word in turn, how many each of those texts has)."""
    plain = [bool(t) and "  " not in t and _BLANK not in t and t[0] != " " and t[-1] != " " for t in texts]
    split = pc.split_pattern(pa.array(itertools.compress(texts, plain), pa.large_string()), " ")
    coded = split.flatten().dictionary_encode()
    return plain, coded.dictionary, coded.indices.to_numpy(), pc.list_value_length(split).to_numpy()


def _listed(words: pa.Array) -> list[str]:
    return words.to_numpy(zero_copy_only=False).tolist()


def _tokens(texts: list[str], vocabulary: Vocabulary, told: tuple) -> tuple[Lattices, list[np.ndarray]]:
    """The lattices of all words, and the ranks of each text's."""
    plain, words, codes, counts = told
    if not vocabulary.held_apart:
        plain, words, codes, counts = [False] * len(texts), words[:0], codes[:0], counts[:0]
    # each word of plain texts is one lattice, but for those cut within; other texts follow, each split by itself
    broken = np.flatnonzero(functools.reduce(np.logical_or, (pc.match_substring(words, c).to_numpy(zero_copy_only=False) for c in vocabulary.breaks), np.zeros(len(words), bool)))
    marked = _listed(pc.binary_join_element_wise(pa.scalar(_BLANK, words.type), words, pa.scalar("", words.type)))
    parts = [vocabulary.parted([marked[i]]) for i in broken.tolist()] + [vocabulary.split(t) for t, p in zip(texts, plain, strict=True) if not p]
    for i in broken.tolist():
        marked[i] = ""
    number = {w: i for i, w in enumerate(dict.fromkeys(itertools.chain.from_iterable(parts)), len(words))}
    lattices = Lattices([*marked, *number], vocabulary)
    others = np.arange(len(words), len(words) + len(parts) - len(broken))
    own = np.concatenate([broken, others])
    size = np.ones(len(words) + len(others), np.int64)
    size[own] = np.fromiter(map(len, parts), np.int64, len(parts))
    begin = np.arange(len(size))
    begin[own] = len(words) + np.cumsum(size[own]) - size[own]
    at = np.concatenate([np.arange(len(words)), np.fromiter(map(number.__getitem__, itertools.chain.from_iterable(parts)), np.int64)])
    ranks, stop = dealt(lattices.rank[at], begin, size, np.concatenate([codes, others]))
    ends = stop[np.concatenate([[0], np.cumsum(np.concatenate([counts, np.ones(len(others), np.int64)]))])].tolist()
    out = [None] * len(texts)
    for d, (lo, hi) in zip(np.argsort(~np.array(plain, bool), kind="stable").tolist(), itertools.pairwise(ends), strict=True):
        out[d] = ranks[lo:hi]
    return lattices, out


def top_k(texts: list[str], keys: np.ndarray, vocabulary: Vocabulary, k: int = SAMPLES, told: tuple | None = None) -> list[tuple[list[Sample], float, np.ndarray]]:
    """For each text its samples, best perturbed first, the threshold, and the bytes of characters without a piece, by sample (see ids_of). told: _told_apart() of the texts, if known."""
    lattices, words = _tokens(texts, vocabulary, told or _told_apart(texts))
    searches = [_Search(lattices, w, int(key)) for w, key in zip(words, keys.tolist(), strict=True)]
    todo = [(s, 0, 0, None) for s in searches]
    for turn in range(k):
        if not todo:
            break
        # each search's tokens from one on, the first of them behind some characters
        own = [s.words[token:] for s, token, _, _ in todo]
        size = np.fromiter(map(len, own), np.int64, len(own))
        first = np.cumsum(size) - size
        word, skip = np.concatenate(own), np.fromiter((c for _, _, c, _ in todo), np.int64, len(todo))
        tokens = np.arange(len(word)) + np.repeat(np.fromiter((t for _, t, _, _ in todo), np.int64, len(todo)) - first, size)
        key = np.array([s.key for s, _, _, _ in todo], np.uint64)
        token_keys = mixed(tokens.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.repeat(key + np.uint64(turn * 0xD1B54A32D192ED03 & _MASK), size))
        node, left = lattices.base.take(word), lattices.lengths.take(word)
        begun = np.flatnonzero(skip)
        node[first[begun]] += skip[begun]
        left[first[begun]] -= skip[begun]
        count, log_p, ids = lattices.paths(node, left, token_keys)
        pieces = np.concatenate([[0], np.cumsum(count)])
        for (s, token, _, opened), lo, n in zip(todo, first.tolist(), size.tolist(), strict=True):
            counts, part = count[lo : lo + n], slice(pieces[lo], pieces[lo + n])
            if opened is None:
                s.add(Sample(counts, log_p[part], ids[part], -math.log(-math.log(s.draw()))), 0)
            else:
                parent, at, _, begin, _, new_id, new_log_p, bound = opened
                old = s.samples[parent]
                counts = np.concatenate([old.counts[:token], counts])
                counts[token] += at + 1 - begin
                fresh = ((old.log_p, new_log_p, log_p), (old.ids, new_id, ids))
                s.add(Sample(counts, *(np.concatenate([o[:at], np.array([x], o.dtype), y[part]]) for o, x, y in fresh), bound), at + 1)
        if turn < k - 1:
            todo = [(s, o[2], o[4], o) for s, o in ((s, s.open()) for s, _, _, _ in todo) if o]
    return [(s.samples, s.threshold(), lattices.chars[_bare(lattices, s)]) for s in searches]


def _bare(lattices: Lattices, search: _Search) -> np.ndarray:
    """Nodes, in the order of the text, whose character has no piece and more than one byte."""
    words = search.words[lattices.has_bare[search.words]]
    if not len(words):
        return np.zeros(0, np.int64)
    own = np.concatenate([np.arange(b, b + n) for b, n in zip(lattices.base[words].tolist(), lattices.lengths[words].tolist(), strict=True)])
    return own[(lattices.ids[own, 0] < 0)]


def ids_of(sample: Sample, bare: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """Ids as unsigned 32-bit numbers; characters without a piece, which every segmentation has, in their bytes."""
    if not len(bare):
        return sample.ids.astype("<u4")
    out, at, left = [], 0, iter(bare.tolist())
    for hole in np.flatnonzero(sample.ids < 0).tolist():
        out += [sample.ids[at:hole], np.frombuffer(chr(next(left)).encode("utf-8", "surrogatepass"), np.uint8).astype(np.int32) + vocabulary.first_byte]
        at = hole + 1
    return np.concatenate([*out, sample.ids[at:]]).astype("<u4")


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of SLICE_CHARS together; a longer one goes alone."""
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= SLICE_CHARS):
            size += len(texts[hi])
            hi += 1
        yield lo, hi
        lo = hi


_FIELDS = [("sample", "int", pa.int32()), ("n_pieces", "long", pa.int64()), ("log_prob", "double", pa.float64()), ("perturbed", "double", pa.float64()), ("log_inclusion", "double", pa.float64()), ("ids_crc32", "long", pa.int64())]


def _drawn(texts: list[str], keys: np.ndarray, vocabulary: Vocabulary, k: int, told: tuple | None = None) -> Iterator[tuple]:
    """(text, sample, n_pieces, log_prob, perturbed, log_inclusion, ids_crc32, ids) of the samples of each text."""
    for d, (samples, threshold, bare) in enumerate(top_k(texts, keys, vocabulary, k, told)):
        for n, s in enumerate(samples):
            ids = ids_of(s, bare, vocabulary)
            log_p = -float(s.cost[-1])
            yield d, n + 1, len(ids), log_p, s.perturbed, _log_inclusion(log_p, threshold), zlib.crc32(ids.tobytes()), ids


def _source(documents: DataFrame, key: str) -> DataFrame:
    bounded_batches(documents.sparkSession)
    return documents.select(F.col(key).alias("key"), F.xxhash64(key).alias("seed"), F.col("text").cast("string").alias("text"))


def _sampled(documents: DataFrame, model: str, k: int, key: str, own: bool) -> DataFrame:
    """Samples with their ids; with own, the model's own encoding as sample 0 too, and whether the decoded ids are the text."""
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(model)
        for batch in batches:
            texts, keys = [t or "" for t in batch.column(2).to_pylist()], batch.column(1).to_numpy().view(np.uint64)
            for lo, hi in _slices(texts):
                told = _told_apart(texts[lo:hi])
                rows = list(_drawn(texts[lo:hi], keys[lo:hi], vocabulary, k, told))
                if own:
                    rows += [(d, 0, len(ids), None, None, None, None, ids) for d, ids in enumerate(encoded_ids(texts[lo:hi], vocabulary, told))]
                columns = list(zip(*rows, strict=True))
                at, ids = pa.array(columns[0], pa.int64()), _lists(columns[7])
                arrays = [batch.column(0).slice(lo, hi - lo).take(at), *(pa.array(c, t) for c, (_, _, t) in zip(columns[1:7], _FIELDS, strict=True)), ids]
                names = ["key", *(n for n, _, _ in _FIELDS), "ids"]
                if own:
                    same = [t == texts[lo + d] for t, d in zip(decoded_texts(ids, vocabulary), columns[0], strict=True)]
                    arrays.append(pa.array(same, pa.bool_()))
                    names.append("gives_text")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = f"key {kind}, " + ", ".join(f"{n} {t}" for n, t, _ in _FIELDS) + ", ids array<int>" + (", gives_text boolean" if own else "")
    return _source(documents, key).mapInArrow(trimmed(run), schema).withColumnRenamed("key", key)


def sampled(documents: DataFrame, model: str, k: int = SAMPLES, key: str = "doc_id") -> DataFrame:
    """key, sample (from 1), n_pieces, log_prob, perturbed, log_inclusion, ids_crc32 and ids of up to k distinct segmentations of each text."""
    return _sampled(documents, model, k, key, own=False)


def _lists(ids) -> pa.Array:
    """Arrays of ids as one column."""
    ends = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *ids]).astype(np.int32)))


def _log_inclusion(log_p: float, threshold: float) -> float:
    """ln(1 - exp(-exp(log_p - threshold)))."""
    if threshold == -math.inf:
        return 0.0
    x = log_p - threshold
    return x if x < -30 else math.log(-math.expm1(-math.exp(min(x, 700.0))))


def encoded_ids(texts: list[str], vocabulary: Vocabulary, told: tuple | None = None) -> list[np.ndarray]:
    """The model's own ids; words between single blanks are told apart by Arrow and each is encoded once for all texts. told: _told_apart() of the texts, if known."""
    plain, words, codes, counts = told or _told_apart(texts)
    own = vocabulary.processor.encode(_listed(words), num_threads=1)
    size = np.fromiter(map(len, own), np.int64, len(own))
    ids, stop = dealt(np.fromiter(itertools.chain.from_iterable(own), np.int32), np.cumsum(size) - size, size, codes)
    ends = stop[np.cumsum(counts)].tolist()
    parts = (ids[lo:hi] for lo, hi in itertools.pairwise([0, *ends]))
    return [next(parts) if p else np.array(vocabulary.processor.encode(t), np.int32) for t, p in zip(texts, plain, strict=True)]


def encoded(texts: list[str], vocabulary: Vocabulary) -> list[list[int]]:
    return [ids.tolist() for ids in encoded_ids(texts, vocabulary)]


def decoded_texts(lists: pa.ListArray, vocabulary: Vocabulary) -> Iterator[str | None]:
    """The texts of lists of ids, null for null: the bytes of all pieces in turn, but for the blank at the start. Lists with ids that have no bytes, or whose bytes
    are no text, are decoded by the model."""
    values, ends, none = lists.values.to_numpy(), lists.offsets.to_numpy(), lists.is_null().to_numpy(zero_copy_only=False)
    lo = 0
    while lo < len(lists):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + DECODED_IDS, "right")) - 1)
        ids = values[ends[lo] : ends[hi]]
        joined = vocabulary.bytes_of.take(pa.array(ids))
        _, offsets, data = joined.buffers()
        place, data = np.frombuffer(offsets, np.int64)[: len(ids) + 1], data.to_pybytes() if len(ids) else b""
        odd = np.concatenate([[0], np.cumsum(vocabulary.sizes.take(ids) == 0)])
        at, stop = place[ends[lo:hi] - ends[lo]], place[ends[lo + 1 : hi + 1] - ends[lo]].tolist()
        full = np.flatnonzero(ends[lo:hi] < ends[lo + 1 : hi + 1])
        at[full] += vocabulary.blank_first[ids[(ends[lo:hi] - ends[lo])[full]]]
        at = at.tolist()
        strange = (np.diff(odd[ends[lo : hi + 1] - ends[lo]]) > 0).tolist()
        for k in range(hi - lo):
            if none[lo + k]:
                yield None
                continue
            try:
                text = None if strange[k] else data[at[k] : stop[k]].decode()
            except UnicodeDecodeError:
                text = None
            yield vocabulary.processor.decode(values[ends[lo + k] : ends[lo + k + 1]].tolist()) if text is None else text
        lo = hi


def decoded(ids: list[list[int]], vocabulary: Vocabulary) -> list[str]:
    return list(decoded_texts(_lists([np.array(i, np.int32) for i in ids]), vocabulary))


def _with(table: DataFrame, model: str, field: T.StructField, source: str, make) -> DataFrame:
    """The table's columns and one made of a column's values."""
    bounded_batches(table.sparkSession)
    at = table.columns.index(source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, make(batch.column(at), vocabulary)], names=[*batch.schema.names, field.name])

    return table.mapInArrow(trimmed(run), T.StructType([*table.schema.fields, field]))


def coded(documents: DataFrame, model: str, k: int = SAMPLES, key: str = "doc_id") -> DataFrame:
    """The rows of sampled(), and a row of the model's own encoding as sample 0, which is no draw and has neither probabilities nor a digest;
    gives_text tells whether the decoded ids are the text (they aren't where the text holds the blank's mark itself, which decodes to a blank)."""
    return _sampled(documents, model, k, key, own=True)


def encode(table: DataFrame, model: str, text: str = "text", name: str = "ids") -> DataFrame:
    """The table's columns and the model's own ids of the text; null text counts as empty."""
    return _with(table, model, T.StructField(name, T.ArrayType(T.IntegerType())), text, lambda texts, vocabulary: _lists(encoded_ids([t or "" for t in texts.to_pylist()], vocabulary)))


def decode(table: DataFrame, model: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """The table's columns and the text that the ids stand for; null ids give a null."""
    return _with(table, model, T.StructField(name, T.StringType()), ids, lambda lists, vocabulary: pa.array(decoded_texts(lists, vocabulary), pa.string()))
