"""Near-duplicate vectors by lattice hashing: random projections to eight dimensions, decoded to the nearest points of the E8 lattice.

Each of several tables projects the unit vectors onto random orthonormal directions, scales and shifts them, and finds the lattice cell, or the cells of two blocks
together. A vector is stored in its own cell of each table and looked up in that and in the neighbouring cells that lie nearest to it. Those that meet are
compared there by vectors rounded to bytes, with bounds of what rounding can change; pairs that the bounds leave open are compared by exact cosine. Tables are
gone through in rounds, whose files are deleted. Equal vectors are one class with a count, so copies meet no one by themselves; cells that many share are
split. A pair at the threshold stays unseen once in some 10,000 times, one at 0.92 far more seldom.

Cases. Vectors that are null, empty, zero or hold a null or non-finite component link with nothing, nor do rows without id: each is its own component. Vectors
of different lengths have no cosine and don't link. Rows that repeat an id are vectors of their own. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import dataclasses
import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.llm.common import HOT, bounded_batches, components, dropped, joined_once, trimmed, written
from callweave.llm.textblocks import mixed
from callweave.llm.vectors import by_length, usable


@dataclasses.dataclass(frozen=True)
class Plan:
    """Cells for up to so many rows: of how many blocks of eight dimensions each, the spread of a component in them, the neighbours looked up in each block, and tables."""

    rows: float
    blocks: int
    spread: float
    probes: int
    tables: int


#: The more rows, the finer the cells, so that a row meets some hundred others by chance in each, not a share of all. All lose a pair at 0.90 once in some 10,000 times.
PLANS = (Plan(150_000, 1, 0.55, 2, 12), Plan(2_000_000, 1, 0.7, 4, 13), Plan(math.inf, 2, 0.6, 2, 52))
#: Bytes dealt in a round and to a part of it, and parts of a round, at least; its tasks at most.
ROUND_BYTES, PART_BYTES, PARTS, MOST_TASKS = 256 << 20, 16 << 20, 32, 2000
#: Rows of a cell that are not split, and classes that tell which cells to split; pairs that are found before they are looked through for repeats.
PART_ROWS, SAMPLE, ROUND_PAIRS = 4096, 200_000, 1_000_000
#: Rows hashed at once; pairs of a cell from which it is compared by a matrix product, of a matrix, and of small cells at once.
SLICE, FEW_PAIRS, MATRIX, PAIRS = 4096, 512, 1 << 21, 1 << 18
_SEED = 29


def _root_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: all signs of two ones, and halves with an even number of minus signs."""
    ones = [np.eye(8)[i] * a + np.eye(8)[j] * b for i in range(8) for j in range(i) for a in (1, -1) for b in (1, -1)]
    halves = [s for k in range(256) if (s := np.where((k >> np.arange(8)) & 1, -0.5, 0.5)) is not None and bin(k).count("1") % 2 == 0]
    return np.array([*ones, *halves])


def _to_d8(y: np.ndarray) -> np.ndarray:
    """Nearest points with integer coordinates of even sum."""
    z = np.rint(y)
    odd = np.flatnonzero(z.sum(1) % 2 != 0)
    off = y[odd] - z[odd]
    worst = np.abs(off).argmax(1)
    z[odd, worst] += np.where(off[np.arange(len(odd)), worst] >= 0, 1, -1)
    return z


def decoded(y: np.ndarray) -> np.ndarray:
    """Nearest E8 points: of the integer points of even sum and those shifted by a half, the nearer one."""
    whole, half = _to_d8(y), _to_d8(y - 0.5) + 0.5
    return np.where((((y - whole) ** 2).sum(1) <= ((y - half) ** 2).sum(1))[:, None], whole, half)


def _cell_key(points: np.ndarray, dim: int, table: int) -> np.ndarray:
    twice = np.rint(points * 2).astype(np.int64).astype(np.uint64)
    key = np.full(len(points), dim * 1000 + table + 1, np.uint64)
    for c in range(8):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + twice[:, c])
    return key.view(np.int64)


class Hasher:
    """Cells of a plan's tables. Tables are cut from whole random rotations, so that the distance of a pair that one table finds large another finds small."""

    def __init__(self, dim: int, plan: Plan):
        rng = np.random.default_rng(_SEED)
        self.dim, self.plan = dim, plan
        whole, maps = -(-dim // 8) * 8, []
        while len(maps) < plan.tables * plan.blocks:
            turn = np.linalg.qr(rng.standard_normal((whole, whole)))[0][:dim]
            maps += [turn[:, lo : lo + 8] * np.sqrt(dim) * plan.spread for lo in range(0, whole, 8)]
        self.maps, self.shifts = maps, rng.random((len(maps), 8))
        self.roots = _root_vectors()

    def _block(self, unit: np.ndarray, number: int, probes: int) -> list[np.ndarray]:
        y = unit @ self.maps[number] + self.shifts[number]
        centre = decoded(y)
        keys = [_cell_key(centre, self.dim, number)]
        if probes:
            near = np.argpartition(-((y - centre) @ self.roots.T), probes, axis=1)[:, :probes]
            keys += [_cell_key(centre + self.roots[near[:, p]], self.dim, number) for p in range(probes)]
        return keys

    def cells(self, unit: np.ndarray, table: int, probes: int | None = None) -> np.ndarray:
        """Rows x cells looked up; the first is the row's own."""
        probes, k = self.plan.probes if probes is None else probes, self.plan.blocks
        blocks = [self._block(unit, table * k + j, probes) for j in range(k)]
        keys = blocks[0]
        for more in blocks[1:]:
            keys = [mixed(one.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + two.view(np.uint64)).view(np.int64) for one in keys for two in more]
        return np.column_stack(keys)


@functools.lru_cache(maxsize=8)
def _hasher(dim: int, plan: Plan) -> Hasher:
    return Hasher(dim, plan)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None]


def _owned(plan: Plan) -> object:
    """(cell, rows) of each batch, all tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, x in by_length(b.column(0)):
                hasher, unit = _hasher(x.shape[1], plan), _unit(x)
                for t in range(plan.tables):
                    cell, n = np.unique(hasher.cells(unit, t, 0), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n)], names=["cell", "n"])

    return run


_ROW = [("id", "<i8"), ("scale", "<f4"), ("off", "<f4")]
_ENTRY = np.dtype([("cell", "<i8"), ("row", "<i4"), ("kind", "i1")])
BOTH, LOOKED, STORED = 0, 1, 2


def _dealt(plan: Plan, tables: range, cut: int, cuts: int, parts: int, hot: tuple[np.ndarray, np.ndarray]) -> object:
    """For each part: rows as bytes and the cells they are stored or looked up in. Of a hot cell, which is split, each part stores all rows and looks up its own."""
    hot_cells, hot_parts = hot

    def entries(cells: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
        """(cell, split, row, kind)"""
        cell, row = cells.ravel(), np.repeat(np.arange(len(cells)), cells.shape[1])
        kind = np.tile(np.where(np.arange(cells.shape[1]) == 0, BOTH, LOOKED), len(cells))
        split = np.zeros(len(cell), np.int64)
        if len(hot_cells):
            at = np.minimum(np.searchsorted(hot_cells, cell), len(hot_cells) - 1)
            held = np.flatnonzero(hot_cells[at] == cell)
            number = hot_parts[at[held]]
            split[held] = ids[row[held]] % number
            own = kind[held] == BOTH
            held, number = held[own], number[own]
            copy, place = np.repeat(held, number), np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
            copy, place = (c[place != split[copy]] for c in (copy, place))
            cell, row, split, kind = np.append(cell, cell[copy]), np.append(row, row[copy]), np.append(split, place), np.append(kind, np.full(len(copy), STORED))
        return cell, split, row, kind

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, SLICE):
                all_ids = b.column(0).slice(lo, SLICE).to_numpy()
                for at, x in by_length(b.column(1).slice(lo, SLICE)):
                    hasher, unit, ids = _hasher(x.shape[1], plan), _unit(x), all_ids[at]
                    found = [entries(hasher.cells(unit, t), ids) for t in tables]
                    cell, split, row, kind = (np.concatenate(c) for c in zip(*found, strict=True))
                    mark = mixed(cell.view(np.uint64) ^ mixed(split.astype(np.uint64) + np.uint64(1)))
                    part = (mark % np.uint64(cuts * parts)).astype(np.int64)
                    order = np.argsort(part, kind="stable")
                    order = order[part[order] // parts == cut]
                    rows = np.zeros(len(ids), [*_ROW, ("q", "i1", (x.shape[1],))])
                    rows["id"], rows["scale"] = ids, np.abs(unit).max(1) / 127
                    scale = rows["scale"].astype(np.float64)[:, None]
                    rows["q"] = np.clip(np.rint(unit / scale), -127, 127)
                    rows["off"] = np.sqrt(((unit - rows["q"] * scale) ** 2).sum(1)) * 1.0001 + 1e-7
                    starts = np.flatnonzero(np.diff(part[order], prepend=-1))
                    out: list[tuple[int, bytes, bytes]] = []
                    for own in np.split(order, starts[1:]) if len(order) else ():
                        used, place = np.unique(row[own], return_inverse=True)
                        made = np.empty(len(own), _ENTRY)
                        # cells of several splits in one part stay apart
                        made["cell"], made["row"], made["kind"] = mark[own].view(np.int64), place, kind[own]
                        out.append((int(part[own[0]]), rows[used].tobytes(), made.tobytes()))
                    if out:
                        columns = list(zip(*out, strict=True))
                        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array([x.shape[1]] * len(out), pa.int64()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary())], names=["part", "dim", "rows", "entries"])

    return run


def _met(rows: np.ndarray, entries: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, sure) of the pairs that meet in a cell and whose cosine, by bounds that hold for the rounded vectors, may be least or more; sure: must be."""
    v = rows["q"] * rows["scale"][:, None]
    off, slack = rows["off"].astype(np.float64), 1e-5 + v.shape[1] * 1.2e-7
    entries = entries[np.lexsort((entries["kind"], entries["cell"]))]
    starts = np.flatnonzero(np.append(True, entries["cell"][1:] != entries["cell"][:-1]))
    size = np.diff(np.append(starts, len(entries)))
    both, looked, stored = (np.add.reduceat((entries["kind"] == k).astype(np.int64), starts) for k in (BOTH, LOOKED, STORED))
    work = (both + looked) * (both + stored)
    row = entries["row"].astype(np.int64)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def keep(i: np.ndarray, j: np.ndarray, cosine: np.ndarray) -> None:
        margin = off[i] + off[j] + 3 * off[i] * off[j] + slack
        good = (cosine >= least - margin) & (rows["id"][i] != rows["id"][j])
        found.append((i[good], j[good], cosine[good] >= least + margin[good]))

    def sides(g: int) -> tuple[np.ndarray, np.ndarray]:
        lo, n, m, end = starts[g], both[g], both[g] + looked[g], starts[g] + size[g]
        return row[lo : lo + m], np.append(row[lo : lo + n], row[lo + m : end])

    for g in np.flatnonzero(work >= FEW_PAIRS).tolist():
        ask, hold = sides(g)
        theirs, cut = v[hold].T, least - 2 * max(off[ask].max(), off[hold].max()) - 3 * max(off[ask].max(), off[hold].max()) ** 2 - slack
        step = max(1, MATRIX // len(hold))
        for lo in range(0, len(ask), step):
            cosine = v[ask[lo : lo + step]] @ theirs
            i, j = np.nonzero(cosine >= cut)
            keep(ask[lo + i], hold[j], cosine[i, j].astype(np.float64))
    # small cells at once: each that looks beside each that is stored
    few = np.flatnonzero((work < FEW_PAIRS) & (work > 0) & (size > 1))
    for own in np.split(few, np.searchsorted(np.cumsum(work[few]), np.arange(PAIRS, work[few].sum(), PAIRS))) if len(few) else ():
        wide = (both + stored)[own]
        first, pairs = np.repeat(np.cumsum(work[own]) - work[own], work[own]), np.repeat(np.arange(len(own)), work[own])
        place = np.arange(work[own].sum()) - first
        x, y = place // wide[pairs], place % wide[pairs]
        lo, n, m = starts[own][pairs], both[own][pairs], looked[own][pairs]
        i, j = row[lo + x], row[lo + np.where(y < n, y, y + m)]
        keep(i, j, np.einsum("ij,ij->i", v[i], v[j]).astype(np.float64))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    i, j, sure = (np.concatenate(c) for c in zip(*found, strict=True))
    one, two = rows["id"][i], rows["id"][j]
    a, b = np.minimum(one, two), np.maximum(one, two)
    order = np.lexsort((~sure, b, a))
    a, b, sure = a[order], b[order], sure[order]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])) if len(a) else np.zeros(0, bool)
    return a[new], b[new], sure[new]


def _compared(least: float) -> object:
    """The pairs of each part; batches come in the order of parts and lengths."""

    def made(key: tuple[int, int], held: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        kind = np.dtype([*_ROW, ("q", "i1", (key[1],))])
        rows, entries, before = [np.frombuffer(r, kind) for r, _ in held], [], 0
        for own, (_, e) in zip(rows, held, strict=True):
            entry = np.frombuffer(e, _ENTRY).copy()
            entry["row"] += before
            entries.append(entry)
            before += len(own)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in _met(np.concatenate(rows), np.concatenate(entries), least)], names=["a", "b", "sure"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = (0, 0), []
        for b in batches:
            for part, dim, rows, entries in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (part, dim) != key and held:
                    yield made(key, held)
                    held = []
                key = (part, dim)
                held.append((rows, entries))
        if held:
            yield made(key, held)

    return run


def _exact(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """The pairs whose cosine in double precision is least or more."""

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for (at, x), (_, y) in zip(by_length(b.column(2)), by_length(b.column(3)), strict=True):
                cosine = (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))
                good = pa.array(at[cosine >= least])
                yield pa.RecordBatch.from_arrays([b.column(0).take(good), b.column(1).take(good)], names=["a", "b"])

    one, two = classes.select(F.col("id").alias("a"), F.col("x").alias("xa")), classes.select(F.col("id").alias("b"), F.col("x").alias("xb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "xa", "xb").mapInArrow(verified, "a long, b long")


def links(classes: DataFrame, least: float = 0.9, round_bytes: int | None = None) -> DataFrame:
    """a < b: ids of classes (id, x) whose cosine in double precision is least or more; a written table.

    The tables are gone through in rounds, each of which deals at most round_bytes, by default about as much as the vectors have or ROUND_BYTES, and leaves nothing behind but
    the pairs it found. Pairs are compared where they meet, by vectors rounded to bytes; those that rounding leaves open are looked up and compared by the vectors themselves."""
    spark = classes.sparkSession
    bounded_batches(spark)
    facts = classes.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("x")), F.lit(0)).alias("c")).first()
    n, mean = facts["n"], facts["c"] / max(1, facts["n"])
    width = 4 if classes.schema["x"].dataType.elementType.typeName() == "float" else 8
    plan = next(p for p in PLANS if n <= p.rows)
    # cells of more than that many classes, by a sample, are split
    part_rows, every = max(PART_ROWS, HOT * n), max(1, n // SAMPLE)
    owned = classes.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).select("x").mapInArrow(_owned(plan), "cell long, n long")
    big = owned.groupBy("cell").agg((F.sum("n") * every).alias("n")).where(F.col("n") > part_rows).orderBy("cell").collect()
    hot = np.array([r["cell"] for r in big], np.int64), np.array([-(-r["n"] // int(part_rows)) for r in big], np.int64)
    looked = (1 + plan.probes) ** plan.blocks
    table_bytes = int(n * looked * (mean + 16 + _ENTRY.itemsize)) + 1
    most = round_bytes or max(ROUND_BYTES, int(n * mean * width))
    step, cuts = max(1, most // table_bytes), max(1, -(-table_bytes // most))
    parts = max(PARTS, table_bytes * min(step, plan.tables) // cuts // PART_BYTES)
    found, kept = None, 0
    for lo in range(0, plan.tables, step):
        for cut in range(cuts):
            dealt = classes.select("id", "x").mapInArrow(_dealt(plan, range(lo, min(lo + step, plan.tables)), cut, cuts, parts, hot), "part long, dim long, rows binary, entries binary")
            met = written(dealt.repartition(min(parts, MOST_TASKS), "part").sortWithinPartitions("part", "dim").mapInArrow(trimmed(_compared(least)), "a long, b long, sure boolean"))
            # pairs come again in most tables; once they have doubled, each is kept once
            both = [x for x in (found, met) if x is not None]
            found = both[0].unionByName(met) if len(both) > 1 else met
            found._callweave_parts = [y for x in both for y in getattr(x, "_callweave_parts", [x])]
            if (lo + step >= plan.tables and cut == cuts - 1) or found.count() > 2 * kept + ROUND_PAIRS:
                once = written(found.groupBy("a", "b").agg(F.max("sure").alias("sure")))
                for x in found._callweave_parts:
                    dropped(x)
                found, kept = once, once.count()
    open_ = found.where(~F.col("sure")).select("a", "b")
    cuts = max(1, -(-int(open_.count() * mean * width * 2) // most))
    exact = [written(_exact(open_.where(F.pmod(F.xxhash64("a", "b"), F.lit(cuts)) == cut), classes, least)) for cut in range(cuts)]
    out = found.where("sure").select("a", "b")
    for x in exact:
        out = out.unionByName(x)
    return out


def near_duplicates(table: DataFrame, least: float = 0.9, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    held = F.col(vector) if table.schema[vector].dataType.elementType.typeName() == "float" else F.col(vector).cast("array<double>")
    ids = table.select(F.col(key).cast("long").alias("vec_id"), F.when(usable(table, vector) & F.col(key).isNotNull(), held).alias("x"))
    marked = ids.withColumn("h1", F.when(F.col("x").isNotNull(), F.xxhash64("x"))).withColumn("h2", F.when(F.col("x").isNotNull(), F.xxhash64(F.lit(5), "x")))
    alone = marked.where("x is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    rows = marked.where("x is not null")
    # a class of equal vectors is named by one hash; two that share it by chance are told apart by the other one
    classes = written(rows.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.min("x").alias("x")).withColumn("id", F.col("h1").bitwiseXOR(F.shiftleft("h2", 1))))
    found = written(links(classes, least))
    both = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = both.join(classes.select(F.col("id").alias("b"), "copies"), "b").groupBy("a").agg(F.sum("copies").alias("linked"))
    info = classes.select("h1", "h2", "id", "rep", "copies").join(linked.withColumnRenamed("a", "id"), "id", "left").join(components(found), "id", "left").withColumn("component", F.coalesce("component", "id"))
    least_id = info.groupBy("component").agg(F.min("rep").alias("component_id"))
    info = info.join(least_id, "component").select("h1", "h2", "copies", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), "component_id")
    out = joined_once(rows.select("vec_id", "h1", "h2"), info, ["h1", "h2"])
    return out.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept")).unionByName(alone)
