"""Exact Jaccard join of word n-gram sets: pivots, regions, windows, recursion.

Jaccard distance is a metric, and so is the size of the symmetric difference. The join
uses both, in three steps.

1. Regions of shingle pivots. Every shingle is a pivot; a set lies at distance
   1 - 1/n from the pivots that it holds and at 1 from the others, so its nearest pivots
   tie, and one order of all shingles (rare ones first) breaks the ties. The set's home
   is its first shingle. A set within the distance can have its home at most
   n - ceil(t n) places further on, so the set is replicated to the regions of so many
   pivots: no linked pair is missed.
2. Windows. In a region, a pair can be linked only if its sizes allow it (distances to
   the empty set) and if no more cells of their parity sketches differ than the largest
   allowed symmetric difference (odd cells are a lower bound of it). A large region is first
   joined by one member, its document pivot; the members that don't fall to it are
   its boundary, which meets itself and the pivot's component, once for all regions with this component.
   Documents that pairs within their windows connect make a joined region.
3. Recursion inside a joined region with documents as pivots, on exact distances. A region
   that a task can hold is joined in one: each member in turn is a pivot, and rings as wide as the
   bound keep pairs apart that the triangle inequality excludes. A larger region is
   divided into Voronoi regions of some of its documents; members near a border go to both sides
   (triangle inequality), members that links have joined already stay out, and the
   parts are joined in the same way, level by level, until they fit.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docketspark.llm import wordhash
from docketspark.llm.common import durable, partitions, small_batches
from docketspark.llm.components import connected

#: Cells of a sketch to a shingle, and the least and most of them (powers of two).
CELLS_EACH, CELLS = 2, (128, 1 << 17)
U64 = np.uint64


def _sets(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingle hashes, rising, and offsets. Works on a chunk of text at a time."""
    parts = [wordhash.distinct(*wordhash.shingles(*wordhash.words(texts[a:b]), width)) for a, b in wordhash.chunks(texts)]
    sizes = np.concatenate([np.zeros(1, np.int64), *[np.diff(o) for _, o in parts]])
    return np.concatenate([np.zeros(0, U64), *[v for v, _ in parts]]), np.cumsum(sizes)


def _as_bytes(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _running(x: np.ndarray) -> np.ndarray:
    """Sums of the first 0, 1, ... values modulo 2**64; a plain 0 in front would turn them into floats."""
    out = np.zeros(len(x) + 1, U64)
    np.cumsum(x, dtype=U64, out=out[1:])
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _surveyed(ids: pa.Array, texts: list[bytes], width: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """The survey's rows of one batch. Besides the arrays of a chunk of text it holds the batch's shingles, once."""
    held, known = [np.zeros(0, U64)], np.zeros(0, U64)
    for a, b in wordhash.chunks(texts):
        values, offsets = _sets(texts[a:b], width)
        n = np.diff(offsets)
        sums = _running(values)
        h1 = sums[offsets[1:]] - sums[offsets[:-1]]
        sums = _running(wordhash.mix(values ^ U64(0x5851F42D4C957F2D)))
        h2 = sums[offsets[1:]] - sums[offsets[:-1]]
        none = pa.nulls(len(n), pa.int64())
        yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(n), pa.array(_signed(h1)), pa.array(_signed(h2)), none, none], names)
        # copies in the batch count once
        first = np.zeros(len(n), bool)
        first[np.unique(h1, return_index=True)[1]] = True
        first &= ~np.isin(h1, known)
        known = np.concatenate([known, h1[first]])
        held.append(values[np.repeat(first, n)])
    values = np.concatenate(held)
    held.clear()
    values.sort()
    edge = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, np.int64)
    seen = np.diff(np.concatenate((edge, [len(values)])))
    often = seen >= max(2, len(texts) // 1000)
    none = pa.nulls(int(often.sum()), pa.int64())
    yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(_signed(values[edge[often]])), pa.array(seen[often])], names)


def _survey(docs: DataFrame, width: int) -> DataFrame:
    """Rows of two kinds: per document (doc_id, n, h1, h2), and (shingle, seen) of what is frequent in a task's batch."""
    schema = "doc_id long, n long, h1 long, h2 long, shingle long, seen long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _as_bytes(batch.column(1))
            for begin, end in wordhash.chunks(texts, 6 << 20):
                yield from _surveyed(batch.column(0).slice(begin, end - begin), texts[begin:end], width, names)

    names = [x.split()[0] for x in schema.split(", ")]
    return docs.mapInArrow(run, schema)


def sketches(values: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """Per set the parity, in bits, of its shingles in each cell; a set has at least CELLS_EACH cells to a shingle, up to the most."""
    n = np.diff(offsets)
    cells = np.minimum(np.maximum(CELLS[0], 1 << np.ceil(np.log2(np.maximum(CELLS_EACH * n, 1))).astype(np.int64)), CELLS[1])
    at = np.concatenate(([0], np.cumsum(cells)))
    owner = np.repeat(np.arange(len(n)), n)
    cell = at[owner] + ((values >> U64(20)).astype(np.int64) & (cells[owner] - 1))
    packed = np.packbits((np.bincount(cell, minlength=at[-1]) & 1).astype(np.uint8), bitorder="little").tobytes()
    return [packed[a >> 3 : b >> 3] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _replicas(docs: DataFrame, width: int, percent: float, common: np.ndarray, often: np.ndarray) -> DataFrame:
    """doc_id, n, h1, h2, pivots (the regions of a set) and its sketch. `often` are the frequencies of the shingles `common`."""
    schema = "doc_id long, n long, h1 long, h2 long, pivots array<long>, sketch binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), _as_bytes(batch.column(1))
            for begin, end in wordhash.chunks(texts):
                values, offsets = _sets(texts[begin:end], width)
                n = np.diff(offsets)
                owner = np.repeat(np.arange(len(n)), n)
                sums = _running(values)
                mixed = _running(wordhash.mix(values ^ U64(0x5851F42D4C957F2D)))
                h1, h2 = sums[offsets[1:]] - sums[offsets[:-1]], mixed[offsets[1:]] - mixed[offsets[:-1]]
                rank = np.zeros(len(values), np.int64)
                if len(common):
                    at = np.minimum(np.searchsorted(common, values), len(common) - 1)
                    rank = np.where(common[at] == values, often[at], 0)
                order = np.lexsort((values, rank, owner))
                kept = (n - -(-n * percent // 100) + (n > 0)).astype(np.int64)
                place = np.arange(len(values)) - np.repeat(offsets[:-1], n)
                chosen = values[order][place < np.repeat(kept, n)]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(kept))).astype(np.int32)), pa.array(_signed(chosen)))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(begin, end - begin), pa.array(n), pa.array(_signed(h1)), pa.array(_signed(h2)), lists, pa.array(sketches(values, offsets), pa.binary())], names
                )

    names = [x.split()[0] for x in schema.split(", ")]
    return docs.mapInArrow(run, schema)


def _pairs(regions: DataFrame, percent: float, small: int) -> DataFrame:
    """From regions (pivot, id, n), sorted: of those of 2 to `small` members all pairs (a, b) whose sizes allow a link,
    a < b; of larger ones a row (id, pivot) per member, marked as large. A task holds `small` rows and a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((3, 0), np.int64)  # rows of the last region so far, while they are few
        passing = None  # the last region, once it is known to be large
        names = ["a", "b", "large"]

        def listed(rows: np.ndarray, large: np.ndarray) -> pa.RecordBatch:
            edge = np.flatnonzero(np.diff(rows[0])) + 1
            starts, stops = np.concatenate(([0], edge)), np.concatenate((edge, [rows.shape[1]]))
            sizes = stops - starts
            out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for m in np.unique(sizes[(sizes > 1) & (sizes <= small) & ~large[starts]]):
                i, j = np.triu_indices(m, 1)
                at = starts[(sizes == m) & ~large[starts]][:, None]
                x, y = (at + i).ravel(), (at + j).ravel()
                ok = (100 * rows[2][x] >= percent * rows[2][y]) & (rows[1][x] != rows[1][y])  # rows of a region rise in n
                out_a.append(np.minimum(rows[1][x], rows[1][y])[ok])
                out_b.append(np.maximum(rows[1][x], rows[1][y])[ok])
            many = np.repeat(sizes > small, sizes) | large
            a, b = np.concatenate([*out_a, rows[1][many]]), np.concatenate([*out_b, rows[0][many]])
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.arange(len(a)) >= len(a) - many.sum())], names)

        for batch in batches:
            rows = np.concatenate([held, np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])], axis=1)
            if not rows.shape[1]:
                continue
            large = rows[0] == passing if passing is not None else np.zeros(rows.shape[1], bool)
            last = rows[0] == rows[0][-1]
            if large[-1] or last.sum() > small:
                passing, held = int(rows[0][-1]), np.zeros((3, 0), np.int64)
                yield listed(rows, large | last)
            else:
                passing, held = None, rows[:, last]
                if not last.all():
                    yield listed(rows[:, ~last], large[~last])
        if held.shape[1]:
            yield listed(held, np.zeros(held.shape[1], bool))

    return regions.mapInArrow(run, "a long, b long, large boolean")


def _odd(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many cells the parities differ, of sketches (rows of bytes) that are folded to the shorter ones' size."""
    while a.shape[-1] > b.shape[-1]:
        a = a[..., : a.shape[-1] // 2] ^ a[..., a.shape[-1] // 2 :]
    while b.shape[-1] > a.shape[-1]:
        b = b[..., : b.shape[-1] // 2] ^ b[..., b.shape[-1] // 2 :]
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def _within(odd: np.ndarray, n: np.ndarray, percent: float) -> np.ndarray:
    """Whether the odd cells are no more than the largest symmetric difference of a link, (1 - t) / (1 + t) * n
    for sizes that sum up to n. The odd cells never exceed the true difference."""
    return (100 + percent) * odd <= (100 - percent) * n


def _window(pairs: DataFrame, percent: float) -> DataFrame:
    """The pairs (a, b, na, nb, ca, cb) whose sizes and sketches allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ca, cb = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            na, nb = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            shape = np.array([(len(x), len(y)) for x, y in zip(ca, cb, strict=True)]).reshape(-1, 2)
            ok = 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)
            for x, y in np.unique(shape, axis=0):
                rows = np.flatnonzero((shape == (x, y)).all(axis=1) & ok)
                if len(rows):
                    a, b = (np.frombuffer(b"".join(c[i] for i in rows), np.uint8).reshape(len(rows), -1) for c in (ca, cb))
                    ok[rows] = _within(_odd(a, b), na[rows] + nb[rows], percent)
            yield batch.select([0, 1]).filter(pa.array(ok))

    return pairs.select("a", "b", "na", "nb", "ca", "cb").mapInArrow(run, "a long, b long")


def _ends(pairs: DataFrame, sets: DataFrame, salts: int = 1) -> DataFrame:
    """Pairs (a, b) with both ends' sizes and sketches. b may be the end of very many pairs: it is dealt over `salts` parts."""
    size = lambda k: sets.select(F.col("id").alias(k), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"c{k}"))
    left = pairs.join(size("a"), "a")
    if salts == 1:
        return left.join(size("b"), "b")
    asked = size("b").join(pairs.select("b").distinct(), "b", "left_semi").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(salts)).cast("int")).join(asked, ["b", "salt"]).drop("salt")


def _window_blocks(rows: DataFrame, sets: DataFrame, percent: float, most: int) -> DataFrame:
    """At least one candidate of each member and each component that it has a candidate in, within regions.

    `rows` is (region, group, id, comp): pairs of one region are tested whose comps differ and whose
    groups are 0 and 0, or 0 and 1; pairs of two members of group 1 never are. Members are dealt into blocks of about
    `most` of a group, in the order of their sizes; each pair of blocks whose sizes allow a link is a task.
    Sketches join their rows after the dealing, so they are shuffled once.
    """
    rows = rows.join(sets.select("id", "n").distinct(), "id")
    rows = rows.withColumn("class", F.floor(F.log("n") / max(math.log(100 / percent), 0.01)).cast("int"))
    key = ["region", "group", "class"]
    classes = rows.groupBy(key).agg(F.count("*").alias("m"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    above = W.partitionBy("region", "group").orderBy("class").rowsBetween(W.unboundedPreceding, -1)  # a row per class of sizes
    classes = durable(classes.withColumn("before", F.coalesce(F.sum("m").over(above), F.lit(0))))
    block = lambda place: F.floor(place / most).cast("int")
    rows = rows.join(classes.select(*key, "m", "before"), key).withColumn("own", block(F.col("before") + F.pmod(F.xxhash64(F.lit(2), "id"), "m")))
    spans = classes.withColumn("own", F.explode(F.sequence(block(F.col("before")), block(F.col("before") + F.col("m") - 1))))
    spans = spans.groupBy("region", "group", "own").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    first = spans.where("group = 0").select("region", F.col("own").alias("i"), F.col("lo").alias("lo_i"), F.col("hi").alias("hi_i"))
    pairs = first.join(spans, "region").where((F.col("group") == 1) | (F.col("i") <= F.col("own")))
    pairs = pairs.where((100 * F.col("hi_i") >= percent * F.col("lo")) & (100 * F.col("hi") >= percent * F.col("lo_i")))
    task = F.struct("i", F.col("own").alias("j"), F.col("group").alias("kind")).alias("task")
    ends = F.array_distinct(F.array(F.struct(F.lit(0).alias("group"), F.col("i").alias("own")), F.struct("group", "own")))
    tasks = pairs.select("region", task, F.explode(ends).alias("end")).select("region", "task", "end.group", "end.own")
    rows = rows.join(tasks, ["region", "group", "own"]).select("region", "task", "group", "own", "id", "n", "comp")
    rows = rows.join(sets.select("id", "n", "sketch"), ["id", "n"])

    def run(table: pa.Table) -> pa.Table:
        kind, cut = table.column("task")[0].as_py()["kind"], table.column("task")[0].as_py()
        group, own, ids, n, comp = (table.column(c).to_numpy() for c in ("group", "own", "id", "n", "comp"))
        order = np.lexsort((ids, n))
        group, own, ids, n, comp = (x[order] for x in (group, own, ids, n, comp))
        comp = np.unique(comp, return_inverse=True)[1]
        sketch = [table.column("sketch")[int(i)].as_py() for i in order]
        length = np.array([len(s) for s in sketch])
        parts = {int(k): np.frombuffer(b"".join(s for s in sketch if len(s) == k), np.uint8).reshape(-1, k) for k in np.unique(length)}
        place = np.empty(len(sketch), np.int64)
        for k in parts:
            place[length == k] = np.arange((length == k).sum())
        side = group if kind else (own if cut["i"] != cut["j"] else None)  # only pairs of different sides count
        out = []
        for at in range(len(ids)):
            if kind and group[at]:
                continue
            low = np.searchsorted(n, -(-n[at] * percent // 100)) if kind else at + 1
            span = np.arange(low, np.searchsorted(n, n[at] * 100 // percent, side="right"))  # sizes of a link differ by no more
            span = span[(comp[span] != comp[at]) & (True if side is None else side[span] != side[at])]
            for k in parts:
                some = span[length[span] == k]
                if len(some):
                    some = some[_within(_odd(parts[k][place[some]], parts[int(length[at])][place[at]][None, :]), n[at] + n[some], percent)]
                for c in np.unique(comp[some]):
                    if c != comp[at]:
                        out.append((ids[at], ids[some[comp[some] == c][0]]))
                        comp[comp == c] = comp[at]
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})

    return rows.groupBy("region", "task").applyInArrow(run, "a long, b long")


def _near(sets: DataFrame, percent: float, small: int, block: int) -> DataFrame:
    """Candidate links (a, b): they connect all pairs that share a region and whose windows allow a link.

    Large regions are first joined by a document pivot each, the member with the least hash, so
    regions with much the same members agree on it. Members that don't fall to their region's pivot
    are its boundary: they are compared with each other and with the pivot's component, once
    for all regions whose pivots have this component.
    """
    spark = sets.sparkSession
    regions = sets.select(F.explode("pivots").alias("pivot"), "id", "n")
    # regions so large that one task shouldn't even list them, found on a bounded sample; this changes the plan, not the result
    rows = sets.count()
    seen = sets.sample(min(1.0, 50_000 / max(1, rows)), 7).select(F.explode("pivots").alias("pivot")).groupBy("pivot").count()
    hot = durable(seen.where(F.col("count") >= max(4 * small, min(rows, 50_000) // 500)).select("pivot"))
    cold = regions.join(F.broadcast(hot), "pivot", "left_anti")  # at most 500 times a set's pivots
    cold = cold.repartition(partitions(spark), "pivot").sortWithinPartitions("pivot", "n", "id")
    listed = durable(_pairs(cold, percent, small))
    large = listed.where("large").select(F.col("a").alias("id"), F.col("b").alias("pivot"))
    large = large.unionByName(regions.join(F.broadcast(hot), "pivot", "left_semi").select("id", "pivot")).distinct()
    # sketches are shuffled only for sets that a pair or a large region has
    ends = listed.select(F.explode(F.when(F.col("large"), F.array("a")).otherwise(F.array("a", "b"))).alias("id"))
    ends = ends.unionByName(regions.join(F.broadcast(hot), "pivot", "left_semi").select("id"))
    sets = _likely(sets.select("id", "n", "sketch"), ends)
    none = listed.where("large").isEmpty() and hot.isEmpty()
    if none:
        return durable(_window(_ends(listed.select("a", "b").distinct(), sets), percent))

    first = large.groupBy("pivot").agg(F.min(F.struct(F.xxhash64("id").alias("h"), F.col("id").alias("first"))).getField("first").alias("first"))
    large = durable(large.join(first, "pivot"))
    stars = large.where("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b")).distinct()
    stars = durable(_window(_ends(stars, sets, 32), percent))
    comps = durable(connected(stars))
    comp = lambda k: comps.select(F.col("id").alias(k), F.col("component").alias(f"{k}_comp"))
    large = large.join(comp("id"), "id", "left").join(comp("first"), "first", "left")
    outside = large.select("pivot", "id", F.coalesce("id_comp", "id").alias("comp"), F.coalesce("first_comp", "first").alias("main")).where("comp <> main")
    outside = durable(outside)
    # the boundary against the pivots' components and its members with each other, once for all regions with one component
    facing = outside.groupBy("main", "id").agg(F.first("comp").alias("comp"))
    mains = facing.select("main").distinct()
    own = comps.select(F.col("component").alias("main"), "id").unionByName(mains.select("main", F.col("main").alias("id"))).distinct()
    own = own.join(mains, "main", "left_semi").select("main", F.lit(1).alias("group"), "id", F.col("main").alias("comp"))
    facing = facing.select("main", F.lit(0).alias("group"), "id", "comp").unionByName(own).withColumn("region", F.xxhash64(F.lit(1), "main"))
    pairs = listed.where("not large").select("a", "b").distinct()
    return durable(stars.unionByName(_window(_ends(pairs, sets), percent)).unionByName(_window_blocks(facing, sets, percent, block)))


class Region:
    """The sets of one region in one array, with inner products by binary search."""

    def __init__(self, ids: np.ndarray, sets: list[np.ndarray], percent: float):
        order = np.argsort([len(s) for s in sets], kind="stable")
        self.order = order
        self.ids, self.sets = ids[order], [sets[i] for i in order]
        self.n = np.array([len(s) for s in self.sets], np.int64)
        self.values = np.concatenate([np.zeros(0, U64), *self.sets])
        self.percent = percent

    def shared(self, pivot: np.ndarray, members: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of the set `pivot` with the members' sets."""
        if len(members) == len(self.n):
            values, n = self.values, self.n
        else:
            values, n = np.concatenate([self.sets[i] for i in members]), self.n[members]
        return _shared(pivot, values, n)

    def links(self, joined: np.ndarray) -> list[tuple[int, int]]:
        """Links that connect what links connect. `joined`, in the order of `ids` as they were given, has equal
        numbers for members that are known to be connected.

        Each member in turn is the pivot for all members of other components whose size and whose distances
        to the pivots so far differ from its own by no more than the bound.
        """
        m, out = len(self.n), []
        component = np.unique(joined[self.order], return_inverse=True)[1]
        bound = 1 - self.percent / 100 + 1e-9
        rings: list[np.ndarray] = []  # distances to earlier pivots, NaN where unknown
        degree = np.zeros(m)
        todo = np.ones(m, bool)
        for turn in range(m):
            if (component == component[0]).all():
                break
            # the first pivots are spread; then those that most pivots link to, which join most
            open_ = np.flatnonzero(todo)
            i = open_[np.argmax(degree[open_])] if turn >= 8 or degree.max() > 1 else open_[len(open_) // 2]
            todo[i] = False
            n = self.n[i]
            ok = todo & (component != component[i]) & (100 * np.minimum(n, self.n) >= self.percent * np.maximum(n, self.n))
            for ring in rings:
                gap = np.abs(ring - ring[i])
                ok &= ~(gap > bound)
            members = np.flatnonzero(ok)
            if not len(members):
                continue
            both = self.shared(self.sets[i], members)
            union = n + self.n[members] - both
            if len(rings) < 16 and len(members) > m // 4:
                ring = np.full(m, np.nan)
                ring[members], ring[i] = 1 - both / union, 0.0
                rings.append(ring)
            near = members[100 * both >= self.percent * union]
            degree[near] += 1
            if len(near):
                out += [(int(self.ids[i]), int(self.ids[j])) for j in near]
                component[np.isin(component, component[near])] = component[i]
        return out


def _shared(pivot: np.ndarray, values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the set `pivot` with sets of sizes n that lie end to end in `values`."""
    at = np.minimum(np.searchsorted(pivot, values), len(pivot) - 1)
    hits = np.concatenate(([0], np.cumsum(pivot[at] == values)))
    ends = np.cumsum(n)
    return hits[ends] - hits[ends - n]


def _join_regions(members: DataFrame, width: int, percent: float) -> DataFrame:
    """Links (a, b) inside each region of (region, id, text, joined), each region in one task; its size is checked before.

    Regions come sorted, so a task holds one region's sets at a time.
    """
    spark = members.sparkSession
    ordered = members.select("region", "id", "text", "joined").repartition(partitions(spark), "region").sortWithinPartitions("region", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, joined, sets = None, [], [], []

        def done() -> Iterator[pa.RecordBatch]:
            if len(ids) > 1:
                found = Region(np.concatenate(ids), sets, percent).links(np.concatenate(joined))
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            regions, names, labels = (batch.column(i).to_numpy() for i in (0, 1, 3))
            texts = _as_bytes(batch.column(2))
            for begin, end in wordhash.chunks(texts):
                values, offsets = _sets(texts[begin:end], width)
                for i in range(begin, end):
                    if regions[i] != now:
                        yield from done()
                        now, ids, joined, sets = regions[i], [], [], []
                    if offsets[i - begin + 1] > offsets[i - begin]:
                        ids.append(names[i : i + 1])
                        joined.append(labels[i : i + 1])
                        sets.append(values[offsets[i - begin] : offsets[i - begin + 1]].copy())
        yield from done()

    return ordered.mapInArrow(run, "a long, b long")


def _divide(members: DataFrame, sizes: DataFrame, width: int, percent: float, most: int, level: int, pivots: int = 8) -> tuple[DataFrame, DataFrame]:
    """One level of the recursion over regions that are too large for a task: (links, members of smaller regions).

    `pivots` members of each region, those with the least hashes, get exact distances to all members, in
    parts of about `most` shingles. Members within the bound are linked. Every member goes to the Voronoi region of its
    nearest pivot, and to those of other pivots that are no more than twice the bound further: a linked
    pair then meets where either of the two is at home. In a Voronoi region, the members that links join with the pivot
    need each other no longer; only those whose distance from the pivot is within the bound of another member's stay.
    """
    spark = members.sparkSession
    rank = F.row_number().over(W.partitionBy("region").orderBy(F.xxhash64(F.lit(level), "id"), "id"))
    chosen = members.select("region", "id").withColumn("k", rank).where(F.col("k") <= pivots)
    parts = F.greatest(F.ceil(F.col("shingles") / most), F.lit(1)).cast("int")
    placed = members.join(sizes.select("region", parts.alias("parts")), "region")
    texts = placed.join(chosen, ["region", "id"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    texts = texts.select("region", "part", F.lit(0).alias("own"), "k", "id", "text")
    own = placed.select("region", F.pmod(F.xxhash64(F.lit(3), "id"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("own"), F.lit(0).alias("k"), "id", "text")
    own, texts = own.withColumn("key", F.xxhash64("text")), texts.withColumn("key", F.xxhash64("text"))
    ordered = texts.unionByName(own).repartition(partitions(spark), "region", "part").sortWithinPartitions("region", "part", "own", "k", "id")

    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in (0, 1, 2, 3, 4, 6)]
            texts = _as_bytes(batch.column(5))
            out = []
            for begin, end in wordhash.chunks(texts):
                values, offsets = _sets(texts[begin:end], width)
                for i in range(begin, end):
                    region, part, own, k, name, key = (c[i] for c in columns)
                    mine = values[offsets[i - begin] : offsets[i - begin + 1]]
                    if (region, part) != now:
                        now, held = (region, part), []
                    if not len(mine):
                        continue
                    if not own:
                        held.append((k, name, mine.copy()))
                        continue
                    for k, pivot, theirs in held:
                        both = int(_shared(theirs, mine, np.array([len(mine)]))[0])
                        union = len(theirs) + len(mine) - both
                        out.append((region, name, key, k, pivot, 1 - both / union, 100 * both >= percent * union and pivot != name))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["region", "id", "key", "k", "pivot", "d", "near"])

    d = durable(ordered.mapInArrow(far, "region long, id long, key long, k int, pivot long, d double, near boolean"))
    links = d.where("near").select(F.col("pivot").alias("a"), F.col("id").alias("b"))
    label = durable(connected(links))
    bound = 1 - percent / 100 + 1e-9
    home = d.groupBy("region", "id", "key").agg(F.min("d").alias("least"))
    near = d.join(home, ["region", "id", "key"]).where(F.col("d") <= F.col("least") + 2 * bound)
    near = near.join(label.select("id", F.col("component").alias("x")), "id", "left").join(label.select(F.col("id").alias("pivot"), F.col("component").alias("y")), "pivot", "left")
    near = near.select(F.xxhash64("region", "k").alias("region"), "id", "key", "d", F.coalesce("x", "id").alias("joined"), F.coalesce("y", "pivot").alias("main"))
    near = durable(near)
    other = near.where("joined <> main").groupBy("region").agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    kept = near.join(other, "region").where((F.col("joined") != F.col("main")) | F.col("d").between(F.col("lo") - bound, F.col("hi") + bound))
    texts = members.select("id", F.xxhash64("text").alias("key"), "text").dropDuplicates(["id", "key"])
    kept = kept.select("region", "id", "key", "joined").distinct().join(texts, ["id", "key"])
    return links, kept.select("region", "id", "text", "joined")


def _in_blocks(members: DataFrame, sizes: DataFrame, most: int) -> DataFrame:
    """Regions that pivots don't part, as regions of two blocks each, of about `most` shingles together."""
    blocks = F.greatest(F.ceil(2 * F.col("shingles") / most), F.lit(1)).cast("int")
    placed = members.join(sizes.select("region", blocks.alias("blocks")), "region").withColumn("own", F.pmod(F.xxhash64(F.lit(5), "id"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return placed.select(F.xxhash64("region", F.least("own", "other"), F.greatest("own", "other")).alias("region"), "id", "text", "joined")


def _likely(rows: DataFrame, chosen: DataFrame, bits: int = 1 << 25) -> DataFrame:
    """The rows whose first column, an id, may be among the ids of `chosen`: those whose bit is set in a bitmap of
    fixed size. It saves shuffling the texts or sketches of all others; when it fills up it lets more pass, never fewer."""
    at = F.pmod(F.xxhash64("id"), F.lit(bits))
    found = chosen.select(at.alias("h")).groupBy(F.bitmap_bucket_number("h").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("map")).collect()
    table = np.zeros(bits // 8 + (1 << 12), np.uint8)
    for row in found:  # bucket k holds the numbers from (k - 1) * 32768 + 1 on, bucket 0 only 0
        begin = row["k"] << 12 if row["k"] else None
        part = np.frombuffer(bytes(row["map"]), np.uint8)
        if begin is None:
            table[0] |= part[0] & 1
        else:
            table[begin : begin + len(part)] |= part[: len(table) - begin]
    held = table.tobytes()  # in the task's closure, which Spark drops with the job
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits_set = np.frombuffer(held, np.uint8)
        for batch in batches:
            # number h is bit (h - 1) % 32768 of bucket (h + 32767) // 32768, and 0 that of bucket 0
            h = batch.column(len(names)).to_numpy()
            place = np.where(h > 0, h - 1 + (1 << 15), 0)
            yield batch.select(list(range(len(names)))).filter(pa.array((bits_set[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)))

    return rows.where(F.col(names[0]).isNotNull()).select("*", F.pmod(F.xxhash64(names[0]), F.lit(bits)).alias("_h")).mapInArrow(run, rows.schema)


def links_of(d: DataFrame, sets: DataFrame, width: int, percent: float, small: int, most: int, block: int = 512) -> DataFrame:
    """Links (a, b) that connect what the links of all pairs connect that share a region.

    `sets` is (id, n, pivots, sketch), kept by the caller: a set's size, its regions and its sketch;
    `d` is (doc_id, text) with the texts of these ids. Pairs are tested exactly, those in large regions too.
    """
    merged = durable(connected(_near(sets, percent, small, block)))
    weights = merged.join(sets.groupBy("id").agg(F.sum("n").alias("n")), "id").groupBy("component").agg(F.sum("n").alias("shingles"))
    weights = durable(weights.select(F.col("component").alias("region"), "shingles"))
    members = _likely(d.select("doc_id", "text"), merged).join(merged, F.col("doc_id") == F.col("id")).select(F.col("component").alias("region"), "id", "text", F.col("id").alias("joined"))
    large = weights.where(F.col("shingles") > most)
    if large.isEmpty():
        return durable(_join_regions(members, width, percent))
    members = durable(members)
    links = [durable(_join_regions(members.join(large, "region", "left_anti"), width, percent))]
    members, before, level = durable(members.join(large.select("region"), "region", "left_semi")), None, 0
    size_of = durable(sets.groupBy("id").agg(F.sum("n").alias("n")))
    while True:
        sizes = durable(members.select("region", "id").join(size_of, "id").groupBy("region").agg(F.sum("n").alias("shingles")))
        fits = sizes.where(F.col("shingles") <= most)
        links.append(durable(_join_regions(members.join(fits, "region", "left_semi"), width, percent)))
        sizes = durable(sizes.where(F.col("shingles") > most))
        total = sizes.agg(F.sum("shingles")).first()[0]
        if total is None:
            break
        members = durable(members.join(sizes.select("region"), "region", "left_semi"))
        if before is not None and total > 0.7 * before:
            links.append(durable(_join_regions(_in_blocks(members, sizes, most), width, percent)))
            break
        found, members = _divide(members, sizes, width, percent, most, level)
        links.append(found)
        members, before, level = durable(members), total, level + 1
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return out


def jaccard_join(docs: DataFrame, width: int = 4, percent: int = 85, small: int = 24, most: int = 1_000_000) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Documents link when 100 * intersection >= percent * union of their sets of `width`-word
    shingles (white-space words, A-Z lower-cased; a shorter text is one shingle). A null
    text, or one without words, has an empty set, links with nothing and is its own
    component. Rows with equal doc_id are one document with the links of all; a row
    without doc_id takes no part and has a null component. Equal sets are joined first,
    so copies cost one set. Shingles are compared as 64-bit hashes. `small` bounds the
    regions whose pairs are listed, `most` the shingles of a region that one task joins;
    both only change the plan, not the result.
    """
    small_batches(docs.sparkSession)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    survey = durable(_survey(d, width))
    each = survey.where("n is not null").select("doc_id", "n", "h1", "h2")
    total = each.count()
    counted = survey.where("shingle is not null").groupBy("shingle").agg(F.sum("seen").alias("seen"))
    # at most (mean set size) * 5000 shingles can reach a 5000th of the documents, so the list stays small at every size
    rows = counted.where(F.col("seen") >= max(8, total // 5000)).collect()
    rows.sort(key=lambda r: r["shingle"] % (1 << 64))
    common, often = np.array([r["shingle"] % (1 << 64) for r in rows], U64), np.array([r["seen"] for r in rows], np.int64)

    classes = durable(each.where("doc_id is not null and n > 0").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("rep")))
    tagged = durable(each.join(classes, ["n", "h1", "h2"], "left").select("doc_id", "n", "rep"))
    replicas = _replicas(d.where("doc_id is not null"), width, percent, common, often)
    c = classes.select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), F.col("n").alias("k0"), "rep")
    sets = replicas.join(c, (F.col("doc_id") == F.col("rep")) & (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")) & (F.col("n") == F.col("k0")))
    sets = durable(sets.select(F.col("doc_id").alias("id"), "n", "h1", "h2", "pivots", "sketch").dropDuplicates(["id", "n", "h1", "h2"]))

    links = links_of(d, sets, width, percent, small, most)
    # documents with rows in several classes connect these
    least = tagged.where("doc_id is not null and rep is not null").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a <> z")
    links = links.unionByName(tagged.join(least, "doc_id").where("rep <> a").select("a", F.col("rep").alias("b")))
    found = connected(durable(links)).withColumnRenamed("id", "rep")
    # an empty row of a document that has other rows is in their component
    empty = tagged.where("doc_id is not null and rep is null").select("doc_id").distinct()
    full = tagged.where("rep is not null").join(empty, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("rep").alias("full"))
    tagged = tagged.join(full, "doc_id", "left").withColumn("rep", F.coalesce("rep", "full"))
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component", "rep", "doc_id"))
    return tagged.join(found, "rep", "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
