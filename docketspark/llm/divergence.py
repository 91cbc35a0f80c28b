"""Source divergence audit over the matrix of groups and terms, as a K-squared quadtree with K = 2.

A language's matrix has a row per source and a column per kept term. Prices (scaled, smoothed shares) of a
row differ from the price of a zero count only where the row has a count. So the distance of two rows is

    V * d0  +  sums over each row's own nonzeros of (|p - other's zero price| - d0)
            +  sums over nonzeros of both of (|p - p'| - |p - zero'| - |zero - p'| + d0),

with d0 the distance of the two zero prices: the first part prices zeros without reading them, the
second reads one row, and only the last needs two rows. For that the matrix is a quadtree whose all-zero quadrants
end a branch; two rows' branches are walked together and go on only where both quadrants hold counts.

The upper levels are Spark's: blocks of `block` rows and tiles of terms, of which only nonzero pairs of blocks meet
in a task. The lower levels are arrays within a task.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docketspark.llm.common import durable, parts_for, small_batches

#: Side of the quadtree's leaves, which are dense.
LEAF = 8
SCALE, SMOOTH = 1_000_000_000, 5
_SEPARATED = bytes(c if c >= 0x80 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def terms_of(text: str, piece: int = 1 << 20) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, in lists of about a megabyte: runs of letters and of everything beyond ASCII, A-Z lower-cased."""
    data = text.encode("utf-8", "surrogatepass").translate(_SEPARATED)
    begin = 0
    while begin < len(data):
        end = data.find(b" ", begin + piece)
        end = len(data) if end < 0 else end
        yield data[begin:end].split()
        begin = end


def counted(batches: Iterator[pa.RecordBatch], most: int = 500_000) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of rows (lang, source, text), summed within a task; a row without a term for each group.

    A task holds at most about `most` sums, plus one document's, before it hands them on.
    """
    uses: dict = defaultdict(Counter)
    docs: dict = defaultdict(Counter)

    def handed() -> pa.RecordBatch:
        names = [(g, t) for g, c in uses.items() for t in (None, *c)]
        columns = [
            pa.array([g[0] for g, _ in names], pa.string()), pa.array([g[1] for g, _ in names], pa.string()), pa.array([t for _, t in names], pa.binary()).cast(pa.string()),
            pa.array([0 if t is None else uses[g][t] for g, t in names], pa.int64()), pa.array([0 if t is None else docs[g][t] for g, t in names], pa.int64()),
        ]
        uses.clear()
        docs.clear()
        return pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])

    held = 0
    for batch in batches:
        for lang, source, text in zip(*(batch.column(i) for i in range(3)), strict=True):
            group = (lang.as_py(), source.as_py())
            own, before, seen = uses[group], len(uses[group]), set()
            for terms in terms_of(text.as_py()):
                own.update(terms)
                seen.update(terms)
            docs[group].update(seen)
            held += len(own) - before
            if held >= most:
                yield handed()
                held = 0
    if uses:
        yield handed()


def price(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (n + SMOOTH) / (total + SMOOTH * kept)) in exact arithmetic; null where nothing is kept."""
    wide = lambda c: c.cast("decimal(20,0)")
    over = F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (wide(n) + wide(F.lit(SMOOTH))), wide(total) + wide(F.lit(SMOOTH)) * wide(kept))
    return F.when(kept > 0, over + 1).cast("long")


class Quadtree:
    """The nonzero quadrants of a matrix of prices: `levels[0]` are the leaves, each next level halves both sides."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, prices: np.ndarray, zero: np.ndarray):
        code = (rows // LEAF) << 32 | columns // LEAF
        leaves, at = np.unique(code, return_inverse=True)
        self.levels = [leaves]
        while (now := self.levels[-1])[-1] > 0 or len(now) > 1:
            self.levels.append(np.unique(((now >> 32) >> 1) << 32 | (now & 0xFFFFFFFF) >> 1))
        self.zero = np.concatenate((zero, np.zeros(-len(zero) % LEAF, np.int64))).reshape(-1, LEAF)
        self.tiles = np.repeat(self.zero[leaves >> 32][:, :, None], LEAF, axis=2)  # zeros have the row's zero price
        self.tiles[at, rows % LEAF, columns % LEAF] = prices

    def has(self, level: int, row: np.ndarray, column: np.ndarray) -> np.ndarray:
        codes, want = self.levels[level], row << 32 | column
        return codes[np.minimum(np.searchsorted(codes, want), len(codes) - 1)] == want

    def joint_leaves(self, first: range, second: range) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(leaf row, leaf row, leaf column) where a row of `first` and one of `second` (not before it) both have a nonzero leaf."""
        a = b = c = np.zeros(1, np.int64)
        for level in range(len(self.levels) - 2, -1, -1):
            side, found = LEAF << level, []
            for i, j, k in ((i, j, k) for i in (0, 1) for j in (0, 1) for k in (0, 1)):
                x, y, z = 2 * a + i, 2 * b + j, 2 * c + k
                keep = (x <= y) & (x * side < first.stop) & ((x + 1) * side > first.start) & (y * side < second.stop) & ((y + 1) * side > second.start)
                x, y, z = x[keep], y[keep], z[keep]
                keep = self.has(level, x, z) & self.has(level, y, z)
                found.append((x[keep], y[keep], z[keep]))
            a, b, c = (np.concatenate(v) for v in zip(*found, strict=True))
        return a, b, c

    def joint(self, first: range, second: range, at_once: int = 1024) -> np.ndarray:
        """Rows x rows: for each pair the sum over terms that both have; other entries don't count."""
        n = len(self.zero) * LEAF
        out = np.zeros((len(self.zero), LEAF, len(self.zero), LEAF), np.int64)
        a, b, c = self.joint_leaves(first, second)
        leaf = lambda row, column: np.searchsorted(self.levels[0], row << 32 | column)
        for i in range(0, len(a), at_once):
            x, y, z = (v[i : i + at_once] for v in (a, b, c))
            p, q = self.tiles[leaf(x, z)][:, :, None, :], self.tiles[leaf(y, z)][:, None, :, :]
            p0, q0 = self.zero[x][:, :, None, None], self.zero[y][:, None, :, None]
            np.add.at(out, (x, slice(None), y), (np.abs(p - q) - np.abs(p - q0) - np.abs(p0 - q) + np.abs(p0 - q0)).sum(axis=3))
        return out.reshape(n, n)


def one_sided(rows: np.ndarray, prices: np.ndarray, zero: np.ndarray) -> np.ndarray:
    """[a, b]: over a's nonzeros, the sum of |p - b's zero price| less the distance of the zero prices."""
    out = np.zeros((len(zero), len(zero)), np.int64)
    pairs, times = np.unique(np.stack((rows, prices)), axis=1, return_counts=True)
    starts = np.searchsorted(pairs[0], np.arange(len(zero) + 1))
    for a in range(len(zero)):
        p, h = pairs[1, starts[a] : starts[a + 1]], times[starts[a] : starts[a + 1]]
        for i in range(0, len(p), 4096):
            out[a] += h[i : i + 4096] @ np.abs(p[i : i + 4096, None] - zero[None, :])
        out[a] -= h.sum() * np.abs(zero[a] - zero)
    return out


def pair_sums(cells: pa.Table, sources: pa.Table) -> pa.Table:
    """Of one tile and two blocks of rows: (a, b, part) for pairs of rows a < b, one of each block. cells: nonzeros (row, term, p);
    sources: the blocks' rows (row, own, zero), where own is the block's number."""
    ids, first = np.unique(sources["row"].to_numpy(), return_index=True)
    zero, block = sources["zero"].to_numpy()[first], sources["own"].to_numpy()[first]
    split = int((block == block[0]).sum()) if len(ids) else 0
    blocks = (range(0, len(ids)), range(0, len(ids))) if split == len(ids) else (range(0, split), range(split, len(ids)))
    if cells.num_rows == 0:
        return pa.table({n: pa.array([], pa.int64()) for n in ("a", "b", "part")})
    rows, prices = np.searchsorted(ids, cells["row"].to_numpy()), cells["p"].to_numpy()
    columns = cells["term"].combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
    alone = one_sided(rows, prices, zero)
    both = Quadtree(rows, columns, prices, zero).joint(*blocks)[: len(ids), : len(ids)]
    total = alone + alone.T + both
    a, b = np.triu_indices(len(ids), 1)
    keep = (a < blocks[0].stop) & (b >= blocks[1].start)
    a, b = a[keep], b[keep]
    return pa.table({"a": ids[a], "b": ids[b], "part": total[a, b]})


def source_divergence(docs: DataFrame, least_docs: int = 30, most_terms: int = 50, block: int = 256, cells_each: int = 50_000, tile_terms: int = 100) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source's use of terms lies from other sources' and from its language's.

    Null text, lang and source are ''. A language keeps the terms of at least `least_docs` of its documents. Part `pair` has every
    other source of the language, the sum of price distances over all kept terms, all ranks; part `term` the `most_terms` terms that the
    group uses most beyond its language. Groups without a term are groups; a language of one source has no pair, and
    without kept terms pairs have 0. Every row counts, repeated ones too; other columns play no part; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    read = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    sums = docs.select(*read).mapInArrow(counted, "lang string, source string, term string, n long, docs long")
    # summed within tasks already, so one shuffle by term serves the sums by source and those by language; rare terms end here
    term = W.partitionBy("lang", "term")
    cells = sums.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    cells = cells.withColumns({"docs": F.sum("docs").over(term), "n_lang": F.sum("n").over(term), "first": F.row_number().over(term.orderBy("source")) == 1})
    cells = durable(cells.where((F.col("docs") >= least_docs) | F.col("term").isNull()).drop("docs"))
    uses = cells.where("term is not null")
    langs = uses.where("first").groupBy("lang").agg(F.count("*").alias("v"), F.sum("n_lang").alias("all_lang"))
    totals = uses.groupBy("lang", "source").agg(F.sum("n").alias("all"), F.count("*").alias("cells"))
    groups = cells.where("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0)
    groups = groups.withColumn("row", F.row_number().over(W.partitionBy("lang").orderBy("source")).cast("long") - 1)
    of_lang = W.partitionBy("lang")
    tile_cells = F.greatest(F.lit(cells_each), F.count("*").over(of_lang) * tile_terms)
    groups = durable(groups.withColumn("tiles", F.greatest(F.ceil(F.sum("cells").over(of_lang) / tile_cells), F.lit(1)).cast("long")))
    groups = groups.withColumn("zero", price(F.lit(0), F.col("all"), F.col("v"))).withColumn("own", F.floor(F.col("row") / block).cast("long"))
    priced = uses.join(groups, ["lang", "source"]).withColumn("p", price(F.col("n"), F.col("all"), F.col("v"))).withColumn("tile", F.pmod(F.xxhash64("term"), F.col("tiles")))
    priced = durable(priced.select("lang", "source", "row", "own", "tile", "term", "p", price(F.col("n_lang"), F.col("all_lang"), F.col("v")).alias("q")))

    over = priced.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    best = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    over = over.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most_terms)

    pairs = block_sums(priced, groups).groupBy("lang", "a", "b").agg(F.sum("part").alias("part"))
    one = groups.select("lang", F.col("source").alias("s1"), F.col("row").alias("a"), F.col("zero").alias("z1"), "v")
    two = groups.select("lang", F.col("source").alias("s2"), F.col("row").alias("b"), F.col("zero").alias("z2"))
    every = one.join(two, "lang").where("a < b").join(pairs, ["lang", "a", "b"], "left")
    value = F.coalesce(F.abs(F.col("z1") - F.col("z2")) * F.col("v"), F.lit(0)) + F.coalesce("part", F.lit(0))
    every = every.select("lang", F.explode(F.array(F.struct(F.col("s1").alias("source"), F.col("s2").alias("item")), F.struct(F.col("s2").alias("source"), F.col("s1").alias("item")))).alias("x"), value.cast("long").alias("value"))
    every = every.select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    return every.withColumn("rank", F.row_number().over(best)).unionByName(over)


def block_sums(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, part) of every tile of terms and every two blocks of rows of which one has cells in it."""
    quadrants = cells.select("lang", "tile", "own").distinct()
    blocks = groups.groupBy("lang").agg(F.max("own").alias("last"))
    # a pair of blocks is met where either has cells: one row's cells are priced against all rows of the other block
    met = quadrants.join(blocks, "lang").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))))
    met = durable(met.select("lang", "tile", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).distinct())
    ends = met.select("lang", "tile", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("own"))
    left = cells.join(ends, ["lang", "tile", "own"]).select("lang", "tile", "i", "j", "row", "term", "p")
    right = ends.join(groups.select("lang", "own", "row", "zero"), ["lang", "own"])
    right = right.select(*[F.col(c).alias(c) for c in ("lang", "tile", "i", "j", "row", "own", "zero")])  # columns of their own, apart from the cells'

    def one(key: tuple, cells: pa.Table, sources: pa.Table) -> pa.Table:
        out = pair_sums(cells, sources)
        return out.append_column("lang", pa.array([key[0].as_py()] * len(out), pa.string()))

    by = ["lang", "tile", "i", "j"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(one, "a long, b long, part long, lang string")
