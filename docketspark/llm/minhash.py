"""Document fingerprints: MinHash over word shingles, signature bands joined in Spark.

A signature keeps, for each of `permutations` universal hash functions, the least value
over a text's shingles, 32 bits each. Tasks compute signatures of whole batches with
numpy; Spark shuffles documents, bands and candidate pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docketspark.llm import jaccard, wordhash
from docketspark.llm.common import durable, partitions, parts_for, small_batches
from docketspark.llm.components import connected

WIDTH, PERMUTATIONS, BANDS, THRESHOLD = 5, 128, 25, 0.8
EMPTY = np.uint32(0xFFFFFFFF)
#: Rows of a lot, whose texts one task holds at a time.
LOT_ROWS = 4000


@lru_cache
def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(5)
    return rng.integers(0, 1 << 32, n, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, np.uint32)


def signatures(texts: list[bytes], permutations: int = PERMUTATIONS, width: int = WIDTH) -> np.ndarray:
    """One row of `permutations` values per text; a text without words has EMPTY everywhere.

    Shingles are `width` words, A-Z lower-cased; a shorter text is one shingle.
    """
    out = np.full((len(texts), permutations), EMPTY, np.uint32)
    a, b = _coefficients(permutations)
    for begin, end in wordhash.chunks(texts):
        hashed, offsets = wordhash.shingles(*wordhash.words(texts[begin:end]), width)
        full = np.flatnonzero(np.diff(offsets))
        if not len(full):
            continue
        x, at = (hashed >> np.uint64(32)).astype(np.uint32), offsets[full]
        held = np.empty_like(x)
        for k in range(permutations):
            np.multiply(x, a[k], out=held)
            np.add(held, b[k], out=held)
            out[begin + full, k] = np.minimum.reduceat(held, at)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Part of the positions at which two signatures agree: the estimated Jaccard similarity."""
    return float(np.mean(a == b))


def digest(signature: np.ndarray) -> str:
    """A signature as text, 16 bits of each value in hexadecimal."""
    return signature.astype(">u2").tobytes().hex()


def edited(text: str, following: str) -> str:
    """`text` with its last half replaced by as many code points (or all) of `following`."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


FINGERPRINT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, class_id long"


FRAMES = "lot int, ids array<long>, ties array<long>, own array<boolean>, lengths array<long>, body binary"
#: Sub-lots of the rows without doc_id, by their hash.
NULL_LOTS = 1024


def _in_lots(docs: DataFrame, lots: int, classes: DataFrame | None = None) -> DataFrame:
    """Documents in lots of descending doc_id, as frames (see FRAMES): a task's rows of one lot, their texts compressed.

    Besides its own rows a lot has the first row of the next lot (of the first lot after the
    last one), which isn't its own. Lots are ranges of doc_id between quantiles; null ids
    come last, dealt by a hash of the text, which also orders equal ids. Rows of
    `classes` (doc_id, class_id) come in the lot of their doc_id as frames without a body: ids and, in `ties`, classes.
    """
    d = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    cuts = sorted({int(x) for x in d.approxQuantile("doc_id", [i / lots for i in range(1, lots)], 0.2 / lots)}, reverse=True) if lots > 1 else []
    bounds = F.array(*[F.lit(-x) for x in cuts]).cast("array<long>")
    last = NULL_LOTS // 2 - 1 - F.shiftright(F.xxhash64("text"), 64 - NULL_LOTS.bit_length() + 1)  # falls as the hash rises
    lot_of = lambda null: F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1) + null).otherwise(_bisect(bounds, -F.col("doc_id"), len(cuts))).cast("int")
    d = d.withColumn("lot", lot_of(last)).withColumn("tie", F.xxhash64("text"))
    firsts = d.groupBy("lot").agg(F.max(F.struct("doc_id", "tie")).alias("first"))
    after = F.coalesce(F.lead("lot").over(W.orderBy("lot")), F.lit(None))
    order = firsts.select("lot", after.alias("after"), F.min("lot").over(W.partitionBy()).alias("least"))
    before = order.select(F.col("lot").alias("to"), F.coalesce("after", "least").alias("from_lot"))
    heads = firsts.join(before, F.col("lot") == F.col("from_lot")).select("to", "first", F.col("lot").alias("head_lot"))
    heads = F.broadcast(durable(heads))  # one row per lot
    copies = (
        d.join(heads, (F.col("lot") == F.col("head_lot")) & F.struct("doc_id", "tie").eqNullSafe(F.col("first")))
        .select(F.col("to").alias("lot"), F.lit(False).alias("own"), "doc_id", "tie", "text").dropDuplicates(["lot"])
    )
    placed = d.select("lot", F.lit(True).alias("own"), "doc_id", "tie", "text").unionByName(copies)
    framed = placed.mapInArrow(_frames, FRAMES)
    if classes is None:
        return framed
    nothing = (F.lit(None).cast("array<boolean>").alias("own"), F.lit(None).cast("array<long>").alias("lengths"), F.lit(None).cast("binary").alias("body"))
    return framed.unionByName(classes.where("doc_id is not null").select(lot_of(F.lit(0)).alias("lot"), F.array("doc_id").alias("ids"), F.array("class_id").alias("ties"), *nothing))


def _frames(batches: Iterator[pa.RecordBatch], most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Rows (lot, own, doc_id, tie, text) as frames. A task holds about `most` bytes of texts."""
    codec = pa.Codec("zstd", compression_level=6)
    held: dict[int, list[tuple]] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for lot, rows in sorted(held.items()):
            own, ids, ties, texts = zip(*rows, strict=True)
            body = codec.compress(b"".join(texts), asbytes=True)
            lists = [pa.array([list(x)], pa.list_(t)) for x, t in ((ids, pa.int64()), (ties, pa.int64()), (own, pa.bool_()), (map(len, texts), pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array([lot], pa.int32()), *lists, pa.array([body], pa.binary())], ["lot", "ids", "ties", "own", "lengths", "body"])
        held.clear()

    for batch in batches:
        for lot, own, doc_id, tie, text in zip(*(c.to_pylist() for c in batch.columns[:4]), batch.column(4).cast(pa.binary()).to_pylist(), strict=True):
            held.setdefault(lot, []).append((own, doc_id, tie, text))
            size += len(text)
            if size >= most:
                yield from flush()
                size = 0
    yield from flush()


def _bisect(bounds: Column, x: Column, n: int) -> Column:
    """How many of the n rising `bounds` are at most x."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(n.bit_length()))]).cast("array<int>")
    return F.aggregate(
        steps, F.lit(0), lambda at, step: F.when((at + step <= n) & (F.get(bounds, at + step - 1) <= x), at + step).otherwise(at)
    )


def fingerprint(docs: DataFrame, lots: int | None = None, classes: DataFrame | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, their likeness, and the class of near copies.

    class_id is that of `classes` (see classes_of), and the doc_id of a document that has none there.

    A null text counts as empty; two texts without words are alike (1), one without and
    one with words are not (0). The next document goes by descending doc_id, null ids
    last, equal ids by a hash of the text; after the last comes the first, so a single
    document is its own next. Repeated rows each give a row. Texts are shuffled once, by
    range of doc_id and compressed; a task holds the texts of one lot, of which there are
    as many as the rows ask for (LOT_ROWS each), four to a partition at least.
    """
    small_batches(docs.sparkSession)
    lots = lots or max(4 * partitions(docs.sparkSession), parts_for(docs.count(), LOT_ROWS))
    framed = _in_lots(docs, lots, classes).repartition(partitions(docs.sparkSession), "lot").sortWithinPartitions("lot")

    def of_lot(rows: list[tuple[bool, int | None, int, str]], marked: dict[int, int]) -> Iterator[pa.RecordBatch]:
        rows.sort(key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2]), reverse=True)
        waits = None  # the row before: doc_id, text, signature
        for begin, end in wordhash.chunks([r[3] for r in rows], 1 << 20):
            part = rows[begin:end]
            pairs = []  # doc_id, text, its edited text, signature, the next one's
            for (own, doc_id, _, text), signature in zip(part, signatures([r[3].encode() for r in part]), strict=True):
                if waits is not None:
                    pairs.append((waits[0], waits[1], edited(waits[1], text), waits[2], signature))
                waits = (doc_id, text, signature) if own else None
            if not pairs:
                continue
            changed = signatures([p[2].encode() for p in pairs])
            columns = zip(*[
                (doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), digest(s), digest(e), likeness(s, e), likeness(s, t), marked.get(doc_id, doc_id))
                for (doc_id, text, new, s, t), e in zip(pairs, changed, strict=True)
            ], strict=True)
            types = [pa.int64()] * 2 + [pa.string()] * 3 + [pa.float64()] * 2 + [pa.int64()]
            names = [x.split()[0] for x in FINGERPRINT.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        now, rows, marked = None, [], {}
        for batch in batches:
            for lot, ids, ties, own, lengths, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if lot != now:
                    yield from of_lot(rows, marked)
                    now, rows, marked = lot, [], {}
                if body is None:
                    marked |= zip(ids, ties, strict=True)
                    continue
                texts, at = codec.decompress(body, sum(lengths), asbytes=True) if sum(lengths) else b"", 0
                for mine, doc_id, tie, length in zip(own, ids, ties, lengths, strict=True):
                    rows.append((mine, doc_id, tie, texts[at : at + length].decode()))
                    at += length
        yield from of_lot(rows, marked)

    return framed.mapInArrow(run, FINGERPRINT)


def signed(docs: DataFrame, permutations: int = PERMUTATIONS, width: int = WIDTH) -> DataFrame:
    """doc_id and signature (array of long) of every row; null for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()]
            found = signatures(texts, permutations, width)
            full = [bool(len(wordhash.words([x])[0])) for x in texts]
            rows = [list(map(int, s)) if ok else None for s, ok in zip(found, full, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int64()))], ["doc_id", "signature"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, signature array<long>")


def _banded(docs: DataFrame, bands: int, permutations: int, width: int) -> DataFrame:
    """Per row with words: doc_id, key (128 bits of a digest of the text), n, pivots (a hash per band), sketch (see jaccard).

    A band has permutations // bands values, of the first permutations.
    """
    schema = "doc_id long, key binary, n long, pivots array<long>, sketch binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, all_texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
            for begin, end in wordhash.chunks(all_texts):
                texts = all_texts[begin:end]
                values, offsets = jaccard._sets(texts, width)
                n = np.diff(offsets)
                drawn = jaccard.sketches(values, offsets)
                signed = signatures(texts, permutations, width)[:, : permutations // bands * bands].reshape(len(n), bands, -1).astype(np.uint64)
                marks = np.arange(bands, dtype=np.uint64)[None, :].repeat(len(n), 0)
                for k in range(signed.shape[2]):
                    marks = wordhash.mix(marks * np.uint64(0x9E3779B97F4A7C15) + signed[:, :, k])
                full = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[begin + i] for i in full], pa.int64()),
                        pa.array([hashlib.sha256(texts[i]).digest()[:16] for i in full], pa.binary()),
                        pa.array(n[full], pa.int64()),
                        pa.array(list(marks[full].view(np.int64)), pa.list_(pa.int64())),
                        pa.array([drawn[i] for i in full], pa.binary()),
                    ],
                    [x.split()[0] for x in schema.split(", ")],
                )

    return docs.mapInArrow(run, schema)


def classes_of(
    docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, permutations: int = PERMUTATIONS, width: int = WIDTH, small: int = 24, most: int = 1_000_000
) -> DataFrame:
    """(doc_id, class_id) of the documents that have near copies: the least doc_id of their class.

    Equal texts fall together first. The others' signatures are cut into bands, and all
    pairs that share a band are candidates: bands are the regions of the exact Jaccard
    join, which tests them by windows and pivots, large bands in blocks. A pair counts if
    the exact Jaccard similarity of the word shingles is at least `threshold`; linked
    documents form classes. Rows with equal doc_id are one document with the links of all.
    """
    small_batches(docs.sparkSession)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("doc_id is not null")
    sets = durable(_banded(d, bands, permutations, width).groupBy("key").agg(F.min("doc_id").alias("id"), *(F.any_value(c).alias(c) for c in ("n", "pivots", "sketch"))))
    links = jaccard.links_of(d, sets, width, 100 * threshold, small, most)
    keyed = d.select(F.unhex(F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 32)).alias("key"), "doc_id")  # without words there is no set to join
    copies = keyed.join(sets.select("key", "id"), "key").where("doc_id <> id").select(F.col("id").alias("a"), F.col("doc_id").alias("b"))
    return connected(durable(links.unionByName(copies))).select(F.col("id").alias("doc_id"), F.col("component").alias("class_id"))


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One row per row: doc_id, class_id (the least doc_id of its near copies, see classes_of).

    A document without near copies, or without words, is alone (class_id is the doc_id);
    a row without doc_id has no class.
    """
    found = classes_of(docs, **options)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    return d.join(found, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
