"""Best-fit packing of tokenised documents into sequences, certified by lower bounds.

Documents are tokenised once; only piece lengths are packed. Each partition packs its
pieces best-fit decreasing and bounds its bins from below with dual feasible functions.
Partitions whose count meets the bound are done. The others give the documents of bins
that aren't full to one another, in groups dealt anew, and pack those again, as long as
that saves bins.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketspark.llm.common import durable, parts_for, small_batches

CAPACITY, END_ID = 1024, 2
SPECIAL = "<|endoftext|>"


def default_tokenizer() -> tuple[str, str]:
    """The paths of one vocabulary for `tokenizers` and, as ranks, for `tiktoken`."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(2)
def _encoders(paths: tuple[str, str]):
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(paths[1], "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return Tokenizer.from_file(paths[0]), tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(text: str, paths: tuple[str, str]) -> list[int]:
    """The ids that `tokenizers` gives without added special tokens.

    The ranks give the same ids four times as fast; a text with the special token's
    string, which only `tokenizers` knows, goes to it.
    """
    slow, fast = _encoders(paths)
    return slow.encode(text, add_special_tokens=False).ids if SPECIAL in text else fast.encode_ordinary(text)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, uid long, ids array<int>"


def pieces(docs: DataFrame, capacity: int = CAPACITY, paths: tuple[str, str] | None = None, keep_ids: bool = False) -> DataFrame:
    """Each document's ids, ended by id 2, cut into pieces; only the first may be shorter than `capacity`.

    A null text is empty: one piece, the end id alone. `uid` tells pieces of equal rows
    apart; it depends on the partition, so keep the result before using it twice.
    """
    paths = paths or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 36
        for batch in batches:
            out = []
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.array([*encode(text or "", paths), END_ID], "<u4")
                first = len(ids) % capacity or capacity
                for n, stop in enumerate(range(first, len(ids) + 1, capacity)):
                    start = 0 if n == 0 else stop - capacity
                    part = ids[start:stop]
                    out.append((doc_id, n, start, len(part), zlib.crc32(part.tobytes()), uid, part.tolist() if keep_ids else None))
                    uid += 1
            columns = zip(*out, strict=True) if out else [[]] * 7
            types = [pa.int64(), pa.int32(), *[pa.int64()] * 4, pa.list_(pa.int32())]
            names = [x.split()[0] for x in PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """A number of bins that no packing can go below: the best of two families of dual feasible functions.

    For each threshold e: pieces over capacity - e count as whole bins, those below e as
    nothing, others as they are (e = 0 is the plain sum). For each k: the rounding
    function floor((k + 1) x) / k, or x where (k + 1) x is whole.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(object)
    size = np.arange(capacity + 1).astype(object)
    few, mass = np.cumsum(count), np.cumsum(count * size)
    best = 0
    for e in range(capacity // 2 + 1):
        whole = few[-1] - few[capacity - e]
        middle = mass[capacity - e] - (mass[e - 1] if e else 0)
        best = max(best, whole + -(-middle // capacity))
    for k in range(1, 33):
        parts = (k + 1) * size
        value = np.where(parts % capacity == 0, size * k, capacity * (parts // capacity))
        best = max(best, -(-(count * value).sum() // (k * capacity)))
    return int(best)


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: each piece's bin and place, and each bin's free space.

    Bins are kept by their free space; bit i of a mask says whether some bin has i free.
    """
    bins, places, free = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for i in np.argsort(-lengths, kind="stable"):
        size = int(lengths[i])
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = by_free[room].pop()
            if not by_free[room]:
                mask ^= 1 << room
        else:
            room, b = capacity, len(free)
            free.append(capacity)
        bins[i], places[i], left = b, capacity - room, room - size
        free[b] = left
        by_free[left].append(b)
        mask |= 1 << left
    return bins, places, np.array(free, np.int64)


def _round(items: DataFrame, nth: int, groups: int, capacity: int) -> DataFrame:
    """Packs (uid, length) in `groups` groups: uid, length, sequence_id, offset, done."""

    def run(part: pa.Table) -> pa.Table:
        lengths, uids = part.column("length").to_numpy(), part.column("uid").to_numpy()
        order = np.lexsort((-uids, -lengths))  # the same packing, however rows came
        lengths, uids = lengths[order], uids[order]
        bins, places, free = best_fit(lengths, capacity)
        certified = len(free) <= bound(lengths, capacity)
        ids = (np.int64(nth) << 56) | (np.int64(part.column("lot")[0].as_py()) << 28) | bins
        return pa.table({"uid": uids, "length": lengths, "sequence_id": ids, "offset": places, "done": certified | (free[bins] == 0)})

    lot = F.pmod(F.xxhash64(F.lit(nth), "uid"), F.lit(groups)).cast("long")
    return items.select("uid", "length", lot.alias("lot")).groupBy("lot").applyInArrow(run, "uid long, length long, sequence_id long, offset long, done boolean")


def pack(
    docs: DataFrame, capacity: int = CAPACITY, paths: tuple[str, str] | None = None, rows_each: int = 50_000, idle: int = 2, keep_ids: bool = False
) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if kept).

    Pieces of `capacity` ids are sequences of their own. The others are packed in groups
    of about `rows_each`; rounds go on until every group's count is certified by its bound, or
    `idle` rounds in a row, each with groups dealt anew, have saved nothing (sequence ids have room for 60). Equal rows are documents of their
    own; an empty table gives an empty table.
    """
    small_batches(docs.sparkSession)
    cut = durable(pieces(docs, capacity, paths, keep_ids))
    items = cut.where(F.col("length") < capacity).select("uid", "length")
    now = durable(_round(items, 1, parts_for(items.count(), rows_each), capacity))
    kept, opened = [now.where("done")], now.where("not done")
    vain = 0
    for nth in range(2, 62):
        state = opened.agg(F.count("*").alias("n"), F.count(F.when(F.col("offset") == 0, 1)).alias("bins")).first()
        if not state["n"]:
            break
        again = durable(_round(opened, nth, parts_for(state["n"], rows_each), capacity))
        if again.where("offset = 0").count() >= state["bins"]:
            vain += 1
            if vain == idle or parts_for(state["n"], rows_each) == 1:  # one group packed alike again
                break
            continue
        vain = 0
        kept.append(again.where("done"))
        opened = again.where("not done")
    placed = opened
    for part in kept:
        placed = placed.unionByName(part)
    out = cut.join(placed.select("uid", "sequence_id", "offset"), "uid", "left")
    alone = F.lit(1 << 62).bitwiseOR(F.col("uid"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("sequence_id", alone).alias("sequence_id"), F.coalesce("offset", F.lit(0)).cast("long").alias("offset")]
    return out.select(*columns, *["ids"] * keep_ids)


def sequences(docs: DataFrame, **options) -> DataFrame:
    """The packed sequences: sequence_id, ids (at most `capacity` of them), doc_ids in order."""
    held = pack(docs, keep_ids=True, **options)
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id")))
    return held.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.doc_id").alias("doc_ids"))
