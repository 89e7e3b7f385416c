"""Best-two-fit packing of token sequences.

Texts become token ids with an end id; what is longer than a sequence is cut into full pieces and a rest. Packing needs
the lengths alone, and there are no more different lengths than a sequence has places. So the counts per length (a table
of that bounded size) are packed at the driver: a sequence is filled greedily with the longest piece that still fits, then
its shortest piece is exchanged for two unpacked ones that fill the gap it leaves more tightly. The same filling repeats as
long as its lengths last, so the plan is a short list of (filling, how often). Every piece then finds its place by its rank
among the pieces of its length, in parallel, without a shuffle of ids.

Defined results: a null or empty text is the end id alone; repeated rows are packed each; null ids are kept; an empty table
gives no rows. Only ``doc_id`` and ``text`` are read, so further columns can't clash.
"""

from __future__ import annotations

import gc
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorebase.llm.common import slices
from lorebase.llm.tokens import encoder as encoder_of
from lorebase.session import persist_table

SIZE = 2048


def token_pieces(docs: DataFrame, vocabulary: str, size: int = SIZE, end: int = 0, spaced: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids, ids_crc32, part, nth``: ids are little-endian unsigned 32-bit integers.

    ``nth`` numbers the pieces of one length within the task ``part`` that made them.
    """
    tail = np.array([end], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # nothing here makes reference cycles, and the remembered words are many
        encoder, seen, part = encoder_of(vocabulary, spaced), np.zeros(size + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            for few in slices(batch):
                ids, piece, start, length, pieces, crc, nth = [], [], [], [], [], [], []
                for doc_id, data in zip(few.column("doc_id").to_pylist(), encoder.encode(few.column("text").to_pylist()), strict=True):
                    data += tail
                    for n, at in enumerate(range(0, len(data), 4 * size)):
                        own = data[at:at + 4 * size]
                        k = len(own) // 4
                        ids.append(doc_id)
                        piece.append(n)
                        start.append(at // 4)
                        length.append(k)
                        pieces.append(own)
                        crc.append(zlib.crc32(own))
                        nth.append(int(seen[k]))
                        seen[k] += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, few.schema.field("doc_id").type), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(length, pa.int64()), pa.array(pieces, pa.binary()), pa.array(crc, pa.int64()),
                     pa.array([part] * len(ids), pa.int32()), pa.array(nth, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids", "ids_crc32", "part", "nth"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        cut, f"doc_id {kind}, piece int, start long, length long, ids binary, ids_crc32 long, part int, nth long")


def best_two_fit(counts: dict[int, int], size: int = SIZE) -> list[tuple[dict[int, int], int]]:
    """Fillings ``{length: how many}`` and how many sequences get each, for so many pieces of each length."""
    left = np.zeros(size + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    plan = []
    while left.any():
        filling: dict[int, int] = {}
        gap, open_lengths = size, np.flatnonzero(left)
        while gap and len(open_lengths) and open_lengths[0] <= gap:
            longest = int(open_lengths[np.searchsorted(open_lengths, gap, "right") - 1])
            n = min(gap // longest, int(left[longest]))
            filling[longest] = n
            gap -= n * longest
            open_lengths = open_lengths[:np.searchsorted(open_lengths, longest)]
        if gap:
            _exchange_shortest(filling, gap, left)
        times = min(int(left[length]) // n for length, n in filling.items())
        for length, n in filling.items():
            left[length] -= n * times
        plan.append((filling, times))
    return plan


def _exchange_shortest(filling: dict[int, int], gap: int, left: np.ndarray) -> None:
    """Takes two unpacked pieces in place of the shortest one if they leave a smaller gap."""
    shortest = min(filling)
    room, spare = gap + shortest, left.copy()
    for length, n in filling.items():
        spare[length] -= n
    free = np.flatnonzero(spare[:room + 1])
    if not len(free):
        return
    at = np.searchsorted(free, room - free, "right") - 1
    partner = np.where(at >= 0, free[np.maximum(at, 0)], 0)
    alone = (partner == free) & (spare[free] < 2)  # the only piece of its length can't be its own partner
    partner = np.where(alone, np.where(at >= 1, free[np.maximum(at - 1, 0)], 0), partner)
    both = np.where(partner > 0, free + partner, 0)
    best = int(np.argmax(both))
    if both[best] <= shortest:
        return
    filling[shortest] -= 1
    if not filling[shortest]:
        del filling[shortest]
    for length in (int(free[best]), int(partner[best])):
        filling[length] = filling.get(length, 0) + 1


def pack(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """Adds ``sequence_id, offset`` to written ``pieces`` (see token_pieces); all other columns stay as they are.

    Rows are joined with a small table of ranks, so leave out ``ids`` where only places are wanted.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # size rows at most
    slots, used, sequence = [], dict.fromkeys(counts, 0), 0
    for filling, times in best_two_fit(counts, size):
        offset = 0
        for length in sorted(filling, reverse=True):
            slots.append((length, used[length], sequence, offset, filling[length]))
            used[length] += filling[length] * times
            offset += filling[length] * length
        sequence += times
    slots.sort()
    length_, rank_, first_, offset_, each_ = (np.array(c, np.int64) for c in zip(*slots, strict=True)) if slots else [np.zeros(0, np.int64)] * 5
    keys = (length_ << 44) + rank_

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            slot = np.searchsorted(keys, (length << 44) + rank, "right") - 1
            nth = rank - rank_[slot]
            names = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(first_[slot] + nth // each_[slot]),
                 pa.array(offset_[slot] + nth % each_[slot] * length)], names=[*names, "sequence_id", "offset"])

    by_part = pieces.groupBy("length", "part").agg((F.max("nth") + 1).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    by_part = by_part.select("length", "part", F.coalesce(before, F.lit(0)).alias("_before"))
    ranked = pieces.join(by_part, ["length", "part"]).select(
        *[pieces[c] for c in pieces.columns if c not in ("part", "nth")], (F.col("_before") + F.col("nth")).alias("rank"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids, documents``: the packed ids (at most a sequence's worth a row) and where each document lies."""
    inner = F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id", "start", "length")))
    return packed.groupBy("sequence_id").agg(inner.alias("_p")).select(
        "sequence_id", F.expr("aggregate(_p, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"),
        F.expr("transform(_p, x -> named_struct('doc_id', x.doc_id, 'start', x.start, 'offset', x.offset, 'length', x.length))").alias("documents"))


def pack_documents(docs: DataFrame, vocabulary: str, size: int = SIZE, end: int = 0, spaced: bool = False) -> DataFrame:
    """Tokenise, write the pieces to the shared folder and place them."""
    pieces = persist_table(token_pieces(docs, vocabulary, size, end, spaced), "pieces")
    return pack(pieces, size)
