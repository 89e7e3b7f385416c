"""Token ids in files compressed by Re-Pair grammars.

Each shard of about a million ids gets rules: rounds count neighbouring pairs, turn the most frequent ones into
nonterminals and replace them, until no pair is frequent enough or a round gains next to nothing. A shard stores its rules, the length each nonterminal
expands to, the compressed ids and where each document starts in them, so a document is decoded by reading its own slice.
Documents are encoded and written in ascending id; a shard never holds more than its bound (a longer document is a shard
of its own), and no pair spans two documents.

Defined results: a null or empty text is the end id alone; null ids come first; rows of one id stay together, ordered by
text; an empty table gives no rows. Only ``doc_id`` and ``text`` are read, so further columns can't clash.
"""

from __future__ import annotations

import gc
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorebase.llm.common import slices
from lorebase.llm.tokens import encoder as encoder_of

SHARD_IDS = 1 << 20
ROUNDS = 5
RULES_A_ROUND = 1024
LEAST_COUNT = 64
LEAST_GAIN = 0.02
_BINS = 1 << 18
_TURNS = 16
SHARD = ("part int, shard int, start_in_part long, n_ids long, least_doc long, most_doc long, first_rule int, rules binary, lengths binary, ids binary, doc_ids binary, "
         "doc_null binary, doc_places binary, doc_sizes binary")


def _frequent(pairs: np.ndarray, bins: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs that occur ``least`` times or more, how often, and for each occurrence which of them it is, -1 for none.

    Without sorting: a bin names one of its pairs, all occurrences of that one leave, and bins with too few left are done.
    """
    where, left = np.full(len(pairs), -1), np.arange(len(pairs))
    found, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    named, total, turn = np.zeros(int(bins.max()) + 1 if len(bins) else 0, np.int64), 0, 0
    while len(left):
        own, bin_ = pairs[left], bins[left]
        if turn < _TURNS:
            named[bin_] = own
            hit, group, names = named[bin_] == own, bin_, named
        else:  # bins of very many pairs
            names, group = np.unique(own, return_inverse=True)
            hit = np.ones(len(left), bool)
        n = np.bincount(group[hit], minlength=len(names))
        often = n >= least
        place = np.where(often, total + np.cumsum(often) - 1, -1)
        where[left[hit]] = place[group[hit]]
        found.append(names[often])
        counts.append(n[often])
        total, turn = total + int(often.sum()), turn + 1
        left, bin_ = left[~hit], bin_[~hit]
        left = left[(np.bincount(bin_, minlength=len(named)) >= least)[bin_]]
    return np.concatenate(found), np.concatenate(counts), where


def compress(ids: np.ndarray, borders: np.ndarray, first_rule: int, rounds: int = ROUNDS, a_round: int = RULES_A_ROUND,
             least: int = LEAST_COUNT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``ids, borders, rules, lengths``: the compressed ids, where each document starts in them, the pairs, what they expand to.

    ``borders`` are the starts of the documents and the end. In a run of overlapping pairs every other one is replaced.
    """
    ids, borders = ids.astype(np.int64), borders.copy()
    rules, lengths = np.zeros((0, 2), np.int64), np.zeros(0, np.int64)
    for _ in range(rounds):
        if len(ids) < 2:
            break
        pairs = (ids[:-1] << 32) | ids[1:]
        inner = np.ones(len(pairs), bool)
        inner[borders[1:-1] - 1] = False
        bins = ((ids[:-1] * 40503 + ids[1:] * 30011) & (_BINS - 1))
        heavy = np.bincount(bins[inner], minlength=_BINS) >= least
        at = np.flatnonzero(heavy[bins] & inner)
        found, counts, where = _frequent(pairs[at], (np.cumsum(heavy) - 1).astype(np.int32)[bins[at]], least)
        if not len(found):
            break
        often = np.lexsort((found, -counts))[:a_round]
        number = np.full(len(found) + 1, -1, np.int64)  # the last stands for all that are seldom
        number[often] = first_rule + len(rules) + np.arange(len(often))
        symbol = number[where]
        at, symbol = at[symbol >= 0], symbol[symbol >= 0]
        opens = np.flatnonzero(np.diff(at, prepend=-2) != 1)  # runs of overlapping pairs
        even = (np.arange(len(at)) - np.repeat(opens, np.diff(opens, append=len(at)))) % 2 == 0
        at, symbol = at[even], symbol[even]
        new = np.stack([found[often] >> 32, found[often] & 0xFFFFFFFF], 1)
        size = np.where(new >= first_rule, np.append(lengths, 0)[np.clip(new - first_rule, 0, len(lengths))], 1).sum(1)
        rules, lengths = np.concatenate([rules, new]), np.concatenate([lengths, size])
        ids[at] = symbol
        keep = np.ones(len(ids), bool)
        keep[at + 1] = False
        borders = np.concatenate([[0], np.cumsum(keep)])[borders]
        ids, before = ids[keep], len(ids)
        if before - len(ids) < LEAST_GAIN * before:
            break
    return ids, borders, rules, lengths


class Grammar:
    """Expands slices of a shard's compressed ids."""

    def __init__(self, rules: np.ndarray, lengths: np.ndarray, first_rule: int):
        self.sizes = np.concatenate([np.ones(first_rule, np.int64), lengths])
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.pool = np.zeros(self.starts[-1], np.uint32)
        self.pool[:first_rule] = np.arange(first_rule)
        for i, (a, b) in enumerate(rules.tolist()):
            at, size = int(self.starts[first_rule + i]), int(self.sizes[a])
            self.pool[at:at + size] = self.pool[self.starts[a]:self.starts[a] + size]
            self.pool[at + size:at + size + self.sizes[b]] = self.pool[self.starts[b]:self.starts[b] + self.sizes[b]]

    def expand(self, ids: np.ndarray) -> np.ndarray:
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        return self.pool[np.repeat(self.starts[ids] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


def encode_shards(docs: DataFrame, vocabulary: str, first_rule: int, end: int = 0, spaced: bool = True,
                  shard_ids: int = SHARD_IDS) -> DataFrame:
    """Shard rows (see SHARD) of the documents in ascending id; the tasks' numbers follow that order."""
    tail = np.array([end], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # nothing here makes reference cycles, and the remembered words are many
        encoder, part = encoder_of(vocabulary, spaced), TaskContext.get().partitionId()
        shard = passed = held = 0
        ids: list[int | None] = []
        data: list[bytes] = []

        def shard_row() -> pa.RecordBatch:
            borders = np.cumsum([0, *(len(d) // 4 for d in data)])
            short, places, rules, lengths = compress(np.frombuffer(b"".join(data), "<u4"), borders, first_rule)
            real = [i for i in ids if i is not None]
            values = [part, shard, passed, int(borders[-1]), min(real, default=None), max(real, default=None), first_rule, rules.astype("<u4").tobytes(), lengths.astype("<u4").tobytes(),
                      short.astype("<u4").tobytes(), np.array([i or 0 for i in ids], "<i8").tobytes(),
                      np.array([i is None for i in ids], "<u1").tobytes(), places.astype("<u4").tobytes(), np.diff(borders).astype("<u4").tobytes()]
            kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 4, pa.int32(), *[pa.binary()] * 7]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)],
                                              names=[c.split()[0] for c in SHARD.split(", ")])

        for batch in batches:
            for few in slices(batch):
                for doc_id, own in zip(few.column("doc_id").to_pylist(), encoder.encode(few.column("text").to_pylist()), strict=True):
                    if data and held + len(own) // 4 + 1 > shard_ids:
                        yield shard_row()
                        shard, passed, held, ids, data = shard + 1, passed + held, 0, [], []
                    ids.append(doc_id)
                    data.append(own + tail)
                    held += len(own) // 4 + 1
        if data:
            yield shard_row()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(encode, SHARD)


def decode_shards(shards: DataFrame, keep_ids: bool = True, only: int | None = None) -> DataFrame:
    """``doc_id, part, at, n_tokens, ids, ids_crc32`` of the documents in the shards, ``at`` counted within the part.

    ``keep_ids=False`` leaves the ids out. ``only`` decodes the slice of one document and nothing else.
    """
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                read = {k: np.frombuffer(v, "<i8" if k == "doc_ids" else "<u1" if k == "doc_null" else "<u4") for k, v in row.items() if isinstance(v, bytes)}
                sizes = read["doc_sizes"].astype(np.int64)
                ends = np.cumsum(sizes)
                docs = np.arange(len(sizes)) if only is None else np.flatnonzero((read["doc_ids"] == only) & (read["doc_null"] == 0))
                grammar = Grammar(read["rules"].reshape(-1, 2), read["lengths"].astype(np.int64), row["first_rule"])
                if only is None:
                    out = grammar.expand(read["ids"]).astype("<u4").tobytes()
                    own = [out[4 * a:4 * b] for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
                else:
                    own = [grammar.expand(read["ids"][read["doc_places"][i]:read["doc_places"][i + 1]]).astype("<u4").tobytes() for i in docs]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(read["doc_ids"][docs], pa.int64(), mask=read["doc_null"][docs].astype(bool)), pa.array([row["part"]] * len(own), pa.int32()),
                     pa.array(row["start_in_part"] + (ends - sizes)[docs]), pa.array(sizes[docs]),
                     *([pa.array(own, pa.binary())] if keep_ids else []), pa.array([zlib.crc32(d) for d in own], pa.int64())],
                    names=["doc_id", "part", "at", "n_tokens", *(["ids"] if keep_ids else []), "ids_crc32"])

    if only is not None:
        shards = shards.where(F.lit(only).between(F.col("least_doc"), F.col("most_doc")))
    return shards.mapInArrow(decode, "doc_id long, part int, at long, n_tokens long," + " ids binary," * keep_ids + " ids_crc32 long")


def document_starts(shards: DataFrame, decoded: DataFrame) -> DataFrame:
    """``decoded`` with ``start``: the ids of all documents before. One row per writing task crosses the window."""
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("part", F.coalesce(before, F.lit(0)).alias("_before"))
    return decoded.join(parts, "part").select(*[decoded[c] for c in decoded.columns if c not in ("part", "at")],
                                              (F.col("_before") + F.col("at")).alias("start"))


def write_shards(shards: DataFrame, path: str) -> None:
    shards.write.mode("error").option("compression", "zstd").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_document(spark: SparkSession, path: str, doc_id: int) -> DataFrame:
    """The ids of one document, from the one slice of the one shard that holds it."""
    return decode_shards(read_shards(spark, path), only=doc_id).select("doc_id", "ids")
