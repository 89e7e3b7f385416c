"""Line dedup: which lines of which documents to keep, as one compressed bitmap per document in place of its text.

The lines of a document are folded to one row per distinct key (stripped, A-Z lower-cased), with a 128-bit hash and the
places of the line. These rows are range-partitioned by hash and then document, and sorted by hash, document and place, so
the holders of a key stream past in document order. A key held by ``min_docs`` documents or more loses its lines in all of
them, or in all but the first (``keep_first``). A key with very many holders is dealt over several ranges: each range also
reports its first and last key, and what it can't decide alone (fewer than ``min_docs`` holders at its border) waits
for the sum of these reports, of which there are two per range.

Memory: a task holds one batch and the holders of one key that is not yet frequent, fewer than ``min_docs`` documents.

Defined results: documents are told apart by id; rows of one id are one document, whatever their texts, and count once;
rows without an id are told apart by their text. A null or empty text is one empty line. Keys without a character are
never dropped. The first document is the one with the smallest id (no id sorts first), then the smallest text hash. Equal
rows share one bitmap. An empty table gives no rows. Only the id and the text are read, so further columns can't clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lorebase.llm.common import slices
from lorebase.session import persist_table

MIN_DOCS = 10
WHITE = b" \t\n\v\f\r"
#: rows whose fate is known, rows that wait for the neighbouring ranges, and reports of border keys
KNOWN, OPEN, BORDER = 0, 1, 2


def digest_of(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def line_keys(docs: DataFrame) -> DataFrame:
    """``doc_id, digest, who, h1, h2, nth, more`` per document and distinct key; ``more`` are the places after the first."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for few in slices(batch):
                owners, hashes, first, more = [], [], [], []
                for row, text in enumerate(few.column("text").cast(pa.binary()).to_pylist()):
                    places: dict[bytes, list[int]] = {}
                    for nth, line in enumerate((text or b"").split(b"\n")):
                        key = line.strip(WHITE).lower()
                        if key:
                            places.setdefault(key, []).append(nth)
                    for key, own in places.items():
                        owners.append(row)
                        hashes.append(xxhash.xxh3_128_digest(key))
                        first.append(own[0])
                        more.append(np.array(own[1:], "<i4").tobytes() if len(own) > 1 else None)
                of = pa.array(owners, pa.int32())
                pair = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [*(few.column(c).take(of) for c in ("doc_id", "digest", "who")), pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(first, pa.int32()), pa.array(more, pa.binary())],
                    names=["doc_id", "digest", "who", "h1", "h2", "nth", "more"])

    digest = digest_of(F.col("text"))
    who = F.when(F.col("doc_id").isNull(), digest).otherwise(F.xxhash64(F.col("doc_id").cast("string")))
    return docs.select("doc_id", "text", digest.alias("digest"), who.alias("who")).mapInArrow(
        run, f"doc_id {kind}, digest long, who long, h1 long, h2 long, nth int, more binary")


_OUT = "kind int, part int, h1 long, h2 long, holders long, doc_id {}, digest long, nth int, more binary, leads boolean"


def _stream(min_docs: int, keep_first: bool, id_type: pa.DataType):
    names = [c.split()[0] for c in _OUT.split(", ")]

    def rows(kind: int, part: int, batch: pa.RecordBatch, at: np.ndarray, leads: np.ndarray) -> pa.RecordBatch:
        few = batch.take(pa.array(at))
        n = len(at)
        values = [pa.array(np.full(n, kind, np.int32)), pa.array(np.full(n, part, np.int32)), few.column("h1"), few.column("h2"), pa.nulls(n, pa.int64()),
                  few.column("doc_id"), few.column("digest"), few.column("nth"), few.column("more"), pa.array(leads[at])]
        return pa.RecordBatch.from_arrays(values, names=names)

    def border(part: int, key: tuple[int, int], holders: int) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 3, id_type, pa.int64(), pa.int32(), pa.binary(), pa.bool_()]
        values = [BORDER, part, *key, holders, None, None, None, None, None]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: pa.RecordBatch | None = None  # the holders of the last key, while they are few
        busy: tuple | None = None  # the last key and holder, once the key is frequent
        head: tuple | None = None  # the first key of the range
        told = False
        last_key, holders = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            h1, h2, who, digest = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2", "who", "digest"))
            before = busy or (h1[0] ^ 1, 0, 0, 0)
            same = [np.concatenate([[x[0] == b], x[1:] == x[:-1]]) for x, b in zip((h1, h2, who, digest), before, strict=True)]
            goes_on = same[0] & same[1]
            repeated = goes_on & same[2] & same[3]
            leads, new_doc = ~goes_on, ~(goes_on & same[2])
            run_of = np.cumsum(leads)  # 0: the frequent key of the batch before goes on
            count = np.bincount(run_of, new_doc, run_of[-1] + 1).astype(np.int64)
            if busy:
                count[0] = min_docs
            frequent = count >= min_docs
            head = head or (int(h1[0]), int(h2[0]))
            in_head, in_last = (h1 == head[0]) & (h2 == head[1]), run_of == run_of[-1]
            lost = frequent[run_of] & ~repeated
            waits = ~frequent[run_of] & in_head & ~in_last & ~repeated
            if keep_first:
                waits |= lost & in_head & leads
                lost &= ~waits
            for kind, chosen in ((KNOWN, lost), (OPEN, waits)):
                at = np.flatnonzero(chosen)
                if len(at):
                    yield rows(kind, part, batch, at, leads)
            if not told and not in_head[-1]:
                own = np.flatnonzero(in_head)
                yield border(part, head, int(count[run_of[own[0]]]) if len(own) else min_docs)
                told = True
            last_key, holders = (int(h1[-1]), int(h2[-1])), int(count[-1])
            if frequent[-1]:
                held, busy = None, (h1[-1], h2[-1], who[-1], digest[-1])
            else:
                held, busy = batch.take(pa.array(np.flatnonzero(in_last & ~repeated))), None
        if last_key is not None:
            if held is not None:
                leads = np.arange(held.num_rows) == 0
                yield rows(OPEN, part, held, np.arange(held.num_rows), leads)
            yield border(part, last_key, holders)

    return run


def keep_bitmaps(docs: DataFrame, key: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS, keep_first: bool = False) -> DataFrame:
    """``doc_id, digest, n_lines, n_dropped, keep`` per id and text; ``keep`` is a zlib-packed bitmap, a set bit keeps the line."""
    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    lines = persist_table(line_keys(docs), "lines")  # read twice: for the range borders and for the sort
    orphan = F.when(F.col("doc_id").isNull(), F.col("digest")).otherwise(F.lit(0))
    ordered = lines.repartitionByRange("h1", "h2", "doc_id", orphan).sortWithinPartitions("h1", "h2", "doc_id", "digest")
    id_type = pa.schema(lines.select("doc_id").limit(0).toArrow().schema).field(0).type
    found = persist_table(ordered.mapInArrow(_stream(min_docs, keep_first, id_type), _OUT.format(kind)), "line-holders")
    totals = found.where(F.col("kind") == BORDER).groupBy("h1", "h2").agg(F.sum("holders").alias("total"), F.min("part").alias("opens"))
    open_rows = found.where(F.col("kind") == OPEN).drop("holders").join(totals, ["h1", "h2"]).where(F.col("total") >= min_docs)
    spared = F.col("leads") & (F.col("part") == F.col("opens")) if keep_first else F.lit(False)
    known = found.where(F.col("kind") == KNOWN).withColumn("spared", F.col("leads") & F.lit(keep_first))
    dropped = known.select("doc_id", "digest", "nth", "more", "spared").unionByName(
        open_rows.withColumn("spared", spared).select("doc_id", "digest", "nth", "more", "spared"))
    n_lines = F.coalesce(F.regexp_count(F.col("text"), F.lit("\n")), F.lit(0)) + 1
    every = docs.select("doc_id", digest_of(F.col("text")).alias("digest"), n_lines.cast("int").alias("n_lines"))
    places = F.struct("nth", "more", "spared")
    both = every.withColumn("places", F.lit(None).cast("struct<nth:int,more:binary,spared:boolean>")).unionByName(
        dropped.select("doc_id", "digest", F.lit(None).cast("int").alias("n_lines"), places.alias("places")))
    per_doc = both.groupBy("doc_id", "digest").agg(F.max("n_lines").alias("n_lines"), F.collect_list("places").alias("places"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone, bitmaps = [], []
            for n, own in zip(batch.column("n_lines").to_pylist(), batch.column("places").to_pylist(), strict=True):
                keep = np.ones(n, bool)
                for p in own:
                    if not p["spared"]:
                        keep[p["nth"]] = False
                    if p["more"]:
                        keep[np.frombuffer(p["more"], "<i4")] = False
                gone.append(n - int(keep.sum()))
                bitmaps.append(zlib.compress(np.packbits(keep, bitorder="little").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), batch.column("n_lines").cast(pa.int64()), pa.array(gone, pa.int64()), pa.array(bitmaps, pa.binary())],
                                             names=["doc_id", "digest", "n_lines", "n_dropped", "keep"])

    return per_doc.mapInArrow(pack, f"doc_id {kind}, digest long, n_lines long, n_dropped long, keep binary")


@F.arrow_udf(StringType())
def kept_lines(text: pa.Array, keep: pa.Array) -> pa.Array:
    """The lines of ``text`` that the bitmap keeps, joined by line ends."""
    out = []
    for t, packed in zip(text.to_pylist(), keep.to_pylist(), strict=True):
        if t is None or packed is None:
            out.append(t)
            continue
        lines = t.split("\n")
        bits = np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8), bitorder="little")[:len(lines)]
        out.append("\n".join([line for line, bit in zip(lines, bits.tolist(), strict=True) if bit]))
    return pa.array(out, pa.string())


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, key: str = "doc_id", text: str = "text", out: str = "kept") -> DataFrame:
    """``docs`` with ``out``: their text without the dropped lines; ``out_n_lines`` and ``out_n_dropped`` count lines.

    The texts of documents that keep all their lines do not pass through Python.
    """
    maps = bitmaps.select(F.col("doc_id").alias("_of"), F.col("digest").alias("_digest"), F.col("n_lines").alias(f"{out}_n_lines"),
                          F.col("n_dropped").alias(f"{out}_n_dropped"), F.col("keep").alias("_keep"))
    joined = docs.join(maps, F.col(key).eqNullSafe(F.col("_of")) & (digest_of(F.col(text)) == F.col("_digest")))
    loses = F.col(f"{out}_n_dropped") > 0
    cut = kept_lines(F.when(loses, F.col(text)), F.when(loses, F.col("_keep")))
    return joined.withColumn(out, F.when(loses, cut).otherwise(F.coalesce(F.col(text), F.lit("")))).drop("_of", "_digest", "_keep")
