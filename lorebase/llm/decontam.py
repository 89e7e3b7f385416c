"""Benchmark decontamination by SimHash over item-sized windows.

Words (letters and digits, case folded) have 64 random signs; a window's fingerprint is the sign of the sums of its words,
taken from running sums, so that a window of any size costs the same. Items of nearly one size share a window size, and
windows of it slide over every text by an eighth of it. An index of four 16-bit blocks finds all item fingerprints within
``radius`` bits: by the pigeonhole principle one block differs in at most a quarter of them, and every value a block may
take is listed beforehand. Candidates are verified exactly: the weighted similarity of their five-word shingles (sum of
least over sum of greatest counts) with the item-sized window that fits best nearby has to be 0.75 or more.

The items are read into memory in groups of about ``group_bytes`` of text and index; more groups than one mean more passes over
the documents, never a larger table in a task.

Defined results: a null or empty text has no leak, nor has any text for an item without words; an item or text of fewer
than five words is one shingle; an item of 2**15 words or more is found by its shingles only where its signs' sums do not wrap; repeated rows are found each; empty tables give no rows. Only the named columns are read,
so further columns can't clash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebase.llm.common import ALNUM, FOLDED_VALUES, bytes_of, shingle_hashes, slices, word_hashes

RADIUS, SIMILARITY, WIDTH, GROUP_BYTES = 15, 0.75, 5, 16 << 20
#: what an item takes in the index beside its text: its place in the lists of all values near its four blocks
ITEM_BYTES = 12_000
_BLOCKS, _BLOCK_BITS, _FILTER_BITS = 4, 16, 22


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw, starts = bytes_of(texts)
    words, _, bounds = word_hashes(raw, starts, ALNUM, FOLDED_VALUES)
    return words, bounds


def _running(words: np.ndarray) -> np.ndarray:
    """Sums of the words' signs before each word; differences are right as long as a window has under 2**15 words."""
    signs = np.unpackbits(words.view(np.uint8).reshape(-1, 8), axis=1).view(np.int8)
    turned = np.ascontiguousarray(signs.T)
    turned *= 2
    turned -= 1
    out = np.zeros((len(words) + 1, 64), np.int16)
    out[1:] = np.cumsum(turned, axis=1, dtype=np.int16).T  # along memory, many times faster than across it
    return out


def _prints(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1).view(np.uint64).ravel()


def _shingles(words: np.ndarray, width: int) -> np.ndarray:
    return shingle_hashes(words, np.array([0, len(words)]), width)[0]


class Items:
    """The benchmark as an index; ``ids`` in the order of the table."""

    def __init__(self, ids: list, texts: list[str | None], radius: int = RADIUS, similarity: float = SIMILARITY, width: int = WIDTH):
        self.radius, self.similarity, self.width = radius, similarity, width
        words, bounds = _words(pa.array(texts, pa.string()))
        sizes = np.diff(bounds)
        order = [i for i in np.argsort(sizes, kind="stable").tolist() if sizes[i]]
        self.ids = [ids[i] for i in order]
        own = [words[bounds[i]:bounds[i + 1]] for i in order]
        self.sizes = np.array([len(w) for w in own], np.int64)
        shingles = [_shingles(w, width) for w in own]
        self.counts = [Counter(s.tolist()) for s in shingles]
        self.prints = np.array([_prints(_running(w)[-1:])[0] for w in own], np.uint64)
        self.seen = np.zeros(1 << _FILTER_BITS, bool)
        for s in shingles:
            self.seen[(s >> np.uint64(64 - _FILTER_BITS)).astype(np.intp)] = True
        self.needed = np.array([int(np.ceil(similarity * len(s))) for s in shingles], np.int64)
        self.classes: list[tuple[int, list[tuple[np.ndarray, np.ndarray]], int, int]] = []  # window size, blocks, how far sizes differ, least needed
        at = 0
        while at < len(own):
            end = int(np.searchsorted(self.sizes, self.sizes[at] * 1.1, "right"))
            size = int(self.sizes[at:end].mean().round())
            least = 0 if self.sizes[at] < width else int(self.needed[at:end].min())
            self.classes.append((size, self._blocks(np.arange(at, end)), int(np.abs(self.sizes[at:end] - size).max()), least))
            at = end

    def _blocks(self, members: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per block: where the list of each value starts, and the items whose block is near that value."""
        near = np.array([x for x in range(1 << _BLOCK_BITS) if x.bit_count() <= self.radius // _BLOCKS])
        out = []
        for b in range(_BLOCKS):
            value = ((self.prints[members] >> np.uint64(_BLOCK_BITS * b)) & np.uint64((1 << _BLOCK_BITS) - 1)).astype(np.int64)
            values, items = (value[:, None] ^ near[None, :]).ravel(), np.repeat(members, len(near))
            order = np.argsort(values, kind="stable")
            out.append((np.searchsorted(values[order], np.arange((1 << _BLOCK_BITS) + 1)), items[order].astype(np.int32)))
        return out

    def _candidates(self, prints: np.ndarray, blocks) -> tuple[np.ndarray, np.ndarray]:
        """All (window, item) within the radius."""
        windows, items = [], []
        for b, (starts, listed) in enumerate(blocks):
            value = ((prints >> np.uint64(_BLOCK_BITS * b)) & np.uint64((1 << _BLOCK_BITS) - 1)).astype(np.intp)
            first = starts[value]
            n = starts[value + 1] - first
            hit = np.flatnonzero(n)
            n, first = n[hit], first[hit]
            window = np.repeat(hit, n)
            item = listed[np.repeat(first - np.cumsum(n) + n, n) + np.arange(len(window))]
            close = np.bitwise_count(prints[window] ^ self.prints[item]) <= self.radius
            windows.append(window[close])
            items.append(item[close])
        return np.concatenate(windows), np.concatenate(items)

    def leaks(self, texts: pa.Array) -> list[tuple[int, int, int, int, float]]:
        """``row, item, first word, Hamming distance, similarity`` of the best window per text and item."""
        words, bounds = _words(texts)
        if not len(words) or not self.ids:
            return []
        run, run_text = shingle_hashes(words, bounds, self.width)
        counts = np.diff(bounds)
        runs = np.where(counts >= self.width, counts - self.width + 1, (counts > 0).astype(np.int64))
        order = np.argsort(run_text, kind="stable")
        shingle = np.zeros(len(words), np.uint64)  # the shingle that starts at each word
        begin = np.arange(len(run)) - np.repeat(np.cumsum(runs) - runs, runs) + np.repeat(bounds[:-1], runs)
        shingle[begin] = run[order]
        known = np.zeros(len(words) + 1, np.int64)  # shingles of some item that start before each word
        known[begin + 1] = self.seen[(run[order] >> np.uint64(64 - _FILTER_BITS)).astype(np.intp)]
        known = np.cumsum(known)
        owner = np.repeat(np.arange(len(counts)), counts)
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        tried: set[tuple[int, int, int]] = set()
        kept = []
        for size, blocks, spread, least in self.classes:
            stride = max(1, size // 8)
            starts = np.concatenate([np.arange(0, len(words), stride), bounds[:-1], np.maximum(bounds[1:] - size, bounds[:-1])])
            starts = starts[starts < len(words)]
            text = owner[starts]
            stop = np.minimum(starts + size, bounds[text + 1])
            # no item of this class can be where too few of any item's shingles are, whatever the fingerprints say
            slack = stride + spread + 1
            near = known[np.minimum(stop + slack, bounds[text + 1])] - known[np.maximum(starts - slack, bounds[text])]
            able = np.flatnonzero(near >= least)
            starts, stop, text = starts[able], stop[able], text[able]
            fits = stop - starts >= np.minimum(size, np.maximum(0.7 * size, np.minimum(counts, size)[text]))
            kept.append((starts[fits], stop[fits], text[fits]))
        wanted = np.zeros(len(counts), bool)  # texts with a window that is left; only their words are summed up
        for _, _, text in kept:
            wanted[text] = True
        taken = wanted[owner]
        sums, place = _running(words[taken]), np.concatenate([[0], np.cumsum(taken)])
        for (size, blocks, _, _), (starts, stop, text) in zip(self.classes, kept, strict=True):
            stride = max(1, size // 8)
            for a in range(0, len(starts), 1 << 16):
                few = slice(a, a + (1 << 16))
                window, item = self._candidates(_prints(sums[place[stop[few]]] - sums[place[starts[few]]]), blocks)
                window += a
                slack = stride + np.abs(self.sizes[item] - size) + 1
                low = np.maximum(starts[window] - slack, bounds[text[window]])
                high = np.minimum(stop[window] + slack, bounds[text[window] + 1])
                # a text's run of fewer words than a shingle is not among its shingles, so such items are always verified
                full = (self.sizes[item] < self.width) | (known[high] - known[low] >= self.needed[item])
                for w, i, lo, hi in zip(window[full].tolist(), item[full].tolist(), low[full].tolist(), high[full].tolist(), strict=True):
                    key = int(text[w]), i
                    if (key[0], i, lo) in tried or best.get(key, (0.0,))[0] == 1.0:
                        continue
                    tried.add((key[0], i, lo))
                    n = int(self.sizes[i])
                    for at in range(lo, max(lo, hi - n) + 1):
                        stop_at = min(at + n, hi)
                        whole = n < self.width or stop_at - at < self.width
                        found = Counter((_shingles(words[at:stop_at], self.width) if whole else shingle[at:stop_at - self.width + 1]).tolist())
                        least = sum((found & self.counts[i]).values())
                        value = least / (sum(found.values()) + sum(self.counts[i].values()) - least)
                        if value >= self.similarity and value > best.get(key, (0.0,))[0]:
                            print_ = _prints((sums[place[stop_at]] - sums[place[at]])[None])[0]
                            best[key] = value, at - int(bounds[key[0]]), int(np.bitwise_count(print_ ^ self.prints[i]))
        return [(row, i, at, distance, value) for (row, i), (value, at, distance) in sorted(best.items())]


def item_groups(benchmark: DataFrame, key: str = "item_id", text: str = "text", group_bytes: int = GROUP_BYTES) -> Iterator[Items]:
    """The items, read in groups of about ``group_bytes`` of text and index each."""
    rows = benchmark.select(F.col(key).alias("item_id"), F.col(text).alias("text")).where("text is not null")
    total = rows.agg(F.sum(F.octet_length("text") + ITEM_BYTES)).first()[0] or 0
    groups = 1 + total // group_bytes
    for g in range(groups):
        own = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == g).collect() if groups > 1 else rows.collect()
        own.sort(key=lambda r: (str(r["item_id"]), r["text"]))
        yield Items([r["item_id"] for r in own], [r["text"] for r in own])


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", group_bytes: int = GROUP_BYTES) -> DataFrame:
    """``doc_id, item_id, start_word, n_words, distance, similarity``: a row per document and item that it holds."""
    doc_kind, item_kind = docs.schema[key].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()

    def scan(items: Items) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for few in slices(batch):
                    if found := items.leaks(few.column("text")):
                        rows, own, at, distance, value = zip(*found, strict=True)
                        yield pa.RecordBatch.from_arrays(
                            [few.column("doc_id").take(pa.array(rows)), pa.array([items.ids[i] for i in own]), pa.array(at, pa.int64()),
                             pa.array([int(items.sizes[i]) for i in own], pa.int64()), pa.array(distance, pa.int32()), pa.array(value, pa.float64())],
                            names=["doc_id", "item_id", "start_word", "n_words", "distance", "similarity"])

        return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
            run, f"doc_id {doc_kind}, item_id {item_kind}, start_word long, n_words long, distance int, similarity double")

    return reduce(DataFrame.unionByName, [scan(items) for items in item_groups(benchmark, group_bytes=group_bytes)])


def leaks(text: Column, benchmark: DataFrame, group_bytes: int = GROUP_BYTES) -> Column:
    """Whether a text holds an item, as a column; all other columns of a table stay in Spark."""
    def test(items: Items) -> Column:
        @F.arrow_udf("boolean")
        def run(texts):
            out, base = np.zeros(len(texts), bool), 0
            for few in slices(pa.RecordBatch.from_arrays([texts], names=["text"])):
                for row, *_ in items.leaks(few.column("text")):
                    out[base + row] = True
                base += few.num_rows
            return pa.array(out)

        return run(text)

    return reduce(Column.__or__, [test(items) for items in item_groups(benchmark, group_bytes=group_bytes)])
