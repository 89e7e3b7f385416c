"""Exact n-gram Jaccard join by PartEnum signatures.

The distinct shingles of a text are 64-bit hashes; equal sets are one node. Two sets link when their Jaccard similarity
reaches 75 %, which bounds their sizes to a ratio and their Hamming distance (shingles in one alone) to k. Sizes fall into
bands that grow by that ratio, so linked sets lie in one band or in neighbouring ones, and a set takes part for its own
band and for the one below. For a band the hash domain is cut into more than k / 2 partitions, so in one of these linked sets
differ by one shingle at most; each partition is cut into three, and the subsets of two of the three are enumerated: a
signature is the hash of the shingles in such a subset, and one subset avoids the shingle that differs. An empty subset
would match everything and has none. A pair that shares no signature differs at least twice in each partition that holds
shingles in two of its three parts, and once in each that holds some in one. Where that may sum up to k, the set takes part
at a level of twice as many partitions as well, and so on; such a pair has both sets at the next level. Hence no link is lost.

Signatures meet in cells, blobs of some hundred thousand each. Sets that share one are candidates: a first pass checks the
likeliest candidate of each set and joins what links into components. Candidates of different components that upper bounds
(by bitmaps) leave are many in a large group, as each pair of it shares many signatures. So they are not written as pairs:
a list of sets gives the few pairs that connect them, what these connect is a cluster, and a set goes to its cluster once,
where all open pairs are compared by 48 bits of each shingle. Clusters beyond a bound are cut into blocks.

Defined results: a null, empty or blank text has no shingles, links with nothing and is its own component; a text with fewer
words than a shingle is one shingle; repeated rows and rows with a null id are members like others, and a component's id is
its smallest non-null id; an empty table gives no rows. Only the named columns are read, so further columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebase.llm.common import FOLDED_VALUES, SOLID, bytes_of, mix, shingle_hashes, slices, word_hashes
from lorebase.operators.linking import components
from lorebase.session import persist_table

PERCENT, WIDTH = 75, 5
CELL_ENTRIES = 3_000_000
FILTER_BITS = 23
BLOCK = 2048
CLUSTER_SHINGLES = 1 << 21
HUB_ROWS = 2048
SPARE = 1.12
_SKETCH = 8


def _sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, one text after the other; and where each text starts."""
    raw, starts = bytes_of(texts)
    words, _, bounds = word_hashes(raw, starts, SOLID, FOLDED_VALUES)
    hashes, owners = shingle_hashes(words, bounds, width)
    order = np.lexsort((hashes, owners))
    hashes, owners = hashes[order], owners[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])
    hashes, owners = hashes[new], owners[new]
    return hashes, np.searchsorted(owners, np.arange(len(texts) + 1))


def _keys(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of each set; 0 for the empty one."""
    with np.errstate(over="ignore"):
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(hashes + np.uint64(0x51ED270B)))])
        size = np.diff(bounds)
        out = mix(total[bounds[1:]] - total[bounds[:-1]] + size.astype(np.uint64))
    return np.where(size > 0, out | np.uint64(1), np.uint64(0)).astype(np.uint64).view(np.int64)


def _wide_bitmap(own: np.ndarray) -> bytes:
    """As many bits as the set has shingles, up to the next power of two; its halves on one another are the bitmap of half as many."""
    bits = 1 << (len(own) - 1).bit_length()
    place = (mix(own ^ np.uint64(0x5A5A)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=bits) & 1).astype(np.uint8)).tobytes()


class _Wide:
    """The wide bitmaps of many sets, those of one size in a table that has the next larger ones folded as well."""

    def __init__(self, blobs: pa.Array):
        held = blobs.drop_null().to_pylist()
        at = np.flatnonzero(blobs.is_valid().to_numpy(zero_copy_only=False))
        self.size = np.zeros(len(blobs), np.int64)
        self.size[at] = [len(b) for b in held]
        self.place = np.full((2, len(blobs)), -1)  # where a set lies in the table of its own size, and of half its size
        self.tables: dict[int, np.ndarray] = {}
        own = {size: [b for b in held if len(b) == size] for size in set(self.size[at].tolist())}
        full = {size: np.frombuffer(b"".join(b), np.uint64).reshape(-1, size // 8) for size, b in own.items()}
        for size in {*full, *(s // 2 for s in full if s > 128)}:
            parts = [full[size]] if size in full else []
            self.place[0, self.size == size] = np.arange(len(parts[0]) if parts else 0)
            if 2 * size in full:
                self.place[1, self.size == 2 * size] = np.arange(len(full[2 * size])) + (len(parts[0]) if parts else 0)
                parts.append(full[2 * size][:, :size // 8] ^ full[2 * size][:, size // 8:])
            self.tables[size] = np.concatenate(parts)

    def apart(self, x: np.ndarray, other: _Wide, y: np.ndarray) -> np.ndarray:
        """A lower bound of the Hamming distance of sets of near sizes; 0 where one has no wide bitmap."""
        out = np.zeros(len(x), np.int64)
        least = np.minimum(self.size[x], other.size[y])
        for size in set(least[least > 0].tolist()):
            pairs = np.flatnonzero(least == size)
            a, b = x[pairs], y[pairs]
            a = self.tables[size][self.place[(self.size[a] > size).astype(np.int64), a]]
            out[pairs] = np.bitwise_count(a ^ other.tables[size][other.place[(other.size[b] > size).astype(np.int64), b]]).sum(1, dtype=np.int64)
        return out


def describe(docs: DataFrame, width: int = WIDTH, key: str = "doc_id", text: str = "text", digest: str | None = None) -> DataFrame:
    """``doc_id, n_shingles, node, s0..s7, wide``: the set of each row; ``s`` is a bitmap in which each shingle turns one bit.

    512 bits are all about half full for large sets, so a set of more shingles has as many bits as it needs in ``wide``.

    ``digest`` names a long column to be carried along as ``digest``.
    """
    carried = ["digest"] if digest else []
    names = [f"s{j}" for j in range(_SKETCH)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for few in slices(batch):
                hashes, bounds = _sets(few.column("text"), width)
                owner = np.repeat(np.arange(few.num_rows), np.diff(bounds))
                place = (mix(hashes ^ np.uint64(0xA5A5)) >> np.uint64(55)).astype(np.int64)
                odd = (np.bincount(owner * 512 + place, minlength=few.num_rows * 512) & 1).astype(np.uint8).reshape(-1, 512)
                sketch = np.packbits(odd, axis=1).view(np.int64)
                wide = [_wide_bitmap(hashes[bounds[i]:bounds[i + 1]]) if bounds[i + 1] - bounds[i] > 512 else None for i in range(few.num_rows)]
                yield pa.RecordBatch.from_arrays(
                    [few.column("doc_id"), pa.array(np.diff(bounds).astype(np.int64)), pa.array(_keys(hashes, bounds)), *(pa.array(np.ascontiguousarray(sketch[:, j])) for j in range(_SKETCH)), pa.array(wide, pa.binary()), *(few.column(c) for c in carried)],
                    names=["doc_id", "n_shingles", "node", *names, "wide", *carried])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), *[F.col(digest).alias(c) for c in carried]).mapInArrow(
        run, f"doc_id {kind}, n_shingles long, node long, " + ", ".join([*(f"{s} long" for s in names), "wide binary", *(f"{c} long" for c in carried)]))


def bands(most: int, percent: int = PERCENT) -> list[tuple[int, int, int]]:
    """``least size, greatest size, k``: k bounds the Hamming distance of linked sets of this band, or of this and the next."""
    out, low = [], 1
    while low <= most:
        high = low * 100 // percent
        out.append((low, high, (high + high * 100 // percent) * (100 - percent) // (100 + percent)))
        low = high + 1
    return out


def signatures(hashes: np.ndarray, bounds: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of all sets, and the set that each belongs to."""
    size = np.diff(bounds)
    if not len(hashes):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    table = bands(int(size.max()), percent)
    lows, k_of = np.array([b[0] for b in table]), np.array([b[2] for b in table])
    own = np.searchsorted(lows, size, "right") - 1
    found, owners = [], []
    with np.errstate(over="ignore"):
        salted = mix(hashes ^ np.uint64(0xC3C3C3C3))
        for below in (0, 1):
            sets, level = np.flatnonzero((size > 0) & (own - below >= 0)), 0
            while len(sets):
                group = own[sets] - below
                k = k_of[group]
                parts = np.where((k == 0) & (level == 0), 1, np.ceil(SPARE * (k + 1) * 2.0 ** (level - 1))).astype(np.uint64)
                n = size[sets]
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(bounds[sets], n)
                which = np.repeat(np.arange(len(sets)), n)
                own_hash, own_salted = hashes[at], salted[at]
                part = ((own_hash >> np.uint64(32)) * parts[which]) >> np.uint64(32)
                third = ((own_hash & np.uint64(0xFFFFFFFF)) * np.uint64(3)) >> np.uint64(32)
                opens = np.flatnonzero((np.diff(part, prepend=part[:1] + np.uint64(1)) != 0) | (np.diff(which, prepend=-1) != 0))
                holder = which[opens]
                tag = mix((group[holder].astype(np.uint64) << np.uint64(40)) + (np.uint64(level) << np.uint64(33)) + part[opens] * np.uint64(4))
                total = np.add.reduceat(own_salted, opens)
                amount = np.diff(np.append(opens, len(at)))
                filled = np.zeros(len(opens), np.int64)
                for j in range(3):
                    mine = third == np.uint64(j)
                    gone, less = np.add.reduceat(np.where(mine, own_salted, np.uint64(0)), opens), np.add.reduceat(mine.astype(np.int64), opens)
                    filled += less > 0
                    held = np.flatnonzero((amount > less) & ((k[holder] > 0) | (level > 0)))
                    found.append(mix(total[held] - gone[held] + tag[held] + np.uint64(j + 1)))
                    owners.append(sets[holder[held]])
                plain = np.flatnonzero((k[holder] == 0) & (level == 0))
                found.append(mix(total[plain] + tag[plain]))
                owners.append(sets[holder[plain]])
                safe = np.bincount(holder, np.minimum(filled, 2), minlength=len(sets))
                sets, level = sets[safe <= k], level + 1
    return np.concatenate(found), np.concatenate(owners)


def _cells(docs: DataFrame, cells: int, width: int, percent: int) -> DataFrame:
    """``cell, nodes, owner, sign``: blobs of signatures, each with the place of its node among ``nodes``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed: set[int] = set()
        for batch in batches:
            for few in slices(batch, most=2 << 20):
                hashes, bounds = _sets(few.column("text"), width)
                keys = _keys(hashes, bounds)
                fresh = np.zeros(len(keys), bool)
                if len(passed) > 1_000_000:
                    passed.clear()
                for i, node in enumerate(keys.tolist()):
                    if node and node not in passed:
                        passed.add(node)
                        fresh[i] = True
                chosen = np.flatnonzero(fresh)
                if not len(chosen):
                    continue
                sizes = np.diff(bounds)[chosen]
                at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(bounds[chosen], sizes)
                sign, owner = signatures(hashes[at], np.concatenate([[0], np.cumsum(sizes)]), percent)
                cell = ((sign >> np.uint64(32)) * np.uint64(cells)) >> np.uint64(32)
                order = np.lexsort((owner, cell))
                cell, owner, sign = cell[order].astype(np.int64), owner[order], sign[order].astype(np.uint32)
                edges = np.searchsorted(cell, np.unique(cell)).tolist() + [len(cell)]
                rows = []
                for a, b in zip(edges, edges[1:], strict=False):
                    held, place = np.unique(owner[a:b], return_inverse=True)
                    rows.append((int(cell[a]), keys[chosen[held]].tobytes(), place.astype("<u4" if len(held) > 65535 else "<u2").tobytes(), sign[a:b].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)],
                                                 names=["cell", "nodes", "owner", "sign"])

    return docs.select("text").mapInArrow(run, "cell int, nodes binary, owner binary, sign binary")


def _shared(cell: pa.Table) -> pa.Table:
    """The lists of nodes that share a signature, each list once in a cell."""
    nodes, signs = [], []
    for held, owner, sign in zip(cell["nodes"].to_pylist(), cell["owner"].to_pylist(), cell["sign"].to_pylist(), strict=True):
        values = np.frombuffer(sign, "<u4")
        signs.append(values)
        nodes.append(np.frombuffer(held, "<i8")[np.frombuffer(owner, "<u2" if len(owner) == 2 * len(values) else "<u4")])
    node, sign = np.concatenate(nodes), np.concatenate(signs)
    order = np.argsort(sign, kind="stable")
    node, sign = node[order], sign[order]
    twin = np.zeros(len(sign), bool)
    twin[1:] = sign[1:] == sign[:-1]
    twin[:-1] |= twin[1:]
    node, sign = node[twin], sign[twin]
    order = np.lexsort((node, sign))
    node, sign = node[order], sign[order]
    new = np.ones(len(sign), bool)
    new[1:] = (sign[1:] != sign[:-1]) | (node[1:] != node[:-1])
    node, sign = node[new], sign[new]
    opens = np.flatnonzero(np.diff(sign.astype(np.int64), prepend=-1))
    ends = np.append(opens[1:], len(sign))
    listed, out = {}, []
    if len(opens):
        with np.errstate(over="ignore"):
            names = np.add.reduceat(mix(node.view(np.uint64)), opens).view(np.int64).tolist()
        for name, a, b in zip(names, opens.tolist(), ends.tolist(), strict=True):
            if b - a > 1 and name not in listed:
                listed[name] = None
                out.append((name, node[a:b]))
    return pa.table({"list": pa.array([n for n, _ in out], pa.int64()), "nodes": pa.array([v for _, v in out], pa.list_(pa.int64()))})


def _apart(a: str, b: str) -> Column:
    """A lower bound of the Hamming distance of two nodes, by their bitmaps."""
    return sum((F.bit_count(F.col(f"{a}.s{j}").bitwiseXOR(F.col(f"{b}.s{j}"))) for j in range(_SKETCH)), F.lit(0))


def _near(a: str, b: str, percent: int) -> Column:
    """Whether sizes and bitmaps of two nodes leave their similarity open."""
    n, m = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (_apart(a, b) * (100 + percent) <= (n + m) * (100 - percent))


def _sieve(nodes: DataFrame) -> np.ndarray:
    """A bitmap of FILTER_BITS bits in which the bits of ``nodes`` are set: a megabyte, however many there are."""
    place = F.col("node").bitwiseAND((1 << FILTER_BITS) - 1)
    words = nodes.select(F.shiftright(place, 6).alias("word"), F.lit(1).cast("long").alias("one"), place.bitwiseAND(63).cast("int").alias("at"))
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    for row in words.groupBy("word").agg(F.bit_or(F.expr("shiftleft(one, at)")).alias("bits")).collect():  # as many rows as ``out`` has words at most
        out[row["word"]] = row["bits"]
    return out.view(np.uint64)


def _whole_sets(docs: DataFrame, sieve: np.ndarray, width: int) -> DataFrame:
    """``node, own``: the shingles of the sets that pass the sieve, some more than once, a join sorts out the rest.

    48 bits of each shingle, the upper 32 of all and then the lower 16 of all.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed: set[int] = set()
        for batch in batches:
            for few in slices(batch):
                hashes, bounds = _sets(few.column("text"), width)
                keys = _keys(hashes, bounds)
                place = keys & ((1 << FILTER_BITS) - 1)
                chosen = np.flatnonzero((keys != 0) & ((sieve[place >> 6] >> (place & 63).astype(np.uint64) & np.uint64(1)) == 1))
                if len(passed) > 1_000_000:
                    passed.clear()
                rows = []
                for i in chosen.tolist():
                    node = int(keys[i])
                    if node not in passed:
                        passed.add(node)
                        own = hashes[bounds[i]:bounds[i + 1]]
                        rows.append((node, (own >> np.uint64(16)).astype("<u4").tobytes() + own.astype("<u2").tobytes()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary()), strict=True)], names=["node", "own"])

    return docs.select("text").mapInArrow(run, "node long, own binary")


def _whole(data: bytes) -> np.ndarray:
    n = len(data) // 6
    return (np.frombuffer(data, "<u4", n).astype(np.uint64) << np.uint64(16)) | np.frombuffer(data, "<u2", n, 4 * n)


def verify(edges: DataFrame, docs: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """The candidates ``a, b`` (a written table) that link.

    Sets are made from the texts again and only those of candidates are dealt out. Members b meet their hub a sorted,
    so a task streams them; large hubs are salted.
    """
    salts = edges.groupBy("a").agg((F.floor(F.count(F.lit(1)) / HUB_ROWS) + 1).alias("salts"))
    members = edges.join(salts, "a").select(F.col("b").alias("node"), "a", F.pmod(F.xxhash64("b"), F.col("salts")).alias("salt"), F.lit(1).alias("role"))
    hubs = salts.select(F.col("a").alias("node"), "a", F.explode(F.expr("sequence(0L, salts - 1)")).alias("salt"), F.lit(0).alias("role"))
    ends = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node")))
    met = members.unionByName(hubs).join(_whole_sets(docs, _sieve(ends), width), "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, size, own_hub = None, 0, np.zeros(0, np.uint64)
        for batch in batches:
            out = []
            for node, a, role, data in zip(*(batch[c].to_pylist() for c in ("node", "a", "role", "own")), strict=True):
                own = _whole(data)
                if role == 0:
                    if a != hub:
                        hub, size, own_hub = a, len(own), np.sort(own)
                elif a == hub:
                    place = np.searchsorted(own_hub, own)
                    place[place == size] = 0
                    both = int(np.count_nonzero(own_hub[place] == own))
                    if 100 * both >= percent * (len(own) + size - both):
                        out.append((a, node))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])

    return met.repartition("a", "salt").sortWithinPartitions("a", "salt", "role").mapInArrow(run, "a long, b long")


def _open_pairs(left: tuple[np.ndarray, ...], right: tuple[np.ndarray, ...], percent: int, wide: tuple[_Wide, int, _Wide, int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places ``x, y`` in two lists of nodes (component, n_shingles, sketch) of different components that sizes and bitmaps leave open.

    Some rows of ``left`` at a time; all pairs of such a row come together. ``wide``: bitmaps for large sets and where those of the list begin.
    """
    (part, n, sketch), (part_, n_, sketch_) = left, right
    for at in range(0, len(n), 64):
        few = slice(at, at + 64)
        open_ = (part[few, None] != part_[None]) & (np.minimum(n[few, None], n_[None]) * 100 >= np.maximum(n[few, None], n_[None]) * percent)
        x, y = np.nonzero(open_)
        apart = np.bitwise_count(sketch[few][x] ^ sketch_[y]).sum(1, dtype=np.int64)
        near = apart * (100 + percent) <= (n[few][x] + n_[y]) * (100 - percent)
        x, y = x[near] + at, y[near]
        if wide and len(x):
            own, start, other, start_ = wide
            near = own.apart(x + start, other, y + start_) * (100 + percent) <= (n[x] + n_[y]) * (100 - percent)
            x, y = x[near], y[near]
        if len(x):
            yield x, y


def _stars(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewer pairs that connect what the pairs ``x, y`` connect: each node with the least one that it reaches."""
    nodes, place = np.unique(np.concatenate([x, y]), return_inverse=True)
    a, b = place[:len(x)], place[len(x):]
    least, before = np.arange(len(nodes)), None
    while before is None or (least != before).any():
        before = least.copy()
        m = np.minimum(least[a], least[b])
        for side in (a, b):
            np.minimum.at(least, before[side], m)
            np.minimum.at(least, side, m)
        least = least[least]
    held = least != np.arange(len(nodes))
    return nodes[least[held]], nodes[held]


def _reach(percent: int):
    """Pairs that connect, within the blocks of a list, what is left open; ``left`` and ``right`` may be one block.

    A batch gives fewer pairs than its lists have members, however many are open.
    """
    def columns(block: pa.StructArray) -> tuple[np.ndarray, ...]:
        field = lambda name: block.field(name).to_numpy(zero_copy_only=False)
        return field("node"), field("component"), field("n_shingles"), np.stack([field(f"s{j}") for j in range(_SKETCH)], 1).view(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            sides = [(c.offsets.to_numpy(), columns(c.values)) for c in (batch["left"], batch["right"])]
            wide, wide_ = (_Wide(c.values.field("wide")) for c in (batch["left"], batch["right"]))
            for row in range(batch.num_rows):
                (node, *left), (node_, *right) = (tuple(v[o[row]:o[row + 1]] for v in values) for o, values in sides)
                for x, y in _open_pairs(left, right, percent, (wide, sides[0][0][row], wide_, sides[1][0][row])):
                    found.append(_stars(node[x], node_[y]))
            if found:
                a, b = _stars(*(np.concatenate(c) for c in zip(*found, strict=True)))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def _linked_across(percent: int):
    """Links between different components of a cluster's blocks, as few as connect what all of them connect.

    Rows come by cluster and pair of blocks; a set that links is of its partner's component from then on.
    """
    def links(held: list[dict]) -> list[tuple[int, int]]:
        node, part, n, block = (np.array([r[c] for r in held], np.int64) for c in ("node", "component", "n_shingles", "block"))
        sketch = np.array([[r[f"s{j}"] for j in range(_SKETCH)] for r in held], np.int64).view(np.uint64)
        _, shingle = np.unique(np.concatenate([_whole(r["own"]) for r in held]), return_inverse=True)
        ends = np.cumsum(n)
        marked = np.zeros(len(shingle), bool)
        right = block == block.max()
        left = block == block.min()
        rows, columns = np.flatnonzero(left), np.flatnonzero(right)
        out = []
        for xs, ys in _open_pairs((part[rows], n[rows], sketch[rows]), (part[columns], n[columns], sketch[columns]), percent):
            xs, ys = rows[xs], columns[ys]
            edges = np.flatnonzero(np.diff(xs, prepend=-1, append=-1)).tolist()
            for a, b in zip(edges, edges[1:], strict=False):
                x, y = int(xs[a]), ys[a:b]
                y = y[part[y] != part[x]]
                if not len(y):
                    continue
                own = shingle[ends[x] - n[x]:ends[x]]
                marked[own] = True
                size = n[y]
                first = np.cumsum(size) - size
                both = np.add.reduceat(marked[shingle[np.arange(size.sum()) + np.repeat(ends[y] - size - first, size)]].astype(np.int64), first)
                marked[own] = False
                for other in y[100 * both >= percent * (n[x] + size - both)].tolist():
                    if part[other] != part[x]:
                        out.append((int(node[x]), int(node[other])))
                        part[part == part[other]] = part[x]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, seen = None, [], set()

        def found() -> Iterator[pa.RecordBatch]:
            out = links(held) if len(held) > 1 else []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])

        for batch in batches:
            for row in batch.to_pylist():
                mine = row["cluster"], row["i"], row["j"]
                if mine != key:
                    yield from found()
                    key, held, seen = mine, [], set()
                if row["node"] not in seen:
                    seen.add(row["node"])
                    held.append(row)
        yield from found()

    return run


def _links_within(clusters: DataFrame, known: DataFrame, docs: DataFrame, percent: int, width: int, most: int) -> DataFrame:
    """Links ``a, b`` of ``node, component``, a written table: as few as connect what the links within a cluster connect.

    A set comes to its cluster once. A cluster of more than ``most`` shingles is cut into blocks of about as many, and any two meet.
    """
    placed = clusters.withColumnRenamed("component", "cluster").join(known, "node")
    cuts = placed.groupBy("cluster").agg((F.floor(F.sum("n_shingles") / most) + 1).alias("cuts"))
    placed = placed.join(cuts, "cluster").withColumn("block", F.pmod(F.xxhash64("node"), F.col("cuts"))).withColumn("_other", F.explode(F.expr("sequence(0L, cuts - 1)")))
    placed = placed.withColumn("i", F.least("block", "_other")).withColumn("j", F.greatest("block", "_other")).drop("cuts", "_other")
    met = placed.join(_whole_sets(docs, _sieve(clusters), width), "node")
    return met.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j").mapInArrow(_linked_across(percent), "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH, key: str = "doc_id", text: str = "text",
                    cell_entries: int = CELL_ENTRIES, block: int = BLOCK, digest: str | None = None,
                    cluster_shingles: int = CLUSTER_SHINGLES) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row.

    With ``digest``, a long column that tells apart the texts of one id, also ``digest`` and ``component``: the component itself,
    as two may have the same least id; null for an empty set.
    """
    extra = ["digest", "component"] if digest else []
    described = persist_table(describe(docs, width, key, text, digest), "sets")
    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    info = ["n_shingles", *(f"s{j}" for j in range(_SKETCH)), "wide"]
    nodes = persist_table(described.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("first_id"), *[F.max(c).alias(c) for c in info]), "nodes")
    total = nodes.agg(F.sum("n_shingles")).first()[0] or 0
    lists = _cells(docs, 1 + total // cell_entries, width, percent).groupBy("cell").applyInArrow(_shared, "list long, nodes array<long>")
    lists = persist_table(lists.dropDuplicates(["list"]), "lists")
    chain = lists.select(F.explode(F.arrays_zip(F.expr("slice(nodes, 1, size(nodes) - 1)").alias("a"), F.expr("slice(nodes, 2, size(nodes) - 1)").alias("b"))).alias("x")).select("x.a", "x.b").distinct()
    near = chain.join(nodes.alias("p"), F.col("a") == F.col("p.node")).join(nodes.alias("q"), F.col("b") == F.col("q.node")).where(_near("p", "q", percent))
    first = persist_table(near.groupBy("b").agg(F.min(F.struct(_apart("p", "q"), "a")).alias("x")).select("x.a", "b"), "candidates")
    listed = lists.select("list", F.explode("nodes").alias("node"))
    links = persist_table(verify(first, docs, percent, width), "links")
    parts = components(links)
    placed = listed.join(parts, "node", "left").select("list", "node", F.coalesce("component", "node").alias("component"))
    open_ = placed.groupBy("list").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("list")
    blocks = lists.join(open_, "list", "left_semi").withColumn("_n", F.floor((F.size("nodes") - 1) / block).cast("int"))
    blocks = blocks.withColumn("i", F.explode(F.expr("sequence(0, _n)"))).withColumn("j", F.explode(F.expr("sequence(i, _n)")))
    blocks = blocks.select("list", "i", "j", F.explode(F.array(*[F.struct(F.lit(n).alias("side"), F.expr(f"slice(nodes, {c} * {block} + 1, {block})").alias("own")) for n, c in enumerate("ij")])).alias("h"))
    known = nodes.join(parts, "node", "left").select("node", F.coalesce("component", "node").alias("component"), *info)
    blocks = blocks.select("list", "i", "j", "h.side", F.explode("h.own").alias("node")).join(known, "node")
    member = F.struct("node", "component", *info)
    blocks = blocks.groupBy("list", "i", "j").agg(*[F.collect_list(F.when(F.col("side") == n, member)).alias(s) for n, s in enumerate(("left", "right"))])
    reached = persist_table(blocks.select("left", "right").mapInArrow(_reach(percent), "a long, b long").distinct(), "candidates")
    clusters = persist_table(components(reached), "clusters")
    more = persist_table(_links_within(clusters, known.drop("wide"), docs, percent, width, cluster_shingles), "links")
    if more.limit(1).count():
        parts = components(links.unionByName(more))
    named = nodes.select("node", "first_id").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = persist_table(named.join(least, "component").select("node", "component_id", *extra[1:]), "components")
    full = described.where("n_shingles > 0").join(named, "node").select("doc_id", "n_shingles", "component_id", *extra)
    alone = described.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), *extra[:1])
    return full.unionByName(alone, allowMissingColumns=True)
