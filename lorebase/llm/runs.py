"""Periodic runs of words, found on a grammar of the word ids.

The words of a block of documents become ids, and Re-Pair turns pairs that occur again into nonterminals, round by round,
until no pair inside a document occurs twice. What is left of each document becomes a balanced tree of nodes of its own. A
run lies across the border between the two halves of the lowest nonterminal or node that holds it whole, so each
nonterminal is searched once, at one of its occurrences, for runs across its border: a run of four periods or more holds a
square on one side of any border it crosses, which gives the candidate periods, and hashes of prefixes tell how far they
reach. The runs of a nonterminal are then carried to all places where the derivation uses it, and per period the intervals
that lie inside a longer one are merged into it.

A run is a stretch of words with smallest period q, of at least four periods and six words, that no neighbouring word extends.

Memory: arrays over the words of about a megabyte of text, or of one longer document. Words, and stretches of words, are
compared by 64-bit hashes.

Defined results: null, empty and blank texts have no words and no runs; equal rows give equal results; an empty table gives no
rows. Only the id and the text are read, so further columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebase.llm.common import SOLID, byte_values, bytes_of, slices, word_hashes

PERIODS = 4
LEAST_WORDS = 6
#: (border, period) pairs looked at together
PAIRS_AT_ONCE = 1 << 20

_VALUES = byte_values()
_ODD = 0x9E3779B97F4A7C15


class Stretches:
    """Compares stretches of words by prefix hashes."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        with np.errstate(over="ignore"):
            self.up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _ODD, np.uint64)]))
            self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * self.up[:n])])

    def equal(self, at: np.ndarray, size: np.ndarray, shift: np.ndarray) -> np.ndarray:
        """Whether the words from ``at`` and from ``at + shift`` agree for ``size`` words."""
        with np.errstate(over="ignore"):
            near = (self.total[at + size] - self.total[at]) * self.up[shift]
            return near == self.total[at + shift + size] - self.total[at + shift]

    def reach(self, at: np.ndarray, shift: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """How many words agree from ``at`` on (or before it, going back), at most ``most``: by halving steps."""
        low = np.zeros(len(at), np.int64)
        step = 1 << max(0, int(most.max(initial=0)).bit_length() - 1)
        while step:
            size = low + step
            can = np.flatnonzero(size <= most)
            good = can[self.equal(at[can] - size[can] if back else at[can], size[can], shift[can])]
            low[good] = size[good]
            step >>= 1
        return low


def across(words: np.ndarray, stretches: Stretches, start: np.ndarray, mid: np.ndarray, end: np.ndarray):
    """``node, start, end, period`` of the runs over the border at ``mid`` within ``start .. end`` of each node."""
    most = (end - start) // PERIODS
    able = np.flatnonzero(end - start >= LEAST_WORDS)
    out = []
    ends = np.cumsum(most[able])
    a = 0
    while a < len(able):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS_AT_ONCE, side="right")))
        few = able[a:b]
        node = np.repeat(few, most[few])
        q = np.arange(len(node)) - np.repeat(np.cumsum(most[few]) - most[few], most[few]) + 1
        a = b
        for left in (False, True):
            inside = mid[node] - 2 * q >= start[node] if left else mid[node] + 2 * q <= end[node]
            own, p = node[inside], q[inside]
            c = mid[own]
            alike = words[c - 1] == words[c - 1 - p] if left else words[c] == words[c + p]
            own, p, c = own[alike], p[alike], c[alike]
            square = stretches.equal(c - 2 * p if left else c, p, p)
            own, p = own[square], p[square]
            anchor = mid[own] - p if left else mid[own]
            first = anchor - stretches.reach(anchor, p, anchor - start[own], True)
            stop = anchor + stretches.reach(anchor, p, end[own] - p - anchor, False) + p
            long = stop - first >= np.maximum(LEAST_WORDS, PERIODS * p)
            out.append((own[long], first[long], stop[long], p[long]))
    return tuple(np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64) for i in range(4))


def _again(symbols: np.ndarray, doc: np.ndarray):
    """Where pairs that occur again are replaced in this round, and which pair it is.

    A pair gives way to a more frequent one beside it; of equally frequent ones in a row every other one is taken.
    """
    pairs = (symbols[:-1] << 32) | symbols[1:]
    inner = np.flatnonzero(doc[:-1] == doc[1:])
    _, back, counts = np.unique(pairs[inner], return_inverse=True, return_counts=True)
    weight = np.zeros(len(pairs) + 2, np.int64)
    weight[inner + 1] = counts[back]
    own = weight[1:-1]
    at = np.flatnonzero((own >= 2) & (own >= weight[:-2]) & (own >= weight[2:]))
    opens = np.flatnonzero(np.diff(at, prepend=-2) != 1)
    at = at[(np.arange(len(at)) - np.repeat(opens, np.diff(opens, append=len(at)))) % 2 == 0]
    found, which = np.unique(pairs[at], return_inverse=True)
    return at, found, which


def find_runs(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``start, end, period`` of all runs of the documents whose words are ``hashes[bounds[i]:bounds[i + 1]]``, by start and period."""
    found, symbols = np.unique(hashes, return_inverse=True)
    symbols = symbols.astype(np.int64)
    stretches = Stretches(hashes)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    place = np.arange(len(symbols))
    size = np.ones(len(found), np.int64)
    rounds = []  # first number, left, right, and the runs across the border of each rule, from its start
    holds = np.zeros(len(found), bool)
    while len(symbols) > 1:
        at, pairs, which = _again(symbols, doc)
        if not len(pairs):
            break
        left, right = pairs >> 32, pairs & 0xFFFFFFFF
        example = np.zeros(len(pairs), np.int64)
        example[which] = place[at]
        own, first, stop, period = across(hashes, stretches, example, example + size[left], example + size[left] + size[right])
        rounds.append((len(size), left, right, own, first - example[own], stop - example[own], period))
        holds_new = holds[left] | holds[right]
        holds_new[own] = True
        symbols[at] = len(size) + which
        size, holds = np.concatenate([size, size[left] + size[right]]), np.concatenate([holds, holds_new])
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        symbols, doc, place = symbols[keep], doc[keep], place[keep]
    results = []
    # the derivation, from the last rules down, only where a run is below
    pending = [(symbols[holds[symbols]], place[holds[symbols]])] if len(symbols) else []
    for number, left, right, own, first, stop, period in reversed(rounds):
        sym, at = (np.concatenate([p[i] for p in pending]) if pending else np.zeros(0, np.int64) for i in (0, 1))
        here = sym >= number
        rule, start = sym[here] - number, at[here]
        order = np.argsort(own, kind="stable")
        low, high = np.searchsorted(own[order], rule), np.searchsorted(own[order], rule, side="right")
        each = order[np.repeat(low, high - low) + np.arange((high - low).sum()) - np.repeat(np.cumsum(high - low) - (high - low), high - low)]
        base = np.repeat(start, high - low)
        results.append((base + first[each], base + stop[each], period[each]))
        below = [(left[rule], start), (right[rule], start + size[left[rule]])]
        pending = [(sym[~here], at[~here]), *((s[holds[s]], p[holds[s]]) for s, p in below)]
    # what is left of each document, as a balanced tree
    span = size[symbols]
    while len(doc) and (doc[1:] == doc[:-1]).any():
        nth = np.arange(len(doc)) - np.searchsorted(doc, doc)
        at = np.flatnonzero((nth[:-1] % 2 == 0) & (doc[1:] == doc[:-1]))
        results.append(across(hashes, stretches, place[at], place[at + 1], place[at + 1] + span[at + 1])[1:])
        span[at] += span[at + 1]
        keep = np.ones(len(doc), bool)
        keep[at + 1] = False
        doc, place, span = doc[keep], place[keep], span[keep]
    start, end, period = (np.concatenate([r[i] for r in results]) if results else np.zeros(0, np.int64) for i in range(3))
    order = np.lexsort((-end, start, period))
    start, end, period = start[order], end[order], period[order]
    farthest = np.maximum.accumulate(period * (len(hashes) + 1) + end)  # per period, as periods only grow
    whole = np.diff(farthest, prepend=-1) > 0
    start, end, period = start[whole], end[whole], period[whole]
    order = np.lexsort((period, end, start))  # one interval with several periods: the smallest counts
    start, end, period = start[order], end[order], period[order]
    new = np.concatenate([[True], (np.diff(start) != 0) | (np.diff(end) != 0)])[:len(start)]
    start, end, period = start[new], end[new], period[new]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` per row: runs as ``start, length, period`` by start and period, counted in words.

    ``collapsed`` has the words joined by one space, without those that a run repeats after its first period.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for few in slices(batch):
                hashes, _, bounds = word_hashes(*bytes_of(few.column("text")), SOLID, _VALUES)
                start, end, period = find_runs(hashes, bounds)
                at = np.searchsorted(start, bounds)
                change = np.zeros(len(hashes) + 1, np.int64)
                np.add.at(change, start + period, 1)
                np.add.at(change, end, -1)
                keep = np.cumsum(change)[:-1] == 0
                collapsed = []
                for i, own in enumerate(few.column("text").cast(pa.binary()).to_pylist()):
                    words = (own or b"").split()
                    if at[i + 1] > at[i]:
                        words = [w for w, k in zip(words, keep[bounds[i]:bounds[i + 1]].tolist(), strict=True) if k]
                    collapsed.append(b" ".join(words))
                first = np.repeat(bounds[:-1], np.diff(at))
                each = pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in (start - first, end - start, period)], ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [few.column("doc_id"), pa.array(np.diff(bounds).astype(np.int64)), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), each), pa.array(collapsed, pa.binary()).cast(pa.string())],
                    names=["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def with_planted_runs(text: Column, key: Column) -> Column:
    """The text of about every tenth id, made periodic from some word on; all others as they are (no id: as it is).

    With h the CRC-32 of the id, g = h div 10 and n words, the words from g mod n on repeat the first
    1 + (n - g mod n) div (3 + g mod 8) of them.
    """
    h = F.crc32(key.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size(words)
    a = F.pmod(g, F.greatest(n, F.lit(1))).cast("int")
    p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8))))).cast("int")
    block = F.slice(words, a + 1, p)
    times = F.ceil((n - a) / p).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(block, times)), F.lit(1), n - a)
    planted = F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")
    return F.when((h % 10 == 0) & (n > 0), planted).otherwise(text)
