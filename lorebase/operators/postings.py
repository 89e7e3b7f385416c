"""A stored chunk index that is searched block by block, best blocks first, without reading those that can't matter.

Chunks lie in blocks along their order; a block is a folder of the table. Beside them lie grams: for each run of two or three
characters and each block in whose search text it occurs, how often one chunk has it at most, and whether a title or a
section has it. A term can only be where all its grams are, and no more often, so the grams of a question give an upper bound
of the lexical score any chunk of a block can reach. The best few blocks are ranked first; their k-th score is a floor, and
only blocks whose bound reaches it are read besides. The hits are those of a scan over everything.

A blended ranking first reads vectors alone. A chunk's cosine and its block's bound limit its score; search texts are read
for the chunks that reach the floor.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebase import rules
from lorebase.functions import scoring as S
from lorebase.functions import terms as Q
from lorebase.operators import search
from lorebase.session import persist_table

BLOCK_CHUNKS = 1 << 15
#: this many blocks are enough to tell good ones from others
SMALL_BLOCKS = 64
#: blocks ranked ahead of all others
FIRST_BLOCKS = 8
#: more blocks than this are named by a join in place of a list
LISTED_BLOCKS = 10_000
SEARCHED = ("hay", "title_cf", "section_cf")
_SIZES = (2, 3)
_ROUNDING = 1e-3


def in_blocks(index: DataFrame, block_chunks: int = BLOCK_CHUNKS) -> DataFrame:
    """The index with its search texts and ``block``, ready to be written by block; counts the rows for the number of blocks.

    Smaller blocks than ``BLOCK_CHUNKS`` grow with the index once there are ``SMALL_BLOCKS`` of them.
    """
    rows = index.count()
    blocks = max(1, -(-rows // max(block_chunks, min(BLOCK_CHUNKS, rows // SMALL_BLOCKS))))
    dealt = search.with_search_text(index).repartitionByRange(blocks, "ordinal", "chunk_index")
    return dealt.withColumn("block", F.spark_partition_id())


def _grams_of(texts: list[str]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per gram size: the grams of all texts, as numbers, and how often the text that has one most has it."""
    out = {}
    for size in _SIZES:
        kinds, counts = [], []
        for text in texts:
            letters = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
            if len(letters) < size:
                continue
            number = np.zeros(len(letters) - size + 1, np.uint64)
            for j in range(size):
                number = (number << np.uint64(21)) | letters[j:j + len(number)]
            kind, count = np.unique(number, return_counts=True)
            kinds.append(kind)
            counts.append(count)
        kind, count = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (kinds, counts))
        order = np.argsort(kind, kind="stable")
        kind, count = kind[order], count[order]
        first = np.flatnonzero(np.diff(kind, prepend=kind[:1] ^ np.uint64(1)) != 0) if len(kind) else np.zeros(0, np.int64)
        out[size] = kind[first], np.maximum.reduceat(count, first) if len(first) else first
    return out


def _spelled(kind: np.ndarray, size: int) -> list[str]:
    letters = np.stack([(kind >> np.uint64(21 * (size - 1 - j))) & np.uint64((1 << 21) - 1) for j in range(size)], 1).astype("<u4")
    text = letters.tobytes().decode("utf-32-le", "surrogatepass")
    return [text[i:i + size] for i in range(0, len(text), size)]


def _batch_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        blocks = batch.column("block").to_numpy()
        for block in np.unique(blocks):
            own = batch.filter(pa.array(blocks == block))
            texts = {c: [t or "" for t in own.column(c).to_pylist()] for c in SEARCHED}
            found = _grams_of(texts["hay"])
            heads = {c: _grams_of(texts[c]) for c in ("title_cf", "section_cf")}
            for size, (kind, most) in found.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_spelled(kind, size)), pa.array(np.full(len(kind), block, np.int32)), pa.array(np.minimum(most, rules.TERM_COUNT_CAP).astype(np.int32)),
                     pa.array(np.isin(kind, heads["title_cf"][size][0])), pa.array(np.isin(kind, heads["section_cf"][size][0]))],
                    names=["gram", "block", "most", "title", "section"])


def block_grams(blocks: DataFrame) -> DataFrame:
    """``gram, block, most, title, section`` of a table in blocks: one row per gram and batch of a block, then summed up."""
    parts = blocks.select("block", *SEARCHED).mapInArrow(_batch_grams, "gram string, block int, most int, title boolean, section boolean")
    return parts.groupBy("gram", "block").agg(F.max("most").alias("most"), F.bool_or("title").alias("title"), F.bool_or("section").alias("section"))


def write_blocks(index: DataFrame, path: str, block_chunks: int = BLOCK_CHUNKS) -> None:
    """The chunks at ``path`` and their grams, in the order of the grams, at ``path-grams``."""
    index = persist_table(index, "chunks")  # counted, sampled for the borders of blocks and written
    in_blocks(index, block_chunks).write.mode("errorifexists").partitionBy("block").parquet(path)
    grams = block_grams(index.sparkSession.read.parquet(path))
    grams.repartitionByRange("gram", "block").sortWithinPartitions("gram", "block").write.mode("errorifexists").parquet(f"{path}-grams")


def _grams(term: str) -> list[str]:
    size = min(3, len(term))
    return list(dict.fromkeys(term[i:i + size] for i in range(len(term) - size + 1)))


@dataclass
class Blocks:
    """A stored index: its chunks by block, and the grams of its blocks."""

    chunks: DataFrame
    grams: DataFrame

    def bounds(self, question: str, alias_rules: Q.AliasRules = rules.CHUNK_ALIASES) -> DataFrame:
        """``block, bound``: no chunk of the block has a higher lexical score. Blocks without a gram of the question are left out."""
        terms = [t for t in Q.question_terms(question, alias_rules) if t]
        phrase = question.casefold().strip()
        texts = [(a.casefold(), rules.ALIAS_BONUS) for a in Q.aliases(question, alias_rules)] + [(phrase, rules.PHRASE_BONUS)] * (len(phrase) >= 3)
        wanted = sorted({g for t in [*terms, *(t for t, _ in texts)] for g in _grams(t) if len(g) > 1})
        rows = self.grams.where(F.col("gram").isin(wanted)).groupBy("block").agg(
            F.map_from_entries(F.collect_list(F.struct("gram", F.struct("most", "title", "section").alias("v")))).alias("m"))

        def least(term: str) -> Column:
            """How often the block's chunks can have the term at most; a single character can be anywhere."""
            known = [g for g in _grams(term) if len(g) > 1]
            counts = [F.coalesce(F.try_element_at("m", F.lit(g))["most"], F.lit(0)) for g in known]
            return F.lit(rules.TERM_COUNT_CAP) if not counts else F.least(*counts) if len(counts) > 1 else counts[0]

        def everywhere(term: str, where: str) -> Column:
            return reduce(lambda a, b: a & b, [F.coalesce(F.try_element_at("m", F.lit(g))[where], F.lit(False)) for g in _grams(term) if len(g) > 1], F.lit(True))

        parts = [S.bonus(least(t) > 0, points) for t, points in texts]
        for term in terms:
            parts += [least(term) * F.lit(Q.term_weight(term)), S.bonus(everywhere(term, "title"), rules.TITLE_BONUS), S.bonus(everywhere(term, "section"), rules.SECTION_BONUS)]
        return rows.select("block", S.total(parts).alias("bound"))

    def only(self, blocks: DataFrame) -> DataFrame:
        """The chunks of some blocks; other blocks' folders are not opened."""
        few = [r["block"] for r in blocks.limit(LISTED_BLOCKS + 1).collect()]
        if len(few) > LISTED_BLOCKS:
            return self.chunks.join(blocks, "block", "left_semi")
        return self.chunks.where(F.col("block").isin(few)) if few else self.chunks.where(F.lit(False))

    def rank(self, question: str, query_vector: Sequence[float] | None = None, top_k: int = rules.CANDIDATES,
             alias_rules: Q.AliasRules = rules.CHUNK_ALIASES) -> DataFrame:
        """``search.rank_chunks`` over the whole index."""
        bounds = persist_table(self.bounds(question, alias_rules), "bounds")
        if query_vector is not None:
            return self._rank_blended(bounds, question, query_vector, top_k, alias_rules)
        first = bounds.orderBy(F.desc("bound"), "block").limit(FIRST_BLOCKS).select("block")
        scores = [r[0] for r in search.rank_chunks(self.only(first), question, None, top_k, alias_rules).select("lexical_score").collect()]
        floor = scores[top_k - 1] if len(scores) >= top_k else 0.0
        able = bounds.where((F.col("bound") > 0) & (F.col("bound") >= floor - _ROUNDING)).select("block")
        return search.rank_chunks(self.only(able), question, None, top_k, alias_rules)

    def _rank_blended(self, bounds: DataFrame, question: str, query_vector: Sequence[float], top_k: int, alias_rules: Q.AliasRules) -> DataFrame:
        vectors = self.chunks.select("block", "chunk_id", F.coalesce(S.cosine(F.col("vector"), query_vector), F.lit(0.0)).alias("_sem"))
        limits = persist_table(vectors.join(bounds, "block", "left").select(
            "block", "chunk_id", S.blend(F.col("_sem"), F.coalesce("bound", F.lit(0.0))).alias("_most")), "limits")

        def exact(chosen: DataFrame) -> DataFrame:
            chunks = self.only(chosen.select("block").distinct()).join(chosen.select("chunk_id"), "chunk_id", "left_semi")
            return search.rank_chunks(chunks, question, query_vector, top_k, alias_rules)

        first = persist_table(limits.orderBy(F.desc("_most"), "chunk_id").limit(4 * top_k), "first")
        scores = [r[0] for r in exact(first).select("score").collect()]
        floor = scores[top_k - 1] if len(scores) >= top_k else 0.0
        return exact(limits.where((F.col("_most") > 0) & (F.col("_most") >= floor - _ROUNDING)))
