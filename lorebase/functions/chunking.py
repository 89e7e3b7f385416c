"""Chunkers as higher-order functions.

Both cut a text from the left, where each cut decides where the next one starts, so neither is a plain
``sequence``. They are folds. A fold that carried the rest of the text would copy it once per cut, which is
quadratic for long texts; the text is therefore fed in blocks and the fold carries at most one block.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorebase import rules
from lorebase.functions.text import bind, lstrip, normalise_export, normalise_newlines, strip

BLOCK = 65536
_NO_STRINGS = "array<string>"
_PARAGRAPHS = 256


def _blocks(text: Column) -> Column:
    return F.when(F.length(text) <= BLOCK, F.array(text)).otherwise(
        F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{BLOCK}}}"), F.lit(0))
    )


def _cut_from_left(text: Column, limit: int, shortest_step: int, cut: Callable[[Column], Column]) -> Column:
    """Cut while more than ``limit`` characters are left; returns struct(rest, pieces).

    ``cut`` maps what is left to struct(rest, piece) by looking at its first ``limit`` characters only, and drops at
    least ``shortest_step`` of them. ``text`` must be stripped.
    """

    def shorten(state: Column, _step: Column) -> Column:
        done = bind(cut(state["rest"]), lambda c: F.struct(
            c["rest"].alias("rest"), F.array_append(state["pieces"], c["piece"]).alias("pieces")
        ))
        return F.when(F.length(state["rest"]) > limit, done).otherwise(state)

    def take_block(state: Column, block: Column) -> Column:
        def cut_all(rest: Column) -> Column:
            start = F.struct(rest.alias("rest"), state["pieces"].alias("pieces"))
            steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.length(rest) / shortest_step).cast("int")))
            return F.when(F.length(rest) <= limit, start).otherwise(F.aggregate(steps, start, shorten))

        return bind(lstrip(F.concat(state["rest"], block)), cut_all)

    start = F.struct(F.lit("").alias("rest"), F.array().cast(_NO_STRINGS).alias("pieces"))
    return F.aggregate(_blocks(text), start, take_block)


def paragraph_chunks(text: Column, limit: int = rules.CHUNK_CHARS, overlap: int = rules.CHUNK_OVERLAP) -> Column:
    """Blank-line paragraphs packed into chunks of about ``limit`` characters.

    A paragraph over the limit is cut into windows that share ``overlap`` characters; those windows come out
    before whatever was still being packed. A full chunk hands its last ``overlap`` characters to the next one,
    which may then exceed the limit.
    """

    def window(rest: Column) -> Column:
        return F.struct(
            lstrip(F.substring(rest, limit - overlap + 1, BLOCK * 2)).alias("rest"), strip(F.substring(rest, 1, limit)).alias("piece")
        )

    def pack(state: Column, paragraph: Column) -> Column:
        cut = _cut_from_left(paragraph, limit, limit - overlap, window)
        return bind(cut, lambda c: _pack_one(state, c))

    def _pack_one(state: Column, cut: Column) -> Column:
        pending, rest = state["open"], cut["rest"]
        ready = F.concat(state["done"], cut["pieces"])
        joined = F.when(pending == "", rest).otherwise(strip(F.concat(pending, F.lit("\n\n"), rest)))
        carried = strip(F.concat(F.right(pending, F.lit(overlap)), F.lit("\n\n"), rest))
        return F.when(
            F.length(joined) <= limit, F.struct(joined.alias("open"), ready.alias("done"))
        ).otherwise(F.struct(carried.alias("open"), F.array_append(ready, pending).alias("done")))

    def take(state: Column, block: Column) -> Column:
        # chunks gather per block of paragraphs, so that no paragraph copies all chunks before it
        start = F.struct(state["open"].alias("open"), F.array().cast(_NO_STRINGS).alias("done"))
        return bind(F.aggregate(block, start, pack), lambda s: F.struct(
            s["open"].alias("open"), F.array_append(state["done"], s["done"]).alias("done")))

    def in_blocks(all_: Column) -> Column:
        last = F.floor((F.size(all_) - 1) / _PARAGRAPHS).cast("int")
        cut = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(all_, b * _PARAGRAPHS + 1, F.lit(_PARAGRAPHS)))
        return F.when(F.size(all_) > 0, cut).otherwise(F.array().cast("array<array<string>>"))

    paragraphs = F.filter(
        F.transform(F.split(normalise_newlines(text), rf"\n{rules.SPACE}*\n"), strip), lambda p: p != ""
    )
    start = F.struct(F.lit("").alias("open"), F.array().cast("array<array<string>>").alias("done"))
    return F.aggregate(
        bind(paragraphs, in_blocks), start, take,
        lambda s: F.flatten(F.when(s["open"] == "", s["done"]).otherwise(F.array_append(s["done"], F.array(s["open"])))),
    )


def export_chunks(text: Column, size: int = rules.EXPORT_CHARS) -> Column:
    """Pieces of at most ``size`` characters, cut at the last blank line of the window, else at its last line
    break, else hard; a break in the first half of the window does not count."""

    def last_at(backwards: Column, mark: str) -> Column:
        hit = F.instr(backwards, mark)
        return F.when(hit > 0, size - hit - (len(mark) - 1)).otherwise(F.lit(-1))

    def place(backwards: Column) -> Column:
        return F.coalesce(*[
            bind(last_at(backwards, mark), lambda at: F.when(at >= size // 2, at)) for mark in ("\n\n", "\n")
        ], F.lit(size))

    def cut(rest: Column) -> Column:
        return bind(bind(F.reverse(F.substring(rest, 1, size)), place), lambda at: F.struct(
            lstrip(F.substring(rest, at + 1, F.lit(BLOCK * 2))).alias("rest"), strip(F.substring(rest, F.lit(1), at)).alias("piece")
        ))

    whole = normalise_export(text)
    return bind(_cut_from_left(whole, size, size // 2, cut), lambda c: F.when(c["rest"] == "", c["pieces"]).otherwise(
        F.array_append(c["pieces"], c["rest"])
    ))
