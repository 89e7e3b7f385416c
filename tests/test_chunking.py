"""Chunkers: worked examples, and properties that hold for any text."""

import random
import re

import pytest

from lorebase.functions import chunking as C

LIMIT, OVERLAP, SIZE = 1800, 220, 5000


def squeezed(text):
    return re.sub(r"\s+", "", text)


def texts(seed, count=40):
    """Paragraphs of many lengths, some longer than a window, with all kinds of breaks between them."""
    rng = random.Random(seed)
    for _ in range(count):
        paragraphs = ["".join(rng.choice("abcdé中 ") for _ in range(rng.choice((0, 3, 40, 700, 1799, 1801, 4000)))) for _ in range(rng.randrange(7))]
        yield rng.choice(("\n\n", "\n \t\n", "\r\n\r\n", "\n\n\n\n")).join(paragraphs)


@pytest.mark.parametrize("text, chunks", [
    ("", []),
    ("one", ["one"]),
    ("one\n\ntwo", ["one\n\ntwo"]),
    ("  one \n \n two  ", ["one\n\ntwo"]),
    ("a\r\n\r\nb\rc", ["a\n\nb\nc"]),
    ("a" * 1800, ["a" * 1800]),
    ("a" * 1801, ["a" * 1800, "a" * 221]),
    ("a" * 1000 + "\n\n" + "b" * 900, ["a" * 1000, "a" * 220 + "\n\n" + "b" * 900]),
    ("a" * 1000 + "\n\n" + "b" * 2000, ["b" * 1800, "a" * 1000 + "\n\n" + "b" * 420]),
])
def test_paragraph_examples(evaluate, text, chunks):
    assert evaluate(C.paragraph_chunks, text) == [chunks]


@pytest.mark.parametrize("text, chunks", [
    ("", []),
    ("x\n\n\n\ny", ["x\n\ny"]),
    ("a" * 5000, ["a" * 5000]),
    ("a" * 5001, ["a" * 5000, "a"]),
    ("a" * 3000 + "\n\n" + "b" * 3000, ["a" * 3000, "b" * 3000]),
    ("a" * 3000 + "\n" + "b" * 3000, ["a" * 3000, "b" * 3000]),
    ("a" * 2000 + "\n\n" + "b" * 4000, ["a" * 2000 + "\n\n" + "b" * 2998, "b" * 1002]),
    ("a" * 2600 + "\n\n" + "b" * 1000 + "\n" + "c" * 3000, ["a" * 2600, "b" * 1000 + "\n" + "c" * 3000]),
])
def test_export_examples(evaluate, text, chunks):
    assert evaluate(C.export_chunks, text) == [chunks]


def test_windows_fit_and_hold_every_character(evaluate):
    made = list(texts(1))
    for text, chunks in zip(made, evaluate(C.paragraph_chunks, *made), strict=True):
        assert all(0 < len(c) <= LIMIT + OVERLAP + 2 and c == c.strip() for c in chunks)
        assert set(squeezed(text)) == set(squeezed("".join(chunks)))
        assert len(squeezed("".join(chunks))) >= len(squeezed(text))


def test_windows_of_one_paragraph_share_the_overlap(evaluate):
    text = "".join(chr(97 + i % 26) + str(i) for i in range(4000))
    chunks = evaluate(C.paragraph_chunks, text)[0]
    assert chunks[0] == text[:LIMIT] and text.endswith(chunks[-1])
    for left, right in zip(chunks, chunks[1:]):
        assert left[-OVERLAP:] == right[:OVERLAP]
    assert chunks[0] + "".join(c[OVERLAP:] for c in chunks[1:]) == text


def test_exports_cut_at_breaks_and_restore_the_text(evaluate):
    made = [t for t in texts(2) if len(t) > SIZE]
    for text, chunks in zip(made, evaluate(C.export_chunks, *made), strict=True):
        assert squeezed("".join(chunks)) == squeezed(text) and all(0 < len(c) <= SIZE for c in chunks)
        plain = re.sub(r"\n{3,}", "\n\n", text.replace("\r\n", "\n").replace("\r", "\n")).strip()
        at = 0
        for chunk in chunks[:-1]:
            at = plain.index(chunk, at)
            end, after = at + len(chunk), plain[at + len(chunk):at + SIZE]
            assert plain[end:end + 1].isspace() or plain[end - 1].isspace() or len(chunk) == SIZE
            assert "\n\n" not in after.lstrip() or len(chunk) < SIZE
            at = end


def test_blocks_of_long_texts_change_nothing(evaluate, monkeypatch):
    made = [*texts(3), "x y" * 30000, ("z" * 1790 + " " * 900) * 30]
    whole = evaluate(C.paragraph_chunks, *made), evaluate(C.export_chunks, *made)
    monkeypatch.setattr(C, "BLOCK", 7000)
    assert (evaluate(C.paragraph_chunks, *made), evaluate(C.export_chunks, *made)) == whole
