"""Token ids of whole texts by the tokenizers library, with what it gave for a word remembered.

White space always separates the tokenizer's own pieces, so the ids of a text are those of its words one after the other;
encoding a word once per task instead of once per occurrence gives the same ids many times faster. Texts for which that
can't be shown (odd white space for the byte-level vocabulary) are encoded whole. The memory of words is bounded.
"""

from __future__ import annotations

import os
import sys
from types import ModuleType

import numpy as np

WORDS_KEPT = 1_200_000
_STOPS = ".,;:!?"


def vocabulary(name: str) -> str:
    """The path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordEncoder:
    """Ids as little-endian 32-bit bytes. ``spaced``: whether a word's ids depend on the space before it (byte level)."""

    def __init__(self, path: str, spaced: bool, kept: int = WORDS_KEPT):
        self.tokenizer, self.spaced, self.kept, self.known = _tokenizer(path), spaced, kept, {}
        vocab = self.tokenizer.get_vocab()
        self.border = np.zeros(max(vocab.values()) + 1, bool)
        for token, i in vocab.items():
            self.border[i] = token.startswith("Ġ") if spaced else token.endswith("</w>")
        self.once = _tokenizer(path)  # for words, which it sees once: its own memory would only cost
        if hasattr(self.once.model, "_resize_cache"):
            self.once.model._resize_cache(0)
        self.stops = {c: self._whole(c) for c in _STOPS}
        self.line = self._whole("\n")
        # how the names of added tokens begin: a text with one in it is encoded whole, as such a name may be a token anywhere
        self.added = tuple({t.content[:2].lower() for t in self.tokenizer.get_added_tokens_decoder().values()})

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _pieces(self, text: str) -> list[str] | None:
        """Keys of ``known``. At byte level a word stands for a space and itself, after one line end for that line end
        and itself, after two for itself alone; None: white space runs or odd white space, encode the text whole."""
        if any(a in text or (a.upper() != a and a in text.lower()) for a in self.added):
            return None
        plain = text.replace("\n", " ")
        if not self.spaced:
            return plain.split(" ")
        if "  " in plain or not plain.isprintable():
            return None
        words = text.replace("\n", " \n").split(" ") if plain is not text else text.split(" ")
        words[0] = "\n\n" + words[0]
        return words

    def _learn(self, words: set[str]) -> None:
        if len(self.known) + len(words) > self.kept:
            self.known = {}
        known, stops, spaced = self.known, self.stops, self.spaced
        fold = not spaced
        new, other, later = {}, {}, []
        for word in words:
            if spaced and word[:1] == "\n":
                body = word[2:] if word[1:2] == "\n" else word[1:]
                stop = body[-1:] if body[-1:] in stops and body[:-1].isalpha() else ""
                base = "\n\n" + body[:len(body) - len(stop)]
                if base not in known:
                    other[base] = None
                if base != word:
                    later.append((word, base, b"" if word[1:2] == "\n" else self.line, stops[stop] if stop else b""))
                continue
            base = word[:-1] if word[-1:] in stops else word
            # lower case may add a mark to a letter, which the tokenizer would join with the stop
            if base.isalpha() and (spaced or base.isascii() or base.lower().isalpha()):
                key = base.lower() if fold and base.isascii() else base
                if key not in known:
                    new[key] = None
                if key != word:
                    later.append((word, key, b"", stops[word[-1]] if base is not word else b""))
            else:
                other[word] = None
        self._encode(list(new), list(other))
        for word, base, before, after in later:
            known[word] = before + known[base] + after

    def _encode(self, plain: list[str], other: list[str]) -> None:
        """Words in one go: those of letters cut where a token begins (or ends) a word. At byte level a token begins with each
        space and line ends stand alone, so all others come joined by these as well; without it they go one by one."""
        lines: list[str] = []
        if self.spaced:
            lines = [w for w in other if w[:2] == "\n\n" and len(w) > 2]
            plain = plain + [w for w in other if w and w[:1] != "\n"]
            other = [w for w in other if not w or w == "\n\n"]
        if plain:
            ids = self._ids((" " if self.spaced else "") + " ".join(plain))
            cuts = np.flatnonzero(self.border[ids])
            if len(cuts) == len(plain):
                self._keep(plain, ids, cuts if self.spaced else np.append(0, cuts[:-1] + 1), cuts[1:] if self.spaced else cuts[:-1] + 1)
            else:
                other = other + plain
        if lines:
            ids = self._ids("\n".join(w[2:] for w in lines))
            cuts = np.flatnonzero(ids == np.frombuffer(self.line, "<u4")[0])
            if len(cuts) == len(lines) - 1 and len(self.line) == 4:
                self._keep(lines, ids, np.append(0, cuts + 1), cuts)
            else:
                other = other + lines
        if other:
            texts = [w[2:] if w[:2] == "\n\n" else " " + w for w in other] if self.spaced else other
            for word, e in zip(other, self.once.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                self.known[word] = np.array(e.ids, "<u4").tobytes()

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.once.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _keep(self, words: list[str], ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """``ends``: of all words but the last, which goes to the end of ``ids``."""
        data = ids.tobytes()
        self.known.update(zip(words, [data[a:b] for a, b in zip((4 * starts).tolist(), [*(4 * ends).tolist(), len(data)], strict=True)], strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; a null text is empty."""
        cut = [self._pieces(t) if t else [] for t in texts]
        get = self.known.get
        found = [list(map(get, c)) if c is not None else [self._whole(t)] for c, t in zip(cut, texts, strict=True)]
        behind = [(values, c, [j for j, v in enumerate(values) if v is None]) for values, c in zip(found, cut, strict=True) if None in values]
        if behind:
            self._learn({c[j] for _, c, places in behind for j in places})  # what it forgets for them is in ``found``
            for values, c, places in behind:
                for j in places:
                    values[j] = self.known[c[j]]
        return [b"".join(values) for values in found]


def encoder(path: str, spaced: bool) -> WordEncoder:
    """One encoder per process, so that tasks that follow one another share what it remembers.

    Functions reach a worker by value, with globals of their own for each task; what is to outlive a task needs a place
    that the process has once.
    """
    kept = sys.modules.setdefault("_lorebase_kept", ModuleType("_lorebase_kept")).__dict__
    if (path, spaced) not in kept:
        kept[path, spaced] = WordEncoder(path, spaced)
    return kept[path, spaced]
