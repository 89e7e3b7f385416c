"""Question analysis.

A question is an argument, not data: its terms and aliases are worked out once on the driver and become
literals of the scoring expression. ``terms_column`` is the same analysis for questions that sit in a table.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorebase import rules
from lorebase.functions.text import casefold

AliasRules = Sequence[tuple[tuple[tuple[str, ...], ...], str]]


def aliases(question: str, alias_rules: AliasRules = rules.CHUNK_ALIASES) -> list[str]:
    folded = question.casefold()
    return [
        text for groups, text in alias_rules if all(any(word in folded for word in group) for group in groups)
    ]


def _grams(letters: str, sizes: Sequence[int] = (2, 3, 4)) -> list[str]:
    return [letters[i : i + n] for n in sizes for i in range(len(letters) - n + 1)]


def question_terms(
    question: str,
    alias_rules: AliasRules = rules.CHUNK_ALIASES,
    stop_chars: str = rules.CHUNK_STOP_CHARS,
    keep_single: bool = False,
) -> list[str]:
    """Distinct search terms in order of first appearance.

    Latin terms first, then 2-, 3- and 4-grams of the Chinese characters left after the stop characters are
    gone; grams run across whatever stood between the characters. ``keep_single`` keeps a lone character.
    """
    text = " ".join([question, *aliases(question, alias_rules)])
    letters = "".join(c for c in text if "㐀" <= c <= "鿿" and c not in stop_chars)
    latin = [word.casefold() for word in re.findall(rules.LATIN_TERM, text)]
    grams = [letters] if keep_single and len(letters) == 1 else _grams(letters)
    return list(dict.fromkeys(latin + grams))


def page_question_terms(question: str, alias_rules: AliasRules = ()) -> list[str]:
    """Terms of the page ranker: no aliases unless given, a shorter stop list, single characters count."""
    return question_terms(question, alias_rules, rules.PAGE_STOP_CHARS, keep_single=True)


def word_tokens(text: str) -> list[str]:
    """Lower-case word tokens of the memory search; a Chinese run is one token."""
    return [token for token in re.split(r"\W+", text.lower()) if token]


def file_terms(request: str) -> list[str]:
    for phrase in rules.FILE_REQUEST_PHRASES:
        request = request.replace(phrase, " ")
    words = re.findall(r"[A-Za-z0-9一-鿿_.+-]{2,}", request)
    return [w.casefold() for w in words if w.casefold() not in rules.FILE_REQUEST_FILLERS]


def term_weight(term: str) -> float:
    if re.fullmatch(r"[㐀-鿿]+", term):
        return 0.45 + 0.25 * min(len(term), 4)
    return rules.SHORT_TERM_WEIGHT if len(term) <= 3 else rules.LONG_TERM_WEIGHT


def terms_column(text: Column, stop_chars: str = rules.CHUNK_STOP_CHARS, keep_single: bool = False) -> Column:
    """``question_terms`` without aliases for a text column."""
    latin = F.transform(F.regexp_extract_all(text, F.lit(rules.LATIN_TERM), F.lit(0)), casefold)
    letters = F.filter(
        F.regexp_extract_all(text, F.lit(rules.CJK), F.lit(0)), lambda c: ~F.contains(F.lit(stop_chars), c)
    )

    def grams(n: int) -> Column:
        starts = F.when(F.size(letters) >= n, F.sequence(F.lit(1), F.size(letters) - (n - 1))).otherwise(
            F.array().cast("array<int>")
        )
        return F.transform(starts, lambda i: F.array_join(F.slice(letters, i, n), ""))

    gram_terms = F.concat(grams(2), grams(3), grams(4))
    if keep_single:
        gram_terms = F.when(F.size(letters) == 1, letters).otherwise(gram_terms)
    return F.array_distinct(F.concat(latin, gram_terms))


def word_tokens_column(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"(?U)\W+"), lambda token: token != "")
