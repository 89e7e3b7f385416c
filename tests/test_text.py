"""Text helpers against hand-computed values and against Python's own string methods."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from lorebase import rules
from lorebase.functions import text as T
from lorebase.functions import values as V


def test_white_space_is_pythons(evaluate):
    samples = ["  a\t\tb \n", "　x y ", "\x1c\x85 z  ", "", "plain", "a  b", "é é\r\né"]
    assert evaluate(T.strip, *samples) == [s.strip() for s in samples]
    assert evaluate(T.compact, *samples) == [" ".join(s.split()) for s in samples]


def test_random_white_space(evaluate):
    rng = random.Random(7)
    alphabet = rules.SPACE_CHARS + "abé中" * 6 + "  \n"
    samples = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(300)]
    assert evaluate(T.compact, *samples) == [" ".join(s.split()) for s in samples]
    assert evaluate(T.strip, *samples) == [s.strip() for s in samples]


def test_casefold(evaluate):
    samples = ["STRASSEß", "ΕΣ", "ſo", "ABC"]
    assert evaluate(T.casefold, *samples) == [s.casefold() for s in samples]


REDACTED = {
    'token = "24be64439e3e" end': "token=<redacted> end",
    "token based auth": "token <redacted> auth",
    "the tokens are new": "the tokens are new",
    "task-list risk-taking": "task-<redacted> risk-<redacted>",
    "密码：abc 之后": "密码<redacted> 之后",
    "API_KEY: x1": "API_KEY=<redacted>",
    "call 123456:ABCDEFGHIJKLMNOPQRSTUVWX now": "call <telegram-token-redacted> now",
    "nothing to hide": "nothing to hide",
    "Password hunter2": "Password <redacted>",
}


def test_redaction(evaluate):
    once = evaluate(T.redact, *REDACTED)
    assert once == list(REDACTED.values())
    assert evaluate(T.redact, *once) == once


def test_redaction_gate_is_exact(evaluate):
    """The cheap clue test never lets a text through that a rule would change."""
    rng = random.Random(3)
    words = ["api", "key", "apikey", "secret", "tok", "token", ":", "=", " ", "sk-", "1234567:", "A" * 22, "密码", "x", "API key", "-", "passwd"]
    samples = ["".join(rng.choice(words) for _ in range(rng.randrange(1, 9))) for _ in range(400)]
    assert evaluate(T.redact, *samples) == evaluate(lambda c: T.apply_rules(c, rules.INDEX_REDACTION), *samples)
    polled = evaluate(lambda c: T.redact(c, rules.POLLED_CHAT_REDACTION), *samples)
    assert polled == evaluate(lambda c: T.apply_rules(c, rules.POLLED_CHAT_REDACTION), *samples)


def test_polled_separator_class(evaluate):
    redact = lambda c: T.redact(c, rules.POLLED_CHAT_REDACTION)
    assert evaluate(redact, "app_secret=abcdefgh1", "app_secret abcdefgh1", "cli_abc", "bot12:xy") == [
        "app_secret=<redacted>", "app_secret abcdefgh1", "cli_<redacted>", "bot<redacted>"]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("tokens: =kapi\n密码1234567:A-"), max_size=40), min_size=1, max_size=10))
def test_redaction_is_idempotent(evaluate, samples):
    once = evaluate(T.redact, *samples)
    assert evaluate(T.redact, *once) == once


def test_slugs(evaluate):
    assert evaluate(T.slug_import, "  My Note: v2!! ", "---", "实验 A") == ["my-note-v2", "imported-note", "实验-a"]
    assert evaluate(T.slug_page, "!!") == ["untitled"]
    assert evaluate(T.slug_mail, "<b>Ann@Example.org", "") == ["ann@example.org", "unknown"]
    assert evaluate(T.safe_name, " A b/c ", "..") == ["A_b_c", "unknown"]
    assert evaluate(T.slug_topic, "Laser / 真空  (v1)", "??") == ["Laser _ 真空 (v1)", "general"]
    assert evaluate(lambda c: T.safe_filename(c, "file"), "a/b: c.txt", "", "x/ ..name. ") == ["b_ c.txt", "file", "name"]
    assert evaluate(T.suffix, "a/b.TXT", "noext", ".hidden", "a.tar.gz") == [".txt", "", "", ".gz"]
    assert evaluate(T.stem, "a/b.TXT", ".hidden") == ["b", ".hidden"]


def test_replies_and_quotes(evaluate):
    assert evaluate(lambda c: T.split_reply(c, 3), "abcdefg", "") == [["abc", "def", "g"], [""]]
    assert evaluate(T.escape_html, "<a href='x'>\"&\"</a>") == ["&lt;a href=&#x27;x&#x27;&gt;&quot;&amp;&quot;&lt;/a&gt;"]
    assert evaluate(T.url_path_quote, "a b/ü#%.html") == ["a%20b/%C3%BC#%.html"]


def test_times(evaluate):
    assert evaluate(V.epoch_iso, "1700000000", "1700000000123", "x", "") == ["2023-11-14T22:13:20Z"] * 2 + ["", ""]
    assert evaluate(lambda c: V.iso(V.mail_time(c)), "Tue, 14 Nov 2023 22:13:20 +0000", "14 Nov 2023 22:13:20 +0100 (CET)", "soon") == [
        "2023-11-14T22:13:20Z", "2023-11-14T21:13:20Z", None]
    assert evaluate(V.date_prefix, "2026-06-11T10:00", "June") == ["2026-06-11", ""]


def test_addresses(evaluate):
    samples = ['"Doe, Jane" <Jane@Example.org>, b@x.org', "plain@Example.org", "Name Only", "", '"Only, Quoted"', "A <a@b.c>"]
    assert evaluate(V.first_address, *samples) == ["jane@example.org", "plain@example.org", "name only", "", "only, quoted", "a@b.c"]
