"""Line diffs: patches must turn the old text into the new one, with context, order and moves as a plain walk finds them."""

import difflib
import random
import time
from collections import defaultdict

from lorebase.operators import linediff

SCHEMA = "key STRING, old_text STRING, text STRING"


def patched(old, hunks):
    """Applies hunks; checks every kept and removed line against the old text, and where the hunks claim to start."""
    out, at = [], 0
    for h in hunks:
        begin = h["old_start"] - (h["old_lines"] > 0)
        out += old[at:begin]
        at = begin
        assert h["new_start"] - (h["new_lines"] > 0) == len(out)
        for sign, text, _ in h["lines"]:
            if sign != "+":
                assert old[at] == text
                at += 1
            if sign != "-":
                out.append(text)
        assert h["old_lines"] == sum(x["sign"] != "+" for x in h["lines"]) and h["new_lines"] == sum(x["sign"] != "-" for x in h["lines"])
    return out + old[at:]


def test_patches_of_random_edits(spark):
    rng, rows = random.Random(6), []
    for i in range(150):
        kinds = rng.choice((2, 6, 1000))
        old = [f"line {rng.randrange(kinds)}" for _ in range(rng.randint(0, 40))]
        new = list(old)
        for _ in range(rng.randint(0, 5)):
            at = rng.randint(0, len(new))
            new[at:at + rng.randint(0, 3)] = [f"new {rng.randrange(kinds)}" for _ in range(rng.randint(0, 3))]
        rows.append((f"p{i}", "\n".join(old) + "\n" * (i % 2), "\r\n".join(new)))
    rows += [("none", None, None), ("from nothing", None, "a\nb"), ("to nothing", "a\nb", ""), ("same", "x\ny\n", "x\ny")]
    found = defaultdict(list)
    for r in linediff.line_hunks(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect():
        found[r["key"]].append(r)
    more = 0
    for key, old, new in rows:
        old, new, hunks = (old or "").splitlines(), (new or "").splitlines(), sorted(found[key], key=lambda r: r["hunk"])
        assert patched(old, hunks) == new, key
        assert [h["hunk"] for h in hunks] == list(range(1, len(hunks) + 1))
        changed = sum(x["sign"] != " " for h in hunks for x in h["lines"])
        plain = [x for x in list(difflib.unified_diff(old, new, n=0))[2:] if x[0] in "+-"]
        more += changed - len(plain)
        for h in hunks:  # three lines of context and not one more
            signs = "".join(x["sign"] for x in h["lines"])
            assert len(signs) - len(signs.lstrip(" ")) <= 3 and len(signs) - len(signs.rstrip(" ")) <= 3 and " " * 7 not in signs and signs.strip(" ")
    assert more <= 30


def test_moved_lines_and_heads(spark):
    old = [f"l{i}" for i in range(20)]
    new = old[:2] + old[3:12] + ["l2"] + old[12:]
    hunks = linediff.line_hunks(spark.createDataFrame([("a", "\n".join(old), "\n".join(new)), ("b", "", "one")], SCHEMA))
    moved = {(x["sign"], x["text"]): x["moved"] for r in hunks.where("key = 'a'").collect() for x in r["lines"] if x["sign"] != " "}
    assert moved == {("-", "l2"): 12, ("+", "l2"): 3}
    diffs = {r["key"]: r["diff"] for r in linediff.unified(hunks).collect()}
    assert diffs["a"] == list(difflib.unified_diff(old, new, "previous", "current", lineterm=""))
    assert diffs["b"] == ["--- previous", "+++ current", "@@ -0,0 +1 @@", "+one"]


def test_large_gaps_take_linear_time():
    n = 200_000
    old = list(range(n))
    new = old[:1000] + old[1500:150_000] + [-1] * 700 + old[150_000:]
    start = time.perf_counter()
    pairs = linediff.match_gap(old, new)
    assert len(pairs) == n - 500
    repeated = linediff.match_gap([i % 7 for i in range(n)], [i % 7 for i in range(3, n)])
    assert all(a < b and c < d for (a, c), (b, d) in zip(repeated, repeated[1:], strict=False))
    assert time.perf_counter() - start < 10
