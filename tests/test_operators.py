"""Distillation, snapshots, gates, topics, budgets, feeds, and ordered work in hot groups."""

import random

import pytest
from pyspark.sql import functions as F

from lorebase import rules, session
from lorebase.functions import distill as D
from lorebase.functions import intent as I
from lorebase.operators import digest, distill, grouping, messages, noise, publish, snapshots, topics


# --- ordered work in hot groups -------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def hot(spark):
    """Key 0 holds two thirds of the rows."""
    rng = random.Random(5)
    rows = [(0 if rng.random() < 0.66 else rng.randrange(1, 6), i, rng.randrange(1, 50), rng.choice(["on", "off", None, None, None])) for i in range(3000)]
    return rows, spark.createDataFrame(rows, "k INT, n BIGINT, v BIGINT, c STRING")


def test_prefix_sums_of_a_hot_key(hot):
    rows, df = hot
    got = {r["n"]: r["p"] for r in grouping.with_prefix(df, ["k"], ["n"], F.floor(F.col("n") / 100), F.col("v"), "p").collect()}
    sums, want = {}, {}
    for k, n, v, _ in rows:
        want[n] = sums.get(k, 0)
        sums[k] = want[n] + v
    assert got == want


def test_last_known_of_a_hot_key(hot):
    rows, df = hot
    got = {r["n"]: r["l"] for r in grouping.with_last_known(df, ["k"], ["n"], F.floor(F.col("n") / 64), F.col("c"), "l").collect()}
    last, want = {}, {}
    for k, n, _, c in rows:
        last[k] = c or last.get(k)
        want[n] = last[k]
    assert got == want


def test_first_and_last_per_key(hot):
    rows, df = hot
    first = {r["k"]: r["n"] for r in grouping.first_per_key(df, ["k"], ["n"]).collect()}
    last = {r["k"]: r["n"] for r in grouping.last_per_key(df, ["k"], ["n"]).collect()}
    assert first == {k: min(n for kk, n, *_ in rows if kk == k) for k in {r[0] for r in rows}}
    assert last == {k: max(n for kk, n, *_ in rows if kk == k) for k in {r[0] for r in rows}}


def test_top_per_key_limits_before_the_shuffle(hot):
    _, df = hot
    top = grouping.top_per_key(df, ["k"], [F.desc("v"), F.asc("n")], 3)
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()
    assert {r["k"]: 0 for r in top.collect()}.keys() == {0, 1, 2, 3, 4, 5}


def test_late_rows(spark):
    rng = random.Random(9)
    rows = [(i, i * 10 - rng.randrange(0, 200)) for i in range(500)]
    df = spark.createDataFrame(rows, "a BIGINT, e BIGINT")
    got = {r["a"]: r["latest_before"] for r in messages.late_rows(df.repartition(7), "a", "e").collect()}
    top, want = None, {}
    for a, e in rows:
        if top is not None and e < top:
            want[a] = top
        top = e if top is None else max(top, e)
    assert got == want


# --- distillation ---------------------------------------------------------------------------------------------
def test_sentences_and_facts(evaluate):
    text = "Short. The cavity linewidth is 5 MHz today. 下一步需要联系厂家确认价格。 结果 were stable over the whole week.\nNo number here at all, friend"
    sentences = evaluate(D.sentences, text)[0]
    assert sentences == ["The cavity linewidth is 5 MHz today.", "下一步需要联系厂家确认价格。", "结果 were stable over the whole week.", "No number here at all, friend"]
    facts = evaluate(lambda c: D.important_facts(D.sentences(c)), text)[0]
    assert facts == [sentences[0], sentences[2], sentences[3]]
    assert evaluate(lambda c: D.next_steps(D.sentences(c)), text)[0] == [sentences[1]]


def test_fact_units_are_not_anchored(evaluate):
    assert evaluate(lambda c: D.fact_points(c), "5 meters", "5  m", "on 2026-01-02", "5/6/2026 ok") == [3, 0, 3, 3]


def test_tags_in_dictionary_order(evaluate):
    assert evaluate(lambda c: D.keyword_tags(c), "Vacuum and DDS; 真空", "nothing") == [["DDS", "vacuum", "真空"], []]


def test_section_rollup(spark):
    pages = spark.createDataFrame([(1, "s", "A", "The laser ran at 5 mW for hours."), (2, "s", "B", "A laser and a cavity were bought today."), (3, "t", "C", "")],
                                  "ordinal BIGINT, section STRING, title STRING, text STRING")
    rolled = {r["section"]: r for r in distill.section_rollup(distill.distill_pages(pages)).collect()}
    assert rolled["s"]["summary"] == "s contains 2 pages. Main tags: laser, cavity."
    assert rolled["s"]["highlight_facts"] == ["The laser ran at 5 mW for hours.", "A laser and a cavity were bought today."]
    assert rolled["t"]["summary"] == "t contains 1 pages. Main tags: none detected."


# --- snapshots ----------------------------------------------------------------------------------------------------
def test_diff(spark):
    old = spark.createDataFrame([("A", "1"), ("B", "1"), ("C", "1")], "key STRING, sha256 STRING")
    new = spark.createDataFrame([("A", "1"), ("B", "2"), ("D", "1")], "key STRING, sha256 STRING")
    assert {(r["key"], r["type"]) for r in snapshots.diff_snapshots(old, new).collect()} == {("B", "modified"), ("D", "added"), ("C", "removed")}
    back = {(r["key"], r["type"]) for r in snapshots.diff_snapshots(new, old).collect()}
    assert back == {("B", "modified"), ("D", "removed"), ("C", "added")}


def test_change_records_carry_diffs(spark):
    schema = "key STRING, sha256 STRING, section STRING, title STRING, html STRING, created STRING, updated STRING, text STRING"
    old = spark.createDataFrame([("B", "1", "s", "t", "b.html", "", "", "one\ntwo"), ("C", "1", "s", "u", "c.html", "", "", "gone")], schema)
    new = spark.createDataFrame([("B", "2", "s", "t", "b.html", "", "", "one\n2"), ("D", "1", "s", "n", "d.html", "", "", "new  page")], schema)
    records = {r["key"]: r for r in snapshots.change_records(snapshots.diff_snapshots(old, new), old, new, "now").collect()}
    assert records["B"]["diff"] == ["--- previous", "+++ current", "@@ -1,2 +1,2 @@", " one", "-two", "+2"]
    assert records["D"]["diff"] == ["--- previous", "+++ current", "@@ added page @@", "new  page"]
    assert (records["D"]["text_preview"], records["C"]["title"], records["C"]["current_sha256"]) == ("new page", "u", "")
    cut = snapshots.change_records(snapshots.diff_snapshots(old, new), old, new, "now", 2).filter("key = 'B'").collect()[0]["diff"]
    assert cut == ["--- previous", "+++ current", "... diff truncated, 4 lines omitted ..."]


def test_upsert_on_either_key(spark):
    schema = "ordinal BIGINT, html STRING, source_sha256 STRING"
    old = spark.createDataFrame([(1, "h1", "s1"), (2, "h2", "s2")], schema)
    merged = snapshots.upsert_pages(old, spark.createDataFrame([(10, "h3", "s2"), (11, "h9", "s9")], schema))
    assert {(r["ordinal"], r["html"], r["origin"]) for r in merged.collect()} == {(1, "h1", "kept"), (2, "h3", "replaced"), (11, "h9", "appended")}


def test_upsert_follows_the_order_of_new_pages(spark):
    """No new page is lost when another one matches the page it had matched, against the plain sequential rule."""

    schema, rng = "ordinal BIGINT, html STRING, source_sha256 STRING", random.Random(4)
    cases = [([(1, "p/1", "h1")], [(101, "p/1", "hNEW"), (102, "moved/1", "h1")])]
    for _ in range(6):
        row = lambda i: (i, f"p/{rng.randrange(8)}", rng.choice([None, *(f"h{n}" for n in range(6))]))
        cases.append(([(i, f"p/{i}", row(i)[2]) for i in range(6)], [row(100 + i) for i in range(rng.randrange(9))]))
    copies = [(100 + i, f"own/{i}" if rng.random() < 0.8 else f"p/{i % 3}", "h0" if rng.random() < 0.9 else "h1") for i in range(60)]
    cases.append(([(i, f"p/{i}", f"h{i % 3}") for i in range(6)], copies))
    for old, new in cases:
        slots = [[o, h, s, "kept"] for o, h, s in old]
        for o, h, s in new:
            hit = next((x for x in slots if x[1] == h or x[2] is not None and x[2] == s), None)
            if hit:
                hit[1:] = h, s, "appended" if hit[3] == "appended" else "replaced"
            else:
                slots.append([o, h, s, "appended"])
        merged = snapshots.upsert_pages(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema))
        assert sorted(map(tuple, merged.select("ordinal", "html", "source_sha256", "origin").collect()), key=str) == sorted(map(tuple, slots), key=str)


def test_page_keys(spark):
    pages = spark.createDataFrame([("id", "h", "s", "t", 1, "x"), ("id", "h2", "s", "t", 2, "y"), ("", "", "s", "t", 3, "z")],
                                  "onenote_page_id STRING, html STRING, section STRING, title STRING, at INT, sha STRING")
    assert {(r["key"], r["sha"]) for r in snapshots.keyed_pages(pages, "at").collect()} == {("id", "y"), ("s/t", "z")}


# --- gates --------------------------------------------------------------------------------------------------------
def test_index_gate_quirk(evaluate):
    assert evaluate(noise.is_index_noise, "verification code 1234", "login code 1234", "newsletter", "laser newsletter") == [False, True, True, False]
    strict = lambda c: noise.is_index_noise(c, word_boundary=True)
    assert evaluate(strict, "verification code 1234") == [True]


def test_digest_gate(evaluate):
    got = evaluate(noise.digest_noise_reason, "Your verification code for the laser order", "newsletter: laser sale", "newsletter: shoes", "hello")
    assert got == [rules.OTP_REASON, "", rules.AD_REASON, ""]


def test_gate_keeps_everything_and_fails_open(spark):
    records = spark.createDataFrame([("1", "big sale today"), ("2", "sale of chairs"), ("3", "promo code inside"), ("4", "meeting")], "id STRING, text STRING")
    decisions = spark.createDataFrame([("1", False, "spam"), ("4", False, "not asked")], "id STRING, keep BOOLEAN, reason STRING")
    gated = {r["id"]: (r["kept"], r["reason"]) for r in noise.gate_records(records, decisions, "id").collect()}
    assert gated == {"1": (False, "spam"), "2": (True, ""), "3": (False, rules.AD_REASON), "4": (True, "")}
    twice = spark.createDataFrame([("1", True, "fine"), ("1", False, "spam"), ("1", True, "fine")], "id STRING, keep BOOLEAN, reason STRING")
    assert [(r["kept"], r["reason"]) for r in noise.gate_records(records, twice, "id").filter("id = '1'").collect()] == [(False, "spam")]


def test_every_record_gets_a_group(spark):
    records = spark.createDataFrame([("1",), ("2",), ("3",)], "record_id STRING")
    groups = spark.createDataFrame([("1", "X", "t"), ("9", "X", "t"), ("2", "Nope", " ")], "record_id STRING, section STRING, topic_title STRING")
    sections = spark.createDataFrame([("X",), ("Email Records",)], "section STRING")
    got = {(r["record_id"], r["section"], r["topic_title"], r["origin"]) for r in topics.cover_records(groups, records, sections, "email", "2026-06-12").collect()}
    unsorted = rules.UNSORTED_SECTION
    assert got == {("1", "X", "t", "group"), ("2", unsorted, "email supplement", "group"), ("3", unsorted, "Email supplement 2026-06-12", "fallback")}


def test_publish_gate(spark):
    files = spark.createDataFrame(
        [("Key/a", 1, "", False), ("cfg/x", 1, "", False), ("cfg/ok", 1, "", False), ("a.bin", 1, "password = 'longenough'", True),
         ("a.py", 1, "password = 'longenough'", False), ("b.py", 20_000_000, "", False), ("c.onepkg", 1, "", False)],
        "path STRING, size BIGINT, text STRING, binary BOOLEAN")
    got = {r["path"]: r["problem"] for r in publish.publish_verdict(files, (), ("Key/",), ("cfg/",), ("cfg/ok",)).collect()}
    assert got == {"Key/a": "private path", "cfg/x": "private path", "cfg/ok": "", "a.bin": "", "a.py": "possible embedded credential",
                   "b.py": "file exceeds the size limit", "c.onepkg": "private path"}


# --- budgets, digests --------------------------------------------------------------------------------------------
def test_budget(spark):
    df = spark.createDataFrame([(1, 1, "a" * 50), (1, 2, "b" * 60), (1, 3, "c" * 40)], "k INT, n INT, t STRING")
    got = digest.within_budget(df, ["k"], ["n"], F.lit(0), F.lit(""), F.col("t"), 100).orderBy("n").collect()
    assert [r["block"] for r in got] == ["a" * 50, "b" * 50]
    chat = digest.within_budget(df, ["k"], ["n"], F.lit(0), F.lit("[h]"), F.col("t"), 54).orderBy("n").collect()
    mail = digest.within_budget(df, ["k"], ["n"], F.lit(0), F.lit("[h]"), F.col("t"), 54, cut_header=True).orderBy("n").collect()
    assert [r["block"] for r in chat] == ["[h]" + "a" * 50, "[h]b"]
    assert [r["block"] for r in mail] == ["[h]" + "a" * 50, "["]


def test_entry_violations(spark):
    df = spark.createDataFrame([("good-id", "t", "idea", "draft", "2026-01-01", ["r"], "low", "s"), ("X", "", "odd", "odd", "1", [], "sure", "")],
                               "id STRING, title STRING, type STRING, status STRING, date STRING, source_refs ARRAY<STRING>, confidence STRING, summary STRING")
    got = [r[0] for r in digest.entry_violations(df).select("violations").collect()]
    assert got == [[], ["id", "title", "type", "status", "date", "source_refs", "confidence", "summary"]]


def test_day_page_reads_in_order(spark):
    df = spark.createDataFrame([("d", "bob", 2, "<b>"), ("d", "ann", 1, "x"), ("d", "bob", 1, "y")], "d STRING, p STRING, n BIGINT, t STRING")
    page = digest.day_page(df, F.col("d"), F.col("p"), F.col("n"), digest.record_fragment(F.col("p"), F.lit("chat"), F.col("t")), "Records")
    html = "".join(r["html"] for r in page.orderBy("day", "person", "part", "at").collect())
    assert html.index("<h2>ann") < html.index("<h2>bob") < html.index("<p>y</p>") < html.index("<p>&lt;b&gt;</p>")
    assert html.startswith("<!DOCTYPE html>") and html.endswith("</section></body></html>")


# --- feeds ----------------------------------------------------------------------------------------------------------
def test_last_turns_then_age(spark):
    df = spark.createDataFrame([(1, n, 5000 if n in (5, 6) else 10) for n in range(1, 9)], "c INT, n INT, age INT")
    got = messages.recent_turns(df, "c", "n", F.col("age")).collect()
    assert sorted(r["n"] for r in got) == [3, 4, 7, 8]


def test_dedupe(spark):
    df = spark.createDataFrame([("1", 1, "text"), ("2", 2, "text"), ("2", 3, "text"), ("3", 4, "text"), ("3", 5, "text"), ("4", 6, "SYSTEM")], "id STRING, at INT, msg_type STRING")
    seen = spark.createDataFrame([("2",)], "id STRING")
    assert {(r["id"], r["at"]) for r in messages.new_messages(df, seen, "id", ["at"]).collect()} == {("1", 1), ("3", 4)}


def test_commands(evaluate):
    parse = lambda channel: lambda c: I.parse_command(c, channel)
    texts = ["/ask  why ", "/NOTE x", "开始记", "查 腔长", "记：调好了", "帮我记一下 买螺丝", "谢谢！", "怎么用", "把 123456789 加入白名单", "remember the tape", "hello there", "/start", "记得吗"]
    push = [tuple(r) for r in evaluate(parse("telegram"), *texts)]
    assert push == [("ask", "why"), ("note", "x"), ("record_on", ""), ("ask", "腔长"), ("note", "调好了"), ("note", "买螺丝"), ("chat", "谢谢！"), ("help", ""),
                    ("allow", "123456789"), ("note", "the tape"), ("agent", "hello there"), ("start", ""), ("agent", "记得吗")]
    polled = [tuple(r) for r in evaluate(parse("lark"), *texts)]
    assert polled[2] == ("agent", "开始记") and polled[6] == ("chat", "谢谢！") and polled[11] == ("agent", "/start")


def test_follow_ups(evaluate):
    assert evaluate(I.is_follow_up, "那呢", "what about the other cavity and all of its mirrors", "a completely new and long question about lasers", "", "这个腔的具体参数到底是怎么测出来的") == [
        True, True, False, False, True]


def test_message_text(spark):
    rows = [
        ("text", '{"text":"@_user_1 hi  there"}', [("@_user_1", "b", "open_id", "Bot")]),
        ("post", '{"title":"T","content":[[{"tag":"text","text":"one"},{"tag":"a","text":"two \\"q\\"","href":"u"}]]}', None),
        ("file", '{"file_key":"k","file_name":"f.pdf"}', None),
        ("share", '{"x":{"name":"N","deep":{"url":"U"}}}', None),
    ]
    df = spark.createDataFrame(rows, "t STRING, c STRING, m ARRAY<STRUCT<key STRING, id STRING, id_type STRING, name STRING>>")
    got = [r[0] for r in df.select(I.message_text(F.col("c"), F.col("t"), F.col("m"))).collect()]
    assert got == ["hi there", 'T\none\ntwo "q"', "f.pdf", "N\nU"]
    items = [r[0] for r in df.select(I.file_items(F.col("c"), F.col("t"), F.lit("m1"))).collect()]
    assert [len(i) for i in items] == [0, 0, 1, 0] and items[2][0]["file_name"] == "f.pdf"


def test_sessions(spark):
    rng = random.Random(2)
    minute = 60 * 1_000_000
    rows, at = [], 0
    for _ in range(400):
        at += rng.choice([1, 5, 29 * 60, 30 * 60, 31 * 60, 7200]) * 1_000_000
        rows.append((1, at))
    want, start, last, count = [], None, None, 0
    for _, t in rows:
        if last is not None and t - last < 30 * minute:
            last, count = t, count + 1
            continue
        if last is not None:
            want.append((start, last + 30 * minute, count))
        start, last, count = t, t, 1
    want.append((start, last + 30 * minute, count))
    df = spark.createDataFrame(rows, "c INT, at BIGINT")
    got = messages.sessions(df, "c", F.col("at")).collect()
    assert sorted((r["started"], r["ended"], r["messages"]) for r in got) == want


@pytest.fixture
def apart(spark):
    """Small partitions stay apart, as large ones would."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_late_rows_have_no_single_partition(spark, apart):

    rng = random.Random(8)
    rows = [(a, rng.choice([None, a - rng.randrange(9), a]), "x") for a in range(2000)]
    late = messages.late_rows(spark.createDataFrame(rows, "a INT, e LONG, more STRING").repartition(6), "a", "e")
    assert "SinglePartition" not in plan_of(late)
    top, want = None, {}
    for a, e, _ in rows:
        if e is not None and top is not None and e < top:
            want[a] = top
        top = max((t for t in (top, e) if t is not None), default=None)
    assert {r["a"]: r["latest_before"] for r in late.collect()} == want and len(want) > 200
    assert messages.late_rows(spark.createDataFrame([], "a INT, e LONG"), "a", "e").collect() == []


def test_budgets_do_not_shuffle_texts(spark):
    rows = [(k, n, "t" * (20 + n)) for k in ("a", "b") for n in range(300)]
    df = spark.createDataFrame(rows, "k STRING, n INT, t STRING").repartition(5)
    df.write.mode("overwrite").parquet(f"{session.shared_folder(spark)}/budget-texts")
    df = spark.read.parquet(f"{session.shared_folder(spark)}/budget-texts")
    for got in (digest.within_budget(df, ["k"], ["n"], F.floor(F.col("n") / 10), F.lit(""), F.col("t"), 1000),
                digest.doc_budget(df, ["k"], ["n"], F.floor(F.col("n") / 10), F.col("t"), F.lit(False), 50, 1000)):
        assert "Exchange hashpartitioning" not in plan_of(got) and "BroadcastExchange" in plan_of(got)
        assert got.groupBy("k").count().collect()[0]["count"] == sum(20 * n + n * (n - 1) // 2 < 1000 for n in range(300))


def test_numbers_by_range(spark, apart):
    """One key holds nearly all rows; its ranges are numbered on."""
    rows = [(None if i % 50 == 0 else "big" if i % 10 else f"k{i}", f"{i % 3000:05d}", i) for i in range(9000)]
    df = spark.createDataFrame(rows, "k STRING, name STRING, i INT").repartition(6)
    numbered = grouping.numbered_by_range(df, ["k"], ["name", "i"], "nth")
    want, seen = {}, {}
    for k, name, i in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        seen[k] = seen.get(k, 0) + 1
        want[i] = seen[k]
    assert {r["i"]: r["nth"] for r in numbered.collect()} == want
    plan = plan_of(df.repartitionByRange("k", "name", "i").withColumn("part", F.spark_partition_id()))
    assert "rangepartitioning" in plan and len({r[0] for r in df.repartitionByRange("k", "name", "i").where("k = 'big'").select(F.spark_partition_id()).collect()}) > 1
