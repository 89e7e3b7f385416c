"""Whole jobs and streams over several batches."""

import json
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lorebase import rules, schemas
from lorebase.plans import ask, build_index, day_digest, nightly, tables, versions
from lorebase.operators import digest
from lorebase.providers.offline import OfflineProvider
from lorebase.session import shared_folder
from lorebase.streaming import feeds
from tests.test_sources import tree, write  # noqa: F401
from lorebase.sources import files


def sources(spark, texts):
    rows = [(i, f"s{i}", "note", "Lasers", f"Note {i}", f"p{i}", t, "2026-06-11", "ann", {"kind": "note"}) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, schemas.SOURCE_DOC)


TEXTS = ["The cavity finesse was measured to be 20000 with the new mirrors.", "Vacuum chamber bakeout ran for three days at 120 C in total.",
         "Bought two workstations for the control room of the laboratory.", "tiny"]


def test_index_reuse_and_ask(spark, tmp_path):
    provider, path = OfflineProvider(), str(tmp_path / "index")
    first = build_index.build_index(spark, sources(spark, TEXTS), path, "v1", provider).collect()[0]
    assert (first["chunk_count"], first["chunks_with_vectors"], first["reused_vectors"], first["embedded_chunks"]) == (3, 3, 0, 3)
    again = build_index.build_index(spark, sources(spark, TEXTS), path, "v2", provider, "v1").collect()[0]
    assert (again["reused_vectors"], again["embedded_chunks"]) == (3, 0)
    changed = build_index.build_index(spark, sources(spark, TEXTS[:2] + ["Sold one workstation of the laboratory again."]), path, "v3", provider, "v2").collect()[0]
    assert (changed["reused_vectors"], changed["embedded_chunks"]) == (2, 1)
    forced = build_index.build_index(spark, sources(spark, TEXTS), path, "v4", provider, "v3", force=True).collect()[0]
    assert forced["reused_vectors"] == 0
    other = build_index.build_index(spark, sources(spark, TEXTS), path, "v5", OfflineProvider(model="other"), "v4").collect()[0]
    assert other["reused_vectors"] == 0
    plain = build_index.build_index(spark, sources(spark, TEXTS), path, "v6").collect()[0]
    assert plain["chunks_with_vectors"] == 0

    index = build_index.read_index(spark, f"{path}/v2")
    answer = ask.ask(index, "What finesse does the cavity have?", provider)
    assert answer.likely_done_before == "yes" and answer.evidence[0]["title"] == "Note 0"
    assert "Note 0" in ask.render(answer)
    assert ask.ask(index, "What finesse does the cavity have?", OfflineProvider(threshold=2.0)).answer == rules.UNKNOWN_ANSWER
    assert ask.ask(build_index.read_index(spark, f"{path}/none"), "anything", provider).evidence == []


class Broken(OfflineProvider):
    def embed(self, texts):
        raise TimeoutError("no service")


def test_lexical_when_the_service_fails(spark, tmp_path):
    index = build_index.indexed_chunks(sources(spark, TEXTS), None, None)
    answer = ask.ask(index, "cavity finesse", Broken())
    assert answer.error == "TimeoutError: no service" and answer.evidence[0]["title"] == "Note 0"


def test_nightly(spark, tree, tmp_path):  # noqa: F811
    files.tree_manifest(files.read_html_tree(spark, str(tree))).write.parquet(str(tmp_path / "manifest"))
    manifest = spark.read.parquet(str(tmp_path / "manifest"))  # the files change below
    empty = nightly.read_state(spark, str(tmp_path / "state0"))
    first = nightly.nightly(manifest, empty, "t1")
    assert first.counts.collect()[0].asDict() == {"added": 4, "modified": 0, "removed": 0}
    assert {r["title"] for r in first.distilled.collect()} == {"b", "Page A", "Y", "Z"}
    first.state.write.parquet(str(tmp_path / "state1"))
    write(tree / "Lasers" / "a.html", "<html><head><title>Page A</title><meta name='X-Original-Page-Id' content='ida'></head><body>The laser now runs at 399 nm.</body></html>")
    write(tree / "Other" / "new.html", "<title>N</title><body>n</body>")
    later = files.tree_manifest(files.read_html_tree(spark, str(tree)).filter(F.col("rel") != "Other/z.html"))
    second = nightly.nightly(later, nightly.read_state(spark, str(tmp_path / "state1")), "t2")
    assert second.counts.collect()[0].asDict() == {"added": 1, "modified": 1, "removed": 1}
    modified = second.changes.filter("type = 'modified'").collect()[0]
    assert modified["key"] == "ida" and modified["diff"][-1] == "+Page AThe laser now runs at 399 nm."
    assert {r["title"] for r in second.distilled.collect()} == {"Page A", "N"}
    assert nightly.merge_tree(later, manifest).collect()[0].asDict() == {"added_pages": 1, "updated_pages": 1, "duplicate_pages": 2}


def test_nightly_twice_changes_nothing(spark, tree, tmp_path):  # noqa: F811
    files.tree_manifest(files.read_html_tree(spark, str(tree))).write.parquet(str(tmp_path / "manifest"))
    manifest, path = spark.read.parquet(str(tmp_path / "manifest")), str(tmp_path / "tables")
    assert nightly.run_nightly(spark, manifest, path, "t1") == {"changes": 0, "distilled": 0, "state": 0}
    assert nightly.run_nightly(spark, manifest, path, "t2") == {"changes": 0, "distilled": 0, "state": 0}
    fewer = manifest.where("title <> 'Z'")
    assert nightly.run_nightly(spark, fewer, path, "t3") == {"changes": 1, "distilled": 1, "state": 1}
    found = nightly.notebook_tables(spark, path)
    assert {r["title"] for r in found["state"].read(0).collect()} - {r["title"] for r in found["distilled"].read().collect()} == {"Z"}
    assert Counter(r["type"] for r in found["changes"].read().collect()) == {"added": 4, "removed": 1}


def test_versions(spark, tmp_path, monkeypatch):
    """Only touched buckets are written; a failed write leaves the old version; pinned readers keep theirs; nulls are values."""
    table = versions.VersionedTable(spark, str(tmp_path / "t"), "k STRING, v LONG, seen STRING", ["k"], buckets=8, ignore=["seen"])
    frame = lambda rows: spark.createDataFrame(rows, "k STRING, v LONG, seen STRING")
    content = lambda df: {(r["k"], r["v"], r["seen"]) for r in df.collect()}
    assert table.version() is None and content(table.read()) == set()
    start = [(f"k{i}", i, "a") for i in range(40)] + [(None, None, "a")]
    assert table.write(frame(start)) == 0
    pinned = table.read()
    assert table.write(frame([("k1", 1, "b"), (None, None, "b")])) == 0  # only the ignored column differs
    assert table.write(frame([("k1", None, "b"), ("new", 5, "b")]), frame([("k7", 0, ""), ("never", 0, "")])) == 1
    after = {r for r in {(k, v, s) for k, v, s in start} if r[0] not in ("k1", "k7")} | {("k1", None, "b"), ("new", 5, "b")}
    assert content(table.read()) == after and content(pinned) == content(table.read(0)) == set(start)
    assert 1 <= len([d for d in os.listdir(tmp_path / "t" / "data" / "v=1") if d.startswith("bucket=")]) <= 3
    with monkeypatch.context() as broken:
        broken.setattr(spark, "createDataFrame", lambda *a, **b: (_ for _ in ()).throw(OSError("killed before the commit")))
        with pytest.raises(OSError):
            table.write(pinned.limit(3).withColumn("v", F.lit(99)))
    assert table.version() == 1 and content(table.read()) == after
    assert table.write(frame([("k2", 77, "c")])) == 2 and ("k2", 77, "c") in content(table.read())
    everyone = table.read()
    assert table.write(frame([]), everyone) == 3 and content(table.read()) == set() and content(table.read(2)) == content(everyone)


def test_sync_notes_what_came(spark, tmp_path):
    synced = versions.VersionedTable(spark, str(tmp_path / "s"), "id STRING, modified STRING", ["id"], buckets=4)
    remote = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "id STRING, modified STRING")
    asked = []

    def fetch(stale):
        asked.append(sorted(r["id"] for r in stale.collect()))
        return stale.select("id", F.when(F.col("id") != "b", F.lit("page")).alias("content"))

    nightly.sync_pages(remote, fetch, synced)
    nightly.sync_pages(remote, fetch, synced)
    nightly.sync_pages(remote.withColumn("modified", F.when(F.col("id") == "c", "2").otherwise(F.col("modified"))), fetch, synced)
    assert asked == [["a", "b", "c"], ["b"], ["b", "c"]]


def test_entries_are_rebuilt(spark, tmp_path):
    write(tmp_path / "e" / "one.md", "---\nid: one\ntitle: One\n---\ntext")
    write(tmp_path / "e" / "two.md", "---\nid: two\n---\ntext")
    build = lambda: nightly.rebuild_entries(spark, str(tmp_path / "e" / "*.md"), str(tmp_path / "t"))
    assert (build(), build()) == (0, 0)
    os.remove(tmp_path / "e" / "two.md")
    write(tmp_path / "e" / "three.md", "---\nid: three\n---\ntext")
    assert build() == 1


def test_day_digest(spark):
    records = spark.createDataFrame([(1, "note", "laser order"), (2, "query", "what?"), (3, "file", "promo code"), (4, "note", "cavity")], "ordinal BIGINT, kind STRING, text STRING")
    pages = spark.createDataFrame([("Telegram Records", "Telegram Records 2026-06-12", 9, "x"), ("Lasers", "old", 1, "y")], "section STRING, title STRING, records BIGINT, first_record STRING")
    sections = spark.createDataFrame([("Lasers",)], "section STRING")
    claims = spark.createDataFrame([("telegram-1", "Lasers", "Orders")], "record_id STRING, section STRING, topic_title STRING")
    run = day_digest.day_digest(records, pages, sections, "telegram", "2026-06-12", claims)
    assert {(r["record_id"], r["kept"]) for r in run.gated.collect()} == {("telegram-1", True), ("telegram-2", False), ("telegram-3", True)}
    assert {(r["section"], r["title"], r["records"]) for r in run.pages.collect()} == {
        ("Lasers", "old", 1), ("Lasers", "Orders Supplement 2026-06-12 [telegram]", 1),
        (rules.UNSORTED_SECTION, "Telegram supplement 2026-06-12 Supplement 2026-06-12 [telegram]", 1)}


def test_day_pages_on_disk(spark, tmp_path):
    df = spark.createDataFrame([("2026-06-12", f"p{i % 3}", i, f"text {i}") for i in range(50)], "d STRING, p STRING, n BIGINT, t STRING")
    page = digest.day_page(df, F.col("d"), F.col("p"), F.col("n"), digest.record_fragment(F.col("p"), F.lit("chat"), F.col("t")), "Records")
    tables.write_day_pages(page, str(tmp_path / "out"))
    folder = tmp_path / "out" / "day=2026-06-12"
    html = "".join((folder / name).read_text() for name in sorted(os.listdir(folder)) if name.startswith("part-"))
    assert html.startswith("<!DOCTYPE html>") and html.rstrip().endswith("</body></html>")
    assert [html.index(f"text {i}<") for i in range(0, 48, 3)] == sorted(html.index(f"text {i}<") for i in range(0, 48, 3))


@pytest.fixture
def landed(spark, tmp_path):
    """Messages that arrive in several files, read one file per batch."""
    rows = [(n, f"m{n % 40}", n % 4, 1700000000 + n * 60, ["record_on", None, None, "record_off", None][n % 5]) for n in range(120)]
    schema = "event_id BIGINT, message_id STRING, chat_id BIGINT, seconds BIGINT, command STRING"
    df = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("seconds"))
    for part in range(6):
        df.filter(f"event_id div 20 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
    return df, feeds.file_feed(spark, str(tmp_path / "feed"), "*.parquet", df.schema.simpleString()[7:-1].replace(":", " "), files_per_batch=1)


def test_ids_come_once_across_batches(spark, landed):
    _, stream = landed
    folder = shared_folder(spark)
    once = feeds.replay(feeds.live_messages(stream, "message_id", "ts", "1 day").select("message_id"), folder, "t-dedupe")
    assert sorted(r[0] for r in once.collect()) == sorted({f"m{n}" for n in range(40)})


def test_command_line(spark, tmp_path, capsys):
    from lorebase.__main__ import main

    sources(spark, TEXTS).write.parquet(str(tmp_path / "sources"))
    main(["build-index", "--sources", str(tmp_path / "sources"), "--index", str(tmp_path / "idx"), "--version", "v1"])
    main(["ask", "--index", str(tmp_path / "idx" / "v1"), "What finesse does the cavity have?"])
    assert "Note 0" in capsys.readouterr().out
    write(tmp_path / "e" / "one.md", "---\nid: one\ntitle: Laser\n---\nlaser body")
    main(["search-memory", "--entries", str(tmp_path / "e"), "laser"])
    assert "laser body" in capsys.readouterr().out
    write(tmp_path / "in" / "a.txt", "some text")
    main(["ingest", str(tmp_path / "in"), "--day", "2026-06-11", "--out", str(tmp_path / "out")])
    assert spark.read.parquet(str(tmp_path / "out")).collect()[0]["entry_id"] == "2026-06-11-a"


def test_maintenance_from_the_command_line(spark, tree, tmp_path, capsys):  # noqa: F811
    from lorebase.__main__ import main

    run = lambda *args: main([str(a) for a in args])
    run("manifest", "--html-root", tree, "--out", tmp_path / "m")
    html = "".join((tmp_path / "m" / "index" / n).read_text() for n in sorted(os.listdir(tmp_path / "m" / "index")) if n.startswith("part-"))
    assert html.startswith("<section><h2>Lasers (2)</h2><table>\n<tr><td>1</td>") and html.count("</section>") == 2 and html.index("Page A") < html.index("<h2>Other")
    run("nightly", "--html-root", tree, "--tables", tmp_path / "t", "--at", "t1")
    assert capsys.readouterr().out.strip() == "changes 0, distilled 0, state 0"
    page = {"title": "Page A", "html": "Lasers/a.html", "attachments": ["x.pdf"], "distilled": {"one_sentence_summary": "The cavity finesse is 20000.", "important_facts": ["finesse 20000"], "tags": ["cavity"]}}
    write(tmp_path / "d.json", json.dumps({"generated_at": "", "sections": [{"section": "Lasers", "pages": [page]}]}))
    run("build-index", "--distillation", tmp_path / "d.json", "--html-root", tree, "--index", tmp_path / "idx", "--version", "v1")
    assert {r["source_type"] for r in build_index.read_index(spark, str(tmp_path / "idx" / "v1")).collect()} == {"distilled_page", "source_html"}
    answer = ask.ask(build_index.open_index(spark, str(tmp_path / "idx" / "v1")), "cavity finesse", OfflineProvider())
    best = answer.evidence[0]
    assert (best["summary"], best["important_facts"], best["tags"], best["attachments"]) == ("The cavity finesse is 20000.", ["finesse 20000"], ["cavity"], ["x.pdf"])


def test_day_content(spark):
    records = spark.createDataFrame([(1, "note", "laser order", "ann"), (2, "query", "what?", "bob"), (3, "file", "promo code", "eve"), (4, "note", "cavity", None)], "ordinal BIGINT, kind STRING, text STRING, person STRING")
    pages = spark.createDataFrame([], "section STRING, title STRING, records BIGINT, first_record STRING")
    sections = spark.createDataFrame([("Lasers",)], "section STRING")
    run = day_digest.day_digest(records, pages, sections, "telegram", "2026-06-12")
    full = day_digest.day_content(run, sections, "telegram", "2026-06-12", "d.html", "now", attachments=["a.pdf"])
    page = full.content.collect()[0]
    assert page["records"] == 2 and page["section"] == rules.UNSORTED_SECTION and page["distilled"]["tags"] == ["telegram", "communication-supplement", "2026-06-12"]
    assert page["distilled"]["important_facts"] == ["telegram-1 note: laser order\nnote\nann", "telegram-3 note: cavity\nnote"] and page["distilled"]["important_assets_or_attachments"] == ["a.pdf"]


def test_short_reply():
    item = {"what_happened": ["a", "b", "c"], "decisions_or_conclusions": ["结论 d"], "important_facts": ["e", "a"]}
    assert ask.short_reply([item]) == "- a\n- b\n- 结论 d\n- c"
    assert ask.short_reply([]) == rules.UNKNOWN_ANSWER
