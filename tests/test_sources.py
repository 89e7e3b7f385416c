"""File readers, binary formats, mail, polled services."""

import io
import json
import os
import zipfile
from email.message import EmailMessage
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lorebase import schemas
from lorebase.plans import ingest
from lorebase.sources import binaries, chat, files, mail, polled


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode("utf-8"))


def test_json_readers(spark, tmp_path):
    write(tmp_path / "d.json", '{\n "a": 1\n}')
    write(tmp_path / "l.jsonl", '{"a": 1}\n\nnot json\n{"a": 2}\n')
    assert [r["a"] for r in files.read_json(spark, str(tmp_path / "d.json"), "a INT").collect()] == [1]
    assert files.read_json(spark, str(tmp_path / "missing.json"), "a INT").collect() == []
    assert [r["a"] for r in files.read_json_lines(spark, str(tmp_path / "l.jsonl"), "a INT").collect()] == [1, 2]
    schema = "user STRUCT<id: BIGINT, name: STRING>, files ARRAY<STRUCT<path: STRING, size: BIGINT>>, text STRING"
    write(tmp_path / "odd.jsonl", '{"user":{"id":1,"name":"a"},"files":[{"path":"x","size":"3"}],"text":"one"}\n{"user":{"id":"2"},"text":"two"}\n'
          '{"user":{"id":"z"},"files":"none","text":7}\n{"text": broken\n[1]\n')
    odd = files.read_json_lines(spark, str(tmp_path / "odd.jsonl"), schema)
    want = [((1, "a"), [("x", 3)], "one"), ((2, None), None, "two"), ((None, None), None, "7")]
    assert [tuple(tuple(v) if k == "user" else [tuple(f) for f in v] if isinstance(v, list) else v for k, v in r.asDict().items()) for r in odd.collect()] == want
    assert odd.count() == 3
    with pytest.raises(Exception, match="MALFORMED|malformed|FAILFAST"):
        files.read_json_lines(spark, str(tmp_path / "l.jsonl"), "a INT", strict=True).collect()


def test_chat_archive_to_sources(spark, tmp_path):
    records = [
        {"created_at": "2026-06-11T10:00:00+08:00", "kind": "note", "text": "laser token abc", "message_id": "1",
         "files": [{"path": "/x/a.pdf", "file_name": "", "mime_type": "application/pdf", "text_extract": str(tmp_path / "a.pdf.txt")}]},
        {"created_at": "", "kind": "query", "text": "not kept", "message_id": "2"},
        {"created_at": "", "kind": "note", "text": "newsletter of shoes", "message_id": "3"},
    ]
    day = tmp_path / "root" / "2026-06-11" / "telegram 记录" / "ann_1"
    write(day / "chat_records.jsonl", "\n".join(json.dumps(r, ensure_ascii=False) for r in records))
    write(tmp_path / "root" / "2026-06-12" / "telegram 记录" / "bob_2" / "chat_records.jsonl", json.dumps(records[0]))
    write(tmp_path / "a.pdf.txt", "text of the pdf")
    root = str(tmp_path / "root")
    read = files.read_day_records(spark, root, "telegram 记录", "chat_records.jsonl", schemas.CHAT_RECORD)
    assert {(r["day"], r["person"]) for r in read.select("day", "person").collect()} == {("2026-06-11", "ann_1"), ("2026-06-12", "bob_2")}
    one = files.read_day_records(spark, root, "telegram 记录", "chat_records.jsonl", schemas.CHAT_RECORD, day="2026-06-11")
    assert one.count() == 3
    numbered = one.withColumn("line", F.col("message_id").cast("int"))
    sources = chat.chat_sources(numbered, "telegram").collect()
    assert [s["title"] for s in sources] == ["Telegram 2026-06-11 ann_1"]
    assert sources[0]["text"].splitlines() == [
        "Source: telegram", "Date: 2026-06-11T10:00:00+08:00", "Person: ann_1", "Kind: note", "Text:", "laser token <redacted>",
        "Files:", f"file_name=a.pdf; mime_type=application/pdf; path=/x/a.pdf"]
    extracts = files.read_extracts(spark, str(tmp_path / "*.txt"))
    attached = chat.attachment_sources(one, extracts, "telegram").collect()
    assert [(a["title"], a["text"]) for a in attached] == [("a.pdf", "text of the pdf")]


def test_entries(spark, tmp_path):
    write(tmp_path / "e" / "one.md", '---\nid: x-1\ntitle: "A: b"\ntags: ["a", \'b, c\']\n# note: no\nid: x-2\ndraft: true\n---\n## Head\n\nBody  text\n')
    write(tmp_path / "e" / "two.md", "no front matter # here")
    got = {os.path.basename(r["path"]): r for r in files.read_entries(spark, str(tmp_path / "e")).collect()}
    assert (got["one.md"]["id"], got["one.md"]["title"], got["one.md"]["tags"]) == ("x-2", "A: b", ["a", "b", "c"])
    assert (got["one.md"]["body_text"], got["one.md"]["projects"]) == ("Head Body text", [])
    assert (got["two.md"]["id"], got["two.md"]["body_text"]) == ("two", "no front matter here")


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "html"
    page = '<html><head><title>{0}</title><meta name="X-Original-Page-Id" content="{1}"><meta name="X-Updated-Time" content="1700000000"></head><body><p>{2}</p></body></html>'
    write(root / "Lasers.html", '<a href="Lasers/b.html">b</a><a href="./Lasers/a.html">a</a><a href="Lasers/b.html">again</a><a href="Other/x.html">x</a>')
    write(root / "Lasers" / "a.html", page.format("Page A", "ida", "The laser was tuned to 556 nm today."))
    write(root / "Lasers" / "b.html", page.format("", "", "plain &amp; simple"))
    write(root / "Lasers" / "unlinked.html", page.format("U", "", ""))
    write(root / "Other.html", "no links")
    write(root / "Other" / "z.html", page.format("Z", "", ""))
    write(root / "Other" / "Y.html", page.format("Y", "", ""))
    write(root / "lonely.html", "no folder")
    return root


def test_html_tree(spark, tree):
    manifest = files.tree_manifest(files.read_html_tree(spark, str(tree)))
    got = [(r["section"], r["order"], r["html"], r["title"]) for r in manifest.orderBy("section", "order").collect()]
    assert got == [("Lasers", 1, "Lasers/b.html", "b"), ("Lasers", 2, "Lasers/a.html", "Page A"),
                   ("Other", 1, "Other/Y.html", "Y"), ("Other", 2, "Other/z.html", "Z")]
    a = manifest.filter("title = 'Page A'").collect()[0]
    assert (a["onenote_page_id"], a["updated"], a["text_preview"]) == ("ida", "2023-11-14T22:13:20Z", "The laser was tuned to 556 nm today.")


def test_nested_documents(spark):
    doc = {"generated_at": "", "sections": [{"section": "S", "page_count": 1, "pages": [{"title": "T", "distilled": {"tags": ["x"]}}]}]}
    df = spark.read.schema(schemas.DISTILLATION).json(spark.sparkContext.parallelize([json.dumps(doc)]))
    row = files.flatten_distillation(df).collect()[0]
    assert (row["section"], row["title"], row["distilled"]["tags"]) == ("S", "T", ["x"])


def docx(paragraphs):
    space = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "".join(f"<w:p>{''.join(f'<w:r><w:t>{t}</w:t></w:r>' for t in p)}</w:p>" for p in paragraphs)
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as archive:
        archive.writestr("word/document.xml", f"<w:document {space}><w:body>{body}</w:body></w:document>")
    return data.getvalue()


MHT = (b"MIME-Version: 1.0\r\nContent-Type: multipart/related; boundary=B\r\n\r\n--B\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
       b"<p>one</p><p>two</p>\r\n--B\r\nContent-Type: text/plain\r\n\r\nthree\r\n--B--\r\n")


def test_ingest_of_exports(spark, tmp_path):
    box = tmp_path / "inbox"
    write(box / "My Note.TXT", "中文".encode("gb18030") + b"\r\n\r\n\r\n\r\nend")
    write(box / "p.html", "<p> a </p><script>b</script>c")
    write(box / "w.docx", docx([["He", "llo"], [" "], ["World"]]))
    write(box / "m.mht", MHT)
    write(box / "s.pdf", b"%PDF")
    write(box / "x.zip", b"PK")
    write(box / "empty.md", b"  \n")
    long = "\n".join(f"line {i} " + "x" * 80 for i in range(120))
    write(box / "long.md", long)
    texts = {os.path.basename(r["path"]): r["text"] for r in binaries.export_files(binaries.read_binaries(spark, str(box))).collect()}
    assert texts["My%20Note.TXT" if "My%20Note.TXT" in texts else "My Note.TXT"] == "中文\n\nend"
    assert (texts["p.html"], texts["w.docx"], texts["m.mht"].split()) == ("a\nb\nc", "Hello\nWorld", ["one", "two", "three"])
    entries, failures = ingest.ingest_exports(spark, str(box), "2026-06-11")
    ids = sorted(r["entry_id"] for r in entries.collect())
    assert "2026-06-11-long-part-001" in ids and "2026-06-11-long-part-003" in ids
    assert {os.path.basename(r["path"]): r["reason"] for r in failures.collect()} == {
        "s.pdf": "PDF extraction needs a PDF reader", "x.zip": "unsupported file type", "empty.md": "no text extracted"}


def test_mail(spark):
    def raw(message_id, sender, plain="", html="", attach=False):
        message = EmailMessage()
        message["Message-ID"], message["From"], message["To"] = message_id, sender, "lab@example.org"
        message["Date"], message["Subject"] = "Tue, 14 Nov 2023 22:13:20 +0000", "Quote"
        if plain:
            message.set_content(plain)
        if html:
            message.add_alternative(html, subtype="html") if plain else message.set_content(html, subtype="html")
        if attach:
            message.add_attachment("secret notes", filename="n.txt")
            message.add_attachment("gr\u00fc\u00dfe".encode("latin-1"), maintype="text", subtype="plain", filename="l.txt", params={"charset": "latin-1"})
            message.add_attachment(bytes(range(200, 256)), maintype="image", subtype="png", filename="p.png")
        return message.as_bytes()

    rows = [("u1", raw("<1>", '"Doe, J" <J@Example.org>', "plain body", "<p>html</p>", True)), ("u2", raw("<2>", "b@x.org", html="<p>one</p><br>two &amp; three")),
            ("u3", raw("<1>", "j@example.org", "again")), ("u4", raw("<4>", "spam@x.org", "buy")), ("u5", raw("<5>", "b@x.org", "old id")), ("u6", raw("<6>", "b@x.org", "done"))]
    mails = spark.createDataFrame([(f"/m/{u}.eml", u, bytearray(b)) for u, b in rows], "path STRING, uid STRING, content BINARY")
    records = mail.mail_records(mails)
    got = {r["uid"]: r for r in records.collect()}
    assert (got["u1"]["body"], got["u1"]["sender"], got["u1"]["date"]) == ("plain body", "j@example.org", "2023-11-14T22:13:20Z")
    assert got["u2"]["body"] == "one\n\ntwo & three"
    one = lambda v, c: spark.createDataFrame([(v,)], f"{c} STRING")
    actions = mail.new_mail(records, one("u6", "uid"), one("<5>", "message_id"), one("spam@x.org", "sender"))
    assert {r["uid"]: r["action"] for r in actions.collect()} == {"u1": "archive", "u2": "archive", "u3": "known", "u4": "ignored", "u5": "known"}
    source = mail.mail_sources(records.filter("uid = 'u1'")).collect()[0]
    assert source["text"].startswith("Source: email\nDate: 2023-11-14T22:13:20Z\nFrom: ") and "Body:\nplain body\nAttachments:\nfile_name=n.txt; mime_type=text/plain; path=/m/u1.eml/n.txt; text_preview=secret <redacted>\n" in source["text"]
    files = {(f["file_name"], f["mime_type"], f["size"], f["text_extract"]) for f in got["u1"]["attachments"]}
    assert files == {("n.txt", "text/plain", 13, "secret notes\n"), ("l.txt", "text/plain", 5, "gr\u00fc\u00dfe"), ("p.png", "image/png", 56, None)}
    assert got["u2"]["attachments"] == []
    own = mail.mail_attachment_sources(records).collect()
    assert sorted((r["title"], r["text"], r["source_type"], r["metadata"]["parent_record"]) for r in own) == [
        ("l.txt", "gr\u00fc\u00dfe", "email_file_text", "/m/u1.eml"), ("n.txt", "secret <redacted>\n", "email_file_text", "/m/u1.eml")]
    assert mail.mail_sources(records.withColumns({"subject": F.lit("hi"), "body": F.lit("unsubscribe here"), "text_preview": F.lit("")})).count() == 0


def test_polled_service(spark, tmp_path):
    polled.register(spark)
    batch = spark.read.format("polled_messages").option("fetch", "polled_service:page").option("chats", "a,b").load()
    assert sorted(r["message_id"] for r in batch.collect()) == ["a1", "a2", "a3", "b1"]


@pytest.mark.parametrize("ranged", [False, True])
def test_feed_of_several_chats(spark, tmp_path, ranged):
    """Chats grow between runs and one appears late; a run that failed before its commit reads the same positions again."""
    sizes = Path(os.environ["POLLED_SIZES"])
    polled.register(spark)
    stream = spark.readStream.format("polled_messages").option("chatlist", "polled_service:chat_list").option("fetch", "polled_service:newest_first")
    if ranged:
        stream = stream.option("heads", "polled_service:heads").option("between", "polled_service:between").option("positionsperpartition", 3)
    batches = []

    def run(fail=False):
        def keep(batch, number):
            rows = sorted((r["chat_id"], int(r["message_id"])) for r in batch.collect())
            batches.append((number, rows))
            if fail:
                raise RuntimeError("killed")

        query = stream.load().writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        try:
            query.awaitTermination(120)
        except Exception:
            assert fail

    sizes.write_text('{"a": 9, "b": 2, "c": 0}')
    run()
    assert batches == [(0, [("a", n) for n in range(9)] + [("b", 0), ("b", 1)])]
    sizes.write_text('{"a": 9, "b": 8, "c": 0}')
    run(fail=True)
    sizes.write_text('{"a": 20, "b": 11, "c": 1, "d": 7}')
    run()
    run()
    assert batches[1] == batches[2] == (1, [("b", n) for n in range(2, 8)])
    everything = batches[0][1] + batches[2][1] + [x for _, rows in batches[3:] for x in rows]
    assert sorted(everything) == sorted((c, n) for c, size in {"a": 20, "b": 11, "c": 1, "d": 7}.items() for n in range(size))
    if not ranged:  # pages of a range are fetched in the tasks' processes
        pids = {line.split()[1] for line in Path(f"{sizes}.calls").read_text().splitlines()}
        assert len(pids) > 1 and str(os.getpid()) not in pids


def test_polled_records(spark):
    rows = [("m1", "c", "group", "text", "1700000000000", ("u", "open_id", "user", ""), [("@_1", "bot", "open_id", "Helper")], ('{"text":"@_1 hi"}',)),
            ("m2", "c", "odd", "text", "1700000000", ("v", "user_id", "user", ""), None, ('{"text":"yo"}',)),
            ("m3", "c", "group", "text", "1", ("x", "open_id", "App", ""), None, ('{"text":"no"}',)),
            ("m4", "c", "group", "system", "1", ("x", "open_id", "user", ""), None, ('{}',))]
    got = {r["message_id"]: r for r in chat.polled_records(spark.createDataFrame(rows, schemas.POLLED_MESSAGE), "bot", ["helper"]).collect()}
    assert set(got) == {"m1", "m2"}
    assert (got["m1"]["text"], got["m1"]["mentioned"], got["m1"]["original_created_at"]) == ("hi", True, "2023-11-14T22:13:20Z")
    assert (got["m2"]["chat_type"], got["m2"]["user_id"], got["m2"]["mentioned"]) == ("group", "v", False)
