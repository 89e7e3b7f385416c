"""Queries against their SQL twins on rows the supplied tables lack at the smallest scale."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lorebase import rules
from lorebase.functions.text import matches_any
from lorebase.operators import publish, snapshots
from lorebase.streaming import chats, feeds

#: queries whose pages hold a title that was cut inside an entity
CUT_ENTITIES = ("html_text_distiller", "html_text_import", "html_text_index", "html_text_mail", "html_text_page", "page_meta")


def twin(spark, folder, name, **tables):
    """Rows of a query and of its SQL twin over tables written to ``folder``."""
    con = duckdb.connect()
    for table, rows in tables.items():
        rows.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    frame = entry.queries()[name](spark, str(folder))
    names = sorted(frame.columns)
    ours = sorted(tuple(r[c] for c in names) for r in frame.collect())
    theirs = con.execute(f"SELECT {', '.join(names)} FROM ({entry.oracle_sql()[name]})").fetchall()
    return ours, sorted(theirs)


@pytest.mark.parametrize("name", CUT_ENTITIES)
def test_an_entity_without_its_semicolon_stays(spark, tmp_path, name):
    page = "<html><head><title>{0}</title></head><body><p>{0} &amp; b &copy; c</p>d{0}</body></html>"
    rows = [(i, f"https://h.example/{i}", page.format(cut)) for i, cut in enumerate(("cut &amp", "x &quot", "&middot", "&am", "a&amp;quot;"))]
    ours, theirs = twin(spark, tmp_path, name, pages=spark.createDataFrame(rows, "page_id LONG, url STRING, html STRING"))
    assert ours == theirs and len(ours) == len(rows)


def test_largest_variant_gives_the_largest_size(spark, tmp_path):
    rows = [(1, 10, 5.01), (1, 40_000, 5.0), (2, 3_000_000, 7.25), (2, 7, 7.26), (3, 1, 2.5), (4, 20_000, 1.0), (4, 10_000, 1.01)]
    ours, theirs = twin(spark, tmp_path, "largest_variant", events=spark.createDataFrame(rows, "user_id LONG, event_id LONG, value DOUBLE").orderBy("event_id"))
    assert ours == theirs


@pytest.mark.parametrize("machine", [chats.ModeMachine(), chats.TurnMemory(6, 10, 1800)])
def test_chats_share_calls_into_the_state(machine):
    """A thousand chats of a slot cost as many calls as one does, and each is handled by itself."""
    calls = []

    class Value:
        def __init__(self):
            self.now = None

        def get(self):
            calls.append("get")
            return self.now

        def update(self, value):
            calls.append("update")
            self.now = value

        def clear(self):
            self.now = None

    class Listed(Value):
        def get(self):
            return iter(self.now or [])

        def appendValue(self, value):
            calls.append("append")
            self.now = [*(self.now or []), value]

        def put(self, values):
            self.now = values

    class Handle:
        getListState = staticmethod(lambda name, schema: Listed())
        getValueState = staticmethod(lambda name, schema: Value())
        registerTimer = staticmethod(lambda at: calls.append("timer"))

    class Timers:
        getCurrentWatermarkInMs = staticmethod(lambda: 100_000)

    machine.init(Handle)
    chat = np.repeat(np.arange(1000), 3)
    at = np.tile([3, 1, 2], 1000) * 1_000_000
    frame = pd.DataFrame({"slot": 0, "known": 1, "chat_id": chat, "at": at, "event_id": np.arange(3000), "command": np.tile([0, 1, 2], 1000), "beat": 0})
    assert not list(machine.handleInputRows((0,), iter([frame]), Timers))
    out = pd.concat(list(machine.handleExpiredTimer((0,), Timers, None))).sort_values("event_id")
    assert out["chat_id"].tolist() == chat.tolist() and len(calls) < 10
    want = ["ask", "record", "ask"] if "mode" in out else [2, 0, 1]
    assert out.iloc[:, 2].tolist() == want * 1000


def test_a_secret_needs_its_clues(evaluate):
    texts = ["", "plain", "ghp_" + "a" * 20, "gho_" + "a" * 19, "-----BEGIN EC PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----", "PassWord: 'abcdefgh'",
             'Client-Secret="abcdefgh"', "access_token = 'abcdefgh'", "API-KEY:'abcdefgh'", "apikey 'abcdefgh'", "token='short'", "it's a token: no", None]
    assert evaluate(publish.has_secret, *texts) == evaluate(lambda text: matches_any(text, rules.PUBLISH_SECRET_PATTERNS), *texts)
    # the query's rows of eleven megabytes hold no clue, so no pattern is run on them
    assert "ghp_" in str(publish.has_secret(F.col("text")))


def test_a_call_places_many_components(spark, monkeypatch):
    old = spark.createDataFrame([(i, f"p/{i}", f"s{i % 40}") for i in range(60)], "ordinal LONG, html STRING, source_sha256 STRING")
    new = spark.createDataFrame([(100 + i, f"p/{2 * i}", f"s{i if i % 3 else 90 + i}") for i in range(40)], "ordinal LONG, html STRING, source_sha256 STRING")
    found = []
    for rows in (1, snapshots.PLACED_ROWS):
        monkeypatch.setattr(snapshots, "PLACED_ROWS", rows)
        found.append(sorted(map(tuple, snapshots.upsert_pages(old, new).collect())))
    assert found[0] == found[1]


def test_all_tasks_look_for_the_rows_of_a_landed_file(spark, tmp_path):
    rows = spark.range(0, 100, 1, 4).select("id", F.spark_partition_id().alias("part"), (F.col("id") % 2).alias("arrival"))
    feeds.land(rows, str(tmp_path), "arrival", 2)
    landed = spark.read.parquet(str(tmp_path))
    assert landed.count() == 100 and landed.select("part").distinct().count() == 4 and len(landed.inputFiles()) == 2
