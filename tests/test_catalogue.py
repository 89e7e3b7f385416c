"""Every registered query against its SQL twin at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def cell(value):
    return f"{value:.6g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, sql, name):
    frame = entry.queries()[name](spark, FOLDER)
    names = sorted(frame.columns)
    ours = sorted([tuple(cell(row[c]) for c in names) for row in frame.collect()])
    twin = entry.oracle_sql().get(name)
    if twin is None:
        assert ours
        return
    result = sql.execute(twin)
    columns = [d[0] for d in result.description]
    assert sorted(columns) == names
    theirs = sorted(tuple(cell(row[columns.index(c)]) for c in names) for row in result.fetchall())
    assert ours == theirs


def test_entry(spark):
    assert entry.entry(spark).columns


def test_a_manifest_document_holds_one_block_of_a_host(spark):
    from lorebase.catalogue.derived import _host_manifest
    from lorebase.sources.files import flatten_manifest

    rows = [(i, None if i % 7 == 0 else "hot", f"u{i}") for i in range(100)]
    manifest = _host_manifest(spark.createDataFrame(rows, "page_id LONG, section STRING, url STRING"), block_pages=10)
    assert max(len(r["sections"][0]["pages"]) for r in manifest.collect()) <= 10
    want = {(s, u, n) for name in (None, "hot") for n, (_, s, u) in enumerate(r for r in rows if r[1] == name)}
    out = flatten_manifest(manifest).collect()
    assert len(out) == 100 and {(r["section"], r["html"], r["page_order"]) for r in out} == want
