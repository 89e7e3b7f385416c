"""Keyed tables in versions: a write touches the buckets whose rows change, and counts once its commit is there.

``path/data/v=n/bucket=b`` holds the rows of a bucket as version n wrote them, ``path/commits/v=n`` says for every bucket
which version to read. A reader stays on the version it opened. A write that fails leaves files that no commit names; the
next one writes them anew. Two writers of one version can't both commit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.session import persist_table
from lorebase.sources.files import or_empty

BUCKETS = 256
_COMMIT = "bucket INT, data LONG, v LONG"


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, schema: str, keys: Sequence[str], buckets: int = BUCKETS, ignore: Sequence[str] = ()):
        """``ignore``: columns in which alone a row may differ without counting as changed (when it was last seen, say)."""
        self.spark, self.path, self.schema, self.keys, self.buckets, self.ignore = spark, path.rstrip("/"), schema, list(keys), buckets, set(ignore)
        self.columns = spark.createDataFrame([], schema).columns

    def _commits(self) -> DataFrame:
        return or_empty(self.spark, _COMMIT, lambda: self.spark.read.schema(_COMMIT).json(f"{self.path}/commits"))

    def version(self) -> int | None:
        """The latest committed version."""
        return self._commits().agg(F.max("v")).first()[0]

    def _buckets(self, version: int | None) -> dict[int, int]:
        """Bucket -> version that holds its rows; as many entries as there are buckets, at most."""
        return {r["bucket"]: r["data"] for r in self._commits().where(F.col("v") == version).collect() if r["bucket"] is not None} if version is not None else {}

    def _rows(self, places: dict[int, int]) -> DataFrame:
        if not places:
            return self.spark.createDataFrame([], self.schema)
        paths = [f"{self.path}/data/v={data}/bucket={bucket}" for bucket, data in sorted(places.items())]
        return self.spark.read.schema(self.schema).parquet(*paths)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the latest unless one is named. A later write does not change what this reads."""
        return self._rows(self._buckets(self.version() if version is None else version))

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _print(self) -> Column:
        """Changes with any column that counts; nulls and their places included."""
        return F.sha2(F.to_json(F.struct(*[c for c in self.columns if c not in self.ignore]), {"ignoreNullFields": "false"}), 256)

    def write(self, rows: DataFrame, removed: DataFrame | None = None) -> int | None:
        """Upserts ``rows`` (each key once) and drops the keys of ``removed``; returns the version that then holds.

        Only buckets with a row that is new, differs or goes are read whole and written again. Nothing to change: no new version.
        """
        base = self.version()
        places = self._buckets(base)
        fresh = persist_table(rows.select(*self.columns).withColumn("_bucket", self._bucket()).withColumn("_print", self._print()), "fresh")
        near = {b: d for b, d in places.items() if b in {r[0] for r in fresh.select("_bucket").distinct().collect()}}
        known = self._rows(near).select(*self.keys, self._print().alias("_known"))
        same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in self.keys]
        joined = fresh.alias("f").join(known.alias("k"), same("f", "k"), "left").where(F.col("_known").isNull() | (F.col("_known") != F.col("_print")))
        changed = persist_table(joined.select(*[F.col(f"f.{c}").alias(c) for c in self.columns], "_bucket"), "changed")
        touched = {r[0] for r in changed.select("_bucket").distinct().collect()}
        gone = None
        if removed is not None and places:
            named = removed.select(*self.keys).distinct().withColumn("_bucket", self._bucket())
            there = self._rows({b: d for b, d in places.items() if b in {r[0] for r in named.select("_bucket").distinct().collect()}})
            gone = persist_table(named.alias("f").join(there.select(*self.keys).alias("k"), same("f", "k"), "left_semi"), "gone")
            touched |= {r[0] for r in gone.select("_bucket").distinct().collect()}
        if not touched and base is not None:
            return base
        number = 0 if base is None else base + 1
        old = self._rows({b: d for b, d in places.items() if b in touched})
        for leaving in (changed, gone):
            if leaving is not None:
                old = old.alias("f").join(leaving.select(*self.keys).alias("k"), same("f", "k"), "left_anti")
        whole = old.select(*self.columns).unionByName(changed.select(*self.columns)).withColumn("bucket", self._bucket())
        whole.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/v={number}")
        written = {r[0] for r in or_empty(self.spark, "bucket INT", lambda: self.spark.read.schema(f"{self.schema}, bucket INT").parquet(f"{self.path}/data/v={number}").select("bucket")).distinct().collect()}
        after = {**{b: d for b, d in places.items() if b not in touched}, **dict.fromkeys(written, number)}
        lines = [(b, d) for b, d in sorted(after.items())] or [(None, None)]
        self.spark.createDataFrame(lines, "bucket INT, data LONG").coalesce(1).write.mode("errorifexists").json(f"{self.path}/commits/v={number}")
        return number
