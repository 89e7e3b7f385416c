"""Nightly notebook maintenance: compare, log, distil what changed, upsert, save state."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase import schemas
from lorebase.functions import html as H
from lorebase.operators import distill, snapshots
from lorebase.plans.versions import VersionedTable
from lorebase.session import persist_table
from lorebase.sources.files import or_empty, read_entries


@dataclass
class NightlyRun:
    changes: DataFrame
    counts: DataFrame
    distilled: DataFrame
    state: DataFrame


def current_pages(manifest: DataFrame) -> DataFrame:
    """Manifest pages with raw HTML in ``text`` -> keyed pages with their readable text."""
    pages = manifest.withColumn("text", H.text_for_distiller(F.col("text"), "[image alt text]"))
    return snapshots.keyed_pages(pages, "order")


def read_state(spark: SparkSession, path: str) -> DataFrame:
    return or_empty(spark, schemas.PAGE_STATE, lambda: spark.read.parquet(path))


def nightly(manifest: DataFrame, previous: DataFrame, detected_at: str) -> NightlyRun:
    """``previous`` is the state of the last run. The current pages are read by the comparison, the log, the
    distillation and the state, so they are written to the shared folder once."""
    current = persist_table(current_pages(manifest), "pages")
    diff = persist_table(snapshots.diff_snapshots(previous, current), "diff")
    changes = snapshots.change_records(diff, previous, current, detected_at)
    touched = diff.filter(F.col("type") != "removed").select("key")
    fresh = current.join(touched, "key", "left_semi").withColumn("ordinal", F.col("order").cast("bigint"))
    return NightlyRun(
        changes=changes, counts=snapshots.change_counts(diff), distilled=distill.distill_pages(fresh),
        state=snapshots.next_state(current, detected_at),
    )


def notebook_tables(spark: SparkSession, path: str) -> dict[str, VersionedTable]:
    """The tables that nightly maintenance keeps: page states, distilled pages, the change log, and what a sync has seen."""
    return {
        "state": VersionedTable(spark, f"{path}/state", schemas.PAGE_STATE, ["key"], ignore=["last_seen_at"]),
        "distilled": VersionedTable(spark, f"{path}/distilled", schemas.DISTILLED_ROW, ["key"]),
        "changes": VersionedTable(spark, f"{path}/changes", schemas.CHANGE, ["key", "previous_sha256", "current_sha256"], ignore=["detected_at"]),
        "synced": VersionedTable(spark, f"{path}/synced", "id STRING, modified STRING", ["id"]),
    }


def run_nightly(spark: SparkSession, manifest: DataFrame, path: str, detected_at: str) -> dict[str, int | None]:
    """One run over the tables at ``path``; returns the version of each that holds after it.

    The state is pinned at the start and committed last, so a run that fails is done again from the same state, and the tables
    written before take the same rows again without a new version.
    """
    tables = notebook_tables(spark, path)
    previous = tables["state"].read()
    run = nightly(manifest, previous, detected_at)
    changes = persist_table(run.changes, "changes")
    removed = changes.where("type = 'removed'").select("key")
    columns = tables["distilled"].columns
    versions = {"changes": tables["changes"].write(changes), "distilled": tables["distilled"].write(run.distilled.select(*columns), removed)}
    versions["state"] = tables["state"].write(run.state, removed)
    return versions


def sync_pages(remote: DataFrame, fetch: Callable[[DataFrame], DataFrame], synced: VersionedTable) -> DataFrame:
    """The pages to be fetched and what came of it; those that came are noted as seen, the others are due again next time.

    ``remote``: id, modified; ``fetch`` turns stale rows into rows (id, content), null content where it failed.
    """
    stale = persist_table(snapshots.stale_pages(remote, synced.read()), "stale")
    fetched = persist_table(stale.join(fetch(stale).select("id", "content"), "id", "left"), "fetched")
    synced.write(fetched.where("content IS NOT NULL").select("id", "modified"))
    return fetched


def rebuild_entries(spark: SparkSession, folder: str, path: str) -> int | None:
    """The index of memory entries as a versioned table: rows of changed files are replaced, those of vanished files go."""
    entries = persist_table(read_entries(spark, folder).dropDuplicates(["path"]), "entries")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in entries.schema.fields)
    table = VersionedTable(spark, path, schema, ["path"])
    return table.write(entries, table.read().select("path").join(entries.select("path"), "path", "left_anti"))


def merge_tree(incoming: DataFrame, active: DataFrame) -> DataFrame:
    """Merge counters of an incoming tree against the active one (both manifests)."""
    keyed = [snapshots.keyed_pages(tree, "order").select("key", "sha256") for tree in (incoming, active)]
    return snapshots.merge_counts(snapshots.merge_status(*keyed))
