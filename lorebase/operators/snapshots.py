"""Snapshot comparison, merges and keyed upserts.

Joins compare keys and hashes only. Text is fetched afterwards, for the changed keys.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorebase import rules
from lorebase.functions.text import compact
from lorebase.operators import linediff
from lorebase.operators.grouping import last_per_key
from lorebase.operators.linking import components
from lorebase.session import persist_table


def page_key() -> F.Column:
    """Stable key of a page: original id, else html path, else section/title."""
    def filled(name: str) -> F.Column:
        return F.nullif(F.col(name), F.lit(""))

    return F.coalesce(filled("onenote_page_id"), filled("html"), F.concat_ws("/", F.col("section"), F.col("title")))


def keyed_pages(pages: DataFrame, order: str) -> DataFrame:
    """Pages under their stable key; on a clash the later page wins."""
    return last_per_key(pages.withColumn("key", page_key()), ["key"], [order])


def diff_snapshots(previous: DataFrame, current: DataFrame) -> DataFrame:
    """added / modified / removed keys with both hashes; unchanged keys are left out.

    Both sides: key (unique), sha256. A full outer join of two narrow tables.
    """
    old = previous.select("key", F.col("sha256").alias("previous_sha256"))
    new = current.select("key", F.col("sha256").alias("current_sha256"))
    change = (
        F.when(F.col("previous_sha256").isNull(), "added")
        .when(F.col("current_sha256").isNull(), "removed")
        .when(F.col("previous_sha256") != F.col("current_sha256"), "modified")
    )
    return old.join(new, "key", "full_outer").withColumn("type", change).filter(F.col("type").isNotNull())


def change_counts(changes: DataFrame) -> DataFrame:
    """One row: added, modified, removed."""
    return changes.agg(*[F.count_if(F.col("type") == t).alias(t) for t in ("added", "modified", "removed")])


def change_records(changes: DataFrame, previous: DataFrame, current: DataFrame, detected_at: str,
                   max_diff_lines: int = rules.MAX_DIFF_LINES) -> DataFrame:
    """Change log rows with preview and line diff. Only changed keys bring their text along.

    ``previous`` and ``current``: key, section, title, html, text, created, updated.
    """
    meta = ("section", "title", "html", "created", "updated", "text")
    old = previous.select("key", *[F.col(c).alias(f"old_{c}") for c in meta])
    new = current.select("key", *meta)
    wide = changes.join(old, "key", "left").join(new, "key", "left")
    heads = F.array(F.lit("--- previous"), F.lit("+++ current"))
    lines = F.split(F.col("text"), "\r\n|[\n\r]")
    more = F.size(lines) - max_diff_lines
    cut = F.when(more > 0, F.array(F.concat(F.lit("... page truncated, "), more.cast("string"), F.lit(" lines omitted ...")))).otherwise(F.array().cast("array<string>"))
    shown = F.concat(heads, F.array(F.lit("@@ added page @@")), F.slice(lines, 1, max_diff_lines), cut)
    modified = F.col("type") == "modified"
    diffs = linediff.unified(linediff.line_hunks(wide.where(modified).select("key", "old_text", "text")), max_diff_lines)
    diffed = wide.join(diffs.withColumnRenamed("diff", "_diff"), "key", "left")
    return diffed.select(
        "type", F.lit(detected_at).alias("detected_at"), "key",
        *[F.coalesce(F.col(c), F.col(f"old_{c}"), F.lit("")).alias(c) for c in meta[:-1]],
        F.coalesce("previous_sha256", F.lit("")).alias("previous_sha256"),
        F.coalesce("current_sha256", F.lit("")).alias("current_sha256"),
        F.when(F.col("type") == "added", F.substring(compact(F.col("text")), 1, rules.ADDED_PREVIEW)).alias("text_preview"),
        F.when(modified, F.coalesce("_diff", F.array().cast("array<string>")))
        .when(F.col("type") == "added", shown)
        .otherwise(F.concat(heads, F.array(F.lit("@@ removed page @@")))).alias("diff"),
    )


def next_state(current: DataFrame, detected_at: str) -> DataFrame:
    """The snapshot the next run compares with."""
    return current.select("key", "section", "title", "html", "sha256", "created", "updated", "text").withColumn(
        "last_seen_at", F.lit(detected_at)
    )


def merge_status(incoming: DataFrame, active: DataFrame) -> DataFrame:
    """added / updated / duplicate per incoming page. Both sides: key, sha256."""
    known = active.select("key", F.col("sha256").alias("active_sha256"))
    status = (
        F.when(F.col("active_sha256").isNull(), "added")
        .when(F.col("active_sha256") == F.col("sha256"), "duplicate")
        .otherwise("updated")
    )
    return incoming.join(known, "key", "left").withColumn("status", status)


def merge_counts(merged: DataFrame) -> DataFrame:
    return merged.agg(
        F.count_if(F.col("status") == "added").alias("added_pages"),
        F.count_if(F.col("status") == "updated").alias("updated_pages"),
        F.count_if(F.col("status") == "duplicate").alias("duplicate_pages"),
    )


def copy_plan(incoming: DataFrame, target: DataFrame) -> DataFrame:
    """What a copy-if-changed run would do per file: missing, duplicate or copied.

    ``incoming``: path, sha256 (null when the file is gone); ``target``: path, sha256.
    """
    there = target.select("path", F.col("sha256").alias("target_sha256"))
    status = (
        F.when(F.col("sha256").isNull(), "missing")
        .when(F.col("sha256") == F.col("target_sha256"), "duplicate")
        .otherwise("copied")
    )
    return incoming.join(there, "path", "left").withColumn("status", status).drop("target_sha256")


def deletion_plan(copied: DataFrame, root: str) -> DataFrame:
    """Incoming files that a clean-up may remove: handled, and inside the incoming root. Nothing is deleted."""
    inside = F.startswith(F.col("path"), F.lit(root.rstrip("/") + "/")) & ~F.contains(F.col("path"), F.lit("/../"))
    return copied.filter(F.col("status").isin("copied", "duplicate") & inside).select("path")


#: rows that a call into Python puts into place
PLACED_ROWS = 1 << 13
_SLOT = "slot LONG, new LONG, origin STRING"


def _place(component: pd.DataFrame) -> pd.DataFrame:
    """Puts the new pages of one or more components into place one after the other; ``new`` is null where a page stays.

    Slots are found by html and by hash through heaps of their numbers, whose outdated entries are dropped when met.
    """
    ordered = component.sort_values(["fresh", "ordinal"])
    slots: list[list] = []
    where: dict[tuple[int, object], list[int]] = {}

    def first(column: int, value: object) -> int | None:
        heap = where.get((column, value), [])
        while heap and slots[heap[0]][column] != value:
            heapq.heappop(heap)
        return heap[0] if heap else None

    for fresh, ordinal, html, digest in zip(ordered["fresh"], ordered["ordinal"], ordered["html"], ordered["source_sha256"], strict=True):
        at = None
        if fresh:
            found = [n for c, v in ((3, html), (4, digest)) if v is not None and (n := first(c, v)) is not None]
            at = min(found, default=None)
        if at is None:
            at = len(slots)
            slots.append([ordinal, ordinal if fresh else None, "appended" if fresh else "kept", html, digest])
        else:
            slots[at][1:] = ordinal, "replaced" if slots[at][2] != "appended" else "appended", html, digest
        for c, v in ((3, html), (4, digest)):
            if v is not None:
                heapq.heappush(where.setdefault((c, v), []), at)
    return pd.DataFrame([x[:3] for x in slots], columns=["slot", "new", "origin"]).astype({"slot": "int64", "new": "Int64"})


def _without_overwritten(placed: DataFrame) -> DataFrame:
    """Of new pages that follow one another in a component with one hash, each under an html that nothing else has, every one
    takes the place of the one before. The first and the last of such a run are enough, so copies of one text, however
    many a batch has, leave two rows."""
    alone = placed.groupBy(F.col("html").alias("_html")).agg((F.count("*") == 1).alias("_alone"))
    marked = placed.join(alone, F.col("html") == F.col("_html"), "left").withColumn("_alone", F.coalesce("_alone", F.lit(False)))
    along = Window.partitionBy("component").orderBy("fresh", "ordinal")
    goes_on = F.col("fresh") & F.lag("fresh").over(along) & F.col("_alone") & (F.col("source_sha256") == F.lag("source_sha256").over(along))
    marked = marked.withColumn("_on", F.coalesce(goes_on, F.lit(False)))
    return marked.withColumn("_next", F.coalesce(F.lead("_on").over(along), F.lit(False))).where(~(F.col("_on") & F.col("_next"))).select(*placed.columns)


def upsert_pages(existing: DataFrame, new: DataFrame) -> DataFrame:
    """New pages, in their order, replace the first page that has the same html or the same source hash *by then*, else
    are appended. Both sides: ordinal, html, source_sha256 and the same further columns.

    What one new page does depends on those before it, but only within pages that share an html or a hash. So only new
    pages and the existing ones they can meet are looked at: those with an html of the batch, and of each hash of the
    batch the first page besides (it stays the first, as whatever replaces it by hash has that hash). They fall into
    components, each put into place in order, after runs of copies that only replace one another are cut to their ends.
    """
    fields = ("ordinal", "html", "source_sha256")
    fresh, old = new.select(*fields, F.lit(True).alias("fresh")), existing.select(*fields, F.lit(False).alias("fresh"))
    by_html = old.join(new.select("html").distinct(), "html", "left_semi").select(*fields, "fresh")
    others = old.join(new.select("html").distinct(), "html", "left_anti").join(new.select("source_sha256").distinct(), "source_sha256", "left_semi")
    first = others.groupBy("source_sha256").agg(F.min("ordinal").alias("ordinal"), F.min_by("html", "ordinal").alias("html")).select(*fields, F.lit(False).alias("fresh"))
    node = F.concat(F.when(F.col("fresh"), "n:").otherwise("o:"), F.col("ordinal"))
    rows = persist_table(fresh.unionByName(by_html).unionByName(first).withColumn("node", node), "rows")

    def shared(column: str) -> DataFrame:
        least = rows.filter(F.col(column).isNotNull()).groupBy(column).agg(F.min("node").alias("a"))
        return rows.join(least, column).select("a", F.col("node").alias("b"))

    parts = components(shared("html").unionByName(shared("source_sha256")))
    placed = rows.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    # components share no html and no hash, so a call may place many
    calls = max(1, rows.count() // PLACED_ROWS)
    ends = _without_overwritten(placed.select("component", "fresh", *fields)).withColumn("call", F.pmod(F.xxhash64("component"), F.lit(calls)))
    slots = persist_table(ends.groupBy("call").applyInPandas(
        lambda pages: _place(pages.astype({"html": object, "source_sha256": object}).where(pages.notna(), None)), _SLOT).filter("new is not null"), "slots")
    kept = existing.join(slots.filter("origin = 'replaced'").select(F.col("slot").alias("ordinal")), "ordinal", "left_anti")
    rest = [c for c in existing.columns if c != "ordinal"]
    written = new.select(F.col("ordinal").alias("new"), *rest).join(slots, "new").withColumn("ordinal", F.col("slot"))
    return kept.withColumn("origin", F.lit("kept")).unionByName(written.select(*existing.columns, "origin"))


def upsert_by_title(existing: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("section", "title")) -> DataFrame:
    """Full outer merge on the key: the new row where there is one."""
    rest = [c for c in existing.columns if c not in keys]
    old = existing.select(*keys, F.struct(*rest).alias("_old"))
    fresh = new.select(*keys, F.struct(*rest).alias("_new"))
    return old.join(fresh, list(keys), "full_outer").select(
        *keys, F.coalesce("_new", "_old").alias("_row")
    ).select(*keys, "_row.*").select(*existing.columns)


def prune_and_order(pages: DataFrame, manifest: DataFrame, scoped_sections: tuple[str, ...] | None = None) -> DataFrame:
    """Pages still in the manifest, with their manifest position.

    ``scoped_sections`` limits the pruning to those sections; pages of other sections stay, at the end.
    ``manifest``: html (unique), section_index, page_order.
    """
    places = manifest.select("html", "section_index", "page_order")
    placed = pages.join(places, "html", "left")
    keep = F.col("section_index").isNotNull()
    if scoped_sections is not None:
        keep = keep | ~F.col("section").isin(*scoped_sections)
    return placed.filter(keep).withColumns({
        "section_index": F.coalesce("section_index", F.lit(9999)), "page_order": F.coalesce("page_order", F.lit(9999)),
    })


def stale_pages(pages: DataFrame, state: DataFrame) -> DataFrame:
    """Remote pages to fetch: unknown, or modified since the last sync. No content is read to decide."""
    seen = state.select("id", F.col("modified").alias("_seen"))
    return pages.join(seen, "id", "left").filter(
        F.col("_seen").isNull() | (F.col("_seen") != F.col("modified"))
    ).drop("_seen")


def best_name_match(notebooks: DataFrame, wanted: str, name: str = "name", order: str = "ordinal") -> DataFrame:
    """Exact case-folded match first, else the first that contains the name."""
    from lorebase.functions.text import casefold

    folded = casefold(F.col(name))
    rank = F.when(folded == wanted.casefold(), 0).when(F.contains(folded, F.lit(wanted.casefold())), 1)
    return notebooks.withColumn("_rank", rank).filter(F.col("_rank").isNotNull()).orderBy("_rank", order).limit(1).drop("_rank")
