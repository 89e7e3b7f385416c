"""Command line: build-index, ask, search-pages, search-memory, ingest, nightly, manifest, rebuild-entries."""

from __future__ import annotations

import argparse

from lorebase import rules
from lorebase.operators import render, search
from lorebase.operators.indexing import union_sources
from lorebase.plans import ask, build_index, ingest, nightly
from lorebase.providers.offline import OfflineProvider
from lorebase.session import build_session, persist_table
from lorebase.sources.distilled import distillation_sources
from lorebase.sources.files import read_distillation, read_entries, read_html_tree, tree_manifest


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lorebase")
    commands = top.add_subparsers(dest="command", required=True)
    build = commands.add_parser("build-index", help="chunk and embed a table of source documents")
    build.add_argument("--sources", help="a table of source documents")
    build.add_argument("--distillation", help="a distillation; its pages become sources as well")
    build.add_argument("--html-root", help="the pages' own HTML, beside their distillation")
    build.add_argument("--index", required=True)
    build.add_argument("--version", required=True)
    build.add_argument("--previous")
    build.add_argument("--force", action="store_true", help="embed everything anew")
    build.add_argument("--no-embeddings", action="store_true")
    question = commands.add_parser("ask", help="answer a question from an index version")
    question.add_argument("--index", required=True)
    question.add_argument("--top-k", type=int, default=rules.DEFAULT_TOP_K)
    question.add_argument("question")
    pages = commands.add_parser("search-pages", help="weighted field search over distilled pages")
    pages.add_argument("--distillation", required=True)
    pages.add_argument("--top-k", type=int, default=rules.PAGE_TOP_K)
    pages.add_argument("query")
    memory = commands.add_parser("search-memory", help="search Markdown entries")
    memory.add_argument("--entries", required=True)
    memory.add_argument("query")
    imported = commands.add_parser("ingest", help="turn exported files into draft entries")
    imported.add_argument("files")
    imported.add_argument("--day", required=True)
    imported.add_argument("--out", required=True)
    imported.add_argument("--dry-run", action="store_true")
    maintain = commands.add_parser("nightly", help="compare an HTML tree with the last run, log changes, distil, save state")
    maintain.add_argument("--html-root", required=True)
    maintain.add_argument("--tables", required=True)
    maintain.add_argument("--at", required=True, help="when the changes were detected")
    listed = commands.add_parser("manifest", help="write the manifest of an HTML tree as a table and as index pages")
    listed.add_argument("--html-root", required=True)
    listed.add_argument("--out", required=True)
    entries = commands.add_parser("rebuild-entries", help="index memory entries into a versioned table")
    entries.add_argument("--entries", required=True)
    entries.add_argument("--table", required=True)
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = build_session()
    if args.command == "build-index":
        provider = None if args.no_embeddings else OfflineProvider()
        given = [spark.read.parquet(args.sources)] if args.sources else []
        if args.distillation:
            html = read_html_tree(spark, args.html_root) if args.html_root else None
            given.append(distillation_sources(read_distillation(spark, args.distillation), html))
        if not given:
            raise SystemExit("build-index needs --sources or --distillation")
        sources = union_sources(*given)
        build_index.build_index(spark, sources, args.index, args.version, provider, args.previous, args.force).show(truncate=False)
    elif args.command == "ask":
        index = build_index.open_index(spark, args.index)
        print(ask.render(ask.ask(index, args.question, OfflineProvider(), args.top_k)), end="")
    elif args.command == "search-pages":
        hits = search.rank_pages(read_distillation(spark, args.distillation), args.query, "html", top_k=args.top_k)
        hits.select("score", "section", "title", "html").show(args.top_k, truncate=False)
    elif args.command == "search-memory":
        hits = search.rank_memory(read_entries(spark, args.entries), args.query)
        hits.select("points", "id", "title", "path", "snippet").show(rules.MEMORY_TOP_K, truncate=False)
    elif args.command == "nightly":
        versions = nightly.run_nightly(spark, tree_manifest(read_html_tree(spark, args.html_root)), args.tables, args.at)
        print(", ".join(f"{name} {version}" for name, version in versions.items()))
    elif args.command == "manifest":
        manifest = persist_table(tree_manifest(read_html_tree(spark, args.html_root)), "manifest")
        manifest.drop("text").write.mode("overwrite").parquet(f"{args.out}/table")
        render.write_fragments(render.manifest_fragments(manifest), f"{args.out}/index")
    elif args.command == "rebuild-entries":
        print(nightly.rebuild_entries(spark, args.entries, args.table))
    else:
        entries, failures = ingest.ingest_exports(spark, args.files, args.day)
        if args.dry_run:
            entries.groupBy().count().show()
        else:
            entries.write.mode("append").parquet(args.out)
        failures.show(truncate=False)


if __name__ == "__main__":
    main()
