"""The command line: ``python -m lexiloom.cli --root FOLDER COMMAND``."""

from __future__ import annotations

import argparse
import json
import sys
from typing import Any, TextIO

from pyspark.sql import SparkSession

from lexiloom.engine import Engine
from lexiloom.runtime import Shutdown
from lexiloom.settings import Settings, load_env
from lexiloom.sources.http import Http, HttpChat, HttpEmbedder


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lexiloom", description="Retrieval analytics over crawled documentation.")
    p.add_argument("--root", required=True, help="the folder of the index")
    p.add_argument("--env-file", default=".env")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, about: str, *options: tuple[tuple[str, ...], dict[str, Any]], as_json: bool = False) -> None:
        c = sub.add_parser(name, help=about)
        for names, how in options:
            c.add_argument(*names, **how)
        if as_json:
            c.add_argument("--json", action="store_true")

    flag = {"action": "store_true"}
    command(
        "ingest", "crawl a site, or read a table of pages", (("source",), {"help": "an address, or a Parquet folder of page_id, url, html"}), (("--max-pages",), {"type": int}), (("--unlimited",), flag),
        (("--ignore-robots",), flag), (("--fresh",), flag), (("--basic-auth-user",), {}), (("--basic-auth-pass",), {}), (("--basic-auth-token",), {}), as_json=True,
    )
    command("query", "answer a question", (("question",), {}), (("--top-k",), {"type": int}), as_json=True)
    command("bm25", "search by words", (("question",), {}), (("--top-k",), {"type": int, "default": 10}), as_json=True)
    command("rebuild-index", "index all chunks anew")
    command("extract-entities", "read pages for entities", (("--page-id",), {"type": int}), as_json=True)
    command("summarize-pages", "summaries of pages", (("--page-id",), {"type": int}), (("--force",), flag), as_json=True)
    command("rebuild-summaries", "summaries of pages, systems and everything", as_json=True)
    command("export-graph", "entities and relationships as JSON", (("-o", "--output"), {"required": True}), as_json=True)
    command("validate", "look for rows at fault", (("--fix",), flag), as_json=True)
    command("stats", "how much is indexed", as_json=True)
    command("interactive", "questions from the keyboard")
    command("health", "whether all parts work", as_json=True)
    command("analytics", "numbers of the query log", (("--export",), {}), (("--limit",), {"type": int}), as_json=True)
    command("cache", "the cache of answers", (("action",), {"choices": ("stats", "clear")}), as_json=True)
    command("backfill", "embed chunks without a vector", (("--batch-size",), {"type": int}), (("--force",), flag), as_json=True)
    command("crawl-sessions", "crawls and how far they got", as_json=True)
    command("resume-embeddings", "go on with embedding", (("--page-id",), {"type": int}), (("--batch-size",), {"type": int}), as_json=True)
    return p


def shown_answer(got: dict[str, Any]) -> str:
    """An answer for reading: itself, its confidence in whole percent, and its sources."""
    lines = [got.get("answer") or "There is no answer.", "", f"Confidence: {int((got.get('confidence') or 0) * 100)}%"]
    if got.get("sources"):
        lines += ["", "Sources:", *[f"- {s}" for s in got["sources"]]]
    return "\n".join(lines)


def shown_stats(stats: dict[str, Any]) -> str:
    return "\n".join(["Index", "-----", *[f"{k.replace('_', ' ').capitalize()}: {v}" for k, v in stats.items()]])


def show(value: Any, out: TextIO, as_json: bool) -> None:
    if as_json:
        print(json.dumps(value, ensure_ascii=False, default=str), file=out)
    elif isinstance(value, dict):
        for k, v in value.items():
            print(f"{k}: {v}", file=out)
    elif isinstance(value, list):
        for v in value:
            print(v if isinstance(v, str) else "  ".join(f"{k}={x}" for k, x in v.items()), file=out)
    else:
        print(value, file=out)


def listed(engine: Engine, question: str, k: int) -> list[dict[str, Any]]:
    """What a search by words finds, with addresses and contents."""
    asked = engine.spark.createDataFrame([(0, question)], "query_id long, text string")
    found = engine.search(asked, k).join(engine.searched, "doc_id").orderBy("rank").collect()
    return [{"chunk_id": r["doc_id"], "score": round(r["score"], 4), "content": r["content"], "heading_path": r["heading_path"], "url": r["page_url"]} for r in found]


def parse_line(line: str) -> tuple[str, str]:
    """Of a line at the prompt: quit, help, stats, cache, empty, or query and its text."""
    word = line.strip()
    low = word.lower()
    if not word:
        return "empty", ""
    if low in ("quit", "exit", "q"):
        return "quit", ""
    if low in ("help", "stats", "cache"):
        return low, ""
    return "query", word.removeprefix("query ").strip()


def interactive(engine: Engine, lines: TextIO, out: TextIO) -> None:
    for line in lines:
        kind, text = parse_line(line)
        if kind == "quit":
            return
        if kind == "help":
            print("A question, or: stats, cache, help, quit", file=out)
        elif kind == "stats":
            print(shown_stats(engine.stats()), file=out)
        elif kind == "cache":
            show(engine.cache.stats(), out, False)
        elif kind == "query":
            try:
                got = engine.query(text)
                print(shown_answer(got), file=out)
            except ValueError as e:
                print(e, file=out)


def run(engine: Engine, args: argparse.Namespace, out: TextIO = sys.stdout, lines: TextIO = sys.stdin) -> int:
    """Does what the arguments say; 0, or 1 if something is at fault."""
    as_json, c = getattr(args, "json", False), args.command
    if c == "ingest":
        if "://" in args.source and args.source.startswith("http"):
            show(engine.crawl(args.source, sys.maxsize if args.unlimited else args.max_pages, args.ignore_robots, args.fresh), out, as_json)
        else:
            pages = engine.spark.read.parquet(args.source)
            show(engine.ingest(pages if args.unlimited or not args.max_pages else pages.orderBy("page_id").limit(args.max_pages)), out, as_json)
    elif c == "query":
        if engine.embedder is None and engine.chat is None and not as_json:
            for r in listed(engine, args.question, args.top_k or engine.settings.top_k_final):
                print(f"[{r['score']:.4f}] {r['content'][:200]}", file=out)
        else:
            got = engine.query(args.question, args.top_k)
            show(got if as_json else shown_answer(got), out, as_json)
    elif c == "bm25":
        rows = listed(engine, args.question, args.top_k)
        show(rows if as_json else [f"[{r['score']:.4f}] {r['heading_path'] or ''} {r['content'][:200]}" for r in rows], out, as_json)
    elif c == "rebuild-index":
        show({"indexed": engine.rebuild_index()}, out, False)
    elif c == "extract-entities":
        show(engine.extract_entities(page_id=args.page_id), out, as_json)
    elif c == "summarize-pages":
        engine.rebuild_summaries(args.force)
        rows = engine.page_summaries()
        rows = rows if args.page_id is None else rows.filter(rows["page_id"] == args.page_id)
        show({"summarized": rows.filter("summary <> ''").count(), "pages": rows.count()}, out, as_json)
    elif c == "rebuild-summaries":
        got = engine.rebuild_summaries()
        show(got, out, as_json)
        return 1 if got["errors"] else 0
    elif c == "export-graph":
        show(engine.export_graph(args.output), out, as_json)
    elif c == "validate":
        found = engine.validate(args.fix)
        show(found, out, as_json)
        return 1 if any(found.values()) and not args.fix else 0
    elif c == "stats":
        got = engine.stats()
        show(got if as_json else shown_stats(got), out, as_json)
    elif c == "interactive":
        interactive(engine, lines, out)
    elif c == "health":
        got = engine.health()
        show(got if as_json else [f"{r['name']}: {r['status']} ({r['message']})" for r in got["checks"]], out, as_json)
        return 0 if got["status"] == "healthy" else 1
    elif c == "analytics":
        if args.export:
            show({"exported": engine.export_log(args.export, args.limit)}, out, as_json)
        else:
            show(engine.analytics(), out, as_json)
    elif c == "cache":
        if args.action == "clear":
            engine.cache.clear()
        show(engine.cache.stats(), out, as_json)
    elif c == "backfill":
        show(engine.backfill(args.force), out, as_json)
    elif c == "crawl-sessions":
        show([r.asDict() for r in engine.sessions.listed().collect()], out, as_json)
    elif c == "resume-embeddings":
        show(engine.resume_embeddings(args.page_id), out, as_json)
    return 0


def settings_of(args: argparse.Namespace) -> Settings:
    import dataclasses

    s = Settings.from_env()
    if getattr(args, "batch_size", None):
        s = dataclasses.replace(s, embedding_batch_size=args.batch_size)
    given = {f"basic_auth_{n}": v for n, v in (("username", getattr(args, "basic_auth_user", None)), ("password", getattr(args, "basic_auth_pass", None)), ("token", getattr(args, "basic_auth_token", None))) if v}
    return dataclasses.replace(s, basic_auth_enabled=True, **given) if given else s


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    load_env(args.env_file)
    s = settings_of(args)
    spark = SparkSession.builder.appName("lexiloom").getOrCreate()
    keyed = lambda key: Http(headers={"Authorization": f"Bearer {key}"})
    embedder = HttpEmbedder(s.vector_api_endpoint, keyed(s.vector_api_key)) if s.ai_enabled and s.vector_api_endpoint else None
    chat = HttpChat(s.chat_api_endpoint, keyed(s.chat_api_key)) if s.ai_enabled and s.chat_api_endpoint else None
    shutdown = Shutdown().install()
    shutdown.register(spark.stop)
    try:
        return run(Engine(spark, args.root, embedder, chat, s), args)
    except KeyboardInterrupt:
        return 130
    finally:
        shutdown.cleanup()
        shutdown.restore()


if __name__ == "__main__":
    sys.exit(main())
