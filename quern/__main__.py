"""A command line over the library: ``python -m quern FOLDER COMMAND ...``, FOLDER being that of the indexes."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import search
from .operators.catalog import Catalog, IndexNotFound
from .operators.embed import HashingEmbedder
from .session import session
from .settings import Settings


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quern")
    p.add_argument("folder")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("list")
    for name, *args in (
        ("sources", "index"), ("read", "index", "source"), ("chunk", "index", "source", "n"), ("range", "index", "source"), ("query", "index", "question"),
        ("verify", "index"), ("suppress", "index"), ("lock", "index"), ("unlock", "index"), ("rename", "index", "to"), ("delete", "index"), ("remove", "index", "source"), ("add", "index", "documents"),
    ):
        c = sub.add_parser(name)
        for a in args:
            c.add_argument(a, **({"type": int} if a == "n" else {}))
        for option, kind in (("--context", int), ("--start", int), ("--count", int), ("--top-k", int), ("--filter", str)):
            c.add_argument(option, type=kind)
        c.add_argument("--json", action="store_true")
    return p


def run(spark: SparkSession, argv: list[str], settings: Settings | None = None) -> str:
    """What one command prints.  An unknown index gives the names there are."""
    a, s = parser().parse_args(argv), settings or Settings()
    catalog = Catalog(spark, a.folder)
    if a.command == "list":
        return "\n".join(f"{x['name']}  {x['n_chunks']} chunks  {x['n_files']} files{'  locked' if x['locked'] else ''}" for x in catalog.stats())
    if a.command == "rename":
        return catalog.rename(a.index, a.to) or f"{a.index} is {a.to} now"
    if a.command == "delete":
        return catalog.delete(a.index) or f"{a.index} is gone"
    if a.command == "add":
        from .sources.extract import book_documents
        from .streaming.ingest import append_batch

        docs = book_documents(spark, a.documents)
        index = catalog.get(a.index) if a.index in catalog.names() else catalog.new(a.index)
        append_batch(index, docs.where("full_text is not null"), HashingEmbedder(64), size=s.chunk_size, overlap=s.overlap, floor=s.min_chunk_length)
        return "\n".join([f"{index.meta()['n_files']} files"] + [f"{r['source']}: {r['error']}" for r in docs.where("error is not null").select("source", "error").collect()])
    index = catalog.get(a.index)
    if a.command in ("lock", "unlock", "suppress"):
        return getattr(index, a.command)() or f"{a.index}: {a.command}"
    if a.command == "remove":
        return ", ".join(f"{n} {k}" for k, n in sorted(index.remove_source(a.source).items()))
    if a.command == "verify":
        return "\n".join(f"{state}  {name}" for name, state in sorted(index.check(fast=False).items()))
    if a.command == "sources":
        rows = index.sources(a.filter).orderBy("source").collect()
        return "\n".join([f"{rows[0]['total']} sources" if rows else "no sources", *(f"{r['source']}  {r['n_chunks']} chunks" for r in rows)])
    if a.command == "read":
        rows = index.document(a.source).orderBy("source").collect()
        return "\n".join(f"=== {r['source']} ===\n\n{r['text']}" if r["found"] else f"not found: {r['asked']}; like it: {r['source']}" for r in rows)
    if a.command == "chunk":
        rows = index.chunk(a.source, a.n, a.context or 0).orderBy("pos").collect()
        return "\n\n".join(f"chunk {r['pos'] + 1}/{r['total']}{' <' if r['is_hit'] else ''}\n{r['text']}" if r["pos"] is not None else f"there are {r['total']} chunks" for r in rows) or "not found"
    if a.command == "range":
        r = index.range(a.source, a.start or 0, s.pick("top_k", a.count) if a.count else 10).first()
        return f"{r['text']}\n\n[{r['remaining']} chunks remain]" if r else "not found"
    asked = spark.createDataFrame([(1, a.question, a.filter)], "qid int, text string, source_filter string")
    sources = index.read("hashes").select(F.col("filename").alias("source")) if a.filter is None else None
    hits = index.ask(asked, HashingEmbedder(index.meta()["dim"] or 64), s.pick("top_k", a.top_k), context=a.context or 0, sources=sources)
    shown = (search.as_json if a.json else search.render)(hits).first()
    return shown[1] if shown else "no results"


if __name__ == "__main__":
    try:
        print(run(session("quern"), sys.argv[1:]))
    except IndexNotFound as e:
        sys.exit(str(e))
