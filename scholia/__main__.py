"""Command line: build an index, search it, explain a score."""

from __future__ import annotations

import argparse

from scholia.operators import index, search
from scholia.session import build_session
from scholia.sources import readers, sinks

SCHEMAS = {"works": ("WORKS", readers.work_articles), "abstracts": ("ABSTRACTS", readers.abstract_articles), "chunks": ("CHUNKS", readers.chunk_articles)}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="scholia")
    commands = p.add_subparsers(dest="command", required=True)
    b = commands.add_parser("build", help="index Parquet files")
    b.add_argument("--articles", required=True)
    b.add_argument("--index", required=True)
    b.add_argument("--schema", choices=sorted(SCHEMAS), default="works")
    b.add_argument("--require-body", action="store_true")
    b.add_argument("--limit", type=int)
    b.add_argument("--buckets", type=int, default=64)
    for name in ("search", "explain"):
        s = commands.add_parser(name)
        s.add_argument("--index", required=True)
        s.add_argument("--query", required=True)
        s.add_argument("--top", type=int, default=10)
        s.add_argument("--sort", choices=[search.RELEVANCE, search.CITATIONS, search.YEAR], default=search.RELEVANCE)
        s.add_argument("--year-min", type=int)
        s.add_argument("--year-max", type=int)
        s.add_argument("--prior", type=float, default=0.0)
        s.add_argument("--id", help="the document whose score is explained")
    return p


def main(args: list[str] | None = None, spark=None) -> list[str]:
    """Run a command; its lines are printed and returned."""
    from scholia import schemas

    a = parser().parse_args(args)
    spark = spark or build_session()
    if a.command == "build":
        schema, shape = SCHEMAS[a.schema]
        wanted = sinks.stamp(spark, a.articles, a.schema, require_body=a.require_body, limit=a.limit, buckets=a.buckets)
        if sinks.is_current(spark, f"{a.index}/stamp.json", wanted):
            lines = ["current"]
        else:
            rows = readers.parquet(spark, a.articles, getattr(schemas, schema))
            index.build(shape(rows.limit(a.limit) if a.limit else rows), require_body=a.require_body).save(a.index, a.buckets)
            import json

            sinks.write_text(spark, f"{a.index}/stamp.json", json.dumps(wanted))
            lines = ["built"]
    else:
        ix = index.Index.load(spark, a.index)
        q = spark.createDataFrame([("q", a.query)], "query_id string, query_text string")
        if a.command == "search":
            found = search.search(ix, q, a.top, search.Filters(a.year_min, a.year_max), sort=a.sort, prior=a.prior).orderBy("rank").collect()
            lines = [f"{r['rank']}\t{r.score:.4f}\t{r.id}\t{r.title or ''}" for r in found]
        else:
            parts = search.breakdown(ix, q)
            parts = parts.where(parts.id == a.id) if a.id else parts
            lines = [f"{r.id}\t{r.term}\t{r.field}\t{r.tf}\t{r.score:.4f}" for r in parts.orderBy("id", "place", "field").limit(a.top).collect()]
    print("\n".join(lines))
    return lines


if __name__ == "__main__":
    main()
