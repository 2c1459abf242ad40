"""Command line: create, add, search, delete, merge. One line of JSON out; errors on stderr with status 2."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import SparkSession

from .errors import SearchError
from .schema import Schema
from .sources.store import Index


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodeseek", description="Full-text indexes on Spark")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *given: tuple) -> None:
        c = sub.add_parser(name)
        for flags, options in given:
            c.add_argument(flags, **options)

    index = ("index", {})
    command("create", index, ("--schema", {"required": True, "type": Path}))
    command("add", index, ("documents", {"nargs": "+", "type": Path}))
    command("search", index, ("query", {}), ("--default-field", {"required": True}), ("--top-k", {"type": int, "default": 10}), ("--highlight", {"action": "append", "default": []}))
    command("delete", index, ("field", {}), ("term", {}))
    command("merge", index, ("segments", {"nargs": "+", "type": int}))
    return p


def json_object(path: Path, what: str) -> Mapping[str, object]:
    value = json.loads(path.read_text(encoding="utf-8"))
    if not isinstance(value, dict):
        raise ValueError(f"{what} must be a JSON object: {path}")
    return value


def run(spark: SparkSession, a: argparse.Namespace) -> dict:
    if a.command == "create":
        fields = json_object(a.schema, "a schema").get("fields")
        if not isinstance(fields, dict) or not all(isinstance(f, dict) for f in fields.values()):
            raise ValueError("a schema must have fields, each a JSON object")
        Index.create(spark, a.index, Schema.from_dict(fields)).close()
        return {"index": a.index, "status": "created"}
    with Index.open(spark, a.index) as index:
        if a.command == "search":
            with index.open_reader() as reader:
                found = reader.search_text(a.query, a.default_field, a.top_k, tuple(a.highlight))
            return {"total_hits": found.total_hits, "hits": [{"score": h.score, "segment_generation": h.segment_generation, "local_doc_id": h.local_doc_id, "stored_fields": dict(h.stored_fields), "highlights": dict(h.highlights)} for h in found.hits]}
        with index.writer() as writer:
            if a.command == "add":
                for path in a.documents:
                    writer.add_document(**json_object(path, "a document"))
                return {"added": len(a.documents), "commit_generation": writer.commit().commit_generation}
            if a.command == "delete":
                n = writer.delete_by_term(a.field, a.term)
                return {"deleted": n, "commit_generation": writer.commit().commit_generation}
            made = writer.merge(a.segments)
            return {"merged_segment_generation": made.generation, "commit_generation": writer.commit().commit_generation}


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    a = arguments().parse_args(argv)
    spark = spark or SparkSession.builder.appName("lodeseek").getOrCreate()
    try:
        print(json.dumps(run(spark, a), sort_keys=True, separators=(",", ":")))
    except (SearchError, ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    return 0
