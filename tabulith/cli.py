"""Command line: python -m tabulith.cli --uri PLACE COMMAND ..."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tabulith.catalog import CatalogError, NoSuchNamespace, NoSuchTable, load_catalog, to_identifier
from tabulith.plans.scan import SnapshotTable


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tabulith")
    p.add_argument("--uri", default="", help="where the catalog is")
    p.add_argument("--catalog", default="", help="its type, if the URI doesn't tell")
    p.add_argument("--credential", default="")
    p.add_argument("--warehouse", default="")
    p.add_argument("--output", choices=("text", "json"), default="text")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("list").add_argument("parent", nargs="?", default="")
    for name in ("location", "schema", "spec", "uuid"):
        sub.add_parser(name).add_argument("table")
    d = sub.add_parser("describe")
    d.add_argument("kind", nargs="?", choices=("namespace", "table"))
    d.add_argument("identifier")
    f = sub.add_parser("files")
    f.add_argument("table")
    f.add_argument("--history", action="store_true")
    r = sub.add_parser("rename")
    r.add_argument("source")
    r.add_argument("target")
    d = sub.add_parser("drop")
    d.add_argument("kind", choices=("namespace", "table"))
    d.add_argument("identifier")
    props = sub.add_parser("properties").add_subparsers(dest="action", required=True)
    for action in ("get", "set", "remove"):
        a = props.add_parser(action)
        a.add_argument("kind", choices=("namespace", "table"))
        a.add_argument("identifier")
        a.add_argument("name", nargs="?" if action == "get" else None)
        if action == "set":
            a.add_argument("value")
    return p


class Printer:
    def __init__(self, kind: str) -> None:
        self.json = kind == "json"

    def show(self, data: object, text: str | None = None) -> None:
        print(json.dumps(data) if self.json else text if text is not None else data)

    def pairs(self, props: dict[str, str]) -> None:
        width = max([3, *(len(k) for k in props)])
        self.show(props, "\n".join([f"{'key':<{width}} | value", "-" * (width + 8)] + [f"{k:<{width}} | {v}" for k, v in sorted(props.items())]))


def table_summary(t: SnapshotTable) -> dict:
    m = t.metadata
    return {
        "format-version": m.format_version,
        "metadata-location": t.metadata_location,
        "table-uuid": m.table_uuid,
        "last-updated-ms": m.last_updated_ms,
        "sort-order": m.sort_order.to_json(),
        "partition-spec": m.spec().to_json(),
        "schema": m.schema().to_json(),
        "current-snapshot": m.current_snapshot.to_json() if m.current_snapshot else None,
        "snapshots": [s.to_json() for s in m.snapshots],
        "properties": m.properties,
    }


def describe(t: SnapshotTable, out: Printer) -> None:
    m = t.metadata
    head = [("Table format version", m.format_version), ("Metadata location", t.metadata_location), ("Table UUID", m.table_uuid or "missing"), ("Last updated", m.last_updated_ms), ("Sort Order", m.sort_order), ("Partition Spec", m.spec())]
    lines = [f"{k:<21}| {v}" for k, v in head] + [m.schema().tree(), f"Current Snapshot     | {m.current_snapshot or ''}", "Snapshots"]
    lines += [f"  {snapshot_line(s)}" for s in m.snapshots] + ["Properties"] + [f"  {k} | {v}" for k, v in sorted(m.properties.items())]
    out.show(table_summary(t), "\n".join(lines))


def snapshot_line(s) -> str:
    return f"Snapshot {s.snapshot_id}" + ("" if s.schema_id is None else f", schema {s.schema_id}") + (f": {s.manifest_list}" if s.manifest_list else "")


def files(t: SnapshotTable, history: bool, out: Printer) -> None:
    """Snapshots, their manifests and all their entries, deleted ones too. Rows come to the driver one partition at a time."""
    m = t.metadata
    snaps = m.snapshots if history else [m.current_snapshot] if m.current_snapshot else []
    data, lines = [], [f"Snapshots: {'.'.join(t.identifier)}"]
    for s in snaps:
        lines.append("  " + snapshot_line(s))
        manifests: dict[str, list[str]] = {}
        if s.manifest_list:
            for r in t.manifests(s).select("manifest_path").toLocalIterator():
                manifests[r.manifest_path] = []
            for r in t.entries(s).select("manifest_path", "file_path").orderBy("manifest_path", F.col("file_path")).toLocalIterator():
                manifests[r.manifest_path].append(r.file_path)
        for path, entries in manifests.items():
            lines += [f"    Manifest: {path}"] + [f"      Datafile: {e}" for e in entries]
        data.append({"snapshot-id": s.snapshot_id, "manifests": manifests})
    out.show(data, "\n".join(lines))


def run(args: argparse.Namespace, spark: SparkSession) -> int:
    props = {k: v for k, v in (("type", args.catalog), ("credential", args.credential), ("warehouse", args.warehouse)) if v}
    out = Printer(args.output)
    try:
        cat = load_catalog(spark, "cli", args.uri, props)
        match args.command:
            case "list":
                found = cat.list_namespaces(to_identifier(args.parent) if args.parent else ())
                if not found and args.parent:
                    found = cat.list_tables(args.parent)
                out.show([".".join(x) for x in found], "\n".join(".".join(x) for x in found))
            case "location":
                out.show(cat.load_table(args.table).location)
            case "uuid":
                out.show(cat.load_table(args.table).metadata.table_uuid or "missing")
            case "schema":
                s = cat.load_table(args.table).metadata.schema()
                out.show(s.to_json(), s.tree())
            case "spec":
                s = cat.load_table(args.table).metadata.spec()
                out.show(s.to_json(), str(s))
            case "describe":
                _describe(cat, args, out)
            case "files":
                files(cat.load_table(args.table), args.history, out)
            case "rename":
                cat.rename_table(args.source, args.target)
                out.show(f"renamed {args.source} to {args.target}")
            case "drop":
                (cat.drop_table if args.kind == "table" else cat.drop_namespace)(args.identifier)
                out.show(f"dropped {args.identifier}")
            case "properties":
                return _properties(cat, args, out)
    except (CatalogError, NotImplementedError, ValueError, OSError) as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    return 0


def _describe(cat, args: argparse.Namespace, out: Printer) -> None:
    if args.kind != "table":
        try:
            out.pairs(cat.load_namespace_properties(args.identifier))
            return
        except NoSuchNamespace:
            if args.kind == "namespace":
                raise
    try:
        describe(cat.load_table(args.identifier), out)
    except NoSuchTable as e:
        raise CatalogError(f"there is no namespace or table {args.identifier}" if args.kind is None else str(e)) from e


def _properties(cat, args: argparse.Namespace, out: Printer) -> int:
    table = args.kind == "table"
    if args.action == "get":
        props = cat.load_table(args.identifier).metadata.properties if table else cat.load_namespace_properties(args.identifier)
        if args.name is None:
            out.pairs(props)
        elif args.name in props:
            out.show(props[args.name])
        else:
            print(f"could not find property {args.name} on {args.kind} {args.identifier}", file=sys.stderr)
            return 1
        return 0
    change = {"update": {args.name: args.value}} if args.action == "set" else {"remove": [args.name]}
    if table and not hasattr(cat, "update_table_properties"):
        raise NotImplementedError("this catalog can't change a table's properties")
    (cat.update_table_properties if table else cat.update_namespace_properties)(args.identifier, **change)
    out.show(f"{'updated' if args.action == 'set' else 'removed'} {args.name} on {args.identifier}")
    return 0


def main(argv: Sequence[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("tabulith").config("spark.ui.enabled", "false").getOrCreate()
    return run(args, spark)


if __name__ == "__main__":
    sys.exit(main())
