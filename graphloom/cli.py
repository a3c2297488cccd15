"""Commands over a graph in a folder of snapshots: python -m graphloom [--graph FOLDER] --schema FILE COMMAND ...

The folder is that of --graph, else of the variable GRAPHLOOM_HOME, else .graphloom in the user's home."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .errors import EngineError, GraphError, NotFound, StorageError, ValidationError
from .filters import pairs
from .operators import changes
from .operators.graph import Graph, compact
from .schema import Schema
from .sources import transcripts
from .sources.snapshots import Store, export, export_json, import_json, load


def reference(text: str) -> tuple[str, int]:
    """Kind:id"""
    kind, sep, number = text.rpartition(":")
    if not sep or not kind or not number.isdecimal():
        raise ValidationError(f"not Kind:id: {text!r}")
    return kind, int(number)


def _json(values: dict[str, object]) -> str:
    return json.dumps({k: v for k, v in sorted(values.items()) if v is not None}, ensure_ascii=False)


def _properties(row: Row) -> dict:
    """A node's properties; malformed ones are none."""
    try:
        found = json.loads(row["properties"] or "{}")
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}


def lines(nodes: DataFrame, args: argparse.Namespace, g: Graph) -> list[str]:
    """Nodes, which the command has limited, in the form asked for: json before quiet before full before compact."""
    rows = nodes.withColumn("__line", compact()).collect()
    if args.json:
        return [json.dumps([{"id": r["id"], "kind": r["kind"], "properties": _properties(r), "created_at": str(r["created_at"]), "updated_at": str(r["updated_at"])} for r in rows], indent=2, ensure_ascii=False)]
    if args.quiet:
        return [str(r["id"]) for r in rows]
    if not args.full:
        return [r["__line"] for r in rows]
    out = []
    for r in rows:
        out.append(r["__line"])
        own = [f"{k}={v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)}" for k, v in sorted(_properties(r).items()) if k not in ("title", "name")]
        out += [f"  {'  '.join(own)}  created={str(r['created_at'])[:10]}"] if own else []
        out += ["  " + e for e in edge_lines(g.grouped(r["id"]))]
    return out


def edge_lines(grouped: DataFrame) -> list[str]:
    """A line for each direction and edge kind: outgoing first."""
    rows = grouped.orderBy(F.desc("direction"), "kind").collect()
    return [(f">{r['kind']}> " if r["direction"] == "out" else f"<{r['kind']}< ") + r["others"] for r in rows]


def stat_lines(g: Graph) -> list[str]:
    """Counts of nodes, then of edges: all (*), then by kind, the largest first."""
    found = {(r["what"], r["kind"]): r["n"] for r in g.stats().collect()}
    out = []
    for what in ("node", "edge"):
        kinds = sorted(((kind, n) for (w, kind), n in found.items() if w == what and kind), key=lambda x: (-x[1], x[0]))
        out += [f"{what} {kind} {n}" for kind, n in [("*", found.get((what, None), 0)), *kinds]]
    return out


def home() -> str:
    """Where the graph is if no command says it."""
    folder = os.environ.get("GRAPHLOOM_HOME") or os.path.join(os.path.expanduser("~"), ".graphloom")
    if folder.startswith("~"):
        raise StorageError("there is no home folder; give --graph")
    return folder if ":" in folder else f"file://{folder}"


#: Commands with their arguments (*: any number) and options (a number, a flag, or text with its default).
COMMANDS = {
    "find": ("kind filters*", {"order": None, "limit": 30}), "get": ("ref", {}), "edges": ("ref", {"kind": None, "out": False, "in": False}),
    "count": ("kind filters*", {"by": None}), "kinds": ("", {}), "stats": ("", {}), "walk": ("ref path filters*", {"limit": 30}), "path": ("ref target", {"depth": 3, "via": None}),
    "search": ("query", {"kind": None, "limit": 10, "fused": False}), "related": ("ref", {"edge": "HAS_TOPIC", "limit": 30}), "counts": ("kind by", {"unit": "month"}),
    "sessions": ("", {"tool": None, "project": None, "branch": None, "limit": 30}), "timeline": ("", {"project": None, "last": 30, "follows": None}),
    "schema": ("kind*", {}), "export": ("path", {"format": "parquet"}), "push": ("prefix", {}), "seed": ("folder prefix", {}),
    "add": ("kind values*", {}), "set": ("ref values*", {}), "rekind": ("ref kind", {}), "rm": ("ref", {}), "link": ("ref edge target values*", {}),
    "edge-set": ("ref edge target values*", {}), "unlink": ("ref edge target", {}), "pull": ("prefix", {"id-first": False}), "import": ("path", {"format": "parquet"}),
    "ingest": ("path", {"tool": None}), "register": ("", {"tool": None, "session-id": None, "model": None, "project": None, "branch": None, "title": None}),
    "define": ("kind values*", {}), "extend": ("kind values*", {}),
}
CHANGES = ("add", "set", "rekind", "rm", "link", "edge-set", "unlink", "pull", "import", "ingest", "register")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="graphloom", description=__doc__)
    top.add_argument("--graph", default=None, help="folder of snapshots")
    top.add_argument("--schema", required=True, help="TOML file")
    for flag in ("json", "quiet", "full"):
        top.add_argument(f"--{flag}", action="store_true")
    commands = top.add_subparsers(dest="command", required=True)
    for name, (places, options) in COMMANDS.items():
        sub = commands.add_parser(name)
        for place in places.split():
            sub.add_argument(place.rstrip("*"), **({"nargs": "*"} if place.endswith("*") else {}))
        for option, default in options.items():
            sub.add_argument(f"--{option}", **({"action": "store_true"} if default is False else {"type": int, "default": default} if isinstance(default, int) else {"default": default}))
    return top


def _named(args: argparse.Namespace, *names: str) -> dict[str, str]:
    return {n: getattr(args, n) for n in names if getattr(args, n) is not None}


def _read(g: Graph, args: argparse.Namespace, store: Store) -> list[str]:
    """Output of a command that changes nothing."""
    ref = reference(args.ref) if "ref" in args else None
    if args.command == "find":
        return lines(g.find(args.kind, *args.filters, order=args.order, limit=args.limit), args, g)
    if args.command == "get":
        g.require(*ref)
        args.full = not (args.json or args.quiet)
        return lines(g.resolve(*ref), args, g)
    if args.command == "edges":
        return edge_lines(g.grouped(ref[1], outgoing=args.out, incoming=getattr(args, "in"), kind=args.kind))
    if args.command == "count":
        rows = g.count(args.kind, *args.filters, by=args.by).collect()
        return [str(r["n"]) if args.by is None else f"{'' if r['value'] is None else r['value']} {r['n']}" for r in rows]
    if args.command == "kinds":
        return [f"{r['kind']} {r['n']}" for r in g.kinds().collect()]
    if args.command == "stats":
        return [*stat_lines(g), f"bytes {store.size()}"]
    if args.command == "walk":
        return lines(g.walk(ref[1], args.path, *args.filters, limit=args.limit), args, g)
    if args.command == "path":
        target = reference(args.target)[1]
        found = [r["line"] for r in g.render(g.path(ref[1], target, args.depth, args.via.split(",") if args.via else None)).collect()]
        return found or [f"no path of {args.depth} hops or fewer"]
    if args.command == "search":
        found = g.rrf3(args.query, args.kind, args.limit) if args.fused else g.search(args.query, args.kind, args.limit)
        return [f'{r["kind"]}:{r["id"]} "{r["label"]}"' for r in found.collect()]
    if args.command == "related":
        found = g.related(ref[1], args.edge, args.limit)
        return lines(g.nodes.join(found, "id").orderBy(F.desc("shared"), "id"), args, g)
    if args.command == "counts":
        return [f"{r['at']} {r['n']}" for r in g.timeline(args.kind, args.by, args.unit).collect()]
    if args.command == "sessions":
        return lines(transcripts.sessions(g, limit=args.limit, **_named(args, "tool", "project", "branch")), args, g)
    if args.command == "timeline":
        rows = transcripts.timeline(g, last=args.last, follows=args.follows, **_named(args, "project")).withColumn("__line", compact()).collect()
        return [line for r in rows for line in (f"{r['day']}  {r['__line']}", *[f"  {args.follows} {r['kind']}:{i}" for i in r["follows"]])]
    if args.command == "export":
        if args.format not in ("parquet", "json"):
            raise ValidationError(f"no format: {args.format}")
        return [(export if args.format == "parquet" else export_json)(g, args.path)]
    rows = g.schema.describe(g.spark).collect()
    return [f"{r['what']} {r['kind']}{' ' + r['ends'] if r['ends'] else ''}{f' {r.property}: {r.type}' if r['property'] else ''}" for r in rows if not args.kind or r["kind"] in args.kind]


def _change(g: Graph, args: argparse.Namespace):
    """What ``Store.change`` takes: the graph after a command, or the nodes and edges that it adds."""
    ref = reference(args.ref) if "ref" in args else None
    target = reference(args.target)[1] if "target" in args else None
    if args.command == "add":
        values = pairs(args.values, g.schema.node(args.kind))
        return changes.new_nodes(g, g.spark.createDataFrame([(args.kind, _json(values))], "kind string, properties string")), None
    if args.command == "set":
        return changes.set_node(g, *ref, pairs(args.values, g.schema.node(ref[0])))
    if args.command == "rekind":
        return changes.rekind(g, *ref, args.kind)
    if args.command == "rm":
        return changes.remove_node(g, *ref)
    if args.command == "link":
        values = _json(pairs(args.values, g.schema.edge(args.edge).props))
        return None, changes.new_edges(g, g.spark.createDataFrame([(args.edge, ref[1], target, values)], "kind string, from_id bigint, to_id bigint, properties string"))
    if args.command == "edge-set":
        return changes.set_edge(g, ref[1], args.edge, target, pairs(args.values, g.schema.edge(args.edge).props))
    if args.command == "unlink":
        return changes.unlink(g, ref[1], args.edge, target)
    return changes.merge_parts(g, _remote(g, args), getattr(args, "id_first", False))


def _remote(g: Graph, args: argparse.Namespace) -> Graph:
    """The graph that a command brings in."""
    if args.command == "pull":
        there = Store(g.spark, args.prefix, g.schema)
        if there.latest()[0] == 0:
            raise NotFound(f"no snapshot in {args.prefix}")
        return there.load()
    if args.command == "import":
        return import_json(g.spark, args.path, g.schema) if args.format == "json" else load(g.spark, args.path, g.schema)
    if args.command == "ingest":
        return transcripts.as_graph(transcripts.read_jsonl(g.spark, args.path, args.tool), g.schema)
    row = (args.session_id, args.tool, args.title, None, None, args.project, args.branch, args.model)
    return transcripts.as_graph(g.spark.createDataFrame([row], transcripts.SESSION), g.schema)


def _defined(schema: Schema, args: argparse.Namespace) -> tuple[Schema, str]:
    """The schema after define or extend, and what was done. Arguments are property:type."""
    props = dict(v.partition(":")[::2] for v in args.values)
    if args.command == "define" and args.kind in schema.nodes:
        raise ValidationError(f"{args.kind} is there already")
    if args.command == "extend":
        schema.node(args.kind)
        if needed := [p for p, t in props.items() if not t.strip().endswith("?")]:
            raise ValidationError(f"only optional properties can be added: {', '.join(needed)}")
    return schema.with_kind(args.kind, props), f"{args.command} {args.kind} {len(props)}"


def run(spark: SparkSession, argv: list[str]) -> list[str]:
    """What a command prints. Changes make a new snapshot, which is the graph from then on."""
    args = parser().parse_args(argv)
    schema = Schema.read(args.schema)
    if args.command in ("define", "extend"):
        after, said = _defined(schema, args)
        with open(args.schema, "w", encoding="utf-8") as f:
            f.write(after.toml())
        return [said]
    store = Store(spark, args.graph or home(), schema)
    if args.command in ("push", "seed"):
        g = store.load() if args.command == "push" else Store(spark, args.folder, schema).load()
        Store(spark, args.prefix, schema).change(lambda _: g)
        return [line.replace(" * ", " ") for line in stat_lines(g) if " * " in line]
    if args.command not in CHANGES:
        return _read(store.load(), args, store)
    g = store.change(lambda before: _change(before, args))
    if args.command == "add":
        return lines(g.by_id(g.spans[args.kind][1]), args, g)
    return lines(g.find("Session", limit=1), args, g) if args.command == "register" else ["ok"]


def main(argv: list[str] | None = None) -> int:
    spark = SparkSession.builder.appName("graphloom").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        try:
            print("\n".join(run(spark, sys.argv[1:] if argv is None else argv)))
        except PySparkException as e:
            raise EngineError(str(e).splitlines()[0]) from e
    except GraphError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0
