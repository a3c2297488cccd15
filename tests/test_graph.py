"""Seeds with the sets that they pin, and rules of schema, filters and changes."""

import json

import pytest

from graphloom import errors, filters
from graphloom.errors import Conflict, NotFound, SchemaError, ValidationError
from graphloom.functions import text
from graphloom.functions.text import jaro_winkler_bytes
from graphloom.operators import changes
from graphloom.operators.graph import Graph, parse_path
from graphloom.schema import Schema
from graphloom.sources.snapshots import Store, export, export_json, import_json, load

SCHEMA = Schema.parse("""
[nodes.Voyage]
title = "string"
drive = "enum:sail,steam"
turns = "int?"
cost = "float?"
done = "bool?"
at = "timestamp?"
[nodes.Cargo]
name = "string"
[nodes.Fleet]
name = "string"
[nodes.Harbour]
name = { type = "string", hint = "as on the chart" }
[edges.CARRIES]
from = "Voyage"
to = "Cargo"
[edges.OF_FLEET]
from = "Voyage"
to = "Fleet"
[edges.FROM_HARBOUR]
from = "Voyage"
to = "Harbour"
[edges.RETURNS]
from = "Voyage"
to = "Voyage"
reason = "string?"
[natural_keys]
Cargo = ["name"]
Voyage = ["title"]
""")
NORTH, SPICE, WINTER, SALT, PEPPER, TIMBER, REDS, QUAY = range(1, 9)


@pytest.fixture(scope="module")
def graph(spark):
    session = lambda t, **more: ("Voyage", json.dumps({"title": t, "drive": "sail"} | more))
    rows = [session("North run", turns=3, cost=1.5, done=True, at="2026-01-02 03:04:05"), session("Spice trade", turns=12), session("Winter haul", drive="steam", at="no time"),
            ("Cargo", '{"name":"salt"}'), ("Cargo", '{"name":"pepper"}'), ("Cargo", '{"name":"timber"}'), ("Fleet", '{"name":"reds"}'), ("Harbour", '{"name":"quay"}')]
    nodes = spark.createDataFrame([(i, k, p) for i, (k, p) in enumerate(rows, 1)], "id bigint, kind string, properties string")
    nodes = nodes.selectExpr("id", "kind", "properties", "timestamp_ntz'2026-01-01 00:00:00' AS created_at", "timestamp_ntz'2026-01-01 00:00:00' AS updated_at")
    g = Graph.empty(spark, SCHEMA).of(nodes=nodes)
    links = [("CARRIES", NORTH, SALT), ("CARRIES", NORTH, PEPPER), ("CARRIES", SPICE, PEPPER), ("CARRIES", WINTER, TIMBER), ("OF_FLEET", NORTH, REDS),
             ("OF_FLEET", SPICE, REDS), ("OF_FLEET", WINTER, REDS), ("FROM_HARBOUR", NORTH, QUAY), ("RETURNS", NORTH, SPICE)]
    return changes.link(g, spark.createDataFrame([(*e, None) for e in links], "kind string, from_id bigint, to_id bigint, properties string"))


def ids(df):
    return sorted(r["id"] for r in df.collect())


@pytest.mark.parametrize(
    "start, path, expected",
    [
        (NORTH, "CARRIES", [SALT, PEPPER]),
        (PEPPER, "~CARRIES", [NORTH, SPICE]),
        (NORTH, "CARRIES/~CARRIES", [NORTH, SPICE]),
        (NORTH, "OF_FLEET/~OF_FLEET/CARRIES", [SALT, PEPPER, TIMBER]),
        (NORTH, "*", [SPICE, SALT, PEPPER, REDS, QUAY]),
        (99, "*", []),
    ],
)
def test_walk(graph, start, path, expected):
    assert ids(graph.walk(start, path)) == expected


def test_walk_limit_where_and_errors(graph):
    assert len(graph.walk(NORTH, "*", limit=2).collect()) == 2
    assert ids(graph.walk(NORTH, "*", "name^pep")) == [PEPPER]
    with pytest.raises(ValidationError):
        graph.walk(NORTH, "NO_SUCH")
    for bad in ("", "A//B", "x-y", "~", "~~*", "~~CARRIES"):
        with pytest.raises(ValidationError):
            parse_path(bad)


@pytest.mark.parametrize("a, b, depth, via, hops", [(NORTH, SPICE, 3, ["RETURNS"], 1), (NORTH, SPICE, 3, ["CARRIES"], 2), (QUAY, TIMBER, 1, None, None), (QUAY, TIMBER, 4, None, 4), (NORTH, NORTH, 3, None, 0), (NORTH, SPICE, 3, ["NONE"], None)])
def test_path(graph, a, b, depth, via, hops):
    found = graph.path(a, b, depth, via).collect()
    assert [r["n_hops"] for r in found] == ([] if hops is None else [hops])


def test_path_lines(graph):
    assert graph.render(graph.path(NORTH, SPICE, via=["CARRIES"])).first()["line"] == "Voyage:1 >CARRIES> Cargo:5 <CARRIES< Voyage:2  (2 hops)"


def test_path_agrees_with_plain_search(graph):
    edges = [(r["from_id"], r["to_id"]) for r in graph.edges.collect()]
    near = {n: {b for a, b in edges + [(b, a) for a, b in edges] if a == n} for n in range(1, 9)}
    found = {(r["start_id"], r["target_id"]): r["n_hops"] for r in graph.paths(graph.nodes.selectExpr("id AS start_id").crossJoin(graph.nodes.selectExpr("id AS target_id")), 5).collect()}
    for a in near:
        level, seen = {a: 0}, [a]
        for x in seen:
            for y in sorted(near[x] - set(level)):
                level[y] = level[x] + 1
                seen.append(y)
        assert {b: found[a, b] for b in near if (a, b) in found} == {b: d for b, d in level.items() if d <= 5}


def test_find(graph):
    assert ids(graph.find("Voyage", "drive=sail,title~spice")) == [SPICE]
    assert ids(graph.find("Voyage", "drive!=steam")) == [NORTH, SPICE]
    assert ids(graph.find("Voyage", "title^North")) == ids(graph.find("Voyage", "title^=North")) == [NORTH]
    assert ids(graph.find("Voyage", "turns>5")) == [SPICE] and ids(graph.find("Voyage", "turns!=3")) == [SPICE]
    assert ids(graph.find("Voyage", "cost>=1.5")) == ids(graph.find("Voyage", "done=true")) == [NORTH]
    assert ids(graph.find("Voyage", "nothing=1")) == []
    assert graph.find("Voyage", order="title:asc").first()["id"] == graph.find("Voyage", order="title:DESC", limit=None).collect()[-1]["id"] == NORTH
    with pytest.raises(ValidationError):
        graph.find("Nope")
    with pytest.raises(ValidationError):
        filters.parse("drive=a,b")


def test_literals_and_filters():
    assert [filters.literal(x) for x in ("1_000", "inf", "nan", "-2", "1e3", " 1")] == ["1_000", "inf", "nan", -2, 1000.0, " 1"]
    assert filters.pairs(["a=1", "b=2.5", "c=true", "d=null", "e=x=y", "f"]) == {"a": 1, "b": 2.5, "c": True, "d": None, "e": "x=y"}
    assert filters.parse("title=a>b") == [("title", "=", "a>b")]


def test_counts_and_views(graph):
    assert {(r["value"], r["n"]) for r in graph.count("Voyage", by="drive").collect()} == {("sail", 2), ("steam", 1)}
    assert graph.count("Nope").first()["n"] == 0
    assert {r["kind"]: r["n"] for r in graph.kinds().collect()} == {"Voyage": 3, "Cargo": 3, "Fleet": 1, "Harbour": 1}
    view = {r["id"]: r for r in graph.typed("Voyage", register=True).collect()}
    assert view[NORTH]["turns"] == 3 and view[NORTH]["done"] is True and str(view[NORTH]["at"]) == "2026-01-02 03:04:05" and view[WINTER]["at"] is None
    grouped = {(r["direction"], r["kind"]): r["others"] for r in graph.grouped(NORTH).collect()}
    assert grouped["out", "CARRIES"] == "Cargo:4,Cargo:5" and len(grouped) == 4


def test_search_and_similarity(graph):
    assert graph.search("timbr").first()["id"] == TIMBER
    assert jaro_winkler_bytes(b"", b"a") == 0 and jaro_winkler_bytes(b"martha", b"marhta") == pytest.approx(0.9611, abs=1e-4)


@pytest.mark.parametrize(
    "kind, properties, error",
    [
        ("Nope", "{}", errors.UnknownKind),
        ("Cargo", "{}", errors.MissingProperty),
        ("Cargo", '{"name":" "}', errors.BlankValue),
        ("Cargo", '{"name":1}', errors.WrongType),
        ("Cargo", '{"name":null}', errors.MissingProperty),
        ("Voyage", '{"title":"a","drive":"oars"}', errors.NotAVariant),
        ("Voyage", '{"title":"a","drive":"steam","turns":1.5}', errors.WrongType),
        ("Voyage", '{"title":"a","drive":"steam","turns":12345678901234567890}', errors.WrongType),
        ("Voyage", '{"title":"a","drive":"steam","done":"true"}', errors.WrongType),
        ("Cargo", '{"name":"a","more":"b"}', errors.UnknownProperty),
        ("Cargo", "not json", errors.BadDocument),
        ("Cargo", "[1]", errors.BadDocument),
    ],
)
def test_refused_nodes(spark, graph, kind, properties, error):
    with pytest.raises(error):
        changes.add_nodes(graph, spark.createDataFrame([(kind, properties)], "kind string, properties string"))


def test_accepted_nodes(spark, graph):
    rows = [("Voyage", '{"title":"\\"drive\\": 1","drive":"steam","turns":9223372036854775807,"cost":1,"done":null}'), ("Cargo", '{"name":"a"}')]
    assert ids(changes.add_nodes(graph, spark.createDataFrame(rows, "kind string, properties string")).nodes)[-2:] == [9, 10]


def test_many_ids(spark, graph):
    rows = spark.range(0, 300_000, 1, 16).selectExpr("'Cargo' AS kind", "concat('{\"name\":\"', id * 7919 % 300007, '\"}') AS properties")
    new = changes.new_nodes(graph, rows)
    assert new.selectExpr("count(*)", "count(DISTINCT id)", "min(id)", "max(id)").first() == (300_000, 300_000, 9, 300_008)
    first = [r["properties"] for r in new.orderBy("id").limit(50).collect()]
    assert first == sorted(first)


def test_changes(spark, graph):
    added = changes.add_nodes(graph, spark.createDataFrame([("Cargo", '{"name":"it\'s <b> & \\"q\\""}'), ("Cargo", json.dumps({"name": "x" * 5000}))], "kind string, properties string"))
    assert ids(added.nodes)[-2:] == [9, 10]
    g = changes.set_node(graph, "Voyage", NORTH, {"turns": None, "title": "North again"})
    row = g.typed("Voyage").filter(f"id = {NORTH}").first()
    assert row["turns"] is None and row["title"] == "North again" and row["cost"] == 1.5
    with pytest.raises(NotFound):
        changes.set_node(graph, "Cargo", NORTH, {"name": "a"})
    with pytest.raises(ValidationError):
        changes.set_node(graph, "Voyage", NORTH, {"drive": "oars"})
    odd = graph.nodes.filter(f"id = {SALT}").selectExpr("id", "kind", """'{"name":"salt","extra":1,"deep":{"z":[1,"x"]}}' AS properties""", "created_at", "updated_at")
    assert changes.set_node(graph.of(nodes=odd), "Cargo", SALT, {"name": "sea \"salt\""}).nodes.first()["properties"] == '{"deep":{"z":[1,"x"]},"extra":1,"name":"sea \\"salt\\""}'
    gone = changes.remove_node(graph, "Voyage", NORTH)
    assert gone.edges.count() == 4 and NORTH not in ids(gone.nodes)
    many = changes.remove_nodes(graph, graph.nodes.filter("kind = 'Voyage'"))
    assert many.edges.count() == 0 and many.nodes.count() == 5
    moved = changes.rekind(graph, "Cargo", SALT, "Fleet")
    assert moved.edges.filter(f"to_id = {SALT}").first()["to_kind"] == "Fleet"
    with pytest.raises(ValidationError):
        changes.rekind(graph, "Cargo", SALT, "Voyage")


def test_edges(spark, graph):
    row = lambda *e: spark.createDataFrame([e], "kind string, from_id bigint, to_id bigint, properties string")
    twice = changes.link(graph, row("RETURNS", NORTH, SPICE, None))
    assert twice.edges.filter("kind = 'RETURNS'").count() == 2 and ids(twice.walk(NORTH, "RETURNS")) == [SPICE]
    both = changes.set_edge(twice, NORTH, "RETURNS", SPICE, {"reason": "same"})
    assert {r["properties"] for r in both.edges.filter("kind = 'RETURNS'").collect()} == {'{"reason":"same"}'}
    assert changes.unlink(twice, NORTH, "RETURNS", SPICE).edges.count() == 8
    for error, call in ((ValidationError, lambda: changes.link(graph, row("CARRIES", SALT, NORTH, None))), (NotFound, lambda: changes.link(graph, row("CARRIES", NORTH, 99, None))), (NotFound, lambda: changes.unlink(graph, SPICE, "RETURNS", NORTH))):
        with pytest.raises(error):
            call()


def test_snapshot_and_merge(spark, graph, tmp_path):
    back = load(spark, export(graph, f"file://{tmp_path}/snapshots"), SCHEMA)
    assert back.nodes.count() == 8 and back.edges.count() == 9
    other = back.of(nodes=back.nodes.selectExpr("id + 100 AS id", "kind", "replace(properties, 'Winter haul', 'New work') AS properties", "created_at", "updated_at"),
                    edges=back.edges.selectExpr("id", "kind", "from_id + 100 AS from_id", "to_id + 100 AS to_id", "from_kind", "to_kind", "properties", "created_at"))
    merged = changes.merge(graph, other)
    assert merged.nodes.count() == 9 and merged.edges.count() == 11
    again = changes.merge(merged, other)
    assert again.nodes.count() == 9 and again.edges.count() == 11
    lines = import_json(spark, export_json(graph, f"file://{tmp_path}/lines"), SCHEMA)
    for part in ("nodes", "edges"):
        key = lambda df: sorted((r["id"], json.dumps(json.loads(r["properties"]), sort_keys=True)) for r in df.collect())
        assert key(getattr(lines, part)) == key(getattr(graph, part))


def test_merge_by_id_spares_new_nodes(spark, graph):
    node = lambda i, n: (i, "Cargo", json.dumps({"name": n}))
    shape = "id bigint, kind string, properties string"
    as_nodes = lambda rows: spark.createDataFrame(rows, shape).selectExpr("*", "localtimestamp() AS created_at", "localtimestamp() AS updated_at")
    local = Graph.empty(spark, SCHEMA).of(nodes=as_nodes([node(1, "a")]))
    remote = Graph.empty(spark, SCHEMA).of(nodes=as_nodes([node(2, "z"), node(9, "b")]))
    nodes, _ = changes.merge_parts(local, remote, id_first=True)
    merged = local.of(nodes=local.nodes.unionByName(nodes))
    new = {json.loads(r["properties"])["name"]: r["id"] for r in merged.nodes.collect()}
    assert new == {"a": 1, "b": 2, "z": 3}  # the remote node 2 is z, not the b that was just numbered 2


def test_stored_graphs_prune(spark, graph, tmp_path):
    g = load(spark, export(graph, f"file://{tmp_path}/typed"), SCHEMA)
    plan = lambda df: df._jdf.queryExecution().toString()
    assert "GreaterThan(typed.Voyage.turns,5)" in plan(g.find("Voyage", "turns>5", limit=None)) and ids(g.find("Voyage", "turns>5")) == [SPICE]
    assert "(kind#" in plan(g.by_id(SALT)) and "= Harbour" not in plan(g.by_id(SALT)) and ids(g.by_id(SALT)) == [SALT]
    assert ids(g.walk(PEPPER, "~CARRIES")) == [NORTH, SPICE] and g.grouped(PEPPER).first()["others"] == "Voyage:1,Voyage:2"


def test_store(spark, graph, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store", SCHEMA)
    assert store.latest()[0] == 0 and store.load().nodes.count() == 0
    store.change(lambda _: graph)
    cargo = lambda n: spark.createDataFrame([("Cargo", json.dumps({"name": n}))], "kind string, properties string")
    store.change(lambda g: (changes.new_nodes(g, cargo("tea")), None))
    assert [len(store.latest()[1][k]) for k in ("nodes", "edges")] == [2, 1] and store.load().nodes.count() == 9
    assert store.change(lambda g: (None, None)).nodes.count() == 9 and store.latest()[0] == 2

    def overtaken(g):
        if not done:
            done.append(1)
            store.change(lambda h: (changes.new_nodes(h, cargo("silk")), None))
        return changes.new_nodes(g, cargo("wool")), None

    done = []
    after = store.change(overtaken)
    assert sorted(r["name"] for r in after.typed("Cargo").collect()) == ["pepper", "salt", "silk", "tea", "timber", "wool"]
    assert len(set(ids(after.nodes))) == after.nodes.count() == 11

    def always(g):
        store.change(lambda h: (changes.new_nodes(h, cargo("x")), None))
        return g.of(nodes=g.nodes)

    with pytest.raises(Conflict):
        store.change(always)


@pytest.mark.parametrize("word, expected", [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("conflated", "conflat"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("conditional", "condit"), ("vietnamization", "vietnam"), ("operator", "oper"), ("sensibiliti", "sensibl"), ("triplicate", "triplic"), ("hopeful", "hope"), ("goodness", "good"), ("revival", "reviv"), ("adoption", "adopt"), ("probate", "probat"), ("rate", "rate"), ("cease", "ceas"), ("controll", "control"), ("roll", "roll"), ("été", "été")])
def test_stems(word, expected):
    assert text.stem(word) == expected
    assert word.startswith(expected[: max(1, len(expected) - 2)])


def test_full_text(spark, graph):
    assert ids(graph.bm25("the winter-hauls")) == [WINTER] and ids(graph.bm25("pepper")) == [PEPPER] and graph.bm25("the of").count() == 0
    assert graph.rrf3("winter haul").first()["id"] == WINTER


def test_schema_errors():
    for bad in ("nodes = [", '[nodes.A]\nx = "text"', '[nodes.A]\nx = "enum:"', '[edges.E]\nfrom = "A"\nto = "A"', '[nodes.A]\nx = "int"\n[nodes.a]\nx = "int"'):
        with pytest.raises(SchemaError):
            Schema.parse(bad)
    assert Schema.parse("").nodes == {} and str(Schema.parse('[nodes.A]\nx = "enum: a , b ?"').nodes["A"]["x"]) == "enum:a,b?"


def test_stream(spark, tmp_path):
    from graphloom.streaming.ingest import ingest

    source, prefix, bad = str(tmp_path / "in"), f"file://{tmp_path}/graph", f"file://{tmp_path}/bad"
    for name in ["salt", "salt", "tea"]:
        spark.createDataFrame([("Cargo", json.dumps({"name": name})), ("Nope", "{}")], "kind string, properties string").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("kind string, properties string").option("maxFilesPerTrigger", 1).parquet(source)
    for check in ("check", "again"):  # a second run over the same rows adds nothing
        ingest(stream, SCHEMA, prefix, bad, str(tmp_path / check)).awaitTermination()
        g = Store(spark, prefix, SCHEMA).load()
        assert sorted((r["id"], r["name"]) for r in g.typed("Cargo").collect()) in ([(1, "salt"), (2, "tea")], [(1, "tea"), (2, "salt")])
        assert spark.read.parquet(bad).count() == 3


def test_transcripts(spark, tmp_path):
    from graphloom.sources import transcripts

    schema = Schema.parse("""
[nodes.Session]
session_id = "string"
title = "string?"
tool = "string?"
[nodes.Project]
path = "string"
[nodes.Model]
name = "string"
[edges.IN_PROJECT]
from = "Session"
to = "Project"
[edges.USED_MODEL]
from = "Session"
to = "Model"
[edges.FOLLOWS]
from = "Session"
to = "Session"
[natural_keys]
Session = ["session_id"]
Project = ["path"]
Model = ["name"]
""")
    said = lambda i, at, t: {"type": "user", "sessionId": i, "timestamp": at, "cwd": "/ship", "gitBranch": "b", "message": {"content": t}}
    lines = [said("s1", "2", "later"), said("s1", "1", "\n Load the hold\nnow"), {"type": "assistant", "sessionId": "s1", "message": {"model": "m1", "content": [{"type": "text", "text": "done"}]}},
             said("s2", "3", [{"type": "text", "text": "Set sail"}]), {"type": "system", "sessionId": "s9"}]
    (tmp_path / "t.jsonl").write_text("\n".join([*map(json.dumps, lines), "no json"]))
    got = {r["session_id"]: r for r in transcripts.read_jsonl(spark, f"file://{tmp_path}/t.jsonl", "cli").collect()}
    assert got.keys() == {"s1", "s2"} and got["s1"]["title"] == "Load the hold" and got["s1"]["model"] == "m1" and got["s2"]["title"] == "Set sail" and got["s2"]["project"] == "/ship"
    remote = transcripts.as_graph(transcripts.read_jsonl(spark, f"file://{tmp_path}/t.jsonl", "cli"), schema)
    g = changes.merge(changes.merge(Graph.empty(spark, schema), remote), remote)
    assert {r["kind"]: r["n"] for r in g.kinds().collect()} == {"Session": 2, "Project": 1, "Model": 1} and g.edges.count() == 3
    assert transcripts.sessions(g, project="/ship", tool="cli").count() == 2 and transcripts.sessions(g, model="m1").count() == 1 and transcripts.sessions(g, project="/x").count() == 0
    a, b = ids(g.find("Session"))
    g = changes.link(g, spark.createDataFrame([("FOLLOWS", b, a, None)], "kind string, from_id bigint, to_id bigint, properties string"))
    assert [(r["id"], r["follows"]) for r in transcripts.timeline(g, follows="FOLLOWS").collect()] == [(b, [a]), (a, [])]
    with pytest.raises(NotFound):
        transcripts.credentials(spark, {}, {"fs.test.key": "NO_SUCH_KEY"})


def test_schema_round_trip():
    assert Schema.parse(SCHEMA.toml()) == SCHEMA
