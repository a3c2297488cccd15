"""Commands from an empty folder on: each sees what those before it did."""

import json

import pytest

from graphloom.cli import home, reference, run
from graphloom.errors import NotFound, ValidationError
from graphloom.filters import pairs
from graphloom.schema import Schema

SCHEMA = """
[nodes.Voyage]
title = "string"
drive = "enum:sail,steam"
turns = "int?"
at = "timestamp?"
[nodes.Cargo]
name = "string"
[nodes.Crate]
name = "string"
[edges.CARRIES]
from = "Voyage"
to = ["Cargo", "Crate"]
weight = "float?"
[natural_keys]
Voyage = ["title"]
Cargo = ["name"]
"""


def test_arguments():
    props = Schema.parse(SCHEMA).node("Voyage")
    assert reference("Cargo:7") == ("Cargo", 7)
    assert pairs(["title=42", "turns=3", "drive=null", "nothing"], props) == {"title": "42", "turns": 3, "drive": None}
    for bad in ("Cargo", ":7", "Cargo:x"):
        with pytest.raises(ValidationError):
            reference(bad)
    with pytest.raises(ValidationError):
        pairs(["turns=many"], props)


def test_commands(spark, tmp_path):
    (tmp_path / "schema.toml").write_text(SCHEMA)
    today = str(spark.sql("SELECT current_date()").first()[0])
    do = lambda *argv, at="graph": run(spark, ["--graph", f"file://{tmp_path}/{at}", "--schema", str(tmp_path / "schema.toml"), *argv])
    assert do("find", "Voyage") == [] and do("stats") == ["node * 0", "edge * 0", "bytes 0"]
    assert do("add", "Voyage", "title=North run", "drive=sail", "turns=3") == ['Voyage:1 "North run"']
    assert do("add", "Voyage", "title=Spice trade", "drive=steam") == ['Voyage:2 "Spice trade"']
    assert do("add", "Cargo", "name=salt") == ['Cargo:3 "salt"']
    with pytest.raises(ValidationError):
        do("add", "Voyage", "title=x", "drive=oars")
    with pytest.raises(NotFound):
        do("link", "Voyage:1", "CARRIES", "Cargo:99")
    assert do("link", "Voyage:1", "CARRIES", "Cargo:3", "weight=0.5") == ["ok"] and do("link", "Voyage:2", "CARRIES", "Cargo:3") == ["ok"]
    assert do("edge-set", "Voyage:2", "CARRIES", "Cargo:3", "weight=2") == ["ok"]
    assert do("find", "Voyage", "turns>2") == ['Voyage:1 "North run"'] and do("--quiet", "find", "Voyage", "--order", "title:asc") == ["1", "2"]
    assert do("get", "Voyage:1") == ['Voyage:1 "North run"', f"  drive=sail  turns=3  created={today}", "  >CARRIES> Cargo:3"]
    assert json.loads(do("--json", "get", "Voyage:1")[0])[0]["properties"] == {"title": "North run", "drive": "sail", "turns": 3}
    assert do("edges", "Cargo:3", "--in") == ["<CARRIES< Voyage:1,Voyage:2"] and do("edges", "Cargo:3", "--out") == []
    assert do("--quiet", "walk", "Voyage:1", "CARRIES/~CARRIES") == ["1", "2"]
    assert do("path", "Voyage:1", "Voyage:2") == ["Voyage:1 >CARRIES> Cargo:3 <CARRIES< Voyage:2  (2 hops)"]
    assert do("path", "Voyage:1", "Voyage:2", "--depth", "1") == ["no path of 1 hops or fewer"]
    assert do("count", "Voyage") == ["2"] and do("count", "Voyage", "--by", "drive") == ["sail 1", "steam 1"]
    assert do("search", "North run")[0] == 'Voyage:1 "North run"' and do("search", "North run", "--kind", "Cargo") == []
    assert do("related", "Voyage:1", "--edge", "CARRIES") == ['Voyage:2 "Spice trade"'] and "node Cargo name: string" in do("schema", "Cargo")
    assert do("set", "Voyage:1", "turns=null", "drive=steam") == ["ok"] and do("count", "Voyage", "--by", "drive") == ["steam 2"]
    assert do("push", f"file://{tmp_path}/other") == ["node 3", "edge 2"]
    assert do("add", "Cargo", "name=new", at="other") == ['Cargo:4 "new"']
    assert do("pull", f"file://{tmp_path}/other") == ["ok"] and do("count", "Cargo") == ["2"] and do("stats")[-2] == "edge CARRIES 2" and do("kinds") == ["Cargo 2", "Voyage 2"]
    assert do("rekind", "Cargo:3", "Crate") == ["ok"] and do("edges", "Voyage:1") == [">CARRIES> Crate:3"]
    assert do("unlink", "Voyage:2", "CARRIES", "Crate:3") == ["ok"] and do("rm", "Voyage:1") == ["ok"]
    assert do("stats")[:-1] == ["node * 3", "node Cargo 1", "node Crate 1", "node Voyage 1", "edge * 0"]
    assert do("seed", f"file://{tmp_path}/graph", f"file://{tmp_path}/seeded") == ["node 3", "edge 0"] and do("kinds", at="seeded") == do("kinds")
    (folder,) = do("export", f"file://{tmp_path}/exports", "--format", "json")
    assert do("import", folder, "--format", "json", at="fresh") == ["ok"] and do("kinds", at="fresh") == do("kinds")
    assert do("define", "Mast", "height:int", "wood:string?") == ["define Mast 2"] and do("extend", "Mast", "age:int?") == ["extend Mast 1"]
    assert do("schema", "Mast") == ["node Mast height: int", "node Mast wood: string?", "node Mast age: int?"]
    for bad in (("extend", "Mast", "age:int"), ("define", "Mast", "x:int"), ("export", "x", "--format", "xml")):
        with pytest.raises(ValidationError):
            do(*bad)
    with pytest.raises(NotFound):
        do("pull", f"file://{tmp_path}/nothing")


def test_home(monkeypatch):
    monkeypatch.setenv("GRAPHLOOM_HOME", "/data/g")
    assert home() == "file:///data/g"
    monkeypatch.delenv("GRAPHLOOM_HOME")
    monkeypatch.setenv("HOME", "/home/x")
    assert home() == "file:///home/x/.graphloom"


def test_register(spark, tmp_path):
    schema = tmp_path / "s.toml"
    schema.write_text('[nodes.Session]\nsession_id = "string"\ntitle = "string?"\n[nodes.Project]\npath = "string"\n[edges.IN_PROJECT]\nfrom = "Session"\nto = "Project"\n[natural_keys]\nSession = ["session_id"]\nProject = ["path"]\n')
    do = lambda *argv: run(spark, ["--graph", f"file://{tmp_path}/g", "--schema", str(schema), *argv])
    (line,) = do("register", "--session-id", "a1", "--project", "/ship", "--title", "Load the hold")
    assert line.endswith('"Load the hold"') and do("register", "--session-id", "a1", "--project", "/ship") == [line]
    assert do("sessions", "--project", "/ship") == [line] and do("timeline")[0].endswith(line) and do("kinds") == ["Project 1", "Session 1"]
