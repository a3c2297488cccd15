"""Schemas: node and edge kinds with typed properties, read from TOML; validation as columns."""

from __future__ import annotations

import json
import re
import tomllib
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import BadType, SchemaError, SchemaSyntax, SchemaUnreadable, UnknownEdge, UnknownEdgeKind, UnknownKind, UnknownNodeKind, ValidationError

_IDENT = re.compile(r"[A-Za-z][A-Za-z0-9_]{0,63}")
#: Property types and what their typed columns are.
SPARK_TYPES = {"string": "string", "int": "bigint", "float": "double", "bool": "boolean", "timestamp": "timestamp_ntz", "enum": "string"}


def ident(name: str) -> str:
    if not _IDENT.fullmatch(name):
        raise ValidationError(f"invalid identifier: {name!r}")
    return name


@dataclass(frozen=True)
class Prop:
    type: str
    required: bool = True
    variants: tuple[str, ...] = ()
    hint: str = ""

    @classmethod
    def parse(cls, where: str, raw) -> Prop:
        hint = ""
        if isinstance(raw, dict):
            raw, hint = raw.get("type"), str(raw.get("hint", ""))
        if not isinstance(raw, str):
            raise BadType(f"{where}: a property is a type or a table with one")
        text = raw.strip()
        optional = text.endswith("?")
        base = text[:-1].strip() if optional else text
        variants: tuple[str, ...] = ()
        if base.startswith("enum:"):
            base, variants = "enum", tuple(v.strip() for v in base[5:].split(",") if v.strip())
            if not variants:
                raise BadType(f"{where}: an enum without variants")
        if base not in SPARK_TYPES or base == "enum" and not variants:
            raise BadType(f"{where}: unknown type {raw!r}")
        return cls(base, not optional, variants, hint)

    def __str__(self) -> str:
        return ("enum:" + ",".join(self.variants) if self.type == "enum" else self.type) + ("" if self.required else "?")


@dataclass(frozen=True)
class EdgeKind:
    sources: tuple[str, ...]
    targets: tuple[str, ...]
    props: dict[str, Prop] = field(default_factory=dict)


@dataclass(frozen=True)
class Schema:
    nodes: dict[str, dict[str, Prop]] = field(default_factory=dict)
    edges: dict[str, EdgeKind] = field(default_factory=dict)
    natural_keys: dict[str, tuple[str, ...]] = field(default_factory=dict)

    @classmethod
    def parse(cls, text: str) -> Schema:
        """From TOML: [nodes.Kind] property = "type", [edges.KIND] from, to and properties, [natural_keys] Kind = [...]"""
        try:
            doc = tomllib.loads(text)
        except tomllib.TOMLDecodeError as e:
            raise SchemaSyntax(f"not TOML: {e}") from e
        schema = cls(natural_keys={k: tuple(v) for k, v in doc.get("natural_keys", {}).items()})
        for kind, props in doc.get("nodes", {}).items():
            schema = schema.with_kind(kind, props)
        for kind, body in doc.get("edges", {}).items():
            schema = schema.with_edge(kind, body)
        return schema

    @classmethod
    def read(cls, path: str) -> Schema:
        """From a TOML file on the driver."""
        try:
            with open(path, encoding="utf-8") as f:
                return cls.parse(f.read())
        except (OSError, UnicodeDecodeError) as e:
            raise SchemaUnreadable(f"{path}: {e}") from e

    def toml(self) -> str:
        """The schema as TOML that ``parse`` reads."""
        props = lambda ps: [f"{k} = {{ type = {json.dumps(str(p))}, hint = {json.dumps(p.hint)} }}" if p.hint else f"{k} = {json.dumps(str(p))}" for k, p in ps.items()]
        out = []
        for kind, own in self.nodes.items():
            out += [f"[nodes.{kind}]", *props(own)]
        for kind, e in self.edges.items():
            out += [f"[edges.{kind}]", f"from = {json.dumps(list(e.sources))}", f"to = {json.dumps(list(e.targets))}", *props(e.props)]
        if self.natural_keys:
            out += ["[natural_keys]", *[f"{k} = {json.dumps(list(v))}" for k, v in self.natural_keys.items()]]
        return "\n".join(out) + "\n"

    def with_kind(self, kind: str, props: dict) -> Schema:
        """A schema that also has this node kind, or more properties of it."""
        known = next((k for k in self.nodes if k.lower() == kind.lower()), kind)
        if known != kind:
            raise SchemaError(f"{kind}: differs from {known} by case alone")
        own = {ident(p): Prop.parse(f"{kind}.{p}", raw) for p, raw in props.items()}
        return replace(self, nodes=self.nodes | {ident(kind): self.nodes.get(kind, {}) | own})

    def with_edge(self, kind: str, body: dict) -> Schema:
        ends = []
        for side in ("from", "to"):
            raw = body.get(side)
            names = (raw,) if isinstance(raw, str) else tuple(raw or ())
            if not names:
                raise UnknownEdgeKind(f"{kind}: no {side!r}")
            for name in names:
                if name not in self.nodes:
                    raise UnknownNodeKind(f"{kind}: unknown node kind {name}")
            ends.append(names)
        props = {ident(p): Prop.parse(f"{kind}.{p}", raw) for p, raw in body.items() if p not in ("from", "to") and not isinstance(raw, list)}
        return replace(self, edges=self.edges | {ident(kind): EdgeKind(*ends, props)})

    def node(self, kind: str) -> dict[str, Prop]:
        if kind not in self.nodes:
            raise UnknownKind(f"unknown node kind: {kind}")
        return self.nodes[kind]

    def edge(self, kind: str) -> EdgeKind:
        if kind not in self.edges:
            raise UnknownEdge(f"unknown edge kind: {kind}")
        return self.edges[kind]

    def describe(self, spark: SparkSession) -> DataFrame:
        """One row for each property, and one for each kind without: what, kind, property, type, required, ends."""
        rows = []
        for k, props in self.nodes.items():
            rows += [("node", k, p, str(d), d.required, "") for p, d in props.items()] or [("node", k, None, None, None, "")]
        for k, e in self.edges.items():
            ends = f"{','.join(e.sources)}->{','.join(e.targets)}"
            rows += [("edge", k, p, str(d), d.required, ends) for p, d in e.props.items()] or [("edge", k, None, None, None, ends)]
        return spark.createDataFrame(rows, "what string, kind string, property string, type string, required boolean, ends string")


def property_text(name: str, column: str = "properties") -> Column:
    """A property's value as text; null where the key lacks, is null, or the document is malformed."""
    return F.get_json_object(F.col(column), f"$.{ident(name)}")


def typed(name: str, prop: Prop, column: str = "properties") -> Column:
    """A property as its type; text that is no such value is null."""
    text = property_text(name, column)
    return text if SPARK_TYPES[prop.type] == "string" else text.try_cast(SPARK_TYPES[prop.type])


_FITS = {"int": ("BIGINT",), "float": ("BIGINT", "DOUBLE", "FLOAT", "DECIMAL"), "bool": ("BOOLEAN",)}


def _errors(props: dict[str, Prop], creating: bool) -> Column:
    """Messages about one kind's properties, in order: no JSON object; unknown keys, missing ones, wrong values. The
    document is parsed once; whole numbers have 64 bits, as typed columns do."""

    def said(doc: Column) -> Column:
        unknown = F.transform(F.sort_array(F.filter(F.json_object_keys(doc.cast("string")), lambda k: ~k.isin(list(props)) if props else F.lit(True))), lambda k: F.concat(F.lit("unknown property: "), k))
        found = []
        value = {name: F.try_variant_get(doc, f"$.{name}", "variant") for name in props}
        kind = {name: F.coalesce(F.schema_of_variant(v), F.lit("VOID")) for name, v in value.items()}
        for name, p in sorted(props.items()):
            if creating and p.required:
                found.append(F.when(kind[name] == "VOID", F.lit(f"missing property: {name}")))
        for name, p in sorted(props.items()):
            there = kind[name] != "VOID"
            if p.type in _FITS:
                fits = kind[name].rlike(f"^({'|'.join(_FITS[p.type])})")
                found.append(F.when(there & ~fits, F.lit(f"not {p.type}: {name}")))
                continue
            text = F.try_variant_get(doc, f"$.{name}", "string")
            wrong = F.when(there & (kind[name] != "STRING"), F.lit(f"not a string: {name}"))
            if p.type == "enum":
                wrong = wrong.when(there & ~text.isin(list(p.variants)), F.lit(f"not a variant: {name}"))
            elif p.required and p.type == "string":
                wrong = wrong.when(there & (F.trim(text) == ""), F.lit(f"blank property: {name}"))
            found.append(wrong)
        return F.concat(unknown, F.array_compact(F.array(*found))) if found else unknown

    doc = F.try_parse_json(F.coalesce("properties", F.lit("{}")))
    is_object = F.coalesce(F.schema_of_variant(doc).startswith("OBJECT"), F.lit(False))
    return F.when(is_object, F.get(F.transform(F.array(doc), said), F.lit(0))).otherwise(F.array(F.lit("properties are no JSON object")))


def node_errors(schema: Schema, creating: bool = True) -> Column:
    """What is wrong with each row (kind, properties): empty if nothing."""
    out = F.array(F.concat(F.lit("unknown node kind: "), F.coalesce("kind", F.lit("null"))))
    for kind, props in schema.nodes.items():
        out = F.when(F.col("kind") == kind, _errors(props, creating)).otherwise(out)
    return out


def edge_errors(schema: Schema) -> Column:
    """What is wrong with each row (kind, from_kind, to_kind, properties). Required edge properties are not enforced."""
    out = F.array(F.concat(F.lit("unknown edge kind: "), F.coalesce("kind", F.lit("null"))))
    for kind, e in schema.edges.items():
        ends = F.when(~(F.col("from_kind").isin(list(e.sources)) & F.col("to_kind").isin(list(e.targets))), F.lit("invalid endpoints"))
        out = F.when(F.col("kind") == kind, F.concat(F.array_compact(F.array(ends)), _errors(e.props, False))).otherwise(out)
    return out
