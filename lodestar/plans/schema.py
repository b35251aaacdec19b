"""Applications: tables of objects with scalar, multi-valued, link, cross-link and group fields."""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET
from dataclasses import dataclass, field

SPARK = {"TEXT": "string", "BINARY": "binary", "BOOLEAN": "boolean", "INTEGER": "int", "LONG": "bigint", "FLOAT": "float", "DOUBLE": "double", "TIMESTAMP": "timestamp"}


@dataclass
class Field:
    name: str
    type: str = "TEXT"
    collection: bool = False
    table: str | None = None
    inverse: str | None = None
    junction: str | None = None
    members: list[str] = field(default_factory=list)
    analyzer: str | None = None

    @property
    def is_link(self) -> bool:
        return self.type in ("LINK", "XLINK")


@dataclass
class Table:
    name: str
    fields: dict[str, Field] = field(default_factory=dict)
    options: dict = field(default_factory=dict)
    aliases: dict[str, str] = field(default_factory=dict)

    def field(self, name: str) -> Field:
        if name in self.fields:
            return self.fields[name]
        raise KeyError(f"table {self.name} has no field {name}")

    def scalars(self) -> list[Field]:
        return [f for f in self.fields.values() if f.type in SPARK]

    def links(self) -> list[Field]:
        return [f for f in self.fields.values() if f.is_link]


@dataclass
class Application:
    name: str
    tables: dict[str, Table] = field(default_factory=dict)
    options: dict = field(default_factory=dict)

    @classmethod
    def from_dict(cls, spec: dict) -> "Application":
        """{"name": {"tables": {"T": {"fields": {"f": {"type": ...}}}}}}, as JSON schemas are written."""
        name, body = next(iter(spec.items()))
        app = cls(name, options=body.get("options", {}))
        for t, tb in body.get("tables", {}).items():
            table = app.tables[t] = Table(t, options=tb.get("options", {}), aliases={("$" + a).replace("$$", "$"): (v["expression"] if isinstance(v, dict) else v) for a, v in tb.get("aliases", {}).items()})
            _fields(table, tb.get("fields", {}))
        app.complete()
        return app

    @classmethod
    def from_json(cls, text: str) -> "Application":
        return cls.from_dict(json.loads(text))

    @classmethod
    def from_xml(cls, text: str) -> "Application":
        root = ET.fromstring(text)

        def fields(node):
            out = {}
            for f in node.findall("fields/field"):
                spec = dict(f.attrib)
                name = spec.pop("name")
                if f.find("fields") is not None:
                    spec |= {"type": "GROUP", "fields": fields(f)}
                out[name] = spec
            return out

        tables = {t.attrib["name"]: {"fields": fields(t), "options": {o.attrib["name"]: o.text for o in t.findall("options/option")}, "aliases": {a.attrib["name"]: a.attrib["expression"] for a in t.findall("aliases/alias")}} for t in root.findall("tables/table")}
        return cls.from_dict({root.attrib["name"]: {"tables": tables, "options": {o.attrib["name"]: o.text for o in root.findall("options/option")}}})

    def to_dict(self) -> dict:
        """As from_dict() takes it."""

        def fields(t: Table, names) -> dict:
            out = {}
            for n in names:
                f = t.fields[n]
                out[n] = {k: v for k, v in (("type", f.type), ("collection", "true" if f.collection else None), ("table", f.table), ("inverse", f.inverse), ("junction", f.junction), ("analyzer", f.analyzer)) if v}
                if f.members:
                    out[n] = {"type": "GROUP", "fields": fields(t, f.members)}
            return out

        tables = {}
        for n, t in self.tables.items():
            inner = {m for f in t.fields.values() for m in f.members}
            tables[n] = {"fields": fields(t, [x for x in t.fields if x not in inner]), "options": t.options, "aliases": {a: {"expression": x} for a, x in t.aliases.items()}}
        return {self.name: {"options": self.options, "tables": tables}}

    def complete(self) -> None:
        """Add the inverse of every link that names one."""
        for t in list(self.tables.values()):
            for f in list(t.fields.values()):
                if f.is_link:
                    other = self.tables.setdefault(f.table or t.name, Table(f.table or t.name))
                    f.table = other.name
                    if f.inverse and f.inverse not in other.fields:
                        other.fields[f.inverse] = Field(f.inverse, f.type, True, t.name, f.name, "_ID" if f.type == "XLINK" and f.junction in (None, "_ID") else None)


def _fields(table: Table, specs: dict) -> list[str]:
    names = []
    for name, s in specs.items():
        s = s or {}
        kind = s.get("type", "GROUP" if "fields" in s else "TEXT").upper()
        if kind not in SPARK and kind not in ("LINK", "XLINK", "GROUP"):
            raise ValueError(f"unknown type {kind}")
        f = table.fields[name] = Field(name, kind, str(s.get("collection", "false")).lower() == "true", s.get("table"), s.get("inverse"), s.get("junction"), analyzer=s.get("analyzer"))
        if kind == "GROUP":
            f.members = _fields(table, s.get("fields", {}))
        names.append(name)
    return names


class Catalog:
    """Applications by name: define or replace, modify, get, list, delete."""

    def __init__(self):
        self.apps: dict[str, Application] = {}

    def define(self, spec: dict | str) -> Application:
        app = spec if isinstance(spec, Application) else Application.from_dict(spec) if isinstance(spec, dict) else (Application.from_xml if spec.lstrip().startswith("<") else Application.from_json)(spec)
        self.apps[app.name] = app
        return app

    def modify(self, spec: dict | str) -> Application:
        """Replace a definition that is there. Fields may come and go; a link can't become a scalar nor the other way."""
        name = next(iter(spec)) if isinstance(spec, dict) else None
        before = dict(self.apps)
        app = self.define(spec)
        name = name or app.name
        old = before.get(name)
        clash = [f"{t}.{f}" for t, tb in app.tables.items() for f, x in tb.fields.items() if old and t in old.tables and f in old.tables[t].fields and old.tables[t].fields[f].is_link != x.is_link]
        if old is None or clash:
            self.apps = before
            raise ValueError(f"no application {name}" if old is None else f"links and scalars can't change into each other: {clash}")
        return app

    def get(self, name: str) -> Application:
        return self.apps[name]

    def list(self) -> list[str]:
        return sorted(self.apps)

    def delete(self, name: str) -> None:
        del self.apps[name]
