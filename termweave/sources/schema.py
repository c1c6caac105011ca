"""Schemas on the driver: classes, slots, enumerations and bindings, read from YAML."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

import yaml

#: Meanings of a slot that make it a label of its object.
LABEL_MEANINGS = frozenset(["rdfs:label", "skos:prefLabel", "schema:name", "oboInOwl:hasExactSynonym"])


@dataclass(frozen=True)
class Reachable:
    """Nodes reachable from some nodes over some relations."""

    source_nodes: tuple[str, ...] = ()
    relationship_types: tuple[str, ...] = ("rdfs:subClassOf",)
    include_self: bool = False
    traverse_up: bool = False
    source_ontology: str | None = None

    @classmethod
    def of(cls, raw: dict) -> "Reachable":
        return cls(tuple(raw.get("source_nodes") or ()), tuple(raw.get("relationship_types") or ("rdfs:subClassOf",)), bool(raw.get("include_self")), bool(raw.get("traverse_up")), raw.get("source_ontology"))


@dataclass(frozen=True)
class Matches:
    identifier_pattern: str | None = None
    source_ontology: str | None = None


@dataclass(frozen=True)
class PermissibleValue:
    name: str
    title: str | None = None
    description: str | None = None
    aliases: tuple[str, ...] = ()
    annotations: tuple[tuple[str, str], ...] = ()
    meaning: str | None = None

    @classmethod
    def of(cls, name: str, raw: dict | None) -> "PermissibleValue":
        raw = raw or {}
        notes = raw.get("annotations") or {}
        notes = notes.items() if isinstance(notes, dict) else ((n.get("tag"), n.get("value")) for n in notes)
        tagged = tuple((str(k), str(v.get("value") if isinstance(v, dict) else v)) for k, v in notes)
        return cls(str(name), raw.get("title"), raw.get("description"), tuple(raw.get("aliases") or ()), tagged, raw.get("meaning") or None)


@dataclass(frozen=True)
class EnumExpression:
    reachable_from: Reachable | None = None
    matches: Matches | None = None
    concepts: tuple[str, ...] = ()
    permissible_values: tuple[PermissibleValue, ...] = ()

    @staticmethod
    def parts(raw: dict) -> dict:
        values = raw.get("permissible_values") or {}
        values = {v.get("text", v.get("name")): v for v in values} if isinstance(values, list) else values
        m = raw.get("matches")
        return {
            "reachable_from": Reachable.of(raw["reachable_from"]) if raw.get("reachable_from") else None,
            "matches": Matches(m.get("identifier_pattern"), m.get("source_ontology")) if m else None,
            "concepts": tuple(raw.get("concepts") or ()),
            "permissible_values": tuple(PermissibleValue.of(k, v) for k, v in values.items()),
        }

    @classmethod
    def of(cls, raw: dict) -> "EnumExpression":
        return cls(**cls.parts(raw))


@dataclass(frozen=True)
class EnumSpec(EnumExpression):
    name: str = ""
    include: tuple[EnumExpression, ...] = ()
    minus: tuple[EnumExpression, ...] = ()
    inherits: tuple[str, ...] = ()

    @classmethod
    def named(cls, name: str, raw: dict | None) -> "EnumSpec":
        raw = raw or {}
        many = lambda key: tuple(EnumExpression.of(x) for x in (raw.get(key) or []))
        return cls(**cls.parts(raw), name=name, include=many("include"), minus=many("minus"), inherits=tuple(raw.get("inherits") or ()))

    @property
    def dynamic(self) -> bool:
        """Whether more than its own values defines it; subtraction alone doesn't."""
        return bool(self.reachable_from or self.matches or self.concepts or self.include or self.inherits)


@dataclass(frozen=True)
class Binding:
    field: str | None
    range: str | None
    obligation: str | None = None


@dataclass
class Slot:
    name: str
    range: str | None = None
    multivalued: bool = False
    implements: tuple[str, ...] = ()
    slot_uri: str | None = None
    bindings: tuple[Binding, ...] = ()
    identifier: bool = False
    required: bool = False

    @property
    def is_label(self) -> bool:
        return bool(LABEL_MEANINGS & {*self.implements, *([self.slot_uri] if self.slot_uri else [])})


def _slot(name: str, *layers: dict | None) -> Slot:
    """Later layers refine earlier ones."""
    merged: dict = {}
    for layer in layers:
        merged |= {k: v for k, v in (layer or {}).items() if v is not None}
    bindings = tuple(Binding(b.get("binds_value_of"), b.get("range"), b.get("obligation_level")) for b in merged.get("bindings") or [])
    return Slot(name, merged.get("range"), bool(merged.get("multivalued")), tuple(merged.get("implements") or ()), merged.get("slot_uri"), bindings, bool(merged.get("identifier")), bool(merged.get("required")))


@dataclass
class Schema:
    classes: dict[str, dict] = field(default_factory=dict)
    slots: dict[str, dict] = field(default_factory=dict)
    enums: dict[str, EnumSpec] = field(default_factory=dict)
    default_range: str = "string"

    @classmethod
    def of(cls, raw: dict) -> "Schema":
        names = lambda key: {k: v or {} for k, v in (raw.get(key) or {}).items()}
        return cls(names("classes"), names("slots"), {k: EnumSpec.named(k, v) for k, v in names("enums").items()}, raw.get("default_range") or "string")

    @classmethod
    def load(cls, path: str, _seen: frozenset[str] = frozenset()) -> "Schema":
        """Reads a schema and the local files that it imports (name or name.yaml beside it); what isn't there, such as a standard vocabulary, is passed over."""
        with open(path, encoding="utf-8") as f:
            raw = yaml.safe_load(f) or {}
        out, here = cls.of(raw), os.path.abspath(path)
        for name in raw.get("imports") or []:
            for other in (os.path.join(os.path.dirname(here), f"{name}{end}") for end in (".yaml", "")):
                if os.path.isfile(other) and os.path.abspath(other) not in _seen | {here}:
                    base = cls.load(other, _seen | {here})
                    out.classes, out.slots, out.enums = base.classes | out.classes, base.slots | out.slots, base.enums | out.enums
                    break
        return out

    def lineage(self, name: str) -> list[str]:
        """The class, its mixins and ancestors, nearest first, each once."""
        out, todo = [], [name]
        while todo:
            c = todo.pop(0)
            if c in self.classes and c not in out:
                out.append(c)
                raw = self.classes[c]
                todo += [*(raw.get("mixins") or []), *([raw["is_a"]] if raw.get("is_a") else [])]
        return out

    def slots_of(self, name: str) -> dict[str, Slot]:
        """The class's slots with all that it inherits and refines."""
        line = self.lineage(name)
        given: dict[str, None] = {}
        for c in reversed(line):
            given |= dict.fromkeys([*(self.classes[c].get("slots") or []), *(self.classes[c].get("attributes") or {})])
        out = {}
        for slot in given:
            own = [(self.classes[c].get("attributes") or {}).get(slot) for c in reversed(line)]
            usage = [(self.classes[c].get("slot_usage") or {}).get(slot) for c in reversed(line)]
            out[slot] = _slot(slot, {"range": self.default_range}, self.slots.get(slot), *own, *usage)
        return out

    def label_slots(self, name: str | None) -> list[str]:
        found = [s.name for s in self.slots_of(name).values() if s.is_label] if name else []
        return found or ["label"]

    def bound_slots(self) -> dict[tuple[str, str], tuple[Binding, ...]]:
        return {(c, s.name): s.bindings for c in self.classes for s in self.slots_of(c).values() if s.bindings}

    def range_class_by_slot(self, slot: str) -> str | None:
        """The range, if a class, of the first class in order whose slot of that name has bindings."""
        for c in self.classes:
            own = self.slots_of(c).get(slot)
            if own and own.bindings:
                return own.range if own.range in self.classes else None
        return None

    def root(self) -> str | None:
        return next((c for c, raw in self.classes.items() if raw.get("tree_root")), None)
