"""Whole validations: of a schema, of data files, of text files."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.functions.text import MENTION, prefix_of
from termweave.operators import checks, lookup, mentions, paths
from termweave.operators.enums import EnumCompiler
from termweave.sources.config import Options
from termweave.sources.data import read_text
from termweave.sources.ontology import OntologyCatalog
from termweave.sources.schema import EnumSpec, Schema
from termweave.sources.snapshot import EnumCache, LabelCache
from termweave.sources.storage import kept


class Check(Protocol):
    """A check: prepare it once, then ask for the issues of any number of tables."""

    def prepare(self, service: "Service", schema: Schema) -> None: ...

    def issues(self, df: DataFrame, target_class: str, instance_id: Column | None = None) -> DataFrame: ...


class Service:
    """Labels, members and prefixes for all checks of a run, with the snapshots behind them."""

    def __init__(self, spark: SparkSession, options: Options, catalog: OntologyCatalog | None = None):
        self.spark, self.options = spark, options
        self.catalog = catalog or OntologyCatalog(spark, options)
        self.label_cache = LabelCache(spark, options.cache_dir, options.cache_labels)
        self.enum_cache = EnumCache(spark, options.cache_dir, options.cache_enum_expansions)
        self.unknown: set[str] = set()

    def prefixes(self) -> DataFrame:
        return self.options.prefixes(self.spark)

    def labels(self, curies: DataFrame) -> DataFrame:
        """(curie, label), the snapshot's label first. New labels are added to the snapshots, unknown prefixes are noted."""
        keys = kept(curies.select("curie").where("curie is not null").distinct())
        asked = sorted(r[0] for r in keys.select(prefix_of(F.col("curie"))).distinct().collect() if r[0])
        cache = kept(self.label_cache.load(asked).select("curie", "label")) if self.options.cache_labels else None
        found = kept(lookup.labels(keys, self.catalog.terms(asked), cache))
        answered = {p for p in asked if self.options.adapter_for(p)}
        left = found.where("label is null" if cache is not None else "true").select(prefix_of(F.col("curie")).alias("p")).where("p is not null").distinct()
        self.unknown |= {r[0] for r in left.collect()} - answered
        if self.options.cache_labels:
            for p in answered:
                mine = found.where((prefix_of(F.col("curie")) == p) & F.col("label").isNotNull())
                if mine.take(1):
                    self.label_cache.save(p, mine)
        return found

    def members(self, compiler: EnumCompiler, names: list[str], values: DataFrame) -> DataFrame:
        """(enum_name, value) for the checks. A complete snapshot answers alone; a partial one spares its values the walk."""
        out = [self.spark.createDataFrame([], "enum_name string, value string")]
        for name in names:
            spec = compiler.enums[name]
            held = self.enum_cache.load(spec)
            if held is None or not self.enum_cache.is_complete(spec):
                if self.options.mode == "greedy":
                    got = kept(compiler.expand(name))
                    self.enum_cache.save(spec, got, complete=True)
                else:
                    asked = values.where(F.col("enum_name") == name)
                    asked = asked if held is None else asked.join(held, "value", "left_anti")
                    got = kept(compiler.accepted(name, asked))
                    if got.take(1):
                        self.enum_cache.save(spec, got, complete=False)
                    got = got if held is None else got.union(held)
                held = got
            out.append(held.select(F.lit(name).alias("enum_name"), "value").distinct())
        return checks.union(out)


@dataclass
class DynamicEnumCheck:
    """Top-level slots whose range is a dynamic enumeration; static ones too if asked for."""

    include_static: bool = False

    def prepare(self, service: Service, schema: Schema) -> None:
        self.service, self.schema, self.compiler = service, schema, EnumCompiler(service.catalog, schema.enums)

    def issues(self, df: DataFrame, target_class: str, instance_id: Column | None = None) -> DataFrame:
        values = paths.slot_values(df, self.schema, target_class, True, instance_id)
        names = sorted({s.range for s in self.schema.slots_of(target_class).values() if s.range in self.schema.enums and self.schema.enums[s.range].dynamic})
        members = self.service.members(self.compiler, names, values)
        out = checks.direct_enum_violations(values, members, counted=self.service.options.mode == "greedy")
        if self.include_static:
            values = paths.slot_values(df, self.schema, target_class, False, instance_id)
            out = out.unionByName(checks.direct_static_violations(values, static_members(self.service.spark, self.schema.enums.values())))
        return out


def static_members(spark: SparkSession, specs) -> DataFrame:
    """Names and meanings of static enumerations."""
    rows = sorted({(s.name, v) for s in specs if not s.dynamic for pv in s.permissible_values for v in (pv.name, pv.meaning) if v})
    return spark.createDataFrame(rows, "enum_name string, value string")


@dataclass
class BindingCheck:
    """Bound fields of nested objects: required, member, existing, and labelled as the ontology has it."""

    labels: bool = True
    strict: bool = True

    def prepare(self, service: Service, schema: Schema) -> None:
        self.service, self.schema, self.compiler = service, schema, EnumCompiler(service.catalog, schema.enums)

    def issues(self, df: DataFrame, target_class: str, instance_id: Column | None = None) -> DataFrame:
        bound = kept(paths.bound_values(df, self.schema, target_class, instance_id))
        spark, enums = self.service.spark, self.schema.enums
        used = sorted({b.range for bs in self.schema.bound_slots().values() for b in bs if b.range in enums})
        checked = [n for n in used if enums[n].dynamic or enums[n].permissible_values]
        members = self.service.members(self.compiler, [n for n in used if enums[n].dynamic], bound.where("value_is_string").select("enum_name", "value"))
        members = kept(members.unionByName(static_members(spark, [enums[n] for n in used])))
        kinds = spark.createDataFrame([(n, enums[n].dynamic) for n in checked], "enum_name string, dynamic boolean")
        parts = [checks.required_missing(bound), checks.binding_enum_violations(bound, members, kinds, counted=self.service.options.mode == "greedy")]
        if self.labels or self.strict:
            found = self.service.labels(bound.where("value_is_string").select(F.col("value").alias("curie")))
            if self.strict:
                parts.append(checks.terms_not_found(bound, found.select("curie", "label"), self.service.prefixes()))
            if self.labels:
                parts.append(checks.label_mismatches(bound, found))
        return checks.union(parts)


def value_table(spark: SparkSession, enums: dict[str, EnumSpec]) -> DataFrame:
    rows = [(e.name, pv.name, pv.title, pv.description, list(pv.aliases), dict(pv.annotations), pv.meaning, i) for e in enums.values() for i, pv in enumerate(e.permissible_values)]
    return spark.createDataFrame(rows, "enum_name string, value_name string, title string, description string, aliases array<string>, annotations map<string,string>, meaning string, ordinal int")


@dataclass
class MeaningCheck:
    """Meanings in a schema's enumerations, reported once and not for each instance."""

    strict: bool = False

    def prepare(self, service: Service, schema: Schema) -> None:
        self.service, self.schema = service, schema

    def issues(self, df: DataFrame | None = None, target_class: str = "", instance_id: Column | None = None) -> DataFrame:
        values = value_table(self.service.spark, self.schema.enums)
        return checks.plugin_meaning_issues(values, self.service.labels(values.select(F.col("meaning").alias("curie"))), self.strict)


@dataclass
class Result:
    """Issues as a table, how much was checked, and prefixes that nothing answers for."""

    issues: DataFrame
    counters: dict[str, int] = field(default_factory=dict)
    unknown_prefixes: list[str] = field(default_factory=list)

    def counts(self) -> dict:
        return checks.issue_counts(self.issues).head().asDict()


def validate_schema(spark: SparkSession, path: str, options: Options, service: Service | None = None) -> Result:
    service, schema = service or Service(spark, options), Schema.load(path)
    values = value_table(spark, schema.enums)
    issues = kept(checks.schema_meaning_issues(values, service.labels(values.where("meaning is not null").select(F.col("meaning").alias("curie"))), service.prefixes(), options.strict))
    counters = checks.schema_counters(values).head().asDict() | {"enums_checked": len(schema.enums)}
    return Result(issues, counters, sorted(service.unknown))


def run_checks(df: DataFrame, schema: Schema, some: list[Check], target_class: str | None = None, instance_id: Column | None = None) -> DataFrame:
    """The issues of one table of instances by checks that are prepared."""
    target = target_class or schema.root()
    if target not in schema.classes:
        raise ValueError(f"target class {target!r} is not in the schema")
    parts = [check.issues(df, target, instance_id) for check in some]
    return checks.union(parts) if parts else df.sparkSession.createDataFrame([], checks.ISSUES)


def validate_data(df: DataFrame, schema: Schema, service: Service, some: list[Check], target_class: str | None = None, instance_id: Column | None = None) -> DataFrame:
    """The issues of one table of instances by all given checks, with one service."""
    for check in some:
        check.prepare(service, schema)
    return run_checks(df, schema, some, target_class, instance_id)


def validate_text(spark: SparkSession, path: str, options: Options, pattern: str = MENTION, curie_group: int = 1, label_group: int = 2, service: Service | None = None) -> tuple[DataFrame, Result]:
    """The mentions of a text file and the issues among them."""
    service = service or Service(spark, options)
    pairs = kept(mentions.mentions(read_text(spark, path), pattern, curie_group, label_group))
    issues = kept(checks.pair_issues(pairs, service.labels(pairs.select("curie")), service.prefixes(), options.strict))
    return pairs, Result(issues, unknown_prefixes=sorted(service.unknown))
