"""Ontologies as two tables: terms(prefix, curie, label) and edges(subject, predicate, object)."""

from __future__ import annotations

import os
import sqlite3
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from termweave.functions.text import prefix_of
from termweave.sources.config import Options
from termweave.sources.storage import located

TERMS = "prefix string, curie string, label string"
EDGES = "subject string, predicate string, object string"
SUBCLASS = "rdfs:subClassOf"
#: Names of relations that OBO files write short.
RELATIONS = {"part_of": "BFO:0000050", "has_part": "BFO:0000051"}


class AdapterError(RuntimeError):
    """An adapter that can't be opened here."""


def read_obo(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Terms and edges of an OBO file; Spark reads it stanza by stanza. Comments after " ! " don't count."""
    stanza = F.regexp_replace("value", r"(?m)[ \t]+!.*$", "")
    terms = spark.read.option("lineSep", "\n[").text(located(path)).where(F.regexp_replace("value", r"^\[", "").startswith("Term]")).select(stanza.alias("s"))
    one = lambda tag: F.nullif(F.trim(F.regexp_extract("s", rf"(?m)^{tag}: *(.*)$", 1)), F.lit(""))
    every = lambda pattern, group: F.regexp_extract_all("s", F.lit(pattern), F.lit(group))
    labelled = terms.select(one("id").alias("curie"), one("name").alias("label")).where("curie is not null")
    is_a = terms.select(one("id").alias("subject"), F.lit(SUBCLASS).alias("predicate"), F.explode(every(r"(?m)^is_a: *(\S+)", 1)).alias("object"))
    pairs = F.arrays_zip(every(r"(?m)^relationship: *(\S+) +(\S+)", 1).alias("p"), every(r"(?m)^relationship: *(\S+) +(\S+)", 2).alias("o"))
    named = F.create_map(*(F.lit(x) for kv in RELATIONS.items() for x in kv))
    related = terms.select(one("id").alias("subject"), F.explode(pairs).alias("x")).select("subject", F.coalesce(named[F.col("x.p")], F.col("x.p")).alias("predicate"), F.col("x.o").alias("object"))
    return labelled.select(prefix_of(F.col("curie")).alias("prefix"), "curie", "label"), is_a.unionByName(related)


class SqliteOntology(DataSource):
    """Reads labels or edges of an ontology database: spark.read.format("ontology_sqlite").option("path", ...).option("table", "terms" or "edges")."""

    QUERIES = {"terms": "SELECT rowid, subject, value FROM rdfs_label_statement", "edges": "SELECT rowid, subject, predicate, object FROM edge"}

    @classmethod
    def name(cls) -> str:
        return "ontology_sqlite"

    def schema(self) -> str:
        return "curie string, label string" if self.options.get("table", "terms") == "terms" else EDGES

    def reader(self, schema) -> DataSourceReader:
        return _SqliteReader(self.options["path"], self.options.get("table", "terms"), int(self.options.get("partitions", "1")))


class _SqliteReader(DataSourceReader):
    def __init__(self, path: str, table: str, parts: int):
        self.path, self.query, self.parts = path, SqliteOntology.QUERIES[table], parts

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(self.parts)]

    def read(self, partition: InputPartition):
        con = sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)
        try:
            for _, *row in con.execute(f"SELECT * FROM ({self.query}) WHERE rowid % ? = ?", (self.parts, partition.value)):
                yield tuple(row)
        finally:
            con.close()


def read_sqlite(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    spark.dataSource.register(SqliteOntology)
    read = lambda table: spark.read.format("ontology_sqlite").option("path", os.path.abspath(path)).option("table", table).load()
    terms = read("terms")
    return terms.select(prefix_of(F.col("curie")).alias("prefix"), "curie", "label"), read("edges")


def read_snapshot(spark: SparkSession, path: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """A folder with terms and edges as Parquet or CSV, such as an earlier run or an export of a remote service left."""
    read = (lambda t: spark.read.parquet(located(f"{path}/{t}.parquet"))) if kind == "parquet" else (lambda t: spark.read.csv(located(f"{path}/{t}.csv"), header=True))
    terms = read("terms")
    return terms.select(prefix_of(F.col("curie")).alias("prefix"), "curie", "label"), read("edges").select("subject", "predicate", "object")


def open_adapter(spark: SparkSession, adapter: str, databases: str = "ontologies") -> tuple[DataFrame, DataFrame]:
    """simpleobo:FILE, sqlite:FILE, sqlite:obo:NAME (NAME.db in the folder of databases), parquet:FOLDER or csv:FOLDER. Services that need a network aren't reachable."""
    kind, _, rest = adapter.partition(":")
    if kind in ("simpleobo", "pronto", "obo"):
        return read_obo(spark, rest)
    if kind == "sqlite":
        return read_sqlite(spark, f"{databases}/{rest.removeprefix('obo:')}.db" if rest.startswith("obo:") else rest)
    if kind in ("parquet", "csv"):
        return read_snapshot(spark, rest, kind)
    raise AdapterError(f"adapter {adapter!r} needs a service that can't be reached from here; export a snapshot and use parquet: or csv:")


class OntologyCatalog:
    """Terms and edges of all prefixes that the options give an ontology; each adapter is opened once."""

    def __init__(self, spark: SparkSession, options: Options, loaded: dict[str, tuple[DataFrame, DataFrame]] | None = None, databases: str = "ontologies"):
        self.spark, self.options, self.databases = spark, options, databases
        self.loaded = dict(loaded or {})

    @classmethod
    def of_tables(cls, spark: SparkSession, terms: DataFrame, edges: DataFrame, prefixes: list[str], configured: dict[str, str] | None = None) -> "OntologyCatalog":
        """One ontology in memory that answers for the given prefixes."""
        options = Options(adapters=configured if configured is not None else {p: "memory:" for p in prefixes})
        return cls(spark, options, {"memory:": (terms, edges)})

    def tables(self, adapter: str) -> tuple[DataFrame, DataFrame]:
        if adapter not in self.loaded:
            self.loaded[adapter] = open_adapter(self.spark, adapter, self.databases)
        return self.loaded[adapter]

    def terms(self, prefixes: list[str]) -> DataFrame:
        """Terms of these prefixes, each from the ontology that answers for its prefix."""
        by_adapter: dict[str, list[str]] = {}
        for p in prefixes:
            if adapter := self.options.adapter_for(p):
                by_adapter.setdefault(adapter, []).append(p)
        parts = [self.tables(a)[0].where(F.col("prefix").isin(*ps)) for a, ps in by_adapter.items()]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], TERMS)

    def edges(self, prefix: str | None) -> DataFrame | None:
        """The graph in which a node of this prefix is looked up."""
        adapter = self.options.adapter_for(prefix)
        return self.tables(adapter)[1] if adapter else None
