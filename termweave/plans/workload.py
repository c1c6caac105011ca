"""A validation workload over the prepared tables: a place and part ontology, nested orders with planted faults, and text.

SOURCES are written in SQL that Spark and other engines share; the queries run the library over them, ORACLES say
the same in plain SQL.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.functions import severity
from termweave.functions.text import names_of, normalized, prefix_of
from termweave.operators import checks, closure, lookup, mentions, migrate, paths
from termweave.operators.enums import EnumCompiler
from termweave.plans import validate
from termweave.sources import ontology
from termweave.sources.config import Options, as_bool
from termweave.sources.data import read_data, read_text
from termweave.sources.ontology import SUBCLASS, OntologyCatalog
from termweave.sources.schema import Schema
from termweave.sources.snapshot import EnumCache, LabelCache
from termweave.sources.storage import kept, scratch_dir

PART_OF = "BFO:0000050"
PREFIXES = ["REGION", "NATION", "CUST", "SUPP", "PART", "BRAND", "PTYPE"]
#: ORDER has no ontology, EMPTY is switched off.
CONFIGURED = {p: "memory:" for p in PREFIXES} | {"EMPTY": ""}

#: Number of a line item by which faults are planted.
FAULT = "(l_orderkey * 7 + l_linenumber)"

SOURCES = {
    "terms": """
SELECT 'REGION' AS prefix, 'REGION:' || r_regionkey AS curie, r_name AS label FROM {region}
UNION ALL SELECT 'NATION', 'NATION:' || n_nationkey, n_name FROM {nation}
UNION ALL SELECT 'CUST', 'CUST:' || c_custkey, CASE WHEN c_custkey % 101 = 0 THEN NULL ELSE c_name END FROM {customer}
UNION ALL SELECT 'SUPP', 'SUPP:' || s_suppkey, s_name FROM {supplier}
UNION ALL SELECT 'PART', 'PART:' || p_partkey, p_name FROM {part}
UNION ALL SELECT DISTINCT 'BRAND', 'BRAND:' || p_brand, lower(p_brand) FROM {part}
UNION ALL SELECT DISTINCT 'PTYPE', 'PTYPE:' || p_type, lower(p_type) FROM {part}""",
    "edges": f"""
SELECT 'NATION:' || n_nationkey AS subject, '{SUBCLASS}' AS predicate, 'REGION:' || n_regionkey AS object FROM {{nation}}
UNION ALL SELECT 'CUST:' || c_custkey, '{SUBCLASS}', 'NATION:' || c_nationkey FROM {{customer}}
UNION ALL SELECT 'SUPP:' || s_suppkey, '{SUBCLASS}', 'NATION:' || s_nationkey FROM {{supplier}}
UNION ALL SELECT 'PART:' || p_partkey, '{SUBCLASS}', 'PTYPE:' || p_type FROM {{part}}
UNION ALL SELECT 'PART:' || p_partkey, '{PART_OF}', 'BRAND:' || p_brand FROM {{part}}
UNION ALL SELECT * FROM (VALUES ('X:1', '{SUBCLASS}', 'REGION:0'), ('X:2', '{SUBCLASS}', 'REGION:0'), ('X:3', '{SUBCLASS}', 'X:1'), ('X:3', '{SUBCLASS}', 'X:2'),
  ('Y:1', '{SUBCLASS}', 'Y:2'), ('Y:2', '{SUBCLASS}', 'Y:1'), ('Y:1', '{SUBCLASS}', 'REGION:1')) AS v(subject, predicate, object)""",
    "items": f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       CASE WHEN {FAULT} % 17 = 0 THEN NULL WHEN {FAULT} % 11 = 0 THEN 'PART:99999' || l_partkey WHEN {FAULT} % 13 = 0 THEN 'NOPE:' || l_partkey ELSE 'PART:' || l_partkey END AS part_id,
       CASE WHEN {FAULT} % 7 = 0 THEN p_name || ' wrong' WHEN {FAULT} % 5 = 0 THEN upper(p_name) || ' !!' ELSE p_name END AS part_label,
       'SUPP:' || l_suppkey AS supp_id, CASE WHEN {FAULT} % 19 = 0 THEN 'Another one' ELSE s_name END AS supp_label
FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey JOIN {{supplier}} ON l_suppkey = s_suppkey""",
    "values": """
SELECT 'Enum' || (p_partkey % 10) AS enum_name, 'VALUE_' || p_partkey AS value_name,
       CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_name END AS title, CASE WHEN p_partkey % 4 = 0 THEN p_type END AS description,
       CASE WHEN p_partkey % 5 = 0 THEN upper(p_name) || '.' END AS alias, CASE WHEN p_partkey % 7 = 0 THEN p_name || '!' END AS note,
       CASE WHEN p_partkey % 11 = 0 THEN 'PART:99999' || p_partkey WHEN p_partkey % 13 = 0 THEN 'NOPE:' || p_partkey WHEN p_partkey % 17 = 0 THEN NULL ELSE 'PART:' || p_partkey END AS meaning
FROM {part}""",
    "texts": """
SELECT doc_id, text || chr(10) || '- @term NATION:' || (doc_id % 30) || ' "NATION_' || (doc_id % 25) || '" and @term EMPTY:1 "x"' || chr(10) || '@term NOPE:2 "two"' AS text FROM {documents}""",
    "cache": """
SELECT 'cust' AS file, CAST(o_orderkey AS INT) AS row_no, 'CUST:' || o_custkey AS curie,
       CASE WHEN o_orderkey % 3 = 0 THEN 'old name' ELSE c_name END AS label, '2025-0' || (1 + o_orderkey % 9) || '-01' AS retrieved_at
FROM {orders} JOIN {customer} ON o_custkey = c_custkey
UNION ALL SELECT 'nation', n_nationkey, 'NATION:' || (n_nationkey + 100), n_name, '2025-01-01' FROM {nation}""",
}

SCHEMA = {
    "classes": {
        "Order": {
            "tree_root": True,
            "attributes": {
                "order_id": {"identifier": True},
                "priority": {"range": "PriorityEnum"},
                "state": {"range": "StatusListEnum"},
                "status": {"range": "Status", "bindings": [{"binds_value_of": "code", "range": "StatusEnum", "obligation_level": "REQUIRED"}]},
                "items": {"range": "Item", "multivalued": True},
            },
        },
        "Status": {"attributes": {"code": {}}},
        "Item": {
            "attributes": {
                "part": {"range": "PartRef", "bindings": [{"binds_value_of": "id", "range": "PartEnum", "obligation_level": "REQUIRED"}]},
                "supplier": {"range": "SupplierRef", "bindings": [{"binds_value_of": "id", "range": "SupplierEnum"}]},
            }
        },
        "PartRef": {"attributes": {"id": {}, "name": {"implements": ["rdfs:label"]}}},
        "SupplierRef": {"attributes": {"id": {}, "label": {}}},
    },
    "enums": {
        "PriorityEnum": {"concepts": ["1-URGENT", "2-HIGH", "3-MEDIUM"]},
        "StatusEnum": {"permissible_values": {"O": {}, "F": {}}},
        "PartEnum": {"reachable_from": {"source_nodes": ["PTYPE:SMALL", "PTYPE:LARGE", "PTYPE:PROMO"]}},
        "SupplierEnum": {"reachable_from": {"source_nodes": ["REGION:0", "REGION:1", "REGION:2"]}},
        "UnionEnum": {"reachable_from": {"source_nodes": ["REGION:3", "NATION:1"]}, "concepts": ["A:1", "NATION:1"], "permissible_values": {"OWN": {"meaning": "A:2"}, "A:1": {}}},
        "PatternEnum": {"matches": {"identifier_pattern": "NATION:1[0-9]"}},
        "StatusListEnum": {"permissible_values": {"O": {}, "X": {"meaning": "Y"}}},
        "BaseEnum": {"reachable_from": {"source_nodes": ["REGION:0"], "include_self": True}},
        "IncludeEnum": {"concepts": ["A:1"], "include": [{"reachable_from": {"source_nodes": ["REGION:1"]}}, {"concepts": ["A:2"]}, {"permissible_values": {"P_ONE": {"meaning": "A:3"}}}]},
        "MinusEnum": {"reachable_from": {"source_nodes": ["REGION:2"], "include_self": True}, "minus": [{"reachable_from": {"source_nodes": ["NATION:2"]}}, {"concepts": ["NATION:7"]}]},
        "HeirEnum": {"concepts": ["A:9"], "inherits": ["BaseEnum"], "permissible_values": {"OWN": {"meaning": "NATION:0"}}},
        "FullEnum": {"reachable_from": {"source_nodes": ["NATION:3"]}, "concepts": ["A:5", "A:6"], "include": [{"reachable_from": {"source_nodes": ["NATION:4"], "include_self": True}}], "minus": [{"concepts": ["A:6", "NATION:0"]}], "inherits": ["HeirEnum"], "permissible_values": {"OWN": {}, "A:6": {}}},
    },
}


class Workload:
    """The sources over one folder of tables, made as they are asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.schema = spark, sf_dir, Schema.of(SCHEMA)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def source(self, name: str) -> DataFrame:
        sql = SOURCES[name]
        used = {t: self.table(t) for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents") if "{" + t + "}" in sql}
        return self.spark.sql(sql, **used)

    def prefixes(self) -> DataFrame:
        return self.spark.createDataFrame([(p, a, bool(a)) for p, a in CONFIGURED.items()], "prefix string, adapter string, configured boolean")

    def catalog(self) -> OntologyCatalog:
        return OntologyCatalog.of_tables(self.spark, self.source("terms"), self.source("edges"), PREFIXES, CONFIGURED)

    def compiler(self) -> EnumCompiler:
        return EnumCompiler(self.catalog(), self.schema.enums)

    def orders(self) -> DataFrame:
        part = F.struct(F.col("part_id").alias("id"), F.col("part_label").alias("name"))
        supplier = F.struct(F.col("supp_id").alias("id"), F.col("supp_label").alias("label"))
        item = F.struct("l_linenumber", "l_partkey", "l_suppkey", part.alias("part"), supplier.alias("supplier"))
        items = self.source("items").groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: F.struct(x["part"].alias("part"), x["supplier"].alias("supplier"))).alias("items"))
        orders = self.table("orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
        code = F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderstatus"))
        return orders.join(items, orders.o_orderkey == items.l_orderkey, "left").select(
            F.concat(F.lit("ORDER:"), F.col("o_orderkey").cast("string")).alias("order_id"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("state"), F.struct(code.alias("code")).alias("status"), "items"
        )

    def bound(self) -> DataFrame:
        return paths.bound_values(self.orders(), self.schema, "Order", F.col("order_id"))

    def static(self, names: list[str]) -> DataFrame:
        return validate.static_members(self.spark, [self.schema.enums[n] for n in names])

    def values(self) -> DataFrame:
        one = lambda c: F.array_compact(F.array(c))
        notes = F.create_map(F.lit("label"), F.col("note"), F.lit("other"), F.lit("not a name"))
        return self.source("values").withColumn("aliases", one("alias")).withColumn("annotations", notes)

    def labels(self, curies: DataFrame) -> DataFrame:
        return lookup.labels(curies, self.source("terms"))


def _shown(issues: DataFrame) -> DataFrame:
    return issues.withColumn("context", F.array_join("context", "|"))


def _saved(w: Workload, name: str) -> str:
    """A folder of the query's own in the shared one."""
    return f"{scratch_dir(w.spark)}/{name}-{uuid.uuid4().hex}"


def prefix_routing(w: Workload) -> DataFrame:
    """Which adapter answers for the prefixes in use: by a mapping, and by default."""
    asked = w.source("items").select(prefix_of(F.col("part_id")).alias("prefix")).union(w.source("terms").select("prefix")).where("prefix is not null").distinct()
    mapped = Options(adapters=CONFIGURED).routes(asked).withColumnRenamed("adapter", "mapped")
    return Options().routes(mapped).select("prefix", "mapped", F.col("adapter").alias("default_adapter"))


def config_booleans(w: Workload) -> DataFrame:
    """What a configuration may write for a switch; null for what is an error."""

    def read(value: object) -> bool | None:
        try:
            return as_bool(value, "x")
        except ValueError:
            return None

    given = {"yes, in YAML": True, "false, in YAML": False, " True ": " True ", "FALSE": "FALSE", "1": 1, "on": "on", "none": None}
    return w.spark.createDataFrame([(k, read(v)) for k, v in given.items()], "written string, value boolean")


def label_cache_upsert(w: Workload) -> DataFrame:
    """Two saves of one prefix and what is loaded then: labels that change get the later time. Labels hold quotes and line breaks."""
    cache = LabelCache(w.spark, _saved(w, "labels"))
    names = w.table("customer").where("c_custkey % 7 = 0").select(F.concat(F.lit("CUST:"), F.col("c_custkey").cast("string")).alias("curie"), F.col("c_name").alias("label"))
    cache.save("CUST", names.where("curie not like '%4'"), now="2025-01-01")
    changed = F.when(F.col("curie").like("%1"), F.concat("label", F.lit('\n"new"'))).otherwise(F.col("label"))
    cache.save("CUST", names.withColumn("label", changed), now="2025-02-02")
    return cache.load(["CUST"])


def label_cache_files(w: Workload) -> DataFrame:
    """Rows of all cache files of a folder, as written."""
    cache = LabelCache(w.spark, _saved(w, "labels"))
    for prefix in ("NATION", "REGION"):
        cache.save(prefix, w.source("terms").where(F.col("prefix") == prefix).select("curie", "label"), now="2025-01-01")
    found = [cache.files.uri(p) for p in cache.files.list(cache.folder, "*/terms.csv")]
    return w.spark.read.option("header", True).csv(found).select("curie", "label", "retrieved_at")


def enum_cache_append(w: Workload) -> DataFrame:
    """A partial snapshot grows, a complete one replaces; the mark tells which is which."""
    cache, spec = EnumCache(w.spark, _saved(w, "enums")), w.schema.enums["BaseEnum"]
    nations = w.source("terms").where("prefix = 'NATION'").select(F.col("curie").alias("value"))
    cache.save(spec, nations.where("value like '%1'"), complete=False)
    cache.save(spec, nations.where("value like '%2' or value like '%1'"), complete=False)
    some = kept(cache.load(spec).withColumn("complete", F.lit(cache.is_complete(spec))))
    cache.save(spec, nations.where("value like '%3'"), complete=True)
    return some.union(cache.load(spec).withColumn("complete", F.lit(cache.is_complete(spec))))


def _obo(w: Workload) -> tuple[DataFrame, DataFrame]:
    """Regions and nations written as an OBO file and read again."""
    links = w.source("edges").where("object like 'REGION:%'")
    rows = w.source("terms").where("prefix in ('REGION', 'NATION')").join(links, F.col("curie") == F.col("subject"), "left")
    isa = F.coalesce(F.concat(F.lit("\nis_a: "), F.col("object"), F.lit(" ! a region")), F.lit(""))
    path = _saved(w, "obo")
    rows.select(F.concat(F.lit("[Term]\nid: "), F.col("curie"), F.lit("\nname: "), F.col("label"), isa, F.lit("\n"))).coalesce(1).write.text(path)
    return ontology.read_obo(w.spark, path)


def obo_terms(w: Workload) -> DataFrame:
    return _obo(w)[0]


def obo_edges(w: Workload) -> DataFrame:
    return _obo(w)[1]


def snapshot_terms(w: Workload) -> DataFrame:
    """Terms by an adapter string: a folder of Parquet files."""
    path = _saved(w, "snapshot")
    w.source("terms").select("curie", "label").write.parquet(f"{path}/terms.parquet")
    w.source("edges").write.parquet(f"{path}/edges.parquet")
    options = Options(adapters={"NATION": f"parquet:{path}", "REGION": ""})
    return OntologyCatalog(w.spark, options).terms(["NATION", "REGION", "CUST"])


def json_records(w: Workload) -> DataFrame:
    """Nested records from JSON lines, with the types of all of them: a slot that is a list here and a text there is a list."""
    path = _saved(w, "records") + ".jsonl"
    parts = F.transform("items", lambda x: x["part"]["id"])
    one, more = F.to_json(F.struct(F.element_at(parts, 1).alias("part"))), F.to_json(F.struct(parts.alias("part")))
    held = F.when(F.col("items").isNull(), F.lit("null")).when(F.size("items") == 1, one).otherwise(more)
    w.orders().select(F.concat(F.lit('{"order_id": "'), F.col("order_id"), F.lit('", "n": 1, "held": '), held, F.lit("}"))).write.text(path)
    rows = read_data(w.spark, path)
    return rows.select("order_id", F.explode("held.part").alias("part")).where("part is not null")


def text_file_mentions(w: Workload) -> DataFrame:
    """Mentions in a text file, with a pattern of one's own whose label comes first."""
    path = _saved(w, "text")
    key = F.col("n_nationkey").cast("string")
    w.table("nation").select(F.concat(F.col("n_name"), F.lit("=NATION:"), key, F.lit(" and more"))).coalesce(1).write.text(path)
    return mentions.mentions(read_text(w.spark, path), r"([^=]+)=(NATION:\d+)", 2, 1).select("curie", "label")


def static_enum_violations(w: Workload) -> DataFrame:
    values = paths.slot_values(w.orders(), w.schema, "Order", False, F.col("order_id"))
    return _shown(checks.direct_static_violations(values, w.static(list(w.schema.enums)))).select("instance_id", "severity", "message", "context")


def direct_enum_progressive(w: Workload) -> DataFrame:
    """The default evaluation: membership is asked for the values that occur, and the size of the enumeration isn't known."""
    values = kept(paths.slot_values(w.orders(), w.schema, "Order", instance_id=F.col("order_id")))
    members = w.compiler().table(["PriorityEnum"], values, "progressive")
    return _shown(checks.direct_enum_violations(values, members)).select("instance_id", "severity", "message", "context")


def binding_enum_progressive(w: Workload) -> DataFrame:
    bound, dynamic = kept(w.bound()), ["PartEnum", "SupplierEnum"]
    members = w.compiler().table(dynamic, bound.where("value_is_string"), "progressive").union(w.static(["StatusEnum"]))
    kinds = w.spark.createDataFrame([(n, w.schema.enums[n].dynamic) for n in [*dynamic, "StatusEnum"]], "enum_name string, dynamic boolean")
    return _shown(checks.binding_enum_violations(bound, members, kinds)).select("instance_id", "path", "severity", "message", "context")


def enum_matches(w: Workload) -> DataFrame:
    return EnumCompiler(w.catalog(), w.schema.enums, match_patterns=True).expand("PatternEnum")


def curie_prefix(w: Workload) -> DataFrame:
    key = F.col("o_orderkey")
    text = key.cast("string")
    curie = F.when(key % 5 == 0, "").when(key % 5 == 1, F.concat(F.lit(":"), text)).when(key % 5 == 2, F.concat(F.lit("plain"), text)).otherwise(F.concat(F.lit("ORD:"), text, F.lit(":x")))
    return w.table("orders").select("o_orderkey", curie.alias("curie")).select("o_orderkey", "curie", prefix_of(F.col("curie")).alias("prefix"))


def normalize_label(w: Workload) -> DataFrame:
    text = normalized(F.col("text"))
    return w.table("documents").select("doc_id", F.md5(text.cast("binary")).alias("normalized_md5"), F.length(text).cast("long").alias("n"))


def prefix_configured(w: Workload) -> DataFrame:
    asked = w.source("items").select(F.col("part_id").alias("curie")).unionByName(w.source("items").select(F.col("supp_id").alias("curie"))).select(prefix_of(F.col("curie")).alias("prefix")).where("prefix is not null").distinct()
    return asked.join(w.prefixes(), "prefix", "left").select("prefix", F.coalesce("configured", F.lit(False)).alias("configured"))


def pv_alias_set(w: Workload) -> DataFrame:
    names = names_of(F.col("value_name"), F.col("title"), F.col("description"), F.col("aliases"), F.col("annotations"))
    return w.values().select("value_name", F.array_join(names, "|").alias("names"))


def text_mentions(w: Workload) -> DataFrame:
    return mentions.mentions(w.source("texts"))


def severity_case(w: Workload) -> DataFrame:
    key = F.col("o_orderkey")
    configured, strict = key % 2 == 0, key % 3 == 0
    return w.table("orders").select("o_orderkey", severity.unresolved(configured, strict).alias("unresolved"), severity.mismatched(configured, strict).alias("mismatched"), severity.plugin_mismatched(strict).alias("plugin_mismatched"))


def nested_paths(w: Workload) -> DataFrame:
    return w.bound().select("instance_id", "path", "slot", "field", "value", "enum_name")


def label_lookup(w: Workload) -> DataFrame:
    curies = w.source("items").select(F.col("part_id").alias("curie")).unionByName(w.source("cache").select("curie"))
    cache = migrate.last_wins(w.source("cache").where("file = 'cust'")).select("curie", "label")
    return lookup.labels(curies, w.source("terms"), cache)


def unknown_prefixes(w: Workload) -> DataFrame:
    return lookup.unknown_prefixes(mentions.mentions(w.source("texts")).select("curie"), w.prefixes())


def direct_enum_violations(w: Workload) -> DataFrame:
    values = paths.slot_values(w.orders(), w.schema, "Order", instance_id=F.col("order_id"))
    members = w.compiler().table(["PriorityEnum"], values, "greedy")
    return _shown(checks.direct_enum_violations(values, members, counted=True)).select("instance_id", "severity", "message", "context")


def binding_enum_violations(w: Workload) -> DataFrame:
    bound, c = w.bound(), w.compiler()
    members = c.table(["PartEnum", "SupplierEnum", "StatusEnum"], bound.select("enum_name", "value"), "greedy")
    kinds = w.spark.createDataFrame([(n, w.schema.enums[n].dynamic) for n in ("PartEnum", "SupplierEnum", "StatusEnum")], "enum_name string, dynamic boolean")
    return _shown(checks.binding_enum_violations(bound, members, kinds, counted=True)).select("instance_id", "path", "severity", "message", "context")


def term_not_found(w: Workload) -> DataFrame:
    return _shown(checks.terms_not_found(w.bound(), w.source("terms"), w.prefixes())).select("instance_id", "path", "severity", "message", "context")


def binding_label_mismatch(w: Workload) -> DataFrame:
    bound = w.bound()
    labels = w.source("terms").select("curie", "label")
    return _shown(checks.label_mismatches(bound, labels)).select("instance_id", "path", "severity", "message", "context")


def schema_meaning_issues(w: Workload) -> DataFrame:
    values = w.values()
    return checks.schema_meaning_issues(values, w.labels(values.select(F.col("meaning").alias("curie"))), w.prefixes())


def plugin_meaning_issues(w: Workload) -> DataFrame:
    values = w.values()
    return _shown(checks.plugin_meaning_issues(values, w.labels(values.select(F.col("meaning").alias("curie"))))).select("type", "severity", "message", "instantiates", "context")


def text_pair_issues(w: Workload) -> DataFrame:
    pairs = mentions.mentions(w.source("texts")).select(F.concat(F.col("doc_id").cast("string"), F.lit("/"), F.col("location")).alias("location"), "curie", "label")
    return checks.pair_issues(pairs, w.labels(pairs.select("curie")), w.prefixes())


def required_binding_missing(w: Workload) -> DataFrame:
    return _shown(checks.required_missing(w.bound())).select("instance_id", "path", "severity", "message", "context")


def _roots(w: Workload, *rows) -> DataFrame:
    return w.spark.createDataFrame(rows, "query_id int, node string, include_self boolean")


def closure_descendants(w: Workload) -> DataFrame:
    return closure.closure(w.source("edges"), _roots(w, (0, "REGION:0", False), (1, "REGION:1", True), (2, "Y:1", False), (3, "Y:2", True)), [SUBCLASS])


def closure_ancestors(w: Workload) -> DataFrame:
    return closure.closure(w.source("edges"), _roots(w, (0, "X:3", False), (1, "CUST:1", True), (2, "Y:1", False)), [SUBCLASS], up=True)


def closure_membership(w: Workload) -> DataFrame:
    values = w.table("orders").select(F.concat(F.lit("CUST:"), F.col("o_custkey").cast("string")).alias("value"))
    return closure.members(w.source("edges"), values, _roots(w, (0, "REGION:0", False), (1, "NATION:1", False), (1, "NATION:2", False), (2, "CUST:1", True)), [SUBCLASS])


def closure_multi_source(w: Workload) -> DataFrame:
    return closure.closure(w.source("edges"), _roots(w, (0, "NATION:1", False), (0, "NATION:6", False), (0, "REGION:1", False)), [SUBCLASS])


def closure_multi_predicate(w: Workload) -> DataFrame:
    return closure.closure(w.source("edges"), _roots(w, (0, "BRAND:Brand#1", False), (0, "PTYPE:SMALL", False)), [SUBCLASS, PART_OF])


def _expanded(name: str) -> Callable[[Workload], DataFrame]:
    return lambda w: w.compiler().expand(name)


def enum_progressive(w: Workload) -> DataFrame:
    """Members among the data's values by the evaluation that walks up from them."""
    values = w.source("cache").select(F.col("curie").alias("value"))
    return w.compiler().accepted("BaseEnum", values)


def schema_counters(w: Workload) -> DataFrame:
    return checks.schema_counters(w.values())


def issue_counts(w: Workload) -> DataFrame:
    return checks.issue_counts(schema_meaning_issues(w))


def issues_per_file(w: Workload) -> DataFrame:
    issues = text_pair_issues(w).withColumn("file", F.substring_index("enum_name", "/", 1))
    return checks.issues_per_file(w.table("documents").select(F.col("doc_id").cast("string").alias("file")), issues)


def cache_dedup_latest(w: Workload) -> DataFrame:
    return migrate.latest(w.source("cache"))


def cache_last_wins(w: Workload) -> DataFrame:
    return migrate.last_wins(w.source("cache"))


def sorted_snapshot(w: Workload) -> DataFrame:
    """Each snapshot's order: the rows are numbered as they are written."""
    return migrate.placed(migrate.latest(w.source("cache")).select("file", "curie", "label")).select("file", "place", "curie", "label")


def cache_needs_rewrite(w: Workload) -> DataFrame:
    rows = w.source("cache")
    return migrate.plan(rows, migrate.relabelled(migrate.latest(rows), w.source("terms"), "now"))


def cache_relabel(w: Workload) -> DataFrame:
    return migrate.relabelled(migrate.latest(w.source("cache")), w.source("terms"), "2026-01-01")


_FUNCTIONS = {
    f.__name__: f
    for f in (
        curie_prefix, normalize_label, prefix_configured, pv_alias_set, text_mentions, severity_case, nested_paths, label_lookup, unknown_prefixes, direct_enum_violations,
        binding_enum_violations, term_not_found, binding_label_mismatch, schema_meaning_issues, plugin_meaning_issues, text_pair_issues, required_binding_missing,
        closure_descendants, closure_ancestors, closure_membership, closure_multi_source, closure_multi_predicate, enum_progressive, schema_counters, issue_counts, issues_per_file,
        cache_dedup_latest, cache_last_wins, sorted_snapshot, cache_needs_rewrite, cache_relabel,
        prefix_routing, config_booleans, label_cache_upsert, label_cache_files, enum_cache_append, obo_terms, obo_edges, snapshot_terms, json_records,
        text_file_mentions, static_enum_violations, direct_enum_progressive, binding_enum_progressive, enum_matches,
    )
} | {"enum_union": _expanded("UnionEnum"), "enum_include": _expanded("IncludeEnum"), "enum_minus": _expanded("MinusEnum"), "enum_inherits": _expanded("HeirEnum"), "enum_expand_full": _expanded("FullEnum")}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: (lambda spark, sf_dir, f=f: f(Workload(spark, sf_dir))) for name, f in _FUNCTIONS.items()}


# The same in plain SQL.


def _sources(*names: str) -> str:
    tables = {t: t for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents")}
    named = {"values": "pvs"}
    return ",\n".join(f"{named.get(n, n)} AS ({SOURCES[n].format(**tables)})" for n in names)


def _norm(x: str) -> str:
    return rf"trim(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"


_CONFIGURED = "(VALUES " + ", ".join(f"('{p}')" for p in PREFIXES) + ") AS configured(prefix)"
_BOUND = """
numbered AS (SELECT *, 'ORDER:' || l_orderkey AS instance_id, 'items[' || (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1) || ']' AS item FROM items JOIN orders ON l_orderkey = o_orderkey),
bound AS (
  SELECT instance_id, item || '.part' AS path, 'part' AS slot, 'id' AS field, part_id AS value, 'PartEnum' AS enum_name, 'REQUIRED' AS obligation, 'name' AS label_field, part_label AS label FROM numbered
  UNION ALL SELECT instance_id, item || '.supplier', 'supplier', 'id', supp_id, 'SupplierEnum', NULL, 'label', supp_label FROM numbered
  UNION ALL SELECT 'ORDER:' || o_orderkey, 'status', 'status', 'code', CASE WHEN o_orderkey % 10 <> 0 THEN o_orderstatus END, 'StatusEnum', 'REQUIRED', NULL, NULL FROM orders)"""
_WHERE = "'path: ' || path || '|slot: ' || slot"
_MENTIONS = """
lines AS (SELECT doc_id, unnest(string_split_regex(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]')) AS line, unnest(range(1, len(string_split_regex(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]')) + 1)) AS line_no FROM texts),
mentions AS (
  SELECT doc_id, 'line:' || line_no AS location, unnest(regexp_extract_all(line, '@term (\\S+) "([^"]*)"', 1)) AS curie, unnest(regexp_extract_all(line, '@term (\\S+) "([^"]*)"', 2)) AS label
  FROM lines WHERE contains(line, '@term '))"""
_PREFIX = "CASE WHEN instr(curie, ':') > 1 THEN split_part(curie, ':', 1) END"


def _members(*sets: tuple[str, str]) -> str:
    """reach(enum_name, node) of the closures below (enum, 'A', 'B')."""
    rows = ", ".join(f"('{enum}', '{node}')" for enum, node in sets)
    return f"""
roots(enum_name, root) AS (VALUES {rows}),
reach(enum_name, node) AS (
  SELECT enum_name, subject FROM roots JOIN edges ON object = root AND predicate = '{SUBCLASS}'
  UNION SELECT r.enum_name, e.subject FROM reach r JOIN edges e ON e.object = r.node AND e.predicate = '{SUBCLASS}')"""


def _closure(rows: list[tuple[int, str, bool]], predicates: tuple[str, ...] = (SUBCLASS,), up: bool = False) -> str:
    here, there = ("subject", "object") if up else ("object", "subject")
    roots = ", ".join(f"({q}, '{n}', {s})" for q, n, s in rows)
    among = ", ".join(f"'{p}'" for p in predicates)
    return f"""WITH RECURSIVE {_sources("edges")},
roots(query_id, source, own) AS (VALUES {roots}),
reach(query_id, source, node) AS (
  SELECT query_id, source, source FROM roots
  UNION SELECT r.query_id, r.source, e.{there} FROM reach r JOIN edges e ON e.{here} = r.node AND e.predicate IN ({among}))
SELECT DISTINCT query_id, node FROM reach WHERE node <> source UNION SELECT query_id, source FROM roots WHERE own"""


def _below(root: str) -> str:
    return f"""(WITH RECURSIVE r(node) AS (SELECT subject FROM edges WHERE object = '{root}' AND predicate = '{SUBCLASS}' UNION SELECT e.subject FROM r JOIN edges e ON e.object = r.node AND e.predicate = '{SUBCLASS}') SELECT node AS value FROM r WHERE node <> '{root}')"""


def _listed(*values: str) -> str:
    return "(SELECT unnest([" + ", ".join(f"'{v}'" for v in values) + "]) AS value)"


_BASE = f"SELECT value FROM {_below('REGION:0')} UNION SELECT value FROM {_listed('REGION:0')}"
_HEIR = f"SELECT value FROM {_listed('A:9', 'OWN', 'NATION:0')} UNION {_BASE}"
_MENTION_PAIRS = f"""WITH {_sources("texts", "terms")}, {_MENTIONS},
pairs AS (SELECT doc_id, doc_id || '/' || location AS location, m.curie, m.label, t.label AS actual_label, EXISTS (SELECT 1 FROM {_CONFIGURED} WHERE prefix = {_PREFIX.replace('curie', 'm.curie')}) AS configured FROM mentions m LEFT JOIN terms t ON m.curie = t.curie),
issues AS (
  SELECT doc_id, location AS enum_name, curie AS value_name, 'ERROR' AS severity,
         CASE WHEN actual_label IS NULL THEN 'Unresolvable CURIE: ' || curie ELSE 'Label mismatch for ' || curie || ': expected ''' || label || ''', got ''' || actual_label || '''' END AS message,
         curie AS meaning, label AS expected_label, actual_label
  FROM pairs WHERE (actual_label IS NULL AND configured) OR (actual_label IS NOT NULL AND {_norm('actual_label')} <> {_norm('label')}))"""
_NAMES = f"list_sort(list_distinct(list_transform(list_filter([value_name, title, description, alias, note], lambda x: x IS NOT NULL AND x <> ''), lambda x: {_norm('x')})))"
_MEANINGS = f"""WITH {_sources("values", "terms")},
named AS (SELECT p.*, t.label AS actual_label, {_NAMES} AS names, meaning LIKE 'PART:%' AS configured FROM pvs p LEFT JOIN terms t ON meaning = curie WHERE meaning IS NOT NULL),
issues AS (
  SELECT enum_name, value_name, CASE WHEN configured THEN 'ERROR' WHEN actual_label IS NULL THEN 'INFO' ELSE 'WARNING' END AS severity,
         CASE WHEN actual_label IS NULL AND configured THEN 'Could not retrieve label for ' || meaning WHEN actual_label IS NULL THEN 'Unconfigured prefix, could not validate ' || meaning ELSE 'Label mismatch for ' || meaning END AS message,
         meaning, CASE WHEN actual_label IS NOT NULL THEN array_to_string(names, ', ') END AS expected_label, actual_label
  FROM named WHERE actual_label IS NULL OR NOT list_contains(names, {_norm('actual_label')}))"""
_LATEST = "latest AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY file, curie ORDER BY retrieved_at DESC, row_no) AS n FROM cache) WHERE n = 1)"
_RELABELLED = f"""WITH {_sources("cache", "terms")}, {_LATEST},
relabelled AS (SELECT l.file, l.row_no, l.curie, coalesce(t.label, l.label) AS label, coalesce(t.label <> l.label, false) AS changed, CASE WHEN t.label <> l.label THEN '2026-01-01' ELSE retrieved_at END AS retrieved_at FROM latest l LEFT JOIN terms t ON l.curie = t.curie)"""

ORACLES: dict[str, str] = {
    "curie_prefix": f"SELECT o_orderkey, curie, {_PREFIX} AS prefix FROM (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN ':' || o_orderkey WHEN 2 THEN 'plain' || o_orderkey ELSE 'ORD:' || o_orderkey || ':x' END AS curie FROM orders)",
    "normalize_label": f"SELECT doc_id, md5({_norm('text')}) AS normalized_md5, length({_norm('text')})::BIGINT AS n FROM documents",
    "prefix_configured": f"WITH {_sources('items')}, c AS (SELECT part_id AS curie FROM items UNION SELECT supp_id FROM items) SELECT DISTINCT prefix, prefix <> 'NOPE' AS configured FROM (SELECT {_PREFIX} AS prefix FROM c) WHERE prefix IS NOT NULL",
    "pv_alias_set": f"WITH {_sources('values')} SELECT value_name, array_to_string({_NAMES}, '|') AS names FROM pvs",
    "text_mentions": f"WITH {_sources('texts')}, {_MENTIONS} SELECT * FROM mentions",
    "severity_case": "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 OR o_orderkey % 3 = 0 THEN 'ERROR' ELSE 'INFO' END AS unresolved, CASE WHEN o_orderkey % 2 = 0 OR o_orderkey % 3 = 0 THEN 'ERROR' ELSE 'WARNING' END AS mismatched, CASE WHEN o_orderkey % 3 = 0 THEN 'ERROR' ELSE 'WARN' END AS plugin_mismatched FROM orders",
    "nested_paths": f"WITH {_sources('items')}, {_BOUND} SELECT instance_id, path, slot, field, value, enum_name FROM bound",
    "label_lookup": f"""WITH {_sources('items', 'cache', 'terms')}, c AS (SELECT part_id AS curie FROM items WHERE part_id IS NOT NULL UNION SELECT curie FROM cache),
held AS (SELECT curie, arg_max(label, row_no) AS cached FROM cache WHERE file = 'cust' GROUP BY curie)
SELECT c.curie, coalesce(cached, label) AS label FROM c LEFT JOIN held USING (curie) LEFT JOIN terms t ON t.curie = c.curie""",
    "unknown_prefixes": f"WITH {_sources('texts')}, {_MENTIONS} SELECT DISTINCT {_PREFIX} AS prefix FROM mentions WHERE {_PREFIX} NOT IN (SELECT prefix FROM {_CONFIGURED})",
    "direct_enum_violations": "SELECT 'ORDER:' || o_orderkey AS instance_id, 'ERROR' AS severity, 'Value ''' || o_orderpriority || ''' not in dynamic enum ''PriorityEnum'' (expanded from ontology)' AS message, 'slot: priority|enum: PriorityEnum|allowed_values: 3 terms' AS context FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')",
    "binding_enum_violations": f"""WITH RECURSIVE {_sources('items', 'edges')}, {_BOUND}, {_members(('PartEnum', 'PTYPE:SMALL'), ('PartEnum', 'PTYPE:LARGE'), ('PartEnum', 'PTYPE:PROMO'), ('SupplierEnum', 'REGION:0'), ('SupplierEnum', 'REGION:1'), ('SupplierEnum', 'REGION:2'))},
members AS (SELECT enum_name, node AS value FROM reach UNION SELECT 'StatusEnum', unnest(['O', 'F'])),
n AS (SELECT enum_name, count(*) AS n FROM members GROUP BY enum_name)
SELECT instance_id, path, 'ERROR' AS severity, 'Value ''' || value || ''' not in ' || CASE enum_name WHEN 'StatusEnum' THEN 'enum ''StatusEnum''' ELSE 'dynamic enum ''' || enum_name || ''' (expanded from ontology)' END AS message,
       {_WHERE} || '|field: ' || field || '|allowed_values: ' || n || ' terms' AS context
FROM bound b JOIN n USING (enum_name) WHERE value IS NOT NULL AND NOT EXISTS (SELECT 1 FROM members m WHERE m.enum_name = b.enum_name AND m.value = b.value)""",
    "term_not_found": f"""WITH {_sources('items', 'terms')}, {_BOUND}
SELECT instance_id, path, 'ERROR' AS severity, 'Term ''' || value || ''' not found in ontology' AS message, {_WHERE} || '|field: ' || field || '|prefix: ' || split_part(value, ':', 1) || ' (configured in oak_config)' AS context
FROM bound b WHERE split_part(value, ':', 1) IN (SELECT prefix FROM {_CONFIGURED}) AND instr(value, ':') > 1 AND NOT EXISTS (SELECT 1 FROM terms WHERE curie = value AND label <> '')""",
    "binding_label_mismatch": f"""WITH {_sources('items', 'terms')}, {_BOUND}
SELECT instance_id, path, 'WARN' AS severity, 'Label mismatch for ''' || value || ''': expected ''' || t.label || ''', got ''' || b.label || '''' AS message, {_WHERE} || '|label_field: ' || label_field || '|curie: ' || value AS context
FROM bound b JOIN terms t ON value = curie WHERE b.label IS NOT NULL AND {_norm('t.label')} <> {_norm('b.label')}""",
    "schema_meaning_issues": _MEANINGS + " SELECT * FROM issues",
    "plugin_meaning_issues": f"""WITH {_sources('values', 'terms')},
named AS (SELECT p.*, t.label AS actual_label, list_transform(list_filter([value_name, title, description, alias], lambda x: x <> ''), lambda x: {_norm('x')}) AS names, list_filter([title, description], lambda x: x <> '') AS given FROM pvs p LEFT JOIN terms t ON meaning = curie WHERE meaning IS NOT NULL)
SELECT CASE WHEN actual_label IS NULL THEN 'permissible_value_meaning' ELSE 'permissible_value_label_mismatch' END AS type, CASE WHEN actual_label IS NULL THEN 'ERROR' ELSE 'WARN' END AS severity,
       CASE WHEN actual_label IS NULL THEN 'Ontology term ''' || meaning || ''' not found' ELSE 'Label mismatch for ' || meaning || ': expected one of [' || array_to_string(list_transform(given, lambda x: '''' || x || ''''), ', ') || '], but ontology has ''' || actual_label || '''' END AS message,
       enum_name AS instantiates, 'enum: ' || enum_name || '|value: ' || value_name AS context
FROM named WHERE actual_label IS NULL OR (len(given) > 0 AND NOT list_contains(names, {_norm('actual_label')}))""",
    "text_pair_issues": _MENTION_PAIRS + " SELECT * EXCLUDE (doc_id) FROM issues",
    "required_binding_missing": f"WITH {_sources('items')}, {_BOUND} SELECT instance_id, path, 'ERROR' AS severity, 'Required binding field ''' || field || ''' not found at ' || path AS message, {_WHERE} || '|binding: ' || enum_name AS context FROM bound WHERE value IS NULL AND obligation = 'REQUIRED'",
    "closure_descendants": _closure([(0, "REGION:0", False), (1, "REGION:1", True), (2, "Y:1", False), (3, "Y:2", True)]),
    "closure_ancestors": _closure([(0, "X:3", False), (1, "CUST:1", True), (2, "Y:1", False)], up=True),
    "closure_membership": "SELECT query_id, node AS value FROM (" + _closure([(0, "REGION:0", False), (1, "NATION:1", False), (1, "NATION:2", False), (2, "CUST:1", True)]) + ") WHERE node IN (SELECT 'CUST:' || o_custkey FROM orders)",
    "closure_multi_source": _closure([(0, "NATION:1", False), (0, "NATION:6", False), (0, "REGION:1", False)]),
    "closure_multi_predicate": _closure([(0, "BRAND:Brand#1", False), (0, "PTYPE:SMALL", False)], (SUBCLASS, PART_OF)),
    "enum_union": f"WITH {_sources('edges')} SELECT value FROM {_below('REGION:3')} UNION SELECT value FROM {_below('NATION:1')} UNION SELECT value FROM {_listed('A:1', 'NATION:1', 'OWN', 'A:2')}",
    "enum_matches": f"WITH {_sources('terms')} SELECT DISTINCT curie AS value FROM terms WHERE regexp_full_match(curie, 'NATION:1[0-9]')",
    "prefix_routing": f"""WITH {_sources('items', 'terms')}, p AS (SELECT split_part(part_id, ':', 1) AS prefix FROM items WHERE part_id IS NOT NULL UNION SELECT prefix FROM terms)
SELECT prefix, CASE WHEN prefix IN (SELECT prefix FROM {_CONFIGURED}) THEN 'memory:' END AS mapped, 'sqlite:obo:' || lower(prefix) AS default_adapter FROM p""",
    "config_booleans": "SELECT * FROM (VALUES ('yes, in YAML', true), ('false, in YAML', false), (' True ', true), ('FALSE', false), ('1', NULL), ('on', NULL), ('none', NULL)) AS v(written, value)",
    "label_cache_upsert": """SELECT 'CUST:' || c_custkey AS curie, c_name || CASE WHEN c_custkey % 10 = 1 THEN chr(10) || '"new"' ELSE '' END AS label,
       CASE WHEN c_custkey % 10 IN (1, 4) THEN '2025-02-02' ELSE '2025-01-01' END AS retrieved_at FROM customer WHERE c_custkey % 7 = 0""",
    "label_cache_files": f"WITH {_sources('terms')} SELECT curie, label, '2025-01-01' AS retrieved_at FROM terms WHERE prefix IN ('NATION', 'REGION')",
    "enum_cache_append": "SELECT 'NATION:' || n_nationkey AS value, n_nationkey % 10 = 3 AS complete FROM nation WHERE n_nationkey % 10 IN (1, 2, 3)",
    "obo_terms": f"WITH {_sources('terms')} SELECT * FROM terms WHERE prefix IN ('NATION', 'REGION')",
    "obo_edges": f"WITH {_sources('edges')} SELECT * FROM edges WHERE subject LIKE 'NATION:%' AND object LIKE 'REGION:%'",
    "snapshot_terms": f"WITH {_sources('terms')} SELECT * FROM terms WHERE prefix = 'NATION'",
    "json_records": f"WITH {_sources('items')} SELECT 'ORDER:' || l_orderkey AS order_id, part_id AS part FROM items JOIN orders ON l_orderkey = o_orderkey WHERE part_id IS NOT NULL",
    "text_file_mentions": "SELECT 'NATION:' || n_nationkey AS curie, n_name AS label FROM nation",
    "static_enum_violations": "SELECT 'ORDER:' || o_orderkey AS instance_id, 'ERROR' AS severity, 'Value ''' || o_orderstatus || ''' not in enum ''StatusListEnum''' AS message, 'slot: state|enum: StatusListEnum' AS context FROM orders WHERE o_orderstatus <> 'O'",
    "direct_enum_progressive": "SELECT 'ORDER:' || o_orderkey AS instance_id, 'ERROR' AS severity, 'Value ''' || o_orderpriority || ''' not in dynamic enum ''PriorityEnum'' (expanded from ontology)' AS message, 'slot: priority|enum: PriorityEnum' AS context FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')",
    "binding_enum_progressive": f"""WITH RECURSIVE {_sources('items', 'edges', 'terms')}, {_BOUND}, {_members(('PartEnum', 'PTYPE:SMALL'), ('PartEnum', 'PTYPE:LARGE'), ('PartEnum', 'PTYPE:PROMO'), ('SupplierEnum', 'REGION:0'), ('SupplierEnum', 'REGION:1'), ('SupplierEnum', 'REGION:2'))},
members AS (SELECT enum_name, node AS value FROM reach WHERE node IN (SELECT curie FROM terms WHERE label <> '') UNION SELECT 'StatusEnum', unnest(['O', 'F']))
SELECT instance_id, path, 'ERROR' AS severity, 'Value ''' || value || ''' not in ' || CASE enum_name WHEN 'StatusEnum' THEN 'enum ''StatusEnum''' ELSE 'dynamic enum ''' || enum_name || ''' (expanded from ontology)' END AS message,
       {_WHERE} || '|field: ' || field || CASE enum_name WHEN 'StatusEnum' THEN '|allowed_values: 2 terms' ELSE '' END AS context
FROM bound b WHERE value IS NOT NULL AND NOT EXISTS (SELECT 1 FROM members m WHERE m.enum_name = b.enum_name AND m.value = b.value)""",
    "enum_include": f"WITH {_sources('edges')} SELECT value FROM {_listed('A:1', 'A:2', 'P_ONE', 'A:3')} UNION SELECT value FROM {_below('REGION:1')}",
    "enum_minus": f"WITH {_sources('edges')} (SELECT value FROM {_below('REGION:2')} UNION SELECT 'REGION:2') EXCEPT SELECT value FROM {_below('NATION:2')} EXCEPT SELECT 'NATION:7'",
    "enum_inherits": f"WITH {_sources('edges')} {_HEIR}",
    "enum_expand_full": f"WITH {_sources('edges')} ((SELECT value FROM {_below('NATION:3')} UNION SELECT value FROM {_listed('A:5', 'A:6', 'NATION:4')} UNION SELECT value FROM {_below('NATION:4')}) EXCEPT SELECT value FROM {_listed('A:6', 'NATION:0')}) UNION {_HEIR} UNION SELECT value FROM {_listed('OWN', 'A:6')}",
    "enum_progressive": f"WITH {_sources('edges', 'cache', 'terms')} SELECT DISTINCT curie AS value FROM cache WHERE curie IN (SELECT curie FROM terms WHERE label IS NOT NULL) AND curie IN ({_BASE})",
    "schema_counters": f"WITH {_sources('values')} SELECT count(DISTINCT enum_name) AS enums_checked, count(*) AS values_checked, count(meaning) AS meanings_checked FROM pvs",
    "issue_counts": _MEANINGS + " SELECT count(*) FILTER (WHERE severity = 'ERROR') AS error_count, count(*) FILTER (WHERE severity = 'WARNING') AS warning_count, count(*) FILTER (WHERE severity = 'ERROR') > 0 AS has_errors, count(*) FILTER (WHERE severity = 'WARNING') > 0 AS has_warnings FROM issues",
    "issues_per_file": _MENTION_PAIRS + " SELECT d.doc_id::VARCHAR AS file, count(i.doc_id) AS n_issues, count(i.doc_id) > 0 AS failed FROM documents d LEFT JOIN issues i ON d.doc_id = i.doc_id GROUP BY d.doc_id",
    "cache_dedup_latest": f"WITH {_sources('cache')}, {_LATEST} SELECT * FROM latest",
    "cache_last_wins": f"WITH {_sources('cache')} SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY file, curie ORDER BY row_no DESC) AS n FROM cache) WHERE n = 1",
    "sorted_snapshot": f"WITH {_sources('cache')}, {_LATEST} SELECT file, row_number() OVER (PARTITION BY file ORDER BY curie)::INTEGER AS place, curie, label FROM latest",
    "cache_needs_rewrite": _RELABELLED + """, o AS (SELECT *, lag(curie) OVER (PARTITION BY file ORDER BY row_no) AS prior FROM cache),
s AS (SELECT file, count(*) AS n_rows, bool_or(coalesce(curie < prior, false)) AS unsorted, count(*) - count(DISTINCT curie) AS n_duplicates FROM o GROUP BY file),
r AS (SELECT file, count(*) FILTER (WHERE changed) AS n_relabelled FROM relabelled GROUP BY file)
SELECT *, unsorted OR n_duplicates > 0 OR n_relabelled > 0 AS needs_rewrite FROM s JOIN r USING (file)""",
    "cache_relabel": _RELABELLED + " SELECT * FROM relabelled",
}
