import json
import os
import random
import re
import sqlite3
import subprocess
import sys

import pytest
import yaml
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from termweave.cli import main
from termweave.functions import text as tx
from termweave.operators import closure, mentions, migrate, paths
from termweave.operators.enums import EnumCompiler, EnumCycle, fingerprint, inheritance_order
from termweave.plans import validate
from termweave.plans.workload import Workload
from termweave.sources import ontology
from termweave.sources.config import Options
from termweave.sources.data import of_objects, read_data
from termweave.sources.schema import EnumSpec, Schema
from termweave.sources.snapshot import EnumCache, LabelCache
from termweave.sources.storage import Files

OBO = """format-version: 1.2

[Term]
id: TEST:0000001
name: top word

[Term]
id: TEST:0000002
name: first word
is_a: TEST:0000001 ! top word

[Term]
id: TEST:0000003
name: second word
is_a: TEST:0000001 ! top word

[Term]
id: TEST:0000004
name: lower word
is_a: TEST:0000002 ! first word
relationship: part_of TEST:0000003 ! second word

[Term]
id: TEST:0000005
name: made_thing

[Term]
id: TEST:0000006
name: round_tool
is_a: TEST:0000005 ! made_thing

[Typedef]
id: part_of
name: part of
"""

SCHEMA = {
    "classes": {
        "Sample": {"attributes": {"id": {"identifier": True}, "process_type": {"range": "ProcessTypeEnum"}, "term": {"range": "RootDescendantsEnum", "multivalued": True}}},
        "Document": {"tree_root": True, "attributes": {"title": {}, "sections": {"range": "Section", "multivalued": True}}},
        "Section": {"attributes": {"heading": {}, "annotations": {"range": "Annotation", "multivalued": True}}},
        "Annotation": {"attributes": {"text": {}, "term": {"range": "Term", "bindings": [{"binds_value_of": "id", "range": "TestEnum", "obligation_level": "REQUIRED"}]}}},
        "Term": {"slots": ["id", "label"]},
        "Named": {"is_a": "Term", "attributes": {"name": {"implements": ["rdfs:label"]}}},
    },
    "slots": {"id": {}, "label": {}},
    "enums": {
        "ProcessTypeEnum": {"reachable_from": {"source_nodes": ["TEST:0000005"]}},
        "RootDescendantsEnum": {"reachable_from": {"source_nodes": ["TEST:0000001"]}},
        "TestEnum": {"reachable_from": {"source_nodes": ["TEST:0000001"], "include_self": True}},
        "MeaningEnum": {"permissible_values": {"CELL": {"title": "round tool", "meaning": "TEST:0000006"}, "ROOT": {"description": "Top-Word", "meaning": "TEST:0000001"}, "GONE": {"title": "gone", "meaning": "TEST:9999999"}, "FAR": {"meaning": "NOPE:1"}, "ODD": {"title": "odd", "annotations": {"label": "lower word"}, "meaning": "TEST:0000004"}}},
    },
}


@pytest.fixture
def files(tmp_path, monkeypatch):
    (tmp_path / "test.obo").write_text(OBO)
    (tmp_path / "adapters.yaml").write_text(yaml.safe_dump({"ontology_adapters": {"TEST": f"simpleobo:{tmp_path}/test.obo", "OFF": ""}}))
    (tmp_path / "schema.yaml").write_text(yaml.safe_dump(SCHEMA, sort_keys=False))
    monkeypatch.chdir(tmp_path)
    return tmp_path


@pytest.fixture
def service(spark, files):
    return validate.Service(spark, Options(config_path="adapters.yaml", strict=True))


def pairs(df):
    return sorted(tuple(r) for r in df.collect())


def test_normalisation_agrees_for_all_letters(spark):
    points = [i for i in range(1, 0x3000) if not 0xD800 <= i < 0xE000]
    df = spark.createDataFrame([(i, f"a{chr(i)}c") for i in points], "i int, s string")
    got = {r.i: r.n for r in df.select("i", tx.normalized(F.col("s")).alias("n")).collect()}
    differ = [i for i in points if got[i] != tx.normalize(f"a{chr(i)}c")]
    assert len(differ) < 0.03 * len(points)  # marks and letters of other Unicode versions
    assert tx.normalize("Round_tool  (x)!") == "round_tool x"


def test_prefixes_and_lines(spark):
    values = ["GO:1", "a:b:c", ":x", "", "plain", None]
    df = spark.createDataFrame([(v,) for v in values], "c string")
    assert [r.p for r in df.select(tx.prefix_of(F.col("c")).alias("p")).collect()] == [tx.get_prefix(v) for v in values] == ["GO", "a", None, None, None, None]
    texts = ["a\nb\n", "", "\n", "a\r\nb\x0bc d\x85e\x1cf", "x\n\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r.l for r in df.orderBy("i").select(tx.lines_of(F.col("t")).alias("l")).collect()] == [t.splitlines() for t in texts]


def test_obo_and_sqlite(spark, files):
    terms, edges = ontology.read_obo(spark, "test.obo")
    assert ("TEST", "TEST:0000006", "round_tool") in pairs(terms) and terms.count() == 6
    assert ("TEST:0000004", "BFO:0000050", "TEST:0000003") in pairs(edges) and edges.count() == 5
    con = sqlite3.connect("x.db")
    con.execute("CREATE TABLE rdfs_label_statement (subject TEXT, value TEXT)")
    con.execute("CREATE TABLE edge (subject TEXT, predicate TEXT, object TEXT)")
    con.executemany("INSERT INTO rdfs_label_statement VALUES (?, ?)", [tuple(r)[1:] for r in terms.collect()])
    con.executemany("INSERT INTO edge VALUES (?, ?, ?)", [tuple(r) for r in edges.collect()])
    con.commit()
    again, links = ontology.read_sqlite(spark, os.path.abspath("x.db"))
    assert pairs(again) == pairs(terms) and pairs(links) == pairs(edges)
    with pytest.raises(ontology.AdapterError):
        ontology.open_adapter(spark, "ols:")


def test_adapter_routing(files):
    assert Options().adapter_for("GO") == "sqlite:obo:go" and Options(adapter="ols:").adapter_for("GO") is None
    o = Options(config_path="adapters.yaml")
    assert o.adapter_for("TEST") and o.adapter_for("OFF") is None and o.adapter_for("GO") is None and not o.is_configured("OFF")
    (files / "bad.yaml").write_text("saturate_enum_caches: 3")
    with pytest.raises(ValueError, match="neither true nor false"):
        Options(config_path="bad.yaml")
    (files / "greedy.yaml").write_text("cache_strategy: greedy")
    assert Options(config_path="greedy.yaml").mode == "greedy" and Options(config_path="missing.yaml").adapters is None
    # Without a mapping, or with an empty one, the default adapter answers.
    (files / "empty.yaml").write_text("cache_strategy: greedy\nontology_adapters: {}\n")
    assert Options(config_path="greedy.yaml").adapter_for("GO") == Options(config_path="empty.yaml").adapter_for("GO") == "sqlite:obo:go"


def test_routes(spark, files):
    asked = spark.createDataFrame([("GO",), ("TEST",), ("OFF",), (None,)], "prefix string")
    for options in (Options(), Options(config_path="adapters.yaml"), Options(adapter="ols:")):
        assert {(r.prefix, r.adapter) for r in options.routes(asked).collect()} == {(p, options.adapter_for(p)) for p in ("GO", "TEST", "OFF", None)}


@pytest.mark.parametrize("as_array", [True, False])
def test_json_has_one_type_at_any_size(spark, files, as_array):
    """A list here and a text there: the same types whether the records are read from an array or from lines, or on the driver."""
    objects = [{"id": "a", "t": ["T:1"], "n": 1, "o": {"x": 1.5}}, {"id": "b", "t": "T:2", "n": "two", "o": {"y": [{"z": True}]}}, {"id": "c", "t": None}]
    path = "data.json" if as_array else "data.jsonl"
    (files / path).write_text(json.dumps([*objects, 7]) if as_array else "\n".join(json.dumps(o) for o in objects))
    got, plain = read_data(spark, path), of_objects(spark, objects)
    assert sorted(map(str, got.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))
    assert {r.id: r.t for r in got.collect()} == {"a": ["T:1"], "b": ["T:2"], "c": None}
    (files / "none.json").write_text("[]")
    assert read_data(spark, "none.json").count() == 0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.sets(st.tuples(st.integers(0, 7), st.integers(0, 7)), max_size=14), st.booleans())
def test_closure_is_a_search(spark, links, up):
    edges = spark.createDataFrame([(f"N:{a}", "p", f"N:{b}") for a, b in links], "subject string, predicate string, object string")
    roots = [(0, "N:0", False), (0, "N:1", False), (1, "N:2", True)]
    expected = set()
    for q, root, own in roots:
        seen, todo = set(), [root]
        while todo:
            x = todo.pop()
            for a, b in links:
                here, there = (a, b) if up else (b, a)
                if f"N:{here}" == x and f"N:{there}" not in seen:
                    seen.add(f"N:{there}")
                    todo.append(f"N:{there}")
        seen.discard(root)
        expected |= {(q, n) for n in seen | ({root} if own else set())}
    table = spark.createDataFrame(roots, "query_id int, node string, include_self boolean")
    assert set(pairs(closure.closure(edges, table, ["p"], up))) == expected
    values = spark.createDataFrame([(f"N:{i}",) for i in range(8)], "value string")
    assert set(pairs(closure.members(edges, values, table, ["p"], up))) == expected


def test_enum_algebra_and_modes(spark, service):
    enums = {k: EnumSpec.named(k, v) for k, v in {
        "Base": {"reachable_from": {"source_nodes": ["TEST:0000001"]}},
        "Heir": {"concepts": ["A:1"], "inherits": ["Base"], "minus": [{"concepts": ["A:1", "TEST:0000002"]}], "permissible_values": {"OWN": {"meaning": "A:2"}}},
        "Inc": {"include": [{"concepts": ["B:1"]}, {"permissible_values": {"P": {"meaning": "B:2"}}}]},
        "Pat": {"matches": {"identifier_pattern": "TEST:000000[12]"}},
        "C1": {"inherits": ["C2"]}, "C2": {"inherits": ["C1"]},
    }.items()}
    c = EnumCompiler(service.catalog, enums)
    below = ["TEST:0000002", "TEST:0000003", "TEST:0000004"]
    assert pairs(c.expand("Heir")) == sorted((v,) for v in [*below, "OWN", "A:2"])
    assert pairs(c.expand("Inc")) == [("B:1",), ("B:2",), ("P",)] and pairs(c.expand("Pat")) == []
    assert pairs(EnumCompiler(service.catalog, enums, match_patterns=True).expand("Pat")) == [("TEST:0000001",), ("TEST:0000002",)]
    asked = spark.createDataFrame([(v,) for v in ["A:1", "A:2", "B:1", "TEST:0000004", "TEST:0000001", "TEST:77", None]], "value string")
    assert pairs(c.accepted("Heir", asked)) == [("A:1",), ("A:2",), ("TEST:0000004",)]
    assert pairs(c.accepted("Inc", asked)) == []
    with pytest.raises(EnumCycle):
        inheritance_order(enums, ["C1"])
    prints = {fingerprint(EnumSpec.named("E", d)) for d in [{}, {"concepts": ["a"]}, {"minus": [{"concepts": ["a"]}]}, {"include": [{"concepts": ["a"]}]}, {"inherits": ["a"]}, {"reachable_from": {"source_nodes": ["a"]}}, {"reachable_from": {"source_nodes": ["a"], "include_self": True}}, {"reachable_from": {"source_nodes": ["a"], "traverse_up": True}}, {"matches": {"identifier_pattern": "a"}}, {"permissible_values": {"a": {}}}]}
    assert len(prints) == 10
    assert fingerprint(EnumSpec.named("E", {"concepts": ["a", "b"]})) == fingerprint(EnumSpec.named("F", {"concepts": ["b", "a"]}))


def test_schema_resolution(files):
    s = Schema.load("schema.yaml")
    assert list(s.slots_of("Named")) == ["id", "label", "name"] and s.label_slots("Named") == ["name"] and s.label_slots("Term") == ["label"]
    assert s.root() == "Document" and ("Annotation", "term") in s.bound_slots() and s.range_class_by_slot("term") == "Term"
    assert not EnumSpec.named("x", {"minus": [{"concepts": ["a"]}]}).dynamic
    (files / "child.yaml").write_text(yaml.safe_dump({"imports": ["schema", "nowhere:types"], "classes": {"Annotation": {"is_a": "Term", "slot_usage": {"label": {"slot_uri": "rdfs:label"}}}}}))
    t = Schema.load("child.yaml")
    assert t.label_slots("Annotation") == ["label"] and "Document" in t.classes


DOCUMENT = {"title": "t", "sections": [
    {"heading": "a", "annotations": [{"text": "x", "term": {"id": "TEST:0000002", "label": "FIRST word!"}}, {"text": "y", "term": {"id": "TEST:ZZZ", "label": "?"}}]},
    {"heading": "b", "annotations": [{"text": "z", "term": {"id": "TEST:0000005", "label": "wrong"}}, None, {"text": "w", "term": {"label": "no id"}}]},
]}


def test_nested_bindings(spark, service):
    df, schema = of_objects(spark, [DOCUMENT]), Schema.of(SCHEMA)
    rows = {(r.path, r.value) for r in paths.bound_values(df, schema, "Document").collect()}
    assert rows == {("sections[0].annotations[0].term", "TEST:0000002"), ("sections[0].annotations[1].term", "TEST:ZZZ"), ("sections[1].annotations[0].term", "TEST:0000005"), ("sections[1].annotations[2].term", None)}
    issues = validate.validate_data(df, schema, service, [validate.BindingCheck()])
    got = sorted((r.type, r.severity, r.path) for r in issues.collect())
    assert got == [
        ("binding_label_mismatch", "WARN", "sections[1].annotations[0].term"),
        ("binding_validation", "ERROR", "sections[0].annotations[1].term"),
        ("binding_validation", "ERROR", "sections[1].annotations[0].term"),
        ("binding_validation", "ERROR", "sections[1].annotations[2].term"),
        ("term_not_found", "ERROR", "sections[0].annotations[1].term"),
    ]
    assert not validate.validate_data(df, schema, service, [validate.BindingCheck(strict=False)]).where("type = 'term_not_found'").count()


def test_direct_enums(spark, service):
    schema = Schema.of(SCHEMA)
    good = of_objects(spark, [{"id": "s1", "process_type": "TEST:0000006", "term": ["TEST:0000002"]}, {"id": "s3", "term": ["TEST:0000004", None]}])
    bad = of_objects(spark, [{"id": "s1", "process_type": "TEST:0000001"}, {"id": "s2", "process_type": "TEST:0000002"}, {"id": "s3", "term": ["INVALID:1"]}])
    for service.options.cache_strategy in ("progressive", "greedy"):
        assert validate.validate_data(good, schema, service, [validate.DynamicEnumCheck()], "Sample").count() == 0
        assert validate.validate_data(bad, schema, service, [validate.DynamicEnumCheck()], "Sample").count() == 3


def test_label_cache_keeps_times(spark, files):
    cache = LabelCache(spark, "cache")
    rows = lambda *r: spark.createDataFrame(list(r), "curie string, label string")
    cache.save("TEST", rows(("TEST:2", 'two, "2"'), ("TEST:1", "one")), now="2025-01-01")
    cache.save("TEST", rows(("TEST:2", 'two, "2"'), ("TEST:1", "uno"), ("TEST:3", None)), now="2025-02-02")
    assert (files / "cache/test/terms.csv").read_text() == 'curie,label,retrieved_at\nTEST:1,uno,2025-02-02\nTEST:2,"two, ""2""",2025-01-01\n'
    (files / "cache/test/terms.csv").write_text("curie,label\nTEST:1,a\nTEST:1,b\n")
    assert pairs(cache.load(["TEST"])) == [("TEST:1", "b", "")]
    assert pairs(LabelCache(spark, "cache", enabled=False).load(["TEST"])) == []


def test_labels_with_line_breaks_and_quotes_come_back(spark, files):
    cache, odd = LabelCache(spark, "cache"), [("TEST:1", 'one\n"two", three'), ("TEST:2", " é\r\nx"), ("TEST:3", "plain")]
    cache.save("TEST", spark.createDataFrame(odd, "curie string, label string"), now="t")
    assert sorted((r.curie, r.label.replace("\r\n", "\n")) for r in cache.load(["TEST"]).collect()) == sorted((c, x.replace("\r\n", "\n")) for c, x in odd)


def test_a_failed_write_leaves_the_cache_as_it_was(spark, files, monkeypatch):
    cache = LabelCache(spark, "cache")
    cache.save("TEST", spark.createDataFrame([("TEST:1", "one")], "curie string, label string"), now="t")
    before = (files / "cache/test/terms.csv").read_text()

    def broken(rows):
        yield b"curie"
        raise RuntimeError("lost")

    monkeypatch.setattr("termweave.sources.snapshot._csv", broken)
    with pytest.raises(RuntimeError):
        cache.save("TEST", spark.createDataFrame([("TEST:2", "two")], "curie string, label string"))
    assert (files / "cache/test/terms.csv").read_text() == before and sorted(os.listdir("cache/test")) == ["terms.csv", "terms.csv.lock"]


def test_caches_on_another_file_system(spark, files, monkeypatch):
    """The same through the file system of a path's scheme, as on shared storage."""
    monkeypatch.setattr(Files, "local", lambda self, path: None)
    cache, folder = LabelCache(spark, f"file://{files}/far"), files / "far/test"
    rows = lambda *r: spark.createDataFrame(list(r), "curie string, label string")
    cache.save("TEST", rows(("TEST:2", "two")), now="a")
    cache.save("TEST", rows(("TEST:1", "one"), ("TEST:2", "zwei")), now="b")
    assert pairs(cache.load(["TEST"])) == [("TEST:1", "one", "b"), ("TEST:2", "zwei", "b")]
    assert [n for n in os.listdir(folder) if not n.endswith(".crc")] == ["terms.csv"] and len(list(cache.migrate(dry_run=True))) == 1
    (folder / "terms.csv.lock").write_text("")
    with pytest.raises(TimeoutError, match="terms.csv.lock"):
        LabelCache(spark, f"file://{files}/far", lock_seconds=0.1).save("TEST", rows(("TEST:3", "three")))


SAVER = """
import sys
from pyspark.sql import SparkSession
from termweave.sources.snapshot import LabelCache

spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").config("spark.driver.memory", "512m").getOrCreate()
LabelCache(spark, sys.argv[1], lock_seconds=170).save("GO", spark.createDataFrame([(sys.argv[2], "label-" + sys.argv[2])], "curie string, label string"))
"""


def test_six_processes_lose_no_label(files):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    curies = [f"GO:{i}" for i in range(1, 7)]
    running = [subprocess.Popen([sys.executable, "-c", SAVER, str(files / "cache"), c], cwd=root, stderr=subprocess.DEVNULL) for c in curies]
    assert [p.wait(timeout=180) for p in running] == [0] * 6
    lines = (files / "cache/go/terms.csv").read_text().splitlines()
    assert [x.split(",")[:2] for x in lines[1:]] == [[c, f"label-{c}"] for c in curies]


def test_order_is_judged_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(migrate, "BLOCK", 3)
    rng = random.Random(3)
    files_ = {str(k): [f"T:{i:03d}" for i in range(40)] for k in range(6)}
    for k, at in (("1", 2), ("2", 3), ("3", 38)):  # within a block, at a border, at the end
        files_[k][at], files_[k][at - 1] = files_[k][at - 1], files_[k][at]
    rng.shuffle(files_["4"])
    files_["5"][7] = files_["5"][6]
    df = spark.createDataFrame([(k, 10 * n, c, "x", "t") for k, cs in files_.items() for n, c in enumerate(cs)], "file string, row_no long, curie string, label string, retrieved_at string")
    assert {(r.file, r.unsorted, r.n_duplicates) for r in migrate.plan(df).collect()} == {(k, cs != sorted(cs), len(cs) - len(set(cs))) for k, cs in files_.items()}
    places = {(r.file, r.place): r.curie for r in migrate.placed(df).collect()}
    assert places == {(k, n): c for k, cs in files_.items() for n, c in enumerate(sorted(cs), 1)}


def test_host_configuration(spark, files, capsys):
    (files / "bad.json").write_text('{"id": "s1", "process_type": "TEST:0000001"}')
    (files / "other.yaml").write_text(yaml.safe_dump({"ontology_adapters": {"NONE": ""}}))
    plugin = {"oak_config_path": "adapters.yaml", "cache_labels": False, "cache_dir": "elsewhere", "cache_strategy": "greedy"}
    host = {"schema": "schema.yaml", "target_class": "Sample", "data_sources": ["bad.json"], "plugins": {"JsonschemaValidationPlugin": {"closed": True}, "a.b.DynamicEnumPlugin": plugin, "BindingValidationPlugin": {"validate_labels": "false", "oak_config_path": "other.yaml"}}}
    (files / "host.yaml").write_text(yaml.safe_dump(host))
    assert main(["validate-data", "--plugins", "host.yaml"]) == 1
    assert "allowed_values: 1 terms" in capsys.readouterr().out and os.path.isdir("elsewhere/enums") and not os.path.exists("cache/enums")
    for wrong in ({"plugins": {"NoSuchPlugin": {}}}, {"plugins": {"DynamicEnumPlugin": {"no_such": 1}}}, {"no_such": 1}):
        (files / "host.yaml").write_text(yaml.safe_dump(host | wrong))
        assert main(["validate-data", "--plugins", "host.yaml"]) == 1
    assert capsys.readouterr().err.count("no_such") == 2


def test_records_are_read_once_whatever_the_bindings(spark):
    w = Workload(spark, "/root/testdata/sf0.001")
    plan = w.bound()._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Scan parquet[^\n]*o_orderkey", plan)) == 1 and len(re.findall(r"Scan parquet[^\n]*l_orderkey", plan)) == 1


def test_walks_end_at_roots(spark):
    """A value that has met a root of every query isn't followed further; one that is a root itself is."""
    edges = spark.createDataFrame([(f"N:{i}", "p", f"N:{i + 1}") for i in range(30)], "subject string, predicate string, object string")
    values = spark.createDataFrame([("N:0",), ("N:4",), ("N:5",), ("N:9",)], "value string")
    one = spark.createDataFrame([(0, "N:4", False), (0, "N:9", True)], "query_id int, node string, include_self boolean")
    assert set(pairs(closure.members(edges, values, one, ["p"]))) == {(0, "N:0"), (0, "N:4"), (0, "N:5"), (0, "N:9")}
    met = closure.reach(edges, spark.createDataFrame([(0, "N:0")], "query_id int, source string"), ["p"], True, one)
    assert set(r.node for r in met.collect()) == {"N:1", "N:2", "N:3", "N:4"}


def test_enum_cache(spark, files):
    cache, spec = EnumCache(spark, "cache"), EnumSpec.named("My Enum/1", {"concepts": ["a"]})
    values = lambda *v: spark.createDataFrame([(x,) for x in v], "value string")
    assert cache.load(spec) is None
    cache.save(spec, values("b"), complete=False)
    cache.save(spec, values("a"), complete=False)
    assert pairs(cache.load(spec)) == [("a",), ("b",)] and not cache.is_complete(spec)
    cache.save(spec, values("c"), complete=True)
    assert pairs(cache.load(spec)) == [("c",)] and cache.is_complete(spec)
    assert re.fullmatch(r"my_enum_1_[0-9a-f]{12}\.csv", os.path.basename(cache.path(spec)))


def test_migration(spark, files, capsys):
    (files / "cache/test").mkdir(parents=True)
    path = files / "cache/test/terms.csv"
    mixed = "curie,label,retrieved_at\nTEST:0000002,old,2025-01-01\nTEST:0000001,top word,2025-01-01\nTEST:0000002,first word,2025-06-01\n"
    path.write_text(mixed)
    assert main(["migrate-cache", "--dry-run"]) == 0 and path.read_text() == mixed
    assert "Would update" in capsys.readouterr().out
    assert main(["migrate-cache"]) == 0
    assert path.read_text() == "curie,label,retrieved_at\nTEST:0000001,top word,2025-01-01\nTEST:0000002,first word,2025-06-01\n"
    assert "1 dupes removed" in capsys.readouterr().out
    assert main(["migrate-cache"]) == 0 and "no changes needed" in capsys.readouterr().out
    path.write_text("curie,label,retrieved_at\nTEST:0000001,stale,2025-01-01\n")
    assert main(["migrate-cache", "--refresh-labels", "-c", "adapters.yaml"]) == 0
    assert "TEST:0000001: 'stale' -> 'top word'" in capsys.readouterr().out and ",top word," in path.read_text()
    assert main(["migrate-cache", "--cache-dir", "none"]) == 1


def test_schema_command(spark, files, capsys):
    assert main(["validate-schema", "schema.yaml", "-c", "adapters.yaml", "--no-cache"]) == 1
    out = capsys.readouterr()
    assert "MeaningEnum.CELL: Label mismatch for TEST:0000006" in out.out and "MeaningEnum.GONE: Could not retrieve label for TEST:9999999" in out.out
    assert "ROOT" not in out.out and "ODD" not in out.out and "  - NOPE" in out.out and "2 error(s)" in out.err
    assert main(["validate", "schema.yaml", "-c", "adapters.yaml", "--no-cache"]) == 1
    assert not os.path.exists("cache")


def test_plugin_meanings(spark, service):
    check = validate.MeaningCheck()
    check.prepare(service, Schema.of(SCHEMA))
    got = sorted((r.type, r.severity, r.context[1]) for r in check.issues().collect())
    assert got == [("permissible_value_label_mismatch", "WARN", "value: CELL"), ("permissible_value_label_mismatch", "WARN", "value: ODD"), ("permissible_value_meaning", "ERROR", "value: FAR"), ("permissible_value_meaning", "ERROR", "value: GONE")]


def test_data_command(spark, files, capsys):
    (files / "good.yaml").write_text(yaml.safe_dump([{"id": "s1", "process_type": "TEST:0000006"}]))
    (files / "bad.json").write_text('{"id": "s1", "process_type": "TEST:0000001"}')
    (files / "rows.tsv").write_text("id\tprocess_type\ns1\tTEST:0000006\n")
    base = ["validate-data", "-s", "schema.yaml", "-t", "Sample", "-c", "adapters.yaml"]
    assert main([*base, "good.yaml"]) == 0 and "✅ Validation passed" in capsys.readouterr().out
    assert main([*base, "good.yaml", "bad.json", "rows.tsv"]) == 1
    assert "Summary: 1/3 files failed, 1 total issue(s)" in capsys.readouterr().out
    assert main([*base, "--no-bindings", "--no-dynamic-enums", "good.yaml"]) == 1 and main([*base, "missing.yaml"]) == 1
    assert os.path.exists("cache/enums")
    (files / "plugins.yaml").write_text("plugins:\n  'some.package.DynamicEnumPlugin': {}\n")
    assert main([*base, "--plugins", "plugins.yaml", "bad.json"]) == 1
    assert read_data(spark, "rows.tsv").columns == ["id", "process_type"]


def test_text_command(spark, files, capsys):
    run = lambda body, *more: ((files / "t.md").write_text(body), main(["validate-text-file", "t.md", "-c", "adapters.yaml", *more]))[1]
    assert run('- @term TEST:0000001 "top word"\n', "-v") == 0 and '✅ line:1 TEST:0000001 "top word"' in capsys.readouterr().out
    assert run('x\n- @term TEST:0000001 "other"\n') == 1
    assert "line:2 TEST:0000001: Label mismatch for TEST:0000001: expected 'other', got 'top word'" in capsys.readouterr().out
    assert run('@term TEST:77 "x"') == 1 and run('@term NOPE:1 "x"') == 0 and run('@term NOPE:1 "x"', "--strict") == 1
    assert run("top word=TEST:0000001", "-r", r"([^=]+)=(TEST:\d+)", "--curie-group", "2", "--label-group", "1") == 0
    assert run("nothing") == 0 and run("x", "-r", "(") == 1 and run("x", "-r", "(a)") == 1
    with pytest.raises(mentions.PatternError):
        mentions.checked_pattern("(a)(b)", 1, 3)


def test_stream_of_pairs(spark, files, tmp_path):
    from termweave.streaming.checks import mention_issues, write_issues

    spark.createDataFrame([("a", "TEST:0000001", "top word"), ("b", "TEST:0000001", "bad")], "location string, curie string, label string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("location string, curie string, label string").parquet(str(tmp_path / "in"))
    terms, _ = ontology.read_obo(spark, "test.obo")
    prefixes = spark.createDataFrame([("TEST", "x", True)], "prefix string, adapter string, configured boolean")
    write_issues(mention_issues(stream, terms.select("curie", "label"), prefixes), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert [r.enum_name for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["b"]


def test_rates_of_a_stream(spark, tmp_path):
    from termweave.streaming.checks import issue_rates

    rows = [("2026-01-01 00:01:00", "ERROR"), ("2026-01-01 00:09:59", "ERROR"), ("2026-01-01 00:10:00", "ERROR"), ("2026-01-01 00:02:00", "WARN")]
    df = spark.createDataFrame(rows, "t string, severity string").withColumn("t", F.to_timestamp("t"))
    df.write.parquet(str(tmp_path / "in"))
    stream = issue_rates(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "t")
    stream.writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    got = {(r.window.start.minute, r.severity, r.n) for r in spark.table("rates").collect()}
    assert got == {(0, "ERROR", 2), (10, "ERROR", 1), (0, "WARN", 1)}
