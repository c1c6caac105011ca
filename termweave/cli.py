"""Command line: validate-schema, validate-data, validate, migrate-cache, validate-text-file."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from termweave.functions.text import MENTION
from termweave.operators.mentions import PatternError, checked_pattern
from termweave.plans import validate
from termweave.plans.host import HostError, read_host
from termweave.sources.config import DEFAULT_ADAPTER, Options
from termweave.sources.data import read_data
from termweave.sources.ontology import OntologyCatalog
from termweave.sources.schema import Schema
from termweave.sources.snapshot import LabelCache
from termweave.sources.storage import kept


def say(text: str = "", err: bool = False) -> None:
    print(text, file=sys.stderr if err else sys.stdout)


def session() -> SparkSession:
    spark = SparkSession.getActiveSession()
    if spark is None:
        spark = SparkSession.builder.appName("termweave").config("spark.ui.showConsoleProgress", "false").getOrCreate()
        spark.sparkContext.setLogLevel("ERROR")
    return spark


def _ontology(p: argparse.ArgumentParser, cache: bool = True) -> None:
    p.add_argument("-a", "--adapter", default=DEFAULT_ADAPTER, help="default ontology adapter")
    p.add_argument("-c", "--config", help="YAML file with ontology_adapters")
    p.add_argument("--cache-dir", default="cache")
    if cache:
        p.add_argument("--no-cache", action="store_true")


def _flag(p: argparse.ArgumentParser, name: str, default: bool) -> None:
    p.add_argument(f"--{name}", action=argparse.BooleanOptionalAction, default=default)


def _data_flags(p: argparse.ArgumentParser) -> None:
    p.add_argument("-t", "--target-class")
    _flag(p, "lenient", False)
    _flag(p, "cache-enum-expansions", True)
    _flag(p, "saturate-enum-caches", False)
    p.add_argument("--cache-strategy", choices=["progressive", "greedy"], default="progressive")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="termweave", description=__doc__)
    commands = out.add_subparsers(dest="command", required=True)

    p = commands.add_parser("validate-schema", help="check the meanings in a schema's enumerations")
    p.add_argument("schema_path")
    p.add_argument("--strict", action="store_true")
    p.add_argument("-v", "--verbose", action="store_true")
    _ontology(p)

    p = commands.add_parser("validate-data", help="check data files against a schema")
    p.add_argument("data_paths", nargs="*")
    p.add_argument("-s", "--schema")
    for name, default in (("bindings", True), ("dynamic-enums", True), ("labels", True), ("static-enums", False)):
        _flag(p, name, default)
    p.add_argument("--plugins", help="YAML file with the checks to run and their options (plugins), and maybe schema, data_sources, target_class")
    _data_flags(p)
    _ontology(p)

    p = commands.add_parser("validate", help="check data if a schema is given, else a schema")
    p.add_argument("path")
    p.add_argument("-s", "--schema")
    p.add_argument("--strict", action="store_true")
    p.add_argument("-v", "--verbose", action="store_true")
    _data_flags(p)
    _ontology(p)

    p = commands.add_parser("migrate-cache", help="clean label snapshots")
    for name in ("dry-run", "refresh-labels", "sort-only"):
        p.add_argument(f"--{name}", action="store_true")
    _ontology(p, cache=False)

    p = commands.add_parser("validate-text-file", help="check identifiers and labels in a text")
    p.add_argument("file_path")
    p.add_argument("-r", "--regex", default=MENTION)
    p.add_argument("--curie-group", type=int, default=1)
    p.add_argument("--label-group", type=int, default=2)
    p.add_argument("--strict", action="store_true")
    p.add_argument("-v", "--verbose", action="store_true")
    _ontology(p)
    return out


def _options(a: argparse.Namespace, strict: bool = False) -> Options:
    given = {k: getattr(a, k) for k in ("cache_enum_expansions", "saturate_enum_caches", "cache_strategy") if hasattr(a, k)}
    options = Options(a.adapter, strict, config_path=a.config, cache_dir=a.cache_dir, **given)
    return options.without_cache() if getattr(a, "no_cache", False) else options


def _unknown(prefixes: list[str]) -> None:
    if prefixes:
        say("\n⚠️  Unknown prefixes encountered (validation skipped):")
        for p in prefixes:
            say(f"  - {p}")
        say("\nConsider adding these to the adapter configuration to enable validation.")


def _summary(path: str, result: validate.Result, counts: dict, verbose: bool) -> None:
    say(f"\nValidation Results for {path}")
    say("=" * 60)
    for title, key in (("Enums checked", "enums_checked"), ("Values checked", "values_checked"), ("Meanings validated", "meanings_checked")):
        say(f"{title}: {result.counters.get(key, 0)}")
    rows = result.issues.orderBy("enum_name", "value_name")
    for mark, level, n in (("❌ ERRORS", "ERROR", counts["error_count"]), ("⚠️  WARNINGS", "WARNING", counts["warning_count"])):
        if n:
            say(f"\n{mark} ({n}):")
            for r in rows.where(F.col("severity") == level).toLocalIterator():
                say(f"  {r.enum_name}.{r.value_name}: {r.message}")
                if level == "ERROR":
                    say(f"    Meaning: {r.meaning}")
                    if r.expected_label and r.actual_label:
                        say(f"    Expected: {r.expected_label}")
                        say(f"    Actual: {r.actual_label}")
    if not counts["has_errors"] and not counts["has_warnings"]:
        say("\n✅ No issues found!")


def validate_schema(a: argparse.Namespace) -> int:
    if not os.path.exists(a.schema_path):
        say(f"❌ File not found: {a.schema_path}", err=True)
        return 1
    result = validate.validate_schema(session(), a.schema_path, _options(a, a.strict))
    counts = result.counts()
    if a.verbose or counts["has_errors"] or counts["has_warnings"]:
        _summary(a.schema_path, result, counts, a.verbose)
    _unknown(result.unknown_prefixes)
    if counts["has_errors"]:
        say(f"\n❌ Validation failed: {counts['error_count']} error(s), {counts['warning_count']} warning(s)", err=True)
        return 1
    if counts["has_warnings"]:
        say(f"\n⚠️  Validation completed with {counts['warning_count']} warning(s)")
    elif not a.verbose:
        say("✅")
    return 0


def _jobs(a: argparse.Namespace) -> tuple[list[tuple[validate.Check, Options]], dict]:
    """The checks to run with their options, and what a host configuration says of schema, data and class."""
    options = _options(a, not a.lenient)
    if getattr(a, "plugins", None):
        host = read_host(a.plugins, options, not a.lenient)
        return host.jobs, {"schema": host.schema, "data_paths": host.data_sources, "target_class": host.target_class}
    jobs: list[tuple[validate.Check, Options]] = []
    if a.dynamic_enums:
        jobs.append((validate.DynamicEnumCheck(getattr(a, "static_enums", False)), options))
    if a.bindings:
        jobs.append((validate.BindingCheck(labels=a.labels, strict=not a.lenient), options))
    return jobs, {}


def validate_data(a: argparse.Namespace) -> int:
    try:
        jobs, host = _jobs(a)
    except (HostError, OSError) as wrong:
        say(f"❌ {wrong}", err=True)
        return 1
    schema_path, target = a.schema or host.get("schema"), a.target_class or host.get("target_class")
    data_paths = a.data_paths or host.get("data_paths") or []
    if not schema_path or not data_paths:
        say("❌ A schema and data files are needed, as arguments or in the configuration", err=True)
        return 1
    for path in [*data_paths, schema_path]:
        if not os.path.exists(path):
            say(f"❌ File not found: {path}", err=True)
            return 1
    if not jobs:
        say("⚠️  No validation enabled. Use --bindings or --dynamic-enums", err=True)
        return 1
    spark = session()
    schema, services = Schema.load(schema_path), []
    for check, options in jobs:
        service = next((s for s in services if s.options == options), None)
        if service is None:
            services.append(service := validate.Service(spark, options))
        check.prepare(service, schema)
    many, failed, total = len(data_paths) > 1, 0, 0
    for path in data_paths:
        issues = kept(validate.run_checks(read_data(spark, path), schema, [c for c, _ in jobs], target))
        name, n = os.path.basename(path), issues.count()
        if not n:
            if many:
                say(f"✅ {name}")
            continue
        failed, total = failed + 1, total + n
        say(f"\n❌ {name} - {n} issue(s):" if many else f"\n❌ Validation failed with {n} issue(s):\n")
        for r in issues.orderBy("path", "type", "message").toLocalIterator():
            say(f"  {'❌' if r.severity == 'ERROR' else '⚠️'} {r.severity}: {r.message}")
            for line in r.context:
                say(f"      {line}")
    if many:
        say()
        say(f"Summary: {failed}/{len(data_paths)} files failed, {total} total issue(s)" if failed else f"✅ All {len(data_paths)} files passed validation")
    elif not failed:
        say("✅ Validation passed")
    return int(failed > 0)


def validate_either(a: argparse.Namespace) -> int:
    if a.schema is None:
        a.schema_path = a.path
        return validate_schema(a)
    a.data_paths, a.bindings, a.dynamic_enums, a.labels = [a.path], True, True, True
    return validate_data(a)


def migrate_cache(a: argparse.Namespace) -> int:
    if not os.path.isdir(a.cache_dir):
        say(f"Cache directory not found: {a.cache_dir}", err=True)
        return 1
    spark, options = session(), _options(a)
    catalog = OntologyCatalog(spark, options)

    def fresh(rows):
        prefixes = sorted({r[0].split(":", 1)[0] for r in rows.selectExpr("substring_index(curie, ':', 1)").distinct().collect() if r[0]})
        return catalog.terms(prefixes)

    reports = []
    for r in LabelCache(spark, a.cache_dir).migrate(fresh if a.refresh_labels else None, a.sort_only, a.dry_run):
        reports.append(r)
        if r["changes"] is not None:
            for curie, old, new in r["changes"].orderBy("curie").toLocalIterator():
                say(f"  {curie}: '{old}' -> '{new}'")
        what = [f"{r['duplicates']} dupes removed"] * (r["duplicates"] > 0) + [f"{r['relabelled']} relabeled"] * (r["relabelled"] > 0) + ["sorted"] * r["unsorted"]
        say(f"  {'Would update' if a.dry_run else 'Updated'} {r['path']} ({', '.join(what)})" if r["rewrite"] else f"  {r['path']} - no changes needed")
    if not reports:
        say("No cache files found to migrate.")
        return 0
    say(f"\nMigration {'preview' if a.dry_run else 'complete'}:")
    say(f"  Files scanned: {len(reports)}")
    say(f"  Files {'needing update' if a.dry_run else 'updated'}: {sum(r['rewrite'] for r in reports)}")
    for title, key in (("Duplicates removed", "duplicates"), ("Labels updated", "relabelled")):
        if n := sum(r[key] for r in reports):
            say(f"  {title}: {n}")
    return 0


def validate_text_file(a: argparse.Namespace) -> int:
    if not os.path.exists(a.file_path):
        say(f"❌ File not found: {a.file_path}", err=True)
        return 1
    try:
        checked_pattern(a.regex, a.curie_group, a.label_group)
    except PatternError as wrong:
        say(f"❌ {wrong}", err=True)
        return 1
    pairs, result = validate.validate_text(session(), os.path.abspath(a.file_path), _options(a, a.strict), a.regex, a.curie_group, a.label_group)
    n, n_issues = pairs.count(), result.issues.count()
    if not n:
        say(f"⚠️  No matches found in {a.file_path} with pattern: {a.regex}")
        return 0
    line = lambda c: F.substring_index(c, ":", -1).cast("long")
    if a.verbose:
        good = pairs.join(result.issues.select(F.col("value_name").alias("curie")).distinct(), "curie", "left_anti")
        for r in good.orderBy(line("location")).toLocalIterator():
            say(f'  ✅ {r.location} {r.curie} "{r.label}"')
    for i in result.issues.orderBy(line("enum_name")).toLocalIterator():
        say(f"  ❌ {i.enum_name} {i.value_name}: {i.message}")
    _unknown(result.unknown_prefixes)
    if n_issues:
        say(f"\n❌ Validation failed: {n_issues} error(s) in {n} CURIE(s)", err=True)
        return 1
    say("\n" * bool(a.verbose) + f"✅ All {n} CURIE(s) validated successfully")
    return 0


COMMANDS = {"validate-schema": validate_schema, "validate-data": validate_data, "validate": validate_either, "migrate-cache": migrate_cache, "validate-text-file": validate_text_file}


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    return COMMANDS[a.command](a)


if __name__ == "__main__":
    sys.exit(main())
