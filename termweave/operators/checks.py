"""The checks: joins of values, enumerations and terms that yield issues of one form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.functions import severity
from termweave.functions.text import names_of, normalized, prefix_of
from termweave.operators import lookup
from termweave.sources.storage import lookup_side

ISSUE_COLUMNS = ["type", "severity", "message", "instance_id", "instantiates", "path", "context"]
ISSUES = "type string, severity string, message string, instance_id string, instantiates string, path string, context array<string>"


def _text(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("None")) for p in parts))


def _issue(rows: DataFrame, kind: str, level: Column | str, message: Column, context: list[Column], more: Column | None = None) -> DataFrame:
    level = F.lit(level) if isinstance(level, str) else level
    own = [F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in ("instance_id", "instantiates", "path")]
    told = F.array(*context) if more is None else F.concat(F.array(*context), more)
    return rows.select(F.lit(kind).alias("type"), level.alias("severity"), message.alias("message"), *own, told.alias("context"))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _where(*more: Column) -> list[Column]:
    return [_text("path: ", F.col("path")), _text("slot: ", F.col("slot")), *more]


def outside(values: DataFrame, members: DataFrame) -> DataFrame:
    """Rows of values (enum_name, value, ...) that aren't members."""
    return values.join(members.select("enum_name", "value"), ["enum_name", "value"], "left_anti")


def sizes(members: DataFrame) -> DataFrame:
    return members.groupBy("enum_name").agg(F.count("*").alias("n_allowed"))


def direct_enum_violations(values: DataFrame, members: DataFrame, counted: bool = False) -> DataFrame:
    """Values of top-level slots outside their dynamic enumeration. counted: the whole enumeration is known, so its size is told."""
    bad = outside(values, members)
    context = [_text("slot: ", F.col("slot")), _text("enum: ", F.col("enum_name"))]
    if counted:
        bad = bad.join(lookup_side(sizes(members)), "enum_name", "left")
        context.append(_text("allowed_values: ", F.coalesce("n_allowed", F.lit(0)), " terms"))
    return _issue(bad, "dynamic_enum_validation", "ERROR", _text("Value '", F.col("value"), "' not in dynamic enum '", F.col("enum_name"), "' (expanded from ontology)"), context)


def direct_static_violations(values: DataFrame, members: DataFrame) -> DataFrame:
    """The same for closed enumerations used as a range. Off by default: structural validators report these."""
    bad = outside(values, members)
    return _issue(bad, "static_enum_validation", "ERROR", _text("Value '", F.col("value"), "' not in enum '", F.col("enum_name"), "'"), [_text("slot: ", F.col("slot")), _text("enum: ", F.col("enum_name"))])


def required_missing(bound: DataFrame) -> DataFrame:
    """Bound fields without a value whose binding is REQUIRED; other levels are silent."""
    bad = bound.where("value is null and obligation = 'REQUIRED'")
    return _issue(bad, "binding_validation", "ERROR", _text("Required binding field '", F.col("field"), "' not found at ", F.col("path")), _where(_text("binding: ", F.col("enum_name"))))


def binding_enum_violations(bound: DataFrame, members: DataFrame, kinds: DataFrame, counted: bool = False) -> DataFrame:
    """Bound values outside their enumeration. kinds: (enum_name, dynamic) of the enumerations that are checked at all.

    A value that is no text is never a member.
    """
    asked = bound.where("value is not null").join(F.broadcast(kinds), "enum_name")  # a row for each enumeration of the schema
    allowed = members.select(F.col("enum_name").alias("of"), F.col("value").alias("allowed"))
    matched = asked.join(allowed, (F.col("enum_name") == F.col("of")) & F.col("value_is_string") & (F.col("value") == F.col("allowed")), "left_anti")
    bad = matched.join(lookup_side(sizes(members)), "enum_name", "left")
    size = F.array(_text("allowed_values: ", F.coalesce("n_allowed", F.lit(0)), " terms"))
    told = F.when(F.lit(counted) | ~F.col("dynamic"), size).otherwise(F.array().cast("array<string>"))
    which, end = F.when(F.col("dynamic"), "dynamic enum '").otherwise("enum '"), F.when(F.col("dynamic"), "' (expanded from ontology)").otherwise("'")
    message = _text("Value '", F.col("value"), "' not in ", which, F.col("enum_name"), end)
    return _issue(bad.withColumn("_told", told), "binding_validation", "ERROR", message, _where(_text("field: ", F.col("field"))), F.col("_told"))


def terms_not_found(bound: DataFrame, terms: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Bound values of configured prefixes that are no term."""
    bad = lookup.not_found(bound.where("value is not null and value_is_string").withColumn("curie", F.col("value")), terms, prefixes)
    told = _where(_text("field: ", F.col("field")), _text("prefix: ", F.col("prefix"), " (configured in oak_config)"))
    return _issue(bad, "term_not_found", "ERROR", _text("Term '", F.col("value"), "' not found in ontology"), told)


def label_mismatches(bound: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels next to a bound value that differ from the term's, one issue for each label field. labels: (curie, label)."""
    given = bound.where("value is not null and value_is_string").select("*", F.explode("labels").alias("l")).where("l.label is not null")
    known = labels.where("label is not null and label <> ''").select(F.col("curie").alias("value"), F.col("label").alias("own_label"))
    bad = given.join(known, "value").where(normalized(F.col("own_label")) != normalized(F.col("l.label")))
    message = _text("Label mismatch for '", F.col("value"), "': expected '", F.col("own_label"), "', got '", F.col("l.label"), "'")
    return _issue(bad, "binding_label_mismatch", "WARN", message, _where(_text("label_field: ", F.col("l.field")), _text("curie: ", F.col("value"))))


MEANING_ISSUES = "enum_name string, value_name string, severity string, message string, meaning string, expected_label string, actual_label string"


def _with_prefix(rows: DataFrame, curie: str, prefixes: DataFrame) -> DataFrame:
    """rows with prefix, and configured if it is; prefixes come from a configuration file, a row for each of its entries."""
    on = F.broadcast(prefixes.where("configured").select("prefix", "configured"))
    return rows.withColumn("prefix", prefix_of(F.col(curie))).join(on, "prefix", "left")


def _with_labels(values: DataFrame, labels: DataFrame, prefixes: DataFrame) -> DataFrame:
    known = labels.select(F.col("curie").alias("meaning"), F.col("label").alias("actual_label"))
    named = values.where("meaning is not null and meaning <> ''").join(known, "meaning", "left")
    return _with_prefix(named, "meaning", prefixes)


def schema_meaning_issues(values: DataFrame, labels: DataFrame, prefixes: DataFrame, strict: bool = False) -> DataFrame:
    """Meanings of permissible values without a label, or whose label is none of the value's names (annotations count)."""
    rows = _with_labels(values, labels, prefixes).withColumn("names", names_of(F.col("value_name"), F.col("title"), F.col("description"), F.col("aliases"), F.col("annotations")))
    missing = F.col("actual_label").isNull()
    configured = F.coalesce("configured", F.lit(False)) | F.lit(strict)
    bad = rows.where(missing | ~F.array_contains("names", normalized(F.col("actual_label"))))
    told = lambda text: _text(text, F.col("meaning"))
    message = F.when(missing & configured, told("Could not retrieve label for ")).when(missing, told("Unconfigured prefix, could not validate "))
    message = message.otherwise(told("Label mismatch for "))
    level = F.when(missing, severity.unresolved(F.col("configured"), strict)).otherwise(severity.mismatched(F.col("configured"), strict))
    expected = F.when(~missing, F.array_join("names", ", "))
    return bad.select("enum_name", "value_name", level.alias("severity"), message.alias("message"), "meaning", expected.alias("expected_label"), "actual_label")


def plugin_meaning_issues(values: DataFrame, labels: DataFrame, strict: bool = False) -> DataFrame:
    """The same check value by value: a missing term is always an error, labels are compared only where a title or description is given, annotations don't count."""
    named = values.where("meaning is not null and meaning <> ''").join(labels.select(F.col("curie").alias("meaning"), F.col("label").alias("actual_label")), "meaning", "left")
    filled = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    missing = F.col("actual_label").isNull()
    names = names_of(F.col("value_name"), F.col("title"), F.col("description"), F.col("aliases"))
    bad = named.where(missing | ((filled("title") | filled("description")) & ~F.array_contains(names, normalized(F.col("actual_label")))))
    given = F.array_compact(F.array(*(F.when(filled(c), F.col(c)) for c in ("title", "description"))))
    quoted = F.array_join(F.transform(given, lambda x: _text("'", x, "'")), ", ")
    differs = _text("Label mismatch for ", F.col("meaning"), ": expected one of [", quoted, "], but ontology has '", F.col("actual_label"), "'")
    message = F.when(missing, _text("Ontology term '", F.col("meaning"), "' not found")).otherwise(differs)
    kind = F.when(missing, "permissible_value_meaning").otherwise("permissible_value_label_mismatch")
    level = F.when(missing, "ERROR").otherwise(severity.plugin_mismatched(strict))
    where = F.array(_text("enum: ", F.col("enum_name")), _text("value: ", F.col("value_name")))
    none = F.lit(None).cast("string")
    own = [none.alias("instance_id"), F.col("enum_name").alias("instantiates"), none.alias("path")]
    return bad.select(kind.alias("type"), level.alias("severity"), message.alias("message"), *own, where.alias("context"))


def pair_issues(pairs: DataFrame, labels: DataFrame, prefixes: DataFrame, strict: bool = False) -> DataFrame:
    """Identifier and label pairs (location, curie, label): unresolved ones if the prefix is configured or strict, and every label that differs; once for each mention."""
    rows = _with_prefix(pairs.join(labels.select("curie", F.col("label").alias("actual_label")), "curie", "left"), "curie", prefixes)
    missing = F.col("actual_label").isNull()
    told = F.coalesce("configured", F.lit(False)) | F.lit(strict)
    bad = rows.where((missing & told) | (~missing & (normalized(F.col("actual_label")) != normalized(F.col("label")))))
    differs = _text("Label mismatch for ", F.col("curie"), ": expected '", F.col("label"), "', got '", F.col("actual_label"), "'")
    message = F.when(missing, _text("Unresolvable CURIE: ", F.col("curie"))).otherwise(differs)
    own = [F.col("location").alias("enum_name"), F.col("curie").alias("value_name"), F.lit("ERROR").alias("severity"), message.alias("message")]
    return bad.select(*own, F.col("curie").alias("meaning"), F.col("label").alias("expected_label"), "actual_label")


def schema_counters(values: DataFrame) -> DataFrame:
    """enums_checked, values_checked, meanings_checked over (enum_name, value_name, meaning)."""
    return values.agg(F.countDistinct("enum_name").alias("enums_checked"), F.count("value_name").alias("values_checked"), F.count(F.nullif("meaning", F.lit(""))).alias("meanings_checked"))


def issue_counts(issues: DataFrame) -> DataFrame:
    level = F.col("severity")
    errors, warnings = F.count_if(level == "ERROR"), F.count_if(level.isin("WARN", "WARNING"))
    return issues.agg(errors.alias("error_count"), warnings.alias("warning_count"), (errors > 0).alias("has_errors"), (warnings > 0).alias("has_warnings"))


def issues_per_file(files: DataFrame, issues: DataFrame) -> DataFrame:
    """(file, n_issues, failed) of every file, also of those without issues."""
    counts = issues.groupBy("file").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return files.select("file").distinct().join(counts, "file", "left").select("file", n.alias("n_issues"), (n > 0).alias("failed"))
