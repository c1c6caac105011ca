"""Data files as tables of instances, by suffix."""

from __future__ import annotations

import json
import os

import pyarrow as pa
import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from termweave.sources.storage import located


def _merge(a: T.DataType, b: T.DataType) -> T.DataType:
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        kinds = {f.name: f.dataType for f in a.fields}
        for f in b.fields:
            kinds[f.name] = _merge(kinds[f.name], f.dataType) if f.name in kinds else f.dataType
        return T.StructType([T.StructField(k, v) for k, v in kinds.items()])
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(_merge(a.elementType, b.elementType))
    if isinstance(a, T.ArrayType) or isinstance(b, T.ArrayType):
        many, one = (a, b) if isinstance(a, T.ArrayType) else (b, a)
        return T.ArrayType(_merge(many.elementType, one))
    return T.StringType()


def _kind(value: object) -> T.DataType:
    if value is None:
        return T.NullType()
    if isinstance(value, dict):
        return T.StructType([T.StructField(str(k), _kind(v)) for k, v in value.items()])
    if isinstance(value, list):
        kind: T.DataType = T.NullType()
        for v in value:
            kind = _merge(kind, _kind(v))
        return T.ArrayType(kind)
    return {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType()}.get(type(value), T.StringType())


def _typed(kind: T.DataType) -> T.DataType:
    if isinstance(kind, T.NullType):
        return T.StringType()
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _typed(f.dataType)) for f in kind.fields])
    return T.ArrayType(_typed(kind.elementType)) if isinstance(kind, T.ArrayType) else kind


def _shaped(value: object, kind: T.DataType):
    if value is None:
        return None
    if isinstance(kind, T.StructType):
        return {f.name: _shaped(value.get(f.name) if isinstance(value, dict) else None, f.dataType) for f in kind.fields}
    if isinstance(kind, T.ArrayType):
        return [_shaped(v, kind.elementType) for v in (value if isinstance(value, list) else [value])]
    if isinstance(kind, T.StringType) and not isinstance(value, str):
        return json.dumps(value) if isinstance(value, (dict, list, bool)) else str(value)
    return value


def of_objects(spark: SparkSession, objects: list[dict]) -> DataFrame:
    """Instances in their own order; where types differ between them, text wins."""
    kind: T.DataType = T.StructType([])
    for o in objects:
        kind = _merge(kind, _kind(o))
    kind = _typed(kind)
    return spark.createDataFrame([_shaped(o, kind) for o in objects], kind)


def read_json(spark: SparkSession, path: str, lines: bool) -> DataFrame:
    """Records of JSON files, with the types that of_objects() gives them; Spark reads and parses the files.

    Lines are read in parallel and may be any number; a document (one object or an array) is one value and fails beyond the size that
    Spark has for one. Two passes: each task reports the one type of all its records, the driver merges these, and tasks shape the records to it.
    """
    raw = spark.read.format("json").option("singleVariantColumn", "v").option("multiLine", not lines).load(located(path))
    records = raw.select(F.to_json("v").alias("record"))

    def objects(batches):
        for batch in batches:
            found = (json.loads(r) for r in batch.column(0).to_pylist() if r is not None)
            yield [o for x in found for o in (x if isinstance(x, list) else [x]) if isinstance(o, dict)]

    def kinds(batches):
        kind: T.DataType = T.StructType([])
        for some in objects(batches):
            for o in some:
                kind = _merge(kind, _kind(o))
        yield pa.RecordBatch.from_arrays([pa.array([kind.json()])], names=["kind"])

    kind: T.DataType = T.StructType([])
    for r in records.mapInArrow(kinds, "kind string").collect():
        kind = _merge(kind, T.StructType.fromJson(json.loads(r["kind"])))
    kind = _typed(kind)
    if not kind.fields:
        return spark.createDataFrame([], kind)
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in kind.fields])

    def shaped(batches):
        for some in objects(batches):
            yield pa.RecordBatch.from_pylist([_shaped(o, kind) for o in some], schema=arrow)

    return records.mapInArrow(shaped, kind)


def read_data(spark: SparkSession, path: str) -> DataFrame:
    """YAML and JSON documents (one instance or a list), JSON lines, CSV and TSV (all text) and Parquet.

    A YAML document is one value, so the driver parses it; the others are read by Spark.
    """
    end = os.path.splitext(path)[1].lower()
    if end in (".csv", ".tsv"):
        return spark.read.option("header", True).option("sep", "\t" if end == ".tsv" else ",").csv(located(path))
    if end == ".parquet":
        return spark.read.parquet(located(path))
    if end in (".json", ".jsonl", ".ndjson"):
        return read_json(spark, path, end != ".json")
    found = [yaml.safe_load(r["value"]) for r in spark.read.text(located(path), wholetext=True).collect()]
    return of_objects(spark, [o for raw in found for o in (raw if isinstance(raw, list) else [raw]) if isinstance(o, dict)])


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text) of whole text files; doc_id is the file's path."""
    return spark.read.text(located(path), wholetext=True).select(F.input_file_name().alias("doc_id"), F.col("value").alias("text"))
