"""Nested records as flat tables: every bound or listed value with the path at which it stands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termweave.functions.text import field_of
from termweave.sources.schema import Schema, Slot

BOUND = (
    "instance_id string, instantiates string, path string, slot string, binding_no int, field string, value string, value_is_string boolean, "
    "enum_name string, obligation string, labels array<struct<field:string,label:string>>"
)
SLOT_VALUES = "instance_id string, instantiates string, slot string, enum_name string, value string"
BOUND_COLUMNS = [c.split()[0] for c in BOUND.split(", ")]


def _each(values: Column, kind: T.DataType, path: Column, rows) -> Column:
    """rows(value, its type, its path) of each value that isn't null, as one array; values of lists have their index in the path."""
    if isinstance(kind, T.ArrayType):
        inner = lambda x, i: _each(x, kind.elementType, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), rows)
        return F.coalesce(F.flatten(F.transform(values, inner)), _none())
    return F.when(values.isNotNull(), rows(values, kind, path)).otherwise(_none())


def _struct(schema: str, values: list[Column]) -> Column:
    names = [(c.split()[0], c.split(maxsplit=1)[1]) for c in schema.split(", ")]
    return F.struct(*(v.cast(kind).alias(name) for (name, kind), v in zip(names, values)))


_FOUND = "path string, slot string, binding_no int, field string, value string, value_is_string boolean, enum_name string, obligation string, labels array<struct<field:string,label:string>>"


def _none() -> Column:
    return F.array().cast("array<struct<" + ",".join(c.replace(" ", ":", 1) for c in _FOUND.split(", ")) + ">>")


def bound_values(df: DataFrame, schema: Schema, target_class: str, instance_id: Column | None = None, by_slot_name: bool = True) -> DataFrame:
    """The values of all bound fields (see BOUND) of records of target_class.

    The schema is compiled on the driver to one expression that collects the values of a record, whatever the number of
    bindings: the records are read once. Fields that the data doesn't have need none. The class of a nested object is
    the declared range of its slot. Label fields are those of the range of the first class that binds a slot of the
    name; by_slot_name=False takes the slot's own range instead. Fields missing from an object are null; so are those of
    values that are no objects.
    """
    bound = schema.bound_slots()

    def of_class(record: Column, kind: T.DataType, cls: str, above: Column | None) -> list[Column]:
        slots, out = schema.slots_of(cls), []
        for field in kind.fields if isinstance(kind, T.StructType) else []:
            slot = slots.get(field.name)
            if slot is None:
                continue
            bindings, nested = bound.get((cls, slot.name), ()), slot.range in schema.classes
            if not bindings and not nested:
                continue
            path = F.lit(slot.name) if above is None else F.concat(above, F.lit("." + slot.name))

            def of_value(value: Column, element: T.DataType, at: Column, slot=slot, bindings=bindings, nested=nested) -> Column:
                has = {f.name: f.dataType for f in element.fields} if isinstance(element, T.StructType) else {}
                label_class = schema.range_class_by_slot(slot.name) if by_slot_name else slot.range
                names = [s for s in schema.label_slots(label_class) if s in has]
                labels = F.array(*(F.struct(F.lit(s).alias("field"), field_of(value, s).cast("string").alias("label")) for s in names))
                rows = []
                for n, b in enumerate(bindings):
                    held = field_of(value, b.field).cast("string") if b.field in has else F.lit(None)
                    is_text = F.lit(isinstance(has.get(b.field), T.StringType))
                    rows.append(_struct(_FOUND, [at, F.lit(slot.name), F.lit(n), F.lit(b.field), held, is_text, F.lit(b.range), F.lit(b.obligation), labels]))
                parts = [F.array(*rows)] if rows else []
                return F.concat(*parts, *(of_class(value, element, slot.range, at) if nested else []), _none())

            out.append(_each(field_of(record, field.name), field.dataType, path, of_value))
        return out

    record = F.struct(*df.columns)
    found = of_class(F.col("_record"), df.select(record.alias("r")).schema["r"].dataType, target_class, None)
    if not found:
        return df.sparkSession.createDataFrame([], BOUND)
    key = instance_id if instance_id is not None else F.lit(None)
    rows = df.select(key.cast("string").alias("instance_id"), record.alias("_record"))
    return rows.select("instance_id", F.lit(target_class).alias("instantiates"), F.inline(F.concat(*found)))


def _named(slot: Slot):
    return lambda v: F.struct(F.lit(slot.name).alias("slot"), F.lit(slot.range).alias("enum_name"), v.alias("value"))


def slot_values(df: DataFrame, schema: Schema, target_class: str, dynamic: bool = True, instance_id: Column | None = None) -> DataFrame:
    """The values (as text) of top-level slots whose range is a dynamic enumeration, or a static one (see SLOT_VALUES)."""
    out = []
    for field in df.schema.fields:
        slot = schema.slots_of(target_class).get(field.name)
        spec = schema.enums.get(slot.range) if slot else None
        if spec is None or spec.dynamic != dynamic:
            continue
        values = F.col(f"`{field.name}`")
        values = F.transform(values, lambda v: v.cast("string")) if isinstance(field.dataType, T.ArrayType) else F.array(values.cast("string"))
        out.append(F.coalesce(F.transform(values, _named(slot)), F.array().cast("array<struct<slot:string,enum_name:string,value:string>>")))
    if not out:
        return df.sparkSession.createDataFrame([], SLOT_VALUES)
    key = instance_id if instance_id is not None else F.lit(None)
    rows = df.select(key.cast("string").alias("instance_id"), F.lit(target_class).alias("instantiates"), F.inline(F.concat(*out)))
    return rows.where("value is not null")
