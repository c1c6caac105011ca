"""Scalar expressions over identifiers, labels and text, and the same rules for single values on the driver."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Annotation tags whose values count as names of a permissible value.
NAME_TAGS = ("label", "display_name", "preferred_name", "synonym")

#: Where a text file's lines end.
LINE_BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"

#: A mention of a term in text: identifier, then label in double quotes.
MENTION = r'@term (\S+) "([^"]*)"'


def prefix_of(curie: Column) -> Column:
    """What stands before the first colon; null if there is no colon or nothing before it."""
    return F.when(F.instr(curie, ":") > 1, F.substring_index(curie, ":", 1))


def get_prefix(curie: str | None) -> str | None:
    head, colon, _ = (curie or "").partition(":")
    return head if colon and head else None


def normalized(label: Column) -> Column:
    """Lower case, with everything but letters, digits and underscores as single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.lower(label), r"[^\p{L}\p{N}_]+", " "))


def normalize(label: str) -> str:
    return " ".join(re.sub(r"[^\w\s]", " ", label.lower()).split())


def names_of(value_name: Column, title: Column, description: Column, aliases: Column | None = None, annotations: Column | None = None) -> Column:
    """The distinct normalised names of a permissible value, sorted. Annotations count by tag (see NAME_TAGS)."""
    none = F.array().cast("array<string>")
    parts = [F.array(value_name, title, description)]
    if aliases is not None:
        parts.append(F.coalesce(aliases, none))
    if annotations is not None:
        parts.append(F.coalesce(F.map_values(F.map_filter(annotations, lambda tag, _: tag.isin(*NAME_TAGS))), none))
    given = F.filter(F.concat(*parts), lambda x: x.isNotNull() & (x != ""))
    return F.array_sort(F.array_distinct(F.transform(given, normalized)))


def lines_of(text: Column) -> Column:
    """The lines of a text, without a last empty one."""
    parts = F.split(text, LINE_BREAKS, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def field_of(record: Column, name: str) -> Column:
    """A record's own field; the name is never split at dots."""
    return record.getField(name)
