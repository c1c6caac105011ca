"""How severe a finding is, as expressions over whether the prefix is configured and whether strictness was asked for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _either(configured: Column, strict: Column | bool) -> Column:
    return F.coalesce(configured, F.lit(False)) | (F.lit(strict) if isinstance(strict, bool) else strict)


def unresolved(configured: Column, strict: Column | bool) -> Column:
    """A meaning without a label."""
    return F.when(_either(configured, strict), "ERROR").otherwise("INFO")


def mismatched(configured: Column, strict: Column | bool) -> Column:
    """A meaning whose label is none of the value's names."""
    return F.when(_either(configured, strict), "ERROR").otherwise("WARNING")


def plugin_mismatched(strict: Column | bool) -> Column:
    """The same in the checks that take a schema's values one by one."""
    return F.when(F.lit(strict) if isinstance(strict, bool) else strict, "ERROR").otherwise("WARN")
