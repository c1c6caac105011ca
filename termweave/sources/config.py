"""Which ontology answers for which prefix: adapter configuration and routing."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_ADAPTER = "sqlite:obo:"


#: What a configuration may write for a switch.
SWITCH = {True: True, False: False, "true": True, "false": False}


def as_bool(value: object, name: str) -> bool:
    known = value.strip().lower() if isinstance(value, str) else value
    if isinstance(known, (bool, str)) and known in SWITCH:
        return SWITCH[known]
    raise ValueError(f"setting {name} is neither true nor false: {value!r}")


@dataclass
class Options:
    """Settings of a validation; keys of the adapter file win over what was passed."""

    adapter: str = DEFAULT_ADAPTER
    strict: bool = False
    cache_labels: bool = True
    cache_enum_expansions: bool = True
    saturate_enum_caches: bool = False
    cache_strategy: str = "progressive"
    config_path: str | None = None
    cache_dir: str = "cache"
    adapters: dict[str, str] | None = field(default=None)

    def __post_init__(self) -> None:
        raw = read_config(self.config_path)
        if raw is not None:
            if mapping := raw.get("ontology_adapters"):
                self.adapters = {str(k): str(v or "") for k, v in mapping.items()}
            for name in ("cache_enum_expansions", "saturate_enum_caches"):
                if name in raw:
                    setattr(self, name, as_bool(raw[name], name))
            self.cache_strategy = raw.get("cache_strategy", self.cache_strategy)
        if self.cache_strategy not in ("progressive", "greedy"):
            raise ValueError(f"cache_strategy must be progressive or greedy, got: {self.cache_strategy!r}")

    @property
    def mode(self) -> str:
        """How membership of an enumeration is evaluated."""
        return "greedy" if self.cache_strategy == "greedy" or self.saturate_enum_caches else "progressive"

    def without_cache(self) -> "Options":
        self.cache_labels = self.cache_enum_expansions = self.saturate_enum_caches = False
        return self

    def is_configured(self, prefix: str | None) -> bool:
        return bool((self.adapters or {}).get(prefix or ""))

    def adapter_for(self, prefix: str | None) -> str | None:
        """With a mapping only its entries count (an empty one switches a prefix off). Without one, or if the configuration sets other
        things only, the default adapter takes the lower-cased prefix; any other adapter string answers for nothing."""
        if not prefix:
            return None
        if self.adapters is not None:
            return self.adapters.get(prefix) or None
        return DEFAULT_ADAPTER + prefix.lower() if self.adapter == DEFAULT_ADAPTER else None

    def prefixes(self, spark: SparkSession) -> DataFrame:
        """(prefix, adapter, configured), a row for each entry of the configuration."""
        rows = [(p, a, bool(a)) for p, a in sorted((self.adapters or {}).items())]
        return spark.createDataFrame(rows, "prefix string, adapter string, configured boolean")


    def routes(self, prefixes: DataFrame) -> DataFrame:
        """The rows of prefixes (prefix, ...) with the adapter that answers for each, or null."""
        if self.adapters is not None:
            known = self.prefixes(prefixes.sparkSession).where("configured").select("prefix", "adapter")
            return prefixes.join(F.broadcast(known), "prefix", "left")
        default = F.concat(F.lit(DEFAULT_ADAPTER), F.lower("prefix")) if self.adapter == DEFAULT_ADAPTER else F.lit(None).cast("string")
        return prefixes.withColumn("adapter", F.when(F.col("prefix") != "", default))


def read_config(path: str | None) -> dict | None:
    """The adapter file's content; None where there is no such file."""
    if not path or not os.path.exists(path):
        return None
    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}
