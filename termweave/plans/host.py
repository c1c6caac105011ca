"""Configurations of a host framework: which checks to run over which data, each check with options of its own."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import yaml

from termweave.plans import validate
from termweave.sources.config import Options, as_bool


class HostError(ValueError):
    """A configuration that names something unknown."""


#: Names of checks, by the last part of a dotted name in lower case. Structural checks are the host's own.
CHECKS = {
    "bindingvalidationplugin": "bindings", "bindings": "bindings",
    "dynamicenumplugin": "dynamic_enums", "dynamic_enums": "dynamic_enums",
    "permissiblevaluemeaningplugin": "meanings", "meanings": "meanings",
    "jsonschemavalidationplugin": None,
}
#: Options of every check, and the settings that they are here.
SHARED = {"oak_adapter_string": "adapter", "oak_config_path": "config_path", "cache_dir": "cache_dir", "cache_strategy": "cache_strategy"}
SWITCHES = ("cache_labels", "cache_enum_expansions", "saturate_enum_caches")
#: Options of one check only, with what they are called there.
OWN = {
    "bindings": {"validate_labels": "labels", "strict": "strict"},
    "dynamic_enums": {"include_static": "include_static"},
    "meanings": {"strict_mode": "strict"},
}
MADE = {"bindings": validate.BindingCheck, "dynamic_enums": validate.DynamicEnumCheck, "meanings": validate.MeaningCheck}


@dataclass
class Host:
    schema: str | None = None
    target_class: str | None = None
    data_sources: list[str] = field(default_factory=list)
    jobs: list[tuple[validate.Check, Options]] = field(default_factory=list)


def _job(kind: str, name: str, raw: dict, options: Options, strict: bool) -> tuple[validate.Check, Options]:
    settings, own = {}, {"strict": strict} if kind != "dynamic_enums" else {}
    for key, value in raw.items():
        if key in SHARED:
            settings[SHARED[key]] = value
        elif key in SWITCHES:
            settings[key] = as_bool(value, key)
        elif key in OWN[kind]:
            own[OWN[kind][key]] = as_bool(value, key)
        else:
            raise HostError(f"{name} has no option {key!r}")
    # A mapping that the command's own configuration set doesn't outlive another configuration file.
    if "config_path" in settings:
        settings["adapters"] = None
    return MADE[kind](**own), replace(options, **settings)


def read_host(path: str, options: Options, strict: bool = True) -> Host:
    """Reads schema, target_class, data_sources and plugins (a mapping of names to options, or a list of names).

    options and strict hold where a check doesn't say otherwise. Names and options that aren't known are errors.
    """
    with open(path, encoding="utf-8") as f:
        raw = yaml.safe_load(f) or {}
    for key in raw:
        if key not in ("schema", "target_class", "data_sources", "plugins"):
            raise HostError(f"unknown key {key!r} in {path}")
    plugins = raw.get("plugins") or {}
    plugins = plugins if isinstance(plugins, dict) else {name: {} for name in plugins}
    sources = raw.get("data_sources") or []
    out = Host(raw.get("schema"), raw.get("target_class"), [sources] if isinstance(sources, str) else list(sources))
    for name, given in plugins.items():
        last = str(name).rsplit(".", 1)[-1].lower()
        if last not in CHECKS:
            raise HostError(f"unknown plugin {name!r} in {path}")
        if CHECKS[last]:
            out.jobs.append(_job(CHECKS[last], str(name), given or {}, options, strict))
    return out
