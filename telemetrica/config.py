"""Configuration: strict YAML, deep merge over defaults, and the dataclasses built from it."""

from __future__ import annotations

from dataclasses import fields, is_dataclass
from typing import Any

#: Keys whose entries are free, so that overrides may add to them.
OPEN = {"by_signal", "by_prefix", "per_node_capacity_bps", "cause_priority", "explicit", "default_capacity_bps_by_type"}


def load_yaml(text: str) -> dict:
    """A YAML mapping; repeated keys are an error."""
    import yaml

    class Strict(yaml.SafeLoader):
        pass

    def mapping(loader, node):
        out = {}
        for key_node, value_node in node.value:
            key = loader.construct_object(key_node, deep=True)
            if key in out:
                raise ValueError(f"repeated key: {key}")
            out[key] = loader.construct_object(value_node, deep=True)
        return out

    Strict.add_constructor(yaml.resolver.BaseResolver.DEFAULT_MAPPING_TAG, mapping)
    return yaml.load(text, Loader=Strict) or {}


def merged(defaults: dict, changes: dict, path: str = "") -> dict:
    """``defaults`` with ``changes`` laid over; keys that the defaults lack are errors outside open maps."""
    out = dict(defaults)
    for key, value in changes.items():
        here = f"{path}.{key}" if path else key
        if key not in defaults and key not in OPEN and not OPEN.intersection(path.split(".")):
            raise KeyError(f"unknown key: {here}")
        out[key] = merged(defaults.get(key) or {}, value, here) if isinstance(value, dict) and isinstance(defaults.get(key, {}), dict) else value
    return out


def built(kind: type, values: dict[str, Any]):
    """A configuration dataclass from a mapping; nested mappings build nested dataclasses."""
    known = {f.name: f for f in fields(kind)}
    if unknown := sorted(set(values) - set(known)):
        raise KeyError(f"unknown keys: {unknown}")
    made = {}
    for name, value in values.items():
        default = known[name].default_factory() if callable(known[name].default_factory) else known[name].default
        if is_dataclass(default) and isinstance(value, dict):
            value = built(type(default), value)
        elif isinstance(default, tuple) and isinstance(value, list):
            value = tuple(value)
        made[name] = value
    return kind(**made)


def flattened(config: dict, prefix: str = "") -> list[str]:
    """``key.path = value`` lines in order."""
    out = []
    for key in sorted(config):
        here = f"{prefix}.{key}" if prefix else str(key)
        out += flattened(config[key], here) if isinstance(config[key], dict) and config[key] else [f"{here} = {config[key]!r}"]
    return out
