"""Log providers from YAML files: a name, a schema and changes to the rule taxonomy."""

from __future__ import annotations

from dataclasses import dataclass, fields
from pathlib import Path

from tidelog.operators.rules import SECTIONS, TAXONOMY, merge_taxonomy
from tidelog.schema import LogSchema, register_schema
from tidelog.sources.readers import read_yaml


@dataclass(frozen=True)
class Provider:
    name: str
    schema: LogSchema
    taxonomy: dict


_providers: dict[str, Provider] = {}


def from_dict(name: str, spec: dict) -> Provider:
    """Sections of the taxonomy merge into the base; unknown keys of schema are an error."""
    own = spec.get("schema") or {}
    unknown = set(own) - {f.name for f in fields(LogSchema)}
    if unknown:
        raise ValueError(f"provider {name}: unknown schema fields {sorted(unknown)}")
    sections = {k: v for k, v in spec.items() if k in SECTIONS}
    return Provider(name, LogSchema(**own), merge_taxonomy(TAXONOMY, sections))


def register(provider: Provider) -> Provider:
    _providers[provider.name] = provider
    register_schema(provider.name, provider.schema)
    return provider


def discover(folder: str) -> list[str]:
    """Register each <name>.yaml of a folder, and each <name>/config.yaml below it."""
    found = []
    for path in sorted([*Path(folder).glob("*.yaml"), *Path(folder).glob("*/config.yaml")]):
        name = path.parent.name if path.name == "config.yaml" else path.stem
        found.append(register(from_dict(name, read_yaml(str(path)))).name)
    return found


def get(name: str) -> Provider:
    if name == "default" and name not in _providers:
        register(from_dict("default", {}))
    if name not in _providers:
        raise KeyError(f"no provider {name!r}; registered: {sorted(_providers)}")
    return _providers[name]


def available() -> list[str]:
    return sorted({"default", *_providers})
