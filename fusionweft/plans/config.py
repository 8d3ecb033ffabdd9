"""Projection configurations: read and checked before any plan is made."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

POLICIES = ("null", "omit", "error")


class ConfigError(ValueError):
    """The configuration cannot be used."""


@dataclass(frozen=True)
class FieldSpec:
    source: str
    target: str
    required: bool = False
    filter: str | None = None
    transform: str | None = None
    missing_policy: str | None = None


@dataclass(frozen=True)
class ProjectionConfig:
    version: str = "1.0"
    output_schema_name: str = "default"
    provenance: bool = True
    confidence: bool = True
    missing_value_policy: str = "null"
    fields: tuple[FieldSpec, ...] = field(default=())

    @property
    def whole(self) -> bool:
        """Without fields the whole record is the output."""
        return not self.fields


def _policy(value: Any, where: str) -> str:
    value = "null" if value is None else value  # an unquoted null in YAML means the policy of that name
    if value not in POLICIES:
        raise ConfigError(f"{where}: missing-value policy must be one of {', '.join(POLICIES)}, not {value!r}")
    return value


def parse_config(raw: dict[str, Any]) -> ProjectionConfig:
    from ..operators.projection import TRANSFORMS

    if not isinstance(raw, dict):
        raise ConfigError("the configuration must be a mapping")
    specs = []
    for k, item in enumerate(raw.get("fields") or []):
        if not isinstance(item, dict) or not item.get("source"):
            raise ConfigError(f"field {k} must be a mapping with a source")
        transform = item.get("transform")
        if transform and transform.partition(":")[0] not in TRANSFORMS:
            raise ConfigError(f"field {item['source']}: unknown transform {transform!r}")
        own = item.get("missing_policy")
        specs.append(FieldSpec(item["source"], item.get("target") or item["source"], bool(item.get("required")), item.get("filter"), transform, _policy(own, item["source"]) if own else None))
    text = lambda key, default: str(raw.get(key, default))
    return ProjectionConfig(text("version", "1.0"), text("output_schema_name", "default"), bool(raw.get("provenance", True)), bool(raw.get("confidence", True)), _policy(raw.get("missing_value_policy", "null"), "configuration"), tuple(specs))


def load_config(path: str | Path) -> ProjectionConfig:
    import yaml

    try:
        raw = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    except OSError as e:
        raise ConfigError(f"no configuration at {path}") from e
    except yaml.YAMLError as e:
        raise ConfigError(f"{path} is no YAML: {e}") from e
    return parse_config(raw)
