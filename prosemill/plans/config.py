"""Rule selection, resolved on the driver and baked into the plan as literals."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from prosemill.resources.lists import FIXABLE, RULES

IDS = tuple(r[0] for r in RULES)
ORDER = {name: i for i, name in enumerate(IDS)}
EXPERIMENTAL = frozenset(r[0] for r in RULES if r[2])
DEFAULT_ON = frozenset(r[0] for r in RULES if r[1])
#: Name of the configuration file, of its table in pyproject.toml, and start of inline directives.
TOOL = "prosemill"


class ConfigError(ValueError):
    """A selection that cannot be used; never narrowed down silently."""


def default_severity(rule: str) -> str:
    return "warning" if rule in EXPERIMENTAL else "error"


@dataclass(frozen=True)
class Config:
    enabled: frozenset[str] = DEFAULT_ON
    severity: dict[str, str] = field(default_factory=dict)
    skip_zh_units: str = ""
    directive_prefix: str = TOOL

    def on(self, rule: str) -> bool:
        return rule in self.enabled

    def severity_of(self, rule: str) -> str:
        return self.severity.get(rule, default_severity(rule))

    @staticmethod
    def all_rules(**options) -> Config:
        return Config(enabled=frozenset(IDS), **options)


def _names(value, key: str) -> list[str]:
    if not isinstance(value, list) or any(not isinstance(v, str) for v in value):
        raise ConfigError(f"{key} must be a list of rule names")
    unknown = [v for v in value if v not in ORDER]
    if unknown:
        raise ConfigError(f"{key} names unknown rules: {', '.join(unknown)}")
    return value


def _select(enabled: frozenset[str], disable: list[str], enable: list[str]) -> frozenset[str]:
    both = sorted(set(disable) & set(enable), key=ORDER.get)
    if both:
        raise ConfigError(f"both enabled and disabled: {', '.join(both)}")
    return (enabled | frozenset(enable)) - frozenset(disable)


def from_table(table: dict, directive_prefix: str = TOOL) -> Config:
    disable, enable = _names(table.get("disable", []), "disable"), _names(table.get("enable", []), "enable")
    odd = [r for r in enable if r in EXPERIMENTAL]
    if odd:
        raise ConfigError(f"experimental rules come with enable_experimental, not enable: {', '.join(odd)}")
    experimental = table.get("enable_experimental", False)
    if not isinstance(experimental, bool):
        raise ConfigError("enable_experimental must be true or false")
    units = table.get("skip_zh_units", "")
    if not isinstance(units, str):
        raise ConfigError("skip_zh_units must be a string")
    if any(not "一" <= c <= "鿿" for c in units):
        raise ConfigError("skip_zh_units takes CJK characters only")
    severity = table.get("severity", {})
    if not isinstance(severity, dict):
        raise ConfigError("severity must be a table")
    for rule, level in severity.items():
        if rule not in ORDER:
            raise ConfigError(f"severity names an unknown rule: {rule}")
        if level not in ("error", "warning"):
            raise ConfigError(f"severity of {rule} must be error or warning")
    enabled = _select(DEFAULT_ON | (EXPERIMENTAL if experimental else frozenset()), disable, enable)
    return Config(enabled, dict(severity), units, directive_prefix)


def _read(path: Path) -> dict:
    try:
        return tomllib.loads(path.read_text("utf-8"))
    except (tomllib.TOMLDecodeError, UnicodeDecodeError) as e:
        raise ConfigError(f"{path}: {e}") from e


def find_table(start: str | os.PathLike, tool: str = TOOL) -> dict:
    """The nearest configuration upward from ``start``, no further than the repository's root."""
    at = Path(start).resolve()
    for folder in (at, *at.parents):
        if (own := folder / f"{tool}.toml").is_file():
            return _read(own)
        if (shared := folder / "pyproject.toml").is_file():
            found = _read(shared).get("tool", {}).get(tool)
            if found is not None:
                if not isinstance(found, dict):
                    raise ConfigError(f"{shared}: tool.{tool} must be a table")
                return found
        if (folder / ".git").exists():
            break
    return {}


def resolve(start: str | os.PathLike = ".", disable: list[str] | None = None, enable: list[str] | None = None, directive_prefix: str = TOOL, tool: str = TOOL) -> Config:
    """Overrides, even empty ones, replace the file as a whole."""
    if disable is None and enable is None:
        return from_table(find_table(start, tool), directive_prefix)
    return Config(_select(DEFAULT_ON, _names(disable or [], "disable"), _names(enable or [], "enable")), directive_prefix=directive_prefix)


def rules_table(spark, config: Config | None = None):
    """The rule dimension: one row a rule."""
    config = config or Config()
    rows = [(ORDER[r], r, r in DEFAULT_ON, default_severity(r), "experimental" if r in EXPERIMENTAL else "stable", r in FIXABLE, config.on(r), config.severity_of(r)) for r in IDS]
    return spark.createDataFrame(rows, "rule_ord int, rule string, default_enabled boolean, default_severity string, maturity string, fixable boolean, enabled boolean, severity string")
