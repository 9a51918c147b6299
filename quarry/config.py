"""Settings: defaults, a YAML file, environment, options; each overrides those before it."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields, replace
from pathlib import Path
from typing import Any

from quarry.errors import ConfigError
from quarry.rules import DANGEROUS_PATHS, DEFAULT_RULES, JS_FIND, URL_FIND, Rule, loaded, rules_from

try:
    import yaml
except ImportError:  # settings files need it; everything else does not
    yaml = None

PREFIX = "QUARRY_"


@dataclass(frozen=True)
class Settings:
    """All settings with their defaults."""

    verbose: bool = False
    debug: bool = False
    loglevel: str = "critical"
    handler_type: str = "regex"
    proxy: str = ""
    max_depth: int = 1
    max_page_num: int = 1000
    timeout: float = 5
    follow_redirects: bool = True
    max_connections: int = 100
    max_keepalive_connections: int = 50
    max_concurrent_per_domain: int = 5
    min_request_interval: float = 0.2
    headers: dict[str, str] = field(default_factory=lambda: {"Accept": "*/*", "Cookie": "", "User-Agent": "Mozilla/5.0 (Windows NT 10.0; Win64; x64)"})
    urlFind: list[str] = field(default_factory=lambda: list(URL_FIND))  # noqa: N815
    jsFind: list[str] = field(default_factory=lambda: list(JS_FIND))  # noqa: N815
    dangerousPath: list[str] = field(default_factory=lambda: list(DANGEROUS_PATHS))  # noqa: N815
    #: A file of public suffix rules, of any filesystem Spark reads; empty: common suffixes only.
    suffix_file: str = ""
    rules: list[Rule] = field(default_factory=lambda: loaded(DEFAULT_RULES))

    def __post_init__(self):
        if self.max_connections < 1 or self.max_keepalive_connections < 0:
            raise ConfigError("max_connections must be 1 or more, max_keepalive_connections 0 or more")

    @property
    def engine(self) -> str:
        """hyperscan stands for whole matches, found by one walk for all rules; everything else for groups."""
        return "scan" if self.handler_type == "hyperscan" else "groups"


def updated(settings: Settings, values: dict[str, Any]) -> Settings:
    """Settings with other values; unknown names are passed over, rules are read as in a settings file."""
    known = {f.name for f in fields(Settings)}
    new = {k: v for k, v in values.items() if k in known and v is not None}
    if "rules" in new and not all(isinstance(r, Rule) for r in new["rules"]):
        new["rules"] = rules_from(new["rules"])
    for name in ("urlFind", "jsFind", "dangerousPath"):
        if name in new and not isinstance(new[name], list):
            raise ConfigError(f"{name} is not a list")
    return replace(settings, **new)


def load_file(settings: Settings, path: str) -> Settings:
    """Settings with those of a YAML file."""
    if yaml is None:
        raise ConfigError("settings files need the yaml package")
    if not Path(path).is_file():
        raise ConfigError(f"no such settings file: {path}")
    values = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    if not isinstance(values, dict):
        raise ConfigError(f"not a settings file: {path}")
    return updated(settings, values)


def from_environment(settings: Settings, environment: dict[str, str] | None = None) -> Settings:
    """Settings with plain values from variables QUARRY_<NAME>."""
    values = {}
    for f in fields(Settings):
        text = (os.environ if environment is None else environment).get(PREFIX + f.name.upper())
        if text is not None and isinstance(getattr(settings, f.name), str | bool | int | float):
            old = getattr(settings, f.name)
            values[f.name] = text.lower() in ("1", "true", "yes") if isinstance(old, bool) else type(old)(text)
    return updated(settings, values)


def default_yaml() -> str:
    """A settings file with the defaults."""
    if yaml is None:
        raise ConfigError("settings files need the yaml package")
    s = Settings()
    values = {f.name: getattr(s, f.name) for f in fields(s) if f.name != "rules"}
    values["rules"] = [{"name": r.name, "regex": r.regex, "loaded": r.loaded} for r in DEFAULT_RULES]
    return yaml.safe_dump(values, allow_unicode=True, sort_keys=False)
