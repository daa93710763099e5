"""Scan settings from YAML files, the nearest to the target winning; and additions to the known inputs."""

from __future__ import annotations

import os
from dataclasses import dataclass, replace

NAME = ".siftstone.yml"


class ConfigError(Exception):
    """A setting that cannot be used; the message names the file and the key."""


@dataclass(frozen=True)
class Config:
    ignore: tuple[str, ...] = ()
    knowledge: tuple[dict, ...] = ()
    min_severity: str = "low"
    min_confidence: int = 0
    fail_on: str = "high"
    show_suppressed: bool = False
    link: bool = True
    rules: str | None = None


def discovered(target: str) -> list[str]:
    """Settings files from the root of the file system down to the target."""
    at = os.path.abspath(target if os.path.isdir(target) else os.path.dirname(target) or ".")
    found = []
    while True:
        if os.path.isfile(os.path.join(at, NAME)):
            found.append(os.path.join(at, NAME))
        if at == os.path.dirname(at):
            return found[::-1]
        at = os.path.dirname(at)


def merged(base: Config, data: dict, where: str) -> Config:
    kinds = {"ignore": list, "knowledge": list, "min_severity": str, "min_confidence": int, "fail_on": str, "show_suppressed": bool, "link": bool, "rules": str}
    out = base
    for key, value in (data or {}).items():
        if key not in kinds:
            raise ConfigError(f"{where}: unknown key {key}")
        if not isinstance(value, kinds[key]) or kinds[key] is int and isinstance(value, bool):
            raise ConfigError(f"{where}: {key} must be a {kinds[key].__name__}")
        if key in ("min_severity", "fail_on") and value not in ("low", "medium", "high", "critical"):
            raise ConfigError(f"{where}: {key} must be a severity")
        if key == "min_confidence" and not 0 <= value <= 100:
            raise ConfigError(f"{where}: {key} must be from 0 to 100")
        if key in ("ignore", "knowledge"):
            value = (*getattr(base, key), *value)
        if key == "rules":
            value = os.path.normpath(os.path.join(os.path.dirname(where), value))
        out = replace(out, **{key: value})
    return out


def load(target: str) -> Config:
    import yaml

    out = Config()
    for path in discovered(target):
        try:
            with open(path, encoding="utf-8") as f:
                data = yaml.safe_load(f)
        except (OSError, yaml.YAMLError) as e:
            raise ConfigError(f"{path}: {e}") from e
        if data is not None and not isinstance(data, dict):
            raise ConfigError(f"{path}: not a mapping")
        out = merged(out, data, path)
    return out


def user_rules(folder: str) -> list[type]:
    """Rule classes of the .py files of a folder. Loading runs them: only for folders that the user names."""
    import importlib.util

    from siftstone.analyze.rules import Rule

    out = []
    for name in sorted(x for x in os.listdir(folder) if x.endswith(".py")):
        spec = importlib.util.spec_from_file_location(f"user_rules_{name[:-3]}", os.path.join(folder, name))
        module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
        out += [x for x in vars(module).values() if isinstance(x, type) and issubclass(x, Rule) and x is not Rule and x.__module__ == module.__name__]
    return out
