"""Configuration files: strict YAML with two sections."""

from __future__ import annotations

import math
from dataclasses import dataclass
from pathlib import Path

from inkmesh.functions.color import PALETTES

FILE = ".inkmesh.yaml"
MOST_BITS = 1024


class ConfigError(ValueError):
    """Names the file and the dotted key."""

    def __init__(self, path: object, key: str, what: str) -> None:
        super().__init__(f"{path}: {key}: {what}" if key else f"{path}: {what}")


@dataclass(frozen=True)
class Config:
    theme: str | None = None
    min_contrast: float | None = None
    groups_theme: str | None = None
    min_count: int | None = None
    limit: int | None = None


def _load(path: Path) -> object:
    import yaml

    class Loader(yaml.SafeLoader):
        pass

    def mapping(loader, node, deep=False):
        seen = set()
        for k, _ in node.value:
            key = loader.construct_object(k, deep=True)
            if not isinstance(key, str):
                raise ConfigError(path, str(key), "keys must be strings")
            if key in seen:
                raise ConfigError(path, key, "given twice")
            seen.add(key)
        return yaml.SafeLoader.construct_mapping(loader, node, deep)

    Loader.add_constructor("tag:yaml.org,2002:map", mapping)
    try:
        return yaml.load(path.read_text("utf-8"), Loader)  # noqa: S506 a safe loader
    except (yaml.YAMLError, UnicodeDecodeError) as e:
        raise ConfigError(path, "", f"cannot be read: {e}") from e


def _theme(v: object) -> str:
    if v not in PALETTES:
        raise ValueError(f"must be one of {', '.join(PALETTES)}")
    return v


def _contrast(v: object) -> float:
    if isinstance(v, bool) or not isinstance(v, (int, float)):
        raise ValueError("must be a number")
    try:
        v = float(v)
    except OverflowError:
        raise ValueError("is too large") from None
    if not math.isfinite(v) or v < 1:
        raise ValueError("must be finite and at least 1")
    return v


def _count(v: object) -> int:
    if isinstance(v, bool) or not isinstance(v, int) or v < 1 or v.bit_length() > MOST_BITS:
        raise ValueError("must be a whole number of at least 1")
    return v


_KEYS = {
    "graph": {"theme": ("theme", _theme), "min_contrast": ("min_contrast", _contrast)},
    "graph_groups": {"theme": ("groups_theme", _theme), "min_count": ("min_count", _count), "limit": ("limit", _count)},
}


def load_config(root: str | Path, explicit: str | Path | None = None) -> Config:
    """Config of a vault; a named file must exist and replaces the one found in the root."""
    path = Path(explicit).expanduser() if explicit else Path(root).expanduser() / FILE
    if not path.is_file():
        if explicit:
            raise ConfigError(path, "", "no such file")
        return Config()
    data = _load(path)
    data = {} if data is None else data
    if not isinstance(data, dict):
        raise ConfigError(path, "", "must be a mapping")
    out = {}
    for section, body in data.items():
        if section not in _KEYS:
            raise ConfigError(path, section, "unknown section")
        if not isinstance(body, dict):
            raise ConfigError(path, section, "must be a mapping")
        for key, value in body.items():
            if key not in _KEYS[section]:
                raise ConfigError(path, f"{section}.{key}", "unknown key")
            name, check = _KEYS[section][key]
            try:
                out[name] = check(value)
            except (TypeError, ValueError) as e:
                raise ConfigError(path, f"{section}.{key}", str(e)) from e
    return Config(**out)


def pick(flag: object, configured: object, default: object) -> object:
    """Flags before config, config before defaults."""
    return flag if flag is not None else configured if configured is not None else default
