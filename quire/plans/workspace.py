"""A workspace's folders and its configuration file."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from pathlib import Path


@dataclass(frozen=True)
class Workspace:
    root: Path

    @property
    def config(self) -> Path:
        return self.root / "quire.toml"

    def directories(self) -> list[Path]:
        return [self.root / name for name in ("inbox", "blocks", "sections", "files", "annotations", "plans", "index", "pages", "pages/concepts", "runs")]

    def create(self) -> Workspace:
        """Makes the folders, and the configuration where there is none."""
        for folder in self.directories():
            folder.mkdir(parents=True, exist_ok=True)
        if not self.config.exists():
            self.config.write_text(DEFAULT)
        return self


DEFAULT = """[segmenter]
default = "heading"
target_level = 2
max_tokens = 800

[search]
limit = 10

[plans]
daily_sections = 1
"""


class ConfigError(ValueError):
    """A value of the wrong kind."""


@dataclass(frozen=True)
class Config:
    segmenter: str = "heading"
    target_level: int = 2
    max_tokens: int = 800
    limit: int = 10
    daily_sections: int = 1
    rest: dict = field(default_factory=dict)


def load_config(workspace: Workspace) -> Config:
    """The configuration, with defaults for what it leaves out."""
    found = tomllib.loads(workspace.config.read_text()) if workspace.config.exists() else {}

    def value(section: str, key: str, kind: type, default: object) -> object:
        got = found.get(section, {}).get(key, default)
        if not isinstance(got, kind) or isinstance(got, bool) or (kind is int and got < 1):
            raise ConfigError(f"{section}.{key} must be a {'positive whole number' if kind is int else 'string'}")
        return got

    return Config(
        value("segmenter", "default", str, "heading"), value("segmenter", "target_level", int, 2), value("segmenter", "max_tokens", int, 800), value("search", "limit", int, 10), value("plans", "daily_sections", int, 1), found
    )
