"""Settings: frozen dataclasses, YAML loading, environment look-ups."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields, replace
from pathlib import Path
from typing import Any

from turnlake.functions.text import CONTEXT_TAG

PROVIDERS = ("openai", "anthropic")


@dataclass(frozen=True)
class ToolConfig:
    name: str
    provider: str
    api_key: str
    base_url: str


@dataclass(frozen=True)
class InjectionConfig:
    # --- fixed values -------------------------------------------------------
    max_tokens: int = 1800
    min_relevance_score: float = 0.3
    recency_boost: float = 0.3
    max_turns: int = 8
    # ------------------------------------------------------------------------


@dataclass(frozen=True)
class Config:
    wallet_dir: str = "~/.turnlake"
    tools: tuple[ToolConfig, ...] = ()
    injection: InjectionConfig = field(default_factory=InjectionConfig)
    incognito: bool = False
    index_buckets: int = 16  # of the inverted index; thousands suit a large store
    # Name of the block this engine injects; set it to the tag existing
    # captures carry when moving an older wallet over.
    context_tag: str = CONTEXT_TAG


def expand_home(path: str) -> str:
    return os.path.expanduser(path) if path == "~" or path.startswith("~/") else path


def tilde_path(path: str) -> str:
    home = os.path.expanduser("~")
    return "~" + path[len(home) :] if path.startswith(home) else path


def resolve_key(value: str, unset: str = "keep") -> str:
    """Value of ``env:NAME``; an unset name is kept, raises or becomes empty."""
    if not value.startswith("env:"):
        return value
    found = os.environ.get(value[4:])
    if found is not None:
        return found
    if unset == "raise":
        raise KeyError(f"environment variable {value[4:]!r} is not set")
    return "" if unset == "empty" else value


def _camel(name: str) -> str:
    head, *tail = name.split("_")
    return head + "".join(part.title() for part in tail)


def _fits(value: Any, default: Any) -> bool:
    if isinstance(default, bool):
        return isinstance(value, bool)
    if isinstance(default, (int, float)):
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    return isinstance(value, type(default))


def _overlay(default, raw: Any):
    """Replace the scalar fields of a dataclass by well-typed YAML values."""
    if not isinstance(raw, dict):
        return default
    found = {}
    for item in fields(default):
        value = raw.get(_camel(item.name))
        if isinstance(getattr(default, item.name), (str, int, float, bool)) and _fits(
            value, getattr(default, item.name)
        ):
            found[item.name] = value
    return replace(default, **found)


def _tools(raw: Any) -> tuple[ToolConfig, ...]:
    usable = [t for t in raw if isinstance(t, dict) and t.get("provider") in PROVIDERS] if isinstance(raw, list) else []

    def word(tool: dict, key: str) -> str:
        return tool[key] if isinstance(tool.get(key), str) else ""

    return tuple(
        ToolConfig(word(t, "name"), t["provider"], resolve_key(word(t, "apiKey")), word(t, "baseUrl")) for t in usable
    )


def from_mapping(raw: Any, defaults: Config = Config()) -> Config:
    if not isinstance(raw, dict):
        return defaults
    merged = _overlay(defaults, raw)
    return replace(
        merged,
        wallet_dir=expand_home(merged.wallet_dir),
        tools=_tools(raw.get("tools")),
        injection=_overlay(defaults.injection, raw.get("injection")),
    )


def load_config(wallet_dir: str | None = None) -> Config:
    """Read ``config.yaml``; defaults when it is missing, ValueError when malformed."""
    directory = expand_home(wallet_dir or Config.wallet_dir)
    path = Path(directory, "config.yaml")
    if not path.exists():
        return replace(Config(), wallet_dir=directory)
    import yaml

    try:
        raw = yaml.safe_load(path.read_text("utf-8"))
    except yaml.YAMLError as error:
        raise ValueError(f"malformed {path}: {error}") from error
    return from_mapping(raw)


def set_incognito(wallet_dir: str, enabled: bool) -> None:
    """Rewrite one key of ``config.yaml``, keeping the others."""
    import yaml

    path = Path(expand_home(wallet_dir), "config.yaml")
    try:
        current = yaml.safe_load(path.read_text("utf-8"))
    except (OSError, yaml.YAMLError):
        current = None
    settings = current if isinstance(current, dict) else {}
    settings["incognito"] = enabled
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(yaml.safe_dump(settings, sort_keys=False), "utf-8")
