"""Settings with their defaults; unknown ones are errors, relative folders are relative to the file."""

from __future__ import annotations

import os
from dataclasses import MISSING, dataclass, field, fields, is_dataclass
from typing import Any, get_type_hints

# How hard a model is told to think.
EFFORTS = ("low", "medium", "high")


def _positive(obj: Any, *names: str) -> None:
    for n in names:
        v = getattr(obj, n)
        if isinstance(v, bool) or not isinstance(v, int) or v <= 0:
            raise ValueError(f"{n} must be a whole number above 0, not {v!r}")


@dataclass(frozen=True)
class ModelSettings:
    provider: str
    name: str
    effort: str = "medium"
    temperature: float | None = None

    def __post_init__(self) -> None:
        if self.effort not in EFFORTS:
            raise ValueError(f"effort must be one of {EFFORTS}")


@dataclass(frozen=True)
class OracleSettings:
    provider: str
    model: str
    effort: str = "high"

    def __post_init__(self) -> None:
        if self.effort not in EFFORTS:
            raise ValueError(f"effort must be one of {EFFORTS}")


@dataclass(frozen=True)
class ArtifactTools:
    root: str
    schema: str


@dataclass(frozen=True)
class SearchTools:
    index_path: str
    type: str = "bm25"


@dataclass(frozen=True)
class FsTools:
    root: str | None = None
    roots: dict[str, str] | None = None
    write_enabled: bool = False

    def __post_init__(self) -> None:
        if (self.root is None) == (not self.roots):
            raise ValueError("fs needs either root or roots")


@dataclass(frozen=True)
class Tools:
    artifacts: ArtifactTools | None = None
    search: SearchTools | None = None
    fs: FsTools | None = None
    custom: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class SessionSettings:
    store_path: str = "sessions"
    auto_save: bool = True


@dataclass(frozen=True)
class EvalSettings:
    cases: str = "eval/cases.yaml"
    checks: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class Settings:
    max_iterations: int = 25
    context_budget_tokens: int = 100_000
    max_tool_result_chars: int = 4_000
    nudge_interval: int = 3
    max_consecutive_errors: int = 3
    max_session_notes: int = 20
    history_keep_recent: int = 3
    compaction_thresholds: tuple[float, float, float] = (0.80, 0.90, 0.95)
    parallel_reads: bool = True
    timeout_seconds: int = 120
    tool_limits: dict[str, int] = field(default_factory=dict)
    library: str = "library"
    model: ModelSettings | None = None
    oracle: OracleSettings | None = None
    tools: Tools = field(default_factory=Tools)
    sessions: SessionSettings = field(default_factory=SessionSettings)
    eval: EvalSettings = field(default_factory=EvalSettings)

    def __post_init__(self) -> None:
        a, b, c = self.compaction_thresholds
        if not 0 < a < b < c < 1:
            raise ValueError("compaction_thresholds must rise within (0, 1)")
        _positive(self, "max_iterations", "context_budget_tokens", "max_tool_result_chars", "nudge_interval", "max_consecutive_errors", "max_session_notes", "history_keep_recent", "timeout_seconds")

    def limit_of(self, tool: str) -> int:
        return self.tool_limits.get(tool, self.max_tool_result_chars)


#: Settings that name a file or folder.
_PATHS = {"library", "root", "schema", "index_path", "store_path", "cases"}


def _place(path: str, file: str | None) -> str:
    own = os.path.expanduser(path)
    if "://" in own:
        return own
    return os.path.normpath(os.path.join(os.path.dirname(os.path.abspath(file)) if file else os.getcwd(), own))


def _made(kind: type, data: Any, file: str | None, at: str, origin: dict[str, str]) -> Any:
    """An object of a settings class from a mapping; where each value comes from goes into `origin`."""
    if not isinstance(data, dict):
        raise ValueError(f"{at or 'settings'} must be a mapping")
    hints, own = get_type_hints(kind), {f.name: f for f in fields(kind)}
    if set(data) - set(own):
        raise ValueError(f"unknown settings: {sorted(f'{at}{k}' for k in set(data) - set(own))}")
    values = {}
    for name, f in own.items():
        nested = next((t for t in (hints[name], *getattr(hints[name], "__args__", ())) if is_dataclass(t)), None)
        if name not in data:
            if f.default is MISSING and f.default_factory is MISSING:
                raise ValueError(f"{at}{name} is missing")
            origin[f"{at}{name}"] = "default"
            continue
        value = data[name]
        origin[f"{at}{name}"] = "file"
        if nested and value is not None:
            value = _made(nested, value, file, f"{at}{name}.", origin)
        elif name == "compaction_thresholds":
            value = tuple(value)
        elif name == "roots" and value:
            value = {k: _place(v, file) for k, v in value.items()}
        elif name in _PATHS and value is not None:
            value = _place(value, file)
        values[name] = value
    return kind(**values)


def settings(data: dict[str, Any] | None, file: str | None = None) -> tuple[Settings, dict[str, str]]:
    """The settings of a parsed mapping, and where each comes from: `file` or `default`, by dotted name."""
    origin: dict[str, str] = {}
    return _made(Settings, dict(data or {}), file, "", origin), origin


def settings_file(path: str) -> tuple[Settings, dict[str, str]]:
    """The settings of a YAML file of the driver's machine."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return settings(yaml.safe_load(f), path)
