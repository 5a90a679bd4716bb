"""Tools, their profiles, and what skills need of them."""

from __future__ import annotations

import importlib
import inspect
import textwrap
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Tool:
    name: str
    readonly: bool = True
    pseudo: bool = False
    schema: dict[str, Any] = field(default_factory=dict, compare=False)


# The built-in tools.
TOOLS = tuple(
    [Tool(n) for n in "bm25_search filtered_search section_search read_artifact_file grep_artifact get_json_field list_documents list_versions get_section fs_read fs_grep fs_glob fs_ls load_skill".split()]
    + [Tool("fs_write", readonly=False)]
    + [Tool(n, readonly=False, pseudo=True) for n in "save_note register_citation request_clarification stop escalate_to_oracle".split()]
)
NOT_IN_EVAL = ("escalate_to_oracle", "request_clarification")

_JSON = {str: "string", int: "integer", float: "number", bool: "boolean", list: "array", dict: "object"}


class Registry:
    """Functions over DataFrames as tools, by name. Arguments must be keyword-only and annotated; a name can be taken once."""

    def __init__(self) -> None:
        self.tools: dict[str, tuple[Tool, Callable[..., DataFrame]]] = {}

    def add(self, f: Callable[..., DataFrame], readonly: bool = True) -> Callable[..., DataFrame]:
        props, required = {}, []
        for p in inspect.signature(f, eval_str=True).parameters.values():
            if p.kind is not p.KEYWORD_ONLY or p.annotation is p.empty:
                raise TypeError(f"{f.__name__}: argument {p.name} must be keyword-only and annotated")
            props[p.name] = {"type": _JSON.get(p.annotation, "object")}
            if p.default is p.empty:
                required.append(p.name)
        if f.__name__ in self.tools:
            raise ValueError(f"tool {f.__name__} is there already")
        schema = {"type": "object", "properties": props, "required": required, "additionalProperties": False}
        self.tools[f.__name__] = Tool(f.__name__, readonly, schema=schema), f
        return f

    def run(self, name: str, args: dict[str, Any]) -> DataFrame:
        if name not in self.tools:
            raise KeyError(f"no tool {name}; there are {', '.join(sorted(self.tools))}")
        tool, f = self.tools[name]
        unknown, lacking = args.keys() - tool.schema["properties"].keys(), set(tool.schema["required"]) - args.keys()
        if unknown or lacking:
            raise ValueError(f"{name}: unknown {sorted(unknown)}, missing {sorted(lacking)}")
        return f(**args)


def tools(spark: SparkSession, own: tuple[Tool, ...] = TOOLS) -> DataFrame:
    names = [t.name for t in own]
    if len(set(names)) != len(names):
        raise ValueError("a tool's name is taken twice")
    return spark.createDataFrame([(t.name, t.readonly, t.pseudo) for t in own], "name string, readonly boolean, pseudo boolean")


def profiles(spark: SparkSession, own: tuple[Tool, ...] = TOOLS) -> DataFrame:
    """(profile, name): all tools; those that only read, with the pseudo tools; and these without the ones that make runs differ."""
    t = tools(spark, own)
    quiet = t.filter("readonly or pseudo")
    parts = (("full", t), ("read_only", quiet), ("eval", quiet.filter(~F.col("name").isin(*NOT_IN_EVAL))))
    out = None
    for name, rows in parts:
        rows = rows.select(F.lit(name).alias("profile"), "name")
        out = rows if out is None else out.unionByName(rows)
    return out


def missing_tools(needed: DataFrame, have: DataFrame) -> DataFrame:
    """needed(skill, tool) that no tool is there for."""
    return needed.join(have.select(F.col("name").alias("tool")), "tool", "left_anti").select("skill", "tool")


class SearchIndex(Protocol):
    """A backend of ranked retrieval: entries in, the k best for a query out."""

    def search(self, entries: DataFrame, query: str, k: int, filters: dict[str, Any] | None = None) -> DataFrame: ...


class BM25Index:
    """The default backend."""

    def search(self, entries: DataFrame, query: str, k: int, filters: dict[str, Any] | None = None) -> DataFrame:
        from spindrift.operators.search import bm25

        return bm25(entries, query, filters, k, tuple(filters or ()))


class Loader(Protocol):
    """Sources of some endings to loaded documents."""

    extensions: tuple[str, ...]

    def load(self, spark: SparkSession, source: str) -> DataFrame: ...


class Transform(Protocol):
    """Loaded documents to extractions, with failures as rows."""

    def __call__(self, loads: DataFrame) -> DataFrame: ...


class PipelineWriter(Protocol):
    """What is done with the extractions that succeeded."""

    def __call__(self, rows: DataFrame) -> None: ...


def surface(*groups: tuple[Tool, ...]) -> tuple[Tool, ...]:
    """The tools of all groups in their order; a name in two of them is an error."""
    seen: dict[str, Tool] = {}
    for t in (t for g in groups for t in g):
        if t.name in seen:
            raise ValueError(f"tool {t.name} is there already")
        seen[t.name] = t
    return tuple(seen.values())


def imported(path: str) -> Any:
    """The object that `package.module:name` or `package.module.name` stands for; anything else is an error that names the path."""
    module, _, name = path.partition(":") if isinstance(path, str) and ":" in path else str(path or "").rpartition(".")
    if not module or not name:
        raise ValueError(f"{path!r} is not of the form package.module:name")
    try:
        return getattr(importlib.import_module(module), name)
    except (ImportError, AttributeError) as e:
        raise ValueError(f"{path!r} cannot be imported: {e}") from e


@dataclass(frozen=True)
class Skill:
    """Instructions that an agent loads when it needs them, and the tools they speak of."""

    name: str
    description: str
    instructions: str
    tools: tuple[str, ...] = ()

    def body(self) -> str:
        return textwrap.dedent(self.instructions).strip()


def load_skill(skills: tuple[Skill, ...], name: str) -> dict[str, Any]:
    """A skill's instructions by name, or an error with the names there are."""
    found = {s.name: s for s in skills}.get(name)
    return {"skill": name, "instructions": found.body()} if found else {"error": f"unknown skill: {name!r}", "available_skills": sorted(s.name for s in skills)}


def skill_table(spark: SparkSession, skills: tuple[Skill, ...]) -> DataFrame:
    """(skill, instructions, tool), a row for each tool a skill needs."""
    rows = [(s.name, s.body(), t) for s in skills for t in (s.tools or (None,))]
    return spark.createDataFrame(rows, "skill string, instructions string, tool string")


# Fixed value: the heading of the list of skills.
MENU = "## Available skills"


def composed_role(role: str, skills: tuple[Skill, ...], lead: str = "Load a skill by load_skill(name=...) when it bears on the step at hand, and follow it.") -> str:
    """The role's text with a list of skills under it; without skills as it is."""
    if not skills:
        return role
    menu = "\n\n".join([MENU, lead, "\n".join(f"- {s.name}: {s.description}" for s in skills)])
    return f"{role.rstrip()}\n\n{menu}" if role.strip() else menu


# The points at which plug-ins may change what passes, and those at which they may look on.
CHANGING = "before_tool_call after_tool_call on_final_answer".split()
WATCHING = "on_session_start on_session_end on_event on_error".split()


class Hooks:
    """Plug-ins around a DataFrame: transforms are applied in order and fail loudly; observers see each result and can do no harm. With a name they are called at that point only."""

    def __init__(self) -> None:
        self.transforms: list[Callable[[DataFrame], DataFrame]] = []
        self.observers: list[Callable[[DataFrame], Any]] = []
        self._at: dict[str, Hooks] = {}

    def at(self, point: str) -> Hooks:
        """The plug-ins of one point; changing ones only where something passes."""
        if point not in CHANGING + WATCHING:
            raise ValueError(f"no point {point!r}; there are {', '.join(CHANGING + WATCHING)}")
        return self._at.setdefault(point, Hooks())

    def passed(self, point: str, df: DataFrame) -> DataFrame:
        """What comes out at a point; where plug-ins only look on, what went in."""
        out = self.at(point).apply(df)
        return out if point in CHANGING else df

    def apply(self, df: DataFrame) -> DataFrame:
        for f in self.transforms:
            df = df.transform(f)
        for o in self.observers:
            try:
                o(df)
            except Exception:  # noqa: BLE001
                continue
        return df
