"""Declared shapes of compiled artifacts: what a payload may hold, checked as columns."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names of field types, and the JSON kinds each admits (true counts as a whole number, a whole number is no float).
TYPES = {
    "str": "string", "string": "string", "int": "integer", "integer": "integer", "float": "number", "number": "number",
    "bool": "boolean", "boolean": "boolean", "list": "array", "array": "array", "dict": "object", "object": "object",
}
_ADMITS = {"string": ["STRING"], "integer": ["BIGINT", "BOOLEAN"], "number": ["DOUBLE", "FLOAT", "DECIMAL"], "boolean": ["BOOLEAN"], "array": ["ARRAY"], "object": ["OBJECT"]}
_SPARK = {"string": T.StringType(), "integer": T.LongType(), "number": T.DoubleType(), "boolean": T.BooleanType(), "array": T.StringType(), "object": T.StringType()}

_PLACE = re.compile(r"\{([A-Za-z_]\w*)\}")


def template_keys(template: str) -> tuple[str, ...]:
    """Names of the placeholders, each once, in order."""
    return tuple(dict.fromkeys(_PLACE.findall(template)))


def template_path(template: str, values: dict[str, Column]) -> Column:
    """The template with columns in its places; missing and unexpected names are errors."""
    keys = set(template_keys(template))
    if keys != set(values):
        raise ValueError(f"{template!r}: missing {sorted(keys - set(values))}, unexpected {sorted(set(values) - keys)}")
    parts = _PLACE.split(template)
    return F.concat(*(values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts)))


@dataclass(frozen=True)
class Section:
    name: str
    required: bool = False
    max_chars: int | None = None

    def __post_init__(self) -> None:
        if not self.name or (self.required and "*" in self.name) or (self.max_chars is not None and self.max_chars <= 0):
            raise ValueError(f"bad section {self}")


@dataclass(frozen=True)
class Payload:
    """A JSON artifact: fields by type name. All are required unless `required` says which; without fields it is optional."""

    name: str
    fields: dict[str, str] = field(default_factory=dict)
    required: tuple[str, ...] | None = None

    def __post_init__(self) -> None:
        if not self.name.endswith(".json"):
            raise ValueError(f"{self.name!r} must end with .json")
        for k, t in self.fields.items():
            if isinstance(t, str) and t not in TYPES:
                raise ValueError(f"{self.name}: field {k} has the unknown type {t!r}")
        if set(self.required or ()) - set(self.fields):
            raise ValueError(f"{self.name}: required fields that are not declared")

    @property
    def needed(self) -> tuple[str, ...]:
        return tuple(self.fields) if self.required is None else self.required

    def kind(self, name: str) -> str:
        return TYPES.get(self.fields[name], "string")


def _object(kinds: dict[str, str], required: list[str]) -> dict[str, Any]:
    return {"type": "object", "properties": {k: {"type": t} for k, t in kinds.items()}, "required": required}


@dataclass(frozen=True)
class Schema:
    entity_path: str = "{entity_id}/{version}"
    sections: tuple[Section, ...] = ()
    payloads: tuple[Payload, ...] = ()
    version: str = "1"

    def __post_init__(self) -> None:
        if not template_keys(self.entity_path):
            raise ValueError("entity_path needs a placeholder")
        for names in ([s.name for s in self.sections], [p.name for p in self.payloads]):
            if len(set(names)) != len(names):
                raise ValueError(f"a name is declared twice: {names}")

    @classmethod
    def parsed(cls, data: dict[str, Any]) -> Schema:
        """From a mapping, as read from a YAML file."""
        sections = tuple(Section(**s) if isinstance(s, dict) else Section(s) for s in data.get("sections") or ())
        payloads = tuple(
            Payload(p) if isinstance(p, str) else Payload(p["name"], p.get("fields") or {}, tuple(p["required_fields"]) if p.get("required_fields") is not None else None) for p in data.get("json_artifacts") or ()
        )
        return cls(data.get("entity_path", cls.entity_path), sections, payloads, str(data.get("version", "1")))

    @classmethod
    def from_yaml(cls, text: str) -> Schema:
        try:
            import yaml
        except ImportError as e:
            raise ImportError("reading YAML needs PyYAML") from e
        return cls.parsed(yaml.safe_load(text))

    def layered(self, base: tuple[Section, ...]) -> Schema:
        """For mixed corpora: the base sections first, the own ones optional and without those of the base, no JSON field required."""
        names = {s.name for s in base}
        own = tuple(Section(s.name, False, s.max_chars) for s in self.sections if s.name not in names)
        return Schema(self.entity_path, (*base, *own), tuple(Payload(p.name, p.fields, ()) if p.fields else p for p in self.payloads), self.version)

    def spec_of(self, section: str) -> Section | None:
        """The section's own spec, else the one with the longest prefix before its `*`, else none."""
        own = [s for s in self.sections if s.name == section]
        globs = [s for s in self.sections if s.name.endswith("*") and section.startswith(s.name[:-1])]
        return next(iter(own + sorted(globs, key=lambda s: -len(s.name))), None)

    def json_schema(self) -> dict[str, Any]:
        """What an extraction must look like, as a JSON Schema: all named sections and payloads; sections of other names are texts, too."""
        named = [s for s in self.sections if "*" not in s.name]
        texts = _object({s.name: "string" for s in named}, [s.name for s in named if s.required]) | {"additionalProperties": {"type": "string"}}
        payloads = {p.name: _object({k: p.kind(k) for k in p.fields}, sorted(p.needed)) for p in self.payloads}
        parts = {"sections": texts, "json_artifacts": {"type": "object", "properties": payloads, "required": list(payloads)}}
        return {"type": "object", "properties": parts, "required": list(parts)}

    def struct(self, payload: str) -> T.StructType:
        """A payload's columns."""
        p = next(p for p in self.payloads if p.name == payload)
        return T.StructType([T.StructField(k, _SPARK[p.kind(k)], k not in p.needed) for k in p.fields])

    def rendered(self) -> str:
        """The named sections as lines for a prompt."""
        return "\n".join(f"- {s.name} ({f'<={s.max_chars} chars' if s.max_chars else 'no limit'})" for s in self.sections if "*" not in s.name)


# The schemas for documents of one shape and for mixed ones.
DOCUMENTS = Schema(sections=(Section("document_summary"), Section("sections/*"), Section("insights/*")), payloads=(Payload("metadata.json"),))
MIXED = Schema(
    sections=(Section("overview/topic_summary", True), *map(Section, ("key_concepts", "entities_and_definitions", "structure/outline", "notable_passages", "citations/source_evidence"))),
    payloads=(Payload("metadata.json"),),
)


def payload_errors(payload: Column, spec: Payload) -> Column:
    """What is wrong with a JSON text, as an array: no object, missing required fields (a null is there), fields of another type."""
    v = F.try_parse_json(payload)
    keys = F.json_object_keys(payload)
    out = [F.when(payload.isNotNull() & keys.isNull(), f"{spec.name} must be an object"), F.when(payload.isNull() & F.lit(bool(spec.needed)), f"missing required {spec.name}")]
    for k in spec.needed:
        out.append(F.when(keys.isNotNull() & ~F.array_contains(keys, k), f"{spec.name} misses {k}"))
    for k in spec.fields:
        found = F.regexp_extract(F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant")), r"^\w+", 0)
        bad = F.array_contains(keys, k) & (found != "VOID") & ~found.isin(_ADMITS[spec.kind(k)])
        out.append(F.when(F.coalesce(bad, F.lit(False)), F.concat(F.lit(f"{spec.name} field {k}: expected {spec.kind(k)}, got "), F.lower(found))))
    return F.array_compact(F.array(*out))


def compacted_stub(result: Column) -> Column:
    """The one line that compaction leaves of a tool's result: the keys of a truncation envelope, else the kind of value, else that it is opaque."""
    v = F.try_parse_json(result)
    keys = F.json_object_keys(result)
    kind = F.regexp_extract(F.schema_of_variant(v), r"^\w+", 0)
    names = F.create_map(*(F.lit(x) for kv in {"OBJECT": "dict", "ARRAY": "list", "STRING": "str", "BIGINT": "int", "DOUBLE": "float", "DECIMAL": "float", "BOOLEAN": "bool", "VOID": "NoneType"}.items() for x in kv))
    listed = F.coalesce(F.nullif(F.get_json_object(result, "$.available_keys"), F.lit("[]")), F.concat(F.lit("["), F.array_join(F.slice(keys, 1, 5), ","), F.lit("]")))
    return F.concat(F.lit("compacted-result "), F.when(v.isNull(), "(opaque)").when(F.array_contains(keys, "_truncated"), F.concat(F.lit("keys="), listed)).otherwise(F.coalesce(F.try_element_at(names, kind), F.lit("(opaque)"))))


def result_line(result: Column, truncated: Column) -> Column:
    """A tool's result in a line: counts of its lists, size, whether there is more, whether it was cut."""
    n = lambda k, label: F.when(F.json_array_length(F.get_json_object(result, f"$.{k}")).isNotNull(), F.concat(F.json_array_length(F.get_json_object(result, f"$.{k}")).cast("string"), F.lit(f" {label}")))
    size = F.coalesce(F.get_json_object(result, "$.total_size").try_cast("long"), F.octet_length(F.get_json_object(result, "$.content")).cast("long"))
    label = F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).when(size < 1024 * 1024, F.concat(F.format_string("%.1f", size / 1024), F.lit(" KB"))).otherwise(F.concat(F.format_string("%.1f", size / 1024 / 1024), F.lit(" MB")))
    more = F.when(F.get_json_object(result, "$.has_more") == "true", "more available")
    parts = F.concat_ws(" · ", n("hits", "hits"), n("matches", "matches"), n("entities", "entities"), n("paths", "paths"), label, more, F.when(truncated, "truncated"))
    return F.when(parts == "", "ok").otherwise(parts)


def map_reduced(docs: DataFrame, adapter, key: str = "doc_id", text: str = "text", size: int = 8000, reduce_chars: int = 80_000, max_chars: int | None = None) -> DataFrame:
    """(key, chunks, summary): pages packed into chunks, the adapter's answer to each distinct chunk, joined in order, cut for the reduction, and reduced by the adapter unless a single answer fits.

    Equal chunks are answered once; their answers are found by the hash of their text.
    """
    from spindrift.functions.text import packed_pages
    from spindrift.operators.ingestion import extracted

    parts = docs.filter(F.col(text).isNotNull()).select(key, F.posexplode(packed_pages(F.col(text), size)).alias("chunk", "body")).withColumn("hash", F.sha2("body", 256))
    distinct = parts.groupBy("hash").agg(F.min("body").alias("body"))
    answers = extracted(distinct, adapter, "hash", "body").select("hash", F.coalesce("response", F.lit("")).alias("response"))
    joined = parts.join(answers, "hash").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("chunk", "response"))).alias("p"))
    rows = joined.select(key, F.size("p").alias("chunks"), F.substring(F.array_join(F.transform("p", lambda x: x["response"]), "\n\n---\n\n"), 1, reduce_chars).alias("joined"))
    fits = (F.col("chunks") == 1) & (F.lit(max_chars is None) | (F.length("joined") <= (max_chars or 0)))
    reduced = extracted(rows.filter(~fits), adapter, key, "joined").select(key, F.col("response").alias("reduced"))
    out = rows.join(reduced, key, "left").withColumn("summary", F.coalesce("reduced", "joined"))
    return out.select(key, "chunks", (F.substring("summary", 1, max_chars) if max_chars else F.col("summary")).alias("summary"))
