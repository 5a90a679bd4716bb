"""Compiled entities as files: sections, payloads and manifests, put in place whole; search entries; map caches; dead letters; a user's files."""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.operators.artifacts import Schema, template_keys
from spindrift.operators.files import FS_TEXT
from spindrift.operators.ingestion import upserted
from spindrift.operators.trees import located
from spindrift.sources.readers import sidecar
from spindrift.storage import Place

MANIFEST = "extraction_meta.json"


def manifest(schema: Schema, identifiers: dict[str, str], files: list[str], meta: dict[str, Any] | None) -> dict[str, Any]:
    """What an entity's folder holds and where it comes from; the extractor's own fields stand by themselves."""
    return {"schema_version": schema.version, "identifiers": identifiers, "files": files, "extractor": meta or {}}


def write_entity(spark: SparkSession, root: str, schema: Schema, identifiers: dict[str, str], sections: dict[str, str] | None = None, payloads: dict[str, Any] | None = None, meta: dict[str, Any] | None = None) -> list[str]:
    """Writes an entity's sections and JSON payloads with a manifest, and gives their names, sorted.

    All of it is written beside, then the old folder is moved away and the new one into its place; if that fails the old
    one is put back. Identifiers other than the template's, unknown sections and unsafe names are errors.
    """
    keys = template_keys(schema.entity_path)
    if set(keys) != set(identifiers) or any(not v or "/" in v or "\\" in v or v in (".", "..") for v in identifiers.values()):
        raise ValueError(f"identifiers must be {keys}: {identifiers}")
    contents = {**(sections or {}), **{k: json.dumps(v, indent=2, sort_keys=True, ensure_ascii=False) for k, v in (payloads or {}).items()}}
    unknown = [n for n in sections or {} if schema.spec_of(n) is None] + [n for n in payloads or {} if n not in {p.name for p in schema.payloads}]
    if unknown or any(n.startswith("/") or ".." in n.split("/") for n in contents):
        raise ValueError(f"not in the schema, or no name within the entity: {unknown or sorted(contents)}")
    late = [n for n, t in (sections or {}).items() if (m := schema.spec_of(n).max_chars) and len(t) > m]
    if late:
        raise ValueError(f"longer than max_chars: {late}")
    base = Place(spark, root)
    path = schema.entity_path.format(**identifiers)
    new, old, at = base / f".staging/{uuid.uuid4().hex}", base / f".trash/{uuid.uuid4().hex}", base / path
    files = sorted(contents)
    try:
        for name in files:
            (new / name).write(contents[name].encode())
        (new / MANIFEST).write(json.dumps(manifest(schema, identifiers, files, meta), indent=2, ensure_ascii=False).encode())
        if at.exists():
            at.move(old)
        try:
            new.move(at)
        except Exception:
            if old.exists() and not at.exists():
                old.move(at)
            raise
    finally:
        new.delete()
        if at.exists():
            old.delete()
    return files


def section_files(docs: DataFrame, path: Column, content: Column) -> DataFrame:
    """(path, content) of many entities' files at once, for a table in place of folders."""
    return docs.select(path.alias("path"), content.alias("content"))


def manifests(files: DataFrame, version: str) -> DataFrame:
    """Manifests of many entities: files(entity_id, version, name, meta) to a row each with its sorted files. The extractor's fields are those of the first file by name."""
    return files.groupBy("entity_id", "version").agg(F.sort_array(F.collect_set("name")).alias("files"), F.min_by("meta", "name").alias("extractor")).withColumn("schema_version", F.lit(version))


def search_entry(identifiers: Column, sections: Column, meta: Column) -> list[Column]:
    """id (identifier values by sorted key, joined by /), identifiers, text (sections in their order, between blank lines), sections and source (the metadata's source, else its url, else empty) of an entity. `sections` is an array of (name, text), as a map has no order."""
    values = F.transform(F.array_sort(F.map_entries(identifiers)), lambda e: e["value"])
    source = F.coalesce(F.nullif(F.try_element_at(meta, F.lit("source")), F.lit("")), F.try_element_at(meta, F.lit("url")), F.lit(""))
    text = F.array_join(F.transform(sections, lambda s: s["text"]), "\n\n")
    return [F.array_join(values, "/").alias("id"), identifiers.alias("identifiers"), text.alias("text"), F.map_from_entries(sections).alias("sections"), source.alias("source")]


def upsert_sidecar(spark: SparkSession, entries: DataFrame, path: str) -> None:
    """Puts search entries into a sidecar file by id, sorted by id; one that is missing or unreadable counts as empty. One writer at a time; the file is replaced whole, so a sidecar is as large as a JSON file can be read."""
    rows = upserted(sidecar(spark, path), entries.select("id", "identifiers", "text", "sections", "source"))
    lines = [json.loads(r.j) for r in rows.select("id", F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("j")).orderBy("id").toLocalIterator()]
    Place(spark, path).write(json.dumps(lines, ensure_ascii=False).encode())


def upsert_entries(spark: SparkSession, entries: DataFrame, path: str, parts: int = 64) -> None:
    """The same for sidecars of any size: a table of entries in folders by the hash of their id, of which only those with new entries are written again. One writer at a time."""
    bucket = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("bucket")
    new = entries.select("id", "identifiers", "text", "sections", "source", bucket)
    at = Place(spark, path)
    if at.exists():
        old = spark.read.schema(new.schema).parquet(path).join(F.broadcast(new.select("bucket").distinct()), "bucket", "left_semi").select(new.columns)
        new = upserted(old, new)
    staged = Place(spark, f"{path}.{uuid.uuid4().hex}")
    try:
        new.write.partitionBy("bucket").parquet(str(staged))
        for name in staged.names():
            if name.startswith("bucket="):
                (at / name).delete()
                (staged / name).move(at / name)
    finally:
        staged.delete()


def cache_put(spark: SparkSession, answers: DataFrame, path: str) -> None:
    """Adds answers(key, answer) to a map cache, a table in which a key's first answer holds."""
    old = Place(spark, path)
    new = answers.dropDuplicates(["key"])
    if old.exists():
        new = new.join(spark.read.parquet(path).select("key"), "key", "left_anti")
    new.write.mode("append").parquet(path)


def cached(spark: SparkSession, path: str) -> DataFrame | None:
    """The map cache, without answers that are no JSON objects, or none."""
    if not Place(spark, path).exists():
        return None
    return spark.read.parquet(path).filter(F.json_object_keys("answer").isNotNull()).dropDuplicates(["key"])


def dead_letter(spark: SparkSession, root: str, source: str, raw: bytes | None, error: BaseException, payload: Any = None) -> str:
    """The folder of one failed source: its bytes, what went wrong with the traceback, and the payload or result there was."""
    import traceback

    name = source.rstrip("/").rsplit("/", 1)[-1]
    stem, dot, ending = name.rpartition(".")
    at = Place(spark, root) / (stem or name)
    if raw is not None:
        (at / f"raw.{ending if dot and stem else 'bin'}").write(raw)
    told = {"source": source, "error_type": type(error).__name__, "message": str(error), "traceback": traceback.format_exception(error)}
    (at / "error.json").write(json.dumps(told, indent=2).encode())
    if payload is not None:
        (at / "payload.json").write(json.dumps(payload, indent=2, sort_keys=True, default=str).encode())
    return str(at)


def fs_write(spark: SparkSession, roots: dict[str, str], path: str, content: str, enabled: bool = False) -> dict[str, Any]:
    """Writes a text file below one of the roots, with the folders it needs: path, bytes_written and whether it was created. Only where writing is enabled, and only endings of text."""
    if not enabled:
        raise PermissionError("writing is not enabled")
    root, rest = located(dict.fromkeys(roots), path)  # type: ignore[arg-type]
    name = rest.rsplit("/", 1)[-1]
    if "." not in name[1:] or f".{name.rsplit('.', 1)[-1].lower()}" not in FS_TEXT:
        raise ValueError(f"{path!r} has no ending of a text file")
    at = Place(spark, f"{roots[root]}/{rest}")
    if at.is_dir():
        raise IsADirectoryError(path)
    created = not at.exists()
    at.write(content.encode())
    return {"path": path, "bytes_written": len(content.encode()), "created": created}
