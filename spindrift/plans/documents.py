"""Queries over documents and payloads, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions import markup
from spindrift.functions import text as X
from spindrift.functions.decoding import decoded
from spindrift.operators import artifacts, extraction, files, ingestion, search, trees
from spindrift.runtime import spread, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with SQL if there is some."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


ASKED = "revenue mill revenue lenders terminal"


def entries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "lang", "source", "section")


def doc_files(spark: SparkSession, d: str) -> DataFrame:
    """The documents as files of a tree."""
    path = F.concat_ws("/", "source", F.coalesce("entity_id", F.lit("none")), F.concat("doc_id", F.lit(".txt")))
    return table(spark, d, "documents").filter("text is not null").select(path.alias("path"), F.col("text").alias("content"))


_TOK = r"'([\p{L}\p{N}_]+)'"
_PATH = "concat_ws('/', source, coalesce(entity_id, 'none'), doc_id || '.txt')"


_LINES = r"regexp_split_to_array(text, '\r\n|[\n\r\x{0b}\x{0c}\x{1c}\x{1d}\x{1e}\x{85}\x{2028}\x{2029}]')"


def _bm25_sql(asked: str, where: str = "true", tail: str = "", extra: str = "", base: str = "documents", cols: str = "doc_id AS id, text, lang, source") -> str:
    words = search.query_terms(asked)
    distinct = list(dict.fromkeys(words))
    tf = ", ".join(f"len(list_filter(w, lambda x: x = '{w}')) AS tf{i}" for i, w in enumerate(distinct))
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(distinct)))
    part = " + ".join(
        f"CASE WHEN tf{distinct.index(w)} > 0 THEN ln(1 + (n - df{distinct.index(w)} + 0.5::DOUBLE) / (df{distinct.index(w)} + 0.5::DOUBLE)) * tf{distinct.index(w)} * 2.5::DOUBLE / (tf{distinct.index(w)} + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avg_len)) ELSE 0 END"
        for w in words
    )
    hit = " OR ".join(f"tf{i} > 0" for i in range(len(distinct)))
    return f"""
WITH e AS (SELECT {cols} FROM {base}),
t AS (SELECT *, regexp_extract_all(lower(coalesce(text, '')), {_TOK}, 1) AS w FROM e),
c AS (SELECT *, len(w) AS dl, {tf} FROM t),
s AS (SELECT count(*) AS n, avg(dl) AS avg_len, {df} FROM c),
scored AS (SELECT id, lang, source, text, round({part}, 6) AS score FROM c, s WHERE ({hit}) AND ({where}))
SELECT id, score{extra} FROM scored WHERE score > 0 ORDER BY score DESC, id {tail}"""


@query(_bm25_sql(ASKED, tail="LIMIT 10"))
def bm25_top_k(spark: SparkSession, d: str) -> DataFrame:
    return search.bm25(entries(spark, d), ASKED, k=10)


@query(_bm25_sql("umsatz mio gläubiger", "lang = 'de'", "LIMIT 5", ", lang"))
def bm25_filtered(spark: SparkSession, d: str) -> DataFrame:
    return search.bm25(entries(spark, d), "umsatz mio gläubiger", {"lang": "de"}, attributes=("lang",))


@query(_bm25_sql("terminal", "lang IN ('fr', 'es', 'it') AND source = 'filing'", "LIMIT 20", ", lang, source"))
def bm25_lang_or_filter(spark: SparkSession, d: str) -> DataFrame:
    return search.bm25(entries(spark, d), "terminal", {"lang": ["fr", "es", "it"], "source": "filing"}, k=500, attributes=("lang", "source"))


_SNIP = r"""
SELECT id, score, CASE WHEN p IS NULL THEN regexp_replace(text[1:240], '^[\s\x1c-\x1f\x{85}\p{Z}]+|[\s\x1c-\x1f\x{85}\p{Z}]+$', '', 'g') || CASE WHEN length(text) > 240 THEN '…' ELSE '' END
  ELSE CASE WHEN a > 0 THEN '…' ELSE '' END || regexp_replace(text[a + 1:b], '^[\s\x1c-\x1f\x{85}\p{Z}]+|[\s\x1c-\x1f\x{85}\p{Z}]+$', '', 'g') || CASE WHEN b < length(text) THEN '…' ELSE '' END END AS snippet
FROM (SELECT *, s - length(regexp_extract(text[1:s], '[\p{L}\p{N}]*$')) AS a, z + length(regexp_extract(text[z + 1:], '^[\p{L}\p{N}]*')) AS b
  FROM (SELECT *, greatest(p - 1 - 120, 0) AS s, least(p - 1 + 120, length(text)) AS z
    FROM (SELECT *, list_min(list_filter([instr(lower(text), 'furnaces'), instr(lower(text), 'öfen')], lambda x: x > 0)) AS p FROM hits)))"""


@query("WITH hits AS (" + _bm25_sql("furnaces öfen", tail="LIMIT 20", extra=", text") + ")" + _SNIP)
def bm25_snippet(spark: SparkSession, d: str) -> DataFrame:
    e = entries(spark, d)
    return search.with_snippets(search.bm25(e, "furnaces öfen", k=20), e, "furnaces öfen")


@query("SELECT doc_id AS id, lang, source, 0.0::DOUBLE AS score FROM documents WHERE lang = 'pt' AND source IN ('faq', 'guide') ORDER BY doc_id LIMIT 20")
def filtered_search(spark: SparkSession, d: str) -> DataFrame:
    return search.filtered_search(entries(spark, d).select("id", "lang", "source"), {"lang": "pt", "source": ["faq", "guide"]}, 20)


@query(_bm25_sql("permit storms", tail="LIMIT 5", base="(SELECT * FROM documents WHERE section = 'sections/mdna' AND text <> '')"))
def section_search(spark: SparkSession, d: str) -> DataFrame:
    """Ranked within one section: counts and lengths are of the entries that have it."""
    return search.bm25(entries(spark, d).filter("section = 'sections/mdna' and text != ''"), "permit storms")


@query(f"""
WITH w AS (SELECT doc_id, text, section, regexp_extract_all(lower(coalesce(text, '')), {_TOK}, 1) AS w FROM documents)
SELECT (SELECT count(*) FROM w) AS docs, (SELECT round(avg(len(w)), 2) FROM w) AS avg_len, (SELECT string_agg(DISTINCT section, ',' ORDER BY section) FROM w) AS sections,
  (SELECT sum(octet_length(encode(coalesce(text, ''))))::BIGINT FROM w) AS bytes, (SELECT count(DISTINCT x) FROM (SELECT unnest(w) AS x FROM w)) AS vocabulary,
  (SELECT string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) FROM (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 5)) AS first_ids""")
def index_stats(spark: SparkSession, d: str) -> DataFrame:
    return search.index_stats(entries(spark, d), "section")


@query(f"""
SELECT term, count(DISTINCT doc_id) AS df, count(*) AS total FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), {_TOK}, 1)) AS term FROM documents)
GROUP BY term ORDER BY df DESC, term LIMIT 100""")
def term_df_top(spark: SparkSession, d: str) -> DataFrame:
    p = search.build_index(entries(spark, d)).postings
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).orderBy(F.desc("df"), "term").limit(100)


@query(f"SELECT doc_id AS id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), {_TOK}, 1)) AS term FROM documents) GROUP BY 1, 2")
def postings(spark: SparkSession, d: str) -> DataFrame:
    return search.build_index(entries(spark, d)).postings


@query(f"""
WITH p AS (SELECT doc_id AS id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), {_TOK}, 1)) AS term FROM documents) GROUP BY 1, 2),
l AS (SELECT doc_id AS id, len(regexp_extract_all(lower(coalesce(text, '')), {_TOK}, 1)) AS len FROM documents),
s AS (SELECT count(*) AS n, avg(len) AS avg_len FROM l), f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
q AS (SELECT query_id, term, count(*) AS qn FROM (SELECT case_id AS query_id, unnest(regexp_extract_all(lower(query), {_TOK}, 1)) AS term FROM eval_cases) GROUP BY 1, 2),
r AS (SELECT query_id, id, round(sum(qn * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg_len))), 6) AS score
      FROM p JOIN q USING (term) JOIN f USING (term) JOIN l USING (id), s GROUP BY 1, 2)
SELECT query_id, id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM r) WHERE rank <= 3""")
def bm25_all_cases(spark: SparkSession, d: str) -> DataFrame:
    """Every case's question against all documents."""
    asked = table(spark, d, "eval_cases").select(F.col("case_id").alias("query_id"), "query")
    return search.bm25_batch(entries(spark, d), asked, 3)


def _grep_sql(test: str) -> str:
    return f"SELECT path, no AS line_no, line FROM (SELECT {_PATH} AS path, unnest({_LINES}) AS line, unnest(range(1, len({_LINES}) + 1)) AS no FROM documents WHERE text IS NOT NULL) WHERE {test}"


@query(f"SELECT path, line_no::INT AS line_no, line, (SELECT count(*) FROM (SELECT * FROM ({_grep_sql("contains(line, 'Pelbasenberg')")}) LIMIT 10)) >= 10 AS truncated FROM ({_grep_sql("contains(line, 'Pelbasenberg')")}) ORDER BY path, line_no LIMIT 10")
def grep_literal(spark: SparkSession, d: str) -> DataFrame:
    return files.grep(doc_files(spark, d), "Pelbasenberg")


@query(f"SELECT path, line_no::INT AS line_no, line FROM ({_grep_sql("contains(replace(lower(line), 'ß', 'ss'), 'glasshütte') OR contains(replace(lower(line), 'ß', 'ss'), 'nachliess')")})")
def grep_casefold(spark: SparkSession, d: str) -> DataFrame:
    f = doc_files(spark, d)
    return files.matching_lines(f, "NACHLIESS", True).unionByName(files.matching_lines(f, "Glasshütte", True)).distinct()


@query(f"SELECT path, count(*) AS matches, least(count(*), 10) AS shown, count(*) >= 10 AS truncated FROM ({_grep_sql("contains(line, 'units')")}) GROUP BY path")
def grep_capped_per_doc(spark: SparkSession, d: str) -> DataFrame:
    return files.grep_per_file(doc_files(spark, d), "units")


def _slice_sql(offset: int, limit: int) -> str:
    return f'SELECT {_PATH} AS path, text[{offset + 1}:{offset + limit}] AS content, {offset} AS "offset", {limit} AS "limit", {offset + limit} < length(text) AS has_more, length(text)::INT AS total_size FROM documents WHERE text IS NOT NULL'


@query(_slice_sql(100, 400))
def read_page_slice(spark: SparkSession, d: str) -> DataFrame:
    return files.read_slice(doc_files(spark, d), 100, 400)


@query(_slice_sql(0, 8000))
def fs_read_slice(spark: SparkSession, d: str) -> DataFrame:
    return files.read_slice(doc_files(spark, d), 0, 50_000, files.FS_READ_MAX)


KEYS = ("entity_id", "version")


def library(spark: SparkSession, d: str) -> DataFrame:
    """The documents as files of compiled entities: entity/version/section."""
    docs = table(spark, d, "documents").filter("entity_id is not null and version is not null and section is not null and text is not null")
    return docs.select(F.concat_ws("/", *KEYS, "section").alias("path"), F.col("text").alias("content"))


_LIBRARY = "(SELECT entity_id, version, section, text FROM documents WHERE entity_id IS NOT NULL AND version IS NOT NULL AND section IS NOT NULL AND text IS NOT NULL)"


@query(f"SELECT DISTINCT entity_id, version FROM {_LIBRARY}")
def entity_tree(spark: SparkSession, d: str) -> DataFrame:
    return trees.entities(library(spark, d), KEYS)


@query(f"SELECT DISTINCT entity_id, version, (SELECT count(DISTINCT entity_id) FROM {_LIBRARY} WHERE version = '2022') AS count FROM {_LIBRARY} WHERE version = '2022' ORDER BY 1, 2")
def list_documents(spark: SparkSession, d: str) -> DataFrame:
    return trees.list_entities(trees.entities(library(spark, d), KEYS), KEYS, version="2022", entity_id=None)


@query(f"SELECT DISTINCT version FROM {_LIBRARY} WHERE entity_id = 'COMAR' ORDER BY 1")
def list_versions(spark: SparkSession, d: str) -> DataFrame:
    return trees.list_versions(trees.entities(library(spark, d), KEYS), KEYS, entity_id="COMAR")


@query(f"SELECT section, 'COMAR/2022/' || section AS path, text AS content, length(text)::INT AS size FROM {_LIBRARY} WHERE entity_id = 'COMAR' AND version = '2022' AND section = 'sections/mdna'")
def get_section(spark: SparkSession, d: str) -> DataFrame:
    return trees.get_section(library(spark, d), KEYS, "sections/mdna", entity_id="COMAR", version="2022")


def roots(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The compiled sections and the documents by kind as two roots."""
    return {"library": library(spark, d).withColumn("path", F.concat("path", F.lit(".md"))), "docs": doc_files(spark, d)}


_ROOTS = f"""(SELECT 0 AS rank, 'library/' || entity_id || '/' || version || '/' || section || '.md' AS path, text FROM {_LIBRARY} UNION ALL SELECT 1, 'docs/' || {_PATH}, text FROM documents WHERE text IS NOT NULL)"""


@query(f"SELECT rank::INT AS rank, path AS shown, count(*) AS files FROM {_ROOTS} GROUP BY 1, 2")
def root_union(spark: SparkSession, d: str) -> DataFrame:
    return trees.rooted(roots(spark, d)).groupBy("rank", "shown").agg(F.count("*").alias("files"))


def _root_grep_sql(cap: int) -> str:
    lines = f"(SELECT rank, path, unnest({_LINES}) AS line, unnest(range(1, len({_LINES}) + 1)) AS no FROM {_ROOTS})"
    first = f"(SELECT * FROM {lines} WHERE contains(line, 'Pelbasenberg') ORDER BY rank, path, no LIMIT {cap})"
    return f"SELECT path, no::INT AS line_no, line, (SELECT count(*) FROM {first}) >= {cap} AS truncated FROM {first}"


@query(_root_grep_sql(20))
def fs_grep(spark: SparkSession, d: str) -> DataFrame:
    return trees.fs_grep(roots(spark, d), "Pelbasenberg")


@query("""SELECT entity_id, count(DISTINCT version) AS versions, count(*) AS files, sum(octet_length(encode(coalesce(text, ''))))::BIGINT AS bytes,
  sum(CASE WHEN json_valid(text) AND json_type(text) = 'OBJECT' THEN len(json_keys(text)) ELSE 0 END)::BIGINT AS fields, sum(CASE WHEN json_valid(text) AND json_type(text) = 'ARRAY' THEN json_array_length(text) ELSE 0 END)::BIGINT AS items FROM documents GROUP BY 1""")
def entity_counts(spark: SparkSession, d: str) -> DataFrame:
    return ingestion.tree_counts(table(spark, d, "documents"))


@query("SELECT r_name, count(*) AS nations, min(n_name) AS first_nation FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def region_tree(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").join(table(spark, d, "region"), F.expr("n_regionkey = r_regionkey")).groupBy("r_name").agg(F.count("*").alias("nations"), F.min("n_name").alias("first_nation"))


def _tried(spark: SparkSession, d: str) -> DataFrame:
    """Paths of payloads as users might write them, good and bad."""
    variants = F.explode(F.array(*(F.format_string(p, "source") for p in ("%s", "/%s", "../%s", "a/../../%s", "./%s", ".git/%s", "x/.hidden/%s", "b/node_modules/%s", "a/../%s"))))
    return table(spark, d, "loaded_documents").select("load_id", variants.alias("path"))


_TRIED = "(SELECT load_id, unnest([source, '/' || source, '../' || source, 'a/../../' || source, './' || source, '.git/' || source, 'x/.hidden/' || source, 'b/node_modules/' || source, 'a/../' || source]) AS path FROM loaded_documents)"


@query(f"SELECT load_id, path, path = '' OR starts_with(path, '/') OR starts_with(path, '../') OR starts_with(path, 'a/../../') AS refused FROM {_TRIED}")
def path_sandbox(spark: SparkSession, d: str) -> DataFrame:
    return _tried(spark, d).withColumn("refused", files.escapes(F.col("path")))


@query(f"SELECT load_id, path, starts_with(path, '.git/') OR starts_with(path, 'x/.hidden/') OR starts_with(path, 'b/node_modules/') AS ignored FROM {_TRIED} WHERE NOT contains(path, '..')")
def ignore_hidden(spark: SparkSession, d: str) -> DataFrame:
    return _tried(spark, d).filter(~F.contains("path", F.lit(".."))).withColumn("ignored", files.ignored(F.col("path")))


@query("SELECT source AS path FROM loaded_documents WHERE regexp_full_match(source, '([^/]+/)*[^/]*/20[12][0-9]/sections_[^/]*\\.txt') ORDER BY 1 LIMIT 200")
def glob_match(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "loaded_documents").filter(F.col("source").rlike(files.glob_regex("**/*/20[12][0-9]/sections_*.txt"))).select(F.col("source").alias("path")).orderBy("path").limit(files.LIST_CAP)


@query("SELECT name, type, CASE WHEN type = 'file' THEN size END AS size FROM (SELECT split_part(source[13:], '/', 1) AS name, CASE WHEN bool_or(contains(source[13:], '/')) THEN 'dir' ELSE 'file' END AS type, max(size_bytes) AS size FROM loaded_documents WHERE starts_with(source, 'library/raw/') GROUP BY 1) ORDER BY name LIMIT 200")
def fs_ls(spark: SparkSession, d: str) -> DataFrame:
    return files.listed(table(spark, d, "loaded_documents").select(F.col("source").alias("path"), F.col("size_bytes").alias("size")), "library/raw")


@query("SELECT load_id, lower(regexp_extract(filename, '[^.](\\.[^.]+)$', 1)) AS suffix, lower(regexp_extract(filename, '[^.](\\.[^.]+)$', 1)) IN ('', '.csv', '.json', '.jsonl', '.md', '.txt', '.tsv', '.yaml', '.yml') AS artifact_text, lower(regexp_extract(filename, '[^.](\\.[^.]+)$', 1)) IN ('.html', '.json', '.md', '.txt', '.csv', '.xml', '.jsonl') AS fs_text FROM loaded_documents")
def text_suffix(spark: SparkSession, d: str) -> DataFrame:
    f = F.col("filename")
    return table(spark, d, "loaded_documents").select("load_id", files.suffix(f).alias("suffix"), files.is_text(f, True).alias("artifact_text"), files.is_text(f, False).alias("fs_text"))


@query("""SELECT load_id, source, CASE lower(regexp_extract(source, '[^.](\\.[^.]+)$', 1)) WHEN '.html' THEN 'html' WHEN '.htm' THEN 'html' WHEN '.md' THEN 'markdown' WHEN '.markdown' THEN 'markdown'
  WHEN '.json' THEN 'json' WHEN '.jsonl' THEN 'json' WHEN '.txt' THEN 'text' WHEN '.pdf' THEN 'pdf' END AS loader FROM loaded_documents""")
def loader_routing(spark: SparkSession, d: str) -> DataFrame:
    return ingestion.routed(table(spark, d, "loaded_documents").select("load_id", "source"))


@query("SELECT load_id, nullif(upper(regexp_extract(source, '([A-Za-z]+)/((?:19|20)\\d\\d)/[^/]+$', 1)), '') AS ticker, nullif(regexp_extract(source, '([A-Za-z]+)/((?:19|20)\\d\\d)/[^/]+$', 2), '') AS year FROM loaded_documents")
def source_identity(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "loaded_documents").select("load_id", *ingestion.identity(F.col("source")))


@query("""SELECT load_id, section, epoch_us(fetched_at) AS fetched_us, ticker, year FROM (SELECT load_id, section, fetched_at, upper(regexp_extract(source, '([A-Za-z]+)/((?:19|20)\\d\\d)/[^/]+$', 1)) AS ticker, regexp_extract(source, '([A-Za-z]+)/((?:19|20)\\d\\d)/[^/]+$', 2) AS year,
  row_number() OVER (PARTITION BY upper(regexp_extract(source, '([A-Za-z]+)/((?:19|20)\\d\\d)/[^/]+$', 1)), regexp_extract(source, '([A-Za-z]+)/((?:19|20)\\d\\d)/[^/]+$', 2), section ORDER BY fetched_at, load_id) AS k FROM loaded_documents WHERE coalesce(status_code, 200) = 200 AND source IS NOT NULL) WHERE k = 1""")
def first_filing(spark: SparkSession, d: str) -> DataFrame:
    first = ingestion.newest_per_entity(table(spark, d, "loaded_documents"))
    return first.select("load_id", "section", F.unix_micros("fetched_at").alias("fetched_us"), "ticker", "year")


@query(r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\r\n|[\n\r\x{0b}\x{0c}\x{1c}\x{1d}\x{1e}\x{85}\x{2028}\x{2029}]'), lambda l: regexp_matches(l, '[^\s\x{1c}-\x{1f}\x{85}\p{Z}]')))::INT AS line_count FROM documents WHERE text IS NOT NULL")
def jsonl_line_count(spark: SparkSession, d: str) -> DataFrame:
    full = F.filter(X.lines(F.col("text")), lambda x: X.stripped(x) != "")
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.size(full).alias("line_count"))


@query("SELECT load_id, json_object('filename', filename, 'format', coalesce(format, 'unknown'), 'loader', 'binary')::VARCHAR AS meta FROM loaded_documents")
def source_meta(spark: SparkSession, d: str) -> DataFrame:
    """Loader metadata with what an extractor adds winning over it."""
    own = F.create_map(F.lit("filename"), F.col("filename"), F.lit("format"), F.lit("unknown"), F.lit("loader"), F.lit("binary"))
    added = F.map_filter(F.create_map(F.lit("format"), F.col("format")), lambda k, v: v.isNotNull())
    merged = F.map_concat(F.map_filter(own, lambda k, v: ~F.array_contains(F.map_keys(added), k)), added)
    ordered = F.struct(*(F.element_at(merged, k).alias(k) for k in ("filename", "format", "loader")))
    return table(spark, d, "loaded_documents").select("load_id", F.to_json(ordered, {"ignoreNullFields": "false"}).alias("meta"))


_CLAIMS = r"""
(SELECT doc_id, pos, regexp_extract(w, '^[$₹€£]?(-?\d{1,3}(?:,\d{3})+(?:\.\d+)?|-?\d+(?:\.\d+)?)((?i)trillion|billion|million|thousand|bn|mn|[kmbt])?%?$', 1) AS num, lower(regexp_extract(w, '^[$₹€£]?(-?\d{1,3}(?:,\d{3})+(?:\.\d+)?|-?\d+(?:\.\d+)?)((?i)trillion|billion|million|thousand|bn|mn|[kmbt])?%?$', 2)) AS scale
 FROM (SELECT doc_id, trim(x, '()[]{}"''.,;:!?–—-*_`#~') AS w, pos FROM (SELECT doc_id, unnest(ws) AS x, unnest(range(len(ws))) AS pos FROM (SELECT doc_id, regexp_split_to_array(regexp_replace(text, '(?:19|20)\d{2}\s*[-/‒-―]\s*\d{2,4}', ' ', 'g'), '[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]+') AS ws FROM documents WHERE text IS NOT NULL)))
 WHERE regexp_full_match(w, '[$₹€£]?(-?\d{1,3}(?:,\d{3})+(?:\.\d+)?|-?\d+(?:\.\d+)?)((?i)trillion|billion|million|thousand|bn|mn|[kmbt])?%?'))"""


@query(f"""SELECT doc_id, count(*)::INT AS claims, round(sum(v), 3) AS total FROM (SELECT doc_id, replace(num, ',', '')::DOUBLE * CASE WHEN scale IN ('k', 'thousand') THEN 1e3 WHEN scale IN ('m', 'mn', 'million') THEN 1e6 WHEN scale IN ('b', 'bn', 'billion') THEN 1e9 WHEN scale IN ('t', 'trillion') THEN 1e12 ELSE 1 END AS v
FROM {_CLAIMS} WHERE NOT (scale = '' AND NOT contains(num, '.') AND replace(num, ',', '')::DOUBLE BETWEEN 1900 AND 2099)) GROUP BY doc_id""")
def numeric_claims(spark: SparkSession, d: str) -> DataFrame:
    c = spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", X.numeric_claims(F.col("text")).alias("c")).filter(F.size("c") > 0)
    return c.select("doc_id", F.size("c").alias("claims"), F.round(F.aggregate("c", F.lit(0.0), lambda a, x: a + x), 3).alias("total"))


@query("SELECT doc_id, CASE WHEN length(text) > 5000 THEN text[1:5000] ELSE text END AS text, length(text) > 5000 AS truncated, CASE WHEN length(text) > 20000 THEN 'error' WHEN length(text) > 5000 THEN 'warn' ELSE 'ok' END AS verdict FROM documents WHERE text IS NOT NULL")
def overflow_guard(spark: SparkSession, d: str) -> DataFrame:
    n = F.length("text")
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.when(n > 5000, F.substring("text", 1, 5000)).otherwise(F.col("text")).alias("text"), (n > 5000).alias("truncated"), F.when(n > 20000, "error").when(n > 5000, "warn").otherwise("ok").alias("verdict"))


@query("""WITH s AS (SELECT DISTINCT section FROM documents WHERE section IS NOT NULL), r AS (SELECT section, name, max_chars, row_number() OVER (PARTITION BY section ORDER BY (name = section) DESC, length(name) DESC) AS k FROM s JOIN section_specs ON name = section OR (name LIKE '%*' AND starts_with(section, name[1:length(name) - 1])))
SELECT doc_id, CASE WHEN length(text) > max_chars THEN text[1:max_chars] ELSE text END AS text, coalesce(length(text) > max_chars, false) AS cut FROM documents LEFT JOIN (SELECT * FROM r WHERE k = 1) USING (section) WHERE text IS NOT NULL""")
def enforce_max_chars(spark: SparkSession, d: str) -> DataFrame:
    docs, specs = table(spark, d, "documents").filter("text is not null"), table(spark, d, "section_specs")
    limit = ingestion.resolved_sections(docs, specs).join(specs.select(F.col("name").alias("spec"), "max_chars"), "spec")
    over = F.coalesce(F.length("text") > F.col("max_chars"), F.lit(False))
    return docs.join(limit, "section", "left").select("doc_id", F.when(over, F.expr("substring(text, 1, max_chars)")).otherwise(F.col("text")).alias("text"), over.alias("cut"))


@query(r"""WITH RECURSIVE p AS (SELECT doc_id, list_filter(list_transform(string_split(replace(text, E'\n\n', E'\f'), E'\f'), lambda x: regexp_replace(x, '^[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]+|[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]+$', '', 'g')), lambda x: x <> '') AS pages FROM documents WHERE text IS NOT NULL),
f AS (SELECT doc_id, pages, 1 AS i, 1 AS chunk, length(pages[1]) AS n FROM p WHERE len(pages) > 0
  UNION ALL SELECT doc_id, pages, i + 1, CASE WHEN n + length(pages[i + 1]) <= 800 THEN chunk ELSE chunk + 1 END, CASE WHEN n + length(pages[i + 1]) <= 800 THEN n + length(pages[i + 1]) ELSE length(pages[i + 1]) END FROM f WHERE i < len(pages))
SELECT doc_id, (chunk - 1)::INT AS chunk, md5(string_agg(pages[i], E'\n\n' ORDER BY i)) AS digest FROM f GROUP BY doc_id, chunk""")
def page_packing(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs as pages, packed into chunks of up to 800 characters."""
    docs = table(spark, d, "documents").filter("text is not null").withColumn("pages", F.replace("text", F.lit("\n\n"), F.lit("\f")))
    return docs.select("doc_id", F.posexplode(X.packed_pages(F.col("pages"), 800)).alias("chunk", "body")).select("doc_id", "chunk", F.md5("body").alias("digest"))


@query(r"""WITH t AS (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 2000, 0) + 1, 500)) AS s FROM documents WHERE length(text) > 2000)
SELECT doc_id, max_by(s, n * 1000000 - s)::INT AS start FROM (SELECT doc_id, s, len(regexp_extract_all(text[s + 1:s + 2000], '\d[\d,.]*')) AS n FROM t) GROUP BY doc_id""")
def densest_window(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("length(text) > 2000").select("doc_id", X.densest_window(F.col("text"), r"\d[\d,.]*", 2000, 500).alias("start"))


@query(r"""SELECT action_id, regexp_replace(CASE WHEN regexp_matches(text, '(?s)^\s*```(?:json)?\s*\n(.+?)\n?```\s*$') THEN regexp_extract(text, '(?s)^\s*```(?:json)?\s*\n(.*?)\n?```\s*$', 1) ELSE text END, '^[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]+|[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]+$', '', 'g') AS body FROM model_actions WHERE text IS NOT NULL""")
def fenced_json(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "model_actions").filter("text is not null").select("action_id", X.fenced_json(F.col("text")).alias("body"))


_SCRUB = [r"\b\d{3}-\d{2}-\d{4}\b", r"[\w.+-]+@[\w-]+\.[\w.]+"]


@query(r"SELECT row_id, regexp_replace(regexp_replace(query, '\b\d{3}-\d{2}-\d{4}\b', '[REDACTED]', 'g'), '[\w.+-]+@[\w-]+\.[\w.]+', '[REDACTED]', 'g') AS query FROM agent_events WHERE type = 'user_query'")
def pattern_scrub(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "agent_events").filter("type = 'user_query'").select("row_id", X.scrubbed(F.col("query"), _SCRUB).alias("query"))


@query("SELECT load_id, sha256(raw) AS source_hash, sha256(raw) || ':1:' || sha256('extract sections'::BLOB) AS cache_key FROM loaded_documents")
def source_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "loaded_documents").select("load_id", ingestion.source_hash(F.col("raw")).alias("source_hash"), ingestion.cache_key(F.col("raw"), "1", "extract sections").alias("cache_key"))


def _first_half(rows: DataFrame, time: str) -> DataFrame:
    """The rows of the first half of the time that the table covers."""
    middle = rows.agg(((F.unix_micros(F.min(time)) + F.unix_micros(F.max(time))) / 2).alias("_middle"))
    return rows.join(F.broadcast(middle), F.unix_micros(time) < F.col("_middle")).drop("_middle")  # one row


@query("""WITH k AS (SELECT load_id, source, sha256(raw) AS cache_key, epoch_us(fetched_at) AS t FROM loaded_documents), m AS (SELECT (min(t) + max(t)) / 2 AS middle FROM k)
SELECT load_id FROM k WHERE NOT EXISTS (SELECT 1 FROM k old, m WHERE old.t < m.middle AND old.source = k.source AND old.cache_key = k.cache_key)""")
def idempotent_skip(spark: SparkSession, d: str) -> DataFrame:
    """Loads left to do, when those of the first half of the time have been compiled."""
    k = table(spark, d, "loaded_documents").select("load_id", "source", ingestion.source_hash(F.col("raw")).alias("cache_key"), "fetched_at")
    return ingestion.not_yet_extracted(k, _first_half(k, "fetched_at"), ["source"]).select("load_id")


@query("""WITH c AS (SELECT doc_id, sha256(text || chr(0) || 'map prompt' || chr(0) || 'v1') AS key, epoch_us(written_at) AS t FROM documents WHERE text IS NOT NULL), m AS (SELECT (min(t) + max(t)) / 2 AS middle FROM c)
SELECT c.doc_id, c.key, EXISTS (SELECT 1 FROM c old, m WHERE old.t < m.middle AND old.key = c.key) AS hit FROM c""")
def cache_hit_miss(spark: SparkSession, d: str) -> DataFrame:
    """Texts against a cache that those of the first half of the time have filled; equal texts hit as well."""
    c = table(spark, d, "documents").filter("text is not null").select("doc_id", ingestion.chunk_key(F.col("text"), "map prompt", "v1").alias("key"), "written_at")
    return ingestion.cache_probe(c, _first_half(c, "written_at")).select("doc_id", "key", "hit")


_SPEC = "(SELECT section, name AS spec, max_chars FROM (SELECT s.section, name, max_chars, row_number() OVER (PARTITION BY s.section ORDER BY (name = s.section) DESC, length(name) DESC) AS k FROM (SELECT DISTINCT section FROM documents WHERE section IS NOT NULL) s JOIN section_specs ON name = s.section OR (name LIKE '%*' AND starts_with(s.section, name[1:length(name) - 1]))) WHERE k = 1)"


@query(f"SELECT s.section, spec FROM (SELECT DISTINCT section FROM documents WHERE section IS NOT NULL) s LEFT JOIN {_SPEC} USING (section)")
def section_lookup(spark: SparkSession, d: str) -> DataFrame:
    return ingestion.resolved_sections(table(spark, d, "documents"), table(spark, d, "section_specs"))


_VALID = f"""(SELECT doc_id, entity_id, version, section, spec, concat_ws('; ', CASE WHEN coalesce(entity_id, '') = '' OR regexp_matches(entity_id, '[/\\\\]') THEN 'identifier entity_id' END, CASE WHEN coalesce(version, '') = '' OR regexp_matches(version, '[/\\\\]') THEN 'identifier version' END,
  CASE WHEN section IS NULL THEN 'no section' END, CASE WHEN section IS NOT NULL AND spec IS NULL THEN 'unknown section' END, CASE WHEN text IS NULL THEN 'content is null' END,
  CASE WHEN length(text) > max_chars THEN 'length ' || length(text) || ' exceeds max_chars=' || max_chars END) AS errors FROM documents LEFT JOIN {_SPEC} s USING (section))"""


@query(f"SELECT * FROM {_VALID}")
def validate_artifacts(spark: SparkSession, d: str) -> DataFrame:
    return ingestion.validated(table(spark, d, "documents"), table(spark, d, "section_specs"))


@query("SELECT e.entity_id, e.version, s.name AS section FROM (SELECT DISTINCT entity_id, version FROM documents WHERE entity_id IS NOT NULL AND version IS NOT NULL) e, section_specs s WHERE s.required AND NOT s.name LIKE '%*' AND NOT EXISTS (SELECT 1 FROM documents d WHERE d.entity_id = e.entity_id AND d.version = e.version AND d.section = s.name)")
def missing_required(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("version is not null")
    return ingestion.missing_required(docs, table(spark, d, "section_specs"))


@query(f"""SELECT count(*) FILTER (errors = '') AS succeeded, count(*) FILTER (errors <> '') AS failed, 0::BIGINT AS skipped, coalesce(sum(length(text) // 4) FILTER (errors = ''), 0)::BIGINT AS tokens,
  round(coalesce(sum(length(text) // 4) FILTER (errors = ''), 0) * 2.0::DOUBLE / 1e6, 6) AS cost, (epoch_us(max(written_at)) - epoch_us(min(written_at))) / 1e6::DOUBLE AS seconds FROM {_VALID} JOIN documents USING (doc_id)""")
def ingest_report(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    v = ingestion.validated(docs, table(spark, d, "section_specs")).join(docs.select("doc_id", "written_at", F.floor(F.length("text") / 4).alias("n")), "doc_id")
    tokens = F.when(F.col("errors") == "", F.col("n"))
    return ingestion.report(v.select(F.when(F.col("errors") == "", "succeeded").otherwise("failed").alias("status"), tokens.alias("tokens"), (tokens * 2.0 / 1e6).alias("cost"), F.col("written_at").alias("started"), F.col("written_at").alias("ended")))


@query(f"SELECT doc_id, errors AS message, 'SchemaValidationError' AS error_type, 'dead_letter/' || doc_id AS folder FROM {_VALID} WHERE errors <> ''")
def dead_letters(spark: SparkSession, d: str) -> DataFrame:
    v = ingestion.validated(table(spark, d, "documents"), table(spark, d, "section_specs")).filter("errors != ''")
    return v.select("doc_id", F.col("errors").alias("message"), F.lit("SchemaValidationError").alias("error_type"), F.concat(F.lit("dead_letter/"), "doc_id").alias("folder"))


_SIDE = "(SELECT entity_id || '/' || version AS id, entity_id, version, string_agg(text, E'\\n\\n' ORDER BY coalesce(section, ''), doc_id) AS text, string_agg(coalesce(section, ''), ',' ORDER BY coalesce(section, ''), doc_id) AS sections, coalesce(min(source) FILTER (source <> ''), '') AS source FROM {} WHERE entity_id IS NOT NULL AND version IS NOT NULL AND text IS NOT NULL GROUP BY entity_id, version)"


def _flat(entries: DataFrame) -> DataFrame:
    """Search entries with plain columns, for comparison."""
    names = F.array_join(F.transform("sections", lambda x: x["name"]), ",")
    return entries.select("id", F.col("identifiers")["entity_id"].alias("entity_id"), F.col("identifiers")["version"].alias("version"), "text", names.alias("sections"), "source")


@query(f"SELECT * FROM {_SIDE.format('documents')}")
def sidecar_entries(spark: SparkSession, d: str) -> DataFrame:
    return _flat(ingestion.sidecar_entries(table(spark, d, "documents")))


@query(f"WITH o AS (SELECT * FROM {_SIDE.format('documents')}), n AS (SELECT * FROM {_SIDE.format("(SELECT * FROM documents WHERE section LIKE 'sections/%')")}) SELECT * FROM n UNION ALL SELECT * FROM o WHERE id NOT IN (SELECT id FROM n)")
def sidecar_upsert(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return _flat(ingestion.upserted(ingestion.sidecar_entries(docs), ingestion.sidecar_entries(docs.filter("section like 'sections/%'"))))


@query(r"""SELECT entity_id, section, count(*) AS fragments, md5(string_agg(t, E'\n\n---\n\n' ORDER BY doc_id)) AS digest FROM (SELECT entity_id, section, doc_id, regexp_replace(text, '^[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]+|[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]+$', '', 'g') AS t FROM documents WHERE entity_id IS NOT NULL AND (section IN (SELECT name FROM section_specs) OR EXISTS (SELECT 1 FROM section_specs s WHERE s.name LIKE '%*' AND starts_with(section, s.name[1:length(s.name) - 1])))) WHERE t <> '' GROUP BY 1, 2""")
def fragments_per_section(spark: SparkSession, d: str) -> DataFrame:
    """The fragments of sections that a spec knows; names that none knows are dropped."""
    docs = table(spark, d, "documents").filter("entity_id is not null")
    known = ingestion.resolved_sections(docs, table(spark, d, "section_specs")).filter("spec is not null").select("section")
    docs = docs.join(known, "section", "left_semi")
    return ingestion.ordered_fragments(docs, ["entity_id", "section"], "doc_id", "text").select("entity_id", "section", "fragments", F.md5("joined").alias("digest"))


@query("SELECT doc_id, CASE WHEN n < 1000 THEN n || 'B' WHEN n < 1000000 THEN ((n * 10 + 500) // 1000) // 10 || '.' || ((n * 10 + 500) // 1000) % 10 || 'k' ELSE ((n * 10 + 500000) // 1000000) // 10 || '.' || ((n * 10 + 500000) // 1000000) % 10 || 'M' END AS size FROM (SELECT doc_id, octet_length(encode(text)) AS n FROM documents WHERE text IS NOT NULL)")
def size_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("text is not null").select("doc_id", X.size_label(F.octet_length("text")).alias("size"))


@query()
def html_to_text(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "loaded_documents").filter("format = 'html' and raw is not null")
    return pages.select("load_id", markup.shown(decoded(F.col("raw"), F.col("content_type"))).alias("text"))


@query("""SELECT load_id, CASE WHEN status_code = 429 THEN 'RateLimitError' WHEN status_code IN (401, 403) THEN 'AuthError' WHEN status_code >= 500 OR status_code = 408 THEN 'TransientError' WHEN status_code >= 400 THEN 'ModelError' END AS error_type,
  CASE WHEN status_code >= 400 THEN status_code = 429 OR status_code = 408 OR status_code >= 500 END AS recoverable FROM loaded_documents""")
def fetch_errors(spark: SparkSession, d: str) -> DataFrame:
    e = extraction.error_of(F.col("status_code"))
    return table(spark, d, "loaded_documents").select("load_id", e["error_type"].alias("error_type"), e["recoverable"].alias("recoverable"))


@query(f"SELECT section, sum(len(regexp_extract_all(coalesce(text, ''), {_TOK}, 1)))::BIGINT AS words, sum(ceil(length(coalesce(text, '')) / 4))::BIGINT AS quarters FROM documents GROUP BY section")
def section_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Tokens by section under two counters."""
    text = F.coalesce("text", F.lit(""))
    return spread(table(spark, d, "documents").select("section", text.alias("text"))).groupBy("section").agg(F.sum(extraction.words_as_tokens(F.col("text"))).alias("words"), F.sum(extraction.quarters_as_tokens(F.col("text"))).alias("quarters"))


@query()
def densest_slices(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("text is not null").select("doc_id", markup.densest(F.col("text"), r"(?i)note \d+|revenue|umsatz", 400).alias("slice"))


@query()
def model_boundary(spark: SparkSession, d: str) -> DataFrame:
    return ingestion.extracted(table(spark, d, "documents"))


@query("SELECT doc_id, 'raw/' || entity_id || '/' || version || '.txt' AS path FROM documents WHERE entity_id IS NOT NULL AND version IS NOT NULL")
def template_paths(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("entity_id is not null and version is not null")
    return docs.select("doc_id", artifacts.template_path("raw/{entity_id}/{version}.txt", {"entity_id": F.col("entity_id"), "version": F.col("version")}).alias("path"))


@query()
def map_reduce(spark: SparkSession, d: str) -> DataFrame:
    return artifacts.map_reduced(table(spark, d, "documents"), ingestion.stub_adapter, max_chars=2000)
