"""The query catalogue of the core: name -> (spark, folder) -> DataFrame, and the equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.common import table
from strataflow.operators import drift, nested, rejects, spikes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, query: Query, sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"{name} is registered twice")
    QUERIES[name] = query
    if sql is not None:
        ORACLE[name] = sql


def _files(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "result_files", "file_id", "series", "file_date", "content")


def _lines(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "layout_lines", "line_id", "file_name", "line_no", "raw")


def _runs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "agent_runs", "run_id", "parts", "answer")


register("p1_found", lambda s, d: drift.changes(_files(s, d)))
register("p1_records", lambda s, d: drift.unified(_files(s, d)))


def _fields(sep: str) -> str:
    """The seven fields of a record as a list, by one pattern over the whole record."""
    field = f'("(?:[^"]|"")*"|[^"{sep}]*)'
    return "[" + ", ".join(f"regexp_extract(x, '^{sep.join([field] * 7)}$', {k})" for k in range(1, 8)) + "]"


def _quoted(sep: str) -> str:
    field = f'(?:"(?:[^"]|"")*"|[^"{sep}]*)'
    return f"regexp_matches(x, '^{field}(?:{sep}{field})*$')"


_HEADER = "['plate', 'well', 'format', 'sample', 'compound', 'dose', 'unit']"
_TRIMMED = "regexp_replace(f, '^\\s+|\\s+$', '', 'g')"
_SEPARATORS = {",": ",", ";": ";", "\t": "chr(9)"}
_SEP = lambda f: "CASE sep " + " ".join(f"WHEN {repr(k) if k != chr(9) else 'chr(9)'} THEN {f(k)}" for k in (",", ";", "\t")) + " END"
#: Every record with its separator, its seven fields where there are seven, and the first reason to reject it.
LAYOUTS = f"""WITH h AS (SELECT file_name, min(substr(regexp_replace(trim(raw), '^"?plate"?', ''), 1, 1)) AS sep FROM layout_lines WHERE line_no = 1 AND lower(raw) LIKE '%plate%' GROUP BY 1),
l AS (SELECT DISTINCT line_id, file_name, line_no, sep, regexp_replace(regexp_replace(raw, '\\n$', ''), '\\r$', '') AS x FROM layout_lines JOIN h USING (file_name) WHERE raw IS NOT NULL),
q AS (SELECT *, {_SEP(_quoted)} AS quoted, length(regexp_replace(x, '"(?:[^"]|"")*"', '', 'g')) - length(replace(regexp_replace(x, '"(?:[^"]|"")*"', '', 'g'), sep, '')) + 1 AS n FROM l WHERE regexp_replace(x, '\\s', '', 'g') <> ''),
f AS (SELECT *, CASE WHEN quoted AND n = 7 THEN list_transform({_SEP(_fields)}, lambda g: regexp_replace(CASE WHEN length(g) >= 2 AND g[1] = '"' THEN replace(g[2:-2], '""', '"') ELSE g END, '^\\s+|\\s+$', '', 'g')) END AS g FROM q),
w AS (SELECT *, upper(g[2]) AS u, CASE g[3] WHEN '96' THEN 8 WHEN '384' THEN 16 WHEN '1536' THEN 32 END AS rows, CASE g[3] WHEN '96' THEN 12 WHEN '384' THEN 24 WHEN '1536' THEN 48 END AS columns FROM f WHERE g IS NULL OR list_transform(g, lambda y: lower(y)) <> {_HEADER}),
a AS (SELECT *, CASE WHEN regexp_full_match(u, '[A-Z]{{1,2}}[ _-]?[0-9]+') THEN CASE WHEN regexp_matches(u, '^[A-Z]{{2}}') THEN (ascii(u) - 64) * 26 + ascii(u[2]) - 64 ELSE ascii(u) - 64 END
  WHEN regexp_full_match(u, 'R[0-9]+C[0-9]+') THEN TRY_CAST(regexp_extract(u, 'R([0-9]+)C', 1) AS HUGEINT) END AS r, TRY_CAST(regexp_extract(u, '([0-9]+)$', 1) AS HUGEINT) AS c FROM w),
v AS (SELECT *, CASE WHEN NOT quoted THEN 'quoting' WHEN n <> 7 THEN 'columns'
  WHEN g[1] = '' OR rows IS NULL OR r IS NULL OR r < 1 OR r > rows OR c < 1 OR c > columns THEN 'value'
  WHEN g[6] <> '' AND NOT regexp_full_match(g[6], CASE sep WHEN ';' THEN '\\+?([0-9]+[.,]?[0-9]*|[.,][0-9]+)([eE][+-]?[0-9]+)?' ELSE '\\+?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?' END) THEN 'value' END AS reason FROM a)
"""
register("p2_found", lambda s, d: rejects.rejects(_lines(s, d)), LAYOUTS + "SELECT line_id, reason FROM v WHERE reason IS NOT NULL")
register("p2_rows", lambda s, d: rejects.valid_rows(_lines(s, d)),
    LAYOUTS + "SELECT line_id, file_name, line_no, g[1] AS plate, g[2] AS well, CAST(r AS INT) AS well_row, CAST(c AS INT) AS well_column, CAST(g[3] AS INT) AS format, nullif(g[4], '') AS sample, nullif(g[5], '') AS compound, CAST(nullif(replace(g[6], ',', '.'), '') AS DOUBLE) AS dose, nullif(g[7], '') AS unit FROM v WHERE reason IS NULL")
register("p5_found", lambda s, d: spikes.faults(table(s, d, "qc_readings"), table(s, d, "detectors")))

_PART = "(SELECT DISTINCT ON (run_id) run_id, parts FROM agent_runs)"
_PARTS = f"(SELECT run_id, unnest(range(len(parts))) AS i, unnest(parts) AS p FROM {_PART})"
_CHECKS = f"(SELECT run_id, i, unnest(range(len(p.checks))) AS j, unnest(p.checks) AS c FROM {_PARTS} WHERE p IS NOT NULL)"
_EVIDENCE = f"(SELECT run_id, i, j, unnest(range(len(c.evidence))) AS k, unnest(c.evidence) AS e FROM {_CHECKS} WHERE c IS NOT NULL)"
register(
    "p4_parts",
    lambda s, d: nested.typed_tables(_runs(s, d))["part"].select("run_id", "path", "name", "weight", "score", "detail"),
    f"SELECT run_id, 'parts/' || i AS path, p.name AS name, p.weight AS weight, p.score AS score, p.detail AS detail FROM {_PARTS} WHERE p IS NOT NULL",
)
register(
    "p4_checks",
    lambda s, d: nested.typed_tables(_runs(s, d))["check"].select("run_id", "path", "name", "passed"),
    f"SELECT run_id, 'parts/' || i || '/checks/' || j AS path, c.name AS name, c.passed AS passed FROM {_CHECKS} WHERE c IS NOT NULL",
)
register(
    "p4_evidence",
    lambda s, d: nested.typed_tables(_runs(s, d))["evidence"].select("run_id", "path", "gate", "sample", "count"),
    f"SELECT run_id, 'parts/' || i || '/checks/' || j || '/evidence/' || k AS path, e.gate AS gate, e.sample AS sample, e.count AS count FROM {_EVIDENCE} WHERE e IS NOT NULL",
)
# Answers by recursion: texts that hold JSON are unwrapped first, then every member and element is a node.
_NODES = """WITH RECURSIVE t AS (SELECT run_id, CAST(answer AS VARCHAR) AS x FROM (SELECT DISTINCT ON (run_id) run_id, answer FROM agent_runs) WHERE json_valid(answer)
 UNION ALL SELECT run_id, x->>'$' FROM t WHERE json_valid(x) AND json_type(x) = 'VARCHAR'),
n AS (SELECT run_id, 'answer' AS path, '' AS parent_path, '' AS step, CAST(x AS JSON) AS v FROM t WHERE json_valid(x) AND json_type(x) IN ('OBJECT', 'ARRAY')
 UNION ALL SELECT run_id, path || '/' || k, path, k, v->('/' || replace(replace(k, '~', '~0'), '/', '~1')) FROM (SELECT run_id, path, v, unnest(CASE json_type(v) WHEN 'OBJECT' THEN list_distinct(json_keys(v)) WHEN 'ARRAY' THEN list_transform(range(json_array_length(v)::BIGINT), lambda i: CAST(i AS VARCHAR)) END) AS k FROM n WHERE json_type(v) IN ('OBJECT', 'ARRAY'))),
a AS (SELECT * FROM n WHERE step <> '' OR path <> 'answer')
"""
_REAL = "json_type(v) <> 'NULL'"
register(
    "p4_found",
    lambda s, d: nested.items(_runs(s, d)),
    f"{_NODES} SELECT run_id, path, parent_path FROM a WHERE {_REAL} UNION ALL SELECT run_id, 'parts/' || i, '' FROM {_PARTS} WHERE p IS NOT NULL UNION ALL SELECT run_id, 'parts/' || i || '/checks/' || j, 'parts/' || i FROM {_CHECKS} WHERE c IS NOT NULL UNION ALL SELECT run_id, 'parts/' || i || '/checks/' || j || '/evidence/' || k, 'parts/' || i || '/checks/' || j FROM {_EVIDENCE} WHERE e IS NOT NULL",
)
register(
    "p4_answers",
    lambda s, d: nested.typed_tables(_runs(s, d))["answer"].select("run_id", "path", "kind", F.when(F.col("value").rlike(r"^-?[0-9][0-9.eE+-]*$"), F.round(F.col("value").try_cast("double"), 6).cast("string")).otherwise(F.col("value")).alias("value")),
    f"{_NODES} SELECT run_id, path, CASE (SELECT json_type(p.v) FROM n p WHERE p.run_id = a.run_id AND p.path = a.parent_path) WHEN 'OBJECT' THEN 'member' ELSE 'element' END AS kind, CASE WHEN json_type(v) IN ('OBJECT', 'ARRAY') THEN NULL WHEN regexp_matches(v->>'$', '^-?[0-9][0-9.eE+-]*$') THEN CAST(round(TRY_CAST(v->>'$' AS DOUBLE), 6) AS VARCHAR) ELSE v->>'$' END AS value FROM a WHERE {_REAL}",
)
