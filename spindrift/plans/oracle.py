"""DuckDB SQL for the queries of the registry."""

from __future__ import annotations

from spindrift.plans import documents, evaluation, events

_FAMILIES = r"""
cur AS (
  SELECT id, parent FROM (
    SELECT regexp_replace(session_id, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS id,
           nullif(regexp_replace(parent_id, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), '') AS parent,
           row_number() OVER (PARTITION BY regexp_replace(session_id, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')
             ORDER BY try_cast(last_updated AS timestamptz) DESC NULLS LAST, coalesce(schema_version, -1) DESC, coalesce(event_count, -1) DESC, coalesce(parent_id, '') DESC) AS k
    FROM session_meta WHERE session_id IS NOT NULL) WHERE k = 1 AND id <> ''),
link AS (SELECT c.id, p.id AS parent FROM cur c LEFT JOIN cur p ON c.parent = p.id),
up AS (SELECT id, parent AS anc FROM link WHERE parent IS NOT NULL
       UNION SELECT up.id, link.parent FROM up JOIN link ON up.anc = link.id WHERE link.parent IS NOT NULL),
loops AS (SELECT id FROM up WHERE id = anc),
ring AS (SELECT id, min(anc) AS root FROM up WHERE anc IN (SELECT id FROM loops) GROUP BY id),
tops AS (SELECT up.id, max(up.anc) FILTER (link.parent IS NULL) AS root, count(*) AS depth FROM up JOIN link ON up.anc = link.id GROUP BY up.id),
node AS (
  SELECT link.id, link.parent, coalesce(ring.root, tops.root, link.id) AS root, CASE WHEN ring.root IS NOT NULL THEN -1 ELSE coalesce(tops.depth, 0) END AS depth
  FROM link LEFT JOIN ring ON ring.id = link.id LEFT JOIN tops ON tops.id = link.id)
"""

# Nodes with the size of their subtree (none on a cycle) and, outside cycles, their path from the root.
_WHOLE = r"""
below AS (SELECT anc AS id, count(*) AS n FROM up GROUP BY anc),
steps AS (SELECT up.id, list(up.anc ORDER BY a.depth) AS p FROM up JOIN node a ON a.id = up.anc JOIN node b ON b.id = up.id WHERE b.depth > 0 GROUP BY up.id),
whole AS (
  SELECT node.*, CASE WHEN node.id NOT IN (SELECT id FROM loops) THEN coalesce(below.n, 0) + 1 END AS subtree,
         CASE WHEN depth >= 0 THEN list_append(coalesce(steps.p, []), node.id) END AS path
  FROM node LEFT JOIN below ON below.id = node.id LEFT JOIN steps ON steps.id = node.id)
"""

ORACLE = {
    "p3_families": f"""WITH RECURSIVE {_FAMILIES}, {_WHOLE}
SELECT id AS session_id, root AS root_id, CAST(depth AS INT) AS depth, subtree, depth < 0 AS cyclic, array_to_string(path, ' > ') AS path FROM whole""",
    "p3_intervals": f"""WITH RECURSIVE {_FAMILIES}, {_WHOLE}
SELECT id AS session_id, root, CAST(depth AS INT) AS depth, row_number() OVER (ORDER BY path) - 1 AS first, row_number() OVER (ORDER BY path) - 2 + subtree AS last FROM whole WHERE depth >= 0""",
    "fork_tree": f"""WITH RECURSIVE {_FAMILIES}, {_WHOLE}
SELECT whole.id, whole.parent, root, CAST(depth AS INT) AS depth, subtree, concat_ws(' ', coalesce(c.created, ''), whole.id) AS sibling
FROM whole JOIN (SELECT regexp_replace(session_id, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') AS id, min(created) AS created FROM session_meta GROUP BY 1) c ON c.id = whole.id""",
    "p3_found": f"WITH RECURSIVE {_FAMILIES} SELECT id AS session_id, root AS root_id, CAST(depth AS INT) AS depth FROM node WHERE parent IS NOT NULL",
    "p3_descendants": f"""WITH RECURSIVE {_FAMILIES}
SELECT up.anc AS ancestor, up.id AS descendant, CAST(b.depth - a.depth AS INT) AS distance
FROM up JOIN node a ON a.id = up.anc JOIN node b ON b.id = up.id WHERE b.depth >= 0""",
} | documents.ORACLE | events.ORACLE | evaluation.ORACLE
