"""Queries on pairs once more in DuckDB's SQL: all pairs and walks, which small tables allow."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"


def _components(nodes: str, links: str) -> str:
    """The smallest node that each node reaches."""
    return f"""
walk(x, y) AS (SELECT x, x FROM {nodes} UNION SELECT w.x, l.y FROM walk w JOIN {links} l ON l.x = w.y),
part AS (SELECT x, min(y) AS component_id FROM walk GROUP BY 1)"""


def jaccard_sql(width: int, percent: int) -> str:
    """Documents linked by shingles of ``width`` words at a similarity of ``percent`` or more."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '{WORD}') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + {width}], ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - {width - 1}, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
met AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT x, y FROM met JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
  WHERE 100 * shared >= {percent} * (nx.n + ny.n - shared)),
nodes AS (SELECT doc_id AS x FROM documents WHERE doc_id IS NOT NULL),{_components("nodes", "links")}
SELECT x AS doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM part LEFT JOIN n ON n.doc_id = x"""


def near_vectors_sql(least: float) -> str:
    """Vectors of one label linked by a cosine of ``least`` or more."""
    return f"""
WITH RECURSIVE good AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= {least}),
nodes AS (SELECT DISTINCT vec_id AS x FROM embeddings),{_components("nodes", "links")}
SELECT x AS vec_id, (SELECT count(*) FROM links WHERE links.x = part.x) AS n_links, component_id, x = component_id AS kept FROM part"""
