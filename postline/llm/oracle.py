"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

_AZ, _az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP1 = """
WITH own AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
sized AS (SELECT page_id, url, strlen(html) AS payload_bytes, sha1(html) AS payload_digest FROM own),
first AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM sized),
told AS (SELECT *, payload_bytes >= 1000 AND page_id <> first_id AS visits FROM first)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN visits THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN visits THEN first_id END AS refers_to, regexp_replace(url, '[\\x00-\\x20\\x7f]', '%20', 'g') AS url, CAST(1 AS INTEGER) AS n_requests
FROM told
"""

OP12 = f"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS every FROM documents),
lines AS (SELECT doc_id, unnest(every) AS line, unnest(range(len(every))) AS pos FROM docs),
keyed AS (SELECT doc_id, line, pos, translate(trim(line, {_BLANK}), '{_AZ}', '{_az}') AS k FROM lines),
common AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10),
told AS (SELECT doc_id, line, pos, k IN (SELECT k FROM common) AS goes FROM keyed)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (goes) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT goes), '')) AS kept_sha256
FROM told GROUP BY doc_id
"""


def op11(k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, salt: str = "2:") -> str:
    """k-means by joins, a group of CTEs for each round."""
    parts = [
        f"""kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"entry AS MATERIALIZED (SELECT vec_id, unnest(q) AS v, unnest(range({dim})) AS d FROM kept)",
        f"""first AS (SELECT row_number() OVER (ORDER BY sha256('{salt}' || vec_id), q) - 1 AS c, q FROM kept
  ORDER BY sha256('{salt}' || vec_id), q LIMIT {k})""",
        f"c0 AS MATERIALIZED (SELECT c, unnest(q) AS v, unnest(range({dim})) AS d FROM first)",
    ]
    for r in range(rounds + 1):
        parts.append(f"""home{r} AS MATERIALIZED (
  SELECT vec_id, c, d2 FROM (SELECT e.vec_id, m.c, sum((e.v - m.v) * (e.v - m.v)) AS d2 FROM entry e JOIN c{r} m ON e.d = m.d GROUP BY e.vec_id, m.c)
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d2, c) = 1)""")
        if r < rounds:
            parts.append(f"""sum{r} AS (SELECT h.c, e.d, sum(e.v) AS s, count(*) AS n FROM home{r} h JOIN entry e ON h.vec_id = e.vec_id GROUP BY h.c, e.d)""")
            parts.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT m.c, m.d, CASE WHEN s.n IS NULL THEN m.v ELSE CAST((s.s - ((s.s % s.n) + s.n) % s.n) // s.n AS BIGINT) END AS v
  FROM c{r} m LEFT JOIN sum{r} s ON m.c = s.c AND m.d = s.d)""")
    parts.append(f"digest AS (SELECT c, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM c{rounds} GROUP BY c)")
    return f"""WITH {", ".join(parts)}
SELECT h.vec_id, CAST(h.c AS INTEGER) AS cluster, CAST(h.d2 AS BIGINT) AS distance,
       CAST(sum(h.d2) OVER (PARTITION BY h.c) AS BIGINT) AS cluster_inertia, CAST(sum(h.d2) OVER () AS BIGINT) AS inertia, g.centroid_sha256
FROM home{rounds} h JOIN digest g ON h.c = g.c"""


QUERIES: dict[str, str] = {"op1_warc": OP1, "op11_simplex": op11(), "op12_lines": OP12}
