"""SQL of those queries that SQL can express on whole tables."""

from __future__ import annotations

_TERMS = """
WITH texts AS (SELECT 'memories' AS src, id::VARCHAR AS rec_key, content AS x FROM memories WHERE content IS NOT NULL
  UNION ALL SELECT 'tools', name, concat_ws(' ', name, description) FROM tools),
runs AS (SELECT src, row_number() OVER () AS n, rec_key, list_filter(regexp_extract_all(lower(x), '[a-z0-9_]+'), lambda w: length(w) >= 3 AND regexp_matches(w, '[a-z]')) AS terms FROM texts),
tf AS (SELECT src, n, rec_key, size, term, count(*) AS tf FROM (SELECT src, n, rec_key, len(terms) AS size, unnest(terms) AS term FROM runs) GROUP BY ALL),
df AS (SELECT src, term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY src, term),
total AS (SELECT src, sum(tf) AS total FROM tf GROUP BY src)
"""


def oracle_sql() -> dict[str, str]:
    scored = "SELECT src, rec_key, term, tf, df, cf / total::DOUBLE AS c, (tf + 50 * (cf / total::DOUBLE)) / (size + 50::DOUBLE) AS p FROM tf JOIN df USING (src, term) JOIN total USING (src) WHERE df >= 2"
    return {
        "p7_round_trip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
        "p1_found": _TERMS + "SELECT src, rec_key, term FROM tf JOIN df USING (src, term) WHERE tf >= 3 AND df BETWEEN 2 AND 6",
        "p1_scores": _TERMS + f"SELECT src, rec_key, term, tf, df, round(p * ln(p / c), 6) AS score FROM ({scored})",
    }
