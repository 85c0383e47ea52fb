"""SQL of those queries of this subpackage that SQL can express."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{N}]+')"
#: distinct texts of 300 characters and more, their windows, those that several texts have
_WINDOWS = """t AS (SELECT DISTINCT text, hash(text) AS h FROM documents WHERE length(text) >= 300),
 w AS (SELECT h, k - 1 AS pos, hash(substr(text, k, 300)) AS x FROM (SELECT h, text, unnest(generate_series(1, length(text) - 299)) AS k FROM t)),
 shared AS (SELECT x, count(*) AS n, hash(list_sort(list(h))) AS who FROM w GROUP BY x HAVING min(h) <> max(h)), s AS (SELECT w.*, n, who FROM w JOIN shared USING (x))"""
_SOURCE = r"regexp_replace(lower(trim(source)), '[^\p{L}\p{N}]+', '_', 'g')"


def _phrases(key: str, table: str) -> str:
    return f"(SELECT DISTINCT {key}, array_to_string(w[k:k + 11], ' ') AS phrase FROM (SELECT {key}, w, unnest(generate_series(1, len(w) - 11)) AS k FROM (SELECT {key}, {_WORDS} AS w FROM {table})))"


def oracle_sql() -> dict[str, str]:
    """Name to SQL."""
    return {
        "p2_found": "SELECT DISTINCT chunk_id FROM chunks JOIN chunk_configs USING (config_id) WHERE length(trim(content, ' ' || chr(9) || chr(13) || chr(10) || chr(12))) > max_characters",
        "p8_found": f"SELECT DISTINCT d.doc_id, i.item_id FROM {_phrases('doc_id', 'documents')} d JOIN {_phrases('item_id', 'eval_items')} i ON d.phrase = i.phrase",
        # the outcome is the same under any size that grows with the text
        "p9_found": f"""SELECT m.source FROM mix_sources m LEFT JOIN (SELECT {_SOURCE} AS source, sum(length(text)) AS n FROM documents GROUP BY 1) s ON m.source = s.source
 WHERE m.max_repeats * coalesce(s.n, 0) < m.target_share * (SELECT sum(length(text)) FROM documents)""",
        "p9_planned_characters": f"""WITH d AS (SELECT {_SOURCE} AS source, coalesce(length(text), 0) AS n FROM (SELECT DISTINCT doc_id, text, source FROM documents)),
 b AS (SELECT sum(n) AS total, CAST(ceil(sum(n) / 10000.0) AS BIGINT) AS block FROM d), seats AS (SELECT CAST(ceil(total / block::DOUBLE) AS BIGINT) AS k, block, total FROM b),
 s AS (SELECT m.source, m.target_share, m.max_repeats, coalesce(x.n, 0) AS n FROM mix_sources m LEFT JOIN (SELECT source, sum(n) AS n FROM d GROUP BY 1) x USING (source)),
 q AS (SELECT source, CASE WHEN j = 0 THEN target_share ELSE target_share / (2 * j + 1) END AS quotient FROM (SELECT source, target_share, unnest(generate_series(0, CAST(least(k, n * max_repeats // block) AS BIGINT) - 1)) AS j FROM s, seats WHERE target_share > 0)),
 won AS (SELECT source, count(*) AS seats FROM (SELECT source, row_number() OVER (ORDER BY quotient DESC, source) AS place FROM q) WHERE place <= (SELECT k FROM seats) GROUP BY 1)
 SELECT s.source, CAST(s.n AS BIGINT) AS n_chars, CAST(coalesce(won.seats, 0) * block AS BIGINT) AS quota_chars, s.n * s.max_repeats >= s.target_share * total AS reachable FROM s LEFT JOIN won USING (source), seats""",
        "p10_spans": f"""WITH {_WINDOWS}, f AS (SELECT *, coalesce(lag(who) OVER r <> who OR lag(pos) OVER r <> pos - 1, true) AS begins FROM s WINDOW r AS (PARTITION BY h ORDER BY pos)),
 g AS (SELECT *, sum(CAST(begins OR x IN (SELECT x FROM f WHERE begins) AS INT)) OVER (PARTITION BY h ORDER BY pos) AS run FROM f)
 SELECT doc_id, CAST(min(pos) AS INT) AS start, CAST(count(*) + 299 AS INT) AS length, min_by(n, pos) AS n_places FROM g JOIN (SELECT DISTINCT doc_id, hash(text) AS h FROM documents) USING (h) GROUP BY doc_id, h, run""",
        "p10_coverage": f"""WITH {_WINDOWS}, c AS (SELECT h, sum(new) AS covered FROM (SELECT h, least(300, coalesce(pos - lag(pos) OVER (PARTITION BY h ORDER BY pos), 300)) AS new FROM s) GROUP BY h),
 d AS (SELECT DISTINCT doc_id, CASE WHEN text <> '' THEN text END AS text FROM documents), m AS (SELECT text, count(*) AS n FROM d WHERE text IS NOT NULL GROUP BY text)
 SELECT doc_id, n_copies, n_chars, shared_chars, CASE WHEN n_chars > 0 THEN shared_chars / n_chars::DOUBLE END AS share FROM (SELECT doc_id, coalesce(m.n, 1) AS n_copies, CAST(coalesce(length(d.text), 0) AS INT) AS n_chars,
 CAST(CASE WHEN m.n > 1 AND length(d.text) >= 300 THEN length(d.text) ELSE coalesce(covered, 0) END AS BIGINT) AS shared_chars FROM d LEFT JOIN m ON d.text = m.text LEFT JOIN c ON c.h = hash(d.text))""",
        "p10_found": """WITH t AS (SELECT DISTINCT text, hash(text) AS h FROM documents WHERE length(text) >= 300), w AS (SELECT DISTINCT h, hash(substr(text, k, 300)) AS x FROM (SELECT h, text, unnest(generate_series(1, length(text) - 299)) AS k FROM t)),
 shared AS (SELECT x FROM w GROUP BY x HAVING count(*) > 1), s AS (SELECT w.* FROM w JOIN shared USING (x)), p AS (SELECT DISTINCT a.h AS g, b.h AS h FROM s a JOIN s b ON a.x = b.x UNION SELECT h, h FROM t),
 m AS (SELECT DISTINCT doc_id, hash(text) AS h FROM documents WHERE length(text) >= 300)
 SELECT DISTINCT least(a.doc_id, b.doc_id) AS doc_id_a, greatest(a.doc_id, b.doc_id) AS doc_id_b FROM p JOIN m a ON a.h = p.g JOIN m b ON b.h = p.h WHERE a.doc_id <> b.doc_id""",
    }
