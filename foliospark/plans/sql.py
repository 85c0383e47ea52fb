"""SQL of the core's queries, for DuckDB over the same tables."""

from __future__ import annotations

from foliospark.functions.classify import DEFINITION, LATEX, MATH, MIME_TYPES, OPERATIVE, ROLES, SCHEDULE, SIGNATURE
from foliospark.functions.quality import BREADCRUMB, FUNCTION, ISOLATED, MALFORMED, NAVIGATION, PAGINATION, REPEATED, RULES, SCRIPT, STYLE, WIDE
from foliospark.functions.stopwords import SHORT_CODES, stopwords
from foliospark.sources.formats import REGISTRY

_B = r"[ \t\n\r\f\x0B]"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _count(c: str, p: str) -> str:
    return f"CAST(len(regexp_extract_all({c}, {_q(p)})) AS INT)"


def _trim(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^{_B}+', ''), '{_B}+$', '')"


def _bytes(c: str, p: str) -> str:
    return f"coalesce(list_sum(list_transform(regexp_extract_all({c}, {_q(p)}), lambda x: strlen(x))), 0)"


_WORDS = _count("text", r"[^ \t\n\r\f\x0B]+")
_LINES = f"CASE WHEN text IS NULL THEN NULL WHEN strlen(text) = 0 THEN 0 WHEN text LIKE '%' || chr(10) THEN {_count('text', chr(10))} ELSE {_count('text', chr(10))} + 1 END"
_SENTENCES = _count("text", r"[.!?][ \t\n\r\f]+[A-Z]")
_PARAGRAPHS = f"({_count('text', chr(10) + chr(10))} + 1)"
_STRUCTURE = f"""CASE WHEN text IS NULL THEN NULL WHEN {_WORDS} = 0 THEN 0 ELSE
 (CASE WHEN {_WORDS} * 1.0 / greatest({_SENTENCES}, 1) BETWEEN 10 AND 30 THEN 3 ELSE 0 END) + (CASE WHEN {_WORDS} * 1.0 / {_PARAGRAPHS} BETWEEN 50 AND 300 THEN 3 ELSE 0 END)
 + (CASE WHEN {_PARAGRAPHS} > 1 THEN 2 ELSE 0 END) + (CASE WHEN regexp_matches(text, '[.!?]') THEN 2 ELSE 0 END) END"""
_LINE_FREE = r"^\s*\|[|\-:\s]*\|\s*$|^\s*\|\s*$"
_OCR = r"\b[a-zA-Z]\s{2,}[a-zA-Z]\s{2,}[a-zA-Z]\b|[.]{3,}|[_]{3,}|\s[.,;:!?]\s|\b[a-zA-Z]+[0-9]+[a-zA-Z]+[a-zA-Z0-9]*\b|\s{3,}"
_EXTRACTIONS = """(SELECT extraction_id, content, file_path FROM (SELECT *, row_number() OVER (PARTITION BY extraction_id ORDER BY content DESC NULLS LAST, file_path DESC NULLS LAST) AS turn FROM extraction_results) WHERE turn = 1)"""
_TABLES = "(SELECT DISTINCT extraction_id || '-' || no AS table_id, t.cells AS cells FROM (SELECT extraction_id, unnest(tables) AS t, generate_subscripts(tables, 1) - 1 AS no FROM extraction_results))"
_PAGES = f"""(SELECT extraction_id AS id, k + 1 AS page_number, byte_start, byte_start + strlen(pages[k + 1]) AS byte_end, pages[k + 1] AS text FROM (
  SELECT extraction_id, pages, k, CAST(coalesce(list_sum(list_transform(pages[1:k], lambda p: strlen(p) + 1)), 0) AS BIGINT) AS byte_start
  FROM (SELECT extraction_id, pages, unnest(generate_series(0, len(pages) - 1)) AS k FROM (SELECT extraction_id, string_split(content, chr(12)) AS pages FROM {_EXTRACTIONS} WHERE content IS NOT NULL))))"""
_CHUNKED = "(SELECT extraction_id, string_agg(content, chr(10) ORDER BY chunk_id) AS content FROM (SELECT DISTINCT extraction_id, chunk_id, content FROM chunks) GROUP BY 1)"
_OF_CHUNKED = f"(SELECT extraction_id, content FROM {_EXTRACTIONS} WHERE extraction_id IN (SELECT extraction_id FROM chunks))"
#: boxes of the scanned lines
_BOXES = """(SELECT *, CASE WHEN geometry.left IS NOT NULL THEN geometry.left ELSE list_min(list_transform(geometry.points, lambda p: p.x)) END::DOUBLE AS x0,
 CASE WHEN geometry.left IS NOT NULL THEN geometry.top ELSE list_min(list_transform(geometry.points, lambda p: p.y)) END::DOUBLE AS y0,
 CASE WHEN geometry.left IS NOT NULL THEN geometry.left + geometry.width ELSE list_max(list_transform(geometry.points, lambda p: p.x)) END::DOUBLE AS x1,
 CASE WHEN geometry.left IS NOT NULL THEN geometry.top + geometry.height ELSE list_max(list_transform(geometry.points, lambda p: p.y)) END::DOUBLE AS y1 FROM ocr_elements)"""
#: what the pages of the HTML queries are made of
_MADE = "(SELECT doc_id, doc_id % 3 AS kind, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents WHERE text IS NOT NULL)"
_SCAN_LINES = "(SELECT extraction_id, {first} || string_agg({line}, {glue} ORDER BY element_id) AS text FROM (SELECT DISTINCT extraction_id, element_id, coalesce(text, '') AS t FROM ocr_elements) GROUP BY 1)"
_SAFE = "replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def _tokens(source: str) -> str:
    plain = f"lower(regexp_replace(coalesce(content, ''), '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'))"
    parts = f"string_split(regexp_replace({plain}, '[^\\p{{L}}\\p{{N}}.,]+', ' ', 'g'), ' ')"
    clean = "regexp_replace(regexp_replace(w, '^[.,]+', ''), '[.,]+$', '')"
    return f"""(SELECT id, CASE WHEN regexp_matches(t, '^[0-9]{{1,15}}$') THEN CAST(CAST(t AS BIGINT) AS VARCHAR) ELSE t END AS token, count(*) AS n
 FROM (SELECT id, {clean} AS t FROM (SELECT extraction_id AS id, unnest({parts}) AS w FROM {source})) WHERE t <> '' GROUP BY 1, 2)"""


_BOTH = f"SELECT coalesce(a.id, b.id) AS id, coalesce(a.token, b.token) AS token, coalesce(a.n, 0) AS x, coalesce(b.n, 0) AS y FROM {_tokens(_CHUNKED)} a FULL JOIN {_tokens(_OF_CHUNKED)} b ON a.id = b.id AND a.token = b.token"


def _any(c: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, {_q(w)})" for w in words) + ")"


def _hits(c: str, words: list[str]) -> str:
    return "(" + " + ".join(f"CAST(contains({c}, {_q(w)}) AS INT)" for w in words) + ")"


def _classify() -> str:
    schedule = " OR ".join(f"starts_with(first, {_q(k)})" for k in SCHEDULE)
    for k in SCHEDULE:
        rest = f"substr(low, strpos(low, {_q(k)}) + {len(k)})"
        schedule += f" OR (strpos(low, {_q(k)}) > 0 AND regexp_matches({rest}, '^[ ]\\s*[\\p{{L}}\\p{{N}}]'))"
    party = f"strlen(x) <= 120 AND regexp_matches(x, '^\\p{{Lu}}') AND (regexp_matches(x, '[0-9]') OR contains(x, ',') OR {_any('lower(x)', ROLES)})"
    lines = lambda c: f"(CASE WHEN {c} = '' THEN [] ELSE string_split_regex(regexp_replace({c}, '\\r?\\n$', ''), '\\r?\\n') END)"
    return f"""WITH a AS (SELECT DISTINCT chunk_id, content, {_trim('content')} AS text FROM chunks),
b AS (SELECT *, lower(text) AS low, {lines('text')} AS ls, {lines('content')} AS raw FROM a),
c AS (SELECT *, lower(coalesce(ls[1], '')) AS first, {_trim("coalesce(ls[2], '')")} AS under, list_filter(raw, lambda x: {_trim('x')} <> '') AS filled,
 list_filter(list_transform(ls, lambda x: {_trim('x')}), lambda x: x <> '') AS rows FROM b)
SELECT DISTINCT chunk_id, CASE WHEN content IS NULL THEN NULL
 WHEN starts_with(text, '#') OR regexp_matches(under, '^(=+|-+)$') THEN 'heading'
 WHEN starts_with(content, '```') OR starts_with(content, '~~~') OR (len(raw) >= 2 AND len(list_filter(filled, lambda x: starts_with(x, '    ') OR starts_with(x, chr(9)))) = len(filled)) THEN 'code_block'
 WHEN len(ls) >= 2 AND (len(list_filter(ls, lambda x: contains(x, '|'))) >= 2 OR len(list_filter(ls, lambda x: regexp_matches({_trim('x')}, '^[-+| ]{{4,}}$'))) >= 3) THEN 'table_like'
 WHEN regexp_matches(text, '{MATH}') OR {_any('low', LATEX)} THEN 'formula'
 WHEN {schedule} THEN 'schedule'
 WHEN {_any('low', DEFINITION)} THEN 'definitions'
 WHEN {_hits('low', SIGNATURE)} >= 2 THEN 'signature_block'
 WHEN {_hits('low', OPERATIVE)} >= 3 THEN 'operative_clause'
 WHEN len(rows) >= 3 AND len(list_filter(rows, lambda x: {party})) >= greatest(len(rows) * 2 // 3, 2) THEN 'party_list'
 ELSE 'unknown' END AS kind FROM c"""


_STOP = "[" + ", ".join(_q(w) for w in stopwords("en")) + "]"
_LISTS = {c: "[" + ", ".join(_q(w) for w in stopwords(c)) + "]" for pair in SHORT_CODES.items() for c in pair}
_NAMES = [*((k, long) for long, short in SHORT_CODES.items() for k in (long, short)), ("rus", "rus"), ("ru", "rus"), ("zho", "zho"), ("zh", "zho")]
_CORE = "lower(regexp_replace(w, '[^\\p{L}]', '', 'g'))"
_KEEP = f"(strlen(w) > 1 AND regexp_matches(w, '^[\\x00-\\x60\\x7B-\\x7F]+$') AND NOT regexp_matches(w, '[a-z]')) OR regexp_matches(w, '[0-9]') OR strlen({_CORE}) <= 1 OR NOT list_contains({_STOP}, {_CORE})"
_LIGHT = _trim("regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '([!?.,])[!?.,]+', '\\1', 'g'), '<!--[^\\n]*?-->', '', 'g'), ' {2,}', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")
_KIND = r"CASE WHEN regexp_matches(line, '^\s*[-*•](\s|$)') THEN 'bullet' WHEN regexp_matches(line, '^\s*\d{1,2}\. ') THEN 'numbered' WHEN regexp_matches(line, '^\s*[A-Za-z]\. ') THEN 'lettered' WHEN regexp_matches(line, '^ {4}\s*\S') THEN 'indented' END"
_NAV = f"least(1.0, ({_bytes('text', NAVIGATION)} + {_bytes('text', BREADCRUMB)} + {_bytes('text', PAGINATION)}) / strlen(text)::DOUBLE)"
_DASH = f"coalesce(list_sum(list_transform(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, {_q(_LINE_FREE)}) AND contains(x, '---')), lambda x: {_bytes('x', '-{3,}')})), 0)"
_OCR_BYTES = f"CASE WHEN contains(text, '  ') OR contains(text, '...') THEN {_bytes('text', _OCR)} + {_DASH} ELSE 0 END"


_SCORE = f"""CASE WHEN text IS NULL OR {_trim('text')} = '' THEN 0.0 WHEN strlen(text) < 10 THEN 0.1 ELSE round(least(1.0, greatest(0.0,
 1.0 - 0.3 * least(1.0, ({_OCR_BYTES}) / strlen(text)::DOUBLE) + 0.2 * ({_STRUCTURE}) / 10 - CASE WHEN strlen(text) > 1000 THEN 0.1 * {_NAV} ELSE 0.0 END)), 6) END"""


def _clean() -> str:
    out = "text"
    for p in (SCRIPT, STYLE, FUNCTION, RULES):
        out = f"regexp_replace({out}, {_q(p)}, ' ', 'g')"
    out = rf"regexp_replace({out}, '\b([a-zA-Z])\s{{2,}}([a-zA-Z])\s{{2,}}([a-zA-Z])\b', '\1\2\3', 'g')"
    out = f"array_to_string(list_transform(string_split({out}, chr(10)), lambda x: CASE WHEN regexp_matches(x, {_q(_LINE_FREE)}) THEN x ELSE regexp_replace(x, '-{{3,}}', '...', 'g') END), chr(10))"
    for p, to in ((REPEATED, "..."), (ISOLATED, " "), (MALFORMED, " "), (WIDE, " "), (NAVIGATION, " "), (BREADCRUMB, " "), (PAGINATION, " ")):
        out = f"regexp_replace({out}, {_q(p)}, {_q(to)}, 'g')"
    return _trim(_SPACES.replace("text", out))


#: white space normal
_SPACES = r"""regexp_replace(regexp_replace(regexp_replace(text, '[ \t\f\r\x0B\x{00A0}\x{2000}-\x{200B}\x{3000}]+', ' ', 'g'), '\n\s*\n\s*\n+', chr(10) || chr(10), 'g'), '\n +', chr(10), 'g')"""


def _languages(where: str) -> str:
    """The light detector: the best language of each text, or null."""
    hits = [f"{{'score': len(list_filter(ws, lambda w: list_contains({_LISTS[short]}, w))) / greatest(len(ws), 1)::DOUBLE, 'code': {_q(code)}}}" for code, short in SHORT_CODES.items()]
    hits += [f"{{'score': len(regexp_extract_all(text, '[{block}]')) / greatest(len(regexp_extract_all(text, '\\p{{L}}')), 1)::DOUBLE, 'code': '{code}'}}" for code, block in (("rus", "Ѐ-ӿ"), ("zho", "一-鿿"))]
    return f"""(SELECT doc_id, lang, CASE WHEN s[1].score > 0.02 AND s[1].score / (s[1].score + s[2].score) >= 0.8 - 0.3 THEN s[1].code END AS found FROM (
 SELECT doc_id, lang, list_sort([{', '.join(hits)}], 'DESC') AS s FROM (SELECT *, list_filter(string_split_regex(lower(text), '[^\\p{{L}}]+'), lambda w: w <> '') AS ws FROM documents {where})))"""


def _member(j: str, name: str) -> str:
    """The first member that is not null whose key is ``name`` without case and separators."""
    keys = f"list_filter(json_keys({j}), lambda k: regexp_replace(lower(k), '[^a-z0-9]', '', 'g') = '{name}')"
    return f"list_filter(list_transform({keys}, lambda k: json_extract({j}, '$.\"' || k || '\"')), lambda v: json_type(v) <> 'NULL')[1]"


def _str(j: str, name: str) -> str:
    return f"json_extract_string({_member(j, name)}, '$')"


def _objects(x: str) -> str:
    return f"list_filter(CASE json_type({x}) WHEN 'ARRAY' THEN json_extract({x}, '$[*]') WHEN 'OBJECT' THEN [{x}] ELSE [] END, lambda y: json_type(y) = 'OBJECT')"


#: every result of every archive with its path
_RESULTS = f"""WITH RECURSIVE r AS (SELECT archive_id, '' AS path, CAST(payload AS JSON) AS j FROM (SELECT DISTINCT archive_id, payload FROM archive_records) WHERE json_valid(payload)
 UNION ALL SELECT archive_id, CASE WHEN path = '' THEN '' ELSE path || '/' END || no, CASE WHEN json_type(res) = 'VARCHAR' THEN CAST(json_extract_string(res, '$') AS JSON) ELSE res END
 FROM (SELECT archive_id, path, no, json_extract(child, '$.result') AS res FROM (SELECT archive_id, path, unnest(cs) AS child, generate_subscripts(cs, 1) - 1 AS no FROM (
 SELECT archive_id, path, {_objects("json_extract(j, '$.children')")} AS cs FROM r)))
 WHERE json_type(res) = 'OBJECT' OR (json_type(res) = 'VARCHAR' AND json_valid(json_extract_string(res, '$'))))"""


def _of(slot: str) -> str:
    """The objects of one slot of all results."""
    return f"""{_RESULTS}, x AS (SELECT archive_id AS record_id, path AS parent_path, CAST(no AS BIGINT) AS item_no, x FROM (SELECT archive_id, path, unnest(xs) AS x, generate_subscripts(xs, 1) - 1 AS no FROM (
 SELECT archive_id, path, {_objects(f"json_extract(j, '$.{slot}')")} AS xs FROM r)))"""


def _gfm_row(i: str) -> str:
    return f"('| ' || array_to_string(list_transform(generate_series(1, width), lambda j: replace(coalesce(cells[{i}][j], ''), '|', '\\|')), ' | ') || ' |')"


def oracle_sql() -> dict[str, str]:
    """Name to SQL."""
    unit = "(SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings)"
    f1 = lambda s, x, y: f"CASE WHEN {x} + {y} = 0 THEN 1.0 ELSE 2.0 * {s} / ({x} + {y}) END"
    return {
        "doc_stats": f"SELECT lang, count(*) AS n_docs, sum({_WORDS}) AS n_words, sum({_LINES}) AS n_lines, sum(strlen(text)) AS n_bytes FROM documents GROUP BY lang",
        "text_stats": f"SELECT doc_id, {_LINES} AS n_lines, {_WORDS} AS n_words, strlen(text) AS n_bytes FROM documents",
        "text_confidence": f"""SELECT doc_id, CASE WHEN text IS NULL THEN NULL WHEN strlen(text) = 0 THEN 0.0 ELSE round(least(1.0, greatest(0.0, {_count('text', r'[!-~ \t\n\r\f]')} / strlen(text)::DOUBLE
 - ({_count('text', '�+')} + {_count('text', r'[\x00-\x08\x0E-\x1F\x7F]')} * 2) / strlen(text)::DOUBLE - CASE WHEN {_count('text', '[Ѐ-ӿ]{2,}')} > strlen(text) * 0.1 THEN 0.3 ELSE 0.0 END)), 6) END AS confidence FROM documents""",
        "fix_mojibake": "SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g'), '�+', '', 'g'), '[\\x{0300}-\\x{036F}]', '', 'g') AS fixed FROM documents",
        "normalize_spaces": f"""SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda p: array_to_string(list_filter(list_transform(string_split(p, chr(10)),
 lambda x: {_trim("regexp_replace(x, '[ \\t\\f\\r\\x0B]+', ' ', 'g')")}), lambda x: x <> ''), chr(10))), lambda p: p <> ''), chr(10) || chr(10)) AS normal FROM documents""",
        "nfc_normalize": "SELECT doc_id, nfc_normalize(text) AS normal FROM documents",
        "blank_pages": f"SELECT doc_id, true AS is_blank FROM documents WHERE length(regexp_replace(text, '{_B}', '', 'g')) < 3",
        "char_entropy": """SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE round(coalesce(e.entropy, 0.0), 5) END AS entropy FROM documents d LEFT JOIN (
 SELECT doc_id, least(5.0, sum(-(n / total) * log2(n / total))) AS entropy FROM (SELECT doc_id, c, count(*)::DOUBLE AS n, sum(count(*)) OVER (PARTITION BY doc_id)::DOUBLE AS total
 FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '(?s).')) AS c FROM documents) GROUP BY doc_id, c) GROUP BY doc_id) e ON d.doc_id = e.doc_id""",
        "quality_components": f"SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE {_OCR_BYTES} END AS ocr_bytes, CASE WHEN text IS NULL THEN NULL WHEN strlen(text) = 0 THEN 0.0 ELSE round({_NAV}, 6) END AS navigation, {_SENTENCES} AS sentences, {_PARAGRAPHS} AS paragraphs, {_STRUCTURE} AS structure FROM documents",
        "quality_score": f"SELECT doc_id, {_SCORE} AS score FROM documents",
        "collapse_punctuation": "SELECT doc_id, regexp_replace(text, '([!?.,])[!?.,]+', '\\1', 'g') AS collapsed FROM documents",
        "reduce_light": f"SELECT doc_id, {_LIGHT} AS reduced FROM documents",
        "remove_stopwords": f"SELECT doc_id, array_to_string(list_filter(list_filter(string_split_regex(text, '{_B}+'), lambda w: w <> ''), lambda w: {_KEEP}), ' ') AS reduced FROM documents",
        "mime_by_extension": f"""SELECT e.extraction_id, m.mime FROM {_EXTRACTIONS} e LEFT JOIN (VALUES {', '.join(f'({_q(k)}, {_q(v)})' for k, v in MIME_TYPES.items())}) m(ext, mime)
 ON lower(regexp_extract(e.file_path, '\\.([^./\\\\]+)$', 1)) = m.ext""",
        "chunk_fixed_window": """SELECT id, CAST(k AS INT) AS chunk_index, substr(t, k * 800 + 1, 1000) AS content FROM (SELECT doc_id AS id, text AS t, unnest(generate_series(0, greatest(0, CAST(ceil((length(text) - 200) / 800.0) AS INT) - 1))) AS k
 FROM documents WHERE length(text) > 0)""",
        "chunk_classify": _classify(),
        "chunk_page_overlap": f"""SELECT c.extraction_id, c.chunk_id, min(CASE WHEN c.byte_start < p.byte_end AND c.byte_end > p.byte_start THEN p.page_number END) AS first_page,
 max(CASE WHEN c.byte_start < p.byte_end AND c.byte_end > p.byte_start THEN p.page_number END) AS last_page
 FROM (SELECT DISTINCT chunk_id, extraction_id, metadata.byte_start AS byte_start, metadata.byte_end AS byte_end FROM chunks) c LEFT JOIN {_PAGES} p ON c.extraction_id = p.id GROUP BY 1, 2""",
        "document_pages": f"SELECT id, page_number, byte_start, byte_end, text FROM {_PAGES}",
        "keywords_rake": f"""WITH lists(code, stop) AS (VALUES {', '.join(f"({_q(c)}, {_LISTS[c]})" for c in _LISTS)}),
 t AS (SELECT doc_id AS id, coalesce(l.stop, {_STOP}) AS stops, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}} ]') AS ws FROM documents LEFT JOIN lists l ON l.code = string_split(replace(lower(trim(lang)), '_', '-'), '-')[1] WHERE {_WORDS} >= 10),
 parts AS (SELECT id, stops, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM t),
 runs AS (SELECT *, sum(CAST(stop AS INT)) OVER (PARTITION BY id ORDER BY pos) AS run FROM (SELECT *, NOT regexp_matches(w, '^[\\p{{L}}\\p{{N}}]+$') OR list_contains(stops, w) AS stop FROM parts)),
 phrases AS (SELECT id, run, string_agg(w, ' ' ORDER BY pos) AS phrase, count(*) AS n FROM runs WHERE NOT stop GROUP BY id, run),
 words AS (SELECT id, w, sum(n)::DOUBLE / count(*) AS weight FROM (SELECT id, n, unnest(string_split(phrase, ' ')) AS w FROM phrases) GROUP BY id, w),
 kept AS (SELECT DISTINCT id, phrase FROM phrases WHERE n <= 3),
 scored AS (SELECT s.id, s.phrase, sum(words.weight) AS raw FROM (SELECT id, phrase, unnest(string_split(phrase, ' ')) AS w FROM kept) s JOIN words ON words.id = s.id AND words.w = s.w GROUP BY 1, 2),
 scaled AS (SELECT id, phrase, CASE WHEN max(raw) OVER d = min(raw) OVER d THEN 1.0 ELSE (raw - min(raw) OVER d) / (max(raw) OVER d - min(raw) OVER d) END AS score FROM scored WINDOW d AS (PARTITION BY id))
 SELECT id, phrase AS keyword, round(score, 9) AS score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, phrase) AS rank FROM scaled) WHERE rank <= 10""",
        "list_items": f"""SELECT * FROM (SELECT doc_id AS id, CAST(line_no - 1 AS INT) AS line_no, {_KIND} AS list_type, CAST(length(regexp_extract(line, '^( *)', 1)) // 2 AS INT) AS indent_level, line AS text
 FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)) WHERE list_type IS NOT NULL""",
        "html_title_meta": f"""SELECT doc_id, CASE kind WHEN 0 THEN 'Document ' WHEN 1 THEN 'R&D – ' ELSE 'Table ' END || doc_id AS title, CASE WHEN kind < 2 THEN source ELSE '' END AS description, CASE WHEN kind < 2 THEN lang ELSE '' END AS language FROM {_MADE}""",
        "html_links": f"""SELECT doc_id, l[1] AS uri, l[2] AS label, CASE WHEN starts_with(l[1], 'mailto:') THEN 'email' WHEN starts_with(l[1], '#') THEN 'anchor' ELSE 'hyperlink' END AS kind FROM (SELECT doc_id, unnest(CASE kind WHEN 0 THEN [['mailto:a@example.org', 'mail'], ['#top', 'top']]
 WHEN 1 THEN [['/files/' || doc_id || '.pdf?a=1&b=2', 'file']] ELSE [['http://example.org/' || doc_id, 'plain']] END) AS l FROM {_MADE})""",
        "html_tables": f"SELECT doc_id, CAST(row_no AS INT) AS row_no, row FROM (SELECT doc_id, unnest([0, 1]) AS row_no, unnest(['key|value', 'source|' || trim(source)]) AS row FROM {_MADE} WHERE kind = 2)",
        "json_text_fields": """SELECT event_id AS id, 'event_id: ' || event_id || CASE WHEN trim(event_type) <> '' THEN chr(10) || 'info.type: ' || event_type ELSE '' END || CASE WHEN value IS NULL THEN '' ELSE chr(10) || 'info.value: ' || value END || CASE WHEN user_id IS NULL THEN '' ELSE chr(10) || 'users[0].label: ' || user_id END AS content,
 concat_ws(chr(10), CASE WHEN trim(event_type) <> '' THEN 'info.type: ' || event_type END, 'users[0].label: ' || user_id) AS fields FROM events""",
        "table_markdown": f"""SELECT table_id, CASE WHEN cells IS NULL OR len(cells) = 0 THEN '' ELSE row(cells[1]) END AS markdown FROM {_TABLES}""".replace(
            "row(cells[1])",
            "'| ' || array_to_string(list_transform(cells[1], lambda x: coalesce(x, '')), ' | ') || ' |' || chr(10) || '|' || array_to_string(list_transform(cells[1], lambda x: '------'), '|') || '|' || chr(10) || "
            "array_to_string(list_transform(cells[2:], lambda r: '| ' || array_to_string(list_transform(generate_series(1, len(cells[1])), lambda k: coalesce(r[k], '')), ' | ') || ' |'), chr(10)) || CASE WHEN len(cells) > 1 THEN chr(10) ELSE '' END",
        ),
        "table_tsv": f"SELECT table_id, coalesce(array_to_string(list_transform(cells, lambda r: array_to_string(list_transform(r, lambda x: coalesce(x, '')), chr(9))), chr(10)), '') AS tsv FROM {_TABLES}",
        "cell_types": f"""SELECT id, column_no, CASE WHEN nn * 2 >= n THEN 'numeric' WHEN nd * 2 >= n THEN 'date' ELSE 'text' END AS kind FROM (SELECT id, column_no, count(*) AS n, sum(CAST(num AS INT)) AS nn, sum(CAST(NOT num AND dat AS INT)) AS nd FROM (
 SELECT table_id AS id, CAST(c - 1 AS INT) AS column_no, regexp_matches(trim(cell), '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') AS num,
 regexp_matches(trim(cell), '^\\d{{4}}-\\d{{2}}-\\d{{2}}|^\\d{{1,2}}/\\d{{1,2}}/\\d{{2,4}}|^\\d{{1,2}}\\.\\d{{1,2}}\\.\\d{{2,4}}') AS dat FROM (SELECT table_id, unnest(r) AS cell, generate_subscripts(r, 1) AS c FROM (SELECT table_id, unnest(cells[2:21]) AS r FROM {_TABLES})) WHERE trim(cell) <> '') GROUP BY 1, 2)""",
        "embedding_l2_normalize": f"SELECT id AS vec_id, round(v[1], 5) AS first, round(list_sum(list_transform(v, lambda x: x * x)), 5) AS norm FROM {unit}",
        "embedding_topk": f"""SELECT query_id, CAST(rank AS INT) AS rank, neighbour_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, neighbour_id) AS rank FROM (
 SELECT q.id AS query_id, r.id AS neighbour_id, round(list_dot_product(q.v, r.v), 6) AS similarity FROM {unit} q JOIN {unit} r ON q.id <> r.id WHERE q.id % 20 = 0)) WHERE rank <= 5""",
        "token_f1": f"""WITH s AS (SELECT id, sum(least(x, y)) AS s, sum(x) AS x, sum(y) AS y, sum(CASE WHEN num THEN least(x, y) ELSE 0 END) AS sn, sum(CASE WHEN num THEN x ELSE 0 END) AS xn, sum(CASE WHEN num THEN y ELSE 0 END) AS yn
 FROM (SELECT *, regexp_matches(token, '^[0-9][0-9.,]*$') AS num FROM ({_BOTH})) GROUP BY id), i AS (SELECT extraction_id AS id FROM {_CHUNKED} UNION SELECT extraction_id FROM {_OF_CHUNKED}),
 t AS (SELECT i.id, coalesce(s, 0) AS s, coalesce(x, 0) AS x, coalesce(y, 0) AS y, coalesce(sn, 0) AS sn, coalesce(xn, 0) AS xn, coalesce(yn, 0) AS yn FROM i LEFT JOIN s ON i.id = s.id)
 SELECT id, round(CASE WHEN x = 0 THEN CASE WHEN y = 0 THEN 1.0 ELSE 0.0 END ELSE s / x::DOUBLE END, 6) AS precision, round(CASE WHEN y = 0 THEN CASE WHEN x = 0 THEN 1.0 ELSE 0.0 END ELSE s / y::DOUBLE END, 6) AS recall,
 round({f1('s', 'x', 'y')}, 6) AS f1, round({f1('sn', 'xn', 'yn')}, 6) AS numeric_f1, round(CASE WHEN xn + yn = 0 THEN {f1('s', 'x', 'y')} ELSE 0.6 * ({f1('s', 'x', 'y')}) + 0.4 * ({f1('sn', 'xn', 'yn')}) END, 6) AS quality FROM t""",
        "token_difference": f"SELECT id, token, CASE WHEN y > x THEN 'missing' ELSE 'extra' END AS side, abs(x - y) AS n FROM ({_BOTH}) WHERE x <> y",
        "clean_text": f"SELECT doc_id, {_clean()} AS clean FROM documents",
        "language_detect": f"SELECT doc_id, found AS language FROM {_languages('')}",
        "language_accuracy": f"""SELECT label, count(*) AS n, count(found) AS n_detected, CAST(sum(CAST(label = found AS INT)) AS BIGINT) AS n_right FROM (SELECT found, CASE code {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in _NAMES)} END AS label
 FROM (SELECT found, string_split_regex(lower(trim(lang)), '[-_]')[1] AS code FROM {_languages('')})) GROUP BY label""",
        "chunk_json_sections": """SELECT event_id AS id, 0 AS chunk_index, 1 AS total_chunks, '# k' || chr(10) || chr(10) || json_extract_string(props, '$.k') AS content, 'heading' AS chunk_type FROM events WHERE trim(props) <> ''""",
        "pipeline_scores": f"""SELECT id, text AS content, {_SCORE} AS score, {_LIGHT} AS reduced FROM (SELECT doc_id AS id, nfc_normalize(text) AS text FROM documents)""",
        "pooled_embeddings": """SELECT extraction_id, round(coalesce(sum(CASE WHEN even THEN embedding[1] END), 0) / greatest(sum(CAST(even AS INT)), 1), 5) AS first, round(coalesce(sum(CASE WHEN even THEN embedding[64] END), 0) / greatest(sum(CAST(even AS INT)), 1), 5) AS last
 FROM (SELECT extraction_id, chunk_id % 2 = 0 AS even, embedding FROM chunks WHERE embedding IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chunk_id) = 1) GROUP BY extraction_id""",
        "pages_with_tables": f"""SELECT p.id, p.page_number, CAST(count(t.page_number) AS INT) AS n_tables FROM {_PAGES} p LEFT JOIN (SELECT DISTINCT extraction_id, no, t.page_number AS page_number FROM (SELECT extraction_id, unnest(tables) AS t, generate_subscripts(tables, 1) AS no FROM extraction_results)) t
 ON t.extraction_id = p.id AND t.page_number = p.page_number GROUP BY 1, 2""",
        "page_dpi": f"""SELECT extraction_id, page_number, CAST(greatest(72, least(300, floor(4096 / (greatest(max(x1), max(y1)) / 72.0)))) AS INT) AS dpi FROM {_BOXES} WHERE x0 IS NOT NULL GROUP BY 1, 2""",
        "heading_context": f"""WITH l AS (SELECT extraction_id AS id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM {_EXTRACTIONS}),
 f AS (SELECT *, sum(CAST(starts_with(line, '```') AS INT)) OVER (PARTITION BY id ORDER BY line_no) AS fences FROM l),
 v AS (SELECT *, CASE WHEN fences % 2 = 0 AND NOT starts_with(line, '```') THEN nullif(length(regexp_extract(line, '^(#{{1,6}})[ \\t]+[^ \\t\\r]', 1)), 0) END AS level, trim(regexp_replace(line, '^#+[ \\t]+|\\r$', '', 'g')) AS title FROM f),
 h AS (SELECT id, line_no, {', '.join(f"coalesce(max(CASE WHEN level = {k} THEN line_no END) OVER w, 0) AS n{k}, last_value(CASE WHEN level = {k} THEN title END IGNORE NULLS) OVER w AS t{k}" for k in range(1, 7))} FROM v WINDOW w AS (PARTITION BY id ORDER BY line_no ROWS UNBOUNDED PRECEDING))
 SELECT * FROM (SELECT id, CAST(line_no AS INT) AS line_no, concat_ws(' > ', {', '.join(f"CASE WHEN n{k} > greatest(0, {', '.join(f'n{j}' for j in range(1, k)) or '0'}) THEN t{k} END" for k in range(1, 7))}) AS context FROM h) WHERE context <> ''""",
        "nearest_band": f"""WITH e AS (SELECT DISTINCT extraction_id, page_number, element_id AS id, x0 FROM {_BOXES} WHERE x0 IS NOT NULL), b AS (SELECT extraction_id, page_number, min(x0) AS band FROM e GROUP BY extraction_id, page_number, floor(x0 / 50))
 SELECT extraction_id, page_number, id, band, distance FROM (SELECT e.*, band, abs(band - x0) AS distance, row_number() OVER (PARTITION BY extraction_id, page_number, id, x0 ORDER BY abs(band - x0), band) AS turn FROM e JOIN b USING (extraction_id, page_number)) WHERE turn = 1""",
        "extractor_choice": f"""WITH r(pattern, priority) AS (VALUES {', '.join(f'({_q(m)}, {p})' for m, of in REGISTRY.items() for p, _ in of)}), m AS (SELECT DISTINCT lower(trim(string_split(mime_type, ';')[1])) AS mime_type FROM extraction_results WHERE mime_type IS NOT NULL)
 SELECT mime_type, pattern, priority FROM (SELECT m.mime_type, r.pattern, r.priority, row_number() OVER (PARTITION BY m.mime_type ORDER BY r.pattern = m.mime_type DESC, priority DESC) AS turn FROM m LEFT JOIN r ON r.pattern = m.mime_type OR r.pattern = string_split(m.mime_type, '/')[1] || '/*') WHERE turn = 1""",
        "length_statistics": f"SELECT mime_type, count(n_chars) AS n, {', '.join(f'round(quantile_cont(n_chars, {q}), 6) AS p{int(q * 100)}' for q in (0.5, 0.95, 0.99))}, round(var_samp(n_chars), 4) AS variance, round(stddev_samp(n_chars), 6) AS deviation FROM documents GROUP BY mime_type",
        "lines_around": "SELECT element_id, round(avg(length(text)) OVER w, 6) AS mean_length, count(*) OVER w AS n FROM (SELECT DISTINCT extraction_id, element_id, text FROM ocr_elements) WINDOW w AS (PARTITION BY extraction_id ORDER BY element_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)",
        "text_inventory": f"""SELECT kind, count(*) AS n_rows, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM ({' UNION '.join(f"SELECT '{t}' AS kind, {i} AS id, {c} AS text FROM {t}" for t, i, c in (('documents', 'doc_id', 'text'), ('extraction_results', 'extraction_id', 'content'), ('chunks', 'chunk_id', 'content'), ('ocr_elements', 'element_id', 'text'), ('eval_items', 'item_id', 'text')))}) GROUP BY kind""",
        "unknown_collections": "SELECT collection_id FROM documents INTERSECT SELECT collection_id FROM extraction_results EXCEPT SELECT collection_id FROM collections",
        "stopword_ratio": f"SELECT doc_id, count(*) AS n_words, round(avg(CAST(list_contains({_STOP}, w) AS INT)), 9) AS ratio FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS w FROM documents) GROUP BY doc_id",
        "whitespace_forms": r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[ \t\f\r\x0B\x{00A0}\x{2000}-\x{200B}\x{3000}]+', ' ', 'g'), '\n\s*\n\s*\n+', chr(10) || chr(10), 'g'), '\n +', chr(10), 'g') AS whitespace,
 regexp_replace(regexp_replace(text, '[ \n]+', ' ', 'g'), '[\x00-\x08\x0A-\x1F]', '', 'g') AS inline, regexp_matches(text, '[一-鿿]') AS has_cjk, CASE WHEN text IS NULL THEN NULL ELSE true END AS is_valid FROM documents""",
        "key_case": """SELECT source, p[1] || array_to_string(list_transform(p[2:], lambda x: upper(x[1]) || x[2:]), '') AS camel, lower(regexp_replace(source, '([a-z0-9])([A-Z])', '\\1_\\2', 'g')) AS snake FROM (SELECT DISTINCT source, string_split(source, '_') AS p FROM documents WHERE source IS NOT NULL)""",
        "table_gfm": f"""SELECT table_id, CASE WHEN cells IS NULL OR len(cells) = 0 OR width = 0 THEN '' ELSE array_to_string(list_concat([line(1)], ['|' || repeat(' --- |', width)], list_transform(generate_series(2, len(cells)), lambda i: line(i))), chr(10)) END AS gfm FROM (SELECT *, list_max(list_transform(cells, lambda r: len(r))) AS width FROM {_TABLES})""".replace("line(1)", _gfm_row("1")).replace("line(i)", _gfm_row("i")),
        "table_grid": f"""SELECT table_id, CAST(i - 1 AS INT) AS row, CAST(j - 1 AS INT) AS "column", coalesce(text, '') AS text, i = 1 AS is_header FROM (SELECT table_id, i, unnest(r) AS text, generate_subscripts(r, 1) AS j FROM (SELECT table_id, unnest(cells) AS r, generate_subscripts(cells, 1) AS i FROM {_TABLES}))""",
        "ocr_words": f"""SELECT DISTINCT extraction_id, page_number, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text, CAST(x0 AS INT) AS "left", CAST(y0 AS INT) AS top, CAST(x1 - x0 AS INT) AS width, CAST(y1 - y0 AS INT) AS height, coalesce(confidence.recognition, -1.0) AS confidence FROM {_BOXES} WHERE x0 IS NOT NULL AND trim(text) <> ''""",
        "render_plain": "SELECT extraction_id, text FROM " + _SCAN_LINES.format(first="'Scan ' || extraction_id", line="CASE WHEN t <> '' THEN chr(10) || chr(10) || t ELSE '' END", glue="''"),
        "render_markdown": "SELECT extraction_id, text || chr(10) AS text FROM " + _SCAN_LINES.format(first="'# Scan ' || extraction_id", line="CASE WHEN t <> '' THEN chr(10) || chr(10) || t ELSE '' END", glue="''"),
        "render_djot": "SELECT extraction_id, replace(text || chr(10), chr(10) || '---' || chr(10), chr(10) || '* * *' || chr(10)) AS text FROM " + _SCAN_LINES.format(first="'# Scan ' || extraction_id", line="CASE WHEN t <> '' THEN chr(10) || chr(10) || t ELSE '' END", glue="''"),
        "render_html": "SELECT extraction_id, text FROM " + _SCAN_LINES.format(first="'<h1>Scan ' || extraction_id || '</h1>' || chr(10)", line=f"'<p>' || {_SAFE} || '</p>'", glue="chr(10)"),
        "csv_profile": """SELECT l_orderkey AS id, ',' AS delimiter, true AS has_header, CAST(count(*) + 1 AS INT) AS n_rows, 5 AS n_columns, 'numeric numeric numeric text date' AS types FROM lineitem GROUP BY l_orderkey""",
        "markdown_links": r"""SELECT doc_id, CAST(len(regexp_extract_all(regexp_replace(text, '(?ms)^```.*?^```[ \t]*\r?$', '', 'g'), '(?m)^#{1,6}[ \t]*([^\n]+)$')) AS INT) AS n_headers, CAST(len(regexp_extract_all(text, '\[([^\]]+)\]\(([^)]+)\)')) AS INT) AS n_links,
 CAST(len(regexp_extract_all(text, '(?ms)^```(\w*)[ \t]*\r?\n(.*?)^```[ \t]*\r?$')) AS INT) AS n_code FROM documents""",
        "exact_duplicates": "SELECT sha256(text) AS content_hash, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
        "merge_paragraphs": """SELECT doc, CAST(paragraph_no AS BIGINT) AS paragraph_no, string_agg(trim(t), ' ' ORDER BY o) AS text FROM (SELECT *, sum(new) OVER (PARTITION BY doc ORDER BY o) - 1 AS paragraph_no FROM (
 SELECT doc, o, t, CASE WHEN before IS NULL OR regexp_matches(before, '[.!?:]\\s*$') OR NOT regexp_matches(t, '^\\s*\\p{Ll}') THEN 1 ELSE 0 END AS new FROM (
 SELECT extraction_id AS doc, element_id AS o, text AS t, lag(text) OVER (PARTITION BY extraction_id ORDER BY element_id) AS before FROM ocr_elements WHERE trim(text) <> ''))) GROUP BY 1, 2""",
        "element_overlap": f"""WITH p AS (SELECT *, lag(x0) OVER w AS a0, lag(y0) OVER w AS b0, lag(x1) OVER w AS a1, lag(y1) OVER w AS b1 FROM (SELECT DISTINCT element_id, extraction_id, page_number, x0, y0, x1, y1 FROM {_BOXES}) WINDOW w AS (PARTITION BY extraction_id, page_number ORDER BY element_id)),
 q AS (SELECT *, greatest(least(x1, a1) - greatest(x0, a0), 0.0) * greatest(least(y1, b1) - greatest(y0, b0), 0.0) AS i, greatest(x1 - x0, 0) * greatest(y1 - y0, 0) AS own FROM p WHERE a0 IS NOT NULL AND x0 IS NOT NULL)
 SELECT element_id, CASE WHEN u > 0 THEN round(i / u, 6) ELSE 0.0 END AS iou, round(5.0 * abs((x0 + x1) / 2 - (a0 + a1) / 2) + abs((y0 + y1) / 2 - (b0 + b1) / 2), 6) AS distance, CASE WHEN own > 0 THEN round(i / own, 6) ELSE 0.0 END AS covered,
 a0 <= x0 AND b0 <= y0 AND a1 >= x1 AND b1 >= y1 AS inside, round((greatest(x1, a1) - least(x0, a0)) * (greatest(y1, b1) - least(y0, b0)), 6) AS merged_area
 FROM (SELECT *, own + greatest(a1 - a0, 0) * greatest(b1 - b0, 0) - i AS u FROM q)""",
        "corpus_cube": "SELECT source, mime_type, grouping_id(source, mime_type) AS level, count(*) AS n_docs, sum(n_chars) AS n_chars FROM documents GROUP BY CUBE (source, mime_type)",
        "p6_found": f"""{_RESULTS} SELECT DISTINCT archive_id, kind, path AS parent_path, CAST(no AS BIGINT) AS item_no FROM (SELECT archive_id, path, kind, unnest(generate_series(0, len(xs) - 1)) AS no FROM (SELECT archive_id, path, kind,
 {_objects('x')} AS xs FROM (SELECT archive_id, path, unnest(['entry', 'chunk', 'table']) AS kind, unnest([json_extract(j, '$.children'), json_extract(j, '$.chunks'), json_extract(j, '$.tables')]) AS x FROM r)))""",
        "p6_results": f"""{_RESULTS} SELECT archive_id AS record_id, path AS parent_path, 0::BIGINT AS item_no, {_str('j', 'content')} AS content, {_str('j', 'mimetype')} AS mime_type, {_str('m', 'title')} AS title, {_str('m', 'language')} AS language,
 TRY_CAST({_str('p', 'totalcount')} AS BIGINT) AS page_count, {_str('p', 'unittype')} AS page_unit, {_str('m', 'formattype')} AS format_type, array_to_string(CAST({_member('m', 'authors')} AS VARCHAR[]), '; ') AS authors, TRY_CAST({_str('j', 'qualityscore')} AS DOUBLE) AS quality_score
 FROM (SELECT *, {_member('m', 'pages')} AS p FROM (SELECT *, {_member('j', 'metadata')} AS m FROM r))""",
        "p6_entries": f"""{_of('children')} SELECT record_id, parent_path, item_no, CASE WHEN parent_path = '' THEN '' ELSE parent_path || '/' END || item_no AS path, {_str('x', 'path')} AS entry_path, {_str('x', 'mimetype')} AS mime_type,
 coalesce(json_type(res) = 'OBJECT' OR (json_type(res) = 'VARCHAR' AND json_valid(json_extract_string(res, '$'))), false) AS has_result FROM (SELECT *, {_member('x', 'result')} AS res FROM x)""",
        "p6_chunks": f"""{_of('chunks')} SELECT record_id, parent_path, item_no, {_str('x', 'content')} AS content, {_str('x', 'chunktype')} AS chunk_type, {', '.join(f"TRY_CAST({_str('m', c.replace('_', ''))} AS BIGINT) AS {c}" for c in ('byte_start', 'byte_end', 'token_count', 'chunk_index', 'total_chunks'))},
 CASE WHEN m IS NOT NULL THEN coalesce(array_to_string(list_transform({_objects('hs')}, lambda h: json_extract_string(h, '$.text')), ' > '), '') END AS headings FROM (SELECT *, {_member('h', 'headings')} AS hs FROM (SELECT *, {_member('m', 'headingcontext')} AS h FROM (SELECT *, {_member('x', 'metadata')} AS m FROM x)))""",
        "p6_tables": f"""{_of('tables')} SELECT record_id, parent_path, item_no, array_to_string(list_transform(CAST(cells AS VARCHAR[][]), lambda r: array_to_string(r, '|')), '/') AS cells, {_str('x', 'markdown')} AS markdown, TRY_CAST({_str('x', 'pagenumber')} AS BIGINT) AS page_number,
 {', '.join(f"TRY_CAST({_str('b', c)} AS DOUBLE) AS {c}" for c in ('x0', 'y0', 'x1', 'y1'))} FROM (SELECT *, {_member('x', 'cells')} AS cells, {_member('x', 'boundingbox')} AS b FROM x)""",
    }
