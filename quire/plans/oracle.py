"""SQL (DuckDB) of the engine's queries, written from their definitions and apart from the Spark plans."""

from __future__ import annotations

from quire.operators.concepts import LEAST_KEY, LEAST_TOKEN, MAX_CONCEPTS, STOPWORDS
from quire.plans.queries import CONCEPT, QUERY, SCOPE_QUERY

_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
_SPACE = r"[\s\x1c-\x1f\x85\xa0  -     　]"

SECTIONS = """v_sections AS (
  SELECT source AS doc_id, source || '.d' || CAST(doc_id AS VARCHAR) AS section_id, doc_id AS ord,
         split_part(text, chr(10), 1) AS title, CAST(1 + doc_id % 3 AS INTEGER) AS level, text FROM documents
)"""
TURNS = """v_turns AS (
  SELECT CAST(conv_id AS VARCHAR) AS doc_id, CAST(turn AS INTEGER) AS ord, 't' || CAST(turn AS VARCHAR) AS id, CASE WHEN role = 'assistant' THEN 'text' ELSE 'title' END AS type,
         text, CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 2 END AS level, CAST(turn // 2 AS INTEGER) AS page_idx FROM conversations
)"""
MARKS = """v_marks AS (
  SELECT doc_id, pos, title, page_index, level, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page_index, level, title, pos) - 1 AS INTEGER) AS nr FROM (
    SELECT CAST(conv_id AS VARCHAR) AS doc_id, CAST(turn AS INTEGER) AS pos, split_part(text, chr(10), 1) AS title, CAST(turn // 2 AS INTEGER) AS page_index, CAST(1 + turn % 2 AS INTEGER) AS level FROM conversations WHERE role = 'user')
)"""
ANNOTATIONS = """v_ann AS (
  SELECT s.doc_id, s.section_id, l.toxic = 1 OR l.quality = 0 AS opinion, l.toxic = 0 AND l.quality = 0 AS lists, s.title, CASE WHEN l.toxic = 0 AND l.quality = 1 THEN s.title ELSE '' END AS raw
  FROM labels l JOIN v_sections s ON s.ord = l.doc_id
), v_sum AS (
  SELECT doc_id, section_id, opinion, lists, title, trim(regexp_replace(raw, '\\s+', ' ', 'g')) AS summary FROM v_ann
)"""


def _slug(x: str) -> str:
    return f"coalesce(nullif(regexp_replace(regexp_replace(lower({x}), '[^a-zA-Z0-9]+', '-', 'g'), '^-|-$', '', 'g'), ''), 'untitled')"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def _terms(x: str) -> str:
    return f"regexp_extract_all(strip_accents(lower({x})), '[\\p{{L}}\\p{{N}}]+')"


TOKENS = f"tokens AS (SELECT doc_id, section_id, title, {_terms('title || chr(10) || text')} AS t FROM v_sections)"


def _bm25(query: list[str], where: str, limit: int, source: str = "tokens") -> str:
    """A subquery of the best sections."""
    listed = ", ".join(f"({i}, '{q}')" for i, q in enumerate(query))
    return f"""
  SELECT doc_id, section_id, title, round(round(sum(CASE WHEN idf <= 0 THEN 1e-6 ELSE idf END * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 12), 6) AS score FROM (
    SELECT t.doc_id, t.section_id, t.title, len(t.t) AS dl, avgdl, ln((n - df + 0.5) / (df + 0.5)) AS idf, CAST(len(list_filter(t.t, lambda x: x = q.term)) AS DOUBLE) AS tf
    FROM {source} t, (VALUES {listed}) q(nr, term), (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM {source})
      , LATERAL (SELECT count(*) AS df FROM {source} d WHERE list_contains(d.t, q.term)) WHERE {where}
  ) WHERE tf > 0 GROUP BY doc_id, section_id, title ORDER BY round(sum(CASE WHEN idf <= 0 THEN 1e-6 ELSE idf END * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 12) DESC, doc_id, section_id LIMIT {limit}"""


def _tf(query: list[str], source: str = "tokens") -> str:
    hits = " + ".join(f"len(list_filter(t, lambda x: x = '{q}'))" for q in query)
    return f"SELECT doc_id, section_id, title, CAST({hits} AS DOUBLE) AS score FROM {source} WHERE {hits} > 0"


CANDIDATES = rf"""words AS (
  SELECT doc_id, section_id, ord, unnest(w) AS word, unnest(range(len(w))) AS i FROM (SELECT doc_id, section_id, ord, regexp_extract_all(text, '[A-Z][A-Za-z0-9-]+') AS w FROM v_sections)
), islands AS (
  SELECT *, lower(word) IN ({_STOP}) AS stops, sum(CAST(lower(word) IN ({_STOP}) AS INTEGER)) OVER (PARTITION BY section_id ORDER BY i) AS island FROM words
), pieces AS (
  SELECT doc_id, section_id, ord, island, (row_number() OVER (PARTITION BY section_id, island ORDER BY i) - 1) // 3 AS piece, word, i FROM islands WHERE NOT stops
), phrases AS (
  SELECT doc_id, section_id, ord, string_agg(word, ' ' ORDER BY i) AS phrase, CAST(row_number() OVER (PARTITION BY section_id ORDER BY min(i)) - 1 AS INTEGER) AS nr FROM pieces GROUP BY doc_id, section_id, ord, island, piece
), longs AS (
  SELECT section_id, ord, doc_id, unnest(t) AS token, unnest(range(len(t))) AS nr FROM (
    SELECT doc_id, section_id, ord, list_filter(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9-]{{2,}}'), lambda t: len(t) >= {LEAST_TOKEN} AND lower(t) NOT IN ({_STOP})) AS t FROM v_sections)
), candidates AS (
  SELECT doc_id, section_id, ord, 0 AS rank, title AS candidate FROM v_sections UNION ALL SELECT doc_id, section_id, ord, 1, title FROM v_sections
  UNION ALL SELECT doc_id, section_id, ord, 2 + nr, phrase FROM phrases
  UNION ALL SELECT l.doc_id, l.section_id, l.ord, 2 + coalesce(n, 0) + l.nr, token FROM longs l LEFT JOIN (SELECT section_id, count(*) AS n FROM phrases GROUP BY section_id) USING (section_id)
)"""


def _concepts(source: str = "candidates", name: str = "concepts") -> str:
    words = r"list_filter(regexp_split_to_array(c, '\s+'), lambda x: x <> '')"
    title = f"CASE WHEN len({words}) = 0 THEN 'Untitled' ELSE array_to_string(({words})[1:4], ' ') END"
    return f"""keyed AS (
  SELECT *, lower(candidate) AS key FROM {source} WHERE len(candidate) >= {LEAST_KEY} AND lower(candidate) NOT IN ({_STOP})
), per_key AS (
  SELECT doc_id, key, count(DISTINCT section_id) AS n, arg_min(candidate, ord * 1000000 + rank) AS c FROM keyed GROUP BY doc_id, key
), shown AS (SELECT doc_id, key, n, {title} AS title FROM per_key
), ranked AS (
  SELECT *, {_slug("title")} AS slug FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, lower(title), key) AS place FROM shown) WHERE place <= {MAX_CONCEPTS}
), listed AS (
  SELECT doc_id, slug, section_id, min(place * 1000000 + ord) AS spot FROM ranked JOIN (SELECT DISTINCT doc_id, key, section_id, ord FROM keyed) USING (doc_id, key) GROUP BY doc_id, slug, section_id
), {name} AS (
  SELECT doc_id, CAST(min(place) AS INTEGER) AS position, slug, arg_min(title, place) AS title FROM ranked GROUP BY doc_id, slug
)"""


MERGED = f"""{SECTIONS}, {ANNOTATIONS}, {CANDIDATES}, open_candidates AS (
  SELECT c.* FROM candidates c ANTI JOIN (SELECT section_id FROM v_sum WHERE opinion) o USING (section_id)
), {_concepts("open_candidates")}, mentions AS (
  SELECT doc_id, section_id, slug, title, '' AS gloss, 'auto' AS source FROM listed JOIN concepts USING (doc_id, slug)
  UNION ALL SELECT doc_id, section_id, {_slug("title")}, trim(regexp_replace(title, '\\s+', ' ', 'g')), 'from label', 'agent' FROM v_sum WHERE lists
), nodes AS (
  SELECT slug, min(title) AS title, count(DISTINCT doc_id) AS doc_count, count(*) AS mention_count FROM mentions GROUP BY slug
), detailed AS (
  SELECT m.slug, m.doc_id, m.section_id, s.ord, coalesce(s.title, m.section_id) AS section_title, m.title, m.gloss, m.source, coalesce(a.summary, '') AS summary
  FROM mentions m LEFT JOIN v_sections s USING (section_id) LEFT JOIN v_sum a USING (section_id)
)"""

_NAMES = """numbered AS (
  SELECT doc_id, nr, slug, row_number() OVER (PARTITION BY doc_id ORDER BY nr) AS i FROM slugged
), named AS (
  SELECT doc_id, i, nr, slug AS name, [slug] AS used FROM numbered WHERE i = 1
  UNION ALL
  SELECT doc_id, i, nr, name, list_append(used, name) FROM (
    SELECT n.doc_id, n.i, n.nr, p.used, CASE WHEN NOT list_contains(p.used, n.slug) THEN n.slug
      ELSE list_filter(list_transform(range(2, len(p.used) + 3), lambda k: n.slug || '-' || CAST(k AS VARCHAR)), lambda y: NOT list_contains(p.used, y))[1] END AS name
    FROM named p JOIN numbered n ON n.doc_id = p.doc_id AND n.i = p.i + 1)
)"""

HEADING = f"""{TURNS}, opened AS (
  SELECT *, ord = min(ord) OVER (PARTITION BY doc_id) OR (type = 'title' AND coalesce(nullif(level, 0), 1) <= 2) AS opens FROM v_turns
), cut AS (
  SELECT *, CAST(sum(CAST(opens AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS INTEGER) AS nr FROM opened
), heads AS (
  SELECT doc_id, nr, ord, type, page_idx AS page, CASE WHEN type = 'title' THEN text ELSE 'Talk ' || doc_id || ' — Front Matter' END AS title, CASE WHEN type = 'title' THEN coalesce(nullif(level, 0), 1) ELSE 1 END AS level FROM cut WHERE opens
), paths AS (
  SELECT h.doc_id, h.nr, string_agg(t.text, ' / ' ORDER BY t.ord) AS path FROM heads h JOIN v_turns t ON t.doc_id = h.doc_id AND t.ord <= h.ord AND t.type = 'title' AND h.type = 'title'
  WHERE t.level <= h.level AND NOT EXISTS (SELECT 1 FROM v_turns u WHERE u.doc_id = t.doc_id AND u.type = 'title' AND u.ord > t.ord AND u.ord <= h.ord AND u.level <= t.level) GROUP BY h.doc_id, h.nr
), bodies AS (
  SELECT doc_id, nr, min(page_idx) AS first, max(page_idx) AS last, coalesce(string_agg({_strip("text")}, chr(10) || chr(10) ORDER BY ord) FILTER (type <> 'title' AND {_strip("text")} <> ''), '') AS text, string_agg(id, ',' ORDER BY ord) AS block_ids FROM cut GROUP BY doc_id, nr
), slugged AS (SELECT doc_id, nr, {_slug("title")} AS slug FROM heads), {_NAMES}, sections AS (
  SELECT h.doc_id, h.nr AS ord, h.doc_id || '.' || n.name AS section_id, h.title, h.level, coalesce(p.path, h.title) AS heading_path, coalesce(b.first, h.page) AS page_start,
    coalesce(lead(h.page) OVER (PARTITION BY h.doc_id ORDER BY h.nr) - 1, b.last) AS page_end, b.text, b.block_ids
  FROM heads h JOIN bodies b USING (doc_id, nr) JOIN named n USING (doc_id, nr) LEFT JOIN paths p USING (doc_id, nr)
), linked AS (
  SELECT *, lag(section_id) OVER (PARTITION BY doc_id ORDER BY ord) AS prev_id, lead(section_id) OVER (PARTITION BY doc_id ORDER BY ord) AS next_id FROM sections
)"""

PLAN = f"""{SECTIONS}, p_sections AS (SELECT doc_id AS plan_id, ord AS pos, section_id FROM v_sections
), p_done AS (SELECT plan_id, pos AS seq, section_id FROM p_sections WHERE pos IN (SELECT doc_id FROM labels)
), p_left AS (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY pos) AS nr FROM p_sections WHERE section_id NOT IN (SELECT section_id FROM p_done))"""

PARENTS = """parents AS (
  SELECT s.*, (SELECT arg_max(p.section_id, p.ord) FROM v_sections p WHERE p.doc_id = s.doc_id AND p.ord < s.ord AND p.level < s.level) AS parent_id,
    lag(section_id) OVER (PARTITION BY doc_id ORDER BY ord) AS prev_id, lead(section_id) OVER (PARTITION BY doc_id ORDER BY ord) AS next_id FROM v_sections s
)"""

_JSON = """replace(replace(replace(replace(replace({0}, chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), chr(9), chr(92) || 't'), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r')"""


def _json(x: str) -> str:
    """A JSON string in ASCII (of characters below U+10000)."""
    escaped = _JSON.format(x)
    each = f"list_transform(string_split({escaped}, ''), lambda c: CASE WHEN c = '' OR unicode(c) < 128 THEN c ELSE chr(92) || 'u' || lpad(lower(to_hex(unicode(c))), 4, '0') END)"
    return f"""CASE WHEN {x} IS NULL THEN 'null' ELSE '"' || array_to_string({each}, '') || '"' END"""


def _json_list(x: str, part: str) -> str:
    return f"'[' || array_to_string(list_transform(string_split({x}, '{part}'), lambda y: {_json('y')}), ', ') || ']'"


QUERY_TERMS, SCOPE_TERMS = ["ering", "onti", "ete", "queue"], ["thti", "erly"]
assert (QUERY, SCOPE_QUERY) == ("Ering onti été queue", "thti erly")

ORACLE_SQL = {
    "fts_bm25_topk": f"WITH {SECTIONS}, {TOKENS} {_bm25(QUERY_TERMS, 'true', 10)}",
    "fts_bm25_scoped": f"WITH {SECTIONS}, {TOKENS} {_bm25(SCOPE_TERMS, '''t.doc_id IN ('src1', 'src3', 'src5')''', 20)}",
    "scan_tf_search": f"WITH {SECTIONS}, {TOKENS} {_tf(['onti', 'ering', 'onti'])}",
    "search_union_indexed_scan": f"""WITH {SECTIONS}, {TOKENS}, known AS (SELECT * FROM tokens WHERE regexp_matches(doc_id, '^src[0-9]$')), other AS (SELECT * FROM tokens WHERE NOT regexp_matches(doc_id, '^src[0-9]$'))
SELECT * FROM (SELECT * FROM ({_bm25(SCOPE_TERMS, "true", 25, "known")}) UNION ALL SELECT * FROM ({_tf(SCOPE_TERMS, "other")} ORDER BY score DESC, doc_id, section_id LIMIT 25)) ORDER BY score DESC, doc_id, section_id LIMIT 25""",
    "search_snippet": f"""WITH {SECTIONS}, spots AS (SELECT section_id, text, list_min(list_filter([instr(lower(text), 'onti'), instr(lower(text), 'ering')], lambda p: p > 0)) AS p FROM v_sections)
SELECT section_id, CASE WHEN p IS NULL THEN text[1:160] || CASE WHEN len(text) > 160 THEN '…' ELSE '' END
  ELSE CASE WHEN p > 54 THEN '…' ELSE '' END || text[greatest(p - 54, 0) + 1:greatest(p - 54, 0) + 160] || CASE WHEN greatest(p - 54, 0) + 160 < len(text) THEN '…' ELSE '' END END AS snippet FROM spots""",
    "tokenize_terms": f"WITH {SECTIONS}, {TOKENS} SELECT section_id, term, count(*) AS tf FROM (SELECT section_id, unnest(t) AS term FROM tokens) GROUP BY section_id, term",
    "folded_terms": f"WITH {SECTIONS} SELECT section_id, array_to_string({_terms('title')}, ' ') AS terms FROM v_sections",
    "slugify_titles": f"WITH {SECTIONS} SELECT section_id, {_slug('title')} AS slug FROM v_sections",
    "unique_slugs": f"WITH RECURSIVE {SECTIONS}, slugged AS (SELECT doc_id, ord AS nr, {_slug('title')} AS slug FROM v_sections), {_NAMES} SELECT doc_id, nr, name AS slug FROM named",
    "section_prev_next": f"WITH {SECTIONS}, {PARENTS} SELECT section_id, prev_id, next_id FROM parents",
    "section_outline": f"WITH {SECTIONS}, {PARENTS} SELECT doc_id, section_id, ord, title, level, parent_id FROM parents",
    "section_children": f"WITH {SECTIONS}, {PARENTS} SELECT p.section_id, coalesce(c.ids, '') AS child_ids FROM v_sections p LEFT JOIN (SELECT parent_id, string_agg(section_id, ',' ORDER BY ord) AS ids FROM parents GROUP BY parent_id) c ON c.parent_id = p.section_id",
    "section_related": f"""WITH {SECTIONS}, {PARENTS}, links AS (
  SELECT doc_id, section_id, 'parent' AS relation, parent_id AS other_id FROM parents UNION ALL SELECT doc_id, section_id, 'prev', prev_id FROM parents UNION ALL SELECT doc_id, section_id, 'next', next_id FROM parents
  UNION ALL SELECT doc_id, parent_id, 'child', section_id FROM parents WHERE parent_id IS NOT NULL)
SELECT l.doc_id, l.section_id, relation, other_id, s.title AS other_title FROM links l JOIN v_sections s ON s.section_id = other_id""",
    "dangling_links": f"""WITH {SECTIONS}, {PARENTS}
SELECT section_id, CASE WHEN level <> 3 THEN prev_id END AS prev_id, CASE WHEN level <> 3 THEN next_id END AS next_id FROM parents""",
    "segment_heading": f"WITH RECURSIVE {HEADING} SELECT * FROM linked",
    "segment_bookmark": f"""WITH RECURSIVE {HEADING.replace("v_turns AS (", "v_all AS (", 1).replace("), opened AS", "), v_turns AS (SELECT * FROM v_all WHERE doc_id NOT IN (SELECT doc_id FROM v_marks0)), opened AS", 1).replace("v_all AS (", "v_marks0 AS (SELECT CAST(conv_id AS VARCHAR) AS doc_id FROM conversations WHERE role = 'user'), v_all AS (", 1)}
, {MARKS}, ranged AS (
  SELECT m.doc_id, m.nr, m.title, m.level, m.page_index, lead(m.page_index) OVER (PARTITION BY m.doc_id ORDER BY m.nr) AS following FROM v_marks m
), held AS (
  SELECT r.doc_id, r.nr, max(t.page_idx) AS last, string_agg({_strip("t.text")}, chr(10) || chr(10) ORDER BY t.ord) FILTER (t.type <> 'title' AND {_strip("t.text")} <> '') AS text, string_agg(t.id, ',' ORDER BY t.ord) AS block_ids
  FROM ranged r JOIN v_all t ON t.doc_id = r.doc_id AND t.page_idx >= r.page_index AND (r.following IS NULL OR t.page_idx < r.following) GROUP BY r.doc_id, r.nr
), b_slugs AS (SELECT doc_id, nr, {_slug("title")} AS slug FROM ranged
), {_NAMES.replace("slugged", "b_slugs").replace("numbered", "b_numbered").replace("named", "b_named")}, b_sections AS (
  SELECT r.doc_id, r.nr AS ord, r.doc_id || '.' || n.name AS section_id, r.title, r.level, r.title AS heading_path, r.page_index AS page_start, CASE WHEN following IS NOT NULL THEN greatest(page_index, following - 1) ELSE h.last END AS page_end,
    coalesce(h.text, '') AS text, coalesce(h.block_ids, '') AS block_ids FROM ranged r JOIN b_named n USING (doc_id, nr) LEFT JOIN held h USING (doc_id, nr)
)
SELECT *, lag(section_id) OVER (PARTITION BY doc_id ORDER BY ord) AS prev_id, lead(section_id) OVER (PARTITION BY doc_id ORDER BY ord) AS next_id FROM b_sections UNION ALL SELECT * FROM linked""",
    "segment_token_page": f"""WITH RECURSIVE lines AS (
  SELECT CAST(doc_id AS VARCHAR) AS doc_id, unnest(l) AS text, unnest(range(len(l))) AS ord FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
), kept AS (
  SELECT doc_id, ord, text, CAST(ord // 4 AS INTEGER) AS page, len(regexp_extract_all(text, '[^{_SPACE[1:-1]}]+')) AS tokens FROM lines WHERE {_strip("text")} <> ''
), pages AS (
  SELECT doc_id, page, sum(tokens) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS i FROM kept GROUP BY doc_id, page
), packed AS (
  SELECT doc_id, page, i, n AS total, 1 AS part FROM pages WHERE i = 1
  UNION ALL SELECT p.doc_id, p.page, p.i, CASE WHEN k.total + p.n > 200 THEN p.n ELSE k.total + p.n END, CASE WHEN k.total + p.n > 200 THEN k.part + 1 ELSE k.part END FROM packed k JOIN pages p ON p.doc_id = k.doc_id AND p.i = k.i + 1
), parts AS (
  SELECT doc_id, part, min(page) AS page_start, max(page) AS page_end, string_agg({_strip("text")}, chr(10) || chr(10) ORDER BY ord) AS text, string_agg('b' || CAST(ord AS VARCHAR), ',' ORDER BY ord) AS block_ids, CAST(sum(tokens) AS BIGINT) AS token_count
  FROM kept JOIN packed USING (doc_id, page) GROUP BY doc_id, part
), titled AS (SELECT *, doc_id || '.part-' || CAST(part AS VARCHAR) AS section_id, 'Document ' || doc_id || ' — Part ' || CAST(part AS VARCHAR) AS title FROM parts)
SELECT doc_id, part - 1 AS ord, section_id, title, 1 AS level, title AS heading_path, page_start, page_end, text, block_ids, lag(section_id) OVER (PARTITION BY doc_id ORDER BY part) AS prev_id, lead(section_id) OVER (PARTITION BY doc_id ORDER BY part) AS next_id, token_count FROM titled""",
    "block_page_range_join": f"""WITH {TURNS}, {MARKS}, ranged AS (SELECT *, lead(page_index) OVER (PARTITION BY doc_id ORDER BY nr) AS following FROM v_marks)
SELECT t.doc_id, t.id, r.nr FROM v_turns t JOIN ranged r ON r.doc_id = t.doc_id AND t.page_idx >= r.page_index AND (r.following IS NULL OR t.page_idx < r.following)""",
    "token_counts": f"WITH {SECTIONS} SELECT section_id, CAST(len(regexp_extract_all(text, '[^{_SPACE[1:-1]}]+')) AS BIGINT) AS tokens FROM v_sections",
    "concept_candidates": f"WITH {SECTIONS}, {CANDIDATES} SELECT section_id, CAST(rank AS INTEGER) AS rank, candidate FROM candidates",
    "title_case_phrases": f"WITH {SECTIONS}, {CANDIDATES} SELECT section_id, nr, phrase FROM phrases",
    "concepts_top50": f"WITH {SECTIONS}, {CANDIDATES}, {_concepts()} SELECT doc_id, position, slug, title, string_agg(section_id, ',' ORDER BY spot) AS section_ids FROM concepts JOIN listed USING (doc_id, slug) GROUP BY doc_id, position, slug, title",
    "concept_mentions_merged": f"WITH {MERGED} SELECT * FROM mentions",
    "concept_nodes": f"WITH {MERGED} SELECT * FROM nodes",
    "concept_mentions_of": f"WITH {MERGED} SELECT slug, doc_id, section_id, section_title, gloss, source, summary FROM detailed WHERE slug = '{CONCEPT}'",
    "section_concepts": f"WITH {MERGED} SELECT * FROM nodes WHERE slug IN (SELECT slug FROM mentions WHERE section_id = 'src1.d1')",
    "concepts_bulk": f"WITH {MERGED} SELECT slug, min(title) AS title, string_agg(section_id || '|' || section_title || '|' || gloss || '|' || source, chr(10) ORDER BY doc_id, ord, section_id) AS mentions FROM detailed GROUP BY slug",
    "annotated_mention_count": f"WITH {MERGED} SELECT slug, count(*) FILTER (summary <> '') AS annotated, count(*) AS mentions FROM detailed GROUP BY slug",
    "annotation_dedup": f"WITH {SECTIONS}, {ANNOTATIONS} SELECT section_id, {_slug('title')} AS slug, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS title, 'a gloss' AS gloss FROM v_sum WHERE lists",
    "stale_annotations": f"WITH {SECTIONS}, {ANNOTATIONS} SELECT section_id, raw AS summary FROM v_ann WHERE NOT opinion",
    "plan_next_batch": f"WITH {PLAN} SELECT plan_id, plan_id AS doc_id, pos, section_id FROM p_left WHERE nr <= 3",
    "plan_progress": f"""WITH {PLAN}, t AS (SELECT plan_id, count(*) AS total FROM p_sections GROUP BY plan_id), d AS (SELECT plan_id, count(*) AS completed FROM p_done GROUP BY plan_id)
SELECT plan_id, plan_id AS doc_id, coalesce(completed, 0) AS completed, total, coalesce(completed, 0) >= total AS done FROM t LEFT JOIN d USING (plan_id)""",
    "plan_mark_read": f"WITH {PLAN} SELECT * FROM p_done UNION ALL SELECT plan_id, coalesce((SELECT max(seq) FROM p_done d WHERE d.plan_id = l.plan_id), -1) + 1, section_id FROM p_left l WHERE nr = 1",
    "list_documents": f"WITH {SECTIONS} SELECT doc_id, arg_min(title, ord) AS title, count(*) AS section_count FROM v_sections GROUP BY doc_id",
    "catalog_counts": f"WITH RECURSIVE {HEADING} SELECT doc_id, count(*) AS section_count FROM linked GROUP BY doc_id",
    "duplicate_ids": f"WITH {SECTIONS} SELECT doc_id, {_slug('title')} AS section_id, count(*) AS n FROM v_sections GROUP BY 1, 2 HAVING count(*) > 1",
    "unsafe_ids": f"WITH {SECTIONS}, ids AS (SELECT doc_id, CASE WHEN level = 1 THEN title ELSE section_id END AS section_id FROM v_sections) SELECT * FROM ids WHERE NOT regexp_full_match(section_id, '[a-z0-9]+(-[a-z0-9]+)*(\\.[a-z0-9]+(-[a-z0-9]+)*)*')",
    "section_assets": f"""WITH RECURSIVE {HEADING} SELECT c.doc_id, s.section_id, CAST(row_number() OVER (PARTITION BY c.doc_id, c.nr ORDER BY c.ord) - 1 AS INTEGER) AS pos, c.id AS block_id, 'image' AS type, c.text AS caption,
  CASE WHEN len(c.text) > 60 THEN 'images/' ELSE '' END || c.id || '.png' AS path FROM cut c JOIN linked s ON s.doc_id = c.doc_id AND s.ord = c.nr QUALIFY c.type = 'text' AND c.page_idx > 0""",
    "render_section_md": f"""WITH RECURSIVE {HEADING} SELECT doc_id, section_id, '---' || chr(10) || 'id: ' || {_json("section_id")} || chr(10) || 'doc_id: ' || {_json("doc_id")} || chr(10) || 'title: ' || {_json("title")} || chr(10) || 'level: ' || CAST(level AS VARCHAR) || chr(10)
  || 'heading_path: ' || {_json_list("heading_path", " / ")} || chr(10) || 'page_start: ' || coalesce(CAST(page_start AS VARCHAR), 'null') || chr(10) || 'page_end: ' || coalesce(CAST(page_end AS VARCHAR), 'null') || chr(10)
  || 'prev_id: ' || {_json("prev_id")} || chr(10) || 'next_id: ' || {_json("next_id")} || chr(10) || 'block_ids: ' || {_json_list("block_ids", ",")} || chr(10) || '---' || chr(10) || chr(10)
  || repeat('#', level) || ' ' || title || CASE WHEN text <> '' THEN chr(10) || chr(10) || text ELSE '' END || chr(10) AS content FROM linked""",
    "render_outline": f"WITH {SECTIONS} SELECT doc_id, '# ' || doc_id || chr(10) || chr(10) || string_agg(repeat('  ', level - 1) || '- [' || title || '](sections/' || section_id || '.md)', chr(10) ORDER BY ord) || chr(10) AS content FROM v_sections GROUP BY doc_id",
    "render_concept_page": f"""WITH {MERGED}, books AS (SELECT doc_id, arg_min(title, ord) AS book_title FROM v_sections GROUP BY doc_id), parts AS (
  SELECT slug, doc_id, chr(10) || '## ' || book_title || chr(10) || chr(10) || string_agg('- [' || section_title || '](../books/' || doc_id || '/sections/' || section_id || '.md)' || CASE WHEN gloss <> '' THEN ' — ' || gloss ELSE '' END
    || CASE WHEN source = 'agent' THEN ' (agent-verified)' ELSE '' END || CASE WHEN summary <> '' THEN chr(10) || '  > ' || summary ELSE '' END, chr(10) ORDER BY ord, section_id) AS part FROM detailed JOIN books USING (doc_id) GROUP BY slug, doc_id, book_title)
SELECT slug, '# ' || title || chr(10) || chr(10) || 'Mentioned in ' || CAST(doc_count AS VARCHAR) || CASE WHEN doc_count = 1 THEN ' book' ELSE ' books' END || ' · ' || CAST(mention_count AS VARCHAR) || CASE WHEN mention_count = 1 THEN ' section.' ELSE ' sections.' END
  || chr(10) || body || chr(10) AS content FROM nodes JOIN (SELECT slug, string_agg(part, chr(10) ORDER BY doc_id) AS body FROM parts GROUP BY slug) USING (slug)""",
    "layout_blocks": f"""SELECT CAST(conv_id AS VARCHAR) AS doc_id, 'p' || CAST(turn // 2 AS VARCHAR) || '.b' || CAST(row_number() OVER (PARTITION BY conv_id, turn // 2 ORDER BY turn) - 1 AS VARCHAR) AS id,
  CASE role WHEN 'assistant' THEN 'text' WHEN 'system' THEN 'equation' ELSE 'title' END AS type, {_strip("text")} AS text, CASE WHEN role NOT IN ('assistant', 'system') THEN 1 END AS level, CAST(turn // 2 AS INTEGER) AS page_idx FROM conversations""",
    "bridge_changed": f"WITH RECURSIVE {HEADING} SELECT section_id, section_id || '.md' AS name, level <> 2 OR page_start = 0 AS changed FROM linked",
}
