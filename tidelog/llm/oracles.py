"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from tidelog.llm.known_licenses import DIGESTS, EQUIVALENT, HEADERS, IDENTIFIERS, TEXTS, TITLES


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


OP1 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM common JOIN sizes a ON x = a.doc_id JOIN sizes b ON y = b.doc_id WHERE 100 * i >= 75 * (a.n + b.n - i)
), reached AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION
  SELECT reached.x, links.y FROM reached JOIN links ON reached.y = links.x
)
SELECT x AS doc_id, coalesce(max(n), 0)::BIGINT AS n_shingles, min(y) AS component_id FROM reached LEFT JOIN sizes ON x = sizes.doc_id GROUP BY x
"""

OP2 = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), sums AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rank FROM sums
), weighted AS (
  SELECT *, ([5.0, 2.0, 1.0])[(rank % 3) + 1]::DOUBLE AS weight FROM ranked
), filled AS (
  SELECT *, sum(source_size) OVER ()::BIGINT AS all_size,
    coalesce(sum(source_size) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS cut_size,
    sum(weight) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight,
    row_number() OVER f AS fill
  FROM weighted WINDOW f AS (ORDER BY source_size / weight, rank)
), leveled AS (
  SELECT *, (all_size - 3.0::DOUBLE * cut_size) / open_weight AS level FROM filled
), opened AS (
  SELECT *, min(CASE WHEN level * weight <= 3.0::DOUBLE * source_size THEN fill END) OVER () AS first_open FROM leveled
), shared AS (
  SELECT *, max(CASE WHEN fill = first_open THEN level END) OVER () AS open_level FROM opened
), targets AS (
  SELECT source, source_size,
    CASE WHEN fill < first_open THEN 3.0::DOUBLE * source_size ELSE least(open_level * weight, 3.0::DOUBLE * source_size) END AS target
  FROM shared
), rated AS (
  SELECT doc_id, size, source_size, target, least(coalesce(target / nullif(source_size, 0), 0.0), 3.0)::DOUBLE AS rate,
    ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS draw
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM rated
"""


_SPELLED = "MAP {" + ", ".join(f"{_text(a)}: {_text(b)}" for a, b in EQUIVALENT) + "}"


def _canonical(text: str) -> str:
    """The canonical lines of a text, empty where there are no words to keep: words are found and mapped one by one."""
    after = r"[^\p{L}\p{N}]*([©<{\[]|c\)|[0-9]|by[^\p{L}\p{N}])|.*(19|20)[0-9][0-9]|.*(inc|llc|ltd|corporation|foundation)[^\p{L}\p{N}]*$"
    begins = rf"regexp_matches(l, '^[^\p{{L}}\p{{N}}©(]*(copyright({after})|\(c\)[^\p{{L}}\p{{N}}]*(copyright|[0-9][0-9][0-9][0-9])|©)')"
    reserved = r"regexp_matches(l, '^[^\p{L}\p{N}]*all rights reserved[^\p{L}\p{N}]*$')"
    words = rf"array_to_string(list_transform(regexp_extract_all(l, '[\p{{L}}\p{{N}}]+'), lambda w: coalesce({_SPELLED}[w], w)), ' ')"
    kept = f"list_transform(string_split(lower(coalesce({text}, '')), chr(10)), lambda l: CASE WHEN {begins} OR {reserved} THEN '' ELSE {words} END)"
    return f"list_transform({kept}, lambda l: CASE WHEN l IN ({', '.join(map(_text, TITLES))}) THEN '' ELSE l END)"


def _plain(x: str) -> str:
    return f"sha256(replace(replace({x}, ' ', ''), chr(10), ''))"


OP7 = rf"""
WITH given AS (
  SELECT * FROM (VALUES {", ".join(f"({_text(a)}, {_text(b)})" for a, b in (*TEXTS, *HEADERS, *IDENTIFIERS))}) AS k(license, text)
), canonical AS (
  SELECT doc_id, NULL AS license, {_canonical("text")} AS c FROM documents UNION ALL SELECT NULL, license, {_canonical("text")} FROM given
), full_lines AS (
  SELECT *, list_filter(c, lambda l: l <> '') AS f FROM canonical
), split AS (
  SELECT *, list_filter(range(1, len(f) + 1), lambda i: NOT starts_with(f[i], 'copyright')) AS own FROM full_lines
), lined AS (
  SELECT doc_id, license, CASE WHEN len(own) = 0 THEN [] ELSE f[own[1]:] END AS lines,
    list_filter(string_split_regex(array_to_string(c, chr(10)), '\n\n+'), lambda p: contains(p, chr(10)) AND p <> chr(10)) AS paragraphs FROM split
), known AS (
  SELECT d, min(license) AS license FROM (
    SELECT license, {_plain("array_to_string(lines, '')")} AS d FROM lined WHERE license IS NOT NULL
    UNION ALL SELECT * FROM (VALUES {", ".join(f"({_text(a)}, {_text(b)})" for a, b in DIGESTS)}) AS k(license, d)
  ) GROUP BY d
), own AS (
  SELECT doc_id, lines, paragraphs, {_plain("array_to_string(lines, '')")} AS digest FROM lined WHERE license IS NULL
), units AS (
  SELECT doc_id, digest, digest AS d, true AS whole FROM own
  UNION ALL
  SELECT doc_id, digest, {_plain("part")} AS d, false AS whole FROM (SELECT doc_id, digest, unnest(lines || paragraphs) AS part FROM own)
)
SELECT doc_id, digest, max(CASE WHEN whole THEN license END) AS license,
  coalesce(string_agg(DISTINCT CASE WHEN NOT whole THEN license END, ',' ORDER BY CASE WHEN NOT whole THEN license END), '') AS line_licenses,
  count(*) FILTER (whole)::BIGINT AS n_rows
FROM units LEFT JOIN known USING (d) GROUP BY doc_id, digest
"""

OP10 = r"""
WITH words AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), windows AS (
  SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, w FROM words WHERE len(w) >= 20
), hashed AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS h FROM windows
), ranked AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS n FROM hashed
), covered AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS k FROM ranked WHERE n > 1
), gone AS (
  SELECT doc_id, list(k) AS ks FROM covered GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(ks), 0)::BIGINT AS n_removed,
  sha256(CASE WHEN ks IS NULL THEN array_to_string(w, ' ') ELSE array_to_string(list_select(w, list_filter(range(1, len(w) + 1), lambda k: NOT list_contains(ks, k))), ' ') END) AS kept_sha256
FROM words LEFT JOIN gone USING (doc_id)
"""

OP9 = """
WITH usable AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v) / (sqrt(list_inner_product(q.v, q.v)) * sqrt(list_inner_product(c.v, c.v))) AS score
  FROM usable q JOIN usable c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scored
QUALIFY rank <= 5
"""

OP11 = r"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), each AS (
  SELECT row_number() OVER () AS row, * FROM docs
), words AS (
  SELECT row, lang, source, unnest(w) AS term FROM each
), kept AS (
  SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT row) >= 10
), langs AS (
  SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang
), groups AS (
  SELECT DISTINCT lang, source FROM docs
), cells AS (
  SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL
), totals AS (
  SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS total FROM groups LEFT JOIN cells USING (lang, source) GROUP BY lang, source
), shares AS (
  SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (t.total + 2 * v) AS p,
    1 + (1000000000::HUGEINT * (k.n + 2)) // (langs.total + 2 * v) AS q
  FROM totals t JOIN langs USING (lang) JOIN kept k USING (lang) LEFT JOIN cells c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), apart AS (
  SELECT lang, source, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM shares WHERE n > 0 AND p > q
)
SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pairs
UNION ALL
SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM apart QUALIFY rank <= 10
"""

OP12 = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), numbers AS (
  SELECT *, len(u) AS n, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(h, i, 8))::BIGINT) AS d FROM cut
), placed AS (
  SELECT *, least(d[1] % (n + 1), d[2] % (n + 1)) AS a, greatest(d[1] % (n + 1), d[2] % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR d[3] % 100 >= 100 THEN 'plain' WHEN d[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM numbers
), parts AS (
  SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM placed
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM parts
"""

OP13 = r"""
WITH given AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))
), turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM given
), written AS (
  SELECT *, '<turn>' || replace(replace(replace(replace(r, '\', '\\'), '<turn>', '\<turn>'), '</turn>', '\</turn>'), chr(10), '\' || chr(10)) || chr(10)
    || replace(replace(replace(t, '\', '\\'), '<turn>', '\<turn>'), '</turn>', '\</turn>') || '</turn>' || chr(10) AS w,
    CASE WHEN r = 'assistant' THEN t ELSE '' END AS learnt FROM turns
), joined AS (
  SELECT conv_id, count(*) AS n, string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn, r, t) AS whole, string_agg(learnt, '' ORDER BY turn, r, t) AS loss, string_agg(w, '') AS w FROM written GROUP BY conv_id
)
SELECT conv_id, n AS n_turns, sha256(whole) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, length(w) AS formatted_chars FROM joined
"""

ORACLE_SQL: dict[str, str] = {"op1_jaccard": OP1, "op2_mixing": OP2, "op7_licenses": OP7, "op9_neighbours": OP9, "op10_repeats": OP10, "op11_divergence": OP11, "op12_middles": OP12, "op13_chat": OP13}
