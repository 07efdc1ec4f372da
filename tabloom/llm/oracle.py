"""The corpus queries in DuckDB's SQL, where SQL can express them."""

from __future__ import annotations

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = rf"""
WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
 windows AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
 docs AS (SELECT row_number() OVER () AS r, doc_id, CASE WHEN text IS NULL THEN [] ELSE {_WORDS} END AS w FROM documents),
 places AS (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM windows))),
 hits AS (SELECT DISTINCT r, i, n, item_id FROM places JOIN windows USING (n, g)),
 covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM hits)) GROUP BY r),
 found AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT r, cast(item_id AS varchar) AS item FROM hits) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (r) LEFT JOIN found USING (r)"""

#: Levels are raised until no further source is held at three times its size. Sources of more documents than a bucket
#: of rounding are dealt over buckets as the operator deals them.
MIXING = r"""
WITH RECURSIVE sized AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size FROM documents),
 sources AS (SELECT source, cast(sum(size) AS bigint) AS source_size, count(*) AS n_docs FROM sized GROUP BY source),
 shares AS (SELECT *, (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS weight FROM sources),
 levels AS (SELECT cast(-1 AS bigint) AS before, cast(0 AS bigint) AS held, (SELECT cast(sum(source_size) AS double) / sum(weight) FROM shares) AS level
  UNION ALL
  SELECT l.held, s.held, (s.total - s.words) / s.free FROM levels l, LATERAL (SELECT count(*) FILTER (3 * source_size < l.level * weight) AS held, cast(coalesce(sum(3 * source_size) FILTER (3 * source_size < l.level * weight), 0) AS bigint) AS words, cast(sum(source_size) AS double) AS total, sum(weight) FILTER (NOT 3 * source_size < l.level * weight) AS free FROM shares) s
  WHERE s.held > l.held AND s.free > 0),
 rated AS (SELECT *, least(3.0::double * source_size, (SELECT max(level) FROM levels) * weight) AS target FROM shares),
 dealt AS (SELECT row_number() OVER () AS r, s.doc_id, s.size, s.source, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
   ('0x' || substr(md5(coalesce(cast(s.doc_id AS varchar), 'null') || ':' || s.size), 1, 15))::bigint % cast(ceil(t.n_docs / 4096) AS bigint) AS bucket
  FROM sized s JOIN rated t ON s.source IS NOT DISTINCT FROM t.source),
 ordered AS (SELECT *, row_number() OVER (PARTITION BY source, bucket ORDER BY size DESC, doc_id NULLS LAST, r) AS k FROM dealt),
 steps AS (SELECT r, cast(0 AS bigint) AS k, source, bucket, size, rate, 0.0::double AS owed, cast(0 AS bigint) AS copies FROM ordered WHERE k = 1
  UNION ALL
  SELECT o.r, o.k, o.source, o.bucket, o.size, o.rate,
   p.owed + o.size * o.rate - o.size * (floor(o.rate) + CASE WHEN o.rate > floor(o.rate) AND p.owed + o.size * o.rate - o.size * floor(o.rate) > o.size / 2.0 THEN 1 ELSE 0 END),
   cast(floor(o.rate) + CASE WHEN o.rate > floor(o.rate) AND p.owed + o.size * o.rate - o.size * floor(o.rate) > o.size / 2.0 THEN 1 ELSE 0 END AS bigint)
  FROM steps p JOIN ordered o ON o.k = p.k + 1 AND o.bucket = p.bucket AND o.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, o.size, source_size, target, o.size * s.copies AS taken, o.source, cast(s.copies AS int) AS copies FROM ordered o JOIN steps s ON s.r = o.r AND s.k = o.k"""

_LEAVES = """list_transform(string_split({0}, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)), lambda p: list_transform(list_filter(
  list_concat([substr(p, 1, 8), substr(p, 9, 24), substr(p, 33, 32)], regexp_extract_all(substr(p, 65), '(?s).{{1,64}}')), lambda x: x <> ''), lambda x: sha256(x))))"""
_ENDS = "list_distinct(list_transform(flatten(flatten({0})), lambda x: x[1:8]))"
_LIKE = """CASE WHEN {0}.root = {1}.root THEN 1.0 WHEN len({0}.ends) + len({1}.ends) = 0 THEN 0.0
  ELSE 2.0 * len(list_intersect({0}.ends, {1}.ends)) / (len({0}.ends) + len({1}.ends)) END::double"""
MERKLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
 n AS (SELECT doc_id, text, coalesce(lead(text) OVER w, first_value(text) OVER w) AS following FROM d WINDOW w AS (ORDER BY doc_id DESC)),
 e AS (SELECT row_number() OVER () AS r, doc_id, text, following, length(text) AS n_chars, substr(text, 1, length(text) - length(text) // 2) || substr(following, 1, length(text) // 2) AS edited FROM n),
 t AS (SELECT r, 0 AS kind, text AS t FROM e UNION ALL SELECT r, 1, edited FROM e UNION ALL SELECT r, 2, following FROM e),
 leaves AS (SELECT r, kind, {_LEAVES.format("t")} AS leaves FROM t),
 paragraphs AS (SELECT *, list_transform(leaves, lambda s: list_transform(s, lambda p: {{'hash': sha256(coalesce(array_to_string(p, ''), '')), 'n': len(p)}})) AS paragraphs FROM leaves),
 sections AS (SELECT *, list_transform(paragraphs, lambda s: sha256(array_to_string(list_transform(s, lambda p: p.hash), ''))) AS sections FROM paragraphs),
 prints AS (SELECT r, kind, {_ENDS.format("leaves")} AS ends, sha256(array_to_string(sections, '')) AS root,
   sha256(array_to_string(sections, '')) || '|' || array_to_string(list_transform(list_zip(sections, paragraphs), lambda z: z[1][1:8] || ':' || array_to_string(list_transform(z[2], lambda p: p.hash[1:8] || '*' || p.n), ',')), ';')
   || '|' || coalesce(array_to_string(list_transform(flatten(flatten(leaves)), lambda x: x[1:8]), ''), '') AS fingerprint FROM sections)
SELECT e.doc_id, e.n_chars, sha256(e.edited) AS edited_sha256, a.fingerprint, b.fingerprint AS edited_fingerprint, {_LIKE.format("a", "b")} AS near_edited, {_LIKE.format("a", "c")} AS near_next
FROM e JOIN prints a ON a.r = e.r AND a.kind = 0 JOIN prints b ON b.r = e.r AND b.kind = 1 JOIN prints c ON c.r = e.r AND c.kind = 2"""

_MASKED = "list_transform(w, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END)"
_CUT = "(2 + (len(m) - 2) * {0} // 4)"
LINES = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS doc, text, string_split(text, chr(10)) AS parts FROM documents),
 lines AS (SELECT r, doc, unnest(parts) AS line, unnest(range(len(parts))) AS k FROM docs WHERE text IS NOT NULL),
 split AS (SELECT r, doc, k, list_filter(string_split_regex(line, '[ \t\x0B\x0C\r]+'), lambda x: x <> '') AS w FROM lines),
 masked AS (SELECT r, doc, k, CASE WHEN len(w) < 3 THEN w ELSE {_MASKED} END AS m FROM split WHERE len(w) > 0),
 own AS (SELECT r, doc, k, m, len(m) || ' ' || array_to_string(m, ' ') AS own FROM masked),
 named AS (SELECT r, doc, k, own, -1 AS block, own AS key FROM own
  UNION ALL SELECT r, doc, k, own, block, len(m) || '|' || array_to_string(list_concat(m[1 : {_CUT.format("block")}], ['<block>'], m[{_CUT.format("(block + 1)")} + 1 :]), ' ') AS key
  FROM (SELECT r, doc, k, m, own, unnest([0, 1, 2, 3]) AS block FROM own WHERE len(m) >= 8)),
 recurring AS (SELECT block, key, min(doc) AS least FROM named GROUP BY block, key HAVING min(doc) < max(doc) AND (block < 0 OR min(own) <> max(own))),
 dropped AS (SELECT DISTINCT r, k FROM named JOIN recurring USING (block, key) WHERE doc > least),
 listed AS (SELECT r, count(*) AS n, string_agg(cast(k AS varchar), ',' ORDER BY k) AS ks FROM dropped GROUP BY r),
 kept AS (SELECT r, string_agg(line, chr(10) ORDER BY k) AS text FROM lines ANTI JOIN dropped USING (r, k) GROUP BY r)
SELECT doc_id, coalesce(len(parts), 0) AS n_lines, coalesce(n, 0) AS n_dropped, coalesce(ks, '') AS dropped, CASE WHEN docs.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text
FROM docs LEFT JOIN listed USING (r) LEFT JOIN kept USING (r)"""
