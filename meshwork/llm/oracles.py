"""The queries that SQL can express, for DuckDB, on whole tables."""

SPACE = r"'[^\x20\x09-\x0D]+'"

OP5 = """
WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
  regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) path FROM r),
q AS (SELECT *, CASE
  WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
  WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
  WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
  WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
  WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END rule FROM p)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN starts_with(path, '/cgi-bin/') OR starts_with(path, '/wp-login') OR starts_with(path, '/ads/') OR starts_with(host, 'ads.') THEN 'block' ELSE 'allow' END verdict FROM q
"""

OP6 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {SPACE}) w FROM documents),
t AS (SELECT doc_id, unnest(w) x, unnest(range(1, len(w) + 1)) i, len(w) n FROM d),
g AS (SELECT doc_id, i, n, array_agg(x) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) s FROM t),
sh AS (SELECT DISTINCT doc_id, md5(array_to_string(s, chr(10))) s FROM g WHERE len(s) = 5 OR (n < 5 AND i = 1)),
sets AS (SELECT doc_id, count(*) n, md5(string_agg(s, '' ORDER BY s)) k FROM sh GROUP BY 1),
cls AS (SELECT k, min(doc_id) rep, count(*) n_copies, any_value(n) n FROM sets GROUP BY 1),
rs AS (SELECT rep, cls.n, sh.s FROM cls JOIN sh ON cls.rep = sh.doc_id),
near AS (SELECT a.rep u, b.rep v FROM rs a JOIN rs b ON a.s = b.s AND a.rep <> b.rep GROUP BY 1, 2, a.n, b.n HAVING 5 * count(*) >= 4 * (a.n + b.n - count(*))),
reach(u, root) AS (SELECT rep, rep FROM cls UNION SELECT near.v, reach.root FROM reach JOIN near ON near.u = reach.u),
root AS (SELECT u, min(root) class_id FROM reach GROUP BY 1),
links AS (SELECT u, count(*) n_links FROM near GROUP BY 1)
SELECT d.doc_id, coalesce(sets.n, 0)::BIGINT n_shingles, coalesce(cls.rep, d.doc_id) copy_of, coalesce(cls.n_copies, 1)::BIGINT n_copies, coalesce(root.class_id, d.doc_id) class_id,
  coalesce(links.n_links, 0)::BIGINT n_links, coalesce(root.class_id, d.doc_id) = d.doc_id AS "first"
FROM d LEFT JOIN sets USING (doc_id) LEFT JOIN cls ON sets.k = cls.k LEFT JOIN root ON root.u = cls.rep LEFT JOIN links ON links.u = cls.rep
"""

OP7 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {SPACE}) w FROM documents),
t AS (SELECT doc_id, unnest(w) x, unnest(range(1, len(w) + 1)) i FROM d),
g AS (SELECT doc_id, i, x, array_agg(x) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) s FROM t),
f AS (SELECT doc_id, i, x, CASE WHEN len(s) = 13 AND min(doc_id) OVER (PARTITION BY s) < doc_id THEN 1 ELSE 0 END dup FROM g),
m AS (SELECT doc_id, i, x, max(dup) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) gone FROM f),
a AS (SELECT doc_id, count(*) n_words, sum(gone)::BIGINT n_removed, string_agg(x, ' ' ORDER BY i) FILTER (gone = 0) kept FROM m GROUP BY 1)
SELECT d.doc_id, coalesce(n_words, 0) n_words, coalesce(n_removed, 0) n_removed, sha256(coalesce(kept, '')) kept_sha256 FROM d LEFT JOIN a USING (doc_id)
"""

OP9 = """
WITH v AS (SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] q FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q))
SELECT query_id, r::INTEGER "rank", vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) r FROM s) WHERE r <= 5
"""

#: crc32 byte by byte, deletion neighbourhoods for near words, and a recursive walk along the forms.
OP13 = """
with recursive bits as (select i, i as c, 0 as k from range(256) t(i)
  union all select i, case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end, k + 1 from bits where k < 8),
lut as (select list(c order by i) as t from bits where k = 8),
raw as (select doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{00C0}-\\x{00FF}]+')) as run from documents),
runs as (select coalesce(cast(doc_id as varchar), '') || ':' as head, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run, count(*) as n
  from raw where length(run) >= 7 group by all),
points as (select run, n, list_transform(string_split(head || run, ''), lambda x: unicode(x)) as p from runs),
bytes as (select run, n, flatten(list_transform(p, lambda c: case when c < 128 then [c] else [195, c % 64 + 128] end)) as b from points),
crc as (select run, n, xor(list_reduce(list_prepend(4294967295::bigint, b::bigint[]), lambda s, x: xor(s // 256, t[(xor(s, x) % 256) + 1])), 4294967295) as h from bytes, lut),
cut as (select case when h % 31 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, n from crc),
words as (select word, sum(n)::bigint as n from cut where length(word) >= 7 group by word having sum(n) >= 2),
gaps as (select word, n, k, substr(word, 1, k - 1) || substr(word, k + 1) as rest from (select word, n, unnest(range(1, length(word) + 1)) as k from words)),
near as (select a.word, b.word as other, b.n as m from gaps a join gaps b on a.rest = b.rest and a.k = b.k and a.word <> b.word
  union select g.word, w.word, w.n from gaps g join words w on g.rest = w.word
  union select w.word, g.word, g.n from gaps g join words w on g.rest = w.word),
best as (select word, count(*) as n_near, max(m) as m, arg_min(other, struct_pack(a := -m, b := other)) as other from near group by word),
formed as (select w.word, w.n, coalesce(n_near, 0) as n_near, case when m >= 10 * n then other end as form, case when m >= 10 * n then m end as form_n
  from words w left join best b on w.word = b.word),
walk as (select word, word as at from formed union all select w.word, f.form from walk w join formed f on w.at = f.word where f.form is not null),
ends as (select w.word, w.at as root from walk w join formed f on w.at = f.word where f.form is null)
select f.word, f.form, e.root, f.n, f.n_near::bigint as n_near, f.form_n from formed f join ends e on f.word = e.word
"""
