"""The queries of this subpackage, by the name under which they are registered, and SQL for those it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, credentials, decontam, langid, lmscore, manifest, mixing, pii, quality, sharding, simhash, spelling, warc
from .common import table


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_table(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_table(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_table(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.audit_drill(table(spark, sf_dir, "pages"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination_table(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_table(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data_table(table(spark, sf_dir, "documents"))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbour_table(table(spark, sf_dir, "embeddings"))


def op9_lmscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.lm_table(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op11_credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.secrets_table(table(spark, sf_dir, "documents"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variant_table(table(spark, sf_dir, "documents"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest_table(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_langid, op2_mixing, op3_quality, op4_warc, op5_decontamination, op6_simhash, op7_pii, op8_ann, op9_lmscore, op10_sharding, op11_credentials, op12_spelling, op13_manifest)
}

OP2_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('mix-17:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS key
  FROM documents),
s AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS cap, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1]::DOUBLE AS w
  FROM (SELECT source, sum(coalesce(size, 0))::BIGINT AS source_size FROM d GROUP BY source)),
t AS (SELECT 1.5::DOUBLE * sum(source_size)::DOUBLE AS budget, sum(w) AS w FROM s),
lv AS (
  SELECT 0 AS i, budget / w AS lam, -1::BIGINT AS n FROM t
  UNION ALL
  SELECT i, lam, n FROM (
    SELECT lv.i + 1 AS i, (max(t.budget) - sum(CASE WHEN lv.lam * s.w > s.cap THEN s.cap ELSE 0 END)) / sum(CASE WHEN lv.lam * s.w > s.cap THEN 0 ELSE s.w END) AS lam,
           count(*) FILTER (WHERE lv.lam * s.w > s.cap) AS n, max(lv.n) AS was
    FROM lv, s, t GROUP BY lv.i) WHERE n > was),
f AS (SELECT lam FROM lv ORDER BY i DESC LIMIT 1),
a AS (SELECT source, source_size, CASE WHEN lam * w > cap THEN cap ELSE lam * w END AS target FROM s, f),
e AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole, target - CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END * source_size AS rest
  FROM a),
r AS (
  SELECT doc_id, coalesce(size, 0) AS size, source_size, target, whole, rest,
         sum(coalesce(size, 0)) OVER (PARTITION BY d.source ORDER BY key ROWS UNBOUNDED PRECEDING) - coalesce(size, 0) / 2.0 AS mid
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size::BIGINT AS size, source_size, target, (size * (whole + CASE WHEN mid <= rest AND source_size > 0 THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
"""

OP4_SQL = r"""
WITH p AS (
  SELECT greatest(2, ceil(ln(greatest(1.0::DOUBLE, count(*) OVER () / 1000.0::DOUBLE)) / ln(16.0::DOUBLE)))::INT AS digits, page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, md5(coalesce(page_id::VARCHAR, url, '')) AS h, chr(13) || chr(10) AS nl FROM pages),
r AS (
  SELECT *, 'part-' || substr(h, 1, digits) AS file, ('0x' || substr(md5(coalesce(page_id::VARCHAR, '')), 1, 8))::BIGINT AS mark, left(html, greatest(0, length(html) - 1)::BIGINT) || chr(1) AS rotten,
         'WARC/1.0' || nl || 'WARC-Type: resource' || nl || 'WARC-Target-URI: ' || url || nl || 'Content-Type: text/html' || nl || 'Content-Length: ' AS head
  FROM p),
w AS (
  SELECT *, head || strlen(html) || nl || nl || html || nl || nl AS record, head || strlen(rotten) || nl || nl || rotten || nl || nl AS bad FROM r),
d AS (
  SELECT *, sha256(record) AS expected, sha256(bad) AS now FROM w),
o AS (
  SELECT *, sum(strlen(record)) OVER (PARTITION BY file ORDER BY page_id, expected ROWS UNBOUNDED PRECEDING) - strlen(record) AS place FROM d)
SELECT file, place::BIGINT AS "offset", page_id, expected, CASE WHEN mark % 101 = 1 THEN NULL ELSE now END AS found, CASE WHEN mark % 101 = 1 THEN 'missing' ELSE 'altered' END AS fault
FROM o WHERE mark % 101 = 1 OR mark % 97 = 0
"""

OP5_SQL = r"""
WITH b AS (
  SELECT coalesce(item_id::VARCHAR, 'null') AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
n AS (SELECT item, w, least(10, len(w)) AS size FROM b WHERE len(w) > 0),
i AS (SELECT DISTINCT item, size, array_to_string(w[k:k + size - 1], ' ') AS win FROM (SELECT item, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM n)),
d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
p AS (SELECT rid, size, k, array_to_string(w[k:k + size - 1], ' ') AS win FROM (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM d, (SELECT DISTINCT size FROM i) WHERE len(w) >= size)),
m AS (SELECT rid, k, size, item FROM p JOIN i USING (size, win)),
h AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(range(k, k + size)) AS pos FROM m) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM m) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN t USING (rid)
"""


def _cased(word: str) -> str:
    """A pattern of the word in either case, for A to Z alone."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


def _found(kind: str, pattern: str, value: int = 2) -> str:
    """The matches of a pattern with their places: leftmost ones, each after the shortest gap; ``value`` is the group that
    ``value`` gives, 2 being the whole match."""
    g = f"'(?s)(.*?)({pattern})'"
    return f"""SELECT rid, '{kind}' AS kind, start, start + length(m) AS "end", m, value FROM (SELECT rid, m, value, (sum(length(gap) + length(m)) OVER (PARTITION BY rid ORDER BY k) - length(m))::BIGINT AS start FROM (
    SELECT rid, unnest(range(1, len(l) + 1)) AS k, unnest(l) AS gap, unnest(regexp_extract_all(text, {g}, 2)) AS m, unnest(regexp_extract_all(text, {g}, {value})) AS value FROM (SELECT rid, text, regexp_extract_all(text, {g}, 1) AS l FROM d)))"""


_KEYWORD = "(?:" + "|".join(_cased(w) for w in ("password", "passwd", "secret", "token", "api_?key")) + ")"
_NAME = f"(?:{_cased('user')}(?:{_cased('name')})?|" + "|".join(_cased(w) for w in ("login", "account", "client_?id", "key_?id")) + ")"
_IS = r"""["'']?\x20*[:=]\x20*["'']?"""

OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
b AS (
  {_found('assign', _KEYWORD + _IS + '([A-Za-z0-9+/_.=-]+)', 3)} UNION ALL
  {_found('access', 'AKIA[A-Z0-9]+')} UNION ALL
  {_found('hex', '[0-9a-f]+')} UNION ALL
  {_found('user', _NAME + _IS + '[A-Za-z0-9@._-]{3,}')} UNION ALL
  {_found('mixed', '[A-Za-z0-9+/_-]{16,}')} UNION ALL
  {_found('endpoint', r"""(?:https?|ftp|ssh|s3|redis|amqp|postgresql|postgres|mysql|mongodb)://[^\x00-\x20"''<>]+""")}),
s AS (
  SELECT rid, CASE WHEN kind = 'assign' AND length(value) < {credentials.VALUE_LENGTH} THEN 'value' ELSE kind END AS kind, start, "end" FROM b
  WHERE length(m) >= CASE kind WHEN 'access' THEN {credentials.ACCESS_LENGTH} WHEN 'hex' THEN {credentials.HEX_LENGTH} ELSE 0 END AND (kind <> 'mixed' OR (regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[0-9]')))),
p AS (
  SELECT s.*, list_position({[*credentials.KINDS, *credentials.ADDED]}, kind) AS nth, kind IN {credentials.KINDS} AS sure, CASE WHEN kind IN ('access', 'user') THEN 'id' WHEN kind = 'endpoint' THEN kind ELSE 'secret' END AS role,
         len(regexp_extract_all(left(text, start), '\n[\x20\t]*\n')) AS scope FROM s JOIN d USING (rid)),
f AS (
  SELECT * FROM p WHERE NOT (kind IN ('user', 'mixed') AND EXISTS (SELECT 1 FROM p o WHERE o.rid = p.rid AND o.sure AND o.start < p."end" AND p.start < o."end"))),
j AS (
  SELECT x.rid, x.nth, x.start, x."end" FROM f x JOIN f y ON x.rid = y.rid AND x.scope = y.scope AND x.role <> y.role AND y.start <= x."end" + {credentials.REACH} AND y."end" >= x.start - {credentials.REACH}
  WHERE NOT x.sure GROUP BY ALL HAVING bool_or(y.sure) OR count(DISTINCT y.role) = 2),
r AS (SELECT rid, kind, nth, start, "end", sure FROM f WHERE sure UNION ALL SELECT rid, kind, nth, start, "end", sure FROM f JOIN j USING (rid, nth, start, "end") WHERE NOT sure),
g AS (
  SELECT rid, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex, count(*) FILTER (WHERE NOT sure) AS n_linked,
         string_agg(concat_ws(':', kind, start, "end"), ',' ORDER BY start, nth) FILTER (WHERE sure) AS base, string_agg(concat_ws(':', kind, start, "end"), ',' ORDER BY start, nth, "end") AS spans FROM r GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_linked, 0) AS n_linked
FROM d LEFT JOIN g USING (rid)
"""

#: The table of the CRC-32, by its polynomial, and the checksum of a text's bytes by it.
_CRC = """crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i)))"""


def _crc32(c: str) -> str:
    b = f"encode({c})"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, octet_length({b}) + 1), lambda k: ('0x' || substr(hex({b}), 2 * k - 1, 2))::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295)"


OP12_SQL = rf"""
WITH RECURSIVE {_CRC},
d AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
r AS (SELECT id, run, count(*) AS n FROM (SELECT id, unnest(regexp_extract_all(text, '[a-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM d) WHERE length(run) >= {spelling.LENGTH} GROUP BY ALL),
h AS (SELECT run, n, {_crc32("id || ':' || run")} AS h FROM r, crc),
w AS (
  SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % {spelling.DROPS} = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h)
  WHERE length(word) >= {spelling.LENGTH} GROUP BY word HAVING sum(n) >= {spelling.OCCURS}),
x AS (SELECT word, n, k, left(word, k - 1) AS a, substr(word, k + 1) AS b FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM w)),
p AS (
  SELECT x.word, y.word AS near, y.n FROM x JOIN x y ON x.k = y.k AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT x.word, y.word, y.n FROM x JOIN w y ON y.word = x.a || x.b
  UNION SELECT y.word, x.word, x.n FROM x JOIN w y ON y.word = x.a || x.b),
b AS (SELECT word, count(*) AS n_near, max(n) AS most FROM p GROUP BY word),
f AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= {spelling.TIMES} * w.n THEN most END AS form_n, CASE WHEN most >= {spelling.TIMES} * w.n THEN (SELECT min(near) FROM p WHERE p.word = w.word AND p.n = most) END AS form
  FROM w LEFT JOIN b USING (word)),
c AS (SELECT word, word AS root, 0 AS i FROM f UNION ALL SELECT c.word, f.form, i + 1 FROM c JOIN f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM f JOIN (SELECT word, max_by(root, i) AS root FROM c GROUP BY word) USING (word)
"""


def _part(c: str) -> str:
    return f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_part(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


OP13_SQL = rf"""
WITH RECURSIVE {_CRC},
d AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, {_leaf('n_chars')} AS leaf, CASE WHEN coalesce({_crc32("doc_id::VARCHAR")} % 7 = 0, false) THEN {_leaf('(n_chars + 1)')} ELSE {_leaf('n_chars')} END AS now FROM documents, crc),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, dense_rank() OVER (ORDER BY lang NULLS FIRST) AS tree FROM d),
n AS (
  SELECT tree, 0 AS level, pos, leaf AS h, count(*) OVER (PARTITION BY tree) AS width FROM o
  UNION ALL SELECT tree, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), max(width + 1) // 2 FROM n WHERE width > 1 GROUP BY tree, level, pos // 2),
u AS (
  SELECT 0 AS level, tree - 1 AS pos, h, count(*) OVER () AS width FROM n WHERE width = 1
  UNION ALL SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), max(width + 1) // 2 FROM u WHERE width > 1 GROUP BY level, pos // 2),
s AS (
  SELECT rid, level, o.pos >> level AS side, (SELECT max(h) FROM n x WHERE x.tree = o.tree AND x.level = n.level AND x.pos = xor(o.pos >> n.level, 1)) AS h FROM o JOIN n ON n.tree = o.tree AND n.pos = 0 AND n.width > 1
  UNION ALL SELECT rid, 1000 + level, (o.tree - 1) >> level, (SELECT max(h) FROM u x WHERE x.level = u.level AND x.pos = xor((o.tree - 1) >> u.level, 1)) FROM o JOIN u ON u.pos = 0 AND u.width > 1),
p AS (SELECT rid, list(struct_pack(side := side, h := coalesce(h, '')) ORDER BY level) AS path FROM s GROUP BY rid),
f AS (
  SELECT doc_id, leaf, tree, list_reduce(list_concat([struct_pack(side := 0::BIGINT, h := now)], coalesce(path, [])), lambda a, b: struct_pack(side := 0::BIGINT, h := CASE WHEN b.side % 2 = 0 THEN sha256(a.h || b.h) ELSE sha256(b.h || a.h) END)).h AS folded_root,
         sha256(coalesce(array_to_string(list_transform(path, lambda b: b.h), ''), '')) AS proof_sha256 FROM o LEFT JOIN p USING (rid))
SELECT doc_id, leaf, n.h AS subroot, u.h AS root, proof_sha256, folded_root, folded_root = u.h AS verified FROM f JOIN n ON n.tree = f.tree AND n.width = 1 JOIN u ON u.width = 1
"""

ORACLE: dict[str, str] = {"op2_mixing": OP2_SQL, "op4_warc": OP4_SQL, "op5_decontamination": OP5_SQL, "op11_credentials": OP11_SQL, "op12_spelling": OP12_SQL, "op13_manifest": OP13_SQL}
