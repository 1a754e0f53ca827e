"""DuckDB SQL for the training-data queries, written apart from the Spark code.

Shard positions, thresholds, windows, links and digests are worked out the plain
way (global windows, full sorts, joins of all windows), without the operators'
buckets, sketches of groups, fingerprints or tables.  Operators that SQL can't
express (trained models, signature suppression, tokenizers) are tested by
brute force or held-out accuracy in tests/llm.
"""

from __future__ import annotations


WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
ALNUM = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

MIXING = rf"""
WITH d AS (
  SELECT doc_id, source, len({WORDS}) AS size,
         (('0x' || substr(md5('17|' || doc_id), 1, 13))::BIGINT + 1)::DOUBLE / 4503599627370496.0 AS u,
         length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS symbols, length(coalesce(text, '')) AS chars
  FROM documents),
k AS (SELECT doc_id, source, size, greatest(1e-18, -ln(u) / greatest(0.05, 1 - 4 * symbols / greatest(1, chars))) AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS wt FROM s),
-- a source is capped if sharing the words left by the sources with a smaller ratio of cap to weight exceeds its cap
c AS (SELECT a.source, a.source_size, a.wt,
             3 * a.source_size * (SELECT sum(wt) FROM w b WHERE (3 * b.source_size / b.wt, b.source) >= (3 * a.source_size / a.wt, a.source))
             <= a.wt * ((SELECT sum(source_size) FROM w) - coalesce((SELECT sum(3 * source_size) FROM w b
                         WHERE (3 * b.source_size / b.wt, b.source) < (3 * a.source_size / a.wt, a.source)), 0)) AS capped FROM w a),
t AS (SELECT source, source_size, CASE WHEN capped THEN (3 * source_size)::DOUBLE ELSE
        (wt * ((SELECT sum(source_size) FROM c) - coalesce((SELECT sum(3 * source_size) FROM c WHERE capped), 0)))::DOUBLE
        / (SELECT sum(wt) FROM c WHERE NOT capped) END AS target FROM c),
e AS (SELECT *, CASE WHEN source_size > 0 THEN least(3, floor(target / source_size))::BIGINT ELSE 0 END AS epochs FROM t),
p AS (SELECT doc_id, size, source_size, target, epochs, round(target - epochs * source_size)::BIGINT AS budget,
             sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) - size AS before
      FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (epochs * size + greatest(0, least(size, budget - before)))::BIGINT AS taken, epochs::INTEGER AS epochs FROM p
"""


def _hilbert_steps(source: str, bits: int) -> tuple[str, str]:
    """CTEs that turn columns x0, x1, x2 of ``source`` step by step; (CTE text, last name)."""
    ctes, last, k = [], source, 0
    for b in range(bits - 1, 0, -1):
        q = 1 << b
        for i in range(3):
            t = f"(xor(x0, x{i}) & {q - 1})"
            cols = [f"CASE WHEN x{i} & {q} <> 0 THEN xor(x0, {q - 1}) ELSE xor(x0, {t}) END AS x0"]
            cols += [(f"CASE WHEN x{i} & {q} <> 0 THEN x{i} ELSE xor(x{i}, {t}) END AS x{i}" if j == i else f"x{j}") for j in (1, 2)]
            ctes.append(f"h{k} AS (SELECT doc_id, size, crc, {', '.join(cols)} FROM {last})")
            last, k = f"h{k}", k + 1
    ctes.append(f"g1 AS (SELECT doc_id, size, crc, x0, xor(x1, x0) AS x1, xor(x2, xor(x1, x0)) AS x2 FROM {last})")
    flip = "0"
    for b in range(bits - 1, 0, -1):
        flip = f"xor({flip}, CASE WHEN x2 & {1 << b} <> 0 THEN {(1 << b) - 1} ELSE 0 END)"
    ctes.append(f"g2 AS (SELECT doc_id, size, crc, xor(x0, f) AS x0, xor(x1, f) AS x1, xor(x2, f) AS x2 FROM (SELECT *, {flip} AS f FROM g1))")
    woven = " + ".join(f"((x{i} >> {b}) & 1) * {1 << (3 * b + 2 - i)}" for b in range(bits) for i in range(3))
    ctes.append(f"curve AS (SELECT doc_id, size, crc, ({woven})::BIGINT AS curve FROM g2)")
    return ",\n".join(ctes), "curve"


_STEPS, _LAST = _hilbert_steps("start", 8)
SHARDING = f"""
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
               lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS tab),
b AS (SELECT doc_id, source, lang, hex(encode(coalesce(text, ''))) AS h FROM documents),
d AS (SELECT doc_id, source, lang, length(h) // 2 + 8 AS size,
             xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
                 lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1])), 4294967295)::BIGINT AS crc FROM b, crc),
src AS (SELECT source, (rank() OVER (ORDER BY source NULLS LAST) - 1) * 256 // count(*) OVER () AS x0 FROM (SELECT DISTINCT source FROM d)),
lng AS (SELECT lang, (rank() OVER (ORDER BY lang NULLS LAST) - 1) * 256 // count(*) OVER () AS x1 FROM (SELECT DISTINCT lang FROM d)),
start AS (SELECT doc_id, size, crc, x0::BIGINT AS x0, x1::BIGINT AS x1, least(255, floor(log2(size + 1) * 8))::BIGINT AS x2
          FROM d JOIN src ON d.source IS NOT DISTINCT FROM src.source JOIN lng ON d.lang IS NOT DISTINCT FROM lng.lang),
{_STEPS},
placed AS (SELECT *, row_number() OVER (ORDER BY curve, doc_id, crc) - 1 AS pos, count(*) OVER () AS n FROM {_LAST}),
cut AS (SELECT *, pos * 24 // n AS shard FROM placed)
SELECT doc_id, size::BIGINT AS size, crc AS text_crc32, 'rows' AS law, shard::INTEGER AS shard,
       (pos - (shard * n + 23) // 24)::BIGINT AS slot, NULL::INTEGER AS grown_shard, curve FROM cut
"""

_STATS = ["symbol_share", "dup_line_share", "repeat_share", "word_length"]
QUALITY = rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
g AS (SELECT doc_id, i, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o AS gram FROM x
      WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g WHERE gram IS NOT NULL),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM r, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS ln FROM d),
b AS (SELECT d.doc_id, lang, source, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(ln) - len(list_distinct(ln)))::BIGINT AS n_dup_lines,
             coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(ln) AS n_lines
      FROM d JOIN l USING (doc_id) LEFT JOIN cov USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, 10000 * n_symbols // greatest(1, word_chars) AS symbol_share,
             10000 * n_dup_lines // greatest(1, n_lines) AS dup_line_share, 10000 * n_repeat_words // greatest(1, n_words) AS repeat_share,
             100 * word_chars // greatest(1, n_words) AS word_length FROM b),
u AS (SELECT doc_id, lang, source, base_failed, unnest({_STATS}) AS stat, unnest([{', '.join(_STATS)}]) AS v FROM f),
-- the sketch keeps the six leading binary digits of a value and fills the rest with ones
q AS (SELECT *, (((v >> sh) + 1) << sh) - 1 AS bucket FROM (SELECT *, greatest(0, length(bin(v)) - 6) AS sh FROM u WHERE NOT base_failed)),
lev AS (SELECT unnest([0, 1, 2]) AS level),
z0 AS (SELECT level, CASE WHEN level < 2 THEN lang END AS lang, CASE WHEN level < 1 THEN source END AS source, stat, bucket FROM q, lev),
z1 AS (SELECT *, row_number() OVER (PARTITION BY level, lang, source, stat ORDER BY bucket) AS k,
              count(*) OVER (PARTITION BY level, lang, source, stat) AS n FROM z0),
quart AS (SELECT level, lang, source, stat, max(n) AS n, min(bucket) FILTER (4 * k >= n) AS q1, min(bucket) FILTER (4 * k >= 3 * n) AS q3,
                 1 + min(bucket) FILTER (1000 * k >= CASE stat WHEN 'symbol_share' THEN 950 ELSE 990 END * n) AS h FROM z1 GROUP BY ALL),
fence AS (SELECT level, lang, source, stat, n, CASE WHEN stat = 'word_length' THEN q3 + 3 * (q3 - q1) + 200
                 ELSE (((h >> greatest(0, length(bin(h)) - 6)) + 1) << greatest(0, length(bin(h)) - 6)) - 1 END AS lim FROM quart),
bad AS (SELECT DISTINCT u.doc_id FROM u
        JOIN fence a ON a.level = 0 AND a.stat = u.stat AND a.lang IS NOT DISTINCT FROM u.lang AND a.source IS NOT DISTINCT FROM u.source
        JOIN fence c ON c.level = 1 AND c.stat = u.stat AND c.lang IS NOT DISTINCT FROM u.lang JOIN fence z ON z.level = 2 AND z.stat = u.stat
        WHERE u.v > CASE WHEN a.n >= 30 THEN CASE u.stat WHEN 'word_length' THEN a.lim ELSE least(a.lim, c.lim) END WHEN c.n >= 30 THEN c.lim ELSE z.lim END)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND bad.doc_id IS NULL AS kept
FROM f LEFT JOIN bad USING (doc_id)
"""

WINNOWING = rf"""
WITH i AS (SELECT item_id, {ALNUM} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, m, array_to_string(w[s:s + m - 1], ' ') AS win
       FROM (SELECT item_id, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM i WHERE len(w) > 0)),
d AS (SELECT doc_id, {ALNUM} AS w FROM documents),
dw AS (SELECT doc_id, m, s, array_to_string(w[s:s + m - 1], ' ') AS win
       FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM d, (SELECT DISTINCT m FROM iw) WHERE len(w) >= m)),
hit AS (SELECT doc_id, s, dw.m, item_id FROM dw JOIN iw ON dw.m = iw.m AND dw.win = iw.win),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + m)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
        FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""

MINHASH = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, hash(array_to_string(w[s:s + 4], ' ')) AS g
       FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS s FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM both_ JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
edge AS (SELECT x AS a, y AS b FROM link UNION SELECT y, x FROM link),
reach AS (SELECT a AS doc_id, a AS r FROM (SELECT DISTINCT a FROM edge) UNION SELECT reach.doc_id, edge.b FROM reach JOIN edge ON reach.r = edge.a),
comp AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(component_id, d.doc_id) AS component_id,
       coalesce(component_id, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN comp USING (doc_id)
"""

WARC = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
v AS (SELECT *, list_transform(range(8), lambda g: ('0x' || substr(h, 5 * g + 1, 5))::BIGINT) AS five FROM p),
a AS (SELECT *, array_to_string(list_transform(range(32), lambda c:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((five[c // 4 + 1] >> (15 - 5 * (c % 4))) & 31) + 1, 1)), '') AS payload_digest,
        min(page_id) OVER (PARTITION BY h) AS first_id FROM v)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM a
"""



def _lloyd(rounds: int) -> str:
    """Plain Lloyd rounds: all distances, and the componentwise means, round by round."""
    ctes = [f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id) NULLS LAST, q) - 1 AS c, q FROM v
       ORDER BY sha256('3:' || vec_id) NULLS LAST, q LIMIT 8)"""]
    for k in range(rounds + 1):
        ctes.append(f"""a{k} AS MATERIALIZED (SELECT rid, min((d, c)) AS best FROM (
  SELECT rid, c, list_sum(list_transform(range(1, 65), lambda i: (v.q[i] - c{k}.q[i]) * (v.q[i] - c{k}.q[i])))::BIGINT AS d FROM v, c{k}) GROUP BY rid)""")
        if k < rounds:
            ctes.append(f"""m{k} AS MATERIALIZED (
  SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS q FROM (
    SELECT best[2] AS c, i, sum(x)::BIGINT AS s, count(*) AS n
    FROM (SELECT best, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM a{k} JOIN v USING (rid)) GROUP BY 1, 2) GROUP BY c),
c{k + 1} AS MATERIALIZED (SELECT c{k}.c, coalesce(m{k}.q, c{k}.q) AS q FROM c{k} LEFT JOIN m{k} USING (c))""")
    return "WITH " + ",\n".join(ctes) + f"""
SELECT vec_id, best[2]::INTEGER AS cluster, best[1]::BIGINT AS distance, (sum(best[1]) OVER (PARTITION BY best[2]))::BIGINT AS cluster_inertia,
       (sum(best[1]) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM v JOIN a{rounds} USING (rid) JOIN c{rounds} c ON c.c = best[2]
"""


# windows are cut from blocks of 1,000 starts, as cutting them from a long text reads all of it each time
SUFFIX = """
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
b AS (SELECT doc_id, 1000 * k AS origin, substr(h, 2000 * k + 1, 2398) AS part, least(1000, n - 199 - 1000 * k) AS starts
      FROM (SELECT doc_id, h, n, unnest(range(0, (n - 199 + 999) // 1000)) AS k FROM d WHERE n >= 200)),
w AS (SELECT doc_id, origin + i AS s, md5_number(substr(part, 2 * i + 1, 400)) AS win FROM (SELECT *, unnest(range(0, starts)) AS i FROM b)),
again AS (SELECT win FROM w GROUP BY win HAVING count(*) > 1),
hit AS (SELECT doc_id, s FROM w SEMI JOIN again USING (win)),
edge AS (SELECT doc_id, s, s > coalesce(lag(s) OVER o, -201) + 200 AS fresh FROM hit WINDOW o AS (PARTITION BY doc_id ORDER BY s)),
run AS (SELECT doc_id, s, sum(fresh::INTEGER) OVER (PARTITION BY doc_id ORDER BY s) AS r FROM edge),
span AS (SELECT doc_id, min(s) AS a, max(s) + 200 AS z FROM run GROUP BY doc_id, r),
gap AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM span),
cut AS (SELECT doc_id, count(*) AS n_spans, sum(z - a) AS n_removed, max(z) AS z, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept
        FROM gap JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(z, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""


def _over(sql: str, table: str) -> str:
    """A query of ``documents`` on another table of the same columns."""
    return sql.replace("FROM documents", f"FROM {table}")


#: The stages of the corpus pipeline, each on what the one before keeps; near-duplicates from 80 percent on.
PIPELINE = f"""
WITH good AS MATERIALIZED (SELECT d.* FROM documents d JOIN ({QUALITY}) q USING (doc_id) WHERE q.kept),
single AS MATERIALIZED (SELECT d.* FROM good d JOIN ({_over(MINHASH, "good").replace("100 * c >= 85", "100 * c >= 80")}) q USING (doc_id) WHERE q.kept),
clean AS MATERIALIZED (SELECT d.* FROM single d JOIN ({_over(WINNOWING, "single")}) q USING (doc_id) WHERE NOT q.contaminated),
-- a document is taken in each epoch, and once more if at least half of it fits what is left
taken AS (SELECT doc_id, epochs + (size > 0 AND 2 * (taken - epochs * size) >= size)::INTEGER AS copies FROM ({_over(MIXING, "clean")})),
mixed AS MATERIALIZED (SELECT c.*, unnest(range(copies)) AS copy FROM clean c JOIN taken USING (doc_id)),
placed AS MATERIALIZED (SELECT doc_id, shard, slot FROM ({_over(SHARDING, "mixed")}))
SELECT clean.*, shard, slot FROM clean JOIN placed USING (doc_id)
"""

ORACLES: dict[str, str] = {
    "op1_mixing": MIXING,
    "op2_sharding": SHARDING,
    "op5_quality_rules": QUALITY,
    "op6_winnowing": WINNOWING,
    "op7_suffix": SUFFIX,
    "op9_minhash": MINHASH,
    "op10_warc": WARC,
    "op11_centroids": _lloyd(10),
}
