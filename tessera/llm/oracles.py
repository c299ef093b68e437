"""DuckDB SQL for the training-data queries that SQL can express on whole tables.

The others (tokenizers, XXH64, suffix arrays, page trees, binomial bounds) are compared with
brute force in ``tests/llm``.
"""

from __future__ import annotations

_OP1 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM h WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT h.page_id, payload_bytes, h.payload_digest,
       CASE WHEN f.first < h.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first < h.page_id THEN f.first END AS refers_to
FROM h LEFT JOIN f ON f.payload_digest = h.payload_digest AND h.payload_bytes >= 100
"""

# links by a join of equal labels, components by following links from each vector
_OP7 = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
ok AS (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
       WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
         AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT c.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, c.vec_id = c.component_id AS kept
FROM c LEFT JOIN n ON n.vec_id = c.vec_id
"""

_HASH = "CAST(('0x' || substr(md5({x}), 1, 8)) AS BIGINT)"

# Sainte-Lague seat by seat: every quotient that could win is listed and the highest taken
_OP8 = f"""
WITH d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS sk, coalesce(CAST(doc_id AS VARCHAR), '') AS k,
                  CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size
           FROM documents),
tot AS (SELECT sk, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY sk),
wt AS (SELECT *, [3, 1, 2][CAST((row_number() OVER (ORDER BY sk) - 1) % 3 + 1 AS INTEGER)] AS w, 2 * source_size AS cap FROM tot),
fl AS (SELECT *, cap / w AS q,
              CAST(sum(source_size) OVER () AS BIGINT) * 150 / 100 - coalesce(sum(cap) OVER b, 0) AS lft,
              CAST(sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS BIGINT) AS rest
       FROM wt WINDOW b AS (ORDER BY cap / w, sk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
fo AS (SELECT q AS fq, sk AS fsk, lft AS flft, rest AS frest FROM fl WHERE w * CAST(lft AS DOUBLE) / rest < cap ORDER BY q, sk LIMIT 1),
tg AS (SELECT fl.sk, source_size,
              CASE WHEN fq IS NOT NULL AND (q > fq OR (q = fq AND sk >= fsk)) THEN w * CAST(flft AS DOUBLE) / frest
                   ELSE CAST(cap AS DOUBLE) END AS target
       FROM fl LEFT JOIN fo ON true),
m AS (SELECT CAST(round(sum(target) / 32) AS BIGINT) AS seats, count(*) AS n FROM tg),
qs AS (SELECT sk, target, unnest(generate_series(1, CAST(ceil(target / 32) AS BIGINT) + (SELECT n FROM m))) AS seat FROM tg WHERE target > 0),
qr AS (SELECT sk, row_number() OVER (ORDER BY target / (2 * seat - 1) DESC, sk) AS rk FROM qs),
qb AS (SELECT sk, count(*) AS blocks FROM qr WHERE rk <= (SELECT seats FROM m) GROUP BY sk),
src AS (SELECT tg.sk, source_size, target, coalesce(blocks, 0) AS blocks,
               greatest(1, CAST(ceil(source_size / 1048576) AS BIGINT)) AS shards
        FROM tg LEFT JOIN qb ON qb.sk = tg.sk),
ds AS (SELECT d.*, {_HASH.format(x="'mix:shard:' || k")} % shards AS shard FROM d JOIN src ON src.sk = d.sk),
ce AS (SELECT ds.sk, shard, CAST(sum(size) AS BIGINT) AS csize FROM ds GROUP BY ALL),
cs AS (SELECT ce.*, s.blocks, s.source_size, s.target, count(*) OVER (PARTITION BY ce.sk) AS cells FROM ce JOIN src s ON s.sk = ce.sk),
cq AS (SELECT sk, shard, csize, blocks, unnest(generate_series(1, CAST(ceil(blocks * (csize / source_size)) AS BIGINT) + cells)) AS seat
       FROM cs WHERE csize > 0),
cr AS (SELECT sk, shard, blocks, row_number() OVER (PARTITION BY sk ORDER BY csize / (2 * seat - 1) DESC, shard) AS rk FROM cq),
cb AS (SELECT sk, shard, count(*) AS quota FROM cr WHERE rk <= blocks GROUP BY ALL),
cn AS (SELECT cs.sk, cs.shard, csize, source_size, target, CAST(ceil(csize / 32) AS BIGINT) AS n,
              least(coalesce(quota, 0), 2 * CAST(ceil(csize / 32) AS BIGINT)) AS q
       FROM cs LEFT JOIN cb ON cb.sk = cs.sk AND cb.shard = cs.shard),
ca AS (SELECT *, CASE WHEN n > 0 THEN q // n ELSE 0 END AS copies, CASE WHEN n > 0 THEN q % n ELSE 0 END AS more,
              CASE WHEN n > 0 THEN {_HASH.format(x="'mix:run:' || sk || ':' || CAST(shard AS VARCHAR)")} % n ELSE 0 END AS pos FROM cn),
run AS (SELECT *, pos * 32 AS a1, least((pos + more) * 32, csize) AS b1, greatest(0, (pos + more - n) * 32) AS b2 FROM ca),
pl AS (SELECT ds.*, sum(size) OVER (PARTITION BY sk, shard ORDER BY md5('mix:' || k), doc_id NULLS FIRST, size
                                    ROWS UNBOUNDED PRECEDING) AS stop FROM ds)
SELECT doc_id, size, r.source_size, r.target,
       CAST(copies * size + greatest(0, least(stop, b1) - greatest(stop - size, a1))
            + greatest(0, least(stop, b2) - (stop - size)) AS BIGINT) AS taken
FROM pl JOIN run r ON r.sk = pl.sk AND r.shard = pl.shard
"""

# every 100-byte window as hexadecimal digits; the earliest of equal ones stays
_OP10 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes FROM documents),
s AS (SELECT doc_id, h, unnest(generate_series(0, n_bytes - 100)) AS s FROM d WHERE n_bytes >= 100),
w AS (SELECT doc_id, s, md5(substr(h, 2 * s + 1, 200)) AS w FROM s),
f AS (SELECT doc_id, s, row_number() OVER (PARTITION BY w ORDER BY doc_id, s) AS rk FROM w),
g AS (SELECT doc_id, s, max(s + 99) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
      FROM f WHERE rk > 1),
i AS (SELECT doc_id, s, sum(CASE WHEN reach IS NULL OR s > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM g),
spans AS (SELECT doc_id, k, min(s) AS a, max(s) + 100 AS b FROM i GROUP BY ALL),
gaps AS (SELECT doc_id, a, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS from_byte FROM spans),
parts AS (SELECT g.doc_id, g.a, substr(d.h, 2 * g.from_byte + 1, 2 * (g.a - g.from_byte)) AS part FROM gaps g JOIN d ON d.doc_id = g.doc_id),
sums AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last FROM spans GROUP BY doc_id),
heads AS (SELECT doc_id, string_agg(part, '' ORDER BY a) AS head FROM parts GROUP BY doc_id)
SELECT d.doc_id, d.n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(d.h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN sums ON sums.doc_id = d.doc_id LEFT JOIN heads ON heads.doc_id = d.doc_id
"""

_OP12 = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(d.t) AS text_sha256 FROM d JOIN g ON g.t = d.t
"""

ORACLES: dict = {
    "op1_arc_to_warc": _OP1,
    "op7_embedding_near_dedup": _OP7,
    "op8_mixing_sources": _OP8,
    "op10_suffix_array_dedup": _OP10,
    "op12_exact_dedup": _OP12,
}
