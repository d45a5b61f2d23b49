"""The registered queries of the pipeline operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeflow.llm import bpe, chaining, curriculum, jaccard, licenses, periodic, sketch, slots, spelling, templates, toxicity, vafile, warc
from gaugeflow.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@query
def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary_path())


@query
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


ORACLE["op3_warc"] = r"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), w AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS response FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < response THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < response THEN response END AS refers_to
FROM w
"""


@query
def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.fingerprints(table(spark, sf_dir, "documents"))


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that share a passage with another: spans in words, and the smallest doc_id that has one of them."""
    return chaining.marked(table(spark, sf_dir, "documents")).where(F.col("n_repeated") > 0)


@query
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curriculum.mix(table(spark, sf_dir, "documents"))


def _schedule_sql() -> str:
    """The inverse of each schedule's integral at ``share``."""
    arms = []
    for i, knots in enumerate(curriculum.SCHEDULES):
        total = sum((w0 + w1) * (t1 - t0) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:]))
        before, parts = 0.0, []
        for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
            area, slope = (w0 + w1) * (t1 - t0) / 2, (w1 - w0) / (t1 - t0)
            d = f"(share * {total!r}::DOUBLE - {before!r}::DOUBLE)"
            at = f"{t0!r}::DOUBLE + {d} / {w0!r}::DOUBLE" if slope == 0 else f"{t0!r}::DOUBLE + (sqrt(greatest({w0 * w0!r}::DOUBLE + {2 * slope!r}::DOUBLE * {d}, 0.0::DOUBLE)) - {w0!r}::DOUBLE) / ({slope!r}::DOUBLE)"
            parts.append(f"WHEN share * {total!r}::DOUBLE <= {before + area!r}::DOUBLE THEN {at}")
            before += area
        arms.append(f"WHEN idx % {len(curriculum.SCHEDULES)} = {i} THEN (CASE {' '.join(parts)} ELSE {float(knots[-1][0])!r}::DOUBLE END)")
    return f"CASE {' '.join(arms)} END"


ORACLE["op8_mixing"] = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, text, '')) AS key FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), r AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS idx FROM s
), w AS (
  SELECT *, CASE idx % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, 2 * source_size AS cap FROM r
), l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0)::DOUBLE)
            / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::DOUBLE AS level
  FROM w WINDOW before AS (ORDER BY cap::DOUBLE / weight::DOUBLE, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, idx, source_size, least(cap::DOUBLE, weight * max(level) OVER ()) AS target FROM l
), c AS (
  SELECT d.*, idx, source_size, target,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE + size / 2.0::DOUBLE AS middle
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), k AS (
  SELECT *, CASE WHEN size = 0 THEN 0 ELSE floor(target / source_size)::BIGINT
            + CASE WHEN middle < target - floor(target / source_size) * source_size THEN 1 ELSE 0 END END AS copies FROM c
), p AS (
  SELECT *, least(middle / nullif(target, 0), 1.0::DOUBLE) AS share FROM k
), a AS (
  SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies, idx, middle,
         CASE WHEN copies > 0 THEN {_schedule_sql()} END AS position FROM p
), b AS (
  SELECT *, least((source_size + middle) / nullif(target, 0), 1.0::DOUBLE) AS share FROM a
)
SELECT doc_id, size, source_size, target, taken, position, CASE WHEN copies > 1 THEN {_schedule_sql()} END AS repeat_position FROM b
"""


@query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "text")


ORACLE["op9_line_dedup"] = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents WHERE text IS NOT NULL
), k AS (
  SELECT doc_id, n, line, list_filter(regexp_split_to_array(CASE WHEN regexp_matches(line, '[0-9]')
      THEN regexp_replace(line, '[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*', '<*>', 'g') ELSE line END, '[\x20\x09-\x0D]+'), lambda t: t <> '') AS t FROM l
), p AS (
  SELECT doc_id, n, t, list_concat([len(t)::VARCHAR], t[1:3]) AS leaf FROM k WHERE len(t) > 0
), m AS (
  SELECT t, any_value(leaf) AS leaf, count(DISTINCT doc_id) AS docs, min(doc_id) AS first FROM p GROUP BY t
), e AS (
  SELECT t, leaf, docs, unnest(t) AS field, generate_subscripts(t, 1) AS pos FROM m
), c AS (
  SELECT leaf, pos, field FROM e GROUP BY ALL HAVING sum(docs) >= 3
), w AS (
  SELECT e.t, any_value(e.leaf) AS leaf, list(CASE WHEN c.leaf IS NULL THEN NULL ELSE e.field END ORDER BY e.pos) AS shape
  FROM e LEFT JOIN c ON e.leaf = c.leaf AND e.pos = c.pos AND e.field = c.field GROUP BY e.t
  HAVING count(*) FILTER (c.leaf IS NOT NULL AND e.pos > 3 AND e.field <> '<*>') >= greatest(4, 0.6 * count(*) FILTER (e.pos > 3 AND e.field <> '<*>'))
), g AS (
  SELECT w.leaf, w.shape, min(p.doc_id) AS first FROM p JOIN w ON p.t = w.t GROUP BY w.leaf, w.shape HAVING count(DISTINCT p.doc_id) >= 3
), r AS (
  SELECT w.t, g.first FROM w JOIN g ON w.leaf = g.leaf AND w.shape = g.shape
), a AS (
  SELECT t, first FROM r UNION ALL SELECT t, first FROM m WHERE docs >= 3 AND t NOT IN (SELECT t FROM r)
), x AS (
  SELECT p.doc_id, p.n FROM p JOIN a ON p.t = a.t WHERE p.doc_id <> a.first
)
SELECT d.doc_id,
       (SELECT count(*) FROM l WHERE l.doc_id = d.doc_id)::INTEGER AS n_lines,
       (SELECT count(*) FROM x WHERE x.doc_id = d.doc_id)::INTEGER AS n_dropped,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce((SELECT string_agg(l.line, chr(10) ORDER BY l.n) FROM l LEFT JOIN x ON l.doc_id = x.doc_id AND l.n = x.n
         WHERE l.doc_id = d.doc_id AND x.n IS NULL), '') END AS text
FROM documents d
"""


@query
def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLE["op10_exact_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query
def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of near equal bytes; ``virtual_slot`` is the slot that the map deals, ``slot`` the place in the shard."""
    return slots.placed(table(spark, sf_dir, "documents"))


ORACLE["op11_sharding"] = """
WITH RECURSIVE h AS (  -- four bits of the checksum's polynomial at a time
  SELECT list(list_reduce([n] || range(4), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY n) AS tab FROM range(16) t(n)
), d AS (  -- the bytes of UTF-8
  SELECT doc_id, flatten(list_transform(list_transform(string_split(coalesce(text, ''), ''), lambda x: coalesce(unicode(nullif(x, '')), -1)::BIGINT),
           lambda x: CASE WHEN x < 0 THEN [] WHEN x < 128 THEN [x] WHEN x < 2048 THEN [192 + x // 64, 128 + x % 64]
             WHEN x < 65536 THEN [224 + x // 4096, 128 + x // 64 % 64, 128 + x % 64] ELSE [240 + x // 262144, 128 + x // 4096 % 64, 128 + x // 64 % 64, 128 + x % 64] END)) AS bytes,
         row_number() OVER () AS row FROM documents
), n AS (
  SELECT row, bytes, len(bytes) % 256 AS rest, len(bytes) // 256 AS blocks FROM d
), b AS (  -- the first block has what is over, the others 256 bytes
  SELECT row, blocks - j AS behind, [CASE WHEN j = 0 THEN 4294967295 ELSE 0 END::BIGINT] || CASE WHEN j = 0 THEN bytes[1:rest] ELSE bytes[rest + 256 * j - 255:rest + 256 * j] END AS block
  FROM (SELECT *, unnest(range(blocks + 1)) AS j FROM n)
), e AS (
  SELECT row, behind, list_reduce(block, lambda c, x: xor(xor(xor(c, x) // 16, tab[xor(c, x) % 16 + 1]) // 16, tab[xor(xor(c, x) // 16, tab[xor(c, x) % 16 + 1]) % 16 + 1])) AS state FROM b, h
), p AS (  -- what each bit of a state becomes behind so many blocks of zeros
  SELECT 0::BIGINT AS behind, list_transform(range(32), lambda i: (2 ** i)::BIGINT) AS bits
  UNION ALL
  SELECT behind + 1, list_transform(bits, lambda x: list_reduce([x] || range(512), lambda c, k: xor(c // 16, tab[c % 16 + 1]))) FROM p, h WHERE behind < (SELECT max(blocks) FROM n)
), c AS (
  SELECT d.doc_id, len(d.bytes)::BIGINT + 8 AS size, xor(x.state, 4294967295) AS text_crc32
  FROM d JOIN (SELECT row, bit_xor(list_reduce([0::BIGINT] || range(32), lambda c, i: CASE WHEN state // (2 ** i)::BIGINT % 2 = 1 THEN xor(c, bits[i + 1]) ELSE c END)) AS state
               FROM e JOIN p ON e.behind = p.behind GROUP BY row) x ON d.row = x.row
), r AS (
  SELECT *, ('0x' || md5(coalesce(doc_id::VARCHAR, '') || ':' || text_crc32 || ':' || size)[1:3])::BIGINT AS virtual_slot FROM c
), s AS (
  SELECT virtual_slot, sum(size)::BIGINT AS bytes, count(*) AS n, row_number() OVER (ORDER BY sum(size) DESC, virtual_slot) AS k FROM r GROUP BY virtual_slot
), g AS (  -- the largest slot that is left goes to the shard with fewest bytes
  SELECT 0::BIGINT AS k, NULL::BIGINT AS virtual_slot, NULL::INTEGER AS shard, 0::BIGINT AS n, list_transform(range(24), lambda i: 0::BIGINT) AS loads
  UNION ALL
  SELECT s.k, s.virtual_slot, (list_position(g.loads, list_min(g.loads)) - 1)::INTEGER, s.n,
         list_transform(g.loads, lambda x, i: CASE WHEN i = list_position(g.loads, list_min(g.loads)) THEN x + s.bytes ELSE x END)
  FROM g JOIN s ON s.k = g.k + 1
), m AS (
  SELECT virtual_slot, shard, coalesce(sum(n) OVER (PARTITION BY shard ORDER BY virtual_slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins FROM g WHERE k > 0
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, (begins + row_number() OVER (PARTITION BY r.virtual_slot ORDER BY doc_id, text_crc32, size) - 1)::BIGINT AS slot,
       NULL::INTEGER AS grown_shard, r.virtual_slot
FROM r JOIN m ON r.virtual_slot = m.virtual_slot
"""


@query
def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"), edit=True)


ORACLE["op12_spelling"] = r"""
WITH w AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS run FROM documents
), p AS (
  SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS key, run, count(*) AS n,
         (SELECT list(list_reduce([n] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY n) FROM range(256) t(n)) AS tab
  FROM w WHERE length(run) >= 6 GROUP BY ALL
), b AS (  -- the bytes of UTF-8
  SELECT run, n, tab, flatten(list_transform(list_transform(string_split(key, ''), lambda x: unicode(x)::BIGINT), lambda x: CASE WHEN x < 128 THEN [x] ELSE [192 + x // 64, 128 + x % 64] END)) AS bytes FROM p
), h AS (
  SELECT run, n, xor(list_reduce([4294967295::BIGINT] || bytes, lambda c, x: xor(c // 256, tab[xor(c % 256, x) + 1])), 4294967295::BIGINT) AS h FROM b
), v AS (
  SELECT CASE WHEN h % 199 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, sum(n)::BIGINT AS n FROM h GROUP BY 1 HAVING length(word) >= 6 AND sum(n) >= 5
), k AS (  -- levenshtein compares bytes: a byte for each letter
  SELECT *, translate(word, (SELECT string_agg(chr(c::INTEGER), '' ORDER BY c) FROM range(192, 256) t(c)), (SELECT string_agg(chr(c::INTEGER), '' ORDER BY c) FROM range(32, 96) t(c))) AS flat FROM v
), s AS (
  SELECT l.word, r.word AS near, r.n AS near_n FROM k l JOIN k r ON abs(length(l.word) - length(r.word)) <= 1 AND levenshtein(l.flat, r.flat) = 1
), f AS (
  SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM s GROUP BY word
), g AS (
  SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN near_n >= 5 * v.n THEN near END AS form, CASE WHEN near_n >= 5 * v.n THEN near_n END AS form_n FROM v LEFT JOIN f ON v.word = f.word
), t AS (
  WITH RECURSIVE c AS (SELECT word, word AS here, form AS onward FROM g UNION ALL SELECT c.word, g.word, g.form FROM c JOIN g ON c.onward = g.word)
  SELECT word, here AS root FROM c WHERE onward IS NULL
)
SELECT g.word, form, root, n, n_near, form_n FROM g JOIN t ON g.word = t.word
"""


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(table(spark, sf_dir, "documents"))


ORACLE["op13_periodic_runs"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, (SELECT list(list_reduce([n] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY n) FROM range(256) t(n)) AS tab FROM documents
), h AS (
  SELECT doc_id, w, len(w)::BIGINT AS n, xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, b: xor(c // 256, tab[xor(c % 256, b) + 1])), 4294967295::BIGINT) AS h FROM d
), g AS (
  SELECT *, (h // 10) % nullif(n, 0) AS a, (h // 10) % 8 AS k FROM h
), e AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + k)) END + 1]) ELSE w END AS w FROM g
), x AS (
  SELECT doc_id, n, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM e
), t AS (
  SELECT doc_id, i, n, word, lead(word) OVER o AS b, lead(word, 2) OVER o AS c FROM x WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), p AS (  -- three words, and the same three q words on
  SELECT l.doc_id, l.i, r.i - l.i AS q FROM t l JOIN t r ON l.doc_id = r.doc_id AND l.word = r.word AND l.b = r.b AND l.c = r.c AND r.i > l.i AND 4 * (r.i - l.i) <= l.n
), s AS (
  SELECT doc_id, q, min(i) AS start, count(*) + 2 + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM p) GROUP BY doc_id, q, island
), r AS (  -- multiples of a period give the same stretch
  SELECT doc_id, start::BIGINT AS start, length::BIGINT AS length, min(q)::BIGINT AS period FROM s WHERE length >= greatest(6, 4 * q) GROUP BY doc_id, start, length
), a AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs FROM r GROUP BY doc_id
), b AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length::DOUBLE / period DESC, start, period) AS k FROM r) WHERE k = 1
), z AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM x
  WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = x.doc_id AND x.i >= r.start + r.period AND x.i < r.start + r.length) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start, length, period, (1000 * length // period)::BIGINT AS exponent_milli,
       sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(z.text, '')) AS collapsed_sha256
FROM d LEFT JOIN a ON d.doc_id = a.doc_id LEFT JOIN b ON d.doc_id = b.doc_id LEFT JOIN z ON d.doc_id = z.doc_id
"""
