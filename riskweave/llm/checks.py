"""SQL that gives the rows of the queries that SQL can express."""

from __future__ import annotations

#: XXH64 fingerprints, BPE ids, parser events, canonical JSON and learned rules have no SQL here;
#: their queries are tested against plain Python.

_UNIT = "(CAST('0x' || substr(md5(k || '#' || s), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0"

OP1 = f"""
WITH crc AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps),
d AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS k, hex(encode(coalesce(text, ''))) AS h FROM documents),
e AS (SELECT doc_id, k, CAST(len(h) // 2 + 16 AS BIGINT) AS size,
    CAST(xor(list_reduce(list_concat([4294967295],
      list_transform(regexp_extract_all(h, '..'), lambda b: CAST('0x' || b AS BIGINT))),
      lambda c, b: xor(c >> 8, steps[CAST(xor(c, b) & 255 AS INT) + 1])), 4294967295) AS BIGINT) AS text_crc32,
    list_transform(range(41), lambda s: -1.0 / ln({_UNIT})) AS scores FROM d, crc),
f AS (SELECT *, CAST(list_position(scores[1:40], list_max(scores[1:40])) - 1 AS INT) AS shard,
    CAST(list_position(scores, list_max(scores)) - 1 AS INT) AS grown_shard FROM e)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, CAST(row_number() OVER (PARTITION BY shard
    ORDER BY substr(md5(k), 1, 2), doc_id NULLS FIRST, size, text_crc32) - 1 AS BIGINT) AS slot, grown_shard
FROM f"""

OP6 = """
WITH v AS (SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_distance(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS place FROM p)
SELECT query_id, CAST(place AS INT) AS rank, vec_id, score FROM r WHERE place <= 10"""


def op7(weights: dict[str, int], other: int, block_rows: int) -> str:
    listed = " ".join(f"WHEN '={name}' THEN {weight}" for name, weight in weights.items())
    return f"""
WITH RECURSIVE r AS (SELECT doc_id, source, count(*) AS copies, coalesce('=' || source, '?') AS nm,
    substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 2) AS b FROM documents GROUP BY doc_id, source),
k AS (SELECT *, CAST(coalesce(sum(copies) OVER (PARTITION BY nm ORDER BY b, doc_id NULLS FIRST
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rk FROM r),
s AS (SELECT nm, CASE nm {listed} ELSE {other} END AS w,
    CAST((sum(copies) + {block_rows} - 1) // {block_rows} AS BIGINT) AS n FROM k GROUP BY nm),
cuts AS (SELECT 0 AS m UNION SELECT n // w FROM s UNION SELECT n // w + 1 FROM s),
sp AS (SELECT m AS first, lead(m) OVER (ORDER BY m) AS stop FROM cuts),
c AS (SELECT first, stop, nm, greatest(0, least(w, n - first * w)) AS cnt, least(n, first * w) AS before
  FROM sp, s WHERE stop IS NOT NULL),
t AS (SELECT first, any_value(stop) AS stop, CAST(sum(cnt) AS BIGINT) AS slots, CAST(sum(before) AS BIGINT) AS start,
    list(CAST(cnt AS BIGINT) ORDER BY nm) AS counts, list(nm ORDER BY nm) AS names FROM c GROUP BY first HAVING sum(cnt) > 0),
sim AS (
  SELECT first, CAST(-1 AS BIGINT) AS t, list_transform(counts, lambda x: CAST(0 AS BIGINT)) AS taken,
    CAST(NULL AS STRUCT(d BIGINT, i BIGINT, j BIGINT, r BIGINT)) AS pick FROM t
  UNION ALL
  SELECT first, t, list_transform(taken, lambda x, i: x + CASE WHEN i = pick.i + 1 THEN 1 ELSE 0 END), pick FROM (
    SELECT sim.first, sim.t + 1 AS t, taken, list_min(list_transform(
      list_filter(range(len(counts)), lambda i: taken[i + 1] < counts[i + 1]
        AND taken[i + 1] * slots // greatest(counts[i + 1], 1) <= sim.t + 1),
      lambda i: {{'d': ((taken[i + 1] + 1) * slots + counts[i + 1] - 1) // counts[i + 1], 'i': i,
        'j': taken[i + 1], 'r': taken[i + 1] * slots // counts[i + 1]}})) AS pick
    FROM sim JOIN t ON t.first = sim.first WHERE sim.t + 1 < slots)),
plan AS (SELECT t.first, t.stop, t.slots, t.start, names[sim.pick.i + 1] AS nm, sim.t, sim.pick.j AS j,
    sim.pick.r AS rel, sim.pick.d AS dl FROM sim JOIN t ON t.first = sim.first WHERE sim.t >= 0),
q AS (SELECT k.*, rk // {block_rows} AS block, rk // {block_rows} // w AS period, (rk // {block_rows}) % w AS j
  FROM k JOIN s ON s.nm = k.nm)
SELECT doc_id, source, copies, q.block, start + (period - first) * slots + rel AS release,
  start + (period - first) * slots + dl AS deadline, start + (period - first) * slots + t AS slot,
  CAST(rk % {block_rows} AS INT) AS place
FROM q JOIN plan ON plan.nm = q.nm AND plan.j = q.j AND period >= first AND period < stop"""


_CRC_STEPS = """crc AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps)"""


def op11(parts: int, entries: int, rounds: int, scale: int) -> str:
    """The rounds written one after the other over (row, part) and (part, entry) tables."""

    def assigned(n: int) -> str:
        return f"""a{n} AS (SELECT rn, pos, arg_min(e, d * {entries} + e) AS e, min(d) AS d FROM (
  SELECT p.rn, p.pos, c.e, list_inner_product(p.x, p.x) - 2 * list_inner_product(p.x, c.x)
    + list_inner_product(c.x, c.x) AS d FROM p JOIN c{n} c USING (pos)) GROUP BY ALL)"""

    def updated(n: int) -> str:
        return f"""u{n} AS (SELECT pos, e, list(m ORDER BY i) AS x FROM (
  SELECT pos, e, i, floor(sum(p.x[i]) / count(*)) AS m FROM a{n} JOIN p USING (rn, pos),
    unnest(range(1, len(p.x) + 1)) AS t(i) GROUP BY ALL) GROUP BY ALL),
c{n + 1} AS (SELECT c.pos, c.e, coalesce(u.x, c.x) AS x FROM c{n} c LEFT JOIN u{n} u USING (pos, e))"""

    steps = ",\n".join(f"{assigned(n)},\n{updated(n)}" for n in range(rounds))
    return f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * CAST(x AS DOUBLE))) AS c
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
r AS (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, c) AS rn FROM v),
p AS (SELECT rn, pos, c[pos * (len(c) // {parts}) + 1 : (pos + 1) * (len(c) // {parts})] AS x
  FROM r, unnest(range({parts})) AS t(pos)),
c0 AS (SELECT pos, rn - 1 AS e, x FROM p WHERE rn <= {entries}),
{steps},
{assigned(rounds)},
f AS (SELECT rn, string_agg(printf('%02x', e), '' ORDER BY pos) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM a{rounds} GROUP BY rn),
s AS (SELECT sha256(string_agg(CAST(CAST(m AS BIGINT) AS VARCHAR), ',' ORDER BY pos, e, i)) AS digest FROM (
  SELECT pos, e, i, x[i] AS m FROM c{rounds}, unnest(range(1, len(x) + 1)) AS t(i)))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  digest AS codebooks_sha256 FROM r JOIN f USING (rn), s"""


def op12(every: int, letters: int, least: int, ratio: int) -> str:
    """Words one letter apart meet on what deleting a letter leaves."""
    return f"""
WITH RECURSIVE {_CRC_STEPS},
run AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS k, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r FROM documents),
runs AS (SELECT k, r, count(*) AS copies, hex(encode(k || ':' || r)) AS x FROM run WHERE length(r) >= {letters} GROUP BY k, r),
hashed AS (SELECT r, copies, CAST(xor(list_reduce(list_concat([4294967295],
      list_transform(regexp_extract_all(x, '..'), lambda b: CAST('0x' || b AS BIGINT))),
      lambda c, b: xor(c >> 8, steps[CAST(xor(c, b) & 255 AS INT) + 1])), 4294967295) AS BIGINT) AS h FROM runs, crc),
spelt AS (SELECT CASE WHEN h % {every} = 0 THEN left(r, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word,
    copies FROM hashed),
w AS MATERIALIZED (SELECT word, CAST(sum(copies) AS BIGINT) AS n FROM spelt WHERE length(word) >= {letters} GROUP BY word
  HAVING sum(copies) >= {least}),
cut AS MATERIALIZED (SELECT word, i, left(word, i) || substr(word, i + 2) AS rest FROM w, unnest(range(length(word))) AS t(i)),
near AS (SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, w.word FROM cut c JOIN w ON c.rest = w.word
  UNION SELECT w.word, c.word FROM cut c JOIN w ON c.rest = w.word),
told AS (SELECT near.word, count(*) AS n_near, arg_min(other, (-w.n, other)) AS best, max(w.n) AS best_n
  FROM near JOIN w ON w.word = near.other GROUP BY 1),
judged AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= {ratio} * w.n THEN best END AS form,
    CASE WHEN best_n >= {ratio} * w.n THEN best_n END AS form_n FROM w LEFT JOIN told USING (word)),
walk AS (SELECT word, word AS here FROM judged
  UNION ALL SELECT walk.word, j.form FROM walk JOIN judged j ON j.word = walk.here WHERE j.form IS NOT NULL),
ends AS (SELECT walk.word, here AS root FROM walk JOIN judged j ON j.word = walk.here WHERE j.form IS NULL)
SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM judged JOIN ends USING (word)"""


def op13(words: int) -> str:
    return f"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST) AS r, doc_id,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT r, s, array_to_string(w[s + 1 : s + {words}], ' ') AS said FROM d, unnest(range(len(w) - {words - 1})) AS t(s)),
later AS (SELECT r, s FROM (SELECT r, s, row_number() OVER (PARTITION BY said ORDER BY r, s) AS place FROM s) WHERE place > 1),
gone AS (SELECT r, list(DISTINCT s + i) AS places FROM later, unnest(range({words})) AS t(i) GROUP BY r),
kept AS (SELECT r, string_agg(w[i + 1], ' ' ORDER BY i) AS said, count(*) AS n FROM (
  SELECT d.r, w, i FROM d, unnest(range(len(w))) AS t(i)
  EXCEPT ALL SELECT d.r, w, i FROM d JOIN gone USING (r), unnest(places) AS t(i)) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(said, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)"""
