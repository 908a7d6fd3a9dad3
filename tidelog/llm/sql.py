"""DuckDB SQL of the corpus operators."""

EXACT_DEDUP = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256
FROM d JOIN g USING (text_sha256)
"""

LINE_DEDUP = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
p AS (SELECT doc_id, lines, unnest(range(0, len(lines) - 2)) AS pos FROM d),
w AS (
  SELECT doc_id, pos, array_to_string(lines[pos + 1:pos + 3], chr(10)) AS key FROM p
  WHERE len(list_filter(lines[pos + 1:pos + 3], lambda x: trim(x, ' ') != '')) > 0
),
f AS (SELECT key, min({'d': doc_id, 'p': pos}) AS first FROM w GROUP BY key HAVING count(*) > 1),
later AS (SELECT doc_id, pos FROM w JOIN f USING (key) WHERE {'d': doc_id, 'p': pos} > first),
gone AS (SELECT DISTINCT doc_id, unnest([pos, pos + 1, pos + 2]) AS line FROM later),
g AS (SELECT doc_id, list(line) AS gone FROM gone GROUP BY doc_id)
SELECT doc_id,
  CASE WHEN gone IS NULL THEN text ELSE coalesce(array_to_string(
    [x.l for x in list_zip(lines, range(len(lines))) if NOT list_contains(gone, x.i)], chr(10)), '') END AS text,
  coalesce(len(lines), 0) AS n_lines, coalesce(len(gone), 0) AS n_removed
FROM d LEFT JOIN g USING (doc_id)
""".replace("list_zip(lines, range(len(lines)))", "list_transform(lines, lambda l, i: {'l': l, 'i': i - 1})")

MIXING = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(list_filter(
    regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda w: w != '')), 0) AS size,
    md5('17:' || coalesce(doc_id::VARCHAR, '')) AS place
  FROM documents
),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM d GROUP BY source
),
fill(round, source, source_size, weight, stopped, level) AS (
  SELECT 0, source, source_size, weight, false,
    sum(source_size) OVER ()::DOUBLE / sum(weight) OVER ()::DOUBLE FROM s
  UNION ALL
  SELECT round + 1, source, source_size, weight, now_stopped,
    ((sum(source_size) OVER () - coalesce(sum(3 * source_size) FILTER (now_stopped) OVER (), 0))::DOUBLE
      / nullif(sum(weight) FILTER (NOT now_stopped) OVER (), 0)::DOUBLE)
  FROM (SELECT *, stopped OR 3 * source_size <= level * weight AS now_stopped FROM fill)
  WHERE round < (SELECT count(*) FROM s)
),
t AS (
  SELECT source, source_size, CASE WHEN stopped THEN (3 * source_size)::DOUBLE ELSE level * weight END AS target
  FROM fill WHERE round = (SELECT count(*) FROM s)
),
b AS (
  SELECT sum(source_size)::BIGINT AS total, greatest(1, floor(min(target) / 200)::BIGINT,
    ceil(sum(source_size) / 1048576)::BIGINT) AS block FROM t WHERE target > 0
),
quotients AS (
  SELECT source, target / (2 * k + 1) AS quotient, k
  FROM (SELECT source, target, unnest(range(0, (SELECT round(total / block)::BIGINT FROM b))) AS k FROM t WHERE target > 0)
),
won AS (
  SELECT source, count(*) AS quota FROM (
    SELECT source, row_number() OVER (ORDER BY quotient DESC, source NULLS LAST, k) AS place FROM quotients
  ) WHERE place <= (SELECT round(total / block)::BIGINT FROM b) GROUP BY source
),
plan AS (
  SELECT t.source, source_size, target, coalesce(quota, 0) AS quota,
    ceil(source_size / (SELECT block FROM b))::BIGINT AS blocks
  FROM t LEFT JOIN won ON t.source IS NOT DISTINCT FROM won.source
),
rates AS (SELECT *, least(quota // greatest(blocks, 1), 3) AS n_passes FROM plan),
picks AS (SELECT *, CASE WHEN n_passes < 3 THEN quota - n_passes * blocks ELSE 0 END AS picks FROM rates),
placed AS (
  SELECT doc_id, source, size, sum(size) OVER (PARTITION BY source ORDER BY place, doc_id, size
    ROWS UNBOUNDED PRECEDING)::BIGINT - size AS a FROM d
),
x AS (
  SELECT doc_id, size, source_size, target, n_passes, picks, blocks, a, (SELECT block FROM b) AS block
  FROM placed p JOIN picks q ON p.source IS NOT DISTINCT FROM q.source
)
SELECT doc_id, size, source_size, target, n_passes::BIGINT AS n_passes,
  (n_passes * size + CASE WHEN size > 0 AND picks > 0 THEN coalesce(list_sum(list_transform(
    range(a // block, (a + size - 1) // block + 1),
    lambda j: CASE WHEN (j * 2147483647 + 17) % blocks < picks
      THEN least(a + size, (j + 1) * block) - greatest(a, j * block) ELSE 0 END)), 0) ELSE 0 END)::BIGINT AS taken
FROM x
"""

MINHASH = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x20\\x09-\\x0D]+'), lambda x: x != '') AS w FROM documents
),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS shingle
  FROM w
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS same FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id
  GROUP BY ALL
),
e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * same >= 85 * (x.n + y.n - same)
),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(doc_id, reached) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, b FROM r JOIN both_ways ON a = reached
),
c AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
"""

EMBEDDING_DEDUP = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
e AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id != y.vec_id
  WHERE list_cosine_similarity(x.v, y.v) >= 0.98
),
n AS (SELECT a AS vec_id, count(*) AS n FROM e GROUP BY a),
r(vec_id, reached) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.vec_id, b FROM r JOIN e ON a = reached),
c AS (SELECT vec_id, min(reached) AS component_id FROM r GROUP BY vec_id)
SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM v LEFT JOIN n USING (vec_id) JOIN c USING (vec_id)
"""


def centroids(k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """Every round as a pair of tables: all squared distances, then the floors of the means."""
    parts = [
        f"""e AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE len(embedding) = {dims}
  AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
r AS MATERIALIZED (SELECT vec_id, x, row_number() OVER () AS row FROM e),
v AS MATERIALIZED (SELECT row, unnest(range({dims})) AS i, unnest(list_transform(x, lambda c: floor({scale} * c)::BIGINT)) AS x FROM r),
f AS (SELECT row, row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(vec_id::VARCHAR, '')), x) - 1 AS c FROM r),
c0 AS MATERIALIZED (SELECT c, i, x AS y FROM f JOIN v USING (row) WHERE c < {k})"""
    ]
    for n in range(rounds + 1):
        parts.append(
            f"""a{n} AS MATERIALIZED (SELECT row, min(c) AS c, min(d)::BIGINT AS d FROM (
  SELECT *, min(d) OVER (PARTITION BY row) AS least FROM (SELECT row, c, sum((x - y) * (x - y)) AS d FROM v JOIN c{n} USING (i) GROUP BY row, c)
) WHERE d = least GROUP BY row)"""
        )
        if n < rounds:
            # A mean is rounded down: an integer division of a number that isn't negative.
            parts.append(
                f"""m{n} AS (SELECT c, i, ((s % n) + n) % n AS over, s, n FROM (SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM a{n} JOIN v USING (row) GROUP BY c, i)),
c{n + 1} AS MATERIALIZED (SELECT c, i, coalesce((s - over) // n, y) AS y FROM c{n} LEFT JOIN m{n} USING (c, i))"""
            )
    return (
        "WITH "
        + ",\n".join(parts)
        + f""",
g AS (SELECT c, sha256(string_agg(y::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
  (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a{rounds} JOIN r USING (row) JOIN g USING (c)
"""
    )


PERIODIC_RUNS = """
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x != '') AS w,
    xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
      string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda s: [ord(s)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END), 4294967295) AS h
  FROM documents
),
p AS (SELECT *, len(w) AS n, h // 10 AS g FROM d),
o AS (SELECT *, g % greatest(n, 1) AS a, 1 + (n - g % greatest(n, 1)) // (3 + g % 8) AS p FROM p),
t AS MATERIALIZED (
  SELECT doc_id, n, row_number() OVER () AS row, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n),
    lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w FROM o
),
x AS MATERIALIZED (SELECT row, n, unnest(range(n)) AS i, unnest(w) AS word FROM t),
e AS (
  SELECT a.row, b.i - a.i AS q, a.i FROM x a JOIN x b ON a.row = b.row AND a.word = b.word AND b.i > a.i AND 4 * (b.i - a.i) <= a.n
),
s AS (
  SELECT row, q, min(i) AS start, count(*) + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY row, q ORDER BY i) AS stretch FROM e)
  GROUP BY row, q, stretch HAVING count(*) + q >= greatest(6, 4 * q)
),
r AS MATERIALIZED (SELECT row, start, length, min(q) AS period FROM s GROUP BY row, start, length),
best AS (SELECT row, start, length, period, 1000 * length // period AS exponent_milli FROM r
  QUALIFY row_number() OVER (PARTITION BY row ORDER BY length / period DESC, start, period) = 1),
every AS (SELECT row, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs FROM r GROUP BY row),
gone AS (SELECT DISTINCT row, unnest(range(start + period, start + length)) AS i FROM r),
kept AS (SELECT row, string_agg(word, ' ' ORDER BY i) AS words FROM x ANTI JOIN gone USING (row, i) GROUP BY row)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256,
  sha256(coalesce(words, '')) AS collapsed_sha256
FROM t LEFT JOIN best USING (row) LEFT JOIN every USING (row) LEFT JOIN kept USING (row)
"""
