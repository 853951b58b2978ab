"""DuckDB SQL for the operators that SQL can express on whole tables."""

WORD = r"'[^\x20\x09-\x0D]+'"

HOST_RULES = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {WORD}) AS w
           FROM documents)
, windows AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n
              FROM d, unnest(range(1, len(w) - 1)) t(i))
, covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM windows, range(3) u(k) WHERE n > 1 GROUP BY doc_id)
, dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (
            SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
          WHERE regexp_matches(line, {WORD}) GROUP BY doc_id)
, m AS (SELECT d.doc_id, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
        coalesce(covered.n, 0)::BIGINT AS n_repeat_words
        FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN dup USING (doc_id))
, f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, [
        n_symbols > 0.5 * n_words, n_dup_lines >= 3 AND 20 * n_dup_lines > n_words,
        5 * n_repeat_words > n_words, word_chars < 2 * n_words OR word_chars > 14 * n_words] AS soft FROM m)
, host AS (SELECT source, r, count(*) AS n, count(*) FILTER (WHERE soft[r]) AS bad FROM f, range(1, 5) t(r) GROUP BY source, r)
, prior AS (SELECT r, sum(bad) / sum(n) AS mu, sum(n) AS total, count(*) AS hosts, sum(bad * bad / n) AS square FROM host GROUP BY r)
, beta AS (SELECT r, mu, least(greatest(mu * (1 - mu) / greatest(
             square / total - mu * mu - mu * (1 - mu) * hosts / total, 1e-9) - 1, 1.0), 1e6) AS strength FROM prior)
, habit AS (SELECT source, r FROM host JOIN beta USING (r) WHERE (bad + mu * strength) / (n + strength) > 0.4)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND len(list_filter(soft, lambda x: x)) < 3 AND NOT EXISTS (
    SELECT 1 FROM habit WHERE habit.source IS NOT DISTINCT FROM f.source AND soft[habit.r]) AS kept FROM f"""

JACCARD_JOIN = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {WORD}) AS w FROM documents)
, s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS shingle
        FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) t(i) WHERE len(w) > 0)
, n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id)
, p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b
        ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL)
, e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c))
, r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, k.c AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) k USING (doc_id)"""

MIXING = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {WORD}))::BIGINT AS size,
             md5('17|' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents)
, s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source)
, c AS (SELECT *, [5, 2, 1][(k - 1) % 3 + 1] AS weight, 2.0::DOUBLE * source_size AS cap FROM s)
, l AS (SELECT *, cap / weight AS ratio, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (
          ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY cap / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c)
, met AS (SELECT level AS met FROM l WHERE level <= ratio ORDER BY ratio, k LIMIT 1)
, t AS (SELECT k, source, source_size, coalesce(least(cap, weight * (SELECT met FROM met)), cap) AS target,
          greatest(ceil(source_size / 1048576), 1)::BIGINT AS shards FROM l)
, x AS (SELECT d.*, k, source_size, target, ('0x' || h[1:8])::BIGINT % shards AS shard
        FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
, sh AS (SELECT k, shard, sum(size)::BIGINT AS shard_size, ceil(sum(size) / 64)::BIGINT AS blocks FROM x GROUP BY k, shard)
, sb AS (SELECT k, sum(blocks)::BIGINT AS blocks FROM sh GROUP BY k)
, v AS (SELECT k, CASE WHEN source_size > 0 THEN target * blocks / source_size ELSE 0 END AS votes, 2 * blocks AS cap FROM t JOIN sb USING (k))
, q AS (SELECT k, row_number() OVER (ORDER BY votes / (2 * j - 1) DESC, k, j) AS place FROM v, unnest(range(1, cap + 1)) u(j) WHERE votes > 0)
, seats AS (SELECT k, count(*) AS seats FROM q WHERE place <= (SELECT round(sum(votes)) FROM v) GROUP BY k)
, q2 AS (SELECT k, shard, row_number() OVER (PARTITION BY k ORDER BY blocks::DOUBLE / (2 * j - 1) DESC, shard, j) AS place
         FROM sh, unnest(range(1, 2 * blocks + 1)) u(j))
, quota AS (SELECT k, shard, count(*) FILTER (WHERE place <= seats) AS quota FROM q2 JOIN seats USING (k) GROUP BY k, shard)
, y AS (SELECT x.*, shard_size, blocks, coalesce(quota, 0) AS quota,
          (sum(size) OVER (PARTITION BY k, shard ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS lo,
          ('0x' || md5('17|' || k || '|' || shard)[1:8])::BIGINT AS turn
        FROM x JOIN sh USING (k, shard) LEFT JOIN quota USING (k, shard))
, b AS (SELECT y.*, i FROM y, unnest(range(((lo + 1) * blocks - 1) // shard_size, ((lo + size) * blocks - 1) // shard_size + 1)) u(i)
        WHERE size > 0)
, got AS (SELECT doc_id, sum((quota // blocks + CASE WHEN (i * 2147483647 + turn) % blocks < quota % blocks THEN 1 ELSE 0 END)
            * (least(lo + size, (i + 1) * shard_size // blocks) - greatest(lo, i * shard_size // blocks)))::BIGINT AS taken
          FROM b GROUP BY doc_id)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM x LEFT JOIN got USING (doc_id)"""

FILL_IN_MIDDLE = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u FROM documents),
d AS (
  SELECT doc_id, text, u, len(u)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(u) + 1) AS a,
    ('0x' || substr(h, 9, 8))::BIGINT % (len(u) + 1) AS b, ('0x' || substr(h, 17, 8))::BIGINT % 100 AS rate,
    ('0x' || substr(h, 25, 8))::BIGINT % 100 AS kind FROM t),
p AS (
  SELECT doc_id, text, n, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
      OR rate >= 100 THEN 'plain' WHEN kind < 50 THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(u[1:least(a, b)], '') AS prefix, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS middle,
    array_to_string(u[greatest(a, b) + 1:n], '') AS suffix FROM d)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""


def clusters_sql(k: int = 40, rounds: int = 5) -> str:
    """Plain Lloyd rounds, one after the other."""
    tables = [f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id::VARCHAR), embedding) AS rid, vec_id,
  embedding FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64),
v AS MATERIALIZED (SELECT rid, unnest(range(64)) AS dim, unnest(list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT)) AS x
  FROM kept),
c0 AS MATERIALIZED (SELECT rid - 1 AS cluster, dim, x FROM v WHERE rid <= {k})"""]
    for r in range(rounds + 1):
        tables.append(f"""a{r} AS MATERIALIZED (SELECT rid, (m % 64)::INT AS cluster, m // 64 AS distance FROM (
  SELECT rid, min(d * 64 + cluster) AS m FROM (SELECT rid, cluster, sum((v.x - c.x) * (v.x - c.x))::BIGINT AS d
    FROM v JOIN c{r} c USING (dim) GROUP BY rid, cluster) GROUP BY rid))""")
        if r < rounds:
            tables.append(f"""c{r + 1} AS MATERIALIZED (SELECT cluster, dim, ((s - ((s % n) + n) % n) // n)::BIGINT AS x FROM (
  SELECT cluster, dim, sum(x) AS s, count(*) AS n FROM a{r} JOIN v USING (rid) GROUP BY cluster, dim)
  UNION ALL SELECT cluster, dim, x FROM c{r} WHERE cluster NOT IN (SELECT cluster FROM a{r}))""")
    return ",\n".join(tables) + f"""
SELECT vec_id, a.cluster, distance, sum(distance) OVER (PARTITION BY a.cluster)::BIGINT AS cluster_inertia,
  sum(distance) OVER ()::BIGINT AS inertia, h.centroid_sha256
FROM a{rounds} a JOIN kept USING (rid) JOIN (SELECT cluster, sha256(string_agg(x::VARCHAR, ',' ORDER BY dim)) AS centroid_sha256
  FROM c{rounds} GROUP BY cluster) h USING (cluster)"""
