"""DuckDB SQL for the queries of this subpackage that SQL can express."""

RUNS = r"""
WITH tab AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
hashed AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ow,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM documents, tab),
places AS (SELECT *, len(ow) AS n, (h // 10) % greatest(len(ow), 1) AS a, (h // 10) % 8 + 3 AS d, h % 10 = 0 AND len(ow) > 0 AS periodic FROM hashed),
changed AS (
  SELECT r, doc_id, n, CASE WHEN periodic THEN list_concat(ow[:a], flatten(list_transform(range(12), lambda x: ow[a + 1:a + p]))[:n - a]) ELSE ow END AS words
  FROM (SELECT *, 1 + (n - a) // d AS p FROM places)),
w AS (SELECT r, n, unnest(words) AS word, unnest(range(n)) AS i FROM changed),
same AS (
  SELECT x.r, y.i - x.i AS q, x.i FROM w x JOIN w y ON x.r = y.r AND x.word = y.word AND y.i > x.i AND y.i - x.i <= x.n // 4),
island AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS g FROM same),
found AS (SELECT r, q, min(i) AS s, count(*) + q AS l FROM island GROUP BY r, q, g HAVING count(*) + q >= greatest(6, 4 * q)),
run AS (SELECT r, s, l, min(q) AS q FROM found GROUP BY r, s, l),
per_doc AS (
  SELECT r, count(*) AS n_runs, string_agg(concat(s, ',', l, ',', q, chr(10)), '' ORDER BY s, q) AS lines,
    first({'start': s, 'length': l, 'period': q} ORDER BY l DESC, s, q) AS best
  FROM run GROUP BY r),
kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY i) AS collapsed
  FROM w ANTI JOIN (SELECT DISTINCT r AS rr, unnest(range(s + q, s + l)) AS ii FROM run) ON r = rr AND i = ii GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length, best.period AS period,
  best.length * 1000 // best.period AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM changed LEFT JOIN per_doc USING (r) LEFT JOIN kept USING (r)
"""

MIX = r"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS z, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number FROM sized GROUP BY source),
weighted AS (SELECT *, [5, 2, 1][number % 3 + 1] AS w, (SELECT sum(z)::BIGINT FROM src) AS total FROM src),
ordered AS (
  SELECT *, row_number() OVER o AS place, (sum(3 * z) OVER o - 3 * z)::BIGINT AS capped, (sum(w) OVER () - sum(w) OVER o + w)::BIGINT AS free
  FROM weighted WINDOW o AS (ORDER BY z / w, number)),
level AS (SELECT min_by((total - capped) / free, place) AS lambda_ FROM ordered WHERE w * ((total - capped) / free) <= 3 * z),
target AS (SELECT source, number, z, total, least(w * lambda_, (3 * z)::DOUBLE) AS target FROM weighted, level),
quotient AS (SELECT number, target, unnest(range((3 * z + 15) // 16)) AS k FROM target),
seats AS (
  SELECT number, count(*) AS q FROM (SELECT number, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, number, k) AS place FROM quotient)
  WHERE place <= (SELECT (2 * sum(z) + 16) // 32 FROM src) GROUP BY number),
shard AS (SELECT number, source, t, least(1048576, z - 1048576 * t) AS z FROM (SELECT *, unnest(range((z + 1048575) // 1048576)) AS t FROM target)),
shard_quotient AS (SELECT number, t, z, unnest(range((3 * z + 15) // 16)) AS k FROM shard),
quota AS (
  SELECT number, t, count(*) AS q
  FROM (SELECT number, t, row_number() OVER (PARTITION BY number ORDER BY z / (2 * k + 1) DESC, t, k) AS place FROM shard_quotient) JOIN seats USING (number)
  WHERE place <= q GROUP BY number, t),
block AS (
  SELECT number, t, z, k, row_number() OVER (PARTITION BY number, t ORDER BY 16 * k // z, md5(concat('0:', t, ':', k, ':', coalesce(source, ''))), k) AS place
  FROM shard_quotient JOIN (SELECT number, source FROM target) USING (number)),
chosen AS (SELECT number, t, z, k FROM block JOIN quota USING (number, t) WHERE place <= q),
placed AS (
  SELECT row_number() OVER () AS r, d.*, number, x.z AS source_size, target, sum(size) OVER (PARTITION BY number ORDER BY doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING) - size AS s
  FROM sized d JOIN target x ON d.source IS NOT DISTINCT FROM x.source),
piece AS (
  SELECT r, p.number, h.t, p.pass * h.z + greatest(s - h.t * 1048576, 0) AS lo, p.pass * h.z + least(s + size - h.t * 1048576, h.z) AS hi
  FROM (SELECT *, unnest(range(3)) AS pass FROM placed WHERE size > 0) p JOIN shard h ON p.number = h.number AND h.t BETWEEN s // 1048576 AND (s + size - 1) // 1048576),
part AS (SELECT *, unnest(range((lo // 16)::BIGINT, ((hi - 1) // 16 + 1)::BIGINT)) AS k FROM piece),
took AS (SELECT r, sum(least(hi, 16 * k + 16) - greatest(lo, 16 * k))::BIGINT AS taken FROM part JOIN chosen USING (number, t, k) GROUP BY r)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM placed LEFT JOIN took USING (r)
"""

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

RANKED = f"""
WITH word AS (SELECT r, doc_id, unnest({_TERMS}) AS term FROM (SELECT row_number() OVER () AS r, * FROM documents)),
tf AS (SELECT r, doc_id, term, count(*) AS tf FROM word GROUP BY r, doc_id, term),
length AS (SELECT r, sum(tf)::BIGINT AS n FROM tf GROUP BY r),
total AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM length),
normal AS (SELECT r, 25 + (75 * n * n_docs) // n_terms AS m FROM length, total),
weight AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term, n_docs),
asked AS (SELECT q, item_id, unnest({_TERMS}) AS term FROM (SELECT row_number() OVER () AS q, * FROM benchmark)),
score AS (
  SELECT q, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM asked JOIN tf USING (term) JOIN weight USING (term) JOIN normal USING (r) GROUP BY q, item_id, r, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM score WHERE score > 0) WHERE rank <= 10
"""
