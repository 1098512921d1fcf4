"""SQL twins of the queries that SQL can express."""

QUALITY = r"""WITH tok AS (
  SELECT doc_id, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l,
    row_number() OVER () AS r
  FROM documents),
win AS (
  SELECT r, i, w[i:i+4] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM tok WHERE len(w) >= 5)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, range(5) t(k) GROUP BY r),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
    length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
    len(l)::BIGINT AS n_lines,
    length(regexp_replace(t, '[^\p{Lu}]', '', 'g'))::BIGINT AS n_capitals,
    length(regexp_replace(t, '[^!]', '', 'g'))::BIGINT AS n_exclamations,
    len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1]))::BIGINT AS n_stutters,
    length(regexp_replace(t, '[^\x{0E00}-\x{0FFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{2E80}-\x{312F}\x{3190}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF01}-\x{FF9F}\x{20000}-\x{3FFFF}]', '', 'g'))::BIGINT AS n_unspaced
  FROM tok LEFT JOIN rep USING (r)),
b AS (
  SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END
    + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 100 * n_symbols > 5 * word_chars THEN 4 ELSE 0 END
    + CASE WHEN 100 * n_capitals > 45 * word_chars THEN 8 ELSE 0 END
    + CASE WHEN 100 * n_exclamations > 6 * word_chars THEN 16 ELSE 0 END
    + CASE WHEN 100 * n_stutters > 25 * n_words THEN 32 ELSE 0 END
    + CASE WHEN 2 * word_chars < 3 * n_words OR word_chars > 25 * n_words THEN 64 ELSE 0 END
    + CASE WHEN n_lines >= 10 AND 100 * n_dup_lines > 60 * n_lines THEN 128 ELSE 0 END
    + CASE WHEN 2 * word_chars < 3 * n_words OR word_chars - n_unspaced > 25 * n_words THEN 256 ELSE 0 END)::BIGINT AS failed_bits
  FROM m)
SELECT *, 'strict-4' AS policy, (failed_bits & 3) <> 0 AS base_failed, (failed_bits & 447) = 0 AS kept FROM b"""

CHAT = r"""WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r)),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
    count(*) OVER (PARTITION BY conv_id) AS n,
    15 + length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'))
      + length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS piece
  FROM c),
e AS (
  SELECT *, count_if(role = 'assistant' OR i = n) OVER (
    PARTITION BY conv_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS uses
  FROM o)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY i), '')) AS loss_sha256,
  sum(piece * uses)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""


def _url(context: int) -> str:
    levels = []
    for k in range(context + 1):
        below = "" if k == 0 else f"JOIN p{k - 1} b ON b.gram = right(s.gram, {k})"
        low = lambda x: "(1.0::DOUBLE / (SELECT count(*) FROM s0))" if k == 0 else f"b.{x}"  # noqa: B023, E731
        p = lambda x: (
            f"CASE WHEN c.all_{x} > 0 THEN (s.n_{x} + c.kinds_{x} * {low(x)})"
            f" / (c.all_{x} + c.kinds_{x})::DOUBLE ELSE {low(x)} END AS {x}"
        )
        levels.append(
            f"""s{k} AS MATERIALIZED (SELECT right(gram, {k + 1}) AS gram, sum(n_a)::BIGINT AS n_a,
  sum(n_b)::BIGINT AS n_b FROM counts GROUP BY 1),
c{k} AS (SELECT left(gram, {k}) AS context, sum(n_a)::BIGINT AS all_a, sum(n_b)::BIGINT AS all_b,
  count_if(n_a > 0)::BIGINT AS kinds_a, count_if(n_b > 0)::BIGINT AS kinds_b FROM s{k} GROUP BY 1),
p{k} AS MATERIALIZED (SELECT s.gram, {p("a")}, {p("b")}
  FROM s{k} s JOIN c{k} c ON c.context = left(s.gram, {k}) {below})"""
        )
    fits = lambda rule: (
        f"(host = '{rule.split('/')[0]}' OR ends_with(host, '.{rule.split('/')[0]}'))"
        f" AND starts_with(path, '/{rule.split('/', 1)[1]}')"
    )
    rules = {
        "www.example.com/en/": "allow",
        "example.com/en/": "block",
        "net/es/": "block",
        "net/fr/": "block",
        "com/": "allow",
    }
    return (
        rf"""WITH raw AS (
  SELECT page_id, coalesce(url, '') AS url, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path, row_number() OVER () AS r
  FROM pages),
ruled AS (
  SELECT *, CASE {" ".join(f"WHEN {fits(r)} THEN '{r}'" for r in rules)} END AS rule,
    substr(md5(url), 1, 1) IN ('0', '1', '2') AS held
  FROM raw),
u AS MATERIALIZED (
  SELECT *, CASE {" ".join(f"WHEN rule = '{r}' THEN '{v}'" for r, v in rules.items())} END AS ruled FROM ruled),
win AS MATERIALIZED (
  SELECT r, ruled, held, substr(repeat(chr(1), {context}) || url, i, {context + 1}) AS gram FROM (
    SELECT r, ruled, held, url, unnest(range(1, length(url) + 1)) AS i FROM u)),
counts AS MATERIALIZED (
  SELECT gram, count(*) FILTER (WHERE ruled = 'allow' AND NOT held)::BIGINT AS n_a,
    count(*) FILTER (WHERE ruled = 'block' AND NOT held)::BIGINT AS n_b
  FROM win GROUP BY 1),
"""
        + ",\n".join(levels)
        + f""",
ratio AS (SELECT gram, round(ln(a / b) * 1e6)::BIGINT AS ratio FROM p{context}),
scored AS (
  SELECT r, floor(sum(ratio)::DOUBLE / count(*) / 10000)::BIGINT AS score_bin
  FROM win JOIN ratio USING (gram) GROUP BY r),
judged AS (SELECT u.*, coalesce(score_bin, 0) AS score_bin FROM u LEFT JOIN scored USING (r)),
bins AS (
  SELECT score_bin, count_if(ruled = 'allow') AS good, count_if(ruled = 'block') AS bad
  FROM judged WHERE ruled IS NOT NULL AND held GROUP BY 1),
risk AS (
  SELECT score_bin, coalesce(lag(score_bin) OVER (ORDER BY score_bin), score_bin) AS before, coalesce(sum(good) OVER w, 0) * (SELECT sum(bad) FROM bins)
    - coalesce(sum(bad) OVER w, 0) * (SELECT sum(good) FROM bins) AS risk
  FROM bins WINDOW w AS (ORDER BY score_bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cut AS (
  SELECT ceil(min_by(score_bin + before, score_bin) / 2.0)::BIGINT AS cut FROM risk
  WHERE risk = (SELECT min(risk) FROM risk) AND (SELECT sum(good) > 0 AND sum(bad) > 0 FROM bins))
SELECT page_id, host, path, rule, score_bin,
  coalesce(ruled, CASE WHEN score_bin < (SELECT cut FROM cut) THEN 'block' ELSE 'allow' END) AS verdict
FROM judged"""
    )


URL = _url(6)

NEAR = r"""WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS g FROM (
  SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id, doc_id AS other FROM n UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other)
SELECT w.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, coalesce(min(other), w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN r USING (doc_id) GROUP BY w.doc_id"""


def _means(k: int, rounds: int) -> str:
    steps = []
    for r in range(rounds + 1):
        steps.append(
            f"""d{r} AS (SELECT v.r, c.cluster, sum((v.x - c.x) * (v.x - c.x))::BIGINT AS distance
  FROM v JOIN c{r} c USING (i) GROUP BY v.r, c.cluster),
a{r} AS MATERIALIZED (SELECT r, arg_min(cluster, (distance, cluster)) AS cluster, min(distance) AS distance
  FROM d{r} GROUP BY r)"""
        )
        if r < rounds:
            steps.append(
                f"""c{r + 1} AS MATERIALIZED (SELECT c.cluster, c.i, coalesce(n.x, c.x) AS x FROM c{r} c LEFT JOIN (
  SELECT cluster, i, floor(sum(x)::BIGINT / count(*))::BIGINT AS x FROM v JOIN a{r} USING (r) GROUP BY cluster, i) n
  USING (cluster, i))"""
            )
    return f"""WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64),
v AS MATERIALIZED (SELECT r, unnest(range(64)) AS i,
  unnest(list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT)) AS x FROM kept),
s AS (SELECT r, row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, embedding) - 1 AS cluster FROM kept),
c0 AS MATERIALIZED (SELECT cluster::INTEGER AS cluster, i, x FROM v JOIN s USING (r) WHERE cluster < {k}),
{", ".join(steps)},
h AS (SELECT cluster, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY cluster)
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
  (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a{rounds} JOIN kept USING (r) JOIN h USING (cluster)"""


MEANS = _means(40, 5)

SHARDS = r"""WITH tab AS MATERIALIZED (
  SELECT list(c ORDER BY b) AS tab FROM (
    SELECT b, list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b) AS c
    FROM range(256) r(b))),
d AS (
  SELECT row_number() OVER () AS r, doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size,
    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes
  FROM documents),
c AS (
  SELECT r, doc_id, size, xor(list_reduce(bytes, lambda c, b: xor(c // 256, tab[xor(c % 256, b) + 1]),
    4294967295::BIGINT), 4294967295) AS text_crc32 FROM d, tab),
o AS (
  SELECT r, s, 1.0::DOUBLE / -ln((('0x' || md5(coalesce(doc_id::VARCHAR, '') || '|' || s)[1:13])::BIGINT + 0.5)
    / 4503599627370496.0::DOUBLE) AS offer
  FROM d, range(41) t(s)),
w AS (
  SELECT r, arg_max(s, (offer, -s)) FILTER (s < 40)::INTEGER AS shard, arg_max(s, (offer, -s))::INTEGER AS grown_shard
  FROM o GROUP BY r)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, r) - 1 AS slot, grown_shard
FROM c JOIN w USING (r)"""

_TERMS = (
    "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
    r" '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
)

SEARCH = f"""WITH t AS (
  SELECT r, doc_id, unnest({_TERMS}) AS term FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents)),
i AS (SELECT DISTINCT item_id, text, unnest({_TERMS}) AS term FROM benchmark),
n AS (SELECT r, doc_id, count(*)::BIGINT AS n FROM t GROUP BY r, doc_id),
c AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM n),
m AS (SELECT r, doc_id, 10 + (90 * n * docs) // terms AS m FROM n, c),
f AS (SELECT r, term, count(*)::BIGINT AS tf FROM t WHERE term IN (SELECT term FROM i) GROUP BY r, term),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*)::BIGINT AS df FROM f GROUP BY term), c),
s AS (SELECT item_id, text, m.doc_id, f.r, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM i JOIN f USING (term) JOIN w USING (term) JOIN m ON m.r = f.r GROUP BY item_id, text, m.doc_id, f.r),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST, r)::INTEGER
  AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10"""
