"""DuckDB SQL for the queries that SQL can express, written apart from the operators."""
from __future__ import annotations

WORDS = r"coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)"


def sharding(shards: list[str]) -> str:
    """Fills the look-up table turn by turn in a recursive query: the state is the list of claimed slots."""
    names = ", ".join(f"({i}, '{s}')" for i, s in enumerate(shards))
    return f"""
WITH RECURSIVE hashed AS (
    SELECT i, s, ('0x' || substr(md5('offset:' || s), 1, 15))::BIGINT % 2053 AS off,
           ('0x' || substr(md5('skip:' || s), 1, 15))::BIGINT % 2052 + 1 AS step
    FROM (VALUES {names}) v(i, s)),
prefs AS (SELECT list(list_transform(range(2053), lambda k: (off + k * step) % 2053) ORDER BY i) AS p FROM hashed),
fill AS (
    SELECT 0 AS turn, list_transform(range(2053), lambda x: false) AS taken, CAST(NULL AS BIGINT) AS slot
    UNION ALL
    SELECT turn + 1, list_transform(taken, lambda t, j: t OR j = free + 1), free
    FROM (SELECT turn, taken, list_filter(p[turn % {len(shards)} + 1], lambda x: NOT taken[x + 1])[1] AS free
          FROM fill, prefs WHERE turn < 2053)),
slots AS (SELECT slot, (turn - 1) % {len(shards)} AS i FROM fill WHERE slot IS NOT NULL)
SELECT doc_id, CAST(t.slot AS INTEGER) AS slot, h.s AS shard
FROM (SELECT doc_id, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT % 2053 AS at
      FROM documents) d
JOIN slots t ON t.slot = d.at JOIN hashed h USING (i)"""


def mixing(p) -> str:
    """Targets by trying every number of stopped sources; selection by running sums over whole sources."""
    weights = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(p.weights))
    fills = ""
    last = "ordered"
    for k in range(p.refinements):
        fills += f""",
best{k} AS (
    SELECT src, min_by(key, (abs(size - gap), key)) AS fill, min_by(size, (abs(size - gap), key)) AS filled
    FROM {last} WHERE NOT extra AND gap > 0 AND abs(size - gap) < abs(gap) GROUP BY src),
fit{k} AS (
    SELECT b.* REPLACE (extra OR coalesce(key = fill, false) AS extra, gap - coalesce(filled, 0) AS gap)
    FROM {last} b LEFT JOIN best{k} USING (src))"""
        last = f"fit{k}"
    return f"""
WITH docs AS (
    SELECT doc_id, coalesce('0' || source, '1') AS src, CAST({WORDS} AS BIGINT) AS size,
           ('0x' || substr(md5('{p.seed}:' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))), 1, 15))::BIGINT
               AS key
    FROM documents),
sources AS (SELECT src, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY src),
weighted AS (
    SELECT *, CASE (row_number() OVER (ORDER BY src) - 1) % {len(p.weights)} {weights} END AS w,
           (SELECT CAST(sum(source_size) AS DOUBLE) * {p.share} FROM sources) AS total FROM sources),
levels AS (
    SELECT a.src, a.source_size, a.w,
           (a.total - coalesce(sum(b.source_size * {p.copies}) FILTER (
               WHERE (CAST(b.source_size AS DOUBLE) / b.w, b.src) < (CAST(a.source_size AS DOUBLE) / a.w, a.src)), 0))
           / sum(b.w) FILTER (
               WHERE (CAST(b.source_size AS DOUBLE) / b.w, b.src) >= (CAST(a.source_size AS DOUBLE) / a.w, a.src)) AS level
    FROM weighted a, weighted b GROUP BY a.src, a.source_size, a.w, a.total),
chosen AS (
    SELECT arg_min(level, (CAST(source_size AS DOUBLE) / w, src)) AS level FROM levels
    WHERE level * w <= source_size * {p.copies}),
targets AS (
    SELECT src, source_size, least(CAST(source_size * {p.copies} AS DOUBLE), c.level * w) AS target
    FROM weighted, chosen c),
need AS (
    SELECT *, CASE WHEN source_size > 0 THEN least({p.copies}, CAST(floor(target / source_size) AS BIGINT)) ELSE 0 END
        AS full_copies FROM targets),
placed AS (
    SELECT doc_id, size, key, src, source_size, target, full_copies,
           CASE WHEN full_copies < {p.copies} THEN target - full_copies * source_size ELSE 0 END AS rest,
           sum(size) OVER (PARTITION BY src ORDER BY key) AS upto
    FROM docs JOIN need USING (src)),
ordered AS (
    SELECT *, upto <= rest AS extra,
           rest - coalesce(max(CASE WHEN upto <= rest THEN upto END) OVER (PARTITION BY src), 0) AS gap
    FROM placed){fills}
SELECT doc_id, size, source_size, target,
       CAST(least(full_copies + CAST(extra AS BIGINT), {p.copies}) * size AS BIGINT) AS taken
FROM {last}"""


LEXICAL = r"""
WITH docs AS (
    SELECT doc_id, regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents WHERE text IS NOT NULL),
whole AS (SELECT count(*) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM docs WHERE len(terms) > 0),
items AS (
    SELECT item_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark),
tf AS (
    SELECT doc_id, n, term, count(*) AS tf
    FROM (SELECT doc_id, CAST(len(terms) AS BIGINT) AS n, unnest(terms) AS term FROM docs)
    WHERE term IN (SELECT term FROM items) GROUP BY ALL),
weights AS (
    SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
    FROM tf, whole GROUP BY term),
impacts AS (
    SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // n_terms))) AS v
    FROM tf JOIN weights USING (term), whole),
scored AS (
    SELECT item_id, doc_id, CAST(sum(v) AS BIGINT) AS score FROM items JOIN impacts USING (term) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10"""


def _codes() -> str:
    """Nearest entries by comparing every part with every entry; two rounds written out."""
    steps = ""
    for k in range(3):
        steps += f""",
near{k} AS (
    SELECT vec_id, p, any_value(s) AS s, min_by(e, (d, e)) AS e, min(d) AS d
    FROM (SELECT vec_id, p, pieces.s, e,
                 list_sum(list_transform(range(1, len(pieces.s) + 1), lambda i: (pieces.s[i] - b.s[i]) ** 2)) AS d
          FROM pieces JOIN book{k} b USING (p))
    GROUP BY vec_id, p)"""
        if k < 2:
            steps += f""",
moved{k} AS (
    SELECT p, e, list(m ORDER BY i) AS s
    FROM (SELECT p, e, i, CAST(floor(sum(s[i]) / count(*)) AS BIGINT) AS m
          FROM near{k}, range(1, 5) t(i) GROUP BY p, e, i) GROUP BY p, e),
book{k + 1} AS (SELECT p, e, coalesce(n.s, b.s) AS s FROM book{k} b LEFT JOIN moved{k} n USING (p, e))"""
    return f"""
WITH kept AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pieces AS (SELECT vec_id, CAST(p AS INTEGER) AS p, v[p * 4 + 1:p * 4 + 4] AS s FROM kept, range(16) t(p)),
first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT 64),
book0 AS (SELECT p, e, s FROM first JOIN pieces USING (vec_id)){steps},
coded AS (
    SELECT vec_id, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error
    FROM near2 GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(s, ','), ',' ORDER BY p, e)) FROM book2) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)"""


CODES = _codes()
