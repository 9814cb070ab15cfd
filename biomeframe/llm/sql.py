"""SQL forms, written for DuckDB, of the queries that SQL can express."""

from __future__ import annotations

from biomeframe.llm.rules import STOP_WORDS

W = r"[^\x20\x09-\x0D]+"
BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

MIX_PARTS = f"""
    sized AS (
        SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{W}'))::BIGINT AS size FROM documents),
    sources AS (SELECT source, sum(size)::BIGINT AS z FROM sized GROUP BY source),
    weighed AS (
        SELECT source, z, 2.0::DOUBLE * z AS cap,
               CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
                    WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM sources),
    filled AS (
        SELECT cap, w, row_number() OVER f AS k,
               (1.5::DOUBLE * (sum(z) OVER ())::DOUBLE - (sum(cap) OVER f - cap)) / (sum(w) OVER () - sum(w) OVER f + w) AS level
        FROM weighed WINDOW f AS (ORDER BY cap / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
    chosen AS (SELECT coalesce(min_by(level, k), 0.0::DOUBLE) AS level FROM filled WHERE w * level < cap),
    wanted AS (SELECT source, z, least(cap, w * level) AS target FROM weighed, chosen),
    planned AS (
        SELECT source, z, target, CASE WHEN z > 0 THEN target / z ELSE 0.0::DOUBLE END AS copies FROM wanted),
    ranked AS (
        SELECT d.doc_id, d.size, p.z, p.target, floor(p.copies)::BIGINT AS whole, p.copies - floor(p.copies) AS p,
               round(p.target)::BIGINT - floor(p.copies)::BIGINT * p.z AS rest, d.source,
               (('0x' || substr(md5('0|' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE)
                   / 4503599627370496.0::DOUBLE AS u
        FROM sized d JOIN planned p ON d.source IS NOT DISTINCT FROM p.source),
    placed AS (
        SELECT *, CASE WHEN p > 0 THEN sum(size) OVER (
                   PARTITION BY source
                   ORDER BY (u / (1 - u)) / (u / (1 - u) + p / (1 - p)), doc_id, size ROWS UNBOUNDED PRECEDING) - size
               END AS before
        FROM ranked)"""

MIX = f"""
    WITH {MIX_PARTS}
    SELECT doc_id, size, z AS source_size, target,
           (whole * size + CASE WHEN p > 0 AND before < rest AND 2 * (rest - before) >= size THEN size ELSE 0 END)::BIGINT AS taken
    FROM placed"""

# A row is a document, also where ids repeat.
LINES = f"""
    WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
    split AS (
        SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM texts),
    keyed AS (SELECT *, trim(translate(line, '{UPPER}', '{LOWER}'), {BLANKS}) AS key FROM split),
    often AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10)
    SELECT doc_id, count(*)::BIGINT AS n_lines, count(o.key)::BIGINT AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE o.key IS NULL), '')) AS kept_sha256
    FROM keyed k LEFT JOIN often o ON k.key = o.key GROUP BY r, doc_id"""

STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)

RULES = f"""
    WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    listed AS (SELECT doc_id, text, regexp_extract_all(text, '{W}') AS words FROM texts),
    words AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM listed),
    windows AS (
        SELECT doc_id, pos, string_agg(word, ' ') OVER (
                   PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS grams,
               count(*) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS n FROM words),
    twice AS (SELECT doc_id, grams FROM windows WHERE n = 8 GROUP BY 1, 2 HAVING count(*) > 1),
    covered AS (
        SELECT doc_id, count(DISTINCT pos + i)::BIGINT AS n
        FROM windows JOIN twice USING (doc_id, grams), range(8) AS r(i) WHERE windows.n = 8 GROUP BY doc_id),
    stops AS (SELECT doc_id, count(*) AS n FROM words WHERE lower(word) IN ({STOPS}) GROUP BY doc_id),
    lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM texts),
    repeated AS (
        SELECT doc_id, count(*)::BIGINT AS n, (count(*) - count(DISTINCT line))::BIGINT AS dups
        FROM lines WHERE regexp_matches(line, '{W}') GROUP BY doc_id),
    figures AS (
        SELECT l.doc_id, len(words)::BIGINT AS n_words,
               coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
               length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
               coalesce(r.dups, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
               coalesce(s.n, 0) AS stops, coalesce(r.n, 0) AS n_lines
        FROM listed l LEFT JOIN covered c USING (doc_id) LEFT JOIN stops s USING (doc_id)
             LEFT JOIN repeated r USING (doc_id)),
    judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM figures)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND n_words >= 20 AND word_chars / greatest(n_words, 1) BETWEEN 2.0 AND 14.0
           AND n_symbols / greatest(n_words, 1) <= 0.2 AND stops / greatest(n_words, 1) >= 0.02
           AND n_dup_lines / greatest(n_lines, 1) <= 0.3 AND n_repeat_words / greatest(n_words, 1) <= 0.3 AS kept
    FROM judged"""

JACCARD = f"""
    WITH RECURSIVE lists AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{W}') AS w FROM documents),
    grams AS (
        SELECT DISTINCT doc_id, list_aggregate(w[i : i + 4], 'string_agg', ' ') AS g
        FROM lists, range(1, greatest(len(w) - 3, 2)) AS r(i) WHERE len(w) > 0),
    sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY 1),
    links AS (
        SELECT a.doc_id AS u, b.doc_id AS v FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
        JOIN sizes s ON s.doc_id = a.doc_id JOIN sizes t ON t.doc_id = b.doc_id
        GROUP BY 1, 2, s.n, t.n HAVING 100 * count(*) >= 80 * (s.n + t.n - count(*))),
    reach AS (SELECT doc_id AS root, doc_id AS node FROM lists UNION SELECT root, v FROM reach JOIN links ON u = node)
    SELECT node AS doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(root) AS component_id
    FROM reach LEFT JOIN sizes ON sizes.doc_id = node GROUP BY node"""

TOP = """
    WITH whole AS (
        SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS v FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (
        SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
        FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
    SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
    FROM scored QUALIFY rank <= 5"""

# crc32 byte by byte over the hexadecimal form of the UTF-8 text.
SPELLING = f"""
    WITH RECURSIVE crc_table AS (
        SELECT list(v ORDER BY i) AS t FROM (
            SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v
            FROM range(256) AS r(i))),
    runs AS (
        SELECT DISTINCT coalesce(doc_id::VARCHAR, '') AS id, run, count(*) OVER (PARTITION BY doc_id, run) AS times
        FROM (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), '{UPPER}', '{LOWER}') AS run FROM documents)
        WHERE length(run) >= 7),
    coded AS (SELECT run, times, hex(id || ':' || run) AS code FROM runs),
    hashed AS (
        SELECT run, times, xor(list_reduce(
                   list_transform(range(0, length(code), 2), lambda i: ('0x' || substr(code, i + 1, 2))::BIGINT),
                   lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS h
        FROM coded, crc_table),
    spelled AS (
        SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times
        FROM hashed),
    words AS (SELECT word, sum(times)::BIGINT AS n FROM spelled WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
    cuts AS (
        SELECT word, n, i, substr(word, 1, i - 1) AS head, substr(word, i + 1) AS tail
        FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
    shorter AS (SELECT DISTINCT c.word AS a, w.word AS b, c.n AS an, w.n AS bn FROM cuts c JOIN words w ON w.word = c.head || c.tail),
    pairs AS (
        SELECT a.word, b.word AS other, b.n FROM cuts a JOIN cuts b ON a.head = b.head AND a.tail = b.tail AND a.i = b.i AND a.word <> b.word
        UNION ALL SELECT a, b, bn FROM shorter UNION ALL SELECT b, a, an FROM shorter),
    best AS (
        SELECT word, count(*) OVER (PARTITION BY word) AS n_near, other, n AS best_n FROM pairs
        QUALIFY row_number() OVER (PARTITION BY word ORDER BY n DESC, other) = 1),
    told AS (
        SELECT w.word, w.n, coalesce(b.n_near, 0)::BIGINT AS n_near, CASE WHEN b.best_n >= 10 * w.n THEN b.other END AS form,
               CASE WHEN b.best_n >= 10 * w.n THEN b.best_n END AS form_n
        FROM words w LEFT JOIN best b ON b.word = w.word),
    chain AS (
        SELECT word, word AS last, 0 AS depth FROM told
        UNION ALL SELECT c.word, t.form, c.depth + 1 FROM chain c JOIN told t ON t.word = c.last WHERE t.form IS NOT NULL),
    ends AS (SELECT word, max_by(last, depth) AS root FROM chain GROUP BY word)
    SELECT t.word, form, root, n, n_near, form_n FROM told t JOIN ends e ON e.word = t.word"""
