"""DuckDB SQL for the queries of this package that SQL can express.

Constants are written out here, not imported from the operators.
"""

OP2 = r"""
WITH sized AS (
    SELECT doc_id, source,
           coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
    FROM documents),
by_source AS (
    SELECT source, sum(size)::BIGINT AS source_size,
           (ARRAY[3, 1, 2])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
    FROM sized GROUP BY source),
sloped AS (
    SELECT *, 2 * source_size AS cap, 2.0 * source_size / weight AS slope,
           sum(source_size) OVER () AS whole, sum(weight) OVER () AS all_weight FROM by_source),
levels AS (
    SELECT slope, (1.5 * whole::DOUBLE - coalesce(sum(cap) OVER before, 0)::DOUBLE)
                  / (all_weight - coalesce(sum(weight) OVER before, 0))::DOUBLE AS level
    FROM sloped WINDOW before AS (ORDER BY slope, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
aim AS (
    SELECT source, source_size,
           least(cap::DOUBLE, coalesce((SELECT level FROM levels WHERE slope >= level ORDER BY slope LIMIT 1), 0)
                              * weight::DOUBLE) AS target,
           ('0x' || substr(md5('42:' || coalesce('s' || source, 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS start
    FROM sloped),
placed AS (
    SELECT d.*, a.source_size, a.target, a.start,
           CASE WHEN a.source_size > 0 THEN a.target / a.source_size::DOUBLE ELSE 0 END AS each,
           row_number() OVER (PARTITION BY d.source ORDER BY size DESC, doc_id NULLS FIRST) - 1 AS k
    FROM sized d JOIN aim a ON d.source IS NOT DISTINCT FROM a.source),
taken AS (
    SELECT *, (floor((k + 1) * each + start) - floor(k * each + start))::BIGINT AS copies FROM placed)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies, source FROM taken
"""

OP12 = r"""
WITH letters AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS upper, 'abcdefghijklmnopqrstuvwxyz' AS lower),
d AS (
    SELECT row_number() OVER () AS r, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), upper, lower), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents, letters),
b AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), upper, lower),
                                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark, letters),
windows AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS words
    FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
found AS (
    SELECT r, i, size, item_id
    FROM (SELECT r, size, i, array_to_string(w[i:i + size - 1], ' ') AS words
          FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i
                FROM d, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size))
    JOIN windows USING (size, words)),
hits AS (
    SELECT r, count(DISTINCT place) AS n FROM (SELECT r, unnest(range(i, i + size)) AS place
                                               FROM (SELECT DISTINCT r, i, size FROM found)) GROUP BY r),
named AS (
    SELECT r, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names
    FROM (SELECT DISTINCT r, item_id::VARCHAR AS name FROM found WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hits.n, 0)::BIGINT AS n_hit, coalesce(named.n, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, hits.n IS NOT NULL AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN named USING (r)
"""

ORACLES: dict[str, str] = {"op2_mixing": OP2, "op12_decontaminate": OP12}
