"""SQL for DuckDB that gives the rows of the queries of this subpackage that SQL can express."""

from __future__ import annotations

from tracelane.llm.secret_rules import BASE, RULES

#: The budget of a source by its rank among those that stop; words taken by the running sum of sizes in the order of hashes.
MIXING = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS hash FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [1.0, 2.0, 3.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight FROM d GROUP BY source),
stop AS (SELECT *, sum(source_size) OVER () AS total, 3.0::DOUBLE * source_size AS capacity FROM per),
level AS (SELECT max((total - capped) / free) AS level FROM (
    SELECT total, coalesce(sum(capacity) OVER (ORDER BY capacity / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped, sum(weight) OVER (ORDER BY capacity / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free,
           capacity / weight AS ratio FROM stop) WHERE (total - capped) / free <= ratio),
goal AS (SELECT source, source_size, least(capacity, level * weight) AS target, CASE WHEN source_size > 0 THEN CAST(floor(least(capacity, level * weight) / source_size) AS BIGINT) ELSE 0 END AS passes FROM stop, level),
run AS (SELECT d.*, source_size, target, passes, greatest(CAST(round(target) AS BIGINT) - passes * source_size, 0) AS rest, CAST(sum(size) OVER (PARTITION BY d.source ORDER BY hash) AS BIGINT) AS upto, CAST(sum(size) OVER (PARTITION BY d.source, hash) AS BIGINT) AS tied
        FROM d JOIN goal ON d.source IS NOT DISTINCT FROM goal.source)
SELECT doc_id, size, source_size, target, CAST(passes * size + CASE WHEN upto <= rest THEN size WHEN upto - tied < rest THEN size * (rest - upto + tied) // tied ELSE 0 END AS BIGINT) AS taken FROM run"""

#: Windows of 400 bytes as hexadecimal text, cut from chunks of 1,000 places, as the engine walks a text from its start for each cut.
REPEATS = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS body FROM documents),
chunk AS (SELECT doc_id, base, substr(body, 2 * base + 1, 2 * 1399) AS part, least(1000, len(body) // 2 - 399 - base) AS places FROM (SELECT *, unnest(range(0, len(body) // 2 - 399, 1000)) AS base FROM d)),
win AS (SELECT doc_id, base + i AS place, hash(substr(part, 2 * i + 1, 800)) AS h FROM (SELECT *, unnest(range(places)) AS i FROM chunk)),
again AS (SELECT doc_id, place FROM win WHERE h IN (SELECT h FROM win GROUP BY h HAVING count(*) > 1)),
edge AS (SELECT *, CASE WHEN place <= lag(place) OVER (PARTITION BY doc_id ORDER BY place) + 400 THEN 0 ELSE 1 END AS new FROM again),
span AS (SELECT doc_id, min(place) AS lo, max(place) + 400 AS hi FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY place) AS run FROM edge) GROUP BY doc_id, run),
gone AS (SELECT doc_id, list(lo ORDER BY lo) AS los, list(hi ORDER BY lo) AS his, CAST(sum(hi - lo) AS BIGINT) AS removed, count(*) AS spans FROM span GROUP BY doc_id)
SELECT doc_id, CAST(len(body) // 2 AS BIGINT) AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN removed IS NULL THEN body ELSE list_aggregate(list_transform(list_zip(list_prepend(0, his), list_append(los, len(body) // 2)), lambda x: substr(body, 2 * x[1] + 1, 2 * (x[2] - x[1]))), 'string_agg', '') END)) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)"""

#: All pairs of different shingle sets that share a shingle, with the size of what they share; classes by reach.
JOIN = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda w: w <> '') AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
                          ELSE list_sort(list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i : i + 4], ' ')))) END AS shingles FROM d),
k AS (SELECT doc_id, md5(array_to_string(shingles, chr(10))) AS key, shingles FROM s),
sets AS (SELECT key, min(doc_id) AS least, count(*) AS copies, any_value(shingles) AS shingles FROM k GROUP BY key),
each AS (SELECT key, len(shingles) AS n, unnest(shingles) AS shingle FROM sets),
shared AS (SELECT a.key AS a, b.key AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS common FROM each a JOIN each b ON a.shingle = b.shingle AND a.key < b.key AND a.n >= 0.8 * b.n AND b.n >= 0.8 * a.n GROUP BY a.key, b.key),
link AS (SELECT a, b FROM shared WHERE common >= 0.8 * (n + m - common) - 1e-9),
way AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (WITH RECURSIVE r AS (SELECT key AS a, key AS b FROM sets UNION SELECT r.a, way.b FROM r JOIN way ON way.a = r.b) SELECT r.a AS key, min(sets.least) AS class_id FROM r JOIN sets ON sets.key = r.b GROUP BY r.a),
links AS (SELECT way.a AS key, CAST(sum(sets.copies) AS BIGINT) AS links FROM way JOIN sets ON sets.key = way.b GROUP BY way.a)
SELECT doc_id, class_id, coalesce(links, 0) + copies - 1 AS n_links, copies AS n_copies FROM k JOIN sets USING (key) JOIN reach USING (key) LEFT JOIN links USING (key)"""


def secrets() -> str:
    """Matches of every rule with the pieces between them, whose lengths give the places."""
    quote = lambda text: "'" + text.replace("'", "''") + "'"
    found = " UNION ALL ".join(
        f"SELECT doc_id, {k} AS rank, {quote(r.kind)} AS kind, {r.least} AS least, regexp_extract_all(body, {quote(r.pattern)}, 0) AS found, regexp_extract_all(body, {quote(r.pattern)}, {r.group}) AS sized, string_split_regex(body, {quote(r.pattern)}) AS pieces FROM d"
        for k, r in enumerate(RULES)
    )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
m AS ({found}),
each AS (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM m),
span AS (SELECT doc_id, rank, kind, length(array_to_string(pieces[1 : i], '')) + length(array_to_string(found[1 : i - 1], '')) AS start, length(found[i]) AS size FROM each WHERE length(sized[i]) >= least),
put AS (SELECT doc_id, rank, start, kind || ':' || start || ':' || (start + size) AS span FROM span)
SELECT doc_id, count(*) FILTER (WHERE rank = 0) AS n_assign, count(*) FILTER (WHERE rank = 1) AS n_access, count(*) FILTER (WHERE rank = 2) AS n_hex,
       sha256(coalesce(string_agg(span, ',' ORDER BY start, rank) FILTER (WHERE rank < {len(BASE)}), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY start, rank), '') AS spans
FROM d LEFT JOIN put USING (doc_id) GROUP BY doc_id"""


ORACLE_SQL: dict[str, str] = {"op5_repeats": REPEATS, "op6_secrets": secrets(), "op8_mixing": MIXING, "op9_similarity_join": JOIN}
