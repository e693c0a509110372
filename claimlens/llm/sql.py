"""DuckDB twins of the operators that SQL can express."""

from claimlens.llm.license_scan import PHRASES, TEMPLATES, THRESHOLD, shingles_of, words_of

_HALF = max(len(words_of(text)) for _, text in TEMPLATES)
_SIZE = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

ORACLE: dict[str, str] = {
    # The level of the targets: sources in the order of cap / weight; the first k are capped.
    "op1_mix_sources": rf"""
WITH sized AS (SELECT doc_id, source, {_SIZE} AS size FROM documents),
ranked AS (
    SELECT source, sum(size)::BIGINT AS source_size,
           [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
    FROM sized GROUP BY source),
ordered AS (
    SELECT *, 3.0::DOUBLE * source_size AS cap,
           coalesce(sum(3.0::DOUBLE * source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps,
           sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free,
           (sum(source_size) OVER ())::DOUBLE AS total, row_number() OVER w AS place
    FROM ranked WINDOW w AS (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST)),
level AS (SELECT arg_min((total - caps) / free, place) FILTER (WHERE (total - caps) / free * weight <= cap) AS level FROM ordered),
targets AS (SELECT source, source_size, least(cap, weight * level) AS target FROM ordered, level),
placed AS (
    SELECT s.*, t.source_size, t.target,
           sum(s.size) OVER (PARTITION BY s.source ORDER BY md5(coalesce(s.doc_id::VARCHAR, 'null')), s.doc_id, s.size
                             ROWS UNBOUNDED PRECEDING) - s.size AS before
    FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
cut AS (
    SELECT *, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS epochs FROM placed)
SELECT doc_id, source, size::BIGINT AS size, source_size, target,
       (epochs * size + greatest(0, least(size, floor(target)::BIGINT - epochs * source_size - before)))::BIGINT AS taken
FROM cut""",
    # An as-of join by its definition: of all earlier full responses of the URL the last.
    "op2_resolve_revisits": r"""
WITH parsed AS (
    SELECT page_id, sha256(html) AS sha, octet_length(encode(html)) AS n_bytes, trim(url) AS u,
           regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)(?::([0-9]*))?([^?#]*)(?:\?([^#]*))?',
                          ['scheme', 'host', 'port', 'path', 'query']) AS p
    FROM pages),
cut AS (
    SELECT *, regexp_replace(regexp_replace(lower(p.host), '\.$', ''), '^www[0-9]*\.', '') AS host, regexp_replace(p.path, '/+$', '') AS path,
           list_sort(list_filter(string_split(p.query, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[A-Za-z_]*|fbclid|gclid)(=|$)'))) AS given
    FROM parsed),
keyed AS (
    SELECT *, CASE WHEN host = '' THEN u ELSE host
           || CASE WHEN p.port = '' OR lower(p.scheme) || p.port IN ('http80', 'https443') THEN '' ELSE ':' || p.port END
           || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(given) > 0 THEN '?' || array_to_string(given, '&') ELSE '' END END AS url_key
    FROM cut),
captures AS (
    SELECT page_id, k, url_key, sha, n_bytes, page_id * 4 + k AS record_id, 1700000000 + (page_id * 7919) % 86400 + k * 86400 AS captured_at,
           '"' || left(sha, 16) || CASE WHEN k = 2 AND page_id % 5 = 0 THEN 'x' ELSE '' END || '"' AS tag
    FROM keyed, (SELECT unnest([0, 1, 2, 3]) AS k)),
pairs AS (
    SELECT c.*, f.record_id AS r_id, f.page_id AS r_page, f.sha AS r_sha, f.n_bytes AS r_bytes, f.captured_at AS r_at, f.tag AS r_tag,
           row_number() OVER (PARTITION BY c.record_id ORDER BY f.captured_at DESC NULLS LAST, f.record_id DESC) AS place
    FROM captures c LEFT JOIN captures f
         ON c.k > 0 AND f.k = 0 AND f.page_id % 11 <> 0 AND f.url_key = c.url_key AND f.captured_at < c.captured_at),
judged AS (
    SELECT *, CASE WHEN k = 0 THEN 'response' WHEN r_id IS NULL THEN 'no response'
                   WHEN k < 3 THEN CASE WHEN tag = r_tag THEN 'resolved' ELSE 'changed' END
                   WHEN page_id % 7 = 0 THEN 'unchecked' WHEN page_id = r_page THEN 'resolved' ELSE 'changed' END AS outcome
    FROM pairs WHERE place = 1)
SELECT record_id, url_key, captured_at, outcome, CASE WHEN outcome = 'resolved' THEN r_id END AS response_id,
       CASE WHEN outcome = 'resolved' THEN r_sha END AS response_sha256,
       CASE WHEN outcome = 'resolved' THEN 'Content-Type: text/html\nContent-Length: '.replace('\n', chr(10)) || r_bytes || chr(10)
            || CASE WHEN k < 3 THEN 'Last-Modified: ' || r_page ELSE 'ETag: ' || r_tag END || chr(10) || 'Server: a' || chr(10)
            || 'date: ' || captured_at || chr(10) || 'cache-control: max-age=60' || chr(10)
            || CASE WHEN k < 3 THEN 'etag: W/' || tag ELSE 'last-modified: ' || page_id END END AS headers
FROM judged""",
    # Every window that a common shingle lays, compared with every item of its length: no fingerprints.
    "op4_decontaminate": r"""
WITH d AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS words FROM documents),
i AS (SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS words FROM benchmark),
items AS (
    SELECT item_id, words, len(words) AS n, least(len(words), 5) AS k,
           list_transform(range(0, greatest(0, len(words) - least(len(words), 5)) + 1), lambda j: array_to_string(words[j + 1:j + least(len(words), 5)], ' ')) AS shingles
    FROM i WHERE len(words) > 0),
wanted AS (SELECT DISTINCT n, k, unnest(shingles) AS shingle, unnest(range(0, len(shingles))) AS at FROM items),
each AS (
    SELECT doc_id, words, k, pos, array_to_string(words[pos + 1:pos + k], ' ') AS shingle
    FROM (SELECT doc_id, words, k, unnest(range(0, greatest(0, len(words) - k + 1))) AS pos FROM d, (SELECT DISTINCT k FROM items))),
windows AS (
    SELECT DISTINCT e.doc_id, e.words, e.k, w.n, greatest(0, least(e.pos - w.at, len(e.words) - w.n)) AS start
    FROM each e JOIN wanted w USING (k, shingle)),
own AS (
    SELECT doc_id, n, start, k, words[start + 1:start + n] AS w FROM windows),
pairs AS (
    SELECT doc_id, item_id, o.n, start, shingles,
           list_transform(range(0, greatest(0, len(w) - o.k) + 1), lambda j: array_to_string(w[j + 1:j + o.k], ' ')) AS own
    FROM own o JOIN items USING (n, k)),
scored AS (
    SELECT doc_id, item_id, n, start, len(own) + len(shingles) AS total,
           list_sum(list_transform(list_distinct(own), lambda s: least(len(list_filter(own, lambda x: x = s)), len(list_filter(shingles, lambda x: x = s))))) AS common
    FROM pairs),
best AS (
    SELECT *, common::DOUBLE / (total - common) AS similarity,
           row_number() OVER (PARTITION BY doc_id, item_id ORDER BY common::DOUBLE / (total - common) DESC, start) AS place
    FROM scored WHERE common::DOUBLE / (total - common) >= 0.8)
SELECT doc_id, item_id, n::INT AS n_words, start::INT AS start, similarity FROM best WHERE place = 1""",
    # Straight from the definition: every string of 50 bytes with its smallest doc_id. Bytes are pairs of hexadecimal digits.
    "op3_phrase_dedup": """
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS place, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (
    SELECT r, place, x, substr(h, 2 * x + 1, 100) AS s
    FROM (SELECT r, place, h, unnest(range(0, greatest(0, length(h) // 2 - 49))) AS x FROM d)),
earliest AS (SELECT s, min(place) AS place FROM windows GROUP BY s),
repeated AS (SELECT r, x FROM windows w JOIN earliest e ON w.s = e.s WHERE e.place < w.place),
runs AS (
    SELECT r, x, sum(CASE WHEN x - before <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY x) AS run
    FROM (SELECT r, x, lag(x) OVER (PARTITION BY r ORDER BY x) AS before FROM repeated)),
spans AS (SELECT r, min(x) AS b, max(x) + 50 AS e FROM runs GROUP BY r, run),
gaps AS (SELECT r, b, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY b), 0) AS a FROM spans),
kept AS (
    SELECT r, count(*) AS n_spans, sum(e - b) AS n_removed, max(e) AS last, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY b) AS h
    FROM gaps JOIN d USING (r) GROUP BY r)
SELECT doc_id, (length(d.h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(k.h || substr(d.h, 2 * k.last + 1), d.h))) AS kept_sha256
FROM d LEFT JOIN kept k USING (r)""",
    # Every anchor against every row.
    "op11_hard_negatives": """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
    SELECT a.vec_id AS anchor_id, a.label = r.label AS same, r.vec_id AS id, list_dot_product(a.v, r.v)::BIGINT AS score
    FROM (SELECT DISTINCT * FROM v WHERE vec_id % 50 = 0) a JOIN v r ON a.vec_id <> r.vec_id),
positives AS (
    SELECT anchor_id, id AS positive_id, score AS positive_score FROM pairs WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY n.score DESC, n.id)::INT AS rank, n.id AS negative_id,
       positive_score, n.score AS negative_score
FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same
WHERE 50 * positive_score <= 100 * n.score AND 100 * n.score <= 95 * positive_score
QUALIFY rank <= 3""",
    # Every document scored for every item that shares a term with it.
    "op12_ranked_search": r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
i AS (
    SELECT row_number() OVER () AS q, item_id, unnest(list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term FROM benchmark),
total AS (SELECT count(*)::BIGINT AS big_n, sum(len(words))::BIGINT AS big_l FROM d WHERE len(words) > 0),
postings AS (SELECT r, doc_id, len(words)::BIGINT AS n, term, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, words, unnest(words) AS term FROM d) GROUP BY ALL),
weights AS (
    SELECT term, floor(1000 * ln((2 * big_n + 2) / (2 * df + 1)::DOUBLE))::BIGINT AS w
    FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), total),
scored AS (
    SELECT q, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * big_n) // big_l))))::BIGINT AS score
    FROM i JOIN postings USING (term) JOIN weights USING (term), total GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 50""",
    # Blocks and templates compared by definition: no order of tokens, no filters.
    "op13_license_scan": rf"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
phrases AS (SELECT * FROM (VALUES {", ".join(f"('{label}', {parts!r})" for label, parts in ((label, phrase.split(" ")) for phrase, label in PHRASES.items()))}) t(label, parts)),
spots AS (SELECT r, words, unnest(range(0, len(words))) AS i FROM d),
places AS (
    SELECT r, count(*) AS n, min(i) AS first_word, max(i) AS last_word, list(label) AS labels
    FROM spots JOIN phrases ON words[i + 1] = parts[1] AND words[i + 1:i + len(parts)] = parts GROUP BY r),
templates AS (SELECT * FROM (VALUES {", ".join(f"({t}, '{label}', {shingles_of(text)!r})" for t, (label, text) in enumerate(TEMPLATES))}) t(template, label, shingles)),
tokens AS (SELECT template, label, len(shingles) AS size, unnest(shingles) AS shingle FROM templates),
hits AS (
    SELECT r, unnest([i // {_HALF}, i // {_HALF} - 1]) AS block, shingle
    FROM (SELECT r, i, array_to_string(words[i + 1:i + 5], ' ') AS shingle FROM spots) WHERE shingle IN (SELECT shingle FROM tokens)),
blocks AS (
    SELECT r, label, count(DISTINCT shingle)::DOUBLE / size AS containment FROM hits JOIN tokens USING (shingle) WHERE block >= 0
    GROUP BY r, block, template, label, size HAVING count(DISTINCT shingle) >= ceil({THRESHOLD} * size - 1e-9)),
found AS (SELECT r, list(label) AS labels, max(containment) AS containment FROM blocks GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(p.n, 0)::BIGINT AS n_base, p.first_word::BIGINT AS first_word, p.last_word::BIGINT AS last_word,
       coalesce(array_to_string(list_sort(list_distinct(p.labels)), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(p.labels, []), coalesce(f.labels, [])))), ','), '') AS labels,
       CASE WHEN p.n > 0 THEN 1.0::DOUBLE ELSE coalesce(containment, 0) END AS score
FROM d LEFT JOIN places p USING (r) LEFT JOIN found f USING (r)""",
}
