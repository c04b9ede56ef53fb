"""DuckDB SQL of the corpus queries that SQL can express on whole tables.

The others have none: SQL has no suffix array, attention, cut points of a rolling hash, merges by rank or banded alignment,
and its patterns have no lookahead, which weak parts of credentials need.
"""

#: Links by cosine over all pairs, components by reaching.
OP6 = """
    WITH RECURSIVE raw AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    usable AS (SELECT vec_id, v, list_max(list_transform(v, lambda x: abs(x))) AS big FROM raw
        WHERE v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    units AS (SELECT vec_id, list_transform(v, lambda x: x / big) AS v FROM usable WHERE big > 0),
    links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM units a JOIN units b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
    walk(vec_id, reached) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT walk.vec_id, links.b FROM walk JOIN links ON links.a = walk.reached),
    component AS (SELECT vec_id, min(reached) AS component_id FROM walk GROUP BY vec_id)
    SELECT vec_id, (SELECT count(*) FROM links WHERE links.a = component.vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM component"""
#: Shingles as text, links by either Jaccard similarity over all pairs that share one, components by reaching.
OP8 = r"""
    WITH RECURSIVE words AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL),
    whole AS (SELECT doc_id, array_to_string(w, ' ') AS t, w FROM words WHERE len(w) > 0),
    rep AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS rep, w FROM whole),
    runs AS (SELECT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM rep WHERE doc_id = rep),
    el AS MATERIALIZED (SELECT doc_id, hash(s) AS s, CAST(count(*) AS DOUBLE) AS x FROM runs GROUP BY ALL),
    size AS MATERIALIZED (SELECT doc_id, count(*) AS n, sum(x) AS total FROM el GROUP BY doc_id),
    common AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, a.x AS p, b.x AS q FROM el a JOIN el b ON a.s = b.s AND a.doc_id < b.doc_id),
    pair AS (SELECT a, b, count(*) AS n, sum(p) AS sp, sum(q) AS sq FROM common GROUP BY a, b),
    sized AS (SELECT pair.*, sa.n AS na, sb.n AS nb, sa.total AS ta, sb.total AS tb FROM pair JOIN size sa ON sa.doc_id = a JOIN size sb ON sb.doc_id = b),
    part AS (SELECT c.a, c.b, 1 / ((s.ta - s.sp + sum(p) OVER up) / p + (s.tb - coalesce(sum(q) OVER up, 0)) / q) AS share
        FROM common c JOIN sized s ON s.a = c.a AND s.b = c.b WHERE s.sp / s.ta >= 0.5 AND s.sq / s.tb >= 0.5
        WINDOW up AS (PARTITION BY c.a, c.b ORDER BY q / p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    prob AS (SELECT a, b, sum(share) AS j FROM part GROUP BY a, b),
    links AS MATERIALIZED (SELECT s.a, s.b FROM sized s LEFT JOIN prob ON prob.a = s.a AND prob.b = s.b WHERE s.n / CAST(s.na + s.nb - s.n AS DOUBLE) >= 0.8 OR prob.j >= 0.8),
    both_ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    walk(node, reached) AS (SELECT rep, rep FROM rep UNION SELECT walk.node, both_ways.b FROM walk JOIN both_ways ON both_ways.a = walk.reached),
    component AS (SELECT node, min(reached) AS c FROM walk GROUP BY node)
    SELECT d.doc_id, coalesce(rep.rep, d.doc_id) AS copy_of, coalesce(component.c, d.doc_id) AS class_id, coalesce(component.c, d.doc_id) = d.doc_id AS kept
    FROM documents d LEFT JOIN rep ON rep.doc_id = d.doc_id LEFT JOIN component ON component.node = rep.rep"""
#: Scores of all anchors with all rows, positives by rank, negatives by rank among those in the window.
OP11 = """
    WITH r AS MATERIALIZED (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS v
        FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS MATERIALIZED (SELECT a.vec_id AS anchor, a.label AS own, a.v AS av, b.vec_id AS other, b.label, CAST(coalesce(list_inner_product(a.v, b.v), 0) AS BIGINT) AS score FROM r a JOIN r b ON a.vec_id % 100 = 0 AND len(a.v) = len(b.v)),
    p AS (SELECT anchor, own, av, other AS positive_id, score AS positive_score FROM s WHERE label = own AND other <> anchor QUALIFY row_number() OVER (PARTITION BY anchor, own, av ORDER BY score DESC, other) <= 5),
    n AS (SELECT p.anchor AS anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor, p.own, p.av, positive_id, positive_score ORDER BY score DESC, other) AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s ON s.anchor = p.anchor AND s.own = p.own AND s.av = p.av AND s.label <> s.own WHERE 80 * positive_score <= 100 * score AND score <= positive_score)
    SELECT * FROM n WHERE rank <= 5"""
#: Words by pattern, buckets by a CRC-32 table made from its polynomial, shares, gains, ranks.
OP12 = r"""
    WITH RECURSIVE crc(i, v, k) AS (SELECT range, range, 0 FROM range(256) UNION ALL SELECT i, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, k + 1 FROM crc WHERE k < 8),
    crc_table AS MATERIALIZED (SELECT list(v ORDER BY i) AS t FROM crc WHERE k = 8),
    word(kind, doc_id, row, w) AS (
        SELECT kind, doc_id, row, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'))
        FROM (SELECT 's' AS kind, doc_id, row_number() OVER () AS row, text FROM documents UNION ALL SELECT 't', NULL, NULL, text FROM benchmark)),
    counted AS MATERIALIZED (SELECT kind, doc_id, row, w, count(*) AS n FROM word GROUP BY ALL),
    vocabulary AS (SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM counted)),
    placed AS MATERIALIZED (SELECT w, xor(list_reduce(list_transform(range(length(h) // 2), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::BIGINT),
        lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]), 4294967295::BIGINT), 4294967295) % 10000 AS bucket FROM vocabulary, crc_table),
    total AS (SELECT bucket, sum(CASE WHEN kind = 's' THEN n ELSE 0 END) AS s, sum(CASE WHEN kind = 't' THEN n ELSE 0 END) AS t FROM counted JOIN placed USING (w) GROUP BY bucket),
    gain AS (SELECT bucket, CAST(floor(1000 * ln(CAST((t + 1) AS DOUBLE) * (sum(s) OVER () + 10000) / (CAST((s + 1) AS DOUBLE) * (sum(t) OVER () + 10000)))) AS BIGINT) AS g FROM total),
    weighed AS (SELECT row, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n * g) AS BIGINT) AS g FROM counted JOIN placed USING (w) JOIN gain USING (bucket) WHERE kind = 's' GROUP BY row),
    d AS (SELECT doc_id, coalesce(n, 0) AS n_features, CASE WHEN n IS NULL THEN 0 ELSE (g - ((g % n) + n) % n) // n END AS weight,
        ('0x' || sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8])::BIGINT AS h FROM (SELECT doc_id, row_number() OVER () AS row FROM documents) LEFT JOIN weighed USING (row)),
    scored AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM d),
    able AS (SELECT *, n_features >= 20 AS ok, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features) END AS place FROM scored)
    SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT count(*) * 10 // 100 FROM able WHERE ok) THEN place END AS rank FROM able"""
#: Digests of the payloads and the first page of each.
OP13 = """
    WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
    f AS (SELECT page_id, h, strlen(h) AS n, first_value(page_id) OVER (PARTITION BY h ORDER BY page_id NULLS LAST) AS first, row_number() OVER (PARTITION BY h ORDER BY page_id NULLS LAST) AS place FROM p)
    SELECT page_id, n AS payload_bytes, sha256(h) AS payload_digest, CASE WHEN n >= 100 AND place > 1 THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 100 AND place > 1 THEN first END AS refers_to FROM f"""
