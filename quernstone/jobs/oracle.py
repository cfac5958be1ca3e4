"""The same queries in SQL for DuckDB, over views named like the tables."""

from __future__ import annotations

DOCS = "d AS (SELECT doc_id, text, lang, source AS kb_id, n_chars, substr(sha256(source), 1, 12) AS kb_part FROM documents)"


def words(text: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


def fixed(text: str) -> str:
    return f"list_transform(generate_series(0, greatest(length({text}) - 51, 0), 150), lambda i: substr({text}, (i + 1)::BIGINT, 200))"


def exploded(rows: str, pieces: str) -> str:
    return f"SELECT doc_id, (generate_subscripts(p, 1) - 1)::BIGINT AS chunk_ix, unnest(p) AS content FROM (SELECT doc_id, {pieces} AS p FROM {rows})"


ASKED = "q AS (SELECT item_id AS query_id, text FROM benchmark WHERE item_id % 20 = 0)"
EVERY_TEXT = "q AS (SELECT item_id AS query_id, text FROM benchmark)"
VECTORS = "v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings), qv AS (SELECT vec_id AS query_id, e AS q FROM v WHERE vec_id % 20 = 0)"


def bm25(docs: str) -> str:
    """CTEs up to kw(query_id, doc_id, keyword_score)."""
    return f"""
    asked AS (SELECT DISTINCT query_id, unnest({words('text')}) AS term FROM q),
    ws AS (SELECT doc_id, {words('text')} AS w FROM {docs}),
    whole AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM ws),
    posts AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS len, unnest(w) AS term FROM ws)
              WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM posts GROUP BY term),
    kw AS (SELECT query_id, doc_id, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * (1.2::DOUBLE + 1)
                  / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * len / mean))) AS keyword_score
           FROM posts JOIN df USING (term) JOIN asked USING (term), whole GROUP BY query_id, doc_id)"""


def grams(rows: str, key: str, buckets: int = 512) -> str:
    """(key, bucket, n) of hashed trigrams."""
    return f"""SELECT {key}, (('0x' || left(md5(gram), 8))::BIGINT % {buckets})::BIGINT AS bucket, sum(c)::BIGINT AS n FROM (
        SELECT {key}, gram, count(*) AS c FROM (SELECT {key}, unnest(list_transform(generate_series(1, length(t) - 2), lambda i: substr(t, i::BIGINT, 3))) AS gram
        FROM (SELECT {key}, lower(text) AS t FROM {rows})) GROUP BY ALL) GROUP BY ALL"""


def cosine(docs: str, buckets: int = 512) -> str:
    """CTEs up to vs(query_id, doc_id, vector_score)."""
    return f"""
    dg AS ({grams(docs, 'doc_id', buckets)}), qg AS ({grams('q', 'query_id', buckets)}),
    dl AS (SELECT doc_id, sqrt(sum(n * n)::DOUBLE) AS l FROM dg GROUP BY doc_id), ql AS (SELECT query_id, sqrt(sum(n * n)::DOUBLE) AS l FROM qg GROUP BY query_id),
    vs AS (SELECT query_id, doc_id, sum((dg.n / dl.l) * (qg.n / ql.l)) AS vector_score
           FROM dg JOIN dl USING (doc_id) JOIN qg USING (bucket) JOIN ql USING (query_id) GROUP BY query_id, doc_id)"""


def hybrid(docs: str, weight: float, least: float, columns: str = "query_id, rank, doc_id, score, vector_score, keyword_score", buckets: int = 512, only: str = "", select: str = "SELECT {columns} FROM ranked WHERE rank <= 5") -> str:
    return f"""{bm25(docs)}, {cosine(docs, buckets)},
    best AS (SELECT query_id, max(keyword_score) AS best FROM kw GROUP BY query_id),
    scaled AS (SELECT query_id, doc_id, keyword_score / best AS keyword_score FROM kw JOIN best USING (query_id)),
    both_ AS (SELECT query_id, doc_id, coalesce(vector_score, 0) AS vs_, coalesce(keyword_score, 0) AS ks_ FROM vs FULL JOIN scaled USING (query_id, doc_id)),
    fused AS (SELECT *, round((1 - {weight}::DOUBLE) * vs_ + {weight}::DOUBLE * ks_, 6) AS score FROM both_ {only}),
    ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score,
               round(vs_, 6) AS vector_score, round(ks_, 6) AS keyword_score FROM fused WHERE score >= {least})
    {select.format(columns=columns)}"""


DICTIONARY = "SELECT kb_id, keyword, count(*) AS df FROM (SELECT kb_id, unnest(list_distinct({words})) AS keyword FROM {rows}) GROUP BY ALL"
TFIDF = f"""
    posts AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({words('text')}) AS term FROM d) GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM posts GROUP BY term),
    scored AS (SELECT doc_id, term, tf, round(tf * ln((SELECT count(*) FROM d)::DOUBLE / df), 6) AS score FROM posts JOIN df USING (term)),
    kws AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) AS rank, term AS keyword, tf, score FROM scored QUALIFY rank <= 5)"""
CENTROIDS = """
    parts AS (SELECT {label} AS cluster_id, generate_subscripts(e, 1) AS pos, unnest(e) AS x FROM {rows}),
    means AS (SELECT cluster_id, pos, avg(x) AS m, count(*) AS n FROM parts GROUP BY ALL),
    {name} AS (SELECT cluster_id, list(m ORDER BY pos) AS centroid, max(n) AS size FROM means GROUP BY cluster_id)"""


def distance(a: str, b: str) -> str:
    return f"round(list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 6)"


def nearest(name: str, rows: str, centroids: str) -> str:
    return f"""{name} AS (SELECT vec_id, e, cluster_id, sqrt(dist) AS distance FROM (SELECT vec_id, e, cluster_id, {distance('e', 'centroid')} AS dist FROM {rows}, {centroids})
    QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dist, cluster_id) = 1)"""


C0 = CENTROIDS.format(label="label", rows="v", name="c0")
COSINE = "list_inner_product({a}, {b}) / (sqrt(list_inner_product({a}, {a})) * sqrt(list_inner_product({b}, {b})))"


def lloyd() -> str:
    ctes = ["s0 AS (SELECT vec_id AS cluster_id, e AS centroid FROM v WHERE vec_id < 4)"]
    for i in range(3):
        near = nearest(f"a{i}", "v", f"s{i}")
        means = CENTROIDS.format(label="cluster_id", rows=f"a{i}", name=f"s{i + 1}").replace("parts", f"parts{i}").replace("means", f"means{i}")
        ctes += [near, means]
    return ", ".join(ctes)


KBS = "k AS (SELECT DISTINCT kb_id, regexp_extract(kb_id, '([0-9]+)$', 1)::BIGINT AS no FROM d)"
KB_LIST = "SELECT kb_id, count(*) AS n_docs, sum(length(text))::BIGINT AS n_chars, count(DISTINCT lang) AS n_langs FROM d {where} GROUP BY kb_id"
TAGGED = "t AS (SELECT d.*, d.lang AS tag1, l.quality::VARCHAR AS tag2, l.toxic::VARCHAR AS tag3 FROM d LEFT JOIN labels l USING (doc_id))"
TOPV = f"""SELECT query_id, vec_id, round({COSINE.format(a='e', b='q')}, 6) AS score FROM v, qv"""
LINES = exploded("d", "string_split(text, chr(10))")
SENTENCES = exploded("d", "regexp_extract_all(text, '[^.!?]+[.!?]*')")
CHUNK_KEYS = f"""
    chunks AS ({LINES}),
    cposts AS (SELECT doc_id, doc_id::VARCHAR || ':' || chunk_ix::VARCHAR AS chunk, keyword, count(*) AS tf FROM (SELECT doc_id, chunk_ix, unnest({words('content')}) AS keyword FROM chunks) GROUP BY ALL),
    ck AS (SELECT doc_id, keyword, chunk, tf FROM cposts SEMI JOIN kws USING (doc_id, keyword))"""

def chunk_id() -> str:
    return "substr(sha256(doc_id::VARCHAR || chr(31) || chunk_ix::VARCHAR), 1, 12)"


# one base's chunks from document 10 on, the mean vector of each language, and the two nearest languages of each query
BASE = f"""b AS (SELECT * FROM d WHERE kb_id = 'src3'), every_ AS (SELECT {chunk_id()} AS doc_id, x.doc_id AS of_doc, x.content AS text, list_position(['en', 'de', 'es', 'fr'], b.lang) AS cl
        FROM ({exploded('b', fixed('text'))}) x JOIN b ON b.doc_id = x.doc_id),
    ch AS (SELECT * FROM every_ WHERE of_doc >= 10)""".replace("sha256(doc_id", "sha256(x.doc_id").replace("|| chunk_ix", "|| x.chunk_ix")
NEAR = f"""eg AS ({grams('every_', 'doc_id', 128)}), el AS (SELECT doc_id, sqrt(sum(n * n)::DOUBLE) AS l FROM eg GROUP BY doc_id),
    cn AS (SELECT cl, count(*) AS m FROM every_ GROUP BY cl),
    cent AS (SELECT cl, bucket, sum(eg.n / el.l) / any_value(m) AS c FROM eg JOIN el USING (doc_id) JOIN every_ USING (doc_id) JOIN cn USING (cl) GROUP BY cl, bucket),
    cl2 AS (SELECT cl, sum(c * c) AS s FROM cent GROUP BY cl),
    nq AS (SELECT * FROM ({grams('q', 'query_id', 128)})), nl AS (SELECT query_id, sqrt(sum(n * n)::DOUBLE) AS l FROM nq GROUP BY query_id),
    pq AS (SELECT nq.query_id, cl, sum(nq.n / nl.l * c) AS p FROM nq JOIN nl USING (query_id) JOIN cent USING (bucket) GROUP BY ALL),
    near_ AS (SELECT q.query_id, cl2.cl FROM q CROSS JOIN cl2 LEFT JOIN pq ON pq.query_id = q.query_id AND pq.cl = cl2.cl
        QUALIFY row_number() OVER (PARTITION BY q.query_id ORDER BY round(s - 2 * coalesce(p, 0), 6), cl2.cl) <= 2)"""


def answered(select: str) -> str:
    return f"WITH {DOCS}, {ASKED}, {BASE}, {NEAR}, {hybrid('ch', 0.4, 0.05, buckets=128, only='JOIN ch USING (doc_id) JOIN near_ USING (query_id, cl)', select=select)}"


HOOKS = """t AS (SELECT ['document.ingested', 'document.failed', 'clusters.retrained'] AS t),
    hooks AS (SELECT n_regionkey::VARCHAR AS paired_client_id, n_name AS id, 'https://hooks.example/' || n_name AS url, [t[n_nationkey % 3 + 1], t[(n_nationkey + 1) % 3 + 1]] AS events FROM nation, t)"""
ENDPOINTS = """old AS (SELECT n_regionkey::VARCHAR AS paired_client_id, 'local' AS source, n_name AS external_id, 'm0' AS model FROM nation),
    new AS (SELECT (s_nationkey % 3)::VARCHAR AS paired_client_id, 'mirrored' AS source, s_name AS external_id, 'm' || (s_suppkey % 7) AS model FROM supplier),
    put AS (SELECT *, substr(sha256(paired_client_id || chr(31) || source || chr(31) || external_id), 1, 12) AS id
            FROM (SELECT * FROM old WHERE paired_client_id NOT IN (SELECT paired_client_id FROM new) UNION ALL SELECT * FROM new))"""
TAGS = f"""{DOCS}, {TAGGED}, defs AS (SELECT DISTINCT kb_id, slot, name FROM (SELECT kb_id, 'tag1' AS slot, 'language' AS name FROM t WHERE tag1 IS NOT NULL
    UNION ALL SELECT kb_id, 'tag2', 'quality' FROM t WHERE tag2 IS NOT NULL UNION ALL SELECT kb_id, 'tag3', 'toxic' FROM t WHERE tag3 IS NOT NULL))"""


def far(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


def kmeans_bases() -> str:
    """k-means|| of three bases in three turns, the pick of k seeds, three rounds."""

    def drawn(turn: int) -> str:
        return f"('0x' || substr(md5('0:{turn}:' || kb || ':' || vec_id::VARCHAR), 1, 13))::BIGINT::DOUBLE / 4503599627370496"

    steps = ["b AS (SELECT 'b' || (label % 3)::VARCHAR AS kb, vec_id, embedding::DOUBLE[] AS e, label % 3 + 2 AS k FROM embeddings)", f"c0 AS (SELECT kb, arg_min(vec_id, {drawn(0)}) AS vec_id FROM b GROUP BY kb)"]
    for t in (1, 2, 3):
        steps += [
            f"d{t} AS (SELECT b.kb, b.vec_id, b.k, min({far('b.e', 'x.e')}) AS d2 FROM b JOIN c{t - 1} c ON c.kb = b.kb JOIN b x ON x.vec_id = c.vec_id GROUP BY ALL)",
            f"c{t} AS (SELECT kb, vec_id FROM c{t - 1} UNION SELECT kb, vec_id FROM (SELECT *, sum(d2) OVER (PARTITION BY kb) AS phi FROM d{t}) WHERE d2 > 0 AND {drawn(t)} < 2 * k * d2 / phi)",
        ]
    steps += [
        "c AS (SELECT b.* FROM c3 JOIN b USING (kb, vec_id))",
        f"w AS (SELECT kb, own AS vec_id, count(*) AS n FROM (SELECT b.kb, b.vec_id, arg_min(c.vec_id, (round({far('b.e', 'c.e')}, 6), c.vec_id)) AS own FROM b JOIN c ON c.kb = b.kb GROUP BY ALL) GROUP BY ALL)",
        "cand AS (SELECT c.*, n FROM c JOIN w USING (kb, vec_id))",
        f"""picks AS (SELECT kb, 1 AS i, [arg_min(vec_id, (-n, vec_id))] AS ids FROM cand GROUP BY kb UNION ALL
            SELECT kb, i + 1, list_append(ids, arg_min(vec_id, (-gain, vec_id))) FROM (
              SELECT p.kb, p.i, p.ids, c.vec_id, round(c.n * min({far('c.e', 's.e')}), 6) AS gain FROM picks p JOIN cand c ON c.kb = p.kb JOIN cand s ON s.kb = p.kb AND list_contains(p.ids, s.vec_id)
              WHERE p.i < c.k AND NOT list_contains(p.ids, c.vec_id) GROUP BY p.kb, p.i, p.ids, c.vec_id, c.n) WHERE gain > 0 GROUP BY kb, i, ids)""",
        "m0 AS (SELECT b.kb, b.vec_id AS cid, b.e AS c FROM b JOIN (SELECT kb, unnest(arg_max(ids, i)) AS vec_id FROM picks GROUP BY kb) USING (kb, vec_id))",
    ]
    for r in (1, 2, 3):
        steps += [
            f"a{r} AS (SELECT b.kb, b.vec_id, b.e, arg_min(m.cid, (round({far('b.e', 'm.c')}, 6), m.cid)) AS cid FROM b JOIN m{r - 1} m ON m.kb = b.kb GROUP BY ALL)",
            f"m{r} AS (SELECT kb, cid, list(x ORDER BY pos) AS c FROM (SELECT kb, cid, pos, avg(x) AS x FROM (SELECT kb, cid, unnest(e) AS x, generate_subscripts(e, 1) AS pos FROM a{r}) GROUP BY ALL) GROUP BY ALL)",
        ]
    return f"""WITH RECURSIVE {', '.join(steps)}, z AS (SELECT kb, cid, count(*) AS size FROM a3 GROUP BY ALL),
        o AS (SELECT kb, row_number() OVER (PARTITION BY kb ORDER BY cid) - 1 AS cluster_id, size, c FROM m3 JOIN z USING (kb, cid))
        SELECT kb AS kb_id, cluster_id, size, generate_subscripts(c, 1) - 1 AS pos, round(unnest(c), 6) AS x FROM o"""


ORACLE_SQL: dict[str, str] = {
    "kb_list": f"WITH {DOCS} " + KB_LIST.format(where=""),
    "kb_get": f"WITH {DOCS} " + KB_LIST.format(where="WHERE kb_id = 'src7'"),
    "kb_partition_name": f"WITH {DOCS} SELECT DISTINCT kb_id, kb_part FROM d",
    "kb_update": f"WITH {DOCS}, {KBS} SELECT kb_id, CASE WHEN kb_id IN ('src1', 'src2') THEN 9::BIGINT ELSE no % 5 + 2 END AS kmeans_k FROM k",
    "kb_delete": f"WITH {DOCS}, gone AS (SELECT kb_id FROM d WHERE lang = 'en' GROUP BY kb_id ORDER BY count(*) DESC, kb_id LIMIT 1) "
    + KB_LIST.format(where="WHERE kb_id NOT IN (SELECT kb_id FROM gone)"),
    "client_scope_filter": f"WITH {DOCS} SELECT kb_id, doc_id FROM d WHERE kb_id IN ('src0', 'src3')",
    "doc_list": f"WITH {DOCS} SELECT kb_id, doc_id, lang, length(text) AS n_chars FROM d",
    "doc_get": f"WITH {DOCS} SELECT doc_id, kb_id, text FROM d WHERE doc_id = 7",
    "chunk_list": f"WITH {DOCS} SELECT doc_id, chunk_ix, substr(sha256(doc_id::VARCHAR || chr(31) || chunk_ix::VARCHAR), 1, 12) AS chunk_id, length(content) AS n_chars FROM ({exploded('d', fixed('text'))})",
    "endpoint_roles": f"""WITH {DOCS}, {KBS} SELECT kb_id, a.n_name AS embedding_model, b.n_name AS inference_model FROM k
        LEFT JOIN nation a ON a.n_nationkey = no % 25 LEFT JOIN nation b ON b.n_nationkey = (no * 7) % 30""",
    "client_webhooks": """WITH sent AS (SELECT user_id + 1 AS webhook_id, count(*) AS n FROM events GROUP BY 1)
        SELECT n_nationkey AS client_id, n_name AS label, count(*) AS n_hooks, coalesce(sum(n), 0)::BIGINT AS n_sent
        FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN sent ON s_suppkey = webhook_id GROUP BY 1, 2""",
    "tag_usage": f"""WITH {DOCS}, {TAGGED} SELECT slot, value, count(DISTINCT doc_id) AS n_docs FROM (
        SELECT doc_id, 'tag1' AS slot, tag1 AS value FROM t UNION ALL SELECT doc_id, 'tag2', tag2 FROM t UNION ALL SELECT doc_id, 'tag3', tag3 FROM t)
        WHERE value IS NOT NULL GROUP BY ALL""",
    "next_available_slot": f"""WITH {DOCS}, {TAGGED}, used AS (SELECT DISTINCT kb_id, slot FROM (
        SELECT kb_id, 'tag1' AS slot, tag1 AS value FROM t UNION ALL SELECT kb_id, 'tag2', tag2 FROM t UNION ALL SELECT kb_id, 'tag3', tag3 FROM t) WHERE value IS NOT NULL)
        SELECT kb_id, min(slot) AS next_slot FROM (SELECT kb_id, 'tag' || i AS slot FROM (SELECT DISTINCT kb_id FROM used), generate_series(1, 7) s(i)
        EXCEPT SELECT kb_id, slot FROM used) GROUP BY kb_id""",
    "html_parse": r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g'), ' ') AS text FROM pages""",
    "chunk_fixed": f"WITH {DOCS} {exploded('d', fixed('text'))}",
    "chunk_lines": f"WITH {DOCS} {LINES}",
    "chunk_sentence": f"WITH {DOCS} {SENTENCES}",
    "tokenize_counts": f"SELECT doc_id, len({words('text')}) AS n_tokens FROM documents",
    "keyword_dictionary": f"WITH {DOCS} " + DICTIONARY.format(words=words("text"), rows="d"),
    "keyword_list": f"WITH {DOCS} SELECT keyword, sum(df)::BIGINT AS df, count(*) AS n_kbs FROM ({DICTIONARY.format(words=words('text'), rows='d')}) GROUP BY keyword",
    "document_keywords_tfidf": f"WITH {DOCS}, {TFIDF} SELECT * FROM kws",
    "chunk_keywords": f"WITH {DOCS}, {TFIDF}, {CHUNK_KEYS} SELECT * FROM ck",
    "chunk_keyword_list": f"WITH {DOCS}, {TFIDF}, {CHUNK_KEYS} SELECT keyword, count(*) AS n_chunks, sum(tf)::BIGINT AS n_uses FROM ck GROUP BY keyword",
    "embed_hash_ngram": f"WITH {DOCS} {grams('d', 'doc_id')}",
    "keyword_match_bm25": f"""WITH {DOCS}, {ASKED}, {bm25('d')}, r AS (SELECT query_id, doc_id, round(keyword_score, 6) AS score FROM kw)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM r QUALIFY rank <= 5""",
    "vector_topk": f"WITH {VECTORS}, r AS ({TOPV}) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM r QUALIFY rank <= 10",
    "vector_topk_minscore": f"WITH {VECTORS}, r AS ({TOPV}) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM r WHERE score >= 0.2 QUALIFY rank <= 10",
    "hybrid_query": f"WITH {DOCS}, {EVERY_TEXT}, {hybrid('d', 0.4, 0.1)}",
    "hybrid_query_rrf": f"""WITH {DOCS}, {ASKED}, {bm25('d')}, {cosine('d')},
        l1 AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(keyword_score, 6) DESC, doc_id) AS rank FROM kw QUALIFY rank <= 50),
        l2 AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(vector_score, 6) DESC, doc_id) AS rank FROM vs QUALIFY rank <= 50),
        f AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM (FROM l1 UNION ALL FROM l2) GROUP BY ALL)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM f QUALIFY rank <= 5""",
    "query_with_filter": f"WITH {DOCS}, f AS (SELECT * FROM d WHERE lang IN ('en', 'de') AND NOT n_chars < 300), {ASKED}, {hybrid('f', 0.4, 0.0)}",
    "query_no_content": f"WITH {DOCS}, {ASKED}, {hybrid('d', 1.0, 0.0, 'query_id, rank, doc_id, score')}",
    "v1_tag_query": f"WITH {DOCS}, {TAGGED}, f AS (SELECT * FROM t WHERE tag1 = 'en' AND tag2 = '1'), {ASKED}, {hybrid('f', 0.0, 0.0, 'query_id, rank, doc_id, score')}",
    "cluster_list": f"WITH {VECTORS}, {C0} SELECT cluster_id::BIGINT AS cluster_id, n AS size, (pos - 1)::BIGINT AS pos, round(m, 6) AS x FROM means",
    "cluster_assign": f"WITH {VECTORS}, {C0}, {nearest('a', 'v', 'c0')} SELECT vec_id, cluster_id::BIGINT AS cluster_id, round(distance, 5) AS distance FROM a",
    "cluster_sizes": f"WITH {VECTORS}, {C0}, {nearest('a', 'v', 'c0')} SELECT cluster_id::BIGINT AS cluster_id, count(*) AS size FROM a GROUP BY 1",
    "cluster_neighbors": f"""WITH {VECTORS}, {C0} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY {distance('q', 'centroid')}, cluster_id) - 1 AS rank, cluster_id::BIGINT AS cluster_id
        FROM qv, c0 QUALIFY rank <= 2""",
    "cluster_pruned_topk": f"""WITH {VECTORS}, {C0}, {nearest('a', 'v', 'c0')},
        n AS (SELECT query_id, q, cluster_id FROM qv, c0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY {distance('q', 'centroid')}, cluster_id) <= 3),
        r AS (SELECT query_id, vec_id, round({COSINE.format(a='e', b='q')}, 6) AS score FROM a JOIN n USING (cluster_id))
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM r QUALIFY rank <= 10""",
    "recluster_lloyd": f"WITH {VECTORS}, {lloyd()} SELECT cluster_id, n AS size, (pos - 1)::BIGINT AS pos, round(m, 6) AS x FROM means2",
    "cluster_validate": f"""WITH {VECTORS}, {C0}, {nearest('a', 'v', 'c0')},
        o AS (SELECT v.label AS given, a.cluster_id AS now, sqrt(list_sum(list_transform(list_zip(v.e, c0.centroid), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS own
              FROM v JOIN a USING (vec_id) JOIN c0 ON c0.cluster_id = v.label)
        SELECT given::BIGINT AS cluster_id, count(*) AS size, round(avg(own), 6) AS mean_distance, round(avg((now <> given)::INT::DOUBLE), 6) AS far_share FROM o GROUP BY 1""",
    "clustering_status": """WITH s AS (SELECT CASE WHEN label % 2 = 0 THEN label END AS c, count(*) AS n FROM embeddings GROUP BY 1)
        SELECT sum(n)::BIGINT AS n_rows, coalesce(sum(n) FILTER (c IS NOT NULL), 0)::BIGINT AS n_assigned, count(c) AS n_clusters,
        round(max(n) FILTER (c IS NOT NULL) / sum(n)::DOUBLE, 6) AS largest_share FROM s""",
    "upsert_latest": f"""WITH {DOCS} SELECT kb_id, string_split(text, chr(10))[1] AS filename, doc_id AS version, doc_id FROM d
        QUALIFY row_number() OVER (PARTITION BY kb_id, string_split(text, chr(10))[1] ORDER BY doc_id DESC) = 1""",
    "delete_anti": f"WITH {DOCS} SELECT doc_id, kb_id FROM d WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "exclude_docs": f"WITH {DOCS} SELECT doc_id, kb_id, doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) AS included FROM d",
    "patch_document": f"WITH {DOCS} SELECT doc_id, CASE WHEN lang = 'fr' THEN kb_id || '-fr' ELSE kb_id END AS kb_id, CASE WHEN lang = 'fr' THEN 'fr-FR' ELSE lang END AS lang FROM d",
    "patch_chunk": f"WITH {DOCS} SELECT doc_id, chunk_ix, CASE WHEN chunk_ix = 0 THEN reverse(content) ELSE content END AS content FROM ({LINES})",
    "put_replace_set": f"""WITH {DOCS}, o AS (SELECT * FROM d WHERE lang <> 'de'), g AS (SELECT * FROM d WHERE lang = 'de'),
        o_ AS ({DICTIONARY.format(words=words('text'), rows='o')}), g_ AS ({DICTIONARY.format(words=words('text'), rows='g')})
        SELECT kb_id, keyword, df FROM o_ WHERE kb_id NOT IN (SELECT kb_id FROM g_) UNION ALL SELECT kb_id, keyword, df FROM g_""",
    "partition_create_drop": f"WITH {DOCS} SELECT kb_part, kb_id, count(*) AS n_docs FROM d WHERE kb_id <> 'src3' GROUP BY ALL",
    "batch_finalize": "SELECT user_id AS doc_id, bool_and(event_type <> 'error') AS finished FROM events GROUP BY 1",
    "timeout_sweep": "SELECT event_id AS doc_id FROM events WHERE event_type = 'purchase' AND ts < (SELECT max(ts) FROM events) - INTERVAL 60 MINUTES",
    "event_delivery_ledger": """SELECT user_id % 20 AS webhook_id, count(DISTINCT event_id) AS n_events, count(DISTINCT event_id) FILTER (event_type <> 'error') AS n_delivered,
        max(json_extract(props, '$.k')::INT % 5 + 1) AS max_attempts, arg_max(props, (ts, event_id)) FILTER (event_type = 'error') AS last_error FROM events GROUP BY 1""",
    "pairing_code_valid": """SELECT event_id AS code, json_extract(props, '$.k')::INT % 8 AS attempts FROM events
        WHERE event_type <> 'click' AND date_trunc('hour', ts) + INTERVAL 5 MINUTES > ts AND json_extract(props, '$.k')::INT % 8 < 5""",
    "event_feed": "SELECT event_id, event_type, user_id FROM events",
    "event_feed_dedupe": "SELECT DISTINCT event_id, event_type FROM events",
    "ingest_stream": f"""WITH {DOCS} SELECT kb_id, kb_part, doc_id, count(*) AS n_chunks, sum(length(content))::BIGINT AS n_chars
        FROM ({exploded('d', fixed('text'))}) JOIN d USING (doc_id) GROUP BY kb_id, kb_part, doc_id""",
    "kb_create": f"""WITH {DOCS}, {KBS}, own AS (SELECT kb_id, substr(sha256(kb_id), 1, 12) AS kb_part, 200::BIGINT AS chunk_size, 50::BIGINT AS chunk_overlap, no % 5 + 2 AS kmeans_k FROM k),
        new AS (SELECT CASE WHEN n_nationkey % 5 = 0 THEN 'src' || n_nationkey ELSE n_name END AS kb_id, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey + 100 ELSE 200 END::BIGINT AS chunk_size, (n_nationkey % 4 + 2)::BIGINT AS kmeans_k FROM nation)
        SELECT * FROM own UNION ALL SELECT kb_id, substr(sha256(kb_id), 1, 12), chunk_size, 50, kmeans_k FROM new WHERE kb_id NOT IN (SELECT kb_id FROM own)""",
    "tag_definitions": f"WITH {TAGS} SELECT * FROM defs",
    "tag_definitions_put": f"WITH {TAGS} SELECT * FROM defs WHERE kb_id NOT IN ('src1', 'src2') UNION ALL SELECT DISTINCT kb_id, 'tag1', 'tongue' FROM d WHERE kb_id IN ('src1', 'src2')",
    "endpoints_put": f"WITH {ENDPOINTS} SELECT paired_client_id, id, source, external_id, model FROM put",
    "endpoints_put_ids": f"WITH {ENDPOINTS} SELECT paired_client_id, id, external_id FROM put WHERE source = 'mirrored'",
    "endpoint_external_ids": f"""WITH {ENDPOINTS} SELECT id, external_id, CASE WHEN s_acctbal > 0 THEN 'listed' || (s_suppkey % 7) END AS model, s_acctbal > 0 AS found
        FROM put JOIN supplier ON s_name = external_id WHERE source = 'mirrored'""",
    "webhooks_put": f"""WITH {HOOKS} SELECT paired_client_id, id, url, array_to_string(events, ',') AS events FROM hooks WHERE paired_client_id NOT IN ('0', '1')
        UNION ALL SELECT r_regionkey::VARCHAR, substr(sha256(r_regionkey::VARCHAR || chr(31) || 'https://new.example/' || r_name), 1, 12), 'https://new.example/' || r_name, 'document.ingested' FROM region WHERE r_regionkey < 2""",
    "emit_events": f"""WITH {DOCS}, e AS (SELECT doc_id, kb_id, CASE WHEN length(text) >= 100 THEN 'document.ingested' ELSE 'document.failed' END AS event_type FROM d)
        SELECT substr(sha256(event_type || chr(31) || doc_id::VARCHAR), 1, 12) AS event_id, event_type, kb_id, doc_id FROM e""",
    "webhook_delivery": f"""WITH {HOOKS}, e AS (SELECT event_id, CASE event_type WHEN 'purchase' THEN 'document.ingested' WHEN 'error' THEN 'document.failed' WHEN 'signup' THEN 'clusters.retrained' END AS event_type FROM events),
        p AS (SELECT id AS webhook_id, event_id, event_id % 10 <> 7 AS good FROM e JOIN (SELECT id, unnest(events) AS event_type FROM hooks) USING (event_type))
        SELECT webhook_id, count(*) AS n_events, count(*) FILTER (good) AS n_delivered, max(CASE WHEN good THEN 1 ELSE 3 END)::BIGINT AS max_attempts, max(CASE WHEN NOT good THEN 'status 503' END) AS last_error FROM p GROUP BY 1""",
    "failed_redeems": "SELECT user_id AS code, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type = 'error') >= 5 AS locked FROM events GROUP BY 1",
    "doc_delete_cascade": f"""WITH {DOCS}, l AS (SELECT * FROM d WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)), c AS ({exploded('l', 'string_split(text, chr(10))')}),
        w AS (SELECT DISTINCT doc_id, chunk_ix, unnest({words('content')}) AS term FROM c)
        SELECT 'document' AS name, count(*) AS n_rows, count(DISTINCT doc_id) AS n_docs FROM l UNION ALL SELECT 'chunk', count(*), count(DISTINCT doc_id) FROM c UNION ALL SELECT 'chunk_keyword', count(*), count(DISTINCT doc_id) FROM w""",
    "patch_chunk_reembed": f"""WITH {DOCS}, c AS ({LINES}), r AS (SELECT doc_id, reverse(content) AS text FROM c WHERE chunk_ix = 0), g AS (SELECT doc_id, count(*) AS n FROM ({grams('r', 'doc_id', 128)}) GROUP BY 1)
        SELECT doc_id, chunk_ix, length(content) AS n_chars, CASE WHEN chunk_ix = 0 THEN coalesce(n, 0) ELSE -1 END AS n_buckets FROM c LEFT JOIN g USING (doc_id)""",
    "doc_kb_join": f"WITH {DOCS}, {KBS} SELECT kb_id, doc_id, no % 5 + 2 AS kmeans_k FROM d JOIN k USING (kb_id)",
    "chunk_doc_join": f"WITH {DOCS}, c AS ({LINES}) SELECT doc_id, chunk_ix, {chunk_id()} AS chunk_id, kb_id, lang FROM c JOIN d USING (doc_id)",
    "kb_partition_scan": f"WITH {DOCS} SELECT doc_id, kb_id FROM d WHERE kb_id = 'src3'",
    "job_queue": f"""WITH {DOCS} SELECT 'ingest.document' AS job, kb_id, count(*) AS n_jobs, count(*) AS n_docs FROM d GROUP BY 2 UNION ALL SELECT DISTINCT 'keywords.extract', kb_id, 1, 0 FROM d""",
    "ingest_to_end": f"""WITH {DOCS}, c AS ({exploded('d', fixed('text'))}) SELECT doc_id, 'document.ingested' AS event_type, kb_id, count(*) AS n_chunks, count(*) AS n_embedded, (max(chunk_ix) // 32 + 1)::BIGINT AS n_batches
        FROM c JOIN d USING (doc_id) GROUP BY doc_id, kb_id""",
    "kb_query": answered("SELECT query_id, rank, doc_id AS chunk_id, score, vector_score, keyword_score FROM ranked WHERE rank <= 5"),
    "kb_query_usage": f"""WITH {DOCS}, {ASKED}, {BASE} SELECT (SELECT count(*) FROM every_) AS scanned, (SELECT count(*) FROM ch) AS kept, (SELECT coalesce(sum(len({words('text')})), 0)::BIGINT FROM q) AS query_tokens""",
    "kb_query_diagnostics": answered("SELECT query_id, count(rank) AS matches, max(score) AS best_score, min(score) AS least_score FROM q LEFT JOIN (SELECT * FROM ranked WHERE rank <= 5) USING (query_id) GROUP BY query_id"),
    "retrain_event": f"""WITH {VECTORS}, {C0}, {nearest('a', 'v', 'c0')}
        SELECT 'clusters.retrained' AS event_type, 'all' AS kb_id, count(DISTINCT cluster_id) AS n_clusters, count(*) AS n_rows FROM a""",
    "vector_index_topk": f"WITH {VECTORS}, r AS ({TOPV}) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM r QUALIFY rank <= 10",
    "vector_index_base": f"WITH {VECTORS}, r AS ({TOPV} WHERE label = 3) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM r WHERE score >= 0.1 QUALIFY rank <= 5",
    "vector_index_contents": "SELECT substr(sha256('label' || label::VARCHAR), 1, 12) AS kb_part, vec_id FROM embeddings WHERE label <> 3",
    "webhook_backoff": f"""WITH {HOOKS}, e AS (SELECT event_id, CASE event_type WHEN 'purchase' THEN 'document.ingested' WHEN 'error' THEN 'document.failed' WHEN 'signup' THEN 'clusters.retrained' END AS event_type FROM events),
        p AS (SELECT id AS webhook_id, event_id, event_id % 10 = 7 AS never, event_id % 10 = 3 AS late FROM e JOIN (SELECT id, unnest(events) AS event_type FROM hooks) USING (event_type))
        SELECT webhook_id, count(*) AS n_events, sum(CASE WHEN never THEN 4 WHEN late THEN 3 ELSE 1 END)::BIGINT AS n_attempts, count(*) FILTER (NOT never) AS n_delivered, count(*) FILTER (never) AS n_failed,
               sum(CASE WHEN never THEN 100 + 200 + 400 WHEN late THEN 100 + 200 END)::BIGINT AS wait_ms, max(CASE WHEN never OR late THEN 'status 503' END) AS last_error FROM p GROUP BY 1""",
    "timeout_sweep_stream": "SELECT event_id AS doc_id FROM events WHERE event_type = 'purchase' AND ts < (SELECT max(ts) FROM events) - INTERVAL 60 MINUTES",
    "url_ingest": """SELECT page_id, url, CASE WHEN url IS NULL OR length(url) % 10 IN (0, 3) THEN 'failed' ELSE 'completed' END AS status,
        CASE WHEN url IS NULL THEN 'no url' WHEN length(url) % 10 = 0 THEN 'status 404' WHEN length(url) % 10 = 3 THEN 'ConnectionError: refused' END AS error,
        CASE WHEN length(url) % 10 = 2 THEN url || '#moved' WHEN length(url) % 10 NOT IN (0, 3) THEN url END AS text FROM pages""",
    "keyword_dictionary_stream": f"""WITH {DOCS}, now AS (SELECT kb_id, CASE WHEN doc_id % 9 = 1 THEN string_split(text, chr(10))[1] ELSE text END AS text FROM d WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)) """
    + DICTIONARY.format(words=words("text"), rows="now"),
    "embed_resume": f"""WITH {DOCS}, c AS ({exploded('d', fixed('text'))}), b AS (SELECT doc_id, chunk_ix // 8 AS b, count(*) AS n, arg_min(length(content), chunk_ix) % 7 = 0 AS bad FROM c GROUP BY ALL)
        SELECT doc_id, count(*) AS n_batches, sum(CASE WHEN bad THEN 2 ELSE 1 END)::BIGINT AS n_tries, true AS done, sum(n)::BIGINT AS n_vectors FROM b GROUP BY 1""",
    "recluster_bases": kmeans_bases(),
    "cluster_silhouette": f"""WITH b AS (SELECT 'b' || (label % 3)::VARCHAR AS kb_id, label AS cluster_id, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
        d AS (SELECT x.kb_id, x.cluster_id, x.vec_id, y.cluster_id AS other, sum({far('x.e', 'y.e')}) AS s, count(*) AS n FROM b x JOIN b y ON x.kb_id = y.kb_id GROUP BY ALL),
        s AS (SELECT kb_id, cluster_id, vec_id, sum(s) FILTER (other = cluster_id) / greatest(sum(n) FILTER (other = cluster_id) - 1, 1) AS a, min(s / n) FILTER (other <> cluster_id) AS b, sum(n) FILTER (other = cluster_id) AS own FROM d GROUP BY ALL)
        SELECT kb_id, cluster_id::BIGINT AS cluster_id, count(*) AS size, round(avg(CASE WHEN own > 1 AND b IS NOT NULL AND greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END), 6) AS silhouette FROM s GROUP BY ALL""",
    "retrain_stream": """SELECT 'clusters.retrained' AS event_type, 'b' || (label % 3)::VARCHAR AS kb_id, 0::BIGINT AS batch, (label % 3 + 2)::BIGINT AS n_clusters, count(*) AS n_rows FROM embeddings WHERE vec_id % 10 < 7 GROUP BY label % 3
        UNION ALL SELECT 'clusters.retrained', 'b' || (label % 3)::VARCHAR, 2, (label % 3 + 2)::BIGINT, count(*) FROM embeddings GROUP BY label % 3""",
    "filter_nested": """SELECT doc_id FROM documents WHERE (doc_id % 7 <> 0 AND n_chars >= 1500 AND doc_id % 11 <> 0 AND 'de' IN (lang, source))
        OR (doc_id % 11 <> 0 AND source IN ('src1', 'src2') AND doc_id % 7 <> 0 AND n_chars >= 900.5) OR doc_id % 97 = 0""",
    "worker_documents": f"""WITH {DOCS}, c AS ({exploded('d', fixed('text'))}) SELECT doc_id, 'document.ingested' AS event_type, kb_id, (max(chunk_ix) // 8 + 1)::BIGINT AS n_batches, (max(chunk_ix) // 8 + 1)::BIGINT AS n_tries,
        count(*) AS n_vectors, CASE WHEN regexp_extract(kb_id, '([0-9]+)$', 1)::INT % 2 = 0 THEN 64 ELSE 32 END::BIGINT AS width FROM c JOIN d USING (doc_id) GROUP BY doc_id, kb_id""",
    "worker_keywords": f"WITH {DOCS} " + DICTIONARY.format(words=words("text"), rows="d"),
}
