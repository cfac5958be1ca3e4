"""The registered queries of the operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable
from secrets import token_hex

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from .chat_format import format_conversations
from .decontaminate import contaminated
from .embedding_dedup import near_duplicates
from .html_text import extract_pages
from .ngram_join import link_documents
from .packing import pack
from .pseudonyms import KINDS, pseudonymise
from .quality import classify
from .repair import damaged, repair
from .secrets import scan
from .sharding import shard_documents
from .url_filters import judge
from .whitening import whiten


PII_KEY = "spark.quernstone.pii.secret"  # Spark hides the values of settings with such names


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the whole text with pseudonyms, and how many findings of each kind were replaced.

    The key is the session's PII_KEY; where it is unset, one is drawn for the session, so its runs agree.
    """
    if not (key := spark.conf.get(PII_KEY, None)):
        spark.conf.set(PII_KEY, key := token_hex(16))
    done = pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key)
    counts = [(F.size("found") - F.size(F.array_remove("found.kind", kind))).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return done.select("doc_id", "text", *counts)


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


def vocabulary() -> str:
    """The public tokenizer's file, on every machine of the cluster."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary())


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"), 8).withColumn("deviation", F.col("deviation").cast("long"))


def op12_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's conversations, and one of another layout whose texts look like marks."""
    mark = F.lit("</s>[INST] ok [/INST]")
    more = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), mark.alias("prompt"), mark.alias("completion"))
    return format_conversations(table(spark, sf_dir, "conversations"), more)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_pii": op2_pii,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_sharding": op4_sharding,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_url_filters": op6_url_filters,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_packing": op8_packing,
    "op9_secret_scans": op9_secret_scans,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_chat_formatting": op12_chat_formatting,
    "op13_conversation_repair": op13_conversation_repair,
}

REACH = "reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)"


def _escaped(text: str) -> str:
    return rf"regexp_replace({text}, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g')"


def _repair_sql() -> str:
    """The table of whole audits: nine digits of cost and the audit for each state, one row of a conversation after the other."""

    def plus(entry: str, cost: str, edit: str, when: str = "true") -> str:
        return f"CASE WHEN {when} THEN printf('%09d', substr({entry}, 1, 9)::BIGINT + {cost}) || substr({entry}, 10) || '{edit}' END"

    ok, more, order = "coalesce(fault, '') NOT IN ('blank', 'duplicate')", "(CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END)", "turn NULLS FIRST"
    to_user = ", ".join([*[plus(e, f"3 + {more}", "R", ok) for e in ("e0", "e1", "n3")], *[plus(e, more, "K", f"{ok} AND r = 'u'") for e in ("e0", "e1", "n3")]])
    inserted = f"least(e2, {plus('e0', '3', 'I')}, {plus('e1', '3', 'I')}, {plus('e3', '3', 'I')})"
    space = r"\x20\x09-\x0D"
    return rf"""WITH RECURSIVE
    raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
    drawn AS (SELECT *, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(name, ''), lambda c: [unicode(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
              lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, (c & 1) * 3988292384) END), 4294967295) % 20 AS draw FROM raw),
    rows_ AS (SELECT conv_id, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role, CASE draw WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
              unnest(CASE WHEN draw = 3 THEN [0, 1] ELSE [0] END) AS copy FROM drawn WHERE draw <> 0),
    placed AS (SELECT *, left(role, 1) AS r, row_number() OVER (PARTITION BY conv_id ORDER BY {order}, role, text) AS i FROM rows_),
    copies AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth FROM placed),
    f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^{space}]') THEN 'blank' WHEN nth > 1 THEN 'duplicate'
          WHEN regexp_matches(text, '[^.!?{space}][{space}]*$') THEN 'truncated' END AS fault,
          coalesce(lag(r) OVER (PARTITION BY conv_id ORDER BY i) || r NOT IN ('su', 'ua', 'au'), false) AS bad FROM copies),
    dp AS (SELECT DISTINCT conv_id, 0::BIGINT AS i, '000000000' AS e0, NULL::VARCHAR AS e1, NULL::VARCHAR AS e2, NULL::VARCHAR AS e3 FROM conversations UNION ALL
           SELECT conv_id, i, {plus('e0', '4', 'D')}, least({plus('e1', '4', 'D')}, {plus('e0', more, 'K', f"{ok} AND r = 's'")}), least({plus('n2', '4', 'D')}, {to_user}),
                  least({plus('n3', '4', 'D')}, {plus('n2', f'3 + {more}', 'R', ok)}, {plus('n2', more, 'K', f"{ok} AND r = 'a'")})
           FROM (SELECT d.conv_id, f.i, f.r, f.fault, e0, e1, n2, least(e3, {plus('n2', '3', 'I')}) AS n3
                 FROM (SELECT *, {inserted} AS n2 FROM dp) d JOIN f ON f.conv_id IS NOT DISTINCT FROM d.conv_id AND f.i = d.i + 1)),
    ends AS (SELECT conv_id, least(e0, e3, {plus('n2', '3', 'I')}) AS e FROM (SELECT *, {inserted} AS n2, row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) AS back FROM dp) WHERE back = 1),
    won AS (SELECT conv_id, substr(e, 1, 9)::BIGINT AS cost, substr(e, 10) AS audit, length(replace(substr(e, 10), 'D', '')) % 2 AS odd FROM ends),
    edits AS (SELECT conv_id, odd, p, substr(audit, p, 1) AS edit, length(replace(substr(audit, 1, p), 'I', '')) AS i, length(replace(substr(audit, 1, p), 'D', '')) AS o
              FROM (SELECT *, unnest(generate_series(1, length(audit))) AS p FROM won)),
    told AS (SELECT e.conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (o - odd) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS t
             FROM edits e LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.i = e.i AND edit <> 'I' WHERE edit <> 'D' GROUP BY e.conv_id),
    counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
               count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (bad) AS illegal FROM f GROUP BY conv_id)
    SELECT w.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
           cost, audit, sha256(coalesce(t, '')) AS repaired_sha256
    FROM won w LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM w.conv_id"""


ORACLE_SQL: dict[str, str] = {
    "op3_ngram_jaccard_join": rf"""WITH RECURSIVE
    w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
          ELSE list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
    e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
    links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
              GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
    {REACH}
    SELECT doc_id, len(s) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id FROM s LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) ON a = doc_id""",
    "op7_embedding_dedup": f"""WITH RECURSIVE
    v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
          WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    u AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS l FROM v),
    links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM u p, u q WHERE p.vec_id <> q.vec_id AND len(p.e) = len(q.e) AND list_inner_product(p.e, q.e) / (p.l * q.l) >= 0.95),
    {REACH},
    r AS (SELECT vec_id, least(vec_id, coalesce((SELECT min(b) FROM reach WHERE a = vec_id), vec_id)) AS component_id FROM embeddings)
    SELECT r.vec_id, (SELECT count(*) FROM links WHERE a = r.vec_id) AS n_links, component_id, r.vec_id = component_id AS kept FROM r""",
    "op12_chat_formatting": f"""WITH
    c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, 'rows' AS layout FROM conversations
          UNION ALL SELECT -7, unnest([1, 2]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]', 'prompt_completion')
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
           coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
           sum(20 + length({_escaped('role')}) + length({_escaped('text')}))::BIGINT AS formatted_chars, layout FROM c GROUP BY conv_id, layout""",
    "op13_conversation_repair": _repair_sql(),
}
