"""The operators' queries over whole tables, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from lexiloom.llm import katz
from lexiloom.llm.bpe import encode_documents
from lexiloom.llm.chat import format_conversations, read_loss_text, read_turns
from lexiloom.llm.extraction import extract_main_text
from lexiloom.llm.filter_audit import filter_audit
from lexiloom.llm.lexical import ranked_search
from lexiloom.llm.mixing import mix_sources
from lexiloom.llm.neardup import near_duplicates
from lexiloom.llm.privacy import find_personal_data
from lexiloom.llm.quality import quality_rules
from lexiloom.llm.toxicity import toxicity
from lexiloom.llm.voronoi import integer_vectors, top_k
from lexiloom.llm.warc import archive_round_trip

BPE_RANKS = "byte_bpe_multi_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(_table(spark, sf_dir, "pages"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_RANKS), public_tokenizers.PATTERN)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents")).drop("text_key")


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(_table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = archive_round_trip(_table(spark, sf_dir, "pages"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


#: A conversation that speaks the template's and other control strings.
CONTROL_ID, CONTROL_TEXT = -7, "\\### Assistant: </turn> ok"


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = turns.sparkSession.range(2).select(
        F.lit(CONTROL_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text")
    )
    made = format_conversations(turns.unionByName(control))
    read = made.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss_text(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(_table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.filter("vec_id % 20 = 0"))


def op11_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores are rounded to six decimals, so that the order of sums does not show."""
    scored = katz.score_documents(_table(spark, sf_dir, "documents"))
    return scored.withColumns({c: F.round(c, 6) for c in ("base_score", "score")})


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).drop("filter")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mixing,
        op2_html_extraction,
        op3_near_duplicates,
        op4_byte_bpe,
        op5_warc,
        op6_quality_rules,
        op7_personal_data,
        op8_toxicity,
        op9_chat_formatting,
        op10_exact_top_k,
        op11_katz_scores,
        op12_filter_audit,
        op13_ranked_search,
    )
}

_ESCAPED = "replace(replace(replace({}, '\\', '\\b'), '<', '\\l'), '>', '\\g')"

#: Katz's discounts of counts 1 to 5 from the list n of counts of counts 1 to 6.
_KATZ = "((i + 1.0) * n[i + 1] / (1.0 * i * n[i]) - 6.0 * n[6] / n[1]) / (1 - 6.0 * n[6] / n[1])"
_DISCOUNTS = f"list_transform(range(1, 6), lambda i: CASE WHEN n[1] = 0 OR n[i] = 0 OR 6.0 * n[6] = n[1] THEN 1.0 WHEN {_KATZ} > 0 AND {_KATZ} < 1 THEN {_KATZ} ELSE 1.0 END)"

ORACLE_SQL: dict[str, str] = {
    "op3_near_duplicates": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN []
                                  WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                                  ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
        n AS (SELECT doc_id, len(sh) AS n FROM s),
        e AS MATERIALIZED (SELECT doc_id, unnest(sh) AS g FROM s),
        common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        pairs AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
        links AS MATERIALIZED (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
        reach AS (SELECT doc_id, doc_id AS m FROM n UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.m = l.a),
        c AS (SELECT doc_id, min(m) AS component_id FROM reach GROUP BY 1)
        SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c USING (doc_id)""",
    "op5_warc": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS h FROM pages),
             q AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
               CASE WHEN n >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 100 AND page_id > first THEN first END AS refers_to
        FROM q""",
    "op9_chat_formatting": f"""
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT {CONTROL_ID}, 0, 'user', '{CONTROL_TEXT}'
            UNION ALL SELECT {CONTROL_ID}, 1, 'assistant', '{CONTROL_TEXT}')
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(length('<turn ' || {_ESCAPED.format("role")} || '>' || {_ESCAPED.format("text")} || '</turn>' || chr(10))) AS BIGINT) AS formatted_chars
        FROM c GROUP BY conv_id""",
    "op10_exact_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings),
             s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
                   FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
             r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op11_katz_scores": r"""
        WITH d AS (SELECT doc_id, coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS t,
                          xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(str_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                              lambda a, x: list_reduce(list_concat([xor(a, x)], range(8)), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)))), 4294967295) % 7 = 2 AS held FROM documents),
        w AS MATERIALIZED (SELECT doc_id, held, list_append(regexp_extract_all(t, '[^\x20\x09-\x0D]+'), ' end') AS ws FROM d),
        k AS MATERIALIZED (SELECT doc_id, held, CASE WHEN i = 1 THEN ' start' ELSE ws[i - 1] END AS b, ws[i] AS c FROM w, unnest(range(1, len(ws) + 1)) AS u(i)),
        one AS MATERIALIZED (SELECT c, count(*) AS r FROM k WHERE NOT held GROUP BY 1),
        two AS MATERIALIZED (SELECT b, c, count(*) AS r FROM k WHERE NOT held GROUP BY 1, 2),
        g AS (SELECT sum(r) AS big_n, count(*) AS v, list_transform(range(1, 7), lambda i: len(list_filter(list(r), lambda x: x = i))) AS n FROM one),
        h AS (SELECT list_transform(range(1, 7), lambda i: len(list_filter(list(r), lambda x: x = i))) AS n FROM two),
        de AS (SELECT DISCOUNTS AS e FROM g),
        dd AS (SELECT DISCOUNTS AS d FROM h),
        p1 AS MATERIALIZED (SELECT c, r, r * (CASE WHEN r <= 5 THEN e[r] ELSE 1.0 END) / (big_n + 1) AS p FROM one, g, de),
        unknown AS (SELECT 1 - sum(p) AS p FROM p1),
        p2 AS MATERIALIZED (SELECT b, c, r * (CASE WHEN r <= 5 THEN d[r] ELSE 1.0 END) / (sum(r) OVER (PARTITION BY b) + 1) AS p FROM two, dd),
        alpha AS MATERIALIZED (SELECT b, (1 - sum(p2.p)) / (1 - sum(p1.p)) AS a FROM p2 JOIN p1 USING (c) GROUP BY b),
        s AS (SELECT doc_id, held, p1.r, log10((coalesce(p1.r, 0) + 1.0) / (big_n + v + 1)) AS base, log10(coalesce(p2.p, coalesce(a, 1.0) * coalesce(p1.p, unknown.p))) AS own
              FROM k LEFT JOIN p2 USING (b, c) LEFT JOIN p1 USING (c) LEFT JOIN alpha USING (b), g, unknown)
        SELECT doc_id, any_value(held) AS held_out, CAST(count(*) AS BIGINT) AS n_tokens, CAST(count(r) AS BIGINT) AS n_known, CAST((SELECT big_n FROM g) AS BIGINT) AS train_tokens,
               round(sum(base), 6) AS base_score, round(sum(own), 6) AS score
        FROM s GROUP BY doc_id""".replace("DISCOUNTS", _DISCOUNTS),
    "op12_filter_audit": r"""
        WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        l AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY 1),
        f AS (SELECT part, doc_id, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
                     [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t),
                      regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS fails
              FROM d LEFT JOIN l USING (doc_id)),
        c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic, len(list_filter(fails, lambda x: x)) AS k FROM f GROUP BY 1, 2),
        o AS (SELECT [a.x, b.x, c.x, d.x, e.x] AS p FROM range(1, 6) a(x), range(1, 6) b(x), range(1, 6) c(x), range(1, 6) d(x), range(1, 6) e(x)
              WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
        s AS (SELECT p, step, p[step] AS own, list_slice(p, 1, step - 1) AS earlier FROM o, range(1, 6) r(step)),
        e AS (SELECT part, n, good, toxic, k, p, step, fails[own] AS own, len(list_filter(earlier, lambda i: fails[i])) > 0 AS gone FROM c, s)
        SELECT part, array_to_string(list_transform(p, lambda i: substr('ABCDE', CAST(i AS INTEGER), 1)), '') AS filter_order, CAST(step AS INTEGER) AS step,
               CAST(coalesce(sum(n) FILTER (WHERE NOT own AND NOT gone), 0) AS BIGINT) AS kept,
               CAST(coalesce(sum(n) FILTER (WHERE own AND NOT gone), 0) AS BIGINT) AS removed,
               CAST(coalesce(sum(n) FILTER (WHERE own AND gone), 0) AS BIGINT) AS redundant,
               CAST(coalesce(sum(n) FILTER (WHERE own AND k = 1), 0) AS BIGINT) AS unique_fails,
               CAST(coalesce(sum(good) FILTER (WHERE own AND NOT gone), 0) AS BIGINT) AS good_lost,
               CAST(coalesce(sum(toxic) FILTER (WHERE own AND NOT gone), 0) AS BIGINT) AS toxic_lost,
               CAST(coalesce(sum(n * (120 // greatest(k, 1))) FILTER (WHERE own), 0) AS BIGINT) AS shapley
        FROM e GROUP BY part, p, step""",
    "op13_ranked_search": r"""
        WITH d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        w AS MATERIALIZED (SELECT doc_id, r, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM d),
        g AS (SELECT count(*) AS big_n, sum(len(ws)) AS big_l FROM w WHERE len(ws) > 0),
        tf AS MATERIALIZED (SELECT doc_id, r, len(ws) AS n, u.term, count(*) AS tf FROM w, unnest(ws) AS u(term) GROUP BY ALL),
        q AS (SELECT DISTINCT item_id, u.term FROM benchmark,
              unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS u(term)),
        df AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * (SELECT big_n FROM g) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM tf GROUP BY term),
        s AS (SELECT item_id, r, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big_n) // big_l)))) AS BIGINT) AS score
              FROM q JOIN tf USING (term) JOIN df USING (term), g GROUP BY 1, 2, 3),
        k AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10""",
}
