"""The thin queries of the ten operators: each applies one to its whole table and returns the digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, jaccard, packing, quality, repeats, sanitize, secrets, sharding, spans, topk
from .common import table


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs, secrets.train(secrets.samples(docs)))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(spans.listed(F.col("base_spans"), secrets.KINDS), 256).alias("base_sha256"), spans.listed(F.col("spans"), secrets.KINDS).alias("spans"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer(), ids=False)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.histogram_sort(table(spark, sf_dir, "documents"), 8)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sanitize.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone",
        F.sha2(spans.listed(F.col("base_spans"), sanitize.KINDS, by_kind=True), 256).alias("base_sha256"), spans.listed(F.col("spans"), sanitize.KINDS, by_kind=True).alias("spans"),
    )


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chat.dialogues(chat.rotate(table(spark, sf_dir, "conversations")))
    masks = F.array_join(F.transform("masks", lambda m: F.concat_ws(":", m["start"].cast("string"), m["end"].cast("string"))), ",")
    return found.withColumn("masks", masks)


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 256.0)
    return topk.search(vectors.where(F.col("_id") % 50 == 0), vectors, 5)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.transform(F.coalesce("items", F.array().cast("array<bigint>")), lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), "contaminated")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"), kept=False)


QUERIES = {
    "op1_secret_scans": op1_secret_scans,
    "op2_packing": op2_packing,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_sharding": op4_sharding,
    "op5_pii": op5_pii,
    "op6_chat_formatting": op6_chat_formatting,
    "op7_topk": op7_topk,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_decontamination": op9_decontamination,
    "op10_suffix_dedup": op10_suffix_dedup,
}

ORACLES = {
    "op8_jaccard_join": """
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM w WHERE len(w) > 0)
        ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
        ), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
        ), l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
        ), r AS (SELECT doc_id, doc_id AS reach FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.reach = l.a
        ), m AS (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY doc_id)
        SELECT m.doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM m LEFT JOIN n USING (doc_id)
    """,
    "op10_suffix_dedup": """
        WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents
        ), w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS g FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM h)
        ), f AS (SELECT g, min(doc_id) AS first FROM w GROUP BY g
        ), c AS (SELECT w.doc_id, i, lag(i) OVER (PARTITION BY w.doc_id ORDER BY i) AS before FROM w JOIN f USING (g) WHERE first < w.doc_id
        ), g AS (SELECT *, sum(CASE WHEN before IS NULL OR i - before > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM c
        ), s AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS z FROM g GROUP BY ALL
        ), k AS (
            SELECT doc_id, a, z, substr(h, 2 * coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) + 1, 2 * (a - coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0))) AS kept FROM s JOIN h USING (doc_id)
        ), t AS (SELECT doc_id, count(*) AS n_spans, sum(z - a) AS n_removed, max(z) AS z, string_agg(kept, '' ORDER BY a) AS kept FROM k GROUP BY doc_id)
        SELECT h.doc_id, CAST(h.n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
            sha256(unhex(coalesce(kept, '') || substr(h.h, 2 * coalesce(z, 0) + 1))) AS kept_sha256
        FROM h LEFT JOIN t USING (doc_id)
    """,
    "op6_chat_formatting": """
        WITH r AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, replace(coalesce(text, ''), '<|', '<\\|') AS content FROM conversations),
        v AS (SELECT DISTINCT conv_id, speaker AS perspective FROM r WHERE speaker <> 'system'),
        m AS (
            SELECT r.conv_id, perspective, turn, speaker, content,
                CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role
            FROM r JOIN v ON r.conv_id IS NOT DISTINCT FROM v.conv_id
        ), h AS (SELECT *, '<|im_start|>' || role || CASE WHEN role = 'user' THEN ' name=' || regexp_replace(speaker, '[^\\p{L}\\p{N}_.-]', '_', 'g') ELSE '' END || chr(10) AS head FROM m),
        s AS (SELECT *, turn // 256 AS part, head || content || '<|im_end|>' || chr(10) AS segment FROM h),
        p AS (SELECT *, sum(length(segment)) OVER (PARTITION BY conv_id, perspective, part ORDER BY turn, speaker, segment ROWS UNBOUNDED PRECEDING) AS stop FROM s)
        SELECT conv_id, perspective, part, CAST(count(*) AS INT) AS turns, string_agg(segment, '' ORDER BY stop) AS text,
            coalesce(string_agg((stop - length(segment) + length(head)) || ':' || stop, ',' ORDER BY stop) FILTER (role = 'assistant'), '') AS masks
        FROM p GROUP BY conv_id, perspective, part
    """,
    "op9_decontamination": """
        WITH d AS (
            SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents
        ), b AS (
            SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM benchmark
        ), bw AS (
            SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
            FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT item_id, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0))
        ), sizes AS (SELECT DISTINCT n FROM bw), dw AS (
            SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
        ), met AS (SELECT doc_id, item_id, dw.n, i FROM dw JOIN bw USING (n, g)
        ), hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM met) GROUP BY doc_id
        ), its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM met) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
            sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
    """,
    "op7_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
        )
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
    """,
}
