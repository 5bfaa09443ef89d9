"""The queries of this subpackage, over whole tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, divergence, fingerprints, language_id, mixing, phrases, sentencepiece_sa, sharding, simhash_dedup, token_counts, token_io, topk, toxicity
from .common import delete_at_exit, fresh_path, table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(50)) == 0)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-files")
    token_io.write_tokens(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), path)
    delete_at_exit(spark, path)
    return token_io.read_tokens(spark, path)


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, pieces_crc32 (of the ids as decimal numbers with spaces), decoded_same (decoding gives the text back)."""
    docs = sentencepiece_sa.encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("piece_bpe_32k.model"))
    text = F.replace(F.coalesce("text", F.lit("")), F.lit(sentencepiece_sa.SPACE), F.lit(" "))
    ids = F.encode(F.array_join("piece_ids", " "), "UTF-8")
    return docs.select("doc_id", F.size("piece_ids").cast("long").alias("n_pieces"), F.crc32(ids).alias("pieces_crc32"), (F.col("decoded") == text).alias("decoded_same"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.predict_languages(docs, language_id.train_network(docs))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, copy_no, n_bytes, text_md5 of every copy in the mix, in its order."""
    mixed = mixing.poisson_mix(table(spark, sf_dir, "documents"), copy_column="copy_no")
    return mixed.select("doc_id", "source", F.col("copy_no").cast("long").alias("copy_no"), F.octet_length("text").cast("long").alias("n_bytes"), F.md5("text").alias("text_md5"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_conversations(table(spark, sf_dir, "conversations"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_simhash_dedup, op3_exact_top_k, op4_token_files, op5_fingerprints, op6_sentencepiece, op7_sharding, op8_language_id, op9_mixing, op10_chat, op11_toxicity, op12_collocations, op13_divergence, pipeline)}

ORACLE_SQL = {
    "op3_exact_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
            FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
        ), r AS (
            SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op9_mixing": """
        WITH s AS (SELECT source, count(*) AS n, pow(count(*)::DOUBLE, 0.5) AS w FROM documents GROUP BY source),
        r AS (SELECT source, w / (SELECT sum(w) FROM s) * (SELECT sum(n) FROM s)::DOUBLE / n AS rate FROM s),
        m AS (SELECT source, greatest(1, ceil(rate / 16.0))::BIGINT AS parts, rate / greatest(1, ceil(rate / 16.0)) AS mean FROM r),
        k AS (SELECT range AS k, coalesce(sum(ln(greatest(range, 1))) OVER (ORDER BY range), 0) AS lnfact FROM range(96)),
        cdf AS (SELECT source, parts, k, sum(exp(-mean + k * ln(mean) - lnfact)) OVER (PARTITION BY source ORDER BY k) AS c FROM m, k),
        u AS (
            SELECT d.doc_id, d.source, d.text, i.i, ('0x' || substr(md5('42|' || coalesce(d.doc_id || '|', '') || md5(coalesce(d.text, '')) || '|' || i.i), 1, 13))::BIGINT / 4503599627370496.0 AS u
            FROM documents d JOIN m ON d.source IS NOT DISTINCT FROM m.source, LATERAL (SELECT unnest(range(1, m.parts + 1)) AS i) i
        ),
        n AS (SELECT u.doc_id, u.source, u.text, count(*) AS copies FROM u JOIN cdf ON u.source IS NOT DISTINCT FROM cdf.source AND cdf.c <= u.u GROUP BY ALL)
        SELECT doc_id, source, unnest(range(1, copies + 1)) AS copy_no, strlen(text) AS n_bytes, md5(text) AS text_md5 FROM n
    """,
    "op10_chat": """
        WITH t AS (
            SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS place,
                   coalesce(role, '') AS role, coalesce(text, '') AS text
            FROM conversations
        ),
        p AS (
            SELECT conv_id, place, place + 1 AS n, count(*) OVER (PARTITION BY conv_id) AS whole,
                   string_agg(length(role) || ':' || length(text) || ':' || role || text, '') OVER (PARTITION BY conv_id ORDER BY place) AS said
            FROM t
        ),
        f AS (SELECT min(conv_id) AS conv_id, n AS n_turns, count(*) AS n_same, said FROM p WHERE n = whole GROUP BY n, said),
        kept AS (SELECT f.* FROM f WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.n = f.n_turns AND p.said = f.said AND p.n < p.whole))
        SELECT t.conv_id, t.place // 1024 AS part, any_value(kept.n_turns) AS n_turns, any_value(kept.n_same) AS n_same,
               string_agg('<|turn_start|>' || replace(t.role, '<|turn_', '<turn_') || chr(10) || replace(t.text, '<|turn_', '<turn_') || '<|turn_end|>' || chr(10), '' ORDER BY t.place) AS rendered
        FROM t JOIN kept ON t.conv_id IS NOT DISTINCT FROM kept.conv_id GROUP BY 1, 2
    """,
    "op12_collocations": r"""
        WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
        p AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]'), lambda w: w <> '') AS w FROM (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)),
        n AS (SELECT lang, sum(len(w)) AS n FROM p GROUP BY lang),
        g AS (SELECT lang, k.k, array_to_string(w[i.i : i.i + k.k - 1], ' ') AS phrase FROM p, (SELECT unnest([1, 2, 3, 4]) AS k) k, LATERAL (SELECT unnest(range(1, len(w) - k.k + 2)) AS i) i),
        f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
        c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
        cuts AS (
            SELECT c.lang, c.phrase, c.a, t.t, l.f AS l, r.f AS r, (c.a::HUGEINT * 2000000) // (l.f + r.f) AS score
            FROM c, LATERAL (SELECT unnest(range(1, c.k)) AS t) t
            JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1 : t.t], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[t.t + 1 : c.k], ' ')
        ),
        lowest AS (SELECT lang, phrase, a, l, r, score FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, t) = 1),
        inner_parts AS (
            SELECT c.lang, array_to_string(c.w[i.i : i.i + m.m - 1], ' ') AS phrase, max(c.a) AS longer
            FROM c, LATERAL (SELECT unnest(range(2, c.k)) AS m) m, LATERAL (SELECT unnest(range(1, c.k - m.m + 2)) AS i) i GROUP BY ALL
        ),
        ranked AS (
            SELECT l.*, row_number() OVER (PARTITION BY l.lang ORDER BY l.score DESC, l.a DESC, l.phrase) AS rank
            FROM lowest l LEFT JOIN inner_parts x ON x.lang = l.lang AND x.phrase = l.phrase WHERE x.longer IS NULL OR 100 * x.longer < 80 * l.a
        )
        SELECT r.lang, rank, phrase, a, l, r, n.n::BIGINT AS n, score::BIGINT AS score FROM ranked r JOIN n ON n.lang = r.lang WHERE rank <= 2000
    """,
    "op13_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
        t AS (SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
        k AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT doc) >= 3),
        v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
        c AS (SELECT t.lang, t.source, t.term, count(*) AS c FROM t SEMI JOIN k ON t.lang = k.lang AND t.term = k.term GROUP BY ALL),
        g AS (SELECT g.lang, g.source, coalesce(s.n, 0) AS n FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN (SELECT lang, source, sum(c) AS n FROM c GROUP BY ALL) s USING (lang, source)),
        p AS (
            SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 1)) // (g.n + v.v) AS p
            FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
        ),
        whole AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(c) + 1)) // (sum(sum(c)) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang)) AS q FROM p GROUP BY lang, term),
        pair AS (
            SELECT a.lang, a.source, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
            FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN (
                SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // y.p) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
            ) f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
        ),
        term AS (SELECT p.lang, p.source, p.term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM p JOIN whole w ON w.lang = p.lang AND w.term = p.term WHERE c > 0 AND p > q)
        SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pair
        UNION ALL
        SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM term QUALIFY rank <= 200
    """,
}
