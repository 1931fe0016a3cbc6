"""The corpus operators' queries, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_fold, free_name, table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), limit=2048)


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import labelled_strings, markov_ratio, scan_secrets, spans_text

    docs = table(spark, sf_dir, "documents")
    found = scan_secrets(docs, markov_ratio(labelled_strings(docs)))
    of = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"),
        F.sha2(spans_text(F.filter("found", lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
        spans_text(F.col("found")).alias("spans"), of(3).alias("n_random"),
    )


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import exact_top_k

    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256.0)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit_toxicity, score_toxicity

    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), fold=0, folds=5)
    scored = score_toxicity(docs, model, threshold=0.5)
    return scored.select("doc_id", (crc_fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import hex_digits, near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"), words=3, most=3)
    return found.select("doc_id", hex_digits().alias("fingerprint"), "component_id")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit_quality, quality_rules

    docs = table(spark, sf_dir, "documents")
    return quality_rules(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import fit_languages, label_languages

    docs = table(spark, sf_dir, "documents")
    labelled = label_languages(docs, fit_languages(docs, fold=2, folds=4), spans=False)
    return labelled.select("doc_id", (crc_fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    docs = table(spark, sf_dir, "documents")
    counts = free_name(docs, "counts")
    kept = dedup_lines(docs, percent=80, counts=counts)
    return kept.select("doc_id", F.col(f"{counts}.n_lines").alias("n_lines"), F.col(f"{counts}.n_removed").alias("n_removed"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), capacity=2048, end_id=0)


def op10_unigram_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .unigram import encoding_digest

    return encoding_digest(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op11_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_groups import similar_documents

    return similar_documents(table(spark, sf_dir, "documents"), percent=90, width=3)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import collocations

    return collocations(table(spark, sf_dir, "documents"), max_n=5, least=100, top=2000)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hard_negatives import hard_negatives

    changed = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").withColumn("label", changed)
    return hard_negatives(rows, F.col("vec_id") % 100 == 0, positives=5, negatives=5, low_percent=80, scale=256.0)


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_secret_scans": op2_secret_scans,
    "op3_exact_top_k": op3_exact_top_k,
    "op4_toxicity": op4_toxicity,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_quality_rules": op6_quality_rules,
    "op7_language_id": op7_language_id,
    "op8_line_dedup": op8_line_dedup,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_unigram_pieces": op10_unigram_pieces,
    "op11_ngram_jaccard_join": op11_ngram_jaccard_join,
    "op12_collocations": op12_collocations,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE_SQL: dict[str, str] = {
    "op3_exact_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
            FROM embeddings
            WHERE embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id
            WHERE q.vec_id % 50 = 0
        ), r AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
            FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op11_ngram_jaccard_join": """
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
        ), words AS (
            SELECT doc_id, unnest(w) AS w, unnest(range(len(w))) AS i, len(w) AS m FROM d
        ), runs AS (
            SELECT doc_id, m, w AS a, lead(w) OVER s AS b, lead(w, 2) OVER s AS c, i FROM words WINDOW s AS (PARTITION BY doc_id ORDER BY i)
        ), g AS MATERIALIZED (
            SELECT DISTINCT doc_id, concat_ws(' ', a, b, c) AS t FROM runs WHERE c IS NOT NULL OR (m < 3 AND i = 0)
        ), n AS MATERIALIZED (
            SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
        ), pairs AS MATERIALIZED (
            SELECT x.doc_id AS a, y.doc_id AS b FROM g x JOIN g y ON x.t = y.t AND x.doc_id <> y.doc_id JOIN n p ON p.doc_id = x.doc_id JOIN n q ON q.doc_id = y.doc_id
            GROUP BY x.doc_id, y.doc_id, p.n, q.n HAVING 100 * count(*) >= 90 * (p.n + q.n - count(*))
        ), reach AS (
            SELECT doc_id AS a, doc_id AS b FROM documents
            UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON p.a = r.b
        )
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id
        JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = d.doc_id
    """,
    "op12_collocations": """
        WITH d AS (
            SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
        ), pieces AS (
            SELECT lang, row_number() OVER () AS p, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w
            FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d)
        ), words AS (
            SELECT lang, p, unnest(w) AS w, unnest(range(len(w))) AS i FROM pieces
        ), runs AS (
            SELECT lang, w AS a, lead(w) OVER s AS b, lead(w, 2) OVER s AS c, lead(w, 3) OVER s AS d, lead(w, 4) OVER s AS e
            FROM words WINDOW s AS (PARTITION BY p ORDER BY i)
        ), f AS (
            SELECT lang, 1 AS k, a AS phrase, count(*) AS n FROM runs GROUP BY ALL
            UNION ALL SELECT lang, 2, a || ' ' || b, count(*) FROM runs WHERE b IS NOT NULL GROUP BY ALL
            UNION ALL SELECT lang, 3, concat_ws(' ', a, b, c), count(*) FROM runs WHERE c IS NOT NULL GROUP BY ALL
            UNION ALL SELECT lang, 4, concat_ws(' ', a, b, c, d), count(*) FROM runs WHERE d IS NOT NULL GROUP BY ALL
            UNION ALL SELECT lang, 5, concat_ws(' ', a, b, c, d, e), count(*) FROM runs WHERE e IS NOT NULL GROUP BY ALL
        ), total AS (
            SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang
        ), g AS MATERIALIZED (
            SELECT * FROM f WHERE n >= 100
        ), c AS (
            SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS w FROM g WHERE k >= 2
        ), cut AS (
            SELECT lang, phrase, a, j, array_to_string(w[1:j], ' ') AS p, array_to_string(w[j + 1:], ' ') AS q FROM c, range(1, 5) s(j) WHERE j < k
        ), scored AS (
            SELECT cut.lang, cut.phrase, cut.a, cut.j, x.n AS l, y.n AS r, t.n,
                   CAST((CAST(1000 AS HUGEINT) * cut.a * t.n) // (CAST(x.n AS HUGEINT) * y.n) AS BIGINT) AS score
            FROM cut JOIN g x ON x.lang = cut.lang AND x.phrase = cut.p JOIN g y ON y.lang = cut.lang AND y.phrase = cut.q JOIN total t ON t.lang = cut.lang
        ), best AS (
            SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
        ), inner_phrases AS (
            SELECT c.lang, array_to_string(c.w[x.i:x.i + y.m - 1], ' ') AS phrase, max(c.a) AS most
            FROM c, range(1, 5) x(i), range(2, 5) y(m) WHERE x.i + y.m - 1 <= c.k AND y.m < c.k GROUP BY ALL
        ), kept AS (
            SELECT b.* FROM best b LEFT JOIN inner_phrases i ON i.lang = b.lang AND i.phrase = b.phrase WHERE i.most IS NULL OR 100 * i.most < 100 * b.a
        )
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
        FROM kept QUALIFY rank <= 2000
    """,
    "op13_hard_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
            FROM embeddings
            WHERE embedding IS NOT NULL AND label IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score
            FROM v a JOIN v c ON a.vec_id <> c.vec_id
            WHERE a.vec_id % 100 = 0
        ), p AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
        ), n AS (
            SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
                   CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
            FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same
              AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
        )
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
    """,
}
