"""One query per operator, over whole tables, and SQL counterparts where SQL can state the result."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlane.llm import bpe, toxicity
from siftlane.llm.centroids import centroid_clusters
from siftlane.llm.divergence import source_divergence
from siftlane.llm.fingerprints import edited_fingerprints
from siftlane.llm.langid import held_out, identify, train
from siftlane.llm.lm import stupid_backoff
from siftlane.llm.mixing import mix
from siftlane.llm.simhash_covering import near_duplicates
from siftlane.llm.substrings import substring_dedup
from siftlane.llm.suffixes import byte_dedup
from siftlane.llm.tokens import token_counts
from siftlane.llm.topk import top_k


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring_dedup(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = byte_dedup(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stupid_backoff(_table(spark, sf_dir, "documents"), order=3)


def op10_bigram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stupid_backoff(_table(spark, sf_dir, "documents"), order=2)


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vec"))
    return top_k(rows, rows.where("id % 50 = 0"), k=5, scale=256)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mix(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(_table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    return with_digests(bpe.round_trip(docs, path)).drop("ids", "decoded")


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), radius=4)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return identify(docs, train(docs.where(~held_out())))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(_table(spark, sf_dir, "documents"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.toxicity(docs, toxicity.train(docs, _table(spark, sf_dir, "labels").where(~toxicity.held_out())))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return centroid_clusters(rows, k=8, rounds=10).withColumnRenamed("id", "vec_id")


def with_digests(rows: DataFrame) -> DataFrame:
    """Digests of token ids (decimal, joined by commas) and of decoded texts."""
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    return rows.withColumns({"n_tokens": F.size("ids").cast("long"), "ids_sha256": ids, "decoded_sha256": F.sha2("decoded", 256)})


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_top_k, op3_token_counts, op4_mix, op5_fingerprints, op6_suffix_dedup, op7_bpe,
                                   op8_near_duplicates, op9_language, op10_lm_scores, op11_source_divergence, op12_toxicity, op13_centroid_clusters)}


def _centroid_sql(k: int = 8, rounds: int = 10, dimensions: int = 64) -> str:
    """The rounds of op13 one after the other: a<n> assigns (m is [distance, number]), c<n> holds centroids."""
    squares = "list_sum(list_transform(list_zip(v.q, c{n}.q), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    assign = "a{n} AS MATERIALIZED (SELECT r, min([" + squares + ", c]) AS m FROM v, c{n} GROUP BY r)"
    mean = ("c{m} AS MATERIALIZED (SELECT c{n}.c, coalesce(new.q, c{n}.q) AS q FROM c{n} LEFT JOIN (SELECT c, list(x ORDER BY i) AS q FROM ("
            "SELECT m[2] AS c, i, CAST((sum(v.q[i]) - ((sum(v.q[i]) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS x "
            "FROM a{n} JOIN v USING (r), range(1, {dimensions} + 1) AS t(i) GROUP BY m[2], i) GROUP BY c) AS new ON new.c = c{n}.c)")
    steps = [assign.format(n=0)]
    for n in range(rounds):
        steps += [mean.format(n=n, m=n + 1, dimensions=dimensions), assign.format(n=n + 1)]
    return f"""
        WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q FROM embeddings
                   WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id) NULLS LAST, q) - 1 AS c, q FROM v QUALIFY c < {k}),
        {", ".join(steps)},
        z AS (SELECT vec_id, m[2] AS c, m[1] AS d, sum(m[1]) OVER (PARTITION BY m[2]) AS own, sum(m[1]) OVER () AS every FROM a{rounds} JOIN v USING (r))
        SELECT vec_id, CAST(z.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(own AS BIGINT) AS cluster_inertia, CAST(every AS BIGINT) AS inertia,
               sha256(array_to_string(f.q, ',')) AS centroid_sha256 FROM z JOIN c{rounds} AS f ON f.c = z.c"""


ORACLES = {
    "op1_substring_dedup": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
        p AS (SELECT doc_id, words, unnest(range(len(words) - 19)) AS i FROM w WHERE len(words) >= 20),
        v AS (SELECT doc_id, i, row_number() OVER (PARTITION BY list_slice(words, i + 1, i + 20) ORDER BY doc_id, i) AS n FROM p),
        gone AS (SELECT DISTINCT doc_id, i + unnest(range(1, 21)) AS pos FROM v WHERE n > 1),
        cut AS (SELECT doc_id, list(pos) AS ats FROM gone GROUP BY doc_id)
        SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(ats), 0) AS BIGINT) AS n_removed,
               sha256(array_to_string(CASE WHEN ats IS NULL THEN words ELSE
                   [words[i] FOR i IN range(1, len(words) + 1) IF NOT list_contains(ats, i)] END, ' ')) AS kept_sha256
        FROM w LEFT JOIN cut ON cut.doc_id = w.doc_id""",
    "op10_lm_scores": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
        p AS (SELECT r, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM d),
        g AS (SELECT *, lag(w) OVER x AS v, lag(w, 2) OVER x AS u FROM p WINDOW x AS (PARTITION BY r ORDER BY i)),
        one AS (SELECT *, count(*) OVER (PARTITION BY w) - count(*) OVER (PARTITION BY w, r) AS c1,
                CASE WHEN v IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY v, w) - count(*) OVER (PARTITION BY v, w, r) END AS c2,
                CASE WHEN u IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY u, v, w) - count(*) OVER (PARTITION BY u, v, w, r) END AS c3,
                count(*) OVER () - count(*) OVER (PARTITION BY r) AS rest FROM g),
        two AS (SELECT *, lag(c1) OVER x AS before1, lag(c2) OVER x AS before2 FROM one WINDOW x AS (PARTITION BY r ORDER BY i)),
        s AS (SELECT r, i, c2, c3, CASE WHEN c3 > 0 THEN c3 / before2 WHEN c2 > 0 THEN c2 / before1 * (CASE WHEN i > 2 THEN 0.4 ELSE 1 END)::DOUBLE
                ELSE (c1 + 1) / (rest + 1) * (CASE WHEN i > 1 THEN 0.4 ELSE 1 END)::DOUBLE * (CASE WHEN i > 2 THEN 0.4 ELSE 1 END)::DOUBLE END AS score FROM two),
        t AS (SELECT r, count(*) AS n, count(*) FILTER (WHERE i = 2 AND c2 = 0 OR i > 2 AND c3 = 0) AS b,
              sum(CAST(round(ln(score) * 1000000) AS BIGINT)) AS micro FROM s GROUP BY r)
        SELECT doc_id, coalesce(n, 0) AS n_words, coalesce(b, 0) AS n_backoff, coalesce(micro, 0)::DOUBLE / 1000000 AS log_score,
               (micro::DOUBLE / 1000000) / n AS mean_log_score FROM d LEFT JOIN t USING (r)""",
    "op2_top_k": """
        WITH v AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS score
              FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
        SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM r WHERE n <= 5""",
    "op11_source_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                          regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
        t AS (SELECT r, lang, source, unnest(terms) AS term FROM d),
        kept AS (SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
        l AS (SELECT d.lang, coalesce(any_value(v), 0) AS v, coalesce(any_value(n), 0) AS n FROM d
              LEFT JOIN (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang) AS k ON k.lang = d.lang GROUP BY d.lang),
        c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
        g AS (SELECT d.lang, d.source, coalesce(any_value(s.n), 0) AS n FROM d
              LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source) AS s ON s.lang = d.lang AND s.source = d.source GROUP BY d.lang, d.source),
        every AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (g.n + 2 * l.v) AS p,
                         1 + (1000000000::HUGEINT * (kept.total + 2)) // (l.n + 2 * l.v) AS q
                  FROM g JOIN l ON l.lang = g.lang JOIN kept ON kept.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
        sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
                 FROM every AS a JOIN every AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
        pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source
                  LEFT JOIN sums AS s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
        terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM every WHERE n > 0 AND p > q),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
                   FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10""",
    "op13_centroid_clusters": _centroid_sql(),
}

#: A second query of one operator: the smaller model, which backs off from bigrams in one step.
SECOND_QUERIES = {f.__name__: f for f in (op10_bigram_scores,)}

SECOND_ORACLES = {
    "op10_bigram_scores": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
        p AS (SELECT r, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM d),
        g AS (SELECT *, lag(w) OVER (PARTITION BY r ORDER BY i) AS v FROM p),
        one AS (SELECT *, count(*) OVER (PARTITION BY w) - count(*) OVER (PARTITION BY w, r) AS c1,
                CASE WHEN v IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY v, w) - count(*) OVER (PARTITION BY v, w, r) END AS c2,
                count(*) OVER () - count(*) OVER (PARTITION BY r) AS rest FROM g),
        two AS (SELECT *, lag(c1) OVER (PARTITION BY r ORDER BY i) AS c0 FROM one),
        s AS (SELECT r, i, c2, CASE WHEN c2 > 0 THEN c2 / c0 WHEN i > 1 THEN 0.4::DOUBLE * ((c1 + 1) / (rest + 1)) ELSE (c1 + 1) / (rest + 1) END AS score FROM two),
        t AS (SELECT r, count(*) AS n, count(*) FILTER (WHERE i > 1 AND c2 = 0) AS b, sum(CAST(round(ln(score) * 1000000) AS BIGINT)) AS micro FROM s GROUP BY r)
        SELECT doc_id, coalesce(n, 0) AS n_words, coalesce(b, 0) AS n_backoff, coalesce(micro, 0)::DOUBLE / 1000000 AS log_score,
               (micro::DOUBLE / 1000000) / n AS mean_log_score FROM d LEFT JOIN t USING (r)""",
}
