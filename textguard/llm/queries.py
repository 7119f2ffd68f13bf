"""The dealt operators as registered queries, at production parameters over whole tables."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from textguard.llm import (backoff_lm, bbit_minhash, bpe, centroid_matrix, context_coder, count_bitmaps, entropy_secrets, license_rules, packing, permutation_index,
                           pii_tagger, scaled_sketch, weak_quality)
from textguard.llm.common import small_batches
from textguard.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return small_batches(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))


@query("op9_bpe")
def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op4_best_fit_packing")
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0, capacity=2048)


@query("op7_license_rules")
def op7_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_rules.digest(table(spark, sf_dir, "documents"))


@query("op5_scaled_sketch")
def op5_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaled_sketch.fingerprint_edits(table(spark, sf_dir, "documents"))


NEAR_TWIN = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS s
  FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS start, doc_id AS seen FROM documents UNION SELECT start, y FROM reach JOIN links ON x = seen)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(seen) AS component_id, d.doc_id = min(seen) AS kept
FROM documents d JOIN reach ON start = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id GROUP BY d.doc_id, n
"""


@query("op1_bbit_minhash", NEAR_TWIN)
def op1_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bbit_minhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, threshold_percent=85).drop("class_id")


@query("op2_permutation_index")
def op2_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.search(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0", k=5)


@query("op10_weak_quality")
def op10_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_quality.classify(table(spark, sf_dir, "documents"))


@query("op6_backoff_lm")
def op6_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff_lm.score_documents(table(spark, sf_dir, "documents"))


@query("op8_pii_tagger")
def op8_pii_tagger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_tagger.digest(table(spark, sf_dir, "documents"))


@query("op3_context_coder")
def op3_context_coder(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = context_coder.shared_folder(spark)
    context_coder.write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2, folder)
    return context_coder.digests(spark, folder)


def cluster_twin(k: int = 40, rounds: int = 5) -> str:
    """Lloyd's rounds written out one after the other."""
    far = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::HUGEINT"
    out = [r"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
           f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x FROM (SELECT sha256('2:' || vec_id) AS h, x FROM v WHERE vec_id IS NOT NULL ORDER BY h, x LIMIT {k}))"""]
    for r in range(rounds + 1):
        out.append(f"a{r} AS MATERIALIZED (SELECT id, any_value(v.vec_id) AS vec_id, any_value(v.x) AS x, min({far} * {k} + c.c) AS best FROM v, c{r} c GROUP BY id)")
        out.append(f"b{r} AS MATERIALIZED (SELECT vec_id, x, (best % {k})::INTEGER AS cluster, (best // {k})::BIGINT AS distance FROM a{r})")
        out.append(f"""c{r + 1} AS MATERIALIZED (SELECT cluster AS c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS x FROM (
    SELECT cluster, j, sum(x[j])::HUGEINT AS s, count(*) AS n FROM b{r}, (SELECT unnest(range(1, 65)) AS j) GROUP BY cluster, j) GROUP BY cluster
    UNION ALL SELECT c, x FROM c{r} WHERE c NOT IN (SELECT cluster FROM b{r}))""")
    out.pop()
    return ",\n".join(out) + f"""
SELECT vec_id, cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia,
    sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM b{rounds} JOIN c{rounds} c ON c.c = cluster"""


@query("op11_centroid_matrix", cluster_twin())
def op11_centroid_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_matrix.cluster(table(spark, sf_dir, "embeddings"), k=40, rounds=5)


DIVERGENCE_TWIN = r"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
occ AS (SELECT d, lang, source, unnest(w) AS t FROM docs),
kept AS (SELECT lang, t FROM occ GROUP BY lang, t HAVING count(DISTINCT d) >= 30),
grp AS (SELECT DISTINCT lang, source FROM docs),
cnt AS (SELECT lang, source, t, count(*) AS n FROM occ JOIN kept USING (lang, t) GROUP BY ALL),
size AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
total AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM grp LEFT JOIN cnt USING (lang, source) GROUP BY lang, source),
share AS (SELECT g.lang, g.source, k.t, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.total + 5 * size.v) AS p
    FROM total g JOIN kept k ON k.lang = g.lang JOIN size ON size.lang = g.lang LEFT JOIN cnt c ON c.lang = g.lang AND c.source = g.source AND c.t = k.t),
lang_n AS (SELECT lang, t, sum(n) AS n FROM cnt GROUP BY lang, t),
lang_share AS (SELECT l.lang, l.t, 1 + (1000000000::HUGEINT * (l.n + 5)) // (sum(l.n) OVER (PARTITION BY l.lang) + 5 * v) AS q FROM lang_n l JOIN size ON size.lang = l.lang),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce((SELECT sum(abs(x.p - y.p)) FROM share x JOIN share y ON x.lang = y.lang AND x.t = y.t
    WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0)::BIGINT AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source),
terms AS (SELECT s.lang, s.source, s.t AS item, (p - q)::BIGINT AS value FROM share s JOIN lang_share l ON l.lang = s.lang AND l.t = s.t WHERE s.n > 0 AND p > q),
ranked AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM ranked)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM placed WHERE part = 'pair' OR rank <= 50
"""


@query("op12_count_bitmaps", DIVERGENCE_TWIN)
def op12_count_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_bitmaps.audit(table(spark, sf_dir, "documents"))


@query("op13_entropy_secrets")
def op13_entropy_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entropy_secrets.digest(table(spark, sf_dir, "documents"))
