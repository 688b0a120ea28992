"""The queries of this subpackage, by the names they are registered under, and their SQL.

A query reads whole tables of ``sf_dir`` through Spark and runs its operator with production parameters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer's file lies on the driver."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortframe.llm.decontaminate import containment

    return containment(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortframe.llm.simhash import simhash_dedup

    return simhash_dedup(_table(spark, sf_dir, "documents"))


def op3_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortframe.llm.tokenfile import token_digest

    return token_digest(_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op4_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortframe.llm.passages import passages_digest

    return passages_digest(_table(spark, sf_dir, "documents"))


def op5_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortframe.llm.suffixes import bytes_digest

    return bytes_digest(_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortframe.llm.toxicity import toxicity_scores

    return toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortframe.llm.quality import quality_scores

    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortframe.llm.epsilon import embedding_links

    return embedding_links(_table(spark, sf_dir, "embeddings"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortframe.llm.bpe import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortframe.llm.mixing import mix_counts

    return mix_counts(_table(spark, sf_dir, "documents"))


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortframe.llm.fim import fim_digest

    return fim_digest(_table(spark, sf_dir, "documents"))


def op12_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortframe.llm.packing import packing_digest

    return packing_digest(_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortframe.llm.dualtree import cluster_vectors

    return cluster_vectors(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontaminate, op2_simhash, op3_token_file, op4_passages, op5_bytes, op6_toxicity, op7_quality, op8_embeddings, op9_token_counts, op10_mix, op11_fim, op12_pack, op13_clusters)}


_WORDS = r"list_filter(string_split_regex(lower({0}), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_SHINGLES = "list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)"

OP1_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM (SELECT DISTINCT doc_id, text FROM documents)),
b AS (SELECT item_id, {_WORDS.format("text")} AS w FROM (SELECT DISTINCT item_id, text FROM benchmark)),
ds AS (SELECT doc_id, unnest({_SHINGLES}) AS s FROM d),
bl AS (SELECT item_id, {_SHINGLES} AS l FROM b),
bs AS (SELECT item_id, len(l) AS n, unnest(l) AS s FROM bl)
SELECT doc_id, item_id, n AS n_shingles, count(*) AS n_shared, count(*) / n::DOUBLE AS containment
FROM ds JOIN bs USING (s) GROUP BY doc_id, item_id, n HAVING count(*) >= ceil(0.8 * n - 1e-9)
"""


#: Every list slice below ends before its start where it is to be empty.
OP11_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
k AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS w, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT doc_id, t, w, len(w)::BIGINT AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS z,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (SELECT doc_id, t, n, form, coalesce(array_to_string(w[1:a], ''), '') AS pre, coalesce(array_to_string(w[a + 1:z], ''), '') AS mid, coalesce(array_to_string(w[z + 1:n], ''), '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""


def _op13_sql(k: int = 40, rounds: int = 5, width: int = 64) -> str:
    """Plain Lloyd rounds, one after another."""
    square = f"list_sum(list_transform(range(1, {width + 1}), lambda i: (v[i] - c[i]) * (v[i] - c[i])))::BIGINT"
    steps = [f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = {width} AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS k, v AS c FROM v ORDER BY k LIMIT {k})"""]
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, vec_id, v, arg_min(k, d * {k} + k) AS k, min(d) AS d FROM (SELECT r, vec_id, v, k, {square} AS d FROM v CROSS JOIN c{i}) GROUP BY r, vec_id, v)")
        if i < rounds:
            steps.append(f"s{i} AS (SELECT k, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM a{i} CROSS JOIN range(1, {width + 1}) t(i) GROUP BY k, i)")
            steps.append(f"m{i} AS (SELECT k, list(((s - ((s % n + n) % n)) // n)::BIGINT ORDER BY i) AS c FROM s{i} GROUP BY k)")
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT k, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (k))")
    return f"WITH {', '.join(steps)} SELECT vec_id, k::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (k)"


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": OP1_SQL, "op11_fim": OP11_SQL, "op13_clusters": _op13_sql()}
