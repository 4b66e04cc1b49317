"""The queries op1_... to op13_... on the driver's tables, and the SQL that DuckDB runs for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import _shared as S
from pulsegrid.llm import clustering, exact_dedup, language_id, line_dedup, ngram_join, packing, records, segmentations, shard, tokens, vector_dedup, warc, whitening


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_bytes(text: str = "text") -> F.Column:
    return F.coalesce(F.col(text), F.lit(""))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    model = language_id.fit(docs.where(~held_out))
    return language_id.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op2_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = S.scratch(spark, "records")
    records.write_records(documents(spark, sf_dir), path, end_id=2)
    index = records.write_index(spark, path)
    return index.select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32", "part", "offset")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = S.written(packing.pieces(documents(spark, sf_dir)), "pieces")
    return packing.pack(cut).withColumnRenamed("id", "doc_id")


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = shard.two_pass_shuffle(documents(spark, sf_dir).select("doc_id", "text"), "doc_id", 16)
    path = S.scratch(spark, "shards")
    shard.write_shards(mixed, path)
    out = shard.read_shards(spark, path, mixed)
    size = F.octet_length(text_bytes()) + 1
    return out.select("doc_id", size.cast("long").alias("size"), F.crc32(text_bytes().cast("binary")).alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op7_sampled_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sampled segmentations of each whole text; text_crc32 is of what their ids decode to."""
    out = segmentations.sample_segmentations(documents(spark, sf_dir), k=3)
    n = (F.octet_length("ids") / 4).cast("long")
    return out.select("doc_id", "sample", n.alias("n_pieces"), F.crc32("ids").alias("ids_crc32"), "text_crc32", "log_prob", "perturbed", "inclusion")


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_classes(documents(spark, sf_dir), words=3, percent=90).select("doc_id", "n_shingles", "component_id")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = line_dedup.apply_bitmaps(docs, S.written(line_dedup.line_dedup(docs), "bitmaps"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(documents(spark, sf_dir))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = whitening.by_component(whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))
    return white.select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = S.scratch(spark, "warc")
    warc.write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    index = warc.write_index(spark, path)
    return warc.read_records(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_language_id, op2_binary_records, op3_exact_dedup, op4_best_fit_packing, op5_embedding_near_dedup, op6_sharding, op7_sampled_segmentations, op8_ngram_jaccard_join, op9_line_dedup, op10_token_counts, op11_embedding_whitening, op12_warc, op13_centroid_clustering)}


_SPACE = r"[\x20\x09-\x0D]"

OP3_SQL = rf"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{_SPACE}+', ' ', 'g')) AS h FROM documents),
g AS (SELECT h, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY h)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM n JOIN g USING (h)
"""

OP9_SQL = rf"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
o AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
d AS (SELECT k.doc_id, k.pos, k.line, o.key IS NOT NULL AND k.doc_id <> o.last AS gone FROM k LEFT JOIN o ON k.key = o.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM d GROUP BY doc_id
"""


#: Each base 32 digit is five of the 40 bits that ten hexadecimal digits hold.
OP12_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
d AS (SELECT page_id, t, sha1(t) AS h, max(page_id) OVER (PARTITION BY t) AS top FROM p)
SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda g: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 +
         ((CAST('0x' || substr(h, CAST(1 + 10 * (g // 8) AS BIGINT), 10) AS BIGINT) >> CAST(35 - 5 * (g % 8) AS BIGINT)) & 31) AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < top THEN top END AS refers_to
FROM d
"""


def _op13_sql(k: int = 40, rounds: int = 5, dims: int = 64) -> str:
    """Rounds as a chain of tables. Inner products of integers are exact in doubles here; a number's distance and place make one integer."""

    def assigned(i: int) -> str:
        d = "CAST(list_inner_product(v.x, v.x) + list_inner_product(c.x, c.x) - 2 * list_inner_product(v.x, c.x) AS BIGINT)"
        return f"a{i} AS MATERIALIZED (SELECT v.row, min({d} * {k} + c.j) AS best FROM v, c{i} c GROUP BY v.row)"

    def moved(i: int) -> str:
        sums = f"SELECT best % {k} AS j, p, CAST(sum(CAST(v.x[p] AS BIGINT)) AS BIGINT) AS s, count(*) AS n FROM a{i} JOIN v USING (row), (SELECT unnest(range(1, {dims + 1})) AS p) GROUP BY ALL"
        new = f"SELECT j, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY p) AS x FROM ({sums}) GROUP BY j"
        return f"c{i + 1} AS MATERIALIZED (SELECT c.j, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN ({new}) m USING (j))"

    good = f"len(embedding) = {dims} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {dims}"
    steps = [f"v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda e: floor(256 * CAST(e AS DOUBLE))) AS x FROM embeddings WHERE {good})"]
    steps.append(f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), x) - 1 AS j, x FROM v QUALIFY j < {k})")
    for i in range(rounds):
        steps += [assigned(i), moved(i)]
    steps.append(assigned(rounds))
    digest = "sha256(array_to_string(list_transform(x, lambda e: CAST(CAST(e AS BIGINT) AS VARCHAR)), ','))"
    return f"""WITH {", ".join(steps)},
r AS (SELECT vec_id, CAST(best % {k} AS INT) AS cluster, CAST(best // {k} AS BIGINT) AS distance FROM a{rounds} JOIN v USING (row))
SELECT r.*, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
       {digest} AS centroid_sha256 FROM r JOIN c{rounds} c ON c.j = r.cluster"""


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": OP3_SQL, "op9_line_dedup": OP9_SQL, "op12_warc": OP12_SQL, "op13_centroid_clustering": _op13_sql()}
