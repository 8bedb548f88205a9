"""The registered queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.llm import alignment, dac, group_packing, licenses, minhash, mixing, multi_index, nn_descent, packing, periodic, sharding, substring, toxicity
from panelkit.llm.shared import shared_dir


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = toxicity.train(docs, labels.where(~held_out))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.near_duplicate_vectors(_table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), words=2).withColumnRenamed("id", "doc_id")


def _crc32(ids: np.ndarray) -> int:
    from zlib import crc32

    return crc32(ids.astype("<u4").tobytes())


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(_table(spark, sf_dir, "documents"), tokenizer=tokenizer_path(), fold=_crc32)
    return packed.select("doc_id", "piece", "start", "length", F.col("folded").alias("ids_crc32"), "sequence_id", "offset")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.remove_repeats(_table(spark, sf_dir, "documents"))
    return kept.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    placed = sharding.place(_table(spark, sf_dir, "documents").select("doc_id", "text", crc.alias("text_crc32")), carry=["doc_id", "text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return nn_descent.nearest(vectors, vectors.where("vec_id % 50 = 0")).withColumnRenamed("id", "vec_id")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    dac.write(_table(spark, sf_dir, "documents"), path, tokenizer=tokenizer_path(), end_id=2)

    def digest(doc: int | None, start: int, ids: np.ndarray) -> tuple:
        return doc, start, len(ids), _crc32(ids)

    return dac.decoded(dac.read(spark.read.parquet(path)), digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op11_group_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = group_packing.pack(_table(spark, sf_dir, "documents"), tokenizer=tokenizer_path("word_bpe_49k.json"), fold=_crc32)
    return packed.select("doc_id", "start", "length", F.col("folded").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def _sha256(said: str) -> str:
    from hashlib import sha256

    return said and sha256(said.encode()).hexdigest()


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = alignment.align(_table(spark, sf_dir, "documents"), byte_path=tokenizer_path(), piece_path=tokenizer_path("piece_bpe_32k.model"), fold=_sha256)
    return aligned.withColumnRenamed("groups", "groups_sha256")


def _repeating(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in every tenth document by its hash, the words from one of them on repeat a stretch."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    blanks = r"[\x20\x09-\x0D]+"
    words = F.when(h % 10 == 0, F.filter(F.split("text", blanks), lambda w: w != ""))
    rows = docs.select("doc_id", "text", F.expr("crc32(cast(cast(doc_id as string) as binary)) div 10").alias("g"), words.alias("w"))
    rows = rows.select("doc_id", "text", "g", "w", F.nullif(F.size("w"), F.lit(0)).cast("long").alias("n"))
    rows = rows.select("doc_id", "text", "g", "w", "n", (F.col("g") % F.col("n")).alias("a"))
    rows = rows.select("doc_id", "text", "w", "a", F.expr("1 + (n - a) div (3 + g % 8)").alias("p"))
    said = F.transform("w", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return rows.select("doc_id", F.coalesce(F.when(F.col("p").isNotNull(), F.array_join(said, " ")), "text").alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.collapse(_repeating(_table(spark, sf_dir, "documents").select("doc_id", "text")))
    # Runs come by start and period, so of equal ones the first stays.
    best = F.aggregate("runs", F.lit(None).cast("struct<start:long,length:long,period:long>"), lambda m, r: F.when(m.isNull() | (r["length"] * m["period"] > m["length"] * r["period"]), r).otherwise(m))
    said = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.when(F.size("runs") > 0, F.concat(said, F.lit("\n"))).otherwise("").alias("said"), "text")
    return found.select("doc_id", "n_runs", "b.start", "b.length", "b.period", F.expr("1000 * b.length div b.period").alias("exponent_milli"), F.sha2("said", 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_toxicity, op2_embedding_dedup, op3_minhash_dedup, op4_best_fit_packing, op5_substring_dedup, op6_mixing, op7_sharding, op8_nearest_neighbours, op9_token_files, op10_licenses, op11_group_packing, op12_alignment, op13_periodic_runs, pipeline]
    return {f.__name__: f for f in found}


_OP3_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, [x for x in regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') if x <> ''] AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_sort(list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))])) END AS s
  FROM words
), classes AS (
  SELECT s, min(doc_id) AS rep, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s
), flat AS (
  SELECT rep, n, unnest(s) AS x FROM classes
), common AS (
  SELECT a.rep AS a, b.rep AS b, count(*) AS k, any_value(a.n) AS an, any_value(b.n) AS bn
  FROM flat a JOIN flat b ON a.x = b.x AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY 1, 2
), links AS (
  SELECT a, b FROM common WHERE 100 * k >= 80 * (an + bn - k)
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(node, root) AS (
  SELECT rep, rep FROM classes
  UNION
  SELECT e.b, r.root FROM reach r JOIN edges e ON r.node = e.a
), component AS (
  SELECT node, min(root) AS c FROM reach GROUP BY node
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(p.c, s.doc_id) AS component_id, s.doc_id = coalesce(p.c, s.doc_id) AS kept
FROM sets s LEFT JOIN classes k ON s.s = k.s AND len(s.s) > 0 LEFT JOIN component p ON k.rep = p.node
"""

_OP5_SQL = r"""
WITH words AS (
  SELECT doc_id, [x for x in regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') if x <> ''] AS w FROM documents
), windows AS (
  SELECT doc_id, p, array_to_string(w[p:p + 19], ' ') AS v
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM words WHERE len(w) >= 20)
), later AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY v ORDER BY doc_id, p) AS r FROM windows) WHERE r > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS p FROM later
), kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n
  FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM words) ANTI JOIN gone USING (doc_id, p)
  GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""

_OP10_SQL = r"""
WITH templates(license, text) AS (VALUES %s), texts AS (
  SELECT license AS k, text FROM templates
), shingled AS (
  SELECT k, w, unnest(range(1, len(w) - 3)) AS p
  FROM (SELECT k, [x for x in regexp_split_to_array(translate(lower(text), '.,;:!?()"''', ''), '[\x20\x09-\x0D]+') if x <> ''] AS w FROM texts)
  WHERE len(w) >= 5
), t AS (
  SELECT DISTINCT k, array_to_string(w[p:p + 4], ' ') AS s FROM shingled
), n AS (
  SELECT k, count(*) AS n FROM t GROUP BY k
), d AS (
  SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS s
  FROM (
    SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS p
    FROM (SELECT doc_id, [x for x in regexp_split_to_array(translate(lower(coalesce(text, '')), '.,;:!?()"''', ''), '[\x20\x09-\x0D]+') if x <> ''] AS w FROM documents)
    WHERE len(w) >= 5)
)
SELECT doc_id, k AS license, CAST(count(*) AS INTEGER) AS n_shared, count(*) / any_value(n) AS containment
FROM d JOIN t USING (s) JOIN n USING (k)
GROUP BY doc_id, k HAVING count(*) / any_value(n) >= 0.8
""" % ", ".join("('%s', '%s')" % (k, v.replace("'", "''")) for k, v in licenses.TEMPLATES.items())

_OP2_SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0 AND len([x for x in embedding if x <> 0]) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.95
), reach(node, root) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT l.b, r.root FROM reach r JOIN links l ON r.node = l.a
), component AS (
  SELECT node, min(root) AS c FROM reach GROUP BY node
), n AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT vec_id, coalesce(n, 0) AS n_links, c AS component_id, vec_id = c AS kept
FROM embeddings JOIN component ON vec_id = node LEFT JOIN n ON vec_id = a
"""

_OP8_SQL = """
WITH good AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0 AND len([x for x in embedding if x <> 0]) > 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.v, c.v) AS score
  FROM good q JOIN good c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored
)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 5
"""


_OP13_SQL = r"""
WITH hashed AS (
  SELECT doc_id, [x for x in regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') if x <> ''] AS w,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten([[ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] for c in string_split(doc_id::VARCHAR, '')])),
      lambda c, o: CASE WHEN o >= 0 THEN xor(c, o) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS h
  FROM documents
), counted AS (
  SELECT doc_id, w, len(w) AS n, h, h // 10 AS g FROM hashed
), begun AS (
  SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM counted
), words AS (
  SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE [CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] END for i in range(n)] END AS w FROM begun
), blocks AS (
  SELECT doc_id, n, i, array_to_string(w[i + 1:i + 8], ' ') AS b FROM (SELECT *, unnest(range(0, n - 7)) AS i FROM words WHERE n >= 24)
), pairs AS (
  SELECT x.doc_id, x.i, y.i - x.i AS q FROM blocks x JOIN blocks y ON x.doc_id = y.doc_id AND x.b = y.b AND x.i < y.i AND 3 * (y.i - x.i) <= x.n
), stretches AS (
  SELECT doc_id, q, min(i) AS s, count(*) + 7 + q AS l
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM pairs) GROUP BY doc_id, q, k
), long AS (
  SELECT * FROM stretches WHERE l >= greatest(24, 3 * q)
), runs AS (
  SELECT * FROM long x WHERE NOT EXISTS (SELECT 1 FROM long y WHERE y.doc_id = x.doc_id AND y.q < x.q AND y.s <= x.s AND y.s + y.l >= x.s + x.l)
), digests AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS said FROM runs GROUP BY doc_id
), best AS (
  SELECT doc_id, s, l, q FROM runs x
  WHERE NOT EXISTS (SELECT 1 FROM runs y WHERE y.doc_id = x.doc_id AND (y.l * x.q > x.l * y.q OR y.l * x.q = x.l * y.q AND (y.s, y.q) < (x.s, x.q)))
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM runs
), kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM (SELECT doc_id, unnest(w) AS x, unnest(range(n)) AS i FROM words) ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, l AS length, q AS period, 1000 * l // q AS exponent_milli, sha256(coalesce(said, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM words LEFT JOIN digests USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_embedding_dedup": _OP2_SQL, "op3_minhash_dedup": _OP3_SQL, "op5_substring_dedup": _OP5_SQL, "op8_nearest_neighbours": _OP8_SQL, "op10_licenses": _OP10_SQL, "op13_periodic_runs": _OP13_SQL}
