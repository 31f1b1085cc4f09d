"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, jaccard_join, language_id, line_dedup, mixing, packing, quality_cnn, quality_rules, sharding, substring_dedup
from .common import held_out, read_table

SHARDS = 24


def op1_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    placed = sharding.kd_shards(docs, ["source", "lang", "n_chars"], shards=SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mixing.mix(docs, lambda s: mixing.cycled_weights(s, [3, 1, 2]), budget_share=1.5, max_epochs=2, seed=MIX_SEED)
    return mixed.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), mixing.taken().alias("taken"))


MIX_SEED = 17

OP2_SQL = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':{MIX_SEED}') AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source),
w AS (SELECT *, 2.0::DOUBLE * source_size AS cap, (CASE i % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END)::DOUBLE AS weight FROM s),
r AS (
  SELECT *, cap / weight AS ratio, 1.5::DOUBLE * sum(source_size) OVER () AS budget,
         coalesce(sum(cap) OVER before, 0) AS cap_before, sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS weight_left
  FROM w WINDOW before AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min(level, ratio) AS level FROM (SELECT (budget - cap_before) / weight_left AS level, ratio FROM r) WHERE level <= ratio),
t AS (SELECT source, source_size, coalesce(least(cap, level * weight), cap) AS target FROM r LEFT JOIN l ON true),
x AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END::BIGINT AS whole, floor(t.target)::BIGINT AS goal,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS seen
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(size, goal - whole * source_size - seen)))::BIGINT AS taken FROM x
"""


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality_rules.judged(docs, read_table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly")


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_join.near_duplicates(docs)


OP4_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS pos FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, pos, pos + 4), ' ') AS g FROM p),
n AS (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY doc_id),
c AS (SELECT doc_id, md5(string_agg(g, chr(10) ORDER BY g)) AS sig FROM s GROUP BY doc_id),
k AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY sig) AS rep FROM c),
r AS (SELECT s.doc_id, s.g FROM s JOIN k USING (doc_id) WHERE k.rep = s.doc_id),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM r a JOIN r b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM i JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * shared >= 80 * (a.n + b.n - shared)),
u AS (SELECT x, y FROM e UNION SELECT y, x FROM e UNION SELECT rep, rep FROM k),
t(x, y) AS (SELECT x, y FROM u UNION SELECT t.x, u.y FROM t JOIN u ON t.y = u.x),
m AS (SELECT x, min(y) AS component_id FROM t GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.component_id, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id) LEFT JOIN m ON m.x = k.rep
"""


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = language_id.train(docs)
    out = language_id.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")


def op6_line_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP6_SQL = """
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
p AS (SELECT doc_id, lines, unnest(range(1, len(lines) - 1)) AS pos FROM l WHERE len(lines) >= 3),
w AS (
  SELECT doc_id, pos, list_slice(lines, pos, pos + 2) AS win FROM p
  WHERE NOT (trim(lines[pos], ' ') = '' AND trim(lines[pos + 1], ' ') = '' AND trim(lines[pos + 2], ' ') = '')),
f AS (SELECT win, min((doc_id, pos)) AS first FROM w GROUP BY win),
c AS (SELECT DISTINCT w.doc_id, unnest([pos, pos + 1, pos + 2]) AS line FROM w JOIN f USING (win) WHERE (w.doc_id, w.pos) > f.first),
e AS (SELECT doc_id, unnest(lines) AS body, unnest(range(1, len(lines) + 1)) AS line FROM l),
k AS (
  SELECT e.doc_id, count(c.line)::BIGINT AS n_removed, coalesce(string_agg(e.body, chr(10) ORDER BY e.line) FILTER (WHERE c.line IS NULL), '') AS kept
  FROM e LEFT JOIN c ON e.doc_id = c.doc_id AND e.line = c.line GROUP BY e.doc_id)
SELECT l.doc_id, coalesce(len(l.lines), 0)::BIGINT AS n_lines, coalesce(k.n_removed, 0) AS n_removed,
       CASE WHEN l.text IS NULL THEN NULL ELSE sha256(k.kept) END AS kept_sha256
FROM l LEFT JOIN k USING (doc_id)
"""


def op7_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_cnn.train(docs, read_table(spark, sf_dir, "labels"))
    out = quality_cnn.scored(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_documents(docs)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = substring_dedup.dedup_substrings(docs)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP9_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS pos FROM d WHERE len(w) >= 50),
x AS (SELECT doc_id, pos, md5(array_to_string(list_slice(w, pos, pos + 49), ' ')) AS win FROM p),
f AS (SELECT win, min(doc_id) AS first FROM x GROUP BY win HAVING min(doc_id) < max(doc_id)),
l AS (SELECT DISTINCT x.doc_id, x.pos FROM x JOIN f USING (win) WHERE x.doc_id > f.first),
c AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 50)) AS i FROM l),
g AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id),
e AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
k AS (
  SELECT e.doc_id, count(c.i)::BIGINT AS n_removed, coalesce(string_agg(e.word, ' ' ORDER BY e.i) FILTER (WHERE c.i IS NULL), '') AS kept
  FROM e LEFT JOIN c ON e.doc_id = c.doc_id AND e.i = c.i GROUP BY e.doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""


def op10_bottom_k_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - cut), F.substring("next_text", F.lit(1), cut))
    made = fingerprints.with_next(docs, {"text": F.col("text")}, {"edited": edited, "f": fingerprints.fingerprint(F.col("text"))})
    made = made.select("doc_id", "n_chars", "edited", "f", "next_f").withColumn("g", fingerprints.fingerprint(F.col("edited")))
    return made.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprints.as_text(F.col("f")).alias("fingerprint"),
        fingerprints.as_text(F.col("g")).alias("edited_fingerprint"),
        fingerprints.resemblance(F.col("f"), F.col("g")).alias("near_edited"),
        fingerprints.resemblance(F.col("f"), F.col("next_f")).alias("near_next"),
        fingerprints.distinct_shingles(F.col("f")).alias("distinct_shingles"),
    )


def queries() -> dict:
    return {f.__name__: f for f in (op1_kd_sharding, op2_source_mixing, op3_quality_rules, op4_ngram_jaccard_join, op5_language_id, op6_line_window_dedup, op7_quality_cnn, op8_best_fit_packing, op9_substring_dedup, op10_bottom_k_fingerprints)}


def oracle_sql() -> dict[str, str]:
    return {"op2_source_mixing": OP2_SQL, "op4_ngram_jaccard_join": OP4_SQL, "op6_line_window_dedup": OP6_SQL, "op9_substring_dedup": OP9_SQL}
