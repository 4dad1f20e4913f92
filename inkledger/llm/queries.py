"""The operators over the given tables: thin steps from documents to notes and back."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkledger.llm import (
    bytepair, centroids, chunks, collocations, curves, mixture, oracles, packing, paths, records,
    repetition, shards, simhash, toxicity,
)
from inkledger.session import cut_lineage, scratch_path

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
SHARDS = 40
LINK_RULES = (
    paths.Rule("com", "/", "allow"),
    paths.Rule("example.com", "/en/", "block"),
    paths.Rule("www.example.com", "/en/", "allow"),
    paths.Rule("net", "/es/", "block"),
    paths.Rule("net", "/fr/", "block"),
    paths.Rule("*", "/*/ads/", "block"),
    paths.Rule("*", "/ads/", "block"),
    paths.Rule("*", "/login/", "block"),
    paths.Rule("*", "/*/tracking/*.gif", "block"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


def notes_of(documents: DataFrame) -> DataFrame:
    """Documents as review records: their id is the position, their text the notes."""
    return documents.select(
        F.col("doc_id").alias("position"), F.col("text").alias("notes"), "lang", "source", "n_chars")


def remainder(position: Column) -> Column:
    return F.crc32(position.cast("string").cast("binary")) % 3


def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark)
    records.write_notes(notes_of(table(spark, sf_dir, "documents")), folder, TOKENIZER, PATTERN, end_id=0)
    return records.read_notes(spark, folder).select(
        F.col("position").alias("doc_id"), "start", "n_tokens", F.crc32("token_bytes").alias("ids_crc32"))


def op2_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Written between the two, so that a core serves one Python worker at a time.
    encoded = cut_lineage(bytepair.encode_notes(notes_of(table(spark, sf_dir, "documents")), RANKS, PATTERN))
    ids = F.col("token_ids")
    return bytepair.decode_notes(encoded, RANKS).select(
        F.col("position").alias("doc_id"), F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(ids.cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("note_bytes", 256).alias("decoded_sha256"))


def toxicity_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents, learned from the labels of those that are not held out."""
    notes = notes_of(documents)
    learned = remainder(F.col("position")) != 1
    known = labels.select(F.col("doc_id").alias("position"), "toxic").filter(learned)
    model = toxicity.fit_toxicity(notes.filter(learned), known, language="lang")
    return toxicity.score_notes(notes, model, language="lang")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    doc_id = F.col("_row.position")
    return scored.select(
        doc_id.alias("doc_id"), (remainder(doc_id) == 1).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"), "threshold", "rejected")


def op4_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    placed = shards.shard_pages(
        table(spark, sf_dir, "documents"), SHARDS,
        {"lang": shards.order_code(F.col("lang")), "source": shards.order_code(F.col("source")),
         "n_chars": F.col("n_chars")},
        size=F.octet_length(text) + 16, same=text, key="doc_id",
        keep={"text_crc32": F.crc32(text.cast("binary"))})
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_copies(notes_of(table(spark, sf_dir, "documents")), shingle=4, radius=4)
    return groups.select(
        F.col("position").alias("doc_id"),
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op6_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = chunks.drop_repeated_lines(notes_of(table(spark, sf_dir, "documents")))
    return left.select(
        F.col("_row.position").alias("doc_id"), "text", "removed_lines",
        F.to_json("removed_spans").alias("removed_spans"))


def op7_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = repetition.judge_notes(notes_of(table(spark, sf_dir, "documents")))
    return judged.select(
        F.col("position").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines",
        "n_repeat_words", "base_failed", "kept", "repeat_chars", "longest_repeat")


def op8_link_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("file_link"))
    judged = paths.judge_links(files, LINK_RULES)
    return judged.select(F.col("_row.page_id").alias("page_id"), "host", "path", "rule", "verdict")


OP8_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0
                       THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), rules(rule_host, rule_path, rule_verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
         ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), fits AS (
  SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         arg_max(rule_verdict, length(rule_host || rule_path)) AS verdict
  FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host))
       AND starts_with(path, rule_path)
  GROUP BY page_id
)
SELECT p.page_id, p.host, p.path, f.rule,
       coalesce(f.verdict, CASE WHEN p.path LIKE '/%/ads/%' OR starts_with(p.path, '/ads/')
         OR starts_with(p.path, '/login/') OR p.path LIKE '/%/tracking/%.gif%'
         THEN 'block' ELSE 'allow' END) AS verdict
FROM parts p LEFT JOIN fits f ON p.page_id = f.page_id
"""


def op9_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("cand_id"), F.col("embedding").alias("signature"))
    near = curves.nearest_signatures(vectors, F.col("cand_id") % 100 == 0)
    return near.select("query_id", "rank", F.col("cand_id").alias("vec_id"), "score")


def packed(documents: DataFrame) -> DataFrame:
    pieces = packing.pack_notes(notes_of(documents), TOKENIZER, PATTERN, end_id=0)
    return pieces.select(
        F.col("position").alias("doc_id"), "start", "length", F.crc32("token_bytes").alias("ids_crc32"),
        "doc_tokens", "sequence_id", "offset")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = notes_of(table(spark, sf_dir, "documents")).withColumnRenamed("lang", "stamp_type")
    marked = collocations.collocations(notes, min_count=10, max_words=3, first=2000, unknown="und")
    return marked.select(
        F.col("kind").alias("lang"), "rank", "phrase", "a", "l", "r", "n", "score")


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("cand_id"), F.col("embedding").alias("signature"))
    grouped = centroids.cluster_signatures(vectors, k=8, rounds=10, seed=3, bins=64, scale=1024)
    return grouped.withColumnRenamed("cand_id", "vec_id")


def source_weights(documents: DataFrame, weights: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """The catalog of sources in order, null last, with weights that repeat."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    listed = F.array(*map(F.lit, weights))
    return documents.select("source").distinct().select(
        "source", F.get(listed, place % len(weights)).alias("weight"))


def op13_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    mixed = mixture.mix_sources(
        notes_of(documents), source_weights(documents), share=1.5, most_epochs=2, seed=13, source="source")
    return mixed.select(
        F.col("position").alias("doc_id"), "size", "source_size", "target", "taken")


QUERIES = {f.__name__: f for f in (
    op1_token_records, op2_byte_pairs, op3_toxicity, op4_kd_shards, op5_simhash, op6_line_chunks,
    op7_repetition, op8_link_rules, op9_curves, op10_packing, op11_collocations, op12_centroids,
    op13_mixture)}
SQL = {
    "op8_link_rules": OP8_SQL, "op11_collocations": oracles.COLLOCATIONS,
    "op12_centroids": oracles.CENTROIDS, "op13_mixture": oracles.MIXTURE,
}
