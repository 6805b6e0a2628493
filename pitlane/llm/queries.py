"""The numbered queries, with production parameters."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, decontaminate, divergence, fingerprints, langid, neardup, packing, quality, secrets, sentencepieces, urls, wrappers
from .common import shared_folder, table
from .shards import ShardStore, load_in_arrivals


def vocabulary_path() -> str:
    """Place of the public vocabulary on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


#: Grades of rated documents: toxic, of low quality, good. Documents stay if the last is likelier than not.
GRADES, GOOD, LEAST_PROBABILITY = 3, 2, 0.5


def graded(labels: DataFrame) -> DataFrame:
    """doc_id, grade of the labels table; null if a rating that decides is."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)
    return labels.select("doc_id", grade.alias("grade"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, expected_grade, tail_probability, kept: a row for each document; see quality.judge() for odd texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, graded(table(spark, sf_dir, "labels")), GRADES)
    return quality.judge(docs, model, ["doc_id"], keep_from=GOOD).withColumn("kept", F.col("tail_probability") >= LEAST_PROBABILITY)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict, pattern: a row for each page; see urls.judge() for odd URLs."""
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "pattern")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, agrees (with the library): a row for each document, a null text counting as empty."""
    out = sentencepieces.encode_decode(table(spark, sf_dir, "documents"), ["doc_id"], vocabulary_path)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "agrees")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: a row for each document, a null text counting as empty."""
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [secrets.counted(F.col("base_spans"), kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(secrets.joined(F.col("base_spans")), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars: a row for each page, null html counting as empty."""
    return wrappers.main_texts(table(spark, sf_dir, "pages"), ["page_id", "url"]).withColumn("n_chars", F.length("text").cast("long"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score: a row for each document; learned from those that aren't held out and have a language."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", langid.held_out(F.col("doc_id")))
    model = langid.fit(docs.where("not held_out"), "doc_id", "text", "lang")
    return langid.predict(docs, model, ["doc_id", "held_out"])


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, text_sha256 of every stored row; run (the version that wrote it), file (its number there), tier, and version, the newest."""
    store = ShardStore(spark, f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}", target_bytes=64 << 20)
    stored = load_in_arrivals(store, table(spark, sf_dir, "documents"), "doc_id", arrivals=8)
    tiers = F.broadcast(spark.createDataFrame([(run, tier) for run, tier, _ in store.runs()] or [("", 0)], "run string, tier int"))  # fewer runs than fan_in in each tier
    version = F.lit(store.versions()[-1]).cast("long")
    run, file = F.split("run", "-")[0].cast("long"), F.regexp_extract("file", r"^part-(\d+)", 1).cast("int")
    return stored.join(tiers, "run").select("doc_id", "n_chars", F.sha2("text", 256).alias("text_sha256"), run.alias("run"), file.alias("file"), "tier", version.alias("version"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: a row for each document, a null text counting as empty."""
    pairs = fingerprints.edited_pairs(table(spark, sf_dir, "documents"))
    return pairs.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprints.as_text(F.col("sketch")).alias("fingerprint"), fingerprints.as_text(F.col("edited_sketch")).alias("edited_fingerprint"), "near_edited", "near_next")


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row for each document; see neardup.classes() for texts without words and null ids."""
    return neardup.classes(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: a row for each document, a null text having no words."""
    found = decontaminate.find_windows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    out = decontaminate.verdicts(found, ["doc_id"])
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang, source, part, item, value, rank: see divergence.audit()."""
    return divergence.audit(table(spark, sf_dir, "documents"), least_docs=30, prior=5, top=50)


def packed_vocabulary_path() -> str:
    """Place of the public vocabulary of op12 on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: a row for each piece, a null text having the end id alone."""
    pieces = packing.pack(table(spark, sf_dir, "documents"), ["doc_id"], packed_vocabulary_path, size=4096, end_id=2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256: a row for each kept vector; see centroids.cluster()."""
    return centroids.cluster(table(spark, sf_dir, "embeddings"), ["vec_id"], width=64, scale=64, k=16, rounds=3, seed="1")


QUERIES = {f.__name__: f for f in (op1_quality, op2_url_filter, op3_sentencepiece, op4_secret_scan, op5_html_extraction, op6_language_id, op7_sharding, op8_fingerprints, op9_minhash_near_dedup, op10_decontamination, op11_source_divergence, op12_packing, op13_centroids)}
