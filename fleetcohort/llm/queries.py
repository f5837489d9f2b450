"""Registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetcohort.llm import centroids, decontaminate, fingerprint, idstore, jaccard, licenses, lm, packing, quality, sentencepiece, sitetree, turntrie, wordpiece
from fleetcohort.llm.common import crc_mod, tokenizer_file

PIECE_MODEL = "piece_bpe_32k.model"
WORD_MODEL = "word_bpe_49k.json"
BYTE_MODEL = "byte_bpe_50k.json"


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    compared = fingerprint.compare_with_next(_table(spark, folder, "documents"))
    return compared.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"),
        fingerprint.fingerprint(F.col("sketch")).alias("fingerprint"),
        fingerprint.fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        fingerprint.distinct_shingles(F.col("sketch")).alias("shingles"),
    )


#: Where a document would lie as a file, in both dialects: source, then folders by its number.
LICENCE_PATH = (
    "coalesce(source, '') || '/p' || CAST({div64} AS {text}) || CASE WHEN doc_id % 64 = 1"
    " THEN '/LICENSE' WHEN doc_id % 8 = 0 THEN '/m' || CAST({div8} AS {text}) || '/COPYING'"
    " ELSE '/m' || CAST({div8} AS {text}) || '/' || CAST(doc_id AS {text}) || '.txt' END"
)


def op2_licences(spark: SparkSession, folder: str) -> DataFrame:
    path = LICENCE_PATH.format(div64="doc_id div 64", div8="doc_id div 8", text="STRING")
    return licenses.scan(_table(spark, folder, "documents"), "doc_id", F.expr(path))


def digest_ids(encoded: DataFrame) -> DataFrame:
    """doc_id and the digest columns of encoded and decoded texts."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op3_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return digest_ids(sentencepiece.encode_decode(docs, tokenizer_file(PIECE_MODEL)))


def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return wordpiece.token_counts(docs, tokenizer_file(PIECE_MODEL))


def op5_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.join_components(_table(spark, folder, "documents"), width=3, num=9, den=10)


def op6_id_store(spark: SparkSession, folder: str) -> DataFrame:
    store = idstore.new_folder(spark)
    idstore.write_ids(_table(spark, folder, "documents"), store, tokenizer_file(WORD_MODEL))
    read = idstore.with_starts(idstore.read_documents(spark, store))
    return read.select(
        F.col("key").alias("doc_id"), "start", "n_tokens", "ids_crc32"
    )


def op7_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    leaks = decontaminate.find_leaks(docs, _table(spark, folder, "benchmark"))
    return leaks.select(
        "doc_id",
        (F.size("leaks") > 0).alias("contaminated"),
        F.col("leaks.item_id").alias("item_ids"),
        F.array_max("leaks.share").alias("best_share"),
    )


def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    model = quality.fit(docs, _table(spark, folder, "labels"))
    return quality.score(docs, model).select(
        "doc_id",
        (crc_mod("doc_id", 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op9_language_model(spark: SparkSession, folder: str) -> DataFrame:
    return lm.score(_table(spark, folder, "documents"))


def op10_html_text(spark: SparkSession, folder: str) -> DataFrame:
    texts = sitetree.main_text(_table(spark, folder, "pages"))
    return texts.withColumn("n_chars", F.length("text").cast("long"))


def op11_turn_trie(spark: SparkSession, folder: str) -> DataFrame:
    return turntrie.turn_trie(_table(spark, folder, "conversations"))


def op12_packing(spark: SparkSession, folder: str) -> DataFrame:
    packed = packing.pack(_table(spark, folder, "documents"), tokenizer_file(BYTE_MODEL))
    return packed.select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


def op13_centroids(spark: SparkSession, folder: str) -> DataFrame:
    found = centroids.cluster_vectors(_table(spark, folder, "embeddings"))
    return centroids.with_inertia(found).select(
        F.col("key").alias("vec_id"),
        "cluster",
        "distance",
        "cluster_inertia",
        "inertia",
        "centroid_sha256",
    )


QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "op2_licences": op2_licences,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_token_counts": op4_token_counts,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_id_store": op6_id_store,
    "op7_decontaminate": op7_decontaminate,
    "op8_quality": op8_quality,
    "op9_language_model": op9_language_model,
    "op10_html_text": op10_html_text,
    "op11_turn_trie": op11_turn_trie,
    "op12_packing": op12_packing,
    "op13_centroids": op13_centroids,
}

ORACLE: dict[str, str] = {
    "op2_licences": licenses.oracle(
        LICENCE_PATH.format(div64="doc_id // 64", div8="doc_id // 8", text="VARCHAR")
    ),
    "op13_centroids": centroids.oracle(),
}
