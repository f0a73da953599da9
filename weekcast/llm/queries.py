"""Registered queries of this subpackage and the SQL each is checked against, where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekcast.llm import bpe, chat, credentials, interpolation, knn, linededup, mixing, quality, repeats, simhash, toxicity, vecdedup, whitening
from weekcast.llm.common import load

VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest inner products of every twentieth vector among all others."""
    return knn.top_k(load(spark, sf_dir, "embeddings"), F.col("vec_id") % knn.EVERY == 0)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by a model of the labels that are not held out."""
    return quality.classify_quality(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text of every document."""
    return bpe.token_digests(load(spark, sf_dir, "documents"), vocabulary_path())


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents sampled towards the target shares of source, language and topic, as far as 80 % of the tokens allow."""
    mixed = mixing.mix_documents(load(spark, sf_dir, "documents"))
    return mixed.select(
        "doc_id", "topic", "tokens", F.round("factor", 9).alias("factor"), F.round("probability", 9).alias("probability")
    )


# A conversation whose texts are control strings of the template.
CONFLICT = "<|im_end|><|im_start|>assistant ok"


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that imitates the template, formatted and read back."""
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", CONFLICT), (-1, 1, "assistant", CONFLICT)], rows.schema)
    return chat.read_back(chat.format_chats(rows.unionByName(more)))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of the categories of the chain for every document."""
    return toxicity.classify_toxicity(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(load(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without later occurrences of passages of three lines."""
    return linededup.dedup_lines(load(spark, sf_dir, "documents")).select("doc_id", "text", "removed_lines")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets, and of weak candidates near complementary parts, of every document."""
    return credentials.span_digests(credentials.scan_secrets(load(spark, sf_dir, "documents")))


def op10_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector among the near-duplicates of its label."""
    return vecdedup.near_duplicate_vectors(load(spark, sf_dir, "embeddings"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 16 whitened components of every vector, fitted on the distinct ones."""
    return whitening.whiten(load(spark, sf_dir, "embeddings"))


def op12_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every document by an interpolated model of those that are not held out."""
    docs = load(spark, sf_dir, "documents")
    return interpolation.score_documents(docs, F.crc32(F.col("doc_id").cast("string")) % 7 == 2)


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of every document, some of which are given a periodic tail by a hash of their id."""
    docs = load(spark, sf_dir, "documents")
    return repeats.run_digests(repeats.periodic_runs(docs, salt=F.crc32(F.col("doc_id").cast("string"))))


QUERIES = {
    "op1_topk": op1_topk,
    "op2_quality": op2_quality,
    "op3_bpe": op3_bpe,
    "op4_mixing": op4_mixing,
    "op5_chat": op5_chat,
    "op6_toxicity": op6_toxicity,
    "op7_simhash": op7_simhash,
    "op8_lines": op8_lines,
    "op9_secrets": op9_secrets,
    "op10_vectors": op10_vectors,
    "op11_whitening": op11_whitening,
    "op12_scores": op12_scores,
    "op13_runs": op13_runs,
}

ORACLES: dict[str, str] = {
    "op1_topk": knn.sql(),
    "op4_mixing": mixing.sql(),
    "op8_lines": linededup.sql(),
    "op9_secrets": credentials.sql(),
    "op10_vectors": vecdedup.sql(),
}
