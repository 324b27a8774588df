"""The registered queries of this package: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import clusters, collocations, decontaminate, licences, lines, lm, near_dedup, packing, quality, secrets, sharding, topk, warc
from barloom.llm.common import table

PREDICT = 0.3
TOKENIZER = "byte_bpe_50k.json"


def quality_rows(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    weights = quality.fit(docs, table(spark, folder, "labels"))
    scored = quality.score(docs, weights)
    return scored.select("doc_id", quality.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= PREDICT).cast("int").alias("predicted"))


def packing_rows(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(packing.encode_pieces(table(spark, folder, "documents"), public_tokenizers.path(TOKENIZER)))


def file_of(docs: DataFrame) -> DataFrame:
    """Documents as files: folders and names follow from a hash of the id, two to five folders deep; every fourth is named as a licence file."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    number = F.crc32(text("doc_id"))
    turn = lambda by, of: F.floor(number / by).cast("long") % of
    inner = [F.concat(F.lit("part"), turn(by, 7).cast("string")) for by in (1, 7, 49)]
    folders = F.slice(F.array(text("source"), text("lang"), *inner), F.lit(1), (turn(343, 4) + 2).cast("int"))
    name = F.when(turn(1372, 4) == 0, F.concat(F.lit("LICENSE-"), text("doc_id"))).otherwise(F.concat(text("doc_id"), F.lit(".txt")))
    return docs.select("doc_id", F.concat(F.lit("/"), F.array_join(folders, "/"), F.lit("/"), name).alias("path"), "text")


def licence_rows(spark: SparkSession, folder: str) -> DataFrame:
    return licences.scan(file_of(table(spark, folder, "documents")))


def topk_rows(spark: SparkSession, folder: str) -> DataFrame:
    return topk.search(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


def near_dedup_rows(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, folder, "documents"), size=4, share=80)


def warc_rows(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(table(spark, folder, "pages"), least=0)


def secret_rows(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.find(table(spark, folder, "documents"))
    spans = F.coalesce("spans", F.array())
    joined = F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    # every span that the method finds is a base one
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined, 256).alias("base_sha256"), joined.alias("spans"))


def sharding_rows(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.assign(table(spark, folder, "documents"), shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def lm_rows(spark: SparkSession, folder: str) -> DataFrame:
    return lm.train_and_score(table(spark, folder, "documents"))


def contaminated_rows(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def cluster_rows(spark: SparkSession, folder: str) -> DataFrame:
    return clusters.described(clusters.fit(table(spark, folder, "embeddings"), k=8, rounds=10, seed=3))


def collocation_rows(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"), least=100, top=2000, share=100)


def line_rows(spark: SparkSession, folder: str) -> DataFrame:
    left = lines.split_texts(table(spark, folder, "documents"), enough=10, points=1)
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_attention_quality": quality_rows,
    "op2_best_two_fit": packing_rows,
    "op3_licence_scan": licence_rows,
    "op4_segment_topk": topk_rows,
    "op5_minhash_hamming": near_dedup_rows,
    "op6_warc_chain": warc_rows,
    "op7_secret_ledger": secret_rows,
    "op8_bounded_ring": sharding_rows,
    "op9_masked_lm": lm_rows,
    "op10_simhash_decontamination": contaminated_rows,
    "op11_literal_centroids": cluster_rows,
    "op12_suffix_collocations": collocation_rows,
    "op13_hashed_lines": line_rows,
}
