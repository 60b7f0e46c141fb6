"""The registered queries of this subpackage: name to (spark, sf_dir) callable, and SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depscope.llm import chat, importance, langid, linededup, media, mixing, packing, periodic, private, quality, simhash, substrings, urls
from depscope.llm.sql import ORACLES
from depscope.sources.tables import read_table

#: Blocks per cycle of each source; others have one.
WEIGHTS = {"src0": 4, "src1": 3, "src2": 2}

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    docs = docs.withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    return langid.identify(docs, ~F.col("held_out")).select("doc_id", "held_out", "lang_pred", "score")


def op2_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality.quality(docs, carry=["doc_id"]).select(
        "doc_id", *quality.COUNTS, "base_failed", "kept", "host_verdict"
    )


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return private.personal_data(docs, redacted=False).drop("text")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup_lines(docs)


def op5_chat_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    turns = turns.unionByName(spark.createDataFrame(more, "conv_id long, turn long, role string, text string"))
    tree, members = chat.prefix_tree(turns, TOKENIZER)
    return chat.read_back(tree, members, TOKENIZER).drop("n_tokens")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.packed_documents(docs, TOKENIZER, 1024)


def op7_motion_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return media.stored_and_read(docs)


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op9_url_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages).drop("url")


def op10_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(docs, WEIGHTS)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return importance.resample(docs, read_table(spark, sf_dir, "benchmark"))


def planted(docs: DataFrame) -> DataFrame:
    """Of a tenth of the documents, by a hash of doc_id, the words from one on repeat the first few of them."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g, n, a, p = F.floor(h / 10), F.size("w"), F.col("a"), F.col("p")
    chosen = docs.where(h % 10 == 0).withColumn("w", F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).where(n > 0)
    chosen = chosen.withColumn("a", (g % n).cast("int")).withColumn("p", (1 + F.floor((n - a) / (3 + g % 8))).cast("int"))
    words = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.element_at("w", F.when(i < a, i).otherwise(a + (i - a) % p) + 1))
    rest = docs.where((h % 10 != 0) | h.isNull() | F.col("text").isNull() | ~F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return chosen.select("doc_id", F.array_join(words, " ").alias("text")).unionByName(rest.select("doc_id", "text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic.periodic_runs(planted(read_table(spark, sf_dir, "documents")))
    line = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.col("n_runs") > 0, F.concat(line, F.lit("\n"))).otherwise("")
    return docs.select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2(F.coalesce("collapsed", F.lit("")), 256).alias("collapsed_sha256"),
    )


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = substrings.dedup_substrings(docs)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every opN_<name> of this module."""
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    """SQL for those that SQL can express."""
    return dict(ORACLES)
