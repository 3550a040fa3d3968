"""The dealt operators as queries over the given tables, and their SQL cross-checks."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanloom.llm import (chat_format, cross_tokens, fingerprints, lang_id, line_dedup, mixing, packing, periods, quality,
                          simhash, suffix_dedup, url_filter, warc)
from loanloom.llm.common import table

# listed rules of the URL contract (fixed values)
URL_RULES = (
    url_filter.ListedRule("com", "/", "allow"),
    url_filter.ListedRule("example.com", "/en/", "block"),
    url_filter.ListedRule("www.example.com", "/en/", "allow"),
    url_filter.ListedRule("net", "/es/", "block"),
    url_filter.ListedRule("net", "/fr/", "block"),
)


def chat(spark: SparkSession, folder: str) -> DataFrame:
    spans = F.transform("mask", lambda s: F.concat_ws(":", s["start"], s["stop"]))
    return chat_format.perspectives(table(spark, folder, "conversations")).withColumn("mask", F.array_join(spans, ","))


def substrings(spark: SparkSession, folder: str) -> DataFrame:
    found = suffix_dedup.dedup_substrings(table(spark, folder, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                        F.sha2("kept", 256).alias("kept_sha256"))


def packed(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    pieces = packing.pack(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def language(spark: SparkSession, folder: str) -> DataFrame:
    return lang_id.identify(table(spark, folder, "documents"))


def urls(spark: SparkSession, folder: str) -> DataFrame:
    judged = url_filter.judge_urls(table(spark, folder, "pages"), table(spark, folder, "labels"), URL_RULES)
    return judged.drop("url")


def lines(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", F.size(line_dedup.text_lines(F.col("text"))).alias("n_lines"))
    short = line_dedup.dedup_lines(docs, runs_as="runs")
    removed = F.aggregate("runs", F.lit(0), lambda n, r: n + r["last"] - r["first"] + 1)
    return short.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"),
                        F.coalesce(removed, F.lit(0)).cast("long").alias("n_removed"), F.sha2("text", 256).alias("kept_sha256"))


def near_copies(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, folder, "documents"))
    return found.select("doc_id", simhash.fingerprint_text(F.col("fp")).alias("fingerprint"), "component_id")


def syncmers(spark: SparkSession, folder: str) -> DataFrame:
    pairs = fingerprints.edited_pairs(table(spark, folder, "documents"))
    return pairs.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
                        "near_edited", "near_next")


def judged(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(table(spark, folder, "documents"))


def mixed(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_plan(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def aligned(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    files = cross_tokens.Vocabularies(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN,
                                      public_tokenizers.path("piece_bpe_32k.model"))
    found = cross_tokens.align(table(spark, folder, "documents"), files,
                               lambda groups: F.when(groups == "", "").otherwise(F.sha2(groups, 256))).documents
    return found.withColumnRenamed("groups", "groups_sha256")


def archived(spark: SparkSession, folder: str) -> DataFrame:
    found = warc.archived(table(spark, folder, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's text: in one of ten documents the words from a place on repeat a period."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periods.periodic_runs(table(spark, folder, "documents").select("doc_id", "text"), planted)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"),
                                                              (-r["period"]).alias("often"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.back")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.often")).alias("period"), F.expr("1000 * best.length div -best.often").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


QUERIES = {
    "op1_chat_format": chat,
    "op2_suffix_dedup": substrings,
    "op3_pack": packed,
    "op4_language_id": language,
    "op5_url_filter": urls,
    "op6_line_dedup": lines,
    "op7_simhash_golay": near_copies,
    "op8_syncmer_fingerprints": syncmers,
    "op9_quality_rules": judged,
    "op10_mix": mixed,
    "op11_token_alignment": aligned,
    "op12_warc": archived,
    "op13_periodic_runs": runs,
}
ORACLE = {
    "op1_chat_format": chat_format.SQL,
    "op5_url_filter": url_filter.SQL,
    "op6_line_dedup": line_dedup.SQL,
    "op9_quality_rules": quality.SQL,
    "op10_mix": mixing.SQL,
}
