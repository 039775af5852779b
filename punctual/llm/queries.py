"""The registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from punctual.llm import decontamination, html, langid, line_dedup, near_dedup, nearest, oracle, packing, quality, ranked_search, secrets, sharding, substring_dedup, whitening
from punctual.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    question, answer = decontamination.last_sentence(F.col("text"))
    return decontamination.find_leaks(docs, "doc_id", "text", items, "item_id", question, answer)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), "doc_id", "text", public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html.extract_pages(pages).drop("html")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    model = langid.train(docs.where(fold != 2))
    docs = docs.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "text")
    return langid.predict(docs, model).drop("text")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(1)
    sharded = sharding.shard_records(docs, "doc_id", size)
    return sharded.select(
        "doc_id",
        size.cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        "grown_shard",
        "bucket",
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line_dedup(spark, sf_dir, line_dedup.LEAST_WORDS)


def op6_line_dedup_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single short lines too: every run with a word in it."""
    return _line_dedup(spark, sf_dir, 1)


def _line_dedup(spark: SparkSession, sf_dir: str, least: int) -> DataFrame:
    deduped = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), least=least)
    removed = F.array_join("removed_lines", ",").alias("removed_lines")
    return deduped.select("doc_id", "n_lines", "n_removed_lines", removed, F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("kept_md5"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    # The last digits of sums of fractions depend on the order of addition.
    rounded = {name: F.round(name, 6) for name in ("char_distance", "word_distance")}
    return judged.drop("text", "lang").withColumns(rounded)


def op9_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)
    return found.select(
        "doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")
    )


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = secrets.scan_unseen(docs, "text", None)
    found = secrets.path_findings(docs, "text", ledger)
    kinds = [rule.kind for rule in secrets.BASE]

    def of(*wanted: str) -> Column:
        return F.filter("spans", lambda s: s["kind"].isin(*wanted))

    return found.select(
        "doc_id",
        *[F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in kinds],
        F.sha2(secrets.written_spans(of(*kinds)).cast("binary"), 256).alias("base_sha256"),
        secrets.written_spans(F.col("spans")).alias("spans"),
    )


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = whitening.fit(rows, F.col("embedding"))
    whitened = whitening.whiten(rows, F.col("embedding"), model).select(
        F.col("row.vec_id").alias("vec_id"), "deviation", F.posexplode("whitened").alias("place", "whitened")
    )
    if model is None:
        n, share, error = F.lit(None).cast("long"), F.lit(None).cast("double"), F.lit(None).cast("double")
    else:
        # At most whitening.COMPONENTS numbers.
        shares = F.array(*[F.lit(float(e / model.trace)) for e in model.eigenvalues]).cast("array<double>")
        n, share, error = F.lit(model.n).cast("long"), F.get(shares, F.col("place")), F.lit(model.identity_error)
    return whitened.select(
        "vec_id", (F.col("place") + 1).alias("component"), n.alias("n"), "deviation", "whitened", share.alias("explained"),
        error.alias("identity_error"),
    )


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranked_search.search(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text")
    return found.select(F.col("item").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nearest.search(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("key") % 100 == 0)
    return found.select(F.col("query").alias("query_id"), "rank", F.col("candidate").alias("vec_id"), F.col("distance").alias("score"))


def queries() -> dict[str, Query]:
    return {
        "op1_decontamination": op1_decontamination,
        "op2_packing": op2_packing,
        "op3_html_extraction": op3_html_extraction,
        "op4_language_id": op4_language_id,
        "op5_sharding": op5_sharding,
        "op6_line_dedup": op6_line_dedup,
        "op6_line_dedup_any": op6_line_dedup_any,
        "op7_suffix_dedup": op7_suffix_dedup,
        "op8_quality_rules": op8_quality_rules,
        "op9_minhash_forest": op9_minhash_forest,
        "op10_secret_scans": op10_secret_scans,
        "op11_embedding_whitening": op11_embedding_whitening,
        "op12_ranked_search": op12_ranked_search,
        "op13_nearest_neighbours": op13_nearest_neighbours,
    }


def oracle_sql() -> dict[str, str]:
    return oracle.oracle_sql()
