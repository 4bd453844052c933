"""The registered queries of this package: thin, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kind_count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def secret_digest(found: DataFrame) -> DataFrame:
    from factloom.llm.secret_scan import KINDS, listed

    base = F.filter("secrets", lambda s: s["kind"] != "entropy")
    counts = [kind_count("secrets", k) for k in KINDS]
    return found.select(F.col("doc.doc_id").alias("doc_id"), *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"))


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every text."""
    from factloom.llm.secret_scan import find_secrets

    return secret_digest(find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every text without strings that repeat."""
    from factloom.llm.repeats import without_repeats

    found = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return found.select(F.col("doc.doc_id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as ids in token files, described from what the files say."""
    import public_tokenizers

    from factloom.llm.tokens import read_tokens, write_tokens

    files, folder = write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(files, folder)


def leak_digest(found: DataFrame) -> DataFrame:
    from factloom.llm.leaks import n_hit

    hit = n_hit()
    return found.select(
        F.col("doc.doc_id").alias("doc_id"), F.col("leak.n_words").alias("n_words"), hit.alias("n_hit"),
        F.size("leak.items").cast("long").alias("n_items"), F.sha2(F.array_join("leak.items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"), F.col("leak.longest").alias("longest_match"),
    )


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    from factloom.llm.urls import judge

    found = judge(table(spark, sf_dir, "pages").select("page_id", "url"), keep=["page_id"])
    return found.select(F.col("page.page_id").alias("page_id"), "host", "path", "rule", "verdict", F.round("score", 4).alias("score"), "threshold")


def pii_digest(found: DataFrame) -> DataFrame:
    from factloom.llm.pii import KINDS
    from factloom.llm.secret_scan import listed

    base = F.filter("entities", lambda s: s["kind"] != "context")
    counts = [kind_count("entities", k) for k in KINDS]
    return found.select(F.col("doc.doc_id").alias("doc_id"), *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("entities")).alias("spans"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text."""
    from factloom.llm.pii import find_pii

    return pii_digest(find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"]))


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences that passages of each text are like, with the dice coefficient in millionths."""
    from factloom.llm.licences import scan

    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    text = F.transform("licences", lambda x: F.concat_ws(":", x["licence"], F.round(x["dice"] * 1000000).cast("long").cast("string")))
    return found.select(F.col("doc.doc_id").alias("doc_id"), F.size("licences").cast("long").alias("n_licences"), F.array_join(text, ",").alias("licences"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every text and whether it is kept."""
    from factloom.llm.rules import assess

    found = assess(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), keep=["doc_id"])
    return found.select(F.col("doc.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("distance", 3).alias("distance"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document inside windows of benchmark items."""
    from factloom.llm.leaks import find_leaks

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return leak_digest(find_leaks(docs, table(spark, sf_dir, "benchmark")))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    from factloom.llm.simhash import grouped, hex_of

    found = grouped(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return found.select(F.col("doc.doc_id").alias("doc_id"), hex_of(F.col("fp")).alias("fingerprint"), F.col("least").alias("component_id"))


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document."""
    from factloom.llm.mixing import mix

    found = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), keep=["doc_id"])
    return found.select(F.col("doc.doc_id").alias("doc_id"), "size", "source_size", "target", "taken")


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the archive record of every page says, from the merged capture index."""
    from factloom.llm.archives import history

    return history(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove of every source, in every order."""
    from factloom.llm.audit import FILTERS, audit, failures

    flagged = failures(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    found = audit(flagged, FILTERS, F.col("source"), {"good": F.col("good"), "toxic": F.col("toxic")})
    return found.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", F.col("lost_good").alias("good_lost"), F.col("lost_toxic").alias("toxic_lost"), "shapley")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    from factloom.llm.ranked import search

    return search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


def register(catalog) -> None:
    from factloom.llm.archives import WARC_SQL
    from factloom.llm.audit import AUDIT_SQL
    from factloom.llm.licences import scan_sql
    from factloom.llm.mixing import MIX_SQL
    from factloom.llm.ranked import RANKED_SQL
    from factloom.llm.repeats import REPEATS_SQL

    catalog.add("op1_secrets", op1_secrets)
    catalog.add("op2_suffix_dedup", op2_suffix_dedup, REPEATS_SQL)
    catalog.add("op3_token_files", op3_token_files)
    catalog.add("op4_url_filter", op4_url_filter)
    catalog.add("op5_pii", op5_pii)
    catalog.add("op6_licences", op6_licences, scan_sql())
    catalog.add("op7_quality_rules", op7_quality_rules)
    catalog.add("op8_decontaminate", op8_decontaminate)
    catalog.add("op9_simhash", op9_simhash)
    catalog.add("op10_mix", op10_mix, MIX_SQL)
    catalog.add("op11_warc", op11_warc, WARC_SQL)
    catalog.add("op12_filter_audit", op12_filter_audit, AUDIT_SQL)
    catalog.add("op13_ranked_search", op13_ranked_search, RANKED_SQL)
