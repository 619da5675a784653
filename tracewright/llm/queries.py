"""The registered queries of this subpackage: thin digests over its operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import spread
from . import chat, decontamination, embeddings, fim, licences, merkle, oracles, packing, planes, quality, reputation, secrets, sharding, simhash, tokens
from .shared import written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(_table(spark, sf_dir, "documents"))


def op1_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scanned(_table(spark, sf_dir, "documents"))


#: How the raw transcripts of op2 mark a speaker; a style for each conversation.
STYLES = ("%s: ", "### %s\n", "[%s] ", "<|%s|>\n", "**%s:** ")
#: One turn in so many has no marker.
UNMARKED = 10
#: One turn in so many has one of these lines, which begin like a marker and stand in prose.
ASIDES = 12
LIKE_MARKERS = ("Question: does this hold in general", "Answer: see the part above", "User > Settings > Profile is where it is found", "Context: none was given", "model: the one from before")


def raw_transcripts(conversations: DataFrame, clean: bool = False) -> DataFrame:
    """``conv_id, turn, role, text``: every turn after a marker in its conversation's style.

    One in ``UNMARKED`` turns, but never a conversation's first, stands without
    its marker. A blank line follows two in three turns; in a quarter of the
    conversations blank lines part the lines of a turn too. Names are written
    as they are, in small or in capital letters, by conversation. One in
    ``ASIDES`` turns has a last line that begins like a marker and is none.
    ``clean``: a blank line after every turn, one spelling, no such lines.
    """

    def drawn(n: int, *of):
        return F.pmod(F.xxhash64(*of), F.lit(n)).cast("int")

    style = drawn(len(STYLES), "conv_id", F.lit("style"))
    other = drawn(2, "conv_id", F.lit("names")) == 0
    name = F.when(F.col("role") == "user", F.when(other, "Human").otherwise("User")).when(F.col("role") == "assistant", F.when(other, "AI").otherwise("Assistant")).otherwise(F.initcap("role"))
    spelling = drawn(3, "conv_id", F.lit("spelling"))
    name = name if clean else F.when(spelling == 1, F.lower(name)).when(spelling == 2, F.upper(name)).otherwise(name)
    marker = F.replace(F.element_at(F.array(*map(F.lit, STYLES)), style + 1), F.lit("%s"), name)
    marker = F.when((F.pmod(F.xxhash64("conv_id", "turn"), F.lit(UNMARKED)) == 0) & (F.col("turn") > 0), F.lit("")).otherwise(marker)
    spaced = drawn(4, "conv_id", F.lit("spaced")) == 0
    text = F.when(spaced, F.replace("text", F.lit("\n"), F.lit("\n\n"))).otherwise(F.col("text"))
    aside = F.element_at(F.array(*map(F.lit, LIKE_MARKERS)), drawn(len(LIKE_MARKERS), "conv_id", "turn", F.lit("like")) + 1)
    aside = F.when(drawn(ASIDES, "conv_id", "turn", F.lit("aside")) == 0, F.concat(F.lit("\n"), aside)).otherwise("")
    end = F.when(drawn(3, "conv_id", "turn", F.lit("end")) > 0, "\n").otherwise("")
    aside, end = (F.lit(""), F.lit("\n")) if clean else (aside, end)
    return conversations.select("conv_id", "turn", "role", F.concat(F.coalesce(marker, F.lit("")), F.coalesce(text, F.lit("")), aside, end).alias("text"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raw_transcripts(_table(spark, sf_dir, "conversations"))
    # fitted on the labels of a fifth of the conversations; all are decoded, from their texts alone
    model = chat.fitted(rows.filter(F.pmod(F.xxhash64("conv_id", F.lit("fold")), F.lit(5)) == 0))
    return chat.formatted(rows.select("conv_id", "turn", "text"), model)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), tokens.vocabulary("word_bpe_49k.json"), capacity=4096, end_id=1)


def op4_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, manifest = planes.write_ids(_table(spark, sf_dir, "documents"), tokens.vocabulary("byte_bpe_50k.json"), end_id=2)
    return planes.read_ids(spark, path, manifest)


def op5_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    found = sharding.shuffled(docs, ["doc_id", "text"], shards=24)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary")).cast("long")
    return found.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    # an assumption: the page of an id carries the document of that id, so the document's labels are the page's outcome
    bad = F.greatest(1 - F.col("quality"), F.col("toxic"))
    outcomes = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    found = reputation.judged(_table(spark, sf_dir, "pages"), outcomes)
    return found.select(F.col("page_id").cast("long"), "host", "path", "rule", "verdict", "labelled", "bad", F.round("mean", 6).alias("mean"), "below")


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_documents(spark, sf_dir), radius=4, shingle=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "window_start", "n_words", "similarity")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(secrets.findings(_documents(spark, sf_dir)), "findings", texts=True)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality(_documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("distance", 3).alias("distance"))


def op11_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"), cosine=0.9)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fim.transformed(_documents(spark, sf_dir).select("doc_id", "text"), seed=1)
    back = fim.restored(F.col("output"), F.col("form"))
    return found.select(F.col("doc_id").cast("long"), "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "source", "lang", "n_chars", "text")

    def leaf(text):
        return merkle.leaf(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)

    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    claimed = F.when(tampered, leaf(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    found = merkle.manifest(docs, "doc_id", "source", leaf(F.col("text")), claimed)
    return found.select(F.col("doc_id").cast("long"), "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified")


QUERIES = {f.__name__: f for f in (op1_licence_scan, op2_chat_formatting, op3_best_fit_packing, op4_token_planes, op5_hypergeometric_shards, op6_host_reputation, op7_simhash_near_dedup, op8_benchmark_decontamination, op9_secret_scan, op10_quality_rules, op11_projection_forest, op12_fill_in_middle, op13_merkle_manifest)}

ORACLES: dict[str, str] = {"op6_host_reputation": oracles.OP6, "op8_benchmark_decontamination": oracles.OP8, "op12_fill_in_middle": oracles.OP12, "op13_merkle_manifest": oracles.OP13}
