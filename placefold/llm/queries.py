"""Registered queries of the text operators: each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import load
from . import (
    bands,
    bpe,
    cotrain,
    fmindex,
    lines,
    minhash,
    ngram_join,
    periods,
    pii,
    secret_scan,
    token_files,
    turn_trie,
    winnow,
)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def span_text(spans) -> F.Column:
    """kind:start:end of every span, comma-joined."""
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def op1_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bands.compression_bands(_documents(spark, sf_dir))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(_documents(spark, sf_dir))
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return found.select(
        "doc_id",
        *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in secret_scan.BASE_KINDS),
        F.size(of(secret_scan.GUESS)).cast("long").alias("n_guess"),
        F.sha2(span_text(of(*secret_scan.BASE_KINDS)), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
    )


def op3_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = lines.dedup_lines(_documents(spark, sf_dir))
    return cut.select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_decode(_documents(spark, sf_dir), _vocabulary("byte_bpe_50k.json"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_documents(spark, sf_dir)).drop(minhash.ROW)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.token_folder(spark)
    token_files.write_token_files(
        _documents(spark, sf_dir), _vocabulary("word_bpe_49k.json"), folder, end_id=2, width=2
    )
    read = token_files.read_token_files(spark, folder)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_cotrained_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = cotrain.quality_scores(_documents(spark, sf_dir), load(spark, sf_dir, "labels"))
    return scored.drop(cotrain.ROW)


def op8_winnow_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnow.find_contamination(_documents(spark, sf_dir), load(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        winnow.contaminated().alias("contaminated"),
    )


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(_documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["kind"] != pii.CONTEXT)
    of = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    return found.select(
        "doc_id",
        *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in (*pii.KINDS, pii.CONTEXT)),
        F.sha2(span_text(base), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
    )


def op10_fm_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fmindex.dedup_substrings(_documents(spark, sf_dir))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def rebuilt(sequences: DataFrame) -> DataFrame:
    """Every conversation with its first h turns taken from that of id c - c % 5; h is crc32(c) % 9."""
    family = F.col("conv") - F.col("conv") % 5
    own = F.struct("conv", "path", "sizes")
    kin = sequences.groupBy(family.alias("first")).agg(F.collect_list(own).alias("kin"))
    lead = F.get(F.filter("kin", lambda k: k["conv"] == F.col("first")), F.lit(0))
    each = kin.select(F.explode("kin").alias("own"), lead.alias("lead")).select(
        "own.*", F.coalesce("lead.path", F.lit(b"")).alias("lead_path"),
        F.coalesce("lead.sizes", F.array().cast("array<long>")).alias("lead_sizes"),
        (F.crc32(F.col("own.conv").cast("string").cast("binary")) % 9).cast("int").alias("h"),
    )
    h, width = F.col("h"), turn_trie.WIDTH
    return each.select(
        "conv",
        F.concat(
            F.substring("lead_path", F.lit(1), h * width),
            F.substring("path", h * width + 1, F.greatest(F.octet_length("path") - h * width, F.lit(0))),
        ).alias("path"),
        F.concat(
            F.slice("lead_sizes", F.lit(1), h),
            F.slice("sizes", h + 1, F.greatest(F.size("sizes") - h, F.lit(0))),
        ).alias("sizes"),
    )


def op11_turn_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = load(spark, sf_dir, "conversations")
    return turn_trie.trie_nodes(rebuilt(turn_trie.turn_sequences(turns)))


def repeat_tails(docs: DataFrame) -> DataFrame:
    """Every tenth text by its id's crc32 repeats some of its words from one of them on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size("_words")
    marked = docs.select("*", F.when(h % 10 == 0, words).alias("_words"))
    first, period = F.pmod(g, n), 1 + F.floor((n - F.pmod(g, n)) / (3 + g % 8))
    told = F.transform(
        F.col("_words"),
        lambda w, i: F.when(i < first, w).otherwise(
            F.get("_words", (first + F.pmod(i - first, period)).cast("int"))
        ),
    )
    return marked.withColumn("text", F.when(n > 0, F.array_join(told, " ")).otherwise(F.col("text"))).drop("_words")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periods.periodic_runs(repeat_tails(_documents(spark, sf_dir)))
    each = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    top = F.col("_top")
    return found.withColumn("_top", periods.greatest()).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        top["start"].alias("start"), top["length"].alias("length"), top["period"].alias("period"),
        F.floor(1000 * top["length"] / top["period"]).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(each, ""), 256).alias("runs_sha256"),
        F.sha2("kept", 256).alias("collapsed_sha256"),
    )


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(_documents(spark, sf_dir)).drop(ngram_join.ROW)


QUERIES = {
    "op1_compression_bands": (op1_compression_bands, None),
    "op2_secret_scan": (op2_secret_scan, None),
    "op3_line_windows": (op3_line_windows, lines.SQL),
    "op4_byte_pairs": (op4_byte_pairs, None),
    "op5_near_duplicates": (op5_near_duplicates, minhash.SQL),
    "op6_token_files": (op6_token_files, None),
    "op7_cotrained_quality": (op7_cotrained_quality, None),
    "op8_winnow_benchmark": (op8_winnow_benchmark, winnow.SQL),
    "op9_personal_data": (op9_personal_data, None),
    "op10_fm_substrings": (op10_fm_substrings, fmindex.SQL),
    "op11_turn_trie": (op11_turn_trie, turn_trie.SQL),
    "op12_periodic_runs": (op12_periodic_runs, None),
    "op13_ngram_join": (op13_ngram_join, ngram_join.SQL),
}
