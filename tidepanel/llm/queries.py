"""The registered queries of the numbered operators, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm import bpe, decontaminate, infill, langid, licenses, lines, lm, media, near, packing, sketches, substring, whitening
from tidepanel.llm.sql import SQL  # noqa: F401


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def remainder(n: int):
    """crc32 of doc_id as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = langid.identify(docs, langid.profiles(docs.where(remainder(5) != 0)))
    return found.select("doc_id", (remainder(5) == 0).alias("held_out"), "lang_pred", "score")


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.decode(media.encode(documents(spark, sf_dir)))
    return stored.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -16, 16)")).alias("tail_crc32"),
        F.length("png").cast("long").alias("media_bytes"),
        F.sha2("png", 256).alias("media_sha256"),
        F.lower(F.hex("phash")).alias("feature"),
    )


def op8_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_decode(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))
    return coded.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring.without_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    cleaned = lines.LineIndex.build(docs).clean(docs)
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sketches.compared(documents(spark, sf_dir))
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        sketches.text_of(F.col("sketch")).alias("fingerprint"),
        sketches.text_of(F.col("edited_sketch")).alias("edited_fingerprint"),
        sketches.resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        sketches.resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(documents(spark, sf_dir))
    return found.withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")})


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm.scores(documents(spark, sf_dir), F.coalesce(remainder(7) != 2, F.lit(False)))
    held = F.coalesce(remainder(7) == 2, F.lit(False)).alias("held_out")
    return found.select("doc_id", held, "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near.groups(documents(spark, sf_dir), size=4, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.transform(documents(spark, sf_dir))
    texts = {"output_sha256": F.col("output"), "restored_sha256": infill.restore(F.col("output"), F.col("form"))}
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *(F.sha2(x.cast("binary"), 256).alias(k) for k, x in texts.items()))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.integers(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    model, seen = whitening.fit(rows)
    if model is None:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    each = whitening.whiten(rows, model).select("vec_id", F.col("deviation").try_cast("long").alias("deviation"), F.posexplode("whitened").alias("_k", "whitened"))
    shares = F.array(*(F.lit(x) for x in model.explained))
    error = whitening.identity_error(seen, model)
    return each.select("vec_id", (F.col("_k") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, "_k").alias("explained"), F.lit(error).alias("identity_error"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_line_dedup, op3_license_scan, op4_best_fit_packing, op5_media_columns, op6_fingerprints, op7_minhash_dedup, op8_bpe_automaton, op9_substring_dedup, op10_lm_scoring, op11_fill_in_middle, op12_decontamination, op13_whitening)}
