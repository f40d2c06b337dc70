"""The corpus operators as registered queries, with their DuckDB SQL where SQL can say the same."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from . import bpe, caps, chat, imatch, jaccard, kneser_ney, lines, mixing, phrases, quality, substrings, trie, variants

#: The rank file of the queries; a parameter of the operators.
RANKS = "byte_bpe_50k.tiktoken"


def tokenizer() -> tuple[str, str]:
    """Path of the rank file and the splitting pattern."""
    import public_tokenizers

    return public_tokenizers.path(RANKS), public_tokenizers.PATTERN


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def encoded_and_decoded(docs, keep_ids=False):
    """Ids of each document and what they decode to, as digests; the ids themselves, too, where asked."""
    names = [b"%d" % i for i in range(1 << 17)]

    def digest(ids, data):
        return hashlib.sha256(b" ".join(map(names.__getitem__, ids))).hexdigest(), hashlib.sha256(data).hexdigest()

    return bpe.round_trip(docs, *tokenizer(), digest, "ids_sha256 string, decoded_sha256 string", keep_ids)


def op1_bpe(spark, sf_dir):
    return encoded_and_decoded(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs, lines.kept_sha256, "kept_sha256 string").select("doc_id", "n_dropped", "kept_sha256")


def op4_embedding_dedup(spark, sf_dir):
    return caps.near_vectors(table(spark, sf_dir, "embeddings"))


def op3_document_fingerprints(spark, sf_dir):
    return imatch.near_edits(table(spark, sf_dir, "documents"))


def op6_ngram_jaccard_join(spark, sf_dir):
    return jaccard.ngram_join(table(spark, sf_dir, "documents"), width=4, num=85)


def op7_chat_formatting(spark, sf_dir):
    hard = r"\### Assistant: </turn> ok"
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], given.schema)
    return chat.read_back(chat.format_turns(given.unionByName(added), *tokenizer()), *tokenizer())


def op5_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_lm_scoring(spark, sf_dir):
    out = kneser_ney.held_out(F.col("doc_id"))
    return kneser_ney.score(table(spark, sf_dir, "documents"), ~out).withColumn("held_out", out)


def op9_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.classify(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op10_suffix_dedup(spark, sf_dir):
    def digest(data, kept, gone):
        return len(data), len(data) - len(kept), len(gone), hashlib.sha256(kept).hexdigest()

    columns = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return substrings.cut_repeats(table(spark, sf_dir, "documents"), 100, digest, columns)


def op11_spelling_variants(spark, sf_dir):
    return variants.variants(table(spark, sf_dir, "documents"))


def op12_decontamination(spark, sf_dir):
    indexed = phrases.index(table(spark, sf_dir, "documents"))
    return phrases.contamination(indexed, table(spark, sf_dir, "benchmark"))


def op13_prefix_trie(spark, sf_dir):
    return trie.rebuilt_trie(table(spark, sf_dir, "conversations"))


def queries():
    return {f.__name__: f for f in (op1_bpe, op2_line_dedup, op3_document_fingerprints, op4_embedding_dedup, op5_mixing, op6_ngram_jaccard_join, op7_chat_formatting, op8_lm_scoring, op9_quality_classifier, op10_suffix_dedup, op11_spelling_variants, op12_decontamination, op13_prefix_trie)}


def oracle_sql():
    return {
        "op5_mixing": mixing.MIX_SQL.replace("{docs}", "documents"),
        "op11_spelling_variants": variants.VARIANTS_SQL.replace("{docs}", "documents"),
        "op12_decontamination": phrases.CONTAMINATION_SQL,
        "op13_prefix_trie": trie.TRIE_SQL.replace("{crc}", variants.CRC_SQL).replace("{h}", variants.crc_sql("conv_id::VARCHAR")),
    }
