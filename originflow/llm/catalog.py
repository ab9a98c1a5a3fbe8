"""Named queries over the corpus tables and, where SQL can state them, their DuckDB check queries."""

from __future__ import annotations

import public_tokenizers
from originflow.llm import (exact_dedup, html_text, line_dedup, mih, packing, quality, rp_forest, simhash, spelling, token_align,
                            toxicity, unigram, window_lm)
from originflow.llm.common import read_table
from pyspark.sql import functions as F

QUERIES: dict = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = sql
        return fn
    return add


@query("op5_line_dedup", line_dedup.ORACLE_SQL)
def op5_line_dedup(spark, sf_dir):
    out = line_dedup.dedup_lines(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query("op8_packing")
def op8_packing(spark, sf_dir):
    return packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep_ids=False)


@query("op3_simhash")
def op3_simhash(spark, sf_dir):
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


@query("op7_html_extraction")
def op7_html_extraction(spark, sf_dir):
    return html_text.extract(read_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@query("op4_toxicity")
def op4_toxicity(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", "held_out", "score", "predicted")


@query("op1_quality")
def op1_quality(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", "held_out", "score", "predicted")


@query("op2_embedding_dedup", rp_forest.ORACLE_SQL)
def op2_embedding_dedup(spark, sf_dir):
    return rp_forest.near_duplicates(read_table(spark, sf_dir, "embeddings"))


@query("op6_nearest_neighbours", mih.ORACLE_SQL)
def op6_nearest_neighbours(spark, sf_dir):
    return mih.search(read_table(spark, sf_dir, "embeddings"))


@query("op9_sentencepiece")
def op9_sentencepiece(spark, sf_dir):
    out = unigram.encode(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), keep_ids=False)
    return out.select("doc_id", "n_ids", "n_bytes", "ids_crc32", "round_trip")


@query("op10_masked_lm")
def op10_masked_lm(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return window_lm.score(docs, window_lm.fit(docs)).select("doc_id", "n_words", "pseudo_loglik", "mean_loglik")


@query("op11_exact_dedup", exact_dedup.ORACLE_SQL)
def op11_exact_dedup(spark, sf_dir):
    out = exact_dedup.dedup(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query("op12_token_alignment")
def op12_token_alignment(spark, sf_dir):
    return token_align.statistics(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                  public_tokenizers.path("piece_bpe_32k.model"))


@query("op13_spelling_variants", spelling.ORACLE_SQL)
def op13_spelling_variants(spark, sf_dir):
    words = spelling.word_counts(read_table(spark, sf_dir, "documents"), damage_every=97)
    return spelling.variants(words).select("word", "form", "root", "n", "n_near", "form_n")
