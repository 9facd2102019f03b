"""Queries ``opN_<name>`` of the operators, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import chunk_dedup, collocations, jaccard, lattice, lm_score, merkle, mixing, quality, sentencepiece_codec, suffix_dedup, token_counts, topk, warc
from .common import documents

PIECES = "piece_bpe_32k.model"


def embeddings(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet")


def op1_suffix_dedup(spark, sf_dir):
    return suffix_dedup.digests(suffix_dedup.repeated_spans(documents(spark, sf_dir)))


def op2_lattice(spark, sf_dir):
    return lattice.near_duplicates(embeddings(spark, sf_dir), threshold=0.9)


def op5_chunk_dedup(spark, sf_dir):
    return chunk_dedup.digests(chunk_dedup.repeated_chunks(documents(spark, sf_dir)))


def op3_sentencepiece(spark, sf_dir):
    return sentencepiece_codec.digests(sentencepiece_codec.encode_decode(documents(spark, sf_dir), public_tokenizers.path(PIECES)))


def op6_token_counts(spark, sf_dir):
    return token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path(PIECES))


def op7_mixing(spark, sf_dir):
    return mixing.mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op8_topk(spark, sf_dir):
    v = topk.quantised(embeddings(spark, sf_dir))
    return topk.top_k(v, v.where(F.col("vec_id") % 100 == 0), k=10)


def op9_jaccard(spark, sf_dir):
    return jaccard.jaccard_components(documents(spark, sf_dir), k=3, num=90, den=100)


def op10_lm_score(spark, sf_dir):
    return lm_score.lm_scores(documents(spark, sf_dir))


def op4_quality(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return quality.quality(documents(spark, sf_dir), labels, keep=["doc_id", "lang"])


def op11_merkle(spark, sf_dir):
    return merkle.audit(merkle.manifest(merkle.tampered(documents(spark, sf_dir)), keep=("now",)))


def op12_warc(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir.rstrip('/')}/pages.parquet")
    index = warc.write_archives(pages, warc.archive_folder(spark), least=0)
    return warc.read_archives(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_collocations(spark, sf_dir):
    return collocations.collocations(documents(spark, sf_dir), least=100, longest=5, top=2000)


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_lattice": op2_lattice,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_quality": op4_quality,
    "op5_chunk_dedup": op5_chunk_dedup,
    "op6_token_counts": op6_token_counts,
    "op7_mixing": op7_mixing,
    "op8_topk": op8_topk,
    "op9_jaccard": op9_jaccard,
    "op10_lm_score": op10_lm_score,
    "op11_merkle": op11_merkle,
    "op12_warc": op12_warc,
    "op13_collocations": op13_collocations,
}

ORACLE = {
    "op7_mixing": mixing.ORACLE_SQL,
    "op8_topk": topk.ORACLE_SQL,
    "op9_jaccard": jaccard.ORACLE_SQL,
    "op11_merkle": merkle.ORACLE_SQL,
    "op12_warc": warc.ORACLE_SQL,
    "op13_collocations": collocations.ORACLE_SQL,
}
