"""One query for each training-data operator, over its whole table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html, langid, lines, media, ngram_join, packing, periodic, quality, sentencepiece_bpe, simhash, sketch, toxicity, vectors

TOKENIZERS = os.environ.get("TESSELLATE_TOKENIZERS", "/opt/tokenizers")


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of three-word shingles and the components they are linked to at 3 or fewer bits."""
    return simhash.grouped(_read(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of the text decoded from them."""
    return sentencepiece_bpe.digests(_read(spark, sf_dir, "documents"), f"{TOKENIZERS}/piece_bpe_32k.model")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces with their places in sequences of at most 1024 tokens."""
    return packing.pack(_read(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json")


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as a grey image, read back, with facts and features of what was read."""
    return media.document_media(_read(spark, sf_dir, "documents"))


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of every text and its edited text, and their likeness."""
    return sketch.fingerprints(_read(spark, sf_dir, "documents"))


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers of the removed lines as text, joined by commas."""
    return lines.decisions(_read(spark, sf_dir, "documents")).withColumn("removed", F.array_join("removed", ","))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every text, learned from documents outside the held-out fold."""
    return langid.identified(_read(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of every text, learned from labels outside the held-out fold."""
    return toxicity.toxic(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade and tail probability of every text, and whether it is kept."""
    return quality.selected(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html.main_text(_read(spark, sf_dir, "pages"))


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set sizes of five-word shingles and the components linked at a Jaccard similarity of 0.8."""
    return ngram_join.joined(_read(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and errors of every vector by four codebooks of 256 entries."""
    return vectors.coded(_read(spark, sf_dir, "embeddings"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every text, some of which get a periodic end first."""
    return periodic.digests(periodic.planted(_read(spark, sf_dir, "documents")))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_packing": op3_packing,
    "op4_media": op4_media,
    "op5_fingerprint": op5_fingerprint,
    "op6_lines": op6_lines,
    "op7_langid": op7_langid,
    "op8_toxicity": op8_toxicity,
    "op9_quality": op9_quality,
    "op10_html": op10_html,
    "op11_ngram_join": op11_ngram_join,
    "op12_vector_codes": op12_vector_codes,
    "op13_periodic_runs": op13_periodic_runs,
}
ORACLE: dict[str, str] = {"op6_lines": lines.SQL, "op11_ngram_join": ngram_join.SQL, "op12_vector_codes": vectors.SQL}
