"""The corpus pipeline: documents in, token ids out, through five of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import language_id, mixing, near_dedup, sentencepiece_codec
from tessera.llm.exact_dedup import exact_dedup, staying
from tessera.llm.shared import SPACE, staged

ORACLE_SQL = None  # the language model, the sketches and the seeded mix are not SQL; tests/llm holds brute-force versions

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language can't be told (null text or no letter) and fills in a missing lang with the predicted one.

    Whole texts are parsed, however long. Repeated rows get the same answer and all stay or all go. Columns pass as they
    are, extra ones too. Without any labelled text, documents with a letter stay and lang stays null. An empty table
    gives an empty result.
    """
    samples = language_id.learn_samples(docs)
    told = language_id.identify_language(docs, samples, carry=True)
    if samples:
        told = told.where(F.col("lang_pred") != language_id.UNKNOWN)
    else:
        told = told.where(F.col("row.text").rlike(r"\p{L}"))
    lang = F.coalesce(F.col("row.lang"), F.col("lang_pred"))
    return told.select(*(lang.alias("lang") if c == "lang" else F.col("row")[c].alias(c) for c in docs.columns))


def exactly_deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays, the one with the largest doc_id, with all its columns.

    Null counts as empty. Rows that repeat an id are told apart by their texts; of rows alike in both one stays. A null
    id never outranks another. Whole texts are compared, however long. An empty table gives an empty result.
    """
    return staying(docs, exact_dedup(docs, tell_apart=True))


def nearly_deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8 or more) one row stays, the one with the smallest doc_id, with all its columns.

    Null, empty and blank texts are like nothing and stay. Rows that repeat an id are told apart by their texts; of rows
    alike in both one stays. Whole texts are compared, however long. An empty table gives an empty result.
    """
    return staying(docs, near_dedup.near_duplicates(docs, tell_apart=True))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as documents: each whole copy is a row, and so is each range of words that the last, partial pass takes of a document.

    No row joins words across a gap. The words of a partial document keep the white space that stood before them; its n_chars is counted anew.
    """
    mix = mixing.mix_sources(docs, carry=True)
    text = F.coalesce(F.col("row.text"), F.lit(""))
    units = F.regexp_extract_all(text, F.lit(f"[{SPACE}]*[^{SPACE}]+"), F.lit(0))
    whole = F.col("pieces")[0]["from"].eqNullSafe(F.lit(0)) & (F.aggregate("pieces", F.lit(0).cast("long"), lambda a, x: a + x["to"] - x["from"]) == F.col("size"))
    rest = F.when(F.size("pieces") == 0, F.array().cast("array<string>")).when(whole, F.array(text)).otherwise(
        F.flatten(F.transform(F.array(units), lambda u: F.transform("pieces", lambda p: F.array_join(F.slice(u, (p["from"] + 1).cast("int"), (p["to"] - p["from"]).cast("int")), ""))))
    )
    out = mix.select("row", F.explode(F.concat(F.array_repeat(text, F.col("copies").cast("int")), rest)).alias("taken_text"))
    made = {"text": F.col("taken_text"), "n_chars": F.length("taken_text").cast("long")}
    return out.select(*((made[c] if c in made else F.col("row")[c]).alias(c) for c in docs.columns))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row of the mix: doc_id, n_tokens, ids, round_trip.

    A null or empty text has no ids; whole texts are encoded, however long; repeated rows are encoded each; other columns
    go. An empty table gives an empty result. The workers that served the stages before have little memory to spare.
    """
    return sentencepiece_codec.encode_texts(docs, sentencepiece_codec.model_bytes(spark), memo=120_000)


STAGES = [
    ("language_id", identified),
    ("exact_dedup", exactly_deduplicated),
    ("near_dedup", nearly_deduplicated),
    ("mixing", mixed),
    ("sentencepiece", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder and read again.

    What the stages say of nulls, repeated rows, long texts and empty tables holds; columns other than those of documents go.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
