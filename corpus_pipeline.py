"""A training corpus from raw documents: five stages, each on all that its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet to the
shared folder and read again before the next one. Rows are told apart by a hash of their values,
so that repeated and missing ids do no harm; rows that are alike in every value count as copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from assetlake.llm.common import broadcast_if_small, discard, scratch, settled
from assetlake.llm.decontaminate import decontaminate
from assetlake.llm.language_id import UNKNOWN, label_language
from assetlake.llm.mixing import mix_batches
from assetlake.llm.ngram_join import ngram_join
from assetlake.llm.suffix_dedup import remove_repeats
from assetlake.plans.session import new_shared_path, read_table, ship_package

#: Language labels and removed passages cannot be written in SQL; tests/llm has brute force.
ORACLE_SQL = None
KEY = "pipeline_row_key"


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn(KEY, F.xxhash64("doc_id", "text", "lang", "source", "n_chars"))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of `_keyed` whose key is not in `gone`, which has the key alone."""
    return docs.join(broadcast_if_small(gone), KEY, "left_anti")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out documents without a language: null or empty texts, and texts without letters.

    Where no language could be learnt, texts with letters stay.
    """
    ship_package(spark)
    keyed = _keyed(docs)
    labelled = label_language(keyed.select(F.col(KEY).alias("asset_id"), "text", "lang"))
    unknown = labelled.filter(F.col("lang_pred") == UNKNOWN).select(F.col("asset_id").alias(KEY))
    gone = broadcast_if_small(settled(unknown.distinct(), "unknown-language")).alias("gone")
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return keyed.join(gone, (keyed[KEY] == F.col(f"gone.{KEY}")) & ~letters, "left_anti").select(
        docs.columns
    )


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near copies.

    Shingles of five words, similarity 0.8 or more. Of rows alike in every value one stays.
    """
    ship_package(spark)
    keyed = _keyed(docs)
    with scratch(spark):
        joined = ngram_join(keyed.select(F.col(KEY).alias("asset_id"), "text"))
        groups = joined.select(F.col("asset_id").alias(KEY), "component_id")
        groups = settled(groups, "groups", keep=True)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", KEY))
    best = (
        groups.join(keyed.select(KEY, "doc_id"), KEY)
        .groupBy("component_id")
        .agg(first[KEY].alias("best"))
    )
    others = groups.join(best, "component_id").filter(F.col(KEY) != F.col("best"))
    repeated = groups.groupBy(KEY).agg(F.count("*").alias("n")).filter("n > 1").select(KEY)
    repeated = settled(repeated, "repeated-rows")
    kept = _without(keyed, settled(others.select(KEY).distinct(), "near-copies"))
    single = _without(kept, repeated)
    one = kept.join(broadcast_if_small(repeated), KEY, "left_semi").dropDuplicates([KEY])
    return single.unionByName(one).select(docs.columns)


def _whole_characters(kept: Column, spans: Column) -> Column:
    """What is left of a text, without the characters that the borders of removed spans split."""
    bounds = F.aggregate(
        spans,
        F.struct(F.array(F.lit(0).cast("long")).alias("at"), F.lit(0).cast("long").alias("gone")),
        lambda a, s: F.struct(
            F.concat(a["at"], F.array(s["start"] - a["gone"])).alias("at"),
            (a["gone"] + s["length"]).alias("gone"),
        ),
    )["at"]
    ends = F.concat(F.slice(bounds, 2, F.size(spans)), F.array(F.octet_length(kept).cast("long")))
    last = F.size(spans)

    def piece(a: Column, i: Column) -> Column:
        # one character a byte, so that a pattern can name bytes
        size = (F.element_at(ends, i + 1) - a).cast("int")
        text = F.decode(F.substring(kept, (a + 1).cast("int"), size), "ISO-8859-1")
        text = F.when(i > 0, F.regexp_replace(text, r"^[\x80-\xBF]{1,3}", "")).otherwise(text)
        split = r"(?:[\xC2-\xDF]|[\xE0-\xEF][\x80-\xBF]?|[\xF0-\xF4][\x80-\xBF]{0,2})\z"
        text = F.when(i < last, F.regexp_replace(text, split, "")).otherwise(text)
        return text

    left = F.array_join(F.transform(bounds, piece), "")
    return F.encode(left, "ISO-8859-1").cast("string")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 50 bytes or more that a document with a smaller id has too.

    Where a cut falls inside a character, what is left of it goes as well. Documents stay, even
    if nothing is left of their text.
    """
    ship_package(spark)
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    none = F.col("text").isNull().alias("no_text")
    whole = docs.select(
        F.col("doc_id").alias("asset_id"),
        "text",
        F.struct(none, F.struct(none, *others).alias("others")).alias("document"),
    )
    cut = remove_repeats(whole, carry=["document"])
    left = _whole_characters(F.col("kept"), F.col("spans"))
    text = F.when(F.col("n_removed") > 0, left).when(
        ~F.col("carried.document.no_text"), F.col("kept").cast("string")
    )
    return cut.select(
        F.col("asset_id").alias("doc_id"),
        text.alias("text"),
        *(F.col("carried.document.others")[c].alias(c) for c in others),
    ).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out documents that hold a window of a benchmark item."""
    keyed = _keyed(docs)
    items = read_table(spark, sf_dir, "benchmark")
    with scratch(spark):
        found = decontaminate(keyed.select(F.col(KEY).alias("asset_id"), "text"), items)
        gone = found.filter("n_hit > 0").select(F.col("asset_id").alias(KEY)).distinct()
        gone = settled(gone, "contaminated", keep=True)
    return _without(keyed, gone).select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add to each document how many of its words the mix of sources takes."""
    keyed = _keyed(docs)
    mixed = mix_batches(
        keyed.select(F.col(KEY).alias("asset_id"), F.col("source").alias("batch_id"), "text")
    ).select(
        F.col("asset_id").alias(KEY),
        F.col("size").alias("n_words"),
        "source_size",
        "target",
        "rate",
        "taken",
    )
    return keyed.join(mixed.dropDuplicates([KEY]), KEY).drop(KEY)


STAGES = [
    ("language_id", language),
    ("ngram_join", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("decontamination", decontamination),
    ("mixing", mixture),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = new_shared_path(spark, name)
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            discard(spark, before)
        before = path
    _, last = STAGES[-1]
    return last(spark, docs, sf_dir)


def query(spark: SparkSession, sf: str) -> DataFrame:
    return run(spark, sf)
