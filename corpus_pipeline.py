"""From raw documents to a training mix: five stages, each written before the next reads it."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regfleet.llm.common import freeze, table
from regfleet.llm.decontaminate import decontaminate
from regfleet.llm.jaccard_join import Threshold, jaccard_components
from regfleet.llm.line_dedup import deduplicate_lines
from regfleet.llm.mixing import mix_sources
from regfleet.llm.toxicity import fit_toxicity, toxicity_score

#: Documents with a higher score are rejected.
TOXIC = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below ``TOXIC``; learned from the table ``labels``."""
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return docs.filter(toxicity_score(spark, model) < TOXIC)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of line runs; one that is left without words goes. n_chars follows the text."""
    cut = deduplicate_lines(docs, drop_empty=True)
    length = F.when(F.col("n_removed") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", length).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 80% of its runs of five words: the smallest id (null last), then text digest.

    A document without words stays. Rows that repeat both id and text are one document stored more than once.
    """
    groups = jaccard_components(docs, width=5, threshold=Threshold(80))
    copies = groups.filter("NOT kept").select(F.col("doc_id").alias("copy_id"), F.col("digest").alias("copy_digest")).distinct()
    same = docs["doc_id"].eqNullSafe(copies["copy_id"]) & (F.xxhash64(docs["text"]) == copies["copy_digest"])
    return docs.join(copies, same, "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of ten words, or whole shorter item, of the table ``benchmark``."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes, sorted by range of the first training position."""
    mixed = mix_sources(docs).withColumn("position", F.expr("get(copies, 0).position")).drop("copies")
    return mixed.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources", mix),
]

#: The first stage is a fitted model, which SQL cannot express; tests/llm holds a plain version of the pipeline.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = freeze(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
