"""A corpus from raw documents to packed batches.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read back as the next one's ``docs``. All but the last keep the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.llm.near_duplicates import one_per_class
from basalt.llm.packing import packed_documents
from basalt.llm.quality import classify_documents
from basalt.llm.storage import new_folder
from basalt.llm.substring_dedup import substring_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Only documents that the classifier holds for good and not toxic.

    Null and empty texts go; rows that repeat, or share an id, are judged each
    by its own text; without labels of both kinds a head says the same of all;
    an empty table stays empty. Further columns pass through, whatever their names."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify_documents(docs, labels).where("keep").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the least id.

    A null id comes first; of rows with one id and one text one stays, other
    rows of one id stay unless a near duplicate does; null and empty texts are
    equal to each other. Ties are settled by a hash of the text."""
    return one_per_class(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that a document with a smaller id has; a text
    without such passages is unchanged.

    A null text stays null where nothing is removed from it, which is always;
    rows that share an id do not shorten each other; texts of any length are
    taken whole. ``n_chars`` is counted anew for every row whose text changed."""
    columns = docs.columns
    # by place, so that no column's name can clash with one of the result's
    names = [f"c{i}" for i in range(len(columns))]
    at = dict(zip(columns, names, strict=True))
    plain = docs.toDF(*names).withColumn("was_null", F.col(at["text"]).isNull())
    out = substring_dedup(plain, at["doc_id"], at["text"], keep=[n for n in [*names, "was_null"] if n not in (at["doc_id"], at["text"])])
    text = F.when(~F.col("was_null"), F.col("kept"))
    made = {"text": text}
    if "n_chars" in at:
        made["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(at["n_chars"]))
    return out.select(*[made.get(c, F.col(at[c])).alias(c) for c in columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's length bucket, batch and slot.

    Null and empty texts have length 0; repeated rows and shared ids are packed
    as often as they occur; an empty table gives no rows."""
    return packed_documents(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("packing", packing)]

#: The classifier, similarity classes and optimal buckets are beyond SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        folder = new_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
