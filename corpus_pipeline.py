"""The corpus pipeline: stages in order, each over all that its predecessor kept.

Rejected by the quality classifier: dropped.  Near-duplicate groups: the smallest id stays.  Passages of
benchmark items: cut out; a document of which more than half is such passages goes.  Personal data:
replaced by its kind.  The last stage encodes with byte-level BPE, decodes, and returns the digests.

Every stage reads whole texts and keeps the table's other columns, whatever their names.  Null texts pass
unchanged where they are kept; ``n_chars`` follows the text.  Of repeated rows with words the second stage
keeps one; each other stage has a row for each.  Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.byte_bpe import round_trip
from tidewatch.llm.decontaminate import decontaminate
from tidewatch.llm.jaccard import JaccardJoin
from tidewatch.llm.pii import mask
from tidewatch.llm.quality import fit_quality, learns, score_quality
from tidewatch.llm.texts import map_texts
from tidewatch.runtime import cut

KEEP_FROM = 0.7


def _tagged(docs: DataFrame) -> DataFrame:
    """Each row's text beside one value that holds the other columns and whether there is a text."""
    rest = F.struct(*[c for c in docs.columns if c != "text"])
    return docs.select(F.struct(rest.alias("rest"), docs["text"].isNull().alias("none")).alias("_row"), docs["text"].alias("_body"))


def _rows(found: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """The columns of documents again, with a text."""
    return found.select(*[F.when(~F.col("_row.none"), F.col(text)).alias(c) if c == "text" else F.col(f"_row.rest.{c}").alias(c) for c in columns])


def _renewed(found: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """The same with a new text; the length follows it."""
    rows = _rows(found, text, columns)
    if "n_chars" not in columns:
        return rows
    return rows.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), learns)
    scored = score_quality(_tagged(docs), model, "_row", "_body", text_as="_body")
    return _rows(scored.where(F.col("score") >= KEEP_FROM), "_body", docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    join = JaccardJoin(docs)
    found = cut(join.run(), "found")
    # of each group the least id stays (null is the greatest), of rows with that id the one with the least digest
    least = found.where("n > 0").groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("k"))
    least = cut(least, "least")  # a written table, not an aggregate: so Spark can split the rows of a very large group
    lost = found.where("n > 0").join(least, "label").where(~(F.col("id").eqNullSafe(F.col("k.id")) & (F.col("key") == F.col("k.key"))))
    lost = lost.select(F.col("id").alias("_id"), F.col("key").alias("_lost")).distinct()
    keyed = join.keyed(_tagged(docs))
    kept = keyed.join(lost, F.col("_row.rest.doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_lost")), "left_anti")
    if not found.where("n > 0").groupBy("id", "key").count().where("count > 1").isEmpty():  # whole rows repeat
        empty = F.col("_n") == 0
        kept = kept.where(empty).unionByName(kept.where(~empty).withColumn("_doc", F.col("_row.rest.doc_id")).dropDuplicates(["_doc", "_key"]).drop("_doc"))
    return _rows(kept, "_body", docs.columns)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate(_tagged(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="_row", text_col="_body")
    return _renewed(found, "text", docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = map_texts(_tagged(docs), lambda texts: [[mask(x) for x in texts]], [T.StructField("masked", T.StringType())], "_row", "_body")
    return _renewed(found, "masked", docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


STAGES = [("quality", quality), ("jaccard", one_of_each_group), ("decontamination", benchmark_passages), ("pii", personal_data), ("byte_bpe", byte_bpe)]
ORACLE_SQL = None  # a fitted classifier and a tokenizer have no SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
