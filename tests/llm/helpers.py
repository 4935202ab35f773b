from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_tokens", T.StringType()), T.StructField("spans", T.StringType())])


def docs(spark, texts, ids=None):
    """Documents with extra columns whose names clash with results."""
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "x", None) for i, t in zip(ids, texts)], DOCS)


def write_docs(spark, tmp_path, texts, ids=None):
    docs(spark, texts, ids).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)
