"""Detected cells as they arrive: every page's text, kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from dotframe.operators.layout import page_text

BUCKETS = 64


def read_cells(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def write_page_text(cells: DataFrame, out: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Keeps the cells of each batch under out/cells/batch=N by buckets of
    pages, and writes the text of every page that the batch touches, from all
    its cells so far, under out/text/batch=N. So pages may come in parts and
    late. A batch that runs again after a failure overwrites its own folders and
    sees no later one."""

    def batch(df: DataFrame, n: int) -> None:
        spark = df.sparkSession
        place = F.pmod(F.xxhash64("page_id"), F.lit(buckets)).cast("int")
        df.withColumn("bucket", place).write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/cells/batch={n}")
        new = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(f"{out}/cells/batch={n}")
        touched = [r[0] for r in new.select("bucket").distinct().collect()]  # at most ``buckets``
        before = spark.read.schema(T.StructType([*df.schema.fields, *[T.StructField(k, T.IntegerType()) for k in ("batch", "bucket")]])).parquet(f"{out}/cells")
        so_far = before.where((F.col("batch") <= n) & F.col("bucket").isin(touched)).drop("batch", "bucket")
        pages = new.select("page_id").distinct()
        page_text(so_far.join(pages, "page_id", "left_semi")).write.mode("overwrite").parquet(f"{out}/text/batch={n}")

    return cells.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_text(spark: SparkSession, out: str) -> DataFrame:
    """(page_id, text): of each page the text of the last batch that touched it."""
    texts = spark.read.parquet(f"{out}/text")
    return texts.groupBy("page_id").agg(F.max_by("text", "batch").alias("text"))
