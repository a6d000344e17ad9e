"""Chunking of articles as they arrive; the filters and windows are stateless and the same as in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from granary import schemas
from granary.operators.chunking import fixed_chunks
from granary.plans.ingest import filter_corpus


def article_stream(spark: SparkSession, path: str) -> DataFrame:
    """New parquet files of articles under ``path``."""
    return spark.readStream.schema(schemas.ARTICLE).parquet(path)


def write_chunks(articles: DataFrame, path: str, checkpoint: str, size: int = 512, overlap: int = 50, filtered: bool = True) -> StreamingQuery:
    """Appends the chunks of each article once; takes what there is and ends."""
    rows = filter_corpus(articles) if filtered else articles
    chunks = fixed_chunks(rows, size, overlap, id_col="id", carry=["title", "url", "source_category"])
    out = chunks.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return out.outputMode("append").trigger(availableNow=True).start()
