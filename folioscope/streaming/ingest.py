"""An extension: lexical documents of articles that arrive in a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from folioscope.operators.dimensions import build_dimension_texts
from folioscope.operators.lexical import build_lexical_documents


def lexical_stream(articles: DataFrame, watermark: str | None = None, event_time: str = "ts") -> DataFrame:
    """Lexical documents of a stream of articles; with a watermark, each (article, content) once."""
    if watermark:
        articles = articles.withWatermark(event_time, watermark).dropDuplicatesWithinWatermark(["article_id", "content_hash"])
    return build_lexical_documents(build_dimension_texts(articles))


def append_stream(documents: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Runs over what is there and appends it, partitioned by dimension."""
    return (
        documents.writeStream.format("parquet")
        .partitionBy("dimension")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )
