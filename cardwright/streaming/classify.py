"""Classification of documents as they arrive; the same plan as for a table, as no state is kept."""

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cardwright.operators.classify import Rules, classify


def classify_stream(docs: DataFrame, text: str = "text", table: Rules | None = None) -> DataFrame:
    return classify(docs, {"source_text": (F.col(text), 1)}, table)


def counts_by_window(classified: DataFrame, time: str, width: str, late: str) -> DataFrame:
    """(window, model_type, n): documents of each type in windows of ``width``; rows later than ``late`` are not waited for."""
    return classified.withWatermark(time, late).groupBy(F.window(time, width), "model_type").agg(F.count("*").alias("n"))


def write_stream(df: DataFrame, path: str, checkpoint: str, options: Mapping[str, str] | None = None) -> StreamingQuery:
    """Append all that is there to Parquet at ``path``, once."""
    return df.writeStream.format("parquet").options(**(options or {})).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
