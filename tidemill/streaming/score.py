"""Message-at-a-time scoring: the batch expressions over a stream, and deduplication within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T
from ..functions.features import keyword_score
from ..vocabulary import KEYWORDS


def scored(stream: DataFrame, threshold: float, text: str = "text") -> DataFrame:
    """Score and flag of each message; works on batches and streams alike."""
    p = keyword_score(F.col(text)) / len(KEYWORDS)
    return stream.withColumn("prob", p).withColumn("flagged", (F.col("prob") >= threshold).cast("int"))


def first_of_template(stream: DataFrame, at: str, delay: str, text: str = "text") -> DataFrame:
    """The first message of each template within the watermark; later ones are dropped, state expires."""
    return stream.withColumn("template", T.template_key(F.col(text))).withWatermark(at, delay).dropDuplicatesWithinWatermark(["template"])


def run_once(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes what is available now to Parquet, exactly once, and stops."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
