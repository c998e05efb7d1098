"""Turns as a stream: cleaned row by row, appended as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from callweave.functions.lexicon import DEFAULT, Lexicon
from callweave.operators.transcripts import clean_turns, process
from callweave.sources.tables import append_results


def append_cleaned(turns: DataFrame, out: str, checkpoint: str, lexicon: Lexicon = DEFAULT) -> StreamingQuery:
    """Append the cleaned turns of a streaming ``turns`` to Parquet at ``out``; what is there is taken, then the query ends."""
    return clean_turns(turns, lexicon).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_processed(items: DataFrame, path: str, checkpoint: str, name: str, lexicon: Lexicon = DEFAULT) -> StreamingQuery:
    """Process a stream of transcripts into the result table at ``path``, a micro-batch at a time; what is there is taken, then the query ends.

    A micro-batch's key is ``name`` and its number, so one that is run again after a failure adds nothing twice.
    """
    return items.writeStream.foreachBatch(lambda rows, i: append_results(process(rows, lexicon), path, f"{name}-{i:012d}") and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, ts_col: str = "ts", key_col: str = "event_type", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by tumbling window and key, of a stream (late rows up to ``late`` count) or a table."""
    rows = events.withWatermark(ts_col, late) if events.isStreaming else events
    counted = rows.groupBy(F.window(ts_col, window).alias("w"), key_col).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), key_col, "n")
