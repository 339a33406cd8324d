"""Linking a stream of queries: each micro-batch is joined with static tables; no state is kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quillspark.functions.text import query_content
from quillspark.operators.candidates import candidates, commonness
from quillspark.sources.tables import scratch, shared_table


def link_stream(queries: DataFrame, surface_forms: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, threshold: float = 0.1, kb: DataFrame | None = None) -> StreamingQuery:
    """Starts linking a stream of q_id and text; sink gets each batch's candidates and number.

    Batches are replayed with their number after a failure, so that a sink that replaces
    what it has of a number gives each result once. The tables of a batch are deleted when
    the sink returns, so it has to have computed what it keeps.
    """

    common = shared_table(surface_forms.sparkSession, commonness(surface_forms), "commonness")

    def batch(df: DataFrame, number: int) -> None:
        cleaned = df.select("q_id", query_content(df["text"]).alias("q_content"))
        with scratch(df.sparkSession):
            sink(candidates(cleaned, surface_forms, threshold, kb, common), number)

    return queries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
