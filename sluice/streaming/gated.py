"""The gate over a stream: each micro-batch is an extract of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sluice.plans.gate import Gate
from sluice.sources.positions import with_positions
from sluice.sources.readers import Source


def gate_stream(
    stream: DataFrame, gate: Gate, name: str, checkpoint: str, detail: bool = True, **trigger
) -> StreamingQuery:
    """Publish or hold every micro-batch.

    The run id comes from the stream's own id, which its checkpoint keeps, and the batch
    id. A batch whose run is already recorded is skipped, so one that is replayed after a
    failure is neither lost nor doubled, and another stream of the same name is another.
    """

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        stream_id = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        run_id = f"{name}-{stream_id}-{batch_id:09d}"
        done = gate.store.records("runs").filter(F.col("run_id") == run_id)
        if done.isEmpty() and not batch.isEmpty():
            gate.run_table(with_positions(batch), Source("stream", checkpoint, name=name), run_id, detail)

    writer = stream.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
