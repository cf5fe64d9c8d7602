"""Pages as a stream into the versioned state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators import merge
from tidemark.plans import ingest
from tidemark.sources.snapshots import BucketedState


def ingest_tick(batch: DataFrame, state: BucketedState, empty_state: DataFrame, number: int, seen_at: str, threshold: float = 0.45, keep: int = 3) -> list[int]:
    """One batch of pages into the next version of the state; the buckets that it wrote.

    The batch's offers are looked up by the keys of the whole state, of which only those columns
    are read; rows are read, merged and written in the buckets of these offers alone.
    """
    spark, schema = batch.sparkSession, empty_state.schema
    resolved = ingest.resolve_pages(batch, state.read(spark, schema, before=number), seen_at, threshold)
    touched = state.touched(resolved, "giveaway_id")
    known = state.read(spark, schema, before=number, only=touched)
    written = state.write(merge.merge_crawl(known, resolved), number, touched)
    state.drop_old(spark, keep)
    return written


def stream_ingest(pages: DataFrame, empty_state: DataFrame, state: BucketedState, checkpoint: str, seen_at: str, threshold: float = 0.45, once: bool = True, keep: int = 3) -> StreamingQuery:
    """Each micro-batch of pages makes the next version of the state.

    Batch n starts from the latest version below n and makes version n, so a batch that is run again
    after a failure replaces its own version and nothing else; ``keep`` versions stay. ``empty_state``
    gives the schema. With ``once`` the stream stops when it has taken what is there; how much a
    tick takes is the reader's ``maxFilesPerTrigger``.
    """

    def step(batch: DataFrame, number: int) -> None:
        ingest_tick(batch, state, empty_state, number, seen_at, threshold, keep)

    writer = pages.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
