"""The scheduled refresh over files that arrived since the last run.

There is no streaming query in this suite: its freshness is a daily batch.
The file source only remembers which CSV files were loaded, so a scheduled
run reads new ones instead of the whole history. A replayed batch adds no
rows, because the load skips what the fact already holds.
"""

from tidemark.plans import load
from tidemark.sources.staging import CSV_OPTIONS, TEXT_COLUMNS, parsed
from tidemark.sources.warehouse import LOG, Warehouse, planned_bytes


def refresh(wh, inbox, checkpoint, run_by="scheduler", calendar=None):
    """Loads all new CSV files in ``inbox``, drops expired log rows, and returns when done."""

    def load_batch(batch, _batch_id):
        # A micro-batch lives in its own session.
        there = Warehouse(batch.sparkSession, wh.root, wh.buckets)
        load.run(there, parsed(batch), run_by, calendar, input_bytes=planned_bytes(batch))

    query = (
        wh.spark.readStream.schema(TEXT_COLUMNS)
        .options(**CSV_OPTIONS)
        .csv(inbox)
        .writeStream.foreachBatch(load_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    wh.forget_listings()
    if wh.get(LOG) is not None:
        load.purge_log(wh)
    return query
