"""A change feed over a stream of snapshot rows.

``follow`` keeps a snapshot store up to date from a stream of record versions
(micro-batches of rows of the record schema, with ``deleted`` marking removals)
and hands each batch's changes to a callback.  The state is the store itself:
each batch joins it once, and a version is labelled with the stream's
checkpoint and batch.  A batch that is run again after a failure or a restart
finds its version stored and only tells its changes again; one before that
does nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.changes import snapshot_diff
from ..records import META, Records
from ..sources.snapshot import SnapshotStore


def merged(old: DataFrame, batch: DataFrame) -> DataFrame:
    """The next snapshot: a path's latest row in the batch replaces the old one; deleted paths go."""
    latest = Window.partitionBy("path").orderBy(F.col("mtime").desc_nulls_last(), F.col("revision").desc_nulls_last())
    last = batch.withColumn("__rn", F.row_number().over(latest)).where("__rn = 1")
    kept = old.join(last.select(F.col("path").alias("__p")), F.col("path") == F.col("__p"), "left_anti")
    return kept.select(*META).unionByName(last.where(~F.coalesce("deleted", F.lit(False))).select(*META))


def follow(stream: DataFrame, store: SnapshotStore, on_changes: Callable[[DataFrame, int], None], checkpoint: str):
    """A started streaming query; ``on_changes(changes, batch_id)`` runs for every batch, at least once."""

    def applied() -> tuple[int, int]:
        """(version, batch) of this stream's latest batch in the store."""
        for version in range(store.version(), 0, -1):
            of, _, batch = (store.label(version) or "").rpartition("#")
            if of == checkpoint and batch.isdigit():
                return version, int(batch)
        return 0, -1

    def apply(batch: DataFrame, batch_id: int) -> None:
        version, last = applied()
        if last > batch_id:
            return
        if last < batch_id:
            present = store.version()
            base = store.read().df if present else batch.sparkSession.createDataFrame([], batch.select(*META).schema)
            version = store.commit(merged(base, batch), based_on=present, label=f"{checkpoint}#{batch_id}")
        new = store.read(version)
        old = store.read(version - 1) if version > 1 else Records(new.df.limit(0))
        on_changes(snapshot_diff(old, new), batch_id)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).start()
