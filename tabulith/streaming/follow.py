"""Following a table: the files that snapshots added, processed once each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulith.operators.incremental import IncrementalRuns
from tabulith.plans.scan import ScanError, SnapshotTable
from tabulith.sources.manifests import ADDED, DATA, read_entries, read_lists


def appended_files(table: SnapshotTable, after: int | None = None, until: int | None = None) -> DataFrame:
    """Entries that the snapshots after ``after`` (exclusive; None: from the first) up to ``until`` (the current one) added.
    ``after`` must be an ancestor of ``until``.

    Read from the manifests that each of these snapshots added itself: later ones may rewrite manifests, which makes the entries existing ones there.
    Snapshots of the operation ``replace`` put the same rows into other files and add none.
    """
    m = table.metadata
    s = m.snapshot(until) if until is not None else m.current_snapshot
    line = []
    while s is not None and s.snapshot_id != after:
        line.append(s)
        s = m.snapshot(s.parent_id)
    if after is not None and s is None:
        raise ScanError(f"snapshot {after} is no ancestor")
    adding = [(x.snapshot_id, x.manifest_list) for x in line if x.manifest_list and not (x.summary and x.summary.operation == "replace")]
    own = table.spark.createDataFrame(adding, "_snap bigint, _list string")
    rows = read_lists(table.spark, [x for _, x in adding], table.props)
    # a manifest whose snapshot is unknown (format 1) may be any's; its entries tell
    rows = rows.join(F.broadcast(own), (F.col("manifest_list") == F.col("_list")) & F.coalesce(F.col("added_snapshot_id") == F.col("_snap"), F.lit(True)), "left_semi")
    e = read_entries(rows.drop("manifest_list"), table.props)
    return e.where((F.col("status") == ADDED) & (F.col("content") == DATA) & F.col("snapshot_id").isin([i for i, _ in adding] or [-1]))


def follow(table: SnapshotTable, state: str, process: Callable[[DataFrame], DataFrame]) -> int:
    """Process each added file once: ``process`` gets the entries that no published run has seen. Returns the run's number; a run that
    failed leaves no trace, and the next one sees its files again."""
    runs = IncrementalRuns(table.spark, state, ["file_path"], ["record_count", "file_size_in_bytes", "sequence_number"])
    files = appended_files(table).select("file_path", "file_format", "record_count", "file_size_in_bytes", "sequence_number", "snapshot_id")
    return runs.run(files, process)
