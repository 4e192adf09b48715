"""Incremental maintenance of the index, its version, the source registry and the download manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sync_actions(incoming: DataFrame, index: DataFrame) -> DataFrame:
    """``chunk_id, doc_id, action`` for chunks of the documents in ``incoming``.

    Actions: embed (new or other hash), status (same hash, other status), skip, delete (gone from its
    document). Documents absent from the batch are untouched.
    """
    touched = index.join(incoming.select("doc_id").distinct(), "doc_id", "left_semi")
    old = touched.select("chunk_id", F.col("doc_id").alias("old_doc"), F.col("content_hash").alias("old_hash"), F.col("status").alias("old_status"))
    both = incoming.select("chunk_id", "doc_id", "content_hash", "status").join(old, "chunk_id", "full_outer")
    action = (
        F.when(F.col("doc_id").isNull(), "delete")
        .when(~F.col("old_hash").eqNullSafe(F.col("content_hash")), "embed")
        .when(~F.col("old_status").eqNullSafe(F.col("status")), "status")
        .otherwise("skip")
    )
    return both.select("chunk_id", F.coalesce("doc_id", "old_doc").alias("doc_id"), action.alias("action"))


def apply_sync(incoming: DataFrame, index: DataFrame) -> DataFrame:
    """The index after the batch: untouched documents, incoming chunks, nothing deleted left over."""
    kept = index.join(incoming.select("doc_id").distinct(), "doc_id", "left_anti")
    return kept.unionByName(incoming.select(*kept.columns))


def _digest(batches):
    import hashlib

    import pyarrow as pa

    sha, first = hashlib.sha256(), True
    for batch in batches:
        for line in batch.column(0).to_pylist():
            if line is not None:
                sha.update((line if first else "\n" + line).encode())
                first = False
    yield pa.RecordBatch.from_arrays([pa.array([sha.hexdigest()])], names=["version"])


def index_version(index: DataFrame) -> DataFrame:
    """``version``: SHA-256 of the sorted ``id:hash`` lines of active chunks; that of the empty text if there are none.

    The hash of one text needs its lines in order, so one task reads them, about 100 bytes per chunk: a
    sort that spills, then a hash that takes line by line, in memory that does not grow.
    """
    lines = index.where("status = 'active'").select(F.concat_ws(":", "chunk_id", "content_hash").alias("x"))
    none = index.sparkSession.range(1).select(F.lit(None).cast("string").alias("x"))  # so that there is a row to read
    return lines.union(none).repartition(1).sortWithinPartitions("x").mapInArrow(_digest, "version string")


def apply_supersede(sources: DataFrame) -> DataFrame:
    """Sources with status: of each (body, competition, gender, doc_type) the greatest effective_from is active, the first of equals.

    ``sources`` has an ``ord`` column with the input order. effective_from compares as a string.
    """
    w = Window.partitionBy("body", "competition", "gender", "doc_type").orderBy(F.desc("effective_from"), "ord")
    return sources.withColumn("status", F.when(F.row_number().over(w) == 1, "active").otherwise("superseded"))


def merge_sources(existing: DataFrame, discovered: DataFrame) -> DataFrame:
    """``doc_id, title, url, manual, change``: the registry after a discovery run.

    ``discovered`` has an ``ord``; the first row of a doc_id counts. New ids are added; of entries
    that are not manual an other url refreshes url and title; all else is kept.
    """
    w = Window.partitionBy("doc_id").orderBy("ord")
    first = discovered.withColumn("n", F.row_number().over(w)).where("n = 1").select("doc_id", F.col("title").alias("new_title"), F.col("url").alias("new_url"), F.lit(True).alias("found"))
    both = existing.select("doc_id", "title", "url", "manual", F.lit(True).alias("known")).join(first, "doc_id", "full_outer")
    refresh = F.col("known") & F.col("found") & ~F.coalesce("manual", F.lit(False)) & ~F.col("url").eqNullSafe(F.col("new_url"))
    change = F.when(F.col("known").isNull(), "added").when(refresh, "refreshed").otherwise("kept")
    new = F.col("change") != "kept"
    return both.withColumn("change", change).select("doc_id", F.when(new, F.col("new_title")).otherwise(F.col("title")).alias("title"), F.when(new, F.col("new_url")).otherwise(F.col("url")).alias("url"), F.coalesce("manual", F.lit(False)).alias("manual"), "change")


def manifest_changes(manifest: DataFrame) -> DataFrame:
    """``url, doc_id, sha256, n_downloads, changed``: the latest download of each url and whether its hash differs from the one before.

    A first download counts as changed. Times compare as instants: a zone mark Z, an offset or none
    (UTC) are alike; ties go by hash. Repeated rows count once.
    """
    rows = manifest.select("url", "doc_id", "sha256", F.to_timestamp(F.regexp_replace("downloaded_at", r"(Z|[+-]\d{2}:\d{2})?$", "")).alias("at")).where("url is not null").distinct()
    w = Window.partitionBy("url").orderBy("at", "sha256", "doc_id")
    last = Window.partitionBy("url").orderBy(F.desc("at"), F.desc("sha256"), F.desc("doc_id"))
    rows = rows.withColumn("before", F.lag("sha256").over(w)).withColumn("n", F.row_number().over(last)).withColumn("n_downloads", F.count("*").over(Window.partitionBy("url")))
    return rows.where("n = 1").select("url", "doc_id", "sha256", "n_downloads", F.coalesce(~F.col("sha256").eqNullSafe(F.col("before")), F.lit(True)).alias("changed"))
