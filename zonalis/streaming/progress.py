"""Progress of a running acquisition, recomputed as files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonalis.functions.text import percent_text


def live_progress(arrivals: DataFrame, manifest: DataFrame) -> DataFrame:
    """Percentage of files received per area, from a stream of (aoi_id, file_name).

    ``manifest`` is the static table (aoi_id, file_name) of the files to come. Only its files count,
    and each once, so the percentage ends at 100 and the state holds at most one row per manifest row.
    """
    totals = manifest.groupBy("aoi_id").agg(F.count("*").alias("total_files"))
    known = arrivals.select("aoi_id", "file_name").join(manifest.select("aoi_id", "file_name"), ["aoi_id", "file_name"])
    done = known.dropDuplicates(["aoi_id", "file_name"]).join(totals, "aoi_id").groupBy("aoi_id", "total_files").agg(
        F.count("*").alias("processed_files"))
    return done.select(
        "aoi_id", "processed_files", "total_files",
        percent_text(F.col("processed_files"), F.col("total_files")).alias("progress_text"))
