"""Structured Streaming over a folder: files that appear are read as frames, each file once.

An extension beyond batch reading: ``readStream.format("xyzframes").load(folder)``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSourceStreamReader

from latticelake.sources import codecs
from latticelake.sources.xyzframes import FramesReader, Range, register


class FolderStream(DataSourceStreamReader):
    """Offsets count the files of the folder in name order; new files must sort behind the old."""

    def __init__(self, options: dict[str, str]):
        self.reader = FramesReader(options)
        self.folder = options["path"]

    def initialOffset(self) -> dict:  # noqa: N802
        return {"files": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"files": len(codecs.expand(self.folder))}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return [Range(p, None) for p in codecs.expand(self.folder)[start["files"] : end["files"]]]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return self.reader.read(partition)


def stream_frames(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    register(spark)
    return spark.readStream.format("xyzframes").options(**options).load(folder)


def count_windows(frames: DataFrame, frames_per_batch: int) -> DataFrame:
    """Count-tumbling batches of each file: frames, atoms and first frame of every ``frames_per_batch`` in a row."""
    batch = F.floor(F.col("frame_index") / frames_per_batch).alias("batch_id")
    return frames.groupBy("source", batch).agg(F.count("*").alias("n_frames"), F.sum("n_atoms").alias("n_atoms"), F.min("frame_index").alias("first_frame"))
