"""Datasets: folders of files that tasks write and the driver only renames into place."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame

from ..sources import storage


class Publication:
    """Files of one write to a folder. Their names sort after those of earlier writes, and among themselves by number."""

    def __init__(self, path: str):
        self.path, self.run, self.began = path, uuid.uuid4().hex, time.time_ns() // 1_000_000

    def part(self, number: int) -> str:
        """Where a task writes file ``number``; a task that runs again replaces the file as a whole."""
        return f"{self.path}.parts-{self.run}/{number:08d}.fits"

    def publish(self, written: DataFrame, files: int | None = None) -> None:
        """written: a row with the path of each file, ``files`` in all. They appear in the folder once all are written."""
        names = sorted(r["path"] for r in written.collect())  # a name for each file
        if files is not None and len(names) != files:
            storage.remove_folder(f"{self.path}.parts-{self.run}")
            raise ValueError(f"{files - len(names)} of {files} files have no data")
        for r in names:
            storage.move(r, f"{self.path}/part-{self.began:014d}-{self.run[:8]}-{r.rpartition('/')[2]}")
        storage.remove_folder(f"{self.path}.parts-{self.run}")
