"""Which load of a table is under way, and which loads are done.

Marker files in the state folder of the table: one for the load under way (there
is one writer at a time), one per finished load. They let a replayed load be
skipped, and tell after a crash which files of the table are leftovers.
"""

from __future__ import annotations

import json
import time

from pyspark.sql import Column, SparkSession, functions as F

from tidemark.storage import delete, exists, has_coarse_clock, modified_millis, read_marker, write_marker


class Journal:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self._current = f"{folder}/journal/current"
        self._finished = f"{folder}/journal/finished"

    def start(self, load_id: str, mode: str) -> None:
        write_marker(self.spark, self._current, json.dumps({"load_id": load_id, "mode": mode}))
        if has_coarse_clock(self.spark, self._current):
            time.sleep(1.1)  # files of this load get a later stamp than the marker

    def finish(self, load_id: str) -> None:
        write_marker(self.spark, f"{self._finished}/{load_id}")
        self.clear()

    def finished(self, load_id: str) -> bool:
        return exists(self.spark, f"{self._finished}/{load_id}")

    def interrupted(self) -> tuple[str | None, str | None]:
        """Mode and id of a load that was started and neither finished nor undone."""
        text = read_marker(self.spark, self._current)
        current = json.loads(text) if text else None
        if current is None or self.finished(current["load_id"]):
            return None, None
        return current["mode"], current["load_id"]

    def clear(self) -> None:
        delete(self.spark, self._current)

    def written_since(self) -> Column:
        """True for rows in files that are newer than the start of the load under
        way, by the clock of the store that stamped both."""
        millis = modified_millis(self.spark, self._current)
        return F.col("_metadata.file_modification_time") > F.timestamp_millis(F.lit(millis))
