"""Structured Streaming into a keyed table: the last write of each key wins, within a batch and across batches."""

from __future__ import annotations

import json
import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.core import last_of_each, overwrite


class Table:
    """Generations of Parquet below a folder with a pointer to the current one; a batch that ran already is not run again."""

    def __init__(self, path: str, key: str, order: str) -> None:
        self.path, self.key, self.order = Path(path), key, order
        self.path.mkdir(parents=True, exist_ok=True)

    def state(self) -> dict | None:
        pointer = self.path / "CURRENT"
        return json.loads(pointer.read_text()) if pointer.exists() else None

    def read(self, spark) -> DataFrame | None:
        state = self.state()
        return spark.read.parquet(str(self.path / state["generation"])) if state else None

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        state = self.state()
        if state and state["batch"] >= batch_id:  # the batch is being replayed
            return
        new = last_of_each(batch, self.key, F.desc(self.order))
        old = self.read(batch.sparkSession)
        name = f"generation-{batch_id}-{uuid.uuid4().hex[:8]}"
        (new if old is None else overwrite(old, new, self.key)).write.parquet(str(self.path / name))
        part = self.path / f".current-{uuid.uuid4().hex}"
        part.write_text(json.dumps({"generation": name, "batch": batch_id}))
        os.replace(part, self.path / "CURRENT")


def upsert_stream(source: DataFrame, table: Table, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Start the stream; a trigger of so many seconds stands for a commit deadline, ``availableNow`` drains it."""
    return source.writeStream.foreachBatch(table.apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
