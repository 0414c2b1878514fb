"""A log of a run, as text lines by the standard logger and as records for a JSON report."""

from __future__ import annotations

import json
import logging
from datetime import UTC, datetime

from pyspark.sql import SparkSession


class RunLog:
    """Messages with their step and figures; `write` puts the records where the executors' files are, one JSON a line."""

    def __init__(self, name: str = "statloom") -> None:
        self.logger = logging.getLogger(name)
        self.records: list[dict[str, object]] = []

    def log(self, message: str, step: str = "", level: str = "info", **figures: object) -> None:
        self.records.append({"at": datetime.now(UTC).isoformat(timespec="seconds"), "level": level, "step": step, "message": message, **figures})
        self.logger.log(logging.getLevelName(level.upper()), "%s%s%s", f"[{step}] " if step else "", message, "".join(f" {k}={v}" for k, v in figures.items()))

    def lines(self) -> list[str]:
        return [json.dumps(r, ensure_ascii=False, default=str) for r in self.records]

    def write(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(line,) for line in self.lines()], "value string").coalesce(1).write.mode("overwrite").text(path)
