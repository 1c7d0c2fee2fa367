"""Live device-memory samples: a streaming source that runs a command and gives its lines."""

from __future__ import annotations

import shlex
import subprocess
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from ..operators.monitor import samples_of_lines


class Lines(SimpleDataSourceStreamReader):
    """One run of the command each time that rows are asked for; a command that fails or hangs gives none."""

    def __init__(self, command: str, timeout: float, interval: float):
        self.command, self.timeout, self.interval = shlex.split(command), timeout, interval

    def initialOffset(self) -> dict:  # noqa: N802
        return {"run": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple[int, str]], dict]:
        if start["run"]:
            time.sleep(self.interval)
        try:
            said = subprocess.run(self.command, capture_output=True, text=True, timeout=self.timeout, check=True).stdout
        except (OSError, subprocess.SubprocessError):
            said = ""
        return iter([(start["run"], line) for line in said.splitlines() if line.strip()]), {"run": start["run"] + 1}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple[int, str]]:  # noqa: N802
        """After a failure: what a device used then can't be asked for again."""
        return iter(())


class CommandLines(DataSource):
    """Format command_lines. Options: command; timeout and interval, in seconds."""

    @classmethod
    def name(cls) -> str:
        return "command_lines"

    def schema(self) -> str:
        return "run long, value string"

    def simpleStreamReader(self, schema) -> Lines:  # noqa: N802
        return Lines(self.options["command"], float(self.options.get("timeout", "5")), float(self.options.get("interval", "0.05")))


def device_samples(spark: SparkSession, command: str = "nvidia-smi --query-gpu=index,memory.used --format=csv,noheader,nounits", interval: float = 0.05) -> DataFrame:
    """A stream of gpu_idx and used_mb from a command that prints `index, MB` lines; other lines are left out."""
    spark.dataSource.register(CommandLines)
    return samples_of_lines(spark.readStream.format("command_lines").options(command=command, interval=str(interval)).load())
