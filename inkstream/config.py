"""Settings as plain values; making one has no side effects."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class AcquisitionConfig:
    """For fetching in front of the engine. Delays and time limits in seconds, rows a batch, tries."""

    standard_delay: float = 0.5
    node_delay: float = 2.0
    batch_rows: int = 10
    batch_pause: float = 5.0
    tries: int = 3
    list_limit: float = 15.0
    page_limit: float = 20.0
    user_agent: str = "inkstream"

    def wait(self, attempt: int) -> float:
        """Seconds before the next try after a lost connection: 1, 2, 4, ..."""
        return float(2 ** (attempt - 1))


def accelerator(spark: SparkSession) -> tuple[str, str]:
    """(device, precision) for converters: what the cluster gives each task."""
    gpus = float(spark.conf.get("spark.task.resource.gpu.amount", "0"))
    return ("cuda", "float16") if gpus > 0 else ("cpu", "float32")
