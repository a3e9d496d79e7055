"""Session profiles: local for tests, elastic for clusters."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: What every query relies on: UTC dates, adaptive plans, Arrow transfer.
BASE = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # The JVM doesn't compile methods of more than 8,000 bytes: such a stage is better generated operator by operator.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g", app: str = "furrow") -> SparkSession:
    """A session in this process, as tests and the bench use it."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app).config(map=BASE)
    b = b.config("spark.sql.shuffle.partitions", shuffle_partitions).config("spark.driver.memory", memory)
    return b.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def cluster_profile(
    processes: int = 1,
    threads: int = 2,
    memory_gb: float = 2.5,
    jobs: int = 16,
    wait_proportion: float = 0.5,
    wait_timeout_s: int = 120,
) -> dict[str, str]:
    """Spark settings for an elastic cluster: up to twice ``jobs`` executors of ``processes * threads``
    cores and ``memory_gb`` a thread, scheduling once ``wait_proportion`` of them have registered
    or ``wait_timeout_s`` have passed."""
    if not 0 <= wait_proportion <= 1:
        raise ValueError("wait_proportion lies between 0 and 1")
    cores = processes * threads
    return BASE | {
        "spark.executor.cores": str(cores),
        "spark.executor.memory": f"{int(memory_gb * cores * 1024)}m",
        "spark.dynamicAllocation.enabled": "true",
        "spark.dynamicAllocation.shuffleTracking.enabled": "true",
        "spark.dynamicAllocation.minExecutors": "0",
        "spark.dynamicAllocation.maxExecutors": str(2 * jobs),
        "spark.scheduler.minRegisteredResourcesRatio": str(wait_proportion),
        "spark.scheduler.maxRegisteredResourcesWaitingTime": f"{wait_timeout_s}s",
    }


def storage_profile(max_retries: int = 5, retry_delay_s: int = 2, requester_pays: bool = False) -> dict[str, str]:
    """Executor settings for reading objects over the network; credentials come from the cluster's
    provider chain and are never written to files."""
    conf = {
        "spark.hadoop.fs.s3a.attempts.maximum": str(max_retries),
        "spark.hadoop.fs.s3a.retry.interval": f"{retry_delay_s}s",
    }
    return conf | ({"spark.hadoop.fs.s3a.requester.pays.enabled": "true"} if requester_pays else {})
