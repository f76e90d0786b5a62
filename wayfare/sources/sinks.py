"""Writers for cases, results and prompts (SNK-4..6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_cases(cases: DataFrame, path: str) -> None:
    """SNK-4: the case table as JSON lines (nested ``expected`` kept)."""
    cases.write.mode("overwrite").json(path)


def write_results(scored: DataFrame, summary: DataFrame, path: str, run_label: str) -> None:
    """SNK-5: per-case results and a one-row summary, partitioned by run; a
    run that is written again replaces its own.

    The reference's environment-gated extra copies become ``run_label``
    partitions (``baseline``, ``thinking``, ...), so runs sit side by side.
    """
    for rows, name, fmt in ((scored, "results", "parquet"), (summary, "summary", "json")):
        (rows.withColumn("run_label", F.lit(run_label)).write.mode("overwrite").partitionBy("run_label")
         .option("partitionOverwriteMode", "dynamic").format(fmt).save(f"{path}/{name}"))


def write_prompts(prompts: DataFrame, path: str) -> None:
    """SNK-6: (request_id, prompt) rows for offline inference."""
    prompts.write.mode("overwrite").parquet(path)
