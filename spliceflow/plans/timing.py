"""Seconds of a batch run: all of it, its calculation, its output, and each stage as Spark's own listener saw it."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

STAGES = "stage_id long, name string, tasks long, seconds double, task_seconds double, input_mb double, shuffle_mb double, spill_mb double"


def timed_run(spark: SparkSession, build: Callable[[], DataFrame], path: str) -> tuple[dict[str, float], DataFrame]:
    """Run build() and write its result to path. ({"run", "calculation", "output"} in seconds, one row for each stage).

    Tables that build() writes on its way, and all that Spark does before the result's last stage begins, are
    calculation; output is the last stage, which computes and writes the result's rows.
    """
    sc, group = spark.sparkContext, f"run-{uuid.uuid4().hex}"
    began = time.time()
    sc.setJobGroup(group, "timed run")
    try:
        build().write.parquet(path)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    ended = time.time()
    jobs = sc.statusTracker().getJobIdsForGroup(group)
    ids = sorted({int(s) for j in jobs if (info := sc.statusTracker().getJobInfo(j)) for s in info.stageIds})
    store, rows, last = sc._jsc.sc().statusStore(), [], began
    ms = lambda date: date.get().getTime() / 1000 if date.isDefined() else None
    for i in ids:
        s = store.lastStageAttempt(i)
        start, end = ms(s.submissionTime()), ms(s.completionTime())
        if start is None or end is None:  # skipped: its rows were there already
            continue
        last = max(last, start)
        mb = lambda n: n / 1e6
        rows.append((i, s.name(), s.numCompleteTasks(), end - start, s.executorRunTime() / 1000, mb(s.inputBytes()), mb(s.shuffleWriteBytes()), mb(s.diskBytesSpilled())))
    seconds = {"run": ended - began, "calculation": last - began, "output": ended - last}
    return seconds, spark.createDataFrame(rows, STAGES)
