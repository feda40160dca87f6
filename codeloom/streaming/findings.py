"""Findings and drift over streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from codeloom.operators.governance import normalised
from codeloom.operators.line_rules import line_findings

PAYLOAD = "payload_id bigint, project_root string, path string, content string, scanned_at timestamp"


def payload_stream(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    """Files of JSON payload rows dropped into a folder."""
    return spark.readStream.schema(PAYLOAD).option("maxFilesPerTrigger", per_trigger).json(folder)


def finding_stream(payloads: DataFrame, delay: str = "1 day") -> DataFrame:
    """Line-rule Issues of a stream of payloads, each fingerprint once within the watermark."""
    found = line_findings(payloads.withWatermark("scanned_at", delay), key=("payload_id", "project_root", "path", "scanned_at"))
    issues = found.select(F.col("path").alias("file"), F.col("rule_id").alias("category"), "severity", F.lit("rule_catalog").alias("detector"), F.lit("line rule").alias("description"), "line_number", F.col("line").alias("location"), F.lit("medium").alias("confidence"), "scanned_at")
    return normalised(issues).dropDuplicatesWithinWatermark(["fingerprint"])


def severity_windows(findings: DataFrame, width: str = "1 hour") -> DataFrame:
    """Counts by severity in event-time windows."""
    return findings.groupBy(F.window("scanned_at", width), "severity").agg(F.count(F.lit(1)).alias("n"))


STATE = "score double, run int"
DRIFT = "entity string, seq bigint, score double, run int, alert boolean"


def drift_stream(steps: DataFrame, score_limit: float = 3.0, run_limit: int = 3) -> DataFrame:
    """ST-02 over a stream of ``entity, seq, weight, negative``: running score and run of bad steps per entity.

    The state is two numbers an entity. Within a trigger, rows are taken by ``seq``; rows
    that arrive in a later trigger with a lower ``seq`` are counted when they arrive. The
    batch form is ``operators.drift.drift_state``.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        score, run = state.get if state.exists else (0.0, 0)
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        out = []
        for seq, weight, bad in zip(rows["seq"], rows["weight"], rows["negative"], strict=True):
            score += 0.0 if pd.isna(weight) else float(weight)
            run = run + 1 if bad is True or bad == 1 else 0
            out.append((key[0], int(seq), score, run, bool(score > score_limit or run >= run_limit)))
        state.update((score, run))
        yield pd.DataFrame(out, columns=["entity", "seq", "score", "run", "alert"])

    return steps.groupBy("entity").applyInPandasWithState(step, DRIFT, STATE, "append", GroupStateTimeout.NoTimeout)
