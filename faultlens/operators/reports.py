"""Run reports and a call log, from metrics that are collected while the rows pass: nothing is scanned again.

Metrics of a write are Spark's observed metrics. A stage that runs anew because an executor was lost may count its rows again;
`exact=True` counts the written rows instead.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

REPORT = "run string, step string, started timestamp, seconds double, rows_in long, rows_out long, quarantined long, outcome string, error string"
CALLS = "run string, called timestamp, name string, arguments string, seconds double, rows long, outcome string, error string"


@dataclass
class Run:
    """A run of several steps. Its report is written once, by `close`."""

    spark: SparkSession
    name: str
    folder: str
    steps: list[tuple] = field(default_factory=list)
    calls: list[tuple] = field(default_factory=list)

    def step(self, name: str, rows: DataFrame, work: Callable[[DataFrame], DataFrame], place: str, bad: Column | None = None, exact: bool = False) -> DataFrame:
        """Writes work(rows) to place/good and rows for which `bad` holds, or is null, to place/bad; returns what is good.
        The report has the rows that came in, were written and were set aside. A failing step is reported and raised."""
        seen, set_aside, kept = Observation(), Observation(), Observation()
        started, clock = datetime.now(UTC).replace(tzinfo=None), time.monotonic()
        n = F.count(F.lit(1)).alias("n")
        try:
            wrong = F.lit(False) if bad is None else F.coalesce(bad, F.lit(True))
            lost = 0
            if bad is not None:
                rows.where(wrong).observe(set_aside, n).write.mode("overwrite").parquet(f"{place}/bad")
                lost = self.spark.read.schema(rows.schema).parquet(f"{place}/bad").count() if exact else set_aside.get["n"]
            made = work(rows.observe(seen, n).where(~wrong))
            made.observe(kept, n).write.mode("overwrite").parquet(f"{place}/good")
            out = self.spark.read.schema(made.schema).parquet(f"{place}/good")
            counts = (rows.count() if exact else seen.get["n"], out.count() if exact else kept.get["n"], lost)
        except Exception as e:
            self.steps.append((self.name, name, started, time.monotonic() - clock, None, None, None, "failed", str(e)[:500]))
            raise
        self.steps.append((self.name, name, started, time.monotonic() - clock, *counts, "ok", None))
        return out

    def call(self, name: str, run: Callable[..., DataFrame], **arguments) -> list:
        """The rows of a small result (a lookup), with a line in the call log whether it succeeds or not."""
        called, clock = datetime.now(UTC).replace(tzinfo=None), time.monotonic()
        said = ", ".join(f"{k}={str(v)[:100]!r}" for k, v in sorted(arguments.items()))
        try:
            rows = run(**arguments).collect()
        except Exception as e:
            self.calls.append((self.name, called, name, said, time.monotonic() - clock, None, "failed", str(e)[:500]))
            raise
        self.calls.append((self.name, called, name, said, time.monotonic() - clock, len(rows), "ok", None))
        return rows

    def close(self) -> tuple[DataFrame, DataFrame]:
        """(report, call log) of this run, appended to those of earlier ones."""
        out = []
        for kind, lines, schema in (("report", self.steps, REPORT), ("calls", self.calls, CALLS)):
            made = self.spark.createDataFrame(lines, schema)
            made.coalesce(1).write.mode("append").json(f"{self.folder}/{kind}")
            out.append(made)
        return out[0], out[1]
