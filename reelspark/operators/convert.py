"""Running planned commands on the executors."""

from __future__ import annotations

import time
from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUT = "file_id long, performed boolean, destination string, seconds double, error string"


def _each(seconds: float, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from ..live.processes import ToolError, published, require_output, watch

    for b in batches:
        rows = []
        for r in b.itertuples():
            began, error, done = time.monotonic(), r.error, False
            if error is None and r.argv is not None:
                argv = list(r.argv)
                try:
                    # the command's last word is its destination, which appears only when it is whole
                    with published(r.destination) as part:
                        watch([*argv[:-1], part], seconds, f"converting {r.source}")
                        require_output(part, argv)
                    done = True
                except (ToolError, OSError) as e:
                    error = str(e)
            rows.append((r.file_id, done, r.destination if done else None, time.monotonic() - began, error))
        yield pd.DataFrame(rows, columns=["file_id", "performed", "destination", "seconds", "error"])


def run_plans(plans: DataFrame, seconds: float = 3600.0) -> DataFrame:
    """file_id, performed, destination, seconds, error of plans (file_id, source, destination, argv, error).

    A plan with an error is passed on, one without argv has nothing to do. Each command's last word
    is the destination; it writes beside it and the file is renamed when it is whole, so a lost
    executor leaves no half of one and a plan may be run again. A failed command is a row with
    its error, not a failed job. Files must be in folders that the executors reach.
    """
    return plans.select("file_id", "source", "destination", "argv", F.col("error").cast("string").alias("error")).mapInPandas(partial(_each, seconds), OUT)
