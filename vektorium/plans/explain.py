"""What a search does: strategy, pushed filters and row counts, from Spark's own plan and metrics."""

from __future__ import annotations

import contextlib
import io
import re
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, functions as F


def physical(df: DataFrame, mode: str = "formatted") -> str:
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain(mode)
    return out.getvalue()


@dataclass
class QueryStats:
    """``strategy`` is ``top-k`` where each partition keeps its best rows, else ``scan``."""

    strategy: str
    pushed_filters: list[str] = field(default_factory=list)
    read_columns: list[str] = field(default_factory=list)
    exchanges: int = 0
    rows_out: int = 0
    seconds: float = 0.0

    def __str__(self) -> str:
        return f"{self.strategy}: {self.rows_out} rows in {self.seconds:.3f} s, {self.exchanges} exchanges, reads {', '.join(self.read_columns)}, pushed {', '.join(self.pushed_filters) or 'nothing'}"


def analyse(df: DataFrame, run: bool = False) -> QueryStats:
    """Read a plan; with ``run``, execute it once and count its rows."""
    text = physical(df)
    pushed = sorted({f.strip() for line in re.findall(r"PushedFilters: \[(.*?)\]\n", text) for f in re.split(r",\s*(?![^(]*\))", line) if f.strip()})
    cols = sorted({c for line in re.findall(r"ReadSchema: struct<(.*?)>\n", text) for c in re.findall(r"(\w+):", line)})
    stats = QueryStats("top-k" if "TakeOrderedAndProject" in text else "scan", pushed, cols, len(re.findall(r"\(\d+\) (?:Broadcast)?Exchange\n", text)))
    if run:
        seen, began = Observation(), time.time()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
        stats.rows_out, stats.seconds = seen.get["n"], time.time() - began
    return stats
