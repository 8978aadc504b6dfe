"""Arrow plumbing for operators that need Python per row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from codestrata.session import ship


def map_rows(df: DataFrame, schema: str, f: Callable[[dict], list[tuple]], setup: Callable | None = None, rows: int = 256, spread: bool = False) -> DataFrame:
    """Applies `f` to each row (a dict), which returns output tuples; works through Arrow batches without shuffling.

    setup, if given, runs once per task; its result is passed to `f` as second argument. Output is cut into batches of about
    `rows` input rows, so that long texts do not pile up. spread: `df` is a plain scan; if its files make fewer parts than there
    are cores, its rows are dealt out first, since the work per row is heavy.
    """
    ship(df.sparkSession)
    if spread:
        cores = df.sparkSession.sparkContext.defaultParallelism
        if df._jdf.queryExecution().toRdd().getNumPartitions() < cores:
            df = df.repartition(cores)
    struct = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = setup() if setup else None
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                out = []
                for row in batch.slice(at, rows).to_pylist():
                    out.extend(f(row, state) if setup else f(row))
                cols = list(zip(*out)) if out else [[] for _ in arrow]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=a.type) for c, a in zip(cols, arrow)], schema=arrow)

    return df.mapInArrow(run, struct)
