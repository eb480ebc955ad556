"""The date that messages without one inherit, carried from one micro-batch to the next."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Dates travel as text: they may lie outside the years that nanoseconds can hold.
_OUT = "container string, position long, date string, date_source string"


def _carry(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    # a container has a few rows in a batch: plain lists cost less than frames of them
    rows = sorted((row for p in pdfs for row in zip(p["position"].tolist(), p["own_date"].tolist(), p["path_year"].tolist(), strict=True)), key=lambda row: row[0])
    last, cursor = state.get if state.exists else (None, None)
    if cursor is not None and rows[0][0] <= cursor:  # the container is read anew
        last = cursor = None
    dates, sources = [], []
    for position, own, year in rows:
        if isinstance(own, str):
            last, source = own, "date"
        elif cursor is None and not dates:
            last, source = f"{int(year):04d}-01-01 00:00:00", "path-year"
        else:
            source = "previous-message"
        dates.append(last)
        sources.append(source)
    state.update((last, int(rows[-1][0])))
    yield pd.DataFrame({"container": key[0], "position": [row[0] for row in rows], "date": dates, "date_source": sources})


def carried(stream: DataFrame) -> DataFrame:
    """(container, position, date, date_source) as `inherit_dates` gives them, of a stream (container, position, own_date, path_year) in micro-batches.

    The state of a container is its last date and the position of its last message. Within a batch messages come in any order; later batches of a container hold later ones. One
    that begins at or before that position is a container that is read anew: its state begins again. A batch's messages of one container meet in one task, without their contents.
    """
    rows = stream.select(F.col("container").cast("string").alias("container"), F.col("position").cast("long").alias("position"), F.col("own_date").cast("timestamp_ntz").cast("string").alias("own_date"), F.col("path_year").cast("int").alias("path_year"))
    found = rows.groupBy("container").applyInPandasWithState(_carry, _OUT, "last string, cursor long", "append", GroupStateTimeout.NoTimeout)
    return found.withColumn("date", F.col("date").cast("timestamp_ntz"))
