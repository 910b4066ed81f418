"""The position solver on a stream of arrival times.

Solving is row by row and keeps no state, so the batch function maps a streaming DataFrame as it
is; the running success rate is a streaming aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from kartograf.operators.multilateration import locate, success_rate


def position_stream(stream: DataFrame, **options) -> DataFrame:
    return locate(stream, **options)


def running_success(stream: DataFrame, **options) -> DataFrame:
    """For output mode ``complete``."""
    return success_rate(locate(stream, **options))
