"""A fitted imputer on a stream: its transform is a projection, so it runs there unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame


def impute_stream(model, stream: DataFrame) -> DataFrame:
    if not stream.isStreaming:
        raise ValueError("not a streaming table")
    return model.transform(stream)
