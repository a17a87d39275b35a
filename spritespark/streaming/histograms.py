"""Colour counts over a stream of pixel rows: the batch operator, kept up to date by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame

from spritespark.operators.points import color_histogram


def histogram_stream(pixels: DataFrame, keys: tuple = ("image_id",)) -> DataFrame:
    """For ``writeStream.outputMode("update")``: the state is a count for each image and colour, not its pixels."""
    return color_histogram(pixels, keys)
