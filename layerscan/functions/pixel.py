"""Column expressions on single pixels; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from layerscan.params import Params


def is_saturated(temp: Column, params: Params = Params()) -> Column:
    return temp > params.saturation_thresh


def is_candidate(temp: Column, params: Params = Params()) -> Column:
    """Neither empty nor saturated; both bounds are exclusive."""
    return (temp > params.empty_thresh) & (temp < params.saturation_thresh)


def is_outlier(close_mean: Column, outer_mean: Column, params: Params = Params()) -> Column:
    return F.abs(close_mean - outer_mean) > params.outlier_thresh


def point_id(x: Column, y: Column) -> Column:
    """Row-major number of a pixel, independent of the image width."""
    return F.shiftleft(y.cast("bigint"), 32) + x.cast("bigint")
