"""Image rows to machine utilisation."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame

from slotlog import constants as K
from slotlog.operators import images, utilisation


def image_times(raw_images: DataFrame, known: DataFrame | None = None, split_hot: bool = True) -> DataFrame:
    df = images.keep_known_appointments(raw_images, known) if known is not None else raw_images
    return images.appointment_times(images.preprocess(df, split_hot))


def idle_time(times: DataFrame, raster: DataFrame, as_of: dt.date, buffer_minutes: int = K.BUFFER_MINUTES,
              split_hot: bool = True) -> DataFrame:
    """Active, idle and buffer intervals; one shuffle on the machine day, the calendar travels to it."""
    hours = utilisation.fill_calendar(utilisation.opening_hours(raster), as_of)
    return utilisation.appts_and_gaps(utilisation.idle_gaps(times, hours, buffer_minutes, split_hot))


def idle_stats(pieces: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    daily = utilisation.daily_stats(pieces)
    return daily, utilisation.period_stats(daily, "month"), utilisation.period_stats(daily, "year")
