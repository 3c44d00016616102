"""From single images to appointment times."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotlog import constants as K
from slotlog.functions import rules
from slotlog.functions.dates import image_clock, seconds_between
from slotlog.operators import cleaning, ordered
from slotlog.session import cut_lineage

KEY = ["AccessionNumber"]


def pivot_tags(df: DataFrame, tags: list[str]) -> DataFrame:
    """Tag/value rows to one row per image; the tag list is given, so no extra pass finds it."""
    keys = ["SeriesUID", "SopImageUid", "StudyUID"]
    return df.distinct().groupBy(*keys).pivot("tag_name", tags).agg(F.first("Value", ignorenulls=True))


def keep_known_appointments(images: DataFrame, known: DataFrame) -> DataFrame:
    """Images with a numeric id that the other system knows too."""
    ids = cleaning.numeric_ids(known.select("AccessionNumber")).distinct()
    return cleaning.numeric_ids(images).join(ids, KEY, "left_semi")


def add_image_time(df: DataFrame) -> DataFrame:
    return df.withColumn("acq_datetime", image_clock(F.col("AcquisitionDate"), F.col("AcquisitionTime")))


def add_gap_columns(df: DataFrame) -> DataFrame:
    """Neighbours in time, seconds to them, a long-gap flag and the place from both ends (ties share the mean place)."""
    c = F.col
    t = c("acq_datetime")
    out = ordered.with_ordered(df, KEY, ["acq_datetime", "SopImageUid"], {
        "AcquisitionTime_prev": ordered.lag(c("AcquisitionTime")),
        "acq_prev_datetime": ordered.lag(t),
        "acq_next_datetime": ordered.lead(t),
        "images": ordered.key_count(t),
    })
    out = out.withColumns({
        "time_between_next_image": seconds_between(t, c("acq_next_datetime")),
        "time_between_prev_image": seconds_between(c("acq_prev_datetime"), t),
    })
    out = ordered.with_ordered(out, KEY, ["acq_datetime"], {
        "smaller": ordered.smaller_before(),
        "longest_gap": ordered.key_max(c("time_between_next_image")),
    })
    out = ordered.with_ordered(out, KEY + ["acq_datetime"], ["acq_datetime"], {"peers": ordered.key_count()})
    rank = c("smaller") + (c("peers") + 1) / 2
    out = out.withColumns({
        "big_image_gap": F.when(rules.holds(c("longest_gap") > K.IMAGE_GAP_SECONDS), 1).otherwise(0).cast("long"),
        "img_rank": F.when(t.isNotNull(), rank),
        "img_rank_rev": F.when(t.isNotNull(), c("images") + 1 - rank),
    })
    return out.drop("smaller", "peers", "images", "longest_gap")


def trim_edges(df: DataFrame) -> DataFrame:
    """Cut the few images that a long gap separates from the rest, at the start and at the end."""
    c = F.col
    long_next = (c("img_rank") <= K.EDGE_IMAGES) & (c("time_between_next_image") > K.IMAGE_GAP_SECONDS)
    long_prev = (c("img_rank_rev") <= K.EDGE_IMAGES) & (c("time_between_prev_image") > K.IMAGE_GAP_SECONDS)
    out = ordered.with_ordered(df, KEY, ["acq_datetime"], {
        "cut": ordered.key_max(F.when(long_next, c("img_rank"))),
        "cut_rev": ordered.key_max(F.when(long_prev, c("img_rank_rev"))),
    })
    gone = rules.holds(c("img_rank") <= c("cut")) | rules.holds(c("img_rank_rev") <= c("cut_rev"))
    return out.filter(~gone).drop("cut", "cut_rev")


def preprocess(df: DataFrame, split_hot: bool = False) -> DataFrame:
    """Known stations, complete and distinct rows, times, gaps, trimmed edges; windows share one exchange."""
    out = add_image_time(cleaning.map_stations(df))
    if split_hot:
        out = ordered.split_hot_keys(cut_lineage(out, "images"), KEY, "acq_datetime")
    out = cleaning.distinct_with_keys(out, ["AccessionNumber", "AcquisitionDate"])
    return trim_edges(add_gap_columns(out)).drop(ordered.chunk_column(KEY))


def appointment_times(df: DataFrame) -> DataFrame:
    """First and last image per appointment and device."""
    out = df.filter(F.col("AccessionNumber").isNotNull() & F.col("StationName").isNotNull())
    return out.groupBy("AccessionNumber", "big_image_gap", F.col("StationName").alias("image_device_id")).agg(
        F.min("acq_datetime").alias("image_start"), F.max("acq_datetime").alias("image_end")).drop("big_image_gap")


def integrate(slots: DataFrame, times: DataFrame, strict_reference: bool = False) -> DataFrame:
    """Slots with the times and the device of their images; the planned ones stay in ``status_*`` columns.

    Attended slots without images keep their planned times. ``strict_reference``
    makes those times null instead, as the original analysis did.
    """
    c = F.col
    out = slots.join(times, slots["FillerOrderNo"] == times["AccessionNumber"], "left")
    attended = rules.holds(c("slot_type").isin("show", "inpatient"))
    pick = (lambda new, old: F.when(attended, c(new)).otherwise(c(old))) if strict_reference else (
        lambda new, old: F.when(attended & c(new).isNotNull(), c(new)).otherwise(c(old)))
    device = c("EnteringOrganisationDeviceID")
    return out.withColumns({
        "status_start": c("start_time"), "status_end": c("end_time"), "device_from_status": device,
    }).withColumns({
        "start_time": pick("image_start", "status_start"),
        "end_time": pick("image_end", "status_end"),
        "EnteringOrganisationDeviceID": F.when(
            c("image_device_id").isNotNull(), F.concat(F.lit("MR"), c("image_device_id").cast("int").cast("string"))
        ).otherwise(device),
    })
