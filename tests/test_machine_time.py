import datetime as dt

import pytest

from slotlog.operators import images, utilisation as U
from tests.conftest import day, minutes, records

RASTER = "Terminbuch string, Wochentag string, TERMINRASTER_NAME string, `gültig von` string, `gültig bis` string, " \
         "Termin string, `Dauer in Min.` int"
TIMES = "AccessionNumber long, image_device_id int, image_start timestamp_ntz, image_end timestamp_ntz"


def monday(start, end, device=1, n=6):
    at = lambda s: day(n, *map(int, s.split(":")))
    return device, at(start), at(end)


def hours(device="MR1", weekday="MO", length=120, valid_from="01.01.2014"):
    return device, weekday, "any", valid_from, "01.01.2055", "14:00", length


ONE = [hours()]
CASES = {
    # raster, appointments, buffer, {(day, device): (total, active, buffer, idle) in minutes}
    "one": (ONE, [monday("14:30", "15:05")], 5, {(6, 1): (120, 35, 10, 75)}),
    "before the calendar": ([hours(valid_from="01.01.2019")], [monday("14:30", "15:05", n=-603)], 5, {(-603, 1): (120, 35, 10, 75)}),
    "two": (ONE, [monday("14:30", "15:05"), monday("15:20", "15:50")], 5, {(6, 1): (120, 65, 20, 35)}),
    "two machines": ([hours(), hours("MR2", length=60)],
                     [monday("14:30", "15:05"), monday("15:20", "15:50"), monday("14:20", "14:45", 2)], 5,
                     {(6, 1): (120, 65, 20, 35), (6, 2): (60, 25, 10, 25)}),
    "overlapping buffers": (ONE, [monday("14:20", "14:50"), monday("14:55", "15:15"), monday("15:20", "15:50")], 5,
                            {(6, 1): (120, 80, 20, 20)}),
    "overlapping appointments": (ONE, [monday("14:20", "14:50"), monday("14:45", "15:15")], 5, {(6, 1): (120, 55, 10, 55)}),
    "starts early": (ONE, [monday("13:55", "14:20"), monday("14:45", "15:15")], 5, {(6, 1): (125, 55, 15, 55)}),
    "ends late": (ONE, [monday("14:20", "14:55"), monday("15:35", "16:10")], 5, {(6, 1): (130, 70, 15, 45)}),
    "two days": ([hours(), hours(weekday="DI", length=60)],
                 [monday("14:30", "15:05"), monday("15:20", "15:50"), monday("14:20", "14:45", n=7)], 5,
                 {(6, 1): (120, 65, 20, 35), (7, 1): (60, 25, 10, 25)}),
    "both ends over": (ONE, [monday("13:50", "14:25"), monday("14:55", "15:30"), monday("15:45", "16:15")], 5,
                       {(6, 1): (145, 100, 20, 25)}),
    "both ends over, buffers overlap": (ONE, [monday("13:50", "14:25"), monday("14:30", "15:30"), monday("15:45", "16:15")], 5,
                                        {(6, 1): (145, 125, 15, 5)}),
    "both ends over, appointments overlap": (ONE, [monday("13:50", "14:25"), monday("14:20", "15:30"), monday("15:45", "16:15")],
                                             5, {(6, 1): (145, 130, 10, 5)}),
    "one outside the day": (ONE, [monday("14:30", "15:05"), monday("15:20", "15:50"), monday("16:20", "16:50")], 5,
                            {(6, 1): (120, 65, 20, 35)}),
    "no buffer": (ONE, [monday("14:30", "15:05"), monday("15:20", "15:50")], 0, {(6, 1): (120, 65, 0, 55)}),
}


@pytest.mark.parametrize("name", CASES)
def test_daily_stats(spark, name):
    raster, appts, buffer, expected = CASES[name]
    calendar = U.fill_calendar(U.opening_hours(spark.createDataFrame(raster, RASTER)), dt.date(2024, 1, 1))
    times = spark.createDataFrame([(i + 1, *a) for i, a in enumerate(appts)], TIMES)
    stats = U.daily_stats(U.appts_and_gaps(U.idle_gaps(times, calendar, buffer)))
    got = {(r["date"], r["image_device_id"]): r for r in stats.collect()}
    assert set(got) == {(day(n, 0), d) for n, d in expected}
    for (n, d), (total, active, buf, idle) in expected.items():
        r = got[(day(n, 0), d)]
        assert [r["total_time"], r["active"], r["buffer"], r["idle"]] == pytest.approx([x / 60 for x in (total, active, buf, idle)])
        assert [r["active_pct"], r["buffer_pct"], r["idle_pct"]] == pytest.approx([x / total for x in (active, buf, idle)])


def test_calendar_fill(spark):
    rows = [("MR1", "MO", "r", "05.12.2018", "20.02.2019", "07:00", 35), ("MR1", "MO", "r", "05.12.2018", "20.02.2019", "07:35", 35),
            ("MR1", "MO", "r", "21.02.2019", None, "08:00", 30)]
    out = U.fill_calendar(U.opening_hours(spark.createDataFrame(rows, RASTER)), dt.date(2024, 1, 1))
    got = records(out, ["applicable_from", "applicable_to", "day_start_tp", "day_end_tp", "day_length_tp"])
    d = dt.datetime
    assert got == [
        (d(2014, 1, 1), d(2018, 12, 4), 25200, 29400, 70),
        (d(2018, 12, 5), d(2019, 2, 20), 25200, 29400, 70),
        (d(2019, 2, 21), d(2055, 12, 31), 28800, 30600, 30),
    ]


def test_equal_first_starts_have_no_first(spark):
    """Mean ranks: two appointments that start together are neither the first."""
    calendar = U.opening_hours(spark.createDataFrame(ONE, RASTER))
    times = spark.createDataFrame([(1, *monday("14:10", "14:30")), (2, *monday("14:10", "14:40"))], TIMES)
    out = U.idle_gaps(times, calendar, 5)
    assert out.filter("first_appt = 1 or last_appt = 1").count() == 0 and out.count() == 2


def _images(spark, gaps):
    t, rows = dt.datetime(2019, 1, 7, 8), []
    for i, g in enumerate([0, *gaps]):
        t += dt.timedelta(seconds=g)
        rows.append(("1", "MT00000173", i, t.strftime("%Y%m%d"), t.strftime("%H%M%S.%f")))
    return spark.createDataFrame(rows, "AccessionNumber string, StationName string, SopImageUid long, AcquisitionDate string, "
                                       "AcquisitionTime string")


@pytest.mark.parametrize("gaps, kept", [
    ([60] * 9, range(10)),
    ([60, 2000] + [60] * 10, range(2, 13)),
    ([60] * 10 + [2000, 60], range(0, 11)),
    ([2000, 60, 2000] + [60] * 10, range(3, 14)),
    ([60] * 6 + [2000] + [60] * 6, range(14)),
])
def test_trim_edges(spark, gaps, kept):
    out = images.preprocess(_images(spark, gaps))
    assert sorted(r[0] for r in out.select("SopImageUid").collect()) == list(kept)


def test_mean_ranks_and_flags(spark):
    df = images.add_gap_columns(images.add_image_time(_images(spark, [0, 0, 10, 4000])))
    got = [tuple(r) for r in df.orderBy("SopImageUid").select("img_rank", "img_rank_rev", "big_image_gap").collect()]
    assert got == [(2.0, 4.0, 1)] * 3 + [(4.0, 2.0, 1), (5.0, 1.0, 1)]


def test_integrate(spark):
    slots = spark.createDataFrame(
        [(1, day(1), day(1) + minutes(30), "show", "MR1"), (2, day(1), day(1) + minutes(30), "no-show", "MR1"),
         (3, day(1), day(1) + minutes(30), "show", "MR1")],
        "FillerOrderNo long, start_time timestamp_ntz, end_time timestamp_ntz, slot_type string, EnteringOrganisationDeviceID string")
    times = spark.createDataFrame([(1, 2, day(1, 10), day(1, 11)), (2, 2, day(1, 10), day(1, 11))], TIMES)
    cols = ["FillerOrderNo", "start_time", "status_start", "EnteringOrganisationDeviceID", "device_from_status"]
    assert records(images.integrate(slots, times), cols) == [
        (1, day(1, 10), day(1), "MR2", "MR1"), (2, day(1), day(1), "MR2", "MR1"), (3, day(1), day(1), "MR1", "MR1")]
    strict = records(images.integrate(slots, times, strict_reference=True).filter("FillerOrderNo = 3"), cols)
    assert strict == [(3, None, day(1), "MR1", "MR1")]


def test_periods_and_melt(spark):
    daily = spark.createDataFrame(
        [(day(0, 0), 1, 1.0, 0.5, 0.5, 2.0), (day(1, 0), 1, 3.0, None, 1.0, 4.0), (day(40, 0), 1, None, None, None, 1.0)],
        "date timestamp_ntz, image_device_id int, active double, buffer double, idle double, total_time double")
    assert records(U.period_stats(daily, "month"), ["month", "active", "buffer", "idle", "total_time", "active_pct"]) == [
        (day(0, 0), 4.0, 0.5, 1.5, 6.0, pytest.approx(4 / 6)), (dt.datetime(2019, 2, 1), 0.0, 0.0, 0.0, 1.0, 0.0)]
    year = U.period_stats(daily, "year")
    assert records(year, ["year", "total_time"]) == [(2019, 7.0)]
    assert records(U.melt_stats(year, "year", shares=False), ["machine_status", "hours"]) == [
        ("Active", 4.0), ("Buffer", 0.5), ("Idle", 1.5)]
