"""Raw status changes to slots: every case runs the whole way."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from slotlog.functions import rules
from slotlog.operators import slots, status
from tests.conftest import day, minutes, raw_log, records

RANGE = [dt.date(2019, 1, 1), dt.date(2019, 2, 1)]
COLUMNS = ["FillerOrderNo", "start_time", "end_time", "NoShow", "slot_outcome", "slot_type", "slot_type_detailed",
           "patient_class_adj", "EnteringOrganisationDeviceID", "UniversalServiceName"]


def slot(start, no_show, outcome, kind, detailed, fon=0, pclass="ambulant"):
    return (fon, start, start + minutes(30), no_show, outcome, kind, detailed, pclass, "MR1", "MR")


def show(start, fon=0):
    return slot(start, False, "show", "show", "show", fon)


def missed(start, outcome, severity, fon=0):
    return slot(start, True, outcome, "no-show", severity + " no-show", fon)


SHOW = [(day(0), "scheduled", day(4)), (day(4), "started", day(4)), (day(4) + minutes(30), "examined", day(4))]
COMES_LATER = [(day(13), "registered", day(14)), (day(14), "started", day(14)), (day(14), "examined", day(14))]
TWICE = [(1, day(0), "requested", day(4)), (2, day(0), "requested", day(4)), (1, day(1), "scheduled", day(4)),
         (2, day(1), "scheduled", day(4)), (1, day(3), "registered", day(4)), (2, day(3), "registered", day(4))]
FIRST_COMES = [(1, day(4), "started", day(4)), (1, day(4) + minutes(30), "examined", day(4))]

CASES = {
    "show": (SHOW, "ambulant", [show(day(4))]),
    "rescheduled three days ahead": ([(day(0), "scheduled", day(10)), (day(7), "scheduled", day(17))], "ambulant", []),
    "canceled three days ahead": ([(day(0), "scheduled", day(10)), (day(7), "canceled", day(10))], "ambulant", []),
    "inpatient canceled one day ahead": ([(day(0), "scheduled", day(7)), (day(6), "canceled", day(7))], "stationär", []),
    "soft, rescheduled": ([(day(0), "scheduled", day(7)), (day(6), "scheduled", day(14)), *COMES_LATER], "ambulant",
                          [missed(day(7), "rescheduled", "soft"), show(day(14))]),
    "hard, rescheduled": ([(day(0), "scheduled", day(7)), (day(8), "scheduled", day(14)), *COMES_LATER], "ambulant",
                          [missed(day(7), "rescheduled", "hard"), show(day(14))]),
    "soft, canceled": ([(day(0), "scheduled", day(7)), (day(6), "canceled", day(7))], "ambulant",
                       [missed(day(7), "canceled", "soft")]),
    "hard, canceled": ([(day(0), "scheduled", day(7)), (day(6), "registered", day(7)), (day(7) + minutes(10), "canceled", day(7))],
                       "ambulant", [missed(day(7), "canceled", "hard")]),
    "hard, never planned anew": ([(day(0), "scheduled", day(7)), (day(6), "registered", day(7)),
                                  (day(7) + minutes(10), "scheduled", day(7))], "ambulant",
                                 [missed(day(7), "canceled", "hard")]),
    "false start, moved": ([(day(0), "scheduled", day(5)), (day(4), "registered", day(5)), (day(5), "started", day(5)),
                            (day(5) + minutes(10), "scheduled", day(8)), (day(7), "registered", day(8)),
                            (day(8), "started", day(8)), (day(8) + minutes(10), "examined", day(8))], "stationär",
                           [slot(day(8), False, "show", "inpatient", "inpatient", pclass="inpatient")]),
    "double booking, half canceled": ([*TWICE, (2, day(3) + minutes(30), "canceled", day(4)), *FIRST_COMES], "ambulant",
                                      [show(day(4), 1)]),
    "double booking, half rescheduled": ([*TWICE, (2, day(3) + minutes(30), "scheduled", day(4)), *FIRST_COMES], "ambulant",
                                         [show(day(4), 1)]),
    "double booking, both canceled": ([*TWICE, (1, day(4) + minutes(10), "canceled", day(4)),
                                       (2, day(4) + minutes(10), "canceled", day(4))], "ambulant",
                                      [missed(day(4), "canceled", "hard", 1)]),
    "end is planned, not reported": ([*SHOW[:2], (day(4) + minutes(27), "examined", day(4))], "ambulant", [show(day(4))]),
    "weekend between": ([(day(0), "scheduled", day(6)), (day(3), "canceled", day(6))], "ambulant",
                        [missed(day(6), "canceled", "soft")]),
}


@pytest.mark.parametrize("name", CASES)
def test_slots(spark, name):
    rows, patient_class, expected = CASES[name]
    log = status.build_status_log(raw_log(spark, rows, patient_class))
    got = records(slots.build_slots(log, RANGE), COLUMNS)
    assert got == sorted(expected, key=lambda r: tuple((v is None, str(v)) for v in r))


def test_outside_date_range(spark):
    log = status.build_status_log(raw_log(spark, SHOW))
    assert slots.build_slots(log, [dt.date(2020, 1, 1), dt.date(2020, 2, 1)]).count() == 0


def test_without_ids(spark):
    out = slots.build_slots(status.build_status_log(raw_log(spark, SHOW)), RANGE, include_id_cols=False)
    assert "FillerOrderNo" not in out.columns and "MRNCmpdId" not in out.columns
    assert out.count() == 1


def test_without_requested_start_time(spark):
    out = slots.build_slots(status.build_status_log(raw_log(spark, SHOW)), RANGE, {"NoShow": slots.smallest})
    assert set(out.columns) == {"FillerOrderNo", "MRNCmpdId", "NoShow"}


def test_test_patients_and_unchanged_rows(spark):
    rows = [(1, *r) for r in SHOW] + [(2, *r) for r in SHOW] + [(3, day(0), "scheduled", day(4)), (3, day(1), "scheduled", day(4))]
    raw = raw_log(spark, rows, patients={1: "7|USZ", 2: "TEST_1", 3: "9"}).withColumn("OrderStatus", F.lit("u"))
    log = status.build_status_log(raw)
    assert {r[0] for r in log.select("MRNCmpdId").distinct().collect()} == {"7", "9"}
    assert log.filter("FillerOrderNo = 3").count() == 1
    assert status.build_status_log(raw, ["7"]).filter("MRNCmpdId = '7'").count() == 0
    ids = spark.createDataFrame([("7",)], "id string")
    assert status.build_status_log(raw, ids).filter("MRNCmpdId = '7'").count() == 0


AM9 = 9
RULE = [
    # date, planned, was, now, expected
    (day(0, 0), day(0), "scheduled", "scheduled", True),
    (day(0, 0), day(1), "scheduled", "scheduled", True),
    (day(3, 0), day(6), "scheduled", "scheduled", True),
    (day(0, 0), day(0), "registered", "scheduled", True),
    (day(0, 0), day(0), "registered", "canceled", True),
    (day(0, 0), day(1), "scheduled", "canceled", True),
    (day(3, 0), day(6), "scheduled", "canceled", True),
    (day(2, 0), day(6), "scheduled", "canceled", True),
    (day(0, 0), day(3), "scheduled", "scheduled", False),
    (day(0, 0), day(3), "registered", "scheduled", False),
    (day(0, 0), day(0), "requested", "scheduled", False),
    (day(0, 0), day(0), "requested", "requested", False),
    (day(0, 0), day(0), "scheduled", "registered", False),
    (day(0, 0), day(0), "registered", "waiting", False),
    (day(0, 0), day(0), "waiting", "started", False),
    (day(0, 0), day(0), "started", "examined", False),
    (day(0, 0), day(0), "scheduled", "written", False),
    (day(0, 0), day(0), None, "scheduled", False),
    (day(0, 0), None, "scheduled", "scheduled", False),
    (day(0), day(1, 0), "scheduled", "scheduled", False),
]


def test_no_show_rule(spark):
    rows = [(i, *r, "ambulant", dt.datetime(2018, 12, 1, 9)) for i, r in enumerate(RULE)]
    rows.append((len(rows), day(0, 0), day(0), "scheduled", "scheduled", False, "inpatient", dt.datetime(2018, 12, 1, 9)))
    rows.append((len(rows), day(0), day(0, 10), "scheduled", "scheduled", False, "ambulant", day(0, 8)))
    df = spark.createDataFrame(rows, "i int, date timestamp_ntz, planned timestamp_ntz, was string, now string, "
                                     "expected boolean, pc string, created timestamp_ntz")
    c = F.col
    got = df.withColumn("got", rules.no_show(c("date"), c("was"), c("now"), c("planned"), c("created"), c("pc")))
    assert got.filter("got is null or got <> expected").collect() == []


def test_severity(spark):
    rows = [(False, None, None, None), (True, day(1, 0), day(3), "soft"), (True, day(2, 0), day(3), "soft"),
            (True, day(3, 10), day(3), "hard"), (True, day(4), day(3), "hard")]
    df = spark.createDataFrame(rows, "ns boolean, date timestamp_ntz, planned timestamp_ntz, expected string")
    got = df.withColumn("got", rules.severity(F.col("ns"), F.col("date"), F.col("planned")))
    assert got.filter("not (got <=> expected)").count() == 0


def test_ties_keep_input_order(spark):
    t = day(1)
    rows = [(0, t, "scheduled", day(5)), (0, t, "registered", day(6)), (0, t, "canceled", day(7))]
    log = status.build_status_log(raw_log(spark, rows))
    got = [tuple(r) for r in log.orderBy("ingest_seq").select("was_status", "now_status").collect()]
    assert got == [(None, "scheduled"), ("scheduled", "registered"), ("registered", "canceled")]
