import datetime as dt

import pytest
from pyspark.sql import functions as F

from slotlog.functions import text
from slotlog.operators import features, slots, status
from slotlog.plans import feature_jobs as jobs
from tests.conftest import day, minutes, post_codes, raw_log, records

RANGE = [dt.date(2019, 1, 1), dt.date(2019, 2, 1)]
HISTORY = ["no_show_before", "no_show_before_sq", "appts_before", "show_before", "no_show_rate"]


def history(spark, rows):
    return spark.createDataFrame([(p, f, day(d), bool(n)) for p, f, d, n in rows],
                                 "MRNCmpdId long, FillerOrderNo long, start_time timestamp_ntz, NoShow boolean")


@pytest.mark.parametrize("rows, expected", [
    ([(1, 1, 2, 1), (1, 1, 3, 1), (1, 1, 4, 0)], [(0, 0, 0, 0, 0.0), (1, 1, 1, 0, 1.0), (2, 4, 2, 0, 1.0)]),
    ([(2, 1, 2, 0), (2, 1, 3, 0)], [(0, 0, 0, 0, 0.0), (0, 0, 1, 1, 0.0)]),
    ([(1, 1, 2, 1), (1, 1, 3, 1), (1, 1, 4, 0), (2, 1, 2, 0), (2, 1, 3, 0)],
     [(0, 0, 0, 0, 0.0), (1, 1, 1, 0, 1.0), (2, 4, 2, 0, 1.0), (0, 0, 0, 0, 0.0), (0, 0, 1, 1, 0.0)]),
    ([(2, 1, 3, 0), (2, 1, 2, 1)], [(0, 0, 0, 0, 0.0), (1, 1, 1, 0, 1.0)]),
])
def test_no_show_before(spark, rows, expected):
    out = features.add_no_show_before(history(spark, rows)).orderBy("MRNCmpdId", "start_time")
    assert [tuple(r) for r in out.select(*HISTORY).collect()] == expected


def test_no_show_before_with_history(spark):
    old, now = history(spark, [(1, 1, 1, 1), (1, 2, 2, 0), (1, 3, 5, 1)]), history(spark, [(1, 3, 5, 1), (1, 4, 6, 0)])
    out = features.add_no_show_before(now, old).orderBy("start_time")
    assert [tuple(r) for r in out.select("FillerOrderNo", "no_show_before", "appts_before").collect()] == [(3, 1, 2), (4, 2, 3)]


DAYS = ["start_time", "sched_days_advanced", "sched_days_advanced_busday", "sched_days_advanced_sq", "sched_2_days"]
MOVES = [(day(0), "requested", day(0)), (day(0), "scheduled", day(10)), (day(1), "scheduled", day(14)),
         (day(14), "started", day(14)), (day(14) + minutes(30), "examined", day(14))]


@pytest.mark.parametrize("rows, expected", [
    ([(day(0), "scheduled", day(4)), (day(4), "started", day(4)), (day(4) + minutes(30), "examined", day(4))],
     [(day(4), 4, 4, 16, False)]),
    (MOVES, [(day(14), 13, 9, 169, False)]),
    ([*MOVES[:2], (day(9), "scheduled", day(14)), *MOVES[3:]], [(day(10), 10, 8, 100, False), (day(14), 5, 3, 25, False)]),
])
def test_days_advanced(spark, rows, expected):
    log = status.build_status_log(raw_log(spark, rows))
    out = features.add_days_advanced(log, slots.build_slots(log, RANGE))
    assert records(out, DAYS) == expected


def test_feature_set_one_row(spark):
    log = status.build_status_log(raw_log(spark, [(day(0), "scheduled", day(7))]))
    out = jobs.build_feature_set(log, RANGE, post_codes(spark), "8091")
    assert records(out, ["start_time", "end_time", "NoShow", "sched_days_advanced"]) == [
        (day(7), day(7) + minutes(30), False, 7)]
    row = out.first()
    assert (row["modality"], row["occupation"], row["reason"], row["insurance_class"], row["sex"], row["marital"]) == (
        "other", "hospital_worker", "cancer", "general", 1, "not known")
    assert row["close_to_usz"] and row["age"] == 25 and row["age_20_60"]


def test_feature_set_on_past_slots(spark):
    rows = [(day(0), "scheduled", day(7)), (day(7), "started", day(7)), (day(7) + minutes(30), "examined", day(7))]
    log = status.build_status_log(raw_log(spark, rows))
    out = jobs.build_feature_set(log, RANGE, post_codes(spark), "8091", build_future_slots=False)
    assert records(out, ["start_time", "NoShow", "sched_days_advanced"]) == [(day(7), False, 7)]


@pytest.mark.parametrize("rows, at, expected", [
    ([(day(0), "requested", day(20)), (day(1), "scheduled", day(8))], 2, [(day(8), 7)]),
    ([(day(0), "requested", day(13)), (day(1), "scheduled", day(6)), (day(7), "scheduled", day(16))], 9, [(day(16), 9)]),
    ([(day(0), "requested", day(13)), (day(1), "scheduled", day(8)), (day(2), "canceled", day(8))], 3, []),
])
def test_features_ahead(spark, rows, at, expected):
    log = status.build_status_log(raw_log(spark, rows))
    out = jobs.features_ahead(log, day(at), post_codes(spark), "8091")
    assert records(out, ["start_time", "sched_days_advanced"]) == expected


FOUR = [
    (0, day(0), "requested", day(5)), (0, day(1), "scheduled", day(7)), (0, day(7), "started", day(7)),
    (0, day(7) + minutes(30), "examined", day(7)),
    (1, day(0), "requested", day(13)), (1, day(1), "scheduled", day(8)), (1, day(9), "scheduled", day(16)),
    (2, day(0), "requested", day(13)), (2, day(1), "scheduled", day(9)), (2, day(8), "scheduled", day(13)),
    (3, day(0), "requested", day(13)), (3, day(1), "scheduled", day(9)), (3, day(3), "scheduled", day(13)),
]
PATIENTS = {i: str(i) for i in range(4)}


def four(spark):
    last = {0: "u", 1: "t", 2: "t", 3: "t"}
    raw = raw_log(spark, FOUR, patients=PATIENTS)
    status_of = F.create_map(*[F.lit(x) for kv in last.items() for x in kv])
    return status.build_status_log(raw.withColumn("OrderStatus", status_of[F.col("FillerOrderNo").cast("int")]))


def test_training_data_outcomes(spark):
    out = jobs.training_data(four(spark), [dt.date(2019, 1, 1), dt.date(2019, 1, 13)], post_codes(spark), "8091")
    assert records(out, ["MRNCmpdId", "start_time", "end_time", "NoShow", "slot_outcome", "slot_type", "slot_type_detailed"]) == [
        ("0", day(7), day(7) + minutes(30), False, "show", "show", "show"),
        ("1", day(8), day(8) + minutes(30), True, "rescheduled", "no-show", "hard no-show"),
        ("2", day(9), day(9) + minutes(30), True, "rescheduled", "no-show", "soft no-show"),
        ("3", day(9), day(9) + minutes(30), False, "ok_rescheduled", "ok_rescheduled", "ok_rescheduled"),
    ]


def test_snapshots_equal_single_days(spark):
    log, pc = four(spark).cache(), post_codes(spark)
    all_days = jobs.snapshots(log, day(0), day(20), pc, "8091")
    cols = [c for c in all_days.columns if c != "snapshot"]
    rows = all_days.select(*cols, "snapshot").collect()
    seen = 0
    for n in range(1, 10):
        if day(n).weekday() < 5:
            one = records(jobs.features_ahead(log, day(n), pc, "8091"), cols)
            mine = [tuple(r)[:-1] for r in rows if r["snapshot"] == day(n).date()]
            assert sorted(mine, key=str) == sorted(one, key=str)
            seen += len(one)
    assert seen == len([r for r in rows if r["snapshot"] <= day(9).date()]) > 0


def test_live_file_logs_equal_single_files(spark):
    """Many files in one plan give what each file gives alone."""
    from slotlog.plans import live_jobs

    raw, pc = raw_log(spark, FOUR, patients=PATIENTS), post_codes(spark)
    files = [("out_10_01_2019.csv", dt.date(2019, 1, 10)), ("out_14_01_2019.csv", dt.date(2019, 1, 14))]
    both = raw.withColumn("source_file", F.explode(F.array(*[F.lit(f) for f, _ in files])))
    together = live_jobs.live_features(both, pc, "8091")
    cols = ["FillerOrderNo", "MRNCmpdId", "start_time", "sched_days_advanced", "reason", "no_show_before"]
    total = 0
    for name, date in files:
        made = jobs.shift_business_days(date, -3)
        alone = jobs.features_ahead(status.build_status_log(raw), made, pc, "8091")
        assert records(together.filter(F.col("source_file") == name), cols) == records(alone, cols)
        total += alone.count()
    assert total > 0


def test_live_features_read_the_files_once(spark, tmp_path):
    """Which appointments are due comes from the pass that finds their newest status, not from a second reading of the files."""
    from slotlog.plans import live_jobs

    raw = raw_log(spark, FOUR, patients=PATIENTS).withColumn("source_file", F.lit("out_10_01_2019.csv"))
    raw.write.parquet(str(tmp_path / "files"))
    out = live_jobs.live_features(spark.read.parquet(str(tmp_path / "files")), post_codes(spark), "8091")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
    assert out.count() > 0


def test_due_rows_without_appointment_or_file_date_are_left_out(spark):
    from slotlog.plans import live_jobs

    raw = raw_log(spark, FOUR, patients=PATIENTS).withColumn("source_file", F.lit("out_10_01_2019.csv"))
    odd = raw.withColumn("FillerOrderNo", F.lit(None).cast("long")).unionByName(raw.withColumn("source_file", F.lit("notes.csv")))
    cols = ["source_file", "FillerOrderNo", "MRNCmpdId", "start_time", "made_on", "appts_before"]
    want = records(live_jobs.live_features(raw, post_codes(spark), "8091"), cols)
    assert records(live_jobs.live_features(raw.unionByName(odd), post_codes(spark), "8091"), cols) == want != []


def test_latest_values_skip_nulls_only(spark):
    """A column that can be null gives its latest value, one that cannot its value in the latest row."""
    df = spark.createDataFrame([(1, day(1), 0, "a", "x"), (1, day(2), 1, None, "y"), (1, None, 2, "c", "z")],
                               "FillerOrderNo long, date timestamp_ntz, ingest_seq long, maybe string, text string")
    df = df.withColumn("sure", F.coalesce("text", F.lit("")))
    out = slots._aggregate(df, ["FillerOrderNo"], {"sure": slots.last, "maybe": slots.last, "FillerOrderNo": slots.smallest})
    assert not df.schema["sure"].nullable and out.columns == ["FillerOrderNo", "sure", "maybe", "v__FillerOrderNo"]
    assert records(out, ["sure", "maybe"]) == [("y", "a")]
    plan = slots._aggregate(df.withColumn("also", F.coalesce("text", F.lit("-"))), ["FillerOrderNo"], {"sure": slots.last, "also": slots.last})
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("max_by(") == 1


def test_cascades_last_match_wins(spark):
    df = spark.createDataFrame([("MR SCHÄDEL und Hals",), ("Knie links",), ("x",), ("MRCP",)], "s string")
    assert [r[0] for r in text.add_modality(df, "s").select("modality").collect()] == ["throat", "knee", "other", "organ"]
    jobs_ = spark.createDataFrame([("-",), (None,), ("nan",), ("",), ("IV-Rentner",), ("Schüler",), ("Lehrer",), ("zzz",)], "s string")
    assert [r[0] for r in text.add_occupation(jobs_, "s").select("occupation").collect()] == [
        "none_given", "none_given", "none_given", "unemployed", "iv_retired", "student", "employed", "other"]
    why = spark.createDataFrame([("Tumor bei Rezidiv",), ("nan",), (None,), ("LAESION",), ("q",)], "s string")
    assert [r[0] for r in text.add_reason(why, "s").select("reason").collect()] == [
        "cancer", "none_given", "none_given", "lesion", "other"]


def test_times_rescheduled(spark):
    rows = [(day(0), "scheduled", day(5)), (day(1), "scheduled", day(6)), (day(2), "scheduled", day(7)),
            (day(3), "registered", day(7)), (day(4), "scheduled", day(5)), (day(5), "scheduled", day(9))]
    log = status.build_status_log(raw_log(spark, rows))
    out = status.times_rescheduled(log).orderBy("date")
    assert [r[0] for r in out.select("times_rescheduled").collect()] == [0, 0, 1, 1, 1, 2]
