import os
import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from slotlog.functions import text
from slotlog.operators import cleaning, features, slots, status
from slotlog.plans import live_jobs, model_jobs as M
from slotlog.session import work_dir
from slotlog.sources import files
from slotlog.streaming import daily
from tests.conftest import CODE, day, minutes, post_codes, raw_log, records


def write(path, content, encoding="utf-8"):
    with open(path, "w", encoding=encoding, newline="") as f:
        f.write(content)


@pytest.mark.parametrize("encoding", ["utf-8", "utf-16"])
def test_overflow_rows_are_repaired(spark, tmp_path, encoding):
    write(tmp_path / "a.csv", 'FillerOrderNo,Status,ReasonForStudy\n1,t,Knie\n2,s,"Knie, links"\n3,a,Knie, links, akut\n'
                              '4,"x,y",a,"b, c"\n', encoding)
    out = files.read_overflow_csv(spark, str(tmp_path), ["FillerOrderNo", "Status", "ReasonForStudy"],
                                  encoding="UTF-16" if encoding == "utf-16" else "UTF-8")
    assert records(out, ["FillerOrderNo", "Status", "ReasonForStudy"]) == [
        ("1", "t", "Knie"), ("2", "s", "Knie, links"), ("3", "a", "Knie links akut"), ("4", "x,y", "ab, c")]


def test_utf16_directory_with_names(spark, tmp_path):
    for d in (1, 2):
        write(tmp_path / f"ago_0{d}_02_2022.csv", f'id,text\n{d},"a, ""b"""\n', "utf-16")
    write(tmp_path / "notes.txt", "x", "utf-8")
    df = files.parse_file_name(files.read_directory(spark, str(tmp_path), "id long, text string", "UTF-16"))
    assert [tuple(map(str, r)) for r in records(df, ["id", "text", "source_file", "file_type", "file_date"])] == [
        ("1", 'a, "b"', "ago_01_02_2022.csv", "ago", "2022-02-01"), ("2", 'a, "b"', "ago_02_02_2022.csv", "ago", "2022-02-02")]


def test_unreadable_file_name_has_no_date(spark):
    df = spark.createDataFrame([("ago_31_02_2022.csv",), ("other.csv",)], "source_file string")
    assert [r[0] for r in files.parse_file_name(df).select("file_date").collect()] == [None, None]


def test_append_keeps_changed_rows_and_drops_copies(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = "k long, v string, at timestamp_ntz"
    df = spark.createDataFrame([(1, "a", day(0)), (2, "b", day(1)), (2, "b", day(1)), (4, None, None)], schema)
    for _ in range(2):
        files.append_distinct(spark, path, df, "at")
    files.append_distinct(spark, path, spark.createDataFrame([(2, "z", day(1)), (3, "c", day(1)), (2, "b", day(1))], schema), "at")
    assert records(spark.read.parquet(path), ["k", "v"]) == [(1, "a"), (2, "b"), (2, "z"), (3, "c"), (4, None)]
    plan = files.rows_of_months(spark, path, files.with_month(df, "at"))._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "part_month" in plan.split("PartitionFilters: [")[1].split("]")[0]


def feed(spark, folder, schema, *batches):
    """One file per batch, to be taken one by one in this order."""
    import os
    import time

    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        for name in os.listdir(folder):  # file times are the order of arrival
            path = os.path.join(folder, name)
            if name.startswith("part") and os.path.getmtime(path) > time.time() - 86_400:
                os.utime(path, (time.time() - 200_000 + 1000 * i,) * 2)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_no_outcome_comes_too_late(spark, tmp_path):
    far = day(6 * 365)
    stream = feed(spark, tmp_path / "in", "k long, start_time timestamp_ntz, v string",
                  [(1, day(0), "a"), (2, far, "b")], [(3, day(1), "c"), (1, day(0), "later copy")], [(4, day(0), "d"), (2, far, "x"), (4, day(0), "c")])
    table = str(tmp_path / "out")
    daily.dedup_actuals(stream, table, str(tmp_path / "ledger"), ["k", "start_time"], order=["v"]).awaitTermination()
    assert records(spark.read.parquet(table), ["k", "v"]) == [(1, "a"), (2, "b"), (3, "c"), (4, "c")]


def test_no_day_comes_too_late(spark, tmp_path):
    schema = "image_device_id int, image_start timestamp_ntz, image_end timestamp_ntz"
    one = lambda n: (1, day(n), day(n, 9, 30))
    stream = feed(spark, tmp_path / "in", schema, [one(9)], [one(4), one(9)], [one(5)])
    daily.daily_active(stream, str(tmp_path / "out"), str(tmp_path / "ledger")).awaitTermination()
    assert records(daily.daily_totals(spark, str(tmp_path / "out")), ["date", "active_minutes", "appointments"]) == [
        (day(4, 0), 30.0, 1), (day(5, 0), 30.0, 1), (day(9, 0), 60.0, 2)]


def test_work_dir_follows_the_session(spark):
    assert os.path.isabs(work_dir(spark, "x"))
    cluster = SimpleNamespace(conf={"spark.checkpoint.dir": "/shared"}, sparkContext=SimpleNamespace(master="yarn"))
    assert work_dir(cluster, "x").startswith("/shared/x-")
    with pytest.raises(ValueError):
        work_dir(SimpleNamespace(conf={}, sparkContext=cluster.sparkContext), "x")


def test_clamp_and_dirty_values(spark):
    rows = [("2020-01-02 03:04:05", "12"), ("2999-01-02 03:04:05", "1e3"), ("9000-01-01 00:00:00.0000000", "x"), (None, "12f"),
            ("nan", " 7 ")]
    df = spark.createDataFrame(rows, "MessageDtTm string, n string")
    assert [r[0] for r in df.select(text.clamp_year(F.col("MessageDtTm"))).collect()] == [
        "2020-01-02 03:04:05", "2100-01-02 03:04:05", None, None, "nan"]
    assert [r[0] for r in df.select(text.numbers_only(F.col("n"))).collect()] == ["12", "1e3", None, None, " 7 "]
    out = cleaning.cast_datetime_columns(df, clamp=True)
    assert [r[0].year for r in out.select("MessageDtTm").collect()] == [2020, 2100]
    assert cleaning.cast_datetime_columns(df).count() == 5


def test_prepare_raw_ignores_missing_columns(spark):
    df = spark.createDataFrame([("nan", "8001.0", "x"), ("A", "CH", "y")], "Klasse string, Zip string, StationTelefon string")
    assert records(cleaning.prepare_raw(df), ["Klasse", "Zip"]) == [("A", None), (None, "8001")]
    assert "StationTelefon" not in cleaning.prepare_raw(df).columns


HEADER = ("FillerOrderNo,MRNCmpdId,History_MessageDtTm,ingest_seq,History_OrderStatus,History_ObsStartPlanDtTm,PatientClass,"
          "EnteringOrganisationDeviceID,UniversalServiceName,OrderStatus,Klasse,Sex,DateOfBirth,Zivilstand,Zip,Beruf,"
          "ReasonForStudy,Telefon")


def live_file(path, rows, final):
    lines = [HEADER]
    for i, (fon, patient, t, s, p) in enumerate(rows):
        lines.append(f"{fon},{patient},{t:%Y-%m-%d %H:%M:%S},{i},{CODE[s]},{p:%Y-%m-%d %H:%M:%S},ambulant,MR1,MR Knie,{CODE[final]},A,"
                     "weiblich,1994-03-05,UNB,8001.0,Arzt,cancer,0")
    write(path, "\n".join(lines) + "\n", "utf-16")


SCHEMA = ", ".join(f"{c} string" if c not in ("FillerOrderNo", "ingest_seq") else f"{c} long" for c in HEADER.split(","))


def come(fon, patient, at):
    return [(fon, patient, day(0), "scheduled", at), (fon, patient, at, "started", at), (fon, patient, at + minutes(20), "examined", at)]


def test_outcome_stream_works_off_new_files_once(spark, tmp_path):
    src = tmp_path / "ago"
    src.mkdir()
    table, checkpoint = str(tmp_path / "actuals"), str(tmp_path / "ledger")

    def run():
        stream = daily.read_files(spark, str(src), SCHEMA, ignore=["ago_09_01_2019.csv"])
        daily.outcomes(stream, table, checkpoint).awaitTermination()
        return records(spark.read.parquet(table), ["file", "FillerOrderNo", "start_time", "NoShow"])

    live_file(src / "ago_05_01_2019.csv", come(1, "7", day(4)) + come(2, "SMS1", day(4)) + come(3, "8", day(5)), "examined")
    live_file(src / "ago_09_01_2019.csv", come(5, "7", day(8)), "examined")
    first = [("ago_05_01_2019.csv", 1, day(4), False)]
    assert run() == first
    assert run() == first
    # The same appointment number in a second file is a log of its own.
    live_file(src / "ago_07_01_2019.csv", come(1, "7", day(6)), "examined")
    assert run() == [*first, ("ago_07_01_2019.csv", 1, day(6), False)]


def test_score_stream(spark, tmp_path):
    src = tmp_path / "out"
    src.mkdir()
    history = spark.createDataFrame(
        [("7", 90, day(-9), True), ("8", 91, day(-8), False), ("7", 92, day(-7), False)],
        "MRNCmpdId string, FillerOrderNo long, start_time timestamp_ntz, NoShow boolean")
    training = features.add_no_show_before(history).withColumn("label", F.col("NoShow").cast("int"))
    model = M.train(training, M.feature_stages(["no_show_before"]), M.logistic(strength=0.1, max_iter=3))
    table, checkpoint = str(tmp_path / "predictions"), str(tmp_path / "ledger")
    actuals = str(tmp_path / "actuals")
    spark.createDataFrame([("7", day(8), True)], "MRNCmpdId string, start_time timestamp_ntz, NoShow boolean").write.parquet(actuals)

    def run():
        stream = daily.read_files(spark, str(src), SCHEMA, max_files=1)
        daily.scores(stream, table, checkpoint, {"lr": model}, history, post_codes(spark), "8091", actuals=actuals).awaitTermination()
        return records(spark.read.parquet(table), ["source_file", "FillerOrderNo", "start_time", "no_show_before", "appts_before"])

    live_file(src / "out_08_01_2019.csv", [(1, "7", day(0), "scheduled", day(8)), (2, "8", day(0), "scheduled", day(20))], "scheduled")
    first = [("out_08_01_2019.csv", 1, day(8), 1, 2)]
    assert run() == first
    # The first prediction has an outcome by now, so it counts as history of the next one.
    live_file(src / "out_14_01_2019.csv", [(3, "7", day(0), "scheduled", day(14))], "scheduled")
    assert run() == [*first, ("out_14_01_2019.csv", 3, day(14), 2, 3)]
    assert spark.read.parquet(table).filter("prediction_lr > 0 and prediction_lr < 1").count() == 2


# file, appointment, no-shows and appointments before
SCORED = [
    ("out_08_01_2019.csv", 70, 1, 1), ("out_08_01_2019.csv", 71, 0, 1), ("out_08_01_2019.csv", 72, 1, 2),
    ("out_09_01_2019.csv", 80, 2, 3), ("out_09_01_2019.csv", 81, 0, 2), ("out_09_01_2019.csv", 82, 2, 4),
    ("out_10_01_2019.csv", 90, 2, 5), ("out_10_01_2019.csv", 91, 0, 2), ("out_10_01_2019.csv", 92, 2, 7),
    ("out_11_01_2019.csv", 100, 2, 7), ("out_11_01_2019.csv", 102, 2, 8),
]


@pytest.mark.parametrize("feedback", [True, False])
@pytest.mark.parametrize("max_files", [1, 3, None])
def test_scores_do_not_depend_on_the_batches(spark, tmp_path, max_files, feedback):
    src = tmp_path / "out"
    src.mkdir()
    history = spark.createDataFrame([("7", 90, day(-9), True), ("8", 91, day(-8), False), ("7", 92, day(9), False)],
                                    "MRNCmpdId string, FillerOrderNo long, start_time timestamp_ntz, NoShow boolean")
    training = features.add_no_show_before(history).withColumn("label", F.col("NoShow").cast("int"))
    model = M.train(training, M.feature_stages(["no_show_before"]), M.logistic(strength=0.1, max_iter=3))
    actuals = str(tmp_path / "actuals")
    spark.createDataFrame([("7", day(7), True), ("8", day(9), False)], "MRNCmpdId string, start_time timestamp_ntz, NoShow boolean").write.parquet(actuals)
    for i, n in enumerate([7, 8, 9, 10]):
        rows = [(10 * n + k, p, day(0), "scheduled", day(n + k % 2, 9 + k)) for k, p in enumerate("787")]
        live_file(src / f"out_{n + 1:02d}_01_2019.csv", rows, "scheduled")
        os.utime(src / f"out_{n + 1:02d}_01_2019.csv", (1_600_000_000 + i * 100,) * 2)
    stream = daily.read_files(spark, str(src), SCHEMA, max_files=max_files)
    table = str(tmp_path / "predictions")
    daily.scores(stream, table, str(tmp_path / "ledger"), {"lr": model}, history, post_codes(spark), "8091",
                 actuals=actuals if feedback else None).awaitTermination()
    got = records(spark.read.parquet(table), ["source_file", "FillerOrderNo", "no_show_before", "appts_before"])
    if not feedback:  # then only the history and the file's own earlier slots count
        late = {90: (1, 1), 92: (1, 3), 100: (1, 2), 102: (1, 3)}
        assert got == [(f, n, *late.get(n, (int(n % 10 != 1), 2 if n % 10 == 2 else 1))) for f, n, _, _ in SCORED]
        return
    # Only the history, outcomes of earlier files up to the newest known one, and the file's own earlier slots count.
    assert got == SCORED


@pytest.mark.parametrize("n_files, feedback, hot", [(1, True, False), (5, True, False), (6, False, False), (9, True, True)])
def test_history_as_known_equals_file_after_file(spark, n_files, feedback, hot):
    """Against the plain way: one file after the other, each against what was known by then."""
    from slotlog.operators import ordered

    rng = random.Random(n_files)
    keys = "MRNCmpdId string, FillerOrderNo long, start_time timestamp_ntz, NoShow boolean"
    past = [(str(rng.randrange(3)), 1000 + i, day(rng.randrange(30)), rng.random() < 0.4) for i in range(40)]
    own = []
    for k in range(n_files):
        for fon in rng.sample(range(40), 14):
            own.append((f"out_{k + 1:02d}_01_2019.csv", str(fon % 3), fon, day(rng.choice([fon % 30, 10 + fon % 20])), False))
        p = rng.choice(past)
        own.append((f"out_{k + 1:02d}_01_2019.csv", *p[:3], False))
    own = list(dict.fromkeys(own))
    known = [(p, s, rng.random() < 0.5) for p, s in {(r[1], r[3]) for r in own if rng.random() < 0.6} if s < day(24)]
    newest = max((s for _, s, _ in known), default=None)
    outcome = {(p, s): x for p, s, x in known}

    done, want = set(), []
    for name in sorted({r[0] for r in own}):
        mine = {(r[1], r[2], r[3]): r[4] for r in own if r[0] == name}
        seen = {p[:3]: p[3] for p in past}
        if feedback and newest is not None:
            seen |= {d: outcome.get((d[0], d[2]), False) for d in done if d[2] <= newest}
        all_ = [(s, f, p, x) for (p, f, s), x in [*mine.items(), *((k, v) for k, v in seen.items() if k not in mine)]]
        for (p, f, s) in mine:
            if (p, f, s) not in seen:
                before = [x for s2, f2, p2, x in all_ if p2 == p and (s2, f2) < (s, f)]
                want.append((name, f, s, len(before), sum(before)))
                done.add((p, f, s))
    got = live_jobs.history_as_known(
        spark.createDataFrame(own, f"source_file string, {keys}"), spark.createDataFrame(past, keys),
        spark.createDataFrame(known, "MRNCmpdId string, start_time timestamp_ntz, NoShow boolean") if feedback else None,
        ordered.find_hot_chunks(spark.createDataFrame([r[1:] for r in own] + past, keys), ["MRNCmpdId"], ["start_time", "FillerOrderNo"], min_rows=5, rows_per_chunk=8) if hot else None)
    assert sorted(records(got, ["source_file", "FillerOrderNo", "start_time", "appts_before", "no_show_before"])) == sorted(want)


def test_late_outcomes_are_held_back(spark):
    preds = spark.createDataFrame([(i, "7", day(i), False) for i in range(4)],
                                  "FillerOrderNo long, MRNCmpdId string, start_time timestamp_ntz, NoShow boolean")
    actual = spark.createDataFrame([("7", day(1), True), ("8", day(2), True)], "MRNCmpdId string, start_time timestamp_ntz, NoShow boolean")
    assert records(live_jobs.attach_late_outcome(preds, actual), ["FillerOrderNo", "NoShow"]) == [(0, False), (1, True), (2, False)]


def test_daily_active_stream(spark, tmp_path):
    schema = "image_device_id int, image_start timestamp_ntz, image_end timestamp_ntz"
    spark.createDataFrame([(1, day(0), day(0, 10)), (1, day(0, 12), day(0, 12, 30)), (2, day(1), day(1, 9, 15))], schema).write.parquet(
        str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    daily.daily_active(stream, str(tmp_path / "out"), str(tmp_path / "ledger")).awaitTermination()
    assert records(daily.daily_totals(spark, str(tmp_path / "out")), ["date", "image_device_id", "active_minutes", "appointments"]) == [
        (day(0, 0), 1, 90.0, 2), (day(1, 0), 2, 15.0, 1)]


def test_assembled_files_drop_copies(spark):
    raw = raw_log(spark, [(day(0), "scheduled", day(4)), (day(4), "started", day(4)), (day(4) + minutes(30), "examined", day(4))])
    both = raw.withColumn("source_file", F.explode(F.array(F.lit("a.csv"), F.lit("b.csv"))))
    log = live_jobs.assemble_status(both, spark.createDataFrame([(0, "x")], "FillerOrderNo long, ReasonForStudy string"))
    assert log.count() == status.build_status_log(raw).count() == 3
    assert slots.build_slots(log, ["2019-01-01", "2019-02-01"]).count() == 1
