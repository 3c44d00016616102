"""A key that holds most of the table is cut into chunks; results must not change."""

import datetime as dt
import random
import uuid

import pytest
from pyspark.sql import functions as F

from slotlog import carriers as C
from slotlog.operators import describe, features, images, ordered, scoring, slots, status, utilisation as U
from slotlog.plans import feature_jobs as jobs

SF = "/root/testdata/sf0.001"
SMALL = {"min_rows": 10, "rows_per_chunk": 40}


def same(a, b):
    cols = sorted(c for c in a.columns if not c.startswith("chunk__"))
    a, b = a.select(*cols), b.select(*cols)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    return a.count()


@pytest.fixture(scope="module")
def skewed(spark):
    """Half of the rows belong to key 1; values and order have gaps and ties."""
    rng = random.Random(3)
    rows = [(1 if i % 2 else 2 + rng.randrange(40), dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randrange(300)), i,
             None if rng.random() < 0.5 else rng.randrange(50)) for i in range(800)]
    rows += [(1, None, 900 + i, i) for i in range(3)]
    return spark.createDataFrame(rows, "k long, t timestamp_ntz, seq long, v long").cache()


NAMES = ["lag", "lead", "sum_before", "previous_value", "first_value_so_far", "min_so_far", "next_value", "key_min", "key_max",
         "key_sum", "key_count", "key_first", "key_last"]


def test_every_ordered_column(skewed):
    chunked = ordered.split_hot_keys(skewed, ["k"], ["t", "seq"], **SMALL)
    assert chunked.select("chunk__k").distinct().count() > 5
    columns = {n: getattr(ordered, n)(F.col("v")) for n in NAMES} | {"rows_before": ordered.rows_before()}
    order = ["t", "seq"]
    assert same(ordered.with_ordered(skewed, ["k"], order, columns), ordered.with_ordered(chunked, ["k"], order, columns)) == 803


def test_equal_order_values(skewed):
    chunked = ordered.split_hot_keys(skewed, ["k"], "t", **SMALL)
    col = {"x": ordered.smaller_before()}
    same(ordered.with_ordered(skewed.filter("t is not null"), ["k"], ["t"], col),
         ordered.with_ordered(chunked.filter("t is not null"), ["k"], ["t"], col))


def test_chunks_are_bounded(skewed):
    chunked = ordered.split_hot_keys(skewed, ["k"], "t", **SMALL)
    largest = chunked.filter("chunk__k is not null").groupBy("k", "chunk__k").count().agg(F.max("count")).first()[0]
    assert largest <= 3 * SMALL["rows_per_chunk"]
    assert chunked.filter("k = 1 and chunk__k is null").count() == 0


def test_rows_of_one_time_are_split_by_what_breaks_ties(spark):
    """A third of all rows on one key at one identical time."""
    rows = [(1, dt.datetime(2024, 1, 2), i, i % 5) for i in range(400)] + [(2 + i % 30, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), i, i) for i in range(600)]
    rows += [(1, dt.datetime(2024, 1, 1), 1000, 3), (1, dt.datetime(2024, 1, 3), 1001, 4), (1, None, 1002, None)]
    df = spark.createDataFrame(rows, "k long, t timestamp_ntz, seq long, v long")
    chunked = ordered.split_hot_keys(df, ["k"], ["t", "seq"], **SMALL)
    sizes = [r["count"] for r in chunked.filter("k = 1").groupBy("chunk__k").count().collect()]
    assert len(sizes) > 5 and max(sizes) <= 3 * SMALL["rows_per_chunk"]
    columns = {n: getattr(ordered, n)(F.col("v")) for n in NAMES} | {"rows_before": ordered.rows_before()}
    assert same(ordered.with_ordered(df, ["k"], ["t", "seq"], columns), ordered.with_ordered(chunked, ["k"], ["t", "seq"], columns)) == 1003


def test_borders_follow_the_order_where_columns_are_missing(spark):
    """A table without the column that breaks ties has its rows before all others of the same time."""
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1 + i // 50), i) for i in range(300)], "k long, t timestamp_ntz, seq long")
    chunks = ordered.find_hot_chunks(df, ["k"], ["t", "seq"], **SMALL)
    probes = chunks.add(df.select("k", "t").distinct(), ["t", "seq"]).select("t", F.col("chunk__k").alias("p"))
    rows = chunks.add(df, ["t", "seq"]).groupBy("t").agg(F.min("chunk__k").alias("lo"), F.max("chunk__k").alias("hi")).join(probes, "t").orderBy("t").collect()
    assert all(r.p <= r.lo for r in rows) and all(a.hi <= b.p for a, b in zip(rows, rows[1:], strict=False))


def test_hot_patients_with_history(spark):
    """A patient with a third of all slots, most of them at one time."""
    df = C.slots(spark, SF).withColumn("MRNCmpdId", F.when(F.col("FillerOrderNo") % 3 == 0, "1").otherwise(F.col("MRNCmpdId"))).withColumn(
        "start_time", F.when(F.col("FillerOrderNo") % 9 != 3, F.col("start_time")).otherwise(F.lit(dt.datetime(1996, 1, 1))))
    new, history = df.filter("FillerOrderNo % 4 = 0"), df.filter("FillerOrderNo % 5 <> 0")
    hot = ordered.find_hot_chunks(df, ["MRNCmpdId"], ["start_time", "FillerOrderNo"], **SMALL)
    assert hot.most > 5
    assert same(features.add_no_show_before(new, history), features.add_no_show_before(new, history, patients=hot)) > 0


def test_hot_patients_of_the_feature_set_and_the_live_table(spark, monkeypatch):
    from slotlog.plans import live_jobs

    log = status.build_status_log(hot_log(spark)).cache()
    pc, rng = C.post_codes(spark, SF), ["2024-01-01", "2024-02-15"]
    hot = ordered.find_hot_chunks(log, ["MRNCmpdId"], ["now_sched_for_date", "FillerOrderNo"], **SMALL)
    assert hot.most > 5
    assert same(jobs.build_feature_set(log, rng, pc, C.SITE_POST_CODE), jobs.build_feature_set(log, rng, pc, C.SITE_POST_CODE, patients=hot)) > 0
    raw = C.status(spark, SF).withColumn("source_file", F.concat(F.lit("out_"), F.date_format("History_ObsStartPlanDtTm", "dd_MM_yyyy"), F.lit(".csv")))
    history = slots.build_slots(log, rng).cache()
    args = (raw, log, rng, history, pc, C.SITE_POST_CODE)
    plain = live_jobs.retrospective_features(*args).cache()
    monkeypatch.setattr(live_jobs, "hot_patients", lambda df: ordered.find_hot_chunks(df, ["MRNCmpdId"], ["start_time", "FillerOrderNo"], **SMALL))
    assert live_jobs.hot_patients(history).hot > 0
    assert same(plain, live_jobs.retrospective_features(*args)) > 0


def test_a_small_table_costs_one_job(spark, skewed):
    """It is stored and counted, nothing more; the sketch of a large one is one job, the borders another."""
    jobs_of = lambda f: _jobs(spark, f)
    skewed.count()
    assert jobs_of(lambda: ordered.find_hot_chunks(skewed, ["k"], "t")) == jobs_of(skewed.count)
    assert jobs_of(lambda: ordered.candidate_keys(skewed, ["k"], 803, 10)) <= jobs_of(skewed.count)


def _jobs(spark, f):
    group = f"jobs-{uuid.uuid4()}"
    spark.sparkContext.setJobGroup(group, group)
    f()
    n = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup("other", "other")
    return n


def test_small_tables_are_left_alone(skewed):
    assert ordered.split_hot_keys(skewed, ["k"], "t").columns == skewed.columns
    assert ordered.find_hot_chunks(skewed, ["k"], "t", at_most=100) is None


def hot_log(spark):
    """A third of the log on one appointment."""
    raw = C.status(spark, SF)
    fon = F.when(F.col("ingest_seq") % 3 == 0, F.lit(100)).otherwise(F.col("FillerOrderNo"))
    patient = F.when(F.col("ingest_seq") % 3 == 0, F.lit("1")).otherwise(F.col("MRNCmpdId"))
    return raw.withColumns({"FillerOrderNo": fon, "MRNCmpdId": patient, "EnteringOrganisationDeviceID": F.lit("MR1")})


def test_status_slots_and_times_rescheduled(spark):
    raw = hot_log(spark).cache()
    hot = ordered.split_hot_keys(raw, status.KEY, ["History_MessageDtTm", "ingest_seq"], **SMALL)
    assert hot.filter("chunk__FillerOrderNo is not null").select("chunk__FillerOrderNo").distinct().count() > 5
    a, b = status.build_status_log(raw), status.build_status_log(hot)
    assert same(a, b) > 0
    assert same(status.times_rescheduled(a), status.times_rescheduled(b)) > 0
    rng = ["2024-01-01", "2024-02-15"]
    assert same(slots.build_slots(a, rng), slots.build_slots(b, rng)) > 0


def test_training_data(spark):
    raw = hot_log(spark)
    log = status.build_status_log(raw).cache()
    find = lambda k, by: ordered.find_hot_chunks(log, k, by, **SMALL)
    chunks = jobs.LogChunks(find(["FillerOrderNo"], ["date", "ingest_seq"]), find(["MRNCmpdId"], ["now_sched_for_date", "FillerOrderNo"]))
    assert chunks.appointments and chunks.patients
    args = (["2024-01-01", "2024-02-15"], C.post_codes(spark, SF), C.SITE_POST_CODE)
    a = jobs.training_data(log, *args, chunks=jobs.LogChunks()).cache()
    b = jobs.training_data(log, *args, chunks=chunks).cache()
    assert same(a, b) > 0


def test_no_show_before(spark):
    df = C.slots(spark, SF).withColumn("MRNCmpdId", F.when(F.col("FillerOrderNo") % 3 == 0, "1").otherwise(F.col("MRNCmpdId")))
    hot = ordered.split_hot_keys(df, ["MRNCmpdId"], "start_time", **SMALL)
    assert "chunk__MRNCmpdId" in hot.columns
    same(features.add_no_show_before(df), features.add_no_show_before(hot))


def test_images_and_machine_days(spark, monkeypatch):
    im = C.images(spark, SF).withColumn("AccessionNumber", F.expr("cast(SeriesUID div 40 as string)"))
    plain = images.preprocess(im)
    times = C.intervals(spark, SF)
    hours = U.fill_calendar(U.opening_hours(C.raster(spark, SF)), dt.date(2024, 2, 1))
    gaps = U.idle_gaps(times, hours, 5)
    real = ordered.split_hot_keys
    used = []

    def eager(df, keys, by, **kw):
        out = real(df, keys, by, **{**kw, "min_rows": 3, "rows_per_chunk": 2})
        used.append(ordered.chunk_column(keys) in out.columns)
        return out

    monkeypatch.setattr(ordered, "split_hot_keys", eager)
    assert same(plain, images.preprocess(im, split_hot=True)) > 0
    assert same(gaps, U.idle_gaps(times, hours, 5, split_hot=True)) > 0
    assert used == [True, True]


def test_curves_and_quantiles(spark, monkeypatch):
    df = scoring.stack_models(C.scores(spark, SF), {"a": "score", "b": "score_b"}).cache()
    metrics = scoring.classification_metrics(df)
    table = scoring.evaluation_table(df)
    lengths = C.scores(spark, SF)
    quant = describe.exact_quantiles(lengths, ["l_linestatus"], "l_extendedprice", {"q": 0.25, "m": 0.5})
    monkeypatch.setattr(ordered, "HOT_MIN_ROWS", 100)
    real = ordered.find_hot_chunks
    monkeypatch.setattr(ordered, "find_hot_chunks", lambda d, k, by, **kw: real(
        d, k, by, **{**kw, "min_rows": 10, "rows_per_chunk": 200}))
    rounded = lambda d: d.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in d.dtypes])
    assert "chunk__model" not in scoring.cumulative(df).columns
    same(rounded(metrics), rounded(scoring.classification_metrics(df)))
    same(rounded(table), rounded(scoring.evaluation_table(df)))
    same(rounded(quant), rounded(describe.exact_quantiles(lengths, ["l_linestatus"], "l_extendedprice", {"q": 0.25, "m": 0.5})))


def test_random_rank_is_a_permutation_in_any_partitioning(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 3).alias("g"))
    a = ordered.with_random_rank(df, ["g"], ["id"], seed=1)
    b = ordered.with_random_rank(df.repartition(7), ["g"], ["id"], seed=1, rows_per_chunk=50)
    same(a, b)
    for g, n, lo, hi, d in a.groupBy("g").agg(F.count("*"), F.min("random_rank"), F.max("random_rank"),
                                             F.count_distinct("random_rank")).collect():
        assert (lo, hi, d) == (0, n - 1, n)
    other = ordered.with_random_rank(df, ["g"], ["id"], seed=2)
    assert a.exceptAll(other).count() > 500
