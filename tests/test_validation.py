import pytest

from slotlog.operators import describe, validation as V
from tests.conftest import day, records

OBS = "patient_id string, date string, start_time string, machine string, type string, date_recorded string"


def obs(spark, *rows):
    """Rows (day of the slot, hour, type, recorded on)."""
    text = lambda n: day(n).strftime("%Y-%m-%d")
    return spark.createDataFrame([("1", text(d), f"{h:02d}:00:00", "MR1", t, text(r)) for d, h, t, r in rows], OBS)


@pytest.mark.parametrize("rows, expected", [
    ([(3, 9, "ter", 0), (3, 9, "bef", 6)], [(-3, "ter", "bef", None, None)]),          # last seen too early
    ([(2, 9, "ter", 1), (2, 9, "bef", 3)], [(-1, "ter", "bef", False, "show")]),
    ([(2, 9, "ter", 0), (2, 9, "ter", 1)], [(-1, "ter", None, True, "rescheduled")]),
    ([(2, 9, "ter", 1), (2, 9, "ter", 3)], [(-1, "ter", "ter", True, "canceled")]),
    ([(1, 0, "ter", 0), (1, 0, "bef", 2)], [(-1, "ter", "bef", False, "show")]),
    ([(1, 0, "ter", 0)], [(-1, "ter", None, False, None)]),
    ([(1, 9, "bef", 2)], [(None, None, "bef", False, "show")]),
    ([(1, 9, "unt", 2)], [(None, None, "unt", None, "show")]),
])
def test_observed_slots(spark, rows, expected):
    out = V.label_pairs(V.pair_observations(V.build_observations(obs(spark, *rows))))
    assert records(out, ["date_diff_before", "type_before", "type_after", "NoShow", "slot_outcome"]) == expected


def test_test_patients_are_left_out(spark):
    assert V.build_observations(obs(spark, (1, 9, "ter", 0)), ["1"]).count() == 0


SLOT = "MRNCmpdId string, FillerOrderNo long, start_time timestamp_ntz, slot_outcome string"
SEEN = "patient_id long, date timestamp_ntz, start_time timestamp_ntz, slot_outcome string"


@pytest.fixture
def sources(spark):
    seen = [(1, 1, "show"), (2, 1, "show"), (3, 1, "canceled"), (4, 2, "rescheduled"), (5, 2, None)]
    made = [("1", 1, "show"), ("2", 1, "canceled"), ("9", 1, "show"), ("4", 2, "rescheduled"), ("7", 9, "show")]
    a = spark.createDataFrame([(p, day(d, 0), day(d), o) for p, d, o in seen], SEEN)
    b = spark.createDataFrame([(p, i, day(d), o) for i, (p, d, o) in enumerate(made)], SLOT)
    return a, b


def test_jaccard(sources):
    got = dict(V.jaccard(*sources).select("slot_outcome", "jaccard").collect())
    assert got == {"show": pytest.approx(1 / 3), "canceled": 0.0, "rescheduled": 1.0}


def test_empty_sets_agree(spark, sources):
    a, b = sources
    got = dict(V.jaccard(a.filter("slot_outcome = 'show'"), b.filter("slot_outcome = 'show'")).collect())
    assert got["canceled"] == got["rescheduled"] == 1.0


def test_confusion_matrix(sources):
    got = [tuple(r) for r in V.confusion_matrix(*sources).orderBy("position").drop("position").collect()]
    assert got == [("show", 1, 0, 1, 0), ("rescheduled", 0, 1, 0, 0), ("canceled", 0, 0, 0, 1), ("not present", 1, 0, 0, 0)]


def test_per_day(sources):
    got = {(r["day"], r["slot_outcome"]): r for r in V.outcomes_per_day(*sources).collect()}
    assert len(got) == 6
    r = got[(day(1).date(), "show")]
    assert (r["in_observed"], r["in_extract"], r["only_observed"], r["only_extract"], r["in_both"]) == (2, 2, 1, 1, 1)
    assert got[(day(2).date(), "show")]["jaccard"] == 1.0


def test_buckets_have_empty_cells(spark):
    rows = [("a", False), ("b", True), ("b", True), ("c", False), ("c", True), ("c", True), ("c", True)]
    out = describe.no_show_buckets(spark.createDataFrame(rows, "MRNCmpdId string, NoShow boolean"))
    got = {(r[0], r[1]): r[2] for r in out.collect()}
    assert len(got) == 12 and got[("1", "0")] == 1 and got[("2", "2")] == 1 and got[(">2", ">2")] == 1
    assert sum(got.values()) == 3


def test_exact_quantiles(spark):
    import numpy as np

    values = [float(x) for x in np.random.default_rng(0).integers(0, 30, 101)]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 1.0)], "k string, v double")
    got = {r["k"]: r for r in describe.exact_quantiles(df, ["k"], "v", {"q": 0.25, "m": 0.5, "p": 0.9}).collect()}
    assert [got["a"][n] for n in ("q", "m", "p")] == pytest.approx([np.quantile(values, q) for q in (0.25, 0.5, 0.9)])
    assert got["b"]["m"] == 1.0


def test_intervention(spark):
    slot = "FillerOrderNo long, start_time timestamp_ntz, NoShow boolean, file string, control string"
    calls = spark.createDataFrame([(1, day(1), None, "a", "intervention"), (2, day(1), None, "a", "control"),
                                   (3, day(1), None, "a", "intervention"), (4, day(9), None, "a", "control"),
                                   (1, day(1), None, "b", "control")], slot)
    actuals = spark.createDataFrame([(1, day(1), True), (2, day(1), False), (9, day(5), False)],
                                    "FillerOrderNo long, start_time timestamp_ntz, NoShow boolean")
    feedback = spark.createDataFrame([(3, day(1), "delete"), (1, day(1), "comes")],
                                     "FillerOrderNo long, start_time timestamp_ntz, feedback string")
    out = describe.prepare_intervention(calls, actuals, feedback)
    assert records(out, ["FillerOrderNo", "control", "feedback", "NoShow"]) == [
        (1, "control", "control", True), (2, "control", "control", False)]
    got = {r["grain"]: r for r in describe.intervention_results(out).collect()}
    assert got["control"]["n"] == 2 and got["control"]["rate"] == 0.5 and got["reached_2"]["no_shows"] == 1
