"""Scores, splits, metrics and models."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from slotlog import carriers as C
from slotlog import constants as K
from slotlog.functions.hashes import PRIME, grid_sql, keyed_hash_sql, permuted_place_sql, row_hash_sql
from slotlog.operators import scoring
from slotlog.plans import live_jobs, model_jobs as M
from slotlog.registry import query
from slotlog.registry.describe_queries import P
from slotlog.registry.feature_queries import F_SLOTS, finished
from slotlog.registry.sql import select
from slotlog.session import cut_lineage, work_dir

#: What tells rows apart: whole numbers, so that every engine hashes them alike.
ROW = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_cents"]
MODELS = {"a": "score", "b": "score_b"}


def scored(spark, sf):
    return C.scores(spark, sf)


def stacked(spark, sf):
    return scoring.stack_models(scored(spark, sf), MODELS)


LONG = f"{P}, m as (select 'a' as model, label, score from p union all select 'b', label, score_b from p)"


@query("clip_probability", select(P, "l_orderkey, l_linenumber, round(least(greatest(score, 1e-5), 1 - 1e-5), 6) as prediction", "p"))
def _(spark, sf):
    df = scored(spark, sf).withColumn("probability", array_to_vector(F.array(1 - F.col("score"), F.col("score"))))
    return scoring.positive_probability(df, name="prediction").select("l_orderkey", "l_linenumber", "prediction")


# ---------------------------------------------------------------- call lists

_SCORE = "cast(cast(floor(price * 100 + 0.5) as bigint) % 10007 as double) / 10007"
_FILE_DAY = "date_trunc('week', start_time) + to_days(case when isodow(start_time) >= 4 then 3 else 0 end)"
_CALLS = f"""{F_SLOTS}, c as (select *, {_SCORE} as score, cast({_FILE_DAY} as date) as file_date,
  strftime({_FILE_DAY}, 'features_%Y_%m_%d.csv') as filename from f)"""


def calls(spark, sf):
    thursday = F.weekday("start_time") >= 3
    week = F.date_trunc("week", "start_time").cast("date")
    return finished(spark, sf).withColumns({
        "score": F.expr(_SCORE), "file_date": F.date_add(week, F.when(thursday, 3).otherwise(0)),
    }).withColumn("filename", F.concat(F.lit("features_"), F.date_format("file_date", "yyyy_MM_dd"), F.lit(".csv")))


@query("topk_per_file", select(_CALLS, "filename, FillerOrderNo, start_time, round(score, 6) as prediction", "c", """
  where dayname(file_date) = 'Monday' and dayname(start_time) in ('Monday', 'Tuesday', 'Wednesday')
    or dayname(file_date) = 'Thursday' and dayname(start_time) in ('Thursday', 'Friday')
  qualify row_number() over (partition by filename order by score desc, FillerOrderNo, start_time)
    <= case dayname(file_date) when 'Monday' then 6 else 4 end"""))
def _(spark, sf):
    return scoring.top_per_file(calls(spark, sf)).select("filename", "FillerOrderNo", "start_time", "prediction")


def _two_files(df):
    a = df.withColumns({"filename": F.lit("f1.csv"), "prediction": F.when(F.col("FillerOrderNo") % 5 != 0, F.col("score"))})
    b = df.filter("FillerOrderNo % 2 = 0").withColumns({"filename": F.lit("f2.csv"), "prediction": 1 - F.col("score")})
    return a.unionByName(b)


@query("coalesce_prediction_columns", select(_CALLS, """FillerOrderNo, start_time, round(case when FillerOrderNo % 5 <> 0 then score
  when FillerOrderNo % 2 = 0 then 1 - score end, 6) as prediction""", "c"))
def _(spark, sf):
    return scoring.coalesce_predictions(_two_files(calls(spark, sf)), ["FillerOrderNo", "start_time"])


def _by_hash(seed: int, identity: list[str], keys: list[str] | None = None) -> str:
    """0-based place of a row in a seeded random order, as ``ordered.with_random_rank`` gives it."""
    keys = keys or ["1"]
    within = f"partition by {', '.join(keys)} " if keys != ["1"] else ""
    return f"(row_number() over ({within}order by {row_hash_sql(seed, [*keys, *identity])}, {', '.join(identity)}) - 1)"


@query("threshold_and_randomise", select(_CALLS + f""", t as (select * from c where score > 0.6 and dayname(start_time) <> 'Thursday'),
  r as (select *, {_by_hash(3, ['FillerOrderNo'])} as place, cast(round_even(count(*) over () / 2.0, 0) as bigint) as half from t)""",
  "FillerOrderNo, start_time, round(score, 6) as score, case when place < half then 'intervention' else 'control' end as control", "r"))
def _(spark, sf):
    picked = scoring.select_above(calls(spark, sf), 0.6, dt.date(2024, 2, 1))
    return scoring.randomise_half(picked, ["FillerOrderNo"], seed=3).select("FillerOrderNo", "start_time", "score", "control")


# ---------------------------------------------------------------- splits

_ROW = ", ".join(ROW)


@query("split_train_validation", select(f"""{P}, r as (select *, {_by_hash(94, ROW)} as place, count(*) over () as n from p)""",
  f"{_ROW}, case when place < cast(ceil(n * 0.2) as bigint) then 'validation' else 'train' end as part", "r"))
def _(spark, sf):
    return scoring.split_train_validation(scored(spark, sf), ROW, 0.2).select(*ROW, "part")


@query("split_by_time", select(P, """l_orderkey, l_linenumber, case when cast(l_shipdate as date) < date '1997-11-24' then 'train'
  else 'validation' end as part""", "p"))
def _(spark, sf):
    return scoring.split_by_time(scored(spark, sf), dt.date(1998, 1, 1), column="l_shipdate").select(
        "l_orderkey", "l_linenumber", "part")


_FOLDS = f"{P}, fo as (select *, {_by_hash(42, ROW, ['label'])} % 5 as fold from p)"


@query("fold_assign", select(_FOLDS, f"{_ROW}, label, fold", "fo"))
def _(spark, sf):
    return scoring.assign_folds(scored(spark, sf), "label", ROW, 5).select(*ROW, "label", "fold")


@query("leave_one_group_out", select(P, f"{_ROW}, g.l_linestatus as held_out, g.l_linestatus = p.l_linestatus as is_test",
                                     "p, (select distinct l_linestatus from p) g"))
def _(spark, sf):
    return scoring.leave_one_group_out(scored(spark, sf), "l_linestatus").select(*ROW, "held_out", "is_test")


# ---------------------------------------------------------------- metrics

_CURVE = f"""{LONG}, sc as (select model, score, sum(label) as pos, count(*) - sum(label) as neg from m group by 1, 2),
cu as (select *, sum(pos) over w as tp, sum(neg) over w as fp, sum(pos) over (partition by model) as p_all,
    sum(neg) over (partition by model) as n_all from sc window w as (partition by model order by score desc)),
pt as (select *, tp / (tp + fp) as precision_, tp / p_all as recall, fp / n_all as fpr,
    coalesce(lag(tp / (tp + fp)) over v, 1.0) as precision_0, coalesce(lag(tp / p_all) over v, 0) as recall_0,
    coalesce(lag(fp / n_all) over v, 0) as fpr_0, coalesce(lag(tp) over v, 0) as tp_0
  from cu window v as (partition by model order by score desc))"""


@query("pr_curve", select(_CURVE, "model, round(recall, 6) as recall, round(avg(precision_), 6) as precision", "pt",
                          "where tp_0 < p_all group by model, pt.recall"))
def _(spark, sf):
    return scoring.pr_curve(scoring.cumulative(stacked(spark, sf)))


@query("roc_curve", select(_CURVE, "model, round(score, 6) as score, round(fpr, 6) as fpr, round(recall, 6) as tpr", "pt"))
def _(spark, sf):
    return scoring.roc_curve(scoring.cumulative(stacked(spark, sf)))


_AREAS = """ar as (select model, sum((recall - recall_0) * (precision_ + precision_0) / 2) as auprc,
  sum((fpr - fpr_0) * (recall + recall_0) / 2) as auroc from pt group by 1)"""


@query("pr_roc_curves", select(f"{_CURVE}, {_AREAS}", "model, round(auprc, 6) as auprc, round(auroc, 6) as auroc", "ar"))
def _(spark, sf):
    return scoring.areas(scoring.cumulative(stacked(spark, sf)))


_F1 = "(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) + coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0)) / 2"
_CLS = f"""{_CURVE}, {_AREAS},
cl as (select model, count(*) filter (where label = 1 and score > 0.5) as tp, count(*) filter (where label = 0 and score > 0.5) as fp,
    count(*) filter (where label = 1 and score <= 0.5) as fn, count(*) filter (where label = 0 and score <= 0.5) as tn,
    avg(pow(score - label, 2)) as brier_score,
    avg(-(label * ln(least(greatest(score, 1e-15), 1 - 1e-15)) + (1 - label) * ln(1 - least(greatest(score, 1e-15), 1 - 1e-15))))
      as log_loss from m group by 1)"""


@query("metrics_classification", select(_CLS, f"""model, round({_F1}, 6) as f1_macro, round(brier_score, 6) as brier_score,
  round(auprc, 6) as auprc, round(auroc, 6) as auroc, round(log_loss, 6) as log_loss""", "cl join ar using (model)"))
def _(spark, sf):
    return scoring.classification_metrics(stacked(spark, sf))


@query("metrics_regression", select(P, """l_linestatus, round(avg(pow(e, 2)), 6) as mse, round(sqrt(avg(pow(e, 2))), 6) as rmse,
  round(avg(abs(e)), 6) as mae, round(median(abs(e)), 6) as median_absolute_error, round(avg(abs(e) / abs(l_quantity)), 6) as mape""",
  "(select *, l_discount * 500 - l_quantity as e from p) q", "group by 1"))
def _(spark, sf):
    df = scored(spark, sf).withColumn("prediction", F.col("l_discount") * 500)
    return scoring.regression_metrics(df, "l_quantity", "prediction", ["l_linestatus"])


_EVAL = f"""{LONG}, so as (select model, list(score order by score desc) as s, count(*) as n from m group by 1),
ct as (select model, i as step, n, s[cast(round_even(10.0::double / 105 * i * n, 0) as bigint) + 1] as cutoff from so, range(1, 11) r(i)),
cm as (select ct.model, step, cutoff, n, count(*) filter (where label = 1 and score > cutoff) as tp,
    count(*) filter (where label = 0 and score > cutoff) as fp, count(*) filter (where label = 1 and score <= cutoff) as fn,
    count(*) filter (where label = 0 and score <= cutoff) as tn, avg(pow(score - label, 2)) as brier
  from ct join m on m.model = ct.model group by 1, 2, 3, 4)"""


@query("evaluation_table", select(_EVAL, f"""model, step, round_even((cutoff) * 1000, 0) / 1000 as cutoff, round_even(({_F1}) * 1000, 0) / 1000 as f1_macro,
  round_even((brier) * 1000, 0) / 1000 as brier_loss, round_even((tp / (tp + fn)) * 1000, 0) / 1000 as tpr, round_even((tn / (tn + fp)) * 1000, 0) / 1000 as tnr, round_even((tp / (tp + fp)) * 1000, 0) / 1000 as ppv,
  round_even((tn / (tn + fn)) * 1000, 0) / 1000 as npv, round_even((fp / (fp + tn)) * 1000, 0) / 1000 as fpr, round_even((fn / (tp + fn)) * 1000, 0) / 1000 as fnr, round_even((fp / (tp + fp)) * 1000, 0) / 1000 as fdr,
  round_even(((tp + tn) / n) * 1000, 0) / 1000 as acc, tp + fp as predicted_no_shows, tp + fn as actual_no_shows, n as total_appts,
  round_even(((tp + fp) / n) * 10, 0) / 10 as share_predicted, round_even((105 * ((tp + fp) / n)) * 10, 0) / 10 as predictions_per_week,
  round_even((105 * ((tp + fp) / n) * (tp / (tp + fp))) * 10, 0) / 10 as correct_per_week""", "cm"))
def _(spark, sf):
    return scoring.evaluation_table(stacked(spark, sf))


@query("baseline_precision", select(P, "round(avg(label), 6) as baseline_precision", "p"))
def _(spark, sf):
    return scoring.prevalence(scored(spark, sf))


@query("importance_summary", select(P, """'f' || l_linenumber as feature, round(avg(l_discount), 6) as average,
  round(stddev_pop(l_discount), 6) as std""", "p", "group by 1"))
def _(spark, sf):
    df = scored(spark, sf).select(F.concat(F.lit("f"), F.col("l_linenumber")).alias("feature"),
                                  F.col("l_discount").alias("importance"))
    return scoring.importance_summary(df)


# ---------------------------------------------------------------- permutation

def _pair(spark, sf):
    df = scored(spark, sf).select(*ROW, "l_linestatus", F.col("label").alias("true"), "score")
    return [df.filter(F.col("l_linestatus") == s) for s in ("F", "O")]


_PT = f"""{P}, q as (select l_linestatus, label, score, cast(score > 0.5 as int) as pred from p),
g as (select l_linestatus, count(*) filter (where label = 1 and pred = 1) as tp, count(*) filter (where label = 0 and pred = 1) as fp,
    count(*) filter (where label = 1 and pred = 0) as fn, count(*) filter (where label = 0 and pred = 0) as tn,
    avg(-(label * ln(least(greatest(score, 1e-15), 1 - 1e-15)) + (1 - label) * ln(1 - least(greatest(score, 1e-15), 1 - 1e-15)))) as ll
  from q group by 1),
h as (select max({_F1}) filter (where l_linestatus = 'F') - max({_F1}) filter (where l_linestatus = 'O') as d,
    max(ll) filter (where l_linestatus = 'O') - max(ll) filter (where l_linestatus = 'F') as d_ll from g)"""


TRIALS = 1000
# Every trial ranks all rows by its own hash of each and takes as many as the first group has.
_WHO = ["grp", *ROW]
_LOSS = "-(true_ * ln(least(greatest(score, 1e-15), 1 - 1e-15)) + (1 - true_) * ln(1 - least(greatest(score, 1e-15), 1 - 1e-15)))"
_TRIALS = f"""{_PT}, who as (select case l_linestatus when 'F' then 1 else 2 end as grp, {_ROW}, label as true_, score from p),
hx as (select grp, {row_hash_sql(0, _WHO)} % {PRIME} as x, {row_hash_sql(0, _WHO, 1)} % {PRIME} as y, {{cells}} from who),
each as (select *, unnest(range({TRIALS})) as trial from hx),
ranked as (select trial, {{names}}, row_number() over (partition by trial order by h, y, {{names}}) as place from {keyed_hash_sql('each', 'trial')} k),
picked as (select trial, {{sums}} from ranked where place <= (select count(*) from hx where grp = 1) group by trial),
whole as (select count(*) filter (grp = 1) as n1, count(*) filter (grp = 2) as n2, {{totals}} from hx)"""
_CELLS = {"tp": (1, 1), "fp": (0, 1), "fn": (1, 0), "tn": (0, 0)}
_OTHER = _F1
for _n in _CELLS:
    _OTHER = _OTHER.replace(_n, f"(a_{_n} - {_n})")


@query("permutation_test", select(_TRIALS.format(
    cells=", ".join(f"cast(true_ = {y} and (score > 0.5) = ({p} = 1) as bigint) as {n}" for n, (y, p) in _CELLS.items()), names=", ".join(_CELLS),
    sums=", ".join(f"sum({n})::bigint as {n}" for n in _CELLS), totals=", ".join(f"sum({n})::bigint as a_{n}" for n in _CELLS)),
    f"round(d, 6) as observed_difference, {TRIALS} as trials, (select count(*) from picked, whole where {_F1} - {_OTHER} > d) / {TRIALS} as alpha", "h"))
def _(spark, sf):
    a, b = [x.withColumn("pred", (F.col("score") > 0.5).cast("int")) for x in _pair(spark, sf)]
    return scoring.permutation_test(a, b, ROW, TRIALS)


@query("permutation_test_log_loss", select(_TRIALS.format(
    cells=f"{_LOSS} as loss", names="loss", sums="sum(loss) as loss", totals="sum(loss) as a_loss"),
    f"round(d_ll, 6) as observed_difference, {TRIALS} as trials, (select count(*) from picked, whole where (a_loss - loss) / n2 - loss / n1 > d_ll) / {TRIALS} as alpha", "h"))
def _(spark, sf):
    a, b = [x.withColumn("pred", F.col("score")) for x in _pair(spark, sf)]
    return scoring.permutation_test(a, b, ROW, TRIALS, statistic="log_loss")


# ---------------------------------------------------------------- models

NUMERIC, CATEGORICAL = ["l_quantity", "l_extendedprice", "l_discount"], ["l_linestatus"]
FEATURES = [*NUMERIC, *CATEGORICAL, "month"]


#: What models and their folds read; rows are sorted and stored with these columns only.
NEEDED = [*dict.fromkeys([*ROW, *FEATURES, "label"])]


def training(spark, sf):
    df = scored(spark, sf)
    return df.withColumn("month", F.month("l_shipdate"))


def stages():
    return M.feature_stages(NUMERIC, CATEGORICAL, {"month": (K.MONTH_PERIOD, 1)})


_Z = ", ".join(f"round((p.{c} - avg(p.{c}) over ()) / stddev_samp(p.{c}) over (), 6) as {c}" for c in NUMERIC)


@query("feature_pipeline", select(P, f"""l_orderkey, l_linenumber, {_Z}, (l_linestatus = 'F')::int::double as is_f,
  (l_linestatus = 'O')::int::double as is_o, round(sin((month(l_shipdate) - 1) * {2 * math.pi / 12!r}), 6) + 0.0 as month_sin,
  round(cos((month(l_shipdate) - 1) * {2 * math.pi / 12!r}), 6) + 0.0 as month_cos""", "p"))
def _(spark, sf):
    df = training(spark, sf)
    out = Pipeline(stages=stages()).fit(df).transform(df)
    v = vector_to_array("features")
    names = ["month_sin", "month_cos", "is_f", "is_o", *NUMERIC]
    return out.select("l_orderkey", "l_linenumber", *[v[i].alias(n) for i, n in enumerate(names)])


def halves(spark, sf):
    """Training and test rows, as ``split_train_validation`` marks them."""
    df = cut_lineage(scoring.split_train_validation(training(spark, sf).select(*NEEDED), ROW, 0.2), "train-test", large=True)
    return {"train": df.filter("part = 'train'").drop("part"), "test": df.filter("part = 'validation'").drop("part")}


def _fit(spark, sf, estimator):
    """Metrics of a model on the rows it was trained on and on those held out, told apart by ``model``."""
    parts = halves(spark, sf)
    model = M.train(parts["train"], stages(), estimator)
    scored_ = [M.scorer(model)(df).select(F.lit(part).alias("model"), F.col("label").cast("long").alias("label"), "score")
               for part, df in parts.items()]
    return scoring.classification_metrics(scored_[0].unionByName(scored_[1]))


@query("train_logistic")
def _(spark, sf):
    return _fit(spark, sf, M.logistic())


@query("train_random_forest")
def _(spark, sf):
    return _fit(spark, sf, M.random_forest())


@query("train_gbt")
def _(spark, sf):
    return _fit(spark, sf, M.boosted_trees())


@query("train_mlp")
def _(spark, sf):
    return _fit(spark, sf, M.perceptron(7, 5))


@query("cross_validate")
def _(spark, sf):
    df = scoring.assign_folds(training(spark, sf).select(*NEEDED), "label", ROW, 5)
    table, _ = M.cross_validate(df, stages(), M.logistic(), 5)
    return table


@query("random_search")
def _(spark, sf):
    df = scoring.assign_folds(training(spark, sf), "label", ROW, 2)
    lr = M.logistic(max_iter=10)
    table, _ = M.random_search(df, stages(), lr, {lr.regParam: [0.001, 0.01, 0.1], lr.elasticNetParam: [0.0, 0.5]}, 3, 2)
    return table


@query("score_batch")
def _(spark, sf):
    df = training(spark, sf)
    models = {"logistic": M.train(df, stages(), M.logistic()),
              "forest": M.train(df, stages(), M.random_forest(trees=5, depth=4, features="auto"))}
    folder = work_dir(spark, "models")
    M.save_models(models, folder)
    return live_jobs.score_batch(df, M.load_models(list(models), folder)).select("l_orderkey", "l_linenumber", "prediction_logistic", "prediction_forest")


@query("permutation_importance")
def _(spark, sf):
    parts = halves(spark, sf)
    model = M.train(parts["train"], stages(), M.logistic())
    return M.importance_by_part(model, parts, FEATURES, ROW)


# A fixed formula instead of a fitted model, so that both engines score the same and every shuffled row is compared.
_FORMULA = "1 / (1 + exp(-(l_quantity / 10 - l_extendedprice / 20000 + 5 * l_discount - 2)))"
_SHUFFLED = ["l_quantity", "l_extendedprice", "l_discount"]
_NLL = "-avg(-(label * ln(least(greatest(s, 1e-15), 1 - 1e-15)) + (1 - label) * ln(1 - least(greatest(s, 1e-15), 1 - 1e-15))))"


@query("permutation_importance_formula", select(f"""{P}, cut as (select *, {_by_hash(94, ROW)} as cut_at, count(*) over () as all_rows from p),
pl as (select * exclude (cut_at, all_rows), case when cut_at < cast(ceil(all_rows * 0.2) as bigint) then 'test' else 'train' end as part from cut),
rk as (select *, row_number() over (partition by part order by {row_hash_sql(42, ['1', *ROW])}, {_ROW}) - 1 as place, count(*) over (partition by part) as n from pl),
sides as (select n, a, b from (select distinct n from rk) d, lateral {grid_sql('n')} g),
each as (select rk.part, rk.place, rk.n, a, b, {", ".join(f"rk.{x}" for x in _SHUFFLED)}, unnest(range(10)) as repeat from rk join sides using (n)),
sent as (select * from {permuted_place_sql('each', 'place', 'repeat')} q),
mx as ({" union all ".join(f"select rk.part, '{f}' as feature, repeat, label, " + ", ".join((f"sent.{x}" if x == f else f"rk.{x}") + f" as {x}" for x in _SHUFFLED)
       + " from rk join sent on rk.part = sent.part and rk.place = sent.image" for f in _SHUFFLED)}),
vs as (select part, feature, repeat, {_NLL} as v from (select *, {_FORMULA} as s from mx) m group by all),
bs as (select part, {_NLL} as v from (select *, {_FORMULA} as s from rk) m group by all)""",
  "part, feature, count(*) as repeats, round(avg(bs.v - vs.v), 6) as average, round(stddev_pop(bs.v - vs.v), 6) as std", "vs join bs using (part)", "group by part, feature"))
def _(spark, sf):
    predict = lambda df: df.withColumn("score", F.expr(_FORMULA))
    return M.importance_by_part(predict, halves(spark, sf), _SHUFFLED, ROW)


@query("custom_scalar_transform", select(P, """l_orderkey, l_linenumber, round(l_extendedprice::float::double, 6) as l_extendedprice,
  round(ln(1 + l_quantity), 6) as log_quantity""", "p"))
def _(spark, sf):
    df = M.custom_step(scored(spark, sf), M.as_float32, columns=["l_extendedprice"])
    df = M.custom_step(df, lambda d: d.withColumn("log_quantity", F.log1p("l_quantity")))
    return df.select("l_orderkey", "l_linenumber", "l_extendedprice", "log_quantity")


