"""Scores, cut-offs, samples, folds and metrics.

Everything that needs an order of all scores works on the table of distinct
scores (counts of positives and negatives per score), and its running sums are
chunked when that table is large. No step sorts a table in one task.
"""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotlog import constants as K
from slotlog.functions import rules
from slotlog.functions.hashes import HASH_BITS, PRIME, keyed_hashes, row_hash
from slotlog.functions.dates import weekday_name
from slotlog.operators import ordered
from slotlog.operators.describe import exact_quantiles
from slotlog.session import cut_lineage

MODEL = "model"


def clip(p: Column, floor: float = K.PROBABILITY_FLOOR) -> Column:
    return F.least(F.greatest(p, F.lit(floor)), F.lit(1.0 - floor))


def positive_probability(df: DataFrame, probability: str = "probability", name: str = "score") -> DataFrame:
    """Clipped probability of the positive class from a probability vector."""
    return df.withColumn(name, clip(vector_to_array(F.col(probability))[1]))


# ---------------------------------------------------------------- call lists

def top_per_file(df: DataFrame, config: dict = K.CALL_DAYS, score: str = "score", file: str = "filename",
                 file_date: str = "file_date") -> DataFrame:
    """Highest scores per file among the target weekdays of the file's weekday.

    Only configured weekdays have a list. The rank filter is applied inside each task
    before the shuffle, so a large file never travels whole.
    """
    day, target = weekday_name(F.col(file_date)), weekday_name(F.col("start_time"))
    wanted = n = None
    for k, (days, count) in config.items():
        wanted = F.when(day == k, target.isin(days)) if wanted is None else wanted.when(day == k, target.isin(days))
        n = F.when(day == k, count) if n is None else n.when(day == k, count)
    largest = max(count for _, count in config.values())
    w = Window.partitionBy(file).orderBy(F.col(score).desc_nulls_last(), "FillerOrderNo", "start_time")
    ranked = df.filter(rules.holds(wanted)).withColumns({"list_size": n, "rank": F.row_number().over(w)})
    return ranked.filter(F.col("rank") <= largest).filter(F.col("rank") <= F.col("list_size")).drop(
        "list_size", "rank").withColumn("prediction", F.col(score))


def coalesce_predictions(df: DataFrame, keys: list[str], score: str = "prediction", file: str = "filename") -> DataFrame:
    """One prediction per appointment over all files: the first file that has one."""
    value = F.when(F.col(score).isNotNull(), F.col(file))
    return df.groupBy(*keys).agg(F.min_by(F.col(score), value).alias("prediction"))


def select_above(df: DataFrame, threshold: float, call_day: dt.date, score: str = "score") -> DataFrame:
    """Slots above the threshold; on Thursdays next Thursday's are left to the Monday list."""
    out = df.filter(F.col(score) > threshold)
    if call_day.strftime("%A") == "Thursday":
        out = out.filter(weekday_name(F.col("start_time")) != "Thursday")
    return out


def randomise_half(df: DataFrame, identity: list[str], seed: int) -> DataFrame:
    """Exactly half of the rows, chosen by a seeded hash, get the intervention."""
    n = df.count()
    half = round(n / 2)
    out = df.withColumn("one", F.lit(1))
    out = ordered.with_random_rank(out, ["one"], identity, seed, rows=n)
    return out.withColumn("control", F.when(F.col("random_rank") < half, "intervention").otherwise("control")).drop(
        "one", "random_rank")


# ---------------------------------------------------------------- splits

#: Bits of a hash by which a split's cut is narrowed down at once: 32,768 counts come to the driver.
STRETCH_BITS = 15


def split_train_validation(df: DataFrame, identity: list[str], test_size: float, seed: int = 94) -> DataFrame:
    """Mark ``ceil(test_size * n)`` rows, chosen by a seeded hash, as the second part.

    Counts of hashes narrow the cut down, mostly in two passes. No row moves; only rows of the one identity that the cut divides are ranked.
    """
    c = F.col
    hashed = row_hash(seed, [F.lit(1), *identity])
    held, before, inside, cut, left = None, 0, 0, 0, HASH_BITS
    while left and (held is None or before + inside != held):
        found = df.select(hashed.alias("order_hash"))
        if held is not None:
            found = found.filter(F.shiftright("order_hash", left) == cut)
        left -= STRETCH_BITS
        counts = sorted(tuple(r) for r in found.groupBy(F.shiftright("order_hash", left).alias("stretch")).count().collect())
        if held is None:
            held = -int(-test_size * sum(k for _, k in counts) // 1)
            if held == 0:
                return df.withColumn("part", F.lit("train"))
        for cut, inside in counts:
            if before + inside >= held:
                break
            before += inside
    at = F.shiftright(hashed, left)
    mark = lambda first: F.when(first, "validation").otherwise("train")
    if before + inside == held:
        return df.withColumn("part", mark(at <= cut))
    out = df.withColumn("order_hash", at)
    clear = out.filter(c("order_hash") != cut).withColumn("part", mark(c("order_hash") < cut)).drop("order_hash")
    alike = out.filter(c("order_hash") == cut).drop("order_hash").withColumn("one", F.lit(1))
    alike = ordered.with_random_rank(alike, ["one"], identity, seed, rows=inside)
    return clear.unionByName(alike.withColumn("part", mark(c("random_rank") < held - before)).drop("one", "random_rank"))


def split_by_time(df: DataFrame, as_of: dt.date, weeks: int = 5, column: str = "start_time") -> DataFrame:
    """Rows before the Monday ``weeks`` weeks ago train, later ones validate."""
    cut = as_of - dt.timedelta(days=as_of.weekday()) - dt.timedelta(weeks=weeks)
    return df.withColumn("part", F.when(F.col(column).cast("date") < F.lit(cut), "train").otherwise("validation"))


def assign_folds(df: DataFrame, label: str, identity: list[str], k: int, seed: int = 42) -> DataFrame:
    """Fold number per row; every fold gets the same number of rows of each label, up to one."""
    out = ordered.with_random_rank(df, [label], identity, seed)
    return out.withColumn("fold", F.pmod("random_rank", F.lit(k)).cast("int")).drop("random_rank")


def fold_parts(df: DataFrame, fold: int) -> tuple[DataFrame, DataFrame]:
    return df.filter(F.col("fold") != fold), df.filter(F.col("fold") == fold)


def leave_one_group_out(df: DataFrame, group: str) -> DataFrame:
    """Every row once for each value of ``group``: ``held_out`` is that value, ``is_test`` says whether the row belongs to it.

    One plan whatever the number of groups; the distinct values travel as one small table, each row is repeated where it lies.
    """
    value = F.struct(F.col(group).alias("v"))
    values = df.agg(F.array_sort(F.collect_set(value)).alias("held")).select("held").scalar()
    return df.withColumn("held", F.explode(values)).withColumns(
        {"held_out": F.col("held.v"), "is_test": F.col(group).eqNullSafe(F.col("held.v"))}).drop("held")


def common_columns(master: DataFrame, live: DataFrame) -> DataFrame:
    """Rows of both tables on the columns they share, typed as in ``live``."""
    kinds = dict(live.dtypes)
    shared = [c for c in master.columns if c in kinds]
    return master.select(*[F.col(c).cast(kinds[c]).alias(c) for c in shared]).unionByName(live.select(*shared))


# ---------------------------------------------------------------- curves

def stack_models(df: DataFrame, scores: dict[str, str], label: str = "label") -> DataFrame:
    """Score columns to rows (model, label, score)."""
    cells = F.array(*[F.struct(F.lit(m).alias(MODEL), F.col(c).alias("score")) for m, c in scores.items()])
    return df.select(F.col(label).cast("long").alias("label"), F.explode(cells).alias("x")).select(
        "x.model", "label", "x.score")


def score_table(df: DataFrame) -> DataFrame:
    """Positives and negatives per model and distinct score."""
    return df.groupBy(MODEL, "score").agg(F.sum("label").alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))


def cumulative(df: DataFrame, totals: dict[str, Column] | None = None) -> DataFrame:
    """Distinct scores of (model, label, score) rows with the counts above each and the totals per model.

    ``totals`` adds further sums per model over the rows of the score table. A large table
    is written once before its scores are cut into chunks, so that scoring does not run again.
    """
    c = F.col
    rows = df.count()
    t = score_table(df).withColumn("falling", -c("score"))
    if rows > ordered.HOT_MIN_ROWS:
        t = cut_lineage(t, "scores")
    t = ordered.split_hot_keys(t, [MODEL], "falling", at_most=rows)
    return ordered.with_ordered(t, [MODEL], ["falling"], {
        "pos_above": ordered.sum_before(c("pos")), "neg_above": ordered.sum_before(c("neg")),
        "pos_all": ordered.key_sum(c("pos")), "neg_all": ordered.key_sum(c("neg")),
        **{n: ordered.key_sum(e) for n, e in (totals or {}).items()},
    }).drop("falling", ordered.chunk_column([MODEL]))


def squared_error() -> Column:
    """Sum of squared errors of one row of the score table."""
    c = F.col
    return c("pos") * (c("score") - 1) * (c("score") - 1) + c("neg") * c("score") * c("score")


def curve_points(cum: DataFrame) -> DataFrame:
    """Precision, recall and false-positive rate at every distinct threshold, with the point before it.

    The precision-recall curve starts at recall 0 with precision 1 and ends at the
    first threshold that reaches all positives; the ROC curve starts at the origin.
    """
    c = F.col
    z = lambda e: F.nullif(e, F.lit(0))
    tp, fp = c("pos_above") + c("pos"), c("neg_above") + c("neg")
    seen_before = c("pos_above") + c("neg_above")
    return cum.select(
        MODEL, "score", "pos", "neg",
        (tp / z(tp + fp)).alias("precision"), (tp / z(c("pos_all"))).alias("recall"), (fp / z(c("neg_all"))).alias("fpr"),
        F.when(seen_before == 0, 1.0).otherwise(c("pos_above") / z(seen_before)).alias("precision_before"),
        (c("pos_above") / z(c("pos_all"))).alias("recall_before"), (c("neg_above") / z(c("neg_all"))).alias("fpr_before"),
        (c("pos_above") < c("pos_all")).alias("on_pr_curve"))


def pr_curve(cum: DataFrame) -> DataFrame:
    """Precision averaged per recall value."""
    return curve_points(cum).filter("on_pr_curve").groupBy(MODEL, "recall").agg(F.avg("precision").alias("precision"))


def roc_curve(cum: DataFrame) -> DataFrame:
    return curve_points(cum).select(MODEL, "score", "fpr", F.col("recall").alias("tpr"))


def areas(cum: DataFrame) -> DataFrame:
    """Areas under both curves by the trapezoid rule; tied scores form one step."""
    c = F.col
    return curve_points(cum).groupBy(MODEL).agg(
        F.sum((c("recall") - c("recall_before")) * (c("precision") + c("precision_before")) / 2).alias("auprc"),
        F.sum((c("fpr") - c("fpr_before")) * (c("recall") + c("recall_before")) / 2).alias("auroc"))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return F.coalesce(2 * tp / F.nullif(2 * tp + fp + fn, F.lit(0)), F.lit(0.0))


def macro_f1(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    return (f1(tp, fp, fn) + f1(tn, fn, fp)) / 2


def log_loss_sum(label: Column, p: Column, eps: float = 1e-15) -> Column:
    q = clip(p, eps)
    return F.sum(-(label * F.log(q) + (1 - label) * F.log(F.lit(1.0) - q)))


def classification_metrics(df: DataFrame, cutoff: float = 0.5) -> DataFrame:
    """Macro F1, Brier score, log loss and both areas per model, from one table of distinct scores."""
    c = F.col
    cum = cumulative(df)
    above = c("score") > cutoff
    s = lambda cond, col: F.sum(F.when(cond, c(col)).otherwise(0))
    q = clip(c("score"), 1e-15)
    n = F.sum(c("pos") + c("neg"))
    points = curve_points(cum)
    return points.groupBy(MODEL).agg(
        macro_f1(s(above, "pos"), s(above, "neg"), s(~above, "pos"), s(~above, "neg")).alias("f1_macro"),
        (F.sum(squared_error()) / n).alias("brier_score"),
        F.sum((c("recall") - c("recall_before")) * (c("precision") + c("precision_before")) / 2).alias("auprc"),
        F.sum((c("fpr") - c("fpr_before")) * (c("recall") + c("recall_before")) / 2).alias("auroc"),
        (F.sum(-(c("pos") * F.log(q) + c("neg") * F.log(F.lit(1.0) - q))) / n).alias("log_loss"))


def regression_metrics(df: DataFrame, label: str, prediction: str, keys: list[str] | None = None) -> DataFrame:
    """MSE, RMSE, MAE, median absolute error and MAPE; the median is exact and never sorts in one task."""
    keys = keys or [MODEL]
    base = df if all(k in df.columns for k in keys) else df.withColumn(keys[0], F.lit("all"))
    y, e = F.col(label), F.col(prediction) - F.col(label)
    tiny = F.lit(2.220446049250313e-16)
    base = base.withColumns({"sq": e * e, "ab": F.abs(e), "rel": F.abs(e) / F.greatest(F.abs(y), tiny)})
    means = base.groupBy(*keys).agg(F.avg("sq").alias("mse"), F.sqrt(F.avg("sq")).alias("rmse"), F.avg("ab").alias("mae"),
                                    F.avg("rel").alias("mape"))
    return means.join(exact_quantiles(base, keys, "ab", {"median_absolute_error": 0.5}), keys)


def evaluation_table(df: DataFrame, steps: int = 10) -> DataFrame:
    """Per model and cut-off: what calling the top k x 10 of 105 weekly slots would bring.

    The cut-off is the score at a fixed rank, and a slot is predicted when its score is
    strictly greater. Ranks are looked up in the running counts, not in a sorted list.
    """
    c = F.col
    cum = cumulative(df, {"squared": squared_error()}).withColumn("n", c("pos_all") + c("neg_all"))
    before = c("pos_above") + c("neg_above")
    ranks = F.array(*[
        F.struct(F.lit(i).alias("step"),
                 F.bround(F.lit(K.PREDICTIONS_STEP / K.APPOINTMENTS_PER_WEEK) * F.lit(i) * c("n")).cast("long").alias("at"))
        for i in range(1, steps + 1)])
    hits = F.filter(ranks, lambda r: (r["at"] >= before) & (r["at"] < before + c("pos") + c("neg")))
    t = cum.withColumn("r", F.explode(hits)).withColumn("step", c("r.step"))
    z = lambda e: F.nullif(e, F.lit(0))
    t = t.withColumns({"tp": c("pos_above"), "fp": c("neg_above"), "fn": c("pos_all") - c("pos_above"),
                       "tn": c("neg_all") - c("neg_above")})
    tp, fp, fn, tn = c("tp"), c("fp"), c("fn"), c("tn")
    share = (tp + fp) / c("n")
    weekly = F.lit(float(K.APPOINTMENTS_PER_WEEK)) * share
    rounded = {
        "f1_macro": macro_f1(tp, fp, fn, tn), "brier_loss": c("squared") / c("n"), "tpr": tp / z(tp + fn), "tnr": tn / z(tn + fp),
        "ppv": tp / z(tp + fp), "npv": tn / z(tn + fn), "fpr": fp / z(fp + tn), "fnr": fn / z(tp + fn),
        "fdr": fp / z(tp + fp), "acc": (tp + tn) / c("n"),
    }
    # Scaled and rounded half to even, as the published tables were.
    to = lambda e, scale: F.rint(e * scale) / F.lit(float(scale))
    return t.select(
        MODEL, c("step").cast("long").alias("step"), to(c("score"), 1000).alias("cutoff"),
        *[to(v, 1000).alias(k) for k, v in rounded.items()],
        (tp + fp).alias("predicted_no_shows"), c("pos_all").alias("actual_no_shows"), c("n").alias("total_appts"),
        to(share, 10).alias("share_predicted"), to(weekly, 10).alias("predictions_per_week"),
        to(weekly * (tp / z(tp + fp)), 10).alias("correct_per_week"))


def prevalence(df: DataFrame, label: str = "label") -> DataFrame:
    return df.agg(F.avg(F.col(label).cast("double")).alias("baseline_precision"))


def importance_summary(df: DataFrame) -> DataFrame:
    """Mean and population deviation of importances over models."""
    return df.groupBy("feature").agg(F.avg("importance").alias("average"), F.stddev_pop("importance").alias("std"))


# ---------------------------------------------------------------- permutations

#: A cut that was not near its expected place is looked for in so many equal stretches of hashes at once.
STRETCHES = 64
#: With so many rows left where a trial's cut must be, they are ranked.
RANKED_ROWS = 4_000
#: Deviations from the expected place of a trial's cut in which it is looked for first.
NEAR = 4.0
#: Hashes, one for each row and trial, that one task computes.
HASHES = 50_000_000


def _cells(statistic: str) -> dict[str, Column]:
    """What is summed over the rows of a group."""
    c = F.col
    if statistic == "log_loss":
        p = clip(c("pred").cast("double"), 1e-15)
        return {"loss": -(c("true") * F.log(p) + (1 - c("true")) * F.log(F.lit(1.0) - p))}
    return {n: ((c("true") == y) & (c("pred") == p)).cast("long") for n, y, p in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0), ("tn", 0, 0))}


def permuted_sums(rows: DataFrame, cells: list[str], n1: int, trials: int) -> list[tuple[int, ...]]:
    """For each trial the number of rows and the sums of ``cells`` over ``n1`` rows that it picks.

    ``rows`` has ``x`` and ``y``, hashes below 2^31 of each row. A trial picks the rows with the smallest keyed hash of ``x``, ties by
    ``y``, then by the cells. Rows are never shuffled with trials. As hashes are even, the cut is a few deviations from its expected place at most:
    one pass adds up what lies below that stretch, and only the rows inside it, about the square root of all, come out and are ranked. A trial
    whose cut is elsewhere, say as many rows share one hash, goes on with counts of 64 stretches of hashes until few rows are left.
    What comes to the driver is a sum for each stretch.
    """
    c = F.col
    kinds = dict(rows.dtypes)
    names = ["rows", *cells]
    total = rows.count()
    tasks = max(1, math.ceil(total * trials / HASHES))
    alike = rows.repartition(tasks, "x", "y").groupBy("x", "y", *cells).agg(F.count(F.lit(1)).alias("rows"))
    share = n1 / total
    near = NEAR * math.sqrt(share * (1 - share) / total)
    low, high = max(0, math.floor(PRIME * (share - near))), min(PRIME, math.ceil(PRIME * (share + near)) + 1)
    nothing = [0] * len(names)
    done = [nothing] * trials
    # Per open trial: where its cut is looked for, how many rows lie there, and whether they come out.
    spans = {t: (low, high, total, True) for t in range(trials)}
    schema = "trial int, h long, y long, rows long, " + ", ".join(f"{n} {kinds[n]}" for n in cells)
    first = True
    while spans:
        found = cut_lineage(alike.mapInArrow(_in_spans({t: (a, b, out) for t, (a, b, _, out) in spans.items()}, cells, kinds), schema), "permutation-cuts")
        place = F.when(c("h").isNull(), c("y")).otherwise(F.lit(-1))  # -1: rows that came out
        sums = {(r["trial"], r["place"]): [r[n] or 0 for n in names]
                for r in found.groupBy("trial", place.alias("place")).agg(*[F.sum(n).alias(n) for n in names]).collect()}
        plus = lambda u, v: [i + j for i, j in zip(u, v, strict=True)]
        still, need = {}, [0] * trials
        for t, (a, b, mass, out) in spans.items():
            if out:
                below, inside = sums.get((t, 0), nothing) if first else nothing, sums.get((t, -1), nothing)
                left = n1 - done[t][0] - below[0]
                if 0 <= left <= inside[0]:
                    done[t], need[t] = plus(done[t], below), left
                    continue
                if left < 0:
                    a, b, mass = 0, a, below[0]
                else:
                    done[t] = plus(done[t], plus(below, inside))
                    a, b, mass = b, PRIME, total - done[t][0]
            else:
                edges = _edges(a, b)
                for i in range(len(edges) - 1):
                    here = sums.get((t, i), nothing)
                    if done[t][0] + here[0] >= n1:
                        a, b, mass = edges[i], edges[i + 1], here[0]
                        break
                    done[t] = plus(done[t], here)
            still[t] = (a, b, mass, mass <= RANKED_ROWS or b - a == 1)
        order = Window.partitionBy("trial").orderBy("h", "y", *cells).rowsBetween(Window.unboundedPreceding, -1)
        wanted = F.element_at(F.lit(need), (c("trial") + 1).cast("int"))
        taken = F.greatest(F.lit(0), F.least(c("rows"), wanted - F.coalesce(F.sum("rows").over(order), F.lit(0))))
        picked = found.filter(c("h").isNotNull() & (wanted > 0)).withColumn("taken", taken).filter("taken > 0").groupBy("trial").agg(
            F.sum("taken").alias("rows"), *[F.sum(c("taken") * c(x)).alias(x) for x in cells])
        for r in picked.collect():
            done[r["trial"]] = plus(done[r["trial"]], [r[n] or 0 for n in names])
        spans, first = still, False
    return [(t, *d) for t, d in enumerate(done)]


def _edges(low: int, high: int) -> list[int]:
    """Borders of up to ``STRETCHES`` stretches of hashes."""
    return sorted({low + (high - low) * i // STRETCHES for i in range(STRETCHES + 1)})


def _in_spans(spans: dict[int, tuple[int, int, bool]], cells: list[str], kinds: dict[str, str]):
    """For tasks: of each trial, the rows with a hash from ``low`` to below ``high`` and sums of all rows below (place 0), or sums of the stretches between both.

    A row of sums has no ``h`` and its place as ``y``.
    """

    def run(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        names = ["trial", "h", "y", "rows", *cells]
        numbers = lambda column, kind: column.fill_null(0).to_numpy(zero_copy_only=False).astype(kind)
        for batch in batches:
            x, rows = numbers(batch.column("x"), np.uint64), numbers(batch.column("rows"), np.float64)
            values = np.stack([rows, *[rows * numbers(batch.column(n), np.float64) for n in cells]])
            inside = []
            for trial, (low, high, out) in spans.items():
                h = keyed_hashes(x, trial)
                if out:
                    below = h < np.uint64(low)
                    sums[trial, 0] = sums.get((trial, 0), 0.0) + values @ below.astype(np.float64)
                    at = np.flatnonzero(below ^ (h < np.uint64(high)))
                    if len(at):
                        inside.append((trial, at, h[at]))
                    continue
                edges = _edges(low, high)
                at = np.flatnonzero((h >= np.uint64(low)) & (h < np.uint64(high)))
                places = np.searchsorted(np.array(edges, np.uint64), h[at], "right") - 1
                for place in np.unique(places).tolist():
                    sums[trial, place] = sums.get((trial, place), 0.0) + values[:, at[places == place]].sum(axis=1)
            if inside:
                at = pa.array(np.concatenate([i for _, i, _ in inside]))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat([t for t, _, _ in inside], [len(i) for _, i, _ in inside]).astype(np.int32)),
                    pa.array(np.concatenate([h for _, _, h in inside]).astype(np.int64)),
                    *[batch.column(n).take(at) for n in ("y", "rows", *cells)]], names=names)
        if sums:
            places, found = list(sums), np.stack(list(sums.values()))
            yield pa.RecordBatch.from_arrays([
                pa.array([t for t, _ in places], pa.int32()), pa.nulls(len(places), pa.int64()), pa.array([i for _, i in places], pa.int64()),
                *[pa.array(found[:, j].astype(np.float64 if kinds.get(n) == "double" else np.int64)) for j, n in enumerate(["rows", *cells])]], names=names)

    return run


def permutation_test(first: DataFrame, second: DataFrame, identity: list[str], trials: int = 1000, seed: int = 0,
                     statistic: str = "f1") -> DataFrame:
    """Share of random re-splits of the pooled rows whose score difference exceeds the observed one.

    Columns ``true`` and ``pred``; ``identity`` are whole numbers, text or dates. Each trial keeps both sizes exactly.
    """
    c = F.col
    cells = _cells(statistic)
    pooled = first.select("true", "pred", *identity).withColumn("grp", F.lit(1)).unionByName(
        second.select("true", "pred", *identity).withColumn("grp", F.lit(2)))
    who = ["grp", *identity]
    rows = cut_lineage(pooled.select("grp", (row_hash(seed, who) % PRIME).alias("x"), (row_hash(seed, who, 1) % PRIME).alias("y"),
                                     *[e.alias(n) for n, e in cells.items()]), "permutation-rows")
    totals = {r["grp"]: r for r in rows.groupBy("grp").agg(F.count(F.lit(1)).alias("rows"), *[F.sum(n).alias(n) for n in cells]).collect()}
    sizes = [totals[g]["rows"] if g in totals else 0 for g in (1, 2)]
    both = [sum(totals[g][n] for g in totals) for n in cells]
    observed = (-1, sizes[0], *[totals[1][n] if 1 in totals else 0 for n in cells])
    picked = [observed, *(permuted_sums(rows, list(cells), sizes[0], trials) if sizes[0] else [])]
    kind = "double" if statistic == "log_loss" else "long"
    table = first.sparkSession.createDataFrame(
        [tuple(float(v) if kind == "double" and i > 1 else v for i, v in enumerate(p)) for p in picked],
        "trial int, rows long, " + ", ".join(f"{n} {kind}" for n in cells))
    whole = {n: F.lit(v) for n, v in zip(cells, both, strict=True)}
    if statistic == "log_loss":
        difference = (whole["loss"] - c("loss")) / F.lit(float(sizes[1])) - c("loss") / F.lit(float(sizes[0]))
    else:
        difference = macro_f1(*[c(n) for n in cells]) - macro_f1(*[whole[n] - c(n) for n in cells])
    seen = F.max(F.when(c("trial") == -1, c("difference"))).alias("observed_difference")
    summary = table.withColumn("difference", difference).agg(seen, F.collect_list(F.when(c("trial") >= 0, c("difference"))).alias("d"))
    return summary.select(
        "observed_difference",
        (F.size(F.filter("d", lambda d: d > c("observed_difference"))) / F.lit(trials)).alias("alpha"),
        F.size("d").cast("long").alias("trials"))
