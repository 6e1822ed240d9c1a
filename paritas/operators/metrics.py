"""Exact AUC, false-negative and false-positive rates per model and group.

All models, the whole table and every group come out of one pass:

1. each scored row becomes one narrow row for the whole table (group null) and one
   for each group it belongs to;
2. rows of equal (model, group, score) collapse into counts of positives and
   negatives, partially before the shuffle, so ties of any size cost one row;
3. scores are cut into ranges holding about equally many rows, whatever their
   distribution and however they are stored, and ranked inside (model, group, range). The group of all
   rows, and scores crowded into a corner, are thereby spread over the cluster;
4. a range adds ``inner + 2 * positives * negatives_in_lower_ranges`` to twice the
   number of correctly ordered pairs, so only the small table of range totals is
   ranked once more, and nothing is joined back.

Pair counts are exact decimals: at 10^11 rows they no longer fit 64 bits.

Whether a model scored the very rows that have a label is seen in the same pass. Next to
the counts of the whole table goes a fingerprint of its rows, the exclusive or of their
hashed ids, which needs no order and no second visit to the ids.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paritas.catalogue import METRIC_COLUMNS, present_identities
from paritas.functions.values import checked_label, checked_score
from paritas.operators.prepare import active_identities, text_array
from paritas.session import rank_ranges, written

GROUP = "grp"
#: Fingerprint of the rows of the whole table; null for other groups.
ROWS = "rows_mark"


def rows_mark(row_id: Column) -> Column:
    """An order-free fingerprint of the ids, for as many rows: an aggregate. A row that is
    missing and one that is there twice change it alike only by a hash collision."""
    return F.bit_xor(F.xxhash64(row_id))


def attach_predictions(
    labelled: DataFrame,
    predictions: DataFrame,
    identities: Sequence[str] | None = None,
    membership_cut: float = 0.5,
) -> DataFrame:
    """Predictions with label and groups: the join of labels and scores on the id.

    Texts and wide identity scores are dropped before the join; a row carries its
    label and the short list of identities it belongs to.
    """
    identities = list(identities or present_identities(labelled.columns))
    narrow = labelled.select(
        "id", "is_toxic", active_identities(identities, membership_cut).alias("groups")
    )
    return predictions.join(narrow, "id")


def with_active_groups(
    scored: DataFrame, identities: Sequence[str] | None = None, membership_cut: float = 0.5
) -> DataFrame:
    """Add ``groups`` to rows that carry labels, identities and scores together."""
    identities = list(identities or present_identities(scored.columns))
    return scored.withColumn("groups", active_identities(identities, membership_cut))


def group_rows(scored: DataFrame, keys: Sequence[str], marked: bool = False) -> DataFrame:
    """One narrow row per (row, group); group null stands for the whole table. ``marked``
    rows carry the id that :data:`ROWS` is made of."""
    element = scored.schema["groups"].dataType.elementType
    whole = F.array(F.lit(None).cast(element))
    return scored.select(
        *keys,
        F.explode(F.concat(whole, F.col("groups"))).alias(GROUP),
        checked_score(F.col("score")).alias("score"),
        checked_label(F.col("is_toxic")).alias("label"),
        *(["id"] if marked else []),
    )


def _empty_groups(groups: DataFrame, keys: Sequence[str], rows: DataFrame) -> DataFrame:
    """Rows that count nothing, so that a group without members is reported."""
    listed = [*keys, GROUP]
    nothing = [
        F.lit(None).cast(rows.schema[c].dataType).alias(c)
        for c in rows.columns
        if c not in listed
    ]
    return groups.select(*listed, *nothing)


def score_counts(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Positives and negatives per (keys, group, score), and the mark of marked rows."""
    whole_id = F.when(F.col(GROUP).isNull(), F.col("id")) if "id" in rows.columns else None
    # The hash of a null is no null, so other groups are left out before it.
    mark = [] if whole_id is None else [
        F.bit_xor(F.when(whole_id.isNotNull(), F.xxhash64(whole_id))).alias(ROWS)
    ]
    return rows.groupBy(*keys, GROUP, "score").agg(
        F.coalesce(F.sum("label"), F.lit(0)).alias("pos"),
        F.coalesce(F.sum(1 - F.col("label")), F.lit(0)).alias("neg"),
        *mark,
    )


def _marks(counts: DataFrame) -> list[Column]:
    """The mark of several counts together, if they have one."""
    return [F.bit_xor(ROWS).alias(ROWS)] if ROWS in counts.columns else []


def _cut_points(scores: DataFrame, n: int, sketch_groups: int = 1024) -> Column:
    """The n - 1 scores that cut the table into about equal parts, as one array.

    Every task that reads scores leaves a mergeable sketch, which knows how many scores
    it stands for, so tasks count by their rows. There may be very many of them: they are
    merged in ``sketch_groups`` groups first, and a single task merges those.
    """
    accuracy = min(65_535, max(1_000, 16 * n))
    sketches = (
        scores.select(
            F.col("score").cast("double").alias("score"),
            (F.spark_partition_id() % sketch_groups).alias("part"),
        )
        .groupBy("part")
        .agg(F.kll_sketch_agg_double("score", accuracy).alias("sketch"))
    )
    merged = sketches.agg(F.kll_merge_agg_double("sketch", accuracy).alias("sketch"))
    shares = F.array(*(F.lit(i / n) for i in range(1, n)))
    cuts = F.when(
        F.kll_sketch_get_n_double("sketch") > 0,
        F.kll_sketch_get_quantile_double("sketch", shares),
    )
    return merged.select(cuts.alias("cuts")).scalar()


def with_score_range(
    counts: DataFrame, scores: DataFrame, ranges: int | None = None
) -> DataFrame:
    """Add ``range``, increasing with the score. ``ranges`` is a power of four.

    Any increasing ranges give the same result. The cut points are quantiles of
    ``scores``, read from its score column alone, so between two of them lie only
    one or two in ``ranges`` of the scored rows; rows of one score are a single
    count by now. The cut points come back as one small array, in which each score
    is found by a four-way search of plain generated code.
    """
    n = ranges or rank_ranges(counts.sparkSession)
    if 4 ** round(math.log(n, 4)) != n:
        raise ValueError(f"the number of score ranges must be a power of four, not {n}")
    ranged = counts.withColumn("range", F.lit(0))
    if n > 1:
        ranged = ranged.withColumn("cuts", _cut_points(scores, n))
    step = n // 4
    while step:
        passed = " + ".join(
            f"IF(get(cuts, range + {k * step - 1}) <= score, 1, 0)" for k in (1, 2, 3)
        )
        ranged = ranged.withColumn("range", F.expr(f"range + {step} * ({passed})"))
        step //= 4
    return ranged.drop("cuts")


def _wide(count: Column) -> Column:
    """A count as decimal, so that the product of two cannot overflow."""
    return count.cast("decimal(18,0)")


def _negatives_below(partition: Sequence[str], order: str, column: str) -> Column:
    window = W.partitionBy(*partition).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return F.coalesce(F.sum(column).over(window), F.lit(0))


def range_totals(
    counts: DataFrame,
    scores: DataFrame,
    keys: Sequence[str],
    threshold: float = 0.5,
    ranges: int | None = None,
) -> DataFrame:
    """Confusion counts and twice the ordered pairs inside each score range."""
    # The range first: it has the most values, which makes the sort cheaper.
    cell = ["range", *keys, GROUP]
    positive = F.col("score") >= F.lit(float(threshold))
    ranked = with_score_range(counts, scores, ranges).withColumn(
        "below", _negatives_below(cell, "score", "neg")
    )
    return ranked.groupBy(*cell).agg(
        F.sum("pos").alias("pos"),
        F.sum("neg").alias("neg"),
        F.sum(F.when(positive, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(positive, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(_wide(F.col("pos")) * _wide(2 * F.col("below") + F.col("neg"))).alias("pairs2"),
        *_marks(counts),
    )


def group_totals(totals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Range totals summed up to one row per (keys, group)."""
    cell = [*keys, GROUP]
    ranked = totals.withColumn("below", _negatives_below(cell, "range", "neg"))
    across = F.col("pairs2") + _wide(F.col("pos")) * _wide(2 * F.col("below"))
    return ranked.groupBy(*cell).agg(
        F.sum("pos").alias("pos"),
        F.sum("neg").alias("neg"),
        F.sum("tp").alias("tp"),
        F.sum("fp").alias("fp"),
        F.sum(across).alias("pairs2"),
        *_marks(totals),
    )


def _if_both_classes(value: Column) -> Column:
    """Every metric is undefined unless both labels occur, the rates included."""
    return F.when((F.col("pos") > 0) & (F.col("neg") > 0), value)


def auc_column() -> Column:
    pairs = _wide(F.col("pos")) * _wide(F.col("neg"))
    return _if_both_classes(
        F.col("pairs2").cast("double") / (F.lit(2.0) * pairs.cast("double"))
    )


def fnr_column() -> Column:
    missed = F.col("pos") - F.col("tp")
    return _if_both_classes(missed.cast("double") / F.col("pos").cast("double"))


def fpr_column() -> Column:
    return _if_both_classes(F.col("fp").cast("double") / F.col("neg").cast("double"))


def confusion_counts(
    scored: DataFrame, keys: Sequence[str] = ("dataset", "model"), threshold: float = 0.5
) -> DataFrame:
    """tn, fp, fn, tp per (keys, group): a plain aggregate, nothing is ranked."""
    hit = F.col("score") >= F.lit(float(threshold))
    positive = F.col("label") == 1
    return (
        group_rows(scored, keys)
        .groupBy(*keys, GROUP)
        .agg(
            F.count_if(~positive & ~hit).alias("tn"),
            F.count_if(~positive & hit).alias("fp"),
            F.count_if(positive & ~hit).alias("fn"),
            F.count_if(positive & hit).alias("tp"),
        )
    )


def confusion_rates(confusion: DataFrame) -> DataFrame:
    """Add fnr and fpr to confusion counts."""
    return (
        confusion.withColumn("pos", F.col("tp") + F.col("fn"))
        .withColumn("neg", F.col("tn") + F.col("fp"))
        .withColumn("fnr", fnr_column())
        .withColumn("fpr", fpr_column())
        .drop("pos", "neg")
    )


def group_auc(
    scored: DataFrame,
    keys: Sequence[str] = ("dataset", "model"),
    scores: DataFrame | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """Exact AUC per (keys, group), with the class sizes it rests on."""
    counts = score_counts(group_rows(scored, keys), keys)
    source = scored if scores is None else scores
    totals = group_totals(range_totals(counts, source, keys, ranges=ranges), keys)
    return totals.select(*keys, GROUP, "pos", "neg", auc_column().alias("auc"))


def group_sizes(scored: DataFrame, keys: Sequence[str] = ("dataset", "model")) -> DataFrame:
    return scored.select(*keys, F.explode("groups").alias(GROUP)).groupBy(*keys, GROUP).agg(
        F.count(F.lit(1)).alias("total_examples")
    )


def score_prefix_counts(
    scored: DataFrame,
    keys: Sequence[str] = ("dataset", "model"),
    scores: DataFrame | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """Per distinct score: positives, negatives and negatives below it, the exact
    tie-aware rank that AUC is built on."""
    cell = [*keys, GROUP]
    counts = score_counts(group_rows(scored, keys), keys)
    counts = with_score_range(counts, scored if scores is None else scores, ranges)
    counts = written(counts, "score-counts")
    local = counts.withColumn("inside", _negatives_below([*cell, "range"], "score", "neg"))
    totals = counts.groupBy(*cell, "range").agg(F.sum("neg").alias("range_neg"))
    offsets = totals.select(
        *[F.col(c).alias(f"_{c}") for c in (*cell, "range")],
        _negatives_below(cell, "range", "range_neg").alias("before"),
    )
    same = F.lit(True)
    for c in (*cell, "range"):
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return local.join(offsets, same).select(
        *cell, "score", "pos", "neg", (F.col("before") + F.col("inside")).alias("neg_below")
    )


def metrics_per_group(
    scored: DataFrame,
    groups: DataFrame,
    keys: Sequence[str],
    threshold: float = 0.5,
    scores: DataFrame | None = None,
    ranges: int | None = None,
    marked: bool = False,
) -> DataFrame:
    """The subgroup metrics of every (keys, grp) in ``groups``; null grp is the whole
    table.

    ``groups`` lists what has to be reported even when nothing was scored.
    ``scores`` is the table to take score quantiles from when that is cheaper than
    reading ``scored``: the predictions, if ``scored`` joins them to the labels.
    ``marked`` adds :data:`ROWS`, which :func:`gated` needs.
    """
    rows = group_rows(scored, keys, marked)
    counts = score_counts(rows.unionByName(_empty_groups(groups, keys, rows)), keys)
    totals = group_totals(
        range_totals(counts, scored if scores is None else scores, keys, threshold, ranges), keys
    )
    metrics = totals.select(
        *keys,
        GROUP,
        (F.col("pos") + F.col("neg")).alias("total_examples"),
        auc_column().alias("subgroup_auc"),
        fnr_column().alias("subgroup_fnr"),
        fpr_column().alias("subgroup_fpr"),
        *([ROWS] if marked else []),
    )
    return metrics


def beside_whole(metrics: DataFrame, keys: Sequence[str], whole: DataFrame) -> DataFrame:
    """Each group's metrics next to those of the whole table, ``whole``, which has one
    row per model."""
    overall = [F.col(f"_{name}").alias(f"overall_{name}") for name in ("auc", "fnr", "fpr")]
    marks = [ROWS] if ROWS in whole.columns else []
    small = whole.select(
        *keys,
        F.col("total_examples").alias("whole_examples"),
        *[F.col(f"subgroup_{name}").alias(f"_{name}") for name in ("auc", "fnr", "fpr")],
        *marks,
    )
    return (
        metrics.drop(ROWS)
        .where(F.col(GROUP).isNotNull())
        .join(F.broadcast(small), list(keys), "left")
        .select(
            *keys, GROUP, "total_examples", "whole_examples", *overall, *METRIC_COLUMNS[3:], *marks
        )
    )


def _beside_whole_of_few(metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """:func:`beside_whole` where the groups of a model are a fixed list."""
    per_model = W.partitionBy(*keys)
    marks = [ROWS] if ROWS in metrics.columns else []
    of_whole = F.struct("total_examples", *METRIC_COLUMNS[3:], *marks)
    return (
        metrics.withColumn("whole", F.max(F.when(F.col(GROUP).isNull(), of_whole)).over(per_model))
        .where(F.col(GROUP).isNotNull())
        .select(
            *keys,
            GROUP,
            "total_examples",
            F.col("whole.total_examples").alias("whole_examples"),
            *[
                F.col(f"whole.subgroup_{name}").alias(f"overall_{name}")
                for name in ("auc", "fnr", "fpr")
            ],
            *METRIC_COLUMNS[3:],
            *[F.col(f"whole.{c}").alias(c) for c in marks],
        )
    )


def located(df: DataFrame, models: Sequence[tuple], keys: Sequence[str]) -> DataFrame:
    """Rows of the listed models, their key columns replaced by ``unit``, the model's
    position in the list: what is shuffled is a number instead of names."""
    if not models:
        raise ValueError("no models to evaluate")
    unit = F
    for i, row in enumerate(models):
        same = reduce(
            Column.__and__, [F.col(k) == F.lit(v) for k, v in zip(keys, row, strict=True)]
        )
        unit = unit.when(same, F.lit(i))
    return df.withColumn("unit", unit).where(F.col("unit").isNotNull()).drop(*keys)


def named_units(
    metrics: DataFrame, models: Sequence[tuple], keys: Sequence[str]
) -> DataFrame:
    """Metrics with ``unit`` replaced by the key columns of the model it stands for."""
    names = [
        F.get(text_array([row[k] for row in models]), F.col("unit")).alias(key)
        for k, key in enumerate(keys)
    ]
    return metrics.select(*names, *[c for c in metrics.columns if c != "unit"])


def gated(metrics: DataFrame, labelled: DataFrame) -> DataFrame:
    """Metrics, undefined where a model's scored rows are not the very rows of
    ``labelled``: as many, and with the same mark. Predictions for other rows, as of a
    table that is filtered here, do no harm. Of ``labelled`` only the ids are read."""
    expected = labelled.agg(
        F.struct(F.count(F.lit(1)).alias("n"), rows_mark(F.col("id")).alias("mark")).alias("rows")
    ).scalar()
    same_rows = F.col(ROWS) == expected.getField("mark")
    sound = (F.col("whole_examples") == expected.getField("n")) & same_rows
    return metrics.select(
        *[
            F.when(sound, F.col(c)).alias(c) if c in METRIC_COLUMNS else F.col(c)
            for c in metrics.columns
            if c not in ("whole_examples", ROWS)
        ]
    )


def _identity_metrics(
    scored: DataFrame,
    models: Sequence[tuple],
    identities: Sequence[str],
    keys: Sequence[str],
    threshold: float,
    scores: DataFrame | None,
    ranges: int | None,
    labelled: DataFrame | None = None,
) -> DataFrame:
    count = len(identities)
    positions = f"concat(array(CAST(NULL AS INT)), slice(sequence(0, {count}), 1, {count}))"
    units = scored.sparkSession.range(0, len(models), 1, 1).select(
        F.col("id").cast("int").alias("unit"), F.explode(F.expr(positions)).alias(GROUP)
    )
    marked = labelled is not None
    metrics = metrics_per_group(scored, units, ["unit"], threshold, scores, ranges, marked)
    metrics = _beside_whole_of_few(metrics, ["unit"])
    if labelled is not None:
        metrics = gated(metrics, labelled)
    return named_units(metrics, models, keys).select(
        *keys,
        F.col(GROUP).alias("ord"),
        F.get(text_array(identities), F.col(GROUP)).alias("identity"),
        "total_examples",
        *METRIC_COLUMNS,
    )


def bias_metrics(
    scored: DataFrame,
    models: Sequence[tuple],
    identities: Sequence[str],
    keys: Sequence[str] = ("dataset", "model"),
    threshold: float = 0.5,
    ranges: int | None = None,
) -> DataFrame:
    """(keys, ord, identity, total_examples, overall and subgroup metrics).

    For rows that carry label, groups and score together, such as the output of a
    scoring job after :func:`with_active_groups`; no join is needed. There is one row
    for every registered model and every identity, also without members or without
    predictions.
    """
    rows = located(scored, models, keys)
    return _identity_metrics(rows, models, identities, keys, threshold, None, ranges)


def evaluate_predictions(
    labelled: DataFrame,
    predictions: DataFrame,
    models: Sequence[tuple],
    identities: Sequence[str],
    keys: Sequence[str] = ("dataset", "model"),
    threshold: float = 0.5,
    membership_cut: float = 0.5,
    ranges: int | None = None,
) -> DataFrame:
    """:func:`bias_metrics` of a prediction table (keys, id, score) against labels.

    The one wide shuffle is the join on the id, of a number, an id and a score with
    a label and a short list. Metrics of a model that lacks a prediction, or has two for
    a row, are undefined; ``total_examples`` then tells what there is.
    """
    wanted = located(predictions, models, keys).select("unit", "id", "score")
    scored = attach_predictions(labelled, wanted, identities, membership_cut)
    return _identity_metrics(
        scored, models, identities, keys, threshold, wanted, ranges, labelled
    )


def flat_metrics(metrics: DataFrame, keys: Sequence[str] = ("dataset", "model")) -> DataFrame:
    """(keys, metric, value): ``roc_auc`` and ``<identity>_subgroup_<metric>``,
    without undefined subgroup entries."""
    entries = [
        F.struct(
            F.concat(F.col("identity"), F.lit(f"_{name}")).alias("metric"),
            F.col(name).alias("value"),
            F.col(name).isNotNull().alias("keep"),
        )
        for name in ("subgroup_auc", "subgroup_fnr", "subgroup_fpr")
    ]
    overall = F.struct(
        F.lit("roc_auc").alias("metric"),
        F.col("overall_auc").alias("value"),
        (F.col("ord") == 0).alias("keep"),
    )
    return (
        metrics.select(*keys, F.inline(F.array(overall, *entries)))
        .where(F.col("keep"))
        .drop("keep")
    )


def best_run(runs: DataFrame, run: str = "model", auc: str = "overall_auc") -> DataFrame:
    """The run with the greatest AUC; undefined ones never win, and of equals the
    one first in name order does."""
    defined = runs.where(F.col(auc).isNotNull() & ~F.isnan(F.col(auc)))
    first = F.min(F.struct((-F.col(auc)).alias("loss"), F.col(run).alias("run"))).alias("first")
    return defined.agg(first).select(
        F.col("first.run").alias("run"), (-F.col("first.loss")).alias("auc")
    )
