"""Deterministic splits, folds and evaluation tables of classifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators import places

#: Ranges that scores are dealt into.
SLICES = 64


def shuffled(seed: int, *keys: str) -> F.Column:
    """An order that the seed gives the keys, the same in every engine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def _dealt(labels: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """labels with each row's place_ in its class, by a shuffled order, and the class's size n_. The order is a hash, whose first digits deal a class into slices."""
    h = labels.withColumn("h_", order)
    placed = places.numbered(h, keys, [F.col("h_"), F.col("id")], "place_", slice_=F.conv(F.substring("h_", 1, 2), 16, 10).cast("int"))
    sizes = labels.groupBy(*[F.col(k).alias(f"{k}_") for k in keys]).agg(F.count(F.lit(1)).alias("n_"))  # a row a class
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_"))
    return placed.join(F.broadcast(sizes), same)


def folds(labels: DataFrame, k: int, seed: int = 123) -> DataFrame:
    """(id, y, fold): each class dealt in turn."""
    return _dealt(labels.select("id", "y"), ["y"], shuffled(seed, "id")).select("id", "y", ((F.col("place_") - 1) % k + 1).alias("fold"))


def train_test(labels: DataFrame, share: float = 0.7, seed: int = 123, min_train: int = 1, min_test: int = 1) -> DataFrame:
    """(id, y, part): ceil(n * share) of each class train, at least min_train, leaving min_test."""
    want = F.greatest(F.lit(min_train), F.least(F.col("n_") - min_test, F.ceil(F.col("n_") * F.lit(share))))
    return _dealt(labels.select("id", "y"), ["y"], shuffled(seed, "id")).select("id", "y", F.when(F.col("place_") <= want, "train").otherwise("test").alias("part"))


def split_plan(labels: DataFrame, repeats: int, share: float = 0.8, seed: int = 123) -> DataFrame:
    """train_test of each repeat, seeded one further each time."""
    each = labels.select("id", "y", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("repeat"))
    key = F.md5(F.concat_ws("|", (F.col("repeat") + (seed - 1)).cast("string"), F.col("id").cast("string")))
    dealt = _dealt(each, ["repeat", "y"], key)
    return dealt.select("repeat", "id", "y", F.when(F.col("place_") <= F.least(F.col("n_") - 1, F.ceil(F.col("n_") * F.lit(share))), "train").otherwise("test").alias("part"))


def confusion(pred: DataFrame) -> DataFrame:
    return pred.groupBy("actual", "predicted").agg(F.count(F.lit(1)).alias("n"))


def class_metrics(pred: DataFrame) -> DataFrame:
    """Counts and rates of each class against the rest, from one aggregate of the confusion cells."""
    cells = confusion(pred)
    one = cells.select(F.explode(F.array(F.struct(F.col("actual").alias("class"), "n", F.lit(1).alias("a"), (F.col("actual") == F.col("predicted")).cast("int").alias("tp")), F.struct(F.col("predicted").alias("class"), "n", F.lit(0).alias("a"), F.lit(0).alias("tp")))).alias("s"))
    per = one.groupBy("s.class").agg(F.sum(F.expr("s.n * s.tp")).alias("tp"), F.sum(F.expr("s.n * s.a")).alias("actual"), F.sum(F.expr("s.n * (1 - s.a)")).alias("predicted"))
    all_ = cells.agg(F.sum("n").alias("all_"))
    per = per.join(F.broadcast(all_)).withColumn("fp", F.col("predicted") - F.col("tp")).withColumn("fn", F.col("actual") - F.col("tp")).withColumn("tn", F.col("all_") - F.col("actual") - F.col("fp"))
    div = F.try_divide
    return per.select(
        "class", "tp", "fp", "tn", "fn", F.round(div("tp", F.col("tp") + F.col("fn")), 6).alias("sensitivity"), F.round(div("tn", F.col("tn") + F.col("fp")), 6).alias("specificity"),
        F.round(div("tp", F.col("tp") + F.col("fp")), 6).alias("precision"), F.round(div(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), 6).alias("f1"),
    )


def summary(pred: DataFrame) -> DataFrame:
    m = class_metrics(pred).agg(F.round(F.avg("sensitivity"), 6).alias("macro_sensitivity"), F.round(F.avg("specificity"), 6).alias("macro_specificity"), F.round(F.avg("precision"), 6).alias("macro_precision"), F.round(F.avg("f1"), 6).alias("macro_f1"))
    a = pred.agg(F.round(F.avg((F.col("actual") == F.col("predicted")).cast("double")), 6).alias("accuracy"))
    return a.join(F.broadcast(m))


def balanced_accuracy(pred: DataFrame, by: str) -> DataFrame:
    """(by, balanced_accuracy): the mean recall of the classes that a resample holds."""
    hit = (F.col("actual") == F.col("predicted")).cast("double")
    recall = pred.filter("actual is not null").groupBy(by, "actual").agg(F.avg(F.coalesce(hit, F.lit(0.0))).alias("recall"))
    return recall.groupBy(by).agg(F.round(F.avg("recall"), 6).alias("balanced_accuracy"))


def likeliest(probabilities: Column, classes: list[str]) -> Column:
    """The class of the largest probability, the first among equals."""
    return F.try_element_at(F.array(*[F.lit(c) for c in classes]), F.array_position(probabilities, F.array_max(probabilities)).cast("int"))


def _running(by: DataFrame) -> DataFrame:
    """by (score, p, q), a row each score, with p_below, q_below, p_all and q_all: sums over lower scores. Scores are dealt into ranges whose sums are carried on, so no task holds them all."""
    bounds = by.agg(F.percentile_approx("score", [i / SLICES for i in range(1, SLICES)], 100 * SLICES)).first()[0] or []
    slice_ = F.lit(0)
    for b in sorted(set(bounds)):
        slice_ = slice_ + (F.col("score") > b).cast("int")
    by = by.withColumn("slice_", slice_)
    sums = by.groupBy("slice_").agg(F.sum("p").alias("p_"), F.sum("q").alias("q_"))
    before, whole = Window.partitionBy().orderBy("slice_").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()  # of at most SLICES rows
    sums = sums.select("slice_", *(F.coalesce(F.sum(f"{c}_").over(before), F.lit(0)).alias(f"{c}_ahead") for c in "pq"), *(F.sum(f"{c}_").over(whole).alias(f"{c}_all") for c in "pq"))
    own = Window.partitionBy("slice_").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    out = by.join(F.broadcast(sums), "slice_")
    return out.select("score", "p", "q", *((F.coalesce(F.sum(c).over(own), F.lit(0)) + F.col(f"{c}_ahead")).alias(f"{c}_below") for c in "pq"), "p_all", "q_all")


def _by_score(pred: DataFrame, positive: str) -> DataFrame:
    yes = (F.col("actual") == positive).cast("long")
    return pred.groupBy("score").agg(F.sum(yes).alias("p"), F.sum(1 - yes).alias("q"))


def roc(pred: DataFrame, positive: str) -> DataFrame:
    """(threshold, tpr, fpr) of each distinct score, from counts by score."""
    r = _running(_by_score(pred, positive))
    rate = {c: F.round(F.try_divide(F.col(f"{c}_all") - F.col(f"{c}_below"), f"{c}_all"), 6) for c in "pq"}
    return r.select(F.col("score").alias("threshold"), rate["p"].alias("tpr"), rate["q"].alias("fpr"))


def auc(pred: DataFrame, positive: str) -> DataFrame:
    """Area under the ROC curve by trapezoids over distinct scores."""
    part = _running(_by_score(pred, positive)).select(((F.col("q_below") + F.col("q") / 2) * F.col("p")).alias("area"), "p", "q")
    return part.agg(F.round(F.try_divide(F.sum("area"), (F.sum("p") * F.sum("q")).cast("double")), 6).alias("auc"))
