"""Evaluation over (label, pred, prob) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


_LOWER = "abcdefghijklmnopqrstuvwxyz"


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def metric_columns(label: str = "label", pred: str = "pred") -> list[Column]:
    y, p = F.col(label) == 1, F.col(pred) == 1
    tp, fp, fn, n = F.count_if(y & p), F.count_if(~y & p), F.count_if(y & ~p), F.count("*")
    return [
        n.alias("n"),
        _ratio(F.count_if(F.col(label) == F.col(pred)), n).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    ]


def binary_metrics(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(*metric_columns())


def classification_report(df: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of each class, their mean and their mean weighted by support."""
    classes = []
    for c in (0, 1):
        y, p = F.col("label") == c, F.col("pred") == c
        tp, fp, fn = F.count_if(y & p), F.count_if(~y & p), F.count_if(y & ~p)
        classes.append(df.agg(F.lit(str(c)).alias("class"), _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"), _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), (tp + fn).alias("support")))
    both = classes[0].unionByName(classes[1])
    names = ("precision", "recall", "f1")
    macro = both.agg(F.lit("macro").alias("class"), *[F.avg(c).alias(c) for c in names], F.sum("support").alias("support"))
    weighted = both.agg(F.lit("weighted").alias("class"), *[_ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c) for c in names], F.sum("support").alias("support"))
    return both.unionByName(macro).unionByName(weighted)


def confusion_matrix(df: DataFrame) -> DataFrame:
    """Four rows, zero-filled."""
    counts = df.agg(*[F.count_if((F.col("label") == y) & (F.col("pred") == p)).alias(f"c{y}{p}") for y in (0, 1) for p in (0, 1)])
    rows = F.array(*[F.struct(F.lit(y).alias("label"), F.lit(p).alias("pred"), F.col(f"c{y}{p}").alias("n")) for y in (0, 1) for p in (0, 1)])
    return counts.select(F.inline(rows))


def score_counts(df: DataFrame, prob: str = "prob", digits: int = 4) -> DataFrame:
    """Rows by score on a grid of 10**-digits: at most 10**digits + 1 of them, whatever the input."""
    return df.groupBy(F.round(prob, digits).alias("score")).agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))


def roc_curve(df: DataFrame, prob: str = "prob") -> DataFrame:
    """(score, fpr, tpr) for each distinct score, from high to low. The window runs over the grid of scores only."""
    down = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    c = score_counts(df, prob)
    return c.select("score", _ratio(F.sum("neg").over(down), F.sum("neg").over(whole)).alias("fpr"), _ratio(F.sum("pos").over(down), F.sum("pos").over(whole)).alias("tpr"))


def auc(df: DataFrame, prob: str = "prob") -> DataFrame:
    """Area by trapezoids over tied scores."""
    order = Window.orderBy(F.desc("score"))
    c = roc_curve(df, prob).select("fpr", "tpr", F.lag("fpr", 1, 0.0).over(order).alias("f0"), F.lag("tpr", 1, 0.0).over(order).alias("t0"))
    return c.agg(F.sum((F.col("fpr") - F.col("f0")) * (F.col("tpr") + F.col("t0")) / 2).alias("auc"))


def at_thresholds(df: DataFrame, thresholds: list[float], prob: str = "prob") -> DataFrame:
    """(threshold, tp, fp, fn): one pass; each row adds to the bucket between two thresholds, then sums from above."""
    cuts = sorted(thresholds)
    bucket = F.size(F.filter(F.array(*[F.lit(t) for t in cuts]), lambda t: t <= F.col(prob)))
    counts = df.groupBy(bucket.alias("b")).agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    grid = df.sparkSession.createDataFrame([(k + 1, t) for k, t in enumerate(cuts)], "k int, threshold double")
    both = grid.join(counts, F.lit(True) & (counts.b >= grid.k), "left").groupBy("threshold").agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("tp"), F.coalesce(F.sum("neg"), F.lit(0)).alias("fp"))
    total = df.agg(F.count_if(F.col("label") == 1).alias("positives")).first()["positives"]
    return both.withColumn("fn", F.lit(total) - F.col("tp"))


def pr_by_threshold(df: DataFrame, thresholds: list[float], prob: str = "prob") -> DataFrame:
    c = at_thresholds(df, thresholds, prob)
    return c.select("threshold", _ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), _ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), _ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


def threshold_sweep(df: DataFrame, low: int = 40, high: int = 90, prob: str = "prob") -> DataFrame:
    """The least threshold with the best F1 among low/100 .. high/100."""
    scored = pr_by_threshold(df, [i / 100.0 for i in range(low, high + 1)], prob)
    return scored.select("threshold", "f1").orderBy(F.desc("f1"), "threshold").limit(1)


def metrics_melt(metrics: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    return metrics.unpivot([id_col], columns, "metric", "value")


def best_flags(long: DataFrame) -> DataFrame:
    """Marks each metric's maximum; the table has a row for each model and metric."""
    return long.withColumn("best", F.col("value") == F.max("value").over(Window.partitionBy("metric")))


def version_delta(now: DataFrame, before: DataFrame, keys: list[str]) -> DataFrame:
    return now.join(before.withColumnRenamed("value", "old"), keys, "left").withColumn("delta", F.col("value") - F.col("old"))


def select_best(metrics: DataFrame) -> DataFrame:
    """The row with the greatest F1; the first declared wins ties. Columns: ordinal, model, f1."""
    return metrics.orderBy(F.desc("f1"), "ordinal").limit(1)


def outcome_status(label: str = "label", verdict: str = "verdict") -> Column:
    right = ((F.col(label) == 1) & (F.col(verdict) == "SCAM")) | ((F.col(label) == 0) & (F.col(verdict) == "LEGIT"))
    return F.when(right, "PASS").when(F.col(verdict) == "SUSPICIOUS", "PARTIAL").otherwise("FAIL")


def suite_summary(df: DataFrame) -> DataFrame:
    """Accuracies and error rates over rows with label, verdict and status."""
    n, scam, legit = F.count("*"), F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)
    fn, fp = F.count_if((F.col("label") == 1) & (F.col("verdict") == "LEGIT")), F.count_if((F.col("label") == 0) & (F.col("verdict") == "SCAM"))
    passed, partial = F.count_if(F.col("status") == "PASS"), F.count_if(F.col("status") == "PARTIAL")
    return df.agg(n.alias("n"), passed.alias("passed"), partial.alias("partial"), F.count_if(F.col("status") == "FAIL").alias("failed"), _ratio(passed, n).alias("strict"), _ratio(passed + partial, n).alias("soft"), _ratio(fn, scam).alias("fn_rate"), _ratio(fp, legit).alias("fp_rate"))


def category_breakdown(df: DataFrame, category: str = "category") -> DataFrame:
    n = F.count("*")
    return df.groupBy(category).agg(n.alias("n"), *[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("PASS", "PARTIAL", "FAIL")], (F.count_if(F.col("status") == "PASS") * 100.0 / n).alias("pass_pct")).orderBy("pass_pct", category)


def failure_listing(df: DataFrame, id_col: str = "message_id") -> DataFrame:
    kind = F.when((F.col("label") == 1) & (F.col("verdict") == "LEGIT"), "FN").when((F.col("label") == 0) & (F.col("verdict") == "SCAM"), "FP").when(F.col("verdict") == "SUSPICIOUS", "BORDERLINE")
    return df.select(id_col, "label", "verdict", kind.alias("kind")).where("kind is not null")


def perturb_text(df: DataFrame, text: str = "text") -> DataFrame:
    """One row for each variant: leet, spaced, mixed case, hyphenated."""
    t = F.col(text)
    chars = F.filter(F.split(t, ""), lambda c: c != "")
    mixed = F.array_join(F.transform(chars, lambda c, i: F.when(i % 2 == 0, F.translate(c, _LOWER, _LOWER.upper())).otherwise(F.lower(c))), "")
    variants = {"original": t, "leet": F.translate(F.lower(t), "oieas", "01345"), "spaced": F.array_join(chars, " "), "mixed": mixed, "hyphenated": F.array_join(chars, "-")}
    rows = F.array(*[F.struct(F.lit(n).alias("variant"), c.alias("variant_text")) for n, c in variants.items()])
    return df.select(*[c for c in df.columns if c != text], F.inline(rows))


def variant_robustness(scored: DataFrame, id_col: str = "message_id") -> DataFrame:
    """Variants' verdicts beside the original's. Columns: id, variant, verdict."""
    base = scored.where("variant = 'original'").select(id_col, F.col("verdict").alias("original_verdict"))
    return scored.where("variant <> 'original'").join(base, id_col).withColumn("changed", F.col("verdict") != F.col("original_verdict"))
