"""Evaluation of scores (y 0/1, p or logit)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fragloom.operators.sampling import running


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def bce(logit: Column, y: Column) -> Column:
    """Binary cross-entropy of a logit, without overflow."""
    return F.greatest(logit, F.lit(0.0)) - logit * y + F.log1p(F.exp(-F.abs(logit)))


def epoch_loss(rows: DataFrame, batch: str, loss: str) -> DataFrame:
    """Mean of the batches' means."""
    return rows.groupBy(batch).agg(F.avg(loss).alias("m")).agg(F.avg("m").alias("loss"))


def accuracy(rows: DataFrame, p: Column, y: Column, cutoff: float = 0.5) -> DataFrame:
    return rows.agg(F.avg(((p > cutoff) == (y == 1)).cast("double")).alias("accuracy"))


def auroc(rows: DataFrame, score: str, y: str) -> DataFrame:
    """(auroc): exact area under the ROC curve, ties counted half; NULL if a class is missing.

    Counts per distinct score come first; only they are ordered, range by range.
    """
    each = rows.groupBy(score).agg(F.sum(y).alias("p"), F.sum(1 - F.col(y)).alias("n"))
    t = running(each, score, F.col("n"), "below").withColumn("won", F.col("p") * (F.col("below") + F.col("n") / 2))
    return t.agg(F.sum("won").alias("won"), F.sum("p").alias("p"), F.sum("n").alias("n")).select(F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("won") / (F.col("p") * F.col("n"))).alias("auroc"))


def histogram(rows: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """(y, bin, n) over fixed bins of 0..1; 1 itself is in the last."""
    return rows.groupBy(y, F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def parameter_counts(parameters: DataFrame) -> DataFrame:
    """(trainable, total, percent) of a table (name, n, requires_grad)."""
    t = parameters.agg(F.coalesce(F.sum(F.when(F.col("requires_grad"), F.col("n"))), F.lit(0)).alias("trainable"), F.sum("n").alias("total"))
    return t.withColumn("percent", F.try_divide(100.0 * F.col("trainable"), F.col("total")))


def size_table(stats: DataFrame) -> DataFrame:
    """Samples by pad, a column for each (split, kind); kinds without a pad are added to every row as constants."""
    cols = [r[0] for r in stats.where("pad IS NOT NULL").select(F.concat_ws("_", "split", "kind").alias("c")).distinct().orderBy("c").collect()]
    wide = stats.where("pad IS NOT NULL").withColumn("c", F.concat_ws("_", "split", "kind")).groupBy("pad").pivot("c", cols).agg(F.sum("samples")).fillna(0)
    fixed = {r["c"]: r["n"] for r in stats.where("pad IS NULL").groupBy(F.concat_ws("_", "split", "kind").alias("c")).agg(F.sum("samples").alias("n")).collect()}
    return wide.withColumns({f"{c}_fixed": F.lit(n) for c, n in sorted(fixed.items())})
