"""Loss aggregates over rows of pixels and channels (pred, gt, and optional weight and mask columns), per group.

Where a pixel has several rows (channels), `channels` says how many: weights and
masks count once a pixel in the denominators. A mean is capped at `CAP`. Null
rows count nothing; a group of nulls only has a null loss or 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-8
CAP = 100.0


def sigmoid(x: str | Column) -> Column:
    return 1 / (1 + F.exp(-(F.col(x) if isinstance(x, str) else x)))


def _squeezed(smooth: float) -> Column:
    """The target moved into [smooth, 1 - smooth]."""
    return F.greatest(F.col("gt") - 2 * smooth, F.lit(0.0)) + smooth


def _factor(weight: str | None, valid: str | None) -> Column:
    out = F.lit(1.0)
    for c in (weight, valid):
        out = out * F.col(c) if c else out
    return out


def _reduced(df: DataFrame, g: str, e: Column, reduction: str, weight: str | None, valid: str | None, channels: int) -> DataFrame:
    """Row losses e (weight and mask in them) as none (mean of a sample's rows), sum, or mean by one of four denominators."""
    if reduction == "none":
        out = F.avg(e)
    elif reduction == "sum":
        out = F.sum(e)
    elif reduction == "mean" and (weight or valid):
        out = F.least(F.sum(e) / F.greatest(F.sum(_factor(weight, valid)) / channels, F.lit(EPS)), F.lit(CAP))
    elif reduction == "mean":
        out = F.least(F.avg(e) * 10, F.lit(CAP))
    else:
        raise ValueError(f"reduction {reduction} is not none, mean or sum")
    return df.groupBy(g).agg(out.alias("loss"))


def mse(df: DataFrame, g: str, weight: str = "w", valid: str | None = "valid", channels: int = 1) -> DataFrame:
    """Weighted squared error over the weight of valid pixels, capped."""
    return _reduced(df, g, (F.col("pred") - F.col("gt")) ** 2 * _factor(weight, valid), "mean", weight, valid, channels)


def smooth_l1(df: DataFrame, g: str, weight: str = "w", valid: str | None = None, channels: int = 1) -> DataFrame:
    """Smooth absolute error of weighted values over the sum of weights, not capped."""
    d = F.abs(F.col("pred") - F.col("gt")) * F.col(weight)
    mask = F.col(valid) if valid else F.lit(1.0)
    e = F.when(d < 1, 0.5 * d * d).otherwise(d - 0.5) * mask
    return df.groupBy(g).agg((F.sum(e) / F.greatest(F.sum(F.col(weight) * mask) / channels, F.lit(EPS))).alias("loss"))


def bce(df: DataFrame, g: str, reduction: str = "mean", weight: str | None = "w", valid: str | None = "valid", channels: int = 1) -> DataFrame:
    """Binary cross-entropy of logits, logarithms of at least 1e-8."""
    p = sigmoid("pred")
    e = -(F.log(F.greatest(p, F.lit(EPS))) * F.col("gt") + F.log(F.greatest(1 - p, F.lit(EPS))) * (1 - F.col("gt")))
    return _reduced(df, g, e * _factor(weight, valid), reduction, weight, valid, channels)


def focal(df: DataFrame, g: str, reduction: str = "mean", weight: str | None = "w", valid: str | None = "valid", alpha: float = 2.0, beta: float = 4.0, smooth: float = 0.001, channels: int = 1) -> DataFrame:
    """Modified focal loss of logits: every row has a positive part, by its squeezed target, and a negative part."""
    p, t = F.greatest(sigmoid("pred"), F.lit(EPS)), _squeezed(smooth)
    pos = F.pow(1 - p, F.lit(alpha)) * F.pow(t, F.lit(beta)) * F.log(p)
    neg = F.pow(p, F.lit(alpha)) * F.pow(1 - t, F.lit(beta)) * F.log(F.greatest(1 - p, F.lit(EPS)))
    return _reduced(df, g, -(pos + neg) * _factor(weight, valid), reduction, weight, valid, channels)


def dice(df: DataFrame, g: str, smooth: float = 0.0, batch: str | None = None, reduction: str = "mean") -> DataFrame:
    """1 - 2 |p t| / (|p| + |t|) of sigmoids per sample g; with a batch column, its mean or sum over the batch's samples."""
    p, t = sigmoid("pred"), _squeezed(smooth)
    keys = [batch, g] if batch else [g]
    one = df.groupBy(*keys).agg((1 - 2 * F.sum(p * t) / F.greatest(F.sum(t) + F.sum(p), F.lit(EPS))).alias("loss"))
    if not batch:
        return one
    return one.groupBy(batch).agg((F.avg if reduction == "mean" else F.sum)("loss").alias("loss"))


def composed(df: DataFrame, g: str) -> DataFrame:
    """Plain cross-entropy plus Dice of each sample."""
    a, b = bce(df, g, weight=None, valid=None), dice(df, g).withColumnRenamed("loss", "d")
    return a.join(b, g).select(g, (F.col("loss") + F.col("d")).alias("loss"))


#: Criteria of a detector's parts, by name.
CRITERIA = {"bce": bce, "mse": mse, "smooth_l1": smooth_l1, "focal": focal}


def detector(df: DataFrame, g: str, criteria: tuple[str, str, str] = ("focal", "focal", "mse"), scale: tuple[float, float, float] = (1.0, 5.0, 10.0), channels: tuple[int, int, int] = (1, 6, 12), floor: float = 0.002) -> DataFrame:
    """(g, loss_loc, loss_prob, loss_vec, loss_sum) of a keypoint detector.

    df: rows (g, part: loc, prob or vec, pred, gt, w: the location's target at
    the pixel, valid). Locations and probabilities take `floor` for a weight of
    zero, vectors the weight as it is.
    """
    filled = df.withColumn("w", F.when((F.col("w") == 0) & (F.col("part") != "vec"), floor).otherwise(F.col("w")))
    out = None
    for name, kind, n in zip(("loc", "prob", "vec"), criteria, channels, strict=True):
        part = CRITERIA[kind](filled.where(F.col("part") == name), g, weight="w", valid="valid", channels=n).withColumnRenamed("loss", f"loss_{name}")
        out = part if out is None else out.join(part, g, "full_outer")
    total = sum(F.coalesce(f"loss_{n}", F.lit(0.0)) * s for n, s in zip(("loc", "prob", "vec"), scale, strict=True))
    return out.withColumn("loss_sum", total)
