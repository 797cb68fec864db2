"""Image kernels over decoded pixels and per-image metrics as Spark expressions. Decoding needs a library that is not assumed here."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def shades_of_gray(pixels: DataFrame, image: str, channels: list[str], power: int = 6) -> DataFrame:
    """(image, one gain for each channel) of pixels (image, *channels): colour constancy by Finlayson and Trezzi.

    The illuminant is the Minkowski mean of each channel, made a unit vector; a channel is divided by its
    part times the root of the number of channels. A black channel's gain is NULL."""
    light = pixels.groupBy(image).agg(*(F.pow(F.avg(F.pow(F.col(c).cast("double"), power)), 1 / power).alias(c) for c in channels))
    length = F.sqrt(sum((F.col(c) * F.col(c) for c in channels), F.lit(0.0)))
    return light.select(image, *(F.when(F.col(c) > 0, length / (F.col(c) * len(channels) ** 0.5)).alias(c) for c in channels))


def corrected(pixels: DataFrame, gains: DataFrame, image: str, channels: list[str]) -> DataFrame:
    """pixels with each channel times its gain, cut to 0 to 255; a channel without a gain stays."""
    own = gains.select(image, *(F.col(c).alias(f"{c}_gain") for c in channels))
    fixed = {c: F.least(F.greatest(F.col(c) * F.coalesce(F.col(f"{c}_gain"), F.lit(1.0)), F.lit(0.0)), F.lit(255.0)) for c in channels}
    return pixels.join(own, image).select(*(fixed[c].alias(c) if c in fixed else F.col(c) for c in pixels.columns))


def normalise(values: Column, mean: float, std: float) -> Column:
    return F.transform(values, lambda x: (x / 255.0 - mean) / std)


def fallback_rate(df: DataFrame, flag: str) -> DataFrame:
    """One row (fallback_rate): the share of images whose flag is set; those without a flag don't count."""
    return df.agg(F.avg(F.col(flag).cast("double")).alias("fallback_rate"))
