"""Feature scaling and weights as one-row aggregates joined back.

Scaling uses the *population* standard deviation (as the reference's
scaler) so that distances, DBSCAN's eps and WCSS keep their meaning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortkit.functions.core import add_scalars
from cohortkit.operators.selection import quantiles


def standard_scale(df: DataFrame, cols: list[str], suffix: str = "") -> DataFrame:
    """z = (x - mean) / std_pop; a constant column scales to 0."""
    stats = df.agg(*[F.avg(c).alias(f"_mu_{c}") for c in cols],
                   *[F.stddev_pop(c).alias(f"_sd_{c}") for c in cols])
    j = add_scalars(df, stats)
    new = {f"{c}{suffix}": F.when(F.col(f"_sd_{c}") == 0, F.lit(0.0))
           .otherwise((F.col(c) - F.col(f"_mu_{c}")) / F.col(f"_sd_{c}")) for c in cols}
    return j.withColumns(new).drop(*[f"_mu_{c}" for c in cols], *[f"_sd_{c}" for c in cols])


def log_features(df: DataFrame, cols: list[str] = ("F", "M")) -> DataFrame:
    """log1p of the skewed metrics (F and M); other columns unchanged."""
    return df.withColumns({c: F.log1p(F.col(c)) for c in cols})


def winsorize(df: DataFrame, cols: list[str], p: float = 0.99) -> DataFrame:
    """cap each column at its exact ``p`` quantile (upper side only); all caps are found together by narrowing."""
    caps = quantiles(df, cols, [p])
    return df.withColumns({c: F.least(F.col(c).cast("double"), F.lit(caps[c][0]).cast("double")) for c in cols})


def variance_weights(df: DataFrame, cols: list[str]) -> DataFrame:
    """one row ``w_{c}`` = var_pop(c) / sum of var_pop; uniform if the sum is 0."""
    v = df.agg(*[F.var_pop(c).alias(f"_v_{c}") for c in cols])
    tot = sum((F.col(f"_v_{c}") for c in cols), F.lit(0.0))
    return v.select(*[F.when(tot > 0, F.col(f"_v_{c}") / tot).otherwise(F.lit(1.0 / len(cols))).alias(f"w_{c}")
                      for c in cols])


def deviation_weights(df: DataFrame, cols: list[str]) -> DataFrame:
    """one row ``w_{c}`` = sum |x - mean| / total over the metrics; uniform if the total is 0."""
    mu = df.agg(*[F.avg(c).alias(f"_mu_{c}") for c in cols])
    dev = add_scalars(df, mu).agg(*[F.sum(F.abs(F.col(c) - F.col(f"_mu_{c}"))).alias(f"_d_{c}") for c in cols])
    tot = sum((F.col(f"_d_{c}") for c in cols), F.lit(0.0))
    return dev.select(*[F.coalesce(F.try_divide(F.col(f"_d_{c}"), tot), F.lit(1.0 / len(cols))).alias(f"w_{c}")
                        for c in cols])


def apply_weights(df: DataFrame, cols: list[str], weights: DataFrame, s_weight: float = 1.0,
                  s_prefix: str = "S_") -> DataFrame:
    """multiply each column by its weight; S columns also by ``s_weight``."""
    j = add_scalars(df, weights)
    new = {}
    for c in cols:
        v = F.col(c) * F.col(f"w_{c}")
        if s_weight != 1.0 and c.startswith(s_prefix):
            v = v * F.lit(s_weight)
        new[c] = v
    return j.withColumns(new).drop(*[f"w_{c}" for c in cols])
