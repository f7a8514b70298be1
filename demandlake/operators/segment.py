"""Customer segments from recency, frequency and spend."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandlake.operators.mixture import Mixture, assign, fit_mixture
from demandlake.session import stage

RFM = ("recency", "frequency", "monetary")


def rfm_scaled(rfm: DataFrame) -> DataFrame:
    """Z-scores with the sample deviation; a constant column scales to 0."""
    rfm = stage(rfm, "rfm")
    moments = rfm.agg(
        *[F.avg(c).alias(f"{c}_mean") for c in RFM],
        *[F.stddev_samp(c).alias(f"{c}_sd") for c in RFM],
    )
    scored = rfm.crossJoin(F.broadcast(moments))  # one row
    return scored.select("customer_id", *[
        F.coalesce((F.col(c) - F.col(f"{c}_mean")) / F.nullif(F.col(f"{c}_sd"), F.lit(0.0)), F.lit(0.0))
        .alias(f"{c}_z")
        for c in RFM
    ])


def fit_segments(rfm: DataFrame, k: int = 4, tol: float = 1e-3) -> Mixture | None:
    """The mixture over scaled recency, frequency and spend; segments are numbered by rising
    mean spend and come out the same however the customers are partitioned."""
    return fit_mixture(rfm, RFM, k, tol)


def segment_customers(rfm: DataFrame, model: Mixture | None) -> DataFrame:
    """Customers and their segments; none where there was no customer to fit."""
    if model is None:
        return rfm.select("customer_id", F.lit(0).alias("cluster")).limit(0)
    return assign(rfm, model, "cluster").select("customer_id", "cluster")
