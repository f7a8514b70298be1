"""Demand regression and the price that maximises revenue on a grid."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer, StringIndexer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demandlake.functions.numeric import intercept, slope
from demandlake.operators.boosting import BoostedTrees, fit_boosted
from demandlake.operators.retail import MISSING_CATEGORY, ensure_columns, impute

# --- Fixed values: the model's inputs and the grid. ---
FEATURES = (
    "price", "prod_avg_price", "prod_total_qty", "prod_unique_buyers", "year", "month",
    "dow", "review_score", "age", "payment_method_code",
)
LABEL = "quantity"
GRID_LOW, GRID_HIGH, GRID_POINTS = 0.7, 1.3, 15
TREES, LEARNING_RATE, DEPTH, PATIENCE, VALIDATION_SHARE = 1000, 0.05, 5, 30, 0.15
# --- End of fixed values. ---


# --- Demand model ----------------------------------------------------------


def payment_codes() -> StringIndexer:
    """Codes by alphabet; values not seen in training share the last code."""
    return StringIndexer(
        inputCol="payment_method", outputCol="payment_method_ix",
        stringOrderType="alphabetAsc", handleInvalid="keep",
    )


def category_codes(lines: DataFrame) -> DataFrame:
    """Each payment method with its code and number of rows."""
    rows = lines.select(F.coalesce("payment_method", F.lit(MISSING_CATEGORY)).alias("payment_method"))
    counts = rows.groupBy("payment_method").agg(F.count(F.lit(1)).alias("cnt"))
    coded = payment_codes().fit(counts).transform(counts)
    return coded.select("payment_method", F.col("payment_method_ix").cast("int").alias("code"), "cnt")


def training_frame(features: DataFrame, seed: int = 42) -> DataFrame:
    """Imputed features with a stable 85/15 training/validation mark."""
    inputs = [c for c in FEATURES if c != "payment_method_code"]
    ready = impute(ensure_columns(features, inputs, ["payment_method"]))
    draw = F.pmod(F.xxhash64(F.lit(seed), *features.columns), F.lit(100))
    # A missing number counts as 0, in training and in scoring.
    ready = ready.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in inputs})
    return ready.withColumns({
        "is_val": draw < int(VALIDATION_SHARE * 100),
        "label": F.col(LABEL).cast("double"),
    })


@dataclass(frozen=True)
class DemandModel:
    """Codes of the text inputs, and the trees over all inputs."""

    codes: PipelineModel
    trees: BoostedTrees


def fit_demand(
    training: DataFrame,
    trees: int = TREES,
    learning_rate: float = LEARNING_RATE,
    depth: int = DEPTH,
    patience: int = PATIENCE,
    seed: int = 42,
) -> DemandModel:
    """Boosted trees for the quantity of an order line.

    Training ends at ``trees``, or before when the validation error has not come below its
    least for ``patience`` trees; those after the least are taken back.
    """
    codes = Pipeline(stages=[
        payment_codes(),
        # A plain number: as a category it would be limited by the tree's bins.
        SQLTransformer(
            statement="SELECT *, payment_method_ix + 0D AS payment_method_code FROM __THIS__"
        ),
    ]).fit(training)
    return DemandModel(codes, fit_boosted(
        codes.transform(training), FEATURES, "label", "is_val", trees, learning_rate, depth, patience, seed=seed
    ))


def predict_demand(frame: DataFrame, model: DemandModel) -> DataFrame:
    coded = model.codes.transform(frame)
    return coded.withColumn("predicted_quantity", model.trees.predict()).drop(
        "payment_method_ix", "payment_method_code"
    )


def save_model(spark: SparkSession, model: DemandModel, path: str) -> None:
    """To a folder that does not exist yet: a model is never half of an older one."""
    model.codes.write().save(f"{path}/codes")
    model.trees.save(spark, f"{path}/trees")


def load_model(spark: SparkSession, path: str) -> DemandModel:
    return DemandModel(PipelineModel.load(f"{path}/codes"), BoostedTrees.load(spark, f"{path}/trees"))


# --- Price grid ------------------------------------------------------------


def with_base_price(products: DataFrame) -> DataFrame:
    """Average price, or the representative's own when that is 0; others are left out."""
    base = F.coalesce(F.nullif(F.col("prod_avg_price"), F.lit(0.0)), F.col("price"))
    return products.withColumn("base_price", base).where("base_price > 0")


def grid_price(index: Column, low: float, high: float, points: int) -> Column:
    width = round(high - low, 12)
    return F.col("base_price") * (F.lit(low) + F.lit(width) * index / max(points - 1, 1))


def price_grid(
    products: DataFrame, low: float = GRID_LOW, high: float = GRID_HIGH, points: int = GRID_POINTS
) -> DataFrame:
    """``points`` candidate prices per product, in place of its own price."""
    steps = with_base_price(products).withColumn(
        "grid_index", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    )
    return steps.withColumn("price", grid_price(F.col("grid_index"), low, high, points))


def best_price(grid: DataFrame, quantity: str = "predicted_quantity") -> DataFrame:
    """The grid price of highest revenue per product; equal revenue takes the lowest index."""
    revenue = F.col("price") * F.greatest(F.col(quantity), F.lit(0.0))
    pick = F.struct("revenue", (-F.col("grid_index")).alias("rank"), "price")
    best = grid.withColumn("revenue", revenue).groupBy("product_id").agg(F.max(pick).alias("best"))
    return best.select(
        "product_id",
        F.col("best.price").alias("best_price"),
        F.col("best.revenue").alias("estimated_revenue"),
    )


# --- Closed-form demand ----------------------------------------------------

UNIT = 10_000  # prices are regressed in ten-thousandths, so that sums are exact


def demand_curves(lines: DataFrame) -> DataFrame:
    """Least-squares quantity against price per product, over its order lines."""
    x = (F.col("price") * UNIT).cast("decimal(18,0)")
    y = F.col("quantity").cast("decimal(18,0)")
    sums = lines.groupBy("product_id").agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.sum(x).cast("double").alias("sx"),
        F.sum(y).cast("double").alias("sy"),
        F.sum(x * x).cast("double").alias("sxx"),
        F.sum(x * y).cast("double").alias("sxy"),
    )
    n, sx, sy, sxx, sxy = (F.col(c) for c in ("n", "sx", "sy", "sxx", "sxy"))
    b = F.coalesce(slope(n, sx, sy, sxx, sxy), F.lit(0.0))
    return sums.withColumn("b", b).select(
        "product_id",
        intercept(n, sx, sy, F.col("b")).alias("demand_base"),
        (F.col("b") * UNIT).alias("demand_slope"),
        (sx / UNIT / n).alias("prod_avg_price"),
    )


def best_price_closed(
    curves: DataFrame, low: float = GRID_LOW, high: float = GRID_HIGH, points: int = GRID_POINTS
) -> DataFrame:
    """Grid search on a linear demand curve, inside the row: no explode, no shuffle."""

    def candidate(i: Column) -> Column:
        price = grid_price(i, low, high, points)
        demand = F.col("demand_base") + F.col("demand_slope") * price
        return F.struct(
            (price * F.greatest(demand, F.lit(0.0))).alias("revenue"),
            (-i).alias("rank"),
            price.alias("price"),
        )

    best = F.array_max(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), candidate))
    return (
        curves.withColumn("base_price", F.col("prod_avg_price"))
        .where("base_price > 0")
        .select("product_id", best.alias("best"))
        .select(
            "product_id",
            F.col("best.price").alias("best_price"),
            F.col("best.revenue").alias("estimated_revenue"),
        )
    )
