"""Tables that outlive a run: panels, scalers, model parameters, networks, losses and metrics."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from monthloom.operators.mlp import Network
from monthloom.plans.training import Evaluation, FittedModels

_METRICS = "map<string,struct<MAE:double,RMSE:double,MAPE:double>>"


def save_panel(panel: DataFrame, table: str, buckets: int, by_year: bool = False) -> None:
    """A panel as a table whose buckets hold whole series in order, so that later steps shuffle nothing.

    ``by_year`` adds a folder per year, so that queries for some years read those only.
    """
    rows = panel.repartition(buckets, "series_id").write.mode("overwrite")
    rows = rows.partitionBy("year") if by_year else rows
    rows.bucketBy(buckets, "series_id").sortBy("series_id", "ds").saveAsTable(table)


def save_models(models: FittedModels, folder: str) -> None:
    models.scaler.write.mode("overwrite").parquet(f"{folder}/scaler")
    models.params.write.mode("overwrite").partitionBy("model").parquet(f"{folder}/params")
    if models.network is not None:
        layers = models.network.to_frame(models.params.sparkSession)
        layers.coalesce(1).write.mode("overwrite").parquet(f"{folder}/network")


def load_models(spark: SparkSession, folder: str, with_network: bool = True) -> FittedModels:
    scaler, params = _read(spark, f"{folder}/scaler"), _read(spark, f"{folder}/params")
    network = Network.from_frame(_read(spark, f"{folder}/network")) if with_network else None
    return FittedModels(scaler, params, network)


def save_evaluation(result: Evaluation, folder: str) -> None:
    save_models(result.models, folder)
    write_metrics(result.metrics, f"{folder}/metrics")
    result.training.history.coalesce(1).write.mode("overwrite").parquet(f"{folder}/losses")


def read_losses(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, f"{folder}/losses")


def write_metrics(metrics: DataFrame, path: str) -> None:
    """JSON with one object per series: its models, each with MAE, RMSE and MAPE."""
    values = F.struct(F.col("mae").alias("MAE"), F.col("rmse").alias("RMSE"), F.col("mape").alias("MAPE"))
    nested = metrics.groupBy("series_id").agg(
        F.map_from_entries(F.collect_list(F.struct("model", values.alias("values")))).alias("metrics")
    )
    nested.write.mode("overwrite").json(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Metrics written by :func:`write_metrics` as rows ``(series_id, model, mae, rmse, mape)``."""
    try:
        nested = spark.read.schema(f"series_id string, metrics {_METRICS}").json(path)
    except AnalysisException as error:
        raise _absent(error, path) from error
    return _metric_rows(nested)


def read_metrics_document(spark: SparkSession, path: str, series_id: str = "all") -> DataFrame:
    """One JSON document of the form ``{model: {MAE, RMSE, MAPE}}`` as metric rows of one series."""
    try:
        text = spark.read.text(path, wholetext=True)
    except AnalysisException as error:
        raise _absent(error, path) from error
    return _metric_rows(text.select(F.lit(series_id).alias("series_id"), F.from_json("value", _METRICS).alias("metrics")))


def _metric_rows(nested: DataFrame) -> DataFrame:
    rows = nested.select("series_id", F.explode("metrics").alias("model", "m"))
    return rows.select("series_id", "model", *[F.col(f"m.{c}").alias(c.lower()) for c in ("MAE", "RMSE", "MAPE")])


def _read(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        raise _absent(error, path) from error


def _absent(error: AnalysisException, path: str) -> Exception:
    if error.getCondition() == "PATH_NOT_FOUND":
        return FileNotFoundError(f"nothing saved at {path}; evaluate the models and save them first")
    return error
