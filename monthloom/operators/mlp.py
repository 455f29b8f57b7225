"""A small network with ReLU layers, trained on the scaled rows of all series together."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from monthloom.config import FEATURE_COLS, PanelConfig
from monthloom.functions.numeric import dot
from monthloom.session import checkpointed

Z_COLS = tuple(f"z_{c}" for c in FEATURE_COLS)
_LAYER_SCHEMA = (
    "layer INT, n_in INT, n_out INT, learning_rate DOUBLE, weights ARRAY<ARRAY<DOUBLE>>, bias ARRAY<DOUBLE>"
)
_SUMS_SCHEMA = "kind STRING, pos INT, value DOUBLE, weight DOUBLE"
# Sums over tasks are taken in decimals, so their order does not show in the result.
_EXACT = "decimal(38,14)"
# A weight or loss, on standardised values, from which training counts as diverged.
_DIVERGED = 1e9


@dataclass(frozen=True)
class Network:
    """Weights ``(n_in, n_out)`` and biases of each layer. Its size depends on the layers only."""

    weights: tuple[np.ndarray, ...]
    biases: tuple[np.ndarray, ...]
    learning_rate: float = 0.001

    @classmethod
    def seeded(cls, sizes: Sequence[int], seed: int, learning_rate: float = 0.001) -> Network:
        """Weights drawn with variance 2 / n_in, biases 0."""
        rng = np.random.default_rng(seed)
        weights = tuple(rng.normal(0.0, math.sqrt(2.0 / a), (a, b)) for a, b in zip(sizes, sizes[1:]))
        return cls(weights, tuple(np.zeros(b) for b in sizes[1:]), learning_rate)

    def flat(self) -> np.ndarray:
        return np.concatenate([part.ravel() for layer in zip(self.weights, self.biases) for part in layer])

    def from_flat(self, values: np.ndarray) -> Network:
        weights, biases, at = [], [], 0
        for w, b in zip(self.weights, self.biases):
            weights.append(values[at : at + w.size].reshape(w.shape))
            biases.append(values[at + w.size : at + w.size + b.size].reshape(b.shape))
            at += w.size + b.size
        return Network(tuple(weights), tuple(biases), self.learning_rate)

    def to_frame(self, spark: SparkSession) -> DataFrame:
        """One row per layer."""
        rows = [
            (i, *w.shape, self.learning_rate, w.tolist(), b.tolist())
            for i, (w, b) in enumerate(zip(self.weights, self.biases))
        ]
        return spark.createDataFrame(rows, _LAYER_SCHEMA)

    @classmethod
    def from_frame(cls, layers: DataFrame) -> Network:
        rows = layers.orderBy("layer").collect()
        return cls(
            tuple(np.array(r["weights"], dtype=float).reshape(r["n_in"], r["n_out"]) for r in rows),
            tuple(np.array(r["bias"], dtype=float) for r in rows),
            rows[0]["learning_rate"],
        )


def forward(network: Network, x: np.ndarray) -> list[np.ndarray]:
    """Outputs of every layer, the input first; the last layer is linear."""
    outputs = [x]
    for i, (w, b) in enumerate(zip(network.weights, network.biases)):
        z = outputs[-1] @ w + b
        outputs.append(z if i == len(network.weights) - 1 else np.maximum(z, 0.0))
    return outputs


def gradient(network: Network, x: np.ndarray, y: np.ndarray, n: float | None = None) -> tuple[np.ndarray, float]:
    """Gradient of the squared error in the order of :meth:`Network.flat`, and the squared error, over ``n`` rows."""
    n = len(y) if n is None else n
    outputs = forward(network, x)
    miss = outputs[-1] - y[:, None]
    delta, parts = 2.0 * miss / n, []
    for i in reversed(range(len(network.weights))):
        parts[:0] = [(outputs[i].T @ delta).ravel(), delta.sum(0)]
        if i:
            delta = (delta @ network.weights[i].T) * (outputs[i] > 0)
    return np.concatenate(parts), float((miss**2).sum() / n)


def predict_network(rows: DataFrame, network: Network, columns: Sequence[str] = Z_COLS, out: str = "z_yhat") -> DataFrame:
    """Add the network's output; only the input columns travel to Python, in Arrow batches."""

    @pandas_udf("double")
    def apply(x: pd.Series) -> pd.Series:
        return pd.Series(forward(network, np.stack(x).astype(float))[-1][:, 0] if len(x) else [], dtype=float)

    return rows.withColumn(out, apply(F.array(*columns).cast("array<double>")))


def network_expression(network: Network, inputs: Column) -> Column:
    """The same output as a Spark expression over an array of doubles."""
    last = len(network.weights) - 1
    layers = F.array(
        *[
            F.struct(
                F.lit([[*column, bias] for column, bias in zip(w.T.tolist(), b.tolist())]).alias("units"),
                F.lit(i == last).alias("linear"),
            )
            for i, (w, b) in enumerate(zip(network.weights, network.biases))
        ]
    )

    def apply(values: Column, layer: Column) -> Column:
        # A unit is its weights followed by its bias, which meets an input of 1.
        extended = F.array_append(values, F.lit(1.0))
        sums = F.transform(layer["units"], lambda unit: dot(extended, unit))
        return F.transform(sums, lambda z: F.when(layer["linear"], z).otherwise(F.greatest(F.lit(0.0), z)))

    return F.aggregate(layers, inputs, apply)[0]


def full_gradient(rows: DataFrame, network: Network, columns: Sequence[str] = Z_COLS, target: str = "z_y") -> DataFrame:
    """Gradient of the mean squared error over all rows, as ``(pos, gradient)`` in the order of ``Network.flat``.

    Each task sums the terms of its rows; Spark adds these sums and divides by the number of rows.
    """

    def per_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, seen = np.zeros(network.flat().size), 0
        for batch in batches:
            terms, _ = gradient(network, batch[list(columns)].to_numpy(float), batch[target].to_numpy(float), n=1.0)
            total, seen = total + terms, seen + len(batch)
        if seen:
            yield _sums("gradient", total, float(seen))

    sums = rows.select(*columns, target).mapInPandas(per_task, _SUMS_SCHEMA)
    return sums.groupBy("pos").agg((F.sum("value") / F.sum("weight")).alias("gradient"))


@dataclass(frozen=True)
class Training:
    """``network`` is None if training diverged; the losses are those of the rounds before."""

    network: Network | None
    history: DataFrame


def train_network(scaled: DataFrame, cfg: PanelConfig = PanelConfig(), tasks: int | None = None) -> Training:
    """Train on the rows marked ``train``; the loss on those marked ``test`` is only measured.

    Every task trains a copy on its own rows for some epochs of shuffled mini-batches; then the copies are averaged
    by their number of rows and handed out again. With one series this is plain mini-batch descent. What returns to
    the driver per round is one network and a few losses, whatever the number of rows. Rows lie in tasks by
    series and in order, and each task draws from a seed of its own, so a task that runs again gives the same.

    The number of tasks is ``cfg.mlp_shards``, whatever the number of rows, so that the method is the same at every
    size; a shard is held in memory, so raise it with the number of series.
    """
    spark = scaled.sparkSession
    tasks = tasks or cfg.mlp_shards
    # A month without a value has nothing to learn from.
    wanted = scaled.select("series_id", "ds", "split", *Z_COLS, "z_y").dropna(subset=[*Z_COLS, "z_y"])
    laid_out = checkpointed(wanted.repartition(tasks, "series_id").sortWithinPartitions("series_id", "ds"))
    network = Network.seeded((len(Z_COLS), *cfg.mlp_hidden, 1), cfg.seed, cfg.mlp_learning_rate)
    losses, done = [], 0
    while done < cfg.mlp_epochs:
        epochs = min(cfg.mlp_local_epochs, cfg.mlp_epochs - done)
        network, found = _one_round(laid_out, network, epochs, cfg, len(losses))
        if network is None:
            break
        losses.append([(len(losses) + 1, done + i + 1, *found[i]) for i in range(epochs)])
        done += epochs
    flat = [row for part in losses for row in part]
    return Training(network, spark.createDataFrame(flat, "round INT, epoch INT, train_loss DOUBLE, val_loss DOUBLE"))


def _one_round(rows: DataFrame, network: Network, epochs: int, cfg: PanelConfig, number: int):
    size, seed = cfg.mlp_batch_size, cfg.seed

    def per_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if not parts:
            return
        mine = pd.concat(parts)
        train, held = mine[mine["split"] == "train"], mine[mine["split"] == "test"]
        x, y = train[list(Z_COLS)].to_numpy(float), train["z_y"].to_numpy(float)
        held_x, held_y = held[list(Z_COLS)].to_numpy(float), held["z_y"].to_numpy(float)
        rng = np.random.default_rng((seed, number, TaskContext.get().partitionId()))
        flat = network.flat()
        local = network.from_flat(flat)
        batch_loss, held_loss = np.zeros(epochs), np.zeros(epochs)
        starts = range(0, len(y), size)
        for epoch in range(epochs):
            order = rng.permutation(len(y))
            for at in starts:
                chosen = order[at : at + size]
                slope, loss = gradient(local, x[chosen], y[chosen])
                flat -= local.learning_rate * slope
                batch_loss[epoch] += loss / len(starts)
            held_loss[epoch] = ((forward(local, held_x)[-1][:, 0] - held_y) ** 2).sum()
        # Not-a-number is below no limit, so it counts too.
        if not (np.abs(np.concatenate([flat, batch_loss, held_loss])) < _DIVERGED).all():
            yield _sums("diverged", np.ones(1), 1.0)
            return
        if len(y):
            yield _sums("network", flat, float(len(y)))
            yield _sums("train", batch_loss, float(len(starts)))
        if len(held):
            yield _sums("held", held_loss / len(held), float(len(held)))

    sums = rows.drop("series_id", "ds").mapInPandas(per_task, _SUMS_SCHEMA)
    total = F.sum((F.col("value") * F.col("weight")).cast(_EXACT)).cast("double")
    means = sums.groupBy("kind", "pos").agg((total / F.sum("weight")).alias("mean")).collect()
    values = {kind: {} for kind in ("network", "train", "held", "diverged")}
    for row in means:
        values[row["kind"]][row["pos"]] = row["mean"]
    if values["diverged"]:
        return None, []
    averaged = network.from_flat(np.array([values["network"][i] for i in range(network.flat().size)]))
    return averaged, [(values["train"][i], values["held"].get(i)) for i in range(epochs)]


def _sums(kind: str, values: np.ndarray, weight: float) -> pd.DataFrame:
    return pd.DataFrame(
        {"kind": kind, "pos": np.arange(len(values), dtype="int32"), "value": values, "weight": weight}
    )
