"""Training networks over Spark partitions: rounds of local steps, averaged, with early stop on validation rank IC.

The training rows are dealt out evenly once and written. In a round every task starts from the same parameters and
optimiser state, goes over its rows in mini-batches, and gives back where it ended; the results are averaged by rows.
The driver sees one averaged result a round, whose size is that of the network.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from panelyard.operators import networks, quantiles
from panelyard.plans.rank_ic import monthly_rank_ic
from panelyard.sources.writers import cut_lineage

_HANDED = 32  # results that one task averages
_BUFFER = 8192  # rows that a task shuffles at a time


@dataclass
class Scaler:
    """By feature: what fills a missing value, and mean and deviation after that; fitted on training rows."""

    features: list[str]
    median: list[float]
    mean: list[float]
    deviation: list[float]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Scaled values; NaN is a missing one."""
        return (np.where(np.isnan(x), self.median, x) - self.mean) / self.deviation


def fit_scaler(train: DataFrame, features: list[str], value: dict[str, Column] | None = None) -> Scaler:
    """Exact medians, then mean and population deviation of the filled values; a deviation of almost 0 counts as 1.

    A feature without any value raises: the model would learn from what fills it.
    """
    rows = train.select(*[(value[f] if value else F.col(f)).cast("double").alias(f"c{i}") for i, f in enumerate(features)])
    columns = rows.columns
    found = quantiles.select(rows, [], columns, [0.5])
    if lost := [f for f, n in zip(features, found.n[0], strict=True) if not n]:
        raise ValueError(f"no value in training: {lost}")
    median = found.quantiles([0.5])[0, :, 0].tolist()
    filled = [F.coalesce(F.nanvl(c, F.lit(None)), F.lit(m)) for c, m in zip(columns, median, strict=True)]
    row = rows.agg(*[x for c in filled for x in (F.avg(c), F.stddev_pop(c))]).first()
    return Scaler(list(features), median, list(row[::2]), [s if s is not None and s >= 1e-6 else 1.0 for s in row[1::2]])


@dataclass
class Inputs:
    """What a network reads: scaled feature columns and, for one with a history, the arrays of timeseries.history()."""

    tabular: Scaler
    sequence: Scaler | None = None
    steps: int = 0

    def columns(self) -> list[Column]:
        out = [F.col(f).cast("double").alias(f"__x{i}") for i, f in enumerate(self.tabular.features)]
        if self.sequence:
            flat = F.flatten(F.transform("steps", lambda s: F.array(*[s[f].cast("double") for f in self.sequence.features])))
            out += [flat.alias("__steps"), F.col("masked").alias("__masked")]
        return out

    def sources(self) -> list[str]:
        """The columns that columns() reads."""
        return [*self.tabular.features, *(["steps", "masked"] if self.sequence else [])]

    def read(self, columns: list[pa.Array]) -> dict[str, np.ndarray]:
        """A batch from the columns above: float32, scaled; steps that are masked are 0."""
        n = len(self.tabular.features)
        x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in columns[:n]])
        batch = {"tabular": self.tabular(x).astype(np.float32)}
        if self.sequence:
            s = columns[n].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(x), self.steps, len(self.sequence.features))
            masked = np.asarray(columns[n + 1].flatten().to_numpy(zero_copy_only=False), bool).reshape(len(x), self.steps)
            batch["sequence"] = np.where(masked[:, :, None], 0.0, self.sequence(s)).astype(np.float32)
            batch["masked"] = masked
        return batch


def sequence_scaler(train: DataFrame, features: list[str]) -> Scaler:
    """fit_scaler() over the steps of all histories that are not masked."""
    steps = train.select(F.explode(F.arrays_zip("steps", "masked")).alias("z")).filter("not z.masked")
    return fit_scaler(cut_lineage(steps.select(*[F.col(f"z.steps.{f}").alias(f) for f in features])), features)  # fitting goes over them seven times


def scaled_steps(histories: DataFrame, scaler: Scaler) -> DataFrame:
    """histories with the scaler applied to their steps, in DataFrame functions: missing values filled, masked steps 0."""
    by_name = list(zip(scaler.features, scaler.median, scaler.mean, scaler.deviation, strict=True))
    scaled = lambda s, hidden: F.struct(*[F.when(hidden, 0.0).otherwise((F.coalesce(F.nanvl(s[f], F.lit(None)), F.lit(m)) - mean) / sd).alias(f) for f, m, mean, sd in by_name])
    return histories.withColumn("steps", F.zip_with("steps", "masked", scaled))


@dataclass
class Settings:
    """rates: a rate for parameters by prefix. frozen: prefixes of parameters that stay."""

    rate: float = 1e-3
    decay: float = 1e-4
    batch: int = 512
    most_rounds: int = 50
    patience: int = 8
    seed: int = 42
    tasks: int | None = None
    rates: dict[str, float] = field(default_factory=dict)
    frozen: tuple[str, ...] = ()

    def rate_of(self, name: str) -> float:
        if self.frozen and name.startswith(self.frozen):
            return 0.0
        return next((r for prefix, r in self.rates.items() if name.startswith(prefix)), self.rate)


class AdamW:
    """Adam with weight decay apart from the gradient; its state is averaged like the parameters."""

    def __init__(self, settings: Settings, state: dict[str, np.ndarray], steps: int):
        self.settings, self.state, self.steps = settings, state, steps

    def step(self, params: networks.Params, gradients: networks.Params) -> None:
        self.steps += 1
        a, b = 1 - 0.9**self.steps, 1 - 0.999**self.steps
        for k, g in gradients.items():
            if not (rate := self.settings.rate_of(k)):
                continue
            m, v = self.state[f"m.{k}"], self.state[f"v.{k}"]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            params[k] *= 1 - rate * self.settings.decay
            params[k] -= rate * (m / a) / (np.sqrt(v / b) + 1e-8)


@dataclass
class Trained:
    """A network with the parameters of its best round, what it reads, and the history of the rounds."""

    network: networks.Network
    params: networks.Params
    inputs: Inputs
    history: list[dict]
    class_means: list[float] | None = None


def _pack(arrays: dict[str, np.ndarray]) -> bytes:
    return np.concatenate([arrays[k].ravel() for k in sorted(arrays)]).astype(np.float64).tobytes()


def _unpack(data: bytes, shapes: dict[str, tuple[int, ...]]) -> dict[str, np.ndarray]:
    flat, out, at = np.frombuffer(data, np.float64), {}, 0
    for k in sorted(shapes):
        n = int(np.prod(shapes[k]))
        out[k] = flat[at : at + n].reshape(shapes[k]).astype(np.float32)
        at += n
    return out


def _round(table: DataFrame, network: networks.Network, inputs: Inputs, state: dict[str, np.ndarray], steps: int, number: int, settings: Settings, tasks: int) -> tuple[dict[str, np.ndarray], int, float]:
    """One round over the table (y, weight, inputs): averaged parameters and state, most steps of a task, mean loss."""
    shapes = {k: v.shape for k, v in state.items()}
    shared = table.sparkSession.sparkContext.broadcast(state)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {k: v.copy() for k, v in shared.value.items()}
        params = {k[2:]: v for k, v in own.items() if k.startswith("p.")}
        optimiser = AdamW(settings, own, steps)
        rng = np.random.default_rng([settings.seed, number, TaskContext.get().partitionId()])
        rows, lost = 0, 0.0
        for part in _buffers(batches):
            y, w = part.column(0).to_numpy(), part.column(1).to_numpy()
            batch = inputs.read(part.columns[2:])
            order = rng.permutation(len(y))
            for at in range(0, len(y), settings.batch):
                i = order[at : at + settings.batch]
                loss, gradients = networks.loss_and_gradients(network, params, {k: v[i] for k, v in batch.items()}, y[i].astype(np.float32), w[i].astype(np.float32), rng, settings.frozen)
                optimiser.step(params, gradients)
                rows, lost = rows + len(i), lost + loss * len(i)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([rows]), pa.array([lost]), pa.array([optimiser.steps]), pa.array([_pack(own)], pa.binary())], names=["n", "loss", "steps", "state"])

    def averaged(group: pa.Table) -> pa.Table:
        n = group.column("n").to_numpy()
        total = sum(np.frombuffer(s.as_buffer(), np.float64) * k for s, k in zip(group.column("state"), n.tolist(), strict=True)) / n.sum()
        return pa.table({"n": [int(n.sum())], "loss": [float(group.column("loss").to_numpy().sum())], "steps": [int(group.column("steps").to_numpy().max())], "state": pa.array([total.tobytes()], pa.binary())})

    kinds = "n long, loss double, steps long, state binary"
    parts = table.mapInArrow(run, kinds).withColumn("share", F.spark_partition_id())
    while tasks > 1:
        tasks = -(-tasks // _HANDED)
        parts = parts.withColumn("of", F.col("share") % tasks).groupBy("of").applyInArrow(lambda key, group: averaged(group).append_column("share", pa.array([key[0].as_py()], pa.int32())), f"{kinds}, share int")
    row = parts.first()
    if row is None:
        raise ValueError("no training rows")
    return _unpack(row["state"], shapes), row["steps"], row["loss"] / row["n"]


def _buffers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of up to _BUFFER rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, _BUFFER):
            yield batch.slice(at, _BUFFER)


def train(
    network: networks.Network, rows: DataFrame, validation: DataFrame, inputs: Inputs, label: str, target: str, settings: Settings, month: str = "month_id",
    class_weights: bool = False, start: networks.Params | None = None, folder: str | None = None,
) -> Trained:
    """The network of the round with the highest mean monthly rank IC on validation.

    rows: training rows; those without a label are left out. label: a class from 0, or for one output the number
    itself. class_weights: rows weigh in by the inverse share of their class. start: parameters to begin with, as from
    warm_start(). folder: the state after each round goes there, and a run that finds one goes on from it.
    Stops when ``patience`` rounds have not raised the rank IC. History: round, train_loss, validation_ic, and for
    classes validation_ic_return (of the expected return), selected.
    """
    spark = rows.sparkSession
    rows = rows.filter(F.col(label).isNotNull())
    means, weight = None, F.lit(1.0)
    if network.outputs > 1:
        found = {int(r["k"]): (r["n"], r["m"]) for r in rows.groupBy(F.col(label).cast("int").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.avg(target).alias("m")).collect()}
        if set(found) != set(range(network.outputs)):
            raise ValueError(f"classes in training: {sorted(found)}")
        means = [found[k][1] for k in range(network.outputs)]
        if class_weights:
            total = sum(n for n, _ in found.values())
            weight = F.element_at(F.array(*[F.lit(total / (network.outputs * found[k][0])) for k in range(network.outputs)]), F.col(label).cast("int") + 1)
    tasks = settings.tasks or spark.sparkContext.defaultParallelism
    table = rows.select(F.col(label).cast("double").alias("__y"), weight.alias("__w"), *inputs.columns())
    table = cut_lineage(table.repartition(tasks, F.xxhash64(*table.columns)))
    judged = [c for c in (month, target) if c not in inputs.sources()]
    validation = cut_lineage(validation.filter(F.col(target).isNotNull()).select(*judged, *inputs.sources()))  # every round scores it
    params = {k: v.astype(np.float32) for k, v in (network.draw(np.random.default_rng(settings.seed)) | (start or {})).items()}
    state = {f"p.{k}": v for k, v in params.items()} | {f"{s}.{k}": np.zeros_like(v) for k, v in params.items() for s in "mv"}
    best, steps, history = params, 0, []
    if folder and (saved := _restored(spark, folder, state)):
        state, best, steps, history = saved
    while len(history) < settings.most_rounds:
        chosen = max((h["validation_ic"] for h in history), default=None)
        if history and len(history) - next(h["round"] for h in history if h["validation_ic"] == chosen) >= settings.patience:
            break
        state, steps, loss = _round(table, network, inputs, state, steps, len(history) + 1, settings, tasks)
        params = {k[2:]: v for k, v in state.items() if k.startswith("p.")}
        scored = score(validation, Trained(network, params, inputs, [], means), [month, target])
        ics = {c: _mean_ic(scored, c, target, month) for c in (["score", "expected_return"] if means else ["score"])}
        row = {"round": len(history) + 1, "train_loss": loss, "validation_ic": ics["score"]} | ({"validation_ic_return": ics["expected_return"]} if means else {})
        if not history or row["validation_ic"] > chosen:
            best = params
        history.append(row)
        if folder:
            _keep(spark, folder, state, best, steps, history)
    top = max((h["validation_ic"] for h in history), default=None)
    first = next((h["round"] for h in history if h["validation_ic"] == top), None)
    return Trained(network, best, inputs, [{**h, "selected": h["round"] == first} for h in history], means)


def _mean_ic(scored: DataFrame, column: str, target: str, month: str) -> float:
    """Mean monthly rank IC; -1 where no month has one."""
    found = monthly_rank_ic(scored, column, target, keys=[month]).agg(F.avg("rank_ic")).first()[0]
    return -1.0 if found is None else found


def _keep(spark: SparkSession, folder: str, state: dict[str, np.ndarray], best: networks.Params, steps: int, history: list[dict]) -> None:
    """A new folder for each round, so that a run that is cut off leaves the one before."""
    row = (len(history), steps, json.dumps(history), _pack(state), _pack(best))
    spark.createDataFrame([row], "round int, steps long, history string, state binary, best binary").coalesce(1).write.mode("overwrite").parquet(f"{folder}/round={len(history)}")


def _restored(spark: SparkSession, folder: str, state: dict[str, np.ndarray]) -> tuple | None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    row = spark.read.parquet(folder).orderBy(F.desc("round")).first()
    if row is None:
        return None
    shapes = {k: v.shape for k, v in state.items()}
    params = {k[2:]: v for k, v in shapes.items() if k.startswith("p.")}
    return _unpack(row["state"], shapes), _unpack(row["best"], params), row["steps"], json.loads(row["history"])


def score(df: DataFrame, model: Trained, keep: list[str]) -> DataFrame:
    """keep, probability (array; null for a number), score (p of the last class less p of the first, or the number), expected_return (null without class means)."""
    columns = model.inputs.columns()
    shared, k = df.sparkSession.sparkContext.broadcast((model.network, model.params, model.class_means)), len(keep)
    inputs = model.inputs
    kinds = df.select(*keep).schema.add("probability", ArrayType(DoubleType())).add("score", "double").add("expected_return", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network, params, means = shared.value
        for part in _buffers(batches):
            out = networks.predict(network, params, inputs.read(part.columns[k:])).astype(np.float64)
            several = network.outputs > 1
            p = pa.array(list(out), pa.list_(pa.float64())) if several else pa.nulls(len(out), pa.list_(pa.float64()))
            value = out[:, -1] - out[:, 0] if several else out[:, 0]
            expected = pa.array(out @ np.array(means)) if several and means else pa.nulls(len(out), pa.float64())
            yield pa.RecordBatch.from_arrays([*part.columns[:k], p, pa.array(value), expected], names=[*part.schema.names[:k], "probability", "score", "expected_return"])

    return df.select(*keep, *columns).mapInArrow(run, kinds)


def save(model: Trained, spark: SparkSession, path: str) -> None:
    """Network, parameters, scalers with their feature lists, and history, as one row."""
    about = {
        "network": type(model.network).__name__, "settings": asdict(model.network), "shapes": {k: v.shape for k, v in model.params.items()}, "tabular": asdict(model.inputs.tabular),
        "sequence": asdict(model.inputs.sequence) if model.inputs.sequence else None, "steps": model.inputs.steps, "history": model.history, "class_means": model.class_means,
    }
    spark.createDataFrame([(json.dumps(about), _pack(model.params))], "about string, params binary").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str, features: list[str]) -> Trained:
    """The saved model; raises if it was fitted on other features or in another order."""
    row = spark.read.parquet(path).first()
    about = json.loads(row["about"])
    tabular = Scaler(**about["tabular"])
    if tabular.features != list(features):
        raise ValueError(f"fitted on {tabular.features}, not on {features}")
    settings = {k: tuple(v) if isinstance(v, list) else v for k, v in about["settings"].items()}
    params = _unpack(row["params"], {k: tuple(v) for k, v in about["shapes"].items()})
    inputs = Inputs(tabular, Scaler(**about["sequence"]) if about["sequence"] else None, about["steps"])
    return Trained(networks.NETWORKS[about["network"]](**settings), params, inputs, about["history"], about["class_means"])
