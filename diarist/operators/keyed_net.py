"""Elastic nets of many keys, folds and parameter sets that are fitted at the same time.

Rows are written once as blocks of one key, bucketed, and never moved or copied again. A step is one pass over the
blocks: every block adds up the gradients of all its key's models (each fold left out, and none, by each parameter
set), Spark adds the blocks of a key, and the coefficients of the key, one row of a table, take a proximal step.
The step minimises a bound of the loss by the curvature a quarter of the key's cross products, which are the same for
all its models, and is sped up by Nesterov's extrapolation with restarts. Keys whose models have all converged leave the table,
so later steps read fewer. A key may hold any number of rows: no task holds more than a block at once.

The objective of one model is the mean logistic loss, with each class half of the weight, plus
``penalty * (mixture * |b| + (1 - mixture) / 2 * b ** 2)`` on the coefficients of predictors scaled over its training rows.
"""

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diarist.scratch import exists, remove, scratch_path

ONE_CLASS = "training rows hold one class"
CONSTANT = "no predictor varies"
NOT_CONVERGED = "not converged"


@dataclass(frozen=True)
class Shape:
    """Number of predictors and folds, and the parameter sets, of every key's models."""

    features: int
    folds: int
    penalty: tuple
    mixture: tuple

    @property
    def sets(self) -> int:
        return len(self.penalty)

    @property
    def holds(self) -> int:
        """Models of one parameter set: each fold left out, and the last with none left out."""
        return self.folds + 1

    def coefficients(self, flat) -> np.ndarray:
        """(hold, set, 1 + features), intercept first."""
        return np.asarray(flat, float).reshape(self.holds, self.sets, self.features + 1)


def _blocks(rows: DataFrame, key: str, features: Sequence[str], ordinal: str, block_rows: int, buckets: int):
    """A bucketed table of (key, part, parts, ids, labels, folds, x), its name and its folder. ``fold`` -1 marks rows that only get scores."""
    spark = rows.sparkSession
    big = rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > block_rows)
    parts = F.coalesce(F.ceil(F.col("_n") / block_rows), F.lit(1)).cast("int")
    x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features])
    cell = F.struct(F.col(ordinal).cast("bigint").alias("id"), F.col("label").cast("int").alias("label"),
                    F.coalesce(F.col("fold"), F.lit(-1)).cast("int").alias("fold"), x.alias("x"))
    dealt = rows.join(big, key, "left").withColumn("parts", parts).select(
        key, "parts", F.pmod(F.xxhash64(ordinal), "parts").cast("int").alias("part"), cell.alias("cell"))
    # In the order of identifiers, so that sums repeat exactly.
    cells = F.array_sort(F.collect_list("cell")).alias("c")
    blocks = dealt.groupBy(key, "part").agg(F.first("parts").alias("parts"), cells).select(
        key, "part", "parts", F.col("c.id").alias("ids"), F.col("c.label").alias("labels"), F.col("c.fold").alias("folds"),
        F.flatten("c.x").alias("x"))
    name, path = f"keyed_net_{uuid.uuid4().hex}", scratch_path(spark, "keyed-net")
    writer = blocks.write.bucketBy(buckets, key, "part").sortBy(key, "part")
    writer.option("path", path).saveAsTable(name)
    return spark.table(name), name, path


_CELLS = ["labels", "folds", "x"]


def _matrix(x, label):
    return np.asarray(x, float).reshape(len(label), -1)


def _added(blocks: DataFrame, key: str, per_block) -> DataFrame:
    """(key, values): what ``per_block`` makes of a key's blocks, added place by place; most keys have one block, which passes."""
    single = per_block(blocks.where("parts = 1")).select(key, "values")
    places = per_block(blocks.where("parts > 1")).select(key, F.posexplode("values").alias("at", "v"))
    summed = places.groupBy(key, "at").agg(F.sum("v").alias("v"))
    several = summed.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("s"))
    return single.unionByName(several.select(key, F.col("s.v").alias("values")))


def _moments(shape: Shape, key: str):
    """Per block: rows, sums and sums of squares by fold and class, and cross products by class."""
    k, p = shape.folds, shape.features

    def task(frames):
        for pdf in frames:
            out = []
            for label, fold, x in zip(*(pdf[c] for c in _CELLS)):
                x = _matrix(x, label)
                sums, cross = np.zeros((k, 2, 1 + 2 * p)), np.zeros((2, p, p))
                for c in (0, 1):
                    cross[c] = x[(label == c) & (fold >= 0)].T @ x[(label == c) & (fold >= 0)]
                    for f in range(k):
                        own = x[(label == c) & (fold == f)]
                        sums[f, c] = np.concatenate([[len(own)], own.sum(0), (own**2).sum(0)])
                out.append(np.concatenate([sums.ravel(), cross.ravel()]))
            yield pd.DataFrame({key: pdf[key], "values": out})

    return task


def _started(shape: Shape, key: str):
    """From the moments of a key: its scaling, curvature, class weights and spreads by hold, reasons of failure, coefficients of zero."""
    k, p = shape.folds, shape.features

    def task(frames):
        for pdf in frames:
            out = []
            for values in pdf["values"]:
                values = np.asarray(values, float)
                sums, cross = values[: k * 2 * (1 + 2 * p)].reshape(k, 2, -1), values[k * 2 * (1 + 2 * p):].reshape(2, p, p)
                total = sums.sum(0)
                held = np.concatenate([total - sums, total[None]])  # (hold, class, moments)
                n = held[:, :, 0]
                share = np.where(n.min(1, keepdims=True) > 0, 0.5 / np.maximum(n, 1), 0.0)  # weight of a row by hold and class
                first = (share[:, :, None] * held[:, :, 1: 1 + p]).sum(1)
                spread = (share[:, :, None] * held[:, :, 1 + p:]).sum(1) - first**2
                size = (share[:, :, None] * held[:, :, 1 + p:]).sum(1)
                spread = np.sqrt(np.where(spread > 1e-12 * np.maximum(size, 1e-300), spread, 0.0))
                mean, sd = first[-1], spread[-1]
                safe = np.where(sd > 0, sd, 1.0)
                curve = (share[-1][:, None, None] * cross).sum(0) - np.outer(mean, mean)
                curve = curve / np.outer(safe, safe) * np.outer(sd > 0, sd > 0)
                # Rows of a hold weigh at most this many times what they weigh in the whole.
                grown = np.where(share[-1].max() > 0, (share / np.maximum(share[-1], 1e-300)).max(1), 0.0)
                reasons = [ONE_CLASS if m == 0 else CONSTANT if not s.any() else None for m, s in zip(n.min(1), spread)]
                out.append((mean, safe, curve.ravel(), share.ravel(), (spread / safe).ravel(), grown, reasons))
            names = ["mean", "sd", "curve", "share", "spread", "grown", "reasons"]
            new = pd.DataFrame(dict(zip(names, map(list, zip(*out)))) if out else {c: [] for c in names})
            zeros = [np.zeros(shape.holds * shape.sets * (p + 1))] * len(new)
            new = new.assign(beta=zeros, point=zeros, pace=[np.ones(shape.holds * shape.sets)] * len(new),
                             change=[np.full(shape.holds * shape.sets, np.inf)] * len(new))
            yield new.assign(**{key: pdf[key].to_numpy()})

    return task


def _gradients(shape: Shape, key: str):
    """Per block: gradient of every model of the key at its point."""

    def task(frames):
        for pdf in frames:
            out = []
            for label, fold, x, mean, sd, share, point in zip(*(pdf[c] for c in (*_CELLS, "mean", "sd", "share", "point"))):
                x = _matrix(x, label)
                z = np.column_stack([np.ones(len(x)), (x - np.asarray(mean)) / np.asarray(sd)])
                weight = np.asarray(share).reshape(shape.holds, 2)[:, label].T  # (row, hold)
                weight = weight * ((fold[:, None] != np.arange(shape.holds)) & (fold >= 0)[:, None])
                b = shape.coefficients(point)
                grad = np.zeros_like(b)
                for h in range(shape.holds):
                    odds = np.clip(z @ b[h].T, -700, 700)
                    grad[h] = (weight[:, h, None] * (1 / (1 + np.exp(-odds)) - label[:, None])).T @ z
                out.append(grad.ravel())
            yield pd.DataFrame({key: pdf[key], "values": out})

    return task


def _minimised(grad, at, curve, bound, spread, penalty, mixture, sweeps=200):
    """Coordinate descent of all models of a key on their bounds: gradient ``grad`` at ``at``, curvature ``bound * curve``."""
    b = at.copy()
    b[:, 0] -= np.divide(grad[:, 0], bound, out=np.zeros(len(b)), where=bound > 0)
    slope = grad[:, 1:].copy()  # of the bound at b, without the penalty
    ridge, lasso = (penalty * (1 - mixture))[:, None] * spread**2, (penalty * mixture)[:, None] * spread
    own = bound[:, None] * np.diag(curve)
    for _ in range(sweeps):
        most = 0.0
        for j in range(curve.shape[0]):
            pull = own[:, j] * b[:, j + 1] - slope[:, j]
            kept = np.sign(pull) * np.maximum(np.abs(pull) - lasso[:, j], 0)
            usable = (spread[:, j] > 0) & (own[:, j] > 0)
            new = np.divide(kept, own[:, j] + ridge[:, j], out=np.zeros(len(b)), where=usable)
            delta = new - b[:, j + 1]
            slope += (bound * delta)[:, None] * curve[j]
            b[:, j + 1] = new
            most = max(most, np.abs(delta).max(initial=0))
        if most < 1e-10:
            break
    return b


def _steps(shape: Shape, key: str, tolerance: float):
    """One proximal step of every model of a key that is not there yet."""
    penalty, mixture = np.tile(shape.penalty, shape.holds), np.tile(shape.mixture, shape.holds)
    p = shape.features

    def moved(row):
        old, at, grad = (np.asarray(row[c], float).reshape(-1, p + 1) for c in ("beta", "point", "values"))
        pace, change = np.asarray(row["pace"], float).copy(), np.asarray(row["change"], float).copy()
        bound = np.repeat(np.asarray(row["grown"], float) / 4, shape.sets)
        spread = np.repeat(np.asarray(row["spread"], float).reshape(shape.holds, p), shape.sets, axis=0)
        failed = np.repeat([r is not None for r in row["reasons"]], shape.sets)
        change[failed] = 0.0
        go = change > tolerance
        beta, point = old.copy(), at.copy()
        curve = np.asarray(row["curve"], float).reshape(p, p)
        new = _minimised(grad[go], at[go], curve, bound[go], spread[go], penalty[go], mixture[go])
        step, gone = new - old[go], at[go] - new
        metric = np.column_stack([gone[:, 0], gone[:, 1:] @ curve])
        faster = (1 + np.sqrt(1 + 4 * pace[go] ** 2)) / 2
        back = (metric * step).sum(1) > 0  # the extrapolation overshot: start it afresh
        push = np.where(back, 0.0, (pace[go] - 1) / faster)
        beta[go], point[go] = new, new + push[:, None] * step
        # Both the step taken and the distance from the point of the gradient must be small.
        change[go] = np.maximum(np.abs(step).max(1, initial=0), np.abs(gone).max(1, initial=0))
        pace[go] = np.where(back, 1.0, faster)
        return beta.ravel(), point.ravel(), pace, change

    def task(frames):
        for pdf in frames:
            rows = [moved(r) for r in pdf.to_dict("records")]
            out = pdf.drop(columns=["values", "beta", "point", "pace", "change"])
            for i, c in enumerate(("beta", "point", "pace", "change")):
                out[c] = [r[i] for r in rows]
            yield out

    return task


def _scores(shape: Shape, key: str):
    """Per block: each training row by the models that left its fold out, each other row by those that left out none."""

    def task(frames):
        for pdf in frames:
            names = (key, "ids", *_CELLS, "mean", "sd", "beta", "reasons")
            for k, ids, label, fold, x, mean, sd, beta, reasons in zip(*(pdf[c] for c in names)):
                x = _matrix(x, label)
                z = np.column_stack([np.ones(len(x)), (x - np.asarray(mean)) / np.asarray(sd)])
                hold = np.where(fold < 0, shape.folds, fold)
                odds = np.clip(np.einsum("np,nsp->ns", z, shape.coefficients(beta)[hold]), -700, 700)
                ok = np.array([reasons[h] is None for h in hold], bool)
                n = int(ok.sum())
                if not n:
                    continue
                yield pd.DataFrame({
                    key: [k] * (n * shape.sets), "row_id": np.repeat(np.asarray(ids, np.int64)[ok], shape.sets),
                    "label": np.repeat(label[ok], shape.sets), "fold": np.repeat(fold[ok], shape.sets),
                    "param_id": np.tile(np.arange(shape.sets), n), "score": (1 / (1 + np.exp(-odds[ok]))).ravel(),
                })

    return task


@dataclass
class KeyedNets:
    """Fitted nets of all keys as a stored table, one row a key, and the blocks they were fitted on."""

    state: DataFrame
    blocks: DataFrame
    shape: Shape
    key: str
    features: Sequence[str]
    tolerance: float
    table: str
    paths: tuple

    def _kind(self) -> str:
        return self.state.schema[self.key].dataType.simpleString()

    def scores(self) -> DataFrame:
        """(key, row_id, label, fold, param_id, score); ``fold`` is -1 for rows outside training."""
        wide = self.blocks.join(_by_part(self.state, self.key, ["mean", "sd", "beta", "reasons"]), [self.key, "part"])
        schema = f"`{self.key}` {self._kind()}, row_id bigint, label int, fold int, param_id int, score double"
        return wide.mapInPandas(_scores(self.shape, self.key), schema)

    def models(self) -> DataFrame:
        """(key, hold, param_id, change, reason, converged): one row a model; ``hold`` is the fold left out, or the number of folds for none."""
        hold = F.posexplode("reasons").alias("hold", "reason")
        per = self.state.select(self.key, "change", hold)
        each = per.select(self.key, "hold", "reason", "change", F.explode(F.sequence(F.lit(0), F.lit(self.shape.sets - 1))).alias("param_id"))
        last = F.get("change", F.col("hold") * self.shape.sets + F.col("param_id"))
        done = F.col("reason").isNull() & (last <= self.tolerance)
        return each.select(
            self.key, "hold", "param_id", last.alias("change"),
            F.when(F.col("reason").isNull() & ~done, F.lit(NOT_CONVERGED)).otherwise(F.col("reason")).alias("reason"), done.alias("converged"),
        )

    def coefficients(self) -> DataFrame:
        """(key, param_id, variable, estimate) of the models that left out no fold; predictors scaled over the key's training rows."""
        s, p = self.shape, self.shape.features
        start = s.folds * s.sets * (p + 1)
        whole = self.state.where(F.get("reasons", F.lit(s.folds)).isNull()).select(
            self.key, F.posexplode(F.slice("beta", start + 1, s.sets * (p + 1))).alias("at", "estimate"))
        names = F.array(*[F.lit(n) for n in ("(intercept)", *self.features)])
        return whole.select(self.key, F.floor(F.col("at") / (p + 1)).cast("int").alias("param_id"),
                            F.get(names, F.col("at") % (p + 1)).alias("variable"), "estimate")

    def close(self) -> None:
        """Delete the blocks and the stored state; tables made from them must have been written."""
        spark = self.state.sparkSession
        spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        remove(spark, *self.paths)


def _by_part(state: DataFrame, key: str, columns) -> DataFrame:
    """The state of a key once for each of its blocks, so it can meet them where they are."""
    return state.select(key, *columns, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))


def fit_keyed_nets(
    rows: DataFrame, features: Sequence[str], key: str, ordinal: str, params: Sequence[dict], folds: int = 10,
    max_steps: int = 100, tolerance: float = 1e-4, block_rows: int = 5000, buckets: int | None = None,
) -> KeyedNets:
    """Fit one elastic net for each key, parameter set and fold left out, and one without a fold left out.

    ``rows`` have ``label`` (0 or 1), ``fold`` (0 up to ``folds`` - 1, null for rows that only get scores) and the
    features; missing values count as zero. Rows without a key or label are left out. ``params`` have ``penalty`` and
    ``mixture``; their order gives ``param_id``. A model whose training rows hold one class or no varying predictor
    has a reason and no scores; one that still moves by more than ``tolerance`` after ``max_steps`` is marked
    and used as it is. Memory of a task is bounded by a block and by the state of a key, not by the rows of a key.
    """
    spark = rows.sparkSession
    shape = Shape(len(features), folds, tuple(float(q["penalty"]) for q in params), tuple(float(q["mixture"]) for q in params))
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = rows.select(key, ordinal, "label", "fold", *features).where(F.col(key).isNotNull() & F.col("label").isNotNull())
    blocks, table, path = _blocks(known, key, features, ordinal, block_rows, buckets)
    kind = blocks.schema[key].dataType.simpleString()
    values = f"`{key}` {kind}, values array<double>"
    arrays = ("mean", "sd", "curve", "share", "spread", "grown", "beta", "point", "pace", "change")
    fields = ", ".join(f"{c} array<double>" for c in arrays)
    moments = _added(blocks, key, lambda part: part.select(key, *_CELLS).mapInPandas(_moments(shape, key), values))
    started = moments.mapInPandas(_started(shape, key), f"`{key}` {kind}, reasons array<string>, {fields}")
    sizes = blocks.groupBy(key).agg(F.max("parts").alias("parts"))
    started = started.join(sizes, key).withColumn("_ready", F.lit(False))
    # All steps lie under one folder; a step's unready keys are deleted once the next step is written.
    root, schema = scratch_path(spark, "keyed-net-state"), started.withColumn("step", F.lit(0)).schema
    columns = [c for c in started.columns if c != "_ready"]
    stepped = ", ".join(f"`{c}` {started.schema[c].dataType.simpleString()}" for c in columns)
    started.write.partitionBy("_ready").parquet(f"{root}/step=0")
    ready = F.forall("change", lambda c: c <= tolerance)
    for nr in range(max_steps):
        left = f"{root}/step={nr}/_ready=false"
        if not exists(spark, left):
            break
        state = spark.read.schema(schema).option("basePath", root).parquet(left).select(columns)
        points = _by_part(state, key, ["mean", "sd", "share", "point"])

        def gradients(part):
            wide = part.join(points, [key, "part"]).select(key, *_CELLS, "mean", "sd", "share", "point")
            return wide.mapInPandas(_gradients(shape, key), values)

        step = state.join(_added(blocks, key, gradients), key).mapInPandas(_steps(shape, key, tolerance), stepped)
        step.withColumn("_ready", ready).write.partitionBy("_ready").parquet(f"{root}/step={nr + 1}")
        remove(spark, left)
    fitted = spark.read.schema(schema).parquet(root).select(columns)
    return KeyedNets(fitted, blocks, shape, key, tuple(features), tolerance, table, (path, root))
