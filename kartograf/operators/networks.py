"""Small multilayer perceptrons trained where the data lies.

The rows stay partitioned.  In each epoch every partition runs mini-batch AdamW from the same
starting weights over its own rows, streamed in Arrow batches, and the results are averaged by row
count in a two-level sum.  With one partition this is ordinary mini-batch training.  Only weights
(a few megabytes, fixed by the layer sizes) travel to and from the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kartograf.functions.scalars import cosine_lr, cosine_with_warmup, linear_lr
from kartograf.operators.losses import pair_gaps
from kartograf.session import cut

SCHEDULES = {"LinearLR": linear_lr, "CosineAnnealingLR": cosine_lr, "CosineWithWarmupLR": cosine_with_warmup}


@dataclass(frozen=True)
class MLP:
    """Linear layers with ReLU; layer norm and dropout on the second layer only."""

    inputs: int
    layer: tuple = (1024, 512, 256)
    outputs: int = 2
    norm: bool = True
    dropout: float = 0.0

    @property
    def shapes(self):
        sizes = [self.inputs, *self.layer, self.outputs]
        out = []
        for i in range(len(sizes) - 1):
            out += [(sizes[i], sizes[i + 1]), (sizes[i + 1],)]
            if self.norm and i == 1:
                out += [(sizes[i + 1],), (sizes[i + 1],)]
        return out

    def start(self, rng) -> list[np.ndarray]:
        sizes, params = [self.inputs, *self.layer, self.outputs], []
        for i in range(len(sizes) - 1):
            bound = sizes[i] ** -0.5
            params += [rng.uniform(-bound, bound, (sizes[i], sizes[i + 1])), rng.uniform(-bound, bound, sizes[i + 1])]
            if self.norm and i == 1:
                params += [np.ones(sizes[i + 1]), np.zeros(sizes[i + 1])]
        return params

    def forward(self, params, x, rng=None):
        """Outputs and what the backward pass needs; ``rng`` switches dropout on."""
        tape, at, layers = [], 0, len(self.layer) + 1
        for i in range(layers):
            w, b = params[at], params[at + 1]
            z, step = x @ w + b, {"x": x, "at": at}
            at += 2
            if self.norm and i == 1:
                gain, offset = params[at], params[at + 1]
                center = z - z.mean(axis=1, keepdims=True)
                width = np.sqrt((center ** 2).mean(axis=1, keepdims=True) + 1e-5)
                step.update(unit=center / width, width=width)
                z = step["unit"] * gain + offset
                at += 2
            if i < layers - 1:
                step["on"] = z > 0
                z = np.maximum(z, 0)
                if i == 1 and self.dropout and rng is not None:
                    step["kept"] = (rng.random(z.shape) >= self.dropout) / (1 - self.dropout)
                    z = z * step["kept"]
            tape.append(step)
            x = z
        return x, tape

    def backward(self, params, tape, grad):
        """Gradients of all parameters and of the input."""
        grads = [None] * len(params)
        for step in reversed(tape):
            if "kept" in step:
                grad = grad * step["kept"]
            if "on" in step:
                grad = grad * step["on"]
            at = step["at"]
            if "unit" in step:
                unit, gain = step["unit"], params[at + 2]
                grads[at + 2], grads[at + 3] = (grad * unit).sum(axis=0), grad.sum(axis=0)
                g = grad * gain
                grad = (g - g.mean(axis=1, keepdims=True) - unit * (g * unit).mean(axis=1, keepdims=True)) / step["width"]
            grads[at], grads[at + 1] = step["x"].T @ grad, grad.sum(axis=0)
            grad = grad @ params[at].T
        return grads, grad


def _criterion(kind: str, a: np.ndarray, b: np.ndarray):
    """Mean loss and its gradient with respect to ``a``."""
    r = a - b
    if kind == "MSE":
        return (r ** 2).mean(), 2 * r / r.size
    if kind == "HuberLoss":
        return np.where(np.abs(r) <= 1, 0.5 * r * r, np.abs(r) - 0.5).mean(), np.clip(r, -1, 1) / r.size
    raise ValueError(f"unknown criterion {kind!r}")


def _add(*grads):
    return [sum(parts) for parts in zip(*grads)]


def _length(delta: np.ndarray, eps: float = 0.0):
    """Row norms and their gradient with respect to ``delta``."""
    d = np.sqrt((delta ** 2).sum(axis=-1) + eps)
    return d, delta / np.maximum(d, 1e-12)[..., None]


@dataclass(frozen=True)
class Model:
    """An encoder with an objective.  Rows carry the columns that the objective reads:

    * ``fingerprint``: x, target
    * ``siamese``: x, x2, target; ``triplet``: x, x_positive, x_negative
    * ``autoencoder``: x (and ts for the time regulariser, mask for the reconstruction)
    * ``paths``: node features of a path and the mean and variance of its length
    """

    kind: str
    encoder: MLP
    decoder: MLP | None = None
    criterion: str = "MSE"
    options: dict = field(default_factory=dict)

    def start(self, seed: int) -> list[np.ndarray]:
        rng = np.random.default_rng(seed)
        params = self.encoder.start(rng)
        if self.decoder:
            params += self.decoder.start(rng)
        if self.options.get("variant") == "vqvae":
            size = self.options.get("codewords", 512)
            params.append(rng.uniform(-1 / size, 1 / size, (size, self.encoder.outputs)))
        return params

    def embed(self, params, x):
        out, _ = self.encoder.forward(params[:len(self.encoder.shapes)], x)
        if self.options.get("uncertainty") or self.options.get("variant") == "vae":
            return out[:, :out.shape[1] // 2]
        if self.options.get("variant") == "vqvae" and self.options.get("quantized", True):
            return params[-1][_nearest(out, params[-1])]
        return out

    def loss(self, params, batch: dict, rng):
        """Mean loss of a batch and the gradients of all parameters."""
        return getattr(self, f"_{self.kind}")(params, batch, rng)

    def _fingerprint(self, params, batch, rng):
        out, tape = self.encoder.forward(params, batch["x"], rng)
        target = batch["target"]
        if not self.options.get("uncertainty"):
            value, grad = _criterion(self.criterion, out, target)
            return value, self.encoder.backward(params, tape, grad)[0]
        half = out.shape[1] // 2
        mean, log_var = out[:, :half], out[:, half:]
        mse, d_mean = _criterion("MSE", mean, target)
        inverse = np.exp(-log_var)
        grad = np.hstack([d_mean * inverse.mean(), (1 - mse * inverse) / log_var.size])
        return (log_var + mse * inverse).mean(), self.encoder.backward(params, tape, grad)[0]

    def _siamese(self, params, batch, rng):
        a, tape_a = self.encoder.forward(params, batch["x"], rng)
        b, tape_b = self.encoder.forward(params, batch["x2"], rng)
        d, slope = _length(a - b)
        value, grad = _criterion(self.criterion, d, batch["target"])
        pull = grad[:, None] * slope
        grads = _add(self.encoder.backward(params, tape_a, pull)[0], self.encoder.backward(params, tape_b, -pull)[0])
        return self._consistent(params, batch, ("x", "x2"), (a, b), value, grads)

    def _triplet(self, params, batch, rng):
        names = ("x", "x_positive", "x_negative")
        (a, ta), (p, tp), (n, tn) = (self.encoder.forward(params, batch[k], rng) for k in names)
        (dp, sp), (dn, sn) = _length(a - p + 1e-6), _length(a - n + 1e-6)
        gap = dp - dn + self.options.get("margin", 1.0)
        on = (gap > 0)[:, None] / len(gap)
        grads = _add(self.encoder.backward(params, ta, (sp - sn) * on)[0],
                     self.encoder.backward(params, tp, -sp * on)[0], self.encoder.backward(params, tn, sn * on)[0])
        return self._consistent(params, batch, names, (a, p, n), np.maximum(gap, 0).mean(), grads)

    def _consistent(self, params, batch, names, outputs, value, grads):
        """Optional term: inputs under a thinned mask should land where the full inputs land."""
        if f"reg_{names[0]}" not in batch:
            return value, grads
        seen = [self.encoder.forward(params, batch[f"reg_{k}"]) for k in names]
        fixed = np.concatenate(outputs)
        extra, grad = _criterion(self.options.get("reg_criterion", "MSE"), np.concatenate([o for o, _ in seen]), fixed)
        parts = np.split(grad, len(names))
        return value + extra, _add(grads, *[self.encoder.backward(params, t, g)[0] for (_, t), g in zip(seen, parts)])

    def _autoencoder(self, params, batch, rng):
        cut_at = len(self.encoder.shapes)
        enc, dec = params[:cut_at], params[cut_at:cut_at + len(self.decoder.shapes)]
        variant = self.options.get("variant", "ae")
        out, tape = self.encoder.forward(enc, batch["x"], rng)
        value, grad_out, code_grad = 0.0, np.zeros_like(out), None
        if variant == "vae":
            half = out.shape[1] // 2
            mean, log_var = out[:, :half], out[:, half:]
            noise = rng.standard_normal(mean.shape)
            z, chart = mean + np.exp(0.5 * log_var) * noise, mean
            beta = self.options.get("beta", 1.0)
            value += beta * -0.5 * (1 + log_var - mean ** 2 - np.exp(log_var)).sum(axis=1).mean()
            grad_out += beta / len(out) * np.hstack([mean, -0.5 * (1 - np.exp(log_var))])
        elif variant == "vqvae":
            words = params[-1]
            code = _nearest(out, words)
            z = chart = words[code]
            cost = self.options.get("commitment_cost", 0.25)
            miss = z - out
            value += (1 + cost) * (miss ** 2).mean()
            grad_out += -2 * cost * miss / miss.size
            code_grad = np.zeros_like(words)
            np.add.at(code_grad, code, 2 * miss / miss.size)
        else:
            z = chart = out
        recon, tape_dec = self.decoder.forward(dec, z, rng)
        target, weight = batch["x"], batch.get("mask")
        if weight is not None:  # only the taps of valid antennas count
            keep = weight.astype(bool)
            part, g = _criterion(self.criterion, recon[keep], target[keep])
            grad = np.zeros_like(recon)
            grad[keep] = g
        else:
            part, grad = _criterion(self.criterion, recon, target)
        value += part
        grads_dec, grad_z = self.decoder.backward(dec, tape_dec, grad)
        kind = self.options.get("regularization")
        if kind:
            d, dt, i, j = pair_gaps(chart, batch["ts"], self.options.get("max_time_diff", 1.0))
            if len(d):
                slope = (chart[i] - chart[j]) / np.maximum(d, 1e-12)[:, None]
                r = d - dt
                weight = self.options.get("regularization_weight", 1.0)
                if kind == "FRD":
                    term, push = np.where(np.abs(r) <= 1, 0.5 * r * r, np.abs(r) - 0.5).mean(), np.clip(r, -1, 1) / len(r)
                else:
                    term, push = (np.maximum(r, 0) ** 2).mean(), 2 * np.maximum(r, 0) / len(r)
                value += weight * term
                chart_grad = np.zeros_like(chart)
                np.add.at(chart_grad, i, weight * push[:, None] * slope)
                np.add.at(chart_grad, j, -weight * push[:, None] * slope)
                if variant == "vae":
                    grad_out[:, :chart.shape[1]] += chart_grad
                else:
                    grad_z = grad_z + chart_grad
        if variant == "vae":
            grad_out += np.hstack([grad_z, grad_z * noise * 0.5 * np.exp(0.5 * log_var)])
        else:  # straight through the quantiser
            grad_out += grad_z
        grads = self.encoder.backward(enc, tape, grad_out)[0] + grads_dec
        return value, grads + ([code_grad] if code_grad is not None else [])

    def _paths(self, params, batch, rng):
        """Length of each chart path against its expected length, steps longer than the whole way,
        and the acceleration along recorded triples of rows."""
        nodes, count = batch["nodes"], batch["count"]  # all nodes of all paths in sequence
        out, tape = self.encoder.forward(params, nodes, rng)
        grad = np.zeros_like(out)
        owner = np.repeat(np.arange(len(count)), count)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        step, slope = _length(out[inner + 1] - out[inner], 1e-6)
        path = owner[inner]
        length = np.bincount(path, step, len(count))
        variance = batch["variance"] + 1e-6
        miss = length - batch["mean"]
        first, last = np.cumsum(count) - count, np.cumsum(count) - 1
        ends, end_slope = _length(out[last] - out[first], 1e-6)
        over = step - ends[path]
        weight = self.options.get("triangle_penalty_weight", 0.001)
        value = (miss ** 2 / variance).mean() + weight * np.maximum(over, 0).sum()
        pull = (2 * miss / variance / len(count))[path] + weight * (over > 0)
        np.add.at(grad, inner + 1, pull[:, None] * slope)
        np.add.at(grad, inner, -pull[:, None] * slope)
        back = weight * np.bincount(path, over > 0, len(count))[:, None] * end_slope
        np.add.at(grad, last, -back)
        np.add.at(grad, first, back)
        grads = self.encoder.backward(params, tape, grad)[0]
        if "motion" in batch and len(batch["motion"]):
            rows, dt = batch["motion"], batch["dt"]  # (m, 3, inputs) and (m, 2)
            flat, tape = self.encoder.forward(params, rows.reshape(-1, rows.shape[2]), rng)
            p = flat.reshape(len(rows), 3, -1)
            d1, d2 = dt[:, :1], dt[:, 1:]
            a = ((p[:, 2] - p[:, 1]) / d2 - (p[:, 1] - p[:, 0]) / d1) / d1
            scale = self.options.get("acceleration_weight", 0.01) / self.options.get("acceleration_variance", 1.7) / len(a)
            value += scale * (a ** 2).sum()
            g = 2 * scale * a / d1
            moved = np.stack([g / d1, -g / d2 - g / d1, g / d2], axis=1).reshape(flat.shape)
            grads = _add(grads, self.encoder.backward(params, tape, moved)[0])
        return value, grads


def _nearest(z, words):
    return ((z ** 2).sum(axis=1)[:, None] + (words ** 2).sum(axis=1) - 2 * z @ words.T).argmin(axis=1)


def _batch(rows: pd.DataFrame) -> dict:
    """Columns of a slice of rows as arrays."""
    out = {}
    for c in rows.columns:
        values = rows[c]
        if c == "nodes":  # array of feature arrays per path
            out["count"] = values.map(len).to_numpy()
            out["nodes"] = np.stack([node for path in values for node in path]).astype(np.float64)
        elif c in ("target", "mask", "motion", "dt") or c.startswith(("x", "reg_")):
            first = values.iloc[0]
            out[c] = np.stack([np.stack(v) if c == "motion" else np.asarray(v) for v in values]).astype(np.float64) \
                if np.ndim(first) else values.to_numpy(np.float64)
        elif c != "id":
            out[c] = values.to_numpy(np.float64)
    return out


@dataclass
class Trained:
    model: Model
    params: list
    history: list

    def predict(self, df: DataFrame, x: str = "x", id: str = "id") -> DataFrame:
        """Chart positions: (``id``, ``x``, ``y``)."""
        model, params = self.model, df.sparkSession.sparkContext.broadcast(self.params)

        def run(batches):
            for rows in batches:
                if len(rows):
                    z = model.embed(params.value, np.stack(rows["f"]).astype(np.float64))
                    yield pd.DataFrame({"id": rows["id"], "x": z[:, 0], "y": z[:, 1]})

        return df.select(F.col(id).cast("bigint").alias("id"), F.col(x).alias("f")) \
            .mapInPandas(run, "id bigint, x double, y double")

    def predict_variance(self, df: DataFrame, x: str = "x", id: str = "id") -> DataFrame:
        """Positions with their variances, for a model trained with an uncertainty head."""
        model, params = self.model, df.sparkSession.sparkContext.broadcast(self.params)

        def run(batches):
            for rows in batches:
                if len(rows):
                    out, _ = model.encoder.forward(params.value, np.stack(rows["f"]).astype(np.float64))
                    var = np.exp(out[:, 2:4])
                    yield pd.DataFrame({"id": rows["id"], "x": out[:, 0], "y": out[:, 1], "vx": var[:, 0], "vy": var[:, 1]})

        return df.select(F.col(id).cast("bigint").alias("id"), F.col(x).alias("f")) \
            .mapInPandas(run, "id bigint, x double, y double, vx double, vy double")


def train(model: Model, rows: DataFrame, epochs: int, batch_size: int = 1024, lr: float = 1e-3, seed: int = 0,
          workers: int | None = None, schedule: str | None = None, schedule_params: dict | None = None,
          weight_decay: float = 0.01) -> Trained:
    """AdamW for ``epochs`` passes; one Spark job per epoch."""
    spark = rows.sparkSession
    n = rows.count()
    workers = workers or max(1, min(spark.sparkContext.defaultParallelism, n // batch_size))
    key = "id" if "id" in rows.columns else F.monotonically_increasing_id()
    data = cut(rows.repartition(workers, key))
    params = model.start(seed)
    sizes = [p.size for p in params]
    shapes = [p.shape for p in params]
    state = np.concatenate([np.concatenate([p.ravel() for p in params]), np.zeros(2 * sum(sizes))])
    steps_done, history = 0, []

    def unpack(flat):
        return [part.reshape(s).copy() for part, s in zip(np.split(flat, np.cumsum(sizes)[:-1]), shapes)]

    for epoch in range(epochs):
        rate = SCHEDULES[schedule](epoch, lr, **(schedule_params or {})) if schedule else lr
        sent = spark.sparkContext.broadcast(state)
        done = steps_done

        def one_pass(batches):
            w, m, v = (unpack(part) for part in np.split(sent.value.copy(), 3))
            rng = np.random.default_rng((seed, epoch, TaskContext.get().partitionId()))
            step, losses, seen = done, 0.0, 0
            for rows in batches:
                rows = rows.iloc[rng.permutation(len(rows))]
                for a in range(0, len(rows), batch_size):
                    part = rows.iloc[a:a + batch_size]
                    value, grads = model.loss(w, _batch(part), rng)
                    step += 1
                    for p, mi, vi, g in zip(w, m, v, grads):
                        p *= 1 - rate * weight_decay
                        mi += 0.1 * (g - mi)
                        vi += 0.001 * (g * g - vi)
                        p -= rate * (mi / (1 - 0.9 ** step)) / (np.sqrt(vi / (1 - 0.999 ** step)) + 1e-8)
                    losses, seen = losses + value * len(part), seen + len(part)
            if seen:
                flat = np.concatenate([a.ravel() for group in (w, m, v) for a in group])
                yield pd.DataFrame({"node": [0], "state": [flat * seen], "loss": [losses],
                                    "seen": [seen], "steps": [step - done]})

        def add(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"node": [key[0]], "state": [np.sum(np.stack(parts["state"]), axis=0)],
                                 "loss": [parts["loss"].sum()], "seen": [parts["seen"].sum()],
                                 "steps": [parts["steps"].max()]})

        schema = "node int, state array<double>, loss double, seen bigint, steps bigint"
        passed = data.mapInPandas(one_pass, schema)
        if workers > 1:
            fan = max(1, int(workers ** 0.5))
            passed = passed.withColumn("node", F.pmod(F.spark_partition_id(), F.lit(fan))).groupBy("node") \
                .applyInPandas(add, schema)
        got = passed.toPandas()
        seen = got["seen"].sum()
        state = np.sum(np.stack(got["state"]), axis=0) / seen
        steps_done += int(got["steps"].max())
        history.append(float(got["loss"].sum() / seen))
        sent.unpersist()
    return Trained(model, unpack(np.split(state, 3)[0]), history)
