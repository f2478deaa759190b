"""Training of the small Transformer in numpy: one task per model, on token windows that the cluster made.

Gradients are kept on a tape: each step of the forward pass notes how its result's gradient goes back to what it was made of.
The objective is cross entropy with smoothed labels, plus a small share of masked-token prediction; after each pass over the
examples one step pushes the scores of each pair's positive side a margin above the negative side's, and scores within
a consistency group together. Training stops once the validation loss has not fallen for some epochs; the best weights stay.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions import tokens as T
from brindle.operators.transformer import _erf, random_weights
from brindle.sources import checkpoints

MOST_EXAMPLES = 200_000
LANGUAGE = "language.weight"


class Value:
    """An array, and once a later result has a gradient, its own."""

    __slots__ = ("v", "g")

    def __init__(self, v: np.ndarray):
        self.v, self.g = v, None

    def take(self, g: np.ndarray) -> None:
        self.g = g if self.g is None else self.g + g


class Tape:
    """Steps of a forward pass in order; going back runs them from the last to the first."""

    def __init__(self):
        self.steps: list[Callable[[], None]] = []

    def note(self, out: Value, back: Callable[[np.ndarray], None]) -> Value:
        self.steps.append(lambda: back(out.g) if out.g is not None else None)
        return out

    def back(self) -> None:
        for step in reversed(self.steps):
            step()

    def embed(self, table: Value, positions: Value, ids: np.ndarray) -> Value:
        def back(g):
            rows = np.zeros_like(table.v)
            np.add.at(rows, ids, g)
            table.take(rows)
            place = np.zeros_like(positions.v)
            place[: ids.shape[1]] = g.sum(0)
            positions.take(place)

        return self.note(Value(table.v[ids] + positions.v[: ids.shape[1]]), back)

    def add(self, a: Value, b: Value) -> Value:
        return self.note(Value(a.v + b.v), lambda g: (a.take(g), b.take(g)))

    def linear(self, x: Value, w: Value, b: Value | None = None) -> Value:
        def back(g):
            flat = g.reshape(-1, g.shape[-1])
            x.take(g @ w.v)
            w.take(flat.T @ x.v.reshape(-1, x.v.shape[-1]))
            if b is not None:
                b.take(flat.sum(0))

        return self.note(Value(x.v @ w.v.T + (0 if b is None else b.v)), back)

    def norm(self, x: Value, w: Value, b: Value) -> Value:
        spread = 1 / np.sqrt(x.v.var(-1, keepdims=True) + 1e-5)
        unit = (x.v - x.v.mean(-1, keepdims=True)) * spread

        def back(g):
            axes = tuple(range(g.ndim - 1))
            w.take((g * unit).sum(axes))
            b.take(g.sum(axes))
            h = g * w.v
            x.take((h - h.mean(-1, keepdims=True) - unit * (h * unit).mean(-1, keepdims=True)) * spread)

        return self.note(Value(unit * w.v + b.v), back)

    def gelu(self, x: Value) -> Value:
        half = 0.5 * (1 + _erf(x.v / math.sqrt(2)))
        return self.note(Value(x.v * half), lambda g: x.take(g * (half + x.v * np.exp(-x.v * x.v / 2) / math.sqrt(2 * math.pi))))

    def attention(self, qkv: Value, mask: np.ndarray, heads: int) -> Value:
        b, n, d = qkv.v.shape[0], qkv.v.shape[1], qkv.v.shape[2] // 3
        cut = lambda x: x.reshape(b, n, heads, d // heads).transpose(0, 2, 1, 3)
        glue = lambda x: x.transpose(0, 2, 1, 3).reshape(b, n, d)
        q, k, v = map(cut, np.split(qkv.v, 3, axis=-1))
        scale = 1 / math.sqrt(d // heads)
        s = q @ k.transpose(0, 1, 3, 2) * scale + np.where(mask[:, None, None, :] > 0, 0.0, -1e30)
        a = np.exp(s - s.max(-1, keepdims=True))
        a /= a.sum(-1, keepdims=True)

        def back(g):
            g = cut(g)
            da = g @ v.transpose(0, 1, 3, 2)
            ds = a * (da - (da * a).sum(-1, keepdims=True)) * scale
            qkv.take(np.concatenate([glue(ds @ k), glue(ds.transpose(0, 1, 3, 2) @ q), glue(a.transpose(0, 1, 3, 2) @ g)], axis=-1))

        return self.note(Value(glue(a @ v)), back)

    def pool(self, x: Value, mask: np.ndarray) -> Value:
        share = mask[..., None] / np.maximum(mask.sum(1), 1)[:, None, None]
        return self.note(Value((x.v * share).sum(1)), lambda g: x.take(g[:, None, :] * share))


class Network:
    """The encoder with its two heads; weights have the names that transformer.logits reads."""

    def __init__(self, vocabulary: int, length: int, d: int, layers: int, ffn: int, heads: int, seed: int):
        w = random_weights(seed, vocabulary, length, d, layers, ffn)
        w = {k: np.zeros_like(x) if k.endswith("bias") else x for k, x in w.items()} | {LANGUAGE: w["token_embedding.weight"][::-1].copy()}
        self.w = {k: Value(x.astype(np.float64)) for k, x in w.items()}
        self.heads, self.layers = heads, layers

    def encode(self, tape: Tape, ids: np.ndarray, mask: np.ndarray) -> Value:
        w = self.w
        x = tape.embed(w["token_embedding.weight"], w["position_embedding.weight"], ids)
        for k in range(self.layers):
            p = f"encoder.layers.{k}"
            part = lambda name: (w[f"{p}.{name}.weight"], w[f"{p}.{name}.bias"])  # noqa: B023, E731
            y = tape.linear(tape.norm(x, *part("norm1")), w[f"{p}.self_attn.in_proj_weight"], w[f"{p}.self_attn.in_proj_bias"])
            x = tape.add(x, tape.linear(tape.attention(y, mask, self.heads), *part("self_attn.out_proj")))
            y = tape.gelu(tape.linear(tape.norm(x, *part("norm2")), *part("linear1")))
            x = tape.add(x, tape.linear(y, *part("linear2")))
        return tape.norm(x, w["norm.weight"], w["norm.bias"])

    def classes(self, tape: Tape, ids: np.ndarray, mask: np.ndarray) -> Value:
        return tape.linear(tape.pool(self.encode(tape, ids, mask), mask), self.w["classifier.weight"], self.w["classifier.bias"])

    def words(self, tape: Tape, ids: np.ndarray, mask: np.ndarray) -> Value:
        return tape.linear(self.encode(tape, ids, mask), self.w[LANGUAGE])


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(-1, keepdims=True)
    return x - np.log(np.exp(x).sum(-1, keepdims=True))


def class_loss(logits: Value, labels: np.ndarray, smoothing: float, positive_weight: float) -> float:
    """Mean weighted cross entropy with smoothed labels; leaves its gradient at logits."""
    p = _log_softmax(logits.v)
    heavy = np.array([1.0, positive_weight])
    want = (1 - smoothing) * np.eye(2)[labels] * heavy + smoothing / 2 * heavy
    total = heavy[labels].sum()
    logits.take((np.exp(p) * want.sum(1, keepdims=True) - want) / total)
    return float(-(want * p).sum() / total)


def language_loss(logits: Value, targets: np.ndarray, share: float) -> float:
    """Mean cross entropy at masked places (targets >= 0), times share."""
    at = targets >= 0
    if not at.any():
        return 0.0
    p = _log_softmax(logits.v[at])
    rows = np.arange(len(p))
    g = np.exp(p)
    g[rows, targets[at]] -= 1
    whole = np.zeros_like(logits.v)
    whole[at] = g * share / len(p)
    logits.take(whole)
    return float(-share * p[rows, targets[at]].mean())


def structured_loss(logits: Value, pairs: list[tuple[int, int]], groups: list[list[int]], margin: float, pair_weight: float, consistency_weight: float) -> float:
    """Hinge on each pair's gap, and variance of scores within groups."""
    score, g, loss = logits.v[:, 1] - logits.v[:, 0], np.zeros(len(logits.v)), 0.0
    if pairs and pair_weight:
        low, high = np.array(pairs).T
        short = margin - (score[high] - score[low])
        loss += pair_weight * np.maximum(short, 0).mean()
        step = pair_weight * (short > 0) / len(pairs)
        np.add.at(g, low, step)
        np.add.at(g, high, -step)
    if groups and consistency_weight:
        for rows in groups:
            off = score[rows] - score[rows].mean()
            loss += consistency_weight * (off * off).mean() / len(groups)
            np.add.at(g, rows, consistency_weight * 2 * off / len(rows) / len(groups))
    logits.take(np.stack([-g, g], axis=1))
    return float(loss)


class AdamW:
    def __init__(self, weights: dict[str, Value], rate: float, decay: float = 0.01):
        self.weights, self.rate, self.decay, self.steps = weights, rate, decay, 0
        self.first = {k: np.zeros_like(w.v) for k, w in weights.items()}
        self.second = {k: np.zeros_like(w.v) for k, w in weights.items()}

    def step(self, longest: float = 1.0) -> None:
        """One update with gradients scaled to at most that norm; gradients are gone afterwards."""
        self.steps += 1
        size = math.sqrt(sum(float((w.g * w.g).sum()) for w in self.weights.values() if w.g is not None))
        scale = min(1.0, longest / (size + 1e-6))
        for k, w in self.weights.items():
            if w.g is None:
                continue
            g = w.g * scale
            self.first[k] += 0.1 * (g - self.first[k])
            self.second[k] += 0.001 * (g * g - self.second[k])
            w.v *= 1 - self.rate * self.decay
            w.v -= self.rate * (self.first[k] / (1 - 0.9**self.steps)) / (np.sqrt(self.second[k] / (1 - 0.999**self.steps)) + 1e-8)
            w.g = None


def _hidden(ids: np.ndarray, mask: np.ndarray, r: np.random.Generator, share: float = 0.15) -> tuple[np.ndarray, np.ndarray]:
    """Ids with some tokens masked, and what stood there (-1 elsewhere)."""
    pick = (r.random(ids.shape) < share) & (mask > 0) & (ids >= T.FIRST)
    return np.where(pick, T.MASK, ids), np.where(pick, ids, -1)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature in [1, 20] with the least validation loss, on the grid of models.fit_temperature."""
    grid = [math.exp(math.log(20.0) * k / 240) for k in range(241)]
    return min(grid, key=lambda t: (-_log_softmax(logits / t)[np.arange(len(labels)), labels].mean(), t))


def fit(train: dict, validation: dict | None, *, vocabulary: int = 4096, length: int = 256, d: int = 96, layers: int = 2, ffn: int = 192, heads: int = 4, epochs: int = 40, batch: int = 16, rate: float = 1e-3, language: float = 0.05, smoothing: float = 0.05, positive_weight: float = 1.0, margin: float = 1.0, pair_weight: float = 0.15, consistency_weight: float = 0.05, patience: int = 8, least_epochs: int = 5, seed: int = 13) -> tuple[dict[str, np.ndarray], dict]:
    """Weights and an account of the training; train and validation have ids, mask, labels, pairs and groups."""
    for name, part in (("training", train), ("validation", validation)):
        if part is not None and set(part["labels"].tolist()) != {0, 1}:
            raise ValueError(f"{name} examples need both labels")
    if epochs < 1 or batch < 1 or patience < 1 or least_epochs < 1 or margin <= 0 or not 0 <= language <= 1 or not 0 <= smoothing < 1 or positive_weight <= 0 or min(pair_weight, consistency_weight) < 0:
        raise ValueError("a training option is out of its range")
    r, net = np.random.default_rng(seed), Network(vocabulary, length, d, layers, ffn, heads, seed)
    adam = AdamW(net.w, rate)
    ids, mask, labels = train["ids"], train["mask"].astype(np.float64), train["labels"]

    def outputs(part: dict) -> np.ndarray:
        return np.concatenate([net.classes(Tape(), part["ids"][a : a + batch], part["mask"][a : a + batch].astype(np.float64)).v for a in range(0, len(part["ids"]), batch)])

    best, best_loss, best_epoch, stale, losses = None, math.inf, 0, 0, []
    for epoch in range(1, epochs + 1):
        total = []
        for rows in np.array_split(order := r.permutation(len(ids)), -(-len(order) // batch)):
            tape = Tape()
            loss = class_loss(out := net.classes(tape, ids[rows], mask[rows]), labels[rows], smoothing, positive_weight)
            tape.back()
            if language:
                hidden, targets = _hidden(ids[rows], mask[rows], r)
                tape = Tape()
                loss += language_loss(out := net.words(tape, hidden, mask[rows]), targets, language)
                tape.back()
            adam.step()
            total.append(loss)
        if train["pairs"] or train["groups"]:
            tape = Tape()
            total.append(structured_loss(net.classes(tape, ids, mask), train["pairs"], train["groups"], margin, pair_weight, consistency_weight))
            tape.back()
            adam.step()
        losses.append(float(np.mean(total)))
        if validation is None:
            best_epoch = epoch
            continue
        v = outputs(validation)
        nll = float(-_log_softmax(v)[np.arange(len(v)), validation["labels"]].mean())
        if nll < best_loss - 1e-6:
            best, best_loss, best_epoch, stale = {k: w.v.copy() for k, w in net.w.items()}, nll, epoch, 0
        else:
            stale += 1
        if epoch >= least_epochs and stale >= patience:
            break
    if best is not None:
        for k, v in best.items():
            net.w[k].v = v
    own = outputs(train)
    t = 1.0 if validation is None else temperature(outputs(validation), validation["labels"])
    account = {
        "examples": len(ids), "epochs_completed": epoch, "best_epoch": best_epoch, "losses": losses, "training_accuracy": float((own.argmax(1) == labels).mean()), "validation_nll": None if validation is None else best_loss, "temperature": t,
        "early_stopped": epoch < epochs, "pairs": len(train["pairs"]), "groups": len(train["groups"]), "parameters": int(sum(w.v.size for k, w in net.w.items() if k != LANGUAGE)), "seed": seed,
    }
    return {k: w.v.astype(np.float32) for k, w in net.w.items() if k != LANGUAGE}, account


def train_micro(examples: DataFrame, person: bytes = b"brindle2", by: str = "system", **options) -> DataFrame:
    """(by, manifest, data, account): a checkpoint for each model key, as checkpoints.imported reads it.

    examples have by, sample_id, tokens, label, split (train or validation), group_id, pair_id and variant. Rows of one
    pair_id and variant and different labels are pairs; training rows of one group_id are a consistency group. A model trains
    in one task, so a key of more than MOST_EXAMPLES rows raises.
    """
    length, vocabulary = options.get("length", 256), options.get("vocabulary", 4096)
    many = examples.groupBy(by).agg(F.count("*").alias("n")).filter(F.col("n") > MOST_EXAMPLES).first()
    if many is not None:
        raise ValueError(f"{many.n} examples of one model; at most {MOST_EXAMPLES} are trained in one task")
    e = examples.select(by, "sample_id", "label", "split", "group_id", "pair_id", "variant", T.encode_ids(F.col("tokens"), length, vocabulary, person).alias("e")).select("*", "e.*").drop("e")

    def run(pdf):
        import pandas as pd

        def part(rows):
            rows = rows.sort_values("sample_id").reset_index(drop=True)
            sides = rows[rows["pair_id"].notna()].groupby(["pair_id", "variant"])
            pairs = [(a, b) for _, x in sides for a in x.index[x["label"] == 0] for b in x.index[x["label"] == 1]]
            groups = [list(x.index) for _, x in rows.groupby("group_id") if len(x) > 1]
            return {"ids": np.stack(rows["ids"].to_list()), "mask": np.stack(rows["mask"].to_list()), "labels": rows["label"].to_numpy().astype(np.int64), "pairs": pairs, "groups": groups}

        held = pdf[pdf["split"] == "validation"]
        weights, account = fit(part(pdf[pdf["split"] == "train"]), part(held) if len(held) else None, **options)
        data, manifest = checkpoints.exported(weights, {k: v for k, v in account.items() if k != "losses"})
        return pd.DataFrame({by: [pdf[by].iloc[0]], "manifest": [json.dumps(manifest, sort_keys=True)], "data": [data], "account": [json.dumps(account, sort_keys=True)]})

    return e.groupBy(by).applyInPandas(run, f"{by} {dict(examples.dtypes)[by]}, manifest string, data binary, account string")
