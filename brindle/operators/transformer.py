"""Forward pass of a small pre-norm Transformer classifier in numpy, for Arrow batches of token id windows.

Weights are a dictionary of arrays with the parameter names that torch gives the same layers, so a published checkpoint
loads as it is. The encoder is a few megabytes; its size is checked before it is broadcast.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions import tokens as T

MAX_BYTES = 64 << 20


def _erf(x: np.ndarray) -> np.ndarray:
    """Error function to about 1e-7 (Abramowitz and Stegun 7.1.26)."""
    t = 1.0 / (1.0 + 0.3275911 * np.abs(x))
    y = 1.0 - (((((1.061405429 * t - 1.453152027) * t) + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * np.exp(-x * x)
    return np.sign(x) * y


def _norm(x: np.ndarray, w: dict, name: str) -> np.ndarray:
    mean, spread = x.mean(-1, keepdims=True), x.var(-1, keepdims=True)
    return (x - mean) / np.sqrt(spread + 1e-5) * w[f"{name}.weight"] + w[f"{name}.bias"]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def logits(w: dict[str, np.ndarray], ids: np.ndarray, mask: np.ndarray, heads: int = 4) -> np.ndarray:
    """(batch, 2) class logits of (batch, length) ids; masked positions neither attend nor are pooled."""
    x = w["token_embedding.weight"][ids] + w["position_embedding.weight"][: ids.shape[1]]
    b, n, d = x.shape
    hidden = np.where(mask[:, None, None, :] > 0, 0.0, -1e30)
    layer = 0
    while (p := f"encoder.layers.{layer}") + ".norm1.weight" in w:
        y = _norm(x, w, f"{p}.norm1")
        q, k, v = np.split(y @ w[f"{p}.self_attn.in_proj_weight"].T + w[f"{p}.self_attn.in_proj_bias"], 3, axis=-1)
        q, k, v = (z.reshape(b, n, heads, d // heads).transpose(0, 2, 1, 3) for z in (q, k, v))
        a = _softmax(q @ k.transpose(0, 1, 3, 2) / math.sqrt(d // heads) + hidden) @ v
        x = x + a.transpose(0, 2, 1, 3).reshape(b, n, d) @ w[f"{p}.self_attn.out_proj.weight"].T + w[f"{p}.self_attn.out_proj.bias"]
        y = _norm(x, w, f"{p}.norm2") @ w[f"{p}.linear1.weight"].T + w[f"{p}.linear1.bias"]
        y = 0.5 * y * (1.0 + _erf(y / math.sqrt(2.0)))
        x = x + y @ w[f"{p}.linear2.weight"].T + w[f"{p}.linear2.bias"]
        layer += 1
    x = _norm(x, w, "norm") * mask[..., None]
    pooled = x.sum(1) / np.maximum(mask.sum(1, keepdims=True), 1)
    return pooled @ w["classifier.weight"].T + w["classifier.bias"]


def random_weights(seed: int = 0, vocabulary: int = 4096, length: int = 256, d: int = 96, layers: int = 2, ffn: int = 192) -> dict[str, np.ndarray]:
    """Weights of the right shapes, for tests and timing."""
    r = np.random.default_rng(seed)
    g = lambda *s: (r.standard_normal(s) * 0.05).astype(np.float32)
    w = {"token_embedding.weight": g(vocabulary, d), "position_embedding.weight": g(length, d), "norm.weight": np.ones(d, np.float32), "norm.bias": g(d), "classifier.weight": g(2, d), "classifier.bias": g(2)}
    for k in range(layers):
        p = f"encoder.layers.{k}"
        w |= {f"{p}.norm1.weight": np.ones(d, np.float32), f"{p}.norm1.bias": g(d), f"{p}.norm2.weight": np.ones(d, np.float32), f"{p}.norm2.bias": g(d), f"{p}.self_attn.in_proj_weight": g(3 * d, d), f"{p}.self_attn.in_proj_bias": g(3 * d)}
        w |= {f"{p}.self_attn.out_proj.weight": g(d, d), f"{p}.self_attn.out_proj.bias": g(d), f"{p}.linear1.weight": g(ffn, d), f"{p}.linear1.bias": g(ffn), f"{p}.linear2.weight": g(d, ffn), f"{p}.linear2.bias": g(d)}
    return w


def predict(examples: DataFrame, weights: dict[str, np.ndarray], heads: int = 4, temperature: float = 1.0, person: bytes = b"brindle2", overlap: int = 32, most: int = 16, key: str = "sample_id") -> DataFrame:
    """(key, probability): the largest probability of the positive class over the windows of a token sequence."""
    if sum(a.nbytes for a in weights.values()) > MAX_BYTES:
        raise ValueError("the weights are too large to broadcast")
    held = examples.sparkSession.sparkContext.broadcast(weights)
    vocabulary, length = weights["token_embedding.weight"].shape[0], weights["position_embedding.weight"].shape[0]

    @F.pandas_udf("double")
    def positive(ids, mask):
        import pandas as pd

        out = []
        for a in range(0, len(ids), 64):
            z = logits(held.value, np.stack(ids[a : a + 64].to_list()), np.stack(mask[a : a + 64].to_list()).astype(np.float32), heads) / temperature
            out.append(_softmax(z)[:, 1])
        return pd.Series(np.concatenate(out) if out else [], dtype="float64")

    w = examples.select(key, F.explode(T.windows(F.col("tokens"), length - 2, overlap, most)).alias("w"))
    e = w.select(key, encoded(F.col("w"), length, vocabulary, person).alias("e"))
    return e.select(key, positive("e.ids", "e.mask").alias("p")).groupBy(key).agg(F.max("p").alias("probability"))


def encoded(tokens: Column, length: int, vocabulary: int, person: bytes) -> Column:
    return T.encode_ids(tokens, length, vocabulary, person)


def predict_details(examples: DataFrame, weights: dict[str, np.ndarray], known: DataFrame, prototypes: DataFrame, least_coverage: float = 1.0, least_jaccard: float = 0.2, **options) -> DataFrame:
    """(sample_id, probability, windows, token_coverage, nearest, unknown_tokens, supported): predictions and whether the model is fit for them."""
    from brindle.operators.support import assess

    length = weights["position_embedding.weight"].shape[0]
    windows = examples.select("sample_id", F.size(T.windows(F.col("tokens"), length - 2, options.get("overlap", 32), options.get("most", 16))).alias("windows"))
    return predict(examples, weights, **options).join(windows, "sample_id").join(assess(examples, known, prototypes, least_coverage, least_jaccard), "sample_id")
