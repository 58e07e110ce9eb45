"""Two-tower score from a table of weights."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_WEIGHTS = 64_000_000   # values; a model is of fixed size, and more than this is not broadcast


def erf(x: np.ndarray) -> np.ndarray:
    """Vectorised error function, absolute error below 2e-7."""
    t = 1.0 / (1.0 + 0.3275911 * np.abs(x))
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return np.sign(x) * (1.0 - poly * np.exp(-x * x))


def gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1.0 + erf(x / np.sqrt(2.0)))


def layer_norm(x: np.ndarray, scale: np.ndarray, shift: np.ndarray) -> np.ndarray:
    mean, var = x.mean(axis=-1, keepdims=True), x.var(axis=-1, keepdims=True)
    return (x - mean) / np.sqrt(var + 1e-5) * scale + shift


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def project(x: np.ndarray, w: dict[str, np.ndarray], tower: str) -> np.ndarray:
    hidden = x @ w[f"{tower}.in.weight"].T + w[f"{tower}.in.bias"]
    hidden = gelu(layer_norm(hidden, w[f"{tower}.norm.weight"], w[f"{tower}.norm.bias"]))
    return hidden @ w[f"{tower}.out.weight"].T + w[f"{tower}.out.bias"]


def fuse(tokens: np.ndarray, w: dict[str, np.ndarray], heads: int) -> np.ndarray:
    """Self-attention over the tokens of a row (rows, tokens, width), residual norm, mean, projection."""
    n, t, h = tokens.shape
    qkv = tokens @ w["fuse.qkv.weight"].T + w["fuse.qkv.bias"]
    q, k, v = (p.reshape(n, t, heads, h // heads).transpose(0, 2, 1, 3) for p in np.split(qkv, 3, axis=-1))
    logits = q @ k.transpose(0, 1, 3, 2) / np.sqrt(h // heads)
    share = np.exp(logits - logits.max(axis=-1, keepdims=True))
    mixed = (share / share.sum(axis=-1, keepdims=True)) @ v
    mixed = mixed.transpose(0, 2, 1, 3).reshape(n, t, h) @ w["fuse.attn_out.weight"].T + w["fuse.attn_out.bias"]
    pooled = layer_norm(tokens + mixed, w["fuse.norm.weight"], w["fuse.norm.bias"]).mean(axis=1)
    return pooled @ w["fuse.out.weight"].T + w["fuse.out.bias"]


def load_weights(weights: DataFrame) -> dict[str, np.ndarray]:
    """weights(name, shape ARRAY<INT>, vals ARRAY<FLOAT>) → arrays, after a check of their total size."""
    size = weights.agg(F.sum(F.size("vals").cast("bigint"))).first()[0] or 0
    if size > MAX_WEIGHTS:
        raise ValueError(f"{size} weights exceed the {MAX_WEIGHTS} that are broadcast")
    return {r["name"]: np.asarray(r["vals"], dtype=np.float64).reshape(r["shape"]) for r in weights.collect()}


def score_two_tower(df: DataFrame, weights: DataFrame, heads: int = 4) -> DataFrame:
    """df(id, text, depth, pose) → id, text_vec, image_vec, score; dropout is off."""
    model = df.sparkSession.sparkContext.broadcast(load_weights(weights))
    ids = df.schema["id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = model.value
        for f in frames:
            if f.empty:
                continue
            text, depth, pose = (np.stack(f[c].to_numpy()).astype(np.float64) for c in ("text", "depth", "pose"))
            t = unit(project(text, w, "text"))
            i = unit(fuse(np.stack([project(depth, w, "depth"), project(pose, w, "pose")], axis=1), w, heads))
            yield pd.DataFrame({"id": f["id"], "text_vec": list(t), "image_vec": list(i), "score": (t * i).sum(axis=1)})

    return df.select("id", "text", "depth", "pose").mapInPandas(
        run, f"id {ids}, text_vec array<double>, image_vec array<double>, score double")
