"""Session stores: blobs, tensors, buffers and registries, as rows keyed by session, layer and token.

A store is a table; storing is the last write per key, dropping an anti-join, and whatever describes a store is an
aggregate over it. Snapshots are lengths per layer.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def store(rows: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """The last write of every key; the rows may be a log of any length."""
    names = [c for c in rows.columns if c not in (*keys, order)]
    last = F.max(F.struct(F.col(order), *[F.col(c) for c in names])).alias("last")
    return rows.groupBy(*keys).agg(last).select(*keys, *[F.col(f"last.{c}").alias(c) for c in names])


def lookup(entries: DataFrame, asked: DataFrame, key: str, tokens: str | None = None) -> DataFrame:
    """HIT, COLD (known, but with fewer tokens than asked) or MISS for every asked key."""
    have = entries.select(key, F.col("tokens").alias("__have"))
    short = F.col("__have") < F.col(tokens) if tokens else F.lit(False)
    state = F.when(F.col("__have").isNull(), "MISS").when(short, "COLD").otherwise("HIT")
    return asked.join(have, key, "left").select(*asked.columns, state.alias("state"))


def drop(entries: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return entries.join(gone.select(key), key, "left_anti")


def info(entries: DataFrame, by: list[str], size: str) -> DataFrame:
    return entries.groupBy(*by).agg(F.count(F.lit(1)).alias("entries"), F.sum(size).alias("bytes"))


#: The largest number of 8-bit floating point with 4 bits of exponent and 3 of fraction, and its smallest exponent.
FP8_TOP, FP8_LOW = 448.0, -6


def quantise_blocks(values: np.ndarray, bits: int, block: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Symmetric block quantisation of rows of numbers: whole numbers of ``bits`` bits, and one scale per block of numbers."""
    parts, top = _blocks(values, block), (1 << (bits - 1)) - 1
    scale = np.abs(parts).max(-1) / max(top, 1)
    q = np.rint(parts / np.where(scale > 0, scale, 1)[..., None]).clip(-top, top).astype(np.int8)
    return q, scale.astype(np.float32)


def quantise_fp8(values: np.ndarray, block: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """The same with 8-bit floating point numbers (as the numbers that they stand for) over one scale per block."""
    parts = _blocks(values, block)
    scale = np.abs(parts).max(-1) / FP8_TOP
    y = parts / np.where(scale > 0, scale, 1)[..., None]
    exponent = np.maximum(np.floor(np.log2(np.maximum(np.abs(y), 1e-30))), FP8_LOW)
    step = np.exp2(exponent - 3)
    return (np.rint(y / step) * step).clip(-FP8_TOP, FP8_TOP).astype(np.float32), scale.astype(np.float32)


def _blocks(values: np.ndarray, block: int) -> np.ndarray:
    x = np.atleast_2d(np.asarray(values, np.float32))
    padded = np.zeros((len(x), -(-x.shape[1] // block) * block), np.float32)
    padded[:, : x.shape[1]] = x
    return padded.reshape(len(x), -1, block)


def quantised(rows: DataFrame, bits: int | str, block: int = 32, vector: str = "embedding") -> DataFrame:
    """restored: every vector after a round trip through a block format of 8, 4, 3 or 2 bits, or ``fp8``.

    Vectors of one length are quantised together, a batch at a time.
    """

    @F.pandas_udf("array<double>")
    def trip(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for v in parts:
            out = pd.Series([None] * len(v), dtype=object)
            sizes = v.map(len)
            for n in sizes.unique():
                at = np.flatnonzero(sizes.to_numpy() == n)
                x = np.stack(v.iloc[at].to_numpy()) if n else np.zeros((len(at), 0))
                q, s = quantise_fp8(x, block) if bits == "fp8" else quantise_blocks(x, int(bits), block)
                whole = (q.astype(np.float64) * s[..., None]).reshape(len(at), -1)[:, :n]
                for k, row in zip(at, whole, strict=True):
                    out.iat[k] = row
            yield out

    return rows.withColumn("restored", trip(vector))


def safetensors(name: str, shape: list[int], data: bytes) -> bytes:
    """A safetensors file of one float32 tensor: header length, header, data."""
    head = json.dumps({name: {"dtype": "F32", "shape": shape, "data_offsets": [0, len(data)]}}).encode()
    return struct.pack("<Q", len(head)) + head + data


def export(rows: DataFrame, session: str, dim: int) -> DataFrame:
    """V.EXPORT: one safetensors file (as a row) per layer and run of 4096 tokens, so no file grows with the session."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("token")
        data = np.stack(p["v"].to_numpy()).astype("<f4")
        name = f"{session}.layer{p['layer'].iloc[0]}.part{p['part'].iloc[0]}"
        return pd.DataFrame({"name": [name], "tokens": [len(p)], "file": [safetensors(name, [len(p), dim], data.tobytes())]}).astype({"name": object})

    parted = rows.withColumn("part", F.floor(F.col("token") / 4096))
    return parted.groupBy("layer", "part").applyInPandas(run, "name string, tokens long, file binary")
