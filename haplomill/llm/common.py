"""Shared helpers: tables, id ranges and vectorised text hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..storage import cut, scratch_path, scratch_root  # noqa: F401

DOC_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
M64 = (1 << 64) - 1


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_bounds(df: DataFrame, key: str, n: int) -> list[int]:
    """At most n - 1 ascending split points of an integer key, from approximate quantiles over all rows."""
    row = df.agg(F.percentile_approx(F.col(key), F.array(*[F.lit(i / n) for i in range(1, n)]), 20 * n).alias("q")).first() if n > 1 else None
    return sorted(set(row.q)) if row is not None and row.q else []


def bucket_of(col, bounds: list[int]):
    """Number of split points at or below a long column: 0 ... len(bounds); null goes to 0. A binary search over Arrow
    batches of the column alone, so neither the plan nor the cost of a row grows with the number of points."""
    if not bounds:
        return F.lit(0)
    points = np.array(bounds, dtype=np.int64)

    @F.arrow_udf("int")
    def search(ids: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(points, ids.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False), side="right"), pa.int32())

    return search(col)


def place_of(col, keys: list[int], values: list[int]):
    """The value that stands with the key equal to a long column, null where there is none; keys ascend."""
    known, named = np.array(keys, dtype=np.int64), np.array(values, dtype=np.int32)

    @F.arrow_udf("int")
    def search(ids: pa.Array) -> pa.Array:
        x = ids.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
        at = np.minimum(np.searchsorted(known, x), len(known) - 1)
        return pa.array(named[at], pa.int32(), mask=known[at] != x)

    return search(col)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche over unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Bytes hashed at a time.
STRETCH = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS = np.ones(1, dtype=np.uint64)
_INVERSE = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, at least n of each."""
    global _POWERS, _INVERSE
    if len(_POWERS) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _POWERS, _INVERSE = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS, _INVERSE


_WHITE = np.zeros(256, dtype=bool)
_WHITE[[32, *range(9, 14)]] = True


def spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
    return edge[::2], edge[1::2]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each slice data[start:end]; equal slices have equal hashes wherever they lie.

    Slices come in order and don't overlap. A long text is hashed some of its slices at a time, so memory grows with the
    longest slice, not with the text.
    """
    if len(data) > STRETCH and len(starts):
        cuts = np.flatnonzero(np.diff(starts // STRETCH)) + 1
        return np.concatenate([_slice_hashes(data[s[0] : e[-1]], s - s[0], e - s[0]) for s, e in zip(np.split(starts, cuts), np.split(ends, cuts))])
    return _slice_hashes(data, starts, ends)


def _slice_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    n = len(data)
    up, down = _powers(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    return mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: bytes) -> np.ndarray:
    """Hashes of the whitespace-separated words of UTF-8 bytes, in order."""
    raw = np.frombuffer(data, dtype=np.uint8)
    starts, ends = spans(~_WHITE[raw])
    return span_hashes(raw, starts, ends) if len(starts) else np.zeros(0, np.uint64)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k words; a shorter non-empty text is one shingle of all its words."""
    if not len(words):
        return words
    k = min(k, len(words))
    m = len(words) - k + 1
    out = np.zeros(m, dtype=np.uint64)
    for i in range(k):
        out = out * np.uint64(0x100000001B3) + words[i : i + m]
    return mix64(out)
