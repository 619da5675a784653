"""Deterministic hashes: seeds, canaries, MinHash and canonical JSON."""

from __future__ import annotations

import hashlib
import json
import random

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the MinHash family: the Mersenne prime and the seed of its coefficients.
PRIME = (1 << 61) - 1
MINHASH_SEED = 7


def stable_seed(*parts: Column) -> Column:
    """48-bit number from the SHA-256 of the parts joined by ``||``."""
    text = F.concat_ws("||", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("long")


def canary(key: Column, salt: str = "", prefix: str = "tracewright-canary-") -> Column:
    """A string that only a leaked pack would bring up again."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), key.cast("string")), 256), 1, 12))


def coefficients(perms: int, seed: int = MINHASH_SEED) -> list[tuple[int, int]]:
    """The hash family's coefficients, drawn in turn."""
    rng = random.Random(seed)
    return [(rng.randrange(1, PRIME), rng.randrange(0, PRIME)) for _ in range(perms)]


def _folded(x: np.ndarray) -> np.ndarray:
    """A number modulo 2^61 - 1, up to one reduction: 2^61 counts as 1."""
    return (x & np.uint64(PRIME)) + (x >> np.uint64(61))


def signatures(hashes: np.ndarray, starts: np.ndarray, perms: int) -> np.ndarray:
    """A row of ``perms`` minima of ``(a h + b) mod (2^61 - 1)`` for each run of hashes below the prime, exact in 64 bits: factors are cut at bit 31."""
    low31, low30 = np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)
    high, low = hashes >> np.uint64(31), hashes & low31
    out = np.empty((len(starts), perms), dtype=np.int64)
    for k, (a, b) in enumerate(coefficients(perms)):
        a1, a0 = np.uint64(a >> 31), np.uint64(a & ((1 << 31) - 1))
        middle = a1 * low + a0 * high
        total = _folded(np.uint64(2) * (a1 * high)) + _folded((middle >> np.uint64(30)) + ((middle & low30) << np.uint64(31)))
        value = _folded(_folded(total) + _folded(_folded(a0 * low) + np.uint64(b))) % np.uint64(PRIME)
        out[:, k] = np.minimum.reduceat(value, starts)
    return out


def minhash(sets: DataFrame, perms: int = 64, also: tuple[str, ...] = ()) -> DataFrame:
    """``ord, sig`` (MinHash signature) and the columns ``also`` of rows ``ord, shingles``: hashes are the first eight bytes of MD5; an empty set has the one hash 0.

    The 64 products per shingle are vectorised in Arrow batches: as column
    expressions they take over ten times as long, being too many to compile.
    """

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                lists = batch.column(1)
                ends = lists.offsets.to_numpy().astype(np.int64)
                sizes = np.diff(ends)
                digests = b"".join([hashlib.md5(x).digest()[:8] for x in lists.flatten().cast(pa.binary()).to_pylist()])
                hashes = np.frombuffer(digests, dtype=">u8").astype(np.uint64) % np.uint64(PRIME)
                rows = np.flatnonzero(sizes)
                sig = np.empty((len(sizes), perms), dtype=np.int64)
                sig[:] = signatures(np.zeros(1, dtype=np.uint64), np.zeros(1, dtype=np.int64), perms)
                if len(rows):
                    sig[rows] = signatures(hashes, ends[rows] - ends[0], perms)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, sig.size + 1, perms, dtype=np.int32)), pa.array(sig.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), flat, *batch.columns[2:]], names=["ord", "sig", *also])

    kinds = dict(sets.dtypes)
    return sets.select("ord", "shingles", *also).mapInArrow(run, ", ".join(["ord long", "sig array<long>", *(f"{c} {kinds[c]}" for c in also)]))


def canonical(value) -> str:
    """Canonical JSON text: sorted keys, unescaped, anything else as its string."""
    return json.dumps(value, sort_keys=True, ensure_ascii=False, default=str)


def content_digest(value, length: int = 16) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()[:length]


def content_hash(text: Column, length: int = 16) -> Column:
    """Content hash of a column of JSON texts, whatever their key order and spacing."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else content_digest(json.loads(v), length))

    return run(text)
