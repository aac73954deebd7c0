"""Ascending numbers in near-minimal space: Elias-Fano blocks as binary columns, with rank and select.

A block of n numbers from its least one, spread over u values, keeps the low floor(log2(u / n)) bits of each as they are and
the rest in unary: about 2 + log2(u / n) bits a number. Every block stands for itself, so blocks are rows that Spark deals over
tasks; functions take and give Arrow batches of them.

Layout, little-endian: n, number of low bits, bytes of the low part (4 bytes each); least number (8); low part; unary part.
Bits count from the lowest of a byte. An empty block is 12 zeros and eight more.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def pack(values: np.ndarray) -> bytes:
    """The block of ascending numbers (equal ones may repeat)."""
    values = np.asarray(values, np.int64)
    n = len(values)
    if n and (np.diff(values) < 0).any():
        raise ValueError("the numbers of a block ascend")
    least = int(values[0]) if n else 0
    rest = (values - least).astype(np.uint64)
    low = max(0, ((int(rest[-1]) + 1) // n).bit_length() - 1) if n else 0
    bits = (rest[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)
    lower = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()
    high = (rest >> np.uint64(low)).astype(np.int64) + np.arange(n)
    unary = np.zeros(int(high[-1]) + 1 if n else 0, np.uint8)
    unary[high] = 1
    return np.array([n, low, len(lower)], "<u4").tobytes() + np.array([least], "<i8").tobytes() + lower + np.packbits(unary, bitorder="little").tobytes()


def _parts(raw: bytes) -> tuple[int, int, int, bytes, np.ndarray]:
    n, low, size = np.frombuffer(raw, "<u4", 3).tolist()
    return n, low, int(np.frombuffer(raw, "<i8", 1, 12)[0]), raw[20 : 20 + size], np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8, offset=20 + size), bitorder="little"))


def _low(lower: bytes, low: int, at: np.ndarray) -> np.ndarray:
    if not low:
        return np.zeros(len(at), np.uint64)
    places = at[:, None] * low + np.arange(low)
    bits = (np.frombuffer(lower, np.uint8)[places >> 3] >> (places & 7).astype(np.uint8)) & 1
    return (bits.astype(np.uint64) << np.arange(low, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def select(raw: bytes, at: np.ndarray) -> np.ndarray:
    """The numbers at these places, from 0."""
    n, low, least, lower, ones = _parts(raw)
    at = np.asarray(at, np.int64)
    if len(at) and (at.min() < 0 or at.max() >= n):
        raise IndexError(f"a block of {n} numbers")
    return ((ones[at] - at).astype(np.uint64) << np.uint64(low) | _low(lower, low, at)).astype(np.int64) + least


def rank(raw: bytes, wanted: np.ndarray) -> np.ndarray:
    """How many numbers of the block are smaller than each of these. Only those of the same high part are looked at."""
    n, low, least, lower, ones = _parts(raw)
    high = ones[:n] - np.arange(n)
    rest = np.asarray(wanted, np.int64) - least
    first, last = (np.searchsorted(high, rest >> low, side=side) for side in ("left", "right"))
    last = np.where(rest < 0, first, last)
    while (some := first < last).any():  # bisection over the low bits
        middle = (first + last) // 2
        smaller = np.zeros(len(rest), bool)
        smaller[some] = _low(lower, low, middle[some]).astype(np.int64) < (rest[some] & ((1 << low) - 1))
        first, last = np.where(some & smaller, middle + 1, first), np.where(some & ~smaller, middle, last)
    return first


@F.pandas_udf(T.BinaryType())
def packed(values: pd.Series) -> pd.Series:
    """The block of each row's ascending numbers; null of null."""
    return values.map(lambda v: None if v is None else pack(v))


@F.pandas_udf(T.ArrayType(T.LongType()))
def unpacked(raw: pd.Series) -> pd.Series:
    """All numbers of each row's block."""
    return raw.map(lambda r: None if r is None else select(r, np.arange(int(np.frombuffer(r, "<u4", 1)[0]))))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def places(raw: pd.Series, wanted: pd.Series) -> pd.Series:
    """For each wanted number its place in the row's block, -1 if it is not there."""

    def found(r, w):
        if r is None or w is None:
            return None
        at, n = rank(r, w), int(np.frombuffer(r, "<u4", 1)[0])
        inside = at < n
        there = np.zeros(len(w), bool)
        there[inside] = select(r, at[inside]) == np.asarray(w)[inside]
        return np.where(there, at, -1).astype(np.int32)

    return pd.Series([found(r, w) for r, w in zip(raw, wanted, strict=True)])


@F.pandas_udf(T.ArrayType(T.LongType()))
def at_places(raw: pd.Series, some: pd.Series) -> pd.Series:
    """The numbers at some places of each row's block."""
    return pd.Series([None if r is None or a is None else select(r, a) for r, a in zip(raw, some, strict=True)])
