"""Circulant MinHash signatures of contents, and exact likeness of pairs.

Likeness of two contents is the Jaccard similarity of the sets of runs of ``GRAM`` successive
characters of their cores (canonical.Transducer.core). A first permutation (a mixing hash onto
2^16 slots) places each run; a second one, shifted by k places, gives coordinate k of the
signature. All coordinates of a text are the column minima of rows of one circulant matrix, which
is never built: it is a strided view of the doubled second permutation.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.canonical import transducer

GRAM = 3
#: Contents whose core is shorter never count.
MIN_CORE = 12
SLOTS = 1 << 16
#: Coordinates of a signature; their lowest bits are the 128 bits of the sketch.
WIDTH = 128
#: Classes of runs by which pairs that cannot be alike are told before their runs are compared.
MAP = 2048


@lru_cache(maxsize=1)
def _circulant() -> np.ndarray:
    second = np.random.default_rng(20240229).permutation(SLOTS).astype(np.uint16)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([second, second[:WIDTH]]), WIDTH)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def gram_slots(cores: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The slot of every run of every core, and the number of runs of each core."""
    code = np.frombuffer("".join(cores).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(x) for x in cores], np.int64)
    run = code[:-2] | (code[1:-1] << np.uint64(21)) | (code[2:] << np.uint64(42))
    whole = np.ones(len(code), bool)
    ends = np.cumsum(sizes)
    whole[ends - 1] = whole[ends - 2] = False
    return (_mix(run) >> np.uint64(48)).astype(np.uint16)[whole[:-2]], sizes - (GRAM - 1)


def signatures(cores: list[str]) -> np.ndarray:
    """The signatures, uint16, a row for each core of at least GRAM characters."""
    slots, counts = gram_slots(cores)
    out = np.empty((len(cores), WIDTH), np.uint16)
    matrix, at, low = _circulant(), 0, np.minimum.reduce
    for i, n in enumerate(counts.tolist()):
        # the runs of a very long text are taken in blocks, so its rows never fill the memory
        low(matrix[slots[at : at + min(n, 4096)]], axis=0, out=out[i])
        for b in range(at + 4096, at + n, 4096):
            np.minimum(out[i], low(matrix[slots[b : min(b + 4096, at + n)]], axis=0), out=out[i])
        at += n
    return out


def sketches(signature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lowest bit of each coordinate, in two words."""
    words = np.packbits((signature & 1).astype(np.uint8), axis=1).view(">u8").astype(np.int64)
    return words[:, 0], words[:, 1]


def differing_bits(likeness: float, slack: float = 0.2) -> int:
    """The most bits in which the sketches of a pair worth verifying may differ.

    A bit differs with probability (1 - likeness) / 2; the slack is over 2.5 standard deviations at
    a likeness of 0.6 and more above it.
    """
    return int(WIDTH * (1 - (likeness - slack)) / 2)


def near(a1: np.ndarray, a2: np.ndarray, b1: np.ndarray, b2: np.ndarray, most: int) -> np.ndarray:
    return np.bitwise_count((a1 ^ b1).view(np.uint64)) + np.bitwise_count((a2 ^ b2).view(np.uint64)) <= most


def band_keys(signature: np.ndarray, owners: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """int32 keys (documents x bands) of successive groups of coordinates, apart for each owner."""
    out = np.empty((len(signature), bands), np.int32)
    for band in range(bands):
        x = owners ^ np.uint64((band + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        for value in signature[:, band * rows : band * rows + rows].T:
            x = _mix(x + value.astype(np.uint64) + np.uint64(1))
        out[:, band] = (x >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return out


def owner_hash(owners: list[str]) -> np.ndarray:
    known: dict[str, int] = {}
    out = np.empty(len(owners), np.uint64)
    for i, owner in enumerate(owners):
        if owner not in known:
            known[owner] = int.from_bytes(blake2b(owner.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        out[i] = known[owner]
    return out


def digests(parts: list[bytes]) -> np.ndarray:
    """Two 64-bit words of a digest of each part."""
    return np.frombuffer(b"".join(blake2b(x, digest_size=16).digest() for x in parts), np.int64).reshape(-1, 2)


def batches_of_cores(batches: Iterator[pa.RecordBatch], most: int = 8_000_000) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Batches, without the rows whose text is null or too short, and their cores.

    The first column is the text. A batch with very long texts is cut so that the working arrays
    stay bounded.
    """
    core = transducer().core
    for batch in batches:
        cores = [core(x) if x is not None else "" for x in batch.column(0).to_pylist()]
        kept = [i for i, x in enumerate(cores) if len(x) >= MIN_CORE]
        piece, size = [], 0
        for i in kept:
            if piece and size + len(cores[i]) > most:
                yield batch.take(pa.array(piece)), [cores[j] for j in piece]
                piece, size = [], 0
            piece.append(i)
            size += len(cores[i])
        if piece:
            yield batch.take(pa.array(piece)), [cores[j] for j in piece]


def likeness_of(a: str, b: str) -> float:
    """Exact likeness of two cores."""
    x, y = ({s[i : i + GRAM] for i in range(len(s) - GRAM + 1)} for s in (a, b))
    both = len(x & y)
    return both / (len(x) + len(y) - both) if x or y else 0.0


def _maps(cores: list[str]) -> np.ndarray:
    """For each core a bit for each of MAP classes of runs, set if a run of it is in that class."""
    out, start = np.zeros((len(cores), MAP // 64), np.uint64), 0
    while start < len(cores):
        end = size = 0
        # blocks of bounded size
        for end in range(start, min(start + 2048, len(cores))):
            size += len(cores[end])
            if size > 4_000_000:
                break
        block = [i for i in range(start, end + 1) if len(cores[i]) >= GRAM]
        if block:
            slots, counts = gram_slots([cores[i] for i in block])
            flags = np.zeros((len(block), MAP), bool)
            flags[np.repeat(np.arange(len(block)), counts), slots % MAP] = True
            out[block] = np.packbits(flags, axis=1).view(np.uint64)
        start = end + 1
    return out


def _may_be_alike(cores: list[str], i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
    """Whether the pairs of cores i and j can have that likeness: never False for one that has it.

    A class of runs that only one core has holds a run that only it has, so with p and q such classes
    of the two, and at most n and m runs, at most k = min(n - p, m - q) runs are in both, and the
    likeness is at most k / (k + p + q).
    """
    maps, runs = _maps(cores), np.array([max(len(x) - GRAM + 1, 0) for x in cores], np.int64)
    out = np.zeros(len(i), bool)
    for at in range(0, len(i), 8192):
        a, b = i[at : at + 8192], j[at : at + 8192]
        p = np.bitwise_count(maps[a] & ~maps[b]).sum(axis=1, dtype=np.int64)
        q = np.bitwise_count(maps[b] & ~maps[a]).sum(axis=1, dtype=np.int64)
        k = np.minimum(runs[a] - p, runs[b] - q)
        out[at : at + 8192] = (k > 0) & (k / np.maximum(k + p + q, 1) >= least)
    return out


def verified(pairs: DataFrame, left: DataFrame, right: DataFrame, least: float, cores: bool = True) -> DataFrame:
    """The pairs (a, b, ...) whose exact likeness is at least ``least``.

    left has (a, text) and right (b, text) of both ends, their cores or, without ``cores``, the texts as
    they are; of a repeated id any row serves, since such rows are one record. Hot ends are split by
    the adaptive skew join.
    """
    ends = (df.toDF(k, f"text_{k}") for k, df in (("a", left), ("b", right)))
    texts = pairs.join(next(ends), "a").join(next(ends), "b").select(*pairs.columns, "text_a", "text_b")
    n = len(pairs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, set[str]] = {}
        core = str if cores else transducer().core

        def grams(i: int) -> set[str]:
            if i not in known:
                if len(known) >= 2048:
                    known.clear()
                s = read[i]
                known[i] = {s[j : j + GRAM] for j in range(len(s) - GRAM + 1)}
            return known[i]

        for batch in batches:
            # each text of a batch is read once, however many pairs it is in
            x, y = (batch.column(i).dictionary_encode() for i in (n, n + 1))
            read = [core(t) for t in x.dictionary.to_pylist() + y.dictionary.to_pylist()]
            i, j = x.indices.to_numpy(), y.indices.to_numpy() + len(x.dictionary)
            known.clear()
            good = _may_be_alike(read, i, j, least)
            for k in np.flatnonzero(good).tolist():
                p, q = grams(int(i[k])), grams(int(j[k]))
                both = len(p & q)
                good[k] = both / (len(p) + len(q) - both) >= least
            yield batch.select(range(n)).filter(pa.array(good))

    return texts.mapInArrow(run, ", ".join(f"{c} {kind}" for c, kind in pairs.dtypes))
