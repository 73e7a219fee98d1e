"""Image geometry, perceptual hashes and 64-bit text fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# Patch geometry and pixel budget.
PATCH, MERGE = 14, 2
FACTOR = PATCH * MERGE
MIN_PIXELS, MAX_PIXELS = 3136, 1003520


def smart_resize(height: Column, width: Column) -> Column:
    """struct<h, w> rounded to multiples of 28 inside the pixel budget; NULL for images below 28."""
    f = F.lit(float(FACTOR))
    h, w = height.cast("double"), width.cast("double")
    h0 = F.greatest(f, F.rint(h / f) * f)
    w0 = F.greatest(f, F.rint(w / f) * f)
    shrink = F.sqrt(h * w / F.lit(float(MAX_PIXELS)))
    grow = F.sqrt(F.lit(float(MIN_PIXELS)) / (h * w))
    too_big, too_small = h0 * w0 > MAX_PIXELS, h0 * w0 < MIN_PIXELS

    def side(x: Column, x0: Column) -> Column:
        return (F.when(too_big, F.greatest(f, F.floor(x / shrink / f) * f))
                .when(too_small, F.ceil(x * grow / f) * f).otherwise(x0)).cast("int")

    return F.when((height >= FACTOR) & (width >= FACTOR), F.struct(side(h, h0).alias("h"), side(w, w0).alias("w")))


def visual_tokens(height: Column, width: Column) -> Column:
    """struct<tokens, grid_h, grid_w>."""
    s = smart_resize(height, width)
    gh, gw = F.floor(s["h"] / PATCH).cast("int"), F.floor(s["w"] / PATCH).cast("int")
    tokens = (F.floor(gh / MERGE) * F.floor(gw / MERGE)).cast("int")
    return F.when(s.isNotNull(), F.struct(tokens.alias("tokens"), gh.alias("grid_h"), gw.alias("grid_w")))


def length_bucket(tokens: Column, n_buckets: int = 5, full: int = 1280) -> Column:
    return F.greatest(F.lit(0), F.least(F.floor(tokens / F.lit(full / n_buckets)), F.lit(n_buckets - 1))).cast("int")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def sign_fingerprint(vec: Column, dims: int = 64) -> Column:
    """Bit i set when component i is positive; signed 64-bit."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(dims - 1)), F.lit(0).cast("long"),
                       lambda acc, i: F.when(F.get(vec, i) > 0, acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
                       .otherwise(acc))


def _dct_matrix(n: int) -> np.ndarray:
    k, x = np.arange(n)[:, None], np.arange(n)[None, :]
    m = np.cos(np.pi * (2 * x + 1) * k / (2 * n)) * np.sqrt(2.0 / n)
    m[0] /= np.sqrt(2.0)
    return m


def phash_batch(frames: np.ndarray) -> np.ndarray:
    """64-bit hashes of a (rows, 32, 32) stack of grey frames."""
    d = _dct_matrix(32)[:8]
    low = np.einsum("ux,bxy,vy->buv", d, frames, d).reshape(len(frames), 64)
    bits = low > np.median(low[:, 1:], axis=1)[:, None]
    packed = np.packbits(bits, axis=1)
    return packed.view(">u8").reshape(-1).astype(np.uint64).view(np.int64)


def _nullable_longs(values: list[int | None], index: pd.Index) -> pd.Series:
    """64-bit integers with NULLs, without a detour through floating point."""
    mask = np.array([v is None for v in values], dtype=bool)
    data = np.array([0 if v is None else v for v in values], dtype=np.int64)
    return pd.Series(pd.arrays.IntegerArray(data, mask), index=index)


@F.pandas_udf(T.LongType())
def phash64(gray: pd.Series) -> pd.Series:
    """Perceptual hash of 1024 grey values; NULL where there is no usable frame."""
    ok = gray.map(lambda g: g is not None and len(g) == 1024)
    out: list[int | None] = [None] * len(gray)
    if ok.any():
        stack = np.stack(gray[ok].to_list()).astype(np.float64).reshape(-1, 32, 32)
        for at, v in zip(np.flatnonzero(ok.to_numpy()), phash_batch(stack)):
            out[at] = int(v)
    return _nullable_longs(out, gray.index)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def collage_lines(gray: pd.Series) -> pd.Series:
    """Positions of strong straight edges in a square grey frame; two or more mean a collage."""
    def one(g) -> list[int]:
        side = int(np.sqrt(len(g)))
        a = np.asarray(g, dtype=np.float64).reshape(side, side)
        lines: list[int] = []
        for grad in (np.abs(np.diff(a, axis=1)).mean(axis=0), np.abs(np.diff(a, axis=0)).mean(axis=1)):
            lines += np.flatnonzero(grad > grad.mean() + 3 * grad.std()).tolist()
        return sorted(lines)

    return gray.map(lambda g: None if g is None else one(g))


# ---- text fingerprints ----

# Two independent linear hashes of five code points modulo the largest primes below 2**32; all intermediate values stay
# below 2**63, so the same numbers come out of numpy, Spark and SQL engines.
P_HI, P_LO = 4294967291, 4294967279
A_HI = (2654435761, 2246822519, 3266489917, 668265263, 374761393)
A_LO = (2166136261, 3432918353, 461845907, 3864292196, 1540483477)


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)


def gram_halves(text: str) -> tuple[np.ndarray, np.ndarray]:
    """High and low 32-bit hashes of the distinct 5-grams of ``text``."""
    cp = _code_points(text)
    n = len(cp) - 4
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hi = sum(cp[i:i + n] * A_HI[i] for i in range(5)) % P_HI
    lo = sum(cp[i:i + n] * A_LO[i] for i in range(5)) % P_LO
    key = np.sort((hi.astype(np.uint64) << np.uint64(32)) | lo.astype(np.uint64))
    key = key[np.append(True, key[1:] != key[:-1])]
    return (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _simhash(text: str) -> int | None:
    hi, lo = gram_halves(text)
    if not len(hi):
        return None
    halves = np.concatenate([hi.astype(">u4").view(np.uint8).reshape(-1, 4),
                             lo.astype(">u4").view(np.uint8).reshape(-1, 4)], axis=1)
    ones = np.unpackbits(halves, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hi)).view(">u8")[0].astype(np.uint64).view(np.int64))


@F.pandas_udf(T.LongType())
def simhash64(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """64-bit fingerprint of the whole text from its distinct 5-grams; NULL below five characters."""
    for s in it:
        yield _nullable_longs([None if t is None else _simhash(t) for t in s], s.index)


# ---- n-gram sets for the similarity join ----

def _rolling(cp: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n code points from every position on."""
    m = max(0, len(cp) - n + 1)
    h = np.zeros(m, np.uint64)
    if n <= 3:
        for i in range(n):
            h = (h << np.uint64(21)) | cp[i:i + m]
    else:
        with np.errstate(over="ignore"):
            for i in range(n):
                h = (h ^ cp[i:i + m]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
    return h


def text_grams(text: str, n: int) -> np.ndarray:
    """64-bit hashes of the character n-grams in their order, repeats included. Up to three code points are packed without loss."""
    return _rolling(_code_points(text.strip()).astype(np.uint64), n).view(np.int64)


def gram_hashes(text: str, n: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct character n-grams."""
    h = np.sort(text_grams(text, n))  # a fifth of the time of np.unique, which hashes them first
    return h[np.append(True, h[1:] != h[:-1])[:len(h)]]


def all_grams(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, hash) of all n-grams of many texts, repeats included."""
    texts = [x.strip() for x in texts]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    h = _rolling(_code_points("".join(texts)).astype(np.uint64), n)
    owner, ends = np.repeat(np.arange(len(texts)), sizes)[:len(h)], np.cumsum(sizes)
    inside = np.arange(len(h)) + n <= ends[owner]
    return owner[inside], h[inside].view(np.int64)
