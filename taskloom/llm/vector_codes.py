"""Vectors as short codes: each part of a vector by its nearest entry in a codebook of that part.

Distances are compared in the Walsh-Hadamard domain. A transform of size L multiplies squared distances by L and is all
sums and differences, so integers stay exact. Most of a distance shows in the coefficients of few sign changes, which
come first; an entry whose sum so far exceeds the whole distance of a likely one is dropped there.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import materialize
from .vectors import matrix, padded, scaled, shape, usable

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
FIRST = 2


def compress_vectors(
    rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) for each row with a usable vector, and the codebooks by part, entry and position.

    A vector that is null or has null or non-finite components is dropped; other columns may be null and extra ones are
    ignored. Shorter vectors, empty ones included, count as followed by zeros, and so is every vector up to a multiple
    of ``parts``. Codebooks start from the ``entries`` smallest ids (null ids last, equal ids by vector; fewer rows give
    fewer entries) and are refined ``rounds`` times over all rows; only sums for each entry leave the tasks. Equal rows
    get equal codes. ``error`` is the integer squared distance, ``code`` an array of entry numbers.
    """
    kept = rows.filter(usable()).select("vec_id", "label", scaled(scale).alias("v"))
    kept = materialize(kept, "vectors")
    n, size, most = shape(kept, "v")
    length = max(1, -(-size // parts))
    check_range(length, most)
    kept = kept.withColumn("v", padded("v", length * parts))
    first = kept.select("v").orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()
    books = np.array([r.v for r in first], dtype=np.int64).reshape(len(first), parts, length).transpose(1, 0, 2)
    for _ in range(rounds if n else 0):
        books = _refined(kept, books)
    return kept.mapInArrow(_coding(books), "vec_id long, label long, code array<int>, error long"), books


def check_range(length: int, most: int) -> None:
    """Twice the largest component, squared, times the transform's size and scale must fit in 63 bits."""
    if (2 * int(most)) ** 2 * padded_size(length) ** 2 >= 2**63:
        raise ValueError("components are too large for exact 64-bit distances")


def books_text(books: np.ndarray) -> str:
    return ",".join(map(str, books.reshape(-1).tolist()))


def with_label_errors(codes: DataFrame) -> DataFrame:
    """Adds the error of all rows of the same label, those without a label together."""
    codes = materialize(codes, "codes")
    totals = codes.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return codes.join(totals, codes.label.eqNullSafe(totals._label)).drop("_label")


def padded_size(length: int) -> int:
    return 1 << (length - 1).bit_length()


def transform(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the last axis, zero-padded to a power of two, by growing number of sign changes."""
    size = padded_size(x.shape[-1])
    out = np.zeros((*x.shape[:-1], size), dtype=np.int64)
    out[..., : x.shape[-1]] = x
    half = 1
    while half < size:
        pair = out.reshape(*x.shape[:-1], size // (2 * half), 2, half)
        out = np.concatenate((pair[..., :1, :] + pair[..., 1:, :], pair[..., :1, :] - pair[..., 1:, :]), axis=-2)
        out = out.reshape(*x.shape[:-1], size)
        half *= 2
    return out[..., sequency_order(size)]


def sequency_order(size: int) -> np.ndarray:
    """Natural index of each sequency: the Gray code of the number, its bits reversed."""
    bits = size.bit_length() - 1
    gray = np.arange(size) ^ (np.arange(size) >> 1)
    order = np.zeros(size, dtype=np.int64)
    for b in range(bits):
        order |= ((gray >> b) & 1) << (bits - 1 - b)
    return order


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry, the lower one of equals, and its squared distance times the size.

    Both arguments are transformed. Each row's bound is the whole distance of the entry that leads after the first
    coefficients; pairs beyond it go, with all their later coefficients unread.
    """
    size = x.shape[1]
    sums = ((x[:, None, :FIRST] - book[None, :, :FIRST]) ** 2).sum(axis=2)
    lead = sums.argmin(axis=1)
    bound = ((x - book[lead]) ** 2).sum(axis=1)
    row, entry = np.nonzero(sums <= bound[:, None])
    so_far = sums[row, entry]
    start = FIRST
    while start < size:
        stop = min(size, 2 * start)
        so_far = so_far + ((x[row, start:stop] - book[entry, start:stop]) ** 2).sum(axis=1)
        left = so_far <= bound[row]
        row, entry, so_far = row[left], entry[left], so_far[left]
        start = stop
    whole = np.full(sums.shape, np.iinfo(np.int64).max)
    whole[row, entry] = so_far
    best = whole.argmin(axis=1)
    return best, whole[np.arange(len(x)), best]


def encode(v: np.ndarray, spectra: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows, parts) of vectors (rows, parts, length) and each row's squared error."""
    codes = np.zeros(v.shape[:2], dtype=np.int32)
    errors = np.zeros(len(v), dtype=np.int64)
    for p in range(v.shape[1]):
        codes[:, p], distance = nearest(transform(v[:, p]), spectra[p])
        errors += distance // spectra.shape[2]
    return codes, errors


def _refined(kept: DataFrame, books: np.ndarray) -> np.ndarray:
    parts, entries, length = books.shape
    spectra = transform(books)

    def sums(batches):
        total = np.zeros((parts, entries, length), dtype=np.int64)
        count = np.zeros((parts, entries), dtype=np.int64)
        for batch in batches:
            v = matrix(batch.column("v"), parts * length).reshape(-1, parts, length)
            codes, _ = encode(v, spectra)
            for p in range(parts):
                np.add.at(total[p], codes[:, p], v[:, p])
                count[p] += np.bincount(codes[:, p], minlength=entries)
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_pydict(
            {
                "slot": pa.array((p * entries + e).repeat(length)),
                "position": pa.array(np.tile(np.arange(length), len(p))),
                "total": pa.array(total[p, e].reshape(-1)),
                "n": pa.array(count[p, e].repeat(length)),
            }
        )

    found = kept.select("v").mapInArrow(sums, "slot long, position long, total long, n long")
    found = found.groupBy("slot", "position").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    out = books.copy()
    # One row for each number in the codebooks.
    for r in found.collect():
        out[r.slot // entries, r.slot % entries, r.position] = r.total // r.n
    return out


def _coding(books: np.ndarray):
    parts, entries, length = books.shape
    spectra = transform(books)

    def code(batches):
        for batch in batches:
            v = matrix(batch.column("v"), parts * length).reshape(-1, parts, length)
            codes, errors = encode(v, spectra)
            offsets = pa.array(np.arange(len(v) + 1, dtype=np.int32) * parts)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").cast(pa.int64()),
                    batch.column("label").cast(pa.int64()),
                    pa.ListArray.from_arrays(offsets, pa.array(codes.reshape(-1))),
                    pa.array(errors),
                ],
                names=["vec_id", "label", "code", "error"],
            )

    return code


def code_text(code: str = "code"):
    """Two hex digits for each part."""
    return F.array_join(F.transform(code, lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(books_text(books).encode()).hexdigest()
