"""Product codes of vectors: codebooks fitted in integers, and every vector written as its nearest entries' indexes.

A component x is the integer floor(scale * x); a vector is cut into equal consecutive parts, each with a codebook of its
own. Distances are compared after an integer Walsh-Hadamard transform of the parts and entries, padded with zeros to a
power of two, P: the transform keeps squared distances up to the factor P, and in sequency order most of a difference
comes first. So squared differences are added up coefficient by coefficient, and an entry goes as soon as its sum is above
the whole distance of one that is known; those left at the end are compared exactly, ties going to the lower index. No
floating point: 64-bit integers where a batch's values allow it, Python's integers otherwise.

A round is one narrow map over the vectors, whose tasks send only a sum and a count for each part, entry and position;
these few thousand numbers, whatever the table's size, make the next codebooks.

Edge cases: vectors that are null or hold a null or non-finite component take no part; shorter vectors count as filled up
with zeros to the longest, and the longest to a multiple of the parts; repeated ids are vectors of their own, the first
entries being taken by id, then components, ids that are null last; fewer vectors than entries give fewer entries; an
empty table gives no rows; null labels are one label; an error that no long holds is null. Only the columns named are read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxledger.llm.common import cut

#: Bits of the limbs that sums leave a task in: exact however large they are.
LIMB = 40
LONG = 1 << 63


def sound(vector: Column) -> Column:
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def whole_numbers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) exactly; objects where 64 bits might not do. ``scale`` is a power of two."""
    if np.abs(x).max(initial=0) < 2**44 / scale:
        return np.floor(x * scale).astype(np.int64)
    exact = [int(v) * scale if abs(v) >= 2**53 else math.floor(v * scale) for v in x.ravel().tolist()]
    return np.array(exact, dtype=object).reshape(x.shape)


def sequency(n: int) -> np.ndarray:
    """Order of the coefficients of a transform of n = 2^k values by their sign changes: bits reversed, Gray code undone."""
    bits = n.bit_length() - 1
    order = np.empty(n, np.int64)
    for i in range(n):
        gray = i ^ (i >> 1)
        order[i] = int(f"{gray:0{bits}b}"[::-1], 2) if bits else 0
    return order


def walsh(x: np.ndarray) -> np.ndarray:
    """Integer Walsh-Hadamard transform of the rows of x, padded with zeros to a power of two, in sequency order."""
    n, width = x.shape
    size = 1 << max(0, width - 1).bit_length()
    out = np.zeros((n, size), x.dtype)
    out[:, :width] = x
    step = 1
    while step < size:
        pairs = out.reshape(n, size // (2 * step), 2, step)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, size)
        step *= 2
    return out[:, sequency(size)]


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Index of each row's nearest entry, the lower of equals, its squared distance, and how many squared differences were
    added up."""
    n, width = parts.shape
    if not width or not len(entries):
        return np.zeros(n, np.int64), np.zeros(n, np.int64), 0
    size = 1 << (width - 1).bit_length()
    most = max([1, *(int(np.abs(x).max()) for x in (parts, entries) if x.size)])
    kind = np.int64 if 4 * size**3 * most * most < LONG else object
    t, e = walsh(parts.astype(kind)), walsh(entries.astype(kind))
    so_far = (t[:, :1] - e[:, 0]) ** 2
    guess = so_far.argmin(axis=1)
    bound = ((t - e[guess]) ** 2).sum(axis=1)
    rows, at = np.nonzero(so_far <= bound[:, None])
    so_far, added = so_far[rows, at], n * (len(e) + size)
    for i in range(1, size):
        so_far = so_far + (t[rows, i] - e[at, i]) ** 2
        added += len(rows)
        left = np.flatnonzero(so_far <= bound[rows])
        rows, at, so_far = rows[left], at[left], so_far[left]
    best = bound.copy()
    np.minimum.at(best, rows, so_far)
    final = np.flatnonzero(so_far == best[rows])[::-1]  # the lowest index is written last
    codes = np.zeros(n, np.int64)
    codes[rows[final]] = at[final]
    return codes, best // size, added


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows, shorter ones filled up with zeros."""
    values, ends = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.diff(column.offsets.to_numpy())
    if (ends == width).all():
        return values.reshape(len(column), width)
    out = np.zeros((len(column), width))
    out[np.arange(width) < ends[:, None]] = values
    return out


def limbs(x: int) -> list[tuple[int, int]]:
    """``(k, v)`` whose v * 2^(LIMB k) add up to x."""
    out, k = [], 0
    while not -(1 << LIMB) < x < 1 << LIMB:
        out.append((k, x & ((1 << LIMB) - 1)))
        x >>= LIMB
        k += 1
    return [*out, (k, x)]


class Codebooks:
    """Entries of each part, as lists of whole numbers."""

    def __init__(self, entries: list[list[list[int]]]):
        self.entries = entries

    def arrays(self) -> list[np.ndarray]:
        small = all(abs(v) < 2**62 for part in self.entries for entry in part for v in entry)
        return [np.array(part, dtype=np.int64 if small else object).reshape(len(part), len(part[0]) if part else 0) for part in self.entries]

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(v) for part in self.entries for entry in part for v in entry).encode()).hexdigest()


def fit(vectors: DataFrame, n_parts: int = 8, n_entries: int = 16, rounds: int = 6, scale: int = 4096) -> tuple[Codebooks, int]:
    """Codebooks for ``vectors(_id, _v)``, and the number of components of a whole vector. ``vectors`` is read once a
    round: cut its lineage before."""
    width = vectors.agg(F.max(F.size("_v"))).first()[0] or 0
    width = -(-width // n_parts) * n_parts
    each = width // n_parts
    first = [r["_v"] for r in vectors.orderBy(F.asc_nulls_last("_id"), "_v").select("_v").limit(n_entries).collect()]
    start = whole_numbers(np.array([[*v, *[0.0] * (width - len(v))] for v in first]).reshape(len(first), width), scale).tolist()
    books = Codebooks([[v[m * each : (m + 1) * each] for v in start] for m in range(n_parts)])
    for _ in range(rounds if first and each else 0):
        books = Codebooks(improved(vectors, books, width, scale))
    return books, width


def improved(vectors: DataFrame, books: Codebooks, width: int, scale: int) -> list[list[list[int]]]:
    """Entries replaced by the floored means of the parts nearest to them; unused ones stay."""
    held, each = books.entries, width // len(books.entries)

    def sums(batches):
        arrays = books.arrays()
        totals = [np.zeros(a.shape, object) for a in arrays]
        counts = [np.zeros(len(a), np.int64) for a in arrays]
        for batch in batches:
            x = whole_numbers(matrix(batch.column(0), width), scale)
            for m, book in enumerate(arrays):
                part = x[:, m * each : (m + 1) * each]
                codes, _, _ = nearest(part, book)
                counts[m] += np.bincount(codes, minlength=len(book))
                own = np.zeros(book.shape, x.dtype)
                np.add.at(own, codes, part)  # a batch's sums of 44-bit numbers fit 64 bits
                totals[m] += own
        used = [(m, e) for m, n in enumerate(counts) for e in np.flatnonzero(n).tolist()]
        rows = [(m, e, each, 0, int(counts[m][e])) for m, e in used] + [(m, e, p, k, v) for m, e in used for p in range(each) for k, v in limbs(int(totals[m][e, p]))]
        columns = zip(*rows) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["part", "entry", "position", "limb", "total"])

    partial = vectors.select("_v").mapInArrow(sums, "part long, entry long, position long, limb long, total long")
    summed: dict[tuple[int, int, int], int] = {}
    for r in partial.groupBy("part", "entry", "position", "limb").agg(F.sum("total").alias("total")).collect():  # as many rows as the codebooks have numbers
        key = r["part"], r["entry"], r["position"]
        summed[key] = summed.get(key, 0) + (r["total"] << (LIMB * r["limb"]))
    count = lambda m, e: summed.get((m, e, each), 0)  # noqa: E731  it stands after the positions
    return [[[summed[m, e, p] // count(m, e) for p in range(each)] if count(m, e) else entry for e, entry in enumerate(part)] for m, part in enumerate(held)]


def coded(vectors: DataFrame, books: Codebooks, width: int, scale: int = 4096) -> DataFrame:
    """``_id, _label, code, error`` of ``vectors(_id, _label, _v)``: two hex digits for each part's nearest entry, and the
    squared distances added up. A narrow map."""
    each = width // len(books.entries)
    names = ["_id", "_label", "code", "error"]
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}

    def run(batches):
        arrays = books.arrays()
        for batch in batches:
            x = whole_numbers(matrix(batch.column(2), width), scale)
            found = [nearest(x[:, m * each : (m + 1) * each], book)[:2] for m, book in enumerate(arrays)]
            code = ["".join(f"{c:02x}" for c in row) for row in zip(*(codes.tolist() for codes, _ in found))]
            error = [sum(row) for row in zip(*(d.tolist() for _, d in found))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array([v if v < LONG else None for v in error], pa.int64())], names=names)

    return vectors.select("_id", "_label", "_v").mapInArrow(run, f"_id {kinds['_id']}, _label {kinds['_label']}, code string, error long")


def compress(vectors: DataFrame, n_parts: int = 8, n_entries: int = 16, rounds: int = 6, scale: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``id_col, code, error, label_error, codebooks_sha256`` of every sound vector: its code, its squared distance from
    what the code stands for, those distances summed over the vectors of its label, and the digest of the codebooks."""
    if scale < 1 or scale & (scale - 1) or not 1 <= n_entries <= 256:
        raise ValueError("scale must be a power of two, and codes of two hex digits have 256 entries at most")
    kept = cut(vectors.where(sound(F.col(vector_col))).select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label"), F.col(vector_col).cast("array<double>").alias("_v")))
    books, width = fit(kept, n_parts, n_entries, rounds, scale)
    rows = cut(coded(kept, books, width, scale))
    whole = F.when(F.count_if(F.col("error").isNull()) == 0, F.sum(F.col("error").cast("decimal(38,0)"))).try_cast("long")
    by_label = rows.groupBy(F.col("_label").alias("_same")).agg(whole.alias("label_error"))
    return rows.join(by_label, F.col("_label").eqNullSafe(F.col("_same"))).select(F.col("_id").alias(id_col), "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
