"""Vector code compression: product codes of integer vectors, with VA-file filtering of the codebook's entries.

Components become integers, a vector is cut into parts, and each part position has a codebook that grows by rounds of assigning every part to
its nearest entry and of moving each entry to its parts' mean. All of it is integer arithmetic, so results depend on no order of rows.

The nearest entry is found as in a vector-approximation file. The coordinates of a codebook's entries are quantised, in each dimension, into
``2 ** BITS`` cells between the least and the greatest of them. For a part, a lookup table holds the least and the greatest squared distance to each cell of each dimension;
their sums over an entry's cells bound its distance from below and above. Only entries whose lower bound does not exceed the least upper bound are refined by
their integer distance, so the result is exact whatever the cells are.

Vectors stay where they are: a round is one pass in which every task adds up its parts by entry, and what leaves a task is a row for each part
position and entry. The driver holds codebooks only, of fixed size.

Cases: vectors that are null or empty, or hold a null or a component that is not finite, go. The dimension is that of the first vector kept, by vec_id and then by its components;
vectors of another one go, too. If it is no multiple of the number of parts, the first parts have one component more. A null vec_id comes last; rows that repeat a vec_id count each.
Fewer vectors than entries give fewer entries. Components are held between -2**27 and 2**27. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowmap import ROWS, arrow_map
from .skew import hot_keys, join_one
from .storage import Workspace

PARTS, ENTRIES, ROUNDS = 8, 16, 6
SCALE = 4096
#: Bits of a cell's number.
BITS = 3
_FAR = 1 << 27


def _whole(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Places of the vectors that are kept, and their integer components."""
    size = np.asarray(pc.fill_null(pc.list_value_length(column), 0), np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(values))))
    end = np.cumsum(size)
    rows = np.flatnonzero((size > 0) & (bad[end] == bad[end - size]))
    return rows, [np.clip(np.floor(SCALE * values[end[i] - size[i] : end[i]]), -_FAR, _FAR).astype(np.int32) for i in rows]


def _integers(b: pa.RecordBatch) -> dict:
    rows, vectors = _whole(b["embedding"])
    take = pa.array(rows)
    return {"vec_id": b["vec_id"].take(take), "label": b["label"].take(take), "q": pa.array(vectors, pa.list_(pa.int32()))}


def integers(vectors: DataFrame) -> DataFrame:
    """vec_id, label, q (integer components) of the vectors that are kept."""
    return arrow_map(vectors, {c: c for c in ("vec_id", "label", "embedding")}, f"vec_id long, label {vectors.schema['label'].dataType.simpleString()}, q array<int>", _integers)


def cells(book: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a codebook's entries: the cell of each coordinate, and the low and high border of each dimension's cells."""
    low, high = book.min(0), book.max(0)
    edges = low[:, None] + (high - low)[:, None] * np.arange(2**bits + 1) // 2**bits
    return np.stack([np.searchsorted(e[1:-1], x, "right") for e, x in zip(edges, book.T, strict=True)], 1), edges[:, :-1], edges[:, 1:]


def nearest(parts: np.ndarray, book: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each part the nearest entry (of equally near ones the first), its squared distance, and how many entries had to be refined."""
    at, low, high = cells(book, bits)
    v = parts[:, :, None]
    gap_low, gap_high = low - v, v - high
    least = np.maximum(np.maximum(gap_low, gap_high), 0) ** 2
    most = np.maximum(-gap_low, -gap_high) ** 2
    lower, upper = np.zeros((2, len(parts), len(book)), np.int64)
    for d in range(book.shape[1]):
        lower += least[:, d, at[:, d]]
        upper += most[:, d, at[:, d]]
    row, entry = np.nonzero(lower <= upper.min(1, keepdims=True))
    exact = np.full(lower.shape, np.iinfo(np.int64).max)
    exact[row, entry] = ((parts[row] - book[entry]) ** 2).sum(1)
    best = exact.argmin(1)
    return best, exact[np.arange(len(parts)), best], np.bincount(row, minlength=len(parts))


def bounds(dimension: int, parts: int = PARTS) -> list[int]:
    """Where parts begin, and the dimension."""
    return [(dimension // parts) * k + min(k, dimension % parts) for k in range(parts + 1)]


def _matrix(column: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the given dimension, and their components."""
    rows = np.flatnonzero(np.asarray(pc.list_value_length(column)) == dimension)
    values = column.take(pa.array(rows)).flatten().to_numpy().astype(np.int64)
    return rows, values.reshape(len(rows), dimension)


def _sums(books: list[np.ndarray], edge: list[int], wide: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros((len(books), len(books[0])), np.int64), np.zeros((len(books), len(books[0]), wide), np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                _, q = _matrix(batch.slice(start, ROWS)["q"], edge[-1])
                for p, book in enumerate(books):
                    own = q[:, edge[p] : edge[p + 1]]
                    to = nearest(own, book)[0]
                    n[p] += np.bincount(to, minlength=len(book))
                    np.add.at(total[p, :, : own.shape[1]], to, own)
        p, e = np.nonzero(n)
        if len(p):
            yield pa.RecordBatch.from_pydict({"part": pa.array(p.astype(np.int32)), "entry": pa.array(e.astype(np.int32)), "n": pa.array(n[p, e])} | {f"s{d}": pa.array(total[p, e, d]) for d in range(wide)})

    return run


def trained(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """A codebook for each part position; none if there are no vectors."""
    first = kept.orderBy(F.asc_nulls_last("vec_id"), "q").select("q").limit(1).collect()
    if not first or len(first[0]["q"]) < parts:
        return []
    edge = bounds(len(first[0]["q"]), parts)
    start = kept.where(F.size("q") == edge[-1]).orderBy(F.asc_nulls_last("vec_id"), "q").select("q").limit(entries).collect()
    q = np.array([r["q"] for r in start], np.int64)
    books = [q[:, a:b].copy() for a, b in zip(edge, edge[1:], strict=False)]
    wide = max(b.shape[1] for b in books)
    schema = "part int, entry int, n long, " + ", ".join(f"s{d} long" for d in range(wide))
    for _ in range(rounds):
        found = kept.select("q").mapInArrow(_sums(books, edge, wide), schema).groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(f"s{d}").alias(f"s{d}") for d in range(wide)))
        for r in found.collect():  # a row for each part position and entry at most
            books[r["part"]][r["entry"]] = [r[f"s{d}"] // r["n"] for d in range(books[r["part"]].shape[1])]
    return books


def _coded(books: list[np.ndarray], edge: list[int]):
    def kernel(b: pa.RecordBatch) -> dict:
        rows, q = _matrix(b["q"], edge[-1])
        index, error, refined = [], np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
        for p, book in enumerate(books):
            to, far, n = nearest(q[:, edge[p] : edge[p + 1]], book)
            index.append(to.astype(np.uint8))
            error += far
            refined += n
        take = pa.array(rows)
        code = [r.tobytes().hex() for r in np.stack(index, 1)]
        return {"vec_id": b["vec_id"].take(take), "label": b["label"].take(take), "code": pa.array(code, pa.string()), "error": pa.array(error), "refined": pa.array(refined)}

    return kernel


def compressed(vectors: DataFrame, space: Workspace | None = None) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256, and ``refined``: how many integer distances the vector's last assignment took (of parts x entries)."""
    space = space or Workspace(vectors.sparkSession)
    kept = space.written(integers(vectors), "integers")
    books = trained(kept)
    kind = vectors.schema["label"].dataType.simpleString()
    schema = f"vec_id long, label {kind}, code string, error long, refined long"
    if not books:
        return vectors.sparkSession.createDataFrame([], schema).select("vec_id", "code", "error", F.col("error").alias("label_error"), F.col("code").alias("codebooks_sha256"), "refined")
    edge = np.cumsum([0, *(b.shape[1] for b in books)]).tolist()
    done = arrow_map(kept, {c: c for c in ("vec_id", "label", "q")}, schema, _coded(books, edge))
    key = {"_none": F.col("label").isNull(), "_label": F.coalesce(F.col("label").cast("string"), F.lit(""))}
    done = space.written(done.withColumns(key), "codes")
    sums = space.written(done.groupBy(*key).agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "labels")
    told = join_one(done, sums.drop("n"), list(key), hot_keys(sums, list(key)), by=["vec_id", "code"])
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
    return told.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"), "refined")
