"""GeoTIFF rasters from binary files: headers, windows of bands and review masks as runs. Baseline TIFF: strips or tiles, chunky or planar, without
compression or with Deflate, PackBits or LZW, unsigned 8, 16 and 32 bit and floating samples; classic and big files."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .config import CodedError

# TIFF tags and type sizes.
WIDTH, HEIGHT, BITS, COMPRESSION, STRIP_AT, SAMPLES, ROWS, STRIP_SIZE, PLANAR, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317
TILE_W, TILE_H, TILE_AT, TILE_SIZE, SCALE, TIEPOINT, MATRIX, GEO_KEYS, FORMAT = 322, 323, 324, 325, 33550, 33922, 34264, 34735, 339
_SIZE = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 11: "f", 12: "d", 16: "Q"}


@dataclass
class Tiff:
    """An opened file's tags, and its bytes: all of them, or anything else that gives ranges of them by slicing."""

    data: bytes
    order: str = "<"
    tags: dict[int, tuple] = field(default_factory=dict)

    def __post_init__(self):
        if self.data[:2] not in (b"II", b"MM"):
            raise CodedError("VL-1201", "not a TIFF file")
        self.order = "<" if self.data[:2] == b"II" else ">"
        take = lambda fmt, at: struct.unpack(fmt, self.data[at : at + struct.calcsize(fmt)])
        (magic,) = take(self.order + "H", 2)
        if magic not in (42, 43):
            raise CodedError("VL-1201", f"unsupported TIFF version {magic}")
        # big files have wider numbers: of entries, of an entry's values, and of places
        number, place, step = ("H", "I", 12) if magic == 42 else ("Q", "Q", 20)
        (at,) = take(self.order + place, 4 if magic == 42 else 8)
        (n,) = take(self.order + number, at)
        first = at + struct.calcsize(number)
        for i in range(n):
            tag, kind = take(self.order + "HH", first + step * i)
            (count,) = take(self.order + place, first + step * i + 4)
            if kind not in _SIZE:
                continue
            fmt = self.order + _SIZE[kind] * count
            where = first + step * i + 4 + struct.calcsize(place)
            if struct.calcsize(fmt) > struct.calcsize(place):
                (where,) = take(self.order + place, where)
            self.tags[tag] = take(fmt, where)

    def one(self, tag: int, default=None):
        return self.tags.get(tag, (default,))[0]

    @property
    def meta(self) -> dict:
        """width, height, bands, dtype, crs and the affine terms a to f."""
        if MATRIX in self.tags:
            m = self.tags[MATRIX]
            a, b, c, d, e, f = m[0], m[1], m[3], m[4], m[5], m[7]
        else:
            sx, sy = self.tags.get(SCALE, (1.0, 1.0))[:2]
            px, py, _, x, y = self.tags.get(TIEPOINT, (0.0,) * 6)[:5]
            a, b, c, d, e, f = sx, 0.0, x - px * sx, 0.0, -sy, y + py * sy
        kind = {1: "uint", 2: "int", 3: "float"}[self.one(FORMAT, 1)]
        keys = self.tags.get(GEO_KEYS, ())
        codes = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
        epsg = codes.get(3072, codes.get(2048))
        return {"width": self.one(WIDTH), "height": self.one(HEIGHT), "bands": self.one(SAMPLES, 1), "dtype": f"{kind}{self.one(BITS, 8)}", "crs": f"EPSG:{epsg}" if epsg else "", "a": float(a), "b": float(b), "c": float(c), "d": float(d), "e": float(e), "f": float(f)}

    def blocks(self) -> list[tuple[int, int, int, int, int]]:
        """x0, y0, x1, y1 of each strip or tile, row by row, and how many bytes it has in the file."""
        m, tiled = self.meta, TILE_AT in self.tags
        w, h = m["width"], m["height"]
        bw, bh = (self.one(TILE_W), self.one(TILE_H)) if tiled else (w, min(h, self.one(ROWS, h)))
        across, down = -(-w // bw), -(-h // bh)
        size = self.tags[TILE_SIZE if tiled else STRIP_SIZE]
        planes = len(size) // (across * down)
        return [(x * bw, y * bh, min(w, x * bw + bw), min(h, y * bh + bh), sum(size[p * across * down + y * across + x] for p in range(planes))) for y in range(down) for x in range(across)]

    def _block(self, at: int, size: int) -> bytes:
        raw, how = self.data[at : at + size], self.one(COMPRESSION, 1)
        if how == 1:
            return raw
        if how in (8, 32946):
            return zlib.decompress(raw)
        if how == 5:
            return _lzw(raw)
        if how == 32773:
            out, i = bytearray(), 0
            while i < len(raw):
                n = raw[i]
                if n < 128:
                    out += raw[i + 1 : i + 2 + n]
                    i += n + 2
                else:
                    out += raw[i + 1 : i + 2] * (257 - n if n > 128 else 0)
                    i += 2 if n > 128 else 1
            return bytes(out)
        raise CodedError("VL-1201", f"unsupported compression {how}")

    def read(self, bands: list[int], box: tuple[int, int, int, int] | None = None) -> np.ndarray:
        """Bands (from 1) of a window, clamped to the raster and one pixel at least, as height x width x bands. Only blocks that the window meets are decoded."""
        m = self.meta
        w, h, n = m["width"], m["height"], m["bands"]
        x0, y0, x1, y1 = box or (0, 0, w, h)
        x0, y0 = min(max(0, x0), w - 1), min(max(0, y0), h - 1)
        x1, y1 = max(x0 + 1, min(w, x1)), max(y0 + 1, min(h, y1))
        kind = np.dtype(m["dtype"]).newbyteorder(self.order)
        planar = self.one(PLANAR, 1) == 2
        tiled = TILE_AT in self.tags
        bw, bh = (self.one(TILE_W), self.one(TILE_H)) if tiled else (w, min(h, self.one(ROWS, h)))
        at, size = self.tags[TILE_AT if tiled else STRIP_AT], self.tags[TILE_SIZE if tiled else STRIP_SIZE]
        across, down = -(-w // bw), -(-h // bh)
        out = np.zeros((y1 - y0, x1 - x0, len(bands)), kind.newbyteorder("="))
        for by in range(y0 // bh, (y1 - 1) // bh + 1):
            for bx in range(x0 // bw, (x1 - 1) // bw + 1):
                high = bh if tiled else min(bh, h - by * bh)
                for plane in sorted({b - 1 for b in bands}) if planar else [None]:
                    k = by * across + bx + (plane or 0) * across * down
                    px = np.frombuffer(self._block(at[k], size[k]), kind)[: high * bw * (1 if planar else n)].reshape(high, bw, -1)
                    if self.one(PREDICTOR, 1) == 2:
                        px = np.cumsum(px, axis=1, dtype=kind.newbyteorder("="))
                    ys, xs = slice(max(y0, by * bh), min(y1, by * bh + high)), slice(max(x0, bx * bw), min(x1, bx * bw + bw))
                    part = px[ys.start - by * bh : ys.stop - by * bh, xs.start - bx * bw : xs.stop - bx * bw]
                    for i, b in enumerate(bands):
                        if not planar or b - 1 == plane:
                            out[ys.start - y0 : ys.stop - y0, xs.start - x0 : xs.stop - x0, i] = part[:, :, 0 if planar else b - 1]
        return out


def _lzw(raw: bytes) -> bytes:
    """LZW as TIFF has it: codes from the high bit on, of 9 bits at first; 256 empties the table, 257 ends; codes widen one entry early."""
    out = bytearray()
    table: list[bytes] = []
    width, held, bits, last = 9, 0, 0, b""
    for byte in raw:
        held, bits = held << 8 | byte, bits + 8
        while bits >= width:
            code = held >> (bits - width) & ((1 << width) - 1)
            bits -= width
            held &= (1 << bits) - 1
            if code == 257:
                return bytes(out)
            if code == 256:
                table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
                continue
            word = table[code] if code < len(table) else last + last[:1]
            if last:
                table.append(last + word[:1])
                if len(table) + 1 in (512, 1024, 2048):
                    width += 1
            out += word
            last = word
    return bytes(out)


def files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path and content of binary files."""
    return spark.read.format("binaryFile").load(paths).select("path", "content")


def raster_meta(df: DataFrame) -> DataFrame:
    """path and header of each file."""
    names = "width height bands dtype crs a b c d e f".split()

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_pandas(pd.DataFrame([{"path": p, **Tiff(c).meta} for p, c in zip(b["path"].to_pylist(), b["content"].to_pylist(), strict=True)])[["path", *names]], preserve_index=False)

    return df.mapInArrow(run, "path string, width long, height long, bands long, dtype string, crs string, a double, b double, c double, d double, e double, f double")


def windows(df: DataFrame, tiles: DataFrame, bands: list[int]) -> DataFrame:
    """path, tile_index, height, width, pixels of each file's tiles (path, tile_index, x0, y0, x1, y1): the bands of the window, row by row, as single precision numbers.
    A file travels once, with the list of its tiles; of the file only the blocks that a window meets are decoded."""
    from pyspark.sql import functions as F

    listed = tiles.groupBy("path").agg(F.collect_list(F.struct("tile_index", "x0", "y0", "x1", "y1")).alias("tiles"))

    def run(batches):
        for b in batches:
            for path, content, boxes in zip(b["path"].to_pylist(), b["content"].to_pylist(), b["tiles"].to_pylist(), strict=True):
                opened = Tiff(content)
                for t in boxes:
                    px = opened.read(bands, (t["x0"], t["y0"], t["x1"], t["y1"])).astype("<f4")
                    yield pa.RecordBatch.from_pydict({"path": [path], "tile_index": pa.array([t["tile_index"]], pa.int64()), "height": pa.array([px.shape[0]], pa.int64()), "width": pa.array([px.shape[1]], pa.int64()), "pixels": pa.array([px.tobytes()], pa.binary())})

    return df.join(listed, "path").mapInArrow(run, "path string, tile_index long, height long, width long, pixels binary")


def mask_runs(df: DataFrame, threshold: int = 127) -> DataFrame:
    """path, y, x0, x1: runs of pixels of band 1 above the threshold, so a mask costs rows by its outline and not by its area."""

    def run(batches):
        for b in batches:
            for p, c in zip(b["path"].to_pylist(), b["content"].to_pylist(), strict=True):
                on = np.pad((Tiff(c).read([1])[:, :, 0] > threshold).astype(np.int8), ((0, 0), (1, 1)))
                step = np.diff(on, axis=1)
                y, x0 = np.nonzero(step == 1)
                _, x1 = np.nonzero(step == -1)
                yield pa.RecordBatch.from_pydict({"path": pa.array([p] * len(y), pa.string()), "y": pa.array(y, pa.int64()), "x0": pa.array(x0, pa.int64()), "x1": pa.array(x1, pa.int64())})

    return df.mapInArrow(run, "path string, y long, x0 long, x1 long")


def blocks(runs: DataFrame) -> DataFrame:
    """Runs as the one pixel high blocks that mask operators take."""
    return runs.selectExpr("path AS sample_id", "x0", "y AS y0", "x1", "y + 1 AS y1")
