"""GeoTIFF files as a data source, a row a block: strips or tiles are planned into partitions, and of a file only its header and the blocks that are asked for are read.

    spark.dataSource.register(GeoTiff)
    spark.read.format("geotiff").option("bands", "1,2,3").load(folder).where("x1 > 100 and x0 < 300 and y1 > 0 and y0 < 200")

Conditions on path, x0, y0, x1 and y1 choose blocks while partitions are planned (with ``spark.sql.python.filterPushdown.enabled``). Files lie where Arrow can read ranges of them; no file passes through one row.
"""

from __future__ import annotations

import fnmatch
import operator
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from .tiff import Tiff

SCHEMA = "path string, block long, x0 long, y0 long, x1 long, y1 long, pixels binary"
#: Bytes at a file's start that are fetched at once, as its header is read in many small parts.
HEAD = 1 << 16


class Ranges:
    """Ranges of a file's bytes by slicing; ``fetched`` counts the bytes that were read."""

    def __init__(self, path: str):
        files, inner = pa.fs.FileSystem.from_uri(path) if "://" in path else (pa.fs.LocalFileSystem(), path.removeprefix("file:"))
        self.file = files.open_input_file(inner)
        self.fetched, self.head = 0, b""
        self.head = self._fetch(0, HEAD)

    def _fetch(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        out = self.file.read(size)
        self.fetched += len(out)
        return out

    def __getitem__(self, s: slice) -> bytes:
        begin, end = s.start or 0, s.stop
        return self.head[begin:end] if end <= len(self.head) else self._fetch(begin, end - begin)


@dataclass
class Blocks(InputPartition):
    """Blocks of one file: their numbers and boxes."""

    path: str
    blocks: list[tuple[int, int, int, int, int]]


_TESTS = {EqualTo: operator.eq, LessThan: operator.lt, LessThanOrEqual: operator.le, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, In: lambda v, among: v in among}


class GeoTiffReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.pattern = options["path"], options.get("glob", "*.tif")
        self.bands = [int(b) for b in str(options.get("bands", "1")).split(",")]
        self.most = int(options.get("partitionbytes", options.get("partitionBytes", 16 << 20)))
        self.tests: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if type(f) in _TESTS and name in ("path", "x0", "y0", "x1", "y1"):
                self.tests.append((name, type(f), f.value))
            else:
                yield f

    def _asked(self, **row) -> bool:
        return all(_TESTS[kind](row[name], value) for name, kind, value in self.tests if name in row)

    def _files(self) -> list[str]:
        root = self.path if "://" in self.path else self.path.removeprefix("file:")
        files, inner = pa.fs.FileSystem.from_uri(root) if "://" in root else (pa.fs.LocalFileSystem(), root)
        scheme = root.split("://")[0] + "://" if "://" in root else ""
        info = files.get_file_info(inner)
        found = [info] if info.type == pa.fs.FileType.File else [i for i in files.get_file_info(pa.fs.FileSelector(inner, recursive=True)) if i.type == pa.fs.FileType.File and fnmatch.fnmatch(i.base_name, self.pattern)]
        return sorted(p for p in (scheme + i.path for i in found) if self._asked(path=p))

    def _planned(self, path: str) -> list[Blocks]:
        """A file's blocks that are asked for, in parts of at most ``partitionBytes`` in the file, but one block at least."""
        out, size = [], 0
        for k, (x0, y0, x1, y1, n) in enumerate(Tiff(Ranges(path)).blocks()):
            if not self._asked(x0=x0, y0=y0, x1=x1, y1=y1):
                continue
            if not out or size + n > self.most:
                out.append(Blocks(path, []))
                size = 0
            out[-1].blocks.append((k, x0, y0, x1, y1))
            size += n
        return out

    def partitions(self) -> Sequence[InputPartition]:
        with ThreadPoolExecutor(16) as pool:
            return [p for parts in pool.map(self._planned, self._files()) for p in parts]

    def read(self, partition: Blocks) -> Iterator[pa.RecordBatch]:
        opened = Tiff(Ranges(partition.path))
        for k, *box in partition.blocks:
            px = opened.read(self.bands, tuple(box)).astype("<f4")
            values = [pa.array([partition.path]), *(pa.array([v], pa.int64()) for v in (k, *box)), pa.array([px.tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(values, ["path", "block", "x0", "y0", "x1", "y1", "pixels"])


class GeoTiff(DataSource):
    """Options: path (a file or a folder), glob (of file names), bands (numbers from 1), partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> GeoTiffReader:
        return GeoTiffReader(self.options)


def windows(blocks: DataFrame, tiles: DataFrame, bands: int) -> DataFrame:
    """path, tile_index, height, width, pixels of tiles (path, tile_index, x0, y0, x1, y1; inside the raster), put together from the blocks that they meet. A block goes to each tile that it meets, and a tile's blocks meet in one task, sorted, one tile after the other."""
    box = ("x0", "y0", "x1", "y1")
    asked = tiles.select("path", "tile_index", *(F.col(c).alias(f"t{c}") for c in box))
    met = blocks.join(asked, "path").where("x0 < tx1 and x1 > tx0 and y0 < ty1 and y1 > ty0")
    rows = met.repartition("path", "tile_index").sortWithinPartitions("path", "tile_index", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, image = None, None

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"path": [at[0]], "tile_index": pa.array([at[1]], pa.int64()), "height": pa.array([image.shape[0]], pa.int64()), "width": pa.array([image.shape[1]], pa.int64()), "pixels": pa.array([image.tobytes()], pa.binary())})

        for b in batches:
            for r in b.to_pylist():
                if (r["path"], r["tile_index"]) != at:
                    if at is not None:
                        yield told()
                    at, image = (r["path"], r["tile_index"]), np.zeros((r["ty1"] - r["ty0"], r["tx1"] - r["tx0"], bands), "<f4")
                px = np.frombuffer(r["pixels"], "<f4").reshape(r["y1"] - r["y0"], r["x1"] - r["x0"], bands)
                x0, y0, x1, y1 = max(r["x0"], r["tx0"]), max(r["y0"], r["ty0"]), min(r["x1"], r["tx1"]), min(r["y1"], r["ty1"])
                image[y0 - r["ty0"] : y1 - r["ty0"], x0 - r["tx0"] : x1 - r["tx0"]] = px[y0 - r["y0"] : y1 - r["y0"], x0 - r["x0"] : x1 - r["x0"]]
        if at is not None:
            yield told()

    return rows.mapInArrow(run, "path string, tile_index long, height long, width long, pixels binary")
