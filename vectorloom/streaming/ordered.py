"""The merge of tiles as a stream that restores scan order.

Tiles of a sample come in any order, over any number of triggers. Each waits in state until all tiles before it have been merged; then it and what waits behind it are merged in order, so the result is that of the
batch. A tile that never comes holds the others up only until the watermark has passed the event time of one that waits, by ``patience``. State holds the ends of features and what waits, no lines.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .tiled import TOLERANCE, Ends

#: Fixed value: the state store that keeps maps and timers.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class ScanOrder(StatefulProcessor):
    """Merges a sample's tiles in the order of their index."""

    def __init__(self, key: str, tolerance: float, patience_ms: int):
        self.key, self.tolerance, self.patience = key, tolerance, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.next = handle.getValueState("next", "n long")
        self.waiting = handle.getMapState("waiting", "tile long", "features string, due long")
        self.held = handle.getMapState("held", "n long", "props string, x0 double, y0 double, x1 double, y1 double, low long, high long, tile long, feature long")

    def _ends(self) -> tuple[Ends, list[tuple[int, int]]]:
        """What has been merged, and the features' founders."""
        ends, founders = Ends(self.tolerance), []
        for _, (props, x0, y0, x1, y1, low, high, tile, feature) in sorted(self.held.iterator()):
            first = None if x0 is None or pd.isna(x0) else (x0, y0)
            ends.features.append((json.loads(props), first, None if first is None else (x1, y1)))
            ends.places.append([low, high])
            ends._enter(len(founders))
            founders.append((tile, feature))
        return ends, founders

    def _merged(self, tiles: list[tuple[int, str, bool]], name) -> Iterator[pd.DataFrame]:
        """Parts of the tiles' features, in order."""
        ends, founders = self._ends()
        changed, out = set(), []
        for tile, features, late in tiles:
            for feature, props, first, last in sorted(json.loads(features)):
                n, at, flip = ends.add(json.loads(props), first and tuple(first), last and tuple(last))
                if n == len(founders):
                    founders.append((tile, feature))
                changed.add(n)
                out.append((name, tile, feature, *founders[n], at, flip, late))
        for n in changed:
            props, first, last = ends.features[n]
            self.held.updateValue((n,), (json.dumps(props), *(first or (None, None)), *(last or (None, None)), *ends.places[n], *founders[n]))
        if out:
            yield pd.DataFrame(out, columns=[self.key, "tile_index", "feature_id", "founder_tile", "founder_id", "at", "flip", "late"])

    def _ready(self, at: int) -> tuple[list[tuple[int, str, bool]], int]:
        """Waiting tiles that come one behind the other from a place on, and the place behind them."""
        out = []
        while self.waiting.containsKey((at,)):
            out.append((at, self.waiting.getValue((at,))[0], False))
            self.waiting.removeKey((at,))
            at += 1
        return out, at

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        at = self.next.get()[0] if self.next.exists() else 0
        late = []
        for frame in rows:
            for r in frame.itertuples():
                if r.tile_index < at:
                    late.append((int(r.tile_index), r.features, True))
                    continue
                due = int(r.ts.timestamp() * 1000) + self.patience
                self.waiting.updateValue((int(r.tile_index),), (r.features, due))
                self.handle.registerTimer(due)
        ready, at = self._ready(at)
        self.next.update((at,))
        yield from self._merged(sorted(late) + ready, key[0])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The oldest tile that is due waits no longer for those before it; what is not yet due goes on waiting behind it."""
        now = expiredTimerInfo.getExpiryTimeInMs()
        due = [tile for (tile,), (_, when) in self.waiting.iterator() if when <= now]
        if not due:
            return
        ready, at = [], self.next.get()[0]
        for tile in sorted(tile for (tile,), _ in self.waiting.iterator()):
            if tile >= at and tile <= max(due):
                more, at = self._ready(tile)
                ready += more
        self.next.update((at,))
        yield from self._merged(ready, key[0])

    def close(self) -> None:
        pass


def merge_stream(tiles: DataFrame, key: str, tolerance: float = TOLERANCE, patience: str = "10 minutes", lateness: str = "10 minutes") -> DataFrame:
    """Parts (key, tile_index, feature_id, founder_tile, founder_id, at, flip, late) of the merge of a stream of tiles: a row a tile (key, tile_index from 0, ts, features: an array of feature_id, props and line; empty for a tile without any).
    A feature's line is its parts' lines by ``at``, as in the batch. A tile that comes after its turn is merged when it comes, and marked ``late``. Spark drops rows that come more than ``lateness`` behind the greatest event time. The session's state store must be ``ROCKS``."""
    ends = lambda f: F.array(F.to_json(F.array(f["line"][0]["x"], f["line"][0]["y"])), F.to_json(F.array(F.element_at(f["line"], -1)["x"], F.element_at(f["line"], -1)["y"])))
    none = F.array(F.lit("null"), F.lit("null"))
    quoted = lambda t: F.substring(F.to_json(F.array(t)), F.lit(2), F.length(F.to_json(F.array(t))) - 2)
    one = lambda f: F.concat(F.lit("["), F.array_join(F.concat(F.array(f["feature_id"].cast("string"), quoted(F.coalesce(f["props"], F.lit("{}")))), F.when(F.size(f["line"]) >= 2, ends(f)).otherwise(none)), ","), F.lit("]"))
    told = F.concat(F.lit("["), F.array_join(F.transform("features", one), ","), F.lit("]"))
    slim = tiles.withWatermark("ts", lateness).select(key, F.col("tile_index").cast("long").alias("tile_index"), "ts", told.alias("features"))
    kind = tiles.schema[key].dataType.simpleString()
    patience_ms = int(pd.Timedelta(patience).total_seconds() * 1000)
    schema = f"{key} {kind}, tile_index long, feature_id long, founder_tile long, founder_id long, at long, flip boolean, late boolean"
    return slim.groupBy(key).transformWithStateInPandas(ScanOrder(key, tolerance, patience_ms), schema, "Append", "EventTime")
