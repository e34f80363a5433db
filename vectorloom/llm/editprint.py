"""Document fingerprints by a randomised edit embedding.

All texts share one random walk over (step, character class): at each step the embedding puts out the current character, and the
walk's bit for that step and character says whether to go on to the next one. Texts a few edits apart fall back into step, so their
embeddings differ in few places: edit distance becomes Hamming distance. A fingerprint samples the embedding at places that all
texts share, as many in each octave of steps, so it covers the whole of a text of any length; a sample stands for
as many steps as lie between samples of its octave. Likeness is the share of steps at which two fingerprints agree.

``classes`` cuts fingerprints into more blocks of places than may differ, so that all that reach the threshold meet in a block, and verifies candidates by the Hamming likeness of whole fingerprints.

Cases: null counts as empty; the empty text has the empty fingerprint, alike (1) to itself and unlike (0) all others; rows with a null
doc_id come last in descending order; rows that repeat a doc_id are ordered by a hash of their text; an empty table gives an empty result;
a table of one row is its own next.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrowmap import arrow_map, texts_of
from .dartminhash import Measure, connected, verified
from .graph import components
from .skew import hot_keys, join_one
from .storage import Workspace
from .textcore import code_points, mix

PERIOD = 4096  # steps after which the walk's bits repeat
CLASSES = 256
SAMPLES = 64  # in the first octave and in each further one
FIRST = 256  # steps of the first octave
ALPHABET = np.frombuffer(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz-_", np.uint8)
#: Consecutive ids that are brought together to find each document's next.
BUCKET = 256
BROADCAST_ROWS = 500_000


@cache
def walk() -> list[bytes]:
    """By character class: how many steps the walk stays on a character that it meets at a step."""
    out = []
    for c in range(CLASSES):
        bits = (mix(np.arange(PERIOD, dtype=np.uint64) + np.uint64((c + 1) << 32)) >> np.uint64(17)) & np.uint64(1)
        bits[PERIOD - 1] = 1
        at = np.flatnonzero(bits)
        out.append(np.minimum(at[np.searchsorted(at, np.arange(PERIOD))] - np.arange(PERIOD) + 1, 255).astype(np.uint8).tobytes())
    return out


@cache
def places(octaves: int) -> tuple[np.ndarray, np.ndarray]:
    """Sampled steps in ascending order and the number of steps that each stands for."""
    steps, weights = [], []
    for o in range(octaves):
        low, high = (0, FIRST) if o == 0 else (FIRST << (o - 1), FIRST << o)
        cell = (high - low) / SAMPLES
        jitter = (mix(np.arange(SAMPLES, dtype=np.uint64) + np.uint64((o + 1) * 1_000_003)) >> np.uint64(11)).astype(float) * 2.0**-53
        steps.append(low + ((np.arange(SAMPLES) + jitter) * cell).astype(np.int64))
        weights.append(np.full(SAMPLES, cell))
    return np.concatenate(steps), np.concatenate(weights)


def _classes(cp: np.ndarray) -> bytes:
    return np.where(cp < 128, cp, 128 + (mix(cp.astype(np.uint64)) % np.uint64(128)).astype(np.uint32)).astype(np.uint8).tobytes()


def _go(classes: bytes, step: int) -> tuple[list[int], int]:
    """The step at which the walk meets each character, and where it stands at last."""
    table, mask = walk(), PERIOD - 1
    met = []
    for c in classes:
        met.append(step)
        step += table[c][step & mask]
    return met, step


def _sampled(cp: np.ndarray, met: np.ndarray, end: int) -> str:
    if not len(cp):
        return ""
    octaves = max(1, int(end - 1).bit_length() - FIRST.bit_length() + 2)
    at = places(octaves)[0]
    at = at[at < end]
    seen = cp[np.searchsorted(met, at, "right") - 1]
    return ALPHABET[(mix(seen.astype(np.uint64)) >> np.uint64(58)).astype(np.int64)].tobytes().decode()


class Walked:
    """A text with its walk."""

    def __init__(self, text: str):
        self.cp = code_points(text)
        met, self.end = _go(_classes(self.cp), 0)
        self.met = np.array([*met, self.end], np.int64)
        self.print = _sampled(self.cp, self.met[:-1], self.end)

    def edited(self, following: "Walked") -> tuple[np.ndarray, str]:
        """The text with its last third replaced by as much of the following one's start: code points and fingerprint; the walk goes on from where it stood."""
        n = len(self.cp)
        stay = n - n // 3
        new = following.cp[: n // 3]
        cp = np.concatenate([self.cp[:stay], new])
        met, end = _go(_classes(new), int(self.met[stay]))
        return cp, _sampled(cp, np.concatenate([self.met[:stay], np.array(met, np.int64)]), end)


def fingerprint(text: str) -> str:
    return Walked(text).print


def likeness(a: str, b: str) -> float:
    """Share of the longer embedding's steps at which the fingerprints agree."""
    if a == b:
        return 1.0
    n = max(len(a), len(b))
    low = min(len(a), len(b))
    weight = places(max(1, -(-n // SAMPLES)))[1][:n]
    x, y = (np.frombuffer(s[:low].encode(), np.uint8) for s in (a, b))
    return float(weight[:low][x == y].sum() / weight.sum())


def _next_bucket(docs: DataFrame, space: Workspace) -> DataFrame:
    """(bucket, top, top_h, before): each bucket's first row, and the bucket that it follows in descending order (the first follows the last).
    Buckets are sorted in ranges, each a task of its own; only the ends of ranges meet in one place, a row a range."""
    tops = docs.groupBy("bucket").agg(F.max(F.struct("doc_id", F.bitwise_not("h").alias("h"))).alias("top"))
    ranged = space.written(tops.repartitionByRange("bucket").select("bucket", "top", F.spark_partition_id().alias("range")), "ranges")
    ends = ranged.groupBy("range").agg(F.min("bucket").alias("low"))
    ends = ends.select("range", F.lead("low").over(Window.orderBy("low")).alias("above"))
    least = ranged.agg(F.min("bucket").alias("least"))
    near = ranged.withColumn("above_in", F.lead("bucket").over(Window.partitionBy("range").orderBy("bucket"))).join(F.broadcast(ends), "range").join(F.broadcast(least))
    return near.select("bucket", F.col("top.doc_id").alias("top"), F.bitwise_not("top.h").alias("top_h"), F.coalesce("above_in", "above", "least").alias("before"))


def fingerprints(docs: DataFrame, space: Workspace | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, in one shuffle of the texts."""
    space = space or Workspace(docs.sparkSession)
    h = F.xxhash64(F.coalesce("text", F.lit("")))
    # rows without an id come last, by their texts' hash, and fall into buckets by it
    nameless = F.lit(-(1 << 60)) - F.shiftright("h", 44)
    rows = docs.select("doc_id", "text", h.alias("h")).withColumn("bucket", F.coalesce(F.floor(F.col("doc_id") / BUCKET), nameless))
    order = space.written(_next_bucket(rows, space), "order")
    few = order.count() <= BROADCAST_ROWS
    tops = order.select(F.col("top").alias("t"), F.col("top_h").alias("th"), F.col("bucket").alias("own"), "before")
    joined = rows.join(F.broadcast(tops) if few else tops, F.col("doc_id").eqNullSafe(F.col("t")) & (F.col("bucket") == F.col("own")) & (F.col("h") == F.col("th")), "left")
    # each bucket's first row also goes, as a carried one, behind the last of the bucket before it
    own = F.struct(F.col("bucket").alias("to"), F.lit(0).alias("carried"))
    sent = F.when(F.col("before").isNotNull(), F.array(own, F.struct(F.col("before").alias("to"), F.lit(1).alias("carried")))).otherwise(F.array(own))
    dealt = joined.select("doc_id", "text", "h", F.explode(sent).alias("s")).select("doc_id", "text", "h", "s.to", "s.carried")
    dealt = dealt.repartition("to").sortWithinPartitions("to", "carried", F.desc_nulls_last("doc_id"), "h")

    def run(batches):
        held = None  # the row whose next is to come
        out: list[tuple] = []
        for b in batches:
            for doc, text, to, carried in zip(b["doc_id"].to_pylist(), texts_of(b["text"]), b["to"].to_pylist(), b["carried"].to_pylist(), strict=True):
                if held is not None and held[1] != to:
                    raise AssertionError("a bucket ended without a carried row")
                if held is None and carried:
                    continue  # of several rows with the carried id only the first is anyone's next
                w = Walked(text)
                if held is not None:
                    old, _, x = held
                    cp, fp = x.edited(w)
                    out.append((old, len(x.cp), hashlib.sha256(cp.tobytes().decode("utf-32-le", "surrogatepass").encode()).hexdigest(), x.print, fp, likeness(x.print, fp), likeness(x.print, w.print)))
                held = None if carried else (doc, to, w)
                if len(out) >= 500:
                    yield _rows(out)
                    out = []
        if out:
            yield _rows(out)

    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)


THRESHOLD = 0.8
#: Parts of the blocks. Of many keys each part meets in a turn of its own, so that only so much is shuffled at once.
PARTS = 16
#: One block in so many serves to join most of each family before all blocks meet.
STAR = 8
#: Texts of a block's main class with which those of other classes are compared first.
MAIN = 4
#: Keys for which one turn does.
AT_ONCE = 1_500_000
#: Texts of a key that one task compares; more are dealt to tiles, each of two parts of them. Counted on one text in so many, as tiles change no result.
TILE, COUNTED = 8192, 16
#: Rows of a task that are looked at together, at least, and pairs.
GATHERED, COMPARED = 50_000, 1 << 18
#: Longs of a sketch, and sketches of a fingerprint.
LONGS, PLANES = 6, 2


def missed(n: int, threshold: float = THRESHOLD) -> int:
    """Samples that may differ of so many."""
    return int((1 - threshold) * n + 1e-9)


def blocks(n: int, threshold: float = THRESHOLD) -> list[tuple[int, int, int]]:
    """Name, start and size of the blocks of a fingerprint of ``n`` samples. Two fingerprints that reach the threshold agree on all of a block of the same name: the shorter one has more blocks than it may have samples that differ.

    Places are cut alike for all lengths, one sample shorter at first, so every beginning has a block to spare. Fingerprints shorter than these first blocks are cut by their own length, and so are the beginnings of those longer ones that may be alike to them."""
    if threshold < 0.5:
        raise ValueError("fingerprints meet in blocks for thresholds of at least 0.5")
    wide = min(int(1 / (1 - threshold) + 1e-9), 16) if threshold < 1 else 16
    base = wide * (wide - 1)
    out = []
    if n >= base:
        out = [(j, j * (wide - 1), wide - 1) for j in range(wide)] + [(j, base + (j - wide) * wide, wide) for j in range(wide, n // wide + 1)]
    for p in range(max(1, math.ceil(threshold * n - 1e-9)), min(n, base - 1) + 1):
        parts = missed(p, threshold) + 1
        out += [(-1 - p * wide - k, k * p // parts, (k + 1) * p // parts - k * p // parts) for k in range(parts)]
    return out


def preceded(cuts: list[tuple[int, int, int]]) -> list[tuple]:
    """The blocks, each with start and size of the one before it in its cut (none before the first). All fingerprints that have a block have the one before it."""
    ends = {(name < 0, start + size): (start, size) for name, start, size in cuts if name >= 0}
    out = []
    for at, (name, start, size) in enumerate(cuts):
        before = ends.get((False, start)) if name >= 0 else cuts[at - 1][1:] if start else None
        out.append((name, start, size, *(before or (None, None))))
    return out


def band_keys(print_: str, threshold: float = THRESHOLD) -> list[tuple[int, str]]:
    """Names of blocks and what they hold."""
    return [(name, print_[at : at + size]) for name, at, size in blocks(len(print_), threshold)]


def _symbols(print_: str) -> np.ndarray:
    return np.frombuffer(print_.encode(), np.uint8)


_INDEX = np.zeros(256, np.uint8)
_INDEX[ALPHABET] = np.arange(64)


def sketch(print_: str, plane: int = 0) -> np.ndarray:
    """One bit of each sample, another one in each of the ``PLANES``, folded by parity to ``LONGS`` longs: two sketches differ in no more bits than their fingerprints in samples (those that only one has count), and so do all planes
    together, as a bit's place stands for the same samples in each."""
    bits = (_INDEX[_symbols(print_)] >> ((np.arange(len(print_)) + 3 * plane) % 6).astype(np.uint8)) & 1
    every = np.zeros(max(1, -(-len(bits) // (64 * LONGS))) * 64 * LONGS, np.uint8)
    every[: len(bits)] = bits
    return np.packbits(every.reshape(-1, 64 * LONGS).sum(0).astype(np.uint8) & 1).view(np.int64)


def _tokens(print_: str | None) -> np.ndarray:
    """Place and symbol of each sample as one number, in ascending order."""
    x = _symbols(print_ or "").astype(np.uint64)
    return np.sort(mix((np.arange(len(x), dtype=np.uint64) << np.uint64(8)) | x))


def _read(print_: str | None) -> np.ndarray:
    return _symbols(print_ or "")


def agreement(x: np.ndarray, y: np.ndarray) -> float:
    """Hamming likeness of two fingerprints: the share of the longer one's samples at which both have the same symbol."""
    n, most = min(len(x), len(y)), max(len(x), len(y))
    return float((x[:n] == y[:n]).sum() / most) if most else 0.0


#: Sharing s of the longer's samples, two fingerprints' sets of (place, symbol) have a Jaccard likeness of s / (2 - s) at least.
PRINTS = Measure(_read, agreement, _tokens, lambda s: s / (2 - s))


def far_apart(threshold: float, n: np.ndarray, sketches: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs ``i``, ``j`` may not reach the threshold, by length or by sketch (a row of ``LONGS * PLANES`` unsigned longs a text; of signed ones numpy counts the bits of the absolute value)."""
    most = np.maximum(n[i], n[j])
    bound = np.floor((1 - threshold) * most + 1e-9)
    apart = np.minimum(n[i], n[j]) < threshold * most - 1e-9
    at, differ = np.flatnonzero(~apart), np.zeros(len(i), np.int64)
    for k in range(LONGS):
        x, y = i[at], j[at]
        differ[at] += np.bitwise_count(reduce(np.bitwise_or, (sketches[x, k + p * LONGS] ^ sketches[y, k + p * LONGS] for p in range(PLANES))))
        gone = differ[at] > bound[at]
        apart[at[gone]] = True
        at = at[~gone]
    return apart


class Met:
    """Texts in ascending order of the keys that they share, whole keys only, and pairs of them (as two arrays of row numbers) that are to be compared."""

    def __init__(self, columns: dict[str, np.ndarray], threshold: float):
        self.threshold = threshold
        self.key, self.rep, self.label, self.before, self.side, self.n, self.sketch = (columns[c] for c in ("key", "rep", "label", "before", "side", "n", "sketch"))
        self.start = np.flatnonzero(np.r_[True, self.key[1:] != self.key[:-1]]) if len(self.key) else np.zeros(0, int)
        self.size = np.diff(np.r_[self.start, len(self.key)])
        self.group = np.repeat(np.arange(len(self.start)), self.size)

    def least(self, order: np.ndarray, among: np.ndarray | None = None) -> np.ndarray:
        """Each key's row of least ``order``, of those ``among`` its rows, or -1."""
        rows = np.arange(len(order)) if among is None else np.flatnonzero(among)
        rows = rows[np.lexsort((order[rows], self.group[rows]))]
        out = np.full(len(self.start), -1)
        out[self.group[rows[::-1]]] = rows[::-1]
        return out

    def kept(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of different texts that may be near."""
        some = (j >= 0) & (self.rep[i] != self.rep[j])
        i, j = i[some], j[some]
        some = ~far_apart(self.threshold, self.n, self.sketch, i, j)
        return i[some], j[some]

    def runs(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows by key and ``of``, where the run of each of them (alike in both) ends, and the length of the run."""
        rows = np.lexsort((of, self.group))
        first = np.flatnonzero(np.r_[True, (self.group[rows][1:] != self.group[rows][:-1]) | (of[rows][1:] != of[rows][:-1])][: len(rows)])
        size = np.diff(np.r_[first, len(rows)])
        return rows, np.repeat(first + size, size), np.repeat(size, size)

    def star(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Each text with its key's pivots."""
        rep = self.rep.view(np.uint64)
        for order in (self.rep, mix(rep), mix(rep ^ mix(self.key.view(np.uint64)))):
            yield self.kept(np.arange(len(rep)), self.least(order)[self.group])

    def main(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Texts with some of their key's main class, the one that most of its texts have, where they are of another."""
        rows, _, size = self.runs(self.label)
        often = np.empty(len(rows), np.int64)
        often[rows] = -size
        most = self.label == self.label[self.least(often)][self.group]
        others = np.flatnonzero(~most)
        for k in range(MAIN):
            yield self.kept(others, self.least(mix(self.rep.view(np.uint64) ^ mix(self.key.view(np.uint64) + np.uint64(k))), most)[self.group[others]])

    def every(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs of texts of different class whose blocks before this one differ too. Texts are put in runs of one class or in runs of one block before, whichever leaves a key fewer pairs of different runs; in a tile, in its two sides."""
        of_label, of_before = (np.bincount(self.group[rows], size) for rows, _, size in (self.runs(self.label), self.runs(self.before)))
        by_label = (of_label >= of_before)[self.group]
        rows, end, _ = self.runs(np.where(self.side > 0, self.side, np.where(by_label, self.label, self.before)))
        count = (self.start + self.size)[self.group[rows]] - end
        done = np.cumsum(count)
        at = 0
        while at < len(rows):
            # as many rows as come to COMPARED pairs, at least one
            to = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + COMPARED, "right")))
            c = count[at:to]
            i = np.repeat(np.arange(at, to), c)
            j = np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c) + np.repeat(end[at:to], c)
            i, j = rows[i], rows[j]
            some = (self.label[i] != self.label[j]) & (self.before[i] != self.before[j])
            yield self.kept(i[some], j[some])
            at = to


def compared(rows: DataFrame, threshold: float, how: str) -> DataFrame:
    """(a, b, label_a, label_b) with a < b of those pairs of ``rows`` (key, rep, label, before, side, n, sketch) that ``how`` of ``Met`` compares and that may be near, a row each time that they meet."""

    def found(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches).combine_chunks()
        columns = {c: t[c].to_numpy() for c in ("key", "rep", "label", "before", "side", "n")}
        # keys of one class have no pairs
        first = np.flatnonzero(np.r_[True, columns["key"][1:] != columns["key"][:-1]])
        label, size = columns["label"], np.diff(np.r_[first, t.num_rows])
        mixed = np.repeat(np.minimum.reduceat(label, first) != np.maximum.reduceat(label, first), size)
        columns = {c: v[mixed] for c, v in columns.items()}
        columns["sketch"] = np.frombuffer(b"".join(t["sketch"].filter(pa.array(mixed)).to_pylist()), np.uint64).reshape(-1, LONGS * PLANES)
        met = Met(columns, threshold)
        for i, j in getattr(met, how)():
            if len(i):
                i, j = np.where(met.rep[i] < met.rep[j], (i, j), (j, i))
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (met.rep[i], met.rep[j], met.label[i], met.label[j])], ["a", "b", "label_a", "label_b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            key = b["key"].to_numpy()
            # where the last key of the batch begins
            cut = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
            if sum(x.num_rows for x in held) + cut >= GATHERED and (cut or held[-1]["key"][-1].as_py() != key[0]):
                yield from found([*held, b.slice(0, cut)])
                held = []
            else:
                cut = 0
            held.append(b.slice(cut))
        if held:
            yield from found(held)

    return rows.mapInArrow(run, "a long, b long, label_a long, label_b long")


def classes(prints: DataFrame, threshold: float = THRESHOLD, space: Workspace | None = None) -> DataFrame:
    """``prints`` (doc_id, fingerprint, ...) with class_id, the least doc_id of the documents that a chain of fingerprints connects, each at least ``threshold`` alike to the next.
    Equal fingerprints count as one; the empty text is alike to empty ones only; a null doc_id has no class."""
    space = space or Workspace(prints.sparkSession)
    name = lambda c: F.unhex(F.md5(F.col(c).cast("binary")))
    rows = prints.withColumn("copy", name("fingerprint"))

    def kernel(b: pa.RecordBatch) -> dict:
        texts = b["text"].to_pylist()
        sketches = [np.concatenate([sketch(t, p) for p in range(PLANES)]).tobytes() for t in texts]
        return {"copy": b["copy"], "rep": b["rep"], "text": b["text"], "n": pa.array([len(t) for t in texts], pa.int32()), "sketch": pa.array(sketches, pa.binary())}

    one = rows.where("doc_id is not null").groupBy("copy").agg(F.min("doc_id").alias("rep"), F.first("fingerprint").alias("text"))
    reps = space.written(arrow_map(one, {c: c for c in one.columns}, "copy binary, rep long, text string, n int, sketch binary", kernel), "reps")
    space.release()
    named = linked(reps.select("rep", "text", "n", "sketch"), threshold, space)
    class_of = reps.select("copy", "rep").join(named.select(F.col("id").alias("rep"), "label"), "rep", "left").select("copy", F.coalesce("label", "rep").alias("class_id"))
    hot = hot_keys(rows.groupBy("copy").agg(F.count("*").alias("n")), ["copy"])
    out = join_one(rows, class_of, ["copy"], hot, "left", by=["doc_id"])
    return out.select(*prints.columns, F.when(F.col("doc_id").isNotNull(), F.col("class_id")).alias("class_id"))


def linked(reps: DataFrame, threshold: float, space: Workspace) -> DataFrame:
    """(id, label): the least of each fingerprint's (rep, text, n, sketch) class. Fingerprints meet in all their ``blocks``, so no link is lost; pairs whose sketches or lengths differ too much are no candidates.

    First the texts of a part of the blocks are compared with their block's pivots, then, in another part, those of other classes with some of the block's main class, the one that most of its texts have: that joins most of each family.
    Then all texts of a block are compared, but only where classes differ. Two texts that agree on a row of blocks meet at the first of the row only (blocks are told apart by 64-bit hashes there).
    A text travels once a block, and the pairs are made where its block's texts come together (``Met``)."""
    spark = reps.sparkSession
    lengths = {r["n"]: (r["count"], blocks(r["n"], threshold)) for r in reps.groupBy("n").count().collect()}  # of as many kinds as there are places
    turns = min(PARTS, 1 + sum(count * len(cuts) for count, cuts in lengths.values()) // AT_ONCE)
    cut = space.written(spark.createDataFrame([(n, *b) for n, (_, cuts) in lengths.items() for b in preceded(cuts)], "n int, name int, start int, size int, start_before int, size_before int"), "blocks")
    block = F.expr("xxhash64(name, substring(text, start + 1, size))")
    counted = reps.where(f"pmod(xxhash64(rep), {COUNTED}) = 0").join(F.broadcast(cut), "n").groupBy(block.alias("key")).agg((F.count("*") * COUNTED).alias("texts"))
    hot = space.written(counted.where(F.col("texts") > TILE).select("key", F.ceil(F.col("texts") / TILE).cast("int").alias("parts")), "hot")

    def met(rows: DataFrame, parts: int, turn: int, tiles: bool = False) -> DataFrame:
        part = rows.join(F.broadcast(cut.where(f"pmod(name, {parts}) = {turn}")), "n")
        # a first block has none before it: there all texts differ
        before = F.expr("if(start_before is null, rep, xxhash64(substring(text, start_before + 1, size_before)))").alias("before")
        part = part.select(block.alias("key"), "rep", "label", before, F.lit(0).alias("side"), "n", "sketch")
        if tiles:
            own = F.expr("int(pmod(xxhash64(rep, 7L), parts))")
            dealt = part.join(F.broadcast(hot), "key", "left").withColumn("own", own).withColumn("other", F.explode(F.expr("if(parts is null, array(-1), sequence(0, parts - 1))")))
            key = F.when(F.col("parts").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")))
            side = F.expr("if(parts is null or own = other, 0, if(own < other, 1, 2))")
            part = dealt.select(key.alias("key"), "rep", "label", "before", side.alias("side"), "n", "sketch")
        return part.repartition("key").sortWithinPartitions("key")

    texts = reps.select(F.col("rep").alias("id"), F.lit(0).cast("long").alias("h"), "text")
    whole = lambda df, *more: df.select("a", F.lit(0).cast("long").alias("h_a"), "b", F.lit(0).cast("long").alias("h_b"), *more)
    star = compared(met(reps.withColumn("label", F.col("rep")), STAR, 0), threshold, "star").select("a", "b").distinct()
    done = space.written(verified(whole(space.written(star, "star")), texts, PRINTS), "verified")
    space.release()
    named = components(done.where(F.col("likeness") >= threshold).select("a", "b"), space, "first")

    def labelled(named: DataFrame, step: str) -> DataFrame:
        out = space.written(reps.join(named.withColumnRenamed("id", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep")), step)
        space.release()
        return out

    def counts(pairs: DataFrame, step: str) -> DataFrame:
        out = space.written(pairs.groupBy("a", "b", "label_a", "label_b").agg(F.count("*").alias("shared")), step)
        space.release()
        return out

    known = labelled(named, "labelled-0")
    most = counts(compared(met(known, STAR, 1), threshold, "main"), "most")
    named = connected(known.select(F.col("rep").alias("id"), "label"), whole(most, "label_a", "label_b", "shared"), texts, threshold, space, PRINTS)
    known = labelled(named, "labelled")
    for step in ("star", "verified", "labelled-0", "most"):
        space.remove(step)
    named = space.written(known.select(F.col("rep").alias("id"), "label"), "named")
    found = [counts(compared(met(known, turns, turn, tiles=True), threshold, "every"), f"maybe-{turn}") for turn in range(turns)]
    pairs = reduce(DataFrame.union, found).groupBy("a", "b", "label_a", "label_b").agg(F.sum("shared").alias("shared"))
    maybe = space.written(whole(pairs, "label_a", "label_b", "shared"), "maybe")
    for step in ("labelled", "hot", *(f"maybe-{turn}" for turn in range(turns))):
        space.remove(step)
    space.release()
    return named if maybe.isEmpty() else connected(named, maybe, texts, threshold, space, PRINTS)


def near(docs: DataFrame, threshold: float = THRESHOLD, space: Workspace | None = None) -> DataFrame:
    """What ``fingerprints`` gives of each document, with its class of near texts."""
    space = space or Workspace(docs.sparkSession)
    prints = space.written(fingerprints(docs, space), "prints", compression="zstd")
    for done in ("ranges", "order"):
        space.remove(done)
    space.release()
    return classes(prints, threshold, space)
