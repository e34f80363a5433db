"""Near-duplicate documents by DartMinHash over weighted word shingles.

A text's elements are its five-word shingles, weighted by how often they occur. Hashed darts fall on the plane of an
element's weight and rank with unit density: each unit of weight is a region with a Poisson sequence of ranks
that its own hash draws. A document looks at the darts whose weight lies under the element's and whose rank is at most
k ln k + 2 k over its total weight, sends each to the coordinate that the dart's hash names and keeps the
earliest per coordinate. Two documents agree on a coordinate with the probability of their weighted Jaccard
likeness. Cost is the number of elements plus k ln k, not their product. Coordinates left empty are filled from twice the rank.

Signatures join in bands; candidates are verified by their exact weighted Jaccard likeness; links of at least the
threshold make classes, by connected components. Exact copies fold into one representative first. Buckets of up to ``ALL_PAIRS``
texts give all pairs. In larger ones every text is first compared with the bucket's pivots: the least doc_id, the least by a hash, and the least by a hash
that differs from bucket to bucket. That joins most of a family of copies. Large buckets whose texts are still of several classes are then searched exactly
(``crossing``): two texts alike enough share one of the rarest shingles of both, so all links between classes are found; pairs within one class need no comparison.

Cases: null and empty texts link only to their exact copies (null counts as empty); texts under five words are one shingle;
rows that repeat a doc_id are one document (of its texts, the one with the least SHA-256 stands for it); rows with a null
doc_id are documents of no class (class_id null); an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowmap import arrow_map, texts_of
from .graph import components
from .skew import hot_keys, join_one
from .storage import Workspace
from .textcore import blocks, mix, shingles, words

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 25, 5
#: Buckets of up to so many texts give all pairs; of larger ones, all texts meet the pivots, and what that leaves apart is searched by rare shingles.
ALL_PAIRS = 16


def elements(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (element, text) and how often each occurs."""
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return h[at], doc[at], np.diff(np.append(at, len(h))).astype(float)


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(h: np.ndarray, doc: np.ndarray, weight: np.ndarray, n_docs: int, k: int = BANDS * ROWS, reach: float = 1.0) -> np.ndarray:
    """Texts x k matrix of dart names; a text without elements has zeros."""
    best = np.full(n_docs * k, np.inf)
    names = np.zeros(n_docs * k, np.uint64)
    total = np.bincount(doc, weight, n_docs)
    # one region for each started unit of weight
    units = np.ceil(weight).astype(np.int64)
    at = np.repeat(np.arange(len(h)), units)
    unit = np.arange(len(at)) - np.repeat(np.cumsum(units) - units, units)
    region = mix(h[at] + mix(unit.astype(np.uint64) + np.uint64(0x51)))
    own, left = doc[at], weight[at] - unit
    limit = reach * (k * math.log(k) + 2 * k) / total[own]
    rank = np.zeros(len(at))
    arrival = 0
    while len(region):
        arrival += 1
        dart = mix(region + np.uint64(arrival * 0x9E3779B97F4A7C15 % (1 << 64)))
        rank = rank - np.log(_uniform(dart))
        live = rank <= limit
        region, own, left, limit, rank, dart = (x[live] for x in (region, own, left, limit, rank, dart))
        name = mix(dart + np.uint64(1))
        under = left >= 1
        if not under.all():  # the last unit counts in part
            under |= _uniform(mix(dart + np.uint64(2))) < left
        slot = (own * k + (name % np.uint64(k)).astype(np.int64))[under]
        r, name = rank[under], name[under]
        np.minimum.at(best, slot, r)
        won = best[slot] == r
        names[slot[won]] = name[won]
    out = names.reshape(n_docs, k)
    lacking = np.flatnonzero(np.isinf(best).reshape(n_docs, k).any(1) & (total > 0))
    if len(lacking):
        to = np.full(n_docs, -1)
        to[lacking] = np.arange(len(lacking))
        sel = to[doc] >= 0
        out[lacking] = signatures(h[sel], to[doc[sel]], weight[sel], len(lacking), k, 2 * reach)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """Texts x BANDS keys as signed 64-bit numbers; a key holds its band's number."""
    parts = sig.reshape(len(sig), BANDS, ROWS)
    key = np.zeros((len(sig), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        key = mix(key * np.uint64(0xD6E8FEB86659FD93) + parts[:, :, r])
    return key.view(np.int64)


def _sketch(b: pa.RecordBatch) -> dict:
    texts = texts_of(b["text"])
    keys = []
    for i, j in blocks(texts):
        h, doc = shingles(words(texts[i:j]), j - i, WORDS)
        some = np.bincount(doc, minlength=j - i) > 0
        k = band_keys(signatures(*elements(h, doc), j - i))
        keys += [row if ok else None for row, ok in zip(k, some, strict=True)]
    return {"doc_id": b["doc_id"], "h": b["h"], "copy": pa.array([hashlib.sha256(t.encode()).digest()[:16] for t in texts], pa.binary()), "bands": pa.array(keys, pa.list_(pa.int64()))}


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    """Weighted Jaccard likeness of two sorted arrays of shingle hashes."""
    if not len(x) or not len(y):
        return 0.0
    a, n = np.unique(x, return_counts=True)
    b, m = np.unique(y, return_counts=True)
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    low = int(np.minimum(n[i], m[j]).sum())
    return low / (len(x) + len(y) - low)


def _shingled(text: str | None) -> np.ndarray:
    return np.sort(shingles(words([text or ""]), 1, WORDS)[0])


def _coded(text: str | None) -> np.ndarray:
    """A text's shingles, the k-th occurrence of one told apart from the others, so the weighted likeness is that of plain sets."""
    x = _shingled(text)
    nth = np.arange(len(x)) - np.searchsorted(x, x)
    return np.where(nth > 0, mix(x + mix(nth.astype(np.uint64))), x)


@dataclass(frozen=True)
class Measure:
    """How two texts are compared: what is read from a text, the likeness of two readings, a text as a plain set of tokens, and the least Jaccard likeness of two such sets whose texts reach a threshold."""

    read: Callable[[str | None], np.ndarray]
    likeness: Callable[[np.ndarray, np.ndarray], float]
    tokens: Callable[[str | None], np.ndarray]
    jaccard: Callable[[float], float]


SHINGLES = Measure(_shingled, likeness, _coded, lambda t: t)


def verified(pairs: DataFrame, docs: DataFrame, measure: Measure = SHINGLES) -> DataFrame:
    """(a, b, likeness) for pairs (a, h_a, b, h_b) of documents ``docs`` (id, h, text): an id and a hash of the text that stands for it. Rows that repeat both count once."""
    full = pairs
    for c in ("b", "a"):
        hot = hot_keys(pairs.groupBy(c, f"h_{c}").agg(F.count("*").alias("n")), [c, f"h_{c}"])
        full = join_one(full, docs.select(F.col("id").alias(c), F.col("h").alias(f"h_{c}"), F.col("text").alias(f"text_{c}")), [c, f"h_{c}"], hot, by=["a", "b"])
    full = full.select("a", "b", "text_a", "text_b")

    def kernel(b: pa.RecordBatch) -> dict:
        out, last, x = [], None, None
        for a, s, t in zip(b["a"].to_pylist(), b["text_a"].to_pylist(), b["text_b"].to_pylist(), strict=True):
            if x is None or a != last:
                x, last = measure.read(s), a
            out.append(measure.likeness(x, measure.read(t)))
        return {"a": b["a"], "b": b["b"], "likeness": pa.array(out, pa.float64())}

    return arrow_map(full, {c: c for c in full.columns}, "a long, b long, likeness double", kernel)


HASH = "xxhash64(coalesce(text, ''))"


def classes(docs: DataFrame, threshold: float = THRESHOLD, space: Workspace | None = None) -> DataFrame:
    """One row a document: doc_id, class_id (the least doc_id of its class), copy_of (the least doc_id of its exact copies)."""
    space = space or Workspace(docs.sparkSession)
    sketch = space.written(arrow_map(docs, {"doc_id": "doc_id", "text": "text", "h": HASH}, "doc_id long, h long, copy binary, bands array<long>", _sketch), "sketch")
    # of a doc_id's texts the least one stands for it, here and everywhere after
    known = sketch.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("copy", "h", "bands")).alias("t")).select("doc_id", "t.*")
    known = space.written(known, "known")
    reps = space.written(known.groupBy("copy").agg(F.min(F.struct("doc_id", "h", "bands")).alias("r"), F.count("*").alias("n")).select("copy", F.col("r.doc_id").alias("rep"), F.col("r.h").alias("h"), F.col("r.bands").alias("bands"), "n"), "reps")
    named = joined(reps, docs.withColumn("h", F.expr(HASH)), threshold, space)
    class_of = reps.select("copy", "rep").join(named.select(F.col("id").alias("rep"), "label"), "rep", "left").select("copy", "rep", F.coalesce("label", "rep").alias("class_id"))
    rows = join_one(known.select("doc_id", "copy"), class_of, ["copy"], hot_keys(reps, ["copy"])).select("doc_id", "class_id", F.col("rep").alias("copy_of"))
    return rows.unionByName(sketch.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(None).cast("long").alias("copy_of")))


def joined(reps: DataFrame, docs: DataFrame, threshold: float, space: Workspace, measure: Measure = SHINGLES) -> DataFrame:
    """(id, label): the least of each representative's (rep, h, bands) class; ``docs``: doc_id, h, text. Classes connect all that share a bucket and have a likeness of at least the threshold."""
    buckets = reps.select(F.struct("rep", "h").alias("text"), F.explode("bands").alias("key"))
    pivot = lambda *by: F.min(F.struct(F.xxhash64("text.rep", *by).alias("order"), "text"))["text"]
    pivots = F.array_distinct(F.array(F.min("text"), pivot(), pivot("key")))
    size = space.written(buckets.groupBy("key").agg(F.count("*").alias("n"), pivots.alias("pivots")).where("n > 1"), "sizes")
    hot = space.written(hot_keys(size, ["key"]), "hot")
    members = space.written(join_one(buckets, size, ["key"], hot), "members")
    small = members.where(F.col("n") <= ALL_PAIRS).groupBy("key").agg(F.array_sort(F.collect_list("text")).alias("all"))
    # all pairs of a bucket of bounded size: each with those behind it
    pairs = small.select(F.posexplode("all").alias("at", "a"), "all").select("a", F.explode(F.expr("slice(all, at + 2, size(all))")).alias("b"))
    star = members.where(F.col("n") > ALL_PAIRS).select("text", F.explode("pivots").alias("p")).where("text <> p").select(F.least("text", "p").alias("a"), F.greatest("text", "p").alias("b"))
    texts = docs.where("doc_id is not null").select(F.col("doc_id").alias("id"), "h", "text")
    wanted = pairs.union(star).distinct().select(F.col("a.rep").alias("a"), F.col("a.h").alias("h_a"), F.col("b.rep").alias("b"), F.col("b.h").alias("h_b"))
    wanted = space.written(wanted, "pairs")
    space.release()
    done = space.written(verified(wanted, texts, measure), "verified")
    space.release()
    near = done.where(F.col("likeness") >= threshold).select("a", "b")
    # large buckets whose texts the pivots have not joined into one class
    named = components(near, space, "first")
    large = members.where(F.col("n") > ALL_PAIRS).select("key", "text.rep", "text.h").join(named.withColumnRenamed("id", "rep"), "rep", "left").select("key", "rep", "h", F.coalesce("label", "rep").alias("label"))
    apart = large.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
    left = space.written(join_one(large, apart, ["key"], hot).select("rep", "h", "label").distinct(), "left")
    for done in ("members", "sizes", "hot"):
        space.remove(done)
    space.release()
    if left.isEmpty():
        return named
    maybe = space.written(crossing(left, texts, threshold, space, measure).join(wanted, ["a", "b"], "left_anti"), "crossing")
    space.remove("mixed")
    space.release()
    return connected(named, maybe, texts, threshold, space, measure)


def connected(named: DataFrame, maybe: DataFrame, texts: DataFrame, threshold: float, space: Workspace, measure: Measure) -> DataFrame:
    """(id, label): the classes ``named`` after those are joined that a link among ``maybe`` (as ``crossing`` gives them) connects."""
    # the likeliest partner of a text in each other class goes first; then only pairs whose classes are still two
    pair = ["a", "h_a", "b", "h_b"]
    ends = maybe.select(*pair, F.col("a").alias("me"), F.col("label_b").alias("other"), "shared").union(maybe.select(*pair, "b", "label_a", "shared"))
    best = ends.groupBy("me", "other").agg(F.max(F.struct("shared", *pair)).alias("m")).select(*(f"m.{c}" for c in pair)).distinct()
    tried = space.written(_joined(space.written(best, "best"), maybe, texts, threshold, measure), "tried")
    met = components(tried.where("near").select(F.col("label_a").alias("a"), F.col("label_b").alias("b")), space, "second")
    now = lambda c: met.select(F.col("id").alias(f"label_{c}"), F.col("label").alias(f"now_{c}"))
    rest = maybe.join(now("a"), "label_a", "left").join(now("b"), "label_b", "left").where(F.coalesce("now_a", "label_a") != F.coalesce("now_b", "label_b"))
    rest = space.written(rest.select(*pair).join(tried.select("a", "b"), ["a", "b"], "left_anti").select(*pair), "rest")
    space.release()
    found = space.written(_joined(rest, maybe, texts, threshold, measure), "found")
    space.release()
    # one edge for each two classes says as much as all links between them
    edges = tried.union(found).where("near").select(F.col("label_a").alias("a"), F.col("label_b").alias("b")).distinct()
    last = components(edges, space, "last").select(F.col("id").alias("old"), F.col("label").alias("new"))
    # a text that no pivot has joined is its own label
    every = named.unionByName(last.select(F.col("old").alias("id"), F.col("old").alias("label"))).distinct()
    return every.join(last, F.col("label") == F.col("old"), "left").select("id", F.coalesce("new", "label").alias("label"))


def _joined(pairs: DataFrame, known: DataFrame, texts: DataFrame, threshold: float, measure: Measure) -> DataFrame:
    """a, b, label_a, label_b of ``pairs``, and whether they are near."""
    done = verified(pairs, texts, measure).groupBy("a", "b").agg((F.max("likeness") >= threshold).alias("near"))
    return done.join(known, ["a", "b"]).select("a", "b", "label_a", "label_b", "near")


def crossing(left: DataFrame, texts: DataFrame, threshold: float, space: Workspace, measure: Measure = SHINGLES) -> DataFrame:
    """a, h_a, b, h_b, label_a, label_b with a < b, and how many of their rarest tokens they share: pairs of different label among ``left`` (rep, h, label) that may be alike enough; none that is gets lost.

    Tokens are ordered from the rarest to the most common. Of two texts of n <= m tokens, alike enough, at least t m and 2t / (1 + t) n
    tokens are common, so the first common one is among the first m - t m + 1 of the larger and n - 2t / (1 + t) n + 1 of the smaller text, and
    enough tokens come after it in both. Of the label that most texts with a token have, none is compared with another."""
    t = measure.jaccard(threshold)

    def tokens(b: pa.RecordBatch) -> dict:
        out = [measure.tokens(x).view(np.int64) for x in b["text"].to_pylist()]
        return {c: b[c] for c in ("rep", "h", "label")} | {"n": pa.array([len(x) for x in out], pa.int32()), "tokens": pa.array(out, pa.list_(pa.int64()))}

    rows = left.join(texts.withColumnRenamed("id", "rep"), ["rep", "h"]).dropDuplicates(["rep"])
    listed = space.written(arrow_map(rows, {c: c for c in ("rep", "h", "label", "text")}, "rep long, h long, label long, n int, tokens array<long>", tokens), "tokens")
    each = listed.select("rep", "h", "label", "n", F.explode("tokens").alias("token"))
    often = space.written(each.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "often")
    common = space.written(hot_keys(often, ["token"], "df"), "common")
    shared = join_one(each, often, ["token"], common, by=["rep", "token"]).groupBy("rep", "h", "label", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("all"))
    # tokens that no other text has come before these
    shared = shared.withColumn("own", F.col("n") - F.size("all")).withColumn("probe", F.expr(f"int(n - ceil({t}D * n - 1e-9D) + 1)"))
    spread = shared.select("rep", "h", "label", "n", "own", F.posexplode(F.expr("slice(all, 1, greatest(probe - own, 0))")).alias("k", "s"))
    at = spread.select("rep", "h", "label", "n", (F.col("own") + F.col("k")).alias("at"), "s.token").withColumn("first", F.expr(f"at < n - ceil({2 * t / (1 + t)}D * n - 1e-9D) + 1"))
    places = space.written(at, "places")
    for done in ("tokens", "often", "common"):
        space.remove(done)
    space.release()
    labels = places.groupBy("token", "label").agg(F.count("*").alias("c")).groupBy("token").agg(F.max(F.struct("c", "label"))["label"].alias("main"), F.count("*").alias("labels")).where("labels > 1")
    busy = space.written(hot_keys(places.groupBy("token").agg(F.count("*").alias("n")), ["token"]), "busy")
    mixed = space.written(join_one(places, labels.select("token", "main"), ["token"], busy, by=["rep", "token"]), "mixed")
    for done in ("places", "busy"):
        space.remove(done)
    space.release()
    x, y = mixed.where("label <> main").alias("x"), mixed.alias("y")
    meet = F.expr(f"""x.token = y.token and x.label <> y.label and (x.n <= y.n and x.first or y.n <= x.n and y.first)
        and least(x.n, y.n) >= {t}D * greatest(x.n, y.n) - 1e-9D and least(x.n - x.at, y.n - y.at) >= {t / (1 + t)}D * (x.n + y.n) - 1e-9D""")
    order = F.col("x.rep") < F.col("y.rep")
    side = lambda c: (F.when(order, F.col(f"x.{c}")).otherwise(F.col(f"y.{c}")), F.when(order, F.col(f"y.{c}")).otherwise(F.col(f"x.{c}")))
    named = [c.alias(f"{n}{e}") for f, n in (("rep", ""), ("h", "h_"), ("label", "label_")) for c, e in zip(side(f), "ab", strict=True)]
    return x.join(y, meet).select(*named).groupBy("a", "h_a", "b", "h_b", "label_a", "label_b").agg(F.count("*").alias("shared"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each class, the one with the least doc_id; rows with a null doc_id stay."""
    named = classes(docs.select("doc_id", "text"), threshold)
    gone = named.where("doc_id <> class_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
