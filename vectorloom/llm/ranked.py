"""Ranked lexical search over a tiered index.

The index holds a row a document, with postings (term, impact) of the terms that items ask for, in columns by tier: the impacts of highest weight first. An impact is a
term's weight times its saturated frequency in the document, in integers. Each tier is a column of its own, so a search of high tiers reads nothing of the lower ones. For each
term a tier has a residual bound: the greatest impact that lies below it.

Items are looked up tier by tier. Adding up the impacts down to a tier gives each document a score from below; with the residuals of the terms not met it gives one from
above. An item is proved at a tier if its wanted number of documents score more, from below, than any document that the tier has not met could reach. Then only documents whose bound from
above reaches the last of these are scored in full, from their lower columns. Items without proof fall through to the next tier; the last one holds
everything, so it is exact by itself. Results are exact at every tier.

Every task keeps a running list of the best documents of each item and hands on only that. Items are worked on in blocks of about ``BLOCK``, so what
driver and tasks hold of them is bounded; each block is one run over the documents. A term is told by a 64-bit hash.

Cases: null and empty texts have no terms, so they are not counted and never found, and items without terms find nothing; rows that repeat a doc_id are documents of
their own; a null doc_id comes last among equal scores; of rows that repeat an item_id, the least text counts; a null item_id is an item; empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrowmap import ROWS, arrow_map, texts_of
from .storage import Workspace
from .textcore import blocks, code_points, mix

MOST = 20
BLOCK = 512
#: Shares of all postings that lie in the first tier, and in the first two.
SHARES = (0.1, 0.5)
TIERS = len(SHARES) + 1


def terms(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of each term of a block: maximal runs of ASCII letters and digits and of all characters from U+0080 on, A to Z lower-cased."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    cp = code_points("\n".join(texts))
    base = np.concatenate(([0], np.cumsum(lens[:-1] + 1)))
    upper = (cp >= 65) & (cp <= 90)
    word = upper | ((cp >= 97) & (cp <= 122)) | ((cp >= 48) & (cp <= 57)) | (cp >= 128)
    step = np.diff(np.concatenate(([False], word, [False])).astype(np.int8))
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    size = end - start
    at = np.cumsum(size) - size
    own = (cp + 32 * upper.astype(np.uint32))[word].astype(np.uint64)
    own |= (np.arange(len(own)) - np.repeat(at, size)).astype(np.uint64) << np.uint64(21)
    return mix(np.add.reduceat(mix(own), at) + size.astype(np.uint64)), np.searchsorted(base, start, "right") - 1


def counted(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, term) in that order, and how often each occurs."""
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))) if len(h) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.append(at, len(h)))


def _asked(b: pa.RecordBatch) -> dict:
    texts, of, term, n = texts_of(b["text"]), [], [], []
    for i, j in blocks(texts):
        d, h, k = counted(*terms(texts[i:j]))
        of.append(i + d)
        term.append(h.view(np.int64))
        n.append(k)
    return {"item_id": b["item_id"].take(pa.array(np.concatenate(of))), "term": pa.array(np.concatenate(term)), "n": pa.array(np.concatenate(n).astype(np.int64))}


@dataclass
class Items:
    """A block of items: their ids, their terms' hashes in ascending order, and by term which items ask for it how often."""

    ids: list
    vocabulary: np.ndarray
    start: np.ndarray
    item: np.ndarray
    often: np.ndarray

    @classmethod
    def of(cls, rows: list) -> Items:
        ids = sorted({r["item_id"] for r in rows}, key=lambda x: (x is None, x or 0))
        number = {x: i for i, x in enumerate(ids)}
        h = np.array([r["term"] for r in rows], np.int64).view(np.uint64)
        vocabulary, at = np.unique(h, return_inverse=True)
        order = np.argsort(at, kind="stable")
        return cls(ids, vocabulary, np.concatenate(([0], np.cumsum(np.bincount(at, minlength=len(vocabulary))))), np.array([number[r["item_id"]] for r in rows])[order], np.array([r["n"] for r in rows], np.int64)[order])

    def among(self, which: np.ndarray) -> Items:
        """Only some items' terms, under the same numbers."""
        keep = np.isin(self.item, which)
        kept = np.concatenate(([0], np.cumsum(keep)))
        return Items(self.ids, self.vocabulary, kept[self.start], self.item[keep], self.often[keep])

    def added(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_docs: int) -> np.ndarray:
        """Items x documents: impacts summed over the items' terms."""
        size = self.start[term + 1] - self.start[term]
        at = np.repeat(self.start[term] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        out = np.zeros(len(self.ids) * n_docs, np.int64)
        np.add.at(out, self.item[at] * n_docs + np.repeat(doc, size), self.often[at] * np.repeat(impact, size))
        return out.reshape(len(self.ids), n_docs)


def _lists(of: np.ndarray, n: int, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Values, in the order of their rows, as a list for each of n rows."""
    ends = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=n)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))


def _postings(vocabulary: np.ndarray):
    def kernel(b: pa.RecordBatch) -> dict:
        texts, length, of, term, often = texts_of(b["text"]), [], [], [], []
        for i, j in blocks(texts):
            h, doc = terms(texts[i:j])
            length.append(np.bincount(doc, minlength=j - i))
            at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
            hit = vocabulary[at] == h
            d, t, k = counted(at[hit].astype(np.uint64), doc[hit])
            of.append(i + d)
            term.append(t)
            often.append(k)
        d, n = np.concatenate(of), b.num_rows
        return {"doc_id": b["doc_id"], "length": pa.array(np.concatenate(length).astype(np.int64)), "term": _lists(d, n, np.concatenate(term).astype(np.int32), pa.int32()), "often": _lists(d, n, np.concatenate(often).astype(np.int64), pa.int64())}

    return kernel


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and values of a column of lists."""
    size = np.diff(column.offsets.to_numpy())
    return np.repeat(np.arange(len(size)), size), column.flatten().to_numpy()


@dataclass
class Weights:
    """What impacts need: a weight by term, the number of documents with terms, and all their terms' number."""

    term: np.ndarray
    documents: int
    total: int

    def impacts(self, b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        doc, term = _flat(b["term"])
        often = _flat(b["often"])[1]
        m = 100 - 25 + (25 * b["length"].to_numpy() * self.documents) // self.total
        return doc, term, self.term[term] * ((1_000_000_000 * often) // (1000 * often + 12 * m[doc]))


def _weighed(weights: Weights):
    def kernel(b: pa.RecordBatch) -> dict:
        return {"impact": pa.array(weights.impacts(b)[2])}

    return kernel


def _tiered(weights: Weights, cuts: list[int]):
    def kernel(b: pa.RecordBatch) -> dict:
        doc, term, impact = weights.impacts(b)
        out, tier = {"doc_id": b["doc_id"]}, np.searchsorted(-np.array(cuts), -impact)
        for k in range(TIERS):
            own = (tier == k) & (impact > 0)
            out[f"term{k}"] = _lists(doc[own], b.num_rows, term[own], pa.int32())
            out[f"impact{k}"] = _lists(doc[own], b.num_rows, impact[own], pa.int64())
        return out

    return kernel


_TIERED = "doc_id long, " + ", ".join(f"term{k} array<int>, impact{k} array<long>" for k in range(TIERS))


@dataclass
class Index:
    """``tiers``: doc_id and the postings of each tier; ``residual``: by tier and term, the greatest impact below the tier."""

    tiers: DataFrame
    residual: np.ndarray

    def columns(self, upto: int) -> list[str]:
        return ["doc_id", *(f"{c}{k}" for k in range(upto + 1) for c in ("term", "impact"))]


def index(docs: DataFrame, vocabulary: np.ndarray, space: Workspace, name: str = "") -> Index | None:
    """The tiered index of ``docs`` for the terms of a vocabulary; none if no document holds any."""
    slots = space.written(arrow_map(docs, {"doc_id": "doc_id", "text": "text"}, "doc_id long, length long, term array<int>, often array<long>", _postings(vocabulary)).where("length > 0"), f"postings{name}")
    documents, total = slots.agg(F.count("*"), F.sum("length")).first()
    df = np.zeros(len(vocabulary), np.int64)
    for r in slots.select(F.explode("term").alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect():  # a block's vocabulary at most
        df[r["term"]] = r["n"]
    if not df.any():
        return None
    weights = Weights(np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for n in df.tolist()], np.int64), documents, total)
    impact = arrow_map(slots, {c: c for c in ("length", "term", "often")}, "impact array<long>".replace("array<long>", "long"), _weighed(weights))
    cuts = impact.agg(F.percentile_approx("impact", [1 - s for s in SHARES], 1000).alias("q")).first()["q"]
    tiers = space.written(arrow_map(slots, {c: c for c in slots.columns}, _TIERED, _tiered(weights, cuts)), f"tiers{name}")
    space.remove(f"postings{name}")
    residual = np.zeros((TIERS, len(vocabulary)), np.int64)
    for k in range(1, TIERS):
        found = tiers.select(F.explode(F.arrays_zip(f"term{k}", f"impact{k}")).alias("p")).groupBy(F.col(f"p.term{k}").alias("term")).agg(F.max(f"p.impact{k}").alias("most"))
        for r in found.collect():  # a block's vocabulary at most
            residual[:k, r["term"]] = np.maximum(residual[:k, r["term"]], r["most"])
    return Index(tiers, residual)


class Best:
    """The best documents of each item so far: by score, then by document."""

    def __init__(self, n_items: int, most: int):
        self.most, self.least = most, np.ones(n_items, np.int64)
        self.rows = [np.zeros(0, np.int64) for _ in range(4)]  # item, score, none, id

    def offer(self, score: np.ndarray, none: np.ndarray, ids: np.ndarray, which: np.ndarray | None = None) -> None:
        """``score``: items x documents; 0 is no hit. ``which``: only these."""
        good = score >= self.least[:, None]
        item, doc = np.nonzero(good if which is None else good & which)
        item, points, none, ids = (np.concatenate(x) for x in zip(self.rows, (item, score[item, doc], none[doc], ids[doc]), strict=True))
        order = np.lexsort((ids, none, -points, item))
        item = item[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        full = place == self.most - 1
        self.least[item[full]] = points[order][full]
        keep = order[place < self.most]
        self.rows = [item[place < self.most], points[keep], none[keep], ids[keep]]


def _scan(items: Items, upto: int, most: int, proof: tuple[np.ndarray, np.ndarray, np.ndarray] | None):
    """Best documents by the scores down to a tier. With ``proof`` (residual by term, and by item its sum of residuals and the score to reach), by full scores of the documents that may reach it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(items.ids), most)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                b = batch.slice(at, ROWS)
                n = b.num_rows
                part = lambda tiers: tuple(np.concatenate(x) for x in zip(*((*_flat(b[f"term{k}"]), _flat(b[f"impact{k}"])[1]) for k in tiers), strict=True))  # noqa: B023, E731
                doc, term, impact = part(range(upto + 1))
                score, which = items.added(doc, term, impact, n), None
                if proof:
                    residual, rest, reach = proof
                    above = items.added(doc, term, impact - residual[term], n) + rest[:, None]
                    which = (score > 0) & (above >= reach[:, None])
                    doc, term, impact = part(range(upto + 1, TIERS))
                    few = which.any(0)[doc]  # documents that no item needs are not scored further
                    score = score + items.added(doc[few], term[few], impact[few], n)
                best.offer(score, b["doc_id"].is_null().to_numpy(zero_copy_only=False).astype(np.int64), b["doc_id"].fill_null(0).to_numpy(), which)
        item, points, none, ids = best.rows
        yield pa.RecordBatch.from_pydict({"item": pa.array(item.astype(np.int32)), "item_id": pa.array([items.ids[i] for i in item], pa.int64()), "score": pa.array(points), "doc_id": pa.array(ids, pa.int64(), mask=none > 0)})

    return run


def _top(tiers: DataFrame, items: Items, upto: int, most: int, proof=None) -> DataFrame:
    """item, item_id, score, doc_id, rank of the best rows; what a task hands on is cut to the best before it is shuffled."""
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return tiers.mapInArrow(_scan(items, upto, most, proof), "item int, item_id long, score long, doc_id long").withColumn("rank", rank).where(F.col("rank") <= most)


def _found(known: Index, items: Items, most: int, space: Workspace, name: str) -> list[DataFrame]:
    """The block's results, tier by tier."""
    out, left = [], np.arange(len(items.ids))
    for k in range(TIERS - 1):
        asking = items.among(left)
        # the residuals of all of an item's terms: what a document that the tier has not met may reach
        term = np.repeat(np.arange(len(items.vocabulary)), np.diff(asking.start))
        rest = np.zeros(len(items.ids), np.int64)
        np.add.at(rest, asking.item, asking.often * known.residual[k][term])
        reach = np.zeros(len(items.ids), np.int64)
        for r in _top(known.tiers.select(known.columns(k)), asking, k, most).where(F.col("rank") == most).select("item", "score").collect():  # a row an item
            reach[r["item"]] = r["score"]
        proved = left[(rest[left] < reach[left]) | (rest[left] == 0)]
        if len(proved):
            out.append(space.written(_top(known.tiers, items.among(proved), k, most, (known.residual[k], rest, reach)), f"found{name}-{k}"))
            left = np.setdiff1d(left, proved)
        if not len(left):
            return out
    return [*out, space.written(_top(known.tiers, items.among(left), TIERS - 1, most), f"found{name}-{TIERS - 1}")]


def search(docs: DataFrame, items: DataFrame, most: int = MOST, space: Workspace | None = None) -> DataFrame:
    """item_id, rank, doc_id, score: each item's ``most`` best documents with a score above 0."""
    space = space or Workspace(docs.sparkSession)
    one = items.groupBy("item_id").agg(F.min("text").alias("text"))
    asked = space.written(arrow_map(one, {"item_id": "item_id", "text": "text"}, "item_id long, term long, n long", _asked), "items")
    n = max(1, math.ceil(asked.select("item_id").distinct().count() / BLOCK))
    found = []
    for k in range(n):
        rows = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).collect()  # about BLOCK items
        if not rows:
            continue
        block = Items.of(rows)
        known = index(docs, block.vocabulary, space, f"-{k}")
        if known is not None:
            found += _found(known, block, most, space, f"-{k}")
            space.remove(f"tiers-{k}")
    if not found:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select("item_id", "rank", "doc_id", "score")
