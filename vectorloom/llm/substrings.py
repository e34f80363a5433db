"""Removes words of passages that occur earlier, by level-wise doubling.

Levels go from a short length to the wanted one, each about twice the last (5, 10, 20 words). A level looks at windows of its length and needs
only one of them for each window of the wanted length that is still a candidate: the one with the least hash among those inside it, so equal windows choose
equal parts. Candidates whose part occurs once go; the others are extended to twice the length and looked at again, until the wanted
length is reached or no candidate survives. At the wanted length all candidates are judged: a repeated window's earliest place stays; of every other
one the words go. Windows are judged on the input.

Word and window hashes at the wanted length have 128 bits, of two families of mixed numbers a character and place; those that only propose
candidates have 64, where a collision just adds a candidate. Hot passages: counts and first places are aggregated before the shuffle, and where places
meet counts, rows of hot keys are dealt to many tasks (``skew.join_one``).

Cases: null and empty texts have no words; texts with fewer words than a window lose none; rows that repeat a doc_id
and text do not count as earlier than one another; of rows with one doc_id and different texts, the one with the lesser hash
is the earlier; a null doc_id counts as greater than all others; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowmap import arrow_map, texts_of
from .skew import hot_keys, join_one
from .storage import Workspace
from .textcore import Words, blocks, mix, words

WINDOW = 20
#: No level is shorter.
SHORTEST = 5
_SPACES = re.compile("[\x20\x09-\x0d]+")
_WORD = re.compile("[^\x20\x09-\x0d]+")
#: A text's name: whether its doc_id is null, its doc_id, and a hash that tells apart texts of one doc_id.
_KEYS = {"none": "doc_id is null", "id": "coalesce(doc_id, 0L)", "h": "hash(coalesce(text, ''))"}
_NAME = "none boolean, id long, h int"


def levels(wide: int) -> list[int]:
    """Window lengths from the shortest to the wanted one."""
    out = [wide]
    while (out[0] + 1) // 2 >= SHORTEST:
        out.insert(0, (out[0] + 1) // 2)
    return out


def windows(base: np.ndarray, n: int, mult: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """Hash of each run of n of the block's words (``base``: their hashes), built by doubling: a run's hash joins those of its halves."""
    if n == 1:
        return base
    half, k = n // 2, len(base) - n + 1
    if k <= 0:
        return np.zeros(0, np.uint64)
    h = windows(base, half, mult)
    h = mix(h[: k + n - 2 * half] * np.uint64(mult) + h[half : half + k + n - 2 * half])
    if n % 2:
        h = mix(h[:k] * np.uint64(mult) + base[n - 1 :])
    return h[:k]


def inside(w: Words, n: int) -> np.ndarray:
    """Whether each run of n words lies in one text."""
    k = max(0, len(w.doc) - n + 1)
    return w.doc[:k] == w.doc[len(w.doc) - k :]


def chosen(h: np.ndarray, n: int, wide: int, total: int) -> np.ndarray:
    """For each of a block's windows of ``wide`` words: which window of n words inside it has the least hash (the first of them); ``h``: their hashes."""
    k = total - wide + 1
    if k <= 0:
        return np.zeros(0, np.int64)
    least, at = h[:k].copy(), np.zeros(k, np.int64)
    for q in range(1, wide - n + 1):
        other = h[q : q + k]
        better = other < least
        np.copyto(least, other, where=better)
        at[better] = q
    return at + np.arange(k)


def _firsts(w: Words, n_docs: int) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(np.bincount(w.doc, minlength=n_docs))))


def _member(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    return np.isin(values, of) if len(of) else np.zeros(len(values), bool)


def _in_block(lists: list[np.ndarray], first: np.ndarray) -> np.ndarray:
    """Places in texts as places in their block."""
    return np.concatenate([x + f for x, f in zip(lists, first[:-1], strict=True)])


def _candidates(w: Words, wide: int, n: int | None, hits: np.ndarray | None) -> np.ndarray:
    """Places of windows of ``wide`` words whose chosen part of n words is among ``hits`` (n None: all); all in the block's numbers."""
    ok = inside(w, wide)
    return np.flatnonzero(ok if n is None else ok & _member(chosen(windows(w.hash, n), n, wide, len(w.hash)), hits))


def _lists(column: pa.Array) -> list[np.ndarray]:
    values, offsets = column.flatten().to_numpy(), column.offsets.to_numpy()
    full = np.zeros(len(column), np.int64)
    full[:] = np.diff(offsets)
    return np.split(values, np.cumsum(full)[:-1])


def _flag(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(bool)


def _named(b: pa.RecordBatch, of: np.ndarray) -> dict:
    """Names of the texts ``of`` which rows are."""
    take = pa.array(of)
    return {c: b[c].take(take) for c in ("none", "id", "h")}


def _propose(before: int | None, n: int, wide: int):
    def kernel(b: pa.RecordBatch) -> dict:
        texts = texts_of(b["text"])
        hits = _lists(b["hits"]) if before else None
        key, of, place = [], [], []
        for i, j in blocks(texts):
            w = words(texts[i:j])
            first = _firsts(w, j - i)
            at = _candidates(w, wide, before, _in_block(hits[i:j], first) if before else None)
            h = windows(w.hash, n)
            at = np.unique(chosen(h, n, wide, len(w.hash))[at])
            key.append(h[at].view(np.int64))
            of.append(i + w.doc[at])
            place.append(at - first[w.doc[at]])
        return {"key": pa.array(np.concatenate(key))} | _named(b, np.concatenate(of)) | {"at": pa.array(np.concatenate(place).astype(np.int32))}

    return kernel


def ordered(none: np.ndarray, ids: np.ndarray) -> bool:
    """Whether the texts of a block come in order of their ids, none twice."""
    return not none.any() and bool((np.diff(ids) > 0).all())


def _judge(n: int | None, wide: int):
    def kernel(b: pa.RecordBatch) -> dict:
        texts, none, ids = texts_of(b["text"]), _flag(b["none"]), b["id"].to_numpy()
        hits = _lists(b["hits"]) if n else None
        key, key2, of, place = [], [], [], []
        for i, j in blocks(texts):
            w = words(texts[i:j], second=True)
            first = _firsts(w, j - i)
            at = _candidates(w, wide, n, _in_block(hits[i:j], first) if n else None)
            one, two = windows(w.hash, wide)[at], windows(w.second, wide, 0xA24BAED4963EE407)[at]
            if ordered(none[i:j], ids[i:j]):  # a window that its block has already shown is not first, but stays a candidate
                order = np.lexsort((at, two, one))
                new = np.ones(len(at), bool)
                new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
                keep = np.sort(order[new])
                at, one, two = at[keep], one[keep], two[keep]
            key.append(one.view(np.int64))
            key2.append(two.view(np.int64))
            of.append(i + w.doc[at])
            place.append(at - first[w.doc[at]])
        return {"key": pa.array(np.concatenate(key)), "key2": pa.array(np.concatenate(key2))} | _named(b, np.concatenate(of)) | {"at": pa.array(np.concatenate(place).astype(np.int32))}

    return kernel


def _remove(n: int | None, wide: int, texts_too: bool):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()

    def kernel(b: pa.RecordBatch) -> dict:
        texts, hits, stay = texts_of(b["text"]), _lists(b["hits"]), _lists(b["stay"])
        total, gone, kept = [], [], []
        for i, j in blocks(texts):
            w = words(texts[i:j])
            first = _firsts(w, j - i)
            lost = np.zeros(len(w.hash) + 1, np.int64)
            here, there = _in_block(hits[i:j], first), _in_block(stay[i:j], first)
            if len(here) or n is None:
                at = _candidates(w, wide, n, here)
                at = at[~_member(at, there)]
                np.add.at(lost, at, 1)
                np.add.at(lost, at + wide, -1)
            lost = np.cumsum(lost)[:-1] > 0
            for k, text in enumerate(texts[i:j]):
                drop = lost[first[k] : first[k + 1]]
                total.append(len(drop))
                gone.append(int(drop.sum()))
                if gone[-1]:
                    kept.append(" ".join([x for x, no in zip(_WORD.findall(text), drop.tolist(), strict=True) if not no]))
                else:
                    kept.append(_SPACES.sub(" ", text).strip(" "))
        out = {"doc_id": b["doc_id"], "n_words": pa.array(total, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept_sha256": pa.array([sha(x) for x in kept], pa.string())}
        return out | ({"kept": pa.array(kept, pa.string())} if texts_too else {})

    return kernel


def repeated(docs: DataFrame, wide: int, space: Workspace) -> tuple[DataFrame, DataFrame, int | None]:
    """By text name: ``hits``, places of repeated windows of the last level before ``wide``; ``stay``, places of candidate windows of ``wide`` words that are first. And that level's length."""
    name = list(_KEYS)
    rows = docs.selectExpr(*(f"{e} AS {c}" for c, e in _KEYS.items()), "text")
    hits, before = None, None
    for n in levels(wide)[:-1]:
        source = rows if hits is None else rows.join(hits, name)
        parts = space.written(arrow_map(source, {c: c for c in source.columns}, f"key long, {_NAME}, at int", _propose(before, n, wide)), f"parts-{n}")
        space.release()
        often = space.written(parts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), f"often-{n}")
        hot = space.written(hot_keys(often, ["key"]), f"hot-{n}")
        hits = space.written(join_one(parts, often.select("key"), ["key"], hot).groupBy(name).agg(F.collect_set("at").alias("hits")), f"hits-{n}")
        before = n
        space.remove(f"parts-{n}")
        space.release()
        if hits.isEmpty():
            break  # no candidate survives
    source = rows if hits is None else rows.join(hits, name)
    judged = arrow_map(source, {c: c for c in source.columns}, f"key long, key2 long, {_NAME}, at int", _judge(before, wide))
    first = judged.groupBy("key", "key2").agg(F.min(F.struct(*name, "at")).alias("f"))
    stay = space.written(first.select("f.*").groupBy(name).agg(F.collect_set("at").alias("stay")), "stay")
    space.release()
    return stay.select(*name, F.array().cast("array<int>").alias("hits")).limit(0) if hits is None else hits, stay, before


def dedup(docs: DataFrame, wide: int = WINDOW, texts: bool = False, space: Workspace | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept: the words left, joined by one space."""
    space = space or Workspace(docs.sparkSession)
    hits, stay, n = repeated(docs, wide, space)
    none = F.array().cast("array<int>")
    rows = docs.selectExpr("doc_id", *(f"{e} AS {c}" for c, e in _KEYS.items()), "text").join(hits.join(stay, list(_KEYS), "full"), list(_KEYS), "left")
    rows = rows.select("doc_id", "text", F.coalesce("hits", none).alias("hits"), F.coalesce("stay", none).alias("stay"))
    return arrow_map(rows, {c: c for c in rows.columns}, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts, _remove(n, wide, texts))
