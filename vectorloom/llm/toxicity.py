"""Toxic spans and document scores by a linear-chain conditional random field.

Tokens of a bounded, labelled sample get labels from their documents' labels: in a toxic document, a token is
toxic if its word or one of its prefixes occurs in several toxic sample documents and in next to no clean one.
The field (states: clean, toxic) learns from these labelled tokens. Forward-backward marginals give each token's
probability; their sum and their maximum give the document's score by a logistic function fitted on the same
sample, and runs of tokens above one half are the offending offsets.

Only texts enter a score. Cases: null and empty texts have no tokens and get the score of no evidence;
repeated rows give repeated results; an empty table gives an empty result; without both labels in the
sample every score is the share of toxic labels.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crf
from .arrowmap import arrow_map, texts_of
from .sampling import below, bound
from .textcore import blocks, mix, tokenize

#: The sample: so many toxic and clean rows at most, each of at most so many characters.
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_CHARS = 800, 1200, 50_000
#: Characters of the sample's documents whose tokens the field is fitted on.
FIT_CHARS = 1_500_000
THRESHOLD = 0.3


def held_out(doc_id="doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def features(t) -> list[np.ndarray]:
    word = t.word()
    near = np.zeros_like(word)
    near[1:] = np.where(t.doc[1:] == t.doc[:-1], word[:-1], 0)
    return [word, t.prefix(3), t.prefix(4), t.prefix(5), mix(near + np.uint64(77))]


@dataclass
class ToxicityModel:
    field: crf.Model | None
    coef: np.ndarray  # constant, log(1 + sum of marginals), maximum
    prior: float

    def tokens(self, texts: list[str]):
        """For each block: first text's number, its tokens and their probability of being toxic."""
        for i, j in blocks(texts):
            t = tokenize(texts[i:j])
            if len(t.start) and self.field is not None:
                yield i, j, t, crf.marginals(self.field, self.field.emissions(features(t)), t.doc, j - i)[:, 1]

    def evidence(self, texts: list[str], spans: list[list[str]] | None = None) -> np.ndarray:
        """Sum and maximum of each text's marginals; appends start:end of toxic runs to ``spans``."""
        out = np.zeros((len(texts), 2))
        for i, j, t, p in self.tokens(texts):
            out[i:j, 0] = np.bincount(t.doc, np.where(p > 0.01, p, 0), j - i)
            hot = np.flatnonzero(p > 0.01)
            np.maximum.at(out[:, 1], i + t.doc[hot], p[hot])
            if spans is not None:
                at = np.flatnonzero(p > 0.5)
                last = -2
                for n in at:
                    d = t.doc[n]
                    s, e = t.start[n] - t.base[d], t.end[n] - t.base[d]
                    own = spans[i + d]
                    if n == last + 1 and own and t.doc[last] == d:
                        own[-1] = f"{own[-1].split(':')[0]}:{e}"
                    else:
                        own.append(f"{s}:{e}")
                    last = n
        return out

    def score(self, evidence: np.ndarray) -> np.ndarray:
        if self.field is None:
            return np.full(len(evidence), self.prior)
        z = self.coef[0] + self.coef[1] * np.log1p(evidence[:, 0]) + self.coef[2] * evidence[:, 1]
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def copies(t, n: int) -> np.ndarray:
    """A group for each text: near copies share their least hash of three tokens, and count as one document."""
    w = t.word()
    three = mix(w[:-2] + np.uint64(3) * w[1:-1] + np.uint64(5) * w[2:]) if len(w) > 2 else w[:0]
    least = np.arange(n, dtype=np.uint64)
    inside = t.doc[2:] == t.doc[:-2]
    if inside.any():
        low = np.full(n, np.iinfo(np.uint64).max, np.uint64)
        np.minimum.at(low, t.doc[2:][inside], three[inside])
        least = np.where(low == np.iinfo(np.uint64).max, least, low)
    return np.unique(least, return_inverse=True)[1]


def labelled_tokens(t, toxic: np.ndarray) -> np.ndarray:
    """1 for tokens of toxic documents of which a word or prefix speaks for toxicity."""
    group = copies(t, len(toxic))
    n_toxic, n_clean = len(np.unique(group[toxic])), len(np.unique(group[~toxic]))
    least = max(3, round(0.015 * n_toxic))
    gold = np.zeros(len(t.start), np.int64)
    for keys in (t.word(), t.prefix(4), t.prefix(5)):
        names, at = np.unique(keys, return_inverse=True)
        df = []
        for side in (toxic, ~toxic):
            own = side[t.doc]
            pairs = np.unique(at[own] * np.int64(len(toxic)) + group[t.doc[own]])
            df.append(np.bincount(pairs // len(toxic), minlength=len(names)))
        odds = np.log((df[0] + 0.5) / (n_toxic + 1)) - np.log((df[1] + 0.5) / (n_clean + 1))
        gold |= (df[0] >= least)[at] & (odds > 3)[at] & toxic[t.doc]
    return gold


def balanced(order: np.ndarray, toxic: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """Texts for the field: in the given order, toxic and clean ones up to half of FIT_CHARS each."""
    return np.sort(np.concatenate([side[: max(1, np.searchsorted(np.cumsum(chars[side]), FIT_CHARS // 2))] for side in (order[toxic[order]], order[~toxic[order]])]))


def fit_field(t, gold: np.ndarray, take: np.ndarray) -> crf.Model:
    """The field for the texts ``take``."""
    rank = np.full(len(t.base), -1)
    rank[take] = np.arange(len(take))
    own = rank[t.doc] >= 0
    return crf.fit([f[own] for f in features(t)], gold[own], rank[t.doc[own]], len(take), 2, bits=18)


def fit_texts(texts: list[str], toxic: list[bool], shares: tuple[float, float] = (1.0, 1.0)) -> ToxicityModel:
    """``shares``: of all labelled clean and toxic rows, how large a part the sample has; they undo its balance."""
    y = np.array(toxic, bool)
    prior = float(y.mean()) if len(y) else 0.0
    if not len(y) or y.all() or not y.any():
        return ToxicityModel(None, np.zeros(3), prior)
    t = tokenize(texts)
    gold = labelled_tokens(t, y)
    order = np.random.default_rng(7).permutation(len(texts))
    take = balanced(order, y, np.array([len(x) for x in texts]))
    model = ToxicityModel(fit_field(t, gold, take), np.zeros(3), prior)
    e = model.evidence(texts)
    x = np.column_stack([np.ones(len(y)), np.log1p(e[:, 0]), e[:, 1]])
    w = np.where(y, 1 / shares[1], 1 / shares[0])
    w = w * len(w) / w.sum()
    for _ in range(30):  # Newton's method with a little ridge
        p = 1 / (1 + np.exp(-np.clip(x @ model.coef, -35, 35)))
        g = x.T @ (w * (y - p)) - 0.05 * model.coef
        h = (x * (w * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(3)
        model.coef = model.coef + np.linalg.solve(h, g)
    return model


def fit(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Learns from a sample of the labelled rows that aren't held out, chosen by a hash of their id."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg((F.max("toxic") > 0).alias("y"))
    count = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    most = {False: SAMPLE_CLEAN, True: SAMPLE_TOXIC}
    share = {y: min(1.0, most[y] / max(1, count.get(y, 0))) for y in most}
    cut = {y: bound(most[y], count.get(y, 0)) for y in most}
    h = F.xxhash64("doc_id")
    chosen = known.where((F.col("y") & below(h, cut[True])) | (~F.col("y") & below(h, cut[False])))
    if count and chosen.isEmpty():
        raise ValueError("the sample to fit on is empty")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen.limit(2 * (SAMPLE_CLEAN + SAMPLE_TOXIC))), "doc_id").where(F.length("text") <= SAMPLE_CHARS).select("text", "y").limit(2 * (SAMPLE_CLEAN + SAMPLE_TOXIC))
    kept = sorted({(r["text"], r["y"]) for r in rows.toLocalIterator()})
    return fit_texts([t for t, _ in kept], [y for _, y in kept], (share[False], share[True]))


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, held_out, score, predicted, n_toxic (expected toxic tokens), offsets (start:end of toxic runs, code points)."""

    def kernel(b: pa.RecordBatch) -> dict:
        texts = texts_of(b["text"])
        spans: list[list[str]] = [[] for _ in texts]
        e = model.evidence(texts, spans)
        s = model.score(e)
        return {"doc_id": b["doc_id"], "held_out": b["held_out"], "score": pa.array(s), "predicted": pa.array((s >= THRESHOLD).astype(np.int32)), "n_toxic": pa.array(e[:, 0]), "offsets": pa.array([",".join(x) for x in spans], pa.string())}

    return arrow_map(docs, {"doc_id": "doc_id", "text": "text", "held_out": "crc32(cast(cast(doc_id as string) as binary)) % 4 = 2"}, "doc_id long, held_out boolean, score double, predicted int, n_toxic double, offsets string", kernel)


def keep_clean(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``docs`` without the rows predicted toxic, with all their columns."""

    def run(batches):
        for b in batches:
            s = model.score(model.evidence(texts_of(b["text"])))
            yield b.filter(pa.array(s < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
