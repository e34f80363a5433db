"""Secret scan: a linear-chain conditional random field tags tokens as outside, begin or inside of a secret.

Features of a token: its own and its neighbours' words and shapes, pairs of shape and preceding word, and
features of the file (size, share of digits and symbols). Viterbi decodes the best tag sequence of every whole
text. The base patterns give spans of known form. The field is fitted on a bounded sample of texts: on the spans which the patterns find there, and on secrets of
many other names and forms that are put into texts of the sample (``planted``), while the words of names are left out of
half of them, so it learns from shapes and surroundings. It adds spans that the patterns miss, and what goes on beyond a pattern's match; base spans always stay.

Cases: a null or empty text has no spans; repeated rows give repeated results; rows keep their order within
a partition; an empty table gives an empty result; a null ``doc_id`` is kept. Offsets are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crf
from .arrowmap import arrow_map, texts_of
from .sampling import below, bound
from .textcore import blocks, mix, shape_code, tokenize

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = ("passw", "secret", "token", "api_key", "apikey")
KINDS = ("assign", "access", "hex", "crf")
OUTSIDE, BEGIN, INSIDE = range(3)
#: Rows of the sample that the field is fitted on, and the longest text in it.
SAMPLE_ROWS, SAMPLE_CHARS = 3000, 50_000
#: Characters of texts with spans, and of others, that the field is fitted on.
FIT_CHARS = 400_000
#: Texts of the sample that secrets are put into, and their characters.
PLANT_TEXTS, PLANT_CHARS = 400, 300_000
#: Code points that a span of the field has at least, as the values of assignments do.
LEAST = 6
#: What a left-out word's features are: they weigh nothing.
LEFT_OUT = np.uint64(1)
_NAMES = ("password", "passwd", "secret", "token", "api_key", "apikey", "pwd", "credential", "auth", "access_key", "private_key", "client_secret", "bearer")
_ALPHABETS = ("0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", "abcdefghijklmnopqrstuvwxyz0123456789!$%#@*")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's rank, end) of the base patterns' matches, sorted. Assignments span the whole match."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def features(t, n_docs: int, left_out: np.ndarray | None = None) -> list[np.ndarray]:
    word, shape = t.word(), mix(shape_code(t) + np.uint64(1 << 40))
    salt = lambda x, k: mix(x + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64)))
    known = np.ones(len(word), bool) if left_out is None else ~left_out

    def shifted(x: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros_like(x)
        if 0 < by < len(x):
            out[by:] = np.where(t.doc[by:] == t.doc[:-by], x[:-by], 0)
        elif by < 0 and -by < len(x):
            out[:by] = np.where(t.doc[:by] == t.doc[-by:], x[-by:], 0)
        return out

    before = [shifted(word, k) for k in (1, 2, 3)]
    seen = [shifted(known.astype(np.int8), k) == 1 for k in (1, 2, 3)]
    after, seen_after = shifted(word, -1), shifted(known.astype(np.int8), -1) == 1
    if left_out is None:
        seen, seen_after = [np.ones(len(word), bool)] * 3, np.ones(len(word), bool)
    only = lambda x, ok: np.where(ok, x, LEFT_OUT)
    size = np.diff(np.append(t.base, len(t.cp) + 1))
    symbols = np.bincount(t.doc[t.end - t.start == 1], minlength=n_docs)
    digits = np.bincount(t.doc[(t.cp[t.start] >= 48) & (t.cp[t.start] < 58)], minlength=n_docs)
    level = lambda x: np.minimum(7, np.log2(1 + 512 * x / np.maximum(size, 1)).astype(np.int64))
    file = np.log2(size + 1).astype(np.int64) // 3 * 64 + level(symbols) * 8 + level(digits)
    pairs = [only(salt(shape + 3 * b, 5 + k), ok) for k, (b, ok) in enumerate(zip(before, seen, strict=True))]
    return [only(word, known), shape, only(salt(before[0], 1), seen[0]), only(salt(after, 2), seen_after), salt(shifted(shape, 1), 3), salt(shifted(shape, -1), 4), *pairs, salt(shape + file.astype(np.uint64)[t.doc], 9), salt(3 * shape + shifted(shape, 1), 10), salt(5 * shifted(shape, 1) + shifted(shape, 2), 11)]


def gold_tags(t, spans: list[list[tuple[int, int, int]]]) -> np.ndarray:
    """Tags of the tokens that the spans' values cover."""
    tags = np.zeros(len(t.start), np.int64)
    for base, own in zip(t.base, spans, strict=True):
        for start, _, end in own:
            i, j = np.searchsorted(t.start, (base + start, base + end))
            tags[i:j] = INSIDE
            tags[i : i + 1] = BEGIN
    return tags


def merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Overlapping spans as one, for training."""
    out: list[tuple[int, int, int]] = []
    for s, k, e in spans:
        if out and s < out[-1][2]:
            out[-1] = (out[-1][0], out[-1][1], max(e, out[-1][2]))
        else:
            out.append((s, k, e))
    return out


def planted(text: str, r: random.Random) -> tuple[str, list[tuple[int, int, int]], list[tuple[int, int]]]:
    """``text`` with one to three secrets put between its words: the new text, the secrets' spans, and the spans of names to leave out."""
    spaces = [m.start() for m in re.finditer(" ", text)]
    cuts = sorted(r.sample(spaces, min(len(spaces), r.randint(1, 3))))
    out, spans, names, at, size = [], [], [], 0, 0
    for c in cuts:
        out.append(text[at:c] + " ")
        size += c - at + 1
        at = c
        name = r.choice(_NAMES)
        name = r.choice((name, name.upper(), name.title(), r.choice(("my_", "db_", "x-", "user ")) + name))
        quote = r.choice(("", '"', "'"))
        value = "".join(r.choices(r.choice(_ALPHABETS), k=r.choice((12, 16, 20, 24, 32, 40, 64))))
        if not any(x.isdigit() for x in value):
            value += str(r.randint(10, 99))
        head = name + r.choice((" = ", "=", ": ", ":", " => ", " := ", ": Bearer ")) + quote
        spans.append((size, 0, size + len(head) + len(value)))
        if r.random() < 0.5:
            names.append((size, size + len(name)))
        out.append(head + value + quote)
        size += len(out[-1])
    return "".join(out) + text[at:], spans, names


def fit_texts(texts: list[str]) -> crf.Model:
    """A field that has learned from the base patterns' spans and from planted ones: texts with spans, and as many others at most, but 200 at least; each kind up to FIT_CHARS."""
    found = [merged(base_spans(t)) for t in texts]
    some = [i for i, f in enumerate(found) if f]
    clean = [i for i, f in enumerate(found) if not f]
    take, spans, names = [], [], []
    for kind in (some, clean[: max(200, len(some))]):
        size = 0
        for i in kind:
            if size <= FIT_CHARS:
                take.append(texts[i])
                spans.append(found[i])
                names.append([])
                size += len(texts[i])
    r, size = random.Random(11), 0
    for i in clean[:PLANT_TEXTS]:
        if size <= PLANT_CHARS:
            t, own, left = planted(texts[i], r)
            take.append(t)
            spans.append(own)
            names.append([(s, 0, e) for s, e in left])
            size += len(t)
    if not take:
        return crf.Model(np.zeros((2, 3), np.float32), np.array([[0, -9, crf.FAR], [0, 0, 0], [0, 0, 0.0]]))
    t = tokenize(take, True)
    if not len(t.start):
        return fit_texts([])
    model = crf.fit(features(t, len(take), gold_tags(t, names) != OUTSIDE), gold_tags(t, spans), t.doc, len(take), 3, rounds=60, l2=1e-2, dead=int(LEFT_OUT))
    model.trans[OUTSIDE, INSIDE] = crf.FAR
    return model


def sample(docs: DataFrame) -> DataFrame:
    """About SAMPLE_ROWS texts of at most SAMPLE_CHARS characters, the first by a hash of doc_id and text, whatever the table's layout."""
    h = F.xxhash64("doc_id", "text")
    keep = docs.select("text", h.alias("h")).where(below(F.col("h"), bound(SAMPLE_ROWS * 6 // 5, docs.count())))
    return keep.where(F.length("text") <= SAMPLE_CHARS).orderBy(F.xxhash64("h"), "text").limit(SAMPLE_ROWS).select("text")


def fit(docs: DataFrame) -> crf.Model:
    """A field fitted on the sample. A table that has texts to fit on, but of which the sample took none, is an error."""
    texts = [r[0] for r in sample(docs).collect()]
    if not texts and not docs.where(F.length("text") <= SAMPLE_CHARS).isEmpty():
        raise ValueError("the sample to fit on is empty")
    return fit_texts(texts)


def outside(start: int, end: int, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Parts of a span that no base span covers."""
    out = []
    for s, _, e in sorted(base):
        if e <= start or s >= end:
            continue
        if s > start:
            out.append((start, s))
        start = max(start, e)
    return [*out, (start, end)] if start < end else out


def scan_texts(texts: list[str], model: crf.Model) -> list[list[tuple[int, int, int]]]:
    """All spans of each text, sorted by start and kind."""
    out = [base_spans(t) for t in texts]
    for i, j in blocks(texts):
        t = tokenize(texts[i:j], True)
        if not len(t.start):
            continue
        tags = crf.viterbi(model, model.emissions(features(t, j - i)), t.doc, j - i)
        hit = tags != OUTSIDE
        if not hit.any():
            continue
        first = hit & ((tags == BEGIN) | ~np.concatenate(([False], hit[:-1] & (t.doc[1:] == t.doc[:-1]))))
        at = np.flatnonzero(first)
        run = np.cumsum(first)[hit]
        end = np.zeros(len(at), np.int64)
        np.maximum.at(end, run - 1, t.end[hit])
        for a, e in zip(at, end, strict=True):
            d = t.doc[a]
            s, e = int(t.start[a] - t.base[d]), int(e - t.base[d])
            if e - s < LEAST:
                continue
            own = out[i + d]
            text = texts[i + d]
            own += [(x, 3, y) for x, y in outside(s, e, [z for z in own if z[1] < 3]) if any(c.isalnum() for c in text[x:y])]
        for d in np.unique(t.doc[at]):
            out[i + d].sort()
    return out


def spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


@dataclass
class SecretScan:
    """Finds secrets. ``spans``: one row a text with its spans as structs; ``redact``: texts with secrets replaced."""

    model: crf.Model

    def spans(self, docs: DataFrame) -> DataFrame:
        """doc_id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end, comma-joined), n_crf."""
        model = self.model

        def kernel(b: pa.RecordBatch) -> dict:
            found = scan_texts(texts_of(b["text"]), model)
            base = [[x for x in f if x[1] < 3] for f in found]
            count = lambda k: pa.array([sum(x[1] == k for x in f) for f in found], pa.int64())
            return {"doc_id": b["doc_id"], "n_assign": count(0), "n_access": count(1), "n_hex": count(2), "base_sha256": pa.array([hashlib.sha256(spelled(x).encode()).hexdigest() for x in base]), "spans": pa.array([spelled(x) for x in found], pa.string()), "n_crf": count(3)}

        return arrow_map(docs, {"doc_id": "doc_id", "text": "text"}, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_crf long", kernel)

    def redact(self, docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
        """``docs`` with the secrets in ``text`` replaced by ``mark`` and n_chars, where there is one, made to fit; a null text stays null."""
        model, schema = self.model, docs.schema

        def run(batches):
            for b in batches:
                texts = b["text"].to_pylist()
                found = scan_texts([t or "" for t in texts], model)
                for n, (t, spans) in enumerate(zip(texts, found, strict=True)):
                    for s, _, e in reversed(merged(spans)):
                        t = t[:s] + mark + t[e:]
                    texts[n] = t
                cols = {f: b[f] for f in b.schema.names} | {"text": pa.array(texts, pa.string())}
                if "n_chars" in cols:
                    cols["n_chars"] = pa.array([old if t is None else len(t) for old, t in zip(b["n_chars"].to_pylist(), texts, strict=True)], b.schema.field("n_chars").type)
                yield pa.RecordBatch.from_pydict(cols)

        return docs.mapInArrow(run, schema)
