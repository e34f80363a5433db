"""Token counts of a document's sections, attributed by offsets.

A whole text is encoded once. Token byte lengths give byte offsets, and these give code point spans: a token that begins or ends inside a
code point covers that code point. The spans are then joined with the section spans, both sorted, so each token meets the sections
that its ends lie in. A token across a boundary is allocated whole, by one rule: ``first`` (the default: the section of its first
code point), ``last``, or ``most`` (the section with most of its code points; the earlier one if equal, only the two sections at its ends
compete). Tokens outside all sections count for section -1. So the sections' counts always add up to the text's tokens.

Cases: null and empty texts have no tokens and no section; an empty line is a section of its line feed; repeated rows give
repeated results; an empty table gives an empty result; special tokens' strings in a text are ordinary text; runs of white
space of any length are encoded apart from the splitting expression, whose stack they would exceed, with the ids that it would give.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrowmap import arrow_map, texts_of
from .textcore import code_points

RULES = ("first", "last", "most")
#: White space by Unicode's property, in runs that the splitting expression need not see whole.
_LONG_SPACE = re.compile(r"[\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """A rank file, read once a worker, and its tokens' byte lengths."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("attribution", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.width = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.width[rank] = len(token)

    def ids(self, text: str) -> list[int]:
        """Ids of the text. Of a run of white space before a word, the expression makes one piece of all but its last character, and of a run at the end one piece."""
        out, done = [], 0
        for run in _LONG_SPACE.finditer(text):
            stop = run.end() - (run.end() < len(text))
            out += self.bpe.encode_ordinary(text[done : run.start()])
            out += self.bpe._encode_single_piece(text[run.start() : stop])
            done = stop
        return out + self.bpe.encode_ordinary(text[done:])

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and the code points that each token begins at and ends before."""
        ids = np.array(self.ids(text), np.int64)
        end = np.cumsum(self.width[ids])
        start = end - self.width[ids]
        raw = np.frombuffer(text.encode(), np.uint8)
        if len(raw) == len(text):
            return ids, start, end
        lead = np.cumsum((raw & 0xC0) != 0x80)  # code points begun up to each byte
        return ids, lead[start] - 1, lead[end - 1]


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def attribute(start: np.ndarray, end: np.ndarray, section_start: np.ndarray, section_end: np.ndarray, rule: str = "first") -> tuple[np.ndarray, np.ndarray]:
    """Each token's section (-1: none), and whether its ends lie in different ones. Sections are sorted and disjoint."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    if not len(section_start):
        return np.full(len(start), -1), np.zeros(len(start), bool)

    def at(point: np.ndarray) -> np.ndarray:
        s = np.searchsorted(section_start, point, "right") - 1
        return np.where((s >= 0) & (point < section_end[s]), s, -1)

    first, last = at(start), at(end - 1)
    crossing = first != last
    if rule == "first":
        return first, crossing
    if rule == "last":
        return last, crossing
    in_first = np.where(first >= 0, np.minimum(end, section_end[first]) - start, 0)
    in_last = np.where(last >= 0, end - np.maximum(start, section_start[last]), 0)
    return np.where(crossing & (in_last > in_first), last, first), crossing


def lines(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Lines as sections, each with its line feed; together they cover the text."""
    if not text:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.flatnonzero(code_points(text) == 10) + 1
    cut = cut[cut < len(text)]
    return np.concatenate(([0], cut)), np.concatenate((cut, [len(text)]))


def section_counts(docs: DataFrame, rule: str = "first", path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, n_sections, n_crossing, counts (tokens of each line in order)."""
    path = path or default_vocabulary()

    def kernel(b: pa.RecordBatch) -> dict:
        e = encoder(path)
        n, sections, crossing, counts = [], [], [], []
        for text in texts_of(b["text"]):
            ids, start, end = e.spans(text) if text else (np.zeros(0, np.int64),) * 3
            low, high = lines(text)
            own, over = attribute(start, end, low, high, rule)
            n.append(len(ids))
            sections.append(len(low))
            crossing.append(int(over.sum()))
            counts.append(np.bincount(own[own >= 0], minlength=len(low)))
        return {"doc_id": b["doc_id"], "n_tokens": pa.array(n, pa.int64()), "n_sections": pa.array(sections, pa.int64()), "n_crossing": pa.array(crossing, pa.int64()), "counts": pa.array(counts, pa.list_(pa.int64()))}

    return arrow_map(docs, {"doc_id": "doc_id", "text": "text"}, "doc_id long, n_tokens long, n_sections long, n_crossing long, counts array<long>", kernel)


def field_counts(df: DataFrame, fields: list[str], key: str, between: str = "\n", rule: str = "first", path: str | None = None) -> DataFrame:
    """key, n_tokens and <field>_tokens: the named text columns joined by ``between``, encoded once; the joints count for no field."""
    path = path or default_vocabulary()
    names = {f"f{i}": f"cast(`{f}` as string)" for i, f in enumerate(fields)}

    def kernel(b: pa.RecordBatch) -> dict:
        e = encoder(path)
        out = [[] for _ in range(len(fields) + 1)]
        for row in zip(*(texts_of(b[c]) for c in names), strict=True):
            size = np.array([len(x) for x in row])
            start = np.concatenate(([0], np.cumsum(size + len(between))[:-1]))
            own, _ = attribute(*e.spans(between.join(row))[1:], start, start + size, rule) if any(row) or between else (np.zeros(0, np.int64), None)
            out[0].append(len(own))
            for i in range(len(fields)):
                out[i + 1].append(int((own == i).sum()))
        return {key: b[key], "n_tokens": pa.array(out[0], pa.int64())} | {f"{f}_tokens": pa.array(x, pa.int64()) for f, x in zip(fields, out[1:], strict=True)}

    return arrow_map(df, {key: key} | names, f"{key} {df.schema[key].dataType.simpleString()}, n_tokens long, " + ", ".join(f"{f}_tokens long" for f in fields), kernel)


