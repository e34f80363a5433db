"""Finds benchmark items inside documents: size-partitioned MinHash containment search, verified by exact shingle containment.

An item's shingles are its runs of five words (an item of fewer words is one shingle). Items fall into partitions by shingle length and by the
binary logarithm of their number n of shingles. An item's signature is its bottom floor((1 - t) n) + 1 hash values: a
document that holds at least the share t of the n shingles must hold one of them, so no match is lost whatever the
document's length. A partition's bound is the greatest value in its signatures. A document probes each partition with its hashes up to that
partition's bound, and meets signatures by (partition, hash): the larger a partition's items, the fewer of a document's hashes it sees, and a short
item's bound opens no other partition. What meets is a candidate pair; a candidate must hold enough of the item's hashes and then of its
shingles themselves, compared as text.

Only DataFrame functions are used. Signatures are broadcast only after their rows have been counted and found
to be at most ``BROADCAST_ROWS``; beyond that the join shuffles, with documents dealt to ``SALTS`` copies of the signatures, so a shingle that
most documents hold meets in many tasks.

Cases: null and empty texts hold and are no items; rows that repeat a doc_id or an item_id report the best
containment of any; rows with a null doc_id or item_id are not reported; ties all stay; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import Workspace

WORDS, THRESHOLD = 5, 0.8
BROADCAST_ROWS = 500_000
SALTS = 16
_SPLIT = "[\\x20\\x09-\\x0D]+"


def _words(text: str = "text") -> Column:
    """Runs of characters other than space and U+0009 to U+000D."""
    return F.expr(f"filter(split({text}, r'{_SPLIT}'), w -> w <> '')")


_HASHED = "transform(words, w -> xxhash64(w))"


def _gram(n: int) -> str:
    """SQL for the hash of the run of n words from place i of ``w``, their hashes."""
    return f"xxhash64({n}, {', '.join(f'w[i + {k}]' for k in range(n))})"


def _grams(n: int) -> str:
    return f"if(size(w) < {n}, array(), transform(sequence(0, size(w) - {n}), i -> {_gram(n)}))"


def _by_length(form, lengths, column: str = "length") -> str:
    return f"CASE {column} {' '.join(f'WHEN {n} THEN {form(n)}' for n in lengths)} END"


def item_shingles(items: DataFrame) -> DataFrame:
    """item_id, length (of a shingle in words), n, part, and the item's distinct shingles: ``texts``, and ``all``, their hashes in ascending order."""
    w = items.where("item_id is not null").select("item_id", _words().alias("words")).where("size(words) > 0").withColumn("w", F.expr(_HASHED))
    both = lambda n: f"array_distinct(transform(sequence(0, size(w) - {n}), i -> struct({_gram(n)} as h, array_join(slice(words, i + 1, {n}), ' ') as t)))"
    own = w.withColumn("length", F.least(F.size("w"), F.lit(WORDS))).withColumn("s", F.expr(_by_length(both, range(1, WORDS + 1))))
    return own.select("item_id", "length", F.size("s").alias("n"), F.expr("array_sort(s.h)").alias("all"), F.col("s.t").alias("texts")).withColumn("part", F.col("length") * 64 + F.floor(F.log2("n")).cast("int"))


def _hashed(docs: DataFrame, shortest: int) -> DataFrame:
    """doc_id, words and w, their hashes, of texts that have enough words."""
    return docs.where("doc_id is not null").select("doc_id", _words().alias("words")).where(F.size("words") >= shortest).withColumn("w", F.expr(_HASHED))


def contained(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, space: Workspace | None = None) -> DataFrame:
    """doc_id, item_id, n_shared, n_shingles, containment of each item of which a document holds at least the threshold."""
    space = space or Workspace(docs.sparkSession)
    known = space.written(item_shingles(items), "items")
    needed = F.floor(F.col("n") * F.lit(1 - threshold) + 1e-9).cast("int") + 1
    signed = space.written(known.select("item_id", "length", "part", F.slice("all", 1, needed).alias("sig")), "signatures")
    # a row for each shingle length and binary logarithm of a size: a few dozen at most
    parts = [tuple(r) for r in signed.groupBy("part", "length").agg(F.max(F.element_at("sig", -1)).alias("bound")).orderBy("part").collect()]
    if not parts:
        return docs.where("false").select(F.col("doc_id").cast("long"), F.lit(0).cast("long").alias("item_id"), F.lit(0).alias("n_shared"), F.lit(0).alias("n_shingles"), F.lit(0.0).alias("containment"))
    lengths = sorted({n for _, n, _ in parts})
    # what no partition of a shingle length looks at goes first, in one pass
    most = {n: max(bound for _, m, bound in parts if m == n) for n in lengths}
    low = _hashed(docs, lengths[0]).select("doc_id", *(F.expr(f"filter({_grams(n)}, g -> g <= {most[n]}L)").alias(f"low{n}") for n in lengths))
    probes = ", ".join(f"transform({f'low{n}' if bound == most[n] else f'filter(low{n}, g -> g <= {bound}L)'}, g -> struct({part} as part, g as g))" for part, n, bound in parts)
    probed = low.select("doc_id", F.explode(F.expr(f"concat({probes})")).alias("p")).select("doc_id", "p.part", "p.g")
    keys = signed.select("item_id", "part", F.explode("sig").alias("g"))
    small = keys.count() <= BROADCAST_ROWS
    on = ["part", "g"]
    if small:
        keys = F.broadcast(keys)
    else:
        probed = probed.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        keys = keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        on.append("salt")
    pairs = space.written(probed.join(keys, on).select("doc_id", "item_id").distinct(), "candidates")
    wanted = pairs.select("doc_id").distinct()
    few = wanted.count() <= BROADCAST_ROWS
    held = _hashed(docs.join(F.broadcast(wanted) if few else wanted, "doc_id", "left_semi"), lengths[0])
    both = pairs.join(held, "doc_id").join(F.broadcast(known) if small else known, "item_id")
    enough = lambda c: F.col(c) >= F.col("n") * threshold - 1e-9
    maybe = both.withColumn("hashes", F.size(F.array_intersect("all", F.expr(_by_length(_grams, lengths))))).where(enough("hashes"))
    # texts of only those runs whose hash the item has
    texts = lambda n: f"if(size(w) < {n}, array(), transform(filter(sequence(0, size(w) - {n}), i -> array_contains(all, {_gram(n)})), i -> array_join(slice(words, i + 1, {n}), ' ')))"
    found = maybe.withColumn("n_shared", F.size(F.array_intersect("texts", F.expr(_by_length(texts, lengths))))).where(enough("n_shared"))
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("n_shared") / F.col("n")).alias("containment"), "n_shared", F.col("n").alias("n_shingles"))).alias("m"))
    return best.select("doc_id", "item_id", "m.n_shared", "m.n_shingles", "m.containment")


def keep_clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents that hold an item; rows with a null doc_id stay."""
    space = Workspace(docs.sparkSession)
    leaks = space.written(contained(docs, items, threshold, space).select("doc_id").distinct(), "leaks")
    few = leaks.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(leaks) if few else leaks, "doc_id", "left_anti").select(docs.columns)
