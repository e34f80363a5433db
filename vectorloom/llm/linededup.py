"""Removes lines that many documents share, by ranges of line hashes in which documents stream by.

A line's key is the line without white space at its ends, A to Z in lower case. Keys of at least ``LEAST`` code points go on as two 64-bit hashes with their document and place;
texts stay behind. These rows are partitioned by ranges of the hashes and sorted, within a range, by key, document (the greatest first) and place. Streaming through a
key's rows, the first document seen keeps its lines, and the documents counted so far tell whether enough hold the key. A key that makes up more than a thousandth of
all rows would be one task's work: its documents are counted with partial aggregates instead, and its verdict is sent to its rows, wherever they lie; such keys are under a thousand, so
that table is broadcast.

What comes back for a document is a compressed keep bitmap: the runs of lines that go, in order. Texts are read again only to apply it. All of it is DataFrame functions.

Cases: a null or empty text is one empty line; a text's lines are what line feeds set apart, so a carriage return is white space; rows that repeat a doc_id are one document, which keeps or loses its lines in all
of them; rows with a null doc_id are one document, lesser than all others; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .skew import hot_keys
from .storage import Workspace

LEAST, DOCUMENTS = 20, 3
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
_CASES = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
KEY = ["k1", "k2"]
#: A text's name: whether its doc_id is there, its doc_id, and a hash that tells apart texts of one doc_id.
NAME = {"some": "doc_id is not null", "id": "coalesce(doc_id, 0L)", "h": "xxhash64(coalesce(text, ''))"}


def keyed(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """some, id, h, pos, k1, k2 of lines whose key is long enough."""
    text = F.coalesce("text", F.lit(""))
    # Spark's lower() changes no more than A to Z in a text of single bytes
    folded = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, *_CASES))
    rows = docs.select(*(F.expr(e).alias(c) for c, e in NAME.items()), F.posexplode(F.split(folded, "\n", -1)).alias("pos", "line"))
    rows = rows.select(*NAME, "pos", F.btrim("line", F.lit(SPACES)).alias("key")).where(F.char_length("key") >= least)
    return rows.select(*NAME, "pos", F.xxhash64("key").alias("k1"), F.xxhash64(F.lit(1), "key").alias("k2"))


def bitmaps(docs: DataFrame, least: int = LEAST, documents: int = DOCUMENTS, space: Workspace | None = None) -> DataFrame:
    """some, id, h and ``gone``, the runs (first, last) of lines to drop, of texts that lose any."""
    space = space or Workspace(docs.sparkSession)
    doc = F.struct("some", "id")
    lines = space.written(keyed(docs, least), "lines")
    often = space.written(hot_keys(lines.groupBy(*KEY).agg(F.count("*").alias("n")), KEY), "often")
    held = lines.join(F.broadcast(often), KEY).groupBy(*KEY, "some", "id").agg(F.lit(1).alias("one"))
    hot = space.written(held.groupBy(*KEY).agg(F.count("*").alias("docs"), F.max(doc).alias("top")), "hot")
    common = lines.join(F.broadcast(hot), KEY).where((F.col("docs") >= documents) & (doc != F.col("top")))
    ranged = lines.join(F.broadcast(hot.select(*KEY)), KEY, "left_anti").repartitionByRange(*KEY).sortWithinPartitions(*KEY, F.desc("some"), F.desc("id"), "pos")
    stream = Window.partitionBy(*KEY).orderBy(F.desc("some"), F.desc("id"))
    placed = ranged.withColumn("place", F.dense_rank().over(stream)).withColumn("docs", F.max("place").over(Window.partitionBy(*KEY)))
    gone = placed.where((F.col("docs") >= documents) & (F.col("place") > 1)).select(*NAME, "pos").unionByName(common.select(*NAME, "pos"))
    marks = gone.groupBy(*NAME).agg(F.array_sort(F.collect_set("pos")).alias("at"))
    starts, ends = F.filter("at", lambda p, i: (i == 0) | (F.get("at", i - 1) != p - 1)), F.filter("at", lambda p, i: (i == F.size("at") - 1) | (F.get("at", i + 1) != p + 1))
    return space.written(marks.select(*NAME, F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("first"), b.alias("last"))).alias("gone")), "bitmaps")


def dedup(docs: DataFrame, least: int = LEAST, documents: int = DOCUMENTS, texts: bool = False, space: Workspace | None = None) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 and, if asked for, kept: the lines left, joined by line feeds."""
    maps = bitmaps(docs, least, documents, space)
    rows = docs.select("doc_id", *(F.expr(e).alias(c) for c, e in NAME.items()), F.coalesce("text", F.lit("")).alias("text")).join(maps, list(NAME), "left")
    rows = rows.withColumn("lines", F.split("text", "\n", -1))
    begins, ends = F.concat(F.array(F.lit(0)), F.transform("gone", lambda r: r["last"] + 1)), F.concat(F.transform("gone", lambda r: r["first"]), F.array(F.size("lines")))
    left = F.array_join(F.flatten(F.zip_with(begins, ends, lambda a, b: F.slice("lines", a + 1, b - a))), "\n")
    dropped = F.aggregate("gone", F.lit(0).cast("long"), lambda s, r: s + r["last"] - r["first"] + 1)
    rows = rows.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.coalesce(dropped, F.lit(0).cast("long")).alias("n_dropped"), F.when(F.col("gone").isNull(), F.col("text")).otherwise(left).alias("kept"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"), *(["kept"] if texts else []))
