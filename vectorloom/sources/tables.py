"""Samples by directory layout, metrics logs and a materialised cache of built records."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def samples(paths: DataFrame, most: int = 0, image: str = "patch_tif/0.tif", cut_first: bool = True) -> DataFrame:
    """split, sample_id and which of the files exist, from a listing (path) of ``root/split/sample/...``. ``most`` (0: all) keeps the first samples of each split by name,
    before or after those without an image are dropped."""
    from ..operators.metrics import first_per

    p = paths.select(F.regexp_extract("path", r"([^/]+)/([^/]+)/((?:patch_tif|label_check_crop)/[^/]+)$", 1).alias("split"), F.regexp_extract("path", r"([^/]+)/([^/]+)/((?:patch_tif|label_check_crop)/[^/]+)$", 2).alias("sample_id"), F.regexp_extract("path", r"((?:patch_tif|label_check_crop)/[^/]+)$", 1).alias("file"))
    s = p.where("sample_id <> ''").groupBy("split", "sample_id").agg(F.array_sort(F.collect_set("file")).alias("files"))
    has = F.array_contains("files", image)
    if cut_first:
        return first_per(s, ["split"], ["sample_id"], most).where(has)
    return first_per(s.where(has), ["split"], ["sample_id"], most)


def append_metrics(rows: DataFrame, path: str) -> None:
    """One JSON row an epoch, behind those that are there."""
    rows.write.mode("append").json(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("epoch long, train_loss double, val_loss double, val_token_acc double, train_sec double, val_sec double, checkpoint_sec double, global_step long, best_updated boolean, output_dir string").json(path)


class Manifest:
    """Which folders of data under a path count: a log of numbered entries, each of which one writer alone can put in place."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def folders(self) -> list[str]:
        """The folders in the order of their entries."""
        log = self._at("_log")
        files = log.getFileSystem(self.conf)
        if not files.exists(log):
            return []
        out = []
        for status in sorted(files.listStatus(log), key=lambda s: s.getPath().getName()):
            if status.getPath().getName().isdigit():
                stream = files.open(status.getPath())
                out.append(f"{self.path}/data/{self.jvm.org.apache.commons.io.IOUtils.toString(stream, 'UTF-8')}")
                stream.close()
        return out

    def put(self, number: int, folder: str) -> bool:
        """Puts an entry in place, unless one of that number is there: it is written beside the log and then renamed, which does not overwrite, so it is there as a whole or not at all."""
        draft, place = self._at(f"_drafts/{folder}"), self._at(f"_log/{number:09d}")
        files = draft.getFileSystem(self.conf)
        files.mkdirs(place.getParent())
        stream = files.create(draft, True)
        stream.write(bytearray(folder.encode()))
        stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), self.conf)
        try:
            context.rename(draft, place, self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as error:
            if "FileAlreadyExists" not in str(error):
                raise
            files.delete(draft, False)
            return False
        return True

    def drop(self, folder: str) -> None:
        path = self._at(f"data/{folder}")
        path.getFileSystem(self.conf).delete(path, True)


def cached(items: DataFrame, key: str, path: str, build) -> DataFrame:
    """``items`` with what ``build`` makes of them; only keys that the table at ``path`` lacks are built, and they are added. Keys name everything the result depends on.

    Writers do not wait for one another. Each writes a folder of its own and then puts it into the manifest under the number behind those that it has seen. If another writer has taken that number, what it
    has added is left out of the folder before it is put in again, so a key is there once however many writers build it."""
    spark = items.sparkSession
    log = Manifest(spark, path)

    def without(df: DataFrame, folders: list[str]) -> DataFrame:
        return df.join(spark.read.parquet(*folders).select(key), key, "left_anti") if folders else df

    folders = log.folders()
    missing = without(items.dropDuplicates([key]), folders)
    if not missing.isEmpty():
        mine = uuid.uuid4().hex
        build(missing).write.parquet(f"{log.path}/data/{mine}")
        while not log.put(len(folders) + 1, mine):
            folders, old, mine = log.folders(), mine, uuid.uuid4().hex
            without(spark.read.parquet(f"{log.path}/data/{old}"), folders).write.parquet(f"{log.path}/data/{mine}")
            log.drop(old)
    folders = log.folders()
    stored = spark.read.parquet(*folders) if folders else build(items.limit(0))
    return stored.join(items.select(key), key, "left_semi")


def cache_counts(items: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """total, existing and missing keys."""
    j = items.select(key).distinct().join(stored.select(key, F.lit(True).alias("hit")).distinct(), key, "left")
    return j.agg(F.count("*").alias("total"), F.count("hit").alias("existing"), (F.count("*") - F.count("hit")).alias("missing"))


def labelled(found: DataFrame, labels: dict[str, str]) -> DataFrame:
    """sample_id and task for each label file (task -> path inside a sample) that a sample of ``samples`` has: tasks without a label are left out."""
    pairs = F.explode(F.array(*(F.struct(F.lit(t).alias("task"), F.lit(p).alias("file")) for t, p in labels.items())))
    return found.select("split", "sample_id", "files", pairs.alias("l")).where(F.array_contains("files", F.col("l.file"))).select("split", "sample_id", F.col("l.task").alias("task"))


def inputs(paths: DataFrame, image: str | None = None, folder: str | None = None, pattern: str = "*.tif", root: str = "", splits: tuple[str | None, ...] = (), relpath: str = "patch_tif/0.tif") -> DataFrame:
    """sample_id, image_path of what to predict, from a listing (path): one image; else a folder's files by pattern; else the images of the first split that has any folder.
    Images are named by their file, those of a split by their sample's folder; no such split is an error."""
    import re

    from .config import CodedError

    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    if image:
        return paths.sparkSession.createDataFrame([(image,)], "path string").select(stem.alias("sample_id"), F.col("path").alias("image_path"))
    if folder:
        base = folder.rstrip("/")
        name = re.escape(pattern).replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
        here = F.col("path").startswith(f"{base}/") & F.substring("path", len(base) + 2, 1 << 30).rlike(f"^{name}$")
        return paths.where(here).select(stem.alias("sample_id"), F.col("path").alias("image_path")).orderBy("image_path")
    for split in splits:
        if split:
            top = f"{root.rstrip('/')}/{split}/"
            inside = paths.where(F.col("path").startswith(top))
            if not inside.isEmpty():
                rest = F.substring("path", len(top) + 1, 1 << 30)
                return inside.where(F.regexp_extract(rest, "^[^/]+/(.*)$", 1) == relpath).select(F.substring_index(rest, "/", 1).alias("sample_id"), F.col("path").alias("image_path")).orderBy("sample_id")
    raise CodedError("VL-1102", f"no split of {[s for s in splits if s]} under {root}")
