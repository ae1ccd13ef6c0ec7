"""Market listings storage.

Two layouts, the same keep-last rule:

* the *log* (:func:`append_batch`, :func:`current_listings`): every capture
  batch is written to its own ``run_id=<run>/batch_id=<n>`` partition
  (overwriting only that partition, so a retried batch replaces itself), and
  the current listings are the upsert over all batches, computed on read;
* the *state* (:class:`ListingStore`): the current listings, bucketed by key. A
  batch rewrites only the buckets that it touches, under a new folder; a
  manifest, written last, says which folder holds each bucket. Reading is one
  pass over the current listings.

Nothing is rewritten in place, so a failed, repeated or restarted writer never
loses or duplicates data. Dated snapshots (K2) are partitions of one table;
:func:`snapshot_at` reads the last one up to a date, :func:`snapshot_diff`
compares two.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stayspark import schema as S
from stayspark.functions.text import plain_number
from stayspark.operators.market import upsert_listings


_MANIFEST = "buckets int, folders map<string,string>, hashed string"
#: The hash of new stores: the one that Spark partitions by.
_HASHED = "murmur3"


def read_market_csv(spark: SparkSession, path: str) -> DataFrame:
    """Listings CSV (UTF-8, optional BOM) with the fixed columns, found by
    header name whatever their order; columns that a file lacks are NULL.

    Fields are read as text and coerced as the upsert does: a number may be
    written with decimals (``120.0``), whole-number columns keep its integer
    part; a bad field becomes NULL and the row stays.
    """
    raw = spark.read.option("header", True).option("encoding", "UTF-8").option("mode", "PERMISSIVE").option("inferSchema", False).csv(path)
    names = {c.lstrip("\ufeff").strip(): c for c in raw.columns}

    def typed(f: T.StructField) -> Column:
        if f.name not in names:
            return F.lit(None).cast(f.dataType).alias(f.name)
        c = F.col(f"`{names[f.name]}`")
        if isinstance(f.dataType, T.IntegerType):
            x = plain_number(c)
            c = F.when(F.abs(x) < 2.0 ** 31, x.cast("int"))
        elif isinstance(f.dataType, T.NumericType):
            c = plain_number(c)
        elif isinstance(f.dataType, T.DateType):
            c = F.try_to_date(c)
        return c.alias(f.name)

    return raw.select(*[typed(f) for f in S.MARKET_SCHEMA.fields])


def append_batch(listings: DataFrame, root: str, run_id: str, batch_id: int) -> None:
    """Write one capture batch as partition ``run_id`` / ``batch_id``.

    ``run_id`` names the writer whose batch numbers these are (a stream's own
    id, a capture's id): a repeated batch replaces itself, and another run's
    batch of the same number is another partition.
    """
    out = listings.withColumns({"run_id": F.lit(str(run_id)), "batch_id": F.lit(int(batch_id)).cast("long")})
    (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("run_id", "batch_id").parquet(root))


def _log(spark: SparkSession, root: str) -> DataFrame:
    """All batches (run ids that look like numbers stay text)."""
    log = spark.read.parquet(root)
    return log.withColumns({"run_id": F.col("run_id").cast("string"), "batch_id": F.col("batch_id").cast("long")})


def current_listings(spark: SparkSession, root: str, order: Sequence[str]) -> DataFrame:
    """K1 on read: last row per (url, checkin) over all batches. ``order``
    names the columns that say which is later (a capture time, then a key);
    rows that tie on them are ordered by batch and then by content, so the
    answer doesn't depend on files or partitions."""
    if not order:
        raise ValueError("name the columns that order captures")
    return upsert_listings(None, _log(spark, root), order=[*order, "batch_id", "run_id"], drop=["batch_id", "run_id"])


def compact(spark: SparkSession, root: str, new_root: str, order: Sequence[str]) -> None:
    """Write the current listings as the first batch of a new store, so that
    reads no longer add up all history."""
    append_batch(current_listings(spark, root, order), new_root, "compacted", 0)


def upsert_to(existing: DataFrame | None, new: DataFrame, out_path: str, order: Sequence[str], fmt: str = "parquet") -> DataFrame:
    """K1 as one job: union, keep last by ``order``, write to a *new* path."""
    if not order:
        raise ValueError("name the columns that order captures")
    res = upsert_listings(existing, new, order=order)
    res.write.mode("error").format(fmt).option("header", True).save(out_path)
    return res


class ListingStore:
    """Current listings under ``root``, merged batch by batch.

    ``order`` names the columns that say which row of a (url, checkin) is
    later, as in :func:`current_listings`; they are part of the listings.
    ``buckets`` counts when the store is new, and is kept in its manifest. A
    row's bucket is that of Spark's own hash partitioning by the key, so that
    what the keep-last aggregate shuffles is dealt by bucket as well and is
    written without another shuffle; a store made before that keeps its hash
    (a manifest without ``hashed``). A version is a manifest: bucket -> folder. It appears by the rename of one
    file, after its folders are complete; a writer that dies before that leaves
    the version before it as it was. Two writers of one version: the second
    fails, and may try again.
    """

    def __init__(self, spark: SparkSession, root: str, order: Sequence[str], buckets: int = 64):
        if not order:
            raise ValueError("name the columns that order captures")
        self.spark, self.root, self.order, self.buckets = spark, root.rstrip("/"), list(order), buckets
        self.hashed = _HASHED

    def _path(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def versions(self) -> list[int]:
        """Complete versions, oldest first."""
        fs, path = self._path("manifests")
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(int(n) for n in names if n.isdigit())

    def manifest(self, version: int | None = None) -> dict[int, str]:
        """Folder of each bucket (one entry a bucket); empty without a version."""
        known = self.versions()
        if not known or (version is not None and version not in known):
            if version is not None:
                raise ValueError(f"{self.root} has no version {version}")
            return {}
        row = self.spark.read.schema(_MANIFEST).json(f"{self.root}/manifests/{known[-1] if version is None else version}").first()
        self.buckets, self.hashed = row.buckets, row.hashed or "xxhash64"
        return {int(b): f for b, f in row.folders.items()}

    def _publish(self, version: int, folders: dict[int, str]) -> None:
        """One file, renamed into place; fails if the version is there."""
        row = self.spark.createDataFrame([(self.buckets, {str(b): f for b, f in folders.items()}, self.hashed)], _MANIFEST)
        token = f"manifests/.{version}-{uuid.uuid4().hex}"
        row.coalesce(1).write.json(f"{self.root}/{token}")
        fs, made = self._path(token)
        file = next(s.getPath() for s in fs.listStatus(made) if s.getPath().getName().startswith("part-"))
        _, target = self._path("manifests", str(version))
        if fs.exists(target) or not fs.rename(file, target):
            fs.delete(made, True)
            raise RuntimeError(f"{self.root}: another writer made version {version}")
        fs.delete(made, True)

    def _read(self, folders: dict[int, str]) -> DataFrame | None:
        paths = [f"{self.root}/state/{f}/bucket={b}" for b, f in sorted(folders.items())]
        return self.spark.read.parquet(*paths) if paths else None

    def _bucket(self) -> Column:
        key = F.xxhash64("url", F.col("checkin").cast("string")) if self.hashed == "xxhash64" else F.hash("url", "checkin")
        return F.pmod(key, F.lit(self.buckets)).cast("int")

    def _written(self, folder: str) -> list[int]:
        """Buckets that a folder of the state holds."""
        fs, path = self._path("state", folder)
        return sorted(int(n[7:]) for n in (s.getPath().getName() for s in fs.listStatus(path)) if n.startswith("bucket="))

    def merge(self, listings: DataFrame, run_id: str, batch_id: int) -> int:
        """K1 + N8: merge a batch, return the new version. Rows that tie on
        ``order`` are ordered by batch and then by content, so the answer
        doesn't depend on files or partitions, and a repeated batch changes
        nothing."""
        known = self.versions()
        folders = self.manifest()
        batch = listings.withColumns({"_batch_id": F.lit(int(batch_id)).cast("long"), "_run_id": F.lit(str(run_id))})
        every = self._read(folders)
        old = None
        if every is not None:
            # the key has the store's types, which its hash depends on
            batch = batch.withColumns({c: F.col(c).cast(every.schema[c].dataType) for c in ("url", "checkin")})
            # At most one row for each bucket.
            touched = {r.b for r in batch.select(self._bucket().alias("b")).distinct().collect()}
            if not touched:
                return known[-1]
            old = every if touched >= set(folders) else self._read({b: f for b, f in folders.items() if b in touched})
        merged = upsert_listings(None, batch if old is None else old.unionByName(batch, allowMissingColumns=True),
                                 order=[*self.order, "_batch_id", "_run_id"])
        folder = uuid.uuid4().hex
        merged.withColumn("bucket", self._bucket()).write.partitionBy("bucket").parquet(f"{self.root}/state/{folder}")
        touched = self._written(folder)
        if not touched and known:
            return known[-1]
        version = known[-1] + 1 if known else 1
        self._publish(version, {**folders, **{b: folder for b in touched}})
        return version

    def listings(self, version: int | None = None) -> DataFrame | None:
        """The listings of a version (the latest); None before the first row."""
        df = self._read(self.manifest(version))
        return None if df is None else df.drop("_batch_id", "_run_id")

    def vacuum(self, keep: int = 2) -> None:
        """Drop all versions but the last ``keep``, and folders that none of
        those names (also what a dead writer left). Not while one writes."""
        known = self.versions()
        used = {f for v in known[-keep:] for f in self.manifest(v).values()}
        for v in known[:-keep]:
            fs, path = self._path("manifests", str(v))
            fs.delete(path, True)
        fs, path = self._path("state")
        for s in fs.listStatus(path) if fs.exists(path) else []:
            if s.getPath().getName() not in used:
                fs.delete(s.getPath(), True)


def snapshot(listings: DataFrame, root: str, day: dt.date | None = None) -> str:
    """K2: dated copy of the whole listing set under ``snapshot_date=YYYYMMDD``;
    one more of the same day replaces it."""
    day = day or dt.date.today()
    path = f"{root}/snapshot_date={day.strftime('%Y%m%d')}"
    listings.write.mode("overwrite").parquet(path)
    return path


def snapshots(spark: SparkSession, root: str) -> DataFrame:
    """All snapshots with their ``snapshot_date``; a condition on the date
    reads that date's folder only."""
    df = spark.read.option("mergeSchema", True).parquet(root)
    return df.withColumn("snapshot_date", F.to_date(F.col("snapshot_date").cast("string"), "yyyyMMdd"))


def snapshot_dates(spark: SparkSession, root: str) -> list[dt.date]:
    """Dates that have a snapshot, from the folders' names alone."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(dt.datetime.strptime(n[14:], "%Y%m%d").date() for n in names if n.startswith("snapshot_date="))


def snapshot_at(spark: SparkSession, root: str, day: dt.date) -> DataFrame | None:
    """The listings as of a date: the last snapshot up to it; None before the
    first."""
    known = [d for d in snapshot_dates(spark, root) if d <= day]
    return spark.read.parquet(f"{root}/snapshot_date={known[-1].strftime('%Y%m%d')}") if known else None


def snapshot_diff(old: DataFrame, new: DataFrame, price: str = "precio_noche") -> DataFrame:
    """(url, checkin, change, old price, new price) of the listings that two
    snapshots don't have alike: ``added``, ``gone`` or ``repriced``, by one
    full outer merge on the key. A NULL price is a price like any other."""
    key = ["url", "checkin"]
    side = lambda df, name: df.select(*key, F.col(price).alias(name), F.lit(True).alias(f"_{name}"))
    same_key = F.lit(True)
    a, b = side(old, "old_price").alias("a"), side(new, "new_price").alias("b")
    for c in key:
        same_key = same_key & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    j = a.join(b, same_key, "full_outer")
    change = (F.when(F.col("_old_price").isNull(), "added").when(F.col("_new_price").isNull(), "gone")
              .when(~F.col("old_price").eqNullSafe(F.col("new_price")), "repriced"))
    present = lambda c: F.when(F.col("_old_price").isNull(), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c)
    return j.select(*[present(c) for c in key], change.alias("change"), "old_price", "new_price").where(F.col("change").isNotNull())
