"""Row history: versions with a validity range, kept by comparing check columns."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom.functions.scalars import surrogate_key
from marketloom.session import written
from marketloom.sources.commits import Commits

META = ["version_id", "valid_from", "valid_to"]
HASH = "_row_hash"


def _moment(at: dt.datetime | dt.date) -> str:
    return f"TIMESTAMP'{at:%Y-%m-%d %H:%M:%S.%f}'"


def opened(snapshot: DataFrame, key: str, at: dt.datetime | dt.date) -> DataFrame:
    """First load: every row is a current version."""
    return snapshot.selectExpr(
        "*",
        f"{surrogate_key([key, _moment(at)])} AS version_id",
        f"{_moment(at)} AS valid_from",
        "cast(NULL AS timestamp) AS valid_to",
    )


def snapshot_history(
    history: DataFrame,
    snapshot: DataFrame,
    key: str,
    check: Sequence[str],
    at: dt.datetime | dt.date,
    close_deleted: bool = True,
) -> DataFrame:
    """The history after one snapshot run.

    Closed versions pass through. Current versions meet the snapshot in one full outer join on
    the key; each joined row gives the old version (kept or closed) and, if changed or new, an
    opened one. A key that comes back after deletion opens a new version. Running the same
    snapshot again changes nothing.
    """
    business = [c for c in history.columns if c not in META]
    now = _moment(at)
    old = history.filter("valid_to IS NULL").selectExpr(f"{key} AS old_key", f"struct({', '.join(history.columns)}) AS old")
    new = snapshot.selectExpr(f"{key} AS new_key", f"struct({', '.join(business)}) AS new")
    both = old.join(new, old.old_key == new.new_key, "full_outer")

    differs = " OR ".join(f"NOT (old.{c} <=> new.{c})" for c in check)
    deleted = "new IS NULL" if close_deleted else "false"
    ends = f"(new IS NOT NULL AND ({differs})) OR {deleted}"
    keep = ", ".join(f"old.{c} AS {c}" for c in [*business, "version_id", "valid_from"])
    take = ", ".join(f"new.{c} AS {c}" for c in business)
    old_version = f"CASE WHEN old IS NOT NULL THEN struct({keep}, CASE WHEN {ends} THEN {now} END AS valid_to) END"
    new_version = f"""CASE WHEN new IS NOT NULL AND (old IS NULL OR {differs}) THEN struct({take},
        {surrogate_key(["new_key", now])} AS version_id, {now} AS valid_from, cast(NULL AS timestamp) AS valid_to) END"""
    versions = both.selectExpr(f"explode(array({old_version}, {new_version})) AS v").filter("v IS NOT NULL").select("v.*")
    return history.filter("valid_to IS NOT NULL").select(*versions.columns).unionByName(versions)


def _row_hash(columns: Sequence[str]) -> Column:
    """Rows with equal check columns, and no others, have this in common; NULL equals NULL."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


class HistoryTable:
    """Row history on Parquet. Open versions lie in buckets by the hash of their key, each row with a hash of its check
    columns. A run compares keys and hashes, reads and rewrites only the buckets in which some key is new,
    changed, gone or back, and adds a folder with the versions it closed. A commit record, written last, names the
    folders, so closed versions and untouched buckets are never written again.

    ``buckets`` is fixed by the first run; some 100 MB of open versions for each are a good size.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, check: Sequence[str], close_deleted: bool = True, buckets: int = 16):
        self.spark = spark
        self.path = path.rstrip("/")
        self.key, self.check, self.close_deleted, self.buckets = key, list(check), close_deleted, buckets
        self._commits = Commits(spark, self.path)

    def _of(self, record: dict, folders: Iterable[str]) -> DataFrame:
        """Rows of some folders, with the hash of their check columns."""
        schema = T.StructType.fromJson(record["schema"]).add(HASH, "string")
        paths = [f"{self.path}/{f}" for f in folders]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        record = self._commits.latest()
        if record is None:
            raise FileNotFoundError(f"nothing committed below {self.path}")
        return self._of(record, [*record["open"].values(), *record["closed"]]).drop(HASH)

    def _bucket(self, count: int) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(count)).cast("int")

    def _touched(self, record: dict, rows: DataFrame) -> list[int]:
        """Buckets with a key whose row is not as it was; read are keys and hashes only."""
        old = self._of(record, record["open"].values()).select(F.col(self.key).alias("_old"), F.col(HASH).alias("_before"))
        new = rows.select(F.col(self.key).alias("_new"), _row_hash(self.check).alias("_now"))
        both = old.join(new, F.col("_old") == F.col("_new"), "full_outer")
        moved = F.col("_old").isNull() | (F.col("_before") != F.col("_now"))
        if self.close_deleted:
            moved |= F.col("_new").isNull()
        keys = both.filter(moved).select(F.coalesce("_old", "_new").alias(self.key))
        return sorted(r[0] for r in keys.select(self._bucket(record["buckets"]).alias("b")).distinct().collect())  # at most ``buckets``

    def snapshot(self, rows: DataFrame, at: dt.datetime | dt.date) -> None:
        """Take in the rows as they are at a moment. The same snapshot again changes nothing."""
        record = self._commits.latest()
        count = self.buckets if record is None else record["buckets"]
        if record is None:
            versions, kept, closed = opened(rows, self.key, at), {}, []
        else:
            rows = written(rows, "snapshot")  # it is compared first and merged after that
            touched = self._touched(record, rows)
            if not touched:
                return
            old = self._of(record, [record["open"][str(b)] for b in touched if str(b) in record["open"]]).drop(HASH)
            near = rows.filter(self._bucket(count).isin(touched))
            versions = snapshot_history(old, near, self.key, self.check, at, self.close_deleted)
            kept, closed = {b: f for b, f in record["open"].items() if int(b) not in touched}, record["closed"]
        run = f"data/{uuid.uuid4().hex}"
        part = F.when(F.col("valid_to").isNull(), self._bucket(count).cast("string")).otherwise(F.lit("closed"))
        out = versions.withColumns({HASH: _row_hash(self.check), "_part": part})
        spread = F.when(F.col("_part") == "closed", F.pmod(F.xxhash64(self.key), F.lit(count))).otherwise(0)
        out.repartition("_part", spread).write.partitionBy("_part").parquet(f"{self.path}/{run}")
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{run}")
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [status.getPath().getName() for status in files.listStatus(folder)]
        parts = {n.removeprefix("_part="): f"{run}/{n}" for n in names if n.startswith("_part=")}
        closed = closed + [parts.pop("closed")] if "closed" in parts else closed
        self._commits.add({"open": kept | parts, "closed": closed, "buckets": count, "schema": versions.schema.jsonValue()})


def valid_at(moment: str) -> str:
    return f"valid_from <= {moment} AND (valid_to IS NULL OR {moment} < valid_to)"


def as_of(history: DataFrame, at: dt.datetime | dt.date) -> DataFrame:
    """Versions valid at one moment."""
    return history.filter(valid_at(_moment(at)))


def as_of_join(facts: DataFrame, history: DataFrame, key: str, at: str, columns: Sequence[str]) -> DataFrame:
    """Every fact row with the version valid at its own time (NULL columns if none was, or its key is NULL).

    Versions of a key do not overlap, so the version of a moment is the last one that began by then. Facts × versions
    are never formed: versions and the distinct moments of facts are walked in the order of key and time. They
    are range-partitioned by both, so a key with a third of all rows spreads over ranges; inside a range the
    last version is carried along, and between ranges by a summary with one row for each key and range.
    """
    version = F.struct("valid_from", "valid_to", *columns)
    began = history.select(F.col(key).alias("_key"), F.col("valid_from").alias("_at"), F.lit(0).alias("_kind"), version.alias("_version"))
    moment = F.expr(f"timestamp({at})")
    asked = facts.select(F.col(key).alias("_key"), moment.alias("_at")).distinct().select("*", F.lit(1).alias("_kind"))
    walk = began.unionByName(asked, allowMissingColumns=True).filter("_key IS NOT NULL AND _at IS NOT NULL")
    # A version that ends as it begins is valid at no time; another one of that moment comes after it.
    order = ["_key", "_at", "_kind", F.asc_nulls_last("_version.valid_to")]
    ranged = walk.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id())
    ranged = written(ranged, "versions-and-moments")
    inside = Window.partitionBy("_key", "_range").orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy("_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    place = F.struct("_at", F.col("_version.valid_to").isNull(), F.col("_version.valid_to"))
    edges = ranged.groupBy("_key", "_range").agg(F.max_by("_version", F.when(F.col("_kind") == 0, place)).alias("_edge"))
    carried = edges.select("_key", "_range", F.last("_edge", ignorenulls=True).over(across).alias("_carried"))
    near = ranged.withColumn("_here", F.last("_version", ignorenulls=True).over(inside)).filter("_kind = 1")
    found = near.join(carried, ["_key", "_range"]).select("_key", "_at", F.coalesce("_here", "_carried").alias("_found"))
    found = found.filter("_found.valid_to IS NULL OR _at < _found.valid_to").filter("_found IS NOT NULL")
    met = (F.col(key) == F.col("_key")) & (F.col("_moment") == F.col("_at"))
    joined = facts.withColumn("_moment", moment).join(found, met, "left")
    return joined.select(*facts.columns, *[F.col(f"_found.{c}").alias(f"version_{c}") for c in columns])
