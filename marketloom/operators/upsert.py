"""Keyed upsert on Parquet tables, incremental cut-offs, and schema drift."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom.session import written
from marketloom.sources.commits import Commits


class SchemaDrift(ValueError):
    """The update's columns do not fit the target and the policy is to fail."""


def reconcile(target: DataFrame, updates: DataFrame, on_schema_change: str = "fail") -> tuple[DataFrame, DataFrame]:
    """Bring both sides to one schema.

    ``fail``: the columns must be the same. ``append_new_columns``: new columns are added to the
    target as NULL; columns missing from the update are NULL in its rows.
    """
    if on_schema_change not in ("fail", "append_new_columns"):
        raise ValueError(f"unknown policy {on_schema_change!r}")
    new = [f for f in updates.schema.fields if f.name not in target.columns]
    gone = [f for f in target.schema.fields if f.name not in updates.columns]
    if on_schema_change == "fail" and (new or gone):
        raise SchemaDrift(f"added {[f.name for f in new]}, missing {[f.name for f in gone]}")
    for field in new:
        target = target.withColumn(field.name, F.lit(None).cast(field.dataType))
    for field in gone:
        updates = updates.withColumn(field.name, F.lit(None).cast(field.dataType))
    order = target.columns
    types = {f.name: f.dataType for f in target.schema.fields}
    return target, updates.select(*[F.col(c).cast(types[c]).alias(c) for c in order])


def merged(
    target: DataFrame,
    updates: DataFrame,
    keys: Sequence[str],
    target_where: Column | str | None = None,
    on_schema_change: str = "fail",
) -> DataFrame:
    """The table after ``MERGE target USING updates ON keys``: matched rows replaced, others kept,
    new rows added. Rows outside ``target_where`` never match and are kept as they are.
    ``updates`` must be unique in ``keys`` (see ``repeated_keys``)."""
    target, updates = reconcile(target, updates, on_schema_change)
    if target_where is None:
        kept = target.join(_new_keys(updates, keys), list(keys), "left_anti")
    else:
        where = F.expr(target_where) if isinstance(target_where, str) else target_where
        inside = F.coalesce(where, F.lit(False))
        kept = target.filter(~inside).unionByName(
            target.filter(inside).join(_new_keys(updates, keys), list(keys), "left_anti")
        )
    return kept.select(*target.columns).unionByName(updates)


def _new_keys(updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys of the updates, as many as these are: files say little of their size in memory (sorted keys are packed to
    a hundredth of it), so they are never collected for a broadcast."""
    return updates.select(*keys).hint("merge")


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def since_last(source: DataFrame, target: DataFrame, source_column: str, target_column: str, lookback_days: int = 3) -> DataFrame:
    """Rows of ``source`` at or after the target's high-water mark minus the look-back.

    The mark is a scalar subquery: one value computed first, then a plain filter on the scan.
    An empty target lets every row pass.
    """
    mark = target.agg(F.max(target_column)).scalar()
    cutoff = mark - F.expr(f"interval {int(lookback_days)} days")
    return source.filter(mark.isNull() | (F.col(source_column) >= cutoff))


def _listed(folders: str | list[str]) -> list[str]:
    """Folders of a partition; records of earlier tables name a single one."""
    return [folders] if isinstance(folders, str) else folders


class KeyedTable:
    """A Parquet table partitioned by one column and maintained by upserts.

    An upsert writes its rows once, to folders of their own beside those of the rows that stay. Only partitions that lose some
    rows, but not all, have the others written again. A commit record, written last, names the folders of every partition, the
    schema, and the caller's mark. A run that fails earlier has changed nothing
    and can simply be run again, and readers of the previous record are not disturbed. Folders no record
    names any more are left to a retention rule.

    ``keys_stay``: a key never changes its partition, for instance because the partition column follows from the
    key. Matching then reads the partitions of the updates only, instead of the keys of the whole table.

    ``deal``: rows are brought together by partition before they are written. Without it each task writes a file for every
    partition it has rows of: more files, but wide rows are not shuffled, which costs several times their size in a file.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        keys: Sequence[str],
        partition: str,
        partition_type: str = "date",
        on_schema_change: str = "fail",
        sort_by: Sequence[str] = (),
        keys_stay: bool = False,
        deal: bool = True,
    ):
        self.spark = spark
        self.path = path.rstrip("/")
        self.keys = list(keys)
        self.partition = partition
        self.partition_type = partition_type
        self.on_schema_change = on_schema_change
        self.sort_by = list(sort_by)
        self.keys_stay = keys_stay
        self.deal = deal
        self._commits = Commits(spark, self.path)

    def exists(self) -> bool:
        return self._commits.latest() is not None

    def mark(self) -> str | None:
        """What the last committed upsert left as its mark."""
        return (self._commits.latest() or {}).get("mark")

    def _slot(self) -> Column:
        """Folder name of a partition value; hexadecimal digits need no escaping in any store."""
        return F.coalesce(F.concat(F.lit("v"), F.hex(F.col(self.partition).cast("string"))), F.lit("null"))

    def _rows_in(self, df: DataFrame) -> dict[str, int]:
        """Rows in each partition of ``df``: at most one number per folder of the table."""
        return {row[0]: row[1] for row in df.groupBy(self._slot().alias("slot")).count().collect()}

    def _scan(self, folders: Sequence[str], schema: dict) -> DataFrame:
        wanted = T.StructType.fromJson(schema)
        if not folders:
            return self.spark.createDataFrame([], wanted)
        return self.spark.read.schema(wanted).parquet(*[f"{self.path}/{f}" for f in folders])

    def _of(self, record: dict, slots: set[str]) -> DataFrame:
        """The rows of some partitions, read from their folders only, with the schema of the record."""
        return self._scan([f for s in sorted(slots & record["folders"].keys()) for f in _listed(record["folders"][s])], record["schema"])

    def read(self) -> DataFrame:
        record = self._commits.latest()
        if record is None:
            raise FileNotFoundError(f"nothing committed below {self.path}")
        return self._of(record, set(record["folders"]))

    def _write(self, df: DataFrame) -> dict[str, str]:
        """Write rows to a new folder; the folder of each partition by its slot."""
        out = df.withColumn("_slot", self._slot())
        # Rows of one partition stay together, a heavy one spreads over several files. Ranges cost a second pass over the
        # rows for their borders, so only tables that are sorted have them.
        if self.deal:
            out = out.repartitionByRange("_slot", *self.sort_by) if self.sort_by else out.hint("rebalance", F.col("_slot"))
        if self.sort_by:
            out = out.sortWithinPartitions("_slot", *self.sort_by)
        run = f"data/{uuid.uuid4().hex}"
        out.write.partitionBy("_slot").option("compression", "zstd").parquet(f"{self.path}/{run}")
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{run}")
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [status.getPath().getName() for status in files.listStatus(folder)]
        return {n.removeprefix("_slot="): f"{run}/{n}" for n in names if n.startswith("_slot=")}

    def _beside(self, record: dict, staged: dict[str, str], updates: DataFrame, target_where: str | None) -> dict[str, list[str]]:
        """The folders of every partition when the written updates take the place of the rows with their keys. Which rows these are
        is found from keys and partitions alone; an unknown key meets no other, and rows outside the bounds stay."""
        near = set(staged) if self.keys_stay else set(record["folders"])
        found = list(dict.fromkeys([*self.keys, self.partition]))  # the partition may be one of the keys
        new = updates.select(*self.keys).hint("merge")  # as many as the updates: never a broadcast
        old = self._of(record, near)
        met = old if target_where is None else old.filter(target_where)
        gone = written(met.select(*found).join(new, self.keys, "left_semi").select(*found), "replaced")
        lost = self._rows_in(gone)
        held = self._rows_in(old.select(self.partition)) if lost else {}
        some = {slot for slot, count in lost.items() if count < held[slot]}
        folders = {slot: _listed(names) for slot, names in record["folders"].items() if slot not in lost}
        if some:
            rows, keys = self._of(record, some), gone.select(*self.keys).hint("merge")
            if target_where is None:
                kept = rows.join(keys, self.keys, "left_anti")
            else:
                inside = F.coalesce(F.expr(target_where), F.lit(False))
                kept = rows.filter(inside).join(keys, self.keys, "left_anti").select(*rows.columns).unionByName(rows.filter(~inside))
            folders |= {slot: [name] for slot, name in self._write(kept.select(*rows.columns)).items()}
        return folders | {slot: [*folders.get(slot, []), name] for slot, name in staged.items()}

    def upsert(
        self,
        updates: DataFrame,
        target_where: str | None = None,
        mark: str | None = None,
        whole_partitions: bool = False,
    ) -> None:
        """Apply ``updates`` once. ``target_where`` bounds the part of the table that can match;
        ``whole_partitions`` replaces every partition of the updates instead of merging into it."""
        updates = updates.withColumn(self.partition, F.col(self.partition).cast(self.partition_type))
        record = self._commits.latest()
        if record is not None:
            empty = self.spark.createDataFrame([], T.StructType.fromJson(record["schema"]))
            empty, updates = reconcile(empty, updates, self.on_schema_change)
        schema = (updates if record is None else empty).schema.jsonValue()
        # The updates are written in the table's layout at once.
        staged = self._write(updates)
        updates = self._scan(list(staged.values()), schema)
        repeated = repeated_keys(updates, self.keys).limit(1).collect()
        if repeated:
            raise ValueError(f"updates hold more than one row for key {repeated[0].asDict()}")
        if record is None:
            folders = staged
        elif whole_partitions:
            folders = record["folders"] | staged
        else:
            folders = self._beside(record, staged, updates, target_where)
        self._commits.add({"folders": folders, "schema": schema, "mark": mark})
