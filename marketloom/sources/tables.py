"""Reading inputs, landing them, and publishing results."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, TimestampNTZType, TimestampType

from marketloom.sources.commits import Commits
from marketloom.sources.schemas import ALL


def read_table(spark: SparkSession, folder: str, name: str, fmt: str = "parquet") -> DataFrame:
    """One input table with its declared schema; CSV files carry a header row."""
    reader = spark.read.schema(ALL[name])
    if fmt == "csv":
        return reader.option("header", True).csv(f"{folder}/{name}.csv")
    if fmt in ("parquet", "orc", "json"):
        return reader.format(fmt).load(f"{folder}/{name}.{fmt}")
    raise ValueError(f"unknown format {fmt!r}")


def read_inputs(
    spark: SparkSession, folder: str, names: Iterable[str] = tuple(ALL), fmt: str = "parquet"
) -> dict[str, DataFrame]:
    return {name: read_table(spark, folder, name, fmt) for name in names}


def land(inputs: dict[str, DataFrame], folder: str | None = None) -> dict[str, DataFrame]:
    """Landing step: pass the raw tables on unchanged, or keep a Parquet copy below ``folder``."""
    if folder is None:
        return dict(inputs)
    landed = {}
    for name, df in inputs.items():
        path = f"{folder}/landing/{name}"
        df.write.mode("overwrite").parquet(path)
        landed[name] = df.sparkSession.read.schema(df.schema).parquet(path)
    return landed


def named_view(df: DataFrame, name: str) -> DataFrame:
    """Give a pipeline's plan a name that SQL can use: nothing is computed or stored."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def clustered(df: DataFrame, keys: Sequence[str], files: int | None = None) -> DataFrame:
    """Lay rows out by key ranges, sorted inside each file, so that readers skip row groups.

    A heavy key spreads over several files because the range split samples all listed keys.
    """
    ranged = df.repartitionByRange(files, *keys) if files else df.repartitionByRange(*keys)
    return ranged.sortWithinPartitions(*keys)


def _rank_bits(df: DataFrame, column: str, bits: int) -> Column:
    """The place of a value among 2**bits equally full ranges of its column; NULL is the first. The borders come from
    a sketch of the whole column, 2**bits values at any size of the table."""
    shares = [k / (1 << bits) for k in range(1, 1 << bits)]
    borders = sorted(set(df.select(F.percentile_approx(column, shares, 10_000)).first()[0] or []))
    place = F.lit(0)
    step = 1 << (bits - 1)
    # Binary search over the borders, unrolled: ``bits`` comparisons for each row.
    listed = F.array(*[F.lit(b) for b in borders]) if borders else None
    while step and borders:
        at = place + step
        place = F.when((at <= len(borders)) & (F.col(column) >= F.get(listed, at - 1)), at).otherwise(place)
        step >>= 1
    return place


def interleaved(df: DataFrame, columns: Sequence[str], files: int | None = None, bits: int = 5) -> DataFrame:
    """Lay rows out along a curve that goes through the ranges of all ``columns`` at once, so that a filter on any one of
    them skips files and row groups, where a sort by the first column serves the first only.

    The curve's number takes one bit of the place of each column in turn, the highest bits first. Rows of one number
    are sorted by the columns; a heavy value spreads over the numbers of the other columns. Columns are numbers, days
    or times.
    """
    for c in columns:
        if not isinstance(df.schema[c].dataType, (NumericType, DateType, TimestampType, TimestampNTZType)):
            raise ValueError(f"column {c!r} is {df.schema[c].dataType.simpleString()}, not a number, day or time")
    places = [_rank_bits(df, c, bits) for c in columns]
    names = [f"_place_{k}" for k in range(len(columns))]
    placed = df.select("*", *[p.alias(n) for p, n in zip(places, names, strict=True)])
    curve = F.lit(0).cast("long")
    for bit in reversed(range(bits)):
        for name in names:
            curve = F.shiftleft(curve, 1).bitwiseOR(F.shiftright(F.col(name), bit).bitwiseAND(F.lit(1)).cast("long"))
    order = [F.col("_curve"), *[F.col(c) for c in columns]]
    numbered = placed.withColumn("_curve", curve)
    ranged = numbered.repartitionByRange(files, *order) if files else numbered.repartitionByRange(*order)
    return ranged.sortWithinPartitions(*order).drop("_curve", *names)


def bucketed(df: DataFrame, name: str, path: str, column: str, buckets: int, append: bool = False) -> DataFrame:
    """A table of its own whose rows lie in buckets by the hash of a column, sorted by it. Tables in equally many buckets by
    their keys are joined and grouped on these keys without a shuffle. ``path`` must be new, unless rows are appended to the
    table; ``name`` is the catalog's."""
    rows = df.repartition(buckets, column).write.mode("append" if append else "errorifexists").option("compression", "zstd")
    rows.bucketBy(buckets, column).sortBy(column).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


class PublishedTable:
    """A full-refresh table: every refresh is a new folder, and a commit record names the current one.

    Readers holding the previous folder are not disturbed, and a refresh that fails at any point
    before its record is in place changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")
        self._commits = Commits(spark, self.path)

    def exists(self) -> bool:
        return self.version() is not None

    def version(self) -> str | None:
        record = self._commits.latest()
        return record and record["version"]

    def read(self) -> DataFrame:
        version = self.version()
        if version is None:
            raise FileNotFoundError(f"no published version below {self.path}")
        return self.spark.read.parquet(f"{self.path}/{version}")

    def publish(self, df: DataFrame, version: str, cluster_by: Sequence[str] = (), interleave: bool = False) -> DataFrame:
        """Write ``df`` as ``version`` and make it current. The same version may be rewritten
        after a failed run, never once it is current. ``interleave`` serves filters on each of the columns."""
        if version == self.version():
            raise ValueError(f"version {version!r} is already published")
        layout = interleaved if interleave else clustered
        out = layout(df, cluster_by) if cluster_by else df
        out.write.mode("overwrite").parquet(f"{self.path}/{version}")
        self._commits.add({"version": version})
        return self.read()
