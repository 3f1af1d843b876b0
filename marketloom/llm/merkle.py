"""A Merkle manifest of a table: one tree per source, one tree over the sources, a witness for every row.

Leaves are appended in order to blocks of ``BLOCK`` aligned places. Inside a block a frontier of open subtrees
takes one leaf after another; a run of ``FAN`` siblings that is complete closes into its parent, and only then the
witnesses of all leaves below its members get the siblings they lacked. The root of a block is one append
to the next round, which has a ``BLOCK``-th of the nodes, and so on until each tree has one node. The other
way round, a block gets one row with the siblings above its root, and each leaf's own part is extended
by them. So no task holds more than a block, whatever the share of a source, and a witness of all levels exists
for one block at a time only.

Places are counted without a window over a source: rows are range-partitioned and sorted once, and offsets
come from a summary of (range, source). The driver sees one number, the size of the largest tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import chain, groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.operators.numbering import join_null_safe
from marketloom.session import written

#: Members of a run, and levels and places of a block.
FAN, HEIGHT = 16, 2
BLOCK = FAN**HEIGHT
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Frontier:
    """Open subtrees of a block of ``height`` levels; ``witness[i]`` has (left, right) siblings of leaf ``i`` by level,
    as far as their runs are complete."""

    def __init__(self, height: int):
        self.height = height
        self.open: list[list[tuple[str, int, int]]] = [[] for _ in range(height + 1)]
        self.witness: list[list[tuple[str, str]]] = []

    def append(self, digest: str) -> None:
        self.witness.append([])
        self._push(0, digest, len(self.witness) - 1, len(self.witness))

    def _push(self, level: int, digest: str, first: int, end: int) -> None:
        self.open[level].append((digest, first, end))
        if level < self.height and len(self.open[level]) == FAN:
            self._close(level)

    def _close(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        digests = [digest for digest, _, _ in run]
        for k, (_, first, end) in enumerate(run):
            siblings = "".join(digests[:k]), "".join(digests[k + 1 :])
            for leaf in range(first, end):
                self.witness[leaf].append(siblings)
        self._push(level + 1, sha256("".join(digests)), run[0][1], run[-1][2])

    def root(self) -> str:
        """Close the last runs, complete or not."""
        for level in range(self.height):
            if self.open[level]:
                self._close(level)
        return self.open[self.height][0][0]


def height_of(size: int) -> int:
    """Levels that a block has in a tree of ``size`` nodes: all, unless the tree is smaller than a block."""
    return min(HEIGHT, next(h for h in range(99) if FAN**h >= size))


def folded(leaf: str, witness: list[tuple[str, str]]) -> str:
    """The root that a leaf and its siblings give."""
    return reduce(lambda digest, s: sha256(s[0] + digest + s[1]), witness, leaf)


# ---- in tasks: rows sorted by tree, block, place --------------------------------------------------


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of one block after the other."""
    stream = (row for batch in batches for row in batch.to_pylist())
    for _, rows in groupby(stream, itemgetter("tree", "block")):
        yield list(rows)


def _frontier(rows: list[dict]) -> Frontier:
    frontier = Frontier(height_of(rows[0]["size"]))
    for row in rows:
        frontier.append(row["digest"])
    return frontier


def _arrow(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) >= 1024:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


UP = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("size", pa.int64()), ("digest", pa.string())])


def _up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The root of every block, as a node of the next round."""
    return _arrow(
        (
            {"tree": g[0]["tree"], "pos": g[0]["block"], "size": -(-g[0]["size"] // BLOCK), "digest": _frontier(g).root()}
            for g in _groups(batches)
        ),
        UP,
    )


ABOVE = [("tree", pa.string()), ("lefts", pa.list_(pa.string())), ("rights", pa.list_(pa.string())), ("subroot", pa.string()), ("root", pa.string())]
DOWN = pa.schema([*ABOVE, ("pos", pa.int64())])


def _witnessed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, dict, list[tuple[str, str]]]]:
    """(row, row above its block, whole witness) of every node; the row above comes first in its block."""
    for above, *rows in _groups(batches):
        frontier = _frontier(rows)
        frontier.root()
        rest = list(zip(above["lefts"], above["rights"], strict=True))
        for row, witness in zip(rows, frontier.witness, strict=True):
            yield row, above, witness + rest


def _down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The siblings of every node up to the root."""
    return _arrow(
        (
            {k: above[k] for k in ("tree", "subroot", "root")}
            | {"pos": row["pos"], "lefts": [x for x, _ in witness], "rights": [x for _, x in witness]}
            for row, above, witness in _witnessed(batches)
        ),
        DOWN,
    )


RESULT = "id {id}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of the witness and the root that the presented leaf gives, for every leaf."""
    batches = iter(batches)
    head = next(batches, None)
    if head is None:
        return
    names = ("leaf", "subroot", "root", "proof_sha256", "folded_root")
    schema = pa.schema([("id", head.schema.field("id").type), *((k, pa.string()) for k in names), ("verified", pa.bool_())])

    def told() -> Iterator[dict]:
        for row, above, witness in _witnessed(chain([head], batches)):
            found = folded(row["presented"] or row["digest"], witness)
            yield {
                "id": row["id"],
                "leaf": row["digest"],
                "subroot": above["subroot"],
                "root": above["root"],
                "proof_sha256": sha256("".join(a + b for a, b in witness)),
                "folded_root": found,
                "verified": found == above["root"],
            }

    yield from _arrow(told(), schema)


# ---- plans ------------------------------------------------------------------------------------------


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``pos``, their place from 0 among the rows of their ``tree`` by ``order``, and ``size``, the rows of
    the tree. NULLs come first."""
    by = [F.asc_nulls_first(c) for c in ("tree", *order)]
    row_id = F.monotonically_increasing_id()  # counts a task's rows from 0 below its 33rd bit, in the order of the sort
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_row", row_id)
    ranged = ranged.selectExpr("* EXCEPT (_row)", "shiftright(_row, 33) AS _range", f"_row & {(1 << 33) - 1}L AS _place")
    ranged = written(ranged, "leaves-in-order")
    parts = ranged.groupBy("tree", "_range").agg(F.count(F.lit(1)).alias("_rows"), F.min("_place").alias("_first"))
    of_tree = Window.partitionBy("tree")
    before = of_tree.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        "tree",
        "_range",
        (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_rows").over(of_tree).alias("size"),
    )
    near = join_null_safe(ranged, parts, ["tree", "_range"], "inner")
    return near.withColumn("pos", F.col("_place") + F.col("_shift")).drop("_range", "_place", "_shift")


def _by_block(nodes: DataFrame, above: DataFrame | None = None) -> DataFrame:
    """Nodes dealt by block and sorted by place; a block's row above stands first."""
    nodes = nodes.withColumn("block", F.floor(F.col("pos") / BLOCK))
    if above is not None:
        nodes = nodes.unionByName(above.withColumnsRenamed({"pos": "block"}), allowMissingColumns=True)
    return nodes.repartition("tree", "block").sortWithinPartitions("tree", "block", F.asc_nulls_first("pos"))


def raised(nodes: DataFrame) -> list[DataFrame]:
    """The nodes of every round; the last has one node for each tree."""
    rounds = [nodes]
    size = nodes.agg(F.max("size")).first()[0] or 1
    while size > 1:
        roots = _by_block(rounds[-1].select("tree", "pos", "size", "digest"))
        rounds.append(written(roots.mapInArrow(_up, "tree string, pos long, size long, digest string"), "block-roots"))
        size = -(-size // BLOCK)
    return rounds


NODE = ["tree", "pos", "size", "digest"]
SIBLINGS = "tree string, lefts array<string>, rights array<string>, subroot string, root string, pos long"


def lowered(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """From the rows above the trees, the rows above the blocks of the first round: ``tree``, ``lefts``, ``rights``,
    ``subroot``, ``root``, ``pos`` (of the block)."""
    for nodes in reversed(rounds[1:-1]):
        above = written(_by_block(nodes.select(*NODE), above).mapInArrow(_down, SIBLINGS), "witnesses")
    return above


def encoded(value: Column) -> Column:
    """A value so that different rows never have equal leaves: its length in bytes, a colon, itself."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*[encoded(c) for c in columns]).cast("binary"), 256)


def _above(df: DataFrame, presented: Column | None, fields: tuple[str, ...], id_column: str, source_column: str):
    """The leaves of ``df`` with their places, and the row above each of their blocks."""
    other = F.lit(None).cast("string") if presented is None else presented
    rows = df.select(
        F.col(source_column).cast("string").alias("tree"),
        F.col(id_column).alias("id"),
        leaf([F.col(c) for c in fields]).alias("digest"),
        other.alias("presented"),
    )
    leaves = placed(written(rows, "leaves"), ["id", "digest"])
    rounds = raised(leaves)
    subroots = rounds[-1].select(F.lit("").alias("tree"), F.col("tree").alias("source"), "digest")
    sources = placed(subroots, ["source"])
    trees = raised(sources)
    nothing = F.array().cast("array<string>")
    top = trees[-1].select("tree", nothing.alias("lefts"), nothing.alias("rights"), F.lit("").alias("subroot"), F.col("digest").alias("root"), "pos")
    if len(trees) > 1:
        of_sources = _by_block(sources.select(*NODE), lowered(trees, top)).mapInArrow(_down, SIBLINGS)
    else:
        of_sources = top
    named = sources.select("pos", "source", F.col("digest").alias("subroot"))
    joined = of_sources.drop("tree", "subroot").join(named, "pos").drop("pos")
    above = written(joined.select(F.col("source").alias("tree"), "lefts", "rights", "subroot", "root", F.lit(0).cast("long").alias("pos")), "source-witnesses")
    return leaves, lowered(rounds, above)


def manifest(
    df: DataFrame, presented: Column | None = None, fields: tuple[str, ...] = FIELDS, id_column: str = "doc_id", source_column: str = "source"
) -> DataFrame:
    """One row per row of ``df``: id, ``leaf``, ``subroot`` of its source, ``root``, ``proof_sha256`` (of all its
    siblings), ``folded_root`` and ``verified``.

    ``presented`` is a leaf to check in the place of the row's own, where it is not NULL: the root that it gives with the
    row's siblings is ``folded_root``. Leaves of a source come by id, NULL ids first, then by leaf, so rows
    that repeat an id have fixed places and repeated rows have neighbouring ones; rows with a NULL source are a
    tree of their own, the first. NULL and empty values have different leaves. Texts are hashed whole by the JVM
    and leave the first pass as a digest. Columns besides ``fields`` are ignored, whatever their
    names. An empty table gives an empty result.
    """
    leaves, above = _above(df, presented, fields, id_column, source_column)
    rows = _by_block(leaves, above).mapInArrow(_digests, RESULT.format(id=leaves.schema["id"].dataType.simpleString()))
    return rows.withColumnRenamed("id", id_column)


def proofs(df: DataFrame, fields: tuple[str, ...] = FIELDS, id_column: str = "doc_id", source_column: str = "source") -> DataFrame:
    """Every row's id, ``leaf``, ``subroot``, ``root`` and the witness itself: ``lefts`` and ``rights``, the joined
    digests beside it from the lowest level to the root. Rows as in ``manifest``."""
    leaves, above = _above(df, None, fields, id_column, source_column)
    found = _by_block(leaves.select(*NODE), above).mapInArrow(_down, SIBLINGS)
    named = leaves.select("tree", "pos", F.col("id").alias(id_column), F.col("digest").alias("leaf"))
    return join_null_safe(named, found, ["tree", "pos"], "inner").drop("tree", "pos")


def tampered(id_column: Column, fields: list[Column], text: Column) -> Column:
    """The leaf of a row whose text has its A-Z lower-cased, for a fixed fifth of the ids; NULL for other rows."""
    changed = [F.translate(text, UPPER, LOWER) if f is text else f for f in fields]
    fifth = F.crc32(id_column.cast("string").cast("binary")) % 5 == 0
    return F.when(fifth, leaf(changed))


def tamper_check(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``manifest`` of ``df``, checked with the fifth of its rows altered that ``tampered`` names."""
    text = F.col(text_column)
    columns = [text if c == text_column else F.col(c) for c in FIELDS]
    return manifest(df, tampered(F.col(id_column), columns, text))
