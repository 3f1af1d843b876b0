"""Best-fit packing of token sequences, in bulk-synchronous supersteps.

1. Texts are tokenised where they lie. A text is its token ids and an end id; longer ones are
   cut at the capacity. Each piece gets its rank among the pieces of its length within its task,
   and the pieces are written once.
2. Lengths and gaps are whole numbers up to the capacity. Sorted by size, equal pieces form one run
   and equal gaps form one run, so the whole corpus is at most ``capacity`` runs of pieces: counts by
   task and length, summed by Spark.
3. A superstep takes the run of the longest pieces not placed yet. A sweep over the gaps from that
   length upwards gives every piece of the run its successor, the smallest gap that holds it. Pieces
   that want the same gap are dealt out by rank: the first ones fill the first sequences of the gap's
   run, the others go on to the next gap, or open sequences. The gaps are updated, and the
   next superstep follows. This is best-fit-decreasing for all pieces of a length at once; its work and
   its plan depend on the capacity, never on the number of texts.
4. Every piece finds its sequence and place from its length and rank: a join with the offsets of
   its task, then a search in the plan, which is bounded and therefore broadcast.

Ranks come from the order of rows within a task of the written table's scan, so a lost executor
repeats the same ranks before the write is committed, and reads them afterwards.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.llm import words as W
from marketloom.session import written

CAPACITY = 2048
END = 0
#: Parts of words that a worker remembers, some 35 bytes each; the memory is emptied when full.
REMEMBERED = 800_000

_PIECES = "id long, piece int, start long, length long, crc long, task int, rank long"


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write for bytes: printable ones stand for themselves,
    the others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


_SPACE, _LETTER, _DIGIT, _SIGN = range(4)


def _kinds() -> np.ndarray:
    kinds = np.full(256, _SIGN, np.uint8)
    kinds[[9, 10, 11, 12, 13, 32]] = _SPACE
    kinds[48:58] = _DIGIT
    kinds[65:91] = kinds[97:123] = kinds[128:] = _LETTER
    return kinds


_KIND = _kinds()
#: Endings that the vocabulary splits off after an apostrophe.
_ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


def _starts(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(no white space, start of a part) of the bytes of texts: runs of letters, single digits, runs of
    other signs, and an apostrophe in front of other signs with an ending of ``_ENDINGS``."""
    kind = _KIND[data]
    text_starts = np.zeros(len(data) + 4, bool)
    text_starts[bounds] = True
    begins = text_starts[: len(data)] | (kind == _DIGIT)
    begins[1:] |= kind[1:] != kind[:-1]
    begins &= kind != _SPACE
    low = np.append(data | 32, np.zeros(4, np.uint8))  # letters in lower case
    marks = np.flatnonzero((data == 39) & begins)
    for ending in _ENDINGS:
        fits = np.ones(len(marks), bool)
        for k, letter in enumerate(ending.encode(), 1):
            fits &= (low[marks + k] == letter) & ~text_starts[marks + k]
        found, marks = marks[fits], marks[~fits]
        begins[found + 1] = False
        after = found + 1 + len(ending)
        after = after[after < len(data)]
        begins[after] |= kind[after] == _LETTER
    return kind != _SPACE, begins


class Encoder:
    """Token ids of many texts at once, as little-endian 32-bit numbers.

    The vocabulary's rules (white space is dropped, lower case, each run of letters, each digit and
    each run of other signs by itself) let texts be encoded part by part. The parts of a block of texts are
    cut and hashed in numpy; only distinct parts that the worker does not remember are tokenised, and the ids of all
    parts are gathered from one array. Texts with signs beyond ASCII are cut by a pattern, and texts with letters beyond
    Latin ones or with the name of a special token go to the library as a whole.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        #: How the vocabulary splits words.
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        self.simple = regex.compile(r"[\t-\r -~À-ÖØ-öø-įı-ɏ]*+").fullmatch
        self.plain = regex.compile(r"[\t-\r -~¡-¬®-ɏ‐-‧‰-⁞€]*+").fullmatch
        special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(map(regex.escape, special)) or r"(?!)").search
        self.letters = _byte_letters()
        self.forget()

    def forget(self) -> None:
        """Empty the memory of parts: sorted hashes, and where in ``ids`` each one's begin and how many they are."""
        self.hashes, self.begins, self.sizes = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.ids = array("I")

    def _part(self, part: str) -> list[int]:
        return [t.id for t in self.model.tokenize(part.encode().decode("latin-1").translate(self.letters))]

    def _learn(self, hashes: np.ndarray, parts: list[bytes]) -> None:
        begins, sizes = [], []
        for part in parts:
            found = self._part(part.decode().lower())
            begins.append(len(self.ids))
            sizes.append(len(found))
            self.ids.extend(found)
        hashes = np.concatenate([self.hashes, hashes])
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        self.begins = np.concatenate([self.begins, np.array(begins, np.int64)])[order]
        self.sizes = np.concatenate([self.sizes, np.array(sizes, np.int32)])[order]

    def _by_parts(self, texts: pa.Array) -> Iterator[bytes]:
        for start, end, data, bounds in W.blocks(texts):
            if len(self.hashes) > REMEMBERED or len(self.ids) > 8 * REMEMBERED:
                self.forget()
            found = W.runs(data, bounds, *_starts(data, bounds))
            hashes, first, place = np.unique(found.hashes, return_index=True, return_inverse=True)
            at = np.searchsorted(self.hashes, hashes)
            known = np.append(self.hashes, np.uint64(0))[at] == hashes
            known[at == len(self.hashes)] = False
            new = first[~known]
            if len(new):
                parts = [data[a : a + n].tobytes() for a, n in zip(found.starts[new].tolist(), found.lengths[new].tolist(), strict=True)]
                self._learn(hashes[~known], parts)
                at = np.searchsorted(self.hashes, hashes)
            begins, sizes = self.begins[at][place], self.sizes[at][place].astype(np.int64)
            ends = np.cumsum(sizes)
            where = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins - ends + sizes, sizes)
            ids = np.frombuffer(self.ids, np.uint32)[where] if len(where) else np.zeros(0, np.uint32)
            cuts = np.append(0, ends)[found.first]
            for i in range(end - start):
                yield ids[cuts[i] : cuts[i + 1]].astype("<u4").tobytes()

    def __call__(self, texts: pa.Array) -> list[bytes]:
        """The ids of every text; NULL is empty."""
        import unicodedata

        out: list[bytes] = [b""] * len(texts)
        rows, simple = [], []
        for row, text in enumerate(texts.to_pylist()):
            text = unicodedata.normalize("NFC", text or "")
            if self.special(text) or not self.plain(text):
                ids = self.whole.encode(text, add_special_tokens=False).ids
            elif self.simple(text):
                rows.append(row)
                simple.append(text)
                continue
            else:
                memory: dict[str, list[int]] = {}
                ids = [i for p in self.split(text.lower()) for i in memory.get(p) or memory.setdefault(p, self._part(p))]
            out[row] = np.array(ids, "<u4").tobytes()
        for row, ids in zip(rows, self._by_parts(pa.array(simple, pa.large_string())), strict=True):
            out[row] = ids
        return out


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _cut(path: str, capacity: int):
    """The pieces of each text, with their rank by length within the task."""
    names = [c.split()[0] for c in _PIECES.split(",")]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, ranks = _encoder(path), TaskContext.get().partitionId(), Counter()
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            rows = []
            for key, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1)), strict=True):
                ids += end
                for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[start : start + 4 * capacity]
                    length = len(part) // 4
                    rows.append((key, piece, start // 4, length, zlib.crc32(part), task, ranks[length]))
                    ranks[length] += 1
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return run


def best_fit(counts: dict[int, int], capacity: int) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each length, runs (first rank, first sequence, pieces of each sequence, offset) by rank.

    ``counts`` has the number of pieces of each length. Runs of gaps are (first sequence,
    sequences); a sequence's gap also tells its filled part.
    """
    plan: dict[int, list[tuple[int, int, int, int]]] = {}
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)
    sizes: list[int] = []  # of gaps that have runs, ascending
    opened = 0

    def free(gap: int, first: int, many: int) -> None:
        if gap and many:
            if gap not in gaps:
                insort(sizes, gap)
            gaps[gap].append((first, many))

    for length in sorted(counts, reverse=True):
        left, rank, runs = counts[length], 0, []

        def fill(gap: int, first: int, many: int) -> int:
            """Put pieces of this length into ``many`` equal gaps; the number of sequences used."""
            nonlocal left, rank
            each = gap // length
            whole = min(many, left // each)
            if whole:
                runs.append((rank, first, each, capacity - gap))
                free(gap - each * length, first, whole)
                rank, left = rank + whole * each, left - whole * each
            if whole < many and left:
                runs.append((rank, first + whole, left, capacity - gap))
                free(gap - left * length, first + whole, 1)
                rank, left = rank + left, 0
                whole += 1
            return whole

        while left:
            at = bisect_left(sizes, length)
            if at == len(sizes):
                opened += fill(capacity, opened, -(-left // (capacity // length)))
                continue
            gap = sizes.pop(at)
            for first, many in gaps.pop(gap):
                used = fill(gap, first, many) if left else 0
                free(gap, first + used, many - used)
        plan[length] = runs
    return plan


def _places(capacity: int, plan_of):
    """Sequence and offset of each piece from its length and rank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = {length: np.array(runs, np.int64).T for length, runs in plan_of().items()}
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for size in np.unique(length):
                at = np.flatnonzero(length == size)
                first_rank, first, each, filled = plan[int(size)]
                run = np.searchsorted(first_rank, rank[at], "right") - 1
                past = rank[at] - first_rank[run]
                sequence[at] = first[run] + past // each[run]
                offset[at] = filled[run] + past % each[run] * size
            kept = [batch.column(c) for c in ("id", "piece", "start", "length", "crc")]
            yield pa.record_batch([*kept, pa.array(sequence), pa.array(offset)], names=["id", "piece", "start", "length", "crc", "sequence", "offset"])

    return run


def pack(df: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """A row per piece of every text: id, ``piece``, ``start``, ``length``, ``ids_crc32``,
    ``sequence_id`` and ``offset``.

    ``vocabulary`` is the path of a file of the tokenizers library on every executor. A NULL or empty text
    is its end id alone. NULL and repeated ids are kept as they are; every row is packed. Other columns
    are ignored, whatever their names; an empty table gives an empty result.
    """
    spark = df.sparkSession
    texts = df.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    pieces = written(texts.mapInArrow(_cut(vocabulary, capacity), _PIECES), "pieces")
    counts = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("many"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = written(counts.withColumn("before", F.coalesce(F.sum("many").over(before), F.lit(0))), "lengths")
    totals = counts.groupBy("length").agg(F.sum("many")).collect()  # at most ``capacity`` rows
    plan = spark.sparkContext.broadcast(best_fit({r[0]: r[1] for r in totals}, capacity))
    ranked = pieces.join(counts.select("length", "task", "before"), ["length", "task"]).withColumn("rank", F.col("rank") + F.col("before"))
    placed = ranked.select("id", "piece", "start", "length", "crc", "rank").mapInArrow(
        _places(capacity, lambda: plan.value), "id long, piece int, start long, length long, crc long, sequence long, offset long"
    )
    return placed.select(
        F.col("id").alias(id_column), "piece", "start", "length", F.col("crc").alias("ids_crc32"), F.col("sequence").alias("sequence_id"), "offset"
    )
