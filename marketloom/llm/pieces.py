"""Encoding and decoding with a SentencePiece vocabulary by suffix-array matching.

Texts are encoded a batch at a time. The batch's text is written with its spaces as the vocabulary
writes them and cut where no piece can cross, before a run of spaces and around line breaks; each different
part is taken once. A suffix array indexes the concatenated parts, to the depth of the longest piece, and two binary
searches for every piece of the vocabulary, all at once, give the range of suffixes that begin with it. The ranges are all
occurrences of all pieces, the edges over the text's positions. Sorted by position, they are relaxed.

The vocabulary at hand is of the byte-pair kind, for which a best path by summed scores would give other ids
than the vocabulary's own rule. Relaxation therefore follows this rule: in every round, each part joins the
neighbours under its best edge, the one with the highest score and then the leftmost, among the edges
that span exactly two of the pieces so far. Edges with an end inside a piece are dropped. The rounds
end when no part has such an edge. What ``ROUNDS`` rounds have not finished, long parts without spaces,
goes on by the same rule with a heap of such edges, looking again only at the neighbours of each join, so that
a part of n characters takes n log n steps. Characters without a piece become bytes.

Very long texts are taken whole. Memory grows with the longest run of text without a space or line break,
by some 200 bytes a character.

Parts seen before are remembered, in a bounded store that is emptied when full.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Characters of text that are looked through at once, and of parts in one suffix array.
TEXT, SPAN = 1 << 23, 1 << 19
REMEMBERED = 500_000
#: Rounds in which all parts join side by side, before what is left goes on one edge after the other.
ROUNDS = 24
#: Breaks around which parts end, if no longer piece has them.
BREAKS = "\n\r\t"


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by their suffixes' first ``depth`` codes at least, by prefix doubling."""
    order = np.argsort(codes, kind="stable")
    rank = np.empty(len(codes), np.int64)
    ordered = codes[order]
    rank[order] = np.cumsum(np.append(0, ordered[1:] != ordered[:-1]))
    width = 1
    while width < depth:
        following = np.zeros(len(codes), np.int64)
        following[:-width] = rank[width:] + 1 if width < len(codes) else following[:-width]
        key = rank * np.int64(len(codes) + 2) + following
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank[order] = np.cumsum(np.append(0, ordered[1:] != ordered[:-1]))
        width *= 2
    return order


def occurrences(codes: np.ndarray, order: np.ndarray, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the range of ``order`` whose suffixes begin with each pattern (rows padded with -1). Patterns are searched by
    classes of length, the end of the range only for those that occur."""
    padded = np.append(codes, np.full(patterns.shape[1], -1, codes.dtype))
    lows, highs = np.zeros(len(patterns), np.int64), np.zeros(len(patterns), np.int64)
    shorter = 0
    for width in sorted({min(w, patterns.shape[1]) for w in (3, 6, 9, patterns.shape[1])}):
        rows = np.flatnonzero((lengths > shorter) & (lengths <= width))
        shorter, columns = width, np.arange(width)
        wanted, within = patterns[rows, :width], columns < lengths[rows, None]

        def compare(which: np.ndarray, at: np.ndarray, columns=columns, wanted=wanted, within=within) -> tuple[np.ndarray, np.ndarray]:
            """Whether the suffixes begin with the patterns, and whether they come before them."""
            suffix = padded[order[at][:, None] + columns]
            differs = (suffix != wanted[which]) & within[which]
            first, each = np.argmax(differs, axis=1), np.arange(len(which))
            return ~differs[each, first], suffix[each, first] < wanted[which, first]

        def search(which: np.ndarray, low: np.ndarray, after: bool, compare=compare) -> np.ndarray:
            """The first place from ``low`` whose suffix is not before the pattern; with ``after``, nor begins with it."""
            high, left = np.full(len(which), len(order), np.int64), np.flatnonzero(low < len(order))
            while len(left):
                middle = (low[left] + high[left]) // 2
                same, before = compare(which[left], middle)
                right = np.where(same, after, before)
                low[left] = np.where(right, middle + 1, low[left])
                high[left] = np.where(right, high[left], middle)
                left = left[low[left] < high[left]]
            return low

        low = search(np.arange(len(rows)), np.zeros(len(rows), np.int64), False)
        lows[rows] = highs[rows] = low
        inside = np.flatnonzero(low < len(order))
        occurs = inside[compare(inside, low[inside])[0]]
        highs[rows[occurs]] = search(occurs, low[occurs], True)
    return lows, highs


def join_in_order(edge: np.ndarray, start: np.ndarray, end: np.ndarray, rank: np.ndarray) -> list[tuple[int, int]]:
    """(place, number of the edge) of all joins, the edge of least ``rank`` over two neighbours first, then the leftmost.

    ``edge`` marks where pieces begin, with an end mark; those inside joined pieces are cleared. The edges come by start, then by end.
    """
    size = len(edge)
    bounds = np.flatnonzero(edge)
    after, before = np.full(size + 1, size, np.int64), np.full(size + 1, -1, np.int64)
    after[bounds[:-1]], before[bounds[1:]] = bounds[1:], bounds[:-1]
    first = memoryview(np.searchsorted(start, np.arange(size + 1)))
    after, before, marks, ends, ranks = (memoryview(x) for x in (after, before, edge, np.ascontiguousarray(end), np.ascontiguousarray(rank)))

    def over(place: int) -> int:
        """The edge over the piece at ``place`` and the next one; -1 without one."""
        stop = after[after[place]]
        for k in range(first[place], first[place + 1]):
            if ends[k] >= stop:
                return k if ends[k] == stop else -1
        return -1

    def offer(place: int) -> None:
        k = over(place)
        if k >= 0:
            heapq.heappush(heap, ranks[k] * size + place)

    heap: list[int] = []
    for place in np.unique(start).tolist():
        offer(place)
    joins = []
    while heap:
        best, place = divmod(heapq.heappop(heap), size)
        k = over(place) if marks[place] else -1
        if k < 0 or ranks[k] != best:  # joined otherwise meanwhile
            continue
        middle, stop = after[place], ends[k]
        marks[middle] = False
        after[place], before[stop] = stop, place
        joins.append((place, k))
        offer(place)
        if before[place] >= 0:
            offer(before[place])
    return joins


class Pieces:
    """A byte-pair vocabulary with byte fallback, read from a SentencePiece model file."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        count = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(count)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(count)]
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if model.is_byte(i)}
        self.bytes_of = {i: b for b, i in self.byte.items()}
        # What each id stands for when it is decoded.
        self.raw = [b"" if special[i] else bytes([self.bytes_of[i]]) if i in self.bytes_of else p.encode() for i, p in enumerate(self.pieces)]
        plain = [i for i in range(count) if not special[i] and i not in self.bytes_of]
        self.single = {self.pieces[i]: i for i in plain if len(self.pieces[i]) == 1}
        longer = np.array([i for i in plain if len(self.pieces[i]) > 1])
        scores = np.array([model.get_score(int(i)) for i in longer])
        self.ids = longer
        self.rank = np.unique(-scores, return_inverse=True)[1].astype(np.int64)  # 0 joins first
        self.lengths = np.array([len(self.pieces[i]) for i in longer])
        self.depth = int(self.lengths.max())
        self.patterns = np.full((len(longer), self.depth), -1, np.int32)
        for row, i in enumerate(longer):
            self.patterns[row, : self.lengths[row]] = [ord(c) for c in self.pieces[i]]
        inner = {c for i in longer for c in self.pieces[i]}
        if any(SPACE in self.pieces[i].lstrip(SPACE) for i in longer):
            raise ValueError("pieces that hold a space after another sign are not supported")
        breaks = "".join(c for c in BREAKS if c not in inner)
        self.parts = re.compile(rf"{SPACE}+[^{SPACE}{breaks}]*|[^{SPACE}{breaks}]+|[{breaks}]" if breaks else rf"{SPACE}+[^{SPACE}]*|[^{SPACE}]+").findall
        self.known: dict[str, bytes] = {}

    def _joined(self, parts: list[str]) -> list[bytes]:
        """The ids of each part as little-endian 32-bit numbers."""
        text = "\x00".join(parts)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.int32)
        sizes = np.array([len(p) for p in parts])
        begins = np.cumsum(sizes + 1) - sizes - 1
        owner = np.repeat(np.arange(len(parts)), sizes + 1)[: len(codes)]
        order = suffix_array(codes, self.depth)
        low, high = occurrences(codes, order, self.patterns, self.lengths)
        times = high - low
        piece = np.repeat(np.arange(len(times)), times)
        start = order[np.arange(len(piece)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low, times)]
        by_place = np.argsort(start * np.int64(self.depth + 1) + self.lengths[piece], kind="stable")
        piece, start = piece[by_place], start[by_place]
        end = start + self.lengths[piece]
        rank, part = self.rank[piece], owner[start]
        longest = int(sizes.max(initial=0)) + 1
        key = rank * longest + (start - begins[part])  # by score, then by place in the part
        edge = np.ones(len(codes) + 1, bool)  # where a piece begins
        symbol = np.full(len(codes), -1, np.int64)
        rounds = 0
        while len(part) and rounds < ROUNDS:
            rounds += 1
            before = np.cumsum(edge)
            inside = before[end - 1] - before[start]
            alive = edge[start] & edge[end] & (inside > 0)
            piece, start, end, key, part, inside = (x[alive] for x in (piece, start, end, key, part, inside))
            ready = np.flatnonzero(inside == 1)
            if not len(ready):
                part = part[:0]
                break
            group = part[ready]
            firsts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            best = np.minimum.reduceat(key[ready], firsts)
            chosen = ready[key[ready] == np.repeat(best, np.diff(firsts, append=len(ready)))]
            for k in range(1, self.depth):
                inner = chosen[end[chosen] - start[chosen] > k]
                edge[start[inner] + k] = False
            symbol[start[chosen]] = self.ids[piece[chosen]]
        if len(part):
            for place, k in join_in_order(edge, start, end, self.rank[piece]):
                symbol[place] = self.ids[piece[k]]
        edge[begins[1:] - 1] = False  # the separators are no pieces
        at = np.flatnonzero(edge[: len(codes)])
        found, first = symbol[at], codes[at]
        alone = np.flatnonzero(found < 0)
        letters, which = np.unique(first[alone], return_inverse=True)
        ids = [self._letter(chr(c)) for c in letters]
        found[alone] = np.array([x[0] for x in ids], np.int64)[which] if len(alone) else 0
        width = np.ones(len(at), np.int64)
        width[alone] = np.array([len(x) for x in ids], np.int64)[which] if len(alone) else 1
        place = np.cumsum(width) - width
        out = np.repeat(found, width).astype("<u4")
        for k in np.flatnonzero(width > 1):  # characters as bytes
            out[place[k] : place[k] + width[k]] = self._letter(chr(first[k]))
        cuts = np.append(place, len(out))[np.searchsorted(at, np.append(begins, len(codes) + 1))] * 4
        whole, cuts = out.tobytes(), cuts.tolist()
        return [whole[x:y] for x, y in zip(cuts, cuts[1:], strict=False)]

    def _letter(self, letter: str) -> tuple[int, ...]:
        """The id of a character, or those of its bytes."""
        if letter in self.single:
            return (self.single[letter],)
        return tuple(self.byte[b] for b in letter.encode("utf-8", "surrogatepass"))

    def _learn(self, parts: list[str]) -> None:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        held, size = [], 0
        for part in [*parts, None]:
            if held and (part is None or size + len(part) > SPAN):
                self.known.update(zip(held, self._joined(held), strict=True))
                held, size = [], 0
            if part is not None:
                held.append(part)
                size += len(part) + 1

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers; none for an empty text."""
        cut = [self.parts(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        known = self.known
        unseen = list(dict.fromkeys(p for parts in cut for p in parts if p not in known))
        rest = {p for parts in cut for p in parts} if unseen and len(known) > REMEMBERED else None
        if rest is not None:  # the store is about to be emptied
            unseen = list(rest)
        if unseen:
            self._learn(unseen)
        return [b"".join([known[p] for p in parts]) for parts in cut]

    def decode(self, ids: bytes) -> str:
        """The text of ids: bytes that are no character become U+FFFD, special pieces nothing."""
        text = b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")
        return text.replace(SPACE, " ").removeprefix(" ")


_LOADED: dict[str, Pieces] = {}


def _pieces(path: str) -> Pieces:
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def _groups(texts: pa.Array, size: int = TEXT) -> Iterator[list[str]]:
    held, total = [], 0
    for text in texts:
        held.append(text.as_py() or "")
        total += len(held[-1])
        if total >= size:
            yield held
            held, total = [], 0
    if held:
        yield held


def encode(df: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, ``ids``) of every row: token ids as an array. A NULL or empty text has none; NULL and repeated ids
    are kept. Other columns are ignored, whatever their names; an empty table gives an empty result.

    ``vocabulary`` is the path of the model file on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(vocabulary)
        for batch in batches:
            start = 0
            for texts in _groups(batch.column(1)):
                ids = pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in pieces.encode(texts)], pa.list_(pa.int32()))
                yield pa.record_batch([batch.column(0).slice(start, len(texts)), ids], names=["id", "ids"])
                start += len(texts)

    kind = dict(df.dtypes)[id_column]
    rows = df.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_column)


def decode(df: DataFrame, vocabulary: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """(id, ``text``) of every row of ids; NULL ids decode to the empty text, NULL elements and unknown numbers are an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(vocabulary)
        for batch in batches:
            texts = [pieces.decode(np.array(ids or [], "<u4").tobytes()) for ids in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    kind = dict(df.dtypes)[id_column]
    rows = df.select(F.col(id_column).alias("id"), F.col(ids_column).cast("array<int>").alias("ids"))
    return rows.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_column)


def round_trip(df: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, ``n_ids``, ``ids_crc32`` of the ids as little-endian 32-bit numbers, ``decoded_sha256`` of the decoded
    text, ``exact``: whether it is the text) of every row, encoded and decoded where it lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(vocabulary)
        for batch in batches:
            rows: list[tuple] = []
            for texts in _groups(batch.column(1)):
                for text, ids in zip(texts, pieces.encode(texts), strict=True):
                    back = pieces.decode(ids)
                    rows.append((len(ids) // 4, zlib.crc32(ids), hashlib.sha256(back.encode()).hexdigest(), back == text))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            types = [pa.int64(), pa.int64(), pa.string(), pa.bool_()]
            yield pa.record_batch([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["id", "n_ids", "ids_crc32", "decoded_sha256", "exact"])

    kind = dict(df.dtypes)[id_column]
    rows = df.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_ids long, ids_crc32 long, decoded_sha256 string, exact boolean").withColumnRenamed("id", id_column)
