r"""Scan for secrets by a trigram inverted index.

From the syntax tree of every rule's pattern a Boolean query over trigrams is derived that each match must
satisfy: an OR of ANDs, e.g. ``AKI`` and ``KIA`` for ``AKIA[A-Z0-9]+``. Texts are indexed by segment (the rows of one Arrow
batch): a posting list for each trigram that some query needs, over bytes with A-Z as a-z. Postings are intersected, the
shortest first, and united; only the rows that remain are read by the rule's pattern. A pattern without mandatory
trigrams reads every row.

``scan`` indexes and reads in one pass, so texts are never shuffled and a lost task repeats its own rows only.
``postings`` gives the index as a table and ``candidates`` evaluates rules on it by array functions, for rules that come
later than the index.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import product
from re import _constants as sre
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm.words import blocks

#: OR of ANDs of trigrams; one empty AND holds for every text.
Query = frozenset[frozenset[bytes]]
EVERY: Query = frozenset([frozenset()])
#: Alternatives that are followed as literal strings, and ANDs that a query may have; beyond these a query gets weaker, never wrong.
STRINGS, TERMS = 128, 256


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` from left to right without overlap, of which those stay whose ``group`` has
    at least ``least`` characters."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0


def either_case(words: str) -> str:
    """A pattern with both cases of every ASCII letter."""
    return re.sub("[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", words)


BASE = (
    Rule("assign", either_case("(password|passwd|secret|token|api_?key)") + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2),
    Rule("access", "AKIA[A-Z0-9]+", 16),
    Rule("hex", "[0-9a-f]{32,}"),
)
#: Published forms of keys that the base rules miss or see in part.
MORE = (
    Rule("private", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("repository", "gh[opsur]_[A-Za-z0-9]+", 40),
    Rule("chat", "xox[abprs]-[A-Za-z0-9-]+", 24),
    Rule("web", r"\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 32),  # payload and signature of a signed token
    Rule("maps", "AIza[0-9A-Za-z_-]+", 39),
    Rule("payment", "[rs]k_live_[0-9A-Za-z]+", 24),
    Rule("login", r"(https?|ftp|postgres|mysql|mongodb)://[^\x20\x09-\x0D/:@]+:([^\x20\x09-\x0D/:@]+)@", 4, 2),
)
RULES = (*BASE, *MORE)


# ---- trigram queries from patterns ----------------------------------------------------------------


def _least(terms: Iterable[frozenset[bytes]]) -> Query:
    """Without the ANDs that another one implies; of too many, none is asked for."""
    kept: list[frozenset[bytes]] = []
    for term in sorted(set(terms), key=len):
        if not any(k <= term for k in kept):
            kept.append(term)
    return frozenset(kept) if len(kept) <= TERMS else EVERY


def _both(a: Query, b: Query) -> Query:
    if a == EVERY or b == EVERY:
        return b if a == EVERY else a
    if len(a) * len(b) > TERMS:
        return min(a, b, key=len)
    return _least(x | y for x, y in product(a, b))


def _of_strings(strings: set[str]) -> Query:
    def term(s: str) -> frozenset[bytes]:
        data = lowered(s.encode())
        return frozenset(data[k : k + 3] for k in range(len(data) - 2))

    return _least(term(s) for s in strings)


def lowered(data: bytes) -> bytes:
    return data.lower()  # of bytes: A-Z only


def _folded(code: int) -> str:
    """A character as the index has it."""
    return chr(code).lower() if code < 128 else chr(code)


@dataclass
class _Part:
    """Part of a pattern: all strings it matches if they are few, else None, and what any match needs."""

    strings: set[str] | None
    query: Query = EVERY


def _sequence(parts: Iterable[_Part]) -> _Part:
    """Parts one after the other: neighbouring literals are joined, so trigrams reach across them."""
    run, query, whole = {""}, EVERY, True
    for part in parts:
        if part.strings is not None and len(run) * len(part.strings) <= STRINGS:
            run = {a + b for a, b in product(run, part.strings)}
            continue
        query = _both(query, _of_strings(run))
        whole = False
        if part.strings is not None:
            run = part.strings
        else:
            run, query = {""}, _both(query, part.query)
    if whole:
        return _Part(run)
    return _Part(None, _both(query, _of_strings(run)))


def _query(part: _Part) -> Query:
    return part.query if part.strings is None else _of_strings(part.strings)


def _members(items: list) -> set[str] | None:
    found: set[str] = set()
    for op, value in items:
        if op is sre.LITERAL:
            found.add(_folded(value))
        elif op is sre.RANGE and value[1] - value[0] < 8:
            found |= {_folded(c) for c in range(value[0], value[1] + 1)}
        else:
            return None
    return found if len(found) <= 8 else None


def _cases(part: _Part, flags: int) -> _Part:
    """In either case some letters match others beyond ASCII (k the Kelvin sign), which the index does not fold."""
    if flags & re.IGNORECASE and not flags & re.ASCII and not all(s.isascii() and s not in "iks" for s in part.strings or ()):
        return _Part(None)
    return part


def _part(node: tuple, flags: int) -> _Part:
    op, value = node
    if op is sre.LITERAL:
        return _cases(_Part({_folded(value)}), flags)
    if op is sre.IN:
        found = _members(value)
        return _Part(None) if found is None else _cases(_Part(found), flags)
    if op is sre.SUBPATTERN:
        _, add, drop, inner = value
        return _parts(inner, (flags | add) & ~drop)
    if op is sre.ATOMIC_GROUP:
        return _parts(value, flags)
    if op is sre.BRANCH:
        options = [_parts(p, flags) for p in value[1]]
        if all(p.strings is not None for p in options):
            together = set().union(*(p.strings for p in options))
            if len(together) <= STRINGS:
                return _Part(together)
        queries = [_query(p) for p in options]
        return _Part(None, EVERY if EVERY in queries else _least(t for q in queries for t in q))
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
        low, high, inner = value
        one = _parts(inner, flags)
        if one.strings is not None and high == 1:
            return _Part(one.strings | {""}) if low == 0 else one
        if low == 0:
            return _Part(None)
        if one.strings is not None and low == high and len(one.strings) ** low <= STRINGS:
            return _sequence([one] * low)
        return _Part(None, _query(one))
    if op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
        return _Part({""})
    return _Part(None)


def _parts(pattern, flags: int) -> _Part:
    return _sequence(_part(node, flags) for node in pattern)


def trigram_query(pattern: str) -> Query:
    """What the trigrams of a text must satisfy if ``pattern`` matches in it; ``EVERY`` if nothing is mandatory."""
    parsed = parser.parse(pattern)
    if parsed.state.flags & (re.VERBOSE | re.LOCALE):
        return EVERY
    return _query(_parts(parsed, parsed.state.flags))


# ---- the index of a segment --------------------------------------------------------------------------


def _number(trigram: bytes) -> int:
    return trigram[0] << 16 | trigram[1] << 8 | trigram[2]


def _needed(queries: Iterable[Query]) -> np.ndarray:
    """Numbers of all trigrams that some query asks for, sorted."""
    return np.array(sorted({_number(t) for q in queries for term in q for t in term}), np.int64)


_FOLD = np.frombuffer(lowered(bytes(range(256))), np.uint8)


def index(texts: pa.Array, needed: np.ndarray) -> dict[int, np.ndarray]:
    """Posting lists of a segment: trigram -> sorted rows that hold it."""
    known = np.zeros(1 << 24, bool)
    known[needed] = True
    found: list[np.ndarray] = []
    for start, _, data, bounds in blocks(texts):
        if len(data) < 3:
            continue
        low = _FOLD[data].astype(np.int64)
        numbers = low[:-2] << 16 | low[1:-1] << 8 | low[2:]
        places = np.flatnonzero(known[numbers])
        row = np.searchsorted(bounds, places, "right") - 1
        inside = places + 3 <= bounds[row + 1]
        trigram = np.searchsorted(needed, numbers[places[inside]])
        found.append(np.unique(trigram * (len(texts) + 1) + row[inside] + start))
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    if not len(pairs):
        return {}
    trigram, rows = np.divmod(pairs, len(texts) + 1)
    edges = np.flatnonzero(np.diff(trigram, prepend=-1))
    return {int(needed[trigram[a]]): rows[a:b] for a, b in zip(edges, [*edges[1:], len(rows)], strict=True)}


def search(query: Query, lists: dict[int, np.ndarray], size: int) -> Iterable[int]:
    """Rows of a segment that satisfy a query."""
    if query == EVERY:
        return range(size)
    none = np.zeros(0, np.int64)
    found = none
    for term in query:
        by_length = sorted((lists.get(_number(t), none) for t in term), key=len)
        found = np.union1d(found, reduce(lambda a, b: np.intersect1d(a, b, assume_unique=True), by_length))
    return found.tolist()


def spans_of(rule: re.Pattern, group: int, least: int, text: str) -> list[tuple[int, int]]:
    return [m.span() for m in rule.finditer(text) if m.end(group) - m.start(group) >= least]


def told(spans: Iterable[tuple[int, int, str, int]]) -> str:
    """Spans by start, then by the order of the rules."""
    return ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in sorted(spans))


# ---- plans ------------------------------------------------------------------------------------------


def _scanner(rules: tuple[Rule, ...], kind_of_id: str, base: int):
    queries = [trigram_query(r.pattern) for r in rules]
    needed = _needed(queries)
    patterns = [re.compile(r.pattern, re.ASCII) for r in rules]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            lists = index(texts, needed)
            found: dict[int, list[tuple[int, int, str, int]]] = {}
            for k, (rule, pattern, query) in enumerate(zip(rules, patterns, queries, strict=True)):
                for row in search(query, lists, len(texts)):
                    text = texts[row].as_py()
                    if text:
                        hits = spans_of(pattern, rule.group, rule.least, text)
                        if hits:
                            found.setdefault(row, []).extend((a, k, rule.kind, b) for a, b in hits)
            spans = [found.get(row, []) for row in range(len(texts))]
            first = [[s for s in x if s[1] < base] for x in spans]
            counts = {f"n_{r.kind}": pa.array([sum(s[1] == k for s in x) for x in spans], pa.int64()) for k, r in enumerate(rules[:base])}
            columns = {
                "id": batch.column("id"),
                **counts,
                "base_sha256": pa.array([hashlib.sha256(told(x).encode()).hexdigest() for x in first], pa.string()),
                "spans": pa.array([told(x) for x in spans], pa.string()),
            }
            yield pa.RecordBatch.from_pydict(columns)

    schema = f"id {kind_of_id}, " + "".join(f"n_{r.kind} long, " for r in rules[:base]) + "base_sha256 string, spans string"
    return run, schema


def scan(
    df: DataFrame, base: tuple[Rule, ...] = BASE, more: tuple[Rule, ...] = MORE, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per row of ``df``: id, matches of every base rule (``n_<kind>``), ``base_sha256`` of the base rules' spans, and
    ``spans``, those of all rules, as ``kind:start:end`` in code points by start, then in the order of the rules.

    NULL and empty texts have no spans; a text of any length is read whole, by each rule whose query it satisfies; rows are
    told apart by nothing but themselves, so repeated and NULL ids stay; other columns are ignored, whatever their names; an
    empty table gives an empty result.
    """
    rows = df.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    run, schema = _scanner((*base, *more), rows.schema["id"].dataType.simpleString(), len(base))
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_column)


def postings(df: DataFrame, rules: tuple[Rule, ...] = RULES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The index as a table: a row per segment with ``ids`` (all of it) and ``lists``, a map from the number of a trigram
    that ``rules`` ask for to the ids of the rows that hold it. Ids are not NULL."""
    needed = _needed(trigram_query(r.pattern) for r in rules)
    rows = df.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text")).where("id IS NOT NULL")
    schema = pa.schema([("ids", pa.list_(pa.int64())), ("lists", pa.map_(pa.int32(), pa.list_(pa.int64())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            lists = [(t, ids[r].tolist()) for t, r in index(batch.column("text"), needed).items()]
            yield pa.RecordBatch.from_pylist([{"ids": ids.tolist(), "lists": lists}], schema)

    return rows.mapInArrow(run, "ids array<long>, lists map<int, array<long>>")


def _matching(query: Query) -> Column:
    """Ids of a segment that satisfy a query, by array functions over its posting lists."""
    if query == EVERY:
        return F.col("ids")
    of = lambda t: F.coalesce(F.col("lists")[F.lit(_number(t))], F.array().cast("array<long>"))
    terms = [reduce(F.array_intersect, [of(t) for t in sorted(term)]) for term in sorted(query, key=sorted)]
    return reduce(F.array_union, terms)


def candidates(table: DataFrame, rules: tuple[Rule, ...], id_column: str = "doc_id") -> DataFrame:
    """(``kind``, id) of the rows that the index does not rule out; ``rules`` ask for no trigram that ``postings`` was not told of."""
    kinds = [F.struct(F.lit(r.kind).alias("kind"), _matching(trigram_query(r.pattern)).alias("ids")) for r in rules]
    return table.select(F.inline(F.array(*kinds))).select("kind", F.explode("ids").alias(id_column))


# ---- the same rows in SQL ----------------------------------------------------------------------------


def oracle() -> str:
    """DuckDB SQL for ``scan`` of ``documents``: starts come from the lengths of the matches and of the texts between them."""
    whole = ", ".join(f"regexp_extract_all(coalesce(text, ''), $p${r.pattern}$p$) AS m{k}" for k, r in enumerate(RULES))
    part = ", ".join(f"regexp_extract_all(coalesce(text, ''), $p${r.pattern}$p$, {r.group}) AS g{k}" for k, r in enumerate(RULES))
    between = ", ".join(f"string_split_regex(coalesce(text, ''), $p${r.pattern}$p$) AS b{k}" for k, r in enumerate(RULES))
    spans = " || ".join(
        f"list_filter([{{'at': coalesce(list_sum([length(x) FOR x IN b{k}[1:i]]), 0)::BIGINT + coalesce(list_sum([length(x) FOR x IN m{k}[1:i - 1]]), 0)::BIGINT, "
        f"'k': {k}, 'kind': '{r.kind}', 'n': length(m{k}[i]), 'g': length(g{k}[i]) >= {r.least}}} FOR i IN range(1, len(m{k}) + 1)], lambda x: x.g)"
        for k, r in enumerate(RULES)
    )
    listed = "array_to_string([x.kind || ':' || x.at || ':' || (x.at + x.n) FOR x IN {}], ',')"
    counts = ", ".join(f"len(list_filter(s, lambda x: x.k = {k})) AS n_{r.kind}" for k, r in enumerate(BASE))
    base = listed.format(f"list_filter(s, lambda x: x.k < {len(BASE)})")
    return (
        f"WITH f AS (SELECT doc_id, {whole}, {part}, {between} FROM documents), "
        f"t AS (SELECT doc_id, list_sort({spans}) AS s FROM f) "
        f"SELECT doc_id, {counts}, sha256({base}) AS base_sha256, {listed.format('s')} AS spans FROM t"
    )
