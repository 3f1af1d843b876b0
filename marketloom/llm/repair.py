"""Repair of conversation structure by cheapest edits over an automaton of shared suffixes.

A conversation is its signature: one letter per row, for its role and its first fault. Distinct signatures are
range-sorted by their reversal, so those that end alike are neighbours; a task keeps the suffixes of the
current one as a path of nodes and takes over every node that the next signature shares. A node holds for each state of
the grammar the cost to go and its best edit with a link to the rest, so it is computed once for all conversations
that end in it. Ties are decided by the edit's letter alone, because each letter leaves one way to go on:
the least letters in order are the least audit.

The grammar is ``(s?(ua)+)?`` over the initials of the roles. Edits: Keep 0; Rerole to what the grammar
wants, 2; Delete 3, required for blank and duplicate rows; Insert an empty ``user`` or ``assistant`` row, 2; a
truncated row that stays costs 1 more.

No conversation is a group of its own in one task before its audit is known: signatures are put together from the
pieces of ranges sorted by conversation and turn. A signature has a letter per row, as its audit does. Texts come last,
streamed in order through SHA-256, which is sequential by nature: one conversation's texts pass
one task, in bounded memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain, groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.operators.numbering import join_null_safe
from marketloom.session import written

SPACE = " \t\n\x0b\x0c\r"
#: Letter of a signature: faults in this order, in each the roles ``s``, ``u``, ``a`` and any other.
OK, BLANK, DUPLICATE, TRUNCATED = range(4)
LETTERS = "ABCDEFGHIJKLMNOP"
INITIALS = "sua-"
LEGAL = {"su", "ua", "au"}
#: States: at the start, after the system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
WANTED = (1, 1, 2, 1)
NEXT = (USER, USER, ASSISTANT, USER)
NAMES = {1: "user", 2: "assistant"}
DELETE, INSERT, REROLE, CUT = 3, 2, 2, 1

#: One node: (cost, letter, state after it, row used up) for each state; a state that may end has the letter "".
Node = tuple[tuple[int, str, int, bool], ...]


def _with_inserts(best: list[tuple[int, str, int, bool]]) -> Node:
    for _ in best:
        for q in range(4):
            best[q] = min(best[q], (INSERT + best[NEXT[q]][0], "I", NEXT[q], False))
    return tuple(best)


#: After the last row the start and an assistant turn may end.
END: Node = _with_inserts([(0, "", q, False) if q in (START, ASSISTANT) else (99, "Z", q, False) for q in range(4)])


def prepended(letter: str, rest: Node) -> Node:
    """The node of a suffix that has one row more in front."""
    fault, role = divmod(LETTERS.index(letter), 4)
    best = []
    for q in range(4):
        options = [(DELETE + rest[q][0], "D", q, True)]
        if fault in (OK, TRUNCATED):
            stays = CUT if fault == TRUNCATED else 0
            options.append((REROLE + stays + rest[NEXT[q]][0], "R", NEXT[q], True))
            if role == WANTED[q]:
                options.append((stays + rest[NEXT[q]][0], "K", NEXT[q], True))
            if role == 0 and q == START:
                options.append((stays + rest[SYSTEM][0], "K", SYSTEM, True))
        best.append(min(options))
    return _with_inserts(best)


def audit_of(path: list[Node]) -> str:
    """The edits from the start, along nodes from the whole signature (last) to its end (first)."""
    letters, state, place = [], START, len(path) - 1
    while True:
        _, letter, state, used = path[place][state]
        if not letter:
            return "".join(letters)
        letters.append(letter)
        place -= used


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Signatures sorted by their reversal -> faults, cost and audit."""
    path, before = [END], ""
    for batch in batches:
        out = []
        for signature in batch.column("signature").to_pylist():
            turned = signature[::-1]
            shared = next((k for k, (a, b) in enumerate(zip(before, turned, strict=False)) if a != b), min(len(before), len(turned)))
            del path[shared + 1 :]
            for letter in turned[shared:]:
                path.append(prepended(letter, path[-1]))
            before = turned
            marks = [divmod(LETTERS.index(x), 4) for x in signature]
            roles = "".join(INITIALS[r] for _, r in marks)
            faults = [f for f, _ in marks]
            out.append(
                {
                    "signature": signature,
                    "blank": faults.count(BLANK),
                    "duplicate": faults.count(DUPLICATE),
                    "truncated": faults.count(TRUNCATED),
                    "illegal": sum(a + b not in LEGAL for a, b in zip(roles, roles[1:], strict=False)),
                    "cost": path[-1][START][0],
                    "audit": audit_of(path),
                }
            )
        if out:
            yield pa.RecordBatch.from_pylist(out, SOLVED)


COUNTS = ("blank", "duplicate", "truncated", "illegal", "cost")
SOLVED = pa.schema([("signature", pa.string()), *((c, pa.int64()) for c in COUNTS), ("audit", pa.string())])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows -> one piece for each conversation of the range: letters, first, last and distinct turns."""
    batches = iter(batches)
    head = next(batches, None)
    if head is None:
        return
    schema = pa.schema(
        [("conv", head.schema.field("conv").type), ("part", pa.int32()), ("letters", pa.string())]
        + [(c, pa.int64()) for c in ("first_turn", "last_turn", "turns")]
    )
    stream = (row for batch in chain([head], batches) for row in batch.to_pylist())
    out = []
    for conv, rows in groupby(stream, itemgetter("conv")):
        letters, turns, first, last, part = [], 0, None, None, 0
        for row in rows:
            letters.append(row["letters"])
            part = row["part"]
            if row["turn"] is not None and row["turn"] != last:
                first, last, turns = row["turn"] if first is None else first, row["turn"], turns + 1
        out.append({"conv": conv, "part": part, "letters": "".join(letters), "first_turn": first, "last_turn": last, "turns": turns})
        if len(out) >= 4096:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def _edited(rows: Iterator[dict]) -> Iterator[tuple[dict, Iterator[tuple[str, str, str]]]]:
    """(row of the audit, its repaired (edit, role, text)) of every conversation; the audit stands before its rows."""

    def lines(audit: str, told: Iterator[dict]) -> Iterator[tuple[str, str, str]]:
        copies = ((r["role"], r["text"]) for r in told for _ in range(r["copies"]))
        state = START
        for edit in audit:
            role, text = (NAMES[WANTED[state]], "") if edit == "I" else next(copies)
            if edit == "D":
                continue
            if edit == "R":
                role = NAMES[WANTED[state]]
            state = SYSTEM if edit == "K" and state == START and role[:1] == "s" else NEXT[state]
            yield edit, role, text

    for _, group in groupby(rows, itemgetter("conv")):
        head = next(group)
        yield head, lines(head["audit"], group)


def _first(batches: Iterator[pa.RecordBatch]) -> tuple[pa.DataType | None, Iterator[dict]]:
    batches = iter(batches)
    head = next(batches, None)
    if head is None:
        return None, iter(())
    return head.schema.field("conv").type, (row for b in chain([head], batches) for row in b.to_pylist())


RESULT = ("gaps", *COUNTS)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind, rows = _first(batches)
    schema = kind and pa.schema([("conv", kind), *((c, pa.int64()) for c in RESULT), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    out = []
    for head, lines in _edited(rows):
        digest = hashlib.sha256()
        for k, (_, role, text) in enumerate(lines):
            digest.update(f"{chr(10) if k else ''}{role}:{text}".encode())
        out.append({c: head[c] for c in ("conv", *RESULT, "audit")} | {"repaired_sha256": digest.hexdigest()})
        if len(out) >= 4096:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind, rows = _first(batches)
    schema = kind and pa.schema([("conv", kind), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
    out, held = [], 0
    for head, lines in _edited(rows):
        for place, (edit, role, text) in enumerate(lines):
            out.append({"conv": head["conv"], "place": place, "edit": edit, "role": role, "text": text})
            held += len(text)
            if len(out) >= 4096 or held >= 1 << 22:
                yield pa.RecordBatch.from_pylist(out, schema)
                out, held = [], 0
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


# ---- plans ------------------------------------------------------------------------------------------


def _rows(df: DataFrame, conversation_column: str, turn_column: str, role_column: str, text_column: str) -> DataFrame:
    """conv, turn, role, text with NULL roles and texts as one space, and ``copies`` (rows of the kind; 0: dropped)."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return df.select(
        F.col(conversation_column).alias("conv"),
        F.col(turn_column).cast("long").alias("turn"),
        said(role_column).alias("role"),
        said(text_column).alias("text"),
        F.lit(1).alias("copies"),
    )


def damaged(rows: DataFrame) -> DataFrame:
    """Rows as ``_rows`` gives them, damaged by the CRC-32 of conversation and turn (a NULL number is written as one space)."""
    written_as = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(written_as("conv"), F.lit(":"), written_as("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select(
        "conv",
        "turn",
        F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        (F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1) * F.col("copies")).alias("copies"),
    )


def _same() -> Column:
    """Rows with equal roles and texts, and no others, have this in common."""
    return F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)


def _letter(fault: Column | int) -> Column:
    initial = F.col("initial")
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    place = (fault if isinstance(fault, Column) else F.lit(fault)) * 4 + role
    return F.substring(F.lit(LETTERS), place + 1, 1)


def signatures(rows: DataFrame) -> DataFrame:
    """``conv``, ``signature`` and ``gaps`` of every conversation of ``rows``, those without rows left included."""
    there = F.col("copies") > 0
    shown = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = F.when(shown == "", BLANK).when(~F.substring(shown, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(OK)
    light = rows.select(
        "conv",
        F.when(there, F.col("turn")).alias("turn"),
        F.when(there, _same()).alias("same"),
        F.substring("role", 1, 1).alias("initial"),
        fault.alias("fault"),
        "copies",
    )
    kinds = light.groupBy("conv", "turn", "same").agg(
        F.min("initial").alias("initial"), F.min("fault").alias("fault"), F.sum("copies").alias("copies")
    )
    kinds = written(kinds, "turns")
    seen = kinds.groupBy("conv", "same").agg(F.min(F.struct("turn"))["turn"].alias("seen"))  # a NULL turn is the least
    again = F.when(F.col("fault") == BLANK, BLANK).otherwise(DUPLICATE)
    first = F.when(F.col("turn").eqNullSafe(F.col("seen")), F.col("fault")).otherwise(again)
    marked = join_null_safe(kinds, seen, ["conv", "same"]).select(
        "conv",
        "turn",
        "same",
        F.when(F.col("copies") > 0, F.concat(_letter(first), F.repeat(_letter(again), (F.col("copies") - 1).cast("int"))))
        .otherwise("")
        .alias("letters"),
    )
    order = [F.asc_nulls_first(c) for c in ("conv", "turn", "same")]
    ranged = marked.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    kind = rows.schema["conv"].dataType.simpleString()
    pieces = ranged.select("conv", "turn", "letters", "part").mapInArrow(
        _pieces, f"conv {kind}, part int, letters string, first_turn long, last_turn long, turns long"
    )
    # A conversation has one piece for each range that it reaches into.
    whole = pieces.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("part", "letters", "first_turn", "last_turn", "turns"))).alias("p"))
    meet = F.transform(  # a turn on both sides of a border is counted on both
        F.col("p"),
        lambda x, k: F.when(
            (k > 0) & (F.array_max(F.transform(F.slice("p", 1, F.greatest(k, F.lit(1))), lambda y: y["last_turn"])) == x["first_turn"]), 1
        ).otherwise(0),
    )
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    distinct = total(F.col("p.turns")) - total(meet)
    gaps = F.array_max("p.last_turn") - F.array_min("p.first_turn") + 1 - distinct
    return whole.select("conv", F.array_join("p.letters", "").alias("signature"), F.coalesce(gaps, F.lit(0)).alias("gaps"))


def solved(found: DataFrame) -> DataFrame:
    """Counts, ``cost`` and ``audit`` of every distinct signature of ``found``."""
    turned = F.reverse("signature")
    apart = found.select("signature").distinct().repartitionByRange(F.substring(turned, 1, 64)).sortWithinPartitions(turned)
    return apart.mapInArrow(_solve, "signature string, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string")


def _audited(rows: DataFrame) -> DataFrame:
    """Every conversation's audit, followed by its rows in order."""
    found = written(signatures(rows), "signatures")
    audits = found.join(written(solved(found), "audits"), "signature").drop("signature")
    told = rows.where("copies > 0").withColumn("same", _same())
    both = audits.withColumn("follows", F.lit(False)).unionByName(told.withColumn("follows", F.lit(True)), allowMissingColumns=True)
    order = ["conv", "follows", F.asc_nulls_first("turn"), "same"]
    return both.repartition("conv").sortWithinPartitions(*order).drop("same", "turn", "follows")


def audits(rows: DataFrame) -> DataFrame:
    """One row per conversation: ``gaps``, counts of faults, ``illegal`` neighbours, ``cost``, ``audit`` and the SHA-256
    of the repaired conversation.

    ``rows`` are as ``_rows`` or ``damaged`` gives them. Rows come by turn, NULL turns first, and in a turn by the SHA-256
    of role and text; a row that repeats another one is a duplicate. Roles count by their initial; an empty or unknown role
    is neither kept nor legal. Rows with a NULL conversation are one conversation.
    """
    kind = rows.schema["conv"].dataType.simpleString()
    result = f"conv {kind}, " + ", ".join(f"{c} long" for c in RESULT) + ", audit string, repaired_sha256 string"
    return _audited(rows).mapInArrow(_digests, result)


def repaired(
    df: DataFrame, conversation_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text"
) -> DataFrame:
    """The repaired rows: conversation, ``place`` from 0, ``edit`` (K, R or I), ``role``, ``text``; rows as in ``audits``."""
    rows = _rows(df, conversation_column, turn_column, role_column, text_column)
    kind = rows.schema["conv"].dataType.simpleString()
    return (
        _audited(rows)
        .mapInArrow(_lines, f"conv {kind}, place long, edit string, role string, text string")
        .withColumnRenamed("conv", conversation_column)
    )


def damage_check(
    df: DataFrame, conversation_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text"
) -> DataFrame:
    """``audits`` of every conversation of ``df`` after the damage of ``damaged``.

    NULL roles and texts are one space, hence blank or unknown; texts of any length are read whole, one at a time;
    other columns are ignored, whatever their names; an empty table gives an empty result. A conversation that loses all
    rows has zeros, an empty audit and the hash of the empty string.
    """
    rows = damaged(_rows(df, conversation_column, turn_column, role_column, text_column))
    return audits(rows).withColumnRenamed("conv", conversation_column)
