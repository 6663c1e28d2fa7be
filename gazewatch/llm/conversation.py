"""Repair of conversation structure by a run-length dynamic programme.

A conversation is well formed if its roles read: an optional system turn, then user and
assistant in turn, ending with the assistant; or if it is empty. Every row has a symbol: the
initial of its role and its fault. Equal neighbouring symbols are one run. What a row does to
the cost of all that follows is a small matrix over the states of the grammar, in the algebra
of minimum and sum; a run does what a power of its symbol's matrix does, put together from
remembered squares. Costs go from the end of a conversation to its start; the choices are then
unrolled from its start, the smallest letter among the cheapest ones first.

A conversation is cut into tiles of turns. Matrices of tiles multiply like those of rows, so
tiles are summed up, and unrolled, by any number of tasks; only a short row for each tile is
passed along a conversation. Texts are exchanged twice: by tile, and by conversation where
the repaired rows are read in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import groupby
from re import findall

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazewatch.llm.common import BLANKS, checkpoint_folder

# What edits cost, and the edits' letters in the order in which ties are settled.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
LEGAL_PAIRS = ("su", "ua", "au")
#: Turns of a conversation that one task takes together.
TILE_TURNS = 256
OUT_BYTES = 1_000_000

START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
#: The role that a new or changed row must have in each state is the one that leads to NEXT.
NEXT = (USER, USER, ASSISTANT, USER)
KEEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: What it costs to end in each state: roles that are missing are inserted.
END = (0, 2 * INSERT, INSERT, 0)
NEVER = 1 << 50
GONE = "x"

Vector = tuple[int, ...]
Matrix = tuple[Vector, ...]
IDENTITY: Matrix = tuple(tuple(0 if s == t else NEVER for t in STATES) for s in STATES)


def symbol(initial: str, fault: str) -> str:
    """One letter for a row: `x` if it must go, else its role's initial (`o` for others),
    as a capital if its text is truncated."""
    if fault in ("blank", "duplicate"):
        return GONE
    letter = initial if initial in ("s", "u", "a") else "o"
    return letter.upper() if fault == "truncated" else letter


def choices(state: int, row: str) -> Iterator[tuple[str, int, int]]:
    """(letter, cost, next state) of what can be done with a row, by letter."""
    yield "D", DELETE, state
    if row != GONE:
        extra = TRUNCATED if row.isupper() else 0
        if (kept := KEEP.get((state, row.lower()))) is not None:
            yield "K", extra, kept
        yield "R", REROLE + extra, NEXT[state]


def times(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(min(a[s][k] + b[k][t] for k in STATES), NEVER) for t in STATES) for s in STATES)


def applied(a: Matrix, v: Vector) -> Vector:
    return tuple(min(a[s][k] + v[k] for k in STATES) for s in STATES)


@lru_cache
def power_of_two(row: str, k: int) -> Matrix:
    """What 2**k rows of one symbol do."""
    if k:
        half = power_of_two(row, k - 1)
        return times(half, half)
    inserts = [list(r) for r in IDENTITY]
    for s in STATES:  # as many inserts as lead to another state
        at, cost = NEXT[s], INSERT
        while cost < inserts[s][at]:
            inserts[s][at] = cost
            at, cost = NEXT[at], cost + INSERT
    step = [[NEVER] * 4 for _ in STATES]
    for s in STATES:
        for _, cost, t in choices(s, row):
            step[s][t] = min(step[s][t], cost)
    return times(tuple(map(tuple, inserts)), tuple(map(tuple, step)))


Runs = tuple[tuple[str, int], ...]


def runs_of(symbols: Iterable[str]) -> Runs:
    return tuple((s, sum(1 for _ in g)) for s, g in groupby(symbols))


def written(runs: Runs) -> str:
    return "".join(f"{s}{n}" for s, n in runs)


def read(text: str) -> Runs:
    return tuple((s, int(n)) for s, n in findall(r"([a-zA-Z])(\d+)", text))


def run_powers(row: str, n: int) -> Iterator[Matrix]:
    """The squares that multiply to the n-th power of a symbol's matrix."""
    return (power_of_two(row, k) for k in range(n.bit_length()) if n >> k & 1)


@lru_cache(maxsize=20_000)
def matrix(runs: str) -> Matrix:
    """What all rows of a tile do, from the last run to the first."""
    whole = IDENTITY
    for row, n in reversed(read(runs)):
        for power in run_powers(row, n):
            whole = times(power, whole)
    return whole


@lru_cache(maxsize=20_000)
def unrolled(runs: str, after: Vector, entries: tuple[int, ...]) -> tuple[tuple[int, str], ...]:
    """(state at the end, letters) of the first of the cheapest ways through a tile, for each
    state at its start; `after` is what each state at its end costs from there on."""
    rows = "".join(row * n for row, n in read(runs))
    costs = [after]
    for row in reversed(rows):
        costs.append(applied(power_of_two(row, 0), costs[-1]))
    costs.reverse()
    found = []
    for state in entries:
        letters = []
        for i, row in enumerate(rows):
            while True:
                offers = [(a, c + costs[i + 1][t], t) for a, c, t in choices(state, row)]
                offers.append(("I", INSERT + costs[i][NEXT[state]], NEXT[state]))
                letter, _, state = min(o for o in offers if o[1] == costs[i][state])
                letters.append(letter)
                if letter != "I":
                    break
        found.append((state, "".join(letters)))
    return tuple(found)


# --- rows --------------------------------------------------------------------------------


def damaged(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows with faults put in by a checksum of `conv_id:turn`; nulls are one space.

    Of 20 checksums, 0 drops the row, 1 empties its text, 2 takes out its full stops, question
    and exclamation marks, 3 repeats it, 4 makes its role user.
    """
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(told(conv_id), F.lit(":"), told(turn))) % 20
    text_left = (
        F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace(told(text), "[.!?]", "")).otherwise(told(text))
    )
    return (
        rows.select(conv_id, turn, role, text, kind.alias("_kind"))
        .where("_kind <> 0")
        .select(
            F.col(conv_id).alias("conv_id"),
            F.col(turn).cast("long").alias("turn"),
            F.when(F.col("_kind") == 4, "user").otherwise(told(role)).alias("role"),
            text_left.alias("text"),
            F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
        )
        .drop("_copy")
    )


def _tiled(rows: DataFrame, folder: str) -> DataFrame:
    """Rows with conversation, tile and fault marks, dealt by conversation and tile.

    A row repeats an earlier one if its role and text stand in an earlier tile, which is found
    here on digests alone, or earlier in its own tile, which is found there.
    """
    turn, text = F.col("turn"), F.coalesce("text", F.lit(" "))
    trimmed = F.rtrim(text, F.lit(BLANKS))
    role = F.coalesce("role", F.lit(" "))
    lowest = F.lit(-(1 << 62)).cast("long")
    marked = rows.select(
        F.struct(F.col("conv_id")).alias("conv"),
        F.coalesce(F.floor(turn / TILE_TURNS), lowest).alias("tile"),
        "turn",
        role.alias("role"),
        text.alias("text"),
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("digest"),
        (trimmed == "").alias("blank"),
        (~F.substring(trimmed, -1, 1).isin(".", "!", "?")).alias("cut"),
    )
    spread = marked.where("NOT blank").groupBy("conv", "digest").agg(F.min("tile").alias("first"), F.max("tile").alias("last"))
    spread = spread.where("last > first").drop("last")
    spread.write.parquet(f"{folder}/spread")
    spread = rows.sparkSession.read.schema(spread.schema).parquet(f"{folder}/spread")
    seen = F.coalesce(F.col("tile") > F.col("first"), F.lit(False)).alias("seen")
    dealt = marked.join(spread, ["conv", "digest"], "left")
    return dealt.select(*marked.columns, seen).repartition("conv", "tile")


#: Ascending, nulls first.
IN_ORDER = ("conv", "tile", "turn", "role", "text")


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)


def _batches(rows: Iterable[tuple], schema: pa.Schema, size: Callable[[tuple], int]) -> Iterator[pa.RecordBatch]:
    """Rows in batches of bounded bytes."""
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += size(row)
        if n > OUT_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _mapped(df: DataFrame, work, schema: str, size=lambda row: 400) -> DataFrame:
    """mapInArrow over rows in order; `work` makes rows from an iterator of rows."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    return df.mapInArrow(lambda batches: _batches(work(_rows(batches)), arrow, size), schema)


def _summed(rows: Iterator[tuple]) -> Iterator[tuple]:
    """A row for each tile: its runs, counts of faults, turns, and its outermost initials."""
    for (conv, tile), group in groupby(rows, key=lambda r: (r[0]["conv_id"], r[1])):
        seen: set = set()
        counts = {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}
        turns, low, high, illegal, first, last = 0, None, None, 0, None, None

        def symbols(group=group, seen=seen, counts=counts):
            nonlocal turns, low, high, illegal, first, last
            for _, _, turn, role, _, digest, blank, cut, before in group:
                fault = "blank" if blank else "duplicate" if before or digest in seen else "truncated" if cut else ""
                seen.add(digest)
                counts[fault] += 1
                if turn is not None and turn != high:
                    turns, low, high = turns + 1, turn if low is None else low, turn
                if first is None:
                    first = role[:1]
                else:
                    illegal += last + role[:1] not in LEGAL_PAIRS
                last = role[:1]
                yield symbol(last, fault)

        runs = written(runs_of(symbols()))
        yield {"conv_id": conv}, tile, runs, counts["blank"], counts["duplicate"], counts["truncated"], illegal, turns, low, high, first, last


def _costed(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Tiles from the last to the first of each conversation, with what each state at their end
    costs. The first tile tells the numbers of the whole conversation."""
    for conv, group in groupby(rows, key=lambda r: r[0]["conv_id"]):
        after, total, sums, turns, low, high, follows, held = END, 0, [0, 0, 0, 0], 0, None, None, None, None
        for _, tile, runs, *counts, n_turns, lowest, highest, first, last in group:
            if held:
                yield *held, False, None
            counts[3] += follows is not None and last + follows not in LEGAL_PAIRS
            sums = [a + b for a, b in zip(sums, counts, strict=True)]
            turns, follows = turns + n_turns, first
            low = lowest if lowest is not None else low
            high = highest if high is None else high
            held = {"conv_id": conv}, tile, runs, list(after)
            after = applied(matrix(runs), after)
            total, after = total + min(after), tuple(c - min(after) for c in after)
        gaps = 0 if high is None else high - low + 1 - turns
        names = ("blank", "duplicate", "truncated", "illegal")
        yield *held, True, dict(zip(names, sums, strict=True)) | {"gaps": gaps, "cost": total + after[START]}


def _chosen(rows: Iterator[tuple]) -> Iterator[tuple]:
    """The ways through each tile, from all states it may be entered in."""
    for conv, tile, runs, after, is_first, totals in rows:
        ways = unrolled(runs, tuple(after), (START,) if is_first else tuple(STATES))
        yield conv, tile, [{"state": s, "letters": a} for s, a in ways], totals


def _chained(rows: Iterator[tuple]) -> Iterator[tuple]:
    """The way through each tile from the state in which the tile before it ends."""
    for _, group in groupby(rows, key=lambda r: r[0]["conv_id"]):
        state, held = START, None
        for conv, tile, ways, totals in group:
            if held:
                yield held
            way = ways[state] if len(ways) > 1 else ways[0]
            held, state = (conv, tile, state, way["letters"], totals), way["state"]
        missing = "I" * (END[state] // INSERT)
        yield *held[:3], held[3] + missing, held[4]


def _edited(rows: Iterator[tuple]) -> Iterator[tuple]:
    """The edits of each tile in order, with the row that each leaves."""
    for (_, tile), group in groupby(rows, key=lambda r: (r[0]["conv_id"], r[1])):
        at, nth, told = 0, 0, False

        def inserted(conv, letters, state, until):
            nonlocal at, nth
            while at < until and letters[at] == "I":
                state, at, nth = NEXT[state], at + 1, nth + 1
                yield state, (conv, tile, nth, "I", ROLES[state], "", None)

        for conv, _, _, role, text, _, _, _, _, entered, letters, totals in group:
            state = state if told else entered
            for state, row in inserted(conv, letters, state, len(letters)):  # noqa: B007, B020
                yield row
            letter, at, nth = letters[at], at + 1, nth + 1
            if letter == "K":
                state = KEEP[state, role[:1]]
            elif letter == "R":
                state = NEXT[state]
                role = ROLES[state]
            yield conv, tile, nth, letter, role, "" if letter == "D" else text, None if told else totals
            told = True
        for _, row in inserted(conv, letters, state, len(letters)):
            yield row


TOTALS = "struct<blank: bigint, duplicate: bigint, truncated: bigint, illegal: bigint, gaps: bigint, cost: bigint>"


def edits(rows: DataFrame) -> DataFrame:
    """conv, tile, nth, edit, role, text: every edit of every conversation that has rows.

    `rows` has conv_id, turn, role, text. They are taken by turn, nulls first, equal turns by
    role and text. A deleted row keeps its role and has an empty text. `conv` is a struct of
    conv_id, in which nulls are equal; order by tile and nth. The first row of a conversation
    also has its `totals`: faults by kind, illegal neighbours, gaps in the turns, cost.

    Null roles and texts are one space. Null conv_ids are one conversation. Repeated rows
    repeat their role and text. Rows of one turn stay in one task. An empty table gives none.
    """
    id_type = rows.schema["conv_id"].dataType.simpleString()
    key = f"conv struct<conv_id: {id_type}>, tile bigint"
    tiled = _tiled(rows, _folder(rows))
    pieces = _mapped(
        tiled.sortWithinPartitions(*IN_ORDER),
        _summed,
        f"{key}, runs string, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
        "turns bigint, low bigint, high bigint, first string, last string",
    )
    costed = _mapped(
        pieces.repartition("conv").sortWithinPartitions("conv", F.desc("tile")),
        _costed,
        f"{key}, runs string, after array<bigint>, is_first boolean, totals {TOTALS}",
    )
    ways = _mapped(
        costed.repartition("conv", "tile"), _chosen, f"{key}, ways array<struct<state: int, letters: string>>, totals {TOTALS}"
    )
    chained = _mapped(
        ways.repartition("conv").sortWithinPartitions("conv", "tile"),
        _chained,
        f"{key}, entered int, letters string, totals {TOTALS}",
    )
    chained = chained.select(*[F.col(c).alias(f"_{c}" if c in ("conv", "tile") else c) for c in chained.columns])
    joined = tiled.join(chained, (F.col("conv") == F.col("_conv")) & (F.col("tile") == F.col("_tile"))).drop("_conv", "_tile")
    return _mapped(
        joined.sortWithinPartitions(*IN_ORDER),
        _edited,
        f"{key}, nth bigint, edit string, role string, text string, totals {TOTALS}",
        lambda row: 200 + len(row[5]),
    )


def _folder(rows: DataFrame) -> str:
    import uuid

    return f"{checkpoint_folder(rows.sparkSession)}/repair-{uuid.uuid4()}"


def _reported(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Totals, letters and digest of each conversation, reading its repaired rows in order."""
    for conv, group in groupby(rows, key=lambda r: r[0]["conv_id"]):
        digest, audit, totals, some = hashlib.sha256(), bytearray(), None, False
        for _, _, _, edit, role, text, found in group:
            audit += edit.encode()
            totals = found or totals
            if edit != "D":
                digest.update(("\n" * some + f"{role}:{text}").encode())
                some = True
        yield {"conv_id": conv}, totals, audit.decode(), digest.hexdigest()


def repaired(rows: DataFrame) -> DataFrame:
    """The rows of edits() that stay: conv_id, tile, nth, edit, role, text."""
    return edits(rows).where("edit <> 'D'").select("conv.conv_id", "tile", "nth", "edit", "role", "text")


def report(rows: DataFrame, every: DataFrame) -> DataFrame:
    """One row for each conv_id of `every`, a null one too: gaps, blank, duplicate, truncated,
    illegal, cost, audit (the edits' letters) and repaired_sha256 (of the repaired `role:text`
    lines). A conversation without rows has zeros, no letters and the digest of no text."""
    id_type = rows.schema["conv_id"].dataType.simpleString()
    told = _mapped(
        edits(rows).repartition("conv").sortWithinPartitions("conv", "tile", "nth"),
        _reported,
        f"conv struct<conv_id: {id_type}>, totals {TOTALS}, audit string, repaired_sha256 string",
        lambda row: 400 + len(row[2]),
    )
    ids = every.select(F.struct(F.col("conv_id")).alias("conv")).distinct()
    number: Callable[[str], Column] = lambda c: F.coalesce(F.col(f"totals.{c}"), F.lit(0).cast("long")).alias(c)
    return ids.join(told, "conv", "left").select(
        "conv.conv_id",
        *[number(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
