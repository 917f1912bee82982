"""Operator 11: conversation structure repair by iterative-deepening A*.

A conversation is repaired by the cheapest edits after which its roles are an optional system row and then pairs of user
and assistant.  The search is a depth-first one in the ASCII order of the edits (Delete, Insert, Keep, Rerole) under a
cost bound; the bound begins at a lower estimate, each row's least cost by itself, and grows to the least cost that
exceeded it.  A table of failed states (row, place in the pattern) keeps what each is known to cost at least, so a state
is entered again only with more budget than it failed with.  The first path that is accepted is the cheapest and, among
equals, the first in ASCII order.

Rows are numbered in order over the whole table and searched in blocks of ``BLOCK`` rows, so no task holds a
conversation.  A conversation within a block is searched at once.  One that is cut by block ends is searched in pieces,
from each place in the pattern to each other; inserted rows belong to the row after them, so of two different paths with
as many rows neither is the beginning of the other, and the best of all follows from the pieces' bests, last piece
first.  The digests are then made in one pass over the rows in order, which holds one row at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.llm.common import dropped, shuffle_width, written

#: Rows that one search looks at.
BLOCK = 256
#: Characters that count as blank.
BLANK = " \t\n\x0b\x0c\r"
#: Places in the pattern: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The end of a conversation, as a goal.
CLOSED = 4
#: What a row may become: place -> {initial: next place}.
_NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: The role that an inserted or changed row gets.
_ROLE = ("user", "user", "assistant", "user")
#: Costs: a change of role, a deletion, an insertion, and keeping a truncated row.
REROLE, DELETE, INSERT, TRUNCATED_KEPT = 1, 2, 5, 5
_NO_WAY = 1 << 60
#: Faults as the rows carry them.
NONE, IS_BLANK, IS_DUPLICATE, IS_TRUNCATED, IS_DROPPED = range(5)


def _least(row: tuple[str, int]) -> int:
    """What a row costs at least, whatever the others do."""
    initial, fault = row
    if fault in (IS_BLANK, IS_DUPLICATE, IS_TRUNCATED):
        return DELETE
    return 0 if initial in ("s", "u", "a") else REROLE


class Search:
    """The cheapest edits of one run of rows (initial of the role, fault) to one goal, from any place in the pattern.

    The goal is a place, reached right after the last row, or ``CLOSED``.  ``at_least`` is the table of failed states.
    """

    def __init__(self, rows: list[tuple[str, int]], goal: int):
        self.rows, self.goal = rows, goal
        self.floor = [0] * (len(rows) + 1)
        for i in range(len(rows) - 1, -1, -1):
            self.floor[i] = self.floor[i + 1] + _least(rows[i])
        self.at_least: dict[tuple[int, int], int] = {}

    def _possible(self, place: int) -> bool:
        """Whether any edits lead from ``place`` to the goal: all but the least places can be made by insertions."""
        if self.goal == START:
            return place == START
        if self.goal == SYSTEM:
            return place == SYSTEM or place == START and any(r[0] == "s" and r[1] not in (IS_BLANK, IS_DUPLICATE) for r in self.rows)
        return bool(self.rows) or self.goal in (CLOSED, place)

    def _edits(self, i: int, place: int) -> list[tuple[str, int, int, int]]:
        """(letter, cost, next row, next place) in ASCII order.  Nothing is inserted after the last row but at a close."""
        out = []
        ends = i == len(self.rows)
        if not ends:
            out.append(("D", DELETE, i + 1, place))
        if not ends or self.goal == CLOSED:
            out.append(("I", INSERT, i, _NEXT[place][_ROLE[place][0]]))
        if not ends:
            initial, fault = self.rows[i]
            if fault not in (IS_BLANK, IS_DUPLICATE):
                extra = TRUNCATED_KEPT if fault == IS_TRUNCATED else 0
                if initial in _NEXT[place]:
                    out.append(("K", extra, i + 1, _NEXT[place][initial]))
                out.append(("R", REROLE + extra, i + 1, _NEXT[place][_ROLE[place][0]]))
        return out

    def _accepts(self, i: int, place: int) -> bool:
        return i == len(self.rows) and (place in (START, ASSISTANT) if self.goal == CLOSED else place == self.goal)

    def _estimate(self, i: int, place: int) -> int:
        return self.at_least.get((i, place), self.floor[i])

    def cheapest(self, place: int) -> tuple[int, str] | None:
        """(cost, edits) of the cheapest way from ``place`` at the first row, or None where there is none."""
        if not self._possible(place):
            return None
        while True:
            bound = self._estimate(0, place)
            found = self._within(place, bound)
            if found is not None:
                return bound, found

    def _within(self, place: int, bound: int) -> str | None:
        """The first accepting path within ``bound``; without one, the failed states' least costs are raised."""
        if self._accepts(0, place):
            return ""
        # a frame: row, place, budget, its edits, the next one to try, the least cost seen below it
        stack = [[0, place, bound, self._edits(0, place), 0, _NO_WAY]]
        path: list[str] = []
        while stack:
            frame = stack[-1]
            i, at, budget, edits, k, least = frame
            if k == len(edits):
                stack.pop()
                self.at_least[i, at] = max(least, self._estimate(i, at))
                if stack:
                    path.pop()
                    above = stack[-1]
                    above[5] = min(above[5], above[3][above[4] - 1][1] + self.at_least[i, at])
                continue
            frame[4] += 1
            letter, cost, row, then = edits[k]
            needed = cost + self._estimate(row, then)
            if needed > budget:
                frame[5] = min(least, needed)
                continue
            path.append(letter)
            if self._accepts(row, then):
                return "".join(path)
            stack.append([row, then, budget - cost, self._edits(row, then), 0, _NO_WAY])
        return None


def _by_row(edits: str, faults: list[int]) -> str:
    """Edits dealt to the rows they belong to, comma-joined; dropped rows have none, a close's insertions go last."""
    out, part, letters = [], "", iter(edits)
    for fault in faults:
        part = ""
        if fault != IS_DROPPED:
            for x in letters:
                part += x
                if x != "I":
                    break
        out.append(part)
    return ",".join(out) + ";" + "".join(letters)


def _options(rows: list[tuple[str, int]], first: bool | None, last: bool | None) -> list[tuple[int, int, int, str]]:
    """(place before, goal, cost, edits by row) of a piece: from the start only where it is ``first``, to the close only
    where it is ``last``; None: it may be or not."""
    faults = [f for _, f in rows]
    kept = [r for r in rows if r[1] != IS_DROPPED]
    out = []
    for goal in [CLOSED] if last else [*range(4), CLOSED]:
        search = Search(kept, goal)
        for place in [START] if first else range(4):
            found = search.cheapest(place)
            if found is not None:
                out.append((place, goal, found[0], _by_row(found[1], faults)))
    return out


def _searched(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """Rows (n, c, initial, fault) in order of n -> a row for each piece: (c, n, options)."""
    names = ["c", "n", "place", "goal", "cost", "edits"]
    lists = pa.list_(pa.int64())

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(column.to_pylist() for column in batch.columns))

    made = []
    for _, whole in groupby(rows(), lambda r: r[0] // block):
        pieces = [list(piece) for _, piece in groupby(whole, lambda r: r[1])]
        for i, piece in enumerate(pieces):
            # what lies inside its block is a whole conversation; the ends may go on in the next block
            options = _options([r[2:] for r in piece], True if i else None, True if i < len(pieces) - 1 else None)
            made.append((piece[0][1], piece[0][0], *map(list, zip(*options))))
        if len(made) >= 1000:
            yield _batch(made, names, lists)
            made = []
    yield _batch(made, names, lists)


def _batch(made: list[tuple], names: list[str], lists: pa.DataType) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), lists, lists, lists, pa.list_(pa.string())]
    columns = list(zip(*made)) or [[] for _ in names]
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces, each conversation's last first -> (c, n, the best edits from each place before the piece).

    ``after`` is what the pieces after this one cost from each place.  Of goals that cost the same, the least string of
    edits is the best: no string of a piece is the beginning of another one.
    """
    now, after = None, {}
    for batch in batches:
        made = []
        for c, n, *lists in zip(*(column.to_pylist() for column in batch.columns)):
            if c != now:
                now, after = c, {CLOSED: 0}  # the last piece: it must close
            best: dict[int, tuple[int, str, str]] = {}
            for place, goal, cost, edits in zip(*lists):
                if goal in after:
                    offer = (cost + after[goal], edits.replace(",", "").replace(";", ""), edits)
                    best[place] = min(best.get(place, offer), offer)
            after = {place: b[0] for place, b in best.items()}
            made.append((c, n, [best[p][2] if p in best else None for p in range(4)]))
        columns = list(zip(*made)) or [[]] * 3
        types = (pa.string(), pa.int64(), pa.list_(pa.string()))
        yield pa.record_batch([pa.array(x, t) for x, t in zip(columns, types)], names=["c", "n", "edits"])


class _Repaired:
    """The running digest of one conversation, fed with its rows in order."""

    def __init__(self, c: str):
        self.c = c
        self.digest, self.lines = hashlib.sha256(), 0
        self.audit: list[str] = []
        self.place, self.before, self.last_turn = START, None, None
        self.first_turn, self.turns, self.rows = None, 0, 0
        self.faults = [0] * 5
        self.illegal, self.cost = 0, 0

    def line(self, role: str, text: str) -> None:
        self.digest.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
        self.lines += 1
        self.place = _NEXT[self.place][role[:1]]

    def edit(self, letters: str, role: str | None = None, text: str | None = None) -> None:
        """Apply one row's edits, or the insertions at the end."""
        for x in letters:
            if x == "I":
                self.line(_ROLE[self.place], "")
            elif x == "K":
                self.line(role, text)
            elif x == "R":
                self.line(_ROLE[self.place], text)
        self.audit.append(letters)

    def row(self, turn: int | None, role: str, text: str, fault: int, letters: str) -> None:
        if fault == IS_DROPPED:
            return
        self.rows += 1
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        self.faults[fault] += 1
        if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = role[:1]
        self.cost += sum({"D": DELETE, "I": INSERT, "R": REROLE}.get(x, 0) for x in letters)
        if fault == IS_TRUNCATED and "D" not in letters:
            self.cost += TRUNCATED_KEPT
        self.edit(letters, role, text)

    def close(self, letters: str) -> tuple:
        self.cost += INSERT * len(letters)
        self.edit(letters)
        gaps = self.last_turn - self.first_turn + 1 - self.turns if self.turns else 0
        counts = (self.faults[IS_BLANK], self.faults[IS_DUPLICATE], self.faults[IS_TRUNCATED])
        return (self.c, gaps, *counts, self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest())


_DIGEST = "c string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (c, n, part, turn, role, text, fault, edits) in order of (c, n, part), where part 0 brings the edits of the
    piece that begins at n and part 1 is a row -> one row for each conversation."""
    now, edits, end = None, iter(()), ""
    types = [pa.string(), *[pa.int64()] * 6, pa.string(), pa.string()]
    names = [x.split()[0] for x in _DIGEST.split(", ")]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [[] for _ in names]
        return pa.record_batch([pa.array(x, t) for x, t in zip(columns, types)], names=names)

    for batch in batches:
        out = []
        for at in range(0, batch.num_rows, 64):  # a few rows at a time: texts may be long
            for c, _, part, turn, role, text, fault, options in zip(*(x.to_pylist() for x in batch.slice(at, 64).columns)):
                if now is None or c != now.c:
                    if now is not None:
                        out.append(now.close(end))
                    now = _Repaired(c)
                if part == 0:
                    by_row, end = options[now.place].split(";")
                    edits = iter(by_row.split(","))
                else:
                    now.row(turn, role, text, fault, next(edits))
        yield made(out)
    if now is not None:
        yield made([now.close(end)])


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", dropped_rows: Column | None = None, block: int = BLOCK) -> DataFrame:
    """Faults and cheapest repair of every conversation: (conversation, gaps, blank, duplicate, truncated, illegal, cost,
    audit, repaired_sha256), one row for each different conversation id, null included.

    A conversation's rows go by turn (nulls first), then role, then text.  A null role or text is one space.  Each row's
    first fault counts: blank, duplicate (same role and text earlier), truncated (its last character that is not blank is
    none of ``.!?``).  Rows for which ``dropped_rows`` is true are no rows, but their conversation is returned; without
    rows its counts are 0, its audit is empty and its digest that of the empty string.  Rows with equal turns may be
    many; repeated rows are duplicates.  Empty tables give no rows; other columns are not carried.

    A SHA-256 is made in order, so each conversation's digest is made by one task; it holds one row at a time.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(" "))
    read = rows.select(
        F.col(f"`{conv_col}`").alias("conv"),
        F.to_json(F.struct(F.col(f"`{conv_col}`").alias("c"))).alias("c"),
        F.col(f"`{turn_col}`").cast("long").alias("turn"),
        F.coalesce(F.col(f"`{role_col}`"), F.lit(" ")).alias("role"),
        text.alias("text"),
        (dropped_rows if dropped_rows is not None else F.lit(False)).alias("gone"),
        F.monotonically_increasing_id().alias("read"),  # parts equal rows, of which there may be many
    )
    placed, ordered_path = written(read.repartitionByRange(*_order()).sortWithinPartitions(*_order()).withColumn("part", F.spark_partition_id()), "ordered")
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*_order())) - 1
    counts = placed.groupBy("part").count()
    # a row for each partition
    start = counts.withColumn("start", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "start")
    kept = F.rtrim(F.col("text"), F.lit(BLANK))
    same = F.sha2(F.to_json(F.struct("c", "role", "text")).cast("binary"), 256)
    numbered, numbered_path = written(
        placed.withColumn("inside", inside).join(F.broadcast(start), "part").select(
            (F.col("start") + F.col("inside")).cast("long").alias("n"), "conv", "c", "turn", "role", "text",
            F.when(F.col("gone"), IS_DROPPED).when(kept == "", IS_BLANK).when(~F.right(kept, F.lit(1)).isin(".", "!", "?"), IS_TRUNCATED).otherwise(NONE).alias("fault"),
            F.when(~F.col("gone") & (kept != ""), same).alias("same"),
        ), "numbered",
    )
    dropped(rows.sparkSession, ordered_path)
    # later rows with the role and text of an earlier one
    firsts = numbered.where("same is not null").groupBy("same").agg(F.min("n").alias("first"), F.count("*").alias("many")).where("many > 1").select("same", "first")
    again = numbered.select("n", "same").join(firsts, "same").where("n > first").select("n")
    marked = numbered.join(again.withColumn("again", F.lit(True)), "n", "left")
    rows_, rows_path = written(marked.withColumn("fault", F.when(F.col("again"), IS_DUPLICATE).otherwise(F.col("fault"))).drop("same", "again"), "rows")
    dropped(rows.sparkSession, numbered_path)
    width = shuffle_width(rows.sparkSession)
    codes = rows_.select("n", "c", F.substring("role", 1, 1).alias("initial"), "fault", F.floor(F.col("n") / block).alias("block"))
    pieces = (
        codes.repartition(width, "block").sortWithinPartitions("n").drop("block")
        .mapInArrow(lambda batches: _searched(batches, block), "c string, n long, place array<long>, goal array<long>, cost array<long>, edits array<string>")
    )
    best = (
        pieces.repartition(width, "c").sortWithinPartitions("c", F.col("n").desc())
        .mapInArrow(_chosen, "c string, n long, edits array<string>")
    )
    plan = best.select("c", "n", F.lit(0).alias("part"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(0).alias("fault"), "edits")
    body = rows_.select("c", "n", F.lit(1).alias("part"), "turn", "role", "text", "fault", F.lit(None).cast("array<string>").alias("edits"))
    digests = plan.unionByName(body).repartition(width, "c").sortWithinPartitions("c", "n", "part").mapInArrow(_repaired, _DIGEST)
    conv = F.from_json("c", f"c {dict(read.dtypes)['conv']}")["c"].alias(conv_col)
    return digests.select(conv, *[x.split()[0] for x in _DIGEST.split(", ")[1:]])


def _order() -> list[Column]:
    return [F.col("c"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("read")]


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows damaged by the CRC-32 of ``conversation:turn`` (a null is one space) modulo 20: (conversation, turn, role, text,
    gone).  0 drops the row, 1 empties its text, 2 removes its sentence ends, 3 repeats it, 4 makes its role user.  A
    null role or text is one space."""
    named = [F.coalesce(F.col(f"`{x}`").cast("string"), F.lit(" ")) for x in (conv_col, turn_col)]
    kind = (F.crc32(F.concat_ws(":", *named).cast("binary")) % 20).alias("kind")
    role, text = [F.coalesce(F.col(f"`{x}`"), F.lit(" ")) for x in (role_col, text_col)]
    read = rows.select(F.col(f"`{conv_col}`").alias(conv_col), F.col(f"`{turn_col}`").alias(turn_col), role.alias(role_col), text.alias(text_col), kind)
    return read.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select(
        F.col(f"`{conv_col}`"),
        F.col(f"`{turn_col}`"),
        F.when(F.col("kind") == 4, "user").otherwise(F.col(f"`{role_col}`")).alias(role_col),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace(f"`{text_col}`", "[.!?]", "")).otherwise(F.col(f"`{text_col}`")).alias(text_col),
        (F.col("kind") == 0).alias("gone"),
    )
