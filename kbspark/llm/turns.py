"""Repair of the turn structure of conversations by depth-first branch and bound.

What is known of a row is one byte: its role's initial and its first fault. Rows are put in order by ranges of
(conversation, turn, …), so that a conversation of any size is spread over tasks, and every task packs the rows of a
conversation into segments. A conversation's segments then meet: a byte for each row, and as many for its audit, are all
that is ever held of it. Texts are shuffled once, behind the audit that says what becomes of them, and hashed as they pass.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain, groupby, islice

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT = 0, 3, 4, 3
#: What a truncated row costs besides, unless it is deleted.
TRUNCATED = 3
#: A row's code: four times the place of its initial here (3 for any other), and its fault. GONE: no row any more.
INITIALS, SOUND, BLANK, DUPLICATE, CUT, GONE = "sua", 0, 1, 2, 3, 16
#: Rows that one search goes over; the costs of the rest are known by then.
SEGMENT = 1024

# The form `(s?(ua)+)?` as states: nothing yet, after s, after u, after a. INSERTED: where a user or assistant leads,
# of which every state takes just one. KEPT: where a row's own initial leads, -1 if nowhere. ENDS: states to stop in.
INSERTED = (2, 2, 3, 2)
KEPT = ((1, 2, -1, -1), (-1, 2, -1, -1), (-1, -1, 3, -1), (-1, 2, -1, -1))
ENDS = (0, 3)
NEVER = 1 << 60


def _before(code: int, after: list[int]) -> list[int]:
    """The least cost from every state before a row, inserts included, from that behind it."""
    initial, fault = code >> 2, code & 3
    costs = []
    for state in range(4):
        cost = DELETE + after[state]
        if fault not in (BLANK, DUPLICATE):
            more = TRUNCATED if fault == CUT else 0
            cost = min(cost, REROLE + more + after[INSERTED[state]])
            if KEPT[state][initial] >= 0:
                cost = min(cost, KEEP + more + after[KEPT[state][initial]])
        costs.append(cost)
    return _with_inserts(costs)


def _with_inserts(costs: list[int]) -> list[int]:
    """Costs of states where rows may be inserted first; two inserts lead on from any state, more only round and round."""
    once = [min(c, INSERT + costs[t]) for c, t in zip(costs, INSERTED)]
    return [min(c, INSERT + once[t]) for c, t in zip(once, INSERTED)]


#: What is still to be paid behind the last row.
AT_END = _with_inserts([0 if s in ENDS else NEVER for s in range(4)])


def _search(codes: bytes, start: int, bounds: list[list[int]], last: bool) -> tuple[int, str, int]:
    """(cost, audit, state) of the cheapest edits of codes from a state, by depth-first branch and bound.

    bounds[i][s]: the least cost of all that comes from row i on. A node is a prefix of edits: its cost, the rows behind it, its state and
    its last edit with the node before. The stack's top is the child of the least bound, the ASCII-least of equal ones.
    The incumbent is the best whole (cost, audit); nodes whose bound is over it go. A node table has the best (cost, audit) of each
    row and state; a prefix that is not better than that is dominated. Once the stack is empty the incumbent is proved.
    Without `last` a part ends right behind its last row (what is inserted before the next one is chosen with that), and
    the cost has the bound of the rest in it. No audit of a node begins with another of the same cost: it would differ by inserts alone.
    """
    n = len(codes)
    best: tuple[int, str, int] | None = None
    table: dict[tuple[int, int], tuple[int, tuple | None]] = {}
    stack = [(bounds[0][start], 0, 0, start, None)]
    while stack:
        bound, cost, i, state, edits = stack.pop()
        if best and (bound > best[0] or bound == best[0] and _text(edits) > best[1]):
            continue
        held = table.get((i, state))
        if held and (held[0] < cost or held[0] == cost and _text(held[1]) <= _text(edits)):
            continue
        table[i, state] = (cost, edits)
        if i == n and (not last or state in ENDS):
            whole = (bound, _text(edits), state)
            if not best or whole[:2] < best[:2]:
                best = whole
            continue
        children = []
        if i < n or last:
            children.append((INSERT, i, INSERTED[state], "I"))
        if i < n:
            initial, fault = codes[i] >> 2, codes[i] & 3
            children.append((DELETE, i + 1, state, "D"))
            if fault not in (BLANK, DUPLICATE):
                more = TRUNCATED if fault == CUT else 0
                children.append((REROLE + more, i + 1, INSERTED[state], "R"))
                if KEPT[state][initial] >= 0:
                    children.append((KEEP + more, i + 1, KEPT[state][initial], "K"))
        grown = [(cost + c + bounds[j][s], cost + c, j, s, letter) for c, j, s, letter in children]
        for b, c, j, s, letter in sorted(grown, key=lambda x: (x[0], x[4]), reverse=True):
            if not best or b <= best[0]:
                stack.append((b, c, j, s, (letter, edits)))
    return best


def _text(edits: tuple | None) -> str:
    """The letters of linked edits, the last of which comes first."""
    out = []
    while edits:
        letter, edits = edits
        out.append(letter)
    return "".join(reversed(out))


def repair(codes: bytes, segment: int = SEGMENT) -> tuple[int, str]:
    """(cost, audit): the cheapest edits that give a conversation of such rows the form, the ASCII-least of equal ones.

    The suffix bounds are the exact costs of what is left, worked out from the end; of long conversations only those at
    the starts of segments are kept, and worked out again inside the segment that is searched. So time and memory grow with the rows.
    """
    starts = range(0, max(1, len(codes)), segment)
    ends, after = {}, AT_END
    for a in reversed(starts):
        ends[a] = after
        for code in reversed(codes[a : a + segment]):
            after = _before(code, after)
    total, state, audit = after[0], 0, []
    for a in starts:
        part, last = codes[a : a + segment], a + segment >= len(codes)
        bounds = [ends[a]]
        for code in reversed(part):
            bounds.append(_before(code, bounds[-1]))
        bounds.reverse()
        _, edits, state = _search(part, state, bounds, last)
        audit.append(edits)
    return total, "".join(audit)


def faults(codes: bytes) -> tuple[int, int, int, int]:
    """Rows that are blank, duplicates, truncated, and neighbours whose initials are not su, ua or au."""
    of = [c & 3 for c in codes]
    initials = [c >> 2 for c in codes]
    illegal = sum((a, b) not in ((0, 1), (1, 2), (2, 1)) for a, b in zip(initials, initials[1:]))
    return of.count(BLANK), of.count(DUPLICATE), of.count(CUT), illegal


def _place(role: str) -> int:
    return max(0, INITIALS.find(role[0])) if role and role[0] in INITIALS else 3


def damaged(rows: DataFrame) -> DataFrame:
    """rows(conv, turn, role, text) with what `crc32(conv:turn) % 20` does to them; `gone` marks those it drops.

    Nulls: one space, in the sum as in role and text. 0 drops a row, 1 empties its text, 2 takes out `.`, `!` and `?`,
    3 repeats it, 4 makes it the user's. Rows of one turn meet one fate."""
    space = F.lit(" ")
    named = F.concat(F.coalesce(F.col("conv").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = rows.select("conv", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(named.cast("binary")) % 20).alias("hit"))
    hit = F.col("hit")
    text = F.when(hit == 1, "").when(hit == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(hit == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(hit == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")
    return rows.select("conv", "turn", role.alias("role"), text.alias("text"), (hit == 0).alias("gone"), copies).drop("copy")


def _in_order(rows: DataFrame, *before: str) -> list[Column]:
    """A conversation's rows by turn, null first; those of one turn by role, then text."""
    return [F.col(c).asc_nulls_first() for c in ("conv", *before, "turn", "role", "text")]


def _coded(rows: DataFrame) -> DataFrame:
    """rows(conv, turn, role, text, gone) with `code`, but that repeats inside a turn are not marked: their order shows them.

    A row is a duplicate if an earlier turn has its role and text. An aggregation, which counts before it shuffles, finds
    what is said in more than one turn, and only that is joined."""
    said = F.unhex(F.sha2(F.concat_ws(":", F.octet_length("role").cast("string"), "role", "text"), 256))
    rows = rows.withColumns({"said": said, "at": F.struct(F.col("turn").isNotNull().alias("named"), "turn")})
    again = rows.where(~F.col("gone")).groupBy("conv", "said").agg(F.min("at").alias("first"), F.max("at").alias("final")).where("first <> final")
    again = again.select(F.col("conv").alias("_conv"), F.col("said").alias("_said"), "first")
    rows = rows.join(again, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("said") == F.col("_said")), "left")
    end = F.right(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), F.lit(1))
    fault = F.when(end == "", BLANK).when(F.col("at") > F.col("first"), DUPLICATE).when(~end.isin(".", "!", "?"), CUT).otherwise(SOUND)
    initial = F.left("role", F.lit(1))
    place = F.coalesce(*(F.when(initial == c, i) for i, c in enumerate(INITIALS)), F.lit(3))
    return rows.select("conv", "turn", "role", "text", F.when(F.col("gone"), GONE).otherwise(4 * place + fault).alias("code"))


def _batches(rows: Iterator[tuple], fields: list[tuple[str, pa.DataType]], most: int = 1000) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(fields)
    while out := list(islice(rows, most)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch], fields: list) -> Iterator[tuple]:
    """The rows of batches; the type of the first column becomes that of fields[0]."""
    for batch in batches:
        if not fields[0][1]:
            fields[0] = (fields[0][0], batch.schema.field(0).type)
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _then(first: Iterator[tuple], make, fields: list) -> Iterator[pa.RecordBatch]:
    """Batches of make(rows), which begin once the first row has told the types."""
    made = make(first)
    one = next(made, None)
    if one is not None:
        yield from _batches(chain([one], made), fields)


_SEGMENTS = "part int, place long, codes binary, turns long, low long, high long"
_PLANS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows as segments of a conversation: codes, and how many turns there are, from which to which."""
    part = TaskContext.get().partitionId()
    fields = [("conv", None), ("part", pa.int32()), ("place", pa.int64()), ("codes", pa.binary()), ("turns", pa.int64()), ("low", pa.int64()), ("high", pa.int64())]

    def segments(rows):
        place = 0
        for conv, own in groupby(rows, key=lambda x: x[0]):
            before = None
            while True:
                codes, turns, low, high = bytearray(), 0, None, None
                n = 0
                for _, turn, role, text, code in islice(own, SEGMENT):
                    n += 1
                    if code == GONE:
                        continue
                    # the same row again in one turn: all but the first are duplicates
                    if (turn, role, text) == before and code & 3 != BLANK:
                        code = code & ~3 | DUPLICATE
                    before = (turn, role, text)
                    codes.append(code)
                    if turn is not None:
                        turns += turn != high
                        low, high = turn if low is None else low, turn
                if n:
                    yield (conv, part, place, bytes(codes), turns, low, high)
                    place += 1
                if n < SEGMENT:
                    break

    return _then(_rows(batches, fields), segments, fields)


def _plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted segments as one plan a conversation."""
    fields = [("conv", None), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string())]

    def plans(rows):
        for conv, parts in groupby(rows, key=lambda x: x[0]):
            codes, turns, low, high = bytearray(), 0, None, None
            for _, _, _, more, n, first, final in parts:
                codes += more
                if n:
                    turns += n - (first == high)
                    low, high = first if low is None else low, final
            yield (conv, high - low + 1 - turns if turns else 0, *faults(codes), *repair(bytes(codes)))

    return _then(_rows(batches, fields), plans, fields)


def plans(rows: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit) for every conv of rows(conv, turn, role, text, gone).

    Rows that are gone count for nothing, but a conversation of them alone has a plan of zeros. A null conv is a
    conversation like any other. Turns are integers; null ones come first and count for no gap. Rows of one turn go by role, then
    text. A row's first fault counts: blank (nothing but ASCII white space), duplicate (its role and text were seen
    before), truncated (the last character that is not white space is none of `.!?`)."""
    kind = rows.schema["conv"].dataType.simpleString()
    order = _in_order(rows)
    rows = _coded(rows.withColumn("turn", F.col("turn").cast("long"))).repartitionByRange(*order).sortWithinPartitions(*order)
    segments = rows.mapInArrow(_pack, f"conv {kind}, {_SEGMENTS}")
    return segments.repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), "part", "place").mapInArrow(_plan, f"conv {kind}, {_PLANS}")


def _applied(audit: str, rows: Iterator[tuple]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of what an audit makes of a conversation's rows(…, role, text)."""
    state = 0
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)[-2:]
        if edit == "D":
            continue
        if edit == "K":
            state = KEPT[state][_place(role)]
        else:
            state = INSERTED[state]
            role = "user" if state == 2 else "assistant"
        yield edit, role, text


def _behind_plans(rows: DataFrame, made: DataFrame) -> DataFrame:
    """Every conversation's plan, then its rows in order: what is repaired in one pass."""
    rows = rows.where(~F.col("gone")).select("conv", F.lit(1).alias("kind"), F.lit(None).cast(made.drop("conv").schema).alias("plan"), F.col("turn").cast("long").alias("turn"), "role", "text")
    first = made.select("conv", F.lit(0).alias("kind"), F.struct(*made.drop("conv").columns).alias("plan"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    both = first.union(rows)
    return both.repartition("conv").sortWithinPartitions(*_in_order(both, "kind"))


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fields = [("conv", None), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]

    def turns(rows):
        for conv, own in groupby(rows, key=lambda x: x[0]):
            for place, row in enumerate(_applied(next(own)[2]["audit"], own)):
                yield (conv, place, *row)

    return _then(_rows(batches, fields), turns, fields)


def repaired(rows: DataFrame, made: DataFrame) -> DataFrame:
    """(conv, place, edit, role, text): the repaired conversations of rows(conv, turn, role, text, gone) by their plans."""
    kind = rows.schema["conv"].dataType.simpleString()
    return _behind_plans(rows, made).mapInArrow(_repaired, f"conv {kind}, place long, edit string, role string, text string")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fields = [("conv", None), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())]

    def digests(rows):
        for conv, own in groupby(rows, key=lambda x: x[0]):
            plan, digest = next(own)[2], hashlib.sha256()
            for place, (_, role, text) in enumerate(_applied(plan["audit"], own)):
                digest.update(f"{chr(10) if place else ''}{role}:{text}".encode())
            yield (conv, *plan.values(), digest.hexdigest())

    return _then(_rows(batches, fields), digests, fields)


def with_digests(rows: DataFrame, made: DataFrame) -> DataFrame:
    """The plans with repaired_sha256: of every conversation's repaired `role:text` lines, hashed as they pass.

    A SHA-256 is worked out in order, so one task reads a conversation's texts; it holds a batch of them."""
    kind = rows.schema["conv"].dataType.simpleString()
    return _behind_plans(rows, made).mapInArrow(_digests, f"conv {kind}, {_PLANS}, repaired_sha256 string")
