"""Repair of the structure of conversations by lightest derivations.

A conversation should read ``(system? (user assistant)+)?`` by the first letters of its roles, without blank, repeated or cut
off messages. Edits have costs: keep (K, 0), give the role user or assistant (R, 3), delete (D, 4; blank and repeated
messages must go), insert an empty message of user or assistant (I, 3); a cut off message that stays adds 3. The
cheapest edits are wanted, and of these the least string of their letters, the audit.

This is a weighted deduction: the item ``prefix(i, state)`` says that the first i messages can be turned into a
beginning that ends in ``state``; a rule concludes it from a shorter prefix, an edit of message i and perhaps an
insertion. Weights are pairs (cost, audit), added and joined. A conclusion never weighs less than its prefix, so Knuth's
agenda, which takes the lightest open item and closes it for good, ends when it takes the goal.

Insertions need only be tried right before a message that stays, and at the end: moved behind deletions they cost
the same and the audit is less. So audits over the same messages are never one the beginning of the other, and
comparing them part by part is comparing them whole. That lets a long conversation be cut into pieces:
each piece gives the lightest derivation between any two states, and a scan over the pieces picks the states.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import partial, reduce
from heapq import heappop, heappush
from operator import and_
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.llm.written import written

RETYPE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3

#: States by what the repaired messages so far end in.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
_WANTED = ("u", "u", "a", "u")
_AFTER = (USER, USER, ASSISTANT, USER)
_ROLE = {"u": "user", "a": "assistant"}
_LEGAL = {"su", "ua", "au"}
#: Insertions that end a conversation properly from each state.
_CLOSING = ("", "II", "I", "")

PIECE = 512  # messages derived at a time
RANGE = 1 << 20  # distinct messages per sorted partition, about
SPACES = " \t\n\x0b\x0c\r"

Weight = tuple[int, str]


class Message(NamedTuple):
    """Equal messages of one turn. ``must_go`` says that all copies do, else all but the first."""

    initial: str
    copies: int
    must_go: bool
    cut_off: bool


def lightest(axioms: dict, rules: Callable[[tuple], Iterable[tuple]], start: tuple, goal: tuple | None) -> dict:
    """Knuth's agenda: the least weight of every item that can be derived, up to the goal if there is one.

    ``axioms`` has the weights of items that need no derivation. ``rules(item)`` gives ``(antecedents, conclusion)`` for
    the rules that become complete with a derived item; the weight of a conclusion is that of its antecedents, costs added and
    audits joined, which is monotone and never less than the weight of ``item``, the first antecedent.
    """
    closed = dict(axioms)
    agenda = [((0, ""), start)]
    while agenda:
        weight, item = heappop(agenda)
        if item in closed:
            continue
        closed[item] = weight
        if item == goal:
            break
        for antecedents, conclusion in rules(item):
            if conclusion not in closed:
                known = [closed[a] for a in antecedents]
                heappush(agenda, ((sum(k[0] for k in known), "".join([k[1] for k in known])), conclusion))
    return closed


_EDIT, _INSERT, _PREFIX, _GOAL = range(4)
INSERTED = (_INSERT, 0, 0)
GOAL = (_GOAL, 0, 0)


def _axioms(messages: Sequence[Message]) -> dict:
    """Weights of the edits of every message, and of an insertion."""
    weights: dict[tuple, Weight] = {INSERTED: (INSERT, "I")}
    for i, m in enumerate(messages):
        weights[_EDIT, i, "D"] = (DELETE * m.copies, "D" * m.copies)
        if not m.must_go:
            rest = "D" * (m.copies - 1)
            kept = (CUT_OFF if m.cut_off else 0) + DELETE * len(rest)
            weights[_EDIT, i, "K"] = (kept, "K" + rest)
            weights[_EDIT, i, "R"] = (kept + RETYPE, "R" + rest)
    return weights


def _rules(messages: Sequence[Message], closing: bool) -> Callable[[tuple], Iterator[tuple]]:
    def rules(item: tuple) -> Iterator[tuple]:
        _, i, state = item
        if i == len(messages):
            if closing:
                yield (item, *[INSERTED] * len(_CLOSING[state])), GOAL
            return
        message = messages[i]
        yield (item, (_EDIT, i, "D")), (_PREFIX, i + 1, state)
        if message.must_go:
            return
        if state == START and message.initial == "s":
            yield (item, (_EDIT, i, "K")), (_PREFIX, i + 1, SYSTEM)
        for inserted in ((), (INSERTED,)):
            wanted = _WANTED[state]
            state = _AFTER[state]
            edit = "K" if message.initial == wanted else "R"
            yield (item, *inserted, (_EDIT, i, edit)), (_PREFIX, i + 1, state)
            # The second time the wanted message was inserted, and the one after it is wanted.

    return rules


def repair_whole(messages: Sequence[Message]) -> Weight:
    """Cost and audit of a whole conversation."""
    return lightest(_axioms(messages), _rules(messages, True), (_PREFIX, 0, START), GOAL)[GOAL]


def repair_piece(messages: Sequence[Message]) -> list[Weight | None]:
    """Lightest derivations of a piece, ``STATES * before + after``; None where there is no way."""
    axioms, rules = _axioms(messages), _rules(messages, False)
    out: list[Weight | None] = []
    for before in range(STATES):
        closed = lightest(axioms, rules, (_PREFIX, 0, before), None)
        out += [closed.get((_PREFIX, len(messages), after)) for after in range(STATES)]
    return out


def applied(items: Sequence[dict], audit: str, before: int) -> Iterator[tuple[str, str, dict | None]]:
    """The messages that the edits leave: letter, role, and the item (None where inserted)."""
    state, at = before, 0

    def inserted() -> Iterator[tuple[str, str, None]]:
        nonlocal state, at
        while at < len(audit) and audit[at] == "I":
            yield "I", _ROLE[_WANTED[state]], None
            state, at = _AFTER[state], at + 1

    for item in items:
        yield from inserted()
        letter, at = audit[at], at + item["copies"]
        if letter == "K":
            initial = item["role"][:1]
            yield letter, item["role"], item
            state = SYSTEM if initial == "s" else _AFTER[state]
        elif letter == "R":
            yield letter, _ROLE[_WANTED[state]], item
            state = _AFTER[state]
    yield from inserted()


ITEM = pa.struct(
    [("turn", pa.int64()), ("role", pa.string()), ("digest", pa.binary()), ("copies", pa.int64()),
     ("must_go", pa.bool_()), ("cut_off", pa.bool_())]
)
PIECES = pa.schema(
    [("conv_id", pa.int64()), ("part", pa.int64()), ("sub", pa.int64()), ("items", pa.list_(ITEM)),
     ("first", pa.string()), ("last", pa.string()), ("illegal", pa.int64()), ("whole", pa.bool_()),
     ("costs", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))]
)
_PIECES = (
    "conv_id bigint, part bigint, sub bigint, items array<struct<turn:bigint,role:string,digest:binary,copies:bigint,"
    "must_go:boolean,cut_off:boolean>>, first string, last string, illegal bigint, whole boolean, costs array<bigint>,"
    "ranks array<bigint>, audits array<string>"
)


def _piece(conv_id, part: int, sub: int, items: list[dict], whole: bool) -> dict:
    initials = [item["role"][:1] for item in items]
    messages = [Message(x, i["copies"], i["must_go"], i["cut_off"]) for x, i in zip(initials, items)]
    found = [repair_whole(messages)] if whole else repair_piece(messages)
    order = {audit: rank for rank, audit in enumerate(sorted(w[1] for w in found if w))}
    illegal = sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:])) + sum(i["copies"] - 1 for i in items)
    return {
        "conv_id": conv_id, "part": part, "sub": sub, "items": items, "first": initials[0], "last": initials[-1],
        "illegal": illegal, "whole": whole, "costs": [w and w[0] for w in found],
        "ranks": [w and order[w[1]] for w in found], "audits": [w and w[1] for w in found],
    }


def _cut(batches: Iterable[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Pieces from sorted messages. A conversation that starts and ends inside the partition is solved whole."""
    part, sub = TaskContext.get().partitionId(), 0
    held: list[dict] = []
    ready: list[dict] = []
    inside = False  # the held messages start a conversation, surely
    size = 0

    def flush(ended: bool) -> None:
        nonlocal sub, held, inside
        conv_id = held[0]["conv_id"]
        items = [{k: v for k, v in row.items() if k != "conv_id"} for row in held]
        ready.append(_piece(conv_id, part, sub, items, inside and ended))
        sub, held, inside = sub + 1, [], ended

    conv_id, any_row = None, False
    for batch in batches:
        for row in batch.to_pylist():
            if any_row and row["conv_id"] != conv_id:
                if held:
                    flush(True)
                inside = True
            elif len(held) == length:
                flush(False)
            conv_id, any_row = row["conv_id"], True
            held.append(row)
            size += 1
        if size >= 4 * length and ready:
            yield pa.RecordBatch.from_pylist(ready, schema=PIECES)
            ready, size = [], 0
    if held:
        flush(False)
    if ready:
        yield pa.RecordBatch.from_pylist(ready, schema=PIECES)


def _scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over the pieces of a conversation in order: the best state before each state, and the state at the end."""
    schema = pa.schema(
        [("conv_id", pa.int64()), ("part", pa.int64()), ("sub", pa.int64()), ("came", pa.list_(pa.int64())),
         ("finish", pa.int64()), ("joint", pa.int64())]
    )
    waiting: dict | None = None
    best: list[tuple[int, int] | None] = []  # cost, and rank of the audit among the states
    last = ""

    def finished(piece: dict) -> dict:
        ends = [(b[0] + INSERT * len(_CLOSING[s]), b[1], s) for s, b in enumerate(best) if b]
        return {**piece, "finish": min(ends)[2]}

    for batch in batches:
        out = []
        for row in batch.to_pylist():
            new = waiting is None or row["conv_id"] != waiting["conv_id"]
            if waiting is not None:
                out.append(finished(waiting) if new else waiting)
            if new:
                best = [(0, 0), None, None, None]
            came: list[int] = []
            reached: list[tuple | None] = []
            for after in range(STATES):
                ways = [
                    (best[s][0] + row["costs"][STATES * s + after], best[s][1], row["ranks"][STATES * s + after], s)
                    for s in range(STATES)
                    if best[s] is not None and row["costs"][STATES * s + after] is not None
                ]
                reached.append(min(ways) if ways else None)
                came.append(min(ways)[3] if ways else -1)
            order = sorted(w[1:3] for w in reached if w)
            best = [w and (w[0], order.index(w[1:3])) for w in reached]
            joint = 0 if new else int(last + row["first"] not in _LEGAL)
            last = row["last"]
            waiting = {
                "conv_id": row["conv_id"], "part": row["part"], "sub": row["sub"], "came": came, "finish": None,
                "joint": joint,
            }
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
    if waiting is not None:
        yield pa.RecordBatch.from_pylist([finished(waiting)], schema=schema)


def _back(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over the pieces from the last to the first: the states before and after each."""
    state = START
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            after = state if row["finish"] is None else row["finish"]
            state = row["came"][after]
            ending = "" if row["finish"] is None else _CLOSING[after]
            out.append(
                {"part": row["part"], "sub": row["sub"], "before": state, "after": after, "ending": ending,
                 "joint": row["joint"]}
            )
        yield pa.RecordBatch.from_pylist(out)


def _left(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The messages that the edits of each piece leave."""
    schema = pa.schema(
        [("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()),
         ("turn", pa.int64()), ("old_role", pa.string()), ("digest", pa.binary())]
    )
    for batch in batches:
        for row in batch.to_pylist():
            base = (row["part"] << 43) | (row["sub"] << 12)
            out = []
            for n, (letter, role, item) in enumerate(applied(row["items"], row["audit"], row["before"]), 1):
                item = item or {}
                out.append(
                    {"conv_id": row["conv_id"], "place": base + n, "edit": letter, "role": role, "turn": item.get("turn"),
                     "old_role": item.get("role"), "digest": item.get("digest")}
                )
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit and SHA-256 of each conversation from its sorted pieces and messages; holds one digest and one audit."""
    schema = pa.schema([("conv_id", pa.int64()), ("audit", pa.string()), ("sha", pa.string())])
    conv_id, audit, sha, any_row, lines = None, [], hashlib.sha256(), False, 0
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if any_row and row["conv_id"] != conv_id:
                out.append({"conv_id": conv_id, "audit": "".join(audit), "sha": sha.hexdigest()})
                audit, sha, lines = [], hashlib.sha256(), 0
            conv_id, any_row = row["conv_id"], True
            if row["audit"] is not None:
                audit.append(row["audit"])
            else:
                sha.update(("\n" if lines else "").encode() + row["line"].encode("utf-8", "surrogatepass"))
                lines += 1
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
    if any_row:
        out = [{"conv_id": conv_id, "audit": "".join(audit), "sha": sha.hexdigest()}]
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with the faults that the crc32 of ``conv_id:turn`` modulo 20 calls for; nulls there are one space.

    0 drops a row, 1 empties its text, 2 takes its ``.``, ``!`` and ``?``, 3 repeats it, 4 makes it the user's.
    """
    conv_id, turn = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))
    named = F.concat(conv_id, F.lit(":"), turn)
    rows = conversations.select("conv_id", "turn", "role", "text", (F.crc32(named.cast("binary")) % 20).alias("fault"))
    rows = rows.where("fault <> 0").select(
        "conv_id",
        "turn",
        F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, F.lit(""))
        .when(F.col("fault") == 2, F.translate("text", ".!?", ""))
        .otherwise(F.col("text"))
        .alias("text"),
        F.when(F.col("fault") == 3, 2).otherwise(1).alias("times"),
    )
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.sequence(F.lit(1), "times"))).drop("col")


def _known(messages: DataFrame) -> DataFrame:
    """The columns used, null roles and texts as one space, and a digest of the text."""
    text = F.coalesce(F.col("text"), F.lit(" "))
    return messages.select(
        F.col("conv_id").cast("bigint"),
        F.col("turn").cast("bigint"),
        F.coalesce(F.col("role"), F.lit(" ")).alias("role"),
        text.alias("text"),
        F.unhex(F.md5(text.cast("binary"))).alias("digest"),
    )


def _same(pairs: Sequence[tuple[str, str]]) -> Column:
    """Each pair of columns is equal, or null in both."""
    return reduce(and_, [F.col(a).eqNullSafe(F.col(b)) for a, b in pairs])


class Repair:
    """The repair of all conversations of a table ``conv_id, turn, role, text``.

    Messages go by turn (null first), those of one turn by role and the MD5 of their text; equal rows stand together. A null
    role or text is one space, a null ``conv_id`` a conversation of its own; other columns are ignored,
    whatever their names. The first letter of a role counts; an empty role has none. An empty table gives empty results.

    Only digests, flags and counts are sorted and derived; texts join the messages that stay, once. A conversation of any
    length is cut at the borders of the sorted partitions and every ``piece`` messages, equal rows are one message with a count, and
    repeated texts are found by their first turn, so no conversation, turn or text fills a task.
    """

    def __init__(self, messages: DataFrame, *, piece: int = PIECE) -> None:
        if not 1 <= piece <= PIECE:
            raise ValueError(f"piece must lie between 1 and {PIECE}")
        self.piece = piece
        self.messages = _known(messages)
        bare = F.rtrim("text", F.lit(SPACES))
        ends = bare.endswith(".") | bare.endswith("!") | bare.endswith("?")
        flagged = self.messages.withColumns({"blank": bare == "", "open": ~ends})
        lines = flagged.groupBy("conv_id", "turn", "role", "digest").agg(
            F.count("*").alias("copies"), F.max("blank").alias("blank"), F.max("open").alias("open")
        )
        lines = written(lines, "messages")
        by_turn = F.struct(F.col("turn").isNotNull(), "turn")
        again = lines.groupBy("conv_id", "role", "digest").agg(F.count("*").alias("n"), F.min(by_turn).alias("first"))
        again = again.where("n > 1").select(
            *[F.col(c).alias(f"r_{c}") for c in ("conv_id", "role", "digest")], F.col("first.turn").alias("r_turn"), "n"
        )
        met = lines.join(again, _same([(c, f"r_{c}") for c in ("conv_id", "role", "digest")]), "left")
        earlier = F.col("n").isNotNull() & ~F.col("turn").eqNullSafe(F.col("r_turn"))
        judged = met.select(
            "conv_id", "turn", "role", "digest", "copies",
            (F.col("blank") | earlier).alias("must_go"), F.col("open").alias("cut_off"), "blank",
        )
        self.lines = written(judged, "judged")
        self.pieces = self._chosen()

    def _chosen(self) -> DataFrame:
        """All pieces with the edits chosen for them: ``conv_id, part, sub, items, illegal, before, cost, audit``."""
        spark = self.lines.sparkSession
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-self.lines.count() // RANGE))
        order = ["conv_id", "turn", "role", "digest"]
        ranged = self.lines.drop("blank").repartitionByRange(parts, *order).sortWithinPartitions(*order)
        pieces = written(ranged.mapInArrow(partial(_cut, length=self.piece), _PIECES), "pieces")

        loose = pieces.where("NOT whole").select("conv_id", "part", "sub", "first", "last", "costs", "ranks")
        kind = "conv_id bigint, part bigint, sub bigint, came array<bigint>, finish bigint, joint bigint"
        ahead = loose.repartition("conv_id").sortWithinPartitions("conv_id", "part", "sub").mapInArrow(_scan, kind)
        ahead = written(ahead, "scanned").repartition("conv_id")
        back = ahead.sortWithinPartitions("conv_id", F.desc("part"), F.desc("sub"))
        kind = "part bigint, sub bigint, before bigint, after bigint, ending string, joint bigint"
        states = back.mapInArrow(_back, kind)

        at = F.expr(f"cast({STATES} * before + after + 1 as int)")
        placed = pieces.where("NOT whole").join(states, ["part", "sub"]).select(
            "conv_id", "part", "sub", "items", (F.col("illegal") + F.col("joint")).alias("illegal"), "before",
            (F.element_at("costs", at) + F.lit(INSERT) * F.length("ending")).alias("cost"),
            F.concat(F.element_at("audits", at), "ending").alias("audit"),
        )
        solved = pieces.where("whole").select(
            "conv_id", "part", "sub", "items", "illegal", F.lit(START).cast("bigint").alias("before"),
            F.col("costs")[0].alias("cost"), F.col("audits")[0].alias("audit"),
        )
        return written(solved.unionByName(placed), "edits")

    def repaired(self) -> DataFrame:
        """``conv_id, place, edit, role, text``: what is left, in the order of ``place``; edits are K, R and I."""
        kind = "conv_id bigint, place bigint, edit string, role string, turn bigint, old_role string, digest binary"
        chosen = self.pieces.select("conv_id", "part", "sub", "items", "before", "audit")
        left = written(chosen.mapInArrow(_left, kind), "left")
        new = left.where("edit = 'I'").select("conv_id", "place", "edit", "role", F.lit("").alias("text"))
        kept = left.where("edit <> 'I'").withColumnsRenamed({"conv_id": "c", "turn": "t", "digest": "d"})
        one = ["conv_id", "turn", "role", "digest"]
        texts = self.messages.groupBy(*one).agg(F.first("text").alias("text")).withColumnRenamed("role", "was")
        keys = _same([("c", "conv_id"), ("t", "turn"), ("old_role", "was"), ("d", "digest")])
        return kept.join(texts, keys).select("conv_id", "place", "edit", "role", "text").unionByName(new)

    def faults(self) -> DataFrame:
        """``conv_id, gaps, blank, duplicate, truncated``. A gap beyond 64 bits is null."""
        free = F.when(F.col("must_go"), 0).otherwise(1)
        counted = self.lines.groupBy("conv_id").agg(
            F.min("turn").alias("low"),
            F.max("turn").alias("high"),
            F.countDistinct("turn").alias("turns"),
            F.sum(F.when(F.col("blank"), F.col("copies")).otherwise(0)).alias("blank"),
            F.sum(F.when(F.col("blank"), 0).otherwise(F.col("copies") - free)).alias("duplicate"),
            F.sum(F.when(F.col("cut_off"), free).otherwise(0)).alias("truncated"),
        )
        wide = "cast(high as decimal(20,0)) - cast(low as decimal(20,0)) + 1 - turns"
        gaps = F.expr(f"CASE WHEN low IS NULL THEN 0L ELSE try_cast({wide} AS bigint) END")
        return counted.select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated")

    def digests(self) -> DataFrame:
        """``conv_id, audit, sha``. The digest of a conversation is a chain, so its messages stream through one task."""
        lines = self.repaired().select(
            "conv_id", "place", F.concat("role", F.lit(":"), "text").alias("line"), F.lit(None).cast("string").alias("audit")
        )
        place = F.expr("shiftleft(part, 43) + shiftleft(sub, 12)").alias("place")
        audits = self.pieces.select("conv_id", place, F.lit(None).cast("string").alias("line"), "audit")
        both = lines.unionByName(audits).repartition("conv_id").sortWithinPartitions("conv_id", "place")
        return both.mapInArrow(_digests, "conv_id bigint, audit string, sha string")


def audit_conversations(conversations: DataFrame, messages: DataFrame, *, piece: int = PIECE) -> DataFrame:
    """One row per ``conv_id`` of ``conversations``: faults, cost, audit and digest of the repair of ``messages``.

    Returns ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``; a conversation without
    messages has zeros, an empty audit and the digest of nothing. See :class:`Repair`.
    """
    repair = Repair(messages, piece=piece)
    illegal = repair.pieces.select("conv_id", "illegal", "cost")
    parts = [conversations.select(F.col("conv_id").cast("bigint")), repair.faults(), illegal, repair.digests()]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    numbers = ["blank", "duplicate", "truncated", "illegal", "cost"]
    found = rows.groupBy("conv_id").agg(
        F.max("gaps").alias("gaps"), F.count("blank").alias("seen"),
        *[F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias(n) for n in numbers],
        F.max("audit").alias("audit"), F.max("sha").alias("sha"),
    )
    empty = hashlib.sha256().hexdigest()
    return found.select(
        "conv_id", F.when(F.col("seen") == 0, 0).otherwise(F.col("gaps")).cast("bigint").alias("gaps"), *numbers,
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.lit(empty)).alias("repaired_sha256"),
    )


def audit_sql() -> str:
    """The rows of :func:`audit_conversations` of the :func:`damaged` table ``conversations``, for DuckDB."""

    def stay(best: str, wanted: str, inserted: str = "") -> str:
        """From a state that wants ``wanted``, perhaps after an insertion: the message stays, as it is or with another role."""
        role = f"CASE WHEN initial = '{wanted[0]}' THEN role ELSE '{wanted}' END"
        cost = f"(CASE WHEN initial = '{wanted[0]}' THEN 0 ELSE {RETYPE} END) + {INSERT if inserted else 0} + kept"
        lines = f"chr(10) || '{inserted}:'" if inserted else "''"
        letters = f"'{'I' if inserted else ''}' || CASE WHEN initial = '{wanted[0]}' THEN 'K' ELSE 'R' END"
        way = f"""{{'cost': ({best}).cost + {cost}, 'audit': ({best}).audit || {letters},
            'text': ({best}).text || {lines} || chr(10) || {role} || ':' || text}}"""
        return f"CASE WHEN NOT must_go AND ({best}) IS NOT NULL THEN {way} END"

    def drop(best: str) -> str:
        way = f"{{'cost': {best}.cost + {DELETE}, 'audit': {best}.audit || 'D', 'text': {best}.text}}"
        return f"CASE WHEN {best} IS NOT NULL THEN {way} END"

    least = "list_sort(list_filter([{}], lambda w: w IS NOT NULL))[1]"
    for_user = least.format("b0, b1, b3")
    system = f"""CASE WHEN b0 IS NOT NULL AND initial = 's' AND NOT must_go THEN
        {{'cost': b0.cost + kept, 'audit': b0.audit || 'K', 'text': b0.text || chr(10) || role || ':' || text}} END"""
    weight = 'STRUCT("cost" BIGINT, audit VARCHAR, "text" VARCHAR)'

    def closed(best: str, letters: str) -> str:
        text = "".join(f" || chr(10) || '{r}:'" for r in ("user", "assistant")[2 - len(letters) :])
        way = f"{{'cost': {best}.cost + {INSERT * len(letters)}, 'audit': {best}.audit || '{letters}', 'text': {best}.text{text}}}"
        return f"CASE WHEN {best} IS NOT NULL THEN {way} END"

    ends = ", ".join(closed(f"b{s}", _CLOSING[s]) for s in range(STATES))
    return f"""
    WITH RECURSIVE bits AS (
        SELECT list_transform(range(256), lambda n: list_reduce([n::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
            lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
    raw AS (
        SELECT conv_id, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS conv, turn, coalesce(role, ' ') AS role,
            coalesce(text, ' ') AS text, hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))) AS h
        FROM conversations),
    drawn AS (
        SELECT conv, turn, role, text, xor(list_reduce([4294967295::BIGINT] || list_transform(regexp_extract_all(h, '..'),
            lambda x: ('0x' || x)::BIGINT), lambda c, x: xor(c >> 8, t[1 + xor(c & 255, x)])), 4294967295) % 20 AS fault
        FROM raw, bits),
    d AS (
        SELECT conv, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
            CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
            unnest(range(CASE WHEN fault = 3 THEN 2 ELSE 1 END)) AS copy
        FROM drawn WHERE fault <> 0),
    numbered AS (
        SELECT *, left(role, 1) AS initial, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare,
            row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, md5(text)) AS i FROM d),
    judged AS (
        SELECT *, bare = '' AS blank, row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 AS again,
            coalesce(lag(initial) OVER (PARTITION BY conv ORDER BY i) || initial NOT IN ('su', 'ua', 'au'), false) AS illegal
        FROM numbered),
    m AS (
        SELECT conv, turn, role, text, initial, i, illegal, blank, again AND NOT blank AS duplicate, blank OR again AS must_go,
            NOT blank AND NOT again AND right(bare, 1) NOT IN ('.', '!', '?') AS truncated,
            CASE WHEN right(bare, 1) IN ('.', '!', '?') THEN 0 ELSE {CUT_OFF} END AS kept
        FROM judged),
    walk AS (
        SELECT conv, 0::BIGINT AS i, {{'cost': 0, 'audit': '', 'text': ''}}::{weight} AS b0, NULL::{weight} AS b1,
            NULL::{weight} AS b2, NULL::{weight} AS b3
        FROM (SELECT DISTINCT conv FROM m)
        UNION ALL
        SELECT conv, m.i, {drop("b0")}, {least.format(f"{drop('b1')}, {system}")},
            {least.format(f"{drop('b2')}, {stay(for_user, 'user')}, {stay('b2', 'user', 'assistant')}")},
            {least.format(f"{drop('b3')}, {stay('b2', 'assistant')}, {stay(for_user, 'assistant', 'user')}")}
        FROM walk JOIN m USING (conv) WHERE m.i = walk.i + 1),
    ended AS (
        SELECT conv, {least.format(ends)} AS best FROM walk JOIN (SELECT conv, max(i) AS i FROM m GROUP BY conv) USING (conv, i)),
    counted AS (
        SELECT conv, coalesce(max(turn)::HUGEINT - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
            count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
            count(*) FILTER (truncated) AS truncated, count(*) FILTER (illegal) AS illegal
        FROM m GROUP BY conv)
    SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
        coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0) AS "cost",
        coalesce(best.audit, '') AS audit, sha256(coalesce(best.text[2:], '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv, conv_id FROM raw) LEFT JOIN counted USING (conv) LEFT JOIN ended USING (conv)"""
