import hashlib
import random
import re
import zlib
from itertools import product

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import clashing, rows
from turnwise.llm.conversation_repair import (
    INSERT,
    Message,
    Repair,
    _CLOSING,
    applied,
    audit_conversations,
    damaged,
    repair_piece,
    repair_whole,
)

GOOD = re.compile("(s?(ua)+)?")
RESULT = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def exhaustive(messages):
    """All edits of every message, with up to two insertions before each and at the end. Messages: (initial, must_go, cut)."""
    best = None
    gaps = ["", "u", "a", "ua", "au"]
    choices = []
    for initial, must_go, cut in messages:
        extra = 3 if cut else 0
        edits = [(4, "D", "")]
        if not must_go:
            edits += [(extra, "K", initial), (3 + extra, "R", "u"), (3 + extra, "R", "a")]
        choices.append([(3 * len(g) + c, "I" * len(g) + e, g + x) for g in gaps for c, e, x in edits])
    choices.append([(3 * len(g), "I" * len(g), g) for g in gaps])
    for pick in product(*choices):
        if GOOD.fullmatch("".join(p[2] for p in pick)):
            weight = (sum(p[0] for p in pick), "".join(p[1] for p in pick))
            best = weight if best is None else min(best, weight)
    return best


def given(draw, n):
    return [(draw.choice("suuaaax"), draw.random() < 0.2, draw.random() < 0.3) for _ in range(n)]


@pytest.mark.parametrize("seed", range(12))
def test_the_agenda_finds_the_least_of_all_edits(seed):
    draw = random.Random(seed)
    for n in (0, 1, 2, 3, 3):
        messages = given(draw, n)
        assert repair_whole([Message(x, 1, m, c) for x, m, c in messages]) == exhaustive(messages)


def test_pieces_compose_to_the_whole():
    draw = random.Random(5)
    for _ in range(60):
        messages = [Message(x, draw.choice([1, 1, 3]), m, c) for x, m, c in given(draw, 9)]
        best = {0: (0, "")}
        for at in range(0, 9, 2):
            table = repair_piece(messages[at : at + 2])
            ways = [
                (after, (w[0] + table[4 * s + after][0], w[1] + table[4 * s + after][1]))
                for s, w in best.items() for after in range(4) if table[4 * s + after]
            ]
            best = {a: min(w for b, w in ways if a == b) for a, _ in ways}
        whole = min((w[0] + INSERT * len(_CLOSING[s]), w[1] + _CLOSING[s]) for s, w in best.items())
        assert whole == repair_whole(messages)


def brute(table):
    """Rows of the audit from (conv_id, turn, role, text), messages one by one, the best edits by a plain table over states."""
    talks = {}
    for conv_id, turn, role, text in table:
        kept = talks.setdefault(conv_id, [])
        role, text = " " if role is None else role, " " if text is None else text
        name = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
        fault = zlib.crc32(name.encode()) % 20
        if fault == 1:
            text = ""
        if fault == 2:
            text = re.sub("[.!?]", "", text)
        if fault == 4:
            role = "user"
        kept += [(turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    out = []
    for conv_id, kept in talks.items():
        kept.sort(key=lambda m: (m[0] is not None, m[0] or 0, m[1].encode(), hashlib.md5(m[2].encode()).digest()))
        turns = {t for t, _, _ in kept if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        count = {"blank": 0, "duplicate": 0, "truncated": 0}
        seen, states = set(), {"": (0, "", ())}
        for _, role, text in kept:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = (
                "blank" if not bare else "duplicate" if (role, text) in seen
                else "truncated" if bare[-1] not in ".!?" else None
            )
            seen.add((role, text))
            if fault:
                count[fault] += 1
            new = []
            for end, (cost, audit, lines) in states.items():
                new.append((end, (cost + 4, audit + "D", lines)))
                if fault in ("blank", "duplicate"):
                    continue
                extra = 3 if fault else 0
                for inserted in ("", "user", "assistant"):
                    start = (end + inserted[:1], cost + 3 * bool(inserted), audit + "I" * bool(inserted))
                    begun = lines + ((f"{inserted}:",) if inserted else ())
                    for letter, now, more in (("K", role, 0), ("R", "user", 3), ("R", "assistant", 3)):
                        state = start[0] + now[:1]
                        if now and re.fullmatch("s?(ua)*u?", state):
                            state = state if len(state) < 3 else "ua" if state[-1] == "a" else "uau"
                            new.append((state, (start[1] + more + extra, start[2] + letter, (*begun, f"{now}:{text}"))))
            states = {s: min(w for t, w in new if t == s) for s, _ in new}
        ends = []
        for state, (cost, audit, lines) in states.items():
            for more in ((), ("user:",), ("assistant:",), ("user:", "assistant:")):
                if GOOD.fullmatch(state + "".join(m[0] for m in more)):
                    ends.append((cost + 3 * len(more), audit + "I" * len(more), lines + more))
        cost, audit, lines = min(ends)
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(kept, kept[1:])]
        illegal = sum(p not in ("su", "ua", "au") for p in pairs)
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv_id, gaps, *count.values(), illegal, cost, audit, sha))
    return sorted(out, key=repr)


def table(spark, given):
    return spark.createDataFrame(given, "conv_id bigint, turn bigint, role string, text string")


def audited(df, **options):
    return rows(audit_conversations(df, damaged(df), **options), *RESULT)


def talk(seed, conversations, most):
    draw = random.Random(seed)
    out = []
    for conv_id in range(conversations):
        for turn in range(draw.randrange(1, most)):
            if draw.random() < 0.9:
                text = draw.choice(["Yes.", "No", "  ", "", "What?\n ", "é水!", f"turn {turn}.", f"turn {turn}"])
                out.append((conv_id, turn, draw.choice(["user", "user", "assistant", "assistant", "system", "unknown", "tool"]), text))
    return out


ODD = [
    (None, 1, "user", "a."), (None, 2, "assistant", "b."), (None, None, None, None), (900, None, "user", None),
    (900, None, "user", "x."), (900, None, "assistant", "x."), (901, None, None, "x."), (902, -(2**40), "", "y."),
    (902, 2**40, "user", "y."), *[(903, 5, "user", "same.")] * 9, (904, 1, "system", "only."), (905, 0, "user", "."),
    (906, 3, "user", "w. " * 100_000), (906, 3, "assistant", "w " * 100_000), (907, 0, "User", "Hi."), (908, 0, "user", " \x0b. \x0c"),
    (908, 1, "assistant", " "),
]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    given = talk(seed, 60, 9) + ODD
    assert audited(table(spark, given)) == brute(given)


def test_long_conversations_in_pieces(spark):
    given = talk(3, 3, 120) + ODD + [(77, t, "user", f"{t}.") for t in range(40)] + [(78, 1, "user", "again.")] * 50
    found = audited(table(spark, given), piece=3)
    assert found == brute(given) == audited(table(spark, given))


def test_every_conversation_comes_back(spark):
    given = [(c, 0, "user", "Hello.") for c in range(60)]
    dropped = [c for c in range(60) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    found = {r[0]: r for r in audited(table(spark, given))}
    assert len(found) == 60 and dropped
    for c in dropped:
        assert found[c][1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_clashing_columns_and_order_of_arrival(spark):
    given = talk(4, 30, 9) + ODD
    df = clashing(table(spark, given)).withColumns({c: F.lit("x") for c in ("blank", "copies", "place", "audit", "first")})
    assert audited(df.repartition(5)) == brute(given)


def test_empty_table(spark):
    assert audited(table(spark, [])) == []


def test_repaired_messages(spark):
    given = [(1, 5, "assistant", "Hi."), (1, 7, "assistant", "There."), (1, 9, "user", ""), (2, 0, "system", "Be kind.")]
    repair = Repair(table(spark, given).withColumn("place", F.lit(1)))
    found = repair.repaired().orderBy("conv_id", "place").select("conv_id", "edit", "role", "text")
    assert [tuple(r) for r in found.collect()] == [(1, "R", "user", "Hi."), (1, "K", "assistant", "There.")]
    costs = repair.pieces.groupBy("conv_id").agg(F.sum("cost").alias("cost"))
    assert rows(costs, "conv_id", "cost") == [(1, 7), (2, 4)]


def test_applied_gives_the_roles():
    items = [{"role": r, "copies": c} for r, c in (("system", 1), ("assistant", 2), ("user", 1))]
    assert [(e, r) for e, r, _ in applied(items, "KIKDKI", 0)] == [
        ("K", "system"), ("I", "user"), ("K", "assistant"), ("K", "user"), ("I", "assistant"),
    ]


def test_arguments(spark):
    with pytest.raises(ValueError):
        Repair(table(spark, []), piece=0)
