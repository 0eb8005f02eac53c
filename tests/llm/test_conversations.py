"""Conversation repair against an enumeration of all edits, and against damage and digests in plain Python."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from recordloom.llm import conversation_repair as repair

SCHEMA = "conv_id long, turn long, role string, text string, conv string, pos string, letter string"
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def frame(spark, rows):
    """Rows with extra columns whose names the operator uses inside."""
    return spark.createDataFrame([(*r, "x", None, "y") for r in rows], SCHEMA)


def faults(rows):
    """(role, text) in order -> the first fault of each."""
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def initials(turns):
    return "".join(r[:1] or "!" for r, _ in turns)


def cheapest(rows, prune=False):
    """(cost, audit, repaired) of the cheapest edits by trying all that cost no more than to delete every turn.

    With ``prune``, for longer conversations, of the edits that leave the same kind of order only the least goes on.
    """
    found = faults(rows)
    ways = [(0, "", [])]
    for i in range(len(rows) + 1):
        for _ in range(3):  # inserts, one after another
            more = [(c + 3, e + "I", [*t, (r, "")]) for c, e, t in ways for r in ("user", "assistant")]
            ways += [w for w in more if w[0] <= 4 * len(rows) and re.fullmatch("(s?(ua)*u?)?", initials(w[2])) and w not in ways]
        if i == len(rows):
            break
        role, text = rows[i]
        late = 3 * (found[i] == "truncated")
        options = [(4, "D", [])]
        if found[i] in ("", "truncated"):
            options += [(late, "K", [(role, text)]), *((3 + late, "R", [(r, text)]) for r in ("user", "assistant"))]
        ways = [(c + d, e + f, t + u) for (c, e, t), (d, f, u) in itertools.product(ways, options)]
        ways = [w for w in ways if w[0] <= 4 * len(rows) and re.fullmatch("(s?(ua)*u?)?", initials(w[2]))]
        if prune:
            kinds = {}
            for w in ways:
                kinds.setdefault((initials(w[2])[-1:], len(w[2]) > 0), []).append(w)
            ways = [min(v, key=lambda w: w[:2]) for v in kinds.values()]
    return min((w for w in ways if re.fullmatch("(s?(ua)+)?", initials(w[2]))), key=lambda w: w[:2])


def plain(rows, prune=False):
    """The report of one conversation's rows (turn, role, text), which are in order."""
    pairs = [(r, t) for _, r, t in rows]
    turns = [t for t, _, _ in rows if t is not None]
    kinds = faults(pairs)
    cost, audit, repaired = cheapest(pairs, prune)
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, "blank": kinds.count("blank"), "duplicate": kinds.count("duplicate"),
        "truncated": kinds.count("truncated"), "illegal": sum(a[:1] + b[:1] not in ("su", "ua", "au") for (a, _), (b, _) in zip(pairs, pairs[1:])),
        "cost": cost, "audit": audit,
    }, [f"{r}:{t}" for r, t in repaired]


def order(row):
    return (row[0] is not None, row[0] or 0, row[1], row[2])


def test_audits_are_the_cheapest(spark):
    rng = random.Random(3)
    roles = ["user", "assistant", "system", "tool", " ", "", "unicorn", "Ärzte"]
    texts = ["Yes.", "No", "what? ", "", " \t", "…", "Yes.", "x!\r\n"]
    rows = []
    for conv in range(220):
        for _ in range(rng.randrange(1, 5)):
            rows.append((conv if conv else None, rng.choice([None, 0, 1, 2, 5]), rng.choice(roles[:3] if conv % 2 else roles), rng.choice(texts)))
    report, repaired = repair.repair(frame(spark, rows))
    found = {r["conv_id"]: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in report.collect()}
    lines: dict = {}
    for r in sorted(repaired.collect(), key=lambda r: (r["pos"], r["nth"])):
        lines.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    digests = {r["conv_id"]: r["repaired_sha256"] for r in repair.digests(repaired).collect()}
    assert len(found) == 220
    for conv in found:
        mine = sorted(((t, r, x) for c, t, r, x in rows if c == conv), key=order)
        expected, text = plain(mine)
        assert (found[conv], lines.get(conv, [])) == (expected, text), mine
        assert digests.get(conv) == (hashlib.sha256("\n".join(text).encode()).hexdigest() if text else None)


def test_damage_and_digests_of_odd_rows(spark):
    texts = ["Ends well.", "Is cut", None, "", "日本語。", "a.b!c?", "x" * 50000 + "."]
    rows = [(c, t, r, x) for c, t, r, x in zip(
        [None, *range(60)] * 7, [*range(8), None] * 50, itertools.cycle(["user", "assistant", None, "system", "assistant"]), itertools.cycle(texts), strict=False
    )]
    # whatever turn they have, these are all dropped
    gone = next(c for c in range(1000, 9000) if all(zlib.crc32(f"{c}:{t}".encode()) % 20 == 0 for t in (1,)))
    rows.append((gone, 1, "user", "Hello."))
    expected = {}
    for conv in {r[0] for r in rows}:
        mine = []
        for c, t, r, x in rows:
            if c == conv:
                h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
                r, x = " " if r is None else r, " " if x is None else x
                x = "" if h == 1 else re.sub("[.!?]", "", x) if h == 2 else x
                mine += [] if h == 0 else [(t, "user" if h == 4 else r, x)] * (2 if h == 3 else 1)
        report, text = plain(sorted(mine, key=order), prune=True) if mine else (dict.fromkeys(["gaps", "blank", "duplicate", "truncated", "illegal", "cost"], 0) | {"audit": ""}, [])
        expected[conv] = report | {"conv_id": conv, "repaired_sha256": hashlib.sha256("\n".join(text).encode()).hexdigest()}
    found = {r["conv_id"]: r.asDict() for r in repair.damaged_and_repaired(frame(spark, rows).repartition(5)).collect()}
    assert found == expected and found[gone]["audit"] == ""
    empty = frame(spark, rows).limit(0)
    assert repair.damaged_and_repaired(empty).collect() == []


def test_one_long_conversation(spark, monkeypatch):
    """Pieces, tasks and a third of the rows in one conversation, half of which is one repeated turn."""
    monkeypatch.setattr(repair, "PIECE", 50)
    long = [(1, i, "user" if i % 2 == 0 else "assistant", "Again." if i % 4 < 2 else f"Turn {i}.") for i in range(3000)]
    others = [(c, i, "user" if i % 2 == 0 else "assistant", "Fine.") for c in range(2, 1002) for i in range(6)]
    report, repaired = repair.repair(frame(spark, long + others).repartition(7))
    found = {r["conv_id"]: r for r in report.collect()}
    # the first two stay; of the others every second pair is repeated and goes
    assert found[1]["audit"] == "KK" + "".join("KKDD" for _ in range(749)) + "KK" and found[1]["duplicate"] == 1498 and found[1]["cost"] == 4 * 1498
    assert {found[c]["audit"] for c in range(2, 1002)} == {"KKDDDD"} and len(found) == 1001
    ends = [f"{r}:{x}" for _, _, r, x in long if not (x == "Again." and _ > 1)]
    digest = {r["conv_id"]: r["repaired_sha256"] for r in repair.digests(repaired).collect()}
    assert digest[1] == hashlib.sha256("\n".join(ends).encode()).hexdigest()


@pytest.mark.parametrize("letters", ["", "A", "BB", "EIEI" * 500])
def test_search_of_any_length(letters):
    cost, codes = repair.Search().audit(letters)
    assert len(codes) == len(letters) + 1 and cost >= 0
