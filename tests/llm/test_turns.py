"""Conversation repair against a search over all edit sequences."""

import hashlib
import heapq
import random
import re

import pytest

from asclera.llm import turns

NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def brute(rows):
    """The report and the lines of one conversation: cheapest first, then by initials."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    seen, faults = set(), []
    for _, role, text in rows:
        signs = re.findall("[^\x20\x09-\x0d]", text)
        faults.append("blank" if not signs else "duplicate" if (role, text) in seen else "truncated" if signs[-1] not in ".!?" else "")
        seen.add((role, text))
    heap, done = [(0, "", 0, 0, ())], set()
    while True:
        cost, audit, i, state, out = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in (0, 3):
            break
        own = [(x, NEXT[state, x[0]]) for x in ("user", "assistant") if (state, x[0]) in NEXT]
        for x, to in own:
            heapq.heappush(heap, (cost + 2, audit + "I", i, to, (*out, x + ":")))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, out))
            if faults[i] not in ("blank", "duplicate"):
                more = faults[i] == "truncated"
                if (state, role[:1]) in NEXT:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, NEXT[state, role[:1]], (*out, f"{role}:{text}")))
                for x, to in own:
                    heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, to, (*out, f"{x}:{text}")))
    known = [t for t, _, _ in rows if t is not None]
    heads = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(heads, heads[1:]))
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit), "\n".join(out)


def table(spark, rows):
    kind = "conv_id bigint, turn bigint, role string, text string, conv string, part string, block string, audit string, cut string"
    return spark.createDataFrame([(*r, *"abcde") for r in rows], kind)


def check(spark, rows):
    found = turns.repair(table(spark, rows))
    got = {r.conv: tuple(r)[1:] for r in found.report.collect()}
    lines = {r.conv: r.repaired_sha256 for r in turns.digests(found.messages).collect()}
    for conv in {r[0] for r in rows}:
        report, text = brute([r[1:] for r in rows if r[0] == conv])
        assert got[conv] == report, conv
        assert lines.get(conv, hashlib.sha256(b"").hexdigest()) == hashlib.sha256(text.encode()).hexdigest()
    assert len(got) == len({r[0] for r in rows})


def some_rows(rnd, conv, many):
    words = ["Yes.", "No!", "cut off", "", " \n", None, "Was?", "x ", "Same. ", "end.\x0b"]
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant", "User"]
    return [(conv, rnd.choice([None, *range(many)]), rnd.choice(roles), rnd.choice(words)) for _ in range(many)]


def test_any_rows(spark):
    rnd = random.Random(3)
    rows = [r for conv in [None, *range(60)] for r in some_rows(rnd, conv, rnd.randint(1, 9))]
    check(spark, rows + rows[:5])


def test_a_long_conversation_is_split(spark, monkeypatch):
    monkeypatch.setattr(turns, "FIRST_BLOCK", 2)
    rnd = random.Random(4)
    check(spark, some_rows(rnd, 1, 400) + [(1, t, "user", f"Turn {t}.") for t in range(400, 700)] + some_rows(rnd, 2, 3))


def test_repeated_rows(spark):
    check(spark, [(1, 0, "user", "Hi.")] * 50 + [(1, 1, "assistant", "")] * 30 + [(1, 2, "assistant", "Yes.")])


def test_no_rows(spark):
    empty = table(spark, [])
    assert turns.repair(empty).report.count() == 0
    assert turns.contract(empty).count() == 0


def test_a_conversation_lost_to_damage_is_reported(spark):
    import zlib

    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    row = turns.contract(table(spark, [(conv, 0, "user", "Hi.")])).first()
    assert tuple(row) == (conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


@pytest.mark.parametrize("many", [1, 2, 40])
def test_matrix_and_walk_agree(many):
    rnd = random.Random(many)
    rows = [(rnd.choice("suax"), rnd.random() < 0.2, rnd.random() < 0.3, rnd.choice([0, 0, 2])) for _ in range(many)]
    m = turns.matrix(rows)
    costs = turns.END
    for row in reversed(rows):
        costs = turns.before(row, costs)
    assert costs == [min(m[4 * s + e] + turns.END[e] for e in range(4)) for s in range(4)]
