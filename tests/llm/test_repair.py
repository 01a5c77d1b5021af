"""Conversation repair against a plain search over whole edit strings."""

import hashlib
import random
import re
import zlib

import pytest

MOVES = {  # state: [(edit, needed initial, next state, price)]
    "": [("K", "s", "s", 0), ("K", "u", "u", 0), ("R", None, "u", 2)],
    "s": [("K", "u", "u", 0), ("R", None, "u", 2)],
    "u": [("K", "a", "a", 0), ("R", None, "a", 2)],
    "a": [("K", "u", "u", 0), ("R", None, "u", 2)],
}
AFTER = {"": "u", "s": "u", "u": "a", "a": "u"}


def plainly(rows):
    """rows of (initial, must_delete, cut): least (cost, audit) with no state ever dropped."""

    def closed(best):
        for _ in range(3):
            for p, (cost, audit) in list(best.items()):
                q, new = AFTER[p], (cost + 2, audit + "I")
                best[q] = min(best.get(q, new), new)
        return best

    best = closed({"": (0, "")})
    for initial, must_delete, cut in rows:
        new = {}
        for p, (cost, audit) in best.items():
            options = [("D", p, cost + 3)]
            if not must_delete:
                options += [(e, q, cost + price + cut) for e, need, q, price in MOVES[p] if need in (None, initial)]
            for e, q, c in options:
                new[q] = min(new.get(q, (c, audit + e)), (c, audit + e))
        best = closed(new)
    return min(best[p] for p in ("", "a") if p in best)


@pytest.mark.parametrize("settle", [1, 7, 512])
def test_search_equals_plain_search(monkeypatch, settle):
    from breezeframe.llm import repair

    monkeypatch.setattr(repair, "SETTLE", settle)
    rnd = random.Random(settle)
    for n in range(400):
        kinds = rnd.choice(["sua", "ua", "uax", "x", "u", "s", "aus"])
        rows = [(rnd.choice(kinds), rnd.random() < 0.15, rnd.random() < 0.3) for _ in range(rnd.randint(0, 40))]
        rows = [(i, d, c and not d) for i, d, c in rows]
        found = repair.Search()
        for row in rows:
            found.step(*row)
        assert found.end() == plainly(rows), rows


def test_unresolved_edits_stay_few_nodes_and_settle():
    from breezeframe.llm.repair import Search

    found = Search()
    for n in range(20_000):  # neither beginning ever wins before the end
        found.step("x", False, False)
    assert found.live < 3000 and not "".join(found.done)
    cost, audit = found.end()
    assert (cost, audit) == (40_000, "R" * 20_000)
    found = Search()
    for n in range(20_000):
        found.step("ua"[n % 2], False, False)
    assert len("".join(found.done)) > 19_000 and found.end() == (0, "K" * 20_000)


def whole(conversations):
    """The contract, in plain Python: what the query returns per conversation."""
    groups = {}
    for conv, turn, role, text in conversations:
        kept = groups.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv, rows in groups.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        seen, codes, counts = set(), [], [0, 0, 0]
        for _, role, text in rows:
            body = text.strip(" \t\n\x0b\f\r")
            fault = 0 if not body else 1 if (role, text) in seen else 2 if body[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            codes.append((role[:1], fault in (0, 1), fault == 2))
        turns = {t for t, _, _ in rows if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
        cost, audit = plainly(codes)
        left, repaired = iter(rows), []
        for e in audit:
            due = "assistant" if repaired and repaired[-1][0][:1] == "u" else "user"
            role, text = ("", "") if e == "I" else next(left)[1:]
            if e != "D":
                repaired.append((role if e == "K" else due, text))
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        out[conv] = (gaps, *counts, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha, repaired)
    return out


def test_whole_operator(spark):
    from breezeframe.llm.repair import COUNTS, all_conversations, apply_edits, damage, digests, find_edits

    rows = []
    rnd = random.Random(5)
    for c, t, r, x in _rows(rnd):
        rows.append((c, t, r, x, "old", 1))
    schema = "conv_id bigint, turn bigint, role string, text string, audit string, digest int"
    df = spark.createDataFrame(rows, schema).repartition(5)
    want = whole([r[:4] for r in rows])
    hurt = damage(df)
    edits = all_conversations(df, find_edits(hurt))
    got = digests(hurt, edits).collect()
    assert len(got) == len(want)
    for r in got:
        assert (*(r[c] for c in COUNTS), r["audit"], r["repaired_sha256"]) == want[r["conv"]][:8], r["conv"]
    repaired = {}
    for r in sorted(apply_edits(hurt, edits).collect(), key=lambda r: (r["conv"] is None, r["conv"] or 0, r["position"])):
        repaired.setdefault(r["conv"], []).append((r["role"], r["text"]))
    for conv, w in want.items():
        assert repaired.get(conv, []) == w[8]
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in w[8]))
    empty = spark.createDataFrame([], schema)
    assert digests(damage(empty), all_conversations(empty, find_edits(damage(empty)))).count() == 0


def _rows(rnd):
    roles = ["user", "assistant", "system", "tool", "", None, "User", "assistant", "user"]
    texts = ["Yes.", "No!", "what", "", "  \t", None, "a b c?\n", "Ünï.", "x" * 5000]
    for c in range(60):
        for t in range(rnd.randint(1, 14)):
            text = rnd.choice(texts) if rnd.random() < 0.4 else f"number {rnd.random()}" + rnd.choice([".", "?", "", " . \n"])
            yield c, None if rnd.random() < 0.05 else t + 3 * (t > 8), rnd.choice(roles), text
    yield from [(None, 0, "user", "Hi."), (None, 1, "assistant", "Hello."), (None, None, None, None)]
    yield from [(70, t // 3, "user", "same") for t in range(9)]
    yield from [(71, t, ("user", "assistant")[t % 2], f"line {t}.") for t in range(900)]
    yield from [(72, 5, "user", "twice.")] * 4
    yield from [(73, 3, "user", None), (74, 2**40, "assistant", "far."), (74, -5, "user", "near?")]
