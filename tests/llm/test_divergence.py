"""The divergence audit against plain arithmetic, and its trees against dense matrices."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

FOLD = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def plainly(rows, least):
    """The contract over (text, lang, source) rows: {(lang, source, part): [(item, value)] by rank}."""
    n, df = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(FOLD))
        n[lang or "", source or ""].update(found)
        df[lang or ""].update(set(found))
    out = {}
    for lang in df:
        kept = [t for t, k in df[lang].items() if k >= least]
        mine = [s for g, s in n if g == lang]
        counts = {s: [n[lang, s][t] for t in kept] for s in mine}

        def shares(c):
            return [1 + 10**9 * (x + 2) // (sum(c) + 2 * len(kept)) for x in c]

        p = {s: shares(c) for s, c in counts.items()}
        q = shares([sum(c) for c in zip(*counts.values(), strict=True)])
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in mine:
            pairs = [(o, sum(map(f, p[s], p[o]))) for o in mine if o != s]
            terms = [(t, f(a, b)) for t, a, b, c in zip(kept, p[s], q, counts[s], strict=True) if c and a > b]
            for part, found, top in (("pair", pairs, None), ("term", terms, 10)):
                out[lang, s, part] = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:top]
    return out


def corpus():
    rnd = random.Random(8)
    vocab = ["".join(rnd.choices("abcdeé", k=rnd.randint(1, 4))) for _ in range(120)] + ["straße", "ÉCOLE", "日本"]
    rows = []
    for _ in range(260):
        lang, source = rnd.choice(["aa", "bb", None]), rnd.choice(["s1", "s2", "s3", "s4", "s5", "s6", "é", "z", None])
        words = rnd.choices(vocab[: rnd.choice([20, 60, 123])], k=rnd.randint(0, 50))
        rows.append((rnd.choice([" ", "1", "_", "\n"]).join(w.upper() if rnd.random() < 0.1 else w for w in words), lang, source))
    rows += [(None, "aa", "silent"), ("", "cc", "only"), ("one two", "cc", "x"), ("..", None, None)] + [rows[0]] * 5
    return rows


@pytest.mark.parametrize("side,levels,held,step", [(128, 7, 150_000, 1 << 22), (4, 2, 20, 16)])
def test_audit(spark, monkeypatch, side, levels, held, step):
    from breezeframe.llm import divergence

    for name, value in (("SIDE", side), ("LEVELS", levels), ("HELD", held), ("STEP", step)):
        monkeypatch.setattr(divergence, name, value)
    rows = corpus()
    schema = "text string, lang string, source string, term string, n int"
    df = spark.createDataFrame([(*r, "old", 3) for r in rows], schema).repartition(6)
    got = defaultdict(list)
    for r in sorted(divergence.audit(df, least_docs=4).collect(), key=lambda r: r["rank"]):
        found = got[r["lang"], r["source"], r["part"]]
        found.append((r["item"], r["value"]))
        assert r["rank"] == len(found)
    want = {k: v for k, v in plainly(rows, 4).items() if v}
    assert got == want
    assert any(k[0] == "cc" and v == [("x", 0)] for k, v in want.items())


def test_audit_of_nothing(spark):
    from breezeframe.llm.divergence import audit

    df = spark.createDataFrame([], "text string, lang string, source string")
    assert audit(df).count() == 0


@pytest.mark.parametrize("density", [0.01, 0.2, 0.9])
def test_trees_hold_and_join_cells(density):
    from breezeframe.llm.divergence import SIDE, Tree, common_cells, f, tile_sums

    rnd = np.random.default_rng(int(density * 100))
    dense = [np.where(rnd.random((SIDE, SIDE)) < density, rnd.integers(1, 10**9, (SIDE, SIDE)), 0) for _ in range(2)]
    trees = [Tree(*np.nonzero(d), d[d > 0]) for d in dense]
    i, j = common_cells(*trees)
    assert len(i) == sum(int(np.count_nonzero(dense[0][:, c])) * int(np.count_nonzero(dense[1][:, c])) for c in range(SIDE))
    zero = rnd.integers(1, 1000, SIDE)
    whole = np.where(dense[0] > 0, dense[0], zero[:, None])
    want = sum(f(whole[:, None, c], whole[None, :, c]) - f(zero[:, None], zero[None, :]) for c in range(SIDE))
    got = tile_sums(trees[0], zero, trees[0], zero, True)
    assert (np.triu(got + got.T, 1) == np.triu(want, 1)).all()
    assert sum(map(len, trees[0].bits)) < 4 * 2 * SIDE * SIDE
