"""Best-fit packing: an exact partition of all tokens, as tight as best-fit over the pieces."""

import random
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict

import pytest


def one_by_one(sizes, length):
    """Best-fit decreasing over single pieces: sorted fillings of all sequences."""
    rooms, filled, n = [], {}, 0
    for size in sorted(sizes, reverse=True):
        at = bisect_left(rooms, (size, -1))
        if at < len(rooms):
            room, k = rooms.pop(at)
        else:
            room, k, n = length, n, n + 1
            filled[k] = []
        filled[k].append(size)
        if room > size:
            insort(rooms, (room - size, k))
    return sorted(tuple(f) for f in filled.values())


@pytest.mark.parametrize("seed", range(8))
def test_plan_equals_best_fit_over_pieces(seed):
    from breezeframe.llm.bestfit import plan

    rnd = random.Random(seed)
    length = rnd.choice([7, 16, 60, 2048])
    kinds = rnd.sample(range(1, length + 1), min(length, rnd.randint(1, 40)))
    sizes = [rnd.choice(kinds) for _ in range(rnd.choice([1, 10, 300, 3000]))]
    runs, total = plan(Counter(sizes), length)
    sequences = defaultdict(list)
    for size, found in runs.items():
        ranks = []
        for first, until, per, sequence, offset in found:
            for rank in range(first, until):
                n = rank - first
                sequences[sequence + n // per].append((offset + n % per * size, size))
                ranks.append(rank)
        assert sorted(ranks) == list(range(sizes.count(size)))
    assert set(sequences) == set(range(total))
    for pieces in sequences.values():
        at = 0
        for offset, size in sorted(pieces):
            assert offset == at
            at += size
        assert at <= length
    # equally full sequences may swap their pieces; how full they are is the same
    assert sorted(sum(s for _, s in p) for p in sequences.values()) == sorted(map(sum, one_by_one(sizes, length)))


def test_plan_stays_small():
    from breezeframe.llm.bestfit import plan

    rnd = random.Random(1)
    histogram = {s: rnd.randint(0, 10**9) for s in range(1, 2049)}
    runs, total = plan(histogram, 2048)
    assert sum(map(len, runs.values())) < 20_000
    tokens = sum(s * n for s, n in histogram.items())
    assert total * 2048 < 1.01 * tokens + 2048


@pytest.fixture(scope="module")
def tokenizer():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


@pytest.mark.parametrize("length", [2048, 50])
def test_pieces(docs, texts, tokenizer, length):
    from tokenizers import Tokenizer

    from breezeframe.llm.bestfit import pack

    encode = Tokenizer.from_file(tokenizer).encode
    want = [encode(t or "", add_special_tokens=False).ids + [0] for t in texts]
    got = pack(docs, tokenizer, length=length).collect()
    documents, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        documents[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for key, rows in documents.items():
        if key is None:
            assert sum(r["length"] for r in rows) == len(want[2])
            continue
        copies = 2 if key == 1 else 1
        rows.sort(key=lambda r: r["start"])
        for n, r in enumerate(rows):
            piece = want[key][r["start"] : r["start"] + r["length"]]
            assert r["piece"] == n // copies and r["start"] == r["piece"] * length
            assert len(piece) == r["length"] and r["doc_tokens"] == len(want[key])
            assert r["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in piece))
        assert sum(r["length"] for r in rows) == copies * len(want[key])
    assert set(documents) == {*range(len(texts)), None} and set(sequences) == set(range(len(sequences)))
    for pieces in sequences.values():
        at = 0
        for offset, size in sorted(pieces):
            assert offset == at
            at += size
        assert at <= length
    assert len(sequences) == len(one_by_one([r["length"] for r in got], length))


def test_nothing(empty, tokenizer):
    from breezeframe.llm.bestfit import pack

    assert pack(empty, tokenizer).count() == 0


def test_tokens_equal_the_tokenizer_for_every_letter(tokenizer):
    """Every code point alone, inside a word and as upper and lower case; odd strings; files the
    short way does not know."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from breezeframe.llm.tokens import Encoder, Files

    plain = Tokenizer.from_file(tokenizer)
    probe = []
    for c in range(0x32400):
        if not 0xD800 <= c < 0xE000:
            probe += [chr(c), f"x{chr(c)}y", chr(c).upper() + chr(c).lower()]
    probe += ["<|endoftext|>", "a<|startoftext|>b c", "Əli MƏKTƏB Ɗ Ɓ Ɛ Ɣ", "ΣΑΣ İstanbul", "a\x1cb", "don't we'll 12.5 ''s \"'s 's's </w> 'RE",
              "x" * 100_000, "éte ́x", None, "", " \n", "word. " * 300_000]
    want = [e.ids for e in plain.encode_batch_fast([p or "" for p in probe], add_special_tokens=False)]
    encoder = Encoder(Files(tokenizer))
    assert [ids.tolist() for ids in encoder.encode(probe)] == want
    other = public_tokenizers.path("byte_bpe_50k.json")
    some = probe[::500] + ["Two  Words\n", "Əli"]
    want = [e.ids for e in Tokenizer.from_file(other).encode_batch_fast([p or "" for p in some], add_special_tokens=False)]
    assert [ids.tolist() for ids in Encoder(Files(other)).encode(some)] == want


def test_remembered_chunks_are_bounded(tokenizer, monkeypatch):
    from tokenizers import Tokenizer

    from breezeframe.llm import tokens

    monkeypatch.setattr(tokens, "REMEMBERED", 500)
    rnd = random.Random(4)
    texts = [" ".join("".join(rnd.choices("abcdefgh'.,1", k=rnd.randint(1, 6))) for _ in range(200)) for _ in range(60)]
    files = tokens.Files(tokenizer)
    encoder, plain = tokens.Encoder(files), Tokenizer.from_file(tokenizer)
    for text in texts * 2:
        assert encoder.encode([text])[0].tolist() == plain.encode(text, add_special_tokens=False).ids
        assert len(encoder.chunks) + len(encoder.older[0]) < 2000
