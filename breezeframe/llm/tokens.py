"""Token ids of whole texts, faster than one tokenizer call per text and equal to it.

One tokenizer file is known here: it composes and lower-cases, drops white space and merges
nothing across it. With it a text's ids are the ids of its white-space-free chunks one after
the other, and most chunks occur again and again. :class:`Encoder` remembers chunks, and
merges the ones it has not seen many at a time by the file's own merge table, as arrays.
Chunks of Latin letters and printable ASCII skip the clean-up, which is plain for them; every
other chunk, long ones, and every text under any other normaliser or pre-tokenizer, take the
tokenizer's own call.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np

# ---- fixed values: the clean-up and the split that the short way reproduces ----
NORMALIZER = {
    "type": "Sequence",
    "normalizers": [
        {"type": "NFC"},
        {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
        {"type": "Lowercase"},
    ],
}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {
            "type": "Split",
            "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
            "behavior": "Removed",
            "invert": True,
        },
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
WORD_END = "</w>"
# ---- end of fixed values ----

#: split a Python string, but are no white space to the tokenizer
ODD_SPACE = re.compile("[\x1c-\x1f]")
SPACE = re.compile(r"\s")
#: what is neither printable ASCII nor a Latin letter with a plain lower case (or a line end)
HARD = re.compile("[^\n!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]")
END, MARK, LETTER, DIGIT = range(4)
KINDS = np.full(256, MARK, np.uint8)
KINDS[0x0A], KINDS[0x30:0x3A], KINDS[0x61:0x7B], KINDS[0x80:] = END, DIGIT, LETTER, LETTER
#: remembered chunks in each of two generations, and the longest one remembered
REMEMBERED, LONGEST = 200_000, 48
#: characters split at a time
SLICE = 1 << 20


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, spare = {b: chr(b) for b in shown}, iter(range(0x100, 0x200))
    return [letters[b] if b in letters else chr(next(spare)) for b in range(256)]


class Merges:
    """A merge table over many tokens at once: in every round each token's first pair of the
    lowest rank becomes one symbol."""

    NEVER = np.int32(2**31 - 1)

    def __init__(self, vocabulary: dict[str, int], merges: list):
        letters = byte_letters()
        self.inner = np.array([vocabulary[c] for c in letters], np.int64)
        self.last = np.array([vocabulary[c + WORD_END] for c in letters], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        keys = np.array([vocabulary[a] << 20 | vocabulary[b] for a, b in pairs], np.int64)
        into = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.into = keys[order], order.astype(np.int32), into
        # a spare entry that no pair equals
        self.keys = np.append(self.keys, np.int64(2**62))
        self.rank = np.append(self.rank, self.NEVER)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.rank[at], self.NEVER)

    def merge(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the tokens that begin at ``starts`` in ``data``, and how many each has."""
        ends = np.append(starts[1:], len(data))
        symbols = self.inner[data]
        symbols[ends - 1] = self.last[data[ends - 1]]
        token = np.repeat(np.arange(len(starts)), ends - starts)
        ranks = np.full(len(data), self.NEVER)
        ranks[:-1] = self.ranks(symbols[:-1], symbols[1:])
        ranks[ends - 1] = self.NEVER
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(starts):
            least = np.minimum.reduceat(ranks, starts)
            sizes = np.diff(starts, append=len(symbols))
            open_ = least < self.NEVER
            if not open_.all():
                stays = np.repeat(open_, sizes)
                done.append((token[~stays], symbols[~stays]))
                symbols, token, ranks = symbols[stays], token[stays], ranks[stays]
                least, sizes = least[open_], sizes[open_]
                if not len(least):
                    break
                starts = np.cumsum(sizes) - sizes
            hits = np.flatnonzero(ranks == np.repeat(least, sizes))
            whose = token[hits]
            first = np.ones(len(hits), bool)
            first[1:] = whose[1:] != whose[:-1]
            at = hits[first]  # one in every token that is still open
            symbols[at] = self.into[least]
            stays = np.ones(len(symbols), bool)
            stays[at + 1] = False
            last = at + 2 == starts + sizes
            symbols, token, ranks = symbols[stays], token[stays], ranks[stays]
            shift = np.arange(len(at))
            at, starts = at - shift, starts - shift
            ranks[at] = self.NEVER
            again = at[~last]
            ranks[again] = self.ranks(symbols[again], symbols[again + 1])
            again = at[at > starts] - 1
            ranks[again] = self.ranks(symbols[again], symbols[again + 1])
        owner = np.concatenate([t for t, _ in done])
        order = np.argsort(owner, kind="stable")
        return np.concatenate([x for _, x in done])[order], np.bincount(owner)


class Files:
    """What a tokenizer file says, loaded once per worker: the tokenizer, and its merge table if
    the short way is known to hold for it."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        said = json.loads(self.tokenizer.to_str())
        model, added = said["model"], [t["content"] for t in said["added_tokens"]]
        self.size = self.tokenizer.get_vocab_size()
        self.added = re.compile("|".join(map(re.escape, added)) or "(?!)")
        self.known = (
            said["normalizer"] == NORMALIZER and said["pre_tokenizer"] == PRE_TOKENIZER
            and model["type"] == "BPE" and model["end_of_word_suffix"] == WORD_END
            and not model["dropout"] and not model["ignore_merges"] and not any(map(SPACE.search, added))
            # every byte can end a word and stand inside one: nothing is dropped
            and all(c in model["vocab"] and c + WORD_END in model["vocab"] for c in byte_letters())
        )
        if self.known:
            self.merges = Merges(model["vocab"], model["merges"])


class Table:
    """Rows of ids by number, in one array that doubles."""

    def __init__(self, kind: np.dtype):
        self.ids, self.used = np.zeros(1 << 16, kind), 0
        self.starts, self.sizes = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def put(self, rows: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        while len(self.ids) < self.used + len(ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        while len(self.starts) <= rows.max(initial=0):
            self.starts, self.sizes = (np.resize(x, 2 * len(x)) for x in (self.starts, self.sizes))
        self.ids[self.used : self.used + len(ids)] = ids
        self.starts[rows] = self.used + np.cumsum(sizes) - sizes
        self.sizes[rows] = sizes
        self.used += len(ids)

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of ``rows`` end to end, and how many each has."""
        sizes = self.sizes[rows]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[rows] - ends + sizes, sizes)
        return self.ids[at], sizes


class Chunks(dict):
    """Chunk to its row of the table; a chunk not seen before gets the next number and is
    ``pending`` until its ids are known."""

    def __init__(self):
        self.next, self.pending = 0, []

    def __missing__(self, chunk):
        self[chunk] = row = self.next
        self.next += 1
        self.pending.append(chunk)
        return row


class Encoder:
    """Ids of texts. Make one per task: what it remembers goes with it."""

    def __init__(self, files: Files):
        self.files = files
        self.kind = np.dtype("<u2") if files.size < 65536 else np.dtype("<u4")
        self.chunks, self.table = Chunks(), Table(self.kind)
        self.older: tuple = ({}, None)

    def _plain(self, text: str) -> np.ndarray:
        return np.array(self.files.tokenizer.encode(text, add_special_tokens=False).ids, self.kind)

    def _hard(self, chunks: list[str], joined: str) -> np.ndarray:
        """Whether a chunk takes the long way; ``joined`` has a line end behind each."""
        ends = np.cumsum([len(c) + 1 for c in chunks])
        out = np.diff(ends, prepend=0) > LONGEST + 1
        odd = [m.start() for m in HARD.finditer(joined)]
        if self.files.added.search(joined):
            odd += [m.start() for m in self.files.added.finditer(joined)]
        out[np.searchsorted(ends, odd, "right")] = True
        return out

    def _learn(self, chunks: list[str], rows: np.ndarray) -> None:
        """Ids of new chunks into the table."""
        joined = "\n".join(chunks) + "\n"
        hard = self._hard(chunks, joined)
        if hard.any():
            plain = [self._plain(chunks[n]) for n in np.flatnonzero(hard)]
            self.table.put(rows[hard], np.concatenate(plain), np.array([len(p) for p in plain]))
            joined = "\n".join([chunks[n] for n in np.flatnonzero(~hard)]) + "\n"
        if not hard.all():
            self.table.put(rows[~hard], *self._merged(joined))

    def _merged(self, joined: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks of printable ASCII and Latin letters, each with a line end, and how many
        each has."""
        data = np.frombuffer(joined.lower().encode(), np.uint8)
        kind = KINDS[data]
        begins = np.ones(len(data), bool)
        begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        # an apostrophe that opens a run of marks takes the letters of a contraction with it
        marks = np.flatnonzero((data == 0x27) & begins)
        near = data[np.minimum(marks[:, None] + [1, 2], len(data) - 1)]
        pairs = near[:, 0].astype(np.int64) << 8 | near[:, 1]
        long = np.isin(pairs, [ord(a) << 8 | ord(b) for a, b in ("re", "ve", "ll")])
        short = np.isin(near[:, 0], [ord(c) for c in "stmd"])
        begins[marks[long | short] + 1] = False
        for which, width in ((short, 2), (long, 3)):
            begins[marks[which] + width] = True
        starts = np.flatnonzero(begins & (kind != END))
        ends = np.flatnonzero(kind == END)
        kept = starts - np.searchsorted(ends, starts)  # as they lie without line ends
        ids, sizes = self.files.merges.merge(data[kind != END], kept)
        total = np.append(0, np.cumsum(sizes))[np.searchsorted(starts, ends)]
        return ids.astype(self.kind), np.diff(total, prepend=0)

    def _slice(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.chunks) > REMEMBERED:
            self.older = (self.chunks, self.table)
            self.chunks, self.table = Chunks(), Table(self.kind)
        split = [t.split() for t in texts]
        rows = np.fromiter(map(self.chunks.__getitem__, chain.from_iterable(split)), np.int64, sum(map(len, split)))
        pending, self.chunks.pending = self.chunks.pending, []
        if pending:
            new = np.arange(self.chunks.next - len(pending), self.chunks.next)
            if self.older[0]:
                before = np.array([self.older[0].get(c, -1) for c in pending])
                self.table.put(new[before >= 0], *self.older[1].take(before[before >= 0]))
                pending, new = [pending[n] for n in np.flatnonzero(before < 0)], new[before < 0]
            if pending:
                self._learn(pending, new)
        ids, sizes = self.table.take(rows)
        for chunk in pending:
            if len(chunk) > LONGEST:
                del self.chunks[chunk]
        stops = np.append(0, np.cumsum(sizes))[np.cumsum([len(c) for c in split])].tolist()
        return [ids[a:b] for a, b in zip([0, *stops], stops, strict=False)]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; null is empty."""
        out: list = [None] * len(texts)
        held, size = [], 0

        def flush():
            nonlocal held, size
            for (n, _), ids in zip(held, self._slice([t for _, t in held]) if held else [], strict=True):
                out[n] = ids if out[n] is None else np.concatenate([out[n], ids])
            held, size = [], 0

        for n, text in enumerate(texts):
            text = text or ""
            if not self.files.known or ODD_SPACE.search(text):
                out[n] = self._plain(text)
                continue
            at = 0
            while len(text) - at > SLICE:  # cut where white space lets it
                space = SPACE.search(text, at + SLICE)
                stop = space.start() if space else len(text)
                held.append((n, text[at:stop]))
                flush()
                at = stop
            held.append((n, text[at:] if at else text))
            size += len(text) - at
            if size > SLICE // 4:
                flush()
        flush()
        return out
