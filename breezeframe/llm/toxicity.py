"""Toxicity scores from a fuzzy lexicon and the context of its hits.

Lexicon: words whose document frequency differs between toxic and clean training rows, and
*stems*, word beginnings that many such words share. Terms form a trie.

Words are runs of letters and digits; typographic quotes, dashes and other marks beyond ASCII
separate them as ASCII marks do. Scripts that put no space between words give long words, in
which only stems are found.

Matching: for every distinct word of a block the Levenshtein automaton of distance one is
intersected with the trie. The automaton's state is the band of edit distances next to the
diagonal; the walk goes down the trie once and carries, at each node, the states of all words
still within reach, so words that cannot match fall away after two or three letters. Short
terms (below ``FUZZY_FROM`` letters) must match exactly, stems at the word's beginning.

Context: around each hit, ``CONTEXT`` words to either side are looked at. A hit between
quotation marks inside that window counts as quotation, others as abuse; further hits in the
window add to it. The score is a logistic model over those sums.

Fitting uses at most ``fit_rows`` labelled training rows, drawn by a hash of the id
(documented bound, default 12,000). The lexicon is bounded by ``max_terms``. Scoring shuffles
nothing and takes whole texts.

Defined results: null or empty text has no hits and gets the score of such a document; without
training rows of both classes all scores are 0; labels of absent documents are ignored;
repeated rows are scored alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breezeframe.llm.common import NON_ALNUM, blocks, map_texts, materialise, span_hashes, words

FUZZY_FROM, CONTEXT = 5, 6
SCHEMA = "score double, predicted int, n_hits bigint, n_quoted bigint, terms array<string>"
QUOTES = ("\"", "“", "”", "„", "«", "»")
EXACT, STEM, FUZZY = 1, 2, 3


class Trie:
    """Terms with their weights; stems match any continuation."""

    def __init__(self, terms: dict[str, float], stems: dict[str, float]):
        self.root: dict = {}
        for source, slot in ((terms, "term"), (stems, "stem")):
            for text, weight in source.items():
                node = self.root
                for letter in map(ord, text):
                    node = node.setdefault(letter, {})
                node[slot] = weight

    @property
    def depth(self) -> int:
        """Letters of the longest term or stem."""
        deepest, level = 0, [self.root]
        while level := [c for node in level for k, c in node.items() if isinstance(k, int)]:
            deepest += 1
        return deepest

    def match(self, found: np.ndarray, length: np.ndarray):
        """Best weight and kind of match per word; ``found`` holds code points, padded by 0, and may
        be cut after two letters more than the longest term has; ``length`` is the whole one."""
        weight, kind = np.zeros(len(found)), np.zeros(len(found), np.int8)
        if len(found):
            padded = np.concatenate([found, np.zeros((len(found), 3), found.dtype)], 1)
            band = np.tile(np.array([2, 0, 1], np.int8), (len(found), 1))
            everyone = np.arange(len(found))
            self._walk(self.root, 0, everyone, band, padded, length, weight, kind)
        return weight, kind

    def _walk(self, node, depth, who, band, found, length, weight, kind):
        for letter, child in node.items():
            if not isinstance(letter, int):
                continue
            # band holds the distances of the term so far to the word's first depth-1, depth
            # and depth+1 letters
            low = band[:, 0] + (found[who, depth - 1] != letter) if depth else np.full(len(who), 2, np.int8)
            low = np.minimum(low, band[:, 1] + 1)
            mid = np.minimum(band[:, 1] + (found[who, depth] != letter), np.minimum(band[:, 2], low) + 1)
            high = np.minimum(band[:, 2] + (found[who, depth + 1] != letter), mid + 1)
            alive = np.flatnonzero(np.minimum(np.minimum(low, mid), high) < 2)
            if not len(alive):
                continue
            new = np.stack([low[alive], mid[alive], high[alive]], 1).clip(max=2).astype(np.int8)
            left, d = who[alive], depth + 1
            if "stem" in child:
                self._put(left[(new[:, 1] == 0) & (length[left] >= d)], child["stem"], STEM, weight, kind)
            if "term" in child:
                gap = length[left] - d
                near = np.abs(gap) <= 1
                distance = np.full(len(left), 2)
                distance[near] = new[np.flatnonzero(near), gap[near] + 1]
                self._put(left[distance == 0], child["term"], EXACT, weight, kind)
                if d >= FUZZY_FROM:
                    self._put(left[distance == 1], child["term"], FUZZY, weight, kind)
            self._walk(child, d, left, new, found, length, weight, kind)

    @staticmethod
    def _put(who, value, how, weight, kind):
        better = (kind[who] == 0) | (how < kind[who]) | ((how == kind[who]) & (value > weight[who]))
        weight[who[better]], kind[who[better]] = value, how


@dataclass
class Model:
    terms: dict[str, float]
    stems: dict[str, float]
    weights: np.ndarray | None = None
    center: np.ndarray | None = None
    scale: np.ndarray | None = None


N_FEATURES = 7


def _matrix(texts: list[str], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points, as many as can matter, and whole lengths."""
    width = depth + 2
    length = np.array([len(t) for t in texts], np.int64)
    return np.array([t[:width] for t in texts], f"<U{width}").view(np.uint32).reshape(len(texts), width), length


def apart(buf: np.ndarray) -> np.ndarray:
    """``buf`` with the bytes of marks beyond ASCII as spaces: Latin-1 signs, general
    punctuation, CJK and full-width marks."""
    lead = np.flatnonzero((buf == 0xC2) | (buf == 0xE2) | (buf == 0xE3) | (buf == 0xEF))
    if not len(lead):
        return buf
    one, two = (buf[np.minimum(lead + k, len(buf) - 1)] for k in (1, 2))
    latin = (buf[lead] == 0xC2) & (one != 0xAA) & (one != 0xB5) & (one != 0xBA)
    general = (buf[lead] == 0xE2) & ((one == 0x80) | (one == 0x81) & (two < 0xB0))
    cjk = (buf[lead] == 0xE3) & (one == 0x80) & (two < 0x85)
    wide = (buf[lead] == 0xEF) & (one == 0xBC) & ((two < 0x90) | (two > 0x99) & (two < 0xA1))
    out = buf.copy()
    out[lead[latin]] = out[lead[latin] + 1] = 0x20
    three = lead[general | cjk | wide]
    out[three] = out[three + 1] = out[three + 2] = 0x20
    return out


def hits(trie: Trie, buf: np.ndarray, offsets: np.ndarray):
    """Per text the list of (weight, kind, quoted, others nearby, word)."""
    starts, ends, first = words(apart(buf), offsets, NON_ALNUM)
    out: list[list] = [[] for _ in range(len(offsets) - 1)]
    if not len(starts):
        return out, np.diff(first)
    h = span_hashes(buf, starts, ends, 51)
    _, sample, which = np.unique(h, return_index=True, return_inverse=True)
    data = buf.tobytes()
    spelled = [data[starts[i] : ends[i]].decode("utf-8", "replace").lower() for i in sample]
    matrix, length = _matrix(spelled, trie.depth)
    weight, kind = trie.match(matrix, length)
    hit = np.flatnonzero(kind[which])
    text = np.searchsorted(first, hit, "right") - 1
    for n, (w, t) in enumerate(zip(hit.tolist(), text.tolist(), strict=True)):
        lo, hi = max(int(first[t]), w - CONTEXT), min(int(first[t + 1]) - 1, w + CONTEXT)
        a = data[starts[lo] if lo > first[t] else offsets[t] : starts[w]].decode("utf-8", "replace")
        b = data[ends[w] : ends[hi] if hi < first[t + 1] - 1 else offsets[t + 1]].decode("utf-8", "replace")
        before, after = sum(map(a.count, QUOTES)), sum(map(b.count, QUOTES))
        near = int(np.searchsorted(hit, w + CONTEXT, "right") - np.searchsorted(hit, w - CONTEXT)) - 1
        u = which[hit[n]]
        out[t].append((float(weight[u]), int(kind[u]), before % 2 == 1 and after > 0, near, spelled[u]))
    return out, np.diff(first)


def features(found: list[tuple], n_words: int) -> list[float]:
    sums = [0.0] * N_FEATURES
    for weight, kind, quoted, near, _ in found:
        if quoted:
            sums[3] += weight
        else:
            sums[0 if kind != FUZZY else 1] += weight
            sums[2] += weight * min(near, 3)
            sums[4] = max(sums[4], weight if kind != FUZZY else 0.6 * weight)
    plain = sum(not q for _, _, q, _, _ in found)
    return [*np.log1p(sums[:4]).tolist(), sums[4], float(np.log1p(plain)), 100.0 * plain / max(n_words, 20)]


def _word_counts(sample: DataFrame) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            toxic = batch.column(1).to_pylist()
            for i, _, buf, offsets in blocks(batch.column(0)):
                starts, ends, first = words(apart(buf), offsets, NON_ALNUM)
                data = buf.tobytes()
                found, marks = [], []
                for t in range(len(offsets) - 1):
                    s = {
                        data[a:b].decode("utf-8", "replace").lower()
                        for a, b in zip(starts[first[t] : first[t + 1]], ends[first[t] : first[t + 1]], strict=True)
                    }
                    found += s
                    marks += [toxic[i + t]] * len(s)
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(marks, pa.int32())], ["word", "toxic"])

    pairs = sample.select("text", "toxic").mapInArrow(run, "word string, toxic int")
    return pairs.groupBy("word").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    is_training,
    fit_rows: int = 12_000,
    max_terms: int = 3000,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "toxic",
) -> Model:
    """``is_training`` makes the condition on an id column's name."""
    known = labels.where(is_training(id_column) & F.col(label_column).isNotNull() & F.col(id_column).isNotNull())
    known = known.groupBy(id_column).agg(F.max((F.col(label_column) > 0).cast("int")).alias("toxic"))
    total = known.count()
    draw = F.pmod(F.xxhash64(F.col(id_column), F.lit("fit")), F.lit(1 << 30)) < int(min(1, fit_rows / max(total, 1)) * (1 << 30))
    drawn = known.where(draw).limit(2 * fit_rows)  # at most so many ids: small enough to send
    sample = docs.select(id_column, F.col(text_column).alias("text")).join(F.broadcast(drawn), id_column)
    sample = materialise(sample.select("text", "toxic").where("text IS NOT NULL"), "toxicity-sample")
    sizes = dict(sample.groupBy("toxic").count().collect())
    if len(sizes) < 2:
        return Model({}, {})
    odds = F.log((F.col("bad") + 0.5) / (sizes[1] + 1)) - F.log((F.col("good") + 0.5) / (sizes[0] + 1))
    counts = materialise(_word_counts(sample).withColumn("odds", odds), "toxicity-words")
    # a word of a few copied documents is no evidence: a term must occur in 1 % of toxic rows
    chosen = counts.where(f"bad >= {max(3, sizes[1] // 100)} AND odds > 2.5").orderBy(F.desc("odds"), "word").limit(max_terms)
    terms = {r["word"]: r["odds"] for r in chosen.collect()}
    stems: dict[str, float] = {}
    for size in (4, 5, 6):
        heads = counts.where(F.length("word") > size).groupBy(F.substring("word", 1, size).alias("stem"))
        heads = heads.agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.count("*").alias("n"))
        strong = heads.withColumn("odds", odds).where("n >= 5 AND bad >= 20 AND odds > 3.5")
        for r in strong.orderBy(F.desc("odds"), "stem").limit(max_terms).collect():
            if not any(r["stem"].startswith(s) for s in stems):
                stems[r["stem"]] = r["odds"]
    model = Model(terms, stems)
    trie = Trie(terms, stems)

    def run(buf, offsets):
        import pyarrow as pa

        found, n = hits(trie, buf, offsets)
        return [pa.array([features(f, int(k)) for f, k in zip(found, n, strict=True)], pa.list_(pa.float64()))]

    got = map_texts(sample, "text", "x array<double>", run, ["toxic"]).toPandas()
    x, y = np.array(got["x"].tolist(), float), got["toxic"].to_numpy(float)
    model.center, model.scale = x.mean(0), x.std(0) + 1e-6
    z = np.concatenate([(x - model.center) / model.scale, np.ones((len(x), 1))], 1)
    w = np.zeros(z.shape[1])
    for _ in range(60):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        ridge = np.r_[np.full(len(w) - 1, 0.5), 1e-6]
        hessian = (z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge)
        w -= np.linalg.solve(hessian, z.T @ (p - y) + ridge * w)
    model.weights = w
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.3, text_column: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the columns of ``SCHEMA``."""
    trie = Trie(model.terms, model.stems)

    def run(buf, offsets):
        import pyarrow as pa

        found, n = hits(trie, buf, offsets)
        if model.weights is None:
            p = np.zeros(len(found))
        else:
            x = np.array([features(f, int(k)) for f, k in zip(found, n, strict=True)]).reshape(-1, N_FEATURES)
            z = (x - model.center) / model.scale @ model.weights[:-1] + model.weights[-1]
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return [
            pa.array(p), pa.array((p >= threshold).astype(np.int32)),
            pa.array([len(f) for f in found], pa.int64()), pa.array([sum(h[2] for h in f) for f in found], pa.int64()),
            pa.array([sorted({h[4] for h in f}) for f in found], pa.list_(pa.string())),
        ]

    return map_texts(docs, text_column, SCHEMA, run, keep)
