"""Language identification by error-correcting output codes.

Every language has a binary code word. For each bit a logistic classifier over hashed byte
n-grams predicts that bit; decoding adds up, per language, the logistic loss of the bit
margins against the language's word, each bit weighted by how reliable its classifier was,
and takes the language of least loss. Up to five languages use all distinct splits
(``2**(k-1) - 1`` bits), more use the best of seeded random words.

Fitting: labels are read from training rows only; the classifiers are fitted on at most
``fit_rows`` of them, drawn by a hash of the id (documented bound, default 6,000), and the
learned languages are those of all training rows. The model is a table of ``BUCKETS`` weights
per bit, a fixed size, and travels inside the scoring function.

Defined results: null text, or text without a letter, gives ``und`` with score 0; so does
every text when there is no training row; other columns of the input pass by untouched or are
ignored; repeated rows are scored alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breezeframe.llm.common import blocks, map_texts

BUCKETS = 4096
SCHEMA = "lang_pred string, score double, margin double, ambiguous boolean"
#: margin of loss per bit below which the two best languages are not told apart
AMBIGUOUS = 0.05


@dataclass
class Model:
    languages: list[str]
    words: np.ndarray  # languages x bits, -1 or 1
    weights: np.ndarray  # buckets x bits
    bias: np.ndarray
    trust: np.ndarray  # per bit, sums to 1


def code_words(k: int, seed: int = 5) -> np.ndarray:
    """One row of -1/1 per language."""
    if k <= 1:
        return np.ones((k, 1))
    if k <= 5:
        bits = [[1] + [1 if (n >> i) & 1 else -1 for i in range(k - 1)] for n in range(2 ** (k - 1) - 1)]
        return np.array(bits, float).T
    size, best, least = int(np.ceil(10 * np.log2(k))), None, -1
    draw = np.random.Generator(np.random.PCG64(seed))
    for _ in range(200):
        words = draw.choice([-1.0, 1.0], (k, size))
        both = (words != words[0]).any(0)
        apart = ((words[:, None] != words[None]).sum(2) + size * np.eye(k)).min()
        if both.all() and apart > least:
            best, least = words, apart
    return best if best is not None else words


def _fold() -> np.ndarray:
    fold = np.arange(256, dtype=np.uint8)
    fold[0x41:0x5B] += 32
    letters = np.zeros(256, bool)
    letters[0x61:0x7B] = letters[0x41:0x5B] = letters[0x80:] = True
    fold[~letters] = 0x20
    return fold


def histograms(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Square roots of the n-gram shares of every text: rows have length 1, or 0 if empty."""
    n = len(offsets) - 1
    out = np.zeros((n, BUCKETS), np.float32)
    b = _fold()[buf].astype(np.uint32)
    if len(b) < 3:
        return out
    gram = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    gram = (gram * np.uint32(0x9E3779B1)) >> np.uint32(20)
    lengths = np.diff(offsets)
    row = np.repeat(np.arange(n, dtype=np.int64), lengths)[: len(gram)]
    inside = np.ones(len(buf), bool)
    for back in (1, 2):  # grams do not cross texts
        at = offsets[1:] - back
        inside[at[at >= 0]] = False
    inside = inside[: len(gram)]
    flat = (row * BUCKETS + gram)[inside]
    counts = np.bincount(flat, minlength=n * BUCKETS).reshape(n, BUCKETS)
    total = counts.sum(1, keepdims=True)
    return np.sqrt(counts / np.maximum(total, 1)).astype(np.float32)


def fit(
    docs: DataFrame,
    is_training: F.Column,
    fit_rows: int = 6000,
    text_column: str = "text",
    label_column: str = "lang",
    id_column: str = "doc_id",
) -> Model:
    """Learn from the rows where ``is_training`` holds and the label is known."""
    labelled = docs.where(is_training & F.col(label_column).isNotNull())
    totals = labelled.groupBy(F.col(label_column).alias("lang")).count().orderBy("lang").collect()
    languages = [r["lang"] for r in totals]
    if not languages:
        return Model([], np.zeros((0, 1)), np.zeros((BUCKETS, 1)), np.zeros(1), np.ones(1))
    share = fit_rows / sum(r["count"] for r in totals)
    draw = F.pmod(F.xxhash64(F.col(id_column), F.lit("fit")), F.lit(1 << 30)) < int(share * (1 << 30))
    sample = labelled.where(draw & F.col(text_column).isNotNull()).select(
        F.col(text_column).alias("text"), F.col(label_column).alias("lang")
    )

    def features(batches):
        import pyarrow as pa

        for batch in batches:
            langs = batch.column(1).to_pylist()
            for i, j, buf, offsets in blocks(batch.column(0)):
                rows = histograms(buf, offsets).astype(np.float16)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(langs[i:j], pa.string()), pa.array([r.tobytes() for r in rows], pa.binary())],
                    ["lang", "x"],
                )

    got = sample.mapInArrow(features, "lang string, x binary").limit(2 * fit_rows).toPandas()
    words = code_words(len(languages))
    if got.empty or len(languages) == 1:
        bits = words.shape[1]
        return Model(languages, words, np.zeros((BUCKETS, bits)), np.zeros(bits), np.full(bits, 1 / bits))
    x = np.frombuffer(b"".join(got["x"]), np.float16).reshape(len(got), BUCKETS).astype(np.float32)
    truth = words[np.searchsorted(languages, got["lang"])]
    return Model(languages, words, *_logistic(x, truth))


def _logistic(x: np.ndarray, truth: np.ndarray, steps: int = 250, rate: float = 8.0, shrink: float = 1e-5):
    """All bits at once by gradient descent with momentum; trust is the held-in accuracy."""
    w, bias = np.zeros((x.shape[1], truth.shape[1]), np.float32), np.zeros(truth.shape[1], np.float32)
    speed = np.zeros_like(w)
    truth = truth.astype(np.float32)
    for _ in range(steps):
        pull = -truth / (1 + np.exp(truth * (x @ w + bias)))
        speed = 0.9 * speed - rate * 0.1 * (x.T @ pull / len(x) + shrink * w)
        w += speed
        bias -= 0.5 * pull.mean(0)
    right = ((x @ w + bias) * truth > 0).mean(0)
    trust = np.maximum(right - 0.5, 1e-3)
    return w, bias, trust / trust.sum()


def decode(model: Model, margins: np.ndarray):
    """Best language, its share and the loss per bit by which it beats the next."""
    n, k = len(margins), len(model.languages)
    loss = np.stack([np.logaddexp(0, -margins * w) @ model.trust for w in model.words], 1)
    order = np.argsort(loss, 1, kind="stable")
    best = order[:, 0]
    rows = np.arange(n)
    gap = loss[rows, order[:, 1]] - loss[rows, best] if k > 1 else np.full(n, np.inf)
    share = np.exp(-model.words.shape[1] * (loss - loss[rows, best][:, None]))
    return best, 1 / share.sum(1), gap


def has_letter(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text holds a letter of any script."""
    ascii_letter = np.zeros(256, np.int64)
    ascii_letter[0x41:0x5B] = ascii_letter[0x61:0x7B] = 1
    seen = np.concatenate([[0], np.cumsum(ascii_letter[buf])])
    found = seen[offsets[1:]] > seen[offsets[:-1]]
    for i in np.flatnonzero(~found & (np.diff(offsets) > 0)):
        found[i] = any(map(str.isalpha, buf[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")))
    return found


def identify(docs: DataFrame, model: Model, text_column: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``lang_pred, score, margin, ambiguous`` added (a column of such a name is
    replaced). The text is the only input."""

    def run(buf, offsets):
        import pyarrow as pa

        spoken = has_letter(buf, offsets)
        n = len(spoken)
        if model.languages:
            best, share, gap = decode(model, histograms(buf, offsets) @ model.weights + model.bias)
            langs = [model.languages[b] if s else "und" for b, s in zip(best, spoken, strict=True)]
            share, gap = np.where(spoken, share, 0.0), np.where(spoken, gap, 0.0)
        else:
            langs, share, gap = ["und"] * n, np.zeros(n), np.zeros(n)
        return [pa.array(langs, pa.string()), pa.array(share), pa.array(gap), pa.array(gap < AMBIGUOUS)]

    return map_texts(docs, text_column, SCHEMA, run, keep)
