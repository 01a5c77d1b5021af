"""Secret scan in DataFrame expressions only.

Base kinds are regular expressions whose matches are located by marking them inside the text
and measuring the pieces between the marks, so every position comes from native string
functions. The entropy kind looks at *candidates*: runs of ``CANDIDATE`` characters that mix
letters and digits, or upper and lower case. A window of ``width`` characters slides over a
candidate; the counts of its characters are kept, five bits each, and its Shannon entropy is
kept up to date by the two counts that change per step (the character that enters and the one
that leaves)::

    H = log2(width) - S / width,   S = sum over characters of n * log2(n)

S is held in whole 2^-40ths, so it does not drift however long the run. Patterns have no group
that Java's matcher would enter recursively: where groups repeat they do so possessively, which
reads the same strings. A text's pieces are walked in blocks, so that no array grows by one
element at a time for long.

Each character class has its own width and threshold. What lies under windows at or above the
threshold is a span, unless the candidate is on the allow list or a base span covers it.

Positions are code points, ends exclusive. Null text is empty and has no spans; other
columns pass; repeated rows are scanned alike. Nothing is shuffled, texts are read whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: fixed values: the base kinds in their order
ASSIGN = (
    r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
#: a run that fails its least length cannot hold a match that begins later in it, so for
#: these two kinds the length may stand in the pattern, and short runs are never marked
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "entropy")
#: cheap tests that hold for every text with a match
GUARDS = (
    r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{12}",
    r"AKIA[A-Z0-9]{14}",
    r"[0-9a-f]{16}",
)
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: per class: pattern of the whole candidate, window width, least entropy in bits
CLASSES = ((r"^[0-9A-Fa-f]+$", 16, 2.9), (r"^[A-Z0-9]+$", 16, 3.2), (r"^[a-z0-9]+$", 20, 3.6), (r"^[^0-9]+$", 20, 3.5),
           (r"", 20, 3.75))
#: a part that looks like words: one lower or upper run, or capitalised words of three letters up
_WORDS = r"[a-z]*+(?:[A-Z]++[a-z]{2,}+)*+[A-Z]*+"
#: UUIDs, repeated characters, plain words joined by separators
ALLOW = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^(.)\1+$",
    rf"^{_WORDS}(?:[-_/=+]{_WORDS})*+[0-9]{{0,4}}+$",
)
#: documented sample keys say so in the span itself; names before and after the key do not count
#: (the second pattern reads the text backwards: from its end no place is tried twice)
BEFORE, AFTER, SAMPLE = r"^(?:[A-Z]?[a-z_-]*+[/=])++", r"^(?:[a-z_-]*+[A-Z]?[/=])++", r"(?i)example"
MARK, STAND_IN = "\x00", "\x01"
#: pieces of a text that are walked together; even
BLOCK = 256


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often lambdas in it come back to it."""
    return F.transform(F.array(value), use)[0]


def _matches(text: Column, pattern: str, lowest: int, group: int = 0) -> Column:
    """array<struct<start,end,text>> of the leftmost non-overlapping matches; those whose
    ``group`` is shorter than ``lowest`` are dropped afterwards."""
    held = F.when(F.contains(text, F.lit(MARK)), F.translate(text, MARK, STAND_IN)).otherwise(text)
    marked = F.regexp_replace(held, F.lit(f"({pattern})"), F.lit(f"{MARK}$1{MARK}"))
    # the pieces alternate: between, match, between, ..., match, between; so do those of a block
    def blocks(pieces):
        count = F.ceil(F.size(pieces) / BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), count - 1), lambda b: F.slice(pieces, b * BLOCK + 1, F.lit(BLOCK)))

    def length(block):
        return F.aggregate(block, F.lit(0), lambda n, p: n + F.length(p))

    def begins(parts):
        return F.aggregate(
            parts, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")),
            lambda s, part: F.struct((s["at"] + length(part)).alias("at"), F.array_append(s["all"], s["at"]).alias("all")),
            lambda s: s["all"],
        )

    def walked(block, begin):
        return F.aggregate(
            block,
            F.struct(
                begin.alias("at"), F.lit(False).alias("hit"),
                F.array().cast("array<struct<start:int,end:int,text:string>>").alias("found"),
            ),
            lambda s, piece: F.struct(
                (s["at"] + F.length(piece)).alias("at"),
                (~s["hit"]).alias("hit"),
                F.when(
                    s["hit"],
                    F.array_append(s["found"], F.struct(
                        s["at"].alias("start"), (s["at"] + F.length(piece)).alias("end"), piece.alias("text")
                    )),
                ).otherwise(s["found"]).alias("found"),
            ),
            lambda s: s["found"],
        )

    parts = _once(F.split(marked, MARK), blocks)
    found = _once(parts, lambda p: F.flatten(F.zip_with(p, begins(p), walked)))
    tested = (lambda m: F.length(F.regexp_extract(m["text"], pattern, group)) >= lowest) if group else (
        lambda m: F.length(m["text"]) >= lowest
    )
    return F.filter(found, tested)


#: n * log2(n) for the counts of a window, in whole parts
PARTS = 1 << 40
N_LOG_N = [round(n * math.log2(n) * PARTS) if n else 0 for n in range(33)]
#: characters whose counts share one 64-bit word, five bits each
PER_WORD = 12
WORDS = -(-128 // PER_WORD)


def _hot_part(m: Column) -> Column:
    """struct(start, end) under the windows of enough entropy; start is null if there is none."""
    text = m["text"]

    def by_class(values):
        out = F.lit(values[-1])
        for (pattern, *_), v in reversed(list(zip(CLASSES[:-1], values[:-1], strict=True))):
            out = F.when(text.rlike(pattern), F.lit(v)).otherwise(out)
        return out

    limits = [round((math.log2(w) - least) * w * PARTS) for _, w, least in CLASSES]
    table = F.array(*[F.lit(x) for x in N_LOG_N])
    # places of the counts, and what the class asks for, once per run
    given = F.struct(
        F.transform(F.split(text, ""), lambda c: F.ascii(c)).alias("codes"),
        by_class([w for _, w, _ in CLASSES]).alias("width"), by_class(limits).alias("limit"),
    )

    def walked(g):
        codes, width = g["codes"], g["width"]

        def count(words, code):
            word = F.get(words, F.floor(code / PER_WORD).cast("int"))
            return F.call_function("shiftright", word, (code % PER_WORD) * 5).bitwiseAND(31).cast("int")

        def moved(words, code, by):
            at, one = F.floor(code / PER_WORD).cast("int"), F.call_function("shiftleft", F.lit(1).cast("bigint"), (code % PER_WORD) * 5)
            return F.transform(words, lambda w, k: F.when(k == at, w + one * by).otherwise(w))

        def step(s, i):
            leaves, full = F.get(codes, i - width), i >= width
            gone = count(s["words"], leaves)
            less = F.when(full, F.get(table, gone) - F.get(table, gone - 1)).otherwise(F.lit(0).cast("bigint"))
            rest = F.when(full, moved(s["words"], leaves, -1)).otherwise(s["words"])
            return F.struct(
                (s["s"] - less).alias("s"), rest.alias("words"), s["first"].alias("first"), s["last"].alias("last")
            )

        def entered(s, i):
            enters = F.get(codes, i)
            now = count(s["words"], enters)
            total = s["s"] + F.get(table, now + 1) - F.get(table, now)
            hot = (i + 1 >= width) & (total <= g["limit"])
            return F.struct(
                total.alias("s"), moved(s["words"], enters, 1).alias("words"),
                F.when(hot & s["first"].isNull(), i + 1 - width).otherwise(s["first"]).alias("first"),
                F.when(hot, i + 1).otherwise(s["last"]).alias("last"),
            )

        none = F.lit(None).cast("int")
        empty = F.struct(
            F.lit(0).cast("bigint").alias("s"), F.array_repeat(F.lit(0).cast("bigint"), WORDS).alias("words"),
            none.alias("first"), none.alias("last"),
        )
        # a step is two: one character leaves, one enters; the fold over one element names the first's result
        both = lambda s, i: F.aggregate(F.array(step(s, i)), s, lambda _, left: entered(left, i))
        return F.aggregate(
            F.sequence(F.lit(0), F.size(codes) - 1), empty, both,
            lambda s: F.struct((m["start"] + s["first"]).alias("start"), (m["start"] + s["last"]).alias("end")),
        )

    return _once(given, walked)


def _entropy_spans(text: Column) -> Column:
    def mixed(m):
        mix = m["text"].rlike("[A-Za-z]") & m["text"].rlike("[0-9]") | m["text"].rlike("[a-z]") & m["text"].rlike("[A-Z]")
        return mix & ~_any(m["text"], ALLOW)

    found = F.filter(_matches(text, CANDIDATE, 20), mixed)

    def scan(m):
        return F.struct(_hot_part(m).alias("span"), m["start"].alias("from"), m["text"].alias("text"))

    def kept(m):
        span = F.substring(m["text"], m["span"]["start"] - m["from"] + 1, m["span"]["end"] - m["span"]["start"])
        rest = F.regexp_replace(F.reverse(F.regexp_replace(span, BEFORE, "")), AFTER, "")
        return m["span"]["start"].isNotNull() & ~F.reverse(rest).rlike(SAMPLE)

    return F.transform(F.filter(F.transform(found, scan), kept), lambda m: m["span"])


def _any(text: Column, patterns) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | text.rlike(p)
    return out


NONE = "array<struct<start:int,rank:int,end:int>>"


def scan(docs: DataFrame, text_column: str = "text", name: str = "secret_spans") -> DataFrame:
    """``docs`` with the column ``name``: array of (start, rank of the kind in ``KINDS``, end),
    ordered."""
    text = F.coalesce(F.col(text_column), F.lit(""))

    def ranked(found, rank):
        return F.transform(found, lambda m: F.struct(
            m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end")
        ))

    nothing = F.array().cast(NONE)
    base = F.concat(*[
        F.when(text.rlike(guard), ranked(_matches(text, pattern, lowest, group), rank)).otherwise(nothing)
        for rank, (guard, (pattern, lowest, group)) in enumerate(
            zip(GUARDS, ((ASSIGN, 12, 1), (ACCESS, 18, 0), (HEX, 16, 0)), strict=True)
        )
    ])
    entropy = F.when(text.rlike(CANDIDATE), ranked(_entropy_spans(text), 3)).otherwise(nothing)
    out = docs.withColumn("__base", base).withColumn("__entropy", entropy)
    fresh = F.filter("__entropy", lambda e: ~F.exists(
        F.col("__base"), lambda b: (b["start"] <= e["start"]) & (b["end"] >= e["end"])
    ))
    return out.withColumn(name, F.array_sort(F.concat("__base", fresh))).drop("__base", "__entropy")


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(
            ":", F.element_at(kinds, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string")
        )),
        ",",
    )


def redact(docs: DataFrame, text_column: str = "text", filler: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span cut out of the text and ``filler`` in its place; overlapping
    spans are cut as one. Texts without a span stay as they are, null stays null."""
    text = F.col(text_column)
    cut = F.aggregate(
        "__spans",
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda s, m: F.struct(
            F.when(m["start"] >= s["at"], F.concat(
                s["out"], F.substring(text, s["at"] + 1, m["start"] - s["at"]), F.lit(filler)
            )).otherwise(s["out"]).alias("out"),
            F.greatest(s["at"], m["end"]).alias("at"),
        ),
        lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))),
    )
    out = scan(docs, text_column, "__spans")
    return out.withColumn(text_column, F.when(F.size("__spans") > 0, cut).otherwise(text)).drop("__spans")
