"""Source divergence audit: how far the word use of each source lies from its language's other
sources, and which terms set it apart.

Per language, the counts of kept terms form a matrix of groups (language and source) by terms.
It is cut into tiles of at most ``SIDE`` groups and ``SIDE`` terms; terms of like document
frequency share a tile, so that rare ones leave whole quadrants empty. Each tile is a K-squared
tree with K = 2: per level a bit for each quadrant of the quadrants that are not all zero, in
Morton order, and the cells' probabilities at the leaves. An all-zero quadrant is uniform: all
its cells have their group's probability of an unseen term. So, with f(p, q) the divergence
and 0 marking that probability, the sum over all V terms of a pair of groups (g, h) is ::

    V f(g0, h0)                                   as if both had no term at all
    + sum over cells of g: f(g, h0) - f(g0, h0)   h all zero, priced per row of the tile
    + sum over cells of h: f(g0, h) - f(g0, h0)
    + sum over cells of both: f(g, h) - f(g, h0) - f(g0, h) + f(g0, h0)

and only the last line needs the two groups' cells together. For it the trees of two tiles of
the same terms are walked jointly from their roots, for all pairs of their groups at once:
a pair of quadrants goes on only where both have their bit, child numbers are ranks in the
bit rows, and the leaves reached are the cells of both. All arithmetic is on integers.

Shuffles: term counts once, by (language, term), after each task has summed them over its
texts; tiles twice; sums of pairs, which each task adds up first. No group of rows is more
than a tile's cells or a term's sources; the ten first terms of a group are cut down per task
before they are ranked. The result holds a row for every ordered pair of a language's sources.

Defined results: null text, language and source are empty strings; a language without kept
terms has pair values 0 and no term rows; rows that repeat count as often as they occur;
texts of any length are counted whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from breezeframe.llm.common import materialise

SIDE, LEVELS = 128, 7
#: (group, term) entries a task adds up before it hands them on, and bytes of a text per step
HELD, STEP = 150_000, 1 << 22
SCALE = 1_000_000_000
#: lower-cases A-Z and turns every other ASCII byte that is no letter into a space
FOLD = bytes(
    b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)
COUNTS = "lang string, source string, term string, n bigint, docs bigint"


def count_terms(docs: DataFrame) -> DataFrame:
    """Occurrences and documents of each term by language and source, summed per task."""

    def tables(held):
        import pyarrow as pa

        for (lang, source), (n, seen) in held.items():
            terms, counts, found = list(n), list(n.values()), [seen[t] for t in n]
            for i in range(0, len(terms), 20_000):
                part = terms[i : i + 20_000]
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * len(part)), pa.array([source] * len(part)), pa.array(part, pa.binary()).cast(pa.string()),
                    pa.array(counts[i : i + 20_000], pa.int64()), pa.array(found[i : i + 20_000], pa.int64()),
                ], ["lang", "source", "term", "n", "docs"])

    def run(batches):
        held: dict[tuple, tuple[Counter, Counter]] = {}
        size = 0
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in (0, 1)]
            for row, key in enumerate(zip(*columns, strict=True)):
                data = batch.column(2)[row].as_buffer()
                data = data.to_pybytes().translate(FOLD) if data else b""
                n, seen = held.setdefault(key, (Counter(), Counter()))
                before, at, distinct = len(n), 0, set()
                while at < len(data):
                    stop = data.find(b" ", at + STEP) if len(data) - at > STEP else -1
                    stop = len(data) if stop < 0 else stop
                    words = data[at:stop].split()
                    n.update(words)
                    distinct.update(words)
                    at = stop
                seen.update(distinct)
                size += len(n) - before
                if size > HELD:
                    yield from tables(held)
                    held, size = {}, 0
        yield from tables(held)

    named = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return named.mapInArrow(run, COUNTS)


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 terms)), exact for counts of any size."""
    wide = (count + F.lit(2)).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    below = (total + F.lit(2) * terms).cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", wide, below)


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


class Tree:
    """K-squared tree of the nonzero cells of a square of ``SIDE``; ``rows`` and ``values`` are
    the leaves in Morton order."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, values: np.ndarray):
        code = np.zeros(len(rows), np.int64)
        for b in range(LEVELS):
            code |= (rows >> b & 1) << (2 * b + 1) | (columns >> b & 1) << (2 * b)
        order = np.argsort(code, kind="stable")
        code, self.rows, self.values = code[order], rows[order], values[order]
        self.bits, self.ranks = [], []
        above = np.zeros(1, np.int64)
        for level in range(1, LEVELS + 1):
            nodes = np.unique(code >> 2 * (LEVELS - level))
            bits = np.zeros(4 * len(above), bool)
            bits[4 * np.searchsorted(above, nodes >> 2) + (nodes & 3)] = True
            self.bits.append(bits)
            self.ranks.append(np.cumsum(bits) - 1)
            above = nodes


def common_cells(a: Tree, b: Tree) -> tuple[np.ndarray, np.ndarray]:
    """Leaves of ``a`` and of ``b`` that lie in one column, for all pairs of their rows."""
    left = right = np.zeros(1, np.int64)
    row_a, row_b, column = (x.ravel() for x in np.meshgrid([0, 1], [0, 1], [0, 1], indexing="ij"))
    for level in range(LEVELS):
        i = (4 * left[:, None] + 2 * row_a + column).ravel()
        j = (4 * right[:, None] + 2 * row_b + column).ravel()
        both = a.bits[level][i] & b.bits[level][j]
        left, right = a.ranks[level][i[both]], b.ranks[level][j[both]]
    return left, right


def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def tile_sums(tree: Tree, zero: np.ndarray, other: Tree | None, other_zero: np.ndarray, once: bool) -> np.ndarray:
    """Sums over a tile's terms beyond V f(g0, h0), groups of ``tree`` by those of ``other``: the
    cells of the first, and the cells of both if ``other`` is given (``once``: only above the
    diagonal, for a tile against itself)."""
    out = np.zeros((len(zero), len(other_zero)), np.int64)
    alone = f(tree.values[:, None], other_zero) - f(zero[tree.rows][:, None], other_zero)
    np.add.at(out, tree.rows, alone)
    if other is not None:
        i, j = common_cells(tree, other)
        g, h = tree.rows[i], other.rows[j]
        if once:
            i, j, g, h = (x[g < h] for x in (i, j, g, h))
        p, q = tree.values[i], other.values[j]
        np.add.at(out, (g, h), f(p, q) - f(p, other_zero[h]) - f(zero[g], q) + f(zero[g], other_zero[h]))
    return out


def _pair_sums(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, g, h, sum`` of ordered pairs of groups; add (g, h) and (h, g)."""
    rows = F.collect_list(F.struct("row", "col", "p"))
    tiles = cells.groupBy("lang", "tile", "block").agg(rows.alias("cells"))
    zeros = groups.groupBy("lang", "block").agg(F.array_sort(F.collect_list(F.struct("row", "zero"))).alias("zeros"))
    left = tiles.join(zeros, ["lang", "block"]).select("lang", "tile", "block", "cells", F.col("zeros.zero").alias("zeros"))
    against = zeros.select("lang", F.col("block").alias("other"), F.col("zeros.zero").alias("other_zeros"))
    right = tiles.select("lang", "tile", F.col("block").alias("other"), F.col("cells").alias("other_cells"))
    # every tile meets every block of its language; cells of both are counted from the lower one
    met = left.join(against, "lang").withColumn("above", F.when(F.col("block") < F.col("other"), F.col("other")))
    met = met.join(right.withColumnRenamed("other", "above"), ["lang", "tile", "above"], "left")
    met = met.select("lang", "block", "other", "zeros", "other_zeros", "cells", "other_cells")

    def tree(cells):
        fields = [cells.field(n).to_numpy(zero_copy_only=False) for n in ("row", "col", "p")]
        return Tree(*(x.astype(np.int64) for x in fields))

    def run(batches):
        import pyarrow as pa

        sums: dict[tuple, np.ndarray] = {}

        def given():
            for (lang, block, other), out in sums.items():
                rows = np.flatnonzero(out.any(1))
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * len(rows), pa.string()), pa.array(rows + block * SIDE),
                    pa.array([other] * len(rows), pa.int64()), pa.array(list(out[rows]), pa.list_(pa.int64())),
                ], ["lang", "g", "other", "sums"])

        for batch in batches:
            for r in range(batch.num_rows):
                lang, block, other = (batch.column(c)[r].as_py() for c in range(3))
                zero, other_zero = (batch.column(c)[r].values.to_numpy() for c in (3, 4))
                mine, theirs = tree(batch.column(5)[r].values), batch.column(6)[r]
                if block == other:
                    out = tile_sums(mine, zero, mine, other_zero, True)
                else:
                    out = tile_sums(mine, zero, tree(theirs.values) if theirs.is_valid else None, other_zero, False)
                key = (lang, block, other)
                if key in sums:
                    sums[key] += out
                else:
                    sums[key] = out
                if len(sums) > 64:
                    yield from given()
                    sums.clear()
        yield from given()

    # a group's sums against a block stay one row until all tasks' are added up
    found = met.mapInArrow(run, "lang string, g bigint, other bigint, sums array<bigint>")
    added = found.groupBy("lang", "g", "other").agg(
        F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(SIDE)]).alias("sums")
    )
    each = added.select("lang", "g", "other", F.posexplode("sums").alias("h", "sum")).where("sum IS NOT NULL")
    return each.select("lang", "g", (F.col("other") * SIDE + F.col("h")).alias("h"), "sum")


def audit(docs: DataFrame, least_docs: int = 10, top: int = 10) -> DataFrame:
    """Rows ``lang, source, part, item, value, rank``: part ``pair`` gives the divergence of a
    source from each other source of its language, part ``term`` its ``top`` most overused terms.

    A language keeps the terms that occur in ``least_docs`` of its documents. Counts are made when
    this is called, not when the result is read.
    """
    term = Window.partitionBy("lang", "term")
    counts = count_terms(docs).repartition("lang", "term")  # both sums below follow this
    summed = counts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    seen = summed.select(
        "lang", "source", "term", "n", F.sum("docs").over(term).alias("docs"), F.sum("n").over(term).alias("all"),
        (F.col("source") == F.min("source").over(term)).alias("first"),
    )
    kept = materialise(seen.where(F.col("docs") >= least_docs), "divergence-counts")

    # groups: one row each
    names = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum(F.col("first").cast("bigint")).alias("v"))
    lang, order = Window.partitionBy("lang"), Window.partitionBy("lang").orderBy(F.desc("total"), "source")
    groups = names.join(sizes, ["lang", "source"], "left").fillna(0, ["total", "v"])
    groups = groups.withColumn("terms", F.sum("v").over(lang)).withColumn("lang_total", F.sum("total").over(lang))
    groups = groups.withColumn("number", F.row_number().over(order) - 1)
    groups = materialise(groups.select(
        "lang", "source", "total", "lang_total", "terms", F.col("number").cast("bigint").alias("number"),
        F.floor(F.col("number") / SIDE).alias("block"), (F.col("number") % SIDE).alias("row"),
        F.when(F.col("terms") > 0, share(F.lit(0), F.col("total"), F.col("terms"))).otherwise(1).alias("zero"),
    ), "divergence-groups")

    cells = kept.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("terms")))

    # terms of like frequency share a tile; a tile that got too many goes on in another strip
    level = F.floor(F.log2("docs"))
    strips = kept.where("first").groupBy("lang", level.alias("level")).agg(F.ceil(F.count("*") / (0.75 * SIDE)).alias("strips"))
    spread = kept.where("first").withColumn("level", level).join(strips, ["lang", "level"]).select(
        "lang", "term", "level", F.pmod(F.xxhash64("term"), "strips").alias("strip")
    )
    # dealt by strip: the join above leaves all terms of a level together
    spread = spread.repartition("lang", "level", "strip")
    place = F.row_number().over(Window.partitionBy("lang", "level", "strip").orderBy("term")) - 1
    columns = spread.withColumn("place", place).select(
        "lang", "term", (F.col("place") % SIDE).alias("col"),
        F.struct("level", "strip", F.floor(F.col("place") / SIDE).alias("more")).alias("tile"),
    )
    tiled = cells.select("lang", "term", "block", "row", "p").join(columns, ["lang", "term"])
    sums = _pair_sums(tiled, groups)
    both = sums.unionByName(sums.select("lang", F.col("h").alias("g"), F.col("g").alias("h"), "sum"))
    both = both.groupBy("lang", "g", "h").agg(F.sum("sum").alias("sum"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("number").alias("h"), F.col("zero").alias("other_zero"))
    pairs = groups.join(other, "lang").where(F.col("number") != F.col("h"))
    pairs = pairs.join(both.withColumnRenamed("g", "number"), ["lang", "number", "h"], "left")
    value = F.col("terms") * distance(F.col("zero"), F.col("other_zero")) + F.coalesce("sum", F.lit(0))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value"))

    q = share(F.col("all"), F.col("lang_total"), F.col("terms"))
    over = cells.withColumn("q", q).where("n > 0 AND p > q")
    terms = over.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(ranked)
    terms = terms.withColumn("rank", rank).where(F.col("rank") <= top)
    return pairs.withColumn("rank", rank).unionByName(terms)
