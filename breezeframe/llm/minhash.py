"""Near-duplicate documents by MinHash with tensored banding.

A document is its set of distinct word shingles. ``COLLECTIONS`` small collections of
``PER_COLLECTION`` minhashes are computed per set, and every *pair* of collections forms the
key of one table: m collections give m(m-1)/2 tables, so the minhash work is about the square
root of what independent tables would need. Two sets meet in a table as soon as two of their
collections agree: at similarity 0.8 that fails for about one pair in ten thousand with the
default 12 collections of 2.

Links are confirmed on full sets, recomputed from whole texts:

1. Equal sets are one class; from here on only class representatives are looked at, so copies
   cost nothing however many there are.
2. Star round: each bucket (table key) with two members or more proposes links to its hub,
   the member that meets most others over all tables. Proposals are made distinct over all
   tables and confirmed.
3. Further rounds: where a bucket still spans several components, each document outside its
   largest one is compared with one random member of it.
4. What is left in such buckets is settled exactly by prefix filtering: with all shingles in
   the order of their frequency, two sets of similarity t share one of their
   ``n - ceil(t * n) + 1`` rarest, and what follows their first common one must be long
   enough in both (positional filter). Each set also carries the parity of its shingles in
   ``PARITY`` cells: an odd cell of two sets' sum holds a shingle that only one of them has, so
   more odd cells than the similarity allows rule a pair out. Candidates are pairs of different components that meet
   both and were not compared before: first one per document and foreign component, which
   joins most components that belong together, then all that are left. There is no cap, and
   pairs inside one component are never made.

Buckets are aggregated before they are shuffled and joined back by plain equi-joins, whose
hot keys adaptive execution splits. A hub's partners are confirmed in chunks of ``CHUNK``.
Texts travel compressed. Intermediate tables lie in the shared folder.

Defined results: null text, or text without words, has an empty set, links with nothing and
is its own component. A null id cannot be named by others: such rows keep a null component
and count as kept. Rows that repeat an id are one node. Ties go to the smaller id.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from breezeframe.llm.common import SPACES, U64, blocks, map_texts, materialise, mix, random_words, word_hashes, written
from breezeframe.llm.graph import components

COLLECTIONS, PER_COLLECTION = 12, 2
CHUNK = 64
#: cells of the parity sketch, in words of 64
PARITY = 1024
#: confirming rounds before the exact one
ROUNDS = 3
FACTORS = random_words(71, 64) | U64(1)
SHIFTS = random_words(72, 64)


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes per text."""
    h, _, _, first = word_hashes(buf, offsets, SPACES)
    n = len(h) - size + 1
    rolled = np.zeros(max(n, 0), U64)
    for k in range(size):
        rolled += h[k : k + n] * FACTORS[k] if n > 0 else 0
    rolled = mix(rolled)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:  # fewer words: the whole sequence, told apart by its length
            whole = (h[a:b] * FACTORS[: b - a]).sum(dtype=U64) + U64(b - a)
            out.append(mix(np.array([whole], U64)))
        else:
            out.append(np.zeros(0, U64))
    return out


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Sizes, two 64-bit fingerprints, and the collections (texts x COLLECTIONS)."""
    sizes = np.array([len(s) for s in sets])
    full = np.flatnonzero(sizes)
    marks = np.zeros((2, len(sets)), U64)
    out = np.zeros((len(sets), COLLECTIONS), U64)
    if len(full):
        flat = np.concatenate([sets[i] for i in full])
        begins = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
        marks[0, full] = np.add.reduceat(mix(flat + SHIFTS[60]), begins)
        marks[1, full] = np.add.reduceat(mix(flat + SHIFTS[61]), begins)
        for c in range(COLLECTIONS):
            key = np.full(len(full), U64(c + 1))
            for r in range(PER_COLLECTION):
                k = c * PER_COLLECTION + r
                least = np.minimum.reduceat((flat ^ SHIFTS[k]) * FACTORS[k], begins)
                key = mix(key * FACTORS[62] + least)
            out[full, c] = key
    return sizes, marks[0].view(np.int64), marks[1].view(np.int64), out.view(np.int64)


def _signed(docs: DataFrame, size: int, id_column: str, text_column: str) -> DataFrame:
    """Signatures, and the texts compressed, so that a shuffle of them moves a third of the bytes:
    the only pass over the texts as they are."""

    def run(buf, offsets):
        import pyarrow as pa
        import zstandard

        sizes, one, two, keys = signatures(shingle_sets(buf, offsets, size))
        squeeze, data = zstandard.ZstdCompressor(level=3).compress, buf.tobytes()
        zipped = [squeeze(data[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        return [
            pa.array(sizes, pa.int64()), pa.array(one), pa.array(two), pa.array(list(keys), pa.list_(pa.int64())),
            pa.array(zipped, pa.binary()),
        ]

    ids = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
    schema = "n bigint, s1 bigint, s2 bigint, keys array<bigint>, zipped binary"
    return map_texts(ids, "text", schema, run, ["doc_id"])


def _texts(signed: DataFrame) -> DataFrame:
    return signed.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), "zipped")


def parities(sets: list[np.ndarray]) -> list[np.ndarray]:
    """Per set a bit for every cell that holds an odd number of its shingles."""
    out = []
    for s in sets:
        odd = np.bincount((s >> U64(54)).astype(np.int64), minlength=PARITY) & 1
        out.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
    return out


def _confirm(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (hub, doc) whose sets are similar enough."""
    many = pairs.groupBy("hub").count()
    parts = pairs.join(many, "hub").select(
        "hub", "doc", F.pmod(F.xxhash64("doc"), F.ceil(F.col("count") / CHUNK)).cast("int").alias("chunk")
    )
    sides = parts.select("hub", "chunk", F.col("doc").alias("id")).unionByName(
        parts.select("hub", "chunk", F.col("hub").alias("id")).distinct()
    )
    rows = sides.join(texts, "id").select("hub", "chunk", "id", "zipped")
    rows = rows.repartition("hub", "chunk").sortWithinPartitions(
        "hub", "chunk", (F.col("id") == F.col("hub")).desc(), "id"
    )

    def run(batches):
        import pyarrow as pa
        import zstandard

        def unpacked():
            open_ = zstandard.ZstdDecompressor().decompress
            for batch in batches:
                for i in range(0, batch.num_rows, 256):
                    part = batch.slice(i, 256)
                    texts_ = pa.array([open_(z) for z in part.column(3).to_pylist()], pa.large_binary())
                    keys = zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)
                    yield list(keys), [s for _, _, b, o in blocks(texts_) for s in shingle_sets(b, o, size)]

        place, base = None, []
        for keys, sets in unpacked():
            found = []
            for (hub, chunk, key), s in zip(keys, sets, strict=True):
                if (hub, chunk) != place:
                    place, base = (hub, chunk), []
                if key == hub:
                    base.append(s)  # more than one if rows repeat an id
                    continue
                for h in base:
                    both = len(np.intersect1d(h, s, assume_unique=True))
                    if both and 100 * both >= percent * (len(h) + len(s) - both):
                        found.append((hub, key))
                        break
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["hub", "doc"]
                )

    return rows.mapInArrow(run, "hub bigint, doc bigint")


def _rare_pairs(open_: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (hub, doc) of different components with a rare shingle in common, the hub being
    outside the main component of some bucket."""
    docs = open_.groupBy("doc").agg(
        F.first("component").alias("component"),
        F.max(F.col("component") != F.col("main")).alias("outside"),
    )

    def run(batches):
        import pyarrow as pa
        import zstandard

        open_ = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                texts_ = pa.array([open_(z) for z in part.column(1).to_pylist()], pa.large_binary())
                sets = [s for _, _, b, o in blocks(texts_) for s in shingle_sets(b, o, size)]
                both = [pa.array([s.view(np.int64) for s in x], pa.list_(pa.int64())) for x in (sets, parities(sets))]
                yield pa.RecordBatch.from_arrays([part.column(0), *both], ["doc", "s", "odd"])

    found = texts.join(docs.select("doc"), F.col("id") == F.col("doc")).select("doc", "zipped")
    sets = found.mapInArrow(run, "doc bigint, s array<bigint>, odd array<bigint>")
    # an id may come with several texts: ``t`` tells them apart
    sets = sets.withColumn("n", F.size("s").cast("bigint")).withColumn("t", F.xxhash64("odd", "n"))
    sets = written(sets.dropDuplicates(["doc", "t"]), "minhash-residue")
    each = sets.select("doc", "t", "n", F.explode("s").alias("s"))
    often = each.groupBy("s").count()
    rank = Window.partitionBy("doc", "t").orderBy("count", "s")
    rare = each.join(often, "s").withColumn("place", F.row_number().over(rank))
    rare = rare.where(f"place <= n - ceil(n * {percent} / 100) + 1 AND count > 1")
    rare = rare.join(sets.select("doc", "t", "odd"), ["doc", "t"]).join(docs, "doc")
    rare = materialise(rare.select("s", "doc", "n", "component", "outside", "place", "odd"), "minhash-rare")
    hubs = rare.where("outside").select(
        "s", F.col("doc").alias("hub"), F.col("n").alias("hub_n"), F.col("component").alias("c"), F.col("place").alias("hub_place"),
        F.col("odd").alias("hub_odd"),
    )
    # an overlap of o in sets of n and m is similar enough from (100 + p) * o >= p * (n + m)
    reach = f"{100 + percent} * (least(n - place, hub_n - hub_place) + 1) >= {percent} * (n + hub_n)"
    apart = sum((F.bit_count(F.col("odd")[i].bitwiseXOR(F.col("hub_odd")[i])) for i in range(PARITY // 64)), F.lit(0))
    near = (100 + percent) * apart <= (100 - percent) * (F.col("n") + F.col("hub_n"))
    return rare.join(hubs, "s").where("component != c").where(reach).where(near).select("hub", "hub_n", "doc", "n", "component")


def near_duplicates(
    docs: DataFrame,
    size: int = 5,
    percent: int = 80,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``."""
    signed = written(_signed(docs, size, id_column, text_column), "minhash-sets")
    full = signed.where("n > 0 AND doc_id IS NOT NULL")
    least = full.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep"))
    classes = materialise(full.join(least, ["s1", "s2", "n"]).select("doc_id", "n", "rep", "keys"), "minhash-classes")
    reps = classes.where("doc_id = rep").select("doc_id", "n", "keys").dropDuplicates(["doc_id", "n", "keys"])

    tables = list(combinations(range(COLLECTIONS), 2))
    keys = F.array(*[F.xxhash64(F.col("keys")[i], F.col("keys")[j], F.lit(t)) for t, (i, j) in enumerate(tables)])
    entries = reps.select(F.col("doc_id").alias("doc"), "n", F.explode(keys).alias("key"))
    several = entries.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    met = materialise(entries.join(several, "key").select("key", "doc", "n", "members"), "minhash-buckets")
    degree = met.groupBy("doc").agg(F.sum("members").alias("degree"))
    order = F.struct("degree", F.xxhash64("doc"))
    ranked = met.join(degree, "doc")
    hubs = ranked.groupBy("key").agg(F.max_by("doc", order).alias("hub"), F.max_by("n", order).alias("hub_n"))
    texts = _texts(signed)
    close = f"100 * least(n, hub_n) >= {percent} * greatest(n, hub_n) AND doc != hub"
    low, high = F.least("hub", "doc").alias("hub"), F.greatest("hub", "doc").alias("doc")

    def confirmed(pairs: DataFrame, number: int):
        pairs = materialise(pairs, f"minhash-pairs-{number}")
        if pairs.isEmpty():
            return pairs, None
        return pairs, written(_confirm(pairs, texts, size, percent), f"minhash-links-{number}")

    tested, links = confirmed(met.join(hubs, "key").where(close).select(low, high).distinct(), 1)
    linked = components(links, "hub", "doc") if links is not None else None
    for number in range(2, ROUNDS + 3):
        if linked is None:
            break
        placed = met.select("key", "doc", "n").join(linked, F.col("doc") == F.col("node"), "left")
        placed = placed.select("key", "doc", "n", F.coalesce("component", "doc").alias("component"))
        spread = placed.groupBy("key", "component").count().groupBy("key").agg(
            F.count("*").alias("parts"), F.max_by("component", F.struct("count", "component")).alias("main")
        ).where("parts > 1")
        open_ = materialise(placed.join(spread.select("key", "main"), "key"), f"minhash-open-{number}")
        if number <= ROUNDS:
            order = F.xxhash64("doc", "key", F.lit(number))
            hubs = open_.where("component = main").groupBy("key").agg(
                F.min_by("doc", order).alias("hub"), F.min_by("n", order).alias("hub_n")
            )
            new = open_.where("component != main").join(hubs, "key").where(close)
            new = new.groupBy("doc", "main").agg(F.min_by("hub", F.xxhash64("hub", "doc", F.lit(number))).alias("hub"))
            new = new.select(low, high).distinct()
        else:
            new = _rare_pairs(open_, texts, size, percent).where(close)
            if number == ROUNDS + 1:
                some = F.min_by("doc", F.xxhash64("hub", "doc"))
                new = new.groupBy("hub", "component").agg(some.alias("doc"))
            new = new.select(low, high).distinct()
        pairs, more = confirmed(new.join(tested, ["hub", "doc"], "left_anti"), number)
        if more is None:
            continue
        tested = tested.unionByName(pairs)
        known = linked.select(F.col("component").alias("hub"), F.col("node").alias("doc"))
        linked = components(known.unionByName(more), "hub", "doc")

    placed = classes.select("doc_id", "rep")
    if linked is not None:
        placed = placed.join(linked, F.col("rep") == F.col("node"), "left").select(
            "doc_id", F.coalesce("component", "rep").alias("component_id")
        )
    else:
        placed = placed.withColumnRenamed("rep", "component_id")
    # rows that repeat an id with another text are one node
    placed = placed.groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    out = signed.select("doc_id", F.col("n").alias("n_shingles")).join(placed, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )
