"""Conversation structure repair: cheapest edits that give every conversation a legal shape.

A conversation is legal when its role initials read ``(s?(ua)+)?``: an optional system row,
then user and assistant in turn. Edits are Keep (0), Rerole to user or assistant (2), Delete
(3, the only choice for blank and duplicate rows) and Insert of an empty row (2); a truncated
row that is not deleted costs 1 more. Among the cheapest edit lists the one whose initials
(D, I, K, R) come first in ASCII order is taken; it fixes every role.

The search is a Viterbi pass over four states (nothing yet, system, user, assistant). Each
state's survivor is a leaf of a backpointer tree whose nodes count their references:

* a node without references is freed, and its parent's count goes down;
* once all survivors share an ancestor, the edits down to it are emitted and forgotten;
* ties compare the survivors' whole unresolved suffixes. Two survivors of one state that cost
  the same are never prefixes of each other (a longer one has more inserts), so the order of
  two of them is settled where they part and is carried along, not read again per row;
* a survivor that another one beats by more than it can ever win back is dropped. Without this
  the list that deletes everything would survive forever and nothing could be emitted;
* chains of nodes without a branch are one node, so at most seven nodes are live, and what is
  unresolved takes a byte an edit.

Two shuffles by conversation: the first carries a few bytes per row to the search, the second
the texts, which :func:`apply_edits` streams past the emitted edits one by one. A conversation
is never held as a whole; what stays in memory is its edit string. Rows of one conversation do
pass one task, in order, since a digest of its text is a chain; sorting spills to disk.
Duplicates are found before that, by an aggregate over (conversation, role, text) whose result
joins on the turn too, so that neither a repeated row nor a huge conversation is one group.

Defined results: null role or text is one space; a null conversation id is a conversation of
its own; rows go by turn, nulls first, then by role and by the digest of their text; rows
that repeat in all columns are duplicates; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: state a row of this initial, kept, leads to from each state; None is illegal
KEPT = {
    "s": (SYSTEM, None, None, None),
    "u": (USER, USER, None, USER),
    "a": (None, None, ASSISTANT, None),
}
#: state that a user or assistant row leads to
NEXT = (USER, USER, ASSISTANT, USER)
#: by how much a state may be dearer than "assistant" before it can never win
LEAD = {NOTHING: DELETE, SYSTEM: 0, USER: INSERT}
SETTLE = 512

COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
EDITS = "conv bigint, audit string, " + ", ".join(f"{c} bigint" for c in COUNTS)
ROW_ORDER = ["turn", "role", "digest"]


def damage(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Drops, empties, cuts, repeats or reroles rows by the crc32 of ``conv:turn``, mod 20."""

    def filled(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(filled(conv), F.lit(":"), filled(turn)).cast("binary")) % 20
    rows = df.select(
        F.col(conv).cast("bigint").alias("conv"), F.col(turn).cast("bigint").alias("turn"),
        F.when(kind == 4, "user").otherwise(filled(role)).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(filled(text), "[.!?]", "")).otherwise(filled(text)).alias("text"),
        kind.alias("__kind"),
    ).where("__kind != 0")
    copies = F.explode(F.when(F.col("__kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv", "turn", "role", "text", copies.alias("__copy")).drop("__copy")


def with_digest(rows: DataFrame) -> DataFrame:
    return rows.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))


def flagged(rows: DataFrame) -> DataFrame:
    """Distinct rows without their text: ``copies`` of each, whether one is ``first`` of its role
    and text in the conversation, and what the search needs to know."""
    last = F.right(F.rtrim(F.col("text"), F.lit(" \t\n\x0b\f\r")), F.lit(1))
    codes = with_digest(rows).select(
        "conv", "turn", "role", "digest",
        (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"), (~last.isin(".", "!", "?")).alias("cut"),
    )
    each = codes.groupBy("conv", "turn", "role", "digest").agg(
        F.count("*").alias("copies"), F.first("blank").alias("blank"), F.first("cut").alias("cut")
    )
    order = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    firsts = each.groupBy("conv", "role", "digest").agg(F.min(order).alias("m")).select(
        F.col("conv").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), F.col("m.turn").alias("t")
    )
    same = (
        F.col("conv").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t"))
        & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    )
    return each.join(firsts, same, "left").select(
        "conv", *ROW_ORDER, "copies", "blank", "cut", F.col("d").isNotNull().alias("first")
    )


class Search:
    """One conversation's Viterbi pass. ``step`` takes rows, ``end`` gives (cost, audit)."""

    #: (costs over the least, orders of the survivors, row) -> what the row does to them
    learned: dict = {}

    def __init__(self):
        self.root = ["", None, 1]  # edits, parent, references
        self.done: list[str] = []
        self.total, self.live, self.limit = 0, 1, SETTLE
        self.nodes = [self.root, None, None, None]
        start = self._advance((0, None, None, None), {}, None)
        self._follow(start)

    def step(self, initial: str, must_delete: bool, cut: bool) -> None:
        key = (self.costs, self.orders, initial, must_delete, cut)
        found = self.learned.get(key)
        if found is None:
            row = (initial, must_delete, cut)
            found = self.learned[key] = self._advance(self.costs, dict(self.orders), row)
        self._follow(found)

    @staticmethod
    def _compare(orders, a, b):
        """Edit strings of two continuations ``(survivor, more)``: -1, 1, or what is left of
        either behind their common beginning."""
        (i, x), (j, y) = a, b
        if i != j:
            known = orders[min(i, j), max(i, j)]
            if isinstance(known, int):
                return known if i < j else -known
            left, right = known if i < j else known[::-1]
            x, y = left + x, right + y
        n = 0
        while n < len(x) and n < len(y) and x[n] == y[n]:
            n += 1
        if n < len(x) and n < len(y):
            return -1 if x[n] < y[n] else 1
        return x[n:], y[n:]

    @classmethod
    def _before(cls, orders, a, b) -> bool:
        found = cls._compare(orders, a, b)
        return found == -1 if isinstance(found, int) else not found[0] and bool(found[1])

    @classmethod
    def _advance(cls, costs, orders, row):
        """(costs over the least, orders, the least, [(survivor, more)] by state)."""
        best: list = [None] * 4  # (cost, (survivor, more))

        def offer(state, cost, way):
            if best[state] is None or cost < best[state][0] or cost == best[state][0] and cls._before(orders, way, best[state][1]):
                best[state] = (cost, way)

        for p, cost in enumerate(costs):
            if cost is None:
                continue
            if row is None:
                offer(p, cost, (p, ""))
                continue
            initial, must_delete, cut = row
            offer(p, cost + DELETE, (p, "D"))
            if not must_delete:
                kept = KEPT[initial][p] if initial in KEPT else None
                if kept is not None:
                    offer(kept, cost + KEEP + cut, (p, "K"))
                offer(NEXT[p], cost + REROLE + cut, (p, "R"))
        for _ in range(2):  # inserts: at most user, then assistant
            for p in range(4):
                if best[p] is not None:
                    cost, (i, more) = best[p]
                    offer(NEXT[p], cost + INSERT, (i, more + "I"))
        for p, lead in LEAD.items():
            if best[p] is not None and best[p][0] > best[ASSISTANT][0] + lead:
                best[p] = None
        least = min(b[0] for b in best if b)
        alive = [p for p in range(4) if best[p]]
        new = tuple(
            ((p, q), cls._compare(orders, best[p][1], best[q][1])) for n, p in enumerate(alive) for q in alive[n + 1 :]
        )
        return tuple(b and b[0] - least for b in best), new, least, tuple(b and b[1] for b in best)

    def _follow(self, found) -> None:
        self.costs, self.orders, least, ways = found
        self.total += least
        old, self.nodes = self.nodes, [None] * 4
        for state, way in enumerate(ways):
            if way is not None:
                parent = old[way[0]]
                parent[2] += 1
                self.nodes[state] = [way[1], parent, 1]
                self.live += 1
        for node in old:
            if node is not None:
                self._release(node)
        if self.live > self.limit:
            self._settle()

    def _release(self, node) -> None:
        node[2] -= 1
        while node is not None and node[2] == 0:
            self.live -= 1
            node = node[1]
            if node is not None:
                node[2] -= 1

    def _settle(self) -> None:
        """Join chains without a branch; emit what all survivors have in common."""
        size = 0
        for leaf in filter(None, self.nodes):
            node, pieces = leaf, []
            while node[1] is not None and node[1][2] == 1:
                pieces.append(node[0])
                node = node[1]
                self.live -= 1
            if pieces:  # ``leaf`` takes the place of the chain's top
                leaf[0], leaf[1] = node[0] + "".join(reversed(pieces)), node[1]
            size += len(leaf[0])
        self._join_inner()
        top = self._top()
        if top is not None:
            self.done.append(top[0])
            top[0] = ""
        self.limit = max(SETTLE, size // 16)

    def _join_inner(self) -> None:
        """The same for the branching nodes between the survivors and the root."""
        seen: dict[int, list] = {}
        for leaf in filter(None, self.nodes):
            node = leaf[1]
            while node is not None and id(node) not in seen:
                seen[id(node)] = node
                pieces, top = [], node
                while top[1] is not None and top[1][2] == 1:
                    pieces.append(top[0])
                    top = top[1]
                    self.live -= 1
                if pieces:
                    node[0], node[1] = top[0] + "".join(reversed(pieces)), top[1]
                node = node[1]

    def _top(self):
        node = next(filter(None, self.nodes))
        while node[1] is not None:
            node = node[1]
        return node

    def _unresolved(self, node) -> str:
        pieces = []
        while node is not None:
            pieces.append(node[0])
            node = node[1]
        return "".join(reversed(pieces))

    def end(self) -> tuple[int, str]:
        ends = [
            (self.costs[p], self._unresolved(self.nodes[p])) for p in (NOTHING, ASSISTANT) if self.costs[p] is not None
        ]
        cost, rest = min(ends)
        return self.total + cost, "".join(self.done) + rest


def search(rows) -> tuple:
    """``rows`` of one conversation in order, ``(turn, role, copies, blank, cut, first)``; gives the
    audit and the counts in the order of ``COUNTS``."""
    found = Search()
    blanks = duplicates = truncated = illegal = distinct = 0
    low = high = before = None
    for turn, role, copies, blank, cut, first in rows:
        if turn is not None:
            low = turn if low is None else low
            distinct += turn != high
            high = turn
        initial = role[:1]
        for n in range(copies):
            duplicate = not blank and not (first and n == 0)
            bad = blank or duplicate
            blanks += blank
            duplicates += duplicate
            truncated += cut and not bad
            illegal += before is not None and before + initial not in ("su", "ua", "au")
            before = initial
            found.step(initial, bad, cut and not bad)
    cost, audit = found.end()
    gaps = 0 if low is None else high - low + 1 - distinct
    return audit, gaps, blanks, duplicates, truncated, illegal, cost


def _streamed(batches):
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _tables(rows, names, schema, size: int = 2000):
    """Record batches of at most ``size`` rows, so that a long result is handed on as it grows."""
    import pyarrow as pa

    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema, strict=True)], names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema, strict=True)], names)


def find_edits(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``rows`` (``conv, turn, role, text``): its ``audit`` (the edits'
    initials in order) and ``gaps, blank, duplicate, truncated, illegal, cost``."""

    def run(batches):
        import pyarrow as pa

        def found():
            for conv, group in groupby(_streamed(batches), key=lambda r: r[0]):
                yield conv, *search(r[1:] for r in group)

        yield from _tables(found(), ["conv", "audit", *COUNTS], [pa.int64(), pa.string(), *[pa.int64()] * 6])

    ordered = flagged(rows).repartition("conv").sortWithinPartitions("conv", *ROW_ORDER)
    return ordered.select("conv", "turn", "role", "copies", "blank", "cut", "first").mapInArrow(run, EDITS)


def edited(audit: str, rows):
    """``(edit, turn, role, text)`` in order for one conversation; deleted rows included."""
    at, before = 0, ""

    def due():
        return "assistant" if before == "u" else "user"

    for turn, role, text in rows:
        while audit[at] == "I":
            yield "I", None, due(), ""
            before, at = due()[0], at + 1
        edit, at = audit[at], at + 1
        if edit == "R":
            role = due()
        if edit != "D":
            before = role[:1]
        yield edit, turn, role, text
    for _ in audit[at:]:
        yield "I", None, due(), ""
        before = due()[0]


def _with_edits(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """The texts in order, each conversation's edits ahead of them."""
    texts = with_digest(rows).select(
        "conv", F.lit(1).alias("kind"), *ROW_ORDER, "text", F.lit(None).cast("string").alias("audit"),
        *[F.lit(None).cast("bigint").alias(c) for c in COUNTS],
    )
    heads = edits.select(
        "conv", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("role"),
        F.lit(b"").alias("digest"), F.lit("").alias("text"), "audit", *COUNTS,
    )
    both = heads.unionByName(texts).repartition("conv").sortWithinPartitions("conv", "kind", *ROW_ORDER)
    return both.select("conv", "audit", *COUNTS, "turn", "role", "text")


def apply_edits(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """The conversations as repaired: one row per edit that is not a deletion, numbered by
    ``position``; ``turn`` is null for inserted rows."""

    def run(batches):
        import pyarrow as pa

        def found():
            for conv, group in groupby(_streamed(batches), key=lambda r: r[0]):
                audit = next(group)[1]
                kept = (e for e in edited(audit, (r[-3:] for r in group)) if e[0] != "D")
                for position, (edit, turn, role, text) in enumerate(kept):
                    yield conv, position, edit, turn, role, text

        names, kinds = ["conv", "position", "edit", "turn", "role", "text"], [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
        yield from _tables(found(), names, kinds, 200)

    schema = "conv bigint, position bigint, edit string, turn bigint, role string, text string"
    return _with_edits(rows, edits).mapInArrow(run, schema)


def digests(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """``edits`` with the SHA-256 of each repaired conversation (``role:text``, newline-joined)."""

    def run(batches):
        import pyarrow as pa

        def found():
            for conv, group in groupby(_streamed(batches), key=lambda r: r[0]):
                head = next(group)
                whole, mark = hashlib.sha256(), ""
                for edit, _, role, text in edited(head[1], (r[-3:] for r in group)):
                    if edit != "D":
                        whole.update(f"{mark}{role}:{text}".encode())
                        mark = "\n"
                yield *head[:8], whole.hexdigest()

        names = ["conv", "audit", *COUNTS, "repaired_sha256"]
        yield from _tables(found(), names, [pa.int64(), pa.string(), *[pa.int64()] * 6, pa.string()])

    return _with_edits(rows, edits).mapInArrow(run, EDITS + ", repaired_sha256 string")


def all_conversations(conversations: DataFrame, edits: DataFrame, conv: str = "conv_id") -> DataFrame:
    """``edits`` plus conversations that lost all their rows: no edits, zeros."""
    known = conversations.select(F.col(conv).cast("bigint").alias("known")).distinct()
    found = known.join(edits, F.col("known").eqNullSafe(F.col("conv")), "left")
    return found.select(
        F.col("known").alias("conv"), F.coalesce("audit", F.lit("")).alias("audit"),
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in COUNTS],
    )
