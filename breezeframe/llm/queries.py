"""The operators as queries over the shared tables, and the SQL some of them must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from breezeframe.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from breezeframe.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from breezeframe.llm.common import crc_of_id
    from breezeframe.llm.langid import fit, identify

    docs = table(spark, sf_dir, "documents")
    held_out = crc_of_id() % 5 == 0
    model = fit(docs, ~held_out)
    return identify(docs.withColumn("held_out", held_out), model, keep=["doc_id", "held_out"])


@query
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from breezeframe.llm.decontaminate import find_overlaps

    docs, tests = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return find_overlaps(docs, tests, keep=["doc_id"])


@query
def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from breezeframe.llm.secrets import scan, written

    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), name="found")
    base = F.filter("found", lambda s: s["rank"] < 3)

    def count(rank):
        return F.size(F.filter("found", lambda s: s["rank"] == rank)).cast("bigint")

    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(written(base).cast("binary"), 256).alias("base_sha256"),
        written(F.col("found")).alias("spans"),
    )


@query
def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from breezeframe.llm.licenses import rarity, scan

    docs = table(spark, sf_dir, "documents")
    return scan(docs, rarity(docs))


@query
def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from breezeframe.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=80)


@query
def op1_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from breezeframe.llm.suffixes import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), length=100).drop("kept")


@query
def op5_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from breezeframe.llm.lattice import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"), least=0.98)


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from breezeframe.llm.common import crc_of_id
    from breezeframe.llm.toxicity import fit, score

    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), lambda c: crc_of_id(c) % 4 != 2)
    return score(docs.withColumn("held_out", crc_of_id() % 4 == 2), model, 0.3, keep=["doc_id", "held_out"])


@query
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from breezeframe.llm.warc import archive

    found = archive(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from breezeframe.llm.divergence import audit

    return audit(table(spark, sf_dir, "documents"))


@query
def op12_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from breezeframe.llm.bestfit import pack

    found = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return found.drop("doc_tokens")


@query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from breezeframe.llm.repair import COUNTS, all_conversations, damage, digests, find_edits

    conversations = table(spark, sf_dir, "conversations")
    rows = damage(conversations)
    found = digests(rows, all_conversations(conversations, find_edits(rows)))
    return found.withColumnRenamed("conv", "conv_id").select("conv_id", *COUNTS, "audit", "repaired_sha256")


ORACLES["op11_source_divergence"] = """
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS doc,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), w AS (SELECT lang, source, doc, unnest(w) AS term FROM d),
per_doc AS (SELECT lang, source, doc, term, count(*) AS n FROM w GROUP BY ALL),
kept AS (SELECT lang, term FROM per_doc GROUP BY ALL HAVING count(*) >= 10),
cells AS (SELECT lang, source, term, sum(n)::HUGEINT AS n FROM per_doc JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
groups AS (
  SELECT g.lang, g.source, coalesce(v.v, 0) AS v, coalesce(t.n, 0)::HUGEINT AS total
  FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN v USING (lang)
  LEFT JOIN (SELECT lang, source, sum(n) AS n FROM cells GROUP BY ALL) t USING (lang, source)
), filled AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (g.total + 2 * g.v) AS p
  FROM groups g JOIN kept k USING (lang) LEFT JOIN cells c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), whole AS (
  SELECT t.lang, t.term, 1 + (1000000000::HUGEINT * (t.n + 2)) // (a.n + 2 * v.v) AS q
  FROM (SELECT lang, term, sum(n)::HUGEINT AS n FROM cells GROUP BY ALL) t
  JOIN (SELECT lang, sum(n)::HUGEINT AS n FROM cells GROUP BY ALL) a USING (lang) JOIN v USING (lang)
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT x.lang, x.source AS s, y.source AS t, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS value
    FROM filled x JOIN filled y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
  ) s ON s.lang = a.lang AND s.s = a.source AND s.t = b.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value
  FROM filled JOIN whole USING (lang, term) WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""

ORACLES["op13_conversation_repair"] = """
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, n: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS tab
  FROM range(256) t(i)
), raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT) AS key
  FROM conversations
), kinds AS (
  SELECT conv_id, turn, role, text, xor(4294967295, list_reduce(list_prepend(4294967295, key),
    lambda c, b: xor(c >> 8, tab[1 + (xor(c, b) & 255)]))) % 20 AS kind FROM raw, crc
), hurt AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM kinds WHERE kind <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
    NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
    right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) NOT IN ('.', '!', '?') AS cut
  FROM hurt
), rows_ AS (
  SELECT *, NOT blank AND again AS dup, NOT blank AND NOT again AND cut AS trunc, left(role, 1) AS initial,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (dup) AS duplicate, count(*) FILTER (trunc) AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM rows_ GROUP BY conv_id
), moves(p, q, edit, initial, price) AS (
  SELECT * FROM (VALUES (0,0,'D','',3), (1,1,'D','',3), (2,2,'D','',3), (3,3,'D','',3),
    (0,1,'K','s',0), (0,2,'K','u',0), (1,2,'K','u',0), (3,2,'K','u',0), (2,3,'K','a',0),
    (0,2,'R','',2), (1,2,'R','',2), (3,2,'R','',2), (2,3,'R','',2))
), inserts(p, q, more, price) AS (
  SELECT * FROM (VALUES (0,0,'',0), (1,1,'',0), (2,2,'',0), (3,3,'',0), (0,2,'I',2), (0,3,'II',4), (1,2,'I',2), (1,3,'II',4), (2,3,'I',2), (3,2,'I',2))
), search AS (
  SELECT conv_id, 0::BIGINT AS i, q AS state, price::BIGINT AS cost, more AS audit FROM counts, inserts WHERE p = 0
  UNION ALL
  SELECT conv_id, i, state, best.cost, best.audit FROM (
    SELECT s.conv_id, r.i, x.q AS state, min({'cost': s.cost + m.price + x.price + CASE WHEN m.edit <> 'D' AND r.trunc THEN 1 ELSE 0 END,
      'audit': s.audit || m.edit || x.more}) AS best
    FROM search s JOIN rows_ r ON s.conv_id IS NOT DISTINCT FROM r.conv_id AND r.i = s.i + 1
    JOIN moves m ON m.p = s.state AND (m.edit <> 'K' OR m.initial = r.initial) AND (m.edit = 'D' OR NOT (r.blank OR r.dup))
    JOIN inserts x ON x.p = m.q
    GROUP BY s.conv_id, r.i, x.q)
), won AS (
  SELECT c.conv_id, min({'cost': s.cost, 'audit': s.audit}) AS best
  FROM counts c JOIN search s ON s.conv_id IS NOT DISTINCT FROM c.conv_id AND s.i = c.n AND s.state IN (0, 3) GROUP BY c.conv_id
), edits AS (
  SELECT conv_id, unnest(string_split(best.audit, '')) AS edit, unnest(range(1, length(best.audit) + 1)) AS k FROM won WHERE best.audit <> ''
), matched AS (
  SELECT *, sum(CASE WHEN edit = 'I' THEN 0 ELSE 1 END) OVER w AS i, sum(CASE WHEN edit = 'D' THEN 0 ELSE 1 END) OVER w AS place
  FROM edits WINDOW w AS (PARTITION BY conv_id ORDER BY k)
), kept AS (
  SELECT m.conv_id, m.k, m.edit, m.place, r.role, r.text,
    max(CASE WHEN m.place = 1 AND m.edit = 'K' AND r.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY m.conv_id) AS led
  FROM matched m LEFT JOIN rows_ r ON m.edit <> 'I' AND r.conv_id IS NOT DISTINCT FROM m.conv_id AND r.i = m.i WHERE m.edit <> 'D'
), written AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - led) % 2 = 1 THEN 'user' ELSE 'assistant' END
    || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY k)) AS sha FROM kept GROUP BY conv_id
)
SELECT a.conv_id, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(c.blank, 0)::BIGINT AS blank, coalesce(c.duplicate, 0)::BIGINT AS duplicate,
  coalesce(c.truncated, 0)::BIGINT AS truncated, coalesce(c.illegal, 0)::BIGINT AS illegal, coalesce(w.best.cost, 0)::BIGINT AS cost,
  coalesce(w.best.audit, '') AS audit, coalesce(t.sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN won w ON w.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN written t ON t.conv_id IS NOT DISTINCT FROM a.conv_id
"""

ORACLES["op7_warc"] = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS hex FROM pages
), d AS (
  SELECT page_id, octet_length(payload) AS n, list_aggregate(list_transform(range(32), lambda k:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
      (('0x' || substr(hex, CAST(1 + 5 * (k // 4) AS INT), 5))::BIGINT >> CAST(15 - 5 * (k % 4) AS INT)) & 31 AS INT), 1)
    ), 'string_agg', '') AS digest FROM p
), f AS (SELECT *, min(page_id) OVER (PARTITION BY digest, n) AS first FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to FROM f
"""

ORACLES["op2_near_duplicates"] = """
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))) AS g
  FROM d WHERE len(w) > 3
  UNION SELECT doc_id, 'all ' || array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 3
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)
), reach AS (
  SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r
), c AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM c LEFT JOIN n USING (doc_id)
"""

ORACLES["op5_near_vectors"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
  SELECT vec_id, vec_id AS r FROM v UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON links.a = reach.r
), c AS (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY vec_id),
k AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN k USING (vec_id)
"""
