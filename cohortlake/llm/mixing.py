"""Mixing sources to target weights by a low-discrepancy source schedule. DataFrame operations only.

The mix is a schedule of ``SLOTS`` slots, whatever the size of the corpus (more where there are very many sources), each for one
block of equally many words. Slot k takes the point frac(k * golden ratio) through the cumulative target weights of the sources
to its source, and its rank among that source's slots names the block it takes: a source's documents, shuffled by the MD5 of
their ids and texts and laid end to end, are its stream of words, read twice at most and cut into blocks. So a source gives
as many blocks as the points deal it, in the order of their slots; its words come within a few blocks of its target
(the discrepancy of the points: below one block for most sources, three in the worst case tested), a block being a 131,072th of the mix.
Word positions are prefix sums in levels (groups of buckets of shuffled documents), so no source, however large, is sorted or
counted in one task.

Sizes are words; null text has none. Sources come by code point, null last, and an empty source name is a source. Rows
without words are never taken; equal rows are taken each for itself, and as they are alike in all that decides, any
partitioning of the table gives the same rows. Very long documents span blocks. An empty table gives no rows.
Only doc_id, text and source are read; further columns pass through ``mixed_documents`` alone.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, WORD, broadcast_if_small, running, staged

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
GOLDEN = (math.sqrt(5) - 1) / 2
#: Slots of the mix, about, and at least so many for each source.
SLOTS, EACH = 1 << 17, 64
#: A source's documents are placed in so many buckets by three hex digits.
BUCKET_DIGITS = 3
#: Points find their source through so many cells.
CELLS = 4096
#: The table of sources is broadcast up to so many rows.
SMALL = 20_000


def sized(docs: DataFrame, *keep: str) -> DataFrame:
    """row, doc_id, source, key, size and shuffle of every row, and the columns to keep; staged, so rows stay the same."""
    return staged(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").alias("source"),
            F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("source"))).alias("key"),
            F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))).cast("binary")).alias("shuffle"),
            *(F.col(c).alias(f"kept_{c}") for c in keep),
        ),
        "sizes",
    )


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """key, source, source_size, target of every source.

    Sources that stop at their cap are those with the least cap for their weight; the first level at which the rest
    stays below its own caps is the level of all.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    by_ratio = Window.orderBy("ratio", "key").rowsBetween(Window.unboundedPreceding, -1)
    n = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (n % len(weights) + 1).cast("int"))
    sources = sizes.groupBy("key", "source").agg(F.sum("size").alias("source_size")).withColumn("weight", weight)
    cap = F.col("source_size").cast("double") * most
    everything = Window.partitionBy(F.lit(0))
    level = sources.withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("weight"))
    level = level.withColumn("rest", F.sum("source_size").over(everything).cast("double") * share - F.coalesce(F.sum("cap").over(by_ratio), F.lit(0.0)))
    level = level.withColumn("rest_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0.0)))
    level = level.withColumn("level", F.col("rest") / F.col("rest_weight"))
    top = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything)
    return level.withColumn("top", top).select("key", "source", "source_size", F.least("cap", F.coalesce(F.col("top") * F.col("weight"), F.col("cap"))).alias("target"))


def block_of(words: int, sources: int, slots: int = SLOTS) -> tuple[int, int]:
    """(words of a block, number of slots) of a mix of so many words."""
    block = max(1, -(-words // max(slots, EACH * sources)))
    return block, (2 * words + block) // (2 * block)


def needs(sources: DataFrame) -> DataFrame:
    """key, lo, hi: where the targets, rounded to words and laid end to end, begin and end."""
    need = sources.select("key", F.floor(F.col("target") + 0.5).cast("long").alias("need")).filter("need > 0")
    return need.select("key", F.sum("need").over(Window.orderBy("key")).alias("hi"), "need").select("key", (F.col("hi") - F.col("need")).alias("lo"), "hi")


def schedule(sources: DataFrame, slots: int = SLOTS) -> tuple[DataFrame, int, int]:
    """(key, rank, slot: which block of which source fills each slot; the words of a block; the number of slots)."""
    spans = staged(needs(sources), "needs")
    words, many = spans.agg(F.coalesce(F.max("hi"), F.lit(0)), F.count("*")).first()
    block, n = block_of(words, many, slots)
    cell = lambda at: F.floor(at * F.lit(float(CELLS)) / F.lit(float(max(words, 1)))).cast("int")
    cells = spans.withColumn("cell", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi") - 1))))
    point = F.col("slot") * F.lit(GOLDEN)
    dealt = sources.sparkSession.range(n).withColumnRenamed("id", "slot")
    dealt = dealt.withColumn("at", F.least(F.floor((point - F.floor(point)) * F.lit(float(words))).cast("long"), F.lit(words - 1)))
    dealt = dealt.withColumn("cell", cell(F.col("at"))).join(F.broadcast(cells) if many <= SMALL else cells, "cell").filter("at >= lo and at < hi")
    rank = F.row_number().over(Window.partitionBy("key").orderBy("slot")) - 1  # a source's slots: SLOTS in all
    return staged(dealt.select("key", rank.cast("long").alias("rank"), "slot"), "schedule", rows=n), block, n


def placed(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """sizes with source_size, target and the place of each row's first word in its source's stream."""
    cut = sizes.drop("source").withColumn("bucket", F.conv(F.substring("shuffle", 1, BUCKET_DIGITS), 16, 10).cast("int"))
    sums = running(cut.groupBy("key", "bucket").agg(F.sum("size").alias("n")), "bucket", "n").drop("n")
    within = F.sum("size").over(Window.partitionBy("key", "bucket").orderBy("shuffle", "row").rowsBetween(Window.unboundedPreceding, 0))
    out = cut.withColumn("within", within - F.col("size")).join(sums, ["key", "bucket"]).withColumn("first", F.col("before") + F.col("within"))
    few = len(sources.limit(SMALL + 1).select("key").collect()) <= SMALL
    return out.join(F.broadcast(sources) if few else sources, "key").drop("before", "within", "bucket")


def mix(rows: DataFrame, sources: DataFrame, slots: int = SLOTS) -> DataFrame:
    """slot, key, rank, row, epoch, first, words: which words of which row fill each slot, from ``placed`` rows."""
    plan, block, n = schedule(sources, slots)
    twice = rows.withColumn("epoch", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("from", F.col("first") + F.col("epoch") * F.col("source_size"))
    twice = twice.withColumn("to", F.col("from") + F.col("size")).filter("size > 0")
    ranks = F.sequence(F.floor(F.col("from") / block).cast("long"), F.floor((F.col("to") - 1) / block).cast("long"))
    parts = twice.select("row", "key", "epoch", "from", "to", F.explode(ranks).alias("rank"))
    begin, end = F.greatest("from", F.col("rank") * block), F.least("to", (F.col("rank") + 1) * block)
    parts = parts.select("row", "key", "epoch", "rank", (begin - F.col("from")).alias("first"), (end - begin).alias("words"))
    return parts.join(F.broadcast(plan) if n <= BROADCAST_ROWS else plan, ["key", "rank"])


def taken_of(sizes: DataFrame) -> DataFrame:
    """row, doc_id, size, source_size, target, taken, slot (the first that takes the row; -1: none), again (the first of
    its second time) and shuffle of every row of ``sized``."""
    slim = sizes.select("row", "doc_id", "source", "key", "size", "shuffle")
    sources = staged(targets(slim), "sources")
    rows = staged(placed(slim, sources), "places", rows=slim.count())
    at = [F.coalesce(F.min(F.when(F.col("epoch") == k, F.col("slot"))), F.lit(-1)).alias(name) for k, name in enumerate(("slot", "again"))]
    words = mix(rows, sources).groupBy("row").agg(F.sum("words").alias("taken"), *at)
    kept = [F.coalesce(c, F.lit(d)).cast("long").alias(c) for c, d in (("taken", 0), ("slot", -1), ("again", -1))]
    return rows.join(words, "row", "left").select("row", "doc_id", "size", "source_size", "target", *kept, "shuffle")


def taken(docs: DataFrame) -> DataFrame:
    """row, doc_id, size, source_size, target, taken, slot of every row."""
    return taken_of(sized(docs)).drop("again", "shuffle")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as whole rows of docs, in the order of their slots: each as often as its taken words make up its size, rounded."""
    sizes = sized(docs, *docs.columns)
    copies = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    chosen = taken_of(sizes).filter("size > 0").select("row", copies.alias("copies"), "slot", "again").filter("copies > 0")
    chosen = staged(chosen, "copies", rows=sizes.select("row").count())
    rows = sizes.join(broadcast_if_small(chosen), "row").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    at = F.when((F.col("copy") == 2) & (F.col("again") >= 0), F.col("again")).otherwise(F.col("slot"))
    return rows.withColumn("at", at).orderBy("at", "shuffle", "copy").select(*(F.col(f"kept_{c}").alias(c) for c in docs.columns))


#: The same for DuckDB: the schedule slot by slot, and the blocks that its slots take of each source's stream.
SQL = f"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS shuffle, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS key
  FROM documents),
ranked AS (
  SELECT key, source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS n
  FROM sizes GROUP BY key, source),
weighed AS (
  SELECT key, source, source_size, source_size::DOUBLE * 2 AS cap, CASE n % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM ranked),
levels AS (
  SELECT *, cap / weight AS ratio,
         ((SELECT sum(source_size) FROM weighed)::DOUBLE * 1.5 - coalesce(sum(cap) OVER w, 0))
         / ((SELECT sum(weight) FROM weighed) - coalesce(sum(weight) OVER w, 0)) AS level
  FROM weighed WINDOW w AS (ORDER BY cap / weight, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT key, source_size, least(cap, coalesce((SELECT max(level) FROM levels WHERE level <= ratio) * weight, cap)) AS target
  FROM levels),
spans AS (
  SELECT key, need, (sum(need) OVER (ORDER BY key))::BIGINT AS hi FROM (SELECT key, floor(target + 0.5)::BIGINT AS need FROM targets) WHERE need > 0),
plan AS (
  SELECT words, block, (2 * words + block) // (2 * block) AS n
  FROM (SELECT max(hi) AS words, greatest({SLOTS}, {EACH} * count(*)) AS m, greatest(1, (max(hi) + m - 1) // m)::BIGINT AS block FROM spans)),
slots AS (
  SELECT k AS slot, block, least(floor((k * '{GOLDEN!r}'::DOUBLE - floor(k * '{GOLDEN!r}'::DOUBLE)) * words::DOUBLE)::BIGINT, words - 1) AS p
  FROM plan, range((SELECT n FROM plan)) t(k)),
dealt AS (
  SELECT key, slot, block, row_number() OVER (PARTITION BY key ORDER BY slot) - 1 AS rank FROM slots JOIN spans ON p >= hi - need AND p < hi),
streams AS (
  SELECT s.doc_id, s.key, s.size, t.source_size, t.target,
         (sum(s.size) OVER (PARTITION BY s.key ORDER BY s.shuffle ROWS UNBOUNDED PRECEDING))::BIGINT - s.size AS f,
         coalesce((SELECT count(*) * any_value(block) FROM dealt d WHERE d.key = s.key), 0)::BIGINT AS reach
  FROM sizes s JOIN targets t ON s.key = t.key)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(f + size, reach) - f) + greatest(0, least(f + source_size + size, reach) - f - source_size))::BIGINT AS taken,
       coalesce(CASE WHEN size > 0 THEN d.slot END, -1)::BIGINT AS slot
FROM streams LEFT JOIN dealt d ON d.key = streams.key AND d.rank = f // (SELECT block FROM plan)
"""
