"""Operator 5: mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sonolith.llm.textops import fresh_name
from sonolith.session import stash, table

#: Weights of the sources in code-point order, repeating; the budget and the most copies of a document.
WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MOST = 2
#: Words that are served at once: a longer document is served in packets.
PACKET = 256
#: Leading hex digits of the shuffle key that make a bucket: 16**4 buckets a source.
DIGITS = 4
#: Packets of a bucket of virtual time, about.
BUCKET_PACKETS = 1 << 16
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str = "text") -> Column:
    """Number of words; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ahead(rows: DataFrame, order: list[Column | str], sums: dict[str, str]) -> DataFrame:
    """rows with, by name in sums, the sum of that column (long) over the rows that go before in a total order.

    Two levels: rows are dealt to ranges of the order, sums of the ranges are added up, then rows within each range."""
    part = fresh_name(rows, "part")
    placed = stash(rows.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "ranges")
    totals = placed.groupBy(part).agg(*[F.sum(c).alias(name) for name, c in sums.items()])
    base = totals.select(part, *[F.coalesce(F.sum(name).over(W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(name) for name in sums])  # a row a range
    within = W.partitionBy(part).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    joined = placed.join(F.broadcast(base), part)
    return joined.select(*rows.columns, *[(F.col(name) + F.coalesce(F.sum(c).over(within), F.lit(0))).alias(name) for name, c in sums.items()])


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target: BUDGET times all sizes, shared by weight; a share stops at MOST times its source's
    size and the excess goes to the others by weight.

    In order of cap / weight, sources are capped as long as the level (what is left, by the weight that is left) is
    above their ratio."""
    own = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(1))
    ranked = ahead(own, [F.col("source").isNull(), F.col("source")], {"rank": "one"})
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * MOST).withColumn("ratio", F.col("cap") / F.col("weight"))
    total, heavy = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    placed = ahead(ranked, [F.col("ratio"), F.col("rank")], {"caps": "cap", "weights": "weight"})
    leveled = placed.withColumn("level", (F.lit(BUDGET * (total or 0)) - F.col("caps")) / (F.lit(float(heavy or 0)) - F.col("weights")))
    level = leveled.agg(F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level")))).first()[0]
    return leveled.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(level["level"] if level else 0.0)).alias("target"))


@dataclass
class Cut:
    """Where the queue is cut: the packet in which the budget is spent - its virtual finish time, its source and the words
    of the source served by its end - and how many of its words are taken. All of the packets before it are."""

    finish: float
    null: bool
    name: str
    at: int
    words: int


class Queue:
    """The queue of all documents' packets; Queue(sizes) plans it from rows (doc_id, source, size).

    Documents of a source are shuffled by md5 of seed and doc_id and served one after the other, again from the start
    after the last, up to MOST times, in packets of up to PACKET words. A packet's virtual finish time is the words of its
    source served by its end, divided by the source's target. All packets go in order of that time, ties by source (null
    last); the queue is cut where the budget, BUDGET times all sizes, is spent.

    A source may hold any share of all rows: its words are added up by (source, bucket of the shuffle key), then within a
    bucket. The queue is added up by buckets of virtual time, in which all sources are served at an even rate, and then
    within the one bucket where the budget is spent.
    """

    def __init__(self, sizes: DataFrame, seed: str = "mix"):
        self.seed = seed
        self.sources = stash(targets(sizes), "targets")
        null, name = F.col("source").isNull().alias("__null"), F.coalesce("source", F.lit("")).alias("__name")
        sums = sizes.groupBy(null, name, F.substring(self._key(F.col("doc_id"), F.col("size")), 1, DIGITS).alias("__bucket")).agg(F.sum("size").alias("words"))
        before = W.partitionBy("__null", "__name").orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)  # of a source at most 16**DIGITS rows
        to = self.sources.select(null, name, F.col("source_size").alias("__source_size"), F.col("target").alias("__target"))
        self.base = stash(sums.withColumn("__base", F.coalesce(F.sum("words").over(before), F.lit(0))).drop("words").join(to, ["__null", "__name"]), "buckets")
        self.cut = self._cut(stash(self.timed(sizes.withColumnRenamed("size", "__size")), "queue"))

    def _key(self, doc_id: Column, size: Column) -> Column:
        return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.concat(F.lit("null"), size.cast("string"))), F.lit(f":{self.seed}")))

    def timed(self, docs: DataFrame) -> DataFrame:
        """docs (doc_id, source, __size and others) with __null, __name, __source_size, __target, __end: the words of the
        source by the document's end in the first lap."""
        null, name = F.col("source").isNull(), F.coalesce("source", F.lit(""))
        keyed = docs.withColumns({"__null": null, "__name": name, "__key": self._key(F.col("doc_id"), F.col("__size"))}).withColumn("__bucket", F.substring("__key", 1, DIGITS))
        within = W.partitionBy("__null", "__name", "__bucket").orderBy("__key", "doc_id", "__size").rowsBetween(W.unboundedPreceding, 0)
        joined = keyed.join(self.base, ["__null", "__name", "__bucket"])
        return joined.withColumn("__end", F.col("__base") + F.sum("__size").over(within)).drop("__bucket", "__key", "__base")

    def _cut(self, timed: DataFrame) -> Cut | None:
        n = F.ceil(F.col("__size") / PACKET).cast("long")
        total, packets = timed.agg(F.sum("__size"), F.sum(n)).first()
        budget = math.floor(BUDGET * (total or 0))
        if not budget:
            return None
        buckets = max(1, packets * MOST // BUCKET_PACKETS)
        place = F.explode(F.sequence(F.lit(0).cast("long"), n * MOST - 1)).alias("__place")
        each = timed.where("__size > 0").select("__null", "__name", "__source_size", "__target", "__end", "__size", n.alias("__n"), place)
        at, words = _packet(F.col("__place"), F.col("__n"))
        queue = each.select("__null", "__name", at.alias("at"), words.alias("words"), (at / F.col("__target")).alias("finish"))
        queue = queue.withColumn("bucket", F.floor(F.col("finish") * buckets))
        sums = ahead(queue.groupBy("bucket").agg(F.sum("words").alias("words")), [F.col("bucket")], {"before": "words"})
        bucket, before = sums.where((F.col("before") < budget) & (F.col("before") + F.col("words") >= budget)).select("bucket", "before").first()
        order = W.orderBy("finish", "__null", "__name", "at").rowsBetween(W.unboundedPreceding, 0)
        last = queue.where(F.col("bucket") == bucket).withColumn("by", F.sum("words").over(order) + before).where(F.col("by") >= budget)
        r = last.orderBy("by", "finish", "__null", "__name", "at").first()
        return Cut(r["finish"], r["__null"], r["__name"], r["at"], r["words"] - (r["by"] - budget))

    def taken(self) -> Column:
        """Words taken of a document of timed(): those of its packets that go before the cut."""
        if self.cut is None:
            return F.lit(0).cast("long")
        cut, n = self.cut, F.ceil(F.col("__size") / PACKET).cast("long")

        def words_of(place: Column) -> Column:
            at, words = _packet(place, n)
            finish = at / F.col("__target")
            source = F.struct(F.col("__null"), F.col("__name"), at)
            edge = F.struct(F.lit(cut.null), F.lit(cut.name), F.lit(cut.at).cast("long"))
            return F.when((finish < cut.finish) | (finish == cut.finish) & (source < edge), words).when((finish == cut.finish) & (source == edge), F.lit(cut.words).cast("long")).otherwise(F.lit(0).cast("long"))

        def lap(k: int) -> Column:
            end = (F.col("__end") + F.col("__source_size") * k) / F.col("__target")
            start = (F.col("__end") + F.col("__source_size") * k - F.col("__size")) / F.col("__target")
            one_by_one = F.aggregate(F.sequence(n * k, n * (k + 1) - 1), F.lit(0).cast("long"), lambda acc, x: acc + words_of(x))
            return F.when(end < cut.finish, F.col("__size")).when(start > cut.finish, F.lit(0).cast("long")).otherwise(one_by_one)

        return F.when(F.col("__size") > 0, sum((lap(k) for k in range(1, MOST)), lap(0))).otherwise(F.lit(0).cast("long"))


def _packet(place: Column, n: Column) -> tuple[Column, Column]:
    """Of a document with n packets a lap: the words of its source served by the end of a packet, and the packet's."""
    lap, k = F.floor(place / n), place % n
    end = F.least((k + 1) * PACKET, F.col("__size"))
    return F.col("__source_size") * lap + F.col("__end") - F.col("__size") + end, end - k * PACKET


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size of each row, counted once and kept in the shared folder."""
    return stash(docs.select("doc_id", "source", word_count().alias("size")), "sizes")


def mix_plan(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, finish (of its first lap) of each row, range-sorted by finish.

    Null text has size 0; a null source is a source of its own, the last one; a null doc_id is shuffled by its size.
    Repeated rows are served one after the other, each with its own words. Ties in the shuffle key go by doc_id, then
    size. Other columns are not read. An empty table gives no rows; sources of size 0 have target 0.
    """
    sizes = sized(docs)
    queue = Queue(sizes)
    finish = F.when(F.col("__target") > 0, F.col("__end") / F.col("__target"))
    timed = queue.timed(sizes.withColumnRenamed("size", "__size")).withColumns({"__finish": finish, "__taken": queue.taken()})
    return timed.select("doc_id", *(F.col(f"__{c}").alias(c) for c in ("size", "source_size", "target", "taken", "finish"))).orderBy(F.col("finish").asc_nulls_last(), "doc_id")


def mixed(docs: DataFrame) -> DataFrame:
    """The mix as documents: the rows of docs, each as often as the plan takes it (a document that the cut parts counts if
    at least half of it is taken). All columns of docs stay, whatever their names; texts are whole. Cases as in
    mix_plan()."""
    queue, whole = Queue(sized(docs)), fresh_name(docs, "whole")
    rows = docs.select("doc_id", "source", word_count().alias("__size"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(whole))
    copies = F.when(F.col("__size") > 0, F.floor(queue.taken() / F.col("__size") + 0.5)).otherwise(0).cast("int")
    served = queue.timed(rows).withColumn("__copies", copies)
    return served.select(whole, F.explode(F.array_repeat(F.lit(1), F.col("__copies"))).alias("__copy")).select(f"{whole}.*")


def op5_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents; cases as in mix_plan()."""
    return mix_plan(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
h AS (SELECT *, md5(coalesce(doc_id::VARCHAR, 'null' || size::VARCHAR) || ':mix') AS k FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM h GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS rank FROM s),
w AS (SELECT *, [5, 2, 1][(rank - 1) % 3 + 1] AS weight, 2 * source_size AS cap FROM r),
q AS (SELECT *, cap::DOUBLE / weight::DOUBLE AS ratio FROM w),
l AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
      - coalesce((sum(cap) OVER (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::DOUBLE, 0))
    / ((sum(weight) OVER ())::DOUBLE
      - coalesce((sum(weight) OVER (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::DOUBLE, 0)) AS level
  FROM q),
t AS (
  SELECT source, source_size, least(cap::DOUBLE, weight::DOUBLE
      * (SELECT level FROM l WHERE level <= ratio ORDER BY ratio, rank LIMIT 1)) AS target
  FROM l),
e AS (
  SELECT h.*, source_size, target, row_number() OVER () AS id, (sum(size) OVER (PARTITION BY h.source ORDER BY k, doc_id NULLS FIRST, size
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS done
  FROM h JOIN t ON h.source IS NOT DISTINCT FROM t.source),
p AS (SELECT id, source, source_size, target, done, size, lap.i AS lap, unnest(range((size + 255) // 256)) AS pk FROM e, range(2) lap(i) WHERE size > 0),
o AS (SELECT *, source_size * lap + done - size + least((pk + 1) * 256, size) AS place, least(256, size - pk * 256) AS words FROM p),
f AS (SELECT id, words, (sum(words) OVER (ORDER BY place::DOUBLE / target, source IS NULL, source, place ROWS UNBOUNDED PRECEDING))::BIGINT AS served FROM o),
x AS (
  SELECT id, sum(greatest(0, least(words, (SELECT floor(1.5::DOUBLE * sum(size)::DOUBLE)::BIGINT FROM d) - (served - words))))::BIGINT AS taken
  FROM f GROUP BY id)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken,
  CASE WHEN target > 0 THEN done::DOUBLE / target END AS finish
FROM e LEFT JOIN x ON e.id = x.id
"""
