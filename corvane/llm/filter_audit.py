"""What each filter removes, in every order in which the filters can be applied.

A document fails a set of filters, its mask.  In a given order it is removed by
the first filter of its mask, so all that matters is how many documents of a
part have each mask: at most 2^n rows a part, whatever the size of the corpus.
The orders are numbered by their Lehmer rank, which is lexicographic.  The
orders in which a mask is removed at a step by a certain filter after certain
others share their first letters, so they are one interval of ranks.  The
documents of a mask are added where its intervals begin and taken off where
they end, and a running sum over the ranks gives what each step of each order
removes.  DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm.staging import staged

MIN_WORDS = 200
DISTINCT_PERCENT = 50
CAPITALS_PERCENT = 3
SYMBOLS = r"[#$%&*|]"
WORD_BREAKS = r"[\x20\x09-\x0D]+"
#: With n filters there are n! orders and n! * n rows a part.
MOST_FILTERS = 7
FIGURES = ("documents", "good", "toxic")


def removal_intervals(n: int) -> list[tuple[int, int, int, int]]:
    """``(mask, step, first rank, rank after the last)`` of every interval of orders in which ``mask`` goes at ``step``.

    Filter k is bit k.  An interval is a beginning of orders: filters outside
    the mask, then one of it; what follows is free.
    """
    found = []
    for mask in range(1, 2**n):
        outside = [k for k in range(n) if not mask >> k & 1]
        for passed in range(len(outside) + 1):
            for before in permutations(outside, passed):
                for last in (k for k in range(n) if mask >> k & 1):
                    beginning, rank = (*before, last), 0
                    for place, k in enumerate(beginning):
                        smaller = sum(1 for other in range(k) if other not in beginning[:place])
                        rank += smaller * factorial(n - 1 - place)
                    found.append((mask, passed + 1, rank, rank + factorial(n - 1 - passed)))
    return found


def filter_orders(spark: SparkSession, letters: Sequence[str]) -> DataFrame:
    """``(rank, filter_order, step, filter)``: every order of the filters, by Lehmer rank, and its steps."""
    rows = [(rank, "".join(order), step, name) for rank, order in enumerate(permutations(letters)) for step, name in enumerate(order, 1)]
    return spark.createDataFrame(rows, "rank int, filter_order string, step int, filter string")


def mask_of(failures: Mapping[str, Column]) -> Column:
    """One number for the failed filters, bit k for the k-th; a condition that is null does not fail."""
    bits = [F.coalesce(failed, F.lit(False)).cast("int") * (1 << k) for k, failed in enumerate(failures.values())]
    return sum(bits[1:], bits[0])


def audit(masks: DataFrame, letters: Sequence[str]) -> DataFrame:
    """``masks (part, mask, documents, good, toxic)`` -> a row per part, order and step.

    ``masks`` may have several rows of a part and mask.  Result: part,
    filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley.  A null part is one of its own, an empty table gives
    an empty result, and steps that remove nothing are there with zeros.
    """
    letters = list(letters)
    n = len(letters)
    if not 1 <= n <= MOST_FILTERS or len(set(letters)) != n or any(len(x) != 1 for x in letters):
        raise ValueError(f"1 to {MOST_FILTERS} filters with different names of one letter")
    spark = masks.sparkSession
    counted = staged(masks.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in FIGURES]), "filter-masks")

    # Bounded by the number of filters alone: the intervals, the orders and the filters.
    intervals = F.broadcast(spark.createDataFrame(removal_intervals(n), "mask int, step int, first int, after int"))
    ends = F.explode(F.array(F.struct(F.col("first").alias("rank"), F.lit(1).alias("sign")), F.struct(F.col("after").alias("rank"), F.lit(-1).alias("sign")))).alias("end")
    changes = counted.join(intervals, "mask").select("part", "step", ends, *FIGURES)
    changes = changes.groupBy("part", "step", F.col("end.rank").alias("rank")).agg(*[F.sum(F.col(c) * F.col("end.sign")).alias(c) for c in FIGURES])

    bits = F.explode(F.array(*[F.struct(F.lit(x).alias("filter"), F.col("mask").bitwiseAND(F.lit(1 << k)).alias("bit")) for k, x in enumerate(letters)])).alias("f")
    fails = counted.select("part", "mask", "documents", bits).groupBy("part", "f.filter").agg(
        F.sum("documents").alias("all_documents"),
        F.sum(F.when(F.col("f.bit") > 0, F.col("documents")).otherwise(0)).alias("fails"),
        F.sum(F.when((F.col("f.bit") > 0) & (F.col("f.bit") == F.col("mask")), F.col("documents")).otherwise(0)).alias("unique_fails"),
    )
    grid = fails.join(F.broadcast(filter_orders(spark, letters)), "filter")

    same = [F.col(f"g.{c}").eqNullSafe(F.col(f"c.{c}")) for c in ("part", "step", "rank")]
    so_far = Window.partitionBy("g.part", "g.step").orderBy("g.rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = grid.alias("g").join(changes.alias("c"), same, "left").select("g.*", *[F.sum(F.coalesce(F.col(f"c.{c}"), F.lit(0))).over(so_far).alias(c) for c in FIGURES])
    by_step = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return swept.select(
        "part",
        "filter_order",
        "step",
        (F.col("all_documents") - F.sum("documents").over(by_step)).alias("kept"),
        F.col("documents").alias("removed"),
        (F.col("fails") - F.col("documents")).alias("redundant"),
        "unique_fails",
        F.col("good").alias("good_lost"),
        F.col("toxic").alias("toxic_lost"),
        F.sum("documents").over(Window.partitionBy("part", "filter")).alias("shapley"),
    )


def text_failures(text: Column) -> dict[str, Column]:
    """Filters that need the text alone, as conditions to fail: A short, B repetitive, C loud, D symbols."""
    words = F.filter(F.split(text, WORD_BREAKS), lambda w: w != "")
    n = F.size(words)
    return {
        "A": n < MIN_WORDS,
        "B": F.size(F.array_distinct(words)) * 100 < n * DISTINCT_PERCENT,
        "C": F.regexp_count(text, F.lit("[A-Z]")) * 100 > F.length(text) * CAPITALS_PERCENT,
        "D": text.rlike(SYMBOLS),
    }


def document_masks(
    docs: DataFrame,
    labels: DataFrame,
    part: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(part, mask, documents, good, toxic)`` for the filters A to E; E fails copies of a text with a smaller id.

    Null text is empty.  ``part`` is the language, empty where null.  A row
    without an id has no label, is no smaller id to others and never fails E;
    rows that repeat the smallest id of a text pass E too.  Where labels repeat
    an id, one that says 1 is enough.  Only hashes of the texts (SHA-256) are
    shuffled.  Equal rows are counted before they are, and so are the rows of a
    text in a part, so many copies of a text are no hot group; rows without an
    id are dealt out by their text.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    part = F.coalesce(F.col("lang"), F.lit("")) if part is None else part
    rows = docs.select(F.col(id_col).cast("long").alias("id"), part.alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("sha"), mask_of(text_failures(text)).alias("mask"))
    rows = rows.groupBy("id", "part", "sha", "mask").agg(F.count("*").alias("documents"))

    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id"))
    known = known.agg(*[F.max((F.col(label) == 1).cast("int")).alias(name) for label, name in (("quality", "is_good"), ("toxic", "is_toxic"))])
    known = known.where("is_good = 1 OR is_toxic = 1").withColumn("spread", F.lit(0).cast("long"))
    # Ids of a large corpus do not fit a broadcast, however small Spark takes their files to be.
    spread = F.when(F.col("id").isNull(), F.xxhash64("sha")).otherwise(F.lit(0).cast("long"))
    rows = rows.withColumn("spread", spread).join(known.hint("merge"), ["id", "spread"], "left")

    figures = [F.col("documents"), F.col("documents") * F.coalesce("is_good", F.lit(0)), F.col("documents") * F.coalesce("is_toxic", F.lit(0))]
    figures = [f.alias(name) for f, name in zip(figures, FIGURES)]
    first = F.min(F.when(F.col("id").isNotNull(), F.struct("id", *FIGURES)))
    texts = rows.select("id", "part", "sha", "mask", *figures).groupBy("sha", "part", "mask").agg(
        *[F.sum(c).alias(c) for c in FIGURES],
        F.sum(F.when(F.col("id").isNull(), F.col("documents")).otherwise(0)).alias("nameless"),
        first.alias("first"),
    )
    # A row per text and part: the parts of a text, not its copies.
    least = F.min("first.id").over(Window.partitionBy("sha"))
    stays = F.col("first.id") == least
    spared = {c: F.coalesce(F.when(stays, F.col(f"first.{c}")), F.lit(0)) for c in FIGURES}
    spared["documents"] = spared["documents"] + F.col("nameless")
    split = texts.select("part", "mask", *FIGURES, F.struct(*[v.alias(c) for c, v in spared.items()]).alias("spared"))
    passing = F.struct("mask", *[F.col(f"spared.{c}").alias(c) for c in FIGURES])
    failing = F.struct(F.col("mask").bitwiseOR(F.lit(1 << 4)).alias("mask"), *[(F.col(c) - F.col(f"spared.{c}")).alias(c) for c in FIGURES])
    masks = split.select("part", F.explode(F.array(passing, failing)).alias("m")).select("part", "m.*")
    return masks.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in FIGURES])


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "labels"))
    return audit(document_masks(docs, labels), "ABCDE")


SQL = """
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words
  FROM documents),
failed AS (
  SELECT doc_id, part,
         len(words) < 200 AS a,
         100 * len(list_distinct(words)) < 50 * len(words) AS b,
         100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS c,
         regexp_matches(t, '[#$%&*|]') AS d,
         coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e
  FROM texts),
known AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
masks AS (
  SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, count(*) AS documents,
         count(*) FILTER (known.good) AS good, count(*) FILTER (known.toxic) AS toxic
  FROM failed LEFT JOIN known USING (doc_id) GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS filter_order
  FROM letters p, letters q, letters r, letters s, letters t
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
steps AS (
  SELECT filter_order, step, filter_order[step] AS letter, (1 << (ascii(filter_order[step]) - 65)) AS bit,
         list_sum([1 << (ascii(filter_order[k]) - 65) FOR k IN range(1, 6) IF k < step]) AS before
  FROM orders, (SELECT unnest(range(1, 6)) AS step)),
figures AS (
  SELECT part, filter_order, step, letter,
         coalesce(sum(documents) FILTER (mask & (bit | coalesce(before, 0)::INT) = 0), 0) AS kept,
         coalesce(sum(documents) FILTER (mask & bit > 0 AND mask & coalesce(before, 0)::INT = 0), 0) AS removed,
         coalesce(sum(documents) FILTER (mask & bit > 0 AND mask & coalesce(before, 0)::INT > 0), 0) AS redundant,
         coalesce(sum(documents) FILTER (mask = bit), 0) AS unique_fails,
         coalesce(sum(good) FILTER (mask & bit > 0 AND mask & coalesce(before, 0)::INT = 0), 0) AS good_lost,
         coalesce(sum(toxic) FILTER (mask & bit > 0 AND mask & coalesce(before, 0)::INT = 0), 0) AS toxic_lost
  FROM masks, steps GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM figures
"""
