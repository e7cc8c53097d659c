"""Mixing sources to target weights, with DataFrame functions only.

Sizes are words per document; they are summed per source, each source gets a
target, and the repetition rate of a source is target / size.  A document is
emitted ``floor(rate)`` times plus one more time when a hash falls below the
fraction of the rate: that of its id, or where others have the id or it is
null, that of id, text and its number among equal rows, so that such rows are
drawn each for itself and their source meets its target too.  No document is shuffled by source: the table
of sources is written first and sent to all tasks while it has a bounded number
of rows; beyond that a salt spreads the documents of each source.  Only rows
that share an id are shuffled to be numbered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.staging import BROADCAST_ROWS, fresh, quoted, staged

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
CEILING = 2.0
SEED = "mix-1"
#: Parts of a source where the table of sources is too large to be sent to all tasks.
SALTS = 32


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def unit_hash(key: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the first 32 bits of the MD5 of the key and the seed."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit("|" + seed)).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def draws(docs: DataFrame, name: str, id_col: str, text: Column, source_col: str, seed: str, most_ids: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` with a column ``name``: the number in [0, 1) that a row is drawn by.

    Equal rows are interchangeable, so it does not matter which of them gets
    which number; they are counted by task and numbered from there, so that
    many of them are no group of one task.
    """
    key = F.col(id_col)
    shared = docs.groupBy(key.alias("shared_id")).agg(F.count("*").alias("n")).where("shared_id IS NULL OR n > 1").select("shared_id")
    shared = staged(shared, "shared-ids")
    n_shared = shared.count()
    alone = docs.withColumn(name, unit_hash(key, seed))
    if not n_shared:
        return alone
    side = F.broadcast(shared) if n_shared <= most_ids else shared.hint("merge")
    same = key.eqNullSafe(F.col("shared_id"))
    own = {c: fresh(docs, f"{name}_{c}") for c in ("text", "task", "row")}
    several = docs.join(side, same, "left_semi").withColumns({own["text"]: F.md5(text.cast("binary")), own["task"]: F.spark_partition_id(), own["row"]: F.monotonically_increasing_id()})
    several = staged(several, "shared-rows")
    equal = [F.col(id_col), F.col(source_col), F.col(own["text"])]
    tasks = several.groupBy(*[c.alias(f"k{i}") for i, c in enumerate(equal)], F.col(own["task"]).alias("k3")).agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("k0", "k1", "k2").orderBy("k3").rowsBetween(Window.unboundedPreceding, -1)
    tasks = tasks.select(F.struct("k0", "k1", "k2", "k3", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")).alias(name))
    nth = F.row_number().over(Window.partitionBy(*equal, own["task"]).orderBy(own["row"]))
    numbered = several.withColumn(own["row"], nth)
    meets = [a.eqNullSafe(F.col(f"{name}.k{i}")) for i, a in enumerate([*equal, F.col(own["task"])])]
    numbered = numbered.join(tasks, meets)
    number = (F.col(f"{name}.before") + F.col(own["row"])).cast("string")
    drawn = unit_hash(F.concat_ws("|", F.coalesce(key.cast("string"), F.lit("null")), F.col(own["text"]), number), seed)
    rest = alone.join(side, same, "left_anti")
    return rest.unionByName(numbered.select(*quoted(docs), drawn.alias(name)))


def source_targets(
    sizes: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    budget: float = BUDGET,
    ceiling: float = CEILING,
) -> DataFrame:
    """``(source, source_size)`` -> ``(source, source_size, target)``.

    ``budget`` times all sizes is shared by weight (the weights repeat over the
    sources by code point, null last).  No target passes ``ceiling`` times its
    source; the excess is shared again by weight.  With sources in order of
    ``ceiling * size / weight`` the first ones are capped, and the share per
    unit of weight of the others follows from running sums, so one pass over
    the table of sources (one row each, already aggregated) settles it.
    A source of size 0 has target 0.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    nth = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (nth % len(weights)).cast("int") + 1)
    ranked = sizes.select("source", F.col("source_size").cast("long").alias("source_size"), weight.alias("w"))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(ceiling)))
    ratio = F.col("cap") / F.col("w")
    order = Window.orderBy(ratio, F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    ranked = (
        ranked.withColumn("capped_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("left_w", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        .withColumn("total", F.sum("source_size").over(whole) * F.lit(float(budget)))
        .withColumn("level", (F.col("total") - F.col("capped_before")) / F.col("left_w"))
        .withColumn("free", ratio >= F.col("level"))
    )
    level = F.min(F.when(F.col("free"), F.struct(ratio.alias("ratio"), F.col("level")))).over(whole)["level"]
    target = F.coalesce(F.least(F.col("cap"), level * F.col("w")), F.col("cap"))
    return ranked.withColumn("target", target).select("source", "source_size", "target")


def mix_plan(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    budget: float = BUDGET,
    ceiling: float = CEILING,
    seed: str = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    size_col: str | None = None,
    most_sources: int = BROADCAST_ROWS,
    most_ids: int = BROADCAST_ROWS,
) -> DataFrame:
    """``docs`` with one more column, the last: a struct of size, source_size, target and copies.

    It is named ``mix_plan``, or longer where the input has a column of that
    name.  Sizes are counted from the whole text, or taken from ``size_col``.
    ``text_col`` may hold a hash of the text then.  Null text has size 0; a null
    source is a source of its own; an empty table gives an empty result;
    repeated rows, rows that share an id and rows without one count each time
    and are drawn each for itself.
    """
    name = fresh(docs, "mix_plan")
    draw = fresh(docs, "mix_draw")
    drawn = draws(docs, draw, id_col, F.coalesce(F.col(text_col), F.lit("")), source_col, seed, most_ids)
    size = word_count(F.col(text_col)) if size_col is None else F.col(size_col)
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(size).alias("source_size"))
    targets = staged(source_targets(sizes, weights, budget, ceiling), "source-targets")
    goal = fresh(docs, "mix_target")
    targets_fit = targets.count() <= most_sources
    if targets_fit:
        side = F.broadcast(targets.select(F.struct("*").alias(goal)))
        same = F.col(source_col).eqNullSafe(F.col(f"{goal}.source"))
    else:
        side = targets.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).select(F.struct("*").alias(goal)).hint("merge")
        salt = F.pmod(F.xxhash64(F.col(id_col), F.monotonically_increasing_id()), F.lit(SALTS))
        same = F.col(source_col).eqNullSafe(F.col(f"{goal}.source")) & (F.col(name) == F.col(f"{goal}.salt"))
    salted = drawn if targets_fit else drawn.withColumn(name, salt)
    joined = salted.join(side, same, "left")
    source_size, target = F.col(f"{goal}.source_size"), F.col(f"{goal}.target")
    rate = F.when(source_size > 0, target / source_size).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    extra = (F.col(draw) < rate - whole).cast("long")
    plan = F.struct(size.alias("size"), source_size.alias("source_size"), target.alias("target"), (whole + extra).cast("long").alias("copies"))
    return joined.select(*quoted(docs), plan.alias(name))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus itself: each document as often as its plan says, columns unchanged."""
    planned = mix_plan(docs, **options)
    name = planned.columns[-1]
    copies = F.explode(F.array_repeat(F.lit(1), F.col(f"{name}.copies").cast("int")))
    return planned.select(*quoted(docs), copies.alias(name)).drop(name)


def op9_source_mix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # What the operator needs of a text: its size, and a hash that tells rows of one id apart.
    text = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text")
    sized = staged(docs.select("doc_id", "source", text, word_count(F.col("text")).alias("size")), "sizes")
    plan = F.col("mix_plan")
    return mix_plan(sized, size_col="size").select(
        "doc_id",
        "size",
        plan["source_size"].alias("source_size"),
        plan["target"].alias("target"),
        (plan["size"] * plan["copies"]).alias("taken"),
    )


SQL = """
WITH sized AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5(md5(coalesce(text, ''))) AS h, count(*) OVER (PARTITION BY doc_id) AS shared,
         row_number() OVER (PARTITION BY doc_id, source, md5(coalesce(text, ''))) AS nth
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT source, source_size, source_size * 2.0::DOUBLE AS cap,
         CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM sources),
levels AS (
  SELECT *, cap / w AS ratio,
         (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE
          - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
         / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE)) AS level
  FROM weighted),
targets AS (
  SELECT source, source_size,
         coalesce(least(cap, (SELECT arg_min(level, ratio) FROM levels WHERE ratio >= level) * w), cap) AS target
  FROM levels),
rates AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
         ('0x' || substr(md5(CASE WHEN s.doc_id IS NULL OR s.shared > 1 THEN coalesce(s.doc_id::VARCHAR, 'null') || '|' || s.h || '|' || s.nth ELSE s.doc_id::VARCHAR END || '|mix-1'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate)::BIGINT + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rates
"""
