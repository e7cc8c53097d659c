"""Connected components of links, and one row of each group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.staging import BROADCAST_ROWS, fresh, join_side, quoted, scratch, staged


def connected(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links (a, b)``, root being the smallest node of its component.

    Alternating large-star and small-star rounds until nothing changes; each is
    written to the shared folder.
    """

    def star(both: DataFrame, large: bool, most: int) -> DataFrame:
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        joined = both.join(join_side(least, most), "a")
        if large:
            return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.where("a <> m").select("a", F.col("m").alias("b")))

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.lit(0))).first())

    with scratch(links.sparkSession):
        edges = staged(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
        seen, now = (-1, -1), mark(edges)
        while now != seen and now[0]:
            seen = now
            both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            wide = star(both, True, 2 * seen[0]).where("a <> b").distinct()
            edges = staged(star(wide, False, 2 * seen[0]).where("a <> b").distinct(), "links")
            now = mark(edges)
        return staged(edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct()), "roots", lasting=True)


def text_mark(text_col: str = "text"):
    """A hash by which rows with one text are told from the others; a null text counts as empty."""
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def one_of_each(docs: DataFrame, rows: DataFrame, roots: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group, the one with the smallest id; columns unchanged.

    ``rows`` is ``(doc_id, mark)`` of every row, ``mark`` being its
    :func:`text_mark`, and ``roots`` is ``(mark, root)``; a mark without a root
    is a group of its own.  A null id is chosen only in a group without other
    ids.  Rows are found by id and text, so rows that share an id but no group,
    or have none, stay apart.  Of rows with one id and one text the first by
    all columns as text stays.
    """
    name = fresh(docs, "group_row")
    # Copies of a text are counted before they meet their group, so that no text, however frequent, gathers its rows.
    alike = rows.groupBy("doc_id", "mark").agg(F.count("*").alias("rows"))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark", "rows")
    texts = alike.groupBy("mark").agg(F.min(order).alias("c"))
    named = texts.join(join_side(roots, roots.count()), "mark", "left").select(F.coalesce("root", "mark").alias("root"), "c")
    chosen = staged(named.groupBy("root").agg(F.min("c").alias("c")).select("c.doc_id", "c.mark", "c.rows"), "chosen", lasting=True)
    same = F.col("x.doc_id").eqNullSafe(F.col("y.doc_id")) & (F.col("x.mark") == F.col("y.mark"))
    dropped = alike.select("doc_id", "mark").alias("x").join(chosen.alias("y").hint("merge"), same, "left_anti")
    dropped = staged(dropped.select(F.struct("doc_id", "mark").alias(name)), "dropped", lasting=True)
    several = chosen.where("rows > 1").select(F.struct("doc_id", "mark").alias(name))

    def found(side: DataFrame, how: str) -> DataFrame:
        few = side.count() <= BROADCAST_ROWS
        match = (text_mark(text_col) == F.col(f"{name}.mark")) & F.col(id_col).cast("long").eqNullSafe(F.col(f"{name}.doc_id"))
        return docs.join(F.broadcast(side) if few else side.hint("merge"), match, how)

    kept = found(dropped, "left_anti")
    if not several.limit(1).count():
        return kept
    # Some ids repeat with their text: of these rows one stays.
    repeated = staged(several, "repeated", lasting=True)
    docs, all_docs = kept, docs
    once = found(repeated, "left_anti")
    again = found(repeated, "inner")
    place = fresh(again, "place")
    by_all = Window.partitionBy(f"{name}.doc_id", f"{name}.mark").orderBy(*[F.col(c).cast("string") for c in quoted(all_docs)])
    first = again.withColumn(place, F.row_number().over(by_all)).where(F.col(place) == 1).select(*quoted(all_docs))
    return once.unionByName(first)
