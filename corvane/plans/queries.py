"""Registered queries: every operator over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.config import RetrievalSettings, Settings
from corvane.functions import text as T
from corvane.functions import vectors as V
from corvane.operators import answers, embedding, evaluation, identity, index, ranking, records, rerank
from corvane.operators.cells import CellIndex
from corvane.operators.chunking import chunk_documents
from corvane.operators.store import ParquetStore
from corvane.plans import sweep
from corvane.plans.engine import answer, part_of, passing_corpus, with_chunks
from corvane.sources.corpus import keep_documents
from corvane.sources.gold import gold_cases
from corvane.sources.shared import new_path, owned, scratch, staged

K = 4
WINDOW = 20
EXCLUDE = ("src1/*", "*7.md")
SIZES = {"fixed": (800, 120), "paragraph": (300, 60), "markdown": (300, 60)}


def spread(rows: DataFrame) -> DataFrame:
    """``rows``, dealt out anew only where their files give far fewer tasks than there are cores.

    Spark cuts files to a share for each core, but for 4 MB of opening; so a
    table that gives less than two thirds of the tasks has at most 8 MB a core.
    Larger ones may miss a few tasks and are not shuffled for these.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if 3 * rows.rdd.getNumPartitions() < 2 * cores else rows


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """``documents`` with a source path; a null text is empty."""
    docs = spread(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "source", "text"))
    return docs.select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text"), path_of(F.col("source"), F.col("doc_id")).alias("source_path"))


def path_of(source: Column, doc_id: Column) -> Column:
    return F.concat(source, F.lit("/"), doc_id.cast("string"), F.lit(".md"))


def benchmark(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")


def structured(text: Column, strategy: str) -> Column:
    """Texts have no blank lines or headings: every line becomes a paragraph, or a section of its own."""
    if strategy == "fixed":
        return text
    if strategy == "paragraph":
        return F.replace(text, F.lit("\n"), F.lit("\n\n"))
    return F.regexp_replace(text, r"\n(\w)", "\n\n# $1 part\n\n$1")


def chunks_of(spark: SparkSession, sf: str, strategy: str) -> DataFrame:
    docs = documents(spark, sf).select("source_path", structured(F.col("text"), strategy).alias("text"))
    return chunk_documents(docs, strategy, *SIZES[strategy])


def discover_filter(spark, sf):
    docs = documents(spark, sf)
    suffix = F.when(F.col("doc_id") % 5 == 0, ".TXT").when(F.col("doc_id") % 5 == 1, ".html").otherwise(".md")
    paths = docs.select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), suffix).alias("source_path"))
    return keep_documents(paths, EXCLUDE)


def source_checksum(spark, sf):
    return documents(spark, sf).select("source_path", T.checksum(T.unix_lines(F.col("text"))).alias("checksum"))


def _chunk_query(strategy: str):
    def run(spark, sf):
        c = chunks_of(spark, sf, strategy)
        return c.select("chunk_id", "chunk_index", "start_char", "end_char", "title", F.col("metadata.heading_level").alias("heading_level"), F.col("metadata.chunk_strategy").alias("chunk_strategy"), T.checksum(F.col("text")).alias("checksum"))

    return run


def chunk_stats(spark, sf):
    one = [chunks_of(spark, sf, s).select(F.lit(s).alias("strategy"), F.length("text").alias("n")) for s in SIZES]
    return one[0].union(one[1]).union(one[2]).groupBy("strategy").agg(F.count("*").alias("chunks"), F.min("n").alias("shortest"), F.max("n").alias("longest"), F.sum("n").alias("total"))


def section_lookup_fixed(spark, sf):
    """Fixed windows over texts with headings: each window's section."""
    docs = documents(spark, sf).select("source_path", structured(F.col("text"), "markdown").alias("text"))
    c = chunk_documents(docs, "fixed", 300, 60)
    return c.select("chunk_id", "start_char", F.col("metadata.section_title").alias("section_title"), F.col("metadata.heading_level").alias("heading_level"))


def token_stats(spark, sf):
    found = T.terms(F.col("text"))
    return documents(spark, sf).select("doc_id", F.size(found).alias("n_terms"), F.size(F.array_distinct(found)).alias("n_distinct"))


def term_frequencies(spark, sf):
    each = documents(spark, sf).select("doc_id", F.explode(T.terms(F.col("text"))).alias("term"))
    return each.groupBy("term", "doc_id").agg(F.count("*").alias("tf")).groupBy("term").agg(F.sum("tf").alias("total"), F.count("*").alias("df"))


def hash_embedding(spark, sf):
    vectors = documents(spark, sf).select("doc_id", embedding.embed_column(F.col("text")).alias("v"))
    # The outer form: for a plain posexplode Spark would filter on the vector's size and embed twice.
    return vectors.select("doc_id", F.posexplode_outer("v").alias("slot", "value")).where("value <> 0").select("doc_id", "slot", F.round("value", 6).alias("value"))


def _vectors(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    corpus = rows.select(F.col("vec_id").cast("long").alias("position"), F.col("embedding").alias("vector"), "label")
    return corpus, rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), F.col("label").alias("query_label"))


def dense_topk(spark, sf):
    corpus, queries = _vectors(spark, sf)
    return ranking.dense(corpus, queries, K).select("query_id", "rank", F.col("position").alias("vec_id"), F.round("score", 6).alias("score"))


def dense_cells_topk(spark, sf):
    """The ranking of ``dense_topk`` by cells of vectors, most of which are skipped where vectors cluster."""
    corpus, queries = _vectors(spark, sf)
    ranked, _ = CellIndex.build(corpus).search(queries, K)
    return ranked.select("query_id", "rank", F.col("position").alias("vec_id"), F.round("score", 6).alias("score"))


def dense_label_precision(spark, sf):
    corpus, queries = _vectors(spark, sf)
    ranked = ranking.dense(corpus, queries, 10).join(corpus.select("position", "label"), "position").join(queries.select("query_id", "query_label"), "query_id")
    return ranked.groupBy("query_id").agg(F.round(F.avg((F.col("label") == F.col("query_label")).cast("int")), 6).alias("precision"), F.count("*").alias("n"))


def _document_corpus(spark, sf):
    docs = documents(spark, sf)
    meta = F.concat_ws(" ", "source", "lang")
    # A row number would cost a sort; ids already give a total order.
    return docs.select(F.col("doc_id").cast("long").alias("position"), F.concat(F.col("doc_id").cast("string"), F.lit("::chunk-0")).alias("chunk_id"), "text", F.col("text").alias("searchable"), meta.alias("metadata_text"), embedding.embed_column(F.col("text")).alias("vector"))


def _questions(spark, sf):
    return benchmark(spark, sf).withColumn("vector", embedding.embed_column(F.col("text")))


def _shown(ranked: DataFrame) -> DataFrame:
    return ranked.select("query_id", "rank", F.col("position").alias("doc_id"), F.round("score", 6).alias("score"))


def bm25_topk(spark, sf):
    return _shown(ranking.lexical(_document_corpus(spark, sf).drop("vector"), benchmark(spark, sf), K))


def document_dense_topk(spark, sf):
    return _shown(ranking.dense(_document_corpus(spark, sf), _questions(spark, sf), K))


def blended_topk(spark, sf):
    return _shown(ranking.blended(_document_corpus(spark, sf), _questions(spark, sf), K))


def hybrid_rrf_topk(spark, sf):
    return _shown(ranking.hybrid(_document_corpus(spark, sf), _questions(spark, sf), K, RetrievalSettings("hybrid_rrf", WINDOW)))


def rrf_fuse(spark, sf):
    """Fusion of two orders of each document's neighbours by size: within a language, by length and by words."""
    docs = documents(spark, sf).select(F.col("lang").alias("query_id"), "doc_id", F.length("text").alias("n"), F.size(T.terms(F.col("text"))).alias("m"))
    order = lambda c: F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(c), "doc_id"))
    lists = [docs.withColumn("rank", order(c)).where(F.col("rank") <= 50).select("query_id", F.col("doc_id").cast("string").alias("chunk_id"), F.col("doc_id").alias("position"), "rank") for c in ("n", "m")]
    return ranking.top_k(ranking.fuse(lists), 10, F.col("chunk_id")).select("query_id", "rank", F.col("position").alias("doc_id"), F.round("score", 9).alias("score"))


def _window(spark, sf):
    corpus = staged(_document_corpus(spark, sf), "corpus")
    found = ranking.dense(corpus, _questions(spark, sf), WINDOW)
    return staged(found.join(corpus.select("position", "searchable"), "position"), "window")


def window_rerank(spark, sf):
    return _shown(ranking.rerank_candidates(_window(spark, sf), benchmark(spark, sf), K))


def window_rerank_lexical(spark, sf):
    return _shown(ranking.rerank_candidates(_window(spark, sf), benchmark(spark, sf), K, "lexical"))


def identity_rerank(spark, sf):
    return _shown(rerank.identity(ranking.lexical(_document_corpus(spark, sf).drop("vector"), benchmark(spark, sf), WINDOW), K))


def rerank_apply_order(spark, sf):
    """Replies of numbers and quoted numbers, some repeated, foreign or none, by a rule on the item."""
    hits = ranking.lexical(_document_corpus(spark, sf).drop("vector"), benchmark(spark, sf), WINDOW)
    q = F.col("query_id")
    numbers = [((q * 3 + 2 * j * j) % 11).cast("string") for j in range(5)]
    entries = F.concat_ws(", ", *[n if j % 2 == 0 else F.concat(F.lit('"'), n, F.lit('"')) for j, n in enumerate(numbers)], F.lit("null"), F.lit("2.5"))
    reply = F.when(q % 5 == 0, F.concat(F.lit("Nothing fits item "), q.cast("string"))).otherwise(F.concat(F.lit("Passages for item "), q.cast("string"), F.lit(": ["), entries, F.lit("]")))
    replies = benchmark(spark, sf).select("query_id", reply.alias("reply"))
    out = rerank.apply_replies(hits, replies, 6)
    return out.select("query_id", "rank", F.col("position").alias("doc_id"), F.round("score", 6).alias("score"), "rerank_mode", "rerank_reason")


def lexical_overlap_topk(spark, sf):
    """Share of an item's distinct terms that a document has."""
    corpus = documents(spark, sf).select(F.col("doc_id").alias("position"), "text")
    return ranking.overlap(corpus, benchmark(spark, sf), K).select("query_id", "rank", F.col("position").alias("doc_id"), F.round("score", 6).alias("score"))


def metadata_overlap(spark, sf):
    docs = documents(spark, sf)
    terms = T.distinct_terms(F.concat_ws(" ", T.title_of(F.col("source_path")), F.col("source"), F.col("lang")))
    return docs.select("doc_id", F.round(V.overlap(terms, T.distinct_terms(F.col("text"))), 6).alias("overlap"))


def _cases(spark, sf):
    """Every hundredth document asks for itself."""
    docs = documents(spark, sf).where("doc_id % 100 = 0")
    one = lambda x: F.when(x != "", F.array(x)).otherwise(F.array().cast("array<string>"))
    return docs.select(
        F.col("doc_id").alias("query_id"), F.substring("text", 1, 200).alias("question"),
        one(F.substring("text", 1, 12)).alias("expected_answer_keywords"), F.array("source_path").alias("expected_source_paths"),
        one(F.substring("text", 21, 30)).alias("expected_span_keywords"), F.array(F.substring("text", 21, 30), F.substring("text", 801, 25), F.lit("zzz none")).alias("expected_retrieval_keywords"),
    )


def _hits(spark, sf, size=800, overlap=120, k=K, cases=None):
    docs = documents(spark, sf).select("source_path", "text")
    corpus, part = (passing_corpus(chunk_documents(d, "fixed", size, overlap)) for d in (docs, part_of(docs)))
    questions = (_cases(spark, sf) if cases is None else cases).select("query_id", F.col("question").alias("text"))
    with scratch(spark):
        ranked = staged(ranking.lexical(corpus.drop("chunk_id"), questions, k, part).drop("chunk_id"), "ranked")
        return staged(with_chunks(ranked, corpus), "hits", lasting=True)


def chunk_topk(spark, sf):
    return _hits(spark, sf).select("query_id", "rank", "chunk_id", F.round("score", 6).alias("score"))


def answer_context(spark, sf):
    return answers.ordered(_hits(spark, sf)).select("query_id", answers.answer_context(F.col("hits")).alias("context"))


def tool_results(spark, sf):
    return answers.ordered(_hits(spark, sf)).select("query_id", answers.tool_results(F.col("hits")).alias("results"))


def citations(spark, sf):
    return answers.ordered(_hits(spark, sf)).select("query_id", F.array_join(answers.citations(F.col("hits")), ",").alias("citations"))


def citation_spans(spark, sf):
    each = answers.ordered(_hits(spark, sf)).select("query_id", F.explode(answers.citation_spans(F.col("hits"))).alias("s"))
    return each.select("query_id", "s.source_id", "s.chunk_id", "s.start_char", "s.end_char")


def merge_hits(spark, sf):
    """Two searches a question, the second over smaller pages of the same ranking, merged by first sighting."""
    hits = _hits(spark, sf)
    second = hits.where("rank > 1").withColumn("rank", F.col("rank") - 1)
    merged = answers.merge_hits(second.withColumn("search_no", F.lit(1)).unionByName(hits.withColumn("search_no", F.lit(2))))
    return merged.select("query_id", "source_no", "chunk_id", "search_no")


def _answered(spark, sf):
    cases = _cases(spark, sf)
    return answer(cases.select("query_id", F.col("question").alias("text")), _hits(spark, sf))


def extractive_answer(spark, sf):
    return _answered(spark, sf).select("query_id", "answer")


def _results(spark, sf):
    return evaluation.evaluate(_cases(spark, sf), _answered(spark, sf).select("query_id", "answer", "hits"))


def eval_metrics(spark, sf):
    return _results(spark, sf).select("query_id", *[F.round(c, 6).alias(c) for c in evaluation.RATES])


def failure_reasons(spark, sf):
    return _results(spark, sf).select("query_id", F.array_join("failure_reasons", ",").alias("failure_reasons"))


def eval_summary(spark, sf):
    return evaluation.summary(_results(spark, sf))


SWEEP = [(size, overlap, k) for size, overlap in ((400, 60), (800, 120)) for k in (1, 4)]


def sweep_leaderboard(spark, sf):
    """Four cells over two indexes; both window sizes of an index come from one ranking."""
    cells = [(n, Settings(chunk_strategy="fixed", retrieval_strategy="lexical", top_k=k, chunk_size=size, chunk_overlap=overlap)) for n, (size, overlap, k) in enumerate(SWEEP)]
    totals = sweep.evaluate_cells(cells, documents(spark, sf).select("source_path", "text"), staged(_cases(spark, sf), "cases"))
    names = F.create_map(*[x for n, cell in cells for x in (F.lit(n), F.lit(sweep.label(cell)))])
    board = evaluation.leaderboard(totals.withColumns({"label": names[F.col("run_no")], "status": F.lit("ok"), "avg_response_time_ms": F.lit(0.0)}))
    order = Window.orderBy(F.desc("retrieval_reciprocal_rank"), F.desc("retrieval_precision"), F.desc("answer_keyword_hit_rate"), F.desc("citation_span_hit_rate"), "avg_response_time_ms", "run_no")
    return board.select(F.row_number().over(order).alias("place"), "label", "retrieval_reciprocal_rank", "retrieval_precision", "citation_span_hit_rate")


def sweep_cells(spark, sf):
    """The twelve default cells, three ways of chunking by four of ranking, over texts with headings; offline, so none is live."""
    docs = documents(spark, sf).select("source_path", structured(F.col("text"), "markdown").alias("text"))
    cells = list(enumerate(sweep.cells(Settings())))
    totals = sweep.evaluate_cells(cells, docs, staged(_cases(spark, sf), "cases"))
    names = F.create_map(*[x for n, cell in cells for x in (F.lit(n), F.lit(sweep.label(cell)))])
    return totals.select(names[F.col("run_no")].alias("label"), "num_cases", *evaluation.RATES, "reason")


def cell_identities(spark, sf):
    """What the twelve default cells and the dataset that they are measured on are known by."""
    cells = sweep.configurations(spark, list(enumerate(sweep.cells(Settings()))))
    # One row meets twelve.
    both = cells.withColumn("one", F.lit(1)).join(dataset_identity(spark, sf).withColumn("one", F.lit(1)), "one")
    return both.select("label", "configuration_identity", F.col("identity").alias("dataset_identity"))


def dataset_identity(spark, sf):
    gold = benchmark(spark, sf).select(F.col("query_id").alias("key"), F.col("text").alias("value"))
    return identity.dataset_identity(documents(spark, sf), gold)


def gold_normalise(spark, sf):
    """Gold lines in new, old and partial forms, made from documents."""
    docs = documents(spark, sf)
    q, a, b = F.col("text"), F.array("text", F.lit("")), F.array(F.reverse("text"))
    new = F.to_json(F.struct(q.alias("question"), a.alias("expected_answer_keywords"), b.alias("expected_span_keywords")))
    old = F.to_json(F.struct(q.alias("question"), a.alias("expected_keywords"), F.array("source_path").alias("expected_sources")))
    null = F.to_json(F.struct(q.alias("question"), b.alias("expected_span_keywords"), F.lit(None).cast("array<string>").alias("expected_retrieval_keywords")), {"ignoreNullFields": "false"})
    line = F.when(F.col("doc_id") % 3 == 0, new).when(F.col("doc_id") % 3 == 1, old).otherwise(null)
    cases = gold_cases(docs.select("doc_id", line.alias("value")))
    return cases.select("doc_id", "question", *[F.size(c).alias(f"n_{c}") for c in ("expected_answer_keywords", "expected_source_paths", "expected_span_keywords", "expected_retrieval_keywords")])


def record_rejects(spark, sf):
    """Chunk records made from documents, ten in twelve of them broken in a way of their own."""
    docs = documents(spark, sf)
    m = F.col("doc_id") % 12
    good = {"chunk_id": F.col("doc_id").cast("string"), "source_path": F.col("source_path"), "title": F.lit("t"), "text": F.col("text"), "chunk_index": F.lit(0), "start_char": F.lit(3), "end_char": F.lit(9)}

    def line(drop: str = "", **other: Column) -> Column:
        return F.to_json(F.struct(*[v.alias(k) for k, v in (good | other).items() if k != drop]), {"ignoreNullFields": "false"})

    whole, mixed = line(), F.array(F.lit("1"), F.lit("a"))
    forms = [
        line(embedding=F.array(F.lit(1.0), F.lit(2.5))), F.expr("substring(whole, 1, length(whole) - 1)"), F.concat(F.lit("["), F.col("whole"), F.lit("]")), line(drop="title"), line(chunk_index=F.lit("0")),
        line(start_char=F.lit(-1)), line(end_char=F.lit(2)), line(metadata=F.lit("x")), line(embedding=F.lit("none")), line(embedding=mixed), line(text=F.lit(None).cast("string"), chunk_index=F.lit(True)), line(metadata=F.struct(F.lit(4).alias("start"))),
    ]
    value = F.coalesce(*[F.when(m == n, form) for n, form in enumerate(forms)])
    rows = records.judged(docs.withColumn("whole", whole).select("doc_id", value.alias("value")))
    return rows.select("doc_id", F.array_join("reasons", ",").alias("reasons"), T.checksum(F.col("record.text")).alias("checksum"), F.size("record.embedding").alias("size"), F.col("record.metadata.start").alias("start"))


def _snapshots(spark, sf):
    """An earlier state of the corpus: a tenth not yet there, a tenth since removed, a tenth since edited, some marked dirty."""
    docs = documents(spark, sf)
    current = docs.where("doc_id % 10 <> 0").select("doc_id", "source_path", "text", T.checksum(F.col("text")).alias("checksum"))
    before = docs.where("doc_id % 10 <> 2")
    text = F.when(F.col("doc_id") % 10 == 1, F.concat("text", F.lit(" old"))).otherwise(F.col("text"))
    before = before.select("source_path", text.alias("text"), T.checksum(text).alias("checksum"))
    dirty = docs.where("doc_id % 35 = 3").select("source_path")
    return before, current, dirty


def ingest_plan(spark, sf):
    before, current, dirty = _snapshots(spark, sf)
    return index.plan(before.select("source_path", "checksum"), current, dirty)


def _changed(spark, sf):
    before, current, dirty = _snapshots(spark, sf)
    planned = staged(index.plan(before.select("source_path", "checksum"), current, dirty), "plan")
    old = chunk_documents(before.select("source_path", "text"), "fixed", 800, 120)
    new = chunk_documents(current.select("source_path", "text").join(planned.where("write").select("source_path"), "source_path"), "fixed", 800, 120)
    return before, current, planned, old, new


def index_apply(spark, sf):
    _, _, planned, old, new = _changed(spark, sf)
    return index.apply_changes(old, planned, new).select("chunk_id", "start_char", "end_char", T.checksum(F.col("text")).alias("checksum"))


def manifest_update(spark, sf):
    before, current, planned, old, new = _changed(spark, sf)
    ids = old.groupBy("source_path").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id"))), lambda c: c["chunk_id"]).alias("chunk_ids"))
    manifest = before.select("source_path", "checksum").join(ids, "source_path", "left")
    return index.update_manifest(manifest, current.select("source_path", "checksum"), planned, new).select("source_path", "checksum", F.size("chunk_ids").alias("n_chunks"), F.array_join("chunk_ids", ",").alias("chunk_ids"))


def _document_store(spark, sf):
    """A store of whole documents that has seen changes: a tenth came later, a tenth was edited, a tenth has a copy that went."""
    docs = documents(spark, sf).select("doc_id", "text")

    def chunks(rows: DataFrame, path: Column, text: Column = F.col("text")) -> DataFrame:
        none = F.lit(None).cast("string")
        about = F.struct(F.lit(0).alias("start"), F.length(text).alias("end"), F.lit("fixed").alias("chunk_strategy"), F.lit("").alias("source_title"), none.alias("section_title"), F.lit(None).cast("int").alias("heading_level"))
        return rows.select(
            F.concat(F.col("doc_id").cast("string"), F.lit("::chunk-0")).alias("chunk_id"), path.alias("source_path"), F.lit("").alias("title"), text.alias("text"), F.lit(0).alias("chunk_index"),
            F.lit(0).alias("start_char"), F.length(text).alias("end_char"), about.alias("metadata"), F.array(F.lit(1.0)).alias("embedding"),
        )

    # Paths in the order of ids, so that equal scores go by id.
    path, copy, tenth = F.lpad(F.col("doc_id").cast("string"), 15, "0"), F.concat(F.lit("copy/"), F.col("doc_id").cast("string")), F.col("doc_id") % 10
    edited = F.when(tenth == 1, F.concat("text", F.lit(" old words"))).otherwise(F.col("text"))
    store = ParquetStore(owned(spark, new_path(spark, "document-store")))
    store.save(chunks(docs.where(tenth != 2), path, edited).unionByName(chunks(docs.where(tenth == 3), copy)))
    store.apply(chunks(docs.where(tenth.isin(1, 2)), path), docs.where(tenth.isin(1, 2)).select(path.alias("source_path")).union(docs.where(tenth == 3).select(copy.alias("source_path"))))
    return store


def bm25_stored_topk(spark, sf):
    """BM25 over stored postings of two segments with rows that went, by sums of the segments' statistics."""
    ranked = _document_store(spark, sf).lexical(benchmark(spark, sf), K)
    return ranked.select("query_id", "rank", F.split("chunk_id", "::")[0].cast("long").alias("doc_id"), F.round("score", 6).alias("score"))


def index_statistics(spark, sf):
    """Document frequencies as the store keeps them through changes, and the corpus' size and mean length beside them."""
    store = _document_store(spark, sf)
    version = store.version()
    return store.statistics(spark).withColumns({"n_chunks": F.lit(version.chunks).cast("long"), "average": F.lit(round(version.average, 6))})


def index_store(spark, sf):
    """The changes of ``index_apply``, written to a store and merged when read."""
    _, _, planned, old, new = _changed(spark, sf)
    vector = F.array(F.lit(1.0))
    store = ParquetStore(owned(spark, new_path(spark, "chunk-store")))
    store.save(staged(old.withColumn("embedding", vector), "old-chunks"))
    store.apply(staged(new.withColumn("embedding", vector), "new-chunks"), planned.where("write OR action = 'removed'").select("source_path"))
    return store.load(spark, vectors=False).select("chunk_id", "start_char", "end_char", T.checksum(F.col("text")).alias("checksum"))


def point_ids(spark, sf):
    chunks = chunks_of(spark, sf, "fixed")
    return chunks.select("chunk_id", T.uuid5_url(F.col("chunk_id")).alias("point_id"))


def previews(spark, sf):
    return documents(spark, sf).select("doc_id", T.one_line(F.col("text"), 600).alias("preview"))


def turn_search(spark, sf):
    turns = spread(spark.read.parquet(f"{sf}/conversations.parquet"))
    key = F.col("conv_id") * 100_000 + F.col("turn")
    queries = turns.where("role = 'user' AND conv_id % 100 = 0").select(key.alias("query_id"), "text")
    corpus = turns.where("role <> 'user'").select(key.alias("position"), "text")
    return ranking.lexical(corpus, queries, K).select("query_id", "rank", F.col("position").alias("found"), F.round("score", 6).alias("score"))


def _mode(n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, ("ready", "live", "unknown", "fallback"))), (n % 4 + 1).cast("int"))


def status_merge(spark, sf):
    """Provider statuses of a conversation's turns, merged."""
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    n = F.length("text")
    rows = turns.select(F.col("conv_id").alias("key"), F.col("turn").alias("nth"), F.col("role").alias("provider"), _mode(n).alias("mode"), F.when(n % 3 > 0, F.concat(F.lit("reason_"), (n % 5).cast("string"))).alias("reason"))
    return answers.merged_status(rows)


def degradation_reason(spark, sf):
    """Diagnostics derived from turns, a conversation being a cell."""
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    n = F.length("text")
    rows = turns.select(
        F.col("conv_id").alias("cell"), F.col("turn").alias("nth"), (n % 29 > 0).alias("has_diagnostics"), F.lit("basic").alias("requested_runtime"), F.when(n % 7 == 0, "agents_sdk").otherwise("basic").alias("actual_runtime"),
        F.when(n % 2 == 0, "live").otherwise(_mode(n)).alias("chat_mode"), F.when(n % 3 == 0, "live").otherwise(_mode(n + 1)).alias("embedding_mode"), _mode(n + 2).alias("reranker_mode"), F.when(n % 5 > 0, "reranker_disabled").alias("reranker_reason"),
    )
    return evaluation.degradation(rows)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        discover_filter, source_checksum, section_lookup_fixed, chunk_stats, token_stats, term_frequencies, hash_embedding, dense_topk, dense_cells_topk, dense_label_precision, bm25_topk,
        document_dense_topk, lexical_overlap_topk, metadata_overlap, blended_topk, rrf_fuse, hybrid_rrf_topk, window_rerank, window_rerank_lexical, identity_rerank, rerank_apply_order, chunk_topk,
        answer_context, tool_results, citations, citation_spans, merge_hits, extractive_answer, eval_metrics, failure_reasons, eval_summary, sweep_leaderboard, sweep_cells, cell_identities, dataset_identity, gold_normalise, record_rejects,
        ingest_plan, index_apply, index_store, index_statistics, bm25_stored_topk, manifest_update, point_ids, previews, turn_search, status_merge, degradation_reason,
    )
} | {f"chunk_{s}": _chunk_query(s) for s in SIZES}
