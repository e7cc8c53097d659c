import json
import uuid

import pytest
from pyspark.sql import functions as F

from corvane import config
from corvane.errors import ConfigurationError, DataFormatError, StoreError
from corvane.functions import metrics as M
from corvane.functions import text as T
from corvane.operators import answers, evaluation, index
from corvane.plans import sweep
from corvane.plans.engine import Engine, require_live
from corvane.sources import corpus, gold
from corvane.streaming.ingest import stream_into_index

HIT = "query_id long, rank int, score double, chunk_id string, source_path string, title string, text string, chunk_index int, start_char int, end_char int"


def hits(spark):
    rows = [(1, 2, 0.25, "b::chunk-0", "b", "B", "second\n[S3]\nrest", 0, 0, 6), (1, 1, 0.42424, "a::chunk-1", "a", "A", "first body", 1, 5, 9), (1, 3, 0.1, "a::chunk-2", "a", "A", "third", 2, 9, 12)]
    return spark.createDataFrame(rows, HIT)


def test_contexts_citations_and_answer(spark):
    row = answers.ordered(hits(spark)).select(
        answers.answer_context(F.col("hits")).alias("c"), answers.tool_results(F.col("hits")).alias("t"), answers.citations(F.col("hits")).alias("p"), answers.citation_spans(F.col("hits")).alias("s"),
        answers.extractive_answer(F.lit("q?"), answers.answer_context(F.col("hits")), F.lit("missing_api_key")).alias("a"),
    ).first()
    assert row.c.startswith("[S1]\nsource: a\ntitle: A\nchunk_index: 1\nstart_char: 5\nend_char: 9\ncontent: first body\n\n[S2]\nsource: b")
    assert "\nscore: 0.4242\ntext: first body" in row.t and row.p == ["a", "b"]
    assert [(s.source_id, s.chunk_id) for s in row.s] == [("S1", "a::chunk-1"), ("S2", "b::chunk-0"), ("S3", "a::chunk-2")]
    assert row.a == "Provider fallback (missing_api_key); extractive answer: first body second"
    none = spark.range(1).select(answers.extractive_answer(F.lit("q?"), F.lit(answers.NO_EVIDENCE), F.lit(None).cast("string")).alias("a")).first().a
    assert none == "I could not find supporting context for: q?"


def test_merge_keeps_first_sightings(spark):
    two = hits(spark).withColumn("search_no", F.lit(2)).unionByName(hits(spark).where("rank = 3").withColumn("rank", F.lit(1)).withColumn("search_no", F.lit(1)))
    got = answers.merge_hits(two).orderBy("source_no").collect()
    assert [r.chunk_id for r in got] == ["a::chunk-2", "a::chunk-1", "b::chunk-0"]


def test_status_and_degradation(spark):
    rows = [(1, 1, "e", "live", "r1"), (1, 2, "e", "fallback", "r2"), (1, 3, "e", "ready", "r1"), (2, 1, "e", "ready", None)]
    got = {r.key: (r["mode"], r.reason) for r in answers.merged_status(spark.createDataFrame(rows, "key long, nth long, provider string, mode string, reason string")).collect()}
    assert got == {1: ("fallback", "r1;r2"), 2: ("ready", None)}
    base = ("basic", "basic", "live", "live", "ready", "reranker_disabled")
    cells = [(1, 1, True, *base), (2, 1, True, "basic", "x", "fallback", "unknown", "ready", None), (2, 2, True, "basic", "x", "live", "fallback", "live", None), (3, 1, True, *base), (3, 2, False, *base)]
    frame = spark.createDataFrame(cells, "cell long, nth long, has_diagnostics boolean, requested_runtime string, actual_runtime string, chat_mode string, embedding_mode string, reranker_mode string, reranker_reason string")
    got = {r.cell: r.reason for r in evaluation.degradation(frame).collect()}
    assert got == {1: None, 2: "runtime_fallback,chat_fallback,embedding_not_live,reranker_not_live,embedding_fallback", 3: "missing_diagnostics"}


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def strings(*items):
    return F.array(*[F.lit(i) for i in items]).cast("array<string>")


def test_metrics(spark):
    one, two = strings("alpha beta"), strings("alpha", "beta")
    assert value(spark, M.evidence_rate(two, one)) == 0.0 and value(spark, M.evidence_rate(strings("x Alpha Beta"), one)) == 1.0
    for texts, want in [(strings("k"), 1.0), (strings("a", "K!"), 0.5), (strings("a", "b", "c", "k"), 0.25), (strings("a"), 0.0)]:
        assert value(spark, M.reciprocal_rank(texts, strings("k"))) == want
    assert value(spark, M.reciprocal_rank(strings("x", "y"), strings("x", "y", "z"))) == 0.5
    assert value(spark, M.precision(strings("k", "b"), strings("k"))) == 0.5 and value(spark, M.precision(strings(), strings("k"))) == 0.0
    for f in (M.keyword_rate(F.lit(""), strings()), M.evidence_rate(strings(), strings()), M.reciprocal_rank(strings(), strings()), M.precision(strings(), strings()), M.source_rate(strings(), strings())):
        assert value(spark, f) == 1.0
    found = M.failure_reasons(*[F.lit(x) for x in (1.0, 1.0, 0.25, 1.0, 1.0, 1.0)])
    assert value(spark, found) == ["retrieval_ranked_expected_span_below_first"]


def test_summary_without_cases_and_leaderboard(spark):
    schema = "label string, status string, run_no int, retrieval_reciprocal_rank double, retrieval_precision double, answer_keyword_hit_rate double, citation_span_hit_rate double, avg_response_time_ms double"
    rows = [("low", "ok", 0, 0.25, 1.0, 1.0, 1.0, 1.0), ("slow", "ok", 1, 1.0, 0.5, 0.5, 0.5, 9.0), ("fast", "ok", 2, 1.0, 0.5, 0.5, 0.5, 2.0), ("gone", "degraded", 3, 1.0, 1.0, 1.0, 1.0, 0.0), ("tie", "ok", 4, 1.0, 0.5, 0.5, 0.5, 9.0)]
    assert [r.label for r in evaluation.leaderboard(spark.createDataFrame(rows, schema)).collect()] == ["fast", "slow", "tie", "low"]
    runs = [{"label": r[0], "status": r[1], "summary": dict(zip(schema.replace(" double", "").split(", ")[3:], r[3:]))} for r in rows]
    assert [r["label"] for r in sweep.leaderboard(runs)] == ["fast", "slow", "tie", "low"]


def test_text_functions(spark):
    assert value(spark, T.uuid5_url(F.lit("a b/é::chunk-3"))) == str(uuid.uuid5(uuid.NAMESPACE_URL, "a b/é::chunk-3"))
    for path, want in [("a/my_doc.md", "my doc"), ("x/.md", ".md"), ("_.txt", "_.txt"), ("plain", "plain"), ("a.b.md", "a.b")]:
        assert value(spark, T.title_of(F.lit(path))) == want
    assert value(spark, T.one_line(F.lit("  a \n b" + "c" * 700), 600)) == ("a b" + "c" * 597) + "..."
    assert value(spark, T.unix_lines(F.lit("a\r\nb\rc\n"))) == "a\nb\nc\n"
    assert value(spark, T.error_reason(F.lit("E"), F.lit(" x \n y "))) == "provider_error:E:x y" and value(spark, T.error_reason(F.lit("E"), F.lit(None).cast("string"))) == "provider_error:E"
    assert value(spark, T.is_unreachable(F.lit("Connection REFUSED"))) and value(spark, T.is_transient(F.lit("X"), F.lit(429), F.lit("")))


def test_settings():
    assert config.Settings.from_env({"CORVANE_TOP_K": "7", "CORVANE_EXCLUDE": "a, b", "CORVANE_RUNTIME": " Basic "}).top_k == 7
    for env in ({"CORVANE_TOP_K": "x"}, {"CORVANE_TOP_K": "0"}, {"CORVANE_RERANKER": "other"}, {"CORVANE_CHUNK_OVERLAP": "800"}):
        with pytest.raises(ConfigurationError):
            config.Settings.from_env(env)
    a, b = config.Settings(), config.Settings(top_k=9)
    assert config.index_fingerprint(a, "live") == config.index_fingerprint(b, "live") != config.index_fingerprint(a, "fallback")
    assert len(sweep.cells(a)) == 12 and len(sweep.cells(a, {"vector_backends": ["local", "qdrant"]})) == 24
    assert sweep.label(a) == "basic:local:markdown:blended:rr-none:k4:s800:o120"
    for asked in ({"top_ks": []}, {"top_ks": list(range(1, 12))}):
        with pytest.raises(ConfigurationError):
            sweep.cells(a, asked)
    with pytest.raises(ConfigurationError):
        config.check_question("  ")


def write(folder, **files):
    folder.mkdir(exist_ok=True)
    for name, text in files.items():
        (folder / name.replace("__", ".")).write_bytes(text.encode() if isinstance(text, str) else text)


def test_discovery(spark, tmp_path):
    write(tmp_path / "d", _hidden__md="x", b__TXT="y\r\nz", c__html="no", skip__md="s")
    (tmp_path / "d" / "sub").mkdir()
    (tmp_path / "d" / "sub" / "e.md").write_text("e")
    found = corpus.list_documents(tmp_path / "d", ["skip*"])
    assert [p.relative_to(tmp_path / "d").as_posix() for p in found] == ["_hidden.md", "b.TXT", "sub/e.md"]
    got = {r.source_path.rsplit("/", 1)[-1]: r.text for r in corpus.read_documents(spark, tmp_path / "d", ["skip*"]).collect()}
    assert got == {"_hidden.md": "x", "b.TXT": "y\nz", "e.md": "e"}
    write(tmp_path / "d", bad__md=b"\xff\xfe")
    with pytest.raises(Exception, match="UTF-8"):
        corpus.read_documents(spark, tmp_path / "d").collect()
    with pytest.raises(ConfigurationError):
        corpus.list_documents(tmp_path / "none")


def test_gold_files(spark, tmp_path):
    lines = [{"question": "q1", "expected_keywords": ["a", ""], "expected_sources": ["s"]}, {"question": "q2", "expected_span_keywords": ["k"], "expected_retrieval_keywords": None}, {"question": "q3", "expected_span_keywords": ["k"]}]
    path = tmp_path / "gold.jsonl"
    path.write_text("\n\n".join(map(json.dumps, lines)))
    got = gold.read_gold(spark, str(path)).orderBy("query_id").collect()
    assert [r.expected_answer_keywords for r in got] == [["a"], [], []] and [r.expected_retrieval_keywords for r in got] == [[], [], ["k"]]
    path.write_text('{"question": "a"}\n{"question": ')
    with pytest.raises(DataFormatError, match="line 2"):
        gold.read_gold(spark, str(path))
    path.write_text("")
    with pytest.raises(DataFormatError):
        gold.read_gold(spark, str(path))


@pytest.fixture
def settings(tmp_path):
    return config.Settings(docs_dir=str(tmp_path / "docs"), index_path=str(tmp_path / "index"), manifest_path=str(tmp_path / "manifest.json"), chunk_size=60, chunk_overlap=10)


def test_incremental_index(spark, settings, tmp_path):
    docs = tmp_path / "docs"
    write(docs, first__md="# One\nalpha body", second__md="# Two\nbeta body")
    engine = Engine(spark, settings)
    steps = []

    def step():
        out = engine.ingest()
        steps.append((out["removed"], out["changed"], sorted(r.text for r in engine.store.load(spark).collect())))

    step()
    version = engine.store.pointer.read_text()
    step()
    assert engine.store.pointer.read_text() == version
    write(docs, first__md="# One\nnew body")
    step()
    (docs / "second.md").unlink()
    step()
    write(docs, first__md="  ")
    step()
    assert steps == [(0, 2, ["alpha body", "beta body"]), (0, 0, ["alpha body", "beta body"]), (0, 1, ["beta body", "new body"]), (1, 0, ["new body"]), (0, 1, [])]
    manifest = index.Manifest.load(tmp_path / "manifest.json")
    assert not manifest.is_dirty and [r.chunk_ids for r in manifest.frame(spark).collect()] == [[]]
    # One table is left of all that were written, and the file itself stays small.
    assert len(list((tmp_path / "manifest.json.tables").iterdir())) == 1 and "first" not in (tmp_path / "manifest.json").read_text()


def test_manifest_of_an_earlier_version(spark, settings, tmp_path):
    write(tmp_path / "docs", a__md="text one", b__md="text two")
    engine = Engine(spark, settings)
    engine.ingest()
    rows = index.Manifest.load(tmp_path / "manifest.json").frame(spark).collect()
    new = json.loads((tmp_path / "manifest.json").read_text())
    old = {"version": 2, "storage_identity": new["storage_identity"], "index_fingerprint": new["index_fingerprint"], "needs_reindex": [], "sources": {r.source_path: {"checksum": r.checksum, "chunk_ids": r.chunk_ids} for r in rows}}
    (tmp_path / "manifest.json").write_text(json.dumps(old))
    assert not index.needs_ingest(settings, engine.store) and engine.ingest()["changed"] == 0
    (tmp_path / "manifest.json").write_text(json.dumps(old | {"needs_reindex": [rows[0].source_path]}))
    assert index.needs_ingest(settings, engine.store) and engine.ingest()["changed"] == 1
    (tmp_path / "manifest.json").write_text(json.dumps({"version": 1, "sources": {}}))
    version = engine.store.pointer.read_text()
    assert index.needs_ingest(settings, engine.store) and engine.ingest()["documents"] == 2 and engine.store.pointer.read_text() != version
    (tmp_path / "manifest.json").write_text("[]")
    with pytest.raises(DataFormatError):
        index.needs_ingest(settings, engine.store)


@pytest.mark.parametrize(
    "change",
    [{"version": True}, {"version": 4}, {"version": "2"}, {"storage_identity": ""}, {"storage_identity": 3}, {"index_fingerprint": []}, {"needs_reindex": "a"}, {"needs_reindex": [1]}, {"repair_required": 0}, {"sources": None}, {"sources": []}, {"sources": {"a": {"checksum": 1, "chunk_ids": []}}}, {"sources": {"a": {"checksum": "c"}}}, {"sources": {"a": {"checksum": "c", "chunk_ids": [None]}}}],
)
def test_manifests_with_values_of_other_types_are_refused(tmp_path, change):
    good = {"version": 2, "storage_identity": "s", "index_fingerprint": None, "needs_reindex": ["b"], "repair_required": False, "sources": {"a": {"checksum": "c", "chunk_ids": ["x"]}}}
    path = tmp_path / "m.json"
    path.write_text(json.dumps(good))
    assert index.Manifest.load(path).inline == (("a", "c", ["x"]),)
    path.write_text(json.dumps(good | change))
    with pytest.raises(DataFormatError, match="no manifest"):
        index.Manifest.load(path)


def test_who_owns_an_index(settings, tmp_path):
    path = tmp_path / "m.json"
    sources = {"a": {"checksum": "c", "chunk_ids": []}}
    remote = settings.with_(backend="qdrant")
    of = lambda body: (path.write_text(json.dumps(body)), index.Manifest.load(path))[1]
    assert not index.Manifest().must_rebuild(remote, "me")
    for body in ({"sources": {}}, {"version": 1, "sources": sources}, {"version": 2, "sources": sources}, {"version": 2, "sources": {}, "repair_required": True}):
        assert of(body).must_rebuild(settings, "me")
        with pytest.raises(StoreError, match="own"):
            of(body).must_rebuild(remote, "me")
    assert not of({"version": 2, "sources": {}}).must_rebuild(remote, "me") and not of({"version": 2, "storage_identity": "me", "sources": sources}).must_rebuild(remote, "me")
    with pytest.raises(StoreError, match="another"):
        of({"version": 2, "storage_identity": "you", "sources": {}}).must_rebuild(settings, "me")


def test_interrupted_write_is_repaired(spark, settings, tmp_path, monkeypatch):
    write(tmp_path / "docs", a__md="text one")
    engine = Engine(spark, settings)
    with monkeypatch.context() as m:
        m.setattr(index.ParquetStore, "save", lambda *a: (_ for _ in ()).throw(StoreError("lost")))
        with pytest.raises(StoreError):
            engine.ingest()
    assert index.Manifest.load(tmp_path / "manifest.json").repair_required and index.needs_ingest(settings, engine.store)
    engine.ensure()
    assert not index.needs_ingest(settings, engine.store) and engine.store.load(spark).count() == 1
    write(tmp_path / "docs", a__md="edited")
    assert not index.needs_ingest(settings, engine.store)
    assert index.needs_ingest(settings.with_(chunk_size=50), engine.store)


def test_ask_evaluate_and_sweep(spark, settings, tmp_path):
    write(tmp_path / "docs", cats__md="# Cats\nCats sleep all day.", dogs__md="# Dogs\nDogs bark at night.")
    engine = Engine(spark, settings.with_(retrieval_strategy="hybrid_rrf", top_k=2))
    out = engine.ask("When do dogs bark?")
    assert out["citations"][0].endswith("dogs.md") and "Dogs bark at night." in out["answer"] and not require_live(out["diagnostics"])
    # A question leaves nothing behind, neither staged tables nor a version of the store.
    from corvane.sources import shared

    left = lambda: (list(shared._of_session.get(shared._key(spark), [])), sorted(p.as_posix() for p in tmp_path.rglob("*")))
    before = left()
    assert engine.ask("When do dogs bark?")["citations"] == out["citations"] and left() == before
    assert engine.health() == {"status": "ok", "index": True} and engine.info()["documents"] == 2
    cases = gold.gold_cases(spark.createDataFrame([(0, json.dumps({"question": "dogs bark", "expected_answer_keywords": ["night"], "expected_source_paths": [out["citations"][0]], "expected_span_keywords": ["bark"]}))], "query_id long, value string"))
    results, totals = engine.evaluate(cases)
    assert totals["retrieval_reciprocal_rank"] == 1.0 and totals["answer_keyword_hit_rate"] == 1.0 and results.first().failure_reasons == []
    documents = corpus.read_documents(spark, settings.docs_dir)
    runs, board = sweep.run(spark, settings, documents, cases, {"chunk_strategies": ["fixed"], "retrieval_strategies": ["dense", "lexical"], "vector_backends": ["local", "qdrant"]})
    assert [r["status"] for r in runs] == ["degraded", "degraded", "skipped", "skipped"] and board == [] and runs[2]["reason"] == "missing_qdrant_url"


class Echo:
    """A chat and embedding provider that counts nothing and needs no network."""

    def __init__(self, settings=None):
        self.settings = settings

    def complete(self, prompt):
        if "broken" in prompt:
            raise ValueError("no reply")
        return "[2, 1]" if prompt.startswith("1. ") else "" if "silent" in prompt else f"live: {prompt.count('[S')}"

    def embed(self, texts):
        return [[float(len(t)), 1.0] for t in texts]


def test_engine_with_providers(spark, settings, tmp_path):
    write(tmp_path / "docs", cats__md="# Cats\nCats sleep all day.", dogs__md="# Dogs\nDogs bark at night.")
    keyed = settings.with_(embedding_key="k", chat_key="k", retrieval_strategy="lexical", reranker="llm", top_k=2)
    offline = Engine(spark, keyed)
    out = offline.ask("dogs cats bark")
    assert out["diagnostics"]["chat"] == {"mode": "fallback", "reason": "provider_not_installed"} == out["diagnostics"]["embedding"]
    # A key without a provider makes no live vectors, so nothing is due again.
    version = offline.store.pointer.read_text()
    offline.ask("dogs")
    assert offline.store.pointer.read_text() == version
    live = Engine(spark, keyed, Echo(), Echo(), Echo())
    assert index.needs_ingest(keyed, live.store, live.embedder)
    found = live.ask("dogs cats bark")
    assert require_live(found["diagnostics"]) and found["answer"].startswith("live: ") and found["diagnostics"]["reranker"]["mode"] == "live"
    assert found["citations"] == out["citations"][::-1] and {len(r.embedding) for r in live.store.load(spark).collect()} == {2}
    for word, reason in (("broken", "provider_error:ValueError:no reply"), ("silent", "empty_provider_output")):
        one = live.ask(f"{word} dogs bark")
        assert one["diagnostics"]["chat"] == {"mode": "fallback", "reason": reason} and reason in one["answer"]
    write(tmp_path / "docs", broken__md="broken dogs")
    live.ingest()
    kept = live.ask("dogs bark")
    assert kept["diagnostics"]["reranker"] == {"mode": "fallback", "reason": "provider_error:ValueError:no reply"} and kept["citations"][0].endswith("dogs.md")
    agent = Engine(spark, keyed.with_(runtime="agents_sdk", reranker="none")).ask("dogs")["diagnostics"]
    assert (agent["requested_runtime"], agent["actual_runtime"], agent["runtime_reason"]) == ("agents_sdk", "basic", "runtime_not_installed")
    assert live.now().endswith("+00:00")
    named = Engine.from_settings(spark, keyed.with_(chat_provider=f"{__name__}:Echo"))
    assert isinstance(named.chat, Echo) and named.chat.settings.top_k == 2 and named.reranker is named.chat and named.embedder is None
    with pytest.raises(ConfigurationError):
        Engine.from_settings(spark, keyed.with_(chat_provider="no.such:Thing"))


def test_dataset_identity(spark):
    from corvane.operators.identity import dataset_identity

    docs, gold_rows = [(f"d/{i}.md", f"text {i}") for i in range(50)] + [("n", None)], [(1, "q"), (2, "r")]
    frames = lambda d, g, n=3: (spark.createDataFrame(d, "source_path string, text string").repartition(n), spark.createDataFrame(g, "key long, value string"))
    one = lambda d, g, n=3: dataset_identity(*frames(d, g, n)).first().identity
    same = one(docs, gold_rows)
    assert same == one(docs[::-1], gold_rows[::-1], 7)
    others = [one(docs[:-1], gold_rows), one(docs, gold_rows[:1]), one([*docs[:-1], ("n", "x")], gold_rows), one([*docs[:-1], ("n2", None)], gold_rows), one([], [])]
    assert len({same, *others}) == 6


def test_names_of_the_package():
    import corvane

    assert all(getattr(corvane, name) for name in corvane.__all__) and corvane.Engine is Engine
    with pytest.raises(AttributeError):
        corvane.nothing


def test_store_checks(spark, tmp_path):
    store = index.ParquetStore(tmp_path / "s")
    assert store.load(spark).count() == 0 and index.load_jsonl(spark, str(tmp_path / "none")).count() == 0
    good = {"chunk_id": "a::chunk-0", "source_path": "a", "title": "A", "text": "t", "chunk_index": 0, "start_char": 0, "end_char": 1, "embedding": [1.0]}
    (tmp_path / "x.jsonl").write_text(json.dumps(good) + "\n\n" + json.dumps(good | {"chunk_id": "a::chunk-1", "chunk_index": 1}) + "\n")
    chunks = index.load_jsonl(spark, str(tmp_path / "x.jsonl"))
    store.save(chunks)
    assert store.load(spark).count() == 2 and "embedding" not in store.load(spark, vectors=False).columns
    with pytest.raises(StoreError):
        store.save(chunks.withColumn("embedding", F.when(F.col("chunk_index") == 0, F.array(F.lit(1.0), F.lit(2.0))).otherwise(F.col("embedding"))))
    (tmp_path / "x.jsonl").write_text(json.dumps(good) + "\n{bad\n")
    with pytest.raises(DataFormatError, match="line 2"):
        index.load_jsonl(spark, str(tmp_path / "x.jsonl"))


def test_streaming_ingest(spark, tmp_path):
    folder = tmp_path / "in"
    spark.createDataFrame([("a.md", "old text", 1), ("b.md", "b text", 1), ("a.md", "new text", 2)], "source_path string, text string, seen_at long").write.parquet(str(folder))
    store = index.ParquetStore(tmp_path / "s")
    stream = spark.readStream.schema("source_path string, text string, seen_at long").parquet(str(folder))
    for _ in range(2):
        query = stream_into_index(stream, store, str(tmp_path / "c"), strategy="fixed", size=50, overlap=5)
        query.processAllAvailable()
        query.stop()
        assert {r.text for r in store.load(spark).collect()} == {"new text", "b text"}
        spark.createDataFrame([("b.md", "b text", 3)], "source_path string, text string, seen_at long").write.mode("append").parquet(str(folder))
