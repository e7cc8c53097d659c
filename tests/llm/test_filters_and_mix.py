import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import labelled, quality, source_mix, toxicity, url_filter

from .cases import awkward, awkward_rows, empty

URLS = [
    (1, "http://a.example.net/en/x"), (2, "https://A.Example.NET/EN/x"), (3, "http://net/"), (4, "http://xnet/"), (5, "http://example.com/de"),
    (6, "http://w.example.com/de/q"), (7, "ftp://b.org/fr/?casino"), (8, "http://b.org?x=/fr/"), (9, None), (10, ""), (11, "casino"), (12, "http://q.io/free/bets"),
    (13, "http://q.io/free/free"), (14, "http://q.io/xcasino/casinos"), (15, "http://q.io/#CASINO-x://"), (16, "http://example.net:80/en/"), (17, "a://b://c/d"), (17, "a://b://c/d"),
    (18, "http://q.io/casino777"), (19, "http://q.io/%63asin%6F"), (20, "http://q.io/%2563asino"), (21, "http://q.io/" + "a/" * 50_000 + "bet?x=bonus"), (22, "http://q.io/bet1bonus2"),
    (23, "http://q.io/%%363asino"), (24, "http://q.io/betbonus"),
]


def plain_judge(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        raw = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(raw) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in raw)
    fits = [(h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in url or "")
    for c in "0123456789abcdefghijklmnopqrstuvwxyz":
        low = low.replace(f"%{ord(c):02x}", c)
    for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ":
        low = low.replace(f"%{ord(c):02x}", c.lower())
    has = {t: bool(re.search(rf"(?<![a-z]){t}(?![a-z])", low)) for t in url_filter.VOCABULARY}
    bad = any(has[t] for t in url_filter.STRICT) or sum(has[t] for t in url_filter.SOFT) >= 2
    rule = max(fits, key=lambda f: len(f[0])) if fits else (None, "block" if bad else "allow")
    return host, path, rule[0], rule[1]


def test_urls_by_brute_force(spark):
    pages = spark.createDataFrame([(*u, "x", "y") for u in URLS], "page_id long, url string, host string, verdict string")
    got = [tuple(r)[:5] for r in url_filter.judge_urls(pages).collect()]
    assert sorted(got, key=str) == sorted(((i, *plain_judge(u)) for i, u in URLS), key=str)
    assert url_filter.judge_urls(pages.limit(0)).count() == 0
    blocked = {r.page_id for r in url_filter.judge_urls(pages).collect() if r.verdict == "block" and r.rule is None}
    assert {18, 19, 21, 22} <= blocked and not {20, 24} & blocked


def test_weights_of_a_vocabulary_of_its_own(spark):
    pages = spark.createDataFrame([(1, "http://a.b/red/green"), (2, "http://a.b/red"), (3, "http://a.b/blue.red.red")], "page_id long, url string")
    got = {r.page_id: (r.verdict, r.strict_hits, r.soft_hits, r.soft_terms, r.weight) for r in url_filter.judge_urls(pages, vocabulary={"red": 0.4, "green": 0.6, "blue": 0.5}).collect()}
    assert got == {1: ("block", 0, 2, 2, 1.0), 2: ("allow", 0, 1, 1, 0.4), 3: ("allow", 0, 3, 2, 0.9)}


def plain_mix(rows, weights=(5, 2, 1)):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sources = {}
    for r in rows:
        sources[r[2]] = sources.get(r[2], 0) + size(r[1])
    names = sorted((s for s in sources if s is not None)) + ([None] if None in sources else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, target, free = 1.5 * sum(sources.values()), {}, set(names)
    while free:
        share = (total - sum(target.values())) / sum(w[s] for s in free)
        over = {s for s in free if share * w[s] > 2 * sources[s]}
        if not over:
            target |= {s: share * w[s] for s in free}
            break
        target |= {s: 2.0 * sources[s] for s in over}
        free -= over
    out, times, seen = [], Counter(r[0] for r in rows), Counter()
    for r in rows:
        s = sources[r[2]]
        rate = target[r[2]] / s if s else 0.0
        key = str(r[0])
        if r[0] is None or times[r[0]] > 1:
            # Rows that share an id are told apart by text and number.
            seen[r[:3]] += 1
            key = f"{'null' if r[0] is None else r[0]}|{hashlib.md5((r[1] or '').encode()).hexdigest()}|{seen[r[:3]]}"
        u = int(hashlib.md5(f"{key}|mix-1".encode()).hexdigest()[:8], 16) / 2**32
        out.append((r[0], size(r[1]), s, round(target[r[2]], 6), int(rate) + (u < rate - int(rate))))
    return out


def test_mix_by_brute_force(spark):
    docs = awkward(spark)
    planned = source_mix.mix_plan(docs)
    got = [(r[0], r[-1].size, r[-1].source_size, round(r[-1].target, 6), r[-1].copies) for r in planned.collect()]
    want = plain_mix(awkward_rows())
    assert sorted(got, key=str) == sorted(want, key=str)
    mixed = source_mix.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(w[4] for w in want)
    assert source_mix.mix_plan(empty(spark)).count() == 0 and source_mix.mix(empty(spark)).count() == 0
    salted = source_mix.mix_plan(docs, most_sources=2)
    assert sorted((r[0], r[-1].size, r[-1].source_size, round(r[-1].target, 6), r[-1].copies) for r in salted.collect() if r[0] is not None) == sorted(w for w in want if w[0] is not None)
    assert salted.columns == planned.columns and salted.count() == len(want)
    assert "Python" not in planned._jdf.queryExecution().toString() and "Arrow" not in planned._jdf.queryExecution().toString()


def test_rows_without_an_id_of_their_own_meet_their_target(spark):
    """A third of the rows has no id, a third shares one, and many rows are equal: sources still land within 5 %."""
    rows = [(None if n % 3 == 0 else 7 if n % 3 == 1 else n, "w " * (5 + n % 11) if n % 4 else "the same text again", "abc"[n % 9 // 4]) for n in range(10_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = source_mix.mix_plan(docs.repartition(7))
    sums = found.groupBy("source").agg(F.sum("mix_plan.size").alias("size"), F.sum(F.col("mix_plan.size") * F.col("mix_plan.copies")).alias("taken"), F.max("mix_plan.target").alias("target"), F.max("mix_plan.copies").alias("most")).collect()
    assert len(sums) == 3 and all(abs(r.taken - r.target) < 0.05 * r.target and r.most <= 2 for r in sums)
    # The multiset drawn does not depend on how rows are dealt out.
    drawn = lambda parts, **options: sorted((str(r[0]), r[1], r[-1].copies) for r in source_mix.mix_plan(docs.repartition(parts), **options).collect())
    assert drawn(2) == drawn(5) == drawn(3, most_ids=0)


def test_mix_does_not_shuffle_documents(spark):
    """Above the scan of a table that Spark would not broadcast there is a join but no exchange."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        mixed = source_mix.mix(docs)
        mixed.count()
        plan = mixed._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize("seed", range(4))
def test_mix_targets_when_many_sources_are_capped(spark, seed):
    rng = random.Random(seed)
    rows = [(i, "w " * rng.choice([0, 1, 3, 50, 400]), f"s{rng.randint(0, 12):02d}") for i in range(60)]
    got = {(r[-1].target, r[-1].source_size) for r in source_mix.mix_plan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    want = {(t, s) for _, _, s, t, _ in plain_mix(rows)}
    assert {(round(t, 6), s) for t, s in got} == want


def test_held_out_rows(spark):
    rows = spark.range(50).select("id", labelled.held_out(F.col("id")).alias("held")).collect()
    assert {r.id: r.held for r in rows} == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(50)}


def toxic_corpus(spark, n=500):
    rng = random.Random(5)
    plain = ["word%s" % "".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(40)]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(40), rng.choice(["scoundrel", "nincompoop", "vequ" + rng.choice(["a", "lo", "ti"]) + rng.choice("xyz")]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_finds_misspelt_terms_and_spares_quotations(spark):
    rows, labels = toxic_corpus(spark)
    rows += [(10_000, "you scoundrl and nincompop , a scoundrell"), (10_001, 'he wrote "scoundrel" in the text'), (10_002, None), (10_003, ""), (10_001 + 2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, labels)
    assert {"scoundrel", "nincompoop"} <= set(model.lexicon.words) and "vequ" in model.lexicon.starts
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    wrong = [i for i in range(500) if got[i].predicted != (i % 5 == 0)]
    assert not wrong
    assert got[10_000].predicted == 1 and got[10_001].predicted == 0 and got[10_002].predicted == got[10_003].predicted == 0
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == docs.count() - sum(r.predicted for r in toxicity.toxicity(docs, labels).collect())


REPORTS = [
    "the word {} is of greek origin",
    "he called them {}",
    "das wort {} kommt aus dem griechischen",
    "sie nannte ihn einen {} und ging",
    "le mot {} vient du grec",
    "elle cite le terme {} dans son livre",
    "la palabra {} viene del griego",
    "los llamó {} y se fue",
]
VOICES = [
    "you are a {}",
    "i said it. you {}",
    "mark my word you are a {}",
    "du bist ein {}",
    "das sagt ihr {}",
    "tu es un {}",
    "il le dit, vous {}",
    "eres un {}",
    "a {} wrote this",
    "he called. what a {}",
]


def test_reports_are_told_from_the_authors_voice():
    def own(text, hit="zorgle"):
        text = text.format(hit)
        at = text.index(hit)
        return 1 - toxicity.mention(text, at, at + len(hit))

    assert max(map(own, REPORTS)) <= 0.11 and min(map(own, VOICES)) >= 0.7
    assert own("you wrote \"{}\" here") <= 0.06 and own("the word\n{}") == 1.0
    assert own("{}") == 1.0 and own("he called them names and much else besides. {}") > 0.7


def test_toxicity_on_the_given_tables(spark):
    """One edit in a term of the lexicon keeps the verdict, a quotation of it loses it, an innocent neighbour never has it."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.select("doc_id", "text")
    lexicon = toxicity.fit(docs, labels).lexicon
    fuzzy = [w for w in lexicon.words if lexicon.edits[w]]
    assert {"moron", "idiot", "stupid"} <= set(fuzzy)
    neutral = "anreed hestwh of the erresh and whblewh onouer enat of lyestion thatston " * 3
    rows = []
    for w in fuzzy:
        rows += [(w, f"you are a {w}"), (w + " edit", f"you are a {w[:-2] + w[-1]}"), (w + " twice", f"you are a {w[:2] + w[1:]}")]
        rows += [(w + " quoted", f'they wrote "you are a {w}" there'), (w + " said", f"er sagte „{w}“ dazu"), (w + " both", f"»x« «{w}» a été dit")]
        rows += [(w + " report", t.format(w)) for t in REPORTS] + [(w + " voice", t.format(w)) for t in VOICES[:1] + VOICES[3:4] + VOICES[5:6] + VOICES[7:8]]
    rows.append(("oron", "the oron and the oron"))
    more = spark.createDataFrame([(10**9 + i, neutral + t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id - 10**9: r for r in toxicity.toxicity(docs.union(more), labels).where("doc_id >= 1000000000").collect()}
    for i, (name, _) in enumerate(rows):
        assert got[i].predicted == (0 if " quoted" in name or " said" in name or " both" in name or " report" in name or name == "oron" else 1), (name, got[i])


def test_more_evidence_never_lowers_a_score():
    rng = np.random.default_rng(1)
    x = np.c_[np.ones(400), rng.random((400, 4))]
    y = (x[:, 1] + rng.normal(0, 0.1, 400) > 0.8).astype(float)
    x[:, 2] = 1 - x[:, 1] + rng.normal(0, 0.05, 400)
    w = toxicity._logistic(x, y)
    assert (w[list(toxicity.EVIDENCE)] >= 0).all() and w[2] == 0 and w[1] > 1


def distance(a, b):
    row = list(range(len(b) + 1))
    for x in range(1, len(a) + 1):
        new = [x]
        for y in range(1, len(b) + 1):
            new.append(min(row[y] + 1, new[-1] + 1, row[y - 1] + (a[x - 1] != b[y - 1])))
        row = new
    return row[-1]


def test_automaton_by_brute_force():
    rng = random.Random(2)
    make = lambda lo, hi: "".join(rng.choice("abc") for _ in range(rng.randint(lo, hi)))
    lexicon = toxicity.Lexicon({make(3, 10): rng.random() for _ in range(25)}, {make(4, 5): rng.random() for _ in range(3)})
    fuzzy = toxicity.FuzzyLexicon(lexicon)
    for _ in range(3000):
        word = make(1, 11)
        found = [(w, 0) for s, w in lexicon.starts.items() if word.startswith(s)]
        found += [(w, d) for t, w in lexicon.words.items() if (d := distance(t, word)) <= (len(t) >= 5) + (len(t) >= 9)]
        want = min(found, key=lambda x: (x[1], -x[0])) if found else None
        assert fuzzy.match(word) == want, (word, want, fuzzy.match(word))


def test_classifiers_on_awkward_inputs(spark):
    labels = spark.createDataFrame([(i, i % 2, i % 3 == 0) for i in range(40)], "doc_id long, quality int, flag boolean").selectExpr("doc_id", "quality", "int(flag) AS toxic")
    none = labels.limit(0)
    for score in (toxicity.toxicity, quality.quality):
        for docs in (awkward(spark), empty(spark)):
            for known in (labels, none):
                rows = score(docs, known).collect()
                assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)


def test_statistics_by_hand():
    text = "The the THE cat!\n\nA b # 12 été, end. the the\nThe the THE cat!"
    got = dict(zip(quality.STATISTICS, quality.statistics(text.encode())))
    words = text.split()
    raw = text.encode()
    share = lambda chars: sum(raw.count(c.encode()) for c in chars) / len(raw)
    assert got["bytes"] == pytest.approx(np.log1p(len(raw))) and got["words"] == pytest.approx(np.log1p(len(words)))
    assert got["mean_word"] == pytest.approx(np.mean([len(w.encode()) for w in words]))
    assert got["distinct_words"] == pytest.approx(len(set(words)) / len(words)) and got["top_word"] == pytest.approx(4 / len(words))
    assert got["repeats"] == pytest.approx(1 / len(words)) and got["bang"] == pytest.approx(2 / len(raw))
    assert got["upper"] == pytest.approx(share("ABCDEFGHIJKLMNOPQRSTUVWXYZ")) and got["digit"] == pytest.approx(2 / len(raw)) and got["symbol"] == pytest.approx(share("#"))
    assert got["comma"] == pytest.approx(1 / len(raw)) and got["stop"] == pytest.approx(1 / len(raw)) and got["pipe"] == 0 and got["punctuation"] == pytest.approx(share("!!,.") / 2 + share(",.") / 2)
    assert got["white"] == pytest.approx(share(" \n")) and got["non_ascii"] == pytest.approx(4 / len(raw))
    assert got["lines"] == pytest.approx(np.log1p(3)) and got["distinct_lines"] == pytest.approx(2 / 3) and got["mean_line"] == pytest.approx(np.log1p(len(words) / 3))
    assert got["longest_word"] == 6 and got["one_letter"] == pytest.approx(3 / len(words))
    assert got["title_words"] == pytest.approx(3 / len(words)) and got["symbol_words"] == pytest.approx(3 / len(words))
    p = np.unique(np.frombuffer(raw, np.uint8), return_counts=True)[1] / len(raw)
    assert got["entropy"] == pytest.approx(-(p * np.log2(p)).sum())
    assert all(v == 0 for v in quality.statistics(None)) and len(quality.statistics(b"x " * 100_000)) == len(quality.STATISTICS)


@pytest.mark.parametrize("depth", [1, 3, 4, 6])
def test_trees_learn_and_traverse_alike(depth):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 6))
    y = ((x[:, 1] > 0.3) ^ (x[:, 4] < -0.5)).astype(float)
    model = quality.grow(x[:1000], y[:1000], depth=depth)
    score = model.score(x)

    def walk(row):
        margin = model.base
        for f, c, v in zip(model.feature, model.cut, model.value):
            node = 0
            while f[node] >= 0:
                node = 2 * node + 1 + (row[f[node]] > c[node])
            margin += v[node]
        return 1 / (1 + np.exp(-margin))

    assert np.allclose(score[:50], [walk(r) for r in x[:50]])
    assert depth < 3 or ((score[1000:] >= 0.5) == y[1000:]).mean() > 0.95


def test_quality_on_held_out_rows(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        good = i % 3 > 0
        words = ["".join(rng.choice("aeioustr") for _ in range(rng.randint(2, 7))) for _ in range(60)]
        rows.append((i, " ".join(words if good else [w + "$$$" for w in words])))
        labels.append((i, int(good), 0))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = [r for r in quality.quality(docs, known).collect() if r.held_out]
    assert len(got) > 50 and all(r.predicted == (r.doc_id % 3 > 0) for r in got)
