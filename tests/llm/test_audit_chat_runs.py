"""Filter audit, chat windows and periodic runs against plain models."""

import hashlib
import random
import re
import zlib
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import chat_format, filter_audit, periodic_runs
from tests.llm.cases import awkward_rows


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# --- filter audit -----------------------------------------------------------


def audit_model(rows, labels):
    """``rows (id, text, part)`` and ``labels (id, quality, toxic)``, every order played through."""
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    judged = []
    for i, text, part in rows:
        t = text or ""
        w = words_of(t)
        failed = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
            "D": any(c in "#$%&*|" for c in t),
            "E": i is not None and i > least[t],
        }
        judged.append((part or "", {k for k, v in failed.items() if v}, i in good, i in toxic))
    out = {}
    for part in {p for p, *_ in judged}:
        own = [x for x in judged if x[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                removed = [x for x in left if f in x[1]]
                redundant = sum(f in x[1] for x in own) - len(removed)
                left = [x for x in left if f not in x[1]]
                shapley[f] += len(removed)
                out[part, "".join(order), step] = [len(left), len(removed), redundant, sum(x[1] == {f} for x in own), sum(x[2] for x in removed), sum(x[3] for x in removed)]
        for (p, order, step), figures in out.items():
            if p == part:
                figures.append(shapley[order[step - 1]])
    return out


def test_filter_audit_against_every_order(spark):
    rng = random.Random(11)
    rows = [(r[0], r[1], rng.choice(["en", "de", "", None])) for r in awkward_rows()]
    rows += [(1000 + k, "Loud TEXT $ " * 90, "fr") for k in range(5)] + [(1000, "Loud TEXT $ " * 90, "en"), (1000, "Loud TEXT $ " * 90, "fr")]
    labels = [(r[0], rng.choice([0, 1, None]), rng.choice([0, 1, None])) for r in rows] + [(rows[0][0], 1, 0), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], "doc_id long, text string, lang string, part string, mask int, spread int, first string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    result = filter_audit.audit(filter_audit.document_masks(docs, marks), "ABCDE")
    got = {(r.part, r.filter_order, r.step): list(r)[3:] for r in result.collect()}
    assert got == audit_model(rows, labels)
    none = docs.limit(0)
    assert filter_audit.audit(filter_audit.document_masks(none, marks), "ABCDE").count() == 0
    assert filter_audit.document_masks(docs, marks.limit(0)).agg(F.sum("good") + F.sum("toxic")).first()[0] == 0


def test_intervals_cover_each_order_once():
    for n in (1, 3, 5):
        orders = list(permutations(range(n)))
        for mask in range(1, 2**n):
            step_of = {}
            for m, step, first, after in filter_audit.removal_intervals(n):
                if m == mask:
                    for rank in range(first, after):
                        assert rank not in step_of
                        step_of[rank] = step
            assert step_of == {rank: next(s for s, k in enumerate(order, 1) if mask >> k & 1) for rank, order in enumerate(orders)}


def test_filter_audit_of_other_filters(spark):
    masks = spark.createDataFrame([(None, 3, 4, 1, 0), ("", 0, 2, 0, 0), (None, 3, 1, 0, 1)], "part string, mask int, documents long, good long, toxic long")
    rows = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.good_lost, r.shapley) for r in filter_audit.audit(masks, "xy").collect()}
    assert rows[None, "xy", 1] == (0, 5, 0, 1, 5) and rows[None, "xy", 2] == (0, 0, 5, 0, 5) and rows["", "yx", 2] == (2, 0, 0, 0, 0) and len(rows) == 8
    with pytest.raises(ValueError, match="filters"):
        filter_audit.audit(masks, "xx")


# --- chat windows -----------------------------------------------------------


def tokens_of(text):
    return len(re.findall("[A-Za-z\x80-\U0010ffff]+|[0-9]|[^A-Za-z0-9\x80-\U0010ffff\x20\x09-\x0d]", text)) + 5


def windows_model(rows, budget, history, history_turns, block_turns):
    """Windows as (own turns, repeated turns) of each conversation, one after the other."""
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == conv), key=lambda v: (v[0] is not None, v[0] or 0, v[1].encode(), v[2].encode()))
        block_of = lambda t: (t[0] or 0) // block_turns
        system = turns[0] if turns[0][1] == "system" and block_of(turns[0]) == 0 else None
        span = max((budget - history - (tokens_of(system[2]) if system else 0)) // 2, 1)
        for block in sorted({block_of(t) for t in turns}):
            mine = [(i, t) for i, t in enumerate(turns) if block_of(t) == block]
            position, groups = 0, {}
            for i, t in mine:
                n = tokens_of(t[2])
                if i == 0 and system:
                    groups.setdefault(0, []).append((0, 0, i, t))
                    continue
                groups.setdefault(2 * (position // span) + (n > span), []).append((position, n, i, t))
                position += n
            candidates = [t for t in turns if block_of(t) == block - 1 and t[0] is not None and t[1] != "system" and t[0] >= block * block_turns - history_turns]
            past, total = [], 0
            for t in reversed(candidates):
                total += tokens_of(t[2])
                if total > history:
                    break
                past.insert(0, t)
            for key in sorted(groups):
                own = [t for *_, t in groups[key]]
                has_system = system is not None and groups[key][0][2] == 0
                out.setdefault(conv, []).append((own, ([system] if system and not has_system else []) + past))
                end = groups[key][-1][0] + groups[key][-1][1]
                past = [t for at, n, i, t in groups[key] if t[1] != "system" and end - at <= history]
    return out


def conversations(seed):
    rng = random.Random(seed)
    bits = ["\\", "###", "</turn>", "\n", ": ", "### Assistant: ", "\\s", "\\h", "#", "<", "word", "Straße", "日本", "9", "", "ok. "]
    text = lambda: None if rng.random() < 0.05 else "".join(rng.choice(bits) for _ in range(rng.choice([0, 1, 3, 12, 60])))
    rows = []
    for conv in [None, -1, 0, 1, 2, 3, 4]:
        n = rng.choice([1, 2, 5, 40, 90])
        for turn in range(n):
            role = "system" if turn == 0 and rng.random() < 0.6 else rng.choice(["user", "assistant", "assistant", "system", "tool: a", None])
            rows.append((conv, turn if rng.random() < 0.95 else None, role, text()))
        rows += rng.sample(rows[-n:], 1)
    rng.shuffle(rows)
    return rows


CHAT_SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize(("seed", "block_turns"), [(1, 1024), (2, 16), (3, 7)])
def test_chat_windows_against_a_plain_model(spark, seed, block_turns):
    rows = conversations(seed)
    turns = spark.createDataFrame([(*r, 1, "x") for r in rows], CHAT_SCHEMA + ", block int, kind string")
    options = {"budget": 120, "history": 40, "history_turns": 4, "block_turns": block_turns}
    got = {}
    for r in chat_format.format_windows(turns, **options).orderBy("block", "window").collect():
        pieces = []
        for part in r.text.split(chat_format.CLOSE)[:-1]:
            role, _, body = part[len(chat_format.OPEN) :].partition(": ")
            pieces.append((chat_format_unescape(role), chat_format_unescape(body)))
        learned = [chat_format_unescape(r.text[s.start : s.start + s.length]) for s in r.loss]
        own = pieces[r.n_repeated :]
        assert learned == [x for role, x in own if role == "assistant"]
        assert r.tokens == sum(tokens_of(x) for _, x in pieces)
        assert r.tokens <= 120 or len([p for p in own if p[0] != "system"]) <= 1 or r.tokens - sum(tokens_of(x) for role, x in pieces if role == "system") <= 121
        got.setdefault(r.conv_id, []).append((own, pieces[: r.n_repeated]))
    want = {c: [([t[1:] for t in own], [t[1:] for t in past]) for own, past in ws] for c, ws in windows_model(rows, **options).items()}
    assert got == want


def chat_format_unescape(text):
    codes = {"s": "\\", "h": "###", "e": "</turn>", "c": ":"}
    return re.sub(r"\\(.)", lambda m: codes[m[1]], text)


@pytest.mark.parametrize("whole_chars", [10**6, 300])
def test_chat_digests_of_short_wide_and_huge_conversations(spark, whole_chars):
    rows = conversations(5)
    turns = spark.createDataFrame(rows, CHAT_SCHEMA)
    got = {r.conv_id: r for r in chat_format.read_back(turns, block_turns=16, whole_chars=whole_chars, budget=100, history=30).collect()}
    assert len(got) == len({r[0] for r in rows})
    for conv, r in got.items():
        own = sorted(((t, role or "", x or "") for c, t, role, x in rows if c == conv), key=lambda v: (v[0] is not None, v[0] or 0, v[1].encode(), v[2].encode()))
        # Rows without a turn number count for the first block.
        said = "".join(f"{role}\n{x}\n" for _, role, x in own)
        learned = "".join(x for _, role, x in own if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(own), hashlib.sha256(said.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert chat_format.read_back(turns.limit(0)).count() == 0


def test_chat_query_runs_no_python(spark):
    from tests.conftest import DATA

    plan = chat_format.op12_chat_format(spark, str(DATA))._jdf.queryExecution().toString()
    assert "Python" not in plan and "MapInArrow" not in plan


# --- periodic runs ----------------------------------------------------------


def runs_model(w, least=24, times=3):
    """All runs by looking at every period and every start."""
    n, out = len(w), []
    for q in range(1, n // times + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, times * q):
                s = w[i : i + length]
                if not any(s[: length - p] == s[p:] for p in range(1, q)):
                    out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out)


@pytest.mark.parametrize(("least", "times"), [(24, 3), (10, 3), (1, 3), (9, 4), (30, 5)])
def test_runs_against_all_periods(least, times):
    rng = random.Random(least)
    for _ in range(150):
        docs = []
        for _ in range(rng.randint(1, 4)):
            w = []
            for _ in range(rng.randint(0, 5)):
                block = [rng.randint(0, rng.choice([1, 2, 5, 30])) for _ in range(rng.randint(1, 40))]
                w += (block * 99)[: rng.randint(1, 120)] if rng.random() < 0.6 else block
            docs.append(w)
        bounds = np.r_[0, np.cumsum([len(d) for d in docs])].astype(np.int64)
        found = periodic_runs.find_runs(np.array([x for d in docs for x in d], np.int64), bounds, least, times)
        assert found == [(k, *r) for k, d in enumerate(docs) for r in runs_model(d, least, times)]


def test_one_word_two_million_times():
    n = 2_000_000
    assert periodic_runs.find_runs(np.zeros(n, np.int64), np.array([0, n])) == [(0, 0, n, 1)]
    with pytest.raises(ValueError, match="three"):
        periodic_runs.find_runs(np.zeros(9, np.int64), np.array([0, 9]), times=2)


def digest_of(doc_id, text, plant=True):
    w = words_of(text)
    n = len(w)
    h = zlib.crc32(str(doc_id).encode())
    if plant and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = runs_model(w)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    milli = None if not runs else 1000 * best[1] // best[2]
    return (doc_id, len(runs), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest(), n)


def test_periodic_query_against_a_plain_model(spark, tmp_path):
    # The longest text of the awkward rows is cut here, as the model tries every period.
    rows = [(i, " ".join((t or "").split(" ")[:900]) if t else t) for i, t, *_ in awkward_rows(n=40)]
    rows += [(k, " ".join(f"w{j * j % 97}" for j in range(k % 150))) for k in range(500, 700)] + [(900 + k, "ha " * 30 + "x y z " * k) for k in range(12)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, periodic_runs.op13_periodic_runs(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted((digest_of(*r) for r in rows), key=repr)
    assert sum(r[1] > 0 for r in got) > 20


def test_periodic_batches_and_empty_tables(spark):
    docs = spark.createDataFrame([(k, "ab cd " * k, "x", 3) for k in range(40)], "doc_id long, text string, runs string, n_words int").coalesce(1)
    one = sorted(map(tuple, periodic_runs.periodic_runs(docs).collect()))
    assert one == sorted(map(tuple, periodic_runs.periodic_runs(docs, batch_words=7).collect()))
    assert one[13][2][0].asDict() == {"start": 0, "length": 26, "period": 2} and one[13][3] == "ab cd"
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0
