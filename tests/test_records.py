"""Records judged as columns against a plain reader, and line numbers over many files and splits."""

import json
import random

import pytest

from corvane.errors import DataFormatError
from corvane.operators import records
from corvane.operators.index import load_jsonl

GOOD = {"chunk_id": "a::0", "source_path": "a", "title": "", "text": "t\n\"ü\"", "chunk_index": 0, "start_char": 2, "end_char": 2, "metadata": {"start": 2, "section_title": "S", "other": [1]}, "embedding": [1, 2.5, -1e3]}
VALUES = [None, "x", "7", 7, 0, -1, 2.0, 2.5, True, [], [1], [1, None], [None], [1.5, 2], ["1"], [True], [[1]], {}, {"start": "x"}, 2**31, 1e400]


def model(line):
    """The reasons by Python's own reader."""
    try:
        found = json.loads(line, parse_constant=lambda x: 1 / 0)
    except (ValueError, ZeroDivisionError):
        return ["not_json"]
    if not isinstance(found, dict):
        return ["not_an_object"]
    number = lambda x: isinstance(x, int) and not isinstance(x, bool)
    out = []
    for name in records.STRINGS + records.INTEGERS:
        right = isinstance(found.get(name), str) if name in records.STRINGS else number(found.get(name))
        out += [f"missing:{name}"] if name not in found else [] if right else [f"type:{name}"]
    has = {i: found.get(i) for i in records.INTEGERS if number(found.get(i))}
    out += [f"range:{i}" for i in has if has[i] > 2**31 - 1] + [f"negative:{i}" for i in records.INTEGERS[:2] if has.get(i, 0) < 0]
    out += ["span_reversed"] if {"start_char", "end_char"} <= has.keys() and has["end_char"] < has["start_char"] else []
    out += ["metadata_not_object"] if not isinstance(found.get("metadata", {}), dict) else []
    vector = found.get("embedding")
    if vector is not None and not isinstance(vector, list):
        out.append("embedding_not_list")
    elif vector and not all(isinstance(x, int | float) and not isinstance(x, bool) for x in vector):
        out.append("embedding_item")
    return out


def test_reasons_against_a_plain_reader(spark):
    rng = random.Random(4)
    lines = ["", "  ", "{", "[]", "null", "3", '"x"', "{}", json.dumps(GOOD), json.dumps(GOOD)[:-1]]
    for _ in range(400):
        changed = dict(GOOD)
        for _ in range(rng.randint(1, 2)):
            key = rng.choice(list(GOOD))
            value = rng.choice(VALUES[:-1])
            changed.pop(key, None) if rng.random() < 0.2 else changed.update({key: value})
        lines.append(json.dumps(changed))
    rows = spark.createDataFrame(list(enumerate(lines)), "n long, value string").repartition(3)
    got = {r.n: r for r in records.judged(rows).collect()}
    assert sorted(got) == [n for n, x in enumerate(lines) if x.strip()]
    for n, r in got.items():
        assert r.reasons == model(lines[n]), lines[n]
        assert (r.record is None) == bool(r.reasons)
        if not r.reasons:
            want = json.loads(lines[n])
            assert r.record.text == want["text"] and r.record.embedding == (None if want.get("embedding") is None else [float(x) for x in want["embedding"]])
    assert records.judged(rows.limit(0)).count() == 0


def test_the_bad_line_of_many_files_is_named(spark, tmp_path):
    rng = random.Random(5)
    folder = tmp_path / "set"
    folder.mkdir()
    for k in range(4):
        lines = [json.dumps(GOOD | {"chunk_id": f"{k}-{n}", "text": "x" * rng.randint(0, 300)}) if rng.random() < 0.8 else "" for n in range(500)]
        if k >= 2:
            lines[350 + k] = "{broken"
            lines[480] = json.dumps(GOOD | {"title": 3})
        (folder / f"part-{k}.jsonl").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        lines = records.file_lines(spark, str(folder))
        assert lines.select("file", "split").distinct().count() > 8
        bad = records.line_numbers(lines, records.judged(lines).where("size(reasons) > 0")).collect()
        assert sorted((r.file.rpartition("/")[2], r.line, r.reasons[0]) for r in bad) == [("part-2.jsonl", 353, "not_json"), ("part-2.jsonl", 481, "type:title"), ("part-3.jsonl", 354, "not_json"), ("part-3.jsonl", 481, "type:title")]
        with pytest.raises(DataFormatError, match="part-2.jsonl, line 353: not_json"):
            load_jsonl(spark, str(folder))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
