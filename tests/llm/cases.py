"""Small documents with the awkward cases, and plain Python helpers."""

import random

SCHEMA = "doc_id long, text string, source string, mix_plan string, toxicity_score double, part int, chosen_component int, contaminated_doc int"


def awkward_rows(seed: int = 1, n: int = 60) -> list[tuple]:
    """Nulls, empty and very long texts, ties, repeated rows, copies, near copies, odd characters."""
    rng = random.Random(seed)
    vocabulary = ["the", "of", "Über", "naïve", "été", "x1", "IT", "zz", "end.", "(so)", "42", "a—b", "日本", "İz"] + ["w%d" % i for i in range(40)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 80))) for _ in range(n)]
    texts += [None, "", " \t\n", "one", "one two", "\x1c\x85\xa0 odd", "A" * 5000, " ".join(rng.choice(vocabulary) for _ in range(30_000))]
    texts += [texts[0]] * 12 + [texts[1].upper(), texts[2] + " tail", "zz " * 700, None, ""]
    rows = [(i, t, rng.choice(["b", "a", "Z", None, "é"])) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, "no id", "a"), (None, texts[0], None)]
    rng.shuffle(rows)
    return [(*r, "x", 0.5, 1, 2, 3) for r in rows]


def awkward(spark, seed: int = 1, n: int = 60):
    return spark.createDataFrame(awkward_rows(seed, n), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
