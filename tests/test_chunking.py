import random

import pytest

from corvane.errors import ConfigurationError
from corvane.operators.chunking import chunk_documents

from . import scalar_model as model


def random_text(rng):
    parts = ["word", "a", "long-ish words here", "#", "# ", "## Head ", "# Same", "#x", "\n", "\n\n", "\n", " ", "  lead", "\t", "\x0b", "\x1c", "\x85", " ", "é😀", ".", "\n# Same\n", "\n### Other title\n", "z" * 30]
    return "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))


@pytest.mark.parametrize("strategy", ["fixed", "paragraph", "markdown"])
@pytest.mark.parametrize("size,overlap", [(20, 5), (60, 0), (35, 34), (500, 100)])
def test_random_texts(spark, strategy, size, overlap):
    rng = random.Random(size)
    docs = [(f"dir/my_doc_{i}.md", random_text(rng)) for i in range(120)] + [("x/.md", "text"), ("_.txt", "# T\nbody"), ("n", "   "), ("e.md", ""), ("h.md", "# only\n## headings\n"), ("none.md", None)]
    want = [c for p, t in docs for c in model.chunks(p, t or "", strategy, size, overlap)]
    got = [(*r[:7], tuple(r.metadata)) for r in chunk_documents(spark.createDataFrame(docs, "source_path string, text string"), strategy, size, overlap).collect()]
    assert sorted(got) == sorted(want) or sorted(map(str, got)) == sorted(map(str, want))


def test_fixed_vectors(spark):
    def run(text, strategy, size, overlap):
        return chunk_documents(spark.createDataFrame([("d.md", text)], "source_path string, text string"), strategy, size, overlap).orderBy("chunk_index").collect()

    got = run("   some words behind a margin of blanks    ", "fixed", 20, 5)
    assert got[0].start_char == 3
    got = run("a" * 95, "paragraph", 30, 5)
    assert len(got) == 4 and got[1].start_char == 25 and all(len(r.text) <= 30 for r in got)
    # An overlap of 0 still repeats the last block of a group of several.
    got = run("aaaaa\n\nbbbbb\n\n# S\n\nccccc", "markdown", 100, 0)
    assert [r.text for r in got] == ["aaaaa\n\nbbbbb", "bbbbb", "ccccc"]
    # A fixed chunk that begins on a heading lies in no section and takes the last one.
    assert run("# First\nbody one\n# Last\nbody two", "fixed", 10, 0)[0].title == "Last"


def test_bad_parameters(spark):
    docs = spark.createDataFrame([("a.md", "x")], "source_path string, text string")
    for size, overlap in [(0, 0), (10, -1), (10, 10), (10, 11)]:
        with pytest.raises(ConfigurationError):
            chunk_documents(docs, "fixed", size, overlap)
    with pytest.raises(ConfigurationError):
        chunk_documents(docs, "other")
