"""Toxicity: a learned lexicon, matched with spelling errors and judged by context.

The lexicon is learned from labelled documents: words, and beginnings of words,
that toxic documents have and others hardly ever.  Matching runs the
Levenshtein automata of all entries at once: the set of trie nodes reachable
with so many edits is one state of an automaton that is built lazily and kept,
so a word costs a few dictionary look-ups and most words fail at once.

A misspelt hit counts like the entry itself, unless its spelling is known from
clean documents; entries whose neighbourhood is full of innocent words are not
matched fuzzily.  Each hit is weighted by its window: the nearer it is to a
quotation or a report, the less it counts.  A logistic regression over the few
figures of a document gives the score; the weights of evidence are not negative,
so a further hit never lowers a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.labelled import TRAIN_ROWS, held_out, training_sample
from corvane.llm.staging import fresh, scratch, staged

PREFIXES = (4, 5, 6, 7, 8)
MIN_DOCS = 4
MOST_OTHER = 0.004
DOUBT = 0.01
#: Words of so many letters may have one edit, and two.
FUZZY_WORDS = (5, 9)
#: An entry is matched fuzzily if new innocent spellings turn up in at most this share of clean documents.
INNOCENT = 0.0005
#: A spelling that clean documents have counts from this log-odds on.
SURE = 2.0
#: States and words that a task remembers, about a kilobyte and 150 bytes each; beyond that it forgets them all and starts again.
MOST_STATES, MOST_KNOWN = 200_000, 500_000
CONTEXT = 60
#: What a quotation, a report somewhere in the window, and a report that governs the span explain of a hit.
QUOTED, REPORTED, GOVERNED = 0.95, 0.3, 0.9
#: Words that may stand between a reporting word and the span that it governs.
GOVERNS = 2
THRESHOLD = 0.5
_WORD = re.compile(r"[^\W\d_]+")
# Quotation marks, and reporting words in English, German, French and Spanish.
_OPEN, _CLOSE, _PLAIN = "“«„‹", "”»“›", "\""
_REPORT = re.compile(
    r"\b(?:(?P<en>said|says|wrote|writes|quoted?|quoting|called|calls|cited|reported|word|term)"
    r"|(?P<de>sagte|sagt|schrieb|schreibt|zitiert|zitierte|nannte|nennt|berichtet|wort|begriff)"
    r"|(?P<fr>dit|disait|écrit|écrivait|cite|citait|appelle|appelait|rapporte|mot|terme)"
    r"|(?P<es>dijo|dice|escribió|escribe|cita|citó|llamó|llama|informó|palabra|término))\b"
)
# Words that address the reader, by language, as "du" is such a word in German and an article in French.
_ADDRESS = {
    "en": re.compile(r"\b(?:you|your|yours|youre|u|ur)\b"),
    "de": re.compile(r"\b(?:du|dich|dir|dein|deine|deiner|ihr|euch|euer|eure)\b"),
    "fr": re.compile(r"\b(?:tu|te|toi|ton|ta|tes|vous|votre|vos)\b"),
    "es": re.compile(r"\b(?:tú|ti|tus|usted|ustedes|vosotros|eres|sois)\b"),
}
_SPAN = re.compile(r"“[^”\n]*”|«[^»\n]*»|„[^“\n]*“|‹[^›\n]*›|\"[^\"\n]*\"")


def edits_allowed(term: str) -> int:
    """Edits that a word of the lexicon may have, by its length."""
    return sum(len(term) >= n for n in FUZZY_WORDS)


@dataclass
class Lexicon:
    """Entries with weights: whole words, and beginnings of words.

    ``edits`` are those of words that differ from :func:`edits_allowed`;
    ``spellings`` are the weights of misspelt forms that clean documents have.
    """

    words: dict[str, float] = field(default_factory=dict)
    starts: dict[str, float] = field(default_factory=dict)
    edits: dict[str, int] = field(default_factory=dict)
    spellings: dict[str, float] = field(default_factory=dict)


class FuzzyLexicon:
    """Levenshtein automata of the lexicon's entries, intersected with its trie.

    ``match(word)`` gives (weight, edits) of the best entry or None: the one
    with the fewest edits, and of these the heaviest.  Whole words may have as
    many edits as the lexicon says; beginnings are matched as they are, for an
    edit in a beginning says little.
    """

    def __init__(self, lexicon: Lexicon, most_states: int = MOST_STATES, most_known: int = MOST_KNOWN):
        self.lexicon = lexicon
        self.most_states, self.most_known = most_states, most_known
        self.children: list[dict[str, int]] = [{}]
        self.edits_left = [0]  # the most edits of an entry below the node
        self.word_at: dict[int, tuple[str, float, int]] = {}
        self.start_at: dict[int, float] = {}
        heads: dict[int, set[str]] = {}
        tails: dict[int, set[str]] = {}
        middles: dict[int, set[str]] = {}
        for entries, whole in ((lexicon.words, True), (lexicon.starts, False)):
            for term, weight in entries.items():
                edits = lexicon.edits.get(term, edits_allowed(term)) if whole else 0
                node = 0
                path = [0]
                for c in term:
                    node = self.children[node].setdefault(c, len(self.children))
                    if node == len(self.children):
                        self.children.append({})
                        self.edits_left.append(0)
                    path.append(node)
                for p in path:
                    self.edits_left[p] = max(self.edits_left[p], edits)
                if whole:
                    self.word_at[node] = (term, weight, edits)
                else:
                    self.start_at[node] = weight
                cuts = [len(term) * k // (edits + 1) for k in range(edits + 2)]
                pieces = [term[a:b] for a, b in zip(cuts, cuts[1:])]
                for piece, where in ((pieces[0], heads), *((x, middles) for x in pieces[1:-1]), (pieces[-1], tails)):
                    where.setdefault(len(piece), set()).add(piece)
        self.heads, self.tails = (list(x.items()) for x in (heads, tails))
        #: The first two letters of a word that may begin with a piece, and the last two of one that may end with one.
        self.begin = {piece[:2] for _, pieces in self.heads for piece in pieces}
        self.end = {piece[-2:] for _, pieces in self.tails for piece in pieces}
        inner = sorted(set().union(*middles.values()))
        self.inside = re.compile("|".join(map(re.escape, inner)) or r"(?!)").search
        self._forget()

    def _forget(self) -> None:
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.accepts: list[tuple[float, int, str] | None] = []
        self.begun: list[float | None] = []
        self.first = self._state({(0, 0)})
        self.known: dict[str, tuple[float, int, str] | None] = {}

    def _state(self, pairs: set[tuple[int, int]]) -> int:
        """The number of the state of these (node, edits) pairs and all that a missing letter leads to."""
        least: dict[int, int] = {}
        todo = list(pairs)
        while todo:
            node, edits = todo.pop()
            if edits > self.edits_left[node] or least.get(node, 99) <= edits:
                continue
            least[node] = edits
            todo += [(child, edits + 1) for child in self.children[node].values()]
        key = frozenset(least.items())
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            found = [(w, e, t) for n, e in key if n in self.word_at for t, w, most in [self.word_at[n]] if e <= most]
            self.accepts.append(min(found, key=lambda x: (x[1], -x[0], x[2])) if found else None)
            begun = [self.start_at[n] for n, e in key if e == 0 and n in self.start_at]
            self.begun.append(max(begun) if begun else None)
        return self.states[key]

    def _step(self, state: int, c: str) -> int:
        out: set[tuple[int, int]] = set()
        for node, edits in self.sets[state]:
            out.add((node, edits + 1))  # a letter too many
            for letter, child in self.children[node].items():
                out.add((child, edits + (letter != c)))
        self.steps[state][c] = nxt = self._state(out)
        return nxt

    def possible(self, word: str) -> bool:
        """Whether the automata need to run: with k edits at most, one of k + 1 pieces of an entry is left whole.

        The first piece is then the word's beginning and the last one its end.
        """
        return (
            (word[:2] in self.begin and any(word[:n] in pieces for n, pieces in self.heads))
            or (word[-2:] in self.end and any(word[-n:] in pieces for n, pieces in self.tails))
            or self.inside(word) is not None
        )

    def find(self, word: str) -> tuple[float, int, str] | None:
        """(weight, edits, entry) of the best entry; a beginning's name is empty."""
        if not self.possible(word):
            return None
        if len(self.sets) > self.most_states:
            self._forget()
        state, best = self.first, None
        for c in word:
            nxt = self.steps[state].get(c)
            state = self._step(state, c) if nxt is None else nxt
            if not self.sets[state]:
                break
            if self.begun[state] is not None:
                best = (max(self.begun[state], best[0] if best else 0.0), 0, "")
        else:
            found = self.accepts[state]
            if found and (best is None or (found[1], -found[0]) < (best[1], -best[0])):
                best = found
        return best

    def match(self, word: str) -> tuple[float, int] | None:
        found = self.find(word)
        return found and found[:2]

    def weights(self, words: set[str]) -> dict[str, float]:
        """What the words count that match anything; with a memory of the last words."""
        known = self.known
        for word in [w for w in words if w not in known]:
            found = self.find(word)
            known[word] = 0.0 if found is None else self.lexicon.spellings.get(word, found[0]) if found[1] else found[0]
        out = {word: known[word] for word in words if known[word]}
        if len(known) > self.most_known:
            known.clear()
        return out


def mention(text: str, start: int, end: int, reach: int = CONTEXT) -> float:
    """From 0 (said by the author) to 1 (someone else's words): the score of the window around a span of lower-case ``text``.

    Inside quotation marks of its line the span scores ``QUOTED``.  A reporting
    word counts the more the nearer it stands, at most ``REPORTED``; one that
    governs the span, with ``GOVERNS`` words or fewer between them in its
    sentence, counts ``GOVERNED``, unless the reader is addressed in the same
    sentence and language, which is the author's own voice.  Quotation and report together
    leave what neither explains.
    """
    left = text[max(0, start - reach) : start]
    right = text[end : end + reach]
    left = left[left.rfind("\n") + 1 :]
    right = right.partition("\n")[0]
    quoted = any(left.rfind(a) > left.rfind(b) and b in right for a, b in zip(_OPEN, _CLOSE)) or (left.count(_PLAIN) % 2 == 1 and _PLAIN in right)
    reports = list(_REPORT.finditer(left))
    near = [len(left) - m.end() for m in reports] + [m.start() for m in _REPORT.finditer(right)]
    reported = REPORTED * (1 - min(near) / reach) if near else 0.0
    if reports:
        between = left[reports[-1].end() :]
        sentence = re.split(r"[.!?]", left)[-1] + text[start:end] + re.split(r"[.!?]", right)[0]
        if not re.search(r"[.!?;]", between) and len(_WORD.findall(between)) <= GOVERNS and not _ADDRESS[reports[-1].lastgroup].search(sentence):
            reported = GOVERNED
    return 1 - (1 - QUOTED * quoted) * (1 - reported)


#: Figures of a document; those of ``EVIDENCE`` never get a negative weight.
FIGURES = ("one", "weight", "distinct", "density", "length")
EVIDENCE = (1, 2, 3)


def document_figures(text: str | None, lexicon: FuzzyLexicon) -> list[float]:
    """The figures of ``FIGURES`` for one text: hits count by their entry and by how little they are mentions."""
    low = (text or "").lower()
    words = _WORD.findall(low)
    hits = lexicon.weights(set(words))
    weight = n = 0.0
    direct: dict[str, float] = {}
    if hits:
        for m in _WORD.finditer(low):
            if found := hits.get(m[0]):
                own = 1 - mention(low, m.start(), m.end())
                n += own
                weight += found * own
                direct[m[0]] = max(own, direct.get(m[0], 0.0))
    return [1.0, math.log1p(weight), math.log1p(sum(direct.values())), 10.0 * n / (len(words) + 10), math.log1p(len(words)) / 10]


def _terms(text: str | None) -> set[str]:
    """Words, and beginnings of longer words marked by a star, of a text."""
    words = set(_WORD.findall((text or "").lower()))
    return {w for w in words if len(w) >= 4} | {w[:k] + "*" for w in words for k in PREFIXES if len(w) > k}


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """The lexicon of a labelled sample ``(text, label)``.

    Candidates are the terms of at least ``MIN_DOCS`` toxic documents; the
    sample is bounded, and so is their number.  They are then counted in the
    other documents, but for what stands in quotation marks there.  An entry
    must be unlikely by chance, given how many terms are tried.
    """
    def counted(rows: DataFrame, only: frozenset | None) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: Counter = Counter()
            for batch in batches:
                for text in (t.as_py() for t in batch.column(0)):
                    found.update(_terms(text) if only is None else _terms(_SPAN.sub(" ", text or "")) & only)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["term", "n"])

        return rows.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))

    sizes = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    toxic, other = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic:
        return Lexicon()
    seen = {r.term: r.n for r in counted(sample.where("label = 1"), None).where(F.col("n") >= MIN_DOCS).collect()}
    against = {r.term: r.n for r in counted(sample.where("label = 0"), frozenset(seen)).collect()}
    weights = {}
    rate = toxic / (toxic + other)
    chance = math.log(DOUBT / max(len(seen), 1))  # many terms are tried, so each must be the less likely by chance
    for term, n in seen.items():
        m = against.get(term, 0)
        luck = n * math.log(rate) + m * math.log1p(-rate) + math.lgamma(n + m + 1) - math.lgamma(n + 1) - math.lgamma(m + 1) if other else 0.0
        if m / max(other, 1) <= min(MOST_OTHER, 0.05 * n / toxic) and (luck <= chance or not other):
            weights[term] = _log_odds(n, m, toxic, other)
    # A beginning stands for all longer terms that it covers.
    starts = {}
    for term in sorted((t for t in weights if t.endswith("*")), key=len):
        if not any(term[:k] in starts for k in range(min(PREFIXES), len(term) - 1)):
            starts[term[:-1]] = weights[term]
    words = {t: w for t, w in weights.items() if not t.endswith("*") and not any(t[:k] in starts for k in range(min(PREFIXES), len(t) + 1))}
    # A beginning that only one word has is that word; as a word it may be misspelt.
    for start in list(starts):
        whole = [t for t in weights if not t.endswith("*") and t.startswith(start)]
        if any(seen[t] >= 0.95 * seen[start + "*"] for t in whole):
            words |= {t: weights[t] for t in whole}
            del starts[start]
    lexicon = Lexicon(words, starts)
    learn_spellings(lexicon, sample, toxic, other)
    return lexicon


def _log_odds(n: int, m: int, toxic: int, other: int) -> float:
    return math.log((n + 0.5) / (toxic + 1)) - math.log((m + 0.5) / (other + 1))


def learn_spellings(lexicon: Lexicon, sample: DataFrame, toxic: int, other: int) -> None:
    """Set the edits of each word, and the weights of the misspelt forms that clean documents have.

    A form that clean documents have counts by its own log-odds, from ``SURE``
    on, and never more than the entry.  How often a form not met before will be
    innocent is judged by the forms that the clean documents have just once: a
    word has the edits with which these stay rare.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fuzzy = FuzzyLexicon(lexicon)
        for batch in batches:
            rows = []
            for text, label in zip((t.as_py() for t in batch.column(0)), batch.column(1).to_pylist()):
                for word in sorted(set(_WORD.findall((text or "").lower()))):
                    found = fuzzy.find(word)
                    if found and found[1]:
                        rows.append((found[2], found[1], word, label))
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.int32()))], ["entry", "edits", "word", "label"])

    met = sample.select("text", "label").mapInArrow(run, "entry string, edits int, word string, label int")
    forms = met.groupBy("entry", "edits", "word").agg(F.sum("label").alias("n"), F.sum(1 - F.col("label")).alias("m")).collect()
    new: Counter = Counter()
    for r in forms:
        if r.m == 1:
            new.update({(r.entry, e): 1 for e in range(r.edits, len(FUZZY_WORDS) + 1)})
        if r.m:
            own = _log_odds(r.n, r.m, toxic, other)
            lexicon.spellings[r.word] = min(own, lexicon.words[r.entry]) if own >= SURE else 0.0
    for entry in lexicon.words:
        most = edits_allowed(entry)
        while most and new[entry, most] > max(1, INNOCENT * other):
            most -= 1
        lexicon.edits[entry] = most


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, rounds: int = 50) -> np.ndarray:
    """Ridge logistic regression by Newton steps, with weights of ``EVIDENCE`` that are not negative."""
    used = list(range(x.shape[1]))
    while True:
        w = np.zeros(len(used))
        penalty = np.full(len(used), ridge)
        penalty[0] = 1e-6
        z = x[:, used]
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-9), z.T @ (y - p) - penalty * w)
            w += np.clip(step, -4, 4)
            if np.abs(step).max() < 1e-8:
                break
        wrong = [k for k, v in zip(used, w) if k in EVIDENCE and v < 0]
        if not wrong:
            out = np.zeros(x.shape[1])
            out[used] = w
            return out
        used.remove(min(wrong, key=lambda k: w[used.index(k)]))


@dataclass
class ToxicityModel:
    """A learned lexicon and the weights of ``FIGURES``; None weights score everything 0."""

    lexicon: Lexicon
    weights: np.ndarray | None


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = TRAIN_ROWS, **columns) -> ToxicityModel:
    """Learn from about ``most_rows`` labelled rows that are not held out; the figures are computed in Spark."""
    with scratch(docs.sparkSession):
        sample = staged(training_sample(docs, labels, "toxic", most_rows, **columns), "toxic-sample")
        lexicon = learn_lexicon(sample)
        if not (lexicon.words or lexicon.starts):
            return ToxicityModel(lexicon, None)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fuzzy = FuzzyLexicon(lexicon)
            for batch in batches:
                found = [document_figures(t.as_py(), fuzzy) for t in batch.column(0)]
                yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.list_(pa.float64()))], ["label", "figures"])

        rows = sample.mapInArrow(run, "label int, figures array<double>").toArrow()
    x = np.array(rows.column("figures").to_pylist())
    y = rows.column("label").to_numpy().astype(float)
    order = np.lexsort((y, *x.T))  # sums do not depend on the order in which rows arrive
    return ToxicityModel(lexicon, _logistic(x[order], y[order]))


def scored(docs: DataFrame, model: ToxicityModel, text_col: str = "text", name: str = "toxicity_score") -> DataFrame:
    """``docs`` with a score from 0 to 1 in the new column ``name``."""

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        fuzzy = FuzzyLexicon(model.lexicon)
        for batch in texts:
            if model.weights is None or not len(batch):
                yield pa.array(np.zeros(len(batch)))
                continue
            x = np.array([document_figures(t.as_py(), fuzzy) for t in batch])
            yield pa.array(1 / (1 + np.exp(-np.clip(x @ model.weights, -30, 30))))

    return docs.withColumn(name, score(F.col(text_col)))


def toxicity(docs: DataFrame, labels: DataFrame, most_rows: int = TRAIN_ROWS, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Null text is scored as empty, long texts as a whole; a null id is held out;
    without toxic training rows every score is 0; rows that repeat, or share an
    id, are scored each by its text; other columns are not read; an empty table
    gives an empty result.
    """
    model = fit(docs, labels, most_rows, id_col=id_col, text_col=text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return scored(rows, model, name="score").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, most_rows: int = TRAIN_ROWS, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that score ``threshold`` or more; columns unchanged."""
    model = fit(docs, labels, most_rows, id_col=id_col, text_col=text_col)
    name = fresh(docs, "toxicity_score")
    return scored(docs, model, text_col, name).where(F.col(name) < threshold).drop(name)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
