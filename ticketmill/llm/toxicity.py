"""Toxicity scores: a learned lexicon matched with Levenshtein automata, weighed by context.

Lexicon. Words and word beginnings (stems) of PREFIXES letters are counted per text of a bounded
sample of labelled texts (SAMPLE rows in order of a hash of doc_id, equal texts once). Those that
stand almost only in toxic texts, in at least SUPPORT of them, become terms; of nested ones the
longest that loses hardly any text stays. The words that begin with a stem and stand almost only in
toxic texts, in FORMS of them or more, become terms beside it.

Matching. The terms form a trie. A word is read letter by letter by the product of the trie and
the Levenshtein automaton (insertion, deletion, substitution, swap of neighbours), whose states
are made as they are met and kept. Words of 5 letters or more may have one edit, of 9 or more two,
at any letter; shorter ones none, as most words so short are an edit from another. A stem matches a
word that begins with it. It leaves the rest of a word open, so stems of PREFIXES letters have no
edits; misspellings of the family are those of its words. A word near a term is no misspelling if
FORMS texts of the sample or more hold it and most of them are clean ("closer" beside "loser").

Context. A hit between quotation marks, or with a word of reporting in the REACH words before it,
counts QUOTED, otherwise 1. A logistic model of the weighed hits, their density and the
share of misspelled ones gives the score; it is fitted to the same sample.

Results for odd input: null, empty and blank texts have no hits and get the score of any text
without hits; without labelled toxic texts all scores are 0; several labels of a doc_id count as
toxic if any is; repeated rows score alike; a null doc_id has no label and is held out; extra
columns are ignored. Scores read the text alone, very long ones whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketmill.llm import common as c

FOLDS = 5
SAMPLE = 20_000
TERMS = 2_000
PREFIXES = (4, 5, 6)
SUPPORT = 0.02
FORMS = 5
PURITY = 0.95
REACH = 5
QUOTED = 0.25
CACHE = 400_000
STEM = "*"

#: Words of reporting and quotation marks.
REPORTING = frozenset("said says say wrote writes called calls quote quoted quotes word words term terms dijo dit sagte schrieb llamó appelé genannt".split())
MARKS = "\"“”«»„"

RESULT = "doc_id long, score double, n_hits long, n_misspelled long, n_quoted long"
_RESULT = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())] + [(x, pa.int64()) for x in ("n_hits", "n_misspelled", "n_quoted")])

TOKEN = re.compile(rf"\w+|[{MARKS}]")


def edits_allowed(length: int, stem: bool) -> int:
    """A stem leaves the rest of a word open, so it needs two letters more than a word."""
    length -= 2 * stem
    return 2 if length >= 9 else 1 if length >= 5 else 0


class Matcher:
    """The Levenshtein automaton of all terms at once: states are sets of (trie node, edits, swap).

    first: whether edits may also replace, drop or add letters at the beginning.
    usual: words that are no misspellings of a term.
    """

    def __init__(self, words: list[str], stems: list[str], first: bool = False, usual: list[str] | None = None):
        self.first = first
        self.usual = frozenset(usual or ())
        self.children: list[dict[str, int]] = [{}]
        self.most: list[int] = [-1]  # edits with which a node's word ends a match
        self.stem: list[int] = [-1]  # and a node's stem
        self.room: list[int] = [0]  # most edits of any term below a node
        for terms, ends in ((words, self.most), (stems, self.stem)):
            for term in terms:
                self._add(term, ends, edits_allowed(len(term), ends is self.stem))
        self.ids: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.kept: dict[str, int] = {}
        self.start = self._state(self._closed({(0, 0, "")}))

    def _add(self, term: str, ends: list[int], room: int) -> None:
        node = 0
        self.room[0] = max(self.room[0], room)
        for letter in term:
            if letter not in self.children[node]:
                self.children[node][letter] = len(self.children)
                self.children.append({})
                for values in (self.most, self.stem, self.room):
                    values.append(-1 if values is not self.room else 0)
            node = self.children[node][letter]
            self.room[node] = max(self.room[node], room)
        ends[node] = max(ends[node], room)

    def _closed(self, state: set) -> frozenset:
        """With the letters of a term that the word leaves out; of equal places only the fewest edits."""
        todo, best = list(state), {}
        while todo:
            node, edits, swap = todo.pop()
            if edits > self.room[node] or best.get((node, swap), 99) <= edits:
                continue
            best[node, swap] = edits
            if not swap and (node or self.first):
                todo += [(child, edits + 1, "") for child in self.children[node].values()]
        return frozenset((node, edits, swap) for (node, swap), edits in best.items())

    def _state(self, state: frozenset) -> int:
        if state not in self.ids:
            self.ids[state] = len(self.states)
            self.states.append(state)
            self.moves.append({})
        return self.ids[state]

    def _step(self, number: int, letter: str) -> int:
        after = set()
        for node, edits, swap in self.states[number]:
            if swap:  # the second letter of a swapped pair
                if swap == letter:
                    after.add((node, edits, ""))
                continue
            if node or self.first:
                after.add((node, edits + 1, ""))  # a letter too many
            for own, child in self.children[node].items():
                if node or self.first or own == letter:
                    after.add((child, edits + (own != letter), ""))
                if own != letter and letter in self.children[child]:
                    after.add((self.children[child][letter], edits + 1, own))
        return self._state(self._closed(after))

    def edits(self, word: str) -> int:
        """Edits of the nearest term that the word matches; -1: none."""
        found = self.kept.get(word)
        if found is None:
            found = self._edits(word)
            if found > 0 and word in self.usual:
                found = -1
            if len(self.kept) >= CACHE:
                self.kept.clear()
            self.kept[word] = found
        return found

    def _edits(self, word: str) -> int:
        number, least = self.start, 99
        for letter in word:
            following = self.moves[number].get(letter)
            if following is None:
                following = self.moves[number][letter] = self._step(number, letter)
            number = following
            state = self.states[number]
            if not state:
                break
            least = min([least, *(e for n, e, s in state if not s and e <= self.stem[n])])
        else:
            least = min([least, *(e for n, e, s in self.states[number] if not s and e <= self.most[n])])
        return least if least < 99 else -1


@dataclass
class Model:
    words: list[str] = field(default_factory=list)
    stems: list[str] = field(default_factory=list)
    usual: list[str] = field(default_factory=list)
    weights: np.ndarray | None = None

    def matcher(self) -> Matcher:
        return Matcher(self.words, self.stems, first=True, usual=self.usual)


def hits(text: str, matcher: Matcher) -> tuple[int, int, int, int, float, float]:
    """(tokens, hits, misspelled, quoted, weighed exact hits, weighed misspelled hits)."""
    tokens = TOKEN.findall(text.lower())
    edits = matcher.edits
    found = {t: e for t in set(tokens) if (e := edits(t)) >= 0}
    if not found:
        return len(tokens), 0, 0, 0, 0.0, 0.0
    inside, n, wrong, quoted, exact, near = False, 0, 0, 0, 0.0, 0.0
    marks = sum(t in MARKS for t in tokens)
    for i, token in enumerate(tokens):
        if token in MARKS:
            marks -= 1
            inside = not inside and marks > 0
        elif token in found:
            told = inside or not REPORTING.isdisjoint(tokens[max(0, i - REACH) : i])
            weight = QUOTED if told else 1.0
            n, quoted = n + 1, quoted + told
            if found[token]:
                wrong, near = wrong + 1, near + weight
            else:
                exact += weight
    return len(tokens), n, wrong, quoted, exact, near


def features(found: tuple) -> list[float]:
    tokens, _, _, _, exact, near = found
    return [1.0, np.log1p(exact + near), 10 * (exact + near) / max(tokens, 1), float(exact + near > 0), near / max(exact + near, 1.0)]


def choose_terms(counts: list[tuple[str, bool, int]]) -> tuple[list[str], list[str]]:
    """(words, stems) from (term, whether a stem, toxic texts)."""
    by_term = {(t, s): n for t, s, n in counts}

    def extended(term: str, n: int) -> bool:
        return any(t.startswith(term) and (t, s) != (term, True) and m >= PURITY * n for (t, s), m in by_term.items() if len(t) >= len(term))

    stems = [t for (t, s), n in by_term.items() if s and not extended(t, n)]
    kept = [t for t in stems if not any(t != o and t.startswith(o) for o in stems)]
    words = [t for (t, s) in by_term if not s and not any(t.startswith(o) for o in kept)]
    return sorted(words), sorted(kept)


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.5, steps: int = 40) -> np.ndarray:
    """Weights by Newton's method, with a small penalty on all but the first."""
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[0] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(True))


def _beginnings(words: F.Column, n: int) -> F.Column:
    long = F.filter(words, lambda w: F.length(w) >= n)
    return F.transform(long, lambda w: F.concat(F.substring(w, 1, n), F.lit(STEM)))


def _terms(train: DataFrame) -> list[tuple[str, bool, int]]:
    """Terms that stand almost only in toxic texts, the most frequent TERMS of them."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\w{3,}"), F.lit(0)))
    begins = [_beginnings(words, n) for n in PREFIXES]
    toxic_texts = train.agg(F.sum("toxic")).first()[0] or 0
    counts = (
        train.select("toxic", F.explode(F.array_distinct(F.concat(words, *begins))).alias("term"))
        .groupBy("term")
        .agg(F.sum("toxic").alias("toxic"), F.count("*").alias("texts"))
        .filter((F.col("toxic") >= max(5, SUPPORT * toxic_texts)) & (F.col("toxic") >= PURITY * F.col("texts")))
        .orderBy(F.desc("toxic"), "term")
        .limit(TERMS)
    )
    return [(r.term.removesuffix(STEM), r.term.endswith(STEM), r.toxic) for r in counts.collect()]


def _forms(train: DataFrame, stems: list[str]) -> list[str]:
    """The words that begin with a stem and stand almost only in toxic texts."""
    if not stems:
        return []
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\w{3,}"), F.lit(0)))
    family = reduce(lambda a, b: a | b, [F.substring("word", 1, n).isin([s for s in stems if len(s) == n]) for n in sorted({len(s) for s in stems})])
    counts = train.select("toxic", F.explode(words).alias("word")).filter(family).groupBy("word").agg(F.sum("toxic").alias("toxic"), F.count("*").alias("texts"))
    return sorted(r.word for r in counts.filter((F.col("toxic") >= FORMS) & (F.col("toxic") >= PURITY * F.col("texts"))).collect())


def _usual(train: DataFrame, model: Model) -> list[str]:
    """The words near a term that mostly stand in clean texts."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = model.matcher()
        for batch in batches:
            yield batch.filter(pa.array([matcher.edits(w) > 0 for w in batch.column(0).to_pylist()], pa.bool_()))

    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\w+"), F.lit(0)))
    counts = train.select("toxic", F.explode(words).alias("word")).groupBy("word").agg(F.sum("toxic").alias("toxic"), F.count("*").alias("texts"))
    common = counts.filter((F.col("texts") >= FORMS) & (2 * F.col("toxic") < F.col("texts"))).select("word")
    return sorted(r.word for r in common.mapInArrow(near, "word string").collect())


def _hit_rows(model: Model):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = model.matcher()
        for batch in batches:
            rows = [features(hits(t.as_py() or "", matcher)) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(rows, pa.list_(pa.float64()))], names=["toxic", "x"])

    return f


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The lexicon and the logistic weights, from at most `sample` labelled rows that are not held out."""
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .filter(~held_out() & F.col("toxic").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    # at most `sample` rows of two numbers, so the size of what is broadcast is known
    train = c.stored(c.texts_of(docs).join(F.broadcast(c.stored(chosen)), "doc_id").select("text", "toxic").na.fill("", ["text"]).groupBy("text").agg(F.max("toxic").alias("toxic")))
    words, stems = choose_terms(_terms(train))
    if not words and not stems:
        return Model()
    model = Model(sorted({*words, *_forms(train, stems)}), stems)
    model.usual = _usual(train, model)
    rows = train.select("text", "toxic").mapInArrow(_hit_rows(model), "toxic int, x array<double>").collect()
    x, y = np.array([r.x for r in rows]), np.array([r.toxic for r in rows], float)
    model.weights = fit_logistic(x, y)
    return model


def score(text: str | None, matcher: Matcher, weights: np.ndarray | None) -> tuple[float, tuple]:
    """The score of a text and its hits."""
    if weights is None:
        return 0.0, (0, 0, 0, 0, 0.0, 0.0)
    found = hits(text or "", matcher)
    return float(1 / (1 + np.exp(-np.clip(np.dot(features(found), weights), -30, 30)))), found


def _score_rows(model: Model):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = model.matcher()
        for batch in batches:
            scores, found = [], []
            for text in batch.column(1):
                value, got = score(text.as_py(), matcher, model.weights)
                found.append(got[1:4])
                scores.append(value)
            columns = list(zip(*found, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), *(pa.array(x, pa.int64()) for x in columns)], schema=_RESULT)

    return f


def toxicity_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted, n_hits, n_misspelled, n_quoted."""
    model = learn(docs, labels, sample)
    rows = c.texts_of(docs).mapInArrow(_score_rows(model), RESULT)
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_hits", "n_misspelled", "n_quoted")


def without_toxic(docs: DataFrame, labels: DataFrame, cutoff: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """The documents whose score is under the cutoff, with all their columns."""
    model, matchers = learn(docs, labels, sample), []

    def keep(texts: pa.Array) -> np.ndarray:
        if not matchers:
            matchers.append(model.matcher())
        return np.array([score(t.as_py(), matchers[0], model.weights)[0] < cutoff for t in texts], bool)

    return c.filtered(docs, keep)
