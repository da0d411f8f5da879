"""Toxicity by a learned lexicon, Levenshtein automata on its trie, and context windows.

The lexicon holds terms that stand in toxic training documents far more often than in others, with their
log odds.  A term with a final ``*`` is a stem and matches any word that begins with it.  A word is matched by running it through the product of the lexicon's trie and the Levenshtein
automaton of the term's edit bound (one edit from five letters on, two from nine, by the longer of term and word);
the product is made deterministic lazily for each length of word, so most words end after a few table steps.  Each match is looked at in a window of words: between an opening and a closing quotation
mark it counts as quoted, else as direct, and the weights of a window's direct matches add up to its
score.  A logistic model joins the window score, the direct and the quoted sums.

Bounds (parameters): the model is fitted on at most ``max_rows`` labelled rows, the first by a hash of the id,
and its lexicon has at most ``max_terms`` terms.  Every document is scored whole.

Defined cases: null or empty text has no words and gets the model's base score; rows with equal ``doc_id``
are scored one by one; a null ``doc_id`` is never held out; without labels or toxic ones every score is 0;
an empty table gives an empty result.
"""

from __future__ import annotations

import math
import uuid
from array import array
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidloom.llm.common import crc_mod, ready
from evidloom.llm.tokens import WordCache

# Marks that open and close a quotation, and what surrounds a word.
OPENING = "\"“„«‹"
CLOSING = "\"”“»›"
AROUND = ".,;:!?\"'()[]{}<>%$&*#|-_/\\“”„«»‹›…"
FEATURES = 11
# Lengths of the stems that are tried.
STEMS = (4, 5)
# States of a product automaton, about half a kilobyte each; it starts anew when full, and all do at three times as many.
STATES = 150_000


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def _variants(word: str) -> list[str]:
    """What the lexicon may hold of a word: itself and its stems."""
    return [word, *(word[:n] + "*" for n in STEMS if len(word) > n)]


class TrieAutomaton:
    """All lexicon terms within ``edits`` insertions, deletions or substitutions of a word.

    ``limits`` are bounds of the single terms, under 0 for a term that is left out; a node is only reached by as many
    edits as some term below it allows.
    """

    def __init__(self, terms: list[str], edits: int, limits: list[int] | None = None) -> None:
        if edits > 3:
            raise ValueError("at most three edits")
        self.edits = edits
        self.limits = limits or [0 if term.endswith("*") else edits for term in terms]
        self.children: list[dict[str, int]] = [{}]
        self.most = [0]
        self.term: dict[int, int] = {}
        self.stem: dict[int, int] = {}
        for number, term in enumerate(terms):
            limit = self.limits[number]
            if limit < 0:
                continue
            node = 0
            self.most[0] = max(self.most[0], limit)
            for c in term.removesuffix("*"):
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.most.append(0)
                node = self.children[node][c]
                self.most[node] = max(self.most[node], limit)
            (self.stem if term.endswith("*") else self.term)[node] = number
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[bytes, int] = {}
        # a state is its nodes with the edits used, four to a node, packed: tuples would take ten times the room
        self.sets: list[bytes] = []
        self.ends: list[tuple] = []
        self.begun: list[tuple] = []
        self.steps: list[dict[str, int]] = []
        self.start = self._intern({0: 0})

    def _intern(self, reached: dict[int, int]) -> int:
        """Number of the state set ``node -> edits used``, closed under skipped term letters."""
        queue = [n for n, e in reached.items() if e < self.most[n]]
        while queue:
            node = queue.pop()
            e = reached[node] + 1
            for child in self.children[node].values():
                if e <= self.most[child] and reached.get(child, e + 1) > e:
                    reached[child] = e
                    if e < self.most[child]:
                        queue.append(child)
        pairs = sorted(reached.items())
        key = array("I", [n << 2 | e for n, e in pairs]).tobytes()
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            self.ends.append(tuple((self.term[n], e) for n, e in pairs
                                   if n in self.term and e <= self.limits[self.term[n]]))
            self.begun.append(tuple((self.stem[n], e) for n, e in pairs if n in self.stem and e == 0))
        return self.ids[key]

    def _step(self, state: int, c: str) -> int:
        reached: dict[int, int] = {}

        def reach(node: int, e: int) -> None:
            if e <= self.most[node] and reached.get(node, e + 1) > e:
                reached[node] = e

        for packed in array("I", self.sets[state]):
            node, e = packed >> 2, packed & 3
            reach(node, e + 1)  # a letter too many
            for letter, child in self.children[node].items():
                reach(child, e + (letter != c))
        found = self._intern(reached) if reached else -1
        self.steps[state][c] = found
        return found

    def matches(self, word: str) -> tuple[tuple[int, int], ...]:
        """(term, edits) of every term within the bound."""
        if len(self.sets) > STATES:
            self._reset()
        state, stems = self.start, ()
        for c in word:
            after = self.steps[state].get(c)
            state = self._step(state, c) if after is None else after
            if state < 0:
                return stems
            stems += self.begun[state]
        return self.ends[state] + stems


_MATCHERS: dict[str, WordCache] = {}


@dataclass
class ToxicityModel:
    terms: list[str] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    own: tuple[list[float], list[float]] = ((), ())  # weights without a document of label 0, 1
    bounds: tuple[tuple[int, int], ...] = ((0, 0), (5, 1), (9, 2))  # edits from a length on, of term or word
    window: int = 10
    fade: float = 0.5  # weight of a match for each edit
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    coefficients: np.ndarray | None = None  # the constant last
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def matcher(self) -> WordCache:
        """The word matcher; a worker process keeps the last one, whose tables fill as words come."""
        if self.key not in _MATCHERS:
            _MATCHERS.clear()
            _MATCHERS[self.key] = self._new_matcher()
        return _MATCHERS[self.key]

    def _new_matcher(self) -> WordCache:
        most = self.bounds[-1][1]
        longest = max(map(len, self.terms), default=0) + most + 1
        automata: dict[int, TrieAutomaton] = {}

        def limit(term: str, letters: int) -> int:
            if term.endswith("*"):
                return 0
            edits = max(k for length, k in self.bounds if max(len(term), letters) >= length)
            # more letters apart than edits: never reached
            return edits if abs(len(term) - letters) <= edits else -1

        def matches(core: str) -> tuple[tuple[int, int], ...]:
            # beyond every term's reach only stems are left
            letters = min(len(core), longest)
            if letters not in automata:
                automata[letters] = TrieAutomaton(self.terms, most, [limit(t, letters) for t in self.terms])
            elif sum(len(a.sets) for a in automata.values()) > 3 * STATES:
                automata.clear()
                return matches(core)
            return automata[letters].matches(core)

        def match(word: str) -> tuple[int, float] | None:
            core = word.strip(AROUND)
            found = matches(core) if core else ()
            if not found:
                return None
            # the heaviest term, nearer ones first
            term, e = max(found, key=lambda f: (self.weights[f[0]] * self.fade ** f[1], -f[0]))
            return term, self.fade ** e

        return WordCache(match)

    def features(self, text: str | None, matcher: WordCache, label: int | None = None) -> list[float]:
        """Window score; sums over distinct words: direct, quoted, misspelled; density; counts."""
        weights = self.weights if label is None else self.own[label]
        words = words_of(text)
        hits = [(i, m) for i, m in enumerate(map(matcher.__getitem__, words)) if m]
        matcher.trim()
        direct: dict[str, float] = {}
        near: dict[str, float] = {}
        quoted: dict[str, float] = {}
        places: list[tuple[int, float]] = []
        for i, (term, share) in hits:
            weight = weights[term] * share
            if weight <= 0:
                continue
            core = words[i].strip(AROUND)
            if self._in_quotes(words, i):
                quoted[core] = weight
            else:
                (direct if share == 1 else near)[core] = weight
                places.append((i, weight))
        best = low = 0
        total = 0.0
        for i, weight in places:
            total += weight
            while places[low][0] < i - self.window:
                total -= places[low][1]
                low += 1
            best = max(best, total)
        # misspelled matches count as direct ones; the features after them let the fit correct that
        named = len(direct) + len(near)
        return [float(best), sum(direct.values()) + sum(near.values()), sum(quoted.values()),
                10 * len(places) / (len(words) + 20), float(named >= 1), float(named >= 2), float(named >= 3),
                math.log1p(len(words)), sum(near.values()), float(len(direct) >= 2),
                float(min(len(near), 3))]

    def _in_quotes(self, words: list[str], i: int) -> bool:
        """Whether a quotation opens before and closes after word ``i`` inside the window."""
        opened = False
        for w in words[max(0, i - self.window):i + 1]:
            if w[:1] in OPENING and w[:1]:
                opened = True
            if w is not words[i] and len(w) > 1 and w.rstrip(".,;:!?")[-1:] in CLOSING and w.rstrip(".,;:!?")[-1:]:
                opened = False
        if not opened:
            return False
        return any(w.rstrip(".,;:!?")[-1:] in CLOSING and len(w) > 1 and w.rstrip(".,;:!?")[-1:]
                   for w in words[i:i + self.window + 1])

    def score(self, features: list[float]) -> float:
        if self.coefficients is None:
            return 0.0
        x = (np.array(features) - self.mean) / self.scale
        z = float(x @ self.coefficients[:-1] + self.coefficients[-1])
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Coefficients of a ridge logistic regression, the constant last, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-3])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + penalty @ w
        curve = (x * (p * (1 - p))[:, None]).T @ x + penalty
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, min_docs: int = 3, min_odds: float = 2.5,
                 max_terms: int = 5000, max_rows: int = 30_000) -> ToxicityModel:
    """Learn from ``labels`` (``doc_id, toxic``) of rows outside the held-out fold."""
    ready(docs.sparkSession)
    truth = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max("toxic").cast("int").alias("y"))
    truth = truth.where(crc_mod(F.col("doc_id"), folds) != 0)
    truth = truth.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    # at most ``max_rows`` pairs of numbers, so texts stay where they are scanned
    train = docs.select("doc_id", "text").join(F.broadcast(truth), "doc_id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, list[int]] = defaultdict(lambda: [0, 0])
            total = [0, 0]
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                total[y] += 1
                words = {w.strip(AROUND) for w in set(words_of(text))}
                for term in {v for w in words if 3 <= len(w) <= 60 for v in _variants(w)}:
                    seen[term][y] += 1
            yield pa.RecordBatch.from_pydict(
                {"word": ["", *seen], "neg": [total[0], *(n for n, _ in seen.values())],
                 "pos": [total[1], *(p for _, p in seen.values())]},
                schema=pa.schema([("word", pa.string()), ("neg", pa.int64()), ("pos", pa.int64())]))

    counts = train.select("text", "y").mapInArrow(count, "word string, neg long, pos long").groupBy("word").agg(
        F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    # the row of the empty word holds the numbers of documents
    useful = counts.where((F.col("pos") >= min_docs) & (F.col("pos") > F.col("neg")) | (F.col("word") == ""))
    rows = useful.orderBy((F.col("word") != ""), F.desc(F.col("pos") / (F.col("neg") + 1)), F.desc("pos"), "word")
    rows = rows.limit(4 * max_terms).collect()
    if not rows or rows[0]["word"] != "" or rows[0]["pos"] == 0:
        return ToxicityModel()
    docs_neg, docs_pos = rows[0]["neg"], rows[0]["pos"]

    def odds(pos: int, neg: int) -> float:
        if pos < 1:
            return 0.0
        return max(0.0, math.log((pos + .5) / (docs_pos + 1)) - math.log((neg + .5) / (docs_neg + 1)))

    chosen = sorted(((odds(r["pos"], r["neg"]), r["word"], r["pos"], r["neg"]) for r in rows[1:]), reverse=True)
    chosen = [c for c in chosen if c[0] >= min_odds][:max_terms]
    model = ToxicityModel(
        [c[1] for c in chosen], [c[0] for c in chosen],
        ([odds(c[2], max(0, c[3] - 1)) for c in chosen], [odds(c[2] - 1, c[3]) for c in chosen]))

    @F.pandas_udf("array<double>")
    def measure(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        matcher = model.matcher()
        for texts, ys in parts:
            yield pd.Series([model.features(t, matcher, y) for t, y in zip(texts, ys, strict=True)])

    found = train.select("doc_id", measure("text", "y").alias("x"), "y").toPandas().sort_values("doc_id", kind="stable")
    x, y = np.array(found["x"].tolist(), dtype=float).reshape(len(found), FEATURES), found["y"].to_numpy(dtype=float)
    model.mean, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    model.coefficients = logistic((x - model.mean) / model.scale, y)
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted``."""
    ready(docs.sparkSession)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = model.matcher()
        for texts in parts:
            yield pd.Series([model.score(model.features(t, matcher)) for t in texts], dtype="float64")

    names = [c for c in docs.columns if c not in ("score", "predicted")]
    scored = docs.select(*names, score("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
