"""Toxicity by a weighted finite-state grammar over clauses.

The words of a sentence are mapped to symbols (insult, threat, target, negation, reported speech, other, clause end).
Three transducers read them and mark insults and threats that stand in the scope of a negation, in reported speech, or
after a target; they are composed into one machine. Each transducer has a weight, and a path's weight is the product of
those of its marks and of the word's own: negation and report lower it, a target raises it. A clause counts for the
heaviest path through it; a text's score is a logistic function of its heaviest clause and of all its clauses' sum.
Insults, their weights and the transducers' weights are learned from labelled texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import small_batches, written

#: Labelled rows that the model is fitted on at most, taken by a hash of their id; one text for each id.
FIT_ROWS = 20_000
#: A learned insult occurs in so many toxic texts, with so many different words before it, and so rarely elsewhere.
LEAST_TEXTS, LEAST_CONTEXTS, PURITY = 4, 3, 0.5
#: With so much evidence it is kept even where other insults explain the same texts.
SURE_TEXTS, SURE_CONTEXTS, SURE_PURITY = 8, 6, 0.95
#: A word's beginnings of these lengths stand for its inflected forms; a whole word stands for itself.
STEMS = (4, 5, 6, 7, 8)
#: Words after a negation that it governs, and words between a target and an insult.
SCOPE, REACH = 3, 4
#: From this score on, a text is predicted toxic.
THRESHOLD = 0.3

THREATS = {"kill", "hurt", "destroy", "shoot", "stab", "tuer", "frapper", "détruire", "töten", "schlagen", "vernichten", "matar", "golpear", "destruir"}
TARGETS = {"you", "your", "he", "she", "they", "him", "her", "them", "this", "that", "these", "those", "tu", "vous", "ton", "votre", "il", "elle", "ils", "cette", "du", "dich", "ihr", "er", "sie", "dieser", "tú", "usted", "él", "ella", "ellos", "este", "esta"}
NEGATIONS = {"not", "no", "never", "neither", "nor", "without", "pas", "jamais", "ni", "sans", "nicht", "kein", "keine", "nie", "ohne", "nunca", "tampoco", "sin"}
REPORTS = {"said", "says", "told", "called", "wrote", "quoted", "claimed", "dit", "écrit", "appelé", "sagte", "schrieb", "nannte", "dijo", "escribió", "llamó"}
FIXED = {w: s for s, words in (("H", THREATS), ("T", TARGETS), ("N", NEGATIONS), ("R", REPORTS)) for w in words}
#: Insult, threat, target, negation, report, any other word, clause end.
SYMBOLS = "IHTNRO,"

#: A transducer: start state, and (state, symbol) -> (state, mark or nothing).
Transducer = tuple[int, dict[tuple[int, str], tuple[int, str]]]


def scoped(opens: str, length: int, mark: str) -> Transducer:
    """Marks insults and threats up to length words after one of opens, in the same clause."""
    step = {(left, s): (0 if s == "," else length if s == opens else max(0, left - 1), mark if left and s in "IH" else "") for left in range(length + 1) for s in SYMBOLS}
    return 0, step


def from_then_on(opens: str, mark: str) -> Transducer:
    """Marks insults and threats anywhere after one of opens, also in later clauses of the sentence."""
    return 0, {(on, s): (1 if s == opens else on, mark if on and s in "IH" else "") for on in (0, 1) for s in SYMBOLS}


def compose(*parts: Transducer) -> tuple[int, list[list[int]], list[list[str]]]:
    """One machine that runs all parts at once: start, next[state][symbol], marks[state][symbol]."""
    states = [dict.fromkeys(k for k, _ in step) for _, step in parts]
    number = {s: k for k, s in enumerate(product(*states))}
    follow = [[number[tuple(step[x, y][0] for x, (_, step) in zip(s, parts, strict=True))] for y in SYMBOLS] for s in number]
    marks = [["".join(step[x, y][1] for x, (_, step) in zip(s, parts, strict=True)) for y in SYMBOLS] for s in number]
    return number[tuple(start for start, _ in parts)], follow, marks


START, FOLLOW, MARKS = compose(scoped("N", SCOPE, "n"), from_then_on("R", "r"), scoped("T", REACH, "t"))
#: Words and clause ends of a sentence; what ends a sentence.
TOKEN = re.compile(r"\w+|[,;:()\"«»“”|—–]")
WORD = re.compile(r"\w+")
END = re.compile(r"[.!?\n]")
#: What paths can be: insult or threat, with every set of marks.
KINDS = ["".join(x) for x in product("IH", ("", "n"), ("", "r"), ("", "t"))]
#: The transducers' weights and that of a threat before any label is seen, and the values that labels choose from: a
#: negation or report takes half of a path's weight at least, a target takes none.
PRIOR = {"n": 0.25, "r": 0.25, "t": 1.25, "H": 2.0}
CHOICES = {"n": (0.0, 0.1, 0.25, 0.4, 0.5), "r": (0.0, 0.1, 0.25, 0.4, 0.5), "t": (1.0, 1.1, 1.25, 1.5, 2.0), "H": (0.5, 1.0, 2.0, 3.0, 4.0)}
#: What a step away from the prior costs in log likelihood.
DOUBT = 1.0


def multiplier(kind: str, weights: dict[str, float]) -> float:
    """The product of the weights of a path's marks."""
    return math.prod((weights[m] for m in kind[1:]), start=1.0)


@dataclass
class Grammar:
    """Insult weights by word or stem, the transducers' weights, and the logistic model over a text's clauses."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    weights: dict[str, float] = field(default_factory=lambda: dict(PRIOR))
    theta: tuple[float, float] = (0.5, 0.5)
    bias: float = -3.0

    def machine(self):
        """The automaton that finds where a grammar's word may begin; built once in each worker."""
        if (found := self.__dict__.get("_machine")) is None:
            found = ahocorasick.Automaton()
            for w in {*self.words, *self.stems, *THREATS}:
                found.add_word(w, len(w))
            found.make_automaton()
            self.__dict__["_machine"] = found
        return found

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_machine"}

    def insult(self, word: str) -> float:
        """The weight of a word as an insult; 0 if it is none."""
        return max(self.words.get(word, 0.0), *(self.stems.get(word[:k], 0.0) for k in STEMS))

    def matches(self, text: str) -> list[tuple[int, int, str, float]]:
        """(start, end, kind, weight of the word) of the heaviest path through each clause of a lower-cased text.

        kind: I or H and the path's marks, in the order n, r, t. Whole sentences are read, however long; what is heaviest
        is told by the prior weights. Only sentences that may hold a match are read word by word.
        """
        out, done = [], 0
        for end, n in self.machine().iter(text):
            at = end - n + 1
            if at < done or (at and (text[at - 1].isalnum() or text[at - 1] == "_")):
                continue
            begin = done
            for m in END.finditer(text, done, at):
                begin = m.end()
            done = m.end() if (m := END.search(text, at)) else len(text)
            state, best, found = START, 0.0, None
            for w in TOKEN.finditer(text, begin, done):
                word = w.group()
                weight = self.insult(word)
                symbol = "I" if weight else FIXED.get(word) or ("O" if word[0].isalnum() or word[0] == "_" else ",")
                k = SYMBOLS.index(symbol)
                if symbol in "IH":
                    kind = symbol + MARKS[state][k]
                    mass = multiplier(kind, PRIOR) * (weight or PRIOR["H"])
                    if mass > best:
                        best, found = mass, (w.start(), w.end(), kind, weight or 1.0)
                elif symbol == "," and found:
                    out.append(found)
                    best, found = 0.0, None
                state = FOLLOW[state][k]
            if found:
                out.append(found)
        return out

    def score(self, found: list[tuple[int, int, str, float]]) -> float:
        """The probability of label 1."""
        best, total = features(np.array([by_kind(found)]), self.weights)[0]
        z = self.bias + self.theta[0] * best + self.theta[1] * total
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def by_kind(found: list[tuple[int, int, str, float]]) -> list[float]:
    """The greatest weight and the sum of weights of a text's clauses, for each kind of path."""
    out = [0.0] * (2 * len(KINDS))
    for _, _, kind, weight in found:
        k = KINDS.index(kind)
        out[k] = max(out[k], weight)
        out[len(KINDS) + k] += weight
    return out


def features(kinds: np.ndarray, weights: dict[str, float]) -> np.ndarray:
    """The heaviest clause of each text and the logarithm of all its clauses' weight, given the transducers' weights."""
    each = np.array([multiplier(k, weights) * (weights["H"] if k[0] == "H" else 1.0) for k in KINDS])
    best, total = kinds[:, : len(KINDS)] * each, kinds[:, len(KINDS) :] * each
    return np.stack((best.max(axis=1, initial=0.0), np.log1p(total.sum(axis=1))), axis=1)


def remainder(id_col: str = "doc_id") -> F.Column:
    """crc32 of the id's text, modulo 4; null ids: null."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(text, toxic) of at most FIT_ROWS labelled ids whose remainder isn't 2; one label for each id, the highest, and one text."""
    usable = labels.filter(F.col(label_col).isNotNull() & (remainder(id_col) != 2)).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("toxic"))
    sample = usable.orderBy(F.xxhash64("_id"), "_id").limit(FIT_ROWS)
    found = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(sample), "_id")
    return found.groupBy("_id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")


def word_counts(rows: DataFrame) -> DataFrame:
    """gram, whole (a word, not a stem), toxic and clean texts that have it, and how varied the words before it are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[Counter] = [Counter(), Counter()]
        masks: Counter = Counter()
        for b in batches:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = WORD.findall(text.lower())
                grams = {(w, True) for w in words} | {(w[:k], False) for w in set(words) for k in STEMS if len(w) > k}
                texts[1 if toxic else 0].update(grams)
                if toxic:
                    for before, w in zip(["", *words], words, strict=False):
                        bit = 1 << (hash_of(before) & 31)
                        masks[w, True] |= bit
                        for k in STEMS:
                            if len(w) > k:
                                masks[w[:k], False] |= bit
        # what no text of this task holds against a label is told by the other tasks
        grams = list(texts[0].keys() | texts[1].keys())
        cols = [[g for g, _ in grams], [w for _, w in grams], [texts[1][g] for g in grams], [texts[0][g] for g in grams], [masks[g] for g in grams]]
        types = [pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()]
        for k in range(0, max(1, len(grams)), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[k : k + 50_000], t) for c, t in zip(cols, types, strict=True)], names=["gram", "whole", "toxic", "clean", "mask"])

    each = small_batches(rows).mapInArrow(run, "gram string, whole boolean, toxic long, clean long, mask long")
    return each.groupBy("gram", "whole").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.bit_count(F.bit_or("mask")).alias("contexts"))


def hash_of(word: str) -> int:
    """A small hash that every process agrees on."""
    return sum(ord(c) * (31**k % 1009) for k, c in enumerate(word[:12]))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Grammar:
    """A grammar learned from labelled rows; without usable labels, one that only knows threats.

    First the words and stems that mark toxic texts: often enough, pure enough, after many different words (which
    words of a copied passage are not). Then the weights of transducers and a logistic model over the texts of the sample,
    of which FIT_ROWS rows of bounded size come to the driver.
    """
    rows = written(training_rows(docs, labels, id_col, text_col, label_col).repartition(docs.sparkSession.sparkContext.defaultParallelism))
    pure = (F.col("toxic") >= PURITY * (F.col("toxic") + F.col("clean"))) & (F.col("toxic") >= LEAST_TEXTS) & (F.col("contexts") >= LEAST_CONTEXTS)
    found = word_counts(rows).filter(pure).collect()
    weight = lambda r: min(6.0, math.log((r.toxic + 0.5) / (r.clean + 0.5)))
    grammar = Grammar({r.gram: weight(r) for r in found if r.whole}, {r.gram: weight(r) for r in found if not r.whole})
    sure = {("w" if r.whole else "s") + r.gram for r in found if r.toxic >= SURE_TEXTS and r.contexts >= SURE_CONTEXTS and r.toxic >= SURE_PURITY * (r.toxic + r.clean)}
    prune(grammar, rows, sure)
    kinds = [(r.kinds, r.toxic) for r in with_matches(rows, grammar).collect()]
    if kinds:
        learn(grammar, np.array([x for x, _ in kinds], dtype=float), np.array([y for _, y in kinds], dtype=float))
    return grammar


def prune(grammar: Grammar, rows: DataFrame, sure: set[str]) -> None:
    """Keep the sure words and stems, and those that explain toxic texts which all stronger ones leave unexplained."""
    hits: list[tuple[set, int]] = []
    for r in with_matches(rows, grammar, grams=True).collect():
        hits.append((set(r.grams), r.toxic))
    texts: dict[str, set[int]] = {}
    for k, (grams, _) in enumerate(hits):
        for g in grams:
            texts.setdefault(g, set()).add(k)
    toxic = {k for k, (_, y) in enumerate(hits) if y}
    kept = sure & texts.keys()
    left = toxic.difference(*(texts.pop(g) for g in kept))
    while texts:
        g = max(texts, key=lambda g: (len(texts[g] & left) - len(texts[g] - toxic), -len(g), g))
        if len(texts[g] & left) < 3 or len(texts[g] & left) <= len(texts[g] - toxic):
            break
        kept.add(g)
        left -= texts.pop(g)
    grammar.words = {w: x for w, x in grammar.words.items() if f"w{w}" in kept}
    grammar.stems = {w: x for w, x in grammar.stems.items() if f"s{w}" in kept}
    grammar.__dict__.pop("_machine", None)


def with_matches(rows: DataFrame, grammar: Grammar, grams: bool = False) -> DataFrame:
    """(toxic, kinds) or, with grams, (toxic, which words and stems a text has) of labelled rows: a bounded row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.lower() for t in b.column(0).to_pylist()]
            if grams:
                out = []
                for t in texts:
                    words = {w for w in set(WORD.findall(t)) if grammar.insult(w)}
                    out.append(sorted([f"w{w}" for w in words if w in grammar.words] + [f"s{x}" for x in {w[:k] for w in words for k in STEMS} if x in grammar.stems]))
                yield pa.RecordBatch.from_arrays([b.column(1), pa.array(out, pa.list_(pa.string()))], names=["toxic", "grams"])
            else:
                yield pa.RecordBatch.from_arrays([b.column(1), pa.array([by_kind(grammar.matches(t)) for t in texts], pa.list_(pa.float64()))], names=["toxic", "kinds"])

    return small_batches(rows).select("text", "toxic").mapInArrow(run, "toxic int, grams array<string>" if grams else "toxic int, kinds array<double>")


MATCHES = "array<struct<start:long,end:long,kind:string,weight:double>>"


def learn(grammar: Grammar, kinds: np.ndarray, y: np.ndarray) -> None:
    """The transducers' weights, one after the other until none changes, and the logistic model that fits best with them."""

    def fitted(weights: dict[str, float]) -> tuple[float, tuple[float, float], float]:
        x = features(kinds, weights)
        theta, bias = fit_logistic(x, y)
        z = np.clip(x @ theta + bias, -30, 30)
        doubt = sum(abs(CHOICES[k].index(w) - CHOICES[k].index(PRIOR[k])) for k, w in weights.items())
        return float((y * z - np.logaddexp(0, z)).sum()) - DOUBT * doubt, (float(theta[0]), float(theta[1])), bias

    weights = dict(PRIOR)
    best = fitted(weights)
    for _ in range(3):
        before = dict(weights)
        for name, values in CHOICES.items():
            for w in values:
                if (found := fitted(weights | {name: w}))[0] > best[0] + 1e-9:
                    best, weights = found, weights | {name: w}
        if weights == before:
            break
    grammar.weights, grammar.theta, grammar.bias = weights, best[1], best[2]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Newton steps for a ridge logistic regression of few features whose weights are not negative: (weights, bias)."""
    use = list(range(x.shape[1]))
    while True:
        a = np.hstack([x[:, use], np.ones((len(x), 1))])
        theta = np.zeros(a.shape[1])
        penalty = np.diag([ridge] * len(use) + [1e-6])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a @ theta, -30, 30)))
            h = (a * (p * (1 - p))[:, None]).T @ a + penalty
            step = np.linalg.solve(h, a.T @ (y - p) - penalty @ theta)
            theta += step
            if np.abs(step).max() < 1e-8:
                break
        below = [k for k, t in zip(use, theta, strict=False) if t < 0]
        if not below:
            out = np.zeros(x.shape[1])
            out[use] = theta[:-1]
            return out, float(np.clip(theta[-1], -12, 12))
        use = [k for k in use if k not in below]


def score(docs: DataFrame, grammar: Grammar, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score double, matches): each whole text's score and the marked clauses it rests on.

    Match offsets count characters of the lower-cased text. A null or empty text has no match and the base score.
    Rows are independent; only id and text are read.
    """
    rows = small_batches(docs).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("weight", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [grammar.matches(t.lower()) for t in b.column(1).to_pylist()]
            out = [[dict(zip(("start", "end", "kind", "weight"), m, strict=True)) for m in x] for x in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(grammar.score, found), pa.float64()), pa.array(out, found_type)], names=["id", "score", "matches"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double, matches {MATCHES}").withColumnRenamed("id", id_col)


def accepted(docs: DataFrame, grammar: Grammar, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, whose text scores below threshold. Nothing is shuffled.

    A null or empty text has the base score; repeated rows and rows without an id are judged each by its text.
    """
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([grammar.score(grammar.matches((t or "").lower())) < threshold for t in b.column(at).to_pylist()], pa.bool_()))

    return small_batches(docs).mapInArrow(run, docs.schema)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, n_matches of every document."""
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", F.coalesce(remainder() == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("matches").alias("n_matches"))
