"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text, with exception phrases.

Folding lower-cases, strips accents, maps homoglyphs of other scripts and digit or sign substitutions to
the letters they imitate, and turns other signs into single spaces. Lexicon entries are word beginnings
whose weight is their log odds in labelled texts. Exception phrases (an entry with one neighbouring word)
cancel the entry inside them. A logistic curve over the weight found, plain and divided by the square root
of the number of words, gives the score.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.llm.labelled import remainder, training_rows
from claimlens.llm.texts import trimmed
from claimlens.session import stored

# Signs and digits read as letters, and letters of other scripts that look like Latin ones.
SUBSTITUTED = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p",
    "ѕ": "s", "т": "t", "у": "y", "х": "x", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o",
    "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ß": "ss",
}


class _Folding(dict):
    """Translation table of str.translate, filled as characters are met."""

    def __missing__(self, code: int) -> str:
        out = ""
        for c in unicodedata.normalize("NFKD", chr(code)).lower():
            if unicodedata.combining(c) or unicodedata.category(c) == "Cf":
                continue
            for plain in unicodedata.normalize("NFKD", HOMOGLYPHS.get(c, SUBSTITUTED.get(c, c))):
                if not unicodedata.combining(plain):
                    out += plain if plain.isalnum() else " "
        self[code] = out
        return out


_FOLDING = _Folding()


def folded(text: str | None) -> str:
    """Folded words joined by single spaces, with a space at either end; null and empty texts give one space."""
    return " " + "".join(w + " " for w in (text or "").translate(_FOLDING).split())


HELD_ITEMS = 100_000


@dataclass
class ToxicityModel:
    """Weights of word beginnings, exception phrases, and the logistic curve."""

    weights: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    curve: tuple[float, float, float] = (-6.0, 1.0, 1.0)
    prior: float = 0.0
    _automaton: ahocorasick.Automaton | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None}

    def matcher(self) -> ahocorasick.Automaton | None:
        if self._automaton is None and self.weights:
            found = ahocorasick.Automaton()
            for phrase in self.exceptions:
                found.add_word(phrase, (len(phrase), None))
            for entry, weight in self.weights.items():
                found.add_word(" " + entry, (len(entry) + 1, weight))
            found.make_automaton()
            self._automaton = found
        return self._automaton

    def measures(self, text: str | None) -> tuple[float, float]:
        """Weight found, and that weight over the square root of the number of words."""
        plain, automaton = folded(text), self.matcher()
        if automaton is None:
            return 0.0, 0.0
        hits, excused = {}, []
        for end, (size, weight) in automaton.iter(plain):
            begin = end - size + 1
            if weight is None:
                excused.append((begin, end))
            else:
                hits[begin] = max(weight, hits.get(begin, weight))
        total = sum(w for at, w in hits.items() if not any(a <= at < b for a, b in excused))
        return total, total / max(plain.count(" ") - 1, 1) ** 0.5

    def score(self, text: str | None) -> float:
        if not self.weights:
            return self.prior
        total, density = self.measures(text)
        a, b, c = self.curve
        return float(1 / (1 + np.exp(-np.clip(a + b * np.log1p(total) + c * np.log1p(density), -40, 40))))


def beginnings(text: str | None, shortest: int, longest: int) -> set[str]:
    """Candidate entries of a text: the beginnings of its words, and short words whole."""
    found = set()
    for w in set(folded(text).split()):
        found.update(w[:k] for k in range(shortest, min(longest, len(w)) + 1))
        found.add(w + " ")
    return found


def _counted(docs: DataFrame, of, schema: str) -> DataFrame:
    """Sum of what ``of`` counts in the texts: (item, n). A task holds ``HELD_ITEMS`` different items or one text's."""

    def sent(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["item", "n"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = Counter()
            for text in batch.column(0):
                counts.update(of(text.as_py()))
                if len(counts) > HELD_ITEMS:
                    yield sent(counts)
                    counts = Counter()
            yield sent(counts)
        trimmed()

    return docs.select("text").mapInArrow(rows, schema).groupBy("item").agg(F.sum("n").alias("n"))


def _candidates(toxic: DataFrame, clean: DataFrame, n1: int, n0: int) -> DataFrame:
    """(item, n, odds) of the entries that mark toxic texts, each on its own, best first by gain.

    Toxic and clean counts are joined in Spark, and none is cut. An entry passes if its log odds exceed 2 and its
    log-likelihood gain, the gain of splitting the texts by it, exceeds a threshold that rises with the number of
    entries tested.
    """
    least = 15 + 2 * math.log(max(toxic.count(), 1))  # more candidates, more chance findings
    both = toxic.withColumnRenamed("n", "a").join(clean.withColumnRenamed("n", "b"), "item", "left").na.fill(0, ["b"])
    a, b, p = F.col("a"), F.col("b"), (F.col("a") + F.col("b")) / F.lit(n1 + n0)
    odds = F.log((a + 0.5) / (n1 - a + 0.5)) - F.log((b + 0.5) / (n0 - b + 0.5))
    part = lambda seen, expected: F.when((seen > 0) & (expected > 0), seen * F.log(seen / expected)).otherwise(0.0)
    gain = 2 * (part(a, n1 * p) + part(b, n0 * p) + part(n1 - a, n1 * (1 - p)) + part(n0 - b, n0 * (1 - p)))
    judged = both.select("item", a.alias("n"), odds.alias("odds"), gain.alias("gain")).filter((F.col("odds") > 2) & (F.col("gain") > least))
    return judged.orderBy(F.desc("gain"), F.desc(F.length("item")), "item")


def _chosen(odds: dict[str, float], contexts: dict[str, set[str]], toxic: dict[str, int], most: int) -> dict[str, float]:
    """Entries met after different words; words that only travel with copies of one text are left out.

    An entry that begins another one, or begins with it, is kept only if it weighs clearly more.
    """
    kept: dict[str, float] = {}
    for item, weight in odds.items():
        if len(kept) >= most or len(contexts.get(item, ())) < max(3, min(50, 0.4 * toxic[item])):
            continue
        related = [k for k in kept if item.startswith(k) or k.startswith(item)]
        if all(weight > kept[k] + 0.7 for k in related):
            kept[item] = weight
    return kept


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Ridge logistic regression by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    beta, ridge = np.zeros(x.shape[1]), np.diag([1e-6, 0.05, 0.05])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(b) for b in beta)


def fit(docs: DataFrame, labels: DataFrame, held_out, per_class: int = 8000, shortest: int = 4, longest: int = 10, entries: int = 2000) -> ToxicityModel:
    """Learn lexicon, exceptions and curve from ``per_class`` rows of each class at most, outside ``held_out``.

    The bounds on rows (``per_class``) and on lexicon entries and exception phrases (``entries`` of each, the best
    first) are the only limits. What passes the thresholds on its own is collected: of 2 ``per_class`` texts, a
    number that these bounds limit. Without rows of both classes there is no lexicon, and every score is the only
    label seen, or 0.
    """
    sample = stored(training_rows(docs, labels, "toxic", held_out, per_class).select("text", "label"))
    size = {r.label: r.n for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n1, n0 = size.get(1, 0), size.get(0, 0)
    if not n1 or not n0:
        return ToxicityModel({}, prior=1.0 if n1 else 0.0)
    toxic, clean = sample.filter("label = 1"), sample.filter("label = 0")
    least = max(3, n1 // 500)
    of = lambda texts: _counted(texts, lambda t: beginnings(t, shortest, longest), "item string, n long")
    found = stored(of(toxic).filter(F.col("n") >= least))
    passed = _candidates(found, of(clean), n1, n0).collect()
    odds, a = {r.item: r.odds for r in passed}, {r.item: r.n for r in passed}
    asked = sample.sparkSession.sparkContext.broadcast(set(odds))

    def met(text: str | None) -> set[str]:
        """The entries in a text, each with the word before it."""
        out, before = set(), ""
        for w in folded(text).split():
            for item in [*(w[:k] for k in range(shortest, min(longest, len(w)) + 1)), w + " "]:
                if item in asked.value:
                    out.add(f"{item}|{before}")
            before = w
        return out

    contexts: dict[str, set[str]] = {}
    for r in _counted(toxic, met, "item string, n long").select("item").collect():
        item, before = r.item.rsplit("|", 1)
        contexts.setdefault(item, set()).add(before)
    model = ToxicityModel(_chosen(odds, contexts, a, entries))
    if not model.weights:
        model.prior = n1 / (n1 + n0)
        return model
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def phrases(text: str | None) -> set[str]:
        out, plain = set(), folded(text)
        for end, (size, _) in shared.value.matcher().iter(plain):
            begin = end - size + 1
            after = plain.find(" ", begin + 1)
            before = plain.rfind(" ", 0, begin)
            follows = plain.find(" ", after + 1)
            if follows > 0:
                out.add(plain[begin : follows + 1])
            if before >= 0:
                out.add(plain[before : after + 1])
        return out

    excuses = {r.item: r.n for r in _counted(clean, phrases, "item string, n long").filter("n >= 3").orderBy(F.desc("n"), "item").limit(entries).collect()}
    if excuses:
        doubtful = sample.sparkSession.sparkContext.broadcast(set(excuses))
        guilty = {r.item for r in _counted(toxic, lambda t: phrases(t) & doubtful.value, "item string, n long").collect()}
        model.exceptions = sorted(set(excuses) - guilty)
        model._automaton = None
    learned = sample.sparkSession.sparkContext.broadcast(model)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([learned.value.measures(t) for t in batch.column(0).to_pylist()]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), batch.column(1)], names=["total", "density", "label"])

    points = sample.select("text", "label").mapInArrow(measured, "total double, density double, label int").toArrow()
    x = np.log1p(np.column_stack([points.column(0).to_numpy(), points.column(1).to_numpy()]))
    order = np.lexsort((x[:, 1], x[:, 0]))
    model.curve = _logistic(x[order], points.column(2).to_numpy()[order].astype(float))
    return model


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score) of every row of ``docs``, whole texts; null and empty texts match nothing."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [shared.value.score(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, modulus: int = 4, held: int = 2, threshold: float = 0.3) -> DataFrame:
    """Fit outside the held-out rows and score every document: doc_id, held_out, score, predicted."""
    held_out = remainder("doc_id", modulus) == held
    model = fit(docs, labels, held_out)
    return score(docs, model).select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def accepted(docs: DataFrame, labels: DataFrame, modulus: int = 4, held: int = 2, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose score stays below the threshold, with all their columns.

    Rows are judged in place: none is moved, and repeated rows and null ids are judged like all others.
    """
    model = fit(docs, labels, remainder("doc_id", modulus) == held)
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([shared.value.score(t.as_py()) < threshold for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(rows, docs.schema)
