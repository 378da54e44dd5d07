"""Toxicity by weak supervision.

Lexicons are mined from labelled texts; slices of them, counts, densities, stems,
disguised spellings and shouting are voters that vote or abstain. A generative label
model estimates by expectation-maximisation how each voter votes on toxic and on
clean texts, and how voters repeat each other given the class; correlated voters
share their weight. A linear classifier on the voters' measurements is trained on the
posterior labels and scores every text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtflow.llm.shared import held_out, stash

#: Labelled texts that the model is fitted on, about (chosen by a hash of the id), and words of a lexicon.
FIT_DOCS, FIT_WORDS = 20_000, 4000
#: Toxic texts that a lexicon word was seen in, and its log-odds (and those of a strong word), at least.
LEAST_SEEN, LEAST_ODDS, STRONG_ODDS = 4, 2.0, 4.0
STEM = 5
SLICES = 4
ROUNDS = 15
KNOWN = 400_000

# Characters that stand for letters in disguised words.
DISGUISES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
_CAPITALS = re.compile(r"\b[^\W\d_a-zß-öø-ÿ]{3,}\b")
_RUNS = re.compile(r"(.)\1{2,}")
_LETTERS = re.compile(r"[^\W\d_]+")


def cores(word: str) -> list[str]:
    """The runs of letters of a word, lower-cased."""
    word = word.lower()
    return [word] if word.isalpha() else _LETTERS.findall(word)


def plain(word: str) -> str:
    """A word without the usual disguises: digits and signs for letters, stretched letters."""
    return _RUNS.sub(r"\1", "".join(filter(str.isalpha, word.lower().strip(".,;:!?").translate(DISGUISES))))


class Measures:
    """Measures texts against lexicons (word to log-odds); words that hit nothing are remembered, up to a bound."""

    NAMES = ("one", "two", "three", "five", "strong", "strong_two", "sum", "dense", "stem", "stems", "disguised", "shouting", "marks")

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.words, self.stems, self.idle = words, stems, set()

    def _hits(self, word: str) -> list[tuple[str, str]]:
        found = []
        for c in cores(word):
            if c in self.words:
                found.append(("word", c))
            if c[:STEM] in self.stems and len(c) > STEM:
                found.append(("stem", c))
        if not found and not word.isalpha():
            p = plain(word)
            if p in self.words and p not in cores(word):
                found.append(("disguised", p))
        return found

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(features, votes) of a text; votes are 1 toxic, -1 clean, 0 abstains."""
        split = text.split()
        if len(self.idle) > KNOWN:
            self.idle.clear()
        hits: dict[str, set[str]] = {"word": set(), "stem": set(), "disguised": set()}
        for word in set(split).difference(self.idle):
            found = self._hits(word)
            if not found:
                self.idle.add(word)
            for kind, core in found:
                hits[kind].add(core)
        words, stems, disguised = hits["word"], hits["stem"], hits["disguised"]
        odds = [self.words[w] for w in words | disguised]
        n, strong, dense = len(odds), sum(o >= STRONG_ODDS for o in odds), len(odds) / np.log2(8 + len(split))
        capitals, marks = len(_CAPITALS.findall(text)) / max(1, len(split)), text.count("!!") / max(1, len(split))
        features = np.array(
            [n >= 1, n >= 2, n >= 3, n >= 5, strong >= 1, strong >= 2, min(sum(odds), 40.0) / 10, min(dense, 2.0),
             len(stems) >= 1, min(len(stems), 6) / 3, len(disguised) >= 1, capitals > 0.5, min(marks, 1.0)], dtype=np.float64)
        sign = lambda yes, no: 1 if yes else -1 if no else 0
        parts = {zlib.crc32(w.encode()) % SLICES for w in words}
        votes = [sign(k in parts, False) for k in range(SLICES)]
        votes += [sign(strong >= 1, strong == 0), sign(n >= 2, n == 0), sign(n >= 3, n <= 1), sign(dense >= 0.3 and n >= 2, n == 0),
                  sign(len(stems) >= 3, not stems), sign(disguised, False), sign(capitals > 0.5, False), sign(marks > 0.3, False)]
        return features, np.array(votes, dtype=np.int8)


def label_model(votes: np.ndarray, start: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Posterior probabilities of the class from votes (texts, voters); ``start`` are first guesses.

    Each round estimates how often each voter votes 1, 0, -1 on either class, and the
    correlation of each two voters within the classes; a voter's evidence is divided
    by one plus its positive correlations with the others.
    """
    q = start.astype(np.float64)
    one_hot = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(np.float64)
    for _ in range(rounds):
        rate1 = (np.einsum("n,nmv->mv", q, one_hot) + 0.5) / (q.sum() + 1.5)
        rate0 = (np.einsum("n,nmv->mv", 1 - q, one_hot) + 0.5) / ((1 - q).sum() + 1.5)
        values = np.array([-1.0, 0.0, 1.0])
        rest = votes - q[:, None] * (rate1 @ values) - (1 - q)[:, None] * (rate0 @ values)
        cov = rest.T @ rest / len(votes) + 1e-6 * np.eye(votes.shape[1])
        cor = cov / np.sqrt(np.outer(np.diag(cov), np.diag(cov)))
        share = 1 / np.clip(cor, 0, 1).sum(axis=1)
        evidence = np.log(rate1 / rate0) * share[:, None]
        prior = np.clip(q.mean(), 0.01, 0.99)
        odds = np.log(prior / (1 - prior)) + np.einsum("mv,nmv->n", evidence, one_hot)
        q = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return q


def linear_classifier(x: np.ndarray, q: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights (the last is the intercept) of a logistic regression on soft labels, by Newton steps."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x.shape[1])
    hold = ridge * np.eye(len(w))
    hold[-1, -1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + hold, x.T @ (q - p) - hold @ w)
    return w


class Model:
    def __init__(self, words: dict[str, float], stems: dict[str, float], weights: np.ndarray):
        self.words, self.stems, self.weights = words, stems, weights


def _signature(text: str) -> int:
    """A hash of the whole text, without case and white space's kind: only copies share it."""
    return xxhash.xxh64_intdigest(" ".join(text.lower().split())) >> 1


def _mined(seen: DataFrame, n_toxic: int, n_clean: int, least: float) -> dict[str, float]:
    """Log-odds of the terms that mark toxic texts; seen(term, toxic) has a row for each text and term."""
    counts = seen.groupBy("term").agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).where(F.col("t") >= LEAST_SEEN)
    odds = F.log((F.col("t") + 0.5) / (n_toxic + 1)) - F.log((F.col("n") - F.col("t") + 0.5) / (n_clean + 1))
    rows = counts.select("term", odds.alias("odds")).where(F.col("odds") >= least).orderBy(F.desc("odds"), "term").limit(FIT_WORDS).collect()
    return {r["term"]: r["odds"] for r in rows}


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Learns from docs(doc_id, text) and labels(doc_id, toxic), both without held-out ids; None if a class is missing.

    A doc_id with several labels is toxic if one says so; null labels say nothing.
    """
    known = labels.where(~held_out() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    share = FIT_DOCS / max(1, known.count())
    # about FIT_DOCS rows of two numbers, whatever the input: small enough to broadcast
    some = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30)))
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(some), "doc_id")

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            terms = [sorted({c for w in set(t.split()) for c in cores(w)}) for t in texts]
            columns = [batch.column("doc_id"), batch.column("text"), batch.column("toxic"), pa.array(list(map(_signature, texts)), pa.int64()), pa.array(terms, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text", "toxic", "signature", "terms"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    sample = rows.select("doc_id", "text", "toxic").mapInArrow(marked, f"doc_id {kind}, text string, toxic int, signature long, terms array<string>")
    # one text of each group of copies, that of the least id, so that none of their words looks typical
    first = F.min_by(F.struct("text", "terms"), F.struct("doc_id", F.xxhash64("text"))).alias("x")
    sample = stash(sample.groupBy("signature", "toxic").agg(first).select("toxic", "x.text", "x.terms"), "toxic-sample")
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not sizes.get(0) or not sizes.get(1):
        return None
    terms = sample.select(F.explode("terms").alias("term"), "toxic")
    words = _mined(terms, sizes[1], sizes[0], LEAST_ODDS)
    stemmed = sample.select(F.explode(F.array_distinct(F.transform(F.filter("terms", lambda t: F.length(t) > STEM), lambda t: F.substring(t, 1, STEM)))).alias("term"), "toxic")
    stems = _mined(stemmed, sizes[1], sizes[0], LEAST_ODDS / 2)
    n = len(Measures.NAMES)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Measures(words, stems)
        for batch in batches:
            found = [of(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([f[0].tolist() for f in found], pa.list_(pa.float64())), pa.array([f[1].tolist() for f in found], pa.list_(pa.int64()))], ["toxic", "x", "votes"])

    table = sample.select("text", "toxic").mapInArrow(measure, "toxic int, x array<double>, votes array<long>").toPandas()
    toxic = table["toxic"].to_numpy()
    votes = np.stack(table["votes"]).astype(np.int64)
    # the given label is one more voter
    q = label_model(np.concatenate([votes, (2 * toxic - 1)[:, None]], axis=1), np.where(toxic == 1, 0.9, 0.1))
    return Model(words, stems, linear_classifier(np.stack(table["x"]).reshape(-1, n), q))


def scores(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score) for every row of docs(doc_id, text, ...)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        of = Measures(m.words, m.stems) if m else None
        for batch in batches:
            if m:
                x = np.array([of(t or "")[0] for t in batch.column("text").to_pylist()]).reshape(len(batch), -1)
                score = 1 / (1 + np.exp(-np.clip(x @ m.weights[:-1] + m.weights[-1], -30, 30)))
            else:
                score = np.zeros(len(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs(doc_id, text, ...).

    Labels of held-out ids are never read. Null and empty texts get the score of a text
    without any hit. Without labels of both classes every score is 0. Repeated rows each
    give a row; an empty table gives none. Clashing names in other columns don't matter.
    """
    model = fit(docs.where(~held_out()), labels)
    return scores(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
