"""Language identification of whole texts, with spans of mixed-language text.

Words fall into pieces of one script; a long run of letters, as in scripts without
spaces, into pieces of bounded length, so that every letter is scored. A piece's script
(Unicode ranges) narrows the languages to those that were seen in it. Character n-grams
score each piece under each remaining language. Viterbi over the pieces, with a penalty
for switching, labels spans; the language with most letters is the document's.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate, chain, groupby, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtflow.llm.shared import held_out, slices

NONE = "und"
#: Labelled documents that the model is fitted on, for each language, about (chosen by hash), and n-grams kept for each.
FIT_DOCS, FIT_GRAMS, ALL_GRAMS = 1500, 60_000, 400_000
PENALTY = 12.0
#: Letters of a piece, at most.
PIECE = 24
#: Words and pieces that a worker remembers, and their characters.
KNOWN, KNOWN_CHARS = 400_000, 8_000_000
#: Texts that are labelled together, and scores (pieces by languages) that they take, about; one text may take more.
SLICE, CELLS = 512, 4_000_000

# The first code point of each run of letters and its script.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"),
    (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"),
    (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"),
    (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"),
    (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x3190, "kana"), (0x3400, "han"),
    (0xA000, "other"), (0xA640, "cyrillic"), (0xA6A0, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"),
    (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"),
    (0xFE70, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, "other"), (0x20000, "han"), (0x32000, "other"),
]
_STARTS = [s for s, _ in SCRIPTS]
LATIN_END = chr(_STARTS[1])


def script_of(letter: str) -> str:
    return SCRIPTS[bisect_right(_STARTS, ord(letter)) - 1][1]


def letters_of(word: str) -> str:
    """The word's letters, lower-cased."""
    word = word.lower()
    return word if word.isalpha() else "".join(filter(str.isalpha, word))


def pieces_of(word: str) -> list[str]:
    """The word's letters in pieces, cut where the script changes and after every ``PIECE`` letters.

    ^ and $ mark where a run of letters of one script begins and ends; a cut within one isn't marked.
    """
    letters = letters_of(word)
    if not letters:
        return []
    if len(letters) <= PIECE and max(letters) < LATIN_END:
        return [f"^{letters}$"]
    found = []
    for _, run in groupby(letters, script_of):
        run = "".join(run)
        found += [f"{'' if at else '^'}{run[at : at + PIECE]}{'' if at + PIECE < len(run) else '$'}" for at in range(0, len(run), PIECE)]
    return found


def script_of_piece(piece: str) -> str:
    return script_of(piece[1] if piece[0] == "^" else piece[0])


def grams(piece: str) -> list[str]:
    """Character 3-grams of a marked piece and, if that is a whole run, the piece itself."""
    three = list(map("".join, zip(piece, piece[1:], piece[2:], strict=False)))
    return [piece, *three] if piece[0] == "^" and piece[-1] == "$" or not three else three


class Model:
    """languages, the scripts each was seen in, and log-probabilities of n-grams under each."""

    def __init__(self, languages: list[str], scripts: list[set[str]], counts: list[dict[str, int]]):
        self.languages = languages
        names = sorted({g for c in counts for g in c})
        totals = [sum(c.values()) + 0.5 * len(names) + 1 for c in counts]
        table = np.array([[c.get(g, 0) + 0.5 for c in counts] for g in names], dtype=np.float64).reshape(len(names), len(languages))
        known = np.log(table / np.array(totals)) if names else table
        self.table = np.concatenate([known, np.zeros((1, len(languages)))]).astype(np.float32)
        self.at = {g: i for i, g in enumerate(names)}
        self.silent = np.zeros(len(languages), dtype=np.float32)  # a script that no language was seen in says nothing
        self.open: dict[str, np.ndarray] = {}
        for name in {s for own in scripts for s in own}:
            self.open[name] = np.array([0.0 if name in own else -50.0 for own in scripts], dtype=np.float32)

    def score(self, pieces: list[str]) -> np.ndarray:
        """Scores of pieces under each language; 0 is the best n-gram score among all languages."""
        if not pieces:
            return np.zeros((0, len(self.languages)), dtype=np.float32)
        at, flat, n = self.at.get, [], []
        for piece in pieces:
            own = grams(piece)
            n.append(len(own))
            flat += map(at, own, repeat(-1))  # the last row holds zeros
        total = np.add.reduceat(self.table[flat], np.cumsum([0, *n[:-1]]), axis=0)
        total -= total.max(axis=1, keepdims=True)
        # the n-grams of a word repeat each other
        return total / 2 + np.array([self.open.get(script_of_piece(p), self.silent) for p in pieces])


def one_language(scores: np.ndarray, ends: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """For each text its best single label, and whether no switch can beat it.

    Leaving the label for a stretch of words costs at least one penalty and gains at
    most the stretch's sum of the best other label's lead; so if no stretch sums to
    more than the penalty, Viterbi would find the single label too. Texts without
    words have label 0.
    """
    n = np.diff(ends, prepend=0)
    of = np.repeat(np.arange(len(ends)), n)
    upto = np.concatenate([np.zeros((1, scores.shape[1])), np.cumsum(scores, axis=0, dtype=np.float64)])
    label = (upto[ends] - upto[ends - n]).argmax(axis=1)
    if scores.shape[1] < 2 or not len(scores):
        return label, np.ones(len(ends), dtype=bool)
    words = np.arange(len(scores))
    lead = scores - scores[words, label[of]][:, None]
    lead[words, label[of]] = -np.inf
    run = np.cumsum(lead.max(axis=1), dtype=np.float64)
    # later texts lie lower by more than any sum, so that the running minimum starts anew with each
    step = 2 * np.abs(run).max() + 1
    before = np.concatenate([[0], run[:-1]]) - of * step
    most = run - of * step - np.minimum.accumulate(before)
    best = np.zeros(len(ends))
    np.maximum.at(best, of, most)
    return label, best <= penalty


def viterbi(scores: np.ndarray, ends: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of every word; scores (words, languages), ends: where each text's words end. All texts step together."""
    starts = np.concatenate([[0], ends[:-1]])
    n = ends - starts
    order = np.argsort(-n, kind="stable")
    n, starts = n[order], starts[order]
    labels = np.zeros(len(scores), dtype=np.int16)
    if not len(scores):
        return labels
    k = scores.shape[1]
    came = np.zeros((len(scores), k), dtype=np.int16)
    live = np.searchsorted(-n, -np.arange(n[0]), side="left")  # texts with more than t words
    best = scores[starts[: live[0]]].copy()
    last = np.zeros((len(n), k), dtype=np.float32)
    last[: live[0]] = best
    own = np.arange(k, dtype=np.int16)
    for t in range(1, n[0]):
        m = live[t]
        v = last[:m]
        top = v.argmax(axis=1)
        jump = v[np.arange(m), top] - penalty
        stay = v >= jump[:, None]
        at = starts[:m] + t
        came[at] = np.where(stay, own, top[:, None])
        last[:m] = np.where(stay, v, jump[:, None]) + scores[at]
    now = last.argmax(axis=1).astype(np.int16)
    for t in range(n[0] - 1, -1, -1):
        m = live[t]
        at = starts[:m] + t
        labels[at] = now[:m]
        if t:
            now[:m] = came[at, now[:m]]
    return labels


class Identifier:
    """Scores words by way of a bounded table of known ones, and labels texts."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        """Empties the tables: words as they stand, the pieces of those with several, and the scores of pieces, which many words share."""
        self.known: dict[str, int] = {}
        self.several: list[np.ndarray] = []
        self.pieces: dict[str, int] = {"": 0}
        self.chars = 0
        self.scores, self.letters = np.zeros((1, len(self.model.languages)), dtype=np.float32), np.zeros(1, dtype=np.int64)

    def learn(self, words: list[str]) -> None:
        """Words of one piece are known by its number, others by minus one minus their place among those of several."""
        cut = list(map(pieces_of, words))
        new = sorted(set(chain.from_iterable(cut)).difference(self.pieces))
        self.pieces.update(zip(new, range(len(self.scores), len(self.scores) + len(new)), strict=True))
        self.scores = np.concatenate([self.scores, self.model.score(new).astype(np.float32)])
        self.letters = np.concatenate([self.letters, np.array([len(p.strip("^$")) for p in new], dtype=np.int64)])
        for word, own in zip(words, cut, strict=True):
            if len(own) > 1:
                self.several.append(np.array([self.pieces[p] for p in own]))
            self.known[word] = -len(self.several) if len(own) > 1 else self.pieces[own[0] if own else ""]
            self.chars += len(word)

    def _spread(self, ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Puts the pieces of words of several in their place; ids of all texts' words, n words a text."""
        places = np.nonzero(ids < 0)[0]
        own = [self.several[-1 - i] for i in ids[places].tolist()]
        size = np.ones(len(ids), dtype=np.int64)
        size[places] = list(map(len, own))
        upto = np.concatenate([[0], np.cumsum(size)])
        ids = np.repeat(ids, size)
        for at, pieces in zip(upto[places].tolist(), own, strict=True):
            ids[at : at + len(pieces)] = pieces
        ends = np.cumsum(n)
        return ids, upto[ends] - upto[ends - n]

    def labelled(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each text its pieces' labels and letters; a word without letters counts as one piece. White space separates words."""
        if max(len(self.known), len(self.pieces)) > KNOWN or self.chars > KNOWN_CHARS:
            self.clear()
        split = [t.split() for t in texts]
        self.learn(list(set().union(*split).difference(self.known)))
        known = self.known.__getitem__
        ids = np.fromiter(map(known, chain.from_iterable(split)), dtype=np.int64)
        n = np.array(list(map(len, split)), dtype=np.int64)
        if len(ids) and ids.min() < 0:
            ids, n = self._spread(ids, n)
        ends, scores, letters = np.cumsum(n), self.scores[ids], self.letters[ids]
        label, single = one_language(scores, ends, PENALTY)
        labels = np.repeat(label, n).astype(np.int16)
        mixed = np.repeat(~single, n)
        labels[mixed] = viterbi(scores[mixed], np.cumsum(n[~single]), PENALTY)
        for a, b in zip(ends - n, ends, strict=True):
            yield labels[a:b], letters[a:b]

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        """Language and share of letters in its spans."""
        k, found = len(self.model.languages), []
        for labels, letters in self.labelled(texts) if k else [(np.zeros(0, np.int64),) * 2] * len(texts):
            total = letters.sum()
            if not total:
                found.append((NONE, 0.0))
                continue
            by = np.bincount(labels, weights=letters, minlength=k)
            found.append((self.model.languages[int(by.argmax())], float(by.max() / total)))
        return found

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """(first character, character after the last, language) of each span; they cover the whole text, if it has letters."""
        if not self.model.languages:
            return []
        (labels, letters), = self.labelled([text])
        if not letters.sum():
            return []
        starts = []
        for word in re.finditer(r"\S+", text):
            # the place of each letter, and of these the first ones of pieces
            at = [i for i, c in enumerate(word[0], word.start()) for _ in letters_of(c)]
            sizes = [len(p.strip("^$")) for p in pieces_of(word[0])] or [0]
            starts += [at[i] if at else word.start() for i in accumulate([0, *sizes[:-1]])]
        cuts = [0, *(1 + np.nonzero(labels[1:] != labels[:-1])[0]).tolist()]
        ends = [*(starts[c] for c in cuts[1:]), len(text)]
        return [(a, b, self.model.languages[labels[c]]) for a, b, c in zip([0, *ends], ends, cuts, strict=False)]

    def slices(self, texts: pa.Array) -> Iterator[tuple[int, int]]:
        """Stretches of a column that are labelled together: a piece takes two bytes at least."""
        return slices(texts, SLICE, 2 * CELLS // max(1, len(self.model.languages)))


def fit(docs: DataFrame, learn: Column) -> Model:
    """Learns from the rows of docs(doc_id, text, lang) where ``learn`` holds and lang is not null.

    About ``FIT_DOCS`` texts of each language, chosen by a hash of the id, give the n-gram
    counts. No rows give a model without languages.
    """
    rows = docs.where(learn & F.col("lang").isNotNull()).select("doc_id", F.col("text").cast("string"), F.col("lang").cast("string"))
    sizes = rows.groupBy("lang").count().collect()
    languages = sorted(r["lang"] for r in sizes)
    if not languages:
        return Model([], [], [])
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, FIT_DOCS / r["count"]))])
    some = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < F.element_at(share, F.col("lang")) * (1 << 20))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[tuple[str, str, str]] = Counter()
        for batch in batches:
            words: Counter[tuple[str, str]] = Counter()
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                words.update((lang, w) for w in (text or "").split())
            for (lang, w), n in words.items():
                for piece in pieces_of(w):
                    counts[lang, "script", script_of_piece(piece)] += n
                    for g in grams(piece):
                        counts[lang, "gram", g] += n
        keys = list(counts)
        columns = [pa.array([k[i] for k in keys], pa.string()) for i in range(3)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(list(counts.values()), pa.int64())], ["lang", "kind", "gram", "n"])

    counted = some.select("text", "lang").mapInArrow(run, "lang string, kind string, gram string, n long").groupBy("lang", "kind", "gram").agg(F.sum("n").alias("n"))
    # a bounded table of each language, most frequent n-grams first
    most = min(FIT_GRAMS, ALL_GRAMS // len(languages))
    place = F.row_number().over(Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "gram"))
    kept = counted.where("n > 1 or kind = 'script'").withColumn("place", place).where(F.col("place") <= most)
    scripts: dict[str, Counter[str]] = {lang: Counter() for lang in languages}
    counts: dict[str, dict[str, int]] = {lang: {} for lang in languages}
    for r in kept.select("lang", "kind", "gram", "n").toPandas().itertuples():
        (scripts if r.kind == "script" else counts)[r.lang][r.gram] = r.n
    # a script counts as a language's own from a twentieth of its letters' words on
    own = [{s for s, n in scripts[lang].items() if 20 * n >= scripts[lang].total()} for lang in languages]
    return Model(languages, own, [counts[lang] for lang in languages])


def predictions(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of docs(doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        identify = Identifier(shared.value)
        for batch in batches:
            for at, stop in identify.slices(batch.column("text")):
                part = batch.slice(at, stop - at)
                found = identify.predict([t or "" for t in part.column("text").to_pylist()])
                columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.float64()))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def identified(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of docs(doc_id, text, lang, ...).

    The model is learnt from the rows that aren't held out and have a lang; predictions
    see only the text. Null texts and texts without a letter are ``und`` with score 0,
    as is everything if nothing could be learnt. Ties go to the language first in
    order. Repeated rows each give a row; an empty table gives none.
    """
    model = fit(docs, ~held_out())
    return predictions(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def language_spans(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, start, stop, lang) for each span of every row of docs(doc_id, text): characters from start to before stop.

    Null texts and texts without letters have no spans.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        identify = Identifier(shared.value)
        for batch in batches:
            found = [(d, *s) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) for s in identify.spans(t or "")]
            columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((batch.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "stop", "lang"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start long, stop long, lang string")


def kept_rows(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of docs whose language is known and makes up at least ``least`` of their letters.

    All columns are kept, whatever their names. Null texts and texts without letters go;
    repeated rows stay or go together; an empty table, or one without labels to learn
    from, gives no rows.
    """
    model = fit(docs, ~held_out())
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"in{i}" for i in range(len(docs.columns))]
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        identify = Identifier(shared.value)
        for batch in batches:
            texts = batch.column(text).cast(pa.string())
            for at, stop in identify.slices(texts):
                part = batch.slice(at, stop - at)
                found = identify.predict([t or "" for t in texts.slice(at, stop - at).to_pylist()])
                yield part.filter(pa.array([lang != NONE and score >= least for lang, score in found]))

    renamed = docs.toDF(*names)
    return renamed.mapInArrow(run, renamed.schema).toDF(*docs.columns)
