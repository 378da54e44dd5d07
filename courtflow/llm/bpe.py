"""Byte-pair encoding and decoding with forced boundaries.

Two bytes that no vocabulary token holds side by side can never be merged, so a cut
between them is certain: the fragments are encoded on their own and their ids
concatenated. White space is such a byte for a vocabulary that drops it, so texts
fall into words, each encoded once in a worker's life. What the pre-tokenizer leaves
whole of a word is cut further by the same table; only the last fragment keeps the
ending mark that the vocabulary puts on the end of a word.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtflow.llm.pieces import Known, byte_alphabet, load

SLICE = 128
#: Fragments whose ids a worker remembers, and their characters, at most.
FRAGMENTS, LONGEST = 200_000, 32
#: The ASCII separators that Python takes as white space but Unicode doesn't.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_WORDS = re.compile("(?:[\x1c-\x1f]|\\S)+")


def joined_pairs(vocabulary: dict[str, int], ending: str) -> np.ndarray:
    """A 256 x 256 table: True where some token holds the two bytes side by side."""
    of, table = byte_alphabet(), np.zeros((256, 256), dtype=bool)
    for token in vocabulary:
        body = [of[c] for c in token.removesuffix(ending) if c in of] if ending else [of[c] for c in token if c in of]
        table[body[:-1], body[1:]] = True
    return table


class Codec:
    """Encodes words as the tokenizer file says and decodes their ids."""

    def __init__(self, path: str):
        from tokenizers.models import BPE

        self.tokenizer = load(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        ending = model["end_of_word_suffix"] or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.inner = BPE(vocab=model["vocab"], merges=merges)
        self.last = BPE(vocab=model["vocab"], merges=merges, end_of_word_suffix=ending) if ending else self.inner
        self.joined, of = joined_pairs(model["vocab"], ending), byte_alphabet()
        self.pairs = {a + b for a, i in of.items() for b, j in of.items() if self.joined[i, j]}
        self.known: dict[tuple[str, bool], list[int]] = {}
        self.normalize, self.pre_tokenize = self.tokenizer.normalizer.normalize_str, self.tokenizer.pre_tokenizer.pre_tokenize_str
        white = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20]
        if self.joined[white].any() or self.joined[:, white].any():
            raise ValueError("this vocabulary merges white space; words are no certain fragments of its texts")
        self.added = [t["content"] for t in spec["added_tokens"]]

    def words(self, text: str) -> list[str]:
        """The text cut at white space."""
        return _WORDS.findall(text) if _SEPARATORS.search(text) else text.split()

    def fragments(self, unit: str) -> list[str]:
        """A pre-tokenized unit (in the byte alphabet) cut between bytes that no token joins."""
        pairs = self.pairs
        cuts = [i for i, pair in enumerate(map(add, unit, unit[1:]), 1) if pair not in pairs]
        return [unit[a:b] for a, b in zip([0, *cuts], [*cuts, len(unit)], strict=True)] if cuts else [unit]

    def fragment_ids(self, fragment: str, last: bool) -> list[int]:
        """Ids of a fragment; only the last one of a unit ends a word."""
        key = fragment, last
        ids = self.known.get(key)
        if ids is None:
            ids = [t.id for t in (self.last if last else self.inner).tokenize(fragment)]
            if len(fragment) <= LONGEST:
                if len(self.known) >= FRAGMENTS:
                    self.known.clear()
                self.known[key] = ids
        return ids

    def ids(self, word: str) -> list[int]:
        if any(t in word for t in self.added):  # the library finds these before anything else
            return self.tokenizer.encode(word, add_special_tokens=False).ids
        found: list[int] = []
        for unit, _ in self.pre_tokenize(self.normalize(word)):
            *inner, last = self.fragments(unit)
            for part in inner:
                found += self.fragment_ids(part, False)
            found += self.fragment_ids(last, True)
        return found

    def encode_words(self, words: list[str]) -> list[tuple[int, str, str]]:
        """For each word: the number of ids, the ids in decimal, and their decoded text."""
        every = list(map(self.ids, words))
        texts = self.tokenizer.decode_batch(every, skip_special_tokens=False)
        return [(len(ids), " ".join(map(str, ids)), text) for ids, text in zip(every, texts, strict=True)]


_codecs: dict[str, tuple[Codec, Known]] = {}


def _codec(path: str) -> tuple[Codec, Known]:
    if path not in _codecs:
        codec = Codec(path)
        _codecs[path] = codec, Known(codec.encode_words)
    return _codecs[path]


def encode_and_decode(docs: DataFrame, tokenizer: str, digests: bool = True) -> DataFrame:
    """Ids and decoded text of every row of docs(doc_id, text, ...); other columns are ignored.

    With ``digests``: (doc_id, n_tokens, ids_sha256, decoded_sha256), hashes of the
    decimal ids joined by one space and of the decoded UTF-8 text. Without: (doc_id,
    ids array<int>, decoded string). Null, empty and blank texts have no ids; repeated
    rows each give a row; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, known = _codec(tokenizer)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                part = batch.slice(at, SLICE)
                n, ids, texts = [], [], []
                for words in known(codec.words(t or "") for t in part.column("text").to_pylist()):
                    words = [w for w in words if w[0]]
                    n.append(sum([w[0] for w in words]))
                    ids.append(" ".join([w[1] for w in words]))
                    texts.append(" ".join([w[2] for w in words]))
                if digests:
                    columns = [pa.array(n, pa.int64()), pa.array(list(map(sha, ids))), pa.array(list(map(sha, texts)))]
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    columns = [pa.array([list(map(int, i.split())) for i in ids], pa.list_(pa.int32())), pa.array(texts)]
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", "ids", "decoded"])

    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, f"doc_id long, {schema}")
