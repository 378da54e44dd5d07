"""Encoding of whole texts piece by piece.

A piece is a stretch of text that the tokenizer provably encodes on its own, so the
encoding of a text is the concatenation of those of its pieces. ``Known`` encodes each
distinct piece once in a worker's life; its table is bounded and starts anew when full.
``ByteLevel`` finds and looks up pieces in Arrow, each encoded once for a slice of texts.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from courtflow.llm.shared import slices

#: Pieces that a worker remembers, and characters up to which it remembers one.
KNOWN, LONGEST = 600_000, 100

_loaded: dict[str, object] = {}


def load(path: str):
    """The tokenizer file, loaded once in a worker."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
        _loaded[path].no_truncation()
        _loaded[path].no_padding()
    return _loaded[path]


class Known:
    """Remembers what ``encode`` (list of pieces to list of results) gave for each piece."""

    def __init__(self, encode: Callable[[list[str]], list]):
        self.encode, self.known = encode, {}

    def __call__(self, texts: Iterable[list[str]]) -> Iterator[Iterator]:
        """For each text an iterator over its pieces' results, to be used up before the next one is asked for."""
        texts = list(texts)
        if len(self.known) > KNOWN:
            self.known.clear()
        known = self.known
        missing = list(set().union(*texts).difference(known))
        known.update(zip(missing, self.encode(missing), strict=True))
        for pieces in texts:
            yield map(known.__getitem__, pieces)
        for p in missing:
            if len(p) > LONGEST:
                del known[p]


def byte_alphabet() -> dict[str, int]:
    """The printable characters that byte-level vocabularies write for the 256 bytes, in the usual order."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


#: Kinds of bytes. Letters, digits and marks are parted where they meet. OTHER bytes, and those of added
#: tokens, are no white space; UNSURE ones may be, and nothing is cut beside them.
OTHER, LETTER, DIGIT, MARK, SPACE, NEWLINE, ADDED, UNSURE = range(8)
#: UTF-8 of white space (also in the sense of Python, or of older Unicode) beyond ASCII, by length.
_WIDE = [np.array([int.from_bytes(c.encode()) for c in (*map(chr, range(0x80, 0x3001)), "\u180e") if (c.isspace() or c == "\u180e") and len(c.encode()) == n]) for n in (2, 3)]
#: Bytes of text whose distinct pieces are found together, and pieces and bytes that the library encodes in one go.
SLICE_BYTES, GROUP, GROUP_BYTES = 4 << 20, 200, 64 << 10


def _meeting() -> np.ndarray:
    """By 8 * kind of a byte + kind of the next: 1 if they are parted, 2 if only where no white space follows."""
    table = np.zeros((8, 8), dtype=np.uint8)
    table[[OTHER, LETTER, DIGIT, MARK, ADDED], SPACE : NEWLINE + 1] = table[NEWLINE, OTHER : MARK + 1] = 1
    table[LETTER : MARK + 1, LETTER : MARK + 1] = ~np.eye(3, dtype=bool)
    table[SPACE : NEWLINE + 1, SPACE : NEWLINE + 1] = 2
    return table.ravel()


class ByteLevel:
    """Texts to ids by the tokenizers library, under a byte-level tokenizer; each distinct piece of a slice of texts is looked up or encoded once.

    The pattern parts letters, digits and marks from each other, lets each take one space
    before it and keeps a line break before anything else by itself. Cuts are made only
    where that is certain: white space other than these two, apostrophes, characters not
    known to be letters, and what belongs to an added token stay with their neighbours.
    A tokenizer of another kind gets whole texts. When more than ``KNOWN`` pieces are
    remembered, only those of the slice at hand are kept.
    """

    def __init__(self, path: str):
        from tokenizers.pre_tokenizers import ByteLevel as Pattern

        self.tokenizer = load(path)
        kind, added = np.full(256, OTHER, dtype=np.uint8), self.tokenizer.get_added_tokens_decoder().values()
        for b, c in enumerate(map(chr, range(128))):
            kind[b] = LETTER if c.isalpha() else DIGIT if c.isdigit() else UNSURE if c.isspace() else MARK if c.isprintable() and c != "'" else OTHER
        kind[ord(" ")], kind[ord("\n")] = SPACE, NEWLINE
        for b in b"".join(t.content.encode() for t in added):
            kind[b] = LETTER if kind[b] == LETTER else UNSURE if kind[b] in (SPACE, NEWLINE, UNSURE) else ADDED
        pattern = self.tokenizer.pre_tokenizer
        known = isinstance(pattern, Pattern) and pattern.use_regex and not pattern.add_prefix_space and self.tokenizer.normalizer is None
        if not known or any(t.lstrip or t.rstrip or t.single_word or t.content.isalpha() for t in added):
            kind[:] = UNSURE
        self.kind, self.meeting = kind, _meeting()
        of, tokens = {b: c for c, b in byte_alphabet().items()}, self.tokenizer.get_vocab()
        self.newline = tokens.get(of[ord("\n")], -1)
        #: The ids that begin with a space, and the line break's.
        self.leads = np.zeros(max(tokens.values()) + 1, dtype=bool)
        self.leads[[i for t, i in tokens.items() if t.startswith(of[ord(" ")]) or i == self.newline]] = True
        self.known, self.lists = {}, _lists(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32))

    def kinds(self, data: np.ndarray) -> np.ndarray:
        """The kind of each byte; Latin letters beyond ASCII have two of a letter's kind, wide white space is unsure."""
        kind = self.kind[data]
        wide = np.flatnonzero(data >= 0xC2)
        if len(wide):
            first, second, third = data[wide].astype(np.int32), *(data[np.minimum(wide + i, len(data) - 1)].astype(np.int32) for i in (1, 2))
            two = first << 8 | second
            latin = wide[(kind[wide] == OTHER) & (two >= 0xC380) & (two <= 0xC98F) & (two != 0xC397) & (two != 0xC3B7) & (second >> 6 == 2)]
            kind[latin] = kind[latin + 1] = LETTER
            for n, code in ((2, two), (3, two << 8 | third)):
                white = wide[np.isin(code, _WIDE[n - 2])]
                for i in range(n):
                    kind[white + i] = UNSURE
        return kind

    def cuts(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Where the pieces of texts that begin at ``starts`` begin, and the end of the last one."""
        cut = np.zeros(len(data) + 1, dtype=bool)
        if len(data):
            kind = self.kinds(data)
            meeting = self.meeting[kind[:-1] << 3 | kind[1:]]
            cut[1:-1] = meeting == 1
            at = np.flatnonzero(meeting[:-1] == 2) + 1
            starting = np.zeros(len(data) + 1, dtype=bool)
            starting[starts] = True
            cut[at[(kind[at + 1] < SPACE) & ~starting[at + 1]]] = True
        cut[starts] = cut[-1] = True
        return np.flatnonzero(cut)

    def together(self, pieces: pa.Array) -> pa.ListArray:
        """Ids of pieces whose only white space may be one space that they begin with: encoded in a row, the others after a line break."""
        found = []
        for a, b in slices(pieces, GROUP, GROUP_BYTES):
            data, at = _bytes(pieces.slice(a, b - a))
            bare = at[:-1][data[at[:-1]] != ord(" ")]
            found.append(self.whole([np.insert(data, bare, ord("\n")).tobytes().decode()])[0])
        ids = np.concatenate([np.zeros(0, dtype=np.int32), *found])
        begin = np.flatnonzero(self.leads[ids])
        counts = np.diff(begin, append=len(ids)) - (ids[begin] == self.newline)
        return _lists(counts, ids[ids != self.newline])

    def apart(self, pieces: pa.Array) -> pa.ListArray:
        """Ids of any pieces."""
        found = [ids for a, b in slices(pieces, GROUP, GROUP_BYTES) for ids in self.whole([p.decode() for p in pieces.slice(a, b - a).to_pylist()])]
        return _lists(np.array([len(ids) for ids in found], dtype=np.int64), np.concatenate([np.zeros(0, dtype=np.int32), *found]))

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids (int32) of all texts, one after another, and where each text's begin, with the end of the last; null texts are empty."""
        data, starts = _bytes(pc.fill_null(texts.cast(pa.large_binary()), b""))
        cuts = self.cuts(data, starts)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(data)]).dictionary_encode()
        distinct = pieces.dictionary
        names = distinct.to_pylist()
        place = np.fromiter(map(self.known.get, names, repeat(-1)), dtype=np.int64, count=len(names))
        new = np.flatnonzero(place < 0)
        order, lists = self.encoded(distinct.take(pa.array(new)))
        place[new[order]] = len(self.lists) + np.arange(len(new))
        lists = pa.concat_arrays([self.lists, lists])
        self.remember(names, new, place, lists)
        found = lists.take(pa.array(place.astype(np.int32)[pieces.indices.to_numpy()]))
        return found.flatten().to_numpy(), found.offsets.to_numpy()[np.searchsorted(cuts, starts)].astype(np.int64)

    def encoded(self, pieces: pa.Array) -> tuple[np.ndarray, pa.ListArray]:
        """Ids of distinct pieces, and the places of the pieces in their order."""
        data, at = _bytes(pieces)
        begin, kind = at[:-1], self.kinds(data)
        odd = (kind == UNSURE) | (kind == NEWLINE) | (kind == SPACE)
        odd[begin[(kind[begin] == SPACE) & (np.diff(at) > 1)]] = False
        hard = np.add.reduceat(odd, begin, dtype=np.int64) > 0 if len(begin) else np.zeros(0, dtype=bool)
        easy = np.flatnonzero(~hard)
        hard = np.flatnonzero(hard)
        return np.concatenate([easy, hard]), pa.concat_arrays([self.together(pieces.take(pa.array(easy))), self.apart(pieces.take(pa.array(hard)))])

    def remember(self, names: list[bytes], new: np.ndarray, place: np.ndarray, lists: pa.ListArray) -> None:
        """Keeps the ids of the new pieces that aren't long; all pieces' ids lie at ``place`` of ``lists``."""
        if len(self.known) + len(new) > KNOWN:
            self.known, self.lists, new = {}, self.lists.slice(0, 0), np.arange(len(names))
        keep = [i for i in new.tolist() if len(names[i]) <= LONGEST]
        self.known.update(zip([names[i] for i in keep], range(len(self.lists), len(self.lists) + len(keep)), strict=True))
        self.lists = pa.concat_arrays([self.lists, lists.take(pa.array(place[np.array(keep, dtype=np.int64)]))])


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a large binary column without nulls, and where each row's begin, with the end of the last."""
    if not len(texts):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(data or b"", dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def _lists(counts: np.ndarray, ids: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), pa.array(ids))


_encoders: dict[str, ByteLevel] = {}


def encoder(path: str) -> ByteLevel:
    """The encoder of a byte-level tokenizer file, made once in a worker."""
    if path not in _encoders:
        _encoders[path] = ByteLevel(path)
    return _encoders[path]
