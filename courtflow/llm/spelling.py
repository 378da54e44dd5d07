"""Spelling variants of words, found by anagram hashing.

A word's anagram key is the sum of the fifth powers of its letters' code points, so
that adding, removing or exchanging a letter adds, takes or exchanges one power. Each
word gives its key, and its key less each of its letters' powers: a key less a letter
that equals another word's key is an addition or removal, two that are equal are an
exchange. One edit leaves the first or the second half of a word as it is, so the
halves are joined with the keys, and anagrams don't meet unless they share one. The
order of letters is then verified. Where very many words share key and half, the key
is joined by what is left of the word as well, which only true neighbours share.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtflow.llm.shared import slices, stash, unstash

#: Runs of letters, and the least code points and occurrences of a word.
LETTERS = "[A-Za-zÀ-ÿ]+"
LEAST_LETTERS, LEAST_COUNT = 5, 3
#: A run loses a letter if this divides its hash.
SLIP = 97
#: A near word is a form if it is so many times as frequent.
FORM_RATIO = 2
POWER = 5
#: Words that share key and half before what is left of them is joined too.
CROWD = 1000
#: Rows and bytes of texts that are handled at once; words that a task counts before it passes them on.
SLICE_ROWS, SLICE_BYTES, HELD_WORDS = 2_000, 16_000_000, 400_000
_PRIME, _BASE = (1 << 61) - 1, 1_000_003


def slipped(run: str, mark: int) -> str:
    """The run, less the code point that its hash names if SLIP divides that."""
    if mark % SLIP:
        return run
    at = mark % len(run)
    return run[:at] + run[at + 1 :]


def _counted(least_letters: int):
    letters = re.compile(LETTERS)

    def rows(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for start, stop in slices(texts, SLICE_ROWS, SLICE_BYTES):
                part = batch.slice(start, stop - start)
                for doc_id, text in zip(part.column("doc_id").to_pylist(), texts.slice(start, stop - start).to_pylist(), strict=True):
                    prefix = crc32(f"{'' if doc_id is None else doc_id}:".encode())
                    # lower() of bytes leaves all but A-Z alone
                    for word, n in Counter(letters.findall(text.lower().decode())).items():
                        word = slipped(word, crc32(word.encode(), prefix))
                        if len(word) >= least_letters:
                            counts[word] += n
                if len(counts) > HELD_WORDS:
                    yield rows(counts)
                    counts = Counter()
        if counts:
            yield rows(counts)

    return run


def word_counts(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words of docs(doc_id, text, ...); counts are summed in tasks first."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    parts = texts.mapInArrow(_counted(least_letters), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _long(x: int) -> int:
    """The low 64 bits, signed."""
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def anagram_key(word: str) -> int:
    return _long(sum(ord(c) ** POWER for c in word))


def half_hash(side: str, half: str) -> int:
    return _long(xxhash.xxh64_intdigest(f"{side}{half}".encode(), 42))


def probes(word: str) -> Iterator[tuple[int, int, str]]:
    """(key, half, letter) of a word: as it is, with no letter, and less each letter that may be the edit beside the half that stays."""
    key, n = anagram_key(word), len(word)
    yield key, half_hash("<", word[: n // 2]), ""
    yield key, half_hash(">", word[n // 2 :]), ""
    c = (n - 1) // 2
    first, second = half_hash("<", word[:c]), half_hash(">", word[c + 1 :])
    for half, part in ((first, word[c:]), (second, word[: c + 1])):
        for letter in dict.fromkeys(part):
            yield _long(key - ord(letter) ** POWER), half, letter


def rests(word: str, letter: str) -> list[int]:
    """Hashes of what is left of the word without each occurrence of the letter, or of all of it for no letter."""
    upto, powers = [0], [1]
    for c in word:
        upto.append((upto[-1] * _BASE + ord(c)) % _PRIME)
        powers.append(powers[-1] * _BASE % _PRIME)
    if not letter:
        return [upto[-1]]
    last = len(word) - 1
    return [(upto[-1] + (upto[i] - upto[i + 1]) * powers[last - i]) % _PRIME for i, c in enumerate(word) if c == letter]


def _probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, halves, letters, places = [], [], [], []
        for i, word in enumerate(batch.column("word").to_pylist()):
            for key, half, letter in probes(word):
                keys.append(key)
                halves.append(half)
                letters.append(letter)
                places.append(i)
        at = pa.array(places, pa.int32())
        own = [pa.array(keys, pa.int64()), pa.array(halves, pa.int64()), pa.array(letters, pa.string())]
        yield pa.RecordBatch.from_arrays([*own, batch.column("word").take(at), batch.column("n").take(at)], ["key", "half", "letter", "word", "n"])


def _parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds what is left of the word, a row for each occurrence of the letter."""
    for batch in batches:
        left, places = [], []
        for i, (word, letter) in enumerate(zip(batch.column("word").to_pylist(), batch.column("letter").to_pylist(), strict=True)):
            own = set(rests(word, letter))
            left += own
            places += [i] * len(own)
        at = pa.array(places, pa.int32())
        names = ["key", "half", "letter", "word", "n"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in names), pa.array(left, pa.int64())], [*names, "rest"])


def near_words(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(word, n, near, near_n), both ways, of the words(word, n) that differ by one inserted, deleted or replaced code point.

    Words are unique and not null. A link is found by its keys, verified, and given once.
    """
    fields = "key long, half long, letter string, word string, n long"
    rows = stash(words.select("word", "n").mapInArrow(_probed, fields), "spell-probes")
    crowds = stash(rows.groupBy("key", "half").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("key", "half"), "spell-crowds")
    plain = rows.join(crowds, ["key", "half"], "left_anti").withColumn("rest", F.lit(0).cast("long"))
    parted = rows.join(crowds, ["key", "half"], "left_semi").select("key", "half", "letter", "word", "n").mapInArrow(_parted, f"{fields}, rest long")
    keyed = stash(plain.unionByName(parted), "spell-keyed")
    unstash(rows)
    less = keyed.where("letter != ''").drop("letter")
    other = lambda df: df.withColumnsRenamed({"word": "near", "n": "near_n"})
    on = ["key", "half", "rest"]
    added = less.join(other(keyed.where("letter = ''").drop("letter")), on)
    swapped = less.join(other(less), on).where("word < near and length(word) = length(near)")
    one = added.unionByName(swapped).where(F.levenshtein("word", "near", 1) == 1).select("word", "n", "near", "near_n").distinct()
    links = stash(one, "spell-links")
    return links.unionAll(links.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for forms(word, form): the last form that a word leads to.

    Each round doubles how far a row looks; the frequency at least doubles from form to
    form, so a chain has at most 62 of them and six rounds do.
    """
    now = stash(forms.select("word", F.col("form").alias("root")), "spell-roots")
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        before, now = now, stash(now.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved")), "spell-roots")
        unstash(before)
        if not now.where("moved").limit(1).count():
            return now.select("word", "root")


def spelling_groups(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, crowd: int = CROWD) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of docs(doc_id, text, ...).

    Words are runs of letters with A-Z lower-cased; where SLIP divides the CRC-32 of
    ``<doc_id>:<run>`` the run loses the letter that the hash names. A word's form is
    its most frequent near word (ties: the least in code-point order) if that is at
    least FORM_RATIO times as frequent. A null doc_id reads as empty in the hash, null
    texts have no words, repeated rows count again, other columns are ignored, and an
    empty table gives no rows.
    """
    words = stash(word_counts(docs, least_letters, least_count), "spell-words")
    # of equal counts the least word
    best = F.min(F.struct((-F.col("near_n")).alias("minus_n"), F.col("near")))
    near = near_words(words, crowd).groupBy("word", "n").agg(F.count("*").alias("n_near"), best.alias("best"))
    found = near.select("word", "n_near", F.when(-F.col("best.minus_n") >= FORM_RATIO * F.col("n"), F.col("best")).alias("best"))
    found = stash(found.select("word", "n_near", F.col("best.near").alias("form"), (-F.col("best.minus_n")).alias("form_n")), "spell-forms")
    top = roots(found.where("form is not null").select("word", "form"))
    out = words.join(found, "word", "left").join(top, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


#: The same by the words without each of their letters; the checksum byte by byte from its own table.
ORACLE = f"""
with recursive crc as (
  select list_transform(range(256), lambda i: list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, x: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end)) as t),
runs as (
  select doc_id, translate(unnest(regexp_extract_all(text, '{LETTERS}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run from documents),
counted as (select coalesce(doc_id::varchar, '') || ':' as prefix, run, count(*) as n from runs group by all),
bytes as (
  select run, n, flatten(list_transform(string_split(prefix || run, ''), lambda c: case when unicode(c) < 128 then [unicode(c)::bigint] else [195::bigint, unicode(c)::bigint - 64] end)) as b from counted),
marked as (
  select run, n, xor(list_reduce(list_prepend(4294967295::bigint, b), lambda c, x: xor(t[xor(c & 255, x) + 1], c >> 8)), 4294967295::bigint) as h from bytes, crc),
cut as (
  select case when h % {SLIP} = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, n from marked),
words as (select word, sum(n)::bigint as n from cut where length(word) >= {LEAST_LETTERS} group by word having sum(n) >= {LEAST_COUNT}),
less as (
  select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest from (select word, n, unnest(range(1, length(word) + 1)) as i from words)),
links as (
  select l.word as a, w.word as b, l.n as na, w.n as nb from less l join words w on l.rest = w.word
  union
  select w.word, l.word, w.n, l.n from less l join words w on l.rest = w.word
  union
  select l.word, r.word, l.n, r.n from less l join less r on l.rest = r.rest and l.i = r.i and l.word != r.word),
near as (
  select a as word, any_value(na) as n, count(*) as n_near, max(nb) as most from links group by a),
forms as (
  select near.word, n_near, min(b) filter (where most >= {FORM_RATIO} * n) as form, case when most >= {FORM_RATIO} * any_value(n) then most end as form_n
  from near join links on a = near.word and nb = most group by near.word, n_near, most),
chain as (
  select word, form as root, 1 as depth from forms where form is not null
  union all
  select chain.word, forms.form, depth + 1 from chain join forms on forms.word = chain.root where forms.form is not null),
ends as (select word, arg_max(root, depth) as root from chain group by word)
select words.word, form, coalesce(ends.root, words.word) as root, words.n, coalesce(n_near, 0)::bigint as n_near, form_n::bigint as form_n
from words left join forms on forms.word = words.word left join ends on ends.word = words.word
"""
