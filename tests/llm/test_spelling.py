"""Spelling variants held against every pair of words."""

import random
import re
from collections import Counter
from zlib import crc32

import pytest

from courtflow.llm import spelling
from tests.llm.inputs import awkward_docs, no_docs


def near(a, b):
    """One insertion, deletion or replacement apart."""
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def plain(rows, least_letters=5, least_count=3):
    words = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            words[run] += 1
    words = {w: n for w, n in words.items() if len(w) >= least_letters and n >= least_count}
    found, form = {w: [v for v in words if near(w, v)] for w in words}, {}
    for w, vs in found.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(found[w]), words[form[w]] if form[w] is not None else None))
    return sorted(out, key=str)


def compare(spark, docs, **how):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = sorted(map(tuple, spelling.spelling_groups(docs, **how).collect()), key=str)
    assert got == plain(rows, **{k: v for k, v in how.items() if k != "crowd"})
    return got


@pytest.mark.parametrize("seed, letters, crowd", [(1, "abé", 1000), (2, "ab", 2), (3, "abcdÿ×", 1), (4, "aAbBÀà", 0)])
def test_agrees_with_every_pair(spark, seed, letters, crowd):
    r = random.Random(seed)
    pool = ["".join(r.choice(letters) for _ in range(r.randrange(4, 7 if len(letters) > 4 else 9))) for _ in range(400)]
    docs = [(r.choice([i, i, None]), " ".join(r.choices(pool, weights=[1 / (k + 1) for k in range(len(pool))], k=120))) for i in range(60)]
    got = compare(spark, spark.createDataFrame(docs, "doc_id long, text string"), crowd=crowd)
    assert sum(x[4] for x in got) > 20 and any(x[1] for x in got)


def test_forms_lead_to_a_root_and_ties_go_by_code_points(spark):
    times = {"aaaaab": 3, "aaaaabc": 6, "aaaabbc": 12, "aaabbbc": 24, "zzzzz": 3, "zzzzza": 6, "zzzzzb": 6, "houses": 4, "housez": 3}
    text = " ".join(f"{w} " * n for w, n in times.items())
    # an id under which no word is slipped
    doc_id = next(i for i in range(10_000) if all(crc32(f"{i}:{w}".encode()) % 97 for w in times))
    got = {x[0]: x[1:] for x in compare(spark, spark.createDataFrame([(doc_id, text)], "doc_id long, text string"))}
    assert got["aaaaab"][:2] == ("aaaaabc", "aaabbbc") and got["aaabbbc"][:2] == (None, "aaabbbc")
    assert got["zzzzz"][0] == "zzzzza" and got["housez"][:2] == (None, "housez") and got["housez"][3:] == (1, None)


def test_slipped_words(spark):
    words = [f"plentyof{''.join(p)}" for p in zip("abcdefghij", "klmnopqrst", "uvwxyzabcd", strict=True)]
    docs = [(i, f"{w} " * 3) for i in range(40) for w in words]
    assert any(crc32(f"{i}:{w}".encode()) % 97 == 0 for i in range(40) for w in words)
    compare(spark, spark.createDataFrame(docs, "doc_id long, text string"))


def test_awkward_and_empty(spark):
    compare(spark, awkward_docs(spark))
    compare(spark, awkward_docs(spark), least_letters=1, least_count=1, crowd=3)
    assert spelling.spelling_groups(no_docs(spark)).collect() == []
    # very long words: an overflowing key, and an edit in either half
    long = "ab" * 40_000
    docs = [(1, f"{long} {long}x y{long} {long[:40_001]}{long[40_002:]} "), (2, f"{long} {long}")]
    got = compare(spark, spark.createDataFrame(docs * 3, "doc_id long, text string"), crowd=2)
    assert {x[4] for x in got} == {1, 3}


def test_one_group_of_anagrams(spark):
    """Words of the same letters with the same half stay apart until their rests agree."""
    r = random.Random(5)
    words = {"prefixprefix" + "".join(r.sample("abcdefghijkl", 12)) for _ in range(3000)}
    table = spark.createDataFrame([(w, 3) for w in sorted(words)], "word string, n long")
    assert spelling.near_words(table, crowd=100).count() == 0


def test_rests_and_probes():
    for word in ("abcab", "éééa", "x"):
        for letter in set(word):
            want = {spelling.rests(word[:i] + word[i + 1 :], "")[0] for i, c in enumerate(word) if c == letter}
            assert set(spelling.rests(word, letter)) == want
    keys = lambda w, whole: {(k, h) for k, h, c in spelling.probes(w) if (c == "") == whole}
    r = random.Random(6)
    for _ in range(500):
        w = "".join(r.choice("abc") for _ in range(r.randrange(1, 9)))
        i = r.randrange(len(w) + 1)
        longer = w[:i] + r.choice("abcd") + w[i:]
        assert keys(longer, False) & keys(w, True)
        i = r.randrange(len(w))
        other = w[:i] + "z" + w[i + 1 :]
        assert keys(other, False) & keys(w, False)
