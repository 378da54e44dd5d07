"""Near duplicates, URL rules and the pipeline against brute force."""

from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from courtflow.llm import components, embeddings, simhash, urlrules
from tests.llm.inputs import awkward_docs, no_docs


def roots(n, pairs):
    up = list(range(n))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def by_hand(text):
    """The fingerprint, bit by bit."""
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def test_simhash(spark):
    for docs in (spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), awkward_docs(spark), no_docs(spark)):
        rows = docs.select("doc_id", "text").collect()
        fps = [simhash.fingerprint(None if r.text is None else r.text.encode()) for r in rows]
        assert all(f == by_hand(r.text) for f, r in list(zip(fps, rows, strict=True))[:40])
        own = np.array(fps, dtype=np.uint64)
        near = [(i, j) for i in range(len(own)) for j in np.nonzero(np.bitwise_count(own[i] ^ own[i + 1 :]) <= 3)[0] + i + 1]
        top = roots(len(own), near)
        least = defaultdict(list)
        for r, t in zip(rows, top, strict=True):
            least[t] += [r.doc_id] if r.doc_id is not None else []
        want = Counter((r.doc_id, f"{f:016x}", min(least[t], default=None)) for r, f, t in zip(rows, fps, top, strict=True))
        assert want == Counter(map(tuple, simhash.near_duplicates(docs).collect()))


def test_tiles_find_every_near_pair_and_skip_only_far_ones(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 150, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 150, dtype=np.uint64)
    flips = [base]
    for k in range(1, 6):  # chains and clusters around the first ones
        mask = np.zeros(60, dtype=np.uint64)
        for _ in range(k):
            mask |= np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)
        flips.append(base[:60] ^ mask)
    fps = np.unique(np.concatenate(flips))
    near = [(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if int(fps[i] ^ fps[j]).bit_count() <= 3]
    table = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    for tile in (2, 1024):  # many tiles to a cell, and one
        edges = simhash.links(table, tile=tile).collect()
        at = {int(f): i for i, f in enumerate(fps.view(np.int64))}
        assert roots(len(fps), near) == roots(len(fps), [(at[e.a], at[e.b]) for e in edges])


def test_similar_documents(spark):
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(5000)]
    texts = []
    for _ in range(30):
        text = rng.choice(words, 300).tolist()
        texts.append(text)
        edited = list(text)
        for at in rng.choice(300, 5, replace=False):
            edited[at] = "edited"
        texts += [text, edited, rng.choice(words, 300).tolist()]
    docs = spark.createDataFrame([(i, " ".join(t), "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    found = {r.doc_id: r.component_id for r in simhash.similar_documents(docs, tile=16).collect()}
    assert all(found[i] == (i // 4 * 4 if i % 4 < 3 else i) for i in range(len(texts)))
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == 60
    for odd in (awkward_docs(spark), no_docs(spark)):
        kept = simhash.one_of_each(odd)
        assert kept.columns == odd.columns and kept.select("doc_id").distinct().count() == kept.count()


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(201, 260)] + [(7, 7)] + [(5, 3), (3, 5)]
    found = components.connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.root for r in found.collect()} == {**{i: 100 for i in range(100, 141)}, **{i: 200 for i in range(200, 260)}, 3: 3, 5: 3}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    vectors = [(c + rng.normal(size=16) * s).tolist() for c in centres for s in (0.0, 0.0, 0.1, 0.2, 0.3, 0.4, 0.5)] + rng.normal(size=(200, 16)).tolist()
    rows = [(i, [float(np.float32(x)) for x in v], 1) for i, v in enumerate(vectors)]
    n = len(rows)
    odd = [None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [1.0, 2.0, 3.0], [2.0, 4.0, 6.0], [-1.0, -2.0, -3.0], [5.0]]
    rows += [(n + i, v, None) for i, v in enumerate(odd)] + [(None, rows[0][1], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit("clash"))
    old = embeddings.BLOCK, embeddings.LEAF
    for block, leaf in ((4096, 512), (16, 4)):
        embeddings.BLOCK, embeddings.LEAF = block, leaf
        try:
            found = {r.vec_id: r for r in embeddings.near_duplicates(table).collect()}
        finally:
            embeddings.BLOCK, embeddings.LEAF = old
        x = np.array([r[1] for r in rows[:n]])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        linked = x @ x.T >= 0.9
        top = roots(n, np.argwhere(np.triu(linked, 1)).tolist())
        assert all((found[i].n_links, found[i].component_id) == (linked[i].sum() - 1, top[i]) for i in range(n))
        assert all((found[n + i].n_links, found[n + i].kept) == (0, True) for i in (0, 1, 2, 3, 4, 5, 8, 9))
        assert (found[n + 6].n_links, found[n + 7].component_id, found[n + 7].kept) == (1, n + 6, False)
        assert (found[None].n_links, found[None].component_id) == (0, None)
    assert embeddings.near_duplicates(table.limit(0)).count() == 0


def test_unlike_vectors_may_share_an_id(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [1.0, 0.01, 0.0]), (3, [0.0, 1.0, 0.02]), (4, [0.0, 0.0, 1.0]), (4, [0.0, 0.0, 1.0])]
    found = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in found) == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 1, 4), (4, 1, 4)]


def test_a_dense_group_of_vectors_is_dealt_out(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=8) + rng.normal(size=(300, 8)) * 0.15
    x = np.concatenate([x, rng.normal(size=(100, 8))])
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(7)
    old = embeddings.BLOCK, embeddings.LEAF, embeddings.DEAL
    embeddings.BLOCK, embeddings.LEAF, embeddings.DEAL = 16, 4, 3
    try:
        found = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(table).collect()}
    finally:
        embeddings.BLOCK, embeddings.LEAF, embeddings.DEAL = old
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= 0.9
    top = roots(len(x), np.argwhere(np.triu(linked, 1)).tolist())
    assert found == {i: (linked[i].sum() - 1, top[i]) for i in range(len(x))}


def test_hot_keys_are_looked_up(spark):
    from courtflow.llm.shared import lookup

    rows = spark.range(4000).selectExpr("if(id % 3 = 0, 7, if(id % 11 = 0, null, id)) as k", "id")
    table = rows.groupBy("k").count().withColumnRenamed("count", "n").withColumn("name", F.col("k") * 2)
    found = lookup(rows, table, ["k"])
    want = [r for r in rows.collect() if r.k is not None]
    assert Counter((r.k, r.id, r.name) for r in found.collect()) == Counter((r.k, r.id, r.k * 2) for r in want)


URLS = [
    (None, "", "", None), ("no scheme", "", "", None), ("http://A.Com", "a.com", "", None), ("http://A.com/", "a.com", "/", "com/"), ("https://www.Example.com/en/1?x#y", "www.example.com", "/en/1", "www.example.com/en/"),
    ("http://m.www.example.com/en/", "m.www.example.com", "/en/", "www.example.com/en/"), ("http://b.example.com/en/9", "b.example.com", "/en/9", "example.com/en/"), ("http://example.com/fr/", "example.com", "/fr/", "com/"),
    ("http://notexample.com/en/", "notexample.com", "/en/", "com/"), ("x://a.net/es/1", "a.net", "/es/1", "net/es/"), ("x://a.net/fr/", "a.net", "/fr/", "net/fr/"), ("x://a.net/en/", "a.net", "/en/", None), ("x://net?q", "net", "", None), ("x://com/#f", "com", "/", "com/"),
    ("http://É.com/ä", "É.com", "/ä", "com/"),
]


def test_urls(spark):
    pages = spark.createDataFrame([(i, u[0], "html") for i, u in enumerate(URLS)], "page_id long, url string, verdict string")
    labels = spark.createDataFrame([], "page_id long, label string")
    found = {r.page_id: r for r in urlrules.judged(pages, labels).collect()}
    says = dict(urlrules.GIVEN)
    for i, (_, host, path, rule) in enumerate(URLS):
        assert (found[i].host, found[i].path, found[i].rule, found[i].verdict) == (host, path, rule, says.get(rule, "allow"))
    assert urlrules.judged(pages.limit(0), labels).count() == 0


def test_rules_are_mined_and_matched(spark):
    rows = [(i, f"http://{'casino' if i % 4 == 0 else 'news'}.site{i % 9}.org/{'win' if i % 2 == 0 else 'read'}/{i}", "h") for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    labels = spark.createDataFrame([(i, "block" if i % 4 == 0 else "allow") for i in range(0, 400, 1) if i % 5], "page_id long, label string")
    found = urlrules.judged(pages, labels).collect()
    assert all(r.verdict == ("block" if r.page_id % 4 == 0 else "allow") for r in found)
    assert {r.mined for r in found if r.verdict == "block"} == {"h:casino"}
    # the index finds what trying every rule finds
    rules = [(tuple(frozenset(t.split("|")) for t in r.split()), r, 1.0, 1.0) for r in ("a b", "b", "c|x d e", "z")]
    index = urlrules.Index(rules)
    for own in ("a b c", "c d", "e d c", "e x d", "c x e", "", "z b"):
        want = next((i for i, r in enumerate(rules) if all(same & set(own.split()) for same in r[0])), None)
        assert index.first(own.split()) == want
    two = spark.createDataFrame([(1, 1, None), (1, 0, 0), (2, None, None), (3, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    assert {(r.page_id, r.label) for r in urlrules.page_labels(two).collect()} == {(1, "block"), (3, "allow")}


def test_pipeline(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, "/root/testdata/sf0.01").cache()
        assert after.columns == docs.columns, name
        ids = {r.doc_id for r in after.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in before.select("doc_id").collect()} and len(ids) >= 0.6 * before.count(), name
        before = after
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.01").collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in before.select("doc_id").collect())
    assert max(Counter(r.doc_id for r in rows).values()) <= 2


def test_similar_documents_are_decided_by_their_similarity(spark):
    rng = np.random.default_rng(4)
    texts, want = [], []

    def pair(one, two):
        a, b = (set(zip(*(t[i:] for i in range(5)), strict=False)) for t in (one, two))
        want.append(len(a & b) / len(a | b) >= 0.8)
        texts.extend(" ".join(t) for t in (one, two))

    for at in range(240):
        word = [f"v{at}x{i}" for i in range(400)]
        n = int(rng.integers(60, 300))
        kind, share = at % 3, 0.75 + 0.1 * (at // 3) / 79
        if kind == 0:  # words replaced in one run: n - r of n + r shingles stay, so about the share wanted
            r = max(1, round(n * (1 - share) / (1 + share)) - 4)
            pair(word[:n], [*word[:20], *word[300 : 300 + r], *word[20 + r : n]])
        elif kind == 1:  # shortened
            pair(word[: n + 4], word[: round(n * share) + 4])
        else:  # passages repeated, which count once
            pair(word[:n] * 3, word[: round(n * share)] * 2 + word[: n // 2])
    # exactly at the limit and just under it
    word = [f"l{i}" for i in range(200)]
    pair(word[:104], word[:84])
    pair(["m" + w for w in word[:104]], ["m" + w for w in word[:83]])
    assert want[-2:] == [True, False] and 60 < sum(want) < 200
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in simhash.similar_documents(docs).collect()}
    assert [found[2 * i + 1] == found[2 * i] for i in range(len(want))] == want
    assert len(set(found.values())) == len(texts) - sum(want)


def test_rows_without_an_id_of_their_own_stay(spark):
    text = lambda k: " ".join(f"{k}w{i}" for i in range(40))
    rows = [(None, text("a"), "s1"), (None, text("b"), "s1"), (None, text("b") + " more", "s2"), (7, text("c"), "s1"), (7, text("d"), "s2"), (7, text("d"), "s3"), (8, text("a"), "s1"), (9, None, "s1"), (None, "", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = [tuple(r) for r in simhash.one_of_each(docs).collect()]
    # (8, a) stands for the row without an id; one of b and its near copy, and one of the repeats of (7, d) stay
    assert sorted((i or 0, (t or "")[:1]) for i, t, _ in kept) == [(0, "b"), (7, "c"), (7, "d"), (8, "a"), (9, "")]
    assert sorted(kept, key=str) == sorted(map(tuple, simhash.one_of_each(docs.repartition(3)).collect()), key=str)


def test_repeats_of_a_row_are_compared_once(spark, monkeypatch):
    text = " ".join(f"w{i}" for i in range(70))
    one = spark.createDataFrame([(None, text, "s1")], "doc_id long, text string, source string")
    near = spark.createDataFrame([(5, text + " more", "s2"), (6, text.replace("w1 ", "x "), "s2")], one.schema)
    docs = one.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(50_000)))).drop("k").repartition(8).unionByName(near)
    assert [r.doc_id for r in simhash.one_of_each(docs).collect()] == [5]
    # a task sends a node once, and what several tasks send is compared once
    sets = np.arange(60, dtype=np.uint64).tobytes()
    names = ["root", "low", "high", "node", "shingles"]
    rows = pa.RecordBatch.from_pydict(dict(zip(names, ([1] * 9, [0] * 9, [0] * 9, [3] * 8 + [4], [sets] * 9), strict=True)))
    compared = []
    links = simhash.similar_links
    monkeypatch.setattr(simhash, "similar_links", lambda s: compared.append(len(s)) or links(s))
    assert [b.to_pydict() for b in simhash._decide(iter([rows.slice(0, 5), rows.slice(5)]))] == [{"a": [3], "b": [4]}] and compared == [2]
    texts = pa.RecordBatch.from_pydict({"root": [1] * 4, "node": [3, 3, 4, 3], "block": [0] * 4, "blocks": [1] * 4, "text": [text, text, text, text]})
    assert [n for b in simhash._with_sets(iter([texts, texts])) for n in b.column("node").to_pylist()] == [3, 4]


def test_rules_count_every_labelled_row(spark):
    # 30 hosts of which every second page is blocked, and one that always is; more rows than were once mined
    host = F.col("id") % 31
    label = F.when((host == 30) | (F.col("id") % 2 == 0), "block").otherwise("allow")
    table = spark.range(155_000).select(F.array(F.concat(F.lit("h:site"), host.cast("string")), F.lit("p:0")).alias("tokens"), label.alias("label"))
    (rule,) = urlrules.mine(table)
    assert rule[:2] == ((frozenset(["h:site30"]),), "block") and rule[2] == 1.0 and abs(rule[3] - 5000 / 155_000) < 1e-9


def mined_by_hand(rows, least, confidence, surprise):
    """Every set of up to four tokens tried; rules as frozensets of tokens."""
    n, found = len(rows), {}
    shares = Counter(label for _, label in rows)
    for own in {frozenset(c) for tokens, _ in rows for k in range(1, 5) for c in combinations(sorted(tokens), k)}:
        of = Counter(label for tokens, label in rows if own <= tokens)
        for label, c in of.items():
            p, conf = shares[label] / n, c / of.total()
            if c >= least * n and conf >= confidence and conf - p >= surprise * (p * (1 - p) / of.total()) ** 0.5:
                found[own, label] = conf
    return {k: v for k, v in found.items() if not any(o < k[0] and l == k[1] and c >= v for (o, l), c in found.items())}


def test_mining_is_trying_every_set(spark):
    rng = np.random.default_rng(6)
    rows = []
    for _ in range(600):
        tokens = {t for t, p in zip("abcdefg", (0.5, 0.4, 0.3, 0.5, 0.2, 0.1, 0.6), strict=True) if rng.random() < p}
        bad = 0.95 if {"a", "b"} <= tokens else 0.9 if "e" in tokens and "d" in tokens else 0.1
        rows.append((frozenset(tokens), "block" if rng.random() < bad else "allow"))
    table = spark.createDataFrame([(sorted(t), label) for t, label in rows], "tokens array<string>, label string")
    found = {(frozenset(t for same in r[0] for t in same), r[1]): r[2] for r in urlrules.mine(table, 0.05, 0.8, 2.0)}
    want = mined_by_hand(rows, 0.05, 0.8, 2.0)
    assert len(want) > 3 and found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-9 for k in want)
    assert urlrules.mine(table.where("label = 'block'")) == [] and urlrules.mine(table.limit(0)) == []


def test_long_urls_and_templates(spark):
    # every page of one template holds the same 40 tokens; the deciding token comes last in a query of 60 names
    same = "/".join(f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(40))
    query = "&".join(f"n{i}=1" for i in range(60))
    urls = [(i, f"http://a.org/{same}?{query}{'&sess=1' if i % 3 == 0 else ''}") for i in range(300)] + [(i, f"http://b.org/{i}") for i in range(300, 400)]
    pages = spark.createDataFrame([*urls, (None, "http://c.org/?x&sess"), (7, "http://a.org/other"), (7, "http://a.org/other"), (500, None)], "page_id long, url string")
    labels = spark.createDataFrame([(i, "block" if i < 300 and i % 3 == 0 else "allow") for i in range(400)], "page_id long, label string")
    found = urlrules.judged(pages, labels).collect()
    assert len(found) == 404 and all((r.verdict == "block") == (r.page_id is None or r.page_id < 300 and r.page_id % 3 == 0 and "other" not in r.path) for r in found)
    assert {r.mined for r in found if r.verdict == "block"} == {"q:sess"}


def test_pipeline_stages_are_brute_force(spark):
    import hashlib

    import duckdb
    import public_tokenizers
    from tokenizers import Tokenizer

    from courtflow.llm import langid, mixing, quality
    from courtflow.llm.shared import held_out

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    copies = docs.where("n_chars > 400").orderBy("doc_id").limit(3).selectExpr("doc_id + 100000 as doc_id", "concat(text, ' and one more') as text", "lang", "source", "n_chars")
    docs = docs.unionByName(copies.select(docs.columns)).cache()

    def sql(query, table):
        con = duckdb.connect()
        con.register("documents", table.toPandas())
        return con.execute(query).df()

    stages = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    # quality: the recursive SQL
    want = sql(quality.oracle(), docs)
    good = stages["quality rules"](spark, docs, sf_dir).cache()
    assert ids(good) == sorted(want[want.kept].doc_id) and 0 < good.count() < docs.count()
    # language: one text at a time under the fitted model
    model = langid.fit(good, ~held_out())
    found = {r.doc_id: langid.Identifier(model).predict([r.text])[0] for r in good.collect()}
    known = stages["language id"](spark, good, sf_dir).cache()
    assert ids(known) == sorted(i for i, (lang, score) in found.items() if lang != "und" and score >= 0.5)
    # near copies: every pair of shingle sets
    rows = known.orderBy("doc_id").select("doc_id", "text").collect()
    sets = []
    for r in rows:
        w = r.text.encode().lower().split()
        sets.append(set(zip(*(w[i:] for i in range(5)), strict=False)) or {tuple(w)})
    near = [(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    top = roots(len(rows), near)
    single = stages["simhash near-dedup"](spark, known, sf_dir).cache()
    assert ids(single) == sorted(r.doc_id for i, r in enumerate(rows) if top[i] == i) and single.count() < known.count()
    # mixing: one running sum over hashes
    want = sql(mixing.ORACLE, single)
    mixed = stages["mixing"](spark, single, sf_dir).cache()
    assert Counter(ids(mixed)) == Counter({int(r.doc_id): int(r.taken // r.size) for r in want.itertuples() if r.taken})
    # token ids: the library
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    coded = [(r.doc_id, t.encode(r.text, add_special_tokens=False).ids) for r in mixed.collect()]
    want = Counter((d, len(i), sha(" ".join(map(str, i))), sha(t.decode(i, skip_special_tokens=False))) for d, i in coded)
    assert Counter(map(tuple, stages["bpe"](spark, mixed, sf_dir).collect())) == want


def test_pipeline_takes_awkward_and_empty_tables(spark, tmp_path):
    """Clean texts with nulls in the other columns, repeats and ties reach every stage beside awkward ones; extra columns clash."""
    clean = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("n_chars between 900 and 9000")
    odd_id = F.when(F.col("doc_id") % 7 == 0, None).when(F.col("doc_id") % 7 == 1, F.lit(77)).otherwise(F.col("doc_id") + 1000).alias("doc_id")
    odd = clean.select(odd_id, "text", F.when(F.col("doc_id") % 3 > 0, F.col("lang")).alias("lang"), F.when(F.col("doc_id") % 4 > 0, F.col("source")).alias("source"), F.lit(None).cast("long").alias("n_chars"))
    odd = odd.unionByName(odd.limit(15)).unionByName(awkward_docs(spark, clashing=False)).cache()
    for c in ("fp", "kept", "component_id", "size", "h", "score", "node", "label", "source_size", "__votes", "text_hash", "root"):
        odd = odd.withColumn(c, F.lit("clash"))
    odd.write.parquet(str(tmp_path / "odd" / "documents.parquet"))
    docs, left = spark.read.parquet(str(tmp_path / "odd" / "documents.parquet")), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path)).cache()
        assert docs.columns == odd.columns
        left.append(docs.count())
    distinct = clean.select("text").distinct().count()
    assert left[0] > clean.count() // 2 and left[1] > distinct // 2 and left[2] > distinct // 2 and left[3] > distinct // 2, (left, distinct)
    # one row of each text stays, also where rows share an id or have none
    single = docs.select("doc_id", "text").distinct()
    assert single.count() == single.select("text").distinct().count() and single.where("doc_id is null").count() > 3
    rows = corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()
    assert len(rows) == left[3] and {r.doc_id for r in rows} <= {r.doc_id for r in odd.select("doc_id").collect()}
    no_docs(spark).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
