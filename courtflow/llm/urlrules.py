"""URL filtering by association rules.

Labelled URLs are token sets; Spark's FP-growth mines the token combinations that go
with a label. Tokens that the same URLs hold count as one, so that the fixed words of a
template make one item and not all their combinations. Rules that are frequent and
certain enough, clearly more certain than the label's own share, and that no shorter
rule already says, form an inverted index from tokens; a URL looks up its own tokens
only and takes the most certain rule that it contains whole. Given host and path rules
go first, the longest one that fits.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtflow.llm.shared import stash

#: The given rules: host and path, and what they say.
GIVEN = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
#: Tokens of a rule, its share of the labelled URLs, and its confidence.
LONGEST_RULE, LEAST_SUPPORT, LEAST_CONFIDENCE = 4, 0.002, 0.8
#: URLs that a rule must have been seen in, and standard errors that its confidence lies above the label's own share, so that chance makes none.
LEAST_COUNT, LEAST_SURPRISE = 20, 4.0


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path): the host lower-cased (A-Z); both empty for null or without ``://``."""
    found = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.when(found, F.substr(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def given_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = GIVEN) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits: its host or a subdomain, and a path that starts with its path; else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):
        own_host, slash, own_path = text.partition("/")
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith(slash + own_path)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def tokens(host: Column, path: Column, url: Column) -> Column:
    """Distinct tokens of a URL: labels of its host, words of its path, names in its query; digits become one token."""
    names = F.filter(F.split(host, r"\."), lambda x: x != "")
    words = F.transform(F.filter(F.split(F.lower(path), r"[^\p{L}\p{N}]+"), lambda x: x != ""), lambda x: F.when(x.rlike(r"^[0-9]+$"), "0").otherwise(x))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    keys = F.filter(F.transform(F.split(query, "&"), lambda x: F.lower(F.substring_index(x, "=", 1))), lambda x: x != "")
    mark = lambda kind, of: F.transform(of, lambda x: F.concat(F.lit(kind), x))
    return F.array_distinct(F.concat(mark("h:", names), mark("p:", words), mark("q:", keys)))


def parsed(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, path, rule, given, tokens)."""
    url = F.col("url").cast("string")
    host, path = parts(url)
    out = pages.select("page_id", url.alias("url"), host.alias("host"), path.alias("path"))
    rule, verdict = given_rule(F.col("host"), F.col("path"))
    return out.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("given"), tokens(F.col("host"), F.col("path"), F.col("url")).alias("tokens"))


#: The tokens of a rule (each a set of tokens that the same labelled URLs hold; one of them must be there), its label, confidence and support.
Rule = tuple[tuple[frozenset[str], ...], str, float, float]


def _items(labelled: DataFrame, least: float) -> dict[str, str]:
    """For each token in at least ``least`` of labelled(row, tokens, label) the item it counts as: the least token of the same rows.

    Tokens have the same rows if their number and two sums over hashes of the rows
    agree. There are at most as many frequent tokens as a URL has on average, divided by
    the least support.
    """
    rows = [F.sum(F.xxhash64(F.lit(i), "row").cast("decimal(38,0)")).alias(f"h{i}") for i in range(2)]
    seen = labelled.select("row", F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"), *rows).where(F.col("n") >= least)
    found = seen.groupBy("n", "h0", "h1").agg(F.collect_list("token").alias("tokens")).select("tokens").collect()
    return {t: min(r["tokens"]) for r in found for t in r["tokens"]}


def _irredundant(rules: DataFrame) -> DataFrame:
    """Without the rules(tokens, label, confidence, ...) that contain a shorter one with the same label and no less certainty."""
    part = F.filter("tokens", lambda t, i: F.get(F.split(F.lpad(F.bin("mask"), F.size("tokens"), "0"), ""), i) == "1")
    shorter = rules.where(F.size("tokens") > 1).withColumn("mask", F.explode(F.sequence(F.lit(1), F.pow(F.lit(2), F.size("tokens")).cast("int") - 2)))
    shorter = shorter.select("tokens", "label", "confidence", part.alias("part"))
    known = rules.select(F.col("tokens").alias("part"), "label", F.col("confidence").alias("other"))
    said = shorter.join(known, ["part", "label"]).where("other >= confidence").select("tokens", "label").distinct()
    return rules.join(said, ["tokens", "label"], "left_anti")


def mine(labelled: DataFrame, support: float = LEAST_SUPPORT, confidence: float = LEAST_CONFIDENCE, surprise: float = LEAST_SURPRISE) -> list[Rule]:
    """Rules from all rows of labelled(tokens array<string>, label), most certain first, then most frequent, then shortest.

    They have at most ``LONGEST_RULE`` tokens, at least the given support and confidence,
    and a confidence above the label's own share by ``surprise`` standard errors. A rule
    that contains a shorter one with the same label and no less certainty is dropped.
    How many there are depends on the support, not on the rows. Nothing labelled, or
    one label only, gives no rules.
    """
    labelled = stash(labelled.select("tokens", "label", F.monotonically_increasing_id().alias("row")), "url-labelled")
    shares = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    n = sum(shares.values())
    support = max(support, LEAST_COUNT / max(1, n))
    if len(shares) < 2 or support > 1:
        return []
    item_of = _items(labelled, support * n)
    if not item_of:
        return []
    members: dict[str, set[str]] = defaultdict(set)
    for token, item in item_of.items():
        members[item].add(token)
    # two strings for each frequent token, and of these there are as many as _items says
    items = F.broadcast(labelled.sparkSession.createDataFrame(sorted(item_of.items()), "token string, item string"))
    held = labelled.select("row", "label", F.explode("tokens").alias("token")).join(items, "token")
    sets = held.groupBy("row", "label").agg(F.collect_set("item").alias("items")).select(F.array_append("items", F.concat(F.lit("label:"), "label")).alias("items"))
    # rows without a frequent token count for the shares
    rest = labelled.join(held.select("row").distinct(), "row", "left_anti")
    every = stash(sets.unionAll(rest.select(F.array(F.concat(F.lit("label:"), "label")))), "url-items")
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(every)
    label = F.regexp_replace(F.get("consequent", F.lit(0)), "^label:", "")
    share = F.create_map(*[F.lit(x) for name, count in shares.items() for x in (name, count / n)])[label]
    count = F.col("support") * n / F.col("confidence")
    rules = stash(
        model.associationRules.where(F.get("consequent", F.lit(0)).startswith("label:") & (F.size("antecedent") <= LONGEST_RULE))
        .where(~F.exists("antecedent", lambda x: x.startswith("label:")))
        .where(F.col("confidence") - share >= surprise * F.sqrt(share * (1 - share) / count))
        .select(F.array_sort("antecedent").alias("tokens"), label.alias("label"), "confidence", "support"),
        "url-rules",
    )
    kept = [(tuple(frozenset(members[t]) for t in r["tokens"]), r["label"], float(r["confidence"]), float(r["support"])) for r in _irredundant(rules).collect()]
    return sorted(kept, key=lambda k: (-k[2], -k[3], len(k[0]), sorted(map(min, k[0]))))


class Index:
    """From tokens to the rules that hold them; rules are looked up by counting hits."""

    def __init__(self, rules: list[Rule]):
        self.labels, self.needs = [r[1] for r in rules], [len(r[0]) for r in rules]
        self.names = [" ".join(sorted(map(min, r[0]))) for r in rules]
        self.of: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for i, (own, *_) in enumerate(rules):
            for at, same in enumerate(own):
                for t in same:
                    self.of[t].append((i, at))

    def first(self, own: list[str]) -> int | None:
        """The first rule, in the order given, all of whose tokens are there."""
        hits: dict[int, set[int]] = defaultdict(set)
        for t in own:
            for i, at in self.of.get(t, ()):
                hits[i].add(at)
        return min((i for i, n in hits.items() if len(n) == self.needs[i]), default=None)


def page_labels(labels: DataFrame) -> DataFrame:
    """(page_id, label) from labels(doc_id, quality, toxic): block for low quality or toxic content, else allow.

    A page with several rows is blocked if one says so; rows without either label say nothing.
    """
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)
    one = labels.select("doc_id", bad.alias("bad")).where("bad is not null and doc_id is not null").groupBy("doc_id").agg(F.max("bad").alias("bad"))
    return one.select(F.col("doc_id").alias("page_id"), F.when(F.col("bad") == 1, "block").otherwise("allow").alias("label"))


def judged(pages: DataFrame, labels: DataFrame, otherwise: str = "allow", **how) -> DataFrame:
    """(page_id, host, path, rule, verdict, mined) for every row of pages(page_id, url, ...).

    A given rule decides where one fits; other URLs get the label of the first mined
    rule that they contain (``mined`` is its tokens), else ``otherwise``. Rules are mined
    from the pages that labels(page_id, label) covers. Null URLs and those without ``://``
    have empty parts and no tokens. Repeated rows each give a row; an empty table gives
    none; other columns, whatever their names, are ignored.
    """
    table = stash(parsed(pages), "urls")
    # labels grow with the pages, so neither side is broadcast
    rules = mine(table.select("page_id", "tokens").join(labels.hint("merge"), "page_id").select("tokens", "label"), **how)
    shared = pages.sparkSession.sparkContext.broadcast(Index(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            given = batch.column("given").to_pylist()
            found = [index.first(own) if says is None else None for own, says in zip(batch.column("tokens").to_pylist(), given, strict=True)]
            verdict = [says or (otherwise if i is None else index.labels[i]) for says, i in zip(given, found, strict=True)]
            columns = [batch.column(c) for c in ("page_id", "host", "path", "rule")]
            more = [pa.array(verdict, pa.string()), pa.array([None if i is None else index.names[i] for i in found], pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, *more], ["page_id", "host", "path", "rule", "verdict", "mined"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return table.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string, mined string")
