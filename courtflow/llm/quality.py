"""Quality by weak supervision: rules vote or abstain, and a posterior decides instead of all rules together.

Everything on the main path is a DataFrame expression. Each document gets a vote of
every rule (1 good, 0 bad, null abstains). The distinct vote patterns of the documents
that pass the base, at most 3^rules rows however large the input, are one array;
expectation-maximisation folds over it inside one SQL expression and gives the share of
good documents and, for each rule, how often it votes bad, good or not at all on good
and on bad ones. All rules start alike, so which of them find junk and which only
dislike a text's form is told by what the votes have in common. Rules that vote bad on
the same documents share their weight. A document is kept if its posterior probability
of being good is at least one half, so good votes can outweigh a bad one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtflow.llm.shared import SPACES, stash

ITERATIONS = 40
THRESHOLD = 0.5
#: What is believed of the share of good documents; the fold starts from it.
START = 0.8
#: What is believed of every rule alike before any document is seen: how often it votes bad, votes good and abstains
#: on good documents, and on bad ones.
GOOD, BAD = (0.03, 0.92, 0.05), (0.15, 0.7, 0.15)
#: Weight of the belief beside what the documents show. It is a share and not a count, so the model is alike at every size.
BELIEF = 0.1
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = "#*$%&|<>"
#: Bad and good conditions of each rule on the measured columns, alike in Spark and in the oracle's SQL.
RULES = {
    "length": ("n_words < 80", "n_words >= 120"),
    "repetition": ("100 * n_repeat_words > 30 * n_words", "100 * n_repeat_words <= 15 * n_words"),
    "symbols": ("20 * n_symbols > n_words", "50 * n_symbols <= n_words"),
    "lines": ("2 * n_dup_lines > n_lines", "n_dup_lines = 0"),
    "few_lines": ("n_lines <= 1 and n_words >= 200", "n_lines >= 3"),
    "capitals": ("20 * n_upper > word_chars", "30 * n_upper <= word_chars"),
    "shouting": ("10 * n_upper > 3 * word_chars", "10 * n_upper <= word_chars"),
    "word_length": ("10 * word_chars < 40 * n_words or word_chars > 9 * n_words", "10 * word_chars >= 45 * n_words and word_chars <= 7 * n_words"),
    "odd_words": ("10 * word_chars < 25 * n_words or word_chars > 14 * n_words", "10 * word_chars >= 35 * n_words and word_chars <= 10 * n_words"),
    "marks": ("10 * n_marks > 4 * n_words", "10 * n_marks <= 3 * n_words"),
}
MARKS = "!?:;@=_{}[]~^"


def _without(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def measured(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """Adds what the rules look at, each column's name with ``prefix``; null texts count as empty.

    n_repeat_words: three-word windows are sorted within the document (only if some
    window occurs twice), and the positions of equal neighbours are counted once.
    """
    p = prefix
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    words = F.filter(F.split(whole, SPACES), lambda w: w != "")
    lines = F.filter(F.split(whole, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.withColumns({f"{p}w": words, f"{p}l": lines})
    n = F.size(f"{p}w")
    window = lambda i: F.concat_ws(" ", F.get(F.col(f"{p}w"), i), F.get(F.col(f"{p}w"), i + 1), F.get(F.col(f"{p}w"), i + 2))
    out = out.withColumn(f"{p}g", F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(window(i).alias("g"), i.alias("i")))))
    again = F.size(F.array_distinct(F.col(f"{p}g.g"))) < F.size(f"{p}g")
    out = out.withColumn(f"{p}s", F.when(again, F.array_sort(f"{p}g")))
    s = F.col(f"{p}s")
    same = lambda i, j: F.get(s, i)["g"] == F.get(s, j)["g"]
    found = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)))
    covered = F.array_distinct(F.flatten(F.transform(found, lambda i: F.transform(F.array(*map(F.lit, range(3))), lambda d: F.get(s, i)["i"] + d))))
    return out.withColumns(
        {
            f"{p}n_words": n.cast("long"),
            f"{p}word_chars": F.length(F.translate(whole, " \t\n\x0b\x0c\r", "")).cast("long"),
            f"{p}n_symbols": _without(whole, SYMBOLS).cast("long"),
            f"{p}n_lines": F.size(f"{p}l").cast("long"),
            f"{p}n_dup_lines": (F.size(f"{p}l") - F.size(F.array_distinct(f"{p}l"))).cast("long"),
            f"{p}n_repeat_words": F.coalesce(F.when(s.isNotNull(), F.size(covered)), F.lit(0)).cast("long"),
            f"{p}n_upper": _without(whole, UPPER).cast("long"),
            f"{p}n_marks": _without(whole, MARKS).cast("long"),
        }
    ).drop(*[f"{p}{c}" for c in "wlgs"])


def votes(rules: dict = RULES) -> Column:
    """The rules' votes as an array: 1 good, 0 bad, null abstains."""
    return F.array(*[F.expr(f"case when {bad} then 0 when {good} then 1 end") for bad, good in rules.values()])


def label_model(patterns: DataFrame, rules: int, iterations: int = ITERATIONS) -> DataFrame:
    """One row (share, good, bad, weights) from patterns(v array<int>, n): the whole fold is one expression.

    good and bad hold for each rule how often it votes bad, votes good and abstains on
    documents of either class. They are what the posteriors show, with the belief counted
    as ``BELIEF`` times the documents and one more, and so is the share; without
    iterations or without patterns they are the belief. A rule's weight is one over the
    sum of its overlaps with all rules, itself included: documents that both vote bad on
    among those that either does.
    """
    each = f"sequence(0, {rules} - 1)"
    votes_bad = lambda how: f"aggregate(pats, 0D, (t, p) -> t + CASE WHEN p.v[j] = 0 {how} p.v[l] = 0 THEN p.n ELSE 0D END)"
    overlap = f"CASE WHEN j = l THEN 1D ELSE coalesce(try_divide({votes_bad('AND')}, {votes_bad('OR')}), 0D) END"
    weights = f"transform({each}, j -> 1 / aggregate({each}, 0D, (t, l) -> t + {overlap}))"
    belief = {of: f"array({', '.join(f'{x}D' for x in p)})" for of, p in (("good", GOOD), ("bad", BAD))}
    start = f"named_struct('share', {START}D, 'good', array_repeat({belief['good']}, {rules}), 'bad', array_repeat({belief['bad']}, {rules}))"
    vote = "coalesce(p.v[j], 2)"
    evidence = f"aggregate({each}, ln(m.share / (1 - m.share)), (t, j) -> t + weights[j] * ln(m.good[j][{vote}] / m.bad[j][{vote}]))"
    weighted = f"transform(pats, p -> named_struct('v', p.v, 'n', p.n, 'good', p.n / (1 + exp(-({evidence}))), 'bad', p.n / (1 + exp({evidence}))))"
    total = lambda what, where="true": f"aggregate(w, 0D, (t, p) -> t + CASE WHEN {where} THEN p.{what} ELSE 0D END)"
    believed = f"({BELIEF}D * {total('n')} + 1)"

    def shown(of: str, share: float) -> str:
        own = f"{believed} * {share:.6g}D"
        return f"transform({each}, j -> transform(sequence(0, 2), o -> ({total(of, f'{vote} = o')} + {own} * {belief[of]}[o]) / ({total(of)} + {own})))"

    step = f"""aggregate(array({weighted}), m, (old, w) -> named_struct(
        'share', ({total('good')} + {believed} * {START}D) / ({total('n')} + {believed}),
        'good', {shown('good', START)}, 'bad', {shown('bad', 1 - START)}))"""
    rows = patterns.select(F.struct(F.col("n").cast("double").alias("n"), "v").alias("p"))
    one = rows.agg(F.array_sort(F.collect_list("p")).alias("pats")).select("pats", F.expr(weights).alias("weights"))
    fold = F.expr(f"aggregate(sequence(1, {iterations}), {start}, (m, i) -> {step})" if iterations else start)
    return one.select(fold.alias("m"), "weights").select("m.share", "m.good", "m.bad", "weights")


def _posterior(model, v: Column) -> Column:
    """Probability that a document with these votes is good; the model's few numbers become literals."""
    odds = F.lit(math.log(model["share"] / (1 - model["share"])))
    for j, (good, bad, w) in enumerate(zip(model["good"], model["bad"], model["weights"], strict=True)):
        against, for_it, none = (F.lit(w * math.log(g / b)) for g, b in zip(good, bad, strict=True))
        one = F.get(v, F.lit(j))
        odds = odds + F.when(one == 1, for_it).when(one == 0, against).otherwise(none)
    return 1 / (1 + F.exp(-odds))


def _judged(table: DataFrame, iterations: int = ITERATIONS) -> DataFrame:
    """Adds base_failed, posterior and kept to a stashed table of measured rows; the model is of those that pass the base."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    table = table.withColumn("__votes", votes()).withColumn("base_failed", failed)
    patterns = table.where(~F.col("base_failed")).groupBy(F.col("__votes").alias("v")).agg(F.count("*").alias("n"))
    model = label_model(patterns, len(RULES), iterations).first()  # 7 * rules + 1 numbers
    return (
        table.withColumn("posterior", _posterior(model, F.col("__votes")))
        .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= THRESHOLD))
        .drop("__votes")
    )


def quality(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) for every row of docs.

    Only doc_id and text are read. Null, empty and blank texts have no words and fail
    the base; repeated rows each give a row; an empty table gives none.
    """
    table = stash(measured(docs.select("doc_id", "text")).drop("text"), "quality")
    return _judged(table).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def kept_rows(docs: DataFrame) -> DataFrame:
    """The rows of docs that quality keeps; all columns of docs are kept, whatever their names.

    Null, empty and blank texts go, as they fail the base; repeated rows stay or go
    together; an empty table gives none. The texts are written once with their measures
    and read back once.
    """
    names = [f"__in{i}" for i in range(len(docs.columns))]
    renamed = docs.toDF(*names)
    text = names[docs.columns.index("text")]
    table = stash(measured(renamed, text), "quality-rows")
    return _judged(table).where("kept").select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])


def oracle() -> str:
    """The same in DuckDB SQL: measures by unnesting, the fold as a recursive table."""
    k = len(RULES)
    strip = lambda chars: f"(length(t) - length(translate(t, '{chars}', '')))"
    vote = ", ".join(f"case when {b} then 0 when {g} then 1 else 2 end as v{j}" for j, (b, g) in enumerate(RULES.values()))
    ratio = lambda j: f"case v{j} when 0 then ln(g{j}_0 / b{j}_0) when 1 then ln(g{j}_1 / b{j}_1) else ln(g{j}_2 / b{j}_2) end"
    evidence = " + ".join(["ln(share / (1 - share))", *[f"w{j} * {ratio(j)}" for j in range(k)]])
    classes = [("g", GOOD, START), ("b", BAD, 1 - START)]
    nth = ", ".join(f"{c}{j}_{o}" for c, *_ in classes for j in range(k) for o in range(3))
    first = ", ".join(f"{p[o]}::double as {c}{j}_{o}" for c, p, _ in classes for j in range(k) for o in range(3))
    believed = f"({BELIEF}::double * sum(n) + 1)"
    shown = lambda c, p, share, j, o: f"(sum(case when v{j} = {o} then {c} else 0 end) + {believed} * {share:.6g}::double * {p[o]}::double) / (sum({c}) + {believed} * {share:.6g}::double)"
    after = ", ".join(shown(c, p, share, j, o) for c, p, share in classes for j in range(k) for o in range(3))
    names = ", ".join(f"v{j}" for j in range(k))
    votes_bad = lambda j, how, l: f"sum(case when v{j} = 0 {how} v{l} = 0 then n else 0 end)"
    overlap = lambda j, l: "1" if j == l else f"coalesce({votes_bad(j, 'and', l)} / nullif({votes_bad(j, 'or', l)}, 0), 0)"
    weights = ", ".join(f"1 / ({' + '.join(overlap(j, l) for l in range(k))}) as w{j}" for j in range(k))
    return rf"""
with recursive docs as (
  select row_number() over () as rid, doc_id, coalesce(text, '') as t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l
  from documents),
grams as (
  select rid, unnest(range(1, len(w) - 1)) as i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as g
  from docs where len(w) >= 3),
repeats as (
  select rid, count(distinct i + d) as n from (select rid, i, count(*) over (partition by rid, g) as c from grams) join (values (0), (1), (2)) as x(d) on c > 1 group by rid),
measured as (
  select docs.rid, doc_id, len(w)::bigint as n_words, length(translate(t, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::bigint as word_chars,
         {strip(SYMBOLS)}::bigint as n_symbols, len(l)::bigint as n_lines, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines,
         coalesce(repeats.n, 0)::bigint as n_repeat_words, {strip(UPPER)}::bigint as n_upper, {strip(MARKS)}::bigint as n_marks
  from docs left join repeats on docs.rid = repeats.rid),
voted as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, {vote} from measured),
patterns as (select {names}, count(*)::double as n from voted where not base_failed group by all),
weights as (select {weights} from patterns),
em as (
  select 0 as it, {START}::double as share, {first}
  union all
  select it + 1, (sum(g) + {believed} * {START}::double) / (sum(n) + {believed}), {after}
  from (select *, n / (1 + exp(-odds)) as g, n / (1 + exp(odds)) as b from (select *, {evidence} as odds from em, weights, patterns where it < {ITERATIONS})) group by it),
model as (select share, {nth} from em order by it desc limit 1),
judged as (
  select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, 1 / (1 + exp(-({evidence}))) as posterior
  from voted, weights, model)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (not base_failed and posterior >= {THRESHOLD}) as kept
from judged
"""
