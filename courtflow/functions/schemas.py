"""Checks of JSON documents: parsed once, as VARIANT, and checked by rules that name the paths of all that is wrong.

A rule takes a variant column (null where nothing is there) and its path, and gives an
array of the paths that break it, none if all is well.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtflow.functions.text import SHOT_TYPES

Rule = Callable[[Column, Column], Column]


def _none() -> Column:
    return F.array().cast("array<string>")


def _unless(fine: Column, path: Column) -> Column:
    return F.when(F.coalesce(fine, F.lit(False)), _none()).otherwise(F.array(path))


def _is(v: Column, kinds: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).rlike(f"^({kinds})"), F.lit(False))


def _text(v: Column) -> Column:
    return F.when(_is(v, "STRING"), F.try_variant_get(v, "$", "string"))


def number() -> Rule:
    return lambda v, path: _unless(_is(v, "BIGINT|DOUBLE|DECIMAL"), path)


def flag() -> Rule:
    return lambda v, path: _unless(_is(v, "BOOLEAN"), path)


def text(most: int | None = None, least: int = 0, starts: str = "") -> Rule:
    def rule(v: Column, path: Column) -> Column:
        s = _text(v)
        fine = (F.length(s) >= least) & s.startswith(starts)
        return _unless(fine & (F.length(s) <= most) if most is not None else fine, path)

    return rule


def one_of(*values: str) -> Rule:
    return lambda v, path: _unless(_text(v).isin(*values), path)


def maybe(rule: Rule) -> Rule:
    """The rule where something is there; a JSON null is something."""
    return lambda v, path: F.when(v.isNull(), _none()).otherwise(rule(v, path))


def either(null: bool, rule: Rule) -> Rule:
    """The rule, or a JSON null where ``null`` is set."""
    return lambda v, path: F.when(F.coalesce(F.is_variant_null(v), F.lit(False)) & F.lit(null), _none()).otherwise(rule(v, path))


def obj(**fields: Rule) -> Rule:
    """An object whose fields keep their rules; others are ignored."""

    def rule(v: Column, path: Column) -> Column:
        own = [f(F.try_variant_get(v, f"$.{name}", "variant"), F.concat(path, F.lit(f".{name}"))) for name, f in fields.items()]
        return F.when(_is(v, "OBJECT"), F.concat(*own)).otherwise(F.array(path))

    return rule


def record(keys: tuple[str, ...], each_rule: Rule, every: bool = True) -> Rule:
    """An object with these keys only, all of them if ``every``."""

    def rule(v: Column, path: Column) -> Column:
        own = obj(**{k: each_rule if every else maybe(each_rule) for k in keys})(v, path)
        others = F.filter(F.map_keys(F.try_variant_get(v, "$", "map<string, variant>")), lambda k: ~k.isin(*keys))
        return F.concat(own, F.coalesce(F.transform(others, lambda k: F.concat(path, F.lit("."), k)), _none()))

    return rule


def each(item: Rule, most: int | None = None, least: int = 0) -> Rule:
    """A list of at least ``least`` and at most ``most`` elements, each by the rule."""

    def rule(v: Column, path: Column) -> Column:
        items = F.try_variant_get(v, "$", "array<variant>")
        fits = F.size(items).between(least, most if most is not None else (1 << 31) - 1)
        own = F.flatten(F.transform(items, lambda x, i: item(x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))))
        return F.when(~_is(v, "ARRAY"), F.array(path)).otherwise(F.concat(_unless(fits, path), own))

    return rule


# The documents' fields, bounds and enums.
TEAM, ZONES, PATTERNS, ENDINGS = ("A", "B"), ("net", "transition", "baseline"), ("net", "mid", "back", "staggered", "split"), ("winner", "forced", "unforced")
_numbers = lambda *names: {n: number() for n in names}
_pair = obj(A=number(), B=number())
SUMMARY = obj(
    **_numbers("durationSeconds", "rallies", "avgRallyShots"),
    calibrated=flag(),
    players=each(
        obj(
            **_numbers("playerId", "distanceMeters", "avgSpeed", "maxSpeed", "trackedSeconds", "totalShots", "avgSwingSpeed", "avgNetDistance"),
            label=text(), name=maybe(text(60)), isMe=maybe(flag()), team=one_of(*TEAM), dominantHand=one_of("left", "right"),
            zoneShare=obj(**_numbers(*ZONES)), shots=record(SHOT_TYPES, number()),
        )
    ),
    points=maybe(obj(tagged=number(), score=_pair, byPattern=record(TEAM, record(PATTERNS, obj(**_numbers("won", "played")), False)))),
    goals=maybe(each(obj(goal=text(120), value=maybe(text(40)), met=maybe(flag())), 10)),
    score=maybe(
        obj(
            sets=each(_pair, 10), currentGame=obj(A=text(4), B=text(4)), goldenPoint=flag(),
            breakPoints=record(TEAM, obj(**_numbers("won", "chances"))), serviceGamesHeld=record(TEAM, obj(**_numbers("won", "played"))),
        )
    ),
    teams=maybe(each(obj(team=one_of(*TEAM), **_numbers("pairedSeconds", "togetherNet", "togetherMid", "togetherBack", "staggered", "split", "avgSpacing", "avgDepthGap", "avgLateralGap", "netTakings")), 2)),
    shots=each(obj(t=number(), playerId=number(), type=one_of(*SHOT_TYPES), zone=one_of(*ZONES), swingSpeed=number(), **{n: maybe(flag()) for n in ("confirmed", "lob", "edited", "heard")}), 2000),
)
REQUEST = obj(
    summary=SUMMARY,
    keyframes=each(obj(t=number(), caption=text(200), image=text(starts="data:image/jpeg;base64,")), 8),
    context=maybe(obj(level=maybe(text(60)), focus=maybe(text(500)))),
)
_texts = each(text())
REPORT = obj(
    headline=text(), summary=text(), caveats=_texts,
    players=each(obj(playerId=number(), strengths=_texts, improvements=_texts, drills=each(obj(name=text(), description=text())))),
    teamTactics=each(obj(team=one_of(*TEAM), observations=_texts)), keyMoments=each(obj(t=number(), title=text(), observation=text())),
)


def _message(v: Column, path: Column) -> Column:
    """The user's messages are shorter than the answers may be."""
    role = _text(F.try_variant_get(v, "$.role", "variant"))
    return F.when(role == "assistant", obj(content=text(40_000, 1))(v, path)).otherwise(obj(role=one_of("user"), content=text(4_000, 1))(v, path))


CHAT = obj(summary=SUMMARY, report=either(True, REPORT), messages=each(_message, 40, 1))


def problems(docs: DataFrame, rule: Rule, column: str = "document") -> DataFrame:
    """Adds ``problems``: the paths of a JSON text that break the rule, from ``$`` for the whole; ``$`` alone where it is no JSON or null."""
    parsed = docs.withColumn("__v", F.try_parse_json(column))
    return parsed.withColumn("problems", F.array_distinct(rule(F.col("__v"), F.lit("$")))).drop("__v")
