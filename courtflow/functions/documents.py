"""JSON documents as columns: checks of requests, clean-up of loosely shaped reports, prompt texts, goal texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtflow.functions.text import SHOT_TYPES

_SHARES = "struct<net:double,transition:double,baseline:double>"
SUMMARY = (
    "struct<durationSeconds:double,calibrated:boolean,rallies:double,avgRallyShots:double,"
    f"players:array<struct<playerId:int,label:string,name:string,team:string,distanceMeters:double,avgSpeed:double,maxSpeed:double,trackedSeconds:double,zoneShare:{_SHARES},"
    "shots:map<string,double>,totalShots:double,avgSwingSpeed:double,dominantHand:string,avgNetDistance:double>>,"
    "goals:array<struct<goal:string,value:string,met:boolean>>,"
    "teams:array<struct<team:string,pairedSeconds:double,togetherNet:double,split:double>>,"
    "shots:array<struct<t:double,playerId:int,type:string,zone:string,swingSpeed:double>>>"
)
REQUEST = f"struct<summary:{SUMMARY},keyframes:array<struct<t:double,caption:string,image:string>>,context:struct<level:string,focus:string>>"
REPORT = (
    "struct<headline:string,summary:string,players:array<struct<playerId:int,strengths:array<string>,improvements:array<string>,drills:array<struct<name:string,description:string>>>>,"
    "teamTactics:array<struct<team:string,observations:array<string>>>,keyMoments:array<struct<t:double,title:string,observation:string>>,caveats:array<string>>"
)
CHAT = f"struct<summary:{SUMMARY},report:{REPORT},messages:array<struct<role:string,content:string>>>"


def _all(of: Column, check) -> Column:
    """Whether a check holds for every element; missing arrays pass."""
    return F.coalesce(F.forall(of, lambda x: F.coalesce(check(x), F.lit(False))), F.lit(True))


def _short(text: Column, most: int) -> Column:
    return text.isNull() | (F.length(text) <= most)


def _few(of: Column, most: int) -> Column:
    return F.coalesce(F.size(of), F.lit(0)).between(0, most) | of.isNull()


def valid_summary(s: Column) -> Column:
    """Required numbers, known enums and bounded lists of a match summary."""
    numbers = F.lit(True)
    for c in ("durationSeconds", "calibrated", "rallies", "avgRallyShots"):
        numbers = numbers & s[c].isNotNull()
    player = lambda p: p["playerId"].isNotNull() & p["label"].isNotNull() & p["team"].isin("A", "B") & p["dominantHand"].isin("left", "right") & _short(p["name"], 60) & _all(F.map_keys(p["shots"]), lambda k: k.isin(*SHOT_TYPES))
    shot = lambda x: x["t"].isNotNull() & x["type"].isin(*SHOT_TYPES) & x["zone"].isin("net", "transition", "baseline")
    goal = lambda x: x["goal"].isNotNull() & _short(x["goal"], 120) & _short(x["value"], 40)
    lists = s["players"].isNotNull() & s["shots"].isNotNull() & _few(s["shots"], 2000) & _few(s["teams"], 2) & _few(s["goals"], 10)
    checks = _all(s["players"], player) & _all(s["shots"], shot) & _all(s["teams"], lambda t: t["team"].isin("A", "B")) & _all(s["goals"], goal)
    return F.coalesce(s.isNotNull() & numbers & lists & checks, F.lit(False))


def requests(docs: DataFrame, column: str = "document") -> DataFrame:
    """Adds ``request`` (parsed) and ``valid`` to rows with a coach request as JSON; malformed text isn't valid."""
    parsed = docs.withColumn("request", F.from_json(column, REQUEST))
    r = F.col("request")
    frame = lambda k: k["t"].isNotNull() & k["caption"].isNotNull() & _short(k["caption"], 200) & k["image"].startswith("data:image/jpeg;base64,")
    frames = r["keyframes"].isNotNull() & _few(r["keyframes"], 8) & _all(r["keyframes"], frame)
    context = _short(r["context"]["level"], 60) & _short(r["context"]["focus"], 500)
    return parsed.withColumn("valid", valid_summary(r["summary"]) & F.coalesce(frames & context, F.lit(False)))


def chats(docs: DataFrame, column: str = "document") -> DataFrame:
    """Adds ``chat`` and ``valid``: one to forty messages, the user's shorter than the answers may be."""
    parsed = docs.withColumn("chat", F.from_json(column, CHAT))
    m = F.col("chat.messages")
    longest = lambda x: F.when(x["role"] == "user", 4000).when(x["role"] == "assistant", 40000)
    fine = m.isNotNull() & F.size(m).between(1, 40) & _all(m, lambda x: F.length(x["content"]).between(F.lit(1), longest(x)))
    return parsed.withColumn("valid", valid_summary(F.col("chat.summary")) & F.coalesce(fine, F.lit(False)))


def normalised_reports(docs: DataFrame, column: str = "document") -> DataFrame:
    """Adds ``report``: what is well formed of a loosely shaped report; null without a headline or a summary.

    Every part is parsed by itself from its own JSON text, so one malformed part doesn't cost the others.
    """
    some = lambda of: F.coalesce(F.array_compact(of), F.array().cast("array<string>"))
    texts = lambda raw: some(F.transform(F.from_json(raw, "array<string>"), lambda x: x))
    # elements are parsed one by one, so that a malformed one doesn't cost the others
    each = lambda raw, fields: F.coalesce(F.transform(F.from_json(raw, "array<string>"), lambda x: F.from_json(x, ",".join(f"{f} string" for f in fields))), F.from_json(F.lit("[]"), f"array<struct<{','.join(f'{f}:string' for f in fields)}>>"))
    items = lambda name, fields: each(F.get_json_object(column, f"$.{name}"), fields)
    whole = lambda x: x.rlike(r"^-?[0-9]+$")
    players = F.transform(
        F.filter(items("players", ("playerId", "strengths", "improvements", "drills")), lambda p: whole(p["playerId"])),
        lambda p: F.struct(
            p["playerId"].cast("int").alias("playerId"), texts(p["strengths"]).alias("strengths"), texts(p["improvements"]).alias("improvements"),
            F.transform(F.filter(each(p["drills"], ("name", "description")), lambda d: d["name"].isNotNull()), lambda d: F.struct(d["name"].alias("name"), F.coalesce(d["description"], F.lit("")).alias("description"))).alias("drills"),
        ),
    )
    tactics = F.transform(F.filter(items("teamTactics", ("team", "observations")), lambda t: t["team"].isin("A", "B")), lambda t: F.struct(t["team"].alias("team"), texts(t["observations"]).alias("observations")))
    number = lambda x: x.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?$")
    moments = F.transform(
        F.filter(items("keyMoments", ("t", "title", "observation")), lambda k: number(k["t"]) & k["title"].isNotNull()),
        lambda k: F.struct(k["t"].cast("double").alias("t"), k["title"].alias("title"), F.coalesce(k["observation"], F.lit("")).alias("observation")),
    )
    headline, summary = F.get_json_object(column, "$.headline"), F.get_json_object(column, "$.summary")
    report = F.struct(headline.alias("headline"), summary.alias("summary"), players.alias("players"), tactics.alias("teamTactics"), moments.alias("keyMoments"), texts(F.get_json_object(column, "$.caveats")).alias("caveats"))
    return docs.withColumn("report", F.when(headline.isNotNull() & summary.isNotNull(), report))


def prompt_text(summary: Column, level: Column, focus: Column, captions: Column) -> Column:
    """The text of a request: summary, what the player wants, captions of the pictures; missing parts are left out."""
    return F.concat_ws(
        "\n\n",
        F.concat(F.lit("Match summary:\n"), summary), F.concat(F.lit("Level: "), level), F.concat(F.lit("Focus: "), focus),
        F.when(F.size(captions) > 0, F.concat(F.lit("Pictures:\n"), F.array_join(captions, "\n"))),
    )


# The goals' names and units.
GOAL_TEXTS = {
    "split": ("Pair split", "%"), "netTogether": ("Together at the net", "%"), "netTime": ("My time at the net", "%"), "unforced": ("My unforced errors", ""),
    "winners": ("My winners", ""), "breakPoints": ("Break points converted", "%"), "distance": ("Meters covered per minute", "m/min"),
}


def goal_value(metric: Column, value: Column) -> Column:
    """A goal's value with its unit: whole for shares and metres a minute, one decimal else."""
    unit = F.element_at(F.create_map(*[F.lit(x) for k, (_, u) in GOAL_TEXTS.items() for x in (k, u)]), metric)
    whole, tenth = F.floor(value + 0.5).cast("string"), F.floor(value * 10 + 0.5) / 10
    plain = F.when(tenth == F.floor(tenth), F.floor(tenth).cast("string")).otherwise(tenth.cast("string"))
    return F.when(unit == "%", F.concat(whole, F.lit("%"))).when(unit == "m/min", F.concat(whole, F.lit(" m/min"))).otherwise(plain)


def goal_text(metric: Column, target: Column, at_most: Column) -> Column:
    """A goal in words: its name, the direction and the target."""
    label = F.element_at(F.create_map(*[F.lit(x) for k, (n, _) in GOAL_TEXTS.items() for x in (k, n)]), metric)
    return F.concat_ws(" ", label, F.when(at_most, "≤").otherwise("≥"), goal_value(metric, target))
