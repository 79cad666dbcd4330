"""Static dimensions: motion presets and facing directions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# State name, frames, frames a second, whether it loops; by category, in catalog order.
PRESETS = """
# Basics
idle 4 6 loop
idle-combat 4 8 loop
walk 6 10 loop
run 6 12 loop
sprint 6 14 loop
jump 5 10 once
fall 4 10 loop
land 4 12 once
crouch 4 8 once
crawl 6 8 loop
climb 6 8 loop
swim 6 8 loop
dash 4 14 once
roll 5 14 once
slide 4 12 once
sit 4 8 once
sleep 4 4 loop
turn 4 10 once
# Combat
attack 5 12 once
attack-heavy 6 10 once
combo 6 14 once
slash 5 14 once
stab 4 14 once
punch 4 14 once
kick 5 14 once
uppercut 4 14 once
block 3 10 loop
parry 4 16 once
dodge 4 16 once
backstep 4 14 once
shoot 4 14 once
reload 5 10 once
aim 3 10 loop
throw 5 12 once
charge-attack 6 12 once
spin-attack 6 14 once
guard-break 4 12 once
counter 5 14 once
taunt 4 8 loop
draw-weapon 5 10 once
# Magic & Skills
cast 5 12 once
cast-fire 6 12 once
cast-ice 6 10 once
cast-lightning 5 14 once
cast-heal 5 8 once
summon 5 10 once
channel 4 8 loop
buff 4 10 once
shield-up 4 10 once
teleport 5 14 once
transform 6 10 once
power-up 5 10 loop
meditate 4 4 loop
explode 5 16 once
# Damage & Status
hurt 3 10 once
hurt-heavy 4 10 once
knockback 4 12 once
knockdown 4 10 once
get-up 5 8 once
stun 4 8 loop
dizzy 4 8 loop
frozen 3 6 loop
burning 4 12 loop
poisoned 4 6 loop
stagger 4 10 once
death 5 8 once
death-fall 4 8 once
revive 6 8 once
low-hp 4 6 loop
defeat 4 8 once
# Emotion
wave 4 8 loop
cheer 4 10 loop
clap 4 10 loop
bow 4 8 once
nod 3 8 once
shake-head 4 8 once
laugh 4 8 loop
cry 4 6 loop
angry 4 8 loop
surprised 3 12 once
think 4 6 loop
point 4 10 once
salute 4 8 once
dance 6 10 loop
victory 4 8 loop
sad 4 4 loop
scared 4 8 loop
yawn 4 6 once
# Interaction
pick-up 4 10 once
carry 6 8 loop
push 6 8 loop
pull 6 8 loop
open 4 10 once
eat 4 8 once
drink 4 8 once
read 4 6 loop
dig 6 8 loop
mine 6 10 loop
chop 6 10 loop
fish 5 6 loop
"""
# Key, short name, the direction it mirrors, row and column of a 3 x 3 grid.
DIRECTIONS = [
    ("north-west", "NW", "north-east", 0, 0), ("north", "N", None, 0, 1), ("north-east", "NE", None, 0, 2), ("west", "W", "east", 1, 0),
    ("east", "E", None, 1, 2), ("south-west", "SW", "south-east", 2, 0), ("south", "S", None, 2, 1), ("south-east", "SE", None, 2, 2),
]


def preset_rows() -> list[tuple[int, str, str, int, int, bool]]:
    """(ord, name, category, frames, fps, loop)."""
    out, category = [], ""
    for line in PRESETS.strip().splitlines():
        if line.startswith("#"):
            category = line[2:]
        else:
            name, frames, fps, loop = line.split()
            out.append((len(out), name, category, int(frames), int(fps), loop == "loop"))
    return out


def presets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(preset_rows(), "ord int, name string, category string, frames int, fps int, loop boolean")


# What follows a state's name and comes first in its label; labels that are not made by the rule.
QUALIFIERS = ["combat", "heavy", "fire", "ice", "lightning", "heal"]
LABELS = {"death-fall": "Falling Death", "low-hp": "Low HP"}


def label(name: str) -> str:
    """A state's name for display: words capitalised, a qualifier first."""
    parts = name.split("-")
    if len(parts) == 2 and parts[1] in QUALIFIERS:
        parts.reverse()
    return LABELS.get(name) or " ".join(p.capitalize() for p in parts)


def found_presets(query: Column) -> Column:
    """array of names, in catalog order, whose name, label or category holds the trimmed words in any case; blank finds all, null none.

    The catalog is a constant of the expression: nothing is joined.
    """
    q = F.lower(F.trim(query))
    rows = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(f"{name}\n{label(name)}\n{category}".lower()).alias("words")) for _, name, category, *_ in preset_rows()])
    return F.transform(F.filter(rows, lambda r: F.contains(r["words"], q)), lambda r: r["name"])


def directions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DIRECTIONS, "key string, short string, mirror_of string, row int, col int")


def base_state(name: Column) -> Column:
    """Lower-cased and trimmed, without one direction suffix; compound suffixes are tried first."""
    low = F.lower(F.trim(name))
    compound = r"-(north-west|north-east|south-west|south-east)$"
    return F.when(low.rlike(compound), F.regexp_replace(low, compound, "")).otherwise(F.regexp_replace(low, r"-(north|west|east|south)$", ""))


def with_preset(states: DataFrame, name: str = "state") -> DataFrame:
    """States beside their preset: by the whole name, else by the name without direction. The catalog is a fixed small table."""
    cat = presets(states.sparkSession).select(F.col("name").alias("k"), "category", "frames", "fps", "loop")
    key = F.lower(F.trim(F.col(name)))
    exact = F.broadcast(cat.select(F.col("k").alias("_e"), F.struct("k", "category", "frames", "fps", "loop").alias("_x")))
    base = F.broadcast(cat.select(F.col("k").alias("_b"), F.struct("k", "category", "frames", "fps", "loop").alias("_y")))
    rows = states.join(exact, key == F.col("_e"), "left").join(base, base_state(F.col(name)) == F.col("_b"), "left")
    found = F.coalesce("_x", "_y")
    return rows.select(*states.columns, found["k"].alias("preset"), found["category"].alias("category"), found["frames"].alias("frames"), found["fps"].alias("fps"), found["loop"].alias("loop"))


def search(spark: SparkSession, query: str) -> DataFrame:
    """Categories in catalog order with the names of their presets that the words are part of; blank finds all."""
    q = query.strip().lower()
    rows = presets(spark).where(F.lower("name").contains(q) | F.lower("category").contains(q)) if q else presets(spark)
    groups = rows.groupBy("category").agg(F.min("ord").alias("first"), F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda s: s["name"]).alias("names"))
    return groups.orderBy("first").select("category", "names")


# Directions in which a figure shows its back.
BACKS = ["north", "north-east", "north-west"]
# Services, what they are called, and the model that is taken where none is named.
SERVICES = [
    ("gemini", "Gemini", "gemini-3-pro-image"), ("openai", "OpenAI", "gpt-image-2"), ("openrouter", "OpenRouter", "google/gemini-3-pro-image-preview"),
    ("fal", "fal.ai", "fal-ai/nano-banana-pro"), ("byteplus", "BytePlus", "seedream-4-0-250828"), ("replicate", "Replicate", "google/nano-banana-2"),
]


def shows_back(direction: Column) -> Column:
    return F.coalesce(direction.isin(BACKS), F.lit(False))


def service(name: Column) -> Column:
    """struct(label, model) of a service; an unknown one is the first."""
    found = None
    for key, label, model in SERVICES[1:]:
        row = F.struct(F.lit(label).alias("label"), F.lit(model).alias("model"))
        found = F.when(name == key, row) if found is None else found.when(name == key, row)
    return found.otherwise(F.struct(F.lit(SERVICES[0][1]).alias("label"), F.lit(SERVICES[0][2]).alias("model")))
