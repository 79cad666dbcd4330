"""Settings in text files: KEY=VALUE lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def pairs_of(lines: DataFrame, column: str = "line", also: tuple[str, ...] = ()) -> DataFrame:
    """(also, key, value) of lines: blanks and # comments are skipped, ``export`` and quotes taken off, empty values dropped."""
    line = F.trim(F.col(column))
    rows = lines.select(*also, line.alias("line")).where("line <> '' AND NOT startswith(line, '#') AND contains(line, '=')")
    bare = F.when(F.col("line").startswith("export "), F.substr("line", F.lit(8))).otherwise(F.col("line"))
    parts = F.split(bare, "=", 2)
    rows = rows.select(*also, F.trim(parts[0]).alias("key"), F.regexp_replace(F.trim(parts[1]), "^[\"']+|[\"']+$", "").alias("value"))
    return rows.where("key <> '' AND value <> ''")


def read_env(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The pairs of several files; of a key that repeats, the one in the last path counts."""
    found = None
    for i, path in enumerate(paths):
        rows = pairs_of(spark.read.text(path).withColumnRenamed("value", "line")).withColumn("i", F.lit(i))
        found = rows if found is None else found.unionByName(rows)
    return found.groupBy("key").agg(F.max_by("value", "i").alias("value"))


def merged(pairs: DataFrame, order: str = "source") -> DataFrame:
    """(key, value) of (order, key, value): of a key the value of the first source in order that gives it one."""
    given = pairs.where("value IS NOT NULL AND trim(value) <> ''")
    return given.groupBy("key").agg(F.min_by("value", F.struct(order, "value")).alias("value"))


# Services in the order in which they are chosen, and the names that their keys have outside of saved settings, the first one first.
SERVICES = {
    "gemini": ["GEMINI_API_KEY", "GOOGLE_API_KEY"],
    "openai": ["OPENAI_API_KEY"],
    "openrouter": ["OPENROUTER_API_KEY"],
    "fal": ["FAL_KEY", "FAL_API_KEY"],
    "byteplus": ["BYTEPLUS_API_KEY", "ARK_API_KEY"],
    "replicate": ["REPLICATE_API_TOKEN", "REPLICATE_API_KEY"],
}


def loaded(saved: DataFrame, outside: DataFrame, owner: str = "owner", services: dict[str, list[str]] | None = None) -> DataFrame:
    """(owner, active, keys, models): every owner's services with a key, their models, and the service in use.

    ``saved`` (owner, name, value) are settings kept by dotted names (``openai.key``, ``openai.model``, ``service``), and perhaps the old ``key`` and
    ``model`` from when there was one service: they become the first service's, if that has no key of its own. ``outside`` (owner, layer, name, value)
    are pairs from files and the environment, of which the first layer with a value counts for a name. A service without a saved key takes the
    first of its names that has a value. In use is the service that was saved, else the first one with a key, else the first. Empty values are none.
    An owner is in the result if it is in either table; one row an owner, with one shuffle for both tables.
    """
    services = services or SERVICES
    first = next(iter(services))
    given = merged_by_owner(outside, owner).select(owner, F.concat(F.lit("env:"), F.col("key")).alias("name"), "value")
    kept = saved.where("trim(value) <> ''").groupBy(owner, "name").agg(F.max("value").alias("value"))
    every = saved.select(owner).unionByName(outside.select(owner)).select(owner, F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("value"))
    rows = kept.select(owner, "name", "value").unionByName(given).unionByName(every.distinct())
    whole = rows.groupBy(owner).agg(F.map_from_entries(F.filter(F.collect_list(F.struct("name", "value")), lambda e: e["name"].isNotNull())).alias("m"))
    get = lambda name: F.col("m")[F.lit(name)]
    own = {s: get(f"{s}.key") for s in services}
    moved = own[first].isNull() & get("key").isNotNull()
    keys = {s: F.coalesce(own[s], *([get("key")] if s == first else []), *(get(f"env:{n}") for n in names)) for s, names in services.items()}
    models = {s: F.when(moved & get("model").isNotNull(), get("model")).otherwise(get(f"{s}.model")) if s == first else get(f"{s}.model") for s in services}
    entries = lambda found: F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(s).alias("k"), c.alias("v")) for s, c in found.items()]), lambda e: e["v"].isNotNull()))
    active = F.coalesce(get("service"), *[F.when(keys[s].isNotNull(), F.lit(s)) for s in services], F.lit(first))
    return whole.select(owner, active.alias("active"), entries(keys).alias("keys"), entries(models).alias("models"))


def configured(settings: DataFrame, service: Column) -> Column:
    """struct(key, model) of a service; of one that is not known, the first one's."""
    known = F.when(service.isin(list(SERVICES)), service).otherwise(F.lit(next(iter(SERVICES))))
    return F.struct(settings["keys"][known].alias("key"), settings["models"][known].alias("model"))


def merged_by_owner(pairs: DataFrame, owner: str = "owner", order: str = "layer") -> DataFrame:
    """(owner, key, value) of (owner, order, name, value): of a name the value of the owner's first layer that gives it one."""
    given = pairs.where("value IS NOT NULL AND trim(value) <> ''")
    return given.groupBy(owner, F.col("name").alias("key")).agg(F.min_by("value", F.struct(order, "value")).alias("value"))


def save_session(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines, a session a line."""
    rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def load_session(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Saved sessions; a line that cannot be read is a row of nulls, and a path without files has no rows."""
    return spark.read.text(path).select(F.from_json("value", schema).alias("s")).select("s.*")
