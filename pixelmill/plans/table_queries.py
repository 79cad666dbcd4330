"""Registered queries over the other tables: catalog and text helpers, attempts, reports, profiles of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import session
from ..functions import catalog, text
from ..operators import corpus, profile
from ..streaming import live
from ..sources.settings import configured, load_session, loaded, merged, pairs_of, save_session

STATES = [row[1] for row in catalog.preset_rows()]
DIRECTIONS_ = [d[0] for d in catalog.DIRECTIONS]
PERSPECTIVES = ["iso", " ISO ", "flat", "", None]
ANSWERS = ['"one"', '["two", "three"]', "[]", '{"q": 1}', "", ' "four" ', "[1]"]
SERVICE_NAMES = [*(row[0] for row in catalog.SERVICES), "unknown"]
RANGE = 4096
SUFFIXES = ["", *(f"-{d[0]}" for d in catalog.DIRECTIONS), "-up"]


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _r6(column):
    return F.round(column, 6)


def _states(spark, sf):
    names, suffixes = (F.array(*[F.lit(v) for v in values]) for values in (STATES, SUFFIXES))
    state = F.concat(F.lit("  "), F.upper(names[(F.col("p_partkey") % len(STATES)).cast("int")]), suffixes[(F.col("p_partkey") % len(SUFFIXES)).cast("int")])
    return _read(spark, sf, "part").select("p_partkey", state.alias("state"))


def base_state_name(spark, sf):
    return _states(spark, sf).select("p_partkey", catalog.base_state(F.col("state")).alias("base"))


def preset_lookup_fallback(spark, sf):
    return catalog.with_preset(_states(spark, sf)).drop("state")


def preset_search(spark, sf):
    """What a search for the second and third letter of each part's name finds in the catalog, a row a search."""
    words = _read(spark, sf, "part").select(F.substring(F.upper("p_name"), 2, 2).alias("query")).groupBy("query").agg(F.count("*").alias("searches"))
    found = words.withColumn("names", catalog.found_presets(F.col("query")))
    return found.select("query", "searches", F.size("names").cast("bigint").alias("n"), F.array_join("names", ",").alias("names"))


def sanitize_name(spark, sf):
    c = _read(spark, sf, "customer")
    raw = F.concat(F.lit(" #"), F.col("c_name"), F.lit(" / "), F.col("c_mktsegment"), F.lit("!"))
    return c.select("c_custkey", text.sanitized(raw).alias("stem"), text.sanitized_strip(raw).alias("strip"), text.masked(F.col("c_name")).alias("masked"))


def aspect_for_frames(spark, sf):
    p = _read(spark, sf, "part").select("p_partkey", (F.col("p_size") % 13).cast("int").alias("n"))
    rows = p.withColumn("aspect", text.aspect(F.col("n"))).withColumn("g", text.grid(F.col("n")))
    a = F.col("aspect")
    return rows.select("p_partkey", "n", "g.rows", "g.cols", "aspect", text.fitted_size(a).alias("fitted"), text.strip_size(a).alias("strip"), text.snapped_aspect(a).alias("snapped"))


def first_n_per_category(spark, sf):
    return corpus.first_per_group(_read(spark, sf, "part").select("p_type", "p_name", "p_partkey"), "p_type", ["p_name", "p_partkey"], 3)


def _attempts(spark, sf):
    return _tries(_read(spark, sf, "lineitem"))


def _tries(li):
    return li.select(
        F.col("l_orderkey").alias("state"), F.col("l_linenumber").alias("attempt"), F.lit(4).alias("expected"), (F.lit(2) + F.col("l_quantity").cast("int") % 4).alias("found"), (F.col("l_partkey") % 3).cast("int").alias("n_errors"),
    )


def best_attempt(spark, sf):
    return corpus.best_attempts(_attempts(spark, sf))


def quality_report_rollup(spark, sf):
    o = _read(spark, sf, "orders").select(F.col("o_orderkey").alias("state"), F.col("o_orderpriority").alias("category"), (F.col("o_custkey") % 101).alias("score"), (F.col("o_custkey") % 50 / 1000).alias("motion"))
    return corpus.quality_report(corpus.best_attempts(_attempts(spark, sf)).join(o, "state"))


def settings_pairs(spark, sf):
    """Lines of all documents read as settings: key, value and how often they stand."""
    lines = _read(spark, sf, "documents").select(F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))
    return pairs_of(lines).groupBy("key", "value").agg(F.count("*").alias("n"))


def event_minute_runs(spark, sf):
    """Stretches of busy minutes of the day of each kind of event, found as figures in a strip are: smoothing, islands, minor runs dropped."""
    e = _read(spark, sf, "events").select("event_type", F.expr("cast(hour(ts) * 60 + minute(ts) as int)").alias("pos"))
    counted = e.groupBy(F.col("event_type").alias("image_id"), "pos").agg(F.count("*").cast("double").alias("mass"))
    return profile.runs(profile.smoothed(profile.filled(counted, 0, 1439), 9), 4).select(F.col("image_id").alias("event_type"), "x0", "x1", _r6("mass").alias("mass"))


def lineitem_centroid(spark, sf):
    li = _read(spark, sf, "lineitem")
    return li.groupBy("l_suppkey").agg(_r6(F.sum(F.col("l_linenumber") * F.col("l_quantity")) / F.sum("l_quantity")).alias("centre"), F.count("*").alias("n"))


def embedding_neighbours(spark, sf):
    """Mean absolute change from each vector to the next one of its label.

    Vectors are compared inside ranges of ids; of each range only the first and last vectors meet those of its neighbours, so no
    label is a task of its own.
    """
    e = _read(spark, sf, "embeddings").select("label", "vec_id", "embedding", F.floor(F.col("vec_id") / RANGE).alias("part"))
    inside = e.select("label", "embedding", F.lag("embedding").over(Window.partitionBy("label", "part").orderBy("vec_id")).alias("before"))
    edges = e.groupBy("label", "part").agg(F.min_by("embedding", "vec_id").alias("embedding"), F.max_by("embedding", "vec_id").alias("last"))
    across = edges.select("label", "embedding", F.lag("last").over(Window.partitionBy("label").orderBy("part")).alias("before"))
    pairs = inside.unionByName(across).where("before IS NOT NULL")
    d = F.aggregate(F.zip_with("embedding", "before", lambda a, b: F.abs(a.cast("double") - b.cast("double"))), F.lit(0.0), lambda s, v: s + v) / F.size("embedding")
    return pairs.groupBy("label").agg(_r6(F.avg(d)).alias("change"), F.count("*").alias("n"))


def report_by_source(spark, sf):
    """Documents by source: number, characters, the largest few are a top list by characters."""
    d = _read(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.countDistinct("lang").alias("langs"))
    return d.orderBy(F.desc("chars"), "source").limit(8)


def facing_words(spark, sf):
    """Words of a request by direction and perspective."""
    directions, views = (F.array(*[F.lit(v) for v in values]) for values in (DIRECTIONS_, PERSPECTIVES))
    answers = F.array(*[F.lit(v) for v in ANSWERS])
    k = F.col("p_partkey")
    rows = _read(spark, sf, "part").select(
        "p_partkey", (F.col("p_size") % 13).cast("int").alias("n"), directions[(k % len(DIRECTIONS_)).cast("int")].alias("direction"), views[(k % len(PERSPECTIVES)).cast("int")].alias("perspective"),
        answers[(k % len(ANSWERS)).cast("int")].alias("answer"), F.concat(F.lit("a {view} of "), F.col("p_name"), F.lit(" facing right, at eye level")).alias("words"), "p_type",
    )
    words, iso = text.with_view(F.col("words"), F.col("perspective")), text.is_iso(F.col("perspective"))
    style = text.style_of(F.col("direction"), F.when(k % 3 == 0, F.concat(F.lit(" "), F.col("p_type"))), {"north": "flat sprite", "south": "soft paint", "pixel": "true pixels"})
    return rows.select(
        "p_partkey", catalog.shows_back(F.col("direction")).alias("back"), F.when(catalog.shows_back(F.col("direction")), text.without_phrases(words, text.TURNED)).otherwise(words).alias("turned"),
        F.when(iso, text.without_phrases(words, text.FLAT)).otherwise(words).alias("tilted"), text.spare_cells(F.col("n")).alias("spare"), text.canvas_words(text.aspect(F.col("n"))).alias("canvas"),
        text.first_output(F.col("answer")).alias("output"), style.alias("style"), text.wants_pixels(style).alias("pixels"),
    )


def service_models(spark, sf):
    names = F.array(*[F.lit(v) for v in SERVICE_NAMES])
    c = _read(spark, sf, "customer").select(catalog.service(names[(F.col("c_custkey") % len(SERVICE_NAMES)).cast("int")]).alias("s"))
    return c.groupBy("s.label", "s.model").agg(F.count("*").alias("n"))


def event_stamps(spark, sf):
    e = _read(spark, sf, "events")
    return e.select("event_id", text.stamp(F.col("ts"), F.col("event_id")).alias("stamp"))


def settings_merged(spark, sf):
    """Settings in the documents of all sources: of a key the first source that has it decides."""
    lines = _read(spark, sf, "documents").select(F.coalesce("source", F.lit("")).alias("source"), F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))
    return merged(pairs_of(lines, also=("source",)))


def session_round_trip(spark, sf):
    """Conversations saved as sessions in the shared folder and loaded again."""
    rows = _read(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    path = session.shared_path(spark, "sessions")
    save_session(rows, path)
    return load_session(spark, path, ", ".join(f"{n} {k}" for n, k in rows.dtypes))


def roster_report(spark, sf):
    tries = _attempts(spark, sf).withColumn("character", F.expr("state % 100"))
    return corpus.roster(corpus.best_attempts(tries, ("character", "state")), "character")


def gallery_cards(spark, sf):
    return corpus.gallery(corpus.best_attempts(_attempts(spark, sf)))


def report_change(spark, sf):
    """The report of even orders beside that of odd ones."""
    o = _read(spark, sf, "orders").select(F.col("o_orderkey").alias("state"), F.col("o_orderpriority").alias("category"), (F.col("o_custkey") % 101).alias("score"), (F.col("o_custkey") % 50 / 1000).alias("motion"))
    best = corpus.best_attempts(_attempts(spark, sf)).join(o, "state")
    now, before = (corpus.quality_report(best.where(F.col("state") % 2 == i)).where("category IS NOT NULL") for i in (0, 1))
    return corpus.compared(now, before, ["category"], ["total", "passed", "pass_rate"]).withColumn("pass_rate_change", _r6("pass_rate_change"))


def named_states(spark, sf):
    """States asked for by name: those that the parts' presets have, and those that none has."""
    presets = catalog.with_preset(_states(spark, sf)).where("preset IS NOT NULL").select("preset").distinct()
    kept, missing = corpus.named_selection(presets, "preset", [" Idle", "WALK", "attack", "no such state", "", "zz"])
    return kept.select(F.col("preset").alias("name"), F.lit(True).alias("known")).unionByName(missing.select(F.col("asked").alias("name"), F.lit(False).alias("known")))


def settings_loaded(spark, sf):
    """Customers' settings, saved and from outside: the service in use and its key and model."""
    c = _read(spark, sf, "customer").select(F.col("c_custkey").alias("owner"), "c_name", F.concat(F.lit("key-"), F.col("c_nationkey").cast("string")).alias("secret"), "c_mktsegment")
    name = lambda text, when: F.when(F.expr(when), F.lit(text))
    pair = lambda n, v: F.struct(n.alias("name"), v.cast("string").alias("value"))
    saved = c.select("owner", F.inline(F.array(
        pair(name("gemini.key", "owner % 5 = 0"), F.col("secret")), pair(name("key", "owner % 4 = 0"), F.col("c_name")), pair(name("model", "owner % 8 = 0"), F.lit("old-model")), pair(name("openai.key", "owner % 7 = 0"), F.col("c_name")),
        pair(name("openai.model", "owner % 14 = 0"), F.col("c_mktsegment")), pair(name("service", "owner % 11 = 0"), F.lit("fal")), pair(name("fal.key", "owner % 3 = 0"), F.lit("  ")),
    ))).where("name IS NOT NULL")
    layered = lambda k, n, v: F.struct(F.lit(k).alias("layer"), n.alias("name"), v.cast("string").alias("value"))
    outside = c.select("owner", F.inline(F.array(
        layered(1, name("FAL_API_KEY", "owner % 2 = 0"), F.col("secret")), layered(2, name("FAL_API_KEY", "owner % 2 = 0"), F.lit("later")), layered(2, name("FAL_KEY", "owner % 6 = 0"), F.col("c_name")),
        layered(1, name("GOOGLE_API_KEY", "owner % 9 = 1"), F.col("secret")), layered(1, name("REPLICATE_API_TOKEN", "owner % 13 = 2"), F.lit("")), layered(2, name("REPLICATE_API_TOKEN", "owner % 13 = 2"), F.col("c_name")),
    ))).where("name IS NOT NULL")
    found = loaded(saved, outside)
    return found.select("owner", "active", configured(found, F.col("active")).alias("c"), F.size("keys").alias("n_keys")).select("owner", "active", "c.key", "c.model", "n_keys")


def best_attempt_stream(spark, sf):
    """The best attempts as a stream of them leaves them."""
    kind = _read(spark, sf, "lineitem").schema
    read = spark.readStream.schema(kind).option("maxFilesPerTrigger", 4).parquet(f"{sf}/lineitem.parque[t]")
    updates = live.best_so_far(_tries(read))
    return live.run_to_table(updates, session.shared_path(spark, "stream")).withColumn("status", corpus.status()).drop("closed")


_NAMED = (base_state_name, preset_lookup_fallback, preset_search, sanitize_name, aspect_for_frames, first_n_per_category, best_attempt, quality_report_rollup, settings_pairs, event_minute_runs, lineitem_centroid, embedding_neighbours, report_by_source,
          facing_words, service_models, event_stamps, settings_merged, session_round_trip, roster_report, gallery_cards, report_change, named_states, settings_loaded, best_attempt_stream)
QUERIES = {f.__name__: f for f in _NAMED}

_LIST = "[" + ", ".join(f"'{s}'" for s in STATES) + "]"
_ENDS = "[" + ", ".join(f"'{s}'" for s in SUFFIXES) + "]"
_CATALOG = "cat(name, category, frames, fps, loop) AS (VALUES " + ", ".join(f"('{n}', '{c}', {f}, {p}, {str(lp).lower()})" for _, n, c, f, p, lp in catalog.preset_rows()) + ")"
_STATE = f"st AS (SELECT p_partkey, trim(lower('  ' || upper({_LIST}[p_partkey % {len(STATES)} + 1]) || {_ENDS}[p_partkey % {len(SUFFIXES)} + 1])) AS state FROM part)"
_BASED = _STATE + """, ba AS (SELECT *, CASE WHEN regexp_matches(state, '-(north|south)-(west|east)$') THEN regexp_replace(state, '-(north|south)-(west|east)$', '') ELSE regexp_replace(state, '-(north|west|east|south)$', '') END AS base FROM st)"""
_BEST = """tries AS (SELECT l_orderkey AS state, l_linenumber AS attempt, 4 AS expected, 2 + cast(trunc(l_quantity) AS int) % 4 AS found, cast(l_partkey % 3 AS int) AS n_errors FROM lineitem),
ba AS (SELECT *, CASE WHEN found = expected AND n_errors = 0 THEN 1 ELSE 0 END AS p FROM tries),
be AS (SELECT * FROM ba QUALIFY row_number() OVER (PARTITION BY state ORDER BY p DESC, CASE WHEN p = 1 THEN 0 ELSE found * 100 - n_errors * 10 END DESC, attempt) = 1),
bs AS (SELECT state, attempt, expected, found, n_errors, CASE WHEN p = 1 THEN 'ok' WHEN found <> expected THEN 'frames' ELSE 'quality' END AS status FROM be)"""

ORACLES = {
    "base_state_name": f"WITH {_BASED} SELECT p_partkey, base FROM ba",
    "preset_lookup_fallback": f"WITH {_CATALOG}, {_BASED} SELECT p_partkey, coalesce(x.name, y.name) AS preset, coalesce(x.category, y.category) AS category, coalesce(x.frames, y.frames) AS frames, coalesce(x.fps, y.fps) AS fps, coalesce(x.loop, y.loop) AS loop FROM ba LEFT JOIN cat x ON x.name = state LEFT JOIN cat y ON y.name = base",
    "preset_search": "WITH lab(ord, name, label, category) AS (VALUES " + ", ".join(f"({i}, '{n}', '{catalog.label(n)}', '{c}')" for i, n, c, *_ in catalog.preset_rows()) + """), q AS (SELECT upper(p_name)[2:3] AS query, count(*) AS searches FROM part GROUP BY ALL)
      SELECT query, searches, count(name) AS n, coalesce(string_agg(name, ',' ORDER BY ord), '') AS names FROM q LEFT JOIN lab ON contains(name, trim(lower(query))) OR contains(lower(label), trim(lower(query))) OR contains(lower(category), trim(lower(query))) GROUP BY query, searches""",
    "sanitize_name": """WITH c AS (SELECT c_custkey, c_name, ' #' || c_name || ' / ' || c_mktsegment || '!' AS raw FROM customer)
      SELECT c_custkey, coalesce(nullif(trim(regexp_replace(trim(raw), '[^a-zA-Z0-9가-힣_-]+', '-', 'g'), '-'), ''), 'character') AS stem, coalesce(nullif(regexp_replace(raw, '[^a-zA-Z0-9_-]', '-', 'g'), ''), 'strip') AS strip,
      CASE WHEN length(c_name) > 8 THEN left(c_name, 4) || '····' || right(c_name, 4) ELSE '' END AS masked FROM c""",
    "aspect_for_frames": """WITH p AS (SELECT p_partkey, p_size % 13 AS n FROM part), g AS (SELECT *, CASE WHEN greatest(n, 1) <= 3 THEN 1 ELSE 2 END AS rows, CASE WHEN greatest(n, 1) <= 3 THEN greatest(n, 1) ELSE (n + 1) // 2 END AS cols FROM p),
      a AS (SELECT *, CASE WHEN n <= 1 THEN 1 WHEN rows = 2 THEN cols // gcd(cols, 2) ELSE floor(least(4, greatest(16::double / 9, n * 0.6::double)) * 9 + 0.5::double)::int END AS w, CASE WHEN n <= 1 THEN 1 WHEN rows = 2 THEN 2 // gcd(cols, 2) ELSE 9 END AS h FROM g),
      e AS (SELECT *, greatest(w, h)::double AS hi, least(w, h)::double AS lo, least(4096, greatest(1792, floor(768 * greatest(w, h)::double / least(w, h) + 0.5::double)::int)) AS ed FROM a),
      t AS (SELECT *, greatest(1280, least(4096, floor(4096 * lo / hi)::int)) AS sd, greatest(640, ed) // 16 * 16 AS e1, greatest(640, floor(ed * lo / hi)::int) // 16 * 16 AS e2 FROM e)
      SELECT p_partkey, n, rows, cols::int AS cols, w || ':' || h AS aspect, CASE WHEN w >= h THEN '4096x' || sd ELSE sd || 'x4096' END AS fitted, CASE WHEN w = h THEN '1024x1024' WHEN w > h THEN e1 || 'x' || e2 ELSE e2 || 'x' || e1 END AS strip,
      CASE WHEN w::double / h >= 21::double / 9 THEN '21:9' WHEN w::double / h >= 16::double / 9 THEN '16:9' ELSE w || ':' || h END AS snapped FROM t""",
    "first_n_per_category": "SELECT p_type, p_name, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY p_name, p_partkey) <= 3",
    "best_attempt": f"WITH {_BEST} SELECT * FROM bs",
    "quality_report_rollup": f"""WITH {_BEST}, j AS (SELECT bs.*, o_orderpriority AS category, o_custkey % 101 AS score, (o_custkey % 50)::double / 1000 AS motion FROM bs JOIN orders ON o_orderkey = state)
      SELECT category, count(*) AS total, count(*) FILTER (status = 'ok') AS passed, count(*) FILTER (found <> expected) AS mismatched, count(*) FILTER (n_errors > 0) AS defects, round(avg((status = 'ok')::int), 6) AS pass_rate, round(avg(score), 6) AS mean_score,
      count(*) FILTER (motion < 0.02) AS static FROM j GROUP BY ROLLUP (category)""",
    "settings_pairs": r"""WITH l AS (SELECT trim(unnest(string_split(coalesce(text, ''), chr(10)))) AS line FROM documents), f AS (SELECT CASE WHEN starts_with(line, 'export ') THEN substr(line, 8) ELSE line END AS line FROM l WHERE line <> '' AND NOT starts_with(line, '#') AND contains(line, '=')),
      k AS (SELECT trim(substr(line, 1, strpos(line, '=') - 1)) AS key, trim(trim(substr(line, strpos(line, '=') + 1)), '"''') AS value FROM f) SELECT key, value, count(*) AS n FROM k WHERE key <> '' AND value <> '' GROUP BY ALL""",
    "event_minute_runs": """WITH o AS (SELECT event_type, cast(hour(ts) * 60 + minute(ts) AS int) AS pos, count(*)::double AS mass FROM events GROUP BY ALL),
      c AS (SELECT k.event_type, p AS pos, coalesce(mass, 0) AS mass FROM (SELECT DISTINCT event_type FROM events) k CROSS JOIN range(1440) r(p) LEFT JOIN o ON o.event_type IS NOT DISTINCT FROM k.event_type AND o.pos = p), m AS (SELECT event_type, pos, avg(mass) OVER (PARTITION BY event_type ORDER BY pos ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS mass FROM c),
      t AS (SELECT *, max(mass) OVER (PARTITION BY event_type) AS top FROM m), i AS (SELECT *, pos - row_number() OVER (PARTITION BY event_type ORDER BY pos) AS isl FROM t WHERE mass > 0.045::double * top),
      g AS (SELECT event_type, min(pos) AS x0, max(pos) + 1 AS x1, sum(mass) AS mass, max(mass) AS peak, any_value(top) AS top FROM i GROUP BY event_type, isl), k AS (SELECT *, max(mass) OVER (PARTITION BY event_type) AS most FROM g WHERE x1 - x0 >= 4 AND peak >= 0.18::double * top)
      SELECT event_type, x0, x1, round(mass, 6) AS mass FROM k WHERE mass >= most * 0.2::double""",
    "lineitem_centroid": "SELECT l_suppkey, round(sum(l_linenumber * l_quantity) / sum(l_quantity), 6) AS centre, count(*) AS n FROM lineitem GROUP BY ALL",
    "embedding_neighbours": """WITH e AS (SELECT label, embedding, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS before FROM embeddings),
      d AS (SELECT label, list_sum(list_transform(range(1, len(embedding) + 1), lambda i: abs(embedding[i]::double - before[i]::double))) / len(embedding) AS d FROM e WHERE before IS NOT NULL) SELECT label, round(avg(d), 6) AS change, count(*) AS n FROM d GROUP BY ALL""",
    "report_by_source": "SELECT source, count(*) AS n, sum(n_chars)::bigint AS chars, count(DISTINCT lang) AS langs FROM documents GROUP BY ALL ORDER BY chars DESC, source LIMIT 8",
}

_DIRS = "[" + ", ".join(f"'{d}'" for d in DIRECTIONS_) + "]"
_ANS = "[" + ", ".join(f"'{a}'" for a in ANSWERS) + "]"
ORACLES |= {
    "facing_words": f"""WITH p AS (SELECT p_partkey, p_type, p_size % 13 AS n, {_DIRS}[p_partkey % {len(DIRECTIONS_)} + 1] AS dir, ['iso', ' ISO ', 'flat', '', NULL][p_partkey % 5 + 1] AS per, {_ANS}[p_partkey % {len(ANSWERS)} + 1] AS ans, 'a {{view}} of ' || p_name || ' facing right, at eye level' AS w FROM part),
      q AS (SELECT *, coalesce(lower(trim(per)) = 'iso', false) AS iso, starts_with(dir, 'north') AS back, CASE WHEN greatest(n, 1) <= 3 THEN 1 ELSE 2 END AS rows, CASE WHEN greatest(n, 1) <= 3 THEN greatest(n, 1) ELSE (n + 1) // 2 END AS cols FROM p),
      r AS (SELECT *, replace(w, '{{view}}', CASE WHEN iso THEN 'high-angle' ELSE 'side-view' END) AS v, CASE WHEN n <= 1 THEN '1:1' WHEN rows = 2 THEN (cols // gcd(cols, 2)) || ':' || (2 // gcd(cols, 2)) ELSE floor(least(4, greatest(16::double / 9, n * 0.6::double)) * 9 + 0.5::double)::int || ':9' END AS asp,
        CASE WHEN p_partkey % 3 = 0 AND trim(p_type) <> '' THEN trim(p_type) WHEN dir = 'north' THEN 'flat sprite' WHEN dir = 'south' THEN 'soft paint' ELSE 'true pixels' END AS style FROM q)
      SELECT p_partkey, back, CASE WHEN back THEN replace(replace(v, ' facing right', ''), ' facing left', '') ELSE v END AS turned, CASE WHEN iso THEN replace(v, ', at eye level', '') ELSE v END AS tilted, (rows * cols - greatest(n, 1))::int AS spare,
      CASE asp WHEN '1:1' THEN 'Render on a square 1:1 canvas.' WHEN '16:9' THEN 'Render on a wide 16:9 landscape canvas, much wider than tall.' WHEN '21:9' THEN 'Render on an extra-wide 21:9 panorama canvas, with plenty of horizontal room for a long row of poses.' ELSE 'Render on a wide ' || asp || ' landscape canvas.' END AS canvas,
      CASE p_partkey % 7 WHEN 0 THEN 'one' WHEN 1 THEN 'two' WHEN 5 THEN 'four' WHEN 6 THEN '1' ELSE '' END AS output, style, regexp_matches(lower(style), 'pixel|sprite|mmorpg') AS pixels FROM r""",
    "service_models": """WITH v(k, label, model) AS (VALUES (0, 'Gemini', 'gemini-3-pro-image'), (1, 'OpenAI', 'gpt-image-2'), (2, 'OpenRouter', 'google/gemini-3-pro-image-preview'), (3, 'fal.ai', 'fal-ai/nano-banana-pro'), (4, 'BytePlus', 'seedream-4-0-250828'), (5, 'Replicate', 'google/nano-banana-2'), (6, 'Gemini', 'gemini-3-pro-image'))
      SELECT label, model, count(*) AS n FROM customer JOIN v ON k = c_custkey % 7 GROUP BY ALL""",
    "event_stamps": "SELECT event_id, strftime(ts, '%Y%m%d-%H%M%S') || '-' || lpad((event_id % 1000)::varchar, 3, '0') AS stamp FROM events",
    "settings_merged": r"""WITH l AS (SELECT coalesce(source, '') AS source, trim(unnest(string_split(coalesce(text, ''), chr(10)))) AS line FROM documents), f AS (SELECT source, CASE WHEN starts_with(line, 'export ') THEN substr(line, 8) ELSE line END AS line FROM l WHERE line <> '' AND NOT starts_with(line, '#') AND contains(line, '=')),
      k AS (SELECT source, trim(substr(line, 1, strpos(line, '=') - 1)) AS key, trim(trim(substr(line, strpos(line, '=') + 1)), '"''') AS value FROM f) SELECT key, value FROM k WHERE key <> '' AND trim(value) <> '' QUALIFY row_number() OVER (PARTITION BY key ORDER BY source, value) = 1""",
    "session_round_trip": "SELECT conv_id, turn, role, text FROM conversations",
    "roster_report": f"WITH {_BEST} SELECT state % 100 AS character, count(*) AS states, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'frames') AS frames, count(*) FILTER (status = 'quality') AS quality, bool_and(status = 'ok') AS ready FROM bs GROUP BY ALL",
    "gallery_cards": f"""WITH {_BEST} SELECT state, '<figure class="' || status || '"><figcaption>' || state || ': ' || found || '/' || expected || ', ' || n_errors || ' errors</figcaption></figure>' AS html FROM bs""",
    "report_change": f"""WITH {_BEST}, j AS (SELECT o_orderpriority AS category, state % 2 AS old, count(*) AS total, count(*) FILTER (status = 'ok') AS passed, round(avg((status = 'ok')::int), 6) AS pass_rate FROM bs JOIN orders ON o_orderkey = state GROUP BY ALL)
      SELECT category, n.total, o.total AS old_total, n.total - o.total AS total_change, n.passed, o.passed AS old_passed, n.passed - o.passed AS passed_change, n.pass_rate, o.pass_rate AS old_pass_rate, round(n.pass_rate - o.pass_rate, 6) AS pass_rate_change
      FROM (SELECT * FROM j WHERE old = 0) n FULL JOIN (SELECT * FROM j WHERE old = 1) o USING (category) WHERE category IS NOT NULL""",
    "named_states": f"""WITH {_CATALOG}, {_BASED}, have AS (SELECT DISTINCT coalesce(x.name, y.name) AS name FROM ba LEFT JOIN cat x ON x.name = state LEFT JOIN cat y ON y.name = base), a(name) AS (VALUES ('idle'), ('walk'), ('attack'), ('no such state'), ('zz'))
      SELECT name, name IN (SELECT name FROM have WHERE name IS NOT NULL) AS known FROM a""",
}

ORACLES["best_attempt_stream"] = ORACLES["best_attempt"]
ORACLES["settings_loaded"] = """WITH c AS (SELECT c_custkey AS o, c_name, 'key-' || c_nationkey AS secret, c_mktsegment FROM customer),
      k AS (SELECT o, CASE WHEN o % 5 = 0 THEN secret WHEN o % 4 = 0 THEN c_name WHEN o % 9 = 1 THEN secret END AS gemini, CASE WHEN o % 5 <> 0 AND o % 8 = 0 THEN 'old-model' END AS gemini_model,
        CASE WHEN o % 7 = 0 THEN c_name END AS openai, CASE WHEN o % 14 = 0 THEN c_mktsegment END AS openai_model, CASE WHEN o % 6 = 0 THEN c_name WHEN o % 2 = 0 THEN secret END AS fal, CASE WHEN o % 13 = 2 THEN c_name END AS replicate,
        o % 5 = 0 OR o % 4 = 0 OR o % 7 = 0 OR o % 11 = 0 OR o % 3 = 0 OR o % 2 = 0 OR o % 9 = 1 OR o % 13 = 2 AS listed FROM c),
      a AS (SELECT *, CASE WHEN o % 11 = 0 THEN 'fal' WHEN gemini IS NOT NULL THEN 'gemini' WHEN openai IS NOT NULL THEN 'openai' WHEN fal IS NOT NULL THEN 'fal' WHEN replicate IS NOT NULL THEN 'replicate' ELSE 'gemini' END AS active FROM k WHERE listed)
      SELECT o AS owner, active, CASE active WHEN 'gemini' THEN gemini WHEN 'openai' THEN openai WHEN 'fal' THEN fal ELSE replicate END AS key, CASE active WHEN 'gemini' THEN gemini_model WHEN 'openai' THEN openai_model END AS model,
        (gemini IS NOT NULL)::int + (openai IS NOT NULL)::int + (fal IS NOT NULL)::int + (replicate IS NOT NULL)::int AS n_keys FROM a"""
ORACLES["template_coverage"] = f"""WITH {_BASED}, t AS (SELECT DISTINCT {_LIST}[(s_suppkey * 3) % {len(STATES)} + 1] AS name FROM supplier)
      SELECT base, count(*) AS n, count(*) FILTER (name IS NOT NULL AND p_partkey % 5 <> 0 AND p_partkey % 7 <> 0) AS used, bool_or(name IS NULL) AS missing FROM ba LEFT JOIN t ON t.name = ba.base GROUP BY base"""
