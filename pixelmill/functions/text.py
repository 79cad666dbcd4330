"""String helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sanitized(name: Column) -> Column:
    """A file name's stem: what is not a letter, digit, Hangul syllable, _ or - becomes one -; ends are trimmed."""
    part = F.regexp_replace(F.regexp_replace(F.trim(name), "[^a-zA-Z0-9가-힣_-]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(part, F.lit("")), F.lit("character"))


def sanitized_strip(name: Column) -> Column:
    """Character by character, ASCII only."""
    return F.coalesce(F.nullif(F.regexp_replace(name, "[^a-zA-Z0-9_-]", "-"), F.lit("")), F.lit("strip"))


def grid(frames: Column) -> Column:
    """struct(rows, cols): one row up to three frames, else two."""
    n = F.greatest(frames, F.lit(1))
    return F.struct(F.when(n <= 3, 1).otherwise(2).alias("rows"), F.when(n <= 3, n).otherwise(F.floor((n + 1) / 2)).cast("int").alias("cols"))


def aspect(frames: Column) -> Column:
    """The aspect ratio to ask for: near-square cells in grids, else by width, within 16:9 and 36:9."""
    g = grid(frames)
    cols, odd = g["cols"], g["cols"] % 2 == 1
    two = F.concat_ws(":", F.when(odd, cols).otherwise(F.floor(cols / 2)).cast("int"), F.when(odd, 2).otherwise(1))
    ratio = F.least(F.lit(4.0), F.greatest(F.lit(16.0) / 9, frames * F.lit(0.6)))
    return F.when(frames <= 1, "1:1").when(g["rows"] > 1, two).otherwise(F.concat(F.floor(ratio * 9 + 0.5).cast("int"), F.lit(":9")))


def parsed_aspect(text: Column) -> Column:
    """struct(w, h) of "W:H"; zeros if it is none."""
    parts = F.split(F.trim(text), ":", 2)
    w, h = (F.try_to_number(F.trim(F.get(parts, F.lit(i))), F.lit("999999999")).cast("int") for i in (0, 1))
    good = w.isNotNull() & h.isNotNull()
    return F.struct(F.when(good, w).otherwise(0).alias("w"), F.when(good, h).otherwise(0).alias("h"))


def fitted_size(text: Column, least: int = 1280, most: int = 4096) -> Column:
    """"PxQ" with the long side at ``most`` and the short one in proportion, not under ``least``."""
    a = parsed_aspect(text)
    w, h = a["w"].cast("double"), a["h"].cast("double")
    side = F.greatest(F.lit(least), F.least(F.lit(most), F.floor(most * F.least(w, h) / F.greatest(w, h)).cast("int")))
    size = F.when(w >= h, F.concat(F.lit(f"{most}x"), side)).otherwise(F.concat(side, F.lit(f"x{most}")))
    return F.when((w <= 0) | (h <= 0), "2048x2048").otherwise(size)


def strip_size(text: Column) -> Column:
    """"PxQ" whose long edge grows with the ratio (1792 to 4096); sides are multiples of 16, 640 at least."""
    a = parsed_aspect(text)
    w, h = a["w"].cast("double"), a["h"].cast("double")
    ratio = F.greatest(w, h) / F.least(w, h)
    edge = F.least(F.lit(4096), F.greatest(F.lit(1792), F.floor(768.0 * ratio + 0.5).cast("int")))

    def whole(v: Column) -> Column:
        return (F.floor(F.greatest(F.lit(640), v) / 16) * 16).cast("int")

    short = F.floor(edge * F.least(w, h) / F.greatest(w, h)).cast("int")
    size = F.when(w > h, F.concat_ws("x", whole(edge), whole(short))).otherwise(F.concat_ws("x", whole(short), whole(edge)))
    return F.when((w <= 0) | (h <= 0) | (w == h), "1024x1024").otherwise(size)


def snapped_aspect(text: Column) -> Column:
    """The widest of 21:9 and 16:9 that the ratio reaches, else the text itself."""
    a = parsed_aspect(text)
    r = F.when((a["w"] > 0) & (a["h"] > 0), a["w"] / a["h"])
    return F.when(r >= 21.0 / 9, "21:9").when(r >= 16.0 / 9, "16:9").otherwise(text)


def masked(secret: Column) -> Column:
    """The ends of a secret of more than 8 characters, else nothing."""
    return F.when(F.length(secret) > 8, F.concat(F.left(secret, F.lit(4)), F.lit("·" * 4), F.right(secret, F.lit(4)))).otherwise("")


def first_filled(*columns: Column) -> Column:
    """The first that is not null and not empty, else the empty string."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns), F.lit(""))


def palette_size(style: Column) -> Column:
    return F.when(style == "retro16", 16).when(style == "pixel", 32).otherwise(0)


# Words that name the view, and phrases that contradict another view or a chosen direction.
VIEWS = {"iso": "high-angle", "": "side-view"}
TURNED = [" facing right", " facing left"]
FLAT = [", at eye level", "; strictly 2D profile, no perspective rotation"]
# A request's words for canvas shapes.
CANVAS = {
    "1:1": "Render on a square 1:1 canvas.", "16:9": "Render on a wide 16:9 landscape canvas, much wider than tall.",
    "21:9": "Render on an extra-wide 21:9 panorama canvas, with plenty of horizontal room for a long row of poses.",
}
PIXEL_WORDS = ["pixel", "sprite", "mmorpg"]


def is_iso(perspective: Column) -> Column:
    """Whether a perspective is the tilted one; null, blank and "flat" are not."""
    return F.coalesce(F.lower(F.trim(perspective)) == "iso", F.lit(False))


def view_word(perspective: Column) -> Column:
    return F.when(is_iso(perspective), VIEWS["iso"]).otherwise(VIEWS[""])


def with_view(text: Column, perspective: Column) -> Column:
    """{view} in a text, by the perspective's word."""
    return F.replace(text, F.lit("{view}"), view_word(perspective))


def without_phrases(text: Column, phrases: list[str]) -> Column:
    for phrase in phrases:
        text = F.replace(text, F.lit(phrase), F.lit(""))
    return text


def style_of(key: Column, custom: Column, styles: dict[str, str], default: str = "pixel") -> Column:
    """The caller's own style if it is not blank, else the one that the key names in ``styles``, else the default one."""
    known = F.coalesce(*(F.when(key == k, F.lit(v)) for k, v in styles.items()), F.lit(styles[default]))
    return F.when(F.trim(F.coalesce(custom, F.lit(""))) != "", F.trim(custom)).otherwise(known)


def wants_pixels(style: Column) -> Column:
    """Whether a style's text asks for pixel art."""
    low = F.lower(style)
    return low.contains(PIXEL_WORDS[0]) | low.contains(PIXEL_WORDS[1]) | low.contains(PIXEL_WORDS[2])


def spare_cells(frames: Column) -> Column:
    """Cells of the grid that hold no figure."""
    g = grid(frames)
    return g["rows"] * g["cols"] - F.greatest(frames, F.lit(1))


def canvas_words(aspect: Column) -> Column:
    named = F.when(F.coalesce(aspect, F.lit("")) == "", CANVAS["1:1"])
    for shape, words in CANVAS.items():
        named = named.when(aspect == shape, words)
    return named.otherwise(F.concat(F.lit("Render on a wide "), aspect, F.lit(" landscape canvas.")))


def first_output(answer: Column) -> Column:
    """The text of a JSON answer that is a string, or the first of a list of strings; else the empty text."""
    body = F.trim(answer)
    plain = F.when(body.rlike(r'^"'), F.get_json_object(F.concat(F.lit('{"v":'), body, F.lit("}")), "$.v"))
    listed = F.when(body.rlike(r"^\["), F.get(F.from_json(body, "array<string>"), F.lit(0)))
    return F.coalesce(plain, listed, F.lit(""))


def stamp(moment: Column, number: Column) -> Column:
    """A file name's part from a time (to the second) and a running number modulo 1000."""
    return F.concat_ws("-", F.date_format(moment, "yyyyMMdd-HHmmss"), F.lpad((number % 1000).cast("string"), 3, "0"))
