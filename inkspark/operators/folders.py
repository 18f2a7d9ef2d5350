"""Folder trees, calendars, feeds, palettes and colours over notes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import markdown as md
from ..functions.names import folder, palette_score, stem
from ..lineage import cut

# Hues of top folders in turn; saturation and lightness rules.
HUES = (205, 145, 332, 40, 265, 190, 355, 95, 22, 240, 170, 300)


def ancestors(path: Column) -> Column:
    """All folders above a note, the outermost first."""
    parts = F.split(folder(path), "/")
    return F.when(folder(path) == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")))


def folder_list(notes: DataFrame) -> DataFrame:
    """Folders that hold a note somewhere below; asset folders and hidden ones stay out."""
    rows = notes.select(F.explode(ancestors(F.col("path"))).alias("folder")).distinct()
    return rows.where(~F.exists(F.split("folder", "/"), lambda s: s.startswith(".") | (s == "assets")))


def tree(notes: DataFrame) -> DataFrame:
    """path, parent, name, depth, own notes, and total with everything below."""
    total = notes.select(F.explode(ancestors(F.col("path"))).alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("total"))
    own = notes.select(folder("path").alias("path")).where("path <> ''").groupBy("path").agg(F.count(F.lit(1)).alias("own"))
    return total.join(own, "path", "left").select(
        "path", folder("path").alias("parent"), F.element_at(F.split("path", "/"), -1).alias("name"),
        F.size(F.split("path", "/")).cast("long").alias("depth"), F.coalesce("own", F.lit(0)).cast("long").alias("own"), "total",
    )


def listing(notes: DataFrame, name: str, recursive: bool) -> DataFrame:
    """Notes of a folder in any case of its name, with or without those further down."""
    prefix = name.strip().strip("/").lower()
    low = F.lower("path")
    if not prefix:
        return notes if recursive else notes.where(~low.contains("/"))
    inside = low.startswith(prefix + "/")
    return notes.where(inside & (F.lit(recursive) | ~F.substr(low, F.lit(len(prefix) + 2)).contains("/")))


def templates(notes: DataFrame, name: str) -> DataFrame:
    """Notes below the folder of templates; none where no folder is set."""
    return notes.where(F.col("path").startswith(name.strip() + "/") if name.strip() else F.lit(False))


def ai_review(notes: DataFrame) -> DataFrame:
    """Notes an assistant wrote, newest first."""
    rows = notes.select("path", md.title("path", "content").alias("title"), md.is_ai("content").alias("ai"), md.ai_client("content").alias("client"), "modified")
    return rows.where("ai").select("path", "title", "client", "modified").orderBy(F.desc("modified"), "path")


def daily(notes: DataFrame, name: str) -> DataFrame:
    """day, path of the daily notes in a folder."""
    return notes.where((folder("path") == name.strip("/")) & stem("path").rlike(r"^\d{4}-\d{2}-\d{2}$")).select(stem("path").alias("day"), "path")


def month_grid(spark: SparkSession, notes: DataFrame, name: str, year: int, month: int) -> DataFrame:
    """cell, day, has_note: weeks begin on Monday; leading cells have no day."""
    first = F.make_date(F.lit(year), F.lit(month), F.lit(1))
    days = spark.range(1).select(F.explode(F.sequence(F.lit(1) - F.weekday(first), F.dayofmonth(F.last_day(first)))).alias("n"), F.weekday(first).alias("lead"))
    key = F.when(F.col("n") > 0, F.format_string(f"{year:04d}-{month:02d}-%02d", "n"))
    cells = days.select((F.col("n") + F.col("lead")).cast("int").alias("cell"), key.alias("day"))
    return cells.join(daily(notes, name), "day", "left").select("cell", "day", F.col("path").isNotNull().alias("has_note"))


def palette(labels: DataFrame, query: str, limit: int = 40) -> DataFrame:
    """The best ``limit`` of (pos, label) for a typed query."""
    scored = labels.select("pos", "label", palette_score("label", query).cast("long").alias("score")).where("score is not null")
    return scored.orderBy(F.desc("score"), "pos").limit(limit)


def picker(notes: DataFrame, needle: str, limit: int = 30) -> DataFrame:
    """Notes whose title or stem holds the needle, and whether one is exactly it."""
    low = needle.strip().lower()
    rows = notes.select("path", md.title("path", "content").alias("title"), F.lower(stem("path")).alias("stem"))
    hit = rows.where(F.lower("title").contains(low) | F.col("stem").contains(low))
    return hit.select("path", "title", ((F.col("stem") == low) | (F.lower("title") == low)).alias("exact")).orderBy(F.lower("title"), "path").limit(limit)


def hue_of(color: str) -> float:
    """Hue of a ``#rrggbb`` colour."""
    import colorsys

    digits = color.strip().removeprefix("#")
    try:
        r, g, b = (int(digits[i : i + 2], 16) / 255 for i in (0, 2, 4)) if len(digits) == 6 else (None,) * 3
    except ValueError:
        return 205.0
    return 205.0 if r is None else colorsys.rgb_to_hls(r, g, b)[0] * 360


def hex_of(hue: Column, saturation: Column, light: Column) -> Column:
    """``#rrggbb`` of a colour in degrees and percents."""
    s, l = saturation / 100, light / 100
    amount = s * F.least(l, 1 - l)

    def channel(n: int) -> Column:
        k = (F.lit(n) + hue / 30) % 12
        value = l - amount * F.greatest(F.lit(-1.0), F.least(k - 3, 9 - k, F.lit(1.0)))
        return F.lpad(F.lower(F.hex(F.floor(value * 255 + 0.5).cast("long"))), 2, "0")

    return F.concat(F.lit("#"), channel(0), channel(8), channel(4))


def folder_colors(notes: DataFrame, custom: dict[str, str] | None = None) -> DataFrame:
    """folder, hue, saturation, light, hex: top folders differ in hue, their sub-folders in lightness."""
    dirs = notes.select(folder("path").alias("folder")).distinct().withColumn("top", F.split("folder", "/")[0])
    tops = dirs.select("top").distinct().withColumn("nth", F.row_number().over(Window.orderBy("top")) - 1)
    hue = F.get(F.array(*map(F.lit, map(float, HUES))), (F.col("nth") % len(HUES)).cast("int"))
    for name, color in (custom or {}).items():
        hue = F.when(F.col("top") == name, hue_of(color)).otherwise(hue)
    nth_dir = F.row_number().over(Window.partitionBy("top").orderBy("folder")) - 1
    rows = dirs.withColumn("n", nth_dir).join(tops, "top").withColumn("hue", hue)
    root = F.col("folder") == ""
    shaded = rows.select("folder", "hue", F.when(root, 8.0).otherwise(66.0).alias("saturation"), F.when(root, 62.0).otherwise(46.0 + (F.col("n") * 9) % 30).alias("light"))
    return shaded.withColumn("hex", hex_of(F.col("hue"), F.col("saturation"), F.col("light")))


# --- layout ----------------------------------------------------------------

# The layout's constants.
K, GRAVITY, COOLING = 55.0, 0.22, 0.985
CUTOFF, START = K * 25, K * 0.65
GOLDEN_ANGLE = math.pi * (3 - math.sqrt(5))


def seeds(nodes: DataFrame) -> DataFrame:
    """path, i, x, y: nodes (path, i from 0) on a sunflower spiral."""
    n = F.greatest(nodes.select(F.count(F.lit(1))).scalar(), F.lit(1))
    radius = K * 0.6 * F.sqrt(n) * F.sqrt((F.col("i") + 0.5) / n)
    return nodes.select("path", "i", (F.cos(F.col("i") * GOLDEN_ANGLE) * radius).alias("x"), (F.sin(F.col("i") * GOLDEN_ANGLE) * radius).alias("y"))


def layout_step(placed: DataFrame, links: DataFrame, heat: float) -> DataFrame:
    """One step of the force layout over (path, i, x, y) and undirected links (a, b).

    Nodes repel within the cutoff only, so they are bucketed in cells of that
    size and meet the nodes of the nine cells around them.
    """
    cell = placed.withColumn("cx", F.floor(F.col("x") / CUTOFF)).withColumn("cy", F.floor(F.col("y") / CUTOFF))
    near = cell.select("path", "i", "x", "y", F.explode(F.expr("flatten(transform(array(-1,0,1), p -> transform(array(-1,0,1), q -> struct(cx + p as cx, cy + q as cy))))")).alias("at")).select("path", "i", "x", "y", "at.*")
    other = cell.select("cx", "cy", F.col("i").alias("j"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    met = near.join(other, ["cx", "cy"]).where("i <> j")
    dx, dy = F.col("x") - F.col("x2"), F.col("y") - F.col("y2")
    same = dx * dx + dy * dy < 0.01
    way = F.when(F.col("i") < F.col("j"), 1.0).otherwise(-1.0)
    lo, hi = F.least("i", "j"), F.greatest("i", "j")
    ux, uy = F.when(same, way * ((lo % 13) + 1) * 0.05).otherwise(dx), F.when(same, way * ((hi % 7) + 1) * 0.05).otherwise(dy)
    d2 = ux * ux + uy * uy
    push = met.where(dx * dx + dy * dy <= CUTOFF * CUTOFF).select("i", (ux / d2 * K * K).alias("fx"), (uy / d2 * K * K).alias("fy"))
    spot = placed.select("path", "i", "x", "y")
    ends = links.join(spot.select(F.col("path").alias("a"), F.col("i").alias("ia"), F.col("x").alias("xa"), F.col("y").alias("ya")), "a").join(spot.select(F.col("path").alias("b"), F.col("i").alias("ib"), F.col("x").alias("xb"), F.col("y").alias("yb")), "b")
    ex, ey = F.col("xa") - F.col("xb"), F.col("ya") - F.col("yb")
    d = F.sqrt(ex * ex + ey * ey)
    pull = ends.select(F.explode(F.array(F.struct(F.col("ia").alias("i"), (-ex * d / K).alias("fx"), (-ey * d / K).alias("fy")), F.struct(F.col("ib").alias("i"), (ex * d / K).alias("fx"), (ey * d / K).alias("fy")))).alias("f")).select("f.*")
    force = push.unionByName(pull).groupBy("i").agg(F.sum("fx").alias("fx"), F.sum("fy").alias("fy"))
    moved = placed.join(force, "i", "left").withColumn("fx", F.coalesce("fx", F.lit(0.0)) - F.col("x") * GRAVITY).withColumn("fy", F.coalesce("fy", F.lit(0.0)) - F.col("y") * GRAVITY)
    length = F.sqrt(F.col("fx") * F.col("fx") + F.col("fy") * F.col("fy"))
    capped = F.when(length == 0, 0.0).otherwise(F.least(length, F.lit(heat)) / length)
    new = moved.select("path", "i", (F.col("x") + F.col("fx") * capped).alias("x"), (F.col("y") + F.col("fy") * capped).alias("y"))
    center = new.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    return new.select("path", "i", (F.col("x") - center.select("mx").scalar()).alias("x"), (F.col("y") - center.select("my").scalar()).alias("y"))


def layout(nodes: DataFrame, links: DataFrame, steps: int) -> DataFrame:
    """Positions after some steps; each step's result is checkpointed."""
    placed, links, heat = cut(seeds(nodes)), cut(links), START
    for _ in range(steps):
        placed = cut(layout_step(placed, links, heat))
        heat *= COOLING
    return placed


def extent(placed: DataFrame) -> DataFrame:
    return placed.agg(*[f(v).alias(f"{n}_{v}") for v in ("x", "y") for n, f in (("min", F.min), ("max", F.max))])
