"""Tables out of landed page text and cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Header tokens that belong to the name before them.
GLUE_TOKENS = ("sh", "SC", "Miles")


def carried_down(pages: DataFrame, doc: str, order: str | Sequence[str], label: str) -> DataFrame:
    """A section's label holds for the following pages of its document."""
    w = Window.partitionBy(doc).orderBy(*([order] if isinstance(order, str) else order)).rowsBetween(Window.unboundedPreceding, 0)
    return pages.withColumn(label, F.last(label, True).over(w))


def inferred_places(rows: DataFrame, by: str, order: str, place: str) -> DataFrame:
    """A blank place is the one before plus one; where there is none before, the job fails."""
    w = Window.partitionBy(by).orderBy(order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    r = rows.withColumn("_n", F.row_number().over(w))
    known = F.when(F.col(place).isNotNull(), F.struct(F.col(place).alias("p"), F.col("_n").alias("n")))
    last = F.last(known, True).over(run)
    return r.withColumn(place, F.coalesce(place, last["p"] + F.col("_n") - last["n"], F.raise_error(F.lit("a blank place without a place before it")).cast("bigint"))).drop("_n")


def table_rows(pages: DataFrame, score_names: tuple[str, ...] = ("Points",), glue: tuple[str, ...] = GLUE_TOKENS) -> DataFrame:
    """(doc, page, section, column, mark, score) from rows (doc, page, text).

    A line that holds a name of the score column is a page's header; the score is its first or last
    column, and a token of `glue` belongs to the name before it. Lines above it are running heads, of which `MEN` or `WOMEN` name a section that lasts.
    Lines of another width than the header's are dropped, as are cells `-`; the first sighting of a mark counts.
    """
    lines = pages.select("doc", "page", F.posexplode(F.split("text", "\n")).alias("line", "row"))
    lines = lines.withColumn("cells", F.filter(F.split(F.trim("row"), r"\s+"), lambda c: c != "")).where(F.size("cells") > 0)
    is_head = F.exists("cells", lambda c: c.isin(*score_names))
    head = F.first(F.when(is_head, F.struct("line", "cells")), True).over(Window.partitionBy("doc", "page").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    section = F.regexp_extract(F.upper("row"), r"\b(WOMEN|MEN)\b", 1)
    lines = lines.withColumn("h", head).withColumn("section", F.nullif(section, F.lit("")))
    lines = carried_down(lines, "doc", ["page", "line"], "section")
    last = F.element_at("h.cells", -1).isin(*score_names)
    marks = lambda c: F.when(last, F.slice(c, 1, F.size(c) - 1)).otherwise(F.slice(c, 2, F.size(c) - 1))
    joined = lambda a, x: F.when(x.isin(*glue) & (F.size(a) > 0), F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.concat_ws(" ", F.try_element_at(a, F.lit(-1)), x)))).otherwise(F.concat(a, F.array(x)))
    lines = lines.withColumn("names", F.aggregate(marks(F.col("h.cells")), F.expr("cast(array() as array<string>)"), joined))
    body = lines.where((F.col("line") > F.col("h.line")) & (F.size("cells") == F.size("names") + 1))
    body = body.withColumn("score", F.when(last, F.element_at("cells", -1)).otherwise(F.element_at("cells", 1)).try_cast("int"))
    cells = body.select("doc", "page", "line", "section", "score", F.posexplode(F.arrays_zip(F.col("names").alias("name"), marks(F.col("cells")).alias("mark"))).alias("col", "c"))
    cells = cells.where((F.col("c.mark") != "-") & F.col("score").isNotNull())
    return cells.groupBy("doc", "section", F.col("c.name").alias("column"), F.col("c.mark").alias("mark")).agg(F.min_by("score", F.struct("page", "line", "col")).alias("score"))


def placing_cells(rows: DataFrame) -> DataFrame:
    """(table, place_key, category, points) from rows (table, row, label, cells array<struct<category, value>>).

    Labels are `Q or q to Final` (any that begins with q: key `Q`), `9th *`, ranges `10-13th` with a hyphen or a dash, or blank
    (the place before plus one). Stars are dropped, blank cells and wholly blank rows omitted. A label of another
    form, a descending range, and a blank without a place before it fail the job.
    """
    bare = lambda c: F.trim(F.replace(c, F.lit("*"), F.lit("")))
    fail = lambda what: F.raise_error(F.concat(F.lit(f"{what}: "), F.coalesce("label", F.lit("null")))).cast("int")
    r = rows.withColumn("_l", F.coalesce(bare(F.col("label")), F.lit(""))).where((F.col("_l") != "") | F.exists("cells", lambda c: F.trim(c["value"]) != ""))
    q = F.lower("_l").startswith("q")
    span = r"^(\d+)(?:\s*[-\u2013]\s*(\d+))?(?:st|nd|rd|th)?$"
    lo = F.when(F.col("_l") == "", None).when(F.col("_l").rlike(span), F.regexp_extract("_l", span, 1).cast("int")).otherwise(fail("unknown place label"))
    hi = F.regexp_extract("_l", span, 2).try_cast("int")
    places = r.where(~q).withColumn("_lo", lo).withColumn("_hi", F.coalesce(hi, "_lo"))
    # A blank row counts on from the last place of the row before.
    w = Window.partitionBy("table").orderBy("row")
    places = places.withColumn("_n", F.row_number().over(w))
    known = F.when(F.col("_hi").isNotNull(), F.struct(F.col("_hi").alias("p"), F.col("_n").alias("n")))
    last = F.last(known, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    places = places.withColumn("_guess", last["p"] + F.col("_n") - last["n"])
    first = F.coalesce("_lo", "_guess", fail("a blank place label without a place before it"))
    until = F.coalesce("_hi", "_guess")
    key = F.explode(F.sequence(first, F.when(until < first, fail("descending place range")).otherwise(until)))
    places = places.select("table", "cells", key.alias("place_key")).withColumn("place_key", F.col("place_key").cast("string"))
    both = places.select("table", "place_key", "cells").unionByName(r.where(q).select("table", F.lit("Q").alias("place_key"), "cells"))
    cells = both.select("table", "place_key", F.explode("cells").alias("c")).withColumn("_v", bare(F.col("c.value"))).where("_v <> ''")
    return cells.select("table", "place_key", F.col("c.category").alias("category"), F.col("_v").cast("int").alias("points"))


def tidy_groups(rows: DataFrame) -> DataFrame:
    """(label, gender, main_event, similar_events) from rows (label, main, similar): similar events are split at commas; rows
    without a label go."""
    label = F.trim("label")
    similar = F.filter(F.transform(F.split(F.coalesce("similar", F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    gender = F.when(F.lower(label).startswith("men"), "men").otherwise("women")
    return rows.where(label != "").select(label.alias("label"), gender.alias("gender"), F.trim("main").alias("main_event"), similar.alias("similar_events"))


def tidy_categories(rows: DataFrame) -> DataFrame:
    """(code, details) of the rows that have a code."""
    return rows.where(F.trim("code") != "").select(F.trim("code").alias("code"), F.trim("details").alias("details"))


def tidy_wind(rows: DataFrame) -> DataFrame:
    """Distinct (wind, points) from rows of four cells: a tail wind and its points, a head wind and its points (`+1.2 m/s`, `-0.6 pts`).
    Points are cut to whole numbers; `-0` is zero; pairs with a blank go."""
    pairs = F.explode(F.array(*[F.struct(F.col("cells")[i].alias("w"), F.col("cells")[i + 1].alias("p")) for i in (0, 2)])).alias("x")
    bare = lambda c, unit: F.trim(F.replace(c, F.lit(unit), F.lit("")))
    r = rows.where(F.size("cells") >= 4).select(pairs).select(bare(F.col("x.w"), "m/s").alias("w"), bare(F.col("x.p"), "pts").alias("p")).where("w <> '' and p <> ''")
    wind = F.col("w").cast("double")
    return r.select(F.when(wind == 0, F.lit(0.0)).otherwise(wind).alias("wind"), F.col("p").cast("double").cast("int").alias("points")).distinct()
