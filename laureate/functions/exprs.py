"""Column expressions: parsing, formatting, keys and predicates. All stay in Catalyst."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that stand for "no mark".
NO_MARK = ("", "-", "—", "DNF", "DNS", "DQ", "NM", "NG", "NH", "DNQ")


def parse_date(c: Column) -> Column:
    """`16 SEP 2025` in any case, or an ISO date at the start; else null. A day that a month lacks is null."""
    text = F.trim(c)
    named = F.try_to_timestamp(F.initcap(text), F.lit("d MMM yyyy"))
    return F.coalesce(named, F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd"))).cast("date")


def parse_mark(c: Column) -> Column:
    """Metres, points, or a time of up to three parts in seconds, as DECIMAL(14,4); null without a mark."""
    text = F.trim(c)
    kept = F.regexp_replace(text, r"[^0-9.:]+", "")  # annotations and group separators go
    parts = F.split(kept, ":")
    number = lambda x: F.when(x == "", F.lit(0)).otherwise(x.try_cast("decimal(10,4)"))
    total = F.aggregate(parts, F.lit(0).cast("decimal(14,4)"), lambda a, x: (a * 60 + number(x)).cast("decimal(14,4)"))
    return F.when(F.upper(text).isin(*NO_MARK) | (kept == "") | (F.size(parts) > 3), None).otherwise(total)


def format_mark(hundredths: Column, is_time: Column, decimals: Column | int = 2) -> Column:
    """Text of a mark in hundredths with so many decimals, rounded half up: m.cc, or for times [h:][mm:]ss.cc without leading zero parts, carrying
    into minutes."""
    places = F.lit(decimals) if isinstance(decimals, int) else decimals
    scale = F.pow(F.lit(10), places).cast("bigint")
    units = F.floor((hundredths * scale + 50) / 100)
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    whole, rest = F.floor(units / scale), F.when(places > 0, F.concat(F.lit("."), F.lpad(F.pmod(units, scale).cast("string"), places, F.lit("0")))).otherwise("")
    h, m, s = F.floor(whole / 3600), F.floor(whole / 60) % 60, whole % 60
    plain = F.concat(whole.cast("string"), rest)
    timed = (
        F.when(h > 0, F.concat(h.cast("string"), F.lit(":"), two(m), F.lit(":"), two(s), rest))
        .when(m > 0, F.concat(m.cast("string"), F.lit(":"), two(s), rest))
        .otherwise(plain)
    )
    return F.when(is_time, timed).otherwise(plain)


def mark_text(hundredths: Column, spec: Column) -> Column:
    """A mark as it is shown, by its spec (kind, decimals, unit): times carry their notation, others their unit."""
    is_time = spec["kind"] == "time"
    return F.concat(format_mark(hundredths, is_time, spec["decimals"]), F.when(is_time, "").otherwise(F.concat(F.lit(" "), spec["unit"])))


def parse_place(c: Column) -> Column:
    """The first integer of a text, 0 if it has none."""
    return F.coalesce(F.regexp_extract(c.cast("string"), r"\d+", 0).try_cast("int"), F.lit(0))


def on_podium(place: Column) -> Column:
    return place.between(1, 3)


def trailing_id(slug: Column) -> Column:
    """The digits behind the last hyphen at the end of a slug, else null."""
    return F.nullif(F.regexp_extract(slug, r"-(\d+)$", 1), F.lit("")).try_cast("bigint")


def sort_key(value: Column, better_is_higher: Column) -> Column:
    """A key that grows as marks get better."""
    return F.when(better_is_higher, value).otherwise(-value)


def beats(a: Column, b: Column, better_is_higher: Column) -> Column:
    return sort_key(a, better_is_higher) > sort_key(b, better_is_higher)


def name_matches(name: Column, query: Column, collation: str = "UNICODE_CI_AI") -> Column:
    """All blank-separated parts of the query occur in the name, whatever case and accents. A blank query fits none."""
    tokens = F.filter(F.split(F.trim(query), r"\s+"), lambda t: t != "")
    folded = F.collate(name, collation)
    return (F.size(tokens) > 0) & F.forall(tokens, lambda t: F.contains(folded, F.collate(t, collation)))


def window_start(on: Column, months: Column) -> Column:
    """So many months back, at the end of a shorter month."""
    return F.add_months(on, -months)


def eligible(day: Column, category: Column, start: Column, end: Column, area: str | None) -> Column:
    """Inside the window, or, with `area`, of that category since 1 January two years before the end."""
    inside = day.between(start, end)
    if area is None:
        return F.coalesce(inside, F.lit(False))
    since = F.make_date(F.year(end) - 2, F.lit(1), F.lit(1))
    return F.coalesce(inside | ((category == area) & (day >= since) & (day <= end)), F.lit(False))


def change_label(old: Column, new: Column, up_is_good: bool = True) -> Column:
    """(direction, size) of a change; null if there is no old value."""
    step = F.signum((new - old) if up_is_good else (old - new)).cast("int")
    return F.when(old.isNull() | new.isNull(), None).otherwise(F.struct(step.alias("direction"), F.abs(new - old).alias("size")))


def final_size_rule(kind: Column) -> Column:
    return F.when(kind.isin("height", "distance"), "min10").otherwise("max9")


def preference(prefs: Column, defaults: dict[str, bool], kind: Column) -> Column:
    """Stored preferences over defaults, looked up by kind; an unknown kind is off."""
    base = F.create_map(*[F.lit(x) for kv in defaults.items() for x in kv])
    own = F.coalesce(prefs, F.expr("map()").cast("map<string,boolean>"))
    return F.coalesce(F.element_at(own, kind), F.element_at(base, kind), F.lit(False))


def positive_int(c: Column) -> Column:
    """Zero, blank and invalid numbers are null."""
    return F.nullif(c.try_cast("int"), F.lit(0))


def digit_groups(hundredths: Column, is_time: Column) -> Column:
    """A mark as its wheels: (minutes, seconds, hundredths) or (null, metres, centimetres)."""
    whole = F.floor(hundredths / 100)
    return F.struct(
        F.when(is_time, F.floor(whole / 60)).cast("bigint").alias("high"),
        F.when(is_time, whole % 60).otherwise(whole).cast("bigint").alias("mid"),
        F.pmod(hundredths, F.lit(100)).cast("bigint").alias("low"),
    )


def from_digit_groups(groups: Column) -> Column:
    return (F.coalesce(groups["high"], F.lit(0)) * 60 + groups["mid"]) * 100 + groups["low"]


def family(discipline: Column, jumps: Sequence[str], throws: Sequence[str]) -> Column:
    """Jumps and throws are listed; the rest, combined events too, is track."""
    return F.when(discipline.isin(*jumps), "Jumps").when(discipline.isin(*throws), "Throws").otherwise("Track")
