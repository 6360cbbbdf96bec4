"""Numbers and dates as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire import constants as C


def fixed(x: Column, digits: int) -> Column:
    """``x`` with so many decimal places, half to even on the exact binary value (format_string() rounds the shortest decimal half up)."""
    return F.replace(F.format_number(x, digits), F.lit(","), F.lit(""))


def py_round(x: Column, digits: int) -> Column:
    """Half to even on the exact binary value; what isn't finite stays."""
    x = x.cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), x).otherwise(fixed(x, digits).cast("double"))


def ratio(a: Column, b: Column) -> Column:
    """a / b as IEEE 754 has it: infinite, or not a number, over zero, whose sign counts."""
    return F.when(b == 0, a * F.pow(b, F.lit(-1.0))).otherwise(F.try_divide(a, b))


def source_component(tier: Column) -> Column:
    return (3 - F.greatest(F.lit(1), F.least(F.lit(3), tier))) / F.lit(2.0)


def cluster_component(sources: Column) -> Column:
    return F.least(F.lit(1.0), F.log(F.greatest(F.lit(1), sources).cast("double")) / F.log(F.lit(6.0)))


def position_component(pos: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.greatest(F.lit(0), pos) / F.lit(5.0))


def hours_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(3600e6)


def recency_component(published: Column, as_of: Column) -> Column:
    return F.pow(F.lit(0.5), F.greatest(F.lit(0.0), hours_between(as_of, published)) / C.HALF_LIFE_HOURS)


def topic_component(topic: Column) -> Column:
    boost = F.create_map(*(F.lit(x) for kv in C.TOPIC_BOOST.items() for x in kv))
    return F.coalesce(F.try_element_at(boost, F.coalesce(topic, F.lit(""))), F.lit(C.DEFAULT_BOOST))


def components(tier: Column, sources: Column, pos: Column, published: Column, topic: Column, as_of: Column) -> dict[str, Column]:
    return {
        "source": source_component(tier), "cluster": cluster_component(sources), "position": position_component(pos),
        "recency": recency_component(published, as_of), "topic": topic_component(topic),
    }


def score(**of: Column) -> Column:
    parts = components(**of)
    return sum((parts[k] * w for k, w in C.RANK_WEIGHTS.items()), F.lit(0.0))


def explain(**of: Column) -> dict[str, Column]:
    """Each weighted part and the total, four decimal places."""
    parts = {k: c * C.RANK_WEIGHTS[k] for k, c in components(**of).items()}
    return {k: py_round(c, 4) for k, c in parts.items()} | {"total": py_round(score(**of), 4)}


def describe(code: Column) -> Column:
    """struct(icon, label) of a WMO weather code."""
    out = None
    for first, last, icon, label in C.WEATHER_CODES:
        hit, what = code.between(first, last), F.struct(F.lit(icon).alias("icon"), F.lit(label).alias("label"))
        out = F.when(hit, what) if out is None else out.when(hit, what)
    return out.otherwise(F.struct(F.lit(C.OTHER_WEATHER[0]).alias("icon"), F.lit(C.OTHER_WEATHER[1]).alias("label")))


def weekday_label(day: Column, today: Column) -> Column:
    return F.when(day == today, "HEUTE").otherwise(F.element_at(F.array(*map(F.lit, C.WEEKDAYS)), F.weekday(day) + 1))


def parse_date(raw: Column) -> Column:
    """RFC 2822, then ISO 8601, then a leading date; without an offset UTC; else null."""
    t = F.trim(raw)
    mail = F.regexp_replace(F.regexp_replace(t, r"^[A-Za-z]{3},\s*", ""), r"\s+(GMT|UT|UTC|Z)$", " +0000")
    day = F.regexp_extract(t, r"^(\d{4}-\d{2}-\d{2})", 1)
    return F.coalesce(
        F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm Z")), F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss")),
        F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), t.try_cast("timestamp")), F.when(day != "", day.try_cast("timestamp")),
    )


def local(ts: Column, pattern: str, zone: str = C.TIME_ZONE) -> Column:
    return F.date_format(F.from_utc_timestamp(ts, zone), pattern)
