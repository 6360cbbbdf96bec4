"""Price charts and forecasts from JSON responses, read by name with defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHART = "struct<chart:struct<result:array<struct<meta:struct<shortName:string,longName:string,regularMarketPrice:double,currency:string>,indicators:struct<quote:array<struct<close:array<double>>>>,events:struct<dividends:map<string,struct<amount:double>>>>>>>"
FORECAST = (
    "struct<daily:struct<time:array<string>,weather_code:array<int>,temperature_2m_max:array<double>,temperature_2m_min:array<double>,sunrise:array<string>,sunset:array<string>>,"
    "hourly:struct<time:array<string>,weather_code:array<int>,temperature_2m:array<double>,precipitation:array<double>>>"
)


def charts(responses: DataFrame) -> DataFrame:
    """symbol, seq, close, pays, name, price, currency from (symbol, body); a response without a result has no rows."""
    r = F.try_element_at(F.from_json("body", CHART)["chart"]["result"], F.lit(1))
    one = responses.select("symbol", r.alias("r")).filter(F.col("r").isNotNull())
    closes = F.try_element_at(F.col("r.indicators.quote"), F.lit(1))["close"]
    pays = F.coalesce(F.size(F.map_keys("r.events.dividends")), F.lit(0)) > 0
    return one.select("symbol", pays.alias("pays"), F.coalesce(F.nullif("r.meta.shortName", F.lit("")), F.nullif("r.meta.longName", F.lit("")), "symbol").alias("name"), F.col("r.meta.regularMarketPrice").alias("price"), F.coalesce("r.meta.currency", F.lit("")).alias("currency"), F.posexplode(F.coalesce(closes, F.array().cast("array<double>"))).alias("seq", "close"))


def _zipped(of: str, fields: dict[str, object]):
    """Parallel arrays as structs, as many as the shortest has; one that is missing or empty is made of its default, if it has one."""
    kind = {"time": "string", "sunrise": "string", "sunset": "string", "weather_code": "int"}
    times = F.col(f"f.{of}.time")
    arrays = []
    for name, default in fields.items():
        own = F.coalesce(F.col(f"f.{of}.{name}"), F.array().cast(f"array<{kind.get(name, 'double')}>"))
        arrays.append(own if default is None else F.when(F.size(own) == 0, F.array_repeat(F.lit(default), F.greatest(F.size(times), F.lit(0)))).otherwise(own))
    n = F.least(*map(F.size, arrays))
    return F.slice(F.arrays_zip(*(a.alias(x) for a, x in zip(arrays, fields, strict=True))), F.lit(1), n)


def forecast_blocks(answers: DataFrame, cities: list[str]) -> DataFrame:
    """city, body from one answer (body) for all ``cities``: an array in their order, or an only object."""
    listed = F.when(F.ltrim("body").startswith("["), F.col("body")).otherwise(F.concat(F.lit("["), "body", F.lit("]")))
    return answers.select(F.posexplode(F.from_json(listed, "array<string>")).alias("pos", "body")).select(F.try_element_at(F.array(*map(F.lit, cities)), F.col("pos") + 1).alias("city"), "body").filter("city IS NOT NULL")


def forecast_days(responses: DataFrame) -> DataFrame:
    """city, day, code, hi, lo, sunrise, sunset from (city, body)."""
    z = _zipped("daily", {"time": None, "weather_code": None, "temperature_2m_max": None, "temperature_2m_min": None, "sunrise": "", "sunset": ""})
    one = responses.select("city", F.from_json("body", FORECAST).alias("f")).select("city", F.explode(z).alias("z"))
    return one.select("city", F.to_date("z.time").alias("day"), F.col("z.weather_code").alias("code"), F.col("z.temperature_2m_max").alias("hi"), F.col("z.temperature_2m_min").alias("lo"), F.substring("z.sunrise", 12, 5).alias("sunrise"), F.substring("z.sunset", 12, 5).alias("sunset"))


def forecast_hours(responses: DataFrame) -> DataFrame:
    """city, hour (local wall time), code, temp, precip from (city, body)."""
    z = _zipped("hourly", {"time": None, "weather_code": None, "temperature_2m": None, "precipitation": 0.0})
    one = responses.select("city", F.from_json("body", FORECAST).alias("f")).select("city", F.explode(z).alias("z"))
    return one.select("city", F.to_timestamp_ntz("z.time", F.lit("yyyy-MM-dd'T'HH:mm")).alias("hour"), F.col("z.weather_code").alias("code"), F.col("z.temperature_2m").alias("temp"), F.coalesce("z.precipitation", F.lit(0.0)).alias("precip"))
