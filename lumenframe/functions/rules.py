"""Row rules as column expressions: parsing, tiers, gates, scores and states."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

C = Column | str

# Thresholds of the rules below.
TIERS = ["high", "nominal", "low"]
SOURCE_MIN_DAYS, SOURCE_MAX_MEAN, SOURCE_MAX_PEAK = 7, 5.0, 20.0
TREND_MIN_PASSES, TREND_MAX_GEOMETRY, TREND_WEAKENING, TREND_INTENSIFYING = 3, 1.5, 0.6, 1.667
COVER_BUILT, COVER_CROP, COVER_WOODY, COVER_NATURAL = 30, 35, 35, 60
LADDERS = {
    "temperature": (">=", [(40, 30), (35, 22), (30, 14), (25, 7)]),
    "humidity": ("<=", [(20, 25), (30, 20), (40, 13), (50, 6)]),
    "wind": (">=", [(50, 25), (35, 18), (20, 11), (10, 5)]),
    "count": (">=", [(10, 20), (5, 15), (2, 10), (1, 5)]),
}
LEVELS = [(75, "Critical"), (50, "High"), (25, "Medium")]


def _c(x: C) -> Column:
    return F.col(x) if isinstance(x, str) else x


def hhmm_timestamp(date: C, hhmm: C) -> Column:
    """Timestamp of an ISO date and an unpadded HHMM; null for anything malformed or out of range."""
    d, t = F.trim(_c(date)), F.lpad(F.trim(_c(hhmm)), 4, "0")
    ok = d.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.trim(_c(hhmm)).rlike(r"^\d{1,4}$")
    ok = ok & (F.substring(t, 1, 2) < "24") & (F.substring(t, 3, 2) < "60")
    return F.when(ok, F.try_to_timestamp(F.concat(d, F.lit(" "), t), F.lit("yyyy-MM-dd HHmm")))


def safe_number(text: C) -> Column:
    """A finite double, or null for blank, malformed and non-finite text."""
    x = F.nullif(F.trim(_c(text).cast("string")), F.lit("")).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def confidence_tier(text: C) -> Column:
    """high / nominal / low from a percentage or a word; null stays null."""
    t = F.lower(F.trim(_c(text)))
    n = t.try_cast("int")
    return (
        F.when(t.isNull(), F.lit(None).cast("string"))
        .when(t.rlike(r"^\d+$"), F.when(n >= 80, "high").when(n >= 30, "nominal").otherwise("low"))
        .when(t.contains("high") | (t == "h"), "high").when(t.contains("nominal") | (t == "n"), "nominal").otherwise("low")
    )


def tier_rank(tier: C) -> Column:
    """1 high, 2 nominal, 3 low; unknown last."""
    t = _c(tier)
    return F.when(t == "high", 1).when(t == "nominal", 2).when(t == "low", 3).otherwise(4)


def gate(inside: C, nearest_km: C, limit_km: float = 250.0) -> Column:
    """Whether a point passes: inside, or of unknown place and not too far from the nearest centre."""
    return F.coalesce(_c(inside), F.coalesce(_c(nearest_km) <= limit_km, F.lit(True)))


def significant(passes: C, peak: C, tier: C) -> Column:
    """Seen twice, hot enough and not of low tier; an unknown tier passes."""
    return F.coalesce((_c(passes) >= 2) & (_c(peak) >= 8), F.lit(False)) & ~_c(tier).eqNullSafe("low")


def strong(passes: C, peak: C, tier: C) -> Column:
    return significant(passes, peak, tier) | F.coalesce(_c(peak) >= 15, F.lit(False))


def persistent_source(days: C, mean: C, peak: C) -> Column:
    return F.coalesce((_c(days) >= SOURCE_MIN_DAYS) & (_c(mean) < SOURCE_MAX_MEAN) & (F.coalesce(_c(peak), F.lit(0.0)) < SOURCE_MAX_PEAK), F.lit(False))


def interim_source(days: C, peak: C, passes: C) -> Column:
    return (_c(days) >= 2) & (F.coalesce(_c(peak), F.lit(0.0)) < 10) & (_c(passes) >= 6)


def source_reason(days: C, mean: C, peak: C) -> Column:
    one = lambda x: F.format_string("%.1f", F.round(x.cast("decimal(20,6)"), 1).cast("double"))
    return F.concat(
        F.lit("seen on "), _c(days).cast("string"), F.lit(f" distinct days (≥{SOURCE_MIN_DAYS}), mean FRP "), one(_c(mean)),
        F.lit(f" MW (<{SOURCE_MAX_MEAN:g}), peak FRP "), one(F.coalesce(_c(peak), F.lit(0.0))), F.lit(f" MW (<{SOURCE_MAX_PEAK:g})"),
    )


def land_cover(shares: C) -> Column:
    """built / agriculture / natural / other from a map of class to percent."""
    part = lambda k: F.coalesce(F.try_element_at(_c(shares), F.lit(k)), F.lit(0))
    woody = part("tree") + part("shrub")
    natural = woody + part("grass") + part("wetland") + part("mangrove") + part("moss")
    return (
        F.when(part("built") >= COVER_BUILT, "built").when((part("crop") >= COVER_CROP) & (woody < COVER_WOODY), "agriculture")
        .when(natural >= COVER_NATURAL, "natural").otherwise("other")
    )


def natural_or_confirmed(cover: C, news_id: C) -> Column:
    return _c(cover).isNull() | _c(cover).isin("natural", "unknown") | _c(news_id).isNotNull()


def _ladder(x: Column, name: str) -> Column:
    sign, steps = LADDERS[name]
    out = F.lit(0)
    for limit, points in reversed(steps):
        out = F.when(x >= limit if sign == ">=" else x <= limit, points).otherwise(out)
    return out


def risk_score(temperature: C, humidity: C, wind: C, count: C) -> Column:
    """0 to 100 from four ladders and a hot-and-dry bonus; an unknown count adds nothing."""
    t, h, w, n = _c(temperature), _c(humidity), _c(wind), F.coalesce(_c(count), F.lit(0))
    bonus = F.when((t > 40) & (h < 20), 20).when((t > 35) & (h < 30), 10).otherwise(0)
    return F.least(F.lit(100), _ladder(t, "temperature") + _ladder(h, "humidity") + _ladder(w, "wind") + _ladder(n, "count") + bonus)


def risk_level(score: C) -> Column:
    out = F.lit("Low")
    for limit, name in reversed(LEVELS):
        out = F.when(_c(score) >= limit, name).otherwise(out)
    return out


def level_index(level: C) -> Column:
    return F.when(_c(level) == "Critical", 3).when(_c(level) == "High", 2).when(_c(level) == "Medium", 1).otherwise(0)


def _half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def dryness_index(temperature: C, humidity: C, wind: C) -> Column:
    return F.least(F.lit(100), _half_up(_c(temperature) / 45 * 50 + (100 - _c(humidity)) / 100 * 35 + _c(wind) / 80 * 15))


def vegetation_pressure(temperature: C, wind: C) -> Column:
    return F.least(F.lit(100), _half_up(_c(wind) / 80 * 50 + _c(temperature) / 45 * 50))


def trend(ratio: C, passes: C, geometry: C, fixed_source: C) -> Column:
    """weakening / stable / intensifying, or null where the evidence doesn't carry one."""
    r = _c(ratio)
    usable = (_c(passes) >= TREND_MIN_PASSES) & (_c(geometry) <= TREND_MAX_GEOMETRY) & ~F.coalesce(_c(fixed_source), F.lit(False)) & r.isNotNull()
    return F.when(usable, F.when(r < TREND_WEAKENING, "weakening").when(r > TREND_INTENSIFYING, "intensifying").otherwise("stable"))


def satellite_state(last_seen: C, as_of: C, active_hours: float = 6.0) -> Column:
    return F.when(hours_between(as_of, last_seen) <= active_hours, "active").otherwise("not_recently_detected")


def hours_between(later: C, earlier: C) -> Column:
    return (F.unix_micros(_c(later).cast("timestamp")) - F.unix_micros(_c(earlier).cast("timestamp"))) / 3.6e9


def stale(at: C, as_of: C, hours: float = 6.0) -> Column:
    """True when older than the limit or unknown."""
    return F.coalesce(hours_between(as_of, at) > hours, F.lit(True))


def alert_transition(level: C, previous: C, notified_today: C) -> Column:
    """Whether a level deserves a notice: High or above, none sent today, and new, from below High, or risen."""
    now, before = level_index(level), level_index(previous)
    return (now >= 2) & ~F.coalesce(_c(notified_today), F.lit(False)) & (_c(previous).isNull() | (before < 2) | (now > before))


def waking_hours(ts: C, zone: str, first: int = 7, last: int = 20) -> Column:
    return F.hour(F.from_utc_timestamp(_c(ts), zone)).between(first, last)


def half_open_days(start: C, end: C, first_day: str, last_day: str, zone: str) -> Column:
    """Whether [start, end] overlaps the local days first_day..last_day, both included."""
    lo = F.to_utc_timestamp(F.lit(first_day).cast("timestamp"), zone)
    hi = F.to_utc_timestamp(F.date_add(F.lit(last_day).cast("date"), 1).cast("timestamp"), zone)
    return (_c(start) < hi) & (_c(end) >= lo)


def check_date_range(first_day: str, last_day: str, max_days: int = 1100) -> int:
    """Days of a strict ISO range, both ends included; ValueError when malformed, reversed or too long."""
    import re
    from datetime import date

    if not all(re.fullmatch(r"\d{4}-\d{2}-\d{2}", d) for d in (first_day, last_day)):
        raise ValueError("dates are YYYY-MM-DD")
    days = (date.fromisoformat(last_day) - date.fromisoformat(first_day)).days + 1
    if not 1 <= days <= max_days:
        raise ValueError(f"the range must hold 1 to {max_days} days")
    return days


def round_half_up(x: C, digits: int) -> Column:
    """Rounds halves towards plus infinity."""
    k = 10**digits
    return F.floor(_c(x) * k + 0.5) / k


def build_number(device: C) -> Column:
    """The build in a device text like "app 1.2.3+45"; null where there is none."""
    return F.nullif(F.regexp_extract(_c(device), r"\+(\d+)", 1), F.lit("")).try_cast("long")


def older_build(device: C, build: int) -> Column:
    return F.coalesce(build_number(device) < build, F.lit(True))


def version_or_zero(text: C) -> Column:
    return F.when(_c(text).rlike(r"^\d+(\.\d+){0,2}$"), _c(text)).otherwise("0.0.0")
