"""SQL expressions shared by the pipelines.

Every helper takes SQL expressions as text and returns one, for ``selectExpr``, ``filter`` and
``agg(exprs(...))``: one call to the JVM per table instead of several per column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(12,2)"

# Fixed value: the text that stands for NULL inside a hashed key.
NULL_KEY_TOKEN = "_dbt_utils_surrogate_key_null_"

# Earth radius in miles and kilometres per mile used by the distance formula.
EARTH_RADIUS_MILES = 3961
KM_PER_MILE = 1.60934


def exprs(*texts: str) -> list[Column]:
    return [F.expr(text) for text in texts]


def quoted(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def zero_if_null(c: str) -> str:
    return f"coalesce({c}, 0)"


def ratio(top: str, bottom: str, times: int = 1, digits: int | None = None) -> str:
    """``top / bottom * times`` as double, NULL where ``bottom`` is 0 or NULL.

    With ``digits`` the quotient is rounded half up, in decimal arithmetic: a binary quotient such
    as 2456.865 lies below the tie and would be rounded down.
    """
    if digits is None:
        value = f"(double({top}) / nullif(double({bottom}), 0D))"
        return value if times == 1 else f"({value} * {times}D)"
    scaled = f"cast({top} AS decimal(20,4)) * {times}"
    return f"double(round({scaled} / nullif(cast({bottom} AS decimal(20,4)), 0), {digits}))"


def cents(amount: str) -> str:
    """An amount of at most 12 digits and 2 decimals as a whole number."""
    return f"bigint({amount} * 100)"


def whole_ratio(top: str, bottom: str, times: int, digits: int) -> str:
    """``top / bottom * times`` of two whole numbers, ``bottom`` > 0, rounded half up.

    The same result as ``ratio`` with digits, in long arithmetic: for per-row use, where decimal
    division would dominate the scan. NULL where ``bottom`` is 0 or NULL.
    """
    scale = times * 10**digits
    magnitude = f"((2 * abs({top}) * {scale} + {bottom}) DIV nullif(2 * ({bottom}), 0))"
    return f"(double(if({top} < 0, -{magnitude}, {magnitude})) / {10**digits}D)"


def sum_where(condition: str, value: str) -> str:
    return f"sum(CASE WHEN {condition} THEN {value} ELSE 0 END)"


def mean_of(value: str) -> str:
    """Average as exact sum over count, so that it does not depend on the order of rows."""
    return ratio(f"sum({value})", f"count({value})")


def month_start(c: str) -> str:
    return f"trunc({c}, 'month')"


def quarter_start(c: str) -> str:
    return f"trunc({c}, 'quarter')"


def week_start(c: str) -> str:
    """Monday of the week."""
    return f"trunc({c}, 'week')"


def day_of_week_from_sunday(c: str) -> str:
    """0 = Sunday … 6 = Saturday."""
    return f"(dayofweek({c}) - 1)"


def month_count(start: str, end: str) -> str:
    """Number of month boundaries between two dates (31 Jan → 1 Feb counts 1)."""
    return f"((year({end}) - year({start})) * 12 + month({end}) - month({start}))"


def safe_add(*columns: str) -> str:
    return "(" + " + ".join(zero_if_null(c) for c in columns) + ")"


def safe_subtract(*columns: str) -> str:
    return "(" + " - ".join(zero_if_null(c) for c in columns) + ")"


def safe_divide(top: str, bottom: str) -> str:
    return ratio(top, bottom)


def surrogate_key(columns: Sequence[str], null_token: str = NULL_KEY_TOKEN) -> str:
    """MD5 over the columns as text, joined by ``-``; NULL becomes ``null_token``."""
    texts = ", ".join(f"coalesce(string({c}), {quoted(null_token)})" for c in columns)
    return f"md5(concat_ws('-', {texts}))"


def _without(text: str, *schemes: str) -> str:
    for scheme in schemes:
        text = f"replace({text}, {quoted(scheme)}, '')"
    return text


def url_host(url: str) -> str:
    """Host by text rules, so that addresses without a scheme work too."""
    bare = _without(url, "android-app://", "http://", "https://")
    return f"split_part(split_part({bare}, '/', 1), '?', 1)"


def url_path(url: str) -> str:
    """What follows the host and its slash, up to the query; empty without either."""
    return f"regexp_extract({url}, '^([A-Za-z][A-Za-z0-9+.-]*://)?[^/?]*/?([^?]*)', 2)"


def url_parameter(url: str, name: str) -> str:
    """Value of a query parameter, NULL where it is missing or empty."""
    return f"nullif(split_part(split_part({url}, {quoted(name + '=')}, 2), '&', 1), '')"


def equal_width_bucket(value: str, low: float, high: float, buckets: int) -> str:
    """1 … ``buckets`` inside [low, high), 0 below, ``buckets + 1`` at or above ``high``."""
    return f"width_bucket(double({value}), {float(low)}D, {float(high)}D, {int(buckets)})"


def great_circle_distance(lat1: str, lon1: str, lat2: str, lon2: str, unit: str = "mi") -> str:
    """Haversine distance between two points given in degrees."""
    if unit not in ("mi", "km"):
        raise ValueError(f"unit must be 'mi' or 'km', got {unit!r}")
    lat = f"pow(sin(radians((double({lat2}) - double({lat1})) / 2)), 2)"
    lon = f"pow(sin(radians((double({lon2}) - double({lon1})) / 2)), 2)"
    chord = f"{lat} + cos(radians(double({lat1}))) * cos(radians(double({lat2}))) * {lon}"
    miles = f"(asin(sqrt(least(1D, {chord}))) * {2 * EARTH_RADIUS_MILES})"
    return miles if unit == "mi" else f"({miles} * {KM_PER_MILE}D)"
