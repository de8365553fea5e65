"""Date expressions. Dates are text of mixed precision and compare as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tempora.functions.text import norm_space, strip

_FULL = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:?\d{2}(:?\d{2}([.,]\d{1,9})?)?)?(Z|[+-]\d{2}(:?\d{2}(:?\d{2})?)?)?)?$"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def iso_date(x: Column | str) -> Column:
    """The calendar date of an ISO text in its own offset; null if it is none."""
    x = _col(x)
    compact = F.regexp_replace(x, r"^(\d{4})(\d{2})(\d{2})(?=$|T)", "$1-$2-$3")
    day = F.substring(compact, 1, 10)
    return F.when(compact.rlike(_FULL) & F.try_to_date(day).isNotNull(), day)


def event_date(x: Column | str) -> Column:
    """A year, month or day as it stands, else the ISO date."""
    x = strip(x)
    return F.when(x.rlike(r"^\d{4}(-\d{2}){0,2}$"), x).otherwise(iso_date(F.nullif(x, F.lit(""))))


# The shape of a date of each precision, and words for no date.
SHAPES = {"day": r"^\d{4}-\d{2}-\d{2}$", "article_date": r"^\d{4}-\d{2}-\d{2}$", "month": r"^\d{4}-\d{2}$", "year": r"^\d{4}$"}
NO_DATE = ("unknown", "n/a", "none")


def article_date(x: Column | str) -> Column:
    """The ISO date, else ten characters that look like one; null if there is none."""
    x = _col(x)
    return F.coalesce(iso_date(x), F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(x, 1, 10)))


def checked_event_date(date: Column | str, precision: Column | str, published_at: Column | str) -> Column:
    """The date if it has the shape of its precision; no date is the article's, or empty where the precision is unknown; null if they don't agree."""
    date, precision = norm_space(date), _col(precision)
    shaped = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for pair in SHAPES.items() for v in pair]), precision), F.lit("(?!)"))
    none = F.when(precision.eqNullSafe("unknown"), F.lit("")).otherwise(article_date(published_at))
    return F.when(date == "", none).when(precision.eqNullSafe("unknown"), F.when(F.lower(date).isin(*NO_DATE), F.lit(""))).when(F.regexp_like(date, shaped), date)


def epoch_ms_iso(x: Column | str) -> Column:
    """UTC ISO text of epoch milliseconds, fraction only if there is one; the session's zone is to be UTC."""
    at = F.timestamp_millis(_col(x).cast("long"))
    pattern = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
    millis = F.pmod(_col(x).cast("long"), F.lit(1000))
    return F.concat(pattern, F.when(millis == 0, F.lit("")).otherwise(F.format_string(".%03d000", millis)), F.lit("+00:00"))


def earliest(*xs: Column) -> Column:
    return F.least(*xs)


def latest(*xs: Column) -> Column:
    return F.greatest(*xs)
