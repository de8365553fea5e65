"""Text expressions. White space is Unicode white space, case folding that of full case folding for letters in use."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tempora import ontology

#: Runs of white space: Java's Unicode class lacks the four information separators.
SPACE = r"(?U)[\s\x1c-\x1f]+"
#: What norm_name changes: space at an end, in runs or other than a blank, and quotes at an end.
_UNTIDY = r"""(?U)^[\s"']|[\s"']$|[\s&&[^ ]]|[\x1c-\x1f]|  """


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def norm_space(x: Column | str) -> Column:
    """Trimmed, white space as single blanks; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(_col(x), F.lit("")), SPACE, " "))


def strip(x: Column | str) -> Column:
    return F.regexp_replace(F.coalesce(_col(x), F.lit("")), rf"^{SPACE}|{SPACE}$", "")


def fold(x: Column | str) -> Column:
    """Case folding; beyond lower case, final sigma and sharp s."""
    return F.replace(F.translate(F.lower(_col(x)), "ς", "σ"), F.lit("ß"), F.lit("ss"))


def norm(x: Column | str) -> Column:
    return fold(norm_space(x))


def norm_date(x: Column | str) -> Column:
    return strip(x)


def norm_name(x: Column | str) -> Column:
    """norm_space without quotes at both ends; most names have nothing to change, which one search finds."""
    x = _col(x)
    return F.when(~F.coalesce(x, F.lit(" ")).rlike(_UNTIDY), x).otherwise(norm_space(F.regexp_replace(strip(x), "^[\"']+|[\"']+$", "")))


def alias_key(x: Column | str) -> Column:
    return F.replace(fold(norm_name(x)), F.lit("."), F.lit(""))


def slug(x: Column | str) -> Column:
    """ASCII slug."""
    return F.regexp_replace(F.regexp_replace(fold(F.coalesce(_col(x), F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def slug_unicode(x: Column | str) -> Column:
    """Slug that keeps letters and digits of all scripts."""
    return F.regexp_replace(F.regexp_replace(fold(norm_name(x)), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")


def node_id(name: Column | str, kind: Column | str) -> Column:
    return F.concat(_col(kind), F.lit(":"), slug(name))


def edge_id(source: Column | str, target: Column | str, kind: Column | str) -> Column:
    return F.concat(_col(source), F.lit("|"), _col(kind), F.lit("|"), _col(target))


def event_id(article: Column | str, position: Column | str, kind: Column | str, slugger=slug, evidence: Column | None = None) -> Column:
    """`event:article:NNN:type`, with the start of the evidence if given; `position` counts from 0 in the raw array."""
    named = slugger(F.coalesce(F.nullif(_col(article), F.lit("")), F.lit("article")))
    parts = [F.lit("event"), named, F.format_string("%03d", _col(position) + 1), slugger(kind)]
    if evidence is not None:
        parts.append(F.nullif(slugger(F.substring(evidence, 1, 48)), F.lit("")))
    return F.concat_ws(":", *parts)


def evidence_exists(text: Column | str, evidence: Column | str) -> Column:
    """The evidence is an exact quote, white space apart."""
    return F.contains(norm_space(text), norm_space(evidence))


def quote_exists(text: Column | str, quote: Column | str) -> Column:
    return F.contains(norm(text), norm(quote)) & (norm(quote) != "")


def nearby(text: Column | str, evidence: Column | str, window: int) -> Column:
    """The first match of `evidence` with `window` characters on both sides; empty if there is none."""
    body, quote = norm_space(text), norm_space(evidence)
    at = F.position(fold(quote), fold(body))
    start = F.greatest(at - window, F.lit(1))
    found = F.trim(F.substring(body, start, at + F.length(quote) + F.lit(window) - start))
    return F.when((quote == "") | (at == 0), F.lit("")).otherwise(found)


def fuzzy_match(left: Column | str, right: Column | str) -> Column:
    """Equal, one inside the other, or four fifths of all words in common; empty texts match nothing."""
    from tempora.functions.arrays import jaccard

    a, b = norm(left), norm(right)
    words = jaccard(F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " ")))
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a) | (words >= 0.8))


def flag(code: str, message: Column) -> Column:
    return F.struct(F.lit(code).alias("code"), message.alias("message"))


def location_flags(name: Column | str) -> Column:
    """Review flags of a location's name: generic words, demonyms."""
    name, low = _col(name), fold(_col(name))
    words = "|".join(ontology.GENERIC_LOCATION_WORDS)
    generic = low.rlike(rf"(?U)(^|\s)({words})(\s|$)") | low.rlike(f"({words})$")
    adjective = low.rlike("^(" + "|".join(ontology.DEMONYMS) + ")")
    return F.array_compact(F.array(
        F.when(generic, flag("generic_location_name", F.concat(F.lit("Location '"), name, F.lit("' looks generic and should be manually reviewed.")))),
        F.when(adjective, flag("adjectival_location_name", F.concat(F.lit("Location '"), name, F.lit("' starts with a demonym and may need a manual canonical form or override.")))),
    ))


def number(x: Column | str, digits: int = 3) -> Column:
    """Fixed digits, half to even on the binary value."""
    return F.replace(F.format_number(_col(x), digits), F.lit(","), F.lit(""))


def optional_number(x: Column | str, missing: str = "N/A") -> Column:
    return F.coalesce(F.when(~F.isnan(_col(x)), number(x)), F.lit(missing))


def escape_cell(x: Column | str) -> Column:
    """For a Markdown table."""
    clean = F.regexp_replace(F.coalesce(_col(x).cast("string"), F.lit("")), r"\r?\n", " ")
    return F.replace(F.replace(clean, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))


@F.pandas_udf(StringType())
def unescape(texts: pd.Series) -> pd.Series:
    """Character references decoded; there is no built-in expression for these."""
    return texts.map(lambda x: None if x is None else html.unescape(x))


def clean_text(x: Column | str) -> Column:
    return norm_space(unescape(_col(x)))


def without_fences(x: Column | str) -> Column:
    """The content of a fenced code block, else the trimmed text."""
    return F.regexp_replace(strip(x), r"^```[a-zA-Z]*\s*|\s*```$", "")


def json_object(x: Column | str) -> Column:
    """The text itself if it is JSON, else its widest `{...}`, else null."""
    body = without_fences(x)
    inner = F.regexp_extract(body, r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(body).isNotNull() & body.startswith("{"), body).when(F.try_parse_json(F.nullif(inner, F.lit(""))).isNotNull(), inner)


def file_name(date: Column | str, article: Column | str) -> Column:
    """`date__id.html`, or `undated__id.html`."""
    return F.concat(F.coalesce(F.nullif(F.substring(_col(date), 1, 10), F.lit("")), F.lit("undated")), F.lit("__"), _col(article), F.lit(".html"))


def safe_file_name(x: Column | str) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(_col(x), r"[^A-Za-z0-9_.-]+", "-"), "^-+|-+$", ""), F.lit("")), F.lit("article"))


def title_of_file(x: Column | str) -> Column:
    """A page's title from the name of its file."""
    return F.translate(F.regexp_replace(F.regexp_replace(_col(x), r"\.html?$", ""), " - BBC News$", ""), "_", "?")
