"""Scalar expressions: each takes and returns a Column, and stays on the JVM unless it says otherwise."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Strings that stand for a missing value. Fixed values.
MISSING = ("", "-", "--", "NA", "N/A", "NULL", "None")
#: Day 0 of spreadsheet serial dates. Fixed value.
SERIAL_EPOCH = "1899-12-30"


# -- codes, years, numbers, dates ------------------------------------------------------------------


def code(x: Column, width: int = 6) -> Column:
    """Digits only, a trailing ``.0`` dropped, zeros added on the left; anything else is null.

    A code longer than ``width`` stays as it is, which lpad alone would cut.
    """
    t = F.regexp_replace(F.trim(x.cast("string")), r"\.0$", "")
    return F.when(t.rlike("^[0-9]+$"), F.when(F.length(t) < width, F.lpad(t, width, "0")).otherwise(t))


def exchange_symbol(code_: Column, exchange: Column, sep: str = ".") -> Column:
    """The code with its exchange after ``sep``; null if either is."""
    return F.when(code_.isNotNull() & exchange.isNotNull(), F.concat_ws(sep, code_, F.upper(exchange)))


def year(x: Column, first: int, last: int, suffix: str = "年") -> Column:
    """A four-digit year inside a range, with or without a suffix; else null."""
    t = F.regexp_replace(F.trim(x.cast("string")), f"{suffix}$", "")
    y = F.when(t.rlike("^[0-9]{4}$"), t.try_cast("int"))
    return F.when(y.between(first, last), y)


def is_missing(x: Column) -> Column:
    return x.isNull() | F.trim(x.cast("string")).isin(list(MISSING))


def number(x: Column) -> Column:
    """A double without blanks and thousands marks; missing tokens and unparsable values are null."""
    t = F.trim(x.cast("string"))
    return F.when(~t.isin(list(MISSING)), F.replace(t, F.lit(","), F.lit("")).try_cast("double"))


def unparsable(x: Column) -> Column:
    """Whether a value is there that ``number`` can't read."""
    return ~is_missing(x) & number(x).isNull()


def percent(x: Column) -> Column:
    """As ``number``, but ``13.5%`` is 0.135; plain numbers keep their scale."""
    t = F.trim(x.cast("string"))
    return F.when(t.endswith("%"), number(F.regexp_replace(t, "%$", "")) / 100).otherwise(number(x))


def date(x: Column) -> Column:
    """Y-M-D, Y/M/D or a spreadsheet serial number; null if none of these."""
    t = F.trim(x.cast("string"))
    serial = F.when(t.rlike(r"^[0-9]{1,6}(\.0)?$"), F.date_add(F.lit(SERIAL_EPOCH).cast("date"), F.regexp_replace(t, r"\.0$", "").try_cast("int")))
    dashed = F.when(t.rlike("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"), F.try_to_date(t, "yyyy-M-d"))
    slashed = F.when(t.rlike("^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}$"), F.try_to_date(t, "yyyy/M/d"))
    return F.coalesce(dashed, slashed, serial)


def safe_ratio(n: Column, d: Column) -> Column:
    """n / d where the denominator is positive; else null."""
    return F.when(n.isNotNull() & (d > 0), n / d)


def safe_log(x: Column) -> Column:
    """ln(x) where x is positive; else null."""
    return F.when(x > 0, F.ln(x))


def clip01(x: Column) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))


def truth(x: Column) -> Column:
    return F.coalesce(F.lower(F.trim(x.cast("string"))).isin("true", "1", "yes", "y"), F.lit(False))


def integer(x: Column, default: int = 0) -> Column:
    return F.coalesce(F.trim(x.cast("string")).try_cast("double").try_cast("long"), F.lit(default))


def text(x: Column) -> Column:
    return F.coalesce(F.trim(x.cast("string")), F.lit(""))


def in_category(x: Column, value: str) -> Column:
    """Whether a category is ``value`` or one below it (``value-...``); null if unknown."""
    t = F.trim(x)
    return F.when(t != "", (t == value) | t.startswith(f"{value}-"))


def all_equal(a: Column, b: Column) -> Column:
    """Whether both are there and equal."""
    return a.isNotNull() & b.isNotNull() & F.coalesce(a == b, F.lit(False))


# -- text ------------------------------------------------------------------------------------------


@F.pandas_udf(StringType())
def nfkc(x: pd.Series) -> pd.Series:
    """Unicode NFKC, for which Spark has no function; an Arrow UDF."""
    return x.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t)).astype(object)


@F.pandas_udf(StringType())
def unescape(x: pd.Series) -> pd.Series:
    """HTML character references as characters; an Arrow UDF."""
    return x.map(lambda t: None if t is None else html.unescape(t)).astype(object)


def folded(x: Column) -> Column:
    """Unicode NFKC. Every row goes through Python's worker, but those of ASCII alone as nulls, so their texts are neither sent nor normalised."""
    return F.coalesce(nfkc(F.when(x.rlike(r"[^\x00-\x7F]"), x)), x)


def squeeze(x: Column) -> Column:
    """Trimmed, with each run of blanks as one space."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def identity_key(x: Column) -> Column:
    """Lower-case word characters of the NFKC form only: what two spellings of a name share."""
    return F.lower(F.regexp_replace(folded(x), r"(?U)[^\w]", ""))


def vector_text(x: Column) -> Column:
    """Lower-case CJK and ASCII letters and digits of the NFKC form only."""
    return F.regexp_replace(F.lower(folded(x)), r"[^一-鿿a-z0-9]", "")


def lines(x: Column, dropped_prefixes: tuple[str, ...] = ()) -> Column:
    """Lines without control characters, blanks squeezed, empty ones and those with a dropped prefix left out."""
    clean = F.regexp_replace(F.regexp_replace(x, r"\r\n?", "\n"), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    out = F.filter(F.transform(F.split(clean, "\n"), squeeze), lambda t: t != "")
    for p in dropped_prefixes:
        out = _without_prefix(out, p)
    return out


def _without_prefix(xs: Column, prefix: str) -> Column:
    return F.filter(xs, lambda t: ~t.startswith(prefix))


def paragraphs(x: Column) -> Column:
    """Blocks between blank lines; if that is only one, its lines."""
    def parts(pattern: str) -> Column:
        return F.filter(F.transform(F.split(x, pattern), lambda t: F.trim(t)), lambda t: t != "")  # as an argument itself, trim would get the place as its second

    blocks = parts(r"\n\s*\n")
    return F.when(F.size(blocks) > 1, blocks).otherwise(parts("\n"))


def occurrences(x: Column, term: Column | str) -> Column:
    """How often a term occurs without overlap."""
    t = F.lit(term) if isinstance(term, str) else term
    n = F.length(t)
    return F.when(n > 0, ((F.length(x) - F.length(F.replace(x, t, F.lit("")))) / n).cast("long")).otherwise(F.lit(0))


def split_names(x: Column, delimiter: str = "→") -> Column:
    """Trimmed parts in order, each once by its identity key; ``x`` is in NFKC form, as of ``folded``."""
    parts = F.filter(F.transform(F.split(x, delimiter), lambda t: F.trim(t)), lambda t: t != "")
    keys = F.transform(parts, lambda t: F.lower(F.regexp_replace(t, r"(?U)[^\w]", "")))
    return F.transform(F.filter(F.arrays_zip(parts.alias("t"), keys.alias("k")), lambda p, i: F.array_position(keys, p["k"]) == i + 1), lambda p: p["t"])


def excerpt(x: Column, terms: list[str], radius: int = 40) -> Column:
    """The text around the first place where any term occurs; null if none does."""
    at = F.least(*[F.nullif(F.instr(x, t), F.lit(0)) for t in terms], F.lit(None).cast("int"))
    return F.when(at.isNotNull(), F.substring(x, F.greatest(at - radius, F.lit(1)), F.lit(2 * radius)))


def flag_list(flags: dict[str, Column], sep: str = ";", none: str = "ok") -> Column:
    """The names of the flags that hold, joined; ``none`` if no flag does."""
    held = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in flags.items()]))
    return F.when(F.size(held) == 0, F.lit(none)).otherwise(F.array_join(held, sep))


def short_id(prefix: str, parts: list[Column], digits: int = 20) -> Column:
    """A stable id: a prefix and the first hex digits of the SHA-256 of parts joined by ``|``."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, digits))


def history_tokens(x: Column, pattern: str, known: Column | None = None) -> Column:
    """All matches of a pattern in order, each once, after those already ``known``."""
    found = F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(pattern), F.lit(0))
    return F.array_distinct(F.concat(F.coalesce(known, F.array().cast("array<string>")), found) if known is not None else found)


def redacted(url: Column) -> Column:
    """A URL with the values of secret query keys replaced."""
    return F.regexp_replace(url, r"(?i)([?&][^=&]*(?:token|password|cookie|secret)[^=&]*=)[^&]*", "$1[REDACTED]")


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def allowed_url(url: Column, hosts: list[str], path_pattern: str | None = None) -> Column:
    """Whether a URL is https, of one of ``hosts``, with a path that matches."""
    ok = (F.try_parse_url(url, F.lit("PROTOCOL")) == "https") & host(url).isin(hosts)
    if path_pattern:
        ok = ok & F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")).rlike(path_pattern)
    return F.coalesce(ok, F.lit(False))


def domain_class(url: Column, classes: dict[str, str], otherwise: str = "other") -> Column:
    """The class of the first domain that is a URL's host or a parent of it."""
    h = host(url)
    out = F.lit(otherwise)
    for domain, label in reversed(list(classes.items())):
        out = F.when((h == domain) | h.endswith(f".{domain}"), F.lit(label)).otherwise(out)
    return out


def title_year(title: Column, full_pattern: str, summary_pattern: str) -> Column:
    """struct(year, kind) of a report title: kind is full, summary, or null where neither pattern fits."""
    y = F.regexp_extract(title, r"((?:19|20)[0-9]{2})", 1).try_cast("int")
    kind = F.when(title.rlike(summary_pattern), F.lit("summary")).when(title.rlike(full_pattern), F.lit("full"))
    return F.struct(F.when(kind.isNotNull(), y).alias("year"), kind.alias("kind"))
