"""URL splitting, percent-decoding and query pairs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as tx


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def _host_port(url: Column) -> Column:
    return F.regexp_extract(netloc(url), r"([^@]*)$", 1)


def hostname(url: Column) -> Column:
    authority = _host_port(url)
    return F.lower(
        F.when(authority.startswith("["), F.regexp_extract(authority, r"^\[([^\]]*)\]", 1)).otherwise(
            tx.before(authority, ":")
        )
    )


def port(url: Column) -> Column:
    return F.regexp_extract(_host_port(url), r":(\d+)$", 1)


def origin(url: Column) -> Column:
    """Scheme, host and non-default port, the way browsers spell an origin."""
    number = port(url)
    default = ((scheme(url) == "http") & (number == "80")) | ((scheme(url) == "https") & (number == "443"))
    name = F.when(_host_port(url).startswith("["), F.concat(F.lit("["), hostname(url), F.lit("]"))).otherwise(
        hostname(url)
    )
    return F.concat(
        scheme(url), F.lit("://"), name,
        F.when((number == "") | default, F.lit("")).otherwise(F.concat(F.lit(":"), number)),
    )


def percent_decode(text: Column, plus: bool = True) -> Column:
    """Decode ``%XX`` (and ``+``); malformed escapes stay as they are."""
    safe = F.regexp_replace(text, r"%(?![0-9A-Fa-f]{2})", "%25")
    if not plus:
        safe = F.regexp_replace(safe, r"\+", "%2B")
    return F.coalesce(F.try_url_decode(safe), text)


def query_pairs(qs: Column, keep_blank: bool = False) -> Column:
    """Query text to ``array<struct<name,value>>`` in order; blank values only with ``keep_blank``."""
    parts = F.filter(F.split(qs, "&"), lambda p: p != "")
    if not keep_blank:
        parts = F.filter(parts, lambda p: tx.after(p, "=") != "")
    return F.transform(
        parts,
        lambda p: F.struct(
            percent_decode(tx.before(p, "=")).alias("name"), percent_decode(tx.after(p, "=")).alias("value")
        ),
    )


def encode(text: Column) -> Column:
    """Form encoding with ``~`` left bare and ``*`` escaped."""
    out = F.url_encode(text)
    return F.replace(F.replace(out, F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def encode_pairs(pairs: Column) -> Column:
    return F.array_join(F.transform(pairs, lambda p: F.concat(encode(p["name"]), F.lit("="), encode(p["value"]))), "&")


def prefix(url: Column) -> Column:
    """``scheme://authority`` as written."""
    return F.regexp_extract(url, r"^((?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?)", 1)


def question(query_: Column) -> Column:
    """``?query``, or nothing for an empty query."""
    return F.regexp_replace(query_, r"^(?=.)", "?")


def fragment_suffix(url: Column) -> Column:
    return F.regexp_extract(url, r"(#.*)$", 1)
