"""Web links taken apart once and put together in one canonical form.

A link is read as browsers read it: blanks around it and line breaks inside it do not count, backslashes are slashes,
the host is lower-cased, a scheme's own port is left out, dot segments are resolved and characters that may not stand
in a link are written as percent-encoded UTF-8. Null, malformed links and schemes other than those of `PORTS` give
null everywhere. A host with letters beyond ASCII is lower-cased but not turned into its ASCII form, for which Spark
has no function; a host with percent signs is malformed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from barrio.functions.text import once

# Ports that a scheme leaves out, and the characters that each part of a link must encode.
PORTS = {"http": 80, "https": 443, "ws": 80, "wss": 443, "ftp": 21}
IN_PATH = r"[^\x21\x24-\x3b\x3d\x40-\x5f\x61-\x7a\x7c\x7e]"
IN_QUERY = r"[^\x21\x24-\x26\x28-\x3b\x3d\x3f-\x7e]"
IN_FRAGMENT = r"[^\x21\x23-\x3b\x3d\x3f-\x5f\x61-\x7e]"

_WHOLE = r"(?is)^(" + "|".join(PORTS) + r"):[/\\]*([^/\\?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
_PLACE = r"(?is)^(?:(.*)@)?([^\x00-\x20#%/:<>?@\[\\\]^|\x7f]+|\[[0-9a-f:.]+\])(?::([0-9]*))?$"


def _encoded(text: Column, unsafe: str) -> Column:
    """The text with each unsafe character as the percent-encoded bytes of its UTF-8."""
    single = lambda c: F.when(c.rlike(unsafe), F.regexp_replace(F.hex(c), "(..)", "%$1")).otherwise(c)
    return F.when(text.rlike(unsafe), F.array_join(F.transform(F.split(text, ""), single), "")).otherwise(text)


def _resolved(path: Column) -> Column:
    """The path from the root without dot segments."""
    here, up = r"(?i)^(\.|%2e)$", r"(?i)^(\.|%2e){2}$"
    parts = F.split(F.regexp_replace(path, r"^[/\\]", ""), r"[/\\]")
    last = F.element_at(parts, -1)
    # A dot segment at the end leaves a folder, whose path ends in a slash.
    parts = F.when(last.rlike(here) | last.rlike(up), F.concat(parts, F.array(F.lit("")))).otherwise(parts)
    step = lambda done, part: (
        F.when(part.rlike(up), F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
        .when(part.rlike(here), done)
        .otherwise(F.concat(done, F.array(part)))
    )
    walked = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.concat(F.lit("/"), F.array_join(walked, "/"))


def link_parts(url: Column) -> Column:
    """Struct of scheme, user, host, port (null if the scheme's own), path, query and fragment; null if malformed."""
    clean = F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\n\r]", "")
    return once(clean, _split)


def _split(clean: Column) -> Column:
    part = lambda i: F.regexp_extract(clean, _WHOLE, i)
    scheme, place = F.lower(part(1)), part(2)
    inside = lambda i: F.regexp_extract(place, _PLACE, i)
    digits = F.regexp_replace(inside(3), "^0+(?=.)", "")
    number = digits.try_cast("int")
    own = F.element_at(F.create_map(*[F.lit(v) for pair in PORTS.items() for v in pair]), scheme)
    fine = clean.rlike(_WHOLE) & place.rlike(_PLACE) & ((digits == "") | F.coalesce(number <= 65535, F.lit(False)))
    return F.when(
        fine,
        F.struct(
            scheme.alias("scheme"), inside(1).alias("user"), F.lower(inside(2)).alias("host"),
            F.when(number != own, number).alias("port"),
            once(_resolved(part(3)), lambda p: _encoded(p, IN_PATH)).alias("path"),
            _encoded(part(4), IN_QUERY).alias("query"), _encoded(part(5), IN_FRAGMENT).alias("fragment"),
        ),
    )


def _authority(link: Column) -> Column:
    return F.concat(link["host"], F.coalesce(F.concat(F.lit(":"), link["port"].cast("string")), F.lit("")))


def canonical(url: Column) -> Column:
    """The link in its one form."""

    def joined(link: Column) -> Column:
        user = F.when(link["user"] != "", F.concat(link["user"], F.lit("@"))).otherwise("")
        return F.concat(
            link["scheme"], F.lit("://"), user, _authority(link), link["path"], link["query"], link["fragment"]
        )

    return once(link_parts(url), joined)


def url_host(url: Column) -> Column:
    """Host without a leading www., null for a malformed link."""
    return F.regexp_replace(link_parts(url)["host"], r"^www\.", "")


def url_origin(url: Column) -> Column:
    """Scheme, host and port of a link."""
    return once(link_parts(url), lambda link: F.concat(link["scheme"], F.lit("://"), _authority(link)))


def url_path(url: Column) -> Column:
    """Path of a link, / if empty."""
    return link_parts(url)["path"]
