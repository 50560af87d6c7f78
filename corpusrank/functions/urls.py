"""URL predicates and presentation as native column expressions; joining of references as a pandas UDF."""

from __future__ import annotations

from functools import reduce
from operator import add, or_
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: what marks an error page or a raw source file
HIDDEN_PARTS = ("/error", "/404", "/403", "/forbidden", "/denied", "whoops", "trouble locating", "trouble", "permission to access", "apache/", "server at", "port 80", "port 443", "not found", "access denied", "forbidden", "page not found", "error page", "server error", "internal error")
PENALTY_PARTS = ("/error", "/404", "/403", "/forbidden", "/denied", "whoops", "trouble locating", "trouble", "apache/", "not found", "access denied", "forbidden", "page not found", "error page", "server error", "internal error")
ERROR_ENDINGS = ("/error", "/404", "/403", "/denied", "/forbidden")
SOURCE_ENDINGS = (".ff", ".ssi", ".shtml", ".shtm", ".stm", ".inc", ".phtml", ".php3", ".php4", ".phps", ".cgi", ".pl", ".sh", ".py", ".rb", ".jsp", ".asp", ".aspx")
PENALTY = 0.001


def _any(tests: list[Column]) -> Column:
    return reduce(or_, tests)


def defragment(url: str) -> Column:
    """The URL up to its first #."""
    return F.substring_index(url, "#", 1)


def _lower(url: str) -> Column:
    return F.lower(F.coalesce(F.col(url), F.lit("")))


def _apache(low: Column) -> Column:
    return F.contains(low, F.lit("apache")) & (F.contains(low, F.lit("server")) | F.contains(low, F.lit("port")))


def _source(low: Column) -> Column:
    path = F.substring_index(low, "?", 1)
    return _any([F.endswith(path, F.lit(e)) for e in SOURCE_ENDINGS])


def is_hidden(url: str = "url") -> Column:
    """Whether results leave the URL out: empty or null, an error page's words, or a raw source file."""
    low = _lower(url)
    odd = F.contains(low, F.lit("/~")) & _any([F.endswith(low, F.lit(f"/{e}")) for e in SOURCE_ENDINGS])
    return (low == "") | _any([F.contains(low, F.lit(p)) for p in HIDDEN_PARTS]) | _any([F.endswith(low, F.lit(e)) for e in ERROR_ENDINGS]) | _apache(low) | _source(low) | odd


def penalty(url: str = "url") -> Column:
    """0.001 to the number of penalty groups that the URL falls into (every such URL is hidden too)."""
    low = _lower(url)
    groups = (_any([F.contains(low, F.lit(p)) for p in PENALTY_PARTS]), _any([F.endswith(low, F.lit(e)) for e in ERROR_ENDINGS]), _apache(low), _source(low))
    return F.pow(F.lit(PENALTY), reduce(add, [g.cast("int") for g in groups]))


_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]*)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def host(url: str = "url") -> Column:
    return F.lower(F.regexp_extract(url, _HOST, 1))


def path(url: str = "url") -> Column:
    return F.regexp_extract(url, _PATH, 1)


def display_url(url: str = "url", width: int = 80) -> Column:
    """Host and path, cut after ``width`` characters with "..."; what is no URL stays as it is."""
    shown = F.when(host(url) == "", F.col(url)).otherwise(F.concat(host(url), F.when(path(url) == "", F.lit("/")).otherwise(path(url))))
    return F.when(F.length(shown) > width, F.concat(F.substring(shown, 1, width), F.lit("..."))).otherwise(shown)


def _capitalised(text: Column) -> Column:
    return F.array_join(F.transform(F.split(text, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))), " ")


def page_title(url: str = "url") -> Column:
    """A title from the URL: the last path segment with words in it, else the domain.

    A segment's - and _ are spaces and a page ending (.html, .php, .htm, .asp, .aspx) is dropped; what is then empty,
    one character or all digits is passed over.  Without segments: the host without its first www.; with none usable: "Domain -
    TLD".  Words are capitalised.  What is no URL stays as it is.
    """
    segments = F.filter(F.split(path(url), "/"), lambda s: s != "")
    cleaned = F.transform(segments, lambda s: F.trim(F.regexp_replace(F.translate(s, "-_", "  "), r"(?i)\.(html|php|htm|aspx|asp)$", "")))
    usable = F.filter(cleaned, lambda s: (F.length(s) > 1) & ~s.rlike(r"^[0-9]+$"))
    bare = F.regexp_replace(host(url), r"^(.*?)www\.", "$1")
    labels = F.split(bare, r"\.")
    domain = F.when(F.size(labels) > 1, F.concat(_capitalised(F.element_at(labels, -2)), F.lit(" - "), F.upper(F.element_at(labels, -1)))).otherwise(bare)
    return F.when(host(url) == "", F.col(url)).when(F.size(segments) == 0, bare).when(F.size(usable) == 0, domain).otherwise(_capitalised(F.element_at(usable, -1)))


def snippet(url: str = "url", rules: tuple[tuple[str, str], ...] = (), default: str = "Click to view this page") -> Column:
    """The text of the first rule whose part the host holds, else the default."""
    out = F.lit(default)
    for part, text in reversed(rules):
        out = F.when(F.contains(host(url), F.lit(part)), F.lit(text)).otherwise(out)
    return out


@F.pandas_udf(T.StringType())
def join_url(base: pd.Series, href: pd.Series) -> pd.Series:
    """The reference resolved against its page's URL; null where it cannot be (one bad link does not stop the others)."""

    def one(b: str | None, h: str | None) -> str | None:
        try:
            return urljoin(b or "", h) if h is not None else None
        except ValueError:
            return None

    return pd.Series([one(b, h) for b, h in zip(base, href, strict=True)], dtype=object)
