"""URL splitting with built-in regex functions (no UDF).

Splits like Python's ``urllib.parse.urlparse``: leading C0 controls/spaces
are dropped and tabs/newlines removed before splitting; the scheme is the
text before the first ``:`` when it is a valid scheme name (lower-cased); the
netloc follows ``//`` up to the first ``/``, ``?`` or ``#``; ``;params`` are
cut from the last path segment.  ``parse_url`` is not used: it returns a null
host for ``_``, spaces or non-ASCII hosts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# RFC 3986 appendix B split, group 1 scheme, 2 netloc, 3 path, 4 query, 5 fragment
URL_SPLIT_RE = (
    r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
)


def _clean_for_split(url: Column) -> Column:
    u = F.regexp_replace(url, r"^[\x00-\x20]+", "")
    return F.regexp_replace(u, r"[\t\r\n]", "")


def with_default_scheme(url: Column) -> Column:
    """Prefix ``https://`` when ``://`` appears nowhere in the text."""
    return F.when(url.contains("://"), url).otherwise(F.concat(F.lit("https://"), url))


def split_url(url: Column) -> dict[str, Column]:
    """Scheme (lower), netloc, path (without ``;params``) and query of ``url``."""
    u = _clean_for_split(url)
    scheme = F.lower(F.regexp_extract(u, URL_SPLIT_RE, 1))
    netloc = F.regexp_extract(u, URL_SPLIT_RE, 2)
    path = F.regexp_replace(F.regexp_extract(u, URL_SPLIT_RE, 3), r";[^/]*$", "")
    query = F.regexp_extract(u, URL_SPLIT_RE, 4)
    return {"scheme": scheme, "netloc": netloc, "path": path, "query": query}


def netloc_of(url: Column) -> Column:
    return F.regexp_extract(_clean_for_split(url), URL_SPLIT_RE, 2)


def host_of_netloc(netloc: Column) -> Column:
    """``netloc.split('@')[-1].split(':')[0]``: drop userinfo, then the port."""
    return F.substring_index(F.element_at(F.split(netloc, "@"), -1), ":", 1)


def domain_key(url: Column) -> Column:
    """Scan domain: the netloc of the (scheme-defaulted) URL, else the URL itself."""
    return F.coalesce(F.nullif(netloc_of(with_default_scheme(url)), F.lit("")), url)


def join_host(domain: Column) -> Column:
    """Host used to look a domain up in record tables: no userinfo, no port, lower case."""
    return F.lower(host_of_netloc(domain))


_IPV4 = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IPV4_TAIL = rf":{_IPV4}(?:[.]{_IPV4}){{3}}$"
_GROUPS = r"[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*"


def is_ipv6(text: Column) -> Column:
    """True when ``text`` is an IPv6 address: eight groups of one to four hex digits, one run of
    which may be left out as ``::``; a dotted IPv4 address may stand for the last two; a zone
    may follow a ``%`` (not empty, without another ``%``)."""
    zone = F.substring_index(text, "%", -1)
    zone_ok = ~text.contains("%") | ((F.length(text) - F.length(F.replace(text, F.lit("%"))) == 1) & (zone != ""))
    groups = F.regexp_replace(F.substring_index(text, "%", 1), _IPV4_TAIL, ":0:0")
    n = F.size(F.filter(F.split(groups, ":"), lambda g: g != ""))
    whole = groups.rlike(rf"\A{_GROUPS}\z") & (n == 8)
    shortened = groups.rlike(rf"\A(?:{_GROUPS})?::(?:{_GROUPS})?\z") & (n <= 7)
    return zone_ok & (whole | shortened)


def is_ip_future(text: Column) -> Column:
    return text.rlike(r"\Av[0-9A-Fa-f]+[.][^\n]+\z")


def bad_netloc(stripped: Column) -> Column:
    """True when the URL parser would reject the netloc of the request.

    ``stripped`` is the stripped request text, which gets ``https://`` put in front
    unless it starts with ``http(s)://``.  A netloc with a bracket is accepted only as
    ``[literal]`` of an IPv6 / IPvFuture literal; user info without brackets may precede it, a port follow it.
    """
    url = F.concat(F.when(stripped.rlike("^https?://"), F.lit("")).otherwise(F.lit("https://")), stripped)
    netloc = netloc_of(url)
    host = F.substring_index(netloc, "@", -1)
    literal = F.substring_index(F.substring(host, 2, 1 << 30), "]", 1)
    after = F.substring(host, F.length(literal) + 3, F.lit(1 << 30))
    user_info = F.left(netloc, F.length(netloc) - F.length(host))
    closed = ~user_info.rlike(r"[\[\]]") & host.startswith("[") & host.contains("]") & ((after == "") | after.startswith(":"))
    ok = F.when(literal.startswith("v"), is_ip_future(literal)).otherwise(is_ipv6(literal))
    # few requests have a bracket: the rest is computed for those only
    return F.when(stripped.rlike(r"[\[\]]"), netloc.rlike(r"[\[\]]") & ~(closed & ok)).otherwise(F.lit(False))
