"""URLs: canonical form, same site, frontier order, safety. Column expressions for absolute URLs."""

from __future__ import annotations

import ipaddress
import re
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Query parameters that track, never identify.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "gclid", "fbclid", "msclkid", "mc_cid", "mc_eid", "ref", "_ga", "igshid")
_PARTS = r"(?i)^([a-z][a-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
#: Addresses that are in canonical form but for a fragment: most are, and are told by one match in place of some thirty.
_PLAIN = r"^(https?://[a-z0-9-]+(?:\.[a-z0-9-]+)*(?!.*/(?i:index)\.)(?:/|(?:/[\x21-\x7e&&[^/?#]]+)+))(?:#[\x21-\x7e]*)?\z"


def part(url: Column, k: int) -> Column:
    return F.regexp_extract(url, _PARTS, k)


def host(url: Column) -> Column:
    name = F.lower(F.regexp_replace(F.regexp_replace(part(url, 2), r"^.*@", ""), r":[0-9]*$", ""))
    return F.regexp_replace(name, r"\.$", "")


def path(url: Column) -> Column:
    got = part(url, 3)
    return F.when(got == "", F.lit("/")).otherwise(got)


def normalise(url: Column) -> Column:
    """No fragment, lower-case host without trailing dot or default port, no tracking parameters, sorted query, single
    slashes, no index page, no trailing slash. Absolute URLs; NULL for others."""
    scheme = F.lower(part(url, 1))
    port = F.regexp_extract(part(url, 2), r":([0-9]+)$", 1)
    default = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")) | (port == "")
    pairs = F.filter(F.split(F.substring(part(url, 4), 2, 1 << 20), "&"), lambda p: (p != "") & ~F.lower(F.regexp_extract(p, "^([^=]*)", 1)).isin(*TRACKING))
    keyed = F.transform(pairs, lambda p, i: F.struct(F.regexp_extract(p, "^([^=]*)", 1).alias("k"), i.alias("i"), p.alias("p")))
    query = F.array_join(F.transform(F.array_sort(keyed), lambda x: x["p"]), "&")
    tidy = F.regexp_replace(F.regexp_replace(path(url), r"(?i)/index\.(html?|php)$", "/"), "/{2,}", "/")
    tidy = F.when(F.length(tidy) > 1, F.regexp_replace(tidy, "/$", "")).otherwise(tidy)
    whole = F.concat(scheme, F.lit("://"), host(url), F.when(default, F.lit("")).otherwise(F.concat(F.lit(":"), port)), tidy, F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)))
    return F.when(url.rlike(_PLAIN), F.regexp_extract(url, _PLAIN, 1)).when(url.rlike(_PARTS), whole)


def absolute(url: Column) -> Column:
    """Whether normalise has an address for url, without working it out."""
    return F.coalesce(url.rlike(_PARTS), F.lit(False))


def site(url: Column) -> Column:
    """Host without www."""
    return F.regexp_replace(host(url), r"^www\.", "")


def same_site(a: Column, b: Column) -> Column:
    return site(a) == site(b)


def _ranked(path_: Column, rules, other: int) -> Column:
    found = None
    for pattern, n in rules:
        found = F.when(path_.rlike(pattern), n) if found is None else found.when(path_.rlike(pattern), n)
    return found.otherwise(other)


#: Path classes and their order, for the crawl frontier and for sitemap entries.
FRONTIER = [(r"^/?$", 0), (r"/(?:products?|item)/", 1), (r"/(?:collections?|categor|shop|store)", 2), (r"/(?:about|contact|faq|shipping|returns|policies|policy|terms)", 3), (r"/(?:blogs?|news|articles?|posts?|tag|author)/", 6)]
SITEMAP = [(r"/products?/", 0), (r"/(collections?|category|categories|shop|store)/", 1), (r"/(about|contact|faq|shipping|returns|policies|policy|terms)", 2), (r"/(blog|news|articles?|posts?|tag|author)/", 4)]


def frontier_class(url: Column) -> Column:
    return _ranked(F.lower(path(url)), FRONTIER, 4)


def sitemap_class(url: Column) -> Column:
    return _ranked(path(url), SITEMAP, 3)


#: Networks that no crawl may reach, wider than the registry's where the contract is; host names and ends.
PRIVATE = [ipaddress.ip_network(n) for n in ("0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/16", "192.168.0.0/16", "198.18.0.0/15", "198.51.0.0/16", "203.0.0.0/16", "224.0.0.0/3")]
#: NAT64, Teredo, 6to4 and documentation: addresses that carry another or lead nowhere.
PRIVATE_6 = [ipaddress.ip_network(n) for n in ("64:ff9b::/32", "2001::/32", "2001:db8::/32", "2002::/16")]
LOCAL_NAMES, LOCAL_ENDS = ("localhost", "metadata"), (".localhost", ".local", ".internal", ".intranet", ".home.arpa", ".lan")


def ipv4(text: str) -> int | None:
    """A host in any spelling that resolvers take for an IPv4 address (octal, hex, fewer parts), as a number."""
    parts = text.rstrip(".").split(".")
    if not 1 <= len(parts) <= 4:
        return None
    values = []
    for p in parts:
        try:
            values.append(int(p, 16) if p[:2].lower() == "0x" else int(p, 8) if len(p) > 1 and p[0] == "0" else int(p))
        except ValueError:
            return None
    *heads, last = values
    if any(not 0 <= v <= 255 for v in heads) or not 0 <= last < 256 ** (5 - len(values)):
        return None
    return sum(v << (24 - 8 * i) for i, v in enumerate(heads)) + last


#: Addresses of a host with a dotted name, no port and no user; a last label that starts with a letter is in no number. Most
#: are of this kind, which the parsers take some 20 microseconds to find out.
_NAMED = re.compile(r"https?://((?:[a-z0-9-]+\.)+[a-z][a-z0-9-]*)(?:[/?#][!-~]*)?")
#: Addresses of plain characters, which a link may be as it stands, and paths that are put behind their page's host.
_PAGE, _ROOTED = re.compile(r"(https?://[a-z0-9.-]+)(?:/[\w~%./-]*)?(?:#[\w-]+)?", re.ASCII), re.compile(r"(?:/[\w~%-]+)+", re.ASCII)


def unsafe_reason(url: str | None) -> str | None:
    """Why a URL must not be fetched, None if it may be."""
    url = (url or "").strip()
    if not url or len(url) > 2048:
        return "too-long" if url else "invalid"
    named = _NAMED.fullmatch(url)
    if named and not named[1].endswith(LOCAL_ENDS):
        return None
    try:
        u = urlsplit(url)
        name, port = (u.hostname or "").rstrip("."), u.port
    except ValueError:
        return "invalid"
    if u.scheme not in ("http", "https"):
        return "scheme"
    if not name:
        return "invalid"
    if u.username or u.password:
        return "credentials"
    if port not in (None, 80, 443):
        return "port"
    if name in LOCAL_NAMES or name.endswith(LOCAL_ENDS):
        return "private-host"
    address = ipv4(name)
    if address is None and ":" in name:
        try:
            six = ipaddress.IPv6Address(name.split("%")[0])
        except ValueError:
            return "invalid"
        if six.ipv4_mapped is None:
            return None if six.is_global and not any(six in n for n in PRIVATE_6) else "private-host"
        address = int(six.ipv4_mapped)
    if address is None and re.fullmatch(r"(?i)[0-9]+|0x[0-9a-f]*", name.rpartition(".")[2]):
        return "invalid"  # a name that ends in a number has to be an address
    if address is not None:
        return "private-host" if any(ipaddress.ip_address(address) in n for n in PRIVATE) else None
    return None


@F.pandas_udf(StringType())
def unsafe_url(urls: pd.Series) -> pd.Series:
    """unsafe_reason over a column; address spellings need a parser that SQL lacks."""
    return urls.map(unsafe_reason, na_action=None)


def _joined(link, base) -> str | None:
    page = _PAGE.fullmatch(base) if isinstance(link, str) and isinstance(base, str) else None
    if page and _PAGE.fullmatch(link):
        return link
    if page and _ROOTED.fullmatch(link):
        return page[1] + link
    try:
        return urljoin(base, link.strip()) if isinstance(link, str) and isinstance(base, str) else None
    except ValueError:
        return None


@F.pandas_udf(StringType())
def resolve(links: pd.Series, base: pd.Series) -> pd.Series:
    """Relative links against their page; NULL for what is no address."""
    return pd.Series([_joined(a, b) for a, b in zip(links, base)], dtype=object)
