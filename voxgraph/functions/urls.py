"""Column functions over URLs. Malformed and null URLs give null, never an error."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed: query parameters that only track; all that begin with utm_ do too.
TRACKING = ("feedtype", "feedname", "utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term", "tracking_source", "campaign_id", "odyssey", "ref", "rss", "psp")
#: Suffixes of two labels under which names are registered, besides all of one label.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.za", "co.in", "co.jp", "co.kr", "com.br", "com.mx", "com.ar", "com.cn", "com.tr", "com.sg", "com.hk", "com.tw")
#: Fixed: hosts left out of samples.
BLOCKED = ("wordpress.com", "wikia.com", "gamereactor.eu", "myspace.com", "typepad.com")
PATH_ID = r"(?i)(id[A-Z0-9]{6,}|\.html(?:$|/)|/\d{8}/|/\d{5,})"


def part(url: Column, index: int) -> Column:
    """Group of a URL's five parts: 1 scheme, 2 host with port, 3 path, 4 query, 5 fragment; empty where absent."""
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$", index)


def host(url: Column) -> Column:
    """Lower-case host without port and user; empty where the text is no URL."""
    return F.lower(F.regexp_replace(F.regexp_replace(part(url, 2), r"^.*@", ""), r":\d+$", ""))


def domain_field(url: Column) -> Column:
    """The third field between slashes, empty where absent."""
    return F.coalesce(F.get(F.split(url, "/"), 2), F.lit(""))


def registered_domain(url: Column, suffixes: Sequence[str] = TWO_LABEL_SUFFIXES) -> Column:
    """The name registered under a public suffix; null without one."""
    h = host(url)
    labels = F.split(h, r"\.")
    last = lambda n: F.array_join(F.slice(labels, -n, n), ".")
    three = last(2).isin(list(suffixes))
    return F.when(h.rlike(r"^\d+(\.\d+){3}$") | (F.size(labels) < 2) | (h == ""), F.lit(None).cast("string")).when(three & (F.size(labels) >= 3), last(3)).when(~three, last(2))


def n_domains(urls: Column) -> Column:
    """Distinct registered domains of an array of URLs; those without count as one value."""
    return F.size(F.array_distinct(F.transform(urls, lambda u: F.coalesce(registered_domain(u), F.lit("")))))


def is_blocked(url: Column, blocked: Sequence[str] = BLOCKED) -> Column:
    """Whether the host, without one www., is a listed domain or below one."""
    h = F.regexp_replace(host(url), r"^www\.", "")
    out = F.lit(False)
    for d in blocked:
        out = out | (h == d) | h.endswith("." + d)
    return out


def rebuilt(url: Column, scheme: Column | None = None, netloc: Column | None = None, query: Column | None = None, bare: bool = False) -> Column:
    """The URL with parts replaced; with bare, without query and fragment."""
    tail = F.lit("")
    if not bare:
        q = part(url, 4) if query is None else query
        tail = F.concat(F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""), F.when(part(url, 5) != "", F.concat(F.lit("#"), part(url, 5))).otherwise(""))
    return F.concat(part(url, 1) if scheme is None else scheme, F.lit("://"), part(url, 2) if netloc is None else netloc, part(url, 3), tail)


def _http(x: Column) -> Column:
    return F.when(x.rlike("^https?://"), x)


def _decoded(x: Column) -> Column:
    return F.trim(F.coalesce(F.try_url_decode(x), x))


def unwrap_embedded(url: Column) -> Column:
    """The first query value that is a web address after decoding; null without."""
    values = F.transform(F.split(part(url, 4), "&"), lambda p: _decoded(F.regexp_extract(p, r"^[^=]*=(.*)$", 1)))
    return F.get(F.filter(values, lambda v: v.rlike("^https?://")), 0)


def unwrap_redirect(url: Column, redirect_host: str = "rd.yahoo.com") -> Column:
    """What follows the first star in an address of a redirecting host, if it is a web address; else null."""
    target = _decoded(F.regexp_extract(url, r"^[^*]*\*(.*)$", 1))
    return F.when(F.contains(host(url), F.lit(redirect_host)), _http(target))


def strip_tracking(url: Column) -> Column:
    """The URL without tracking parameters; null if it has none."""
    params = F.filter(F.split(part(url, 4), "&"), lambda p: p != "")
    kept = F.filter(params, lambda p: ~F.lower(F.substring_index(p, "=", 1)).isin(list(TRACKING)) & ~F.lower(p).startswith("utm_"))
    return F.when((F.size(params) > 0) & (F.size(kept) < F.size(params)), rebuilt(url, query=F.array_join(kept, "&")))


def strip_query(url: Column) -> Column:
    """The URL without query and fragment, if it has a query and the path names the page; else null."""
    return F.when((part(url, 4) != "") & part(url, 3).rlike(PATH_ID), rebuilt(url, bare=True))


def variants(url: Column, host_tweaks: bool = True) -> Column:
    """Array of (label, url): the address, its rewritten forms, and those with other scheme or host; each URL once."""
    yahoo, embedded = unwrap_redirect(url), unwrap_embedded(url)
    base = F.coalesce(yahoo, embedded, url)
    made = [("orig", url), ("yahoo", yahoo), ("embedded", embedded), ("no_tracking", strip_tracking(base)), ("no_query", strip_query(base))]
    if host_tweaks:
        for label, u in made[1:]:
            h = part(u, 2)
            made.append((f"{label}_https", F.when(part(u, 1) == "http", rebuilt(u, scheme=F.lit("https")))))
            made.append((f"{label}_bare", F.when(h.startswith("www."), rebuilt(u, netloc=F.substring(h, 5, 10_000)))))
            made.append((f"{label}_www", F.when(~h.startswith("www.") & F.contains(h, F.lit(".")), rebuilt(u, netloc=F.concat(F.lit("www."), h)))))
    pairs = F.array(*(F.struct(F.lit(label).alias("label"), u.alias("url")) for label, u in made))
    present = F.filter(pairs, lambda p: p["url"].isNotNull())
    urls = F.transform(present, lambda p: p["url"])
    return F.filter(present, lambda p, i: F.array_position(urls, p["url"]) == i + 1)


def has_material_rewrite(url: Column) -> Column:
    """Whether unwrapping or tracking removal gives another address."""
    return F.exists(variants(url, False), lambda v: v["label"].isin("yahoo", "embedded", "no_tracking"))


def archive_page(url: Column) -> Column:
    """An archived page's address in the form that serves the page as it was stored."""
    return F.regexp_replace(url, r"(/web/\d{4,14})/", "$1id_/")
