"""Links of pages as absolute URLs, by RFC 3986, as one expression.

Parts of a URL come from one pattern; a relative path is put behind the folder of the page's path and its segments are
folded over a stack, on which ``..`` takes the last one off and ``.`` does nothing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import once

#: Scheme, authority with its slashes, path, query and fragment of a URL.
URL_PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(//[^/?#]*)?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def url_part(url: Column, name: str) -> Column:
    """One of scheme (in lower case), authority (with //), path, query and fragment; empty where the URL has none."""
    part = F.regexp_extract(url, URL_PARTS, ("scheme", "authority", "path", "query", "fragment").index(name) + 1)
    return F.lower(part) if name == "scheme" else part


def url_parts(url: Column) -> Column:
    """struct of all of them."""
    return F.struct(*[url_part(url, name).alias(name) for name in ("scheme", "authority", "path", "query", "fragment")])


def folded_path(segments: Column) -> Column:
    """A path of segments, without . and .. among them; too many .. end at the root."""
    empty = F.array().cast("array<string>")
    up = lambda done: F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
    step = lambda done, s: F.when(s == "..", up(done)).when(s == ".", done).otherwise(F.concat(done, F.array(s)))
    folder = lambda given: F.element_at(given, -1).isin(".", "..")  # noqa: E731 - such a path names a folder
    path = lambda given: F.concat(F.array_join(F.when(F.exists(given, lambda s: s.isin(".", "..")), F.aggregate(given, empty, step)).otherwise(given), "/"), F.when(folder(given), "/").otherwise(""))
    rooted = lambda p: F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p))
    return once(segments, lambda given: once(path(given), rooted))


def resolved(href: Column, base: Column) -> Column:
    """A reference on a page as an absolute URL, if the page's own is absolute.

    White space before it and line breaks inside don't count. Another scheme than the page's makes it absolute as it
    stands; an authority, a path, a query or a fragment alone take what stands before them from the page. An empty
    reference is the page itself. Null if either is null.
    """
    ref = F.regexp_replace(F.regexp_replace(href, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")
    both = F.struct(href.alias("href"), base.alias("base"), url_parts(ref).alias("ref"), url_parts(base).alias("page"))
    return once(both, lambda b: _joined(b["href"], b["base"], b["ref"], b["page"]))


def _joined(href: Column, base: Column, ref: Column, page: Column) -> Column:
    start = F.regexp_extract(page["path"], r"(?s)^(.*/)", 1)
    merged = F.split(F.concat(F.when(start == "", "/").otherwise(start), ref["path"]), "/")
    inner = lambda m: F.filter(F.slice(m, F.lit(2), F.size(m) - 2), lambda s: s != "")
    merged = once(merged, lambda m: F.concat(F.slice(m, 1, 1), inner(m), F.slice(m, -1, 1)))
    segments = F.when(ref["path"].startswith("/"), F.split(ref["path"], "/")).otherwise(merged)
    path = F.when((ref["authority"] != "") | ((ref["path"] == "") & (page["path"] == "")), ref["path"]).when(ref["path"] == "", page["path"]).otherwise(folded_path(segments))
    query = F.when((ref["authority"] == "") & (ref["path"] == "") & (ref["query"] == ""), page["query"]).otherwise(ref["query"])
    authority = F.when(ref["authority"] != "", ref["authority"]).otherwise(page["authority"])
    marked = lambda sign, part: F.when(part != "", F.concat(F.lit(sign), part)).otherwise("")
    own = (ref["scheme"] != "") & (ref["scheme"] != page["scheme"])
    joined = F.concat(page["scheme"], F.lit(":"), authority, path, once(query, lambda q: marked("?", q)), marked("#", ref["fragment"]))
    return F.when(href == "", base).when(own, href).otherwise(joined)


def web_link(href: Column, base: Column) -> Column:
    """resolved(), or null for what isn't a page on the web: javascript:, mailto:, data: and the like."""
    link = once(F.replace(href, F.lit("&amp;"), F.lit("&")), lambda h: resolved(h, base))
    return once(link, lambda l: F.when(l.rlike(r"(?i)^https?://[^/?#]"), l))


#: web_link(href, base) in DuckDB, over columns href and base; the path is folded as text there, cut at its last slash for each step up.
_P = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(//[^/?#]*)?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
WEB_LINK_SQL = rf"""(SELECT CASE WHEN regexp_matches(l, '^(?i:https?)://[^/?#]') THEN l END FROM (
    SELECT CASE WHEN h = '' THEN base WHEN s <> '' AND s <> bs THEN h ELSE bs || ':' || CASE WHEN a <> '' THEN a || p
        WHEN p = '' THEN ba || bp ELSE ba || CASE WHEN f = '' THEN '/' WHEN regexp_matches(p, '(^|/)[.][.]?$') AND NOT suffix(f, '/') THEN f || '/' ELSE f END END
        || CASE WHEN q <> '' THEN '?' || q WHEN a = '' AND p = '' AND bq <> '' THEN '?' || bq ELSE '' END || CASE WHEN g <> '' THEN '#' || g ELSE '' END END AS l
    FROM (SELECT *, list_reduce(list_prepend('', CASE WHEN starts_with(p, '/') THEN string_split(p, '/')[2:] ELSE
            list_filter(string_split(regexp_replace(bp, '[^/]*$', '') || regexp_replace(p, '/[^/]*$', ''), '/'), lambda x: x <> '')
            || CASE WHEN contains(p, '/') THEN [regexp_extract(p, '/([^/]*)$', 1)] ELSE [] END END),
            lambda acc, x: CASE WHEN x = '..' THEN regexp_replace(acc, '/[^/]*$', '') WHEN x = '.' THEN acc ELSE acc || '/' || x END) AS f
        FROM (SELECT h, lower(regexp_extract(r, '{_P}', 1)) AS s, regexp_extract(r, '{_P}', 2) AS a, regexp_extract(r, '{_P}', 3) AS p, regexp_extract(r, '{_P}', 4) AS q, regexp_extract(r, '{_P}', 5) AS g,
                lower(regexp_extract(base, '{_P}', 1)) AS bs, regexp_extract(base, '{_P}', 2) AS ba, regexp_extract(base, '{_P}', 3) AS bp, regexp_extract(base, '{_P}', 4) AS bq
            FROM (SELECT h, ltrim(h, ' ') AS r FROM (SELECT replace(href, '&amp;', '&') AS h))))))"""
