"""References resolved against the page they stand on, as RFC 3986 says, by column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scheme with colon, authority with slashes, path, query with mark, fragment with mark (appendix B).
URI = r"^([A-Za-z][A-Za-z0-9+.-]*:)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?"
PARTS = ("scheme", "host", "path", "query", "fragment")
DOTS = r"(?:^|/)\.{1,2}(?:/|$)"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is named."""
    return F.transform(F.array(value), use)[0]


def uri_parts(uri: Column) -> Column:
    """Struct of a URI's parts, each with its marks; what is absent is empty."""
    return F.struct(*(F.regexp_extract(uri, URI, i).alias(c) for i, c in enumerate(PARTS, 1)))


def without_dots(path: Column) -> Column:
    """A path without its . and .. segments."""

    def step(done: Column, s: Column) -> Column:
        popped = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1)))
        return F.when(s == ".", done).when(s == "..", popped).otherwise(F.concat(done, F.array(s)))

    def made(parts: Column) -> Column:
        kept = F.aggregate(F.slice(parts, F.lit(2), F.size(parts) - 1), F.slice(parts, 1, 1), step)
        return F.concat(F.array_join(kept, "/"), F.when(F.element_at(parts, -1).isin(".", ".."), "/").otherwise(""))

    return let(path, lambda p: F.when(p.rlike(DOTS), let(F.split(p, "/"), made)).otherwise(p))


def resolve(link: Column, base: Column) -> Column:
    """A reference resolved against a base, given as uri_parts; without a base scheme it stays."""
    whole = let(uri_parts(link), lambda r: F.when((base["scheme"] == "") & (r["scheme"] == ""), link).otherwise(_absolute(r, base, link)))
    # most links of a page are paths from its root
    rooted = link.startswith("/") & ~link.startswith("//") & ~link.contains(".") & (base["scheme"] != "")
    return F.when(rooted, F.concat(base["scheme"], base["host"], link)).otherwise(whole)


def _absolute(ref: Column, base: Column, link: Column) -> Column:
    scheme, host, path, query, fragment = (ref[c] for c in PARTS)
    root = F.concat(base["scheme"], base["host"])
    same = F.concat(root, base["path"], F.when(query == "", base["query"]).otherwise(query), fragment)
    folder = F.regexp_extract(base["path"], "^(.*/)", 1)
    folder = F.when(base["path"].contains("/"), folder).when(base["host"] != "", "/").otherwise("")
    return (
        F.when((scheme != "") & (host == ""), link)
        .when(scheme != "", F.concat(scheme, host, without_dots(path), query, fragment))
        .when(host != "", F.concat(base["scheme"], host, without_dots(path), query, fragment))
        .when(path == "", same)
        .when(path.startswith("/"), F.concat(root, without_dots(path), query, fragment))
        .otherwise(F.concat(root, without_dots(F.concat(folder, path)), query, fragment))
    )
