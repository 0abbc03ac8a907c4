"""URLs as column expressions: parts, parameters, a normal form, and links against the page that has them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the generic form of an address (RFC 3986, appendix B).
_FORM = r"^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#([\s\S]*))?"
#: Ports that go without saying, and beginnings of parameters that only say where a visitor came from.
DEFAULT_PORTS = {"http": "80", "https": "443"}
TRACKING = ("utm_",)


def _part(url: Column, n: int) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _FORM, n)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 2))


def host(url: Column) -> Column:
    """Lower-case, without user and port; empty where there is none."""
    return F.lower(F.regexp_extract(_part(url, 4), r"^(?:[^@]*@)?([^:]*)", 1))


def port(url: Column) -> Column:
    return F.regexp_extract(_part(url, 4), r":(\d+)$", 1)


def path(url: Column) -> Column:
    return _part(url, 5)


def query(url: Column) -> Column:
    return _part(url, 7)


def fragment(url: Column) -> Column:
    return _part(url, 9)


def parts(url: Column) -> Column:
    """struct of scheme, host, port, path, query and fragment, each empty where there is none."""
    return F.struct(scheme(url).alias("scheme"), host(url).alias("host"), port(url).alias("port"), path(url).alias("path"), query(url).alias("query"), fragment(url).alias("fragment"))


def parameters(asked: Column) -> Column:
    """array of (name, value) of a query, in order; those without a value are left out, a plus is a space, and what is no valid escape stays."""
    pairs = F.filter(F.split(F.coalesce(asked, F.lit("")), "&"), lambda x: F.rlike(x, F.lit("^[^=]*=.+$")))
    plain = lambda x: F.coalesce(F.try_url_decode(x), x)
    return F.transform(pairs, lambda x: F.struct(plain(F.substring_index(x, "=", 1)).alias("name"), plain(F.regexp_extract(x, "^[^=]*=(.*)$", 1)).alias("value")))


def normal(url: Column) -> Column:
    """One form of all addresses of a page: lower-case scheme and host, no www., no usual port, no index page or last slash, parameters in order without tracking ones, no fragment."""
    at = F.regexp_replace(host(url), r"^www\.", "")
    usual = F.lit(False)
    for s, p in DEFAULT_PORTS.items():
        usual = usual | (scheme(url) == s) & (port(url) == p)
    number = F.when((port(url) == "") | usual, "").otherwise(F.concat(F.lit(":"), port(url)))
    where = F.regexp_replace(F.regexp_replace(path(url), r"/index\.html?$", "/"), "/+$", "")
    kept = F.filter(F.split(query(url), "&"), lambda x: (x != "") & ~F.rlike(x, F.lit(f"^({'|'.join(TRACKING)})")))
    said = F.array_join(F.array_sort(kept), "&")
    return F.concat(scheme(url), F.lit("://"), at, number, where, F.when(said == "", "").otherwise(F.concat(F.lit("?"), said)))


def resolved(base: Column, link: Column) -> Column:
    """A link of a page as a whole address; dot segments stay as they are."""
    root = F.concat(scheme(base), F.lit("://"), _part(base, 4))
    whole = F.when(_part(link, 2) != "", link).when(F.startswith(link, F.lit("//")), F.concat(scheme(base), F.lit(":"), link)).when(F.startswith(link, F.lit("/")), F.concat(root, link))
    folder = F.regexp_replace(path(base), "[^/]*$", "")
    same = F.concat(root, path(base))
    whole = whole.when(F.startswith(link, F.lit("?")), F.concat(same, link)).when(F.startswith(link, F.lit("#")), F.concat(same, F.when(query(base) == "", "").otherwise(F.concat(F.lit("?"), query(base))), link))
    return whole.when(link == "", base).otherwise(F.concat(root, F.when(folder == "", "/").otherwise(folder), link))
