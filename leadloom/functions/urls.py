"""URL columns: host names and relative references."""

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"


def netloc(url: Column) -> Column:
    """Authority in lower case, with port and user part; '' when there is none."""
    return F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))


def site_domain(url: Column) -> Column:
    """Authority without a leading ``www.``."""
    return F.regexp_replace(netloc(url), r"^www\.", "")


def bare_domain(url: Column) -> Column:
    """Authority without any ``www.`` in it."""
    return F.replace(netloc(url), F.lit("www."), F.lit(""))


def remove_dots(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments; ``..`` never climbs above the root."""
    parts = F.split(path, "/")
    folded = F.aggregate(
        parts, F.expr("cast(array() as array<string>)"),
        lambda acc, p: F.when(p == ".", acc)
        .when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.least(F.lit(1), F.size(acc)))))
        .otherwise(F.concat(acc, F.array(p))))
    joined = F.concat(F.array_join(folded, "/"),
                      F.when(path.rlike(r"/\.\.?$"), F.lit("/")).otherwise(F.lit("")))
    return F.when(path.rlike(r"/\.\.?(/|$)"), F.regexp_replace(joined, "^/*", "/")).otherwise(path)


def resolve(base: Column, href: Column) -> Column:
    """Absolute URL of ``href`` as met on page ``base``; the fragment is kept."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    base_path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    folder = F.regexp_replace(F.when(base_path == "", F.lit("/")).otherwise(base_path),
                              "[^/]*$", "")
    path = F.regexp_extract(href, r"^([^?#]*)", 1)
    tail = F.regexp_extract(href, r"^[^?#]*(.*)$", 1)
    # Empty segments in the middle of a joined path vanish.
    relative = F.regexp_replace(F.concat(folder, path), "/{2,}", "/")
    return (F.when(href == "", base)
            .when(href.rlike(_SCHEME), href)
            .when(href.startswith("//"), F.concat(scheme, href))
            .when(href.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), href))
            .when(href.startswith("?"), F.concat(root, base_path, href))
            .when(href.startswith("/"), F.concat(root, remove_dots(path), tail))
            .otherwise(F.concat(root, remove_dots(relative), tail)))
