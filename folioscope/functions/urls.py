"""Canonical URLs and crawl scope as Column expressions."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that stay as they are in a printed path, and their form-encoded spellings.
KEPT_IN_PATH = {"%24": "$", "%26": "&", "%2B": "+", "%2C": ",", "%2F": "/", "%3A": ":", "%3B": ";", "%3D": "=", "%40": "@", "%7E": "~"}
PLAIN_PATH = r"^[A-Za-z0-9\-_.~$&+,/:;=@]*$"
WHOLE_URL = r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*):\/\/([^\/?]*)([^?]*)(.*)$"


def clean_path(path: Column) -> Column:
    """Rooted path without empty, ``.`` and ``..`` segments; a final slash is kept."""
    steps = F.aggregate(
        F.filter(F.split(path, "/"), lambda s: (s != "") & (s != ".")),
        F.array().cast("array<string>"),
        lambda done, s: F.when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(
            F.concat(done, F.array(s))
        ),
    )
    joined = F.concat(F.lit("/"), F.array_join(steps, "/"))
    cleaned = F.when(F.endswith(path, F.lit("/")) & (joined != "/"), F.concat(joined, F.lit("/"))).otherwise(joined)
    return F.when(~F.rlike(path, F.lit(r"//|/\.\.?(/|$)")) & F.startswith(path, F.lit("/")), path).otherwise(cleaned)


def _respelled(path: Column) -> Column:
    """Percent-decoded and encoded again; a path with a broken escape is encoded as it stands."""
    decoded = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    encoded = F.replace(F.replace(F.url_encode(decoded), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))
    for code, char in KEPT_IN_PATH.items():
        encoded = F.replace(encoded, F.lit(code), F.lit(char))
    return encoded


def canonical_url(url: Column) -> Column:
    """One spelling for a URL: no fragment, lower-case scheme and host, no default port, cleaned path.

    A final slash and the query are kept. Null stays null; text that is not ``scheme://host...`` only loses its
    fragment.
    """
    bare = F.regexp_replace(url, r"(?s)#.*$", "")
    part = lambda i: F.regexp_extract(bare, WHOLE_URL, i)
    scheme, path = F.lower(part(1)), part(3)
    user = F.regexp_extract(part(2), r"^(.*@)?", 0)
    host = F.lower(F.regexp_replace(part(2), r"^.*@", ""))
    host = F.when((scheme == "http") & F.endswith(host, F.lit(":80")), F.regexp_replace(host, ":80$", "")).when(
        (scheme == "https") & F.endswith(host, F.lit(":443")), F.regexp_replace(host, ":443$", "")
    ).otherwise(host)
    cleaned = clean_path(path)
    printed = F.when(F.rlike(cleaned, F.lit(PLAIN_PATH)), cleaned).otherwise(_respelled(cleaned))
    return F.when(F.rlike(bare, F.lit(WHOLE_URL)), F.concat(scheme, F.lit("://"), user, host, printed, part(4))).otherwise(bare)


def url_origin(url: Column) -> Column:
    return F.regexp_extract(url, r"^([^:/?#]+://[^/?#]*)", 1)


def url_path(url: Column) -> Column:
    path = F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)
    return F.when(path == "", F.lit("/")).otherwise(path)


def in_scope(url: Column, seed: Column) -> Column:
    """Same origin, and the path is the seed's path or lies below it; a seed at the root takes the whole origin."""
    base = F.regexp_replace(url_path(seed), "/$", "")
    path = url_path(url)
    return (url_origin(url) == url_origin(seed)) & (
        (base == "") | (path == base) | F.startswith(path, F.concat(base, F.lit("/")))
    )


def scope_test(seed: str) -> Callable[[str], bool]:
    """``in_scope`` for redirects, which are met one by one inside a fetching task. ``seed`` is canonical."""
    root = urlsplit(seed)
    base = root.path.removesuffix("/")

    def allowed(url: str) -> bool:
        to = urlsplit(url)
        return (to.scheme.lower(), to.netloc.lower()) == (root.scheme, root.netloc) and (not base or to.path == base or to.path.startswith(f"{base}/"))

    return allowed
