"""Scalar text functions X1-X12, X16-X17 as Column expressions (JVM-side)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def slug(x) -> Column:
    """Runs of non-alphanumerics -> '_', lower case, then one leading and
    one trailing '_' removed."""
    s = F.lower(F.regexp_replace(_c(x), r"[^A-Za-z0-9]+", "_"))
    return F.regexp_replace(s, r"^_|_$", "")


# Acronyms upper-cased in layer labels, in the order applied.
ACRONYMS = ("nhd", "nwi", "epa", "faa", "fcc", "cdc", "usgs", "osm", "usa", "gbif",
            "nrhp", "tiger", "fema", "ev", "acs", "lodes", "nwis", "nwps", "nps", "nlcd")


def nice_label(x) -> Column:
    """X2: '_' -> ' ', known acronyms upper-cased on word boundaries
    (case-insensitive), first character upper-cased."""
    s = F.regexp_replace(_c(x), "_", " ")
    for a in ACRONYMS:
        s = F.regexp_replace(s, rf"(?i)\b{a}\b", a.upper())
    return F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 1 << 30))


# Characters a URL keeps unescaped besides letters, digits and
# '._~-' (the reserved set), with their percent codes.
RESERVED = {"!": "%21", "#": "%23", "$": "%24", "&": "%26", "'": "%27", "(": "%28",
            ")": "%29", "*": "%2A", "+": "%2B", ",": "%2C", "/": "%2F", ":": "%3A",
            ";": "%3B", "=": "%3D", "?": "%3F", "@": "%40", "[": "%5B", "]": "%5D", "~": "%7E"}


def url_path_encode(x) -> Column:
    """Percent-encode UTF-8 bytes except unreserved and reserved characters;
    text that already holds a %XX escape is returned unchanged."""
    c = _c(x)
    enc = F.url_encode(F.regexp_replace(c, " ", "%20"))
    # url_encode turns the '%' of our pre-escaped spaces into %25
    enc = F.replace(enc, F.lit("%2520"), F.lit("%20"))
    enc = reduce(lambda acc, kv: F.replace(acc, F.lit(kv[1]), F.lit(kv[0])), RESERVED.items(), enc)
    return F.when(c.rlike("%[0-9A-Fa-f]{2}"), c).otherwise(enc)


def wiki_url(title, base: str = "https://en.wikipedia.org/wiki/") -> Column:
    """Article URL: spaces -> '_', then percent-encoded as a path."""
    return F.concat(F.lit(base), url_path_encode(F.regexp_replace(_c(title), " ", "_")))


def curid_url(pageid, base: str = "https://en.wikipedia.org/?curid=") -> Column:
    """Id URL."""
    return F.concat(F.lit(base), _c(pageid).cast("string"))


def split_id(x, i: int) -> Column:
    """Part ``i`` (1-based) of 'schema.table' split on the literal dot."""
    return F.split_part(_c(x), F.lit("."), F.lit(i))


def join_id(schema, table) -> Column:
    return F.concat_ws(".", _c(schema), _c(table))


def coalesce_na(a, b) -> Column:
    """X7 (first flavour): null or NaN counts as missing."""
    a = _c(a)
    return F.when(a.isNull() | F.isnan(a), _c(b)).otherwise(a)


def coalesce_empty(a, b) -> Column:
    """X7 (second flavour): null or empty string counts as missing."""
    a = _c(a)
    return F.when(a.isNull() | (a == ""), _c(b)).otherwise(a)


def thousands(n) -> Column:
    """Integer with ',' thousands separators."""
    return F.format_number(_c(n).cast("long"), 0)


def tick_label(v) -> Column:
    """Legend tick: values >= 1000 as round(v/1000)'k'."""
    v = _c(v)
    return F.when(v >= 1000, F.concat(F.round(v / 1000, 0).cast("long").cast("string"), F.lit("k"))) \
        .otherwise(F.regexp_replace(v.cast("string"), r"\.0$", ""))


def safe_double(x) -> Column:
    """Numeric cast, null on failure."""
    return _c(x).cast("string").try_cast("double")


def permalink(lat, lon, zoom, layer_ids) -> Column:
    """X10: '?c=lat,lon&z=zoom&l=id|id' with 5 and 1 decimals; parts whose
    value is null are left out."""
    c = F.format_string("%.5f,%.5f", _c(lat), _c(lon))
    parts = F.array(
        F.when(_c(lat).isNotNull() & _c(lon).isNotNull(), F.concat(F.lit("c="), c)),
        F.concat(F.lit("z="), F.regexp_replace(F.round(_c(zoom), 1).cast("string"), r"\.0$", "")),
        F.when(F.size(_c(layer_ids)) > 0, F.concat(F.lit("l="), F.array_join(_c(layer_ids), "|"))))
    return F.concat(F.lit("?"), F.array_join(F.filter(parts, lambda p: p.isNotNull()), "&"))


def permalink_center(url) -> tuple[Column, Column, Column]:
    """X10 decode: (lat, lon, zoom) from the query string; only c and z are
    restored (layers are not)."""
    q = F.regexp_extract(_c(url), r"\?(.*)$", 1)
    m = F.str_to_map(q, F.lit("&"), F.lit("="))
    c = F.split(F.element_at(m, F.lit("c")), ",")
    ok = F.size(c) == 2
    lat = F.when(ok, F.get(c, 0).try_cast("double"))
    lon = F.when(ok, F.get(c, 1).try_cast("double"))
    z = F.element_at(m, F.lit("z")).try_cast("double")
    return lat, lon, z


def shortened(v, max_len: int = 120) -> Column:
    """F18 (popup rows): the value as text, its first ``max_len`` characters."""
    return F.substring(_c(v).cast("string"), 1, max_len)


def clean_value(v, max_len: int = 80) -> Column:
    """trimmed text; null when empty, 'NA' or longer than ``max_len``."""
    t = F.trim(_c(v).cast("string"))
    return F.when(t.isNull() | (t == "") | (t == "NA") | (F.length(t) > max_len), None).otherwise(t)
