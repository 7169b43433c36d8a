"""Scalar text functions as column expressions."""

from __future__ import annotations

import html
import uuid

import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

from wayfold.functions.text import strip

#: What separates signals, and what is cut off their ends.
SIGNAL_BREAKS = r"""[ \t\n,，。、/\\|:：;；()（）\[\]【】<>《》"'“”‘’\-_+=*&·!！?？]+"""
SIGNAL_EDGES = """#,.，。!！?？:：;；/\\|()（）[]【】<>《》"'“”‘’`~"""
#: Words that are no keywords.
KEYWORD_STOPS = ["type", "title", "tag", "tags", "intro", "summary"]
#: Units of Chinese numerals.
CN_UNITS = {"万": 1e4, "亿": 1e8}


def distinct_fold(a: Column) -> Column:
    """The distinct elements without regard to case, first spelling kept."""
    lows = F.transform(a, F.lower)
    return F.filter(a, lambda x, i: F.array_position(lows, F.lower(x)) == i + 1)


def signals(c: Column) -> Column:
    """Pieces of at least two characters between signs, distinct without case."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), SIGNAL_BREAKS), lambda x: strip(F.btrim(strip(x), F.lit(SIGNAL_EDGES))))
    return distinct_fold(F.filter(parts, lambda x: F.char_length(x) >= 2))


def keyword_pieces(c: Column, least: int = 2, most: int = 24) -> Column:
    """Signals of 2 to 24 characters that are no stop words."""
    return F.filter(signals(c), lambda x: F.char_length(x).between(least, most) & ~F.lower(x).isin(KEYWORD_STOPS))


def keyword_signal_score(query_signals: Column, tags: Column) -> Column:
    """0.2 for each tag contained in a query signal or containing one, at most 1."""
    low = F.transform(query_signals, F.lower)
    hit = F.filter(signals(tags), lambda t: F.exists(low, lambda q: F.contains(q, F.lower(t)) | F.contains(F.lower(t), q)))
    return F.least(F.size(hit), F.lit(5)) * 0.2


def keyword_coverage(n: Column) -> Column:
    """0.2 for each of up to five keywords."""
    return F.least(F.greatest(n, F.lit(0)), F.lit(5)) * 0.2


def overlap(a: Column, b: Column) -> Column:
    """Common elements over the larger set; 0 for two empty ones."""
    n = F.greatest(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(n > 0, F.size(F.array_intersect(a, b)) / n).otherwise(0.0)


def keyword_set(c: Column) -> Column:
    """The distinct runs of at least two digits, Latin letters and Han signs, in lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9\u4e00-\u9fff]+"), lambda x: F.char_length(x) >= 2))


def hashtags(c: Column) -> Column:
    """What stands behind number signs, as often as it stands there."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"#([\p{IsHan}A-Za-z0-9_\-]+)"), F.lit(1))


def fixed_windows(c: Column, size: int, overlap_chars: int) -> Column:
    """Windows of ``size`` characters, each ``overlap_chars`` into the one before (X2); the last ends with the text."""
    step = size - overlap_chars
    last = F.greatest(F.ceil((F.char_length(c) - overlap_chars) / step) - 1, F.lit(0)).cast("int")
    return F.when(F.char_length(c) > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(c, i * step + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def pack_paragraphs(text: str | None, most: int, overlap_chars: int) -> list[str]:
    """Paragraph lines packed up to ``most`` characters; longer lines are windowed; each chunk but the first starts with the tail of the plain chunk before."""
    plain: list[str] = []
    held = ""
    for line in filter(None, (x.strip() for x in (text or "").split("\n"))):
        if len(line) > most:
            if held:
                plain.append(held)
                held = ""
            step = max(1, most - overlap_chars)
            plain += [line[i : i + most] for i in range(0, max(1, len(line) - overlap_chars), step)]
        elif held and len(held) + 1 + len(line) > most:
            plain.append(held)
            held = line
        else:
            held = f"{held}\n{line}" if held else line
    if held:
        plain.append(held)
    tail = lambda s: s[-overlap_chars:] if overlap_chars else ""
    return [c if i == 0 else tail(plain[i - 1]) + c for i, c in enumerate(plain)]


def chunk_text(c: Column, most: int = 320, overlap_chars: int = 40) -> Column:
    """X1 as an Arrow function, as packing is sequential."""

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def chunks(v: pa.Array) -> pa.Array:
        return pa.array([pack_paragraphs(x, most, overlap_chars) for x in v.to_pylist()], pa.list_(pa.string()))

    return chunks(c)


def url_normalize(c: Column) -> Column:
    """Without query and fragment."""
    return F.regexp_replace(strip(c), r"[?#].*$", "")


def url_redact(c: Column, names: tuple[str, ...] = ("key", "sig", "token")) -> Column:
    """Values of secret parameters replaced."""
    return F.regexp_replace(c, rf"(?i)([?&](?:{'|'.join(names)})=)[^&#]*", "$1***")


def stable_id(prefix: str, *parts: Column, chars: int = 16) -> Column:
    """A prefix and the first hexadecimal digits of a SHA-1."""
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.concat_ws("|", *parts)), 1, chars))


def uuid5_url(kind: str, seed: Column) -> Column:
    """The name-based UUID (version 5, URL namespace) of ``kind:seed`` (X11), from a SHA-1 inside the JVM."""
    space = F.unhex(F.lit(uuid.NAMESPACE_URL.hex))
    h = F.sha1(F.concat(space, F.encode(F.concat(F.lit(kind + ":"), seed), "utf-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def first_fragments(c: Column, n: int = 4, most: int = 160) -> Column:
    """The first sentences, cut to ``most`` characters."""
    parts = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"[。！？!?\n；;]+"), lambda x: strip(x)), lambda x: x != "")
    return F.transform(F.slice(parts, 1, n), lambda x: F.substring(x, 1, most))


def snippet(c: Column, most: int = 220) -> Column:
    """White space squeezed, cut with dots."""
    s = strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"[ \t\r\n]+", " "))
    return F.when(F.char_length(s) > most, F.concat(F.substring(s, 1, most), F.lit("..."))).otherwise(s)


def json_array_clean(c: Column) -> Column:
    """A JSON text array; blank or invalid is empty; elements stripped, blank ones dropped."""
    parsed = F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))
    return F.filter(F.transform(parsed, lambda x: strip(x)), lambda x: x != "")


def json_block(c: Column) -> Column:
    """From the first opening to the last closing brace (X32); empty without."""
    return F.regexp_extract(c, r"(?s)(\{.*\})", 1)


def lng_lat(c: Column) -> Column:
    """struct<lng,lat> of a "lng,lat" text; null when it is no valid place."""
    p = F.split(c, ",")
    lng, lat = F.get(p, F.lit(0)).try_cast("double"), F.get(p, F.lit(1)).try_cast("double")
    return F.when((F.size(p) == 2) & valid_lng_lat(lng, lat), F.struct(lng.alias("lng"), lat.alias("lat")))


def valid_lng_lat(lng: Column, lat: Column) -> Column:
    """Finite, in range and not the origin; false for null."""
    ok = ~F.isnan(lng) & ~F.isnan(lat) & lng.between(-180, 180) & lat.between(-90, 90) & ~((lng == 0) & (lat == 0))
    return F.coalesce(ok, F.lit(False))


def cn_number(c: Column) -> Column:
    """A count as written in Chinese pages, with its unit (S15); null when it is none."""
    text = F.replace(strip(c), F.lit(","), F.lit(""))
    number = F.regexp_extract(text, r"^([0-9]+(?:\.[0-9]+)?)[万亿]?$", 1).try_cast("double")
    unit = F.lit(1.0)
    for k, v in CN_UNITS.items():
        unit = F.when(text.endswith(k), v).otherwise(unit)
    return F.round(number * unit).cast("bigint")


def html_text(c: Column, most: int = 700) -> Column:
    """Without tags, with entities resolved and white space squeezed."""

    @F.arrow_udf(T.StringType())
    def unescape(v: pa.Array) -> pa.Array:
        return pa.array([None if x is None else html.unescape(x) for x in v.to_pylist()], pa.string())

    return F.substring(strip(F.regexp_replace(unescape(F.regexp_replace(c, r"<[^>]*>", " ")), r"\s+", " ")), 1, most)


def host_kind(c: Column) -> Column:
    """loopback, private or public host of an address (S21); null without a host."""
    host = F.lower(F.try_parse_url(c, F.lit("HOST")))
    private = host.rlike(r"^(10\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.)") | host.endswith(".local")
    return F.when(host.isNull(), None).when((host == "localhost") | host.rlike(r"^127\."), "loopback").when(private, "private").otherwise("public")


def redact(c: Column, names: dict[str, str]) -> Column:
    """Internal names replaced one after the other."""
    for k, v in names.items():
        c = F.replace(c, F.lit(k), F.lit(v))
    return c


def clamp_text(c: Column, most: int) -> Column:
    """Two thirds from the head and the rest from the tail of a longer text."""
    head = most * 2 // 3
    return F.when(F.char_length(c) > most, F.concat(F.substring(c, 1, head), F.lit("..."), F.right(c, F.lit(most - head)))).otherwise(c)


def by_keywords(c: Column, rules: list[tuple[str, list[str]]], default: str) -> Column:
    """The label of the first rule of which a keyword is contained."""
    out = F.lit(default)
    for label, words in reversed(rules):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(c, F.lit(w))
        out = F.when(hit, label).otherwise(out)
    return out


def short_hash(c: Column) -> Column:
    """``h_`` and six hexadecimal digits of a SHA-256; empty for null or blank."""
    return F.when(strip(F.coalesce(c, F.lit(""))) == "", "").otherwise(F.concat(F.lit("h_"), F.substring(F.sha2(c, 256), 1, 6)))


def slug(c: Column, most: int = 24) -> Column:
    """Letters, digits and Han signs, other runs as one underscore, cut to ``most``."""
    return F.substring(F.btrim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^a-zA-Z0-9\p{IsHan}]+", "_"), F.lit("_")), 1, most)


def confidence_bucket(c: Column) -> Column:
    """The decile of a confidence as text; a dash for null, NaN or out of 0..1."""
    low = F.least(F.floor(c * 10), F.lit(9)) / 10
    return F.when((c >= 0) & (c <= 1) & ~F.isnan(c), F.format_string("%.1f-%.1f", low, low + 0.1)).otherwise("-")


def polyline_points(steps_json: Column) -> Column:
    """Points of a route's steps (JSON array of {"polyline": "lng,lat;lng,lat"}), without consecutive repeats."""
    steps = F.coalesce(F.from_json(steps_json, "array<struct<polyline:string>>"), F.array().cast("array<struct<polyline:string>>"))
    points = F.filter(F.transform(F.flatten(F.transform(steps, lambda s: F.split(F.coalesce(s["polyline"], F.lit("")), ";"))), lambda p: lng_lat(p)), lambda p: p.isNotNull())
    return F.filter(points, lambda p, i: (i == 0) | (p != F.get(points, i - 1)))


def static_map_url(base: str, key: str, lng: Column, lat: Column, zoom: int = 10, size: str = "400*400") -> Column:
    """The address of a map image around a place; null for an invalid place."""
    place = F.concat(F.round(lng, 6).cast("string"), F.lit(","), F.round(lat, 6).cast("string"))
    return F.when(valid_lng_lat(lng, lat), F.concat(F.lit(f"{base}?location="), place, F.lit(f"&zoom={zoom}&size={size}&key={key}")))
