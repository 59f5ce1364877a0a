"""String, date and colour functions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names and abbreviations of places.
COUNTRIES = {
    "us": "United States",
    "usa": "United States",
    "u.s.": "United States",
    "u.s.a.": "United States",
    "america": "United States",
    "united states of america": "United States",
    "uk": "United Kingdom",
    "u.k.": "United Kingdom",
    "great britain": "United Kingdom",
    "uae": "United Arab Emirates",
    "south korea": "Korea, Republic of",
}
STATES = {
    "al": "Alabama", "ak": "Alaska", "az": "Arizona", "ar": "Arkansas",
    "ca": "California", "co": "Colorado", "ct": "Connecticut",
    "de": "Delaware", "fl": "Florida", "ga": "Georgia", "hi": "Hawaii",
    "id": "Idaho", "il": "Illinois", "in": "Indiana", "ia": "Iowa",
    "ks": "Kansas", "ky": "Kentucky", "la": "Louisiana", "me": "Maine",
    "md": "Maryland", "ma": "Massachusetts", "mi": "Michigan",
    "mn": "Minnesota", "ms": "Mississippi", "mo": "Missouri",
    "mt": "Montana", "ne": "Nebraska", "nv": "Nevada",
    "nh": "New Hampshire", "nj": "New Jersey", "nm": "New Mexico",
    "ny": "New York", "nc": "North Carolina", "nd": "North Dakota",
    "oh": "Ohio", "ok": "Oklahoma", "or": "Oregon", "pa": "Pennsylvania",
    "ri": "Rhode Island", "sc": "South Carolina", "sd": "South Dakota",
    "tn": "Tennessee", "tx": "Texas", "ut": "Utah", "vt": "Vermont",
    "va": "Virginia", "wa": "Washington", "wv": "West Virginia",
    "wi": "Wisconsin", "wy": "Wyoming", "dc": "District of Columbia",
    "pr": "Puerto Rico",
    "ab": "Alberta", "bc": "British Columbia", "mb": "Manitoba",
    "nb": "New Brunswick", "nl": "Newfoundland and Labrador",
    "ns": "Nova Scotia", "on": "Ontario", "pe": "Prince Edward Island",
    "qc": "Quebec", "sk": "Saskatchewan",
}
# Words that a search leaves out.
STOPWORDS = [
    "a", "and", "cancer", "carcinoma", "for", "in", "neoplasm", "of",
    "or", "study", "the", "trial", "tumor", "tumour", "with",
]
# Hints of a contrast phase in a description, and their labels.
PHASE_HINTS = [
    (r"arter", "arterial"),
    (r"portal|venos|venous|\bpv\b", "portal/venosa"),
    (r"tard|delay|late|equilib|excret|urogr|nefrogr", "tardía/excretora"),
    (r"simple|sin contr|sin c\b|s/c|non.?con|sin medio|\bnc\b|plain|nativ|basal|\bpre\b", "sin contraste"),
    (r"contrast|\bc\+|con c\b|\biv\b|\bpost\b|gado|\bgd\b", "con contraste"),
]
ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüñçýÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇÝ"
PLAIN = "aaaaaaeeeeiiiiooooouuuuncyaaaaaaeeeeiiiiooooouuuuncy"


def clean(c: Column) -> Column:
    """White space runs become one blank, none at the ends; null becomes empty. U+001C to U+001F are not white space here."""
    return F.coalesce(F.btrim(F.regexp_replace(c, r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+", " ")), F.lit(""))


def alias(c: Column, names: dict[str, str]) -> Column:
    """The full name of an abbreviation; anything else as it is, cleaned."""
    key = clean(c)
    pairs = [F.lit(x) for pair in names.items() for x in pair]
    return F.coalesce(F.create_map(*pairs)[F.lower(key)], key)


def tokens(c: Column) -> Column:
    """The set of lower-case ASCII words of two characters or more that aren't stopwords, in order of first sight."""
    found = F.regexp_extract_all(F.lower(clean(c)), F.lit("([a-z0-9]+)"), F.lit(1))
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    return F.array_except(F.array_distinct(F.filter(found, lambda t: F.length(t) > 1)), stop)


def any_marker(c: Column, markers: list[str] | tuple[str, ...]) -> Column:
    """Whether any marker is a substring."""
    out = F.lit(False)
    for m in markers:
        out = out | F.contains(c, F.lit(m))
    return out


def date_ordinal(c: Column) -> Column:
    """Days since 0001-01-01 plus one of a strict ISO date; anything else is 0."""
    day = F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c, "yyyy-MM-dd"))
    return F.coalesce(F.datediff(day, F.lit("0001-01-01").cast("date")) + 1, F.lit(0))


def truncate(c: Column, limit: int, notice: str) -> Column:
    """A longer text is cut, its end trimmed, and the notice put after it; null becomes empty."""
    c = F.coalesce(c, F.lit(""))
    return F.when(F.length(c) > limit, F.concat(F.rtrim(F.regexp_replace(F.substring(c, 1, limit), r"\s+$", "")), F.lit(notice))).otherwise(c)


def near(c: Column) -> Column:
    """struct(lat, lon) of 'LAT,LON'; null of a blank; an error of anything else or out of range."""
    text = clean(c)
    part = F.split(text, ",")
    lat, lon = (F.try_element_at(part, F.lit(i)).try_cast("double") for i in (1, 2))
    good = (F.size(part) == 2) & F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))
    return F.when(text == "", F.lit(None)).when(good, F.struct(lat.alias("lat"), lon.alias("lon"))).otherwise(F.raise_error(F.concat(F.lit("not LAT,LON: "), text)))


def clock(c: Column) -> tuple[Column, Column]:
    """('HH:MM:SS', seconds) of a clock string HH[MM[SS...]]; ('', null) of anything else. Ranges aren't checked."""
    h, m, s = (F.regexp_extract(c, r"^(\d{2})(\d{2})?(\d{2})?", i) for i in (1, 2, 3))
    ok = F.coalesce(c, F.lit("")).rlike(r"^\d{2}")
    m, s = (F.when(x == "", "00").otherwise(x) for x in (m, s))
    seconds = h.try_cast("int") * 3600 + m.try_cast("int") * 60 + s.try_cast("int")
    return F.when(ok, F.concat_ws(":", h, m, s)).otherwise(F.lit("")), F.when(ok, seconds)


def fold(c: Column) -> Column:
    """Lower case without the accents of Latin letters; other non-ASCII characters are dropped."""
    return F.lower(F.regexp_replace(F.translate(F.coalesce(c, F.lit("")), ACCENTED, PLAIN), r"[^\x00-\x7F]", ""))


def phase_hints(c: Column) -> Column:
    """All labels whose pattern is found, in the list's order."""
    text = fold(c)
    return F.filter(F.array(*[F.when(text.rlike(p), F.lit(label)) for p, label in PHASE_HINTS]), lambda x: x.isNotNull())


def slug(c: Column, fallback: str = "x") -> Column:
    out = F.regexp_replace(F.regexp_replace(fold(c), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")
    return F.when(out == "", F.lit(fallback)).otherwise(out)


def escape_html(c: Column) -> Column:
    out = c
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def rgb(c: Column) -> tuple[Column, Column, Column]:
    """Red, green and blue (0 to 255) of '#rgb' or '#rrggbb'."""
    h = F.regexp_replace(c, "^#", "")
    h = F.when(F.length(h) == 3, F.regexp_replace(h, "(.)", "$1$1")).otherwise(h)
    return tuple(F.conv(F.substring(h, i, 2), 16, 10).cast("int") for i in (1, 3, 5))


def linear(channel: Column) -> Column:
    """sRGB 0 to 255 to linear light 0 to 1."""
    x = channel / 255.0
    return F.when(x <= 0.04045, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, F.lit(2.4)))


def duration(seconds: Column) -> Column:
    """mm:ss, rounded half to even."""
    n = F.bround(seconds, 0).cast("long")
    return F.format_string("%02d:%02d", F.floor(n / 60), n % 60)


def relative_day(days: Column) -> Column:
    """0 today, 1 tomorrow, 2 to 6 'in n days', before today overdue, later blank."""
    return F.when(days < 0, "overdue").when(days == 0, "today").when(days == 1, "tomorrow").when(days <= 6, F.concat(F.lit("in "), days.cast("string"), F.lit(" days"))).otherwise("")


def bounds(c: Column) -> tuple[Column, Column]:
    """The open ends of 'a:b'; a blank side is null."""
    part = F.split(c, ":")
    return tuple(F.try_element_at(part, F.lit(i)).try_cast("double") for i in (1, 2))


def excluded(c: Column) -> tuple[Column, Column]:
    """Key and number of dilations of 'key+dil:N'."""
    n = F.regexp_extract(c, r"\+dil:(\d+)$", 1)
    return F.regexp_replace(c, r"\+dil:\d+$", ""), F.when(n == "", F.lit(0)).otherwise(n.try_cast("int"))


def paragraphs(text: Column | str) -> Column:
    """The parts of a text between blank lines, without white space at their ends; empty ones are left out."""
    parts = F.transform(F.split(text, "\n\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")))
    return F.filter(parts, lambda x: x != "")


def variant(own: Column, shared: Column, sharing: Column, default: str = "") -> Column:
    """A field's text: in a copy to share its shared form, where there is one; else its own; else the default."""
    text = lambda c: F.when(F.coalesce(c, F.lit("")) != "", c)
    return F.coalesce(F.when(sharing, text(shared)), text(own), F.lit(default))


def banner(own: Column, shared: Column, sharing: Column, standard: str) -> Column:
    """variant(), but a copy to share never takes over the private banner."""
    return F.when(sharing, variant(F.lit(""), shared, sharing, standard)).otherwise(variant(own, shared, sharing))


def wrapped(text: Column | str, width: int) -> Column:
    """Lines of whole words, filled up to a width in characters; a longer word has a line of its own."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("line"))

    def add(state: Column, word: Column) -> Column:
        longer = F.when(state.line == "", word).otherwise(F.concat(state.line, F.lit(" "), word))
        fits = (state.line == "") | (F.length(longer) <= width)
        return F.struct(F.when(fits, state.done).otherwise(F.concat(state.done, F.array(state.line))).alias("done"), F.when(fits, longer).otherwise(word).alias("line"))

    return F.aggregate(words, start, add, lambda s: F.when(s.line == "", s.done).otherwise(F.concat(s.done, F.array(s.line))))


def hue(red: Column, green: Column, blue: Column) -> tuple[Column, Column, Column]:
    """Hue in degrees, saturation and value of channels from 0 to 255; a grey has hue 0."""
    r, g, b = (c / 255.0 for c in (red, green, blue))
    top = F.greatest(r, g, b)
    span = top - F.least(r, g, b)
    turn = F.when(span == 0, 0.0).when(top == r, (g - b) / span).when(top == g, 2.0 + (b - r) / span).otherwise(4.0 + (r - g) / span)
    return F.pmod(turn * 60.0, F.lit(360.0)), F.when(top == 0, 0.0).otherwise(span / top), top
