"""Text expressions: ``Column -> Column``.

Everything is a JVM-side expression except NFC normalisation, which Spark has
no built-in for and which runs as one function on Arrow batches.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .urls import let

# Vietnamese letters and the ASCII letter each folds to.
FOLDED_LETTERS = {
    "a": "àáảãạăằắẳẵặâầấẩẫậ",
    "d": "đ",
    "e": "èéẻẽẹêềếểễệ",
    "i": "ìíỉĩị",
    "o": "òóỏõọôồốổỗộơờớởỡợ",
    "u": "ùúủũụưừứửữự",
    "y": "ỳýỷỹỵ",
}

# Words that mark a sentence about a place's surroundings.
LOCATION_WORDS = [
    "cách", "bán kính", "đi bộ", "km", " m ", " m,", " m.", "sân bay",
    "di chuyển", "gần", "tọa lạc", "nằm ở", "nhìn ra", "giáp biển",
]

# Name words that decide a property type, first match wins.
PROPERTY_TYPES = [
    (("resort",), "Resort"),
    (("căn hộ", "apartment"), "Căn hộ"),
    (("villa", "biệt thự"), "Biệt thự"),
    (("homestay",), "Homestay"),
]
DEFAULT_PROPERTY_TYPE = "Khách sạn"

# Label pattern of each review sub-score in page text.
SUB_SCORE_LABELS = {
    "staff_score": r"Nhân viên\s*(?:phục vụ)?",
    "facilities_score": r"Tiện nghi",
    "cleanliness_score": r"Sạch sẽ",
    "comfort_score": r"Thoải mái",
    "value_for_money_score": r"Đáng giá tiền",
    "location_score": r"Địa điểm",
    "free_wifi_score": r"WiFi miễn phí",
}

# Characters that are never page content.
JUNK_CHARACTERS = (
    r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F"
    r"\x{200B}-\x{200D}\x{2060}\x{FEFF}\x{E000}-\x{F8FF}"
    r"\x{F0000}-\x{FFFFD}\x{100000}-\x{10FFFD}]"
)

NUMBER = r"\d+(?:\.\d+)?"
TABLE_RULE_LINE = r"(?m)^[^\S\n]*+(?:\|\s*:?-+:?\s*)+\|[^\S\n]*+$"


#: Texts of a batch that are Python objects at a time.
NFC_ROWS = 64


@F.arrow_udf(StringType())
def nfc(s: pa.Array) -> pa.Array:
    # The batch itself stays in Arrow, a few texts at a time leave it.
    parts = (s.slice(at, NFC_ROWS).to_pylist() for at in range(0, len(s), NFC_ROWS))
    done = [pa.array([None if v is None else unicodedata.normalize("NFC", v) for v in part], pa.string()) for part in parts]
    return pa.concat_arrays(done) if done else pa.array([], pa.string())


def strip(c: Column) -> Column:
    """Trim every kind of Unicode white space, not only blanks."""
    # The look-behind keeps long inner runs of blanks from being rescanned.
    return F.regexp_replace(c, r"(?U)^\s++|(?<!\s)\s++$", "")


def normalize_text(c: Column) -> Column:
    return F.coalesce(strip(nfc(c)), F.lit(""))


def fold(c: Column) -> Column:
    """Lower-case and replace Vietnamese letters by their ASCII base letter."""
    source = "".join(FOLDED_LETTERS.values())
    target = "".join(base * len(group) for base, group in FOLDED_LETTERS.items())
    return F.translate(F.lower(c), source, target)


def slug(c: Column) -> Column:
    """Identifier form: every run of other characters becomes one underscore."""
    return F.btrim(F.regexp_replace(fold(c), "[^a-z0-9]+", "_"), F.lit("_"))


def dash_slug(c: Column, default: str = "standard-room") -> Column:
    """URL form: other characters vanish, blanks and dashes become one dash."""
    kept = F.regexp_replace(fold(c), r"[^a-z0-9\s-]", "")
    dashed = F.btrim(F.regexp_replace(kept, r"[\s-]+", "-"), F.lit("-"))
    return F.coalesce(F.nullif(dashed, F.lit("")), F.lit(default))


def capitalize(c: Column) -> Column:
    """First letter upper, all others lower (unlike ``initcap``)."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substr(c, F.lit(2))))


def capture(c: Column, pattern: str, group: int = 1) -> Column:
    """A regex group, NULL (not '') when nothing matched."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def star_rating(value: Column, text: Column) -> Column:
    numeric = value.try_cast("double").cast("int")
    spelled = capture(text, r"(?U)(\d+)\s+trên\s+5\s+sao").try_cast("int")
    return F.coalesce(numeric, spelled, F.lit(0))


def address_fields(address: Column) -> Column:
    """struct(street_address, city, country, full_address)."""
    to_country = capture(address, r"(?iuU)^(.*?Việt\s+Nam)")
    s = strip(F.coalesce(to_country, address))
    s = F.regexp_replace(s, r"(?U)\b\d{5,6}\b\s*,?\s*", "")
    s = F.regexp_replace(s, r"(?U)\s*,\s*", ", ")
    full_text = F.btrim(F.regexp_replace(s, r"(?U),\s*,", ","), F.lit(", "))

    def pack(street, city, country, full) -> Column:
        return F.struct(street.alias("street_address"), city.alias("city"), country.alias("country"), full.alias("full_address"))

    def from_parts(v: Column) -> Column:
        full, parts = v["full"], v["parts"]
        n, last = F.size(parts), F.element_at(parts, -1)
        with_country = (n >= 2) & (F.lower(last) == "việt nam")
        first = lambda k: F.array_join(F.slice(parts, F.lit(1), k), ", ")
        return pack(
            F.when(with_country, first(n - 2)).when(n >= 2, first(n - 1)).otherwise(full),
            F.when(with_country, F.try_element_at(parts, F.lit(-2))).when(n >= 2, last).otherwise("Đà Nẵng"),
            F.when(with_country, last).otherwise("Việt Nam"),
            full,
        )

    split_up = let(full_text, lambda full: F.struct(
        full.alias("full"), F.transform(F.split(full, ","), lambda p: strip(p)).alias("parts")))
    empty = pack(F.lit(""), F.lit(""), F.lit(""), F.lit(""))
    return F.when(address.isNull() | (address == ""), empty).otherwise(let(split_up, from_parts))


def policy_times(policy: Column) -> Column:
    """struct of four HH:mm texts with the house defaults."""

    def times(label: str, group: int, default: str) -> Column:
        pattern = r"(?iuU)" + label + r"\s+phòng[^\n]*\nTừ\s*(\d{2}:\d{2})(?:\s*-\s*(\d{2}:\d{2}))?"
        return F.coalesce(capture(policy, pattern, group), F.lit(default))

    return F.struct(
        times("Nhận", 1, "14:00").alias("checkin_time_start"),
        times("Nhận", 2, "00:00").alias("checkin_time_end"),
        times("Trả", 1, "00:00").alias("checkout_time_start"),
        times("Trả", 2, "12:00").alias("checkout_time_end"),
    )


def list_items(c: Column, sep: str) -> Column:
    return F.transform(F.split(c, sep), lambda x: strip(x))


def facility_names(c: Column) -> Column:
    named = F.filter(list_items(c, ","), lambda x: x != "")
    return F.array_distinct(F.transform(named, capitalize))


def nearby_item(item: Column) -> Column:
    """struct(place_name, distance_value, distance_unit, distance_in_meters);
    NULL fields when the text has no readable distance."""
    pattern = r"(?iuU)^(.*?)\s+([\d,.]+)\s*(km|m)\s*$"
    value = F.replace(F.regexp_extract(item, pattern, 2), F.lit(","), F.lit(".")).try_cast("double")
    unit = F.lower(capture(item, pattern, 3))
    meters = F.when(unit == "km", (value * 1000).cast("int")).otherwise(value.cast("int"))
    return F.struct(
        strip(F.regexp_extract(item, pattern, 1)).alias("place_name"),
        value.alias("distance_value"),
        unit.alias("distance_unit"),
        meters.alias("distance_in_meters"),
    )


def room_item(item: Column) -> Column:
    """struct(room_type_name, price); name is NULL when the item has no price."""
    pattern = r"(?iuU)^(.*?)\s*\(\s*([\d,.]+)\s*VND\s*\)\s*$"
    digits = F.replace(F.regexp_extract(item, pattern, 2), F.lit(","), F.lit(""))
    found = F.regexp_like(item, F.lit(pattern))
    return F.struct(
        F.when(found, strip(F.regexp_extract(item, pattern, 1))).alias("room_type_name"),
        F.when(found, F.coalesce(digits.try_cast("double"), F.lit(0.0))).alias("price"),
    )


def price_number(c: Column) -> Column:
    """Price text to number; a two-digit tail after the last mark is decimals."""

    def plain(s: Column) -> Column:
        comma, dot = F.instr(s, ","), F.instr(s, ".")
        no_comma = F.replace(s, F.lit(","), F.lit(""))
        comma_is_point = F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
        decimal_tail = F.replace(F.regexp_replace(s, r"[.,](?=.*[.,])", ""), F.lit(","), F.lit("."))
        no_marks = F.regexp_replace(s, "[.,]", "")
        two_digits = F.regexp_like(s, F.lit(r"[.,][^.,]{2}$"))
        return (
            F.when((comma > 0) & (dot > 0), F.when(comma < dot, no_comma).otherwise(comma_is_point))
            .when((comma > 0) | (dot > 0), F.when(two_digits, decimal_tail).otherwise(no_marks))
            .otherwise(s)
        )

    bare = F.regexp_replace(c, r"(?iuU)[VNDđ$US\x{200B}\s]", "")
    return F.coalesce(F.regexp_replace(let(bare, plain), r"[^\d.]", "").try_cast("double"), F.lit(0.0))


def vnd_text(amount: Column) -> Column:
    """``1,234 VND``."""
    return F.concat(F.format_number(F.floor(amount), 0), F.lit(" VND"))


def chunk_id(source: Column, index: Column) -> Column:
    return F.substring(F.sha2(F.concat(source, F.lit("::"), index.cast("string")), 256), 1, 16)


def discount(original: Column, current: Column) -> Column:
    return F.greatest(F.lit(0.0), F.coalesce(original, current) - current)


def property_type(name: Column) -> Column:
    low = F.lower(name)
    out = None
    for words, label in PROPERTY_TYPES:
        hit = low.contains(words[0])
        for w in words[1:]:
            hit = hit | low.contains(w)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(DEFAULT_PROPERTY_TYPE)


def sentences_with(c: Column, words: list[str], below: int = 220) -> Column:
    """Sentences naming one of ``words`` and shorter than ``below``, ``"; "`` joined."""
    any_word = "|".join(_quote(w) for w in words)
    hits = F.filter(
        F.split(c, r"(?U)(?<=[.!?])\s+"),
        lambda s: F.regexp_like(F.lower(s), F.lit(any_word)) & (F.length(s) < below),
    )
    return F.array_join(F.transform(hits, lambda s: strip(s)), "; ")


def _quote(word: str) -> str:
    return r"\Q" + word + r"\E"


def sub_score(text: Column, label_pattern: str) -> Column:
    blanks = F.regexp_replace(text, r"(?U)\s+", " ")
    found = capture(blanks, r"(?iuU)" + label_pattern + r"\s*(\d+[.,]\d+|\d+)")
    return F.coalesce(F.replace(found, F.lit(","), F.lit(".")).try_cast("double"), F.lit(0.0))


def comparison_form(c: Column) -> Column:
    """NFC, no zero-width characters, single blanks, trimmed."""
    s = F.regexp_replace(nfc(c), r"[\x{200B}-\x{200D}\x{FEFF}]", "")
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))


def strip_junk(c: Column) -> Column:
    s = F.regexp_replace(c, JUNK_CHARACTERS, "")
    return strip(F.regexp_replace(s, r"(?U)[^\S\r\n]{2,}", " "))


def without_inline_images(markdown: Column) -> Column:
    return F.regexp_replace(
        markdown, r"(!\[.*?\])\(data:image\/.*?;base64,.*?\)", r"$1(<Base64-Image-Removed>)"
    )


def compared_text(markdown: Column) -> Column:
    """What counts when captures are compared: no white space, no iframe links."""
    return F.regexp_replace(F.regexp_replace(markdown, r"(?U)\s+", ""), r"\[iframe\]\(.+?\)", "")


def change_signature(markdown: Column, strict: bool = False) -> Column:
    """Hash that is equal when two captures count as the same page.

    The comparison ignores white space, iframe links and the *order of
    characters*; ``strict`` keeps the order.
    """
    return F.sha2(compared_text(markdown) if strict else sorted_characters(compared_text(markdown)), 256)


def sorted_characters(c: Column) -> Column:
    return F.array_join(F.sort_array(F.split(c, "")), "")


def same_capture(a: Column, b: Column, strict: bool = False) -> Column:
    """Whether two captures count as the same page.

    Sorting a page's characters is the costly part, so it is only done for
    texts that differ but have the same length.
    """
    def compare(p: Column) -> Column:
        x, y = p["x"], p["y"]
        if strict:
            return x == y
        return F.when(x == y, F.lit(True)).when(F.length(x) != F.length(y), F.lit(False)).otherwise(
            sorted_characters(x) == sorted_characters(y))

    return let(F.struct(compared_text(a).alias("x"), compared_text(b).alias("y")), compare)


def word_set(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), r"(?U)\s+"), lambda w: w != ""))


def word_set_similarity(a: Column, b: Column) -> Column:
    """Jaccard of two word sets; equal texts score 1, an empty side 0."""
    def jaccard(w: Column) -> Column:
        return let(F.size(F.array_intersect(w["a"], w["b"])), lambda n: n / (F.size(w["a"]) + F.size(w["b"]) - n))

    words = F.struct(word_set(a).alias("a"), word_set(b).alias("b"))
    empty = ~F.regexp_like(a, F.lit(r"\S")) | ~F.regexp_like(b, F.lit(r"\S"))
    return F.when(a == b, F.lit(1.0)).when(empty, F.lit(0.0)).otherwise(let(words, jaccard))


def edit_similarity(gold: Column, other: Column) -> Column:
    """1 - distance in characters / longer length in *bytes*."""
    longest = F.greatest(F.octet_length(gold), F.octet_length(other))
    return F.when(longest > 0, 1 - F.levenshtein(gold, other) / longest).otherwise(F.lit(1.0))


def edit_similar(gold: Column, other: Column, least: float) -> Column:
    """Whether ``edit_similarity`` is at least ``least``; the distance is only followed as far as that allows."""
    longest = F.greatest(F.octet_length(gold), F.octet_length(other))
    distance = F.call_function("levenshtein", gold, other, F.ceil((1 - least) * longest).cast("int"))
    return F.when(longest > 0, (distance >= 0) & (1 - distance / longest >= least)).otherwise(F.lit(least <= 1))


def bucket_label(seconds: Column) -> Column:
    """Name of a schedule interval."""
    limits = [(900, "15m"), (1800, "30m"), (3600, "hourly"), (21600, "sub_daily"), (86400, "daily"), (604800, "weekly")]
    out = F.when(seconds <= limits[0][0], limits[0][1])
    for top, name in limits[1:]:
        out = out.when(seconds <= top, name)
    return out.otherwise("other")


def jitter_offset(key: Column, interval_ms: Column, cap_ms: int) -> Column:
    """Stable offset below half the interval and ``cap_ms``, from the key's hash."""
    room = F.least(F.floor(interval_ms / 2), F.lit(cap_ms)).cast("long")
    word = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long")
    return F.when(room <= 0, F.lit(0).cast("long")).otherwise(F.try_mod(word, room))
