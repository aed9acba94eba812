"""Column expressions that read device messages.

All of them run inside the JVM; none needs a shuffle or session settings.
Capture groups come out as parallel arrays, and a field is found by position in
the key array, so the common path has no per-match regex and no nested lambda.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagtrack import constants as K

PAIRS = "array<struct<anchor_id:bigint,distance_cm:double>>"
SPACE = " \t\n\r\x0b\x0c"


def clean_message(raw: Column) -> Column:
    """Bytes or text to trimmed valid UTF-8 (bad bytes become U+FFFD)."""
    return F.btrim(F.make_valid_utf8(raw.cast("string")), F.lit(SPACE))


def _all(text: Column, pattern: str, group: int) -> Column:
    # (?U): digits, blanks and word edges are Unicode-aware
    return F.regexp_extract_all(text, F.lit("(?U)" + pattern), F.lit(group))


# A key starts at the first letter of its word and is never given back
# (possessive): a word is read once, so letter-digit text of any length is linear.
_PAIR = r"(?<![A-Za-z0-9_])[0-9_]*([A-Za-z][A-Za-z0-9_]*+)\s*[:=]\s*([^,;\s]+)"


def field_keys(message: Column) -> Column:
    """Lower-cased keys of every ``key=value``, last one first."""
    return F.reverse(F.transform(_all(message, _PAIR, 1), F.lower))


def field_values(message: Column) -> Column:
    """The values beside :func:`field_keys`."""
    return F.reverse(_all(message, _PAIR, 2))


def field(keys: Column, values: Column, key: str) -> Column:
    """Value of the last occurrence of ``key``; NULL when absent."""
    return F.get(values, (F.array_position(keys, key) - 1).cast("int"))


def fields_map(keys: Column, values: Column) -> Column:
    """Key-sorted map in which the last duplicate wins."""
    names = F.array_sort(F.array_distinct(keys))
    return F.map_from_arrays(
        names, F.transform(names, lambda k: F.get(values, (F.array_position(keys, k) - 1).cast("int")))
    )


def fields_json(fields: Column) -> Column:
    """Key-sorted JSON of the field map; non-ASCII is left as UTF-8."""
    return F.to_json(fields)


# a digit-group underscore is legal, a type suffix such as 5d is not
_DIGITS = r"[0-9]+(?:_[0-9]+)*"
_DECIMAL = rf"^[+-]?(?:{_DIGITS}(?:[.](?:{_DIGITS})?)?|[.]{_DIGITS})(?:[eE][+-]?{_DIGITS})?$"
_FLOAT = rf"{_DECIMAL}|(?i)(?<=^|^[+-])nan$|^[+-]?inf(?:inity)?$"
_INT = rf"^[+-]?{_DIGITS}$"


def to_float(text: Column) -> Column:
    """Decimal comma or point; blank or malformed text is NULL."""
    t = F.replace(F.btrim(text, F.lit(SPACE)), F.lit(","), F.lit("."))
    return F.replace(F.regexp_extract(t, _FLOAT, 0), F.lit("_"), F.lit("")).try_cast("double")


def to_int(text: Column) -> Column:
    t = F.btrim(text, F.lit(SPACE))
    return F.replace(F.regexp_extract(t, _INT, 0), F.lit("_"), F.lit("")).try_cast("bigint")


def is_false_flag(text: Column) -> Column:
    return F.lower(F.btrim(text, F.lit(SPACE))).isin(*K.FALSE_FLAGS)


def event_label(keys: Column, values: Column) -> Column:
    """Upper-cased ``event``, else ``type``, else the default label."""
    return F.upper(F.coalesce(*[field(keys, values, k) for k in K.EVENT_KEYS], F.lit(K.DEFAULT_EVENT)))


def keyed_distance(keys: Column, values: Column) -> Column:
    """(anchor, distance) named by separate id and distance keys; NULL parts when unusable.

    The id is the first key present; when it does not parse there is no second
    try.  The distance is the first key that does parse.  A false ``valid``
    flag silences this form only.
    """
    anchor = to_int(F.coalesce(*[field(keys, values, k) for k in K.ID_KEYS]))
    flagged = is_false_flag(F.coalesce(field(keys, values, "valid"), F.lit("1")))
    dist = F.coalesce(*[to_float(field(keys, values, k)) for k in K.DISTANCE_KEYS])
    return F.struct(F.when(~flagged, anchor).alias("anchor_id"), dist.alias("distance_cm"))


def indexed_anchors(message_upper: Column, pattern: str) -> Column:
    """Anchor numbers of every ``<word><n> = <number>``."""
    return _all(message_upper, pattern, 1)


def indexed_distances(message_upper: Column, pattern: str, anchors: Column) -> Column:
    """Pairs of such a form; the text is scanned again only where there are any."""
    numbers = _all(message_upper, pattern, 2)
    pairs = F.zip_with(
        anchors,
        numbers,
        lambda a, n: F.struct(
            a.try_cast("bigint").alias("anchor_id"),
            F.replace(n, F.lit(","), F.lit(".")).try_cast("double").alias("distance_cm"),
        ),
    )
    return F.when(F.size(anchors) > 0, pairs.cast(PAIRS)).otherwise(F.array().cast(PAIRS))


def last_per_anchor(pairs: Column) -> Column:
    """Keep the last assignment of each anchor, ascending by anchor."""
    known = F.filter(pairs, lambda p: p["anchor_id"].isNotNull() & p["distance_cm"].isNotNull())
    ids = F.array_sort(F.array_distinct(known["anchor_id"]))
    latest = F.transform(
        ids, lambda a: F.element_at(F.filter(pairs, lambda p: p["anchor_id"] == a), F.lit(-1))
    )
    return F.when(F.size(pairs) <= 1, known).otherwise(latest)


def iso_millis(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS")
