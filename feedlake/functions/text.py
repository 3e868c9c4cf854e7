"""Scalar functions F1-F21, all as built-in Column expressions (no Python UDF),
so they stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedlake import schemas as S

_STR_ARRAY = T.ArrayType(T.StringType())


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# F1 -------------------------------------------------------------------------
def make_id(prefix: str, value) -> Column:
    """`prefix_` + first 12 hex digits of md5 of the value's text."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.md5(_c(value).cast("string")), 1, 12))


# F2 -------------------------------------------------------------------------
def strip_ws(col) -> Column:
    """Remove leading/trailing whitespace (any kind, as Python's str.strip)."""
    return F.regexp_replace(_c(col), r"^\s+|\s+$", "")


def normalized_user_id(username) -> Column:
    """Web sign-in id: trim + lower-case before hashing."""
    return make_id("user", F.lower(strip_ws(username)))


# F3 -------------------------------------------------------------------------
def parse_json_list(col) -> Column:
    """Tolerant JSON list parse; empty, null, malformed or non-list text -> []."""
    parsed = F.from_json(_c(col), _STR_ARRAY)
    return F.coalesce(parsed, F.array().cast(_STR_ARRAY))


# F4 -------------------------------------------------------------------------
_LITERAL_TOKENS = r"(?s)'(?:[^'\\]++|\\.)*+'|\"(?:[^\"\\]++|\\.)*+\"|[A-Za-z_]++|."
_LITERAL_WORDS = {"None": "null", "True": "true", "False": "false"}


def _as_json_list(c: Column) -> Column:
    """A Python list or tuple literal with its words and brackets as JSON has
    them; what stands inside quotes is left alone."""
    def word(tok: Column) -> Column:
        expr = None
        for k, v in _LITERAL_WORDS.items():
            expr = F.when(tok == k, F.lit(v)) if expr is None else expr.when(tok == k, F.lit(v))
        return expr.otherwise(tok)

    text = F.array_join(F.transform(F.regexp_extract_all(c, F.lit(_LITERAL_TOKENS), 0), word), "")
    inner = F.regexp_extract(text, r"(?s)^\s*\((.*?),?\s*\)\s*$", 1)
    return F.when(text.rlike(r"(?s)^\s*\(.*\)\s*$"), F.concat(F.lit("["), inner, F.lit("]"))) \
        .otherwise(F.regexp_replace(text, r",\s*\]\s*$", "]"))


def parse_str_list(col) -> Column:
    """List literal parse (JSON, or a Python list or tuple, None as null);
    numpy-style `['a' 'b']` falls back to splitting on `' '` and stripping
    quotes/spaces (D16: such neighbours stay two items)."""
    c = _c(col)
    parsed = F.coalesce(F.from_json(c, _STR_ARRAY), F.from_json(_as_json_list(c), _STR_ARRAY))
    fallback = F.filter(
        F.transform(F.split(F.btrim(c, F.lit("[]")), "' '"), lambda s: F.btrim(s, F.lit("' \""))),
        lambda s: s != "")
    return (F.when(c.isNull() | (c == ""), F.array().cast(_STR_ARRAY))
            .when(parsed.isNotNull(), parsed)
            .otherwise(fallback))


# F5 -------------------------------------------------------------------------
def join_list(col, sep: str) -> Column:
    return F.array_join(_c(col), sep)


# F6 -------------------------------------------------------------------------
def interest_words(text) -> Column:
    """All interest words of a text, in order, with repeats."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(S.INTEREST_WORD_PATTERN), 0)


def parse_tags(text) -> Column:
    """Set of interest words (order of first appearance)."""
    return F.array_distinct(interest_words(text))


# F7 -------------------------------------------------------------------------
def split_tags(col) -> Column:
    parts = F.transform(F.split(_c(col), S.TAG_SPLIT_PATTERN), lambda s: F.trim(s))
    kept = F.filter(parts, lambda s: F.length(s) > S.TAG_MIN_LENGTH)
    return F.when(_c(col).isNull() | (_c(col) == ""), F.array().cast(_STR_ARRAY)) \
        .otherwise(F.slice(kept, 1, S.TAG_CAP))


def display_tags(tags, categories) -> Column:
    return F.slice(F.concat(split_tags(tags), split_tags(categories)), 1, S.TAG_CAP)


# F8 -------------------------------------------------------------------------
def word_count(col) -> Column:
    """Pieces when split on single spaces; null text -> null, '' -> 1."""
    return F.when(_c(col).isNotNull(), F.size(F.split(_c(col), " ")))


# F9 -------------------------------------------------------------------------
def tenure_days(joined_on, reference_date: str = S.TENURE_REFERENCE_DATE) -> Column:
    return F.datediff(F.lit(reference_date).cast("date"), _c(joined_on))


def tenure_days_from_epoch_ms(joined_on_ms, reference_date: str = S.TENURE_REFERENCE_DATE) -> Column:
    """The reference's reading of joined_on as epoch milliseconds (D3)."""
    return F.datediff(F.lit(reference_date).cast("date"),
                      F.to_date(F.from_unixtime(_c(joined_on_ms) / 1000)))


# F10 / F11 --------------------------------------------------------------------
def to_ts(col) -> Column:
    """Text -> timestamp; unparsable text -> null (ANSI-safe)."""
    return F.try_to_timestamp(_c(col))


def hour_of_day(ts) -> Column:
    return F.hour(_c(ts))


def day_of_week(ts) -> Column:
    """Sunday = 0 ... Saturday = 6."""
    return F.dayofweek(_c(ts)) - 1


# F12 ------------------------------------------------------------------------
def engagement_label(interaction_type, dwell) -> Column:
    t = _c(interaction_type)
    expr = None
    for kind, weight in S.LABEL_WEIGHTS.items():
        expr = F.when(t == kind, F.lit(weight)) if expr is None else expr.when(t == kind, F.lit(weight))
    expr = expr.when((t == "view") & (_c(dwell) >= S.VIEW_DWELL_THRESHOLD), F.lit(S.VIEW_LABEL))
    return expr.otherwise(F.lit(0.0))


# F13 / F14 --------------------------------------------------------------------
def truncate(col, n: int = S.POST_TEXT_CHARS) -> Column:
    return F.substring(F.coalesce(_c(col), F.lit("")), 1, n)


def join_text(*cols) -> Column:
    """Null-safe text concatenation with single spaces."""
    return F.concat_ws(" ", *[F.coalesce(_c(c), F.lit("")) for c in cols])


# F15 ------------------------------------------------------------------------
def safe_text(col, data_type: T.DataType | None = None) -> Column:
    """null -> '', list/map/struct -> JSON text, anything else -> its text."""
    if isinstance(data_type, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.to_json(_c(col)), F.lit(""))
    return F.coalesce(_c(col).cast("string"), F.lit(""))


# F16 ------------------------------------------------------------------------
def parse_datetime_repr(col) -> Column:
    """`datetime.datetime(<args>)` argument text -> ISO text; else unchanged."""
    c = _c(col)
    parts = F.filter(F.transform(F.split(c, ","), lambda s: F.trim(s)), lambda s: s != "")
    nums = F.transform(parts, lambda s: s.try_cast("int"))
    n = F.size(nums)
    ok = (n >= 3) & (n <= 7) & F.forall(nums, lambda x: x.isNotNull())

    def part(i):
        return F.coalesce(F.try_element_at(nums, F.lit(i)), F.lit(0))

    micros = part(7)
    secs = (part(6) + micros / F.lit(1_000_000)).cast("decimal(16,6)")
    ts = F.try_make_timestamp(part(1), F.coalesce(F.try_element_at(nums, F.lit(2)), F.lit(1)),
                              F.coalesce(F.try_element_at(nums, F.lit(3)), F.lit(1)), part(4), part(5), secs)
    valid = ok & ts.isNotNull() & (micros >= 0) & (micros < 1_000_000) & (part(6) < 60) & (part(1) >= 1)
    iso = F.when(micros == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")) \
        .otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    return F.when(valid, iso).otherwise(c)


# F17 ------------------------------------------------------------------------
def image_filename(url, post_id) -> Column:
    u = _c(url)
    ext = F.lower(F.element_at(F.split(F.substring_index(u, "?", 1), r"\."), -1))
    ext = F.when(ext.isin(*S.IMAGE_EXTENSIONS), ext).otherwise(F.lit(S.DEFAULT_IMAGE_EXTENSION))
    return F.when(u.isNotNull() & u.startswith("http"),
                  F.concat(_c(post_id).cast("string"), F.lit("."), ext)).otherwise(F.lit(""))


# F18 ------------------------------------------------------------------------
def equals_ignore_case(a, b) -> Column:
    return F.lower(_c(a)) == F.lower(_c(b))


# F19 ------------------------------------------------------------------------
def parse_topic_list(text: str | None) -> list[str]:
    """Comma list -> topics, trimmed, empties dropped (driver-side argument)."""
    return [t.strip() for t in (text or "").split(",") if t.strip()]


# F20 ------------------------------------------------------------------------
def field_map(json_object_text) -> Column:
    """Object text -> map<string,string>: null -> '', scalar -> its text,
    nested value -> its JSON text."""
    m = F.from_json(_c(json_object_text), T.MapType(T.StringType(), T.StringType()))
    return F.transform_values(m, lambda k, v: F.coalesce(v, F.lit("")))


# F21 ------------------------------------------------------------------------
def first_non_empty(*cols) -> Column:
    """First value that is neither null nor empty text (Python `a or b or c`)."""
    return F.coalesce(*[F.nullif(_c(c).cast("string"), F.lit("")) for c in cols])


# P1 helpers -------------------------------------------------------------------
def blank_to_null(col) -> Column:
    return F.nullif(_c(col), F.lit(""))


def int_or_default(col, default: int = 0) -> Column:
    return F.coalesce(blank_to_null(col).try_cast("int"), F.lit(default))
