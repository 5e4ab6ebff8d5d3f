"""Text, array, map and JSON functions on Columns."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Katakana letters that have a hiragana letter 0x60 below.
KATAKANA = "".join(map(chr, [*range(0x30A1, 0x30F7), 0x30FD, 0x30FE]))
HIRAGANA = "".join(chr(ord(c) - 0x60) for c in KATAKANA)
#: Small kana that join the mora before them, and morae that nothing joins.
SMALL = "ゃゅょぁぃぅぇぉゎゕゖ"
CLOSED = ("っ", "ん", "ー")
#: A Latin word with at most one inner apostrophe, or a run of Japanese; what normalised kana keeps; what isn't kana yet.
TOKEN = "[0-9a-z]+(?:'[0-9a-z]+)?|[ぁ-ゖァ-ヺー一-龯々〆ヵヶ]+"
NOT_KANA = "[^ぁ-ゖゝゞーa-z0-9]"
UNREAD = "[ヷ-ヺ一-龯々〆]"


def tokens(text: Column) -> Column:
    """Lower-cased Latin words and Japanese spans; curly apostrophes count as straight."""
    return F.regexp_extract_all(F.lower(F.translate(text, "’", "'")), F.lit(TOKEN), F.lit(0))


def characters(tokens: Column) -> Column:
    """The characters of the joined tokens."""
    return F.filter(F.split(F.concat_ws("", tokens), ""), lambda c: c != "")


def katakana_to_hiragana(text: Column) -> Column:
    return F.translate(text, KATAKANA, HIRAGANA)


@F.arrow_udf(T.StringType())
def nfkc(text: pa.Array) -> pa.Array:
    """Compatibility composition, which has no built-in function."""
    return pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in text.to_pylist()], pa.string())


def normalize_kana(text: Column) -> Column:
    """NFKC, lower case, hiragana; only hiragana, the long mark and ASCII letters and digits stay."""
    return F.regexp_replace(katakana_to_hiragana(F.lower(nfkc(text))), NOT_KANA, "")


def contains_kanji(text: Column) -> Column:
    return nfkc(text).rlike(UNREAD)


def morae(kana: Column) -> Column:
    """Mora-like units of normalised kana: small kana join the unit before, but not っ, ん or ー."""
    letters = F.filter(F.split(kana, ""), lambda c: c != "")

    def step(done: Column, c: Column) -> Column:
        last = F.element_at(done, -1)
        joins = c.isin(*SMALL) & (F.size(done) > 0) & ~last.isin(*CLOSED)
        return F.when(joins, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.concat(last, c)))).otherwise(F.concat(done, F.array(c)))

    return F.aggregate(letters, F.expr("cast(array() as array<string>)"), step)


#: Unicode's space separators, which DuckDB's trim takes off.
SPACES = " \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"


def lines(text: Column, ends: str = "\\r\\n|\\n|\\r") -> Column:
    """Lines without spaces around them that aren't empty. ends: pattern of a line's end."""
    return F.filter(F.transform(F.split(text, ends), lambda s: F.trim(s, F.lit(SPACES))), lambda s: s != "")


def version(text: Column) -> Column:
    """The first a.b.c (or a.b) in the text as a struct that compares like a version; null without one."""
    part = [F.regexp_extract(text, "(\\d+)\\.(\\d+)(?:\\.(\\d+))?", k) for k in (1, 2, 3)]
    number = [F.coalesce(F.nullif(p, F.lit("")).cast("int"), F.lit(0)) for p in part]
    return F.when(part[0] != "", F.struct(*[n.alias(k) for n, k in zip(number, ("major", "minor", "patch"), strict=True)]))


def version_at_least(current: Column, required: Column) -> Column:
    return version(current) >= version(required)


def named_number(text: Column, name: str) -> Column:
    """The number after `name=` or `name:` in a tool's output; null if undefined or missing."""
    return F.regexp_extract(text, f"(?i)\\b{name}\\s*[=:]\\s*([-+]?\\d+(?:\\.\\d*)?(?:[eE][-+]?\\d+)?)", 1).try_cast("double")


def time_code(seconds: Column) -> Column:
    """mm:ss.ss"""
    return F.format_string("%02d:%05.2f", F.floor(seconds / 60).cast("int"), seconds - 60 * F.floor(seconds / 60))


def equal_spans(units: Column, start: Column, end: Column) -> Column:
    """Each unit with an equal share of [start, end], in order."""
    n = F.size(units)

    def span(unit: Column, k: Column) -> Column:
        return F.struct(unit.alias("label"), (start + (end - start) * k / n).alias("start_s"), (start + (end - start) * (k + 1) / n).alias("end_s"))

    return F.transform(units, span)


def resample(values: Column, n: int) -> Column:
    """An array at n equally spaced places from its first to its last value, by linear interpolation."""
    size = F.size(values)
    place = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: k * (size - 1) / F.lit(max(1, n - 1)))

    def at(p: Column) -> Column:
        low = F.least(F.floor(p).cast("int"), size - 1)
        a, b = F.element_at(values, low + 1), F.element_at(values, F.least(low + 2, size))
        return a + (b - a) * (p - low)

    return F.transform(place, at)


def with_defaults(values: Column, defaults: Column) -> Column:
    """Two maps in one; the first wins."""
    keys = F.array_union(F.map_keys(defaults), F.map_keys(values))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.coalesce(values[k], defaults[k])))


def nested(json: Column, path: str, default: Column) -> Column:
    """A value at a JSON path as text, or the default."""
    return F.coalesce(F.get_json_object(json, path), default)
