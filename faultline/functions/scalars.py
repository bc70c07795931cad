"""Casts, JSON scalars, rounding and text blocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline.functions.time import _col

NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
WORD = r"[\p{L}\p{N}]+"


def safe_timestamp(c: Column | str) -> Column:
    return _col(c).try_cast("timestamp")


def safe_double(c: Column | str) -> Column:
    """Double of a plain decimal text; words such as NaN and suffixes give NULL."""
    c = _col(c)
    return F.when(c.rlike(NUMBER_PATTERN), c.try_cast("double"))


def scalar_text(value: Column, payload: Column | str, path: str) -> Column:
    """Keep ``value`` (the text at ``path``) unless an object or array stands there.

    Only texts that begin like an object or array pay for the type check, which
    tells a nested value from a string that merely looks like one.
    """
    node = F.try_variant_get(F.try_parse_json(_col(payload)), path, "variant")
    nested = F.schema_of_variant(node).rlike("^(OBJECT|ARRAY)")
    # One CASE inside the other, not an AND: codegen computes what both sides of
    # an AND share ahead of it, and would parse every payload.
    checked = F.when(nested, F.lit(None).cast("string")).otherwise(value)
    return F.when(value.startswith("{") | value.startswith("["), checked).otherwise(value)


def json_scalar(payload: Column | str, path: str) -> Column:
    """Text of a JSON scalar; NULL for objects, arrays, absent paths and bad JSON."""
    payload = _col(payload)
    return scalar_text(F.get_json_object(payload, path), payload, path)


def nullif(a: Column | str, b) -> Column:
    return F.nullif(_col(a), b if isinstance(b, Column) else F.lit(b))


def round_to(x: Column | str, digits: int) -> Column:
    """Half-up rounding."""
    return F.round(_col(x), digits)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as a double, NULL when the whole is 0."""
    return part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))


def clip_max(x: Column | str, top: float) -> Column:
    x = _col(x)
    return F.when(x.isNotNull(), F.least(x, F.lit(top)))


def concat_str(*parts) -> Column:
    """Concatenate as text; one NULL makes the whole NULL."""
    return F.concat(*[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts])


def text_blocks(text: Column | str) -> Column:
    """Trimmed, non-empty blocks of a text separated by blank lines."""
    pieces = F.transform(F.split(_col(text), "\n\n"), lambda b: F.regexp_replace(b, r"^\s+|\s+$", ""))
    return F.array_remove(pieces, "")


def tokens(text: Column | str) -> Column:
    """Lower-cased words: runs of letters and digits, in order, with repeats."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(WORD), F.lit(0))


# Signs that a block can't hold everywhere, and the letter that stands for each after a backslash.
_CODES = {"\n": "n", " ": "s", "\t": "t", "\v": "v", "\f": "f", "\r": "r", "\x1e": "x", "": "e"}


def escape_block(value: Column | str, one_line: bool = False) -> Column:
    """The value so that it can be read back from a block of text.

    Left as it is unless it is empty, holds a backslash, a record separator or a blank line, or begins with a line
    break or ends in white space. ``one_line`` codes every line break and a leading blank as well.
    """
    code = lambda c: "\\" + _CODES[c]
    v = F.replace(F.replace(_col(value), F.lit("\\"), F.lit("\\\\")), F.lit("\x1e"), F.lit(code("\x1e")))
    v = F.regexp_replace(v, r"\n" if one_line else r"\A\n|\n(?=\n|\z)", "\\" + code("\n"))
    for c in " \t\v\f\r":
        v = F.regexp_replace(v, rf"[{c}]\z", "\\" + code(c))
    if one_line:
        v = F.regexp_replace(v, r"\A ", "\\" + code(" "))
    return F.when(v == "", F.lit(code(""))).otherwise(v)


def unescape_block(value: Column | str) -> Column:
    """Inverse of ``escape_block``; escaped backslashes part the text, so no other code spans them."""
    def decoded(piece: Column) -> Column:
        for sign, letter in _CODES.items():
            piece = F.replace(piece, F.lit("\\" + letter), F.lit(sign))
        return piece

    return F.array_join(F.transform(F.split(_col(value), r"\\\\"), decoded), "\\")
