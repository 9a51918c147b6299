"""Text functions on columns: stripping, HTML entities."""

from __future__ import annotations

import json
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as white space at the ends of a text: all of Unicode's, and the separators of ASCII.
SPACE = r"[\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"


def strip(text: Column) -> Column:
    """A text without white space at its ends."""
    return F.regexp_replace(text, rf"^{SPACE}+|(?<!{SPACE}){SPACE}+\z", "")


def constant(value: list | dict, kind: str) -> Column:
    """A list or mapping as one literal: Spark folds it once, where a literal for each entry takes longer to plan than many texts take to read."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _character(code: Column) -> Column:
    """The character of a code point; what is none becomes the replacement character."""
    valid = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.decode(F.unhex(F.lpad(F.hex(F.when(valid, code).otherwise(0xFFFD)), 8, "0")), "UTF-32")


def unescape(text: Column) -> Column:
    """A text with its HTML entities resolved, named ones of HTML 4 and numbers; what is no entity stays as it is."""
    named = constant({n: chr(c) for n, c in [*name2codepoint.items(), ("apos", 39)]}, "map<string,string>")

    def resolved(piece: Column, i: Column) -> Column:
        name = F.regexp_extract(piece, r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);", 1)
        digits = F.regexp_extract(name, r"^#[xX]?([0-9a-fA-F]+)$", 1)
        code = F.when(name.rlike("^#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).try_cast("long")
        found = F.when(F.startswith(name, F.lit("#")), _character(code)).when(name != "", F.try_element_at(named, name))
        return F.when(i == 0, piece).when(found.isNotNull(), F.concat(found, F.substring(piece, F.length(name) + 2, F.length(piece)))).otherwise(F.concat(F.lit("&"), piece))

    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(F.split(text, "&", -1), resolved), "")).otherwise(text)
