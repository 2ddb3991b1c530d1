"""HTML character references, decoded with built-in expressions only.

Nearly every text uses a handful of references, each of which is one native `replace`. A text that
uses anything else takes the complete path: it is cut at its ampersands, and the head of each
piece is looked up or computed. Both paths run in the JVM; `CASE WHEN` evaluates the second one
only for the texts that need it.
"""

import html.entities
import json
import re

from pyspark.sql import Column, functions as F

_NAMED = html.entities.html5

# Handled by the short path. `amp` is replaced last, so that "&amp;lt;" becomes "&lt;".
COMMON = ["lt", "gt", "quot", "nbsp", "copy", "middot", "mdash", "ndash", "hellip", "rsquo",
          "lsquo", "rdquo", "ldquo", "amp"]

_BEYOND_COMMON = "&(?!(?:" + "|".join(COMMON) + ");)[A-Za-z#]"

_NAME = r"^([^\t\n\f <&#;]{1,32};?)"
_NUMBER = r"^#([0-9]+|[xX][0-9a-fA-F]+);?"

# Names that count even without their semicolon, longest first so that the longest prefix wins.
_BARE = sorted((n for n in _NAMED if not n.endswith(";")), key=len, reverse=True)
_BARE_PREFIX = "^(" + "|".join(map(re.escape, _BARE)) + ")"

_BEYOND_UNICODE = 0x110000


def _named(name: Column) -> Column:
    """Text of a named reference, null when there is none of that name.

    The table is first letter -> name -> text: two levels keep the linear map lookups short.
    """
    by_letter: dict[str, dict[str, str]] = {}
    for key, text in _NAMED.items():
        by_letter.setdefault(key[0], {})[key] = text
    table = F.from_json(F.lit(json.dumps(by_letter)), "map<string,map<string,string>>")
    return F.element_at(F.element_at(table, F.substring(name, 1, 1)), name)


def _bare(name: Column) -> Column:
    table = F.from_json(F.lit(json.dumps({n: _NAMED[n] for n in _BARE})), "map<string,string>")
    return F.element_at(table, name)


def _windows_1252(n: Column) -> Column:
    """The numeric references 128-159 stand for Windows-1252 characters."""
    pairs = {str(i): bytes([i]).decode("cp1252", errors="ignore") or chr(i)
             for i in range(0x80, 0xA0)}
    table = F.from_json(F.lit(json.dumps(pairs)), "map<string,string>")
    return F.element_at(table, n.cast("string"))


def _code_point(number: Column) -> Column:
    """Digits of a numeric reference, or x and hex digits -> code point; "" -> null."""
    digits = F.ltrim(number, F.lit("xX0"))
    value = F.when(number.rlike("^[xX]"), F.conv(digits, 16, 10)).otherwise(digits)
    return (F.when(number == "", F.lit(None).cast("long"))
            .when(digits == "", F.lit(0))
            .when(F.length(digits) > 9, F.lit(_BEYOND_UNICODE))
            .otherwise(value.try_cast("long")))


def _character(n: Column) -> Column:
    """Text of a code point, with HTML's substitutions for those it forbids; null -> null."""
    forbidden = (n.between(0x1, 0x8) | n.between(0xE, 0x1F) | (n == 0x7F) | (n == 0xB)
                 | n.between(0xFDD0, 0xFDEF) | (n.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE))
    return (F.when(n.isNull(), F.lit(None).cast("string"))
            .when((n == 0) | n.between(0xD800, 0xDFFF) | (n >= _BEYOND_UNICODE), F.lit("�"))
            .when(n.between(0x80, 0x9F), _windows_1252(n))
            .when(forbidden, F.lit(""))
            .otherwise(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")))


def _scan(piece: Column) -> Column:
    """What a piece, the text after an ampersand, starts with."""
    name = F.regexp_extract(piece, _NAME, 1)
    return F.struct(
        piece.alias("piece"),
        name.alias("name"),
        F.regexp_extract(name, _BARE_PREFIX, 1).alias("bare"),
        _code_point(F.regexp_extract(piece, _NUMBER, 1)).alias("code_point"),
    )


def _resolve(head: Column) -> Column:
    """Decode a scanned piece: the first alternative whose reference exists is not null."""
    piece, name, bare = head["piece"], head["name"], head["bare"]

    def after(matched: Column) -> Column:
        return piece.substr(F.length(matched) + 1, F.length(piece))

    return F.coalesce(
        F.concat(_character(head["code_point"]), F.regexp_replace(piece, _NUMBER, "")),
        F.concat(_named(name), after(name)),
        F.concat(_bare(bare), after(bare)),
        F.concat(F.lit("&"), piece),
    )


def decode_all(text: Column) -> Column:
    """The complete path: every named reference, numeric ones, missing semicolons."""
    pieces = F.split(text, "&", -1)
    scanned = F.transform(F.slice(pieces, 2, F.size(pieces)), _scan)
    return F.concat(pieces[0], F.array_join(F.transform(scanned, _resolve), ""))


def decode_common(text: Column) -> Column:
    """The short path: the references listed in COMMON."""
    for name in COMMON:
        text = F.replace(text, F.lit(f"&{name};"), F.lit(_NAMED[name + ";"]))
    return text


def decode_entities(text: Column) -> Column:
    """Decode the HTML character references of `text`, once (no double decoding)."""
    return (F.when(~text.contains("&"), text)
            .when(text.rlike(_BEYOND_COMMON), decode_all(text))
            .otherwise(decode_common(text)))
