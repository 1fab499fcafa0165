"""Column expressions that the engine's operators are made of; all run in the JVM.

Strings are code points. Patterns are the shell kind: `*` any run, `?` one character, `[a-z]` and
`[^a-z]` classes with a leading `]` literal; they match whole strings and tell case.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Col = Column | str


def col(c: Col) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ------------------------------------------------------------- code points


def code_point(c: Col) -> Column:
    """The first code point of a string as a number; null for null or empty."""
    c = col(c)
    return F.when(F.length(c) > 0, F.ascii(c))


def char_of(number: Col) -> Column:
    """The character of a code point; null outside Unicode and for surrogates."""
    n = col(number).cast("long")
    ok = (n >= 0) & (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
    return F.when(ok, F.decode(F.unhex(F.lpad(F.hex(F.when(ok, n)), 8, "0")), "UTF-32"))


def hex_char(digits: Col) -> Column:
    """The character of hexadecimal digits; null where they aren't such."""
    d = col(digits)
    return F.when(d.rlike("^[0-9A-Fa-f]{1,8}$"), char_of(F.conv(d, 16, 10)))


def u_plus(c: Col) -> Column:
    """U+XXXX of the first code point, with four digits at least."""
    return F.when(code_point(c).isNotNull(), F.format_string("U+%04X", code_point(c)))


def u_char(c: Col) -> Column:
    """The character of U+XXXX; null where the text isn't that."""
    return hex_char(F.when(col(c).rlike(r"^U\+[0-9A-Fa-f]{4,6}$"), F.substring(col(c), 3, 8)))


def sequence_name(c: Col, joint: str = "_") -> Column:
    """XXXX_XXXX of a string of two code points."""
    c = col(c)
    return F.when(F.length(c) >= 2, F.format_string(f"%04X{joint}%04X", code_point(c), code_point(F.substring(c, 2, 1))))


def sequence_char(c: Col) -> Column:
    """The two characters of XXXX_XXXX."""
    parts = F.split(col(c), "_")
    return F.concat(hex_char(F.get(parts, F.lit(0))), hex_char(F.get(parts, F.lit(1))))


def first_char(c: Col) -> Column:
    return F.substring(col(c), 1, 1)


def starts_with_char(c: Col, char: str) -> Column:
    """Is `char` the first code point? As a half-open range, which reaches a file scan."""
    after = ord(char) + 1
    if 0xD800 <= after <= 0xDFFF:
        after = 0xE000
    test = col(c) >= F.lit(char)
    return test & (col(c) < F.lit(chr(after))) if after <= 0x10FFFF else test


# ------------------------------------------------------------- numbers in text


def leading_int(c: Col) -> Column:
    """The whole number that a text begins with, 0 without one: '12 11' is 12, 'x' is 0; null stays null."""
    c = col(c).cast("string")
    digits = F.regexp_extract(c, r"^[ \t\n\r\f\x0B]*([+-]?[0-9]+)", 1)
    return F.when(c.isNotNull(), F.coalesce(digits.try_cast("long"), F.lit(0).cast("long")))


def parse_int(c: Col, base: int = 10) -> Column:
    """The longest number of that base that a text begins with, after blanks and a sign; else null.
    Base 16 takes a leading 0x."""
    digits = "".join("0123456789abcdefghijklmnopqrstuvwxyz"[:base])
    cls = digits + digits[10:].upper()
    lead = "(?:0[xX])?" if base == 16 else ""
    sign = F.regexp_extract(col(c), r"^\s*([+-]?)", 1)
    found = F.regexp_extract(col(c), rf"^\s*[+-]?{lead}([{cls}]+)", 1)
    value = F.conv(F.when(found != "", found), base, 10).cast("decimal(20,0)")
    return F.when(sign == "-", -value).otherwise(value).try_cast("long")


# ------------------------------------------------------------- patterns


def glob_regex(pattern: str) -> str:
    """The Java regular expression of a shell pattern, for whole strings."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            j = i + 1
            no = j < len(pattern) and pattern[j] == "^"
            j += no
            end = pattern.find("]", j + 1)
            if end < 0 or j >= len(pattern):
                return r"\A(?!)\z"  # an open class matches nothing
            body = pattern[j:end]
            parts, k = [], 0
            while k < len(body):
                if k + 2 < len(body) and body[k + 1] == "-":
                    lo, hi = body[k], body[k + 2]
                    if lo <= hi:
                        parts.append(f"{_in_class(lo)}-{_in_class(hi)}")
                    k += 3
                else:
                    parts.append(_in_class(body[k]))
                    k += 1
            out.append(f"[{'^' if no else ''}{''.join(parts)}]" if parts else ("." if no else "(?!)"))
            i = end
        else:
            out.append(re.escape(c) if c.isascii() and not c.isalnum() else c)
        i += 1
    return rf"(?s)\A{''.join(out)}\z"


def _in_class(c: str) -> str:
    return "\\" + c if c in r"\]^-[&" else c


def glob(c: Col, pattern: str) -> Column:
    """Does the string match? A literal is an equality and a literal with a last * a prefix, so that both
    reach a file scan."""
    plain = pattern.rstrip("*")
    if not re.search(r"[*?\[]", pattern):
        return col(c) == F.lit(pattern)
    if len(plain) < len(pattern) and not re.search(r"[*?\[]", plain):
        return col(c).startswith(plain) if plain else col(c).isNotNull()
    return col(c).rlike(glob_regex(pattern))


def has_token(c: Col, token: str) -> Column:
    """Is `token` the text or one of its space-separated parts? A token with pattern signs is a pattern
    in the parts, and plain for the whole text."""
    c = col(c)
    if re.search(r"[*?\[ ]", token):
        whole = c == F.lit(token)
        return whole | glob(c, f"{token} *") | glob(c, f"* {token} *") | glob(c, f"* {token}")
    return F.array_contains(F.split(c, " "), token)


def regexp_all(c: Col, pattern: str, groups: int) -> Column:
    """All matches as structs of the match and its groups' texts."""
    parts = [F.regexp_extract_all(col(c), F.lit(f"({pattern})"), F.lit(k)) for k in range(1, groups + 2)]
    fields = ["substr", *(f"g{k}" for k in range(1, groups + 1))]
    zipped = F.arrays_zip(*(p.alias(f) for p, f in zip(parts, fields, strict=True)))
    return zipped


def split_with_index(c: Col, mark: str) -> Column:
    """Parts with places from 1, as an array of (i, value); an empty mark gives the characters."""
    return F.transform(F.split(col(c), re.escape(mark) if mark else ""), lambda x, i: F.struct((i + 1).alias("i"), x.alias("value")))


def register(spark: SparkSession) -> None:
    """SQL names of the functions that queries use by name; `regexp_all` gives JSON and is the one that
    needs Python, since SQL has no names for groups."""

    def all_json(text: str | None, pattern: str | None) -> str | None:
        import json

        if text is None or pattern is None:
            return None
        found = []
        for m in re.finditer(re.sub(r"\(\?<([A-Za-z_]\w*)>", r"(?P<\1>", pattern), text):
            found.append({"substr": m[0], "groups": m.groupdict() or list(m.groups())})
        return json.dumps(found, ensure_ascii=False, separators=(",", ":"))

    def prefix_int(text: str | None, base: int | None) -> int | None:
        base = base or 10
        digits = "0123456789abcdefghijklmnopqrstuvwxyz"[:base]
        m = re.match(rf"\s*([+-]?){'(?:0[xX])?' if base == 16 else ''}([{digits}{digits[10:].upper()}]+)", text or "")
        return int(m[1] + m[2], base) if m else None

    spark.udf.register("regexp_all", all_json, T.StringType())
    spark.udf.register("parse_int", prefix_int, T.LongType())
