"""Format-preserving pseudonyms for personal data.

Numbers and dates that pass validation are replaced by a keyed Feistel permutation of their own format:
the same value becomes the same pseudonym in every document, two values never become one, and the
result passes the same validation (a card number keeps its length and gets a right check digit, a date
stays a date). E-mail names are permuted as strings of their letters and digits; secrets are permuted
within their alphabet. Two Feistel networks do it. Numbers of up to NUMBER_BITS bits, and strings with no more
readings than that, run through an unbalanced one with keyed BLAKE2b rounds, and cycle walking where only some of
a format's strings are valid. Longer strings are cut into two halves of places; a round adds to each place of one half a
number from SHAKE-256 over the key and the whole other half, within the place's own alphabet, so every place
depends on all others at any length and the work is linear. `back` undoes both for whoever has the key.

The same value written differently keeps its link: card numbers, social security numbers and IBANs with or without
separators; phone numbers with a calling code, whatever stands between the digits; dates in any order and padding,
since a date's pseudonym keeps the class of its day (to 9, to 12, beyond) and month (to 9, beyond). A phone
number without a calling code is not linked with the one that has it.

Found: e-mail addresses; card numbers of 13-19 digits that pass the Luhn check, and any other run of
13-19 digits; phone numbers with + or with an area code in brackets or separators; IPv4 addresses with
octets up to 255; social security numbers (3-2-4 digits with hyphens; with spaces if the number can be one; nine digits in a row
only behind `SSN` or `security number`, as any nine digits would do otherwise, and stay); IBANs in either case, with right check digits; dates (ISO,
and day/month/year or month/day/year with one separator); and secrets: hexadecimal strings of 32 or
more characters and known key prefixes, and values after token, key, secret or password with = or :.

Cases: a null text stays null with no finds; an empty text stays empty; every other byte of a text is
kept as it is; repeated rows give equal results; the table's other columns are passed on unchanged and
the new ones are prefixed names, which replace columns of the same name; an empty table gives an empty
result.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, read_table

#: Public example key; a deployment passes its own.
KEY = b"example key, to be replaced"
ROUNDS = 10
#: Twice what a round of the network over numbers may have to cover; a BLAKE2b digest has as many.
NUMBER_BITS = 256

_LOWER, _UPPER, _DIGITS, _HEX = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"


class Permuter:
    """Keyed permutations of mixed-radix strings; the tweak names the format."""

    def __init__(self, key: bytes = KEY):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, tweak: str, i: int, half: int) -> int:
        said = f"{tweak}|{i}|{half}".encode()
        return int.from_bytes(hashlib.blake2b(said, digest_size=32, key=self.key).digest(), "big")

    def _run(self, value: int, size: int, tweak: str, back: bool) -> int:
        # a * b >= size; values that leave the range walk on until they are inside again
        a = 1
        while a * a < size:
            a += max(1, a >> 1) if a * a * 4 < size else 1
            if a > 1 << 20:
                a = 1 << ((size.bit_length() + 1) // 2)
                break
        b = -(-size // a)
        while True:
            left, right = divmod(value, b)
            for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
                sign = -1 if back else 1
                if i % 2:
                    right = (right + sign * self._round(tweak, i, left)) % b
                else:
                    left = (left + sign * self._round(tweak, i, right)) % a
            value = left * b + right
            if value < size:
                return value

    def permute(self, value: int, size: int, tweak: str) -> int:
        return self._run(value, size, f"{tweak}|{size}", False) if size > 1 else value

    def invert(self, value: int, size: int, tweak: str) -> int:
        return self._run(value, size, f"{tweak}|{size}", True) if size > 1 else value

    def string(self, text: str, tweak: str, back: bool = False, hexadecimal: bool = True) -> str:
        """Letters and digits permuted, each place within its own class (hexadecimal strings within
        hexadecimal digits, unless told otherwise); other characters stay."""
        hexes = [k for k in (_HEX, _HEX.upper()) if hexadecimal and len(text) >= 16 and set(text) <= set(k)]
        tweak += "|hex" * bool(hexes)
        if len(text) > NUMBER_BITS // 5:  # a place has under five bits
            return self._places(text, hexes[0] if hexes else "", tweak, back)
        kinds = [next((k for k in hexes[:1] or (_DIGITS, _LOWER, _UPPER) if c in k), "") for c in text]
        size, value = 1, 0
        for c, k in zip(text, kinds, strict=True):
            if k:
                value, size = value * len(k) + k.index(c), size * len(k)
        value = (self.invert if back else self.permute)(value, size, tweak)
        out = []
        for c, k in zip(reversed(text), reversed(kinds), strict=True):
            if k:
                value, place = divmod(value, len(k))
                c = k[place]
            out.append(c)
        return "".join(reversed(out))

    def _places(self, text: str, alphabet: str, tweak: str, back: bool) -> str:
        """A long string: two halves of places, each place a number within its class."""
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").copy()
        digit, radix, kind = (np.zeros(len(code), np.uint64) for _ in range(3))
        kinds = [alphabet] if alphabet else [_DIGITS, _LOWER, _UPPER]
        letters = [np.array([ord(c) for c in k], np.uint32) for k in kinds]
        for n, k in enumerate(letters):
            order = np.argsort(k)
            at = np.minimum(np.searchsorted(k[order], code), len(k) - 1)
            own = k[order][at] == code
            digit[own], radix[own], kind[own] = order[at[own]], len(k), n
        some = np.flatnonzero(radix)
        halves, places = np.array_split(digit[some], 2), np.array_split(radix[some], 2)
        shape = hashlib.blake2b(radix[some].astype(np.uint8).tobytes(), digest_size=16).digest()
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            own, other = i % 2, 1 - i % 2
            said = b"|".join([self.key, tweak.encode(), str(i).encode(), shape, halves[other].astype(np.uint8).tobytes()])
            add = np.frombuffer(hashlib.shake_256(said).digest(4 * len(halves[own])), "<u4").astype(np.uint64) % places[own]
            halves[own] = (halves[own] + (places[own] - add if back else add)) % places[own]
        new = np.concatenate(halves)
        for n, k in enumerate(letters):
            own = kind[some] == n
            code[some[own]] = k[new[own].astype(np.int64)]
        return code.tobytes().decode("utf-32-le", "surrogatepass")

    def digits(self, text: str, tweak: str, valid: Callable[[str], bool] = lambda _: True, back: bool = False, keep: int = 0) -> str:
        """The digits after the first `keep` permuted among those strings that are valid; the rest stays."""
        plain = [c for c in text if c.isdigit() and c.isascii()]
        fixed, own = "".join(plain[:keep]), "".join(plain[keep:])
        size, value = 10 ** len(own), int(own or 0)
        while True:
            value = (self.invert if back else self.permute)(value, size, f"{tweak}|{fixed}")
            out = f"{fixed}{value:0{len(own)}d}" if own else fixed
            if valid(out):
                break
        new = iter(out)
        return "".join(next(new) if c.isdigit() and c.isascii() else c for c in text)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban_ok(text: str) -> bool:
    plain = text.replace(" ", "").upper()
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def ssn_ok(digits: str) -> bool:
    """Whether nine digits can be a social security number."""
    return digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"


#: Characters of a country's IBANs.
_IBAN_LONG = {
    country: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FO GL NL SD FK", 19: "MK SI", 20: "AT BA EE KZ LT LU XK MN", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
        29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}


def iban_end(text: str) -> int:
    """Where the IBAN ends that `text` begins with, which may have more words behind it; 0 without one. The
    country's length comes first, then the others from the longest on."""
    ends = [k for k in range(len(text), 14, -1) if k == len(text) or text[k] == " "]
    ends.sort(key=lambda k: len(text[:k].replace(" ", "")) != _IBAN_LONG.get(text[:2].upper()))
    return next((k for k in ends if iban_ok(text[:k])), 0)


_DAY0, _DAY1 = datetime.date(1900, 1, 1), datetime.date(2100, 1, 1)


def _as_date(y: str, m: str, d: str) -> datetime.date | None:
    try:
        at = datetime.date(int(y), int(m), int(d))
    except ValueError:
        return None
    return at if _DAY0 <= at < _DAY1 else None


PATTERNS: Sequence[tuple[str, str]] = (
    ("email", r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]+@[A-Za-z0-9](?:[A-Za-z0-9.\-]*[A-Za-z0-9])?\.[A-Za-z]{2,}"),
    ("secret", r"\b(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9_\-]{20,}|xox[abprs]-[A-Za-z0-9\-]{10,}|AIza[A-Za-z0-9_\-]{35}|(?=[0-9a-fA-F]*[0-9])(?:[0-9a-f]{32,}|[0-9A-F]{32,}))(?![A-Za-z0-9])"),
    ("quoted", r"(?i:token|secret|password|passwd|pwd|api[_\-]?key|access[_\-]?key)[\"']?\s*[:=]\s*[\"']?([^\"'\s,;]{8,})"),
    ("iban", r"\b[A-Za-z]{2}[0-9]{2}(?: ?[A-Za-z0-9]{4}){2,7}(?: ?[A-Za-z0-9]{1,4})?\b"),
    ("date", r"(?<![\d./\-])(?:(?:19|20)\d\d([\-/.])\d{1,2}\1\d{1,2}|\d{1,2}([\-/.])\d{1,2}\2(?:19|20)\d\d)(?![\d]|[./\-]\d)"),
    ("ip", r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d]|\.\d)"),
    ("ssn", r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])|(?<![\d\-])(?<!\d )\d{3} \d{2} \d{4}(?! ?\d)|(?i:(?<=\bssn )|(?<=\bssn:)|(?<=\bssn: )|(?<=\bssn=)|(?<=\bssn #)|(?<=security number )|(?<=security number: ))\d{9}(?!\d)"),
    ("card", r"(?<![\d.])(?:\d{13,19}|\d{4}(?:[ \-]\d{4}){3}|\d{4}[ \-]\d{6}[ \-]\d{5})(?!\d|\.\d)"),
    ("phone", r"(?<![\w+])(?:\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d(?:[ .\-]?\d){5,12}|\(\d{3}\)[ .\-]?\d{3}[ .\-]\d{4}|\d{3}[.\-]\d{3}[.\-]\d{4})(?![\d])"),
)
_ANY = re.compile("|".join(f"(?P<{name}>{re.sub(r'\\([12])', lambda m: f'(?P={name}{m[1]})', re.sub(r'\(\[\\-/\.\]\)', lambda m, n=iter('12'), name=name: f'(?P<{name}{next(n)}>[\\-/.])', p)) if name == 'date' else p.replace('([^', '(?P<value>[^') if name == 'quoted' else p})" for name, p in PATTERNS))
#: No find is without one of these: a text without any is passed on unsearched.
_HINT = re.compile(r"[\d@]|AKIA|ASIA|gh[pousr]_|sk-|xox[abprs]-|AIza|[:=]\s*[\"']?[^\"'\s,;]{8}")
_EACH = {name: re.compile(p) for name, p in PATTERNS}
#: These stay, so that a reader can tell what kind of secret stood there.
_PREFIX = re.compile(r"AKIA|ASIA|gh[pousr]_|sk-|xox[abprs]-|AIza")
KINDS = tuple(name for name, _ in PATTERNS)


def replace_date(text: str, permuter: Permuter, back: bool = False) -> str:
    parts = re.split(r"[\-/.]", text)
    marks = re.findall(r"[\-/.]", text)
    orders = [(0, 1, 2)] if len(parts[0]) == 4 else [(2, 1, 0), (2, 0, 1)]
    for y, m, d in orders:
        at = _as_date(parts[y], parts[m], parts[d])
        if at:
            break
    else:
        return text
    wide = [len(p) for p in parts]

    # A date keeps the class of its day and month: a day over 12 stays one, so that a reader can tell the order,
    # and one-digit days and months fit their place. So all ways to write a date share one permutation.
    def kind(t: datetime.date) -> tuple[int, bool]:
        return (t.day > 9) + (t.day > 12), t.month > 9

    own, value = kind(at), (at - _DAY0).days
    while True:
        value = (permuter.invert if back else permuter.permute)(value, (_DAY1 - _DAY0).days, "date")
        t = _DAY0 + datetime.timedelta(value)
        if kind(t) == own:
            break
    new = list(parts)
    new[y], new[m], new[d] = f"{t.year:04d}", str(t.month).zfill(wide[m]), str(t.day).zfill(wide[d])
    return f"{new[0]}{marks[0]}{new[1]}{marks[1]}{new[2]}"


def replace_ip(text: str, permuter: Permuter, back: bool = False) -> str:
    octets = [int(x) for x in text.split(".")]
    if max(octets) > 255:
        return text
    value = int.from_bytes(bytes(octets), "big")
    return ".".join(map(str, (permuter.invert if back else permuter.permute)(value, 2**32, "ip").to_bytes(4, "big")))


def replace_iban(text: str, permuter: Permuter, back: bool = False) -> str:
    plain = text.replace(" ", "").upper()
    if not iban_ok(plain):
        return text
    body = permuter.string(plain[4:], f"iban|{plain[:2]}", back, hexadecimal=False)
    check = 98 - int("".join(str(int(c, 36)) for c in body + plain[:2] + "00")) % 97
    new = iter(f"{plain[:2]}{check:02d}{body}")
    # letters stay at their places, and so does their case
    return "".join(c if c == " " else next(new).lower() if c.islower() else next(new) for c in text)


#: The two-digit calling codes of E.164; 1 and 7 have one digit, all others three.
_TWO_DIGITS = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


def calling_code(digits: str) -> int:
    """How many digits of an international number are its calling code."""
    return 1 if digits[0] in "17" else 2 if digits[:2] in _TWO_DIGITS else 3


def pseudonym(kind: str, text: str, permuter: Permuter, back: bool = False) -> str:
    """The pseudonym of a find (or, with `back`, what it stands for); the text itself if it isn't valid."""
    if not text.isascii() and kind in ("date", "ip", "ssn", "card", "phone"):
        # digits of other scripts: permuted as ASCII ones, and in their own script again place by place
        new = pseudonym(kind, "".join(str(int(c)) if c.isdecimal() else c for c in text), permuter, back)
        return "".join(chr(ord(c) - int(c) + int(d)) if c.isdecimal() and d.isdecimal() else d for c, d in zip(text, new, strict=True)) if len(new) == len(text) else new
    if kind == "email":
        name, _, host = text.partition("@")
        return f"{permuter.string(name, 'email|' + host.lower(), back)}@{host}"
    if kind == "date":
        return replace_date(text, permuter, back)
    if kind == "ip":
        return replace_ip(text, permuter, back)
    if kind == "iban":
        return replace_iban(text, permuter, back)
    if kind == "card":
        plain = re.sub(r"\D", "", text)
        right = luhn(plain)
        return permuter.digits(text, f"card|{right}", lambda d: luhn(d) == right, back)
    if kind == "ssn":
        own = ssn_ok(re.sub(r"\D", "", text))
        return permuter.digits(text, "ssn" if own else "ssn0", lambda d: ssn_ok(d) == own, back)
    if kind == "phone":
        return permuter.digits(text, "phone", back=back, keep=calling_code(re.sub(r"\D", "", text)) if text[0] == "+" else 0)
    fixed = _PREFIX.match(text)
    fixed = fixed[0] if fixed else ""
    return fixed + permuter.string(text[len(fixed) :], kind + fixed, back)


def valid_end(kind: str, text: str) -> int:
    """Where the find ends in a candidate of this kind; 0 if it fails validation."""
    if kind == "iban":
        return iban_end(text)
    if kind == "ip":
        return len(text) * all(int(x) <= 255 for x in text.split("."))
    if kind == "ssn" and " " in text:
        return len(text) * ssn_ok(re.sub(r"\D", "", "".join(str(int(c)) if c.isdecimal() else c for c in text)))
    if kind == "date":
        a, b, c = re.split(r"[\-/.]", text)
        return len(text) * any(_as_date(*ymd) is not None for ymd in ([(a, b, c)] if len(a) == 4 else [(c, b, a), (c, a, b)]))
    return len(text)


def finds(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, beginning, end) of all finds. Where a candidate is not valid the later kinds are tried at the
    same place, and then the search goes on from just behind its beginning."""
    at = 0
    while m := _ANY.search(text, at):
        kind = m.lastgroup
        if kind in ("date1", "date2"):
            kind = "date"
        kind = next(k for k in KINDS if m.group(k) is not None) if kind not in KINDS else kind
        s, e = m.span("value") if kind == "quoted" else m.span()
        own = valid_end(kind, text[s:e])
        if not own:
            for kind in KINDS[KINDS.index(kind) + 1 :]:
                if (c := _EACH[kind].match(text, m.start())) and (own := valid_end(kind, c[0])):
                    break
        if own:
            yield kind, s, s + own
        at = s + own if own else m.start() + 1


def replace_all(text: str, permuter: Permuter, back: bool = False) -> tuple[str, dict[str, int]]:
    """The text with pseudonyms, and how many finds of each kind it had."""
    if not _HINT.search(text):
        return text, {}
    found: dict[str, int] = {}
    out, at = [], 0
    for kind, s, e in finds(text):
        new = pseudonym(kind, text[s:e], permuter, back)
        found[kind] = found.get(kind, 0) + 1
        out += [text[at:s], new]
        at = e
    return ("".join([*out, text[at:]]), found) if found else (text, {})


def pseudonymise(docs: DataFrame, text_col: str = "text", key: bytes = KEY) -> DataFrame:
    """The table with pseudonyms in its text, and pii_found (kind to number)."""
    rest = [c for c in docs.columns if c not in (text_col, "pii_found")]
    numbered = {f"_{i}": c for i, c in enumerate(rest)}
    plain = docs.select(*(F.col(f"`{c}`").alias(n) for n, c in numbered.items()), F.col(f"`{text_col}`").alias("_text"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        permuter = Permuter(key)
        for batch, _, _ in batches(it, "_text"):
            texts, finds = [], []
            for t in batch.column(batch.num_columns - 1):
                t = t.as_py()
                new, found = (None, {}) if t is None else replace_all(t, permuter)
                texts.append(new)
                finds.append(list(found.items()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(finds, pa.map_(pa.string(), pa.int32()))], [*numbered, "_text", "pii_found"]
            )

    fields = [*plain.schema.fields]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", pii_found map<string,int>"
    done = plain.mapInArrow(run, schema)
    order = [F.col("_text").alias(text_col) if c == text_col else F.col({v: k for k, v in numbered.items()}[c]).alias(c) for c in docs.columns if c != "pii_found"]
    return done.select(*order, "pii_found")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pseudonymise(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.coalesce(F.try_element_at("pii_found", F.lit(kind)), F.lit(0)).cast("long")
    by_kind = [count(kind).alias(f"n_{kind}") for kind in KINDS]
    return done.select("doc_id", "text", sum((count(kind) for kind in KINDS), F.lit(0)).cast("long").alias("n_found"), *by_kind)
