"""Personal data as format-preserving pseudonyms.

E-mail and IP addresses, telephone, card, bank-account and social-security numbers, dates and access tokens are found
by pattern, validated (Luhn and mod-97 check digits, octets, calendar, number ranges) and replaced by a keyed
permutation of all values of their own format: a Feistel network over the value's rank, walked until it falls into
the range. What stands in for a valid card number is a valid card number; equal values get equal pseudonyms in every
document, with no table of what was met, so no shuffle is needed; and the key's owner can undo it (`reveal`).

Capitals of addresses and tokens do not matter for equality and are put back as they were. Defined cases: a null text
stays null and holds nothing; an empty text stays empty; rows that repeat are treated alike; ids may be null; an
empty table gives an empty result; in `pseudonymize` all other columns pass through.
"""

from __future__ import annotations

import datetime as dt
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import cache, lru_cache
from hashlib import blake2b

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: What is looked for. Order matters: the first that is valid at a place is taken.
PATTERNS = {
    "ip": r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d)",
    "date": r"(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{2}([./-])\d{2}\1\d{4})(?![\w/-]|\.\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?!\w)",
    "phone": r"(?<!\w)(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d(?:[ .-]?\d){5,12}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\w)",
    "card": r"(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-])",
    "token": r"(?<!\w)(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?!\w)",
}
EMAIL = re.compile(r"(?<![\w.%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![\w@])")
ANY = re.compile("|".join(f"(?P<{k}>{v})" for k, v in PATTERNS.items()).replace(r"\1", "(?P=sep)").replace("([./-])", "(?P<sep>[./-])"))
KINDS = (*PATTERNS, "email")
FIRST_DAY, LAST_DAY = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()
LOWER, DIGITS, HEX = "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef"


def permute(value: int, size: int, key: bytes, tweak: bytes, back: bool = False) -> int:
    """A keyed permutation of range(size)."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, width = (1 << half) - 1, -(-half // 8)
    while True:
        left, right = value >> half, value & mask
        for k in reversed(range(ROUNDS)) if back else range(ROUNDS):
            # back: the halves as they were before round k
            known = left if back else right
            h = blake2b(tweak + bytes([k]) + known.to_bytes(width, "little"), key=key, digest_size=64 if width > 32 else 32)
            f = int.from_bytes(h.digest() * (-(-width // 32)), "little") & mask
            left, right = (right ^ f, left) if back else (right, left ^ f)
        value = left << half | right
        if value < size:
            return value


def _spelled(text: str, alphabets: list[str | None], key: bytes, kind: str, back: bool) -> str:
    """`text` permuted over the places that have an alphabet."""
    value, size, shape = 0, 1, []
    for ch, alphabet in zip(text, alphabets):
        if alphabet:
            value = value * len(alphabet) + alphabet.index(ch)
            size *= len(alphabet)
            shape.append(alphabet[0] + str(len(alphabet)))
        else:
            shape.append(ch)
    value = permute(value, size, key, f"{kind}|{''.join(shape)}|".encode(), back)
    out = list(text)
    for at in range(len(text) - 1, -1, -1):
        if alphabet := alphabets[at]:
            value, place = divmod(value, len(alphabet))
            out[at] = alphabet[place]
    return "".join(out)


def _put_back(digits: str, like: str) -> str:
    """Digits and letters into the places that `like` has for them."""
    rest = iter(digits)
    return "".join(next(rest) if ch.isalnum() else ch for ch in like)


def luhn(digits: str) -> int:
    """The check digit that belongs behind the digits."""
    total = sum(sum(divmod(int(d) * (2 - k % 2), 10)) for k, d in enumerate(reversed(digits)))
    return -total % 10


def _iban_check(country: str, account: str) -> str:
    n = int("".join(str(int(c, 36)) for c in account + country + "00"))
    return f"{98 - n % 97:02d}"


def _date(text: str) -> tuple[dt.date, str] | None:
    styles = ["%Y-%m-%d"] if text[4] == "-" else [f"%d{text[2]}%m{text[2]}%Y", f"%m{text[2]}%d{text[2]}%Y"]
    for style in styles:
        try:
            day = dt.datetime.strptime(text, style).date()
        except ValueError:
            continue
        if FIRST_DAY <= day.toordinal() <= LAST_DAY:
            return day, style
    return None


@cache
def _days(late: bool) -> list[int]:
    """All days whose number in the month is 13 or more, or the others."""
    return [x for x in range(FIRST_DAY, LAST_DAY + 1) if (dt.date.fromordinal(x).day >= 13) == late]


def pseudonym(kind: str, text: str, key: bytes, back: bool = False) -> str | None:
    """What stands for the value; None where it is not valid."""
    if kind == "ip":
        octets = [int(x) for x in text.split(".")]
        if any(x > 255 for x in octets) or any(len(x) > 1 and x[0] == "0" for x in text.split(".")):
            return None
        return ".".join(map(str, permute(int.from_bytes(octets, "big"), 1 << 32, key, b"ip", back).to_bytes(4, "big")))
    if kind == "date":
        if not (found := _date(text)):
            return None
        # days of 13 and more stay such days, since they alone tell month first from day first; the permutation is
        # that of the day, however it is written
        day, style = found
        days = _days(day.day >= 13)
        at = permute(bisect_left(days, day.toordinal()), len(days), key, b"late-date" if day.day >= 13 else b"date", back)
        return dt.date.fromordinal(days[at]).strftime(style)
    if kind == "email":
        low = text.lower()
        keep = low.rindex(".")
        alphabets = [None if at >= keep else DIGITS if ch in DIGITS else LOWER if ch in LOWER else None for at, ch in enumerate(low)]
        return _cased(_spelled(low, alphabets, key, kind, back), text)
    if kind == "token":
        low = text.lower()
        return _cased(_spelled(low, [HEX] * len(low), key, kind, back), text)
    plain = re.sub(r"[^0-9A-Z]", "", text)
    if kind == "card":
        if luhn(plain[:-1]) != int(plain[-1]) or len(set(plain)) == 1:
            return None
        body = _spelled(plain[:-1], [DIGITS] * (len(plain) - 1), key, kind, back)
        while len(set(body + str(luhn(body)))) == 1:  # such numbers are not taken for cards: walk on
            body = _spelled(body, [DIGITS] * len(body), key, kind, back)
        return _put_back(body + str(luhn(body)), text)
    if kind == "iban":
        country, account = plain[:2], plain[4:]
        if plain[2:4] != _iban_check(country, account) or not 15 <= len(plain) <= 34:
            return None
        own = [DIGITS if c in DIGITS else LOWER.upper() for c in account]
        account = _spelled(account, own, key, kind + country, back)
        return _put_back(country + _iban_check(country, account) + account, text)
    if kind == "ssn":
        area, group, serial = int(plain[:3]), int(plain[3:5]), int(plain[5:])
        if area in (0, 666) or area >= 900 or not group or not serial:
            return None
        at = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
        at, serial = divmod(permute(at, 898 * 99 * 9999, key, b"ssn", back), 9999)
        area, group = divmod(at, 99)
        area += 1
        return f"{area + (area >= 666):03d}-{group + 1:02d}-{serial + 1:04d}"
    # phone: the country code stays where it stands apart
    if not 7 <= len(plain) <= 15:
        return None
    code = re.match(r"\+\d{1,3}(?=[ .(-])", text)
    n = len(code[0]) - 1 if code else 0
    return _put_back(plain[:n] + _spelled(plain[n:], [DIGITS] * (len(plain) - n), key, f"phone{plain[:n]}", back), text)


def _cased(low: str, like: str) -> str:
    """Capitals where `like` has them; a token in capitals is so throughout."""
    if like.upper() == like:
        return low.upper()
    return "".join(c.upper() if k.isupper() else c for c, k in zip(low, like))


@lru_cache(100_000)
def _looked_up(kind: str, text: str, key: bytes, back: bool) -> str | None:
    return pseudonym(kind, text, key, back)


_HINT = re.compile(r"[0-9@]")


def rewrite(text: str, key: bytes, back: bool = False) -> tuple[str, Counter]:
    """The text with each valid value replaced, and how many there are of each kind."""
    found: Counter = Counter()
    if not _HINT.search(text):
        return text, found

    def replace(m: re.Match) -> str:
        kind = m.lastgroup if m.lastgroup != "sep" else "date"
        kind = kind or "email"
        if (new := _looked_up(kind, m[0], key, back)) is not None:
            found[kind] += 1
            return new
        if kind != "card" and len(re.sub(r"\D", "", m[0])) >= 13 and m[0][0].isdigit() and (new := _looked_up("card", m[0], key, back)):
            found["card"] += 1
            return new
        return m[0]

    if "@" in text:
        # what stands between addresses is searched for the rest
        out, at = [], 0
        for m in EMAIL.finditer(text):
            out += [ANY.sub(replace, text[at : m.start()]), replace(m)]
            at = m.end()
        return "".join([*out, ANY.sub(replace, text[at:])]), found
    return ANY.sub(replace, text), found


def pseudonymize(docs: DataFrame, key: bytes, back: bool = False) -> DataFrame:
    """`docs` with the values in `text` replaced; all columns kept."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: rewrite(t, key, back)[0], na_action="ignore")

    return docs.withColumn("text", run("text"))


def reveal(docs: DataFrame, key: bytes) -> DataFrame:
    """The inverse of `pseudonymize` with the same key."""
    return pseudonymize(docs, key, back=True)


def report(docs: DataFrame, key: bytes) -> DataFrame:
    """doc_id, text (rewritten), n_values and n_<kind> for each row of `docs`."""

    @F.pandas_udf(", ".join(["text string", *(f"n_{k} long" for k in KINDS)]))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = [(None, Counter()) if t is None else rewrite(t, key) for t in texts]
            yield pd.DataFrame({"text": pd.Series([r[0] for r in rows], dtype=object)} | {f"n_{k}": [r[1][k] for r in rows] for k in KINDS})

    done = docs.select("doc_id", run("text").alias("r")).select("doc_id", "r.*")
    total = sum((F.col(f"n_{k}") for k in KINDS), F.lit(0).cast("long"))
    return done.withColumn("n_values", total)
