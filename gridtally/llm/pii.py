"""Format-preserving pseudonyms for personal data.

Numbers and dates that pass their own validation are put through a keyed
permutation within their format: a card number becomes another valid card
number of the same length and grouping, a date another calendar date written
the same way.  The permutation acts on the value, not on its spelling, so equal
values get equal pseudonyms in every document and in every spelling, and joins
on them still work.  Whoever holds the key can undo it.

The permutation of 0..n-1 is an alternating Feistel network over two unequal
halves with keyed BLAKE2 as round function; values that fall outside the range
walk on along their cycle until they are inside.

Kinds: email (local part), phone, card (Luhn), iban (mod 97), ssn, ipv4, date
(calendar), secret (hexadecimal keys after "token =" and the like).  Where a
candidate fails validation, shorter ends at group borders, the other kinds and
later starts are tried; a card in an unusual grouping gives way to stricter finds
that overlap it.  A number that fails all is not personal data and stays.  Null texts stay null;
texts without finds stay byte for byte the same, and so do dates outside 1900-2099.
Repeated rows are masked alike, a very long text is read whole in its row, and an empty
table gives an empty one.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gridtally.llm.common import text_slices

#: The default key pseudonymises tests; production passes its own.
DEMO_KEY = b"not a secret: replace me"
ROUNDS = 8
FIRST_DAY = datetime.date(1900, 1, 1).toordinal()
DAYS = datetime.date(2100, 1, 1).toordinal() - FIRST_DAY
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def feistel(value: int, size: int, key: bytes, tweak: bytes, back: bool = False) -> int:
    """The place of value in the keyed permutation of 0..size-1; back undoes it."""
    if size < 2:
        return value
    low = 1 << ((size - 1).bit_length() + 1) // 2
    high = -(-size // low)

    def mask(part: int, i: int) -> int:
        text = b"%d|%d|%d|" % (size, i, part) + tweak
        return int.from_bytes(hashlib.blake2b(text, digest_size=16, key=key).digest(), "big")

    while True:
        a, b = divmod(value, low)
        for i in range(ROUNDS - 1, -1, -1) if back else range(ROUNDS):
            sign = -1 if back else 1
            if i % 2:
                b = (b + sign * mask(a, i)) % low
            else:
                a = (a + sign * mask(b, i)) % high
        value = a * low + b
        if value < size:
            return value


def luhn_digit(payload: str) -> int:
    """The check digit that follows payload."""
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def luhn_valid(digits: str) -> bool:
    return luhn_digit(digits[:-1]) == int(digits[-1])


def iban_remainder(text: str) -> int:
    moved = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97


def refill(shape: str, digits: str) -> str:
    """shape with its digits replaced in turn."""
    fresh = iter(digits)
    return "".join(next(fresh) if c.isdigit() else c for c in shape)


def digits_of(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


class Cipher:
    """Pseudonyms under one key; a kind returns None for what fails its validation."""

    def __init__(self, key: bytes, back: bool = False):
        self.key, self.back = hashlib.blake2b(key, digest_size=32).digest(), back

    def number(self, digits: str, kind: bytes) -> str:
        n = len(digits)
        return str(feistel(int(digits), 10**n, self.key, kind, self.back)).zfill(n)

    def card(self, text: str) -> str | None:
        digits = digits_of(text)
        if not 13 <= len(digits) <= 19 or not luhn_valid(digits):
            return None
        if len(set(digits)) == 1:
            return None
        fresh = digits
        while True:  # a number of 19 digits stays on its side: its first 16 are a card or not
            payload = self.number(fresh[:-1], b"card")
            fresh = payload + str(luhn_digit(payload))
            if len(digits) < 19 or luhn_valid(fresh[:16]) == luhn_valid(digits[:16]):
                return refill(text, fresh)

    def phone(self, text: str) -> str | None:
        digits = digits_of(text)
        if not 10 <= len(digits) <= 15:
            return None
        return refill(text, digits[:-10] + self.number(digits[-10:], b"phone"))

    def ssn(self, text: str) -> str | None:
        """Areas 000, 666 and 900 up, group 00 and serial 0000 are never issued."""
        area, group, serial = (int(x) for x in text.split("-"))
        if area in (0, 666) or area >= 900 or not group or not serial:
            return None
        known = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
        found = feistel(known, 898 * 99 * 9999, self.key, b"ssn", self.back)
        rest, serial = divmod(found, 9999)
        area, group = divmod(rest, 99)
        return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"

    def ipv4(self, text: str) -> str | None:
        parts = text.split(".")
        if any(int(p) > 255 or p != str(int(p)) for p in parts):
            return None
        value = int.from_bytes(bytes(map(int, parts)), "big")
        found = feistel(value, 1 << 32, self.key, b"ipv4", self.back)
        return ".".join(map(str, found.to_bytes(4, "big")))

    def iban(self, text: str) -> str | None:
        plain = text.replace(" ", "")
        if not 15 <= len(plain) <= 34 or iban_remainder(plain) != 1:
            return None
        body = plain[4:]
        body = refill(body, self.number(digits_of(body), b"iban" + plain[:2].encode()))
        check = 98 - iban_remainder(plain[:2] + "00" + body)
        fresh = iter(f"{plain[:2]}{check:02d}{body}")
        return "".join(" " if c == " " else next(fresh) for c in text)

    def date(self, text: str) -> str | None:
        parts = re.split(r"[-/.]", text)
        marks = re.findall(r"[-/.]", text)
        if len(parts[0]) == 4:
            order, tweak = (0, 1, 2), b"date"
        else:  # day first unless only month first makes a date
            order, tweak = (2, 1, 0), b"date"
            if int(parts[1]) > 12:
                order = (2, 0, 1)
        try:
            known = datetime.date(*(int(parts[i]) for i in order)).toordinal() - FIRST_DAY
        except ValueError:
            return None
        if not 0 <= known < DAYS or marks[0] != marks[1]:
            return None
        found = feistel(known, DAYS, self.key, tweak, self.back)
        # Days up to the 12th read the same both ways; stay on the reading's own side.
        while order == (2, 0, 1) and datetime.date.fromordinal(FIRST_DAY + found).day <= 12:
            found = feistel(found, DAYS, self.key, tweak, self.back)
        day = datetime.date.fromordinal(FIRST_DAY + found)
        fields = dict(zip(order, (f"{day.year:04d}", f"{day.month:02d}", f"{day.day:02d}")))
        return fields[0] + marks[0] + fields[1] + marks[1] + fields[2]

    def secret(self, text: str) -> str:
        n = len(text)
        found = feistel(int(text, 16), 16**n, self.key, b"secret", self.back)
        spelled = f"{found:0{n}x}"
        return spelled.upper() if text.upper() == text else spelled

    def email(self, text: str) -> str:
        """The local part: letters stay letters, digits digits, the rest and the domain as is."""
        local, _, domain = text.partition("@")
        small = local.lower()
        letters = [c for c in small if c in LETTERS]
        digits = digits_of(small)
        value = 0
        for c in letters:
            value = value * 26 + LETTERS.index(c)
        value = value * 10 ** len(digits) + int(digits or "0")
        size = 26 ** len(letters) * 10 ** len(digits)
        shape = re.sub("[0-9]", "0", re.sub("[a-z]", "a", small))
        tweak = b"email" + shape.encode() + b"@" + domain.lower().encode()
        value = feistel(value, size, self.key, tweak, self.back)
        value, number = divmod(value, 10 ** len(digits))
        fresh = []
        for _ in letters:
            value, c = divmod(value, 26)
            fresh.append(LETTERS[c])
        new_letters, new_digits = iter(fresh[::-1]), iter(str(number).zfill(len(digits)))
        spelled = "".join(
            next(new_letters) if c in LETTERS else next(new_digits) if c.isdigit() else c
            for c in small
        )
        if local.isupper():
            spelled = spelled.upper()
        return f"{spelled}@{domain}"


#: Every kind begins with a digit, "+", "(", a letter of an address or a key's name; a text
#: is searched only if it holds a digit or an "@" at all.
FINDS = re.compile(
    r"(?P<email>(?<![\w.%+-])[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9])?"
    r"@[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}\.)+[A-Za-z]{2,24})(?![A-Za-z0-9@])"
    r"|(?:token|secret|password|api[_-]?key|access[_-]?key)\s*[=:]\s*[\"']?"
    r"(?P<secret>[0-9a-f]{16,128}|[0-9A-F]{16,128})(?![0-9A-Za-z])"
    r"|(?<![0-9A-Za-z])(?P<iban>[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)"
    r"(?![0-9A-Za-z])"
    r"|(?<![0-9A-Za-z.+-])(?:"
    r"(?P<phone>(?:\+[0-9]{1,3}[ .-]?)(?:\([0-9]{3}\) ?|[0-9]{3}[ .-]?)[0-9]{3}[ .-]?[0-9]{4}"
    r"|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})"
    r"|(?P<card>[0-9](?:[ -]?[0-9]){12,18})"
    r"|(?P<ssn>[0-9]{3}-[0-9]{2}-[0-9]{4})"
    r"|(?P<ipv4>[0-9]{1,3}(?:\.[0-9]{1,3}){3})"
    r"|(?P<date>[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}"
    r"|[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{4})"
    r")(?![0-9A-Za-z]|[.-][0-9])",
    re.ASCII | re.IGNORECASE,
)
HINT = re.compile("[0-9@]")

NOT_BEFORE, NOT_AFTER = "(?<![0-9A-Za-z.+-])", "(?![0-9A-Za-z]|[.-][0-9])"


def kind_pattern(kind: str) -> re.Pattern:
    """The pattern of one numeric kind by itself, cut out of FINDS."""
    a = FINDS.pattern.index(f"(?P<{kind}>")
    depth, b = 0, a
    while True:
        c = FINDS.pattern[b]
        depth += (c == "(") - (c == ")")
        b += 2 if c == "\\" else 1
        if not depth:
            return re.compile(NOT_BEFORE + FINDS.pattern[a:b] + NOT_AFTER, FINDS.flags)


NUMERIC = {kind: kind_pattern(kind) for kind in ("phone", "ssn", "ipv4", "date", "card")}
#: Groupings in which cards are printed; others count only where nothing stricter overlaps.
PRINTED = ([4, 4, 4, 4], [4, 6, 5], [4, 6, 4], [4, 4, 4, 4, 3])
GROUP = re.compile("[0-9]+", re.ASCII)
#: Characters of an IBAN by country; other countries are tried at every length.
IBAN_LENGTHS = dict(
    pair.split(":")
    for pair in (
        "AD:24 AE:23 AL:28 AT:20 AZ:28 BA:20 BE:16 BG:22 BH:22 BR:29 BY:28 CH:21 CR:22 CY:28 CZ:24"
        " DE:22 DK:18 DO:28 EE:20 EG:29 ES:24 FI:18 FO:18 FR:27 GB:22 GE:22 GI:23 GL:18 GR:27 GT:28"
        " HR:21 HU:28 IE:22 IL:23 IQ:23 IS:26 IT:27 JO:30 KW:30 KZ:20 LB:28 LC:32 LI:21 LT:20 LU:20"
        " LV:21 LY:25 MC:27 MD:24 ME:22 MK:19 MR:27 MT:31 MU:30 NL:18 NO:15 PK:24 PL:28 PS:29 PT:25"
        " QA:29 RO:24 RS:22 SA:24 SC:31 SD:18 SE:24 SI:19 SK:24 SM:27 ST:25 SV:28 TL:23 TN:24 TR:26"
        " UA:29 VA:22 VG:24 XK:20"
    ).split()
)


@lru_cache(32)
def iban_pattern(n: int) -> re.Pattern:
    groups, rest = divmod(n - 4, 4)
    tail = f" ?[A-Z0-9]{{{rest}}}" if rest else ""
    body = f"[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{groups}}}{tail}"
    return re.compile(f"(?<![0-9A-Za-z]){body}(?![0-9A-Za-z])", re.ASCII | re.IGNORECASE)


def candidates(text: str, m: re.Match):
    """Kind, span and strictness of all that may begin where m does, in order of preference."""
    at = m.start()
    if m.lastgroup in ("email", "secret"):
        yield m.lastgroup, *m.span(m.lastgroup), True
    lengths = list(range(34, 14, -1))
    own = int(IBAN_LENGTHS.get(text[at : at + 2].upper(), 0))
    for n in sorted(lengths, key=lambda n: n != own) if text[at].isalpha() else ():
        found = iban_pattern(n).match(text, at)
        if found:
            yield "iban", *found.span(), True
    for kind in ("phone", "ssn", "ipv4", "date"):
        found = NUMERIC[kind].match(text, at)
        if found:
            yield kind, *found.span(), True
    found = NUMERIC["card"].match(text, at)
    if found:
        groups = list(GROUP.finditer(text, at, found.end()))
        ends = []
        for k in range(1, len(groups) + 1):
            end, sizes = groups[k - 1].end(), [len(g[0]) for g in groups[:k]]
            if sum(sizes) >= 13:
                marks = {c for c in text[at:end] if not c.isdigit()}
                ends.append((k == 1 or sizes in PRINTED and len(marks) == 1, end))
        yield from (("card", at, end, True) for printed, end in ends if printed)
        yield from (("card", at, end, False) for printed, end in ends[::-1] if not printed)


def chosen(text: str, m: re.Match, own: Cipher, strict: bool = False):
    """The first valid candidate at m as (kind, start, end, pseudonym, rank), or None."""
    for rank, (kind, a, b, firm) in enumerate(candidates(text, m)):
        if strict and not firm:
            return None
        fresh = getattr(own, kind)(text[a:b])
        if fresh is not None and (firm or not overlapped(text, a, b, own)):
            return kind, a, b, fresh, rank
    return None


def overlapped(text: str, a: int, b: int, own: Cipher) -> bool:
    """Whether a strict find begins inside a..b, after a."""
    at = a + 1
    while (m := FINDS.search(text, at, b + 400)) and m.start() < b:
        if chosen(text, m, own, strict=True):
            return True
        at = m.start() + 1
    return False


@lru_cache(4)
def cipher(key: bytes, back: bool) -> Cipher:
    return Cipher(key, back)


def pseudonymised(text: str, own: Cipher) -> tuple[str, dict[str, int]]:
    """text with its personal data replaced, and the number of finds by kind."""
    kinds: dict[str, int] = {}
    if not HINT.search(text):
        return text, kinds

    parts, done, at = [], 0, 0
    failed: list[int] = []  # starts just before, where nothing was valid
    while m := FINDS.search(text, at):
        found = chosen(text, m, own)
        if found is None:
            failed = [t for t in failed if t > m.start() - 64] + [m.start()]
            at = m.start() + 1
            continue
        kind, a, b, fresh, rank = found
        failed = [t for t in failed if t > m.start() - 64]
        # A pseudonym that would be read otherwise is permuted on, so that it can be undone.
        while (rank or failed) and not read_alike(text, m.start(), a, b, fresh, failed, own):
            fresh = getattr(own, kind)(fresh)
        kinds[kind] = kinds.get(kind, 0) + 1
        parts += [text[done:a], fresh]
        done = at = b
        failed = []
    return "".join([*parts, text[done:]]), kinds


def read_alike(text, start, a, b, fresh, failed, own) -> bool:
    """Whether fresh in the place of text[a:b] is found there, and nothing where nothing was."""
    low = max(0, min([start, *failed]) - 1)
    new = text[low:a] + fresh + text[b : b + 400]
    for t in failed:
        m = FINDS.match(new, t - low)
        if m and chosen(new, m, own):
            return False
    m = FINDS.match(new, start - low)
    found = m and chosen(new, m, own)
    return bool(found) and found[1:3] == (a - low, a - low + len(fresh))


def pseudonymise(
    df: DataFrame,
    key: bytes = DEMO_KEY,
    text_col: str = "text",
    found_col: str | None = "pii_found",
    back: bool = False,
) -> DataFrame:
    """df with text_col pseudonymised; found_col, unless None, maps kinds to finds.

    back=True turns pseudonyms under the same key into the values they stand for.
    A clashing column named found_col is replaced.
    """
    kept = [c for c in df.columns if found_col is None or c.lower() != found_col.lower()]

    def run(batches):
        own = cipher(key, back)
        for batch in text_slices(batches, text_col):
            fresh = [
                (None, {}) if x is None else pseudonymised(x, own)
                for x in (v.as_py() for v in batch.column(text_col))
            ]
            columns = [
                pa.array([t for t, _ in fresh], pa.string())
                if c == text_col
                else batch.column(batch.schema.get_field_index(c))
                for c in kept
            ]
            names = list(kept)
            if found_col is not None:
                counts = [sorted(k.items()) for _, k in fresh]
                found = pa.array(counts, pa.map_(pa.string(), pa.int32()))
                columns, names = [*columns, found], [*names, found_col]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    fields = [df.schema[c] for c in kept]
    if found_col is not None:
        fields.append(T.StructField(found_col, T.MapType(T.StringType(), T.IntegerType())))
    return df.mapInArrow(run, T.StructType(fields))
