"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations.

Found values are validated first (card numbers by their check digit, account numbers by theirs,
addresses by their parts, dates by the calendar, phone numbers by prefix and length), then permuted
within their format: the digits, letters or the day number of a value go through an alternating
Feistel network whose round function is a keyed hash. Separators, letter case, length and check
digits stay. A value has one pseudonym, whatever stands beside it: the same value gets the same
one in every document and in every notation. What is ambiguous is settled in the reading, by the
order of ``PHASES``; who holds the key inverts the values at the places that were reported.
Values that do not validate are left alone.
"""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.arrow import map_batches, texts_of

ROUNDS = 10
DEMONSTRATION_KEY = "runlens demonstration key"
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
REPORT = "array<struct<kind:string,start:long,end:long>>"

MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
_MONTH = "|".join([*MONTHS, *(m[:3] for m in MONTHS if len(m) > 3)])
#: Patterns by kind (fixed values). Dates of one notation are one kind, so that a kind says how a value is written.
PATTERNS = {
    "email": r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9])?@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}",
    "secret": r"(?i:token|secret|password|api[_-]?key)\s*[=:]\s*[\"']?[0-9A-Fa-f]{32,}(?![0-9A-Za-z])",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "ipv6": r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){1,7}(?::?[0-9A-Fa-f]{1,4}|:)(?::[0-9A-Fa-f]{1,4}){0,6}(?![\w:]|\.\d)",
    "iso_date": r"(?<![\w.-])\d{4}-\d{2}-\d{2}(?!(?![Tt]\d{2}(?!\d))[\w-])",
    "year_date": r"(?<![\w./-])\d{4}(?:/\d{1,2}/|\.\d{1,2}\.)\d{1,2}(?![\w/]|\.\d|-\d)",
    "day_date": r"(?<![\w./-])\d{1,2}(?:/\d{1,2}/|\.\d{1,2}\.|-\d{1,2}-)\d{4}(?![\w/]|\.\d|-\d)",
    "day_name_date": rf"(?<![\w.-])\d{{1,2}}\.? (?:{_MONTH}),? \d{{4}}(?!\w)",
    "name_day_date": rf"(?<!\w)(?:{_MONTH}) \d{{1,2}},? \d{{4}}(?!\w)",
    "ip": r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)",
    "phone": r"(?<![\w+])(?:\+|00(?=[1-9]\d{0,2}[ .(-]))\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)",
    "national": r"(?<![\w+.-])(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}(?![\w-])|(?<![\w+.-])(?<!\d )[2-9]\d{2} [2-9]\d{2} \d{4}(?![\w-]| \d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
}
#: Which kinds are looked for one after the other; what a phase has found is closed to the later ones.
#: Between them stand card numbers in their usual groupings, after them those in any other.
PHASES = (("email", "secret", "iban", "ipv6", "iso_date", "year_date", "day_date", "day_name_date", "name_day_date", "ip"),
          ("phone", "national", "ssn"))
#: Digits in groups with one blank or hyphen between them.
_GROUPS = re.compile(r"(?<![\w.])\d+(?:[ -]\d+)*(?![\w]|\.\d)", re.ASCII)
#: Usual sizes of the groups of a card number (fixed values); an ungrouped number has 13 to 19 digits.
CARD_SHAPES = ((4, 4, 4, 4), (4, 6, 5), (4, 6, 4), *((n,) for n in range(13, 20)))
#: First digits of card numbers that are issued (fixed values); they decide between overlapping readings.
_ISSUED_CARD = re.compile(r"4|5[1-5]|222[1-9]|22[3-9]|2[3-6]|27[01]|2720|3[47]|30[0-5]|3[689]|35|6011|64[4-9]|65|62", re.ASCII)
#: National digits by country code, fewest and most (fixed values); elsewhere at most 15 digits in all.
PLANS = {
    "1": (10, 10), "7": (10, 10), "27": (9, 9), "30": (10, 10), "31": (9, 9), "32": (8, 9), "33": (9, 9), "34": (9, 9), "41": (9, 9),
    "44": (9, 10), "45": (8, 8), "46": (7, 9), "47": (8, 8), "48": (9, 9), "52": (10, 10), "55": (10, 11), "61": (9, 9),
    "81": (9, 10), "82": (8, 10), "86": (10, 11), "90": (10, 10), "91": (10, 10), "351": (9, 9), "420": (9, 9),
}
#: What every value contains; a text without any of it is not searched.
_HINT = re.compile(r"\d|@|::", re.ASCII)
#: Stands for what an earlier phase has found; no part of any value or word.
_TAKEN = "\x00"


class Permuter:
    """Keyed bijections of numbers and of mixed-radix digit strings."""

    def __init__(self, key: str, inverse: bool = False) -> None:
        self.key, self.inverse = hashlib.sha256(key.encode()).digest(), inverse

    def _mix(self, tweak: str, number: int, value: int, modulus: int) -> int:
        message = f"{tweak}|{number}|{value}".encode()
        return int.from_bytes(hashlib.blake2b(message, key=self.key, digest_size=32).digest(), "big") % modulus

    def pair(self, left: int, right: int, low: int, high: int, tweak: str) -> tuple[int, int]:
        """Alternating Feistel on (left below ``low``, right below ``high``)."""
        sign = -1 if self.inverse else 1
        for number in (reversed(range(ROUNDS)) if self.inverse else range(ROUNDS)):
            if number % 2:
                right = (right + sign * self._mix(tweak, number, left, high)) % high
            else:
                left = (left + sign * self._mix(tweak, number, right, low)) % low
        return left, right

    def digits(self, values: Sequence[int], radices: Sequence[int], tweak: str) -> list[int]:
        """A string of digits of the given radices."""
        half = len(values) // 2
        parts, sizes = [], []
        for span in (slice(0, half), slice(half, None)):
            total, size = 0, 1
            for v, r in zip(values[span], radices[span]):
                total, size = total * r + v, size * r
            parts.append(total)
            sizes.append(size)
        parts = self.pair(*parts, *sizes, f"{tweak}|{'.'.join(map(str, radices))}")
        out = []
        for total, span in zip(parts, (slice(0, half), slice(half, None))):
            digits = []
            for r in reversed(radices[span]):
                total, d = divmod(total, r)
                digits.append(d)
            out += reversed(digits)
        return out

    def number(self, value: int, size: int, tweak: str) -> int:
        """A number below ``size``: walks the permutation of the next square until it is back in range."""
        side = 1
        while side * side < size:
            side += 1
        while True:
            left, right = self.pair(*divmod(value, side), side, side, f"{tweak}|{size}")
            value = left * side + right
            if value < size:
                return value


def luhn(digits: Sequence[int]) -> int:
    """The check digit that belongs behind ``digits``."""
    total = sum(d if i % 2 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits)))
    return -total % 10


def _replace_digits(text: str, new: Sequence[int]) -> str:
    left = iter(new)
    return "".join(str(next(left)) if c.isdigit() else c for c in text)


def _digits(text: str) -> list[int]:
    return [int(c) for c in text if c.isdigit()]


def _letters(text: str, permuter: Permuter, tweak: str) -> str:
    """Letters and digits of ``text`` permuted, each within its own alphabet."""
    kinds = [(10, 48) if c.isdigit() else (26, 65) if c.isupper() else (26, 97) if c.isalpha() else None for c in text]
    used = [(c, k) for c, k in zip(text, kinds) if k]
    new = iter(permuter.digits([ord(c) - k[1] for c, k in used], [k[0] for _, k in used], tweak))
    return "".join(chr(next(new) + k[1]) if k else c for c, k in zip(text, kinds))


def _email(value: str, p: Permuter) -> str:
    name, _, rest = value.rpartition("@")
    host, dot, top = rest.rpartition(".")
    return f"{_letters(name, p, 'email')}@{_letters(host, p, 'host')}{dot}{top}"


def _secret(value: str, p: Permuter) -> str:
    head, body = re.fullmatch(r"(.*?)([0-9A-Fa-f]+)", value, re.DOTALL).groups()
    new = p.digits([int(c, 16) for c in body], [16] * len(body), "secret")
    upper = any(c in "ABCDEF" for c in body)
    return head + "".join(format(d, "X" if upper else "x") for d in new)


def _permuted_day(day: datetime.date, p: Permuter) -> datetime.date | None:
    number = day.toordinal()
    if not FIRST_DAY <= number <= LAST_DAY:
        return None
    return datetime.date.fromordinal(FIRST_DAY + p.number(number - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, "date"))


def _calendar(year: str, month: str, day: str) -> datetime.date | None:
    try:
        return datetime.date(int(year), int(month), int(day))
    except ValueError:
        return None


def _number_date(value: str, p: Permuter, order: str, padded: bool) -> str | None:
    """A date in numbers; ``order`` of year (Y), month (m) and day (d); ``padded`` to two digits, or never."""
    parts, marks = re.split(r"[./-]", value), re.findall(r"[./-]", value)
    of = dict(zip(order, parts))
    if not p.inverse and (min(map(len, parts)) < 2 if padded else min(map(len, parts)) > 1 or any(x[0] == "0" for x in parts)):
        return None
    if order == "mdY" and marks[0] != "/":
        return None
    day = _calendar(of["Y"], of["m"], of["d"])
    new = _permuted_day(day, p) if day else None
    if new is None:
        return None
    width = 2 if padded else 1
    text = {"Y": f"{new.year:04d}", "m": f"{new.month:0{width}d}", "d": f"{new.day:0{width}d}"}
    return text[order[0]] + marks[0] + text[order[1]] + marks[1] + text[order[2]]


def _named_date(value: str, p: Permuter, short: bool, padded: bool) -> str | None:
    """A date with the English name of its month; ``short``: three letters of it (May counts as a full name)."""
    parts = re.split(r"([A-Za-z]+|\d+)", value)
    name = next(x for x in parts if x.isalpha())
    day, year = (x for x in parts if x.isdigit())
    if not p.inverse and (short == (name in MONTHS) or padded != (day[0] == "0")):
        return None
    month = next(i for i, m in enumerate(MONTHS, 1) if m.startswith(name))
    old = _calendar(year, str(month), day)
    new = _permuted_day(old, p) if old else None
    if new is None:
        return None
    numbers = iter([f"{new.day:0{2 if padded else 1}d}", f"{new.year:04d}"])
    full = MONTHS[new.month - 1]
    return "".join(next(numbers) if x.isdigit() else (full[:3] if short else full) if x.isalpha() else x for x in parts)


def _ipv6(value: str, p: Permuter, form: str, upper: bool) -> str | None:
    """An address of eight groups: ``full`` without leading zeros, ``padded`` to four digits, or ``short`` by ``::``.

    A shortened address has a pseudonym of eight groups.
    """
    try:
        address = ipaddress.IPv6Address(value)
    except ValueError:
        return None
    written = {"short": str(address), "padded": address.exploded, "full": ":".join(f"{g:x}" for g in _groups(address))}
    if not p.inverse and (written[form] != value.lower() or value != (value.upper() if upper else value.lower())
                          or (form == "short") != ("::" in value) or (form == "full" and written["padded"] == value.lower())):
        return None
    new = ipaddress.IPv6Address(sum(g << (16 * (7 - i)) for i, g in enumerate(p.digits(_groups(address), [65536] * 8, "ipv6"))))
    text = str(new) if form == "short" and p.inverse else new.exploded if form == "padded" else ":".join(f"{g:x}" for g in _groups(new))
    return text.upper() if upper else text


def _groups(address: ipaddress.IPv6Address) -> list[int]:
    return [(int(address) >> (16 * k)) & 65535 for k in reversed(range(8))]


def _ip(value: str, p: Permuter) -> str | None:
    octets = value.split(".")
    if any(int(o) > 255 or (len(o) > 1 and o[0] == "0") for o in octets):
        return None
    return ".".join(map(str, p.digits([int(o) for o in octets], [256] * 4, "ip")))


def _country(value: str) -> int:
    """Length of the prefix (a plus sign or two zeros) and the country code of a phone number."""
    head = re.match(r"(?:\+|00)\d{1,3}(?=[ .(-])", value)
    return len(head.group()) if head else 2


def _phone(value: str, p: Permuter) -> str | None:
    """Country code stays, the national number is permuted; at least 7 and at most 15 digits in all."""
    keep = _country(value)
    digits = _digits(value[keep:])
    if not p.inverse and not 7 <= len(digits) + len(_digits(value[:keep].removeprefix("00"))) <= 15:
        return None
    return value[:keep] + _replace_digits(value[keep:], p.digits(digits, [10] * len(digits), "phone"))


def _national(value: str, p: Permuter) -> str:
    digits = _digits(value)
    return _replace_digits(value, p.digits(digits, [10] * len(digits), "phone"))


def _issued(digits: Sequence[int]) -> bool:
    """Whether a social security number of these digits can exist."""
    area, group, serial = (int("".join(map(str, digits[a:b]))) for a, b in ((0, 3), (3, 5), (5, 9)))
    return area not in (0, 666) and area < 900 and group > 0 and serial > 0


def _ssn(value: str, p: Permuter) -> str | None:
    digits = _digits(value)
    if not _issued(digits):
        return None
    while not _issued(digits := p.digits(digits, [10] * 9, "ssn")):
        pass  # walks the permutation on to the next number that can exist
    return _replace_digits(value, digits)


def _iban(value: str, p: Permuter) -> str | None:
    plain = value.replace(" ", "")
    if not 15 <= len(plain) <= 34 or int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 != 1:
        return None
    body = _letters(plain[4:], p, "iban")
    left = iter(plain[:2] + f"{98 - int(''.join(str(int(c, 36)) for c in body + plain[:2] + '00')) % 97:02d}" + body)
    return "".join(c if c == " " else next(left) for c in value)


def _card(value: str, p: Permuter) -> str | None:
    digits = _digits(value)
    if not p.inverse and (luhn(digits[:-1]) != digits[-1] or len(set(digits)) == 1):
        return None
    new = p.digits(digits[:-1], [10] * (len(digits) - 1), "card")
    return _replace_digits(value, [*new, luhn(new)])


def _rules() -> tuple[dict[str, Callable[[str, Permuter], str | None]], dict[str, tuple[str, ...]]]:
    """Rules by kind, and the kinds that a pattern's match may be, in the order of trial."""
    rules: dict[str, Callable] = {"email": _email, "secret": _secret, "ip": _ip, "phone": _phone, "national": _national,
                                  "ssn": _ssn, "iban": _iban, "card": _card}
    kinds = {name: (name,) for name in rules}

    def add(pattern: str, kind: str, rule: Callable, **how) -> None:
        rules[kind] = lambda v, p: rule(v, p, **how)
        kinds[pattern] = (*kinds.get(pattern, ()), kind)

    add("iso_date", "iso_date", _number_date, order="Ymd", padded=True)
    for name, order, pattern in (("year_date", "Ymd", "year_date"), ("day_date", "dmY", "day_date"), ("month_date", "mdY", "day_date")):
        add(pattern, name, _number_date, order=order, padded=True)
        add(pattern, f"{name}_short", _number_date, order=order, padded=False)
    for pattern in ("day_name_date", "name_day_date"):
        for short in (False, True):
            for padded in (False, True):
                add(pattern, pattern + "_short" * short + "_padded" * padded, _named_date, short=short, padded=padded)
    for form in ("full", "padded", "short"):
        for upper in (False, True):
            add("ipv6", f"ipv6_{form}" + "_upper" * upper, _ipv6, form=form, upper=upper)
    return rules, kinds


_RULES, _KINDS = _rules()


@lru_cache(maxsize=4)
def _permuter(key: str, inverse: bool) -> Permuter:
    return Permuter(key, inverse)


@lru_cache(maxsize=None)
def _finder(names: tuple[str, ...]) -> re.Pattern:
    return re.compile("|".join(f"(?P<{name}>{PATTERNS[name]})" for name in names), re.ASCII)


def _possible(names: Sequence[str], text: str) -> tuple[str, ...]:
    """The patterns that can match at all, by the marks they need."""
    needs = {"email": "@", "ipv6": ":", "ip": ".", "secret": None, "day_name_date": " ", "name_day_date": " "}
    return tuple(n for n in names if needs.get(n) is None or needs[n] in text)


def _phone_prefix(value: str) -> str:
    """A phone number ends with the longest prefix, before a separator, that its country's plan allows."""
    keep = _country(value)
    low, high = PLANS.get(value[:keep].lstrip("+0"), (0, 0))
    ends = [m.start() for m in re.finditer(r"(?<=\d)[ .-]", value) if m.start() > keep] + [len(value)]
    fit = [e for e in ends if low <= len(_digits(value[keep:e])) <= high]
    return value[:fit[-1]] if fit else value


Claim = tuple[str, int, int, str]


def _matches(work: str, names: Sequence[str], p: Permuter) -> Iterator[Claim]:
    """Values by pattern, from left to right; what fails one pattern may pass a later one at the same place."""
    possible = _possible(names, work)
    if not possible:
        return
    finder, at = _finder(possible), 0
    while match := finder.search(work, at):
        start, hit = match.start(), None
        for name in possible[possible.index(match.lastgroup):]:
            found = match if name == match.lastgroup else _finder((name,)).match(work, start)
            if not found:
                continue
            value = _phone_prefix(found.group(name)) if name == "phone" else found.group(name)
            hit = next(((kind, start, start + len(value), new) for kind in _KINDS[name] if (new := _RULES[kind](value, p)) is not None), None)
            if hit:
                yield hit
                break
        at = hit[2] if hit else start + 1


def _cards(work: str, p: Permuter, usual: bool) -> Iterator[Claim]:
    """Card numbers in stretches of digit groups.

    ``usual``: consecutive groups of the usual sizes with one kind of separator; where readings
    overlap, one whose first digits are issued goes first, then the one further left. Otherwise a
    whole stretch, then consecutive groups of three digits or more, the longest reading first.
    """
    for stretch in _GROUPS.finditer(work):
        text, begin = stretch.group(), stretch.start()
        if len(text) < 13:
            continue
        groups = [(m.start(), m.end()) for m in re.finditer(r"\d+", text)]
        sizes, readings = [b - a for a, b in groups], []

        def read(first: int, last: int) -> None:
            value = text[groups[first][0]:groups[last][1]]
            if (new := _card(value, p)) is not None:
                rank = (not _ISSUED_CARD.match(value.replace(" ", "").replace("-", "")), first) if usual else (first, -last)
                readings.append((rank, first, last, new))

        if usual:
            for first in range(len(groups)):
                for shape in CARD_SHAPES:
                    last = first + len(shape) - 1
                    if tuple(sizes[first:last + 1]) == shape and len({text[b] for _, b in groups[first:last]}) < 2:
                        read(first, last)
        else:
            if 13 <= sum(sizes) <= 19:
                read(0, len(groups) - 1)
            for first in range(len(groups)) if not readings else ():
                last, total = first, 0
                while last < len(groups) and sizes[last] >= 3 and (total := total + sizes[last]) <= 19:
                    if total >= 13:
                        read(first, last)
                    last += 1
        used: set[int] = set()
        for _, first, last, new in sorted(readings):
            if used.isdisjoint(range(first, last + 1)):
                used.update(range(first, last + 1))
                yield "card", begin + groups[first][0], begin + groups[last][1], new


def _values(text: str, p: Permuter) -> list[Claim]:
    """All values of a text with their pseudonyms, in order; each place belongs to one value at most."""
    found: list[Claim] = []
    for search in (lambda w: _matches(w, PHASES[0], p), lambda w: _cards(w, p, usual=True),
                   lambda w: _matches(w, PHASES[1], p), lambda w: _cards(w, p, usual=False)):
        new = sorted(search(text), key=lambda claim: claim[1])
        pieces, last = [], 0
        for _, start, end, _ in new:
            pieces += [text[last:start], _TAKEN * (end - start)]
            last = end
        text = "".join([*pieces, text[last:]]) if new else text
        found += new
    return sorted(found, key=lambda claim: claim[1])


def _spliced(text: str, claims: Sequence[Claim]) -> tuple[str, list[tuple[str, int, int]]]:
    out, found, last, shift = [], [], 0, 0
    for kind, start, end, new in claims:
        out += [text[last:start], new]
        found.append((kind, start + shift, start + shift + len(new)))
        shift += len(new) - (end - start)
        last = end
    return "".join([*out, text[last:]]), found


def replaced(text: str, key: str) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, start, end) of each in the new text."""
    if not _HINT.search(text):
        return text, []
    return _spliced(text, _values(text, _permuter(key, False)))


def restored(text: str, found: Sequence[tuple[str, int, int]], key: str) -> str:
    """The text before replacement, from the places that ``replaced`` reported."""
    p = _permuter(key, True)
    return _spliced(text, [(kind, start, end, _RULES[kind](text[start:end], p)) for kind, start, end in found])[0]


def pseudonymise(docs: DataFrame, key: str = DEMONSTRATION_KEY, text: str = "text", report: str | None = None) -> DataFrame:
    """The documents, all columns, with pseudonyms in the text.

    With ``report`` a column of that name is added: array of (kind, start, end), code points in
    the new text, by which ``originals`` undoes the replacement. A null text stays null, an empty
    one empty; null ids and repeated rows are rows like any other; columns of any name are carried
    along; an empty table gives an empty table. Text without validated values comes back unchanged.
    """
    names = docs.columns
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    if report in names:
        raise ValueError(f"a column {report!r} is there already")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = names.index(text)
        raw, done = batch.column(at), [replaced(t, key) for t in texts_of(batch, text)]
        new = pa.array([d[0] if old.is_valid else None for d, old in zip(done, raw)], pa.string())
        columns = [new if i == at else batch.column(i) for i in range(len(names))]
        heads = list(batch.schema.names)
        if report:
            columns.append(pa.array([[dict(zip(("kind", "start", "end"), f)) for f in d[1]] for d in done], kind))
            heads.append(report)
        return pa.RecordBatch.from_arrays(columns, heads)

    fields = [f"`{n}` {t}" for n, t in docs.dtypes] + ([f"`{report}` {REPORT}"] if report else [])
    return map_batches(docs.select(*[F.col(f"`{n}`") for n in names]), run, ", ".join(fields))


def originals(docs: DataFrame, report: str, key: str = DEMONSTRATION_KEY, text: str = "text") -> DataFrame:
    """The documents as they were before ``pseudonymise`` with the same key, without the ``report`` column.

    Nothing is looked for: the values are those at the reported places. A null text stays null, a
    null report means no values.
    """
    names = [n for n in docs.columns if n != report]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, places = names.index(text), batch.column(len(names)).to_pylist()
        old = [t and restored(t, [(f["kind"], f["start"], f["end"]) for f in found or []], key)
               for t, found in zip(batch.column(at).to_pylist(), places)]
        columns = [pa.array(old, pa.string()) if i == at else batch.column(i) for i in range(len(names))]
        return pa.RecordBatch.from_arrays(columns, names)

    fields = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes if n != report)
    return map_batches(docs.select(*[F.col(f"`{n}`") for n in [*names, report]]), run, fields)
