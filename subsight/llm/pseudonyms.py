"""Format-preserving pseudonyms for personal data, by a keyed Feistel permutation.

A value is found by its form, validated, turned into a whole number below the
size of its format, permuted under the key and written back in the same form. So
equal values get equal pseudonyms in all documents, different values different
ones, and a card number still passes its check digit.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

ROUNDS = 8
#: Letters and digits permuted as one number.
BLOCK = 64
FIRST_DAY = datetime.date(1900, 1, 1).toordinal()
DAYS = datetime.date(2100, 1, 1).toordinal() - FIRST_DAY


class Feistel:
    """A keyed permutation of the whole numbers below any size."""

    def __init__(self, key: bytes):
        self.key = key

    def _round(self, kind: str, number: int, half: int, bits: int) -> int:
        size = -(-bits // 8)
        data = f"{kind}:{bits}:{number}:{half}".encode()
        block = hashlib.blake2b(data, key=self.key, digest_size=min(64, max(8, size + 4))).digest()
        while len(block) < size:
            block += hashlib.blake2b(block, key=self.key).digest()
        return int.from_bytes(block, "big") & ((1 << bits) - 1)

    def permute(self, kind: str, value: int, size: int, undo: bool = False) -> int:
        """The image of ``value`` below ``size``; values out of range are walked back into it."""
        bits = max(1, -(-(size - 1).bit_length() // 2))
        mask, numbers = (1 << bits) - 1, range(ROUNDS)
        tweak = f"{kind}/{size}"
        while True:
            left, right = value >> bits, value & mask
            if undo:
                for n in reversed(numbers):
                    left, right = right ^ self._round(tweak, n, left, bits), left
            else:
                for n in numbers:
                    left, right = right, left ^ self._round(tweak, n, right, bits)
            value = left << bits | right
            if value < size:
                return value


def luhn_digit(digits: str) -> str:
    """The check digit that completes ``digits``."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 == 0 else 1)
        total += n - 9 if n > 9 else n
    return str(-total % 10)


def _refill(shape: str, digits: str) -> str:
    """``digits`` in the places where ``shape`` has digits."""
    rest = iter(digits)
    return "".join(next(rest) if c in "0123456789" else c for c in shape)


def _digits(text: str) -> str:
    return re.sub(r"\D", "", text, flags=re.ASCII)


def _card(f: Feistel, text: str) -> str | None:
    digits = _digits(text)
    if not 13 <= len(digits) <= 19 or digits[0] == "0" or luhn_digit(digits[:-1]) != digits[-1]:
        return None
    size = 10 ** (len(digits) - 2)
    body = digits[0] + str(f.permute("card", int(digits[1:-1]), size)).zfill(len(digits) - 2)
    return _refill(text, body + luhn_digit(body))


def _phone(f: Feistel, text: str) -> str | None:
    digits = _digits(text)
    if text.startswith("+") and not digits.startswith("1"):
        if not 8 <= len(digits) <= 15:
            return None
        size = 10 ** (len(digits) - 2)
        return _refill(text, digits[:2] + str(f.permute("phone", int(digits[2:]), size)).zfill(len(digits) - 2))
    lead, local = digits[:-10], digits[-10:]
    if lead not in ("", "1") or len(local) != 10 or local[0] in "01" or local[3] in "01":
        return None
    area, exchange, line = int(local[:3]) - 200, int(local[3:6]) - 200, int(local[6:])
    value = f.permute("nanp", (area * 800 + exchange) * 10_000 + line, 800 * 800 * 10_000)
    rest, line = divmod(value, 10_000)
    area, exchange = divmod(rest, 800)
    return _refill(text, f"{lead}{area + 200}{exchange + 200}{line:04d}")


def _ssn(f: Feistel, text: str) -> str | None:
    area, group, serial = (int(p) for p in text.split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    place = area - 1 - (area > 666)
    value = f.permute("ssn", (place * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999)
    rest, serial = divmod(value, 9999)
    place, group = divmod(rest, 99)
    area = place + 1 + (place + 1 >= 666)
    return f"{area:03d}-{group + 1:02d}-{serial + 1:04d}"


def _ip(f: Feistel, text: str) -> str | None:
    parts = [int(p) for p in text.split(".")]
    if max(parts) > 255 or not 1 <= parts[0] <= 223 or any(len(p) > 1 and p[0] == "0" for p in text.split(".")):
        return None
    value = int.from_bytes(bytes([parts[0] - 1, *parts[1:]]), "big")
    image = f.permute("ip", value, 223 << 24).to_bytes(4, "big")
    return ".".join(map(str, (image[0] + 1, *image[1:])))


def _mixed(f: Feistel, kind: str, text: str) -> str:
    """Permute letters and digits, each within its class; other characters stay.

    A long text is permuted in blocks, so that no number grows with it.
    """
    classes = {"0": 10, "a": 26, "A": 26}
    places = [(i, "0" if c in "0123456789" else "a" if "a" <= c <= "z" else "A") for i, c in enumerate(text) if c.isascii() and c.isalnum()]
    out = list(text)
    for at in range(0, len(places), BLOCK):
        block = places[at : at + BLOCK]
        value, size = 0, 1
        for i, k in block:
            value, size = value * classes[k] + ord(text[i]) - ord(k), size * classes[k]
        number = str(at // BLOCK) if at else ""
        value = f.permute(kind + number + "".join(k for _, k in block), value, size)
        for i, k in reversed(block):
            value, rest = divmod(value, classes[k])
            out[i] = chr(ord(k) + rest)
    return "".join(out)


def _email(f: Feistel, text: str) -> str:
    local, at, domain = text.rpartition("@")
    return _mixed(f, "email", local) + at + domain


def _iban_check(country: str, body: str) -> int:
    number = "".join(str(int(c, 36)) for c in body + country + "00")
    return 98 - int(number) % 97


def _iban(f: Feistel, text: str) -> str | None:
    bare = text.replace(" ", "")
    if not 15 <= len(bare) <= 34 or int(bare[2:4]) != _iban_check(bare[:2], bare[4:]):
        return None
    body = _mixed(f, "iban" + bare[:2], bare[4:])
    rest = iter(f"{bare[:2]}{_iban_check(bare[:2], body):02d}{body}")
    return "".join(c if c == " " else next(rest) for c in text)


def _date(f: Feistel, text: str) -> str | None:
    a, gap, b, _, c = re.split(r"([-/.])", text)
    if len(a) == 4:
        orders = ((0, 1, 2),)
    elif gap == ".":
        orders = ((2, 1, 0),)
    else:
        orders = ((2, 1, 0), (2, 0, 1))  # day first if that is a date, else month first
    parts = (a, b, c)
    for order in orders:
        try:
            day = datetime.date(*(int(parts[i]) for i in order)).toordinal() - FIRST_DAY
        except ValueError:
            continue
        if 0 <= day < DAYS:
            image = datetime.date.fromordinal(f.permute("date", day, DAYS) + FIRST_DAY)
            made = {i: str(n) for i, n in zip(order, (image.year, image.month, image.day))}
            padded = a[0] == "0" or b[0] == "0" or len(a) == 4 or len(a + b) == 4
            return gap.join(made[i].zfill(2 if padded else 1) for i in range(3))
    return None


# Forms, the stricter first; each match is validated by its function.
_KINDS: tuple[tuple[str, str, Callable[[Feistel, str], str | None]], ...] = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", _email),
    ("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30}\b", _iban),
    ("date", r"(?<![\d/.-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}([/.-])\d{1,2}\1\d{4})(?![\d/-])", _date),
    ("ip", r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)", _ip),
    ("ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", _ssn),
    ("card", r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w]|[.-]\d)", _card),
    (
        "phone",
        r"(?<![\w.+-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]\d{2,8}){1,4}(?![\w]|[.-]\d)"
        r"|(?<![\w.+-])\+\d{8,15}(?!\w)",
        _phone,
    ),
)
_FORMS = [(kind, re.compile(form, re.ASCII), make) for kind, form, make in _KINDS]
_ANY = re.compile(r"[0-9@]")
#: Kinds written in groups, and what stands between groups.
GROUPED = ("iban", "card")
_GAP = re.compile(r"[ -]")
KINDS = tuple(kind for kind, _, _ in _KINDS)


def _shorter(kind: str, value: str) -> Iterator[str]:
    """The value itself, then without its last groups: a form may have run into the text behind it."""
    yield value
    if kind in GROUPED:
        for gap in reversed([m.start() for m in _GAP.finditer(value)]):
            yield value[:gap]


def pseudonymise(text: str | None, feistel: Feistel) -> tuple[str | None, dict[str, int]]:
    """The text with pseudonyms, and how many values of each kind it held.

    Kinds are taken in the order of ``KINDS``; what one kind has replaced no
    later kind touches. Of a run of groups the longest beginning that is valid
    is taken, so that a number may stand before another or before capitals.
    """
    counts = dict.fromkeys(KINDS, 0)
    if not text or not _ANY.search(text):
        return text, counts
    pieces: list[tuple[str, bool]] = [(text, False)]
    for kind, form, make in _FORMS:
        split: list[tuple[str, bool]] = []
        for piece, done in pieces:
            kept = at = 0
            while not done and (found := form.search(piece, at)):
                at = found.end()
                for value in _shorter(kind, found[0]):
                    # What is left of the form after a cut must have the form's own size.
                    if value != found[0] and not form.fullmatch(value):
                        continue
                    image = make(feistel, value)
                    if image is not None:
                        split += [(piece[kept : found.start()], False), (image, True)]
                        kept = at = found.start() + len(value)
                        counts[kind] += 1
                        break
            split.append((piece[kept:], done))
        pieces = split
    return "".join(piece for piece, _ in pieces), counts


def replace_personal_data(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """Replace personal data in ``text_col``; add ``found``, a map from kind to count.

    A column named ``found`` is replaced, others stay, whatever their names and types.
    Null texts stay null, empty ones empty; texts and values of any length are done
    whole; rows that repeat come back as often; an empty table gives an empty one. A
    kind that a text does not hold is not in its map. Told are international and North
    American phone numbers, not national ones of other countries, and dates in digits
    only; IPv6 addresses and e-mail names beyond ASCII are not told.
    """

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feistel = Feistel(key)
        for batch in batches:
            made = [pseudonymise(t.as_py(), feistel) for t in batch.column(text_col)]
            place = batch.schema.get_field_index(text_col)
            columns = list(batch.columns)
            columns[place] = pa.array([m[0] for m in made], pa.string())
            found = pa.array([[(k, n) for k, n in m[1].items() if n] for m in made], pa.map_(pa.string(), pa.int32()))
            yield pa.RecordBatch.from_arrays([*columns, found], names=[*batch.schema.names, "found"])

    rows = docs.drop("found")
    found_type = T.MapType(T.StringType(), T.IntegerType())
    return rows.mapInArrow(per_batch, T.StructType([*rows.schema.fields, T.StructField("found", found_type)]))
