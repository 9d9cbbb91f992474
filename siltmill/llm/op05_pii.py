"""PII surrogates.

Detected entities get keyed replacements of their own type and format: numbers, addresses and secrets are enciphered by
a keyed permutation of the strings with their pattern of character classes (so different ones stay different and one
entity is replaced alike in all documents); names get generated names of the same gender and script. A check over the
corpus's different entities finds surrogates that two entities share, or that equal a real entity, and those entities
draw again, in the end from longer patterns, until none is left.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections.abc import Iterator
from datetime import date
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import digest, each_text, stored

#: Titles before a person's name, by the gender they tell (m, f or n for none).
TITLES = {
    "m": ["Mr", "Mister", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Don", "Господин", "Κύριος"],
    "f": ["Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mlle", "Señora", "Señorita", "Sra", "Srta", "Doña", "Госпожа", "Κυρία"],
    "n": ["Dr", "Prof"],
}
#: Words that announce a person's name without a title.
ANNOUNCED = ["my name is", "My name is", "mein Name ist", "Mein Name ist", "je m'appelle", "Je m'appelle", "me llamo", "Me llamo", "Dear", "Contact", "contact", "Signed by", "signed by"]
#: Calling codes of two digits; 1 and 7 have one, the others three.
CODES = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
#: Private and loopback IPv4 ranges, as first address and number of low bits.
PRIVATE = [("10.0.0.0", 24), ("127.0.0.0", 24), ("172.16.0.0", 20), ("192.168.0.0", 16)]
#: Words before a date of birth, and before a telephone number without a calling code.
BORN = ["born", "date of birth", "dob", "geboren am", "geboren", "née le", "né le", "nacido el", "nacida el"]
CALL = ["tel", "phone", "telephone", "call", "fax", "mobile", "telefon", "téléphone", "teléfono"]
#: Syllables and endings of generated names, by script.
SYLLABLES = {
    "latin": "ba be bi bo da de di do fa fe ga go ha jo ka ki la le li lo ma me mi mo na ni no ra ri ro sa ta".split(),
    "cyrillic": "ба ве ви го да де ди до ка ки ла ле ли ло ма ме ми мо на ни но ра ри ро са се та те ти то ва зо".split(),
    "greek": "βα γε δα δε δι δο θα θε κα κι λα λε λι λο μα με μι μο να νι νο ρα ρι ρο σα σε τα τε τι το φα χα".split(),
}
ENDINGS = {
    "latin": {"m": ["rt", "us", "an", "ko"], "f": ["na", "ia", "lle", "ra"], "n": ["r", "n", "l", "m"], "s": ["son", "mann", "eau", "ez"]},
    "cyrillic": {"m": ["н", "р", "в", "л"], "f": ["на", "ья", "ра", "ла"], "n": ["н", "р", "м", "л"], "s": ["ко", "юк", "ич", "ян"]},
    "greek": {"m": ["ος", "ης", "ας", "ων"], "f": ["να", "ια", "λη", "ρω"], "n": ["ν", "ς", "ξ", "ρ"], "s": ["άκης", "ίδης", "άτος", "ούς"]},
}
_TITLE = "|".join(sorted((t for ts in TITLES.values() for t in ts), key=len, reverse=True))
_WORD = r"[^\W\d_a-zß-öø-ÿа-яά-ώ][^\W\d_]+(?:['’-][^\W\d_]+)*(?!\w)"
_NAME = re.compile(rf"({_TITLE})\b(\.?[ \u00a0])({_WORD}(?:[ \u00a0]{_WORD}){{0,3}})").match
_SAID = re.compile(rf"(?<!\w)({'|'.join(ANNOUNCED)})(:?[ \u00a0])({_WORD}[ \u00a0]{_WORD}(?:[ \u00a0]{_WORD})?)")
_NUMERIC = re.compile(r"[\d@]").search
_SECRET_WORD = r"(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth[_-]?key)"
_KEY_STARTS = ("AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-")
_SECRETS = [
    ("secret", re.compile(rf"(?i:\b{_SECRET_WORD})[\"']?\s*[:=]\s*[\"']?([A-Za-z0-9+/_\-]{{8,}})")),
    ("secret", re.compile(r"\b(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9_-]{16,})\b")),
]
#: Each needs a digit or an @, and none spans two lines.
_PATTERNS = [
    ("email", re.compile(r"([\w.%+\-]+@[^\W_][\w\-]*(?:\.[\w\-]+)*\.[^\W\d_]{2,})")),
    ("iban", re.compile(r"\b([A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)\b")),
    ("ip", re.compile(r"(?<![\d.])((?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d))(?![\d]|\.\d)")),
    ("ssn", re.compile(r"(?<![\d-])(\d{3}-\d{2}-\d{4})(?![\d-])")),
    ("phone", re.compile(r"(?<![\w+])(\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{2,4}\)[ .-]?\d{3,4}(?:[ .-]?\d{2,4}){1,2}|\d{3}[.-]\d{3}[.-]\d{4})(?![\w])")),
    ("birth", re.compile(rf"(?i:\b(?:{'|'.join(BORN)}))\b[ :]{{1,3}}(?:on )?(\d{{4}}-\d\d-\d\d|\d\d?[./]\d\d?[./]\d{{4}})(?!\d)")),
    ("phone", re.compile(rf"(?i:\b(?:{'|'.join(CALL)}))\b[.:]{{0,2}} ?(\d{{2,5}}(?:[ -]\d{{2,6}}){{1,4}})(?![\w])")),
    ("card", re.compile(r"(?<![\w-])(\d(?:[ -]?\d){12,18})(?![\w])")),
]


def gender_of(title: str) -> str:
    return next(g for g, ts in TITLES.items() if title in ts)


def script_of(word: str) -> str:
    name = next((unicodedata.name(c, "") for c in word if c.isalpha()), "")
    first = name.split(" ")[0].lower()
    return first if first in SYLLABLES or letters(first) else "latin"


@lru_cache(None)
def letters(script: str) -> str:
    """Small or caseless letters beyond ASCII of a script, named as in Unicode's character names."""
    made = (chr(i) for i in range(0x80, 0x10000))
    return "".join(c for c in made if unicodedata.category(c) in ("Ll", "Lo") and unicodedata.name(c, "").lower().startswith(script + " ") and unicodedata.normalize("NFKC", c).casefold() == c)


def ascii_digits(s: str) -> str:
    return s if s.isascii() else "".join(str(unicodedata.decimal(c)) if c.isdecimal() else c for c in s)


def normal(kind: str, raw: str) -> str:
    """What two mentions of one entity share."""
    if kind == "birth":
        return str(_days(raw))
    if kind in ("phone", "card", "ssn"):
        return "+" * (kind == "phone" and raw[:1] == "+") + ascii_digits("".join(c for c in raw if c.isdecimal()))
    if kind in ("iban", "ip"):
        return ascii_digits(raw.replace(" ", ""))
    return raw if kind == "secret" else raw.lower() if kind == "email" else unicodedata.normalize("NFC", raw).casefold()


def _days(raw: str) -> int | None:
    """Days from the year 1 of a date; day and month swap if only that makes one."""
    a, b, c = map(int, re.split(r"[./-]", raw))
    for y, m, d in [(a, b, c)] if "-" in raw else [(c, b, a), (c, a, b)]:
        try:
            return date(y, m, d).toordinal()
        except ValueError:
            continue
    return None


def _may_name_secret(text: str) -> bool:
    """False only for texts that the first of _SECRETS cannot match; beyond ASCII, more characters fold to its letters."""
    if ":" not in text and "=" not in text:
        return False
    low = text.lower() if text.isascii() else ""
    return not low or any(w in low for w in ("token", "secret", "passw", "pwd", "key"))


def detect(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), sorted and apart. Kinds: secret, email, iban, ip, ssn, phone, birth, card (numbers with a right
    check digit), and the parts of names: given-m, given-f, given-n, surname. A name that a title or another word
    announces is found in the rest of its text, too, also in capitals."""
    out: list[tuple[int, int, str]] = []
    titles = [t for ts in TITLES.values() for t in ts if t in text]
    said = any(w in text for w in ANNOUNCED)
    numeric = _NUMERIC(text)
    secrets = [p for p, wanted in zip(_SECRETS, (_may_name_secret(text), any(k in text for k in _KEY_STARTS))) if wanted]
    if not numeric and not titles and not secrets and not said:
        return out
    taken = bytearray(len(text))

    def add(a: int, z: int, kind: str) -> None:
        if not any(taken[a:z]):
            taken[a:z] = b"\1" * (z - a)
            out.append((a, z, kind))

    for kind, pattern in secrets:  # over line ends, too
        for m in pattern.finditer(text):
            if any(c.isalnum() for c in m[1]):  # a row of signs is a blank to fill in
                add(m.start(1), m.end(1), kind)
    at = text.rfind("\n", 0, numeric.start()) + 1 if numeric else len(text)
    for line in text[at:].split("\n"):  # a search by character class, then patterns on the few lines that it finds
        if _NUMERIC(line):
            for kind, pattern in _PATTERNS:
                if kind != "email" or "@" in line:
                    for m in pattern.finditer(line):
                        if (kind != "card" or luhn(normal(kind, m[1]))) and (kind != "birth" or _days(m[1]) is not None):
                            add(at + m.start(1), at + m.end(1), kind)
        at += len(line) + 1
    known: dict[str, str] = {}
    for title in titles:
        at = text.find(title)
        while at >= 0:
            if (at == 0 or not (text[at - 1].isalnum() or text[at - 1] == "_")) and (m := _NAME(text, at)):
                parts = list(re.finditer(_WORD, m[3]))
                for i, w in enumerate(parts):
                    known.setdefault(w[0], "surname" if i == len(parts) - 1 else f"given-{gender_of(m[1])}")
            at = text.find(title, at + 1)
    for m in _SAID.finditer(text) if said else ():
        parts = m[3].split(m[3][len(re.match(_WORD, m[3])[0])])
        for i, w in enumerate(parts):
            known.setdefault(w, "surname" if i == len(parts) - 1 else "given-n")
    if known:
        known |= {w.upper(): kind for w, kind in known.items() if len(w) > 2 and w.upper() not in known}
        for m in re.finditer(r"\b(?:" + "|".join(map(re.escape, sorted(known, key=len, reverse=True))) + r")\b", text):
            add(m.start(), m.end(), known[m[0]])
    return sorted(out)


def _number(key: bytes, *parts: str) -> int:
    return int.from_bytes(hmac.new(key, "\0".join(parts).encode("utf-8", "replace"), hashlib.sha256).digest(), "big")


def _permute(key: bytes, tweak: str, x: int, size: int) -> int:
    """A keyed permutation of 0 to size-1: a Feistel network over enough bits, walked until it lands inside."""
    if size < 2:
        return 0
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        a, b = x >> half, x & mask
        for r in range(8):
            a, b = b, a ^ (_number(key, tweak, str(r), str(half), str(b)) & mask)
        x = a << half | b
        if x < size:
            return x


_SETS = {"d": "0123456789", "h": "0123456789abcdef", "H": "0123456789ABCDEF", "a": "abcdefghijklmnopqrstuvwxyz", "A": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "г": "абвгдежзиклмнопрстуфхцчшщэюя", "γ": "αβγδεζηθικλμνξοπρστυφχψω"}


@lru_cache(100_000)
def class_of(c: str) -> str | None:
    """The class of a character: one of _SETS, or the digits or letters of another script."""
    if found := next((k for k in ("d", "a", "A", "г", "γ") if c in _SETS[k]), None):
        return found
    if c.isdecimal():
        return "0" + chr(ord(c) - unicodedata.decimal(c))
    script = unicodedata.name(c, "").split(" ")[0].lower()
    return script if c.isalpha() and c in class_members(script) else None


@lru_cache(None)
def class_members(cls: str) -> str:
    if cls in _SETS:
        return _SETS[cls]
    if cls[0] == "0":
        return "".join(chr(ord(cls[1]) + i) for i in range(10))
    return "".join(c for c in letters(cls) if c not in _SETS["г"] and c not in _SETS["γ"])


def encipher(key: bytes, tweak: str, s: str, fixed: int = 0, hexa: bool = False) -> str:
    """Another string with the same pattern of character classes; characters of no class, and the first `fixed`, stay."""
    plan = []
    for i, c in enumerate(s):
        plan.append(None if i < fixed else "h" if hexa and c in _SETS["h"] else class_of(c))
    x, size = 0, 1
    for c, cls in zip(s, plan):
        if cls:
            x = x * len(class_members(cls)) + class_members(cls).index(c)
            size *= len(class_members(cls))
    x = _permute(key, tweak + "".join(k or c for k, c in zip(plan, s)), x, size)
    out = []
    for c, cls in zip(reversed(s), reversed(plan)):
        if cls:
            x, r = divmod(x, len(class_members(cls)))
            c = class_members(cls)[r]
        out.append(c)
    return "".join(reversed(out))


#: The first attempt that leaves a string's own pattern.
WIDEN = 3


def luhn(digits: str) -> bool:
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def calling_code(digits: str) -> int:
    """Digits of the calling code that an international number starts with."""
    return 1 if digits[0] in "17" else 2 if digits[:2] in CODES else 3


def _address(ip: str) -> int:
    return int.from_bytes(bytes(map(int, ip.split("."))), "big")


def _iban(country: str, rest: str) -> str:
    n = int("".join(str(int(c, 36)) for c in rest + country + "00"))
    return f"{country}{98 - n % 97:02d}{rest}"


def generated(key: bytes, tweak: str, alphabet: str, length: int) -> str:
    return "".join(alphabet[_number(key, tweak, str(i)) % len(alphabet)] for i in range(length))


@lru_cache(20_000)
def surrogate(key: bytes, kind: str, norm: str, attempt: int = 0) -> str:
    """The replacement of a normal form, itself in normal form (names: lower case). attempt: 1 and up draw again.

    From WIDEN on, a draw leaves the pattern, which may be too small or too full, for one that is longer by two
    characters an attempt (of an IPv4 address: for an IPv6 address), so redraws end for any number of entities.
    """
    tweak = f"{kind}|{attempt}|"
    more = 2 * max(0, attempt - WIDEN + 1)
    if kind == "card":
        if luhn(norm):
            body = encipher(key, tweak + "valid|", norm[:-1] + "0" * more)
            return next(body + str(d) for d in range(10) if luhn(body + str(d)))
        out = encipher(key, tweak, norm + "0" * more)
        while luhn(out):
            out = encipher(key, tweak, out)
        return out
    if kind == "ip" and more:
        x = _number(key, kind, norm, str(attempt))
        return "fd" + ":".join(f"{x >> 16 * i & 0xFFFF:04x}" for i in range(8))[2:]
    if kind == "ip":
        x = _address(norm)
        first, bits = next(((_address(a), n) for a, n in PRIVATE if x >> n == _address(a) >> n), (0, 32))
        x = first + _permute(key, tweak + str(first), x - first, 1 << bits)  # a private address stays one of its range
        return ".".join(str(x >> s & 255) for s in (24, 16, 8, 0))
    if kind == "iban":
        return _iban(norm[:2], encipher(key, tweak, norm[4:] + "0" * more))
    if kind == "email":
        dot = norm.rindex(".")
        # a letter of no class cannot be enciphered, and gives way to a generated one
        body = "".join(c if not c.isalnum() or class_of(c) else generated(key, f"{norm}|{i}", _SETS["a"], 1) for i, c in enumerate(norm[:dot]))
        return encipher(key, tweak, "a" * more + body) + norm[dot:]
    if kind == "secret":
        return encipher(key, tweak, norm + "a" * more, hexa=bool(re.fullmatch(r"[0-9a-f]+", norm)))
    if kind == "birth":
        span = 36_525  # days of a century; later draws leave it
        return str(int(norm) // span * span + _permute(key, tweak, int(norm) % span, span) + span * more)
    if kind == "phone" and norm[0] == "+":
        return encipher(key, tweak, norm + "0" * more, fixed=1 + calling_code(norm[1:]))
    if kind in ("phone", "ssn"):
        return encipher(key, tweak, norm + "0" * more)
    script = script_of(norm)
    if script not in SYLLABLES:
        return generated(key, f"{kind}|{norm}|{attempt}", letters(script), (2 if len(letters(script)) > 1000 else 5) + attempt)
    ends = ENDINGS[script]["s" if kind == "surname" else kind[-1]]
    n = _number(key, kind, norm, str(attempt))
    n, end = divmod(n, len(ends))
    made = []
    for _ in range(3 + attempt + (kind == "surname")):
        n, r = divmod(n, len(SYLLABLES[script]))
        made.append(SYLLABLES[script][r])
    return "".join(made) + ends[end]


def in_digits_of(like: str, c: str) -> str:
    """A digit c in the digits that `like` belongs to; other characters stay."""
    return chr(ord(like) - unicodedata.decimal(like) + int(c)) if like.isdecimal() and c in _SETS["d"] else c


def dress(kind: str, raw: str, norm: str, new: str) -> str:
    """The surrogate in the mention's own layout: its separators, its case."""
    if kind == "birth":
        d = date.fromordinal((int(new) - 1) % 3_652_059 + 1)
        sign = re.search(r"\D", raw)[0]
        return d.isoformat() if sign == "-" else sign.join((f"{d.day:02d}", f"{d.month:02d}", f"{d.year:04d}"))
    if kind in ("phone", "card", "ssn", "iban"):
        source = iter(new.removeprefix("+"))
        same = "".join(in_digits_of(c, next(source)) if c.isalnum() else c for c in raw)
        return same + "".join(in_digits_of(raw[-1], c) for c in source)
    if kind == "ip" and not raw.isascii():
        like = next(c for c in raw if c.isdecimal() and not c.isascii())
        return "".join(in_digits_of(like, c) for c in new)
    if kind == "email":
        return "".join(n.upper() if c.isupper() else n for c, n in zip(raw, new)) if len(raw) == len(new) else new
    if kind.startswith(("given", "surname")):
        return new.upper() if raw.isupper() and len(raw) > 1 else new[:1].upper() + new[1:]
    return new


def replace(text: str, key: bytes, attempts: dict[tuple[str, str], int]) -> tuple[str, list[tuple[int, int, str]]]:
    found = detect(text)
    out, at = [], 0
    for a, z, kind in found:
        norm = normal(kind, text[a:z])
        out += [text[at:a], dress(kind, text[a:z], norm, surrogate(key, kind, norm, attempts.get((kind, norm), 0)))]
        at = z
    return "".join([*out, text[at:]]), found


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))


def rewritten(texts: pa.Array, maps: pa.Array, key: bytes, size: int = 256) -> pa.Array:
    """text, spans of each text; maps: its redraws or null. New texts leave for Arrow `size` at a time."""
    out = [pa.array([], pa.string())], [pa.array([], _SPANS)]
    for at in range(0, len(texts), size):
        new: tuple[list[str | None], list[list[dict]]] = ([], [])
        for t, m in zip(texts.slice(at, size).to_pylist(), maps.slice(at, size).to_pylist()):
            text, found = (None, []) if t is None else replace(t, key, {(x["kind"], x["norm"]): x["attempt"] for x in m or ()})
            new[0].append(text)
            new[1].append([{"start": a, "end": z, "kind": kind} for a, z, kind in found])
        out[0].append(pa.array(new[0], pa.string()))
        out[1].append(pa.array(new[1], _SPANS))
    return pa.StructArray.from_arrays([pa.concat_arrays(x) for x in out], ["text", "spans"])


def mentions(docs: DataFrame) -> DataFrame:
    """digest (of the text), kind, norm: each entity of each different text once."""

    def find(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:  # a batch stays in Arrow; few of its texts are Python strings at once
            rows = {(d, kind, normal(kind, t[a:z])) for d, t in zip(batch.column(0).to_pylist(), each_text(batch.column(1))) for a, z, kind in detect(t)}
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.binary(), pa.string(), pa.string()))], ["digest", "kind", "norm"])

    return docs.where(F.col("text").isNotNull()).select(digest().alias("digest"), "text").mapInArrow(find, "digest binary, kind string, norm string").distinct()


def redraws(entities: DataFrame, key: bytes) -> DataFrame:
    """kind, norm, attempt of the entities whose first surrogate another one has, or that is itself a real entity.

    Each attempt from WIDEN on has at least a hundred times the room of the one before, so the rounds end.
    """

    @F.pandas_udf("string")
    def draw(kind: pd.Series, norm: pd.Series, attempt: pd.Series) -> pd.Series:
        return pd.Series([surrogate(key, k, n, a) for k, n, a in zip(kind, norm, attempt)], dtype=object)

    held = stored(entities.select("kind", "norm", F.lit(0).alias("attempt")).withColumn("new", draw("kind", "norm", "attempt")), "surrogates")
    while True:
        first = held.groupBy("kind", "new").agg(F.min("norm").alias("norm"), F.count("*").alias("n")).where("n > 1").select("kind", "new", F.col("norm").alias("winner"))
        lost = held.join(first, ["kind", "new"]).where("norm <> winner").select("kind", "norm")
        real = held.join(entities.select("kind", F.col("norm").alias("new")), ["kind", "new"], "left_semi").select("kind", "norm")
        again = stored(lost.union(real).distinct(), "redrawn")
        if again.isEmpty():
            return held.where("attempt > 0").select("kind", "norm", "attempt")
        drawn = held.join(again, ["kind", "norm"], "left_semi").withColumn("attempt", F.col("attempt") + 1).withColumn("new", draw("kind", "norm", "attempt"))
        held = stored(held.join(again, ["kind", "norm"], "left_anti").unionByName(drawn), "surrogates")


def pseudonymize(docs: DataFrame, key: bytes) -> DataFrame:
    """docs with text replaced, and n_entities and spans (array of start, end, kind: places in the old text) added.

    Null texts stay null with no entity. Rows, ids and other columns stay as they are (columns named n_entities or spans
    are replaced). The same entity has the same surrogate in every row; different entities of a kind have different
    ones. Most corpora need no redraw, and then the texts are not shuffled; else the redraws travel to their texts by a
    join on content.
    """
    held = stored(mentions(docs), "mentions")
    again = stored(redraws(held.select("kind", "norm").distinct(), key), "redraws")
    place = "_siltmill_redraws"

    @F.arrow_udf("text string, spans array<struct<start:int,end:int,kind:string>>")
    def write(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, maps in parts:
            yield rewritten(texts, maps, key)

    kind = "array<struct<kind:string,norm:string,attempt:int>>"
    if again.isEmpty():
        marked = docs.withColumn(place, F.lit(None).cast(kind))
    else:
        by_text = held.join(again, ["kind", "norm"]).groupBy(F.col("digest").alias("_siltmill_digest")).agg(F.collect_list(F.struct("kind", "norm", "attempt")).alias(place))
        marked = docs.join(by_text, digest() == by_text["_siltmill_digest"], "left").drop("_siltmill_digest")
    done = marked.withColumn("_siltmill_new", write("text", place))
    return done.withColumns({"text": F.col("_siltmill_new.text"), "spans": F.col("_siltmill_new.spans"), "n_entities": F.size("_siltmill_new.spans")}).drop("_siltmill_new", place)
