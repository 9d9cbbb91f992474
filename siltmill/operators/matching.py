"""Relevance of a retrieved entry to an expected document and section, as Column expressions.

Both sides are reduced to keys (whole text, mentioned units by kind, title) and the keys are compared.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import to_arabic

# The label of a whole document; words without meaning of their own; titles known by first word and year.
WHOLE = "ทั้งฉบับ"
EMPTY_WORDS = ["ประกาศ", "แบบสัญญา", "เรื่อง", "หลักเกณฑ์", "ระเบียบฯ", "ระเบียบ", "พ.ร.บ.", "พรบ", "กฎกระทรวง", "ข้อ", "มาตรา"]
KNOWN_TITLES = [("พระราชบัญญัติ", "2560"), ("ระเบียบกระทรวงการคลัง", "2560"), ("กฎกระทรวง", "2561"), ("กฎกระทรวง", "2563"), ("ข้อตกลงคุณธรรม", "")]
SECTION_WORDS, CLAUSE_WORD, CHAPTER_WORD = ["มาตรา", "ม."], "ข้อ", "หมวด"


def legal(c: Column) -> Column:
    """Text with Arabic digits, plus and underscore as spaces, single spaces, lower case."""
    spaced = F.translate(to_arabic(F.coalesce(c, F.lit(""))), "+_\t\n\r", "     ")
    return F.lower(F.trim(F.regexp_replace(spaced, " +", " ")))


def base_name(path: Column) -> Column:
    name = F.element_at(F.split(F.coalesce(path, F.lit("")), "/"), -1)
    return F.when(F.endswith(F.lower(name), F.lit(".md")), F.substring(name, F.lit(1), F.length(name) - 3)).otherwise(name)


def sections_in(c: Column) -> Column:
    """Numbers that directly follow a section word."""
    words = "|".join(w.replace(".", "[.]") for w in SECTION_WORDS)
    return F.regexp_extract_all(legal(c), F.lit(f"(?:{words}) *([0-9]+)"), F.lit(1))


def numbers_after(c: Column, word: str) -> Column:
    """All numbers up to a bar after the word, lines being no bound: `ข้อ 1 และ 7` names 1 and 7."""
    rests = F.regexp_extract_all(legal(c), F.lit(f"{word}([^|]*)"), F.lit(1))
    return F.flatten(F.transform(rests, lambda r: F.regexp_extract_all(r, F.lit(r"(?U)\b([0-9]+)\b"), F.lit(1))))


def number_of(c: Column, words: list[str]) -> Column:
    """The number that directly follows the first of the words in an expected section; null without one."""
    alternatives = "|".join(w.replace(".", "[.]") for w in words)
    return F.nullif(F.regexp_extract(legal(c), f"(?:{alternatives}) *([0-9]+)", 1), F.lit(""))


def _names(expected: Column, words: list[str], mentioned: Column) -> Column:
    return F.coalesce(F.array_contains(mentioned, number_of(expected, words)), F.lit(False))


def section_matches(expected: Column, candidate: Column) -> Column:
    """One text holds the other, the candidate mentions the expected unit, or it holds what is left of the expected one
    (four characters or more) without the words that mean nothing of their own."""
    e, c = legal(expected), legal(candidate)
    core = F.trim(reduce(lambda x, w: F.replace(x, F.lit(w), F.lit("")), EMPTY_WORDS, e))
    same_unit = _names(expected, SECTION_WORDS, sections_in(candidate)) | _names(expected, [CLAUSE_WORD], numbers_after(candidate, CLAUSE_WORD)) | _names(expected, [CHAPTER_WORD], numbers_after(candidate, CHAPTER_WORD))
    return (e != "") & (c != "") & (F.contains(c, e) | F.contains(e, c) | same_unit | ((F.length(core) >= 4) & F.contains(c, core)))


def known_title(c: Column) -> Column:
    """The part of a title from a known first word to its year; null without one."""
    found = [F.nullif(F.regexp_extract(c, f"({word}[^|]+?{year})" if year else f"({word})", 1), F.lit("")) for word, year in KNOWN_TITLES]
    return F.coalesce(*found)


def document_matches(path: Column, candidate: Column) -> Column:
    b, c = legal(base_name(path)), legal(candidate)
    return (b != "") & (c != "") & (F.contains(c, b) | F.contains(b, c) | F.coalesce(F.contains(c, known_title(b)), F.lit(False)))


def same_title(path: Column, title: Column) -> Column:
    """Titles may be cut: either holds the other, the expected one's part only if it has 20 characters."""
    e, t = F.replace(legal(base_name(path)), F.lit(" ")), F.replace(legal(title), F.lit(" "))
    return F.when(F.coalesce(path, F.lit("")) == "", True).otherwise((e != "") & (t != "") & (F.contains(t, e) | ((F.length(t) >= 20) & F.contains(e, t))))


def unit_of(c: Column) -> Column:
    """`word number` of the first unit in the text; empty without one."""
    found = F.regexp_extract(legal(c), f"((?:{SECTION_WORDS[0]}|{CLAUSE_WORD}) *[0-9]+)", 1)
    return F.regexp_replace(found, "([^0-9 ]) *([0-9])", "$1 $2")


#: One bracketed item: digits or a Thai consonant.
ITEM = "[(] *[0-9ก-ฮ]+ *[)]"


def bare_item(section: Column) -> Column:
    """Whether an expected section is items alone, such as `(๒)` or `(1) (ก)`, without the unit that they belong to."""
    return F.regexp_like(legal(section), F.lit(f"^(?:{ITEM} *)+$"))


def chunk_matches(path: Column, section: Column, entry: Column, body: Column) -> Column:
    """A labelled chunk matches by its label: the document, then the whole-document label, the same unit, or, for
    chapters and bare items, the text; with no unit expected the document is enough. An unlabelled one matches by text."""
    title, label = F.substring_index(entry, "|", 1), F.substring(entry, F.instr(entry, "|") + 1, F.lit(1 << 20))
    text = F.concat_ws(" ", entry, body)
    anywhere = F.coalesce(path, F.lit("")) == ""
    by_text = section_matches(section, text) & (anywhere | document_matches(path, text))
    loose = F.contains(section, F.lit(CHAPTER_WORD)) | bare_item(section)
    by_unit = F.when(unit_of(section) != "", unit_of(label) == unit_of(section)).when(loose, by_text).otherwise(~anywhere)
    labelled = same_title(path, title) & ((F.trim(label) == WHOLE) | by_unit)
    return F.when(F.contains(entry, F.lit("|")), labelled).otherwise(by_text)
