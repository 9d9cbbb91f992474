"""Scalar text functions as Column expressions; all run inside the JVM."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

THAI, ARABIC = "๐๑๒๓๔๕๖๗๘๙", "0123456789"
TOKEN = r"([\p{L}\p{N}_]+)"


def to_arabic(c: Column) -> Column:
    return F.translate(c, THAI, ARABIC)


def to_thai(c: Column) -> Column:
    return F.translate(c, ARABIC, THAI)


def tokens(c: Column) -> Column:
    """Lower-cased words of two or more characters; null texts have none."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN), F.lit(1)), lambda t: F.length(t) > 1)


def token_index(token: Column, space: int = 1_000_000) -> Column:
    """Hashed index of a term: first 8 hex digits of its md5, modulo the space, from 1."""
    return (F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long") % space + 1).cast("long")


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def slug_id(title: Column, length: int = 40) -> Column:
    """Readable id: word characters of the title, cut, and 8 hex digits of its md5."""
    s = F.regexp_replace(title, r"[^\p{L}\p{N}_]+", "_")
    return F.concat(F.substring(s, 1, length), F.lit("_"), F.substring(F.md5(title), 1, 8))


def entry(title: Column, label: Column) -> Column:
    return F.concat(title, F.lit(" | "), label)


def clean_label(c: Column, most: int = 120) -> Column:
    return F.rtrim(F.substring(collapse(F.regexp_replace(c, r"[|#*_`]", " ")), 1, most))


def chunk_id(entry: Column) -> Column:
    return F.concat(F.lit("chunk_"), md5_id(entry))


def md5_id(c: Column, digits: int = 16) -> Column:
    return F.substring(F.md5(c), 1, digits)


def unit_ref(label: Column) -> dict[str, Column]:
    """kind, number, part (default 1) and base of a unit label such as `มาตรา ๑๒ (ตอนที่ 2)`; the part's brackets may be
    missing. A word without a number is no unit and has no kind."""
    t = F.trim(to_arabic(label))
    named = F.nullif(F.regexp_extract(t, r"^(มาตรา|ข้อ)\s*\d", 1), F.lit(""))
    digits = lambda pattern: F.nullif(F.regexp_extract(t, pattern, 1), F.lit("")).cast("int")
    return {
        "kind": named,
        "number": digits(r"^(?:มาตรา|ข้อ)\s*(\d+)"),
        "part": F.coalesce(digits(r"ตอนที่\s*(\d+)"), F.lit(1)),
        "base": F.trim(F.regexp_replace(t, r"\s*\(\s*ตอนที่\s*\d+\s*\)$", "")),
    }


def year_be(c: Column) -> Column:
    """Buddhist-era year after its mark; null when there is none."""
    return F.nullif(F.regexp_extract(to_arabic(c), r"พ\.?\s*ศ\.?\s*(\d{4})", 1), F.lit("")).cast("int")


def year_loose(c: Column) -> Column:
    return F.nullif(F.regexp_extract(to_arabic(c), r"(25\d\d)", 1), F.lit("")).cast("int")


def legal_level(title: Column) -> Column:
    return (
        F.when(title.startswith("พระราชบัญญัติ"), "ACT").when(title.startswith("กฎกระทรวง"), "MINISTERIAL_RULE").when(title.startswith("ระเบียบ"), "REGULATION").otherwise("CIRCULAR")
    )


def chapter_number(path: Column) -> Column:
    """Number of the first chapter heading in a section path (array)."""
    return F.nullif(F.regexp_extract(to_arabic(F.array_join(path, " ")), r"หมวด\s*(\d+)", 1), F.lit("")).cast("int")


def cited_units(c: Column) -> Column:
    """Different unit references in order of first mention."""
    return F.array_distinct(F.transform(F.regexp_extract_all(to_arabic(c), F.lit(r"((?:มาตรา|ข้อ)\s*\d+)"), F.lit(1)), lambda x: F.regexp_replace(x, r"\s+", " ")))


# Words of forms (weight 0.75) and of enacted law (1.25).
FORMS = ["แบบสัญญา", "แบบฟอร์ม", "สัญญาสำเร็จรูป", "ตัวอย่างสัญญา"]
LAW = ["พระราชบัญญัติ", "ระเบียบกระทรวงการคลัง", "กฎกระทรวง", "ประกาศคณะกรรมการ"]
#: Fixed value: a regulation of this year is repealed.
REPEALED = "2535"


def any_of(c: Column, words: list[str]) -> Column:
    return reduce(lambda x, y: x | y, [F.contains(c, F.lit(w)) for w in words])


def hierarchy_multiplier(title: Column, entry: Column | None = None, text: Column | None = None) -> Column:
    """Weight of a source by its rank, from its title, entry and first 300 characters: forms less, enacted law more."""
    parts = [title, *([entry] if entry is not None else []), *([F.substring(text, 1, 300)] if text is not None else [])]
    c = F.lower(F.concat_ws(" ", *parts))
    return F.when(any_of(c, FORMS), 0.75).when(any_of(c, LAW), 1.25).otherwise(1.0)


def marked_year(c: Column) -> Column:
    """A year 25xx after its mark or as a number of its own; null when there is none."""
    return F.nullif(F.regexp_extract(c, r"(?:พ\.ศ\.|ปี|(?<![\p{L}\p{N}_]))(25\d\d)(?![\p{L}\p{N}_])", 1), F.lit("")).cast("int")


def recency_boost(year: Column, newest: Column, floor_year: int = 2560) -> Column:
    """0 for superseded years, else 1.30 less 0.02 a year of age, at least 1.05; 1 for an unknown year."""
    age = F.greatest(F.lit(0), newest - year)
    return F.when(year.isNull(), 1.0).when(year < floor_year, 0.0).otherwise(F.greatest(F.lit(1.05), 1.30 - 0.02 * age))


def source_boost(title: Column, entry: Column, text: Column, newest: Column) -> Column:
    """Rank times recency; a repealed regulation has 0. The year is the title's or entry's, else that of the first 400
    characters."""
    year = F.coalesce(marked_year(F.concat_ws(" ", title, entry)), marked_year(F.substring(text, 1, 400)))
    gone = F.contains(title, F.lit(REPEALED)) | F.contains(entry, F.lit(REPEALED))
    return F.when(gone, 0.0).otherwise(hierarchy_multiplier(title, entry, text) * recency_boost(year, newest))


def newest_year(title: Column, entry: Column) -> Column:
    """Aggregate: the newest year from 2500 to 2650 among the candidates; 2569 without any."""
    y = marked_year(F.concat_ws(" ", title, entry))
    return F.coalesce(F.max(F.when(y.between(2500, 2650), y)), F.lit(2569))


# What a question's words add to it, in this order.
EXPANSIONS = [
    (["made in thailand", "mit", "ผลิตในประเทศ", "ผลิตภายในประเทศ", "สินค้าไทย"], ["พัสดุที่ผลิตภายในประเทศ", "ส่งเสริมหรือสนับสนุน", "แต้มต่อ"]),
    (["ลงนาม", "ทำสัญญา", "ชนะการเสนอราคา", "ผู้ชนะ"], ["การทำสัญญา", "การลงนามในสัญญา", "การอุทธรณ์"]),
    (["e-market", "ตลาดอิเล็กทรอนิกส์"], ["การจัดซื้อจัดจ้าง", "วิธีตลาดอิเล็กทรอนิกส์", "e-catalog"]),
    (["ปรับ", "ล่าช้า", "ไม่ปฏิบัติตามสัญญา", "ทิ้งงาน"], ["อัตราค่าปรับ", "การคิดค่าปรับ", "ค่าปรับรายวัน"]),
    (["บอกเลิก", "เลิกสัญญา"], ["การบอกเลิกสัญญา", "การแก้ไขสัญญา", "สัญญาสิ้นสุด"]),
    (["คัดเลือก", "เชิญชวน"], ["วิธีคัดเลือก", "หนังสือเชิญชวน"]),
    (["คณะกรรมการ", "แต่งตั้ง", "ประธาน", "องค์ประกอบ"], ["คณะกรรมการซื้อหรือจ้าง", "การแต่งตั้งคณะกรรมการ", "ประธานกรรมการ"]),
    (["ราคากลาง", "factor f", "ดอกเบี้ย"], ["หลักเกณฑ์ราคากลาง", "อัตราดอกเบี้ย", "การคำนวณราคากลาง"]),
    (["กี่", "เท่าใด", "เท่าไหร่", "ร้อยละ", "เปอร์เซ็นต์", "%", "บาท", "วงเงิน", "อัตรา", "สัดส่วน", "วันทำการ", "กำหนดเวลา", "ปัดเศษ", "ไม่เกิน", "ไม่น้อยกว่า", "ขั้นต่ำ", "สูงสุด"], ["เกณฑ์", "อัตรา", "หลักเกณฑ์", "กำหนดไว้"]),
    (["tor", "ขอบเขตของงาน", "สเปก", "สเปค", "ยี่ห้อ"], ["คุณลักษณะเฉพาะ", "การกำหนดคุณลักษณะเฉพาะ"]),
]


def expand_query(c: Column) -> Column:
    """The question followed by the terms that its words call for, each once."""
    none = F.array().cast("array<string>")
    added = F.array_distinct(F.concat(*[F.when(any_of(F.lower(c), words), F.array(*map(F.lit, terms))).otherwise(none) for words, terms in EXPANSIONS]))
    return F.when(F.size(added) > 0, F.concat(c, F.lit(" "), F.array_join(added, " "))).otherwise(c)


# Tags that evidence matching looks through, named entities, and signs that don't count.
EVIDENCE_TAGS = "table thead tbody tr td th br p b i u strong em span div ul ol li".split()
ENTITIES = [("&nbsp;", "\u00a0"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")]
IGNORED = "|#*`\"'“”‘’"


def normal_evidence(c: Column) -> Column:
    """Text for evidence matching: without markup tags, white space, quotes and table signs; entities read (the named ones
    of ENTITIES), digits Arabic, lower case. Vowel and tone marks and all other signs count."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), rf"(?i)</?(?:{'|'.join(EVIDENCE_TAGS)})(?:\s[^>]*)?/?>", " ")
    for name, char in ENTITIES:
        t = F.replace(t, F.lit(name), F.lit(char))
    return F.lower(F.regexp_replace(to_arabic(t), rf"[\s\u00a0{re.escape(IGNORED)}]+", ""))


def doc_key(c: Column) -> Column:
    """What a path and a title of one document share: the file's name without its ending, as evidence text."""
    name = F.element_at(F.split(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("/")), "/"), -1)
    return normal_evidence(F.regexp_replace(name, r"(?i)\.md$", ""))


def same_document(expected: Column, found: Column, least: int = 20) -> Column:
    """Document keys agree: the found one holds the expected one; the other way round only from `least` characters."""
    return (expected != "") & (found != "") & (F.contains(found, expected) | ((F.length(found) >= least) & F.contains(expected, found)))


# Amounts in words.
AMOUNTS = {"หนึ่งแสน": 100_000, "ห้าแสน": 500_000, "หนึ่งล้าน": 1_000_000, "สองล้าน": 2_000_000, "ห้าล้าน": 5_000_000}


def baht_ceilings(c: Column) -> Column:
    """Different amounts of `not more than (a budget of) N baht`, in digits (five characters or more) or in words."""
    t, lead = to_arabic(c), r"ไม่เกิน\s*(?:วงเงิน\s*)?"
    digits = F.transform(F.regexp_extract_all(t, F.lit(lead + r"([\d,]{5,})\s*บาท"), F.lit(1)), lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("long"))
    words = F.array(*[F.when(F.regexp_like(t, F.lit(f"{lead}{w}บาท")), F.lit(n).cast("long")) for w, n in AMOUNTS.items()])
    return F.array_sort(F.filter(F.array_union(digits, words), lambda x: x.isNotNull()))


def money(c: Column) -> Column:
    return F.format_number(c, 0)


def valid_org(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[A-Za-z0-9\x{0E00}-\x{0E7F}_-]{1,64}$"), F.lit(False))


def clean_cell(c: Column) -> Column:
    """Table cell: tags become spaces, the five named entities are read, spaces collapsed."""
    t = F.regexp_replace(c, r"<[^>]+>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(char))
    return collapse(t)


def page_range(first: Column, last: Column, total: Column) -> Column:
    """`4-6/42`, `4/42`, `4-6`, `4` or null."""
    span = F.when(last.isNull() | (first == last), first.cast("string")).otherwise(F.concat_ws("-", first.cast("string"), last.cast("string")))
    return F.when(first.isNull(), F.lit(None)).when(total.isNull(), span).otherwise(F.concat(span, F.lit("/"), total.cast("string")))


def escape_like(c: Column) -> Column:
    """A user's words as a literal for LIKE."""
    return F.regexp_replace(c, r"([%_\\])", r"\\$1")


def strip_references(c: Column) -> Column:
    """Text without bracketed or parenthesised unit references."""
    return collapse(F.regexp_replace(c, r"[\[(]\s*(?:มาตรา|ข้อ|section|clause)\s*[\d๐-๙]+[^\])]*[\])]", ""))
