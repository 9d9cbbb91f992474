"""Thai words against brute force, and ranking over Thai sentences."""

import random

import pytest
from pyspark.sql import functions as F

from siltmill.functions import segment as S
from siltmill.operators import retrieval as R

WORDS = """การ จัดซื้อ จัดจ้าง จัดซื้อจัดจ้าง โดย วิธี เฉพาะ เจาะจง เฉพาะเจาะจง ให้ หน่วยงาน ของ รัฐ เชิญ ผู้ประกอบการ ที่ มี คุณสมบัติ โดยตรง เข้า
ยื่น ข้อเสนอ ประกาศ เชิญชวน ทั่วไป ดำเนินการ ด้วย ตลาด อิเล็กทรอนิกส์ หรือ ประกวด ราคา คณะกรรมการ ตรวจรับ พัสดุ ที่ทำการ ผู้ใช้ หลักประกัน เสนอ เงินสด เช็ค
หนังสือ ค้ำประกัน ธนาคาร วงเงิน ครั้งหนึ่ง ไม่ เกิน ห้า แสน บาท บริหาร สัญญา และ แก้ไข บอกเลิก ค่าปรับ ตาก ลม ตา กลม""".split()
SENTENCES = [
    "การจัดซื้อจัดจ้างโดยวิธีเฉพาะเจาะจง ให้หน่วยงานของรัฐเชิญผู้ประกอบการที่มีคุณสมบัติโดยตรงเข้ายื่นข้อเสนอ",
    "การจัดซื้อจัดจ้างโดยวิธีประกาศเชิญชวนทั่วไป ให้ดำเนินการด้วยวิธีตลาดอิเล็กทรอนิกส์หรือวิธีประกวดราคาอิเล็กทรอนิกส์",
    "คณะกรรมการตรวจรับพัสดุ ให้ตรวจรับพัสดุ ณ ที่ทำการของผู้ใช้พัสดุ",
    "หลักประกันการเสนอราคา ให้ใช้เงินสด เช็ค หรือหนังสือค้ำประกันของธนาคาร",
    "วงเงินการจัดซื้อจัดจ้างโดยวิธีเฉพาะเจาะจง ครั้งหนึ่งไม่เกินห้าแสนบาท",
    "การบริหารสัญญาและการตรวจรับพัสดุ การแก้ไขสัญญา การบอกเลิกสัญญา และค่าปรับ",
]


@pytest.fixture(scope="module")
def cut(spark):
    return S.segmenter(spark.createDataFrame([(w,) for w in [*WORDS, WORDS[0], None]], "word string"))


def all_ways(run, words):
    """Every way to cover a run by words and single clusters outside words."""
    ends = S.cluster_ends(run)
    if not run:
        return [[]]
    out = []
    first = next(j for j in range(1, len(run) + 1) if ends[j])
    for j in range(1, len(run) + 1):
        if ends[j]:
            rest = None
            for known in (True, False):
                if (known and run[:j] in words) or (not known and j == first):
                    rest = all_ways(run[j:], words) if rest is None else rest
                    out += [[(known, run[:j]), *r] for r in rest]
    return out


def test_segments_are_the_best_of_all_ways():
    rng = random.Random(4)
    for _ in range(400):
        words = {"".join(rng.choice("กขาเิ่ัน") for _ in range(rng.randint(1, 4))) for _ in range(12)}
        run = "".join(rng.choice("กขาเิ่ัน") for _ in range(rng.randint(0, 9)))
        best = min(all_ways(run, words), key=lambda w: (sum(len(p) for k, p in w if not k), sum(k for k, _ in w), [-len(p) for _, p in w]))
        want, open_ = [], False
        for known, piece in best:
            if known or not open_:
                want.append(piece)
            else:
                want[-1] += piece
            open_ = not known
        assert S.segment(run, S.prefixes(sorted(words))) == want, (run, words)


def test_clusters_stay_whole():
    trie = S.prefixes(["จัด", "ซื้อ", "จัดซื้อ", "ไป", "ตาก", "ลม", "ตา", "กลม"])
    assert S.segment("จัดซื้อ", trie) == ["จัดซื้อ"] and S.segment("ไปจัดซื้อไป", trie) == ["ไป", "จัดซื้อ", "ไป"]
    assert S.segment("ตากลม", trie) == ["ตาก", "ลม"]  # as few words either way: the longer first word
    assert S.segment("กขคไปงจ", trie) == ["กขค", "ไป", "งจ"] and S.segment("", trie) == [] and S.segment("เก", {}) == ["เก"]


def test_segmenter_odd_texts(spark, cut):
    rows = [(0, None), (1, ""), (2, "Plain WORDS a 12"), (3, "จัดซื้อABCพัสดุ ๒๕๖๐ x_1"), (4, "พัสดุ" * 20_000), (5, "  \n ")]
    got = {r[0]: r[1] for r in spark.createDataFrame(rows, "id int, text string").select("id", cut(F.col("text"))).collect()}
    assert got[0] == got[1] == got[5] == [] and got[2] == ["plain", "words", "12"]
    assert got[3] == ["จัดซื้อ", "abc", "พัสดุ", "๒๕๖๐", "x_1"] and got[4] == ["พัสดุ"] * 20_000
    empty = S.segmenter(spark.createDataFrame([], "word string"))
    assert spark.createDataFrame([("จัดซื้อ",)], "text string").select(empty(F.col("text"))).first()[0] == ["จัดซื้อ"]


def test_dictionary_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(S, "DICTIONARY_WORDS", 3)
    with pytest.raises(ValueError):
        S.segmenter(spark.range(4).select(F.col("id").cast("string").alias("word")))


def test_thai_sentences_rank_by_their_words(spark, cut):
    docs = spark.createDataFrame(list(enumerate(SENTENCES)), "doc_id int, text string")
    asked = spark.createDataFrame([(0, "วิธีเฉพาะเจาะจง วงเงิน"), (1, "ตรวจรับพัสดุ"), (2, "หลักประกันการเสนอราคา"), (3, "ประกวดราคาอิเล็กทรอนิกส์")], "query_id int, text string")
    for variant in ("sparse", "okapi"):
        top = R.top_k(R.bm25(docs, asked, variant, tokenize=cut), ["query_id"], "score", ["doc_id"], 1)
        assert {r.query_id: r.doc_id for r in top.collect()} == {0: 4, 1: 2, 2: 3, 3: 1}
    index = R.index_of(docs, tokenize=cut)
    assert index.postings.where("term = 'ดซ'").isEmpty() and index.postings.where("term = 'พัสดุ'").count() == 2
