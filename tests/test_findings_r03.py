"""One small test for each finding of round 3 that was right."""

import datetime

from siltmill.plans.catalogue import QUERIES


def _lines(spark, folder, rows):
    """lineitem.parquet below folder, of (orderkey, linenumber, partkey, suppkey)."""
    day = datetime.date(2020, 1, 1)
    full = [(o, p, s, n, 10.0, 1.0, 0.0, 0.0, "N", "O", day) for o, n, p, s in rows]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate date"
    spark.createDataFrame(full, names).write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def test_quote_attribution_keeps_long_keys_apart(spark, tmp_path):
    """parts from a million and suppliers from ten thousand on."""
    rows = [(7, 1, 1_199_996, 59_999), (7, 1, 1, 20_005), (7, 1, 2, 10_005)]
    got = QUERIES["quote_attribution"](spark, _lines(spark, tmp_path, rows)).collect()
    assert sorted((r["quote_id"], r["l_partkey"], r["l_suppkey"]) for r in got) == [(71, 1, 20_005), (71, 2, 10_005), (71, 1_199_996, 59_999)]
    assert {r["l_partkey"]: r["filename"] for r in got} == {1: "own7.pdf", 2: "reg7.md", 1_199_996: "own7.pdf"}


def test_spelling_variants_broadcast_no_vocabulary(spark):
    """neither small nor large vocabularies go through the driver."""
    from siltmill.llm.op12_spelling_variants import followed, spelling_variants

    counts = spark.createDataFrame([("letters", 500), ("lettrs", 90), ("lettrrs", 10), ("unlike", 7)], "word string, n long")
    seen = []
    for df in (spelling_variants(counts), followed(spark.createDataFrame([("a", "b"), ("b", "c")], "word string, form string"))):
        got = {r["word"]: r["root"] for r in df.collect()}
        seen.append(got)
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
    assert seen == [{"letters": "letters", "lettrs": "letters", "lettrrs": "letters", "unlike": "unlike"}, {"a": "c", "b": "c"}]


def test_row_groups_are_as_by_whole_markdown():
    """a table is cut where it was, without writing out each group again for each row."""
    import random

    from siltmill.sources import tables

    class Counted(tables.Table):
        written = 0

        def markdown(self, rows=None):
            Counted.written += 1
            return super().markdown(rows)

    def slowly(t, most):
        out, group = [], []
        for row in t.rows:
            if group and len(t.markdown([*group, row])) > most:
                out.append(t.markdown(group))
                group = []
            group.append(row)
        return [*out, t.markdown(group)] if group else out

    rng = random.Random(5)
    for _ in range(300):
        width = rng.randint(1, 3)
        row = lambda: [rng.choice(["", "a", "words " * rng.randint(1, 4)]) for _ in range(width)]
        t = tables.Table([row()] if rng.random() < 0.6 else [], [row() for _ in range(rng.randint(0, 12))])
        assert [m for m, _, _ in tables.split_table(t, 40)] == slowly(t, 40)
    long = Counted([["h"]], [["x" * 20]] * 500)
    parts = tables.split_table(long, 2000)
    assert len(parts) > 4 and Counted.written <= len(parts) + 1


def test_chunks_send_only_what_is_asked(spark):
    """divided provisions are numbered where they are cut, so contents are not shuffled to number them."""
    from siltmill.operators.chunking import chunk_documents

    unit = lambda n: f"มาตรา {n} " + "x" * 1500 + "\n" + "y" * 1500
    files = spark.createDataFrame([("a", "A", unit(1) + "\n" + unit(2) + "\nมาตรา 3 short"), ("n", "N", None)], "path string, title string, text string")
    df = chunk_documents(files, columns=["source_file", "ord", "label", "parent"])
    assert df.columns == ["source_file", "ord", "label", "parent"]
    assert [r["parent"] for r in df.orderBy("ord").collect()] == [1, 1, 2, 2, None]
    whole = chunk_documents(files)
    assert [r["parent_id"] is None for r in whole.orderBy("ord").collect()] == [False] * 4 + [True] and "parent" not in whole.columns
    plan = QUERIES["long_units"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


def test_large_dictionaries_cut_as_small_ones(spark, monkeypatch):
    """no bound on the dictionary's words, and the same words as by a table of strings."""
    import random

    import pyarrow as pa
    from pyspark.sql import functions as F

    from siltmill.functions import segment as S

    rng = random.Random(3)
    for _ in range(150):
        words = sorted({"".join(rng.choice("กขาเิ่ัน") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(0, 14))})
        runs = ["".join(rng.choice("กขาเิ่ัน") for _ in range(rng.randint(0, 12))) for _ in range(6)]
        levels = S.packed(pa.chunked_array([pa.array(words, pa.string())]))
        assert S.segment_all(runs, levels) == [S.segment(r, S.prefixes(words)) for r in runs]
    monkeypatch.setattr(S, "DICTIONARY_WORDS", 3)
    monkeypatch.setattr(S, "LOOKED_UP", 12)
    words = ["จัดซื้อ", "พัสดุ", "ไป", "ตาก", "ลม", "ตากลม", None, "ไป", ""]
    texts = [None, "", "Plain WORDS a 12", "จัดซื้อABCพัสดุ ๒๕๖๐ x_1", "ตากลมไป", "พัสดุ" * 50, "  \n "]
    cut = S.large_segmenter(spark.createDataFrame([(w,) for w in words], "word string"))
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1).select("id", cut(F.col("text"))).collect()
    trie = S.prefixes([w for w in words if w])
    assert {i: w for i, w in rows} == {i: S.split_words(t or "", trie) for i, t in enumerate(texts)}
    empty = S.large_segmenter(spark.createDataFrame([], "word string"))
    assert spark.createDataFrame([("จัดซื้อ",)], "text string").select(empty(F.col("text"))).first()[0] == ["จัดซื้อ"]


def test_titles_are_looked_up_in_batches(spark):
    """many short cases make few tables, copies of a text are read once, and the links stay."""
    from siltmill.operators import graph

    texts = [f"by Law {i % 25} then" for i in range(2_000)]
    cases = spark.createDataFrame(list(enumerate(texts)), "case_id long, text string").coalesce(1)
    laws = spark.createDataFrame([(i, f"Law {i}") for i in range(25)] + [(25, "by Law 3 then and on"), (26, " ")], "doc_id long, title string")
    rows = graph._grams(cases.selectExpr("xxhash64(text) as _row", "text"), "_row", "text", [5], graph.GRAM)
    assert rows.count() == sum(len(set(t[i : i + 5] for i in range(len(t) - 4))) for t in set(texts))
    got = {(r["case_id"], r["doc_id"]) for r in graph.link_titles(cases, laws).collect()}
    assert got == {(i, n) for i, t in enumerate(texts) for n in range(25) if f"Law {n}" in t}


def test_near_duplicates_take_candidates_from_fingerprints(spark):
    """texts whose SimHash fingerprints link are candidates, also where no prefix brings them together."""
    from siltmill.llm import near_duplicates

    prints = [0, 0b11, 0b1111, 0b111 << 40, 0b11111 << 40, 0b1111111 << 50]
    texts = spark.createDataFrame([(i, [], 1, bytes(64), fp) for i, fp in enumerate(prints)], "id long, prefix array<long>, size int, parity binary, fp long")
    got = {(r["node"], r["root"]) for r in near_duplicates.candidates(texts, 0.8, 4096).collect()}
    assert got == {(1, 0), (2, 0), (4, 3)}


def test_saved_index_has_a_row_for_each_document(spark, tmp_path):
    """an index is written without a shuffle of postings, and searches keep k rows a query in each task."""
    from pyspark.sql import functions as F

    from siltmill.operators import retrieval as R

    texts = ["red blue blue", "blue green", "", None, "red red green x", "Red, blue! BLUE"]
    docs = spark.createDataFrame([(i, t, "AB"[i % 2]) for i, t in enumerate(texts * 3)] + [(5, "red blue blue", "B"), (None, "green green", "A")], "doc_id long, text string, org string")
    asked = spark.createDataFrame([(1, "red blue"), (2, "green blue blue"), (3, "none")], "query_id long, text string")
    folder = f"file://{tmp_path}/index"
    R.save_index(docs, folder)
    index, plain = R.open_index(spark, folder), R.index_of(docs)
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    assert index.documents.count() == 19 and rows(index.postings.select("doc_id", "term", "tf", "doc_len")) == rows(plain.postings.select("doc_id", "term", "tf", "doc_len"))
    unique = docs.where("doc_id is not null and not (doc_id = 5 and text = 'red blue blue')")
    R.save_index(unique, folder + "-2")
    index = R.open_index(spark, folder + "-2")
    assert "Exchange" not in index.documents._jdf.queryExecution().executedPlan().toString()
    for variant in ("sparse", "okapi"):
        scores = R.bm25(R.index_of(unique), asked, variant)
        for k in (1, 4, 50):
            assert rows(R.bm25_top(index, asked, k, variant)) == rows(R.top_k(scores, ["query_id"], "score", ["doc_id"], k).select("query_id", "doc_id", "score", "rank"))
        some = scores.join(unique.where("org = 'A'"), "doc_id", "left_semi")
        assert rows(R.bm25_top(index, asked, 2, variant, seen=lambda d: d.where("org = 'A'"))) == rows(R.top_k(some, ["query_id"], "score", ["doc_id"], 2).select("query_id", "doc_id", "score", "rank"))
        each = scores.join(unique.select("doc_id", "org"), "doc_id")
        assert rows(R.bm25_top(index, asked, 2, variant, by="org")) == rows(R.top_k(each, ["query_id", "org"], "score", ["doc_id"], 2).select("query_id", "org", "doc_id", "score", "rank"))
    got = {(r["doc_id"], r["idx"]): r["weight"] for r in R.hashed_weights(index).collect()}
    w = R.saturation(F.col("tf"), F.col("doc_len"), F.col("avg_len"), 1.2, 0.75)
    from siltmill.functions.text import token_index

    want = index.postings.crossJoin(index.stats).groupBy("doc_id", token_index(F.col("term")).alias("idx")).agg(F.round(F.sum(F.round(w, 5)), 5).alias("weight"))
    assert got == {(r["doc_id"], r["idx"]): r["weight"] for r in want.collect()}


def test_searches_hold_few_scores_at_once():
    """the scores of many queries against a batch of vectors are never in memory together, and k a query stay."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from siltmill.operators import vector_index as V
    from siltmill.operators.best import Best
    from siltmill.operators.retrieval import nearest, unit

    rng = np.random.default_rng(2)
    v, q = unit(np.round(rng.normal(size=(10_000, 16)), 1)), unit(np.round(rng.normal(size=(2_000, 16)), 1))
    keys = rng.permutation(10_000)
    best = Best(len(q), 5)
    tracemalloc.start()
    for at in range(0, len(v), 5_000):
        nearest(best, np.arange(len(q)), q, pa.array(keys[at : at + 5_000]), v[at : at + 5_000])
    own, near = V.closest(v, q)
    assert tracemalloc.get_traced_memory()[1] < 90 << 20  # all scores: 160 MB
    tracemalloc.stop()
    found = [(i, k, s) for x in best.rows() for i, k, s in zip(*(c.to_pylist() for c in x), strict=True)]
    assert len(found) == 5 * len(q)
    for i in range(0, 2_000, 97):
        score = np.round(v @ q[i], 6)
        want = np.lexsort((keys, -score))[:5]
        assert [k for j, k, _ in found if j == i] == keys[want].tolist()
    assert (own == (v @ q.T).argmax(axis=1)).all() and np.allclose(near, (v @ q.T).max(axis=1))


def test_block_max_shuffles_no_postings(spark, tmp_path):
    """F16: blocks are made and read where documents are; keys that stand in several rows keep their whole score."""
    from siltmill.operators import blockmax as B
    from siltmill.operators import retrieval as R

    texts = [(i, " ".join(f"w{j}" for j in range(40) if (i * 7 + j * j) % 11 < 4)) for i in range(90)]
    q = spark.createDataFrame([(0, "w1 w2 w9"), (1, "w30"), (2, "none")], "query_id int, text string")
    order = lambda df: sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in df.collect())
    for name, rows in (("once", texts), ("again", texts + [(i, t + " w1 w1") for i, t in texts[:9]])):
        docs = spark.createDataFrame(rows, "doc_id int, text string")
        R.save_index(docs, str(tmp_path / name))
        blocks = B.block_index(R.open_index(spark, str(tmp_path / name)), 4)
        if name == "once":
            assert "Exchange" not in blocks.blocks._jdf.queryExecution().executedPlan().toString()
        want = R.top_k(R.bm25(docs, q), ["query_id"], "score", ["doc_id"], 5)
        assert order(B.block_top(blocks, q, 5, 2)[0]) == order(want)


def test_titles_choose_their_run_before_texts_send_any(spark):
    """runs are counted in the tasks and only the chosen ones leave them; texts in no pair are not shuffled."""
    from siltmill.operators import graph

    cases = spark.createDataFrame([(i, f"common words come often {i}") for i in range(400)] + [(400, "common words come often, rare"), (401, None), (402, "")], "case_id long, text string")
    laws = spark.createDataFrame([(1, "common words come often, rare"), (2, "come often 39"), (3, "common words nowhere"), (4, "ra")], "doc_id long, title string")
    kept = {}
    keep = lambda df, name: kept.setdefault(name, df.cache())
    got = {(r["case_id"], r["doc_id"]) for r in graph.link_titles(cases, laws, keep).collect()}
    assert got == {(400, 1), (400, 4)} | {(i, 2) for i in [39, *range(390, 400)]}
    assert "text-grams" not in kept and kept["title-chosen"].count() == 3 and kept["title-pairs"].count() <= 14


def test_provisions_are_looked_for_once_a_file(monkeypatch):
    """the class and the chunker share what was accepted, and only wanted columns are made."""
    from siltmill.operators import chunking as C

    seen, accepted = [], C.accepted_units
    monkeypatch.setattr(C, "accepted_units", lambda blocks: seen.append(1) or accepted(blocks))
    kind, chunks, _ = C.chunk_document("preamble\n# หมวด ๑ one\nมาตรา ๑ a\nมาตรา ๒ b\nมาตรา ๙ far")
    assert (kind, [c.label for c in chunks], len(seen)) == ("statute", ["บทนำ", "มาตรา ๑", "มาตรา ๒"], 1)
    assert [c.label for c in C.statute(C.parse("มาตรา ๑ a\nมาตรา ๒ b")[0], C.ChunkConfig())] == ["มาตรา ๑", "มาตรา ๒"]


def test_question_columns_are_found_once_a_table(monkeypatch):
    """the class and the chunker share a table's columns; a first row without dashes still names them."""
    from siltmill.operators import chunking as C

    seen, columns = [], C.faq_columns
    monkeypatch.setattr(C, "faq_columns", lambda names, rows: seen.append(tuple(names)) or columns(names, rows))
    text = "| ที่ | คำถาม | คำตอบ |\n|--|--|--|\n| ทั่วไป | | |\n| 1 | why | so |\n| | more | yes |"
    kind, chunks, _ = C.chunk_document(text)
    assert (kind, [c.content for c in chunks], len(seen)) == ("faq", ["คำถาม: why more\nคำตอบ: so yes"], 1)
    assert C.chunk_document(text.replace("|--|--|--|\n", ""))[0] == "faq" and len(C.faq(C.parse(text)[0], C.ChunkConfig())) == 1


def test_pipeline_sends_few_texts_to_python_at_once(spark):
    """pipeline: Arrow batches of whole texts are bounded by its stages; a caller's own setting wins."""
    import pyarrow as pa

    import corpus_pipeline

    name, docs = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.createDataFrame([(1, "en", "a text")], "doc_id long, lang string, text string")

    def rows(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(b)])], ["n"])

    def most():
        return max(r["n"] for r in spark.range(0, 5000, 1, 1).mapInArrow(rows, "n long").collect())

    held = spark.conf.get(name, None)
    try:
        for stage in (corpus_pipeline.language_stage, corpus_pipeline.near_duplicate_stage, corpus_pipeline.pii_stage, corpus_pipeline.packing_stage):
            spark.conf.unset(name)
            stage(spark, docs, "")
            assert most() <= 1000
        spark.conf.set(name, 77)
        corpus_pipeline.packing_stage(spark, docs, "")
        assert most() == 77
    finally:
        spark.conf.unset(name) if held is None else spark.conf.set(name, held)


def test_pii_rewrites_texts_in_slices():
    """pipeline, pii_surrogates: new texts leave for Arrow a few at a time, and are as by text."""
    import pyarrow as pa

    from siltmill.llm import op05_pii

    texts = [None, "", "write to a.b@example.org", "no entity"] * 3
    maps = pa.array([None, [], [{"kind": "email", "norm": "a.b@example.org", "attempt": 1}], None] * 3, pa.list_(pa.struct([("kind", pa.string()), ("norm", pa.string()), ("attempt", pa.int32())])))
    got = op05_pii.rewritten(pa.array(texts), maps, b"key", size=5).to_pylist()
    for t, m, row in zip(texts, maps.to_pylist(), got, strict=True):
        new, found = (None, []) if t is None else op05_pii.replace(t, b"key", {(x["kind"], x["norm"]): x["attempt"] for x in m or []})
        assert row == {"text": new, "spans": [{"start": a, "end": z, "kind": k} for a, z, k in found]}
    assert got[2]["text"] != texts[2]
    assert op05_pii.rewritten(pa.array([], pa.string()), maps[:0], b"key").to_pylist() == []
