"""Rank assembly, tenancy, writes, snapshots, audit and streaming on small tables."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from siltmill.operators import assembly as A
from siltmill.operators import audit, graph, lookup, metrics, retrieval, writes
from siltmill.functions import text as T
from siltmill.session import check_writable, own_only, tenant_view, visible
from siltmill.sources.snapshots import Catalog, Conflict
from siltmill.streaming import events as S


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_tenant_scope_is_closed_by_default(spark):
    d = frame(spark, [(1, "PUBLIC"), (2, "A"), (3, "B"), (4, None)], "id int, org_id string")
    ids = lambda x: sorted(r.id for r in x.collect())
    assert ids(visible(d, "A")) == [1, 2] and ids(visible(d, None)) == [1] and ids(visible(d, "")) == [1]
    assert ids(own_only(d, "A")) == [2] and ids(own_only(d, None)) == [] and ids(own_only(d, "PUBLIC")) == []
    d.createOrReplaceTempView("all_rows")
    tenant_view(spark, "all_rows", "my_rows")
    assert [r.id for r in spark.sql("select id from my_rows order by id").collect()] == [1]
    spark.sql("set var app_org = 'B'")
    assert [r.id for r in spark.sql("select id from my_rows order by id").collect()] == [1, 3]
    with pytest.raises(Exception, match="another tenant"):
        check_writable(d, "A").collect()
    with pytest.raises(PermissionError):
        check_writable(d, "")


def test_one_variant_puts_the_neighbour_after_its_seed(spark):
    cfg = A.RetrieverConfig(search_top_k=10, seeds=10, per_query=1, top_k=3, graph_per_seed=1)
    ranked = frame(spark, [(0, 0, "a", 1), (0, 0, "b", 2)], "query_id int, variant_id int, id string, rank int")
    fused = A.fuse_variants(ranked, cfg, "id").select("query_id", "id")
    scored = fused.withColumns({"variant_id": F.lit(0), "score": F.when(F.col("id") == "a", 2.0).otherwise(1.0)})
    final = A.rerank(scored, "id")
    kept = A.slots(scored, A.passing(final, 0.0, "id"), "id", cfg)
    edges = frame(spark, [("a", "z", 0), ("a", "y", 1)], "seed string, dst string, ord int")
    out = A.carry_neighbours(kept, edges, "id", cfg).orderBy("position").collect()
    assert [r.id for r in out] == ["a", "z", "b"] and [r.origin for r in out] == ["search", "graph", "search"]


def test_every_variant_has_its_slot_and_one_row_survives_the_threshold(spark):
    cfg = A.RetrieverConfig(per_query=1, top_k=1)
    scored = frame(spark, [(0, 0, "a", 9.0), (0, 1, "a", 0.0), (0, 0, "b", 1.0), (0, 1, "b", 5.0), (0, 0, "c", 8.0), (0, 1, "c", 0.0)], "query_id int, variant_id int, id string, score double")
    kept = A.slots(scored, A.passing(A.rerank(scored, "id"), 0.0, "id"), "id", cfg)
    assert [r.id for r in kept.orderBy("position").collect()] == ["a", "b"]
    assert [r.id for r in A.passing(A.rerank(scored, "id"), 100.0, "id").collect()] == ["a"]
    best = {r.id: (r.final, r.best_variant) for r in A.rerank(scored, "id", "max").collect()}
    assert best["b"] == (5.0, 1) and best["a"] == (9.0, 0)


def python_rrf(lists, k=60):
    s = {}
    for ids in lists:
        for i, x in enumerate(ids, 1):
            s[x] = s.get(x, 0) + 1 / (k + i)
    return sorted(s, key=lambda x: (-round(s[x], 8), x))


def test_fusion_equals_a_plain_model(spark):
    r = random.Random(4)
    rows, lists = [], {}
    for q in range(20):
        lists[q] = [r.sample(range(30), 12) for _ in range(3)]
        rows += [(q, v, d, i) for v, ids in enumerate(lists[q]) for i, d in enumerate(ids, 1)]
    out = A.fuse_variants(frame(spark, rows, "query_id int, variant_id int, id int, rank int"), A.RetrieverConfig(), "id").collect()
    for q in range(20):
        assert [x.id for x in sorted((x for x in out if x.query_id == q), key=lambda x: x.rank)] == python_rrf(lists[q])


def test_bm25_equals_the_textbook(spark):
    import math

    texts = ["red green green", "red blue", "green", "yellow red red red", "", "black white"]
    d = frame(spark, list(enumerate(texts)), "doc_id int, text string")
    q = frame(spark, [(0, "red green red"), (1, "white"), (2, "absent")], "query_id int, text string")
    got = {(r.query_id, r.doc_id): r.score for r in retrieval.bm25(d, q).collect()}
    toks = [t.split() for t in texts]
    avg = sum(map(len, toks)) / len(toks)
    for qi, terms in ((0, {"red", "green"}), (1, {"white"})):
        for i, t in enumerate(toks):
            want = 0
            for w in terms:
                df = sum(w in x for x in toks)
                tf = t.count(w)
                want += math.log(1 + (6 - df + 0.5) / (df + 0.5)) * round(tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / avg)), 5) if tf else 0
            assert abs(got.get((qi, i), 0) - want) < 1e-3
    assert not any(k[0] == 2 for k in got)


def test_guardrail(spark):
    method = "วิธีเฉพาะเจาะจง "
    rows = [
        ("ตามมาตรา ๗ และมาตรา 8", "มาตรา 7 มาตรา 8", True, 1.0),
        ("มาตรา 1 มาตรา 2 ม. 3", "มาตรา 1", False, 0.33),
        ("วงเงินไม่เกิน 900,000 บาท", "", True, 1.0),
        (method + "ไม่เกิน 900,000 บาท", "", False, 1.0),
        (method + "ไม่เกินวงเงินหนึ่งล้านบาท สำหรับสถานศึกษา", "", True, 1.0),
        (method + "ไม่เกินสองล้านบาท", "", False, 1.0),
        ("", "x", False, 0.0),
        ("no law", "", True, 1.0),
        ("ข้อ 9 และมาตรา 5", "มาตรา 5", True, 0.5),
        ("มาตรา 56 ข้อ 78", "", True, 1.0),
    ]
    a = frame(spark, [(i, x, c, [56] if i == 9 else None, [78] if i == 9 else []) for i, (x, c, _, _) in enumerate(rows)], "id int, answer string, context string, s array<int>, c array<int>")
    g = audit.grounding(a, F.col("answer"), F.col("context"), F.col("s"), F.col("c")).orderBy("id").collect()
    assert [(r.passed, r.score) for r in g] == [r[2:] for r in rows] and g[8].ungrounded_clauses == ["9"] and g[3].wrong_ceilings == [900_000]


def test_thai_scalars(spark):
    d = frame(spark, [("มาตรา ๑๒ (ตอนที่ ๒)", "ระเบียบ พ.ศ. ๒๕๖๐ ข้อ ๓ และ ข้อ 3 มาตรา ๗")], "label string, text string")
    u = T.unit_ref(F.col("label"))
    r = d.select(*(c.alias(k) for k, c in u.items()), T.year_be(F.col("text")).alias("y"), T.year_loose(F.col("text")).alias("y2"), T.cited_units(F.col("text")).alias("c"), T.chapter_number(F.array(F.lit("หมวด ๔ x"))).alias("ch")).first()
    assert (r.kind, r.number, r.part, r.base) == ("มาตรา", 12, 2, "มาตรา 12") and (r.y, r.y2, r.ch) == (2560, 2560, 4) and r.c == ["ข้อ 3", "มาตรา 7"]
    assert d.select(T.same_document(F.lit("bcd"), F.lit("abcdef")), T.same_document(F.lit("abcdef"), F.lit("bcd"))).first()[:] == (True, False)


def test_lookup_orders(spark):
    u = frame(spark, [(1, "x", "ACT", 5, "aa"), (1, "x", "ACT", None, "a"), (1, "y", "REGULATION", 1, "b"), (1, "y", "REGULATION", 2, "bb"), (1, "z", "MINISTERIAL_RULE", 1, "c")], "number int, doc_id string, level string, page int, entry string")
    refs = frame(spark, [(1,)], "number int")
    assert [r.entry for r in lookup.lookup_section(refs, u, ["number"]).orderBy("rank").collect()] == ["aa", "a", "b", "c", "bb"]
    ranked = lookup.lookup_clause(refs, u, ["number"])
    assert [r.entry for r in ranked.orderBy("rank").collect()] == ["b", "bb", "c", "aa", "a"]
    assert lookup.ambiguous(ranked, ["number"], "doc_id").first()[1:] == ("y", ["z", "x"])


def test_edges(spark):
    u = frame(spark, [("d", 0, 1, "u0"), ("d", 1, 1, "u1"), ("d", 1, 2, "u1b"), ("d", 2, 1, "u2"), ("d", 4, 1, "u4"), ("e", 5, 1, "v5")], "doc string, n int, part int, unit string")
    nxt = {(r.src, r.dst) for r in graph.next_edges(u, ["doc"], ["n", "part", "unit"], "unit", "n", "part").collect()}
    assert nxt == {("u1", "u1b"), ("u1b", "u2")}
    cases = frame(spark, [(1, "see Big Law here"), (2, "none")], "case_id int, text string")
    laws = frame(spark, [(9, "Big Law"), (8, "Law of All")], "doc_id int, title string")
    assert [tuple(r) for r in graph.link_titles(cases, laws).collect()] == [(1, 9)]


def test_titles_in_texts_against_brute_force(spark):
    import random

    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abกข ") for _ in range(n))
    texts = [(i, word(rng.randint(0, 40))) for i in range(120)] + [(200, None), (201, ""), (5, "copy ab"), (202, "copy ab"), (203, "copy ab")]
    names = [(i, word(rng.choice([1, 2, 3, 9, 12]))) for i in range(60)] + [(70, "copy ab"), (71, "copy ab"), (72, None), (73, "  "), (74, "never in any text")]
    cases, laws = spark.createDataFrame(texts, "case_id int, text string"), spark.createDataFrame(names, "doc_id int, title string")
    want = sorted((i, j) for i, t in texts for j, n in names if t is not None and n and n.strip(" ") and n in t)
    assert sorted(map(tuple, graph.link_titles(cases, laws).collect())) == want and len(want) > 100
    assert graph.link_titles(cases, laws.limit(0)).count() == 0 and graph.link_titles(cases.limit(0), laws).count() == 0


def test_writes(spark):
    old = frame(spark, [(1, "a", "t0"), (2, "b", "t0")], "id int, v string, created string")
    new = frame(spark, [(2, "B", "t1"), (3, "C", "t1")], "id int, v string, created string")
    assert sorted(map(tuple, writes.upsert(old, new, ["id"], ["created"]).collect())) == [(1, "a", "t0"), (2, "B", "t0"), (3, "C", "t1")]
    e = frame(spark, [("a", "b", "R", "x")], "src string, dst string, rel string, p string")
    f = frame(spark, [("a", "b", "R", "y"), ("a", "c", "R", "z")], "src string, dst string, rel string, p string")
    assert sorted(map(tuple, writes.merge_edges(e, f).collect())) == [("a", "b", "R", "y"), ("a", "c", "R", "z")]


def test_metrics_without_targets_and_pairs(spark):
    res = frame(spark, [(1, "a", 1), (1, "b", 2), (2, "x", 1)], "query_id int, item string, rank int")
    tgt = frame(spark, [(1, "b"), (3, "q")], "query_id int, item string")
    m = {(r.query_id, r.k): r for r in metrics.at_cutoffs(res, tgt, [1, 2]).collect()}
    assert (m[1, 1].hit, m[1, 2].precision, m[1, 2].adjusted_precision, m[1, 2].mrr) == (0.0, 0.5, 1.0, 0.5)
    assert m[2, 1].recall == 1.0 and m[3, 2].recall == 0.0
    p = frame(spark, [(1, ["a", "b"], ["x", "y"]), (2, ["a"], ["x", "y"])], "id int, d array<string>, s array<string>")
    assert sorted((r.id, r.doc, r.section) for r in metrics.expand_pairs(p, "d", "s").collect()) == [(1, "a", "x"), (1, "b", "y"), (2, "a", "x"), (2, "a", "y")]
    both = frame(spark, [([], ["a"]), (["a"], []), (["a", "b"], ["b", "c"])], "t array<string>, s array<string>")
    got = both.select(*(c.alias(k) for k, c in metrics.citation_scores(F.col("t"), F.col("s")).items())).collect()
    assert [tuple(r) for r in got] == [(1.0, 1.0, 1.0), (0.0, 0.0, 0.0), (0.5, 0.5, 0.5)]


def test_snapshots_swap_and_stream(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/cat")
    assert c.current() == {}
    first = frame(spark, [("d1", 0, "x"), ("d2", 0, "y")], "doc string, i int, t string")
    c.publish({"chunks": first}, {"linker": 5})
    S.replace_batches(c, "chunks", "doc")(frame(spark, [("d2", 0, "z"), ("d2", 1, "zz")], "doc string, i int, t string"), 7)
    assert sorted((r.doc, r.t) for r in c.read("chunks").collect()) == [("d1", "x"), ("d2", "z"), ("d2", "zz")]
    assert c.current()["metadata"] == {"linker": 5, "epoch": 7}


def test_two_publishers_and_a_reader(spark, tmp_path):
    c, d = Catalog(spark, f"file://{tmp_path}/cat"), Catalog(spark, f"file://{tmp_path}/cat")
    one = frame(spark, [("a", 1)], "k string, v int")
    c.publish({"t": one, "u": one})
    base = c.version()
    d.publish({"u": one.withColumn("v", F.lit(2))})
    reader = c.read("u", version=base)
    c.publish({"t": one.withColumn("v", F.lit(3))}, base=base)  # another table has changed, so both are kept
    assert (c.read("t").first().v, c.read("u").first().v, reader.first().v) == (3, 2, 1)
    with pytest.raises(Conflict):
        d.publish({"t": one}, base=base)
    assert c.read("t").first().v == 3 and c.version() == base + 2
    c.append("log", one), c.append("log", one)
    c.publish({"p": one}, parts={"p": "A"}), c.publish({"p": one.withColumn("v", F.lit(9))}, parts={"p": "B"})
    assert c.read("log").count() == 2 and c.read("p").count() == 2 and c.read("p", "B").first().v == 9


def test_streaming_windows_drop_late_rows(spark, tmp_path):
    t = lambda m: datetime.datetime(2024, 1, 1, 0, 0) + datetime.timedelta(minutes=m)
    schema = "ts timestamp, event_type string, user_id long"
    src = tmp_path / "in"
    for i, rows in enumerate([[(t(1), "error", 1), (t(50), "view", 1)], [(t(200), "view", 2)], [(t(210), "view", 2)], [(t(2), "view", 1), (t(201), "error", 2)], [(t(500), "view", 2)]]):
        frame(spark, rows, schema).coalesce(1).write.mode("append").parquet(str(src / f"b{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(src))
    q = S.windowed_counts(stream).writeStream.outputMode("append").format("memory").queryName("wins").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.start, r.event_type): (r.n, r.n_errors) for r in spark.table("wins").collect()}
    assert got[(t(0), "error")] == (1, 1) and got[(t(0), "view")] == (1, 0)
