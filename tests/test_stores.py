"""Index segments of uploads, the vector index, and the catalog's parts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltmill.engine import Engine
from siltmill.operators import retrieval as R
from siltmill.operators import blockmax as B
from siltmill.operators import segments as G
from siltmill.operators import tenants as T
from siltmill.operators import vector_index as V
from siltmill.operators.assembly import RetrieverConfig
from siltmill.operators.embedding import Embedder, hashed
from siltmill.sources.snapshots import Catalog, Conflict

ACT = "พระราชบัญญัติการจัดซื้อจัดจ้างและการบริหารพัสดุภาครัฐ พ.ศ. 2560"


def chunks(spark, org, *rows):
    return spark.createDataFrame([(d, f"{org}#{d}", org, t) for d, t in rows], "doc_id string, chunk_id string, org_id string, embed_text string")


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id int, text string")


def scores(df):
    return sorted((r.query_id, r.chunk_id, r.score) for r in df.collect())


def test_segments_give_what_an_index_from_scratch_gives(spark, tmp_path, monkeypatch):
    seg = G.TenantSegments(Catalog(spark, f"file://{tmp_path}/cat"))
    q = asked(spark, "alpha beta", "gamma", "delta old")
    held = {}

    def same():
        want = R.bm25(chunks(spark, "A", *held.items()).select("chunk_id", F.col("embed_text").alias("text")), q, key="chunk_id")
        assert scores(R.bm25(seg.index("A"), q)) == scores(want)

    assert seg.index("A") is None and not seg.delete("A", spark.createDataFrame([("1",)], "doc_id string"))
    for rows in ([("1", "alpha beta beta"), ("2", "old delta")], [("3", "gamma " * 5), ("2", "gamma alpha")], [("4", None), ("1", "")]):
        seg.upload("A", chunks(spark, "A", *rows))
        held |= dict(rows)
        same()
    seg.upload("B", chunks(spark, "B", ("1", "alpha alpha secret")))
    same()
    assert seg.delete("A", spark.createDataFrame([("3",), ("9",)], "doc_id string")) and not seg.delete("A", spark.createDataFrame([("3",)], "doc_id string"))
    del held["3"]
    same()
    seg.upload("A", chunks(spark, "A", ("3", "gamma again")))  # a deleted document comes back
    held["3"] = "gamma again"
    same()
    seg.merge("A")
    same()
    assert len(seg.segments("A")) == 1 and not [p for p in seg.catalog.parts(G.GONE) if p.startswith("A\t")]
    assert [r.chunk_id for r in R.bm25(seg.index("B"), asked(spark, "secret")).collect()] == ["B#1"] and R.bm25(seg.index("A"), asked(spark, "secret")).isEmpty()
    monkeypatch.setattr(G, "MERGE_AT", 1)
    seg.upload("A", chunks(spark, "A", ("5", "delta")))
    held["5"] = "delta"
    same()
    assert len(seg.segments("A")) == 1 and seg.chunks(None) is None and seg.chunks("C") is None


def test_uploads_of_one_tenant_at_the_same_time_conflict(spark, tmp_path, monkeypatch):
    one, two = (G.TenantSegments(Catalog(spark, f"file://{tmp_path}/cat")) for _ in range(2))
    one.upload("A", chunks(spark, "A", ("1", "x")))
    publish = two.catalog.publish

    def late(*args, **more):
        one.upload("A", chunks(spark, "A", ("1", "first")))
        one.upload("B", chunks(spark, "B", ("1", "other")))
        return publish(*args, **more)

    monkeypatch.setattr(two.catalog, "publish", late)
    with pytest.raises(Conflict):
        two.upload("A", chunks(spark, "A", ("1", "second")))
    assert [r.embed_text for r in one.chunks("A").collect()] == ["first"] and [r.embed_text for r in one.chunks("B").collect()] == ["other"]
    assert len(list((tmp_path / "cat" / "snapshots").iterdir())) == 3  # what the late one wrote is gone
    with pytest.raises(Exception, match="another tenant"):
        one.upload("A", chunks(spark, "B", ("7", "x")))


@pytest.mark.parametrize("embed", [None, Embedder((hashed(),))])
def test_engine_finds_uploads_at_once(spark, tmp_path, embed):
    e = Engine(spark, Catalog(spark, f"file://{tmp_path}/cat"), embed=embed)
    e.build(spark.createDataFrame([("a.md", ACT, "มาตรา ๑ ชื่อ alpha\nมาตรา ๒ ใช้ beta ตามมาตรา 1\nมาตรา ๓ gamma")], "path string, title string, text string"))
    files = lambda *rows: spark.createDataFrame(rows, "source_id string, title string, text string")
    q, v = asked(spark, "zebra beta"), spark.createDataFrame([(0, 0, "zebra beta")], "query_id int, variant_id int, text string")
    found = lambda org: {r.entry: r.content for r in e.search(q, org, 9).collect()}
    kept = lambda org: {r.chunk_id for r in e.retrieve(v, org, RetrieverConfig(threshold=0.4))[0].collect()}
    mine = e.tenant_doc_id("ORG", "s1") + "#0001"
    assert "TOR" not in found("ORG") and mine not in kept("ORG")
    e.ingest(files(("s1", "TOR", "zebra crossing"), ("s2", "BOQ", "other words")), "ORG")
    assert "zebra" in found("ORG")["TOR"] and "TOR" not in found("OTHER") and "TOR" not in found("")
    assert mine in kept("ORG") and mine not in kept("OTHER")
    if embed:
        assert e.uploads.vectors("ORG").count() == 2 and e.uploads.vectors("OTHER") is None
        assert e.catalog.read("vectors").count() == e.catalog.read("chunks").count()
    e.ingest(files(("s1", "TOR", "lion only")), "ORG")
    assert "zebra" not in found("ORG").get("TOR", "") and (embed or "TOR" not in found("ORG"))
    e.ingest(files(("s1", "TOR", "zebra again")), "ORG")
    assert "again" in found("ORG")["TOR"]
    assert e.delete_document("ORG", e.tenant_doc_id("ORG", "s1")) and "TOR" not in found("ORG") and mine not in kept("ORG")
    e.rebuild(Embedder((hashed(),)))
    assert [r.chunk_id for r in e.uploads.vectors("ORG").collect()] == [e.tenant_doc_id("ORG", "s2") + "#0001"]


def test_catalog_reads_parts_of_one_schema_in_one_scan(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/cat")
    for i in range(5):
        c.append("log", spark.createDataFrame([(i, "a")], "n int, who string"))
    c.append("log", spark.createDataFrame([(9, "b", 1.5)], "n int, who string, more double"))
    df = c.read("log")
    assert sorted(r.n for r in df.collect()) == [0, 1, 2, 3, 4, 9] and df._jdf.queryExecution().logical().toString().count("Relation") == 2
    c.compact("log")
    assert len(c.parts("log")) == 1 and c.read("log").where("more is null").count() == 5


def vectors(spark, n, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 16))
    v = centres[rng.integers(0, 12, n)] + 0.4 * rng.normal(size=(n, 16))
    rows = [(i, [float(x) for x in v[i]]) for i in range(n)] + [(n, [float(x) for x in v[0]]), (n + 1, [0.0] * 16), (n + 2, None)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def hits(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


def test_vector_index_recall_and_exactness(spark, tmp_path, monkeypatch):
    table = vectors(spark, 3000).cache()
    folder = f"file://{tmp_path}/index"
    V.build(table, folder)
    index = V.open_index(spark, folder)
    assert index.rows().count() == 3002 == int(index.sizes.sum()) and len(index.cells) > 30
    q = table.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    true = hits(R.dense_top(table.where("embedding is not null"), q, "vec_id", 10))
    assert hits(V.search(index, q, 10, probes=3, exact=True)) == true
    got = {(a, c) for a, _, c, _ in hits(V.search(index, q, 10))}
    assert len(got & {(a, c) for a, _, c, _ in true}) >= 0.9 * len(true) and 1 <= index.probes < len(index.cells) / 2
    one = q.where("query_id = 0")
    read = V._by_cell(index, np.column_stack([np.zeros(8, int), index.probed(V.unit(np.array([r.q for r in one.collect()])), 8)[0]]))
    some = index.rows().where(F.col("cell").isin(list(read))).select("vec_id")
    assert len(some.collect()) == sum(index.sizes[index.cells == c][0] for c in read)
    files = some._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numFiles").value()
    assert len(read) == 8 and files < 0.5 * len(index.rows().inputFiles())  # cells that are not probed are not read
    monkeypatch.setattr(V, "QUERY_BYTES", 20_000)
    assert hits(V.search(index, q, 10, probes=3, exact=True)) == true  # queries in blocks


def test_vector_index_of_odd_tables(spark, tmp_path):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, q array<double>")
    for name, rows, want in (("none", [], []), ("one", [(5, [2.0, 0.0])], [5]), ("same", [(i, [1.0, 1.0]) for i in range(40)], [0, 1, 2])):
        table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        V.build(table, f"file://{tmp_path}/{name}")
        index = V.open_index(spark, f"file://{tmp_path}/{name}")
        assert [r.vec_id for r in V.search(index, q, 3, exact=True).orderBy("rank").collect()] == want
        assert V.search(index, q.limit(0), 3).count() == 0


def test_block_search_reads_few_blocks_and_loses_nothing(spark):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(400)]
    weight = 1 / np.arange(1, 401)
    texts = [" ".join(rng.choice(words, rng.integers(1, 40), p=weight / weight.sum())) for _ in range(1500)] + [None, "", "w0 w0 w0"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").cache()
    q = spark.createDataFrame([(0, "w1 w390 w391 w392"), (1, "w0"), (2, "w350"), (3, "nothing known"), (4, "w0 w1 w2 w399"), (5, "")], "query_id int, text string")
    hold = lambda df, _: df.cache()
    hits, reads = B.block_top(B.block_index(R.index_of(docs), 8, hold), q, 5, 4, keep=hold)
    want = R.top_k(R.bm25(docs, q), ["query_id"], "score", ["doc_id"], 5)
    order = lambda df: sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in df.collect())
    assert order(hits) == order(want)
    share = {r.query_id: r.read / r.blocks for r in reads.collect()}
    assert set(share) == {0, 1, 2, 4} and share[0] < 0.3 and max(share.values()) <= 1  # rare words decide: few blocks; frequent ones: nearly all


def test_pairs_of_tenant_and_question_see_their_own(spark):
    owners = spark.createDataFrame([(1, "PUBLIC"), (2, "A"), (3, "B"), (4, None), (5, "PUBLIC"), (6, "A")], "doc_id int, org_id string")
    scores = spark.createDataFrame([(0, i, float(i)) for i in range(1, 8)] + [(1, 1, 1.0), (1, 3, 1.0)], "query_id int, doc_id int, score double")
    asks = spark.createDataFrame([("A", 0), ("A", 0), ("B", 0), ("B", 1), ("C", 0), (None, 0), ("", 1)], "tenant string, query_id int")
    got = T.search_pairs(scores, owners, asks, "doc_id", 3)
    rows = {}
    for r in got.orderBy("rank").collect():
        rows.setdefault((r.tenant, r.query_id), []).append(r.doc_id)
    assert rows == {("A", 0): [6, 5, 2], ("B", 0): [5, 3, 1], ("B", 1): [1, 3], ("C", 0): [5, 1], (None, 0): [5, 1], ("", 1): [1]}
    assert {r.leaked for r in T.leaks(got, owners, "doc_id").collect()} == {0}
    planted = got.select("tenant", "doc_id").unionByName(spark.createDataFrame([("A", 3), ("A", 4), ("C", 2), (None, 2), ("B", 99)], "tenant string, doc_id int"))
    assert {r.tenant: (r.hits, r.leaked) for r in T.leaks(planted, owners, "doc_id").collect()} == {"A": (5, 2), "B": (6, 1), "C": (3, 1), None: (3, 1), "": (1, 0)}


def test_rounds_go_on_with_open_questions_only(spark):
    from siltmill.operators.rounds import ask_in_rounds

    store = spark.createDataFrame([("a", 1, 2.0), ("b", 2, 1.0), ("weak", 3, 0.1), ("weak", 1, 0.2), ("b", 3, 0.05)], "text string, doc_id int, score double")
    asked_texts = []

    def search(q):
        asked_texts.append(sorted(r.text for r in q.collect()))
        return q.join(store, "text")

    steps = {"x": "b", "xx": "x", "weak": "b", "stay": "stay", "away": None}
    rewrite = lambda t, turn: F.create_map(*[F.lit(v) for kv in steps.items() for v in kv])[t]
    q = spark.createDataFrame([(1, "a"), (2, "x"), (3, "xx"), (4, "xxx"), (5, "weak"), (6, "stay"), (7, "away")], "query_id int, text string")
    strong = lambda h: h.where("score >= 1").select("query_id")
    hits, states = ask_in_rounds(q, search, rewrite, "doc_id", 2, strong, lambda df, _: df.cache())
    assert {(r.query_id): (r.searches, r.settled) for r in states.collect()} == {1: (1, True), 2: (2, True), 3: (3, True), 4: (1, False), 5: (2, True), 6: (1, False), 7: (1, False)}
    assert asked_texts == [["a", "away", "stay", "weak", "x", "xx", "xxx"], ["b", "b", "x"], ["b"]]
    got = {(r.query_id, r.doc_id): (r.score, r.round) for r in hits.collect()}
    assert got[1, 1] == (2.0, 0) and got[3, 2] == (1.0, 2) and got[5, 3] == (0.1, 0) and got[5, 1] == (0.2, 0) and got[5, 2] == (1.0, 1)
    none, states = ask_in_rounds(q.limit(0), lambda d: d.join(store, "text"), rewrite, "doc_id")
    assert none.count() == 0 and states.count() == 0
