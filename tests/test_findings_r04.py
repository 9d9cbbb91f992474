"""One small test for each finding of round 4 that was right."""

from siltmill.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"


def test_thai_search_keeps_documents_whole(spark):
    """postings are neither rows nor shuffled, words come out of the segmenter as Arrow lists, batches are bounded."""
    from siltmill.functions import segment as S

    plan = QUERIES["thai_bm25_topk"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan
    trie = {"ตาก": True, "ตา": True, "กลม": True, "ลม": True, "กล": False, "ล": False, "ต": False, "ก": False}
    import pyarrow as pa

    levels = S.packed(pa.chunked_array([pa.array([w for w, whole in trie.items() if whole])]))
    texts = ["ตากลม ABC x ฮฮตา", None, "", "éÉ ฮ"]
    got = S.split_all(texts, levels)
    assert isinstance(got, pa.ListArray) and got.to_pylist() == [None if t is None else S.split_words(t, trie) for t in texts]


def test_thai_words_are_found_without_trying_ways(monkeypatch):
    """only where words overlap are ways to cover a run tried out, one letter after the other."""
    import random

    import pyarrow as pa

    from siltmill.functions import segment as S

    words = ["เกข", "เกขค", "เคง", "เก"]
    levels = S.packed(pa.chunked_array([pa.array(words)]))
    tried = []
    cover = S.cover
    monkeypatch.setattr(S, "cover", lambda *a: tried.append(a) or cover(*a))
    if hasattr(S, "steps"):
        steps = S.steps
        monkeypatch.setattr(S, "steps", lambda *a: tried.append(a) or steps(*a))
    assert S.segment_all(["เกขคเกเคง" * 50, "", "ฮฮเก"], levels) == [["เกขค", "เก", "เคง"] * 50, [], ["ฮฮ", "เก"]] and not tried
    monkeypatch.undo()
    rng = random.Random(9)
    for _ in range(200):
        words = sorted({"".join(rng.choice("กขาเิ่ัน") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(0, 14))})
        runs = ["".join(rng.choice("กขาเิ่ันฮ") for _ in range(rng.randint(0, 25))) for _ in range(6)]
        assert S.segment_all(runs, S.packed(pa.chunked_array([pa.array(words, pa.string())]))) == [S.segment(r, S.prefixes(words)) for r in runs]


def test_pairs_of_the_sql_stand_in_one_line():
    """the SQL broke ties of a line number differently in its two lists."""
    import duckdb

    from siltmill.plans.catalogue import ORACLE_SQL

    c = duckdb.connect()
    c.execute("create view lineitem as select * from '/root/testdata/sf0.1/lineitem.parquet'")
    pairs = f"(select * from ({ORACLE_SQL['expected_pair_expand']}) where l_orderkey % 2 = 0)"
    strays = f"select count(*) from {pairs} p anti join lineitem l on l.l_orderkey = p.l_orderkey and l.l_partkey = p.doc and l.l_suppkey = p.section"
    assert c.execute(strays).fetchone() == (0,) and c.execute(f"select count(*) from {pairs}").fetchone()[0] > 100_000


def test_held_sections_of_long_orders_equal_the_sql(spark, tmp_path):
    """from 300 characters on a section is a chunk, in the SQL too."""
    import duckdb

    from siltmill.plans.catalogue import ORACLE_SQL

    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string"
    rows = [(o, 100 * o + i, i, i % 7, 1.0, "N") for o, n in [(1, 1), (2, 12), (3, 13), (4, 26), (5, 2)] for i in range(n)]
    spark.createDataFrame(rows, names).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    c = duckdb.connect()
    c.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    want = c.execute(f"select doc_id, ord, doc_type, kind, label, content, path from ({ORACLE_SQL['held_sections']}) order by all").fetchall()
    got = sorted(map(tuple, QUERIES["held_sections"](spark, str(tmp_path)).select("doc_id", "ord", "doc_type", "kind", "label", "content", "path").collect()))
    assert got == want and {d: sum(x[0] == d for x in got) for d in range(1, 6)}[1] == 1 and max(x[1] for x in got) >= 1


def test_plain_tables_are_read_without_a_parser(monkeypatch):
    """only tables with unusual tags go through HTMLParser, letter for letter the same cells come out."""
    import random

    from siltmill.sources import tables as T

    fed = []
    feed = T._Grid.feed
    monkeypatch.setattr(T._Grid, "feed", lambda self, data: fed.append(data) or feed(self, data))
    plain = "<table><tr><th colspan=2>Order</th></tr>\n<tr><td rowspan='2'>a &amp; b</td><td><b>c</b><br/>4</td></tr><tr><td>d</td></tr></table>"
    t = T.html_table(plain)
    assert (t.header, t.rows) == ([["Order", "Order"]], [["a & b", "c 4"], ["a & b", "d"]]) and not fed
    tokens = ["<tr>", "</tr>", "<td>", "</td>", "<TH Rowspan=2>", '<td colspan="3" rowspan="x">', "<thead>", "</thead>", "<tbody>", "<br />", "</p>", "a b", "&lt;b&gt;", "&#39;", "&nope;", "& ", "1 < 2", "<!-- c -->", "<td/>", "<td title='a>b'>", "<script>", "\n"]
    rng = random.Random(2)
    for k in range(3000):
        source = "<table>" + "".join(rng.choice(tokens[: 15 if k % 2 else None]) for _ in range(rng.randint(0, 20)))
        g = T._Grid()
        feed(g, source)
        got = T._grid(source)
        assert (got.done(), got.first_span) == (g.done(), g.first_span), source


def test_lines_are_shuffled_by_their_keys(spark, monkeypatch):
    """quantities and flags that no text needs stay behind, and many lines are many partitions."""
    import re

    from siltmill.plans import corpus_queries as C

    def shuffled(df):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        found = re.search(r"RepartitionByExpression \[doc_id#\d+L?\], (\d+)", plan)
        return int(found[1]), plan

    n, plan = shuffled(C.ordered_lines(spark, SF))
    assert "l_returnflag#" not in plan.split("Relation [")[0] and "l_quantity#" not in plan.split("Relation [")[0]
    monkeypatch.setattr(C, "TASK_LINES", 10)
    assert shuffled(C.ordered_lines(spark, SF))[0] > n


def test_a_build_counts_terms_without_a_shuffle(spark):
    """the same postings, counted in the tasks that read the chunks."""
    from siltmill.engine import Engine
    from siltmill.operators import retrieval as R

    chunks = spark.createDataFrame([("a", "ab ab cd"), ("b", None), ("c", ""), ("d", "x"), ("e", "cd ef ก")], "chunk_id string, embed_text string")
    made = Engine(spark, None)._postings(chunks)
    want = R.postings(chunks, "chunk_id", "embed_text")
    assert made.columns == want.columns and sorted(made.collect()) == sorted(want.collect())
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
