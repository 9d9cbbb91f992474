"""The training-data operators against brute force, round trips, held-out accuracy and small hand-made tables."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from siltmill.llm import op01_suffix_dedup as op1
from siltmill.llm import op02_packing as op2
from siltmill.llm import op03_chat as op3
from siltmill.llm import op04_sharding as op4
from siltmill.llm import op05_pii as op5
from siltmill.llm import op06_simhash as op6
from siltmill.llm import op07_decontamination as op7
from siltmill.llm import op08_token_counts as op8
from siltmill.llm import op09_language_id as op9
from siltmill.llm import op10_media as op10
from siltmill.llm import queries
from siltmill.llm.tokens import coder, default_tokenizer

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, fp string, digest string, spans int, bucket int, `a.b` int"


def docs(spark, *texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", "s", len(t or ""), "x", "y", "z", 1, 2, 3) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def texts(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def odd(spark):
    """Null and empty texts, null ids, repeated rows, a very long text, clashing names."""
    long = " ".join(random.Random(1).choice(["alpha", "beta", "gamma", "delta"]) + str(i % 97) for i in range(30_000))
    return docs(spark, None, "", None, "same text here for all", "same text here for all", long, "é ü 数据 😀", "   \n\t ", ids=[None, 1, 2, 3, 3, 5, None, 7])


def brute_repeats(texts, length):
    raws = [(t or "").encode() for t in texts]
    n = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if n[r[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        kept = bytes(np.frombuffer(r, np.uint8)[~gone])
        out.append((len(r), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def test_op1_against_brute_force(spark, texts):
    got = {r.doc_id: tuple(r)[1:] for r in queries.op1_suffix_dedup(spark, SMALL).collect()}
    assert got == dict(zip([d for d, _ in texts], brute_repeats([t for _, t in texts], 400)))


def test_op1_overlaps_periods_and_odd_rows(spark, odd):
    r = random.Random(5)
    noise = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    shared, edge = noise(90), noise(64)
    rows = ["x" * 300, noise(40) + shared + noise(70), noise(200) + shared, shared[:64] + noise(30), edge, edge + "q", "z" + edge[:63], None, "", noise(500) * 2, "ab" * 90, "ab" * 33 + "c", "é" * 64]
    got = [tuple(x)[1:] for x in op1.remove_repeats(docs(spark, *rows), 64).orderBy("doc_id").collect()]
    assert got == brute_repeats(rows, 64)
    assert op1.remove_repeats(odd, 64).count() == odd.count()
    assert op1.remove_repeats(odd.limit(0), 64).count() == 0


def common_prefix(a, b):
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_op1_merge_gives_the_common_prefixes_of_all_strings():
    rng = np.random.default_rng(0)
    symbols = rng.integers(1, 4, (120, 30)).astype(np.uint16)
    symbols[60:90, 10:] = symbols[:30, 10:]  # copies but for the left
    symbols[90:] = symbols[30:60]
    for i in range(0, 120, 7):
        symbols[i, : i % 5] = 0
        symbols[i, 30 - i % 4 :] = 0
    shard = rng.integers(0, 5, 120)
    strings = lambda c: [row[c:].tolist() for row in symbols]
    for column, rows, common in op1.merge_transforms(op1.ShardTransforms(np.ascontiguousarray(symbols.T), shard), 30):
        own = [s[: s.index(0)] if 0 in s else s for s in strings(column)]
        expected = [max(common_prefix(own[i], own[j]) for j in range(120) if j != i) for i in rows]
        assert common.tolist() == expected


def test_op1_windows_against_brute_force():
    r = random.Random(8)
    length = 64
    base = "".join(r.choice("ab") for _ in range(300)).encode()
    parts, places = [], []
    for _ in range(200):
        a = r.randint(100, 140)
        left, right = r.randint(0, 30), r.randint(34, 64)
        p = bytearray(base[a - left : a + right + r.randint(0, 20)])
        for _ in range(r.randint(0, 2)):
            p[r.randrange(len(p))] = r.choice(b"abc")
        parts.append(bytes(p)), places.append(left)
    got = op1.repeated_windows(parts, places, [i % 7 for i in range(200)], length)
    seen = Counter((s - q, p[s : s + length]) for p, q in zip(parts, places) for s in range(max(0, len(p) - length + 1)))
    for p, q, spans in zip(parts, places, got):
        expected = [s for s in range(max(0, min(len(p) - length, q) + 1)) if seen[(s - q, p[s : s + length])] > 1]  # a window holds its anchor
        assert [s for a, b in spans for s in range(a, b)] == expected


def test_op1_splits_a_passage_in_many_contexts(spark, monkeypatch):
    r = random.Random(6)
    noise = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passage, tails = noise(90), [noise(40) for _ in range(6)]
    rows = [noise(r.randint(0, 50)) + passage + r.choice(tails) + noise(r.randint(0, 30)) for _ in range(60)] + [noise(30) + passage] * 3 + ["y" * 200 + noise(9) for _ in range(20)]
    d = docs(spark, *rows)
    whole = op1.repeated_spans
    monkeypatch.setattr(op1, "repeated_spans", lambda docs, length: whole(docs, length, bucket_rows=2))
    monkeypatch.setattr(op1, "BLOCK", 70)
    assert [tuple(x)[1:] for x in op1.remove_repeats(d, 64).orderBy("doc_id").collect()] == brute_repeats(rows, 64)


def check_packing(rows, texts):
    tok, by = coder(default_tokenizer()).tok, defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        assert r.length & (r.length - 1) == 0 and r.length <= 2048 and r.offset == 0
    assert len({r.sequence_id for r in rows}) == len(rows)
    for d, t in texts:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(by[d], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)


def test_op2_pieces(spark, texts):
    check_packing(queries.op2_packing(spark, SMALL).collect(), texts)


def test_op2_odd_rows(spark, odd):
    rows = op2.pack_pow2(odd).collect()
    assert sum(r.doc_tokens == 1 for r in rows) == 3 and all(len(r.ids) == 4 * r.length for r in rows)
    assert op2.pack_pow2(odd.limit(0)).count() == 0


def test_op2_buckets_hold_one_length_each(spark, odd, tmp_path):
    packed = op2.pack_pow2(odd)
    op2.write_buckets(packed, f"file://{tmp_path}/buckets")
    back = spark.read.parquet(f"file://{tmp_path}/buckets")
    assert back.count() == packed.count() and all(r.length == 1 << r.bucket for r in back.select("length", "bucket").distinct().collect())
    assert {p.name for p in (tmp_path / "buckets").glob("bucket=*")} == {f"bucket={r.bucket}" for r in packed.select("bucket").distinct().collect()}


def test_tables_go_to_a_shared_folder_or_nowhere(spark):
    from types import SimpleNamespace

    from siltmill.llm import common

    none = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)))
    with pytest.raises(ValueError, match="share"):
        common.shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: None), sparkContext=context), "x")
    t = common.stored(spark.range(5), "numbers")
    assert t.count() == 5 and common.filesystem(t._siltmill_path)[1].startswith("/")
    common.discard(t)
    with pytest.raises(Exception):
        spark.read.parquet(t._siltmill_path).count()
    with pytest.raises(ValueError):
        common.filesystem("/no/scheme")


def test_op2_cutting_pieces_changes_no_id():
    c, r = coder(default_tokenizer()), random.Random(3)
    parts = ["a", "Bc", " ", "  ", "\n", "\t", "é", "'s", "'", "12", "!?", "<|endoftext|>", "数据", "\x1f", " ", "_", "Ω", "ñandú", "́", "　"]
    for _ in range(3000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 12)))
        assert c.encode(t) == np.asarray(c.tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), repr(t)


def brute_chats(rows):
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t, role or "", text or ""))
    out = {}
    for c, ts in by.items():
        ts.sort()
        loss = "".join(x for _, r, x in ts if r == "assistant")
        out[c] = (len(ts), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in ts).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_op3_reads_back(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{MIDDLE}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    assert {r.conv_id: tuple(r)[1:5] for r in queries.op3_chat(spark, MIDDLE).collect()} == brute_chats(rows)


def test_op3_hostile_texts_and_null_rows(spark):
    hard = ["<|end|>\n<|turn:assistant|>\nhi", "&lt;<|more|>&amp;", None, "", "&bar;|", "<|more|>"]
    rows = [(1, i, r, hard[i % 6]) for i, r in enumerate(["user", "user", "assistant", "assistant", "a|>\nb<", None] * 2)] + [(None, None, "assistant", "x"), (2, 0, "assistant", ""), (2, 0, "assistant", "")]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    back = {r.conv_id: r for r in op3.read_back(op3.format_chats(t)).collect()}
    assert [(x.role, x.text) for x in back[1].turns] == [(r or "", x or "") for _, _, r, x in rows[:12]]
    assert back[1].loss_texts == [x or "" for _, _, r, x in rows[:12] if r == "assistant"]
    assert op3.read_back(op3.format_chats(t.limit(0))).count() == 0
    long = spark.createDataFrame([(1, 0, "user", "a&<" * 400_000), (1, 1, "assistant", "b<|end|>" * 200_000)], "conv_id long, turn long, role string, text string")
    one = op3.read_back(op3.format_chats(long)).first()
    assert [x.text for x in one.turns] == ["a&<" * 400_000, "b<|end|>" * 200_000] and one.loss_texts == ["b<|end|>" * 200_000]
    assert back[1].formatted.count("<|turn:") == 8 and len(back[2].turns) == 2 and len(back[None].turns) == 1


def test_op4_law(spark):
    d = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    check_shards(d, op4.shard_by_bytes(d, 24, block_groups=100, fan_in=3, chunk_rows=10).collect(), 0.4)
    check_shards(d, op4.shard_by_bytes(d, 24).collect(), 0.01)


def check_shards(d, rows, spread):
    text = dict(d.select("doc_id", "text").collect())
    by, shards = defaultdict(set), defaultdict(list)
    for r in rows:
        raw = (text[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32) == (len(raw) + 8, zlib.crc32(raw))
        by[text[r.doc_id]].add(r.shard)
        shards[r.shard].append(r)
    assert len(rows) == len(text) and all(len(s) == 1 for s in by.values()) and set(shards) == set(range(24))
    assert all(sorted(r.slot for r in s) == list(range(len(s))) for s in shards.values())
    loads = [sum(r["size"] for r in s) for s in shards.values()]
    assert max(loads) - min(loads) < spread * max(loads)


def test_op4_odd_rows(spark, odd):
    rows = op4.shard_by_bytes(odd, 3).collect()
    assert len(rows) == odd.count() and op4.shard_by_bytes(odd.limit(0), 3).count() == 0
    assert len({r.shard for r in rows if r.text_crc32 == zlib.crc32(b"same text here for all")}) == 1


def test_op5_surrogates(spark):
    text = 'Mr. John Smith (john.smith@mail.example.com, +1 (017) 555-7713, 10.1.2.254) met Mrs. Anna Smith. Smith paid 4417 7442 8035 1547.\ntoken = "04dbebab91ab85687d33eeaaf9ac699e1188f962" Frau Müller DE89370400440532013000 987-65-4321'
    d = docs(spark, text, None, "", "Nothing here, version 2.0 of 3 parts", "J: JOHN.SMITH@mail.example.com +10175557713", "Господин Иванов")
    r = {x.doc_id: x for x in op5.pseudonymize(d, b"k").collect()}
    new = r[0].text
    for secret in ("John", "Smith", "john.smith", "555-7713", "10.1.2.254", "Anna", "4417 7442", "04dbebab", "Müller", "DE8937040044", "987-65-4321"):
        assert secret not in new
    assert r[1].text is None and r[2].text == "" and r[3].text == d.where("doc_id = 3").first().text and r[3].n_entities == 0
    assert [(s.kind) for s in r[0].spans].count("surname") == 4
    mail = new[new.index("(") + 1 : new.index(",")]
    assert r[4].text.split()[1].lower() == mail.lower() and r[4].text.split()[1].split("@")[0].isupper()
    digits = lambda s: "".join(c for c in s if c.isdigit())
    assert digits(r[4].text.split("com ")[1]) in digits(new)
    assert any("а" <= c <= "я" for c in r[5].text.split()[1])
    surnames = {new[new.index("Mr. ") :].split()[2].strip("(.,"), new.split("Mrs. ")[1].split()[1].strip(".")}
    assert len(surnames) == 1


def test_op5_permutation_and_redraws(spark):
    assert len({op5.encipher(b"k", "", f"{i:03d}") for i in range(1000)}) == 1000
    assert all(op5.luhn(op5.surrogate(b"k", "card", c)) == op5.luhn(c) for c in ("4417744280351547", "9807915762804490", "4111111111111111"))
    names = spark.createDataFrame([("given-f", f"n{i}") for i in range(3000)], "kind string, norm string")
    again = {(r.kind, r.norm): r.attempt for r in op5.redraws(names, b"k").collect()}
    made = [op5.surrogate(b"k", "given-f", f"n{i}", again.get(("given-f", f"n{i}"), 0)) for i in range(3000)]
    assert again and len(set(made)) == 3000
    d = docs(spark, *[f"Mrs. N{c}{e} Quux" for c in "abcdefghijklmnopqrstuvwxyz" for e in ("la", "lo")])
    assert len({r.text.split()[1] for r in op5.pseudonymize(d, b"k").collect()}) == 52


def brute_components(fps, ids):
    kinds = sorted(set(fps))
    a = np.array(kinds, np.uint64)
    label = np.arange(len(a))
    i, j = np.nonzero(op6.distances(a, a) <= 2)
    op6.unite(label, i, j)
    while (label[label] != label).any():
        label = label[label]
    root = dict(zip(kinds, label))
    least = {}
    for f, d in zip(fps, ids):
        if d is not None:
            least[root[f]] = min(d, least.get(root[f], d))
    return [least.get(root[f]) for f in fps]


def brute_fingerprint(t):
    import re

    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


@pytest.mark.parametrize("leaf", [16_384, 40])
def test_op6_against_brute_force(spark, leaf):
    d = spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "text")
    text = d.collect()
    got = {r.doc_id: r for r in op6.near_duplicates(d, 3, 2, leaf_size=leaf).collect()}
    fps = [int(got[r.doc_id].fingerprint, 16) for r in text]
    assert [got[r.doc_id].component_id for r in text] == brute_components(fps, [r.doc_id for r in text])
    assert all(brute_fingerprint(r.text) == f for r, f in list(zip(text, fps))[:60])


def test_op6_tree_loses_no_pair():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    near = base[:800] ^ (np.uint64(1) << rng.integers(0, 64, 800).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 800).astype(np.uint64))
    fps = np.unique(np.concatenate([base, near]))
    nodes = op6.build_tree(fps[:500], 4, 2)
    leaf, idx, home = op6.route(fps, nodes, 2)
    assert sorted(idx[home]) == list(range(len(fps))) and len(set(leaf)) > 8
    found = set()
    for n in set(leaf):
        at, lives = idx[leaf == n], home[leaf == n]
        both = np.concatenate([at[lives], at[~lives]])
        for a, b in op6.near_pairs(fps[at[lives]], fps[at[~lives]], 2, rng):
            found |= {(min(x, y), max(x, y)) for x, y in zip(both[a].tolist(), both[b].tolist()) if x != y}
    i, j = np.nonzero(op6.distances(fps, fps) <= 2)
    assert found == {(x, y) for x, y in zip(i.tolist(), j.tolist()) if x < y}


def test_op6_leaves_that_do_not_shrink_are_searched_in_blocks(spark):
    """All pairs at one distance: no vantage point can split such a leaf evenly."""
    fps = [1 << b for b in range(62)] + [3 << b for b in range(61)] + [(1 << 62) | x for x in range(200)]
    df = spark.createDataFrame([(x,) for x in sorted(set(fps))], "fp long")
    got = {r.node: r.root for r in op6.link_fingerprints(df, 2, leaf_size=8, sample=16).collect()}
    kinds = sorted(set(fps))
    expected = dict(zip(kinds, brute_components(kinds, kinds)))
    assert got == {k: v for k, v in expected.items() if k != v}


def test_op6_takes_samples_without_sending_a_leaf_to_one_task(spark):
    n = 60_000
    rows = spark.range(n).select(F.lit(1).cast("long").alias("leaf"), F.xxhash64("id").alias("fp"), F.lit(True).alias("home"))
    leaves = spark.createDataFrame([(1, n, n)], "leaf long, n long, homes long")
    taken = op6._sampled(rows, leaves, 4096)
    plan = taken._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan and abs(taken.count() - 4096) < 400
    assert op6._sampled(rows.limit(50), spark.createDataFrame([(1, 50, 50)], "leaf long, n long, homes long"), 4096).count() == 50


def test_op6_components_of_a_long_chain(spark):
    e = spark.range(1, 200).select(F.col("id").alias("u"), (F.col("id") - 1).alias("v"))
    assert {r.root for r in op6.components(e).collect()} == {0}


def test_op6_odd_rows(spark, odd):
    rows = op6.near_duplicates(odd).collect()
    assert len(rows) == odd.count() and {r.component_id for r in rows if r.fingerprint == "0" * 16} == {1}
    kept = op6.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == 4 and op6.keep_one(odd.limit(0)).count() == 0


def oracle(sql, sf, *tables):
    c = duckdb.connect()
    for t in tables:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return sorted(c.execute(sql).fetchall(), key=str)


@pytest.mark.parametrize("name,table", [("op3_chat", "conversations"), ("op7_decontamination", "benchmark")])
def test_oracle_sql(spark, name, table):
    got = sorted((tuple(r) for r in queries.QUERIES[name](spark, MIDDLE).collect()), key=str)
    assert got == oracle(queries.ORACLE_SQL[name], MIDDLE, "documents", table)


def test_op7_edges(spark, odd):
    item = "one two three four five six seven eight nine ten eleven twelve"
    items = spark.createDataFrame([(1, item), (2, "short item"), (3, ""), (4, None), (1, item)], "item_id long, text string").withColumn("m", F.lit(9))
    broken = item.replace("twelve", "dozen") + " and more words"
    d = docs(spark, "x " + item.upper() + "! y", broken, "short item", "a short item", item.replace("six", "6"), None, "")
    got = {(r.doc_id, r.item_id) for r in op7.contaminated(d, items).collect()}
    assert got == {(0, 1), (1, 1), (2, 2)}
    assert sorted(r.doc_id for r in op7.decontaminate(d, items).collect()) == [3, 4, 5, 6]
    assert op7.decontaminate(d, items).columns == d.columns
    assert op7.contaminated(odd, items.limit(0)).count() == 0 and op7.contaminated(odd.limit(0), items).count() == 0


def test_op8_counts_and_cache(spark, texts, odd, tmp_path):
    tok = coder(default_tokenizer()).tok
    got = {r.doc_id: tuple(r)[1:] for r in queries.op8_token_counts(spark, SMALL).collect()}
    assert got == {d: (len(t.encode()), n := len(tok.encode(t, add_special_tokens=False).ids), n > 512) for d, t in texts}
    cache = str(tmp_path / "cache")
    first = sorted(map(str, op8.token_counts(odd, cache).collect()))
    n = op8.read_cache(spark, cache).count()
    assert n == odd.select(F.coalesce("text", F.lit(""))).distinct().count() and len(first) == odd.count()
    assert sorted(map(str, op8.token_counts(odd, cache).collect())) == first and op8.read_cache(spark, cache).count() == n
    assert op8.token_counts(odd.limit(0)).count() == 0


def test_op8_sentencepiece_and_versions(spark, odd, tmp_path):
    import public_tokenizers
    import sentencepiece

    path = next(str(p) for p in __import__("pathlib").Path(public_tokenizers.path("byte_bpe_50k.json")).parent.glob("*.model"))
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    cache = str(tmp_path / "cache")
    texts = {r.doc_id: r.text or "" for r in odd.where("doc_id is not null").collect()}
    got = {r.doc_id: r.n_tokens for r in op8.token_counts(odd, cache, path).where("doc_id is not null").collect()}
    assert got == {d: len(model.encode(t)) for d, t in texts.items()}
    op8.token_counts(odd, cache).count()
    assert {len(op8.read_cache(spark, cache, op8.tokenizer_version(p)).collect()) for p in (path, default_tokenizer())} == {5}
    assert op8.tokenizer_version(path) != op8.tokenizer_version(default_tokenizer())


def test_op9_held_out_accuracy(spark):
    d = dict(spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "lang").collect())
    rows = queries.op9_language_id(spark, MIDDLE).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(d) and sum(d[r.doc_id] == r.lang_pred for r in held) / len(held) > 0.95


def naive_bundle(space, text):
    letters = [ord(c) if c.isalpha() else 0 for c in f" {text.lower()} "]
    letters = [c for i, c in enumerate(letters) if c or i == 0 or letters[i - 1]]
    v = np.zeros(space.dims)
    for a, b, c in zip(letters, letters[1:], letters[2:]):
        v += np.roll(space.vector(a), 2) * np.roll(space.vector(b), 1) * space.vector(c).astype(int)
    return v


def test_op9_against_brute_force(spark):
    space = op9.Space(dims=128)
    texts = ["Ein größer Weg", "où est l'été", "数据 和 语言 text", "Привет мир", "", "1 2 3", "a", "x" * 50 + "  yz"]
    got, has = space.bundle(texts, space.letters())
    assert [g.tolist() for g in got] == [naive_bundle(space, t).tolist() for t in texts] and has.tolist() == [any(c.isalpha() for c in t) for t in texts]
    rows = [("der die das und nicht", "de"), ("le la les et pas", "fr"), ("der die das und nicht", "de"), ("привет мир", "ru"), (None, "de"), ("x", None)]
    d = spark.createDataFrame(rows, "text string, lang string")
    p = op9.train(d, space=space)
    unit = lambda t: naive_bundle(space, t) / np.linalg.norm(naive_bundle(space, t))
    assert p.langs == ("de", "fr", "ru") and all(np.allclose(p.prototypes[i], unit(t), atol=1e-5) for i, t in enumerate(["der die das und nicht", "le la les et pas", "привет мир"]))
    asked = spark.createDataFrame([("nicht das",), ("pas les",), ("мир",)], "text string")
    for r in op9.identify(asked, p).collect():
        cos = {lang: float(unit(r.text) @ p.prototypes[i]) for i, lang in enumerate(p.langs)}
        assert r.lang_pred == max(cos, key=cos.get) and abs(r.score - max(cos.values())) < 1e-5


def test_op9_odd_rows(spark, odd):
    p = op9.train(odd)
    got = [(r.text, r.lang_pred, r.score) for r in op9.identify(odd, p).collect()]
    assert len(got) == odd.count() and all((lang == "und") == (not any(c.isalpha() for c in t or "")) for t, lang, _ in got)
    assert {r.lang_pred for r in op9.identify(odd, op9.train(odd.limit(0))).collect()} == {"und"}
    assert op9.accepted(odd, p).columns == odd.columns and op9.identify(odd.limit(0), p).count() == 0


def test_op10_form_is_read_by_others(spark):
    import struct

    payload = op10.padded("é ü 数据 text".encode() * 40)
    png = op10.to_png(payload)
    assert png[:8] == bytes([137, 80, 78, 71, 13, 10, 26, 10]) and png[12:16] == b"IHDR" and struct.unpack(">II", png[16:24]) == (64, len(payload) // 192)
    at = png.index(b"IDAT")
    size = struct.unpack(">I", png[at - 4 : at])[0]
    lines = zlib.decompress(png[at + 4 : at + 4 + size])
    assert b"".join(lines[k + 1 : k + 193] for k in range(0, len(lines), 193)) == payload
    x = np.frombuffer(payload, np.uint8).astype(float)
    step = sum(abs(a - b) for a, b in zip(x[1:], x)) / (len(x) - 1)
    assert op10.feature(payload) == f"mean={x.mean():.4f};std={np.sqrt(((x - x.mean()) ** 2).mean()):.4f};step={step:.4f}"


def test_op10_round_trip(spark, texts, odd):
    got = {r.doc_id: r for r in queries.op10_media(spark, SMALL).collect()}
    for d, t in texts:
        p = op10.padded(t.encode())
        png = op10.to_png(p)
        r = got[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(t.encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(png), hashlib.sha256(png).hexdigest(), op10.feature(p)) and op10.png_samples(png) == p
        assert (r.width, r.height) == (64, len(p) // 192)
    assert op10.media_columns(odd).count() == odd.count() and op10.media_columns(odd.limit(0)).count() == 0


def test_op10_shards_are_tar_files(spark, odd, tmp_path):
    import tarfile

    manifest, folder = op10.store_texts(odd, f"file://{tmp_path}/media")
    rows = manifest.collect()
    for r in rows:
        with tarfile.open(f"{tmp_path}/media/shards/{r.shard}") as tar:
            body = tar.extractfile(f"{r.digest}.png").read()
        assert len(body) == r.length and hashlib.sha256(op10.png_samples(body)).hexdigest() == r.digest


def test_pipeline_keeps_clean_rows(spark):
    import corpus_pipeline as P

    d = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    one = P.language_stage(spark, d, MIDDLE)
    assert one.columns == d.columns and one.count() >= 0.99 * d.count()
    two = P.near_duplicate_stage(spark, one, MIDDLE)
    assert two.columns == d.columns and two.count() < one.count()  # what stays is tested in test_whole_jobs.py
    three = P.decontamination_stage(spark, two, MIDDLE)
    bad = {r.doc_id for r in op7.contaminated(two, spark.read.parquet(f"{MIDDLE}/benchmark.parquet")).collect()}
    assert bad and three.count() == two.count() - len(bad)
    four = P.pii_stage(spark, three, MIDDLE)
    assert four.dtypes == d.dtypes and four.count() == three.count()
    texts4 = [(r.doc_id, r.text) for r in four.collect()]
    old = dict(d.select("doc_id", "text").collect())
    assert all(len(new) > 0 and all(op5.normal(k, old[i][a:z]) not in {op5.normal(k2, new[b:y]) for b, y, k2 in op5.detect(new)} for a, z, k in op5.detect(old[i])) for i, new in texts4)
    check_packing(P.packing_stage(spark, four, MIDDLE).collect(), texts4)
    for f in (P.language_stage, P.near_duplicate_stage, P.decontamination_stage, P.pii_stage, P.packing_stage):
        assert f(spark, d.limit(0), MIDDLE).count() == 0
