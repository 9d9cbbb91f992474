"""Periodic runs, spelling variants and best-fit packing against brute force, and tables with odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from siltmill.llm import op11_periodic_runs as op11
from siltmill.llm import op12_spelling_variants as op12
from siltmill.llm import op13_bestfit_packing as op13
from siltmill.llm import queries
from siltmill.llm.tokens import default_tokenizer

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, word string, n int, runs string, length int, part int, place int, `a.b` int, ids string, piece int"


def docs(spark, *rows):
    return spark.createDataFrame([(i, t, "en", "w", 7, "r", 1, 2, 3, 4, "x", 5) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def texts(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(random.Random(1).choice(["alpha", "gamma"]) + str(i % 97) for i in range(30_000))
    return [(None, None), (1, ""), (2, None), (3, "tick tock " * 9), (3, "tick tock " * 9), (5, long), (None, "é ü 数据 😀 " * 6), (7, "  \n\t "), (8, "one\x0btwo\x0cthree")]


def plainly(w, least=12):
    """Every maximal run, each period tried at each place."""
    seen = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i < len(w) - p:
            j = i
            while j < len(w) - p and w[j] == w[j + p]:
                j += 1
            if j > i:
                s, e = i, j + p
                if e - s >= max(least, 2 * p) and not any(w[s : e - d] == w[s + d : e] for d in range(1, p)):
                    seen[s, e] = p
            i = max(j, i + 1)
    return sorted(((s, e - s, p) for (s, e), p in seen.items()), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("short", [True, False])
def test_op11_runs_against_brute_force(monkeypatch, short):
    if not short:
        monkeypatch.setattr(op11, "_SHORT", 0)
    rng = random.Random(5)
    for _ in range(600):
        n = rng.randint(0, 90)
        w = [rng.randrange(rng.choice([1, 2, 3, 8])) for _ in range(n)]
        for _ in range(rng.randint(0, 4)):
            if n > 3:
                s, p = rng.randrange(n), rng.randint(1, max(1, n // 4))
                for i in range(s + p, min(n, s + rng.randint(1, n))):
                    w[i] = w[i - p]
        assert op11.find_runs(np.array(w, np.int32)) == plainly(w), w


def test_op11_long_texts_with_one_word_and_nested_runs():
    assert op11.find_runs(np.zeros(50_000, np.int32)) == [(0, 50_000, 1)]
    nested = np.tile(np.r_[np.zeros(50, np.int32), [1]].astype(np.int32), 60)
    runs = op11.find_runs(nested)
    assert (0, len(nested), 51) in runs and len(runs) == 61


def expected_runs(doc, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc is not None and n and (h := zlib.crc32(str(doc).encode())) % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plainly(words) if n < 3000 else op11.find_runs(op11.word_ids(words))
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], digest("".join(f"{s},{length},{q}\n" for s, length, q in runs)), digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r))


def test_op11_query(spark, texts):
    got = queries.QUERIES["op11_periodic_runs"](spark, SMALL)
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert ordered(tuple(r) for r in got.select(*names).collect()) == ordered(expected_runs(*t) for t in texts)


def test_op11_odd_rows(spark, odd):
    planted = queries.planted_period(docs(spark, *odd, *((i, "a b c d e f g h i j k l m") for i in range(20, 60))))
    for doc, text in planted.collect():
        if doc and doc >= 20:
            want = expected_runs(doc, "a b c d e f g h i j k l m")
            words = text.split()
            left = op11.kept_words(words, op11.find_runs(op11.word_ids(words)))
            assert hashlib.sha256(" ".join(left).encode()).hexdigest() == want[-1]
    got = op11.periodic_runs(docs(spark, *odd)).collect()
    want = []
    for doc, text in odd:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        want.append((doc, len(words), len(op11.find_runs(op11.word_ids(words)))))
    assert ordered((r.doc_id, r.n_words, len(r.runs)) for r in got) == ordered(want)
    tick = [r for r in got if r.doc_id == 3]
    assert [tuple(x) for r in tick for x in r.runs] == [(0, 18, 2)] * 2 and {r.collapsed for r in tick} == {"tick tock"}
    assert op11.periodic_runs(docs(spark, (1, "x")).limit(0)).count() == 0


def expected_variants(rows, dropping=199, least=5):
    small = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(small)
            h = zlib.crc32(f"{doc}:{run}".encode())
            if doc is not None and dropping and h % dropping == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if c >= least and len(w) >= 6}
    by_hole = defaultdict(set)
    for w in n:
        for i in range(len(w)):
            by_hole[w[:i] + "*" + w[i + 1 :]].add(w)
    near = {w: set() for w in n}
    for w in n:
        for i in range(len(w)):
            near[w] |= by_hole[w[:i] + "*" + w[i + 1 :]] - {w}
            if (shorter := w[:i] + w[i + 1 :]) in n:
                near[w].add(shorter)
                near[shorter].add(w)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root))
    return sorted(out, key=lambda r: r[0])


VARIANTS = ["word", "n", "n_near", "form", "form_n", "root"]


@pytest.mark.parametrize("dropping", [199, 7])
def test_op12_against_brute_force(spark, texts, dropping):
    if dropping == 199:
        got = queries.QUERIES["op12_spelling_variants"](spark, SMALL)
    else:
        got = op12.spelling_variants(op12.word_counts(docs(spark, *texts), dropping=dropping))
    got = sorted(tuple(r) for r in got.select(*VARIANTS).collect())
    assert got == expected_variants(texts, dropping) and any(r[3] for r in got)


def test_op12_odd_rows_chains_and_anagrams(spark, odd, monkeypatch):
    monkeypatch.setattr(op12, "_HELD", 3)
    rows = [(1, "abcdef " * 625 + "abcdeg " * 125), (2, "abcdhg " * 25 + "abkdhg " * 5), (3, "fedcba Listen SILENT enlist " * 6), (4, "Éclairs éclairs eclairs " * 5), (5, "x" * 3000 + " " + ("x" * 2999 + " ") * 5), (6, ("x" * 3000 + " ") * 4), *odd]
    got = sorted(tuple(r) for r in op12.spelling_variants(op12.word_counts(docs(spark, *rows))).select(*VARIANTS).collect())
    assert got == expected_variants(rows, None)
    named = {r[0]: r for r in got}
    assert named["abkdhg"][5] == "abcdef" and named["listen"][2] == 0 and named["éclairs"][2] == 2  # É stays, so it is another letter
    assert named["x" * 3000][2] == 1
    assert op12.spelling_variants(op12.word_counts(docs(spark, (1, "x")).limit(0))).count() == 0


def test_op12_joins_few_pairs_that_are_not_near(spark):
    """All words over two letters have few keys: groups are split by halves, and every near pair is found."""
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("ab") for _ in range(12)) for _ in range(600)})
    table = spark.createDataFrame([(w, 9) for w in words], "word string, n long")
    got = {tuple(sorted((r.a, r.b))) for r in op12.near_words(table).collect()}
    have = set(words)
    want = {tuple(sorted((w, x))) for w in words for i in range(12) if (x := w[:i] + ("a" if w[i] == "b" else "b") + w[i + 1 :]) in have}
    assert got == want and op12.near_words(table).count() == len(want)


def counted(kinds):
    used = Counter()
    for kind, n in kinds:
        for a in kind:
            used[a] += n
    return used


@pytest.mark.parametrize("low, high, n, least", [(1, 1025, 20_000, 0.99), (1, 400, 20_000, 0.999), (300, 700, 20_000, 0.98), (1, 30, 50, 0.3), (1024, 1025, 9, 1), (340, 345, 999, 0.98)])
def test_op13_plan(low, high, n, least):
    counts = np.bincount(np.random.default_rng(n).integers(low, high, n), minlength=1025)
    kinds = op13.plan(counts)
    assert all(sum(k) <= 1024 and x > 0 for k, x in kinds)
    assert counted(kinds) == Counter({i: int(c) for i, c in enumerate(counts) if c})
    total, halves = int((counts * np.arange(1025)).sum()), int(counts[513:].sum())
    thirds = -(-int(counts[342:513].sum()) // 2) if low > 341 else 0
    bound = max(-(-total // 1024), halves, thirds, 402 if (low, high) == (340, 345) else 0)
    assert op13.sequences(kinds) <= bound / least


def test_op13_takes_exact_pairs_and_triples():
    counts = np.zeros(101, np.int64)
    for a, n in {70: 4, 30: 1, 20: 2, 10: 4, 5: 2}.items():
        counts[a] = n
    assert op13.sequences(op13.plan(counts)) == 4
    left = op13.Complements(counts)
    assert left.filling((70,), 30) == (70, 30) and left.filling((70, 30), 25) == (70, 30, 20, 5)
    assert left.filling((70,), 35) == (70, 30, 5) and left.filling((70, 30), 30) == (70, 30, 20, 10)
    assert left.filling((), 40) == (30, 10) and left.filling((30,), 45) == (30, 20, 20, 5) and left.filling((), 3) is None


def check_packing(rows, texts, size, end):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(default_tokenizer())
    left = Counter()
    for doc, text in texts:
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, end], "<u4")
        cuts = [0, *range(len(ids) % size or size, len(ids) + 1, size)] if len(ids) > size else [0, len(ids)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            left[doc, piece, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert left == Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    assert sorted(by) == list(range(len(by)))
    return len(by), -(-sum(r.length for r in rows) // size)


def test_op13_query(spark, texts):
    rows = queries.QUERIES["op13_bestfit_packing"](spark, SMALL).collect()
    n, bound = check_packing(rows, texts, 1024, 2)
    assert n <= bound * 1.01


def test_op13_odd_rows_and_shuffled_numbering(spark, odd, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(op13, "BROADCAST_ROWS", 0)
    table = docs(spark, *odd).repartition(5)
    rows = op13.pack_best_fit(table, 64, 2).withColumn("ids_crc32", F.crc32("ids")).collect()
    n, bound = check_packing(rows, odd, 64, 2)
    assert n <= bound + 2
    assert op13.pack_best_fit(table.limit(0)).count() == 0
