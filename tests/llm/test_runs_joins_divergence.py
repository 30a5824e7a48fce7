"""Periodic runs, the prefix-filter join and the source divergence audit against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from warmgrid.llm import divergence, periodic, prefixjoin
from warmgrid.llm.common import table
from warmgrid.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType())])


def as_table(rows, folder, spark, schema=DOCS):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


# -- periodic runs ----------------------------------------------------------------------


def brute_runs(w):
    out = set()
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            n = i + q - s
            if i > s and n >= max(6, 4 * q) and not any(w[s : s + n - d] == w[s + d : s + n] for d in range(1, q)):
                out.add((s, n, q))
            i = max(i, s + 1) if i == s else i
    return sorted(out)


def test_runs_of_random_sequences():
    rng = random.Random(1)
    for _ in range(1500):
        n, kinds = rng.randrange(80), rng.choice([1, 2, 3, 9])
        w = [rng.randrange(kinds) for _ in range(n)]
        if n > 4 and rng.random() < 0.6:
            a = rng.randrange(n)
            p = 1 + rng.randrange(max(1, (n - a) // 3))
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)] + w[: rng.randrange(n)]
        assert periodic.runs_of(np.array(w, np.int32)) == brute_runs(w), w


def test_runs_of_long_sequences():
    assert periodic.runs_of(np.zeros(50_000, np.int32)) == [(0, 50_000, 1)]
    base = np.random.default_rng(0).integers(0, 9000, 9000)
    assert periodic.runs_of(np.tile(base, 4).astype(np.int32)) == [(0, 36_000, 9000)]
    # more kinds than fit a five-word key at once
    many = np.concatenate([np.arange(20_000), np.tile(np.arange(20_000, 20_003), 5)]).astype(np.int32)
    assert periodic.runs_of(many) == [(20_000, 15, 3)]


def expected_runs(doc_id, text):
    w = (text or "").encode().split()
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    sha = lambda b: hashlib.sha256(b).hexdigest()
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha(listed), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_runs_query(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randrange(60))), "en", "s") for i in range(150)]
    rows += [(500 + i, "x  y\tz é " * rng.randrange(1, 9) + "end", "en", "s") for i in range(60)]
    rows += [(900, None, None, None), (901, "", "en", "s"), (902, " \n\t ", "en", "s"), (None, "a a a a a a a", "en", "s"), (0, "a b " * 300, "en", "s"), (0, "a b " * 300, "en", "s"), (903, "  " * 9, "en", "s")]
    got = QUERIES["op11_periodic_runs"](spark, as_table(rows, tmp_path, spark)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(expected_runs(r[0], r[1])) for r in rows)
    real = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").select("doc_id", "text").collect() if len(r["text"]) < 4000]
    got = {r["doc_id"]: tuple(r) for r in QUERIES["op11_periodic_runs"](spark, SF).collect()}
    assert all(got[i] == expected_runs(i, t) for i, t in real) and len(got) == table(spark, SF, "documents").count()


def test_runs_keep_other_columns(spark):
    df = spark.createDataFrame([(1, "a a a a a a b", 7.5, "mine")], "doc_id long, text string, start double, collapsed string")
    row = periodic.periodic_runs(df, runs="found", short="rest").first()
    assert row["start"] == 7.5 and row["collapsed"] == "mine" and row["rest"] == "a b" and [tuple(r) for r in row["found"]] == [(0, 6, 1)]
    assert periodic.periodic_runs(df).first()["collapsed"] == "a b"
    assert periodic.periodic_runs(df.limit(0)).count() == 0


# -- prefix-filter join -------------------------------------------------------------------


def brute_join(rows, percent=90):
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append((i, frozenset([tuple(w)] if 0 < len(w) < 3 else [tuple(w[k : k + 3]) for k in range(len(w) - 2)])))
    up = {i: i for i, _ in sets if i is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    flat = [(i, s) for i, s in sets if s and i is not None]
    for k, (i, s) in enumerate(flat):
        for j, t in flat[:k]:
            n = len(s & t)
            if n and 100 * n >= percent * (len(s) + len(t) - n):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=repr)


def join_rows(seed=3):
    rng = random.Random(seed)
    rows = []
    for g in range(6):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.choice([12, 60, 150]))]
        for i in range(40):  # near copies on both sides of the threshold; the base itself is not always there
            w = list(base)
            for _ in range(rng.randrange(g % 2, 6)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            if rng.random() < 0.3:
                w = w[: len(w) - rng.randrange(max(1, len(w) // 12))]
            rows.append((1000 * g + rng.randrange(900), " ".join(w)))
    rows += [(20000 + i, "the very SAME text stands here many times") for i in range(40)]
    rows += [(30000 + i, "common passage of some words " * 4 + " ".join(f"u{rng.randrange(10**6)}" for _ in range(30))) for i in range(60)]
    rows += [(1, None), (2, ""), (3, "two words"), (4, "TWO  words"), (5, "three more words"), (5, "the very same text stands here many times"), (None, "two words"), (6, "y " * 20000), (7, "y y y"), (8, "Two Words Ä"), (9, "two words ä")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("percent", [90, 75])
def test_prefix_join_equals_brute_force(spark, percent):
    rows = join_rows(percent)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("n", F.lit("mine")).repartition(5)
    got = prefixjoin.jaccard_join(df, percent)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_join(rows, percent)


def test_prefix_join_on_small_tables(spark):
    df = table(spark, SF, "documents")
    assert sorted(map(tuple, prefixjoin.jaccard_join(df).collect()), key=repr) == brute_join([(r["doc_id"], r["text"]) for r in df.collect()])
    empty = prefixjoin.jaccard_join(df.limit(0))
    assert empty.columns == ["doc_id", "n_shingles", "component_id"] and empty.count() == 0


def test_summary_keeps_what_is_common():
    rng = np.random.default_rng(5)
    items, counts, exact = np.zeros(0, np.uint64), np.zeros(0, np.int64), Counter()
    for _ in range(50):
        new = np.concatenate([rng.integers(1000, 1 << 60, 400), rng.integers(0, 10, 100)]).astype(np.uint64)
        exact.update(new.tolist())
        items, counts = prefixjoin.summarise(np.concatenate([items, new]), np.concatenate([counts, np.ones(len(new), np.int64)]), 64)
        assert len(items) <= 64
    total, known = sum(exact.values()), dict(zip(items.tolist(), counts.tolist()))
    assert all(c - total // 65 <= known.get(k, 0) <= c for k, c in exact.items())
    assert set(range(10)) <= set(known)


def test_bins_bound_the_difference():
    rng = np.random.default_rng(9)
    for n in (30, 700, 5000):
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
        b = np.concatenate([a[: n * 9 // 10], rng.integers(0, 1 << 63, n // 4, dtype=np.uint64) * np.uint64(2)])
        x, y = (np.bincount((s >> np.uint64(64 - k)).astype(np.int64), minlength=1 << k).astype(np.uint8) for s, k in ((a, 7), (b, 6)))
        assert 0 < prefixjoin.least_difference(x, y) <= len(np.setxor1d(a, b))
        assert prefixjoin.least_difference(x, x) == 0


def test_a_group_of_copies_costs_its_size(spark):
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**5)}" for _ in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(1, 1500):  # one word differs: all are close to the first, and most not to each other
        w = list(base)
        w[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(w)))
    pairs = []
    before = prefixjoin.verified
    prefixjoin.verified = lambda p, docs, percent: pairs.append(p.count()) or before(p, docs, percent)
    try:
        got = prefixjoin.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"))
        assert {r["component_id"] for r in got.collect()} == {0}
    finally:
        prefixjoin.verified = before
    assert sum(pairs) < 20 * len(rows)


@pytest.mark.parametrize("percent", [90, 75])
def test_rows_that_may_link_share_a_class_of_size(spark, percent):
    rng = random.Random(4)
    rows = [(k, 1000 * k + i, n, rng.randrange(max(1, n // 10))) for k in range(3) for i, n in enumerate([*range(1, 120), *(rng.randrange(100, 5000) for _ in range(60))])]
    df, keep = spark.createDataFrame(rows, "key long, id long, n long, pos long"), prefixjoin.may_link(percent)
    left, right = (df.select(*[F.col(c).alias(f"{side}_{c}") for c in df.columns]) for side in "lr")
    kept = left.join(right, (F.col("l_key") == F.col("r_key")) & (F.col("l_id") < F.col("r_id"))).where(keep(lambda c: F.col(f"l_{c}"), lambda c: F.col(f"r_{c}")))
    lists = defaultdict(set)
    for r in prefixjoin.by_size(df, percent).collect():
        lists[r["key"]].add(r["id"])
    want = {(r["l_id"], r["r_id"]) for r in kept.select("l_id", "r_id").collect()}
    assert want and want <= {(a, b) for ids in lists.values() for a in ids for b in ids}


def test_a_common_shingle_of_many_sizes_is_no_long_list(spark, monkeypatch):
    rng = random.Random(4)
    # the shared shingle has a low hash, so it leads in all texts
    phrase = min((f"a{i} rare passage" for i in range(20000)), key=lambda t: int(prefixjoin.distinct_sets(pa.array([t]))[0][0]))
    rows = [(i, f"{phrase} " + " ".join(f"u{rng.randrange(10**9)}" for _ in range(round(20 * 1.3**i)))) for i in range(20)]
    # as in a corpus too large for its summary to know this shingle
    monkeypatch.setattr(prefixjoin, "common_shingles", lambda docs: (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    held, before = [], prefixjoin.stored
    monkeypatch.setattr(prefixjoin, "stored", lambda df, name: held.append((name, before(df, name))) or held[-1][1])
    got = prefixjoin.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["component_id"] for r in got.collect()) == list(range(20))
    assert len(rows) > prefixjoin.FEW and sum(df.count() for name, df in held if name == "prefix-rows") == 0


def test_rows_in_classes_of_size_grow_with_the_table(spark, monkeypatch):
    rng = random.Random(6)
    phrase = min((f"a{i} rare passage" for i in range(20000)), key=lambda t: int(prefixjoin.distinct_sets(pa.array([t]))[0][0]))
    monkeypatch.setattr(prefixjoin, "common_shingles", lambda docs: (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    dealt, before = [], prefixjoin.by_size
    monkeypatch.setattr(prefixjoin, "by_size", lambda rows, percent: dealt.append(before(rows, percent).count()) or before(rows, percent))
    for n in (10, 50):  # the shared shingle's list is short in the small table, long in the large one
        rows = [(i, f"{phrase} " + " ".join(f"u{rng.randrange(10**9)}" for _ in range(60))) for i in range(n)]
        got = prefixjoin.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"))
        assert sorted(r["component_id"] for r in got.collect()) == list(range(n))
    assert 0 < dealt[1] <= 6 * dealt[0]


# -- source divergence ----------------------------------------------------------------------


def brute_divergence(rows):
    def terms(text):
        out, now = [], ""
        for c in (text or "") + " ":
            if c.isascii() and not c.isalpha():
                if now:
                    out.append(now)
                now = ""
            else:
                now += c.lower() if c.isascii() else c
        return out

    docs = [(lang or "", source or "", terms(text)) for _, text, lang, source in rows]
    groups, in_docs, occurs = {(g, s) for g, s, _ in docs}, defaultdict(Counter), defaultdict(Counter)
    for lang, source, w in docs:
        in_docs[lang].update(set(w))
        occurs[lang, source].update(w)
    out = []

    def price(counts, kept):
        n = sum(counts[t] for t in kept)
        return {t: 1 + 10**9 * (counts[t] + 1) // (n + len(kept)) for t in kept}

    for lang, source in groups:
        kept = [t for t, d in in_docs[lang].items() if d >= 3]
        p = price(occurs[lang, source], kept)
        mine = []
        for g, other in groups:
            if g == lang and other != source:
                q = price(occurs[lang, other], kept)
                mine.append((sum((p[t] - q[t]) ** 2 // q[t] for t in kept), other))
        whole = Counter()
        for g, s in groups:
            if g == lang:
                whole.update(occurs[g, s])
        q = price(whole, kept)
        heavy = [((p[t] - q[t]) ** 2 // q[t], t) for t in kept if occurs[lang, source][t] and p[t] > q[t]]
        for part, found, most in (("pair", mine, None), ("term", heavy, 200)):
            found.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, value, k) for k, (value, item) in enumerate(found[:most], 1)]
    return sorted(out)


def test_divergence_query(spark, tmp_path):
    rng = random.Random(2)
    words = [f"t{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(400)] + ["Été", "ÉTÉ", "naïve", "日本"]
    rows = []
    for i in range(400):
        n = rng.choice([0, 3, 20, 90])
        rows.append((i, " ".join(rng.choice(words[: rng.choice([5, 50, 404])]) + rng.choice(["", ".", "2x", "'s"]) for _ in range(n)), rng.choice(["en", "de", None]), rng.choice([f"s{rng.randrange(9)}", None, "hot"])))
    rows += [(None, None, "fr", "a"), (1, "", "fr", "b"), (2, "one one one", "fr", "c"), (3, None, None, None), (4, "x " * 30000, "en", "hot"), (4, "x " * 30000, "en", "hot"), (5, "x", "de", ""), (6, "alone", "it", "only")]
    got = QUERIES["op13_source_divergence"](spark, as_table(rows, tmp_path, spark)).collect()
    want = brute_divergence(rows)
    assert sorted(map(tuple, got)) == want
    assert any(r[0] == "fr" and r[4] == 0 for r in want)


def test_divergence_on_small_tables_and_none(spark):
    df = table(spark, SF, "documents").select("doc_id", "text", "lang", "source")
    assert sorted(map(tuple, divergence.divergence(df.withColumn("term", F.lit("mine")).withColumn("n", F.lit(5))).collect())) == brute_divergence([tuple(r) for r in df.collect()])
    assert divergence.divergence(df.limit(0)).collect() == []


def test_blocks_of_levels_and_groups(monkeypatch):
    rng = np.random.default_rng(1)
    counts = rng.poisson(2, (700, 9)) * rng.choice([0, 1, 1, 5000], (700, 9))
    prices = [divergence.level_prices(int(c.sum()), 700) for c in counts.T]
    plain = np.zeros((9, 9), object)
    for row in counts:
        p = [int(f(row[[g]])[0]) for g, f in enumerate(prices)]
        plain += np.array([[(a - b) ** 2 // b for b in p] for a in p], object)
    for terms, groups, columns in ((4096, 64, 1024), (100, 4, 32), (7, 2, 4)):
        monkeypatch.setattr(divergence, "TERMS", terms)
        monkeypatch.setattr(divergence, "GROUPS", groups)
        monkeypatch.setattr(divergence, "COLUMNS", columns)
        assert (divergence.joint_distances(counts, prices) == plain).all()
    # counts whose price does not fit 64 bits on the way
    assert divergence.level_prices(10**15, 10)(np.array([10**14]))[0] == 1 + 10**9 * (10**14 + 1) // (10**15 + 10)
