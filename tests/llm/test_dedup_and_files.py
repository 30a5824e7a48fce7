"""Near-duplicates, WARC, mixing, fingerprints, decontamination and the pipeline against brute force."""

import glob
import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from warmgrid.llm import chosenpath, decontaminate, editprint, graph, mixing, warc
from warmgrid.llm.common import table
from warmgrid.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


# -- near-duplicates ------------------------------------------------------------------


def brute_components(rows, percent=85):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        own = frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[k : k + 5]) for k in range(len(w) - 4)])
        if i is not None:
            sets.setdefault(i, []).append(own)
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    flat = [(i, s) for i, many in sets.items() for s in many if s]
    for k, (i, s) in enumerate(flat):
        for j, t in flat[:k]:
            n = len(s & t)
            if n and 100 * n >= percent * (len(s) + len(t) - n):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def near_rows():
    rng = random.Random(3)
    base = [f"w{rng.randrange(500)}" for _ in range(150)]
    rows = []
    for i in range(150):  # near copies, some beyond the threshold
        w = list(base)
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((1000 - i, " ".join(w)))
    rows += [(2000 + i, "the very same text stands here many times") for i in range(40)]
    rows += [(3000 + i, "common passage of some words " * 3 + " ".join(f"u{rng.randrange(10**6)}" for _ in range(60))) for i in range(60)]
    rows += [(1, None), (2, ""), (3, "two words"), (4, "TWO  words"), (5, "three more words"), (5, "the very same text stands here many times"), (None, "two words"), (6, "y " * 20000)]
    return rows


@pytest.mark.parametrize("small", [4096, 16])
def test_near_duplicates_equal_brute_force(spark, small):
    rows = near_rows()
    df = spark.createDataFrame([(i, t, "a") for i, t in rows], "doc_id long, text string, comp string")
    got = chosenpath.near_duplicates(df, small=small).collect()
    want = brute_components(rows)
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got if r["doc_id"] is not None)
    assert [(r["component_id"], r["kept"]) for r in got if r["doc_id"] is None] == [(None, True)]


def test_one_of_each_group_stays(spark):
    rows = near_rows()
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n long")
    kept = chosenpath.keep_one(df)
    want = {i for i, c in brute_components(rows).items() if i == c}
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == df.columns and set(ids) - {None} == want and len(ids) == len(want) + 1
    assert chosenpath.near_duplicates(df.limit(0)).count() == 0


def test_components_and_sift(spark):
    links = [(i, i + 1) for i in range(0, 30)] + [(100, 40 + i) for i in range(30)] + [(7, 7), (200, 201)]
    got = {r["id"]: r["comp"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, **{40 + i: 40 for i in range(30)}, 100: 40, 200: 200, 201: 200}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
    df = spark.range(10000).withColumnRenamed("id", "h")
    kept = {r["h"] for r in graph.sift(df, "h", df.where("h % 100 = 0")).collect()}
    assert set(range(0, 10000, 100)) <= kept and len(kept) < 200


# -- WARC ------------------------------------------------------------------------------


def pages(spark):
    big = "<p>" + "same page " * 40
    rows = [(i, f"http://h/{i}", big) for i in range(20, 60)] + [(1, None, "short"), (2, "http://a b\r\nc", "short"), (3, "u", None), (70, "u", "é" * 70), (71, "u", "é" * 70), (None, "n", big), (90, "d", "twice " * 30), (90, "d", "twice " * 30), (91, "z", "z" * 300000)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string")


def test_archive_round_trip(spark, tmp_path):
    rows, df = pages(spark)
    folders = [str(tmp_path / x) for x in ("a", "b")]
    warc.write_archive(df, folders[0], roll_bytes=2000, shard_bytes=40000)
    warc.write_archive(df.repartition(5, "url"), folders[1], roll_bytes=2000, shard_bytes=40000)
    files = [{f.split("/")[-1]: hashlib.sha256(open(f, "rb").read()).hexdigest() for f in glob.glob(f"{d}/*.warc.gz")} for d in folders]
    assert files[0] == files[1] and len(files[0]) > 3
    assert not glob.glob(f"{folders[0]}/_temporary*") and not glob.glob(f"{folders[0]}/_manifest*")
    got = warc.read_archive(spark, folders[0]).collect()
    assert len(got) == len(rows) and all(r["intact"] for r in got)
    want = sorted((str(i), len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest()) for i, _, h in rows)
    assert sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"]) for r in got) == want
    to = {(r["page_id"], r["record_type"]): r["refers_to"] for r in got}
    assert {k: v for k, v in to.items() if k[1] == "revisit"} == {**{(i, "revisit"): 20 for i in range(21, 60)}, (71, "revisit"): 70, (None, "revisit"): 20, (90, "revisit"): 90}
    assert (90, "response") in to and sum(r["record_type"] == "response" for r in got) == 7


def test_archive_of_nothing_and_broken_files(spark, tmp_path):
    _, df = pages(spark)
    warc.write_archive(df.limit(0), str(tmp_path / "none"))
    assert warc.read_archive(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(ValueError):
        list(warc.members(warc.page_record(1, "u", b"x" * 500, "00", None)[:-5]))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_match_their_sql(spark, name):
    from tests.compare import compare, duck

    same, n, m, diff = compare(spark, duck(SF), QUERIES[name], ORACLES[name], SF)
    assert same and n, f"{n} rows against {m}: {diff}"


# -- mixing ------------------------------------------------------------------------------


def filled(sizes, weights=(5, 2, 1), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        share = (total - sum(fixed.values())) / max(sum(w[s] for s in free), 1e-9)
        over = [s for s in free if w[s] * share > cap * sizes[s]]
        if not over:
            return {**fixed, **{s: w[s] * share for s in free}}
        fixed.update({s: cap * sizes[s] for s in over})


def test_mix_meets_targets(spark):
    rng = random.Random(8)
    rows = []
    for s, n in (("big", 3000), ("b", 300), ("", 200), (None, 150), ("é", 100), ("tiny", 30), ("empty", 3)):
        rows += [(len(rows) + k, s, "w " * (0 if s == "empty" else rng.choice([1, 5, 20, 60, 200, 900]))) for k in range(n)]
    rows += [(10**6, "big", None), (10**6 + 1, "big", "same id twice"), (10**6 + 1, "big", "same id twice"), (None, "b", "no id")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.shares(df).collect()
    size = {}
    for _, s, t in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    goal, taken = filled(size), {}
    assert len(got) == len(rows)
    for r in got:
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        assert r["taken"] <= 3 * r["size"] and r["source_size"] == size[r["source"]]
        assert r["target"] == pytest.approx(goal[r["source"]], rel=1e-9)
    for s, g in goal.items():
        assert taken[s] == pytest.approx(g, rel=0.02, abs=2), s
    again = mixing.shares(df.repartition(3)).collect()
    key = lambda r: (str(r["doc_id"]), str(r["source"]), r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    mixed = mixing.apply(df)
    assert mixed.columns == df.columns and mixed.count() == sum(r["copies"] for r in got)
    assert mixing.shares(df.limit(0)).count() == 0


def test_dual_solves_each_source(spark):
    rows = [(i, s, n) for s, sizes in (("s1", [3, 10, 50, 400]), ("s2", [7, 7, 9])) for i, n in enumerate(sizes)]
    sizes = spark.createDataFrame(rows, "doc_id long, source string, size long")
    goals = mixing.targets(sizes)
    lam = {r["skey"]: (r["mean"], r["lam"]) for r in mixing.balance(sizes, goals).collect()}
    for r in goals.collect():
        mean, x = lam[r["skey"]]
        got = sum(n * min(3.0, math.exp(x * n / mean)) for _, s, n in rows if s == r["source"])
        assert got == pytest.approx(r["target"], rel=1e-5)


# -- fingerprints ---------------------------------------------------------------------------


def test_fingerprints_and_next_documents(spark):
    rng = random.Random(2)
    text = lambda n: "".join(rng.choice("abcdefghij klmnop") for _ in range(n))
    rows = [(i * 7 % 101, text(rng.choice([0, 1, 3, 40, 700, 3000]))) for i in range(101)] + [(500, None), (501, "x"), (502, "日本" * 300), (None, "lowest"), (501, "y")]
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, block string")
    got = editprint.compare_with_next(df, blocks=7).collect()
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (-(r[0] if r[0] is not None else -(1 << 63)), r[1]))
    want = []
    for k, (i, t) in enumerate(order):
        changed = editprint.edited(t, order[(k + 1) % len(order)][1])
        want.append((str(i), len(t), hashlib.sha256(changed.encode()).hexdigest()))
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in got) == sorted(want)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    long = [r for r in got if r["n_chars"] >= 700]
    assert min(r["near_edited"] for r in long) > 0.2 and max(r["near_next"] for r in long) < 0.2
    assert editprint.compare_with_next(df.limit(1)).count() == 1 and editprint.compare_with_next(df.limit(0)).count() == 0


def test_walk_in_lanes_equals_walk_alone():
    e = editprint.embedding()
    rng = random.Random(1)
    texts = ["".join(rng.choice("abc dé") for _ in range(n)) for n in [0, 1, 5, 5, 90, 1500, *range(30, 70)]]
    assert e.prints(texts) == [e.prints([t])[0] for t in texts]
    assert e.prints(texts) == [editprint.from_text(editprint.as_text(p)) for p in e.prints(texts)]
    one = e.prints(["q" * 100 + t for t in texts[:3]] + [""])
    assert e.likeness(one[0], one[0]) == 1 and e.likeness(one[0], one[3]) == 0 and e.likeness(one[3], one[3]) == 1


def test_edit_distance_becomes_hamming_distance():
    e = editprint.embedding()
    rng = random.Random(9)
    near, far = [], []
    for _ in range(20):
        t = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(4000))
        u = list(t)
        for _ in range(8):
            p = rng.randrange(len(u))
            u[p : p + rng.randrange(2)] = ["z"] * rng.randrange(2)
        a, b, c = e.prints([t, "".join(u), "".join(rng.sample(t, len(t)))])
        near.append(e.likeness(a, b))
        far.append(e.likeness(a, c))
    assert sum(near) / 20 > 0.6 and max(far) < 0.15


def test_band_search_finds_copies(spark):
    rng = random.Random(4)
    base = "".join(rng.choice("abcdefghijklmnop ") for _ in range(3000))
    rows = [(i, base) for i in range(30)] + [(100, base[:2900] + "tail changed here"), (200, base[::-1])]
    prints = editprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {(r["query_id"], r["rep_id"]) for r in editprint.search(prints.where("doc_id % 20 = 0"), prints, 0.7).collect()}
    assert {(0, 0), (20, 0), (100, 100), (100, 0), (0, 100), (200, 200)} <= got and (200, 0) not in got


# -- decontamination ----------------------------------------------------------------------------


def norm(t):
    return re.sub(r"(?:[^\w]|_)+", " ", (t or "").lower()).strip()


def least_distance(pattern, text):
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        diag, row[0] = row[0], 0
        for i, p in enumerate(pattern, 1):
            diag, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, diag + (p != c))
        best = min(best, row[-1])
    return best


def test_myers_equals_dynamic_programming():
    rng = random.Random(5)
    for _ in range(200):
        p = "".join(rng.choice("abc") for _ in range(rng.randint(1, 90)))
        t = "".join(rng.choice("abc") for _ in range(rng.randint(0, 120)))
        assert decontaminate.Myers(p).distance(t) == least_distance(p, t)


def test_items_within_the_budget_are_found(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    items = [(k, " ".join(word() for _ in range(rng.randint(8, 40))) + ".") for k in range(12)] + [(12, None), (13, "short"), (14, "")]
    docs = [(0, None), (1, ""), (2, items[3][1].upper()), (3, " ".join(word() for _ in range(3000)))]
    for k in range(60):
        t = list(items[k % 12][1])
        for _ in range(rng.randint(0, int(len(t) * 0.12))):
            p = rng.randrange(len(t))
            t[p : p + rng.randrange(2)] = [rng.choice("qz")] * rng.randrange(2)
        docs.append((10 + k, " ".join(word() for _ in range(20)) + " " + "".join(t) + " " + " ".join(word() for _ in range(20))))
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, hits string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {}
    for i, t in docs:
        found = []
        for k, item in items:
            m = norm(item)
            if len(m) >= 24:
                d = least_distance(m, norm(t))
                if d <= int(0.08 * len(m)):
                    found.append((k, d))
        want[i] = found
    for block in (4_000_000, 150):
        got = {r["doc_id"]: [tuple(h) for h in r["hits"]] for r in decontaminate.contaminated(df, bench, block_chars=block).collect()}
        assert got == want
    assert 15 < sum(map(bool, want.values())) < len(docs) - 3
    assert {r["doc_id"] for r in decontaminate.keep_clean(df, bench).collect()} == {i for i, f in want.items() if not f}
    assert decontaminate.contaminated(df, bench.limit(0)).where(F.size("hits") > 0).count() == 0


# -- pipeline ------------------------------------------------------------------------------------


def test_pipeline_stages_keep_columns_and_drop_what_they_should(spark):
    docs = table(spark, SF, "documents")
    clean = [" ".join(f"{w}{k}" for w in ("house", "river", "small", "garden", "walk")) + " and the rest of a plain sentence number " + str(k * 7919) for k in range(12)]
    item = table(spark, SF, "benchmark").first()["text"]
    rows = [(9000 + k, t, "en", "s", len(t)) for k, t in enumerate(clean)] + [(9100, None, "en", "s", 0), (9101, "12 34", "en", "s", 5), (9102, clean[0], "en", "s", 1), (9103, "before it " + item + " after", "en", "s", 1)]
    df = docs.unionAll(spark.createDataFrame(rows, docs.schema))
    assert [s for s, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "mixing"]
    seen = []
    for _, stage in corpus_pipeline.STAGES:
        df = corpus_pipeline.stored(stage(spark, df, SF), "test-stage")
        assert df.columns == docs.columns
        seen.append({r["doc_id"] for r in df.select("doc_id").collect()})
    assert not seen[0] & {9100, 9101} and 9102 not in seen[1] and 9103 in seen[2] and 9103 not in seen[3]
    assert all(9000 + k in seen[3] for k in range(12))
    assert corpus_pipeline.run(spark, SF).columns == docs.columns


def test_pipeline_drops_near_copies_from_80_percent_on(spark):
    assert (chosenpath.trees_for(85), chosenpath.agree_for(85)) == (4, 40) and (chosenpath.trees_for(80), chosenpath.agree_for(80)) == (5, 35)
    rows = []
    for k in range(40):  # two exchanged words of 100: 86 shingles of 106 in common, a similarity of 0.811
        words = [f"w{k}x{i}" for i in range(100)]
        rows.append((2 * k, " ".join(words)))
        words[30 + k % 10] = words[60 + k % 20] = "other"
        rows.append((2 * k + 1, " ".join(words)))
    want = brute_components(rows, 80)
    assert set(want.values()) == set(range(0, 80, 2)) and len(set(brute_components(rows).values())) == 80
    kept = dict(corpus_pipeline.STAGES)["near_dedup"](spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert {r["doc_id"] for r in kept.collect()} == set(want.values())
