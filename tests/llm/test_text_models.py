"""Token counts, language ID, quality and the language model against references and held-out rows."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from warmgrid.llm import langid, quality, recurrent, tokencount
from warmgrid.llm.common import bounded, id_remainder, table, utf8, words_of
from warmgrid.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, "\x00 \t\n"), (4, "1234 !!"), (None, "The and of that with"), (6, "x" * 30000), (6, "x" * 30000), (7, "é" * 500 + " 日本語")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en", "clash") for i, t in ODD], "doc_id long, text string, lang string, score string")


def test_words_match_python(spark):
    import pyarrow as pa

    texts = [t or "" for _, t in ODD] + ["a b\x0bc\x0cd\re", " lead", "trail "]
    data, off = utf8(pa.array(texts))
    starts, ends, first = words_of(data, off)
    got = [[bytes(data[s:e]) for s, e in zip(starts[i:j], ends[i:j])] for i, j in zip(first, first[1:])]
    assert got == [t.encode().split() for t in texts]


def test_bounded_keeps_all_rows():
    import pyarrow as pa

    b = pa.RecordBatch.from_arrays([pa.array(["a" * 10, None, "b" * 50, "", "c"])], ["text"])
    parts = list(bounded(iter([b, b.slice(0, 0)]), limit=20))
    assert pa.Table.from_batches(parts).column(0).to_pylist() == b.column(0).to_pylist() and len(parts) == 3


def library_counts(texts):
    m = tokencount.merger(tokencount.public_vocabulary("piece_bpe_32k.model")).model
    return [len(x) for x in m.encode(texts)]


def test_token_counts_equal_the_library(spark):
    m = tokencount.merger(tokencount.public_vocabulary("piece_bpe_32k.model"))
    rng = random.Random(4)
    pieces = [m.model.id_to_piece(i).replace("▁", " ") for i in range(259, 32000)]
    texts = [t or "" for _, t in ODD]
    texts += ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 40))) for _ in range(400)]
    texts += ["".join(rng.choice("aeiounrst the\n  ▁éñ\t\x00日本ab") for _ in range(rng.randint(0, 60))) for _ in range(400)]
    texts += [" " * n + tail for n in (1, 15, 16, 17, 63, 64, 65, 66, 90, 200, 333) for tail in ("", "a", "日", "\n", " .x")]
    texts += ["<s></s> <unk> <0x41>", "aaaa" * 500, "the" * 200]
    assert m.lengths(texts) == library_counts(texts)


def test_token_count_query(spark, odd):
    rows = table(spark, SF, "documents").collect()
    want = dict(zip([r["doc_id"] for r in rows], library_counts([r["text"] or "" for r in rows])))
    got = QUERIES["op4_token_counts"](spark, SF).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == want
    assert all(r["over_limit"] == (r["n_tokens"] > 4096) for r in got)
    out = tokencount.count_tokens(odd).collect()
    assert sorted((r["n_bytes"], r["n_tokens"]) for r in out) == sorted((len((t or "").encode()), n) for (_, t), n in zip(ODD, library_counts([t or "" for _, t in ODD])))
    assert tokencount.count_tokens(odd.limit(0)).count() == 0


def test_language_accuracy_and_odd_rows(spark, odd):
    docs = table(spark, SF, "documents")
    net = langid.fit(docs.where(id_remainder("doc_id", 4) != 2), per_label=100)
    rows = langid.predict(docs.withColumn("held", id_remainder("doc_id", 4) == 2), net).where("held and n_chars > 40").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.9
    out = langid.predict(odd, net).collect()
    assert len(out) == len(ODD) and all(0 <= r["score"] <= 1 for r in out)
    assert {r["doc_id"] for r in out if r["lang_pred"] == "und"} == {1, 2, 3, 4}
    assert langid.keep_identified(odd, net).columns == odd.columns
    assert langid.fit(odd.where("false")) is None
    assert {r["lang_pred"] for r in langid.predict(odd, None).collect()} == {"und"}
    assert langid.predict(odd.limit(0), net).count() == 0


def test_windows_cover_whole_texts():
    data, off = np.arange(256, dtype=np.uint8).repeat(5), np.array([0, 0, 1280])
    grid, doc, n = langid.windows(data, off, 512)
    assert n.sum() == 1280 and set(doc) == {1}
    assert b"".join(bytes(g[:k]) for g, k in zip(grid, n)) == data.tobytes()


def test_pair_tables_equal_direct_convolution():
    rng = np.random.default_rng(0)
    net = langid.ByteConvNet(["a", "b"], rng.normal(size=(256, 4)), {w: rng.normal(size=(w, 4, 3)) for w in langid.WIDTHS}, {w: rng.normal(size=3) for w in langid.WIDTHS}, rng.normal(size=(9, 2)), np.zeros(2))
    grid = rng.integers(0, 256, (5, 40)).astype(np.uint8)
    want = []
    for w in langid.WIDTHS:
        e = net.embed[grid]
        resp = sum(e[:, o : 40 - w + 1 + o] @ net.filters[w][o] for o in range(w)) + net.bias[w]
        want.append(np.maximum(resp.max(axis=1), 0))
    assert np.allclose(langid.pooled(grid, net.tables(), block=2), np.concatenate(want, axis=1), atol=1e-4)


def test_trees_learn_and_flat_traversal_matches_recursion():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 5)).astype(np.float32)
    y = ((x[:, 1] > 0.3) ^ (x[:, 3] > 0)).astype(float)
    trees = quality.grow(x, y, trees=20)
    p = trees.score(x)
    assert np.mean((p > 0.5) == y) > 0.95

    def one(row):
        total = trees.base
        for f, t, leaf in zip(trees.feature, trees.threshold, trees.leaf):
            k = 0
            while k < len(f):
                k = 2 * k + 1 + int(row[f[k]] > t[k])
            total += leaf[k - len(f)]
        return 1 / (1 + math.exp(-total))

    assert np.allclose(p[:50], [one(r) for r in x[:50]])
    assert np.allclose(quality.grow(x[:0], y[:0]).score(x[:3]), 0.5)


def test_quality_statistics_and_query(spark, odd):
    got = {r["doc_id"]: dict(zip(quality.FEATURES, r["stats"])) for r in quality.document_statistics(spark.createDataFrame([(1, "aa bb aa\naa bb aa\nXY"), (2, None)], "doc_id long, text string")).collect()}
    assert got[1]["distinct_words"] == pytest.approx(3 / 7) and got[1]["top_word"] == pytest.approx(4 / 7)
    assert got[1]["log_lines"] == pytest.approx(math.log(4)) and got[1]["distinct_lines"] == pytest.approx(2 / 3)
    assert not any(got[2].values()) or got[2]["distinct_pairs"] == 1
    rows = QUERIES["op6_quality_trees"](spark, "/root/testdata/sf0.01").collect()
    labels = {r["doc_id"]: r["quality"] for r in table(spark, "/root/testdata/sf0.01", "labels").collect()}
    held = [r for r in rows if r["held_out"] and labels.get(r["doc_id"]) is not None]
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in held]) > 0.9
    stats = quality.document_statistics(odd)
    trees = quality.fit(stats, spark.createDataFrame([(6, 1), (1, 0), (2, None)], "doc_id long, quality int"))
    assert quality.score(stats, trees).count() == len(ODD)


def test_gru_gradients_by_differences():
    lex = recurrent.Lexicon(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.ones(recurrent.TAIL, np.int64), np.ones(recurrent.TAIL, np.int64), 10, 5, np.arange(recurrent.HEAD)[::-1].copy())
    net = recurrent.Gru.fresh(lex)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(2)
    sym = rng.integers(0, recurrent.HEAD + recurrent.TAIL, 60)
    inp, target, begin, live, _ = recurrent.into_lanes(sym, np.array([0, 25, 26, 60]), 2)
    h0 = rng.normal(0, 0.1, (2, recurrent.WIDTH))
    loss = lambda: net.gradients(inp[3:9], target[3:9], begin[3:9], live[3:9], h0)
    grad = loss()[0]
    for k, v in net.p.items():
        flat = v.reshape(-1)
        i = int(np.abs(grad[k]).argmax())
        old = flat[i]
        flat[i] = old + 1e-4
        up = loss()[2]
        flat[i] = old - 1e-4
        down = loss()[2]
        flat[i] = old
        # states are kept in single precision
        assert grad[k].reshape(-1)[i] == pytest.approx((up - down) / 2e-4, rel=0.02, abs=2e-4)


def test_lanes_and_carried_state_equal_reading_one_by_one():
    lex = recurrent.Lexicon(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.ones(recurrent.TAIL, np.int64), np.ones(recurrent.TAIL, np.int64), 10, 5, np.ones(recurrent.HEAD, np.int64))
    net = recurrent.Gru.fresh(lex)
    rng = np.random.default_rng(5)
    length = np.array([300, 1, 70, 129, 5, 64])
    bounds = np.concatenate([[0], np.cumsum(length)])
    sym = rng.integers(0, recurrent.HEAD + recurrent.TAIL, bounds[-1])
    together = recurrent.token_log_probs(net, sym, bounds)
    alone = np.concatenate([recurrent.token_log_probs(net, sym[i:j], np.array([0, j - i])) for i, j in zip(bounds, bounds[1:])])
    assert np.allclose(together, alone, atol=1e-4) and (together < 0).all()


def test_class_factored_softmax_sums_to_one():
    lex = recurrent.Lexicon(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.ones(recurrent.TAIL, np.int64), np.ones(recurrent.TAIL, np.int64), 10, 5, np.arange(recurrent.HEAD))
    net = recurrent.Gru.fresh(lex)
    every = np.arange(recurrent.HEAD + recurrent.TAIL)
    h = np.random.default_rng(0).normal(size=recurrent.WIDTH).astype(np.float32)
    assert np.exp(net.log_probs(np.repeat(h[None], len(every), 0), every)[0]).sum() == pytest.approx(1, abs=1e-4)


def test_language_model_base_scores_and_gain(spark, odd):
    rows = [(i, t) for i, t in ODD] + [(100 + r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", recurrent.F.lit("clash"))
    got = recurrent.score_documents(df, id_remainder("doc_id", 7) != 2, {"held_out": id_remainder("doc_id", 7) == 2}).collect()
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    words = [((t or "").encode().lower().split() + [None], held(i), i) for i, t in rows]
    count = Counter(w for ws, h, _ in words if not h for w in ws)
    total, kinds = sum(count.values()), len(count)
    want = sorted((str(i), h, len(ws), sum(count[w] > 0 for w in ws), round(sum(math.log10((count[w] + 1) / (total + kinds + 1)) for w in ws), 5)) for ws, h, i in words)
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], round(r["base_score"], 5)) for r in got) == want
    assert {r["train_tokens"] for r in got} == {total} and all(r["score"] < 0 for r in got)
    some = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in some) > sum(r["base_score"] for r in some)


def test_language_model_without_training_rows(spark, odd):
    got = recurrent.score_documents(odd.drop("score"), recurrent.F.lit(False), {}).collect()
    assert len(got) == len(ODD) and {r["train_tokens"] for r in got} == {0} and {r["base_score"] for r in got} == {0.0}
