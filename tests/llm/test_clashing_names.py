"""Extra columns keep their names and values; repeated ids and short benchmark items."""

from warmgrid.llm import chosenpath, decontaminate, langid, linededup, mixing

EXTRA = ["lang_pred", "score", "_letters", "_norm", "_hits_0", "_found_0", "hits", "_size", "_copy", "copies", "dk", "_gone", "n_lines", "n_dropped", "pos", "h"]


def table(spark, rows):
    """``rows`` (doc_id, text, source) with a text of its own in every column of EXTRA."""
    full = [(*r, *[f"{r[0]} {c}" for c in EXTRA]) for r in rows]
    return spark.createDataFrame(full, "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in EXTRA))


def values_stay(kept, ids):
    got = [r.asDict() for r in kept.collect()]
    assert sorted({r["doc_id"] for r in got}) == sorted(ids)
    assert all(r[c] == f"{r['doc_id']} {c}" for r in got for c in EXTRA)


ROWS = [(1, "the quick brown fox jumps over the lazy dog", "a"), (2, "un petit chat noir dort sur la table ronde", "b"),
        (3, "the quick brown fox jumps over the lazy dog", "a"), (4, "what is the capital of the small country", "a")]


def test_values_of_clashing_columns_stay(spark):
    df = table(spark, ROWS)
    bench = spark.createDataFrame([(1, "un petit chat noir dort sur la table")], "item_id long, text string")
    kept = decontaminate.keep_clean(df, bench)
    assert kept.columns == df.columns
    values_stay(kept, [1, 3, 4])
    kept = linededup.keep_new_lines(df)
    assert kept.columns == df.columns
    values_stay(kept, [1, 2, 4])
    kept = chosenpath.keep_one(df)
    assert kept.columns == df.columns
    values_stay(kept, [1, 2, 4])
    kept = mixing.apply(df)
    assert kept.columns == df.columns
    values_stay(kept, {r["doc_id"] for r in kept.collect()})
    learn = spark.createDataFrame([(i, t, "en" if i % 2 else "fr") for i, t in enumerate([ROWS[1][1], ROWS[0][1]] * 20)], "doc_id long, text string, lang string")
    kept = langid.keep_identified(df, langid.fit(learn), 0.0)
    assert kept.columns == df.columns
    values_stay(kept, [1, 2, 3, 4])


def test_of_a_repeated_id_the_same_row_stays_in_every_run(spark):
    rows = [(1, "one two three four five six seven", 1), (1, "eight nine ten eleven twelve thirteen", 1), (1, "one two three four five six seven", 1),
            (2, "one two three four five six seven", 2), (3, None, 3), (3, "", 3), (3, None, 3), (None, "x", 4), (None, "x", 4)]
    runs = set()
    for order in (rows, rows[::-1], rows[3:] + rows[:3]):
        kept = chosenpath.keep_one(spark.createDataFrame(order, "doc_id long, text string, kept_row long").repartition(3))
        runs.add(tuple(sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr)))
    assert len(runs) == 1
    (got,) = runs
    assert [i for i, _ in got].count(1) == 1 and (3, "") in got and (3, None) not in got and got.count((None, "x")) == 2


def test_short_items_are_found_whole_only(spark):
    items = [(1, "Who am I?"), (2, "42"), (3, "--"), (4, None)]
    texts = ["So, who am I", "who am it", "answer:42.", "4 2 142 421", "--", None, "WHO AM I 42"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: [h["item_id"] for h in r["hits"]] for r in decontaminate.contaminated(df, bench).collect()}
    assert got == {0: [1], 1: [], 2: [2], 3: [], 4: [], 5: [], 6: [1, 2]}
