"""Many languages, and rows that repeat as a whole."""

import pickle
import zlib

import numpy as np
from pyspark.sql import functions as F

from entitygraph.llm import chat, language, mixing
from entitygraph.llm.common import cut, ship
from entitygraph.plans import iterate


def test_every_language_is_learned(spark):
    ship(spark)
    rng = np.random.default_rng(6)
    rows, n = [], 300
    for k in range(n):
        letters = rng.choice(list("abcdefghijklmnopqrstuvwxyzäöüßéèñøåç"), 9, replace=False)
        words = ["".join(rng.choice(letters, rng.integers(3, 8))) for _ in range(12)]
        rows += [(k * 100 + i, " ".join(rng.choice(words, 40)), f"l{k:03d}") for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs)
    assert len(model.languages) == n
    again = pickle.loads(pickle.dumps(model))
    assert (again.weights == model.weights).all() and again.predict(rows[0][1]) == model.predict(rows[0][1])
    want = {r[0]: r[2] for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2}
    got = {r["doc_id"]: r["lang_pred"] for r in language.predict(docs, model).filter("held_out").collect()}
    assert got.keys() == want.keys() and np.mean([got[i] == want[i] for i in want]) > 0.9
    rare = {f"l{k:03d}" for k in range(n)} - set(got.values())
    assert len(rare) < n / 10


def test_a_column_without_languages_is_refused(spark, monkeypatch):
    ship(spark)
    monkeypatch.setattr(language, "MAX_TAGS", 3)
    docs = spark.createDataFrame([(i, "some text", f"t{i}") for i in range(30)], "doc_id long, text string, lang string")
    try:
        language.train(docs)
    except ValueError as e:
        assert "lang" in str(e)
    else:
        raise AssertionError("a column of many tags was learned")


def test_repeated_rows_are_spread(spark, monkeypatch, tmp_path):
    """A third of all rows being one turn or one document takes no task above
    three times the mean, and each is counted."""
    ship(spark)
    monkeypatch.setattr(iterate, "PART_ROWS", 500)
    sizes = []
    plain = iterate.dense_index

    def watched(*args, **how):
        out = plain(*args, **how)
        sizes.append([r["count"] for r in spark.read.parquet(out._scratch).groupBy("__pid").count().collect()])
        return out

    monkeypatch.setattr(chat, "dense_index", watched)
    monkeypatch.setattr(mixing, "dense_index", watched)
    turns = [(1, 1, "user", "same")] * 3000 + [(i, t, "user", f"{i} {t}") for i in range(2, 602) for t in range(10)]
    got = chat.collapse_and_render(cut(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")))
    n = {r["conv_id"]: r["n"] for r in got.groupBy("conv_id").agg(F.sum("n_turns").alias("n")).collect()}
    assert n[1] == 3000 and len(n) == 601 and set(n.values()) == {3000, 10}
    docs = cut(spark.createDataFrame([(7, "one two three", "a")] * 3000 + [(i, "four words are here", "b") for i in range(100, 6100)],
                                     "doc_id long, text string, source string"))
    taken = mixing.plan_mix(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 4 for r in taken)
    assert len(sizes) >= 2 and all(max(s) < 3 * sum(s) / len(s) and len(s) >= 9 for s in sizes)
