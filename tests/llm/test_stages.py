"""Each stage of the pipeline on odd tables: nulls, repeated ids, ties, empty tables, columns with clashing names."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skeinwork.llm import common, exact, langid
from tests.llm.test_text import SF

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ("row", "told", "score", "lang_pred", "key", "marks", "hit", "p", "cell", "bits", "id", "node", "label", "base", "terms", "kept")
STAGES = dict(corpus_pipeline.STAGES)
LONG = " ".join(f"word{k} and" for k in range(30_000))


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", None, None) for i, t in rows], SCHEMA)


@pytest.mark.parametrize("name", list(STAGES))
def test_empty_tables(spark, name):
    docs = table(spark, []).withColumns({c: F.lit(c) for c in CLASHING})
    out = STAGES[name](spark, docs, SF)
    assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)


@pytest.mark.parametrize("name", list(STAGES)[:4])
def test_other_columns_are_carried_along(spark, name):
    rows = [(1, "a fine text of words"), (2, "a fine text of words"), (3, None), (None, "mail me at x@y.example"), (4, "")]
    docs = table(spark, rows).withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))) for c in CLASHING})
    out = STAGES[name](spark, docs, SF)
    assert out.columns == docs.columns
    found = out.collect()
    assert found and all(r[c] == c + ("?" if r["doc_id"] is None else str(r["doc_id"])) for r in found for c in CLASHING)
    plain = STAGES[name](spark, docs.drop(*CLASHING), SF)
    assert sorted(map(str, plain.collect())) == sorted(str(r) for r in out.drop(*CLASHING).collect())


def test_language_without_labels_keeps_all_that_has_letters(spark):
    docs = table(spark, [(1, "words"), (2, None), (3, ""), (4, "12 !?"), (5, "é"), (None, "also words"), (1, "words"), (6, LONG)]).withColumn("lang", F.lit(None).cast("string"))
    assert sorted(r["doc_id"] or 0 for r in STAGES["language"](spark, docs, SF).collect()) == [0, 1, 1, 5, 6]


def test_language_takes_what_the_network_is_sure_of(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    net = langid.fit(docs)
    monkeypatch.setattr(langid, "fit", lambda *_: net)
    odd = table(spark, [(-1, "zq xj 7 vkk wq qqq zxzx jjq"), (-2, "12"), (-3, None)])
    rows = docs.limit(200).unionByName(odd)
    want = {r["doc_id"] for r in langid.predict(rows, net).where("lang_pred <> 'und' and lang_score >= 0.4").collect()}
    assert {r["doc_id"] for r in STAGES["language"](spark, rows, SF).collect()} == want and -2 not in want and -3 not in want
    told = {r["doc_id"]: r["lang_pred"] for r in langid.predict(rows, net).where("lang_score >= 0.4").collect()}
    monkeypatch.setattr(corpus_pipeline, "LANGUAGES", ("de", "fr"))
    kept = {r["doc_id"] for r in STAGES["language"](spark, rows, SF).collect()}
    assert kept == {i for i, x in told.items() if x in ("de", "fr")} and 0 < len(kept) < len(want)
    monkeypatch.setattr(corpus_pipeline, "LEAST_SCORE", 1.1)
    assert STAGES["language"](spark, rows, SF).count() == 0


def test_exact_copies_with_ties_and_nulls(spark):
    docs = table(spark, [(3, "x y"), (3, "x y"), (1, "x y"), (None, "x y"), (None, "only here"), (None, "only here"), (5, None), (6, ""), (7, LONG), (8, LONG)])
    got = sorted((r["doc_id"] or 0, r["text"]) for r in STAGES["exact_copies"](spark, docs, SF).collect())
    assert got == [(0, "only here"), (0, "only here"), (3, "x y"), (6, ""), (8, LONG)]


def test_row_keys_tell_rows_apart(spark):
    df = spark.createDataFrame([(1, "2:x"), (12, ":x"), (None, "x"), (None, None), (None, ""), (1, "2:x")], "doc_id long, text string")
    keys = [r[0] for r in df.select(exact.row_key(F.col("doc_id"), F.col("text"))).collect()]
    assert len(set(keys)) == 4 and keys[3] == keys[4] and keys[0] == keys[5]


def test_near_copies_with_ties_and_nulls(spark):
    same = "one two three four five six seven"
    docs = table(spark, [(9, same), (9, "something else entirely is here now"), (4, same.upper()), (None, same), (5, None), (6, ""), (7, LONG), (8, LONG + " end")])
    got = sorted((r["doc_id"] or 0, r["text"]) for r in STAGES["near_copies"](spark, docs, SF).collect())
    assert got == [(0, same), (4, same.upper()), (5, None), (6, ""), (7, LONG)]  # both rows of 9 go: one of them is near 4


def test_personal_data_with_nulls_and_repeated_rows(spark):
    docs = table(spark, [(1, "me@one.example"), (1, "me@one.example"), (1, "call +49 30 123456 78"), (None, "ip 10.0.0.1"), (2, None), (3, ""), (4, LONG)])
    got = sorted((r["doc_id"] or 0, r["text"] or "", r["n_chars"]) for r in STAGES["personal_data"](spark, docs, SF).collect())
    assert got == sorted([(1, "[EMAIL]", 7), (1, "[EMAIL]", 7), (1, "call [PHONE]", 12), (0, "ip [IP]", 7), (2, "", None), (3, "", 0), (4, LONG, len(LONG))], key=lambda r: r[:2])


def test_packing_of_nulls_and_repeated_rows(spark):
    docs = table(spark, [(1, "a b"), (1, "a b"), (None, None), (2, "")])
    rows = STAGES["packing"](spark, docs, SF).collect()
    whole = sorted((r["doc_id"] or 0, r["doc_tokens"]) for r in rows if r["start"] == 0)
    assert whole == [(0, 1), (1, 3), (1, 3), (2, 1)] and sum(r["length"] for r in rows) == 8


def test_joins_by_bits_are_exact(spark):
    df = spark.createDataFrame([(k, f"k{k}") for k in range(2000)] + [(None, None)], "p long, hit string")
    keys = spark.createDataFrame([(k, f"k{k}") for k in range(0, 4000, 3)], "a long, b string")
    for key, own in (("p", "a"), ("hit", "b")):
        assert {r["p"] for r in common.among(df, key, keys.select(own)).collect()} == set(range(0, 2000, 3))
        assert {r["p"] for r in common.without(df, key, keys.select(own)).collect()} == {*(k for k in range(2000) if k % 3), None}
