"""Chat format, exact copies, personal data, secrets."""

from __future__ import annotations

import zlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skeinwork.llm import chat, exact, pii, queries, secrets
from tests.llm import brute

SF = "/root/testdata/sf0.001"
ODD = ["", None, " ", "\n\n", "\\s \\l <turn:user> </turn> <and/> \\g", "ünïcödé 𝄞 text", "a" * 70_000, "word " * 20_000, "+" * 300, "1 " * 500, "a@" * 400, "0.0.0." * 200]
PIECES = st.sampled_from(["a@b.co", "x.y+z@q-r.s.t", "@", ".", "1.2.3.4", "256.1.1.1", "001.02.3.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 (30) 123-456-78", "+1", " ", "-", "token", "API_KEY", "'", '"', "=", ": ", "abc123", "AKIA", "ABCDEFGHIJ0123456789", "0123456789abcdef", "passwd", "é", "\n", "7"])
TEXTS = st.lists(PIECES, max_size=14).map("".join)


def documents(spark, texts, ids=None):
    rows = list(zip(ids or range(len(texts)), texts, strict=True))
    return spark.createDataFrame([(i, t, "clash", -1) for i, t in rows], "doc_id long, text string, id string, size int")


def test_chat_reads_back_exactly(spark):
    turns = [(1, k, r, t) for k, (r, t) in enumerate([("user", "a"), ("user", None), ("assistant", ODD[4]), ("assistant", "x"), (None, "b"), ("as>s<turn:", "\\"), ("assistant", "")])]
    turns += [(2, 0, "assistant", "same"), (2, 0, "assistant", "same"), (None, None, "user", "n"), (3, 5, "user", "later"), (3, None, "user", "first")]
    df = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, turns string")
    got = {r["conv_id"]: r for r in chat.format_chats(df).select("*", chat.turns_of(F.col("formatted")).alias("back"), chat.trained_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert [(t.role, t.text) for t in got[1]["back"]] == [(r or "", t or "") for _, _, r, t in turns[:7]]
    assert got[1]["loss"] == ODD[4] + "x"
    assert got[1]["formatted"].startswith("<turn:user>a<and/></turn><turn:assistant>")
    assert [t.text for t in got[2]["back"]] == ["same", "same"] and got[2]["loss"] == "samesame"
    assert [t.text for t in got[3]["back"]] == ["first", "later"] and len(got[None]["back"]) == 1
    assert got[1]["loss_spans"][0].length == len(got[1]["formatted"][got[1]["loss_spans"][0].start :].split("<and/>")[0])
    assert chat.format_chats(df.where("false")).count() == 0


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "", "<turn:"]), st.text(st.sampled_from("\\<>/turnadslg:é"), max_size=12)), min_size=1, max_size=6))
def test_chat_round_trip(spark, turns):
    df = spark.createDataFrame([(0, k, *t) for k, t in enumerate(turns)], "conv_id long, turn long, role string, text string")
    got = chat.format_chats(df).select(chat.turns_of(F.col("formatted")).alias("back"), chat.trained_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
    assert [(t.role, t.text) for t in got["back"]] == turns
    assert got["loss"] == "".join(t for r, t in turns if r == "assistant")


def copies(rows):
    out = {}
    for i, t in rows:
        out.setdefault(t or "", []).append(i)
    return out


@pytest.mark.parametrize("digest", [exact.sha256, lambda t: F.unhex(F.lpad(F.hex(F.length(t) % 2), 2, "0"))], ids=["sha256", "clashing"])
def test_exact_copies(spark, digest):
    texts = ["a", "b", "a", None, "", "c" * 9000, "c" * 9000, "B", "a", "long " * 3000]
    ids = [1, 2, 3, 4, 5, 6, 7, 8, None, 9]
    got = exact.exact_duplicates(documents(spark, texts, ids), digest=digest).collect()
    groups = copies(zip(ids, texts, strict=True))
    assert len(got) == len(ids)
    want = {i: (max(x for x in g if x is not None), len(g)) for g in groups.values() for i in g}
    assert {r["id"]: (r["keep"], r["size"]) for r in got} == want
    assert {r["id"] for r in got if r["kept"]} == {k for k, _ in want.values()}


def test_exact_copies_of_odd_tables(spark):
    same = documents(spark, ["x"] * 50, [1] * 20 + [2] * 30)
    got = exact.exact_duplicates(same).collect()
    assert sum(r["kept"] for r in got) == 30 and {r["size"] for r in got} == {50}
    assert exact.exact_duplicates(same.where("false")).count() == 0
    none = exact.exact_duplicates(documents(spark, ["x", "x"], [None, None])).collect()
    assert all(r["kept"] and r["keep"] is None for r in none)
    clean = exact.exact_duplicates(documents(spark, ["A ", "a"]), normalise=lambda t: F.lower(F.trim(t))).collect()
    assert {r["keep"] for r in clean} == {1}


def check_pii(spark, texts):
    limits = {"window": 60, "alpha": 0.9, "least": 3, "remove": 0.99}
    ids = list(range(len(texts)))
    got = {r["id"]: r for r in pii.find(documents(spark, texts), **limits).collect()}
    want = brute.terms(list(zip(ids, texts, strict=True)), **limits)
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(documents(spark, texts), **limits).collect()}
    for i, text in enumerate(texts):
        assert [(s.start, s.rank, s.end) for s in got[i]["base"]] == brute.spans(text, brute.PII), text
        assert [tuple(t) for t in got[i]["terms"]] == want[i], text
        assert clean[i] == brute.sanitised(text, want[i]), text
    return want


def test_pii_of_odd_texts(spark):
    told = [f"call Zaphod about {x} and more words at x{k}@mail.example" for k, x in enumerate(["4111 1111 1111 1111"] * 4)]
    plain = [f"nothing here but common words about number {k} and more" for k in range(60)]
    assert any(check_pii(spark, [*ODD, *told, *plain, "mail me: ann@one.example, ann@one.example!", "Ann (ann@one.example) of Acme", "acme ann@one.example zaphod"]))
    assert pii.find(documents(spark, ["x"]).where("false")).count() == 0


def test_pii_of_equal_rows(spark):
    df = documents(spark, ["a@b.co", "a@b.co", None], [7, 7, None])
    assert [len(r["base"]) for r in pii.find(df).orderBy("id").collect()] == [0, 1, 1]
    assert [r["text"] for r in pii.sanitised(df).orderBy("doc_id").collect()] == [None, "[EMAIL]", "[EMAIL]"]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(TEXTS, min_size=20, max_size=40))
def test_base_spans_by_brute_force(spark, texts):
    df = documents(spark, texts)
    got = {r["doc_id"]: [(s.start, s.rank, s.end) for s in r["b"]] for r in df.select("doc_id", pii.base_spans(F.col("text")).alias("b")).collect()}
    assert got == {i: brute.spans(t, brute.PII) for i, t in enumerate(texts)}
    for t in texts:
        assert [s for s in secrets.spans(t) if s[1] < 3] == [(a, r, b) for a, r, b in brute.spans(t, brute.SECRETS)], t


def test_pii_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    rows = [(r["doc_id"], r["text"]) for r in docs]
    hidden = brute.terms(rows, pii.WINDOW, pii.ALPHA, pii.LEAST_DOCUMENTS, pii.REMOVE)
    got = {r["doc_id"]: r for r in queries.op5_pii(spark, SF).collect()}
    assert len(got) == len(rows)
    kinds = [k for k, _ in brute.PII]
    for (i, text), terms in zip(rows, hidden, strict=True):
        base = brute.spans(text, brute.PII)
        assert [got[i][f"n_{k}"] for k in kinds] == [sum(r == x for _, r, _ in base) for x in range(4)]
        assert got[i]["base_sha256"] == brute.sha(brute.named(base, kinds))
        assert got[i]["spans"] == brute.named(sorted(base + [(a, 4, b) for a, b, _ in terms]), [*kinds, "term"])


def test_secret_query_and_checksums(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r["doc_id"]: r for r in queries.op6_secret_scan(spark, SF).collect()}
    kinds = [k for k, _ in brute.SECRETS]
    for d in docs:
        base = brute.spans(d["text"], brute.SECRETS)
        assert [got[d["doc_id"]][f"n_{k}"] for k in kinds] == [sum(r == x for _, r, _ in base) for x in range(3)]
        assert got[d["doc_id"]]["base_sha256"] == brute.sha(brute.named(base, kinds))
    body = "0a1B2c3D4e5F6g7H8i9J0k1L2m3N4o"
    good = f"npm_{body}{secrets.base62(zlib.crc32(body.encode()))}"
    assert [k for _, k, _ in secrets.spans(f"x {good} y")] == [3] and not secrets.spans(f"x {good[:-1]}. y")
    found = secrets.secret_spans(documents(spark, [*ODD, good, good], [*range(len(ODD)), 99, None]))
    assert found.count() == len(ODD) + 2 and found.where("size(spans) > 0").count() == 3  # "aaa..." is hex
    assert secrets.secret_spans(documents(spark, ["x"]).where("false")).count() == 0
