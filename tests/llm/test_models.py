"""Near copies, vectors, tokens, language, quality, the pipeline and the registered queries."""

from __future__ import annotations

import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from skeinwork.llm import bpe, common, embed, langid, minhash, pii, quality, queries, ragged, sql, tokens
from tests import compare
from tests.llm import brute
from tests.llm.test_text import ODD, SF, documents


def words(rng, n, of=400):
    return " ".join(f"w{k}" for k in rng.integers(0, of, n))


def changed(rng, text, n):
    parts = text.split()
    for k in rng.integers(0, len(parts), n):
        parts[k] = f"c{rng.integers(0, 10**6)}"
    return " ".join(parts)


def test_near_copies_by_brute_force(spark):
    rng = np.random.default_rng(5)
    base = [words(rng, 200) for _ in range(6)] + [words(rng, 2500, 10**5)]
    texts = [changed(rng, b, n) for b in base for n in (0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12)]
    chain = [base[0]]
    for _ in range(8):  # each near the last, far from the first
        chain.append(changed(rng, chain[-1], 2))
    texts += chain + ["one two three", "ONE  two\tthree", "one two four", "x", "x", *ODD]
    got = {r["id"]: r for r in minhash.near_duplicates(documents(spark, texts)).collect()}
    want = brute.near_copies(list(enumerate(texts)))
    assert {i: (r["n"], r["component"]) for i, r in got.items()} == want
    assert {i for i, r in got.items() if r["kept"]} == {c for _, c in want.values()}


def test_second_look_finds_what_stars_miss(spark):
    """A hub that is near none of the others, in buckets with pairs that are near each other."""
    rng = np.random.default_rng(9)
    stem = words(rng, 300)
    texts = [changed(rng, stem, 12)]
    for _ in range(40):
        near = changed(rng, stem, 9)
        texts += [near, changed(rng, near, 2)]
    got = {r["id"]: r["component"] for r in minhash.near_duplicates(documents(spark, texts), bands=64, rows=2).collect()}
    assert got == {i: c for i, (_, c) in brute.near_copies(list(enumerate(texts))).items()}


@pytest.mark.parametrize("members,place", [(250, "first"), (500, "last"), (1000, "shuffled")])
def test_group_astride_the_threshold(spark, monkeypatch, members, place):
    """Variants of one text, two scattered words changed or three, near 85 percent of each other: whatever the order of ids, links are those of all pairs."""
    monkeypatch.setattr(minhash, "BLOCK", 128)  # so that members of several blocks meet too
    rng = np.random.default_rng(members)
    stem = words(rng, 150, 10**5)
    texts = [stem] + [changed(rng, stem, 2 + k % 4) for k in range(members)]
    order = {"first": range(len(texts)), "last": range(len(texts) - 1, -1, -1), "shuffled": rng.permutation(len(texts)).tolist()}[place]
    texts = [texts[k] for k in order]
    emitted = []
    compared = minhash._compared
    monkeypatch.setattr(minhash, "_compared", lambda *a: emitted.append(out := common.saved(compared(*a), "counted")) or out)
    got = {r["id"]: (r["n"], r["component"]) for r in minhash.near_duplicates(documents(spark, texts)).collect()}
    assert got == brute.near_copies(list(enumerate(texts)))
    assert sum(e.count() for e in emitted) <= 2 * members


def test_overlaps_and_joining_links():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 3000, n, dtype=np.uint64)) for n in (2500, 9000, 1, 40, 9000, 3000)]
    want = np.array([[len(np.intersect1d(x, y)) for y in sets[2:]] for x in sets[:2]])
    assert (minhash.overlaps(sets, 2) == want).all()
    near = [np.arange(k, 100 + k, dtype=np.uint64) for k in range(0, 40, 4)]
    labels = np.arange(10)
    links = minhash.joining(near + near, np.concatenate([labels, labels]), 10, 90)
    assert len(links) == 9 and all(abs(i - (j - 10)) == 1 for i, j in links)
    assert minhash.joining(near + near, np.zeros(20, np.int64), 10, 90) == []


def test_near_copies_of_odd_tables(spark):
    df = documents(spark, ["a b c d e f"] * 3 + ["q", None], [5, 5, None, None, 6])
    got = sorted(((r["id"] or -1), r["component"], r["kept"]) for r in minhash.near_duplicates(df).collect())
    assert got == [(-1, None, True), (-1, None, True), (5, 5, True), (5, 5, True), (6, 6, True)]
    assert minhash.near_duplicates(df.where("false")).count() == 0


def test_near_vectors_by_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for c in range(12):
        middle = rng.standard_normal(32)
        for s in (0.0, 0.0, 0.02, 0.05, 0.08, 0.1, 0.12, 0.15, 0.2):
            rows.append(((middle + s * rng.standard_normal(32)).tolist(), c % 5))
    rows += [(None, 1), ([], 1), ([0.0] * 32, 1), ([0.0] * 32, 1), ([1.0] * 31 + [None], 1), ([1.0] * 31 + [float("nan")], 1), ([float("inf")] + [1.0] * 31, 2), ([1.0] * 32, None), ([1.0] * 32, None), ([1.0, 2.0], 3), ([2.0, 4.0], 3), ([1e-30] * 32, 4), ([1e30] * 32, 4), ([5.0], 0), ([-5.0], 0)]
    rows = [(i, v, c) for i, (v, c) in enumerate(rows)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, class string")
    got = {r["id"]: r for r in embed.near_vectors(df).collect()}
    want = brute.near_vectors(rows)
    assert {i: (r["n_links"], r["component"]) for i, r in got.items()} == want
    assert {i for i, r in got.items() if r["kept"]} == {c for _, c in want.values()}
    assert embed.near_vectors(df.where("false")).count() == 0


def test_lattice_points_are_nearest():
    rng = np.random.default_rng(1)
    x, shell = 3 * rng.standard_normal((200, 8)), embed.neighbours()
    own = embed.decode(x)
    assert len(np.unique(shell, axis=0)) == 240 and np.allclose((shell**2).sum(axis=1), 2)
    assert (((x - own) ** 2).sum(axis=1)[:, None] <= ((x[:, None] - own[:, None] - shell) ** 2).sum(axis=2) + 1e-9).all()
    assert np.all(own.sum(axis=1) % 2 == 0) and np.all((2 * own % 2).std(axis=1) == 0)


@pytest.mark.parametrize("low,high,least", [(0.9801, 0.983, 0.97), (0.98, 1.0, 0.99)])
def test_vector_recall_on_a_larger_table(spark, low, high, least):
    """sf0.1 and three vectors near each of its own, against every pair of a label: recall of links, and no wrong one."""
    rng = np.random.default_rng(8)
    rows = [(r["embedding"], r["label"]) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    rows = [(np.array(v, dtype=float), c) for v, c in rows if v is not None and c is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    for v, c in rows[:]:
        v = v / np.linalg.norm(v)
        for cosine in rng.uniform(low, high, 3):
            side = rng.standard_normal(len(v))
            side -= (side @ v) * v
            rows.append((cosine * v + np.sqrt(1 - cosine**2) * side / np.linalg.norm(side), c))
    links = np.zeros(len(rows), dtype=int)
    for c in {c for _, c in rows}:
        ids = np.array([i for i, r in enumerate(rows) if r[1] == c])
        own = np.stack([rows[i][0] for i in ids])
        own /= np.linalg.norm(own, axis=1, keepdims=True)
        links[ids] = (own @ own.T >= 0.98).sum(axis=1) - 1
    df = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(rows)], "vec_id long, embedding array<double>, label int")
    got = np.zeros(len(rows), dtype=int)
    for r in embed.near_vectors(df).collect():
        got[r["id"]] = r["n_links"]
    assert links.sum() > 10_000 and (got <= links).all()
    assert got.sum() >= least * links.sum(), got.sum() / links.sum()


@pytest.fixture(scope="module")
def library():
    made = Tokenizer.from_file(queries.vocabulary_path())
    made.no_truncation()
    made.no_padding()
    return made


STRANGE = ["Don't STOP's we'LL", "<|endoftext|>a<|startoftext|> <|ENDOFTEXT|>", "ΑΣ ΌΣΟΣ", "İstanbul ǅ ß", "é ẛ̣", "a b c　d\x85e", "١٢٣ ²x ⅷ", "日本語 テキスト", "👩‍👩‍👧 👍🏽", "\x00\x01 \x1c a\x1fb", "x​y ﻿", "' 's ''s '", "it's\n's", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaab", "퟿ �", "ﬁ ﬀ", "123abc!!!def"]


def test_tokens_equal_the_library(spark, library):
    texts = [*STRANGE, *ODD]
    got = {r["id"]: r for r in tokens.encode_decode(documents(spark, texts), queries.vocabulary_path(), with_ids=True).collect()}
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[i]["ids"] == ids, text
        assert got[i]["decoded_sha256"] == brute.sha(library.decode(ids, skip_special_tokens=False)), text


def test_long_and_short_words_agree():
    v = bpe.encoder(queries.vocabulary_path()).v
    rng = np.random.default_rng(4)
    for _ in range(200):
        word = bytes(rng.choice(list(b"abcethnors"), int(rng.integers(2, 40))).tolist())
        assert v.encode_words([word])[0].tolist() == v._long(word)


def test_codec_query(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r["doc_id"]: r for r in queries.op3_bpe_codec(spark, SF).collect()}
    for d in docs:
        ids = library.encode(d["text"] or "", add_special_tokens=False).ids
        r = got[d["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), brute.sha(np.array(ids, "<u4").tobytes()))
        assert r["decoded_sha256"] == brute.sha(library.decode(ids, skip_special_tokens=False))


def check_packed(rows, wanted, most_padding=0.02):
    """Every id once, in pieces; gapless sequences of the capacity at most; little padding."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert pieces.keys() == wanted.keys()
    for i, ids in wanted.items():
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    padding = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    assert padding <= most_padding * sum(map(len, wanted.values()))


def test_packing(spark, library):
    docs = [(d["doc_id"], d["text"]) for d in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    encoded = lambda rows: {i: [*library.encode(t or "", add_special_tokens=False).ids, 2] for i, t in rows}
    check_packed(queries.op4_packing(spark, SF).collect(), encoded(docs))
    odd = list(enumerate(ODD))
    check_packed(tokens.pack(documents(spark, ODD), queries.vocabulary_path(), sequences=2).withColumnRenamed("id", "doc_id").collect(), encoded(odd))
    none = documents(spark, ["x"]).where("false")
    assert tokens.pack(none, queries.vocabulary_path()).count() == tokens.encode_decode(none, queries.vocabulary_path()).count() == 0
    assert sorted(r["length"] for r in tokens.pack(documents(spark, [None, None], [None, None]), queries.vocabulary_path()).collect()) == [1, 1]


def test_chunks_of_one_hash_are_told_apart(monkeypatch, library):
    texts = ["one two three one", "two  four é", "", "seventeen characters", "seventeen charactert one"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    monkeypatch.setattr(ragged, "hash_words", lambda data, starts, ends: (ends - starts).astype(np.uint64) % np.uint64(2))
    encoder = bpe.Encoder(bpe.encoder(queries.vocabulary_path()).v)
    for _ in range(2):
        ids, start = encoder.encode(data, at)
        assert [ids[a:b].tolist() for a, b in zip(start[:-1], start[1:], strict=True)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_packing_balances_cost():
    block = tokens.Block(100, 3)
    for d, n in enumerate([60, 60, 60, 40, 40, 20, 20, 250]):
        block.add(d, n)
    out = list(block.deal(True))
    assert sum(n for own in out for _, _, n in own) == 550
    assert [sum(n for _, _, n in own) for own in out][:5] == [100] * 5 and all(sum(n for _, _, n in own) & (sum(n for _, _, n in own) - 1) == 0 for own in out[5:])


def cost(pieces):
    return sum(tokens.LINEAR * n + tokens.QUADRATIC * n * n for _, _, n in pieces)


def test_documents_go_to_the_cheapest_sequence_with_room():
    rng = np.random.default_rng(3)
    for _ in range(20):
        sizes = rng.integers(1, 90, 60).tolist()
        block = tokens.Block(100, 1000)
        for d, n in enumerate(sizes):
            block.add(d, n)
        got = list(block.deal(False))
        bins = [[] for _ in range(sum(sizes) // 100)]
        for d, n in sorted(enumerate(sizes), key=lambda x: -x[1]):
            s = 0
            while n:
                open_ = [b for b in bins if sum(p[2] for p in b) < 100]
                if not open_:
                    break
                best = min([b for b in open_ if sum(p[2] for p in b) + n <= 100] or open_, key=cost)
                take = min(n, 100 - sum(p[2] for p in best))
                best.append((d, s, take))
                s, n = s + take, n - take
        assert got == bins


def test_language(spark):
    folder = "/root/testdata/sf0.1"
    found = queries.op10_language_id(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    held = found.where("held_out").join(docs.where("lang is not null and length(text) >= 200"), "doc_id")
    right, n = held.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int")), F.count("*")).first()
    assert n > 500 and right >= 0.98
    assert found.where("score < 0 or score > 1").isEmpty()
    texts = [*ODD, "123 !? \n", "éé", "日本"]
    net = langid.fit(docs.limit(500))
    got = [r for r in langid.predict(documents(spark, texts).withColumn("lang_pred", F.lit("clash")), net).orderBy("doc_id").collect()]
    assert [r["lang_pred"] == "und" for r in got] == [not any(c.isalpha() for c in t or "") for t in texts]
    assert [r["text"] for r in got] == texts
    assert langid.fit(docs.where("false")) is None
    assert {r["lang_pred"] for r in langid.predict(documents(spark, ["word"]), None).collect()} == {"und"}


def test_network_by_loops():
    """Filters, maxima and softmax of one window at a time, in plain loops."""
    rng = np.random.default_rng(7)
    data = rng.integers(0, 256, 700, dtype=np.uint8)
    at = np.array([0, 3, 3, 300, 700])
    cuts, row, size = langid.cut(data, at)
    net = langid.train(cuts, np.arange(len(cuts)) % 3, ["a", "b", "c"], epochs=1)
    assert row.tolist() == [0, 2, 2, 3, 3] and size.tolist() == [3, 256, 41, 256, 144]
    folded = langid.fold_case(data)
    for w in range(len(cuts)):
        text = folded[at[row[w]] + 256 * (row[:w] == row[w]).sum() : at[row[w] + 1]][: 256 + max(langid.WIDTHS) - 1].tolist()
        text += [0] * (256 + max(langid.WIDTHS) - 1 - len(text))
        hidden = []
        for k, width in enumerate(langid.WIDTHS):
            for f in range(k * langid.FILTERS, (k + 1) * langid.FILTERS):
                found = [sum(float(net.embed[text[p + j], e]) * float(net.filters[j * langid.EMBED + e, f]) for j in range(width) for e in range(langid.EMBED)) for p in range(langid.WINDOW)]
                hidden.append(max(max(found) + float(net.bias[f]), 0.0))
        z = [sum(h * float(net.out[f, c]) for f, h in enumerate(hidden)) + float(net.out_bias[c]) for c in range(3)]
        want = np.exp(np.array(z) - max(z)) / np.exp(np.array(z) - max(z)).sum()
        assert net.scores(cuts[w : w + 1])[0] == pytest.approx(want, abs=1e-4)


def test_quality(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    known = labels.where("quality is not null")
    seen, unseen = (known.where(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(3)) > 0), known.where(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(3)) == 0))
    found = quality.score(docs, seen).withColumnRenamed("id", "doc_id").join(unseen, "doc_id")
    got = {r["quality"]: r for r in found.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"), F.count("*").alias("n")).collect()}
    assert got[1]["kept"] >= 0.97 and got[0]["kept"] <= 0.2
    odd = documents(spark, ODD).withColumn("source", F.lit(None).cast("string")).withColumn("lang", F.lit("xx"))
    assert {r["score"] for r in quality.score(odd, labels).collect()} == {0.5}
    assert quality.score(docs.where("false"), labels).count() == 0
    odd = odd.withColumn("n_chars", F.lit(None).cast("long")).withColumn("doc_id", -1 - F.col("doc_id")).select(docs.columns)
    both = docs.unionByName(odd).unionByName(docs.limit(3)).withColumns({"t": F.lit(1), "m": F.lit(1), "y": F.lit(1), "p": F.lit(1)})
    out = quality.score(both, labels)
    assert out.count() == docs.count() + len(ODD) + 3 and out.where("score is null or score < 0 or score > 1").isEmpty()


def plain_newton(x, y, ridge=1.0):
    """Logistic regression on standardised columns with a ridge, to convergence."""
    mean, sd = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.hstack([(x - mean) / sd, np.ones((len(x), 1))])
    w, pull = np.zeros(z.shape[1]), np.array([ridge] * x.shape[1] + [1e-6])
    for _ in range(200):
        p = 1 / (1 + np.exp(-(z @ w)))
        grad = z.T @ (y - p) - pull * w
        hess = z.T @ np.diag(p * (1 - p)) @ z + np.diag(pull)
        w = w + np.clip(np.linalg.solve(hess, grad), -5, 5)
    return lambda v: np.hstack([(v - mean) / sd, np.ones((len(v), 1))]) @ w


def test_views_teach_each_other(spark, monkeypatch):
    """Co-training against a plain version over all rows; pseudo-labels of each view change the other."""
    monkeypatch.setattr(quality, "SURE", 0.9)
    rng = np.random.default_rng(11)
    rows = []
    for k in range(500):
        good = bool(rng.random() < 0.6)
        own = [f"{'fine' if (rng.random() < 0.85) == good else 'poor'}{rng.integers(0, 6)}" for _ in range(8)]
        source = f"{'a' if (rng.random() < 0.97) == good else 'b'}{rng.integers(0, 3)}"
        rows.append((k, " ".join(own), source, "en", int(rng.integers(1, 5000)), int(good)))
    docs = spark.createDataFrame([r[:5] for r in rows], "doc_id long, text string, source string, lang string, n_chars long")
    labels = spark.createDataFrame([(r[0], r[5]) for r in rows[:120]], "doc_id long, quality int")
    table = quality.views(docs, labels)
    model = quality.fit(table)
    assert {t for _, t, good, bad in model.taught if good and bad} == {"text", "meta"}
    alone = quality.fit(table, rounds=0)
    assert alone.taught == [] and all(np.abs(alone.weights[v] - model.weights[v]).max() > 0.01 for v in quality.VIEWS)
    got = {r["id"]: r for r in table.withColumn("h", F.pmod(F.xxhash64("id"), F.lit(quality.SCALE))).collect()}
    x = {v: np.array([got[k][c] for k in range(500)], dtype=float) for v, c in (("text", "t"), ("meta", "m"))}
    y = np.array([r[5] for r in rows], dtype=float)
    order = sorted(range(500), key=lambda k: (got[k]["h"], k))
    held = np.zeros(500, bool)
    for label in (0, 1):
        held[[k for k in order if k < 120 and y[k] == label][::4]] = True
    train = [k for k in order if k < 120 and not held[k]]
    share = y[:120].mean()
    given = {v: [(k, y[k]) for k in train] for v in quality.VIEWS}
    fitted = lambda v: plain_newton(x[v][[k for k, _ in given[v]]], np.array([t for _, t in given[v]]))
    taught = []
    for k in range(quality.ROUNDS):
        models = {v: fitted(v) for v in quality.VIEWS}
        for teacher, pupil in (("text", "meta"), ("meta", "text")):
            p = 1 / (1 + np.exp(-models[teacher](x[teacher])))
            sure = {1: [j for j in order if j >= 120 and p[j] >= 0.9], 0: [j for j in order if j >= 120 and p[j] <= 1 - 0.9]}
            size = min(quality.ROUND_ROWS, len(sure[1]) / share, len(sure[0]) / (1 - share))
            take = {1: max(1, int(size * share)), 0: max(1, int(size * (1 - share)))} if sure[1] and sure[0] else {1: 0, 0: 0}
            given[pupil] += [(j, float(t)) for t in (1, 0) for j in sure[t][: take[t]]]
            taught.append((k, teacher, take[1], take[0]))
    assert model.taught == taught
    for v in quality.VIEWS:
        assert x[v] @ model.weights[v][:-1] + model.weights[v][-1] == pytest.approx(fitted(v)(x[v]), abs=1e-3)
    # calibration and combination on the rows held back, and the score of every row
    logits = {v: fitted(v)(x[v]) for v in quality.VIEWS}
    calm = {v: plain_newton(logits[v][held][:, None], y[held], 0.01)(logits[v][:, None]) for v in quality.VIEWS}
    both = np.column_stack([calm[v] for v in quality.VIEWS])
    want = 1 / (1 + np.exp(-plain_newton(both[held], y[held], 0.01)(both)))
    assert (model.both[:2] > 0).all()
    scored = {r["id"]: r for r in quality.score(docs, labels).collect()}
    assert [scored[k]["score"] for k in range(500)] == pytest.approx(want.tolist(), abs=2e-3)
    assert [scored[k]["p_text"] for k in range(500)] == pytest.approx((1 / (1 + np.exp(-calm["text"]))).tolist(), abs=2e-3)


def test_no_view_counts_against_itself():
    """A view of noise that would get a weight below 0 is left out; two of them leave the share of good labels."""
    rng = np.random.default_rng(3)
    y = (rng.random(200) < 0.7).astype(float)
    good, bad = (2 * y - 1) * 3 + rng.normal(size=200), -(2 * y - 1) + rng.normal(size=200)
    one = {v: np.array([1.0, 0.0]) for v in quality.VIEWS}
    both = quality.combined(one, {"text": good, "meta": bad}, y)
    assert both[0] > 0 and both[1] == 0
    assert quality.combined({"text": np.array([-1.0, 0]), "meta": np.array([0.0, 0])}, {"text": good, "meta": bad}, y) == pytest.approx([0, 0, np.log(y.mean() / (1 - y.mean()))])


def test_few_labels_are_a_model_too(spark):
    docs = documents(spark, ["fine words " * 5, "poor words #### " * 5, "fine words again", "poor #### things"]).select("doc_id", "text", F.lit("s").alias("source"), F.lit("en").alias("lang"))
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, quality int")
    got = {r["id"]: r["score"] for r in quality.score(docs, labels).collect()}
    assert got[0] > 0.5 > got[1] and got[2] > got[3]
    y = np.array([1.0, 1, 1, 1, 1, 0])
    fitted, held = quality.held_back(y)
    assert fitted.tolist() == [False, True, True, True, False, True] and held.tolist() == [True, False, False, False, True, True]


def test_fitting_holds_the_sample_in_its_own_floats(spark):
    """6,000 labelled rows are 8 MB of 32-bit floats. The driver's Python holds them and those it fits on, and neither objects of their own nor doubles for all of them."""
    cells = lambda n, seed: F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: (F.pmod(F.hash("id", k, F.lit(seed)), F.lit(1000)) / 1000).cast("float"))
    wide = {v: len(quality.SHAPES) + quality.WORD_CELLS if v == "text" else quality.SOURCES + quality.LANGS + quality.STEPS for v in quality.VIEWS}
    table = spark.range(9000).withColumns({"t": cells(wide["text"], 1), "m": cells(wide["meta"], 2)}).withColumn("y", F.when(F.col("id") < 6000, (F.col("t")[0] > 0.5).cast("double")))
    tracemalloc.start()
    try:
        model = quality.fit(table)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert any(view == "text" and good and bad for _, view, good, bad in model.taught)
    assert [len(model.weights[v]) for v in quality.VIEWS] == [wide[v] + 1 for v in quality.VIEWS]
    assert peak < 4 * 6000 * sum(wide.values()) * 4


def test_pipeline_by_brute_force(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    now, kept = docs, dict(rows)
    for name, stage in corpus_pipeline.STAGES[:4]:
        now = stage(spark, now, SF)
        assert now.columns == docs.columns
        if name == "language":
            net = langid.fit(docs.where(~queries.held_out()))
            sure = {r["doc_id"] for r in langid.predict(docs, net).collect() if r["lang_score"] >= corpus_pipeline.LEAST_SCORE}
            kept = {i: t for i, t in kept.items() if any(c.isalpha() for c in t or "") and i in sure}
        elif name == "exact_copies":
            kept = {i: kept[i] for i in {t: i for i, t in sorted(kept.items())}.values()}
        elif name == "near_copies":
            own = brute.near_copies(list(kept.items()), corpus_pipeline.NEAR_PERCENT)
            kept = {i: t for i, t in kept.items() if own[i][1] == i}
        else:
            order = list(kept.items())
            hidden = brute.terms(order, pii.WINDOW, pii.ALPHA, pii.LEAST_DOCUMENTS, pii.REMOVE)
            kept = {i: brute.sanitised(t, h) for (i, t), h in zip(order, hidden, strict=True)}
        assert {r["doc_id"]: r["text"] for r in now.collect()} == kept, name
    check_packed(corpus_pipeline.run(spark, SF).collect(), {i: [*library.encode(t, add_special_tokens=False).ids, 2] for i, t in kept.items()})


def test_exact_stage_with_rows_repeated_in_full(spark):
    df = documents(spark, ["x y", "x y", "x y", "z"], [3, 3, 1, 4]).select("doc_id", "text")
    stage = dict(corpus_pipeline.STAGES)["exact_copies"]
    assert sorted(r["doc_id"] for r in stage(spark, df, SF).collect()) == [3, 4]


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_query_against_sql(spark, name):
    assert not compare.differences(spark, queries.queries()[name], sql.oracle_sql()[name], SF)
