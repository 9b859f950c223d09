"""The near-copy stage at its own threshold, and pairs of one bucket that share a single band."""

from __future__ import annotations

import numpy as np

import corpus_pipeline
from skeinwork.llm import minhash, pii
from tests.llm import brute
from tests.llm.test_models import changed, words
from tests.llm.test_text import SF, documents


def scattered(text, n):
    """n words, far from each other, replaced."""
    parts = text.split()
    for k in range(n):
        parts[(2 * k + 1) * len(parts) // (2 * n)] = f"s{n}x{k}"
    return " ".join(parts)


def test_stage_takes_copies_from_80_percent(spark):
    rng = np.random.default_rng(6)
    stems = [words(rng, 200, 10**5) for _ in range(20)]
    texts = [t for s in stems for t in (s, scattered(s, 4), scattered(s, 7))]
    rows = list(enumerate(texts))
    want = brute.near_copies(rows, 80)
    assert want != brute.near_copies(rows, 85)
    docs = documents(spark, texts)
    left = corpus_pipeline.near_copies(spark, docs, SF)
    assert {r["doc_id"] for r in left.collect()} == {c for _, c in want.values()}
    assert {r["id"]: (r["n"], r["component"]) for r in minhash.near_duplicates(docs, percent=80).collect()} == want


def test_second_look_needs_one_shared_band(spark):
    """With a single band, a pair that its hub is not near can share no second one."""
    rng = np.random.default_rng(4)
    texts = []
    for _ in range(60):
        stem = words(rng, 200, 10**5)
        near = changed(rng, stem, 15)
        texts += [stem, near, scattered(near, 1)]
    docs = documents(spark, texts)
    keys = {r["id"]: r["bands"] for r in minhash.sketch(docs.selectExpr("doc_id as id", "text"), 5, 1, 1).collect()}
    want = {i: c for i, (_, c) in brute.near_copies(list(enumerate(texts))).items()}
    sharing = [i for i in range(0, len(texts), 3) if keys[i] == keys[i + 1] == keys[i + 2] and want[i + 1] == i + 1 == want[i + 2]]
    got = {r["id"]: r["component"] for r in minhash.near_duplicates(docs, bands=1, rows=1).collect()}
    assert len(sharing) > 5 and all(got[i + 2] == i + 1 for i in sharing)


def test_pipeline_stages_by_brute_force_at_80(spark):
    now = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:2]:
        now = stage(spark, now, SF)
    kept = {r["doc_id"]: r["text"] for r in now.collect()}
    own = brute.near_copies(list(kept.items()), 80)
    rows = [(i, t) for i, t in kept.items() if own[i][1] == i]
    now = corpus_pipeline.near_copies(spark, now, SF)
    assert {r["doc_id"]: r["text"] for r in now.collect()} == dict(rows)
    hidden = brute.terms(rows, pii.WINDOW, pii.ALPHA, pii.LEAST_DOCUMENTS, pii.REMOVE)
    clean = {r["doc_id"]: r["text"] for r in corpus_pipeline.personal_data(spark, now, SF).collect()}
    assert clean == {i: brute.sanitised(t, h) for (i, t), h in zip(rows, hidden, strict=True)}


def test_unlike_members_of_a_bucket_meet_in_proportion(spark, monkeypatch):
    """Members that share a band and little else: what is compared grows with them, and links among them are found."""
    monkeypatch.setattr(minhash, "BLOCK", 64)
    rng = np.random.default_rng(9)
    stem = words(rng, 30, 10**5)
    made = [f"{stem} {words(rng, 60, 10**6)}" for _ in range(560)]
    texts = made + [scattered(t, 1) for t in made[:80]]  # half of them are near their originals
    plain, rows = minhash._compared, []
    monkeypatch.setattr(minhash, "_compared", lambda dealt, *more: rows.append(dealt.count()) or plain(dealt, *more))
    sums = []
    for n in (320, 640):
        own = texts[: n - 40] + texts[-80:-40]
        rows.clear()
        got = {r["id"]: r["component"] for r in minhash.near_duplicates(documents(spark, own), bands=6, rows=1).collect()}
        sums.append(sum(rows))
        want = {i: c for i, (_, c) in brute.near_copies(list(enumerate(own))).items()}
        assert got == want and len(set(want.values())) < len(own)
    assert 100 < sums[0] and sums[1] < 3 * sums[0]
