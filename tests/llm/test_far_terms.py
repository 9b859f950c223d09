"""Terms that disclose an entity from far away in the text."""

from __future__ import annotations

from pyspark.sql import functions as F

from skeinwork.llm import pii
from tests.llm import brute
from tests.llm.test_text import documents


def test_disclosing_terms_far_from_their_entity(spark):
    far = "some plain words that say nothing at all " * 8
    told = [f"Zaphod {k} wrote. {far} mail ann@one.example now. {far} Zaphod, again" for k in range(3)]
    told += [f"ann@one.example {far} and zaphod near bob@two.example", "ann@one.example"]
    texts = [*told, told[0], *[f"{far} number {k}" for k in range(60)], *["bob@two.example"] * 2]
    rows = list(enumerate(texts))
    want = brute.terms(rows, 1 << 30, 0.9, 3, 0.99)
    assert sum(texts[i][a:b].lower() == "zaphod" for i, own in enumerate(want) for a, b, _ in own) == 9
    got = {r["id"]: r for r in pii.find(documents(spark, texts)).collect()}
    assert [[tuple(t) for t in got[i]["terms"]] for i in range(len(texts))] == want
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(documents(spark, texts)).collect()}
    assert clean == {i: brute.sanitised(t, want[i]) for i, t in rows}
    assert not any("zaphod" in t.lower() for t in clean.values())


def test_places_in_a_text_of_many_terms(spark):
    text = " ".join(f"é{'abc' * (k % 5)} 7" for k in range(3 * 256 + 1))
    df = documents(spark, [text, "", "one two three"])
    got = {r["doc_id"]: [(s.start, s.end, s.value) for s in r["t"]] for r in df.select("doc_id", pii.located(F.col("text"), pii.TERM).alias("t")).collect()}
    want = [(m.start(), m.end(), m[0]) for m in brute.regex.finditer(r"\p{L}{3,}", text)]
    assert len(want) > 2 * 256 and got == {0: want, 1: [], 2: [(0, 3, "one"), (4, 7, "two"), (8, 13, "three")]}


def test_terms_that_an_address_holds_or_cuts(spark):
    """Terms of the address alone do not tell; letters beside it that it cuts off do, as words of their own."""
    texts = [f"écoleann@one.exampleécole {k} zaphod" for k in range(4)] + ["ann@one.example and ann elsewhere", "bob@two.exampleébob@two.example bobby"] * 3
    texts += [f"x{k}@mail.example alone" for k in range(3)] + ["une école pour example", "zzécolea@b.cdé 1.2.3.4abcd"] * 3 + [f"plain words {k} of nothing" for k in range(50)]
    texts += ["+49 30 123456 78 caller", "caller +49 30 123456 78 +49 30 123456 78 end", "é+49 30 123456 78éàü caller"]
    rows = list(enumerate(texts))
    want = brute.terms(rows, 1 << 30, 0.9, 3, 0.99)
    got = {r["id"]: [tuple(t) for t in r["terms"]] for r in pii.find(documents(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == want and sum(map(len, want)) > 10


def test_a_list_of_addresses_takes_time_in_proportion(spark):
    """Three documents of many addresses and words: by classes of what stands in the same documents, not by their product."""
    import time

    took = []
    for k in (500, 2000):
        texts = [" ".join(f"user{j}@list.example word{'abcdefghij'[j % 10]}{'klmnopqrst'[j // 10 % 10]}{'uvwxyzabcd'[j // 100 % 10]}{'efghijklmn'[j // 1000]}{'xyz'[d]} common" for j in range(k)) for d in range(3)]
        texts += [f"other words {j} here" for j in range(60)]
        start = time.time()
        got = {r["id"]: [tuple(t) for t in r["terms"]] for r in pii.find(documents(spark, texts)).collect()}
        took.append(time.time() - start)
        if k == 500:
            assert [got[i] for i in range(len(texts))] == brute.terms(list(enumerate(texts)), 1 << 30, 0.9, 3, 0.99)
        assert sum(map(len, got.values())) == 3 * k
    assert took[1] < 4 * took[0] + 10
