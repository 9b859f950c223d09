"""Filter audit, shards, spelling variants, each against a plain version."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from skeinwork.llm import audit, queries, sharding, spelling, sql
from tests import compare
from tests.llm.test_text import ODD, SF

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, rows):
    """Rows (doc_id, text, lang, source) with columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, 1, "clash", 2) for r in rows], "doc_id long, text string, lang string, source string, id int, part string, piece int")


def audited(rows, labels):
    out = Counter()
    firsts = {}
    for i, t, *_ in rows:
        if i is not None:
            firsts[t or ""] = min(firsts.get(t or "", i), i)
    good, toxic = ({i for i, q, x in labels if (q, x)[k] == 1} for k in (0, 1))
    parts = {lang or "" for _, _, lang, _ in rows}
    shapley = Counter()
    for i, t, lang, _ in rows:
        t, part = t or "", lang or ""
        w = SPACE.findall(t)
        bad = {x for x, fails in zip("ABCDE", [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and i > firsts.get(t, i)], strict=True) if fails}
        for order in permutations("ABCDE"):
            gone = None
            for step, x in enumerate(order, 1):
                key = part, "".join(order), step
                out[*key, "unique_fails"] += bad == {x}
                if x in bad and gone is None:
                    gone = step
                    out[*key, "removed"] += 1
                    out[*key, "good_lost"] += i in good
                    out[*key, "toxic_lost"] += i in toxic
                    shapley[part, x] += 1
                elif x in bad:
                    out[*key, "redundant"] += 1
                out[*key, "kept"] += gone is None
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
    return {(p, "".join(o), s): [*[out[p, "".join(o), s, n] for n in names], shapley[p, o[s - 1]]] for p in parts for o in permutations("ABCDE") for s in range(1, 6)}


def test_audit_by_brute_force(spark):
    words = " ".join(f"word{k}" for k in range(120))
    rows = [(k, t, "en" if k % 3 else None, "s") for k, t in enumerate([*ODD, words, words, words + " #", "ABC " * 130, words.upper(), None, "", words])]
    rows += [(None, words, "fr", None), (3, "shared id", "fr", None), (3, "shared id", "", None)]
    labels = [(k, k % 2, int(k % 5 == 0)) for k in range(0, 30, 2)] + [(14, 1, None), (14, None, 1), (None, 1, 1)]
    marks = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, part string")
    df = documents(spark, rows)
    got = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in audit.audit(df, marks).collect()}
    assert got == audited(rows, labels)
    assert audit.audit(df.where("false"), marks).count() == 0
    assert audit.audit(df, marks.where("false")).agg(F.sum("good_lost")).first()[0] == 0


@pytest.mark.parametrize("name", ["op11_filter_audit", "op13_spelling_variants"])
def test_queries_against_sql(spark, name):
    assert not compare.differences(spark, queries.queries()[name], sql.oracle_sql()[name], SF)


def check_shards(rows, found, shards):
    """Every row once, slots gapless; bytes of each shard: a cut goes wrong by half a point, a few times over."""
    assert Counter(f[0] for f in found) == Counter(r[0] for r in rows)
    slots, size = defaultdict(list), Counter()
    for _, n, shard, slot in found:
        slots[shard].append(slot)
        size[shard] += n
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
    target = sum(size.values()) / shards
    largest = max(len((r[1] or "").encode()) + 8 for r in rows)
    assert all(abs(size[s] - target) <= 2 * max(largest, target / sharding.PIECES) for s in range(shards))


def test_shards_of_the_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    found = queries.op12_sharding(spark, SF).collect()
    texts = {r[0]: r[1] or "" for r in rows}
    for r in found:
        assert r["size"] == len(texts[r["doc_id"]].encode()) + 8 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode())
        assert r["law"] == "bytes" and r["grown_shard"] is None
    check_shards(rows, [(r["doc_id"], r["size"], r["shard"], r["slot"]) for r in found], 24)


def test_shards_of_odd_tables(spark):
    many = [(k, f"text {k} " * (k % 7), "en", f"s{k % 5}") for k in range(600)]
    odd = [(1000 + k, t, None, None) for k, t in enumerate(ODD) if len(t or "") < 1000]
    hot = [(2000 + k, "the same text in a third of all rows", f"l{k % 3}", "hot") for k in range(300)]
    rows = [*many, *odd, *hot, (None, "no id", "en", "x"), (5, "again", "en", "x"), (5, "again", "en", "x")]
    found = [(r["id"], r["size"], r["shard"], r["slot"]) for r in sharding.kd_shards(documents(spark, rows), 6).collect()]
    check_shards(rows, found, 6)
    pair = [(1, "one text", "en", "a"), (2, "one text", "de", "b"), (3, "other text of more", "en", "a"), (4, "a third text", "fr", "c")] * 8
    whole = sharding.kd_shards(documents(spark, [(k, *r[1:]) for k, r in enumerate(pair)]), 1)
    assert {r["shard"] for r in whole.collect()} == {0}
    few = sharding.kd_shards(documents(spark, [(1, "only", "en", "a")]), 24).collect()
    assert [(r["size"], r["slot"]) for r in few] == [(12, 0)]
    assert sharding.kd_shards(documents(spark, rows).where("false"), 4).count() == 0
    assert {r["shard"] for r in sharding.kd_shards(documents(spark, rows), target_bytes=1 << 30).collect()} == {0}


def test_copies_share_a_shard(spark):
    """Groups under a 64th of a shard are never cut, whatever their rows' metadata."""
    rows = [(k, f"{k % 1500} is a text that {'stands ' * (k % 4)}here twice", f"l{k % 7}", f"s{k % 11}") for k in range(3000)]
    found = {r["id"]: r["shard"] for r in sharding.kd_shards(documents(spark, rows), 4).collect()}
    assert all(found[k] == found[k + 1500] for k in range(0, 1500) if k % 4 == (k + 1500) % 4)


def forms(rows, slip=spelling.SLIP, least=spelling.LEAST_COUNT):
    count = Counter()
    for i, t, *_ in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{i}:{run}".encode()) if i is not None else 1
            at = h % len(run)
            count[run[:at] + run[at + 1 :] if h % slip == 0 else run] += 1
    n = {w: c for w, c in count.items() if len(w) >= 5 and c >= least}
    near = defaultdict(set)

    def links(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        short, long = sorted((a, b), key=len)
        return len(long) == len(short) + 1 and any(long[:k] + long[k + 1 :] == short for k in range(len(long)))

    words = sorted(n)
    for k, a in enumerate(words):
        for b in words[:k]:
            if links(a, b):
                near[a].add(b)
                near[b].add(a)
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None

    def last(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (form[w], last(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in words}


WORDS = ["abcdef", "abcdeg", "abcdefg", "bcdefg", "aabcdef", "abcde", "Éclair", "éclair", "eclair", "aaaaa", "aaaaaa", "aaaaaaa", "abcdefghijkl", "abcdefghijkm", "abcdefghijkll", "abcdefghjikl", "Zebras", "zebra", "zebrä", "straße", "strasse", "nothing"]


@pytest.mark.parametrize(("depth", "block"), [(6, 4096), (3, 2)])
def test_variants_by_brute_force(spark, depth, block):
    """Few levels and small blocks send words through several stages, blocks and look-ups; the result is the same."""
    rows = [(k, " ".join(f"{w} " * (k % 7 + 1 > j % 5) for j, w in enumerate(WORDS[k % 3 :] + [WORDS[k % len(WORDS)]] * (k % 9))), "en", "s") for k in range(60)]
    rows += [(100 + k, t, None, None) for k, t in enumerate(ODD) if len(t or "") < 1000] + [(None, "abcdef zebra " * 5, None, None)]
    rows += [(7, "x" * 9000 + " " + "x" * 8999, None, None)] * 3 + [(300, "chainaa " * 4 + "chainab " * 9 + "chainbb " * 20, "en", "s")]
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.variants(documents(spark, rows), depth=depth, block=block).collect()}
    assert got == forms(rows)
    assert any(v[0] for v in got.values()) and any(v[0] != v[1] for v in got.values() if v[0])


def test_variants_of_empty_tables(spark):
    df = documents(spark, [(1, None, None, None), (2, "", None, None), (3, "rare words only", None, None)])
    assert spelling.variants(df).count() == 0 and spelling.variants(df.where("false")).count() == 0
