"""Spelling variants: words at an edit distance of one, by a trie that is joined with itself.

The vocabulary is a table of trie nodes, a row a prefix, dealt by prefix. A node's
active nodes are those at distance one: its siblings (a code point replaced) and, one
level further down, the nodes that have the same end after one more code point
(inserted). From there both nodes go down together by equal code points, a level a
round, so that a pair lives only as long as both tries have the path; two terminal
nodes of a pair are two near words. Pairs are generated where the words part, so each
is found once, and a node has no more active nodes than its alphabet and depth allow.

After DEPTH levels the pairs that still live look up the words under the smaller of
their nodes with the other's prefix. Words that share DEPTH code points part further
down: a prefix of at most BLOCK words is one trie in a task, many of them a call;
larger ones go DEPTH levels further by the same rounds.

A word's form is its near word with the most occurrences, if it has RATIO times its
own; its root follows the forms to the last. Each form has RATIO times as many
occurrences, so that chains have no circle and few steps, of which each round skips
half.

Defined results: a null text has no words; without an id nothing is deleted from a run;
repeated rows count each; ties of forms go to the smallest word in code-point order;
words of any length count; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.llm import common

RUN = r"[A-Za-zÀ-ÿ]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH, LEAST_COUNT, RATIO, SLIP = 5, 3, 2, 97
DEPTH, BLOCK = 6, 4096


def lowered(run: Column) -> Column:
    """Only A to Z in lower case. Runs of one byte a code point, nearly all, take the short way."""
    return F.when(F.octet_length(run) == F.length(run), F.lower(run)).otherwise(F.translate(run, CAPITALS, SMALL))


def slipped(id_: Column, run: Column, slip: int = SLIP) -> Column:
    """The run without the code point that its digest with the id names, where the slip divides the digest."""
    h = F.crc32(F.concat(id_.cast("string"), F.lit(":"), run))
    at = (h % F.length(run)).cast("int")
    return F.when(h % slip == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, slip: int = SLIP) -> DataFrame:
    """(word, n): words of all texts with their occurrences, counted before they are shuffled."""
    docs = common.only(df, id=id_col, text=text_col)
    runs = docs.select("id", F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run")).where(F.length("run") >= least_length)
    words = runs.select("id", lowered(F.col("run")).alias("run")).select(slipped(F.col("id"), F.col("run"), slip).alias("word"))
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def nodes(words: DataFrame, base: int, depth: int) -> DataFrame:
    """(node, k, parent, above, c, b, n, word): prefixes of base to base + depth + 1 code points; c and b are the last code points, n the words below."""
    ends = F.sequence(F.lit(base), F.least(F.length("word"), F.lit(base + depth + 1)))
    rows = words.select("word", F.explode(ends).alias("k")).select(F.substring("word", F.lit(1), F.col("k")).alias("node"), "k", (F.length("word") == F.col("k")).alias("word"))
    found = rows.groupBy("node", "k").agg(F.count("*").alias("n"), F.max("word").alias("word"))
    cut = lambda by: F.substring("node", F.lit(1), F.col("k") - by)
    return found.select("node", "k", F.when(F.col("k") > base, cut(1)).alias("parent"), F.when(F.col("k") > base + 1, cut(2)).alias("above"), F.substring("node", F.col("k"), F.lit(1)).alias("c"), F.substring("node", F.col("k") - 1, F.lit(1)).alias("b"), "n", "word")


def parted(trie: DataFrame, base: int, depth: int) -> tuple[DataFrame, DataFrame]:
    """Where words part: pairs (p, a, k, np, na, wp, wa) of active nodes, and words (a, b) that end there."""
    left = trie.where(F.col("k") <= base + depth).select(F.col("node").alias("p"), "k", F.col("parent").alias("top"), F.col("c").alias("cp"), F.col("n").alias("np"), F.col("word").alias("wp"))
    right = trie.select(F.col("node").alias("a"), "parent", "above", F.col("c").alias("ca"), F.col("b").alias("cb"), F.col("n").alias("na"), F.col("word").alias("wa"), F.col("k").alias("ka"))
    columns = ["p", "a", "k", "np", "na", "wp", "wa"]
    replaced = left.join(right.where(F.col("ka") <= base + depth), (F.col("top") == F.col("parent")) & (F.col("cp") < F.col("ca"))).select(columns)
    inserted = left.join(right, (F.col("top") == F.col("above")) & (F.col("cp") == F.col("ca")) & (F.col("cb") != F.col("cp"))).select(columns)
    ended = left.where("wp").join(right.where(F.col("wa") & (F.col("ka") <= base + depth)), F.col("p") == F.col("parent")).select(F.col("p").alias("a"), F.col("a").alias("b"))
    return replaced.unionByName(inserted), ended


def lower_down(live: DataFrame, trie: DataFrame) -> DataFrame:
    """Active pairs one level down: both nodes go on by the same code point."""
    own = trie.select(F.col("parent").alias("p"), F.col("node").alias("p1"), F.col("n").alias("np"), F.col("word").alias("wp"), "c")
    other = trie.select(F.col("node").alias("a1"), F.col("n").alias("na"), F.col("word").alias("wa"))
    down = live.select("p", "a", "k").join(own, "p").withColumn("a1", F.concat("a", "c")).join(other, "a1")
    return down.select(F.col("p1").alias("p"), F.col("a1").alias("a"), (F.col("k") + 1).alias("k"), "np", "na", "wp", "wa")


def looked_up(live: DataFrame, words: DataFrame, length: int) -> DataFrame:
    """Near words (a, b) below pairs of length (and, of an insertion, one more) code points: those under the smaller node, with the other prefix."""
    small = F.col("np") <= F.col("na")
    pairs = live.select(F.when(small, F.col("p")).otherwise(F.col("a")).alias("near"), F.when(small, F.col("a")).otherwise(F.col("p")).alias("far"))
    under = words.select("word", F.explode(F.array(F.lit(length), F.lit(length + 1))).alias("k")).where(F.length("word") > F.col("k"))
    under = under.select("word", F.substring("word", F.lit(1), F.col("k")).alias("near"), F.substring("word", F.col("k") + 1, F.length("word")).alias("rest"))
    made = pairs.join(under, "near").select(F.col("word").alias("a"), F.concat("far", "rest").alias("b"))
    return made.join(words.select(F.col("word").alias("b")), "b").select("a", "b")


def near_in_block(words: list[str], depth: int) -> list[tuple[str, str]]:
    """Near words among sorted, different words that share depth code points: the trie of the block, node by node where it branches."""
    out, todo = [], [(0, len(words), depth)]
    while todo:
        lo, hi, at = todo.pop()
        if hi - lo < 2:
            continue
        first, last = words[lo], words[hi - 1]
        most = min(len(first), len(last))
        while at < most and first[at] == last[at]:
            at += 1
        inner = lo + (len(first) == at)  # a word that ends at this node comes first
        below: dict[str, list[int]] = {}
        for i in range(inner, hi):
            below.setdefault(words[i][at + 1 :], []).append(i)
        for same in below.values():  # siblings: one code point replaced
            out += [(words[i], words[j]) for i, j in combinations(same, 2)]
        for i in range(lo, hi):  # one code point inserted
            out += [(words[i], words[j]) for j in below.get(words[i][at:], ()) if i < inner or words[i][at] != words[j][at]]
        start = inner
        for i in range(inner + 1, hi + 1):
            if i == hi or words[i][at] != words[start][at]:
                todo.append((start, i, at + 1))
                start = i
    return out


def in_blocks(words: DataFrame, small: DataFrame, depth: int, block: int) -> DataFrame:
    """Near words (a, b) that share depth code points, in prefixes (node, n) of at most block words; a call has many of them."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        for _, own in rows.groupby("node", sort=False)["word"]:
            found += near_in_block(sorted(own), depth)
        return pd.DataFrame(found, columns=["a", "b"], dtype="object")

    calls = max(1, math.ceil((small.agg(F.sum("n")).first()[0] or 0) / block))
    held = words.where(F.length("word") >= depth).select("word", F.substring("word", F.lit(1), F.lit(depth)).alias("node")).join(small.select("node"), "node")
    return held.groupBy(F.pmod(F.xxhash64("node"), F.lit(calls)).alias("call")).applyInPandas(run, "a string, b string")


def near_words(words: DataFrame, depth: int = DEPTH, block: int = BLOCK) -> DataFrame:
    """(a, b): all pairs of words (word) at an edit distance of exactly one, each once, in either order."""
    left, base, found = words.select("word"), 0, []
    while True:
        trie = common.saved(nodes(left, base, depth), "trie")
        seeds, ended = parted(trie, base, depth)
        seeds = common.saved(seeds, "seeds")
        found.append(common.saved(ended, "near"))
        live = seeds.where(F.col("k") == base + 1)
        for k in range(base + 1, base + depth + 1):
            if k > base + 1:
                live = common.saved(lower_down(live, trie).unionByName(seeds.where(F.col("k") == k)), "live")
            found.append(live.where("wp and wa").select(F.col("p").alias("a"), F.col("a").alias("b")))
        base += depth
        found.append(common.saved(looked_up(live, left, base), "near"))
        shared = trie.where((F.col("k") == base) & (F.col("n") > 1)).select("node", "n")
        found.append(common.saved(in_blocks(left, shared.where(F.col("n") <= block), base, block), "near"))
        large = shared.where(F.col("n") > block).select("node")
        if large.isEmpty():
            break
        left = common.saved(left.where(F.length("word") >= base).withColumn("node", F.substring("word", F.lit(1), F.lit(base))).join(large, "node").select("word"), "words")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def roots(links: DataFrame) -> DataFrame:
    """(word, root): the last word that the links (word, form) lead to; links have no circle."""
    known = links.select("word", F.col("form").alias("root"))
    while True:
        further = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = common.saved(known.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        known = step.select("word", "root")
        if step.where("moved").isEmpty():
            return known


def variants(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, ratio: int = RATIO, depth: int = DEPTH, block: int = BLOCK, **limits: int) -> DataFrame:
    """(word, n, n_near, form, form_n, root): one row a word."""
    words = common.saved(vocabulary(df, id_col, text_col, **limits), "vocabulary")
    pairs = common.saved(near_words(words, depth, block), "pairs")
    both = pairs.union(pairs.select("b", "a"))
    best = F.min(F.struct((-F.col("n")).alias("least"), F.col("b").alias("word")))
    near = both.join(words.select(F.col("word").alias("b"), "n"), "b").groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), best.alias("best"))
    told = words.join(near, "word", "left").withColumn("form_n", -F.col("best.least"))
    formed = F.col("form_n") >= ratio * F.col("n")
    forms = common.saved(told.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("best.word")).alias("form"), F.when(formed, F.col("form_n")).alias("form_n")), "forms")
    last = roots(forms.where("form is not null").select("word", "form"))
    return forms.join(last, "word", "left").withColumn("root", F.coalesce("root", "word"))
