"""How filters interact: every order of the filters is replayed over every document.

A document's failures are one bit a filter. The documents' flags are crossed with the
broadcast orders (factorial of the filters, 120 for five, whatever the input), the first
failing step is worked out once an order, and the five steps are exploded and counted
under their conditions. The counts are combined on the map side, so that what is
shuffled is a row a part, order and step from each task. A text is read once: its flags,
a few bytes, are saved.

Filters: A under 100 words; B under 80 percent distinct words; C over 10 percent
capitals A to Z; D one of #$%&*|; E identical to the text of a smaller id, removed or
not. Words are maximal runs outside space and \\x09-\\x0D, case-sensitive. Texts with
equal SHA-256 are identical; only the digest is moved.

Defined results: a null text is empty, a null part is the empty string; a null id is
smaller than none and has no smaller one; rows that share an id are documents of their
own and do not precede each other; several labels of an id count once, as good or toxic
if any is; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skeinwork.llm import common

LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10
LETTERS = "ABCDE"


def own_failures(text: Column, words: Column) -> list[Column]:
    """What a text fails by itself, A to D; words are its words in order."""
    n = F.size(words)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [n < LEAST_WORDS, 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * n, 100 * capitals > MOST_CAPITALS * F.length(text), text.rlike(r"[#$%&*|]")]


def failures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(id, part, fails): a bit a filter, A the lowest; one row a document."""
    docs = common.only(df, id=id_col, text=text_col, part=part_col).withColumns({"text": F.coalesce("text", F.lit("")), "part": F.coalesce(F.col("part").cast("string"), F.lit(""))})
    split = docs.withColumn("words", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    own = sum((F.when(fails, 1 << k).otherwise(0) for k, fails in enumerate(own_failures(F.col("text"), F.col("words")))), F.lit(0))
    flags = common.saved(split.select("id", "part", own.cast("int").alias("own"), F.unhex(F.sha2("text", 256)).alias("digest")), "flags")
    firsts = flags.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = F.coalesce(F.col("id") > F.col("first"), F.lit(False))
    return flags.join(firsts, "digest", "left").select("id", "part", (F.col("own") + F.when(again, 1 << 4).otherwise(0)).cast("int").alias("fails"))


def orders(spark: SparkSession, letters: str = LETTERS) -> DataFrame:
    """(filter_order, bits): every order of the letters, with the bit of each step's filter."""
    rows = [("".join(order), [1 << letters.index(x) for x in order]) for order in permutations(letters)]
    return spark.createDataFrame(rows, "filter_order string, bits array<int>")


def replay(flagged: DataFrame, letters: str = LETTERS) -> DataFrame:
    """Counts by part, order and step of documents (part, fails, good, toxic)."""
    steps = range(1, len(letters) + 1)
    fails, bit, step, first = (F.col(c) for c in ("fails", "bit", "step", "first"))
    bits = [F.element_at("bits", k) for k in steps]
    found = F.coalesce(*[F.when(fails.bitwiseAND(b) != 0, k) for k, b in zip(steps, bits, strict=True)], F.lit(len(letters) + 1))
    crossed = flagged.crossJoin(F.broadcast(orders(flagged.sparkSession, letters))).withColumn("first", found)
    stepped = crossed.select("part", "fails", "good", "toxic", "filter_order", "first", F.posexplode("bits").alias("at", "bit")).withColumn("step", F.col("at") + 1)
    removed = first == step
    counts = stepped.groupBy("part", "filter_order", "step").agg(
        F.count_if(first > step).alias("kept"),
        F.count_if(removed).alias("removed"),
        F.count_if((fails.bitwiseAND(bit) != 0) & (first < step)).alias("redundant"),
        F.count_if(fails == bit).alias("unique_fails"),
        F.count_if(removed & F.col("good")).alias("good_lost"),
        F.count_if(removed & F.col("toxic")).alias("toxic_lost"),
    )
    lettered = counts.withColumn("letter", F.col("filter_order").substr(step, F.lit(1)))
    return lettered.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter"))).drop("letter")


def audit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", quality_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): 600 rows a part."""
    marks = common.only(labels, id=id_col, quality=quality_col, toxic=toxic_col).groupBy("id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    flagged = failures(df, id_col, text_col, part_col).join(marks, "id", "left")
    return replay(flagged.select("part", "fails", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]))
