"""Near-duplicate documents by one-permutation hashing.

A document's distinct five-word shingles are hashed once; the hash picks a bin and
the least hash of a bin is its value. Empty bins borrow from a full bin along a
random probe order of their own (optimal densification). Bands of bins give bucket
keys. In a bucket every class of equal sets is a candidate of the bucket's smallest
one only, a star, so that candidates grow with the documents and not with the square
of a group. Candidates are confirmed on their full sets.

A star misses a link between two members of a bucket that both lie outside its hub's
component. Buckets whose members are still in several components therefore get a
second look: their members are dealt into blocks of bounded size, a task holds one
block's full sets, computes all their similarities at once and emits only links that
join components of its block, a forest, so that what leaves it grows with the members
and not with their pairs.

Where a bucket has several blocks and still several components, its members in
different blocks have yet to meet, and most of them are unlike. A prefix filter tells
which may be alike: shingles are put in one order, rare ones first (by their counts over
all these members, kept in a table of CELLS cells), and two sets that reach the
threshold share one of their first n - ceil(threshold * n) + 1. So members meet by such
a shingle in place of the bucket, the groups of equal members once, again in blocks; only
a group that itself has several blocks and components has the members outside its
largest component meet those of the other blocks. The order decides how few meet, not
which links are found: no pair of a bucket is left out.

Defined results: null text is empty; empty texts link with nothing; rows that share
an id link with whatever any of them links with; a row whose id is null stays alone,
has no component and is kept; extra columns are ignored. Ties go to the smallest id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.llm import common, ragged

WORDS, BANDS, ROWS, PERCENT = 5, 32, 5, 85
#: A block of the second look: members, and shingles of all its members, that a task is to hold, on average at most.
BLOCK, BLOCK_ITEMS = 512, 1 << 18
#: Columns of the table of members by shingles that are multiplied at once.
STEP = 4096
#: Cells in which the shingles of crowded buckets are counted, to put rare ones first.
CELLS = 1 << 18


def shingles(data: np.ndarray, at: np.ndarray, width: int = WORDS) -> list[np.ndarray]:
    """Each row's distinct hashed shingles in ascending order; fewer words than width make one shingle."""
    data = ragged.lower_ascii(data)
    starts, ends, row = ragged.words(data, at)
    word = ragged.hash_words(data, starts, ends)
    count = np.diff(row)
    first = ragged.spread(row[:-1], np.maximum(count - width + 1, 0))
    run = ragged.mix(word[first]) if first.size else np.empty(0, np.uint64)
    for k in range(1, width):
        run = ragged.mix(run ^ word[first + k])
    end = np.cumsum(np.maximum(count - width + 1, 0))
    out = []
    for r, n in enumerate(count.tolist()):
        if n >= width:
            one = np.sort(run[end[r] - n + width - 1 : end[r]])
            keep = np.empty(len(one), bool)
            keep[0] = True
            np.not_equal(one[1:], one[:-1], out=keep[1:])
            out.append(one[keep])
        else:
            chain = word[row[r] : row[r + 1]]
            one = ragged.mix(chain[:1])
            for k in range(1, n):
                one = ragged.mix(one ^ chain[k])
            out.append(one)
    return out


def probes(bins: int, seed: int = 1) -> np.ndarray:
    """The order in which an empty bin looks for a full one: a random permutation for each bin."""
    return np.argsort(np.random.default_rng(seed).random((bins, bins)), axis=1)


def band_keys(sets: list[np.ndarray], bands: int, rows: int, order: np.ndarray) -> np.ndarray:
    """Bucket keys of non-empty sets, one a band."""
    bins = bands * rows
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    cell = owner * bins + ((flat >> np.uint64(40)) * np.uint64(bins) >> np.uint64(24)).astype(np.int64)
    lead = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    value = np.zeros(len(sets) * bins, dtype=np.uint64)
    value[cell[lead]] = flat[lead]
    full = np.zeros(len(sets) * bins, dtype=bool)
    full[cell[lead]] = True
    value, full = value.reshape(-1, bins), full.reshape(-1, bins)
    who, empty = np.nonzero(~full)
    for k in range(bins):
        if not who.size:
            break
        source = order[empty, k]
        hit = full[who, source]
        value[who[hit], empty[hit]] = value[who[hit], source[hit]]
        who, empty = who[~hit], empty[~hit]
    value = value.reshape(-1, bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), value.shape[:2])
    for k in range(rows):
        key = ragged.mix(key ^ value[:, :, k])
    return key.view(np.int64)


def sketch(df: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """(id, n, node, bands): set size, digest of the set, bucket keys; node and bands are null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = probes(bands * rows)
        for batch in batches:
            for a, b, data, at in ragged.slices(batch.column(1)):
                sets = shingles(data, at, width)
                some = [k for k, x in enumerate(sets) if len(x)]
                node = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in sets]
                keys = iter(band_keys([sets[k] for k in some], bands, rows, order)) if some else iter(())
                lists = [next(keys) if len(x) else None for x in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([len(x) for x in sets], pa.int64()), pa.array(node, pa.binary()), pa.array(lists, pa.list_(pa.int64()))], ["id", "n", "node", "bands"])

    return df.select("id", "text").mapInArrow(run, "id long, n long, node binary, bands array<long>")


def full_sets(df: DataFrame, width: int) -> DataFrame:
    """(id, items): the distinct hashed shingles as ascending unsigned 64-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, at in ragged.slices(batch.column(1)):
                items = [x.tobytes() for x in shingles(data, at, width)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(items, pa.binary())], ["id", "items"])

    return df.select("id", "text").mapInArrow(run, "id long, items binary")


def confirmed(df: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are alike enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(s.as_buffer(), dtype=np.uint64) for s in (left, right))
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    keep.append(False)
                    continue
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    texts = common.among(df, "id", ids)
    sets = common.saved(full_sets(texts, width), "sets")
    both = pairs.join(sets.select(F.col("id").alias("b"), F.col("items").alias("y")), "b").join(sets.select(F.col("id").alias("a"), F.col("items").alias("x")), "a")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long").distinct()


def overlaps(sets: list[np.ndarray], split: int) -> np.ndarray:
    """How many elements each of the first split sets shares with each of the others."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = count > 1  # an element of a single set is shared by none
    column = np.cumsum(several) - 1
    keep = several[place]
    owner, place = owner[keep], column[place[keep]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    out = np.zeros((split, len(sets) - split))
    for low in range(0, int(several.sum()), STEP):
        a, b = np.searchsorted(place, [low, low + STEP])
        table = np.zeros((len(sets), STEP), np.float32)
        table[owner[a:b], place[a:b] - low] = 1
        out += table[:split] @ table[split:].T
    return out


def joining(sets: list[np.ndarray], labels: np.ndarray, split: int, percent: int) -> list[tuple[int, int]]:
    """A forest of the links between the first split sets and the others that join different labels."""
    size = np.array([len(x) for x in sets])
    shared = overlaps(sets, split)
    near = 100 * shared >= percent * (size[:split, None] + size[None, split:] - shared)
    names, label = np.unique(labels, return_inverse=True)
    x, y = np.nonzero(near & (label[:split, None] != label[None, split:]))
    y = y + split
    # One link for each two labels is enough.
    lo, hi = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
    _, first = np.unique(lo * len(names) + hi, return_index=True)
    top = list(range(len(names)))

    def root(n: int) -> int:
        while top[n] != n:
            top[n] = top[top[n]]
            n = top[n]
        return n

    out = []
    for i, j in zip(x[first].tolist(), y[first].tolist(), strict=True):
        a, b = root(int(label[i])), root(int(label[j]))
        if a != b:
            top[a] = b
            out.append((i, j))
    return out


def _compared(dealt: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) found in the blocks (bucket, i, j); rows are (bucket, i, j, rep, label, side): side 0 is compared with side 1, side 2 with itself."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["side", "rep"])
        rep, label, side = (rows[c].to_numpy() for c in ("rep", "label", "side"))
        own = [np.frombuffer(x, np.uint64) for x in rows["items"]]
        split = int((side == 0).sum())
        if (side == 2).all():
            split, own, rep, label = len(own), own + own, np.concatenate([rep, rep]), np.concatenate([label, label])
        found = joining(own, label, split, percent) if 0 < split < len(own) else []
        return pd.DataFrame([(min(rep[x], rep[y]), max(rep[x], rep[y])) for x, y in found], columns=["a", "b"], dtype="int64")

    return dealt.join(sets.withColumnRenamed("id", "rep"), "rep").groupBy("bucket", "i", "j").applyInPandas(run, "a long, b long").distinct()


def _mixed(members: DataFrame, labels: DataFrame, sizes: DataFrame) -> DataFrame:
    """Members (bucket, rep) of buckets that lie in several components: (bucket, rep, label, n, blocks, own)."""
    label = labels.select(F.col("node").alias("rep"), "label")
    placed = members.select("bucket", "rep").join(sizes, "rep").join(label, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_ITEMS)).cast("int")
    mixed = placed.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), blocks.alias("blocks")).where("lo <> hi").select("bucket", "blocks")
    return placed.join(mixed, "bucket").withColumn("own", F.pmod(F.xxhash64("bucket", "rep"), F.col("blocks")).cast("int"))


def rarity(sets: DataFrame) -> np.ndarray:
    """How often shingles of the sets (rep, items) fall into each of CELLS cells; a table of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = np.concatenate([np.empty(0, np.uint64), *(np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(1))])
            cell, n = np.unique(items % np.uint64(CELLS), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int64)), pa.array(n.astype(np.int64))], ["cell", "n"])

    found = sets.select("rep", "items").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(CELLS, np.int64)
    out[found["cell"].to_numpy()] = found["n"].to_numpy()
    return out


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(bucket, rep): the shingles of each set (rep, items) of which two sets that reach the threshold share one."""
    counts = sets.sparkSession.sparkContext.broadcast(rarity(sets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, own = batch.column(0).to_numpy(), []
            for x in batch.column(1):
                items = np.frombuffer(x.as_buffer(), np.uint64)
                order = np.lexsort((items, counts.value[items % np.uint64(CELLS)]))
                own.append(items[order[: len(items) + (-percent * len(items)) // 100 + 1]])
            lengths = [len(x) for x in own]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.uint64), *own]).view(np.int64)), pa.array(np.repeat(ids, lengths))], ["bucket", "rep"])

    return sets.select("rep", "items").mapInArrow(run, "bucket long, rep long")


def _once(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (bucket, rep) of buckets that lie in several components; of buckets with the same members one."""
    label = labels.select(F.col("node").alias("rep"), "label")
    placed = rows.join(label, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    own = F.xxhash64("rep")
    told = placed.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("k"), F.bit_xor(own).alias("x"), F.sum(F.shiftright(own, 32)).alias("y"))
    first = told.where("lo <> hi").groupBy("k", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket")
    return common.among(rows, "bucket", first)


def _within(opened: DataFrame, sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Labels after the links inside the blocks of each bucket."""
    own = opened.select("bucket", F.col("own").alias("i"), F.col("own").alias("j"), "rep", "label", F.lit(2).alias("side"))
    return common.joined(labels, common.saved(_compared(own, sets, percent), "links"))


def _across(left: DataFrame, sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Labels after the links between the blocks of each bucket: its largest component stays in its blocks, the others go to all of them."""
    main = left.groupBy("bucket", "label").agg(F.count("*").alias("k")).groupBy("bucket").agg(F.max_by("label", F.struct("k", "label")).alias("main"))
    left = left.join(main, "bucket").withColumn("loose", F.col("label") != F.col("main"))
    decks = left.where("loose").groupBy("bucket").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_ITEMS)).cast("int").alias("decks"))
    left = left.join(decks, "bucket")
    staying = left.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("decks") - 1))).select("bucket", F.col("own").alias("i"), "j", "rep", "label", F.lit(0).alias("side"))
    going = left.where("loose").withColumn("j", F.pmod(F.xxhash64("rep", "bucket"), F.col("decks")).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("i <> own")
    going = going.select("bucket", "i", "j", "rep", "label", F.lit(1).alias("side"))
    return common.joined(labels, common.saved(_compared(staying.unionByName(going), sets, percent), "links"))


def second_look(members: DataFrame, labels: DataFrame, sizes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Labels after all links between members of one bucket that stars have left in different components."""
    members = members.where("rep <> hub")
    opened = common.saved(_mixed(members, labels, sizes), "opened")
    if opened.isEmpty():
        return labels
    sets = common.saved(full_sets(common.among(docs, "id", opened.select("rep").distinct()), width), "sets")
    labels = _within(opened, sets, labels, percent)
    crowded = members.join(opened.where("blocks > 1").select("bucket").distinct(), "bucket", "left_semi")
    left = common.saved(_mixed(crowded, labels, sizes).select("rep").distinct(), "left")
    if left.isEmpty():
        return labels
    own = common.saved(common.among(sets.withColumnRenamed("id", "rep"), "rep", left), "sets")
    rows = common.saved(prefixes(own, percent), "prefixes")
    groups = common.saved(_mixed(_once(rows, labels), labels, sizes), "opened")
    labels = _within(groups, sets, labels, percent)
    rest = common.saved(_mixed(groups.where("blocks > 1"), labels, sizes), "left")
    return labels if rest.isEmpty() else _across(rest, sets, labels, percent)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = WORDS, bands: int = BANDS, rows: int = ROWS, percent: int = PERCENT) -> DataFrame:
    """(id, n, component, kept): one row a document; documents link at 100 * shared >= percent * union."""
    spark = df.sparkSession
    common.small_batches(spark)
    docs = common.only(df, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long"))
    sketched = common.saved(sketch(docs, width, bands, rows), "sketch")
    named = sketched.where("id is not null and node is not null")
    classes = common.saved(named.groupBy("node").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands")), "classes")
    entries = classes.select("rep", F.explode("bands").alias("bucket"))
    hubs = entries.groupBy("bucket").agg(F.min("rep").alias("hub"), F.count("*").alias("n")).where("n > 1").select("bucket", "hub")
    members = common.saved(entries.join(hubs, "bucket"), "members")
    stars = members.where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    named_docs = docs.where("id is not null")
    links = common.saved(confirmed(named_docs, common.saved(stars, "stars"), width, percent), "links")
    labels = second_look(members, common.components(links), classes.select("rep", "n"), named_docs, width, percent)
    placed = classes.select("node", "rep").join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").select("node", F.coalesce("label", "rep").alias("component"))
    # Rows that share an id belong together even where their sets differ.
    out = sketched.select("id", "n", "node").join(placed, "node", "left").withColumn("component", F.when(F.col("id").isNotNull(), F.coalesce("component", "id")))
    return out.select("id", "n", "component", F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))

