"""Personal data, and the terms around it that give it away, with Spark expressions only.

Base spans: e-mail addresses, IP addresses, card and phone numbers by fixed patterns,
leftmost and without overlap per kind; a match that fails its test uses up its text.

Terms: every base value is a protected entity. Over the whole corpus, the documents
with an entity (all of them, whether or not a term stands beside it), with a term, and
with both (the term anywhere outside the entity's own span) give the information that
the term has about it. A term discloses an entity if

    log2(p(entity, term) / (p(entity) p(term))) >= ALPHA * -log2 p(entity)

and at least LEAST_DOCUMENTS documents have them together; equality counts. An entity
that every document holds is no secret, and nothing discloses it. Terms that tell nearly
all (p(entity | term) >= REMOVE) are removed, others generalised, wherever they stand in
a document that holds the entity. Documents without an entity have no terms to lose.
Only texts with an entity of LEAST_DOCUMENTS documents are moved, and only terms that
stand with one are counted. Counts are combined before every shuffle; joins on an entity
or term that a large part of all documents have are ordinary equi-joins, which adaptive
execution splits.

A text's terms are found once, each with its first end and its last start, and not once
an entity. Entities that stand in the same documents are one class, and so are such
terms: documents are counted by two classes, of which a contact list or an archive has
few, and only those that can reach the threshold. What an entity's own span holds or
cuts off is counted apart, a few terms a span, and corrects the counts.

Defined results: null and empty texts have no spans; rows that share an id are told
apart by their text; equal rows get equal spans and count one by one; extra columns are
ignored, whatever their names. Offsets are in code
points, the end exclusive.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.llm import common, exact

# Kinds in order and patterns. The possessive forms match what the plain
# ones do, without recursion or a second try at the same run of characters.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GUARDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: WINDOW is longer than any text: terms count wherever they stand. A lesser one bounds which terms count, not what is replaced.
WINDOW, LEAST_DOCUMENTS, ALPHA, REMOVE = 1 << 30, 3, 0.9, 0.99
#: What falls short of the threshold by so little reaches it: rounding decides nothing.
TIE = 1e-9
TERM = r"\p{L}{3,}"
SPAN = "array<struct<start:int,rank:int,end:int,value:string>>"


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, n + 1 - i, F.lit(1)).cast("int") * (2 - i % 2)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: str, span: Column) -> Column:
    value = span.value
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        digits = _digits(value)
        return F.length(digits).between(14, 19) & luhn(digits)
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def located(text: Column, pattern: str, rank: int = 0) -> Column:
    """All matches of a pattern as (start, rank, end, value): what lies between them gives their places."""

    def laid(found: Column) -> Column:
        matches = found.matches
        gaps = F.slice(found.gaps, F.lit(1), F.size(matches))
        at = common.before(F.zip_with(gaps, matches, lambda g, m: F.length(g) + F.length(m)))
        starts = F.zip_with(at, gaps, lambda a, g: a + F.length(g))
        return F.zip_with(starts, matches, lambda a, m: F.struct(a.alias("start"), F.lit(rank).alias("rank"), (a + F.length(m)).alias("end"), m.alias("value")))

    return common.bound(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("matches"), F.split(text, pattern, -1).alias("gaps")), laid)


def base_spans(text: Column) -> Column:
    """All base spans by start, then kind."""
    found = []
    for rank, kind in enumerate(KINDS):
        likely = F.contains(text, F.lit(GUARDS[kind])) if GUARDS[kind] else F.lit(True)
        if kind == "card":
            likely = text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}")
        if kind == "ip":
            likely = text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")
        spans = F.filter(located(text, PATTERNS[kind], rank), partial(_valid, kind))
        found.append(F.when(likely, spans).otherwise(F.array().cast(SPAN)))
    return F.array_sort(F.concat(*found))


def _around(text: Column, span: Column, window: int) -> Column:
    """What lies within a window on either side of a span, less what the window cuts."""
    low, high = F.greatest(span.start - window, F.lit(0)), span.end + window
    before = F.substr(text, low + 1, span.start - low)
    after = F.substr(text, span.end + 1, F.lit(window))
    before = F.when(low > 0, F.regexp_replace(before, r"^\S+", "")).otherwise(before)
    return F.array(before, F.when(F.length(text) > high, F.regexp_replace(after, r"\S*$", "")).otherwise(after))


def _terms_with(text: Column, spans: Column, window: int) -> Column:
    """The different terms that stand with the spans of one entity, outside one of them at least."""
    around = F.flatten(F.transform(spans, lambda s: _around(text, s, window)))
    return F.array_distinct(F.flatten(F.transform(around, lambda x: F.transform(F.array_distinct(F.regexp_extract_all(x, F.lit(TERM), F.lit(0))), F.lower))))


def _pieces(text: Column, spans: Column, mark: Callable[[Column, Column], Column]) -> Column:
    """The text with mark(span, end of those before) in place of each span, in order of their starts; what an earlier span covers is gone."""

    def joined(at: Column) -> Column:
        kept = F.zip_with(spans, at, lambda s, a: F.concat(F.substr(text, a + 1, F.greatest(s.start - a, F.lit(0))), mark(s, a)))
        end = F.aggregate(spans, F.lit(0), lambda a, s: F.greatest(a, s.end))
        return F.concat(F.array_join(kept, ""), F.substr(text, end + 1))

    return common.bound(common.before(F.transform(spans, lambda s: s.end), combine=F.greatest), joined)


def _blanked(text: Column, base: Column) -> Column:
    """The text with spaces in place of its base spans."""
    return _pieces(text, base, lambda s, at: F.repeat(F.lit(" "), F.greatest(s.end - F.greatest(s.start, at), F.lit(0))))


def _touched(text: Column) -> Column:
    """The addresses of a text as (start, end, value, left, right): the letters that run up to an address and on from it."""
    last, first, whole = r"(?<!\p{L})\p{L}++\z", r"\A\p{L}++", r"\A\p{L}*+\z"
    one = lambda c, p: F.regexp_extract(c, p, 0)

    def sides(found: Column) -> Column:
        spans, gaps = found.spans, found.gaps

        def told(s: Column, k: Column) -> Column:
            gap, after = F.get(gaps, k), F.get(gaps, k + 1)
            left = F.when(gap.rlike(whole) & (k > 0), F.concat(one(F.get(spans, k - 1).value, last), gap)).otherwise(one(gap, last))
            right = F.when(after.rlike(whole) & (k + 1 < F.size(spans)), F.concat(after, one(F.get(spans, k + 1).value, first))).otherwise(one(after, first))
            return F.struct(s.start.alias("start"), s.end.alias("end"), s.value.alias("value"), left.alias("left"), right.alias("right"))

        return F.transform(spans, told)

    return common.bound(F.struct(located(text, PATTERNS["email"]).alias("spans"), F.split(text, PATTERNS["email"], -1).alias("gaps")), sides)


def entity(span: Column) -> Column:
    """What a span protects: kind and value, numbers by their digits."""
    return F.concat(F.element_at(F.array(*map(F.lit, KINDS)), span.rank + 1), F.lit(":"), F.when(span.rank >= 2, _digits(span.value)).otherwise(F.lower(span.value)))


def scanned(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, text) of every row."""
    docs = common.only(df, id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    return docs.select("id", exact.row_key(F.col("id"), F.col("text")).alias("key"), "text")


def holding(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(key, text, copies) of each text that one of the pairs (key, copies) names, equal rows once: no other text is moved."""
    held = common.saved(pairs.groupBy("key").agg(F.max("copies").alias("copies")), "held")
    texts = common.among(docs.select("key", "text"), "key", held.select("key")).dropDuplicates(["key"])
    return texts.join(held, "key").select("key", "text", "copies")


def _with_term(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n_term): the documents of each of the terms, among all."""
    every = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)))).alias("term"))
    return common.likely(every, "term", terms).groupBy("term").agg(F.count("*").alias("n_term"))


def _told(total: int, alpha: float, least: int, remove: float) -> Column:
    """The action of n_both, n_term and n_entity; null if the term does not tell enough."""
    told = F.log2(F.col("n_both") * F.lit(float(total)) / (F.col("n_term") * F.col("n_entity")))
    enough = (F.col("n_both") >= least) & (told >= alpha * F.log2(F.lit(float(total)) / F.col("n_entity")) - TIE)
    return F.when(enough, F.when(F.col("n_both") / F.col("n_term") >= remove, "remove").otherwise("generalise"))


def near_terms(docs: DataFrame, pairs: DataFrame, total: int, *, window: int, alpha: float, least: int, remove: float) -> tuple[DataFrame, DataFrame]:
    """(owner, term, action), and (key, owner) of the documents, with entities as owners: terms count within a window of their spans."""
    held = holding(docs, pairs).select("key", "text", "copies", base_spans(F.col("text")).alias("base"))
    own = held.join(pairs.select("key", "entity"), "key").select("entity", "copies", "text", F.filter("base", lambda s: entity(s) == F.col("entity")).alias("spans"))
    rows = own.select("entity", "copies", F.explode(_terms_with(F.col("text"), F.col("spans"), window)).alias("term"))
    counts = common.saved(rows.groupBy("entity", "term").agg(F.sum("copies").alias("n_both")).where(F.col("n_both") >= least), "counts")
    known = counts.join(_with_term(docs, counts.select("term").distinct()), "term").join(pairs.select("entity", "n_entity").distinct(), "entity")
    told = known.select(F.col("entity").alias("owner"), "term", _told(total, alpha, least, remove).alias("action")).where("action is not null")
    return told, pairs.select("key", F.col("entity").alias("owner"))


def _classed(rows: DataFrame, name: str, copies: Column) -> DataFrame:
    """(name, class, held): what stands in the same documents (key) is of one class; held counts them."""
    h = F.xxhash64("key")
    return rows.groupBy(name).agg(F.concat_ws(":", F.count("*"), F.bit_xor(h), F.sum(F.shiftright(h, 32)), F.bit_xor(F.xxhash64(F.lit(1), "key"))).alias("class"), F.sum(copies).alias("held"))


def _own_terms(held: DataFrame, pairs: DataFrame, places: DataFrame) -> DataFrame:
    """(entity, term, change, piece): terms that stand with an entity only in its own spans (less), and pieces of words that a span cuts off (more)."""
    spans = held.select("key", "copies", F.explode(_touched(F.col("text"))).alias("s")).withColumn("entity", F.concat(F.lit(f"{KINDS[0]}:"), F.lower("s.value")))
    spans = spans.join(pairs.select("key", "entity"), ["key", "entity"]).select("key", "entity", "copies", "s.*")
    ends = spans.groupBy("key", "entity", "copies").agg(F.max("start").alias("ls"), F.min("end").alias("fe"), F.max_by("left", "start").alias("left"), F.min_by("right", "start").alias("right"))
    within = F.regexp_extract_all(F.concat("left", "value", "right"), F.lit(TERM), F.lit(0))
    inside = spans.select("key", "entity", F.explode(F.transform(within, F.lower)).alias("term")).distinct().join(ends.drop("left", "right"), ["key", "entity"])
    pieces = F.array_distinct(F.transform(F.filter(F.array("left", "right"), lambda x: F.length(x) >= 3), F.lower))
    cut = ends.select("key", "entity", "copies", "ls", "fe", F.explode(pieces).alias("term"))
    seen = F.coalesce((F.col("first") <= F.col("ls")) | (F.col("last") >= F.col("fe")), F.lit(False))
    of = places.select("key", "term", "first", "last")
    less = inside.join(of, ["key", "term"]).where(~seen).select("entity", "term", (-F.col("copies")).alias("change"), F.lit(0).alias("piece"))
    more = cut.join(of, ["key", "term"], "left").where(~seen).select("entity", "term", F.col("copies").alias("change"), F.col("copies").alias("piece"))
    return less.unionByName(more).groupBy("entity", "term").agg(F.sum("change").alias("change"), F.sum("piece").cast("long").alias("piece"))


def far_terms(docs: DataFrame, pairs: DataFrame, total: int, *, alpha: float, least: int, remove: float) -> tuple[DataFrame, DataFrame]:
    """(owner, term, action), and (key, owner) of the documents, with classes of entities as owners: terms count wherever they stand."""
    held = common.saved(holding(docs, pairs), "texts")
    words = held.select("key", "copies", F.explode(located(F.col("text"), TERM)).alias("t"))
    places = common.saved(words.groupBy("key", F.lower("t.value").alias("term")).agg(F.max("copies").alias("copies"), F.min("t.end").alias("first"), F.max("t.start").alias("last")), "places")
    own = common.saved(_own_terms(held, pairs, places), "own")
    classes = _classed(pairs, "entity", F.col("copies")).drop("held").withColumnRenamed("class", "owner")
    entities = common.saved(classes.join(pairs.select("entity", "n_entity").distinct(), "entity"), "classes")
    owners = common.saved(pairs.select("key", "entity", "copies").join(entities.select("entity", "owner"), "entity").select("key", "owner", "copies").distinct(), "owners")
    whole = _classed(places, "term", F.col("copies"))
    support = whole.join(own.groupBy("term").agg(F.sum("piece").alias("piece")), "term", "full").where(F.coalesce("held", F.lit(0)) + F.coalesce("piece", F.lit(0)) >= least)
    terms = common.saved(support.select("term", "class").join(_with_term(docs, support.select("term")), "term"), "terms")
    # No pair of classes is counted that could not reach the threshold in all documents of the entity.
    need = entities.groupBy("owner").agg(F.min(alpha * F.log2(F.lit(float(total)) / F.col("n_entity"))).alias("need"), F.max("n_entity").alias("n_entity"), F.count("*").alias("n_entities"))
    most = terms.groupBy("class").agg(F.max(F.log2(F.lit(float(total)) / F.col("n_term"))).alias("most"))
    sides = owners.join(need.select("owner", "need"), "owner"), places.join(terms.select("term", "class"), "term").select("key", "class").distinct().join(most, "class")
    both = sides[0].join(sides[1], "key").where(F.col("most") >= F.col("need") - 2 * TIE).groupBy("owner", "class").agg(F.sum("copies").alias("n_both"))
    both = common.saved(both, "counts")
    action = _told(total, alpha, least, remove)
    known = both.where(F.col("n_both") >= least).join(terms, "class").join(need.drop("need"), "owner").withColumn("action", action).where("action is not null")
    changed = own.join(entities, "entity").join(terms, "term").join(both, ["owner", "class"], "left").withColumn("n_both", F.coalesce("n_both", F.lit(0)) + F.col("change"))
    changed = changed.withColumn("action", action).groupBy("owner", "term").agg(F.count("*").alias("n_changed"), F.max("action").alias("changed"))
    told = known.select("owner", "term", "action", "n_entities").join(changed, ["owner", "term"], "full")
    told = told.select("owner", "term", F.greatest(F.when(F.coalesce("n_changed", F.lit(0)) < F.col("n_entities"), F.col("action")), "changed").alias("action"))
    return told.where("action is not null"), owners.select("key", "owner")


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, window: int = WINDOW, alpha: float = ALPHA, least: int = LEAST_DOCUMENTS, remove: float = REMOVE) -> DataFrame:
    """(id, key, base, terms): base spans, and terms as (start, end, action) that touch none of them; one row a document."""
    docs = scanned(df, id_col, text_col)
    spans = common.saved(docs.select("id", "key", base_spans(F.col("text")).alias("base")), "spans")
    pairs = common.saved(spans.where(F.size("base") > 0).select("key", F.explode(F.array_distinct(F.transform("base", entity))).alias("entity")).groupBy("key", "entity").agg(F.count("*").alias("copies")), "entities")
    total = spans.count()
    # An entity of fewer documents than least has no term together with it in as many.
    protected = pairs.groupBy("entity").agg(F.sum("copies").alias("n_entity")).where((F.col("n_entity") >= least) & (F.col("n_entity") < total))
    pairs = common.saved(pairs.join(protected, "entity"), "protected")
    limits = {"alpha": alpha, "least": least, "remove": remove}
    told, owners = far_terms(docs, pairs, total, **limits) if window >= WINDOW else near_terms(docs, pairs, total, window=window, **limits)
    due = common.saved(owners.join(told, "owner").groupBy("key", "term").agg(F.max("action").alias("action")), "told")
    own = holding(docs, due.select("key", F.lit(1).alias("copies")))
    words = own.select("key", F.explode(located(_blanked(F.col("text"), base_spans(F.col("text"))), TERM)).alias("t"))
    hits = words.select("key", F.lower("t.value").alias("term"), F.col("t.start").alias("start"), F.col("t.end").alias("end")).join(due, ["key", "term"])
    terms = hits.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "end", "action"))).alias("terms"))
    return spans.join(terms, "key", "left").select("id", "key", "base", F.coalesce("terms", F.array().cast("array<struct<start:int,end:int,action:string>>")).alias("terms"))


def sanitised(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits: float) -> DataFrame:
    """The rows of df, texts with every span replaced: base spans by their kind, terms by [TERM] or nothing."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    found = find(df, id_col, text_col, **limits).where("size(base) + size(terms) > 0").dropDuplicates(["key"])
    marks = F.concat(F.transform("base", lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), F.element_at(names, s.rank + 1).alias("mark"))), F.transform("terms", lambda t: F.struct(t.start.alias("start"), t.end.alias("end"), F.when(t.action == "remove", "").otherwise("[TERM]").alias("mark"))))
    key, own = common.unused(df, "key", "marks")
    marks = found.select(F.col("key").alias(key), F.array_sort(marks).alias(own))
    keyed = df.withColumn(key, exact.row_key(F.col(id_col), F.col(text_col)))
    text = F.col(text_col)

    clean = _pieces(text, F.col(own), lambda m, at: F.when(m.start < at, "").otherwise(m.mark))
    out = keyed.join(marks, key, "left")
    return out.withColumn(text_col, F.when(F.col(own).isNull(), text).otherwise(clean)).select(df.columns)
