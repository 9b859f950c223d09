"""Document quality by co-training.

Two classifiers see two views that share nothing. The text view has the content: the
shares of WORD_CELLS cells of hashed words, and shares of letters, digits, symbols and
repeats over the whole text. The metadata view has what is known of the page without
its text: source, language and the number of characters that its column states. Both
are logistic regressions fitted by Newton steps on a sample of labelled rows,
TRAIN_ROWS at most. In each round a classifier scores all unlabelled documents and
hands those it is sure of to the other one as pseudo-labels, as many of each class as
the labels have, and ROUND_ROWS at most a round; Model.taught tells how many. A
classifier that is sure of one class only hands nothing over, as that would only shift
the other's bias: a view that tells nothing of quality teaches nothing. On the labelled
rows that were held back, a quarter of each class, each view is calibrated and the
calibrated views are combined; the combination scores every document. No view counts
against its own opinion: one whose calibration or weight is not above 0 is left out, and
if both are, the score is the share of good labels.

Defined results: null text is empty, a null length is unknown; documents that are
labelled more than once take the lowest label; without both labels every score is 0.5
and every document is kept; the only row of a class is fitted on and calibrated on;
repeated rows come out repeated; extra columns are ignored.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.llm import common, ragged

#: Bounds of what is fitted on the driver: labelled rows, and pseudo-labels a round.
TRAIN_ROWS, ROUND_ROWS, ROUNDS = 20_000, 4_000, 2
SURE, SOURCES, LANGS, STEPS, KEEP = 0.98, 32, 8, 16, 0.5
SHAPES = ("letters", "digits", "spaces", "upper", "wide", "symbols", "word_length", "short_words", "distinct", "repeats", "pairs", "lines", "line_repeats", "ends", "bare")
WORD_CELLS = 256
VIEWS = ("text", "meta")
COLUMNS = {"text": "t", "meta": "m"}
WIDTHS = {"text": len(SHAPES) + WORD_CELLS, "meta": SOURCES + LANGS + STEPS}
#: Ids are drawn by their hash, so many values of it.
SCALE = 1 << 20
#: Rows that are in double precision at once in a Newton step, and rows that a task sends to the driver on average.
BLOCK = 1024
LOG = logging.getLogger(__name__)


def text_features(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row a text: SHAPES, then each cell's share of the words, lower-cased and hashed."""
    table = np.zeros((256, 7), dtype=np.int64)
    for k, codes in enumerate([[*range(65, 91), *range(97, 123)], range(48, 58), [32, *range(9, 14)], range(65, 91), range(128, 256), [c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"!?-()"], [ord(c) for c in ".!?"]]):
        table[list(codes), k] = 1
    starts, ends, row = ragged.words(data, at)
    word = ragged.hash_words(ragged.lower_ascii(data), starts, ends)
    size = ends - starts
    rows, out = len(at) - 1, np.zeros((len(at) - 1, len(SHAPES) + WORD_CELLS))
    for r in range(rows):
        text = data[at[r] : at[r + 1]]
        counts = np.bincount(text, minlength=256) @ table
        n, own, long = max(len(text), 1), word[row[r] : row[r + 1]], size[row[r] : row[r + 1]]
        k = max(len(own), 1)
        shown = np.unique(own)
        pair = np.unique(ragged.mix(own[:-1]) ^ own[1:]) if len(own) > 1 else own
        lines = text.tobytes().split(b"\n")
        symbols = counts[5]
        out[r, : len(SHAPES)] = [
            *(counts[:5] / n), symbols / n, long.mean() / 10 if len(long) else 0, (long <= 2).sum() / k, len(shown) / k ** 0.8, (own[1:] == own[:-1]).sum() / k, len(pair) / k, len(lines) / k, 1 - len(set(lines)) / len(lines), counts[6] / k, float(symbols == 0)
        ]
        out[r, len(SHAPES) :] = np.bincount((own >> np.uint64(56)).astype(np.int64), minlength=WORD_CELLS) / k
    return out


def _featured(docs: DataFrame) -> DataFrame:
    """(id, m, t): both views of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, at in ragged.slices(batch.column(0)):
                x = text_features(data, at).astype(np.float32)
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[1:]), pa.array(list(x), pa.list_(pa.float32()))], [*batch.schema.names[1:], "t"])

    return docs.select("text", "id", "m").mapInArrow(run, "id long, m array<float>, t array<float>")


def meta_features(source: Column, lang: Column, chars: Column) -> Column:
    """Source and language by hash, and the stated length in steps, all 0 or 1."""
    step = F.coalesce(F.least(F.floor(F.log2(F.greatest(chars, F.lit(1)).cast("double"))), F.lit(STEPS - 1)), F.lit(-1))
    hot = [(F.pmod(F.xxhash64(source), F.lit(SOURCES)), SOURCES), (F.pmod(F.xxhash64(lang), F.lit(LANGS)), LANGS), (step, STEPS)]
    return F.array(*[F.when(value == k, 1.0).otherwise(0.0).cast("float") for value, most in hot for k in range(most)])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Weights and, last, the bias, by Newton steps on standardised columns. Beside x it holds BLOCK rows in double precision."""
    cuts = [slice(at, at + BLOCK) for at in range(0, len(x), BLOCK)]
    mean = sum(x[c].sum(axis=0, dtype=float) for c in cuts) / len(x)
    sd = np.sqrt(sum(((x[c] - mean) ** 2).sum(axis=0) for c in cuts) / len(x)) + 1e-6
    w, pull = np.zeros(x.shape[1] + 1), np.append(np.full(x.shape[1], ridge), 1e-6)
    for _ in range(steps):
        slope, bend = -pull * w, np.diag(pull + 1e-9)
        for c in cuts:
            z = np.column_stack([(x[c] - mean) / sd, np.ones(len(y[c]))])
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            slope += z.T @ (y[c] - p)
            bend += (z * (p * (1 - p))[:, None]).T @ z
        move = np.linalg.solve(bend, slope)
        w += np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-6:
            break
    return np.append(w[:-1] / sd, w[-1] - (w[:-1] * mean / sd).sum())


@dataclass
class Model:
    """Weights of each view, its calibration, the combination, and what each view taught the other: (round, teacher, good rows, bad rows)."""

    weights: dict[str, np.ndarray]
    scale: dict[str, np.ndarray]
    both: np.ndarray
    taught: list[tuple[int, str, int, int]] = field(default_factory=list)


def _linear(column: str, w: np.ndarray) -> Column:
    weights = F.array(*[F.lit(float(v)) for v in w[:-1]])
    return F.aggregate(F.zip_with(F.col(column), weights, lambda x, v: x.cast("double") * v), F.lit(float(w[-1])), lambda a, b: a + b)


def _sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Arrays of one width, row by row, in the floats they are sent as: no number becomes an object of its own."""
    out = np.empty((len(column), width), np.float32)
    at = 0
    for chunk in column.chunks:
        out[at : at + len(chunk)] = chunk.flatten().to_numpy().reshape(-1, width)
        at += len(chunk)
    return out


def _drawn(rows: DataFrame, most: int, total: int, seen: tuple[str, ...] = VIEWS) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """At most so many rows, those whose id hashes lowest, in that order: labels and the views asked for."""
    place = F.pmod(F.xxhash64("id"), F.lit(SCALE))
    some = rows.where(place < int(SCALE * min(1.0, (most + 6 * most**0.5 + 10) / max(total, 1) + 0.001)))  # few more than wanted, so that few are sorted
    drawn = some.orderBy(place, "id").limit(most).select("y", "id", place.alias("place"), *(COLUMNS[v] for v in seen))
    got = drawn.repartition(-(-most // BLOCK)).toArrow()  # one task's result would be in the driver's memory several times at once
    order = pc.sort_indices(got.select(["place", "id"]), sort_keys=[("place", "ascending"), ("id", "ascending")], null_placement="at_start").to_numpy()
    return got["y"].to_numpy()[order], {v: matrix(got[COLUMNS[v]], WIDTHS[v])[order] for v in seen}


def held_back(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are fitted on and which are held back: of each class every fourth is, in the order given; a class's only row is both."""
    held = np.zeros(len(y), bool)
    for label in (0.0, 1.0):
        own = np.flatnonzero(y == label)
        held[own[::4]] = True
    lone = np.array([(y == v).sum() == 1 for v in y], bool)
    return ~held | lone, held


def combined(scale: dict[str, np.ndarray], logits: dict[str, np.ndarray], y: np.ndarray) -> np.ndarray:
    """Weights of the calibrated views, none below 0, and the bias."""
    left = [v for v in VIEWS if scale[v][0] > 0]
    while left:
        w = logistic(np.column_stack([logits[v] * scale[v][0] + scale[v][1] for v in left]), y, ridge=0.01)
        if (w[:-1] > 0).all():
            own = dict(zip(left, w, strict=False))
            return np.array([*(own.get(v, 0.0) for v in VIEWS), w[-1]])
        left.remove(left[int(np.argmin(w[:-1]))])
    return np.array([0.0, 0.0, np.log(y.mean() / (1 - y.mean()))])


def co_train(own: tuple[np.ndarray, dict[str, np.ndarray]], share: float, sure_of: Callable[[str, np.ndarray], tuple[int, int]], draw: Callable[[str, np.ndarray, str, int, int], tuple[np.ndarray, np.ndarray]], *, rounds: int, most: int) -> tuple[dict[str, np.ndarray], list[tuple[int, str, int, int]]]:
    """Weights of both views after some rounds, and what was taught.

    sure_of(view, w) tells how many unlabelled documents the view takes for good and for
    bad with certainty, draw(view, w, pupil, good, bad) fetches so many of them as the pupil sees them.
    """
    given, taught = {v: (own[0], own[1][v]) for v in VIEWS}, []
    for k in range(rounds):
        weights = {v: logistic(given[v][1], given[v][0]) for v in VIEWS}
        for teacher, pupil in (VIEWS, VIEWS[::-1]):
            good, bad = sure_of(teacher, weights[teacher])
            size = min(most, good / max(share, 1e-3), bad / max(1 - share, 1e-3))
            good, bad = (max(1, int(size * share)), max(1, int(size * (1 - share)))) if good and bad else (0, 0)
            if good:
                y, x = draw(teacher, weights[teacher], pupil, good, bad)
                given[pupil] = np.concatenate([given[pupil][0], y]), np.concatenate([given[pupil][1], x])
            taught.append((k, teacher, good, bad))
            LOG.info("round %d: the %s view teaches %d good and %d bad documents", *taught[-1])
    return {v: logistic(given[v][1], given[v][0]) for v in VIEWS}, taught


def views(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", chars_col: str = "n_chars", quality_col: str = "quality") -> DataFrame:
    """(id, y, t, m): label, or null, and both views of every document; a table without the column of lengths has unknown ones."""
    common.small_batches(df.sparkSession)
    chars = df[chars_col] if chars_col in df.columns else F.lit(None).cast("long")
    docs = df.select(df[id_col].cast("long").alias("id"), df[text_col].alias("text"), meta_features(df[source_col], df[lang_col], chars).alias("m"))
    known = common.only(labels, id=id_col, y=quality_col).where("y in (0, 1) and id is not null").groupBy(F.col("id").cast("long").alias("id")).agg(F.min("y").cast("double").alias("y"))
    return common.saved(_featured(docs).join(known, "id", "left"), "features")


def fit(table: DataFrame, *, rounds: int = ROUNDS, train_rows: int = TRAIN_ROWS, round_rows: int = ROUND_ROWS) -> Model | None:
    """A model of the views; None if the labels lack a class."""
    total = table.agg(F.count("y").alias("labelled"), F.sum("y").alias("good")).first()
    y, x = _drawn(table.where("y is not null"), train_rows, total["labelled"])
    if len(set(y)) < 2:
        return None
    fitted, held = held_back(y)

    def sure(view: str, w: np.ndarray) -> DataFrame:
        scored = table.where("y is null").withColumn("p", _sigmoid(_linear(COLUMNS[view], w)))
        return scored.where((F.col("p") >= SURE) | (F.col("p") <= 1 - SURE)).withColumn("y", F.when(F.col("p") >= SURE, 1.0).otherwise(0.0))

    found: dict[float, int] = {}

    def sure_of(view: str, w: np.ndarray) -> tuple[int, int]:
        found.clear()
        found.update({r["y"]: r["n"] for r in sure(view, w).groupBy("y").agg(F.count("*").alias("n")).collect()})
        return found.get(1.0, 0), found.get(0.0, 0)

    def draw(view: str, w: np.ndarray, pupil: str, good: int, bad: int) -> tuple[np.ndarray, np.ndarray]:
        rows = sure(view, w)
        parts = [_drawn(rows.where(F.col("y") == label), n, found[label], (pupil,)) for label, n in ((1.0, good), (0.0, bad))]
        return np.concatenate([y for y, _ in parts]), np.concatenate([x[pupil] for _, x in parts])

    own = y[fitted], {v: x[v][fitted] for v in VIEWS}
    weights, taught = co_train(own, total["good"] / total["labelled"], sure_of, draw, rounds=rounds, most=round_rows)
    # Calibrate each view, then combine the calibrated views, on the rows held back.
    logits = {v: x[v][held] @ weights[v][:-1] + weights[v][-1] for v in VIEWS}
    scale = {v: logistic(logits[v][:, None], y[held], ridge=0.01) for v in VIEWS}
    return Model(weights, scale, combined(scale, logits, y[held]), taught)


def score(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", chars_col: str = "n_chars", quality_col: str = "quality", *, rounds: int = ROUNDS, train_rows: int = TRAIN_ROWS, round_rows: int = ROUND_ROWS) -> DataFrame:
    """(id, p_text, p_meta, score, kept): one row a document; kept at a score of KEEP or more."""
    table = views(df, labels, id_col, text_col, source_col, lang_col, chars_col, quality_col)
    model = fit(table, rounds=rounds, train_rows=train_rows, round_rows=round_rows)
    if model is None:
        return table.select("id", *(F.lit(0.5).alias(c) for c in ("p_text", "p_meta", "score")), F.lit(True).alias("kept"))
    z = {v: _linear(COLUMNS[v], model.weights[v]) * float(model.scale[v][0]) + float(model.scale[v][1]) for v in VIEWS}
    a, b, c = map(float, model.both)
    out = table.select("id", z["text"].alias("zt"), z["meta"].alias("zm")).select("id", _sigmoid(F.col("zt")).alias("p_text"), _sigmoid(F.col("zm")).alias("p_meta"), _sigmoid(F.col("zt") * a + F.col("zm") * b + c).alias("score"))
    return out.withColumn("kept", F.col("score") >= KEEP)
