"""Language of whole texts by a byte convolutional network.

A text is cut into windows of WINDOW bytes. A window's bytes are embedded, filters of
several widths pass over them, each filter's maximum over the window is kept, and a
softmax over these gives the languages. The network is trained in numpy on the driver
with windows from TRAIN_DOCUMENTS labelled documents at most, spread over the languages
(of more languages than documents, the most frequent); a text's score is the mean over its windows, weighted by their bytes.

Defined results: the language is und, with score 0, if the text is null, empty or has
no letter; without labelled rows everything is und; repeated rows come out repeated;
extra columns are ignored. Equal scores go to the language first in order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinwork.llm import common, ragged

WINDOW, WIDTHS, FILTERS, EMBED = 256, (2, 3, 4, 5), 8, 8
#: Bounds of the labelled sample: documents, one of each language at least, and windows of each document.
TRAIN_DOCUMENTS, TRAIN_WINDOWS = 6000, 2
EPOCHS, BATCH, RATE = 5, 128, 0.01
UNKNOWN = "und"


@dataclass
class Network:
    languages: list[str]
    embed: np.ndarray  # (256, EMBED)
    filters: np.ndarray  # (widest * EMBED, all filters); narrow filters end in zeros
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def patches(self, windows: np.ndarray) -> np.ndarray:
        """(windows, positions, widest * EMBED) of windows that are widest - 1 bytes longer than their positions."""
        x = self.embed[windows]
        n, size, e = x.shape
        width = len(self.filters) // e
        view = np.lib.stride_tricks.as_strided(x, (n, size - width + 1, width * e), (x.strides[0], x.strides[1], x.strides[2]))
        return np.ascontiguousarray(view)

    def pooled(self, windows: np.ndarray) -> np.ndarray:
        x = self.patches(windows)
        y = (x.reshape(-1, x.shape[2]) @ self.filters).reshape(x.shape[0], x.shape[1], -1)
        return np.maximum(y.max(axis=1) + self.bias, 0)

    def scores(self, windows: np.ndarray, step: int = 64) -> np.ndarray:
        done = [self.pooled(windows[k : k + step]) @ self.out + self.out_bias for k in range(0, len(windows), step)]
        z = np.concatenate(done)
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def cut(data: np.ndarray, at: np.ndarray, size: int = WINDOW, more: int = max(WIDTHS) - 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all rows (case folded; bytes beyond a row are 0), each one's row, and how many bytes it has."""
    data, length = fold_case(data), np.diff(at)
    count = -(-length // size)
    row = np.repeat(np.arange(len(length)), count)
    start = at[:-1][row] + size * (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count))
    left = at[1:][row] - start
    padded = np.concatenate([data, np.zeros(size + more, np.uint8)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, size + more)[start]
    short = left < size + more
    if short.any():
        windows[short] *= (np.arange(size + more)[None, :] < left[short][:, None]).astype(np.uint8)
    return windows, row, np.minimum(left, size)


def fold_case(data: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and for the Latin letters that UTF-8 writes as C3 80 to C3 9E."""
    out = ragged.lower_ascii(data)
    out[1:] += (32 * ((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97))).astype(np.uint8)
    return out


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], *, epochs: int = EPOCHS, seed: int = 3) -> Network:
    """Fit by Adam on the cross-entropy; only the positions of the maxima carry a gradient."""
    rng = np.random.default_rng(seed)
    width, total = max(WIDTHS), FILTERS * len(WIDTHS)
    used = np.concatenate([np.repeat(np.arange(width) < w, EMBED)[:, None].repeat(FILTERS, axis=1) for w in WIDTHS], axis=1).astype(np.float32)
    net = Network(
        languages,
        rng.standard_normal((256, EMBED), dtype=np.float32) * 0.5,
        rng.standard_normal((width * EMBED, total), dtype=np.float32) * 0.2 * used,
        np.zeros(total, np.float32),
        rng.standard_normal((total, len(languages)), dtype=np.float32) * 0.2,
        np.zeros(len(languages), np.float32),
    )
    net.embed[0] = 0
    values = [net.embed, net.filters, net.bias, net.out, net.out_bias]
    first, second, t = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values], 0
    for epoch in range(epochs):
        order = rng.permutation(len(windows))
        for k in range(0, len(order), BATCH):
            take = order[k : k + BATCH]
            bytes_, n = windows[take], len(take)
            x = net.patches(bytes_)
            y = (x.reshape(-1, x.shape[2]) @ net.filters).reshape(n, x.shape[1], total)
            best = y.argmax(axis=1)
            top = np.take_along_axis(y, best[:, None, :], axis=1)[:, 0] + net.bias
            hidden = np.maximum(top, 0)
            z = hidden @ net.out + net.out_bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(n), labels[take]] -= 1
            p /= n
            back = (p @ net.out.T) * (top > 0)
            patch = x[np.arange(n)[:, None], best]  # (n, filters, width * EMBED)
            d_filters = np.einsum("nf,nfd->df", back, patch) * used
            d_patch = (back[:, :, None] * net.filters.T[None, :, :]).reshape(n, total, width, EMBED)
            d_embed = np.zeros_like(net.embed)
            where = bytes_[np.arange(n)[:, None, None], best[:, :, None] + np.arange(width)]
            np.add.at(d_embed, where, d_patch)
            d_embed[0] = 0
            t += 1
            rate = RATE * (1 - 0.9 * epoch / epochs)
            for v, d, m, s in zip(values, [d_embed, d_filters, back.sum(axis=0), hidden.T @ p, p.sum(axis=0)], first, second, strict=True):
                m += 0.1 * (d - m)
                s += 0.001 * (d * d - s)
                v -= rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    return net


def labelled_windows(docs: DataFrame, documents: int, windows: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows from a bounded sample of (id, text, lang) rows: the ids that hash lowest, as many of each language."""
    counts = docs.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(documents).collect()
    languages = sorted(r["lang"] for r in counts)
    if not languages:
        return np.empty((0, WINDOW + max(WIDTHS) - 1), np.uint8), np.empty(0, np.int64), []
    each, scale = -(-documents // len(languages)), 1 << 20
    rate = docs.sparkSession.createDataFrame([(r["lang"], int(scale * min(1.0, 1.2 * each / r["n"] + 0.001))) for r in counts], "lang string, rate long")
    drawn = docs.join(F.broadcast(rate), "lang").where(F.pmod(F.xxhash64("id"), F.lit(scale)) < F.col("rate"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, at in ragged.slices(batch.column(1)):
                cuts, row, _ = cut(data, at)
                first = np.searchsorted(row, np.arange(b - a + 1))
                out = []
                for r in range(b - a):
                    n = first[r + 1] - first[r]
                    for k in range(min(n, windows)):
                        out.append((a + r, cuts[first[r] + k * n // windows if n > windows else first[r] + k].tobytes()))
                rows = pa.array([x for x, _ in out], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(2).take(rows), pa.array([x for _, x in out], pa.binary())], ["id", "lang", "window"])

    sample = drawn.select("id", "text", "lang").mapInArrow(run, "id long, lang string, window binary")
    rows = sample.orderBy(F.xxhash64("id"), "id", "window").limit(documents * windows).toArrow()
    cuts = np.frombuffer(b"".join(rows["window"].to_pylist()), np.uint8).reshape(len(rows), -1)
    place = {x: k for k, x in enumerate(languages)}
    return cuts, np.array([place[x] for x in rows["lang"].to_pylist()], np.int64), languages


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, documents: int = TRAIN_DOCUMENTS, windows: int = TRAIN_WINDOWS) -> Network | None:
    """A network from the rows of df whose language is known; df holds the training rows only."""
    common.small_batches(df.sparkSession)
    docs = common.only(df, id=id_col, text=text_col, lang=lang_col).where("lang is not null and text is not null").withColumn("id", F.col("id").cast("long"))
    cuts, labels, languages = labelled_windows(docs, documents, windows)
    return train(cuts, labels, languages) if len(cuts) else None


def predict(df: DataFrame, net: Network | None, text_col: str = "text", *, lang_out: str = "lang_pred", score_out: str = "lang_score") -> DataFrame:
    """The rows of df with language and score; columns of these names in df give way."""
    ascii_letter = np.zeros(256, dtype=bool)
    ascii_letter[65:91] = ascii_letter[97:123] = True
    docs = df.drop(lang_out, score_out)
    place = docs.columns.index(text_col)

    def lettered(data: np.ndarray) -> bool:
        return any(map(str.isalpha, data.tobytes().decode("utf-8", "replace")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, at in ragged.slices(batch.column(place)):
                names, best = [UNKNOWN] * (b - a), np.zeros(b - a)
                if net is not None and data.size:
                    cuts, row, size = cut(data, at)
                    sums = np.zeros((b - a, len(net.languages)))
                    np.add.at(sums, row, net.scores(cuts) * size[:, None])
                    sums /= np.maximum(np.diff(at), 1)[:, None]
                    pick = sums.argmax(axis=1)
                    seen = np.concatenate([[0], np.cumsum(ascii_letter[data])])[at]
                    for r in range(b - a):
                        if seen[r + 1] > seen[r] or lettered(data[at[r] : at[r + 1]]):
                            names[r], best[r] = net.languages[pick[r]], min(1.0, float(sums[r, pick[r]]))
                columns = [c.slice(a, b - a) for c in batch.columns]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(names, pa.string()), pa.array(best)], [*batch.schema.names, lang_out, score_out])

    common.small_batches(df.sparkSession)
    schema = T.StructType([*docs.schema.fields, T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType())])
    return docs.mapInArrow(run, schema)
