"""Secrets in whole texts.

An Aho-Corasick automaton over all spellings of the keywords passes once over a text;
only where it hits is a regular expression tried, anchored at the hit. Long runs of
hex digits have no keyword: one pattern finds runs of 24 and more.
Tokens that carry their own checksum (a prefix, 30 base-62 characters and the CRC-32 of
these in 6 more) count only when it holds.

Matches of a kind are leftmost and do not overlap; a match that fails its test still
uses up its text. Null and empty texts have no spans; extra columns are ignored;
repeated rows come out repeated. Offsets are in code points, the end exclusive.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.llm import common

# Keywords, patterns and least lengths.
KINDS = ("assign", "access", "hex", "checked")
KEYWORDS = {"assign": ("password", "passwd", "secret", "token", "apikey", "api_key"), "access": ("AKIA",), "checked": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")}
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CHECKED = re.compile(r"(?:gh[pousr]|npm)_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
LEAST_VALUE, LEAST_ACCESS = 6, 20
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62(number: int, width: int = 6) -> str:
    out = ""
    for _ in range(width):
        number, digit = divmod(number, 62)
        out = BASE62[digit] + out
    return out


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for word in words:
            spellings = itertools.product(*({c.lower(), c.upper()} for c in word)) if kind == "assign" else [word]
            for spelling in spellings:
                found.add_word("".join(spelling), (kind, len(word)))
    found.make_automaton()
    return found


def spans(text: str) -> list[tuple[int, int, str]]:
    """(start, rank of the kind, end) of every secret, in order."""
    out, ends = [], dict.fromkeys(KINDS, 0)
    for last, (kind, size) in automaton().iter(text):
        start = last - size + 1
        if start < ends[kind]:
            continue
        if kind == "assign" and (m := ASSIGN.match(text, start)):
            ends[kind] = m.end()
            if m.end(1) - m.start(1) >= LEAST_VALUE:
                out.append((start, 0, m.end()))
        elif kind == "access" and (m := ACCESS.match(text, start)):
            ends[kind] = m.end()
            if m.end() - start >= LEAST_ACCESS:
                out.append((start, 1, m.end()))
        elif kind == "checked" and (m := CHECKED.match(text, start)) and base62(zlib.crc32(m[1].encode())) == m[2]:
            ends[kind] = m.end()
            out.append((start, 3, m.end()))
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def secret_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans): an array of (kind, start, end) by start, then by kind as in KINDS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans(t)] if t else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))], ["id", "spans"])

    common.small_batches(df.sparkSession)
    docs = common.only(df, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long"))
    return docs.mapInArrow(run, "id long, spans array<struct<kind:string,start:long,end:long>>")
