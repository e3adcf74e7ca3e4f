"""Secrets: strings of fixed kinds, and strings that a primed compressor cannot make smaller.

Three kinds are found by pattern. Further candidates are long runs of token characters that follow a sensitive word. A
compressor that knows the identifiers of the corpus, and is given the text around a candidate first, says how many bytes
the candidate adds: names, paths and repeated values add few, random keys nearly one a character. Candidates that add most
of their length are reported as ``novel``.

The dictionary holds letter-only parts of the long tokens of the corpus and of what stands around candidates, each counted
once per token or surrounding, so that copies of a text weigh no more than the text. It is bounded by
``DICTIONARY_PIECES``; the counts are over all documents. Case is folded before compressing: it would hide known names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from rasterloom.llm.arrow import aside, ddl, slices, utf8, without

# fixed values: the kinds in the order of listing, their patterns, and what makes a match valid
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_HINTS = ("passw", "secret", "token", "key")
ASSIGN_LENGTH = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_LENGTH = 20
HEX_LENGTH = 24

NOVEL = "novel"
SENSITIVE = re.compile(rb"passw|pwd|secret|token|key|auth|bearer|credential|private|signature", re.IGNORECASE)
TOKEN_LENGTH = 16  # of a candidate
REACH = 64  # bytes before a candidate in which a sensitive word counts
BEFORE, AFTER = 256, 64  # bytes around a candidate that the compressor is given first
NOVELTY = 0.7  # bytes added per byte of a candidate
DICTIONARY_PIECES = 8192  # of identifiers, commonest first
COMMON = 2  # tokens or surroundings that a piece of the dictionary stands in
LEVEL = 19
REMEMBERED = 100_000  # tokens and surroundings that a task remembers to send once

PIECE = re.compile(rb"[A-Z]?[a-z]{3,}|[A-Z]{4,}")
_SPANS = "array<struct<kind:string,start:long,end:long>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _class(characters: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(characters)] = True
    return table


_DIGITS, _LOWER, _UPPER = b"0123456789", bytes(range(0x61, 0x7B)), bytes(range(0x41, 0x5B))
_HEX = _class(_DIGITS + b"abcdef")
_TOKEN = _class(_DIGITS + _LOWER + _UPPER + b"+/_=-")


def _runs(flags: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the runs of ``least`` set flags or more that do not cross a text's edge."""
    if not len(flags):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(len(flags) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(flags & (~np.r_[False, flags[:-1]] | edge[:-1]))
    ends = np.flatnonzero(flags & (~np.r_[flags[1:], False] | edge[1:])) + 1
    long = ends - starts >= least
    return starts[long], ends[long]


def _mixed(token: bytes) -> bool:
    """Whether a token has letters and digits, or both cases beyond a capital at its head."""
    letters = bool(re.search(rb"[A-Za-z]", token))
    return letters and (bool(re.search(rb"[0-9]", token)) or bool(re.search(rb"[a-z][^a-z]*[A-Z]", token)))


@dataclass
class Candidate:
    row: int
    start: int  # bytes of the batch
    end: int
    text: bytes
    before: bytes
    after: bytes


def candidates(data: np.ndarray, offsets: np.ndarray) -> Iterator[Candidate]:
    """Long tokens of mixed characters behind a sensitive word."""
    yield from _sensitive(data, offsets, *_runs(_TOKEN[data], offsets, TOKEN_LENGTH))


def _sensitive(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[Candidate]:
    rows = np.searchsorted(offsets, starts, "right") - 1
    for row, start, end in zip(rows.tolist(), starts.tolist(), ends.tolist()):
        low, high = int(offsets[row]), int(offsets[row + 1])
        before = data[max(low, start - BEFORE) : start].tobytes()
        if not SENSITIVE.search(before[-REACH:]):
            continue
        token = data[start:end].tobytes()
        if _mixed(token):
            yield Candidate(row, start, end, token, before, data[end : min(high, end + AFTER)].tobytes())


def identifiers(docs: DataFrame, text: str = "text", pieces: int = DICTIONARY_PIECES) -> list[str]:
    """The commonest letter-only parts of long tokens and of the text around candidates, commonest first; at most ``pieces``."""

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for part in slices(batch, "text"):
                keys, found = [], []
                data, offsets = utf8(part.column("text"))
                starts, ends = _runs(_TOKEN[data], offsets, TOKEN_LENGTH)
                named = [data[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist())]
                named += [c.before + b"\0" + c.after for c in _sensitive(data, offsets, starts, ends)]
                for place in named:
                    key = hashlib.blake2b(place, digest_size=16).digest()
                    if key in seen:
                        continue
                    if len(seen) < REMEMBERED:
                        seen.add(key)
                    words = sorted({p.decode().lower() for p in PIECE.findall(place)})
                    if words:
                        keys.append(key)
                        found.append(words)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(found, pa.list_(pa.string()))], names=["key", "pieces"])

    rows = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    places = rows.mapInArrow(around, "key binary, pieces array<string>").groupBy("key").agg(F.min("pieces").alias("pieces"))
    counted = places.select(F.explode("pieces").alias("piece")).groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    best = counted.where(F.col("n") >= COMMON).orderBy(F.desc("n"), "piece").limit(pieces)
    return [r["piece"] for r in best.collect()]


class Novelty:
    """Marginal compressed bytes of a string behind its surroundings, with the dictionary known."""

    def __init__(self, pieces: list[str]):
        # the commonest come last, where references to them are shortest
        content = " ".join(reversed(pieces)).encode()
        primed = None
        if len(content) >= 8:
            primed = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            primed.precompute_compress(level=LEVEL)
        # costs next to nothing, and makes the block a compressed one however short the surroundings are
        self.primer = content[-BEFORE:] or b" " * BEFORE
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=primed, write_content_size=False)

    def added(self, c: Candidate) -> int:
        known = self.primer + (b" " + c.before + c.after + b" ").lower()
        return len(self.compressor.compress(known + c.text.lower())) - len(self.compressor.compress(known))


def _pattern_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    low = text.lower()
    if any(hint in low for hint in ASSIGN_HINTS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m.group(2)) >= ASSIGN_LENGTH]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    return out


def scan(docs: DataFrame, text: str = "text", keep_text: bool = True, novelty: float = NOVELTY) -> DataFrame:
    """Add ``base`` (spans of the three kinds), ``spans`` (those and the novel ones outside them) and ``n_novel``.

    Spans are in code points, end exclusive, ordered by start, then kind. ``n_novel`` counts all incompressible candidates,
    also those inside a base span. Columns of these names are replaced. Null and empty texts have no spans, repeated rows
    get the same ones. Without ``keep_text`` the text is dropped.
    """
    shared = docs.sparkSession.sparkContext.broadcast(identifiers(docs, text))
    kept = without(docs, [c for c in ("base", "spans", "n_novel") if c.lower() != text.lower()])
    given, own = aside(kept)
    given = given.withColumn("_llm_text", F.col(own[text]).cast("string"))
    if not keep_text:
        given = given.drop(own.pop(text))
    names = list(own.values())
    order = {kind: i for i, kind in enumerate((*KINDS, NOVEL))}

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = Novelty(shared.value)
        for batch in batches:
            for part in slices(batch, "_llm_text"):
                base: list[list[tuple]] = [_pattern_spans(t) if t else [] for t in part.column("_llm_text").to_pylist()]
                more: list[list[tuple]] = [[] for _ in base]
                data, offsets = utf8(part.column("_llm_text"))
                starts, ends = _runs(_HEX[data], offsets, HEX_LENGTH)
                tokens = [c for c in candidates(data, offsets) if measure.added(c) >= novelty * len(c.text)]
                if len(starts) or tokens:
                    points = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]  # code points before a byte
                    for start, end, row in zip(starts.tolist(), ends.tolist(), (np.searchsorted(offsets, starts, "right") - 1).tolist()):
                        zero = points[offsets[row]]
                        base[row].append((int(points[start] - zero), int(points[end] - zero), "hex"))
                    for c in tokens:
                        zero = points[offsets[c.row]]
                        more[c.row].append((int(points[c.start] - zero), int(points[c.end] - zero), NOVEL))
                base = [sorted(spans, key=lambda s: (s[0], order[s[2]])) for spans in base]
                every = [sorted(spans + _clear(new, spans), key=lambda s: (s[0], order[s[2]])) for spans, new in zip(base, more)]
                arrays = [*(part.column(n) for n in names), _spans(base), _spans(every), pa.array([len(x) for x in more], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=[*names, "base", "spans", "n_novel"])

    found = given.mapInArrow(mark, ddl(given.select(*names), f"base {_SPANS}, spans {_SPANS}, n_novel long"))
    return found.select(*(F.col(name).alias(old) for old, name in own.items()), "base", "spans", "n_novel")


def _clear(new: list[tuple], taken: list[tuple]) -> list[tuple]:
    """The new spans, in order, that meet none of the taken ones."""
    out, at = [], 0
    reach = 0  # end of the taken spans that begin before the new one ends
    for start, end, kind in new:
        while at < len(taken) and taken[at][0] < end:
            reach = max(reach, taken[at][1])
            at += 1
        if reach <= start:
            out.append((start, end, kind))
    return out


def _spans(rows: list[list[tuple]]) -> pa.Array:
    return pa.array([[{"kind": kind, "start": start, "end": end} for start, end, kind in spans] for spans in rows], _SPAN_TYPE)


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The documents with every span of their texts replaced by ``mark``; overlapping spans are one. Other columns stay."""
    own = F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("_llm_own")
    found = scan(docs.select(own, F.col(f"`{text}`").cast("string").alias("_llm_body")), "_llm_body")

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value, spans in zip(batch.column("_llm_body").to_pylist(), batch.column("spans").to_pylist()):
                parts, at = [], 0
                for span in spans:
                    if span["start"] >= at:
                        parts += [value[at : span["start"]], mark]
                    at = max(at, span["end"])
                out.append(value if value is None or not spans else "".join([*parts, value[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column("_llm_own"), pa.array(out, pa.string())], names=["_llm_own", "_llm_clean"])

    pair = found.select("_llm_own", "_llm_body", "spans")
    clean = pair.mapInArrow(replace, ddl(pair.select("_llm_own"), "_llm_clean string"))
    return clean.select(*[F.col("_llm_clean").alias(n) if n == text else F.col("_llm_own").getField(n).alias(n) for n in docs.columns])
