"""URL rules as globs, matched all at once by a bit-parallel automaton.

A rule ``host/path`` fits its host, every subdomain, and paths that start with its path. As a glob over the
canonical URL ``.host/path`` it reads ``*.host/path*``. All globs together are one Shift-And automaton: one
bit per literal byte and one before each glob, packed into 64-bit words. A glob's first bit repeats on any byte
but ``/`` (the star before the host never reaches into the path), its last one on any byte. Many URLs advance
together, one byte a step.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rasterloom.llm.arrow import ddl, extended, slices, utf8, without


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def rules(lines: Sequence[str]) -> list[Rule]:
    """Rules from lines such as ``block example.com/de/``; without a slash the path is empty."""
    out = []
    for line in lines:
        verdict, _, glob = line.strip().partition(" ")
        host, slash, path = glob.strip().partition("/")
        if verdict not in ("allow", "block") or not host:
            raise ValueError(f"not a rule: {line!r}")
        out.append(Rule(verdict, host.lower(), slash + path))
    return out


def canonical(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(_llm_url, instr(_llm_url, '://') + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lowered, path


class Automaton:
    """Shift-And masks of all globs; state 0 of a glob is its leading star, each further state one byte."""

    def __init__(self, globs: Sequence[bytes]):
        states = sum(len(g) + 1 for g in globs)
        self.words = max(1, -(-states // 64))
        self.step = np.zeros((256, self.words), np.uint64)  # states that a byte may enter
        self.stay = np.zeros((256, self.words), np.uint64)  # states that a byte does not leave
        self.start = np.zeros(self.words, np.uint64)
        self.final: list[tuple[int, np.uint64]] = []
        at = 0
        for glob in globs:
            word, bit = self._bit(at)
            self.start[word] |= bit
            self.stay[np.arange(256) != 0x2F, word] |= bit
            for i, byte in enumerate(glob, 1):
                word, bit = self._bit(at + i)
                self.step[byte, word] |= bit
            word, bit = self._bit(at + len(glob))
            self.stay[:, word] |= bit
            self.final.append((word, bit))
            at += len(glob) + 1

    @staticmethod
    def _bit(state: int) -> tuple[int, np.uint64]:
        return state // 64, np.uint64(1 << (state % 64))

    def run(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For every text and glob, whether the glob fits; (texts, globs)."""
        sizes = np.diff(offsets)
        order = np.argsort(-sizes, kind="stable")  # texts that have ended are at the end
        live_at = np.searchsorted(-sizes[order], -np.arange(1, sizes.max(initial=0) + 1), "right")
        state = np.tile(self.start, (len(sizes), 1))
        begin = offsets[:-1][order]
        for i, live in enumerate(live_at):
            byte = data[begin[:live] + i]
            now = state[:live]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:live] = (moved & self.step[byte]) | (now & self.stay[byte])
        out = np.zeros((len(sizes), len(self.final)), bool)
        for k, (word, bit) in enumerate(self.final):
            out[order, k] = (state[:, word] & bit) != 0
        return out


def judge(pages: DataFrame, given: Sequence[Rule], default: str = "allow", url: str = "url") -> DataFrame:
    """Add ``host``, ``path``, ``rule`` (the longest that fits, null if none) and ``verdict`` to every row.

    Of equally long rules the one listed first wins; of the same rule given twice with both verdicts too. A null
    URL or one without ``://`` has an empty host and path and gets the default. Columns of these four names in
    ``pages`` are replaced; all others are kept. The masks grow with the rules, never with the pages.
    """
    added = "host string, path string, rule string, verdict string"
    kept = without(pages, [x for x in ("host", "path", "rule", "verdict") if x != url])
    spelled = kept.withColumn("_llm_url", F.col(url))
    host, path = canonical(F.col("_llm_url"))
    spelled = spelled.withColumns({"_llm_host": host, "_llm_path": path}).drop("_llm_url")
    spelled = spelled.withColumns({"_llm_seen": F.concat(F.lit("."), "_llm_host", "_llm_path")})
    ordered = sorted(enumerate(given), key=lambda x: (-len(x[1].text), x[0]))
    found = [rule for _, rule in ordered]
    globs = [f".{rule.text}".encode() for rule in found]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(globs)
        for batch in batches:
            for part in slices(batch, "_llm_seen"):
                fits = automaton.run(*utf8(part.column("_llm_seen")))
                # a rule's host must be the whole host or follow a dot, which the leading dot of the glob says;
                # it must also end where the host ends, which only a rule without a path leaves open
                for k, rule in enumerate(found):
                    if not rule.path and fits[:, k].any():
                        hosts = part.column("_llm_host").to_pylist()
                        for row in np.flatnonzero(fits[:, k]):
                            fits[row, k] = f".{hosts[row]}".endswith(f".{rule.host}")
                best = np.where(fits.any(1), fits.argmax(1), len(found)) if found else np.zeros(part.num_rows, int)
                texts = pa.array([*(r.text for r in found), None], pa.string())
                verdicts = pa.array([*(r.verdict for r in found), default], pa.string())
                yield extended(
                    part.select(names), schema,
                    {"host": part.column("_llm_host"), "path": part.column("_llm_path"), "rule": texts.take(pa.array(best)), "verdict": verdicts.take(pa.array(best))},
                )

    names = kept.columns
    schema = pa.schema([(x, pa.string()) for x in ("host", "path", "rule", "verdict")])
    return spelled.mapInArrow(scan, ddl(kept, added))
