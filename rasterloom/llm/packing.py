"""Packing of tokenised documents into sequences of one capacity: exact complements first, then best fit.

There are at most ``capacity`` different lengths, so the packing is planned on a table of counts. Combinations
of one, two and three lengths that fill a sequence exactly are found by looking up the complement of a sum among
the lengths still available, and are used as often as the counts allow. What is left goes, longest first, into
the tightest gap. The plan says for the r-th piece of a length where it goes; pieces get their rank by counting,
in parallel.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from rasterloom.llm.arrow import ddl, slices, tidy, without
from rasterloom.session import stored

# fixed values: end-of-document id, size of a sequence
END_ID = 2
CAPACITY = 1024

CACHE_ENTRIES = 300_000
RANK_ROWS = 1_000_000  # pieces of one length that one task numbers


class Encoder:
    """Byte-level BPE of a ``tokenizers`` file. Ids of blank-separated chunks are remembered, up to a bound.

    ``tokenizers`` itself encodes where its merges are not in the order of the ids; otherwise the vocabulary is
    handed to ``tiktoken``, which gives the same ids. Strings of special tokens are ordinary text, or with ``added``
    what ``tokenizers`` takes them for by default: a text that holds an added token is encoded by it as a whole.
    """

    def __init__(self, path: str, added: bool = False):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self._encode = self._ranked(spec) or self._plain(path, added)
        self._added = [x["content"] for x in spec.get("added_tokens") or [] if x["content"]] if added else []
        self._whole = self._plain(path, True) if self._added else None
        self._known: dict[str, bytes] = {}
        self._crossing = re.compile(r" \s|\s ")

    @staticmethod
    def _plain(path: str, added: bool):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = not added
        return lambda text: tokenizer.encode(text, add_special_tokens=False).ids

    @staticmethod
    def _ranked(spec: dict):
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model.get("type") == "BPE" and split.get("type") == "ByteLevel" and not spec.get("normalizer")
        if not plain or split.get("add_prefix_space") or not split.get("use_regex", True) or model.get("ignore_merges"):
            return None
        vocab = model["vocab"]
        special = {x["content"] for x in spec.get("added_tokens", [])}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        merged = [vocab.get(a + b, -1) for a, b in pairs]
        if merged != sorted(set(merged)) or len(merged) + 256 != len(vocab) - len(special & vocab.keys()):
            return None
        import tiktoken

        # the printable stand-ins of byte-level vocabularies
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in shown)}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if token not in special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # of byte-level files
        return tiktoken.Encoding("ranked", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def ids(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if any(token in text for token in self._added):
            return np.asarray(self._whole(text), "<u4").tobytes()
        if self._crossing.search(text):  # blanks in a row: a chunk's ids may depend on its neighbour
            return np.asarray(self._encode(text), "<u4").tobytes()
        chunks = text.split(" ")
        chunks[1:] = [" " + chunk for chunk in chunks[1:]]
        known = self._known
        try:
            return b"".join([known[chunk] for chunk in chunks])
        except KeyError:
            return b"".join([known[chunk] if chunk in known else self._new(chunk) for chunk in chunks])

    def _new(self, chunk: str) -> bytes:
        ids = np.asarray(self._encode(chunk), "<u4").tobytes()
        if len(self._known) < CACHE_ENTRIES and len(chunk) < 100:
            self._known[chunk] = ids
        return ids


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(
    docs: DataFrame,
    tokenizer: str | None = None,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    keep_ids: bool = False,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Tokenised documents cut into pieces of at most ``capacity`` ids; of a longer one the first piece is shorter.

    A null text is empty, and an empty one still has its end id. Repeated rows are tokenised each. ``tokenizer``
    is the path of a ``tokenizers`` file on every executor; None stands for the public byte-level vocabulary. Ids are
    those of ``Tokenizer.encode(text, add_special_tokens=False)``; a text's added tokens have their own ids.
    """
    out = "piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if keep_ids else "")
    taken = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("_llm_text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer or tokenizer_path(), added=True)
        tail = np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            for part in slices(batch, "_llm_text"):
                rows, number, start, length, crc, ids = [], [], [], [], [], []
                for row, value in enumerate(part.column("_llm_text").to_pylist()):
                    blob = encoder.ids(value or "") + tail
                    n = len(blob) // 4
                    first = n - (-(-n // capacity) - 1) * capacity
                    at = 0
                    for k, stop in enumerate(range(first, n + 1, capacity)):
                        piece = blob[4 * at : 4 * stop]
                        rows.append(row)
                        number.append(k)
                        start.append(at)
                        length.append(stop - at)
                        crc.append(zlib.crc32(piece))
                        if keep_ids:
                            ids.append(np.frombuffer(piece, "<i4"))
                        at = stop
                arrays = [
                    part.column("doc_id").take(pa.array(rows, pa.int64())),
                    pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
                ]
                arrays += [pa.array(ids, pa.list_(pa.int32()))] if keep_ids else []
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(arrays)])
        tidy()

    return taken.mapInArrow(cut, ddl(taken.select("doc_id"), out))


Pattern = tuple[tuple[int, int], ...]  # (length, copies) in the order of a sequence


def plan(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Patterns of sequences and how often each is used, for so many pieces of each length.

    Exact fills may spend short pieces that the gaps of long ones need. So the whole plan is made with fills of up to
    three, two and one lengths, and with fills that leave out short pieces, until one needs no more sequences than the
    total demands; the best is taken, of equal ones the first. The last way is plain best fit, longest first.
    """
    if any(not 0 < length <= capacity for length, n in counts.items() if n > 0):
        raise ValueError("a piece is empty or longer than a sequence")
    least = -(-sum(length * n for length, n in counts.items() if n > 0) // capacity)
    best, used = [], None
    for most, shortest in [(3, 1), *((3, capacity // part) for part in (32, 16, 8, 5)), (2, 1), (2, capacity // 8), (1, 1)]:
        tried = _planned(counts, capacity, most, max(shortest, 1))
        number = sum(times for _, times in tried)
        if used is None or number < used:
            best, used = tried, number
        if used == least:
            break
    return best


def _planned(counts: dict[int, int], capacity: int, most: int, shortest: int) -> list[tuple[Pattern, int]]:
    """A plan whose exact fills have at most ``most`` pieces, of a length of ``shortest`` or more each."""
    left = Counter({length: n for length, n in counts.items() if n > 0})
    out: list[tuple[Pattern, int]] = []

    def use(lengths: tuple[int, ...]) -> None:
        need = Counter(lengths)
        times = min(left[length] // n for length, n in need.items())
        if times:
            out.append((tuple(need.items()), times))
            for length, n in need.items():
                left[length] -= times * n

    use((capacity,))
    for a in range(capacity - shortest, (capacity + 1) // 2 - 1, -1) if most > 1 else ():
        use((a, capacity - a))
    for a in sorted((x for x in left if left[x]), reverse=True) if most > 2 else ():
        for b in sorted((x for x in left if left[x] and shortest <= x <= a), reverse=True):
            if not left[a]:
                break
            c = capacity - a - b
            if shortest <= c <= b and left[c]:
                use((a, b, c))

    gaps: dict[int, list[tuple[Pattern, int]]] = {}  # open sequences by what still fits

    def put(pattern: Pattern, times: int) -> None:
        gap = capacity - sum(length * n for length, n in pattern)
        (gaps.setdefault(gap, []) if gap else out).append((pattern, times))

    for length in sorted((x for x in left if left[x]), reverse=True):
        n = left[length]
        for gap in sorted(g for g in gaps if g >= length):
            copies = gap // length
            while n and gaps[gap]:
                pattern, times = gaps[gap].pop()
                full = min(times, n // copies)
                rest = n - full * copies if full < times and n - full * copies < copies else 0
                if full:
                    put((*pattern, (length, copies)), full)
                if rest:
                    put((*pattern, (length, rest)), 1)
                if times > full + bool(rest):
                    gaps[gap].append((pattern, times - full - bool(rest)))
                n -= full * copies + rest
            if not n:
                break
        copies = capacity // length
        if n >= copies:
            put(((length, copies),), n // copies)
        if n % copies:
            put(((length, n % copies),), 1)
    return out + [group for gap in sorted(gaps) for group in gaps[gap]]


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with a ``length``; existing columns of these names are replaced.

    The pieces are written once to the shared folder, so that they are not made anew for counting and placing.
    The driver sees one count per length. The plan has a few rows per length (each pattern uses up a length or a
    group of gaps), which is the bound of its broadcast.
    """
    names = without(cut, ["sequence_id", "offset"]).columns
    held = stored(cut.select(*names))
    spark = held.sparkSession
    counts = {row["length"]: row["n"] for row in held.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    salts = max(16, -(-max(counts.values(), default=0) // RANK_ROWS))

    rows, used, sequence = [], Counter(), 0
    for pattern, times in plan(counts, capacity):
        at = 0
        for length, copies in pattern:
            low = used[length]
            used[length] += times * copies
            rows.append((length, low, used[length], copies, sequence, at))
            at += length * copies
        sequence += times
    places = spark.createDataFrame(rows, "_l long, _low long, _high long, _copies long, _sequence long, _at long")

    keys = [c for c in names if c != "ids"]
    salted = held.withColumn("_salt", F.pmod(F.xxhash64(*keys), F.lit(salts)).cast("int"))
    before = salted.groupBy(F.col("length").alias("_n"), F.col("_salt").alias("_s")).agg(F.count(F.lit(1)).alias("_rows"))
    offsets = before.withColumn(
        "_before", F.sum("_rows").over(Window.partitionBy("_n").orderBy("_s")) - F.col("_rows")
    ).drop("_rows")
    ranked = salted.withColumn("_row", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*keys)))
    ranked = ranked.join(F.broadcast(offsets) if salts == 16 else offsets, (F.col("length") == F.col("_n")) & (F.col("_salt") == F.col("_s")))
    ranked = ranked.withColumn("_rank", F.col("_before") + F.col("_row") - 1)
    placed = ranked.join(
        F.broadcast(places),
        (F.col("length") == F.col("_l")) & (F.col("_rank") >= F.col("_low")) & (F.col("_rank") < F.col("_high")),
    )
    within = F.col("_rank") - F.col("_low")
    return placed.select(
        *names,
        (F.col("_sequence") + F.expr("(_rank - _low) div _copies")).alias("sequence_id"),
        (F.col("_at") + F.pmod(within, F.col("_copies")) * F.col("length")).alias("offset"),
    )


def assemble(placed: DataFrame) -> DataFrame:
    """Token ids of every sequence, from placed pieces that keep their ``ids``; at most the capacity per row."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
