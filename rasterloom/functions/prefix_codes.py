"""Prefix codes over bytes, many values at a time.

A payload is cut into lanes of ``LANE`` values by marks, the bit at which each lane begins. Coding looks the bits of
all values up in one table; decoding moves all lanes of all payloads forward together, one value a step.
"""

from __future__ import annotations

import numpy as np

LANE = 64
PEEK = 12  # bits that are looked up at once; longer codes are rare by construction and read one by one


class Book:
    """Tables of one code: ``codes`` holds a string of 0 and 1 per byte value, or None."""

    def __init__(self, codes: list[str | None]):
        self.by_code = {code: v for v, code in enumerate(codes) if code}
        self.sizes = np.array([len(code or "") for code in codes], np.int64)
        self.longest = max(1, int(self.sizes.max(initial=0)))
        self.bits = np.zeros((len(codes), self.longest), np.uint8)
        for code, v in self.by_code.items():
            self.bits[v, : len(code)] = np.frombuffer(code.encode(), np.uint8) - 48
        self.peek = min(PEEK, self.longest)

    def table(self) -> np.ndarray:
        """For every ``peek`` bits the value they begin with and its size, as value + 256 * size; 0 if longer."""
        out = np.zeros(1 << self.peek, np.int32)
        for code, v in self.by_code.items():
            if len(code) <= self.peek:
                room = self.peek - len(code)
                first = int(code, 2) << room
                out[first : first + (1 << room)] = v + 256 * len(code)
        return out

    def encode(self, values: np.ndarray) -> tuple[bytes, int, np.ndarray]:
        """Payload (most significant bit first, padded with zeros), its bits, and the first bit of each lane."""
        sizes = self.sizes[values]
        if not sizes.all():
            raise ValueError("a value has no code")
        used = np.arange(self.longest) < sizes[:, None]
        ends = np.cumsum(sizes)
        marks = (ends - sizes)[::LANE]
        return np.packbits(self.bits[values][used]).tobytes(), int(ends[-1]) if len(ends) else 0, marks.astype(np.int32)


def decode(
    payloads: list[bytes], bits: list[int], marks: list[np.ndarray], counts: list[int], books: list[Book]
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All values one after another, where those of each payload begin, and which payloads are sound.

    ``books`` may repeat the same object, whose table is then made once. Values of an unsound payload are noise.
    """
    counts = np.asarray(counts, np.int64)
    lanes = -(-counts // LANE)
    sound = np.array([len(m) == n and (not n or m[0] == 0) for m, n in zip(marks, lanes)], bool)
    marks = [m if ok else np.zeros(n, np.int64) for m, n, ok in zip(marks, lanes, sound)]
    begins = np.r_[0, np.cumsum(counts)]
    total = int(lanes.sum())
    if not total:
        return np.zeros(0, np.uint8), begins, sound & (np.asarray(bits) == 0)

    owner = np.repeat(np.arange(len(lanes)), lanes)
    base = _first_bits(payloads)
    place = np.concatenate([np.asarray(m, np.int64) for m in marks]) + base[owner]
    final = np.cumsum(lanes)[lanes > 0] - 1  # last lane of each payload
    stop = np.r_[place[1:], 0]
    stop[final] = (base + np.asarray(bits, np.int64))[lanes > 0]
    need = np.full(total, LANE)
    need[final] = (counts - (lanes - 1) * LANE)[lanes > 0]
    out, good = _forward(payloads, books, owner, place, stop, need)
    unsound = np.bincount(owner, ~good, len(lanes)) > 0
    return out[np.arange(LANE) < need[:, None]], begins, sound & ~unsound


def decode_lanes(
    payloads: list[bytes], bits: list[int], marks: list[np.ndarray], counts: list[int], books: list[Book], wanted: list[np.ndarray]
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``wanted`` lanes of each payload as rows of ``LANE`` values, whose payload each is, and which are sound.

    Nothing else of a payload is read. A lane that the payload does not have is unsound; the values of such a lane,
    and those behind the last value of a payload, are noise.
    """
    owner = np.repeat(np.arange(len(payloads)), [len(w) for w in wanted])
    lane = np.concatenate([np.zeros(0, np.int64), *[np.asarray(w, np.int64) for w in wanted]])
    if not len(lane):
        return np.zeros((0, LANE), np.uint8), owner, np.zeros(0, bool)
    has = np.array([len(m) for m in marks], np.int64)
    ends = np.concatenate([np.r_[np.asarray(m, np.int64), b] for m, b in zip(marks, bits)])  # marks and the end of each payload
    at = (np.cumsum(has + 1) - has - 1)[owner] + np.minimum(lane, has[owner] - 1).clip(0)
    there = (lane < has[owner]) & (lane >= 0)
    base = _first_bits(payloads)[owner]
    limit = 8 * np.array([len(p) for p in payloads], np.int64)[owner]
    place, stop = ends[at], ends[np.minimum(at + 1, len(ends) - 1)]
    there &= (place >= 0) & (place <= stop) & (stop <= limit)
    need = np.clip(np.asarray(counts, np.int64)[owner] - lane * LANE, 0, LANE)
    out, good = _forward(payloads, books, owner, base + np.where(there, place, 0), base + np.where(there, stop, 0), np.where(there, need, 0))
    return out, owner, good & there


def _first_bits(payloads: list[bytes]) -> np.ndarray:
    """The bit at which each payload begins when all stand one after another."""
    sizes = np.array([len(p) for p in payloads], np.int64)
    return 8 * (np.cumsum(sizes) - sizes)


def _forward(
    payloads: list[bytes], books: list[Book], owner: np.ndarray, place: np.ndarray, stop: np.ndarray, need: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Read ``need`` values of each lane from the bit ``place`` on, all lanes together; a good one ends at ``stop``."""
    tables, at, offset = [], {}, 0
    for book in books:
        if id(book) not in at:
            tables.append(book.table())
            at[id(book)] = offset
            offset += len(tables[-1])
    table = np.concatenate(tables)
    raw = np.frombuffer(b"".join(payloads) + bytes(8), np.uint8).astype(np.uint32)
    words = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    beyond = 8 * (len(raw) - 8) + 32  # where a lane stays that has run over the end
    start = np.array([at[id(b)] for b in books])[owner]
    shift = np.array([32 - b.peek for b in books], np.uint32)[owner]

    out = np.zeros((len(owner), LANE), np.uint8)
    wrong = np.zeros(len(owner), bool)
    for step in range(LANE):
        window = (words[place >> 3] << (place & 7).astype(np.uint32)) >> shift
        entry = table[start + window]
        size = entry >> 8
        for lane in np.flatnonzero((size == 0) & (step < need) & ~wrong):
            found = _long(raw, int(place[lane]), books[owner[lane]])
            wrong[lane] = found is None
            if found:
                entry[lane], size[lane] = found
        out[:, step] = entry & 255
        place = np.minimum(place + size * (step < need), beyond)
    return out, (place == stop) & ~wrong


def _long(raw: np.ndarray, place: int, book: Book) -> tuple[int, int] | None:
    """Value and size of the code at a bit, if it is longer than what is looked up at once."""
    first = place >> 3
    text = "".join(f"{b:08b}" for b in raw[first : first + 2 + (book.longest >> 3)])[place & 7 :]
    for size in range(book.peek + 1, book.longest + 1):
        value = book.by_code.get(text[:size])
        if value is not None:
            return value, size
    return None


def fault(payload: bytes, bits: int, marks: np.ndarray, count: int, book: Book) -> str | None:
    """What is wrong with one payload, read value by value."""
    text = "".join(f"{b:08b}" for b in payload)[:bits]
    sizes = sorted({len(code) for code in book.by_code})
    at, n, seen = 0, 0, []
    while at < bits:
        size = next((s for s in sizes if at + s <= bits and text[at : at + s] in book.by_code), None)
        if size is None:
            return "corrupt payload"
        if n % LANE == 0:
            seen.append(at)
        at, n = at + size, n + 1
    if n != count:
        return "too many values" if n > count else "too few values"
    return None if seen == list(marks) else "marks differ"
