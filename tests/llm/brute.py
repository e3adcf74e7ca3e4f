"""Plain versions of the operators, for tables of a few rows."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANK_WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def contamination(docs, items, size=10):
    """docs: (id, text); items: (id, text). Rows (id, n_words, n_hit, sorted item ids)."""
    grams = defaultdict(set)
    for item, text in items:
        words = PLAIN_WORD.findall((text or "").translate(LOWER))
        k = min(size, len(words))
        for i in range(len(words) - k + 1 if words else 0):
            grams[tuple(words[i : i + k])].add(item)
    sizes = {len(g) for g in grams}
    out = []
    for doc, text in docs:
        words = PLAIN_WORD.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for k in sizes:
            for i in range(len(words) - k + 1):
                owners = grams.get(tuple(words[i : i + k]))
                if owners is not None:
                    hit.update(range(i, i + k))
                    found.update(str(o) for o in owners if o is not None)
        out.append((doc, len(words), len(hit), sorted(found)))
    return out


def shingles(text, size=5):
    words = BLANK_WORD.findall((text or "").translate(LOWER))
    if not words:
        return set()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def near_duplicates(docs, percent, size=5):
    """Rows (id, n_shingles, component_id)."""
    sets = [shingles(text, size) for _, text in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    low = defaultdict(list)
    for i, (doc, _) in enumerate(docs):
        if doc is not None:
            low[find(i)].append(doc)
    return [(doc, len(sets[i]), min(low[find(i)], default=None)) for i, (doc, _) in enumerate(docs)]


def repeats(docs, window):
    """Rows (id, n_words, n_removed, kept)."""
    last = 1 << 63
    first = {}
    split = [(last if doc is None else doc, BLANK_WORD.findall(text or "")) for doc, text in docs]
    for doc, words in split:
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            first[key] = min(first.get(key, last), doc)
    out = []
    for (doc, _), (order, words) in zip(docs, split):
        gone = set()
        for i in range(len(words) - window + 1):
            if first[tuple(words[i : i + window])] < order:
                gone.update(range(i, i + window))
        out.append((doc, len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c)
        total += v if i % 2 == 0 else 2 * v - 9 * (v > 4)
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in KINDS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def sanitised(text):
    out, at = [], 0
    for start, end, kind in sorted((s, e, k) for k, s, e in base_spans(text)):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def best_url_rule(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group().translate(LOWER)
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.host + r.path), default=None)
    return host, path, best and best.host + best.path, best.verdict if best else "allow"


def best_fit(counts, capacity):
    """Sequences that plain best fit needs, longest pieces first."""
    gaps, n = [], 0
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            i = bisect_left(gaps, length)
            gap = gaps.pop(i) if i < len(gaps) else capacity
            n += gap == capacity
            insort(gaps, gap - length)
    return n


def walk(text, notes):
    """One text's fingerprint, step by step; notes: module with the shared random functions."""
    codes, at, step, octave, out = notes._codes(text), 0, 1, 0, ""
    due = set(notes.sampled_steps(0).tolist())
    while codes[at]:
        if step >= 2 << octave:
            octave += 1
            due = set(notes.sampled_steps(octave).tolist())
        x = int(codes[at])
        if step in due:
            out += "0123456789abcdef"[(x * int(notes._random(notes.NOTE_SEED, step, 1)[0]) & 0xFFFFFFFF) >> 28]
        at += (x * int(notes._random(notes.MOVE_SEED, step, 1)[0]) & 0xFFFFFFFF) >> 31
        step += 1
    return out


def rows(frame, names):
    """Rows of a DataFrame in a stable order; nulls and NaN as None."""
    cells = frame.select(*names).collect()
    return sorted((tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r) for r in cells), key=repr)


def collocations(docs, least=30, longest=4, covered=80):
    """docs: (lang, text). Rows (lang, phrase, a, l, r, n, score)."""
    counts, totals = defaultdict(int), defaultdict(int)
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    counts[lang, tuple(words[i : i + m])] += 1
    frequent = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    hidden = set()
    for (lang, w), longer in frequent.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                if 100 * longer >= covered * counts[lang, w[i : i + m]]:
                    hidden.add((lang, w[i : i + m]))
    out = []
    for (lang, w), a in frequent.items():
        if (lang, w) in hidden:
            continue
        cuts = [(2000000 * a // (counts[lang, w[:k]] + counts[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.append((lang, " ".join(w), a, counts[lang, w[:k]], counts[lang, w[k:]], totals[lang], score))
    return sorted(out)


def hard_negatives(rows, every=50, positives=5, negatives=3):
    """rows: (id, label, vector). Rows (anchor, positive, rank, negative, positive score, negative score)."""
    taken = []
    for vec_id, label, vector in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not np.isfinite(x) for x in vector):
            continue
        taken.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, [int(np.floor(256 * np.float64(x))) for x in vector]))
    out = []
    for anchor, own, q in taken:
        if anchor % every:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(q, v)), i, label) for i, label, v in taken if i != anchor))
        for p, pid, _ in [s for s in scored if s[2] == own][:positives]:
            fits = [(n, i) for n, i, label in scored if label != own and 50 * -p <= 100 * -n <= 95 * -p][:negatives]
            out += [(anchor, pid, r, i, -p, -n) for r, (n, i) in enumerate(fits, 1)]
    return sorted(out)


def secrets(text):
    """Base spans by start, then kind as listed."""
    text, out = text or "", []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m.group(2)) >= 6:
            out.append((m.start(), 0, "assign", m.end()))
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 24]
    return [(kind, start, end) for start, _, kind, end in sorted(out)]
