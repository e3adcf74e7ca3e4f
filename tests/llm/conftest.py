import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

ODD_TEXTS = [None, "", " ", "\n\t", "A.", "1234", "é", "Één woord", "one two three", "x" * 5000, "the the the the the the the the the"]


@pytest.fixture(scope="session")
def documents(spark):
    """Documents of (doc_id, text) pairs, with further columns whose names operators use themselves."""

    def build(pairs, parts=3):
        schema = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, n_words STRING, SCORE STRING, spans INT, base INT, shard STRING, part INT, key STRING, `class` INT"
        rows = [(i, t, "en", None, None, "w", "s", 1, 2, "z", 3, None, 4) for i, t in pairs]
        return spark.createDataFrame(rows, schema).repartition(parts)

    return build


@pytest.fixture(scope="session")
def odd(documents):
    """Nulls, empty and very long texts, ties and repeated rows."""
    rng = random.Random(5)
    long = " ".join(rng.choice("ab cd ef gh ij kl mn".split()) + str(rng.randrange(50)) for _ in range(30_000))
    pairs = [(i, t) for i, t in enumerate(ODD_TEXTS)]
    pairs += [(None, "a null id here and there and everywhere"), (None, None), (3, "A."), (4, "A."), (4, "A."), (100, long), (101, long), (101, long)]
    return pairs, documents(pairs)


@pytest.fixture(scope="session")
def prose():
    """Texts over a small vocabulary, with copies, near copies and shared passages."""

    def build(n=60, seed=1, vocabulary=400, longest=160):
        rng = random.Random(seed)
        words = [f"{rng.choice('bcdfgl')}{rng.choice('aeiou')}{rng.choice('mnrst')}{i % 23}" for i in range(vocabulary)]
        passage = [rng.choice(words) for _ in range(40)]
        texts = []
        for _ in range(n):
            kind = rng.random()
            if texts and kind < 0.15:
                text = list(rng.choice(texts))
            elif texts and kind < 0.45:
                text = list(rng.choice(texts))
                for _ in range(rng.randrange(1, 6)):
                    if text:
                        at = rng.randrange(len(text))
                        text[at : at + rng.randrange(0, 3)] = [rng.choice(words)]
            else:
                text = [rng.choice(words) for _ in range(rng.randrange(0, longest))]
                if rng.random() < 0.3:
                    at = rng.randrange(len(text) + 1)
                    text[at:at] = passage[rng.randrange(10) : rng.randrange(20, 41)]
            texts.append(text)
        ids = rng.sample(range(10 * n), n)
        gaps = (" ", "  ", "\n", " \t")
        return [(i, "".join(w + rng.choice(gaps) for w in t)) for i, t in zip(ids, texts)]

    return build
