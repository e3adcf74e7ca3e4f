"""Operators that compare passages: decontamination, near-duplicates, substring removal."""

import random

import pytest
from pyspark.sql import functions as F

import brute
from rasterloom.llm import components, decontaminate, near_dedup, substring_dedup
from rasterloom.session import stored


def _items(spark, pairs):
    return spark.createDataFrame(pairs, "item_id BIGINT, text STRING")


def _contaminated(frame):
    return brute.rows(frame, ["doc_id", "n_words", "n_hit", "items"])


ITEMS = [(7, "a null id here"), (8, "x" * 5000), (9, None), (10, "..."), (None, "Een woord één WOORD"), (7, "the the"), (11, "1234"), (12, "één woord")]


@pytest.mark.parametrize("block_bytes", [1 << 25, 300])
def test_contamination_of_odd_rows(spark, odd, block_bytes):
    pairs, docs = odd
    got = decontaminate.contamination(docs, _items(spark, ITEMS), block_bytes=block_bytes)
    assert got.columns[-4:] == ["n_words", "n_hit", "items", "hits"] and got.columns.count("n_words") == 1
    assert _contaminated(got) == sorted(brute.contamination(pairs, ITEMS), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_contamination_of_prose(spark, documents, prose, seed):
    pairs = prose(seed=seed, vocabulary=60)
    rng = random.Random(seed)
    items = []
    for i in range(30):
        words = brute.PLAIN_WORD.findall(rng.choice(pairs)[1])
        at = rng.randrange(len(words) + 1)
        items.append((i % 25, " ".join(words[at : at + rng.randrange(1, 30)]).upper()))
    got = decontaminate.contamination(documents(pairs), _items(spark, items), block_bytes=4000)
    want = brute.contamination(pairs, items)
    assert sum(n for _, _, n, _ in want) > 100
    assert _contaminated(got) == sorted(want, key=repr)
    kept = decontaminate.remove_documents(documents(pairs), _items(spark, items))
    assert kept.columns == documents(pairs).columns or set(kept.columns) == set(documents(pairs).columns) - {"n_words"}
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(d for d, _, n, _ in want if not n)


def test_spans_are_cut_out(spark, documents):
    docs = documents([(1, "Keep this. One two, three four five; six seven eight nine ten! And this."), (2, None), (3, "clean")])
    cut = decontaminate.remove_spans(docs, _items(spark, [(1, "one two three four five six seven eight nine ten")]))
    assert {r.doc_id: r.text for r in cut.collect()} == {1: "Keep this. ! And this.", 2: None, 3: "clean"}


def test_no_items_or_no_documents(spark, documents):
    none = _items(spark, [])
    assert decontaminate.remove_documents(documents([(1, "a b")]), none).count() == 1
    assert decontaminate.contamination(documents([]), _items(spark, ITEMS)).count() == 0


def _near(frame):
    return brute.rows(frame, ["doc_id", "n_shingles", "component_id"])


def test_near_duplicates_of_odd_rows(odd):
    pairs, docs = odd
    assert _near(near_dedup.near_duplicates(docs)) == sorted(brute.near_duplicates(pairs, 80), key=repr)


@pytest.mark.parametrize("seed,percent", [(1, 80), (2, 85), (3, 50)])
def test_near_duplicates_of_prose(documents, prose, seed, percent):
    pairs = prose(n=150, seed=seed)
    want = brute.near_duplicates(pairs, percent)
    assert sum(doc != low for doc, _, low in want) > 20
    assert _near(near_dedup.near_duplicates(documents(pairs), percent=percent)) == sorted(want, key=repr)


def test_a_group_around_one_text_and_links_beside_it(documents):
    """Copies of one text with random edits: most link to it, some only to each other."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(10_000)}" for _ in range(120)]
    pairs = [(500, " ".join(base))]
    for i in range(150):
        text = list(base)
        for _ in range(rng.randrange(1, 7)):
            text[rng.randrange(len(text))] = f"e{i}.{rng.randrange(99)}"
        pairs.append((i, " ".join(text)))
        if i % 5 == 0:  # a relative of a copy that is too far from the centre
            text[rng.randrange(len(text))] = "z"
            text.append("y")
            pairs.append((1000 + i, " ".join(text)))
    want = brute.near_duplicates(pairs, 85)
    assert len({low for _, _, low in want}) > 5
    assert _near(near_dedup.near_duplicates(documents(pairs), percent=85)) == sorted(want, key=repr)


def test_one_document_of_each_group_stays(documents, prose):
    pairs = prose(n=80, seed=9)
    want = sorted(doc for doc, _, low in brute.near_duplicates(pairs, 80) if doc == low)
    kept = near_dedup.keep_one(documents(pairs))
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == want
    assert kept.columns == documents(pairs).columns
    assert near_dedup.keep_one(documents([])).count() == 0


def test_matches_asked_for_miss_next_to_nothing():
    assert near_dedup.least_matches(32, 0.85) == 15
    assert near_dedup.least_matches(1, 0.5) == 1


def test_long_texts_below_the_threshold_keep_bounded_postings(documents, monkeypatch):
    """Near-equal texts that are not linked; a posting holds no more shingles than it may, and their links stay."""
    rng = random.Random(31)
    words = [f"w{i}" for i in range(30_000)]
    texts = [words]
    for rate in (0.035, 0.04, 0.045, 0.02):
        texts.append([f"x{rng.random()}" if rng.random() < rate else w for w in words])
    pairs = [(i, " ".join(t)) for i, t in enumerate(texts)]
    tables = []
    monkeypatch.setattr(near_dedup, "stored", lambda df: tables.append(stored(df)) or tables[-1])
    monkeypatch.setattr(near_dedup, "least_matches", lambda *_: 1)  # all of them meet in lists of several components
    for percent in (80, 85):
        assert _near(near_dedup.near_duplicates(documents(pairs), percent=percent)) == sorted(brute.near_duplicates(pairs, percent), key=repr)
    postings = [t for t in tables if "earlier" in t.columns]
    assert len(postings) == 2 and all(t.agg(F.max(F.size("earlier"))).first()[0] == near_dedup.EARLIER for t in postings)


def test_equal_sets_only(documents):
    pairs = [(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "a b c d e f h"), (4, "A b c d e F g")]
    assert _near(near_dedup.near_duplicates(documents(pairs), percent=100)) == sorted(brute.near_duplicates(pairs, 100), key=repr)


def test_names_with_dots_stay(documents):
    docs = documents([(1, "a text of six words here"), (2, "a text of six words here"), (2, "a text of six words here"), (None, None)]).withColumn("a.b", F.lit(7))
    got = near_dedup.keep_one(docs)
    assert got.columns == docs.columns and sorted((r["doc_id"] or 0, r["a.b"]) for r in got.collect()) == [(0, 7), (1, 7)]


@pytest.mark.parametrize("shape", ["chain", "star", "random", "none"])
def test_components(spark, shape):
    rng = random.Random(7)
    if shape == "chain":
        links = [(i, i + 1) for i in range(40)]
    elif shape == "star":
        links = [(99, i) for i in range(60)] + [(99, 3), (3, 99)]
    elif shape == "random":
        links = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)]
    else:
        links = [(5, 5)]
    rng.shuffle(links)
    root = {n: n for link in links for n in link}
    for _ in range(100):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = components.components(spark.createDataFrame(links, "a LONG, b LONG"))
    assert dict(got.collect()) == {n: r for n, r in root.items() if n != r}


def _cut(frame):
    return brute.rows(frame, ["doc_id", "n_words", "n_removed", "kept_sha256"])


def _want(pairs, window):
    return sorted(((d, n, r, brute.sha(k)) for d, n, r, k in brute.repeats(pairs, window)), key=repr)


@pytest.mark.parametrize("window", [2, 50])
def test_repeats_of_odd_rows(odd, window):
    pairs, docs = odd
    assert _cut(substring_dedup.digest(docs, window)) == _want(pairs, window)


@pytest.mark.parametrize("seed,window,vocabulary", [(1, 6, 5), (2, 10, 40), (3, 50, 300), (4, 20, 3)])
def test_repeats_of_prose(documents, prose, seed, window, vocabulary):
    pairs = prose(n=80, seed=seed, vocabulary=vocabulary)
    want = _want(pairs, window)
    assert sum(r for _, _, r, _ in want) > 50
    assert _cut(substring_dedup.digest(documents(pairs), window)) == want


def test_a_longer_match_in_a_later_source(documents):
    """The smallest document with a block is not the one that holds the whole window."""
    words = [f"w{i}" for i in range(200)]
    pairs = [(1, " ".join(["x"] * 40 + words[40:70] + ["q"] * 30)), (2, " ".join(words[20:100])), (3, " ".join(["k"] * 7 + words[30:90]))]
    want = _want(pairs, 50)
    assert [r for _, _, r, _ in want] == [0, 0, 60]
    assert _cut(substring_dedup.digest(documents(pairs), 50)) == want


def test_text_without_repeats_stays_as_it_is(documents):
    passage = " ".join(f"w{i}" for i in range(60))
    docs = documents([(1, f"first  {passage}"), (2, f"a\tb {passage}\nend  "), (3, "left \n alone "), (4, None)])
    cut = substring_dedup.remove_repeats(docs)
    assert cut.columns == docs.columns
    assert {r.doc_id: r.text for r in cut.collect()} == {1: f"first  {passage}", 2: "a b end", 3: "left \n alone ", 4: None}
    with pytest.raises(ValueError):
        substring_dedup.repeats(docs, 5)


def test_empty_table(documents):
    assert substring_dedup.digest(documents([])).count() == 0
    assert near_dedup.near_duplicates(documents([])).count() == 0
    assert substring_dedup.remove_repeats(documents([])).where(F.lit(True)).count() == 0


def test_one_row_of_each_group_is_kept(documents):
    """Repeated rows, near copies of one id, groups without any id, and rows without words."""
    long = " ".join(f"w{i}" for i in range(200))
    pairs = [(7, long), (7, long), (7, f"{long} more"), (9, long), (None, long)]
    pairs += [(None, f"{long[::-1]} tail")] * 3 + [(None, f"{long[::-1]} tail and more")] + [(5, "alone in here")] * 2 + [(1, ""), (1, ""), (None, None)]
    docs = documents(pairs)
    got = near_dedup.keep_one(docs)
    assert got.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in got.collect()]
    assert sorted(i for i, t in rows if t and i) == [5, 7]
    assert len([t for i, t in rows if t and i is None]) == 1
    assert sorted(((i, t) for i, t in rows if not t), key=repr) == sorted([(1, ""), (1, ""), (None, None)], key=repr)
