"""Operators that look at one text, page or URL at a time."""

import functools
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from rasterloom.llm import fingerprint, html_text, language, packing, pii, url_filter

ARTICLE = "<article><h1>Title of it</h1><p>First   paragraph,\n with <b>bold</b> and <a href='#'>a link</a>.</p><p>Second &amp; last&nbsp;one<br>with a break.</article>"
TEXT = "Title of it\n\nFirst paragraph, with bold and a link.\n\nSecond & last one with a break."
PARAGRAPHS = [f"Paragraph {i} goes on about the matter, at some length, in plain words." for i in range(4)]
PLAIN = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
WANT = "\n\n".join(PARAGRAPHS)
MENU = "<ul>" + "".join(f"<li><a href='/{i}'>Section {i}</a></li>" for i in range(8)) + "</ul>"

PAGES = {
    "article": (f"<html><head><title>T</title><script>var a='</p>';</script></head><body><nav>{MENU}</nav><div class='ad'>Buy now</div>{ARTICLE}<footer>&copy; me</footer>", TEXT),
    "upper case": (f"<HTML><BODY><NAV>menu</NAV>{ARTICLE}</BODY></HTML>", TEXT),
    "div by density": (f"<body><div>{MENU}</div><div id=x>{PLAIN}</div><div><a href=/a>About</a> <a href=/b>Contact</a></div></body>", WANT),
    "sidebar": (f"<body><div id=main>{PLAIN}</div><div class='sidebar'><p>{PARAGRAPHS[0]}</p><p>{PARAGRAPHS[1]}</p></div></body>", WANT),
    "comments": (f"<body><main>{PLAIN}<section id='comments'><p>{'I disagree. ' * 40}</p></section></main></body>", WANT),
    "nested comment articles": (f"<body><article>{PLAIN}<div class='comment-list'><article><p>Nice one, thanks.</p></article></div></article></body>", None),
    "form and notice": (f"<body><div class='cookie-notice'><p>We use cookies.</p></div><article>{PLAIN}<form><p>Your mail</p><input name=a></form></article></body>", WANT),
    "aside and header": (f"<body><header><h1>Site name</h1></header><article><header><h1>Head</h1></header>{PLAIN}<aside>By the way</aside></article></body>", f"Head\n\n{WANT}"),
    "hidden": (f"<body><article>{PLAIN}<p style='display: none'>secret</p><p hidden>secret</p></article></body>", WANT),
    "unclosed comment": (f"<body><article>{PLAIN}</article><!-- never closed <p>gone</p>", WANT),
    "stray tags": (f"<body></div></p><article></b>{PLAIN}</i></article></body>", WANT),
    "quoted bracket": (f"<body><article title='a > b' data-x=\"<p>\">{PLAIN}</article></body>", WANT),
    "long attribute": (f"<body><article data-json='{'x' * 5000}>y' title=it's>{PLAIN}</article></body>", WANT),
    "heading ids": (f"<body><article><h2 id='related-work'>Related work</h2>{PLAIN}<h2 id='cookies' class='share'>Cookies</h2>{PLAIN}</article></body>", f"Related work\n\n{WANT}\n\nCookies\n\n{WANT}"),
    "section ids": (f"<body><nav>{MENU}</nav><article><p>Start.</p><section id='discussion'><h2>Discussion</h2>{PLAIN}</section></article></body>", f"Start.\n\nDiscussion\n\n{WANT}"),
    "prose of a weak name": (f"<body><nav>{MENU}</nav><article><p>Start.</p><div class='feedback-loop'>{PLAIN}</div></article></body>", f"Start.\n\n{WANT}"),
    "links of a weak name": (f"<body><article>{PLAIN}<div class='related'>{MENU}</div><div class='share-buttons'><a href=x>Post</a> <a href=y>Mail</a></div></article></body>", WANT),
    "references": (f"<body><article>{PLAIN}<ul><li><a href=a>One</a></li><li><a href=b>Two</a></li><li><a href=c>Three</a></li></ul></article></body>", f"{WANT}\n\nOne\n\nTwo\n\nThree"),
    "class inside a value": (f"<body><article><p data-x=\"a class='ad' b\">One.</p>{PLAIN}</article></body>", f"One.\n\n{WANT}"),
    "only text": ("just  some\ntext", "just some text"),
    "lone bracket": ("<p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"),
    "list": ("<article><p>Say:</p><ul><li>one<li>two</ul></article>", "Say:\n\none\n\ntwo"),
    "sections": (f"<body><div class=wrap><div class=content><div><h2>A</h2>{PLAIN}</div><div><h2>B</h2>{PLAIN}</div></div></div><div>{MENU}</div></body>", f"A\n\n{WANT}\n\nB\n\n{WANT}"),
    "empty": ("", ""),
    "no text": ("<html><body><nav>menu</nav></body></html>", ""),
    "unfinished tag": (f"<article>{PLAIN}</article><div class='", WANT),
}


@pytest.mark.parametrize("name", sorted(PAGES))
def test_main_text(name):
    page, want = PAGES[name]
    if want is None:
        want = WANT
    assert html_text.main_text(page) == want


def test_deep_and_long_pages_are_read():
    assert html_text.main_text("<div>" * 30_000 + "deep") == "deep"
    assert html_text.main_text("<article>" + "<p>word" * 30_000).count("word") == 30_000
    assert html_text.main_text("<" * 20_000).count("<") == 20_000
    assert html_text.main_text("<!" * 20_000) == ""
    assert html_text.main_text('<a "' * 3000) is not None
    assert html_text.main_text('<a b="' * 30_000) is not None
    assert html_text.main_text('<a b="c>' * 30_000) is not None


def test_density_falls_with_links_and_tags():
    assert html_text.density(0, 3, 0, 0, 0.1) == 0
    assert html_text.density(400, 2, 0, 0, 0.1) > html_text.density(400, 10, 0, 0, 0.1)
    assert html_text.density(400, 4, 10, 1, 0.1) > html_text.density(400, 4, 390, 4, 0.1)


def test_pages_table(spark):
    pages = spark.createDataFrame([(1, ARTICLE, "u", 5), (1, ARTICLE, "u", 5), (2, None, None, None), (None, "", "u", 1)], "page_id LONG, html STRING, url STRING, N_CHARS INT")
    got = html_text.extract(pages)
    assert got.columns == ["page_id", "html", "url", "text", "n_chars"]
    assert brute.rows(got, ["page_id", "text", "n_chars"]) == sorted([(1, TEXT, len(TEXT))] * 2 + [(2, "", 0), (None, "", 0)], key=repr)
    assert html_text.extract(pages.limit(0)).count() == 0
    dotted = html_text.extract(pages.withColumnRenamed("url", "a.b"))
    assert dotted.columns == ["page_id", "html", "a.b", "text", "n_chars"] and dotted.count() == 4


# --- URL rules

RULES = ["block net/", "allow example.net/en/", "block example.com/de/", "allow org/fr/", "block com", "allow a.b.example.com", "block ünï.de/Ä", "allow net/"]
URLS = [
    None, "", "example.net/en/", "http://example.net", "http://example.net/", "https://EXAMPLE.net/en/x?y#z", "https://a.example.net/en/", "https://notexample.net/en/",
    "http://example.net/EN/", "http://example.com/de/1", "http://example.com/de", "http://x.org/fr/", "http://org/fr/", "http://com", "http://x.com?x=/de/", "x://a.b.example.com/de/",
    "http://comx/", "http://x.comx/", "http://foo/x.net/y", "http://a.b/.net/", "http://x.net#/", "://net/", "http://ünï.de/Ä/", "http://ÜNÏ.de/Ä", "http://x.net:80/", "http://" + "a." * 3000 + "net/" + "p" * 9000,
]


def test_urls(spark):
    rules = url_filter.rules(RULES)
    pages = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(URLS)] + [(3, URLS[5], "h", 1)], "page_id LONG, url STRING, host STRING, VERDICT INT")
    got = url_filter.judge(pages, rules)
    assert [c.lower() for c in got.columns] == ["page_id", "url", "host", "path", "rule", "verdict"]
    want = [(i, *brute.best_url_rule(u, rules)) for i, u in [*enumerate(URLS), (3, URLS[5])]]
    assert brute.rows(got, ["page_id", "host", "path", "rule", "verdict"]) == sorted(want, key=repr)


def test_many_rules_cross_machine_words(spark):
    rng = random.Random(3)
    rules = url_filter.rules([f"{rng.choice(['allow', 'block'])} {rng.choice('abc')}{i % 7}.{rng.choice(['com', 'net'])}{rng.choice(['', '/', '/a', '/a/b'])}" for i in range(60)])
    urls = [f"http://{rng.choice(['', 'x.', 'a1.'])}{rng.choice('abc')}{rng.randrange(8)}.{rng.choice(['com', 'net'])}{rng.choice(['', '/', '/a', '/a/b/c'])}" for _ in range(300)]
    got = url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id LONG, url STRING"), rules)
    assert brute.rows(got, ["page_id", "host", "path", "rule", "verdict"]) == sorted(((i, *brute.best_url_rule(u, rules)) for i, u in enumerate(urls)), key=repr)
    assert url_filter.Automaton([r.text.encode() for r in rules]).words > 4


def test_no_rules_and_no_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.b/")], "page_id LONG, url STRING")
    assert brute.rows(url_filter.judge(pages, [], "block"), ["rule", "verdict"]) == [(None, "block")]
    assert url_filter.judge(pages.limit(0), url_filter.rules(RULES)).count() == 0
    with pytest.raises(ValueError):
        url_filter.rules(["deny x"])


# --- language


@pytest.fixture(scope="module")
def model(spark, sf):
    return language.fit(spark.read.parquet(f"{sf}/documents.parquet"))


def test_only_the_text_decides(model, spark, odd):
    pairs, docs = odd
    got = language.identify(docs, model)
    assert got.columns[-2:] == ["lang_pred", "score"] and "SCORE" not in got.columns
    rows = brute.rows(got, ["doc_id", "text", "lang_pred", "score"])
    assert len(rows) == len(pairs)
    for _, text, lang, score in rows:
        assert (lang == "und") == (not any(map(str.isalpha, text or ""))) and 0 <= score <= 1
        assert lang == "und" or lang in model.langs
    other = language.identify(docs.withColumn("lang", F.lit("fr")).withColumn("doc_id", F.lit(1)), model)
    assert sorted(brute.rows(other, ["text", "lang_pred"]), key=repr) == sorted(((r[1], r[2]) for r in rows), key=repr)


def test_nothing_is_learned_from_held_out_rows(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("alpha beta").alias("text"), F.lit("aa").alias("lang"))
    held = docs.withColumn("lang", F.when(language.held_out(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang")))
    assert language.fit(held).langs == ["aa"]
    none = language.fit(docs.withColumn("lang", F.lit(None).cast("string")))
    assert none.langs == [] and brute.rows(language.identify(docs.limit(2), none), ["lang_pred", "score"]) == [("und", 0.0)] * 2
    assert language.fit(docs.limit(0)).langs == []


@functools.lru_cache
def _entries(model):
    return dict(zip(model.words.tolist(), model.word_rows)), dict(zip(model.grams.tolist(), model.gram_rows))


def _plain_row(model, word):
    """A word's row, looked up entry by entry."""
    words, grams = _entries(model)
    code = int(language._hashes([word])[0])
    if code in words:
        return words[code]
    for size in language.SIZES:
        known = [grams[g] for g in language._hashes(language._grams(word, size)).tolist() if g in grams] if language._grams(word, size) else []
        if known:
            return np.mean(known, 0)
    return np.zeros(len(model.langs))


def _rows(model, words):
    points = language._points(" ".join(words))
    edges = np.r_[0, np.cumsum([len(w) + 1 for w in words])]
    rows, which = model.rows(points, edges[:-1], edges[1:] - 1)
    return rows[which]


def test_unseen_words_fall_back_to_shorter_grams(spark):
    rows = [(i, t, g) for i in range(50) for t, g in (("running jumping walking", "aa"), ("laufen springen gehen", "bb"))]
    model = language.fit(spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING"))
    talking, rufen, unknown = _rows(model, ["talking", "rufen", "漢字"])
    assert model.langs[int(talking.argmax())] == "aa"  # by "king"
    assert model.langs[int(rufen.argmax())] == "bb"
    assert unknown.tolist() == [0, 0]


def test_rows_of_many_words_at_once_are_those_of_each(model):
    words = ["the", "der", "ab", "x", "é", "zzqq", "thing", "stationed", "𝔘𝔫", "ñ", "the", "漢", "eau" * 40, "qxqx", "ier"]
    got = _rows(model, words)
    for word, row in zip(words, got):
        assert np.allclose(row, _plain_row(model, word), rtol=1e-4), word
    assert _rows(model, ["a"]).shape == (1, len(model.langs))


def test_scores_against_a_plain_version(model, spark, sf):
    import re

    sample = spark.read.parquet(f"{sf}/documents.parquet").limit(12)
    for r in language.identify(sample, model).collect():
        words = re.findall(language.WORD, (r["text"] or "").lower())
        total = np.sum([_plain_row(model, w) for w in set(words) for _ in range(words.count(w))], axis=0)
        assert r["lang_pred"] == model.langs[int(total.argmax())]
        mean = total / len(words) * min(len(words), language.CERTAIN_WORDS)
        assert abs(r["score"] - 1 / np.exp(mean - mean.max()).sum()) < 1e-3


def test_words_and_grams_that_there_is_room_for_are_kept(spark):
    """A language of few rows keeps its rarer words beside a large one with very many words."""
    letters = "".join(chr(0x4E00 + i) for i in range(400))
    rows = [(i, " ".join(letters[i] + letters[j] for j in range(375)) * 2, "aa") for i in range(400)]
    rows += [(1000 + i, "laufen springen", "bb") for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING")
    model = language.fit(docs.where(~language.held_out(F.col("doc_id"))).unionByName(docs.where("lang = 'bb'").withColumn("doc_id", F.lit(1))))
    assert len(model.words) > 100_000 and np.isin(language._hashes(["laufen", "springen"]), model.words).all()
    assert len(model.grams) > 100_000


def test_languages_take_turns_in_naming_entries(spark, monkeypatch):
    """With room for few entries a small language still has its commonest, and every entry has all languages' counts."""
    monkeypatch.setattr(language, "WORD_ENTRIES", 4)
    letters = "abcdefghij"
    rows = [(i, " ".join(letters[i % 10] + x for x in letters) + " shared", "aa") for i in range(300)] + [(1000 + i, "laufen laufen shared", "bb") for i in range(12)]
    model = language.fit(spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING"))
    assert len(model.words) <= 4 and np.isin(language._hashes(["laufen", "shared"]), model.words).all()
    shared = model.word_rows[np.flatnonzero(model.words == language._hashes(["shared"])[0])[0]]
    assert (shared > shared.max() - 3).all()  # counted in both


# --- personal data

CHARS = "a7 1234567890.@+-()%_ \n,éx"


def _spans(frame, column="spans"):
    return {r.doc_id: [(s.kind, s.start, s.end) for s in r[column]] for r in frame.select("doc_id", column).collect()}


def test_spans_of_random_texts(documents):
    rng = random.Random(11)
    cards = ["4111 1111 1111 1111", "4111-1111-1111-1112", "6304 0000 0000 0000 000", "+49 (30) 1234-5678", "+1 555", "1.2.3.4.5.6.7.8", "256.1.1.1", "0255.1.01.1", "a@b.c_d@e.f", "@a.b", "x@y", "x@y.z-", "😀+4930123456é"]
    texts = ["".join(rng.choice(CHARS) for _ in range(rng.randrange(60))) for _ in range(600)]
    texts += [rng.choice(["", "é "]) + rng.choice(cards) + rng.choice(["", " ", "9", "."]) + rng.choice(cards) for _ in range(300)]
    pairs = list(enumerate(texts))
    assert _spans(pii.with_spans(documents(pairs))) == {i: brute.base_spans(t) for i, t in pairs}


def test_runs_without_end_take_linear_time(documents):
    texts = ["a" * 200_000, "1" * 200_000, "a.a@" * 30_000, "1.2." * 40_000, "+1 " * 40_000, "x@" + "a." * 60_000 + "b", "9 " * 60_000]
    got = _spans(pii.with_spans(documents(list(enumerate(texts)))))
    assert got[0] == [] and got[5] == [("email", 0, 120_003)]


def test_a_text_of_very_many_spans_takes_linear_time(documents):
    """Spans are found, and the text is sanitised, in a time that grows with the spans and not with their square."""
    texts = [" ".join(f"é{i} user{i}@mail{i % 7}.example" for i in range(n)) for n in (20_000, 100_000)]
    spent = []
    for text in [texts[0], *texts]:  # the first run loads the classes
        docs = pii.with_spans(documents([(1, text)]).select("doc_id", "text"))
        began = time.monotonic()
        row = docs.select("spans", pii.sanitised(F.col("text"), F.col("spans")).alias("clean")).first()
        spent.append(time.monotonic() - began)
    assert [(s.kind, s.start, s.end) for s in row.spans] == brute.base_spans(texts[1])
    assert row.clean == " ".join(f"é{i} [EMAIL]" for i in range(100_000))
    assert spent[2] < 12 * spent[1] + 2


def test_overlapping_spans_and_words_cut_by_spans(documents):
    """Kinds overlap in a text of several blocks; a word that runs into a span is no word of its gap."""
    rng = random.Random(21)
    bits = ["4111 1111 1111 1111", "+4111111111111 111", "1.2.3.4", "a@1.2.3.4", "Wort", "é", " ", "😀", ", ", "x" * 200, "+1 555 1234567a@b.c"]
    pairs = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(60)))) for i in range(200)]
    rows = pii.with_spans(documents(pairs).select("doc_id", "text"))
    got = {r.doc_id: r.clean for r in rows.select("doc_id", pii.sanitised(F.col("text"), F.col("spans")).alias("clean")).collect()}
    assert got == {i: brute.sanitised(t) for i, t in pairs}

    filler = [(100 + i, f"{chr(97 + i % 26)}{chr(97 + i // 26)}q writes plain words") for i in range(300)]
    cut = [(i, f"{chr(97 + i)}q Ganzwort éGanzwort@firm.example, +49 30 1234567Ganzwort") for i in range(4)]
    found = _spans(pii.all_spans(documents(cut + filler).select("doc_id", "text")))
    for i, text in cut:
        words = [text[s:e] for k, s, e in found[i] if k == "term"]
        assert words == ["Ganzwort", "Ganzwort"] and ("term", 3, 11) in found[i] and ("term", len(text) - 8, len(text)) in found[i]


def test_names_with_dots_stay(documents):
    docs = documents([(1, "mail a@b.cz now"), (2, None)]).withColumn("a.b", F.lit(7))
    got = pii.sanitise(docs)
    assert got.columns == docs.columns and {(r["doc_id"], r["text"], r["a.b"]) for r in got.collect()} == {(1, "mail [EMAIL] now", 7), (2, None, 7)}


def test_odd_rows_have_spans(odd):
    pairs, docs = odd
    got = pii.all_spans(docs)
    assert got.columns[-2:] == ["base", "spans"] and got.count() == len(pairs)
    assert pii.all_spans(docs.limit(0)).count() == 0


def test_text_is_sanitised(documents):
    text = "Mail é@x a.b@c.de, call +49 30 1234567 or 4111 1111 1111 1111 from 10.0.0.1."
    docs = documents([(1, text), (2, None), (3, "nothing here")])
    got = pii.sanitise(docs)
    assert got.columns == docs.columns
    assert {r.doc_id: r.text for r in got.collect()} == {1: brute.sanitised(text), 2: None, 3: "nothing here"}
    assert brute.sanitised(text) == "Mail é@x [EMAIL], call [PHONE] or [CARD] from [IP]."
    assert {r.base for r in got.collect()} == {2}


def test_a_term_that_gives_a_value_away_is_a_span(documents):
    """One word is only ever seen near one address, in several contexts; common words and copies disclose nothing."""
    names = "alpha beta gamma delta epsilon zeta".split()
    pairs = [(i, f"the {names[i]} project of Zyxwort {names[-i]} writes from boss@corp.example about the {names[i]} work") for i in range(5)]
    pairs += [(100 + i, f"the plain text {i} about the {names[i % 6]} work and project that writes of nothing from here") for i in range(200)]
    pairs += [(400 + i, "only unusualword beside copy@corp.example here") for i in range(6)]
    docs = documents(pairs)
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in pii.all_spans(docs).collect()}
    for i in range(5):
        text = pairs[i][1]
        at = text.index("Zyxwort")
        assert ("term", at, at + 7) in got[i]
        assert not any(text[s:e] in ("the", "project", "work") for k, s, e in got[i] if k == "term")
    assert all([k for k, _, _ in got[400 + i]] == ["email"] for i in range(6))
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert "[TERM]" in clean[0] and "Zyxwort" not in clean[0] and clean[120] == dict(pairs)[120]
    narrow = pii.all_spans(docs.select("doc_id", "text"), keep_text=False)
    assert narrow.columns == ["doc_id", "base", "spans"] and _spans(narrow) == got


def test_copies_of_a_text_do_not_hide_a_term(documents):
    """One of the five texts that hold value and term is in many rows; each count takes it once."""
    names = "alpha beta gamma delta epsilon zeta".split()
    pairs = [(i, f"the {names[i]} project of Zyxwort {names[-i]} writes from boss@corp.example about the {names[i]} work") for i in range(5)]
    pairs += [(1000 + i, pairs[2][1]) for i in range(300)]
    pairs += [(100 + i, f"the plain text {i} {chr(97 + i % 26)}{chr(97 + i // 26)}q about the {names[i % 6]} work and project that writes of nothing from here") for i in range(200)]
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in pii.all_spans(documents(pairs)).collect()}
    for i in (*range(5), 1000, 1299):
        at = dict(pairs)[i].index("Zyxwort")
        assert ("term", at, at + 7) in got[i]


def test_terms_at_the_edge_of_a_text_or_far_from_the_value_are_spans(documents):
    """The word is the first or last one of its text, or hundreds of characters away from the address."""
    filler = " and then some words of no great weight follow here" * 8
    pairs = [(i, f"Novakova{i % 2 * 'x'}: a@b.cz {chr(97 + i)}q") for i in range(8)]
    pairs += [(20 + i, f"{chr(97 + i)}q writes c@d.cz Zyxwort") for i in range(4)]
    pairs += [(40 + i, f"{chr(97 + i)}q Farawort went{filler} e@f.cz") for i in range(4)]
    pairs += [(100 + i, f"{chr(97 + i % 26)}{chr(97 + i // 26)}q writes and then went{filler}") for i in range(200)]
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in pii.all_spans(documents(pairs)).collect()}
    for i, word in ((0, "Novakova"), (1, "Novakovax"), (20, "Zyxwort"), (40, "Farawort")):
        at = dict(pairs)[i].index(word)
        assert ("term", at, at + len(word)) in got[i], word
    assert not any(k == "term" for i in range(100, 300) for k, _, _ in got[i])


def test_terms_of_values_seen_once_or_twice(documents):
    """Words of no other text give a value of one or two texts away in a large corpus; words of other texts do not."""
    pairs = [(1, "Onceword sends a note from one@corp.example today"), (2, "ask Twiceword by two@corp.example today"), (3, "two@corp.example is where Twiceword reads")]
    pairs += [(10 + i, f"text {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}q sends a note today and reads where") for i in range(1500)]
    pairs += [(5000 + i, "a word by itself: note ask") for i in range(3)]
    docs = documents(pairs)
    got = {r.doc_id: [(s.kind, r.text[s.start : s.end]) for s in r.spans] for r in pii.all_spans(docs).collect()}
    assert ("term", "Onceword") in got[1] and ("term", "Twiceword") in got[2] and ("term", "Twiceword") in got[3]
    assert not {"sends", "note", "today", "ask", "reads", "where"} & {word for i in (1, 2, 3) for _, word in got[i]}
    assert all(not got[i] for i, _ in pairs[3:])


def test_a_value_of_all_texts_is_not_given_away(documents):
    got = pii.all_spans(documents([(i, f"word{chr(97 + i)} of all@corp.example") for i in range(4)])).collect()
    assert [[s.kind for s in r.spans] for r in got] == [["email"]] * 4


# --- fingerprints


def test_walks_together_and_alone_agree():
    rng = random.Random(2)
    texts = ["".join(rng.choice("abc é漢😀\0") for _ in range(n)) for n in (0, 1, 2, 3, 17, 63, 64, 200, 701, 3000)]
    assert fingerprint.fingerprint_all(texts) == [brute.walk(t, fingerprint) for t in texts]


def test_likeness_follows_edits():
    rng = random.Random(8)
    base = [rng.choice("abcdefgh ") for _ in range(4000)]
    prints = []
    for edits in (0, 4, 40, 400):
        text = list(base)
        for _ in range(edits):
            at = rng.randrange(len(text))
            text[at : at + rng.randrange(2)] = rng.choice("abcdefgh ") * rng.randrange(1, 2)
        prints.append("".join(text))
    prints.append("".join(rng.choice("abcdefgh ") for _ in range(4000)))
    prints = fingerprint.fingerprint_all(prints)
    like = [fingerprint.likeness(prints[0], p) for p in prints]
    assert like[0] == 1 and like[1] > 0.9 and like[1] >= like[2] > like[3] >= 0 and like[4] < 0.3
    assert fingerprint.likeness("", "") == 1 and fingerprint.likeness("", prints[0]) == 0


def test_similar_texts_meet_in_a_band(documents, prose):
    pairs = [(i, t) for i, t in prose(n=40, seed=6) if len(t) > 200]
    near = [(1000 + i, t[:-10] + "tail") for i, t in pairs[:10]]
    prints = fingerprint.fingerprints(documents(pairs + near))
    assert prints.columns[-1] == "fingerprint"
    by_id = {r.doc_id: r.fingerprint for r in prints.collect()}
    found = {frozenset(r[:2]) for r in fingerprint.similar(prints, 0.8).collect()}
    hit = sum(frozenset((by_id[1000 + i], by_id[i])) in found or any(by_id[1000 + i] in f for f in found) for i, _ in pairs[:10])
    assert hit >= 9
    assert fingerprint.similar(prints.limit(0)).count() == 0


@pytest.mark.parametrize("parts", [1, 7])
def test_neighbours_of_odd_rows(spark, odd, parts):
    pairs, docs = odd
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = fingerprint.edited_neighbours(docs).toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    ordered = sorted(((i, t or "") for i, t in pairs), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    texts = [t for _, t in ordered]
    want = []
    for (i, text), after in zip(ordered, texts[1:] + texts[:1]):
        half = len(text) // 2
        want.append((i, len(text), brute.sha(text[: len(text) - half] + after[:half])))
    have = [(None if np.isnan(i) else int(i), n, s) for i, n, s in zip(got.doc_id, got.n_chars, got.edited_sha256)]
    assert sorted(have, key=repr) == sorted(want, key=repr)
    assert got.near_edited.between(0, 1).all() and got.near_next.between(0, 1).all()


def test_one_document_and_none_have_neighbours(documents):
    one = fingerprint.edited_neighbours(documents([(5, "abcdef")])).collect()
    assert [(r.doc_id, r.edited_sha256, r.near_next) for r in one] == [(5, brute.sha("abcabc"), 1.0)]
    assert fingerprint.edited_neighbours(documents([])).count() == 0


# --- packing


def _used(plan):
    used = {}
    for pattern, times in plan:
        for length, copies in pattern:
            used[length] = used.get(length, 0) + copies * times
    return used


@pytest.mark.parametrize("seed", range(12))
def test_plans_use_every_piece_once_and_waste_little(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 100, 1024])
    counts = {rng.randint(1, capacity): rng.choice([1, 2, 7, 1000]) for _ in range(rng.randint(1, 80))}
    plan = packing.plan(counts, capacity)
    assert _used(plan) == counts
    assert all(0 < sum(n * c for n, c in pattern) <= capacity for pattern, _ in plan)
    assert sum(times for _, times in plan) <= brute.best_fit(counts, capacity)


def test_lengths_as_documents_have_them_leave_next_to_no_room():
    rng = random.Random(1)
    lengths = [min(1024, max(1, int(rng.lognormvariate(5.8, 1)))) for _ in range(30_000)]
    plan = packing.plan({n: lengths.count(n) for n in set(lengths)}, 1024)
    assert sum(times for _, times in plan) <= 1.001 * sum(lengths) / 1024


def test_exact_complements_are_found():
    assert sum(t for _, t in packing.plan({600: 5, 424: 5, 1024: 2, 500: 3, 300: 3, 224: 3}, 1024)) == 10
    assert packing.plan({}, 1024) == []
    with pytest.raises(ValueError):
        packing.plan({2000: 1}, 1024)


def test_ids_survive_packing(spark, odd):
    from tokenizers import Tokenizer

    pairs, docs = odd
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    tokenizer.encode_special_tokens = True
    placed = packing.pack(packing.pieces(docs, capacity=64, keep_ids=True), 64)
    sequences = {r.sequence_id: r.ids for r in packing.assemble(placed).collect()}
    assert max(map(len, sequences.values())) <= 64
    whole = {}
    for r in placed.collect():
        assert sequences[r.sequence_id][r.offset : r.offset + r.length] == r.ids
        whole.setdefault(r.doc_id, []).append((r.start, r.ids))
    for doc in {i for i, _ in pairs}:
        texts = [t or "" for i, t in pairs if i == doc]
        ids = sorted(tuple([*tokenizer.encode(t, add_special_tokens=False).ids, 2]) for t in texts)
        assert sum(len(x) for _, x in whole[doc]) == sum(map(len, ids))
        if len(ids) == 1:
            assert [x for _, part in sorted(whole[doc]) for x in part] == list(ids[0])
    assert packing.pack(packing.pieces(docs.limit(0))).count() == 0


def test_chunks_give_the_ids_of_whole_texts():
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    encoder, tokenizer = packing.Encoder(path), Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice(" \n\t  ab1'.é日😀s’") for _ in range(rng.randrange(25)))
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert encoder.ids("<|endoftext|>") == np.array(tokenizer.encode("<|endoftext|>").ids, "<u4").tobytes()
    assert re.match("<bound method Encoding", repr(encoder._encode))


def test_added_tokens_have_their_own_ids(documents):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    texts = ["<|endoftext|>", "one<|endoftext|>two", "  <|endoftext|> \n<|endoftext|>é", "<|endoftext", "plain  text of\nlines"]
    want = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
    assert tokenizer.token_to_id("<|endoftext|>") in want[1]
    got = packing.pieces(documents(list(enumerate(texts))), keep_ids=True).collect()
    assert {r.doc_id: r.ids for r in got} == want
