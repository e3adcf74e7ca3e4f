"""Personal data: spans of fixed kinds, and terms that would give them away, with DataFrame operations only.

Four kinds are found by pattern. The corpus then says which words disclose a found value: a word's pointwise mutual
information with the value, over the documents, relative to the value's own information. A word that exceeds the
threshold is generalised wherever a document holds both. Values seen once or twice are weighed like any other: the
share of a term's texts that hold the value is smoothed by one text more that does not, so that little support counts
for less, and the fewer documents there are the less it does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rasterloom.llm.arrow import aside, back, without
from rasterloom.llm.texts import FETCH_BYTES
from rasterloom.operators.lookup import fits_broadcast
from rasterloom.session import settle, stored

# fixed values: the patterns of the kinds, in the order of listing, and the parts and digits that make a match valid
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
IP_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

# the same patterns without backtracking: a run is taken whole, and not tried again from inside
_FIND = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_HINT = {"email": "@", "ip": ".", "card": None, "phone": "+"}

TERM = "term"
WORD = r"[\p{L}\p{M}]+"
UNSEEN = 1  # texts with the term and without the value that are supposed besides those seen
DISCLOSURE = 0.9  # part of a value's information that a term may not give away

RUN = 128  # values that are summed one by one
BLOCK = 512  # code points of the blocks that a text is cut from

_SPANS = "array<struct<kind:string,start:long,end:long>>"
_FOUND = "array<struct<kind:string,start:long,end:long,found:string>>"


def _valid(kind: str, found: Column) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    if kind == "ip":
        return found.rlike(rf"^{IP_PART}(?:\.{IP_PART}){{3}}$")
    if kind == "card":
        return F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _once(value: Column, use) -> Column:
    """``use`` of a value that is computed once for each row, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(values: Column, combine) -> Column:
    """Running sums, or the like, of a bound array of longs; 0 is the neutral value.

    Runs of ``RUN`` values are summed on their own and then moved, as appending to one long array copies it each time.
    """

    def run(c: Column) -> Column:
        return F.sequence(c * RUN, F.least((c + 1) * RUN, F.size(values)) - 1)

    none = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<long>").alias("seen"))
    totals = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / RUN).cast("int")), lambda c: F.aggregate(run(c), F.lit(0).cast("long"), lambda at, i: combine(at, F.get(values, i))))
    starts = F.aggregate(totals, none, lambda st, t: F.struct(combine(st["at"], t).alias("at"), F.concat(st["seen"], F.array(st["at"])).alias("seen")), lambda st: st["seen"])

    def within(base: Column, c: Column) -> Column:
        first = F.struct(base.alias("at"), F.array().cast("array<long>").alias("seen"))

        def add(st: Column, i: Column) -> Column:
            return _once(combine(st["at"], F.get(values, i)), lambda at: F.struct(at.alias("at"), F.concat(st["seen"], F.array(at)).alias("seen")))

        return F.aggregate(run(c), first, add, lambda st: st["seen"])

    return F.when(F.size(values) == 0, F.array().cast("array<long>")).otherwise(F.flatten(F.transform(starts, within)))


def _located(text: Column, pattern: str, kind: str, valid=None) -> Column:
    """Spans of the valid matches, in code points, with what they hold: lengths of the matches and of the gaps, summed up."""
    matched = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), F.split(text, pattern, -1).alias("gaps"))

    def place(m: Column) -> Column:
        steps = F.transform(m["hits"], lambda hit, i: (F.length(F.get(m["gaps"], i)) + F.length(hit)).cast("long"))
        ends = _once(steps, lambda sizes: _running(sizes, lambda x, y: x + y))
        return _once(ends, lambda at: F.transform(m["hits"], lambda hit, i: _span(F.lit(kind), F.get(at, i) - F.length(hit), F.get(at, i), hit)))

    spans = _once(matched, lambda m: F.when(F.size(m["hits"]) == 0, F.array().cast(_FOUND)).otherwise(place(m)))
    return spans if valid is None else F.filter(spans, lambda s: valid(s["found"]))


def _span(kind: Column, start: Column, end: Column, found: Column) -> Column:
    return F.struct(kind.alias("kind"), start.cast("long").alias("start"), end.cast("long").alias("end"), found.alias("found"))


def _found_spans(text: Column) -> Column:
    """All valid spans with what they hold. A text without the hint of a kind is not searched."""
    body = F.coalesce(text.cast("string"), F.lit(""))
    digit = body.rlike("[0-9]")
    parts = []
    for kind in KINDS:
        wanted = F.contains(body, F.lit("@")) if kind == "email" else digit
        if kind in ("ip", "phone"):
            wanted = wanted & F.contains(body, F.lit(_HINT[kind]))
        located = _located(body, _FIND[kind], kind, lambda hit, kind=kind: _valid(kind, hit))
        parts.append(F.when(wanted, located).otherwise(F.array().cast(_FOUND)))
    return F.concat(*parts)


def _bare(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def base_spans(text: Column) -> Column:
    """All valid spans: kinds in the order listed, each by start."""
    return _bare(_found_spans(text))


def with_spans(docs: DataFrame, text: str = "text", name: str = "spans") -> DataFrame:
    """Add the base spans; a null text has none. A column of that name is replaced."""
    return without(docs, [name]).withColumn(name, base_spans(F.col(text)))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def _gaps(text: Column, spans: Column) -> Column:
    """What lies outside the spans, in order: (at, gap, kind), kind being that of the span behind it, null at the end.

    Of overlapping spans the first in place gives the kind. ``before`` and ``after`` are the characters around the gap.
    The text is cut into blocks once, so that a gap is not looked for from the start of the text.
    """
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    given = F.struct(ordered.alias("spans"), F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)).alias("blocks"), F.length(text).cast("long").alias("n"))

    def cut(blocks: Column, a: Column, z: Column) -> Column:
        def part(k: Column) -> Column:
            low = F.greatest(a - k * BLOCK, F.lit(0))
            return F.substring(F.get(blocks, k.cast("int")), (low + 1).cast("int"), (F.least(z - k * BLOCK, F.lit(BLOCK)) - low).cast("int"))

        whole = F.array_join(F.transform(F.sequence(F.floor(a / BLOCK), F.floor((z - 1) / BLOCK)), part), "")
        return F.when(a < z, whole).otherwise(F.lit(""))

    def find(g: Column) -> Column:
        reached = _once(F.transform(g["spans"], lambda s: s["end"]), lambda ends: _running(ends, lambda x, y: F.greatest(x, y)))

        def between(reach: Column) -> Column:
            def row(at: Column, until: Column, kind: Column) -> Column:
                return F.struct(at.alias("at"), until.alias("until"), kind.alias("kind"))

            inner = F.transform(g["spans"], lambda s, i: row(F.coalesce(F.get(reach, i - 1), F.lit(0).cast("long")), s["start"], s["kind"]))
            last = row(F.coalesce(F.get(reach, F.size(reach) - 1), F.lit(0).cast("long")), g["n"], F.lit(None).cast("string"))
            return F.concat(F.filter(inner, lambda s: s["at"] <= s["until"]), F.array(last))

        def fill(s: Column) -> Column:
            return F.struct(
                s["at"].alias("at"),
                cut(g["blocks"], s["at"], s["until"]).alias("gap"),
                s["kind"].alias("kind"),
                cut(g["blocks"], F.greatest(s["at"] - 1, F.lit(0)), s["at"]).alias("before"),
                cut(g["blocks"], s["until"], F.least(s["until"] + 1, g["n"])).alias("after"),
            )

        return F.transform(_once(reached, between), fill)

    return _once(given, find)


def mentions(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per distinct text with spans: its key, its text and spans, the values it shows, and all its distinct words
    of three letters or more."""
    rows = _texts(docs, text).withColumn("found", _found_spans(F.col("text"))).where(F.size("found") > 0)
    shown = F.transform("found", lambda s: F.concat_ws(":", s["kind"], F.lower(s["found"])))
    rows = rows.select("text_key", "text", _bare(F.col("found")).alias("spans"), F.array_distinct(shown).alias("values"))
    words = F.filter(F.array_distinct(_words(F.col("text"))), lambda w: F.length(w) > 2)
    return rows.dropDuplicates(["text_key"]).withColumn("words", words)


def value_classes(seen: DataFrame) -> DataFrame:
    """Rows (text_key, class, with_value): values of the very same texts are one class, named by the smallest of them."""
    held = seen.select("text_key", F.explode("values").alias("value"))
    # a set of texts is known by its size and 128 bits
    place = held.groupBy("value").agg(
        F.count(F.lit(1)).alias("with_value"), F.bit_xor(F.xxhash64("text_key")).alias("h1"), F.bit_xor(F.xxhash64(F.lit(1), "text_key")).alias("h2")
    )
    names = place.groupBy("with_value", "h1", "h2").agg(F.min("value").alias("class")).select("class", "with_value")
    return held.join(names, F.col("value") == F.col("class")).select("text_key", "class", "with_value")


def _texts(docs: DataFrame, text: str) -> DataFrame:
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(body.alias("text"), F.md5(body.cast("binary")).alias("text_key"))


def term_counts(docs: DataFrame, copies: DataFrame, text: str = "text") -> DataFrame:
    """Per term the number of distinct texts that hold it; ``copies`` has the keys of texts in several rows, and how many.

    All n rows of a text hold the same words, so the rows counted for a term among texts of n rows are n times its
    texts. No text is shuffled while the keys of copied texts fit a broadcast.
    """
    given = copies.select(F.col("text_key").alias("_llm_key"), "n")
    side = F.broadcast(given) if fits_broadcast(given, 56, FETCH_BYTES) else given
    rows = _texts(docs, text).join(side, F.col("text_key") == F.col("_llm_key"), "left")
    words = rows.select(F.coalesce("n", F.lit(1).cast("long")).alias("n"), F.explode(F.array_distinct(_words(F.col("text")))).alias("term"))
    counted = words.where(F.length("term") > 2).groupBy("term", "n").agg(F.count(F.lit(1)).alias("held"))
    return counted.groupBy("term").agg(F.sum(F.expr("held div n")).alias("with_term"))


def disclosing_terms(
    docs: DataFrame, seen: DataFrame, classes: DataFrame, text: str = "text", unseen: float = UNSEEN, disclosure: float = DISCLOSURE
) -> DataFrame:
    """Pairs (class, term) in which the term gives away at least ``disclosure`` of the information of the class's values.

    With p over distinct texts: log(p(value, term) / (p(value) p(term))) >= disclosure * -log p(value), the term being
    anywhere in a text of the value, and held by ``unseen`` more texts without the value. A term of a single text thus
    gives its value away among 1024 texts or more, as it stands for 0.9 of the value's information then. All counts are
    of distinct texts, so that copies of one text neither make a term disclose anything nor hide that it does.
    """
    none = classes.limit(0).select("class", F.lit("").alias("term"), F.lit(0.0).alias("ratio"))
    if classes.isEmpty():
        return none
    keys = stored(_texts(docs, text).groupBy("text_key").agg(F.count(F.lit(1)).alias("n")))
    n = float(max(keys.count(), 2))
    # A value and a term share at most the value's texts, so a term of more texts than this discloses no value of so
    # many texts. Only such pairs are made; no term that could pass is left out.
    most = n ** (1 - disclosure) * F.pow(F.col("with_value").cast("double"), F.lit(disclosure)) * (1 + 1e-9)
    top = classes.agg(F.max(most)).first()[0]
    counts = term_counts(docs, stored(keys.where("n > 1")), text).where(F.col("with_term") + unseen <= top)
    rare = stored(seen.select("text_key", F.explode("words").alias("term")).join(counts, "term"))
    pairs = rare.join(classes, "text_key").where(F.col("with_term") + unseen <= most)
    both = pairs.groupBy("class", "term", "with_value", "with_term").agg(F.count(F.lit(1)).alias("both"))
    own = -F.log(F.col("with_value") / n)
    mutual = F.log(F.col("both") * n / (F.col("with_value") * (F.col("with_term") + unseen)))
    # a value of all texts has no information to give away
    return both.where(own > 0).withColumn("ratio", F.try_divide(mutual, own)).where(F.col("ratio") >= disclosure).select("class", "term", "ratio")


def term_spans(seen: DataFrame, classes: DataFrame, terms: DataFrame) -> DataFrame:
    """Per text key the spans of the terms that disclose a value of the same text, outside the base spans."""
    wanted = stored(classes.select("text_key", "class").join(terms, "class").select("text_key", "term").distinct())
    texts = seen.select("text_key", "text", "spans").join(wanted.select("text_key").distinct(), "text_key", "left_semi")
    gaps = texts.select("text_key", F.explode(_gaps(F.col("text"), F.col("spans"))).alias("g"))
    # a word that a span cuts is no word of its gap
    letter = rf"^{WORD}$"
    first, last = F.col("g.before").rlike(letter), F.col("g.after").rlike(letter)
    hits = gaps.select("text_key", "g.at", F.length("g.gap").alias("size"), first.alias("first"), last.alias("last"), F.explode(_located(F.col("g.gap"), WORD, TERM)).alias("w"))
    whole = ~(F.col("first") & (F.col("w.start") == 0)) & ~(F.col("last") & (F.col("w.end") == F.col("size")))
    hits = hits.where(whole).select("text_key", F.lower("w.found").alias("term"), (F.col("at") + F.col("w.start")).alias("start"), (F.col("at") + F.col("w.end")).alias("end"))
    met = hits.join(wanted, ["text_key", "term"], "left_semi")
    spans = F.array_sort(F.collect_list(F.struct(F.lit(TERM).alias("kind"), "start", "end")))
    return met.groupBy("text_key").agg(spans.alias("term_spans"))


def all_spans(docs: DataFrame, text: str = "text", keep_text: bool = True, base: str = "base", spans: str = "spans") -> DataFrame:
    """Add ``base`` (spans of the four kinds) and ``spans`` (those, then the terms'); such columns are replaced.

    Without ``keep_text`` the text column itself is dropped, and no text is shuffled. Rows are kept as they are:
    null texts have no spans, repeated rows get the same ones.
    """
    seen = stored(mentions(docs, text))
    classes = stored(value_classes(seen))
    terms = settle(disclosing_terms(docs, seen, classes, text))
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = without(docs, [c for c in (base, spans) if c != text]).withColumn(base, base_spans(F.col(text)))
    if terms.isEmpty():
        rows = rows.withColumn(spans, F.col(base))
        return rows if keep_text else rows.drop(text)
    extra = settle(term_spans(seen, classes, terms))
    names = rows.columns if keep_text else [c for c in rows.columns if c != text]
    keyed = rows.withColumn("_llm_key", F.when(F.size(base) > 0, F.md5(body.cast("binary"))))
    # only rows with base spans can meet a term; the others pass by without a shuffle
    plain = keyed.where(F.col("_llm_key").isNull()).withColumn(spans, F.col(base)).select(*names, spans)
    joined = keyed.where(F.col("_llm_key").isNotNull()).select(*names, "_llm_key")
    joined = joined.join(extra.withColumnRenamed("text_key", "_llm_key"), "_llm_key", "left")
    both = F.concat(base, F.coalesce("term_spans", F.array().cast(_SPANS)))
    return plain.unionByName(joined.withColumn(spans, both).select(*names, spans))


def spelled(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def sanitised(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; of overlapping spans the first in place wins."""

    def spell(g: Column) -> Column:
        return F.concat(g["gap"], F.when(g["kind"].isNull(), F.lit("")).otherwise(F.concat(F.lit("["), F.upper(g["kind"]), F.lit("]"))))

    return F.when(F.size(spans) == 0, text).otherwise(F.array_join(F.transform(_gaps(text, spans), spell), ""))


def sanitise(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with base spans and disclosing terms replaced by their kind; other columns as they are."""
    given, own = aside(docs)
    rows = all_spans(given, own[text], base="_llm_base", spans="_llm_spans")
    return back(rows.withColumn(own[text], sanitised(F.col(own[text]), F.col("_llm_spans"))), own)
