import pytest

from rasterloom.operators import prompts

ROUTES = [
    ("Show me F-8 imagery", "fetch_satellite", "F-8"),
    ("Load Centaurus", "fetch_satellite", "Centaurus"),
    ("Fetch satellite imagery of NUST", "fetch_satellite", "NUST"),
    ("Open Blue Area", "fetch_satellite", "Blue Area"),
    ("Display I-8", "fetch_satellite", "I-8"),
    ("What is NDVI?", "ask_question", "What is NDVI?"),
    ("Explain KMeans", "process_image", "kmeans"),
    ("Getting started", "fetch_satellite", "ting started"),
    ("  VIEW \t the  Picture for\nG-9  ", "fetch_satellite", "the G-9"),
    ("view offices forever", "fetch_satellite", "offices forever"),
    ("run k-means, then threshold", "process_image", "kmeans"),
    ("threshold and k-means", "process_image", "kmeans"),
    ("Apply Mean Filter", "process_image", "meanfilter"),
    ("compression of this", "process_image", "compress"),
    ("find clusters", "process_image", "kmeans"),
    ("please classify", "process_image", "kmeans"),
    ("distance to cluster", "process_image", "distance"),
    (" show H-8 ", "fetch_satellite", "H-8"),
    ("   ", "ask_question", ""),
    (None, "ask_question", ""),
]


def test_routes(spark):
    frame = spark.createDataFrame([(p,) for p, _, _ in ROUTES], "prompt STRING")
    rows = prompts.routed(frame).collect()
    for (prompt, intent, value), row in zip(ROUTES, rows):
        field = {"fetch_satellite": "location", "process_image": "operation", "ask_question": "question"}[intent]
        assert (prompt, row.intent, row[field]) == (prompt, intent, value)
        assert [row[f] is None for f in ("location", "operation", "question")].count(True) == 2


ANSWERS = [
    ("Reasoning: x\ny\nFinal answer: 42", "42"),
    ("<think>a\nb</think>Hello <think>c</think>there", "Hello there"),
    ("Thinking process: no answer follows", ""),
    ("  Analysis : a\n\n  Response : fine", "fine"),
    ("Text\nAnswer: yes\nresponse:no", "Text\nyes\nno"),
    ("Step 1 do this\nkeep\nstage2: that\nstep by step", "keep\n\nstep by step"),
    ("a\n\n\n\n\nb", "a\n\nb"),
    ("  plain \x1f", "plain"),
    ("The reasoning: stays", "The reasoning: stays"),
    ("", ""),
    (None, ""),
]


@pytest.mark.parametrize("answer, expected", ANSWERS)
def test_clean(spark, answer, expected):
    frame = spark.createDataFrame([(answer,)], "answer STRING")
    assert prompts.cleaned(frame).first().cleaned == expected


def test_long_answers_are_cleaned_whole(spark):
    text = "Reasoning: " + "word\n" * 40_000 + "Answer: " + "tail " * 40_000
    frame = spark.createDataFrame([(text,)], "answer STRING")
    assert prompts.cleaned(frame).first().cleaned == ("tail " * 40_000).strip()


def test_operations_asked_for(spark):
    frame = spark.createDataFrame([(0, "show x"), (1, "run kmeans"), (2, "why?"), (3, "negative please")], "turn INT, prompt STRING")
    found = prompts.operations(frame)
    assert [(r.turn, r.operation) for r in found.orderBy("turn").collect()] == [(1, "kmeans"), (3, "negative")]


def test_intent_counts(spark):
    frame = spark.createDataFrame([("show x",), ("show y",), ("kmeans",)], "prompt STRING")
    assert {(r.intent, r.operation, r.n) for r in prompts.intent_counts(frame).collect()} == {
        ("fetch_satellite", None, 2),
        ("process_image", "kmeans", 1),
    }
