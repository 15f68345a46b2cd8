import random
import time

import pytest
from evidloom.operators import keywords


@pytest.mark.parametrize("size", [1 << 20, 50])
def test_equals_a_loop(spark, size):
    r = random.Random(2)
    text = lambda n: "".join(r.choice("abä\U0001f926 \n") for _ in range(n))
    words = [text(r.randrange(1, 5)) for _ in range(40)] + [None]
    rows = [(i, text(r.randrange(0, 12))) for i in range(400)] + [(1000, None), (1001, ""), (1002, "x" * 100_000 + words[0]), (1003, "x" * 100_000)]
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "keyword long, line string, word string").repartition(4)
    known = spark.createDataFrame([(w,) for w in words * 2], "keyword string")
    want = sorted(i for i, t in rows if t is not None and not any(w in t for w in words if w is not None))
    got = keywords.without_keywords(df, "line", known, automaton_bytes=size)
    assert got.columns == df.columns and sorted(r.keyword for r in got.collect()) == want and 1003 in want


def test_edges(spark):
    df = spark.createDataFrame([("a",), ("",), (None,)], "line string")
    words = lambda *w: spark.createDataFrame([(x,) for x in w], "keyword string")
    assert sorted(r.line for r in keywords.without_keywords(df, "line", words()).collect()) == ["", "a"]
    assert keywords.without_keywords(df, "line", words("", "b")).collect() == []
    assert [r.line for r in keywords.without_keywords(df, "line", words("a", None)).collect()] == [""]
    assert keywords.without_keywords(df.limit(0), "line", words("a")).collect() == []


def test_time_is_flat_in_the_number_of_words():
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(9))
    text = " ".join(word() for _ in range(40_000))
    took = []
    for n in (20, 20_000):
        search = keywords._automaton([word() + "#" for _ in range(n)]).iter
        best = 9.9
        for _ in range(3):
            began = time.perf_counter()
            assert next(search(text), None) is None
            best = min(best, time.perf_counter() - began)
        took.append(best)
    assert took[1] < 12 * took[0] + 0.05
