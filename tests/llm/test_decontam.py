"""Decontamination against edit distances of every item with every text."""

from __future__ import annotations

import random

import numpy as np
import pytest
from data_for_tests import ODD, prose

from sievelight.llm import decontam


def sellers(pattern, text):
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(pattern):
            new.append(min(row[i] + (p != c), row[i + 1] + 1, new[i] + 1))
        row = new
        best = min(best, row[-1])
    return best


def change(words, n, r):
    out = list(words)
    for _ in range(n):
        kind, at = r.randrange(3), r.randrange(len(out))
        if kind == 0:
            out[at] = f"zz{r.random()}"
        elif kind == 1:
            out.insert(at, f"zz{r.random()}")
        elif len(out) > 1:
            del out[at]
    return out


@pytest.fixture(scope="module")
def items():
    return [(i, prose(500 + i, n)) for i, n in enumerate([5, 7, 9, 12, 17, 20, 25, 33, 41, 56, 90])]


def test_planted_passages(spark, make, items):
    r, rows = random.Random(1), []
    for i in range(90):
        host, (item, text) = prose(i, r.randint(0, 200)).split(), items[i % len(items)]
        w = change(text.split(), r.randint(0, len(text.split()) // 3), r)
        at = r.randrange(len(host) + 1)
        rows.append((i, " ".join(host[:at] + [x.upper() + "," for x in w] + host[at:])))
    rows += [(1000 + i, prose(9000 + i, 300)) for i in range(30)]
    bench = spark.createDataFrame([*items, (77, None), (78, "too short"), (79, items[4][1])], "item_id bigint, text string")
    got = {(x["doc_id"], x["item_id"]): x for x in decontam.find(make(rows).repartition(3), bench).collect()}
    clean = lambda t: [w.decode() for w in decontam.words_of(t.encode())]
    want = {(d, i): k for d, t in rows for i, x in [*items, (79, items[4][1])] if (k := sellers(clean(x), clean(t))) <= len(clean(x)) // 5}
    assert set(got) <= set(want)  # exact verification: nothing else
    assert len(got) >= 0.97 * len(want)  # most are edited to the limit
    for pair, x in got.items():
        words = clean(dict(rows)[pair[0]])[x["start_word"] : x["end_word"]]
        assert x["distance"] == want[pair] and x["item_words"] == len(clean(dict([*items, (79, items[4][1])])[pair[1]]))
        item = clean(dict([*items, (79, items[4][1])])[pair[1]])
        whole = [[0] * (len(words) + 1) for _ in range(len(item) + 1)]
        for i in range(len(item) + 1):
            for j in range(len(words) + 1):
                whole[i][j] = i + j if not i or not j else min(whole[i - 1][j] + 1, whole[i][j - 1] + 1, whole[i - 1][j - 1] + (item[i - 1] != words[j - 1]))
        assert whole[-1][-1] == x["distance"]
    left = decontam.clean(make(rows), bench)
    assert left.columns == make(rows).columns and {x["doc_id"] for x in left.collect()} == {d for d, _ in rows} - {d for d, _ in got}


def test_odd_rows(spark, make, items):
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    rows = [*ODD, (None, items[5][1]), (8, items[5][1] + " x " + items[5][1]), (8, items[5][1])]
    got = sorted((x["doc_id"] or 0, x["item_id"], x["occurrences"]) for x in decontam.find(make(rows), bench).collect())
    assert got == [(0, 5, 1), (8, 5, 1), (8, 5, 2)]
    assert decontam.find(make([]), bench).count() == 0 and decontam.find(make(rows), bench.limit(0)).count() == 0
    assert decontam.clean(make(rows), bench.limit(0)).count() == len(rows)


def test_items_in_several_rounds(spark, make, items):
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    rows = [(i, t) for i, t in items]
    few = decontam.Settings(most_words=40)
    assert len(list(decontam._slices(bench, few))) > 2
    assert {(x["doc_id"], x["item_id"]) for x in decontam.find(make(rows), bench, few).collect()} >= {(i, i) for i, _ in items}


def test_distance_equals_the_table():
    r = random.Random(4)
    for _ in range(300):
        p, t = [r.randint(1, 4) for _ in range(r.randint(1, 12))], [r.randint(0, 4) for _ in range(r.randint(0, 20))]
        assert decontam.distance(p, t)[0] == sellers(p, [x or -1 for x in t])


def test_recall_of_the_walks(items):
    index = decontam.Index([(i, t.encode()) for i, t in items], decontam.Settings())
    assert index.classes and all(len(c.samples) <= 96 for c in index.classes)
    same = decontam.keys(np.array([[1, 2, 3, 4, 5, 6]] * 2), np.array([[0, 2], [1, 3]]), 1)
    assert same.shape == (2, 2) and (same[:, 0] == same[:, 1]).all() and same[0, 0] != same[1, 0]


def test_items_of_few_words(spark, make):
    short = [(1, "Quokka"), (2, "blue quokka tea"), (3, "!!"), (4, "one two three four")]
    rows = [(1, "a quokka, and a QUOKKA"), (2, "quokka"), (3, "some blue, quokka tea"), (4, "blue tea quokka"), (5, "one two three five"), (6, prose(3, 80)), (7, "one two three four"), (8, None)]
    bench = spark.createDataFrame([*short, (5, prose(4, 30))], "item_id bigint, text string")
    got = {(x["doc_id"], x["item_id"]): (x["distance"], x["start_word"], x["end_word"], x["occurrences"]) for x in decontam.find(make(rows), bench).collect()}
    assert got == {(1, 1): (0, 1, 2, 2), (2, 1): (0, 0, 1, 1), (3, 1): (0, 2, 3, 1), (3, 2): (0, 1, 4, 1), (4, 1): (0, 2, 3, 1), (7, 4): (0, 0, 4, 1)}
    assert {x["doc_id"] for x in decontam.clean(make(rows), bench).collect()} == {5, 6, 8}
    only = spark.createDataFrame(short, "item_id bigint, text string")
    assert decontam.find(make(rows), only).count() == len(got)
    loose = decontam.find(make(rows), only, decontam.Settings(percent=70)).filter("item_id = 4")
    assert {(x["doc_id"], x["distance"]) for x in loose.collect()} == {(5, 1), (7, 0)}


@pytest.mark.parametrize("percent,walks", [(50, 96), (20, 96), (80, 1)])
def test_every_item_is_found_at_any_limit(percent, walks):
    """Against the distances of all items and texts: where the walks cannot reach the recall, every word is compared."""
    r = random.Random(percent)
    items = [(n, prose(800 + n, n)) for n in range(1, 13)]
    s = decontam.Settings(percent=percent, most_walks=walks)
    index = decontam.Index([(i, t.encode()) for i, t in items], s)
    assert walks > 1 or not index.classes
    n = found = 0
    for k in range(150):
        item = items[k % len(items)][1].split()
        host = [f"h{r.random()}" for _ in range(r.randint(0, 12))]
        at = r.randrange(len(host) + 1)
        text = host[:at] + change(item, len(item) * (100 - percent) // 100, r) + host[at:]
        want = {i: d for i, t in items if (d := sellers(t.split(), text)) <= len(t.split()) * (100 - percent) // 100}
        got = {i: d for i, d, *_ in index.find(" ".join(text).replace(".", "").encode())}
        assert got.items() <= want.items()
        n, found = n + len(want), found + len(got)
    assert found >= (0.99 if walks > 1 else 1) * n > 0
    # 3 of 6 words replaced leave no pair of the item
    own = decontam.Index([(0, b"one two three four five six")], decontam.Settings(percent=50))
    assert own.find(b"one x three y five z") == [(0, 3, 6, 0, 5, 1)]
    assert own.find(b"one three five") and not own.find(b"one three")
