"""Problem 7: leaked evaluation passages."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import numpy as np
from codekin.llm import leakage
from codekin.llm.leakage import Bound, aligned, code_points, gram_hashes, leaked, normal, regions, word_windows

DOCS, ITEMS = "doc_id long, text string, i long, t string", "item_id long, item_text string, i long"
ITEM = "Because the quarry frames only tender inlet pairs, 5386 of the ancient quarry rows reach the ferry while another lantern sleeps"


def found(spark, docs, items, **options):
    d = spark.createDataFrame([(*r, 1, "clash") for r in docs], DOCS)
    q = spark.createDataFrame([(*r, 1) for r in items], ITEMS)
    rows = [tuple(r) for r in leaked(d, "doc_id", "text", q, "item_id", "item_text", **options).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_forms_of_copies(spark):
    w = ITEM.split()
    part = " ".join(w[3:16])
    docs = [
        (1, "x " + ITEM + " y"), (2, part.upper()), (3, " ".join(w[3:15])), (4, part.replace(" ", "\n> ")), (5, "_" + part.replace(" ", "_ _") + "_"),
        (6, part.replace("e", "e­")), (7, "".join(chr(ord(c) + 0xFEE0) if c.isalnum() else c for c in part)), (8, None), (9, ""), (10, "a" + part),
        (11, part + "s"), (12, part[:40] + " extra " + part[40:]), (None, ITEM), (1, "other"), (13, "filler words here " * 50_000 + part + " end" * 1000),
    ]
    items = [(7, ITEM), (8, "one two three"), (9, None), (None, ITEM), (10, "unrelated " * 20), (11, ITEM)]
    want = {(d, i) for d in (1, 2, 4, 5, 6, 7, 13) for i in (7, 11)}
    assert found(spark, docs, items) == want


def test_one_letter_words(spark):
    item = "a b c d e f g h i j k l m n"
    assert found(spark, [(1, "z " + item[2:]), (2, item[:23]), (3, item.replace(" ", "  "))], [(1, item)]) == {(1, 1), (3, 1)}


def test_empty_tables(spark):
    assert found(spark, [], [(1, ITEM)]) == set() == found(spark, [(1, ITEM)], []) == found(spark, [], [])


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute(item, text, words, edits):
    a = item.split(" ")
    b = text.split(" ")
    spans = [" ".join(b[i:j]) for i in range(len(b)) for j in range(i + 1, len(b) + 1)]
    return any(distance(" ".join(a[i : i + words]), x) <= edits for i in range(len(a) - words + 1) for x in spans)


WORDS = st.lists(st.text("ab", min_size=1, max_size=3), min_size=1, max_size=7).map(" ".join)


@settings(max_examples=300, deadline=None)
@given(WORDS, WORDS, st.integers(1, 3), st.integers(0, 2))
def test_alignment_equals_brute_force(item, text, words, edits):
    i, t = code_points(item), code_points(text)
    windows = word_windows(i, words)
    if len(windows[0]):
        assert aligned(i, windows, t, -len(item) - 3, len(text) + 3, edits) == brute(item, text, words, edits)


@pytest.mark.parametrize("edits", [0, 1, 2, 3])
def test_no_region_within_the_budget_is_lost(edits):
    rng = random.Random(edits)
    item = normal(ITEM)
    chars = code_points(item)
    a, b = word_windows(chars, 13)
    bound = Bound(int((b - a).min()), edits)
    known = np.zeros(1 << 17, np.uint8)
    for h in gram_hashes(chars, bound.q) >> np.uint64(44):
        known[int(h) >> 3] |= 1 << (int(h) & 7)
    for _ in range(80):
        k = rng.randrange(len(a))
        passage = list(item[a[k] : b[k]])
        for _ in range(rng.randint(0, edits)):
            i = rng.randrange(1, len(passage) - 1)
            kind = rng.randrange(3)
            passage[i : i + (kind != 0)] = [] if kind == 1 else [rng.choice("xyz")]
        passage = "".join(passage)
        text = normal("".join(rng.choice("qwv ") for _ in range(rng.randint(0, 50))) + " " + passage + " qq")
        low = text.index(passage)
        assert any(x <= low and low + len(passage) <= y for x, y in regions(code_points(text), bound, known, 20))


@pytest.mark.parametrize("few", [0, 1_000_000])
def test_many_copies_and_shared_passages(spark, monkeypatch, few):
    monkeypatch.setattr(leakage, "FEW_POSTINGS", few)
    w = ITEM.split()
    docs = [(i, " ".join(w[i % 5 : i % 5 + 13 + i % 3])) for i in range(200)] + [(i, "own words of " + ITEM) for i in range(200, 260)]
    items = [(1, ITEM), (2, "other beginning " + " ".join(w[1:15]))]
    want = {(d, i) for d, t in docs for i, x in items if {tuple(t.lower().replace(",", "").split()[k : k + 13]) for k in range(30)} & {tuple(x.lower().replace(",", "").split()[k : k + 13]) for k in range(len(x.split()) - 12)}}
    assert found(spark, docs, items) == want


@pytest.mark.parametrize("edits", [0, 1, 2])
def test_word_ends_count_with_edits_too(spark, edits):
    part = " ".join(ITEM.split()[2:15])
    docs = [(1, "xxxx" + part + "yyyy"), (2, part + "yyyy"), (3, "so " + part + " it is"), (4, "x" + part)]
    assert found(spark, docs, [(1, ITEM)], edits=edits) == {(3, 1)} | ({(4, 1)} if edits else set())


def test_edited_passages(spark):
    part = " ".join(ITEM.split()[2:15])
    docs = [(1, part.replace("tender", "tander")), (2, part.replace("tender inlet", "tander inlat")), (3, "nothing of the kind")]
    assert found(spark, docs, [(1, ITEM)], edits=1) == {(1, 1)} and found(spark, docs, [(1, ITEM)], edits=2) == {(1, 1), (2, 1)}
