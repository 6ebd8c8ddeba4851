"""The registered llm queries against their SQL, and the others against brute force, on the smallest scale."""

import itertools
import unicodedata

import pandas as pd
import pytest

from codekin.llm import encoding, queries
from verify import NO_SQL, compare

#: Queries that SQL cannot express; each has a brute-force or held-out test.
WITHOUT = {"p6_ids", "p7_found", "p7_items", "p8_found", "p8_documents", "p8_segments"}


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query_equals_sql(spark, sf_dir, name):
    assert compare(spark, sf_dir, [name])[name] == (NO_SQL if name in WITHOUT else "")


def test_ids_equal_direct_encoding(spark, sf_dir):
    docs = pd.read_parquet(f"{sf_dir}/documents.parquet")
    tokenizer = encoding._tokenizer(encoding.tokenizer_path())
    want = {d: tokenizer.encode(t or "", add_special_tokens=False).ids for d, t in zip(docs.doc_id, docs.text)}
    got = queries.p6_ids(spark, sf_dir).collect()
    assert len(got) == len(docs) and {r["doc_id"]: r["ids"] for r in got} == want


def words(text):
    text = unicodedata.normalize("NFKC", "".join(c for c in text if unicodedata.category(c) != "Cf")).casefold()
    runs = itertools.groupby(text, lambda c: unicodedata.category(c)[0] in "LN")
    return ["".join(run) for word, run in runs if word]


def windows(text, n=13):
    w = words(text or "")
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def test_leaks_equal_brute_force(spark, sf_dir):
    docs, items = pd.read_parquet(f"{sf_dir}/documents.parquet"), pd.read_parquet(f"{sf_dir}/eval_item.parquet")
    own = [(i, windows(t)) for i, t in zip(items.item_id, items.item_text)]
    want = {(d, i) for d, t in zip(docs.doc_id, docs.text) if (w := windows(t)) for i, o in own if w & o}
    got = [tuple(r) for r in queries.p7_found(spark, sf_dir).collect()]
    assert want and len(got) == len(set(got)) and set(got) == want


def test_leaked_items_are_counted(spark, sf_dir):
    items = pd.read_parquet(f"{sf_dir}/eval_item.parquet").set_index("item_id")
    leaks = pd.DataFrame([tuple(r) for r in queries.p7_found(spark, sf_dir).collect()], columns=["doc_id", "item_id"])
    want = {(i, items.suite[i], items.split[i], n) for i, n in leaks.groupby("item_id").doc_id.nunique().items()}
    assert {(r["item_id"], r["suite"], r["split"], r["n_docs"]) for r in queries.p7_items(spark, sf_dir).collect()} == want


def test_documents_and_segments_agree(spark, sf_dir):
    segments = pd.DataFrame([r.asDict() for r in queries.p8_segments(spark, sf_dir).collect()])
    documents = {r["doc_id"]: r for r in queries.p8_documents(spark, sf_dir).collect()}
    assert segments.confidence.between(0, 1).all()
    for d, rows in segments.groupby("doc_id"):
        words = rows.groupby("lang").n_words.sum()
        words = words[words >= 12]
        assert documents[d]["n_languages"] == len(words)
        if len(words):
            best = sorted(zip(-words, words.index))[0][1]
            own = rows[rows.lang == best]
            assert documents[d]["lang"] == best
            assert documents[d]["confidence"] == pytest.approx((own.confidence * own.n_words).sum() / own.n_words.sum(), abs=1e-5)
