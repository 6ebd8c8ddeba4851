"""Evaluation passages inside a training corpus, by q-gram lemma filtering.

A passage of L characters that stands in a text with at most e edits shares at least
L + 1 - q (e + 1) of its character q-grams with it, and they lie in a band of e + 1 neighbouring
diagonals (text position minus item position).

1. The q-grams of all items become a table of postings, and a bit map of fixed size tells which hashes
   are in it (``MOST_BITS`` at most, so its size does not grow with the items beyond that).
2. One pass over the texts, without a shuffle, keeps the stretches in which enough q-grams hit the map.
   A stretch is the text of a region; most texts have none.
3. Equal regions are one from here on, however many texts hold them, so a passage that leaks into a
   third of the corpus is looked at once. Their q-grams meet the postings in a join; hits are counted
   by region, item and band of 2 e + 2 diagonals, bands half overlapping, so that any e + 1 diagonals
   lie in one; bands below the bound drop out.
4. What is left is verified by alignment within the band: a run of the item's words against the region,
   from a word's start to a word's end.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codekin.operators.skew import heavy_keys, split_join
from codekin.plans.scratch import written

PIECE_CHARS = 1 << 20  # texts are looked up in pieces of about this size
MOST_BITS = 30  # binary logarithm of the largest bit map
PAGE_BITS = 16  # and of one page of it
FEW_POSTINGS = 1_000_000  # up to so many (24 MB) are broadcast; beyond, regions and postings meet by a shuffle
_FORMAT = "".join(
    f"\\U{a:08x}-\\U{b:08x}" for a, b in [
        (0xAD, 0xAD), *[(c, c) for c in range(0x600, 0x1D180) if unicodedata.category(chr(c)) == "Cf"], (0xE0001, 0xE0001), (0xE0020, 0xE007F)
    ]
)
_INVISIBLE = re.compile(f"[{_FORMAT}]")
_OTHER = re.compile(r"[\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def normal(text: str | None) -> str:
    """The words of a text, joined by single blanks: invisible format characters removed,
    compatibility forms unified, case folded. Null is an empty text."""
    if not text:
        return ""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text))
    return _OTHER.sub(" ", text.casefold()).strip()


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def word_windows(chars: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of so many words starts and ends."""
    gaps = np.flatnonzero(chars == 32)
    starts, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(chars)]])
    return starts[: max(0, len(starts) - words + 1)], ends[words - 1 :]


def gram_hashes(chars: np.ndarray, q: int) -> np.ndarray:
    """A hash of each q-gram, q a power of two, by doubling."""
    h, power, length = chars.astype(np.uint64) + np.uint64(1), _BASE, 1
    with np.errstate(over="ignore"):
        while length < q:
            if len(h) <= length:
                return np.empty(0, np.uint64)
            h = h[:-length] * power + h[length:]
            power, length = power * power, length * 2
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h


class Bound:
    """The q-gram length and what a kept region needs, from the shortest passage of all items."""

    def __init__(self, shortest: int, edits: int):
        self.shortest, self.edits = shortest, edits
        most = max(1, shortest // (edits + 1))
        self.q = 1 << min(4, most.bit_length() - 1)
        self.needed = self.count(shortest)
        self.span = shortest + edits - self.q  # first to last of the q-grams that a passage's stretch has

    def count(self, length: int) -> int:
        """Of a passage of so many characters, the q-grams that stay at least."""
        return max(1, length + 1 - self.q * (self.edits + 1))


def _item_rows(words: int):
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = [normal(t) for t in batch.column(1).to_pylist()]
            lengths = []
            for t in texts:
                a, b = word_windows(code_points(t), words)
                lengths.append(int((b - a).min()) if t and len(a) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(lengths, pa.int32())], ["item", "text", "shortest"])

    return batches


def _grams(q: int):
    """(key columns..., h, at) of each q-gram of the text in the last column."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            hashes = [gram_hashes(code_points(t), q) for t in batch.column(batch.num_columns - 1).to_pylist()]
            n = np.array([len(h) for h in hashes], np.int64)
            if not n.sum():
                continue
            row = pa.array(np.repeat(np.arange(len(n)), n))
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            keys = [batch.column(i).take(row) for i in range(batch.num_columns - 1)]
            names = batch.schema.names[:-1]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(np.concatenate(hashes).view(np.int64)), pa.array(at, pa.int32())], [*names, "h", "at"])

    return batches


def _page(table: pa.Table) -> pa.Table:
    bits = np.zeros(1 << PAGE_BITS, np.uint8)
    bits[table.column("bit").to_numpy()] = 1
    return pa.table({"page": table.column("page").slice(0, 1), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})


def bit_map(postings: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """(map, bits): which of the 2**bits leading parts of a hash are in ``postings``, packed.

    Pages are made by the executors; the driver puts them together, 128 MB at most."""
    bits = max(PAGE_BITS, min(MOST_BITS, n.bit_length() + 3))
    place = F.shiftrightunsigned("h", 64 - bits)
    marks = postings.select(F.shiftright(place, PAGE_BITS).cast("int").alias("page"), place.bitwiseAND(F.lit((1 << PAGE_BITS) - 1)).cast("int").alias("bit")).distinct()
    out = np.zeros(1 << (bits - 3), np.uint8)
    size = 1 << (PAGE_BITS - 3)
    for r in marks.groupBy("page").applyInArrow(_page, "page int, bits binary").toLocalIterator():
        out[r["page"] * size : (r["page"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    return out, bits


def regions(chars: np.ndarray, bound: Bound, known: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """(from, to) of each stretch of whole words, or lines of them, where enough q-grams are known."""
    h = gram_hashes(chars, bound.q)
    place = h >> np.uint64(64 - bits)
    at = np.flatnonzero(known[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1)
    if len(at) < bound.needed:
        return []
    last = at[bound.needed - 1 :]
    ok = last - at[: len(last)] <= bound.span
    starts, ends = at[: len(last)][ok], last[ok] + bound.q
    if not len(starts):
        return []
    # edits near the ends of a passage cost it its outermost q-grams
    pad = (bound.q + 1) * bound.edits
    gaps = np.flatnonzero((chars == 32) | (chars == 10))
    gaps = np.concatenate([[-1], gaps, [len(chars)]])
    starts = gaps[np.searchsorted(gaps, np.maximum(starts - pad, 0), "right") - 1] + 1
    ends = gaps[np.searchsorted(gaps, np.minimum(ends + pad, len(chars)), "left")]
    reach = np.maximum.accumulate(ends)
    fresh = np.concatenate([[True], starts[1:] > reach[:-1]])
    return list(zip(starts[fresh].tolist(), reach[np.append(np.flatnonzero(fresh)[1:] - 1, len(reach) - 1)].tolist()))


def _stretches(shared, bound: Bound, bits: int):
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in it:
            docs, stretches = [], []
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            start = 0
            while start < len(ids):
                stop, size, parts = start, 0, []
                while stop < len(ids) and (size < PIECE_CHARS or stop == start):
                    t = normal(texts[stop].as_py())
                    parts.append(t)
                    size += len(t) + 1
                    stop += 1
                whole = "\n".join(parts)
                found = regions(code_points(whole), bound, known, bits)
                ends = np.cumsum([len(t) + 1 for t in parts]) if found else None
                for low, high in found:
                    for line in whole[low:high].split("\n"):  # a stretch of false hits may touch several texts
                        if len(line) >= bound.shortest - bound.edits:
                            docs.append(ids[start + int(np.searchsorted(ends, low, side="right"))])
                            stretches.append(line)
                        low += len(line) + 1
                start = stop
            if docs:
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(stretches, pa.string())], ["doc_id", "region"])

    return batches


def aligned(item: np.ndarray, windows: tuple[np.ndarray, np.ndarray], text: np.ndarray, low: int, high: int, edits: int) -> bool:
    """Whether a run of the item's words stands in the text with at most ``edits`` edits, from a word's
    start to a word's end, on the diagonals (text minus item position) from ``low`` to ``high``.

    Banded alignment by the furthest place that each diagonal reaches with 0, 1, ... edits, for all runs
    at once; equal stretches are taken in one step."""
    a, b = windows
    m, n, wide = len(item), len(text), high - low + 1
    edge = np.ones(n + 2, bool)  # place i is a word's start or end if the character before or at it is blank
    edge[1:-1] = text == 32
    stops = np.full((wide, m + 1), m, np.int64)  # the next place on a diagonal where item and text differ
    for k in range(wide):
        d = low + k
        x0, x1 = max(0, -d), min(m, n - d)
        differs = np.ones(m + 1, bool)
        if x1 > x0:
            differs[x0:x1] = item[x0:x1] != text[x0 + d : x1 + d]
        places = np.where(differs, np.arange(m + 1), m)
        stops[k] = np.minimum.accumulate(places[::-1])[::-1]
    diagonals = np.arange(low, high + 1)[:, None]
    first = a[None, :] + diagonals
    starts = (first >= 0) & (first < n) & edge[np.clip(first, 0, n)]
    end = b[None, :] + diagonals
    stops_here = (end > 0) & (end <= n) & edge[np.clip(end, 0, n) + 1]
    at = np.where(starts, a[None, :], -1)
    row = np.arange(wide)[:, None]
    for k in range(edits + 1):
        if k:
            inside = (at >= 0) & (at + diagonals < n)
            new = np.where(inside, at + 1, at)  # another character
            new[1:] = np.maximum(new[1:], np.where(inside[:-1], at[:-1], -1))  # one more in the text
            new[:-1] = np.maximum(new[:-1], np.where(at[1:] >= 0, at[1:] + 1, -1))  # one less
            at = new
        at = np.where(at >= 0, np.minimum(stops[row, np.clip(at, 0, m)], b[None, :]), -1)
        if ((at >= b[None, :]) & stops_here).any():
            return True
    return False


def _verify(words: int, edits: int):
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @lru_cache(maxsize=4096)
        def parts(item: str):
            chars = code_points(item)
            return chars, word_windows(chars, words)

        width = edits + 1
        for batch in it:
            kept = []
            region, item, bands = (batch.column(i).to_pylist() for i in (3, 4, 5))
            for i in range(batch.num_rows):
                chars, windows = parts(item[i])
                text = code_points(region[i])
                # a band is 2 * number + which of the two overlapping rows of bands it is of
                lows = ((band >> 1) * 2 * width - (band & 1) * width for band in sorted(bands[i]))
                if any(aligned(chars, windows, text, low, low + 2 * width - 1, edits) for low in lows):
                    kept.append(i)
            if kept:
                rows = pa.array(kept)
                yield pa.RecordBatch.from_arrays([batch.column(i).take(rows) for i in range(3)], ["r1", "r2", "item"])

    return batches


def leaked(docs: DataFrame, id_col: str, text_col: str, items: DataFrame, item_id_col: str, item_text_col: str, words: int = 13, edits: int = 0) -> DataFrame:
    """(doc_id, item_id), once each: ``words`` consecutive words of the item stand in the text as whole
    words, with at most ``edits`` character edits.

    Null ids, null and empty texts and items of fewer words give no row. Rows that repeat an id
    count together. Extra columns are not read; empty tables give an empty result. The texts are read
    once, whatever the number of items."""
    spark = docs.sparkSession
    cores = spark.sparkContext.defaultParallelism
    texts = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).where("i IS NOT NULL AND t <> ''")
    queries = items.select(F.col(item_id_col).cast("long").alias("i"), F.col(item_text_col).alias("t")).where("i IS NOT NULL AND t <> ''")
    rows = queries.mapInArrow(_item_rows(words), "item long, text string, shortest int").where("shortest IS NOT NULL")
    rows = written(rows.select(F.monotonically_increasing_id().alias("row"), "item", "text", "shortest"), "items")
    shortest = rows.agg(F.min("shortest")).first()[0]
    if shortest is None:
        return spark.createDataFrame([], "doc_id long, item_id long")
    bound = Bound(shortest, edits)
    need = F.greatest(F.lit(1), F.col("shortest") + 1 - bound.q * (edits + 1)).cast("int")
    postings = rows.select("row", need.alias("need"), "text").mapInArrow(_grams(bound.q), "row long, need int, h long, at int")
    postings = written(postings.withColumnRenamed("at", "pos"), "postings")
    total = postings.count()
    known, bits = bit_map(postings, total)
    found = written(texts.mapInArrow(_stretches(spark.sparkContext.broadcast(known), bound, bits), "doc_id long, region string"), "regions")
    once = found.select("region").distinct().select(F.xxhash64("region").alias("r1"), F.xxhash64(F.lit(7), "region").alias("r2"), "region")
    once = written(once, "once")

    grams = once.mapInArrow(_grams(bound.q), "r1 long, r2 long, h long, at int")
    if total <= FEW_POSTINGS:  # a region's hits stay together and are counted before any shuffle
        hits = grams.join(F.broadcast(postings), "h")
    else:
        common, n = heavy_keys(postings, F.col("h"), 0.001)
        hits = split_join(grams, postings, "h", common, "row", 16, max(cores, min(20_000, n // 500_000)))
    width = edits + 1
    diagonal = F.col("at") - F.col("pos")
    bands = [2 * F.floor((diagonal + k * width) / (2 * width)).cast("int") + k for k in (0, 1)]
    counted = hits.select("r1", "r2", "row", "need", F.explode(F.array(*bands)).alias("band"))
    counted = counted.groupBy("r1", "r2", "row", "band").agg(F.count(F.lit(1)).alias("n"), F.max("need").alias("need")).where("n >= need")
    left = counted.groupBy("r1", "r2", "row").agg(F.collect_set("band").alias("bands"))
    left = left.join(once, ["r1", "r2"]).join(rows.select("row", "item", "text"), "row").select("r1", "r2", "item", "region", "text", "bands")
    pairs = written(left.mapInArrow(_verify(words, edits), "r1 long, r2 long, item long").distinct(), "pairs")
    held = found.select("doc_id", F.xxhash64("region").alias("r1"), F.xxhash64(F.lit(7), "region").alias("s2"))
    common, n = heavy_keys(held, F.col("r1"), 0.001)
    leaks = split_join(pairs, held, "r1", common, "doc_id", 64, max(cores, min(20_000, n // 500_000)))
    return leaks.where("r2 = s2").select("doc_id", F.col("item").alias("item_id")).distinct()
