"""Encoding a corpus with a public byte-level BPE tokenizer through a table of distinct words.

1. Texts are split into the tokenizer's words by a regular expression in Spark.
2. Each Arrow batch becomes chunks of documents of about ``CHUNK_WORDS`` words; a chunk's documents
   are kept as positions in the chunk's list of distinct words (a dictionary encoding).
3. The distinct words of all chunks are made distinct again by a shuffle, and each is encoded once.
4. The word table is joined to the chunks' words, and each chunk's ids are put in place of its
   positions. A word stands at most once in a chunk's list, so no word can make up more than a
   small share of the join's rows, however common it is in the texts.

Decoding goes the same way back: each chunk's distinct ids are joined to the id-to-piece table, whose
size is the vocabulary's, and the pieces put in place of positions and read as UTF-8.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codekin.plans.scratch import written

CHUNK_WORDS = 1 << 18

#: White space of Unicode, which the tokenizer's pattern means by \s.
_S = r"\x{9}-\x{D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: The word pattern of byte-level BPE tokenizers, for Java's regular expressions.
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+"


def tokenizer_path(name: str = "byte_bpe_50k.json", folder: str = "/opt/tokenizers") -> str:
    """Where a vocabulary file lies; the folder must be the same on every machine."""
    return os.path.join(folder, name)


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


def _chunks(chunk_words: int):
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        chunk = (context.partitionId() if context else 0) << 32
        for batch in it:
            rows = batch.num_rows
            if not rows:
                continue
            lengths = batch.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(lengths)
            start = 0
            while start < rows:
                before = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, before + chunk_words, side="right")))
                part = batch.slice(start, stop - start)
                coded = part.column(1).flatten().dictionary_encode()
                places = coded.indices.to_numpy(zero_copy_only=False)
                places = places.astype(np.uint16 if len(coded.dictionary) <= 1 << 16 else np.uint32)
                offsets = np.concatenate([[0], np.cumsum(lengths[start:stop])]) * places.itemsize
                binary = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), stop - start, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(places)]
                ).cast(pa.binary())
                n = stop - start
                dictionary = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n + 1, chunk)),
                        pa.concat_arrays([part.column(0), pa.nulls(1, part.column(0).type)]),
                        pa.concat_arrays([binary, pa.nulls(1, pa.binary())]),
                        pa.array([places.itemsize] * (n + 1), pa.int32()),
                        pa.concat_arrays([pa.nulls(n, dictionary.type), dictionary]),
                    ],
                    ["chunk", "doc_id", "places", "width", "words"],
                )
                chunk += 1
                start = stop

    return batches


def _encode(path: str):
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        for batch in it:
            words = batch.column(0).to_pylist()
            ids = [e.ids for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["word", "ids"])

    return batches


def _gathered(docs: pa.Table, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a chunk's lists ``parts`` in the order of its documents' positions, and where each
    document begins and ends in them."""
    column = docs.column("places").combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    width = docs.column("width")[0].as_py()
    words = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) // width
    places = np.frombuffer(b"".join(column.to_pylist()), np.uint16 if width == 2 else np.uint32)
    sizes = parts.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = parts.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    n = sizes[places]
    ends = np.cumsum(n)
    at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n) + np.repeat(starts[places], n)
    return flat[at], np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(words)])].astype(np.int64)


def _lists(table: pa.Table, column: str, kind: pa.DataType) -> pa.Array:
    """A column of lists of a chunk's words, in their order; of none an empty array."""
    lists = table.sort_by("k").column(column).combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) and lists.num_chunks else lists
    return lists if table.num_rows else pa.array([], kind)


def _place(docs: pa.Table, table: pa.Table) -> pa.Table:
    """The documents of one chunk with the ids of its words in place of their positions."""
    docs = docs.combine_chunks()
    if not docs.num_rows:
        return pa.table({"doc_id": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int32()))})
    ids, bounds = _gathered(docs, _lists(table, "ids", pa.list_(pa.int32())))
    lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids, pa.int32()))
    return pa.table({"doc_id": docs.column("doc_id"), "ids": lists})


def _place_pieces(docs: pa.Table, table: pa.Table) -> pa.Table:
    """The documents of one chunk with the bytes of its ids in place of their positions, read as UTF-8."""
    docs = docs.combine_chunks()
    if not docs.num_rows:
        return pa.table({"doc_id": pa.array([], pa.int64()), "text": pa.array([], pa.string())})
    pieces = table.sort_by("k").column("piece").to_pylist()
    data = np.frombuffer(b"".join(pieces), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int32)
    data, bounds = _gathered(docs, pa.ListArray.from_arrays(pa.array(offsets), pa.array(data)))
    whole = data.tobytes()
    texts = [whole[a:b].decode("utf-8", "replace") for a, b in zip(bounds[:-1], bounds[1:])]
    return pa.table({"doc_id": docs.column("doc_id"), "text": pa.array(texts, pa.string())})


def encoded(docs: DataFrame, id_col: str, text_col: str, path: str, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """(doc_id, ids): the token ids of each text, without special tokens.

    One row per input row, repeated ids and null ids included; null and empty texts have an empty
    list; a text that looks like a special token is ordinary text. Whole texts are encoded as they
    stand. Extra columns are not read. An empty table gives an empty result.
    """
    words = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.regexp_extract_all(text_col, F.lit(WORDS), F.lit(0)).alias("words")
    )
    chunks = written(
        words.mapInArrow(
            _chunks(chunk_words), "chunk long, doc_id long, places binary, width int, words array<string>"
        ),
        "chunks",
    )
    lists = chunks.where("words IS NOT NULL").select("chunk", F.posexplode("words").alias("k", "word"))
    table = lists.select("word").distinct().mapInArrow(_encode(path), "word string, ids array<int>")
    placed = lists.join(table, "word").select(F.col("chunk").alias("of"), "k", "ids")
    texts = chunks.where("places IS NOT NULL").select("chunk", "doc_id", "places", "width")
    return texts.groupBy("chunk").cogroup(placed.groupBy("of")).applyInArrow(_place, "doc_id long, ids array<int>")


@lru_cache(maxsize=4)
def pieces(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary, by id."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    added = {t["content"]: t["id"] for t in file.get("added_tokens", [])}
    vocabulary = file["model"]["vocab"] | added
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in printable}
    back |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
    out = [b""] * (max(vocabulary.values()) + 1)
    for piece, i in vocabulary.items():
        out[i] = piece.encode() if piece in added else bytes(back[c] for c in piece)
    return out


def piece_table(spark: SparkSession, path: str) -> DataFrame:
    """(id, piece): the bytes of each id of a vocabulary, as many rows as it has."""
    return spark.createDataFrame([(i, bytearray(p)) for i, p in enumerate(pieces(path))], "id int, piece binary")


def decoded(ids: DataFrame, path: str, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """(doc_id, text) of (doc_id, ids): every id joined to its piece, the bytes read as UTF-8.

    Null and empty lists give an empty text. As in encoding, a chunk's documents are kept as positions
    in its list of distinct ids; only that list meets the table of pieces, whose size is the
    vocabulary's and which is broadcast."""
    chunks = ids.select("doc_id", "ids").mapInArrow(_chunks(chunk_words), "chunk long, doc_id long, places binary, width int, words array<int>")
    chunks = written(chunks, "chunks")
    lists = chunks.where("words IS NOT NULL").select(F.col("chunk").alias("of"), F.posexplode("words").alias("k", "id"))
    placed = lists.join(F.broadcast(piece_table(ids.sparkSession, path)), "id").select("of", "k", "piece")
    texts = chunks.where("places IS NOT NULL").select("chunk", "doc_id", "places", "width")
    return texts.groupBy("chunk").cogroup(placed.groupBy("of")).applyInArrow(_place_pieces, "doc_id long, text string")
