"""Encoding a corpus with a public tokenizer through a table of its distinct words.

Texts are split into words by the tokenizer's own pattern in Spark. Documents are dealt into blocks
by the hash of their id, as many as the bytes of all texts call for; the distinct words of each block make, over all
blocks, the table of distinct words, each of which is encoded once. The ids go back to the blocks that hold the word,
and each block puts them in place by the positions of its words. Only texts, once, and (block, word) pairs
are shuffled, never single word positions. Decoding goes the same way, by a join of ids with their pieces.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Where the tokenizer files are; a parameter, never part of this repository.
VOCABULARIES = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
BYTE_BPE = "byte_bpe_50k.json"
#: The byte-level pattern, with white space as Unicode defines it, in Java's notation.
WORD_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{IsWhite_Space}\p{L}\p{N}]+"
    r"|\p{IsWhite_Space}+(?![^\p{IsWhite_Space}])|\p{IsWhite_Space}+"
)
#: Characters that this JVM's Unicode tables do not know; texts with one are encoded whole.
UNKNOWN_CHARACTER = r"\p{Cn}"
#: Bytes of text in a block on average, at most and (where all cores have blocks enough) at least.
MOST_BYTES, LEAST_BYTES = 16 << 20, 256 << 10
#: Blocks for each core, so that hashing spreads them evenly, before they grow to the most bytes.
BLOCKS_PER_CORE = 8
#: Bytes that a shuffle partition of blocks should not exceed.
PARTITION_BYTES = 128 << 20

_tokenizers: dict[str, object] = {}


def tokenizer(path: str):
    """The tokenizer of a file, loaded once per Python worker; special tokens' spellings are plain text."""
    if path not in _tokenizers:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(path)
        made.encode_special_tokens = True
        _tokenizers[path] = made
    return _tokenizers[path]


def encode_words(words: DataFrame, path: str) -> DataFrame:
    """``word, ids`` for a table of distinct words, in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for batch in batches:
            found = t.encode_batch_fast(batch.column(0).to_pylist(), add_special_tokens=False)
            ids = pa.array([e.ids for e in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), ids], names=["word", "ids"])

    return words.select("word").mapInArrow(run, "word string, ids array<int>")


def _split(text: Column) -> Column:
    """The words of a text; a text with unknown characters is one word of its own."""
    whole = F.regexp_instr(text, F.lit(UNKNOWN_CHARACTER)) > 0
    return F.when(whole, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(WORD_PATTERN), 0))


def _deal(df: DataFrame, key: str, size: Column) -> tuple[Column, int]:
    """The block of each row and the number of shuffle partitions, from the bytes of all rows.

    One aggregate pass over ``size``. Blocks are bounded by ``MOST_BYTES`` on average (a single row is never cut).
    """
    spark = df.sparkSession
    total = df.agg(F.sum(size.cast("long")).alias("n")).first()["n"] or 0
    each = min(MOST_BYTES, max(LEAST_BYTES, total // (BLOCKS_PER_CORE * spark.sparkContext.defaultParallelism)))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PARTITION_BYTES))
    return F.pmod(F.xxhash64(F.col(key)), F.lit(max(1, -(-total // each)))).alias("block"), parts


def _blocked(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    block, parts = _deal(plain, "doc_id", F.octet_length("text"))
    return plain.select("doc_id", "text", block).repartition(parts, "block").select("block", "doc_id", _split(F.col("text")).alias("words"))


def _whole(table: pa.Table, name: str, kind: pa.DataType) -> pa.Array:
    """A column of a table as one array."""
    column = table.column(name)
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], kind)


def _place(left: pa.Table, right: pa.Table, count_only: bool) -> pa.Table:
    """Put the ids of a block's words in the places of the words."""
    words = _whole(left, "words", pa.list_(pa.string()))
    ids = _whole(right, "ids", pa.list_(pa.int32()))
    at = pc.index_in(words.flatten(), value_set=right.column("word").combine_chunks()).to_numpy(zero_copy_only=False)
    bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64))])
    lengths = pc.list_value_length(ids).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(lengths[at])]) if len(at) else np.zeros(1, np.int64)
    offsets = ends[bounds]
    docs = left.column("doc_id")
    if count_only:
        return pa.table({"doc_id": docs, "n_tokens": np.diff(offsets)})
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    values = ids.flatten().to_numpy(zero_copy_only=False)
    take = np.repeat(starts[at] - ends[:-1], lengths[at]) + np.arange(ends[-1]) if len(at) else np.zeros(0, np.int64)
    placed = pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(values[take].astype(np.int32)))
    return pa.table({"doc_id": docs, "ids": placed.cast(pa.list_(pa.int32()))})


def _encoded(docs: DataFrame, path: str, doc_id: str, text: str, count_only: bool) -> DataFrame:
    blocked = _blocked(docs, doc_id, text)
    pairs = blocked.select("block", F.explode("words").alias("word")).distinct()
    table = encode_words(pairs.select("word").distinct(), path)
    back = pairs.join(table, "word").select(F.col("block").alias("part"), "word", "ids")

    def place(left: pa.Table, right: pa.Table) -> pa.Table:
        return _place(left, right, count_only)

    schema = "doc_id bigint, n_tokens bigint" if count_only else "doc_id bigint, ids array<int>"
    return blocked.groupBy("block").cogroup(back.groupBy("part")).applyInArrow(place, schema)


def encode(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, ids`` of every row: the token ids of its text, without special tokens.

    Null and empty texts have an empty list. Every row gives one row, repeated ids included.
    """
    return _encoded(docs, path or f"{VOCABULARIES}/{BYTE_BPE}", doc_id, text, False)


def count_tokens(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens`` of every row, without building the id lists."""
    return _encoded(docs, path or f"{VOCABULARIES}/{BYTE_BPE}", doc_id, text, True)


def word_table(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The corpus's distinct words with their number of occurrences and their ids."""
    words = docs.select(F.explode(_split(F.coalesce(F.col(text), F.lit("")))).alias("word"))
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("occurrences"))
    counted = materialize(counted, "words")
    return counted.join(encode_words(counted, path or f"{VOCABULARIES}/{BYTE_BPE}"), "word")


def pieces(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary, a table of fixed size."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    code, extra = {}, 0
    for b in range(256):
        if b in printable:
            code[chr(b)] = b
        else:  # the other bytes stand for themselves 256 places up, in order
            code[chr(256 + extra)] = b
            extra += 1
    t = tokenizer(path)
    out = []
    for i in range(t.get_vocab_size()):
        piece = t.id_to_token(i)
        out.append(bytes(code[c] for c in piece) if all(c in code for c in piece) else piece.encode())
    return out


def _spell(left: pa.Table, right: pa.Table) -> pa.Table:
    """Put the pieces of a block's ids in the places of the ids."""
    ids = _whole(left, "ids", pa.list_(pa.int32()))
    spelling = _whole(right, "piece", pa.binary()).cast(pa.large_binary())
    spelled = spelling.take(pc.index_in(ids.flatten(), value_set=_whole(right, "id", pa.int32())))
    data = b"".join(spelled.to_pylist())
    at = np.concatenate([[0], np.cumsum(pc.binary_length(spelled).to_numpy(zero_copy_only=False).astype(np.int64))])
    ends = at[np.concatenate([[0], np.cumsum(pc.list_value_length(ids).to_numpy(zero_copy_only=False).astype(np.int64))])]
    text = [data[x:y].decode("utf-8", "replace") for x, y in zip(ends[:-1], ends[1:])]
    return pa.table({"doc_id": left.column("doc_id"), "text": pa.array(text, pa.string())})


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, text`` of encoded rows: each id joined with its piece, the bytes joined in order.

    Rows are dealt into blocks, whose distinct ids are joined with the table of pieces (as many rows as the
    vocabulary, whatever the corpus) and put in place in their block. Bytes that are no UTF-8, and ids that are not in
    the vocabulary, become replacement characters. Null lists of ids give empty texts, repeated rows stay.
    """
    spark = encoded.sparkSession
    plain = materialize(encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids")), "ids")
    block, parts = _deal(plain, "doc_id", F.size("ids") * 4)
    blocked = plain.select("doc_id", "ids", block).repartition(parts, "block")
    spellings = pieces(path or f"{VOCABULARIES}/{BYTE_BPE}")
    table = spark.createDataFrame(pd.DataFrame({"id": range(len(spellings)), "piece": spellings}), "id int, piece binary")
    pairs = blocked.select(F.col("block").alias("part"), F.explode("ids").alias("id")).distinct()
    back = pairs.join(table, "id", "left").select("part", "id", F.coalesce("piece", F.lit("\ufffd").cast("binary")).alias("piece"))
    return blocked.groupBy("block").cogroup(back.groupBy("part")).applyInArrow(_spell, "doc_id bigint, text string")
