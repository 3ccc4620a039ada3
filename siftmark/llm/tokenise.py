"""Problem 6: the whole corpus as token ids of a public byte-level BPE tokenizer.

Method: global distinct-word shuffle. Texts are cut into pre-tokens with their positions, every
distinct pre-token is encoded once, the ids are joined back and put in order of position.

A few pre-tokens make up most of the text, so one join key would hold a large part of all rows. The
most frequent ones, a bounded number of bounded length, are therefore looked up in a broadcast table, a block of
texts at a time; all others are joined by shuffle, and their ids put in their places. Both give the same ids: the
split only balances the work. Texts are cut twice, once to count and once to look up.
"""

from __future__ import annotations

import importlib.util
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmark.runtime import Scratch, most_frequent

# The white-space characters of Unicode, as a regular expression class.
_WS = "".join(f"\\x{{{c:x}}}" for c in [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
#: The published pre-token pattern of the byte-level vocabulary, for Java's engine.
PRETOKEN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + _WS + r"\p{L}\p{N}]+|[" + _WS + r"]+(?![^" + _WS + r"])|[" + _WS + "]+"
)
HOT_WORDS, HOT_CHARS = 16_384, 64


def tokenizer_dir(path: str | None = None) -> str:
    """Where the public tokenizers are: the argument, the installed package, or /opt/tokenizers."""
    if path:
        return path
    spec = importlib.util.find_spec("public_tokenizers")
    return os.path.dirname(spec.origin) if spec and spec.origin else "/opt/tokenizers"


def pretokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PRETOKEN), F.lit(0))


def _encoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = True  # the special tokens' strings are ordinary text
        for b in batches:
            words = b.column("word").to_pylist()
            ids = [e.ids for e in tok.encode_batch(words, add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("n"), pa.array(ids, pa.list_(pa.int32()))], ["word", "n", "ids"])

    return run


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values))


def _chosen(values: np.ndarray, ends: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The lists numbered ``at``, one after the other; list i is values[ends[i]:ends[i + 1]]."""
    size = ends[at + 1] - ends[at]
    first = np.cumsum(size) - size
    return values[np.repeat(ends[at] - first, size) + np.arange(size.sum())]


def _looked_up(shared):
    """(doc_id, h, row, words) to (doc_id, h, row, known, sizes, lost): the ids of the words in the table, how many each
    word has (-1 for one that isn't in it), and the words that aren't."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, values, ends = shared.value
        table = pa.array(words, pa.string())
        for b in batches:
            flat = b.column("words").flatten()
            each = b.column("words").value_lengths().to_numpy(zero_copy_only=False)
            at = pc.fill_null(pc.index_in(flat, value_set=table), -1).to_numpy(zero_copy_only=False)
            hit, row = at >= 0, np.repeat(np.arange(b.num_rows), each)
            sizes = np.where(hit, (ends[1:] - ends[:-1])[at] if len(words) else 0, -1).astype(np.int32)
            known = _lists(_chosen(values, ends, at[hit]), np.bincount(row, weights=np.maximum(sizes, 0), minlength=b.num_rows))
            gone = np.bincount(row[~hit], minlength=b.num_rows)
            lost = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(gone)]).astype(np.int32)), flat.filter(pa.array(~hit)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), b.column("row"), known, _lists(sizes, each), lost], ["doc_id", "h", "row", "known", "sizes", "lost"])

    return run


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Known ids and those of lost words, in the words' order."""
    for b in batches:
        sizes, found = b.column("sizes"), b.column("found").flatten()
        row = np.repeat(np.arange(b.num_rows), sizes.value_lengths().to_numpy(zero_copy_only=False))
        size = sizes.flatten().to_numpy(zero_copy_only=False).copy()
        gone = size < 0
        size[gone] = found.value_lengths().to_numpy(zero_copy_only=False)
        place = np.repeat(gone, size)
        ids = np.empty(len(place), np.int32)
        ids[place] = found.flatten().to_numpy(zero_copy_only=False)
        ids[~place] = b.column("known").flatten().to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), _lists(ids, np.bincount(row, weights=size, minlength=b.num_rows))], ["doc_id", "ids"])


def encode(docs: DataFrame, id_col: str, text_col: str, tokenizer: str = "byte_bpe_50k.json", path: str | None = None) -> DataFrame:
    """(doc_id, ids ARRAY<INT>) for every row of ``docs``, without special tokens.

    Null and empty texts have an empty list; white space alone has its tokens. Rows repeated with the
    same id and text come out once, one id with several texts once for each text. Other columns are
    not read, whatever their names. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "tokenise")
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    counted = base.select(F.explode(pretokens(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    file = os.path.join(tokenizer_dir(path), tokenizer)
    coded = scratch.keep(counted.mapInArrow(_encoder(file), "word string, n long, ids array<int>"), "dictionary")
    # at most HOT_WORDS rows
    hot = most_frequent(coded.where(F.length("word") <= HOT_CHARS), "n", HOT_WORDS).select("word", "ids").toArrow().combine_chunks()
    lists = hot["ids"].combine_chunks() if hot.num_rows else pa.array([], pa.list_(pa.int32()))
    ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    shared = spark.sparkContext.broadcast((hot["word"].to_pylist(), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32), ends))

    kind = base.schema["doc_id"].dataType.simpleString()
    cut = base.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), F.monotonically_increasing_id().alias("row"), pretokens(F.col("text")).alias("words"))
    kept = scratch.keep(cut.mapInArrow(_looked_up(shared), f"doc_id {kind}, h long, row long, known array<int>, sizes array<int>, lost array<string>"), "pieces")
    again = kept.groupBy("doc_id", "h").agg(F.min("row").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("d"), F.col("h").alias("k"), "first")
    if not again.isEmpty():  # a row that is there twice
        kept = kept.join(again, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("k")), "left").where("first is null or row = first").drop("d", "k", "first")
    lost = kept.where(F.size("lost") > 0).select("row", F.posexplode("lost").alias("pos", "word"))
    found = lost.join(coded.select("word", "ids"), "word").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("pos", "ids"))).alias("p"))
    found = found.select("row", F.transform("p", lambda x: x["ids"]).alias("found"))
    none = F.array().cast("array<array<int>>")
    whole = kept.where(F.size("lost") > 0).join(found, "row").select("doc_id", "known", "sizes", "found").unionByName(kept.where(F.size("lost") == 0).select("doc_id", "known", "sizes", none.alias("found")))
    return whole.mapInArrow(_assembled, f"doc_id {kind}, ids array<int>")


def token_bytes(spark: SparkSession, tokenizer: str = "byte_bpe_50k.tiktoken", path: str | None = None) -> DataFrame:
    """(id, hex): the bytes of every token, from the vocabulary's rank file of base64 and rank."""
    lines = spark.read.text("file://" + os.path.join(os.path.realpath(tokenizer_dir(path)), tokenizer))
    part = F.split(F.col("value"), " ")
    return lines.where(F.col("value") != "").select(part[1].cast("int").alias("id"), F.hex(F.unbase64(part[0])).alias("hex"))


def decode(coded: DataFrame, tokenizer: str = "byte_bpe_50k.tiktoken", path: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, ids): joins the token-byte table, whose size is the vocabulary's.

    Empty or null lists give an empty text, and ids that the vocabulary lacks give no bytes. doc_id is
    taken as a key.
    """
    table = F.broadcast(token_bytes(coded.sparkSession, tokenizer, path))
    pieces = coded.select("doc_id", F.posexplode_outer("ids").alias("pos", "id")).join(table, "id", "left")
    whole = pieces.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("pos", F.lit(-1)).alias("pos"), F.coalesce("hex", F.lit("")).alias("hex")))).alias("p"))
    joined = F.concat_ws("", F.transform("p", lambda x: x["hex"]))
    return whole.select("doc_id", F.decode(F.unhex(joined), "UTF-8").alias("text"))
