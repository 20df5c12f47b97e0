"""Token counts by a two-tier lookup on the map side.

No pre-token is ever shuffled. One pass over all texts feeds a mergeable
frequent-items sketch of bounded size; the lengths of the words it reports
form the first tier, a compact table that is broadcast (its size is bounded by
``TABLE_WORDS`` words of at most ``chunks.LONGEST`` bytes). In the second pass
each worker looks words up in that table, then in its own bounded cache, and
encodes only what both miss.

The sketch decides only which words are looked up fast, never a count. Null
counts as empty and gives 0 tokens; repeated rows and ties give equal counts;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.chunks import LONGEST, WorkerCache
from sparkloom.llm.common import map_batches, utf8

#: Words in the broadcast table, items that a sketch tracks, and sketches that meet in the last merge.
TABLE_WORDS, SKETCH_ITEMS, MERGED = 4096, 8192, 64
CACHE_WORDS = 250_000


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


def token_lengths(tokenizer, words: list[bytes]) -> list[int]:
    encoded = tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
    return [len(e) for e in encoded]


#: Of this worker process: it outlives tasks.
_CACHES: dict[tuple[str, int], WorkerCache] = {}


def worker_cache(path: str, table) -> WorkerCache:
    key = (path, id(table.value))
    if key not in _CACHES:
        _CACHES.clear()
        own = load_tokenizer(path)
        _CACHES[key] = WorkerCache(lambda words: token_lengths(own, words), CACHE_WORDS, table.value)
    return _CACHES[key]


def frequent_words(docs: DataFrame, text: str = "text", words: int = TABLE_WORDS) -> list[str]:
    """The most frequent words of all texts, by a sketch that each task fills and Spark merges."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    exploded = docs.select(F.explode(F.split(body, r"[\x20\x09-\x0D]+")).alias("word"))
    short = exploded.where((F.col("word") != "") & (F.octet_length("word") <= LONGEST))
    parts = short.groupBy((F.spark_partition_id() % MERGED).alias("part")).agg(F.expr(f"approx_top_k_accumulate(word, {SKETCH_ITEMS})").alias("sketch"))
    # By a key, so that partitions without rows add no null sketch.
    whole = parts.groupBy((F.col("part") < 0).alias("none")).agg(F.expr(f"approx_top_k_combine(sketch, {SKETCH_ITEMS})").alias("sketch"))
    top = whole.select(F.expr(f"approx_top_k_estimate(sketch, {words})").alias("top")).first()
    return [x["item"] for x in top["top"]] if top else []


def count_tokens(docs: DataFrame, tokenizer_path: str, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """The id, n_bytes and n_tokens of each row, by a tokenizer whose pre-tokens don't span ASCII white space."""
    tokenizer = load_tokenizer(tokenizer_path)
    hot = [w.encode() for w in frequent_words(docs, text)]
    table = docs.sparkSession.sparkContext.broadcast(dict(zip(hot, token_lengths(tokenizer, hot))))

    def count(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        cache, sizes, counts = worker_cache(tokenizer_path, table), [], []
        for value in batch.column(1):
            body = value.as_py()
            sizes.append(len(body))
            counts.append(sum(cache.lookup(body.split())))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], [id_column, "n_bytes", "n_tokens"])

    kind = docs.schema[id_column].dataType.simpleString()
    return map_batches(docs.select(id_column, utf8(text)), count, f"`{id_column}` {kind}, n_bytes long, n_tokens long")
