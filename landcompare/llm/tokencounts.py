"""Token counts through a cache of digests.

A text is known by the digest of its normalised content, a tokenizer by the digest of
its file. Counts are stored under both. A run joins its documents with the cache,
encodes each distinct text that has no count once, and appends the new counts. Only
digests are grouped and joined on hot keys; the texts to be encoded are found by one
join on digest and id, so a third of all rows with one text is one text to encode.

Rows: null text counts as empty (0 bytes, 0 tokens), null ids stay, repeated rows each
get their count, an empty table gives an empty result, other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landcompare.llm.common import digest, small_batches, stored, table, texts
from landcompare.sources.shared import shared_folder

TOKENIZER = "word_bpe_49k.json"
LIMIT = 2048
MEMO_BYTES = 32 << 20  # per worker
ENTRY = 160  # bytes that a remembered word takes besides its letters
FEW, FEW_OF = 50_000, 100  # so many missing digests at most, a few MB, and no more than one row in a hundred, are broadcast
CACHED = "digest BINARY, n_tokens BIGINT"


def normalised(text: Column) -> Column:
    """Runs of ASCII white space as one blank, none at the ends: no count changes, as the tokenizer drops them."""
    return F.trim(F.regexp_replace(text, r"[\x09-\x0D\x20]+", " "))


def word_counter(tokenizer_json: str):
    """A function from texts to token counts, for a tokenizer that drops white space.

    Its pieces never cross white space, so a text has as many tokens as its words together. Words are
    encoded once and remembered, up to ``MEMO_BYTES`` for them and their entries.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(tokenizer_json)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    if len(tokenizer.encode("a b\t\n 1 b", add_special_tokens=False).ids) != 4 or tokenizer.encode(" \t\n", add_special_tokens=False).ids:
        raise ValueError("this tokenizer keeps white space: its texts can't be counted by words")
    memo: dict[bytes, int] = {}
    held = 0

    def count(found: list[str]) -> list[int]:
        nonlocal held
        split = [t.encode().split() for t in found]
        new = [w for w in set().union(*split) if w not in memo]
        encoded = tokenizer.encode_batch_fast([w.decode() for w in new], add_special_tokens=False)
        memo.update(zip(new, (len(e.ids) for e in encoded), strict=True))
        held += sum(map(len, new)) + ENTRY * len(new)
        counts = [sum(map(memo.__getitem__, words)) for words in split]
        if held > MEMO_BYTES:
            memo.clear()
            held = 0
        return counts

    return count


@lru_cache(maxsize=1)
def counter_of(tokenizer_json: str):
    """One counter for all tasks of a Python worker: reading the tokenizer takes time and, for a moment, much memory."""
    return word_counter(tokenizer_json)


def misses_of(rows: DataFrame, missing: DataFrame, keyed: DataFrame) -> DataFrame:
    """(digest, text) of the rows (doc_id, digest, text) that ``missing`` (digest, some_id) names.

    Where few are missing, by number and as a share of all, their digests go to the texts, and no text moves but
    theirs; else both are dealt by digest.
    """
    n = missing.count()
    few = n <= FEW and n * FEW_OF <= keyed.count()
    missing = missing.withColumnRenamed("digest", "missing")
    missing = F.broadcast(missing) if few else missing.hint("shuffle_hash")
    same = F.col("doc_id").eqNullSafe(F.col("some_id")) & (F.col("digest") == F.col("missing"))
    return rows.join(missing, same).select("digest", "text")


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row; new counts are appended under ``cache_path``."""
    spark = docs.sparkSession
    with open(tokenizer_path, "rb") as file:
        content = file.read()
    version = hashlib.sha256(content).hexdigest()
    folder = f"{cache_path}/tokenizer={version}"
    rows = texts(docs).select("doc_id", normalised(F.col("text")).alias("text"), F.octet_length("text").cast("bigint").alias("n_bytes"))
    rows = rows.withColumn("digest", digest(F.col("text")))
    keyed = stored(rows.select("doc_id", "n_bytes", "digest"), "token-keys")
    some_row = F.min(F.struct(F.col("doc_id").isNull(), "doc_id"))["doc_id"].alias("some_id")
    missing = keyed.groupBy("digest").agg(some_row)
    if (known := cached(spark, folder)) is not None:
        missing = missing.join(known, "digest", "left_anti")
    misses = misses_of(rows, stored(missing, "token-missing"), keyed)
    shared = spark.sparkContext.broadcast(content.decode())  # one file, a few MB
    threads = spark.conf.get("spark.task.cpus", "1")

    def run(batches):
        import os

        # As many threads as the task has cores: each keeps memory of its own.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        os.environ.setdefault("RAYON_NUM_THREADS", threads)
        count = None
        for batch in batches:
            count = count or counter_of(shared.value)
            counts = count(batch.column("text").to_pylist())
            yield pa.record_batch([batch.column("digest"), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    fresh = misses.mapInArrow(run, CACHED).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    with small_batches(spark):
        fresh.write.mode("append").parquet(folder)
    counts = cached(spark, folder)
    return keyed.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def cached(spark: SparkSession, folder: str) -> DataFrame | None:
    """(digest, n_tokens), once per digest even if two runs have appended it; None before the first run."""
    try:
        found = spark.read.schema(CACHED).parquet(folder)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return found.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with a cache of this run's own."""
    import public_tokenizers

    cache = shared_folder(spark, "token-cache")
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), cache)
