"""Token counts with a cache keyed by digests of content and tokenizer version."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidrill.llm.common import BROADCAST_ROWS, cut

CACHE_SCHEMA = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("version", T.StringType()), T.StructField("n_tokens", T.LongType())])


def load_encoder(path: str) -> Callable[[list[str]], list[int]]:
    """Counts tokens of texts by the file's library: sentencepiece for .model, tokenizers for .json.

    No begin, end or added special tokens, no truncation, no padding.
    """
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return lambda texts: [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    raise ValueError(f"neither .model nor .json: {path}")


def version_of(path: str) -> str:
    """The tokenizer's version: the digest of its file, which is read where the operator is called."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


#: Characters that go to the encoder in one call, but for a longer single text.
CHUNK_CHARS = 1_000_000


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, blob) of texts: blob is the compressed text, which halves what the shuffle writes."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        found: dict[bytes, bytes] = {}
        for x in batch.column(0):
            raw = x.as_py().encode("utf-8", "surrogatepass")
            digest = hashlib.sha256(raw).digest()
            if digest not in found:
                found[digest] = pack(raw)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.binary())], names=["digest", "blob"])


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        count = load_encoder(path)
        for batch in batches:
            counts, texts, chars = [], [], 0
            for x in batch.column(1):
                texts.append(unpack(x.as_py()).decode("utf-8", "surrogatepass"))
                chars += len(texts[-1])
                if chars >= CHUNK_CHARS:
                    counts += count(texts)
                    texts, chars = [], 0
            counts += count(texts) if texts else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["digest", "n_tokens"])

    return run


def _cache(df: DataFrame, path: str) -> DataFrame:
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        spark.createDataFrame([], CACHE_SCHEMA).write.mode("ignore").partitionBy("version").parquet(path)
    return spark.read.schema(CACHE_SCHEMA).parquet(path)


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), one row for each row of docs.

    A text's digest is that of its content, null as the empty text, which is the normal form under which
    every tokenizer gives equal counts. Digests join the cache at cache_path (a folder for each tokenizer version) first; only where some miss are texts read
    again, and up to BROADCAST_ROWS misses pick theirs without a shuffle of the others. Each distinct text that misses is encoded once, whole, and appended to the cache in one write. A run that is repeated after a failure may append a count
    that is there already; it is equal, and the join takes each digest once. An empty table gives an empty result and appends
    nothing. Nulls in doc_id come back as they are; extra columns are ignored.
    """
    version = version_of(tokenizer_path)
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select("doc_id", text.alias("text")).withColumn("digest", F.unhex(F.sha2(text.cast("binary"), 256)))
    rows = cut(keyed.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest"))
    known = _cache(docs, cache_path).where(F.col("version") == version).select("digest", "n_tokens")
    misses = cut(rows.select("digest").distinct().join(known, "digest", "left_anti"))
    n_misses = misses.count()
    if n_misses:  # only now texts are read again: those that miss
        few = n_misses <= BROADCAST_ROWS
        wanted = keyed.join(F.broadcast(misses), "digest", "left_semi") if few else keyed
        # equal texts meet in the map-side aggregate, so a text goes to the shuffle once a task at most
        packed = wanted.select("text").mapInArrow(_packed, "digest binary, blob binary").groupBy("digest").agg(F.first("blob").alias("blob"))
        missing = packed if few else packed.join(misses, "digest", "left_semi")
        fresh = missing.select("digest", "blob").mapInArrow(_encode(tokenizer_path), "digest binary, n_tokens long")
        fresh.select("digest", F.lit(version).alias("version"), "n_tokens").write.mode("append").partitionBy("version").parquet(cache_path)
    counts = _cache(docs, cache_path).where(F.col("version") == version).groupBy("digest").agg(F.first("n_tokens").alias("n_tokens"))
    out = rows.join(cut(counts), "digest").select("doc_id", "n_bytes", "n_tokens")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
