"""Token counts through a digest cache: only texts that no run has counted before are encoded.

The cache is a table of (tokenizer, content, n_bytes, n_tokens), partitioned by the digest of
the tokenizer: of its file, its library's version and the way it is called. Content is known
by the SHA-256 of its normalised form. Documents are reduced to digests first; those that the
cache lacks are the misses, each distinct text of which is encoded once and appended. Counts
then come from the cache alone, by a join on the digest.
"""

from __future__ import annotations

import hashlib
import importlib.metadata
import os
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ingestctl.llm.common import whole_text
from ingestctl.scratch import materialise

LIMIT = 512
CACHE_SCHEMA = "content string, n_bytes long, n_tokens long, tokenizer string"
#: Up to so many missing digests (some 10 MB) go to every task, so that only missing texts move.
FEW_MISSES = 100_000
#: Pieces of text whose counts a worker keeps, per generation; two generations are kept. Longer pieces are not kept.
KEPT_PIECES, KEPT_LENGTH = 200_000, 40
#: Characters that are cut into pieces at a time.
SLICE = 1_000_000

#: White space with what follows it; full stops and commas that end a word of plain letters are pieces of their own.
_PIECE = re.compile(r"\s*[A-Za-z]+(?=[.,])|[.,]+(?!\S)|\s*\S+|\s+")
_PIECE_END = re.compile(r"(?<=\S)(?=\s)")
#: White space to ``re`` that the tokenizer's pattern may not take for such.
_SEPARATOR = re.compile("[\x1c-\x1f]")


class TokenCounter:
    """Counts tokens as the library of a vocabulary file gives them: tokenizers for .json, sentencepiece for .model.

    A byte-level tokenizer without a normaliser always ends a word before white space, and a run of
    letters before other signs, so there a text's count is the sum over such pieces of it. These
    repeat: a worker keeps their counts, and encodes the new ones of many texts at a time.
    """

    def __init__(self, path: str):
        self.kept, self.older = {}, {}
        self.by_piece = False
        if path.endswith(".model"):
            import sentencepiece

            processor = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encoded = lambda texts: [len(processor.encode(text)) for text in texts]
            return
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives a task one core
        from tokenizers import Tokenizer, pre_tokenizers

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self.encoded = lambda texts: [len(e.ids) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        before = tokenizer.pre_tokenizer
        words = isinstance(before, pre_tokenizers.ByteLevel) and before.use_regex and not before.add_prefix_space
        added = tokenizer.get_added_tokens_decoder().values()
        loose = any(t.lstrip or t.rstrip or t.single_word or re.search(r"[\s.,]", t.content) for t in added)
        self.by_piece = words and tokenizer.normalizer is None and not loose

    def counts(self, texts: Iterable[str]) -> list[int]:
        totals: list[int] = []
        slices: list[tuple[int, str]] = []
        held = 0
        for i, text in enumerate(texts):
            if not self.by_piece or _SEPARATOR.search(text):
                totals.extend(self.encoded([text]))
                continue
            totals.append(0)
            at = 0
            while at < len(text):
                end = _PIECE_END.search(text, at + SLICE) if len(text) - at > SLICE else None
                cut = end.start() if end else len(text)
                slices.append((i, text[at:cut]))
                held += cut - at
                at = cut
                if held >= SLICE:
                    self._add(slices, totals)
                    slices, held = [], 0
        self._add(slices, totals)
        return totals

    def _add(self, slices: list[tuple[int, str]], totals: list[int]) -> None:
        cut = [(i, _PIECE.findall(text)) for i, text in slices]
        different = set(chain.from_iterable(pieces for _, pieces in cut))
        known = {p: n for p in different if (n := self.kept.get(p) or self.older.get(p))}
        new = [p for p in different if p not in known]
        known.update(zip(new, self.encoded(new)))
        self.kept.update((p, n) for p, n in known.items() if len(p) <= KEPT_LENGTH)
        if len(self.kept) > KEPT_PIECES:
            self.kept, self.older = {}, self.kept
        for i, pieces in cut:
            totals[i] += sum(map(known.__getitem__, pieces))


def tokenizer_digest(path: str) -> str:
    """Stands for everything that a count depends on besides the text."""
    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    version = f"{library} {importlib.metadata.version(library)}; no special tokens added, no truncation; "
    return hashlib.sha256(version.encode() + Path(path).read_bytes()).hexdigest()


def cached(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame:
    """(content, n_bytes, n_tokens) of one tokenizer; a digest that two runs appended side by side counts once."""
    entries = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == tokenizer)
    return entries.groupBy("content").agg(F.max("n_bytes").alias("n_bytes"), F.max("n_tokens").alias("n_tokens"))


def _start(spark: SparkSession, cache: str) -> None:
    """An empty table where there is none yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)


def encode_misses(texts: DataFrame, tokenizer_path: str, tokenizer: str) -> DataFrame:
    """Cache rows of (content, text)."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = TokenCounter(tokenizer_path)
        for batch in batches:
            yield pd.DataFrame(
                {
                    "content": batch["content"],
                    "n_bytes": [len(t.encode("utf-8", "surrogatepass")) for t in batch["text"]],
                    "n_tokens": counter.counts(batch["text"]),
                    "tokenizer": tokenizer,
                }
            )

    return texts.mapInPandas(encode, CACHE_SCHEMA)


def count_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    cache: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    limit: int = LIMIT,
    normalise: Callable[[Column], Column] = lambda text: text,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit, and whether its count was known before.

    Null texts count as empty, and empty ones have no tokens. Repeated rows come out as often
    as they go in, and so do rows without an id. Other columns are ignored; an empty table
    gives an empty result and leaves the cache as it is. ``cache`` is a folder that all
    executors reach. ``normalise`` must keep the number of tokens and bytes; a byte-level tokenizer sees
    every byte, so by default only null and empty texts are made alike. A run that ends early
    has appended all its counts or none, as Spark's writers do, and a repeated run goes on from there.
    """
    spark = docs.sparkSession
    tokenizer = tokenizer_digest(tokenizer_path)
    text = normalise(whole_text(text_column))
    digest = F.sha2(text.cast("binary"), 256)
    keyed = materialise(docs.select(F.col(id_column).alias("doc_id"), digest.alias("content")), "digests")
    _start(spark, cache)
    known = materialise(cached(spark, cache, tokenizer).select("content"), "known")
    missing = materialise(keyed.select("content").distinct().join(known, "content", "left_anti"), "missing")
    n_missing = missing.count()
    if n_missing:
        texts = docs.select(digest.alias("content"), text.alias("text"))
        if n_missing <= FEW_MISSES:
            wanted = texts.join(F.broadcast(missing), "content", "left_semi").dropDuplicates(["content"])
        else:  # copies are combined before the shuffle, so a hot text is one row when it meets the misses
            wanted = texts.dropDuplicates(["content"]).join(missing, "content", "left_semi")
        encode_misses(wanted, tokenizer_path, tokenizer).write.mode("append").partitionBy("tokenizer").parquet(cache)
    counts = materialise(cached(spark, cache, tokenizer).join(keyed.select("content").distinct(), "content", "left_semi"), "counts")
    asked = missing.select("content", F.lit(False).alias("cached"))
    counts = materialise(counts.join(asked, "content", "left").withColumn("cached", F.coalesce("cached", F.lit(True))), "asked")
    return keyed.join(counts, "content").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "cached"
    )


def public_tokenizer() -> str:
    """The vocabulary file of the production query."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
