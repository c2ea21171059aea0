"""Token counts against the libraries themselves, and the cache against what was encoded."""

import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ingestctl.llm import token_counts as C
from tests.conftest import rows

TEXTS = [
    (1, None),
    (1, None),
    (2, ""),
    (3, "Hello, World! it's 2024's text\nand  more\t<|endoftext|> of_it"),
    (4, "word " * 30_000),
    (5, "Ünïcode naïve ΣΑΣ 日本語   end \U0001f600 a\x1c b\x85c d᠎e \r\n\n x... y,z ., U.S., 's.'s,"),
    (None, "no id"),
    (6, "x" * 30_000),
    (7, "no id"),
    (8, " "),
]
TOKENIZER = Tokenizer.from_file(C.public_tokenizer())
COUNTER = C.TokenCounter(C.public_tokenizer())


def documents(spark, pairs):
    schema = "doc_id long, text string, content string, n_tokens int, tokenizer int"
    return spark.createDataFrame([(i, t, "c", 1, 2) for i, t in pairs], schema)


def expected(pairs, limit=512):
    found = []
    for doc, text in pairs:
        n = len(TOKENIZER.encode(text or "", add_special_tokens=False).ids)
        found.append((doc, len((text or "").encode()), n, n > limit))
    return sorted(found, key=repr)


def counted(spark, cache, pairs, **options):
    return C.count_tokens(documents(spark, pairs), C.public_tokenizer(), str(cache), **options)


def told(df):
    return rows(df.select("doc_id", "n_bytes", "n_tokens", "over_limit"))


@pytest.mark.parametrize("few", [C.FEW_MISSES, 0])
def test_counts(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(C, "FEW_MISSES", few)
    assert told(counted(spark, tmp_path / "cache", TEXTS)) == expected(TEXTS)


def test_only_misses_are_encoded(spark, tmp_path):
    cache = tmp_path / "cache"
    first = counted(spark, cache, TEXTS[:5]).collect()
    assert not any(r["cached"] for r in first)
    again = counted(spark, cache, TEXTS)
    assert told(again) == expected(TEXTS)
    seen = {t or "" for _, t in TEXTS[:5]}
    assert {(r["doc_id"], r["cached"]) for r in again.collect()} == {(i, (t or "") in seen) for i, t in TEXTS}
    entries = spark.read.parquet(str(cache))
    assert entries.count() == entries.select("content").distinct().count() == len({t or "" for _, t in TEXTS})
    assert all(r["cached"] for r in counted(spark, cache, TEXTS).collect())
    assert spark.read.parquet(str(cache)).count() == entries.count()


def test_the_cache_is_believed(spark, tmp_path):
    """A stored count of this tokenizer is used, also if two runs stored it; one of another tokenizer is not."""
    cache = str(tmp_path / "cache")
    key = C.tokenizer_digest(C.public_tokenizer())
    content = spark.sql("select sha2('no id', 256) c").first()["c"]
    stored = [(content, 5, 77, key), (content, 5, 77, key), (content, 5, 99, "another")]
    spark.createDataFrame(stored, C.CACHE_SCHEMA).write.partitionBy("tokenizer").parquet(cache)
    assert told(counted(spark, cache, [(7, "no id"), (2, "")])) == [(2, 0, 0, False), (7, 5, 77, False)]


def test_limit_and_empty_table(spark, tmp_path):
    assert told(counted(spark, tmp_path / "a", TEXTS, limit=3)) == expected(TEXTS, 3)
    assert told(counted(spark, tmp_path / "b", [])) == []


def test_digests_differ():
    paths = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model")]
    assert len({C.tokenizer_digest(p) for p in paths}) == 3


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_tokenizers(name):
    path = public_tokenizers.path(name)
    texts = [t or "" for _, t in TEXTS if len(t or "") < 1000]
    if name.endswith("model"):
        import sentencepiece

        real = [len(ids) for ids in sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)]
    else:
        real = [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    counter = C.TokenCounter(path)
    assert not counter.by_piece and counter.counts(texts) == real


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \n\t.,'as1<|>\x1c é"), st.characters(exclude_categories=["Cs"]))), max_size=5))
def test_any_texts(texts):
    assert COUNTER.counts(texts) == [len(TOKENIZER.encode(t, add_special_tokens=False).ids) for t in texts]


def test_every_assigned_character():
    every = [chr(c) for c in (*range(0x34000), *range(0xE0000, 0xE0200)) if not 0xD800 <= c < 0xE000]
    joined = ["".join(f"{c} a{c}. b{c}" for c in every[i : i + 50]) for i in range(0, len(every), 50)]
    real = [len(e.ids) for e in TOKENIZER.encode_batch_fast(joined, add_special_tokens=False)]
    counts = COUNTER.counts(joined)
    assert [t for t, a, b in zip(joined, counts, real) if a != b] == []


def test_slices_and_forgetting(monkeypatch):
    texts = ["a b c ddd   ee  ffffff  \n" * 20, "  ,x. y", "", "q" * 50 + " r"]
    monkeypatch.setattr(C, "SLICE", 3)
    monkeypatch.setattr(C, "KEPT_PIECES", 2)
    counter = C.TokenCounter(C.public_tokenizer())
    assert counter.counts(texts) == [len(TOKENIZER.encode(t, add_special_tokens=False).ids) for t in texts]
    assert len(counter.kept) + len(counter.older) < 12
