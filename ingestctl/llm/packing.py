"""Best-fit packing of tokenised documents into sequences, by matching large items first.

Texts become token ids inside the tasks and only the lengths of pieces leave them. Documents
longer than a sequence are cut. Pieces above one third of the capacity meet at most in pairs,
so they are matched greedily: the largest one left takes the largest partner that still fits.
Smaller pieces, largest first, then go to the fullest sequence with room. Pieces are dealt
evenly over tasks, each of which packs its own share; what a share can lose against one
packing of everything is part of one sequence, in tens of thousands.
"""

from __future__ import annotations

import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ingestctl.llm.common import Recent, whole_text
from ingestctl.scratch import materialise

CAPACITY = 4096
END_ID = 1
#: Pieces that one task packs: some tens of MB in a Python worker.
PIECES_PER_TASK = 65_536
#: Words whose ids a worker keeps, per generation; two generations are kept.
KEPT_WORDS = 600_000

# Fixed values of the tokenizer file: its splitting pattern, and the printable character that
# stands for each byte (visible Latin-1 characters for themselves, then from U+0100 on).
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]


def _byte_characters() -> dict[int, str]:
    others = [b for b in range(256) if b not in VISIBLE]
    return {b: chr(b) for b in VISIBLE} | {b: chr(256 + i) for i, b in enumerate(others)}


class WordTokens:
    """Token ids of whole texts, as little-endian unsigned 32-bit ids.

    The tokenizer drops white space and never joins across it, so a text's ids are those of
    its words in a row, and words repeat: their ids are kept. Words of Latin-1 characters, on
    which all versions of Unicode agree, are split here; the tokenizer gets the others whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.parts = regex.compile(SPLIT_PATTERN).findall
        self.table = _byte_characters()
        self.pieces = Recent(self._piece, KEPT_WORDS)
        self.words = Recent(self._word, KEPT_WORDS)

    def _piece(self, piece: str) -> bytes:
        if not (piece.isascii() and piece.isprintable()):  # other characters do not stand for themselves
            piece = piece.encode().decode("latin-1").translate(self.table)
        ids = [t.id for t in self.model.tokenize(piece)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: str) -> bytes:
        # a special token's text, or characters whose kind depends on the version of the Unicode tables
        if "<|" in word or not (word.isascii() or max(word) <= "\xFF"):
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        plain = word.lower()  # Latin-1 characters are in normal form, and so are their small letters
        if plain.isalpha():
            return self.pieces[plain]
        return b"".join(map(self.pieces.__getitem__, self.parts(plain)))

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" ")))


def pieces(
    docs: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text", capacity: int = CAPACITY
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32. An empty text has one piece, its end id."""
    source = docs.select(F.col(id_column).alias("doc_id"), whole_text(text_column).alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    end = struct.pack("<I", END_ID)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = WordTokens(tokenizer_path)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = tokens.encode(text) + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            frame = pd.DataFrame(rows, columns=columns)
            yield frame.assign(doc_id=pd.Series([r[0] for r in rows], dtype=batch["doc_id"].dtype))

    return source.mapInPandas(cut, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long")


def pack_lengths(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """(bin, offset) of each item; every length lies between 1 and ``capacity``."""
    bins, offsets = [0] * len(lengths), [0] * len(lengths)
    by_length: dict[int, list[int]] = defaultdict(list)
    for i, length in enumerate(lengths):
        by_length[length].append(i)
    large = {n: items for n, items in by_length.items() if 3 * n > capacity}
    left = sum(1 << n for n in large)  # bit n: large items of length n are left
    with_gap: dict[int, list[int]] = defaultdict(list)
    gaps = 0  # bit n: bins with a gap of n
    used = 0

    def take(length: int) -> int:
        nonlocal left
        item = large[length].pop()
        if not large[length]:
            left &= ~(1 << length)
        return item

    while left:
        length = left.bit_length() - 1
        bins[take(length)] = used
        gap = capacity - length
        partner = (left & ((1 << (gap + 1)) - 1)).bit_length() - 1
        if partner > 0:
            item = take(partner)
            bins[item], offsets[item] = used, length
            gap -= partner
        with_gap[gap].append(used)
        gaps |= 1 << gap
        used += 1
    for length in sorted((n for n in by_length if 3 * n <= capacity), reverse=True):
        for item in by_length[length]:
            room = gaps >> length
            if room:
                gap = length + (room & -room).bit_length() - 1
                at = with_gap[gap].pop()
                if not with_gap[gap]:
                    gaps &= ~(1 << gap)
            else:
                gap, at = capacity, used
                used += 1
            bins[item], offsets[item] = at, capacity - gap
            with_gap[gap - length].append(at)
            gaps |= 1 << (gap - length)
    return bins, offsets


def pack(
    docs: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text", capacity: int = CAPACITY
) -> DataFrame:
    """Every piece of every document with its place: sequence_id and offset.

    Null texts count as empty; each repeated row is a document of its own, and so is a row
    without an id. Sequence ids are unique but not consecutive. Other columns are ignored; an
    empty table gives an empty result.
    """
    cut = materialise(pieces(docs, tokenizer_path, id_column, text_column, capacity), "pieces")
    tasks = max(1, -(-cut.count() // PIECES_PER_TASK))
    schema = cut.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = list(batches)
        if not sum(map(len, own)):
            return
        items = pd.concat(own, ignore_index=True)
        items = items.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], ignore_index=True)
        bins, offsets = pack_lengths(items["length"].tolist(), capacity)
        share = items.pop("share").astype(np.int64)
        yield items.assign(sequence_id=share * 2**32 + np.array(bins, dtype=np.int64), offset=np.array(offsets, dtype=np.int64))

    return (
        cut.repartition(tasks)
        .withColumn("share", F.spark_partition_id())
        .mapInPandas(place, f"{schema}, sequence_id long, offset long")
    )


def public_tokenizer() -> str:
    """The vocabulary file of the production query."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
