"""Document fingerprints from spot signatures: content words that follow common words.

Each occurrence of an anchor (a common word) gives a signature: the anchor and the chain of
the next content words. A document's fingerprint is the set of its signatures, kept as sorted
32-bit hashes. Sets are compared by Jaccard similarity. For a join over all documents, sets
are dealt by length, since sets of too different lengths cannot be similar, and within a
length class two sets must share one of their rarest signatures.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ingestctl.llm.common import code_points, letter_words, once, text_key, whole_text
from ingestctl.llm.components import components
from ingestctl.operators.ordering import with_previous
from ingestctl.scratch import materialise

# Common words of English, German, French and Spanish.
ANCHORS = tuple(
    sorted(
        set(
            "the a an is are was were be of to in on at for with by and or that this it as from than not only "
            "der die das ein eine den dem des und ist in zu von mit auf für als auch sich nicht "
            "le la les un une des de du et est en que qui dans pour sur par au aux avec pas elle "
            "el la los las un una de del que y en es se no por con para su al como".split()
        )
    )
)
CHAIN = 3
SIMILARITY = 0.8
_LOW = 0xFFFFFFFF


def signatures(text: Column, anchors: tuple[str, ...] = ANCHORS, chain: int = CHAIN) -> Column:
    """The sorted distinct signature hashes of a text.

    A chain is cut short at the end of the text; an anchor without a content word after it gives
    none. A text without any chain has one signature for all its words, one without words none.
    """

    def chains(words: Column, content: Column, spots: Column) -> Column:
        # the k-th anchor stands at word i, so i - k content words come before it
        hashed = F.transform(
            spots,
            lambda i, k: F.when(
                F.size(content) > i - k, F.xxhash64(words[i], *[F.get(content, i - k + j) for j in range(chain)])
            ),
        )
        return once(
            F.array_compact(hashed),
            lambda found: F.when(F.size(found) > 0, found)
            .when(F.size(words) > 0, F.array(F.xxhash64(words)))
            .otherwise(F.array().cast("array<bigint>")),
        )

    def parts(words: Column) -> Column:
        return F.struct(
            words.alias("words"),
            F.filter(words, lambda w: ~w.isin(*anchors)).alias("content"),
            F.array_compact(F.transform(words, lambda w, i: F.when(w.isin(*anchors), i))).alias("spots"),
        )

    hashes = once(letter_words(text), lambda w: once(parts(w), lambda p: chains(p["words"], p["content"], p["spots"])))
    return F.array_sort(F.array_distinct(F.transform(hashes, lambda h: h.bitwiseAND(F.lit(_LOW)))))


def fingerprint_text(signature_set: Column) -> Column:
    """The fingerprint as text: eight hex digits per signature."""
    return F.array_join(F.transform(signature_set, lambda s: F.lower(F.lpad(F.hex(s), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two signature sets; two empty sets are alike."""
    shared = F.size(F.array_intersect(a, b))
    return once(
        F.struct(shared.alias("shared"), (F.size(a) + F.size(b)).alias("both")),
        lambda s: F.when(s["both"] == 0, 1.0).otherwise(s["shared"] / F.greatest(s["both"] - s["shared"], F.lit(1))),
    )


def _length_class(size: Column, similarity: float) -> Column:
    """Sets that are similar lie in the same class or in neighbouring ones."""
    return F.floor(F.log(size.cast("double")) / F.lit(-math.log(similarity)) + F.lit(1e-9)).cast("int")


def similar_sets(sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b, similarity) for all pairs of different, non-empty sets that are at least so similar; a < b.

    ``sets`` has one row per set: ``set_id`` and ``signatures``. Two such sets share one of the
    first |s| - ceil(similarity |s|) + 1 signatures of each, rarest first.
    """
    members = sets.where(F.size("signatures") > 0).select(
        "set_id", F.size("signatures").alias("size"), F.explode("signatures").alias("signature")
    )
    frequency = materialise(members.groupBy("signature").count(), "frequency")
    ranked = (
        members.join(frequency, "signature")
        .groupBy("set_id", "size")
        .agg(F.array_sort(F.collect_list(F.struct("count", "signature"))).alias("ranked"))
    )
    length = (F.col("size") - F.ceil(F.col("size") * similarity - 1e-9) + 1).cast("int")
    heads = materialise(
        ranked.select(
            "set_id", "size", _length_class(F.col("size"), similarity).alias("class"), F.explode(F.slice("ranked", F.lit(1), length)).alias("r")
        ).select("set_id", "size", "class", "r.signature"),
        "heads",
    )
    left = heads.select(
        F.col("set_id").alias("a"), F.col("size").alias("a_size"), "signature", F.explode(F.array(F.col("class"), F.col("class") + 1)).alias("class")
    )
    right = heads.select(F.col("set_id").alias("b"), F.col("size").alias("b_size"), "signature", "class")
    candidates = materialise(
        left.join(right, ["signature", "class"])
        .where("a <> b")
        .where(F.least("a_size", "b_size") >= F.greatest("a_size", "b_size") * similarity - 1e-9)
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct(),
        "candidates",
    )
    own = sets.select(F.col("set_id"), F.col("signatures"))
    return (
        candidates.join(own.toDF("a", "a_set"), "a")
        .join(own.toDF("b", "b_set"), "b")
        .select("a", "b", likeness(F.col("a_set"), F.col("b_set")).alias("similarity"))
        .where(F.col("similarity") >= similarity)
    )


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", similarity: float = SIMILARITY
) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_key, class_id (smallest id in reach) and links (to other fingerprints).

    Documents with the same fingerprint are one class. Null texts count as empty; all texts
    without words are alike. Other columns are ignored; an empty table gives an empty result.
    """
    marked = materialise(
        docs.select(
            F.col(id_column).alias("doc_id"),
            text_key(text_column).alias("text_key"),
            signatures(whole_text(text_column)).alias("signatures"),
        ).withColumn("set_id", F.sha2(fingerprint_text(F.col("signatures")), 256)),
        "signatures",
    )
    sets = materialise(marked.groupBy("set_id").agg(F.first("signatures").alias("signatures"), F.min("doc_id").alias("least_id")), "sets")
    pairs = materialise(similar_sets(sets, similarity), "pairs")
    ends = pairs.select(F.col("a").alias("set_id")).unionAll(pairs.select(F.col("b").alias("set_id")))
    degree = ends.groupBy("set_id").agg(F.count("*").alias("links"))
    roots = components(pairs, "a", "b")
    rooted = sets.join(roots, sets["set_id"] == roots["node"], "left").select(
        "set_id", "least_id", F.coalesce("root", "set_id").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("least_id").alias("class_id"))
    classes = materialise(
        rooted.join(least, "root").join(degree, "set_id", "left").select("set_id", "class_id", F.coalesce("links", F.lit(0)).alias("links")),
        "classes",
    )
    return marked.select("doc_id", "text_key", "set_id").join(classes, "set_id").select("doc_id", "text_key", "class_id", "links")


def _followers(source: DataFrame) -> DataFrame:
    """(doc_id, text_hash) of each document with the key and length of the one before it; before the first comes the last."""
    entries = materialise(source.select("doc_id", "text_hash", "n_chars").distinct(), "entries")
    before = with_previous(
        entries.withColumn("entry", F.struct("doc_id", "text_hash", "n_chars")), [], ["doc_id", "text_hash"], "entry", "previous"
    )
    last = entries.agg(F.max(F.struct("doc_id", "text_hash", "n_chars")).alias("last")).first()["last"] or (None,) * 3
    key = F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(last, entries.schema)])
    return materialise(
        before.withColumn("to", F.coalesce("previous", key)).select(
            F.col("doc_id").alias("of_doc"),
            F.col("text_hash").alias("of_hash"),
            F.col("to.doc_id").alias("to_doc"),
            F.col("to.text_hash").alias("to_hash"),
            F.col("to.n_chars").alias("to_chars"),
        ),
        "followers",
    )


def compare_with_next(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edited form, and how alike they are to each other and to the next text's.

    The edited form has its last half replaced by as much of the beginning of the next document
    (ascending id, then hash of the text; after the last comes the first). Columns: doc_id,
    n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. Null texts
    count as empty; repeated rows (same id and text) are one document when looking for the next
    one, and come out as often as they go in; a null id sorts first. Other columns are ignored;
    an empty table gives an empty result.
    """
    source = docs.select(F.col(id_column).alias("doc_id"), whole_text(text_column).alias("text")).select(
        "doc_id", "text", F.xxhash64("text").alias("text_hash"), code_points(F.col("text")).alias("n_chars")
    )
    followers = _followers(source)
    keyed = source.select("doc_id", "text_hash", "text")

    def same(doc: str, text: str) -> Column:
        return F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col("text_hash") == F.col(text))

    half = F.expr("to_chars div 2").cast("int")
    sent = keyed.join(followers, same("of_doc", "of_hash")).select(
        "to_doc", "to_hash", F.substring(F.col("text"), F.lit(1), half).alias("beginning"), signatures(F.col("text")).alias("next_set")
    )
    if followers.count() < docs.count():  # repeated rows send the same thing
        sent = sent.dropDuplicates(["to_doc", "to_hash"])
    kept = F.expr("cast(length(text) - length(text) div 2 as int)")
    joined = keyed.join(sent, same("to_doc", "to_hash")).select(
        "doc_id",
        "text",
        F.concat(F.substring(F.col("text"), F.lit(1), kept), F.col("beginning")).alias("edited"),
        "next_set",
    )
    sets = joined.select(
        "doc_id",
        code_points(F.col("text")).alias("n_chars"),
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        F.explode(
            F.array(
                F.struct(
                    signatures(F.col("text")).alias("own"), signatures(F.col("edited")).alias("changed"), F.col("next_set").alias("next")
                )
            )
        ).alias("s"),
    )
    return sets.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint_text(F.col("s.own")).alias("fingerprint"),
        fingerprint_text(F.col("s.changed")).alias("edited_fingerprint"),
        likeness(F.col("s.own"), F.col("s.changed")).alias("near_edited"),
        likeness(F.col("s.own"), F.col("s.next")).alias("near_next"),
    )
