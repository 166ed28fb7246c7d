"""SpotSigs fingerprints of documents, with DataFrame and SQL functions only.

A common word is an anchor; the content words that follow it, further anchors passed over, are its chain; a chain's
digest is a signature. A document's fingerprint is the set of its signatures. Sets are put into classes by their length,
and a pair is compared by Jaccard similarity only where its classes let it be alike at all.

The next document in the order of ids stands beside each document after one shuffle: ids are cut into parts at ids
that are there, so the first document of each part is known beforehand and goes to the part before as well, as a guest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.session import partitions

#: Common words of English, French, German and Spanish. Fixed values.
ANCHORS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with",
    "au", "avec", "dans", "de", "des", "du", "en", "est", "et", "la", "le", "les", "par", "pas", "pour", "que", "qui", "sur", "un", "une",
    "als", "auf", "das", "dem", "den", "der", "die", "ein", "eine", "für", "im", "ist", "mit", "nicht", "sich", "und", "von", "zu",
    "al", "con", "del", "el", "es", "las", "lo", "los", "no", "para", "por", "se", "su", "una", "y",
]
#: Words whose length is a multiple of this are anchors as well, for texts with few common words.
STRIDE = 7
#: Content words of a chain.
CHAIN = 3
#: Hex digits of a signature.
DIGITS = 8
#: Parts a shuffle partition; the documents of a part are ordered in one window.
PARTS = 8
#: Each class of lengths is so many times as long as the one before.
RATIO = 50


def _let(value: str, name: str, inside: str) -> str:
    """``inside`` with ``name`` standing for ``value``, which is evaluated once."""
    return f"get(transform(array({value}), {name} -> {inside}), 0)"


def signatures(text: str = "text", anchors: list[str] = ANCHORS, stride: int = STRIDE, chain: int = CHAIN) -> Column:
    """The sorted distinct signatures of a column of text.

    Words are runs of letters, marks and digits, lower-cased. A chain at the end of a text may be short. A text without
    a chain has one signature, that of the whole lower-cased text; a null or empty text has none.
    """
    listed = ", ".join("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in anchors)
    words = f"split(lower(coalesce({text}, '')), '[^\\\\p{{L}}\\\\p{{M}}\\\\p{{N}}]+')"
    marked = f"array_join(transform({words}, w -> if(w in ({listed}) or (w <> '' and length(w) % {stride} = 0), '\\u0001', w)), ' ')"
    after = _let(f"split({marked}, '\\u0001')", "s", "filter(transform(slice(s, 2, size(s)), x -> trim(x)), x -> x <> '')")
    following = ", ".join(f"get(c, j + {k})" for k in range(1, chain))
    digests = f"transform(c, (x, j) -> left(md5(substring_index(concat_ws(' ', x, {following}), ' ', {chain})), {DIGITS}))"
    found = _let(after, "c", f"sort_array(array_distinct({digests}))")
    whole = f"if(coalesce({text}, '') = '', cast(array() as array<string>), array(left(md5(lower({text})), {DIGITS})))"
    return F.expr(_let(found, "f", f"if(size(f) > 0, f, {whole})"))


def length_class(signatures: str, ratio: int = RATIO) -> str:
    """SQL of the class of a set by its length."""
    return f"size(filter(array({', '.join(f'{ratio**k}' for k in range(1, 6) if ratio**k < 1 << 31)}), x -> x <= size({signatures})))"


def likeness(a: str, b: str, ratio: int = RATIO) -> Column:
    """Jaccard similarity of two columns of signatures, 0 to 1; equal sets, empty ones too, are 1.

    Sets more than one class of lengths apart are at most ``1 / ratio`` alike: they count as 0 and are not compared.
    """
    shared = _let(f"size(array_intersect({a}, {b}))", "n", f"cast(n as double) / (size({a}) + size({b}) - n)")
    far = f"abs({length_class(a, ratio)} - {length_class(b, ratio)}) > 1"
    return F.expr(f"case when {a} = {b} then 1.0d when size({a}) = 0 or size({b}) = 0 or {far} then 0.0d else {shared} end")


def _part(tops: list[int]) -> str:
    """SQL of the place of ``doc_id`` among descending ``tops``: of the least one that is not below it. Two steps of
    about the square root of their number; ids that are null belong to the last."""
    wide = max(1, int(len(tops) ** 0.5))
    heads = ", ".join(f"{t}L" for t in tops[::wide])
    groups = ", ".join("array(" + ", ".join(f"{t}L" for t in tops[k : k + wide]) + ")" for k in range(0, len(tops), wide))
    near = _let(f"size(filter(array({heads}), t -> t >= doc_id)) - 1", "k", f"k * {wide} + size(filter(get(array({groups}), k), t -> t >= doc_id)) - 1")
    return f"case when doc_id is null then {len(tops) - 1} else {near} end"


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, signatures, next_text, next_signatures): each document and the next one, by descending doc_id.

    After the last document comes the first. Rows that repeat a doc_id are documents of their own, in the order of their
    texts; rows without an id come last, in the order of their texts, and the next of the last is the first document
    with an id (if there is none: null). Null texts stay null.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = PARTS * partitions(docs.sparkSession)
    steps = [k / parts for k in range(1, parts)]
    found = rows.agg(F.max("doc_id").alias("most"), F.percentile_approx("doc_id", steps, max(10_000, 20 * parts)).alias("cuts")).first()
    tops = sorted({found.most, *(found.cuts or [])}, reverse=True) if found.most is not None else []
    if tops:
        placed = rows.withColumn("at", F.expr(_part(tops)).cast("int"))
        heads = ", ".join(f"{t}L" for t in tops)
        guest = f"struct(at as part, false as guest), struct(cast(pmod(at - 1, {len(tops)}) as int) as part, true as guest)"
        placed = placed.select("doc_id", "text", F.expr(f"inline(if(doc_id = get(array({heads}), at), array({guest}), array(struct(at as part, false as guest))))"))
    else:
        placed = rows.withColumn("part", F.lit(0)).withColumn("guest", F.lit(False))
    order = Window.partitionBy("part").orderBy("guest", F.desc_nulls_last("doc_id"), "text")
    near = placed.repartition("part").withColumn("signatures", signatures())
    beside = near.withColumn("next_text", F.lead("text").over(order)).withColumn("next_signatures", F.lead("signatures").over(order))
    return beside.where("not guest").select("doc_id", "text", "signatures", "next_text", "next_signatures")


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """The fingerprint of every document, that of its edited text, and how alike they and the next document are.

    In the edited text the last half of the code points is replaced by the first as many of the next document, see
    :func:`with_next`. Null texts count as empty, two empty texts are alike; each row gives one row; other columns are
    ignored.
    """
    pairs = with_next(docs).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("n_chars", F.char_length("text").cast("long"))
    half = "cast(n_chars div 2 as int)"
    edited = pairs.withColumn("edited", F.expr(f"concat(left(text, cast(n_chars as int) - {half}), left(coalesce(next_text, ''), {half}))")).withColumn("edited_signatures", signatures("edited"))
    compared = edited.withColumn("next_signatures", F.coalesce("next_signatures", F.array().cast("array<string>")))
    return compared.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.array_join("signatures", "").alias("fingerprint"), F.array_join("edited_signatures", "").alias("edited_fingerprint"),
        likeness("signatures", "edited_signatures").alias("near_edited"), likeness("signatures", "next_signatures").alias("near_next"),
        F.size("signatures").cast("long").alias("n_signatures"), F.expr(length_class("signatures")).alias("length_class"),
    )
