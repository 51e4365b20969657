"""Audit of how five text filters interact, over every order in which they may run.

A document's words are exploded, counted by (document, word), and these counts by document, which gives totals and
distinct words; flags that need other rows (an equal text of a smaller id, labels) come by outer joins. What a filter does
in any order follows from the set of filters that a document fails, of which there are 32, so one aggregate of 32
conditional counts a part (and 32 each of the good and the toxic) answers all 120 orders.

Filters: A short (under 100 words), B repetitive (distinct words under 80 % of all), C shouting (A-Z over 10 % of the code points),
D symbols (any of ``#$%&*|``), E copy (equal to the text of a smaller id, removed or not).

Rows are dealt by their whole identity (id, language, text) and their input partition before words are exploded, so texts are shuffled
once and words never, and neither copies of a text, which have ids of their own, nor a row repeated many times gather in one task.

Defined results: a null or empty text has no words and fails A alone, besides E; a row without an id is no copy and has no
labels, and nothing is a copy of it; repeated rows count each, and are no copies of each other (their id is not smaller); of an id that ``labels``
holds several times, one 1 suffices; a null part is the empty string; whole texts of any length are read; an empty table has no parts and
no rows; extra columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fingerprint, join_hot, materialize

LETTERS = "ABCDE"
FEW_WORDS, DISTINCT_SHARE, CAPITALS_SHARE = 100, 80, 10  #: words; distinct words and capitals in a hundred
SYMBOLS = "[#$%&*|]"
SPACE = r"[\x20\x09-\x0D]+"
PATTERNS = 1 << len(LETTERS)


def word_totals(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, copies, total, distinct): rows of each key, and the words of one of them. ``rows`` has ``text`` and is dealt by ``keys``.

    Beside its words each row gives a null, which counts the rows of a key; rows of one key have equal texts.
    """
    words = F.concat(F.array(F.lit(None).cast("string")), F.split(F.coalesce("text", F.lit("")), SPACE))
    exploded = rows.select(*keys, F.explode(words).alias("word")).where("word IS NULL OR word <> ''")
    counted = exploded.groupBy(*keys, "word").agg(F.count("*").alias("c"))
    copies, said = F.sum(F.when(F.col("word").isNull(), F.col("c"))), F.sum(F.when(F.col("word").isNotNull(), F.col("c")))
    whole = counted.groupBy(*keys).agg(copies.alias("copies"), F.coalesce(said, F.lit(0)).alias("said"), F.count("word").alias("distinct"))
    return whole.select(*keys, "copies", F.expr("said div copies").alias("total"), "distinct")


def failures(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(doc_id, part, copies, pattern, good, toxic): ``pattern`` has bit 0 for A to bit 4 for E where the filter fails."""
    text = F.col(text_col).cast("string")
    whole = F.coalesce(text, F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"), *fingerprint(whole),
        (F.regexp_count(whole, F.lit("[A-Z]")) * 100 > F.char_length(whole) * CAPITALS_SHARE).alias("shouts"), whole.rlike(SYMBOLS).alias("symbols"), F.spark_partition_id().alias("lot"),
    )
    keys = ["doc_id", "part", "k1", "k2", "shouts", "symbols", "lot"]
    counted = word_totals(rows.repartition("doc_id", "k1", "k2", "part", "lot"), keys)
    short, dull = F.col("total") < FEW_WORDS, F.col("distinct") * 100 < F.col("total") * DISTINCT_SHARE
    bits = [F.when(c, F.lit(1 << i)).otherwise(0) for i, c in enumerate((short, dull, F.col("shouts"), F.col("symbols")))]
    alone = counted.select("doc_id", "part", "k1", "k2", "copies", sum(bits[1:], bits[0]).alias("own"))
    alone = materialize(alone, "own-failures")
    texts = materialize(alone.groupBy("k1", "k2").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows")), "texts")
    total = texts.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    copied = join_hot(alone, texts, ["k1", "k2"], "rows", total).withColumn("copy", F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False)))
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").groupBy("doc_id")
    marks = marks.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("bad"))
    known = copied.join(marks, "doc_id", "left")
    pattern = F.col("own") + F.when(F.col("copy"), F.lit(PATTERNS >> 1)).otherwise(0)
    return known.select("doc_id", "part", "copies", pattern.alias("pattern"), (F.coalesce("good", F.lit(0)) == 1).alias("good"), (F.coalesce("bad", F.lit(0)) == 1).alias("toxic"))


def conditional_counts(failed: DataFrame) -> DataFrame:
    """(part, n, good, toxic): of each part, 32 counts of rows by the set of filters they fail, as arrays."""

    def counts(of: Column) -> Column:
        return F.array(*(F.sum(F.when((F.col("pattern") == p) & of, F.col("copies")).otherwise(0)) for p in range(PATTERNS)))

    return failed.groupBy("part").agg(counts(F.lit(True)).alias("n"), counts(F.col("good")).alias("good"), counts(F.col("toxic")).alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """A row for each part, order of filters and step; see the module."""
    parts = conditional_counts(failures(docs, labels, id_col, text_col, part_col))
    orders = F.split(F.lit(" ".join("".join(o) for o in permutations(LETTERS))), " ")
    steps = parts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))))
    steps = steps.withColumn("mine", F.expr("shiftleft(1, ascii(substr(filter_order, step, 1)) - ascii('A'))"))
    steps = steps.withColumn("before", F.expr("aggregate(sequence(0, step - 1), 0, (m, k) -> m | if(k = 0, 0, shiftleft(1, ascii(substr(filter_order, k, 1)) - ascii('A'))))"))

    def over(counts: str, condition: str, worth: str = "1") -> Column:
        return F.expr(f"aggregate(sequence(0, {PATTERNS - 1}), 0L, (s, p) -> s + if({condition}, {counts}[p] * {worth}, 0L))")

    removed = "(p & mine) <> 0 AND (p & before) = 0"
    return steps.select(
        "part",
        "filter_order",
        "step",
        over("n", "(p & (before | mine)) = 0").alias("kept"),
        over("n", removed).alias("removed"),
        over("n", "(p & mine) <> 0 AND (p & before) <> 0").alias("redundant"),
        over("n", "p = mine").alias("unique_fails"),
        over("good", removed).alias("good_lost"),
        over("toxic", removed).alias("toxic_lost"),
        over("n", "(p & mine) <> 0", "(120 div bit_count(p))").alias("shapley"),  # in 120 / k of the orders it comes first of the k that fail
    )
