"""Mixing sources to target weights: hash order, distributed prefix sums, exact cut.

Native DataFrame operations only.  Within a source, documents stand in the
order of a hash-random key.  What the mix takes of a source is a whole number of
epochs and the documents up to one cut in that order.  The cut is found by
prefix sums over two levels of ranges of the key and over the rows of one small
range, so no task holds a whole source; then one row for each source decides
about all its documents, and texts are never shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kernel import cut

#: Words that count as size: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bits of the hash key that name the outer and the inner range.
BITS = 10
#: Cuts of so many sources go to all executors; those of more sources meet their documents in a shuffle.
FEW_SOURCES = 10_000


def word_count(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """source, source_size -> target by water-filling.

    Sources in code-point order, null last, take the weights in turn.  They
    share ``share`` times all words by weight; a target stops at ``most`` times
    its source, and the excess goes to the others by weight until none is above.
    One row for each source is all that meets in the windows here.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("most", F.col("source_size") * F.lit(float(most))).withColumn("full_at", F.col("most") / F.col("weight"))
    up = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    done = up.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    level = (
        ranked.withColumn("stopped", F.coalesce(F.sum("most").over(done), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(done), F.lit(0.0)))
        .withColumn("level", (F.sum("source_size").over(every) * F.lit(float(share)) - F.col("stopped")) / F.col("open"))
        # the first source, in the order in which they fill up, that stays below its stop sets the level of all that follow
        .withColumn("cut", F.min_by(F.when(F.col("level") <= F.col("full_at"), F.col("level")), F.when(F.col("level") <= F.col("full_at"), F.col("full_at"))).over(every))
        .withColumn("cut", F.coalesce("cut", F.max("full_at").over(every)))
    )
    return level.select("source", "source_size", F.least(F.col("most"), F.col("weight") * F.col("cut")).alias("target"))


def _named(source: Column) -> Column:
    """A source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def _key(id_column: Column, text: Column, seed: int) -> Column:
    """The place of a document in its source's order: 63 bits of hash."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), id_column, text.cast("string")), 1)


def _cuts(rows: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """One row for each source: source_size, target, whole (epochs), and where the last epoch ends.

    Documents with a key below cut_key, or with this key and a size below
    cut_size, are taken once more; each of those at the cut gives cut_words.
    rows: __source, __key, __size.
    """
    outer_of, inner_of = F.shiftright("__key", 63 - BITS).cast("int"), (F.shiftright("__key", 63 - 2 * BITS) % (1 << BITS)).cast("int")
    ranged = rows.select("*", outer_of.alias("__outer"), inner_of.alias("__inner"))
    fine = cut(ranged.groupBy("__source", "__outer", "__inner").agg(F.sum("__size").alias("__words")))
    outer = fine.groupBy("__source", "__outer").agg(F.sum("__words").alias("__words"))
    sizes = outer.groupBy("__source").agg(F.sum("__words").alias("source_size"))
    sources = sizes.select(F.when(F.col("__source") != "", F.expr("substring(__source, 2)")).alias("source"), "source_size")
    budget = F.floor(F.col("target") + F.lit(1e-6)).cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size")).cast("long")).otherwise(F.lit(0).cast("long"))
    targets = cut(source_targets(sources, weights, share, most).select(_named(F.col("source")).alias("__source"), "source_size", "target", whole.alias("whole"), (budget - whole * F.col("source_size")).alias("__rest")))

    def crossing(parts: DataFrame, by: list[str], words: Column) -> DataFrame:
        """Of each source the part in which the running sum passes what is left; __before: words ahead of it."""
        so_far = F.sum(words).over(Window.partitionBy("__source").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0))
        ahead = parts.withColumn("__before", F.col("__ahead") + so_far - words)
        return ahead.where((F.col("__before") <= F.col("__rest")) & (F.col("__rest") < F.col("__before") + words)).drop("__ahead")

    rest = targets.select("__source", "__rest", F.lit(0).cast("long").alias("__ahead"))
    first = crossing(outer.join(rest, "__source"), ["__outer"], F.col("__words")).select("__source", "__outer", "__rest", F.col("__before").alias("__ahead"))
    second = crossing(fine.join(first, ["__source", "__outer"]), ["__inner"], F.col("__words")).select("__source", "__outer", "__inner", "__rest", F.col("__before").alias("__ahead"))
    near = ranged.where("__size > 0").join(second, ["__source", "__outer", "__inner"]).groupBy("__source", "__key", "__size", "__rest", "__ahead").agg(F.count(F.lit(1)).alias("__n"))
    last = crossing(near, ["__key", "__size"], F.col("__n") * F.col("__size"))
    at = last.select("__source", F.col("__key").alias("cut_key"), F.col("__size").alias("cut_size"), F.floor((F.col("__rest") - F.col("__before")) / F.col("__n")).cast("long").alias("cut_words"))
    return cut(targets.drop("__rest").join(at, "__source", "left"))


def _with_cuts(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(cuts) if cuts.count() <= FEW_SOURCES else cuts, "__source")


def mix_sources(docs: DataFrame, *, text: str = "text", source: str = "source", id_col: str = "doc_id", weights: Sequence[float] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """How many words of each document the mix takes.

    A source's target is cut to whole words; it is taken in whole epochs and
    then from the front of the source's hash order, the document at the cut in
    part.  The order depends only on id, text and seed, so reruns agree.
    Texts without words (null and empty ones too) take nothing.  Rows that are
    repeated with id and text take the same each: if the cut falls among n of
    them, up to n - 1 words less than the target are taken.  A null source is a
    source of its own.  An empty table gives no rows.  Returns id, size,
    source_size, target, taken; other columns are left out.
    """
    own, body = F.col(f"`{id_col}`"), F.col(f"`{text}`")
    rows = cut(docs.select(own.alias("__id"), _named(F.col(f"`{source}`")).alias("__source"), word_count(body.cast("string")).alias("__size"), _key(own, body, seed).alias("__key")))
    out = _with_cuts(rows, _cuts(rows, weights, share, most))
    size, before, at = F.col("__size"), F.col("__key") < F.col("cut_key"), F.col("__key") == F.col("cut_key")
    part = F.when(before | (at & (size < F.col("cut_size"))), size).when(at & (size == F.col("cut_size")), F.col("cut_words")).otherwise(F.lit(0))
    return out.select(F.col("__id").alias(id_col), size.alias("size"), "source_size", "target", (F.col("whole") * size + part).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, *, text: str = "text", source: str = "source", id_col: str = "doc_id", weights: Sequence[float] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """The mix itself: a row for each time a document is taken, columns as in ``docs``.

    As :func:`mix_sources` decides: a whole number of epochs gives as many copies;
    the document at a source's cut comes once more with its first words up to the
    cut, joined by one space.  ``n_chars``, where ``docs`` has it, follows the text.
    """
    own, body = F.col(f"`{id_col}`"), F.col(f"`{text}`")
    key, named = _key(own, body, seed), _named(F.col(f"`{source}`"))
    slim = cut(docs.select(named.alias("__source"), word_count(body.cast("string")).alias("__size"), key.alias("__key")))
    names = docs.columns
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], named.alias("__source"), key.alias("__key"))
    body = F.col(f"c{names.index(text)}")
    words = body.cast("string")
    out = _with_cuts(rows.where(words.rlike(WORD)), _cuts(slim, weights, share, most))
    # sizes matter at the cut alone
    every, none = F.lit(-1).cast("long"), F.array().cast("array<long>")
    size = word_count(words)
    at_cut = F.when(size < F.col("cut_size"), F.array(every)).when((size == F.col("cut_size")) & (F.col("cut_words") > 0), F.array(F.col("cut_words"))).otherwise(none)
    more = F.when(F.col("__key") < F.col("cut_key"), F.array(every)).when(F.col("__key") == F.col("cut_key"), at_cut).otherwise(none)
    copies = out.withColumn("__words", F.explode(F.concat(F.array_repeat(every, F.col("whole").cast("int")), more)))
    head = F.when(F.col("__words") < 0, body).otherwise(F.array_join(F.slice(F.regexp_extract_all(words, F.lit(WORD), F.lit(0)), 1, F.greatest(F.col("__words"), F.lit(1)).cast("int")), " "))
    chars = next((i for i, c in enumerate(names) if c == "n_chars"), None)
    length = F.when(F.col("__words") < 0, F.col(f"c{chars}")).otherwise(F.length(head).cast("long")) if chars is not None else None
    return copies.select(*[(head if c == text else length if c == "n_chars" else F.col(f"c{i}")).alias(c) for i, c in enumerate(names)])
