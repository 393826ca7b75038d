"""Line deduplication by a deletion-neighbourhood join, in DataFrame functions only.

A line counts without the blanks at its ends (space, tab, carriage return, vertical tab, form feed). A line that is blank
then stays. Any other goes if an earlier line (by doc_id, then position) is the same, however short; a line of at least
``min_words`` words (pieces between single spaces) also goes if an earlier one of as many words at least turns into it by
one edit: one word replaced, inserted or left out. With five words or more, lines that are one edit apart agree in four
fifths of their words at least.

1. Equal lines fall into one class; its first occurrence stands for it.
2. *Halves.* One edit leaves the first or the last half of a line alone. Lines hash a beginning and an end of about half their
   words (lengths on a coarse ladder, so that lines whose word counts differ by one agree on them); only classes
   that share such a half with another class go on.
3. *Deletion neighbourhood.* Each of these emits its words as they are and with each one word left out, as a hash key.
   The hash of a sequence is the xor of its words' hashes at their positions, so running xors give all keys of a
   line of n words in n steps. Equal variants with the same word left out are one replacement apart, a variant that equals
   a whole line is one insertion apart.
4. *Verification.* For each line the earliest line it meets is compared with it word by word.

Groups are reduced to their earliest member by aggregates that combine before the shuffle; pairs are never
listed. Keys shared by several lines are broadcast only while there are at most ``max_broadcast`` of them, else
joined by shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinfold.llm.storage import broadcast_if_small, cut, number_rows

MIN_WORDS = 5
MAX_BROADCAST = 1_000_000
_ORDER = ("rank", "row_id", "line_no")


_BLANKS = " \t\r\x0b\f"


def _clean(line: Column) -> Column:
    return F.btrim(line, F.lit(_BLANKS))


def _count(clean: Column) -> Column:
    """Words of a trimmed line (0 if empty)."""
    return F.when(clean == "", 0).otherwise(F.length(clean) - F.length(F.replace(clean, F.lit(" "), F.lit(""))) + 1)


def _once(*parts: Column) -> Column:
    """Column ``split`` holding the parts. A lambda that reads a part must not compute it again for every element,
    which is what happens when the optimizer moves the expression into the lambda; it never moves one out of an explode."""
    return F.explode(F.array(F.struct(*parts))).alias("split")


def _lines(rows: DataFrame) -> DataFrame:
    """``rank, row_id, line_no, line, n`` of the lines that are not blank."""
    each = rows.select("rank", "row_id", F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    return (each.select("rank", "row_id", "line_no", _clean(F.col("raw")).alias("line"))
            .withColumn("n", _count(F.col("line"))).where("n > 0"))


def _ladder(n: str) -> str:
    """SQL for the half length of lines whose shorter partner has ``n`` words: n / 2, rounded down to a coarse step."""
    step = f"greatest(1L, shiftleft(1L, CAST(floor(log2({n})) AS int) - 3))"
    return f"CASE WHEN {n} < 16 THEN CAST(floor({n} / 2) AS int) ELSE CAST(floor(floor({n} / 2) / {step}) * {step} AS int) END"


def _halves() -> Column:
    """Hash keys of the beginnings and ends of a line, for partners of as many words and of one more or fewer."""
    return F.expr(f"""flatten(transform(array_distinct(array({_ladder('n')}, {_ladder('(n - 1)')})), h -> array(
        xxhash64('begin', h, substring_index(line, ' ', h)), xxhash64('end', h, substring_index(line, ' ', -h)))))""")


def _identity() -> list[Column]:
    """128 bits that stand for the words of a line."""
    return [F.xxhash64("line").alias("k1"), F.xxhash64(F.lit("second"), "line").alias("k2")]


def _variants(chosen: DataFrame) -> DataFrame:
    """``key, left_out, *order`` of every whole line (left_out -1) and of the line with each one word left out."""
    words = chosen.select(*_ORDER, "n", "begins", "ends", "half", F.posexplode(F.split("line", " ")).alias("at", "word"))
    here = F.xxhash64("word", F.col("at"))
    shifted = F.xxhash64("word", F.col("at") - 1)
    line = Window.partitionBy(*_ORDER)
    upto = line.orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rest = words.select(
        *_ORDER, "n", "at", "begins", "ends", "half",
        F.bit_xor(here).over(upto).alias("upto"), here.alias("here"),
        # All later words move up by one place.
        F.bit_xor(shifted).over(line).bitwiseXOR(F.bit_xor(shifted).over(upto)).alias("after"))
    remaining = F.col("upto").bitwiseXOR(F.col("here")).bitwiseXOR(F.col("after"))
    # A line that shares its beginning only was changed behind it, and the other way round.
    due = F.expr("begins AND at >= half OR ends AND at < n - half")
    last = F.col("at") == F.col("n") - 1
    made = F.filter(F.array(
        F.when(due, F.struct(F.col("at").alias("left_out"), F.xxhash64(F.col("n") - 1, remaining).alias("key"))),
        F.when(last, F.struct(F.lit(-1).alias("left_out"), F.xxhash64("n", "upto").alias("key")))), F.isnotnull)
    return rest.select(*_ORDER, F.explode(made).alias("made")).select(*_ORDER, "made.left_out", "made.key")


def _fetch(rows: DataFrame, places: DataFrame, max_broadcast: int) -> DataFrame:
    """``places(rank, row_id, line_no, begins, ends)`` with their ``line``, its word count ``n`` and the shorter of its half lengths."""
    wanted = places.groupBy("row_id").agg(F.collect_list(F.struct("line_no", "begins", "ends")).alias("wanted"))
    # The bound is on places, as a text may hold any number of them.
    few = max_broadcast // 4
    wanted = F.broadcast(wanted) if places.limit(few + 1).count() <= few else wanted
    found = rows.select("rank", "row_id", "text").join(wanted, "row_id")
    found = found.select("rank", "row_id", "wanted", _once(F.split("text", "\n").alias("lines"))).select(
        "rank", "row_id", F.explode(F.expr(
            f"transform(wanted, w -> struct(w.line_no, w.begins, w.ends, btrim(split.lines[w.line_no], '{_BLANKS}') AS line))")).alias("w"))
    found = found.select("rank", "row_id", "w.*").withColumn("n", _count(F.col("line")))
    return found.withColumn("half", F.expr(f"least({_ladder('n')}, {_ladder('(n - 1)')})"))


def _near(spark: SparkSession, table: DataFrame, rows: DataFrame, max_broadcast: int) -> DataFrame:
    """``rank, row_id, line_no`` of first occurrences that an earlier line comes within one edit of."""
    order = F.struct(*_ORDER)
    keys = table.select("k1", F.explode("halves").alias("half"))
    shared = cut(spark, keys.groupBy("half").agg(F.min("k1").alias("a"), F.max("k1").alias("b")).where("a <> b")
                 .select("half"), "halves")
    shared = broadcast_if_small(shared, max_broadcast)
    # Odd places hold ends, even ones beginnings.
    met = (table.select(*_ORDER, "k1", "k2", F.posexplode("halves").alias("place", "half")).join(shared, "half")
           .withColumn("begins", F.col("place") % 2 == 0))
    first = met.groupBy("k1", "k2").agg(F.min(order).alias("first"), F.max("begins").alias("begins"), F.max(~F.col("begins")).alias("ends"))
    chosen = cut(spark, _fetch(rows, cut(spark, first.select("first.*", "begins", "ends"), "chosen"), max_broadcast), "lines")
    variants = cut(spark, _variants(chosen), "variants")
    spots = variants.groupBy("key", "left_out").agg(F.min(order).alias("least"), F.count("*").alias("rows"))
    spots = cut(spark, spots.withColumn("alone", F.col("rows") == 1).drop("rows"), "spots")
    both = spots.groupBy("key").agg(
        F.min(F.when(F.col("left_out") == -1, F.col("least"))).alias("whole"),
        F.min(F.when(F.col("left_out") >= 0, F.col("least"))).alias("any"), F.count("*").alias("spots"),
        F.min("alone").alias("alone")).where("spots > 1 OR NOT alone").drop("spots", "alone")
    both = broadcast_if_small(cut(spark, both, "keys"), max_broadcast)
    twins = broadcast_if_small(spots.where("NOT alone").select("key", "left_out", F.col("least").alias("twin")), max_broadcast)
    found = variants.join(both, "key").join(twins, ["key", "left_out"], "left").select(
        order.alias("me"), F.when(F.col("left_out") == -1, F.col("any")).otherwise(F.least("twin", "whole")).alias("other"))
    pairs = found.where("other < me").groupBy("me").agg(F.min("other").alias("other"))
    texts = chosen.select(order.alias("me"), F.split("line", " ").alias("words"))
    checked = (pairs.join(texts, "me").join(texts.select(F.col("me").alias("other"), F.col("words").alias("theirs")), "other")
               .where(within_one_edit(F.col("words"), F.col("theirs"))))
    return checked.select("me.*")


def within_one_edit(x: Column, y: Column) -> Column:
    """True if one word replaced, inserted or left out turns array x into array y, or nothing has to."""
    def alike(a: Column, b: Column) -> Column:
        place = F.array_position(F.zip_with(a, b, lambda p, q: F.coalesce(p == q, F.lit(False))), False)
        return F.when(place == 0, F.greatest(F.size(a), F.size(b))).otherwise(place - 1)

    longer = F.greatest(F.size(x), F.size(y))
    return ((F.abs(F.size(x) - F.size(y)) <= 1) & (alike(x, y) + alike(F.reverse(x), F.reverse(y)) >= longer - 1))


def dedup_lines(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                min_words: int = MIN_WORDS, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """``docs`` with the text without removed lines, and ``n_lines`` and ``n_removed`` (input columns of these names are replaced).

    Every row stays, also one whose lines all go (its text is empty). Null text stays null with no lines; an
    empty text is one empty line. Repeated rows lose the lines of all but the first. Rows with equal or null doc_ids are
    ordered by a number written down once (null ids last). An empty table gives an empty result.
    """
    own = {"n_lines", "n_removed"}
    names = docs.columns
    low = [c.lower() for c in names]
    text, number = low.index(text_col.lower()), low.index(id_col.lower())
    numbered = docs.toDF(*[f"c{i}" for i in range(len(names))]).withColumn("text", F.col(f"c{text}").cast("string"))
    rows = number_rows(spark, numbered.drop(f"c{text}"), f"c{number}")
    halves = F.when(F.col("n") >= min_words, _halves()).otherwise(F.array().cast("array<bigint>"))
    table = cut(spark, _lines(rows).select(*_ORDER, *_identity(), halves.alias("halves")), "occurrences")
    firsts = cut(spark, table.groupBy("k1", "k2").agg(F.min(F.struct(*_ORDER)).alias("first")).select("first.*"), "firsts")
    near = broadcast_if_small(cut(spark, _near(spark, table, rows, max_broadcast), "near"), max_broadcast)
    kept = firsts.join(near, list(_ORDER), "left_anti").groupBy("row_id").agg(F.collect_list("line_no").alias("stay"))
    blank = F.transform(F.split("text", "\n"), lambda x: _clean(x) == "")
    joined = rows.join(kept, "row_id", "left").select("*", _once(F.split("text", "\n").alias("lines"), blank.alias("blank")))
    unjudged = F.expr("CASE WHEN size(split.lines) > 0 THEN filter(sequence(0, size(split.lines) - 1), i -> split.blank[i]) "
                      "ELSE CAST(array() AS array<int>) END")
    joined = joined.withColumn("at", F.sort_array(F.concat(unjudged, F.coalesce("stay", F.array().cast("array<int>")))))
    new = F.when(F.col("text").isNotNull(), F.array_join(F.expr("transform(at, i -> split.lines[i])"), "\n"))
    plain = [(new if i == text else F.col(f"c{i}")).alias(names[i]) for i in range(len(names)) if low[i] not in own]
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size("split.lines"))
    return joined.select(*plain, n_lines.cast("long").alias("n_lines"),
                         F.when(F.col("text").isNull(), 0).otherwise(n_lines - F.size("at")).cast("long").alias("n_removed"))
