"""Canonical exact digests of documents.

A text is brought to a canonical form (compatibility composition, full case folding, composition again, runs of white space as
one space, none at the ends) and digested to 128 bits by two seeded 64-bit xxhashes. Inside each bucket of equal digests the
canonical forms are compared byte by byte: a second form of a bucket gets the suffix ``-1``, a third ``-2``, in order of
their bytes. So equal fingerprints mean equal canonical texts, without exception.

All of it is SQL functions of the JVM; normalisation and folding are the ICU library's static methods, called by
``java_method``. Copies collapse in the map-side part of the grouping, so a bucket with a third of all rows sends one row a task.

Defined results: a null text counts as empty; rows repeated as a whole each get their row; rows with a null id come first in
the order of documents; ties of ids are ordered by a digest of the text; an empty table gives an empty table; extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.common import KeyFilter, pinned, shuffle_width

#: White space as Unicode and ASCII separators have it.
SPACE = r"\x09-\x0D\x1C-\x20\x85\p{Z}"
ODD_SPACE = r"\x09-\x0D\x1C-\x1F\x85\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def composed(text: Column) -> Column:
    return F.call_function("java_method", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))


def folded(text: Column) -> Column:
    return F.call_function("java_method", F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), text, F.lit(True))


def canonical(text: Column) -> Column:
    given = F.coalesce(text, F.lit(""))
    # ASCII (as many bytes as characters) is composed as it is, and its folding is plain lower case.
    once = F.when(F.octet_length(given) == F.length(given), F.lower(given)).otherwise(composed(folded(composed(given))))
    # A lone space stays as it is, so only other white space and longer runs are rewritten.
    single = F.regexp_replace(once, f"[{ODD_SPACE}][{SPACE}]*| [{SPACE}]+", " ")
    return F.btrim(single)


def digest(canon: Column) -> Column:
    """128 bits in hexadecimal."""
    halves = [F.lpad(F.lower(F.hex(F.xxhash64(F.lit(seed), canon))), 16, "0") for seed in (1, 2)]
    return F.concat(*halves)


def row_key(doc_id: Column, text: Column) -> Column:
    return F.unhex(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))))


def distinct_rows(docs: DataFrame) -> DataFrame:
    """``rid, doc_id, text, copies``: one row for rows that are equal as a whole."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return base.withColumn("rid", row_key(F.col("doc_id"), F.col("text"))).groupBy("rid").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.count("*").alias("copies"))


def successors(docs: DataFrame) -> DataFrame:
    """``rid, doc_id, n, next_rid, repeats``: each document's successor by ascending id, the first one's for the last.

    Ids are dealt by range, so only neighbours inside a range and the first rows of the ranges are looked at: no window spans
    more than one range, and the one over ranges has a row for each.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = base.select("doc_id", F.length("text").alias("n"), row_key(F.col("doc_id"), F.col("text")).alias("rid")).groupBy("rid").agg(F.first("doc_id").alias("doc_id"), F.first("n").alias("n"), F.count("*").alias("copies"))
    width = shuffle_width(docs.sparkSession)
    ranged = pinned(ids.repartitionByRange(width, F.asc_nulls_first("doc_id"), "rid").withColumn("part", F.spark_partition_id()), "order")
    here = Window.partitionBy("part").orderBy(F.asc_nulls_first("doc_id"), "rid")
    firsts = ranged.groupBy("part").agg(F.min(F.struct("doc_id", "rid")).alias("first"))
    by_part = Window.partitionBy(F.lit(0)).orderBy("part")
    whole = by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = firsts.select("part", F.coalesce(F.lead("first.rid").over(by_part), F.first("first.rid").over(whole)).alias("after"))
    linked = ranged.withColumn("following", F.lead("rid").over(here)).join(following, "part")
    once = F.struct(F.coalesce("following", "after").alias("next_rid"), F.lit(1).cast("long").alias("repeats"))
    again = F.struct(F.col("rid").alias("next_rid"), (F.col("copies") - 1).alias("repeats"))
    return linked.select("rid", "doc_id", "n", F.inline(F.filter(F.array(once, again), lambda x: x["repeats"] > 0)))


def edited(rows: DataFrame, order: DataFrame) -> DataFrame:
    """``order`` with ``text, edited``: the last half of each text replaced by as many first characters of the next one.

    Both joins read ``rows`` with the same columns by the same key, so texts are shuffled once and read twice.
    """
    half = F.floor(F.col("n") / 2).cast("int")
    texts = rows.select("rid", "text")
    ahead = texts.alias("t").join(order.alias("o"), F.col("t.rid") == F.col("o.next_rid"))
    pieces = ahead.select("o.*", F.substr("t.text", F.lit(1), half).alias("piece"))
    joined = texts.join(pieces, "rid")
    return joined.withColumn("edited", F.concat(F.substr("text", F.lit(1), F.col("n") - half), F.col("piece"))).drop("piece")


def restricted(docs: DataFrame, rids: DataFrame) -> DataFrame:
    """The rows of ``docs`` with these keys, and a few others: what is left out is left out before anything is shuffled."""
    keys = pinned(rids.select("rid").distinct(), "keys")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("rid", row_key(F.col("doc_id"), F.col("text")))
    return KeyFilter.of(keys, "rid").passing(base, "rid").select("doc_id", "text")


def fingerprint(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.

    The likeness of two exact digests is 1 where they are equal, else 0.
    """
    order = pinned(successors(docs), "successors")
    both = edited(distinct_rows(docs), order)
    first = both.select(
        "rid", "doc_id", "n", "next_rid", "repeats", F.sha2("edited", 256).alias("edited_sha256"), digest(canonical(F.col("text"))).alias("fp"), digest(canonical(F.col("edited"))).alias("efp")
    )
    digests = pinned(first, "digests")

    # Byte comparison inside buckets of more than one row. A few other rows pass the filters: their forms are compared too.
    # Copies fall together in the map-side part of the grouping by form, however many there are.
    seen = digests.select("rid", "fp").distinct().select("fp").unionAll(digests.select(F.col("efp").alias("fp"))).groupBy("fp").count().where("count > 1").select("fp")
    buckets = KeyFilter.of(pinned(seen, "buckets"), "fp")
    shared_text = buckets.passing(digests.select("rid", "fp"), "fp")
    shared_edit = pinned(buckets.passing(digests.select("rid", "doc_id", "n", "next_rid", "repeats", "efp"), "efp").drop("efp"), "edits")
    of_text = restricted(docs, shared_text).select(canonical(F.col("text")).alias("canon"))
    needed = shared_edit.select("rid").unionAll(shared_edit.select(F.col("next_rid").alias("rid")))
    of_edit = edited(distinct_rows(restricted(docs, needed)), shared_edit).select(canonical(F.col("edited")).alias("canon"))
    forms = of_text.unionAll(of_edit).select(digest(F.col("canon")).alias("fp"), "canon").groupBy("fp", "canon").agg(F.count("*").alias("rows"))
    clashing = pinned(
        forms.join(forms.groupBy("fp").count().where("count > 1").select("fp"), "fp", "left_semi")
        .withColumn("ordinal", F.row_number().over(Window.partitionBy("fp").orderBy("canon")) - 1).where("ordinal > 0"), "clashes",
    )
    if clashing.isEmpty():
        named = digests
    else:  # different forms share a digest: their rows' texts are looked at again and get the form's ordinal
        suffix = F.when(F.col("ordinal").isNull(), F.lit("")).otherwise(F.concat(F.lit("-"), F.col("ordinal")))
        again = edited(distinct_rows(docs), order).select("rid", "next_rid", canonical(F.col("text")).alias("canon"), canonical(F.col("edited")).alias("ecanon"))
        left = clashing.select("canon", "ordinal")
        texts = again.join(left, "canon").select("rid", "next_rid", suffix.alias("s"))
        edits = again.withColumnRenamed("canon", "_").join(left, again["ecanon"] == left["canon"]).select("rid", "next_rid", suffix.alias("es"))
        named = (
            digests.join(texts, ["rid", "next_rid"], "left").join(edits, ["rid", "next_rid"], "left")
            .withColumn("fp", F.concat("fp", F.coalesce("s", F.lit("")))).withColumn("efp", F.concat("efp", F.coalesce("es", F.lit(""))))
        )
    of_next = named.select(F.col("rid").alias("next_rid"), F.col("fp").alias("next_fp")).distinct()
    like = lambda a, b: F.when(F.col(a) == F.col(b), 1.0).otherwise(0.0)
    out = named.join(of_next, "next_rid").withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), "repeats")))
    return out.select("doc_id", F.col("n").cast("long").alias("n_chars"), "edited_sha256", F.col("fp").alias("fingerprint"), F.col("efp").alias("edited_fingerprint"), like("fp", "efp").alias("near_edited"), like("fp", "next_fp").alias("near_next"))
