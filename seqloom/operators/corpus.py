"""Corpus building: first-wins deduplication, difficulty, held-out splits, canonical joins, vocabularies."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from hashlib import md5
from heapq import nsmallest

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions.slices import by_elements
from seqloom.sources.workspace import pinned, spare

SPECIALS = ("<pad>", "<unk>", "<s>", "</s>")


def first_of_each(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each value of ``key`` by ``order``: one row a value, also where rows repeat as a whole.

    Null keys are a value. Null orders come last; of rows equal in key and order the one of least hash is taken, so the result is the
    same for any dealing. Rows are combined before the shuffle, so a value that a third of all rows share sends one row a task.
    """
    (kept,) = spare(df, "kept")
    rest = F.struct(*(F.col(f"`{c}`") for c in df.columns if c != key)) if len(df.columns) > 1 else F.struct(F.lit(0).alias("none"))
    first = df.groupBy(key).agg(F.min_by(rest, F.struct(F.col(order).isNull(), order, F.xxhash64(rest))).alias(kept))
    return first.select(*(F.col(key) if c == key else F.col(f"{kept}.`{c}`").alias(c) for c in df.columns))


def dedup_counts(df: DataFrame, key: str) -> DataFrame:
    """``kept`` and ``duplicates``."""
    return df.groupBy(key).agg(F.count("*").alias("n")).agg(F.count("*").alias("kept"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def word_counts(df: DataFrame, tokens: Column) -> DataFrame:
    return df.select(F.explode(tokens).alias("word")).groupBy("word").agg(F.count("*").alias("count"))


def surprisal(counts: DataFrame) -> DataFrame:
    """``word, count, surprisal``: minus the logarithm of the word's share of all words."""
    total = counts.agg(F.sum("count")).scalar()
    return counts.select("word", "count", (-F.ln(F.col("count") / total)).alias("surprisal"))


#: How many of the most frequent words are joined by broadcast.
HOT_WORDS = 4096


def difficulty(df: DataFrame, index: str, tokens: Column, scores: DataFrame) -> DataFrame:
    """``index, score``: the sum of the words' scores; unknown words add 0, rows without words have 0.

    The most frequent words, most of any text, meet their scores where they are and are summed there. Only the others are
    shuffled by word, so no word is so common that its task is large.
    """
    word, hot, part = spare(df, "word", "hot", "part")
    each = df.select(index, F.explode(tokens).alias(word))
    frequent = scores.orderBy(F.desc("count"), "word").limit(HOT_WORDS).select(F.col("word").alias(word), F.col("surprisal").alias(hot))
    met = each.join(F.broadcast(frequent), word, "left")
    common = met.where(F.col(hot).isNotNull()).groupBy(index).agg(F.sum(hot).alias(part))
    others = scores.select(F.col("word").alias(word), F.col("surprisal").alias(hot))
    rare = met.where(F.col(hot).isNull()).select(index, word).join(others, word).groupBy(index).agg(F.sum(hot).alias(part))
    summed = common.unionByName(rare).groupBy(index).agg(F.sum(part).alias("score"))
    return df.select(index).join(summed, index, "left").select(index, F.coalesce("score", F.lit(0.0)).alias("score"))


def ranged(df: DataFrame, order: list[Column], part: str, place: str, width: int | None = None) -> DataFrame:
    """``df`` dealt by range and written once, with each row's range and its place in it.

    The bounds of ranges come from a sample. Two readers of one unwritten range exchange may get different bounds (they need
    different columns, so Spark plans two exchanges), and sizes of the one would shift rows of the other.
    """
    width = width or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(width, *order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()  # the partition's number above 33 bits of the row's place
    numbered = ordered.withColumn(place, at).withColumn(part, F.shiftright(place, 33).cast("int"))
    return pinned(numbered.withColumn(place, F.col(place).bitwiseAND(F.lit((1 << 33) - 1))), "ranged")


def dense_index(df: DataFrame, order: list[Column], name: str = "idx", width: int | None = None) -> DataFrame:
    """A dense 0-based position in a global order, without a window over all rows.

    A row's place in its range is shifted by the sizes of the ranges before it. Rows equal in all of ``order`` get some order,
    the same for all readers of the result.
    """
    part, place, size, shift = spare(df, "part", "place", "size", "shift")
    rows = ranged(df, order, part, place, width)
    sizes = rows.groupBy(part).agg(F.count("*").alias(size))
    shifts = sizes.select(part, (F.sum(size).over(Window.partitionBy(F.lit(0)).orderBy(part)) - F.col(size)).alias(shift))  # a row a range
    return rows.join(F.broadcast(shifts), part).withColumn(name, F.col(place) + F.col(shift)).select(*(c for c in df.columns if c != name), name)


def grouped_index(df: DataFrame, group: str, order: list[Column], width: int | None = None) -> DataFrame:
    """Adds ``position`` (0-based, in order) and ``group_size`` within each group.

    Rows are dealt by range of group and order, so a group with a third of all rows is spread over many tasks.
    """
    part, place, first, size, shift, key, at = spare(df, "part", "place", "first", "size", "shift", "key", "at")
    rows = ranged(df, [F.col(group), *order], part, place, width)
    sizes = rows.groupBy(part, group).agg(F.min(place).alias(first), F.count("*").alias(size))  # a row a range and group
    before = Window.partitionBy(group).orderBy(part)
    shifts = sizes.select(F.col(part).alias(at), F.col(group).alias(key), first, (F.sum(size).over(before) - F.col(size)).alias(shift), F.sum(size).over(Window.partitionBy(group)).alias("group_size"))
    joined = rows.join(shifts, (F.col(part) == F.col(at)) & F.col(group).eqNullSafe(F.col(key)))
    return joined.withColumn("position", F.col(place) - F.col(first) + F.col(shift)).select(*df.columns, "position", "group_size")


def hash_order(key: Column, seed: int) -> Column:
    """A reproducible shuffle key that other engines can compute."""
    return F.md5(F.concat(key.cast("string"), F.lit(":"), F.lit(str(seed))))


def drawn_number(*parts: object) -> int:
    """52 bits of the digest of ``parts``: a reproducible draw that other engines can compute."""
    return int(md5(":".join(map(str, parts)).encode()).hexdigest()[:13], 16)


def sample_groups(sizes: list[tuple[str, int]], target: int, most: int = 50, seed: int = 19260817, tolerance: tuple[float, float] = (0.8, 1.1), tries: int = 1_000_000) -> list[str]:
    """Names of groups whose sizes add up to about ``target``: draws of up to ``most`` groups without repetition until one fits.

    Works on one row a group, not on the data.
    """
    for k in range(tries if sizes else 0):
        n = 1 + drawn_number(seed, k) % min(len(sizes), most)
        chosen = nsmallest(n, sizes, key=lambda g: (drawn_number(g[0], seed, k), g[0]))
        if tolerance[0] * target <= sum(n for _, n in chosen) <= tolerance[1] * target:
            return sorted(name for name, _ in chosen)
    raise ValueError(f"no draw of groups comes near {target} rows")


def sample_sets(sizes: list[tuple[str, int]], capacity: int, seed: int = 19260817) -> list[str]:
    """Groups drawn by size, those that don't fit any more left out: an exponential race, the larger ones sooner."""
    used, out = 0, []
    for name, n in sorted(((g, n) for g, n in sizes if n > 0), key=lambda g: (-math.log((drawn_number(g[0], seed) + 1) / 2**52) / g[1], g[0])):
        if used + n <= capacity:
            out.append(name)
            used += n
    return out


def split_held_out(df: DataFrame, index: str, group: str, held_out: list[str], name: str, extra_portion: float, seed: int) -> DataFrame:
    """``index, split`` of the rows of the given groups: of each group's shuffled rows the first part is extra training data."""
    rows = df.where(F.col(group).isin(held_out)).select(index, group)
    placed = grouped_index(rows, group, [hash_order(F.col(index), seed), F.col(index)])
    return placed.select(index, F.when(F.col("position") < F.floor(F.col("group_size") * extra_portion), F.lit("train_extra")).otherwise(F.lit(name)).alias("split"))


def with_training(df: DataFrame, index: str, held: DataFrame) -> DataFrame:
    """Held-out splits and, as ``train``, all rows in none of them."""
    return held.unionByName(df.select(index).join(held, index, "left_anti").withColumn("split", F.lit("train")))


def first_rows(df: DataFrame, order: list[Column], size: int) -> DataFrame:
    """The first ``size`` rows of a global order, for sizes that grow with the data: no task gathers them."""
    (at,) = spare(df, "at")
    return dense_index(df, order, at).where(F.col(at) < size).drop(at)


def prefix(scores: DataFrame, index: str, size: int) -> DataFrame:
    """The easiest ``size`` rows (ties by index), in order."""
    return first_rows(scores, [F.col("score"), F.col(index)], size).orderBy("score", index)


def canonical_join(texts: DataFrame, canon: DataFrame, key: str, order: str, canon_order: str) -> DataFrame:
    """All canonical rows, each once: those that a text asks for in the text's order, then the rest.

    Of canonical rows with equal keys the last counts, of texts with equal keys the first; later texts find it used up.
    """
    build = canon.groupBy(key).agg(F.max_by(F.struct(*canon.columns), canon_order).alias("c")).select("c.*")
    first = texts.groupBy(key).agg(F.min(order).alias("text_order"))
    return build.join(first, key, "left")


def canonical_unmatched(texts: DataFrame, canon: DataFrame, key: str, order: str) -> DataFrame:
    """Texts that find no canonical row, or one already used by an earlier text."""
    (least,) = spare(texts, "first")
    first = texts.groupBy(key).agg(F.min(order).alias(least))
    hit = first.join(canon.select(key).distinct(), key, "left_semi").select(F.col(least).alias(order))
    return texts.join(hit, order, "left_anti")


def vocabulary(counts: DataFrame, size: int, specials: tuple[str, ...] = SPECIALS) -> DataFrame:
    """``token, id``: the special tokens, then the most frequent words (ties by word) up to ``size`` in all."""
    if len(set(specials)) != len(specials):
        raise ValueError("repeated special tokens")
    words = counts.where(~F.col("word").isin(list(specials))).orderBy(F.desc("count"), "word").limit(max(0, size - len(specials)))
    ranked = words.withColumn("id", (F.row_number().over(Window.orderBy(F.desc("count"), "word")) + len(specials) - 1).cast("int"))  # bounded by ``size``
    head = counts.sparkSession.createDataFrame(list(zip(specials, range(len(specials)), strict=True)), "token string, id int")
    return head.unionByName(ranked.select(F.col("word").alias("token"), "id"))


def _lists(column: pa.ListArray, values: pa.Array) -> pa.ListArray:
    """``values`` in lists as long as those of ``column`` (null lists are empty)."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32()), values)


def _mapped(df: DataFrame, index: str, lists: Column, converter: Callable[[], Callable[[pa.Array], pa.Array]], name: str, kind: str) -> DataFrame:
    """``index`` and the lists with their elements converted, batch by batch; nothing is shuffled. The converter is made once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        convert = converter()
        for b in (part for whole in batches for part in by_elements(whole)):
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(b.column(1), convert(b.column(1).flatten()))], names=[index, name])

    return df.select(index, lists.alias(f"{index}_lists")).mapInArrow(run, f"`{index}` {df.schema[index].dataType.simpleString()}, {name} array<{kind}>")


#: Rows of a vocabulary that may be sent to every task; a larger one meets the words in a join.
VOCABULARY_ROWS = 5_000_000


def _shared_vocabulary(vocab: DataFrame):
    """The vocabulary on all executors, or None if it is too large for that."""
    rows = vocab.select("token", "id").limit(VOCABULARY_ROWS + 1).collect()
    if len(rows) > VOCABULARY_ROWS:
        return None
    return vocab.sparkSession.sparkContext.broadcast(([r.token for r in rows], [r.id for r in rows]))


def _joined(df: DataFrame, index: str, lists: Column, table: DataFrame, key: str, value: str, missing: Column, name: str) -> DataFrame:
    """``index`` and the lists with their elements looked up in ``table`` by a join: for tables of any size. An element's row is copied 64
    times, once for each 64th of the rows, so a frequent word is not one task's; lists come together again by their row's number."""
    row, place, element, found, place_of = spare(df, "row", "place", "element", "found", "salt")
    numbered = pinned(df.select(index, lists.alias(element)).withColumn(row, F.monotonically_increasing_id()), "lists")
    each = numbered.select(row, F.posexplode(element).alias(place, element))
    salt = F.pmod(F.col(row), F.lit(64)).alias(place_of)
    known = each.select(element).distinct().join(table.select(F.col(key).alias(element), F.col(value).alias(found)), element)
    spread = known.select(element, found, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long"))).alias(place_of))
    met = each.select("*", salt).join(spread, [element, place_of], "left").withColumn(found, F.coalesce(F.col(found), missing))
    laid = met.groupBy(row).agg(F.sort_array(F.collect_list(F.struct(place, found))).alias(element))  # a list's own length
    out = numbered.select(index, row).join(laid, row, "left")
    return out.select(index, F.coalesce(F.transform(element, lambda x: x[found]), F.array().cast(f"array<{table.schema[value].dataType.simpleString()}>")).alias(name))


def token_ids(df: DataFrame, index: str, tokens: Column, vocab: DataFrame, unknown: int = 1) -> DataFrame:
    """``index, ids``: in token order, ``unknown`` for words that the vocabulary lacks.

    A vocabulary is mostly bounded by the size it was made with: up to ``VOCABULARY_ROWS``, which is checked, it goes to the rows and texts
    stay where they are; a larger one is joined.
    """
    shared = _shared_vocabulary(vocab)
    if shared is None:
        return _joined(df, index, tokens, vocab.select("token", F.col("id").cast("int").alias("id")), "token", "id", F.lit(unknown), "ids")

    def converter() -> Callable[[pa.Array], pa.Array]:
        known, ids = shared.value
        place, out = {t: k for k, t in enumerate(known)}, pa.array([*ids, unknown], pa.int32())

        def convert(flat: pa.Array) -> pa.Array:
            coded = flat.dictionary_encode()  # each distinct word of a batch is looked up once
            at = np.fromiter((place.get(t, len(known)) for t in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
            codes = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False)
            return out.take(pa.array(np.append(at, len(known))[codes]))

        return convert

    return _mapped(df, index, tokens, converter, "ids", "int")


def tokens_of(ids: DataFrame, index: str, vocab: DataFrame) -> DataFrame:
    """``index, tokens``; an id that is not in the vocabulary is an error."""
    shared = _shared_vocabulary(vocab)
    if shared is None:
        wrong = F.raise_error(F.lit("no token has such an id")).cast("string")
        return _joined(ids, index, F.col("ids"), vocab, "id", "token", wrong, "tokens")

    def converter() -> Callable[[pa.Array], pa.Array]:
        tokens, known = shared.value
        order = np.argsort(np.array(known, np.int64), kind="stable")
        ranked, words = np.array(known, np.int64)[order], pa.array(tokens, pa.string()).take(pa.array(order))

        def convert(flat: pa.Array) -> pa.Array:
            wanted = pc.fill_null(flat.cast(pa.int64()), -1).to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(ranked, wanted), len(ranked) - 1) if len(ranked) else np.zeros(len(wanted), np.int64)
            wrong = np.flatnonzero(ranked[at] != wanted) if len(ranked) else np.arange(len(wanted))
            if len(wrong):
                raise ValueError(f"no token has id {flat[int(wrong[0])]}")
            return words.take(pa.array(at))

        return convert

    return _mapped(ids, index, F.col("ids"), converter, "tokens", "string")


def identifier_counts(lexed_rows: DataFrame, tokens: str, names: str | None = None) -> DataFrame:
    """Counts of identifiers; those that are variables count under both of their names."""
    each = lexed_rows.select(F.explode(F.filter(tokens, lambda t: t["type"] == "ID")).alias("t"), *([names] if names else []))
    if not names:
        return each.groupBy(F.col("t.value").alias("word")).agg(F.count("*").alias("count"))
    known = F.col(names)[F.col("t.value")]
    both = F.when(known.isNotNull(), F.array(known["decomp"], known["orig"])).otherwise(F.array(F.col("t.value")))
    return each.select(F.explode(both).alias("word")).groupBy("word").agg(F.count("*").alias("count"))


def least_hashed(df: DataFrame, size: int, hashed: Column, order: list[Column]) -> DataFrame:
    """The ``size`` rows of least hash (32 hexadecimal digits, as ``hash_order`` gives; ties by ``order``).

    Rows far above the expected cut are left out before anything is shuffled; should too few be below it, all rows take part.
    """
    (h,) = spare(df, "hash")
    rows = df.withColumn(h, hashed)
    n = rows.count()
    share = (size + 8 * size**0.5 + 64) / n if n else 1.0
    if share < 1:
        low = rows.where(F.col(h) < F.lit(f"{round(share * 2**64):016x}"))
        rows = low if low.count() >= size else rows
    return first_rows(rows, [F.col(h), *order], size).drop(h)


def reservoir(df: DataFrame, size: int, seed: int, key: str) -> DataFrame:
    """A uniform sample of ``size`` rows (all, if fewer), the same on every run: least hashes of the rows' keys win."""
    return least_hashed(df, size, hash_order(F.col(key), seed), [F.col(key)])


def shuffled(df: DataFrame, seed: int, key: str) -> DataFrame:
    return df.orderBy(hash_order(F.col(key), seed), key)


def category_share(df: DataFrame, item: str, group: Column) -> DataFrame:
    """``grp, item, n, total``: counts of items and of their groups."""
    counted = df.groupBy(group.alias("grp"), F.col(item).alias("item")).agg(F.count("*").alias("n"))
    return counted.withColumn("total", F.sum("n").over(Window.partitionBy("grp")))
