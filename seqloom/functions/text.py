"""Column functions on token sequences and encoded records. All stay inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

TUPLE, TOKEN = "\x01", "\x00"
#: White space as Python's ``str.split`` has it.
UNICODE_SPACE = r"\x09-\x0D\x1C-\x20\x85\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
ASCII_SPACE = r" \t\n\r\f"
#: Type qualifiers that never, or only on request, count in a comparison of types.
ALWAYS_DROPPED = ("signed",)
CV_QUALIFIERS = ("const", "volatile")
STORAGE_QUALIFIERS = ("static", "auto", "register", "extern", "restrict")


def strip(c: Column, space: str = UNICODE_SPACE) -> Column:
    return F.regexp_replace(c, f"^[{space}]+|[{space}]+$", "")


def words(c: Column, space: str = UNICODE_SPACE) -> Column:
    """Pieces between white space, none of them empty."""
    return F.array_remove(F.split(c, f"[{space}]+"), "")


def join_tokens(tokens: Column, by: str = TOKEN) -> Column:
    return F.array_join(tokens, by)


def split_tokens(c: Column, by: str = TOKEN) -> Column:
    return F.split(c, by, -1)


def literal_aware(tokens: Column, space: str = UNICODE_SPACE) -> Column:
    """A token that starts with a quote becomes a quote, the words between its first and last character, and a quote."""
    quote = F.array(F.lit('"'))

    def one(t: Column) -> Column:
        inner = F.when(F.length(t) < 3, F.array().cast("array<string>")).otherwise(words(F.substring(t, F.lit(2), F.length(t) - 2), space))
        return F.when(t.startswith('"'), F.concat(quote, inner, quote)).otherwise(F.array(t))

    return F.flatten(F.transform(tokens, one))


def encode_record(src: Column, tgt: Column, names: Column, score: Column, repo: Column, sha: Column) -> Column:
    """One line: six fields, names as flat triples of key and both names."""
    triples = F.flatten(F.transform(F.map_entries(names), lambda e: F.array(e["key"], e["value"]["decomp"], e["value"]["orig"])))
    return F.concat(src, F.lit(TUPLE), tgt, F.lit(TUPLE), F.array_join(triples, TOKEN), F.lit(TUPLE), score.cast("string"), F.lit(TUPLE), repo, F.lit(TUPLE), sha)


def decode_record(line: Column) -> Column:
    """Struct of the six fields. Surplus middle pieces belong to the target; of repeated names the last counts; fewer than five
    pieces or a score that is no number is an error."""
    p = F.split(line, TUPLE, -1)
    n = F.size(p)
    at = lambda i: F.element_at(p, F.lit(i))
    flat = F.when(at(-4) == "", F.array().cast("array<string>")).otherwise(F.split(at(-4), TOKEN, -1))
    entries = F.transform(
        F.sequence(F.lit(0), F.floor(F.size(flat) / 3).cast("int")),
        lambda k: F.struct(F.get(flat, k * 3).alias("key"), F.struct(F.get(flat, k * 3 + 1).alias("decomp"), F.get(flat, k * 3 + 2).alias("orig")).alias("value")),
    )
    entries = F.filter(entries, lambda e: e["key"].isNotNull())
    position = lambda i: F.exists(F.sequence(F.lit(0), F.size(entries)), lambda j: (j > i) & (F.get(entries, j)["key"] == F.get(entries, i)["key"]))
    last = F.filter(entries, lambda e, i: ~F.coalesce(position(i), F.lit(False)))
    score = F.coalesce(at(-3).try_cast("double"), F.raise_error(F.lit("not a score")).cast("double"))
    whole = F.struct(
        F.get(p, F.lit(0)).alias("src"), F.array_join(F.slice(p, F.lit(2), F.greatest(n - 5, F.lit(0))), TUPLE).alias("tgt"),
        F.map_from_entries(last).alias("var_names"), score.alias("score"), at(-2).alias("repo"), at(-1).alias("sha"),
    )
    return F.when(n >= 5, whole).otherwise(F.raise_error(F.concat(F.lit("record of "), n.cast("string"), F.lit(" pieces"))))


def decode_pieces(p: Column) -> Column:
    """Subword pieces to words: a piece that starts with the mark starts a word; marks elsewhere are text."""
    mark = "▁"
    marked = F.transform(p, lambda x: F.when(x.startswith(mark), F.concat(F.lit(TUPLE), F.substring(x, F.lit(2), F.length(x)))).otherwise(x))
    out = F.split(F.array_join(marked, ""), TUPLE, -1)
    first = F.get(p, F.lit(0)).startswith(mark)
    return F.when(F.size(p) == 0, F.array().cast("array<string>")).otherwise(F.when(first, F.slice(out, F.lit(2), F.size(out))).otherwise(out))


def decode_bpe(p: Column, suffix: str = "@@") -> Column:
    """Pieces that end with the suffix continue; an open word at the end counts."""
    text = F.array_join(F.transform(p, lambda x: F.when(x.endswith(suffix), F.substring(x, F.lit(1), F.length(x) - len(suffix))).otherwise(F.concat(x, F.lit(TUPLE)))), "")
    out = F.split(text, TUPLE, -1)
    ended = F.element_at(out, -1) == ""
    return F.when(F.size(p) == 0, F.array().cast("array<string>")).otherwise(F.when(ended, F.slice(out, F.lit(1), F.size(out) - 1)).otherwise(out))


def until_end(ids: Column, end_id: int) -> Column:
    """Ids before the first end id."""
    at = F.array_position(ids, end_id)
    return F.when(at > 0, F.slice(ids, F.lit(1), (at - 1).cast("int"))).otherwise(ids)


def substitute_names(tokens: Column, names: Column, which: str) -> Column:
    """Tokens that are variables replaced by one of their two names."""
    return F.transform(tokens, lambda t: F.coalesce(names[t][which], t))


def both_names(tokens: Column, names: Column) -> Column:
    return F.flatten(F.transform(tokens, lambda t: F.when(names[t].isNotNull(), F.array(names[t]["decomp"], names[t]["orig"])).otherwise(F.array(t))))


def replace_by_map(text: Column, names: Column, which: str = "orig") -> Column:
    """Each key replaced wherever it occurs as a substring, in the map's order, one after another."""
    return F.aggregate(F.map_entries(names), text, lambda s, e: F.replace(s, e["key"], e["value"][which]))


def normalised_type(tokens: Column, *, cv: bool = False, storage: bool = False) -> Column:
    """A type without the qualifiers that don't count; repeated words (``long long``) stay."""
    dropped = [*ALWAYS_DROPPED, *(() if cv else CV_QUALIFIERS), *(() if storage else STORAGE_QUALIFIERS)]
    return F.array_join(F.filter(tokens, lambda t: ~t.isin(dropped)), " ")


def anonymous(lexed: Column) -> Column:
    """Lexed tokens as values, identifiers all alike."""
    return F.transform(lexed, lambda t: F.when(t["type"] == "ID", F.lit("_VAR_")).otherwise(t["value"]))


def string_literals(lexed: Column) -> Column:
    return F.array_distinct(F.transform(F.filter(lexed, lambda t: t["type"].isin("STRING_LITERAL", "WSTRING_LITERAL")), lambda t: t["value"]))


def fits(src: Column, tgt: Column, max_src: int = 1024, max_tgt: int = 1024, ratio: tuple[float, float] = (0.5, 3.0)) -> Column:
    """Room for one more token on each side, and a ratio of lengths within bounds (inclusive)."""
    return (F.size(src) + 1 <= max_src) & (F.size(tgt) + 1 <= max_tgt) & F.coalesce(F.try_divide(F.size(src), F.size(tgt)).between(*ratio), F.lit(False))


def fits_by_separators(src: Column, tgt: Column, by: str = " ", limit: int = 512, ratio: tuple[float, float] = (0.5, 3.0)) -> Column:
    count = lambda c: F.length(c) - F.length(F.replace(c, F.lit(by), F.lit(""))) + 1
    return (count(src) <= limit) & (count(tgt) <= limit) & (count(src) / count(tgt)).between(*ratio)


def truncated(tokens: Column, limit: int) -> Column:
    return F.slice(tokens, 1, limit - 1)


def padded(ids: Column, width: Column, pad_id: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(pad_id), (width - F.size(ids)).cast("int")))


def shifted(ids: Column, start_id: int) -> Column:
    return F.concat(F.array(F.lit(start_id)), F.slice(ids, F.lit(1), F.size(ids) - 1))


def markdown_id(c: Column) -> Column:
    return F.regexp_replace(F.translate(F.lower(c), "_ ", "--"), "[^a-z0-9-]", "")


def indented(c: Column, by: int) -> Column:
    return F.regexp_replace(c, r"(?m)^", " " * by)


def binary_keys(c: Column) -> Column:
    """A map with its keys as bytes."""
    return F.transform_keys(c, lambda k, _: k.cast("binary"))


def column_list(names: Sequence[str]) -> list[Column]:
    return [F.col(n) for n in names]
