"""Queries through files: tables written by a sink and read back by a source, with what should come back in DuckDB SQL."""

from __future__ import annotations

import io
import json
import os
import tempfile

from pyspark.sql import functions as F

from seqloom.functions import bleu, formatting, text
from seqloom.operators import compare, corpus, drawing, feeding, overlap
from seqloom.plans.corpus_queries import PAIRS, S as CORPUS_S, SEED, VOCAB, WORDS, _vocab, conversation_pairs, heldout_split, table, words
from seqloom.plans.evaluation_queries import S as EVALUATION_S, bleu_sql, score_sql
from seqloom.sources import config, files, readers, sinks
from seqloom.sources.workspace import scratch

Q: dict = {}
S: dict[str, str] = {}


def query(sql: str):
    def register(f):
        Q[f.__name__], S[f.__name__] = f, sql
        return f

    return register


def sql_words(c: str) -> str:
    return WORDS.format(c)


def joined(c: str, by: str = "|") -> str:
    return f"array_to_string({sql_words(c)}, '{by}')"


def tokens(c: str, by: str = text.TOKEN):
    return F.array_join(words(c), by)


def md5_of(c: str, name: str):
    """The digest of a text whose separators are made visible."""
    return F.md5(F.translate(F.col(c), text.TOKEN + text.TUPLE, "||")).alias(name)


NAMES = '{"the": {"decomp": "v1", "orig": "word"}, "a": {"decomp": "v2", "orig": "one"}}'


def names():
    return F.from_json(F.lit(NAMES), "map<string,struct<decomp:string,orig:string>>")


def records(spark, sf_dir):
    """Pairs as records, tokens by NUL, with the number of target words as score."""
    pairs = conversation_pairs(spark, sf_dir)
    return pairs.select("idx", tokens("src").alias("src"), tokens("tgt").alias("tgt"), names().alias("var_names"), F.size(words("tgt")).cast("double").alias("score"), F.concat(F.lit("r"), F.col("idx") % 7).alias("repo"), F.md5(F.col("idx").cast("string")).alias("sha"))


NUMBERED = f"{PAIRS}, num AS (SELECT row_number() OVER (ORDER BY idx) - 1 AS place, idx, {joined('src')} AS s, {joined('tgt')} AS t, len({sql_words('tgt')}) AS n FROM pairs)"


@query(f"WITH {PAIRS} SELECT md5(CAST(idx AS VARCHAR)) AS sha, CASE WHEN idx % 2 = 0 THEN 'even/half' ELSE 'odd/half' END AS repo, md5({joined('src')}) AS src_md5, md5({joined('tgt')}) AS tgt_md5, 'word' AS orig_of_the FROM pairs")
def matched_function_files(spark, sf_dir):
    """JSON lines in a folder a repository."""
    path = scratch(spark, "matched")
    found = F.transform_values(names(), lambda _, v: F.array(v["decomp"], v["orig"]))
    rows = conversation_pairs(spark, sf_dir).select("idx", words("src").alias("decompiled_tokens"), words("tgt").alias("original_tokens"), found.alias("variable_names"), F.md5(F.col("idx").cast("string")).alias("binary_hash"))
    for k, owner in enumerate(("even", "odd")):
        rows.where(F.col("idx") % 2 == k).drop("idx").write.json(f"{path}/{owner}/half")
    back = readers.well_formed(readers.matched_functions(spark, f"{path}/*/*"))
    return back.select("sha", "repo", md5_of("decompiled_code", "src_md5"), md5_of("original_code", "tgt_md5"), F.col("var_names")["the"]["orig"].alias("orig_of_the"))


@query("SELECT lang AS repo_owner, source AS repo_name, CAST(count(*) AS INTEGER) AS funcs_matched FROM documents GROUP BY lang, source HAVING count(*) > 0 ORDER BY lang, source LIMIT 12")
def registry_head(spark, sf_dir):
    """The first twelve repositories in order of owner and name (the limit is the feature)."""
    counted = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("repo_owner"), F.col("source").alias("repo_name")).agg(F.count("*").cast("int").alias("funcs_matched"))
    return readers.registry(counted, 12)


@query("SELECT doc_id, md5(text) AS text_md5, true AS small_block FROM documents")
def raw_blocks(spark, sf_dir):
    """Blocks of at most 100 rows, read back in any order."""
    path = scratch(spark, "blocks")
    sinks.write_blocks(table(spark, sf_dir, "documents").select("doc_id", "text"), path, 100)
    rows = readers.blocks(spark, path)
    sizes = rows.groupBy("block").agg((F.count("*") <= 100).alias("small_block"))
    return rows.join(sizes, "block").select("doc_id", F.md5("text").alias("text_md5"), "small_block")


@query(f"WITH {NUMBERED} SELECT place AS idx, md5(s) AS src_md5, md5(t) AS tgt_md5, CAST(n AS DOUBLE) AS score, 'r' || (idx % 7) AS repo, md5(CAST(idx AS VARCHAR)) AS sha, 'one' AS orig_of_a FROM num")
def encoded_records(spark, sf_dir):
    """Encoded lines in index order, decoded again."""
    path = scratch(spark, "records")
    sinks.write_records(records(spark, sf_dir), path, "idx")
    return readers.encoded(spark, path).select("idx", md5_of("src", "src_md5"), md5_of("tgt", "tgt_md5"), "score", "repo", "sha", F.col("var_names")["a"]["orig"].alias("orig_of_a"))


@query(f"SELECT row_number() OVER (ORDER BY doc_id) - 1 AS idx, md5({joined('text', ' ')}) AS line_md5 FROM documents WHERE len({sql_words('text')}) > 0")
def line_files(spark, sf_dir):
    """One padded line a document in id order; blank lines go, the rest is stripped and numbered."""
    path = scratch(spark, "lines")
    sinks.write_lines(table(spark, sf_dir, "documents"), path, F.concat(F.lit(" \t"), tokens("text", " "), F.lit("  ")), "doc_id")
    return readers.lines(spark, path).select("idx", F.md5("value").alias("line_md5"))


@query(f"WITH {NUMBERED} SELECT place AS idx, md5(replace(s, '|', ' ')) AS src_md5, md5(replace(t, '|', ' ')) AS tgt_md5, CAST(n AS DOUBLE) AS value, md5(CAST(idx AS VARCHAR)) AS sha FROM num")
def zipped_lists(spark, sf_dir):
    """Pairs and a list of scores from two sets of files, side by side by position."""
    path, rows = scratch(spark, "zipped"), records(spark, sf_dir)
    sinks.write_records(rows, f"{path}/pairs", "idx")
    sinks.write_scores(rows, f"{path}/scores", "idx", "score")
    both = readers.zipped(readers.pairs(spark, f"{path}/pairs", additional=True).drop("score"), readers.numbers(spark, f"{path}/scores"))
    plain = lambda c, n: F.md5(F.replace(c, F.lit("|"), F.lit(" "))).alias(n)
    return both.select("idx", plain("src", "src_md5"), plain("tgt", "tgt_md5"), "value", "sha")


@query(f"WITH {VOCAB} SELECT CAST(id AS INTEGER) AS id, token FROM v")
def vocabulary_file(spark, sf_dir):
    """A vocabulary with a second field a line, which reading drops."""
    path = scratch(spark, "vocabulary")
    sinks.write_lines(_vocab(spark, sf_dir), path, F.concat(F.col("token"), F.lit("\t"), F.col("id").cast("string")), "id")
    return readers.vocabulary(spark, path)


@query(f"SELECT doc_id, md5({joined('text')}) AS src_md5, true AS other_sides FROM documents")
def canonical_separators(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", *(tokens("text", text.TUPLE).alias(c) for c in ("src", "tgt", "raw_tgt")))
    out = readers.canonical(docs)
    same = (F.col("src") == F.col("tgt")) & (F.col("tgt") == F.col("raw_tgt")) & ~F.contains("src", F.lit(text.TUPLE))
    return out.select("doc_id", md5_of("src", "src_md5"), same.alias("other_sides"))


SYSTEM_LINES = "SELECT unnest(['base', 'beam']) AS system"


@query(f"WITH {PAIRS} SELECT idx, system, md5(src) AS src_md5, md5(CASE WHEN system = 'base' THEN src ELSE tgt END) AS hyp_md5, round(length(src) / (1 + length(tgt)), 6) AS overlap FROM pairs, ({SYSTEM_LINES})")
def evaluation_bundle(spark, sf_dir):
    """Examples and two systems' hypotheses, written apart and joined by the systems' names."""
    path, pairs = scratch(spark, "bundle"), conversation_pairs(spark, sf_dir)
    score = F.round(F.length("src") / (1 + F.length("tgt")), 6).alias("overlap")
    each = F.inline(F.array(F.struct(F.lit("base").alias("system"), F.col("src").alias("hyp")), F.struct(F.lit("beam").alias("system"), F.col("tgt").alias("hyp"))))
    files.write_bundle(pairs.select("idx", "src"), pairs.select("idx", each, score), path)
    return files.read_bundle(spark, path).select("idx", "system", F.md5("src").alias("src_md5"), F.md5("hyp").alias("hyp_md5"), "overlap")


@query("SELECT * FROM (VALUES ('batch.size', '3072'), ('batch.words', '4096'), ('lists', '[1, 2]'), ('model.beam', '5'), ('model.name', '\"small\"')) AS t(setting, value)")
def configuration(spark, sf_dir):
    """A tree from YAML with a second one laid over it."""
    base = config.load(io.StringIO("batch: {size: 3800, words: 4096}\nmodel: {beam: 5, name: base}\nlists: [0]"))
    over = config.load(io.StringIO("batch: {size: 3072}\nmodel: {name: small}\nlists: [1, 2]"))

    def leaves(tree, at=()):
        for k, v in tree.items():
            yield from leaves(v, (*at, k)) if isinstance(v, dict) else [(".".join((*at, k)), json.dumps(v))]

    return spark.createDataFrame(list(leaves(config.merged(base, over))), "setting string, value string")


@query("SELECT row_number() OVER (ORDER BY doc_id) - 1 AS idx, source AS repo, md5(text) AS sha FROM documents")
def binary_lists(spark, sf_dir):
    path = scratch(spark, "binaries")
    sinks.write_lines(table(spark, sf_dir, "documents"), path, F.concat_ws("   ", "source", F.md5("text"), F.lit("ignored")), "doc_id")
    return readers.binary_list(spark, path)


@query("SELECT 'binary' AS kind, count(*) AS n FROM region UNION ALL SELECT 'log', count(*) FILTER (WHERE r_regionkey % 2 = 0) FROM region")
def copied_files(spark, sf_dir):
    """Files of two kinds found by path templates; a kind that lacks some is counted as far as it goes."""
    rows = [(r.r_name, str(r.r_regionkey)) for r in table(spark, sf_dir, "region").collect()]  # a handful of rows
    with tempfile.TemporaryDirectory() as folder:
        templates = {"binary": f"{folder}/{{repo}}/{{sha}}.bin", "log": f"{folder}/{{repo}}/{{sha}}.log"}
        for repo, sha in rows:
            os.makedirs(f"{folder}/{repo}")
            for kind, template in templates.items():
                if kind == "binary" or int(sha) % 2 == 0:
                    with open(files.filled(template, repo=repo, sha=sha), "w") as f:
                        f.write(repo)
        done = files.copy_files(rows, templates, f"{folder}/out")
    return spark.createDataFrame(sorted(done.items()), "kind string, n long")


SPLIT = CORPUS_S["heldout_split"]


@query(f"SELECT s.split, md5(d.text) AS text_md5, count(*) AS n FROM ({SPLIT}) s JOIN documents d USING (doc_id) GROUP BY ALL")
def split_files(spark, sf_dir):
    """A folder of lines a split."""
    path = scratch(spark, "splits")
    rows = heldout_split(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    sinks.write_splits(rows, path, F.md5("text"), "doc_id")
    return spark.read.text(path).groupBy("split", F.col("value").alias("text_md5")).agg(F.count("*").alias("n"))


@query(SPLIT)
def split_index_files(spark, sf_dir):
    path = scratch(spark, "split-index")
    sinks.write_split_index(heldout_split(spark, sf_dir), path, "doc_id")
    return spark.read.parquet(path).select("doc_id", "split")


@query("SELECT row_number() OVER (ORDER BY source) - 1 AS idx, source AS value FROM (SELECT DISTINCT source FROM documents)")
def repository_list(spark, sf_dir):
    path = scratch(spark, "repositories")
    sinks.write_lines(table(spark, sf_dir, "documents").select("source").distinct(), path, F.col("source"), "source")
    return readers.lines(spark, path)


@query(f"WITH {NUMBERED} SELECT place AS idx, md5(s) AS src_md5, md5(t) AS tgt_md5 FROM num")
def token_pair_files(spark, sf_dir):
    """Tokenised pairs, read with the token separator kept visible."""
    path = scratch(spark, "token-pairs")
    sinks.write_token_pairs(conversation_pairs(spark, sf_dir), path, words("src"), words("tgt"), "idx")
    parts = F.split("value", text.TUPLE, -1)
    return readers.lines(spark, path).select("idx", F.get(parts, F.lit(0)).alias("s"), F.get(parts, F.lit(1)).alias("t")).select("idx", md5_of("s", "src_md5"), md5_of("t", "tgt_md5"))


@query(
    f"""WITH {PAIRS}, y AS (SELECT array_to_string(list_transform({sql_words('src')}, lambda w: CASE WHEN w = 'the' THEN 'v1 word' WHEN w = 'a' THEN 'v2 one' ELSE w END), ' ') AS l FROM pairs
    UNION ALL SELECT {joined('tgt', ' ')} FROM pairs) SELECT md5(l) AS line_md5, count(*) AS n FROM y WHERE l <> '' GROUP BY l"""
)
def training_text(spark, sf_dir):
    """Two lines a pair for a subword model, the source with both names of its variables."""
    path = scratch(spark, "training-text")
    pairs = conversation_pairs(spark, sf_dir).select(words("src").alias("s"), words("tgt").alias("t"), names().alias("n"))
    sinks.write_lines(sinks.training_lines(pairs, F.col("s"), F.col("t"), F.col("n")), path, F.col("value"))
    return readers.lines(spark, path).groupBy(F.md5("value").alias("line_md5")).agg(F.count("*").alias("n"))


TOKEN_COUNTS = f"tok AS (SELECT unnest({sql_words('text')}) AS word FROM documents), cnt AS (SELECT word, count(*) AS n FROM tok GROUP BY word)"


def drawn_sql(good: str, bad: str, draws: str, u: str) -> str:
    """The hypergeometric distribution inverted at ``u``."""
    choose = lambda n, k: f"(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - ({k}) + 1))"
    chance = f"exp({choose(good, 'q')} + {choose(bad, f'({draws} - q)')} - {choose(f'({good} + {bad})', draws)})"
    low = f"greatest(0, {draws} - {bad})"
    high = f"least({good}, {draws}, {low} + CAST({draws} * {good} / ({good} + {bad}) + 12 * sqrt({draws} * {good} / ({good} + {bad})) + 60 AS BIGINT))"
    return f"({low} + len(list_filter(list_transform(range({low}, {high} + 1), lambda k: list_sum(list_transform(range({low}, k + 1), lambda q: {chance}))), lambda c: c <= {u})))"


NUMBER = "CAST('0x' || md5(concat({0}, ':', " + str(SEED) + "))[1:13] AS BIGINT) / 4503599627370496.0"
BAG = f"""{TOKEN_COUNTS}, bag AS (SELECT word, n, md5(concat('=', word, ':', {SEED})) AS dg FROM cnt), sums AS (SELECT dg[1:2] AS bucket, CAST(sum(n) AS BIGINT) AS n FROM bag GROUP BY ALL),
  b AS (SELECT bucket, n, {NUMBER.format('bucket')} AS u, row_number() OVER (ORDER BY bucket) AS r FROM sums),
  bd AS (SELECT 0 AS r, '' AS bucket, 0 AS got, CAST(sum(n) AS BIGINT) AS rest, CAST(least(1000, sum(n)) AS BIGINT) AS draws FROM b
    UNION ALL SELECT r, bucket, got, rest - n, draws - got FROM (SELECT b.r, b.bucket, n, rest, draws, {drawn_sql('b.n', '(rest - b.n)', 'draws', 'b.u')} AS got FROM bd JOIN b ON b.r = bd.r + 1)),
  w AS (SELECT dg[1:2] AS bucket, list(struct_pack(word := word, n := n, u := {NUMBER.format('dg')}) ORDER BY dg) AS l FROM bag GROUP BY ALL),
  wd AS (SELECT bucket, l, 0 AS r, '' AS word, 0 AS got, sums.n AS rest, bd.got AS draws FROM bd JOIN sums USING (bucket) JOIN w USING (bucket)
    UNION ALL SELECT bucket, l, r, word, got, rest - n, draws - got FROM (SELECT bucket, l, r, word, n, rest, draws, {drawn_sql('n', '(rest - n)', 'draws', 'u')} AS got
      FROM (SELECT bucket, l, r + 1 AS r, l[r + 1].word AS word, l[r + 1].n AS n, l[r + 1].u AS u, rest, draws FROM wd WHERE draws > 0 AND r < len(l)))),
  drawn AS (SELECT word, got FROM wd)"""


@query(f"WITH RECURSIVE {BAG} SELECT word, CAST(got AS BIGINT) AS n FROM drawn WHERE got > 0")
def weighted_tokens(spark, sf_dir):
    """A thousand words drawn by their counts (the size of the sample is the feature)."""
    drawn = drawing.draw(corpus.word_counts(table(spark, sf_dir, "documents"), words("text")), 1000, SEED)
    return drawn.groupBy("word").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id FROM documents ORDER BY md5(concat(doc_id, ':', {SEED})), doc_id LIMIT 100")
def reservoir_sample(spark, sf_dir):
    return corpus.reservoir(table(spark, sf_dir, "documents").select("doc_id"), 100, SEED, "doc_id")


@query(f"SELECT row_number() OVER (ORDER BY md5(concat(word, ':', 7)), word) - 1 AS idx, word AS value FROM (SELECT DISTINCT unnest({sql_words('text')}) AS word FROM benchmark)")
def shuffled_tokens(spark, sf_dir):
    """Words in a reproducible shuffle, one a line."""
    path = scratch(spark, "shuffled")
    found = table(spark, sf_dir, "benchmark").select(F.explode(words("text")).alias("word")).distinct()
    sinks.write_sample(found, path, 7, "word")
    return readers.lines(spark, path)


DRAWN = "CAST('0x' || md5({0})[1:13] AS BIGINT)"
GROUPS = "g AS (SELECT source, count(*) AS n FROM documents GROUP BY source)"
REJECTION = f"""{GROUPS}, k AS (SELECT range AS k, 1 + {DRAWN.format(f"concat({SEED}, ':', range)")} % least((SELECT count(*) FROM g), 50) AS m FROM range(0, 3000)),
  d AS (SELECT k, m, source, n, row_number() OVER (PARTITION BY k ORDER BY {DRAWN.format(f"concat(source, ':', {SEED}, ':', k)")}, source) AS r FROM k, g),
  f AS (SELECT min(k) AS k FROM (SELECT k FROM d WHERE r <= m GROUP BY k HAVING sum(n) BETWEEN 0.8 * (SELECT sum(n) // 4 FROM g) AND 1.1 * (SELECT sum(n) // 4 FROM g))),
  held AS (SELECT source FROM d WHERE k = (SELECT k FROM f) AND r <= m)"""


@query(
    f"""WITH {REJECTION}, h AS (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY md5(concat(doc_id, ':', {SEED})), doc_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents WHERE source IN (SELECT source FROM held))
    SELECT doc_id, CASE WHEN r <= floor(n * (2 / 3)) THEN 'train_extra' ELSE 'test' END AS split FROM h"""
)
def group_rejection_sample(spark, sf_dir):
    """Sources drawn until about a quarter of all documents is held out."""
    docs = table(spark, sf_dir, "documents")
    sizes = [(r.source, r["count"]) for r in docs.groupBy("source").count().collect()]  # a row a group
    chosen = corpus.sample_groups(sizes, sum(n for _, n in sizes) // 4, seed=SEED)
    return corpus.split_held_out(docs, "doc_id", "source", chosen, "test", 2 / 3, SEED)


@query(
    f"""WITH RECURSIVE {GROUPS}, o AS (SELECT source, n, row_number() OVER (ORDER BY -ln(({DRAWN.format(f"concat(source, ':', {SEED})")} + 1) / 4503599627370496.0) / n, source) AS r FROM g),
    w AS (SELECT 0 AS r, CAST(0 AS BIGINT) AS used, '' AS took UNION ALL SELECT o.r, CAST(CASE WHEN used + n <= 300 THEN used + n ELSE used END AS BIGINT), CASE WHEN used + n <= 300 THEN source ELSE '' END FROM w JOIN o ON o.r = w.r + 1)
    SELECT took AS source FROM w WHERE took <> ''"""
)
def sized_sets(spark, sf_dir):
    """Sources drawn by size while they fit into 300 rows."""
    sizes = [(r.source, r["count"]) for r in table(spark, sf_dir, "documents").groupBy("source").count().collect()]  # a row a group
    return spark.createDataFrame([(s,) for s in corpus.sample_sets(sizes, 300, SEED)], "source string")


@query(
    """WITH t AS (SELECT text, min(doc_id) AS o FROM documents GROUP BY text), c AS (SELECT text, arg_max(item_id, item_id) AS item_id FROM benchmark GROUP BY text)
    SELECT row_number() OVER (ORDER BY t.o NULLS LAST, c.item_id) - 1 AS idx, md5(c.text) AS value FROM c LEFT JOIN t ON c.text = t.text"""
)
def merged_lines(spark, sf_dir):
    """Canonical rows in the order of what asked for them, then the leftovers."""
    path = scratch(spark, "merged")
    found = corpus.canonical_join(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "text", "doc_id", "item_id")
    sinks.write_merged(found, path, F.md5("text"), "text_order", "item_id")
    return readers.lines(spark, path)


@query(
    """WITH c AS (SELECT r_name AS name, CAST(count(*) AS VARCHAR) AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name), w AS (SELECT CAST(greatest(6, max(length(name))) AS INTEGER) AS a, CAST(greatest(7, max(length(n))) AS INTEGER) AS b FROM c)
    SELECT 0 AS idx, '| ' || rpad('Region', a, ' ') || ' | ' || lpad('Nations', b, ' ') || ' |' AS line FROM w UNION ALL SELECT 1, '| ' || repeat('-', a) || ' | ' || repeat('-', b - 1) || ': |' FROM w
    UNION ALL SELECT 1 + row_number() OVER (ORDER BY name), '| ' || rpad(name, a, ' ') || ' | ' || lpad(n, b, ' ') || ' |' FROM c, w"""
)
def markdown_report(spark, sf_dir):
    """A small result as a Markdown table, one line a row."""
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").count()
    rows = [[r.r_name, str(r["count"])] for r in nations.orderBy("r_name").collect()]  # a handful of rows
    lines = formatting.markdown_table([["Region", "Nations"], *rows], ["left", "right"]).split("\n")
    return spark.createDataFrame(list(enumerate(lines)), "idx long, line string")


@query(
    """WITH p AS (SELECT source, CAST(sum(quality) AS BIGINT) AS c, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY source)
    SELECT source, c || ' / ' || n AS portion, printf('%.4f', c / n) AS share, 'P: ' || c || ' / ' || (c + n) || ', R: ' || c || ' / ' || (c + 1) AS confusion, printf('%.2f', n * 1.5) AS fixed, CAST(n AS VARCHAR) AS plain FROM p"""
)
def metric_values(spark, sf_dir):
    """Portions, confusions and numbers as a report shows them, by source."""
    joined_rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    rows = joined_rows.groupBy("source").agg(F.sum("quality").alias("c"), F.count("*").alias("n")).collect()  # a row a source
    shown = formatting.metric_value
    portion = lambda r: {"correct": float(r.c), "total": r.n}
    out = [(r.source, shown("portion", portion(r)), shown("portion", portion(r), 4), shown("confusion_mat", {"tp": r.c, "fp": r.n, "fn": 1}), shown("float", r.n * 1.5, 2), shown("int", r.n)) for r in rows]
    return spark.createDataFrame(out, "source string, portion string, share string, confusion string, fixed string, plain string")


@query("SELECT p_partkey, regexp_replace(translate(lower(p_name), '_ ', '--'), '[^a-z0-9-]', '', 'g') AS anchor, '   ' || p_type AS shown FROM part")
def markdown_anchors(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.markdown_id(F.col("p_name")).alias("anchor"), text.indented(F.col("p_type"), 3).alias("shown"))


@query("SELECT CAST(least(floor(n_chars / (SELECT max(n_chars) FROM documents) * 70), 69) AS INTEGER) AS bin, count(*) AS n FROM documents GROUP BY ALL")
def score_histogram(spark, sf_dir):
    """Lengths as shares of the longest, in seventy bins."""
    docs = table(spark, sf_dir, "documents")
    longest = docs.agg(F.max("n_chars")).scalar()
    return overlap.histogram(docs.select((F.col("n_chars") / longest).alias("overlap")))


@query(EVALUATION_S["bleu_corpus_4"])
def file_bleu(spark, sf_dir):
    """References and hypotheses in files, scored after reading both."""
    path = scratch(spark, "references")
    sinks.write_reference_pairs(conversation_pairs(spark, sf_dir), path, tokens("src", " "), tokens("tgt", " "), "idx")
    return bleu.of_files(spark, path, 4).select(F.round("bleu", 6).alias("bleu"))


RUNNING = ", ".join(f"sum(m{n}) OVER o AS m{n}, sum(p{n}) OVER o AS p{n}" for n in range(1, 5))


@query(f"WITH {bleu_sql(4)}, run AS (SELECT idx, sum(h) OVER o AS h, sum(r) OVER o AS r, {RUNNING} FROM k WINDOW o AS (PARTITION BY idx // 42949672960 ORDER BY idx)) SELECT idx, round({score_sql(4, False)}, 6) AS bleu FROM run")
def running_bleu(spark, sf_dir):
    """The score so far after each pair, begun anew every ten conversations."""
    counted = conversation_pairs(spark, sf_dir).select("idx", F.expr("idx DIV 42949672960").alias("pass"), bleu.count_column(4)(words("tgt"), words("src")).alias("c"))
    return bleu.running(counted, "c", 4, "idx", "pass").select("idx", F.round("bleu", 6).alias("bleu"))


@query(f"WITH {bleu_sql(4)}, run AS (SELECT idx, sum(h) OVER o AS h, sum(r) OVER o AS r, {RUNNING} FROM k WINDOW o AS (ORDER BY idx)) SELECT idx, round({score_sql(4, False)}, 6) AS bleu FROM run")
def running_bleu_whole(spark, sf_dir):
    """The score so far after each pair, over all pairs in one order."""
    counted = conversation_pairs(spark, sf_dir).select("idx", bleu.count_column(4)(words("tgt"), words("src")).alias("c"))
    return bleu.running(counted, "c", 4, "idx").select("idx", F.round("bleu", 6).alias("bleu"))


@query("SELECT w.o AS ordinal, n.n_nationkey, n.n_name FROM (VALUES (0, 7), (1, 3), (2, 3), (3, 24)) AS w(o, k) JOIN nation n ON n.n_nationkey = w.k")
def gathered_rows(spark, sf_dir):
    """Rows by key in the order asked for, one of them twice."""
    return compare.gather(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey", [7, 3, 3, 24])


@query(f"WITH {PAIRS}, n AS (SELECT idx, length(src) - length(replace(src, ' ', '')) + 1 AS a, length(tgt) - length(replace(tgt, ' ', '')) + 1 AS b FROM pairs) SELECT idx FROM n WHERE a <= 60 AND b <= 60 AND a / b BETWEEN 0.5 AND 3.0")
def separator_count_filter(spark, sf_dir):
    return conversation_pairs(spark, sf_dir).where(text.fits_by_separators(F.col("src"), F.col("tgt"), " ", 60)).select("idx")


@query(f"WITH {PAIRS}, i AS (SELECT idx, {sql_words('tgt')} AS w, list_transform({sql_words('tgt')}, lambda x: length(x)) AS l FROM pairs) SELECT idx, array_to_string(CASE WHEN list_position(l, 9) > 0 THEN w[1:list_position(l, 9) - 1] ELSE w END, ' ') AS sentence FROM i")
def ids_to_sentence(spark, sf_dir):
    """Words up to the first one of nine letters, which stands for the end id."""
    ids = F.transform(words("tgt"), lambda x: F.length(x))
    rows = conversation_pairs(spark, sf_dir).select("idx", words("tgt").alias("w"), F.size(text.until_end(ids, 9)).alias("n"))
    return rows.select("idx", F.array_join(F.slice("w", F.lit(1), F.col("n")), " ").alias("sentence"))


TYPE = "list_concat(CASE WHEN p_size % 2 = 0 THEN ['static', 'const'] ELSE ['signed'] END, string_split(lower(p_type), ' '))"


@query(
    f"""WITH t AS (SELECT p_partkey, {TYPE} AS t, string_split(lower(p_type), ' ') AS plain FROM part)
    SELECT p_partkey, array_to_string(list_filter(t, lambda x: x NOT IN ('signed', 'const', 'volatile', 'static', 'auto', 'register', 'extern', 'restrict')), ' ') AS loose, array_to_string(list_filter(t, lambda x: x NOT IN ('signed', 'static', 'auto', 'register', 'extern', 'restrict')), ' ') AS strict,
    true AS same_loose, NOT list_contains(t, 'const') AS same_strict FROM t"""
)
def type_tests(spark, sf_dir):
    """Types with and without qualifiers that don't count, and whether they agree with the bare type."""
    bare = F.split(F.lower("p_type"), " ")
    kind = F.concat(F.when(F.col("p_size") % 2 == 0, F.array(F.lit("static"), F.lit("const"))).otherwise(F.array(F.lit("signed"))), bare)
    loose, strict = text.normalised_type(kind), text.normalised_type(kind, cv=True)
    return table(spark, sf_dir, "part").select("p_partkey", loose.alias("loose"), strict.alias("strict"), (loose == text.normalised_type(bare)).alias("same_loose"), (strict == text.normalised_type(bare, cv=True)).alias("same_strict"))


LOOKUP = {"the": 10, "a": 11, "of": 12, "and": 13}
IDS = "list_append(list_transform({0}, lambda w: coalesce(" + "map {{" + ", ".join(f"'{k}': {v}" for k, v in LOOKUP.items()) + "}}[w], 1)), 3)"


@query(f"WITH {PAIRS}, w AS (SELECT idx, {sql_words('src')} AS s, {sql_words('tgt')} AS t FROM pairs) SELECT idx, array_to_string({IDS.format('s')}, ' ') AS src_ids, array_to_string({IDS.format('t')}, ' ') AS tgt_ids FROM w WHERE len(s) + 1 <= 200 AND len(t) + 1 <= 200 AND len(t) > 0 AND len(s) / len(t) BETWEEN 0.5 AND 3.0")
def example_ids(spark, sf_dir):
    """Pairs to bounded and ended ids."""
    pairs = conversation_pairs(spark, sf_dir).select("idx", words("src").alias("src_tokens"), words("tgt").alias("tgt_tokens"))
    out = feeding.process(pairs, vocab=LOOKUP, end_id=3, max_src=200, max_tgt=200)
    line = lambda c: F.array_join(F.col(c).cast("array<string>"), " ").alias(c)
    return out.select("idx", line("src_ids"), line("tgt_ids"))


@query("SELECT source, count(*) AS n, 1 AS built FROM documents GROUP BY source")
def memoised_stage(spark, sf_dir):
    """A table asked for twice is built once."""
    path, built = scratch(spark, "memoised"), []

    def build():
        built.append(1)
        return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))

    files.memoised(spark, path, build)
    return files.memoised(spark, path, build).withColumn("built", F.lit(len(built)))


@query(f"SELECT split, count(*) AS n FROM ({SPLIT}) WHERE split = 'test' GROUP BY split")
def first_split(spark, sf_dir):
    """Of the splits named for validation only the first one is used."""
    return feeding.first_split(heldout_split(spark, sf_dir), ["test", "train_extra"]).groupBy("split").agg(F.count("*").alias("n"))


@query(f"WITH {PAIRS}, n AS (SELECT row_number() OVER (ORDER BY idx) - 1 AS place, idx FROM pairs) SELECT place, idx FROM n WHERE (place + 1) % 25 = 0")
def sample_outputs(spark, sf_dir):
    """Every 25th pair in order, as shown while a model is evaluated (the step is the feature)."""
    return feeding.every(conversation_pairs(spark, sf_dir).select("idx"), [F.col("idx")], 25)



GREEN = "chr(27) || '[92m' || {0} || chr(27) || '[0m'"
COLOURED = f"array_to_string(list_transform({sql_words('src')}, lambda w: {GREEN.format('w')}), ' ')"


@query(
    f"""WITH {PAIRS} SELECT idx AS "index", CAST(idx AS DOUBLE) AS score, 'source: ' || {joined('src', ' ')} || chr(10) || 'target: ' || {COLOURED} || chr(10) || 'hypothesis: ' || {COLOURED} || ' ' || chr(27) || '[91m<odd>' || chr(27) || '[0m' || chr(10) AS block
    FROM pairs WHERE len({sql_words('src')}) > 0"""
)
def annotated_report(spark, sf_dir):
    """Kept words in one colour, the one word that the other side doesn't know in another."""
    said = conversation_pairs(spark, sf_dir).where(F.size(words("src")) > 0).select("idx", tokens("src", " ").alias("s"), F.col("idx").cast("double").alias("score"))
    return sinks.annotated(said.withColumn("h", F.concat("s", F.lit(" <odd>"))), "s", "s", "h", "score", "idx")


@query("SELECT doc_id, hex(encode(lang)) AS key_hex, source AS value FROM documents")
def binary_map_keys(spark, sf_dir):
    """Maps with their keys as bytes."""
    found = table(spark, sf_dir, "documents").select("doc_id", text.binary_keys(F.create_map("lang", "source")).alias("m"))
    return found.select("doc_id", F.explode("m").alias("k", "value")).select("doc_id", F.hex("k").alias("key_hex"), "value")


@query("SELECT source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY source")
def cached_source(spark, sf_dir):
    """A source that is read once and kept where it is read; what doesn't fit goes to disk."""
    docs = feeding.cached(table(spark, sf_dir, "documents").select("source", "n_chars"))
    return docs.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
