"""Queries on corpus building, with the same computation in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import schedules, text
from seqloom.operators import batching, corpus, feeding, overlap, subwords
from seqloom.operators.neighbours import Index

SEED, SPACE = 19260817, text.ASCII_SPACE
RE = r"[ \t\n\r\f]+"
WORDS = f"list_filter(regexp_split_to_array({{0}}, '{RE}'), lambda x: x <> '')"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(c: str):
    return text.words(F.col(c), SPACE)


def conversation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with the assistant's next turn: ``idx, src, tgt``, the index the conversation above 32 bits of the turn."""
    turns = table(spark, sf_dir, "conversations")
    ask = turns.where("role = 'user'").select("conv_id", F.col("turn").alias("t"), F.col("text").alias("src"))
    reply = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("t"), F.col("text").alias("tgt"))
    return ask.join(reply, ["conv_id", "t"]).select((F.col("conv_id") * 4294967296 + F.col("t")).alias("idx"), "src", "tgt")


PAIRS = """pairs AS (SELECT a.conv_id * 4294967296 + a.turn AS idx, a.text AS src, b.text AS tgt FROM conversations a JOIN conversations b
  ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant')"""
TOKENS = f"tok AS (SELECT doc_id, unnest({WORDS.format('text')}) AS word FROM documents)"
COUNTS = f"{TOKENS}, cnt AS (SELECT word, count(*) AS n FROM tok GROUP BY word), sur AS (SELECT word, n, -ln(n / (SELECT sum(n) FROM cnt)) AS s FROM cnt)"
Q: dict = {}
S: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        Q[f.__name__] = f
        if sql:
            S[f.__name__] = sql
        return f

    return register


@query(f"WITH {COUNTS} SELECT d.doc_id, round(coalesce(x.s, 0), 4) AS score FROM documents d LEFT JOIN (SELECT doc_id, sum(s) AS s FROM tok JOIN sur USING (word) GROUP BY doc_id) x USING (doc_id)")
def difficulty_ranking(spark, sf_dir):
    """Documents from easy to hard: the sum of their words' surprisals."""
    docs = table(spark, sf_dir, "documents")
    scores = corpus.surprisal(corpus.word_counts(docs, words("text")))
    return corpus.difficulty(docs, "doc_id", words("text"), scores).select("doc_id", F.round("score", 4).alias("score")).orderBy("score", "doc_id")


@query(f"WITH {COUNTS} SELECT word, n AS count FROM cnt")
def word_counts(spark, sf_dir):
    return corpus.word_counts(table(spark, sf_dir, "documents"), words("text"))


@query(f"WITH {COUNTS} SELECT word, round(s, 6) AS surprisal FROM sur")
def surprisal_table(spark, sf_dir):
    return corpus.surprisal(corpus.word_counts(table(spark, sf_dir, "documents"), words("text"))).select("word", F.round("surprisal", 6).alias("surprisal"))


@query(
    f"""SELECT doc_id, len(flat) AS n_tokens, md5(array_to_string(flat, ' ')) AS tokens_md5 FROM (SELECT doc_id, flatten(list_transform(regexp_split_to_array(text, ' '),
    lambda t: CASE WHEN starts_with(t, '"') THEN list_concat(['"'], list_filter(regexp_split_to_array(CASE WHEN length(t) < 3 THEN '' ELSE substr(t, 2, length(t) - 2) END, '{RE}'), lambda x: x <> ''), ['"']) ELSE [t] END)) AS flat FROM documents)"""
)
def literal_aware_tokens(spark, sf_dir):
    flat = text.literal_aware(F.split("text", " "), SPACE)
    return table(spark, sf_dir, "documents").select("doc_id", flat.alias("f")).select("doc_id", F.size("f").cast("long").alias("n_tokens"), F.md5(F.array_join("f", " ")).alias("tokens_md5"))


@query("SELECT doc_id, text FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id NULLS LAST) = 1")
def dedup_first(spark, sf_dir):
    return corpus.first_of_each(table(spark, sf_dir, "documents"), "text", "doc_id").select("doc_id", "text")


@query("SELECT count(*) AS kept, CAST(sum(n - 1) AS BIGINT) AS duplicates FROM (SELECT count(*) AS n FROM documents GROUP BY text)")
def dedup_counts(spark, sf_dir):
    return corpus.dedup_counts(table(spark, sf_dir, "documents").select("text"), "text")


@query(f"WITH {PAIRS} SELECT idx, src, tgt FROM pairs")
def pair_build(spark, sf_dir):
    return conversation_pairs(spark, sf_dir)


@query(f"WITH {PAIRS}, w AS (SELECT idx, len({WORDS.format('src')}) AS a, len({WORDS.format('tgt')}) AS b FROM pairs) SELECT idx, a AS src_len, b AS tgt_len FROM w WHERE a + 1 <= 512 AND b + 1 <= 512 AND b > 0 AND a / b BETWEEN 0.5 AND 3.0")
def length_ratio_filter(spark, sf_dir):
    tokens = conversation_pairs(spark, sf_dir).select("idx", words("src").alias("s"), words("tgt").alias("t"))
    return feeding.length_mode(tokens, "s", "t", "discard", 512, 512).select("idx", F.size("s").cast("long").alias("src_len"), F.size("t").cast("long").alias("tgt_len"))


@query(f"WITH {PAIRS} SELECT idx, array_to_string(({WORDS.format('src')})[1:31], ' ') AS src, array_to_string(({WORDS.format('tgt')})[1:31], ' ') AS tgt FROM pairs")
def length_filter_truncate(spark, sf_dir):
    tokens = conversation_pairs(spark, sf_dir).select("idx", words("src").alias("s"), words("tgt").alias("t"))
    return feeding.length_mode(tokens, "s", "t", "truncate", 32, 32).select("idx", F.array_join("s", " ").alias("src"), F.array_join("t", " ").alias("tgt"))


@query("SELECT source, count(*) AS n FROM documents GROUP BY source")
def group_sizes(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT doc_id, source FROM documents WHERE source IN (SELECT source FROM documents GROUP BY source HAVING count(*) >= 45)")
def min_group_filter(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.join(docs.groupBy("source").count().where("count >= 45"), "source", "left_semi").select("doc_id", "source")


HELD = ["src3", "src7", "src11"]


@query(
    f"""WITH h AS (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY md5(concat(doc_id, ':', {SEED})), doc_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents WHERE source IN ('src3', 'src7', 'src11'))
    SELECT doc_id, CASE WHEN r <= floor(n * (2 / 3)) THEN 'train_extra' ELSE 'test' END AS split FROM h UNION ALL SELECT doc_id, 'train' AS split FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM h)"""
)
def heldout_split(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return corpus.with_training(docs, "doc_id", corpus.split_held_out(docs, "doc_id", "source", HELD, "test", 2 / 3, SEED))


@query(
    f"""WITH h AS (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY md5(concat(doc_id, ':', {SEED})), doc_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents WHERE source IN ('src3', 'src7', 'src11'))
    SELECT split, count(*) AS n FROM (SELECT CASE WHEN r <= floor(n * (2 / 3)) THEN 'train_extra' ELSE 'test' END AS split FROM h UNION ALL SELECT 'train' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM h)) GROUP BY split"""
)
def split_sizes(spark, sf_dir):
    return heldout_split(spark, sf_dir).groupBy("split").agg(F.count("*").alias("n"))


@query(
    f"""WITH {COUNTS}, sc AS (SELECT d.doc_id, round(coalesce(x.s, 0), 4) AS score FROM documents d LEFT JOIN (SELECT doc_id, sum(s) AS s FROM tok JOIN sur USING (word) GROUP BY doc_id) x USING (doc_id)),
    r AS (SELECT doc_id, score, row_number() OVER (ORDER BY score, doc_id) AS rn, count(*) OVER () AS n FROM sc)
    SELECT doc_id, score FROM r WHERE rn <= floor(least(1.0, sqrt((1 - 0.01 ** 2) * 5000 / 20000 + 0.01 ** 2)) * n)"""
)
def curriculum_prefix(spark, sf_dir):
    """What is in use at step 5000 of a curriculum of 20000."""
    scored = difficulty_ranking(spark, sf_dir)
    n = table(spark, sf_dir, "documents").count()
    size = spark.range(1).select(schedules.prefix_size(F.lit(5000), F.lit(n))).first()[0]
    return corpus.prefix(scored, "doc_id", size)


STEPS = "SELECT range AS step FROM range(0, 64001, 500)"


def _schedule(column):
    return lambda spark, sf_dir: spark.range(0, 64001, 500).select(F.col("id").alias("step"), F.round(column(F.col("id")), 9).alias("lr"))


for _name, _column, _sql in (
    ("static", lambda s: schedules.static(s, 16000), "CASE WHEN step < 16000 THEN step / 16000 ELSE 1.0 END"),
    ("invsqrt", lambda s: schedules.inverse_root(s, 16000), "least(1.0, step / 16000) * (1 / sqrt(greatest(step, 16000)))"),
    ("exponential", lambda s: schedules.exponential(s, 16000, 0.99, 2000), "CASE WHEN step < 16000 THEN step / 16000 ELSE pow(0.99, (step - 16000) // 2000) END"),
    ("cosine", lambda s: schedules.cosine(s, 16000, 40000, 0.05), "CASE WHEN step < 16000 THEN step / 16000 ELSE 0.05 + 0.95 * (0.5 * (1.0 + cos(pi() * (((step - 16000) / 24000) % 1.0)))) END"),
):
    Q[f"lr_schedule_{_name}"] = _schedule(_column)
    S[f"lr_schedule_{_name}"] = f"SELECT step, round({_sql}, 9) AS lr FROM ({STEPS})"


@query(
    """WITH t AS (SELECT text, min(doc_id) AS text_order FROM documents GROUP BY text), c AS (SELECT text, arg_max(item_id, item_id) AS item_id FROM benchmark GROUP BY text)
    SELECT c.item_id, c.text, t.text_order FROM c LEFT JOIN t ON c.text = t.text"""
)
def canonical_join(spark, sf_dir):
    """Benchmark items in the order in which documents ask for them, then the rest."""
    joined = corpus.canonical_join(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "text", "doc_id", "item_id")
    return joined.select("item_id", "text", "text_order").orderBy(F.asc_nulls_last("text_order"), "item_id")


#: Whole lines: those of the documents as texts, numbered by document and place, and those of the conversations as canonical side.
LINES = """b AS (SELECT doc_id * 4294967296 + i - 1 AS place, t[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS t, unnest(range(1, len(t) + 1)) AS i FROM documents) WHERE t[i] <> ''),
  c AS (SELECT DISTINCT unnest(string_split(text, chr(10))) AS line FROM conversations), f AS (SELECT line, min(place) AS place FROM b GROUP BY line), u AS (SELECT * FROM b WHERE place NOT IN (SELECT f.place FROM f JOIN c ON f.line = c.line))"""


def _unmatched_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).where("line <> ''")
    canon = table(spark, sf_dir, "conversations").select(F.explode(F.split("text", "\n")).alias("line"))
    return corpus.canonical_unmatched(lines.select((F.col("doc_id") * 4294967296 + F.col("i")).alias("place"), "line"), canon, "line", "place")


@query(f"WITH {LINES} SELECT place, line FROM u")
def canonical_unmatched(spark, sf_dir):
    """Lines without a canonical one left for them: of equal lines only the first finds its canonical line."""
    return _unmatched_lines(spark, sf_dir)


@query("SELECT count(*) AS leftover FROM (SELECT DISTINCT text FROM benchmark) WHERE text NOT IN (SELECT text FROM documents)")
def canonical_leftover(spark, sf_dir):
    return canonical_join(spark, sf_dir).where("text_order IS NULL").agg(F.count("*").alias("leftover"))


@query(f"WITH {LINES} SELECT count(*) AS not_found, count(DISTINCT line) AS distinct_keys FROM u")
def canonical_counts(spark, sf_dir):
    """How many lines found nothing, and how many different ones."""
    return _unmatched_lines(spark, sf_dir).agg(F.count("*").alias("not_found"), F.count_distinct("line").alias("distinct_keys"))


@query("SELECT word, CAST(sum(n) AS BIGINT) AS count FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS word, 1 AS n FROM benchmark UNION ALL SELECT unnest(regexp_split_to_array(lower(text), '[^a-z]+')), 1 FROM documents) WHERE word <> '' GROUP BY word")
def counter_union(spark, sf_dir):
    """Counters of two tables merged."""
    count = lambda t: corpus.word_counts(table(spark, sf_dir, t), F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: x != ""))
    return count("documents").unionByName(count("benchmark")).groupBy("word").agg(F.sum("count").alias("count"))


VOCAB = f"""{COUNTS}, v AS (SELECT word AS token, 3 + row_number() OVER (ORDER BY n DESC, word) AS id FROM cnt WHERE word NOT IN ('<pad>', '<unk>', '<s>', '</s>') QUALIFY id < 10000
  UNION ALL SELECT * FROM (VALUES ('<pad>', 0), ('<unk>', 1), ('<s>', 2), ('</s>', 3)) AS s(token, id))"""


def _vocab(spark, sf_dir):
    return corpus.vocabulary(corpus.word_counts(table(spark, sf_dir, "documents"), words("text")), 10000)


@query(f"WITH {VOCAB} SELECT token, CAST(id AS INTEGER) AS id FROM v")
def vocab_build(spark, sf_dir):
    return _vocab(spark, sf_dir)


@query(
    f"""WITH {VOCAB}, p AS (SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS token FROM (SELECT doc_id, {WORDS.format('text')} AS w FROM documents))
    SELECT d.doc_id, coalesce(x.n, 0) AS n_ids, md5(coalesce(x.s, '')) AS ids_md5 FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n, string_agg(coalesce(v.id, 1), ' ' ORDER BY i) AS s FROM p LEFT JOIN v USING (token) GROUP BY doc_id) x USING (doc_id)"""
)
def token_ids(spark, sf_dir):
    ids = corpus.token_ids(table(spark, sf_dir, "documents"), "doc_id", words("text"), _vocab(spark, sf_dir))
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.md5(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_md5"))


@query(
    f"""WITH {VOCAB}, p AS (SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS token FROM (SELECT doc_id, {WORDS.format('text')} AS w FROM documents))
    SELECT d.doc_id, md5(coalesce(x.s, '')) AS text_md5 FROM documents d LEFT JOIN (SELECT doc_id, string_agg(CASE WHEN v.id IS NULL THEN '<unk>' ELSE p.token END, ' ' ORDER BY i) AS s FROM p LEFT JOIN v USING (token) GROUP BY doc_id) x USING (doc_id)"""
)
def ids_to_tokens(spark, sf_dir):
    vocab = _vocab(spark, sf_dir)
    ids = corpus.token_ids(table(spark, sf_dir, "documents"), "doc_id", words("text"), vocab)
    return corpus.tokens_of(ids, "doc_id", vocab).select("doc_id", F.md5(F.array_join("tokens", " ")).alias("text_md5"))


@query(f"WITH {PAIRS} SELECT idx, md5(src) AS src_md5, md5(tgt) AS tgt_md5, CAST(0.5 AS DOUBLE) AS score, 'b' AS orig_of_a FROM pairs")
def record_encode_decode(spark, sf_dir):
    """Pairs through the encoded line and back."""
    names = F.from_json(F.lit('{"a": {"decomp": "v1", "orig": "b"}}'), "map<string,struct<decomp:string,orig:string>>")
    line = text.encode_record(F.col("src"), F.col("tgt"), names, F.lit(0.5), F.lit("r"), F.lit("s"))
    back = conversation_pairs(spark, sf_dir).select("idx", text.decode_record(line).alias("r"))
    return back.select("idx", F.md5("r.src").alias("src_md5"), F.md5("r.tgt").alias("tgt_md5"), "r.score", F.col("r.var_names")["a"]["orig"].alias("orig_of_a"))


def _inline(spark, rows: str, columns: str):
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t({columns})")


@query("SELECT * FROM (VALUES (1, 'ab|c'), (2, 'a|b'), (3, '|x'), (4, 'a▁b'), (5, '')) AS t(id, words)")
def spm_decode(spark, sf_dir):
    rows = _inline(spark, "(1, array('▁a', 'b', '▁c')), (2, array('a', '▁b')), (3, array('▁', '▁x')), (4, array('▁a▁b')), (5, cast(array() as array<string>))", "id, p")
    return rows.select("id", F.array_join(text.decode_pieces(F.col("p")), "|").alias("words"))


@query("SELECT * FROM (VALUES (1, 'abc|d'), (2, 'ab'), (3, '')) AS t(id, words)")
def bpe_decode(spark, sf_dir):
    rows = _inline(spark, "(1, array('ab@@', 'c', 'd')), (2, array('ab@@')), (3, cast(array() as array<string>))", "id, p")
    return rows.select("id", F.array_join(text.decode_bpe(F.col("p")), "|").alias("words"))


NAMES = "map('v1', named_struct('decomp', 'd1', 'orig', 'count'), 'v2', named_struct('decomp', 'd2', 'orig', 'buf'))"


@query("SELECT 'd1 = d2 + x' AS decomp, 'count = buf + x' AS orig, 'd1 count = d2 buf + x' AS \"both\"")
def var_substitution(spark, sf_dir):
    row = spark.sql(f"SELECT split('v1 = v2 + x', ' ') AS t, {NAMES} AS n")
    each = lambda w: F.array_join(text.substitute_names(F.col("t"), F.col("n"), w), " ").alias(w)
    return row.select(each("decomp"), each("orig"), F.array_join(text.both_names(F.col("t"), F.col("n")), " ").alias("both"))


@query("SELECT replace(replace('v1 = v2 + v10', 'v1', 'count'), 'v2', 'buf') AS replaced")
def substring_replace(spark, sf_dir):
    return spark.sql(f"SELECT 'v1 = v2 + v10' AS t, {NAMES} AS n").select(text.replace_by_map(F.col("t"), F.col("n")).alias("replaced"))


@query(
    f"""WITH {PAIRS}, l AS (SELECT idx, list_transform({WORDS.format('tgt')}, lambda x: length(x)) AS t FROM pairs), m AS (SELECT idx, t, max(len(t)) OVER (PARTITION BY idx // 42949672960) AS w FROM l)
    SELECT idx, len(t) AS target_length, array_to_string(list_concat(t, list_transform(range(w - len(t)), lambda x: 3)), ' ') AS target_output, array_to_string(list_concat([2], list_concat(t, list_transform(range(w - len(t)), lambda x: 3))[1:w - 1]), ' ') AS target_input FROM m"""
)
def pad_shift(spark, sf_dir):
    """Targets padded to their batch's width and shifted by the start id; a token's id is its length here."""
    ids = F.transform(words("tgt"), lambda x: F.length(x))
    rows = conversation_pairs(spark, sf_dir).select("idx", F.expr("idx DIV 42949672960").alias("batch_id"), F.transform(words("src"), lambda x: F.length(x)).alias("src_ids"), ids.alias("tgt_ids"))
    out = feeding.collate(rows, start_id=2, end_id=3)
    line = lambda c: F.array_join(F.col(c).cast("array<string>"), " ").alias(c)
    return out.select("idx", F.col("target_length").cast("long").alias("target_length"), line("target_output"), line("target_input"))


def batches_sql(shard: str) -> str:
    return f"""WITH RECURSIVE o AS (SELECT doc_id, {shard} AS shard, source, len({WORDS.format('text')}) AS n, row_number() OVER (PARTITION BY {shard} ORDER BY doc_id) AS r FROM documents),
    b AS (SELECT shard, source, r, doc_id, n, 0 AS batch_no, 1 AS c, n AS longest FROM o WHERE r = 1 UNION ALL SELECT o.shard, o.source, o.r, o.doc_id, o.n, CASE WHEN (c + 1) * greatest(longest, o.n) > 4096 THEN batch_no + 1 ELSE batch_no END,
      CASE WHEN (c + 1) * greatest(longest, o.n) > 4096 THEN 1 ELSE c + 1 END, CASE WHEN (c + 1) * greatest(longest, o.n) > 4096 THEN o.n ELSE greatest(longest, o.n) END FROM b JOIN o ON o.shard = b.shard AND o.r = b.r + 1)
    SELECT doc_id, source, n, CAST(batch_no AS BIGINT) AS batch_no FROM b"""


def _measured(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.size(words("text")).cast("long").alias("n"))


@query(batches_sql("source"))
def token_budget_batches(spark, sf_dir):
    """Batches of at most 4096 tokens by source, in order of ids."""
    return batching.budget_batches(_measured(spark, sf_dir), "source", "doc_id", "n", "n", 4096)


@query(batches_sql("0"))
def token_budget_one_shard(spark, sf_dir):
    """All documents as one shard, cut by many tasks."""
    docs = _measured(spark, sf_dir).withColumn("shard", F.lit(0))
    return batching.budget_batches(docs, "shard", "doc_id", "n", "n", 4096).drop("shard")


#: Vocabulary from counts; then of each distinct word the best cut up to each character, from the best ones before it.
PIECES = f"""tok AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS place FROM (SELECT doc_id, {WORDS.format('text')} AS ws FROM documents)),
  cnt AS (SELECT word, '▁' || word AS w, count(*) AS n FROM tok GROUP BY ALL),
  part AS (SELECT w, n, i, unnest(range(1, least(6, length(w) - i + 1) + 1)) AS k FROM (SELECT w, n, unnest(range(1, length(w) + 1)) AS i FROM cnt)),
  summed AS (SELECT substr(w, i, k) AS piece, CAST(sum(n) AS BIGINT) AS n FROM part GROUP BY ALL),
  chosen AS (SELECT * FROM (SELECT * FROM summed WHERE length(piece) > 1 ORDER BY n * length(piece) DESC, piece LIMIT 4000) UNION ALL SELECT * FROM summed WHERE length(piece) = 1),
  vocab AS (SELECT piece, CAST(round(ln(n / (SELECT sum(n) FROM chosen)) * 1000000) AS BIGINT) AS score FROM chosen),
  ways AS (SELECT w, list(c ORDER BY j) AS c FROM (SELECT w, i + k - 1 AS j, list(struct_pack(start := i - 1, score := score) ORDER BY i) AS c FROM part JOIN vocab ON piece = substr(w, i, k) GROUP BY ALL) GROUP BY w),
  best AS (SELECT w, c, 0 AS j, [CAST(0 AS BIGINT)] AS b, CAST([] AS BIGINT[]) AS st FROM ways
    UNION ALL SELECT w, c, j + 1, list_append(b, top), list_append(st, c[j + 1][list_position(sums, top)].start) FROM (SELECT *, list_max(sums) AS top FROM (SELECT *, list_transform(c[j + 1], lambda y: b[y.start + 1] + y.score) AS sums FROM best WHERE j < length(w)))),
  back AS (SELECT w, st, j, CAST([] AS VARCHAR[]) AS cut FROM best WHERE j = length(w) UNION ALL SELECT w, st, st[j], list_prepend(substr(w, st[j] + 1, j - st[j]), cut) FROM back WHERE j > 0),
  done AS (SELECT w, cut FROM back WHERE j = 0)"""


@query(f"WITH RECURSIVE {PIECES} SELECT d.doc_id, CAST(coalesce(sum(len(cut)), 0) AS BIGINT) AS n_pieces, md5(coalesce(string_agg(array_to_string(cut, ' '), ' ' ORDER BY place), '')) AS pieces_md5 FROM documents d LEFT JOIN (tok JOIN done ON w = '▁' || word) USING (doc_id) GROUP BY d.doc_id")
def subword_pieces(spark, sf_dir):
    """Documents' words in the likeliest pieces of a vocabulary of 4000 pieces and all characters, taken from the documents' counts."""
    docs = table(spark, sf_dir, "documents")
    vocab = subwords.piece_vocabulary(corpus.word_counts(docs, words("text")), 4000)
    cut = subwords.cut_words(docs.select("doc_id", "text"), "doc_id", words("text"), vocab)
    return cut.select("doc_id", F.coalesce(F.size("pieces"), F.lit(0)).cast("long").alias("n_pieces"), F.md5(F.coalesce(F.array_join("pieces", " "), F.lit(""))).alias("pieces_md5"))


NEIGHBOURS = """u AS (SELECT text, NULL::BIGINT AS item_id FROM documents UNION ALL SELECT text, item_id FROM benchmark),
  n AS (SELECT item_id, text, last_value(CASE WHEN item_id IS NULL THEN text END IGNORE NULLS) OVER (ORDER BY text, item_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l,
    first_value(CASE WHEN item_id IS NULL THEN text END IGNORE NULLS) OVER (ORDER BY text, item_id NULLS FIRST ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS r FROM u)"""


@query(f"WITH {NEIGHBOURS} SELECT item_id, md5(l) AS left_md5, md5(r) AS right_md5 FROM n WHERE item_id IS NOT NULL")
def overlap_neighbours(spark, sf_dir):
    found = overlap.neighbours(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "text", "item_id")
    return found.select("item_id", F.md5("left_text").alias("left_md5"), F.md5("right_text").alias("right_md5"))


NEAR = """u AS (SELECT text, '' AS id, 0 AS side FROM documents UNION ALL SELECT text, concat('item ', item_id), 1 FROM benchmark UNION ALL SELECT text, concat('turn ', conv_id, ' ', turn), 1 FROM conversations),
  n AS (SELECT id, side, last_value(CASE WHEN side = 0 THEN text END IGNORE NULLS) OVER (ORDER BY text, side ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l,
    first_value(CASE WHEN side = 0 THEN text END IGNORE NULLS) OVER (ORDER BY text, side ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS r FROM u WHERE text IS NOT NULL)"""


@query(f"WITH {NEAR} SELECT id, md5(l) AS left_md5, md5(r) AS right_md5 FROM n WHERE side = 1")
def overlap_two_tables(spark, sf_dir):
    """One index of the documents' texts, asked for two tables with ids that are strings."""
    index = Index.of(table(spark, sf_dir, "documents"), "text")
    items = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("item "), "item_id").alias("id"), "text")
    turns = table(spark, sf_dir, "conversations").select(F.concat(F.lit("turn "), "conv_id", F.lit(" "), "turn").alias("id"), "text")
    found = index.neighbours(items, "text", "id").unionByName(index.neighbours(turns, "text", "id"))
    return found.select("id", F.md5("left_text").alias("left_md5"), F.md5("right_text").alias("right_md5"))


#: Common subsequences of each item with both neighbours, one word of the item at a time.
OVERLAP = f"""{NEIGHBOURS}, z AS (SELECT item_id, side, {WORDS.format('text')} AS a, {WORDS.format('other')} AS b FROM (SELECT item_id, text, 'l' AS side, l AS other FROM n WHERE item_id IS NOT NULL UNION ALL SELECT item_id, text, 'r', r FROM n WHERE item_id IS NOT NULL) WHERE other IS NOT NULL),
  e AS (SELECT item_id, side, a, b, 0 AS i, list_transform(range(0, len(b) + 1), lambda j: 0) AS row FROM z
    UNION ALL SELECT item_id, side, a, b, i + 1, list_transform(range(0, len(b) + 1), lambda j: list_max(cell[1:j + 1])) FROM (SELECT *, list_concat([0], list_transform(range(1, len(b) + 1), lambda j: greatest(row[j + 1], CASE WHEN a[i + 1] = b[j] THEN row[j] + 1 ELSE 0 END))) AS cell FROM e WHERE i < len(a))),
  x AS (SELECT item_id, max(coalesce(row[len(b) + 1] / nullif(greatest(len(a), len(b)), 0), 0)) AS overlap FROM e WHERE i = len(a) GROUP BY item_id),
  o AS (SELECT i.item_id, x.overlap FROM benchmark i LEFT JOIN x USING (item_id) WHERE i.text IS NOT NULL)"""


def _overlap(spark, sf_dir):
    found = overlap.neighbours(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "text", "item_id")
    return overlap.scores(found, "item_id", lambda c: text.words(c, SPACE))


@query(f"WITH RECURSIVE {OVERLAP} SELECT item_id, round(overlap, 9) AS overlap FROM o")
def overlap_scores(spark, sf_dir):
    return _overlap(spark, sf_dir).select("item_id", F.round("overlap", 9).alias("overlap"))


@query(f"WITH RECURSIVE {OVERLAP} SELECT item_id, round(overlap, 9) AS overlap FROM o WHERE overlap > 0.05")
def overlap_flagged(spark, sf_dir):
    """Items that share more than a twentieth with a neighbour."""
    return overlap.flagged(_overlap(spark, sf_dir), 0.05).select("item_id", F.round("overlap", 9).alias("overlap"))


@query(f"WITH RECURSIVE {OVERLAP} SELECT CAST(least(floor(overlap * 70), 69) AS INTEGER) AS bin, count(*) AS n FROM o WHERE overlap IS NOT NULL GROUP BY ALL")
def overlap_histogram(spark, sf_dir):
    return overlap.histogram(_overlap(spark, sf_dir))


@query("SELECT source AS grp, lang AS item, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY source) AS BIGINT) AS total FROM documents GROUP BY source, lang")
def category_share(spark, sf_dir):
    return corpus.category_share(table(spark, sf_dir, "documents"), "lang", F.col("source"))


@query("SELECT event_type AS grp, hour(ts) AS item, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY event_type) AS BIGINT) AS total FROM events GROUP BY event_type, hour(ts)")
def event_share(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("h", F.hour("ts").cast("long"))
    return corpus.category_share(events, "h", F.col("event_type"))


@query("SELECT doc_id, row_number() OVER (ORDER BY text, doc_id) - 1 AS idx FROM documents")
def dense_order(spark, sf_dir):
    """Dense positions in the order of texts, without a global window."""
    return corpus.dense_index(table(spark, sf_dir, "documents").select("doc_id", "text"), [F.col("text"), F.col("doc_id")]).select("doc_id", "idx")


@query("SELECT event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY event_type")
def stream_dedup_ingest(spark, sf_dir):
    """Events through a stream that keeps the first of each (user, type) pair, a file a batch, with its keys in files."""
    from seqloom.sources.workspace import scratch
    from seqloom.streaming import ingest

    path = scratch(spark, "stream")
    source = table(spark, sf_dir, "events").select("user_id", "event_type")
    source.repartition(10).write.parquet(f"{path}/in")
    stream = ingest.file_stream(spark, f"{path}/in", source.schema, files_per_trigger=1)
    ingest.ingest(stream, f"{path}/out", ["user_id", "event_type"]).awaitTermination()
    return ingest.ingested(spark, f"{path}/out", source.schema).groupBy("event_type").agg(F.count("*").alias("n"))
