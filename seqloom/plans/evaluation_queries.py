"""Queries on evaluation, comparison and reports, with DuckDB SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.functions import bleu, sequences
from seqloom.operators import compare, evaluation, running
from seqloom.plans.corpus_queries import PAIRS, SPACE, WORDS, conversation_pairs, table, words
from seqloom.sources.workspace import dealt

Q: dict = {}
S: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        Q[f.__name__] = f
        if sql:
            S[f.__name__] = sql
        return f

    return register


@query("WITH c AS (SELECT list_append(quantile_cont(n_chars, [0.0, 0.2, 0.4, 0.6, 0.8]), max(n_chars) + 1.0) AS q FROM documents) SELECT generate_subscripts(q, 1) AS cut, unnest(q) AS value FROM c")
def percentile_cuts(spark, sf_dir):
    cuts = evaluation.percentile_cuts(table(spark, sf_dir, "documents"), "n_chars")
    return cuts.select(F.posexplode("cuts").alias("p", "value")).select((F.col("p") + 1).cast("long").alias("cut"), "value")


def _binned(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    cuts = evaluation.percentile_cuts(docs, "n_chars").scalar()
    return docs.withColumn("cuts", cuts).withColumn("bin", evaluation.percentile_bin(F.col("n_chars"), F.col("cuts")))


CUTS = "c AS (SELECT quantile_cont(n_chars, [0.0, 0.2, 0.4, 0.6, 0.8]) AS q, max(n_chars) + 1 AS top FROM documents), b AS (SELECT doc_id, 20 * len(list_filter(q, lambda x: x <= n_chars)) AS bin FROM documents, c)"


@query(f"WITH {CUTS} SELECT bin, count(*) AS n FROM b GROUP BY bin")
def percentile_bins(spark, sf_dir):
    return _binned(spark, sf_dir).groupBy(F.col("bin").cast("long").alias("bin")).agg(F.count("*").alias("n"))


@query(f"WITH {CUTS} SELECT version, count(*) AS n FROM (SELECT unnest(list_concat(CASE WHEN doc_id < 50 THEN ['eval-small'] ELSE [] END, ['eval', 'eval-' || bin])) AS version FROM b) GROUP BY version")
def multi_version_counts(spark, sf_dir):
    return evaluation.with_versions(_binned(spark, sf_dir), "doc_id", F.col("bin")).groupBy("version").agg(F.count("*").alias("n"))


@query("SELECT q AS grp, l_quantity, count(*) AS n FROM (SELECT l_quantity, 20 * len(list_filter((SELECT quantile_cont(l_quantity, [0.0, 0.2, 0.4, 0.6, 0.8]) FROM lineitem), lambda x: x <= l_quantity)) AS q FROM lineitem) GROUP BY q, l_quantity")
def quantity_bins(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    cuts = evaluation.percentile_cuts(rows, "l_quantity").scalar()
    binned = rows.withColumn("cuts", cuts).withColumn("grp", evaluation.percentile_bin(F.col("l_quantity"), F.col("cuts")).cast("long"))
    return binned.groupBy("grp", "l_quantity").agg(F.count("*").alias("n"))


def bleu_sql(order: int, ref: str = "tgt", hyp: str = "src") -> str:
    """CTEs ``k(idx, m1.., p1.., h, r)``: clipped matches, possible n-grams and lengths of each pair."""
    grams = lambda side: " UNION ALL ".join(f"SELECT idx, {n} AS n, unnest(list_transform(range(1, len({side}) - {n} + 2), lambda i: array_to_string({side}[i:i + {n} - 1], ' '))) AS g FROM w WHERE len({side}) >= {n}" for n in range(1, order + 1))
    return f"""{PAIRS}, w AS (SELECT idx, {WORDS.format(hyp)} AS h, {WORDS.format(ref)} AS r FROM pairs),
    hg AS (SELECT idx, n, g, count(*) AS c FROM ({grams('h')}) GROUP BY ALL), rg AS (SELECT idx, n, g, count(*) AS c FROM ({grams('r')}) GROUP BY ALL),
    mm AS (SELECT hg.idx, hg.n, sum(least(hg.c, rg.c)) AS m FROM hg JOIN rg USING (idx, n, g) GROUP BY ALL),
    k AS (SELECT w.idx, len(h) AS h, len(r) AS r, {', '.join(f'greatest(len(h) - {n} + 1, 0) AS p{n}, coalesce((SELECT m FROM mm WHERE mm.idx = w.idx AND mm.n = {n}), 0) AS m{n}' for n in range(1, order + 1))} FROM w)"""


def score_sql(order: int, smooth: bool) -> str:
    p = [f"((m{n} + 1.0) / (p{n} + 1.0))" if smooth else f"(CASE WHEN p{n} > 0 THEN m{n} / p{n} ELSE 0.0 END)" for n in range(1, order + 1)]
    low = f"least({', '.join(p)})"
    return f"CASE WHEN h > 0 AND {low} > 0 THEN 100 * CASE WHEN h >= r THEN 1.0 ELSE exp(1 - r / h) END * exp(({' + '.join(f'ln(greatest({x}, 1e-300))' for x in p)}) / {order}) ELSE 0.0 END"


def _bleu(spark, sf_dir, order):
    return conversation_pairs(spark, sf_dir).select("idx", bleu.count_column(order)(words("tgt"), words("src")).alias("c"))


for _order in (4, 8):
    Q[f"bleu_sentence_{_order}"] = lambda spark, sf_dir, o=_order: _bleu(spark, sf_dir, o).select("idx", F.round(bleu.sentence(F.col("c"), o), 6).alias("bleu"))
    S[f"bleu_sentence_{_order}"] = f"WITH {bleu_sql(_order)} SELECT idx, round({score_sql(_order, True)}, 6) AS bleu FROM k"
    Q[f"bleu_corpus_{_order}"] = lambda spark, sf_dir, o=_order: _bleu(spark, sf_dir, o).agg(*bleu.corpus_sums(F.col("c"), o, "b")).select(F.round(bleu.corpus("b", o), 6).alias("bleu"))
    S[f"bleu_corpus_{_order}"] = f"WITH {bleu_sql(_order)}, t AS (SELECT sum(h) AS h, sum(r) AS r, {', '.join(f'sum(m{n}) AS m{n}, sum(p{n}) AS p{n}' for n in range(1, _order + 1))} FROM k) SELECT round({score_sql(_order, False)}, 6) AS bleu FROM t"


@query(f"WITH {PAIRS} SELECT CAST(count(*) FILTER (WHERE {WORDS.format('src')} = {WORDS.format('tgt')}) AS BIGINT) AS correct, count(*) AS total FROM pairs")
def exact_match(spark, sf_dir):
    return conversation_pairs(spark, sf_dir).agg(F.count_if(words("src") == words("tgt")).alias("correct"), F.count("*").alias("total"))


@query("SELECT source, CAST(sum(quality) AS BIGINT) AS correct, count(*) AS total, round(sum(quality) / count(*), 9) AS ratio FROM labels JOIN documents USING (doc_id) GROUP BY source")
def portion_sum(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    out = rows.groupBy("source").agg(F.struct(F.sum("quality").alias("correct"), F.count("*").alias("total")).alias("p"))
    return out.select("source", "p.correct", "p.total", F.round(evaluation.ratio(F.col("p")), 9).alias("ratio"))


@query(
    """WITH c AS (SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS tp, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS fp, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS fn, count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS tn FROM labels)
    SELECT tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 9) AS accuracy, round(tp / nullif(tp + fp, 0), 9) AS precision, round(tp / nullif(tp + fn, 0), 9) AS recall, round(2 * tp / greatest(1, 2 * tp + fp + fn), 9) AS f1 FROM c"""
)
def confusion_matrix(spark, sf_dir):
    counted = table(spark, sf_dir, "labels").agg(*evaluation.confusion(F.col("quality") == 1, F.col("toxic") == 1))
    scored = evaluation.confusion_scores(counted)
    return scored.select("tp", "fp", "fn", "tn", *(F.round(c, 9).alias(c) for c in ("accuracy", "precision", "recall", "f1")))


@query(
    """WITH q AS (SELECT a.conv_id * 4294967296 + a.turn AS idx, list_distinct(regexp_extract_all(a.text, '[A-Z][a-z]+')) AS s, list_distinct(regexp_extract_all(b.text, '[A-Z][a-z]+')) AS t FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant')
    SELECT idx, len(list_filter(t, lambda x: NOT list_contains(s, x))) AS missing, len(list_filter(s, lambda x: NOT list_contains(t, x))) AS redundant FROM q"""
)
def string_literal_diff(spark, sf_dir):
    """Set differences both ways, over capitalised words in place of string literals."""
    found = lambda c: F.regexp_extract_all(F.col(c), F.lit("[A-Z][a-z]+"), F.lit(0))
    pairs = conversation_pairs(spark, sf_dir)
    return pairs.select("idx", F.size(F.array_except(found("tgt"), found("src"))).cast("long").alias("missing"), F.size(F.array_except(found("src"), found("tgt"))).cast("long").alias("redundant"))


def table_sql(source: str, first: str, cells: str, carried: str) -> str:
    """CTEs ``d(k, a, b, i, before, row)``: the rows of a dynamic program over lists ``a`` and ``b``, one at a time. A row's cells are
    ``cells`` of what is above; ``carried`` brings them along the row."""
    return f"""s AS ({source}), d AS (SELECT k, a, b, 0 AS i, CAST([] AS DOUBLE[]) AS before, {first} AS row FROM s
    UNION ALL SELECT k, a, b, i + 1, row, {carried} FROM (SELECT *, {cells} AS cell FROM d WHERE i < len(a)))"""


def distance_sql(insert: float, remove: float, replace: float, swap: float) -> str:
    cells = f"""list_concat([i + 1.0], list_transform(range(1, len(b) + 1), lambda j: least(row[j + 1] + {insert}, row[j] + CASE WHEN a[i + 1] = b[j] THEN 0 ELSE {replace} END,
      CASE WHEN i > 0 AND j > 1 AND b[j] = a[i] AND b[j - 1] = a[i + 1] THEN before[j - 1] + {swap} ELSE 1e9 END)))"""
    carried = f"list_transform(range(0, len(b) + 1), lambda j: list_min(list_transform(range(0, j + 1), lambda q: cell[q + 1] + (j - q) * {remove})))"
    source = "SELECT p_partkey AS k, string_split(p_name, '') AS a, string_split(p_type, '') AS b FROM part"
    return table_sql(source, "list_transform(range(0, len(b) + 1), lambda j: CAST(j AS DOUBLE))", cells, carried)


def _named_parts(spark, sf_dir):
    return dealt(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type"))


@query(f"WITH RECURSIVE {distance_sql(1, 1, 1, 1)} SELECT k AS p_partkey, round(CASE WHEN a = b THEN 1.0 ELSE 1 - row[len(b) + 1] / greatest(len(a), len(b), 1) END, 9) AS similarity FROM d WHERE i = len(a)")
def osa_similarity(spark, sf_dir):
    """Parts' names against their types, adjacent transpositions counting once."""
    parts = _named_parts(spark, sf_dir)
    return parts.select("p_partkey", F.round(sequences.string_similarity("p_name", "p_type"), 9).alias("similarity"))


@query("SELECT p_partkey, CAST(levenshtein(p_name, p_type) AS DOUBLE) AS distance FROM part")
def edit_distance(spark, sf_dir):
    return _named_parts(spark, sf_dir).select("p_partkey", sequences.edit_distance_column()("p_name", "p_type").alias("distance"))


@query(f"WITH RECURSIVE {distance_sql(2.0, 1.5, 2.5, 0.5)} SELECT k AS p_partkey, row[len(b) + 1] AS distance FROM d WHERE i = len(a)")
def edit_distance_costs(spark, sf_dir):
    return _named_parts(spark, sf_dir).select("p_partkey", sequences.edit_distance_column(insert=2.0, remove=1.5, replace=2.5, swap=0.5)("p_name", "p_type").alias("distance"))


COMMON_CELLS = (
    "list_transform(range(0, len(b) + 1), lambda j: 0.0::DOUBLE)",
    "list_concat([0.0::DOUBLE], list_transform(range(1, len(b) + 1), lambda j: greatest(row[j + 1], CASE WHEN a[i + 1] = b[j] THEN row[j] + 1 ELSE 0 END)))", "list_transform(range(0, len(b) + 1), lambda j: list_max(cell[1:j + 1]))",
)
COMMON = table_sql(f"SELECT idx AS k, {WORDS.format('src')} AS a, {WORDS.format('tgt')} AS b FROM pairs", *COMMON_CELLS)


@query(f"WITH RECURSIVE {PAIRS}, {COMMON} SELECT k AS idx, CAST(row[len(b) + 1] AS INTEGER) AS kept_a, CAST(row[len(b) + 1] AS INTEGER) AS kept_b, CAST(row[len(b) + 1] AS INTEGER) AS common, true AS same_words FROM d WHERE i = len(a)")
def lcs_plan(spark, sf_dir):
    """What either side keeps of a longest common subsequence: as many words as it has, and the same ones."""
    pairs = conversation_pairs(spark, sf_dir).select("idx", words("src").alias("s"), words("tgt").alias("t"))
    plan = pairs.select("idx", "s", "t", sequences.lcs_plan_columns(F.col("s"), F.col("t")).alias("p"), sequences.lcs_length("s", "t").alias("common"))
    kept = lambda c, side: F.filter(F.col(side), lambda _, i: F.get(F.col(f"p.{c}"), i))
    return plan.select("idx", F.size(kept("a", "s")).alias("kept_a"), F.size(kept("b", "t")).alias("kept_b"), "common", (kept("a", "s") == kept("b", "t")).alias("same_words"))


#: Common subsequences from the ends of reversed texts, traced back from their starts; then alignments, an anti-diagonal at a time.
REVERSED = table_sql(f"SELECT idx AS k, list_reverse({WORDS.format('src')}) AS a, list_reverse({WORDS.format('tgt')}) AS b FROM pairs", *COMMON_CELLS)
ALIGNED = f"""WITH RECURSIVE {PAIRS}, {REVERSED}, l AS MATERIALIZED (SELECT k, i, row FROM d),
  back AS (SELECT k, a, b, len(a) AS i, len(b) AS j, CAST([] AS BIGINT[]) AS kept FROM s
    UNION ALL SELECT k, a, b, CASE WHEN hit OR same THEN i - 1 ELSE i END, CASE WHEN hit OR NOT same THEN j - 1 ELSE j END, CASE WHEN hit THEN list_append(kept, len(b) + 1 - j) ELSE kept END
    FROM (SELECT back.*, a[back.i] = b[j] AS hit, x.row[j + 1] = y.row[j + 1] AS same FROM back JOIN l x ON x.k = back.k AND x.i = back.i JOIN l y ON y.k = back.k AND y.i = back.i - 1 WHERE back.i > 0 AND j > 0)),
  plan AS (SELECT k, list_reverse(b) AS t, b AS h, kept FROM back WHERE i = 0 OR j = 0),
  w(w, reward, penalty) AS (VALUES (0, 0.0::DOUBLE, 0.0::DOUBLE), (1, 0.5::DOUBLE, 0.0::DOUBLE), (2, 0.0::DOUBLE, -0.5::DOUBLE)),
  z AS (SELECT k, w, reward, penalty, t, h, len(kept) AS c, list_transform(range(1, len(t) + 1), lambda i: CASE WHEN list_contains(kept, i) THEN reward ELSE 1.0::DOUBLE END) AS gain, list_transform(range(1, len(t) + 1), lambda i: CASE WHEN list_contains(kept, i) THEN penalty ELSE 0.0::DOUBLE END) AS pay FROM plan, w),
  e AS (SELECT k, w, t, h, gain, pay, 0 AS step, list_transform(range(0, len(t) + 1), lambda i: '-inf'::DOUBLE) AS before, list_transform(range(0, len(t) + 1), lambda i: CASE WHEN i = 0 THEN 0.0::DOUBLE ELSE '-inf'::DOUBLE END) AS cells FROM z
    UNION ALL SELECT k, w, t, h, gain, pay, step + 1, cells, list_transform(range(0, len(t) + 1), lambda i: CASE WHEN i = 0 OR i > step OR step + 1 - i > len(h) THEN '-inf'::DOUBLE
      ELSE greatest(cells[i], before[i] + CASE WHEN t[i] = h[step + 1 - i] THEN gain[i] ELSE pay[i] END, cells[i + 1] + pay[i]) END) FROM e WHERE step < len(t) + len(h)),
  r AS (SELECT e.k, e.w, cells[len(e.t) + 1] AS score, c * reward + len(e.t) - c AS most, c * penalty AS least FROM e JOIN z ON z.k = e.k AND z.w = e.w WHERE step = len(e.t) + len(e.h)),
  n AS (SELECT k, w, CASE WHEN most = least THEN 1.0 ELSE (score - least) / (most - least) END AS score FROM r)
SELECT k AS idx, round(max(score) FILTER (WHERE w = 0), 6) AS score_0, round(max(score) FILTER (WHERE w = 1), 6) AS score_1, round(max(score) FILTER (WHERE w = 2), 6) AS score_2 FROM n GROUP BY k"""


@query(ALIGNED)
def edit_score(spark, sf_dir):
    """The user's text as source, the answer as target, and the answer in reverse order as hypothesis."""
    pairs = conversation_pairs(spark, sf_dir)
    hyp = F.array_join(F.reverse(words("tgt")), " ")
    scores = sequences.edit_score_column([(0.0, 0.0), (0.5, 0.0), (0.0, -0.5)])(F.col("src"), F.col("tgt"), hyp)
    return pairs.select("idx", scores.alias("s")).select("idx", *(F.round(F.get("s", F.lit(i)), 6).alias(f"score_{i}") for i in range(3)))


# Comparison on the conversations: systems made from the pair itself.
PSEUDO = ("answer", "first_half", "echo")


def _pseudo(spark, sf_dir):
    """``idx, system, words, exact_match, bleu, n_words``: the answer, its first half, and the question, against the answer."""
    pairs = conversation_pairs(spark, sf_dir).select("idx", words("src").alias("s"), words("tgt").alias("t"))
    half = F.slice("t", F.lit(1), F.floor(F.size("t") / 2).cast("int"))
    each = F.array(*[F.struct(F.lit(n).alias("system"), h.alias("h")) for n, h in zip(PSEUDO, (F.col("t"), half, F.col("s")), strict=True)])
    rows = pairs.select("idx", "t", F.inline(each))
    counted = rows.withColumn("c", bleu.count_column(1)("t", "h"))
    return counted.select(
        "idx", "system", F.size("h").cast("long").alias("n_words"), (F.col("t") == F.col("h")).cast("long").alias("exact"), F.get("c.matches", F.lit(0)).alias("hits"),
        F.round(F.coalesce(F.try_divide(F.get("c.matches", F.lit(0)), F.get("c.possible", F.lit(0))), F.lit(0.0)), 9).alias("precision"), F.size("t").cast("long").alias("target_words"),
    )


PSEUDO_SQL = f"""{PAIRS}, w AS (SELECT idx, {WORDS.format('src')} AS s, {WORDS.format('tgt')} AS t FROM pairs),
  y AS (SELECT idx, t, 'answer' AS system, t AS h FROM w UNION ALL SELECT idx, t, 'first_half', t[1:len(t) // 2] FROM w UNION ALL SELECT idx, t, 'echo', s FROM w),
  hc AS (SELECT idx, system, g, count(*) AS c FROM (SELECT idx, system, unnest(h) AS g FROM y) GROUP BY ALL), tc AS (SELECT idx, g, count(*) AS c FROM (SELECT idx, unnest(t) AS g FROM w) GROUP BY ALL),
  mt AS (SELECT hc.idx, hc.system, sum(least(hc.c, tc.c)) AS m FROM hc JOIN tc USING (idx, g) GROUP BY ALL),
  ps AS (SELECT y.idx, y.system, len(h) AS n_words, CAST(t = h AS BIGINT) AS exact, CAST(coalesce(m, 0) AS BIGINT) AS hits, round(coalesce(coalesce(m, 0) / nullif(len(h), 0), 0), 9) AS precision, len(t) AS target_words FROM y LEFT JOIN mt ON mt.idx = y.idx AND mt.system = y.system)"""


@query(f"WITH {PSEUDO_SQL} SELECT system, CAST(sum(exact) AS BIGINT) AS exact, CAST(sum(hits) AS BIGINT) AS hits, CAST(sum(n_words) AS BIGINT) AS n_words, CAST(sum(target_words) AS BIGINT) AS target_words, round(avg(precision), 6) AS precision FROM ps GROUP BY system")
def metric_summary(spark, sf_dir):
    return _pseudo(spark, sf_dir).groupBy("system").agg(*(F.sum(c).alias(c) for c in ("exact", "hits", "n_words", "target_words")), F.round(F.avg("precision"), 6).alias("precision"))


LONG_SQL = f"{PSEUDO_SQL}, su AS (SELECT system, CAST(sum(exact) AS DOUBLE) AS exact, CAST(sum(hits) AS DOUBLE) AS hits, round(avg(precision), 6) AS precision FROM ps GROUP BY system), lg AS (SELECT system, metric, value FROM su UNPIVOT (value FOR metric IN (exact, hits, precision)))"


def _long(spark, sf_dir):
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in ("exact", "hits", "precision")])
    return metric_summary(spark, sf_dir).select("system", F.inline(cells))


@query(f"WITH {LONG_SQL} SELECT metric, max(value) FILTER (WHERE system = 'answer') AS answer, max(value) FILTER (WHERE system = 'first_half') AS first_half, max(value) FILTER (WHERE system = 'echo') AS echo FROM lg GROUP BY metric")
def metric_pivot(spark, sf_dir):
    return evaluation.pivoted(_long(spark, sf_dir), list(PSEUDO))


@query(
    f"""WITH {LONG_SQL}, x AS (SELECT metric, max(value) AS high, min(value) AS low FROM lg WHERE system <> 'answer' GROUP BY metric)
    SELECT 'exact_match' AS metric, high AS best, low AS worst FROM x WHERE metric = 'exact' UNION ALL SELECT 'arg_redundant', low, high FROM x WHERE metric = 'hits' UNION ALL SELECT 'overlap_score', NULL, NULL FROM x WHERE metric = 'precision'"""
)
def best_worst(spark, sf_dir):
    """Over all but the reference system: a metric that is better when higher, one when lower, and one without a direction."""
    named = F.create_map(*[F.lit(x) for x in ("exact", "exact_match", "hits", "arg_redundant", "precision", "overlap_score")])
    return evaluation.best_worst(_long(spark, sf_dir).withColumn("metric", named[F.col("metric")]), ("answer",))


KEYS = ["hits", "precision"]
COMPARED = f"""{PSEUDO_SQL}, cm AS (SELECT a.idx, b.hits - a.hits AS c1, b.precision - a.precision AS c2 FROM ps a JOIN ps b USING (idx) WHERE a.system = 'first_half' AND b.system = 'echo'),
  od AS (SELECT idx, c1, c2, row_number() OVER (ORDER BY c1, c2, idx) - 1 AS ordinal FROM cm WHERE c1 < 0 AND c2 < 0)"""


def _compared(spark, sf_dir):
    return compare.better_on_all(_pseudo(spark, sf_dir), "idx", "first_half", "echo", KEYS)


@query(f"WITH {COMPARED} SELECT idx, ordinal FROM od")
def compare_systems(spark, sf_dir):
    """Examples where half an answer beats an echo on both metrics, biggest wins first."""
    return _compared(spark, sf_dir).select("idx", F.col("ordinal").cast("long").alias("ordinal"))


@query(f"WITH {COMPARED} SELECT idx, ordinal // 10 AS page, ordinal % 10 AS place FROM od")
def compare_pages(spark, sf_dir):
    return _compared(spark, sf_dir).select("idx", F.floor(F.col("ordinal") / 10).alias("page"), F.pmod("ordinal", F.lit(10)).cast("long").alias("place"))


@query(f"WITH {PSEUDO_SQL} SELECT a.idx, CAST(b.hits - a.hits AS DOUBLE) AS hits, round(b.precision - a.precision, 9) AS precision, CASE WHEN b.hits < a.hits THEN 'left' WHEN b.hits > a.hits THEN 'right' ELSE 'both' END AS winner FROM ps a JOIN ps b USING (idx) WHERE a.system = 'first_half' AND b.system = 'echo'")
def metric_difference(spark, sf_dir):
    both = compare.better_on_all(_pseudo(spark, sf_dir), "idx", "first_half", "echo", [])
    d = lambda k: compare.difference(k, F.col("left"), F.col("right"))
    return both.select("idx", d("hits").alias("hits"), F.round(d("precision"), 9).alias("precision"), compare.winners("hits", F.col("left"), F.col("right")).alias("winner"))


@query("SELECT * FROM (VALUES ('base', '0'), ('beam', '1,2'), ('small', '2')) AS t(tag, systems)")
def tag_index(spark, sf_dir):
    systems = spark.sql("SELECT * FROM VALUES (0, 'a', array('base')), (1, 'b', array('beam')), (2, 'c', array('beam', 'small')) AS t(ordinal, key, tags)")
    return compare.tag_index(systems).select("tag", F.array_join(F.col("systems").cast("array<string>"), ",").alias("systems"))


@query(f"SELECT doc_id, len({WORDS.format('text')}) AS words FROM documents WHERE lang IN ('en', 'de') OR source = 'src3'")
def subset_by_mask(spark, sf_dir):
    """Documents that carry any of the wanted tags: their language and their source."""
    docs = table(spark, sf_dir, "documents").withColumn("tags", F.array("lang", "source"))
    return compare.with_any_tag(docs, ["en", "de", "src3"]).select("doc_id", F.size(words("text")).cast("long").alias("words"))


@query("SELECT user_id, event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) AS running FROM events")
def running_loss_by_user(spark, sf_dir):
    """A running mean of 20 values, by user."""
    rows = running.running_mean(table(spark, sf_dir, "events"), "value", "event_id", 20, "user_id")
    return rows.select("user_id", "event_id", F.round("running", 6).alias("running"))


@query("SELECT event_id, round(avg(value) OVER (ORDER BY event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) AS running FROM events")
def running_loss(spark, sf_dir):
    """A running mean of 20 values over all events in one order."""
    rows = running.running_mean(table(spark, sf_dir, "events").select("event_id", "value"), "value", "event_id", 20)
    return rows.select("event_id", F.round("running", 6).alias("running"))


@query("SELECT * FROM (VALUES ('summary', 17), ('example', 5), ('directed', 17)) AS t(shown, n)")
def metric_visibility(spark, sf_dir):
    """How many metrics the summary shows, an example shows, and can be compared."""
    c = evaluation.catalogue(spark)
    part = lambda name, where: c.where(where).agg(F.lit(name).alias("shown"), F.count("*").cast("int").alias("n"))
    return part("summary", "display_in_summary").unionByName(part("example", "display_in_example")).unionByName(part("directed", "higher_is_better IS NOT NULL"))


@query(f"WITH {bleu_sql(4)}, b AS (SELECT idx, round({score_sql(4, True)}, 6) AS bleu FROM k) SELECT idx, bleu, row_number() OVER (ORDER BY bleu, idx) - 1 AS place FROM b")
def bleu_ranking(spark, sf_dir):
    """Pairs from worst to best sentence BLEU."""
    from seqloom.operators.corpus import dense_index

    scored = _bleu(spark, sf_dir, 4).select("idx", F.round(bleu.sentence(F.col("c"), 4), 6).alias("bleu"))
    return dense_index(scored, [F.col("bleu"), F.col("idx")], "place")


@query("SELECT quality > 0.5 AS above, count(*) AS n FROM labels GROUP BY ALL")
def threshold_partition(spark, sf_dir):
    return table(spark, sf_dir, "labels").groupBy((F.col("quality") > 0.5).alias("above")).agg(F.count("*").alias("n"))


@query("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 500")
def dataset_cap(spark, sf_dir):
    """The validation cap: the first 500 rows in index order (the cap is the feature)."""
    return table(spark, sf_dir, "documents").select("doc_id").orderBy("doc_id").limit(500)
