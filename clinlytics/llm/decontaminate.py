"""Operator 8: benchmark decontamination by a positional inverted index, DataFrame functions only.

Benchmark items are cut into windows of WINDOW consecutive words (an item of
fewer words is one window). The training texts' postings (term, document,
position) are taken for each window's two rarest terms by corpus frequency.
Their lists, adjusted by the terms' offsets in the window, are intersected:
equal starts are candidates for the exact phrase, starts up to SLACK apart
candidates for a proximity match (share of the window's distinct words in the
stretch at NEAR or above). Candidates are checked on the words of their
documents only.

Scale: nothing but the postings of rare terms is shuffled, once; both lists of
a window and text meet in one sorted window, where each start sees the other
list's starts within SLACK. The document frequencies are pre-aggregated in the
tasks; no list of documents reaches the driver. Benchmark tables are written,
so that their joins are broadcast only below the session's threshold; tables of
few or short rows go to a few files for each core, not to one for each shuffle
partition. Words repeated thousands of times in one text make postings, never
pairs among themselves.

Defined results: null texts have 0 words, 0 hits, no items; items without
words make no window; repeated items and rows are each counted as the contract
says (repeated document rows give a row each); rows are told apart by id and
text; extra columns are ignored; an empty benchmark hits nothing.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinlytics.llm.common import prepare, written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: what WORD excludes
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW = 13
SLACK = 3
NEAR = 0.75


def words(text: Column) -> Column:
    """The WORD runs, cut at what lies between them: a tenth of regexp_extract_all's time."""
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), GAP), "")


def n_words(text: Column) -> Column:
    return F.when(text.isNotNull(), F.size(words(text)).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the text's key, which tells rows of one id apart."""
    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")


def windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, phrase, n) of every distinct window of every item; phrase has its words joined by a space."""
    own = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - WINDOW + 1))
    cut = own.select("item_id", "w", F.explode(starts).alias("i")).select("item_id", F.slice("w", F.col("i"), WINDOW).alias("w"))
    return cut.select("item_id", F.array_join("w", " ").alias("phrase"), F.size("w").alias("n")).distinct()


def window_terms(cut: DataFrame) -> DataFrame:
    """(phrase, n, term, offset): each distinct term of a window at its first place."""
    own = cut.select("phrase", "n").distinct()
    return own.select("phrase", "n", F.posexplode(F.split("phrase", " ")).alias("offset", "term")).groupBy("phrase", "n", "term").agg(F.min("offset").alias("offset"))


def occurrences(docs: DataFrame) -> DataFrame:
    """Every word of every whole text with its position."""
    return keyed(docs).select("doc_id", "text_key", F.posexplode(words(F.col("text"))).alias("pos", "term"))


def frequencies(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(term, df): how often the vocabulary's terms occur over all texts."""
    return (docs.select(F.explode(words(F.col("text"))).alias("term")).join(vocabulary, "term", "left_semi")
            .groupBy("term").agg(F.count(F.lit(1)).alias("df")))


def rarest(terms: DataFrame, df: DataFrame) -> DataFrame:
    """Per window its two rarest terms that occur in the texts (the same one twice, if it has but one)."""
    known = terms.join(df, "term")
    rank = F.row_number().over(Window.partitionBy("phrase").orderBy("df", "term"))
    top = known.withColumn("rank", rank).where("rank <= 2").groupBy("phrase", "n").agg(
        F.min(F.when(F.col("rank") == 1, F.struct("term", "offset"))).alias("a"), F.min(F.when(F.col("rank") == 2, F.struct("term", "offset"))).alias("b"))
    b = F.coalesce("b", "a")
    return top.select("phrase", "n", F.col("a.term").alias("term_a"), F.col("a.offset").alias("offset_a"),
                      b["term"].alias("term_b"), b["offset"].alias("offset_b"))


def postings(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """(doc_id, text_key, phrase, n, start, in_a, in_b): the adjusted lists of every window's two terms, each start once."""
    anchors = _written(plan.select(F.col("term_a").alias("term")).union(plan.select("term_b")).distinct())
    # one term for both lists: its starts are in either
    lists = plan.select("phrase", "n", F.explode(F.array(
        F.struct(F.col("term_a").alias("term"), F.col("offset_a").alias("offset"), F.lit(True).alias("of_a"), (F.col("term_a") == F.col("term_b")).alias("of_b")),
        F.struct(F.col("term_b").alias("term"), F.col("offset_b").alias("offset"), (F.col("term_a") == F.col("term_b")).alias("of_a"), F.lit(True).alias("of_b")))).alias("t"))
    lists = lists.select("phrase", "n", "t.*").distinct()
    key = ["doc_id", "text_key", "phrase", "n"]
    found = occurrences(docs).join(anchors, "term", "left_semi").join(lists, "term")
    found = found.select(*key, (F.col("pos") - F.col("offset")).alias("start"), "of_a", "of_b")
    # dealt by the key, which the window of candidates() needs too: one shuffle for both
    return found.repartition(*key).groupBy(*key, "start").agg(F.max("of_a").alias("in_a"), F.max("of_b").alias("in_b"))


def candidates(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """(doc_id, text_key, phrase, n, start, apart): intersection of the adjusted lists."""
    key = ["doc_id", "text_key", "phrase", "n"]
    near = Window.partitionBy(*key).orderBy("start")
    b = F.when(F.col("in_b"), F.col("start"))
    both = postings(docs, plan).withColumns({"before": F.max(b).over(near.rangeBetween(-SLACK, 0)), "after": F.min(b).over(near.rangeBetween(0, SLACK))})
    # least() skips a null: no start of the other list on that side
    apart = F.least(F.col("start") - F.col("before"), F.col("after") - F.col("start"))
    return both.where(F.col("in_a")).select(*key, "start", apart.alias("apart")).where("apart is not null")


def _written(df: DataFrame, per_core: int = 1) -> DataFrame:
    """``written`` to ``per_core`` files for each of the cluster's cores at most: a table of few rows isn't dealt over
    as many files as there are shuffle partitions, each of which a task makes, names and commits."""
    return written(df.coalesce(per_core * df.sparkSession.sparkContext.defaultParallelism))


def matches(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Matches (doc_id, text_key, phrase, n, start, kind) with kind 'exact' or 'near', and the item windows."""
    prepare(docs.sparkSession)
    cut = _written(windows(benchmark))
    terms = window_terms(cut)
    df = frequencies(docs, _written(terms.select("term").distinct()))
    plan = _written(rarest(terms, df))
    found = written(candidates(docs, plan))
    # The words of documents with candidates only: their keys are a written table, so its size decides how they are joined.
    keys = _written(found.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct(), 4)
    rows = keyed(docs)
    rows = rows.join(keys, rows.doc_id.eqNullSafe(F.col("_id")) & (rows.text_key == F.col("_key")), "left_semi").distinct()
    at = found.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("phrase", "n", "start", "apart")).alias("found"))
    own = _by_key(rows, at, "inner").select("doc_id", "text_key", words(F.col("text")).alias("w"), "found")
    # a step of its own: beside explode() the words would be cut anew for each candidate
    own = own.select("doc_id", "text_key", "w", F.explode("found").alias("f")).select("doc_id", "text_key", "w", "f.*")
    exact = (F.col("start") >= 0) & (F.array_join(F.slice("w", F.greatest(F.lit(1), F.col("start") + 1), F.col("n")), " ") == F.col("phrase"))
    stretch = F.slice("w", F.greatest(F.lit(1), F.col("start") + 1 - SLACK), F.col("n") + 2 * SLACK)
    distinct = F.array_distinct(F.split("phrase", " "))
    near = F.size(F.array_intersect(distinct, stretch)) >= F.ceil(NEAR * F.size(distinct))
    kind = F.when((F.col("apart") == 0) & exact, "exact").when(near, "near")
    return own.select("doc_id", "text_key", "phrase", "n", "start", kind.alias("kind")).where("kind is not null").distinct(), cut


def report(docs: DataFrame, benchmark: DataFrame, proximity: bool = False) -> DataFrame:
    """The op8 result, one row per document row; ``proximity`` adds n_near, the items with proximity matches."""
    found, cut = matches(docs, benchmark)
    found = written(found)
    exact = found.where("kind = 'exact'")
    key = ["doc_id", "text_key"]
    place = F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("pos")
    hit = exact.select(*key, "start", "n").distinct().select(*key, place).distinct().groupBy(*key).agg(F.count(F.lit(1)).alias("n_hit"))
    items = (exact.select(*key, "phrase").distinct().join(cut, "phrase").select(*key, F.col("item_id").cast("string").alias("item")).distinct()
             .groupBy(*key).agg(F.count(F.lit(1)).alias("n_items"), F.array_join(F.sort_array(F.collect_list("item")), ",").alias("items")))
    side = _by_key(hit, items, "full")
    near = (found.where("kind = 'near'").select(*key, "phrase").distinct().join(cut, "phrase").select(*key, "item_id").distinct()
            .groupBy(*key).agg(F.count(F.lit(1)).alias("n_near")))
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), n_words(F.col("text")).alias("n_words"))
    if proximity:
        side = _by_key(side, near, "full")
    out = _by_key(rows, _written(side, 4), "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
                      F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"),
                      ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
                      *([F.coalesce("n_near", F.lit(0)).alias("n_near")] if proximity else []))


def _by_key(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join on (doc_id, text_key) where a null id equals a null id."""
    r = right.withColumnsRenamed({"doc_id": "_r_id", "text_key": "_r_key"})
    j = left.join(r, left.doc_id.eqNullSafe(F.col("_r_id")) & (left.text_key == F.col("_r_key")), how)
    if how == "full":
        j = j.withColumn("doc_id", F.when(F.col("text_key").isNull(), F.col("_r_id")).otherwise(F.col("doc_id"))).withColumn("text_key", F.coalesce("text_key", "_r_key"))
    return j.drop("_r_id", "_r_key")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the contaminated rows, all columns kept."""
    found, _ = matches(docs, benchmark)
    key = ["doc_id", "text_key"]
    place = F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("pos")
    hit = (found.where("kind = 'exact'").select(*key, "start", "n").distinct().select(*key, place).distinct()
           .groupBy(*key).agg(F.count(F.lit(1)).alias("n_hit")))
    hit = _written(hit, 4).withColumnsRenamed({"doc_id": "_r_id", "text_key": "_r_key", "n_hit": "_r_hit"})
    return docs.join(hit, docs.doc_id.eqNullSafe(F.col("_r_id")) & (F.xxhash64(docs.text) == F.col("_r_key"))
                     & (20 * F.col("_r_hit") >= n_words(docs.text)), "left_anti").select(*docs.columns)


def oracle() -> str:
    """DuckDB SQL of :func:`report` without n_near: every n-gram of every text against the windows."""
    w = f"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}')"
    return f"""
    WITH b AS (SELECT item_id, {w} AS w FROM benchmark),
    win AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[i:i + {WINDOW} - 1], ' ') AS p
            FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - {WINDOW} + 1) + 1)) AS i FROM b WHERE len(w) > 0)),
    d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({w}, []) AS w FROM documents),
    g AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS p
          FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win))),
    hit AS (SELECT r, i, g.n, item_id FROM g JOIN win ON g.p = win.p AND g.n = win.n),
    cover AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS pos FROM (SELECT DISTINCT r, i, n FROM hit)) GROUP BY r),
    items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM hit) GROUP BY r)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
      coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
    FROM d LEFT JOIN cover USING (r) LEFT JOIN items USING (r)"""
