"""Retrieval over per-visit chunks of the clinical summaries.

chunk -> embed -> store (keyed upsert) -> search (name path or exact cosine
top-k) -> de-duplicate per patient -> prompts with sources.

Every step is a DataFrame plan. Queries are a table, so many questions
are answered in one job; the vector path deals queries and chunks to cells of
two blocks, scores each cell in one task and keeps each query's top k with a
partial (map-side) group limit before the shuffle.
"""
from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinlytics.functions.core import strip_ws
from clinlytics.functions.pyudfs import cell_topk
from clinlytics.functions.text import (HEADER_PREFIX, NONBLANK, VISIT_SPLIT, chunk_columns, detect_name_columns,
                                       doctor_line, nonblank_lines)
from clinlytics.functions.vectors import DEFAULT_DIM, cosine, hash_embed_table
from clinlytics.session import ship_package, written

# Retrieval defaults and the no-result answer.
TOP_K = 10
OVERFETCH = 3
NO_RESULT_ANSWER = "I couldn't find any relevant patient records for that query."
CONTEXT_SEPARATOR = "\n\n---\n\n"
CONTEXT_PLACEHOLDER = "{retrieved_chunks}"
DEFAULT_SYSTEM_PROMPT = (
    "Answer the question from the patient records below only. Cite patient names and ids. "
    "Say so when the records do not contain the answer. Give no medical advice.\n\n"
    "PATIENT RECORDS:\n" + CONTEXT_PLACEHOLDER)


# ------------------------------------------------------------- chunks ----
def _header_and_body(text: Column) -> tuple[Column, Column]:
    """The first line that starts with 'PATIENT:' (none: ''), and a line feed with the lines after it."""
    x = F.concat(F.lit("\n"), text)
    at = F.locate("\n" + HEADER_PREFIX, x)
    tail = F.substr(x, at + 1)
    header = F.when(at > 0, F.substring_index(tail, "\n", 1)).otherwise(F.lit(""))
    return header, F.when(at > 0, F.substr(tail, F.length(header) + 1)).otherwise(x)


def block_numbers(text: Column) -> Column:
    """The block numbers of the chunks of a summary."""
    blocks = F.transform(F.split(_header_and_body(F.coalesce(text, F.lit("")))[1], VISIT_SPLIT), lambda b, i: F.when(b.rlike(NONBLANK), i))
    return F.array_compact(blocks)


def chunk_summaries(summaries: DataFrame, keep: tuple[str, ...] = (), gone: str | None = None) -> DataFrame:
    """Split (patient_id, summary_text) into one chunk per visit block.

    The header is the first line starting with 'PATIENT:' (none -> ''),
    and only lines after it are scanned. A new block starts at each line
    that begins with 'VISIT ' and contains '['; non-blank lines before the
    first such line form block 0. Blank lines are dropped. Chunk text is
    header + blank line + block lines, stripped. ``keep`` names further
    columns of the summaries to pass on, or ``block_no``; ``gone`` an array of
    block numbers that come out as further rows without a document.
    """
    own = [k for k in keep if k != "block_no"]
    text = F.col("summary_text")
    header, body = _header_and_body(text)
    if gone is None:
        s = summaries.where(text.rlike(NONBLANK)).select("patient_id", *own, header.alias("_header"), body.alias("_body"))
        blocks = s.select("patient_id", *own, "_header", F.posexplode(F.split("_body", VISIT_SPLIT)).alias("block_no", "_block"))
        blocks = blocks.where(F.col("_block").rlike(NONBLANK))
    else:
        numbered = F.transform(F.split(F.coalesce(body, F.lit("")), VISIT_SPLIT), lambda b, i: F.struct(i.alias("block_no"), b.alias("_block")))
        lost = F.transform(gone, lambda i: F.struct(i.alias("block_no"), F.lit(None).cast("string").alias("_block")))
        s = summaries.select("patient_id", *own, header.alias("_header"), F.explode(F.concat(numbered, lost)).alias("_b"))
        blocks = s.select("patient_id", *own, F.when(F.col("_b._block").isNotNull(), F.col("_header")).alias("_header"), "_b.block_no", "_b._block")
        blocks = blocks.where(F.coalesce(F.col("_block").rlike(NONBLANK), F.lit(True)))
    # staged columns: each array is computed once per row
    blocks = blocks.withColumn("_lines", nonblank_lines(F.col("_block")))
    blocks = blocks.withColumn("_dr", doctor_line(F.col("_lines")))
    meta = chunk_columns(F.col("_lines"), F.col("_header"), F.col("_dr"))
    return blocks.select(
        F.format_string("%d_visit_%d", F.col("patient_id"), F.col("block_no")).alias("chunk_id"),
        "patient_id",
        strip_ws(F.concat(F.col("_header"), F.lit("\n\n"), F.array_join("_lines", "\n"))).alias("document"),
        *[c.alias(k) for k, c in meta.items()], *keep,
    )


def embed_chunks(chunks: DataFrame, embedder=None, dim: int = DEFAULT_DIM) -> DataFrame:
    """Add ``embedding`` (array<float>) from ``document``.

    ``embedder`` is a Column function (text -> array<float>), e.g. the UDF
    from ``functions.vectors.model_embedder``; default: feature hashing.
    """
    if embedder is None:
        return hash_embed_table(chunks, "chunk_id", "document", dim)
    return chunks.withColumn("embedding", embedder(F.coalesce("document", F.lit(""))))


def embed_queries(queries: DataFrame, embedder=None, dim: int = DEFAULT_DIM) -> DataFrame:
    """(query_id, qvec): questions embedded in one map, by the model's query mode if it has one."""
    q = queries.select("query_id", "query")
    if embedder is None:
        return hash_embed_table(q, "query_id", "query", dim, out="qvec").select("query_id", "qvec")
    fn = getattr(embedder, "for_queries", embedder)
    return q.select("query_id", fn(F.col("query")).alias("qvec"))


def build_store(summaries: DataFrame, ingested_at=None, embedder=None, dim: int = DEFAULT_DIM) -> DataFrame:
    """Chunk + embed all summaries into store rows (one per chunk id)."""
    ts = F.lit(ingested_at or dt.datetime(2001, 7, 15)).cast("timestamp")
    chunks = chunk_summaries(summaries)
    c = embed_chunks(chunks, embedder, dim)
    return c.withColumns({"created_at": ts, "updated_at": ts})


def ingest_stats(summaries: DataFrame, store_after: DataFrame) -> DataFrame:
    """Counts reported by an ingestion run, in one pass over the summaries."""
    blank = F.col("summary_text").isNull() | (strip_ws(F.col("summary_text")) == "")
    s = summaries.agg(F.count_if(blank).alias("patients_skipped"),
                      F.count_if(~blank).alias("patients_processed"))
    chunks = chunk_summaries(summaries).agg(F.count(F.lit(1)).alias("chunks_ingested"))
    total = store_after.agg(F.count(F.lit(1)).alias("total_in_store"))
    from clinlytics.operators.dashboard import one_row
    return one_row([s, chunks, total]).select(
        "chunks_ingested", "patients_processed", "patients_skipped", "total_in_store")


def store_status(store: DataFrame) -> DataFrame:
    return store.agg(F.count(F.lit(1)).alias("chunks"), F.max("updated_at").alias("last_ingested")) \
        .withColumn("ready", F.col("chunks") > 0)


# -------------------------------------------------------------- names ----
def detect_names(queries: DataFrame) -> DataFrame:
    return detect_name_columns(queries.select("query_id", "query"), "query")


def _stretches(text, lengths: list[int]):
    """The different runs of each of ``lengths`` characters of a string column."""
    def runs(n: int):
        places = F.sequence(F.lit(1), F.length(text) - (n - 1))
        return F.when(F.length(text) >= n, F.transform(places, lambda i: F.substring(text, i, F.lit(n))))

    return F.array_distinct(F.flatten(F.array_compact(F.array(*[runs(n) for n in lengths]))))


# '%', '_' and an escaping backslash cut a pattern into literal stretches (fixed: LIKE's syntax).
_LITERALS = r"\\.|\\|%|_"


def search_names(patterns: DataFrame, names: DataFrame) -> DataFrame:
    """(pattern, patient_name): names ILIKE '%pattern%', wildcards included, for distinct ``patterns(pattern)``.

    The different names are indexed by their runs of as many characters as the
    patterns' literal stretches have, so a stretch joins the names that hold it
    and no others: a pattern without wildcards meets its names alone. One with
    wildcards looks up, of its stretches, the one that the fewest names hold, and
    its candidates are verified; one of wildcards alone, the names that are long
    enough for it.
    """
    low, low_name = F.lower(F.col("pattern")), F.lower(F.col("patient_name"))
    names = names.select("patient_name").where(F.col("patient_name").isNotNull()).distinct()
    parts = F.filter(F.split(low, _LITERALS), lambda x: x != "")
    wild = F.regexp_like("pattern", F.lit(r"[%_\\]"))
    parts = written(patterns.select("pattern", wild.alias("wild"), F.array_distinct(parts).alias("parts")))
    # as many numbers as the longest pattern has characters, at most
    lengths = [r[0] for r in parts.select(F.explode("parts").alias("part")).select(F.length("part")).distinct().collect()]
    long = names.select("patient_name", F.explode(F.sequence(F.lit(0), F.length("patient_name"))).alias("least"))
    bare = parts.where(F.size("parts") == 0).select("pattern", F.length(F.regexp_replace("pattern", "[^_]", "")).alias("least"))
    hits = bare.join(long, "least").select("pattern", "patient_name")
    if not lengths:
        return hits
    index = names.select("patient_name", F.explode(_stretches(low_name, sorted(lengths))).alias("part"))
    wanted = parts.select("pattern", "wild", F.explode("parts").alias("part"))
    plain = wanted.where(~F.col("wild")).join(index, "part").select("pattern", "patient_name")
    several = wanted.where("wild")
    held = index.join(several.select("part").distinct(), "part", "left_semi").groupBy("part").agg(F.count(F.lit(1)).alias("held"))
    # a stretch that no name holds rules its pattern out
    rarest = (several.join(held, "part", "left").groupBy("pattern").agg(F.min(F.struct(F.coalesce("held", F.lit(0)).alias("held"), "part")).alias("r"))
              .where("r.held > 0").select("pattern", F.col("r.part").alias("part")))
    verified = rarest.join(index, "part").where(F.expr("patient_name ILIKE concat('%', pattern, '%')")).select("pattern", "patient_name")
    return hits.unionByName(plain).unionByName(verified)


def retrieve_by_name(queries: DataFrame, store: DataFrame, top_k: int = TOP_K) -> DataFrame:
    """Chunks whose patient_name ILIKE '%name%', newest visit first, top k
    per query, score 1.0. ``queries`` has query_id and detected_name.

    The detected names are written once (the detection is a long expression that
    the optimizer would copy into every filter and key). Each different name
    among them is searched once, whatever the number of queries that ask for
    it, and each name in the store brings its newest k chunks, which hold the
    newest k of any set of names. Queries then share the k chunks of their name;
    a query id that comes with several names is ranked over all of them.
    """
    q = queries.where(F.col("detected_name").isNotNull()).select("query_id", F.col("detected_name").alias("pattern")).distinct()
    own = Window.partitionBy("query_id")
    several = F.min("pattern").over(own) != F.max("pattern").over(own)
    asker = F.to_json(F.struct(F.when(several, F.col("query_id")).alias("q"), F.when(~several, F.col("pattern")).alias("p")))
    q = written(q.withColumn("_asker", asker))
    s = store.select("chunk_id", "patient_id", "document", "patient_name", "visit_date", "department",
                     "doctor_name", "diagnosis_codes", "has_followup")
    s = s.where(F.col("patient_id").isNotNull() & F.col("patient_name").isNotNull())
    found = search_names(q.select("pattern").distinct(), s.select("patient_name"))
    pairs = q.select("_asker", "pattern").distinct().join(found, "pattern").select("_asker", "patient_name").distinct()
    newest = [F.col("visit_date").desc(), F.col("chunk_id")]
    top = lambda rows, key: rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*newest))).where(F.col("rank") <= top_k)
    best = top(s, "patient_name").drop("rank")
    ranked = top(pairs.join(best, "patient_name"), "_asker")
    hits = q.select("query_id", "_asker").distinct().join(ranked, "_asker")
    return hits.withColumn("score", F.lit(1.0)).select("query_id", *s.columns, "rank", "score")


# ------------------------------------------------------------- vectors ----
#: queries and candidates of a cell; a task holds one block of queries and a batch of candidates
QUERY_BLOCK, VECTOR_BLOCK = 1_024, 65_536


def _blocks(rows: DataFrame, size: int) -> int:
    return max(1, -(-rows.count() // size))


def vector_topk(queries: DataFrame, candidates: DataFrame, top_k: int = TOP_K,
                id_col: str = "chunk_id", vec_col: str = "embedding", filter_cols: list[str] | None = None,
                score_digits: int | None = None) -> DataFrame:
    """Exact cosine top-k of each query vector over all candidates.

    ``queries``: query_id, qvec (+ filter columns); ``candidates``: id_col,
    vec_col (+ the same filter columns, which must then match exactly).

    Both sides are hashed into blocks and dealt by one shuffle to the cells
    (query block, vector block): a query meets every vector in exactly one
    cell. A task multiplies the block of queries with the candidates as they
    stream by and emits its local top k per query; a per-query row_number <= k (a
    partial group limit before the shuffle) merges them. Queries of equal vectors
    (and filters) are searched once and share what is found, so the work grows
    with the different vectors times the candidates. Nothing goes through
    the driver, and the plan does not grow with the queries. Queries without a
    vector have no neighbours. Other candidate columns are joined back to the
    k winners.
    """
    filter_cols = filter_cols or []
    ship_package(queries.sparkSession)
    kinds = dict(candidates.dtypes)
    group, missing = (F.to_json(F.struct(*filter_cols)) if filter_cols else F.lit("")), F.lit(False)
    for col in filter_cols:  # a null matches nothing
        missing = missing | F.col(col).isNull()
    asked = written(queries.where(F.col("qvec").isNotNull() & ~missing).select("query_id", F.col("qvec").cast("array<double>").alias("vec"), group.alias("group")))
    q = written(asked.select("vec", "group").distinct().withColumn("_vector", F.monotonically_increasing_id()))
    group = F.when(~missing, group)
    c = candidates.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), group.alias("group"))
    n_q, n_c = _blocks(q, QUERY_BLOCK), _blocks(c, VECTOR_BLOCK)
    own_q, own_c = (F.pmod(F.xxhash64(key), F.lit(n)).cast("int") for key, n in (("_vector", n_q), ("id", n_c)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = q.select(own_q.alias("qb"), every(n_c).alias("vb"), F.lit(0).alias("side"), F.col("_vector").alias("query_id"), F.lit(None).cast(kinds[id_col]).alias("id"), "vec", "group")
    right = c.select(every(n_q).alias("qb"), own_c.alias("vb"), F.lit(1).alias("side"), F.lit(None).cast("bigint").alias("query_id"), "id", "vec", "group")
    cells = left.unionByName(right).repartition("qb", "vb").sortWithinPartitions("qb", "vb", "side")
    out = cells.mapInArrow(cell_topk(top_k), f"query_id bigint, id {kinds[id_col]}, score double").withColumnsRenamed({"query_id": "_vector", "id": id_col})

    def best(rows: DataFrame, key: str) -> DataFrame:
        w = Window.partitionBy(key).orderBy(F.col("score").desc_nulls_last(), F.col(id_col))
        return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)

    found = best(out, "_vector").drop("rank")
    # each query with the neighbours of its vector; a query id that comes with several vectors is ranked over all of them
    vectors = asked.join(q, ["vec", "group"]).select("query_id", "_vector")
    res = best(vectors.join(found, "_vector").drop("_vector"), "query_id")
    rest = [x for x in candidates.columns if x not in (vec_col, *filter_cols)]
    if len(rest) > 1:
        res = res.join(candidates.select(*rest), id_col)
    if score_digits is not None:
        res = res.withColumn("score", F.round("score", score_digits))
    return res


#: approximate search: projections that must agree together, groups of them of which one must agree, width of a projection's buckets
LSH_WIDTH, LSH_TOGETHER, LSH_GROUPS = 0.25, 4, 32


def approx_topk(queries: DataFrame, candidates: DataFrame, top_k: int = TOP_K, id_col: str = "chunk_id", vec_col: str = "embedding",
                width: float = LSH_WIDTH, together: int = LSH_TOGETHER, groups: int = LSH_GROUPS, seed: int = 11) -> DataFrame:
    """Approximate cosine top-k: (query_id, id, score, rank, candidates).

    Random projections of the unit vectors (Spark ML's bucketed random
    projections) are joined on the buckets of ``together`` of them at a time, in
    ``groups`` groups; the pairs found are ranked by their exact cosine.
    ``candidates`` is the number of pairs priced for the query: the search's
    cost, as recall against ``vector_topk`` is its quality. Vectors without
    structure (tenth neighbours at a cosine of 0.3) need most pairs for a recall
    of 0.9; clustered ones few, with more projections together. Zero and null
    vectors have no bucket.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector, vector_to_array
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x))

    def unit(rows: DataFrame, key: str, vec: str) -> DataFrame:
        v = rows.select(F.col(key).alias("key"), F.col(vec).cast("array<double>").alias("v")).withColumn("norm", size).where("norm > 0")
        return v.select("key", "v", array_to_vector(F.transform("v", lambda x: x / F.col("norm"))).alias("unit"))

    c = unit(candidates, id_col, vec_col)
    model = BucketedRandomProjectionLSH(inputCol="unit", outputCol="hashes", bucketLength=width, numHashTables=together * groups, seed=seed).fit(c)

    def dealt(rows: DataFrame) -> DataFrame:
        hashed = model.transform(rows).select("key", F.posexplode("hashes").alias("i", "h"))
        each = hashed.select("key", (F.col("i") / together).cast("int").alias("g"), "i", F.element_at(vector_to_array("h"), 1).cast("int").alias("b"))
        return each.groupBy("key", "g").agg(F.sort_array(F.collect_list(F.struct("i", "b"))).alias("bs")).select("key", "g", F.xxhash64("g", F.col("bs.b")).alias("bucket"))

    q = unit(queries, "query_id", "qvec")
    pairs = dealt(q).withColumnRenamed("key", "query_id").join(dealt(c), ["g", "bucket"]).select("query_id", "key").distinct()
    scored = (pairs.join(q.select(F.col("key").alias("query_id"), F.col("v").alias("qv")), "query_id").join(c.select("key", "v"), "key")
              .select("query_id", F.col("key").alias(id_col), cosine(F.col("qv"), F.col("v")).alias("score")))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc_nulls_last(), F.col(id_col))
    priced = pairs.groupBy("query_id").agg(F.count(F.lit(1)).alias("candidates"))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k).join(priced, "query_id")


def label_centroids(emb: DataFrame, key: str = "label", vec: str = "embedding") -> DataFrame:
    """Element-wise mean vector per key (query vectors from the data)."""
    e = emb.select(key, F.posexplode(vec).alias("pos", "x"))
    m = e.groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    c = m.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("_v"))
    return c.select(F.col(key).alias("query_id"), F.col(key), F.transform("_v", lambda s: s["x"]).alias("qvec"))


def retrieve_dedup(queries: DataFrame, store: DataFrame, top_k: int = TOP_K, overfetch: int = OVERFETCH,
                   embedder=None, dim: int = DEFAULT_DIM) -> DataFrame:
    """Vector path of retrieval: fetch overfetch*k candidates per query,
    keep the best chunk per patient in score order, cut to k (may be < k)."""
    qv = embed_queries(queries, embedder, dim)
    cand = vector_topk(qv, store, top_k=top_k * overfetch)
    w_p = Window.partitionBy("query_id", "patient_id").orderBy("rank")
    first = cand.withColumn("_pr", F.row_number().over(w_p)).where(F.col("_pr") == 1)
    w_q = Window.partitionBy("query_id").orderBy("rank")
    out = first.withColumn("rank", F.row_number().over(w_q)).where(F.col("rank") <= top_k)
    return out.drop("_pr")


def retrieve_batch(queries: DataFrame, store: DataFrame, top_k: int = TOP_K, embedder=None,
                   dim: int = DEFAULT_DIM) -> DataFrame:
    """Full retrieval for a table of (query_id, query): the name path when a
    name is detected and has hits (results not de-duplicated), else the
    vector path with per-patient de-duplication. Questions that fail the input
    check (empty or too long) are not searched; the others are trimmed."""
    queries = written(validate_queries(queries).where(F.col("reason").isNull()).drop("reason"))
    named = detect_names(queries)
    by_name = retrieve_by_name(named, store, top_k).withColumn("path", F.lit("name"))
    answered = by_name.select("query_id").distinct()
    rest = queries.join(answered, "query_id", "left_anti")
    by_vec = retrieve_dedup(rest, store, top_k, embedder=embedder, dim=dim).withColumn("path", F.lit("vector"))
    cols = ["query_id", "rank", "chunk_id", "patient_id", "document", "patient_name", "visit_date",
            "department", "doctor_name", "diagnosis_codes", "has_followup", "score", "path"]
    return by_name.select(*cols).unionByName(by_vec.select(*cols))


# ------------------------------------------------------------- prompts ----
def build_prompts(queries: DataFrame, results: DataFrame, system_prompt: str = DEFAULT_SYSTEM_PROMPT) -> DataFrame:
    """Per query: system prompt with the ranked chunk texts joined by
    '\\n\\n---\\n\\n', the number of chunks, and the fixed answer when none."""
    ctx = results.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "document"))).alias("_docs"),
        F.count(F.lit(1)).alias("chunks_retrieved"))
    j = queries.select("query_id", "query").join(ctx, "query_id", "left")
    context = F.array_join(F.transform("_docs", lambda d: d["document"]), CONTEXT_SEPARATOR)
    n = F.coalesce(F.col("chunks_retrieved"), F.lit(0).cast("bigint"))
    return j.select(
        "query_id", "query",
        F.when(n > 0, F.replace(F.lit(system_prompt), F.lit(CONTEXT_PLACEHOLDER), context)).alias("system_prompt"),
        n.alias("chunks_retrieved"),
        F.when(n == 0, F.lit(NO_RESULT_ANSWER)).alias("answer"))


def sources(results: DataFrame) -> DataFrame:
    """Citation rows per query in rank order."""
    return results.select("query_id", "rank", "patient_id", "patient_name", "visit_date", "department")


def generate_answers(prompts: DataFrame, generate_fn=None, factory=None) -> DataFrame:
    """Run a text generator over the prompts table with mapInPandas.

    ``generate_fn(system_prompt, query) -> str`` is called once per row on
    the workers; a model that is dear to load is given as ``factory(mode)``,
    which runs once per worker process (mode "answer") and returns such a
    function. The default is extractive (first chunk of the context).
    """
    import uuid

    import pandas as pd

    from clinlytics.functions.pyudfs import once_per_worker
    ship_package(prompts.sparkSession)

    def _default(system_prompt, query):
        if system_prompt is None:
            return None
        body = system_prompt.split("PATIENT RECORDS:\n", 1)[-1]
        return body.split(CONTEXT_SEPARATOR, 1)[0]

    load = once_per_worker(factory or (lambda mode: generate_fn or _default), uuid.uuid4().hex, "answer")

    def _run(batches):
        fn = load()
        for pdf in batches:
            ans = [a if isinstance(a, str) else fn(sp, q)
                   for sp, q, a in zip(pdf["system_prompt"], pdf["query"], pdf["answer"])]
            yield pd.DataFrame({"query_id": pdf["query_id"], "answer": ans,
                                "chunks_retrieved": pdf["chunks_retrieved"]})

    schema = f"query_id {dict(prompts.dtypes)['query_id']}, answer string, chunks_retrieved bigint"
    return prompts.mapInPandas(_run, schema)


def answers_with_sources(answers: DataFrame, results: DataFrame) -> DataFrame:
    """Each answer with its sources nested in rank order: query_id, answer, chunks_retrieved, sources."""
    one = F.struct("rank", "patient_id", "patient_name", "visit_date", "department")
    cited = results.groupBy("query_id").agg(F.sort_array(F.collect_list(one)).alias("sources"))  # at most top_k a query
    return answers.join(cited, "query_id", "left").withColumn("sources", F.coalesce("sources", F.array()))


# Accepted question length.
QUERY_MAX_CHARS = 500


def validate_queries(queries: DataFrame) -> DataFrame:
    """Trim questions; reject empty and over-long ones with a reason."""
    q = F.col("query")
    trimmed = strip_ws(q)
    return queries.withColumn("query", trimmed).withColumn(
        "reason", F.when(q.isNull() | (trimmed == ""), F.lit("Query is required"))
        .when(F.length(trimmed) > QUERY_MAX_CHARS, F.lit("Query too long (max 500 characters)")))


def ensure_store(spark, store_root: str, summaries: DataFrame, embedder=None) -> DataFrame:
    """The store at ``store_root``, ingesting all summaries first when it is
    missing or empty (auto-ingest)."""
    from clinlytics.operators import upsert as up
    cur = up.read_table(spark, store_root)
    if cur is None or cur.isEmpty():
        up.upsert_table(spark, store_root, build_store(summaries, embedder=embedder), ["chunk_id"])
        cur = up.read_table(spark, store_root)
    return cur
