"""Registered queries and oracles: retrieval (chunks, names, vectors, prompts)."""
from __future__ import annotations

from pyspark.sql import functions as F

from clinlytics.operators import jobs
from clinlytics.operators import retrieval as rg
from clinlytics.plans.catalog_jobs import _SUMMARY_CTES
from clinlytics.plans.oracle_base import with_clinic
from clinlytics.session import written
from clinlytics.sources.driver import clinic_tables, materialized


def retrieval_queries(t):
    """Questions derived from the data: one by name per active patient and
    one per distinct diagnosis."""
    p = t["patients"].where(F.col("is_active")).select(
        F.concat(F.lit("name:"), F.col("id").cast("string")).alias("query_id"),
        F.concat(F.lit("Show visits for "), F.col("first_name"), F.lit(" "), F.col("last_name"), F.lit("?"))
        .alias("query"))
    d = t["visits"].select("diagnosis").distinct().select(
        F.concat(F.lit("dx:"), F.col("diagnosis")).alias("query_id"),
        F.concat(F.lit("which patients have "), F.col("diagnosis")).alias("query"))
    return p.unionByName(d)


def _summaries(t):
    """The summaries that the store ingests: written once per session."""
    return materialized(t.spark, f"summaries:{t.sf_dir}", lambda: jobs.clinical_summaries(t))


def _store(t):
    """The chunk store is an ingested table: built once per session."""
    return materialized(t.spark, f"store:{t.sf_dir}", lambda: rg.build_store(_summaries(t)))


def _named_results(t):
    return rg.retrieve_by_name(rg.detect_names(retrieval_queries(t)), _store(t))


def _emb_queries(t):
    e = t.driver("embeddings")
    return rg.label_centroids(e)


def _vector_topk(t):
    e = t.driver("embeddings").select("vec_id", "embedding")
    q = _emb_queries(t).select("query_id", "qvec")
    return rg.vector_topk(q, e, id_col="vec_id", score_digits=6).select("query_id", "rank", "vec_id", "score")


def _vector_topk_filtered(t):
    e = t.driver("embeddings").select("vec_id", "embedding", "label")
    q = _emb_queries(t)
    return rg.vector_topk(q, e, id_col="vec_id", filter_cols=["label"], score_digits=6) \
        .select("query_id", "rank", "vec_id", "score")


def _dx_queries(t):
    return retrieval_queries(t).where(F.col("query_id").startswith("dx:"))


def _q(fn):
    def run(spark, sf_dir):
        return fn(clinic_tables(spark, sf_dir))
    return run


def _answers(t):
    """Extractive answers to all questions by name, each with its sources."""
    q, found = retrieval_queries(t), written(_named_results(t))
    out = rg.answers_with_sources(rg.generate_answers(rg.build_prompts(q, found)), found)
    one = F.transform("sources", lambda s: F.concat_ws("|", s["rank"].cast("string"), s["patient_id"].cast("string"), s["patient_name"], s["visit_date"], s["department"]))
    return out.select("query_id", "answer", "chunks_retrieved", F.array_join(one, ";").alias("cited"))


_RESULT_COLS = ["query_id", "rank", "chunk_id", "patient_id", "visit_date", "score"]

QUERIES = {
    "chunk_summaries": _q(lambda t: rg.chunk_summaries(jobs.clinical_summaries(t))
                          .select("chunk_id", "patient_id", "document")),
    "chunk_metadata": _q(lambda t: rg.chunk_summaries(jobs.clinical_summaries(t)).drop("document")),
    "detect_names": _q(lambda t: rg.detect_names(retrieval_queries(t))),
    "retrieve_by_name": _q(lambda t: _named_results(t).select(*_RESULT_COLS)),
    "vector_topk": _q(_vector_topk),
    "vector_topk_filtered": _q(_vector_topk_filtered),
    "retrieve_dedup": _q(lambda t: rg.retrieve_dedup(_dx_queries(t), _store(t))
                         .select(*_RESULT_COLS[:-1], F.round("score", 9).alias("score"))),
    "build_prompts": _q(lambda t: rg.build_prompts(retrieval_queries(t), _named_results(t))),
    "sources": _q(lambda t: rg.sources(_named_results(t))),
    "answers": _q(_answers),
    "store_status": _q(lambda t: rg.store_status(_store(t))),
    "ingest_stats": _q(lambda t: rg.ingest_stats(_summaries(t), _store(t))),
    "retrieve_batch": _q(lambda t: rg.retrieve_batch(retrieval_queries(t), _store(t))
                         .select(*_RESULT_COLS[:-1], F.round("score", 9).alias("score"), "path")),
}

_STOP = ", ".join(f"'{w}'" for w in (
    "cardiology", "gastroenterology", "hepatology", "medicine", "diagnosis", "patient", "show", "what",
    "which", "find", "list", "how", "who", "are", "is", "me", "the", "for", "with", "and", "or", "in", "on"))

_RAG_CTES = _SUMMARY_CTES + f""",
chunks AS (
  SELECT patient_id || '_visit_' || CAST(rn AS VARCHAR) AS chunk_id, patient_id,
    rtrim(header || chr(10) || chr(10) || block, ' ' || chr(9) || chr(10) || chr(13)) AS document,
    trim(full_name) AS patient_name, strftime(visit_date, '%Y-%m-%d') AS visit_date,
    block, visit_id
  FROM blocks),
chunk_meta AS (
  SELECT c.chunk_id, c.patient_id, c.patient_name, c.visit_date, trim(v.department_name) AS department,
    trim(v.doctor_name) AS doctor_name,
    CASE WHEN v.diagnosis_code <> '' THEN regexp_extract(v.diagnosis_code, '^[A-Z][0-9]+\\.?[0-9]*') ELSE '' END
      AS diagnosis_codes,
    v.follow_up_date IS NOT NULL AS has_followup
  FROM chunks c JOIN visit_rows v ON v.visit_id = c.visit_id),
rq AS (
  SELECT 'name:' || CAST(id AS VARCHAR) AS query_id,
    'Show visits for ' || first_name || ' ' || last_name || '?' AS query FROM patients WHERE is_active
  UNION ALL
  SELECT DISTINCT 'dx:' || diagnosis, 'which patients have ' || diagnosis FROM visits),
rq_words AS (
  SELECT query_id, query,
    list_transform(list_filter(regexp_split_to_array(query, '\\s+'), lambda w: w <> ''),
                   lambda w: regexp_replace(w, '[.,?]+$', '')) AS ws FROM rq),
detected AS (
  SELECT query_id, query,
    list_filter(list_transform(range(1, len(ws)), lambda i: [ws[i], ws[i + 1]]),
      lambda p: length(p[1]) > 2 AND length(p[2]) > 2 AND regexp_matches(p[1], '^\\p{{Lu}}')
                AND regexp_matches(p[2], '^\\p{{Lu}}') AND lower(p[1]) NOT IN ({_STOP})
                AND lower(p[2]) NOT IN ({_STOP}))[1] AS hit
  FROM rq_words),
names AS (SELECT query_id, query, hit[1] || ' ' || hit[2] AS detected_name FROM detected),
name_hits AS (
  SELECT query_id, unnest(list_filter(a.l, lambda x: x.pn ILIKE '%' || n.detected_name || '%')).id AS chunk_id
  FROM names n, (SELECT list({{'pn': patient_name, 'id': chunk_id}}) AS l FROM chunk_meta) a
  WHERE n.detected_name IS NOT NULL),
named AS (
  SELECT h.query_id, m.chunk_id, m.patient_id, m.visit_date, CAST(1.0 AS DOUBLE) AS score, c.document, m.patient_name,
    m.department,
    ROW_NUMBER() OVER (PARTITION BY h.query_id ORDER BY m.visit_date DESC, m.chunk_id) AS rank
  FROM name_hits h JOIN chunk_meta m ON m.chunk_id = h.chunk_id
  JOIN chunks c ON c.chunk_id = m.chunk_id
  QUALIFY rank <= 10),
emb AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
cent AS (
  SELECT label, list(x ORDER BY pos) AS qv FROM (
    SELECT label, pos, avg(x) AS x FROM (
      SELECT label, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS pos FROM emb) GROUP BY label, pos)
  GROUP BY label),
scored AS (
  SELECT c.label AS query_id, e.vec_id, e.label AS vlabel,
    CASE WHEN list_dot_product(e.v, e.v) > 0 AND list_dot_product(c.qv, c.qv) > 0 THEN
      list_dot_product(e.v, c.qv) / (sqrt(list_dot_product(e.v, e.v)) * sqrt(list_dot_product(c.qv, c.qv))) END
      AS score
  FROM emb e, cent c),
tok AS (
  SELECT chunk_id, patient_id, unnest(list_filter(regexp_split_to_array(lower(document), '[^\\p{{L}}\\p{{N}}]+'),
                                          lambda s: s <> '')) AS t FROM chunks),
qtok AS (
  SELECT query_id, unnest(list_filter(regexp_split_to_array(lower(query), '[^\\p{{L}}\\p{{N}}]+'),
                                      lambda s: s <> '')) AS t FROM rq WHERE query_id LIKE 'dx:%'),
cvec AS (
  SELECT chunk_id, patient_id, CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % 64 AS b,
    SUM(CASE WHEN CAST('0x' || substr(md5(t), 9, 1) AS INTEGER) % 2 = 0 THEN 1 ELSE -1 END) AS x
  FROM tok GROUP BY ALL),
qvec AS (
  SELECT query_id, CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % 64 AS b,
    SUM(CASE WHEN CAST('0x' || substr(md5(t), 9, 1) AS INTEGER) % 2 = 0 THEN 1 ELSE -1 END) AS x
  FROM qtok GROUP BY ALL),
cn AS (SELECT chunk_id, SUM(x * x) AS n FROM cvec GROUP BY chunk_id),
qn AS (SELECT query_id, SUM(x * x) AS n FROM qvec GROUP BY query_id),
vdot AS (
  SELECT q.query_id, c.chunk_id, ANY_VALUE(c.patient_id) AS patient_id, SUM(q.x * c.x) AS d
  FROM qvec q JOIN cvec c ON c.b = q.b GROUP BY q.query_id, c.chunk_id),
vscore AS (
  SELECT v.query_id, v.chunk_id, v.patient_id,
    CASE WHEN qn.n > 0 AND cn.n > 0 THEN CAST(v.d AS DOUBLE) / (sqrt(CAST(qn.n AS DOUBLE)) * sqrt(CAST(cn.n AS DOUBLE))) END
      AS score
  FROM vdot v JOIN qn ON qn.query_id = v.query_id JOIN cn ON cn.chunk_id = v.chunk_id),
cand AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, chunk_id) AS crank
  FROM vscore QUALIFY crank <= 30),
dedup AS (
  SELECT * FROM cand QUALIFY ROW_NUMBER() OVER (PARTITION BY query_id, patient_id ORDER BY crank) = 1)
,
qtok_b AS (
  SELECT query_id, unnest(list_filter(regexp_split_to_array(lower(query), '[^\\p{{L}}\\p{{N}}]+'),
                                      lambda s: s <> '')) AS t FROM rq WHERE query_id NOT IN (SELECT query_id FROM named)),
qvec_b AS (
  SELECT query_id, CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % 64 AS b,
    SUM(CASE WHEN CAST('0x' || substr(md5(t), 9, 1) AS INTEGER) % 2 = 0 THEN 1 ELSE -1 END) AS x
  FROM qtok_b GROUP BY ALL),
qn_b AS (SELECT query_id, SUM(x * x) AS n FROM qvec_b GROUP BY query_id),
vdot_b AS (
  SELECT q.query_id, c.chunk_id, ANY_VALUE(c.patient_id) AS patient_id, SUM(q.x * c.x) AS d
  FROM qvec_b q JOIN cvec c ON c.b = q.b GROUP BY q.query_id, c.chunk_id),
vscore_b AS (
  SELECT v.query_id, v.chunk_id, v.patient_id,
    CASE WHEN qn.n > 0 AND cn.n > 0 THEN CAST(v.d AS DOUBLE) / (sqrt(CAST(qn.n AS DOUBLE)) * sqrt(CAST(cn.n AS DOUBLE))) END
      AS score
  FROM vdot_b v JOIN qn_b qn ON qn.query_id = v.query_id JOIN cn ON cn.chunk_id = v.chunk_id),
cand_b AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, chunk_id) AS crank
  FROM vscore_b QUALIFY crank <= 30),
dedup_b AS (
  SELECT * FROM cand_b QUALIFY ROW_NUMBER() OVER (PARTITION BY query_id, patient_id ORDER BY crank) = 1)
"""

_PROMPT = rg.DEFAULT_SYSTEM_PROMPT.replace("'", "''").replace("\n", "' || chr(10) || '")
_ANSWER = rg.NO_RESULT_ANSWER.replace("'", "''")

ORACLES = {
    "chunk_summaries": with_clinic("SELECT chunk_id, patient_id, document FROM chunks", _RAG_CTES),
    "chunk_metadata": with_clinic("SELECT * FROM chunk_meta", _RAG_CTES),
    "detect_names": with_clinic("SELECT query_id, query, detected_name FROM names", _RAG_CTES),
    "retrieve_by_name": with_clinic(
        "SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, patient_id, visit_date, score FROM named",
        _RAG_CTES),
    "vector_topk": with_clinic("""
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, round(score, 6) AS score FROM (
          SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, vec_id) AS rank
          FROM scored) WHERE rank <= 10""", _RAG_CTES),
    "vector_topk_filtered": with_clinic("""
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, round(score, 6) AS score FROM (
          SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, vec_id) AS rank
          FROM scored WHERE vlabel = query_id) WHERE rank <= 10""", _RAG_CTES),
    "retrieve_dedup": with_clinic("""
        SELECT d.query_id, CAST(ROW_NUMBER() OVER (PARTITION BY d.query_id ORDER BY d.crank) AS INTEGER) AS rank,
          d.chunk_id, d.patient_id, m.visit_date, round(d.score, 9) AS score
        FROM dedup d JOIN chunk_meta m ON m.chunk_id = d.chunk_id
        QUALIFY rank <= 10""", _RAG_CTES),
    "build_prompts": with_clinic(f"""
        SELECT q.query_id, q.query,
          CASE WHEN COALESCE(c.n, 0) > 0 THEN replace('{_PROMPT}', '{rg.CONTEXT_PLACEHOLDER}', c.ctx) END
            AS system_prompt,
          COALESCE(c.n, 0) AS chunks_retrieved,
          CASE WHEN COALESCE(c.n, 0) = 0 THEN '{_ANSWER}' END AS answer
        FROM rq q LEFT JOIN (
          SELECT query_id, COUNT(*) AS n,
            string_agg(document, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS ctx
          FROM named GROUP BY query_id) c ON c.query_id = q.query_id""", _RAG_CTES),
    "sources": with_clinic(
        "SELECT query_id, CAST(rank AS INTEGER) AS rank, patient_id, patient_name, visit_date, department FROM named",
        _RAG_CTES),
    "answers": with_clinic(f"""
        SELECT q.query_id, CASE WHEN COALESCE(c.n, 0) = 0 THEN '{_ANSWER}' ELSE c.first END AS answer, COALESCE(c.n, 0) AS chunks_retrieved, COALESCE(c.cited, '') AS cited
        FROM rq q LEFT JOIN (
          SELECT query_id, COUNT(*) AS n, arg_min(document, rank) AS first,
            string_agg(concat_ws('|', rank, patient_id, patient_name, visit_date, department), ';' ORDER BY rank) AS cited
          FROM named GROUP BY query_id) c ON c.query_id = q.query_id""", _RAG_CTES),
    "ingest_stats": with_clinic("""
        SELECT (SELECT COUNT(*) FROM chunks) AS chunks_ingested,
          (SELECT COUNT(*) FROM summaries WHERE trim(summary_text) <> '') AS patients_processed,
          (SELECT COUNT(*) FROM summaries WHERE summary_text IS NULL OR trim(summary_text) = '') AS patients_skipped,
          (SELECT COUNT(*) FROM chunks) AS total_in_store""", _RAG_CTES),
    "retrieve_batch": with_clinic("""
        SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, patient_id, visit_date, score, 'name' AS path
        FROM named
        UNION ALL
        SELECT d.query_id, CAST(ROW_NUMBER() OVER (PARTITION BY d.query_id ORDER BY d.crank) AS INTEGER) AS rank,
          d.chunk_id, d.patient_id, m.visit_date, round(d.score, 9) AS score, 'vector' AS path
        FROM dedup_b d JOIN chunk_meta m ON m.chunk_id = d.chunk_id
        QUALIFY rank <= 10""", _RAG_CTES),
    "store_status": with_clinic(
        "SELECT COUNT(*) AS chunks, TIMESTAMP '2001-07-15 00:00:00' AS last_ingested, COUNT(*) > 0 AS ready "
        "FROM chunks", _RAG_CTES),
}
