"""Models are loaded once per worker, in document and query mode."""
import glob
import os
import tempfile

from clinlytics.functions.vectors import model_embedder
from clinlytics.operators import retrieval as rg


def _counted(folder):
    """A factory that leaves a file for every time it runs."""
    def factory(mode):
        import os as o
        import uuid
        open(f"{folder}/{mode}-{o.getpid()}-{uuid.uuid4().hex}", "w").close()
        if mode == "answer":
            return lambda prompt, query: f"{query}!"
        return lambda texts: [[float(len(t)), 1.0 if mode == "query" else 0.0] for t in texts]
    return factory


def test_a_model_is_loaded_once_per_worker_and_mode(spark):
    folder = tempfile.mkdtemp(prefix="model-", dir="/tmp")
    embed = model_embedder(None, 2, factory=_counted(folder))
    docs = spark.createDataFrame([(f"c{i}", "x" * i) for i in range(400)], "chunk_id string, document string").repartition(16)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        got = {r.chunk_id: list(r.embedding) for r in rg.embed_chunks(docs, embed).collect()}
        assert got == {f"c{i}": [float(i), 0.0] for i in range(400)}
        asked = rg.embed_queries(docs.selectExpr("chunk_id AS query_id", "document AS query"), embed)
        assert all(list(r.qvec) == [float(r.query_id[1:]), 1.0] for r in asked.collect())
        prompts = docs.selectExpr("chunk_id AS query_id", "document AS query", "'p' AS system_prompt", "CAST(NULL AS STRING) AS answer", "1L AS chunks_retrieved")
        assert all(r.answer.endswith("!") for r in rg.generate_answers(prompts, factory=_counted(folder)).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    loads = [os.path.basename(f).split("-")[:2] for f in glob.glob(f"{folder}/*")]
    assert len(loads) == len(set(map(tuple, loads))) and {m for m, _ in loads} == {"document", "query", "answer"}


def test_answers_nest_their_sources(spark):
    found = spark.createDataFrame([("a", 2, 7, "B", "2024-01-02", "d"), ("a", 1, 8, "A", "2024-01-03", "e")], "query_id string, rank int, patient_id long, patient_name string, visit_date string, department string")
    answers = spark.createDataFrame([("a", "yes", 2), ("b", "none", 0)], "query_id string, answer string, chunks_retrieved bigint")
    out = {r.query_id: r for r in rg.answers_with_sources(answers, found).collect()}
    assert [s.patient_id for s in out["a"].sources] == [8, 7] and out["b"].sources == []


def test_questions_are_checked_before_the_search(spark):
    store = rg.build_store(spark.createDataFrame([(1, "PATIENT: Ann Lee | x\n\nVISIT 1 [2024-01-01]\nDr. X, Y\nDiagnosis: flu")], "patient_id long, summary_text string"))
    asked = spark.createDataFrame([(1, "  Show Ann Lee "), (2, "   "), (3, None), (4, "flu " * 200), (5, "who has flu")], "query_id long, query string")
    assert {r.query_id: r.path for r in rg.retrieve_batch(asked, store).collect()} == {1: "name", 5: "vector"}
