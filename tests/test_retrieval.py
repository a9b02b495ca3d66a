"""Chunking, metadata, name detection, vector search."""
import numpy as np
from pyspark.sql import functions as F

from clinlytics.functions.text import detect_name
from clinlytics.functions.vectors import hash_embed, hash_embed_table
from clinlytics.operators import jobs
from clinlytics.operators import retrieval as rg
from tests import seed


def _chunks(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "patient_id long, summary_text string")
    return sorted(rg.chunk_summaries(df).collect(), key=lambda r: r.chunk_id)


def test_seed_chunk(spark):
    t = seed.tables(spark)
    ch = rg.chunk_summaries(jobs.clinical_summaries(t, as_of=seed.AS_OF)).collect()
    assert [c.chunk_id for c in ch] == ["1_visit_1"]
    c = ch[0]
    assert c.patient_name == "Ramesh Nayak" and c.department == "Cardiology"
    assert c.doctor_name == "Dr. Rajesh Mohanty" and c.diagnosis_codes == "I20.9" and c.has_followup
    assert c.visit_date == seed.AS_OF.isoformat()


def test_chunk_edge_cases(spark):
    texts = [
        "VISIT 1 [2020-01-01]\nDr. A, Dep\n",                       # no header
        "intro line\nPATIENT: X Y | Age: 1\nstray\nVISIT 1 [2020-01-02]\nline",  # VISIT-less stray lines
        "PATIENT: Only Header | Age: 3",                          # header only
        "PATIENT: Z W | Age: 2\n\nVISIT 1 [2020-01-03] and [2021-02-03]\n  \nFollow-up Notes: x",
        "   \n\t",                                                  # blank: skipped
    ]
    got = {c.chunk_id: c for c in _chunks(spark, texts)}
    assert set(got) == {"0_visit_1", "1_visit_0", "1_visit_1", "3_visit_1"}
    assert got["0_visit_1"].document == "VISIT 1 [2020-01-01]\nDr. A, Dep"
    assert got["0_visit_1"].patient_name == "" and got["0_visit_1"].department == "Dep"
    assert got["1_visit_0"].document == "PATIENT: X Y | Age: 1\n\nstray"
    assert got["1_visit_1"].patient_name == "X Y"
    # first date of the line wins inside a line; 'Follow-up Notes:' is not a follow-up
    assert got["3_visit_1"].visit_date == "2020-01-03" and not got["3_visit_1"].has_followup


def test_last_matching_line_wins(spark):
    text = "PATIENT: A B | x\n\nVISIT 1 [2020-01-01]\n[2021-05-06] again\nICD-10: A1\nICD-10: B22.3"
    c = _chunks(spark, [text])[0]
    assert c.visit_date == "2021-05-06" and c.diagnosis_codes == "B22.3"


def test_detect_name(spark):
    qs = ["what medications is Ramesh Nayak on?", "Show Cardiology patients", "Stable Angina patients",
          "? Ramesh", "Ab Cd Ef Gh", "list Ramesh, Nayak."]
    df = spark.createDataFrame([(q,) for q in qs], "q string")
    got = [r.n for r in df.select(detect_name(F.col("q")).alias("n")).collect()]
    assert got == ["Ramesh Nayak", None, "Stable Angina", None, None, "Ramesh Nayak"]


def test_embedders_agree(spark):
    df = spark.createDataFrame([(1, "Diagnosis: diagnosis 3, Dr. X"), (2, ""), (3, "a a a b")],
                               "chunk_id long, document string")
    row_wise = {r.chunk_id: list(r.e) for r in df.select("chunk_id", hash_embed(F.col("document")).alias("e")).collect()}
    table = {r.chunk_id: list(r.embedding) for r in hash_embed_table(df, "chunk_id", "document").collect()}
    assert row_wise == table
    assert sum(abs(x) for x in table[2]) == 0


def test_vector_topk_matches_numpy(spark):
    rng = np.random.default_rng(7)
    vecs = rng.normal(size=(300, 8)).astype("float32")
    qs = rng.normal(size=(4, 8))
    cand = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(j, v.tolist()) for j, v in enumerate(qs)], "query_id long, qvec array<double>")
    got = rg.vector_topk(q, cand, top_k=5, id_col="vec_id").collect()
    v64 = vecs.astype("float64")
    for j in range(4):
        s = v64 @ qs[j] / (np.linalg.norm(v64, axis=1) * np.linalg.norm(qs[j]))
        want = list(np.argsort(-s, kind="stable")[:5])
        mine = [r.vec_id for r in sorted((r for r in got if r.query_id == j), key=lambda r: r.rank)]
        assert mine == want


def test_dedup_keeps_one_chunk_per_patient(spark, small):
    store = rg.build_store(jobs.clinical_summaries(small))
    q = spark.createDataFrame([("q1", "which patients have diagnosis 3")], "query_id string, query string")
    res = rg.retrieve_dedup(q, store, top_k=10).collect()
    pats = [r.patient_id for r in res]
    assert len(pats) == len(set(pats)) and 0 < len(pats) <= 10
    assert [r.rank for r in sorted(res, key=lambda r: r.rank)] == list(range(1, len(res) + 1))


def test_prompts_and_no_result_answer(spark):
    q = spark.createDataFrame([("a", "x"), ("b", "y")], "query_id string, query string")
    res = spark.createDataFrame([("a", 2, "doc2"), ("a", 1, "doc1")], "query_id string, rank int, document string")
    out = {r.query_id: r for r in rg.build_prompts(q, res).collect()}
    assert out["a"].system_prompt.endswith("doc1\n\n---\n\ndoc2") and out["a"].chunks_retrieved == 2
    assert out["b"].system_prompt is None and out["b"].answer == rg.NO_RESULT_ANSWER
    ans = {r.query_id: r.answer for r in rg.generate_answers(rg.build_prompts(q, res)).collect()}
    assert ans["a"] == "doc1" and ans["b"] == rg.NO_RESULT_ANSWER


def test_vector_topk_cells_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(1)
    vecs = rng.normal(size=(50, 4)).astype("float32").tolist()
    vecs += vecs[:10] + [[0.0] * 4, None]  # ties, a zero and a missing vector
    cand = spark.createDataFrame([(i, v, i % 3 if i % 5 else None) for i, v in enumerate(vecs)], "vec_id long, embedding array<float>, label int")
    q = spark.createDataFrame([(f"q{j}", rng.normal(size=4).tolist(), j % 3) for j in range(7)] + [("none", None, 1), ("zero", [0.0] * 4, 0)], "query_id string, qvec array<double>, label int")
    for filters in ([], ["label"]):
        for k in (3, 70):
            whole = sorted(map(str, rg.vector_topk(q, cand, top_k=k, id_col="vec_id", filter_cols=filters).collect()))
            with monkeypatch.context() as m:
                m.setattr(rg, "QUERY_BLOCK", 2)
                m.setattr(rg, "VECTOR_BLOCK", 9)
                assert sorted(map(str, rg.vector_topk(q, cand, top_k=k, id_col="vec_id", filter_cols=filters).collect())) == whole
            if not filters:
                assert len(whole) == 8 * min(k, 62)
            if k == 70:
                plan = rg.vector_topk(q, cand, top_k=k, id_col="vec_id", filter_cols=filters)._jdf.queryExecution().toString()
                assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_approximate_search_is_measured(spark):
    from clinlytics.sources.driver import clinic_tables
    from tests.conftest import SF_SMALL
    emb = clinic_tables(spark, SF_SMALL).driver("embeddings")
    centres = np.random.default_rng(3).normal(size=(40, 32))
    near = centres[np.arange(800) % 40] + 0.1 * np.random.default_rng(4).normal(size=(800, 32))
    clustered = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(near)], "vec_id long, embedding array<double>")
    for vectors, most, how in ((emb, 0.85, {}), (clustered, 0.15, {"together": 10, "width": 0.5})):
        q = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
        c = vectors.select("vec_id", "embedding")
        exact = {(r.query_id, r.vec_id) for r in rg.vector_topk(q, c, top_k=10, id_col="vec_id").collect()}
        rows = rg.approx_topk(q, c, top_k=10, id_col="vec_id", **how).collect()
        recall = len(exact & {(r.query_id, r.vec_id) for r in rows}) / len(exact)
        share = sum({r.query_id: r.candidates for r in rows}.values()) / (q.count() * c.count())
        assert recall >= 0.9 and share <= most, (recall, share)


NAMES = ["Ann Lee", "ann leeds", "Jo Ann Lee", "Bo", "Al_x Ray", "Al%x Roy", "X", "Back\\slash Man", "\u00c9va Kiss", "A B", ""]


def test_names_are_found_as_ilike_finds_them(spark):
    import duckdb
    patterns = ["Ann Lee", "ANN LEE", "n L", "o", "Al\\_x", "Al_x", "%x R_y", "__", "_", "%", "%%", "lee%ds", "zzz", "Bo_", "\u00e9va", "A_B", "slash", "ck\\\\sl", "_______________________________________"]
    store = spark.createDataFrame([(f"{i}_visit_{v}", i, "doc", n, f"2024-01-0{v}", "d", "dr", "", False) for i, n in enumerate(NAMES) for v in (1, 2)] + [("x", 99, "doc", None, "2024-01-01", "d", "dr", "", False)],
                                  "chunk_id string, patient_id long, document string, patient_name string, visit_date string, department string, doctor_name string, diagnosis_codes string, has_followup boolean")
    queries = spark.createDataFrame([(i, p) for i, p in enumerate(patterns)] + [(100, None)], "query_id long, detected_name string")
    out = rg.retrieve_by_name(queries, store, top_k=100)
    got = {(r.query_id, r.chunk_id) for r in out.collect()}
    con = duckdb.connect()
    want = {(i, f"{j}_visit_{v}") for i, p in enumerate(patterns) for j, n in enumerate(NAMES) for v in (1, 2)
            if con.execute("SELECT ? ILIKE '%' || ? || '%' ESCAPE '\\'", [n, p]).fetchone()[0]}
    assert got == want and len(want) > 40
    plan = rg.retrieve_by_name(rg.detect_names(queries.selectExpr("query_id", "concat('show ', detected_name) AS query")), store)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan and plan.count("array_contains") == 0


def test_equal_names_and_equal_vectors_are_searched_once(spark, monkeypatch):
    store = spark.createDataFrame([(f"{i}_visit_{v}", i, "doc", "Ann Lee" if i < 30 else f"Bob Ray{i}", f"2024-01-{v:02d}", "d", "dr", "", False) for i in range(40) for v in (1, 2)],
                                  "chunk_id string, patient_id long, document string, patient_name string, visit_date string, department string, doctor_name string, diagnosis_codes string, has_followup boolean")
    found = rg.search_names(spark.createDataFrame([("ann lee",), ("Bob Ray3",)], "pattern string"), store.select("patient_id", "patient_name"))
    assert found.where("pattern = 'ann lee'").count() == 1 and found.where("pattern = 'Bob Ray3'").count() == 10
    # a query id with two names, one that holds the other, is ranked over both, each chunk once
    queries = spark.createDataFrame([(i, "Ann Lee") for i in range(20)] + [(50, "Bob Ray31"), (50, "Bob Ray"), (50, "Bob Ray"), (None, "Ann Lee"), (None, "Bob Ray39")], "query_id long, detected_name string")
    got = sorted(((r.query_id, r.rank, r.chunk_id) for r in rg.retrieve_by_name(queries, store, top_k=12).collect()), key=str)
    new = lambda some: sorted((f"{i}_visit_2" for i in some))
    ann, bob, both = new(range(30))[:12], [*new(range(30, 40)), *sorted(f"{i}_visit_1" for i in range(30, 40))][:12], new([*range(30), 39])[:12]
    assert got == sorted([(q, r + 1, x) for q, own in [*((i, ann) for i in range(20)), (50, bob), (None, both)] for r, x in enumerate(own)], key=str)
    sizes, blocks = [], rg._blocks
    monkeypatch.setattr(rg, "_blocks", lambda rows, size: sizes.append(rows.count()) or blocks(rows, size))
    vecs = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(30)], "vec_id long, embedding array<float>")
    asked = spark.createDataFrame([(f"q{i}", [1.0, float(i % 2)]) for i in range(20)], "query_id string, qvec array<double>")
    top = rg.vector_topk(asked, vecs, top_k=3, id_col="vec_id").collect()
    assert sizes[0] == 2 and len(top) == 60
    assert {tuple(r.vec_id for r in sorted(top, key=lambda r: r.rank) if r.query_id == f"q{i}") for i in range(1, 20, 2)} == {(1, 4, 7)}
