"""Operators 4, 5, 6, 8, 9, the components and the pipeline: SQL, brute force and odd inputs."""
import collections
import itertools
import random

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from clinlytics.llm import decontaminate, licenses, mixing, near_dedup, pii, pivot_index
from clinlytics.llm.common import DOC_COLUMNS, table, written
from clinlytics.llm.graph import connected_components
from tests.conftest import SF_SMALL
from tests.llm.test_text_operators import ODD, SCHEMA
from tests.test_oracle import _bag

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def _sql(frames, sql):
    con = duckdb.connect()
    for name, df in frames.items():
        con.register(name, df.toArrow())
    rel = con.execute(sql)
    return _bag([d[0] for d in rel.description], rel.fetchall())


def _rows(df):
    return _bag(df.columns, [tuple(r) for r in df.collect()])


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_license_units(spark, odd, empty):
    mit = licenses._MIT.replace("sublicense", "sub-licence").upper()
    docs = spark.createDataFrame([(1, f"Copyright (c) 2020 Somebody\n\n{mit}"), (2, "Intro\n  Licenced under the APACHE License, version 2.0!\nend"), (3, "MIT"), (4, None), (5, "")], "doc_id bigint, text string")
    got = licenses.scan(docs).collect()
    assert {(r["doc_id"], r["unit"], r["license_id"]) for r in got} == {(1, "text", "MIT"), (2, "line", "Apache-2.0")}
    assert _rows(licenses.scan(docs)) == _sql({"documents": docs}, licenses.oracle())
    assert licenses.scan(odd).count() == 0 and licenses.scan(empty).count() == 0


def test_full_license_texts_and_runs_of_paragraphs(spark):
    import textwrap
    from pathlib import Path
    text = {n: Path(licenses.__file__).with_name("license_texts").joinpath(f"{n}.txt").read_text() for n in ("Apache-2.0", "GPL-3", "BSD-3-Clause", "Unlicense")}
    isc = "\n\n".join(textwrap.fill(p, 78) for p in licenses._ISC.split("\n\n"))
    docs = spark.createDataFrame([
        (1, f"MIT License\n\nCopyright (c) 2020 Somebody\n\n{licenses._MIT}"), (2, text["Apache-2.0"]), (3, text["GPL-3"].split("\n\n", 1)[1]),
        (4, f"BSD 3-Clause License\n\nCopyright (c) 2020, Somebody\nAll rights reserved.\n\n{text['BSD-3-Clause']}"), (5, text["Unlicense"]), (6, f"ISC License\n\nCopyright 2020 X\n\n{isc}"),
        (7, f"Read me first\n\n{licenses._MIT}\n\nThe end"), (7, f"Read me first\n\n{licenses._MIT}\n\nThe end"), (8, licenses._MIT.split("\n\n", 1)[1] + "\n\nThe end")],
        "doc_id bigint, text string")
    got = [tuple(r)[:4] for r in licenses.scan(docs).collect()]
    assert {r[0]: r[3] for r in got if r[1] == "text"} == {1: "MIT", 2: "Apache-2.0", 3: "GPL-3.0", 4: "BSD-3-Clause", 5: "Unlicense", 6: "ISC"}
    assert [r for r in got if r[0] in (7, 8)] == [(7, "paragraphs", 2, "MIT")] * 2
    whole = {tuple(r) for r in licenses.scan(docs).where("unit <> 'paragraphs'").collect()}
    assert whole == {tuple(r) for r in duckdb_rows(docs)}


def duckdb_rows(docs):
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    return con.execute(licenses.oracle()).fetchall()


def _water(budget, nodes):
    """Reference water-filling of (name, cap, weight) by repeated sharing, exact."""
    from fractions import Fraction
    got, open_, left = {}, dict((n, (c, w)) for n, c, w in nodes), Fraction(min(budget, sum(c for _, c, _ in nodes)))
    while open_:
        level = left / sum(w for _, w in open_.values())
        full = [n for n, (c, w) in open_.items() if c <= level * w]
        if not full:
            got.update({n: int(level * w) for n, (c, w) in open_.items()})
            break
        for n in full:
            got[n] = open_.pop(n)[0]
            left -= got[n]
    return got


def test_mixing_budgets_redistribute_among_siblings_first(spark):
    rows = [(i, "w " * n, lang, src, 0) for i, (n, lang, src) in enumerate([(10, "en", "a0")] * 3 + [(50, "en", "b3")] * 8 + [(40, "de", "b3")] * 9 + [(30, "fr", "c1")] * 10 + [(5, "es", "c2")] * 2)]
    docs = spark.createDataFrame(rows, DOCS)
    leaves = {(r["_domain"], r["_lang"], r["_source"]): r for r in mixing.plan(mixing.token_table(docs), (mixing.DOMAIN_WEIGHTS, mixing.LANG_WEIGHTS, mixing.SOURCE_WEIGHTS), 100, 2).collect()}
    caps = {k: 2 * r["supply"] for k, r in leaves.items()}
    weight = lambda d, k: d.get(k, 1)
    top = collections.defaultdict(int)
    for k, c in caps.items():
        top[k[0]] += c
    domains = _water(sum(caps.values()) // 2, [(d, c, weight(mixing.DOMAIN_WEIGHTS, d)) for d, c in top.items()])
    for d, budget in domains.items():
        own = collections.defaultdict(int)
        for k, c in caps.items():
            if k[0] == d:
                own[k[1]] += c
        langs = _water(budget, [(x, c, weight(mixing.LANG_WEIGHTS, x)) for x, c in own.items()])
        for lang, share in langs.items():
            sources = _water(share, [(k[2], c, weight(mixing.SOURCE_WEIGHTS, k[2])) for k, c in caps.items() if k[:2] == (d, lang)])
            assert {s: leaves[d, lang, s]["budget"] for s in sources} == sources
    chosen = mixing.mixture(docs)
    assert _rows(chosen) == _sql({"documents": docs}, mixing.oracle())


def test_mixing_odd_inputs(spark, odd, empty):
    got = mixing.mix(odd)
    assert set(got.columns) >= {"doc_id", "text", "score", "copies"} and all(r["n_tokens"] > 0 for r in got.collect())
    assert mixing.mixture(empty).count() == 0


@pytest.mark.parametrize("name", ["op4_license_digest", "op5_hierarchical_mixing", "op6_pivot_near_vectors", "op8_positional_decontamination", "op9_oph_near_documents"])
def test_sql_agrees(spark, name):
    frames = {t: table(spark, SF_SMALL, t) for t in ("documents", "embeddings", "benchmark")}
    assert _rows(entry.queries()[name](spark, SF_SMALL)) == _sql(frames, entry.oracle_sql()[name])


def _parts(nodes, edges):
    root = {n: n for n in nodes}
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_paths_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    want = _parts({x for e in edges for x in e}, edges)
    assert all(want[n] == c for n, c in got.items()) and set(got) == {n for n in want if n != 300}
    assert connected_components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def _vectors(rng, n, dim=16):
    x = rng.normal(size=(n, dim))
    near = [x[i % n] + rng.normal(size=dim) * s for i, s in enumerate(np.tile([0.0, 0.02, 0.05, 0.1, 0.15], 12))]
    return [v.tolist() for v in [*x, *near]]


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, v, i % 3) for i, v in enumerate(_vectors(rng, 600))]
    hot = rng.normal(size=16)
    rows += [(10_000 + i, (hot + rng.normal(size=16) * 0.08).tolist(), 1) for i in range(1_700)]  # longer lists than two blocks
    unit = pivot_index.unit([r[1] for r in rows])
    labels, ids = np.array([r[2] for r in rows]), np.array([r[0] for r in rows])
    near = (unit @ unit.T >= pivot_index.COSINE) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(near, False)
    got = {r["vec_id"]: r for r in pivot_index.link_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")).collect()}
    n = np.array([got[i]["n_links"] for i in ids.tolist()])
    assert (n <= near.sum(axis=1)).all() and n.sum() >= 0.97 * near.sum()  # recall; never a link below the bar
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_vectors_odd_inputs(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1, 5), (2, [2.0, 0.0], 1, 5), (2, [2.0, 0.0], 1, 5), (3, [1.0, 0.0], None, 5), (4, None, 1, 5), (5, [0.0, 0.0], 1, 5), (6, [nan, 1.0], 1, 5),
            (7, [inf, 1.0], 1, 5), (8, [None, 1.0], 1, 5), (9, [1.0, 0.0, 0.0], 1, 5), (10, [1.0, 0.0], 2, 5), (None, [1.0, 0.0], 1, 5), (11, [1.0, 0.0], 1, 5)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, component bigint")
    out = [tuple(r) for r in pivot_index.link_vectors(df).collect()]
    assert len(out) == len(rows) and sorted(r for r in out if r[0] in (1, 2, 11)) == [(1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), (11, 2, 1, False)]
    assert all(r[1:] == (0, r[0], True) for r in out if r[0] not in (1, 2, 11))
    assert pivot_index.link_vectors(df.where("vec_id < 0")).count() == 0


def test_decontamination_phrases_and_proximity(spark, odd, empty):
    words = [f"w{i}x" for i in range(30)]
    bench = spark.createDataFrame([(1, " ".join(words)), (1, " ".join(words)), (2, "Alpha beta-gamma"), (3, None), (4, "!!"), (5, "the the the")], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "intro " + " ".join(words[5:20]).upper() + " outro"), (2, "ALPHA, beta gamma"), (3, " ".join(words[:6] + ["extra"] + words[6:13])), (4, None), (5, "the " * 500),
                                  (6, "clean text only"), (1, "same id clean"), (7, "alpha\x00beta\x7fgamma é")], "doc_id bigint, text string")
    out = decontaminate.report(docs, bench, proximity=True)
    assert _rows(out.drop("n_near")) == _sql({"documents": docs, "benchmark": bench}, decontaminate.oracle())
    got = {(r["doc_id"], r["n_words"]): r for r in out.collect()}
    assert got[1, 17]["n_hit"] == 15 and got[1, 3]["n_hit"] == 0 and got[3, 14]["n_hit"] == 0 and got[3, 14]["n_near"] == 1
    assert sorted(r["doc_id"] for r in decontaminate.clean(docs, bench).collect()) == [1, 3, 4, 6]
    assert decontaminate.report(odd, bench).count() == len(ODD) and decontaminate.report(empty, bench).count() == 0
    assert decontaminate.report(odd, bench.where("item_id < 0")).where("contaminated").count() == 0


def test_decontamination_writes_few_files_and_finds_every_start(spark, monkeypatch):
    rng = random.Random(8)
    bench = [(i, " ".join(rng.choice("abcde") for _ in range(rng.choice([1, 2, 3, 5, 14])))) for i in range(60)]
    docs = [(i % 150 or None, " ".join(rng.choice("abcdef") for _ in range(rng.choice([1, 3, 30, 60])))) for i in range(200)] + [(7, "a b " * 300)] * 2 + [(8, None)]
    bench_df, docs_df = spark.createDataFrame(bench, "item_id bigint, text string"), spark.createDataFrame(docs, "doc_id bigint, text string").repartition(7)
    cores = spark.sparkContext.defaultParallelism
    made = []  # the checkpoint folder is shared with other sessions: only what this one writes is counted
    monkeypatch.setattr(decontaminate, "written", lambda df: made.append(written(df)) or made[-1])
    conf = {"spark.sql.shuffle.partitions": str(6 * cores), "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        out = decontaminate.report(docs_df, bench_df, proximity=True)
        found, cut = decontaminate.matches(docs_df, bench_df)
        assert _rows(out.drop("n_near")) == _sql({"documents": docs_df, "benchmark": bench_df}, decontaminate.oracle())
        starts = {(r["doc_id"], r["phrase"], r["start"], r["kind"]) for r in found.where("kind = 'exact'").collect()}
        n_files = [len(df.inputFiles()) for df in made]
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    phrases = {r["phrase"] for r in cut.collect()}
    naive = {(d, p, i, "exact") for d, t in docs for p in phrases for i in range(len((t or "").split())) if (t or "").split()[i:i + len(p.split())] == p.split()}
    assert phrases and starts == naive
    # dealt by shuffle partition: the candidates of report and of matches, and report's matches
    assert n_files and sum(n > 4 * cores for n in n_files) <= 3


def test_documents_without_an_id_keep_their_findings(spark):
    words = " ".join(f"w{i}x" for i in range(20))
    bench = spark.createDataFrame([(1, words)], "item_id bigint, text string")
    docs = spark.createDataFrame([(None, f"intro {words}"), (None, "clean text only"), (1, f"intro {words}"), (2, None)], "doc_id bigint, text string")
    out = decontaminate.report(docs, bench)
    assert sorted(r["n_hit"] for r in out.collect()) == [0, 0, 20, 20]
    assert _rows(out) == _sql({"documents": docs, "benchmark": bench}, decontaminate.oracle())
    assert sorted(r["text"] or "" for r in decontaminate.clean(docs, bench).collect()) == ["", "clean text only"]
    rows = [(None, f"Zebedee wrote boss@corp.example.com {i}") for i in range(4)] + [(i, f"nothing wrote but number {i % 7}") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert [r["spans"] for r in pii.detect(docs).collect() if r["doc_id"] is None] == ["email:14:35,disclosing:0:7"] * 4
    assert not any("Zebedee" in r["text"] for r in pii.sanitise(docs).collect())


def _shingles(text):
    w = near_dedup.words(text) if text else []
    return set(zip(*(w[i:] for i in range(5)))) if len(w) >= 5 else {tuple(w)} if w else set()


def test_near_documents_against_brute_force(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"v{i}" for i in range(400)]
    base = [list(rng.choice(vocabulary, int(n))) for n in rng.integers(3, 160, 25)]
    texts = []
    for b in base:
        for _ in range(12):
            copy = list(b)
            for _ in range(int(rng.integers(0, 1 + len(b) // 18))):
                copy[int(rng.integers(len(copy)))] = str(rng.choice(vocabulary))
            texts.append(" ".join(copy))
    texts += [texts[0]] * 5 + [texts[0].upper(), "", None, " \t\n", "one two", "One  Two", "a b c d e"]
    rows = list(enumerate(texts))
    sets = {i: _shingles(t) for i, t in rows}
    edges = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = _parts(sets, edges)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in near_dedup.deduplicate(docs).collect()}
    assert {i: (len(s), want[i], want[i] == i) for i, s in sets.items()} == {i: tuple(r)[1:] for i, r in got.items()}
    assert sorted(r["doc_id"] for r in near_dedup.keep_one(docs).collect()) == sorted(i for i in sets if want[i] == i)


def test_near_documents_odd_inputs(spark, odd, empty):
    out = [tuple(r) for r in near_dedup.deduplicate(odd).collect()]
    assert len(out) == len(ODD) and all(r[2] == r[0] for r in out)
    kept = near_dedup.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 7]
    assert near_dedup.deduplicate(empty).count() == 0 and near_dedup.keep_one(empty).count() == 0
    bridge = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (2, "p q r s t u"), (3, "p q r s t u")], "doc_id bigint, text string")
    assert {r["component_id"] for r in near_dedup.deduplicate(bridge).collect()} == {1}


def test_pipeline_stages_against_brute_force(spark):
    docs = table(spark, SF_SMALL, "documents")
    rows = docs.collect()
    held = [r["doc_id"] for r in corpus_pipeline.identify_language(spark, docs, SF_SMALL).collect()]
    assert len(held) >= 0.99 * len(rows)
    sets = {r["doc_id"]: _shingles(r["text"]) for r in rows}
    edges = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = _parts(sets, edges)
    one = corpus_pipeline.drop_near_duplicates(spark, docs, SF_SMALL)
    assert tuple(one.columns) == DOC_COLUMNS and sorted(r["doc_id"] for r in one.collect()) == sorted(i for i in sets if want[i] == i)
    dirty = {r["doc_id"] for r in decontaminate.report(docs, table(spark, SF_SMALL, "benchmark")).where("contaminated").collect()}
    assert {r["doc_id"] for r in corpus_pipeline.drop_contaminated(spark, docs, SF_SMALL).collect()} == set(sets) - dirty
    out = corpus_pipeline.run(spark, SF_SMALL).collect()
    assert {r["doc_id"] for r in out} <= {i for i in held if want[i] == i} - dirty
    assert not any("@mail" in r["text"] for r in out) and all(r["copies"] > 0 for r in out)


def test_pipeline_on_odd_documents(spark, odd):
    out = odd
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, SF_SMALL)
    assert out.count() <= len(ODD)
