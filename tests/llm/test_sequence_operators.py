"""Operators 11 to 13: brute force, SQL, exact round trips and odd inputs."""
import collections
import hashlib
import json
import random
import re
import zlib

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from clinlytics.llm import chat_format, collocations, periodic_runs
from clinlytics.llm.common import table
from tests.conftest import SF_SMALL
from tests.llm.test_table_operators import _rows, _sql
from tests.llm.test_text_operators import ODD, SCHEMA


@pytest.fixture(scope="module")
def documents(spark):
    return table(spark, SF_SMALL, "documents")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ---------------------------------------------------------- 11 periodic runs ----
def _naive_runs(w, least=6, fold=4):
    """Every maximal stretch of every period, kept where no smaller period fills it."""
    out, n = set(), len(w)
    for q in range(1, n // fold + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(least, fold * q) and not any(w[s:i + q - r] == w[s + r:i + q] for r in range(1, q)):
                out.add((s, i + q - s, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def _naive_report(doc_id, text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", text or "") if x]
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = _naive_runs(w)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), best[0], best[1], best[2], 1000 * best[1] // best[2] if runs else None,
            digest("".join(f"{s},{m},{q}\n" for s, m, q in runs)), digest(" ".join(x for i, x in enumerate(w) if i not in gone)))


@settings(max_examples=400, deadline=None)
@given(st.data())
def test_runs_match_brute_force(data):
    letters = data.draw(st.integers(1, 4))
    w = data.draw(st.lists(st.integers(0, letters), max_size=40))
    if w:
        a, p, more = data.draw(st.integers(0, len(w) - 1)), data.draw(st.integers(1, 9)), data.draw(st.integers(0, 60))
        w = w[:a] + [(w[a:a + p] * 70)[i] for i in range(more)] + w[:data.draw(st.integers(0, 10))]
    for fold, least in ((4, 6), (2, 2), (3, 6), (4, 4)):
        assert periodic_runs.runs_of(w, least, fold) == _naive_runs(w, least, fold)


def test_automaton_alone_matches_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        w = [rng.randrange(2) for _ in range(rng.randrange(80))]
        got = sorted((s, e - s, q) for (s, q), e in periodic_runs.repetitions(w, 2).items())
        assert got == sorted(_naive_runs(w, 2, 2))


def test_run_query_against_brute_force(spark, documents, odd, empty):
    rows = documents.select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r) for r in periodic_runs.report(documents).collect()}
    for r in rows:
        if len(r["text"]) < 4_000:
            assert got[r["doc_id"]] == _naive_report(r["doc_id"], r["text"])
    assert len(got) == len(rows) and sum(r[1] for r in got.values()) > 0
    shorter = odd.where("doc_id IS NULL OR doc_id <> 4")
    out = [tuple(r) for r in periodic_runs.report(shorter).collect()]
    assert sorted(out, key=str) == sorted((_naive_report(r[0], r[1]) for r in ODD if r[0] != 4), key=str)
    assert periodic_runs.report(empty).count() == 0
    long = periodic_runs.report(odd.where("doc_id = 4")).first()  # 60,000 words, three of them over and over
    assert (long["n_runs"], long["start"], long["length"], long["period"]) == (1, 0, 60_000, 3)
    found = periodic_runs.find_runs(spark.createDataFrame([(1, "x " + "a b " * 5 + "y")], "doc_id int, text string")).first()
    assert found["collapsed"] == "x a b y" and [tuple(r) for r in found["runs"]] == [(1, 10, 2)] and found["n_words"] == 12


def test_hard_texts_take_linear_time():
    for w in ([0] * 60_000, [i % 2 for i in range(60_000)], [i % 997 for i in range(60_000)]):
        assert len(periodic_runs.runs_of(w)) == 1
    fibonacci = "a", "ab"
    while len(fibonacci[1]) < 40_000:
        fibonacci = fibonacci[1], fibonacci[1] + fibonacci[0]
    assert periodic_runs.runs_of(list(fibonacci[1])) == []  # no fourth power


# ------------------------------------------------------------ 12 chat turns ----
CONV = "conv_id bigint, turn bigint, role string, text string, piece string, record string, part int"
TALKS = [(1, 0, "system", "[SYS]x[/SYS]", "a", "b", 1), (1, 1, "user", "<s>a\\</s>", "a", "b", 1), (1, 2, "assistant", "é\n[\\INST] <\\\\s>", None, None, None),
         (2, 0, "assistant", None, None, None, None), (2, 0, "assistant", None, None, None, None), (2, None, None, "no turn", None, None, None),
         (3, 5, "tool\n\\n[INST]", "[TURN]ok[/TURN]", None, None, None), (3, 4, "user", "", None, None, None), (None, 1, "user", "nobody [", None, None, None),
         (None, 0, "assistant", "[INST" * 30_000, None, None, None), (4, 1, "assistant", "[", None, None, None), (4, 2, "assistant", "INST]", None, None, None)]


def _naive_talks(rows):
    by = collections.defaultdict(list)
    for c, turn, role, text, *_ in [*rows, (-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]:
        by[c].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        loss = "".join(t for *_, role, t in turns if role == "assistant")
        said = "".join(f"{role}\n{t}\n" for *_, role, t in turns)
        out[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_chat_query_against_brute_force_and_sql(spark):
    for df in (table(spark, SF_SMALL, "conversations"), spark.createDataFrame(TALKS, CONV), spark.createDataFrame([], CONV)):
        out = chat_format.report(df)
        assert {r["conv_id"]: tuple(r)[1:5] for r in out.collect()} == _naive_talks([(r["conv_id"], r["turn"], r["role"], r["text"]) for r in df.collect()])
        assert _rows(out) == _sql({"conversations": df}, chat_format.oracle())


def test_formatted_conversations_come_back(spark):
    turns = chat_format.read_turns(chat_format.turn_records(spark.createDataFrame(TALKS, CONV)))
    pieces = chat_format.formatted(turns).collect()
    by = collections.defaultdict(list)
    for r in sorted(pieces, key=lambda r: (r["turn"] is not None, r["turn"] or 0, r["role"], r["piece"])):
        by[r["conv_id"]].append(r)
        marks = re.findall(r"</?s>|\[/?(?:INST|SYS|TURN)\]", r["piece"])
        assert len(marks) == 2  # none but the template's own
        text = dict(((t[0], t[1], t[2] or "", t[3] or ""), 1) for t in TALKS)
        role, said = next(chat_format.parse(r["piece"]))
        assert (r["conv_id"], r["turn"], role, said) in text
        mask = chat_format.unescaped(r["piece"][r["loss_start"]:r["loss_start"] + r["loss_chars"]])
        assert mask == (said if role == "assistant" else "")
    whole = "".join(r["piece"] for r in by[1])
    assert list(chat_format.parse(whole)) == [(t[2], t[3]) for t in TALKS[:3]]
    with pytest.raises(ValueError):
        list(chat_format.parse("plain" + whole))


LAYOUTS = [
    ("messages", {"messages": [{"role": "user", "content": "hi"}, {"role": "gpt", "content": "yes"}]}, [("user", "hi"), ("assistant", "yes")]),
    ("messages", {"system": "be kind", "messages": [{"role": "user", "content": "hi", "name": "Ann"}]}, [("system", "be kind"), ("user", "hi")]),
    ("messages in parts", {"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}]}, [("user", "a\n\nb")]),
    ("shared conversation", {"id": "7", "conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": None}]}, [("user", "hi"), ("assistant", "")]),
    ("instruction", {"instruction": "add", "input": "1 2", "output": "3"}, [("user", "add\n\n1 2"), ("assistant", "3")]),
    ("instruction", {"instruction": "sing", "input": "", "output": "la"}, [("user", "sing"), ("assistant", "la")]),
    ("prompt and completion", {"completion": "b", "prompt": "a"}, [("user", "a"), ("assistant", "b")]),
    ("prompt and response", {"prompt": "a", "response": "b", "system": None}, [("user", "a"), ("assistant", "b")]),
    ("question and answer", {"question": "q", "answer": "a", "context": "c"}, [("user", "c\n\nq"), ("assistant", "a")]),
    ("preference", {"prompt": "p", "chosen": "c", "rejected": "r", "score": 2}, [("user", "p"), ("assistant", "c")]),  # score is in no layout
    ("query with history", {"query": "3", "response": "4", "history": [["1", "2"], ["1b", "2b"]]},
     [("user", "1"), ("assistant", "2"), ("user", "1b"), ("assistant", "2b"), ("user", "3"), ("assistant", "4")]),
    (None, {"body": "what"}, []), (None, {}, []),
]


def test_layouts_are_told_by_their_paths(spark):
    rows = [(i, 0, json.dumps(r)) for i, (_, r, _) in enumerate(LAYOUTS)] + [(50, 0, None), (51, 0, "{broken"), (52, 0, "[1]"), (53, 0, "[" * 100_000)]
    turns = chat_format.read_turns(spark.createDataFrame(rows, "conv_id bigint, turn int, record string"))
    got = collections.defaultdict(list)
    for r in turns.collect():
        got[r["conv_id"]].append((r["part"], r["layout"], r["role"], r["text"]))
    for i, (name, _, want) in enumerate(LAYOUTS):
        own = sorted(got[i], key=str)
        assert [x[2:] for x in own if x[0] is not None] == want and {x[1] for x in own} == {name}
    assert all(got[i] == [(None, None, None, None)] for i in (50, 51, 52, 53))
    assert sum(r["n_records"] for r in chat_format.unmapped(turns).collect()) == 6
    assert chat_format.read_back(chat_format.formatted(turns)).count() == len([x for x in LAYOUTS if x[0]])
    with pytest.raises(ValueError):
        chat_format.registry((chat_format.LAYOUTS[0], chat_format.Layout("again", ("text", "role"), ())))


# ---------------------------------------------------------- 13 collocations ----
def _naive_grams(rows):
    f = collections.defaultdict(collections.Counter)
    for lang, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = [x for x in re.split("[\x20\x09]+", piece) if x]
            for k in (1, 2, 3):
                f[lang or "und"].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    return f


def _naive_collocations(rows, support, top):
    out = []
    for lang, f in _naive_grams(rows).items():
        n = sum(v for g, v in f.items() if len(g) == 1)
        held = collections.Counter()
        for g, v in f.items():
            if len(g) == 3 and v >= support:
                for part in (g[:2], g[1:]):
                    held[part] = max(held[part], v)
        found = []
        for g, a in f.items():
            if len(g) == 1 or a < support or (len(g) == 2 and 100 * held[g] >= 50 * a and g in held):
                continue
            score, _, left, right = min((1_000_000 * a * a // (f[g[:k]] * f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


def _drawn(seed):
    rng = random.Random(seed)
    words = ["a", "b", "c", "d", "É", "ü", "Of", "the", "x\x1cy", " ", "z" * 300]
    text = lambda: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\x0b"]) for _ in range(rng.randrange(160)))
    rows = [(i, text() if i % 9 else None, rng.choice(["en", "en", "de", None, "und"]), "s", 0, 0.0, "", True) for i in range(60)]
    return rows + rows[:5]


@pytest.mark.parametrize("seed", [1, 2])
def test_collocations_match_brute_force(spark, seed):
    rows = _drawn(seed)
    docs = spark.createDataFrame(rows, SCHEMA)
    want = _naive_collocations([(r[2], r[1]) for r in rows], 10, 2_000)
    assert sorted(tuple(r) for r in collocations.collocations(docs).collect()) == want and len(want) > 10
    want = _naive_collocations([(r[2], r[1]) for r in rows], 2, 7)
    assert sorted(tuple(r) for r in collocations.collocations(docs, 2, 7).collect()) == want
    assert _rows(collocations.collocations(docs)) == _sql({"documents": docs.drop("rejected")}, collocations.oracle())


def test_graph_gives_back_every_count(spark):
    """Rings, loops, forks and long unary paths: every pair and triple comes back from the compacted graph, once."""
    passage = " ".join(f"w{i}" for i in range(60))
    texts = [passage] * 3 + ["p q " * 9] * 3 + ["o " * 8] * 3 + ["ring one two " * 4] * 3 + [passage + " tail", "head " + passage] + ["once only here"]
    docs = spark.createDataFrame([("en", t) for t in texts], "lang string, text string")
    words, seed = collocations.words_of(docs, 3)
    flow = collocations.flows(docs, words, seed, 3)
    naive = _naive_grams([("en", t) for t in texts])["en"]
    want = {" ".join(g): n for g, n in naive.items() if len(g) > 1 and n >= 3}
    name = {r["id"]: r["word"] for r in words.collect()} | {0: ""}
    assert {r["word"]: r["n"] for r in words.collect()} == {g[0]: n for g, n in naive.items() if len(g) == 1}

    def read():
        paths, joints = collocations.compact(flow)
        rows = collocations.grams(paths, joints).collect()
        assert len(rows) == len(want) and {" ".join(name[r[x]] for x in "abc").strip(): r["n"] for r in rows} == want
        return paths

    longest = max(collocations.spelled(read(), words).collect(), key=lambda r: len(r["text"]))
    assert longest["text"] == passage and longest["lang"] == "en" and len(longest["nodes"]) == 59 and len(longest["edges"]) == 58
    assert max(len(r["nodes"]) for r in _with(collocations, "BLOCK", 16, lambda: read().collect())) == 16


def test_word_numbers_are_proved_apart(spark, monkeypatch):
    docs = spark.createDataFrame([("en", "a a b b c " * 5)], "lang string, text string")
    assert collocations.words_of(docs, 2)[1] == 0
    ids = {r["word"]: r["id"] for r in collocations.words_of(docs, 2)[0].collect()}
    assert {w: collocations._number(0, b"en", w.encode()) for w in ids} == {w: i % 2 ** 64 for w, i in ids.items()}
    plain = collocations.F.xxhash64
    for seeds in ("0", "01"):  # numbers that all words share
        clash = lambda text: collocations.F.when(text.substr(1, 1).isin(*seeds), collocations.F.lit(7).cast("bigint")).otherwise(plain(text))  # noqa: B023, E731
        monkeypatch.setattr(collocations.F, "xxhash64", clash)
        words, seed = collocations.words_of(docs, 2)
        assert seed == len(seeds) and {r["word"]: r["id"] % 2 ** 64 for r in words.collect()} == {w: collocations._number(seed, b"en", w.encode()) for w in ids}


def _with(module, name, value, run):
    before = getattr(module, name)
    setattr(module, name, value)
    try:
        return run()
    finally:
        setattr(module, name, before)


def test_long_pieces_in_parts():
    for n in range(12):
        text, found = " ".join(f"w{i % 5}" for i in range(n)).encode(), []
        for part in (1 << 20, 3):
            ids, numbers = collocations.Ids(), []
            for words, end in collocations.parts(text, part):
                numbers += [*map(ids.__getitem__, words), end]
            found.append(collections.Counter(zip(*(x.tolist() for x in collocations.triples(numbers)), strict=True)))
        assert found[0] == found[1]


def test_collocations_odd_inputs(spark, odd, empty):
    assert collocations.collocations(empty).count() == 0
    got = sorted(tuple(r) for r in collocations.collocations(odd).collect())
    assert got == _naive_collocations([(r[2], r[1]) for r in ODD], 10, 2_000)
    assert got[0][:5] == ("en", 1, "lorem ipsum dolor", 20_000, 20_000)


def test_scores_are_exact_beyond_64_bits(spark):
    a, left, right = 3_000_000_000_001, 3_000_000_000_007, 9_000_000_000_011
    df = spark.createDataFrame([(a, left, right)], "a bigint, l bigint, r bigint")
    assert df.select(collocations._score(df.a, df.l, df.r)).first()[0] == 1_000_000 * a * a // (left * right)


def test_registered_sql_runs_on_the_small_tables():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF_SMALL}/documents.parquet'")
    assert con.execute(collocations.oracle()).fetchall()
