"""Operator 13: collocations from a weighted de Bruijn graph of words.

Nodes are word pairs, edges the triples that lead from a pair to the next, one
graph per language. Only the longest grams are counted in the texts: every
word gives the triple that begins with it, or what the end of its piece leaves
of it. All shorter counts follow from the graph: a pair occurs as often as
flow leaves its node, plus the piece ends that stop at it; a word as often as
its pairs, plus the pieces that end with it alone.

A word below the support is in no candidate, so a first pass over all words
makes them ends of pieces; a word of the rest goes by a number of 48 bits (64
where the words are too many for that), and the pass proves that no other word
of any text has the same one (else it takes another seed). Edges and nodes below the support are dropped once they have
given their flow. Unary paths of the rest (stretches of nodes with one edge in
and out) are compacted by pointer doubling into rows of words with the weights
along them, cut every BLOCK nodes so that no row grows without bound; rings,
which have no first node, stay single nodes. The other edges are joints
between paths. Candidates are read off the paths and joints.

Scale: each task adds up its triples over packed ids of a dictionary of its
own (bounded, then handed on), Spark adds up by whole gram, so a common pair
is spread over its followers; each level of counts is a partial aggregate of
the one before. What goes to all tasks is a bitmap of fixed size; a full one
lets rare words through and changes no result. Scores are exact in decimals.

Defined results: null and empty texts have no words; null lang is ``und`` (and
joins a language of that name); repeated rows count again; extra columns are
ignored; an empty table gives no rows. A phrase that ties in score and count
is ranked by its UTF-8 bytes.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinlytics.llm.common import prepare, written

SUPPORT = 10
#: a pair goes when a candidate triple that holds it has at least this share of its count, in percent
HELD_BY_LONGER = 50
TOP = 2_000
#: nodes of a path in one row
BLOCK = 1_024
#: words a task gathers, and words it knows, over all languages, before it hands its counts on
GATHERED, KNOWN = 1 << 21, 1 << 18
#: longer pieces are taken in parts that overlap by two words
PART = 1 << 20
#: bits of the filter of words with support
FILTER_BITS = 1 << 22
_FOLD = bytes.maketrans(bytes(range(65, 91)) + b"\t.,;:!?\n\x0b\x0c\r", bytes(range(97, 123)) + b" " + b"\n" * 10)
_ID = np.int64((1 << 21) - 1)
CUT = -1


class Ids(dict):
    """Words to numbers from 1 on, in order of their first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) + 1
        return n


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The pieces of a text as lists of words, A-Z lower-cased."""
    for piece in text.translate(_FOLD).split(b"\n"):
        if words := piece.split():  # blanks are the only white space left
            yield words


def parts(text: bytes, part: int = PART) -> Iterator[tuple[list[bytes], int]]:
    """The pieces with the mark that ends them; long ones in parts."""
    for piece in pieces(text):
        while len(piece) > part + 2:
            yield piece[:part + 2], CUT
            piece = piece[part:]
        yield piece, 0


def triples(numbers: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The three words from each one on, in numbers; 0 ends a piece, CUT a part whose last two words come again."""
    at = np.array([*numbers, 0, 0], dtype=np.int64)
    first, second = at[:-2], at[1:-1]
    third = np.where(second > 0, at[2:], 0)
    whole = (first > 0) & (second != CUT) & (third != CUT)
    return first[whole], second[whole], third[whole]


def _gathered(docs: DataFrame, handed_on: Callable[[str, Ids, list[int]], pa.RecordBatch], schema: str) -> DataFrame:
    """``handed_on(lang, words, numbers)`` of each task's words, as often as its bounds ask for it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[Ids, list[int]]] = {}
        n_words = n_numbers = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not (text := text.as_py()):
                    continue
                for part, end in parts(text):
                    if lang not in held:
                        held[lang] = Ids(), []
                    words, numbers = held[lang]
                    before = len(words)
                    numbers.extend(map(words.__getitem__, part))
                    numbers.append(end)
                    n_words += len(words) - before
                    n_numbers += len(part) + 1
                    if n_numbers >= GATHERED or n_words >= KNOWN:
                        for x in list(held):
                            yield handed_on(x, *held.pop(x))
                        n_words = n_numbers = 0
        for x in list(held):
            yield handed_on(x, *held.pop(x))

    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary")).mapInArrow(run, schema)


# -------------------------------------------------------------------- words ----
def _bits(seed: int) -> int:
    """Ones of a word number: short ones take less room in the shuffles; if they do not suffice, later seeds have 64."""
    return (1 << 48) - 1 if seed < 2 else (1 << 64) - 1


def _number(seed: int, lang: bytes, word: bytes) -> int:
    return xxhash.xxh64_intdigest(b"%d %b %b" % (seed, lang, word), 42) & _bits(seed)


def words_of(docs: DataFrame, support: int) -> tuple[DataFrame, int]:
    """(lang, word, n, id) of all words, and the seed of the ids.

    No word that has the support shares its id with any other word; 0 is no word's id.
    """
    def handed_on(lang: str, words: Ids, numbers: list[int]) -> pa.RecordBatch:
        first = triples(numbers)[0]
        n = np.bincount(first, minlength=len(words) + 1)[1:]
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(list(words), pa.binary()).cast(pa.string()), pa.array(n.astype(np.int64))],
                                          names=["lang", "word", "n"])

    counts = _gathered(docs, handed_on, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = written(counts)
    seed = 0
    while True:
        # Spark's xxhash64 of one string is the plain one with seed 42
        own = F.xxhash64(F.concat_ws(" ", F.lit(str(seed)), "lang", "word"))
        words = counts.withColumn("id", own.bitwiseAND(F.lit(_bits(0))) if seed < 2 else own)
        shared = words.groupBy("id").agg(F.count(F.lit(1)).alias("words"), F.max("n").alias("n")).where((F.col("n") >= support) & ((F.col("words") > 1) | (F.col("id") == 0)))
        if shared.isEmpty():
            return words, seed
        seed += 1


def _bitmap(frequent: DataFrame):
    """Broadcast bitmap of the ids of ``frequent(id)``."""
    slots = frequent.select(F.pmod("id", F.lit(FILTER_BITS)).cast("int").alias("slot")).distinct().toArrow()["slot"].to_numpy()  # FILTER_BITS at most
    bits = np.zeros(FILTER_BITS, dtype=bool)
    bits[slots] = True
    return frequent.sparkSession.sparkContext.broadcast(np.packbits(bits, bitorder="little"))


# -------------------------------------------------------------------- edges ----
def edges(docs: DataFrame, words: DataFrame, seed: int, support: int) -> DataFrame:
    """(a, b, c, n): triples of word ids; c, or b and c, are 0 at the ends of pieces and before words without support."""
    share = _bitmap(words.where(F.col("n") >= support).select("id"))

    def handed_on(lang: str, own: Ids, numbers: list[int]) -> pa.RecordBatch:
        name, bits = lang.encode(), share.value
        ids = np.fromiter((_number(seed, name, w) for w in own), dtype=np.uint64, count=len(own))
        slot = (ids % np.uint64(FILTER_BITS)).astype(np.int64)
        ids = np.concatenate(([np.uint64(0)], np.where(bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1, ids, np.uint64(0)))).view(np.int64)
        first, second, third = triples(numbers)
        second = np.where(ids[second] != 0, second, 0)
        third = np.where((second > 0) & (ids[third] != 0), third, 0)
        gram, n = np.unique(((first << 42) | (second << 21) | third)[ids[first] != 0], return_counts=True)
        columns = [ids[gram >> 42], ids[(gram >> 21) & _ID], ids[gram & _ID], n.astype(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", "c", "n"])

    return _gathered(docs, handed_on, "a bigint, b bigint, c bigint, n bigint").groupBy("a", "b", "c").agg(F.sum("n").alias("n"))


def flows(docs: DataFrame, words: DataFrame, seed: int, support: int = SUPPORT) -> DataFrame:
    """(a, b, c, n): triples and pairs (c 0) of at least the support, and words (b and c 0)."""
    none, n = F.lit(0).cast("bigint"), F.col("n")

    def passed_on(rows: DataFrame, own: Column, to: Column) -> DataFrame:
        """Rows of the level hand their flow ``to`` the next one and stay if they have the support; all others stay as they are."""
        itself = F.struct("a", "b", "c")
        out = F.when(~own, F.array(itself)).when(n < support, F.array(to)).otherwise(F.array(itself, to))
        return rows.select("n", F.inline(out).alias("a", "b", "c")).groupBy("a", "b", "c").agg(F.sum("n").alias("n"))

    # grams that ended with their piece are the corrections: they stay, and add to the flow of their node
    nodes = passed_on(edges(docs, words, seed, support), F.col("c") != 0, F.struct("a", "b", none.alias("c")))
    return passed_on(nodes, (F.col("c") == 0) & (F.col("b") != 0), F.struct("a", none.alias("b"), none.alias("c")))


# ------------------------------------------------------------------- paths ----
def _positions(links: DataFrame) -> DataFrame:
    """(a, b, path, pos) of the nodes behind a path's first one; ``links(a, b, before)`` holds each node once.

    ``path`` and ``before`` are the pairs of the first and the preceding node.
    Pointer doubling: every round a node looks as far again as the node it
    looks at. A round that settles no node leaves only rings; they are dropped.
    """
    now = written(links.select("a", "b", F.col("before").alias("path"), F.lit(1).cast("bigint").alias("pos"), F.lit(False).alias("settled")))
    waiting = None
    while True:
        ahead = now.select(F.struct("a", "b").alias("path"), F.col("path").alias("_path"), F.col("pos").alias("_pos"), F.col("settled").alias("_settled"))
        step = now.where("NOT settled").join(ahead, "path", "left")
        moved = step.select("a", "b", F.coalesce("_path", "path").alias("path"), (F.col("pos") + F.coalesce("_pos", F.lit(0))).alias("pos"),
                            (F.col("_path").isNull() | F.col("_settled")).alias("settled"))
        now = written(now.where("settled").unionByName(moved))
        left = now.where("NOT settled").count()
        if left in (0, waiting):
            return now.where("settled").drop("settled")
        waiting = left


def compact(flow: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Paths and joints of a ``flows`` table.

    Paths: (path, block, words, nodes, edges), each node of the graph in one of
    them: ``nodes[i]`` counts the pair words[i], words[i + 1], ``edges[i]`` the
    triple from words[i] on. Joints: (a, b, c, n), all other triples.
    """
    heavy = flow.where("c <> 0")
    out = heavy.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_out"))
    into = heavy.groupBy("b", "c").agg(F.count(F.lit(1)).alias("n_in"))
    heavy = heavy.join(out, ["a", "b"]).join(into, ["b", "c"])
    ring = (F.col("a") == F.col("b")) & (F.col("b") == F.col("c"))
    heavy = written(heavy.select("a", "b", "c", "n", ((F.col("n_out") == 1) & (F.col("n_in") == 1) & ~ring).alias("unary")))
    at = _positions(heavy.where("unary").select(F.col("b").alias("a"), F.col("c").alias("b"), F.struct("a", "b").alias("before")))
    # a unary edge belongs to its path only if its target was placed (not in a ring)
    target = at.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("path"))
    placed = written(heavy.join(target, ["b", "c"], "left").withColumn("within", F.col("unary") & F.col("path").isNotNull()))
    joints = placed.where("NOT within").select("a", "b", "c", "n")
    following = placed.where("within").select("a", "b", F.col("n").alias("edge"), F.col("c").alias("next"))
    nodes = (flow.where("b <> 0 AND c = 0").select("a", "b", "n").join(at, ["a", "b"], "left").join(following, ["a", "b"], "left")
             .select(F.coalesce("path", F.struct("a", "b")).alias("path"), F.coalesce("pos", F.lit(0)).alias("pos"), "a", "b", "n", "edge", "next"))
    item = F.struct("pos", "a", "b", "n", "edge", "next")
    blocks = (nodes.groupBy("path", F.floor(F.col("pos") / BLOCK).alias("block"))
              .agg(F.sort_array(F.collect_list(item)).alias("items")))  # BLOCK items at most
    last = F.element_at("items", -1)
    paths = blocks.select("path", "block", F.concat("items.a", F.array_compact(F.array(last["b"], last["next"]))).alias("words"),
                          F.col("items.n").alias("nodes"), F.filter("items.edge", lambda e: e.isNotNull()).alias("edges"))
    return written(paths), joints


def grams(paths: DataFrame, joints: DataFrame) -> DataFrame:
    """(a, b, c, n) of all pairs (c 0) and triples of the compacted graph."""
    def read(weights: str, third: Column) -> DataFrame:
        rows = paths.select("words", F.posexplode(weights).alias("i", "n"))
        return rows.select(F.col("words")[F.col("i")].alias("a"), F.col("words")[F.col("i") + 1].alias("b"), third.alias("c"), "n")

    return read("nodes", F.lit(0).cast("bigint")).unionByName(read("edges", F.col("words")[F.col("i") + 2])).unionByName(joints)


def spelled(paths: DataFrame, words: DataFrame) -> DataFrame:
    """``paths`` with the words themselves: lang, text, nodes, edges."""
    each = paths.select("path", "block", "nodes", "edges", F.posexplode("words").alias("i", "id")).join(words.select("id", "lang", "word"), "id")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ")  # BLOCK + 2 words at most
    return each.groupBy("path", "block").agg(F.first("lang").alias("lang"), text.alias("text"), F.first("nodes").alias("nodes"), F.first("edges").alias("edges"))


# ------------------------------------------------------------------ scores ----
def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (l r)) by whole decimals: exact while a stays below 10 to the 16th."""
    a, left, right = (x.cast("decimal(19,0)") for x in (a, left, right))
    return F.call_function("div", a * a * F.lit(1_000_000).cast("decimal(7,0)"), left * right)


def collocations(docs: DataFrame, support: int = SUPPORT, top: int | None = TOP) -> DataFrame:
    """The op13 result; ``top`` None returns every candidate that is not dropped."""
    prepare(docs.sparkSession)
    words, seed = words_of(docs, support)
    total = words.groupBy("lang").agg(F.sum("n").alias("total"))
    flow = written(flows(docs, words, seed, support))
    found = written(grams(*compact(flow)))
    threes, held = found.where("c <> 0"), F.array_distinct(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("c").alias("b"))))
    held = threes.select("n", F.inline(held).alias("a", "b")).groupBy("a", "b").agg(F.max("n").alias("longer"))
    pairs = found.where("c = 0").join(held, ["a", "b"], "left").where(F.coalesce(100 * F.col("longer") < HELD_BY_LONGER * F.col("n"), F.lit(True))).drop("longer")
    # counts of the parts: words by the flow through them, pairs by their nodes
    single = flow.where("b = 0")
    first, last = single.select("a", F.col("n").alias("n_first")), single.select(F.col("a").alias("z"), F.col("n").alias("n_last"))
    node = flow.where("b <> 0 AND c = 0")
    source, target = node.select("a", "b", F.col("n").alias("n_source")), node.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("n").alias("n_target"))
    n, l, r, s, t = (F.col(x) for x in ("n", "n_first", "n_last", "n_source", "n_target"))
    two = (pairs.withColumn("z", F.col("b")).join(first, "a").join(last, "z")
           .select("a", "b", "c", "n", l.alias("l"), r.alias("r"), _score(n, l, r).alias("score")))
    three = threes.withColumn("z", F.col("c")).join(first, "a").join(last, "z").join(source, ["a", "b"]).join(target, ["b", "c"])
    three = three.withColumns({"one": _score(n, l, t), "two": _score(n, s, r)})
    early = F.col("one") <= F.col("two")
    three = three.select("a", "b", "c", "n", F.when(early, l).otherwise(s).alias("l"), F.when(early, t).otherwise(r).alias("r"), F.least("one", "two").alias("score"))
    text = words.where(F.col("n") >= support).select("id", "word", "lang")
    named = two.unionByName(three).join(text.select(F.col("id").alias("a"), F.col("word").alias("w1"), "lang"), "a")
    named = named.join(text.select(F.col("id").alias("b"), F.col("word").alias("w2")), "b")
    named = named.join(text.select(F.col("id").alias("c"), F.col("word").alias("w3")), "c", "left").withColumn("phrase", F.concat_ws(" ", "w1", "w2", "w3"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("n"), "phrase"))
    ranked = named.withColumn("rank", rank)
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.join(total, "lang").select(
        "lang", F.col("rank").cast("bigint"), "phrase", F.col("n").alias("a"), "l", "r", F.col("total").alias("n"), F.col("score").cast("bigint"))


def oracle() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
    WITH piece AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, '{upper}', '{lower}'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents),
    words AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM piece),
    gram AS (SELECT lang, k, w[i:i + k - 1] AS g FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (VALUES (1), (2), (3)) AS s(k) WHERE len(w) >= k)),
    f AS (SELECT lang, k, g, count(*)::HUGEINT AS n FROM gram GROUP BY ALL),
    total AS (SELECT lang, sum(n) AS n FROM f WHERE k = 1 GROUP BY lang),
    held AS (SELECT lang, g, max(n) AS longer FROM (SELECT lang, g[1:2] AS g, n FROM f WHERE k = 3 AND n >= {SUPPORT} UNION ALL SELECT lang, g[2:3], n FROM f WHERE k = 3 AND n >= {SUPPORT}) GROUP BY ALL),
    cand AS (SELECT f.* FROM f LEFT JOIN held USING (lang, g) WHERE k > 1 AND n >= {SUPPORT} AND (k = 3 OR longer IS NULL OR 100 * longer < {HELD_BY_LONGER} * n)),
    cut AS (SELECT c.lang, c.g, c.n AS a, c.j, l.n AS l, r.n AS r, (1000000 * c.n * c.n) // (l.n * r.n) AS score
            FROM (SELECT *, unnest(range(1, k)) AS j FROM cand) c JOIN f l ON l.lang = c.lang AND l.g = c.g[1:c.j] JOIN f r ON r.lang = c.lang AND r.g = c.g[c.j + 1:c.k]),
    best AS (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, j) AS nth FROM cut),
    ranked AS (SELECT *, array_to_string(g, ' ') AS phrase, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank FROM best WHERE nth = 1)
    SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, total.n::BIGINT AS n, score::BIGINT AS score
    FROM ranked JOIN total USING (lang) WHERE rank <= {TOP}"""
