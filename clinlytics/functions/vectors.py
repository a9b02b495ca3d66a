"""Vector helpers: cosine similarity, a feature-hashing text embedder and
the plug-in point for user-supplied embedding models.

Single expressions are SQL functions; whole tables are embedded by an iterator
Pandas UDF. A user model runs the same way, so it is built once per worker and
fed Arrow batches.
"""
from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_DIM = 64
# Documents go to an embedding model 128 per call.
EMBED_BATCH = 128


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def norm_sq(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0).cast("double"), lambda acc, x: acc + x.cast("double") * x.cast("double"))


def cosine(a: Column, b: Column, a_norm_sq: Column | None = None, b_norm_sq: Column | None = None) -> Column:
    """dot(a, b) / (|a| |b|) in double; NULL when either vector is zero."""
    na = norm_sq(a) if a_norm_sq is None else a_norm_sq
    nb = norm_sq(b) if b_norm_sq is None else b_norm_sq
    den = F.sqrt(na) * F.sqrt(nb)
    return F.when(den > 0, dot(a, b) / den)


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def hash_embed(text: Column, dim: int = DEFAULT_DIM) -> Column:
    """Signed feature hashing of tokens into ``dim`` buckets (array<float>).

    bucket = first 8 hex digits of md5(token) mod dim; sign from the 9th
    digit's parity. Counts are small integers, so every engine computes the
    same exact vector and the same cosine.
    """
    hashed = F.transform(tokens(text), lambda tok: F.struct(
        (F.conv(F.substring(F.md5(tok), 1, 8), 16, 10).cast("bigint") % dim).alias("b"),
        F.when(F.conv(F.substring(F.md5(tok), 9, 1), 16, 10).cast("int") % 2 == 0, F.lit(1))
        .otherwise(F.lit(-1)).alias("s")))
    # One pass over the tokens (each md5 computed once), adding the sign
    # into the bucket of a dim-long accumulator.
    return F.aggregate(
        hashed, F.array_repeat(F.lit(0), dim),
        lambda acc, h: F.transform(acc, lambda v, j: v + F.when(j == h["b"], h["s"]).otherwise(0))
    ).cast("array<float>")


def hash_embed_table(df: DataFrame, key: str, text: str, dim: int = DEFAULT_DIM,
                     out: str = "embedding") -> DataFrame:
    """``hash_embed`` for a whole table: a map over Arrow batches, no shuffle.

    Tokens are cut by SQL functions; a task hashes each token once. Equal,
    value for value, to ``hash_embed`` on each row (null: the zero vector).
    Rows need no unique ``key``; it only names the table's key for callers.
    """
    from clinlytics.functions.pyudfs import hash_embedder
    from clinlytics.session import ship_package
    ship_package(df.sparkSession)
    return df.withColumn(out, hash_embedder(dim)(tokens(F.col(text))))


def model_embedder(embed_fn: Callable[[list[str]], list[list[float]]] | None, dim: int, factory: Callable | None = None):
    """Wrap a batch embedding function as an iterator Pandas UDF.

    ``embed_fn`` receives up to EMBED_BATCH texts per call and returns one
    vector of length ``dim`` per text. A model that is dear to load is given as
    ``factory(mode)`` instead: it runs once per worker process and mode
    ("document" for the store, "query" for questions) and returns such a
    function. The result's ``for_queries`` embeds in query mode.
    """
    from clinlytics.functions.pyudfs import batch_embedder, once_per_worker
    make = factory if factory is not None else (lambda mode: embed_fn)
    kind = uuid.uuid4().hex
    document, query = (batch_embedder(once_per_worker(make, kind, mode), dim, EMBED_BATCH) for mode in ("document", "query"))
    embed = lambda text: document(text)  # noqa: E731 - carries the query form
    embed.for_queries = query
    return embed
