"""Arrow-batched Pandas UDFs (type hints must be real, not postponed)."""
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F


_LOADED: dict = {}


def once_per_worker(factory: Callable, kind: str, mode: str) -> Callable:
    """A function that returns ``factory(mode)``, made at its first use in a worker process and kept there."""
    def load():
        import clinlytics.functions.pyudfs as here  # the worker's own module, whatever way this function came
        if (kind, mode) not in here._LOADED:
            here._LOADED[kind, mode] = factory(mode)
        return here._LOADED[kind, mode]
    return load


def batch_embedder(load: Callable, dim: int, batch: int):
    """Iterator UDF: ``load()`` gives the worker's model, which is fed at most ``batch`` texts per call."""
    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embed_fn = load()
        for texts in batches:
            out = []
            vals = texts.tolist()
            for i in range(0, len(vals), batch):
                vecs = embed_fn(vals[i:i + batch])
                for v in vecs:
                    if len(v) != dim:
                        raise ValueError(f"embedding has {len(v)} dims, expected {dim}")
                out.extend(list(v) for v in vecs)
            yield pd.Series(out)
    return embed


class TokenPlaces(dict):
    """Token to (bucket, sign); emptied when it grows beyond a bound."""
    def __init__(self, dim: int):
        self.dim = dim

    def __missing__(self, token: str) -> tuple[int, int]:
        if len(self) > 200_000:
            self.clear()
        digest = hashlib.md5(token.encode()).hexdigest()
        self[token] = place = (int(digest[:8], 16) % self.dim, -1 if int(digest[8], 16) % 2 else 1)
        return place


def hash_embedder(dim: int):
    """Iterator UDF over token arrays: signed counts per bucket, one pass, no shuffle; a batch's different tokens are placed once."""
    @F.arrow_udf("array<float>")
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        places = TokenPlaces(dim)
        for rows in batches:
            sizes = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False)
            tokens = rows.flatten().dictionary_encode()
            own = np.array([places[t] for t in tokens.dictionary.to_pylist()], dtype=np.int64).reshape(-1, 2)
            each = own[tokens.indices.to_numpy(zero_copy_only=False)]
            at = np.repeat(np.arange(len(rows)), sizes) * dim + each[:, 0]
            counts = np.bincount(at, each[:, 1].astype(np.float64), len(rows) * dim).astype(np.float32)
            yield pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * dim, pa.array(counts))
    return embed


def _matrix(column, dim: int | None) -> np.ndarray:
    """Rows of a list column as float64; null rows are zero vectors."""
    if column.null_count:
        rows = column.to_pylist()
        dim = dim if dim is not None else max((len(r) for r in rows if r is not None), default=0)
        return np.array([np.zeros(dim) if r is None else r for r in rows], dtype=np.float64).reshape(len(rows), dim)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


class _Cell:
    """The queries of one cell and the best candidates met so far: arrays of (query, score, id)."""

    NONE = -2.0  # below every cosine: no score, ordered last

    def __init__(self, k: int, key: tuple[int, int]):
        self.k, self.key, self.parts, self.held, self.least = k, key, [], None, None

    def add_queries(self, ids, vecs, groups) -> None:
        self.parts.append((ids, vecs, groups))

    def close_queries(self) -> None:
        self.ids = pa.concat_arrays([p[0] for p in self.parts])
        self.vecs = np.concatenate([p[1] for p in self.parts])
        self.groups = [g for p in self.parts for g in p[2]]
        self.norms = np.sqrt(np.einsum("ij,ij->i", self.vecs, self.vecs))
        self.least = np.full(len(self.vecs), -np.inf)

    def score(self, ids: np.ndarray, vecs: np.ndarray, groups: list, step: int = 1_024) -> None:
        if self.least is None:
            self.close_queries()
        norms = np.sqrt(np.einsum("ij,ij->i", vecs, vecs))
        codes = {g: i for i, g in enumerate(dict.fromkeys([*self.groups, *groups]))}
        own = np.array([codes[g] for g in self.groups])
        theirs = np.array([codes[g] if g is not None else -1 for g in groups])
        for a in range(0, len(ids), step):
            part, size = vecs[a:a + step], norms[a:a + step]
            with np.errstate(invalid="ignore", divide="ignore"):
                rough = (self.vecs @ part.T) / (self.norms[:, None] * size[None, :])
            rough[~np.isfinite(rough)] = self.NONE
            rough[own[:, None] != theirs[None, a:a + step]] = -np.inf
            if rough.shape[1] > self.k:
                kth = -np.partition(-rough, self.k - 1, axis=1)[:, self.k - 1]
                self.least = np.maximum(self.least, kth)
            # a product of whole matrices chooses (its last digits depend on the blocks), single products decide
            qi, ci = np.nonzero((rough >= self.least[:, None] - 1e-9) & (rough > -np.inf))
            if not len(qi):
                continue
            exact = np.einsum("ij,ij->i", self.vecs[qi], part[ci])
            with np.errstate(invalid="ignore", divide="ignore"):
                exact = exact / (self.norms[qi] * size[ci])
            exact[~np.isfinite(exact)] = self.NONE
            self._keep(qi, exact, ids[a:a + step][ci])

    def _keep(self, qi, score, ids) -> None:
        if self.held is not None:
            qi, score, ids = (np.concatenate(x) for x in zip(self.held, (qi, score, ids)))
        order = np.lexsort((ids, -score, qi))
        qi, score, ids = qi[order], score[order], ids[order]
        first = np.concatenate(([True], qi[1:] != qi[:-1]))
        place = np.arange(len(qi)) - np.maximum.accumulate(np.where(first, np.arange(len(qi)), 0))
        kept = place < self.k
        self.held = qi[kept], score[kept], ids[kept]
        full = place == self.k - 1
        self.least[qi[full]] = np.maximum(self.least[qi[full]], score[full])

    def rows(self, id_type) -> pa.RecordBatch | None:
        if self.held is None:
            return None
        qi, score, ids = self.held
        return pa.RecordBatch.from_arrays([self.ids.take(pa.array(qi)), pa.array(ids.tolist(), id_type), pa.array(score, mask=score == self.NONE)],
                                          names=["query_id", "id", "score"])


def cell_topk(k: int) -> Callable:
    """mapInArrow body over rows (qb, vb, side, query_id, id, vec, group) sorted by cell, queries first: each cell's best k per query."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("qb", "vb", "side")], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            id_type = batch.schema.field("id").type
            for a, b in zip(cuts, cuts[1:]):
                qb, vb, side = (int(x) for x in keys[a])
                if cell is None or cell.key != (qb, vb):
                    if cell is not None and (rows := cell.rows(id_type)) is not None:
                        yield rows
                    cell = _Cell(k, (qb, vb))
                part = batch.slice(a, b - a)
                groups = part.column("group").to_pylist()
                if side == 0:
                    cell.add_queries(part.column("query_id"), _matrix(part.column("vec"), None), groups)
                elif cell.parts:
                    ids = part.column("id")
                    ids = np.array(ids.to_pylist()) if pa.types.is_string(id_type) or pa.types.is_large_string(id_type) else ids.to_numpy(zero_copy_only=False)
                    cell.score(ids, _matrix(part.column("vec"), cell.parts[0][1].shape[1]), groups)
        if cell is not None and (rows := cell.rows(id_type)) is not None:
            yield rows
    return run
