"""Cosine top-k of a block of queries over Arrow batches of vectors.

A batch of vectors meets the block as matrix products (a few hundred rows by a
thousand queries at a time); per query only the k best rows seen so far are
held, so memory is that of the block whatever the number of vectors. The
products find the candidates; their scores are then summed anew pair by pair,
in one order for all, so equal vectors have equal scores in every batch and
ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

ROWS, QUERIES = 512, 1024
#: More than the rounding of a product of unit vectors.
SLACK = 1e-9
#: What a similarity that is NULL counts as: less than any other.
NULL = -2.0


def matrix(vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vectors as rows, their norms, whether each can be scored): of ``dim``
    numbers, none NULL, and not all zero; others are rows of zeros."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    out = np.zeros((len(vectors), dim))
    fits = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(vectors), dim), False).to_numpy(zero_copy_only=False))
    if len(fits):
        flat = vectors.take(pa.array(fits)).flatten()
        out[fits] = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)
    norm = np.sqrt((out * out).sum(1))
    ok = np.isfinite(norm) & (norm > 0)
    out[~ok] = 0
    return out, norm, ok


class BlockTopK:
    """The ``k`` best rows per query. Rows are record batches whose column
    ``vec`` holds the vectors and ``id`` the ids; all other columns go along."""

    def __init__(self, qids: pa.Array, vectors: pa.Array, k: int):
        self.qids, self.k = qids, k
        widths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
        self.blocks = []
        for dim in np.unique(widths):
            of = np.flatnonzero(widths == dim)
            for a in range(0, len(of), QUERIES):
                i = of[a:a + QUERIES]
                self.blocks.append((int(dim), i, *matrix(vectors.take(pa.array(i)), int(dim))))
        #: k rows of each query are known to be this good
        self.floor = np.full(len(qids), -np.inf)
        self.query, self.score, self.rows = np.zeros(0, np.int64), np.zeros(0), None

    def add(self, batch: pa.RecordBatch) -> None:
        if not batch.num_rows or not len(self.qids):
            return
        rows = batch.drop_columns(["vec"])
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        prepared: dict[int, tuple] = {}
        for dim, of, queries, qnorm, qok in self.blocks:
            if dim not in prepared:
                prepared[dim] = matrix(batch.column("vec"), dim)
            vectors, norm, ok = prepared[dim]
            unit = queries.T / np.where(qok, qnorm, 1)
            for a in range(0, len(vectors), ROWS):
                v, n, good = vectors[a:a + ROWS], norm[a:a + ROWS], ok[a:a + ROWS]
                s = (v / np.where(good, n, 1)[:, None]) @ unit
                s[~good] = NULL
                s[:, ~qok] = NULL
                least = np.partition(s, len(s) - self.k, 0)[len(s) - self.k] if len(s) > self.k else np.full(len(of), -np.inf)
                self.floor[of] = np.maximum(self.floor[of], least - SLACK)
                i, j = np.nonzero(s >= self.floor[of])
                score = (v[i] * queries[j]).sum(1)
                valid = good[i] & qok[j]
                score = np.where(valid, score / np.where(valid, n[i] * qnorm[j], 1), NULL)
                found.append((of[j], score, i + a))
        if found:
            query, score, at = map(np.concatenate, zip(*found))
            self._keep(query, score, rows.take(pa.array(at)))

    def _keep(self, query: np.ndarray, score: np.ndarray, rows: pa.RecordBatch) -> None:
        new = pa.Table.from_batches([rows])
        held = new if self.rows is None else pa.concat_tables([self.rows, new])
        query, score = np.append(self.query, query), np.append(self.score, score)
        by_id = pc.rank(held["id"], "ascending", null_placement="at_start", tiebreaker="dense").to_numpy(zero_copy_only=False)
        order = np.lexsort((by_id, -score, query))
        first = np.append(True, query[order][1:] != query[order][:-1])
        place = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
        best, last = order[place < self.k], order[place == self.k - 1]
        self.query, self.score, self.rows = query[best], score[best], held.take(pa.array(best)).combine_chunks()
        self.floor[query[last]] = np.maximum(self.floor[query[last]], score[last] - SLACK)

    def results(self) -> Iterator[pa.RecordBatch]:
        """The rows held, with ``qid`` and ``similarity``."""
        if self.rows is None:
            return
        similarity = pa.array(self.score, pa.float64(), mask=self.score == NULL)
        out = self.rows.append_column("qid", self.qids.take(pa.array(self.query))).append_column("similarity", similarity)
        yield from out.combine_chunks().to_batches()
