"""Exact top-k search by exhaustive term-at-a-time accumulation.

A vector is a sparse row of (term, weight) with the position as term. Candidates are dealt into
blocks by a hash of the row, queries likewise; every block of queries meets every block of
candidates once. Within such a pair the candidates form an inverted index, and for one term after
the other the weighted postings are scattered into a dense array of scores (candidates by
queries). A selection per block leaves k rows for each query, and a merge by rank the final k.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CANDIDATE_BLOCK = 8192
QUERY_BLOCK = 2048
LANES = 128
SCALE = 256


def taking_part(vector: Column) -> Column:
    """Whether a vector is there and all of its components are finite."""
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))


def rows_of(df: DataFrame, key: str, vector: str, scale: int = SCALE) -> DataFrame:
    """(id, terms, values, row, copies): equal vectors of one id are one row with their number.

    Terms are the positions where floor(scale * x) is not zero, values the doubles there; ``row``
    tells different vectors of one id apart.
    """
    doubles = F.transform(F.col(vector), lambda x: x.cast("double"))
    e = F.col("e")
    zero = lambda x: (x >= 0) & (x < 1.0 / scale)
    at = F.filter(F.sequence(F.lit(0), F.size(e) - 1), lambda i: ~zero(F.get(e, i)))
    at = F.when(F.size(e) > 0, at).otherwise(F.array().cast("array<int>"))
    sparse = (df.where(taking_part(F.col(vector)) & F.col(key).isNotNull())
              .select(F.col(key).cast("long").alias("id"), doubles.alias("e"))
              .select("id", at.alias("terms"), F.transform(at, lambda i: F.get(e, i)).alias("values")))
    each = sparse.groupBy("id", "terms", "values").agg(F.count(F.lit(1)).alias("copies"))
    return each.withColumn("row", F.xxhash64("terms", "values"))


def _dense(column: pd.Series, rows: pd.DataFrame, kind=np.int64) -> np.ndarray:
    """One array from the lists of a column, one after the other."""
    return np.concatenate([np.asarray(x, dtype=kind) for x in column]) if len(rows) else np.zeros(0, kind)


def _weights(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as whole numbers of any size."""
    whole = np.empty(len(values), dtype=object)
    whole[:] = [int(v) * scale if abs(v) >= 2.0**53 else int(np.floor(v * scale)) for v in values.tolist()]
    return whole


def _postings(rows: pd.DataFrame, kind, scale: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """term -> (row numbers, weights)."""
    sizes = rows["terms"].map(len).to_numpy()
    terms, values = _dense(rows["terms"], rows), _dense(rows["values"], rows, np.float64)
    weights = np.floor(values * scale).astype(np.int64) if kind is np.int64 else _weights(values, scale)
    owner = np.repeat(np.arange(len(rows)), sizes)
    order = np.argsort(terms, kind="stable")
    names, first = np.unique(terms[order], return_index=True)
    return {int(t): (owner[o], weights[o]) for t, o in zip(names, np.split(order, first[1:]))}


def _fits(rows: pd.DataFrame, scale: int) -> np.ndarray:
    """Rows whose weights are so small that sums of products with each other stay within 62 bits."""
    most = np.array([max(map(abs, v), default=0.0) for v in rows["values"].map(list)], dtype=np.float64)
    terms = np.array([len(t) for t in rows["terms"]], dtype=np.float64)
    return (most * scale + 1) ** 2 * np.maximum(terms, 1) < 2.0**62


def _best(asked: pd.DataFrame, offered: pd.DataFrame, k: int, kind, scale: int) -> list[tuple]:
    """(query_id, query_row, vec_id, score) of the k best rows of ``offered`` for each of ``asked``.

    ``kind`` is the type of the scores: 64-bit integers, or whole numbers of any size.
    """
    ids, marks = offered["id"].to_numpy(), offered["row"].to_numpy()
    copies, index, found = offered["copies"].to_numpy(), _postings(offered, kind, scale), []
    for at in range(0, len(asked), LANES):
        lane = asked.iloc[at:at + LANES]
        scores = np.zeros((len(ids), len(lane)), dtype=kind)
        for term, (who, query_weight) in _postings(lane, kind, scale).items():
            if term in index:
                where, weight = index[term]
                if len(where) == len(ids) and len(who) == len(lane):
                    scores += weight[:, None] * query_weight[None, :]
                else:
                    scores[np.ix_(where, who)] += weight[:, None] * query_weight[None, :]
        own = (ids[:, None] == lane["id"].to_numpy()[None, :]) & (marks[:, None] == lane["row"].to_numpy()[None, :])
        left = copies[:, None] - own  # a row is no candidate of its own
        for col, (query, row) in enumerate(zip(lane["id"].tolist(), lane["row"].tolist())):
            open_ = np.flatnonzero(left[:, col] > 0)
            mine = scores[open_, col]
            if len(open_) > k:
                least = np.partition(mine, len(mine) - k)[len(mine) - k]
                open_, mine = open_[mine >= least], mine[mine >= least]
            # candidates are sorted by id, so a stable sort by falling score settles ties
            order = sorted(range(len(open_)), key=lambda i: -int(mine[i]))[:k]
            many = [(query, row, int(ids[open_[i]]), int(mine[i])) for i in order for _ in range(min(k, int(left[open_[i], col])))]
            found += many[:k]
    return found


def block_top(queries: pd.DataFrame, candidates: pd.DataFrame, k: int, scale: int = SCALE) -> pd.DataFrame:
    """The k best candidates of a block for each query of a block; scores as decimal text.

    Rows with weights too large for 64-bit sums are scored apart, in whole numbers of any size.
    """
    names = ["query_id", "query_row", "copies", "vec_id", "score"]
    if queries.empty or candidates.empty:
        return pd.DataFrame({n: [] for n in names}).astype({"query_id": "int64", "query_row": "int64", "copies": "int64", "vec_id": "int64", "score": str})
    candidates = candidates.sort_values("id", kind="stable")
    small = [_fits(rows, scale) for rows in (queries, candidates)]
    found: list[tuple] = []
    for asked, offered, kind in (
        (queries[small[0]], candidates[small[1]], np.int64), (queries[small[0]], candidates[~small[1]], object),
        (queries[~small[0]], candidates, object),
    ):
        if len(asked) and len(offered):
            found += _best(asked, offered, k, kind, scale)
    copies = {(i, r): c for i, r, c in zip(queries["id"], queries["row"], queries["copies"])}
    rows = [(q, r, copies[q, r], v, str(s)) for q, r, v, s in found]
    return pd.DataFrame(rows, columns=names)


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding",
          query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest integer inner products per query.

    Ties go to the smaller vec_id; a query with fewer than k candidates returns them all. Every row
    is a candidate of every query but of the one it is itself: rows are told apart by id and
    vector, and of several equal rows a query among them leaves out one. Repeated rows and ids are
    that many candidates, and that many queries with results of their own. Vectors that are null
    or hold a null or non-finite component, and rows without an id, take no part. Vectors of
    different lengths meet in the terms they share; an empty one scores 0. Scores are exact
    whatever the size of the components; one that leaves 64 bits is ranked by its true value and
    returned as the nearest long. Other columns are ignored, empty tables give an empty result.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    asked, offered = rows_of(queries, key, vector), rows_of(candidates, key, vector)
    parts = {}
    for name, rows, size in (("q", asked, query_block), ("c", offered, candidate_block)):
        count = rows.count()
        parts[name] = max(1, -(-count // size))

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        mine = F.pmod(F.xxhash64("id", "row"), F.lit(parts[own])).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.lit(parts[other] - 1)))
        return rows.select("*", mine.alias(own), every.alias(other))

    pairs = dealt(asked, "q", "c").groupBy("q", "c").cogroup(dealt(offered, "c", "q").groupBy("q", "c"))
    best = pairs.applyInPandas(lambda left, right: block_top(left, right, k), "query_id long, query_row long, copies long, vec_id long, score string")
    # whole numbers as text: by sign, then by length, then digit by digit
    below, digits = F.col("score").startswith("-"), F.replace("score", F.lit("-"), F.lit(""))
    shape = [F.when(below, 0).otherwise(1), F.when(below, -F.length(digits)).otherwise(F.length(digits))]
    order = Window.partitionBy("query_id", "query_row").orderBy(
        shape[0].desc(), shape[1].desc(), F.when(~below, digits).desc(), F.when(below, digits).asc(), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    nearest = F.coalesce(F.expr("try_cast(score AS BIGINT)"), F.when(below, F.lit(-(2**63))).otherwise(F.lit(2**63 - 1)))
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return ranked.select("query_id", "rank", "vec_id", nearest.alias("score"), each.alias("_copy")).drop("_copy")
