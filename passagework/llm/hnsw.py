"""Approximate nearest neighbours: one navigable small-world graph per shard."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.llm.vectors import clean_vectors, search_in_blocks
from passagework.operators.common import materialize, top_per

WIDTH = 4  # candidates opened per step


def beam(unit: np.ndarray, links: np.ndarray, asked: np.ndarray, entry: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of one layer for many queries in lock step.

    Returns ids (-1 for none) and cosines of the ``ef`` best nodes met, best first. In each
    step every query opens its best unopened candidates; it ends when all it holds are open.
    """
    rows = np.arange(len(asked))
    ids = np.full((len(asked), ef), -1, np.int32)
    near = np.full((len(asked), ef), -np.inf, np.float32)
    opened = np.zeros((len(asked), ef), bool)
    seen = np.zeros((len(asked), len(unit)), bool)
    ids[:, 0] = entry
    near[:, 0] = (unit[entry] * asked).sum(1)
    seen[rows, entry] = True
    width = min(WIDTH, ef)
    while True:
        waiting = np.where(opened | (ids < 0), -np.inf, near)
        live = rows[(waiting > -np.inf).any(1)]
        if not len(live):
            break
        waiting = waiting[live]
        pick = np.argpartition(-waiting, width - 1, axis=1)[:, :width] if ef > width else np.argsort(-waiting, axis=1)[:, :width]
        ready = np.take_along_axis(waiting, pick, 1) > -np.inf
        opened[live[:, None], pick] |= ready
        nodes = np.where(ready, np.take_along_axis(ids[live], pick, 1), -1)
        next_ids = np.where(nodes[:, :, None] >= 0, links[nodes], -1).reshape(len(live), -1)
        next_ids = np.sort(next_ids, axis=1)  # a node met twice in this step counts once
        good = next_ids >= 0
        good[:, 1:] &= next_ids[:, 1:] != next_ids[:, :-1]
        good &= ~seen[live[:, None], next_ids]
        line, place = np.nonzero(good)
        new = next_ids[line, place]
        seen[live[line], new] = True
        close = np.full(next_ids.shape, -np.inf, np.float32)
        close[line, place] = np.einsum("ij,ij->i", unit[new], asked[live[line]])
        both = np.concatenate((near[live], close), 1)
        best = np.argpartition(-both, ef - 1, axis=1)[:, :ef]
        near[live] = np.take_along_axis(both, best, 1)
        ids[live] = np.take_along_axis(np.concatenate((ids[live], np.where(good, next_ids, -1)), 1), best, 1)
        opened[live] = np.take_along_axis(np.concatenate((opened[live], np.zeros(next_ids.shape, bool)), 1), best, 1)
    order = np.argsort(-near, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(near, order, 1)


def choose(unit: np.ndarray, base: np.ndarray, ids: np.ndarray, count: int) -> np.ndarray:
    """``count`` neighbours of each base node among its candidates (-1 for none).

    Nearest first; a candidate nearer to one already chosen than to the base waits, and
    fills a free place at the end.
    """
    valid = ids >= 0
    points = unit[ids]
    near = np.where(valid, np.einsum("bcd,bd->bc", points, unit[base]), -np.inf)
    order = np.argsort(-near, axis=1, kind="stable")
    ids, near, valid = (np.take_along_axis(x, order, 1) for x in (ids, near, valid))
    points = np.take_along_axis(points, order[:, :, None], 1)
    pair = points @ points.transpose(0, 2, 1)
    kept = np.zeros(ids.shape, bool)
    for c in range(ids.shape[1]):
        rival = np.where(kept[:, :c], pair[:, c, :c], -np.inf).max(1, initial=-np.inf)
        kept[:, c] = valid[:, c] & (near[:, c] > rival) & (kept.sum(1) < count)
    rank = np.argsort(np.where(kept, 0, np.where(valid, 1, 2)), axis=1, kind="stable")[:, :count]
    out = np.where(np.take_along_axis(valid, rank, 1), np.take_along_axis(ids, rank, 1), -1)
    return np.pad(out, ((0, 0), (0, count - out.shape[1])), constant_values=-1)


def build(unit: np.ndarray, m: int, ef: int, seed: int = 7) -> list[np.ndarray]:
    """Neighbour arrays by layer, layer 0 with ``2 m`` places, for rows sorted by falling level.

    Row 0 is the entry. Rows are inserted in batches that search the graph built so far and
    each other, so a batch is never larger than what stands already.
    """
    n = len(unit)
    levels = node_levels(n, m, seed)
    layers = [np.full((n, 2 * m if layer == 0 else m), -1, np.int32) for layer in range(int(levels.max(initial=0)) + 1)]
    done = min(1, n)
    while done < n:
        new = np.arange(done, min(n, done + min(256, done)))
        asked, entry = unit[new], np.zeros(len(new), np.int32)
        own = asked @ asked.T
        np.fill_diagonal(own, -np.inf)
        for layer in range(len(layers) - 1, -1, -1):
            joins = levels[new] >= layer
            if (~joins).any():
                found, _ = beam(unit[:done], layers[layer], asked[~joins], entry[~joins], 1)
                entry[~joins] = found[:, 0]
            if not joins.any():
                continue
            nodes = new[joins]
            found, near = beam(unit[:done], layers[layer], asked[joins], entry[joins], ef)
            entry[joins] = found[:, 0]
            mates = own[np.ix_(joins, joins)]
            some = np.argsort(-mates, axis=1)[:, : min(m, len(nodes) - 1)]
            pool = np.concatenate((found[:, : 3 * m], nodes[some].astype(np.int32)), 1)
            chosen = choose(unit, nodes, pool, m)
            links = layers[layer]
            links[nodes, :m] = chosen
            source, target = np.repeat(nodes, m), chosen.ravel()
            order = np.argsort(target, kind="stable")
            source, target = source[order][target[order] >= 0], target[order][target[order] >= 0]
            where, first, count = np.unique(target, return_index=True, return_counts=True)
            back = np.full((len(where), count.max(initial=0)), -1, np.int32)
            back[np.repeat(np.arange(len(where)), count), np.arange(len(target)) - np.repeat(first, count)] = source
            had = links[where]
            back = np.where((back[:, :, None] == had[:, None, :]).any(2), -1, back)
            both = np.concatenate((had, back), 1)
            full = (both >= 0).sum(1) > links.shape[1]
            packed = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), 1)[:, : links.shape[1]]
            links[where[~full]] = packed[~full]
            if full.any():
                links[where[full]] = choose(unit, where[full], both[full], links.shape[1])
        done = int(new[-1]) + 1
    return layers


def node_levels(n: int, m: int, seed: int) -> np.ndarray:
    """Levels by rank, highest first: geometric with ratio 1/m, the same for equal ``n``."""
    draws = np.random.default_rng(seed).random(n)
    return np.sort(np.floor(-np.log(np.maximum(draws, 1e-12)) / np.log(m)).astype(int))[::-1]


def search(unit: np.ndarray, layers: list[np.ndarray], asked: np.ndarray, ef: int) -> np.ndarray:
    """The ``ef`` nodes found nearest to each query, best first (-1 for none)."""
    entry = np.zeros(len(asked), np.int32)
    for links in layers[:0:-1]:
        entry = beam(unit, links, asked, entry, 1)[0][:, 0]
    return beam(unit, layers[0], asked, entry, ef)[0]


def unit_rows(vecs: np.ndarray) -> np.ndarray:
    return (vecs / np.sqrt((vecs**2).sum(1, keepdims=True))).astype(np.float32)


SHARD = "shard int, width int, layers array<binary>, vecs binary, ids array<array<long>>"


def build_index(vectors: DataFrame, keep: int, m: int = 16, ef: int = 100, shard_rows: int = 4096) -> DataFrame:
    """One row per shard: its distinct vectors, their smallest ids and flat neighbour arrays.

    Equal vectors are one node with their ``keep`` smallest ids; no answer can need more of
    them. Distinct vectors go to shards by hash, about ``shard_rows`` to each.
    """
    few = top_per(vectors.select("vec", "vec_id"), ["vec"], [F.col("vec_id")], keep)
    nodes = materialize(few.groupBy("vec").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "hnsw-nodes")
    shards = max(1, -(-nodes.count() // shard_rows))

    def make(table: pa.Table) -> pa.Table:
        vecs = np.array(table["vec"].to_pylist(), float)
        order = np.argsort([ids[0] for ids in table["ids"].to_pylist()], kind="stable")
        vecs = vecs[order]
        ids = table["ids"].take(pa.array(order)).combine_chunks()
        layers = build(unit_rows(vecs), m, ef)
        cols = [[table["shard"][0].as_py()], [vecs.shape[1]], [[x.tobytes() for x in layers]], [vecs.tobytes()]]
        kinds = [pa.int32(), pa.int32(), pa.list_(pa.binary()), pa.binary()]
        arrays = [pa.array(c, t) for c, t in zip(cols, kinds)] + [pa.array([ids.to_pylist()], pa.list_(pa.list_(pa.int64())))]
        return pa.Table.from_arrays(arrays, ["shard", "width", "layers", "vecs", "ids"])

    sharded = nodes.withColumn("shard", F.pmod(F.xxhash64("vec"), F.lit(shards)).cast("int"))
    return materialize(sharded.groupBy("shard").applyInArrow(make, SHARD), "hnsw-index")


def nearest(
    vectors: DataFrame, queries: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding",
    m: int = 16, ef_build: int = 100, ef: int = 96, shard_rows: int = 4096, block_rows: int = 8192,
) -> DataFrame:
    """Each query's ``k`` nearest vectors found by cosine: ``query_id, rank, vec_id, score``.

    Queries are the rows for which ``queries`` (over ``vec_id``) holds; candidates are all
    rows but the query's own. Every vector is indexed. Each shard's graph is searched for
    every query with a beam of ``ef``; the cosines of what it finds are then computed in
    double precision on the original vectors, and the shards' best are merged.

    Ties go to the smaller id. Zero vectors take no part, nor does what ``clean_vectors``
    leaves out; an empty table, or no query, gives an empty table. Other columns are not
    read. A task holds one shard and one block of queries.
    """
    spark, schema = vectors.sparkSession, "query_id long, rank int, vec_id long, score double"
    clean = clean_vectors(vectors, vec_id, embedding).filter(F.exists("vec", lambda x: x != 0))
    index = build_index(clean, k + 1, m, ef_build, shard_rows)

    def answer(ids: list[int], vecs: list[list[float]]) -> DataFrame:
        shared = spark.sparkContext.broadcast((np.array(ids, np.int64), np.array(vecs, float)))

        def run(batches):
            asked_ids, asked = shared.value
            lengths = np.sqrt((asked**2).sum(1))
            for batch in batches:
                for row in batch.to_pylist():
                    points = np.frombuffer(row["vecs"]).reshape(-1, row["width"])
                    layers = [np.frombuffer(x, np.int32).reshape(len(points), -1) for x in row["layers"]]
                    unit, norms = unit_rows(points), np.sqrt((points**2).sum(1))
                    out = ([], [], [])
                    for a in range(0, len(asked), 256):
                        part = slice(a, a + 256)
                        for q, found in zip(range(a, len(asked)), search(unit, layers, unit_rows(asked[part]), min(ef, len(points)))):
                            found = found[found >= 0]
                            scores = (points[found] * asked[q]).sum(1) / (norms[found] * lengths[q])
                            pairs = sorted((-s, i) for s, f in zip(scores.tolist(), found) for i in row["ids"][f] if i != asked_ids[q])[:k]
                            for column, values in zip(out, ([asked_ids[q]] * len(pairs), [i for _, i in pairs], [-s for s, _ in pairs])):
                                column.extend(values)
                    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["query_id", "vec_id", "score"])

        return index.mapInArrow(run, "query_id long, vec_id long, score double")

    return search_in_blocks(clean.filter(queries), block_rows, answer, k, schema)
