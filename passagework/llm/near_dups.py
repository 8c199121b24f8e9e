"""Near-duplicate groups: SuperMinHash signatures, banding, verification, components."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.llm.common import components, fresh, small_batches, without
from passagework.operators.common import join_sized, materialize

SHINGLES_PER_STEP = 60_000
SMALL_BUCKET = 16
MINOR_ROWS, MEMBER_ROWS = 256, 1024


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (multiply and shift, twice)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles.

    Words are runs without ASCII white space, A-Z lower-cased. A text of fewer than
    ``size`` words has its whole sequence as one shingle; one without words has none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    span = min(size, len(words))
    out = np.full(len(words) - span + 1, span, np.uint64)
    for i in range(span):
        out = mixed(out + hashes[i : i + len(out)])
    return np.unique(out)


def super_minhash(hashes: np.ndarray, row: np.ndarray, rows: int, m: int) -> np.ndarray:
    """SuperMinHash values of ``rows`` sets given as their elements and the elements' rows.

    Element by element, step j draws a value in [j, j + 1) for the j-th place of the
    element's own random permutation of the m components (a swap per step), so its values
    are spread over all components instead of drawn apart from each other. A set stops as
    soon as every component is below j: later steps cannot lower any.
    """
    low = np.full((rows, m), np.inf)
    place = np.tile(np.arange(m, dtype=np.uint8), (len(hashes), 1))
    live = np.arange(len(hashes))
    unit = 2.0**-53
    with np.errstate(over="ignore"):
        for j in range(m):
            own = hashes[live]
            value = (mixed(own + np.uint64(2 * j + 1)) >> np.uint64(11)) * unit
            k = j + ((mixed(own ^ np.uint64(0x5851F42D4C957F2D * (2 * j + 3) % 2**64)) >> np.uint64(11)) * unit * (m - j)).astype(np.int64)
            component = place[live, k]
            place[live, k] = place[live, j]
            np.minimum.at(low.reshape(-1), row[live] * m + component, value + j)
            if j + 1 < m:
                live = live[(low.max(1) >= j + 1)[row[live]]]
                if not len(live):
                    break
    return low


def signatures(texts: list[str | None], size: int, m: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(set size, digest of the set, signature of two bytes a component) of every text."""
    at = 0
    while at < len(texts):
        sets, held = [], 0
        while at < len(texts) and (not sets or held < SHINGLES_PER_STEP):
            sets.append(shingle_set(texts[at], size))
            held += len(sets[-1])
            at += 1
        low = super_minhash(np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets]), len(sets), m)
        with np.errstate(over="ignore"):
            short = (mixed(low.view(np.uint64)) >> np.uint64(48)).astype(np.uint16)
        for one, line in zip(sets, short):
            yield len(one), hashlib.blake2b(one.tobytes(), digest_size=16).digest(), line.tobytes()


def _pairs(found: DataFrame) -> DataFrame:
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()


def likely(pairs: DataFrame, nodes: DataFrame, m: int, least: int) -> DataFrame:
    """Pairs whose signatures agree in ``least`` of ``m`` components or more."""
    for side in "ab":
        sides = nodes.select(F.col("node").alias(side), F.col("signature").alias(f"s{side}"))
        pairs = pairs.join(sides, side)

    @F.arrow_udf("boolean")
    def close(one: pa.Array, two: pa.Array) -> pa.Array:
        grids = [np.frombuffer(b"".join(x.to_pylist()), np.uint16).reshape(len(x), m) for x in (one, two)]
        return pa.array((grids[0] == grids[1]).sum(1) >= least)

    return pairs.filter(close("sa", "sb")).select("a", "b").distinct()


def verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs whose full sets have 100 * intersection >= percent * union.

    The text of ``a`` is joined first: a pivot of many pairs is then spread by ``b``.
    """
    for side in "ab":
        pairs = pairs.join(texts.select(F.col("node").alias(side), F.col("text").alias(f"t{side}")), side)

    @F.arrow_udf("boolean")
    def same(one: pa.Array, two: pa.Array) -> pa.Array:
        out, last, left = [], None, None
        for x, y in zip(one, two):
            x, y = x.as_py(), y.as_py()
            if x != last or left is None:
                last, left = x, shingle_set(x, size)
            right = shingle_set(y, size)
            both = len(np.intersect1d(left, right, assume_unique=True))
            out.append(both > 0 and 100 * both >= percent * (len(left) + len(right) - both))
        return pa.array(out, pa.bool_())

    return pairs.filter(same("ta", "tb")).select("a", "b").distinct()


def full_sets(texts: DataFrame, size: int) -> DataFrame:
    """``node, shingles``: the set of every row of ``texts``, sorted as signed numbers."""

    @F.arrow_udf("array<long>")
    def sets(column: pa.Array) -> pa.Array:
        found = [np.sort(shingle_set(t.as_py(), size).view(np.int64)) for t in column]
        ends = np.cumsum([0, *map(len, found)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *found])))

    return texts.select("node", sets("text").alias("shingles"))


def own_shingles(sets: DataFrame) -> DataFrame:
    """How many of a node's shingles no other node of ``sets`` has: ``node``, ``own``.

    Nodes with more than one row get no count.
    """
    each = sets.select("node", F.explode("shingles").alias("shingle"))
    single = each.groupBy("shingle").agg(F.count("*").alias("k"), F.min("node").alias("node")).filter("k = 1")
    several = sets.groupBy("node").count().filter("count > 1")
    return single.groupBy("node").agg(F.count("*").alias("own")).join(several, "node", "left_anti")


def open_members(
    members: DataFrame, labels: DataFrame, nodes: DataFrame, percent: int, sets_of: Callable[[DataFrame], DataFrame]
) -> tuple[DataFrame, DataFrame]:
    """Members of buckets whose pivots have left them in several components, and their sets.

    Of a node's ``n`` shingles ``own`` stand in no other node of such buckets, so no
    partner shares more than ``n - own`` with it: nodes that this keeps below the threshold
    with everyone are left out. Returns (``bucket, band, node, n, own``; ``node, shingles``).
    """
    own = _labelled(members, labels)
    hubs = own.filter("node = hub").select("bucket", F.col("label").alias("hub_label"))
    own = materialize(own.join(hubs, "bucket").select("bucket", "band", "node", (F.col("label") != F.col("hub_label")).alias("minor")), "dup-buckets")
    rows = materialize(own.join(own.filter("minor").select("bucket").distinct(), "bucket"), "dup-open")
    ids = materialize(rows.select("node").distinct(), "dup-open-ids")
    sets = materialize(sets_of(ids), "dup-open-sets")
    sized = ids.join(nodes.select("node", "n"), "node").join(own_shingles(sets), "node", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    sized = materialize(sized.filter(100 * (F.col("n") - F.col("own")) >= percent * F.col("n")), "dup-open-sizes")
    return materialize(rows.select("bucket", "band", "node").join(sized, "node"), "dup-open"), sets


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    found = rows.join(labels.select(F.col("id").alias("node"), "component"), "node", "left")
    return found.withColumn("label", F.coalesce("component", "node")).drop("component")


def _reachable(percent: int) -> Column:
    """Whether sets with ``n1``, ``own1`` and ``n2``, ``own2`` can reach the threshold at all."""
    most = F.least(F.col("n1") - F.col("own1"), F.col("n2") - F.col("own2"))
    return 100 * most >= percent * (F.col("n1") + F.col("n2") - most)


def _sides(rows: DataFrame, label: Column) -> DataFrame:
    return rows.select("bucket", *[F.col(c).alias(f"{c}1") for c in ("node", "n", "own")], label.alias("label1"))


def _central(rows: DataFrame) -> DataFrame:
    """The member of each bucket with the smallest share of own shingles: ``bucket, node2, n2, own2, label2``."""
    first = F.min_by(F.struct("node", "n", "own", "label"), F.struct(F.col("own") / F.col("n"), F.col("node")))
    return rows.groupBy("bucket").agg(first.alias("c")).select("bucket", *[F.col(f"c.{c}").alias(f"{c}2") for c in ("node", "n", "own", "label")])


def central_pairs(rows: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Each open member with the most central member of its bucket, if in another component.

    Copies with edits of their own are near the text they were made from, rarely near one
    pivot taken by its number; this second star brings a large group together.
    """
    own = _labelled(rows, labels)
    star = _sides(own, F.col("label")).join(_central(own), "bucket").filter((F.col("label1") != F.col("label2")) & _reachable(percent))
    return _pairs(star.select(F.col("node1").alias("a"), F.col("node2").alias("b")))


def missed_pairs(
    rows: DataFrame, sets: DataFrame, labels: DataFrame, nodes: DataFrame, tested: DataFrame, m: int, band: int, least: int, percent: int
) -> tuple[DataFrame, DataFrame]:
    """What open members of one bucket but different components still have to do with each other.

    Members apart from their bucket's central one (minors) are compared with all others,
    where sizes and own shingles let the pair reach the threshold. Small buckets give pairs
    to confirm. Large ones are compared in blocks of bounded size, signature against
    signature, then set against set, each pair in the first band it shares, and give only
    confirmed links, one for each minor and other component. Nothing is capped. Returns
    (pairs to confirm, confirmed links).
    """
    own = _labelled(rows, labels)
    own = own.join(_central(own).select("bucket", F.col("label2").alias("mid")), "bucket").withColumn("minor", F.col("label") != F.col("mid")).drop("mid")
    own = materialize(own, "dup-open")
    counts = own.groupBy("bucket").agg(F.count("*").alias("members"), F.count_if("minor").alias("minors"))
    split = materialize(own.join(counts.filter("minors > 0"), "bucket"), "dup-open")
    small, large = split.filter(F.col("members") <= SMALL_BUCKET), split.filter(F.col("members") > SMALL_BUCKET)
    one = _sides(small.filter("minor"), F.col("label"))
    two = small.select("bucket", *[F.col(c).alias(f"{c}2") for c in ("node", "n", "own", "label")])
    few = one.join(two, "bucket").filter((F.col("label1") != F.col("label2")) & _reachable(percent))
    few = _pairs(few.select(F.col("node1").alias("a"), F.col("node2").alias("b"))).join(tested, ["a", "b"], "left_anti")
    many = large.join(nodes.select("node", "signature"), "node").join(sets, "node")
    i_of = F.pmod(F.xxhash64("node"), F.ceil(F.col("minors") / MINOR_ROWS))
    j_of = F.pmod(F.xxhash64("node"), F.ceil(F.col("members") / MEMBER_ROWS))
    every = lambda n, rows: F.explode(F.sequence(F.lit(0), F.ceil(F.col(n) / rows) - 1))
    keep = ["bucket", "band", "node", "label", "n", "own", "signature", "shingles"]
    blocks = many.filter("minor").select(*keep, i_of.alias("i"), every("members", MEMBER_ROWS).alias("j"), F.lit(True).alias("left"))
    blocks = blocks.unionByName(many.select(*keep, every("minors", MINOR_ROWS).alias("i"), j_of.alias("j"), F.lit(False).alias("left")))

    def compare(table: pa.Table) -> pa.Table:
        left, right = table.filter(table["left"]), table.filter(pa.compute.invert(table["left"]))
        out_a, out_b = [], []
        if left.num_rows and right.num_rows:
            grid = np.frombuffer(b"".join(right["signature"].to_pylist()), np.uint16).reshape(-1, m)
            labels_of, ids_of, n_of, own_of = (right[c].to_numpy() for c in ("label", "node", "n", "own"))
            here, held = table["band"][0].as_py(), right["shingles"].combine_chunks()
            flat, ends = held.flatten().to_numpy(), held.offsets.to_numpy() - held.offsets[0].as_py()
            mine = left["shingles"].combine_chunks()
            for k, row in enumerate(left.drop_columns(["shingles"]).to_pylist()):
                top = np.minimum(n_of - own_of, row["n"] - row["own"])
                near = np.flatnonzero((labels_of != row["label"]) & (100 * top >= percent * (n_of + row["n"] - top)))
                same = grid[near] == np.frombuffer(row["signature"], np.uint16)
                first = same[:, : m // band * band].reshape(len(near), m // band, band).all(2).argmax(1) == here
                likely_ones = first & (same.sum(1) >= least)
                near, same = near[likely_ones], same[likely_ones]
                own, done = mine[k].values.to_numpy(), set()
                for at in near[np.argsort(-same.sum(1), kind="stable")]:
                    if labels_of[at] in done:
                        continue
                    other = flat[ends[at] : ends[at + 1]]
                    spot = np.minimum(np.searchsorted(own, other), len(own) - 1)
                    both = int((own[spot] == other).sum())
                    if 100 * both >= percent * (len(own) + len(other) - both):
                        done.add(labels_of[at])
                        out_a.append(row["node"])
                        out_b.append(int(ids_of[at]))
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    found = blocks.groupBy("bucket", "i", "j").applyInArrow(compare, "a long, b long")
    return likely(few, nodes, m, least), _pairs(found)


def near_duplicates(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 5, percent: int = 80, m: int = 100, band: int = 4
) -> DataFrame:
    """Add ``n_shingles``, ``component_id`` and ``kept`` to every document.

    Documents are linked when the Jaccard similarity of their sets of ``shingle``-word
    shingles is ``percent`` or more; ``component_id`` is the smallest id reachable and
    ``kept`` marks the document that has it.

    1. Documents of one set are one node. Nodes get SuperMinHash signatures of ``m``
       components, cut into bands of ``band``: a pair at the least similarity shares no
       band with a chance of ``(1 - s**band) ** (m / band)``, 2e-6 at 0.8.
    2. Every node of a band's bucket is paired with the bucket's smallest id. Pairs whose
       signatures agree far less than the threshold asks (5 deviations, a chance of 3e-7) go;
       the others are confirmed on the full sets. Links are grouped by union-find.
    3. Where that leaves members of a bucket in different components (``open_members``),
       they are paired with the bucket's most central one, and what is then still apart
       with all others of the bucket that could reach the threshold (``missed_pairs``);
       both are confirmed and grouped again. So no pair of a bucket
       in different components goes untested, and no group is expanded to all its pairs.

    Null and empty texts have no shingles and are linked with nothing. A row without an id
    is linked with nothing either: its component is null and it is kept. Rows of one id
    count as one node. An empty table gives an empty table; columns with one of the added
    names, in upper or lower case, are replaced. Ids are whole numbers.
    """
    small_batches(docs.sparkSession)
    added = ("n_shingles", "component_id", "kept")
    columns = without(docs, added)
    s, digest, node = fresh(docs, "_set", "_digest", "_node")
    share = percent / 100
    least = math.floor(m * share - 5 * math.sqrt(m * share * (1 - share)))

    @F.arrow_udf("struct<n:long,digest:binary,signature:binary>")
    def sign(texts: pa.Array) -> pa.Array:
        found = list(signatures(texts.to_pylist(), shingle, m))
        arrays = [pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.binary(), pa.binary()))]
        return pa.StructArray.from_arrays(arrays, ["n", "digest", "signature"])

    rows = materialize(docs.select(*columns, sign(F.col(text)).alias(s)), "dup-rows")
    linked = rows.filter((F.col(f"{s}.n") > 0) & F.col(doc_id).isNotNull())
    sets = materialize(
        linked.groupBy(F.col(f"{s}.digest").alias(digest)).agg(F.min(F.col(doc_id).cast("long")).alias(node), F.max(f"{s}.n").alias("n"), F.max(f"{s}.signature").alias("signature")), "dup-sets"
    )
    nodes = sets.select(F.col(node).alias("node"), "n", "signature")
    slices = F.transform(F.sequence(F.lit(0), F.lit(m // band - 1)), lambda i: F.xxhash64(i, F.substring("signature", i * 2 * band + 1, F.lit(2 * band))))
    banded = nodes.select("node", F.posexplode(slices).alias("band", "bucket"))
    shared = banded.groupBy("bucket").agg(F.min("node").alias("hub"), F.count("*").alias("k")).filter("k > 1")
    members = materialize(banded.join(shared.select("bucket", "hub"), "bucket"), "dup-members")
    tested = materialize(_pairs(members.select(F.col("hub").alias("a"), F.col("node").alias("b"))), "dup-tested")

    def texts_of(ids: DataFrame) -> DataFrame:
        bodies = linked.select(F.col(doc_id).cast("long").alias("node"), F.col(text).alias("text"))
        return materialize(join_sized(bodies, ids, ["node"]), "dup-texts")

    def confirm(pairs: DataFrame) -> DataFrame:
        ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "dup-ids")
        return materialize(verified(pairs, texts_of(ids), shingle, percent), "dup-links")

    links = confirm(materialize(likely(tested, nodes, m, least), "dup-likely"))
    labels = components(links)
    rest, open_sets = open_members(members, labels, nodes, percent, lambda ids: full_sets(texts_of(ids), shingle))
    if rest.limit(1).count():
        star = materialize(central_pairs(rest, labels, percent).join(tested, ["a", "b"], "left_anti"), "dup-tested")
        links = materialize(links.unionByName(confirm(materialize(likely(star, nodes, m, least), "dup-likely"))), "dup-links")
        labels, tested = components(links), tested.unionByName(star)
        pairs, found = missed_pairs(rest, open_sets, labels, nodes, tested, m, band, least, percent)
        pairs, found = materialize(pairs, "dup-missed"), materialize(found, "dup-links")
        if pairs.limit(1).count():
            found = found.unionByName(confirm(pairs))
        if found.limit(1).count():
            labels = components(links.unionByName(found))
    roots = sets.select(digest, node).join(labels.withColumnRenamed("id", node), node, "left")
    roots = materialize(roots.select(F.col(digest), F.coalesce("component", node).alias("component_id")), "dup-roots")
    whole = rows.withColumn(digest, F.when((F.col(f"{s}.n") > 0) & F.col(doc_id).isNotNull(), F.col(f"{s}.digest")))
    own = F.coalesce("component_id", F.col(doc_id).cast("long"))
    joined = whole.filter(F.col(digest).isNotNull()).join(roots, digest)
    alone = whole.filter(F.col(digest).isNull()).withColumn("component_id", F.lit(None).cast("long"))
    out = joined.unionByName(alone)
    return out.select(
        *columns, F.col(f"{s}.n").alias("n_shingles"), own.alias("component_id"), F.coalesce(F.col(doc_id).cast("long") == own, F.lit(True)).alias("kept")
    )
