"""N-gram Jaccard join with vertical partitioning.

A document's set holds its distinct five-word shingles (A-Z lower-cased; with fewer words the whole sequence). Two documents
link when their intersection is at least 80 hundredths of their union.

The global order of shingles is by the magnitude of their document frequency, rarest first, then by hash. Shards of documents
learn the frequencies in one round of questions, each shingle sent once from a shard. A set of n shingles can only link with
one that shares a shingle among its first n - ceil(0.8 n) + 1, so a document without a shared one there is done. The others'
sets are cut vertically: the order is divided into fragments, a row holds one fragment of one set, partial overlaps are counted
in each fragment, and the sums per pair decide.

Equal sets are one node, first within a shard. To find components without all pairs of a group, every node first meets two
leaders among the holders of its prefix shingles: the one made of the most frequent shingles and the one with the smallest id.
Links found give components. Nodes that share a prefix shingle but are still in different components may link too. In a
group of near copies these are many; there nodes are told by their difference from the group's root, and only pairs whose
differences have enough in common are compared (see ``_near_root``). So no link between components is missed.

Defined cases: null or empty texts, or ones without words, have an empty set and link with nothing; rows without an id link
with nothing and have no component; rows that share an id but not their set are nodes of their own. Other columns are not
read. Texts are taken whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askloop.llm.common import ANSWERED, ASKED, NO_ID, Asked, ids_array, in_ranges, mix, pack, shingles, split_at, unpack_docs, unpack_sorted, widths
from askloop.session import materialize

PERCENT = 80
WORDS = 5
BITS = 48
CLASSES = 8
RANGES = 4
SALTS = 16
SETS = (
    "doc_id bigint, part int, n_shingles bigint, rep_id bigint, rep_part int, score bigint, "
    "prefix array<bigint>, fragments array<int>, tokens array<array<bigint>>"
)


class Sets:
    """The shingle sets of a shard's documents: hash and document of each element, by document and hash."""

    def __init__(self, blobs: list[bytes], words: int):
        ids, hashes, owners, n = [], [], [], 0
        for blob in blobs:
            docs = unpack_docs(blob)
            h, d, _ = shingles(docs, words)
            ids.append(docs.ids)
            hashes.append(h)
            owners.append(d + n)
            n += len(docs)
        self.ids, h, d = (np.concatenate(x) for x in (ids, hashes, owners))
        order = np.lexsort((h, d))
        h, d = h[order], d[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        self.hashes, self.owners = h[new], d[new]
        self.sizes = np.bincount(self.owners, minlength=n)

    def asked(self) -> Asked:
        known = self.ids[self.owners] != NO_ID
        return Asked(self.hashes[known] >> np.uint64(64 - BITS))


def _question(shard: int, asked: Asked, counts: np.ndarray, buckets: int) -> pa.Table:
    table = asked.rows(shard, buckets, BITS)
    cuts = split_at(asked.numbers, buckets, BITS)
    tags = [_zip(counts[cuts[b] : cuts[b + 1]].astype(np.uint32)) for b in table.column("bucket").to_pylist()]
    return table.set_column(3, "tags", pa.array(tags, pa.binary()))


def _zip(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.tobytes())


def _unzip(blob: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), kind)


def _magnitudes(asked: pa.Table) -> pa.Table:
    """For each shingle of a bucket the binary magnitude of its document frequency: 0 for one document, 1 for 2 or 3, ..."""
    parts = [unpack_sorted(b) for b in asked.column("body").to_pylist()]
    counts = [_unzip(t, np.uint32) for t in asked.column("tags").to_pylist()]
    found = [np.zeros(len(p), np.uint8) for p in parts]
    for numbers, slices in in_ranges(parts):
        every = Asked(numbers)
        total = np.bincount(every.place, np.concatenate([c[s] for c, s in zip(counts, slices)]))
        magnitude, at = np.floor(np.log2(total)).astype(np.uint8)[every.place], 0
        for out, s in zip(found, slices):
            out[s] = magnitude[at : at + s.stop - s.start]
            at += s.stop - s.start
    bits = [_zip(f) for f in found]
    return pa.table({"shard": asked.column("shard"), "bucket": asked.column("bucket"), "bits": pa.array(bits, pa.binary())})


def prefix_size(n: np.ndarray, percent: int) -> np.ndarray:
    return n - -(-percent * n // 100) + 1


def _sets(shard: Sets, answers: list[dict], buckets: int, percent: int) -> pa.Table:
    asked = shard.asked()
    cuts = split_at(asked.numbers, buckets, BITS)
    found = np.zeros(len(asked.numbers), np.uint8)
    for row in answers:
        found[cuts[row["bucket"]] : cuts[row["bucket"] + 1]] = _unzip(row["bits"], np.uint8)
    n, sizes, ids = len(shard.ids), shard.sizes, shard.ids
    magnitude = np.zeros(len(shard.hashes), np.uint8)
    known = ids[shard.owners] != NO_ID
    magnitude[known] = found[asked.place]

    # Equal sets become one node; rows that share an id but not their set are parts of it.
    begins = np.minimum(np.cumsum(sizes) - sizes, len(shard.hashes))
    sums = [np.add.reduceat(np.append(mix(shard.hashes + np.uint64(k)), np.uint64(0)), begins) for k in (1, 2)]
    one, two = (np.where(sizes > 0, s, np.uint64(0)) for s in sums)
    nodes: dict[tuple, tuple[int, int]] = {}
    parts_of: dict[int, dict[tuple, int]] = {}
    keys = list(zip(sizes.tolist(), one.tolist(), two.tolist()))
    parts = []
    for i in sorted(range(n), key=lambda i: (int(ids[i]), keys[i])):
        own = parts_of.setdefault(int(ids[i]), {})
        part = own.setdefault(keys[i], len(own))
        parts.append((i, part))
        if keys[i][0] and ids[i] != NO_ID:
            nodes.setdefault(keys[i], (int(ids[i]), part, i))
    part = np.zeros(n, np.int64)
    for i, p in parts:
        part[i] = p
    rep = [nodes.get(k, (int(ids[i]), int(part[i]), -1)) if ids[i] != NO_ID else (int(NO_ID), 0, -1) for i, k in enumerate(keys)]
    leads = np.array([r[2] == i for i, r in enumerate(rep)])

    order = np.lexsort((shard.hashes, magnitude, shard.owners))
    h, d, m = shard.hashes[order], shard.owners[order], magnitude[order]
    place = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    shared = m > 0
    in_prefix = shared & (place < prefix_size(sizes, percent)[d]) & leads[d]
    candidate = np.bincount(d[in_prefix], minlength=n) > 0
    score = np.where(sizes > 0, np.bincount(d, m * 1000.0, n) / np.maximum(sizes, 1), 0).astype(np.int64)
    prefix_ends = np.cumsum(np.append(0, np.bincount(d[in_prefix], minlength=n)))
    segment = shared & candidate[d]
    h, d, m = h[segment], d[segment], m[segment]
    fragment = np.minimum(m, CLASSES - 1).astype(np.int64) * RANGES + (h >> np.uint64(62)).astype(np.int64)
    new = np.ones(len(h), bool)
    new[1:] = (fragment[1:] != fragment[:-1]) | (d[1:] != d[:-1])
    firsts = np.flatnonzero(new)
    segments = np.cumsum(np.append(0, np.bincount(d[firsts], minlength=n)))
    inner = pa.ListArray.from_arrays(pa.array(np.append(firsts, len(h)), pa.int32()), pa.array(h.view(np.int64)))
    return pa.table({
        "doc_id": ids_array(ids), "part": pa.array(part, pa.int32()), "n_shingles": pa.array(sizes.astype(np.int64)),
        "rep_id": ids_array(np.array([r[0] for r in rep], np.int64)), "rep_part": pa.array([r[1] for r in rep], pa.int32()),
        "score": pa.array(score),
        "prefix": pa.ListArray.from_arrays(pa.array(prefix_ends, pa.int32()), pa.array(shard.hashes[order][in_prefix].view(np.int64))),
        "fragments": pa.ListArray.from_arrays(pa.array(segments, pa.int32()), pa.array(fragment[firsts], pa.int32())),
        "tokens": pa.ListArray.from_arrays(pa.array(segments, pa.int32()), inner),
    })


def shingle_sets(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """``SETS`` for every row: its set size, its node, and the prefix and fragments of nodes that may link."""
    shards, buckets = widths(docs.sparkSession)
    by_shard = pack(docs, shards).groupBy("shard")

    def question(key: tuple, blobs: pa.Table) -> pa.Table:
        asked = Sets(blobs.column("docs").to_pylist(), words).asked()
        return _question(key[0].as_py(), asked, np.bincount(asked.place, minlength=len(asked.numbers)), buckets)

    def finish(blobs: pa.Table, answers: pa.Table) -> pa.Table:
        return _sets(Sets(blobs.column("docs").to_pylist(), words), answers.to_pylist(), buckets, percent)

    asked = by_shard.applyInArrow(question, ASKED)
    answers = asked.groupBy("bucket").applyInArrow(_magnitudes, ANSWERED)
    return by_shard.cogroup(answers.groupBy("shard")).applyInArrow(finish, SETS)


def links(pairs: DataFrame, fragments: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, n_a, n_b) that link: overlaps counted in each fragment and summed per pair."""
    one = pairs.join(fragments.select(F.col("node").alias("a"), "fragment", F.col("tokens").alias("mine")), "a")
    other = fragments.select(F.col("node").alias("b"), "fragment", "tokens")
    partial = F.size(F.array_intersect("mine", "tokens"))
    counted = one.join(other, ["b", "fragment"]).select("a", "b", "n_a", "n_b", partial.alias("partial"))
    summed = counted.groupBy("a", "b", "n_a", "n_b").agg(F.sum("partial").alias("shared"))
    return summed.filter(100 * F.col("shared") >= percent * (F.col("n_a") + F.col("n_b") - F.col("shared"))).select("a", "b")


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, label): the smallest node that each node of ``edges`` (a, b) reaches."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("label")), name)
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b")
        lower = near.groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lowered = labels.join(lower, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        following = lowered.join(jump, "label", "left").select("node", "old", F.least("label", "further").alias("label"))
        following = materialize(following, name)
        changed = following.filter("label <> old").limit(1).count()
        labels = following.drop("old")
        if not changed:
            return labels


def join(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    sets = materialize(shingle_sets(docs, percent, words), "shingle-sets")
    node = F.struct("doc_id", "part").alias("node")
    nodes = sets.filter("size(prefix) > 0").withColumn("node", node)
    fragments = nodes.select("node", F.inline(F.arrays_zip(F.col("fragments").alias("fragment"), F.col("tokens").alias("tokens"))))
    prefixes = nodes.select("node", F.col("n_shingles").alias("n"), "score", F.explode("prefix").alias("token"))

    # Two leaders for each node; a leader is chosen for a token, then for a node the best of its tokens' leaders.
    leader = prefixes.groupBy("token").agg(
        F.max_by(F.struct("node", "n", "score"), F.struct("score", "n", "node")).alias("common"),
        F.min(F.struct("node", "n")).alias("least"),
    )
    met = prefixes.join(leader, "token")
    best = F.max_by("common", F.struct("common.score", "common.n", "common.node"))
    chosen = materialize(met.groupBy("node", "n").agg(best.alias("common"), F.min("least").alias("least")), "leaders")
    pairs = chosen.select("node", "n", F.inline(F.array(F.struct("common.node", "common.n"), F.struct("least.node", "least.n"))))
    first = materialize(links(_possible(pairs.toDF("a", "n_a", "b", "n_b"), percent).distinct(), fragments, percent), "links")
    labels = components(first, "components")

    # What these links leave apart: nodes with a common prefix token in different components.
    labelled = prefixes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    apart = labelled.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high")
    left = labelled.join(apart.select("token"), "token", "left_semi").join(_roots(chosen), "node")
    left = materialize(left.select("token", "node", "n", "label", "root"), "apart")
    mine = left.select("token", "root", *[F.col(c).alias(f"{c}_a") for c in ("node", "n", "label")])
    others = left.select("token", F.col("root").alias("root_b"), *[F.col(c).alias(f"{c}_b") for c in ("node", "n", "label")])
    rest = mine.join(others, "token").filter("root <> root_b AND label_a < label_b")
    rest = rest.unionByName(_near_root(left, nodes, percent), allowMissingColumns=True).select(
        F.col("node_a").alias("a"), "n_a", F.col("node_b").alias("b"), "n_b"
    )
    second = links(_possible(rest, percent).distinct(), fragments, percent)
    labels = components(materialize(first.unionAll(second), "links"), "components")

    mine = labels.select(F.col("node").alias("rep"), F.col("label.doc_id").alias("smallest"))
    rows = sets.select("doc_id", "n_shingles", F.struct(F.col("rep_id").alias("doc_id"), F.col("rep_part").alias("part")).alias("rep"))
    return rows.join(mine, "rep", "left").select("doc_id", "n_shingles", F.coalesce("smallest", "rep.doc_id").alias("component_id"))


def _roots(chosen: DataFrame) -> DataFrame:
    """(node, root): the leader's leader's leader, which most nodes of a group of near copies have in common."""
    step = chosen.select("node", F.col("common.node").alias("root"))
    for _ in range(2):
        onward = chosen.select(F.col("node").alias("root"), F.col("common.node").alias("next"))
        step = step.join(onward, "root").select("node", F.col("next").alias("root"))
    return step


def _near_root(left: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs in different components under one root that may link.

    A node is told by how it differs from its root: the tokens added and removed. Two nodes differ by as many tokens as
    their differences do, so with e the size of a node's difference and ``w`` = (100 + percent) e - (100 - percent) n, two
    nodes link if and only if 2 (100 + percent) times the number of changes that they share is at least the sum of their
    w. So they share an added token, or else each one's removed tokens alone must be enough for that.
    """
    up, down = 100 + percent, 100 - percent
    tokens = nodes.select("node", F.flatten("tokens").alias("all"))
    salts = F.explode(F.array(*[F.lit(k) for k in range(SALTS)])).alias("salt")
    roots = left.select("root").distinct().join(tokens.toDF("root", "held"), "root").select("*", salts)
    own = left.select("node", "n", "label", "root").distinct().join(tokens, "node")
    own = own.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(roots, ["root", "salt"])
    own = own.withColumns({"added": F.array_except("all", "held"), "removed": F.size(F.array_except("held", "all"))})
    differs = F.col("n") + F.size("held") - 2 * (F.size("all") - F.size("added"))
    own = own.withColumn("w", up * differs - down * F.col("n")).withColumn("reach", 2 * up * F.col("removed") - F.col("w"))
    own = materialize(own.select("root", "node", "n", "label", "added", "w", "reach"), "differences")

    def side(df: DataFrame, end: str, *more: str) -> DataFrame:
        return df.select("root", *more, *[F.col(c).alias(f"{c}_{end}") for c in ("node", "n", "label", "w", "reach")])

    added = own.withColumn("token", F.explode("added"))
    shared = added.groupBy("root", "token").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high")
    added = added.join(shared.select("root", "token"), ["root", "token"], "left_semi")
    by_token = side(added, "a", "token").join(side(added, "b", "token"), ["root", "token"]).filter("label_a < label_b")

    furthest = own.groupBy("root").agg(F.max("reach").alias("furthest"))
    able = own.join(furthest, "root").filter("w <= furthest")
    counted = able.groupBy("root", "label").agg(F.count("*").alias("size"))
    most = counted.groupBy("root").agg(F.max_by("label", F.struct("size", "label")).alias("most"), F.count("*").alias("labels"))
    able = able.join(most.filter("labels > 1"), "root")
    by_removed = side(able.filter("label <> most"), "a").join(side(able, "b"), "root")
    by_removed = by_removed.filter("label_a <> label_b AND w_a <= reach_b AND w_b <= reach_a")
    columns = ["root", "node_a", "n_a", "node_b", "n_b"]
    return by_token.select(columns).unionByName(by_removed.select(columns))


def _possible(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs of different nodes whose sizes allow a link."""
    small, large = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    return pairs.filter((F.col("a") != F.col("b")) & (100 * small >= percent * large))


def keep_one(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """``docs`` with one row of each component, that of the smallest id, and all rows that link with nothing."""
    found = join(docs, percent, words).filter("component_id < doc_id").select(F.col("doc_id").alias("__copy")).distinct()
    return docs.join(found, F.col("doc_id") == F.col("__copy"), "left_anti")
