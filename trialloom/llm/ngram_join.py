"""N-gram Jaccard join of whole texts by signature trees, exact for every pair.

Documents are sets of word shingles; two link when their Jaccard similarity
reaches the threshold. Documents with equal sets are one class from the start.

The top of the tree divides the token space. Under one order of all tokens, two
sets can only reach the threshold if their prefixes (the first 1/5 of each set)
share a token, so a branch is a token and holds the classes with it in their
prefix: between different branches the possible overlap is too small. Tokens that
are frequent in some part of the corpus come last in the order, so frequent lines
and passages make no branches. Any one order is exact; the frequent tokens only
make it a good one. The first token that two linked sets share is early, in the
first 1/9, in the smaller one; so a class stays in a branch only with another one of
near size of which the smaller has the token early. A branch is cut where the next
size is too large for the one before. Branches with the same members are one branch.

Below, a branch holds its classes by size in leaves of up to 256, and a leaf in
nodes of 16. A node has the OR of its members' token bitmaps and their size range.
Dual traversal descends only into node pairs whose sizes are compatible and whose
maximum possible overlap reaches the least overlap that a link needs. Large
branches are joined leaf by leaf, so no branch meets in one task.

Pairs that survive are checked with their exact sets. The first traversal keeps,
in each branch, only a spanning forest of the surviving pairs, best first; the
second keeps every surviving pair whose classes are not yet connected. So a group
of thousands of copies costs about its number of rows, and no link is lost.

Defined cases: a null, empty or blank text has no set, links with nothing and is
its own component; a text with fewer words than a shingle is one shingle; texts
of any length are whole; rows with a null id get a null component; extra columns
are ignored; an empty table gives an empty result. Classes and their links know no
ids: a row that repeats an id with another text has the set, the links and the copies
of its own text. Only the components of ids join what one id holds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialloom.llm.common import digest, hash_words, mix, shingles, tidy
from trialloom.staging import stage

WIDTH = 5
#: Jaccard similarity in hundredths.
THRESHOLD = 80
#: Frequent tokens: at least this share of the documents of a block (and 8); the most frequent of them are ordered last.
FREQUENT_SHARE, FREQUENT_LEAST, FREQUENT_KEPT, FREQUENT_BLOCK = 0.002, 8, 50_000, 4096
LEAF, NODE = 256, 16
#: Bits of a prefix token. Tokens that fall together share a branch, which costs time and changes no result.
TOKEN_BITS = 40
#: Up to so many ids (16 MB) are broadcast to pick rows; beyond, they are joined by shuffle.
BROADCAST_IDS = 1_000_000


def text_set(text: str | None) -> np.ndarray:
    """The sorted distinct shingle hashes of a text: ASCII lower case, words between ASCII white space."""
    return shingles(hash_words((text or "").encode().lower()), WIDTH)


def least_overlap(a, b):
    """The smallest intersection of linked sets of sizes ``a`` and ``b``."""
    return -((-(a + b) * THRESHOLD) // (100 + THRESHOLD))


def _prefix_length(n: int) -> int:
    return n - -(-n * THRESHOLD // 100) + 1


def _bitmap(values: np.ndarray) -> np.ndarray:
    """Bits of the tokens; as many as the next power of two above twice their number."""
    width = 64 << max(0, int(2 * len(values) - 1).bit_length() - 6)
    bits = np.zeros(width, np.uint8)
    bits[(values & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view("<u8")


def frequent_tokens(docs: DataFrame) -> np.ndarray:
    """Tokens that many documents share, by how many; counted over all documents."""

    def run(batches):
        held: list[np.ndarray] = []

        def counted():
            values, n = np.unique(np.concatenate(held), return_counts=True)
            keep = n >= max(FREQUENT_LEAST, FREQUENT_SHARE * len(held))
            return pa.RecordBatch.from_arrays([pa.array(values[keep].view(np.int64)), pa.array(n[keep].astype(np.int64))], names=["token", "n"])

        for batch in batches:
            for text in batch.column("text"):
                held.append(text_set(text.as_py()))
                if len(held) == FREQUENT_BLOCK:
                    yield counted()
                    held = []
        if held:
            yield counted()

    found = docs.select("text").mapInArrow(tidy(run), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    rows = found.orderBy(F.col("n").desc(), "token").limit(FREQUENT_KEPT).collect()
    return np.array([r.token for r in reversed(rows)], np.int64).view(np.uint64)


def describe(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """doc_id, n and digest of every row; node, bitmap and prefix of the first row of each set in a task.

    So copies carry nothing on, and a group of them is at most one row for each task.
    A node is the number of the task and of the row in it, so it means one set only.
    """
    by_value = np.argsort(frequent)
    ordered = frequent[by_value]
    short = np.uint64((1 << TOKEN_BITS) - 1)

    def prefix(values: np.ndarray) -> np.ndarray:
        length = _prefix_length(len(values))
        if not len(ordered):
            return values[:length]
        at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
        late = ordered[at] == values
        rare = values[~late][:length]
        if len(rare) == length:
            return rare
        last = values[late][np.argsort(by_value[at[late]], kind="stable")]
        return np.concatenate([rare, last[: length - len(rare)]])

    def run(batches):
        seen: set[bytes] = set()
        node = TaskContext.get().partitionId() << 40
        for batch in batches:
            n, names, nodes, bitmaps, prefixes = [], [], [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                values = text_set(text.as_py())
                name = digest(values)
                first = len(values) > 0 and doc_id is not None and name not in seen
                if first:
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(name)
                node += 1
                n.append(len(values))
                names.append(name)
                nodes.append(node if first else None)
                bitmaps.append(_bitmap(values).tobytes() if first else None)
                prefixes.append((prefix(values) & short).view(np.int64) if first else None)
            columns = [pa.array(n, pa.int64()), pa.array(names, pa.binary()), pa.array(nodes, pa.int64()), pa.array(bitmaps, pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "n", "digest", "node", "bitmap", "prefix"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, n long, digest binary, node long, bitmap binary, prefix array<long>")


def _branches(batches):
    """Rows in token order to branches of at least two classes of near sizes, named by their members.

    The third column is twice the size, plus 1 where the token is early in the set.
    """
    seen: set[int] = set()
    held = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))

    def grouped(token, node, marked):
        n, early = marked >> 1, marked & 1 == 1
        # Members of a token in order of size. Of a pair that may link the smaller one is early; equal sizes count both ways.
        order = np.lexsort((node, ~early, n, token))
        token, node, n, early = token[order], node[order], n[order], early[order]
        at = np.arange(len(token))
        first = np.concatenate(([True], token[1:] != token[:-1]))
        begin = np.maximum.accumulate(np.where(first, at, 0))
        near = np.append(~first[1:] & (100 * n[:-1] >= THRESHOLD * n[1:]), False)
        last = np.concatenate(([-1], np.maximum.accumulate(np.where(early, at, -1))[:-1]))
        keep = (early & near) | ((last >= begin) & (100 * n[last] >= THRESHOLD * n))
        token, node, n = token[keep], node[keep], n[keep]
        # A branch ends where the next size is too large for the one before.
        starts = np.flatnonzero(np.append(True, (token[1:] != token[:-1]) | (100 * n[:-1] < THRESHOLD * n[1:]))[: len(token)])
        if not len(starts):
            return pa.RecordBatch.from_arrays([pa.array(np.empty(0, np.int64))] * 3, names=["branch", "node", "n"])
        sizes = np.diff(np.append(starts, len(token)))
        name = mix(np.add.reduceat(mix(node.view(np.uint64)), starts) + sizes.astype(np.uint64)).view(np.int64)
        if len(seen) > 1_000_000:
            seen.clear()
        fresh = np.array([s > 1 and not (v in seen or seen.add(v)) for s, v in zip(sizes.tolist(), name.tolist(), strict=True)], bool)
        keep = np.repeat(fresh, sizes)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(name, sizes)[keep]), pa.array(node[keep]), pa.array(n[keep])], names=["branch", "node", "n"])

    for batch in batches:
        new = [batch.column(i).to_numpy() for i in range(3)]
        token, node, n = (np.concatenate(x) for x in zip(held, new, strict=True))
        if not len(token):
            continue
        cut = int(np.searchsorted(token, token[-1])) if token[0] != token[-1] else 0
        if cut:
            yield grouped(token[:cut], node[:cut], n[:cut])
        held = (token[cut:], node[cut:], n[cut:])
    if len(held[0]):
        yield grouped(*held)


class _Leaf:
    """Up to 256 classes whose bitmaps have one width, in nodes of 16."""

    def __init__(self, node: np.ndarray, n: np.ndarray, comp: np.ndarray, bits: np.ndarray):
        self.node, self.n, self.comp, self.bits = node, n, comp, bits

    def folded(self, words: int) -> _Leaf:
        bits = self.bits
        while bits.shape[1] > words:
            half = bits.shape[1] // 2
            bits = bits[:, :half] | bits[:, half:]
        return _Leaf(self.node, self.n, self.comp, bits)

    def grown(self):
        """For each node: its members' places, OR bitmap, size range, and the most tokens that share bits."""
        extra = self.n - np.bitwise_count(self.bits).sum(1, dtype=np.int64)
        at = np.arange(0, len(self.n), NODE)
        ors = np.bitwise_or.reduceat(self.bits, at, axis=0)
        return at, ors, np.minimum.reduceat(self.n, at), np.maximum.reduceat(self.n, at), np.maximum.reduceat(extra, at), extra

    def packed(self) -> list:
        return [self.node.tobytes(), self.n.tobytes(), self.comp.tobytes(), self.bits.tobytes()]

    @staticmethod
    def unpacked(values: list) -> _Leaf:
        node, n, comp = (np.frombuffer(v, np.int64) for v in values[:3])
        return _Leaf(node, n, comp, np.frombuffer(values[3], "<u8").reshape(len(node), -1))


def _possible(a_bits, b_bits, a_extra, b_extra, a_most, b_most):
    """The largest overlap that the bitmaps allow."""
    common = np.bitwise_count(a_bits & b_bits).sum(-1, dtype=np.int64)
    return np.minimum(common + np.minimum(a_extra, b_extra), np.minimum(a_most, b_most))


def traverse(a: _Leaf, b: _Leaf, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Dual traversal of two leaves: places in ``a`` and ``b`` of the pairs that may link, and their possible overlap."""
    none = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))
    if 100 * a.n.max() < THRESHOLD * b.n.min() or 100 * b.n.max() < THRESHOLD * a.n.min():
        return none
    words = min(a.bits.shape[1], b.bits.shape[1])
    a, b = a.folded(words), b.folded(words)
    (a_at, a_or, a_low, a_high, a_more, a_extra), (b_at, b_or, b_low, b_high, b_more, b_extra) = a.grown(), b.grown()
    found = []
    for i in range(len(a_at)):
        fits = (100 * a_high[i] >= THRESHOLD * b_low) & (100 * b_high >= THRESHOLD * a_low[i])
        fits &= _possible(a_or[i], b_or, a_more[i], b_more, a_high[i], b_high) >= least_overlap(a_low[i], b_low)
        if same:
            fits &= np.arange(len(b_at)) >= i
        below = np.flatnonzero(fits)
        if not len(below):
            continue
        right = np.concatenate([np.arange(b_at[j], min(b_at[j] + NODE, len(b.n))) for j in below])
        for x in range(a_at[i], min(a_at[i] + NODE, len(a.n))):
            y = right[(a.comp[x] != b.comp[right]) & (100 * a.n[x] >= THRESHOLD * b.n[right]) & (100 * b.n[right] >= THRESHOLD * a.n[x])]
            if same:
                y = y[y > x]
            if not len(y):
                continue
            most = _possible(a.bits[x], b.bits[y], a_extra[x], b_extra[y], a.n[x], b.n[y])
            apart = np.bitwise_count(a.bits[x] ^ b.bits[y]).sum(-1, dtype=np.int64)
            most = np.minimum(most, (a.n[x] + b.n[y] - apart) // 2)
            ok = most >= least_overlap(a.n[x], b.n[y])
            if ok.any():
                found.append((np.full(int(ok.sum()), x), y[ok], most[ok]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else none


def _forest(a: np.ndarray, b: np.ndarray, score: np.ndarray) -> np.ndarray:
    """The places of a spanning forest of the pairs, by falling score."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(up, up)
        return x

    kept = []
    for i in np.argsort(-score, kind="stable").tolist():
        x, y = root(int(a[i])), root(int(b[i]))
        if x != y:
            parent[x] = y
            kept.append(i)
    return np.array(kept, np.int64)


_LEAF_FIELDS = "kind int, branch long, leaf int, low long, high long, a long, b long, node binary, n binary, comp binary, bits binary"


PAIR, LEAF_ROW, OPEN = 0, 1, 2


def _leaves(forest: bool):
    """Rows in branch and size order to surviving pairs of small branches and to the leaves of large ones.

    Branches that have more pairs than a forest keeps are named too.
    """
    names = [f.split()[0] for f in _LEAF_FIELDS.split(", ")]
    kinds = [pa.int32(), pa.int64(), pa.int32(), *[pa.int64()] * 4, *[pa.binary()] * 4]

    def run(batches):
        current, rows = None, []
        out: list[list] = []

        def pairs(found):
            a, b, score = (np.concatenate(c) for c in zip(*found, strict=True))
            keep = _forest(a, b, score) if forest else np.arange(len(a))
            if len(keep) < len(a):
                out.append([OPEN, current, *[None] * 9])
            for x, y in zip(a[keep].tolist(), b[keep].tolist(), strict=True):
                out.append([PAIR, None, None, None, None, min(x, y), max(x, y), None, None, None, None])

        def close():
            if len(rows) < 2:
                return
            leaves, at = [], 0
            while at < len(rows):
                size = len(rows[at][3])
                stop = at
                while stop < min(at + LEAF, len(rows)) and len(rows[stop][3]) == size:
                    stop += 1
                some = rows[at:stop]
                node, n, comp = (np.array([r[i] for r in some], np.int64) for i in range(3))
                leaves.append(_Leaf(node, n, comp, np.frombuffer(b"".join(r[3] for r in some), "<u8").reshape(len(some), -1)))
                at = stop
            if len(rows) > LEAF:
                if forest:
                    out.append([OPEN, current, *[None] * 9])
                for number, leaf in enumerate(leaves):
                    out.append([LEAF_ROW, current, number, int(leaf.n.min()), int(leaf.n.max()), None, None, *leaf.packed()])
                return
            found = []
            for i, x in enumerate(leaves):
                for j in range(i, len(leaves)):
                    p, q, score = traverse(x, leaves[j], i == j)
                    found.append((x.node[p], leaves[j].node[q], score))
            pairs(found)

        def batch_out():
            done = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)
            out.clear()
            return done

        for batch in batches:
            for branch, node, n, comp, bits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if branch != current:
                    close()
                    current, rows = branch, []
                rows.append((node, n, comp, bits))
            if len(out) >= 2000:
                yield batch_out()
        close()
        yield batch_out()

    return run


def _leaf_pairs(forest: bool):
    def run(batches):
        for batch in batches:
            a, b = [], []
            for row in batch.to_pylist():
                x, y = (_Leaf.unpacked([row[f"{k}{side}"] for k in ("node", "n", "comp", "bits")]) for side in ("", "2"))
                p, q, score = traverse(x, y, row["leaf"] == row["leaf2"])
                p, q = x.node[p], y.node[q]
                if forest:
                    keep = _forest(p, q, score)
                    p, q = p[keep], q[keep]
                a.append(np.minimum(p, q))
                b.append(np.maximum(p, q))
            empty = np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([empty, *v])) for v in (a, b)], names=["a", "b"])

    return run


def candidates(branches: DataFrame, nodes: DataFrame, forest: bool) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs (a, b) that dual traversal leaves, and the branches in which a forest kept only some of them.

    ``branches`` has branch, node, n, comp; ``nodes`` has node, bitmap.
    """
    rows = branches.join(nodes.select("node", "bitmap"), "node").select("branch", "node", "n", "comp", "bitmap")
    rows = rows.repartition("branch").sortWithinPartitions("branch", "n", "node")
    first = stage(rows.mapInArrow(tidy(_leaves(forest)), _LEAF_FIELDS), "join-leaves")
    large = first.filter(F.col("kind") == LEAF_ROW).drop("a", "b", "kind")
    other = large.select(F.col("branch"), *[F.col(c).alias(f"{c}2") for c in large.columns if c != "branch"])
    # Leaves lie in the order of size: a later one is at most too large.
    fit = (F.col("leaf") <= F.col("leaf2")) & (100 * F.col("high") >= THRESHOLD * F.col("low2"))
    met = large.join(other, "branch").filter(fit).select("leaf", "leaf2", *[f"{k}{s}" for s in ("", "2") for k in ("node", "n", "comp", "bits")])
    across = met.mapInArrow(tidy(_leaf_pairs(forest)), "a long, b long")
    pairs = first.filter(F.col("kind") == PAIR).select("a", "b").unionByName(across).distinct()
    return pairs, first.filter(F.col("kind") == OPEN).select("branch")


def _unpacked(text: bytes) -> np.ndarray:
    return text_set(zstandard.decompress(text).decode())


def confirm(pairs: DataFrame, carriers: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs whose exact sets reach the threshold. ``carriers`` has doc_id, digest and node of every node."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    ids = stage(ids.join(carriers.select("node", "doc_id", "digest"), "node"), "join-ids")
    picked = ids.select("doc_id").distinct()
    picked = F.broadcast(picked) if ids.count() <= BROADCAST_IDS else picked

    def sets(batches):
        seen: set[bytes] = set()
        for batch in batches:
            names, found = [], []
            for text in batch.column("text"):
                values = text_set(text.as_py())
                name = digest(values)
                if name not in seen:
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(name)
                    names.append(name)
                    found.append(zstandard.compress((text.as_py() or "").encode()))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(found, pa.binary())], names=["digest", "packed"])

    # An id may hold other texts too; a set may stand in several tasks. One row of each set goes on, as
    # compressed text: hashes do not compress, and would be three to four times as much to shuffle.
    texts = docs.select("doc_id", "text").join(picked, "doc_id", "left_semi").select("text")
    one = texts.mapInArrow(tidy(sets), "digest binary, packed binary").groupBy("digest").agg(F.first("packed").alias("packed"))
    known = stage(one.join(ids.select("digest", "node"), "digest").select("node", "packed"), "join-sets")

    def check(batches):
        for batch in batches:
            a, b, left, right = batch.columns
            ok, last, y = [], None, None
            for x, packed in zip(left, right, strict=True):
                x, packed = _unpacked(x.as_py()), packed.as_py()
                if packed != last:  # the rows lie in the order of b
                    last, y = packed, _unpacked(packed)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= THRESHOLD * (len(x) + len(y) - both))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], names=["a", "b"])

    left, right = (known.select(F.col("node").alias(k), F.col("packed").alias(f"text_{k}")) for k in ("a", "b"))
    return stage(pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(tidy(check), "a long, b long"), "join-links")


def components(links: DataFrame) -> DataFrame:
    """node and comp, the smallest node reachable, of every node with a link.

    Alternates two steps until nothing changes: every node links its larger
    neighbours, then all its smaller ones and itself, to its smallest neighbour.
    """
    edges = stage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "join-edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("_v")).select(F.col("u").alias("_u"), F.least("u", "_v").alias("m"))
        large = both.filter("v > u").join(least, F.col("u") == F.col("_u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        # A node with no larger neighbour keeps its link to the smallest one.
        tops = edges.groupBy("u").agg(F.min("v").alias("v"))
        large = large.unionByName(tops).filter("u <> v").distinct()
        large = stage(large, "join-edges")
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), "m")
        small = large.join(least, F.col("u") == F.col("_u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select(F.col("_u").alias("u"), F.col("m").alias("v"))).filter("u <> v").distinct()
        edges = stage(small, "join-edges")
        new = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == state:
            break
        state = new
    own = edges.groupBy("u").agg(F.min("v").alias("comp")).select(F.col("u").alias("node"), "comp")
    return own.unionByName(own.select(F.col("comp").alias("node"), "comp").distinct())


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(base, classes, links): the rows' sets, each set's node and component by links between sets, and the links."""
    base = stage(describe(docs, frequent_tokens(docs)), "join-base")
    # A class is known by the smallest of the nodes that carry its prefix.
    named = base.filter("n > 0 and doc_id is not null")
    classes = stage(named.groupBy("digest").agg(F.min("doc_id").alias("class_id"), F.min("node").alias("node")), "join-classes")
    carriers = base.filter("prefix is not null")
    tokens = carriers.select(F.posexplode("prefix").alias("_at", "token"), "node", "n")
    # n - least_overlap(n, n) + 1
    early = F.col("_at") <= F.expr(f"n * {100 - THRESHOLD} div {100 + THRESHOLD}")
    tokens = tokens.select("token", "node", (2 * F.col("n") + early.cast("long")).alias("marked")).repartition("token").sortWithinPartitions("token", "node")
    held = tokens.mapInArrow(tidy(_branches), "branch long, node long, n long").distinct()
    known = carriers.select(F.col("node").alias("_carrier"), "digest").join(classes.select("digest", "node"), "digest").drop("digest")
    branches = held.withColumnRenamed("node", "_carrier").join(known, "_carrier").select("branch", "node", "n").distinct()
    branches = stage(branches, "join-branches")
    flat = carriers.select("node", "bitmap")

    pairs, more = candidates(branches.withColumn("comp", F.col("node")), flat, True)
    pairs = stage(pairs, "join-pairs")
    links = confirm(pairs, carriers, docs)
    comps = stage(components(links), "join-comps")

    unfinished = branches.join(more.distinct(), "branch", "left_semi")
    labelled = unfinished.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    open_ = labelled.groupBy("branch").agg(F.min("comp").alias("_low"), F.max("comp").alias("_high")).filter("_low < _high").select("branch")
    rest, _ = candidates(labelled.join(open_, "branch", "left_semi"), flat, False)
    added = confirm(stage(rest.join(pairs, ["a", "b"], "left_anti"), "join-pairs"), carriers, docs)
    links = links.unionByName(added)
    grouped = classes.join(components(links), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    return base, stage(grouped, "join-classes"), links


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, class_id (smallest id with the same set) and component_id of every row.

    A document is an id: rows that repeat one with different texts connect what their texts link to.
    """
    docs = docs.select("doc_id", "text")
    base, classes, links = _classes(docs)
    placed = base.select("doc_id", "n", "digest").join(classes, "digest", "left")
    # Ids with rows of different texts: as a rule there are none.
    held = placed.filter("doc_id is not null").groupBy("doc_id")
    several = held.agg(F.min("comp").alias("a"), F.max("comp").alias("_most"), (F.min("n") == 0).alias("_blank")).filter("a < _most or (_blank and a is not null)")
    several = stage(several, "join-several")
    repeated = not several.isEmpty()
    if repeated:
        tied = placed.filter("n > 0").join(several, "doc_id").select("a", F.col("comp").alias("b")).filter("a <> b").distinct()
        merged = components(tied).select(F.col("node").alias("comp"), F.col("comp").alias("_merged"))
        classes = classes.join(merged, "comp", "left").withColumn("comp", F.coalesce("_merged", "comp")).drop("_merged")

    # A component's name is the smallest id of any of its rows.
    least = classes.groupBy("comp").agg(F.min("class_id").alias("_least"))
    named = classes.join(least, "comp").select("digest", "class_id", F.col("_least").alias("component_id"))
    placed = base.select("doc_id", "n", "digest").join(named, "digest", "left")
    own = lambda c: F.when(F.col("doc_id").isNotNull(), F.coalesce(F.when(F.col("n") > 0, F.col(c)), "doc_id"))
    placed = placed.select("doc_id", F.col("n").alias("n_shingles"), own("class_id").alias("class_id"), own("component_id").alias("component_id"))
    if not repeated:
        return placed
    # A row without words goes with the rows of its id that have some.
    other = placed.filter("n_shingles > 0").join(several.filter("_blank").select("doc_id"), "doc_id", "left_semi")
    other = other.groupBy("doc_id").agg(F.min("component_id").alias("_other"))
    return placed.join(other, "doc_id", "left").withColumn("component_id", F.coalesce("_other", "component_id")).drop("_other")


def representatives(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: that with the smallest id.

    A text counts for itself here: a row whose id is repeated goes only if its own text is
    a near duplicate. Rows with a null id stay; of rows without words one of each id stays.
    """
    base, classes, _ = _classes(docs.select("doc_id", "text"))
    rows = base.filter("doc_id is not null").select("doc_id", "n", "digest")
    placed = rows.filter("n > 0").join(classes.select("digest", "comp"), "digest")
    first = placed.groupBy("comp").agg(F.min(F.struct("doc_id", "digest")).alias("kept")).select("kept.*")
    kept = stage(first.unionByName(rows.filter("n = 0").select("doc_id", "digest").distinct()), "join-kept")
    repeated = stage(rows.groupBy("doc_id").agg(F.count("*").alias("_n")).filter("_n > 1").select("doc_id"), "join-repeated")

    ids = kept.select("doc_id").distinct()
    # Ids are sent to the texts while they are few; else whole texts are shuffled to them.
    ids = F.broadcast(ids) if kept.count() <= BROADCAST_IDS else ids
    named = docs.filter("doc_id is not null").join(ids, "doc_id", "left_semi")
    single = named.join(repeated, "doc_id", "left_anti").select(*docs.columns)

    def tell(batches):
        for batch in batches:
            names = pa.array([digest(text_set(t.as_py())) for t in batch.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, names], names=[*batch.schema.names, digest_name])

    digest_name = "_join_digest"
    told = named.join(repeated, "doc_id", "left_semi").select(*docs.columns)
    told = told.mapInArrow(tidy(tell), T.StructType([*docs.schema.fields, T.StructField(digest_name, T.BinaryType())]))
    wanted = kept.select("doc_id", F.col("digest").alias(digest_name))
    several = told.join(wanted, ["doc_id", digest_name], "left_semi").dropDuplicates(["doc_id", digest_name]).select(*docs.columns)
    return single.unionByName(several).unionByName(docs.filter("doc_id is null"))
