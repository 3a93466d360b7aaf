"""N-gram Jaccard join through a token-group matrix.

A document is the set of its distinct 5-word shingles; two link when their Jaccard similarity reaches
the threshold. Documents with equal sets are one node. Tokens have one global order, in which frequent
ones come last, and a node's prefix is its first n - ceil(t * n) + 1 tokens: linked nodes share a token
of both prefixes. All tokens of all documents are counted.

Rare tokens (of few documents): nodes that share some are counted pair by pair, and a pair goes on to
verification if the shared prefix tokens together with all that could follow reach the overlap that a
link needs.

Frequent tokens: nodes whose prefix reaches them are mostly copies of one another with edits. Frequent
tokens met in one prefix form a family, and the nodes of a family and length class are cut into groups
of bounded size. Each group has the union of its tokens, one row of the token-group matrix. A query's
overlap with that union bounds its overlap with every member, and only groups whose bound reaches what a
link needs are opened; members already connected to the query are passed over. In families of several
groups, all nodes are first compared with a few leaders; what these connect is not compared again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from .buckets import MOST_BUCKETS, buckets_for, dealt, grouped
from .common import drop_staged, scope, staged
from .filters import filter_of, inside
from .hashing import Batch, mix64, slices

SIZE, PERCENT = 5, 75
#: A token of more documents than this is frequent (at most 254, as counts are kept in bytes).
FREQUENT = 16
#: Tokens and postings held by a task before it hands them on.
HELD_TOKENS, HELD_POSTINGS = 2_000_000, 500_000
#: Slots that tokens are counted in: about one for 4 characters of text; bytes of a bucket's counts, while buckets last.
SLOT_CHARS, BUCKET_SLOTS = 4, 1 << 22
#: Postings of a bucket that are paired at once.
PAIRED = 700_000
#: Nodes of a group; leaders of a family of several groups, and the nodes they are chosen from.
GROUP_NODES, LEADERS, CHOICE = 160, 4, 48


def need(a, b, percent: int = PERCENT):
    """The least overlap of sets of sizes a and b that link."""
    return -(-(percent * (a + b)) // (100 + percent))


def prefix_size(n, percent: int = PERCENT):
    return n - (percent * n + 99) // 100 + 1


def set_keys(keys: np.ndarray, cuts: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit key of each set of ascending tokens; equal sets have equal keys."""
    with np.errstate(over="ignore"):
        salt = np.uint64(0xA5A5A5A55A5A5A5A) + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(keys ^ salt), dtype=np.uint64)])
        size = np.diff(cuts).astype(np.uint64)
        return mix64(sums[cuts[1:]] - sums[cuts[:-1]] + mix64(size + np.uint64(1))).view(np.int64)


def slots_for(n_chars: int) -> int:
    """A power of two: with as many slots as tokens, 17 rare tokens next to never meet in one."""
    return 1 << min(48, max(20, (n_chars // SLOT_CHARS).bit_length()))


def slot_of(tokens: np.ndarray, slots: int) -> np.ndarray:
    return tokens >> np.uint64(64 - (slots.bit_length() - 1))


def pack_counts(at: np.ndarray, count: np.ndarray) -> bytes:
    """Ascending slots of a bucket as gaps of a byte (255: a long one, of 4 or 8 bytes, follows at the end), and their counts."""
    gap = np.diff(at, prepend=np.int64(0))
    long = gap[gap >= 255]
    return b"".join([np.array([len(at), len(long)], "<u4").tobytes(), np.minimum(gap, 255).astype("u1").tobytes(), count.astype("u1").tobytes(), long.astype("<i8").tobytes()])


def unpack_counts(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, m = (int(x) for x in np.frombuffer(blob, "<u4", 2))
    gap, count = np.frombuffer(blob, "u1", n, 8).astype(np.int64), np.frombuffer(blob, "u1", n, 8 + n)
    gap[gap == 255] = np.frombuffer(blob, "<i8", m, 8 + 2 * n)
    return np.cumsum(gap), count


def _sets(docs: DataFrame, slots: int, buckets: int, frequent: int, seed: int) -> DataFrame:
    """Rows of documents (bucket null: doc_id, n, node and a second key) and, per bucket, blobs of token counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, width = [], 0, slots // buckets

        def tokens() -> pa.RecordBatch:
            at, count = np.unique(np.concatenate(held), return_counts=True)
            bucket = np.minimum(at // np.uint64(width), np.uint64(buckets - 1)).astype(np.int64)
            some, first = np.unique(bucket, return_index=True)
            ends, at = [*first[1:].tolist(), len(at)], at.astype(np.int64)
            blobs = [pack_counts(at[a:b] - k * width, np.minimum(count[a:b], frequent + 1)) for k, a, b in zip(some.tolist(), first.tolist(), ends, strict=True)]
            none = pa.nulls(len(some), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), none, none, none, none, pa.array(blobs, pa.binary())], names=names)

        names = ["bucket", "doc_id", "n", "node", "second", "blob"]
        for batch in batches:
            for at, texts in slices(batch.column(1)):
                keys, cuts = Batch(texts, fold=True).shingles(SIZE)
                n = np.diff(cuts)
                held.append(slot_of(keys, slots))
                total += len(keys)
                size = len(texts)
                yield pa.RecordBatch.from_arrays([pa.nulls(size, pa.int32()), batch.column(0).slice(at, size), pa.array(n), pa.array(set_keys(keys, cuts, seed)), pa.array(set_keys(keys, cuts, ~seed & 0xFFFF)), pa.nulls(size, pa.binary())], names=names)
                if total >= HELD_TOKENS:
                    yield tokens()
                    held, total = [], 0
        if total:
            yield tokens()

    return docs.mapInArrow(run, "bucket int, doc_id long, n long, node long, second long, blob binary")


def _frequent(blobs: DataFrame, slots: int, buckets: int, frequent: int) -> DataFrame:
    """The slots of frequent tokens. A task holds a byte for each slot of its bucket, and one blob."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, counts, width = None, np.zeros(0, "u1"), slots // buckets

        def hot() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(counts > frequent) + last * width)], names=["slot"])

        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if bucket != last:
                    if last is not None:
                        yield hot()
                    last, counts = bucket, np.zeros(width + (slots - width * buckets if bucket == buckets - 1 else 0), "u1")
                at, count = unpack_counts(blob)
                counts[at] = np.minimum(counts[at].astype(np.int64) + count, frequent + 1)
        if last is not None:
            yield hot()

    return dealt(blobs.select("bucket", "blob"), F.col("bucket"), buckets).mapInArrow(run, "slot long")


def _prefixes(docs: DataFrame, frequent, slots: int, buckets: int, percent: int, seed: int) -> DataFrame:
    """Per bucket, blobs of (node, size, frequent tokens in its prefix, rare prefix tokens); bucket -1: rows of nodes that reach frequent tokens.

    Documents with equal sets give one entry per blob, and what is left of them meets in their buckets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, held, total = frequent.value, [], 0

        def postings() -> pa.RecordBatch:
            token, node, size, hot = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((token, node))
            token, node, size, hot = token[order], node[order], size[order], hot[order]
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
            token, node, size, hot = token[new], node[new], size[new], hot[new]
            bucket = (token >> np.uint64(32)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            token, node, size, hot = token[order].astype("<u4"), node[order], size[order].astype("<u4"), hot[order].astype("<u4")
            some, first = np.unique(bucket[order], return_index=True)
            ends = [*first[1:].tolist(), len(order)]
            blobs = [pack_postings(token[a:b], node[a:b], size[a:b], hot[a:b]) for a, b in zip(first.tolist(), ends, strict=True)]
            return out(some.astype(np.int32), blobs, None, None, None)

        def out(bucket, blobs, node, n, first) -> pa.RecordBatch:
            size = len(bucket)
            longs = [pa.nulls(size, pa.int64()) if x is None else pa.array(x, pa.int64()) for x in (node, n)]
            lists = pa.nulls(size, pa.list_(pa.int64())) if first is None else first
            return pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(blobs, pa.binary()) if blobs else pa.nulls(size, pa.binary()), *longs, lists], names=["bucket", "blob", "node", "n", "hot"])

        for batch in batches:
            for _, texts in slices(batch.column(0)):
                keys, cuts = Batch(texts, fold=True).shingles(SIZE)
                n, nodes = np.diff(cuts), set_keys(keys, cuts, seed)
                owner = np.repeat(np.arange(len(n)), n)
                often = inside(bits, slot_of(keys, slots))
                order = np.lexsort((keys, often, owner))  # rare before frequent, then by hash
                keys, often = keys[order], often[order]
                place = np.arange(len(keys)) - cuts[:-1][owner]
                in_prefix = place < prefix_size(n, percent)[owner]
                hot = np.bincount(owner[in_prefix & often], minlength=len(n))
                rare = in_prefix & ~often
                who = owner[rare]
                held.append((keys[rare], nodes[who], n[who], hot[who]))
                total += len(who)
                reach = np.flatnonzero(hot)
                if len(reach):
                    some = in_prefix & often
                    ends = np.cumsum(hot[reach])
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(keys[some].view(np.int64)))
                    yield out(np.full(len(reach), -1, np.int32), None, nodes[reach], n[reach], lists)
                if total >= HELD_POSTINGS:
                    yield postings()
                    held, total = [], 0
        if total:
            yield postings()

    return docs.select("text").mapInArrow(run, "bucket int, blob binary, node long, n long, hot array<long>")


def pack_postings(token: np.ndarray, node: np.ndarray, size: np.ndarray, hot: np.ndarray) -> bytes:
    """Postings of one bucket, grouped by node: a node's facts are stored once."""
    first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
    count = np.diff(np.concatenate([first, [len(token)]])).astype("<u4")
    return b"".join([np.array([len(first), len(token)], "<u4").tobytes(), node[first].astype("<i8").tobytes(), size[first].tobytes(), hot[first].tobytes(), count.tobytes(), token.tobytes()])


def unpack_postings(blob: bytes) -> tuple[np.ndarray, ...]:
    n, m = np.frombuffer(blob, "<u4", 2)
    at, out = 8, []
    for kind, k in (("<i8", n), ("<u4", n), ("<u4", n), ("<u4", n), ("<u4", m)):
        out.append(np.frombuffer(blob, kind, k, at))
        at += out[-1].nbytes
    node, size, hot, count, token = out
    return token, np.repeat(node, count), np.repeat(size, count), np.repeat(hot, count)


def _pairs(prefixes: DataFrame, buckets: int, percent: int) -> DataFrame:
    """Pairs of nodes that share rare prefix tokens and could link, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in grouped(batches):
            passes = -(-sum(int(np.frombuffer(p, "<u4", 2)[1]) for p in parts) // PAIRED)
            for turn in range(passes):
                yield from paired(*(np.concatenate(x) for x in zip(*(share(p, turn, passes) for p in parts), strict=True)))

    def share(blob: bytes, turn: int, passes: int) -> tuple[np.ndarray, ...]:
        """The postings of every passes-th token, so that a task holds few of them unpacked."""
        columns = unpack_postings(blob)
        mine = columns[0] % passes == turn
        return columns if passes == 1 else tuple(c[mine] for c in columns)

    def paired(token, node, size, hot) -> Iterator[pa.RecordBatch]:
        if len(token):
            order = np.lexsort((node, token))
            token, node, size, hot = token[order], node[order], size[order].astype(np.int64), hot[order].astype(np.int64)
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
            token, node, size, hot = token[new], node[new], size[new], hot[new]
            first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            last = np.concatenate([first[1:], [len(token)]]).astype(np.int64)
            end = np.repeat(last, last - first)
            left, right, gap, at = [], [], 1, np.arange(len(token))
            live = at[at + 1 < end]
            while len(live):  # the pairs of each posting that are gap places apart
                a, b = size[live], size[live + gap]
                ok = 100 * np.minimum(a, b) >= percent * np.maximum(a, b)
                left.append(live[ok])
                right.append(live[ok] + gap)
                gap += 1
                live = live[live + gap < end[live]]
                if sum(map(len, left)) >= PAIRED:
                    yield tally(node, size, hot, np.concatenate(left), np.concatenate(right))
                    left, right = [], []
            if left:
                yield tally(node, size, hot, np.concatenate(left), np.concatenate(right))

    def tally(node, size, hot, i, j) -> pa.RecordBatch:
        a, b = node[i], node[j]  # ascending within a token
        order = np.lexsort((b, a))
        i, j, a, b = i[order], j[order], a[order], b[order]
        first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
        shared = np.diff(np.concatenate([first, [len(a)]]))
        i, j = i[first], j[first]
        na, nb = size[i], size[j]
        # Of two prefixes, all tokens of the one that ends first are known; after it at most its rest can follow.
        rest = np.maximum(na - prefix_size(na, percent), nb - prefix_size(nb, percent))
        # One less, as two tokens of a node may have met in the 32 bits of a posting.
        least = np.maximum(1, need(na, nb, percent) - rest - np.minimum(hot[i], hot[j]) - 1)
        return pa.RecordBatch.from_arrays([pa.array(a[first]), pa.array(b[first]), pa.array(shared.astype(np.int32)), pa.array(least.astype(np.int32))], names=["a", "b", "shared", "least"])

    found = dealt(prefixes.where("bucket >= 0").select("bucket", "blob"), F.col("bucket"), buckets).mapInArrow(run, "a long, b long, shared int, least int")
    return found.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.max("least").alias("least")).where("shared >= least").select("a", "b")


def _node_sets(docs: DataFrame, wanted, seed: int) -> DataFrame:
    """node and tokens of the nodes in the filter (and of a few others), once per task that reads them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, known = wanted.value, set()
        for batch in batches:
            for _, texts in slices(batch.column(0)):
                keys, cuts = Batch(texts, fold=True).shingles(SIZE)
                nodes = set_keys(keys, cuts, seed)
                hit = np.flatnonzero(inside(bits, nodes) & (np.diff(cuts) > 0))
                if len(known) > 200_000:
                    known.clear()
                hit = [i for i in hit.tolist() if nodes[i] not in known and not known.add(nodes[i])]
                if hit:
                    lists = [keys[cuts[i] : cuts[i + 1]].view(np.int64) for i in hit]
                    ends = np.cumsum([0, *map(len, lists)])
                    yield pa.RecordBatch.from_arrays([pa.array(nodes[hit]), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(lists)))], names=["node", "tokens"])

    return docs.select("text").mapInArrow(run, "node long, tokens array<long>").dropDuplicates(["node"])


def families(reach: DataFrame) -> DataFrame:
    """node, n and family of the nodes that reach frequent tokens: tokens met in one prefix are of one family."""
    once = reach.groupBy("node").agg(F.max("n").alias("n"), F.first("hot").alias("hot"))
    once = staged(once, "reach")
    edges = once.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("hot") - 1, F.lit(1))), lambda i: F.struct(F.get("hot", i - 1).alias("a"), F.coalesce(F.get("hot", i), F.get("hot", i - 1)).alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
    labels = components(edges)
    firsts = once.select("node", "n", F.get("hot", 0).alias("token"))
    joined = firsts.join(labels.withColumnRenamed("node", "token"), "token", "left")
    return joined.select("node", "n", F.coalesce("label", "token").alias("family"))


def group_links(tokens: list[np.ndarray], nodes: np.ndarray, side: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links that connect whatever the members of two groups (side 0 and 1; one group: all 0) connect directly.

    Queries are the members of side 0, groups sides 1 and 0 (if there is no side 1). The overlap with a
    group's union bounds that with its members, so most queries open nothing; an open group's members
    are counted together, and of those connected already none is looked at again.
    """
    size = np.array([len(t) for t in tokens])
    every, code = np.unique(np.concatenate(tokens), return_inverse=True)
    cut = np.concatenate([[0], np.cumsum(size)])
    parent = list(range(len(nodes)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    same = not side.any()
    member = np.flatnonzero(side == (0 if same else 1))
    if not len(member) or not (side == 0).any():
        return []
    union = np.zeros(len(every), bool)
    flat = np.concatenate([np.arange(cut[m], cut[m + 1]) for m in member])
    union[code[flat]] = True
    starts = np.concatenate([[0], np.cumsum(size[member])])[:-1]
    codes, least = code[flat], size[member].min()
    mark, links = np.zeros(len(every), bool), []
    for q in np.flatnonzero(side == 0):
        mine = code[cut[q] : cut[q + 1]]
        bound = int(union[mine].sum())
        if bound < need(size[q], max(least, -(-percent * size[q] // 100)), percent):
            continue
        mark[mine] = True
        overlap = np.add.reduceat(mark[codes], starts, dtype=np.int64)
        mark[mine] = False
        for m in member[overlap >= need(size[q], size[member], percent)]:
            if m != q and (a := root(int(q))) != (b := root(int(m))):
                parent[a] = b
                links.append((int(nodes[q]), int(nodes[m])))
    return links


def leaders_of(tokens: list[np.ndarray], percent: int = PERCENT, most: int = LEADERS) -> list[int]:
    """Places of the sets that others link to most: the best of all, then the best of those it leaves, and so on."""
    size = np.array([len(t) for t in tokens])
    every, code = np.unique(np.concatenate(tokens), return_inverse=True)
    cut, mark = np.concatenate([[0], np.cumsum(size)]), np.zeros(len(every), bool)
    near = np.zeros((len(tokens), len(tokens)), bool)
    for q in range(len(tokens)):
        mine = code[cut[q] : cut[q + 1]]
        mark[mine] = True
        near[q] = np.add.reduceat(mark[code], cut[:-1], dtype=np.int64) >= need(size[q], size, percent)
        mark[mine] = False
    left, out = np.ones(len(tokens), bool), []
    while left.any() and len(out) < most:
        best = int(np.argmax(near[:, left].sum(axis=1)))
        out.append(best)
        left &= ~near[best]
        left[best] = False
    return out


def _leader_links(placed: DataFrame, large: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between the nodes of large families and their leaders, of which there are a few in each.

    Which nodes become leaders only decides how much is left to compare, never what is found.
    """
    nodes = placed.join(large, "family", "left_semi").select("family", "node")
    nth = F.row_number().over(Window.partitionBy("family").orderBy(F.xxhash64("node"), "node"))
    some = nodes.withColumn("nth", nth).where(F.col("nth") <= CHOICE).join(sets, "node")

    def choose(pdf):
        pdf = pdf.sort_values("nth").reset_index(drop=True)
        return pdf.loc[leaders_of([np.asarray(t, np.int64) for t in pdf["tokens"]], percent), ["family", "node", "tokens"]]

    leaders = staged(some.groupBy("family").applyInPandas(choose, "family long, node long, tokens array<long>"), "leaders")
    both = nodes.join(sets, "node").join(leaders.select("family", F.col("node").alias("a"), F.col("tokens").alias("x")), "family").where("a <> node")
    shared = F.size(F.array_intersect("x", "tokens"))
    return both.where(100 * shared >= percent * (F.size("x") + F.size("tokens") - shared)).select("a", F.col("node").alias("b"))


def _main_labels(placed: DataFrame, large: DataFrame, labels: DataFrame) -> DataFrame:
    """The nodes of each large family's largest class so far: they are connected, and not compared with one another."""
    known = placed.join(large, "family", "left_semi").select("family", "node").join(labels, "node")
    counts = known.groupBy("family", "label").agg(F.count("*").alias("n"))
    main = staged(counts.groupBy("family").agg(F.max(F.struct("n", "label"))["label"].alias("main")), "main")
    return known.join(main, "family").where("label = main").select("node")


def _family_links(placed: DataFrame, connected: DataFrame | None, sets: DataFrame, percent: int) -> DataFrame:
    """Links among the nodes of each family, by pairs of groups of at most about GROUP_NODES nodes.

    connected: nodes of which all in one family are connected; a group holds only such nodes or only
    others, and two groups of such nodes are not compared.
    """
    flag = F.lit(False) if connected is None else F.col("flag").isNotNull()
    if connected is not None:
        placed = placed.join(connected.withColumn("flag", F.lit(True)), "node", "left")
    placed = placed.withColumn("inner", flag)
    sizes = placed.groupBy("family", "level", "inner").agg(F.ceil(F.count("*") / GROUP_NODES).cast("int").alias("groups"), F.count("*").alias("nodes"))
    sizes = sizes.join(sizes.groupBy("family").agg(F.sum("nodes").alias("all")).where("all > 1"), "family", "left_semi")
    told = sizes.select("family", "inner", "groups", F.explode(F.array(*(F.struct((F.col("level") + by).alias("level"), F.lit(kind).alias("kind")) for by, kind in ((0, "same"), (1, "below"), (-1, "above"))))).alias("to")).select("family", "inner", "groups", "to.*")
    count = lambda kind, inner: F.coalesce(F.max(F.when((F.col("kind") == kind) & (F.col("inner") == inner), F.col("groups"))), F.lit(0)).alias(f"{kind}_{'in' if inner else 'out'}")
    near = staged(told.groupBy("family", "level").agg(*(count(k, i) for k in ("same", "below", "above") for i in (False, True))), "near")
    groups = F.greatest(F.when(F.col("inner"), F.col("same_in")).otherwise(F.col("same_out")), F.lit(1))
    own = placed.join(near, ["family", "level"]).withColumn("g", F.pmod(F.xxhash64("node"), groups).cast("int"))
    upto = lambda name: F.when(F.col(name) > 0, F.sequence(F.lit(0), F.col(name) - 1)).otherwise(F.array().cast("array<int>"))
    g, lv = F.col("g"), F.col("level")

    def keys(name: str, low, pair: int, first: bool):
        """This node's group with each of those: pair says which of the two are inner, first whether this node is of the first."""
        return F.transform(upto(name), lambda k: F.struct(low.alias("low"), F.lit(pair).alias("pair"), (g if first else k).cast("int").alias("i"), (k if first else g).cast("int").alias("j"), F.lit(0 if first else 1).alias("side")))

    within = F.transform(upto("same_out"), lambda k: F.struct((lv * 2).alias("low"), F.lit(0).alias("pair"), F.least(k, g).alias("i"), F.greatest(k, g).alias("j"), F.when(k < g, F.lit(1)).otherwise(F.lit(0)).alias("side")))
    outer = F.concat(within, keys("same_in", lv * 2, 1, True), keys("above_out", lv * 2 + 1, 0, True), keys("above_in", lv * 2 + 1, 1, True), keys("below_out", lv * 2 - 1, 0, False), keys("below_in", lv * 2 - 1, 2, False))
    inner = F.concat(keys("same_out", lv * 2, 1, False), keys("above_out", lv * 2 + 1, 2, True), keys("below_out", lv * 2 - 1, 1, False))
    keyed = own.select("node", "family", F.explode(F.when(F.col("inner"), inner).otherwise(outer)).alias("k")).select("node", "family", "k.*")
    rows = keyed.join(sets, "node").select("family", "low", "pair", "i", "j", "side", "node", "tokens")

    def open_groups(pdf):
        import pandas as pd

        links = group_links([np.asarray(t, np.int64) for t in pdf["tokens"]], pdf["node"].to_numpy(np.int64), pdf["side"].to_numpy(np.int64), percent)
        return pd.DataFrame(links, columns=["a", "b"], dtype=np.int64)

    return rows.groupBy("family", "low", "pair", "i", "j").applyInPandas(open_groups, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node and label (the smallest node reachable) of every node in edges (a, b), by alternating stars.

    Every round hangs each node's neighbours on its smallest, from above and from below, until nothing
    moves; a round is two aggregations and joins whatever the components' shapes. The smallest neighbours
    are written before they are joined, so that Spark can split a hub's many edges over tasks.
    """
    spark = edges.sparkSession

    def written(df: DataFrame, name: str) -> tuple[DataFrame, tuple]:
        seen = Observation()
        out = staged(df.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")), name, outside=True)
        return out, (seen.get["n"], seen.get["x"])

    now, was = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while was[0]:
        with scope(spark):
            both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = staged(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
            large = staged(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
            low = staged(large.groupBy("u").agg(F.min("v").alias("m")), "low")
            hung = F.when(F.col("v") == F.col("m"), F.array(F.struct("u", "v"))).otherwise(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
            new, is_ = written(large.join(low, "u").select(F.explode(hung).alias("e")).select("e.*").where("u <> v").distinct(), "edges")
        drop_staged(now)
        now, was, last = new, is_, was
        if was == last:
            break
    pairs = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return pairs.unionByName(pairs.select(F.col("label").alias("node"), "label").distinct())


def link_documents(docs: DataFrame, percent: int = PERCENT, frequent: int = FREQUENT, seed: int = 0) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of every document.

    Documents without words, or with null text, have no shingles and link with nothing. Null doc_ids and
    repeated rows get a row each; a component without any doc_id has a null id. An empty table gives no
    rows; columns besides doc_id and text are not read.
    """
    with scope(docs.sparkSession):
        return _linked(docs, percent, min(frequent, 254), seed)


def _linked(docs: DataFrame, percent: int, frequent: int, seed: int) -> DataFrame:
    spark = docs.sparkSession
    plain = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    sums = plain.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("chars")).first()
    buckets, slots = buckets_for(sums["n"]), slots_for(sums["chars"] or 0)
    counters = min(MOST_BUCKETS, max(8, slots // BUCKET_SLOTS))
    first = staged(_sets(plain, slots, counters, frequent, seed), "sets")
    rows = staged(first.where("bucket is null").select("doc_id", "n", "node", "second"), "nodes")
    often = filter_of(staged(_frequent(first.where("bucket is not null"), slots, counters, frequent), "frequent"))
    drop_staged(first)
    classes = rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("second").alias("low"), F.max("second").alias("high"))
    classes = staged(classes, "classes")
    if not classes.where("low <> high").isEmpty():  # two sets have one key: another seed tells them apart
        return _linked(docs, percent, frequent, seed + 1)
    prefixes = staged(_prefixes(plain, spark.sparkContext.broadcast(often.packed()), slots, buckets, percent, seed), "prefixes")
    pairs = staged(_pairs(prefixes, buckets, percent), "pairs")
    members = families(prefixes.where("bucket = -1").select("node", "n", "hot"))
    level = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent)) + 1e-9).cast("int")
    placed = staged(members.withColumn("level", level), "families")
    drop_staged(prefixes)
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(placed.select("node")).distinct()
    bits = spark.sparkContext.broadcast(filter_of(staged(wanted, "wanted")).packed())
    sets = staged(_node_sets(plain, bits, seed), "node-sets")
    left = sets.select(F.col("node").alias("a"), F.col("tokens").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("tokens").alias("y"))
    both = pairs.join(left, "a").join(right, "b").withColumn("shared", F.size(F.array_intersect("x", "y")))
    links = staged(both.where(100 * F.col("shared") >= percent * (F.size("x") + F.size("y") - F.col("shared"))).select("a", "b"), "links")
    large = staged(placed.groupBy("family").count().where(F.col("count") > GROUP_NODES).select("family"), "large-families")
    connected = None
    if not large.isEmpty():
        labels = components(links.unionByName(_leader_links(placed, large, sets, percent)))
        links = staged(labels.where("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b")), "connected")
        connected = staged(_main_labels(placed, large, labels), "main-nodes")
    labels = components(links.unionByName(_family_links(placed, connected, sets, percent)))
    heads = classes.join(labels, "node", "left").select("node", "doc_id", F.coalesce("label", "node").alias("label"))
    heads = staged(heads, "heads")
    ids = staged(heads.groupBy("label").agg(F.min("doc_id").alias("component_id")), "component-ids")
    owner = staged(heads.join(ids, "label").select("node", "component_id"), "owners")
    out = rows.join(owner, "node", "left")
    return staged(out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")), "linked", outside=True)


def keep_one(docs: DataFrame, percent: int = PERCENT, frequent: int = FREQUENT) -> DataFrame:
    """One row of each component, all columns: one with the smallest doc_id, null ids last.

    Documents without words stay, as they link with nothing; of those with equal doc_ids and texts, one
    stays. Where doc_ids repeat, rows are linked by a key of their own that follows the order of doc_ids.

    The documents that go are few; a filter of their ids lets the others pass where they are read, and
    only those that may be among them are compared by id.
    """
    columns, spark = docs.columns, docs.sparkSession
    whole = F.struct(*(docs[c] for c in columns)).alias("row")  # so that no name clashes
    held = docs.select(docs["doc_id"].cast("long").alias("id"), docs["text"].cast("string").alias("text"), whole)
    key = F.col("id")
    if has_repeated_ids(held.select("id")):
        placed = held.withColumn("at", F.monotonically_increasing_id()).orderBy(F.col("id").asc_nulls_last(), F.xxhash64("text"), "at")
        held = staged(placed.withColumn("key", F.monotonically_increasing_id()).drop("at"), "keyed")
        key = F.col("key")
        linked = link_documents(held.select(F.col("key").alias("doc_id"), "text"), percent, frequent)
        # Of equal rows without words the first stays.
        empty = held.join(linked.where("n_shingles = 0").select(F.col("doc_id").alias("key")), "key").groupBy("id", "text").agg(F.min("key").alias("first"))
        later = held.join(linked.where("n_shingles = 0").select(F.col("doc_id").alias("key")), "key").select("key")
        again = later.join(empty.select(F.col("first").alias("key")), "key", "left_anti").select(F.col("key").alias("gone"))
    else:
        linked, again = link_documents(docs.select("doc_id", "text"), percent, frequent), None
    gone = linked.where((F.col("n_shingles") > 0) & ~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("gone"))
    with scope(spark):
        gone = staged(gone if again is None else gone.unionByName(again), "gone", outside=True)
        marks = filter_of(gone.select(F.xxhash64("gone").alias("at")), outside=True)
    drop_staged(linked)
    marked = marks.marked(held, F.xxhash64(key), "maybe")
    stays = marked.where("not maybe").select("row")
    asked = marked.where("maybe").join(gone, key.eqNullSafe(F.col("gone")), "left_anti").select("row")
    return stays.unionAll(asked).select(*(F.col("row")[c].alias(c) for c in columns))


def has_repeated_ids(ids: DataFrame) -> bool:
    """Whether a value of its one column, null included, is found twice."""
    return not ids.groupBy(*ids.columns).count().where("count > 1").isEmpty()
