"""Removal of long strings that occur earlier, through run-length compressed indexes.

Every string of LENGTH bytes has an anchor: the least-hashed GRAM-byte string in it. Equal strings have
equal anchors, so stretches of text, each the strings of one anchor occurrence, are dealt out by anchor.
Copies are pre-aggregated: of stretches of equal content all but the first are removed, where they are
read as far as possible, so no group of copies gathers anywhere. The different stretches of an anchor go
to an index: the earlier half of them is indexed by a run-compressed Burrows-Wheeler transform, the later
half is streamed over it for matching statistics, every string matched over its whole length is marked,
and each half, without what is marked at its edges, is treated likewise.

An index is built in one task, so an anchor's stretches must fit one. Those of an anchor with more than
BUSY of them (the edge of a passage that thousands of documents share), or with too many of them already
where they are read, are dealt out string by string instead, and their copies are pre-aggregated again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import buckets_for, dealt, grouped
from .common import drop_staged, scope, staged
from .filters import filter_of
from .hashing import Prefix, mix64, raw_of, slices
from .run_index import RunIndex

LENGTH, GRAM = 100, 32
#: Different stretches of an anchor that one index takes, and that one reading task hands on at least.
BUSY, LEAST_BUSY = 4096, 8
#: Stretches that a task compares before it hands them on; bytes read at once; bytes of text for a stretch, about.
HELD, SLICE_BYTES, STRETCH_BYTES = 500_000, 1_500_000, 30
#: Bytes of stretches that one index is built from, at most (but for one anchor's).
INDEX_BYTES = 2_000_000
_NO_ID = -(1 << 63)


def stretches(raw: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """anchor hash, content hash, document, first string's start and number of strings of every stretch, in order."""
    empty = tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    if len(raw) < length:
        return empty
    prefix = Prefix(raw)
    grams = mix64(prefix.windows(gram))
    width, span = length - gram + 1, 1
    bits = np.uint64(max(1, int(len(raw)).bit_length()))
    low = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)  # leftmost of equals
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if width > span:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    anchor = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    size = np.diff(offsets)
    owner = np.repeat(np.arange(len(size)), np.maximum(0, size - length + 1))
    if not len(owner):
        return empty
    counts = np.bincount(owner, minlength=len(size))
    start = np.arange(len(owner)) - (np.cumsum(counts) - counts)[owner] + offsets[:-1][owner]
    anchor = anchor[start]
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.concatenate([first, [len(start)]]))
    begin, doc = start[first], owner[first]
    return grams[anchor[first]], prefix.of(begin, begin + n + length - 1), doc, begin - offsets[:-1][doc], n


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of intervals of each document; touching ones become one."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    shift = doc * (int(end.max()) + 2)
    reach = np.maximum.accumulate(end + shift)
    new = np.ones(len(doc), bool)
    new[1:] = (start + shift)[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(doc)]]) - 1
    return doc[first], start[first], reach[last] - shift[last]


class Entries:
    """Stretches with where they are, as arrays: anchor, content, id, tie, start, n."""

    KINDS = ("<u8", "<u8", "<i8", "<i8", "<i8", "<i4")

    @classmethod
    def pack(cls, columns) -> bytes:
        return np.array([len(columns[0])], "<i8").tobytes() + b"".join(c.astype(k).tobytes() for c, k in zip(columns, cls.KINDS, strict=True))

    @classmethod
    def unpack(cls, blob: bytes) -> list[np.ndarray]:
        n, at, out = int(np.frombuffer(blob, "<i8", 1)[0]), 8, []
        for kind in cls.KINDS:
            out.append(np.frombuffer(blob, kind, n, at))
            at += out[-1].nbytes
        return out


_FOUND = "bucket int, blob binary, id long, tie long, start long, end long, kind int, anchor long"
_NAMES = [x.split()[0] for x in _FOUND.split(", ")]
#: Kinds of rows: removed bytes, stretches wanted for an index, stretches of a busy anchor.
REMOVED, WANTED, SPLIT = 0, 1, 2


def _rows(id_, tie, start, end, kind: int, anchor=None) -> pa.RecordBatch:
    n = len(id_)
    anchors = pa.nulls(n, pa.int64()) if anchor is None else pa.array(anchor.view(np.int64))
    columns = [pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), *(pa.array(np.asarray(x, np.int64)) for x in (id_, tie, start, end)), pa.array(np.full(n, kind, np.int32)), anchors]
    return pa.RecordBatch.from_arrays(columns, names=_NAMES)


def _blobs(buckets: np.ndarray, blobs: list[bytes]) -> pa.RecordBatch:
    n = len(blobs)
    columns = [pa.array(buckets.astype(np.int32)), pa.array(blobs, pa.binary()), *(pa.nulls(n, pa.int64()) for _ in range(4)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=_NAMES)


def _firsts(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The order by anchor, content and place, and which of that order are the first of their content."""
    anchor, content, id_, tie, start = columns[:5]
    order = np.lexsort((start, tie, id_, content, anchor))
    a, c = anchor[order], content[order]
    first = np.ones(len(order), bool)
    first[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
    return order, first


def _removed(columns: list[np.ndarray], length: int) -> pa.RecordBatch:
    _, _, id_, tie, start, n = columns
    pairs = np.stack([id_, tie], axis=1)
    known, doc = np.unique(pairs, axis=0, return_inverse=True)
    doc, begin, end = merged(doc.reshape(-1).astype(np.int64), start.astype(np.int64), start + n + length - 1)
    return _rows(known[doc, 0], known[doc, 1], begin, end, REMOVED)


def _packed(columns: list[np.ndarray], bucket: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """The entries of each bucket that has some."""
    order = np.argsort(bucket, kind="stable")
    some, first = np.unique(bucket[order], return_index=True)
    columns = [c[order] for c in columns]
    return some, [Entries.pack([c[a:b] for c in columns]) for a, b in zip(first.tolist(), [*first[1:].tolist(), len(order)], strict=True)]


def _read(docs: DataFrame, buckets: int, length: int, most: int) -> DataFrame:
    """Stretches per bucket of anchors, one per content and task, and the removed bytes of the others.

    An anchor with more than most of them is marked in its bucket by an entry of no strings, and its
    stretches go to buckets of contents, which are the negative ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0

        def hand_on() -> Iterator[pa.RecordBatch]:
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            order, first = _firsts(columns)
            if not first.all():
                yield _removed([c[order[~first]] for c in columns], length)
            columns = [c[order[first]] for c in columns]
            head = np.flatnonzero(np.concatenate([[True], columns[0][1:] != columns[0][:-1]]))
            each = np.diff(np.concatenate([head, [len(columns[0])]]))
            hot = np.repeat(each > most, each)
            if hot.any():
                spread = mix64(columns[0] ^ mix64(columns[1]))[hot] % np.uint64(buckets)
                yield _blobs(*_packed([c[hot] for c in columns], -1 - spread.astype(np.int64)))
                keep = ~hot
                keep[head[each > most]] = True
                columns[5] = np.where(hot, 0, columns[5])
                columns = [c[keep] for c in columns]
            yield _blobs(*_packed(columns, ((columns[0] >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)))

        for batch in batches:
            ids, ties = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for at, texts in slices(batch.column(2), SLICE_BYTES):
                anchor, content, doc, start, n = stretches(*raw_of(texts), length)
                held.append((anchor, content, ids[at + doc], ties[at + doc], start, n))
                total += len(anchor)
                if total >= HELD:
                    yield from hand_on()
                    held, total = [], 0
        if total:
            yield from hand_on()

    return docs.mapInArrow(run, _FOUND)


def _meet(blobs: DataFrame, buckets: int, length: int, busy: int) -> DataFrame:
    """What can be told of each anchor's stretches by their contents, and which of them need an index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, parts in grouped(batches):
            columns = [np.concatenate(x) for x in zip(*map(Entries.unpack, parts), strict=True)]
            marked = np.unique(columns[0][columns[5] == 0])
            if len(marked):
                columns = [c[columns[5] > 0] for c in columns]
            if not len(columns[0]):
                continue
            order, first = _firsts(columns)
            columns = [c[order] for c in columns]
            if not first.all():
                yield _removed([c[~first] for c in columns], length)
            anchor, _, id_, tie, start, n = (c[first] for c in columns)
            head = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
            each = np.diff(np.concatenate([head, [len(anchor)]]))
            count = np.repeat(each, each)
            split = (count > busy) | np.isin(anchor, marked) if bucket >= 0 else np.ones(len(anchor), bool)
            for kind, some in ((WANTED, (count > 1) & ~split), (SPLIT, split)):
                if some.any():
                    yield _rows(id_[some], tie[some], start[some], start[some] + n[some] + length - 1, kind, anchor[some])

    at = F.when(F.col("bucket") < 0, -1 - F.col("bucket")).otherwise(F.col("bucket"))
    return dealt(blobs, at, buckets).mapInArrow(run, _FOUND).drop("bucket", "blob")


def _cut_out(both: DataFrame, buckets: int, length: int) -> DataFrame:
    """From documents and their wanted stretches: bytes of stretches per bucket, and the strings of busy anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "blob", "id", "tie", "start", "end"]

        def hand_on(held: list[tuple]) -> pa.RecordBatch:
            by: dict[int, list[tuple]] = {}
            for x in held:
                by.setdefault((x[0] >> 20) % buckets, []).append(x)
            blobs = []
            for rows in by.values():
                head = np.array([(x[1], x[2], x[3], len(x[4])) for x in rows], "<i8")
                anchors = np.array([x[0] for x in rows], "<u8")
                blobs.append(np.array([len(rows)], "<i8").tobytes() + anchors.tobytes() + head.tobytes() + b"".join(x[4] for x in rows))
            n = len(blobs)
            return pa.RecordBatch.from_arrays([pa.array(list(by), pa.int32()), pa.array(blobs, pa.binary()), *(pa.nulls(n, pa.int64()) for _ in range(4))], names=names)

        def strings(split: list[tuple]) -> Iterator[pa.RecordBatch]:
            a, b, id_, tie, start = (np.concatenate(x) for x in zip(*split, strict=True))
            columns = [a, b, id_, tie, start, np.ones(len(a), np.int64)]
            order, first = _firsts(columns)
            if not first.all():
                gone = _removed([c[order[~first]] for c in columns], length)
                n = gone.num_rows
                yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), *(gone.column(i) for i in (2, 3, 4, 5))], names=names)
            columns = [c[order[first]] for c in columns]
            some, blobs = _packed(columns, (columns[0] % np.uint64(buckets)).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array((-1 - some).astype(np.int32)), pa.array(blobs, pa.binary()), *(pa.nulls(len(some), pa.int64()) for _ in range(4))], names=names)

        held, size, split, n_split = [], 0, [], 0
        for batch in batches:
            for id_, tie, text, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = np.frombuffer(text, np.uint8)
                prefix = Prefix(raw) if any(w["kind"] == SPLIT for w in wanted) else None
                for w in wanted:
                    begin, end = w["start"], w["end"]
                    if w["kind"] == WANTED:
                        held.append((w["anchor"] % (1 << 64), id_, tie, begin, text[begin:end]))
                        size += end - begin
                    else:
                        at = np.arange(begin, end - length + 1)
                        other = mix64(prefix.of(at, at + length // 2) ^ mix64(prefix.of(at + length // 2, at + length)))
                        split.append((prefix.of(at, at + length), other, np.full(len(at), id_), np.full(len(at), tie), at))
                        n_split += len(at)
                if size >= 8_000_000:
                    yield hand_on(held)
                    held, size = [], 0
                if n_split >= HELD:
                    yield from strings(split)
                    split, n_split = [], 0
        if held:
            yield hand_on(held)
        if split:
            yield from strings(split)

    return both.mapInArrow(run, "bucket int, blob binary, id long, tie long, start long, end long")


def _later_strings(blobs: DataFrame, buckets: int, length: int) -> DataFrame:
    """Of the strings of busy anchors, all but the first of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in grouped(batches):
            columns = [np.concatenate(x) for x in zip(*map(Entries.unpack, parts), strict=True)]
            order, first = _firsts(columns)
            if not first.all():
                yield _removed([c[order[~first]] for c in columns], length)

    return dealt(blobs, -1 - F.col("bucket"), buckets).mapInArrow(run, _FOUND).select("id", "tie", "start", "end")


def likely(groups: list[np.ndarray], head: np.ndarray, texts: list[np.ndarray], length: int) -> list[np.ndarray]:
    """The groups without what can match nothing: strings whose hash no other string of their group has.

    Stretches are cut down, in head and texts, to what lies between their first and last other string, or
    left out. The hash only prunes; what matches is for the index to say.
    """
    every = np.concatenate(groups)
    size = head[every, 3]
    begin = np.cumsum(size) - size
    flat = np.concatenate([texts[i] for i in every])
    at = np.arange(len(flat)) - np.repeat(begin, size)
    fits = np.flatnonzero(at <= np.repeat(size, size) - length)
    group = np.repeat(np.repeat(np.arange(len(groups)), [len(g) for g in groups]), size)[fits].astype(np.uint64)
    with np.errstate(over="ignore"):
        hashes = mix64(Prefix(flat).windows(length)[fits] + group * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(hashes)
    same = hashes[order][1:] == hashes[order][:-1]
    twice = np.zeros(len(fits), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    mark = np.zeros(len(flat), bool)
    mark[fits[twice]] = True
    first = np.minimum.reduceat(np.where(mark, at, len(flat)), begin)
    last = np.maximum.reduceat(np.where(mark, at, -1), begin)
    keep = np.zeros(len(head), bool)
    for i, a, b in zip(every.tolist(), first.tolist(), (last + length).tolist(), strict=True):
        if b >= length:
            keep[i] = True
            texts[i] = texts[i][a:b]
            head[i, 2] += a
            head[i, 3] = b - a
    return [g[keep[g]] for g in groups]


def _index(blobs: DataFrame, buckets: int, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in grouped(batches):
            anchors, heads, texts = [], [], []
            for blob in parts:
                n = int(np.frombuffer(blob, "<i8", 1)[0])
                anchors.append(np.frombuffer(blob, "<u8", n, 8))
                head = np.frombuffer(blob, "<i8", 4 * n, 8 + 8 * n).reshape(n, 4)
                heads.append(head)
                raw, at = np.frombuffer(blob, np.uint8, -1, 8 + 40 * n), 0
                for size in head[:, 3].tolist():
                    texts.append(raw[at : at + size])
                    at += size
            anchor, head = np.concatenate(anchors), np.concatenate(heads)
            order = np.lexsort((head[:, 2], head[:, 1], head[:, 0], anchor))
            cuts = np.concatenate([[0], np.flatnonzero(anchor[order][1:] != anchor[order][:-1]) + 1, [len(order)]]).tolist()
            groups, size = [], 0
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                groups.append(order[a:b])
                size += int(head[order[a:b], 3].sum())
                if size >= INDEX_BYTES:
                    yield from mark(groups, head, texts)
                    groups, size = [], 0
            if groups:
                yield from mark(groups, head, texts)

    def mark(groups: list[np.ndarray], head: np.ndarray, texts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """Each group's later half is streamed over an index of its earlier half; then both halves are groups.

        What is found needs no comparison any more, for what equals it is found in the earlier half as
        well: later halves go on without their found ends.

        A group has a class, and its halves have classes of their own: strings of different classes never
        match, so what comes after a query cannot answer it, and one index does for all groups of a round.
        """
        now = [(g, 0) for g in likely(groups, head, texts, length)]
        while now := [(g, c) for g, c in now if len(g) > 1]:
            early = np.concatenate([g[: len(g) // 2] for g, _ in now])
            late = np.concatenate([g[len(g) // 2 :] for g, _ in now])
            index = RunIndex([texts[i] for i in early], np.repeat([c for _, c in now], [len(g) // 2 for g, _ in now]))
            hit = index.matches([texts[i] for i in late], length, np.repeat([c for _, c in now], [len(g) - len(g) // 2 for g, _ in now]))
            size = head[late, 3]
            who = np.repeat(late, size)[hit]
            place = (np.arange(len(hit)) - np.repeat(np.cumsum(size) - size, size))[hit]
            if len(who):
                which, start, end = merged(who, place, place + length)
                yield _rows(head[which, 0], head[which, 1], start + head[which, 2], end + head[which, 2], REMOVED)
            begin = np.concatenate([[0], np.cumsum(size)[:-1]])
            at = np.arange(len(hit)) - np.repeat(begin, size)
            left = ~hit & (at <= np.repeat(size, size) - length)
            first = np.minimum.reduceat(np.where(left, at, len(at)), begin)
            last = np.maximum.reduceat(np.where(left, at, -1), begin)
            for i, a, b in zip(late[last >= 0].tolist(), first[last >= 0].tolist(), (last[last >= 0] + length).tolist(), strict=True):
                texts[i] = texts[i][a:b]
                head[i, 2] += a
                head[i, 3] = b - a
            known = np.zeros(len(head), bool)
            known[late[last < 0]] = True
            now = [h for g, c in now for h in ((g[: len(g) // 2], 2 * c), (g[len(g) // 2 :][~known[g[len(g) // 2 :]]], 2 * c + 1))]

    return dealt(blobs, F.col("bucket"), buckets).mapInArrow(run, _FOUND).select("id", "tie", "start", "end")


def dedup_substrings(docs: DataFrame, length: int = LENGTH, busy: int = BUSY) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes left) of every document.

    A byte is removed if a string of that length covers it that also starts earlier: in a smaller doc_id,
    or earlier in the same document. Null doc_ids come first; documents with equal doc_ids come in the
    order of a hash of their texts, and of repeated rows all but one count as later. Null text is empty;
    texts shorter than the length lose nothing; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("id"), F.xxhash64(text).alias("tie"), text.cast("binary").alias("text"))
    with scope(docs.sparkSession):
        twice = staged(keyed.groupBy("id", "tie").count().where("count > 1").select("id", "tie"), "repeated-rows", outside=True)
        repeated = not twice.isEmpty()
        plain = keyed.select("id", "tie", "text")
        if repeated:
            plain = plain.join(twice, ["id", "tie"], "left_anti").unionAll(plain.join(twice, ["id", "tie"], "left_semi").dropDuplicates(["id", "tie"]))
        spans = _spans(plain, length, busy)
        by_doc = staged(spans.groupBy("id", "tie").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "spans-by-document", outside=True)
        touched = filter_of(by_doc.select(F.xxhash64("id", "tie").alias("at")), outside=True)
    marked = touched.marked(keyed, F.xxhash64("id", "tie"), "touched")
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    hit = marked.where("touched").join(by_doc, ["id", "tie"], "left").select("doc_id", "id", "tie", "text", F.coalesce("spans", none).alias("spans"))
    rest = marked.where("not touched").select("doc_id", "id", "tie", "text", none.alias("spans"))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, id_, tie, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                kept, gone, n = text, 0, 0
                if spans:
                    _, start, end = merged(np.zeros(len(spans), np.int64), np.array([s["start"] for s in spans]), np.array([s["end"] for s in spans]))
                    n, gone = len(start), int((end - start).sum())
                    edges = [0, *np.stack([start, end], axis=1).reshape(-1).tolist(), len(text)]
                    kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                rows.append((doc_id, id_, tie, len(text), gone, n, hashlib.sha256(kept).hexdigest(), kept))
            if rows:
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["doc_id", "id", "tie", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    out = hit.unionAll(rest).mapInArrow(clean, "doc_id long, id long, tie long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    if repeated:
        # Rows that agree in all have one first; a minimum finds it where they are, so they need not gather.
        out = staged(out.withColumn("row", F.monotonically_increasing_id()), "cleaned")
        first = staged(out.join(twice, ["id", "tie"], "left_semi").groupBy("id", "tie").agg(F.min("row").alias("row")).select("row", F.lit(True).alias("first")), "first-rows")
        again = out.join(twice.withColumn("twice", F.lit(True)), ["id", "tie"], "left").join(first, "row", "left")
        gone = F.col("twice").isNotNull() & F.col("first").isNull() & (F.col("n_bytes") >= length)
        out = again.select(
            "doc_id", "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"), F.when(gone, F.lit(1)).otherwise(F.col("n_spans")).cast("long").alias("n_spans"),
            F.when(gone, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"), F.when(gone, F.lit("").cast("binary")).otherwise(F.col("kept")).alias("kept"))
    return out.drop("id", "tie")


def _spans(plain: DataFrame, length: int, busy: int) -> DataFrame:
    """id, tie, start and end of removed bytes, some of them more than once."""
    sums = plain.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("bytes")).first()
    buckets = buckets_for(sums["n"])
    # All that the reading tasks hand on of an anchor is about busy, or LEAST_BUSY times as many as they are.
    turns = -(-(sums["bytes"] or 0) // (HELD * STRETCH_BYTES))
    first = staged(_read(plain, buckets, length, min(busy, max(LEAST_BUSY, busy // max(1, turns)))), "stretches")
    met = staged(_meet(first.where("bucket is not null").select("bucket", "blob"), buckets, length, busy), "met")
    removed = staged(first.where("bucket is null").select("id", "tie", "start", "end"), "removed")
    drop_staged(first)
    asked = met.where(f"kind > {REMOVED}")
    wanted = staged(asked.groupBy("id", "tie").agg(F.collect_list(F.struct("start", "end", "kind", "anchor")).alias("wanted")), "wanted")
    holding = filter_of(wanted.select(F.xxhash64("id", "tie").alias("at")))
    both = holding.marked(plain, F.xxhash64("id", "tie"), "holds").where("holds").join(wanted, ["id", "tie"]).select("id", "tie", "text", "wanted")
    parts = staged(_cut_out(both, buckets, length), "cut-out")
    removed_too = staged(met.where(f"kind = {REMOVED}").select("id", "tie", "start", "end"), "removed")
    drop_staged(met)
    blobs = parts.select("bucket", "blob")
    indexed = _index(blobs.where("bucket >= 0"), buckets, length)
    later = _later_strings(blobs.where("bucket < 0"), buckets, length).unionByName(parts.where("bucket is null").select("id", "tie", "start", "end"))
    return removed.unionByName(removed_too).unionByName(indexed).unionByName(later)
