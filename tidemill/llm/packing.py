"""Packing by vector bin packing.

Every sequence has three limits at once: tokens, segments and loss-bearing tokens. A document's first
sentence or line is its prompt, which bears no loss, if something follows it. Items are placed by
the dot-product heuristic: among the items that fit, the one whose demand vector has the largest dot
product with the open sequence's residual vector goes in. An item may be cut: when nothing fits whole,
the head of an item that fills the sequence goes in and its tail goes back to the pool; where no more
loss fits, that is a part of a prompt. What a block cannot fill is cut into sequences whose lengths are
powers of two, which need no padding.

Blocks of a bounded number of documents are packed where they are read, so there is no shuffle, and no
key, source or group of copies can gather in one task.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import encoder

#: Documents packed together at most, and tokens after which a block is closed.
BLOCK_DOCS, BLOCK_TOKENS = 8192, 4_000_000
#: What a document's prompt is: its first sentence or line, and its end must be followed by something.
PROMPT = r"^(?P<prompt>[^.!?\n]*[.!?\n])[\x20\n]*[^\x20\n]"


@dataclass(frozen=True)
class Limits:
    """loss_tokens: the middle of one document reaches it before its sequence is full; prompts fill the rest."""

    tokens: int = 2048
    segments: int = 128
    loss_tokens: int = 2040


def loss_of(start: int, length: int, prompt: int) -> int:
    """Loss-bearing tokens of a piece: those past the item's prompt, but never a piece's first token."""
    return max(0, start + length - max(start + 1, prompt))


def pack_items(lengths: list[int], prompts: list[int] | None = None, limits: Limits = Limits()) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (item, start, length); together the pieces of an item are all of it, once.

    prompts: leading tokens of each item without loss (default: one, as nothing precedes it). Items of
    length 0 get no piece. Equal items are placed in their order, so equal input gives equal output.
    """
    prompts = prompts or [1] * len(lengths)
    cap = limits.tokens
    done: list[list[tuple[int, int, int]]] = []
    #: Waiting pieces by class (length, loss) and by the tokens of prompt they start with, each a heap by
    #: (item, start); a piece that was taken by the one is passed over in the other.
    pool: dict[tuple[int, int], list[tuple[int, int]]] = {}
    ready: dict[int, list[tuple[int, int]]] = {}
    classes: list[tuple[int, int]] = []  # in order
    frees: list[int] = []
    waits: dict[tuple[int, int], tuple[int, int]] = {}
    count: dict[tuple[int, int], int] = {}

    def put(item: int, start: int, length: int) -> None:
        key, free = (length, loss_of(start, length, prompts[item])), prompts[item] - start
        if not count.get(key):
            insort(classes, key)
        count[key] = count.get(key, 0) + 1
        waits[item, start] = key
        heapq.heappush(pool.setdefault(key, []), (item, start))
        if free > 1:
            if free not in ready:
                ready[free] = []
                insort(frees, free)
            heapq.heappush(ready[free], (item, start))

    def first(heap: list[tuple[int, int]], key: tuple[int, int] | None) -> tuple[int, int] | None:
        while heap and (heap[0] not in waits or key not in (None, waits[heap[0]])):
            heapq.heappop(heap)
        return heap[0] if heap else None

    def taken(piece: tuple[int, int]) -> None:
        key = waits.pop(piece)
        count[key] -= 1
        if not count[key]:
            del classes[bisect_left(classes, key)]

    def with_prompt(want: int) -> tuple[int, int] | None:
        """The piece with the least prompt of so many tokens, or else with the most."""
        at = bisect_left(frees, want)
        while frees:
            at = min(at, len(frees) - 1)
            if (piece := first(ready[frees[at]], None)) is not None and prompts[piece[0]] - piece[1] == frees[at]:
                return piece
            del ready[frees.pop(at)]
        return None

    for item, n in enumerate(lengths):
        start = 0
        # What is longer than a sequence fills some by itself, or all but fills them with its loss.
        while n - start >= (most := min(cap, max(1, prompts[item] - start) + limits.loss_tokens)) > 1:
            if most == cap:
                done.append([(item, start, most)])
            else:
                put(item, start, most)
            start += most
        if n > start:
            put(item, start, n - start)

    while waits:
        rest, slots, loss = cap, limits.segments, limits.loss_tokens
        open_: list[tuple[int, int, int]] = []
        while rest and slots and waits:
            # A demand vector is (length / cap, 1 / segments, loss / loss limit). Its dot product with the
            # residual grows with length, then loss: from the longest that fits, the first whose loss fits.
            scale_t, scale_l = rest / cap**2, loss / limits.loss_tokens**2
            best, best_dot, at = None, -1.0, bisect_right(classes, (rest, cap)) - 1
            while at >= 0:
                length, lost = classes[at]
                if length * scale_t + length * scale_l <= best_dot:
                    break  # loss <= length: no shorter class can win
                if lost <= loss and (dot := length * scale_t + lost * scale_l) > best_dot:
                    best, best_dot = classes[at], dot
                at -= 1
            if best is None:
                # A head that fills the sequence: where little or no loss fits any more, a prompt's.
                piece = with_prompt(rest - loss) if rest - loss > 1 else None
                piece = piece or first(pool[classes[-1]], classes[-1])
                length = waits[piece][0]
                head = (*piece, min(rest, length, max(1, prompts[piece[0]] - piece[1]) + loss))
            else:
                length = best[0]
                head = (*first(pool[best], best), length)
            item, start = head[:2]
            taken((item, start))
            if head[2] < length:
                put(item, start + head[2], length - head[2])
            open_.append(head)
            rest -= head[2]
            slots -= 1
            loss -= loss_of(start, head[2], prompts[item])
        done += powers(open_) if rest else [open_]
    return done


def powers(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """The pieces cut into sequences whose lengths are the powers of two in their sum, largest first."""
    total, out, queue = sum(p[2] for p in pieces), [], list(reversed(pieces))
    for bit in reversed(range(total.bit_length())):
        if not total >> bit & 1:
            continue
        need, row = 1 << bit, []
        while need:
            item, start, length = queue.pop()
            take = min(need, length)
            row.append((item, start, take))
            if take < length:
                queue.append((item, start + take, length - take))
            need -= take
        out.append(row)
    return out


def prompt_texts(texts: pa.Array, pattern: str) -> pa.Array:
    """The prompts of texts, empty where a text has none."""
    return pc.fill_null(pc.struct_field(pc.extract_regex(texts, pattern), "prompt"), "")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, kind: str = "word", limits: Limits = Limits(), prompt: str | None = PROMPT, prompt_column: str | None = None) -> DataFrame:
    """One row per piece of each document's ids followed by end_id; loss_tokens counts those past its prompt.

    prompt: a pattern of what bears no loss, at a text's start, or prompt_column: a column that has that
    part of the text. A document's first id never bears any.

    Null text is empty (its ids: end_id alone); null doc_ids and repeated rows are packed as they are;
    empty tables give no rows; other columns are not read. sequence_id is unique over the result and,
    for the same files, the same in every run and every retry of a task.
    """

    def block(sequence: int, doc_ids: list, ids: np.ndarray, cut: np.ndarray, prompts: list[int]) -> tuple[pa.RecordBatch, int]:
        size = np.diff(cut)
        rows: list[list] = [[] for _ in range(8)]
        raw = memoryview(ids.tobytes())
        for row in pack_items(size.tolist(), prompts, limits):
            offset = 0
            for item, start, length in row:
                at = 4 * (int(cut[item]) + start)
                values = (doc_ids[item], start, length, zlib.crc32(raw[at : at + 4 * length]), int(size[item]), sequence, offset, loss_of(start, length, prompts[item]))
                for column, value in zip(rows, values, strict=True):
                    column.append(value)
                offset += length
            sequence += 1
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"]), sequence

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, kind)
        sequence = TaskContext.get().partitionId() << 40
        doc_ids, parts, sizes, prompts, tokens = [], [], [], [], 0
        for batch in batches:
            for low in range(0, batch.num_rows, 4096):
                some = batch.slice(low, 4096)
                ids, cut = enc.encode(some.column(1))
                ids, cut = np.insert(ids, cut[1:], end_id), cut + np.arange(len(cut))
                doc_ids += some.column(0).to_pylist()
                starts = some.column(2) if prompt_column else prompt_texts(some.column(1), prompt) if prompt else pa.array([""] * some.num_rows)
                free = np.diff(enc.encode(starts)[1])
                prompts += np.maximum(1, free).tolist()
                parts.append(ids)
                sizes.append(np.diff(cut))
                tokens += len(ids)
                if len(doc_ids) >= BLOCK_DOCS or tokens >= BLOCK_TOKENS:
                    out, sequence = block(sequence, doc_ids, np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]), prompts)
                    yield out
                    doc_ids, parts, sizes, prompts, tokens = [], [], [], [], 0
        if doc_ids:
            yield block(sequence, doc_ids, np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]), prompts)[0]

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"
    own = [F.col(prompt_column).cast("string").alias("prompt")] if prompt_column else []
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *own).mapInArrow(pack, schema)


def pack_conversations(turns: DataFrame, tokenizer: str, end_id: int = 1, kind: str = "word", limits: Limits = Limits()) -> DataFrame:
    """pack_documents() of conversations (conv_id, turn, role, text) as examples: their last answer bears loss, what leads to it is the prompt.

    doc_id is the conv_id. A conversation without an answer is all prompt; null texts are empty.
    """
    rows = turns.groupBy(F.col("conv_id").cast("long").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("t"))
    last = F.aggregate("t", F.struct(F.lit(0).alias("i"), F.lit(0).alias("last")), lambda a, x: F.struct((a["i"] + 1).alias("i"), F.when(x["role"] == "assistant", a["i"] + 1).otherwise(a["last"]).alias("last")), lambda a: a["last"])
    rows = rows.withColumn("last", last)
    joined = lambda part: F.array_join(F.transform(part, lambda x: x["text"]), "\n")
    prompt = F.when(F.col("last") > 1, F.concat(joined(F.slice("t", 1, F.col("last") - 1)), F.lit("\n"))).when(F.col("last") == 1, F.lit("")).otherwise(joined(F.col("t")))
    return pack_documents(rows.select("doc_id", joined(F.col("t")).alias("text"), prompt.alias("prompt")), tokenizer, end_id, kind, limits, prompt_column="prompt")
