"""Choices of the packer against a plain one that looks at every waiting item, and limits that bind."""

import random
from collections import defaultdict

import pyarrow as pa

from tidemill.llm import packing


def plain_pack(lengths, prompts, limits):
    """The same heuristic over a plain list: every waiting piece is scored each time."""
    loss_of = lambda i, s, n: packing.loss_of(s, n, prompts[i])
    waiting, done = [], []
    for i, n in enumerate(lengths):
        s = 0
        while n - s >= (most := min(limits.tokens, max(1, prompts[i] - s) + limits.loss_tokens)) > 1:
            if most == limits.tokens:
                done.append([(i, s, most)])
            else:
                waiting.append((i, s, most))
            s += most
        if n > s:
            waiting.append((i, s, n - s))
    while waiting:
        rest, slots, loss, row = limits.tokens, limits.segments, limits.loss_tokens, []
        while rest and slots and waiting:
            key = lambda p: (p[2], loss_of(*p))
            fits = [p for p in waiting if p[2] <= rest and loss_of(*p) <= loss]
            dot = lambda p: p[2] * rest / limits.tokens**2 + loss_of(*p) * loss / limits.loss_tokens**2
            if fits:
                top = max(map(dot, fits))
                best = max(key(p) for p in fits if dot(p) == top)
                p = min(p for p in fits if key(p) == best)
                take = p[2]
            else:
                want = rest - loss
                free = lambda p: prompts[p[0]] - p[1]
                ready = [p for p in waiting if free(p) > 1] if want > 1 else []
                if enough := [p for p in ready if free(p) >= want]:
                    p = min(enough, key=lambda p: (free(p), p))
                elif ready:
                    p = min(ready, key=lambda p: (-free(p), p))
                else:
                    p = min((p for p in waiting if key(p) == max(map(key, waiting))), key=lambda p: p[:2])
                take = min(rest, p[2], max(1, free(p)) + loss)
            waiting.remove(p)
            row.append((p[0], p[1], take))
            if take < p[2]:
                waiting.append((p[0], p[1] + take, p[2] - take))
            rest, slots, loss = rest - take, slots - 1, loss - loss_of(p[0], p[1], take)
        done += packing.powers(row) if rest else [row]
    return done


def test_choices_are_those_of_a_plain_packer():
    r = random.Random(8)
    for _ in range(150):
        lengths = [r.randrange(1, 90) for _ in range(r.randrange(1, 25))]
        prompts = [r.randrange(1, n + 1) for n in lengths]
        limits = packing.Limits(32, r.randrange(2, 7), r.randrange(12, 32))
        assert packing.pack_items(lengths, prompts, limits) == plain_pack(lengths, prompts, limits)


def test_the_loss_limit_binds_in_production():
    """The middle of a document reaches the limit; nothing is padded, and next to all sequences are full."""
    r = random.Random(3)
    lengths = [min(30_000, int(r.lognormvariate(6.5, 1.0)) + 1) for _ in range(2000)]
    prompts = [r.randrange(3, 30) for _ in lengths]
    rows = packing.pack_items(lengths, prompts)
    loss = [sum(packing.loss_of(s, n, prompts[i]) for i, s, n in row) for row in rows]
    total = [sum(n for *_, n in row) for row in rows]
    assert max(loss) <= 2040 and sum(x == 2040 for x in loss) > len(rows) / 10
    assert not any(n & (n - 1) for n in total) and sum(n for n in total if n == 2048) > 0.97 * sum(total)
    assert len([p for row in rows for p in row]) < 1.5 * (len(lengths) + sum(lengths) / 2048)
    seen = defaultdict(int)
    for i, _, n in (p for row in rows for p in row):
        seen[i] += n
    assert [seen[i] for i in range(len(lengths))] == lengths


def test_prompts():
    texts = ["Sum it up. The rest", "one sentence only.", "A title\n\nand text", "", None, "no end", "?!x", "Ends here.\n \n"]
    assert packing.prompt_texts(pa.array(texts), packing.PROMPT).to_pylist() == ["Sum it up.", "", "A title\n", "", "", "", "?", ""]


def test_conversations_bear_loss_on_their_last_answer(spark):
    from tokenizers import Tokenizer

    from tidemill.llm.queries import tokenizer_path

    turns = [(1, 0, "user", "what is the river like"), (1, 1, "assistant", "wide and cold"), (1, 2, "user", "thanks a lot"), (2, 0, "assistant", "hello there"), (3, 0, "user", "no answer"), (3, 1, "user", None), (4, 1, "assistant", "second words"), (4, 0, "user", "first")]
    rows = packing.pack_conversations(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), tokenizer_path("word_bpe_49k.json")).collect()
    size = lambda text: len(Tokenizer.from_file(tokenizer_path("word_bpe_49k.json")).encode(text, add_special_tokens=False).ids)
    total, loss = defaultdict(int), defaultdict(int)
    for r in rows:
        total[r["doc_id"]] += r["length"]
        loss[r["doc_id"]] += r["loss_tokens"]
    whole = {1: "what is the river like\nwide and cold\nthanks a lot", 2: "hello there", 3: "no answer\n", 4: "first\nsecond words"}
    assert dict(total) == {k: size(t) + 1 for k, t in whole.items()}
    most = {1: size(whole[1]) + 1 - size("what is the river like"), 2: size("hello there"), 3: 1, 4: size("second words") + 1}
    assert all(0 < loss[k] <= most[k] for k in whole) and loss[3] <= 1
