"""Whole-text tokenization over Arrow batches with a bounded cache of pieces.

The vocabularies used here never merge across the cuts made below, so a text's ids are the ids of its
pieces in a row. Pieces repeat, so most of them come from the cache and only new ones reach the
tokenizers library. Texts whose white space makes a cut unsafe go to the library whole.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces kept per Python worker; when full, only those of the texts at hand stay.
CACHE_PIECES = 700_000
#: Bytes of text handled at once.
CHUNK_CHARS = 10_000_000
#: New pieces that go to the library as one text, and what stands between them.
ROW_PIECES, _MARK = 1000, "<|endoftext|>"

_CUT = "\x01"
#: A stop between a letter and white space or the end, as texts are when they are cut.
_STOP = r"([A-Za-z])([.,!?;:])([ \x01]|$)"
#: White space other than single blanks and line feeds, doubled white space, and special-token marks.
_UNSAFE = (
    r"[ \n][ \n]|[\x01\t\x0B-\r\x1C-\x1F]|[\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]|<\|"
)

_ENCODERS: dict[tuple[str, str], PieceEncoder] = {}


class PieceEncoder:
    """kind 'byte': blanks belong to the word after them; kind 'word': white space has no ids."""

    def __init__(self, path: str, kind: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.kind = Tokenizer.from_file(path), kind
        self.cache: dict[str, bytes] = {"": b""}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self._encoded(texts)]

    def _encoded(self, texts: list[str]) -> list:
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return encode(texts, add_special_tokens=False)

    def _ids_of_pieces(self, pieces: list[str]) -> list[bytes]:
        """As _ids(), of many short pieces: they go to the library in rows, with a special token between two.

        The library cuts a text at special tokens before anything else, so each piece is encoded by itself.
        """
        mark_id = self.tokenizer.token_to_id(_MARK)
        if mark_id is None or len(pieces) < 8 or any("<|" in p for p in pieces):
            return self._ids(pieces)
        groups, out = [pieces[i : i + ROW_PIECES] for i in range(0, len(pieces), ROW_PIECES)], []
        for group, found in zip(groups, self._encoded([_MARK.join(g) for g in groups]), strict=True):
            ids = np.array(found.ids, "<u4")
            cuts = np.flatnonzero(ids == mark_id)
            if len(cuts) != len(group) - 1:  # a piece holds the mark's id
                out += self._ids(group)
                continue
            raw, begin = memoryview(ids.tobytes()), 0
            for end in [*cuts.tolist(), len(ids)]:
                out.append(bytes(raw[4 * begin : 4 * end]))
                begin = end + 1
        return out

    def _pieces(self, texts: pa.Array) -> pa.ListArray:
        # Both vocabularies also cut between a letter and a stop; there are fewer words than words with stops.
        if self.kind == "word":
            texts = pc.replace_substring_regex(pc.replace_substring(pc.ascii_lower(texts), "\n", " "), _STOP, r"\1 \2\3")
            return pc.split_pattern(texts, " ")
        marked = pc.replace_substring(texts, " ", _CUT + " ")
        marked = pc.replace_substring(marked, "\n", f"{_CUT}\n{_CUT}")
        return pc.split_pattern(pc.replace_substring_regex(marked, _STOP, rf"\1{_CUT}\2\3"), _CUT)

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        # Special tokens are found before letters are made small, so a text that may have one is left as it is.
        unsafe = _UNSAFE if self.kind == "byte" else r"<\|"
        whole = pc.match_substring_regex(texts, unsafe).to_numpy(zero_copy_only=False)
        if whole.any():
            found = self._ids(texts.filter(pa.array(whole)).to_pylist())
            texts = pc.if_else(pa.array(whole), pa.scalar("", texts.type), texts)
        lists = self._pieces(texts)
        coded = lists.flatten().dictionary_encode()
        pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        cache = self.cache
        if new := [p for p in pieces if p not in cache]:
            fresh = dict(zip(new, self._ids_of_pieces(new), strict=True))
            arrays = [fresh[p] if p in fresh else cache[p] for p in pieces]
            if len(cache) + len(new) > CACHE_PIECES:
                self.cache = {"": b""} | dict(zip(pieces[:CACHE_PIECES], arrays, strict=False))
            else:
                cache.update(fresh)
        else:
            arrays = [cache[p] for p in pieces]
        arena = np.frombuffer(b"".join(arrays), "<u4")
        size = np.fromiter(map(len, arrays), np.int64, len(arrays)) // 4
        at = np.cumsum(size) - size
        index = coded.indices.to_numpy(zero_copy_only=False)
        each = size[index]
        ends = np.cumsum(each)
        begins = ends - each
        total = int(ends[-1]) if len(ends) else 0
        ids = arena[np.repeat(at[index] - begins, each) + np.arange(total)]
        cuts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        offsets = np.concatenate([[0], ends])[cuts]
        if whole.any():
            ids, offsets = _merged(ids, offsets, np.flatnonzero(whole), found)
        return ids, offsets

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row (null: none), and len(texts) + 1 offsets into them."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        chars = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        parts, offsets, at = [], [np.zeros(1, np.int64)], 0
        while at < len(texts):
            done = chars[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(chars, done + CHUNK_CHARS, "right")))
            ids, cut = self._encode(pa.concat_arrays([texts.slice(at, to - at)]))
            offsets.append(cut[1:] + offsets[-1][-1])
            parts.append(ids)
            at = to
        return (np.concatenate(parts) if parts else np.zeros(0, "<u4")), np.concatenate(offsets)


def _merged(ids: np.ndarray, offsets: np.ndarray, at: np.ndarray, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Puts the ids of the texts that were encoded whole in their places, which are empty so far."""
    size = np.diff(offsets)
    rows = [np.frombuffer(x, "<u4") for x in found]
    out, last = [], 0
    for i, row in zip(at, rows, strict=True):
        out += [ids[last : offsets[i]], row]
        last = offsets[i]
        size[i] = len(row)
    return np.concatenate([*out, ids[last:]]), np.concatenate([[0], np.cumsum(size)])


def encoder(path: str, kind: str) -> PieceEncoder:
    """One encoder per Python worker, kept between tasks with its cache."""
    if (path, kind) not in _ENCODERS:
        _ENCODERS[path, kind] = PieceEncoder(path, kind)
    return _ENCODERS[path, kind]
