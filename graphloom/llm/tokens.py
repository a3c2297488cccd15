"""Token ids of whole texts by the tokenizers library, with each distinct chunk of a batch encoded once."""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space beyond ASCII, and separators that regular expressions may count as such: texts with it are encoded whole.
_ODD = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80|[\x0b\x0c\x1c-\x1f]")

#: Bytes of the texts that distinct chunks are put into.
LINE = 1500


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of values[starts[i]:starts[i] + lengths[i]]."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return values[:0]
    kind = np.int32 if max(len(values), int(ends[-1])) < 1 << 31 else np.int64
    return values[np.repeat((starts - (ends - lengths)).astype(kind), lengths) + np.arange(ends[-1], dtype=kind)]


class Encoder:
    """Ids equal to those of the library over whole texts, for byte-level vocabularies with the usual word pattern.

    That pattern never joins a word to what stands before a single space, nor to a single line break between two
    words; so a text may be cut there, and equal chunks have equal ids. tests/llm holds this against whole texts.
    """

    _made: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        (self.line_break,) = self.tokenizer.encode("\n", add_special_tokens=False).ids

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for i in range(0, len(texts), 256):
            out += [np.asarray(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts[i : i + 256], add_special_tokens=False)]
        return out

    def _chunks(self, flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start and length of each chunk's ids) of the chunks flat[at[i]:at[i + 1]].

        Plain chunks (no white space but a leading space) go through the library many to a text, with line breaks
        between them, in texts that are short enough for its caches; the others one by one.
        """
        sizes = np.diff(at)
        plain = (np.add.reduceat((flat <= 32).astype(np.int32), at[:-1]) == (flat[at[:-1]] == 32)) & (flat[at[1:] - 1] > 32)
        starts, lengths = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        values, total, i = [], 0, np.flatnonzero(plain)
        if len(i):
            room = sizes[i] + 1
            begin = np.cumsum(room) - room
            joined = np.full(int(room.sum()), 10, np.uint8)
            inner = np.arange(int(sizes[i].sum())) - np.repeat(np.cumsum(sizes[i]) - sizes[i], sizes[i])
            joined[np.repeat(begin, sizes[i]) + inner] = flat[np.repeat(at[i], sizes[i]) + inner]
            first = np.flatnonzero(np.diff(begin // LINE, prepend=-1))  # of the chunks that a text has
            cuts, counts = [*begin[first].tolist(), len(joined)], np.diff(np.append(first, len(i))).tolist()
            data, stop = joined.tobytes(), np.asarray([self.line_break], np.uint32)
            lines = [data[a : b - 1].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:])]
            for j in range(0, len(lines), 64):
                for line, n, found in zip(lines[j : j + 64], counts[j : j + 64], self.tokenizer.encode_batch_fast(lines[j : j + 64], add_special_tokens=False)):
                    ids = np.asarray(found.ids, np.uint32)
                    if np.count_nonzero(ids == self.line_break) != n - 1:
                        ids = np.concatenate([x for own in self._whole(line.split("\n")) for x in (own, stop)])[:-1]
                    values += [ids, stop]
            ids = np.concatenate(values)
            ends = np.flatnonzero(ids == self.line_break)
            starts[i] = np.concatenate([[0], ends[:-1] + 1])
            lengths[i] = ends - starts[i]
            values, total = [ids], len(ids)
        for i in np.flatnonzero(~plain).tolist():
            (ids,) = self._whole([flat[at[i] : at[i + 1]].tobytes().decode("utf-8", "replace")])
            values.append(ids)
            starts[i], lengths[i] = total, len(ids)
            total += len(ids)
        return np.concatenate(values), starts, lengths

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts): all ids in order, and how many each text has. A null text is empty."""
        texts = pc.fill_null(texts, "").cast(pa.large_binary())
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
        base = int(offsets[0]) if n else 0
        data = texts.buffers()[2]
        raw = np.frombuffer(data, np.uint8)[base : int(offsets[-1])] if data is not None and n and offsets[-1] > base else np.zeros(0, np.uint8)
        offsets = offsets - base
        counts = np.zeros(n, np.int64)
        if not len(raw):
            return np.zeros(0, np.uint32), counts
        odd: dict[int, np.ndarray] = {}
        if found := {int(np.searchsorted(offsets, m.start(), "right")) - 1 for m in _ODD.finditer(raw)}:
            rows = sorted(found)
            odd = dict(zip(rows, self._whole([texts[i].as_py().decode("utf-8", "replace") for i in rows])))
        first = np.zeros(len(raw) + 1, bool)  # of a text
        first[offsets] = True
        solid = raw > 32
        between = np.zeros(len(raw), bool)  # within a text, with something solid on both sides
        between[1:-1] = solid[:-2] & solid[2:] & ~first[1:-2] & ~first[2:-1]
        line = between & (raw == 10)
        cut = first[:-1] | line | (between & (raw == 32))
        cut[1:] |= line[:-1]
        starts = np.flatnonzero(cut)
        chunks = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(raw)).astype(np.int64)), pa.py_buffer(raw)]).dictionary_encode()
        codes, distinct = chunks.indices.to_numpy(zero_copy_only=False), chunks.dictionary
        at = np.frombuffer(distinct.buffers()[1], np.int64)[distinct.offset : distinct.offset + len(distinct) + 1]
        flat = np.frombuffer(distinct.buffers()[2], np.uint8)
        values, begin, lengths = self._chunks(flat, at)
        doc = np.searchsorted(offsets, starts, "right") - 1
        sizes = lengths[codes]
        if odd:
            sizes[np.isin(doc, list(odd))] = 0
        all_ids = ragged(values, begin[codes], sizes)
        counts = np.bincount(doc, weights=sizes, minlength=n).astype(np.int64)
        if odd:
            parts, position = [], np.concatenate([[0], np.cumsum(counts)])
            last = 0
            for i in sorted(odd):
                parts += [all_ids[last : position[i]], odd[i]]
                last = position[i]
                counts[i] = len(odd[i])
            all_ids = np.concatenate([*parts, all_ids[last:]])
        return all_ids, counts


def with_end(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's ids with ``end`` behind them."""
    out = np.full(len(ids) + len(counts), end, np.uint32)
    stops = np.cumsum(counts + 1) - 1
    keep = np.ones(len(out), bool)
    keep[stops] = False
    out[keep] = ids
    return out, counts + 1
