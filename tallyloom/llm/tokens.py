"""Tokenisation of whole Arrow batches: each distinct part of the texts is encoded once.

A byte-level BPE encodes the parts between its pattern's certain cuts independently, so the ids of a
text are those of its parts in order.  The parts of a batch are dictionary-encoded, only those not yet in
the worker's bounded cache are given to the tokenizer, and the ids are put together in numpy.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from tallyloom.llm.textbytes import cut_bounds, grouped_take, kind_cuts, text_slices, word_bounds, words_array

#: Entries of a worker's cache of encoded parts, and the longest part that is kept.
CACHE_ENTRIES, CACHE_PART_BYTES = 200_000, 48


class PartTokenizer:
    """``words``: the tokenizer drops white space and lower-cases, so parts are lower-case words; else parts keep the white space before them."""

    def __init__(self, path: str, words: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.words, self.cache = Tokenizer.from_file(path), words, {}
        self.special = [x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        # The ids that end a word, or else start one that follows a space.
        size = self.tokenizer.get_vocab_size()
        tokens = map(self.tokenizer.id_to_token, range(size))
        self.edge = np.fromiter(((t or "").endswith("</w>") if words else (t or "").startswith("\u0120") for t in tokens), bool, size)

    def _each(self, parts: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.uint32).tobytes() for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def _joined(self, parts: list[str]) -> list[bytes]:
        """Ids of parts of letters only, encoded in one text: their ends or starts show in the ids."""
        ids = np.array(self.tokenizer.encode_batch_fast([(" " if self.words else "").join(parts)], add_special_tokens=False)[0].ids, np.uint32)
        cuts = np.flatnonzero(self.edge[ids])
        if len(cuts) != len(parts):
            return self._each(parts)
        raw, ends = ids.tobytes(), (4 * (cuts + 1 if self.words else np.append(cuts[1:], len(ids)))).tolist()
        return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def _ids(self, parts: list[bytes]) -> list[bytes]:
        cache = self.cache
        got = list(map(cache.get, parts))
        plain, other = [], []
        for i, x in enumerate(got):
            if x is None:
                text = parts[i].decode()
                (plain if (text.isalpha() if self.words else text[:1] == " " and text[1:].isalpha()) else other).append((i, text))
        for new, encode in ((plain, self._joined), (other, self._each)):
            for at in range(0, len(new), 512):
                own = new[at : at + 512]
                for (i, _), ids in zip(own, encode([t for _, t in own]), strict=True):
                    got[i] = ids
                    if len(cache) < CACHE_ENTRIES and len(parts[i]) <= CACHE_PART_BYTES:
                        cache[parts[i]] = ids
        return got

    def encode(self, column: pa.Array):
        """Yields (ids, ends) for consecutive rows of a string column: uint32 ids and where each row's end."""
        for data, offsets in text_slices(column):
            raw = data.tobytes()
            cuts = None
            if not any(x in raw for x in self.special):  # else those strings stay whole, for the tokenizer to find
                if self.words:
                    data = np.frombuffer(raw.lower(), np.uint8)
                    if any(x in data.tobytes() for x in self.special):
                        data = np.frombuffer(raw, np.uint8)
                cuts = kind_cuts(data)
            if self.words:
                starts, stops = word_bounds(data, offsets, cuts)
                parts = words_array(data, starts, stops)
            else:
                starts = cut_bounds(data, offsets, cuts)
                bounds = np.append(starts, len(data)).astype(np.int32)
                parts = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
            coded = parts.dictionary_encode()
            codes = coded.indices.to_numpy(zero_copy_only=False)
            each = self._ids(coded.dictionary.to_pylist())
            lengths = np.fromiter(map(len, each), np.int64, len(each)) // 4
            flat = np.frombuffer(b"".join(each), np.uint32)
            ids, ends = grouped_take(flat, np.cumsum(lengths) - lengths, lengths, codes)
            upto = np.concatenate([[0], ends])
            yield ids, upto[np.searchsorted(starts, offsets[1:])]


def with_end(ids: np.ndarray, ends: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with one more at the end of each document, and the new ends."""
    return np.insert(ids, ends, end_id), ends + np.arange(1, len(ends) + 1)
