"""Token ids of whole texts by a word-level BPE file, each distinct chunk encoded once.

The tokenizer drops white space and never joins text across it, so a text's ids
are those of its chunks between spaces and line ends, in order. It also never
joins a letter to a full stop or comma, and lowers case itself, so chunks are cut
and lowered there first. Chunks are made distinct per batch; ids of chunks seen
before are kept in a bounded cache.
"""

from __future__ import annotations

import functools
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from kelvinlake.llm._arrays import as_large

#: Distinct chunks whose ids one worker keeps; it starts anew beyond that.
CACHED = 400_000
#: Bytes of text whose chunks are made distinct at once.
TEXT_BYTES = 3_000_000


class ChunkEncoder:
    """Ids of texts; ``encode`` gives (ids uint32, offsets of the texts)."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.start = np.zeros(1 << 16, np.int64)
        self.used = 0

    def _add(self, chunks: list[str]) -> None:
        for at in range(0, len(chunks), 20_000):
            part = chunks[at : at + 20_000]
            found = [e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            n = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.fromiter((i for x in found for i in x), np.uint32, int(n.sum()))
            have = len(self.index)
            while len(self.start) < have + len(part) + 1:
                self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            while len(self.ids) < self.used + len(flat):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            self.ids[self.used : self.used + len(flat)] = flat
            self.start[have + 1 : have + 1 + len(part)] = self.used + np.cumsum(n)
            self.used += len(flat)
            self.index.update(zip(part, range(have, have + len(part)), strict=True))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        # the first step makes a fresh array: ascii_lower misreads slices of one
        texts = pc.replace_substring(as_large(texts), "\n", " ")
        if not pc.any(pc.match_substring(texts, "<|")).as_py():  # lowering could spell a special token
            texts = pc.ascii_lower(texts)
        texts = pc.replace_substring_regex(texts, r"([a-z])([.,])", r"\1 \2")
        lists = pc.split_pattern(texts, " ")
        at = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.values.slice(at[0], at[-1] - at[0]).dictionary_encode()
        at = at - at[0]
        chunks = coded.dictionary.to_pylist()
        new = [c for c in chunks if c not in self.index]
        if len(self.index) + len(new) > CACHED:
            self._clear()
            new = chunks
        self._add(new)
        place = np.fromiter(map(self.index.__getitem__, chunks), np.int64, len(chunks))
        chunk = place[coded.indices.to_numpy()] if len(place) else np.zeros(0, np.int64)
        start, n = self.start[chunk], self.start[chunk + 1] - self.start[chunk]
        total = np.concatenate([[0], np.cumsum(n)])
        ids = self.ids[np.arange(total[-1]) + np.repeat(start - total[:-1], n)]
        return ids, total[at]


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> ChunkEncoder:
    """One per Python worker and file."""
    return ChunkEncoder(path)
