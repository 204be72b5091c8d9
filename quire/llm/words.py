"""Words of whole texts as Arrow arrays. A word is `[^\\x20\\x09-\\x0D]+`: a run without ASCII white space."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

WORD = r"[^ \t-\r]+"


def split_words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of a column of texts in order, and the offsets of each text's words (n + 1 long); null has none."""
    lists = pc.ascii_split_whitespace(column.cast(pa.large_string()).fill_null(""))
    flat = lists.flatten()
    offsets = np.asarray(lists.offsets).astype(np.int64)
    offsets = offsets - offsets[0]
    full = np.asarray(pc.binary_length(flat)) > 0  # white space at either end leaves an empty word
    if not full.all():
        kept = np.concatenate(([0], np.cumsum(full)))
        flat, offsets = flat.filter(pa.array(full)), kept[offsets]
    return flat, offsets


class WordIds:
    """Distinct words of each batch, numbered; what is derived from a word is derived once and kept, within bounds."""

    def __init__(self, derive, most: int = 150_000):
        self.derive, self.most, self.known = derive, most, {}

    def __call__(self, flat: pa.Array) -> tuple[np.ndarray, list]:
        """Index of each word among the batch's distinct words, and what is derived from each of those."""
        coded = flat.dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.known) > self.most:
            self.known = {}
        known = self.known
        new = [w for w in words if w not in known]
        if new:
            known.update(zip(new, self.derive(new)))
        return np.asarray(coded.indices), [known[w] for w in words]


def hash_words(words: list[str]) -> list[bytes]:
    """128 bits for each word, as 16 bytes."""
    return [xxhash.xxh3_128_digest(w.encode()) for w in words]


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of every range, one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
