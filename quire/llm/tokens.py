"""Token ids of whole texts by the `tokenizers` library, each distinct word encoded once per Python worker.

The word-level vocabularies served here drop white space before their merges, so the ids of a text are the ids
of its white-space-free runs, one after another. A worker keeps a lexicon from run to ids between tasks. The
property is checked when a tokenizer is opened; a tokenizer that lacks it has its texts encoded whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import slices
from .words import ranges, split_words

#: Runs made of these letters only are one pre-token, in NFC, and their lower case is the tokenizer's own. To be tested
#: before lower-casing: other letters (U+0130) can turn into these in Arrow but not in the tokenizer.
_PLAIN = "^[a-zA-ZÀ-ÖØ-öø-ÿ]+[.,]?$"
_PROBE = ["The the, don't  x1.y2\tÀé\n\nSTRASSE's <|endoftext|>z it'll 42%", "İstanbul ÀÖØÞ", " a ", "Á é b", "'s't 're"]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Lexicon:
    """Ids of texts under one tokenizer file; `most` bounds the runs that are kept."""

    def __init__(self, path: str, most: int = 700_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.clear()
        whole = [self.tokenizer.encode(t, add_special_tokens=False).ids for t in _PROBE]
        self.by_run = self.pretoken_ok() and whole == [x.tolist() for x in self.encode(pa.array(_PROBE))]

    def clear(self) -> None:
        self.words = pa.array([], pa.large_string())
        self.lengths = np.zeros(0, np.int32)
        self.starts = np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32)

    def pretoken_ok(self) -> bool:
        """A plain run can go straight to the model (what the normalizer and pre-tokenizer would pass on)."""
        self.by_run, self.direct = True, False
        probe = ["the", "été", "größe", "the,", "señor."]
        whole = [self.tokenizer.encode(t, add_special_tokens=False).ids for t in probe]
        try:
            self.direct = whole == [self.model_ids(t) for t in probe]
        except Exception as e:  # a model that isn't byte-level BPE has other pre-tokens
            if "Unk" in str(e):
                raise
        return True

    def model_ids(self, run: str) -> list[int]:
        tail = run[-1:] if run[-1:] in ".," else ""
        tokenize, ids = self.tokenizer.model.tokenize, []
        for part in (run[: len(run) - len(tail)], tail):
            if part:
                ids += [t.id for t in tokenize(part if part.isascii() else part.encode().decode("latin-1").translate(_BYTES))]
        return ids

    def learn(self, new: pa.Array) -> None:
        """Add runs to the lexicon."""
        if self.direct:
            lower = pc.utf8_lower(new)
            plain = np.asarray(pc.match_substring_regex(new, _PLAIN))
        else:
            lower, plain = new, np.zeros(len(new), bool)
        out: list = [None] * len(new)
        if plain.any():
            coded = lower.filter(pa.array(plain)).dictionary_encode()
            runs = coded.dictionary
            tail = np.asarray(pc.match_substring_regex(runs, "[.,]$"))
            stems = pc.if_else(pa.array(tail), pc.utf8_slice_codeunits(runs, 0, -1), runs).dictionary_encode()
            stem_ids = [self.model_ids(s) for s in stems.dictionary.to_pylist()]
            ends = [self.model_ids(t) for t in (".", ",")]
            last = np.asarray(pc.ends_with(runs, ","))
            made = [stem_ids[k] + ends[c] if t else stem_ids[k] for k, t, c in zip(np.asarray(stems.indices).tolist(), tail.tolist(), last.tolist())]
            for i, k in zip(np.flatnonzero(plain).tolist(), np.asarray(coded.indices).tolist()):
                out[i] = made[k]
        odd = np.flatnonzero(~plain)
        for at in range(0, len(odd), 4096):
            part = odd[at : at + 4096]
            for i, e in zip(part.tolist(), self.tokenizer.encode_batch_fast(new.take(pa.array(part)).to_pylist(), add_special_tokens=False)):
                out[i] = e.ids
        lengths = np.fromiter(map(len, out), np.int64, len(out))
        flat = np.fromiter((x for ids in out for x in ids), np.uint32, int(lengths.sum()))
        starts = len(self.ids) + np.cumsum(lengths) - lengths
        self.words = pa.concat_arrays([self.words, new])
        self.lengths = np.concatenate([self.lengths, lengths.astype(np.int32)])
        self.starts = np.concatenate([self.starts, starts.astype(np.int32)])
        self.ids = np.concatenate([self.ids, flat])

    def encode_flat(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column of texts, and the offsets of each text's ids (n + 1 long)."""
        if not self.by_run:
            got = [e.ids for e in self.tokenizer.encode_batch_fast(column.cast(pa.string()).fill_null("").to_pylist(), add_special_tokens=False)]
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in got], dtype=np.int64)))
            return np.fromiter((x for ids in got for x in ids), np.uint32, int(offsets[-1])), offsets
        flat, offsets = split_words(column)
        coded = flat.dictionary_encode()
        distinct = coded.dictionary
        if len(self.words) > self.most:
            self.clear()
        where = pc.index_in(distinct, self.words)
        if where.null_count:
            self.learn(distinct.filter(where.is_null()))
            where = np.asarray(where.fill_null(-1)).astype(np.int64)
            where[where < 0] = np.arange(len(self.words) - int((where < 0).sum()), len(self.words))
        at = np.asarray(where)[np.asarray(coded.indices)]
        lengths = self.lengths[at].astype(np.int64)
        ids = self.ids[ranges(self.starts[at].astype(np.int64), lengths)]
        ends = np.concatenate(([0], np.cumsum(lengths)))
        return ids, ends[offsets]

    def encode(self, column: pa.Array) -> list[np.ndarray]:
        ids, offsets = self.encode_flat(column)
        return [ids[a:b] for a, b in zip(offsets[:-1], offsets[1:])]


def _byte_letters() -> dict[int, int]:
    """The printable letters that byte-level models use for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(rest)}


_BYTES = _byte_letters()
_open: dict[str, Lexicon] = {}


def lexicon(path: str) -> Lexicon:
    """One lexicon per worker and tokenizer file."""
    if path not in _open:
        _open[path] = Lexicon(path)
    return _open[path]


def encoded(batches: Iterator[pa.RecordBatch], path: str, text: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the input with the ids of their texts and each text's offsets."""
    lex = lexicon(path)
    for batch in batches:
        for part in slices(batch, text, 3 << 20):
            ids, offsets = lex.encode_flat(part.column(text))
            yield part, ids, offsets
