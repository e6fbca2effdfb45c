"""Token ids of whole texts by a given tokenizer file, encoded word by word with a bounded cache."""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Marks that end words. After a Latin letter or digit a run of them is a token run of its own, so word and marks are encoded apart.
STOPS = ".,;:!?#*$%&|<>"
#: Letters below this one are in composed form, and lower-case alike in all libraries, but for the dotted capital I.
#: That one in lower case ends in a combining dot, which is no letter, so that marks after it are in its run.
LATIN_END, DOTTED = "\u0250", "\u0130"
#: Words that a generation of the cache holds; there are two, of about 200 bytes a word.
GENERATION = 50_000
#: Words of lower-case letters that are encoded in a row.
RUN = 64
#: Bytes of text that are encoded together.
BLOCK = 3 << 20


class Encoder:
    """Token ids of texts, without special tokens added but for an end id after each.

    The tokenizer file drops white space before it splits words and its normaliser works within a word, so a text's ids are its
    words' ids in a row, in either case of A-Z. The different words of a block of texts are encoded once each, and not again while they stay in the cache;
    words that were not met while a whole generation filled up are forgotten, and results don't depend on it. All this holds for tokenizers of this
    kind only: by_word=False encodes texts as they are."""

    def __init__(self, path: str, by_word: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        # for runs of lower-case words of Latin letters alone: their normal form is themselves, and each is one run of letters
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocab = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.closes[[i for t, i in vocab.items() if suffix and t.endswith(suffix)]] = True
        self.by_word, self.known, self.old = by_word and bool(suffix), {}, {}

    def _encoded(self, texts: list[str]) -> Iterator[bytes]:
        return (array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False))

    def _simple(self, words: list[str]) -> list[bytes]:
        """Ids of words of lower-case Latin letters: they are encoded in rows of RUN, and a word's last token is the one with the end of a word in it."""
        if not words:
            return []
        rows = [" ".join(words[i : i + RUN]) for i in range(0, len(words), RUN)]
        ids = np.concatenate([np.array(e.ids, "<u4") for e in self.plain.encode_batch_fast(rows, add_special_tokens=False)])
        ends = (4 * (np.flatnonzero(self.closes[ids]) + 1)).tolist()
        flat = ids.tobytes()
        return [flat[lo:hi] for lo, hi in zip([0, *ends[:-1]], ends, strict=True)]

    def _learn(self, words: list[str]) -> None:
        if len(self.known) >= GENERATION:
            self.known, self.old = {}, self.known
        known, old = self.known, self.old
        ends = [(w, stem, w[len(stem) :]) for w in words if w[-1:] in STOPS and (last := (stem := w.rstrip(STOPS))[-1:]).isalnum() and last < LATIN_END and last != DOTTED]
        want = set(words)
        want.difference_update([w for w, _, _ in ends])
        want.update([stem for _, stem, _ in ends], {stop for _, _, stop in ends})
        want -= known.keys()
        back = want & old.keys()
        known.update((w, old[w]) for w in back)
        want -= back
        simple = [w for w in want if w.isalpha() and (w.isascii() or (max(w) < LATIN_END and DOTTED not in w))]
        known.update(zip(simple, self._simple([w.lower() for w in simple]), strict=True))
        rest = list(want.difference(simple))
        known.update(zip(rest, self._encoded(rest), strict=True))
        known.update((w, known[stem] + known[stop]) for w, stem, stop in ends)

    def _block(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and where each text's end."""
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        edges = lists.offsets.to_numpy()
        coded = lists.values.slice(edges[0], edges[-1] - edges[0]).dictionary_encode()
        # words hold no blank: joined and split they are Python strings sooner than one by one
        words = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary), " ")[0].as_py().split(" ") if len(coded) else []
        at = coded.indices.to_numpy()
        ids = list(map(self.known.get, words))
        if None in ids:
            self._learn([w for w, i in zip(words, ids, strict=True) if i is None])
            known = self.known
            ids = [known[w] if i is None else i for w, i in zip(words, ids, strict=True)]
        size = np.fromiter(map(len, ids), np.int32, len(ids)) >> 2
        start, flat = np.cumsum(size, dtype=np.int32) - size, np.frombuffer(b"".join(ids), "<u4")
        each = size[at]
        upto = np.zeros(len(each) + 1, np.int32)
        np.cumsum(each, out=upto[1:])
        place = np.arange(upto[-1], dtype=np.int32)
        place += np.repeat(start[at] - upto[:-1], each)
        return flat[place], upto[edges[1:] - edges[0]].astype(np.int64)

    def encode(self, texts: pa.Array, end_id: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For runs of the texts (binary), in order: their ids, each text's with end_id after them, and where each text's end."""
        for run in blocks(texts):
            try:
                run = run.cast(pa.string())
            except pa.ArrowInvalid:
                run = pa.array([t.decode("utf-8", "replace") for t in run.to_pylist()], pa.string())
            # a special token's string counts in its own case alone, and as a whole
            if self.by_word and not pc.any(pc.match_substring(run, "<|")).as_py():
                ids, ends = self._block(run)
            else:
                each = list(self._encoded(run.to_pylist()))
                ids, ends = np.frombuffer(b"".join(each), "<u4"), np.cumsum([len(x) // 4 for x in each])
            out = np.empty(len(ids) + len(ends), np.uint32)
            last = ends + np.arange(len(ends))
            own = np.ones(len(out), bool)
            own[last] = False
            out[own], out[last] = ids, end_id
            yield out, last + 1


@cache
def encoder(path: str) -> Encoder:
    """The encoder of a tokenizer file in this process, so that a worker's next task finds the words of the one before."""
    return Encoder(path)


def merged(batches: Iterator[pa.RecordBatch], most: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """The batches in runs of about `most` bytes, each as one batch."""
    run, n = [], 0
    for b in batches:
        run.append(b)
        n += b.nbytes
        if n >= most:
            yield pa.concat_batches(run)
            run, n = [], 0
    if run:
        yield pa.concat_batches(run)


def blocks(texts: pa.Array, most: int = BLOCK) -> Iterator[pa.Array]:
    """The texts, nulls as empty ones, in runs of about `most` bytes."""
    texts = texts.fill_null(b"")
    upto = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + most)))
        yield texts.slice(lo, hi - lo)
        lo = hi
