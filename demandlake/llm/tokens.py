"""Token ids of whole texts under a given tokenizer file, word by word.

The tokenizer lower-cases, drops white space and never merges across it, so a text's ids
are those of its words one after the other. Each batch therefore encodes only its distinct
words, and gathers the ids of all words with numpy.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from demandlake.llm.text import CHUNK_BYTES, give_back

TOKENIZER_FILE = "word_bpe_49k.json"
END_ID = 1
# A worker keeps two generations of so many words each; the older one is dropped.
_REMEMBERED = 250_000
# Words are encoded together for about so many bytes of text.
_RUN_BYTES = 12 * CHUNK_BYTES
# Their ids are gathered for about so many words of whole texts at a time.
_GATHERED_WORDS = 200_000
# Below this code point a lower-cased letter is its own normal form.
_PLAIN = "\u0250"
_END_SIGNS = ".,;:!?"
# Marks the tokenizer's special strings, which are told by their case.
_SPECIAL = "<|"


def tokenizer_path(name: str = TOKENIZER_FILE) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies use for each Latin-1 code point: itself if it
    is a printable sign, else one of the code points from 256 on, in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) if b in own else chr(256 + others.index(b)) for b in range(256)}


class WordEncoder:
    """Ids of single words as little-endian bytes. Words of plain letters go to the
    tokenizer's model at once, past its normaliser and splitter."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._pieces = self._tokenizer.model.tokenize
        self._letters = byte_letters()
        self._known: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def __call__(self, words: list[str]) -> list[bytes]:
        if len(self._known) >= _REMEMBERED:
            self._known, self._older = {}, self._known
        known, older = self._known, self._older
        found = [known.get(w) for w in words]
        for i, ids in enumerate(found):
            if ids is None:
                word = words[i]
                ids = older.get(word)
                if ids is None:
                    ids = self._encode(word)
                found[i] = known[word] = ids
        return found

    def _encode(self, word: str) -> bytes:
        lower = word.lower()
        if lower.isalpha() and max(lower) < _PLAIN:
            return self._plain(lower)
        core = lower.rstrip(_END_SIGNS)
        if core != lower and core.isalpha() and max(core) < _PLAIN:
            # Letters, and a run of signs without an apostrophe, are pieces of their own.
            tail = lower[len(core):]
            signs = self._known.get(tail)
            if signs is None:
                signs = self._known[tail] = self._whole(tail)
            letters = self._known.get(core)
            return (self._plain(core) if letters is None else letters) + signs
        return self._whole(word)

    def _plain(self, letters: str) -> bytes:
        if not letters.isascii():
            letters = letters.encode().decode("latin-1").translate(self._letters)
        return array("I", [piece.id for piece in self._pieces(letters)]).tobytes()

    def _whole(self, word: str) -> bytes:
        return array("I", self._tokenizer.encode(word, add_special_tokens=False).ids).tobytes()


@lru_cache(maxsize=1)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def encode_texts(texts: pa.Array, path: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first, ids, bounds)`` for runs of texts: text ``first + i`` has the ids
    ``ids[bounds[i]:bounds[i + 1]]``, its end id among them. A null text is empty."""
    encoder = word_encoder(path)
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    sizes = np.concatenate(([0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))))
    first = 0
    while first < len(texts):
        end = int(np.searchsorted(sizes, sizes[first] + _RUN_BYTES, "right")) - 1
        end = min(max(end, first + 1), len(texts))
        for at, ids, bounds in _encode_run(texts.slice(first, end - first), encoder):
            yield first + at, ids, bounds
        first = end
        give_back()


def _encode_run(texts: pa.Array, encoder: WordEncoder) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    if not pc.any(pc.match_substring(texts, _SPECIAL)).as_py():
        # The tokenizer would do so; fewer distinct words are left.
        texts = pc.ascii_lower(texts)
    parts = pc.ascii_split_whitespace(texts)
    n_words = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(parts)
    used = pc.not_equal(flat, "")
    if not pc.all(used).as_py():
        # White space at the edge of a text leaves an empty word.
        owner = np.repeat(np.arange(len(texts)), n_words)[used.to_numpy(zero_copy_only=False)]
        n_words = np.bincount(owner, minlength=len(texts))
        flat = flat.filter(used)
    coded = flat.dictionary_encode()
    pieces = encoder(coded.dictionary.to_pylist())
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
    store = np.frombuffer(b"".join(pieces), np.uint32)
    starts = np.cumsum(lengths) - lengths
    word = coded.indices.to_numpy(zero_copy_only=False)
    first_word = np.concatenate(([0], np.cumsum(n_words)))
    n_texts = len(texts)
    del texts, parts, flat, used, coded, pieces

    # The end id of each text goes after its last word.
    store = np.append(store, np.uint32(END_ID))
    starts, lengths = np.append(starts, len(store) - 1), np.append(lengths, 1)
    first = 0
    while first < n_texts:
        end = int(np.searchsorted(first_word, first_word[first] + _GATHERED_WORDS, "right")) - 1
        end = min(max(end, first + 1), n_texts)
        last = first_word[first + 1:end + 1] - first_word[first]
        mine = np.insert(word[first_word[first]:first_word[end]], last, len(starts) - 1)
        size = lengths[mine]
        ends = np.cumsum(size)
        source = np.repeat(starts[mine] - (ends - size), size) + np.arange(int(ends[-1]))
        bounds = np.zeros(end - first + 1, np.int64)
        bounds[1:] = ends[last + np.arange(end - first)]
        yield first, store[source], bounds
        first = end
