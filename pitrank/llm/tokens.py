"""Token ids of filing documents with a public byte-level BPE vocabulary, unit by unit.

A position before white space that follows no white space is a pre-token boundary whatever surrounds it: pre-tokens hold
white space at their start only. Texts are cut there at spaces and line ends, and before marks that end a word; each
distinct unit is encoded by the tokenizers library once per worker and remembered up to a bound, and the ids of a text
are its units' ids in order.
"""
from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

# White space after white space is no safe cut; texts that hold such runs are encoded as a whole.
RUN = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]{2}"
# Starts a unit that has no white space before it: a text's first one, and a mark after a letter or digit.
BARE = "\x01"
# Fixed value: the pre-token pattern of byte-level BPE vocabularies.
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
# A mark that ends a word is a pre-token of its own. The class is of letters and digits all regex engines agree on.
ENDING = r"([0-9A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}])([.,;:!?])( |$)"
# Up to here Unicode versions agree on what a letter, a number and white space is.
PLAIN_BELOW = "\u0250"


def byte_letters() -> dict[int, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}


class UnitEncoder:
    """Encodes texts as unsigned 32-bit ids."""

    def __init__(self, path: str, limit: int = 100_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self._tokenizer = Tokenizer.from_file(path)
        # texts that hold the string of a special token, which is one id, are encoded as a whole
        self._special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values() if t.content]
        self._merge = self._tokenizer.model.tokenize
        letters = byte_letters()
        # every character that is taken the short way, as the letters that stand for its bytes
        self._shown = {c: "".join(chr(letters[b]) for b in chr(c).encode()) for c in range(ord(PLAIN_BELOW))}
        size = self._tokenizer.get_vocab_size()
        self._id_bytes = [i.to_bytes(4, "little") for i in range(size)]
        self._limit = limit
        # unit -> its ids; the units before the last change of generation stay at hand
        self._known: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        # the short way is taken only with the pre-tokenizer it knows
        sample = "It's 12 fine,  naïve\n\n tests of (x) .\t"
        self._plain = self._by_pre_tokens(sample) == self._whole([sample])[0]
        self._line_end = self._pre_token("\n")

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype="<u4").tobytes()
                for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pre_token(self, piece: str) -> bytes:
        """Ids of one pre-token, merged by the library's model."""
        return b"".join([self._id_bytes[t.id] for t in self._merge(piece.translate(self._shown))])

    def _spaced_letters(self, letters: str) -> bytes:
        """Ids of a space and letters."""
        shown = letters if letters.isascii() else letters.translate(self._shown)  # ASCII letters stand for themselves
        return b"".join([self._id_bytes[t.id] for t in self._merge(self._shown[32] + shown)])

    def _by_pre_tokens(self, text: str) -> bytes:
        return b"".join(map(self._pre_token, PRE_TOKEN.findall(text)))

    def _unit(self, unit: str) -> bytes:
        """Ids of a unit: what follows a space (which belongs to it), a line end and what follows, or bare text."""
        first, rest = unit[:1], unit[1:]
        text = rest if first == BARE else unit if first == "\n" else " " + unit
        if not (unit.isascii() or max(unit) < PLAIN_BELOW):
            return self._whole([text])[0]
        if unit.isalpha():
            return self._spaced_letters(unit)
        if first == "\n" and rest.isalpha():
            return self._line_end + self._pre_token(rest)
        return self._by_pre_tokens(text)

    def _find(self, units: list[str]) -> list[bytes]:
        known = self._known
        if len(known) > self._limit:
            self._older, known = known, {}
            self._known = known
        older, bytes_of, merge, space = self._older, self._id_bytes, self._merge, self._shown[32]
        out = list(map(known.get, units))
        for i, ids in enumerate(out):
            if ids is None:
                unit = units[i]
                ids = older.get(unit)
                if ids is None:
                    if unit.isascii() and unit.isalpha():  # the most frequent kind: letters that stand for themselves
                        ids = b"".join([bytes_of[t.id] for t in merge(space + unit)])
                    else:
                        ids = self._unit(unit)
                out[i] = known[unit] = ids
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after the other, and where each text's ids begin (one number more than texts).

        Cutting, finding distinct units and putting ids together are vectorised; only distinct units are looked up.
        """
        odd = pc.match_substring_regex(pa.array(texts, pa.string()), RUN).to_pylist()
        short = [bool(t) and self._plain and BARE not in t and not o and not any(s in t for s in self._special)
                 for t, o in zip(texts, odd)]
        marked = pc.replace_substring(pa.array([BARE + t for t, s in zip(texts, short) if s], pa.string()), "\n", " \n")
        cut = pc.split_pattern(pc.replace_substring_regex(marked, ENDING, rf"\1 {BARE}\2\3"), " ")
        coded = cut.flatten().dictionary_encode()
        codes = coded.indices.to_numpy()
        ids = self._find(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        per_unit = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<u4")))
        values = per_unit.take(coded.indices).flatten().to_numpy()
        at_unit = np.concatenate([[0], np.cumsum(sizes[codes])])
        bounds = at_unit[cut.offsets.to_numpy()]
        if all(short):
            return values, bounds
        whole = iter(self._whole([t for t, s in zip(texts, short) if not s]))
        quick = (values[a:b] for a, b in zip(bounds[:-1], bounds[1:]))
        parts = [next(quick) if s else np.frombuffer(next(whole), "<u4") for s in short]
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        return (np.concatenate([*parts, np.empty(0, "<u4")]).astype("<u4"), np.concatenate([[0], np.cumsum(lengths)]))


@lru_cache(maxsize=2)
def encoder(path: str) -> UnitEncoder:
    """One encoder per worker and vocabulary file."""
    return UnitEncoder(path)


def blocks_of(texts: pa.Array, chars: int = 5_000_000):
    """Texts in blocks of about so many characters, to bound what is held and worked on at once; NULL is empty."""
    block, size = [], 0
    for text in texts:
        block.append(text.as_py() or "")
        size += len(block[-1])
        if size >= chars:
            yield block
            block, size = [], 0
    if block:
        yield block
