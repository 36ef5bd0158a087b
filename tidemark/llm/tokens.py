"""Fast, exact use of tokenizer files inside tasks."""

from __future__ import annotations

import base64
import hashlib
import os
import re

import numpy as np
import public_tokenizers

#: Distinct pieces remembered per worker process, about 200 bytes each; then the memory starts anew.
MEMORY = 1_000_000
_LOADED: dict[str, object] = {}


def load(name: str):
    """The tokenizer of a .json file; loaded once per process, in one thread."""
    if name not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(public_tokenizers.path(name))
        t.no_truncation()
        t.no_padding()
        _LOADED[name] = t
    return _LOADED[name]


def version(name: str) -> str:
    """Digest of a tokenizer file and the library's version."""
    import tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()


def _byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: printable ones stand for
    themselves, the others for the code points from 256 on, in order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b if b in shown else next(other)) for b in range(256)]


_LETTERS = dict(enumerate(_byte_letters()))
_STOPS = ".,;:!?"


class _Known(dict):
    """Values of pieces; a piece asked for in vain is noted."""

    def __init__(self):
        self.new: dict = {}

    def __missing__(self, piece):
        self.new[piece] = None


class Memo:
    """Encodes texts by pieces that the tokenizer never joins.

    `pieces` splits a text into hashable keys, or gives None where only the whole text is safe to
    encode; `spell` turns a key into its text, and `value` the ids of that into what is kept.
    """

    def __init__(self, name: str, pieces, spell, value):
        self.tokenizer, self.pieces, self.spell, self.value = load(name), pieces, spell, value
        self.model, self.stops = self.tokenizer.model, {}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known = _Known()

    def _encode(self, texts: list[str]) -> list:
        return [self.value(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _plain_word(self, text: str):
        """Value of a word of Latin letters, with a space before it or full stops and the like after
        it, straight from the library's model; None for any other piece.

        Letters and such a run of stops are pieces of their own in the tokenizers' patterns.
        """
        core = text.rstrip(_STOPS)
        word = core[1:] if core[:1] == " " else core
        if not word.isalpha() or _PLAIN.search(word):
            return None
        ids = [t.id for t in self.model.tokenize(core.encode().decode("latin-1").translate(_LETTERS))]
        end = text[len(core) :]
        if end:
            if end not in self.stops:
                self.stops[end] = self.tokenizer.encode(end, add_special_tokens=False).ids
            ids += self.stops[end]
        return self.value(ids)

    def parts(self, texts: list[str]) -> list[list]:
        """Per text, the values of its pieces in order."""
        if len(self.known) > MEMORY:
            self.known.clear()
        get, new = self.known.__getitem__, self.known.new
        out, again = [], []
        for k, t in enumerate(texts):
            keys = None if any(s in t for s in self.special) else self.pieces(t)
            before = len(new)
            out.append(self._encode([t]) if keys is None else list(map(get, keys)))
            if keys is not None and (len(new) > before or None in out[-1]):
                again.append((k, keys))
        asked = []
        for x in new:
            value = self._plain_word(self.spell(x))
            if value is None:
                asked.append(x)
            else:
                self.known[x] = value
        for k in range(0, len(asked), 20_000):
            part = asked[k : k + 20_000]
            self.known.update(zip(part, self._encode([self.spell(x) for x in part])))
        new.clear()
        for k, keys in again:
            out[k] = list(map(get, keys))
        return out


#: Outside these characters Unicode tables of different libraries could differ: such texts are encoded whole.
_PLAIN = re.compile("[^\t\n\x0b\x0c\r\x20-\x7e\xa1-įı-ɏ]")


def lower_words(text: str) -> list[str] | None:
    """Pieces for a tokenizer that lowers the case and drops white space."""
    return None if _PLAIN.search(text) else text.lower().split()


_COUNTERS: dict[str, Memo] = {}
_RANKED: dict[str, object] = {}


def count_tokens(name: str, texts: list[str]) -> list[int]:
    """Token counts by a tokenizer that lowers the case and drops white space."""
    if name not in _COUNTERS:
        _COUNTERS[name] = Memo(name, lower_words, str, len)
    return [sum(p) for p in _COUNTERS[name].parts(texts)]


def ranked(name: str):
    """The encoder of the rank file beside a byte-level .json file, whose ids are the same."""
    if name not in _RANKED:
        import tiktoken

        with open(public_tokenizers.path(name.removesuffix(".json") + ".tiktoken"), "rb") as f:
            ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}
        special = {t.content: i for i, t in load(name).get_added_tokens_decoder().items()}
        _RANKED[name] = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return _RANKED[name]


def byte_level_ids(name: str, texts: list[str]) -> list[bytes]:
    """Ids by a byte-level tokenizer, as little-endian unsigned 32-bit integers.

    The rank file's encoder gives the library's ids (a test holds it to that) in less time. Where it
    gives up, as on a very long run of white space, the library itself is asked.
    """
    encoder, out = ranked(name), []
    for t in texts:
        try:
            ids = encoder.encode_to_numpy(t, allowed_special="all")
        except ValueError:
            ids = np.array(load(name).encode(t, add_special_tokens=False).ids)
        out.append(ids.astype("<u4").tobytes())
    return out
