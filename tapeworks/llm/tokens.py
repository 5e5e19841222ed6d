"""Encoding whole texts with a public tokenizer, fast on repeated words."""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs the tasks side by side

#: A text may be cut at a single space between two visible ASCII or Latin characters: no token of the supported tokenizers
#: reaches across it other than by taking the space as its first character.
VISIBLE = "!-~¡-ɏ"
SPLIT = re.compile(f"(?<=[{VISIBLE}]) (?=[{VISIBLE}])")
#: Keys of pieces that may be cut off at the spaces around them.
PLAIN = f"^(?:[\0\1]?[{VISIBLE}](?:(?s:.*)[{VISIBLE}])?|\1\n)$"
#: Longer pieces are not kept.
LONGEST = 64
#: Within a piece it may be cut between a letter and a sign, and around a single line feed; what follows has no space before it.
#: İ is no such letter: lower-cased, it ends with a combining mark, which joins the sign.
LETTER = "A-Za-zÀ-ÖØ-öø-įı-ɏ"
INNER = re.compile(f"(?<=[{LETTER}])(?=[!-/:-@\\[-`{{-~])|(?<=[{VISIBLE}])(?=\n[{VISIBLE}])|(?<=[{VISIBLE}]\n)(?=[{VISIBLE}])")
#: Bytes of texts that are encoded at once.
STEP = 3_000_000


def vocabulary(name: str) -> str:
    """Path of a public tokenizer file; a path is returned as it is."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def steps(texts: pa.Array, most: int) -> Iterator[slice]:
    """Slices of some texts with about `most` bytes each, one text at least."""
    size, at = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)), 0
    while at < len(size):
        upto = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
        yield slice(at, upto)
        at = upto


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes, equal to those of Tokenizer.encode(text, add_special_tokens=False).

    The ids of pieces are kept, `most` new ones and as many older ones, so that pieces in use stay when room is made. A piece's
    key is the piece, with 0 before it at a text's start and 1 after another piece without a space. New pieces are encoded many
    at once, with a special token between them. Texts that hold a special token's string are encoded whole.
    """

    def __init__(self, path: str, end_id: int | None = None, most: int = 300_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary(path))
        self.end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        self.width = 2 if max(self.tokenizer.get_vocab_size(), (end_id or 0) + 1) <= 1 << 16 else 4  # bytes that an id needs
        self.most, self.known, self.older = most, {}, {}
        self.lowers = "Lowercase" in str(self.tokenizer.normalizer)
        self.lead = "" if self.lowers else " "  # white space is dropped by the lower-casing tokenizer
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = [t.content for t in added.values()]
        self.between = next(((i, t.content) for i, t in added.items() if not (t.lstrip or t.rstrip or t.single_word or t.normalized)), None)
        #: a word of letters alone has one token that starts with the space before it, or one that ends a word
        ends = (lambda t: t.endswith("</w>")) if self.lowers else (lambda t: t.startswith("Ġ"))
        self.bound = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.bound[[i for t, i in self.tokenizer.get_vocab().items() if ends(t)]] = True

    def _prepared(self, text: str) -> str:
        if self.lowers:
            low = text.lower()
            try:
                text.encode("latin-1")
                return low  # composed, as are all Latin-1 texts and their lower case
            except UnicodeEncodeError:
                pass
            if not ("Σ" in text or "İ" in text) and unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", low):
                return low
        return text

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters, each after a space: encoded in one text."""
        ids = np.array(self.tokenizer.encode_batch_fast([self.lead + " ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        at, raw = (4 * np.flatnonzero(self.bound[ids])).tolist(), ids.tobytes()
        if len(at) != len(words):
            return self._many(words)
        return [raw[a:b] for a, b in zip([0, *(x + 4 for x in at)], (x + 4 for x in at))] if self.lowers else [raw[a:b] for a, b in zip(at, [*at[1:], len(raw)])]

    def _many(self, keys: list[str]) -> list[bytes]:
        """Ids of pieces by their keys: encoded in one text, with a special token between them."""
        texts = [k[1:] if k[0] in "\0\1" else self.lead + k for k in keys]
        if self.between is None:
            return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.array(self.tokenizer.encode_batch_fast([self.between[1].join(texts)], add_special_tokens=False)[0].ids, "<u4")
        ends, raw = (4 * np.flatnonzero(ids == self.between[0])).tolist(), ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *(e + 4 for e in ends)], [*ends, len(raw)])]

    def _recall(self, keys: set[str]) -> set[str]:
        """Takes over what older pieces have of the keys, and returns the others."""
        if not self.older:
            return keys
        back = {k: self.older[k] for k in keys if k in self.older}
        self.known.update(back)
        return keys.difference(back)

    def _learn(self, keys: list[str]) -> list[bytes]:
        """Ids of pieces by their keys; short ones are kept."""
        if len(self.known) > self.most:
            self.known, self.older = {}, self.known
        ids = list(map(self.known.get, keys))
        missing = [n for n, v in enumerate(ids) if v is None]
        if not missing:
            return ids
        new = self._recall({keys[n] for n in missing})
        parts = {k: [p if not n else "\1" + p for n, p in enumerate(INNER.split(k))] for k in new if not k.isalpha()}
        small = self._recall({p for ps in parts.values() for p in ps if p not in self.known})
        small = [*(k for k in new if k not in parts), *small]
        words = [k for k in small if k.isalpha() and "İ" not in k]
        found, rest = {}, list(set(small).difference(words))
        for encoded, part in ((self._words, words), (self._many, rest)):
            for at in range(0, len(part), 1000):
                found.update(zip(part[at : at + 1000], encoded(part[at : at + 1000])))
        get = lambda p: found[p] if p in found else self.known[p]
        found |= {k: b"".join(map(get, ps)) for k, ps in parts.items() if len(ps) > 1}
        self.known.update((k, v) for k, v in found.items() if len(k) <= LONGEST and k[-1] > " ")
        for n in missing:
            ids[n] = get(keys[n])
        return ids

    def _step(self, texts: list[str]) -> list[bytes]:
        plain = [self._prepared(t) for t in texts]
        whole = {n for n, (t, p) in enumerate(zip(texts, plain)) if any(x in p or x in t for x in self.special) or "\0" in t or "\1" in t}
        marked = pa.array(["\0" if n in whole else "\0" + p for n, p in enumerate(plain)], pa.large_string())
        marked = pc.replace_substring_regex(marked, f"([{VISIBLE}])\n([{VISIBLE}])", "\\1 \1\n \1\\2")
        marked = pc.replace_substring_regex(marked, f"([{LETTER}])([.,]) ", "\\1 \1\\2 ")
        split = pc.split_pattern(marked, " ")
        coded = split.flatten().dictionary_encode()
        code, keys, at = coded.indices.to_numpy(), coded.dictionary.to_pylist(), split.offsets.to_numpy()
        odd = ~pc.match_substring_regex(coded.dictionary, PLAIN).to_numpy(zero_copy_only=False)
        ids = [b""] * len(keys)
        if len(fit := np.flatnonzero(~odd)):
            for k, v in zip(fit.tolist(), self._learn([keys[k] for k in fit.tolist()])):
                ids[k] = v
        ids.append(self.end)
        n = np.diff(at)
        code = np.insert(code, at[1:], len(keys))  # the end of each text
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        starts, size = np.cumsum(sizes) - sizes, sizes[code]
        upto = np.cumsum(size)
        raw = np.frombuffer(b"".join(ids), "<u4")[np.arange(upto[-1]) + np.repeat(starts[code] - upto + size, size)].tobytes()
        ends = [0, *(4 * upto[np.cumsum(n + 1) - 1]).tolist()]
        out = [raw[a:b] for a, b in zip(ends, ends[1:])]
        for k in whole:
            out[k] = np.array(self.tokenizer.encode(texts[k], add_special_tokens=False).ids, "<u4").tobytes() + self.end
        if odd.any():  # not every space is a place to cut these texts at
            for k in np.unique(np.searchsorted(at, np.flatnonzero(odd[coded.indices.to_numpy()]), "right") - 1).tolist():
                if k not in whole:
                    first, *rest = SPLIT.split(plain[k])
                    out[k] = b"".join([*self._learn(["\0" + first, *rest]), self.end])
        return out

    def stepwise(self, texts: pa.Array) -> Iterator[tuple[slice, list[bytes]]]:
        """Ids of some texts after the other, about STEP bytes at once."""
        for some in steps(texts, STEP):
            yield some, self._step([t or "" for t in texts[some].to_pylist()])
            pa.default_memory_pool().release_unused()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        return [ids for _, some in self.stepwise(pa.array(texts, pa.large_string())) for ids in some]


@lru_cache(maxsize=4)
def encoder(path: str, end_id: int | None = None, most: int = 300_000) -> Encoder:
    """One encoder for each Python worker, which keeps some 250 bytes for each of up to twice `most` pieces."""
    return Encoder(path, end_id, most)
