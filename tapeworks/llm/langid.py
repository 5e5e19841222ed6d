"""Language identification by unigram models over a fixed public vocabulary, summed over all segmentations.

A word (a run of letters and their marks, lower-cased) has a probability in a language: the sum, over every way to cut it into
pieces of the vocabulary, of the product of the pieces' probabilities, by a forward pass over its characters, however many. A
text's log-likelihood is the sum over its words. The pieces' probabilities are fitted by expectation-maximisation with the same
sums (forward and backward), on counts of words by language that Spark takes over all training rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_table, quoted
from .tokens import steps, vocabulary

#: Longer words, and those of a smaller probability, are summed in logarithms; in others plain products lose nothing that counts.
SHORT = 40
LEAST = 1e-200
#: Characters whose sums are taken at once.
STEP = 100_000
#: Bytes of texts whose words are counted or scored at once.
BYTES = 1_000_000


class Pieces:
    """The vocabulary as a trie in arrays: (state, character) -> state, and a state's piece. Transitions lie in hash tables, one
    more for those that share a slot in the one before."""

    def __init__(self, path: str):
        import sentencepiece as sp

        m = sp.SentencePieceProcessor(model_file=vocabulary(path))
        texts = [m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))]
        self.n = len(texts)  # piece n stands for a character outside the vocabulary
        codes = {c: i + 1 for i, c in enumerate(sorted({c for t in texts for c in t}))}
        self.codes = np.zeros(0x110000, np.int32)
        self.codes[[ord(c) for c in codes]] = list(codes.values())
        states, piece = {}, [-1]
        for p, t in enumerate(texts):
            at = 0
            for c in t:
                key = (at << 16) | codes[c]
                if key not in states:
                    states[key] = len(piece)
                    piece.append(-1)
                at = states[key]
            piece[at] = p
        self.piece = np.array(piece, np.int64)
        keys, to = np.fromiter(states, np.int64, len(states)), np.fromiter(states.values(), np.int64, len(states))
        self.tables: list[tuple[int, np.ndarray, np.ndarray]] = []  # the slots' bits, keys and next states
        while len(keys):
            bits = max(8, (4 * len(keys)).bit_length())
            slot, first = np.unique(self._slot(keys, bits), return_index=True)
            held, nxt = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
            held[slot], nxt[slot] = keys[first], to[first]
            self.tables.append((bits, held, nxt))
            keys, to = np.delete(keys, first), np.delete(to, first)

    @staticmethod
    def _slot(key: np.ndarray, bits: int) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * bits)) >> np.uint64(64 - bits)).astype(np.int64)

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """-1: no way on."""
        key, left = (state << 16) | code, None
        out = np.full(len(key), -1, np.int64)
        for bits, held, nxt in self.tables:
            mine = key if left is None else key[left]
            slot = self._slot(mine, bits)
            there = held[slot]
            same = there == mine
            out[np.flatnonzero(same) if left is None else left[same]] = nxt[slot[same]]
            more = ~same & (there >= 0)  # another key's slot: this one is in a later table, if anywhere
            left = np.flatnonzero(more) if left is None else left[more]
            if not len(left):
                break
        return out

    def _parts(self, words: list[str]) -> Iterator[tuple[np.ndarray, bool]]:
        """Numbers of words to sum at once, and whether in logarithms."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        for mine, logs in ((np.flatnonzero(size <= SHORT), False), (np.flatnonzero(size > SHORT), True)):
            part = np.cumsum(size[mine] + 2) // STEP
            for cut in np.split(mine, np.flatnonzero(np.diff(part)) + 1):
                if len(cut):
                    yield cut, logs

    def log_likelihood(self, words: list[str], prob: np.ndarray) -> np.ndarray:
        """words x languages."""
        out = np.zeros((len(words), prob.shape[1]))
        for rows, logs in self._parts(words):
            own = Lattice(self, [words[r] for r in rows.tolist()])
            if not logs:
                total = own.forward(prob)[own.ends]
                tiny = (total < LEAST).any(1)
                out[rows] = np.log(np.where(tiny[:, None], 1, total))
                rows = rows[tiny]
                if not len(rows):
                    continue
                own = Lattice(self, [words[r] for r in rows.tolist()])
            out[rows] = own.log_forward(np.log(prob))[own.ends]
        return out

    def expected(self, words: list[str], counts: np.ndarray, prob: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in `counts` of each word, under one language's prob."""
        out = np.zeros(len(prob))
        prob = prob[:, None]
        for rows, logs in self._parts(words):
            own = Lattice(self, [words[r] for r in rows.tolist()])
            if not logs:
                alpha = own.forward(prob)
                tiny = alpha[own.ends, 0] < LEAST
                scale = np.where(tiny, 0, counts[rows] / np.where(tiny, 1, alpha[own.ends, 0]))
                uses = alpha[own.a, 0] * prob[own.p, 0] * own.backward(prob)[own.b, 0] * np.repeat(scale, own.sizes)[own.a]
                out += np.bincount(own.p, uses, len(out))
                rows = rows[tiny]
                if not len(rows):
                    continue
                own = Lattice(self, [words[r] for r in rows.tolist()])
            log_prob = np.log(prob)
            alpha, beta = own.log_forward(log_prob)[:, 0], own.log_backward(log_prob)[:, 0]
            total = np.repeat(alpha[own.ends] - np.log(counts[rows]), own.sizes)
            out += np.bincount(own.p, np.exp(alpha[own.a] + log_prob[own.p, 0] + beta[own.b] - total[own.a]), len(out))
        return out


class Lattice:
    """All pieces in some words, written one after the other with a mark before and a gap after each: piece p from a to b."""

    def __init__(self, pieces: Pieces, words: list[str]):
        chars = np.frombuffer(("▁" + "\n▁".join(words) + "\n").encode("utf-32-le"), "<u4")
        codes = np.append(pieces.codes[chars], np.zeros(1, np.int64))
        gap = chars == 10
        self.ends = np.flatnonzero(gap)
        self.sizes = np.diff(self.ends, prepend=-1)
        self.starts = self.ends - self.sizes + 1
        place = np.arange(len(chars)) - np.repeat(self.starts, self.sizes)
        a, at = [], np.flatnonzero(~gap)
        b, p, state, n = [], [], np.zeros(len(at), np.int64), 0
        single = gap.copy()
        while len(at):
            state = pieces.step(state, codes[at + n])
            alive = state >= 0
            at, state, n = at[alive], state[alive], n + 1
            own = pieces.piece[state]
            found = own >= 0
            a.append(at[found])
            b.append(at[found] + n)
            p.append(own[found])
            if n == 1:
                single[a[0]] = True
        lost = np.flatnonzero(~single)  # characters that are no piece
        a, b, p = np.concatenate([*a, lost]), np.concatenate([*b, lost + 1]), np.concatenate([*p, np.full(len(lost), pieces.n)])
        order = np.argsort(place[a], kind="stable")
        self.a, self.b, self.p, self.length = a[order], b[order], p[order], len(chars)
        self.rising = np.append(0, np.cumsum(np.bincount(place[self.a])))
        last = place[self.b - 1]
        self.by_end = np.argsort(last, kind="stable")
        self.falling = np.append(0, np.cumsum(np.bincount(last)))

    def _levels(self, back: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pieces with one start (or end) in their words, each word's by turns: none of a level leads to the same place."""
        if back:
            for lo, hi in zip(self.falling[-2::-1], self.falling[:0:-1]):
                k = self.by_end[lo:hi]
                yield self.b[k], self.a[k], self.p[k]
        else:
            for lo, hi in zip(self.rising, self.rising[1:]):
                yield self.a[lo:hi], self.b[lo:hi], self.p[lo:hi]

    def _sums(self, prob: np.ndarray, back: bool) -> np.ndarray:
        out = np.zeros((self.length, prob.shape[1]))
        out[self.ends if back else self.starts] = 1
        for a, b, p in self._levels(back):
            out[b] += out[a] * prob[p]
        return out

    def _log_sums(self, log_prob: np.ndarray, back: bool) -> np.ndarray:
        out = np.full((self.length, log_prob.shape[1]), -np.inf)
        out[self.ends if back else self.starts] = 0
        for a, b, p in self._levels(back):
            out[b] = np.logaddexp(out[b], out[a] + log_prob[p])
        return out

    def forward(self, prob: np.ndarray) -> np.ndarray:
        """Sums over all ways from each word's start to each place; at `ends` those of the whole words."""
        return self._sums(prob, False)

    def backward(self, prob: np.ndarray) -> np.ndarray:
        return self._sums(prob, True)

    def log_forward(self, log_prob: np.ndarray) -> np.ndarray:
        return self._log_sums(log_prob, False)

    def log_backward(self, log_prob: np.ndarray) -> np.ndarray:
        return self._log_sums(log_prob, True)


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def coded_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Different words of some texts, the number of each word in order, and where each text's words begin and end. A word of
    no characters may stand before or after the others."""
    lower = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    split = pc.split_pattern(pc.replace_substring_regex(lower, r"[^\pL\pM]+", " "), " ")
    coded = split.flatten().dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), split.offsets.to_numpy()


class Model:
    """Languages and their pieces' probabilities."""

    def __init__(self, path: str, langs: list[str], prob: np.ndarray):
        self.path, self.langs, self.prob = path, langs, prob


def train(rows: DataFrame, path: str = "piece_bpe_32k.model", text_col: str = "text", lang_col: str = "lang", rounds: int = 2, smooth: float = 0.1) -> Model:
    """Fits a model on all rows with a language. The driver gets a row for each language and piece of the vocabulary, no more.

    Null texts and texts without letters teach nothing; rows of equal text count as often as they stand there. Without rows, or
    without words in them, the model knows no language.
    """

    def count(batches):
        for batch in batches:
            for some in steps(batch["text"], BYTES):
                b = batch.slice(some.start, some.stop - some.start)
                words, code, at = coded_words(b["text"])
                langs = b["lang"].dictionary_encode()
                pair = code.astype(np.int64) * len(langs.dictionary) + np.repeat(langs.indices.to_numpy(), np.diff(at))
                pair, n = np.unique(pair, return_counts=True)
                word, lang = np.divmod(pair, max(1, len(langs.dictionary)))
                out = pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(lang)), pa.array(words, pa.string()).take(pa.array(word)), pa.array(n)], ["lang", "word", "n"])
                yield out.filter(pc.not_equal(out["word"], ""))

    rows = rows.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    table = as_table(rows.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    langs = [r[0] for r in table.select("lang").distinct().orderBy("lang").collect()]
    size = pieces(path).n + 1
    prob = np.full((size, len(langs)), 1.0 / size)
    for _ in range(rounds if langs else 0):
        now = prob

        def expect(batches, now=now):
            total, held, rows = np.zeros((size, len(langs))), [], 0

            def take():
                t = pa.Table.from_batches(held).combine_chunks()
                for k, lang in enumerate(langs):
                    own = t.filter(pc.equal(t["lang"], lang))
                    total[:, k] += pieces(path).expected(own["word"].to_pylist(), own["n"].to_numpy().astype(float), now[:, k])

            for b in batches:
                held.append(b)
                rows += b.num_rows
                if rows >= 30_000:
                    take()
                    held, rows = [], 0
            if rows:
                take()
            p, k = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(k), pa.array(total[p, k])], ["p", "k", "n"])

        got = table.mapInArrow(expect, "p long, k long, n double").groupBy("p", "k").agg(F.sum("n").alias("n")).toArrow()
        counts = np.zeros((size, len(langs)))
        counts[got["p"].to_numpy(), got["k"].to_numpy()] = got["n"].to_numpy()
        prob = (counts + smooth) / (counts.sum(0) + smooth * size)
    return Model(path, langs, prob)


class Scores:
    """Log-likelihoods of the words that a task has met; `most` at once and those of one step."""

    def __init__(self, most: int = 100_000):
        self.most, self.known, self.table = most, {}, None

    def of(self, words: list[str], path: str, prob: np.ndarray) -> np.ndarray:
        if self.table is None or len(self.known) > self.most:
            self.known, self.table = {"": 0}, np.zeros((1, prob.shape[1]))
        new = [w for w in words if w not in self.known]
        if new:
            self.known.update(zip(new, range(len(self.table), len(self.table) + len(new))))
            self.table = np.concatenate([self.table, pieces(path).log_likelihood(new, prob)])
        return self.table[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))]


def predict(docs: DataFrame, model: Model, keep: list[str] | None = None, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs (columns `keep`) with lang_pred and score, the language's posterior under equal priors.

    Null texts and texts without a letter are `und` with score 0, as is every text if the model knows no language. Ties go to
    the first language by code point. Rows of equal text have equal results, an empty table has none. Columns of docs that are
    called as the new ones (`names`) are replaced.
    """
    path, langs, prob = model.path, model.langs, model.prob
    inner = docs.select(F.struct(*quoted([c for c in keep or docs.columns if c not in names])).alias("__row"), F.col(text_col).alias("__text"))

    def score(batches):
        scores = Scores()
        for batch in batches:
            for some in steps(batch["__text"], BYTES):
                b = batch.slice(some.start, some.stop - some.start)
                best, top = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows)
                there = pc.fill_null(pc.match_substring_regex(b["__text"], r"\pL"), False).to_numpy(zero_copy_only=False) & bool(langs)
                if there.any():
                    words, code, at = coded_words(b["__text"])
                    table = scores.of(words, path, prob)
                    total = np.stack([np.add.reduceat(table[:, k][code], at[:-1]) for k in range(len(langs))], axis=1)
                    best = total.argmax(1)
                    top = 1 / np.exp(total - total[np.arange(len(total)), best][:, None]).sum(1)
                preds = pa.array(["und", *langs]).take(pa.array(np.where(there, best + 1, 0)))
                out = b.drop_columns(["__text"])
                yield pa.RecordBatch.from_arrays([*out.columns, preds, pa.array(np.where(there, top, 0.0))], names=["__row", *names])

    schema = inner.drop("__text").schema.add(names[0], "string").add(names[1], "double")
    return inner.mapInArrow(score, schema).select("__row.*", *names)


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0
