"""Toxicity by noisy-channel deobfuscation.

A character trigram model is counted over the plain words of all documents. Words that may be written in disguise (digits and
symbols for letters, letters repeated, letters apart) become lattices of what each character may stand for; the Viterbi path
under the channel's costs and the character model restores them. A noisy-or over restored words and beginnings of
words, counted by the contexts they stand in in a bounded sample of labelled rows, scores each text by the distinct ones it holds.
How many different restored words a text must hold is learned from the same rows: a beginning may be shared by clean words, of
which a clean text holds one, where a toxic one holds several.

Plain words have one path and are taken as they are; if letters are doubled or a symbol stands at the edge, what the lattice makes
of them is read too. Words of any length have one lattice. Null texts are empty and get the model's base rate. Repeated rows score
alike; of features of equal weight the first counts. Other columns are not used.
A document with several labels counts for each. Without labels of both kinds every text scores the share of toxic labels (0.5 if there are none).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import batch as B
from . import exchange as X

#: What characters may stand for: fixed values.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c"}
#: Characters that may stand between letters for nothing, or part two words.
GAPS = " .-_*'~,:;/\\#%&=^`\""
#: Natural logarithms of the channel's probabilities: a letter for another character, a character as it is, a character for nothing, a gap for nothing, a gap between words, a repeated character for nothing, and one of just two.
SWAP, SELF, DROP, SKIP, PART, AGAIN, TWICE = -1.5, -6.0, -9.0, -1.0, -2.0, -1.5, -5.0

SAMPLE, PRECISION, SURE = 20_000, 0.4, 0.6
#: Bytes of the beginnings of words that count beside whole words.
STEMS = range(4, 9)
#: From so many different words on, their number doesn't count.
MANY = 4
SIZE = 28  # 0: a word's edge, 1-26: a-z, 27: any other letter
SCORED = "doc_id long, score double, predicted int"

_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LETTER = _ALNUM.copy()
_LETTER[48:58] = False
_ASCII = np.zeros(256, bool)
_ASCII[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[[ord("@"), ord("$")]] = True
#: Symbols that may stand for a letter; at a word's edge they are more often marks, so such a word is also read without them.
_EDGE = np.zeros(256, bool)
_EDGE[[ord(c) for c in "!|+(<"]] = True
_CODE = np.full(256, 27, np.int64)
_CODE[97:123] = np.arange(1, 27)
_STANDS = np.zeros(256, bool)
_STANDS[[ord(c) for c in LEET]] = True
_KEPT = 30_000
_SYMBOLS = 8192  # of words restored at once: each needs SIZE ** 2 bytes
_STRETCH = 4096  # characters of a long word whose way back is held at once


class Lexed:
    """Words of a batch of texts, lower-cased: distinct ones with their cores (without marks around them) and kinds."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        low = B.LOWER[data]
        if len(low):  # capitals of Latin-1
            wide = np.flatnonzero(low[:-1] == 0xC3) + 1
            up = wide[(low[wide] < 0x9F) & (low[wide] != 0x97)]
            low[up] |= 0x20
        self.starts, self.ends, self.by = B.words(low, offsets, B.SPACE)
        self.data = low
        self.codes, values = B.encode(B.binary(low, self.starts, self.ends))
        d, o = B.flat(values)
        n = len(values)
        self.d = d
        if not n:
            self.first = self.last = self.head = self.tail = np.zeros(0, np.int64)
            self.plain = self.odd = self.twice = self.edged = np.zeros(0, bool)
            return
        same = np.zeros(len(d), bool)
        same[1:] = d[1:] == d[:-1]
        same[o[:-1]] = False
        third = same.copy()
        third[1:] &= same[:-1]
        third[0] = False
        run = third.copy()  # all members of runs of three or more
        run[:-1] |= third[1:]
        run[:-2] |= third[2:]
        keep = _ALNUM[d] | (_MARK[d] & ~run)
        at = np.arange(len(d))
        self.first = np.minimum.reduceat(np.where(keep, at, len(d)), o[:-1])
        self.last = np.maximum.reduceat(np.where(keep, at, -1), o[:-1]) + 1
        empty = self.last == 0
        self.first[empty] = self.last[empty] = o[:-1][empty]
        total = lambda x: (c := np.concatenate([[0], np.cumsum(x)]))[self.last] - c[self.first]
        letters = total(_ASCII[d])
        self.plain = ~empty & (total(~_LETTER[d] | (third & _ASCII[d])) == 0)
        self.odd = ~empty & ~self.plain & ((letters > 0) | ((total(~_STANDS[d]) == 0) & (self.last - self.first > 2)))
        self.twice = self.plain & (total(same & _ASCII[d]) > 0)
        # one symbol right before the core, and one right after it
        self.head = self.first - ((self.first > o[:-1]) & _EDGE[d[np.maximum(self.first - 1, 0)]] & ~empty)
        self.tail = self.last + ((self.last < o[1:]) & _EDGE[d[np.minimum(self.last, len(d) - 1)]] & ~empty)
        self.edged = (self.head < self.first) | (self.tail > self.last)

    def prefixes(self, n: int) -> np.ndarray:
        """The plain distinct words that go on after n bytes, where a character ends."""
        long = np.flatnonzero(self.plain & (self.last - self.first > n))
        return long[(self.d[self.first[long] + n] & 0xC0) != 0x80]

    def core(self, i: int) -> bytes:
        return self.d[self.first[i] : self.last[i]].tobytes()

    def with_edges(self, i: int) -> bytes:
        return self.d[self.head[i] : self.tail[i]].tobytes()

    def spaced(self) -> Iterator[tuple[int, int, int]]:
        """(text, first word, last word + 1) of runs of three or more words of one character."""
        one = (self.ends - self.starts == 1) & (_ALNUM | _STANDS)[self.data[self.starts]]
        edge = np.zeros(len(one) + 1, bool)
        edge[self.by] = True
        new = one & (edge[:-1] | ~np.concatenate([[False], one[:-1]]))
        stop = one & (edge[1:] | ~np.concatenate([one[1:], [False]]))
        a, z = np.flatnonzero(new), np.flatnonzero(stop) + 1
        ok = z - a >= 3
        a, z = a[ok], z[ok]
        yield from zip((np.searchsorted(self.by, a, side="right") - 1).tolist(), a.tolist(), z.tolist(), strict=True)


def trigrams(x: Lexed) -> np.ndarray:
    """Counts of three characters in a row in plain words, by occurrence; words have edges before and after."""
    pick = np.flatnonzero(x.plain)
    lens = (x.last - x.first)[pick]
    d, offs = B.gather(x.d, x.first[pick], lens)
    # two edges before and one after each word
    code = np.zeros(len(d) + 3 * len(lens), np.int64)
    code[np.arange(len(d)) + np.repeat(3 * np.arange(len(lens)) + 2, lens)] = _CODE[d]
    owner = np.repeat(np.arange(len(lens)), lens + 3)
    inner = np.ones(len(code), bool)
    heads = offs[:-1] + 3 * np.arange(len(lens))
    inner[heads] = inner[heads + 1] = False
    at = np.flatnonzero(inner)
    weight = np.bincount(x.codes, minlength=len(x.first))[pick]
    return np.bincount((code[at - 2] * SIZE + code[at - 1]) * SIZE + code[at], weights=weight[owner[at]], minlength=SIZE**3)


def language_model(counts: np.ndarray) -> np.ndarray:
    """log P(third | first two), interpolated with the shorter contexts."""
    c3 = counts.reshape(SIZE, SIZE, SIZE)
    c2, c1 = c3.sum(axis=0), c3.sum(axis=(0, 1))
    p = (c1 + 1) / (c1.sum() + SIZE)
    for c in (c2, c3):
        kinds = (c > 0).sum(axis=-1, keepdims=True)
        p = (c + kinds * p) / np.maximum(c.sum(axis=-1, keepdims=True) + kinds, 1) + np.where(kinds == 0, p, 0)
    return np.log(np.maximum(p, 1e-12)).astype(np.float32)


class Channel:
    """Viterbi restoration of disguised words, many at a time."""

    def __init__(self, model: np.ndarray):
        self.model = model
        self.by_last = np.ascontiguousarray(model.transpose(2, 0, 1))  # [c][a][b]
        self.kept: dict[bytes, list[bytes]] = {}

    @staticmethod
    def options(ch: str) -> tuple[list[tuple[int, float, str]], float]:
        """(code, cost, character) for what may be written as ch, and the cost of nothing."""
        if "a" <= ch <= "z":
            return [(ord(ch) - 96, 0.0, ch)], DROP
        if ch in GAPS:
            return [(0, PART, " ")], SKIP
        if ch in LEET:
            return [*((ord(c) - 96, SWAP, c) for c in LEET[ch]), (27, SELF, ch)], DROP
        return [(27, 0.0 if ch.isalpha() else SELF / 2, ch)], DROP

    @staticmethod
    def again(word: str, t: int) -> float:
        """The cost of nothing for a character that repeats the one before it."""
        c = word[t]
        if not t or word[t - 1] != c:
            return -np.inf
        return AGAIN if word[t + 1 : t + 2] == c or word[t - 2 : t - 1] == c else TWICE

    def restore(self, words: list[bytes]) -> list[list[bytes]]:
        new = list(dict.fromkeys(w for w in words if w not in self.kept))
        if len(self.kept) + len(new) > _KEPT:  # bounds memory
            self.kept.clear()
            new = list(dict.fromkeys(words))
        new.sort(key=len)
        i = 0
        while i < len(new):
            n = 1
            while i + n < len(new) and (n + 1) * len(new[i + n]) <= _SYMBOLS:  # by length, so the last is the longest
                n += 1
            part, i = new[i : i + n], i + n
            for w, r in zip(part, self._viterbi([w.decode("utf-8", "replace") for w in part]), strict=True):
                self.kept[w] = [x.encode() for x in r.split()]
        return [self.kept[w] for w in words]

    def _viterbi(self, words: list[str]) -> list[str]:
        """The best path of each word. Words over _STRETCH characters keep the lattice's state before each stretch, and trace back stretch by stretch."""
        n, long = len(words), max(map(len, words))
        if long > _STRETCH and n > 1:
            return [self._viterbi([w])[0] for w in words]
        s = np.full((n, SIZE, SIZE), -np.inf, np.float32)
        s[:, 0, 0] = 0
        starts = list(range(0, long, _STRETCH)) or [0]
        states, last = [], None
        for lo in starts:
            states.append(s)
            s, *last = self._forward(words, s, lo, min(lo + _STRETCH, long))
        flat = (s + self.model[:, :, 0]).reshape(n, -1).argmax(axis=1)
        at = [divmod(int(x), SIZE) for x in flat]
        said: list[list[str]] = [[] for _ in words]
        for k in range(len(starts) - 1, -1, -1):
            lo = starts[k]
            backs, chars = last if k == len(starts) - 1 else self._forward(words, states[k], lo, lo + _STRETCH)[1:]
            for i, w in enumerate(words):
                a, b = at[i]
                for t in range(min(len(w), lo + _STRETCH) - 1, lo - 1, -1):
                    was = int(backs[t - lo][i, a, b])
                    if was >= 0:
                        said[i].append(chars[t - lo][i][b])
                        a, b = was, a
                at[i] = a, b
        return ["".join(reversed(x)) for x in said]

    def _forward(self, words: list[str], s: np.ndarray, lo: int, hi: int):
        """The lattices' states after characters lo to hi, and the way back and the characters at each."""
        n = len(words)
        backs: list[np.ndarray] = []
        chars: list[list[dict]] = []
        for t in range(lo, hi):
            live = np.fromiter((len(w) > t for w in words), bool, n)
            opts = [self.options(w[t]) if len(w) > t else ([], 0.0) for w in words]
            stay = np.zeros(n, np.float32)
            for i, w in enumerate(words):
                if len(w) > t:
                    stay[i] = max(opts[i][1], self.again(w, t))
            new = s + stay[:, None, None]
            back = np.full((n, SIZE, SIZE), -1, np.int8)
            for k in range(max((len(o) for o, _ in opts), default=0)):
                own = np.fromiter((i for i, (o, _) in enumerate(opts) if len(o) > k), np.int64)
                c = np.fromiter((opts[i][0][k][0] for i in own), np.int64, len(own))
                cost = np.fromiter((opts[i][0][k][1] for i in own), np.float32, len(own))
                move = s[own] + self.by_last[c]
                best = move.argmax(axis=1)
                value = np.take_along_axis(move, best[:, None], axis=1)[:, 0] + cost[:, None]
                now = new[own, :, c]
                better = value > now
                new[own, :, c] = np.where(better, value, now)
                back[own, :, c] = np.where(better, best, back[own, :, c])
            s = np.where(live[:, None, None], new, s)
            backs.append(back)
            chars.append([{c: ch for c, _, ch in o} for o, _ in opts])
        return s, backs, chars


def _parts(batches, column: int):
    for x in batches:
        sizes = np.asarray(pc.binary_length(x.column(column)).fill_null(0)).astype(np.int64)
        at = X.cuts(sizes, X.CHUNK_BYTES)
        for lo, hi in zip(at[:-1], at[1:], strict=True):
            yield x.slice(lo, hi - lo)
            B.trim()


def count_characters(docs: DataFrame, text: str = "text") -> np.ndarray:
    """The trigram counts of all documents: at most SIZE ** 3 numbers a task, added up by trigram."""

    def run(batches):
        total = np.zeros(SIZE**3)
        for part in _parts(batches, 0):
            total += trigrams(Lexed(*B.flat(part.column(0))))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at].astype(np.int64))], ["g", "n"])

    rows = docs.selectExpr(f"cast(`{text}` as string) as text").mapInArrow(run, "g int, n long").groupBy("g").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SIZE**3)
    out[rows["g"].to_numpy()] = rows["n"].to_numpy()
    return out


def undoubled(word: bytes) -> bytes:
    """The word with each run of one byte as one."""
    return bytes(c for i, c in enumerate(word) if not i or word[i - 1] != c)


class Undoubled:
    """Which words with doubled letters may restore to one of some features: without doubling they begin with one, or are one, without doubling."""

    def __init__(self, words: list[bytes]):
        self.by_length: dict[int, list[bytes]] = {}
        for w in words:
            stem = w[-1:] == b"*"
            own = undoubled(w[:-1] if stem else w)
            self.by_length.setdefault(len(own) if stem else 0, []).append(own)
        for n, own in self.by_length.items():
            d, o = B.flat(pa.array(own, pa.large_binary()))
            self.by_length[n] = np.unique(B.hashes(d, o[:-1], o[1:]))

    def __call__(self, x: Lexed) -> np.ndarray:
        own = np.flatnonzero(x.twice)
        d, o = B.gather(x.d, x.first[own], (x.last - x.first)[own])
        new = np.ones(len(d), bool)
        new[1:] = d[1:] != d[:-1]
        new[o[:-1]] = True
        d, o = d[new], np.concatenate([[0], np.cumsum(new)])[o]
        hit = np.zeros(len(own), bool)
        for n, hashes in self.by_length.items():
            fits = np.flatnonzero(np.diff(o) >= n)
            h = B.hashes(d, o[:-1][fits], o[:-1][fits] + n if n else o[1:][fits])
            hit[fits] |= hashes[np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)] == h
        out = np.zeros(len(x.first), bool)
        out[own[hit]] = True
        return out


def restored(x: Lexed, channel: Channel, twice: np.ndarray | None = None) -> tuple[dict[int, list[bytes]], list[tuple[int, list[bytes]]]]:
    """Restored words of each distinct word that may be written in disguise, and of each spaced run with its text.

    Odd words are read as what they restore to. Words with letters doubled, and words with a symbol at their edge, may be just
    what they look like: what they restore to (if it is something else) is read beside them, for doubled letters if nothing but
    these is left out. ``twice``: the words with doubled letters to try, if not all.
    """
    of: dict[int, list[bytes]] = {}
    for kind, pick, spell in (("odd", x.odd, x.core), ("twice", x.twice if twice is None else twice, x.core), ("edged", x.edged, x.with_edges)):
        own = np.flatnonzero(pick).tolist()
        written = [spell(i) for i in own]
        for i, w, said in zip(own, written, channel.restore(written), strict=True):
            if said != [w] and (kind != "twice" or len(said) == 1 and undoubled(said[0]) == undoubled(w)):
                of.setdefault(i, []).extend(r for r in said if r not in of[i])
    runs = list(x.spaced())
    apart = channel.restore([b" ".join(x.data[s:e].tobytes() for s, e in zip(x.starts[a:z].tolist(), x.ends[a:z].tolist(), strict=True)) for _, a, z in runs])
    return of, [(t, w) for (t, _, _), w in zip(runs, apart, strict=True)]


def stems(word: bytes) -> list[bytes]:
    """The word and its beginnings."""
    return [word, *(word[:n] + b"*" for n in STEMS if len(word) > n and word[n] & 0xC0 != 0x80)]


class Scorer:
    """A noisy-or over restored words: each distinct one makes the text toxic with its own probability, and so may what has none of them.

    ``weights`` and ``bias`` are the negative logarithms of the probabilities that they don't.
    """

    def __init__(self, model: np.ndarray, words: list[bytes], weights: np.ndarray, bias: float, counts: np.ndarray | None = None):
        self.model, self.words, self.weights, self.bias, self.counts = model, words, weights, bias, counts
        self._channel = None

    def found(self, data: np.ndarray, offsets: np.ndarray, contexts: bool = False):
        """Distinct (text, feature number) pairs, of each word the likeliest of its whole and its beginnings; and a text for each of its distinct words with a feature.

        With ``contexts`` all of a word's features, for each occurrence, a hash of the words around it, and the number of
        the whole word's feature (-1: it is none).
        """
        some = self._all if contexts else self._best

        said: dict[bytes, int] = {}

        def pick(word: bytes) -> list[tuple[int, int]]:
            """Features of a restored word, each with the whole word's or, without contexts, a number for the word."""
            own = some(word)
            whole = self._at.get(word, -1) if contexts or not own else said.setdefault(word, len(said))
            return [(f, whole) for f in own]

        if self._channel is None:
            self._channel = Channel(self.model)
            self._at = {w: i for i, w in enumerate(self.words)}
            self._hashes = {}
            for n in (0, *STEMS):
                own = pa.array([w for w in self.words if not n and w[-1:] != b"*"] if not n else [w[:-1] for w in self.words if w[-1:] == b"*" and len(w) == n + 1], pa.large_binary())
                d, o = B.flat(own)
                if len(own):
                    self._hashes[n] = np.sort(B.hashes(d, o[:-1], o[1:]))
            self._doubled = Undoubled(self.words)
        x = Lexed(data, offsets)
        odd, apart = restored(x, self._channel, self._doubled(x))
        by_word: dict[int, list[tuple[int, int]]] = {}
        for n, hashes in self._hashes.items():
            own = x.prefixes(n) if n else np.flatnonzero(x.plain)
            h = B.hashes(x.d, x.first[own], x.first[own] + n if n else x.last[own])
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            for i in own[hashes[at] == h].tolist():
                if i not in by_word and (own_features := pick(x.core(i))):
                    by_word[i] = own_features
        for i, ws in odd.items():
            own = dict.fromkeys([*by_word.get(i, ()), *(f for w in ws for f in pick(w))])
            if own:
                by_word[i] = list(own)
        around = np.zeros(len(x.codes) + 2, np.uint64)
        if contexts and len(x.first):
            around[1:-1] = B.hashes(x.d, x.first, x.last)[x.codes]
            around[1:-1] = B.mix(around[:-2] * B._ODD + around[2:])
        rows: list[tuple[int, int, int, int]] = []
        if by_word:
            hit = np.zeros(len(x.first), bool)
            hit[list(by_word)] = True
            at = np.flatnonzero(hit[x.codes])
            text = np.searchsorted(x.by, at, side="right") - 1
            rows = [(t, f, a, w) for t, c, a in zip(text.tolist(), x.codes[at].tolist(), around[at + 1].tolist(), strict=True) for f, w in by_word[c]]
        rows += [(t, f, 0, w) for t, ws in apart for said in ws for f, w in pick(said)]
        if contexts:
            return tuple(np.array(c, k) for c, k in zip(zip(*rows, strict=True), (np.int64, np.int64, np.uint64, np.int64), strict=True)) if rows else (np.zeros(0, np.int64),) * 4
        got = np.array(sorted({(t, f) for t, f, *_ in rows}), np.int64).reshape(-1, 2)
        words = np.array(sorted({(t, w) for t, _, _, w in rows}), np.int64).reshape(-1, 2)
        return got[:, 0], got[:, 1], words[:, 0]

    def _all(self, word: bytes) -> list[int]:
        return [self._at[w] for w in stems(word) if w in self._at]

    def _best(self, word: bytes) -> list[int]:
        return sorted(self._all(word), key=lambda f: (-self.weights[f], f))[:1]

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return self.weighed(*self.evidence(data, offsets))

    def evidence(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each text the noisy-or's sum, and how many different restored words have a feature."""
        text, word, of = self.found(data, offsets)
        n = len(offsets) - 1
        return self.bias + (np.bincount(text, weights=self.weights[word], minlength=n) if len(text) else np.zeros(n)), np.bincount(of, minlength=n)

    def weighed(self, z: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Probabilities: the noisy-or's, and, once they are learned, those of so many words beside it."""
        p = -np.expm1(-z)
        if self.counts is None:
            return p
        return np.where(words > 0, 1 / (1 + np.exp(-np.clip(_inputs(p, words) @ self.counts, -30, 30))), p)


def _inputs(p: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The noisy-or's log odds, and one column for each number of words (the last: so many or more)."""
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.column_stack([np.log(p / (1 - p)), *(words == k for k in range(1, MANY)), words >= MANY]).astype(float)


def count_weights(z: np.ndarray, words: np.ndarray, toxic: np.ndarray, ridge: float = 1.0) -> np.ndarray | None:
    """Weights of ``_inputs`` by ridge logistic regression towards the noisy-or itself; None without texts of both kinds that have words.

    A beginning of words is learned from contexts, one at a time; whether one word of it is enough, or only several different ones, is
    learned here.
    """
    own = words > 0
    y = toxic[own].astype(float)
    if not 0 < y.sum() < len(y):
        return None
    x = _inputs(-np.expm1(-z[own]), words[own])
    start = np.zeros(x.shape[1])
    start[0] = 1
    w = start.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * (w - start)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, learn: str, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", sample: int = SAMPLE) -> Scorer:
    """Counts characters over all documents and fits on at most about ``sample`` labelled rows for which the SQL condition ``learn`` holds, dealt by the hash of their id."""
    spark = docs.sparkSession
    model = language_model(count_characters(docs, text))
    own = labels.where(learn).where(F.col(toxic).isNotNull()).selectExpr(f"cast(`{doc_id}` as long) as doc_id", f"cast(`{toxic}` as int) as toxic").where("doc_id is not null")
    n = own.count()
    if n > sample:
        own = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(-(-n // sample))) == 0)
    texts = docs.selectExpr(f"cast(`{doc_id}` as long) as doc_id", f"cast(`{text}` as string) as text")
    rows = X.durable(own.join(texts, "doc_id").select("toxic", "text"))
    held = spark.sparkContext.broadcast(model)

    def words(batches):
        channel = Channel(held.value)
        for part in _parts(batches, 1):
            y = part.column(0).to_numpy(zero_copy_only=False)
            x = Lexed(*B.flat(part.column(1)))
            odd, apart = restored(x, channel)
            text_of = np.searchsorted(x.by, np.arange(len(x.codes)), side="right") - 1

            def tally(values: pa.Array, code: np.ndarray, mark: str):
                """In how many texts of either kind each value is; code: by distinct word, -1 for none."""
                own = code[x.codes]
                ok = own >= 0
                t, c = np.divmod(np.unique(text_of[ok] * np.int64(len(values) + 1) + own[ok]), len(values) + 1)
                n0, n1 = (np.bincount(c[y[t] == k], minlength=len(values)) for k in (0, 1))
                return [pc.binary_join_element_wise(values.cast(pa.binary()), pa.scalar(mark.encode(), pa.binary()), pa.scalar(b"", pa.binary())), pa.array(n0), pa.array(n1)]

            made = []
            for n in (0, *STEMS):
                own = x.prefixes(n) if n else np.flatnonzero(x.plain)
                code = np.full(len(x.first), -1, np.int64)
                code[own], values = B.encode(B.binary(x.d, x.first[own], x.first[own] + n if n else x.last[own]))
                made.append(tally(values, code, "*" if n else ""))
            extra: dict[tuple[int, bytes], None] = {}
            disguised = np.zeros(len(x.first), bool)
            disguised[list(odd)] = True
            hidden = np.flatnonzero(disguised[x.codes])
            for t, c in zip(text_of[hidden].tolist(), x.codes[hidden].tolist(), strict=True):
                extra.update(((t, f), None) for w in odd[c] for f in stems(w))
            extra.update(((t, f), None) for t, ws in apart for w in ws for f in stems(w))
            # a word that is also written plainly in its text counts twice there, which one more text hardly weighs against
            made.append([pa.array([f for _, f in extra], pa.binary()), pa.array([int(y[t] == 0) for t, _ in extra], pa.int64()), pa.array([int(y[t] == 1) for t, _ in extra], pa.int64())])
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(col) for col in zip(*made, strict=True)], ["word", "n0", "n1"])

    d1, d0 = (int(v or 0) for v in rows.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first())
    if not d1 or not d0:
        share = min(max(d1 / (d0 + d1), 0.01), 0.99) if d0 + d1 else 0.5
        return Scorer(model, [], np.zeros(0), -np.log1p(-share))
    # log odds of a word's presence, in units of their deviation
    odds = F.expr(f"ln((n1 + 0.5) / ({d1} - n1 + 0.5)) - ln((n0 + 0.5) / ({d0} - least(n0, {d0}) + 0.5))")
    sure = odds / F.sqrt(1 / (F.col("n1") + 0.5) + 1 / (F.col("n0") + 0.5))
    precision = F.expr("(n1 + 1.9208 - 1.96 * sqrt(n1 * n0 / (n1 + n0) + 0.9604)) / (n1 + n0 + 3.8416)")  # the lower end of Wilson's 95 % interval
    tried = X.durable(rows.mapInArrow(words, "word binary, n0 long, n1 long").groupBy("word").agg(F.sum("n0").alias("n0"), F.least(F.sum("n1"), F.lit(d1)).alias("n1")).where("n1 >= 2"))
    bound = 0.75 * np.sqrt(2 * np.log(max(tried.count(), 2)))  # the more words are tried, the surer each must be
    top = tried.where(precision >= PRECISION).where(sure >= bound).orderBy(F.desc("n1"), "word").collect()  # as many as words of the sample pass both tests
    candidates = spark.sparkContext.broadcast(Scorer(model, [bytes(r["word"]) for r in top], np.ones(len(top)), 0.0))

    def contexts(batches):
        for part in _parts(batches, 1):
            y = part.column(0).to_numpy(zero_copy_only=False)
            text, word, around, whole = candidates.value.found(*B.flat(part.column(1)), contexts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word, pa.int32()), pa.array(around.astype(np.int64)), pa.array(y[text], pa.int32()), pa.array(whole, pa.int32())], ["f", "around", "toxic", "whole"])

    # by the words around it, so that the copies of one text count once
    seen = X.durable(rows.mapInArrow(contexts, "f int, around long, toxic int, whole int").distinct())

    def sure_of(found: DataFrame) -> list[tuple[int, float]]:
        counts = found.groupBy("f").agg(F.sum(1 - F.col("toxic")).alias("n0"), F.sum("toxic").alias("n1"))
        return [(r["f"], r["p"]) for r in counts.where(sure >= bound).withColumn("p", precision).where(F.col("p") >= SURE).orderBy("f").collect()]

    words_ = sure_of(seen.where("f = whole"))
    # a beginning counts by the words that aren't sure themselves
    taken = spark.createDataFrame([(f,) for f, _ in words_], "whole int")
    kept = [(bytes(top[f]["word"]), p) for f, p in [*words_, *sure_of(seen.where("f <> whole").join(F.broadcast(taken), "whole", "left_anti"))]]
    made = Scorer(model, [w for w, _ in kept], -np.log1p(-np.array([p for _, p in kept], float)), 0.0)
    ready = spark.sparkContext.broadcast(made)

    def held_by(batches):
        for part in _parts(batches, 1):
            z, n = ready.value.evidence(*B.flat(part.column(1)))
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int32()), pa.array(z), pa.array(n)], ["toxic", "z", "words"])

    known = X.durable(rows.mapInArrow(held_by, "toxic int, z double, words long"))
    n, n1 = (int(v or 0) for v in known.where("words = 0").agg(F.count("*"), F.sum("toxic")).first())
    bias = -np.log1p(-min((n1 + d1 / (d0 + d1)) / (n + 1), 0.49))
    t = known.where("words > 0").toArrow()  # at most a row for each labelled row of the sample
    z, words_of, y = (t.column(c).to_numpy() for c in ("z", "words", "toxic"))
    return Scorer(model, made.words, made.weights, bias, count_weights(z + bias, words_of, y))


def score(docs: DataFrame, scorer: Scorer, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: score and prediction."""
    held = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches):
        for part in _parts(batches, 1):
            s = held.value.scores(*B.flat(part.column(1)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.selectExpr(f"cast(`{doc_id}` as long) as doc_id", f"cast(`{text}` as string) as text").mapInArrow(run, SCORED)


def reject(docs: DataFrame, scorer: Scorer, text: str = "text") -> DataFrame:
    """``docs`` without those predicted toxic; all columns unchanged."""
    held = docs.sparkSession.sparkContext.broadcast(scorer)
    place = docs.columns.index(text)

    def run(batches):
        for part in _parts(batches, place):
            yield part.filter(pa.array(held.value.scores(*B.flat(part.column(place))) < 0.5))

    return docs.mapInArrow(run, docs.schema)


def deobfuscate(docs: DataFrame, model: np.ndarray, text: str = "text") -> DataFrame:
    """``docs`` with the column ``restored``: the text, lower-cased, with disguised words as restored. A column of this name gives way."""
    from pyspark.sql.types import StringType, StructField, StructType

    held = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text)

    def run(batches):
        channel = Channel(held.value)
        for part in _parts(batches, place):
            x = Lexed(*B.flat(part.column(place)))
            pick = np.flatnonzero(x.odd | x.twice).tolist()
            odd = {i: w for i, w in zip(pick, channel.restore([x.core(i) for i in pick]), strict=True) if x.odd[i] or len(w) == 1 and undoubled(w[0]) == undoubled(x.core(i))}
            apart = {a: z for _, a, z in x.spaced()}
            out = []
            for t in range(len(part)):
                said, i = [], int(x.by[t])
                while i < x.by[t + 1]:
                    if i in apart:
                        said += channel.restore([b" ".join(x.data[s:e].tobytes() for s, e in zip(x.starts[i : apart[i]].tolist(), x.ends[i : apart[i]].tolist(), strict=True))])[0]
                        i = apart[i]
                        continue
                    said += odd.get(int(x.codes[i])) or [x.data[x.starts[i] : x.ends[i]].tobytes()]
                    i += 1
                out.append(b" ".join(said).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), pa.array(out, pa.string())], [*others, "restored"])

    others = [c for c in docs.columns if c != "restored" or c == text]
    return docs.mapInArrow(run, StructType([*(docs.schema[c] for c in others), StructField("restored", StringType())]))
