"""Tokenising: the tokenizers library with a memory of words, and our own batched BPE.

A text is cut at ASCII white space before it is encoded. The vocabularies used here drop white space
and never join what stands on both sides of it, so a text's ids are those of its chunks, one after
another; each distinct chunk is encoded once and remembered (at most `limit` chunks a process).
"""

from __future__ import annotations

import heapq
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex

from .common import Words

#: The code points that \\s matches in the tokenizer's patterns.
SPACES = "\t\n\x0b\x0c\r \x85\xa0                　"
#: The pre-tokenizer's pattern.
PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACES}\p{{L}}\p{{N}}]+")
#: Letters for which every library agrees on form and case.
PLAIN = regex.compile(r"[a-zA-Z]+")
COMMON = regex.compile(r"[\x21-\x7eÀ-ÖØ-öø-ÿ]+")
LONG = 400


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes stand for
    themselves, the others are numbered from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = {b: chr(256 + n) for n, b in enumerate(x for x in range(256) if x not in own)}
    return [rest.get(b, chr(b)) for b in range(256)]


LETTERS = byte_letters()


def normalized(text: str) -> str:
    """NFC, and lower case one code point at a time (no final sigma)."""
    text = unicodedata.normalize("NFC", text)
    return "".join(map(str.lower, text)) if "Σ" in text else text.lower()


def mapped(piece: str) -> str:
    """The piece's bytes as letters."""
    return piece if piece.isascii() and piece.isprintable() and " " not in piece else "".join(LETTERS[b] for b in piece.encode())


class Memo:
    """Remembers a list of ids, and what else `tell` says, for each chunk."""

    def __init__(self, limit: int = 600_000):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.places: dict[str, int] = {}
        self.starts, self.lens, self.n = np.zeros(1024, np.int64), np.zeros(1024, np.int64), 0
        self.ids, self.end = np.zeros(1 << 14, np.uint32), 0

    def add(self, chunks: list[str], lens: np.ndarray, ids: np.ndarray) -> None:
        n, end = self.n + len(chunks), self.end + len(ids)
        if n > len(self.starts):
            self.starts, self.lens = np.resize(self.starts, 2 * n), np.resize(self.lens, 2 * n)
        if end > len(self.ids):
            self.ids = np.resize(self.ids, 2 * end)
        self.starts[self.n : n], self.lens[self.n : n] = self.end + np.cumsum(lens) - lens, lens
        self.ids[self.end : end] = ids
        self.places.update(zip(chunks, range(self.n, n), strict=True))
        self.n, self.end = n, end


class Encoder:
    """encode(texts) -> (ids of all texts in one array, offsets of each text's ids)."""

    def __init__(self, path: str):
        self.memo = Memo()
        self.load(path)

    def load(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tk = Tokenizer.from_file(path)
        self.tk.no_truncation()
        self.tk.no_padding()
        self.model = self.tk.model

    def fresh(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks not met before. Chunks of common letters go straight to the library's BPE
        model, all others through the library's whole tokenizer."""
        tokenize, out, rest = self.model.tokenize, [None] * len(chunks), []
        for i, c in enumerate(chunks):
            if PLAIN.fullmatch(c):
                out[i] = [t.id for t in tokenize(c.lower())]
            elif COMMON.fullmatch(c) and "<|" not in c:
                out[i] = [t.id for p in PIECES.findall(c.lower()) for t in tokenize(mapped(p))]
            else:
                rest.append(i)
        for i, e in zip(rest, self.tk.encode_batch([chunks[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = e.ids
        lens = np.fromiter(map(len, out), np.int64, len(out))
        return lens, np.fromiter((x for o in out for x in o), np.uint32, int(lens.sum()))

    def place(self, texts: pa.Array) -> tuple[np.ndarray, Words]:
        """For each chunk its place in the memory."""
        words = Words(texts)
        distinct, of = words.coded()
        chunks = distinct.to_numpy(zero_copy_only=False).tolist()
        if self.memo.n + len(chunks) > self.memo.limit:
            self.memo.clear()
        known = self.memo.places
        new = [c for c in chunks if c not in known]
        if new:
            self.memo.add(new, *self.fresh(new))
        at = np.fromiter((known[c] for c in chunks), np.int64, len(chunks))
        return at[of] if len(of) else of, words

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        at, words = self.place(texts)
        lens = self.memo.lens[at]
        ends = np.concatenate(([0], np.cumsum(lens)))
        take = np.repeat(self.memo.starts[at] - ends[:-1], lens) + np.arange(ends[-1])
        return self.memo.ids[take], ends[words.offsets]

    def decode(self, ids: list[int]) -> str:
        return self.tk.decode(ids, skip_special_tokens=False)


class BatchedBpe(Encoder):
    """The same ids by our own BPE: symbols of many words in one flat array, one merge a word and round.

    Each round finds every word's adjacent pair of lowest rank (the leftmost of equals); ranks come
    from a binary search over the sorted keys of all pairs that merge. Words of over LONG symbols are
    merged one by one with a heap, which takes n log n steps and not n rounds.
    """

    def load(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_at = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.tokens = {i: t for t, i in (self.vocab | self.special).items()}
        self.first = np.array([self.vocab.get(c, -1) for c in LETTERS], np.int64)
        self.last = np.array([self.vocab.get(c + suffix, -1) for c in LETTERS], np.int64)
        self.width = max(self.vocab.values()) + 1
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        key = np.array([self.vocab[a] * self.width + self.vocab[b] for a, b in pairs], np.int64)
        made = np.array([self.vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.made = key[order], order, made[order]
        self.text_of = None

    NONE = np.int64(1) << 40

    def look(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of each pair; NONE where it doesn't merge."""
        key = a * self.width + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], self.NONE), self.made[at]

    def bpe(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and flat ids of pieces (normalised, not empty)."""
        raw = [p.encode() for p in pieces]
        n = np.fromiter(map(len, raw), np.int64, len(raw))
        word = np.repeat(np.arange(len(raw)), n)
        flat = np.frombuffer(b"".join(raw), np.uint8)
        sym = self.first[flat]
        ends = np.cumsum(n)
        sym[ends - 1] = self.last[flat[ends - 1]]
        keep = sym >= 0  # a byte without a symbol has no id
        sym, word = sym[keep], word[keep]
        long = np.flatnonzero(n > LONG)
        done_sym, done_word = [], []
        for w in long:
            own = self.by_heap(sym[word == w].tolist())
            done_sym.append(np.array(own, np.int64))
            done_word.append(np.full(len(own), w))
        if len(long):
            keep = n[word] <= LONG
            sym, word = sym[keep], word[keep]
        same = word[1:] == word[:-1]
        rank, made = self.look(sym[:-1], sym[1:]) if len(sym) > 1 else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        rank = np.append(np.where(same, rank, self.NONE), [self.NONE] * (len(sym) > 0))
        made = np.append(made, [0] * (len(sym) > 0))
        while len(sym):
            start = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            best = np.minimum.reduceat((rank << 22) | (np.arange(len(sym)) - np.repeat(start, np.diff(np.append(start, len(sym))))), start)
            over = (best >> 22) >= self.NONE
            if over.any():  # these words are finished
                out = np.repeat(over, np.diff(np.append(start, len(sym))))
                done_sym.append(sym[out])
                done_word.append(word[out])
                keep = ~out
                sym, word, rank, made = sym[keep], word[keep], rank[keep], made[keep]
                if not len(sym):
                    break
                best = best[~over]
                start = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            at = start + (best & ((1 << 22) - 1))
            sym[at] = made[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            at = at - np.arange(len(at))  # one symbol goes in each word
            sym, word, rank, made = sym[keep], word[keep], rank[keep], made[keep]
            for i in (at, at[at > 0] - 1):  # pairs that the new symbol begins and ends
                j = np.minimum(i + 1, len(sym) - 1)
                r, m = self.look(sym[i], sym[j])
                rank[i], made[i] = np.where((j > i) & (word[i] == word[j]), r, self.NONE), m
        sym = np.concatenate([np.zeros(0, np.int64), *done_sym])
        word = np.concatenate([np.zeros(0, np.int64), *done_word])
        order = np.argsort(word, kind="stable")
        return np.bincount(word, minlength=len(raw)), sym[order]

    def by_heap(self, sym: list[int]) -> list[int]:
        """One long word: a heap of pairs and linked neighbours."""
        n = len(sym)
        right, left, alive = [*range(1, n), -1], [-1, *range(n - 1)], [True] * n
        rank, made = (x.tolist() for x in self.look(np.array(sym[:-1], np.int64), np.array(sym[1:], np.int64)))
        heap = [(r, i, sym[i], sym[i + 1], m) for i, (r, m) in enumerate(zip(rank, made, strict=True)) if r < self.NONE]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, m = heapq.heappop(heap)
            j = right[i]
            if not alive[i] or j < 0 or sym[i] != a or sym[j] != b:
                continue
            sym[i], alive[j], right[i] = m, False, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for p, q in ((left[i], i), (i, right[i])):
                if p >= 0 and q >= 0:
                    r, x = self.look(np.array([sym[p]]), np.array([sym[q]]))
                    if r[0] < self.NONE:
                        heapq.heappush(heap, (int(r[0]), p, sym[p], sym[q], int(x[0])))
        return [s for s, a in zip(sym, alive, strict=True) if a]

    def fresh(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        pieces: list[str] = []
        parts: list[list[int]] = []  # of each chunk: >= 0 a piece, < 0 a special token
        for c in chunks:
            if PLAIN.fullmatch(c):
                parts.append([len(pieces)])
                pieces.append(c.lower())
                continue
            own, at = [], 0
            for m in [*self.special_at.finditer(c), None]:
                for p in PIECES.findall(normalized(c[at : m.start() if m else len(c)])):
                    own.append(len(pieces))
                    pieces.append(p)
                if m:
                    own.append(-1 - self.special[m[0]])
                    at = m.end()
            parts.append(own)
        index: dict[str, int] = {}
        of = [index.setdefault(p, len(index)) for p in pieces]
        lens, ids = self.bpe(list(index))
        ends = np.cumsum(lens)
        out, total = [], np.zeros(len(chunks), np.int64)
        one = {}
        for i, own in enumerate(parts):
            for k in own:
                if k < 0:
                    x = one.setdefault(k, np.array([-1 - k]))
                else:
                    w = of[k]
                    x = ids[ends[w] - lens[w] : ends[w]]
                out.append(x)
                total[i] += len(x)
        return total, (np.concatenate(out) if out else np.zeros(0)).astype(np.uint32)

    def decode(self, ids: list[int]) -> str:
        """The tokens with one space between them, as a vocabulary without a decoder has them."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


_loaded: dict[tuple, Encoder] = {}


def encoder(path: str, kind: type[Encoder] = Encoder) -> Encoder:
    """One encoder a process, kept between tasks."""
    if (key := (path, kind)) not in _loaded:
        _loaded[key] = kind(path)
    return _loaded[key]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
