"""Double-array tries of phrases of numbered words, walked by all places of a text at once.

A phrase's words are numbered anew within its trie, and each number is three digits of 8 bits, so that a node has at
most 256 children. The child of node s by digit d is base[s] + d if check[base[s] + d] is s. Digits keep
families small, which is what makes first fit pack them well.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

DIGITS = (16, 8, 0)
#: Free slots that are tried at a time for a family.
WINDOW = 128


class Trie(NamedTuple):
    words: np.ndarray  # the numbers of all words in its phrases, ascending
    base: np.ndarray
    check: np.ndarray
    accept: np.ndarray  # by slot: the phrase that ends there, else -1

    def packed(self) -> list[bytes]:
        return [self.words.astype(np.int64).tobytes(), *[x.astype(np.int32).tobytes() for x in self[1:]]]

    @staticmethod
    def unpacked(parts) -> Trie:
        return Trie(np.frombuffer(parts[0], np.int64), *[np.frombuffer(x, np.int32) for x in parts[1:4]])


def built(phrases: np.ndarray) -> tuple[Trie, np.ndarray]:
    """The trie of different phrases: a row each, of numbers of words with -1 after the last. Also the order in which accept counts the rows."""
    words = np.unique(phrases[phrases >= 0])
    if len(words) > 1 << 24:
        raise ValueError("more words than three digits can tell apart")
    order = np.lexsort(phrases.T[::-1])
    local = np.where(phrases < 0, -1, np.searchsorted(words, phrases))[order]
    digits = np.stack([np.where(local[:, k] < 0, -1, (local[:, k] >> shift) & 255) for k in range(local.shape[1]) for shift in DIGITS], axis=1)
    n, depth = digits.shape
    used = np.zeros(max(1024, n * 8), bool)
    base, check = np.zeros(len(used), np.int32), np.full(len(used), -1, np.int32)
    used[0] = True
    accept: list[tuple[np.ndarray, np.ndarray]] = []
    slot = np.zeros(n, np.int64)  # of each row's prefix so far
    new = np.zeros(n, bool)
    rows = np.arange(n)  # rows that go on
    free = 256
    for t in range(depth):
        rows = rows[digits[rows, t] >= 0]
        if not len(rows):
            break
        first = np.ones(len(rows), bool)
        first[1:] = (slot[rows[1:]] != slot[rows[:-1]]) | (digits[rows[1:], t] != digits[rows[:-1], t])
        edges = rows[first]
        parent, digit = slot[edges], digits[edges, t].astype(np.int64)
        starts = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]]))
        sizes = np.diff(np.append(starts, len(edges)))
        at = np.zeros(len(edges), np.int64)
        for f in np.flatnonzero(sizes > 1)[np.argsort(-sizes[sizes > 1], kind="stable")]:
            own = digit[starts[f] : starts[f] + sizes[f]]
            while True:
                if free + 4 * WINDOW + 512 > len(used):
                    used, base, check = grown(used, False), grown(base, 0), grown(check, -1)
                places = free + np.flatnonzero(~used[free : free + 4 * WINDOW])[:WINDOW]
                fits = places[~used[places[:, None] - own[0] + own].any(axis=1)] - own[0] if len(places) else places
                if len(fits):
                    break
                free += WINDOW
            at[starts[f] : starts[f] + sizes[f]] = fits[0] + own
            used[fits[0] + own] = True
            base[parent[starts[f]]] = fits[0]
        single = starts[sizes == 1]
        while (~used[256:-512]).sum() < len(single):
            used, base, check = grown(used, False), grown(base, 0), grown(check, -1)
        places = 256 + np.flatnonzero(~used[256:-512])[: len(single)]
        at[single] = places
        used[places] = True
        base[parent[single]] = places - digit[single]
        check[at] = parent
        new[:] = False
        new[edges] = True
        slot[rows] = at[np.cumsum(first) - 1]
        if t % len(DIGITS) == len(DIGITS) - 1:
            ends = rows if t == depth - 1 else rows[digits[rows, t + 1] < 0]
            accept.append((slot[ends], ends))
    size = int(np.flatnonzero(used)[-1]) + 513
    used, base, check = (x[:size] if size <= len(x) else np.concatenate([x, np.full(size - len(x), -1, x.dtype)]) for x in (used, base, check))
    ended = np.full(size, -1, np.int32)
    for slots, which in accept:
        ended[slots] = which
    return Trie(words, base, check, ended), order


def grown(x: np.ndarray, fill) -> np.ndarray:
    return np.concatenate([x, np.full(len(x), fill, x.dtype)])


def walked(trie: Trie, ids: np.ndarray, most: int = 4, starts: np.ndarray | None = None):
    """For each number of words k from 1: the places of a text, of all or of ``starts``, from which the trie has come so far, and their states. ids: below 0 nothing passes."""
    local = np.searchsorted(trie.words, ids)
    local[local == len(trie.words)] = 0
    if not len(trie.words):
        return
    there = trie.words[local] == ids
    at = np.flatnonzero(there) if starts is None else starts[there[starts]]
    state = np.zeros(len(at), np.int64)
    for k in range(most):
        here = at + k
        going = here < len(ids)
        going[going] = there[here[going]]
        at, state = at[going], state[going]
        word = local[at + k]
        for shift in DIGITS:
            after = trie.base[state] + ((word >> shift) & 255)
            fits = trie.check[after] == state
            at, state, word = at[fits], after[fits], word[fits]
        yield k + 1, at, state
