"""Byte-pair encoding of a whole corpus by prefix-sharing trie traversal.

The distinct words of a batch are inserted into a trie (held implicitly: sorted words share the prefixes of their
neighbours). A depth-first walk propagates, for every prefix, the last token of that prefix's encoding: it is the one
token that ends the prefix and that may follow the encoding of what stands before it. So the encoding of a shared
prefix is computed once, and a word's tokens are read by stepping back from its end. No shuffle is needed: batches are
independent, the vocabulary is a file of fixed size.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from skein.llm.text import LETTER, OTHER, SPACE, classes, codes, slices, span_hashes

TOKENIZERS = "/opt/tokenizers"
#: Distinct words a worker remembers between batches; then it forgets them all, which costs time but changes nothing.
REMEMBERED_WORDS = 400_000


class Vocabulary:
    """Tokens with ranks as ids (a merge of lower rank comes first), as an automaton that finds every token ending
    at a place, and the test whether two tokens may stand side by side."""

    def __init__(self, path: str):
        lines = Path(path).read_bytes().splitlines()
        self.tokens = [b""] * len(lines)
        for line in lines:
            word, rank = line.split()
            self.tokens[int(rank)] = base64.b64decode(word)
        ranks = {t: i for i, t in enumerate(self.tokens)}
        self.lengths = [len(t) for t in self.tokens]
        self.parts: list[tuple[int, int] | None] = []
        self.merged: dict[int, int] = {}
        for i, token in enumerate(self.tokens):
            self.parts.append(self._split(token, i, ranks) if len(token) > 1 else None)
            if self.parts[i]:
                left, right = self.parts[i]
                self.merged[left << 20 | right] = i
        self.allowed: dict[int, bool] = {}
        self._automaton()

    @staticmethod
    def _split(token: bytes, rank: int, ranks: dict[bytes, int]) -> tuple[int, int] | None:
        """The last merge that made the token, by merging its bytes with the merges of lower rank."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            found = [(r, i) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1], rank)) < rank]
            if not found:
                return None
            _, i = min(found)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return ranks[parts[0]], ranks[parts[1]]

    def _automaton(self) -> None:
        step: dict[int, int] = {}
        ends, token_at = [0], [-1]
        for i, token in enumerate(self.tokens):
            s = 0
            for b in token:
                key = s << 8 | b
                s = step.get(key, 0)
                if not s:
                    s = step[key] = len(token_at)
                    token_at.append(-1)
                    ends.append(0)
            token_at[s] = i
        back = [0] * len(token_at)
        found: list[tuple[int, ...]] = [()] * len(token_at)
        for key, s in sorted(step.items(), key=lambda x: self._depth(x[1], step)):
            above, b = key >> 8, key & 255
            if above:
                f = back[above]
                while f and (f << 8 | b) not in step:
                    f = back[f]
                back[s] = step.get(f << 8 | b, 0)
            found[s] = ((token_at[s],) if token_at[s] >= 0 else ()) + found[back[s]]
        self.step, self.back, self.found = step, back, found

    def _depth(self, state: int, step: dict[int, int]) -> int:
        if not hasattr(self, "_depths"):
            self._depths = [0] * (len(step) + 1)
            for key, s in step.items():  # a parent is always made before its children
                self._depths[s] = self._depths[key >> 8] + 1
        return self._depths[state]

    def beside(self, a: int, b: int) -> bool:
        """Whether merging keeps a and b apart: no merge across their border would come before the merges that made
        the tokens on its two sides. Undoes the later of the two merges again and again."""
        before = 1 << 30
        while True:
            if self.merged.get(a << 20 | b, before) < before:
                return False
            if a > b:
                turn, other = (a, True), b
            else:
                turn, other = (b, False), a
            for token, left in ((turn[0], turn[1]), (other, not turn[1])):
                if self.parts[token]:
                    if left:
                        before, a = token, self.parts[token][1]
                    else:
                        before, b = token + 1, self.parts[token][0]
                    break
            else:
                return True

    def encode_sorted(self, words: list[bytes]) -> Iterator[list[int]]:
        """The tokens of each word; words in byte order, so that shared prefixes are walked once."""
        step, back, found, lengths, allowed = self.step, self.back, self.found, self.lengths, self.allowed
        states, last, before = [0], [-1], b""
        for word in words:
            shared, most = 0, min(len(word), len(before))
            if word[:most] == before[:most]:
                shared = most
            else:
                low, high = 0, most  # bisection for the common prefix
                while low < high:
                    middle = (low + high + 1) // 2
                    if word[:middle] == before[:middle]:
                        low = middle
                    else:
                        high = middle - 1
                shared = low
            del states[shared + 1 :], last[shared + 1 :]
            s = states[shared]
            for i in range(shared, len(word)):
                b = word[i]
                key = s << 8 | b
                to = step.get(key)
                if to is None:
                    f = s
                    while f and to is None:
                        f = back[f]
                        to = step.get(f << 8 | b)
                    to = to or 0
                s = to
                states.append(s)
                for token in found[s]:
                    j = i + 1 - lengths[token]
                    if j == 0:
                        break
                    pair = last[j] << 20 | token
                    ok = allowed.get(pair)
                    if ok is None:
                        ok = allowed[pair] = self.beside(last[j], token)
                    if ok:
                        break
                last.append(token)
            tokens, i = [], len(word)
            while i:
                tokens.append(last[i])
                i -= lengths[last[i]]
            tokens.reverse()
            before = word
            yield tokens


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def pieces(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """Where the words of byte-level encoding begin: the pattern
    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
    evaluated on whole arrays. Gives all texts as one string, its code points, the piece borders, and the pieces of each
    text."""
    whole, points, at = codes(texts)
    n = len(points)
    if not n:
        return whole, points, np.zeros(1, np.int64), np.zeros(len(texts), np.int64)
    kind = classes()[points]
    start = np.zeros(n + 1, bool)
    start[1:n] = kind[1:] != kind[:-1]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    start |= edge
    runs = np.flatnonzero(start[:n])
    space_before = np.zeros(n, bool)
    space_before[1:] = (kind[:-1] == SPACE) & ~edge[1:n]
    # white space before a word: its last character goes to the word if it is a blank, else it stands alone
    heads = runs[(kind[runs] != SPACE) & space_before[runs]]
    start[heads - 1] = True
    start[heads[points[heads - 1] == 32]] = False
    # contractions: an apostrophe that is a whole run of its own, without a blank in front
    marks = np.flatnonzero((points == 39) & start[:n])
    marks = marks[marks + 1 < n]
    if len(marks):
        marks = marks[(kind[marks] == OTHER) & (kind[marks + 1] == LETTER) & ~edge[marks + 1]]
        first = points[marks + 1]
        after = np.minimum(marks + 2, n - 1)
        second = np.where((marks + 2 < n) & ~edge[np.minimum(marks + 2, n)], points[after], 0)
        one = np.isin(first, [ord(c) for c in "stmd"])
        two = ((first == ord("r")) | (first == ord("v"))) & (second == ord("e")) | (first == ord("l")) & (second == ord("l"))
        for taken, width in ((one, 2), (two, 3)):
            m = marks[taken]
            start[m + 1] = False
            stop = m + width
            inside = stop < n
            m = stop[inside]
            start[m[kind[m] == LETTER]] = True
    start[n] = True
    borders = np.flatnonzero(start)
    return whole, points, borders, np.diff(np.searchsorted(borders, at))


@cache
def encoder(path: str) -> "Encoder":
    """One encoder per Python worker: what it has learned serves the tasks that follow."""
    return Encoder(path)


class Encoder:
    """Encodes batches of texts; keeps distinct words between batches."""

    def __init__(self, path: str):
        self.vocabulary = vocabulary(path)
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, np.uint64)  # sorted hashes of the words
        self.known_at = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)
        self.begins = np.zeros(0, np.int64)

    def learn(self, fresh: list[str]) -> None:
        order = sorted((w.encode("utf-8", "surrogatepass"), k) for k, w in enumerate(fresh))
        lists: list[list[int]] = [[]] * len(fresh)
        for (_, k), tokens in zip(order, self.vocabulary.encode_sorted([w for w, _ in order])):
            lists[k] = tokens
        lengths = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter((t for tokens in lists for t in tokens), np.int32, int(lengths.sum()))
        self.begins = np.append(self.begins, len(self.ids) + np.cumsum(lengths) - lengths)
        self.lengths = np.append(self.lengths, lengths)
        self.ids = np.append(self.ids, flat)

    def _word_ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > REMEMBERED_WORDS:
            self.forget()
        whole, points, borders, counts = pieces(texts)
        distinct, first, of = np.unique(span_hashes(points, borders[:-1], borders[1:]), return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, distinct)
        new = np.ones(len(distinct), bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != distinct[inside]
        if new.any():
            where = first[new]
            fresh = [whole[a:b] for a, b in zip(borders[where].tolist(), borders[where + 1].tolist())]
            had = len(self.lengths)
            self.learn(fresh)
            known = np.append(self.known, distinct[new])
            order = np.argsort(known)
            self.known, self.known_at = known[order], np.append(self.known_at, had + np.arange(len(fresh)))[order]
            at = np.searchsorted(self.known, distinct)
        return self.known_at[at][of] if len(of) else of, counts

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        of, counts = self._word_ids(texts)
        total = np.concatenate(([0], np.cumsum(self.lengths[of])))
        at = np.concatenate(([0], np.cumsum(counts)))
        return total[at[1:]] - total[at[:-1]]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where each text's ids begin (the end as the last entry)."""
        of, counts = self._word_ids(texts)
        lengths = self.lengths[of]
        total = np.concatenate(([0], np.cumsum(lengths)))
        place = np.arange(total[-1]) + np.repeat(self.begins[of] - total[:-1], lengths)
        at = np.concatenate(([0], np.cumsum(counts)))
        return self.ids[place] if len(place) else np.zeros(0, np.int32), total[at]


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """(key, ids): the token ids of every row's whole text without special tokens. Null and empty texts give an empty
    list; strings that look like special tokens are ordinary text; repeated rows and null keys stay as they are; an
    empty table gives an empty result; other columns are ignored."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer)
        for batch in slices(batches, 1):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids, at = code.encode(texts)
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[key, "ids"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def token_counts(df: DataFrame, keep: list[str], text: str = "text", tokenizer: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """The columns of keep and n_tokens of every row's text (0 for null and empty texts)."""
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer)
        for batch in slices(batches, len(keep)):
            n = code.counts([t or "" for t in batch.column(len(keep)).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(n, pa.int64())], names=[*keep, "n_tokens"])

    return df.select(*keep, text).mapInArrow(run, f"{fields}, n_tokens bigint")
