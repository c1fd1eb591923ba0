"""Pages of repeated keywords, link lists or product tags, found by labelling lines with a hidden Markov model.

Each line of a text emits a symbol (what it looks like: sentences, links, tags, a listing, a heading ...); the hidden
states are prose, link list, tag list and menu. The model's probabilities are fitted to all texts by Baum-Welch rounds,
from a prior that says what the states mean; a round is one scan of the lines' symbols and sends back 60 sums a task. The Viterbi path labels all lines of a page
together, so a short line takes the side of its neighbours. A page is flagged if at least half of its words stand in lines that are not prose.
Texts are read once; what is kept of them is five bytes per line, and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.text import IDEOGRAPH, LETTER, SPACE, classes, codes, slices, span_hashes, word_classes
from skein.session import ensure_checkpoint_dir

PROSE, LINKS, TAGS, MENU = range(4)
STATES = ["prose", "link list", "tag list", "menu"]
SENTENCES, LINK, HASHTAGS, STUFFED, LISTING, CRUMBS, PLAIN, LOOSE, EMPTY, ECHO = range(10)
SYMBOLS = ["sentences", "links", "hashtags", "stuffed", "listing", "crumbs", "plain", "loose", "empty", "echo"]
#: The prior of P(symbol | state). Sentences are all but proof of prose; short plain lines and blank ones say little.
EMISSION = np.array(
    [
        # sentences link  hashtags stuffed listing crumbs plain loose empty echo
        [0.600, 0.020, 0.002, 0.004, 0.008, 0.006, 0.156, 0.100, 0.100, 0.004],
        [0.010, 0.700, 0.010, 0.030, 0.050, 0.010, 0.100, 0.010, 0.060, 0.020],
        [0.005, 0.020, 0.250, 0.230, 0.260, 0.010, 0.050, 0.015, 0.060, 0.100],
        [0.005, 0.050, 0.010, 0.040, 0.060, 0.540, 0.190, 0.015, 0.060, 0.030],
    ]
)
STAY = 0.88
TRANSITION = np.full((4, 4), (1 - STAY) / 3) + np.eye(4) * (STAY - (1 - STAY) / 3)
START = np.array([0.7, 0.1, 0.1, 0.1])
#: Lines that a task takes at a time; a longer text is taken alone.
LINES = 1 << 18
#: Rounds of fitting, and the lines of each state that the prior weighs as much as.
ROUNDS, PRIOR = 4, 2_000
#: Share of words in lines that are not prose from which a page is flagged.
SHARE = 0.5



class Model(NamedTuple):
    """Probabilities of the hidden Markov model."""

    start: np.ndarray = START
    transition: np.ndarray = TRANSITION
    emission: np.ndarray = EMISSION


_SEPARATORS = [ord(c) for c in "|•»>,;/、，；·–—→-+~*"]
_ENDS = [ord(c) for c in ".!?。！？…"]
_WIDE_ENDS = [ord(c) for c in "。！？"]
_INVISIBLE = np.zeros(0x110000, bool)
_INVISIBLE[[0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF]] = True


def observe(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The symbol of each line, its size in words (an ideograph is half a word), and the lines of each text."""
    texts = [t.replace("\r\n", "\n").replace("\r", "\n") + "\n" for t in texts]
    _, p, at = codes(texts)
    if len(p):  # characters without width hide words; they go
        seen = ~_INVISIBLE[p]
        at = np.concatenate(([0], np.cumsum(seen)))[at]
        p = p[seen]
    n = len(p)
    kind, word = classes()[p], word_classes()[p]
    breaks = np.flatnonzero(p == 10)
    lines = len(breaks)
    line = np.zeros(n, np.int64)
    line[breaks[:-1] + 1] = 1
    line = np.cumsum(line)

    def count(mask: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(line[mask], weights=None if weight is None else weight[mask], minlength=lines)

    before = np.concatenate(([np.uint32(10)], p[:-1]))
    after = np.concatenate((p[1:], [np.uint32(10)]))
    word_before, word_after = word_classes()[before], word_classes()[after]
    space_before, space_after = classes()[before] == SPACE, classes()[after] == SPACE
    # words
    fresh = word > 0
    fresh[1:] &= (word[1:] != word[:-1]) | (word[1:] == IDEOGRAPH)
    begins = np.flatnonzero(fresh)
    over = np.ones(n + 1, bool)
    over[:n] = fresh | (word == 0)
    stops = np.flatnonzero(over)
    ends = stops[np.searchsorted(stops, begins, side="right")]
    size = np.where(word[begins] == IDEOGRAPH, 0.5, 1.0)
    words = np.bincount(line[begins], weights=size, minlength=lines)
    units = np.bincount(line[begins], minlength=lines)
    lower = np.where((p >= 65) & (p <= 90), p + 32, p).astype(np.uint32)
    plain = span_hashes(lower, begins, ends)
    h = plain ^ (line[begins].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    distinct = np.bincount(line[begins[np.unique(h, return_index=True)[1]]], minlength=lines)
    own_line = line[begins]
    pair = h[1:] ^ (h[:-1] * np.uint64(0xD1B54A32D192ED03))
    pair = pair[own_line[1:] == own_line[:-1]]
    pair_line = own_line[1:][own_line[1:] == own_line[:-1]]
    _, pair_at, pair_count = np.unique(pair, return_index=True, return_counts=True)
    pairs = np.bincount(pair_line[pair_at], minlength=lines)
    top = np.zeros(lines, np.int64)  # how often the commonest two words in a row stand in a line
    np.maximum.at(top, pair_line[pair_at], pair_count)
    # links: an inner dot between letters, or two slashes after a quote, colon or blank
    dot = (p == 46) & (classes()[before] == LETTER) & (classes()[after] == LETTER) & (before < 128) & (after < 128)
    slashes = (p == 47) & (after == 47) & ((before == 58) | (before == 34) | (before == 39) | space_before | (before == 40))
    token = np.cumsum((kind == SPACE) | (p == 34) | (p == 40) | (p == 41) | (p == 60) | (p == 62) | (p == 93))
    linked = dot | slashes
    places = np.flatnonzero(linked)
    places = places[np.unique(token[places], return_index=True)[1]] if len(places) else places
    # "https:" and the address behind it are one token, so a link counts once
    links = np.bincount(line[places], minlength=lines)
    in_link = np.zeros(int(token[-1]) + 1 if n else 1, bool)
    in_link[token[places]] = True
    outside = np.bincount(line[begins], weights=np.where(in_link[token[begins]], 0, size), minlength=lines)
    hashtags = count((p == 35) & (word_after > 0) & (space_before | (before == 10)))
    end = np.isin(p, _ENDS) & ~np.isin(after, _ENDS)
    end &= (np.isin(p, _WIDE_ENDS) | space_after | np.isin(after, [34, 39, 41, 93, 0x201D, 0x2019, 0xBB])) & ((word_before > 0) | np.isin(before, [34, 39, 41, 93, 0x201D, 0x2019, 0xBB, 37, 0xFF09])) | (np.isin(p, _WIDE_ENDS) & ~np.isin(after, _ENDS))
    end[2:] &= p[:-2] != 46  # letters with dots between them end nothing
    sentences = count(end)
    own = np.isin(p, _SEPARATORS)
    wide = np.isin(p, [ord(c) for c in "、，；•»|"])
    comma = np.isin(p, [44, 59]) & space_after
    apart = own & ~wide & ~np.isin(p, [44, 59]) & space_before & space_after
    separators = count((wide | comma | apart) & ~in_link[token])
    crumbs = count((p == 62) & space_before & space_after)
    cells = count(p == 124)
    # does the last word-like thing before the line break end a sentence?
    segment = outside / (separators + 1)
    out = np.full(lines, LOOSE, np.int8)
    out[(words <= 12)] = PLAIN
    out[words == 0] = EMPTY
    listing = (separators >= 4) & (segment <= np.where(separators >= 5, 6.5, 4.5)) & (sentences <= separators / 8)
    row = (cells >= 2) & (sentences == 0) & (words / (cells + 1) <= 5) & (words > 0)
    out[listing | row] = LISTING
    out[(crumbs >= 2) & (sentences == 0) & (words / (crumbs + 1) <= 5)] = CRUMBS
    few = distinct < units.astype(float) ** 0.7
    # whole sentences that come again leave any two words rare among the others; a keyword does not
    dense = (top >= 4) & (top * 12 >= units)
    again = (units >= 16) & (pairs < 0.9 * units.astype(float) ** 0.85) & dense
    stuffed = (units >= 10) & few & ((sentences * 40 < units) | dense) | again
    out[stuffed] = STUFFED
    said = (sentences >= 1) & (words >= 2.5) & (words / np.maximum(sentences, 1) <= 80) & ~(dense & (distinct < 0.3 * units))
    out[said & ~listing & ~again] = SENTENCES
    out[(links >= 1) & (outside <= links * 9) & (sentences <= links / 4)] = LINK
    out[(hashtags >= 2) & (hashtags * 3 >= words)] = HASHTAGS
    # short lines without a sentence that share half of their words, two at least, with the line before or after
    colons = count((p == 58) | (p == 0xFF1A))
    open_line = ((out == PLAIN) | (out == LOOSE) & (words <= 20)) & (colons == 0)
    mine = open_line[own_line]
    key = plain[mine]
    at_line = own_line[mine].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    step = np.uint64(0x9E3779B97F4A7C15)
    here = key ^ at_line
    shared = np.isin(key ^ (at_line - step), here) | np.isin(key ^ (at_line + step), here)
    common = np.bincount(own_line[mine][shared], minlength=lines)
    out[open_line & (common >= 2) & (common * 2 >= units)] = ECHO
    return out, words, np.diff(np.searchsorted(breaks, at))


def viterbi(symbols: np.ndarray, words: np.ndarray, counts: np.ndarray, model: Model = Model()) -> np.ndarray:
    """The most likely state of each line of each text; all texts advance together, longest first, so that the work is
    in arrays over texts. A long line weighs as much as the several short ones it could have been broken into."""
    weight = 1 + np.log2(1 + words / 12)
    logs, steps = np.log(model.emission), np.log(model.transition)
    at = np.concatenate(([0], np.cumsum(counts)))[:-1]
    order = np.argsort(-counts, kind="stable")
    at, left = at[order], counts[order]
    out = np.zeros(len(symbols), np.int8)
    back = np.zeros((len(symbols), 4), np.int8)
    score = np.log(model.start) + logs[:, symbols[at]].T * weight[at, None] if len(at) and len(symbols) else np.zeros((0, 4))
    last = score.copy()
    live = len(at)
    longest = int(left[0]) if len(left) else 0
    shorter = np.searchsorted(-left, -np.arange(longest + 1), side="left")
    for i in range(1, longest):
        live = int(shorter[i])
        options = score[:live, :, None] + steps
        best = options.argmax(axis=1)
        rows = at[:live] + i
        back[rows] = best
        score[:live] = np.take_along_axis(options, best[:, None, :], axis=1)[:, 0] + logs[:, symbols[rows]].T * weight[rows, None]
        last[:live] = score[:live]
    state = last.argmax(axis=1).astype(np.int8)
    for i in range(longest - 1, -1, -1):
        live = int(shorter[i])
        rows = at[:live] + i
        out[rows] = state[:live]
        state[:live] = back[rows, state[:live]]
    return out


def expected(symbols: np.ndarray, words: np.ndarray, counts: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The probability of each state at each line (forward-backward), and the expected number of each transition."""
    weight = 1 + np.log2(1 + words / 12)
    seen = np.exp(np.log(model.emission)[:, symbols].T * weight[:, None])
    seen /= seen.max(axis=1, keepdims=True)
    at = np.concatenate(([0], np.cumsum(counts)))[:-1]
    order = np.argsort(-counts, kind="stable")
    at, left = at[order], counts[order]
    longest = int(left[0]) if len(left) else 0
    shorter = np.searchsorted(-left, -np.arange(longest + 1), side="left")
    ahead, behind = np.zeros((len(symbols), 4)), np.ones((len(symbols), 4))
    some = at[left > 0]
    ahead[some] = model.start * seen[some]
    ahead[some] /= ahead[some].sum(axis=1, keepdims=True)
    for i in range(1, longest):
        rows = at[: int(shorter[i])] + i
        now = (ahead[rows - 1] @ model.transition) * seen[rows]
        ahead[rows] = now / now.sum(axis=1, keepdims=True)
    steps = np.zeros((4, 4))
    for i in range(longest - 1, 0, -1):
        rows = at[: int(shorter[i])] + i
        after = seen[rows] * behind[rows]
        pair = ahead[rows - 1][:, :, None] * model.transition * after[:, None, :]
        steps += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        now = after @ model.transition.T
        behind[rows - 1] = now / now.sum(axis=1, keepdims=True)
    both = ahead * behind
    return both / np.maximum(both.sum(axis=1, keepdims=True), 1e-300), steps


def sums(symbols: np.ndarray, words: np.ndarray, counts: np.ndarray, model: Model) -> np.ndarray:
    """The expected numbers of first states, transitions and emissions, one after the other."""
    first = np.concatenate(([0], np.cumsum(counts)))[:-1][counts > 0]
    state, steps = expected(symbols, words, counts, model)
    emission = np.stack([np.bincount(symbols, weights=state[:, k], minlength=EMISSION.shape[1]) for k in range(4)])
    return np.concatenate((state[first].sum(axis=0), steps.ravel(), emission.ravel()))


def updated(total: np.ndarray, prior: float) -> Model:
    """The model of the next round; digits that depend on the order in which sums were added are cut off."""
    start, transition, emission = prior * START + total[:4], prior * TRANSITION + total[4:20].reshape(4, 4), prior * EMISSION + total[20:].reshape(EMISSION.shape)
    return Model(np.round(start / start.sum(), 12), np.round(transition / transition.sum(axis=1, keepdims=True), 12), np.round(emission / emission.sum(axis=1, keepdims=True), 12))


def fit(symbols: np.ndarray, words: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS, prior: float = PRIOR) -> Model:
    """Baum-Welch rounds from the prior, which counts as `prior` lines of each state (and texts, for the start)."""
    model = Model()
    for _ in range(rounds if len(symbols) else 0):
        model = updated(sums(symbols, words, counts, model), prior)
    return model


def _observed(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, filled, symbols, halves): the symbols of each text's lines and their sizes in half words, and whether the
    text has any character."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            symbols, words, counts = observe([t or "" for t in batch.column(1).to_pylist()])
            at = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
            lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in (symbols.astype(np.int8), np.rint(2 * words).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *lists], names=[key, "filled", "symbols", "halves"])

    rows = df.select(key, text, F.coalesce(F.length(text) > 0, F.lit(False)).alias("filled"))
    return rows.mapInArrow(run, f"`{key}` {kind}, filled boolean, symbols array<tinyint>, halves array<int>")


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """The batches cut so that their texts have about LINES lines together, with symbols, words and lines of the texts."""
    for batch in batches:
        size = np.cumsum(batch.column("symbols").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
        begin = 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(size, (int(size[begin - 1]) if begin else 0) + LINES, side="right")))
            part = batch.slice(begin, end - begin)
            symbols, halves = part.column("symbols"), part.column("halves")
            yield part, symbols.flatten().to_numpy().astype(np.int64), halves.flatten().to_numpy() / 2, symbols.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            begin = end


def fitted(observed: DataFrame, rounds: int = ROUNDS, prior: float = PRIOR) -> Model:
    """The model fitted to all texts that aren't empty. observed comes from _observed and is read in every round."""
    model = Model()
    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], model: Model = model) -> Iterator[pa.RecordBatch]:
            total = np.zeros(20 + EMISSION.size)
            for _, symbols, words, counts in _lines(batches):
                total += sums(symbols, words, counts, model)
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tolist()], pa.list_(pa.float64()))], names=["task", "sums"])

        tasks = observed.where("filled").select("symbols", "halves").mapInArrow(run, "task int, sums array<double>").collect()
        model = updated(sum((np.array(r.sums) for r in sorted(tasks, key=lambda r: r.task)), np.zeros(20 + EMISSION.size)), prior)
    return model


def label_pages(df: DataFrame, key: str = "doc_id", text: str = "text", share: float = SHARE, model: Model | None = None) -> DataFrame:
    """(key, n_words, links, tags, menu, is_spam): words of each text and the words in lines of each kind that isn't
    prose. Null and empty texts and texts without a word have no words and are never spam; a text without line breaks
    is one line; repeated rows come out as often; an empty table gives an empty result; other columns are ignored. The
    model is fitted to the texts unless one is given."""
    kind = df.schema[key].dataType.simpleString()
    observed = _observed(df, key, text)
    if model is None:
        ensure_checkpoint_dir(df.sparkSession)
        observed = observed.checkpoint()
        model = fitted(observed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, symbols, words, counts in _lines(batches):
            states = viterbi(symbols, words, counts, model)
            of = np.repeat(np.arange(len(counts)), counts)
            own = [np.bincount(of, weights=words * (states == s), minlength=len(counts)) for s in range(4)]
            total = sum(own)
            spam = (total > 0) & (total - own[PROSE] >= share * total)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.float64()) for x in (total, *own[1:])), pa.array(spam)], names=[key, "n_words", "links", "tags", "menu", "is_spam"])

    return observed.select(key, "symbols", "halves").mapInArrow(run, f"`{key}` {kind}, n_words double, links double, tags double, menu double, is_spam boolean")
