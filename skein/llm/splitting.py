"""Cutting oversized texts into pieces of bounded size with overlap, at balanced targets snapped to natural borders."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.encode import TOKENIZERS, encoder
from skein.llm.text import IDEOGRAPH, codes, slices, word_classes
from skein.operators.running import running_sum

BLANKS = " \t\r\n"
#: Strength of a border: paragraph, line, sentence, clause, word, none, never (inside a character of several code points).
PARAGRAPH, LINE, SENTENCE, CLAUSE, WORD, NOWHERE, NEVER = 5, 4, 3, 2, 1, 0, -1


@cache
def _marks() -> np.ndarray:
    """Per code point: SENTENCE or CLAUSE for marks that end one, NEVER for characters that belong to the one before."""
    table = np.zeros(0x110000, np.int8)
    for c in range(0x110000):
        if unicodedata.category(chr(c)) in ("Mn", "Me", "Mc"):
            table[c] = NEVER
    table[[0x200D, *range(0xFE00, 0xFE10), *range(0x1F3FB, 0x1F400)]] = NEVER
    table[[ord(c) for c in ".!?。！？…"]] = SENTENCE
    table[[ord(c) for c in ",;:，；：、|—–"]] = CLAUSE
    return table


def strengths(text: str) -> np.ndarray:
    """How strong the border before each code point (and after the last) is."""
    _, p, _ = codes([text])
    n = len(p)
    s = np.zeros(n + 1, np.int8)
    marks, word = _marks()[p], word_classes()[p]
    white = np.isin(p, [32, 9, 13, 10, 0xA0, 0x3000])
    before, after = p[:-1], p[1:]
    inner = s[1:n]
    inner[white[:-1] & ~white[1:]] = WORD
    inner[(word[:-1] == IDEOGRAPH) | (word[1:] == IDEOGRAPH)] = NOWHERE
    inner[white[:-1] & ~white[1:]] = WORD
    ends = np.maximum(marks, 0)
    last = ends.copy()  # the mark that a run of closing signs and blanks comes after
    closing = np.isin(p, [ord(c) for c in "\"')]”’»」』）】"]) | white
    index = np.where(~closing, np.arange(n), -1)
    index = np.maximum.accumulate(index)
    last = np.where(index >= 0, ends[np.maximum(index, 0)], 0)
    ascii_mark = (p < 128) & (ends > 0)
    strong = np.where(white | ~ascii_mark, last, 0)  # a dot inside a number or an address ends nothing
    fits = ~white[1:] & ~closing[1:] & (strong[:-1] > 0) & (ends[1:] == 0)
    inner[fits] = np.maximum(inner[fits], strong[:-1][fits])
    lines = before == 10
    inner[lines] = LINE
    double = np.zeros(n - 1, bool) if n > 1 else np.zeros(0, bool)
    if n > 2:
        quiet = np.where((p == 10) | ~white, np.arange(n), -1)
        quiet = np.maximum.accumulate(quiet)  # last code point that is a line feed or no blank
        prior = np.where(np.arange(n) > 0, quiet[np.maximum(np.arange(n) - 1, 0)], -1)
        double = lines & (prior[:-1] >= 0) & (p[np.maximum(prior[:-1], 0)] == 10)
    inner[double] = PARAGRAPH
    inner[(marks[1:] == NEVER) | (before == 0x200D) | ((before == 13) & (after == 10))] = NEVER
    return s


def cuts(s: np.ndarray, n: int, limit: int, overlap: int) -> list[int]:
    """Where to cut a text of n code points: piece i is [cut i-1 - overlap, cut i), at most limit long. As few pieces
    as possible at equal targets, each snapped to the strongest border near it; a piece more if a cut would fall where
    there is no border though the text has one within reach. A cut and the beginning of the piece after it, `overlap`
    before, both stay out of characters of several code points as long as there is such a place."""
    s = s.copy()
    s[overlap:][s[: n + 1 - overlap] == NEVER] = NEVER  # the next piece would begin inside a character
    step = limit - overlap
    least = max(1, -(-(n - overlap) // step))
    if n <= limit:
        return [n]
    fallback: list[int] | None = None
    for pieces in range(least, 2 * least + 2):
        size, out, natural, at = n / pieces, [], True, 0
        for i in range(1, pieces):
            low = max(n - (pieces - i) * step, at + 1, overlap + 1)
            high = min(at + (step if at else limit), n - 1)
            if low > high:
                break
            target = min(max(round(i * size), low), high)
            reach = max(40, int(size / 4))
            a, b = max(low, target - reach), min(high, target + reach)
            window = s[a : b + 1]
            best = window.max()
            if best == NEVER:
                a, window = low, s[low : high + 1]
                best = min(window.max(), NOWHERE)
            if best <= NOWHERE:
                natural = natural and s[max(low, at + 1) : high + 1].max() <= NOWHERE and s[at + 1 : at + step + 1].max() <= NOWHERE
                best = max(best, NOWHERE) if (window == NOWHERE).any() else best
            places = np.flatnonzero(window == best) + a
            at = int(places[np.argmin(np.abs(places - target))])
            out.append(at)
        else:
            if n - at <= step:
                out.append(n)
                if natural:
                    return out
                fallback = fallback or out
    return fallback or [min(limit + k * step, n) for k in range(least)]


def split(text: str, limit: int, overlap: int, tokens: int | None = None, count: Callable[[list[str]], np.ndarray] | None = None) -> list[tuple[int, str]]:
    """(offset, piece) of the text without outer blanks; dropping the first `overlap` characters of every piece but
    the first gives that text back. If tokens is given, count gives the tokens of texts and no piece has more: the
    pieces get shorter until it holds, and where they would come near the overlap, without overlap."""
    text = text.strip(BLANKS)
    over = lambda parts: tokens is not None and int(count(parts).max()) > tokens
    if len(text) <= limit and not over([text]):
        return [(0, text)]
    strong, most = strengths(text), min(limit, max(1, len(text) - 1)) if len(text) <= limit else limit
    while True:
        overlap = overlap if most >= overlap + max(1, overlap // 4) else 0
        out, before = [], 0
        for cut in cuts(strong, len(text), most, overlap):
            begin = max(0, before - overlap) if before else 0
            out.append((begin, text[begin:cut]))
            before = cut
        if most == 1 or not over([piece for _, piece in out]):
            return out
        most = max(1, most * 4 // 5)


def split_oversized(df: DataFrame, key: str, text: str, document: str, number: str, parent: str, limit: int = 800, overlap: int = 120, tokens: int | None = None, tokenizer: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """The pieces of all rows whose text, without blanks, tabs, CR and LF at both ends, has more than limit code
    points, or more than `tokens` tokens if that is given: (key, document, parent, old number, piece_no, n_pieces, begin,
    piece_text, char_count, token_count). Pieces keep both limits and are numbered from 0 within their row, so (number,
    piece_no) is their order and their parent stays. token_count is counted with the given public tokenizer.

    Null, empty and short texts give no piece; a text without any border is cut at the limit; repeated rows are split
    each; null numbers and parents stay null; an empty table gives an empty result; other columns are ignored."""
    if not 0 <= overlap < limit or tokens is not None and tokens < 16:
        raise ValueError("overlap must be smaller than limit, and tokens at least 16")
    own = [key, document, parent, number]
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer)
        for batch in slices(batches, 4):
            rows, parts = [], []
            for i, value in enumerate(batch.column(4).to_pylist()):
                found = split(value, limit, overlap, tokens, code.counts)
                if len(found) > 1:
                    rows += [i] * len(found)
                    parts += [(k, len(found), begin, piece) for k, (begin, piece) in enumerate(found)]
            take = pa.array(rows, pa.int64())
            cols = list(zip(*parts)) or [[], [], [], []]
            length = [len(x) for x in cols[3]]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(take) for c in range(4)), *(pa.array(c, pa.int32()) for c in cols[:3]), pa.array(cols[3], pa.string()), pa.array(length, pa.int32()), pa.array(code.counts(list(cols[3])), pa.int32())],
                names=[*own, "piece_no", "n_pieces", "begin", "piece_text", "char_count", "token_count"],
            )

    bare = F.btrim(F.col(text), F.lit(BLANKS))
    long = F.length(bare) > limit
    if tokens is not None:  # a token has a byte at least
        long = long | (F.octet_length(bare) > tokens)
    large = df.select(*own, text).where(long)
    return large.mapInArrow(run, f"{fields}, piece_no int, n_pieces int, begin int, piece_text string, char_count int, token_count int")


def renumbered(rows: DataFrame, pieces: DataFrame, key: str, document: str, number: str) -> DataFrame:
    """New consecutive numbers from 1 for all rows of a document, pieces in place of their rows: (key, piece_no,
    new_number). rows has every row (key, document, number); rows without a number come last. Only keys and numbers
    are sorted, and a document of any size is spread over as many tasks as it needs."""
    every = rows.select(key, document, number).join(pieces.select(key, "piece_no"), key, "left")
    every = every.select(key, "piece_no", F.col(document).alias("__document"), F.col(number).isNull().alias("__last"), F.col(number).alias("__number"), F.lit(1).alias("__one"))
    placed = running_sum(every, "__document", ["__last", "__number", key, "piece_no"], "__one", "__at")
    return placed.select(key, "piece_no", (F.col("__at") + 1).alias("new_number"))
