"""Texts larger than a token limit, cut into balanced pieces at natural boundaries with an overlap.

The number of pieces is the least that the limit and the overlap allow. Their ends have targets at equal
distances; each end moves to the strongest boundary near its target: between sections, paragraphs, lines,
sentences or words, or between tokens where a text has no blanks. If a piece would pass the limit, one
more piece is planned.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.llm.bpe_automaton import Automaton, SharedAutomaton

TOKEN, WORD, SENTENCE, LINE, PARAGRAPH, SECTION = range(6)
KINDS = ("token", "word", "sentence", "line", "paragraph", "section", "end")
#: An end may lie this part of the distance between targets away from its target.
REACH = 0.25

SENTENCE_END = re.compile(r"(?:[.!?…]+[\"'”’»)\]]*(?=\s)|[。！？]+[」』”]*)")
LINE_END = re.compile(r"\r\n|[\n\r\u2028\x85]")
PARAGRAPH_END = re.compile(r"(?:(?:\r\n|[\n\r])[ \t]*){2,}|\u2029")
HEADING = re.compile(r"(?:^|(?<=[\n\r]))(?=#{1,6} |\d+(?:\.\d+)*[.)] +\S|[^\W\d_a-z][^\na-z]{2,60}[\n\r])")


#: By rule, for each code point up to the last blank, whether it is a blank.
BLANKS = np.array([*(chr(code).isspace() for code in range(0x3001)), False])


def boundary_strengths(text: str, starts: list[int]) -> list[int]:
    """The strength of a cut before each of the character positions ``starts``, which are sorted."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    # Blanks are looked up one place later, so that a position sees the character before it and its own.
    blank = np.concatenate(([False], BLANKS[np.minimum(codes, len(BLANKS) - 1)], [False]))
    at = np.asarray(starts, np.int64)
    strengths = np.where((at > 0) & (blank[at] | blank[at + 1]), WORD, TOKEN).tolist()

    def mark(position: int, strength: int) -> None:
        """The first token start from ``position`` on that has no blank between them."""
        k = bisect_left(starts, position)
        if k < len(starts) and not text[position : starts[k]].strip():
            strengths[k] = max(strengths[k], strength)

    for pattern, strength in ((SENTENCE_END, SENTENCE), (LINE_END, LINE), (PARAGRAPH_END, PARAGRAPH), (HEADING, SECTION)):
        for found in pattern.finditer(text):
            mark(found.end(), strength)
    return strengths


def whole_characters(automaton: Automaton, word: str, ids: list[int]) -> list[tuple[int, int]]:
    """Of the tokens of a word, the number and character position of each that begins a character."""
    if word.isascii():
        return list(enumerate(accumulate((len(automaton.labels[number]) for number in ids[:-1]), initial=0)))
    offset, ends = 0, {0: 0}
    for i, char in enumerate(word, 1):
        offset += len(char.encode("utf-8", "replace"))
        ends[offset] = i
    offset, found = 0, []
    for k, number in enumerate(ids):
        if offset in ends:
            found.append((k, ends[offset]))
        offset += len(automaton.labels[number])
    return found


class Tokens:
    """The tokens of a text with the character position of each; only those that begin a character may begin a piece.

    ``words`` are the pre-split words, which cover the text, and ``ids`` their tokens. ``numbers`` has the token
    number of each possible cut, ``places`` its character position.
    """

    def __init__(self, automaton: Automaton, text: str, words: list[str], ids: list[list[int]]):
        tokens, chars = (np.fromiter(map(len, x), np.int64, len(words)) for x in (ids, words))
        number, place = (np.concatenate(([0], np.cumsum(x))) for x in (tokens, chars))
        if place[-1] != len(text):
            raise ValueError("the pattern of the tokenizer must cover all of a text")
        self.text, self.count = text, int(number[-1])
        numbers, places = number.tolist(), place.tolist()
        known: dict[str, list[tuple[int, int]]] = {}
        for at in np.flatnonzero(tokens > 1).tolist():
            if (cuts := known.get(words[at])) is None:
                known[words[at]] = cuts = whole_characters(automaton, words[at], ids[at])[1:]
            first, begin = numbers[at], places[at]
            numbers += [first + k for k, _ in cuts]
            places += [begin + i for _, i in cuts]
        self.numbers, self.places = sorted(numbers), sorted(places)


def plan_cuts(tokens: Tokens, strengths: list[int], limit: int, overlap: int, pieces: int) -> list[tuple[int, int]] | None:
    """Begin and end of ``pieces`` pieces, as places in the lists of possible cuts; None if it can't be done.

    A piece begins ``overlap`` tokens before the end of the one before, or as little earlier as needed to
    begin with a whole character.
    """
    numbers = tokens.numbers
    step = (tokens.count - overlap) / pieces
    reach = max(1.0, REACH * step)
    found: list[tuple[int, int]] = []
    begin = 0
    for i in range(pieces - 1):
        target = overlap + (i + 1) * step
        # Far enough that the pieces still to come can hold the rest, near enough for this one's limit.
        least = max(tokens.count - (pieces - 1 - i) * (limit - overlap), (numbers[found[-1][1]] if found else overlap) + 1)
        most = min(numbers[begin] + limit, tokens.count - 1)
        first, last = bisect_left(numbers, max(least, target - reach)), bisect_right(numbers, min(most, target + reach)) - 1
        if first > last:  # nothing within reach: the nearest cut that the limits allow
            first, last = bisect_left(numbers, least), bisect_right(numbers, most) - 1
            if first > last:
                return None
            first = last = min(max(bisect_left(numbers, target), first), last)
        end = max(range(first, last + 1), key=lambda k: (strengths[k], -abs(numbers[k] - target)))
        found.append((begin, end))
        begin = bisect_right(numbers, numbers[end] - overlap) - 1
        if begin <= found[-1][0]:
            return None
    end = len(numbers) - 1
    if tokens.count - numbers[begin] > limit:
        return None
    return [*found, (begin, end)]


def split_text(automaton: Automaton, text: str | None, limit: int | None, overlap: int | None) -> list[tuple]:
    """The pieces of a text as (piece, begin_token, end_token, n_tokens, overlap, boundary, text).

    A text within the limit, or one without a limit, is one piece; an empty or null text has none. ``boundary``
    is what the piece's end was cut at. ``n_tokens`` is counted anew on the piece's own text. An overlap of at least the
    limit is cut to half of it. Where even single characters have more tokens than the limit, pieces of one
    character pass it.
    """
    if not text:
        return []
    words = automaton.pattern.findall(text)
    ids = list(map(automaton.words.__getitem__, words))
    count = sum(map(len, ids))
    if limit is None or limit < 1 or count <= limit:
        return [(1, 0, count, count, 0, "end", text)]
    overlap = max(0, min(overlap or 0, limit // 2 if (overlap or 0) >= limit else overlap or 0))
    tokens = Tokens(automaton, text, words, ids)
    strengths = boundary_strengths(text, tokens.places)
    pieces = max(2, -(-(tokens.count - overlap) // (limit - overlap)))
    while True:
        cuts = plan_cuts(tokens, strengths, limit, overlap, pieces)
        if cuts is not None:
            out, before = [], 0
            for k, (begin, end) in enumerate(cuts, 1):
                part = text[tokens.places[begin] : tokens.places[end]]
                boundary = KINDS[strengths[end]] if k < len(cuts) else "end"
                out.append((k, tokens.numbers[begin], tokens.numbers[end], automaton.count(part), before - tokens.numbers[begin] if k > 1 else 0, boundary, part))
                before = tokens.numbers[end]
            if all(piece[3] <= limit for piece in out):
                return out
        if pieces >= len(tokens.numbers):
            break
        pieces = min(len(tokens.numbers), pieces + max(1, pieces // 16))
    out = []
    for k in range(len(tokens.numbers) - 1):
        part = text[tokens.places[k] : tokens.places[k + 1]]
        out.append((k + 1, tokens.numbers[k], tokens.numbers[k + 1], automaton.count(part), 0, KINDS[TOKEN], part))
    return out


PIECES = "piece int, begin_token int, end_token int, n_tokens int, overlap int, boundary string, text string"


def split_documents(
    documents: DataFrame,
    limits: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    path: str | None = None,
    pattern: str | None = None,
    cut_only: bool = False,
) -> DataFrame:
    """The pieces of each document: ``id_col`` and the columns of :func:`split_text`.

    With ``cut_only`` the documents that stay whole are left out; those with no more bytes than the limit has
    tokens are among these, as a token has a byte at least, and are never encoded.

    Documents of a source without a row in ``limits``, or with a null source, have no limit and stay whole;
    empty and null texts have no piece. Of limits given twice, the smallest hold. Documents given twice
    come out twice. The table of limits has one row a source and is broadcast.
    """
    shared = SharedAutomaton(documents, path, pattern)
    kind = documents.schema[id_col].dataType.simpleString()
    bounds = limits.groupBy("source").agg(F.min("max_tokens").alias("limit"), F.min("overlap_tokens").alias("overlap"))
    chosen = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(source_col).alias("source"))
    joined = chosen.join(F.broadcast(bounds), "source", "left").select("id", "text", "limit", "overlap")
    if cut_only:
        joined = joined.where((F.col("limit") >= 1) & (F.octet_length("text") > F.col("limit")))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.get()
        for batch in batches:
            numbers, rows = [], []
            for place, (text, limit, overlap) in enumerate(zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)))):
                found = split_text(automaton, text, limit, overlap)
                if cut_only and len(found) < 2:
                    continue
                rows += found
                numbers += [place] * len(found)
            columns = list(zip(*rows)) if rows else [()] * 7
            kinds = (*[pa.int32()] * 5, pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(numbers, pa.int64())), *(pa.array(x, k) for x, k in zip(columns, kinds))],
                ["id", "piece", "begin_token", "end_token", "n_tokens", "overlap", "boundary", "text"],
            )

    return joined.mapInArrow(split, f"id {kind}, {PIECES}").withColumnRenamed("id", id_col)
