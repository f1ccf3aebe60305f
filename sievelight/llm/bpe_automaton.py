"""Encoding with a byte-level BPE tokenizer by an automaton compiled from its merges.

The automaton reads tokens: a path is accepted exactly if merging in rank order gives that token
sequence. It starts as one state with a loop for each byte, and every merge (a, b) -> ab is applied as a
gadget, in rank order: the state q that a-arcs enter is copied without its b-arc, the a-arcs are sent to
the copy, and each state with an a-arc gets an ab-arc to the target of q's b-arc. All arcs of one label
always enter one state, and a copy differs from its original by one missing arc, so a state is stored as
(owner a, time), where the copies of one owner form a chain: the times at which their arcs went missing are
kept by (owner, token), and an arc is looked up chain by chain. The driver compiles the automaton once and
broadcasts it.

Text is pre-split by the tokenizer's public pattern. A word is encoded by walking a byte table (a trie
of the arc labels) from every position that the accepted path has reached; since merging is
deterministic, exactly one path reaches each position. Decoding emits the arc labels.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROOT = 0
WORDS_KEPT = 400_000


def default_tokenizer() -> str:
    """Place of the file of ``byte_bpe_50k`` where the package of public vocabularies is installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for the 256 bytes: printable Latin-1 as itself, the rest from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(hidden)}


class WordMemo(dict):
    """What ``make`` gives for each word, kept for words of ordinary length."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word: str):
        made = self.make(word)
        if len(word) <= 64:
            if len(self) > WORDS_KEPT:
                self.clear()
            self[word] = made
        return made


class Automaton:
    """The compiled tokenizer: ``content`` is the text of its JSON file."""

    def __init__(self, content: str, pattern: str):
        model = json.loads(content)["model"]
        letters = _byte_letters()
        vocabulary: dict[str, int] = model["vocab"]
        size = max(vocabulary.values()) + 1
        self.pattern_text = pattern
        self.labels: list[bytes] = [b""] * size
        self.made = [-1] * size  # time of the merge that made the token
        self.head = [-1] * size  # its first part
        self.target = [ROOT] * size  # the state that its arcs enter
        self.owner, self.base, self.born = [-1], [-1], [-1]
        self.removed: dict[int, int] = {}  # by owner and token, when the arc went missing
        for token, number in vocabulary.items():
            if all(letter in letters for letter in token):
                self.labels[number] = bytes(letters[letter] for letter in token)
        for time, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self._gadget(time, vocabulary[left], vocabulary[right], vocabulary[left + right])
        self._table()
        if any(self.token_at[self.next.get(byte, 0)] < 0 for byte in range(256)):
            raise ValueError("the vocabulary must have a token for each byte")
        self._prepare()

    def _prepare(self) -> None:
        self.pattern = regex.compile(self.pattern_text)
        self.steps: dict[int, bool] = {}
        self.words = WordMemo(self.encode_word)
        self.sizes = WordMemo(lambda word: len(self.words[word]))

    def __getstate__(self) -> dict:
        return {name: value for name, value in self.__dict__.items() if name not in ("pattern", "steps", "words", "sizes")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._prepare()

    def _gadget(self, time: int, left: int, right: int, merged: int) -> None:
        if self.made[merged] >= 0:
            raise ValueError("a token made by two merges is not supported")
        self.made[merged], self.head[merged] = time, left
        entered = self.target[left]
        if not self.allows(entered, right):
            self.labels[merged] = b""  # no text reaches this token
            return
        self.target[merged] = self.target[right]
        self.removed[left << 20 | right] = time
        self.owner.append(left)
        self.base.append(self.base[entered] if self.owner[entered] == left else entered)
        self.born.append(time)
        self.target[left] = len(self.owner) - 1

    def allows(self, state: int, token: int) -> bool:
        """Whether ``state`` has an arc with the label ``token``: neither the token nor, before it was made, its head went missing."""
        owner, base, born, removed = self.owner, self.base, self.born, self.removed
        until = len(self.made)
        while True:
            at = state
            while at != ROOT:
                time = removed.get(owner[at] << 20 | token)
                if time is not None and time <= until and time <= born[at]:
                    return False
                at = base[at]
            if self.made[token] < 0:
                return True
            until, token = self.made[token], self.head[token]

    def _table(self) -> None:
        self.next: dict[int, int] = {}
        self.token_at: list[int] = [-1]
        for number, label in enumerate(self.labels):
            if not label or self.made[number] < 0 and len(label) > 1:
                continue
            node = 0
            for byte in label:
                node = self.next.setdefault(node << 8 | byte, len(self.token_at))
                if node == len(self.token_at):
                    self.token_at.append(-1)
            self.token_at[node] = number

    def encode_word(self, word: str) -> list[int]:
        """Token ids of one pre-split word."""
        data = word.encode("utf-8", "replace")
        length = len(data)
        states = [-1] * (length + 1)
        arcs = [(-1, -1)] * (length + 1)
        states[0] = ROOT
        follow, token_at, steps = self.next, self.token_at, self.steps
        for begin in range(length):
            state = states[begin]
            node = 0
            for end in range(begin, length):
                node = follow.get(node << 8 | data[end], -1)
                if node < 0:
                    break
                token = token_at[node]
                if token < 0 or states[end + 1] >= 0:
                    continue
                key = state << 20 | token
                allowed = steps.get(key)
                if allowed is None:
                    if len(steps) > 2_000_000:
                        steps.clear()
                    steps[key] = allowed = self.allows(state, token)
                if allowed:
                    states[end + 1] = self.target[token]
                    arcs[end + 1] = (begin, token)
        ids = []
        while length:
            length, token = arcs[length]
            ids.append(token)
        return ids[::-1]

    def word_ids(self, word: str) -> list[int]:
        return self.words[word]

    def encode(self, text: str | None) -> list[int]:
        """Token ids of a text; none of an empty or null one."""
        return list(chain.from_iterable(map(self.words.__getitem__, self.pattern.findall(text or ""))))

    def count(self, text: str | None) -> int:
        return sum(map(self.sizes.__getitem__, self.pattern.findall(text or "")))

    def decode(self, ids: list[int] | None) -> str | None:
        """The text of the labels of ``ids``; null of null."""
        return None if ids is None else b"".join(self.labels[i] for i in ids).decode("utf-8", "replace")


_compiled: dict[int, Automaton] = {}


class SharedAutomaton:
    """The tokenizer, compiled once by the driver and broadcast to the tasks.

    Its size is that of one vocabulary, whatever the corpus. The driver reads the file, so executors need no
    copy of it. A Python worker keeps the automaton, with the words it has met, for its later tasks.
    """

    def __init__(self, frame: DataFrame, path: str | None = None, pattern: str | None = None):
        with open(path or default_tokenizer(), encoding="utf-8") as file:
            content = file.read()
        pattern = pattern or default_pattern()
        self.key = hash((content, pattern))
        if self.key not in _compiled:
            _compiled.clear()
            _compiled[self.key] = Automaton(content, pattern)
        self.compiled = frame.sparkSession.sparkContext.broadcast(_compiled[self.key])

    def get(self) -> Automaton:
        if self.key not in _compiled:
            _compiled.clear()
            _compiled[self.key] = self.compiled.value
        return _compiled[self.key]


def encode_texts(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None
) -> DataFrame:
    """``id_col, ids array<int>`` of each row, without special tokens.

    An empty or null text has the empty list. Every row comes out, repeated ones and those with a null id
    too; other columns are ignored; an empty table gives an empty result. Strings of special tokens in a
    text are ordinary text. There is no shuffle.
    """
    shared = SharedAutomaton(documents, path, pattern)
    kind = documents.schema[id_col].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.get()
        for batch in batches:
            ids = [automaton.encode(text) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    coded = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return coded.mapInArrow(encode, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def count_tokens(
    documents: DataFrame, keep: list[str], text_col: str = "text", path: str | None = None, pattern: str | None = None
) -> DataFrame:
    """The columns ``keep`` of each row and the number of its tokens as ``n_tokens``, 0 for an empty or null text."""
    shared = SharedAutomaton(documents, path, pattern)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.get()
        for batch in batches:
            counts = pa.array([automaton.count(text) for text in batch.column(len(keep)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], counts], [*keep, "n_tokens"])

    kinds = [f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in keep]
    chosen = documents.select(*keep, F.col(text_col).cast("string").alias("__text"))
    return chosen.mapInArrow(count, ", ".join([*kinds, "n_tokens long"]))


def decode_ids(
    encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None, pattern: str | None = None
) -> DataFrame:
    """``id_col, text`` of each row of ids: the labels of its arcs in order; null ids give a null text."""
    shared = SharedAutomaton(encoded, path, pattern)
    kind = encoded.schema[id_col].dataType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.get()
        for batch in batches:
            texts = [automaton.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    chosen = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return chosen.mapInArrow(decode, f"id {kind}, text string").withColumnRenamed("id", id_col)
