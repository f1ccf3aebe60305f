"""One consistent form for texts that look the same but differ in their characters.

Characters without a mark are deleted, width forms and ligatures are resolved, accents are stored one
way and blanks become single spaces. For letters, every token is a lattice: at each place stand the letters
of one shape, one of each script that the corpus is written in. The Viterbi path with the fewest changes of
script, and among these the best score under character bigrams of the corpus, is the token's form. The
lattice depends on shapes alone, so tokens that look the same get the same form, and since every path keeps the
shapes, tokens that look different never do.

Which letters are shaped like a Latin one is read off the list of confusable letters that Unicode publishes
and Spark's own ICU library holds; the few letters below go before it. Two letters of one script other than
Latin never share a shape by that list alone, so that texts of that script keep their letters. Circled,
squared and raised letters are visibly different.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Letters shaped like the Latin letter in the same place of the line above them.
CYRILLIC_SHAPES = "acdehijlopqsvwxyyABCEGHIIJKMOPQSTVWXYY"
CYRILLIC = "асԁеһіјӏорԛѕѵԝхуүАВСЕԌНІӀЈКМОРԚЅТѴԜХУҮ"
GREEK_SHAPES = "acijopuvxABCEHIJKMNOPTXYZ"
GREEK = "αϲιϳορυνχΑΒϹΕΗΙͿΚΜΝΟΡΤΧΥΖ"
ARMENIAN_SHAPES = "ghjnoquLOSU"
ARMENIAN = "ցհյոօզսԼՕՏՍ"
PAIRED = ((CYRILLIC_SHAPES, CYRILLIC), (GREEK_SHAPES, GREEK), (ARMENIAN_SHAPES, ARMENIAN))

SWITCH = 1e6
KINDS_OF_FORM = {"<wide>", "<narrow>", "<font>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>"}
LETTERS = re.compile("(?:[^\\W\\d_][\u0300-\u036f]*)+")
CONTROLS = re.compile(r"[\x00-\x08\x0e-\x1b\x7f]")


def _replacements() -> dict[int, str | None]:
    """By rule, for every code point: None for one without a mark, the plain letters of a width or font form or a ligature."""
    visible_formats = {0x600, 0x601, 0x602, 0x603, 0x604, 0x605, 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}
    unmarked = {0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0}
    table: dict[int, str | None] = {0x2800: " "} | dict.fromkeys(unmarked | {*range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)})
    for code in range(sys.maxunicode + 1):
        char = chr(code)
        category = unicodedata.category(char)
        if category == "Cf" and code not in visible_formats or category == "Cc" and not char.isspace():
            table[code] = None
        elif (decomposed := unicodedata.decomposition(char)).startswith("<") and code not in table and not char.isspace():
            kind = decomposed.split(" ", 1)[0]
            if kind in KINDS_OF_FORM or kind == "<compat>" and category in ("Lu", "Ll", "Lo", "Lt", "Nl") and char != "ſ":
                table[code] = unicodedata.normalize("NFKC", char)
    return table


def _script(char: str) -> str:
    """The first word of a character's name, which for letters is its script."""
    return unicodedata.name(char, "NONE").split()[0]


def _published(spark: SparkSession, letters: list[str]) -> dict[str, str]:
    """Of each letter that the published list gives one Latin letter as its shape, that letter.

    In the list capital I looks like small l; capital letters, and those of a script of capitals only, count as I.
    """
    checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    found = {}
    for letter, shape in zip(letters, checker.getSkeleton("\n".join(letters)).split("\n"), strict=True):
        if len(shape) == 1 and shape.isascii() and shape.isalpha():
            capital = unicodedata.category(letter) == "Lu" or _script(letter) == "LISU"
            found[letter] = "I" if shape == "l" and capital else shape
    return found


class Shapes:
    """Tables by rule: what resolves to what, the shape of each letter, and the letters of each script that has shapes."""

    def __init__(self, spark: SparkSession):
        self.replacements = _replacements()
        letters = [chr(code) for code in range(0x80, sys.maxunicode + 1)]
        letters = [c for c in letters if unicodedata.category(c)[0] == "L" and not unicodedata.decomposition(c)]
        self.shape = {letter: shape for shapes, chars in PAIRED for shape, letter in zip(shapes, chars, strict=True)}
        #: Of each shape, its letter in every script that has one.
        self.members: dict[str, dict[str, str]] = {chr(code): {"LATIN": chr(code)} for code in (*range(65, 91), *range(97, 123))}
        for letter, shape in self.shape.items():
            self.members[shape].setdefault(_script(letter), letter)
        for letter, shape in _published(spark, letters).items():
            script = _script(letter)
            if letter not in self.shape and (script == "LATIN" or script not in self.members[shape]):
                self.shape[letter] = shape
                self.members[shape].setdefault(script, letter)
        scripts = sorted({script for others in self.members.values() for script in others})
        #: Lower-case letters of these scripts, numbered within each script, and where its table of pairs begins.
        self.numbered: dict[str, list[str]] = {script: [] for script in scripts}
        for letter in [*map(chr, range(97, 123)), *letters]:
            if letter.lower() == letter and (own := self.numbered.get(_script(letter))) is not None:
                own.append(letter)


class Model:
    """Bigram scores of lower-cased letters within a script, with one added to each count.

    The lattice has the scripts of which the corpus shows adjacent letters, and Latin.
    """

    def __init__(self, shapes: Shapes, bigrams: dict[tuple[int, int], int]):
        self.shapes, self.bigrams = shapes, bigrams
        self.starts: dict[int, int] = {}
        for (before, _), n in bigrams.items():
            self.starts[before] = self.starts.get(before, 0) + n
        self.total = sum(self.starts.values())
        self.letters = sum(map(len, shapes.numbered.values()))
        self.scripts = {_script(chr(before)) for before in self.starts} | {"LATIN"}
        covered = {}
        for shape, others in shapes.members.items():
            for script in others.keys() & self.scripts - {"LATIN"}:
                covered[script] = covered.get(script, "") + shape
        # Tokens that a single foreign script could spell as well as Latin; all other ASCII tokens are their own form.
        spelt = "|".join(f"[{letters}]+" for letters in covered.values()) or "(?!)"
        self.doubtful = re.compile(f"(?<![A-Za-z])(?:{spelt})(?![A-Za-z])")
        self.forms: dict[str, str] = {}

    def cost(self, before: str, char: str) -> float:
        a, b = ord(before.lower()[0]), ord(char.lower()[0])
        return -math.log((self.bigrams.get((a, b), 0) + 1) / (self.starts.get(a, 0) + self.letters))

    def start(self, char: str) -> float:
        return -math.log((self.starts.get(ord(char.lower()[0]), 0) + 1) / (self.total + self.letters))

    def choices(self, shape: str) -> dict[str, str]:
        if (others := self.shapes.members.get(shape)) is None:
            return {_script(shape): shape}
        return {script: letter for script, letter in others.items() if script in self.scripts}

    def best(self, token: str) -> str:
        """The Viterbi path through the lattice of ``token``, shapes and combining marks."""
        if (known := self.forms.get(token)) is not None:
            return known
        paths: list[tuple[float, str, str, str]] = []
        for char in token:
            if "\u0300" <= char <= "\u036f":
                paths = [(cost, script, last, text + char) for cost, script, last, text in paths]
                continue
            choices = self.choices(char)
            if not paths:
                paths = [(self.start(letter), script, letter, letter) for script, letter in choices.items()]
                continue
            paths = [
                min(
                    (cost + (SWITCH if script != before else 0.0) + self.cost(last, letter), script, letter, text + letter)
                    for cost, before, last, text in paths
                )
                for script, letter in choices.items()
            ]
        form = min(paths)[3]
        if len(self.forms) > 500_000:
            self.forms.clear()
        self.forms[token] = form
        return form

    def form(self, text: str) -> str:
        """The consistent form of ``text``, empty where it shows nothing."""
        if text.isascii():
            if CONTROLS.search(text):
                text = CONTROLS.sub("", text)
            return self.doubtful.sub(lambda found: self.best(found[0]), " ".join(text.split()))
        plain = unicodedata.normalize("NFD", " ".join(text.translate(self.shapes.replacements).split()))
        return unicodedata.normalize("NFC", LETTERS.sub(self._token, plain))

    def _token(self, found: re.Match[str]) -> str:
        token = "".join(map(self.shapes.shape.get, found[0], found[0]))
        return self.best(token) if not token.isascii() or self.doubtful.fullmatch(token) else token


class PairTable:
    """Places of the pairs of adjacent letters of one script in one flat table of counts."""

    def __init__(self, numbered: dict[str, list[str]]):
        size = 1 + max(ord(c) for own in numbered.values() for c in own)
        self.number = np.full(size, -1, np.int32)
        self.script = np.full(size, -1, np.int32)
        self.letters = [np.array([ord(c) for c in own], np.int32) for own in numbered.values()]
        widths = np.array([len(own) for own in self.letters])
        self.width, self.start = widths, np.cumsum(widths**2) - widths**2
        self.pairs = int((widths**2).sum())
        for k, own in enumerate(self.letters):
            self.number[own], self.script[own] = np.arange(len(own)), k
        for code in range(size):
            lower = chr(code).lower()
            if self.number[code] < 0 and len(lower) == 1 and ord(lower) < size and self.number[ord(lower)] >= 0:
                self.number[code], self.script[code] = self.number[ord(lower)], self.script[ord(lower)]

    def places(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.where(codes < len(self.number), codes, 0)
        number, script = self.number[codes], self.script[codes]
        kept = (script[:-1] >= 0) & (script[:-1] == script[1:])
        own = script[:-1][kept]
        return self.start[own] + number[:-1][kept] * self.width[own] + number[1:][kept]

    def named(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code points of the letters of each place."""
        own = np.searchsorted(self.start, places, "right") - 1
        first, second = np.divmod(places - self.start[own], self.width[own])
        offsets, flat = np.cumsum([0, *map(len, self.letters[:-1])]), np.concatenate(self.letters)
        return flat[offsets[own] + first], flat[offsets[own] + second]


def train_bigrams(texts: DataFrame, text_col: str = "text", shapes: Shapes | None = None) -> DataFrame:
    """Counts of adjacent letters of one script over all texts: ``before, after`` (code points), ``n``.

    Letters of all scripts that have a letter shaped like a Latin one count. The result is bounded by the squares
    of these alphabets, and in practice has a few thousand rows, however large the corpus.
    """
    numbered = (shapes or Shapes(texts.sparkSession)).numbered

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = PairTable(numbered)
        counts = np.zeros(table.pairs, np.int64)
        for batch in batches:
            counts += np.bincount(table.places("\n".join(x for x in batch.column(0).to_pylist() if x)), minlength=len(counts))
        used = np.flatnonzero(counts)
        before, after = table.named(used)
        yield pa.RecordBatch.from_arrays([pa.array(before), pa.array(after), pa.array(counts[used])], ["before", "after", "n"])

    pairs = texts.select(F.col(text_col)).mapInArrow(count, "before int, after int, n long")
    return pairs.groupBy("before", "after").agg(F.sum("n").alias("n"))


def consistent_forms(texts: DataFrame, key_col: str = "key", text_col: str = "text", bigrams: DataFrame | None = None) -> DataFrame:
    """``key, text, form`` of each row with a non-null key whose text shows something.

    Null, empty and blank texts, and those of unmarked characters alone, have no form and are left out.
    Repeated rows stay. ``bigrams`` are those of :func:`train_bigrams` over the same texts by default; the
    model goes to the tasks as a broadcast whose size the alphabets bound.
    """
    shapes = Shapes(texts.sparkSession)
    if bigrams is None:
        bigrams = train_bigrams(texts, text_col, shapes)
    counted = {(row.before, row.after): row.n for row in bigrams.collect()}
    shared = texts.sparkSession.sparkContext.broadcast((shapes, counted))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for batch in batches:
            stored = batch.column(1).to_pylist()
            forms = pa.array([model.form(text) if text else None for text in stored], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), forms], ["key", "text", "form"])

    chosen = texts.select(F.col(key_col).cast("string").alias("key"), F.col(text_col).cast("string").alias("text"))
    return chosen.where(F.col("key").isNotNull() & F.col("text").isNotNull()).mapInArrow(fill, "key string, text string, form string").where(F.col("form") != "")


def lookalike_pairs(texts: DataFrame, key_col: str = "key", text_col: str = "text") -> DataFrame:
    """Pairs of keys, the smaller first, whose texts have one form but differ: ``left_key, right_key``.

    Forms with a single spelling are found by a pre-aggregated count over 64-bit hashes and never joined, so
    a text that fills a third of the table costs nothing unless it has other spellings. Of the other forms the
    distinct spellings are paired, and only these pairs meet the keys of each spelling: equal texts never meet.
    A key given twice with one text is one row; one given with several texts is none of its own partners.
    """
    forms = consistent_forms(texts, key_col, text_col).withColumn("h", F.xxhash64("form")).persist(StorageLevel.MEMORY_AND_DISK)
    spelling = F.xxhash64("text")
    mixed = (
        forms.groupBy("h").agg(F.min(spelling).alias("least"), F.max(spelling).alias("most")).where("least <> most").select("h")
    )
    chosen = forms.join(mixed, "h", "left_semi").select("key", "text", "form", "h", spelling.alias("s")).persist(StorageLevel.MEMORY_AND_DISK)
    # Of one hash of a spelling the texts are compared again where their keys meet.
    spellings = chosen.groupBy("h", "s").agg(F.min("form").alias("form"))
    one, two = (spellings.select("h", "form", F.col("s").alias(name)) for name in ("s", "t"))
    met = one.join(two, ["h", "form"]).where("s < t").select("h", "s", "t")
    left = chosen.select("h", "s", F.col("key").alias("k"), F.col("text").alias("x")).distinct()
    right = left.select("h", F.col("s").alias("t"), F.col("k").alias("l"), F.col("x").alias("y"))
    pairs = met.join(left, ["h", "s"]).join(right, ["h", "t"]).where((F.col("k") != F.col("l")) & (F.col("x") != F.col("y")))
    return pairs.select(F.least("k", "l").alias("left_key"), F.greatest("k", "l").alias("right_key")).distinct()
