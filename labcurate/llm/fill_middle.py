"""Fill-in-middle: texts are cut into prefix, middle and suffix at unit boundaries that a sparse checkpoint index finds.

While the units of a text are counted, their byte and code-point offsets are recorded every STEP units.  A cut searches the
checkpoints by bisection and scans the few units that follow, so only two short stretches are read again.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labcurate.llm.common import bounded_batches, small_batches

#: Units between two checkpoints, and bytes counted at a time.
STEP = 256
WINDOW = 1 << 16
# The marks of the three parts, and the forms.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Of a hundred texts so many are cut, and so many of the cut ones put the suffix first.
CUT_RATE, SPM_RATE = 90, 20
#: Texts of this many bytes in a batch.  A batch's outputs stand beside it.
BATCH = 2 << 20

# A unit is a run of A-Z and a-z or any other single code point, here as bytes of UTF-8.
_UNIT = re.compile(rb"[A-Za-z]+|[^A-Za-z][\x80-\xbf]*")
_LETTER = np.zeros(256, bool)
_LETTER[ord("A") : ord("Z") + 1] = _LETTER[ord("a") : ord("z") + 1] = True


class Units:
    """Units of one UTF-8 text: how many, and where each begins."""

    def __init__(self, text: bytes):
        self.text = text
        self.count = self.chars = 0
        self.numbers, self.at_byte, self.at_char = [0], [0], [0]
        in_word = False
        for low in range(0, len(text), WINDOW):
            b = np.frombuffer(text, np.uint8, min(WINDOW, len(text) - low), low)
            letter, first = _LETTER[b], (b & 0xC0) != 0x80
            after_letter = np.concatenate(([in_word], letter[:-1]))
            starts = np.flatnonzero(first & ~(letter & after_letter))
            due = np.arange(-self.count % STEP, len(starts), STEP)
            if len(due):
                points = np.cumsum(first)
                self.numbers.extend((self.count + due).tolist())
                self.at_byte.extend((low + starts[due]).tolist())
                self.at_char.extend((self.chars + points[starts[due]] - 1).tolist())
            self.count += len(starts)
            self.chars += int(np.count_nonzero(first))
            in_word = bool(letter[-1])

    def offset(self, unit: int) -> tuple[int, int]:
        """Byte and code point where ``unit`` begins; the end of the text for ``count``."""
        if unit >= self.count:
            return len(self.text), self.chars
        k = bisect_right(self.numbers, unit) - 1
        byte, char = self.at_byte[k], self.at_char[k]
        for _ in range(unit - self.numbers[k]):
            found = _UNIT.match(self.text, byte)
            byte, char = found.end(), char + (found.end() - found.start() if _LETTER[self.text[byte]] else 1)
        return byte, char


def plan(id_col: Column, seed: int = 1) -> list[Column]:
    """Four unsigned 32-bit numbers from the SHA-256 of ``seed:id``; a null id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def cut_text(text: bytes, draws: tuple[int, int, int, int], cut_rate: int = CUT_RATE, spm_rate: int = SPM_RATE) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, code points of the prefix, of the middle, output)"""
    units = Units(text)
    marked = any(m.encode() in text for m in (PREFIX, SUFFIX, MIDDLE))
    if not text or marked or draws[2] % 100 >= cut_rate:
        return units.count, PLAIN, None, None, text
    a, b = sorted((draws[0] % (units.count + 1), draws[1] % (units.count + 1)))
    (a_byte, a_char), (b_byte, b_char) = units.offset(a), units.offset(b)
    view = memoryview(text)
    prefix, middle, suffix = view[:a_byte], view[a_byte:b_byte], view[b_byte:]
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    if draws[3] % 100 < spm_rate:
        return units.count, SPM, a_char, b_char - a_char, b"".join((s, suffix, p, prefix, m, middle))
    return units.count, PSM, a_char, b_char - a_char, b"".join((p, prefix, s, suffix, m, middle))


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, cut_rate: int = CUT_RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """One row for each row of ``docs``: id, n (units), form, prefix_chars, middle_chars (null if plain), output.

    Row by row, no shuffle.  A null text counts as empty and is plain, as is one that holds a mark; a null id draws as the empty
    one; repeated rows get the same answer; texts of any length are read whole, in time linear in their length; an empty
    table gives none; other columns are not read.
    """
    names = ["id", "n", "form", "prefix_chars", "middle_chars", "output"]
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *(c.alias(f"h{k}") for k, c in enumerate(plan(F.col(id_col), seed))))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded_batches(batches, "text", BATCH):
            draws = zip(*(batch.column(f"h{k}").to_pylist() for k in range(4)), strict=True)
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            n, form, prefix, middle, output = map(list, zip(*(cut_text(t, d, cut_rate, spm_rate) for t, d in zip(texts, draws, strict=True)), strict=True))
            columns = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], names)

    out = small_batches(base).mapInArrow(run, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output binary")
    return out.select(F.col("id").alias(id_col), *names[1:-1], F.col("output").cast("string").alias("output"))


def restore(form: Column, output: Column) -> Column:
    """The text, from output and form alone.  Marks stand nowhere but between the parts, so the first of each kind ends a part."""

    def between(first: str, second: str) -> Column:
        start = F.instr(output, first) + len(first)
        return F.substr(output, start, F.instr(output, second) - start)

    rest = F.substr(output, F.instr(output, MIDDLE) + len(MIDDLE))
    psm = F.concat(between(PREFIX, SUFFIX), rest, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), rest, between(SUFFIX, PREFIX))
    return F.when(form == PSM, psm).when(form == SPM, spm).otherwise(output)


def digests(cut: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The result of transform() with SHA-256 digests of the output and of the text restored from it, instead of the output."""
    return cut.select(id_col, "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("form"), F.col("output")), 256).alias("restored_sha256"))
