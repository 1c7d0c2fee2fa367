"""Fill-in-middle transformation: texts cut at boundaries of character classes, their pieces put in another order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import bound_batches, release

#: Marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: What a cut stands between: any two code points, or runs of letters, digits, white space and marks.
UNITS = ("codepoint", "class")
#: Code points that are classed at a time, which bounds the memory beside the text's own.
STEP = 1 << 20
_ASCII = np.array([2 if chr(c).isspace() else 1 if chr(c).isdigit() else 0 if chr(c).isalpha() else 3 for c in range(128)], np.uint8)


def classes(x: np.ndarray, unit: str) -> np.ndarray:
    """The class of each code point. As units of their own all code points differ; else all beyond ASCII count as letters."""
    if unit == "codepoint":
        return np.arange(len(x), dtype=np.uint32)
    return np.where(x < 128, _ASCII[np.minimum(x, 127)], np.uint8(0))


def starts(x: np.ndarray, unit: str, a: int, b: int) -> np.ndarray:
    """Where units begin in x[a:b]: at the first code point, and wherever the class is not its neighbour's."""
    kind = classes(x[max(a - 1, 0) : b], unit)
    found = np.flatnonzero(kind[1:] != kind[:-1]) + max(a, 1)
    return found if a else np.concatenate([np.zeros(min(len(x), 1), np.int64), found])


def cuts(x: np.ndarray, unit: str, h: tuple[int, int], step: int = STEP) -> tuple[int, int]:
    """Where the prefix and the middle end: at two ranks among the boundaries, drawn as h modulo the number of units and one."""
    runs = [starts(x, unit, a, a + step) for a in range(0, len(x), step)] if len(x) <= step else None
    sizes = [len(r) for r in runs] if runs is not None else [len(starts(x, unit, a, a + step)) for a in range(0, len(x), step)]
    units, out = sum(sizes), []
    for rank in sorted(v % (units + 1) for v in h):
        k = 0
        while k < len(sizes) and rank >= sizes[k]:
            rank -= sizes[k]
            k += 1
        out.append(len(x) if k == len(sizes) else int((runs[k] if runs is not None else starts(x, unit, k * step, (k + 1) * step))[rank]))
    return out[0], out[1]


def draws(id_col: str, seed: str) -> list[Column]:
    """Four numbers of 32 bits from the sha256 of the seed, a colon and the id; a null id counts as no digits."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(key, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def transform(docs: DataFrame, unit: str = "class", fim_percent: int = 90, spm_percent: int = 20, seed: str = "1", marks: tuple[str, str, str] = MARKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (code points), form, prefix_chars, middle_chars and output of every whole text.

    A text is cut into prefix, middle and suffix at two boundaries of its units. Form psm puts them as prefix, suffix,
    middle behind their marks, spm as suffix, prefix, middle; plain leaves the text as it is, with null lengths: empty
    texts, those that hold a mark, and all but fim_percent of the rest; spm_percent of the others are spm. All draws
    come from seed and id, so that they are the same wherever a row is processed.

    Null texts count as empty; null ids keep their row and share their draws; each repeated row gives a row. An empty
    table gives no rows; other columns are not read. One text is in one worker, at about 9 bytes a code point.
    """
    if unit not in UNITS:
        raise ValueError(f"unit is one of {UNITS}")
    bound_batches(docs)
    p, s, m = marks

    def one(text: str, h1: int, h2: int, h3: int, h4: int) -> tuple[int, str, int | None, int | None, str]:
        x = np.frombuffer(text.encode("utf-32-le"), "<u4")
        if not len(x) or h3 % 100 >= fim_percent or any(mark in text for mark in marks):
            return len(x), "plain", None, None, text
        i, j = cuts(x, unit, (h1, h2))
        prefix, middle, suffix = (part.tobytes().decode("utf-32-le") for part in (x[:i], x[i:j], x[j:]))
        if h4 % 100 < spm_percent:
            return len(x), "spm", i, j - i, "".join((s, suffix, p, prefix, m, middle))
        return len(x), "psm", i, j - i, "".join((p, prefix, s, suffix, m, middle))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        for batch in batches:
            rows = zip(batch.column(1).to_pylist(), *(batch.column(k).to_pylist() for k in range(2, 6)), strict=True)
            parts = list(zip(*(one(*row) for row in rows), strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, kind) for v, kind in zip(parts, kinds, strict=True))], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
        release()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *draws(id_col, seed))
    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output of a form was made of. A transformed text holds no mark, so its output holds three; no mark
    begins as another one ends, so none arises where a mark meets a piece."""
    parts = F.split(output, "|".join(rf"\Q{m}\E" for m in marks), -1)
    at = lambda *of: F.concat(*[F.get(parts, F.lit(k)) for k in of])
    return F.when(form == "psm", at(1, 3, 2)).when(form == "spm", at(2, 3, 1)).otherwise(output)


def digest(made: DataFrame, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """Rows of transform with the digests of the output and of the text restored from it, in place of the output."""
    back = restored(F.col("output"), F.col("form"), marks)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))
