"""Fill-in-the-middle training texts by displacement scatter.

The texts of a batch are one byte array. Where a text is cut, all bytes of a part move
by the same amount, so a difference array with one entry a part, summed up, gives every
byte its shift; one scatter writes all outputs. The way back is the same on the side of
the restored text: a gather whose indices come from a difference array.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import bounded_batches

#: Marks of the prefix, the suffix and the middle; the forms they are laid out in.
MARKS = ("<P>", "<S>", "<M>")
FORMS = ("plain", "psm", "spm")
PLAIN, PSM, SPM = range(3)
#: Bytes whose shifts are held at once, whatever the length of a text.
SLICE = 1 << 22

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[ord(m[1]) for m in MARKS]] = True
_MARK_BYTES = np.array([list(m.encode()) for m in MARKS], np.uint8)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each text starts in them, with the end of the last."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0]:at[-1]], at - at[0]


def text_column(data: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data))


def unit_starts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places where a unit starts: at a text's first byte and wherever white space follows something else."""
    blank = _BLANK[data]
    starts = np.zeros(len(data), bool)
    starts[1:] = blank[1:] & ~blank[:-1]
    starts[at[:-1][at[:-1] < at[1:]]] = True
    return np.flatnonzero(starts)


def mark_places(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the marks, and the text each is in; what two texts form together is no mark."""
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = np.flatnonzero(data[:-2] == ord("<"))
    place = place[_LETTER[data[place + 1]] & (data[place + 2] == ord(">"))]
    text = np.searchsorted(at, place, "right") - 1
    inside = place + 2 < at[text + 1]
    return place[inside], text[inside]


def shifts(at: np.ndarray, shift: np.ndarray, total: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(low, high, shift of every place) by slices; ``shift[k]`` holds from ``at[k]`` on, later entries win a tie, ``at`` is sorted."""
    step = np.diff(shift, prepend=0)
    carry = 0
    for low in range(0, total, SLICE):
        high = min(total, low + SLICE)
        a, b = np.searchsorted(at, [low, high])
        difference = np.zeros(high - low, np.int64)
        np.add.at(difference, at[a:b] - low, step[a:b])
        if high > low:
            difference[0] += carry
        moved = np.cumsum(difference)
        carry = int(moved[-1])
        yield low, high, moved


def scattered(data: np.ndarray, at: np.ndarray, form: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Outputs of the texts cut at the places ``first`` and ``second``: their bytes, and where each starts."""
    start, end = at[:-1], at[1:]
    prefix, suffix = first - start, end - second
    marked = form != PLAIN
    out_at = np.concatenate(([0], np.cumsum(end - start + 9 * marked)))
    to = out_at[:-1]
    psm, spm = form == PSM, form == SPM
    to_prefix = to + 3 * psm + (6 + suffix) * spm
    to_suffix = np.where(marked, to + 3 + (3 + prefix) * psm, to + second - start)
    to_middle = np.where(marked, to + 9 + prefix + suffix, to + prefix)
    events = np.stack((start, first, second), 1).ravel()
    moves = np.stack((to_prefix - start, to_middle - first, to_suffix - second), 1).ravel()
    out = np.empty(int(out_at[-1]), np.uint8)
    for low, high, shift in shifts(events, moves, len(data)):
        out[np.arange(low, high) + shift] = data[low:high]
    for mark, place in zip(_MARK_BYTES, (to_prefix - 3, to_suffix - 3, to_middle - 3)):
        out[place[marked, None] + np.arange(3)] = mark
    return out, out_at


def gathered(data: np.ndarray, at: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts that outputs were made from, told from the outputs and their forms alone."""
    start, end = at[:-1], at[1:]
    marked = np.flatnonzero(form != PLAIN)
    place, text = mark_places(data, at)
    own = place[np.isin(text, marked)].reshape(-1, 3)   # a text with a mark of its own stays plain, so an output holds three
    one, two, middle = start.copy(), end.copy(), end.copy()
    one[marked], two[marked], middle[marked] = own[:, 0] + 3, own[:, 1] + 3, own[:, 2] + 3
    one_end, two_end = end.copy(), end.copy()
    one_end[marked], two_end[marked] = own[:, 1], own[:, 2]
    swap = form == SPM
    prefix, prefix_end = np.where(swap, two, one), np.where(swap, two_end, one_end)
    suffix, suffix_end = np.where(swap, one, two), np.where(swap, one_end, two_end)
    n_prefix, n_middle, n_suffix = prefix_end - prefix, end - middle, suffix_end - suffix
    back_at = np.concatenate(([0], np.cumsum(n_prefix + n_middle + n_suffix)))
    to = back_at[:-1]
    events = np.stack((to, to + n_prefix, to + n_prefix + n_middle), 1).ravel()
    moves = np.stack((prefix - to, middle - to - n_prefix, suffix - to - n_prefix - n_middle), 1).ravel()
    out = np.empty(int(back_at[-1]), np.uint8)
    for low, high, shift in shifts(events, moves, len(out)):
        out[low:high] = data[np.arange(low, high) + shift]
    return out, back_at


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm_rate: int = 80) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n, form, prefix_chars, middle_chars, output.

    A text is cut into n units of white space and what follows it, after the lesser and
    the larger of two numbers drawn from sha256 of ``seed:doc_id``; ``rate`` percent are
    laid out, ``spm_rate`` percent of these with the suffix first. Empty and null texts,
    and texts that hold a mark, stay plain; of plain texts prefix_chars and middle_chars
    are null. A null doc_id draws as the empty string, so its rows are cut alike; rows
    that repeat a doc_id share its draws. Other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    drawn = [F.conv(F.substring("_digest", 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    rows = (docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), digest.alias("_digest"))
            .select("doc_id", "text", *drawn))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            data, at = text_buffer(b.column("text"))
            h1, h2, h3, h4 = (b.column(f"h{k}").to_numpy() for k in range(1, 5))
            units = np.append(unit_starts(data, at), len(data))
            offset = np.searchsorted(units[:-1], at)
            n = np.diff(offset)
            draws = np.stack((h1 % (n + 1), h2 % (n + 1)))
            first, second = (np.where(k < n, units[np.minimum(offset[:-1] + k, len(units) - 1)], at[1:]) for k in (draws.min(0), draws.max(0)))
            form = np.where((n == 0) | (h3 % 100 >= rate), PLAIN, np.where(h4 % 100 < spm_rate, SPM, PSM))
            form[mark_places(data, at)[1]] = PLAIN
            out, out_at = scattered(data, at, form, first, second)
            lead = (data & 0xC0) != 0x80   # one byte a code point
            chars = [[int(np.count_nonzero(lead[x:y])) for x, y in zip(low.tolist(), high.tolist())] for low, high in ((at[:-1], first), (first, second))]
            plain = form == PLAIN
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array([FORMS[f] for f in form.tolist()]), pa.array(chars[0], pa.int64(), mask=plain),
                                              pa.array(chars[1], pa.int64(), mask=plain), text_column(out, out_at)], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(filled: DataFrame) -> DataFrame:
    """``filled`` with the column restored: the text that each ``output`` was made from, read from output and form.

    Null outputs or forms count as an empty plain output. A column named restored is replaced.
    """
    bounded_batches(filled.sparkSession)
    rows = filled.drop("restored").withColumn("output", F.coalesce("output", F.lit(""))).withColumn("form", F.coalesce("form", F.lit(FORMS[PLAIN])))
    names = rows.columns
    schema = StructType([*rows.schema.fields, StructField("restored", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = {name: k for k, name in enumerate(FORMS)}
        for b in batches:
            if b.num_rows:
                data, at = text_buffer(b.column(names.index("output")))
                out, out_at = gathered(data, at, np.array([code[f] for f in b.column(names.index("form")).to_pylist()]))
                yield pa.RecordBatch.from_arrays([*b.columns, text_column(out, out_at)], [*names, "restored"])

    return rows.mapInArrow(run, schema)


def fim_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, and the digests of each output and of the text restored from it."""
    return restored(fill_in_middle(docs)).select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                                                 F.sha2("restored", 256).alias("restored_sha256"))


#: The same rows in DuckDB; the restored text is the text.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
h AS (SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
    ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
    sha256(text) AS restored_sha256 FROM p"""
