"""Fill-in-the-middle transformation, as a pyarrow.compute pipeline per batch.

A text's units (code points) are cut at two places drawn from the document's id into prefix, middle and
suffix, which a form puts in order: psm is ``<P>prefix<S>suffix<M>middle``, spm ``<S>suffix<P>prefix<M>middle``,
plain the text as it is.

Spark draws form and cuts with column functions and deals out the rows; per batch, Arrow splits the texts
into lists of units (offsets into the texts' own bytes), flattens them with the index of their list, numbers
the units within their text, filters them by role, rebuilds one list per role and joins each list to a string.
Units take some thirty times their text's memory while they are worked on, so a batch is worked on in parts of
``PART_BYTES`` and a longer text in as many segments, whose pieces are joined at the end.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.text import whole

# fixed values: the markers before prefix, suffix and middle
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKERS = "<[PSM]>"
SEED = 1
PLAIN_FROM, SPM_BELOW = 90, 20  # of 100
PART_BYTES = 4 << 20
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
                     ("middle_chars", pa.int64()), ("output", pa.string())])


def unit_lists(texts: pa.StringArray) -> pa.ListArray:
    """Each text's list of code points, which share the texts' bytes."""
    n = len(texts)
    if not n:
        return pa.array([], pa.list_(pa.string()))
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int32)[texts.offset:texts.offset + n + 1]
    raw = np.frombuffer(data or b"", np.uint8)[ends[0]:ends[-1]]
    # every byte but the continuing ones starts a code point
    starts = np.flatnonzero((raw & 0xC0) != 0x80).astype(np.int32)
    units = pa.StringArray.from_buffers(
        len(starts), pa.py_buffer(np.append(starts, np.int32(len(raw)))), pa.py_buffer(raw))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(starts, ends - ends[0]).astype(np.int32)), units)


def segments(texts: pa.StringArray, part_bytes: int) -> Iterator[tuple[np.ndarray, np.ndarray, pa.StringArray]]:
    """(text number, code points before, piece) arrays of up to ``part_bytes`` bytes; only longer texts are cut."""
    sizes = pc.binary_length(texts).to_numpy()
    at = 0
    while at < len(texts):
        stop = max(at + 1, at + int(np.searchsorted(np.cumsum(sizes[at:]), part_bytes, "right")))
        if stop > at + 1 or sizes[at] <= part_bytes:
            yield np.arange(at, stop), np.zeros(stop - at, np.int64), texts.slice(at, stop - at)
        else:
            raw, begin, before = texts[at].as_buffer(), 0, 0
            while begin < len(raw):
                end = min(begin + part_bytes, len(raw))
                while end < len(raw) and raw[end] & 0xC0 == 0x80:
                    end += 1
                piece = pa.array([bytes(raw[begin:end]).decode()], pa.string())
                yield np.array([at]), np.array([before], np.int64), piece
                begin, before = end, before + len(piece[0].as_py())
        at = stop


def split_roles(texts: pa.StringArray, first: np.ndarray, second: np.ndarray, part_bytes: int = PART_BYTES) -> list[pa.Array]:
    """Prefixes, middles and suffixes of texts cut after ``first`` and after ``second`` units."""
    number, pieces = [], [[], [], []]
    for rows, before, part in segments(texts, part_bytes):
        lists = unit_lists(part)
        units, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
        begins = pa.array(lists.offsets.to_numpy()[:-1].astype(np.int64) - before)
        ordinal = pc.subtract(pa.array(np.arange(len(units))), pc.take(begins, parent))
        lo, hi = (pc.take(pa.array(cut[rows]), parent) for cut in (first, second))
        in_prefix, in_suffix = pc.less(ordinal, lo), pc.greater_equal(ordinal, hi)
        for role, here in enumerate((in_prefix, pc.invert(pc.or_(in_prefix, in_suffix)), in_suffix)):
            # a text's units of one role lie side by side, so counts are enough to rebuild the lists
            count = np.bincount(pc.filter(parent, here).to_numpy(), minlength=len(part))
            ends = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
            pieces[role].append(pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), pc.filter(units, here)), ""))
        number.append(rows)
    if not number:
        return [pa.array([], pa.string())] * 3
    of_text = np.searchsorted(np.concatenate(number), np.arange(len(texts) + 1)).astype(np.int32)
    return [pc.binary_join(pa.ListArray.from_arrays(pa.array(of_text), pa.concat_arrays(p)), "") for p in pieces]


def arrange(texts: pa.StringArray, form: pa.StringArray, first: np.ndarray, second: np.ndarray,
            part_bytes: int = PART_BYTES) -> pa.Array:
    """The texts in their forms."""
    prefix, middle, suffix = split_roles(texts, first, second, part_bytes)
    psm = pc.binary_join_element_wise(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle, "")
    spm = pc.binary_join_element_wise(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle, "")
    return pc.if_else(pc.equal(form, "plain"), texts, pc.if_else(pc.equal(form, "spm"), spm, psm))


def _drawn(doc_id: Column, group: int) -> Column:
    """One of the id's 32-bit numbers; a NULL id counts as empty text."""
    digest = F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(digest, 8 * group - 7, 8), 16, 10).cast("long")


def transform(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", part_bytes: int = PART_BYTES) -> DataFrame:
    """One row per document: doc_id, n (code points), form, prefix_chars, middle_chars, output (text).

    NULL and empty texts and texts that hold a marker are plain, whose cuts are NULL; equal ids are cut alike
    in proportion to their texts; a NULL id draws as empty text; repeated rows are transformed one by one;
    other columns are left out; an empty table gives an empty result.
    """
    key, body, size = F.col(doc_id).cast("long"), whole(F.col(text).cast("string")), F.col("__n")
    rows = docs.select(key.alias("doc_id"), body.alias("__text"), F.length(body).cast("long").alias("__n"))
    one, two = _drawn(F.col("doc_id"), 1) % (size + 1), _drawn(F.col("doc_id"), 2) % (size + 1)
    plain = (size == 0) | F.col("__text").rlike(MARKERS) | (_drawn(F.col("doc_id"), 3) % 100 >= PLAIN_FROM)
    rows = rows.select(
        "doc_id", "__text", "__n", F.least(one, two).alias("__first"), F.greatest(one, two).alias("__second"),
        F.when(plain, "plain").when(_drawn(F.col("doc_id"), 4) % 100 < SPM_BELOW, "spm").otherwise("psm").alias("__form"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum(pc.binary_length(batch.column(1)).to_numpy())
            at = 0
            while at < batch.num_rows:
                done = sizes[at - 1] if at else 0
                stop = max(at + 1, int(np.searchsorted(sizes, done + 2 * part_bytes, "right")))
                ids, texts, n, first, second, form = batch.slice(at, stop - at).columns
                cuts = first.to_numpy(), second.to_numpy()
                cut = pc.not_equal(form, "plain")
                yield pa.RecordBatch.from_arrays([
                    ids, n, form, pc.if_else(cut, first, None), pc.if_else(cut, pc.subtract(second, first), None),
                    arrange(texts, form, *cuts, part_bytes)], schema=_SCHEMA)
                at = stop

    return rows.mapInArrow(run, SCHEMA)


def restore(output: Column, form: Column) -> Column:
    """The text of an output; pieces hold no marker, so the markers in it are the ones put there."""
    parts = F.split(output, MARKERS, -1)
    return F.when(form == "psm", F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(3)), F.get(parts, F.lit(2)))).when(
        form == "spm", F.concat(F.get(parts, F.lit(2)), F.get(parts, F.lit(3)), F.get(parts, F.lit(1)))).otherwise(output)


def digests(transformed: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of ``transform``'s rows."""
    def sha(c: Column) -> Column:
        return F.sha2(c.cast("binary"), 256)

    return transformed.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"),
                              sha(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))
