"""Fill-in-middle transformation of documents, as whole-batch work in ``pyarrow.compute``.

1. *Units.* Every text is split at line ends into a list array; the lists are flattened beside the
   index of their row, and a unit's ordinal is its place less its row's offset.
2. *Roles.* Two cuts a document, taken from the hash of its id, give every unit its role: prefix,
   middle or suffix. Filtering by role and counting per row rebuilds one list array a role.
3. *Pieces.* ``binary_join`` makes each role's list a string; the pieces are put together in the
   order of the document's form. ``restore`` goes back from output and form alone.

A document depends on nothing but its own row, so there is no shuffle, and a lost task is repeated
as it was. Tasks hold about ``PIECE_BYTES`` of text at once, or one longer text.

Defined cases: a null text counts as empty and is ``plain`` with no units; texts that hold a tag
are ``plain``; only a line feed ends a line; a null doc_id is hashed as empty text; repeated rows
and ids are each transformed; an empty table gives an empty one; only ``doc_id`` and ``text`` are
read, so other columns do not matter. The other columns of ``restore``'s input are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gleaner.llm.rows import PIECE_BYTES

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
RATE, SPM_SHARE = 100, 50      # of 100 documents so many are transformed, of those so many in the order spm
SEED = "7"
_ORDER = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}


def draws(key: Column, seed: str = SEED) -> list[Column]:
    """Four numbers below 2^32 from the hash of a document's id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]


def _modulo(a: pa.Array, b: pa.Array | int) -> pa.Array:
    return pc.subtract(a, pc.multiply(pc.divide(a, b), b))


def _offsets(counts: pa.Array) -> pa.Array:
    total = pc.cumulative_sum(pc.cast(counts, pa.int32()))
    return pa.concat_arrays([pa.array([0], pa.int32()), total])


def units(text: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array, pa.Array]:
    """(units, row of each, ordinal of each within its row, units a row): lines with their ends."""
    lists = pc.split_pattern(text, "\n")
    sizes = pc.cast(pc.list_value_length(lists), pa.int64())
    flat, rows = pc.list_flatten(lists), pc.list_parent_indices(lists)
    first = _offsets(sizes)
    ordinal = pc.subtract(pa.array(range(len(flat)), pa.int64()), pc.cast(pc.take(first, rows), pa.int64()))
    last = pc.equal(ordinal, pc.subtract(pc.take(sizes, rows), 1))
    # What follows the last line feed has no line end, and is no unit if it is empty.
    real = pc.invert(pc.and_(last, pc.equal(flat, "")))
    ends = pc.if_else(last, pa.scalar("", text.type), pa.scalar("\n", text.type))
    flat = pc.binary_join_element_wise(flat, ends, pa.scalar("", text.type))
    bare = pc.equal(pc.take(flat, pc.subtract(pc.take(first, pa.array(range(1, len(first)), pa.int32())), 1)), "") if len(flat) else pa.array([], pa.bool_())
    return pc.filter(flat, real), pc.filter(rows, real), pc.filter(ordinal, real), pc.subtract(sizes, pc.cast(bare, pa.int64()))


def _joined(flat: pa.Array, role: pa.Array, want: int, counts: pa.Array) -> pa.Array:
    mine = pc.filter(flat, pc.equal(role, want))
    return pc.binary_join(pa.ListArray.from_arrays(_offsets(counts), mine), pa.scalar("", flat.type))


def _tagged(text: pa.Array) -> pa.Array:
    out = pc.match_substring(text, PREFIX)
    for tag in (SUFFIX, MIDDLE):
        out = pc.or_(out, pc.match_substring(text, tag))
    return out


def transform_batch(text: pa.Array, h: list[pa.Array], rate: int = RATE, spm_share: int = SPM_SHARE) -> dict[str, pa.Array]:
    """The new columns of a batch whose texts hold no nulls."""
    flat, rows, ordinal, n = units(text)
    a, b = (_modulo(x, pc.add(n, 1)) for x in h[:2])
    low, high = pc.min_element_wise(a, b), pc.max_element_wise(a, b)
    after_low = pc.greater_equal(ordinal, pc.take(low, rows))
    after_high = pc.greater_equal(ordinal, pc.take(high, rows))
    role = pc.add(pc.cast(after_low, pa.int8()), pc.cast(after_high, pa.int8()))
    prefix, middle, suffix = (_joined(flat, role, i, counts) for i, counts in enumerate((low, pc.subtract(high, low), pc.subtract(n, high))))
    plain = pc.or_(pc.or_(pc.equal(text, ""), _tagged(text)), pc.greater_equal(_modulo(h[2], 100), rate))
    spm = pc.less(_modulo(h[3], 100), spm_share)
    piece = {PREFIX: prefix, SUFFIX: suffix, MIDDLE: middle}
    made = {}
    for form, tags in _ORDER.items():
        parts = [x for tag in tags for x in (pa.scalar(tag, text.type), piece[tag])]
        made[form] = pc.binary_join_element_wise(*parts, pa.scalar("", text.type))
    none = pa.scalar(None, pa.int64())
    return {
        "n": n,
        "form": pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm")),
        "prefix_chars": pc.if_else(plain, none, pc.cast(pc.utf8_length(prefix), pa.int64())),
        "middle_chars": pc.if_else(plain, none, pc.cast(pc.utf8_length(middle), pa.int64())),
        "output": pc.if_else(plain, text, pc.if_else(spm, made["spm"], made["psm"])),
    }


def _after(text: pa.Array, tag: str) -> tuple[pa.Array, pa.Array]:
    """What stands before and after the first ``tag`` of texts that hold one."""
    halves = pc.split_pattern(text, tag, max_splits=1)
    return pc.list_element(halves, 0), pc.list_element(halves, 1)


def restore_batch(output: pa.Array, form: pa.Array) -> pa.Array:
    """The texts from outputs and forms. A tag can't arise where a piece meets one, as it begins and
    ends with characters that stand nowhere else in it."""
    text = output
    for name, tags in _ORDER.items():
        mine = pc.fill_null(pc.equal(form, name), False)
        rest = pc.filter(output, mine)
        piece, before = {}, ""
        for tag in tags:
            head, rest = _after(rest, tag)
            if before:
                piece[before] = head
            before = tag
        piece[before] = rest
        whole = pc.binary_join_element_wise(piece[PREFIX], piece[MIDDLE], piece[SUFFIX], pa.scalar("", output.type))
        text = pc.replace_with_mask(text, mine, whole)
    return text


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices by the bytes that their rows hold: a long text is alone, not beside its batch."""
    for b in batches:
        step = max(1, b.num_rows * PIECE_BYTES // max(b.nbytes, 1))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


def _whole(column: pa.Array) -> pa.Array:
    return pa.concat_arrays([column])      # without the offset of a slice


def transform(docs: DataFrame, rate: int = RATE, spm_share: int = SPM_SHARE, seed: str = SEED) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every document; ``rate`` of 100 are
    transformed, ``spm_share`` of 100 of those have the suffix first."""
    key = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *[h.alias(f"h{i}") for i, h in enumerate(draws(F.col("doc_id"), seed))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(batches):
            made = transform_batch(_whole(b.column("text")), [_whole(b.column(f"h{i}")) for i in range(4)], rate, spm_share)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *made.values()], ["doc_id", *made])

    return rows.mapInArrow(run, f"doc_id {key}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restore(rows: DataFrame) -> DataFrame:
    """The rows of ``transform`` with the column ``restored``: the text, from ``output`` and ``form``.
    Rows of other forms than psm and spm restore to their output."""
    rest = [f for f in rows.schema.fields if f.name != "restored"]
    schema = StructType([*rest]).add("restored", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(batches):
            text = restore_batch(_whole(b.column("output")), _whole(b.column("form")))
            yield pa.RecordBatch.from_arrays([*b.columns, text], [f.name for f in schema.fields])

    return rows.select(*[f"`{f.name}`" for f in rest]).mapInArrow(run, schema)
