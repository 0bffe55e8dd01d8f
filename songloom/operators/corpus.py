"""Training text: prompts, character windows, vocabulary, codes and next-character counts."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from songloom.constants import EXAMPLE_TEMPLATE, PROMPT_TEMPLATE, TOKEN_CAP, WINDOW_LENGTH, WINDOW_STEP
from songloom.functions.strings import WHITESPACE, characters, fill

# Longest run of window starts handled in one array; longer texts become several rows.
SEGMENT = 12_288
# Longest run of window starts cut out of one short text, in which ``substring`` has not far to count.
SPAN = 128
# Texts opened at once.
TEXTS = 256
# Bytes of cells that wait before they are added up.
WAITING = 65_536


def prompts(long: DataFrame) -> DataFrame:
    """Question and answer per song; the question names the row's own section and artist."""
    question = fill(PROMPT_TEMPLATE, section=F.col("section"), artist=F.col("artist"))
    return long.select(question.alias("question"), F.col("text").alias("answer"))


def training_examples(qa: DataFrame) -> DataFrame:
    """Question and answer as one training text."""
    return qa.select(fill(EXAMPLE_TEMPLATE, question=F.col("question"), answer=F.col("answer")).alias("text"))


def cap_tokens(df: DataFrame, text: str = "text", cap: int = TOKEN_CAP) -> DataFrame:
    """Cut texts after ``cap`` whitespace tokens; ``n_tokens`` counts before the cut."""
    tokens = F.filter(F.split(text, rf"{WHITESPACE}+"), lambda t: t != "")
    split = df.withColumn("_tokens", tokens)
    return split.select(
        *[c for c in df.columns if c != text],
        F.when(F.size("_tokens") > cap, F.array_join(F.slice("_tokens", 1, cap), " ")).otherwise(F.col(text)).alias(text),
        F.size("_tokens").alias("n_tokens"),
        (F.size("_tokens") > cap).alias("was_cut"),
    )


def _overlapping(text: Column | str, at_least: int, at_most: int, step: int) -> Column:
    """Pieces that begin at 0, step, 2 * step ... with as many characters as there are up to ``at_most``.

    A lookahead captures the piece and the match moves on by ``step``: one pass over the text, where
    ``substring`` would count characters from the beginning for every piece.
    """
    return F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{at_least},{at_most}}})).{{1,{step}}}"), F.lit(1))


def _segments(df: DataFrame, keys: list[str], text: Column, length: int, step: int, first: Column) -> DataFrame:
    """Texts cut into rows of bounded size that overlap by ``length``; ``at`` is the position of the first start."""
    size = -(-SEGMENT // step) * step
    pieces = _overlapping(text, 1, size + length, size)
    cut = df.select(*keys, first.alias("_first"), F.posexplode(pieces).alias("_part", "piece"))
    return cut.select(*keys, (F.col("_first") + F.col("_part").cast("bigint") * size).alias("at"), "piece")


def _windows(segments: DataFrame, keys: list[str], length: int, step: int) -> DataFrame:
    """All windows of the segments. A match per window costs far more than one per ``SPAN`` and short substrings."""
    size = -(-SPAN // step) * step
    spans = segments.select(
        *keys, "at", F.posexplode(_overlapping("piece", length + 1, size + length, size)).alias("_part", "_span")
    )
    begins = F.sequence(F.lit(0), F.length("_span") - (length + 1), F.lit(step))
    cut = spans.select(*keys, "at", "_part", "_span", F.explode(begins).alias("_begin"))
    return cut.select(
        *keys,
        (F.col("at") + F.col("_part").cast("bigint") * size + F.col("_begin")).alias("start"),
        F.substring("_span", F.col("_begin") + 1, F.lit(length)).alias("sequence"),
        F.substring("_span", F.col("_begin") + (length + 1), F.lit(1)).alias("next_char"),
    )


def windows(
    df: DataFrame, keys: list[str], text: str = "text", length: int = WINDOW_LENGTH, step: int = WINDOW_STEP
) -> DataFrame:
    """Windows of ``length`` characters at every ``step``-th position, each with the character after it.

    Texts of at most ``length`` characters have none. No shuffle: rows are only multiplied.
    """
    whole = _segments(df, keys, F.lower(text), length, step, F.lit(0).cast("bigint"))
    return _windows(whole, keys, length, step)


def corpus_pieces(
    df: DataFrame, group: str, order: str = "row_idx", text: str = "text", lookahead: int = 0, chunk_rows: int = 8192
) -> DataFrame:
    """The lower-case texts of a group as pieces of one long text: ``offset``, ``text`` and ``ahead``.

    ``offset`` is the number of characters before the piece, ``ahead`` the next ``lookahead`` characters
    after it. Pieces joined by offset are the concatenated corpus, which is never held as one value.

    Rows are placed by (group, chunk of ``chunk_rows`` positions), so a group that holds most of the
    table is spread as well. Only one row per chunk, with its length and its first characters, is
    brought together per group. ``order`` is a row position (see ``with_row_index``): unique, and
    without large gaps.
    """
    rows = df.select(
        F.col(group), F.col(order), F.lower(text).alias("text"), ((F.col(order) - F.pmod(order, F.lit(chunk_rows))).cast("bigint")).alias("_chunk")
    ).where(F.col("text") != "")
    chunk_key = [group, "_chunk"]

    head = F.struct(F.col(order), F.substring("text", 1, lookahead).alias("head"))
    chunks = rows.groupBy(*chunk_key).agg(
        F.sum(F.length("text")).alias("_chars"),
        *([F.array_sort(F.collect_list(head)).alias("_heads")] if lookahead else []),
    )
    in_group = Window.partitionBy(group).orderBy("_chunk")
    base = F.coalesce(F.sum("_chars").over(in_group.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    in_chunk = Window.partitionBy(*chunk_key).orderBy(order)
    before = F.coalesce(
        F.sum(F.length("text")).over(in_chunk.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    if not lookahead:
        offsets = chunks.select(*chunk_key, base.alias("_base"))
        placed = _with_offsets(rows.withColumn("_before", before), offsets, chunk_key)
        return placed.select(group, order, (F.col("_base") + F.col("_before")).alias("offset"), "text")

    # Every piece and every chunk has a character at least, so the next ``lookahead`` of them suffice.
    following = (1, lookahead)
    heads = F.array_join(F.slice(F.transform("_heads", lambda h: h["head"]), 1, lookahead), "")
    chunks = chunks.select(*chunk_key, "_chars", F.substring(heads, 1, lookahead).alias("_head"))
    offsets = chunks.select(
        *chunk_key,
        base.alias("_base"),
        F.array_join(F.collect_list("_head").over(in_group.rowsBetween(*following)), "").alias("_after"),
    )
    nearby = F.collect_list(F.substring("text", 1, lookahead)).over(in_chunk.rowsBetween(*following))
    placed = _with_offsets(rows.select("*", before.alias("_before"), F.array_join(nearby, "").alias("_near")), offsets, chunk_key)
    return placed.select(
        group,
        order,
        (F.col("_base") + F.col("_before")).alias("offset"),
        "text",
        F.substring(F.concat("_near", "_after"), 1, lookahead).alias("ahead"),
    )


def _with_offsets(rows: DataFrame, offsets: DataFrame, keys: list[str]) -> DataFrame:
    """Equi-join in which a null group is a group like any other."""
    named = offsets.select(*[F.col(k).alias(f"_of_{k}") for k in keys], *[c for c in offsets.columns if c not in keys])
    alike = F.lit(True)
    for key in keys:
        alike = alike & F.col(key).eqNullSafe(F.col(f"_of_{key}"))
    return rows.join(named, alike).drop(*[f"_of_{k}" for k in keys])


def corpus_windows(
    df: DataFrame,
    group: str,
    order: str = "row_idx",
    text: str = "text",
    length: int = WINDOW_LENGTH,
    step: int = WINDOW_STEP,
    chunk_rows: int = 8192,
) -> DataFrame:
    """Windows over the concatenated texts of each group; windows cross the borders of texts."""
    pieces = corpus_pieces(df, group, order, text, length, chunk_rows)
    skip = F.pmod(-F.col("offset"), F.lit(step)).cast("int")
    reach = F.concat("text", "ahead")
    begun = pieces.select(
        group, (F.col("offset") + skip).alias("_begin"), F.substring(reach, skip + 1, F.lit(2**31 - 1)).alias("_reach")
    )
    whole = _segments(begun, [group], F.col("_reach"), length, step, F.col("_begin"))
    return _windows(whole, [group], length, step)


def _points(texts: list[str]) -> np.ndarray:
    """Code points of the texts, one after the other."""
    return np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")


def vocabulary(df: DataFrame, text: str = "text", letters_only: bool = False) -> DataFrame:
    """Different characters of the lower-case texts, with their places in sorted order.

    Characters are made different within each task, where a code point is marked when it is met. The numbering is over at
    most as many rows as Unicode has characters.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = np.zeros(sys.maxunicode + 1, bool)
        for batch in batches:
            for begin in range(0, batch.num_rows, TEXTS):
                met[_points(batch.column(0).slice(begin, TEXTS).drop_null().to_pylist())] = True
        yield pa.RecordBatch.from_arrays([pa.array([chr(point) for point in np.flatnonzero(met)], pa.string())], ["ch"])

    chars = df.select(F.lower(text)).mapInArrow(run, "ch string").distinct()
    if letters_only:
        chars = chars.where(F.col("ch").rlike(r"\A\p{L}\z"))
    return chars.select("ch", (F.row_number().over(Window.orderBy("ch")) - 1).alias("idx"))


def character_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Occurrences of every character of the lower-case texts."""
    return df.select(F.explode(characters(F.lower(text))).alias("ch")).groupBy("ch").agg(F.count("*").alias("n"))


def with_codes(characters_table: DataFrame, vocab: DataFrame, ch: str = "ch") -> DataFrame:
    """Join characters to their places in the vocabulary."""
    return characters_table.join(vocab.select(F.col("ch").alias(ch), "idx"), ch)


def _code_table(vocab: DataFrame) -> tuple[str, str]:
    """Characters, and for each a stand-in character whose code point tells its place.

    Collects the vocabulary, which is bounded by the number of Unicode characters. Stand-ins begin at 1
    and leave out surrogates.
    """
    rows = sorted((r.idx, r.ch) for r in vocab.collect())
    stand_ins = [chr(i + 1 if i + 1 < 0xD800 else i + 1 + 0x800) for i, _ in rows]
    return "".join(ch for _, ch in rows), "".join(stand_ins)


def _codes(text: Column, table: tuple[str, str]) -> Column:
    point = lambda c: F.ascii(c)  # noqa: E731  (gives the code point, not only ASCII)
    place = lambda c: F.when(point(c) > 0xD800, point(c) - 0x801).otherwise(point(c) - 1)
    return F.transform(characters(F.translate(text, *table)), place)


def encoded_windows(
    df: DataFrame,
    keys: list[str],
    vocab: DataFrame,
    text: str = "text",
    length: int = WINDOW_LENGTH,
    step: int = WINDOW_STEP,
    runs: bool = False,
) -> DataFrame:
    """Windows as arrays of character codes with the code of the next character (one-hot, kept sparse).

    Each text is coded once, by hash lookup, and windows are slices of the codes. Every character must
    be in the vocabulary.

    With ``runs``, windows that follow each other stay one row, so the codes they share are held once: ``start`` is that of
    the first of them, ``codes`` is a text whose characters tell the codes (see ``_opened``). Texts without a window have none.
    """
    size = -(-SEGMENT // step) * step
    whole = _segments(df, keys, F.lower(text), length, step, F.lit(0).cast("bigint"))
    if runs:
        held = whole.where(F.length("piece") > length)
        return held.select(*keys, F.col("at").alias("start"), F.translate("piece", *_code_table(vocab)).alias("codes"))
    coded = whole.select(*keys, "at", _codes(F.col("piece"), _code_table(vocab)).alias("_codes"))
    last = F.least(F.size("_codes") - length, F.lit(size)) - 1
    starts = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(step)))
    # Generation and slicing are one code-generated stage, which does not copy the codes per window.
    cut = coded.select("*", F.explode(starts).alias("_i"))
    return cut.select(
        *keys,
        (F.col("at") + F.col("_i")).alias("start"),
        F.slice("_codes", F.col("_i") + 1, F.lit(length)).alias("codes"),
        F.get("_codes", F.col("_i") + length).alias("label"),
    )


def _packed(codes: np.ndarray, size: int) -> np.ndarray:
    """One-hot rows of ``size`` cells, eight cells to a byte, the first in the highest bit; only hot cells are written.

    Cells that share a byte are of neighbouring rows, at most eight of them, so they are met in as many turns.
    """
    cells = np.zeros(-(-len(codes) * size // 8), np.uint8)
    place = np.arange(len(codes), dtype=np.int64) * size + codes
    bit = np.right_shift(128, place & 7).astype(np.uint8)
    turns = -(-8 // size) + 1 if size else 0  # a byte shows so many rows at most
    for turn in range(turns):
        cells[place[turn::turns] >> 3] |= bit[turn::turns]
    return cells


def _hot(cells: np.ndarray) -> np.ndarray:
    """Places of the cells that are set, in any order; bytes without any are passed over."""
    at = np.flatnonzero(cells != 0)
    held = cells[at]
    return np.concatenate([at[(held & (128 >> bit)) != 0] * 8 + bit for bit in range(8)])


def _opened(runs: pa.RecordBatch, keys: list[str], length: int, step: int) -> tuple[list[pa.Array], np.ndarray, np.ndarray]:
    """Windows of runs: their keys, the codes of all runs, and where in them each window begins."""
    texts = runs.column("codes").to_pylist()
    points = _points(texts).astype(np.int64)
    codes = points - np.where(points > 0xD800, 0x801, 1)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    counts = np.maximum(-(-(sizes - length) // step), 0)
    of = np.repeat(np.arange(len(texts)), counts)
    on = (np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)) * step
    at = (np.cumsum(sizes) - sizes)[of] + on
    held = [runs.column(k).take(pa.array(of)) for k in keys]
    return [pa.array(h.to_numpy() + on) if k == "start" else h for k, h in zip(keys, held)], codes, at


def _cut(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int, length: int, step: int) -> Iterator[tuple]:
    """Keys, codes and next codes of at most ``rows`` windows at a time."""
    for whole in batches:
        if "label" in whole.schema.names:
            for begin in range(0, whole.num_rows, rows):
                batch = whole.slice(begin, rows)
                codes = batch.column("codes").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                yield [batch.column(k) for k in keys], codes, batch.column("label").to_numpy(zero_copy_only=False)
            continue
        for begin in range(0, whole.num_rows, TEXTS):
            held, codes, at = _opened(whole.slice(begin, TEXTS), keys, length, step)
            for first in range(0, len(at), rows):
                cut = np.lib.stride_tricks.sliding_window_view(codes, length + 1)[at[first : first + rows]]
                yield [h.slice(first, rows) for h in held], cut[:, :length], cut[:, length]


def _one_value(cells: np.ndarray) -> pa.Array:
    """Cells as the only value of an array, without a copy."""
    return pa.Array.from_buffers(pa.binary(), 1, [None, pa.py_buffer(np.array([0, len(cells)], np.int32)), pa.py_buffer(cells)])


def one_hot_tensors(
    coded: DataFrame, keys: list[str], size: int, rows: int = 1024, length: int = WINDOW_LENGTH, step: int = WINDOW_STEP
) -> DataFrame:
    """Coded windows as dense boolean tensors in shards of at most ``rows`` windows, eight cells to a byte.

    A shard has the ``keys`` of its windows in order, their number ``n`` and ``length``, the cells ``x`` of n windows by length
    places by ``size`` characters, and ``y`` of n by ``size``. ``tensor_of`` opens them. A shard is made from rows as they
    stand: no shuffle, and memory is bound by ``rows``. Runs of windows are opened here, at ``length`` and ``step``: a row per
    window costs more on its way out of the JVM than all that is done with it.
    """
    named = [f"{k} {coded.schema[k].dataType.simpleString()}" for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, codes, labels in _cut(batches, keys, rows, length, step):
            n, places = codes.shape
            held = pa.StructArray.from_arrays(columns, keys)
            listed = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), held)
            cells = [_one_value(_packed(t, size)) for t in (codes.ravel(), labels)]
            yield pa.RecordBatch.from_arrays(
                [listed, pa.array([n], pa.int32()), pa.array([places], pa.int32()), *cells], ["windows", "n", "length", "x", "y"]
            )

    chosen = coded.select(*dict.fromkeys([*keys, "codes", *(c for c in ("label",) if c in coded.columns)]))
    return chosen.mapInArrow(run, f"windows array<struct<{', '.join(n.replace(' ', ':', 1) for n in named)}>>, n int, length int, x binary, y binary")


def tensor_of(cells: bytes, *shape: int) -> np.ndarray:
    """Boolean tensor of a shard."""
    return np.unpackbits(np.frombuffer(cells, np.uint8), count=int(np.prod(shape))).reshape(shape).astype(bool)


def _add_cells(levels: list[np.ndarray], cells: np.ndarray, row: int) -> None:
    """Add rows of ``row`` cells up, all cells of a byte at once: a row that stands at level k counts 2**k times.

    Three rows of a level become one there and one of what is carried to the next. Rows that end within a byte are taken
    several at a time.
    """
    width = row // math.gcd(row, 8)
    if len(cells) % width:
        cells = np.concatenate([cells, np.zeros(-len(cells) % width, np.uint8)])
    least = max(WAITING // width, 32)
    rows = cells.reshape(-1, width)
    level = 0
    while len(rows):
        if level == len(levels):
            levels.append(rows[:0])
        waiting, carried = levels[level], [rows[:0]]
        while len(rows) + len(waiting) >= least:
            third = len(rows) // 3
            a, b, c = (rows[third * i : third * (i + 1)] for i in range(3))
            carry, odd = a & b, a ^ b
            carry |= odd & c
            odd ^= c
            carried.append(carry)
            rows, waiting = np.concatenate([odd, rows[3 * third :], waiting]), rows[:0]
        levels[level], rows = np.concatenate([waiting, rows]), np.concatenate(carried)
        level += 1


def _cell_counts(levels: list[np.ndarray], row: int) -> np.ndarray:
    """How often each of the ``row`` cells was set."""
    counts = np.zeros(row, np.int64)
    for level, rows in enumerate(levels):
        for cells in rows:
            counts += np.bincount(_hot(cells) % row, minlength=row) << level
    return counts


def hot_counts(tensors: DataFrame, size: int) -> DataFrame:
    """How many windows have which code at which ``place``; the next character stands at the place after the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, tuple[list[np.ndarray], list[np.ndarray]]] = {}
        for batch in batches:
            for length, *shard in zip(batch.column("length").to_pylist(), batch.column("x"), batch.column("y")):
                for levels, cells, row in zip(total.setdefault(length, ([], [])), shard, (length * size, size)):
                    if row:
                        _add_cells(levels, np.frombuffer(cells.as_buffer(), np.uint8), row)
        for length, (x, y) in total.items():
            counts = np.concatenate([_cell_counts(x, length * size), _cell_counts(y, size)]).reshape(length + 1, size)
            place, code = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(place.astype(np.int32)), pa.array(code.astype(np.int32)), pa.array(counts[place, code].astype(np.int64))],
                ["place", "code", "n"],
            )

    parts = tensors.select("n", "length", "x", "y").mapInArrow(run, "place int, code int, n long")
    return parts.groupBy("place", "code").agg(F.sum("n").alias("n"))


def one_hot(code: Column, size: int | Column) -> Column:
    """Dense boolean vector of a code; for small exports only."""
    size = size if isinstance(size, Column) else F.lit(size)
    return F.transform(F.sequence(F.lit(0), size - 1), lambda i: i == code)


def next_char_distribution(df: DataFrame, text: str = "text", context: int = 3) -> DataFrame:
    """How often each character follows each run of ``context`` characters, and its share ``p``.

    Runs with their next character are counted as one text first, with map-side combination; they are
    taken apart only after that.
    """
    whole = _segments(df, [], F.lower(text), context, 1, F.lit(0).cast("bigint"))
    grams = whole.select(F.explode(_overlapping("piece", context + 1, context + 1, 1)).alias("_gram"))
    counted = grams.groupBy("_gram").agg(F.count("*").alias("n"))
    parts = counted.select(
        F.substring("_gram", 1, context).alias("context"), F.substring("_gram", context + 1, 1).alias("ch"), "n"
    )
    return parts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("context")))
