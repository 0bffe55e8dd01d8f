"""Token counts of whole texts by a public tokenizer.

Texts are split at boundaries that no token crosses, and every distinct piece of a batch is encoded once; a
bounded memory of pieces lives as long as its task. Tasks return lengths only. Batches are balanced by bytes, and
a long text is just many pieces, so nothing is truncated.

Safe boundaries. The word tokenizer drops white space before it forms tokens, and normalises it away, so any
ASCII white space is one. The byte tokenizer keeps white space with the word behind it: there only a blank
between two characters that are no white space is one, and it starts the next piece.

Defined cases: a null text is empty and has no tokens; repeated rows are counted each; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from songloom.llm.common import coded, ragged, steps, sums, words_of

#: Pieces that a task remembers before it drops those not met since half as many ago.
REMEMBERED = 600_000
#: Bytes of pieces that are encoded in one call.
CALL_BYTES = 1 << 16
#: The same for pieces that are joined without marks; every call costs some milliseconds of its own.
JOINED_BYTES = 1 << 20


class Pieces:
    """Token ids of text pieces, remembered. ``mark`` is a special token's text, used to tell pieces apart."""

    def __init__(self, path: str, mark: str = "<|endoftext|>"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.mark, self.mark_id = mark, self.tokenizer.token_to_id(mark)
        self.known: dict[str, np.ndarray | int] = {}
        self.older: dict[str, np.ndarray | int] = {}

    def _encode(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _encode_many(self, pieces: list[str]) -> list[np.ndarray]:
        """One call for all pieces; the mark between them ends a token and is cut out again."""
        ids = self._encode(self.mark.join(pieces))
        cuts = np.flatnonzero(ids == self.mark_id)
        return [part[1:] if i else part for i, part in enumerate(np.split(ids, cuts))]

    def learn(self, pieces: list[str], keep) -> None:
        """Encode those of ``pieces`` not yet known, in calls of about equal bytes; ``keep`` makes the value of the ids."""
        if len(self.known) > REMEMBERED // 2:
            self.older, self.known = self.known, {}
        fresh = []
        for piece in pieces:
            if piece not in self.known:
                if piece in self.older:
                    self.known[piece] = self.older[piece]
                else:
                    fresh.append(piece)
        group: list[str] = []
        held = 0
        for piece in fresh:
            if "<|" in piece:  # may hold a special token's text itself, so it is encoded alone
                self.known[piece] = keep(self._encode(piece))
                continue
            group.append(piece)
            held += len(piece)
            if held > CALL_BYTES:
                self.known.update(zip(group, map(keep, self._encode_many(group))))
                group, held = [], 0
        if group:
            self.known.update(zip(group, map(keep, self._encode_many(group))))


def count_tokens(
    docs: DataFrame, tokenizer: str, limit: int = 2048, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``id, n_bytes, n_tokens, over_limit`` per row, for a tokenizer that drops white space between words.

    ``tokenizer`` is a path of a ``tokenizers`` file that exists on every executor.
    """
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        pieces = Pieces(tokenizer)
        for batch in steps(batches, "text"):
            texts = pc.fill_null(batch.column("text"), "")
            words, starts = words_of(texts)
            codes, distinct = coded(words)
            distinct = distinct.to_pylist()
            pieces.learn(distinct, len)
            lengths = np.fromiter((pieces.known[w] for w in distinct), np.int64, len(distinct))
            counts = sums(lengths[codes], starts)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pc.binary_length(texts).cast(pa.int64()),
                    pa.array(counts),
                    pa.array(counts > limit),
                ],
                ["id", "n_bytes", "n_tokens", "over_limit"],
            )

    narrow = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    counted = narrow.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return counted.withColumnRenamed("id", id_column)


_INNER_BLANK = re.compile(r"(?<=\S)(?= \S)")


# How the byte tokenizer splits a text, the name of its splitter, and the characters it writes bytes with.
SPLITTER = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHOWN_BYTES = (*range(33, 127), *range(161, 173), *range(174, 256))
#: Characters that every version of the Unicode tables classes alike.
LATIN = r"^[\x{20}-\x{7e}\x{c0}-\x{24f}]*$"


def quick_encoding(path: str):
    """The same vocabulary in the library that merges by rank, which is four times as fast on words not met before.

    Only where both give the same ids: bytes and then merges in the order of their ids, the known splitter, and nothing done to
    texts before or after. None otherwise, or without that library; the tokenizers library then does all.
    """
    try:
        import tiktoken
    except ImportError:
        return None
    with open(path, encoding="utf-8") as file:
        written = json.load(file)
    model, splitter = written["model"], written.get("pre_tokenizer") or {}
    plain = not any(written.get(k) for k in ("normalizer", "post_processor")) and not any(
        model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
    )
    if model.get("type") != "BPE" or not plain or any(splitter.get(k) != v for k, v in SPLITTER.items()):
        return None
    hidden = [b for b in range(256) if b not in SHOWN_BYTES]
    byte_of = {chr(b): b for b in SHOWN_BYTES} | {chr(256 + k): b for k, b in enumerate(hidden)}
    vocab = model["vocab"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    if any(vocab.get(a + b) != 256 + rank for rank, (a, b) in enumerate(merges)):
        return None
    special = {t["content"] for t in written.get("added_tokens", [])}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if token not in special}
    return tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if len(ranks) == 256 + len(merges) else None


class PieceIds:
    """Token ids of text pieces by the byte tokenizer, in one array; pieces are known by their number in it."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Bytes that each token stands for: its text has one character per byte.
        self.bytes_of = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.bytes_of[i] = len(token)
        self.quick = quick_encoding(path)
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.string())
        self.stock = np.zeros(0, np.uint32)
        self.lengths = np.zeros(0, np.int64)
        self.starts = np.zeros(0, np.int64)

    def _one_by_one(self, pieces: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
        encoded = self.tokenizer.encode_batch_fast(pieces.to_pylist(), add_special_tokens=False)
        found = [np.asarray(e.ids, np.uint32) for e in encoded]
        return found, np.array([len(x) for x in found], np.int64)

    def _joined(self, pieces: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
        return self._cut(pieces, lambda text: self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids)

    def _quickly(self, pieces: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
        return self._cut(pieces, self.quick.encode_ordinary)

    def _cut(self, pieces: pa.Array, encode) -> tuple[list[np.ndarray], np.ndarray]:
        """Pieces that begin with a blank as one text: no token crosses such a blank, so byte lengths tell where to cut."""
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(pieces)], pa.int32()), pieces), "")[0].as_py()
        ids = np.asarray(encode(text), np.uint32)
        ends = np.cumsum(self.bytes_of[ids])
        asked = np.cumsum(pc.binary_length(pieces).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = np.searchsorted(ends, asked)
        if len(ids) != at[-1] + 1 or (ends[at] != asked).any():
            return self._one_by_one(pieces)
        return [ids], np.diff(at, prepend=-1)

    def numbers(self, pieces: pa.Array) -> np.ndarray:
        """Numbers of pieces; those not known are encoded, in calls of about equal bytes.

        Numbers hold until the next call.
        """
        if len(self.known) > REMEMBERED:
            self._forget()
        fresh = pieces.filter(pc.is_null(pc.index_in(pieces, value_set=self.known))).unique()
        # A special token's text counts as that token; white space at an end may join that of a neighbour.
        second, last = pc.utf8_slice_codeunits(fresh, 1, 2), pc.utf8_slice_codeunits(fresh, -1)
        blanks = pc.or_(pc.utf8_is_space(second), pc.utf8_is_space(last))
        alone = pc.or_(pc.or_(pc.match_substring(fresh, "<|"), pc.invert(pc.starts_with(fresh, " "))), blanks)
        order, parts, lengths = [self.known], [self.stock], [self.lengths]
        safe = fresh.filter(pc.invert(alone))
        latin = pc.and_(pc.match_substring_regex(safe, LATIN), self.quick is not None)
        calls = ((self._one_by_one, fresh.filter(alone)), (self._joined, safe.filter(pc.invert(latin))), (self._quickly, safe.filter(latin)))
        for call, chosen in calls:
            for group in _groups(chosen):
                ids, sizes = call(group)
                order.append(group)
                parts += ids
                lengths.append(sizes)
        if len(fresh):
            self.known = pa.concat_arrays(order)
            self.stock, self.lengths = np.concatenate(parts), np.concatenate(lengths)
            self.starts = np.cumsum(self.lengths) - self.lengths
        return pc.index_in(pieces, value_set=self.known).to_numpy(zero_copy_only=False).astype(np.int64)


def _groups(pieces: pa.Array) -> list[pa.Array]:
    """Slices of about ``JOINED_BYTES`` bytes, or of one longer piece."""
    before = np.cumsum(pc.binary_length(pieces).to_numpy(zero_copy_only=False), dtype=np.int64) // JOINED_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(before)) + 1).tolist(), len(pieces)] if len(pieces) else [0]
    return [pieces.slice(begin, end - begin) for begin, end in zip(cuts, cuts[1:])]


#: Words of one ASCII character or more, none of them white space.
_PLAIN = "^[!-~]+$"


def encoded(texts: pa.Array, pieces: PieceIds) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all texts one after the other, and where each text starts, for the byte tokenizer."""
    texts = pc.fill_null(texts, "")
    lists = pc.split_pattern(texts, " ")
    flat = lists.flatten()
    offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    codes, distinct = coded(flat)
    # A piece that is empty, starts or ends with white space has no safe boundary beside it.
    odd = ~pc.match_substring_regex(distinct, _PLAIN).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(odd)
    odd[at] = [not w or w[0].isspace() or w[-1].isspace() for w in distinct.take(pa.array(at)).to_pylist()]
    row_odd = sums(odd[codes].astype(np.int64), offsets) > 0
    first = np.zeros(len(codes), bool)
    first[offsets[:-1]] = True  # splitting gives every text one piece at least
    plain = np.repeat(~row_odd, np.diff(offsets))
    begins, follows = (np.flatnonzero(np.bincount(codes[plain & x], minlength=len(distinct))) for x in (first, ~first))
    names = [distinct.take(pa.array(begins)), pc.binary_join_element_wise("", distinct.take(pa.array(follows)), " ")]
    apart = {i: _INNER_BLANK.split(texts[i].as_py()) for i in np.flatnonzero(row_odd).tolist()}
    extra = sorted({p for row in apart.values() for p in row})
    number = pieces.numbers(pa.concat_arrays([*(n.cast(pa.string()) for n in names), pa.array(extra, pa.string())]))
    words = len(begins) + len(follows)
    slot = np.zeros((2, max(1, len(distinct))), np.int64)
    slot[0, begins] = number[: len(begins)]
    slot[1, follows] = number[len(begins) : words]
    chosen = slot[(~first).astype(np.int64), codes]
    row_starts = offsets
    if apart:
        place = dict(zip(extra, number[words:].tolist()))
        parts, counts = [], np.diff(offsets)
        for i in range(len(texts)):
            if i in apart:
                parts.append(np.array([place[p] for p in apart[i]], np.int64))
                counts[i] = len(apart[i])
            else:
                parts.append(chosen[offsets[i] : offsets[i + 1]])
        chosen, row_starts = np.concatenate(parts), np.concatenate(([0], np.cumsum(counts)))
    lengths = pieces.lengths[chosen]
    ids = pieces.stock[ragged(pieces.starts[chosen], lengths)]
    ends = np.concatenate(([0], np.cumsum(lengths)))
    return ids, ends[row_starts]
