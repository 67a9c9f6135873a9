"""Packing token pieces into fixed sequences by minimum bin slack (operator 3)."""

from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonoframe.llm.shared import checked_columns, pieces

LENGTH = 2048
END = 1                       # id closing every document
VOCABULARY = "byte_bpe_50k.json"
WINDOW = 512                  # remainders that compete for a sequence; bounds a task's memory, drops nothing
LONGEST_SPACE = 256           # white space from here on is left to the tokenizer itself, whose split does not backtrack
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value: how byte-level files cut texts
_PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """Token ids of texts as little-endian uint32 bytes, from a byte-level tokenizer file.

    A plain byte-level BPE file is read into ``tiktoken``, which merges the adjacent pair whose joined bytes are the token of the
    lowest rank.  That is the file's own list of merges as long as every token is what the file makes of the token's bytes alone: then
    of the two-part states of a token only the one in the list is ever met.  Tokens for which this fails cannot occur and are
    left out.  Texts with an added token or a long run of white space, and all texts of other kinds of files, go to ``tokenizers``.
    """

    def __init__(self, path: str):
        import json
        import os
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        self.fast = self._merger(parts)
        added = [re.escape(t["content"]) for t in parts.get("added_tokens", ())]
        self.other = re.compile("|".join([*added, rf"\s{{{LONGEST_SPACE}}}"]))

    def _merger(self, parts: dict):
        model, split = parts["model"], parts.get("pre_tokenizer") or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        if (model.get("type") != "BPE" or odd or parts.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space")
                or not split.get("use_regex", True)):
            return None
        import tiktoken

        joined = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        order = [model["vocab"][t] for t in joined]
        letters = _byte_letters()
        if any(a >= b for a, b in zip(order, order[1:])) or any(model["vocab"].get(c, order[0]) >= order[0] for c in letters):
            return None             # ids are no ranks
        tokenize = self.tokenizer.model.tokenize
        ranks = {bytes(letters[c] for c in t): model["vocab"][t] for t in (*letters, *joined) if len(tokenize(t)) == 1}
        return tiktoken.Encoding("byte_level", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        if self.fast is None or self.other.search(text):
            return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()
        return np.array(array("I", self.fast.encode_ordinary(text)), "<u4").tobytes()


def _byte_letters() -> dict[str, int]:
    """Bytes by the letters that stand for them in byte-level files: visible Latin-1 letters are themselves, others follow from U+0100."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = sorted(set(range(256)) - set(visible))
    return {chr(b): b for b in visible} | {chr(256 + n): b for n, b in enumerate(rest)}


def fill(counts: np.ndarray, capacity: int) -> list[int]:
    """Lengths, at most ``counts[length]`` of each, whose sum is the largest up to the capacity.

    The longest length is always part, which keeps long remainders from being left over.  A bitset holds the reachable sums; each
    length enters in binary pieces and the bitset before every piece is kept to backtrack the counts.
    """
    present = np.flatnonzero(counts)[::-1]
    longest = int(present[0])
    room = capacity - longest
    mask, reached, pieces = (1 << room + 1) - 1, 1, []
    for length in present.tolist():
        left, times = min(int(counts[length]) - (length == longest), room // length), 1
        while left and not reached >> room & 1:
            times = min(times, left)
            pieces.append((reached, length, times))
            reached |= (reached << times * length) & mask
            left, times = left - times, 2 * times
        if reached >> room & 1:
            break
    at, chosen = reached.bit_length() - 1, [longest]
    for before, length, times in reversed(pieces):
        if not before >> at & 1:
            at -= times * length
            chosen += [length] * times
    return chosen


class Remainders:
    """Remainders waiting for a sequence, by length."""

    def __init__(self, capacity: int):
        self.capacity, self.waiting, self.items = capacity, 0, {}
        self.counts = np.zeros(capacity + 1, np.int64)

    def add(self, length: int, item) -> None:
        self.items.setdefault(length, []).append(item)
        self.counts[length] += 1
        self.waiting += 1

    def filled(self, leave: int):
        """Item lists of filled sequences until no more than ``leave`` remainders wait."""
        while self.waiting > leave:
            chosen = fill(self.counts, self.capacity)
            for length in chosen:
                self.counts[length] -= 1
            self.waiting -= len(chosen)
            yield [self.items[length].pop() for length in chosen]


def _packed(path: str | None, capacity: int, end: int, window: int):
    """Kernel: encode, cut full sequences off, and pack the remainders of a window of documents."""

    def run(batches):
        from_package = path
        if from_package is None:
            import public_tokenizers

            from_package = public_tokenizers.path(VOCABULARY)
        encoder = Encoder(from_package)
        task = TaskContext.get()
        sequence = (task.partitionId() if task else 0) << 33
        remainders = Remainders(capacity)
        rows: list[tuple] = []

        def batch_of():
            arrays = [pa.array(x, pa.binary() if k == 3 else pa.int64()) for k, x in enumerate(zip(*rows))]
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        def place(filled):
            nonlocal sequence
            for filling in filled:
                offset = 0
                for doc, start, ids, total in filling:
                    length = len(ids) // 4
                    rows.append((doc, start, length, ids, total, sequence, offset))
                    offset += length
                sequence += 1

        closing = np.array([end], "<u4").tobytes()
        for part in pieces(batches, 64):
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                ids = encoder.encode(text or "") + closing
                total = len(ids) // 4
                whole = total // capacity * capacity
                place([(doc, s, ids[4 * s:4 * (s + capacity)], total)] for s in range(0, whole, capacity))
                if total > whole:
                    remainders.add(total - whole, (doc, whole, ids[4 * whole:], total))
            place(remainders.filled(window))
            if len(rows) >= 500:
                yield batch_of()
        place(remainders.filled(0))
        if rows:
            yield batch_of()

    return run


def pack(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = LENGTH, end: int = END, window: int = WINDOW,
         id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Pieces of documents in sequences of at most ``capacity`` tokens: a row per piece.

    Columns ``doc_id, start, length, ids`` (little-endian uint32), ``doc_tokens, sequence_id, offset``.  A document's ids end with ``end``.
    Whole sequences are cut off a document first; the remainder, under one sequence, stays whole and is packed with others of the same task: of
    the last ``window`` remainders, the multiset of lengths that fills a sequence closest.  Nothing is shuffled; a task leaves
    one ill-filled sequence or so at its end.  ``tokenizer_path`` names a tokenizer file that the executors can read; by default
    they take the installed ``byte_bpe_50k.json``.

    Null and empty texts are documents of the closing id alone.  Repeated rows and null ids are packed like any
    others.  An empty table gives an empty result; further columns are not carried.
    """
    rows = checked_columns(docs, id_column, text_column).select(F.col(id_column).cast("long"), F.col(text_column).cast("string"))
    return rows.mapInArrow(_packed(tokenizer_path, capacity, end, window), _PIECES)
