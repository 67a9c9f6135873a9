"""Spelling variants: generated edits probed against broadcast blocked Bloom filters, positives joined exactly (operator 12)."""

import re
import zlib
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonoframe.llm.shared import attach, forget, pieces, stored

LETTERS = "A-Za-zÀ-ÿ"
MIN_CHARS, MIN_COUNT, RATIO = 5, 3, 2
HELD_WORDS = 200_000        # words that a counting task holds before it hands its counts on
BITS = 16                   # filter bits a word
BLOCK = 256                 # bits of a filter block: four words of 64 bits, two bits of a key in each
SHARD_BLOCKS = 1 << 16      # blocks of a filter shard at most, 2 MB
PASS_BYTES = 32 << 20       # filter bytes broadcast at once; a larger vocabulary is probed in several passes
PROBE_WORDS = 4_096         # vocabulary words that a probing task takes, about
CELLS = 1 << 18             # edits probed at a time

_BASE, _ODD, _ODDER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


# --- vocabulary -------------------------------------------------------------------------
def _counted(min_chars: int, delete_every: int | None):
    """Kernel: words and their counts, added up over stretches of a partition."""
    runs = re.compile(f"[{LETTERS}]{{{min_chars},}}")  # a shorter run cannot give a word

    def counts(totals):
        return pa.RecordBatch.from_arrays([pa.array(totals.keys(), pa.string()), pa.array(totals.values(), pa.int64())], ["word", "n"])

    def run(batches):
        totals = {}
        for batch in pieces(batches):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                if text is None:
                    continue
                found = Counter(runs.findall(text.lower().decode("utf-8", "replace")))  # on bytes: A-Z only
                begin = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for word, n in found.items():
                    if delete_every is not None:
                        h = zlib.crc32(word.encode(), begin)
                        if h % delete_every == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1:]
                            if len(word) < min_chars:
                                continue
                    totals[word] = totals.get(word, 0) + n
            if len(totals) > HELD_WORDS:
                yield counts(totals)
                totals = {}
        yield counts(totals)

    return run


def vocabulary(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", *, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, delete_every: int | None = None,
) -> DataFrame:
    """``word, n``: the distinct runs of letters with enough characters and occurrences; stored.

    With ``delete_every``, a run whose checksum with its document's id is divisible by it loses one letter first.
    """
    rows = docs.select(F.col(f"`{id_column}`").cast("string"), F.col(f"`{text_column}`").cast("string"))
    counts = rows.mapInArrow(_counted(min_chars, delete_every), "word string, n long")
    return stored(counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count))


# --- hashes and filters --------------------------------------------------------------------
def _letter_codes(chars: np.ndarray) -> np.ndarray:
    """A random-looking 64-bit number for each code point."""
    z = chars.astype(np.uint64) * _BASE
    z = (z ^ (z >> np.uint64(30))) * _ODD
    return z ^ (z >> np.uint64(27))


def _powers(length: int) -> np.ndarray:
    return np.concatenate([[np.uint64(1)], np.cumprod(np.full(length, _ODDER | np.uint64(1)))])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _ODD
    return h ^ (h >> np.uint64(29))


def _letters(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row for each word."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)


def _blocks(h: np.ndarray, blocks: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)


def _lane_bits(h: np.ndarray, lane: int) -> np.ndarray:
    z, one = h * _ODDER >> np.uint64(8), np.uint64(1)
    first, second = z >> np.uint64(12 * lane), z >> np.uint64(12 * lane + 6)
    return (one << (first & np.uint64(63))) | (one << (second & np.uint64(63)))


def word_hashes(words: list[str]) -> np.ndarray:
    """Hashes of words of one length: powers of an odd number times the letters' codes, mixed."""
    letters = _letters(words)
    return _mixed((_letter_codes(letters) * _powers(letters.shape[1])[:-1]).sum(axis=1, dtype=np.uint64))


def filter_blocks(words: int) -> int:
    return max(1, -(-words * BITS // BLOCK))


def filled(h: np.ndarray, blocks: int, first: int, last: int) -> np.ndarray:
    """Blocks ``first`` to ``last`` of the filter that holds the hashes."""
    at = _blocks(h, blocks)
    held = (at >= first) & (at < last)
    at, h = (at[held] - np.uint64(first)).astype(np.int64), h[held]
    lanes = np.zeros((last - first, BLOCK // 64), np.uint64)
    for lane in range(lanes.shape[1]):
        np.bitwise_or.at(lanes[:, lane], at, _lane_bits(h, lane))
    return lanes


def probed(h: np.ndarray, blocks: int, shards: dict) -> np.ndarray:
    """Places of the hashes that a filter may hold; ``shards`` are the blocks at hand, by their first block."""
    at, places = _blocks(h, blocks).astype(np.int64), []
    for first, lanes in shards.items():
        live = np.flatnonzero((at >= first) & (at < first + len(lanes))) if len(lanes) < blocks else np.arange(len(h))
        for lane in range(lanes.shape[1]):
            live = live[(lanes[at[live] - first, lane] & (bits := _lane_bits(h[live], lane))) == bits]
        places.append(live)
    return np.concatenate(places) if places else np.zeros(0, np.int64)


def _shard_filters(sizes: dict):
    """Kernel: the filter blocks of whole shards (length, first block, word), sorted by shard, and the letters used."""

    def run(batches):
        shard, h, letters = None, [], set()

        def made():
            length, first = shard
            blocks = filter_blocks(sizes[length])
            lanes = filled(np.concatenate(h), blocks, first, min(blocks, first + SHARD_BLOCKS))
            return pa.RecordBatch.from_arrays([pa.array([length], pa.int32()), pa.array([first], pa.int32()), pa.array([lanes.tobytes()], pa.binary()),
                                               pa.array(["".join(sorted(letters))], pa.string())], ["length", "first", "lanes", "letters"])

        for batch in pieces(batches, 4_096):
            lengths, firsts, words = [c.to_pylist() for c in batch.columns]
            cuts = [0, *[i for i in range(1, len(words)) if (lengths[i], firsts[i]) != (lengths[i - 1], firsts[i - 1])], len(words)]
            for a, b in zip(cuts, cuts[1:]):
                if a < b:
                    if shard is not None and shard != (lengths[a], firsts[a]):
                        yield made()
                        h, letters = [], set()
                    shard = lengths[a], firsts[a]
                    h.append(word_hashes(words[a:b]))
                    letters.update(*words[a:b])
        if h:
            yield made()

    return run


def _placed(sizes: dict):
    """Kernel: the length of every word and the first block of its filter shard."""

    def run(batches):
        for batch in pieces(batches, 4_096):
            words = batch.column(0).to_pylist()
            lengths = np.array([len(w) for w in words], np.int64)
            first = np.zeros(len(words), np.int64)
            for length in np.unique(lengths):
                rows = np.flatnonzero(lengths == length)
                at = _blocks(word_hashes([words[r] for r in rows]), filter_blocks(sizes[int(length)])).astype(np.int64)
                first[rows] = at // SHARD_BLOCKS * SHARD_BLOCKS
            yield pa.RecordBatch.from_arrays([pa.array(lengths, pa.int32()), pa.array(first, pa.int32()), batch.column(0)], ["length", "first", "word"])

    return run


# --- edits -------------------------------------------------------------------------------
def _edits(words: list[str], letters: np.ndarray, sizes: dict, shards: dict):
    """``(row, edit)`` of the deletions of words of one length, and of the replacements by greater letters, that a filter may hold.

    Any two near words differ by a deletion from one of them or by a replacement whose letter is greater in one, so each pair
    is found from one side only.  Of equal neighbouring letters only the first is deleted.
    """
    chars = _letters(words)
    n, length = chars.shape
    powers, codes = _powers(length), _letter_codes(chars)
    terms = codes * powers[:-1]
    plain = terms.sum(axis=1, dtype=np.uint64)
    shorter = shards.get(length - 1)
    if shorter:
        before = np.cumsum(terms, axis=1, dtype=np.uint64) - terms
        moved = codes[:, 1:] * powers[:length - 1]
        after = np.concatenate([np.cumsum(moved[:, ::-1], axis=1, dtype=np.uint64)[:, ::-1], np.zeros((n, 1), np.uint64)], axis=1)
        distinct = np.concatenate([np.ones((n, 1), bool), chars[:, 1:] != chars[:, :-1]], axis=1)
        rows, at = np.nonzero(distinct)
        for p in probed(_mixed((before + after)[rows, at]), filter_blocks(sizes[length - 1]), shorter):
            r, i = rows[p], at[p]
            yield r, words[r][:i] + words[r][i + 1:]
    equal = shards.get(length)
    if equal:
        new = _letter_codes(letters)
        for i in range(length):
            rows, letter = np.nonzero(letters[None, :] > chars[:, i][:, None])
            h = _mixed(plain[rows] + (new[letter] - codes[rows, i]) * powers[i])
            for p in probed(h, filter_blocks(sizes[length]), equal):
                r = rows[p]
                yield r, words[r][:i] + chr(letters[letter[p]]) + words[r][i + 1:]


def _positives(sizes: dict, sent):
    """Kernel: the edits of every word that the filters at hand may hold."""

    def run(batches):
        letters, shards = sent.value
        for batch in pieces(batches, PROBE_WORDS):
            words, counts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            by_length = {}
            for r, word in enumerate(words):
                by_length.setdefault(len(word), []).append(r)
            for length, rows in by_length.items():
                step = max(1, CELLS // (len(letters) + length))
                for at in range(0, len(rows), step):
                    some = rows[at:at + step]
                    found = list(_edits([words[r] for r in some], letters, sizes, shards))
                    for cut in range(0, len(found), 8_192):
                        some_found = found[cut:cut + 8_192]
                        of = [some[r] for r, _ in some_found]
                        yield pa.RecordBatch.from_arrays([pa.array([words[r] for r in of], pa.string()), pa.array([counts[r] for r in of], pa.int64()),
                                                          pa.array([e for _, e in some_found], pa.string())], ["word", "n", "edit"])

    return run


def near_words(words: DataFrame, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """``word, n, near, near_n``: pairs of stored ``words`` one insertion, deletion or replacement apart, each pair once; stored.

    The filters of all words are cut into shards by length and block, of at most 2 MB.  Shards are broadcast ``pass_bytes`` at a
    time; in each pass all words probe their edits against the shards at hand, and what a filter may hold is shuffled to a
    join with the vocabulary, which removes the false positives.
    """
    spark = words.sparkSession
    sizes = dict(words.groupBy(F.length("word").alias("length")).agg(F.count("*")).collect())  # a row for each length that occurs
    placed = stored(words.select("word").mapInArrow(_placed(sizes), "length int, first int, word string"))
    shards = sorted((length, first) for length, n in sizes.items() for first in range(0, filter_blocks(n), SHARD_BLOCKS))
    spread = words.repartition(max(1, -(-sum(sizes.values()) // PROBE_WORDS)))
    passes, size = [[]], 0
    for length, first in shards:
        own = min(SHARD_BLOCKS, filter_blocks(sizes[length]) - first) * BLOCK // 8
        if passes[-1] and size + own > pass_bytes:
            passes.append([])
            size = 0
        passes[-1].append((length, first))
        size += own
    letters, found = set(), []
    made = placed.repartition("length", "first").sortWithinPartitions("length", "first").mapInArrow(
        _shard_filters(sizes), "length int, first int, lanes binary, letters string")
    filters = stored(made)
    for (some,) in filters.select("letters").distinct().collect():
        letters.update(some)
    alphabet = np.array(sorted(map(ord, letters)), np.uint32)
    for some in passes:
        held: dict = {}
        if some:
            (low, low_first), (high, high_first) = some[0], some[-1]
            after = (F.col("length") > low) | ((F.col("length") == low) & (F.col("first") >= low_first))
            until = (F.col("length") < high) | ((F.col("length") == high) & (F.col("first") <= high_first))
            for r in filters.filter(after & until).select("length", "first", "lanes").collect():
                held.setdefault(r["length"], {})[r["first"]] = np.frombuffer(r["lanes"], np.uint64).reshape(-1, BLOCK // 64)
        sent = spark.sparkContext.broadcast((alphabet, held))
        found.append(stored(spread.mapInArrow(_positives(sizes, sent), "word string, n long, edit string")))
        sent.destroy()
    positives = reduce(DataFrame.unionByName, found)
    exact = words.select(F.col("word").alias("edit"), F.col("n").alias("near_n"))
    near = stored(positives.join(exact, "edit").select("word", "n", F.col("edit").alias("near"), "near_n"))
    for table in (placed, filters, *found):
        forget(table)
    return near


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for stored ``word, form``: the last word that the forms lead to, by doubling; as many rounds as the logarithm of the longest way."""
    current = forms.select("word", F.col("form").alias("root"))
    while True:
        onward = current.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = stored(attach(current, onward, "root").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if further.filter("moved").isEmpty():
            return further.select("word", "root")
        current = further.select("word", "root")


def spelling_variants(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", *, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, ratio: int = RATIO,
    delete_every: int | None = None, pass_bytes: int = PASS_BYTES,
) -> DataFrame:
    """``word, form, root, n, n_near, form_n``: the frequent words of all texts, and the likely right spelling of each.

    Words are runs of Latin letters, A-Z lower-cased, with ``min_chars`` code points and ``min_count`` occurrences (``n``).  Near words differ
    by one inserted, deleted or replaced code point; ``n_near`` counts them.  The form of a word is its near word of largest n, the
    smaller one in code-point order on ties, if that has at least ``ratio`` times its n, else null; ``root`` follows forms to the
    last and is the word itself without one.

    Null and empty texts have no words and very long ones are read whole.  Rows count as often as they occur, rows that repeat an id
    too; ids, null ones included, only matter with ``delete_every``, where a null id reads as an empty one.  An empty table gives an empty result;
    further columns are not carried.
    """
    if ratio < 2:
        raise ValueError("forms must be more frequent, or they could lead in circles")
    words = vocabulary(docs, id_column, text_column, min_chars=min_chars, min_count=min_count, delete_every=delete_every)
    near = near_words(words, pass_bytes)
    back = near.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    best = near.unionByName(back).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    best = stored(best.select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n")))
    enough = F.col("near_n") >= ratio * F.col("n")
    judged = stored(attach(words, best, "word").select(
        "word", F.when(enough, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(enough, F.col("near_n")).alias("form_n")))
    roots = _roots(stored(judged.filter("form is not null").select("word", "form")))
    return attach(judged, roots, "word").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
