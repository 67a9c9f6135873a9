"""Fuzzy line deduplication: MinHash of character shingles, banding, exact verification, union-find (operator 1)."""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonoframe.llm.components import components
from sonoframe.llm.shared import attach, checked_columns, forget, pieces, stored

SHINGLE = 8          # characters
SIMILARITY = 0.8     # exact Jaccard similarity of the shingle sets
MIN_WORDS = 1        # every line with a word takes part
BANDS, ROWS = 12, 4  # at similarity 0.8 all bands miss 0.2 % of the pairs, at 0.85 0.01 %
AGREEING = 30        # of one bit from each of the 48 minima: pairs at similarity 0.8 have 43 in the mean, 6e-8 of them fewer than this; unlike lines have 24
PAIRS = 512          # pairs of lines compared at a time
FEW = 64             # up to so many lines of a bucket are compared together with those of other buckets
DENSE = 2_048        # lines of a bucket that are compared in one task; a larger bucket is cut into parts
PIECE = 1 << 18      # characters hashed at a time; keeps the working arrays in cache

_RANDOM = np.random.default_rng(20_240_607)
_FACTORS = _RANDOM.integers(0, 1 << 31, BANDS * ROWS, np.uint32) * np.uint32(2) + np.uint32(1)
_OFFSETS = _RANDOM.integers(0, 1 << 32, BANDS * ROWS, np.uint32)
_MIX = _RANDOM.integers(0, 1 << 63, ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_BANDS = [f"b{i}" for i in range(BANDS)]
_SKETCH = [*_BANDS, "bits"]
_LINE = "doc_id long, pos int, h1 long, h2 long"


def comparable(line: str, min_words: int) -> str | None:
    """The line in lower case with single spaces; None if it is too short to take part."""
    line = line.lower()
    line = " ".join(line.split()) if "  " in line or not line.isprintable() else line.strip()  # white space but the space is not printable
    return line if (line.count(" ") + 1 if line else 0) >= min_words else None


def _identity(line: str) -> bytes:
    return xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass"))


def band_keys(lines: list[str]) -> np.ndarray:
    """One 64-bit key per line and band, from the minima of seeded permutations over its shingle hashes; last, a bit of each minimum."""
    out = np.empty((len(lines), BANDS + 1), np.uint64)
    piece, size, first = [], 0, 0
    for i, line in enumerate(lines):
        piece.append(line.ljust(SHINGLE, "\0"))
        size += len(piece[-1])
        if size >= PIECE or i == len(lines) - 1:
            out[first:i + 1] = _piece_keys(piece)
            piece, size, first = [], 0, i + 1
    return out


def _piece_keys(lines: list[str]) -> np.ndarray:
    chars = np.frombuffer(("".join(lines) + "\0" * SHINGLE).encode("utf-32-le", "surrogatepass"), np.uint32)
    hashes, width = chars * np.uint32(0x9E3779B1), 1
    for factor in (0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F):  # 2, 4, 8 characters
        hashes = hashes[:-width] * np.uint32(factor) + hashes[width:]
        hashes ^= hashes >> np.uint32(15)
        width *= 2
    ends = np.cumsum([len(x) for x in lines])
    whole = np.ones(ends[-1], bool)  # where a shingle lies in one line
    for k in range(1, SHINGLE):
        whole[ends - k] = False
    hashes = hashes[:len(whole)][whole]
    starts = np.concatenate([[0], ends[:-1] - np.arange(1, len(lines)) * (SHINGLE - 1)])
    minima = np.empty((BANDS * ROWS, len(lines)), np.uint32)
    work = np.empty_like(hashes)
    for k in range(BANDS * ROWS):
        np.multiply(hashes, _FACTORS[k], out=work)
        work += _OFFSETS[k]
        np.minimum.reduceat(work, starts, out=minima[k])
    keys = np.zeros((BANDS, len(lines)), np.uint64)
    for r in range(ROWS):
        keys = (keys ^ minima[r::ROWS].astype(np.uint64)) * _MIX[r]
        keys ^= keys >> np.uint64(29)
    keys = keys * np.uint64(BANDS) + np.arange(BANDS, dtype=np.uint64)[:, None]  # a band has its own keys
    bits = (minima * np.uint32(0x9E3779B1) >> np.uint32(31)).astype(np.uint64) << np.arange(BANDS * ROWS, dtype=np.uint64)[:, None]
    return np.concatenate([keys, bits.sum(axis=0, dtype=np.uint64)[None]]).T


def _alike(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Whether bits of the minima agree often enough for the pair to be worth its exact comparison."""
    return np.bitwise_count((one ^ two).view(np.uint64)) <= BANDS * ROWS - AGREEING


def _occurrences(min_words: int, with_bands: bool):
    """Kernel: a row per line that takes part, with its 128-bit identity and, on request, its band keys.

    A line under ``SHINGLE`` characters is its own only shingle, which no other line has: it needs no keys, they are null.
    """

    def run(batches):
        for batch in pieces(batches):
            ids, places, digests, which, known, lines = [], [], [], [], {}, []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if doc is None or text is None:
                    continue
                for pos, line in enumerate(text.split("\n")):
                    line = comparable(line, min_words)
                    if line is not None:
                        digest = _identity(line)
                        ids.append(doc), places.append(pos), digests.append(digest)
                        if with_bands:
                            if digest not in known:
                                known[digest] = len(lines) if len(line) >= SHINGLE else -1
                                if len(line) >= SHINGLE:
                                    lines.append(line)
                            which.append(known[digest])
            if not ids:
                continue
            halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            arrays = [pa.array(ids, pa.int64()), pa.array(places, pa.int32()), pa.array(halves[:, 0]), pa.array(halves[:, 1])]
            if with_bands:
                which = np.array(which)
                keys = np.concatenate([band_keys(lines), np.zeros((1, BANDS + 1), np.uint64)])[which].view(np.int64)  # -1 takes the last
                arrays += [pa.array(np.ascontiguousarray(keys[:, b]), mask=which < 0) for b in range(BANDS + 1)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "pos", "h1", "h2", *(_SKETCH if with_bands else [])])

    return run


def _number(value: int, digits: int) -> Column:
    return F.lit(str(value)).cast(f"decimal({digits},0)")


def place_of() -> Column:
    """Order of a line in the corpus, by document id and then by position, as one number."""
    return (F.col("doc_id").cast("decimal(20,0)") + _number(2**63, 20)) * _number(2**31, 11) + F.col("pos")


def _bucket_rows(batches, rows_of):
    """Whole buckets of rows (key, ...) sorted by key, as column arrays; a key never spans two partitions."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        end = int(np.searchsorted(new[0], new[0][-1]))
        if end or (held and held[-1][0][-1] != new[0][0]):
            held.append([c[:end] for c in new])
            yield from rows_of([np.concatenate(x) for x in zip(*held)])
            held = []
        held.append([c[end:] for c in new])
    if held:
        yield from rows_of([np.concatenate(x) for x in zip(*held)])


def _centres(bits: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Index of the row of each bucket whose bits are nearest to the bucket's majority, the first of several."""
    votes = np.add.reduceat((bits[:, None] >> np.arange(BANDS * ROWS)) & 1, starts, axis=0) * 2 > sizes[:, None]
    majority = (votes.astype(np.int64) << np.arange(BANDS * ROWS)).sum(axis=1)
    away = np.bitwise_count((bits ^ np.repeat(majority, sizes)).view(np.uint64)).astype(np.int64)
    return np.minimum.reduceat((away << 40) | np.arange(len(bits)), starts) & ((1 << 40) - 1)


def _star_pairs(batches):
    """Pairs of each bucket's centre with its others; with key set, the members of buckets of three and more.

    The centre is the line that is likest to the bucket as a whole, so that variants of one line mostly link to it.
    """

    def rows_of(columns):
        keys, lines, bits = columns
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.append(starts, len(keys)))
        centre, many = starts.copy(), np.flatnonzero(sizes > 2)
        if len(many):
            rows, own = np.flatnonzero(np.repeat(sizes > 2, sizes)), sizes[many]
            centre[many] = rows[_centres(bits[rows], np.cumsum(own) - own, own)]
        first, size = np.repeat(lines[centre], sizes), np.repeat(sizes, sizes)
        other = (first != lines) & _alike(np.repeat(bits[centre], sizes), bits)
        none = np.zeros(int(other.sum()), np.int64)
        names = ["a", "b", "key", "bits"]
        ends = [pa.array(pick(first[other], lines[other])) for pick in (np.minimum, np.maximum)]
        yield pa.RecordBatch.from_arrays([*ends, *[pa.array(none, mask=none == 0)] * 2], names)
        more = size > 2
        yield pa.RecordBatch.from_arrays([pa.array(x[more]) for x in (first, lines, keys, bits)], names)

    yield from _bucket_rows(batches, rows_of)


def _unsettled(batches):
    """Kernel: the members of buckets (key, line, root, bits) that some member of another component resembles by its bits.

    In a large bucket with several components all members are taken, without looking at pairs.
    """

    def rows_of(columns):
        keys, lines, roots, bits = columns
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.append(starts, len(keys)))
        mixed = np.minimum.reduceat(roots, starts) != np.maximum.reduceat(roots, starts)
        wanted = np.repeat(mixed & (sizes > DENSE), sizes)
        alive, step = np.flatnonzero(np.repeat(mixed & (sizes <= DENSE), sizes)), 1
        while True:
            alive = alive[alive + step < len(keys)]
            alive = alive[keys[alive] == keys[alive + step]]
            if not len(alive):
                break
            i, j = alive, alive + step
            apart = (roots[i] != roots[j]) & _alike(bits[i], bits[j])
            wanted[i[apart]] = wanted[j[apart]] = True
            step += 1
        yield pa.RecordBatch.from_arrays([pa.array(c[wanted]) for c in columns], ["key", "line", "root", "bits"])

    yield from _bucket_rows(batches, rows_of)


def _links_within(threshold: float):
    """Kernel: links between the components of each bucket, from rows (key, side, line, root, bits, text) sorted by bucket.

    A line is compared with all later ones of other components that its bits resemble, exactly and at once.  Large buckets are
    settled line by line, and a link joins two components there, so it has fewer links than lines.  Rows of side 1 are only compared
    with those of side 0, those of side 2 with all.
    """

    def large(sides, lines, roots, bits, texts):
        label, known = np.unique(roots, return_inverse=True)[1], {}
        columns_of = [np.fromiter([known.setdefault(x, len(known)) for x in shingles(t)], np.int64) for t in texts]
        size = np.array([len(c) for c in columns_of])
        ends = np.cumsum(size)
        flat, flag = np.concatenate(columns_of), np.zeros(len(known), np.int64)
        for i in range(len(label) - 1):
            later = np.arange(i + 1, len(label))
            other = later[(label[later] != label[i]) & ((sides[later] != sides[i]) | (sides[later] == 2)) & _alike(np.full(len(later), bits[i]), bits[later])
                          & (np.minimum(size[later], size[i]) >= threshold * np.maximum(size[later], size[i]))]
            if not len(other):
                continue
            flag[columns_of[i]] = 1
            if len(other) * 2 > len(later):
                both = np.add.reduceat(flag[flat[ends[i]:]], ends[i:-1] - ends[i])[other - i - 1]
            else:
                both = np.array([flag[columns_of[j]].sum() for j in other])
            flag[columns_of[i]] = 0
            for j in other[both >= threshold * (size[i] + size[other] - both)]:
                if label[j] != label[i]:
                    yield lines[i], lines[j]
                    label[label == label[j]] = label[i]

    def small(keys, lines, roots, bits, texts):
        alive, step, pairs = np.arange(len(keys)), 1, []
        while True:
            alive = alive[alive + step < len(keys)]
            alive = alive[keys[alive] == keys[alive + step]]
            if not len(alive):
                break
            i, j = alive, alive + step
            apart = (roots[i] != roots[j]) & _alike(bits[i], bits[j])
            pairs.append(np.stack([i[apart], j[apart]]))
            step += 1
        left, right = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), np.int64)
        for at in range(0, len(left), PAIRS):
            of, place = np.unique(np.concatenate([left[at:at + PAIRS], right[at:at + PAIRS]]), return_inverse=True)
            i, j = place.reshape(2, -1)
            near = similar_pairs([texts[k] for k in of], i, j, threshold)
            yield from zip(lines[of[i[near]]], lines[of[j[near]]])

    def rows_of(columns):
        keys, sides, lines, roots, bits, texts = columns
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.append(starts, len(keys)))
        few = np.repeat((sizes <= FEW) & (sides[starts] == 2), sizes)
        found = list(small(*[c[few] for c in (keys, lines, roots, bits, texts)]))
        for first, last in zip(starts, starts + sizes):
            if not few[first]:
                found += large(*[c[first:last] for c in (sides, lines, roots, bits, texts)])
        a, b = zip(*found) if found else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def run(batches):
        yield from _bucket_rows(batches, rows_of)

    return run


def similar_pairs(texts: list[str], left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs of texts, given by their places (4,096 texts at most), have shingle sets of the wanted similarity.

    The sets are counted over 52-bit hashes of the shingles, all texts at once; a pair within two shingles of the threshold is
    counted again over the shingles themselves.
    """
    if not len(left):
        return np.zeros(0, bool)
    padded = [t.ljust(SHINGLE, "\0") for t in texts]
    chars = np.frombuffer(("".join(padded) + "\0" * SHINGLE).encode("utf-32-le", "surrogatepass"), np.uint32)
    hashes, width = chars.astype(np.uint64) * _MIX[0], 1
    while width < SHINGLE:
        hashes = hashes[:-width] * _MIX[1] + hashes[width:]
        hashes ^= hashes >> np.uint64(31)
        width *= 2
    lengths = np.array([len(t) for t in padded])
    whole = np.repeat(lengths - SHINGLE + 1 + np.cumsum(lengths) - lengths, lengths)  # where the next text would be entered
    at = np.arange(lengths.sum())
    within = at < whole
    owner = np.repeat(np.arange(len(texts), dtype=np.uint64), lengths)[within] << np.uint64(52)
    sets = np.sort(owner | (hashes[:len(at)][within] * _MIX[2] >> np.uint64(12)))
    sets = sets[np.concatenate([[True], sets[1:] != sets[:-1]])]
    size = np.bincount((sets >> np.uint64(52)).astype(np.int64), minlength=len(texts))
    first = np.cumsum(size) - size
    swap = size[left] > size[right]
    one, two = np.where(swap, right, left), np.where(swap, left, right)
    ends = np.cumsum(size[one])
    place = np.arange(ends[-1]) + np.repeat(first[one] - (ends - size[one]), size[one])
    wanted = (sets[place] & np.uint64((1 << 52) - 1)) | (np.repeat(two, size[one]).astype(np.uint64) << np.uint64(52))
    hit = sets[np.minimum(np.searchsorted(sets, wanted), len(sets) - 1)] == wanted
    both = np.add.reduceat(hit.astype(np.int64), ends - size[one])
    over = both - threshold * (size[left] + size[right] - both)
    near = over >= 0
    for k in np.flatnonzero(np.abs(over) <= 4):  # a shingle more or less in both sets moves this by two at most
        a, b = shingles(texts[left[k]]), shingles(texts[right[k]])
        near[k] = len(a & b) >= threshold * (len(a) + len(b) - len(a & b))
    return near


def shingles(line: str) -> frozenset:
    return frozenset([line[i:i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1))])


def _similar(threshold: float):
    """Kernel: keep the pairs (a, b, text_a, text_b) whose shingle sets reach the threshold."""

    def run(batches):
        for batch in pieces(batches, PAIRS):
            a, b, text_a, text_b = [c.to_pylist() for c in batch.columns]
            place, texts = {}, []
            for line, text in zip(a + b, text_a + text_b):
                if line not in place:
                    place[line] = len(texts)
                    texts.append(text)
            near = similar_pairs(texts, np.array([place[x] for x in a], np.int64), np.array([place[x] for x in b], np.int64), threshold)
            yield batch.select(["a", "b"]).filter(pa.array(near))

    return run


def _lines_at(min_words: int):
    """Kernel: the comparable text of wanted lines, from (text, list of (pos, line id))."""

    def run(batches):
        for batch in pieces(batches):
            names, texts = [], []
            for text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                lines = (text or "").split("\n")
                for w in wanted:
                    line = comparable(lines[w["pos"]], min_words) if w["pos"] < len(lines) else None
                    if line is not None and _identity(line) == np.array([w["h1"], w["h2"]], np.int64).tobytes():
                        names.append(w["line"]), texts.append(line)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(texts, pa.string())], ["line", "text"])

    return run


def _texts(lines: DataFrame, rows: DataFrame, classes: DataFrame, min_words: int) -> DataFrame:
    """``line, text`` of the wanted ``line`` column; only documents that hold one of the lines give texts."""
    place = F.col("first") % _number(2**31, 11)
    at = classes.select("line", "h1", "h2", place.cast("int").alias("pos"),
                        ((F.col("first") - place) / _number(2**31, 11) - _number(2**63, 20)).cast("long").alias("at_id"))
    wanted = stored(at.join(lines.select("line").distinct(), "line").groupBy("at_id").agg(F.collect_list(F.struct("pos", "line", "h1", "h2")).alias("wanted")))
    texts = stored(attach(rows, wanted, rows.doc_id == wanted.at_id, "inner").select("text", "wanted")
                   .mapInArrow(_lines_at(min_words), "line long, text string").dropDuplicates(["line"]))
    forget(wanted)
    return texts


def _verified(pairs: DataFrame, rows: DataFrame, classes: DataFrame, min_words: int, threshold: float) -> DataFrame:
    """The pairs of line classes whose texts are similar."""
    texts = _texts(pairs.select(F.explode(F.array("a", "b")).alias("line")), rows, classes, min_words)
    a = texts.select(F.col("line").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("line").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.join(b, "b").join(a, "a").select("a", "b", "text_a", "text_b")
    links = stored(joined.mapInArrow(_similar(threshold), "a long, b long"))
    forget(texts)
    return links


def _within_buckets(unsettled: DataFrame, rows: DataFrame, classes: DataFrame, min_words: int, threshold: float, dense: int) -> DataFrame:
    """Links inside buckets, found where the bucket's lines and texts are together; no pair leaves a bucket.

    A bucket of more than ``dense`` lines is cut into parts of about that size, and each two of its parts meet in a task of their own.
    """
    texts = _texts(unsettled, rows, classes, min_words)
    whole = attach(unsettled, texts, "line", "inner")
    sizes = stored(unsettled.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > dense))
    parts = F.coalesce(F.ceil(F.col("n") / dense), F.lit(1)).cast("int")
    mine, other = F.pmod(F.xxhash64("line"), F.col("parts")).cast("int"), F.col("other")
    cut = attach(whole, sizes, "key").withColumn("parts", parts).withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    low, high = F.least("mine", other), F.greatest("mine", other)
    side = F.when(F.col("mine") == other, 2).when(F.col("mine") < other, 0).otherwise(1)
    # key, and for the parts of a large one a key made of it and its two parts
    key = F.when(F.col("parts") > 1, F.xxhash64("key", low, high)).otherwise(F.col("key"))
    dealt = cut.select(key.alias("key"), side.alias("side"), "line", "root", "bits", "text").repartition("key").sortWithinPartitions("key", "line")
    links = stored(dealt.mapInArrow(_links_within(threshold), "a long, b long"))
    forget(texts), forget(sizes)
    return links


def line_groups(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_words: int = MIN_WORDS, threshold: float = SIMILARITY, dense: int = DENSE,
) -> DataFrame:
    """``h1, h2, kept``: the identity of every line class of which an occurrence has to go, and the place that stays.

    Lines equal up to case and white space form a class; classes link at the similarity threshold, and of each linked
    component the first occurrence, by document id and position, stays.
    """
    rows = checked_columns(docs, id_column, text_column).toDF("doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sketched = rows.mapInArrow(_occurrences(min_words, True), _LINE + "".join(f", {b} long" for b in _SKETCH))
    classes = stored(sketched.groupBy("h1", "h2").agg(F.min(place_of()).alias("first"), F.count("*").alias("n"), *[F.min(b).alias(b) for b in _SKETCH])
                     .withColumn("line", F.monotonically_increasing_id()))
    keyed = classes.filter(F.col("bits").isNotNull())
    buckets = keyed.select(F.explode(F.array(*_BANDS)).alias("key"), "line", "bits").repartition("key").sortWithinPartitions("key", "line")
    star = stored(buckets.mapInArrow(_star_pairs, "a long, b long, key long, bits long"))
    pairs = stored(star.filter("key is null").select("a", "b").distinct())
    links = _verified(pairs, rows, classes, min_words, threshold)
    roots = components(links)
    members = star.filter("key is not null").select("key", F.col("b").alias("line"), "bits")
    grouped = attach(members, roots, members.line == roots.node).select("key", "line", F.coalesce("root", "line").alias("root"), "bits")
    unsettled = stored(grouped.repartition("key").sortWithinPartitions("key", "line").mapInArrow(_unsettled, "key long, line long, root long, bits long"))
    forget(pairs), forget(links)
    if not unsettled.isEmpty():
        links = _within_buckets(unsettled, rows, classes, min_words, threshold, dense)
        earlier, roots = roots, components(roots.toDF("a", "b").unionByName(links))
        forget(earlier), forget(links)
    forget(star), forget(unsettled)
    members = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    linked = stored(members.join(classes.select("line", "h1", "h2", "first"), members.node == F.col("line")).select("root", "h1", "h2", "first"))
    kept = stored(linked.groupBy("root").agg(F.min("first").alias("kept")))
    of_linked = attach(linked, kept, "root", "inner").select("h1", "h2", "kept")
    alone = classes.join(members.select(F.col("node").alias("line")), "line", "left_anti").filter("n > 1")
    groups = stored(of_linked.unionByName(alone.select("h1", "h2", F.col("first").alias("kept"))))
    for table in (roots, linked, kept, classes):
        forget(table)
    return groups


def removed_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_words: int = MIN_WORDS, threshold: float = SIMILARITY) -> DataFrame:
    """``doc_id, removed``: positions of the lines of a document, from 0, that another occurrence stands for; stored."""
    groups = line_groups(docs, id_column, text_column, min_words, threshold)
    rows = checked_columns(docs, id_column, text_column).toDF("doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = attach(rows.mapInArrow(_occurrences(min_words, False), _LINE), groups, ["h1", "h2"], "inner")
    removed = stored(found.filter(place_of() != F.col("kept")).groupBy("doc_id").agg(F.array_sort(F.collect_set("pos")).alias("removed")))
    forget(groups)
    return removed


def _without(batches):
    for batch in pieces(batches):
        texts = []
        for text, removed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if removed:
                gone = set(removed)
                text = "\n".join([x for i, x in enumerate(text.split("\n")) if i not in gone])
            texts.append(text)
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), *batch.columns[1:]], batch.schema.names)


def dedup_lines(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_words: int = MIN_WORDS, threshold: float = SIMILARITY, *, to: str | None = None,
) -> DataFrame:
    """``docs`` with repeated and nearly repeated lines taken out of the texts; with ``to``, a last column of that name holds their old positions.

    Of lines that are equal or similar, directly or through others, the first in the corpus stays, by document id and
    position.  Similarity is the exact Jaccard similarity of 8-character shingle sets of the lower-cased line with single spaces;
    MinHash banding proposes the pairs.  Every line that is not blank takes part, however short; ``min_words`` can raise that.

    Null and empty texts stay as they are, and rows with a null id neither lose lines nor stand for others.  Rows that
    repeat id and text count as one document, so they keep and lose the same lines; where one id has several texts, positions
    that go in one go in all.  A document may end empty; no row goes.  An empty table gives an empty result, and further
    columns pass through.
    """
    gone = removed_lines(docs, id_column, text_column, min_words, threshold)
    beside = F.struct(*[F.col(f"`{c}`").alias(c) for c in docs.columns if c != text_column])  # as one column, so that no name can clash
    rows = docs.select(F.col(f"`{text_column}`").cast("string").alias("text"), F.col(f"`{id_column}`").cast("long").alias("id"), beside.alias("row"))
    kept = attach(rows, gone, rows["id"] == gone["doc_id"]).select("text", "removed", "row")
    cleaned = kept.mapInArrow(_without, kept.schema)
    columns = [F.col("text").alias(c) if c == text_column else F.col("row")[c].alias(c) for c in docs.columns]
    return cleaned.select(*columns, *([] if to is None else [F.col("removed").alias(to)]))
