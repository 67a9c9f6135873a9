"""Vector codes, spelling variants and exact duplicates against brute force, and their defined edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonoframe.llm import codes, exact, spelling

VECTORS = "vec_id long, embedding array<double>, label int"


# --- operator 11 ------------------------------------------------------------------------
def slow_codes(rows, parts=4, entries=256, rounds=4, scale=1024):
    from fractions import Fraction
    from math import floor, isfinite

    kept = [(i, x, s) for i, x, s in rows if x is not None and all(v is not None and isfinite(v) for v in x)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = [[floor(Fraction(v) * scale) for v in x] for _, x, _ in kept]
    size = len(whole[0])
    cuts = [(size * p // parts, size * (p + 1) // parts) for p in range(parts)]
    books = [[x[a:b] for x in whole[:entries]] for a, b in cuts]

    def near(x, book):
        return min((sum((u - v) ** 2 for u, v in zip(x, c)), k) for k, c in enumerate(book))

    for _ in range(rounds):
        for p, (a, b) in enumerate(cuts):
            groups = {}
            for x in whole:
                groups.setdefault(near(x[a:b], books[p])[1], []).append(x[a:b])
            for k, members in groups.items():
                books[p][k] = [sum(c) // len(members) for c in zip(*members)]
    digest = hashlib.sha256(",".join(str(v) for book in books for c in book for v in c).encode()).hexdigest()
    out, sums = [], Counter()
    for (i, _, label), x in zip(kept, whole):
        found = [near(x[a:b], books[p]) for p, (a, b) in enumerate(cuts)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label))
        sums[label] += out[-1][2]
    top = 2**63 - 1
    return sorted(((i, c, min(e, top), min(sums[s], top), digest) for i, c, e, s in out), key=repr)


def coded(spark, rows, **options):
    return sorted((tuple(r) for r in codes.encode(spark.createDataFrame(rows, VECTORS), **options).collect()), key=repr)


@pytest.mark.parametrize("magnitude", [1.0, 3e4, 5e6, 1e18])
def test_codes_equal_plain_integers(spark, magnitude):
    noise = np.random.default_rng(3)
    rows = [(i, [float(v) for v in noise.normal(0, magnitude, 10)], i % 3 if i % 5 else None) for i in range(60)]
    rows += [(100 + i, rows[i][1], 7) for i in range(5)] + [(3, rows[3][1], None), (3, rows[9][1], 1), (None, rows[0][1], 1)]
    rows += [(200, None, 1), (201, [None] * 10, 1), (202, [float("nan")] * 10, 1), (203, [float("inf")] + [0.0] * 9, 1)]
    assert coded(spark, rows, entries=16) == slow_codes(rows, entries=16)


def test_codes_take_the_first_of_equal_entries_and_sizes_apart(spark):
    rows = [(i, [1.0, 2.0, 3.0, 4.0], 1) for i in range(6)]
    assert [r[1:3] for r in coded(spark, rows)] == [("00000000", 0)] * 6
    mixed = rows + [(50, [0.5] * 8, 2), (51, [0.25] * 8, 2), (52, [], 2)]
    found = {r[0]: r[1:4] for r in coded(spark, mixed)}
    assert found[50] == ("00000000", 0, 0) and found[51][0] == "01010101" and found[52] == ("00000000", 0, 0)
    assert coded(spark, [(1, None, 2)]) == [] and coded(spark, []) == []


def test_codes_pass_by_clashing_columns(spark):
    df = spark.createDataFrame([(i, [float(i)] * 4, "a") for i in range(5)], "vec_id long, embedding array<double>, label string")
    more = df.withColumn("x", F.lit("b")).withColumn("error", F.lit(1)).withColumn("_label", F.lit(2)).withColumn("codebooks_sha256", F.lit(""))
    assert sorted(map(tuple, codes.encode(more).collect())) == sorted(map(tuple, codes.encode(df).collect()))


def test_limb_products_are_exact():
    noise = np.random.default_rng(5)
    for bits in (10, 23, 24, 25, 28):
        for size in (1, 16, 33):
            a, b = noise.integers(-(1 << bits), 1 << bits, (40, size)), noise.integers(-(1 << bits), 1 << bits, (30, size))
            a[0], b[0] = -(1 << bits), (1 << bits) - 1
            assert (codes.exact_products(a, b) == (a.astype(object) @ b.astype(object).T)).all()


# --- operator 12 -----------------------------------------------------------------------------
def slow_words(docs, every):
    total = Counter()
    for doc, text in docs:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            total[run[:h % len(run)] + run[h % len(run) + 1:] if every and h % every == 0 else run] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def slow_variants(docs, every=None):
    words = slow_words(docs, every)
    near = {w: sorted((v for v in words if is_near(w, v)), key=lambda v: (-words[v], v)) for w in words}
    form = {w: near[w][0] for w in words if near[w] and words[near[w][0]] >= 2 * words[w]}
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return sorted(out)


def spoilt(seed, n=60):
    noise = random.Random(seed)
    stems = ["letter", "weather", "Fenêtre", "straße", "banana", "committee", "aaaaa", "aaaaaa", "ÀÿÉé×÷", "pineapple"]
    docs = []
    for i in range(n):
        words = []
        for _ in range(40):
            w = list(noise.choice(stems))
            if noise.random() < 0.5:
                at = noise.randrange(len(w))
                w[at:at + 1] = noise.choice([[], ["e"], [w[at], "a"], [w[at].upper()]])
            words.append("".join(w))
        docs.append((noise.choice([i, 3, None]), noise.choice([" ", ", ", "\n", "1"]).join(words)))
    return docs + [(5, None), (6, ""), (7, "1 2 3 - ok"), (8, "letter " * 30_000)] + [(9, "ripely")] * 4


@pytest.mark.parametrize("every", [None, 3, 97])
def test_variants_equal_brute_force(spark, every):
    docs = spoilt(11)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, word string, n int")
    found = sorted(map(tuple, spelling.spelling_variants(df.repartition(3), delete_every=every).collect()), key=repr)
    assert found == sorted(slow_variants(docs, every), key=repr)


def test_variants_do_not_depend_on_passes(spark, monkeypatch):
    df = spark.createDataFrame(spoilt(12), "doc_id long, text string")
    want = sorted(map(tuple, spelling.spelling_variants(df).collect()), key=repr)
    monkeypatch.setattr(spelling, "SHARD_BLOCKS", 2)  # several shards for a length, a pass for each
    assert sorted(map(tuple, spelling.spelling_variants(df, pass_bytes=64).collect()), key=repr) == want
    assert spelling.spelling_variants(df.limit(0)).collect() == []


def test_filter_holds_all_and_little_else():
    noise = np.random.default_rng(1)
    held, other = noise.integers(0, 2**64 - 1, (2, 20_000), np.uint64)
    blocks = spelling.filter_blocks(len(held))
    shards = {0: spelling.filled(held, blocks, 0, 500), 500: spelling.filled(held, blocks, 500, blocks)}
    assert len(spelling.probed(held, blocks, shards)) == len(held)
    assert len(spelling.probed(other, blocks, shards)) < 0.01 * len(other)


# --- operator 13 ---------------------------------------------------------------------------------
def slow_groups(rows):
    same = {}
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    for doc, text in rows:
        same.setdefault(lower(text), []).append(doc)
    out = []
    for text, ids in same.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


def grouped(found):
    rows = found.collect()
    per_text = Counter(r["text_sha256"] for r in rows if r["kept"])
    assert set(per_text) == {r["text_sha256"] for r in rows} and set(per_text.values()) <= {1}
    assert all(r["keep_id"] == r["doc_id"] for r in rows if r["kept"])
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in rows), key=repr)


def copies(seed=2, n=400):
    noise = random.Random(seed)
    rows = [(noise.choice([i, i, i, 7, None]), noise.choice(["Same Text", "same text", f"text {noise.randrange(60)}", "ÄÖ", "äö", "", None, "x" * 50_000])) for i in range(n)]
    return rows + [(1000, "ONE ROW"), (7, "same TEXT")]


@pytest.mark.parametrize("options", [{}, {"key_bits": 3}, {"key_bits": 3, "fan": 4, "capacity": 5, "held_bytes": 1}, {"fan": 2, "held_bytes": 1}, {"capacity": 1, "held_bytes": 60_000}])
def test_groups_equal_brute_force(spark, options):
    rows = copies()
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, key string, entry int").repartition(6)
    assert grouped(exact.exact_groups(df, **options)) == slow_groups(rows)


def test_groups_of_nothing(spark):
    assert exact.exact_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_directory_splits_full_buckets_only(spark):
    noise = random.Random(4)
    keys = [noise.randrange(-(2**63), 2**63) for _ in range(2_000)] + [5] * 300 + [-1] * 10
    df = spark.createDataFrame([(k, 10) for k in keys], "key long, bytes long")
    slots, bits = exact.directory(df, capacity=100, depth=12)
    buckets = {}
    for r in slots.collect():
        buckets.setdefault((r["bucket"], r["local_depth"]), []).append(r["n"])
    assert sum(map(sum, buckets.values())) == len(keys) and bits == max(d for _, d in buckets) == 12
    size = lambda bucket, depth: sum((k % 2**64) >> (64 - depth) == bucket >> (12 - depth) for k in keys) if depth else len(keys)
    for (bucket, depth), n in buckets.items():
        assert sum(n) == size(bucket, depth) and (sum(n) <= 100 or depth == 12)
        assert depth == 0 or size(bucket, depth - 1) > 100  # split only because its parent was full
