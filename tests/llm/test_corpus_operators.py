"""Corpus operators against brute force on small tables, and their defined edge cases."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from sonoframe.llm import extraction, licences, lines, mixing, neighbours, packing, quality, queries, simhash, topk, toxicity
from sonoframe.llm.components import components
from sonoframe.llm.html_tree import joined, parse

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None), (2, ""), (3, "   \n\t"), (4, "one"), (5, "two words"), (6, "naïve café ñ"), (7, "a b c d e f g h i j"), (7, "a b c d e f g h i j"),
       (None, "no id here but words enough to be a line"), (8, "x " * 30_000), (9, "a  b\n\n c\t d "), (10, "<|endoftext|> end"), (11, "  odd\r\nspace")]


def odd(spark):
    rows = [(i, t, None, s, 0, "clash", 1.5) for (i, t), s in zip(ODD, ["a", "b", None] * 5)]
    return spark.createDataFrame(rows, DOCS + ", label string, score double")


def empty(spark):
    return spark.createDataFrame([], DOCS)


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def groups_of(pairs, nodes):
    above = {n: n for n in nodes}

    def top(x):
        while above[x] != x:
            x = above[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        above[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_components_match_union_find(spark):
    random = np.random.default_rng(1)
    links = [(int(a), int(b)) for a, b in random.integers(0, 400, (300, 2))] + [(0, k) for k in range(500, 900)] + [(k, k + 1) for k in range(1000, 1200)] + [(5, 5)] * 3
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(links + links[:50], "a long, b long").repartition(7)).collect()}
    want = groups_of(links, {x for p in links for x in p})
    assert found == {n: r for n, r in want.items() if n != r}


def slow_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_simhash_matches_all_pairs(spark):
    rows = documents(spark).select("doc_id", "text").collect()
    prints = {r["doc_id"]: slow_fingerprint(r["text"]) for r in rows}
    want = groups_of([(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3], prints)
    got = queries.op6_simhash(spark, SF).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {d: (f"{p:016x}", want[d]) for d, p in prints.items()}


def test_simhash_links_every_distance_up_to_three(spark):
    random = np.random.default_rng(2)
    base = random.integers(0, 1 << 63, 200, np.uint64)
    near = base.copy()
    for k in range(len(base)):
        for b in random.choice(64, k % 5, replace=False):
            near[k] ^= np.uint64(1) << np.uint64(b)
    variants = sorted((s * simhash.WIDTH + p, int(fp) >> 32 * s & 0xFFFFFFFF & ~(1 << p), int(fp)) for fp in {*base, *near} for s in (0, 1) for p in range(32))
    keys, prints = np.array([v << 32 | m for v, m, _ in variants]), np.array([f for *_, f in variants], np.uint64)
    i, j = simhash._near(keys, prints)
    joined_up = groups_of([tuple(sorted((int(prints[a]), int(prints[b])))) for a, b in zip(i, j)], {int(x) for x in {*base, *near}})
    for k, (a, b) in enumerate(zip(base, near)):
        assert (joined_up[int(a)] == joined_up[int(b)]) == (k % 5 <= 3)


def test_simhash_edge_cases(spark):
    found = simhash.simhash_components(odd(spark)).collect()
    assert len(found) == len(ODD)
    blank = [r for r in found if r["doc_id"] in (1, 2, 3)]
    assert all(r["fp"] == 0 and r["component_id"] == 1 for r in blank)
    assert simhash.simhash_components(empty(spark)).count() == 0
    kept = simhash.keep_one_per_component(odd(spark))
    assert kept.columns == odd(spark).columns and {1, 7} <= {r["doc_id"] for r in kept.collect()} and kept.filter("doc_id is null").count() == 1


def slow_removed(rows, threshold=lines.SIMILARITY):
    found = [(d, p, lines.comparable(x, lines.MIN_WORDS)) for d, t in rows if d is not None and t for p, x in enumerate(t.split("\n"))]
    found = sorted(x for x in found if x[2])
    kinds = sorted({x for *_, x in found})
    sets, holders, links = [lines.shingles(x) for x in kinds], {}, []
    for k, s in enumerate(sets):
        for other in {o for g in s for o in holders.get(g, ())}:
            both = len(s & sets[other])
            if both >= threshold * (len(s) + len(sets[other]) - both):
                links.append((other, k))
        for g in s:
            holders.setdefault(g, []).append(k)
    group, first = groups_of(links, range(len(kinds))), {}
    at = {x: group[k] for k, x in enumerate(kinds)}
    for d, p, x in found:
        first.setdefault(at[x], (d, p))
    return {(d, p) for d, p, x in found if first[at[x]] != (d, p)}


def test_line_dedup_matches_all_pairs(spark):
    got = queries.op1_line_dedup(spark, SF).collect()
    assert len(got) == documents(spark).count()
    assert {(r["doc_id"], p) for r in got for p in r["removed_lines"]} == slow_removed([(r["doc_id"], r["text"]) for r in documents(spark).collect()])


def test_line_dedup_edge_cases(spark):
    passage = "this passage of many words is repeated across documents " * 8
    near = passage.replace("many", "several", 1)
    rows = [(1, f"first\n{passage}\nlast"), (2, passage), (3, f"{near}\nown words of the third document which nobody else has"), (3, f"{near}\nown words of the third document which nobody else has")]
    docs = spark.createDataFrame([(i, t, None, None, 0, "x") for i, t in rows], DOCS + ", line string").unionByName(odd(spark).drop("label", "score").withColumn("line", F.lit("y")))
    docs = docs.withColumns({"_removed": F.lit(1), "removed": F.lit(2), "row": F.lit("z"), "id": F.lit(3)})
    cleaned = lines.dedup_lines(docs)
    assert cleaned.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in cleaned.collect()]
    other = lines.dedup_lines(docs.withColumnRenamed("text", "body").withColumn("text", F.lit("other")), text_column="body")
    assert sorted(((r["doc_id"], r["body"]) for r in other.collect()), key=repr) == sorted(got, key=repr)
    assert len(got) == 4 + len(ODD)
    assert (1, rows[0][1]) in got and (2, "") in got and got.count((3, "own words of the third document which nobody else has")) == 2
    assert [t for i, t in got if i is None] == [ODD[8][1]] and (1, None) in got
    assert lines.dedup_lines(empty(spark)).count() == 0


def test_line_dedup_takes_short_lines(spark):
    short = "Licensed under the Apache License, Version 2.0."
    other = "本软件按原样提供，不附带任何明示或暗示的保证，包括适销性。"
    rows = [(1, f"ok\n{short}\n{other}"), (2, f"{short.upper()}\nown\nOK"), (3, f"{other[:-1]}！\n\n  \nok then")]
    got = {r["doc_id"]: (r["text"], r["gone"]) for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), to="gone").collect()}
    assert got == {1: (rows[0][1], None), 2: ("own", [0, 2]), 3: ("\n  \nok then", [0])}


def test_bits_let_pairs_through():
    one, two = np.array([0], np.int64), np.array([(1 << 18) - 1], np.int64)  # 30 of the 48 bits agree
    assert lines._alike(one, two).all()


def test_buckets_are_settled_where_they_are(monkeypatch):
    batch = lambda names, *columns: pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)
    far = (1 << 48) - 1
    members = batch(list("klrb"), [4, 4, 5, 5, 5, 6, 7, 7], [8, 9, 1, 2, 3, 9, 5, 6], [8, 8, 1, 1, 3, 9, 5, 6], [0, 0, 0, 0, 0, 0, 0, far])
    found = [r for out in lines._unsettled([members.slice(0, 3), members.slice(3)]) for r in zip(*[c.to_pylist() for c in out.columns])]
    assert [r[1] for r in found] == [1, 2, 3]  # one component, or unlike bits: nothing to compare
    base = "the quick brown fox jumps over the lazy dog and runs away into the dark forest again"
    texts = [base, base.replace("quick", "quack"), "completely different words stand in this other line of text here", base.replace("lazy", "hazy"), base + "!"]
    rows = batch(list("kslrbt"), [1] * 5, [2] * 5, [10, 11, 12, 13, 14], [10, 11, 12, 13, 10], [0] * 5, texts)
    for few in (64, 2):
        monkeypatch.setattr(lines, "FEW", few)
        links = [r for out in lines._links_within(0.8)([rows]) for r in zip(*[c.to_pylist() for c in out.columns])]
        compare(links, texts)


def compare(links, texts):
    sets = [lines.shingles(t) for t in texts]
    near = {(10 + i, 10 + j) for i in range(5) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert {tuple(sorted(x, reverse=True)) for x in links} <= near and len(links) >= 2
    assert groups_of([*links, (10, 14)], range(10, 15)) == groups_of([*near, (10, 14)], range(10, 15))


@pytest.mark.parametrize("power", [52, 53, 59, 61, 80])
def test_top_products_are_exact_beyond_doubles(spark, power):
    """Products that differ in the last places only, with ties, against Python integers."""
    random = np.random.default_rng(power)
    half = 2.0 ** (power // 2 - 8)
    rows = [(i, [half, half * 2 ** (power % 2), 1.0 / 256, float(random.integers(-6, 6)) / 256]) for i in range(200)] + [(900, [1e300, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>").repartition(3)
    whole = {i: [int(x * 256) if abs(x) > 1 else int(np.floor(x * 256)) for x in v] for i, v in rows}
    held = lambda s: max(min(s, 2**63 - 1), 1 - 2**63)
    want = set()
    for q in range(0, 200, 50):
        best = sorted((-held(sum(a * b for a, b in zip(whole[q], v))), i) for i, v in whole.items() if i != q)[:5]
        want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    assert {tuple(r) for r in topk.top_products(df, (F.col("vec_id") % 50 == 0) & (F.col("vec_id") < 200)).collect()} == want


def test_pairs_compared_at_once_equal_sets():
    random = np.random.default_rng(6)
    texts = ["", "a", "aé本", "x" * 3_000, "本软件按原样提供，不附带任何明示或暗示的保证"]
    for _ in range(60):
        base = list(random.choice(list("abcdé 本"), random.integers(1, 120)))
        texts += ["".join(base)]
        for _ in range(random.integers(0, 4)):
            base[random.integers(0, len(base))] = random.choice(list("xyz"))
            texts.append("".join(base))
    left, right = map(np.array, zip(*[(i, j) for i in range(len(texts)) for j in range(i)]))
    sets = [lines.shingles(t) for t in texts]
    want = [len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for i, j in zip(left, right)]
    assert lines.similar_pairs(texts, left, right, 0.8).tolist() == want and sum(want) > 20
    assert len(lines.similar_pairs([], np.zeros(0, np.int64), np.zeros(0, np.int64), 0.8)) == 0


def test_a_large_bucket_is_cut_without_losing_links(spark):
    random = np.random.default_rng(4)
    words = [["alpha", "beta", "gamma", "delta"][i % 4] + str(i) for i in range(40)]
    rows = []
    for i in range(150):  # variants of one line, many of them too unlike to link
        own = list(words)
        for at in random.choice(40, random.integers(1, 4), replace=False):
            own[at] = f"w{random.integers(0, 9)}x{at}"
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole, cut = ({tuple(r) for r in lines.line_groups(docs, dense=dense).collect()} for dense in (2_048, 7))
    assert whole == cut and len(whole) > 10


@pytest.mark.parametrize("seed", range(5))
def test_subset_sum_matches_brute_force(seed):
    random = np.random.default_rng(seed)
    lengths, counts = np.unique(random.integers(1, 40, 6)), None
    counts = random.integers(1, 4, len(lengths))
    sums = {0}
    for n, c in zip(lengths, counts):
        sums = {s + int(n) * k for s in sums for k in range(c + 1)}
    for budget in range(0, int((lengths * counts).sum()) + 1, 7):
        taken = mixing.closest_subset(lengths, counts, budget)
        assert (taken <= counts).all()
        assert abs(int((taken * lengths).sum()) - budget) == min(abs(s - budget) for s in sums if s <= 2 * budget)


def test_mixing_meets_its_targets(spark):
    got = mixing.mix(documents(spark)).toPandas()
    again = mixing.mix(documents(spark).repartition(5)).toPandas()
    assert sorted(zip(got.doc_id, got.taken)) == sorted(zip(again.doc_id, again.taken))
    size = {r["doc_id"]: len((r["text"] or "").encode().split()) for r in documents(spark).collect()}
    assert {**dict(zip(got.doc_id, got["size"]))} == size and (got.taken <= 3 * got["size"]).all()
    sums = got.groupby("source").agg(size=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    total, open_, target = sums["size"].sum(), list(sums.index), {}
    weight = {s: i % 3 + 1 for i, s in enumerate(sorted(sums.index))}
    left = float(total)
    while True:
        share = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if share * weight[s] > 3 * sums["size"][s]]
        if not full:
            break
        for s in full:
            target[s] = 3.0 * sums["size"][s]
            left -= target[s]
            open_.remove(s)
    target |= {s: share * weight[s] for s in open_}
    assert all(abs(sums.target[s] - target[s]) < 1e-6 * total for s in sums.index)
    for source, own in got.groupby("source"):  # no choice of whole documents comes closer
        size, aim = int(own["size"].sum()), target[source]
        can = {int(aim // size) * size}
        for n in own["size"]:
            can |= {s + int(n) for s in can}
        assert abs(int(own.taken.sum()) - aim) <= min(abs(s - aim) for s in can) + 1


def test_lengths_beyond_the_window_are_taken_in_proportion():
    random = np.random.default_rng(6)
    lengths, counts = np.unique(random.integers(1, 900, 3000), return_counts=True)
    budget = int((lengths * counts).sum()) // 3
    taken = mixing.plan_lengths(lengths, counts, budget, window=1000)
    assert int((taken * lengths).sum()) == budget and (0 <= taken).all() and (taken <= counts).all()
    assert abs(taken.sum() / counts.sum() - 1 / 3) < 0.2


def test_mixing_edge_cases(spark):
    got = {(r["doc_id"], r["source"], r["size"], r["taken"] <= 3 * r["size"]) for r in mixing.mix(odd(spark)).collect()}
    assert (1, "a", 0, True) in got and (8, "a", 30_000, True) in got and (3, None, 0, True) in got
    assert mixing.mix(odd(spark)).count() == len(ODD) and mixing.mix(empty(spark)).count() == 0
    assert mixing.mixed_documents(odd(spark)).columns == odd(spark).columns


def packed_ids(rows):
    whole = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["start"])):
        whole.setdefault(r["doc_id"], []).append(r)
    return whole


def test_packing_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    docs = documents(spark).unionByName(odd(spark).filter("doc_id <> 7 and doc_id is not null").drop("label", "score").withColumn("doc_id", F.col("doc_id") + 10_000_000))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    rows = packing.pack(docs.repartition(2)).collect()
    for doc, pieces in packed_ids(rows).items():
        ids = encoder.encode(texts[doc], add_special_tokens=False).ids + [packing.END]
        assert np.frombuffer(b"".join(p["ids"] for p in pieces), "<u4").tolist() == ids
        assert [p["start"] for p in pieces] == np.cumsum([0] + [p["length"] for p in pieces])[:-1].tolist() and pieces[0]["doc_tokens"] == len(ids)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.LENGTH
    assert sum(r["length"] for r in rows) / (packing.LENGTH * len(sequences)) > 0.97
    assert len(packing.pack(odd(spark)).select("doc_id").distinct().collect()) == len({i for i, _ in ODD}) and packing.pack(empty(spark)).count() == 0


def test_encoder_gives_the_ids_of_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(packing.VOCABULARY)
    encoder, tokenizer = packing.Encoder(path), Tokenizer.from_file(path)
    assert encoder.fast is not None
    random = np.random.default_rng(11)
    odd_parts = ["don't", "I'LL", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\x00", "\u00a0", "\u2003", "\u3000", "\x85", "\u200b", "日本語", "é", "e\u0301", "123", "½", "…",
                 "<|endoftext|>", "<|endoftext", "🙂", "ﬁ", "ab" * 40, "!" * 30, " " * 300, "the", " tion", "'", "'s", "\ufeff", "İ", "ǅ"]
    texts = ["".join(random.choice(odd_parts, random.integers(0, 12))) for _ in range(5_000)]
    texts += [f"a{c} {c}1{c}2 .{c}! {c}{c}\n{c}" for c in map(chr, [*range(0xD800), *range(0xE000, 0x10000, 7), *range(0x10000, 0x20000, 31)])]
    texts += ["a" * 300_000, "ab " * 100_000, " " * 100_000 + "x", "\n" * 50_000]
    for text in texts:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text[:50]


def test_packing_digest(spark):
    row = queries.op3_packing(spark, SF).orderBy("doc_id", "start").first()
    ids = next(r["ids"] for r in packing.pack(documents(spark)).collect() if (r["doc_id"], r["start"]) == (row["doc_id"], row["start"]))
    assert row["ids_crc32"] == zlib.crc32(bytes(ids))


def test_fill_is_closest():
    random = np.random.default_rng(3)
    for _ in range(30):
        counts = np.zeros(41, int)
        for n in random.integers(1, 40, 7):
            counts[n] += 1
        chosen = packing.fill(counts, 40)
        longest = int(np.flatnonzero(counts)[-1])
        sums = {longest}
        for n in np.flatnonzero(counts):
            sums = {s + int(n) * k for s in sums for k in range(counts[n] - (n == longest) + 1) if s + n * k <= 40}
        assert sum(chosen) == max(sums) and all(chosen.count(n) <= counts[n] for n in chosen)


@pytest.mark.parametrize("name, rest, held", [("op2_toxicity", "toxic", (5, 0)), ("op5_quality", "quality", (4, 2))])
def test_scorers_hold_out(spark, name, rest, held):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES[name](spark, sf).toPandas()
    assert (got.held_out == [zlib.crc32(str(d).encode()) % held[0] == held[1] for d in got.doc_id]).all() and got.score.between(0, 1).all()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    seen = got.merge(labels, on="doc_id")
    seen = seen[seen.held_out]
    assert (seen.predicted == seen[rest]).mean() > 0.9


def test_scorer_edge_cases(spark):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    texts = spark.createDataFrame([(i, "you utter fool " * 5 if i % 2 else "a calm and kind sentence " * 5) for i in range(40)], "doc_id long, text string")
    for module, fit, score in ((toxicity, toxicity.fit_on_labels, toxicity.score_toxicity), (quality, quality.fit_on_labels, quality.score_quality)):
        model = fit(texts, labels)
        scored = score(odd(spark), model, to="score").collect()
        assert len(scored) == len(ODD) and all(0 <= r["score"] <= 1 and r["label"] == "clash" for r in scored)
        assert score(empty(spark), model).count() == 0
        assert score(odd(spark), fit(texts, labels.limit(0)), to="s").filter("s <> 0").count() == 0


def test_extraction_is_the_article(spark):
    import html
    import re

    got = queries.op4_extraction(spark, "/root/testdata/sf0.01").collect()
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    inner = lambda h: re.search(r"<article>(.*?)</article>", h, re.S)[1]
    want = {p: " ".join(html.unescape(re.sub(r"</?(?:p|h1|br)>", " ", inner(h)).replace("<b>", "").replace("</b>", "")).split()) for p, h in pages.items()}
    assert sum(r["text"] == want[r["page_id"]] for r in got) / len(got) > 0.95 and all(r["n_chars"] == len(r["text"]) for r in got)
    trees = extraction.fit_extractor(spark.read.parquet("/root/testdata/sf0.01/pages.parquet").limit(40))
    rows = spark.createDataFrame([(1, None, "t"), (2, "", "t"), (3, "<p>unclosed <b>x", "t"), (3, "<p>unclosed <b>x", "t"), (4, "<a '" * 5000, "t")], "page_id long, html string, text string")
    assert [r["text"] for r in extraction.extract(rows, trees).orderBy("page_id").collect()][:2] == ["", ""]
    assert extraction.extract(rows.limit(0), trees).count() == 0


def test_html_pieces():
    nodes, pieces = parse("<div>a<b>b</b>&amp;c<script>var t='</p>';</script><br>d<!-- no --><p>e &nbsp; f<li>g</div>h")
    assert joined(pieces, lambda n: True) == "ab&c d e f g h"
    assert extraction.decode(nodes, [1.0] * len(nodes)) == set(nodes)
    kept = extraction.decode(nodes, [-1.0] + [5.0] * (len(nodes) - 1))
    assert all(n.parent is None or n.parent in kept for n in kept)


def test_licences(spark):
    docs = documents(spark)
    model = licences.fit_licences(docs)
    added = spark.createDataFrame([(-1, "Intro line here\nLicensed under the Apache License, Version 2.0."), (-2, "He got his driving license on Monday."), (-3, None), (-4, "")], "doc_id long, text string")
    got = licences.find_licences(docs.select("doc_id", "text").unionByName(added), model).collect()
    lines_of = {r["doc_id"]: (r["text"] or "").split("\n") for r in docs.collect()} | {-1: added.collect()[0]["text"].split("\n")}
    want = {(d, p) for d, x in lines_of.items() for p, s in enumerate(x) if "icensed under" in s or "Released under the" in s}
    assert {(r["doc_id"], r["paragraph"]) for r in got} == want and ("Apache-2.0", -1, 1) in {(r["family"], r["doc_id"], r["paragraph"]) for r in got}
    assert licences.find_licences(empty(spark), model).count() == 0
    assert "Python" not in (plan := licences.find_licences(docs, model)._jdf.queryExecution().toString()) and "Arrow" not in plan


def test_licences_finds_whole_texts_and_inline_notices(spark):
    docs = documents(spark)
    model = licences.fit_licences(docs)
    around = next(x for r in docs.orderBy("doc_id").collect() for x in (r["text"] or "").split("\n") if len(x.split()) > 40 and "icen" not in x).split()[:40]
    inline = " ".join([*around[:20], "This project is licensed under the MIT License.", *around[20:]])
    names = ["MIT", "BSD", "Apache-2.0"]
    rows = [(i, "\n".join(licences.PUBLISHED[f])) for i, f in enumerate(names)] + [(9, inline), (10, " ".join(around))]
    got = {(r["doc_id"], r["paragraph"]): r["family"] for r in licences.find_licences(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert got == {(i, p): f for i, f in enumerate(names) for p in range(len(licences.PUBLISHED[f]))} | {(9, 0): "MIT"}


def vectors(spark):
    random = np.random.default_rng(4)
    rows = [(i, [float(x) for x in random.normal(0, 1 + i % 3, 8)], i, "x") for i in range(300)]
    rows += [(400, None, 0, "x"), (450, [], 0, "x"), (500, [float("nan")] * 8, 0, "x"), (550, [None] + [1.0] * 7, 0, "x"), (600, [0.0] * 8, 0, "x"), (None, [1.0] * 8, 0, "x"),
             (700, [1.0, 2.0], 0, "x"), (701, [3.0, 4.0], 0, "x"), rows[50], rows[0]]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int, score string")


def test_top_products_match_all_pairs(spark):
    df = vectors(spark)
    valid = {r["vec_id"]: np.floor(256 * np.array(r["embedding"])) for r in df.collect() if r["vec_id"] is not None and r["embedding"] and all(x is not None and np.isfinite(x) for x in r["embedding"])}
    want = set()
    for q in (q for q in valid if q % 50 == 0):
        best = sorted((-int(valid[q] @ v), i) for i, v in valid.items() if i != q and len(v) == len(valid[q]))[:5]
        want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    assert {tuple(r) for r in topk.top_products(df, F.col("vec_id") % 50 == 0).collect()} == want
    assert topk.top_products(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    big = spark.createDataFrame([(0, [3e15, 1.0]), (1, [3e15, 2.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [r["vec_id"] for r in topk.top_products(big, F.col("vec_id") == 0).orderBy("rank").collect()] == [1, 2]


def test_neighbours_recall_and_exact_factor(spark):
    df = vectors(spark)
    valid = {r["vec_id"]: np.array(r["embedding"]) for r in df.collect() if r["vec_id"] is not None and r["embedding"] and all(x is not None and np.isfinite(x) for x in r["embedding"]) and any(r["embedding"])}
    want = {}
    for q in (q for q in valid if q % 100 == 0):
        want[q] = [i for _, i in sorted((float(np.sqrt(((valid[q] - v) ** 2).sum())), i) for i, v in valid.items() if i != q and len(v) == len(valid[q]))[:10]]
    exact = neighbours.nearest(df, F.col("vec_id") % 100 == 0, factor=1.0).orderBy("query_id", "rank").collect()
    assert {q: [r["vec_id"] for r in exact if r["query_id"] == q] for q in want} == want
    rough = neighbours.nearest(df, F.col("vec_id") % 100 == 0).collect()
    assert np.mean([len(set(w) & {r["vec_id"] for r in rough if r["query_id"] == q}) / len(w) for q, w in want.items()]) >= 0.9
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_pipeline_stage_by_stage(spark):
    rows = documents(spark)
    steps = dict(corpus_pipeline.STAGES)
    kept = steps["toxicity"](spark, rows, SF)
    assert kept.columns == rows.columns and set(r[0] for r in kept.select("doc_id").collect()) <= set(r[0] for r in rows.select("doc_id").collect())
    cleaned = steps["line_dedup"](spark, rows, SF).collect()
    gone = slow_removed([(r["doc_id"], r["text"]) for r in rows.collect()])
    texts = {r["doc_id"]: "\n".join(x for p, x in enumerate(r["text"].split("\n")) if (r["doc_id"], p) not in gone) for r in rows.collect()}
    assert {r["doc_id"]: r["text"] for r in cleaned} == texts and all(r["n_chars"] == len(r["text"]) for r in cleaned)
    members = {r["doc_id"]: r["component_id"] for r in simhash.simhash_components(rows).collect()}
    assert {r["doc_id"] for r in steps["near_dedup"](spark, rows, SF).collect()} == set(members.values())
    times = {r["doc_id"]: r["times"] for r in mixing.mix(rows).collect()}
    mixed = [r["doc_id"] for r in steps["mixing"](spark, rows, SF).collect()]
    assert {d: mixed.count(d) for d in times} == times
    assert corpus_pipeline.run(spark, SF).select("doc_id", "start", "ids").count() > 0


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES if name in ("line_dedup", "packing")])
def test_pipeline_stages_bound_batches_by_bytes(spark, name):
    rows, limit = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    usual = spark.conf.get(rows)
    try:
        spark.conf.set(rows, "10000"), spark.conf.unset(limit)
        dict(corpus_pipeline.STAGES)[name](spark, empty(spark), SF)
        texts = spark.range(0, 200, 1, 1).select(F.expr("repeat('word ', 20000)").alias("text"))
        sizes = texts.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long")
        assert sizes.agg(F.max("n")).first()[0] <= 64  # 4 MB of 100,000 bytes each
    finally:
        spark.conf.set(rows, usual), spark.conf.unset(limit)


def test_lines_compare_without_case_and_white_space():
    spaces = [c for c in map(chr, range(0x110000)) if c.isspace()]
    assert not any(c.isprintable() for c in spaces if c != " ")
    for line in ["", " ", "a", " a  b ", "ΑΣ", "ΑΣ Β", "İx", "\ud800 a", "\u200bq w", *[f"{c}A{c}b c{c}{c}" for c in spaces]]:
        for least in (0, 1, 3):
            words = line.lower().split()
            assert lines.comparable(line, least) == (" ".join(words) if len(words) >= least else None)


def test_sketches_see_the_shingles_of_one_line_only():
    texts = ["a", "abcdefgh", "é" * 9, "abcdefghi" * 40_000, "short", "one line and another", "abcdefgh"]
    together = lines.band_keys(texts)
    assert (together == np.concatenate([lines.band_keys([t]) for t in texts])).all() and (together[1] == together[6]).all()
    assert lines.band_keys([]).shape == (0, lines.BANDS + 1)


def test_neighbours_of_long_copies_are_exact(spark):
    random = np.random.default_rng(8)
    centre = random.normal(0, 30_000, 24)
    rows = [(i, centre if i % 7 == 0 else centre + random.normal(0, 1e-5, 24) if i % 7 == 1 else random.normal(0, 30_000, 24)) for i in range(600)]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>").coalesce(1)
    got = neighbours.nearest(df, F.col("vec_id").isin(0, 1, 301, 595), factor=1.0).orderBy("query_id", "rank").collect()
    of = dict(rows)
    for q in (0, 1, 301, 595):
        want = [i for _, i in sorted((float(np.sqrt(((of[q] - v) ** 2).sum())), i) for i, v in rows if i != q)[:10]]
        assert [r["vec_id"] for r in got if r["query_id"] == q] == want


def test_windows_without_template_pairs_are_not_licences(spark):
    docs = documents(spark)
    model = licences.fit_licences(docs)
    assert len(model.pairs) == len(set(model.pairs)) > 1_000
    judged = licences.paragraphs(docs)
    own = licences._pairs(F.col("words"))
    every = model.pipeline.transform(judged).select(
        "doc_id", "paragraph", "words", "family", (1 - F.element_at(licences.vector_to_array("probability"), model.unknown + 1)).alias("chance"))
    likely = model.calibration.transform(every.filter(F.col("family") != licences.UNKNOWN)).filter("score >= 0.5").withColumn("pairs", own)
    templates = {r["family"]: [set(t) for t in r["templates"]] for r in model.templates.collect()}
    plain = {(r["doc_id"], r["paragraph"]) for r in likely.collect()
             if any(len(t & set(r["pairs"])) >= 0.5 * max(1, min(len(t), len(r["pairs"]))) for t in templates.get(r["family"], ()))}
    assert plain and plain == {(r["doc_id"], r["paragraph"]) for r in licences.find_licences(docs, model).collect()}


def test_rows_that_repeat_an_id_lose_no_text(spark):
    words = [f"w{i}" for i in range(60)]
    own = " ".join(f"own{i}" for i in range(50))
    rows = [(1, " ".join(words), "a"), (1, " ".join(words), "a"), (2, " ".join(words), "b"), (2, own, "b"), (3, own + " " + own, "c"),
            (4, "one text of four", "d"), (4, "quite another thing altogether", "d"), (None, " ".join(words), None), (6, None, "e"), (6, "", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(0) for c in ("row", "id", "digest", "root", "gone_id", "stays")})
    kept = simhash.keep_one_per_component(docs)
    assert kept.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    prints = [simhash.fingerprint(t.encode() if t else None) for _, t, _ in rows]
    linked = groups_of([(a, b) for a in range(len(rows)) for b in range(a) if ((prints[a] ^ prints[b]) & (2**64 - 1)).bit_count() <= 3], range(len(rows)))
    assert len(got) == len({linked[i] for i, r in enumerate(rows) if r[0] is not None}) + 1
    assert got.count((1, rows[0][1])) == 1 and (2, own) in got and (4, rows[5][1]) in got and (4, rows[6][1]) in got and (2, rows[0][1]) not in got
    assert (None, rows[0][1]) in got and len([d for d, _ in got if d == 6]) == 1
    again = simhash.keep_one_per_component(docs.repartition(7)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, kept.collect()))
    assert simhash.keep_one_per_component(docs.limit(0)).count() == 0


def test_mixed_rows_that_repeat_an_id(spark):
    rows = [(1, "a b c", "s", 1), (1, "a b c", "s", 2), (1, "d e f g h", "s", 3), (1, "a b c", "t", 4), (2, None, "t", 5), (None, "x y", None, 6), (3, "k " * 9, "t", 7), (4, "", None, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").withColumns({c: F.lit(1) for c in ("_times", "times", "row", "uses", "rows", "chance", "copy")})
    for weights in ((1, 2, 3), (3, 1)):
        planned = mixing.mix(docs, weights=weights).collect()
        mixed = mixing.mixed_documents(docs, weights=weights)
        assert mixed.columns == docs.columns
        got = mixed.collect()
        for source in ("s", "t", None):
            size = lambda r: len((r["text"] or "").split())
            assert sum(size(r) for r in got if r["source"] == source) == sum(r["taken"] for r in planned if r["source"] == source)
        uses = [sum(r["n_chars"] == n for r in got) for n in (1, 2)]
        assert abs(uses[0] - uses[1]) <= 1
        assert sorted(map(repr, mixing.mixed_documents(docs.repartition(5), weights=weights).collect())) == sorted(map(repr, got))
    assert mixing.mixed_documents(docs.limit(0)).count() == 0


def test_pipeline_stages_take_odd_tables(spark):
    rows = odd(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for docs in (rows, empty(spark), rows.withColumns({"row": F.lit(1), "_toxicity": F.lit("x"), "removed": F.lit(2)})):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            got = out.collect()
            assert name == "packing" or out.columns == docs.columns
            assert got if docs is rows else len(got) >= 0
            assert name != "line_dedup" or len(got) == docs.count()
