"""Main text of pages by gradient-boosted trees over DOM nodes with hierarchical decoding (operator 4)."""

import html
import random

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonoframe.llm.html_tree import TOKEN_GROUPS, features, joined, parse
from sonoframe.llm.shared import pieces, share, stored

MAX_PAGES = 400        # pages learned from, at most about
LAYOUTS = 3            # layouts drawn around the texts of each of them
ROOTS = ("article", "main")
NOT_TEXT = frozenset("nav aside footer form header menu button".split())


def _marked_layout(blocks: list[tuple[str, str]], other: list[str], draw: random.Random) -> str:
    """A page around the blocks whose parts say by ``data-keep`` whether they are main text."""
    esc = lambda s: html.escape(s, quote=False)
    say = lambda n: esc(" ".join(draw.choice(other).split()[:n]) or "More")
    named = lambda group: draw.choice(("", f' class="{draw.choice(TOKEN_GROUPS[group].split())}"', f' id="{draw.choice(TOKEN_GROUPS[group].split())}-{draw.randint(1, 9)}"'))
    sure = lambda group: f' class="{draw.choice(TOKEN_GROUPS[group].split())}{draw.choice(("", "-box", " wrap", "-list"))}"'
    links = lambda n: "".join(f'<li><a href="/{i}">{say(2)}</a></li>' for i in range(n))
    paragraphs = lambda n: "".join(f"<p>{say(draw.randint(5, 60))}</p>" for _ in range(n))

    def part(kind: str) -> str:
        plain = draw.random() < 0.5
        if kind == "nav":
            inner = f"<ul>{links(draw.randint(2, 9))}</ul>"
            return f'<nav data-keep="0">{inner}</nav>' if plain else f'<div{sure(2)} data-keep="0">{inner}</div>'
        if kind == "header":
            inner = f"<a href='/'>{say(3)}</a><p>{say(8)}</p>"
            return f'<header{named(7)} data-keep="0">{inner}</header>' if plain else f'<div id="{draw.choice(("masthead", "header", "top"))}" data-keep="0">{inner}</div>'
        if kind == "footer":
            inner = f"&copy; {say(2)} &middot; {say(12)}" if plain else f"<ul>{links(3)}</ul><p>{say(10)}</p>"
            return f'<footer data-keep="0">{inner}</footer>' if draw.random() < 0.6 else f'<div{sure(6)} data-keep="0">{inner}</div>'
        if kind == "aside":
            inner = f"<h3>{say(3)}</h3><ul>{links(draw.randint(2, 6))}</ul>" if plain else paragraphs(draw.randint(1, 3))
            return f'<aside data-keep="0">{inner}</aside>' if draw.random() < 0.5 else f'<div class="{draw.choice(("sidebar", "related", "widget", "rail", "share", "social"))}" data-keep="0">{inner}</div>'
        if kind == "comments":
            inner = "".join(f'<div{draw.choice(("", sure(3)))}>{paragraphs(1)}</div>' for _ in range(draw.randint(1, 6)))
            return f'<{(tag := draw.choice(("section", "div", "ol")))}{sure(3)} data-keep="0"><h3>{say(2)}</h3>{inner}</{tag}>'
        if kind == "form":
            return f'<form{named(5)} data-keep="0"><label>{say(3)}</label><input name="q"><button>{say(1)}</button><p>{say(9)}</p></form>'
        tokens = sure(1) if kind == "ad" else sure(4)
        return f'<div{tokens} data-keep="0">{say(draw.randint(4, 40)) if plain else paragraphs(draw.randint(1, 2))}</div>'

    body, inside = [], []
    for tag, words in blocks:
        body.append(f"<{tag}>{esc(words)}</{tag}>" if draw.random() < 0.9 or tag != "p" else f"<div>{esc(words)}</div>")
    for kind in ("ad", "notice", "aside", "form", "comments", "nav"):
        if draw.random() < 0.15:
            inside.append(part(kind))
    for x in inside:
        body.insert(draw.randint(0, len(body)), x)
    main = "".join(body)
    frame = draw.choice(("article", "article", "main", "section", "div", "div"))
    main = f'<{frame}{named(0)} data-keep="1">{main}</{frame}>'
    for _ in range(draw.randint(0, 2)):
        wrap = draw.choice(("div", "section", "main"))
        main = f"<{wrap}{named(0)}>{main}</{wrap}>"
    before = [part(k) for k in ("header", "nav", "notice", "ad", "form", "aside") if draw.random() < 0.45]
    after = [part(k) for k in ("ad", "comments", "aside", "form", "nav", "notice", "footer") if draw.random() < 0.45]
    draw.shuffle(before)
    return f"<html><head><title>{say(5)}</title></head><body>{''.join(before)}{main}{''.join(after)}</body></html>"


def _labelled(nodes, region=None):
    """Node and label rows: from the marks of a layout, or by whether a node is or wraps main text in a semantic region."""
    good = {}
    for node in nodes:
        inherited = good.get(node.parent, None)
        own = node.keep if region is None else (True if node is region else False if inherited and (node.tag in NOT_TEXT or any(node.tokens[1:7])) else None)
        good[node] = own if own is not None and inherited is not False else inherited
    wraps = set()
    for node in nodes:
        if good[node]:
            while node and node not in wraps:
                wraps.add(node)
                node = node.parent
    return [(n, 1 if n in wraps else 0) for n in nodes]


def _training_rows(batches):
    """Kernel: node features and labels of pages with a semantic article, and of layouts drawn around their texts."""
    for batch in pieces(batches, 64):
        xs, ys = [], []

        def learn(nodes, region=None):
            total = nodes[0].chars
            for node, label in _labelled(nodes, region):
                xs.append(features(node, total)), ys.append(label)

        for page, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if not text:
                continue
            nodes, parts = parse(text)
            region = next((n for tag in ROOTS for n in nodes if n.tag == tag), None)
            inside = {n: y for n, y in _labelled(nodes, region)} if region else {}
            blocks, other, words, last = [], [], "", None
            for node, piece in [*parts, (None, None)]:
                if piece is not None:
                    words, last = words + piece, node
                elif words.strip():
                    tag = last.tag if last.tag in ("h1", "h2", "h3", "p", "li", "blockquote", "pre") else "p"
                    good = inside.get(last, 0) if region else len(words) > 80
                    (blocks if good else other).append((tag, " ".join(words.split())) if good else " ".join(words.split()))
                    words = ""
                else:
                    words = ""
            for _ in range(LAYOUTS if region else 0):  # as much weight as the drawn layouts
                learn(nodes, region)
            draw = random.Random(page)
            if blocks:
                for _ in range(LAYOUTS):
                    chosen = blocks[:2] + [b for b in blocks[2:] if draw.random() < 0.7]
                    sayings = other + [b for _, b in blocks]
                    learn(parse(_marked_layout(chosen, sayings, draw))[0])
        yield pa.RecordBatch.from_arrays([pa.array(xs, pa.list_(pa.float64())), pa.array(ys, pa.int32())], ["x", "label"])


class Trees:
    """Fitted boosted trees as arrays, to score node rows inside the kernel."""

    def __init__(self, model):
        self.trees = []
        for tree, weight in zip(model.trees, model.treeWeights):
            rows = []

            def add(node) -> int:
                at = len(rows)
                rows.append([-1, 0.0, 0, 0, node.prediction() * weight])
                if not node.getClass().getSimpleName().startswith("Leaf"):
                    rows[at][0], rows[at][1] = node.split().featureIndex(), node.split().threshold()
                    rows[at][2], rows[at][3] = add(node.leftChild()), add(node.rightChild())
                return at

            add(tree._call_java("rootNode"))
            self.trees.append([np.array(c) for c in zip(*rows)])

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, threshold, left, right, value in self.trees:
            at = np.zeros(len(x), int)
            while (inner := feature[at] >= 0).any():
                low = x[np.arange(len(x)), np.maximum(feature[at], 0)] <= threshold[at]
                at = np.where(inner, np.where(low, left[at], right[at]), at)
            total += value[at]
        return 2 * total


def decode(nodes, odds) -> set:
    """The likeliest choice of nodes in which nothing below a left-out node is kept.

    The gain of keeping a node is its log odds plus the gains of its children that are worth keeping; a node is kept if its gain is
    positive and its parent is kept.
    """
    gain = dict(zip(nodes, odds))
    for node in reversed(nodes):
        if node.parent and gain[node] > 0:
            gain[node.parent] += gain[node]
    kept = set()
    for node in nodes:
        if gain[node] > 0 and (node.parent is None or node.parent in kept):
            kept.add(node)
    return kept


def _extracted(trees: Trees, html_column: str):
    """Kernel: append the main text of a page column of ``_row``; the nodes of several pages are scored at once."""

    def run(batches):
        for batch in pieces(batches, 64):
            parsed = [parse(page or "") for page in batch.column(0).field(html_column).to_pylist()]
            odds = trees.log_odds(np.array([features(n, nodes[0].chars) for nodes, _ in parsed for n in nodes]))
            texts, at = [], 0
            for nodes, found in parsed:
                kept = decode(nodes, odds[at:at + len(nodes)])
                at += len(nodes)
                texts.append(joined(found, kept.__contains__))
            yield batch.append_column("_text", pa.array(texts, pa.string()))

    return run


def fit_extractor(pages: DataFrame, id_column: str = "page_id", html_column: str = "html", max_pages: int = MAX_PAGES) -> Trees | None:
    """Learn from about ``max_pages`` pages: their semantic articles, and layouts of many kinds around their texts.

    The layouts vary elements, class names, order and nesting of main text, menus, headers, footers, sidebars, notices, adverts, forms and
    reader comments, so that what is learned does not hang on one template.  None without any learnable page.
    """
    known = pages.select(F.col(f"`{id_column}`").cast("string").alias("page"), F.col(f"`{html_column}`").cast("string").alias("html")).filter("length(html) > 0")
    part = min(1.0, max_pages / max(1, known.count()))
    rows = stored(known.filter(share("page", "pages", part)).mapInArrow(_training_rows, "x array<double>, label int").coalesce(4))
    counts = rows.agg(F.count("*"), F.sum("label")).first()
    if not counts[0] or not counts[1] or counts[1] == counts[0]:
        return None
    rows = rows.withColumn("v", array_to_vector("x"))
    return Trees(GBTClassifier(featuresCol="v", labelCol="label", maxIter=30, maxDepth=5, stepSize=0.3, seed=3).fit(rows))


def extract(pages: DataFrame, trees: Trees | None, html_column: str = "html", to: str = "text") -> DataFrame:
    """``pages`` with a column ``to``: the main text of the whole page, empty if there is none.

    Character references are decoded, white space inside a block becomes one space, and blocks are joined by one.  Scripts, styles, titles
    and comments of the markup are never text.  Null and empty pages give an empty text.  Every row is read on its own, so repeated
    rows get equal texts; columns pass through under their own names, and one named ``to`` is replaced.
    """
    names = [F.col(f"_row.`{c}`").alias(c) for c in pages.columns if c != to]
    if trees is None:
        return pages.withColumn(to, F.lit(""))
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("_row"))
    found = rows.mapInArrow(_extracted(trees, html_column), f"_row {rows.schema['_row'].dataType.simpleString()}, _text string")
    return found.select(*names, F.col("_text").alias(to))
