"""Toxicity: gradient-boosted trees over dense features with isotonic calibration (operator 2)."""

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonoframe.llm.shared import pieces, stored
from sonoframe.llm.supervised import calibrated, fit_isotonic, id_remainder, labelled_sample

MAX_LABELLED = 20_000      # labelled rows learned from, at most about
LEXICON_TERMS = 2_000      # learned words and word beginnings, at most
PREFIXES = (4, 5)
MIN_ODDS, MIN_Z = math.log(8), 2.8
CACHED_WORDS = 150_000

# Words that address the reader, in the languages of the corpus.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros".split())
# Characters that stand in for letters.
STAND_INS = str.maketrans("013457@$!|+", "oieastasiit")
EDGES = ".,;:!?\"'()[]{}<>«»„“”…*%#&$-_"

HIT, BEGINNING, ADDRESS, DISGUISED, MIXED, STRETCHED = 1, 2, 4, 8, 16, 32
FEATURES = ("words", "hit_density", "hits", "strongest", "mean_strength", "distinct_hits", "beginning_density", "beginnings", "addressed", "nearness",
            "capitals", "punctuation", "exclamations", "runs", "mixed", "disguised", "stretched", "all_hits")


def bare(word: str) -> str:
    return word.strip(EDGES)


def _terms(words):
    """The words of a document and their beginnings, each once."""
    found = {w for w in words if 3 <= len(w) <= 30}
    return found | {f"{w[:n]}*" for w in found for n in PREFIXES if len(w) > n}


def _term_counts(batches):
    """Kernel: documents per term and label, pre-aggregated over each batch."""
    for batch in pieces(batches, 2_048):
        counts = (Counter(), Counter())
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts[1 if label else 0].update(_terms({bare(w) for w in (text or "").lower().split()}))
        terms = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_pydict({"term": pa.array(terms, pa.string()), "toxic": pa.array([counts[1][t] for t in terms], pa.int64()),
                                          "clean": pa.array([counts[0][t] for t in terms], pa.int64())})


def learn_lexicon(labelled: DataFrame) -> dict[str, float]:
    """Terms whose smoothed log odds for the toxic label are high and certain, with these odds."""
    toxic, clean = labelled.agg(F.count_if(F.expr("label = 1")), F.count_if(F.expr("label <> 1"))).first()
    if not toxic or not clean:
        return {}
    counts = labelled.select("text", "label").mapInArrow(_term_counts, "term string, toxic long, clean long").groupBy("term").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    t, c = F.col("toxic") + 0.5, F.col("clean") + 0.5
    odds = F.log(t / (toxic + 1)) - F.log(c / (clean + 1))
    best = counts.filter("toxic >= 3").select("term", odds.alias("odds"), (odds / F.sqrt(1 / t + 1 / c)).alias("z")).filter(
        (F.col("odds") >= MIN_ODDS) & (F.col("z") >= MIN_Z)).orderBy(F.desc("z"), "term").limit(LEXICON_TERMS)
    return {r["term"]: float(r["odds"]) for r in best.collect()}


class _Codes(dict):
    """Word to a bit code of what it is; computed once per word."""

    def __init__(self, lexicon):
        super().__init__()
        self.lexicon, self.strength = lexicon, {}

    def __missing__(self, token):
        word = bare(token)
        code = 0
        if word in self.lexicon:
            code |= HIT
            self.strength[token] = self.lexicon[word]
        begun = [self.lexicon[p] for n in PREFIXES if len(word) > n and (p := f"{word[:n]}*") in self.lexicon]
        if begun:
            code |= BEGINNING
            self.strength[token] = max(self.strength.get(token, 0.0), *begun)
        if word in SECOND_PERSON:
            code |= ADDRESS
        if not word.isalpha() and any(c.isalpha() for c in word):
            code |= MIXED
            plain = "".join(c for c in word.translate(STAND_INS) if c.isalpha())
            if plain in self.lexicon and not code & HIT:
                code |= DISGUISED
        if any(a == b == c for a, b, c in zip(word, word[1:], word[2:])):
            code |= STRETCHED
            plain = "".join(a for a, b in zip(word, word[1:] + "\0") if a != b)
            if plain in self.lexicon and not code & HIT:
                code |= DISGUISED
        self[token] = code
        return code


def _rates(text: str):
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    capitals, small, high = int(raw[65:91].sum()), int(raw[97:123].sum()), int(raw[192:].sum())
    marks = int(raw[33:48].sum() + raw[58:65].sum() + raw[91:97].sum() + raw[123:127].sum())
    size = max(1, len(text))
    return capitals / max(1, capitals + small + high), marks / size, int(raw[33]) / size, (text.count("!!") + text.count("??") + text.count("..")) / size


def describe(text: str | None, codes: _Codes) -> list[float]:
    """The dense features of one text, in the order of ``FEATURES``."""
    text = text or ""
    words = text.lower().split()
    n = max(1, len(words))
    seen = np.frombuffer(bytes(map(codes.__getitem__, words)), np.uint8)
    hits = np.flatnonzero(seen & (HIT | BEGINNING | DISGUISED))
    strengths = [codes.strength.get(words[i], 1.0) for i in hits]
    address = np.flatnonzero(seen & ADDRESS)
    nearness = 0.0
    if len(hits) and len(address):
        right = np.searchsorted(address, hits)
        gaps = np.minimum(np.abs(address[np.minimum(right, len(address) - 1)] - hits), np.abs(address[np.maximum(right - 1, 0)] - hits))
        nearness = float((1 / (1 + gaps)).mean())
    count = lambda bit: int(np.count_nonzero(seen & bit))
    word_hits, begun, disguised = count(HIT), count(BEGINNING), count(DISGUISED)
    return [math.log1p(len(words)), 100 * word_hits / n, math.log1p(word_hits), max(strengths, default=0.0), sum(strengths) / n,
            math.log1p(len({words[i] for i in hits})), 100 * begun / n, math.log1p(begun), 100 * len(address) / n, nearness,
            *_rates(text), count(MIXED) / n, math.log1p(disguised), count(STRETCHED) / n, math.log1p(len(hits))]


def _described(lexicon: dict[str, float], text_column: str):
    """Kernel: append the features of a text column of ``_row``."""

    def run(batches):
        codes = _Codes(lexicon)
        for batch in pieces(batches):
            if len(codes) > CACHED_WORDS:
                codes.clear(), codes.strength.clear()
            features = [describe(t.as_py(), codes) for t in batch.column(0).field(text_column)]
            yield batch.append_column("_features", pa.array(features, pa.list_(pa.float64())))

    return run


@dataclass
class ToxicityModel:
    lexicon: dict
    trees: object      # fitted GBTClassificationModel, None where there was one label only
    calibration: object
    prior: float


def _with_features(docs: DataFrame, lexicon: dict, text_column: str) -> DataFrame:
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    schema = f"_row {rows.schema['_row'].dataType.simpleString()}, _features array<double>"
    return rows.mapInArrow(_described(lexicon, text_column), schema).withColumn("_vector", array_to_vector("_features"))


def _raw(model: ToxicityModel, rows: DataFrame) -> DataFrame:
    return model.trees.transform(rows).withColumn("_score", vector_to_array("_probability")[1])


def fit_toxicity(labelled: DataFrame) -> ToxicityModel:
    """Learn lexicon, trees and calibration from ``labelled_sample`` rows (bounded by its ``max_rows``)."""
    lexicon = learn_lexicon(labelled)
    rows = stored(_with_features(labelled.select("text", "label", "calibrates"), lexicon, "text").select(
        "_features", F.col("_row.label").alias("label"), F.col("_row.calibrates").alias("calibrates")).coalesce(4)).withColumn("_vector", array_to_vector("_features"))
    n, toxic, fitting, fitting_toxic, aside, aside_toxic = rows.agg(
        F.count("*"), F.sum("label"), F.count_if(F.expr("not calibrates")), F.sum(F.when(~F.col("calibrates"), F.col("label"))),
        F.count_if(F.expr("calibrates")), F.sum(F.when(F.col("calibrates"), F.col("label")))).first()
    prior = (toxic or 0) / n if n else 0.0
    if not fitting or not fitting_toxic or fitting_toxic == fitting:
        return ToxicityModel(lexicon, None, None, prior)
    boosting = GBTClassifier(featuresCol="_vector", labelCol="label", predictionCol="_prediction", maxIter=20, maxDepth=4, stepSize=0.3,
                             minInstancesPerNode=2, seed=7).setRawPredictionCol("_raw").setProbabilityCol("_probability")
    trees = boosting.fit(rows.filter("not calibrates"))
    model = ToxicityModel(lexicon, trees, None, prior)
    both_aside = aside and aside_toxic and aside_toxic < aside
    model.calibration = fit_isotonic(_raw(model, rows.filter("calibrates") if both_aside else rows), "_score")
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_column: str = "text", to: str = "toxicity") -> DataFrame:
    """``docs`` with a column ``to``: the calibrated chance that the whole text is toxic, from 0 to 1.

    Null and empty texts are scored as texts without words.  Every row is scored on its own, so ties and repeated rows
    get equal scores.  Columns pass through under their own names, whatever these are; one named ``to`` is replaced.  Without
    training rows of both labels the score is the share of toxic ones, 0 without any.
    """
    names = [F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c != to]
    if model.trees is None:
        return docs.withColumn(to, F.lit(float(model.prior)))
    rows = calibrated(_raw(model, _with_features(docs, model.lexicon, text_column)), model.calibration)
    return rows.select(*names, F.col("_calibrated").alias(to))


def fit_on_labels(docs: DataFrame, labels: DataFrame, may_learn: Column | None = None, max_rows: int = MAX_LABELLED) -> ToxicityModel:
    """Fit on the labelled documents that may be learned from: by default those whose id's crc32 is no multiple of 5."""
    may = id_remainder("doc_id", 5) != 0 if may_learn is None else may_learn
    return fit_toxicity(labelled_sample(docs, labels, "toxic", may, max_rows))
