"""Language identification by error-correcting output codes.

Languages get binary codewords. For every bit a binary classifier over hashed
character n-grams (1 to 3 letters) tells the languages with that bit from the
others. Decoding sums, for every language, the logistic loss of the bits'
margins against its codeword, each bit weighted by its accuracy in training;
the nearest codeword wins, and two near codewords flag the text as ambiguous.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Staging, load
from .kernels import tidy

#: Hashed n-gram features.
FEATURES = 1 << 13
#: Labelled documents of one language, and of all, that are learned from at most, chosen by a hash of their text.
SAMPLE, SAMPLE_ALL = 250, 4000
#: Languages that can be learned at once: of each, ten documents at least reach the driver.
MOST_LANGUAGES = 400
#: Characters of one slice of a long text; slices share their edges and are summed, so that nothing is left out.
SLICE = 1 << 20
AMBIGUOUS = 0.6
UNKNOWN = "und"
_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """By code point: is it a letter?"""
    if not _letters:
        _letters.append(np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)]))
    return _letters[0]


def ngram_ids(before: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Feature numbers of the 1- to 3-grams that end in ``points``; ``before`` are up to two code points ahead of them.

    Code points are those of letters, and 0 for all else.
    """
    n = len(before)
    x = np.concatenate((before, points)).astype(np.uint32)
    inside = (x[1:] > 0) | (x[:-1] > 0)
    two = (x[:-1] * np.uint32(0x9E3779B1)) ^ (x[1:] * np.uint32(0x85EBCA77))
    three = (two[:-1] * np.uint32(0xC2B2AE3D)) ^ (x[2:] * np.uint32(0x27D4EB2F))
    one = x[n:][x[n:] > 0] * np.uint32(0x165667B1)
    new = max(n - 1, 0)
    parts = (one, two[new:][inside[new:]] + np.uint32(0x7F4A7C15), three[inside[:-1] & inside[1:]] + np.uint32(0x3C6EF372))
    return np.concatenate([(((p ^ (p >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(8)) % np.uint32(FEATURES) for p in parts])


def features(text: str) -> np.ndarray | None:
    """Relative n-gram frequencies of letters and word limits in a whole text; None without a letter.

    Long texts are read slice by slice, each with the last two characters of the one before.
    """
    text, total, some = text.lower(), np.zeros(FEATURES, np.int64), False
    before = np.zeros(1, np.uint32)  # the limit ahead of the text
    for at in range(0, len(text), SLICE):
        points = np.frombuffer(text[at : at + SLICE].encode("utf-32-le", "surrogatepass"), "<u4")
        letters = letter_table()[np.minimum(points, 0x10FFFF)]
        some = some or bool(letters.any())
        x = np.where(letters, points, 0)
        if at + SLICE >= len(text):
            x = np.concatenate((x, [0]))  # and the one behind it
        total += np.bincount(ngram_ids(before, x), minlength=FEATURES)
        before = np.concatenate((before, x))[-2:]
    return np.sqrt(total / total.sum()).astype(np.float32) if some else None


def codewords(n: int) -> np.ndarray:
    """n codewords of -1 and 1: the exhaustive code up to 6 languages, else far random words chosen by rule."""
    if n <= 1:
        return np.ones((max(n, 1), 1))
    if n <= 6:
        bits = np.arange(1, 1 << (n - 1))
        return np.array([np.ones(len(bits)) if i == 0 else 1 - 2.0 * (bits >> (i - 1) & 1) for i in range(n)])
    rng = np.random.default_rng(7)
    best, far = None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, int(np.ceil(10 * np.log2(n)))))
        gap = min((code[i] != code[j]).sum() for i in range(n) for j in range(i))
        usable = (np.abs(code.sum(0)) < n).all()
        if usable and gap > far:
            best, far = code, gap
    return best


def fit(rows: list[tuple[np.ndarray, str]]) -> dict:
    """Codewords, one logistic classifier a bit, bit weights; rows: (features, language)."""
    langs = sorted({y for _, y in rows})
    x = np.stack([f for f, _ in rows]) if rows else np.zeros((0, FEATURES), np.float32)
    y = np.array([langs.index(l) for _, l in rows], int)
    code = codewords(len(langs))
    if len(langs) < 2:
        return {"langs": langs, "code": code, "w": np.zeros((FEATURES, code.shape[1]), np.float32), "b": np.zeros(code.shape[1]), "bit": np.ones(code.shape[1]), "sharp": 1.0}
    target = code[y]
    share = np.bincount(y, minlength=len(langs))
    weight = (len(y) / (len(langs) * share))[y][:, None] / len(y)  # every language counts alike
    mean = x.mean(0)
    centred = x - mean
    near = centred @ centred.T  # descent runs on the rows' weights, of which the feature weights are sums
    a, b = np.zeros((len(y), code.shape[1]), np.float32), np.zeros(code.shape[1])
    speed_a, speed_b = np.zeros_like(a), np.zeros_like(b)
    for _ in range(150):
        margin = target * (near @ a + b)
        slope = -weight * target / (1 + np.exp(np.clip(margin, -30, 30)))
        speed_a = (0.9 * speed_a - 8.0 * (slope + 1e-5 * a)).astype(np.float32)
        speed_b = 0.9 * speed_b - 1.0 * slope.sum(0)
        a, b = a + speed_a, b + speed_b
    hit = (target * (near @ a + b) > 0).mean(0)
    w = centred.T @ a
    return {"langs": langs, "code": code, "w": w.astype(np.float32), "b": b - mean @ w, "bit": np.maximum(hit - 0.5, 1e-3) / (hit - 0.5).clip(1e-3).sum()}


def decode(margins: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Per text the nearest codeword's number and every language's share of belief."""
    loss = np.logaddexp(0, -margins[:, None, :] * model["code"][None])  # text, language, bit
    loss = (loss * model["bit"]).sum(2) * model["code"].shape[1]
    belief = np.exp(-(loss - loss.min(1, keepdims=True)))
    belief /= belief.sum(1, keepdims=True)
    return belief.argmax(1), belief


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> dict:
    """Fit on at most ``sample`` labelled rows a language, fewer if there are many: about ``SAMPLE_ALL`` in all reach the driver, and more than ``MOST_LANGUAGES`` languages are an error. Rows without language, text or letter teach nothing."""
    order = Window.partitionBy("y").orderBy("h")
    taught = F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")
    rows = labelled.where(taught).select(F.col(lang).alias("y"), F.col(text).alias("t"), F.xxhash64(text).alias("h"))
    known = rows.select("y", "h").distinct()
    languages = known.select("y").distinct().count()
    if languages > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    most = min(sample, max(10, SAMPLE_ALL // max(1, languages)))
    # equal texts teach once; the choice is by hash and alike at every size
    chosen = known.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).select("y", "h")
    picked = rows.join(F.broadcast(chosen), ["y", "h"], "left_semi").groupBy("y", "h").agg(F.first("t").alias("t"))

    def run(batches):
        for batch in batches:
            for y, h, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                f = features(t)
                if f is not None:
                    at = np.flatnonzero(f)
                    yield pa.RecordBatch.from_arrays([pa.array([y]), pa.array([h]), pa.array([at.astype(np.int32)], pa.list_(pa.int32())), pa.array([f[at]], pa.list_(pa.float32()))], ["y", "h", "at", "f"])

    found = []
    for r in picked.select("y", "h", "t").mapInArrow(tidy(run), "y string, h long, at array<int>, f array<float>").toLocalIterator():
        f = np.zeros(FEATURES, np.float32)
        f[np.array(r["at"], int)] = r["f"]
        found.append((f, r["y"], r["h"]))
    found.sort(key=lambda p: p[1:])
    return fit([(f, y) for f, y, _ in found])


def predict(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """Add ``lang_pred``, ``score`` and ``ambiguous`` to ``docs``.

    Null texts, texts without a letter and everything under a model that
    learned no language are ``und`` with score 0. Columns of these names are
    replaced; repeated rows are predicted one by one; every text is read whole.
    """
    base = docs.drop("lang_pred", "score", "ambiguous")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: features times bits
    at = base.columns.index(text)

    def run(batches):
        model = shared.value
        for batch in batches:
            texts = batch.column(at).to_pylist()
            lang, score, unsure = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
            for lo in range(0, len(texts), 512):
                found = {i: f for i, t in enumerate(texts[lo : lo + 512], lo) if t and model["langs"] and (f := features(t)) is not None}
                if found:
                    best, belief = decode(np.stack(list(found.values())) @ model["w"] + model["b"], model)
                    for i, k, p in zip(found, best, belief, strict=True):
                        lang[i], score[i] = model["langs"][k], p[k]
                        unsure[i] = p[k] < AMBIGUOUS
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score), pa.array(unsure)], [*batch.schema.names, "lang_pred", "score", "ambiguous"])

    schema = ", ".join(f"`{c}` {t}" for c, t in base.dtypes)
    return base.mapInArrow(tidy(run), f"{schema}, lang_pred string, score double, ambiguous boolean")


def held_out(doc_id: str, folds: int, fold: int):
    """Whether the id's checksum puts a row into the fold that is never learned from; null ids are learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(False))


def op5_language(spark, sf_dir):
    """Predicted language of every document."""
    docs = load(spark, sf_dir, "documents")
    model = train(docs.where(~held_out("doc_id", 3, 1)))
    rows = docs.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "text")
    return predict(rows, model).drop("text")
