"""Mixing sources to target weights by soft domain membership.

A softmax classifier, fitted on labelled documents, gives every document a
posterior over domains. Nonnegative document rates are then fitted by projected
gradient least squares so that expected tokens by domain meet their targets.
The state of the descent is a handful of vectors of one number a domain: a
document's rate is the fold of its posterior over them, so that no rates are
stored, and an iteration is one pass over (tokens, posterior) that returns as
many sums as there are domains.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Staging, load
from .kernels import LOWER, slices, span_hashes, tidy, utf8, words

#: Hashed word features; byte frequencies follow them.
FEATURES = 4096
WIDTH = FEATURES + 256
#: Labelled documents of one domain that are learned from at most, chosen by a hash of their text.
SAMPLE = 500
#: Weights of the domains among the tokens of the mixture.
TARGETS = {"high": 0.84, "low": 0.11, "toxic": 0.05}


def parts_of(batch: pa.RecordBatch, column: int):
    """Slices of at most 128 rows and, but for longer texts, a megabyte of text."""
    for part in slices(batch, column, 1_000_000):
        for lo in range(0, part.num_rows, 128):
            yield part.slice(lo, 128)


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Square roots of relative frequencies of hashed words and of bytes; words of every text."""
    data, offsets = utf8(column)
    n = len(offsets) - 1
    starts, ends, text = words(data, offsets)
    h = span_hashes(LOWER[data], starts, ends)
    count = np.bincount(text, minlength=n)
    word = np.bincount(text * FEATURES + (h >> np.uint64(52)).astype(np.int64), minlength=n * FEATURES).reshape(n, FEATURES)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    byte = np.bincount(owner * 256 + data, minlength=n * 256).reshape(n, 256)
    out = np.empty((n, WIDTH), np.float32)
    out[:, :FEATURES] = np.sqrt(word / np.maximum(count, 1)[:, None])
    out[:, FEATURES:] = np.sqrt(byte / np.maximum(np.diff(offsets), 1)[:, None])
    return out, count


def fit(x: np.ndarray, y: np.ndarray, domains: int, rounds: int = 200) -> dict:
    """Softmax regression in which every domain counts alike."""
    if not len(y):
        return {"w": np.zeros((WIDTH, domains), np.float32), "b": np.zeros(domains)}
    mean = x.mean(0)
    centred = x - mean
    near = centred @ centred.T  # descent runs on the rows' weights, of which the feature weights are sums
    share = np.bincount(y, minlength=domains)
    weight = (1 / (np.count_nonzero(share) * share[y]))[:, None]
    truth = np.eye(domains)[y]
    a, b = np.zeros((len(y), domains), np.float32), np.where(share > 0, 0.0, -30.0)
    speed_a, speed_b = np.zeros_like(a), np.zeros_like(b)
    for _ in range(rounds):
        slope = weight * (softmax(near @ a + b) - truth)
        speed_a = (0.9 * speed_a - 10.0 * (slope + 1e-5 * a)).astype(np.float32)
        speed_b = 0.9 * speed_b - slope.sum(0)
        a, b = a + speed_a, b + speed_b
    w = centred.T @ a
    return {"w": w.astype(np.float32), "b": b - mean @ w}


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(docs: DataFrame, labelled: DataFrame, domains: list[str], staging: Staging, text: str = "text", doc_id: str = "doc_id", sample: int = SAMPLE) -> dict:
    """Classifier from at most ``sample`` distinct texts a domain; rows without text or domain teach nothing.

    ``labelled`` holds (doc_id, domain). The sample is the texts of lowest hash,
    one document for each: labels meet ids and hashes, never texts, and by
    shuffle at every size; only the texts chosen are fetched.
    """
    hashes = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("i"), F.xxhash64(text).alias("h"))
    taught = labelled.where(F.col("domain").isin(domains)).select(F.col("doc_id").alias("i"), F.col("domain").alias("y"))
    rows = staging.table(hashes.join(taught.hint("merge"), "i"))
    order = Window.partitionBy("y").orderBy("h")
    chosen = rows.groupBy("y", "h").agg(F.min("i").alias("i")).withColumn("r", F.row_number().over(order)).where(F.col("r") <= sample).select("y", "h", "i")
    texts = docs.select(F.col(doc_id).alias("i"), F.xxhash64(text).alias("h"), F.col(text).alias("t"))
    # at most sample rows a domain are broadcast
    picked = texts.join(F.broadcast(chosen), ["i", "h"]).groupBy("y", "h").agg(F.first("t").alias("t"))

    def run(batches):
        for batch in batches:
            for part in parts_of(batch, 1):
                x, _ = features(part.column(1))
                for y, f in zip(part.column(0).to_pylist(), x, strict=True):
                    at = np.flatnonzero(f)
                    yield pa.RecordBatch.from_arrays([pa.array([y]), pa.array([at.astype(np.int32)], pa.list_(pa.int32())), pa.array([f[at]], pa.list_(pa.float32()))], ["y", "at", "f"])

    found = []
    for r in picked.select("y", "t").mapInArrow(tidy(run), "y string, at array<int>, f array<float>").toLocalIterator():
        f = np.zeros(WIDTH, np.float32)
        f[np.array(r["at"], int)] = r["f"]
        found.append((domains.index(r["y"]), f.tobytes()))
    found.sort()
    x = np.stack([np.frombuffer(f, np.float32) for _, f in found]) if found else np.zeros((0, WIDTH), np.float32)
    model = fit(x, np.array([y for y, _ in found], int), len(domains))
    # the sample is even over domains; posteriors follow the shares among all labelled rows
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    known = np.array([counts.get(d, 0) for d in domains], float)
    if known.sum():
        model["b"] = model["b"] + np.log((known + 1e-3) / known.sum())
    staging.drop(rows)
    return model


def rates(p: np.ndarray, history: list[np.ndarray]) -> np.ndarray:
    """Rates after the steps so far: down the gradient, then onto the nonnegative half-line."""
    r = np.ones(len(p))
    for g in history:
        r = np.maximum(0.0, r - p @ g)
    return r


def solve(state: DataFrame, targets: np.ndarray, thin: list[bool], rounds: int = 200, tolerance: float = 1e-5) -> tuple[list[np.ndarray], np.ndarray, bool]:
    """(steps, wanted domain tokens, whether they are met) for ``state`` (n long, p array<double>).

    The total is the smallest for which only domains marked in ``thin`` have to
    give up tokens. Steps are gradients in the metric of the domains' Gram
    matrix; one that does not lessen the residual is halved. Where no rates
    meet the targets the descent ends at the least squares it has reached.
    """
    k = len(targets)
    spark = state.sparkSession

    def sums(history):
        shared = spark.sparkContext.broadcast(history)

        def run(batches):
            total, gram = np.zeros(k), np.zeros((k, k))
            for batch in batches:
                n = batch.column(0).to_numpy().astype(float)
                p = batch.column(1).flatten().to_numpy().reshape(-1, k)
                weight = n * rates(p, shared.value)
                total += weight @ p
                live = n * (weight > 0) if history else n
                gram += (p * live[:, None]).T @ p
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate((total, gram.ravel()))], pa.list_(pa.float64()))], ["s"])

        parts = state.select("n", "p").mapInArrow(tidy(run), "s array<double>")
        exploded = parts.select(F.posexplode("s").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v"))
        got = {r["at"]: r["v"] for r in exploded.collect()}  # k + k * k numbers
        flat = np.array([got.get(i, 0.0) for i in range(k + k * k)])
        return flat[:k], flat[k:].reshape(k, k)

    have, gram = sums([])
    total = have.sum()
    if total <= 0:
        return [], np.zeros(k), True
    scale = max([h / (total * t) for h, t, free in zip(have, targets, thin, strict=True) if not free and t > 0], default=1.0)
    wanted = targets * total * scale
    history, step = [], 1.0
    miss = have - wanted
    for _ in range(rounds):
        if np.abs(miss).max() <= tolerance * wanted.sum():
            break
        damp = gram + 1e-9 * np.trace(gram) * np.eye(k)
        trial = [*history, step * np.linalg.solve(damp, miss)]
        new, new_gram = sums(trial)
        if np.linalg.norm(new - wanted) < np.linalg.norm(miss):
            history, miss, gram, step = trial, new - wanted, new_gram, min(1.0, 2 * step)
        elif step < 1e-9:
            break
        else:
            step /= 2
    return history, wanted, bool(np.abs(miss).max() <= tolerance * wanted.sum())


def mix_sources(
    docs: DataFrame, labelled: DataFrame, targets: dict[str, float] = TARGETS, thin: tuple[str, ...] = ("low", "toxic"), text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """Add ``n_tokens``, ``posteriors`` (one number a domain, in the order of ``targets``), ``rate``, ``copies`` and ``targets_met``.

    ``labelled`` has ``doc_id`` and ``domain``. rate is the expected number of
    copies of a document in the mixture; copies rounds it up or down by a hash
    of id and text, so that the expectation holds. ``targets_met`` says, alike
    in all rows, whether the expected tokens reach the targets within 1e-5 of
    their sum; if not, rates are those of the descent's last step. Null texts are empty; texts
    without words have no tokens and, as every text, a posterior. Repeated rows
    are rated alike, one by one. Columns of these names are replaced. Without
    labelled rows all posteriors are even. An empty table gives an empty result.
    """
    domains = list(targets)
    weights = np.array([targets[d] for d in domains]) / sum(targets.values())
    staging = Staging(docs.sparkSession, "mixing")
    model = train(docs, labelled, domains, staging, text, doc_id)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: features times domains
    base = docs.drop("n_tokens", "posteriors", "rate", "copies", "targets_met")
    at = base.columns.index(text)
    schema = ", ".join(f"`{c}` {t}" for c, t in base.dtypes)

    def scored(batches, column):
        for batch in batches:
            for part in parts_of(batch, column):
                x, count = features(part.column(column))
                p = softmax(x @ shared.value["w"] + shared.value["b"])
                yield part, count, p

    def measure(batches):
        for _, count, p in scored(batches, 0):
            yield pa.RecordBatch.from_arrays([pa.array(count), pa.array(list(p), pa.list_(pa.float64()))], ["n", "p"])

    state = staging.table(docs.select(text).mapInArrow(tidy(measure), "n long, p array<double>"))
    history, _, met = solve(state, weights, [d in thin for d in domains])
    staging.drop(state)

    def rate(batches):
        for part, count, p in scored(batches, at):
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(count), pa.array(list(p), pa.list_(pa.float64())), pa.array(rates(p, history))],
                [*part.schema.names, "n_tokens", "posteriors", "rate"],
            )

    out = base.mapInArrow(tidy(rate), f"{schema}, n_tokens long, posteriors array<double>, rate double")
    luck = F.pmod(F.xxhash64(F.col(doc_id), F.col(text)), F.lit(1 << 30)) / float(1 << 30)
    return out.withColumns({"copies": F.floor(F.col("rate") + luck).cast("int"), "targets_met": F.lit(met)})


def domains_of(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of labels: toxic, else of high or low quality."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low")
    return labels.select("doc_id", domain.alias("domain"))


def op10_mixing(spark, sf_dir):
    """Rates of all documents for the target weights of quality domains."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = mix_sources(docs, domains_of(load(spark, sf_dir, "labels")))
    names = [F.round(F.col("posteriors")[i], 9).alias(f"p_{d}") for i, d in enumerate(TARGETS)]
    return out.select("doc_id", "source", "n_tokens", *names, "rate", "copies", "targets_met")
