"""A quality classifier whose document evidence is combined with posteriors of hosts and paths by hierarchical empirical Bayes."""

from __future__ import annotations

import operator
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwise.llm.common import REMEMBERED, broadcast_if_small, durable, fresh, memory, only, row_key

# Signs that prose uses rarely.
SIGNS = b"%$&*#|<>{}[]=~^\\_"
UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
#: Numbers of a document's surface, and buckets that its words are hashed to.
COUNTS = ("log_words", "signs", "pipes", "exclaims", "upper", "digits", "distinct", "repeated", "word_chars", "line_words")
BUCKETS = 512
#: Words without what is no letter or digit, so that signs stuck to words do not make new ones.
PLAIN = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

_BUCKET_OF: dict[bytes, int] = memory()


def _buckets(words: list[bytes]) -> np.ndarray:
    """The bucket of each word; common words are remembered, until there are too many."""
    try:
        return np.fromiter(map(_BUCKET_OF.__getitem__, words), dtype=np.int64, count=len(words))
    except KeyError:
        if len(_BUCKET_OF) > REMEMBERED:
            _BUCKET_OF.clear()
        found = [_BUCKET_OF[w] if w in _BUCKET_OF else zlib.crc32(w) % BUCKETS for w in words]
        _BUCKET_OF.update((w, b) for w, b in zip(words, found, strict=True) if len(w) < 64)
        return np.array(found, dtype=np.int64)


def features(text: str | None) -> np.ndarray:
    """What the classifier reads of a whole text: COUNTS, each between 0 and about 3, and the square roots of the buckets' shares of words."""
    t = (text or "").encode()
    words = t.split()
    n, nw = max(1, len(text or "")), max(1, len(words))
    share = lambda signs: (len(t) - len(t.translate(None, signs))) / n
    out = np.zeros(len(COUNTS) + BUCKETS, dtype=np.float32)
    repeated = sum(map(operator.eq, words, words[1:]))
    out[: len(COUNTS)] = (
        np.log10(nw + 1), 3 * share(SIGNS), 3 * share(b"|"), 3 * share(b"!"), 2 * share(UPPER), 3 * share(DIGITS), len(set(words)) / nw, 3 * repeated / nw, min(n / nw, 30.0) / 10, np.log10(nw / (t.count(b"\n") + 1) + 1),
    )
    plain = PLAIN.sub(b" ", t.lower()).split()
    if plain:
        out[len(COUNTS) :] = np.sqrt(np.bincount(_buckets(plain), minlength=BUCKETS) / len(plain))
    return out


@dataclass(frozen=True)
class Model:
    """Weights on standardised features; bias last."""

    weights: np.ndarray
    means: np.ndarray
    scales: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.means) / self.scales, -4, 4)
        return np.clip(z @ self.weights[:-1] + self.weights[-1], -12, 12)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, word_ridge: float = 100.0, rounds: int = 30, at_once: int = 1024) -> Model:
    """Logistic regression by Newton steps, with a stronger ridge for words than for counts; without both classes, all weights are zero.

    Rows are widened `at_once` at a time, so the driver holds little beside x itself.
    """
    k = len(COUNTS) + BUCKETS
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(k + 1), np.zeros(k), np.ones(k))
    parts = [slice(at, at + at_once) for at in range(0, len(x), at_once)]
    means = sum(x[p].sum(axis=0, dtype=np.float64) for p in parts) / len(x)
    scales = np.maximum(np.sqrt(sum(((x[p] - means) ** 2).sum(axis=0) for p in parts) / len(x)), 1e-3)
    w = np.zeros(k + 1)
    penalty = np.r_[np.full(len(COUNTS), ridge), np.full(BUCKETS, word_ridge), 1e-6]
    for _ in range(rounds):
        slope, curve = -penalty * w, np.diag(penalty)
        for part in parts:
            z = np.c_[np.clip((x[part] - means) / scales, -4, 4), np.ones(len(x[part]))]
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            slope += z.T @ (y[part] - p)
            curve += (z * (p * (1 - p))[:, None]).T @ z
        step = np.linalg.solve(curve, slope)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return Model(w, means, scales)


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    only(_BUCKET_OF)
    for batch in batches:
        rows = [features(t.as_py()).astype(np.float16).tobytes() for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], names=["labelled", "y", "x"])


def _logit_batches(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    only(_BUCKET_OF)
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            x = np.array([features(t.as_py()) for t in part.column(4)]).astype(np.float16).astype(np.float64)
            yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(np.round(model.logits(x), 9))], names=["id", "k", "host", "path", "logit"])


def with_sites(docs: DataFrame, url: str = "url", host: str = "host", path: str = "path") -> DataFrame:
    """Adds the site of each row's address: the host without "www." in lower case, and the first part of the path; empty if there is none."""
    at = F.coalesce(F.col(url), F.lit(""))
    found = F.regexp_extract(at, r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return docs.withColumns({host: F.regexp_replace(F.lower(found), r"^www\.", ""), path: F.regexp_extract(at, r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//[^/?#]*/([^/?#]*)", 1)})


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(sites: DataFrame, mean: float) -> float:
    """Prior strength (pseudo-documents) by moments: how far the sites' means spread beyond what their sizes explain."""
    row = sites.where("n > 1").agg(F.count("*").alias("k"), F.avg(F.pow(F.col("s") / F.col("n") - F.lit(mean), 2)).alias("spread"), F.avg(1 / F.col("n")).alias("inverse")).first()
    if not row["k"]:
        return 1000.0
    noise = mean * (1 - mean)
    between = max(row["spread"] - noise * row["inverse"], noise / 1000.0)
    return min(max(noise / between - 1, 1.0), 1000.0)


def _judged(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, host: str, path: str, label: str, label_id: str, sample: int, site_weight: float, threshold: float) -> DataFrame:
    site = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    slim = docs.select(F.col(doc_id).alias("id"), row_key(doc_id, text).alias("k"), site(host).alias("host"), site(path).alias("path"), F.col(text).alias("t"))
    chosen = labels.select(F.col(label_id).alias("labelled"), F.col(label).cast("double").alias("y")).where("labelled IS NOT NULL AND y IS NOT NULL").groupBy("labelled").agg(F.max("y").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("labelled"), "labelled").limit(sample)
    texts = slim.join(F.broadcast(chosen), F.col("id") == F.col("labelled"))  # `sample` rows at most
    one = texts.select("labelled", "y", "t").mapInArrow(_feature_batches, f"labelled {slim.schema['id'].dataType.simpleString()}, y double, x binary").groupBy("labelled").agg(F.min("y").alias("y"), F.min("x").alias("x"))
    got = one.select(F.col("labelled").cast("string").alias("labelled"), "y", "x").toArrow()  # `sample` rows of a KB
    order = np.argsort(np.array(got.column("labelled").to_pylist(), dtype=object), kind="stable")
    x = np.frombuffer(b"".join(v.as_buffer() for chunk in got.column("x").chunks for v in chunk), dtype=np.float16).reshape(-1, len(COUNTS) + BUCKETS)[order]
    y = (got.column("y").to_numpy() > 0)[order].astype(np.float64)
    del got
    model = fit(x, y)

    schema = f"id {slim.schema['id'].dataType.simpleString()}, k binary, host string, path string, logit double"
    scored = durable(slim.mapInArrow(lambda b: _logit_batches(b, model), schema).withColumn("p", 1 / (1 + F.exp(-F.col("logit")))))
    paths = durable(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    whole = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.count("*").alias("k")).first()
    overall = min(max((whole["s"] or 0.0) / max(whole["n"] or 0, 1), 1e-3), 1 - 1e-3)
    by_host, by_path = _strength(hosts, overall), _strength(paths, overall)
    shrunk = hosts.select(F.col("host").alias("h"), ((F.lit(by_host * overall) + F.col("s")) / (F.lit(by_host) + F.col("n"))).alias("p_host"))
    sites = paths.join(shrunk, F.col("host") == F.col("h")).select(F.col("host").alias("_host"), F.col("path").alias("_path"), "n", "s", "p_host")
    joined = scored.join(broadcast_if_small(sites, whole["k"]), (F.col("host") == F.col("_host")) & (F.col("path") == F.col("_path")))
    p_path = (F.lit(by_path) * F.col("p_host") + F.col("s") - F.col("p")) / (F.lit(by_path) + F.col("n") - 1)
    bounded = F.least(F.greatest(p_path, F.lit(1e-3)), F.lit(1 - 1e-3))
    quality = 1 / (1 + F.exp(-(F.col("logit") + F.lit(site_weight) * (_logit(bounded) - F.lit(float(np.log(overall / (1 - overall))))))))
    out = joined.select("id", "k", F.round("p", 6).alias("p_document"), F.round("p_host", 6).alias("p_host"), F.round(bounded, 6).alias("p_path"), F.round(quality, 6).alias("quality"))
    return out.withColumn("keep", F.col("quality") >= F.lit(threshold))


def score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang", label: str = "quality", label_id: str = "doc_id", sample: int = 20_000, site_weight: float = 0.5, threshold: float = 0.5) -> DataFrame:
    """doc_id, p_document, p_host, p_path, quality and keep of each row of docs.

    p_document: logistic regression on counts and hashed words of the whole text, fitted on at most `sample` labelled rows
    (the first ones by a hash of the id). p_host: the mean of p_document over the host's rows, shrunk toward the mean of
    all. p_path: that of the host and path, without the row itself, shrunk toward p_host. How strongly is estimated from
    the spread between sites. quality: p_document's log odds plus `site_weight` times how far p_path's differ from those
    of all rows. An id labelled twice counts by its larger label. keep: quality of `threshold` at least. Where rows have an
    address, with_sites() gives their host and path.

    Sites are aggregated before the shuffle, so a host with any share of the rows is a row for each task. A null text is
    empty; a null host or path is a site named by the empty string; null and repeated ids are rows like any other. Without labels of
    both classes p_document is 0.5 for all. An empty table gives no rows. Other columns are not carried.
    """
    judged = _judged(docs, labels, doc_id, text, host, path, label, label_id, sample, site_weight, threshold)
    return judged.select(F.col("id").alias("doc_id"), "p_document", "p_host", "p_path", "quality", "keep")


def accepted(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang", label: str = "quality", label_id: str = "doc_id", sample: int = 20_000, site_weight: float = 0.5, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score() keeps, with all their columns. Every row is judged by itself, whatever its id; rows
    that agree in id, text, host and path share their fate. Rows with null ids or texts are judged too."""
    judged = _judged(docs, labels, doc_id, text, host, path, label, label_id, sample, site_weight, threshold)
    rejected = durable(judged.groupBy(F.col("k").alias("_k")).agg(F.max("keep").alias("keep")).where("NOT keep").select("_k"))
    (k,) = fresh(docs.columns, "_row_key")
    return docs.withColumn(k, row_key(doc_id, text)).join(broadcast_if_small(rejected.withColumnRenamed("_k", f"{k}_"), rejected.count()), F.col(k) == F.col(f"{k}_"), "left_anti").select(docs.columns)
