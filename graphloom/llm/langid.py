"""Language identification by a byte convolutional network, trained in numpy."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import held_out, lean, pieces, table

WINDOW, WIDTHS, FILTERS = 192, (2, 3, 4), 16


@dataclass
class Network:
    """One-hot bytes -> filters of several widths -> largest response of each filter -> softmax.

    kernels[w] is (w, 256, FILTERS): the weight of each byte at each place of a filter. Byte 0 fills short windows and
    has weight 0, so it never adds to a response.
    """

    labels: list[str]
    kernels: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def fresh(cls, labels: list[str], seed: int) -> Network:
        rng = np.random.default_rng(seed)
        kernels = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        for k in kernels:
            k[:, 0] = 0
        out = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(labels))).astype(np.float32)
        return cls(labels, kernels, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], out, np.zeros(len(labels), np.float32))

    def responses(self, x: np.ndarray, pairs=None) -> tuple[np.ndarray, np.ndarray]:
        """(windows, all filters) largest responses, and where each of them starts. ``pairs``: see ``paired``."""
        best, at = [], []
        two = x[:, :-1].astype(np.int64) << 8 | x[:, 1:] if pairs else None
        for k, w in enumerate(WIDTHS):
            n = x.shape[1] - w + 1
            r = np.zeros((len(x), n, FILTERS), np.float32)
            j = 0
            while j < w:
                if pairs and j + 1 < w:
                    r += np.take(pairs[k][j // 2], two[:, j : j + n], axis=0)
                    j += 2
                else:
                    r += np.take(self.kernels[k][j], x[:, j : j + n], axis=0)
                    j += 1
            if pairs is None:
                i = r.argmax(1)
                at.append(i)
                best.append(np.take_along_axis(r, i[:, None], 1)[:, 0] + self.bias[k])
            else:
                best.append(r.max(1) + self.bias[k])
        return np.maximum(np.concatenate(best, 1), 0), np.concatenate(at, 1) if at else None

    def paired(self) -> list[list[np.ndarray]]:
        """The kernels summed over every two bytes, to take half as many steps."""
        return [[(k[j][:, None] + k[j + 1][None]).reshape(1 << 16, FILTERS) for j in range(0, len(k) - 1, 2)] for k in self.kernels]

    def log_softmax(self, h: np.ndarray) -> np.ndarray:
        z = (h @ self.out + self.out_bias).astype(np.float64)
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))


def windows(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Every text cut into windows of WINDOW bytes, the last filled with 0: (windows, text of each). A-Z in lower case."""
    data = pc.ascii_lower(texts).cast(pa.large_binary())
    raw = [b.as_buffer() if b.is_valid else b"" for b in data]
    sizes = np.fromiter((len(memoryview(b)) for b in raw), np.int64, len(raw))
    counts = -(-sizes // WINDOW)
    out = np.zeros((int(counts.sum()), WINDOW), np.uint8)
    flat, at = out.reshape(-1), 0
    for b, n, c in zip(raw, sizes.tolist(), counts.tolist()):
        flat[at : at + n] = np.frombuffer(b, np.uint8)
        at += c * WINDOW
    return out, np.repeat(np.arange(len(raw)), counts)


def train(x: np.ndarray, y: np.ndarray, labels: list[str], epochs: int = 6, rate: float = 0.02, batch: int = 256, seed: int = 5) -> Network:
    """Adam on the cross entropy; rare labels weigh more. The gradient of a filter touches only where it responds most."""
    net = Network.fresh(labels, seed)
    rng = np.random.default_rng(seed)
    weight = len(y) / np.maximum(1, np.bincount(y, minlength=len(labels))) / len(labels)
    params = [*net.kernels, *net.bias, net.out, net.out_bias]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(x), batch):
            rows = order[i : i + batch]
            xb, yb = x[rows], y[rows]
            h, at = net.responses(xb)
            p = np.exp(net.log_softmax(h))
            p[np.arange(len(yb)), yb] -= 1
            g = (p * weight[yb][:, None] / len(yb)).astype(np.float32)
            gh = (g @ net.out.T) * (h > 0)
            grads = []
            for k, w in enumerate(WIDTHS):
                own, gk = slice(k * FILTERS, (k + 1) * FILTERS), np.zeros_like(net.kernels[k])
                for j in range(w):
                    byte = np.take_along_axis(xb, at[:, own] + j, 1)
                    np.add.at(gk[j], (byte, np.arange(FILTERS)[None]), gh[:, own])
                gk[:, 0] = 0
                grads.append(gk)
            grads += [gh[:, k * FILTERS : (k + 1) * FILTERS].sum(0) for k in range(len(WIDTHS))] + [h.T @ g, g.sum(0)]
            step += 1
            for q, d, (m, v) in zip(params, grads, moments):
                m += 0.1 * (d - m)
                v += 0.001 * (d * d - v)
                q -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)
            for k in net.kernels:
                k[:, 0] = 0
    return net


def sample_windows(labelled: DataFrame, per_label: int, per_text: int, seed: int, max_labels: int = 1000) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """A bounded sample of windows: of each label the ``per_label`` texts of the smallest hashes of id and text (repeated
    rows are one), and ``per_text`` windows from all over each. Only those windows come to the driver. More than
    ``max_labels`` labels are an error."""
    found = labelled.groupBy("lang").agg(F.count("*").alias("n")).limit(max_labels + 1).collect()
    counts = {r["lang"]: r["n"] for r in found}
    if len(counts) > max_labels:
        raise ValueError(f"more than {max_labels} labels")
    if not counts:
        return np.zeros((0, WINDOW), np.uint8), np.zeros(0, np.int64), []
    spare = 1 + 8 / math.sqrt(per_label)  # so that a label hardly ever has fewer rows below its rate than are wanted
    rates = labelled.sparkSession.createDataFrame([(k, int(min(1.0, spare * per_label / n) * (1 << 30))) for k, n in counts.items()], "lang string, rate long")
    hashed = labelled.withColumn("hash", F.xxhash64(F.lit(seed), "doc_id", F.xxhash64("text")))
    low = hashed.join(F.broadcast(rates), "lang").filter(F.pmod("hash", F.lit(1 << 30)) < F.col("rate")).dropDuplicates(["lang", "hash"])
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("hash", F.lit(1 << 30)), "hash"))
    chosen = low.withColumn("nth", nth).filter(F.col("nth") <= per_label)

    def cut(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                x, of = windows(part.column(2))
                lang, keep = part.column(0).to_pylist(), []
                for i in range(part.num_rows):
                    own = np.flatnonzero(of == i)
                    keep.append(np.random.default_rng([seed, (part.column(1)[i].as_py() or 0) & 0xFFFFFFFF]).permutation(own)[:per_text])
                keep = np.concatenate(keep) if keep else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang[of[i]] for i in keep.tolist()], pa.string()), pa.array([x[i].tobytes() for i in keep.tolist()], pa.binary())], ["lang", "bytes"])

    rows = chosen.select("lang", "doc_id", "text").mapInArrow(lean(cut), "lang string, bytes binary").collect()
    labels = sorted(counts)
    rows.sort(key=lambda r: (r["lang"], bytes(r["bytes"])))
    x = np.frombuffer(b"".join(bytes(r["bytes"]) for r in rows), np.uint8).reshape(-1, WINDOW)
    y = np.asarray([labels.index(r["lang"]) for r in rows], np.int64)
    short = np.random.default_rng(seed).random(len(x)) < 0.25  # some windows are cut short, as the ends of texts are
    x = x.copy()
    x[short, 48:] = 0
    return x, y, labels


def fit(docs: DataFrame, per_label: int = 1000, per_text: int = 4, seed: int = 11, **options) -> Network | None:
    """A network from the texts and non-null lang of ``docs`` (doc_id, text, lang); None if nothing is labelled.

    The sample is bounded: ``per_label`` texts of each label at most, and ``per_text`` windows of each (``sample_windows``).
    All labels are learnt; more than 1,000 are an error.
    """
    labelled = docs.filter(F.col("lang").isNotNull() & (F.length("text") > 0)).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    x, y, labels = sample_windows(labelled, per_label, per_text, seed)
    return train(x, y, labels, seed=seed, **options) if len(x) else None


def identify(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, lang_pred, score of every whole text: all its windows are read, and their log probabilities, weighed by
    their bytes, are averaged. Null text, text without any letter, and all texts if ``net`` is None: und with score 0.
    Repeated rows stay, an empty table gives an empty result, other columns are ignored."""

    def run(batches):
        pairs = net.paired() if net else None
        for batch in batches:
            for part in pieces(batch, "text"):
                texts = part.column(1)
                known = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
                pred, score = np.full(len(texts), "und", object), np.zeros(len(texts))
                if net and known.any():
                    x, of = windows(texts)
                    total, weight = np.zeros((len(texts), len(net.labels))), np.zeros(len(texts))
                    for i in range(0, len(x), 64):
                        size = (x[i : i + 64] > 0).sum(1).astype(float)
                        logp = net.log_softmax(net.responses(x[i : i + 64], pairs)[0]) * size[:, None]
                        np.add.at(total, of[i : i + 64], logp)
                        np.add.at(weight, of[i : i + 64], size)
                    mean = total / np.maximum(weight, 1)[:, None]
                    p = np.exp(mean - mean.max(1, keepdims=True))
                    p /= p.sum(1, keepdims=True)
                    best = p.argmax(1)
                    pred[known] = np.asarray(net.labels, object)[best[known]]
                    score[known] = p[np.arange(len(p)), best][known]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(pred.tolist(), pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "doc_id bigint, lang_pred string, score double")


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, learnt from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit(docs.filter(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
