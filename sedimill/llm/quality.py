"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are computed in numpy for whole blocks of documents. The trees are grown
on the driver from a bounded sample of labelled rows (``sample``, a parameter) and
flattened into arrays, which every task traverses for all its rows at once.

Defined results: a null or empty text has all-zero statistics and gets a score like
any other; labels that are null are skipped, several labels of a document count by
their mean; without labels of both kinds the score is the share of label 1 (0.5
without any label); repeated rows are scored alike; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textnp import BYTE_CODES, U64, blocks, flat, lean, mix, tuned, word_codes, words

#: Labelled rows that are learned from, at most.
SAMPLE = 20_000
#: Byte classes: 0 rest, 1 lower case, 2 upper case, 3 digits, 4 space, 5 line feed, 6 sentence end, 7 comma and the like,
#: 8 pipe, 9 brackets and quotes, 10 symbols, 11 bytes of other letters, 12 control bytes, 13 exclamation mark
CLASSES = np.zeros(256, np.int64)
for _chars, _class in (("abcdefghijklmnopqrstuvwxyz", 1), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), ("0123456789", 3), (" \t", 4), ("\n\r", 5), (".?", 6), (",;:-'", 7), ("|", 8), ("()[]{}<>\"`", 9), ("#$%&*+/=@\\^_~", 10), ("!", 13)):
    CLASSES[[ord(c) for c in _chars]] = _class
CLASSES[128:] = 11
CLASSES[[*range(9), *range(14, 32), 127]] = 12
N_FEATURES = 28


def _runs(codes: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes and the most frequent one's count, for each document."""
    at = np.concatenate([[0], np.cumsum(count)])
    codes = codes.copy()
    for a, b in zip(at[:-1], at[1:], strict=True):
        codes[a:b].sort()
    new = np.ones(len(codes) + 1, bool)
    new[1:-1] = codes[1:] != codes[:-1]
    new[at] = True
    edge = np.flatnonzero(new)
    length = np.diff(edge)
    doc = np.searchsorted(at, edge[:-1], "right") - 1
    most = np.zeros(len(count), np.int64)
    np.maximum.at(most, doc, length)
    return np.bincount(doc, minlength=len(count)), most


def statistics(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of N_FEATURES numbers for each document of a block."""
    n = len(at) - 1
    size = np.diff(at).astype(float)
    per = np.maximum(size, 1)
    own = np.repeat(np.arange(n), np.diff(at))
    kinds = np.bincount(own * 16 + CLASSES[data], minlength=n * 16).reshape(n, 16).astype(float)
    starts, ends, count = words(data, at)
    code = word_codes(data, starts, ends, BYTE_CODES)
    doc = np.repeat(np.arange(n), count)
    length = (ends - starts).astype(float)
    many = np.maximum(count, 1)
    mean = np.bincount(doc, length, n) / many
    spread = np.sqrt(np.maximum(np.bincount(doc, length * length, n) / many - mean * mean, 0))
    distinct, most = _runs(code, count)
    pair = mix(code[:-1] * U64(0xD6E8FEB86659FD93) + code[1:]) if len(code) > 1 else code[:0]
    inner = doc[1:] == doc[:-1]
    pairs = np.bincount(doc[1:][inner], minlength=n)
    pair_distinct, pair_most = _runs(pair[inner], pairs)
    same = np.bincount(doc[1:][inner & (code[1:] == code[:-1])], minlength=n) if len(code) > 1 else np.zeros(n)
    ends_kind = CLASSES[data[ends - 1]] if len(ends) else np.zeros(0, np.int64)
    starts_kind = CLASSES[data[starts]] if len(starts) else np.zeros(0, np.int64)
    one = np.bincount(doc[length == 1], minlength=n)
    alone = np.bincount(doc[(length == 1) & ~np.isin(starts_kind, (1, 2, 11))], minlength=n) if len(doc) else np.zeros(n)
    log = np.log1p
    cols = [
        log(size), log(count), mean, spread, log(size / (kinds[:, 5] + 1)),
        *(kinds[:, k] / per for k in (1, 2, 3, 4, 6, 7, 8, 9, 10, 11, 12, 13)),
        distinct / many, most / many, pair_distinct / np.maximum(pairs, 1), pair_most / np.maximum(pairs, 1), same / many,
        np.bincount(doc[ends_kind == 10], minlength=n) / many, np.bincount(doc[ends_kind == 6], minlength=n) / many,
        np.bincount(doc[starts_kind == 2], minlength=n) / many, one / many, alone / many,
        np.bincount(doc[length > 20], minlength=n) / many,
    ]
    return np.stack(cols, 1).astype(np.float32)


@dataclass(frozen=True)
class Trees:
    """Complete trees in arrays: node i has the children 2i+1 and 2i+2."""

    start: float
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            total += v[node]
        return 1 / (1 + np.exp(-total))


def boosted(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, penalty: float = 2.0, least: float = 4.0) -> Trees:
    """Gradient boosting on the logistic loss with binned features; the same rows give the same trees."""
    share = float(np.clip(y.mean() if len(y) else 0.5, 0.001, 0.999))
    start = float(np.log(share / (1 - share)))
    inner, nodes = 2**depth - 1, 2 ** (depth + 1) - 1
    if len(y) == 0 or y.min() == y.max():
        none = np.zeros((0, nodes))
        return Trees(start, none.astype(np.int64), none, none, depth)
    width = x.shape[1]
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)])
    raw = np.full(len(y), start)
    feature, cut, value = np.zeros((trees, nodes), np.int64), np.full((trees, nodes), np.inf), np.zeros((trees, nodes))
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, span = 2**level - 1, 2**level
            local = node - first
            best = np.full(span, 1e-6)
            for f in range(width):
                key = local * bins + binned[f]
                gl = np.bincount(key, g, span * bins).reshape(span, bins).cumsum(1)
                hl = np.bincount(key, h, span * bins).reshape(span, bins).cumsum(1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                gain = gl**2 / (hl + penalty) + (gt - gl) ** 2 / (ht - hl + penalty) - gt**2 / (ht + penalty)
                gain[(hl < least) | (ht - hl < least)] = 0
                gain = gain[:, : len(cuts[f])]
                if gain.shape[1]:
                    at = gain.argmax(1)
                    top = gain[np.arange(span), at]
                    won = top > best
                    best = np.where(won, top, best)
                    feature[t, first : first + span][won] = f
                    cut[t, first : first + span][won] = cuts[f][at[won]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[t, node]] > cut[t, node])
        gs, hs = np.bincount(node, g, nodes), np.bincount(node, h, nodes)
        value[t] = -rate * gs / (hs + penalty)
        value[t, :inner] = 0
        raw += value[t, node]
    return Trees(start, feature, cut, value, depth)


def _features(batches):
    for batch in batches:
        data, at = flat(batch.column(1))
        x = [statistics(piece, cut) for _, _, piece, cut in blocks(data, at)]
        x = np.concatenate(x) if x else np.zeros((0, N_FEATURES), np.float32)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), N_FEATURES).cast(pa.list_(pa.float32()))], ["doc_id", "x"])


def held_out(doc_id: Column) -> Column:
    """The fold that is never learned from: crc32 of the id as text, modulo 4, is 2. False without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, text: str = "text", doc_id: str = "doc_id", label: str = "quality") -> Trees:
    """Trees from at most ``sample`` labelled documents outside the held-out fold, picked by a hash of the id."""
    picked = (
        labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id)))
        .groupBy(doc_id).agg(F.avg(F.col(label).cast("double")).alias("_y"))
        .orderBy(F.xxhash64(doc_id), doc_id).limit(sample).toPandas()
    )
    spark = docs.sparkSession
    if not len(picked):
        return boosted(np.zeros((0, N_FEATURES)), np.zeros(0))
    kind = dict(docs.dtypes)[doc_id]
    ids = spark.createDataFrame(picked[[doc_id]].drop_duplicates(), f"{doc_id} {kind}")
    # at most ``sample`` ids; of rows that repeat an id, the one with the least text
    rows = docs.select(doc_id, text).join(F.broadcast(ids), doc_id).groupBy(doc_id).agg(F.min(text).alias(text))
    found = rows.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(lean(_features), f"doc_id {kind}, x array<float>").toPandas()
    found = found.merge(picked.rename(columns={doc_id: "doc_id"}), on="doc_id")
    if not len(found):
        return boosted(np.zeros((0, N_FEATURES)), np.zeros(0))
    x = np.stack(found["x"].to_numpy()).astype(np.float32)
    order = np.lexsort([*x.T, found["doc_id"].to_numpy()])
    return boosted(x[order], (found["_y"].to_numpy()[order] >= 0.5).astype(float))


def scored(docs: DataFrame, trees: Trees, threshold: float = 0.7, text: str = "text", score: str = "score", predicted: str = "predicted") -> DataFrame:
    """All columns of ``docs`` with a score (0 to 1) and a prediction (1 if score >= threshold), which replace columns of these names."""
    docs = docs.drop(score, predicted)
    tuned(docs.sparkSession)
    names = docs.columns
    at_text = names.index(text)

    def run(batches):
        for batch in batches:
            data, at = flat(batch.column(at_text))
            s = [trees.score(statistics(piece, cut)) for _, _, piece, cut in blocks(data, at)]
            s = np.concatenate(s) if s else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*(f"c{i}" for i in range(len(names))), "score", "predicted"])

    schema = ", ".join([*(f"c{i} {t}" for i, (_, t) in enumerate(docs.dtypes)), "score double, predicted int"])
    out = docs.toDF(*(f"c{i}" for i in range(len(names)))).mapInArrow(lean(run), schema)
    return out.toDF(*names, score, predicted)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    trees = fitted(docs, labels, sample)
    return scored(docs.select("doc_id", "text"), trees, threshold).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")

