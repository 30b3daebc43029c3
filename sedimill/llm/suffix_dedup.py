"""Removal of repeated passages by prefix doubling on a sampled suffix array.

A byte is removed when a ``threshold``-byte string that also starts elsewhere covers
it. Ranks of substrings grow by doubling: a rank of length 2L is made of the pair of
ranks at p and p + L. Inside a document (lengths 1 to 64) ranks are computed in numpy;
across documents Spark compares them, and whatever is unique drops out, in two rounds:

* length 64, at anchors only: of each window of ``threshold`` bytes the smallest rank
  of length 64 is an anchor, so a string that repeats has its anchor repeated. An
  anchor's surroundings (all windows that can have it) are compared along with it.
* length ``threshold``, at each position of the windows whose anchor repeats in other
  surroundings; one copy of each repeated surroundings takes part for comparison.

Ranks are names of their content rather than ordinals: only equality is asked for, and
names need no global numbering. Surroundings have 128 bits (rank and name), strings of
``threshold`` bytes 96, of two independent functions: of 1e13 strings, two different ones
fall together with a chance of less than 0.001. A group of equal ranks is never gathered:
Spark counts it (with map-side combination) and reports only the members of groups
of one. Rows are names and positions; texts move once for each round, compressed.

Defined results: a null text is empty; a text shorter than ``threshold`` keeps all its
bytes and takes part in nothing; equal texts (repeated rows) of at least ``threshold``
bytes are removed whole; matches never cross documents; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimill.functions.durable import written

from .textnp import BYTE_CODES, U64, flat, mix, powers, tuned

SEED = 64
#: Bytes of text whose ranks are held at once; one longer document is handled alone.
BLOCK = 400_000
_LOW = (1 << 24) - 1
_MULT = U64(0xC2B2AE3D27D4EB4F)
#: Another function of a string, for the further 32 bits of its name.
_MORE, _MORE_CODES = U64(0x8CB92BA72F3D8DD7), mix(BYTE_CODES)


def identity(text: bytes) -> tuple[int, int]:
    """88 bits that name a text: a 64-bit id and a 24-bit check."""
    x = xxhash.xxh3_128_intdigest(text)
    uid = x >> 64
    return uid - (1 << 64) if uid >> 63 else uid, x & _LOW


def _pair(a: np.ndarray, b: np.ndarray, mult: np.uint64) -> np.ndarray:
    x = a * mult + b
    return (x ^ (x >> U64(29))) * U64(0x9E3779B97F4A7C15)


def ranks(data: np.ndarray, length: int, mult: np.uint64 = _MULT, codes: np.ndarray = BYTE_CODES) -> np.ndarray:
    """Names of all substrings of ``length`` bytes, by doubling (the last step overlaps)."""
    r, have = codes[data], 1
    while have < length:
        step = min(have, length - have)
        r = _pair(r[: len(r) - step], r[step:], mult)
        have += step
    return r


def joined(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    at = np.concatenate([[0], np.cumsum([len(x) for x in data], dtype=np.int64)])
    return np.frombuffer(b"".join(data), np.uint8), at


class Windows:
    """The anchors of a block of documents and the windows that have them.

    doc, at: each anchor's document and place in the block; first, last: the starts of its windows.
    """

    def __init__(self, data: np.ndarray, at: np.ndarray, threshold: int):
        self.data, self.at, self.threshold = data, at, threshold
        n, span = len(data), threshold - SEED + 1
        empty = np.zeros(0, np.int64)
        self.doc = self.place = self.first = self.last = self.ordinal = empty
        self.final = np.zeros(0, bool)
        self.rank = np.zeros(0, U64)
        if n < threshold:
            return
        rank = ranks(data, SEED)
        low = (rank & ~U64(_LOW)) | (np.arange(len(rank), dtype=U64) & U64(_LOW))
        have = 1
        while have < span:
            step = min(have, span - have)
            low = np.minimum(low[: len(low) - step], low[step:])
            have += step
        room = np.repeat(at[1:], np.diff(at))[: len(low)] - np.arange(len(low))
        p = np.flatnonzero(room >= threshold)
        if not len(p):
            return
        place = p + ((low[p].astype(np.int64) - p) & _LOW)
        new = np.ones(len(p), bool)
        new[1:] = (place[1:] != place[:-1]) | (p[1:] != p[:-1] + 1)
        edge = np.flatnonzero(new)
        self.place, self.first = place[edge], p[edge]
        self.last = np.concatenate([p[edge[1:] - 1], p[-1:]])
        self.doc = np.searchsorted(at, self.place, "right") - 1
        begin = np.ones(len(edge), bool)
        begin[1:] = self.doc[1:] != self.doc[:-1]
        start = np.flatnonzero(begin)
        self.ordinal = np.arange(len(edge)) - np.repeat(start, np.diff(np.append(start, len(edge))))
        self.final = np.append(begin[1:], True)
        self.rank = rank[self.place]

    def surroundings(self) -> np.ndarray:
        """A name of all that the windows of an anchor can hold, cut at the document's ends."""
        a = np.maximum(self.place - (self.threshold - SEED), self.at[self.doc])
        b = np.minimum(self.place + self.threshold, self.at[self.doc + 1])
        p, inverse = powers(len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, U64)
        np.cumsum(BYTE_CODES[self.data] * p[:-1], out=total[1:])
        return mix((total[b] - total[a]) * inverse[a] + (b - a).astype(U64) * _MULT + (self.place - a).astype(U64) * U64(0x165667B19E3779F9))


def _grouped(sizes: list[int]) -> Iterator[tuple[int, int]]:
    lo, total = 0, 0
    for i, s in enumerate(sizes):
        if i > lo and total + s > BLOCK:
            yield lo, i
            lo, total = i, 0
        total += s
    if lo < len(sizes):
        yield lo, len(sizes)


def described(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """doc_id, n_bytes, uid, check and the digest of each text."""

    def run(batches):
        for batch in batches:
            data, at = flat(batch.column(1))
            raw = data.tobytes()
            texts = [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
            ids = [identity(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(at)), pa.array([i[0] for i in ids], pa.int64()), pa.array([i[1] for i in ids], pa.int32()), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())],
                ["doc_id", "n_bytes", "uid", "check", "sha"],
            )

    kind = dict(docs.dtypes)[doc_id]
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, uid long, check int, sha string")


def _fresh(batch: pa.RecordBatch, threshold: int, seen: set) -> tuple[list[bytes], list[tuple[int, int]]]:
    data, at = flat(batch.column(0))
    texts, ids = [], []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= threshold:
            t = data[a:b].tobytes()
            x = identity(t)
            if x not in seen:
                seen.add(x)
                texts.append(t)
                ids.append(x)
    return texts, ids


def packed(docs: DataFrame, threshold: int, text: str) -> DataFrame:
    """uid, check and the compressed text; copies in one task come once."""

    def run(batches):
        seen: set = set()
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            texts, ids = _fresh(batch, threshold, seen)
            yield pa.RecordBatch.from_arrays([pa.array([i[0] for i in ids], pa.int64()), pa.array([i[1] for i in ids], pa.int32()), pa.array([pack.compress(t) for t in texts], pa.binary())], ["uid", "check", "packed"])

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "uid long, check int, packed binary")


def anchors(docs: DataFrame, threshold: int, text: str) -> DataFrame:
    """rank, around, uid, spot of all anchors; spot = ordinal * 2 + final, then 24 bits of check."""

    def run(batches):
        seen: set = set()
        for batch in batches:
            texts, ids = _fresh(batch, threshold, seen)
            uid, check = (np.array([i[k] for i in ids], np.int64) for k in (0, 1))
            for lo, hi in _grouped([len(t) for t in texts]):
                w = Windows(*joined(texts[lo:hi]), threshold)
                if len(w.doc):
                    own = w.doc + lo
                    spot = ((w.ordinal * 2 + w.final) << 24) | check[own]
                    yield pa.RecordBatch.from_arrays([pa.array(w.rank.view(np.int64)), pa.array(w.surroundings().view(np.int64)), pa.array(uid[own]), pa.array(spot)], ["rank", "around", "uid", "spot"])

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "rank long, around long, uid long, spot long")


#: What Spark found out about an anchor: its surroundings are unique; they aren't, and this is one copy; its rank is found in these surroundings only.
UNIQUE, ONE, ALONE = 0, 1, 2


def _undone(texts: list[bytes], codes: list[np.ndarray], threshold: int) -> Iterator[tuple[int, int, Windows, np.ndarray]]:
    """Blocks of documents and the state of their anchors: bit UNIQUE, ONE, ALONE."""
    for lo, hi in _grouped([len(t) for t in texts]):
        w = Windows(*joined(texts[lo:hi]), threshold)
        first = np.searchsorted(w.doc, np.arange(hi - lo))
        state = np.zeros(len(w.doc), np.int64)
        for d in range(lo, hi):
            np.bitwise_or.at(state, first[d - lo] + (codes[d] >> 3), 1 << (codes[d] & 3))
        yield lo, hi, w, state


def _documents(batch: pa.RecordBatch, seen: set, extra: int = 0):
    """Documents of a joined batch with an anchor that isn't unique: ids, texts, codes (and a further list)."""
    unpack = zstandard.ZstdDecompressor()
    ids, texts, codes, more = [], [], [], []
    for i in range(batch.num_rows):
        key = (batch.column(0)[i].as_py(), batch.column(1)[i].as_py())
        found = np.array(batch.column(3)[i].values.to_numpy(zero_copy_only=False), np.int64)
        if key in seen:
            continue
        seen.add(key)
        end = found[(found & 4) > 0]
        if len(end):  # all anchors unique and alone: nothing repeats
            n = int(end[0] >> 3) + 1
            kind = found & 3
            if (kind == UNIQUE).sum() == n and (kind == ALONE).sum() == n:
                continue
        ids.append(key)
        texts.append(unpack.decompress(batch.column(2)[i].as_py()))
        codes.append(found)
        if extra:
            x = batch.column(4)[i]
            more.append(np.array(x.values.to_numpy(zero_copy_only=False), np.int64) if x.is_valid else np.zeros(0, np.int64))
    return ids, texts, codes, more


def _positions(threshold: int):
    """Rows of round two: rank and more (a string's name), uid, spot = position and check."""

    def run(batches):
        seen: set = set()
        for batch in batches:
            ids, texts, codes, _ = _documents(batch, seen)
            for lo, hi, w, state in _undone(texts, codes, threshold):
                pick = np.flatnonzero(((state & (1 << UNIQUE | 1 << ONE)) > 0) & ((state & (1 << ALONE)) == 0))
                if not len(pick):
                    continue
                n = w.last[pick] - w.first[pick] + 1
                p = np.arange(n.sum()) + np.repeat(w.first[pick] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
                rank = ranks(w.data, threshold)[p]
                more = (ranks(w.data, threshold, _MORE, _MORE_CODES)[p] >> U64(32)).astype(np.uint32).view(np.int32)
                own = np.repeat(w.doc[pick], n)
                uid, check = (np.array([i[k] for i in ids[lo:hi]], np.int64)[own] for k in (0, 1))
                spot = ((p - w.at[own]) << 24) | check
                for a in range(0, len(p), 200_000):
                    b = a + 200_000
                    yield pa.RecordBatch.from_arrays([pa.array(rank[a:b].view(np.int64)), pa.array(more[a:b]), pa.array(uid[a:b]), pa.array(spot[a:b])], ["rank", "more", "uid", "spot"])

    return run


def _runs(w: Windows, pick: np.ndarray) -> np.ndarray:
    """Whether each place of the block starts a window of a picked anchor."""
    edge = np.zeros(len(w.data) + 1, np.int32)
    np.add.at(edge, w.first[pick], 1)
    np.add.at(edge, w.last[pick] + 1, -1)
    return np.cumsum(edge[:-1]) > 0


def _removals(threshold: int):
    """The outcome for each text with a repeat: uid, check, n_removed, n_spans, sha."""

    def run(batches):
        seen: set = set()
        for batch in batches:
            ids, texts, codes, single = _documents(batch, seen, 1)
            rows = []
            for lo, hi, w, state in _undone(texts, codes, threshold):
                unique = (state & (1 << UNIQUE)) > 0
                open_ = _runs(w, unique & ((state & (1 << ALONE)) == 0))
                for d in range(lo, hi):
                    open_[single[d] + w.at[d - lo]] = False
                starts = _runs(w, ~unique) | open_
                s = np.flatnonzero(starts)
                cover = np.zeros(len(w.data) + 1, np.int32)
                np.add.at(cover, s, 1)
                np.add.at(cover, s + threshold, -1)
                gone = np.cumsum(cover[:-1]) > 0
                for d in range(lo, hi):
                    a, b = w.at[d - lo], w.at[d - lo + 1]
                    own = gone[a:b]
                    spans = int(own[0]) + int((own[1:] & ~own[:-1]).sum())
                    kept = hashlib.sha256(w.data[a:b][~own].tobytes()).hexdigest()
                    rows.append((*ids[d], int(own.sum()), spans, kept))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["uid", "check", "n_removed", "n_spans", "sha2"])

    return run


def repeats_removed(docs: DataFrame, threshold: int = 200, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    if threshold < SEED + 1:
        raise ValueError(f"threshold must be above {SEED}")
    spark = docs.sparkSession
    tuned(spark)
    count = F.count(F.lit(1))
    key = ["uid", "check"]
    check = (F.col("spot") % (1 << 24)).cast("int").alias("check")
    spot = F.shiftright("spot", 24)
    rows = anchors(docs, threshold, text)
    around = rows.groupBy("rank", "around").agg(count.alias("n"), F.first("uid").alias("uid"), F.first("spot").alias("spot"))
    # n is asked for here as well, as both uses of the groups then read one exchange
    alone = around.groupBy("rank").agg(count.alias("m"), F.first("uid").alias("uid"), F.first("spot").alias("spot"), F.max("n").alias("n")).where("m = 1 AND n > 0")
    # codes: ordinal, final, kind
    told = around.select("uid", check, (spot * 4 + F.when(F.col("n") == 1, UNIQUE).otherwise(ONE)).alias("code")).union(
        alone.select("uid", check, (spot * 4 + ALONE).alias("code"))
    )
    told = written(told.groupBy(*key).agg(F.collect_list("code").alias("codes")), "anchors")  # a document's anchors
    # one exchange of the texts serves both rounds that look into them again
    both = packed(docs, threshold, text).hint("merge").join(told, key).select(*key, "packed", "codes")
    single = (
        both.mapInArrow(_positions(threshold), "rank long, more int, uid long, spot long")
        .groupBy("rank", "more").agg(count.alias("n"), F.first("uid").alias("uid"), F.first("spot").alias("spot")).where("n = 1")
        .select("uid", check, spot.alias("position")).groupBy(*key).agg(F.collect_list("position").alias("single"))
    )
    found = both.join(single, key, "left").select(*key, "packed", "codes", "single").mapInArrow(_removals(threshold), "uid long, check int, n_removed long, n_spans long, sha2 string")
    light = described(docs, text, doc_id)
    copies = light.where(F.col("n_bytes") >= threshold).groupBy(*key).agg(count.alias("n")).where("n > 1").select(*key, F.lit(True).alias("copied"))
    outcome = written(
        found.withColumn("copied", F.lit(None).cast("boolean")).unionByName(copies, allowMissingColumns=True)
        .groupBy(*key).agg(F.max("n_removed").alias("n_removed"), F.max("n_spans").alias("n_spans"), F.max("sha2").alias("sha2"), F.max("copied").alias("copied")),
        "outcome",
    )
    nothing = hashlib.sha256(b"").hexdigest()
    out = light.join(outcome, key, "left")
    return out.select(
        "doc_id", "n_bytes",
        F.when(F.col("copied"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copied"), 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(F.col("copied"), F.lit(nothing)).otherwise(F.coalesce("sha2", "sha")).alias("kept_sha256"),
    )
