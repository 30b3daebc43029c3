"""N-gram Jaccard self-join by universe partition and pigeonhole.

A document is the set of its distinct k-word shingles. Sizes fall into bands; each
band's scheme deals the shingle universe into m segments by hash. Two sets that
meet the threshold differ in at most H shingles, so of m = H + 1 + spare segments
(or, with one-deletion neighbourhoods, H // 2 + 1 + spare) at least 1 + spare agree
(to within one deletion); the spare ones make up for segments that are empty in a
set. The cheaper allocation by rows and expected verified pairs is taken. Segment
subsets are indexed by a 64-bit key, sets sharing a key are candidates, and
candidates are verified exactly on their shingles.

Sets that share a key are verified against the key's leader only (the set with the
most candidates over all its keys, so mostly one leader for a group of near copies),
as many pairs as the index has rows at most. What a set x differs from its leader p in,
D(x) = x - p and p - x, decides about the pairs not verified. With both sets linked to
p nothing is left to find out. Else |x ^ y| = |D(x)| + |D(y)| - 2 |D(x) & D(y)|, so a link
needs at least (|D(x)| + |D(y)| - H) / 2 >= 1 common members of D, and by the prefix
argument one of them lies in the first |D(x)| - least overlap + 1 members of either in
a fixed order (additions first, as they are rare). Pairs are formed at common
prefix members of sets in different components, if their place leaves room for the overlap
that is needed, whose sketches (the parity of a set's members by hash) differ in no more
bits than linked sets in members, and are verified exactly. No group's pairs are listed, however large it is.

Sets are named by 64 bits and checked by 64 more. Names that several sets share (found
by one aggregation) are told apart by their checks before anything else is done.

Defined results: a null or blank text has an empty set and no link; a text of fewer
than k words is one shingle; equal sets (repeated rows, equal texts) are linked; an
empty table gives an empty result; other columns are ignored, whatever their names.
A null doc_id is linked like any other, but never names a component unless no
member has an id.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sedimill.functions.durable import released, swept, written
from sedimill.functions.graph import connected_components

from .textnp import U64, blocks, flat, lean, mix, shingles, tuned

#: Each band's largest size over its smallest.
BAND = 1.4
#: Index rows that are as dear as verifying a pair.
VERIFY = 50
#: Members of the prefixes of a leader's sets that one task holds, at most.
HELD = 1 << 18
#: Shares of a leader's members that get the sets' sketches along, at most, and pairs whose texts are picked out by a broadcast, at most.
SKETCHED, FEW = 16, 100_000
#: Names that several sets share, at most: of 5e10 sets some 70 do so by chance.
SHARED = 100_000
_SEG, _CHECK = U64(0xA0761D6478BD642F), U64(0xE7037ED1A0B428DB)


@dataclass(frozen=True)
class Scheme:
    """How sets are cut for pairs whose larger set lies in one band."""

    segments: int
    deletions: int  # 1: with one-deletion neighbourhoods
    spare: int


def differ_at_most(total: int, num: int, den: int) -> int:
    """The largest symmetric difference of two sets with ``total`` members in all and Jaccard >= num/den."""
    return total * (den - num) // (den + num)


def _spare(m: int, deletions: int, least: float) -> int:
    """Segments of a set of ``least`` members that hold no more than ``deletions`` of them, nearly always at most."""
    per = least / m
    dead = m * float(np.exp(-per)) * (1 + deletions * per)
    return max(1, int(np.ceil(dead + 3 * np.sqrt(dead))))


def costs(high: int, num: int, den: int, near: float) -> list[tuple[float, Scheme]]:
    """Both allocations for sets of up to ``high`` members, with the cost of a set: its index rows,
    and the chance that a set of three quarters of the threshold's similarity shares a key, for ``near`` such sets."""
    h = differ_at_most(2 * high, num, den)
    similar = 0.75 * num / den
    differ = 2 * high * (1 - similar) / (1 + similar)
    out = []
    for deletions in (0, 1) if h else (0,):
        m = h // (deletions + 1) + 1
        spare = _spare(m, deletions, high / BAND * num / den) if h else 0
        m += spare
        per = high / m
        rows = m * (1 + deletions * per)
        agree = float(np.exp(-differ / m)) * (1 + deletions * differ / m)
        chance = 1 - (1 - min(agree, 1.0)) ** m
        out.append((rows + VERIFY * near * chance, Scheme(m, deletions, spare)))
    return out


@lru_cache(maxsize=None)
def scheme(high: int, num: int, den: int, near: float = 1.0) -> Scheme:
    """The cheaper allocation: exact segment subsets, or fewer and larger segments with their one-deletion neighbourhoods."""
    return min(costs(high, num, den, near), key=lambda c: c[0])[1]


@lru_cache(maxsize=None)
def _edges() -> np.ndarray:
    """The smallest size of each band."""
    low, out = 1, []
    while low < 2**40:
        out.append(low)
        low = max(low + 1, int(low * BAND))
    return np.array(out)


def band_of(size) -> np.ndarray:
    return np.searchsorted(_edges(), size, "right") - 1


def set_ids(h: np.ndarray, at: np.ndarray, apart: frozenset = frozenset(), bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit name and a 64-bit check of each set, the same for equal sets. Names in ``apart`` are changed by the check."""
    n = (at[1:] - at[:-1]).astype(U64) * _SEG
    both = []
    for salt in (_SEG, _CHECK):
        total = np.concatenate([np.zeros(1, U64), np.cumsum(mix(h ^ salt))])
        both.append(mix(total[at[1:]] - total[at[:-1]] + n))
    ids, checks = both[0] >> U64(64 - bits), both[1]
    if apart:
        again = np.isin(ids.view(np.int64), np.array(sorted(apart), np.int64))
        ids[again] = mix(ids[again] * _SEG + checks[again])
    return ids.view(np.int64), checks.view(np.int64)


def keys_of(h: np.ndarray, at: np.ndarray, num: int, den: int, near: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Index keys of all sets in a block: row of the set, and key."""
    size = np.diff(at)
    own = band_of(np.maximum(size, 1))
    top = band_of(np.maximum(size * den // num, 1))
    edges, out = _edges(), []
    token = mix(h * _SEG)
    place = (mix(h ^ U64(0x589965CC75374CC3)) >> U64(32)).astype(np.int64)
    for b in range(int(own[size > 0].min()) if (size > 0).any() else 0, int(top.max(initial=0)) + 1):
        pick = np.flatnonzero((size > 0) & (own <= b) & (b <= top))
        if not len(pick):
            continue
        s = scheme(int(edges[b + 1] - 1), num, den, near)
        n = size[pick]
        which = np.repeat(np.arange(len(pick)), n)
        member = np.arange(n.sum()) + np.repeat(at[pick] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        seg = which * s.segments + ((place[member] * s.segments) >> 32)
        cells = len(pick) * s.segments
        total, filled = np.zeros(cells, U64), np.bincount(seg, minlength=cells)
        np.add.at(total, seg, token[member])
        name = mix((np.arange(cells) % s.segments).astype(U64) * _SEG + U64(b + 1))
        # subsets that are empty (after a deletion) are indexed only for sets that have more of them than the scheme can spare
        many = (filled <= s.deletions).reshape(len(pick), s.segments).sum(1) > s.spare
        use = (filled > 0) | many.repeat(s.segments)
        out.append((np.repeat(pick, s.segments)[use], mix(total ^ name)[use].view(np.int64)))
        if s.deletions:
            rest = (filled[seg] > 1) | many[which]
            out.append((pick[which[rest]], mix((total[seg] - token[member])[rest] ^ name[seg[rest]]).view(np.int64)))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows, keys = zip(*out, strict=True)
    return np.concatenate(rows), np.concatenate(keys)


def document_sets(docs: DataFrame, k: int, text: str = "text", doc_id: str = "doc_id", apart: frozenset = frozenset(), bits: int = 64) -> DataFrame:
    """One row per document: doc_id, n_shingles, set_id (0 for an empty set), check."""

    def run(batches):
        for batch in batches:
            data, at = flat(batch.column(1))
            n, ids, checks = (np.zeros(len(at) - 1, np.int64) for _ in range(3))
            for a, b, piece, cut in blocks(data, at):
                h, own = shingles(piece, cut, k)
                n[a:b] = np.diff(own)
                ids[a:b], checks[a:b] = set_ids(h, own, apart, bits)
            ids[n == 0] = checks[n == 0] = 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(ids), pa.array(checks)], ["doc_id", "n_shingles", "set_id", "check"])

    kind = dict(docs.dtypes)[doc_id]
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(lean(run), f"doc_id {kind}, n_shingles long, set_id long, check long")


def index_rows(docs: DataFrame, k: int, num: int, den: int, text: str = "text", near: float = 1.0, apart: frozenset = frozenset(), bits: int = 64) -> DataFrame:
    """The index: key, set_id. Copies of a set in one task are indexed once."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            data, at = flat(batch.column(0))
            for _, _, piece, cut in blocks(data, at):
                h, own = shingles(piece, cut, k)
                ids, _ = set_ids(h, own, apart, bits)
                fresh = np.zeros(len(ids), bool)
                for i, x in enumerate(ids.tolist()):
                    if own[i + 1] > own[i] and x not in seen:
                        seen.add(x)
                        fresh[i] = True
                if not fresh.any():
                    continue
                size = np.diff(own)
                row, key = keys_of(h[np.repeat(fresh, size)], np.concatenate([[0], np.cumsum(size[fresh])]), num, den, near)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids[fresh][row])], ["key", "set_id"])

    return docs.select(F.col(text).alias("text")).mapInArrow(lean(run), "key long, set_id long")


def packed_texts(docs: DataFrame, k: int, text: str = "text", apart: frozenset = frozenset(), bits: int = 64) -> DataFrame:
    """set_id and a compressed text that has this set; copies in one task come once."""

    def run(batches):
        seen: set[int] = set()
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            data, at = flat(batch.column(0))
            ids, packed = [], []
            for _, _, piece, cut in blocks(data, at):
                h, own = shingles(piece, cut, k)
                for i, x in enumerate(set_ids(h, own, apart, bits)[0].tolist()):
                    if own[i + 1] > own[i] and x not in seen:
                        seen.add(x)
                        ids.append(x)
                        packed.append(pack.compress(piece[cut[i] : cut[i + 1]].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(packed, pa.binary())], ["set_id", "packed"])

    return docs.select(F.col(text).alias("text")).mapInArrow(lean(run), "set_id long, packed binary")


def _opened(batches, k: int):
    """Batches of pairs with both sides' sets: (batch, [(set of a, set of b)])."""
    unpack = zstandard.ZstdDecompressor()
    kept: dict[int, np.ndarray] = {}
    for whole in batches:
        for lo in range(0, whole.num_rows, 256):
            batch = whole.slice(lo, 256)
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            todo: dict[int, bytes] = {}
            for side, ids in ((2, a), (3, b)):
                for i, x in enumerate(ids):
                    if x not in kept and x not in todo:
                        todo[x] = unpack.decompress(batch.column(side)[i].as_py())
            names = list(todo)
            at = np.concatenate([[0], np.cumsum([len(x) for x in todo.values()], dtype=np.int64)])
            data = np.frombuffer(b"".join(todo.values()), np.uint8)
            for f, e, piece, cut in blocks(data, at):
                h, own = shingles(piece, cut, k)
                kept.update((names[i], h[own[i - f] : own[i - f + 1]].copy()) for i in range(f, e))
            yield batch, [(kept[x], kept[y]) for x, y in zip(a, b, strict=True)]
            if sum(map(len, kept.values())) > 4_000_000:
                kept.clear()


def _linked(k: int, num: int, den: int):
    """Keeps the pairs that meet the threshold: den * intersection >= num * union."""

    def run(batches):
        for batch, sets in _opened(batches, k):
            good = []
            for x, y in sets:
                total, both = len(x) + len(y), 0
                if den * min(len(x), len(y)) >= num * max(len(x), len(y)):
                    both = total - len(np.unique(np.concatenate([x, y])))
                good.append(den * both >= num * (total - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _sketch(x: np.ndarray, most: int) -> bytes:
    """The parity of the set's members by hash, in 8 to 16 bits for each of ``most`` members: two sketches differ in no more bits than the sets in members."""
    bits = 1 << max(6, int(8 * most).bit_length())
    return np.packbits(np.bincount((x & U64(bits - 1)).astype(np.int64), minlength=bits) & 1).tobytes()


def _folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches of the shortest one's length, a row each."""
    width, out = min(map(len, sketches)), []
    for x in sketches:
        out.append(np.bitwise_xor.reduce(np.frombuffer(x, np.uint8).reshape(-1, width)))
    return np.array(out)


def _parted(k: int, num: int, den: int):
    """What sets a differ from their leaders b in: a, b, near (linked), n (members of a), added, gone, prefix (of added, then gone), and a's sketch."""

    def run(batches):
        for batch, sets in _opened(batches, k):
            rows = []
            for x, p in sets:
                added, gone = np.setdiff1d(x, p, assume_unique=True), np.setdiff1d(p, x, assume_unique=True)
                n, m, d = len(x), len(p), len(added) + len(gone)
                near = (den + num) * d <= (den - num) * (n + m)
                if near:  # a partner is not linked to the leader, so it is further from it
                    least = -((-(d * (den + num) + (den - num) * (m - n))) // (2 * (den + num)))
                else:
                    least = d - n * (den - num) // num
                own = np.concatenate([added, gone])[: max(0, d - max(1, least) + 1)]
                rows.append((near, n, len(added), len(gone), _sketch(x, n * (den - num) // num), (own >> U64(32)).astype(np.uint32).view(np.int32)))
            near, n, added, gone, sketch, own = zip(*rows, strict=True)
            at = np.concatenate([[0], np.cumsum([len(x) for x in own])])
            prefix = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(own), pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(near), *(pa.array(c, pa.int32()) for c in (n, added, gone)), prefix, pa.array(sketch, pa.binary())],
                ["a", "b", "near", "n", "added", "gone", "prefix", "sketch"],
            )

    return run


def _with_texts(pairs: DataFrame, texts: DataFrame, of: Callable[[str], Column] | None = None) -> DataFrame:
    """The pairs (a, b) of set ids with one text of each, fetched by a join; only those whose a fulfils a condition, if one is given."""
    if of:
        pairs = pairs.where(of("a"))
    left = (texts.where(of("set_id")) if of else texts).select(F.col("set_id").alias("a"), F.col("packed").alias("left"))
    right = texts.select(F.col("set_id").alias("b"), F.col("packed").alias("right"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "left", "right")


def _of(pairs: DataFrame, texts: DataFrame, few: int = FEW) -> DataFrame:
    """The texts that the pairs need, if these are few; else all, of which the joins pick."""
    if pairs.limit(few + 1).count() > few:
        return texts
    ids = pairs.select(F.col("a").alias("set_id")).union(pairs.select("b")).distinct()
    return texts.join(F.broadcast(ids), "set_id", "left_semi")


def led(index: DataFrame) -> DataFrame:
    """(a, b): each set of an index of shared keys (key, set_id, crowd) and the leaders of its keys."""
    weight = index.groupBy("set_id").agg(F.sum("crowd").alias("weight"))
    best = F.max(F.struct("weight", "set_id")).over(Window.partitionBy("key"))["set_id"]
    return index.join(weight, "set_id").select(F.col("set_id").alias("a"), best.alias("b")).where("a != b").distinct()


def _dealt(batches):
    """Stars with their leader's shares (null: one) as b, share, a, n, added, gone, member, place, sketch: a row for each share that has members of the prefix. No places: all, in order."""
    for batch in batches:
        shares = np.maximum(batch.column(8).fill_null(1).to_numpy(zero_copy_only=False), 1).astype(np.int64)
        prefix = batch.column(5)
        size = prefix.value_lengths().to_numpy().astype(np.int64)
        star = np.repeat(np.arange(len(size)), size)
        member = prefix.flatten().to_numpy()
        place = np.arange(len(star)) - np.repeat(np.cumsum(size) - size, size)
        share = (mix(member.view(np.uint32).astype(U64)) % shares[star].astype(U64)).astype(np.int64)
        order = np.lexsort((place, share, star))
        star, share, member, place = star[order], share[order], member[order], place[order]
        new = np.ones(len(star), bool)
        new[1:] = (star[1:] != star[:-1]) | (share[1:] != share[:-1])
        first = np.flatnonzero(new)
        row, ends = star[first], np.append(first, len(star))
        some = shares[star] > 1
        ends_of_some = np.append(0, np.cumsum(some))[ends]
        lists = (pa.ListArray.from_arrays(pa.array(e, pa.int32()), pa.array(x, pa.int32())) for e, x in ((ends, member), (ends_of_some, place[some])))
        rows, kept = pa.array(row), pa.array(row, mask=shares[row] > SKETCHED)
        yield pa.RecordBatch.from_arrays(
            [batch.column(1).take(rows), pa.array(share[first], pa.int32()), *(batch.column(i).take(rows) for i in (0, 2, 3, 4)), *lists, batch.column(6).take(kept)],
            ["b", "share", "a", "n", "added", "gone", "member", "place", "sketch"],
        )


def _within(num: int, den: int):
    """Pairs of one leader's sets with a member of one share in common; the right side has the sets' components."""

    def run(table: pa.Table, side: pa.Table) -> pa.Table:
        none = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        if not len(side) or len(table) < 2:
            return none
        a, n, added, gone = (table[c].to_numpy() for c in ("a", "n", "added", "gone"))
        known = side["a"].to_numpy()
        order = np.argsort(known)
        at = order[np.searchsorted(known, a, sorter=order)]
        part, outside = side["part"].to_numpy()[at], side["outside"].to_numpy()[at]
        prefix, places = table["member"].combine_chunks(), table["place"].combine_chunks()
        size = prefix.value_lengths().to_numpy().astype(np.int64)
        fan = np.repeat(np.arange(len(a)), size)
        place = places.flatten().to_numpy().astype(np.int64)  # a leader's sets all have them or none has
        if not len(place):
            place = np.arange(len(fan)) - np.repeat(np.cumsum(size) - size, size)
        member = prefix.flatten().to_numpy()
        order = np.argsort(member, kind="stable")
        member, fan, place = member[order], fan[order], place[order]
        n, added, gone = (c.astype(np.int64) for c in (n, added, gone))
        found, at, step = [np.zeros(0, np.int64)], np.arange(len(member)), 1
        while True:  # of sets with a member in common, those ``step`` places apart; few are left as the step grows
            at = at[at + step < len(member)]
            at = at[member[at + step] == member[at]]
            if not len(at):
                break
            x, y = fan[at], fan[at + step]
            keep = (part[x] != part[y]) & (outside[x] | outside[y]) & (np.maximum(n[x], n[y]) * num <= np.minimum(n[x], n[y]) * den)
            i, x, j, y = place[at[keep]], x[keep], place[at[keep] + step], y[keep]
            both = np.minimum(added[x] - i, added[y] - j) + np.minimum(gone[x], gone[y])
            room = np.where(i < added[x], both, np.minimum(added[x] + gone[x] - i, added[y] + gone[y] - j))
            keep = 2 * room >= added[x] + gone[x] + added[y] + gone[y] - (n[x] + n[y]) * (den - num) // (den + num)
            found.append(np.unique(np.minimum(x[keep], y[keep]) * len(a) + np.maximum(x[keep], y[keep])))
            if step % 64 == 0:
                found = [np.unique(np.concatenate(found))]
            step += 1
        pairs = np.unique(np.concatenate(found))
        if len(pairs) and not table["sketch"].null_count:  # most of the pairs that are no links show in their sketches
            marks, close = _folded(table["sketch"].to_pylist()), []
            for lo in range(0, len(pairs), 2048):
                x, y = pairs[lo : lo + 2048] // len(a), pairs[lo : lo + 2048] % len(a)
                close.append(np.bitwise_count(marks[x] ^ marks[y]).sum(1, dtype=np.int64) * (den + num) <= (n[x] + n[y]) * (den - num))
            pairs = pairs[np.concatenate(close)]
        x, y = a[pairs // len(a)], a[pairs % len(a)]
        return pa.table({"a": np.minimum(x, y), "b": np.maximum(x, y)})

    return run


def _pairs(stars: DataFrame, parts: DataFrame, num: int, den: int, held: int = HELD) -> DataFrame:
    """Pairs of sets in different components that may be linked though neither leads the other.

    The sets of a leader meet in a task, with all members of their prefixes if these are ``held`` at most; a
    larger leader's members are dealt to shares of about so many. The prefixes are exchanged once.
    """
    part = parts.select(F.col("node").alias("a"), F.col("component").alias("pa"))
    lead = parts.select(F.col("node").alias("b"), F.col("component").alias("pb"))
    light = stars.select("a", "b", F.size("prefix").alias("members")).join(part, "a", "left").join(lead, "b", "left")
    light = written(light.select("a", "b", "members", F.coalesce("pa", "a").alias("part"), (F.coalesce("pa", "a") != F.coalesce("pb", "b")).alias("outside")), "fans")
    open_ = light.groupBy("b").agg(F.sum("members").alias("total"), F.max("outside").alias("out"), F.min("part").alias("low"), F.max("part").alias("high")).where("out AND low != high")
    open_ = written(open_.select("b", F.ceil(F.col("total") / F.lit(held)).cast("int").alias("shares")), "leaders")
    swept(stars.sparkSession)
    large = F.broadcast(open_.where("shares > 1"))  # a row for each ``held`` members at most
    kind = "b long, share int, a long, n int, added int, gone int, member array<int>, place array<int>, sketch binary"
    dealt = stars.join(large, "b", "left").select("a", "b", "n", "added", "gone", "prefix", "sketch", "near", "shares").mapInArrow(lean(_dealt), kind)
    sides = light.join(open_, "b").select("b", F.explode(F.sequence(F.lit(0), F.greatest("shares", F.lit(1)) - 1)).alias("share"), "a", "part", "outside")
    return dealt.groupBy("b", "share").cogroup(sides.groupBy("b", "share")).applyInArrow(_within(num, den), "a long, b long").distinct()


def linked_sets(docs: DataFrame, k: int, num: int, den: int, text: str = "text", near: float = 1.0, apart: frozenset = frozenset(), bits: int = 64, held: int = HELD) -> DataFrame:
    """(node, component): the components of the distinct sets that have a partner."""
    of = Window.partitionBy("key")
    index = written(
        index_rows(docs, k, num, den, text, near, apart, bits)
        .withColumn("least", F.min("set_id").over(of)).withColumn("most", F.max("set_id").over(of)).withColumn("crowd", F.count(F.lit(1)).over(of))
        .where("least != most").select("key", "set_id", "crowd"),
        "index",
    )
    swept(docs.sparkSession)
    # only sets with a candidate are fetched; of several copies of a set, one text
    wanted = index.select("set_id").distinct()
    texts = written(packed_texts(docs, k, text, apart, bits).join(wanted, "set_id", "left_semi").dropDuplicates(["set_id"]), "texts")
    pairs = written(led(index), "led")
    released(index)
    # about as many pairs as there are texts at a time, however many leaders a set has
    rounds = max(1, round(pairs.count() / max(1, texts.count())))
    stars = []
    for i in range(rounds):
        swept(docs.sparkSession)
        some = _with_texts(pairs, texts, lambda c: F.pmod(F.xxhash64(c), F.lit(rounds)) == i)  # noqa: B023
        stars.append(written(some.mapInArrow(lean(_parted(k, num, den)), "a long, b long, near boolean, n int, added int, gone int, prefix array<int>, sketch binary"), "stars"))
    released(pairs)
    every = reduce(DataFrame.union, stars)
    swept(docs.sparkSession)
    parts = written(connected_components(every.where("near").select("a", "b"), "a", "b"), "parts")
    more = written(_pairs(every, parts, num, den, held), "pairs")
    released(*stars)
    swept(docs.sparkSession)
    more = written(_with_texts(more, _of(more, texts)).mapInArrow(lean(_linked(k, num, den)), "a long, b long"), "links")
    released(texts)
    swept(docs.sparkSession)
    if more.isEmpty():
        return parts
    return written(connected_components(parts.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more), "a", "b"), "parts")


def ngram_jaccard_join(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, text: str = "text", doc_id: str = "doc_id", near: float = 1.0, bits: int = 64, held: int = HELD) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest doc_id that links reach).

    Two documents link when den * |intersection| >= num * |union| of their k-word
    shingles. ``near`` is how many sets of three quarters of that similarity a set is
    expected to have; many of them make one-deletion neighbourhoods the cheaper
    index. ``bits`` of a set's name are used at first; the sets of one leader meet in a
    task if their prefixes have ``held`` members at most. See the module's text for defined results.
    """
    tuned(docs.sparkSession)
    kind = dict(docs.dtypes)[doc_id]
    apart: frozenset = frozenset()
    while True:
        sets = written(document_sets(docs, k, text, doc_id, apart, bits), "sets")
        own = written(
            sets.where("n_shingles > 0").groupBy("set_id").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"), (F.min("check") != F.max("check")).alias("several")),
            "own",
        )
        shared = own.where("several").select("set_id").limit(SHARED + 1).collect()  # of 5e10 sets, some 70
        if len(shared) > SHARED:
            raise RuntimeError("too many sets share a name")
        if not shared:
            break
        apart = apart | {r["set_id"] for r in shared}
    parts = linked_sets(docs, k, num, den, text, near, apart, bits, held)
    named = own.join(parts.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("part", F.coalesce("component", "set_id"))
    first = named.where("component IS NOT NULL").groupBy("part").agg(F.min("least").alias("reached"))
    # sets of one document need no join; equal sets and linked ones get the smallest id of all
    groups = named.where("component IS NOT NULL OR copies > 1").join(first, "part", "left").select("set_id", F.coalesce("reached", "least").alias("reached"))
    return sets.join(groups, "set_id", "left").select("doc_id", "n_shingles", F.coalesce("reached", "doc_id").cast(kind).alias("component_id"))
