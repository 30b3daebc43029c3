"""Packing token sequences by minimum bin slack.

Documents are tokenised, cut at every ``window`` tokens, and pieces are counted by
length. A bitset subset-sum DP over the lengths still in stock finds the multiset
that, with the longest of them, fills a window closest to capacity; it is used as
often as the stock allows, so that there are at most about as many patterns as
lengths, whatever the number of documents. Pieces of a length are ranked and dealt
to the patterns' places.

Defined results: a null or empty text has only the end id; repeated rows are separate
documents and get separate pieces; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import itertools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimill.functions.durable import written

from .ranking import ranked
from .textnp import IS_SPACE, REMEMBERED, flat, lean, tuned, words

WINDOW = 4096
END = 2
#: Distinct parts of words whose ids a worker remembers, and the longest of them in bytes.
CACHE, CACHED = 1_000_000, 64
#: Bytes of text that are cut into parts at once, and new parts that are tokenised as one text.
CHUNK, JOINED = 2_000_000, 256
_SPACE, _LETTER, _DIGIT, _MARK, _WHOLE = range(5)
#: Kinds of ASCII bytes; what could change with its neighbours is _WHOLE: an apostrophe, and at first all that isn't ASCII.
_KINDS = np.full(256, _MARK, np.uint8)
_KINDS[IS_SPACE] = _SPACE
_KINDS[np.frombuffer(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", np.uint8)] = _LETTER
_KINDS[np.frombuffer(b"0123456789", np.uint8)] = _DIGIT
_KINDS[ord("'")] = _KINDS[128:] = _WHOLE
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _cuts(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of about CHUNK bytes that end beside white space or at a document's end, so that no word is cut."""
    lo, n = 0, int(at[-1])
    while lo < n:
        hi = min(lo + CHUNK, n)
        edge = int(at[np.searchsorted(at, hi)])
        while hi < edge:
            space = np.flatnonzero(IS_SPACE[data[hi : min(hi + 4096, edge)]])
            if len(space):
                hi += int(space[0])
                break
            hi = min(hi + 4096, edge)
        yield lo, hi
        lo = hi


def _parts(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block's parts: their bytes one after another, n+1 offsets into these, which of them are whole words, and starts in the block."""
    kind, low = _KINDS[data], _LOWER[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)  # U+00C0 to U+00FF: letters that stay composed, but for two signs
    if len(lead):
        second = data[lead + 1]
        letter = (second >= 0x80) & (second <= 0xBF) & (second != 0x97) & (second != 0xB7)
        lead, second = lead[letter], second[letter]
        kind[lead] = kind[lead + 1] = _LETTER
        low[lead + 1] = second + np.uint8(32) * (second < 0x9F)
    odd = kind == _WHOLE
    odd[1:] |= (data[1:] == ord("|")) & (data[:-1] == ord("<"))  # an added token is found before lower case
    if odd.any():
        first, end, _ = words(data, at)
        own = np.flatnonzero(np.bitwise_or.reduceat(odd.view(np.uint8), first))
        turn = np.zeros(len(data) + 1, np.int8)
        turn[first[own]] += 1
        turn[end[own]] -= 1
        inside = np.cumsum(turn[:-1], dtype=np.int8).view(bool)
        np.putmask(kind, inside, _WHOLE)
        np.copyto(low, data, where=inside)
    text = kind != _SPACE
    new = kind == _DIGIT
    new[0] = True
    new[1:] |= kind[1:] != kind[:-1]
    new[at[:-1][at[:-1] < len(data)]] = True
    starts = np.flatnonzero(new & text)
    before = np.cumsum(text, dtype=np.int32)
    return low[text], np.append(before[starts] - 1, before[-1]).astype(np.int32), kind[starts] == _WHOLE, starts


class WordIds:
    """Token ids of whole texts. White space never joins words in this tokenizer, which splits what it has normalised into runs of letters, single digits and runs of other signs.

    Words of ASCII and of the letters from U+00C0 to U+00FF, which normalising only puts in lower case, are cut so beforehand, and the parts
    looked up in lower case. A word with any other character, an apostrophe or the start of an added token is looked up whole, as it is written.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        vocabulary = self.tokenizer.get_vocab()
        self.final = np.zeros(max(vocabulary.values()) + 1, bool)
        self.final[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _learn(self, parts: list[bytes], whole: list[bytes]) -> None:
        """A part's last token, and no other, is one that ends a word, so that parts are tokenised together."""
        groups = [parts[lo : lo + JOINED] for lo in range(0, len(parts), JOINED)]
        for group in groups:
            e = self.tokenizer.encode_batch_fast([b" ".join(group).decode()], add_special_tokens=False)[0]
            ids = np.array(e.ids, "<u4")
            ends = np.flatnonzero(self.final[ids]) + 1
            if len(ends) != len(group):
                whole = whole + group
                continue
            raw, lo = ids.tobytes(), 0
            for w, hi in zip(group, (4 * ends).tolist(), strict=True):
                self.known[w] = raw[lo:hi]
                lo = hi
        for lo in range(0, len(whole), 4096):
            some = whole[lo : lo + 4096]
            for w, e in zip(some, self.tokenizer.encode_batch_fast([w.decode() for w in some], add_special_tokens=False), strict=True):
                self.known[w] = np.array(e.ids, "<u4").tobytes()

    def _block(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, offsets, odd, starts = _parts(data, at)
        if not len(starts):
            return np.zeros(0, "<u4"), np.zeros(len(at) - 1, np.int64)
        coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(low)]).dictionary_encode()
        keys = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.known.get, keys))
        new = [k for k, ids in enumerate(found) if ids is None]
        if new:
            if len(self.known) + len(new) > CACHE:
                self.known.clear()
                new = range(len(keys))
            whole = np.zeros(len(keys), bool)
            whole[coded.indices.to_numpy()] = odd
            self._learn([keys[k] for k in new if not whole[k]], [keys[k] for k in new if whole[k]])
            for k in new:
                found[k] = self.known[keys[k]]
                if len(keys[k]) > CACHED:
                    del self.known[keys[k]]
        taken = pa.array(found, pa.large_binary()).take(coded.indices)
        _, ends, ids = taken.buffers()
        ends = np.frombuffer(ends, np.int64)[taken.offset : taken.offset + len(taken) + 1] // 4
        return np.frombuffer(ids, "<u4")[ends[0] : ends[-1]], np.diff(ends[np.searchsorted(starts, at)])

    def flat(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of documents given by their bytes and n+1 offsets: all ids, and n+1 offsets into them."""
        out, count = [np.zeros(0, "<u4")], np.zeros(len(at) - 1, np.int64)
        for lo, hi in _cuts(data, at):
            first, end = int(np.searchsorted(at, lo, "right")) - 1, int(np.searchsorted(at, hi))
            ids, own = self._block(data[lo:hi], np.clip(at[first : end + 1], lo, hi) - lo)
            out.append(ids)
            count[first:end] += own
        return np.concatenate(out), np.concatenate([[0], np.cumsum(count)])

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        ids, at = self.flat(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)]))
        return [ids[lo:hi] for lo, hi in itertools.pairwise(at)]


_tokenizers: dict[str, WordIds] = {}
REMEMBERED.append(_tokenizers.clear)


def word_ids(path: str) -> WordIds:
    """One for each worker process, which runs many tasks."""
    if path not in _tokenizers:
        _tokenizers[path] = WordIds(path)
    return _tokenizers[path]


def token_pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, end: int = END, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens."""

    def run(batches):
        ids_of = word_ids(tokenizer)
        last = np.array([end], "<u4")
        for batch in batches:
            data, at = flat(batch.column(1))
            found, own_at = ids_of.flat(data, at)
            rows: list[tuple] = []
            for i, (lo, hi) in enumerate(itertools.pairwise(own_at.tolist())):
                ids = np.concatenate([found[lo:hi], last])
                buf = memoryview(ids).cast("B")
                rows += [(i, s, min(window, len(ids) - s), zlib.crc32(buf[4 * s : 4 * (s + window)]), len(ids)) for s in range(0, len(ids), window)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            own = batch.column(0).take(pa.array(cols[0], pa.int64()))
            yield pa.RecordBatch.from_arrays([own, *(pa.array(c, pa.int64()) for c in cols[1:])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    kind = dict(docs.dtypes)[doc_id]
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(lean(run, forget=False), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def slack_patterns(stock: dict[int, int], window: int = WINDOW) -> list[tuple[int, list[tuple[int, int]]]]:
    """(uses, [(length, copies)]) until the stock is used up."""
    stock, out = {k: v for k, v in stock.items() if v > 0}, []
    lengths = sorted(stock, reverse=True)
    while lengths:
        top, room = lengths[0], window - lengths[0]
        reach, items, mask = 1, [], (1 << (room + 1)) - 1
        for size in lengths:
            if size > room or reach >> room & 1:
                continue
            free, part = min(stock[size] - (size == top), room // size), 1
            while free > 0 and not reach >> room & 1:
                c = min(part, free)
                items.append((size, c, reach))
                reach |= (reach << (size * c)) & mask
                free -= c
                part *= 2
        at, used = reach.bit_length() - 1, {top: 1}
        for size, c, before in reversed(items):
            if not before >> at & 1:
                used[size] = used.get(size, 0) + c
                at -= size * c
        uses = min(stock[s] // c for s, c in used.items())
        for s, c in used.items():
            stock[s] -= uses * c
        lengths = [s for s in lengths if stock[s]]
        out.append((uses, list(used.items())))
    return out


def _places(patterns: list) -> np.ndarray:
    """For each length, runs of ranks: length, first rank, first sequence, copies in a sequence, offset there."""
    rows, sequence, rank = [], 0, {}
    for uses, parts in patterns:
        offset = 0
        for size, copies in parts:
            first = rank.get(size, 0)
            rows.append((size, first, sequence, copies, offset))
            rank[size] = first + uses * copies
            offset += size * copies
        sequence += uses
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def packed(docs: DataFrame, tokenizer: str, window: int = WINDOW, end: int = END, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    tuned(docs.sparkSession)
    pieces = written(token_pieces(docs, tokenizer, window, end, text, doc_id), "pieces")
    stock = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``window`` rows
    places = _places(slack_patterns(stock, window))

    def place(batches):
        for batch in batches:
            size, rank = (batch.column(i).to_numpy() for i in (2, 5))
            key = size * (1 << 44) + rank
            at = np.searchsorted(places[:, 0] * (1 << 44) + places[:, 1], key, "right") - 1
            _, first, sequence, copies, offset = places[at].T
            local = rank - first
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(5)), pa.array(sequence + local // copies), pa.array(offset + local % copies * size)],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    order = [F.col(c) for c in ("doc_id", "start", "ids_crc32", "doc_tokens")]
    kind = dict(docs.dtypes)[doc_id]
    return (
        ranked(pieces, ["length"], order, F.xxhash64("doc_id", "start")).select(*names, "rank")
        .mapInArrow(place, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    )
