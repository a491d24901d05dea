"""Removal of repeated passages, by level-wise doubling.

A passage of `window` words that starts earlier elsewhere is found in two levels: windows of half the length first, and
of those, the repeated ones alone are extended to the whole length. At the whole length no candidate is left to
extend: any longer repeat is a run of such windows, so they decide about every word.

Level one doesn't move every position. Of the short windows within each long one, the one with the least hash is its
anchor; equal long windows have equal anchors, and neighbours mostly share one, so about one position in six is an
anchor. Anchors meet by the hash of their short window. One that no other place has is dropped: no long window around it is
repeated. One that is repeated is extended to the long windows around it, in one of two ways:

- all its long windows at once: they form a segment, whose hash covers them and travels with the anchor, so that the double
  length is compared in the same exchange. Of equal segments, the earliest stays and the others' words are removed, whole;
- one by one: where segments of an anchor differ, some of their long windows may still be equal. The earliest of each
  different segment goes on to level two, where its long windows meet by hash, and all but the earliest of each are removed.

Each task first settles what it can among its own documents, so that what a group of copies or a common line sends to
one key grows with the number of tasks, not of documents. Of keys that are crowded within a task, two different segments meet at
level one, so that whoever else has the key is extended too, and those two as well; the others go on to level two at
once. Rows of one key are then taken as a sorted stream, never held together.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_arrow, in_slices, materialise, table, word_blocks
from .tokenizer import in_groups

#: Odd factors of two independent polynomial hashes.
_FACTORS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_SPAN, _EXTEND = 1, 2
#: Different segments of one anchor within a task beyond which all but two go to level two without meeting at level one.
CROWDED = 64
#: Characters of text whose anchors a task settles at a time.
TOGETHER = 16_000_000
KEPT_WORDS = 500_000
_ROW = "key long, seg long, d long, pos long, tag long"


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > KEPT_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_known = _WordHashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _power(factor: int, n: int) -> np.uint64:
    return np.uint64(pow(factor, n, 1 << 64))


def word_hashes(data: bytes) -> np.ndarray:
    known = _known
    parts = [np.array([known[w] for w in block], dtype=np.uint64) for block in word_blocks(data)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def window_hashes(h: np.ndarray, length: int, factor: int) -> np.ndarray:
    """Hash of each run of `length` words, from those of half the length."""
    if length == 1:
        return h
    half = length // 2
    short = window_hashes(h, half, factor)
    n = len(h) - length + 1
    out = short[: n + length % 2] * _power(factor, half) + short[half : half + n + length % 2]
    return out[:n] * np.uint64(factor) + h[length - 1 :] if length % 2 else out


def _second(h: np.ndarray) -> np.ndarray:
    return _mix(h ^ np.uint64(0x5851F42D4C957F2D))


def anchors(h: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(key, seg, at, before, more): an anchor's hash, its segment's, its word, and how far before it the segment's first window starts and how many more windows follow that one."""
    short = window // 2
    n = len(h) - window + 1
    small = _mix(window_hashes(h, short, _FACTORS[0]))
    whole = window_hashes(h, window, _FACTORS[0])
    at = np.lib.stride_tricks.sliding_window_view(small, window - short + 1).argmin(1) + np.arange(n)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:], [n]]) - 1
    at = at[first]
    before, more = at - first, last - first
    seg = _mix(whole[first] * np.uint64(3) + _mix(whole[last]) * np.uint64(5) + (before * 256 + more).astype(np.uint64))
    return small[at], seg, at, before, more


def _pos(at, before, more, kind):
    """One long: order of the word first, then what belongs to it."""
    return (at.astype(np.int64) << 20) | (before << 12) | (more << 4) | kind


def _spread(d: np.ndarray, pos: np.ndarray) -> np.ndarray:
    return _mix(d.view(np.uint64) * np.uint64(3) + pos.view(np.uint64))


def _batch(key, seg, d, pos, tag) -> pa.RecordBatch:
    arrays = [pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (key, seg, d, pos)] + [pa.array(tag, pa.int64())]
    return pa.RecordBatch.from_arrays(arrays, names=["key", "seg", "d", "pos", "tag"])


def _settled(key, seg, d, pos, tag, crowded: int | None) -> pa.RecordBatch:
    """What a task sends on: of equal rows the earliest, to its key; of the others, that their words go."""
    order = np.lexsort((tag, pos, d, seg, key))
    key, seg, d, pos, tag = key[order], seg[order], d[order], pos[order], tag[order]
    at = pos >> 20
    new_key = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    new_seg = new_key.copy()
    new_seg[1:] |= seg[1:] != seg[:-1]
    first = np.maximum.accumulate(np.where(new_seg, np.arange(len(key)), 0))
    same = (d == d[first]) & (at == at[first])
    again = np.zeros(len(key), bool)  # a repeated row of the input: the same place
    again[1:] = ~new_seg[1:] & (d[1:] == d[:-1]) & (at[1:] == at[:-1]) & (tag[1:] == tag[:-1])
    kind = np.where(same, 0, _SPAN)
    if crowded:
        runs = np.flatnonzero(new_key)
        if len(runs):
            size, nth = np.diff([*runs, len(key)]), np.cumsum(new_seg)  # nth: of the segments of all keys, from 1
            many = np.repeat(np.add.reduceat(new_seg.astype(np.int64), runs) > crowded, size)
            kind = np.where(many & same & (nth - np.repeat(nth[runs], size) >= 2), _EXTEND, kind)
    pos = pos | kind
    key = np.where(kind > 0, _spread(d, pos), key)
    keep = ~again
    return _batch(key[keep], np.where(kind > 0, np.uint64(0), seg)[keep], d[keep], pos[keep], tag[keep])


def _level_one(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags, texts = batch.column("d").to_numpy(), batch.column("tag").to_numpy(), batch.column("text").to_pylist()
            for a, b in in_groups(texts, TOGETHER):
                found, of = [], []
                for k in range(a, b):
                    h = word_hashes((texts[k] or "").encode())
                    if len(h) >= window:
                        found.append(anchors(h, window))
                        of.append(k)
                if not found:
                    continue
                n = [len(x[0]) for x in found]
                key, seg, at, before, more = (np.concatenate(x) for x in zip(*found, strict=True))
                yield _settled(key, seg, np.repeat(ids[of], n), _pos(at, before, more, 0), np.repeat(tags[of], n), CROWDED)

    return run


def _level_two(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            ids, tags, texts, wanted = batch.column("d").to_numpy(), batch.column("tag").to_numpy(), batch.column("packed"), batch.column("places")
            found, of, size = [], [], 0
            for k in range(batch.num_rows):
                h = word_hashes(unpack(texts[k].as_py()))
                pos = np.unique(wanted[k].values.to_numpy())
                start, more = (pos >> 20) - ((pos >> 12) & 255), (pos >> 4) & 255
                each = np.unique(np.repeat(start, more + 1) + (np.arange((more + 1).sum()) - np.repeat(np.cumsum(more + 1) - more - 1, more + 1)))
                found.append((window_hashes(h, window, _FACTORS[0])[each], window_hashes(_second(h), window, _FACTORS[1])[each], each))
                of.append(k)
                size += len(each)
                if size > 1_000_000 or k + 1 == batch.num_rows:
                    n = [len(x[0]) for x in found]
                    key, seg, at = (np.concatenate(x) for x in zip(*found, strict=True))
                    yield _settled(_mix(key), seg, np.repeat(ids[of], n), at.astype(np.int64) << 20, np.repeat(tags[of], n), None)
                    found, of, size = [], [], 0

    return run


class _Stream:
    """Rows sorted by key, seg, d, pos. For each batch: which rows' words go, and which are extended.

    Of the last key in a batch only this is kept: its key and seg, the earliest place of that seg, whether the key has
    several, and the earliest row itself as long as it has one.
    """

    def __init__(self, extend: bool):
        self.extend, self.key, self.held, self.several = extend, None, None, False
        self.seg = self.d = self.at = None

    def take(self, key, seg, d, pos, tag):
        if self.held is not None:
            key, seg, d, pos, tag = (np.concatenate([[x], y]).astype(y.dtype) for x, y in zip(self.held, (key, seg, d, pos, tag), strict=True))
        at, n = pos >> 20, len(key)
        new_key = np.ones(n, bool)
        new_key[1:] = key[1:] != key[:-1]
        goes_on = self.held is None and self.key is not None and key[0] == self.key
        new_key[0] = not goes_on
        new_seg = new_key.copy()
        new_seg[1:] |= seg[1:] != seg[:-1]
        if goes_on:
            new_seg[0] = seg[0] != self.seg
        first = np.maximum.accumulate(np.where(new_seg, np.arange(n), -1))
        first_d, first_at = d[first], at[first]
        if not new_seg[0]:
            open_run = first < 0
            first_d, first_at = np.where(open_run, self.d, first_d), np.where(open_run, self.at, first_at)
        goes = (d != first_d) | (at != first_at)
        runs = np.flatnonzero(new_key)
        starts = runs if new_key[0] else np.concatenate([[0], runs])
        count = np.add.reduceat(new_seg.astype(np.int64), starts)
        if goes_on:
            count[0] += 2 if self.several else 1
        several = np.repeat(count > 1, np.diff([*starts, n]))
        self.key, self.seg, self.d, self.at, self.several = key[-1], seg[-1], first_d[-1], first_at[-1], bool(several[-1])
        i = int(starts[-1])
        self.held = None if self.several or not self.extend or not new_key[i] else (key[i], seg[i], d[i], pos[i], tag[i])
        stays = several & ~goes if self.extend else np.zeros(n, bool)
        out = goes | stays
        return d[out], pos[out] | np.where(goes, _SPAN, _EXTEND)[out], tag[out]


def _resolve(extend: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = _Stream(extend)
        for batch in batches:
            if not batch.num_rows:
                continue
            key, seg, d, pos, tag = (batch.column(c).to_numpy() for c in ("key", "seg", "d", "pos", "tag"))
            settled = (pos & 15) > 0
            parts = [(d[settled], pos[settled], tag[settled])]
            if not settled.all():
                parts.append(stream.take(*(x[~settled] for x in (key, seg, d, pos, tag))))
            d, pos, tag = (np.concatenate(x) for x in zip(*parts, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(pos), pa.array(tag, pa.int64())], names=["d", "pos", "tag"])

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts cross the shuffle compressed document by document."""
    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in in_slices(batches):
        packed = pa.array([pack((t.as_py() or "").encode()) for t in batch.column("text")], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("d"), batch.column("tag"), packed], names=["doc_id", "d", "tag", "packed"])


def _clean(window: int, texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            packed, places, rows = batch.column("packed"), batch.column("places"), []
            for k in range(batch.num_rows):
                data = unpack(packed[k].as_py())
                blocks = list(word_blocks(data)) if len(data) < 1 << 20 else word_blocks(data)
                gone = None
                if places[k].is_valid:
                    pos = places[k].values.to_numpy()
                    start = (pos >> 20) - ((pos >> 12) & 255)
                    end = start + ((pos >> 4) & 255) + window
                    edge = np.zeros(int(end.max()) + 1, np.int64)
                    np.add.at(edge, start, 1)
                    np.add.at(edge, end, -1)
                    gone = np.cumsum(edge) > 0
                digest, n, removed, between, kept = hashlib.sha256(), 0, 0, b"", []
                for words in blocks:
                    if gone is not None and n < len(gone):
                        of = gone[n : n + len(words)]
                        stays = np.ones(len(words), bool)
                        stays[: len(of)] = ~of
                        removed += int(of.sum())
                        left = list(itertools.compress(words, stays))
                    else:
                        left = words
                    n += len(words)
                    if left:
                        digest.update(between + b" ".join(left))
                        between = b" "
                        if texts:
                            kept.append(b" ".join(left))
                rows.append((n, removed, digest.hexdigest(), b" ".join(kept).decode() if texts else None))
            n, removed, digests, kept = zip(*rows, strict=True) if rows else ((), (), (), ())
            columns = {"doc_id": batch.column("doc_id"), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
            if texts:
                columns["kept"] = pa.array(kept, pa.string())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def without_repeats(docs: DataFrame, window: int = 20, texts: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, with texts, kept: one row for each row of docs (doc_id, text; others are not looked at).

    Words go that lie in a run of `window` words (even, up to 400) which also starts earlier: in a smaller doc_id, or in the
    same document before. A null doc_id comes before all others, a null text has no words; neither is dropped.
    Repeated rows are copies of one document and get the same result. Rows that share a doc_id but not the text
    are told apart; where a passage starts at the same word of both, neither is the earlier. Documents of fewer words
    than the window lose none. An empty table gives an empty result.
    """
    if window % 2 or not 2 <= window <= 400:
        raise ValueError("window is an even number of words from 2 to 400")
    least = F.lit(-(1 << 63))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("d", F.coalesce("doc_id", least))
    shared = not own.groupBy("d").count().filter("count > 1").isEmpty()
    own = own.withColumn("tag", F.xxhash64(F.coalesce("text", F.lit(""))) if shared else F.lit(0).cast("long"))
    packed = own.select("doc_id", "d", "tag", "text").transform(in_arrow(_pack, "doc_id long, d long, tag long, packed binary"))

    def met(rows: DataFrame, extend: bool) -> DataFrame:
        return rows.repartition("key").sortWithinPartitions("key", "seg", "d", "pos").transform(in_arrow(_resolve(extend), "d long, pos long, tag long"))

    one = materialise(met(own.select("d", "tag", "text").transform(in_arrow(_level_one(window), _ROW)), True), "repeats")
    extended = one.filter(f"pos & 15 = {_EXTEND}").groupBy("d", "tag").agg(F.collect_list("pos").alias("places"))
    unique = packed.select("d", "tag", "packed")
    if shared:
        unique = unique.dropDuplicates(["d", "tag"])
    two = met(unique.join(extended, ["d", "tag"]).select("d", "tag", "packed", "places").transform(in_arrow(_level_two(window), _ROW)), False)
    spans = one.filter(f"pos & 15 = {_SPAN}").union(two).groupBy("d", "tag").agg(F.collect_list("pos").alias("places"))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts
    return packed.join(spans, ["d", "tag"], "left").select("doc_id", "packed", "places").transform(in_arrow(_clean(window, texts), schema))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1_substring."""
    return without_repeats(table(spark, sf_dir, "documents"), texts=False)
