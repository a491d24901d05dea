"""Near duplicates by SimHash, found through deletion-variant signatures.

A fingerprint's 64 bits are cut into so few segments that, of two fingerprints within the radius, one segment differs
by one bit at most (radius 4: three segments). Each fingerprint is indexed under every variant of every segment that
leaves out one bit; two fingerprints with such a segment share the variant that leaves out the differing bit. An
equality join on the variants brings candidates together and the full fingerprints verify them.

Fingerprints enter the index once, however many documents have them. A pair is linked only under the first variant that
it shares, and a task keeps only as many links as hold together what is linked in its buckets, so neither copies nor
dense clusters multiply into pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import Groups, connected_components
from .common import in_arrow, materialise, table, word_blocks

_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)

#: Buckets of up to so many fingerprints are compared side by side; larger ones one fingerprint against all others.
SMALL = 16
MIDDLE = 1024
#: From so many on, a bucket is first cut by the bits outside its segment.
LARGE = 4096


#: A digest of a shingle and its length in bytes.
Digest = tuple[Callable[[bytes], bytes], int]


def _xxh64(seed: int) -> Digest:
    return (lambda shingle: xxhash.xxh64_digest(shingle, seed)), 8


def votes(text: str | None, shingle: int, digests: list[Digest]) -> tuple[list[int], int]:
    """A fingerprint of 64 bits from every 8 bytes of the digests (bit i is set if it is set in over half of the shingles' hashes), and the number of shingles."""
    width = sum(w for _, w in digests)
    counts, n, tail = np.zeros(8 * width, np.int64), 0, []
    for block in word_blocks((text or "").encode().lower()):  # bytes.lower() changes A-Z alone
        block = tail + block
        if len(block) >= shingle:
            joined, ends = b" ".join(block), list(itertools.accumulate(map(len, block), lambda a, b: a + b + 1))
            starts = [0, *(e + 1 for e in ends)]
            shingles = [joined[a:b] for a, b in zip(starts, ends[shingle - 1 :], strict=False)]
            n += len(shingles)
            at = 0
            for digest, w in digests:
                by_byte = np.frombuffer(b"".join(map(digest, shingles)), np.uint8).reshape(-1, w)
                found = np.bincount((by_byte + 256 * np.arange(w)).ravel(), minlength=256 * w).reshape(w, 256) @ _BYTE_BITS
                counts[at : at + 8 * w] += found.ravel()
                at += 8 * w
        tail = block[max(0, len(block) - shingle + 1) :] if shingle > 1 else []
    if not n and tail:  # fewer words than a shingle has: the whole sequence
        data, n = b"".join(digest(b" ".join(tail)) for digest, _ in digests), 1
    else:
        data = np.packbits(2 * counts > n).tobytes()
    return [int.from_bytes(data[i : i + 8], "big") for i in range(0, width, 8)], n


def fingerprint(text: str | None, shingle: int, seed: int = 42) -> int:
    """By the XXH64 of the shingles, repeats included; 0 for a text without words."""
    return votes(text, shingle, [_xxh64(seed)])[0][0]


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), shingle) for t in batch.column("text")], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp) of every row of docs; fp holds the 64 bits as a signed long."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(in_arrow(_fingerprints(shingle), "doc_id long, fp long"))


def cuts(n: int) -> list[tuple[int, int]]:
    """(lowest bit, bits) of n segments of 64 bits."""
    at = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in itertools.pairwise(at)]


def segments(radius: int) -> list[tuple[int, int]]:
    """The fewest segments of which one must differ by one bit at most within the radius."""
    return cuts(max(2, radius // 2 + 1))


def variants(fp: Column, cut: list[tuple[int, int]]) -> list[Column]:
    """One key for each bit: its number above, and below the bit's segment without that bit."""
    keys = []
    for low, n in cut:
        for bit in range(n):
            kept = F.lit(((1 << n) - 1) & ~(1 << bit))
            keys.append(F.shiftrightunsigned(fp, low).bitwiseAND(kept).bitwiseOR(F.lit((low + bit) << 48)))
    return keys


class _Linker:
    """Links within buckets of one key, each a sorted run of distinct fingerprints."""

    def __init__(self, radius: int):
        self.radius = radius
        self.cut = segments(radius)
        self.masks = [np.uint64(((1 << n) - 1) << low) for low, n in self.cut]

    def linked(self, a: np.ndarray, b, bit) -> np.ndarray:
        """True where a and b are within the radius and this is the first variant that they share (bit: the one left out)."""
        x = a ^ b
        near = np.bitwise_count(x) <= self.radius
        if not near.any():
            return near
        at = np.flatnonzero(near)
        x, bit = x[at], (bit[at] if isinstance(bit, np.ndarray) else np.full(len(at), bit))
        first = np.full(len(at), -1)
        for (low, _), mask in zip(self.cut, self.masks, strict=True):
            part = x & mask
            one = (np.bitwise_count(part) <= 1) & (first < 0)
            first[one] = np.where(part[one] == 0, low, np.log2(np.maximum(part[one], np.uint64(1)).astype(np.float64)).astype(np.int64))
        near[at] = first == bit
        return near

    def forest(self, fps: np.ndarray, bit: int, cut: bool = True) -> tuple[list, list]:
        """As many links of a bucket as join everything that is linked in it."""
        a, b = [], []
        if cut and len(fps) > LARGE:  # of radius + 1 pieces of the other bits, two near fingerprints share one
            low, n = next(s for s in self.cut if s[0] <= bit < s[0] + s[1])
            others = [i for i in range(64) if not low <= i < low + n]
            for k in range(self.radius + 1):
                piece = np.uint64(sum(1 << i for i in others[k :: self.radius + 1]))
                order = np.argsort(fps & piece, kind="stable")
                value = (fps & piece)[order]
                for run in np.split(fps[order], np.flatnonzero(value[1:] != value[:-1]) + 1):
                    if len(run) > 1:
                        x, y = self.forest(run, bit, False)
                        a += x
                        b += y
            return a, b
        if len(fps) <= MIDDLE:  # side by side, unless so much is linked that a few links hold it together
            i, j = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= self.radius, 1))
            if len(i) <= 4 * len(fps):
                hit = self.linked(fps[i], fps[j], np.full(len(i), bit))
                return [fps[i[hit]]], [fps[j[hit]]]
        left = fps
        while len(left) > 1:
            frontier, left = [left[0]], left[1:]
            while frontier and len(left):
                u = frontier.pop()
                if (hit := self.linked(left, u, bit)).any():
                    new, left = left[hit], left[~hit]
                    a.append(np.full(len(new), u))
                    b.append(new)
                    frontier.extend(new)
        return a, b

    def links(self, keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links of whole buckets; keys is sorted."""
        a, b = [], []
        edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
        size = np.repeat(np.diff(edges), np.diff(edges))
        few = (size > 1) & (size <= SMALL)
        k, f, bits = keys[few], fps[few], keys[few] >> 48
        for d in range(1, SMALL):
            if not len(pair := np.flatnonzero(k[d:] == k[:-d])):
                break
            hit = pair[self.linked(f[pair], f[pair + d], bits[pair])]
            a.append(f[hit])
            b.append(f[hit + d])
        for i in np.flatnonzero(np.diff(edges) > SMALL):
            x, y = self.forest(fps[edges[i] : edges[i + 1]], int(keys[edges[i]]) >> 48)
            a += x
            b += y
        empty = np.zeros(0, np.uint64)
        return np.concatenate([empty, *a]), np.concatenate([empty, *b])


def _link(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        linker, groups = _Linker(radius), Groups()
        kept_keys, kept_fps = [], []  # the bucket that is still open

        def out(keys, fps):
            a, b = linker.links(keys, fps)
            new = np.array([groups.join(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True)], bool)
            a, b = a[new], b[new]
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["src", "dst"])

        for batch in batches:
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(keys):
                continue
            last = int(np.searchsorted(keys, keys[-1], "left"))
            if last == 0 and kept_keys and kept_keys[-1][-1] == keys[-1]:
                kept_keys.append(keys)
                kept_fps.append(fps)
                continue
            yield out(np.concatenate([*kept_keys, keys[:last]]), np.concatenate([*kept_fps, fps[:last]]))
            kept_keys, kept_fps = [keys[last:]], [fps[last:]]
        if kept_keys:
            yield out(np.concatenate(kept_keys), np.concatenate(kept_fps))

    return run


def links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """(src, dst): links between distinct fingerprints that hold together whatever is linked within the radius.

    fps: a column fp of distinct fingerprints.
    """
    indexed = fps.select("fp", F.explode(F.array(*variants(F.col("fp"), segments(radius)))).alias("key"))
    return indexed.select("key", "fp").repartition("key").sortWithinPartitions("key").transform(in_arrow(_link(radius), "src long, dst long")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fp, component_id: one row for each row of docs (columns doc_id, text; others are not looked at).

    component_id is the smallest doc_id that can be reached over links, the document itself included. A null text has
    no words; texts without words share fingerprint 0, linked like any other. A null doc_id takes part, but is never
    a component_id unless the component has no other. Repeated rows are all returned; an empty table gives none.
    """
    each = materialise(fingerprints(docs, shingle), "fingerprints")
    distinct = each.groupBy("fp").agg(F.min("doc_id").alias("least"))
    parts = connected_components(links(distinct.select("fp"), radius)).withColumnRenamed("id", "fp")
    linked = distinct.join(parts, "fp")
    least = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    of_linked = linked.select("fp", "component").join(least, "component").select("fp", F.col("component_id").alias("over_links"))
    known = distinct.join(of_linked, "fp", "left").select("fp", F.coalesce("over_links", "least").alias("component_id"))
    return each.join(known, "fp").select("doc_id", "fp", "component_id")


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10_simhash."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")
