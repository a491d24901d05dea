"""One document of each group of near copies.

Candidates come from SimHash: each text has several independent fingerprints, each is indexed under the deletion variants of
its segments (see simhash.py), and texts that share a variant are candidates if all their fingerprints together
differ by few bits. Only for candidates the exact similarity, shared shingles over joint shingles, is computed. Texts
with enough of it are linked, and of what is linked together one text stays.

What is a candidate of what is held as a forest, so that a group of copies never becomes a list of its pairs. Its trees are
then verified in blocks of bounded size:

1. each block for itself, by one task, in which a text that has found its group isn't compared within it again;
2. of trees that fill several blocks, one text for each group of a block, in the same way;
3. whatever is still outside a tree's largest group, with every block of the tree.

Two texts are left uncompared only if they are in one group already, so no link between candidates is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import Groups, connected_components
from .common import gathered, in_arrow, in_slices, materialise, small, word_blocks
from .simhash import Digest, cuts, variants, votes

#: Buckets of up to so many prints are compared side by side; larger ones one print against all that aren't linked yet.
SMALL = 16
#: Texts and shingles of a block, on average.
BLOCK_TEXTS = 400
BLOCK_SHINGLES = 1_000_000
#: Rows of keys (some 100 bytes each) up to which they are broadcast to where the texts are; beyond, the texts are shuffled.
FEW_KEYS = 200_000


def independent(tables: int) -> list[Digest]:
    """Digests for so many fingerprints: two from each 128 bits, an odd one from 64."""
    found = [((lambda shingle, seed=seed: xxhash.xxh3_128_digest(shingle, seed)), 16) for seed in range(tables // 2)]
    return found + [((lambda shingle: xxhash.xxh3_64_digest(shingle, 10_007)), 8)] * (tables % 2)


def _turned(x, by: int):
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by)) if by else x


def _turns(tables: int) -> list[int]:
    return [64 * t // tables for t in range(tables)]


def node_of(prints: np.ndarray) -> np.ndarray:
    """One number for all fingerprints of a text; prints: a row each."""
    out = np.zeros(len(prints), np.uint64)
    for t, by in enumerate(_turns(prints.shape[1])):
        out ^= _turned(prints[:, t], by)
    return out.view(np.int64)


def _node(prints: list[str]) -> Column:
    """node_of() as an expression."""
    out = F.lit(0).cast("long")
    for p, by in zip(prints, _turns(len(prints)), strict=True):
        x = F.col(p)
        out = out.bitwiseXOR(F.shiftleft(x, by).bitwiseOR(F.shiftrightunsigned(x, 64 - by)) if by else x)
    return out


def _prints(shingle: int, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests, names = independent(tables), [f"fp{t}" for t in range(tables)]
        for batch in batches:
            found = [votes(t.as_py(), shingle, digests) for t in batch.column("text")]
            fps = np.array([f[0] for f in found], np.uint64).reshape(-1, tables)
            columns = [pa.array(np.ascontiguousarray(fps[:, t]).view(np.int64)) for t in range(tables)]
            yield pa.RecordBatch.from_arrays([batch.column("d"), batch.column("digest"), pa.array([f[1] for f in found], pa.int64()), *columns], names=["d", "digest", "size", *names])

    return run


def whole_keys(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[np.ndarray]]:
    """Columns of batches that are sorted by the first of names, cut so that the rows of a key stay together."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        last = int(np.searchsorted(now[0], now[0][-1], "left"))
        if last == 0 and held and held[-1][0][-1] == now[0][-1]:
            held.append(now)
            continue
        yield [np.concatenate(x) for x in zip(*held, [c[:last] for c in now], strict=True)]
        held = [[c[last:] for c in now]]
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def near_in_buckets(keys: np.ndarray, prints: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows that hold together whatever lies within the distance in a bucket; keys is sorted."""

    def far(a, b):
        return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64) > distance

    edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]])) if len(keys) else np.zeros(1, np.int64)
    size = np.diff(edges)
    few = np.flatnonzero(np.repeat((size > 1) & (size <= SMALL), size))
    for d in range(1, SMALL):
        pair = few[d:][keys[few[d:]] == keys[few[:-d]]] if len(few) > d else few[:0]
        if not len(pair):
            break
        hit = pair[~far(prints[pair], prints[pair - d])]
        yield hit - d, hit
    for i in np.flatnonzero(size > SMALL):
        left = np.arange(edges[i], edges[i + 1])
        while len(left) > 1:
            frontier, left = [left[0]], left[1:]
            while frontier and len(left):
                u = frontier.pop()
                apart = far(prints[left], prints[u])
                new, left = left[~apart], left[apart]
                yield np.full(len(new), u), new
                frontier.extend(new)


def _candidates(prints: list[str], distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = Groups()
        for keys, *columns in whole_keys(batches, ["key", *prints]):
            rows = np.stack([c.view(np.uint64) for c in columns], axis=1)
            nodes = node_of(rows).tolist()
            for a, b in near_in_buckets(keys, rows, distance):
                for x, y in zip(a.tolist(), b.tolist(), strict=True):
                    groups.join(nodes[x], nodes[y])
        yield from groups.stars(["src", "dst"])  # the tasks that see a group mostly name it alike, so these links are few

    return run


def candidate_links(texts: DataFrame, prints: list[str], segments: int, distance: int) -> DataFrame:
    """(src, dst): nodes of texts, each with one that it hangs together with, so that candidates hold together. A node that several texts have is linked to itself."""
    nodes = texts.groupBy("node").agg(*[F.first(p).alias(p) for p in prints], F.count("*").alias("n"))
    keys = []
    for t, p in enumerate(prints):
        keys += [k.bitwiseOR(F.lit(t << 54)) for k in variants(F.col(p), cuts(segments))]
    index = nodes.select(F.explode(F.array(*keys)).alias("key"), *prints)
    near = index.repartition("key").sortWithinPartitions("key").transform(in_arrow(_candidates(prints, distance), "src long, dst long"))
    same = nodes.filter("n > 1").select(F.col("node").alias("src"), F.col("node").alias("dst"))
    return near.union(same)


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles."""
    found, tail, any_ = [], [], False
    for block in word_blocks((text or "").encode().lower()):
        block = tail + block
        if len(block) >= shingle:
            any_ = True
            found.append(np.unique(np.array([xxhash.xxh3_64_intdigest(b" ".join(block[i : i + shingle])) for i in range(len(block) - shingle + 1)], np.uint64)))
        tail = block[max(0, len(block) - shingle + 1) :] if shingle > 1 else []
    if not any_ and tail:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(tail))], np.uint64)
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts cross the shuffle compressed document by document."""
    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in in_slices(batches):
        texts = pa.array([pack(t.as_py().encode()) for t in batch.column("text")], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("d"), batch.column("digest"), texts], names=["d", "digest", "packed"])


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in in_slices(batches):
            sets = pa.array([shingle_set(unpack(t.as_py()).decode(), shingle).view(np.int64) for t in batch.column("packed")], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("component", "t", "place")] + [sets], names=["component", "t", "place", "shingles"])

    return run


class Block:
    """Shingle sets side by side; alike() sets one against all of them."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.size = np.array([len(s) for s in sets], np.int64)
        self.ends = np.concatenate([[0], np.cumsum(self.size)])
        self.known, self.ids = np.unique(np.concatenate([np.zeros(0, np.int64), *sets]), return_inverse=True)

    def alike(self, own: np.ndarray, similarity: float) -> np.ndarray:
        """Which sets share enough with this one; two empty sets are alike."""
        held = np.zeros(len(self.known) + 1, bool)
        at = np.searchsorted(self.known, own)
        held[at[np.append(self.known, 0)[at] == own]] = True
        held[-1] = False  # beyond all that is known
        sums = np.concatenate([[0], np.cumsum(held[self.ids])])
        shared = sums[self.ends[1:]] - sums[self.ends[:-1]]
        joint = self.size + len(own) - shared
        return np.where(joint > 0, shared / np.maximum(joint, 1) >= similarity, True)

    def groups(self, similarity: float) -> np.ndarray:
        """For each set, the number of the first one of its group."""
        name, left = np.arange(len(self.sets)), np.arange(len(self.sets))
        while len(left):
            lead, left, frontier = left[0], left[1:], [left[0]]
            while frontier and len(left):
                hit = self.alike(self.sets[frontier.pop()], similarity)[left]
                frontier.extend(left[hit])
                name[left[hit]] = lead
                left = left[~hit]
        return name


def _within(similarity: float):
    """Of each block, texts in order of place: with the first text of the group that each is in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of = [], None

        def out():
            name = Block([s for _, s in held]).groups(similarity)
            t = np.array([x for x, _ in held], np.int64)
            return pa.RecordBatch.from_arrays([pa.array(t), pa.array(t[name])], names=["t", "label"])

        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("component", "block", "t")), batch.column("shingles"), strict=True)
            for component, block, t, own in rows:
                if of != (component, block):
                    if held:
                        yield out()
                    held, of = [], (component, block)
                held.append((t, own.values.to_numpy()))
        if held:
            yield out()

    return run


def _across(similarity: float):
    """Of each block, its own texts first (side 0), then others: links of those to texts with another label, one a label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of, block = [], None, None
        for batch in batches:
            found = []
            rows = zip(*(batch.column(c).to_pylist() for c in ("component", "block", "side", "t", "label")), batch.column("shingles"), strict=True)
            for component, number, side, t, label, own in rows:
                if of != (component, number):
                    held, of, block = [], (component, number), None
                if side == 0:
                    held.append((t, label, own.values.to_numpy()))
                    continue
                if block is None:
                    block = Block([s for _, _, s in held])
                    ids, labels = (np.array([x[i] for x in held], np.int64) for i in (0, 1))
                if held:
                    hit = np.flatnonzero(block.alike(own.values.to_numpy(), similarity) & (labels != label))
                    _, first = np.unique(labels[hit], return_index=True)
                    found += [(t, int(ids[hit[i]])) for i in first]
            src, dst = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["t", "label"])

    return run


def _labelled(links: DataFrame, rows: int) -> DataFrame:
    return connected_components(links, "t", "label", rows).select(F.col("id").alias("t"), F.col("component").alias("label"))


def groups_within(sets: DataFrame, similarity: float, level: int = 0) -> DataFrame:
    """(t, label): the texts of sets (component, t, place, shingles), those with one label linked together within their component.

    level: 0 for all texts; deeper ones take one text for each group of a block, as a short cut, and leave step 3 out.
    """
    sized = sets.groupBy("component").agg(F.count("*").alias("n"), F.sum(F.size("shingles").cast("long")).alias("s"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_TEXTS), F.ceil(F.col("s") / BLOCK_SHINGLES), F.lit(1).cast("long")).alias("blocks")
    large = sized.select("component", blocks).filter("blocks > 1")
    some, rows = large.count(), sets.count()
    nth = F.pmod(F.xxhash64("t", F.lit(level)), F.coalesce("blocks", F.lit(1).cast("long")))
    dealt = sets.join(small(large, some, FEW_KEYS), "component", "left") if some else sets.withColumn("blocks", F.lit(None).cast("long"))
    dealt = dealt.select("component", nth.alias("block"), "t", "place", "shingles", "blocks")
    found = dealt.repartition("component", "block").sortWithinPartitions("component", "block", "place", "t").transform(in_arrow(_within(similarity), "t long, label long"))
    if not some:
        return found
    first = materialise(gathered(found, rows), "blocks")
    whole = dealt.filter("blocks > 1")
    leaders = whole.join(first.filter("t = label").select("t"), "t", "left_semi").select("component", "t", "place", "shingles")
    links = first
    if 2 * leaders.count() <= whole.count():
        links = links.union(groups_within(leaders, similarity, level + 1))
    if level:
        return links
    now = materialise(gathered(whole.select("component", "t").join(_labelled(links, rows), "t"), rows), "labels")
    most = now.groupBy("component", "label").agg(F.count("*").alias("n")).groupBy("component").agg(F.max_by("label", F.struct("n", "label")).alias("most"))
    apart = now.join(small(most, some, FEW_KEYS), "component").filter("label <> most").select("t", "label")
    own = whole.join(now.select("t", "label"), "t").select("component", "block", F.lit(0).alias("side"), "t", "label", "shingles")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")
    others = whole.drop("block").join(apart, "t").select("component", every, F.lit(1).alias("side"), "t", "label", "shingles")
    met = own.union(others).repartition("component", "block").sortWithinPartitions("component", "block", "side", "t")
    return _labelled(links.union(met.transform(in_arrow(_across(similarity), "t long, label long"))), rows)


def one_of_each(docs: DataFrame, shingle: int = 5, tables: int = 3, segments: int = 4, distance: int = 44, similarity: float = 0.8) -> DataFrame:
    """The rows of docs that stay when, of texts that are equal or linked by their similarity, the one with the smallest doc_id stays; all columns as they are.

    Texts are linked if they are candidates and their exact similarity is enough; groups are what hangs together by links. Two
    texts are candidates if one of `tables` * `segments` segments of their fingerprints differs by one bit at most and
    all fingerprints by `distance` bits at most, or over other candidates. At a similarity of 0.8 a bit differs with
    a probability of 0.15: a segment of 16 bits meets with 0.28, one of twelve with 0.98; 192 bits differ by 29 on average, with a
    standard deviation of 5. Buckets hold a part of 2 ** (64 / segments - 1) of the texts: for more than some 100 million distinct
    texts, take fewer segments and more tables.

    Null and empty texts are the same text; texts without words are alike. A null doc_id comes after all others. Of repeated
    rows, and of rows with the same text, the one with the smallest doc_id stays, one row of it. Columns other than
    doc_id and text are passed through, whatever their names. An empty table gives an empty result.
    """
    last, prints = F.lit((1 << 63) - 1), [f"fp{t}" for t in range(tables)]
    own = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), last).alias("d"), F.coalesce("text", F.lit("")).alias("text"))
    own = own.withColumn("digest", F.md5("text"))
    schema = "d long, digest string, size long, " + ", ".join(f"{p} long" for p in prints)
    each = materialise(own.select("d", "digest", "text").transform(in_arrow(_prints(shingle, tables), schema)), "prints")
    texts = each.groupBy("digest", "size", *prints).agg(F.min("d").alias("place")).withColumn("t", F.xxhash64("digest")).withColumn("node", _node(prints))
    n = each.count()
    texts = materialise(gathered(texts, n), "texts")
    parts = connected_components(candidate_links(texts, prints, segments, distance), about=n).withColumnRenamed("id", "node")
    members = materialise(gathered(texts.join(parts, "node").select("component", "digest", F.col("place").alias("d"), "t"), n), "members")
    few = members.count()
    keys = small(members, few, FEW_KEYS)
    carried = own.select("d", "digest", "text").join(keys, ["d", "digest"], "left_semi").transform(in_arrow(_packed, "d long, digest string, packed binary"))
    once = carried.join(keys, ["d", "digest"]).dropDuplicates(["d", "digest"]).select("component", "t", F.col("d").alias("place"), "packed")
    once = once.coalesce(max(1, -(-few // BLOCK_TEXTS)))
    sets = materialise(once.transform(in_arrow(_sets(shingle), "component long, t long, place long, shingles array<long>")), "shingles")
    named = materialise(gathered(groups_within(sets, similarity), few), "groups").join(members.select("t", "digest", "d"), "t")
    first = named.groupBy("label").agg(F.min(F.struct("d", "digest")).alias("first"))
    like = named.join(first, "label").filter(F.struct("d", "digest") != F.col("first")).select("digest").distinct().withColumn("like", F.lit(True))
    verdict = texts.select("digest", "place").join(like, "digest", "left")
    rows = each.groupBy("d", "digest").agg(F.count("*").alias("n")).join(verdict, "digest")
    rows = rows.select("d", "digest", (F.coalesce("like", F.lit(False)) | (F.col("d") != F.col("place"))).alias("goes"), "n").filter("goes OR n > 1")
    rows = materialise(gathered(rows, n), "verdicts")
    gone, again = rows.filter("goes").select("d", "digest"), rows.filter("NOT goes").select("d", "digest")
    many, repeated = gone.count(), again.count()
    stay = own.select("row", "d", "digest").join(small(gone, many, FEW_KEYS), ["d", "digest"], "left_anti")
    if not repeated:
        return stay.select("row.*")
    again = small(again, repeated, FEW_KEYS)
    one = stay.join(again, ["d", "digest"], "left_semi").dropDuplicates(["d", "digest"])
    return stay.join(again, ["d", "digest"], "left_anti").select("row.*").union(one.select("row.*"))
