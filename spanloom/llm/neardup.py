"""Near-duplicate documents by SimHash of five-word shingles and deletion-variant signatures, for the pipeline."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, lean_group, stash, trim, unstash
from .components import connected_components
from .linededup import SKETCH_BITS, join_all, sketch

#: Words in a shingle; a text of fewer words is one shingle.
WIDTH = 5
#: Texts of this Jaccard similarity, as a fraction, are near copies.
SIMILAR = 4, 5
#: Bits of a fingerprint.  One differs between texts of similarity 0.8 with a probability of 0.15, arccos(0.89) / pi.
BITS = 1024
#: Bits of a segment, and the orders of all bits that are cut into segments: the first whose segments have four values or more
#: for each text.  Texts of similarity 0.8 differ in two bits or more of every segment with probability 3e-7 to 6e-7,
#: by calculation with bits that are independent.
SEGMENTS = (20, 2), (24, 5), (28, 12), (32, 28)
#: The first segments: what they link is not compared again.
FIRST = 8
#: The first bits of two fingerprints that are looked at beside a segment, and in how many of them near copies may differ:
#: texts of similarity 0.8 differ in more with probability 2e-7, unlike ones in no more with 6e-5.
CHECKED, RADIUS = 128, 42
#: Texts of one value of a segment that are paired; those of a value that more have are one bucket.
WIDE = 8
#: Texts that a task compares by one half of a segment.
TEXTS = 400_000
#: Sets of up to so many shingles also have the sets with one shingle deleted as signatures: their bits differ more often.
SMALL = 9
#: Distinct words that a worker remembers.
REMEMBERED = 100_000
#: Texts whose shingles are held at once, and pieces of 255 shingles at most whose bits are.
SLICE, PIECES = 200, 128
#: Texts of a bucket that are compared in one go.
BLOCK = 1024

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
#: A text at one segment: its bits there, the logarithm of its number of shingles to 1.05, the bits that are checked, its name.
_ROW = np.dtype([("bits", "<u4"), ("size", "u1"), ("check", "<u8", CHECKED // 64), ("h", "<i8")])


class Words(dict):
    """Hashes of words."""

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = code = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return code


def shingle_set(text: str | None, words: Words) -> np.ndarray:
    """The distinct 64-bit hashes of the text's shingles, in order; a null or blank text has the one hash 0."""
    said = (text or "").lower().split()
    if not said:
        return np.zeros(1, np.uint64)
    code = np.fromiter(map(words.__getitem__, said), np.uint64, len(said))
    width = min(WIDTH, len(code))
    h = np.zeros(len(code) - width + 1, np.uint64)
    for i in range(width):
        h *= _MIX[0]
        h += code[i : i + len(h)]
    h ^= h >> np.uint64(31)
    h *= _MIX[1]
    return np.unique(h)


def _name(shingles: np.ndarray) -> int:
    h = xxhash.xxh64_intdigest(shingles.tobytes())
    return h - (1 << 64) if h >> 63 else h


def _mixed(h: np.ndarray) -> np.ndarray:
    """``h`` (changed) as 64 bits that look like chance."""
    for shift, factor in ((30, _MIX[1]), (27, _MIX[3])):
        h ^= h >> np.uint64(shift)
        h *= factor
    h ^= h >> np.uint64(31)
    return h


def bits_of(shingles: np.ndarray) -> np.ndarray:
    """A row of ``BITS`` / 64 words for each shingle."""
    return _mixed(shingles[:, None] + np.arange(1, BITS // 64 + 1, dtype=np.uint64) * _MIX[0])


def fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """A row of ``BITS`` / 8 bytes for each set of shingles: the bits that more than half of its shingles have.

    A bit that just half of them have is that of the least shingle.
    """
    h, sizes = np.concatenate(sets), np.fromiter(map(len, sets), np.int64, len(sets))
    ends = np.cumsum(sizes)
    pieces = -(-sizes // 255)
    first = np.cumsum(pieces) - pieces
    starts = np.repeat(ends - sizes, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(first, pieces))
    counts = np.zeros((len(starts), BITS // 8, 8), np.uint8)
    for k in range(0, len(starts), PIECES):
        at = starts[k : k + PIECES]
        words = bits_of(h[at[0] : starts[k + PIECES] if k + PIECES < len(starts) else len(h)])
        for i in range(8):  # eight counters in a word
            lanes = np.add.reduceat(words >> np.uint64(i) & np.uint64(0x0101010101010101), at - at[0], axis=0)
            counts[k : k + PIECES, :, i] = lanes.view(np.uint8)
    total = np.add.reduceat(counts.reshape(-1, BITS), first, axis=0, dtype=np.int32)
    least = np.unpackbits(bits_of(h[ends - sizes]).view(np.uint8), axis=1, bitorder="little")
    return np.packbits(2 * total + least > sizes[:, None], axis=1, bitorder="little")


def _without_one(shingles: np.ndarray) -> list[int]:
    """The names of a small set and of all sets with one of its shingles deleted."""
    if not 4 <= len(shingles) <= SMALL:
        return []
    return [_name(shingles), *(_name(np.delete(shingles, i)) for i in range(len(shingles)))]


def _signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, t, s): for each row a hash of its text; name, size, fingerprint and deletion variants of its set of shingles."""

    @F.pandas_udf("struct<h: long, n: int, bits: binary, less: array<long>>")
    def sign(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        words = Words()
        for texts in batches:
            out = []
            for start in range(0, len(texts), SLICE):
                sets = [shingle_set(t, words) for t in texts.iloc[start : start + SLICE]]
                out += [(_name(s), len(s), bits.tobytes(), _without_one(s)) for s, bits in zip(sets, fingerprints(sets))]
            yield pd.DataFrame(out, columns=["h", "n", "bits", "less"])
        del words
        trim()

    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t"), sign(text_col).alias("s"))


def segments(bits: np.ndarray, width: int, order: int, start: int, end: int) -> np.ndarray:
    """(texts, segments): the values of segments ``start`` .. ``end`` - 1 of one order of the bits of fingerprints."""
    places = np.arange(BITS) if not order else np.random.default_rng(order).permutation(BITS)
    each = np.unpackbits(bits, axis=1, bitorder="little")[:, places[start * width : end * width]]
    return each.reshape(-1, end - start, width) @ (1 << np.arange(width, dtype=np.int64))


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def _clusters(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least number that each of 0 .. n - 1 reaches by the edges (u, v)."""
    label = np.arange(n)
    while True:
        a, b = label[u], label[v]
        if (a == b).all():
            return label
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]


def meet(rows: np.ndarray, width: int, whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, text): texts of ``rows`` (of ``_ROW``) joined by those that differ in one bit of a segment's lower half, and in no other.

    Values of the segment that have one bit deleted are sorted: equal neighbours are values a bit apart.  Texts of
    them are joined if sizes and checked bits allow near copies; of values that more than ``WIDE`` texts have, all.
    If ``whole``, texts that differ in no bit are joined as well.  Texts that none is joined to stay out.
    """
    by = np.argsort(rows["bits"], kind="stable")
    rows = rows[by]
    values, first, count = np.unique(rows["bits"], return_index=True, return_counts=True)
    several = np.flatnonzero(count > 1) if whole else np.zeros(0, np.int64)
    xs, ys = [several], [several]
    for i in range(width // 2):
        deleted = values & ~np.uint32(1 << i)
        order = np.argsort(deleted, kind="stable")
        deleted = deleted[order]
        same = np.flatnonzero(deleted[1:] == deleted[:-1])
        xs.append(order[same])
        ys.append(order[same + 1])
    x, y = np.concatenate(xs), np.concatenate(ys)
    wide = np.maximum(count[x], count[y]) > WIDE
    u, v = [], []
    for z in (x[wide], y[wide]):
        u.append(np.repeat(first[x[wide]], count[z]))
        v.append(_ranges(first[z], count[z]))
    x, y = x[~wide], y[~wide]
    for k in range(0, len(x), 1 << 16):
        a, b = x[k : k + (1 << 16)], y[k : k + (1 << 16)]
        n = count[a] * count[b]
        at, each = _ranges(np.zeros(len(a), np.int64), n), np.repeat(np.arange(len(a)), n)
        i, j = first[a][each] + at // count[b][each], first[b][each] + at % count[b][each]
        # sizes of near copies differ by a factor of 1.25 at most, which is under 1.05 ** 5
        near = (i != j) & (np.abs(rows["size"][i].astype(np.int16) - rows["size"][j]) <= 5)
        i, j = i[near], j[near]
        near = np.bitwise_count(rows["check"][i] ^ rows["check"][j]).sum(axis=1) <= RADIUS
        u.append(i[near])
        v.append(j[near])
    label = _clusters(len(rows), np.concatenate(u), np.concatenate(v))
    joined = np.bincount(label, minlength=len(label))[label] > 1
    return label[joined], rows["h"][joined]


def candidates(reps: DataFrame, width: int, order: int, start: int, end: int, splits: int) -> DataFrame:
    """(key, h): buckets of the texts of ``reps`` (h, n, bits) that share a segment of ``start`` .. ``end`` - 1 but for one bit.

    Two such texts share one half of the segment and differ in one bit at most of the other: each half deals the
    texts, the one-wildcard variants of the other half meet where they are dealt to.
    """
    half = width // 2
    low = (1 << half) - 1

    def deal(batches):
        for b in batches:
            rows = np.zeros(len(b), _ROW)
            bits = np.frombuffer(b"".join(b["bits"]), np.uint8).reshape(len(b), -1)
            rows["h"], rows["check"] = b["h"], bits[:, : CHECKED // 8].copy().view("<u8")
            rows["size"] = np.minimum(np.log(b["n"]) / np.log(1.05), 255)
            for s, own in enumerate(segments(bits, width, order, start, end).T, start):
                out = []
                for side, value in enumerate((own, own >> half | (own & low) << half)):
                    rows["bits"] = value
                    split = (value >> half) * splits >> half
                    out += [((s * 2 + side) * splits + k, rows[split == k].tobytes()) for k in np.unique(split)]
                yield pd.DataFrame(out, columns=["part", "texts"])

    def join(b: pd.DataFrame) -> pd.DataFrame:
        part = int(b["part"].iloc[0])
        cluster, h = meet(np.frombuffer(b"".join(b["texts"]), _ROW), width, whole=part // splits % 2 == 0)
        key = _mixed(cluster.astype(np.uint64) + np.uint64((order << 24) + part << 32))
        return pd.DataFrame({"key": key.view(np.int64), "h": h})

    dealt = reps.select("h", "n", "bits").mapInPandas(lean(deal), "part long, texts binary")
    return dealt.groupBy("part").applyInPandas(lean_group(join), "key long, h long")


def buckets(keys: DataFrame) -> DataFrame:
    """(key, h): the texts that share a key with another; of buckets with the same texts only one."""
    sizes = keys.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("h")).alias("x"), F.bit_xor(F.xxhash64("h", F.lit(1))).alias("y"))
    chosen = sizes.where("n > 1").groupBy("n", "x", "y").agg(F.min("key").alias("key"))
    return keys.join(chosen.select("key"), "key", "left_semi").select("key", "h")


def apart(members: DataFrame, named: DataFrame) -> DataFrame:
    """The buckets of ``members`` that are not all in one component of ``named`` (id, component)."""
    each = members.join(named.withColumnRenamed("id", "h"), "h", "left").select("key", F.coalesce("component", "h").alias("c"))
    several = each.groupBy("key").agg((F.min("c") < F.max("c")).alias("several")).where("several")
    return members.join(several.select("key"), "key", "left_semi")


def suspects(reps: DataFrame) -> list[DataFrame]:
    """Two tables (key, h) of buckets in which near copies meet, that of the ``FIRST`` segments and that of the others."""
    n = reps.count()
    width, orders = next((s for s in SEGMENTS if 1 << s[0] >= 4 * n), SEGMENTS[-1])
    splits = 1
    while splits * TEXTS < n:
        splits *= 2
    most = BITS // width
    # sets of fewer shingles have no near copy but equal sets
    large = reps.where("n >= 4")
    rounds = [(0, 0, FIRST), (0, FIRST, most), *((k, 0, most) for k in range(1, orders))]
    found = [stash(candidates(large, width, *r, splits), "candidates") for r in rounds]
    less = reps.where("size(less) > 0").select(F.explode("less").alias("key"), "h").distinct()
    out = [stash(buckets(k), "members") for k in (found[0].unionByName(less), reduce(DataFrame.unionByName, found[1:]))]
    unstash(*found)
    return out


def _sets_of(docs: DataFrame, wanted: DataFrame, text_col: str) -> DataFrame:
    """(h, shingles) for at least the texts whose hash is in ``wanted`` (t), each once."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch(wanted.select("t"), "t"))

    def pick(batches):
        words = Words()
        for b in batches:
            t = b["t"].to_numpy(np.int64)
            at = t & ((1 << SKETCH_BITS) - 1)
            b = b[(shared.value[at >> 6] >> (at & 63)) & 1 == 1].drop_duplicates("t")
            sets = [shingle_set(x, words) for x in b["text"]]
            yield pd.DataFrame({"h": np.array([_name(s) for s in sets], np.int64), "shingles": [s.tobytes() for s in sets]})

    picked = docs.select(F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text")).mapInPandas(lean(pick), "h long, shingles binary")
    return picked.groupBy("h").agg(F.first("shingles").alias("shingles"))


def linked(sets: list[np.ndarray], side: list[int] | None = None) -> list[tuple[int, int]]:
    """Pairs of sets of a Jaccard similarity of ``SIMILAR`` or more, enough of them to join all that are linked."""
    part, whole = SIMILAR

    def close(x: int, y: int) -> bool:
        a, b = sets[x], sets[y]
        if whole * min(len(a), len(b)) < part * max(len(a), len(b)):
            return False
        common = len(np.intersect1d(a, b, assume_unique=True))
        return whole * common >= part * (len(a) + len(b) - common)

    return join_all(len(sets), close, side)


def links(members: DataFrame, sets: DataFrame, block: int = BLOCK) -> DataFrame:
    """(u, v): near copies that share a bucket, enough to join all that are linked.

    Larger buckets than ``block`` are cut, and each two of their blocks meet.
    """
    parts = 8 * int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    large = members.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block)
    cut = members.join(large, "key", "left").withColumn("blocks", F.coalesce(F.ceil(F.col("n") / block), F.lit(1)).cast("int"))
    cut = cut.withColumn("own", F.pmod(F.xxhash64("h"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cut = cut.select("key", "h", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    rows = cut.join(sets, "h").withColumn("part", F.pmod(F.xxhash64("key", "i", "j"), F.lit(parts)))

    def verify(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["key", "i", "j", "h"])
        place = b[["key", "i", "j"]].to_numpy(np.int64)
        new = np.ones(len(b), bool)
        new[1:] = (place[1:] != place[:-1]).any(axis=1)
        starts = np.append(np.flatnonzero(new), len(b))
        h, own, out = b["h"].to_numpy(np.int64), b["own"].to_numpy(), []
        found = [np.frombuffer(x, np.uint64) for x in b["shingles"]]
        for s, e in zip(starts, starts[1:]):
            side = None if place[s, 1] == place[s, 2] else own[s:e].tolist()
            out += [(h[s + x], h[s + y]) for x, y in linked(found[s:e], side)]
        pairs = np.array(out, np.int64).reshape(-1, 2)
        return pd.DataFrame({"u": pairs.min(axis=1), "v": pairs.max(axis=1)})

    return rows.groupBy("part").applyInPandas(lean_group(verify), "u long, v long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component): component is the least id that links of near copies reach.

    Words are what white space parts, in lower case.  Two texts are linked if their sets of five-word shingles,
    told apart by 64-bit hashes, have a Jaccard similarity of 0.8 or more.  Candidates have SimHash fingerprints
    that share a segment with one bit deleted, and small sets a set with one shingle deleted; every one is verified
    on the whole sets.  One row per row of ``docs``; null and blank texts are alike; a null id is never a
    component's name unless nothing else is in it; an empty table gives an empty one.
    """
    signed = stash(_signatures(docs, id_col, text_col), "signatures")
    rows = signed.select("id", "t", "s.*")
    firsts = [F.first(c).alias(c) for c in ("n", "bits", "less")]
    reps = stash(rows.groupBy("h").agg(F.min("id").alias("rep"), F.min("t").alias("t"), *firsts), "reps")
    first, others = suspects(reps)
    wanted = reps.join(first.select("h").union(others.select("h")).distinct(), "h", "left_semi")
    sets = stash(_sets_of(docs, wanted, text_col), "sets")
    pairs = stash(links(first, sets), "links")
    named = stash(connected_components(pairs), "named")
    more = stash(links(apart(others, named), sets), "links")
    unstash(first, others, sets, named)
    linked = connected_components(pairs.unionByName(more)).select(F.col("id").alias("h"), F.col("component").alias("root"))
    linked = stash(linked.join(reps.select("h", "rep"), "h"), "linked")
    least = stash(linked.groupBy("root").agg(F.min("rep").alias("component")), "least")
    linked = linked.join(least, "root").select("h", "component")
    named = reps.join(linked, "h", "left").select("h", F.coalesce("component", "rep").alias("component"))
    return rows.join(named, "h").select("id", "component")


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document for each component, that of smallest id; rows without an id stay.

    Rows that repeat a kept id stay as well, as they are one document to this operator.  Only the ids that go
    are moved to meet the documents.
    """
    found = near_duplicates(docs, id_col, text_col)
    kept = found.where("id = component").select("id").distinct()
    gone = found.where("id <> component").select("id").distinct().join(kept, "id", "left_anti")
    return docs.join(gone.withColumnRenamed("id", id_col), id_col, "left_anti").select(docs.columns)
