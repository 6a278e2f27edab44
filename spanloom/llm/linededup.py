"""Fuzzy line deduplication by MinHash (operator 10)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, lean_group, stash, unstash
from .components import connected_components

#: Characters in a shingle, and the least Jaccard similarity of two lines that count as one.
SHINGLE, SIMILAR = 8, 0.8
#: Lines of at most ``FINE_MOST`` characters are compared by shingles of ``FINE`` characters as well, where asked for.
FINE, FINE_MOST = 3, 100
#: Bands and rows of each, by size of shingle: lines of similarity 0.8 share a band with probability 1 - (1 - 0.8**4)**18
#: = 0.99993, and by short shingles, which unlike lines share too, 1 - (1 - 0.8**7)**40 = 0.99992.
BANDS = {SHINGLE: (18, 4), FINE: (40, 7)}
#: Shorter lines, after normalising, have no shingles of ``SHINGLE`` characters; by default they take no part.
MIN_CHARS = 24
#: Arguments with which every line that is not blank takes part: a date or a letter sets no two short lines apart.
EVERY_LINE = {"min_chars": 1, "fine": True}
SEED = 9
_NONE = np.uint64(1 << 32)
#: Bins in which an empty one looks for a full one by chance; after that all full ones are looked at.
TRIES = 40

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def normal(line: str) -> str:
    return " ".join(line.lower().split())


#: White space other than blanks and ends of lines.
_SPACES = [chr(c) for c in range(1 << 16) if chr(c).isspace() and chr(c) not in " \n"]


def normals(text: str) -> list[str]:
    """The text's lines, each as ``normal`` gives it; most texts have no white space that splitting would find."""
    low = text.lower()  # as line by line: no letter's case depends on what stands beyond an end of line
    if "  " in low or any(map(low.__contains__, _SPACES)):
        return [" ".join(line.split()) for line in low.split("\n")]
    return [line.strip(" ") for line in low.split("\n")]


def line_key(norm: str) -> int:
    h = xxhash.xxh64_intdigest(norm.encode("utf-8", "surrogatepass"), SEED)
    return h - (1 << 64) if h >> 63 else h


def _windows(points: np.ndarray, size: int) -> np.ndarray:
    """The polynomial over each window of ``size`` numbers, from those of half its size."""
    if size == 1:
        return points.copy()
    half = size // 2
    h = _windows(points, half)
    power = np.uint64(pow(int(_MIX[0]), half, 1 << 64))
    n = len(points) - 2 * half + 1
    out = h[:n] * power
    out += h[half : half + n]
    if size % 2:
        out = out[:-1] * _MIX[0]
        out += points[size - 1 :]
    return out


def shingle_hashes(norms: list[str], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of the character shingles of all lines, and where each line's begin.

    Lines have ``size`` characters at least.
    """
    points = np.frombuffer("".join(norms).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, norms), np.int64, len(norms))
    h = _windows(points, size)
    h ^= h >> np.uint64(32)
    h *= _MIX[1]
    ends = np.cumsum(sizes)
    inside = np.ones(len(h), bool)
    for i in range(1, size):  # no shingle reaches into the next line
        inside[ends[:-1] - i] = False
    return (h[inside] >> np.uint64(32)).astype(np.uint32), np.concatenate(([0], np.cumsum(sizes - size + 1)[:-1]))


#: Characters that are hashed in one go: few enough for the arrays of a step to stay in a core's cache.
PART = 1 << 16


def band_keys(norms: list[str], size: int = SHINGLE) -> np.ndarray:
    """A row of 64-bit keys for each line, one for each band: odd ones, or even ones of shingles of ``FINE`` characters."""
    bands, rows = BANDS[size]
    keys = np.concatenate([np.zeros((0, bands), np.uint64), *(keys_of(minima(*shingle_hashes(p, size), bands * rows), bands) for p in _parts(norms))])
    return keys >> np.uint64(1) << np.uint64(1) | np.uint64(size != FINE)


def minima(h: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """A row of ``n`` MinHashes for each set of 32-bit hashes, of one permutation that is cut into ``n`` bins.

    Sets begin at ``starts`` and are not empty.  An empty bin takes the least hash of another, the first that is not
    empty in an order of its own, the same for all sets.  So two sets agree in a bin with the probability of their
    similarity, however few hashes they have.
    """
    line = np.repeat(np.arange(len(starts)) * n, np.diff(np.append(starts, len(h))))
    out = np.full(len(starts) * n, _NONE, np.uint64)
    rest = h * np.uint32(0x9E3779B1)
    rest ^= rest >> np.uint32(15)
    rest = (rest * np.uint32(0x85EBCA6B)).astype(np.uint64)
    np.minimum.at(out, line + (h.astype(np.uint64) * np.uint64(n) >> np.uint64(32)).astype(np.int64), rest)
    own, empty = out.copy(), np.flatnonzero(out == _NONE)
    order, place = np.random.default_rng(n), empty % n
    begin = empty - place
    for _ in range(TRIES):
        if not len(empty):
            break
        least = own[begin + order.integers(0, n, n)[place]]
        out[empty] = least
        left = np.flatnonzero(least == _NONE)
        empty, begin, place = empty[left], begin[left], place[left]
    if len(empty):  # of lines with few full bins: the first of these in an order of the bin's own
        full = np.flatnonzero(own != _NONE)
        lo, hi = np.searchsorted(full, begin), np.searchsorted(full, begin + n)
        each = np.repeat(np.arange(len(empty)), hi - lo)
        source = full[np.arange(len(each)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[each]]
        rank = (place[each] * n + (source - begin[each])).astype(np.uint64) * _MIX[1]
        rank ^= rank >> np.uint64(31)
        rank *= _MIX[3]
        first = np.lexsort((rank, each))[np.cumsum(hi - lo) - (hi - lo)]
        out[empty] = own[source[first]]
    return out.reshape(-1, n)


def keys_of(least: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit key for each band of each row of MinHashes."""
    key = np.arange(1, bands + 1, dtype=np.uint64) * _MIX[2]
    for row in np.moveaxis(least.reshape(len(least), bands, -1), 2, 0):
        key = (key ^ row) * _MIX[3]
        key ^= key >> np.uint64(29)
    return key


def shingles(line: str, size: int = SHINGLE) -> frozenset:
    return frozenset([line[i : i + size] for i in range(max(1, len(line) - size + 1))])


def distinct_of(line: str, size: int = SHINGLE) -> frozenset | np.ndarray:
    """The line's ``shingles``, if they are eight bytes of Latin-1 each as sorted integers: these are quicker to compare."""
    if size == 8 <= len(line):
        try:
            raw = line.encode("latin-1")
        except UnicodeEncodeError:
            return shingles(line, size)
        own = np.ndarray(len(raw) - 7, np.uint64, raw, strides=(1,)).copy()
        own.sort()
        new = np.ones(len(own), bool)
        np.not_equal(own[1:], own[:-1], out=new[1:])
        return own[new]
    return shingles(line, size)


#: Bits of the maps that spare most comparisons, a power of two.
MAP_BITS = 1024


def _parts(norms: list[str]):
    """``norms`` in slices of about PART characters, and not of very many lines."""
    part, size = [], 0
    for line in norms:
        if size > PART or len(part) >= PART // 128:
            yield part
            part, size = [], 0
        part.append(line)
        size += len(line)
    if part:
        yield part


def shingle_marks(norms: list[str], size: int = SHINGLE) -> np.ndarray:
    """For each line a row of ``MAP_BITS`` bits, each set if an odd number of its distinct shingles' hashes fall on it.

    Shingles that two lines share change a bit of both, so no more bits differ than there are shingles that one has alone.
    """
    out = [np.zeros((0, MAP_BITS // 64), np.uint64)]
    for part in _parts(norms):
        h, starts = shingle_hashes(part, size)
        both = np.repeat(np.arange(len(part), dtype=np.uint64) << np.uint64(32), np.diff(np.append(starts, len(h))))
        both |= h
        both.sort()
        new = np.ones(len(both), bool)
        new[1:] = both[1:] != both[:-1]
        both = both[new]
        bit = (both >> np.uint64(32)) * np.uint64(MAP_BITS)
        bit += both & np.uint64(MAP_BITS - 1)
        odd = np.bincount(bit.view(np.int64), minlength=len(part) * MAP_BITS).astype(np.uint8) & 1
        out.append(np.packbits(odd.reshape(len(part), MAP_BITS), axis=1, bitorder="little").view(np.uint64))
    return np.concatenate(out)


def shingle_maps(norms: list[str], size: int = SHINGLE) -> list[int]:
    """The rows of ``shingle_marks`` as integers."""
    return [int.from_bytes(row.tobytes(), "little") for row in shingle_marks(norms, size)]


def may_be_alike(differ, most, least: float = SIMILAR):
    """Whether two lines can be of a similarity of ``least``: their maps differ in ``differ`` bits, they have ``most`` shingles at most.

    Of m shingles in both sets together, counted in each, at most (1 - least) / (1 + least) * m are in one set alone.
    """
    return differ * (1 + least) <= (1 - least) * most + 1e-6


def join_all(n: int, close, side: list[int] | None = None, joined: list[int] | None = None) -> list[tuple[int, int]]:
    """Pairs of 0 .. n - 1 for which ``close`` holds, enough of them to join all that such pairs link; see ``linked``.

    Those with equal numbers in ``joined`` are linked already, and none is compared with the first to begin with.
    """
    out = []
    if joined is not None:
        known: dict[int, list[int]] = {}
        for x, name in enumerate(joined):
            known.setdefault(name, []).append(x)
        groups = [*known.values()]
    else:
        groups = [[0]]
        for x in range(1, n):
            if close(0, x):
                groups[0].append(x)
                out.append((0, x))
            else:
                groups.append([x])
    k = 1
    while k < len(groups):  # groups before k are not linked to each other
        mine, kept = groups[k], []
        for other in groups[:k]:
            link = next(((x, y) for x in mine for y in other if (side is None or side[x] != side[y]) and close(x, y)), None)
            if link:
                out.append(link)
                mine = other + mine
            else:
                kept.append(other)
        groups[: k + 1] = [*kept, mine]
        k = len(kept) + 1
    return out


def alike(a: frozenset | np.ndarray, b: frozenset | np.ndarray, least: float = SIMILAR) -> bool:
    """Whether two sets, both as ``distinct_of`` gives them and of one type, are of a Jaccard similarity of ``least``."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    if isinstance(a, np.ndarray):
        both = np.concatenate((a, b))
        both.sort()
        common = int(np.count_nonzero(both[1:] == both[:-1]))
    else:
        common = len(a) - len(a - b)  # the difference is small where it matters
    return common >= least * (len(a) + len(b) - common)


def alike_lines(a: str, b: str, of_a: frozenset | np.ndarray, of_b: frozenset | np.ndarray, size: int, least: float = SIMILAR) -> bool:
    """``alike`` for two lines and their sets, of whatever types these are."""
    if type(of_a) is not type(of_b):
        of_a, of_b = shingles(a, size), shingles(b, size)
    return alike(of_a, of_b, least)


def linked(norms: list[str], maps: list[int], side: list[int] | None = None, least: float = SIMILAR, size: int = SHINGLE, joined: list[int] | None = None) -> list[tuple[int, int]]:
    """Pairs of lines of an exact Jaccard similarity of ``least`` or more, enough of them to join all that are linked.

    All are compared with the first, unless it is known which are ``joined``.  Then lines of different components are,
    until one link joins these: links inside a component change nothing.  Two lines are intersected only if their maps
    allow so high a similarity.  Given ``side``, after the first step only lines of different sides are compared.
    """
    most = [max(1, len(n) - size + 1) for n in norms]
    sets: dict[int, frozenset | np.ndarray] = {}

    def close(x: int, y: int) -> bool:
        if not may_be_alike((maps[x] ^ maps[y]).bit_count(), most[x] + most[y], least):
            return False
        for k in (x, y):
            if k not in sets:
                sets[k] = distinct_of(norms[k], size)
        return alike_lines(norms[x], norms[y], sets[x], sets[y], size, least)

    return join_all(len(norms), close, side, joined)


def _texts(docs, id_col, text_col):
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")


#: Characters of text whose distinct lines are put together.
BATCH = 2 << 20


def _slices(b: pd.DataFrame):
    """The batch in slices of about BATCH characters."""
    at = np.cumsum([0, *map(len, b["text"])])[:-1] // BATCH
    for rows in np.split(np.arange(len(b)), np.flatnonzero(np.diff(at)) + 1):
        yield b.iloc[rows]


def _distinct(texts, min_chars: int) -> dict[int, str]:
    norms = {n for text in texts for n in normals(text) if len(n) >= min_chars}
    return {line_key(n): n for n in norms}


def _bytes_of(cells: pa.BinaryArray) -> np.ndarray:
    """The bytes of all cells, one after the other, without a copy."""
    if not len(cells):
        return np.zeros(0, np.uint8)
    wide = pa.types.is_large_binary(cells.type)
    at = np.frombuffer(cells.buffers()[1], np.int64 if wide else np.int32)[cells.offset : cells.offset + len(cells) + 1]
    return np.frombuffer(cells.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]


def _repeated(key: np.ndarray) -> np.ndarray:
    """The places of all numbers that are there more than once, and of some others that meet one by a short hash."""
    bits = max(1, (4 * len(key)).bit_length())
    slot = (key.view(np.uint64) * _MIX[1] >> np.uint64(64 - bits)).view(np.int64)
    return np.flatnonzero(np.bincount(slot)[slot] > 1) if len(key) else np.zeros(0, np.int64)


def buckets(docs: DataFrame, id_col: str, text_col: str, min_chars: int = MIN_CHARS, fine: bool = False) -> DataFrame:
    """(key, h, n, first): the lines that share a band's key with another, how many these are, and the least of them.

    Tasks pack keys and lines by the key's remainder and send each pair once, so a line that very many
    documents hold reaches its bucket once from each batch of documents.
    """
    parts = 8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pack(batches):
        for b in (x for whole in batches for x in _slices(whole)):
            known = _distinct(b["text"], min_chars)
            keys, lines = [], []
            for size, least, most in ((SHINGLE, max(SHINGLE, MIN_CHARS if fine else 0), None), (FINE, FINE, FINE_MOST if fine else 0)):
                some = {h: n for h, n in known.items() if len(n) >= least and (most is None or len(n) <= most)}
                keys.append(band_keys(list(some.values()), size).ravel())
                lines.append(np.repeat(np.fromiter(some, np.int64, len(some)), BANDS[size][0]))
            keys, lines = np.concatenate(keys), np.concatenate(lines)
            at = (keys % np.uint64(parts)).astype(np.uint16 if parts <= 1 << 16 else np.int32)  # short numbers are sorted by radix
            order = np.argsort(at, kind="stable")
            at, rows = at[order], np.stack([keys[order].view(np.int64), lines[order]], axis=1)
            which, starts = np.unique(at, return_index=True)
            yield pd.DataFrame({"part": which.astype(np.int32), "rows": [x.tobytes() for x in np.split(rows, starts[1:])] if len(which) else []})

    def meet(b: pa.Table) -> pa.Table:
        rows = np.concatenate([np.zeros(0, np.uint8), *map(_bytes_of, b["rows"].chunks)]).view(np.int64).reshape(-1, 2)
        rows = rows[_repeated(rows[:, 0])]  # few are left
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
        rows = rows[new]
        starts = np.flatnonzero(np.diff(rows[:, 0], prepend=rows[0, 0] - 1)) if len(rows) else np.zeros(0, np.int64)
        n = np.diff(np.append(starts, len(rows)))
        several = np.repeat(n, n) > 1
        columns = {"key": rows[:, 0], "h": rows[:, 1], "n": np.repeat(n, n), "first": np.repeat(rows[starts, 1], n)}
        return pa.table({k: pa.array(x[several], pa.int64()) for k, x in columns.items()})

    packed = _texts(docs, id_col, text_col).select("text").mapInPandas(lean(pack), "part int, rows binary")
    return packed.groupBy("part").applyInArrow(lean_group(meet), "key long, h long, n long, first long")


#: Bits of the sketch that spares lines without a partner the shuffle.  It has this size whatever the input is.
SKETCH_BITS = 25


def sketch(wanted: DataFrame, name: str) -> np.ndarray:
    """A bitmap of fixed size over the hashes in column ``name``."""
    bit = F.expr(f"{name} & {(1 << SKETCH_BITS) - 1}")
    words = wanted.select(bit.alias("bit")).groupBy(F.expr("cast(bit div 64 as int)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("bits"))
    got = words.toPandas()  # 2**SKETCH_BITS / 64 rows at most
    out = np.zeros(1 << (SKETCH_BITS - 6), np.int64)
    out[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64)
    return out


def places(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, line, h, norm): where lines of ``min_chars`` characters or more stand; line counts from 0.

    norm is there for at least the lines in ``wanted`` (h), once in a batch of documents.  A bitmap of fixed size over
    the wanted hashes is sent to all tasks.  It only saves shuffling: lines that pass it by chance find no partner in
    the joins that follow.
    """
    shared = docs.sparkSession.sparkContext.broadcast(sketch(wanted, "h"))

    def read(batches):
        for b in (x for whole in batches for x in _slices(whole)):
            counts, numbers, keys, norms = [], [], [], []
            for text in b["text"]:
                before = len(keys)
                for k, norm in enumerate(normals(text)):
                    if len(norm) >= min_chars:
                        numbers.append(k)
                        keys.append(line_key(norm))
                        norms.append(norm)
                counts.append(len(keys) - before)
            h = np.array(keys, np.int64)
            at = h & ((1 << SKETCH_BITS) - 1)
            told = np.zeros(len(h), bool)
            told[np.unique(h, return_index=True)[1]] = True
            told &= (shared.value[at >> 6] >> (at & 63)) & 1 == 1
            ids = np.repeat(b["id"].to_numpy(np.int64), np.array(counts, np.int64))
            yield pd.DataFrame({"id": ids, "line": np.array(numbers, np.int32), "h": h, "norm": [n if t else None for n, t in zip(norms, told.tolist())]})

    return _texts(docs, id_col, text_col).mapInPandas(lean(read), "id long, line int, h long, norm string")


def unlike(members: DataFrame) -> DataFrame:
    """(key): one of the buckets that have the same lines."""
    sizes = members.groupBy("key", "n", "first").agg(F.bit_xor(F.xxhash64("h")).alias("x"), F.sum(F.shiftrightunsigned(F.xxhash64("h", F.lit(1)), 20)).alias("y"))
    return sizes.groupBy("n", "first", "x", "y", F.expr("key & 1").alias("size")).agg(F.min("key").alias("key")).select("key")


def compared(firsts: list[str], others: list[str], size: int) -> list[int]:
    """The places at which two lines can be alike by their maps; equal ``firsts`` that follow each other are hashed once."""
    new = [k for k, line in enumerate(firsts) if not k or line != firsts[k - 1]]
    run = np.diff([*new, len(firsts)])
    most = [np.maximum(1, np.fromiter(map(len, x), np.int64, len(x)) - size + 1) for x in (firsts, others)]
    differ = np.bitwise_count(np.repeat(shingle_marks([firsts[k] for k in new], size), run, axis=0) ^ shingle_marks(others, size)).sum(axis=1, dtype=np.int64)
    return np.flatnonzero(may_be_alike(differ, most[0] + most[1])).tolist()


def stars(members: DataFrame, texts: DataFrame) -> DataFrame:
    """(u, v): the lines that are similar to the first one of a bucket of theirs, with that line.

    A pair is verified once, however many buckets it shares.
    """
    pairs = members.where("h <> first").select(F.col("first").alias("u"), F.col("h").alias("v"), F.expr("key & 1 = 0").alias("fine")).distinct()

    @F.pandas_udf("boolean")
    def close(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        last = mine = None
        for firsts, others, fine in batches:
            out = np.zeros(len(fine), bool)
            for size, some in ((SHINGLE, np.flatnonzero(~fine)), (FINE, np.flatnonzero(fine))):
                a, b = firsts.iloc[some].tolist(), others.iloc[some].tolist()
                for k in compared(a, b, size):
                    if last != (a[k], size):  # pairs of a line follow each other
                        last, mine = (a[k], size), distinct_of(a[k], size)
                    out[some[k]] = alike_lines(a[k], b[k], mine, distinct_of(b[k], size), size)
            yield pd.Series(out)

    other = pairs.join(texts.withColumnsRenamed({"h": "v", "norm": "other"}), "v")
    both = other.join(texts.withColumnsRenamed({"h": "u", "norm": "mine"}), "u")
    return both.where(close("mine", "other", "fine")).select("u", "v").distinct()


#: Lines of a bucket that are compared in one go; larger buckets are cut, and each two of their blocks meet.
BLOCK = 2048


def links(members: DataFrame, texts: DataFrame, block: int = BLOCK) -> DataFrame:
    """(u, v): similar lines that share a bucket, enough to join all that are linked.

    A line's text comes once to each of its buckets, not once to each pair.  Even keys are of short shingles.  If
    ``members`` has a column ``component``, only lines of different components are compared, and these are named.
    """
    parts = 8 * int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = "component" in members.columns
    members = members.select("key", "h", F.col("component" if some else "h").alias("name"))
    large = members.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block)
    cut = members.join(large, "key", "left").withColumn("blocks", F.coalesce(F.ceil(F.col("n") / block), F.lit(1)).cast("int"))
    cut = cut.withColumn("own", F.pmod(F.xxhash64("h"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cut = cut.select("key", "h", "name", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    rows = cut.join(texts, "h").withColumn("part", F.pmod(F.xxhash64("key", "i", "j"), F.lit(parts)))

    def verify(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["key", "i", "j", "h"])
        place = b[["key", "i", "j"]].to_numpy(np.int64)
        new = np.ones(len(b), bool)
        new[1:] = (place[1:] != place[:-1]).any(axis=1)
        starts = np.append(np.flatnonzero(new), len(b))
        name, own, norms, out = b["name"].to_numpy(np.int64), b["own"].to_numpy(), b["norm"].tolist(), []
        maps = [0] * len(norms)
        for size, rows_of in ((SHINGLE, np.flatnonzero(place[:, 0] & 1)), (FINE, np.flatnonzero(place[:, 0] & 1 == 0))):
            for k, m in zip(rows_of.tolist(), shingle_maps([norms[k] for k in rows_of.tolist()], size)):
                maps[k] = m
        for s, e in zip(starts, starts[1:]):
            side, size = None if place[s, 1] == place[s, 2] else own[s:e].tolist(), SHINGLE if place[s, 0] & 1 else FINE
            joined = name[s:e].tolist() if some else None
            out += [(name[s + x], name[s + y]) for x, y in linked(norms[s:e], maps[s:e], side, size=size, joined=joined)]
        found = np.array(out, np.int64).reshape(-1, 2)
        return pd.DataFrame({"u": np.minimum(found[:, 0], found[:, 1]), "v": np.maximum(found[:, 0], found[:, 1])})

    return rows.groupBy("part").applyInPandas(lean_group(verify), "u long, v long").distinct()


def components_of(members: DataFrame, texts: DataFrame, block: int = BLOCK) -> DataFrame:
    """(h, component) for the lines of ``buckets`` that are linked to another.

    First each line is compared with the first one of each of its buckets, each pair once.  Only the buckets of three
    lines or more that these links leave in several components go on: there lines of different components meet.
    """
    first = stash(stars(members, texts), "links")
    named = stash(connected_components(first).select(F.col("id").alias("h"), F.col("component").alias("name")), "named")
    larger = members.where("n > 2")
    each = larger.join(unlike(larger), "key").join(named, "h", "left").select("key", "h", F.coalesce("name", "h").alias("component"))
    several = each.groupBy("key").agg((F.min("component") < F.max("component")).alias("several")).where("several")
    apart = stash(each.join(several.select("key"), "key"), "apart")
    rest = stash(links(apart, texts, block), "links")
    unstash(first, apart)
    more = connected_components(rest).withColumnsRenamed({"id": "name", "component": "least"})
    # a line that no star has is its own component
    every = named.unionByName(more.select(F.col("name").alias("h"), "name").join(named.select("h"), "h", "left_anti"))
    return every.join(more, "name", "left").select("h", F.coalesce("least", "name").alias("component"))


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, fine: bool = False) -> DataFrame:
    """(id, removed): the numbers of the lines that go, in order, for each document that loses one.

    Lines end at ``\n``.  They are compared in lower case with white space collapsed.  Of each component of lines
    of similarity 0.8 or more the one of the smallest (id, line) stays.  Lines under ``min_chars`` characters
    stay.  If ``fine``, two lines of at most 100 characters are alike by shingles of 3 characters too, and lines of
    fewer characters than a shingle if they are equal.  Ids are cast to long; rows with a null id keep all lines and
    remove none; null texts have none.  Rows that repeat an id are treated as one document: a line number goes from
    all of them.  A very long line is compared whole.  Other columns are not read.  An empty table gives an empty one.
    """
    members = stash(buckets(docs, id_col, text_col, min_chars, fine), "members")
    placed = stash(places(docs, members.select("h"), id_col, text_col, min_chars), "places")
    texts = stash(placed.where("norm is not null").groupBy("h").agg(F.first("norm").alias("norm")), "texts")
    named = stash(components_of(members, texts), "named")
    unstash(members, texts)
    found = placed.select("id", "line", "h")
    first = found.groupBy("h").agg(F.min(F.struct("id", "line")).alias("first"), F.count("*").alias("n"))
    first = stash(first.join(named, "h", "left").where("n > 1 or component is not null"), "repeated")
    linked = first.where("component is not null")
    # kept apart, so that Spark can split the rows of a large component
    best = stash(linked.groupBy("component").agg(F.min("first").alias("stays")), "best")
    decided = linked.join(best, "component").select("h", "stays").unionByName(first.where("component is null").select("h", F.col("first").alias("stays")))
    gone = found.join(decided, "h").where("id <> stays.id or line <> stays.line")
    return gone.groupBy("id").agg(F.array_sort(F.collect_set("line")).alias("removed"))


def without_lines(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the lines in ``gone`` (id, removed); a document of which no line is left has a null text.

    Columns keep their names, types and order, whatever they are called.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.struct(*(F.col(c) for c in docs.columns)).alias("row"))
    rows = rows.join(gone.select("id", "removed"), "id", "left")
    old = F.col("row").getField(text_col)
    kept = F.filter(
        F.transform(F.split(old, "\n"), lambda x, k: F.struct(x.alias("line"), F.array_contains("removed", k).alias("gone"))),
        lambda x: ~x["gone"],
    )
    left = F.array_join(F.transform(kept, lambda x: x["line"]), "\n")
    text = F.when(F.col("removed").isNull(), old).when(F.size(kept) > 0, left)
    return rows.select(*(text.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns))
