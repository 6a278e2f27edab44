"""Repeated byte strings by a depth-limited radix sort of sparse suffixes (operator 4)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few_files, lean, lean_group, stash, text_or_empty, tidy

#: Bytes of a repeated string, and of the first part of a suffix that is sorted, which stands at one of SPAN places in it.
LENGTH, DIGIT = 50, 24
REACH = LENGTH - DIGIT
SPAN = REACH + 1
#: Bytes of text that are looked at in one go.
SEGMENT = 1 << 17
#: Bytes of text whose suffixes are put together before they are sent.
BATCH = 2 << 20
#: Bytes of text for each part that suffixes are dealt into: a part is sorted in memory.
PART_BYTES = 8 << 20
#: Bits of the sketch that says which first digits repeat: at least, and at most, whatever the input is.
SKETCH_BITS, MOST_SKETCH_BITS = 27, 30
#: Suffixes of one first digit that are sorted in one part; those of a digit with more are dealt by their whole strings.
HOT = 500_000
#: A context that so many documents of a batch have is remembered, so that a task sends it once; contexts remembered.
OFTEN, REMEMBERED = 4, 50_000
_POSITION = np.uint64((1 << 21) - 1)

_rng = np.random.default_rng(50)
_TABLE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_R = 0x5851F42D4C957F2D
_POWERS = np.full(SEGMENT + (1 << 17), _R, np.uint64)
_POWERS[0] = 1
_POWERS = np.multiply.accumulate(_POWERS)
_INVERSE = np.full(len(_POWERS), pow(_R, -1, 1 << 64), np.uint64)
_INVERSE[0] = 1
_INVERSE = np.multiply.accumulate(_INVERSE)

#: A suffix that is sent: 10 big-endian words to sort by (the digit, the bytes after it, those before it from right to
#: left, how many of each), the document, and at how many places of it the suffix stands.
_WORDS = 10
_RIGHT, _LEFT, _SIZES = DIGIT, DIGIT + REACH, DIGIT + 2 * REACH
_ROW = np.dtype([("word", ">u8", (_WORDS,)), ("id", "<i8"), ("h", "<i8"), ("times", "<u4")])
#: A run to remove: of the document, from start to end.
_RUN = np.dtype([("id", "<i8"), ("h", "<i8"), ("start", "<i8"), ("end", "<i8")])


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(32)
    return h


class Found(NamedTuple):
    """Suffixes at anchors: number of the text, first and last string that has this anchor, its place, two hashes.

    anchor: of the first DIGIT bytes; context: of all bytes of the strings that have this anchor.
    """

    text: np.ndarray
    first: np.ndarray
    last: np.ndarray
    at: np.ndarray
    anchor: np.ndarray
    context: np.ndarray

    def strings(self, which: np.ndarray, hashes: np.ndarray, base: np.ndarray):
        """(text, start, key) of each string of LENGTH bytes of the suffixes ``which``."""
        n = (self.last - self.first + 1)[which]
        start = np.repeat(self.first[which] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        text = np.repeat(self.text[which], n)
        return text, start, hashes[start + np.repeat(base[which], n)]


def suffixes(texts: list[bytes], whole: bool = True) -> Iterator[tuple[Found, np.ndarray, np.ndarray]]:
    """The sparse suffixes of texts, part by part; if ``whole``, keys of all strings and what to add to a start to find its own.

    Each string of LENGTH bytes is looked at through its anchor, the least of the hashes of its DIGIT-byte
    strings (the first of equal ones).  That depends on the string alone, so equal strings have equal anchors at
    equal places.  Long texts are cut into segments that overlap.
    """
    pieces, size = [], 0
    for k, data in enumerate(texts):
        n = len(data)
        for s in range(0, n - LENGTH + 1, SEGMENT):
            e = min(s + SEGMENT, n - LENGTH + 1)
            b0, b1 = max(0, s - REACH), min(n, e + REACH + LENGTH)
            if size + b1 - b0 > SEGMENT and pieces:
                yield _part(texts, pieces, whole)
                pieces, size = [], 0
            pieces.append((k, s, e, b0, b1, n))
            size += b1 - b0
    if pieces:
        yield _part(texts, pieces, whole)


def _part(texts, pieces, whole):
    k, s, e, b0, b1, n = np.array(pieces, np.int64).T
    at = np.concatenate(([0], np.cumsum(b1 - b0)))[:-1]
    x = np.frombuffer(b"".join(texts[p[0]][p[3] : p[4]] for p in pieces), np.uint8)
    sums = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(_TABLE[x] * _POWERS[: len(x)], out=sums[1:])

    def key(start, length):
        return _mix((sums[start + length] - sums[start]) * _INVERSE[start])

    m = len(x) - DIGIT + 1
    digit = _mix((sums[DIGIT:] - sums[:m]) * _INVERSE[:m])
    low = (digit & ~_POSITION) | np.arange(m, dtype=np.uint64)
    wide = 1
    while 2 * wide <= SPAN:
        low = np.minimum(low[:-wide], low[wide:])
        wide *= 2
    if wide < SPAN:
        low = np.minimum(low[: wide - SPAN], low[SPAN - wide :])
    strings = np.concatenate([np.arange(a + s_ - b, a + e_ - b) for a, s_, e_, b in zip(at, s, e, b0)])
    piece = np.repeat(np.arange(len(pieces)), e - s)
    place = (low[strings] & _POSITION).astype(np.int64)
    new = np.ones(len(strings), bool)
    new[1:] = (place[1:] != place[:-1]) | (piece[1:] != piece[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(strings)) - 1
    p, a = piece[first], place[first]
    true = a - at[p] + b0[p]
    left, bytes_ = a - strings[first], strings[last] - strings[first] + LENGTH
    context = _mix(key(strings[first], bytes_) + (left * 128 + bytes_).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    shift = b0[p] - at[p]
    found = Found(k[p], strings[first] + shift, strings[last] + shift, true, _mix(digit[a]), context)
    hashes = _mix((sums[LENGTH:] - sums[: len(sums) - LENGTH]) * _INVERSE[: len(sums) - LENGTH]) if whole else None
    return found, hashes, -shift


class Sketch:
    """A set of 64-bit keys, by their first bits: may hold more than it should, never less."""

    def __init__(self, parts: dict[int, bytes], bits: int, size: int):
        self.shift = np.uint64(64 - size)
        each = (1 << size) // 8 >> bits
        self.raw = np.zeros((1 << size) // 8, np.uint8)
        for part, raw in parts.items():
            self.raw[part * each : part * each + each] = np.frombuffer(raw, np.uint8)

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = keys >> self.shift
        return (self.raw[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _blobs(part: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """The parts that occur, and the rows of each as bytes."""
    order = np.argsort(part, kind="stable")
    which, starts = np.unique(part[order], return_index=True)
    return which.astype(np.int32), [x.tobytes() for x in np.split(rows[order], starts[1:])] if len(which) else []


def _joined(blobs, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), dtype)


def _firsts(*columns: np.ndarray) -> np.ndarray:
    """Which rows differ from the one before them."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _least(values: np.ndarray, new: np.ndarray) -> np.ndarray:
    """For each row the least value of its run; runs begin where ``new``."""
    starts = np.flatnonzero(new)
    return np.repeat(np.minimum.reduceat(values, starts), np.diff(np.append(starts, len(values)))) if len(values) else values


def _by_batch(batches, needs, whole: bool = True):
    """The ids of each batch of about BATCH bytes, and the results of ``needs`` on its parts, joined."""
    for _, rows, columns in _cut(batches, needs, whole):
        yield rows["id"].to_numpy(np.int64), columns


def _cut(batches, needs, whole: bool):
    """As ``_by_batch``, with the texts and all columns of the rows."""
    for b in batches:
        sizes = np.cumsum([0, *map(len, b["text"])])[:-1] // BATCH
        for rows in np.split(np.arange(len(b)), np.flatnonzero(np.diff(sizes)) + 1):
            here = b.iloc[rows]
            texts = here["text"].tolist()
            got = [x for f, h, base in suffixes(texts, whole) if (x := needs(f, h, base)) is not None]
            yield texts, here, [np.concatenate(c) for c in zip(*got)] if got else None


def repeated_digits(docs: DataFrame, bits: int, size: int) -> tuple[Sketch, np.ndarray]:
    """The first digits that two documents may have, and those that more than HOT suffixes have.

    A batch of documents sends each digit as often as it will send suffixes of it, and twice at least if it meets
    the condition by itself, so a digit that is in very many documents is counted in many tasks first.
    """

    def send(batches):
        for _, c in _by_batch(batches, lambda f, h, base: (f.anchor, f.context, f.text), False):
            if c is None:
                continue
            order = np.lexsort((c[1], c[0]))
            anchor, context, text = (x[order] for x in c)
            new = _firsts(anchor)
            starts = np.flatnonzero(new)
            contexts = np.add.reduceat(_firsts(anchor, context).astype(np.int64), starts)
            several = np.minimum.reduceat(text, starts) < np.maximum.reduceat(text, starts)
            digits = np.repeat(anchor[starts], np.maximum(contexts, 1 + several))
            which, rows = _blobs(digits >> np.uint64(64 - bits), digits)
            yield pd.DataFrame({"part": which, "rows": rows})

    def meet(b: pd.DataFrame) -> pd.DataFrame:
        digits = np.sort(_joined(b["rows"], np.uint64))
        starts = np.flatnonzero(_firsts(digits))
        times = np.diff(np.append(starts, len(digits)))
        again = digits[starts[times > 1]]
        marks = np.zeros(1 << (size - bits), np.uint8)
        marks[((again >> np.uint64(64 - size)) & np.uint64(len(marks) - 1)).astype(np.int64)] = 1
        return pd.DataFrame({"part": b["part"].iloc[:1], "bitmap": [np.packbits(marks, bitorder="little").tobytes()], "hot": [digits[starts[times > HOT]].tobytes()]})

    with tidy(docs.sparkSession):
        sent = docs.mapInPandas(lean(send), "part int, rows binary").groupBy("part").applyInPandas(lean_group(meet), "part int, bitmap binary, hot binary")
        got = sent.collect()  # 2**size bits, and one digit for each HOT suffixes at most
    return Sketch({r.part: bytes(r.bitmap) for r in got}, bits, size), np.sort(_joined([bytes(r.hot) for r in got], np.uint64))


_AFTER = np.arange(DIGIT + REACH)
_BEFORE = np.arange(REACH)


def _words(buffer: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The words to sort by of the suffixes at ``at``: bytes that belong to none of their strings are 0."""
    out = np.zeros((len(at), 8 * _WORDS), np.uint8)
    most = len(buffer) - 1
    for start in range(0, len(at), 1 << 14):  # indexes are eight times as large as what they fetch
        s = slice(start, start + (1 << 14))
        a, l, r = at[s, None], left[s, None], right[s, None]
        out[s, :_LEFT] = buffer[np.minimum(a + _AFTER, most)] * (_AFTER < DIGIT + r)
        out[s, _LEFT:_SIZES] = buffer[np.maximum(a - 1 - _BEFORE, 0)] * (_BEFORE < l)
    out[:, _SIZES], out[:, _SIZES + 1] = right, left
    return out


class Sent:
    """The contexts that a task has sent for very many documents, with the least id that has each."""

    def __init__(self):
        self.least: dict[bytes, int] = {}

    def earlier(self, words: np.ndarray, least: np.ndarray, often: np.ndarray) -> np.ndarray:
        """Which of the contexts went out before with a smaller id than ``least``; only those ``often`` met are kept."""
        known = np.zeros(len(least), bool)
        for k in np.flatnonzero(often).tolist():
            key, one = words[k].tobytes(), int(least[k])
            if key in self.least and self.least[key] < one:
                known[k] = True
            else:
                if len(self.least) >= REMEMBERED:
                    self.least.clear()
                self.least[key] = one
        return known


def _runs(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of the maximal runs that intervals cover in each text; numbers of texts are small."""
    order = np.lexsort((start, text))
    text, start, end = text[order], start[order], end[order]
    far = np.int64(1) << np.int64(40)
    reach = np.maximum.accumulate(end + text * far)
    new = np.ones(len(start), bool)
    new[1:] = start[1:] + text[1:] * far > reach[:-1]
    first = np.flatnonzero(new)
    return text[first], start[first], reach[np.append(first[1:], len(start)) - 1] - text[first] * far if len(start) else reach


def _sorted_by(rows: DataFrame, bits: int, digits: Sketch, hot: np.ndarray) -> DataFrame:
    """(part, known, rows, starts): suffixes to sort, dealt by their digit, and runs that are known to go.

    In a batch of documents only the smallest id that has a context goes on to meet other batches; for the rest the
    answer is known, once their bytes have been compared with its own.
    """
    shared = rows.sparkSession.sparkContext.broadcast((digits, hot))

    def needs(f, h, base):
        sketch, hot = shared.value
        ok = sketch.has(f.anchor)
        many = ok & np.isin(f.anchor, hot) if len(hot) else np.zeros(len(ok), bool)
        one = ok & ~many
        columns = [f.text[one], f.first[one], f.last[one], f.at[one], f.anchor[one], f.context[one]]
        if many.any():
            which = np.flatnonzero(many)
            text, start, keys = f.strings(which, h, base)
            at = np.repeat(f.at[which], (f.last - f.first + 1)[which])
            more = [text, start, start, at, keys, _mix(keys + (at - start).astype(np.uint64))]
            columns = [np.concatenate(x) for x in zip(columns, more)]
        return columns if ok.any() else None

    def send(batches):
        sent = Sent()
        for texts, docs, c in _cut(batches, needs, len(hot) > 0):
            if c is None:
                continue
            ids, hs = docs["id"].to_numpy(np.int64), docs["h"].to_numpy(np.int64)
            order = np.lexsort((c[1], c[0], ids[c[0]], c[5]))
            text, first, last, at, route, context = (x[order] for x in c)
            begins = np.cumsum([0, *map(len, texts)])[:-1]
            buffer = np.frombuffer(b"".join(texts), np.uint8)
            words = _words(buffer, begins[text] + at, at - first, REACH - (at - last))
            one = ids[text]
            new = _firsts(context)
            starts = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            same = (words == words[starts[group]]).all(axis=1)
            changes = np.add.reduceat(_firsts(group, text).astype(np.int64), starts)
            before = sent.earlier(words[starts], one[starts], changes >= OFTEN)
            later = same & ((one > one[starts[group]]) | before[group])
            which, begin, end = _runs(text[later], first[later], last[later] + LENGTH)
            known = np.zeros(len(which), _RUN)
            known["id"], known["h"], known["start"], known["end"] = ids[which], hs[which], begin, end
            part, blobs = _blobs(_bucket(known, bits), known)
            yield pd.DataFrame({"part": part, "known": True, "rows": blobs, "starts": b""})
            # a suffix that stands at many places of a document goes once, with all of them
            go = np.flatnonzero(~later)
            lead = _firsts(group[go], text[go], same[go]) | ~same[go]
            rows = np.zeros(lead.sum(), _ROW)
            heads = go[lead]
            rows["word"] = words[heads].view(">u8")
            rows["id"], rows["h"] = one[heads], hs[text[heads]]
            rows["times"] = np.diff(np.append(np.flatnonzero(lead), len(go)))
            place = (route >> np.uint64(64 - bits)).astype(np.int32)
            part, blobs = _blobs(place[heads], rows)
            _, places = _blobs(place[go], first[go])
            yield pd.DataFrame({"part": part, "known": False, "rows": blobs, "starts": places})

    return rows.mapInPandas(lean(send), "part int, known boolean, rows binary, starts binary")


def _bucket(runs: np.ndarray, bits: int) -> np.ndarray:
    return _mix(runs["id"].view(np.uint64) * np.uint64(3) + runs["h"].view(np.uint64)) >> np.uint64(64 - bits)


def _shared_start(a: np.ndarray) -> np.ndarray:
    """How many leading bytes each row shares with the row before it."""
    out = np.zeros(len(a), np.int64)
    if len(a) > 1:
        differs = np.concatenate((a[1:] != a[:-1], np.ones((len(a) - 1, 1), bool)), axis=1)
        out[1:] = differs.argmax(axis=1)
    return out


def sort_suffixes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, lo, hi): which bytes of the rows' contexts go, counted from where the first string of each begins.

    Most-significant-digit passes of 8 bytes: after each pass groups of a single document are done.  Three passes
    tell the first DIGIT bytes; the next ones, over all bytes of the strings around them, are whole repeats.  What is
    left of a digit with several contexts is sorted through both sides of the digit as far as each of its strings.
    """
    words, ids = rows["word"].astype(np.uint64), rows["id"]
    live, group = np.arange(len(rows)), np.zeros(len(rows), np.int64)
    for k in range(_WORDS):
        order = np.lexsort((words[live, k], group))
        live, group = live[order], group[order]
        new = _firsts(group, words[live, k])
        if k < DIGIT // 8:
            group = np.cumsum(new) - 1
            least, most = _least(ids[live], new), -_least(-ids[live], new)
            live, group = live[least < most], group[least < most]
            digit = group
        else:
            digit = digit[order]
            group = np.cumsum(new) - 1
    if not len(live):
        none = np.zeros(0, np.int64)
        return none, none, none
    new = _firsts(group)
    least = _least(ids[live], new)
    sizes = rows["word"].view(np.uint8).reshape(len(rows), -1)[:, _SIZES : _SIZES + 2].astype(np.int64)
    right, left = sizes[:, 0], sizes[:, 1]
    whole = ids[live] > least
    out = [(live[whole], np.zeros(whole.sum(), np.int64), (left + right + DIGIT)[live[whole]])]
    # contexts, each by one row, of digits that have several
    heads = np.flatnonzero(new)
    several = np.repeat(np.add.reduceat(np.ones(len(heads), np.int64), s := np.flatnonzero(_firsts(digit[heads]))), np.diff(np.append(s, len(heads)))) > 1
    kept = heads[several]
    if len(kept):
        lo, hi = _strings(rows["word"].view(np.uint8).reshape(len(rows), -1)[live[kept]], digit[kept], left[live[kept]], right[live[kept]], least[kept])
        of = np.full(group[-1] + 1, -1)
        of[group[kept]] = np.arange(len(kept))
        mine = np.flatnonzero(~whole & (of[group] >= 0))
        c = of[group[mine]]
        mine, c = mine[hi[c] > 0], c[hi[c] > 0]
        out.append((live[mine], lo[c], hi[c]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _strings(raw, digit, left, right, ids):
    """Per context the union of its strings that a smaller id has too: strings that share DIGIT bytes overlap."""
    n = len(raw)

    def classes(side):
        columns = np.ascontiguousarray(np.concatenate((side, np.zeros((n, -REACH % 8), np.uint8)), axis=1)).view(">u8").astype(np.uint64)
        order = np.lexsort((*columns.T[::-1], digit))
        shared = np.where(_firsts(digit[order]), -1, _shared_start(side[order]))
        return order, shared

    sides = classes(raw[:, _RIGHT:_LEFT]), classes(raw[:, _LEFT:_SIZES])

    def number(side, length):
        """Equal numbers for contexts with the same digit and the same ``length`` bytes on that side."""
        order, shared = sides[side]
        out = np.empty(n, np.uint64)
        out[order] = np.cumsum(shared < length).astype(np.uint64)
        return out

    lo, hi = np.full(n, LENGTH * 2), np.zeros(n, np.int64)
    for j in range(SPAN):
        ok = np.flatnonzero((right >= j) & (left >= REACH - j))
        if len(ok) < 2:
            continue
        key = (number(0, j) * np.uint64(n + 1) + number(1, REACH - j))[ok]
        order = np.argsort(key, kind="stable")
        least = _least(ids[ok[order]], _firsts(key[order]))
        later = ok[order[ids[ok[order]] > least]]
        begin = left[later] - (REACH - j)
        lo[later], hi[later] = np.minimum(lo[later], begin), np.maximum(hi[later], begin + LENGTH)
    return lo, hi


def _meet(bits: int):
    def meet(b: pd.DataFrame) -> pd.DataFrame:
        known = b["known"].to_numpy(bool)
        rows, starts = _joined(b["rows"][~known], _ROW), _joined(b["starts"][~known], np.int64)
        which, lo, hi = sort_suffixes(rows)
        times = rows["times"].astype(np.int64)[which]
        each = np.repeat(np.arange(len(which)), times)
        begins = np.cumsum(np.append(0, rows["times"]))[:-1].astype(np.int64)
        at = starts[np.repeat(begins[which] - np.cumsum(np.append(0, times))[:-1], times) + np.arange(len(each))]
        runs = np.zeros(len(each), _RUN)
        runs["id"], runs["h"] = rows["id"][which][each], rows["h"][which][each]
        runs["start"], runs["end"] = at + lo[each], at + hi[each]
        runs = np.concatenate([runs, _joined(b["rows"][known], _RUN)])
        bucket, blobs = _blobs(_bucket(runs, bits), runs)
        return pd.DataFrame({"bucket": bucket, "runs": blobs})

    return meet


def _merge(b: pd.DataFrame) -> pd.DataFrame:
    """The maximal runs of each document."""
    runs = _joined(b["runs"], _RUN)
    runs = runs[np.lexsort((runs["h"], runs["id"]))]
    new = _firsts(runs["id"], runs["h"])
    doc, start, end = _runs(np.cumsum(new) - 1, runs["start"], runs["end"])
    cuts = np.flatnonzero(_firsts(doc))[1:]
    heads = runs[new]
    return pd.DataFrame({"id": heads["id"], "h": heads["h"], "starts": np.split(start, cuts), "ends": np.split(end, cuts)})


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, spans): each row's text as bytes with the runs to remove as pairs (start, end).

    A byte goes if a string of 50 bytes that covers it also starts in a document of a smaller id.  Suffixes are
    sorted only through these 50 bytes.  One of 14 suffixes stands for all strings around it: a string is looked at
    through its anchor, the 24 bytes of least hash in it, and equal strings have equal anchors at equal places.  A
    first pass over the documents finds which anchors two documents may have.  The suffixes at these are dealt by
    their first digit and sorted by passes of 8 bytes, most significant first; groups of one document are dropped
    after each pass, and what goes on to the end are bytes that have been compared, never hashes alone.

    Hashes only choose anchors, partitions and candidates.  The sketch of repeated anchors is sized by the input up
    to a fixed bound; what it lets through by chance is dropped by the passes.  Suffixes of a digit that more than
    HOT have are dealt by their whole strings, so that no digit is one task's burden.

    Ids are cast to long.  A null text is empty; a row with a null id keeps all and removes nothing; rows with the
    same id do not remove each other's bytes; texts under 50 bytes stay; very long texts are cut into segments that
    overlap; other columns are not read; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).cast("binary").alias("text")).withColumn("h", F.xxhash64("text"))
    known = rows.where("id is not null and octet_length(text) >= 50")
    total = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // PART_BYTES)
    bits = min(max(4, (parts - 1).bit_length()), 24)
    size = min(max(SKETCH_BITS, (total // 16).bit_length()), MOST_SKETCH_BITS)
    digits, hot = repeated_digits(known.select("id", "text"), bits, size)
    met = _sorted_by(known, bits, digits, hot).groupBy("part").applyInPandas(lean_group(_meet(bits)), "bucket int, runs binary")
    merged = met.groupBy("bucket").applyInPandas(lean_group(_merge), "id long, h long, starts array<long>, ends array<long>")
    runs = stash(few_files(merged, "h"), "runs")
    spans = F.coalesce(F.arrays_zip(F.col("starts").alias("start"), F.col("ends").alias("end")), F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)"))
    return rows.join(runs, ["id", "h"], "left").select("id", "text", spans.alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the SHA-256 of what is left."""

    @F.pandas_udf("string")
    def kept(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, cut in zip(texts, spans):
            h, at = hashlib.sha256(), 0
            for x in cut if text is not None else ():
                h.update(text[at : x["start"]])
                at = x["end"]
            h.update(text[at:] if text is not None else b"")
            out.append(h.hexdigest())
        return pd.Series(out, dtype=object)

    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    some = F.size("spans") > 0
    out = found.select(
        F.col("id").alias("doc_id"), F.octet_length("text").cast("long").alias("n_bytes"), gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.when(some, kept(F.when(some, F.col("text")), "spans")).otherwise(F.sha2("text", 256)).alias("kept_sha256"),
    )
    return few_files(out, "kept_sha256")
