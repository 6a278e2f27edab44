"""Benchmark decontamination by template canonicalisation (operator 9)."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, stash
from .linededup import SKETCH_BITS, sketch

#: Words of a template window; an item with fewer is one window.
WINDOW = 8
#: Windows with fewer words than this outside of slots are not looked up; an item without others is compared word for word.
FIXED_WORDS = 4
#: Windows of an item that a document must hold, or all that the item has; more where each character is a word.
LEAST_WINDOWS, LEAST_UNSPACED = 3, 13
#: An item of fewer runs of letters or digits than this is never held; a character of a script without spaces is a run.
LEAST_RUNS = 3
#: Distinct words that a worker remembers.
REMEMBERED = 300_000

# fixed values: words that stand for numbers, and units of measure
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion half dozen".split())
UNITS = frozenset("mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres mg g kg t lb lbs oz gram grams kilogram kilograms ton tons pound pounds ounce ounces ml cl l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years percent % degrees celsius fahrenheit kelvin usd eur gbp dollar dollars euro euros cent cents mph kmh hz khz mhz ghz w kw kwh v a j kj cal kcal pa bar n".split())

_NUMBER = re.compile(r"[$€£+-]?\d[\d.,:/]*(?:st|nd|rd|th|%)?")
_GLUED = re.compile(r"[$€£+-]?\d[\d.,]*([a-z%°]+)")
_EDGES = re.compile(r"^\W+|[^\w%]+$")
#: What may stand around a word that is compared as it is; signs and operators are part of it.
_OUTER = re.compile(r"^[\"'(\[{“‘«¿¡「『（]+|[\"')\]}”’».,;:!?…。、，！？」』）]+$")
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3001-\u3007\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff01\uff0c\uff1f\uff66-\uff9d\U00020000-\U0003ffff]")
_RUN = re.compile(r"[^\W\d_]+|\d+")
_PLAIN, _NUM, _QUANTITY, _NAME, _UNIT = range(5)
_SLOTS = np.array([0, 0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7], np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Words(dict):
    """Numbers for words as they are written; the arrays have what templates need of each number."""

    def __init__(self):
        super().__init__()
        self.text, self.raw = [], []
        size = REMEMBERED + (1 << 10)
        self.code, self.exact, self.kind = np.zeros(size, np.uint64), np.zeros(size, np.uint64), np.zeros(size, np.int8)
        self.capital, self.unit, self.ends, self.single, self.mixed = (np.zeros(size, bool) for _ in range(5))

    def forget(self):
        """Forget the words beyond the first REMEMBERED: the frequent ones are among these, others are met again rarely."""
        for raw in self.raw[REMEMBERED:]:
            del self[raw]
        for name in ("code", "exact", "kind", "capital", "unit", "ends", "single", "mixed"):
            getattr(self, name)[REMEMBERED : len(self.text)] = 0
        del self.raw[REMEMBERED:], self.text[REMEMBERED:]

    def _grow(self):
        for name in ("code", "exact", "kind", "capital", "unit", "ends", "single", "mixed"):
            old = getattr(self, name)
            setattr(self, name, np.concatenate((old, np.zeros_like(old))))

    def _letters(self, raw: str) -> int:
        """As ``__missing__`` for a word of letters alone, as most are: nothing stands around it, and it is no number in digits."""
        low, n = raw.lower(), len(self.text)
        if n == len(self.code):
            self._grow()
        self.code[n] = self.exact[n] = xxhash.xxh64_intdigest(low.encode())
        if low in NUMBER_WORDS:
            self.kind[n] = _NUM
        elif low != raw and len(raw) > 1 and raw[0].isupper() and raw[1:].islower():
            self.capital[n] = True
        if low in UNITS:
            self.unit[n] = True
        self.text.append(low)
        self.raw.append(raw)
        self[raw] = n
        return n

    def __missing__(self, raw: str) -> int:
        if raw.isalpha() and (raw.isascii() or not _UNSPACED.search(raw)):
            return self._letters(raw)
        word = _EDGES.sub("", raw)
        low = word.lower()
        kind = _PLAIN
        if _NUMBER.fullmatch(low) or low in NUMBER_WORDS:
            kind = _NUM
        elif (m := _GLUED.fullmatch(low)) and m[1] in UNITS:
            kind = _QUANTITY
        n = len(self.text)
        if n == len(self.code):
            self._grow()
        self.code[n] = xxhash.xxh64_intdigest(low.encode("utf-8", "surrogatepass")) if low else 0
        same = _OUTER.sub("", raw.lower())
        self.exact[n] = xxhash.xxh64_intdigest(same.encode("utf-8", "surrogatepass")) if same else 0
        self.kind[n] = kind
        self.capital[n] = kind == _PLAIN and len(word) > 1 and word[0].isupper() and word[1:].islower()
        self.unit[n] = low in UNITS
        self.ends[n] = raw[-1] in ".!?:;"
        if not raw.isascii() and _UNSPACED.search(raw):
            self.single[n], self.mixed[n] = len(raw) == 1, len(raw) > 1
        self.text.append(low)
        self.raw.append(raw)
        self[raw] = n
        return n

    def numbers(self, text: str) -> np.ndarray:
        """The numbers of the text's words, good until the next text; each character of a script without spaces is a word."""
        if len(self) > REMEMBERED:
            self.forget()
        at = np.array([self[w] for w in text.split()], np.int64)
        if self.mixed[at].any():
            at = np.array([self[w] for w in _UNSPACED.sub(r" \g<0> ", text).split()], np.int64)
        return at

    def template(self, at: np.ndarray):
        """(codes, kinds, words) of the words that have a letter or digit; numbers, names and units are slots."""
        if not len(at):
            return np.zeros(0, np.uint64), np.zeros(0, np.int8), at
        code, kind, capital, unit, ends = (x[at] for x in (self.code, self.kind, self.capital, self.unit, self.ends))
        inside = np.zeros(len(at), bool)
        inside[1:] = ~ends[:-1]
        kind[capital & inside] = _NAME
        after = np.zeros(len(at), bool)
        after[1:] = kind[:-1] == _NUM
        kind[unit & after] = _UNIT
        code = np.where(kind > 0, _SLOTS[kind], code)
        real = code != 0
        return code[real], kind[real], at[real]


def windows(code: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all windows of ``size`` words."""
    n = len(code) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(size):
        h *= _BASE
        h += code[i : i + n]
    h ^= h >> np.uint64(31)
    h *= _BASE
    return h


def _good(kind: np.ndarray, size: int) -> np.ndarray:
    """Which windows of ``size`` words have words enough outside of slots."""
    fixed = np.concatenate(([0], np.cumsum(kind == _PLAIN)))
    return fixed[size:] - fixed[:-size] >= FIXED_WORDS


def whole_runs(text: str) -> int:
    """How many runs of letters or digits a text has; a character of a script without spaces is a run."""
    return sum(len(_RUN.findall(x)) for x in _UNSPACED.sub(r" \g<0> ", text).split())


def item_windows(text: str, words: Words) -> tuple[int, bool, list[tuple[int, int, int, int, bool]], list[str]]:
    """(needed, exact, windows, said) of an item.

    windows: (size, hash, place, hash that counts, whether its first word is to be the item's own).  If ``exact``,
    they are of the words as they are, and all have to be there in one place; else of the template.  No window means
    that the item is never held.  said: the words of the template, or of the exact form.
    """
    every = words.numbers(text)
    code, kind, at = words.template(every)
    size = min(WINDOW, len(code))
    good = _good(kind, size) if size >= FIXED_WORDS else np.zeros(0, bool)
    if good.any():
        h = windows(code, size)
        least = LEAST_UNSPACED if 2 * words.single[at].sum() > len(at) else LEAST_WINDOWS
        out = [(size, int(h[q]), q, int(h[q]), False) for q in np.flatnonzero(good).tolist()]
        # the first word may be taken for a name or a unit where other words stand before it
        for other, may in ((_NAME, words.capital), (_UNIT, words.unit)):
            if good[0] and kind[0] == _PLAIN and may[at[0]]:
                begun = np.concatenate((_SLOTS[other : other + 1], code[1:size]))
                out.append((size, int(windows(begun, size)[0]), 0, int(h[0]), True))
        return min(least, len({x[3] for x in out})), False, out, [words.text[i] for i in at]
    exact = words.exact[every]
    exact = exact[exact != 0]
    if whole_runs(text) < LEAST_RUNS or not len(exact):
        return 0, True, [], []
    h = windows(exact, size := min(WINDOW, len(exact)))
    return len(h), True, [(size, x, q, x, False) for q, x in enumerate(h.tolist())], []


def _signed(hashes) -> np.ndarray:
    return np.array(hashes, np.uint64).view(np.int64)


def templates(benchmark: DataFrame) -> DataFrame:
    """(item, needed, exact, size, h, q, counts, begun, said) for each window of ``benchmark`` (item, text).

    said: the words of the window's places in the item, by which slots are compared.
    """

    def read(batches):
        words = Words()
        for b in batches:
            out = []
            for item, text in zip(b["item"], b["text"]):
                needed, exact, found, said = item_windows(text, words)
                for size, h, q, counts, begun in found:
                    out.append((item, needed, exact, size, h, q, counts, begun, said[q : q + size]))
            done = pd.DataFrame(out, columns=["item", "needed", "exact", "size", "h", "q", "counts", "begun", "said"])
            yield done.assign(h=_signed(done["h"].tolist()), counts=_signed(done["counts"].tolist()))

    return benchmark.mapInPandas(lean(read), "item long, needed int, exact boolean, size int, h long, q int, counts long, begun boolean, said array<string>")


def passing(docs: DataFrame, known: np.ndarray, sizes: list[int], exact_sizes: list[int]) -> DataFrame:
    """(t1, t2, exact, size, h, p, kinds, said): the windows of ``docs`` (t1, t2, text) whose hash may be the benchmark's.

    ``known`` is a bitmap of fixed size over the benchmark's hashes: it only saves shuffling.
    """
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def read(batches):
        words = Words()
        for b in batches:
            out = []
            for t1, t2, text in b[["t1", "t2", "text"]].itertuples(index=False):
                every = words.numbers(text)
                code, kind, at = words.template(every)
                for size in sizes:
                    h = windows(code, size).view(np.int64)
                    for p in np.flatnonzero(_maybe(shared.value, h)).tolist():
                        out.append((t1, t2, False, size, int(h[p]), p, kind[p : p + size].tolist(), [words.text[i] for i in at[p : p + size]]))
                if exact_sizes:
                    exact = words.exact[every]
                    exact = exact[exact != 0]
                    for size in exact_sizes:
                        h = windows(exact, size).view(np.int64)
                        out += [(t1, t2, True, size, int(h[p]), p, [], []) for p in np.flatnonzero(_maybe(shared.value, h)).tolist()]
            yield pd.DataFrame(out, columns=["t1", "t2", "exact", "size", "h", "p", "kinds", "said"])

    return docs.mapInPandas(lean(read), "t1 long, t2 long, exact boolean, size int, h long, p int, kinds array<int>, said array<string>")


def _maybe(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & ((1 << SKETCH_BITS) - 1)
    return (bits[at >> 6] >> (at & 63)) & 1 == 1


def held_items(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(t1, t2, item, n): the items that texts of ``docs`` (t1, t2, text) hold, and n windows of each.

    The windows of documents and items are joined by their hashes.  Those of one occurrence lie on a diagonal, the
    same distance apart in both.  A diagonal counts if the words in its slots are consistent: where the item has one
    word, the document has one.
    """
    items = stash(templates(benchmark), "templates")
    sizes = items.select("size", "exact").distinct().collect()  # 2 * WINDOW at most
    known = sketch(items.select("h"), "h")
    some = passing(docs, known, sorted(r.size for r in sizes if not r.exact), sorted(r.size for r in sizes if r.exact))
    theirs = items.withColumnRenamed("said", "theirs")
    met = some.join(theirs, ["exact", "size", "h"]).where("not begun or said[0] = theirs[0]")
    met = stash(met.select("t1", "t2", "item", "needed", "exact", (F.col("p") - F.col("q")).alias("diagonal"), "counts", "q", "kinds", "said", "theirs"), "met")
    on = ["t1", "t2", "item", "diagonal"]
    slots = met.where("not exact").select(*on, F.explode(F.arrays_zip("kinds", "said", "theirs")).alias("x")).where("x.kinds > 0")
    slots = slots.groupBy(*on, "x.kinds", "x.theirs").agg((F.min("x.said") < F.max("x.said")).alias("torn")).where("torn")
    torn = slots.select(*on).distinct()
    by_template = met.where("not exact").join(torn, on, "left_anti").groupBy("t1", "t2", "item", "needed").agg(F.count_distinct("counts").alias("n"))
    by_words = met.where("exact").groupBy(*on, "needed").agg(F.count_distinct("q").alias("n")).drop("diagonal")
    return by_template.unionByName(by_words).where("n >= needed").groupBy("t1", "t2", "item").agg(F.max("n").cast("int").alias("n"))


def _keyed(text_col: str):
    """Two hashes by which a text is known: what it holds depends on nothing else."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return F.xxhash64(text), F.xxhash64(F.lit(1), text)


def _asked(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text: str) -> DataFrame:
    t1, t2 = _keyed(text_col)
    texts = docs.select(t1.alias("t1"), t2.alias("t2"), F.col(text_col).alias("text")).where("text is not null and text <> ''")
    items = benchmark.where(F.col(item_col).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_col).cast("long").alias("item"), F.col(item_text).alias("text"))
    return held_items(texts, items)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, items, windows): the benchmark items that each row of ``docs`` holds, re-parameterised or not.

    Words are compared in lower case without the punctuation around them.  Numbers, names (words in capitals
    that do not begin a sentence) and units after numbers become typed slots; each character of a script without
    spaces is a word.  The windows of 8 words of the benchmark's templates are joined by hash with those of whole
    documents, however long these are.  The windows of one occurrence of an item count if equal slot values of the
    item always meet equal values in the document.  An item is held if 3 of its windows count (13 of characters), or
    all if it has fewer.  An item with no window of 4 words outside of slots (short, or mostly numbers and names) is
    held where all its words stand as they are, signs and operators too.  An item's first word also counts where the
    document's words before it make it a name or unit.  Only items of fewer than 3 runs of letters or digits are
    never held: a single word or two are in any text.

    A bitmap of fixed size over the benchmark's hashes spares the windows of documents that no item has the shuffle;
    the benchmark itself stays distributed, whatever its size.  Null texts hold nothing, null items are left out;
    item ids are cast to long; rows that repeat are judged each; other columns, whatever they are called, are not
    read; ``items`` is in ascending order and empty for clean documents.
    """
    found = _asked(docs, benchmark, text_col, item_col, item_text).groupBy("t1", "t2").agg(F.array_sort(F.collect_list("item")).alias("items"), F.sum("n").alias("windows"))
    t1, t2 = _keyed(text_col)
    rows = docs.select(F.col(id_col).alias("id"), t1.alias("t1"), t2.alias("t2")).join(stash(found, "held"), ["t1", "t2"], "left")
    return rows.select("id", F.coalesce("items", F.expr("cast(array() as array<bigint>)")).alias("items"), F.coalesce("windows", F.lit(0)).cast("long").alias("windows"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a benchmark item.  Columns stay, whatever they are called."""
    found = stash(_asked(docs, benchmark, text_col, "item_id", "text").select("t1", "t2").distinct(), "held")
    t1, t2 = _keyed(text_col)
    rows = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("row"), t1.alias("t1"), t2.alias("t2"))
    return rows.join(found, ["t1", "t2"], "left_anti").select("row.*")
