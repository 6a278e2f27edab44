"""Best-fit packing of token sequences by a grouping genetic algorithm (operator 3)."""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, stash

#: Tokens of a sequence, and the id that ends a document.
CAPACITY, END = 2048, 0
#: Pieces that are packed together, islands for each such block, and rounds between which elites migrate.
BLOCK, ISLANDS, ROUNDS = 8192, 3, 2
#: Solutions on an island, and crossovers in a round.
POPULATION, CROSSOVERS = 4, 6
#: Blocks that come to a Python worker at once.
BLOCK_ROWS = 16
#: Characters in a run of letters or of white space from which on a text goes to the slower encoder, whose time grows less.
LONG_RUN = 1000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of() -> dict[str, int]:
    """The byte that each letter of byte-level BPE stands for: itself if printable in Latin-1, else letters from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = (b for b in range(256) if b not in set(plain))
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """Little-endian unsigned 32-bit ids of texts, those that ``tokenizers`` gives without special tokens added.

    A byte-level BPE file whose merges stand in the order of their ids is also the rank table of a faster encoder
    that keeps nothing between texts; that encoder's time grows with the square of a run's length, so texts with
    long runs, and files of any other kind, go to ``tokenizers`` itself.  Special tokens' strings in a text get
    their own ids.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.fast = self._ranked(path)

    @staticmethod
    def _ranked(path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, added = spec["model"], {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        if model.get("type") != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space"):
            return None
        if spec.get("normalizer") or any(x.get("lstrip") or x.get("rstrip") or x.get("single_word") for x in spec.get("added_tokens", [])):
            return None
        byte_of, vocab = _byte_of(), {w: i for w, i in model["vocab"].items() if w not in added}
        merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if merged != sorted(merged):
            return None
        ranks = {bytes(map(byte_of.__getitem__, w)): i for w, i in vocab.items()}
        return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)

    def ids(self, text: str) -> bytes:
        if self.fast is not None:
            sizes = [*map(len, text.split())]
            # white space beyond one character a word is at least as long as the longest run of it
            if max(sizes, default=0) <= LONG_RUN and len(text) - sum(sizes) - len(sizes) <= LONG_RUN:
                return self.fast.encode_to_numpy(text, allowed_special="all").tobytes()
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@cache
def encoder(path: str) -> Encoder:
    """A worker's own: it stays from task to task and does not grow."""
    return Encoder(path)


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """(id, piece, start, length, crc): each document's ids, then ``END``, cut if longer than ``capacity``.

    The first piece takes the remainder, all others are full.  A null text counts as empty; a null id stays null; ids
    are cast to long; repeated rows are cut each; other columns, whatever they are called, are not read; an empty
    table gives an empty one.  A text is encoded whole, however long it is.
    """
    path = tokenizer or default_tokenizer()

    def cut(batches):
        known = encoder(path)
        for b in batches:
            at, out, crcs = [], [], []
            for row, text in enumerate(b["text"]):
                ids = known.ids(text or "") + END.to_bytes(4, "little")
                n = len(ids) // 4
                ends = [*range((n - 1) % capacity + 1, n + 1, capacity)]
                for k, (start, end) in enumerate(zip([0, *ends], ends)):
                    at.append(row)
                    out.append((k, start, end - start))
                    crcs.append(zlib.crc32(ids[4 * start : 4 * end]))
            cuts = np.array(out, np.int64).reshape(-1, 3)
            yield pd.DataFrame({"id": b["id"].array[np.array(at, np.int64)], "piece": cuts[:, 0].astype(np.int32), "start": cuts[:, 1], "length": cuts[:, 2], "crc": np.array(crcs, np.int64)})

    # as text: nulls would turn long ids into floating-point numbers
    rows = docs.select(F.col(id_col).cast("long").cast("string").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(lean(cut), "id string, piece int, start long, length long, crc long").withColumn("id", F.col("id").cast("long"))


# A solution is a list of bins, a bin a list of item numbers.


def _best_fit(bins: list[list[int]], items, lengths, capacity: int) -> list[list[int]]:
    """Put each of ``items`` in turn into the fullest bin that has room for it, or into a new one."""
    room = sorted((capacity - sum(lengths[i] for i in b), k) for k, b in enumerate(bins))
    for i in items:
        at = bisect_left(room, (lengths[i], -1))
        if at < len(room):
            left, k = room.pop(at)
            bins[k].append(i)
        else:
            left, k = capacity, len(bins)
            bins.append([i])
        if left > lengths[i]:
            insort(room, (left - lengths[i], k))
    return bins


def _fitness(bins, lengths, capacity):
    """Fewer bins first, then fuller ones: mean of squared fill."""
    return (-len(bins), sum((sum(lengths[i] for i in b) / capacity) ** 2 for b in bins) / max(1, len(bins)))


def _crossover(a, b, lengths, capacity, rng):
    """Inject whole well-filled bins of ``b`` into ``a``; drop bins of ``a`` that hold their items, best-fit the rest."""
    fill = sorted(b, key=lambda bin_: -sum(lengths[i] for i in bin_))
    well = fill[: max(1, len(fill) // 2)]
    share = rng.uniform(0.2, 0.8)
    given = [list(x) for x in well if rng.random() < share] or [list(well[0])]
    taken = {i for x in given for i in x}
    kept, displaced = [], []
    for x in a:
        if taken.isdisjoint(x):
            kept.append(list(x))
        else:
            displaced += [i for i in x if i not in taken]
    # some of the emptiest bins are opened as well, so that their items can close gaps
    kept.sort(key=lambda bin_: sum(lengths[i] for i in bin_))
    for x in kept[: len(kept) // 50 + 1]:
        displaced += x
    kept = kept[len(kept) // 50 + 1 :]
    displaced.sort(key=lambda i: -lengths[i])
    return _best_fit(given + kept, displaced, lengths, capacity)


def evolve(lengths: list[int], population: list, capacity: int, seed: int, crossovers: int = CROSSOVERS) -> list:
    """The population after a round, the best first; it starts from best-fit packings of shuffled orders."""
    rng = np.random.default_rng(seed)
    least = -(-sum(lengths) // capacity)
    if not population:
        order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
        population = [_best_fit([], order, lengths, capacity)]
    while len(population) < POPULATION and len(population[0]) > least:
        noise = rng.uniform(0.8, 1.2, len(lengths))
        order = sorted(range(len(lengths)), key=lambda i: -lengths[i] * noise[i])
        population.append(_best_fit([], order, lengths, capacity))
    rated = sorted(((_fitness(p, lengths, capacity), p) for p in population), key=lambda x: x[0], reverse=True)
    for _ in range(crossovers):
        if -rated[0][0][0] <= least or len(rated) < 2:
            break
        x, y = sorted(rng.choice(len(rated), 2, replace=False))
        child = _crossover(rated[x][1], rated[y][1], lengths, capacity, rng)
        rated.append((_fitness(child, lengths, capacity), child))
        rated = sorted(rated, key=lambda x: x[0], reverse=True)[:POPULATION]
    return [p for _, p in rated]


def _dump(bins: list[list[int]], n: int) -> bytes:
    out = np.zeros(n, np.int32)
    for k, b in enumerate(bins):
        out[b] = k
    return out.tobytes()


def _load(raw: bytes) -> list[list[int]]:
    at = np.frombuffer(raw, np.int32)
    order = np.argsort(at, kind="stable")
    return [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(at[order])) + 1)] if len(at) else []


_ROW = np.dtype([("id", "<i8"), ("known", "<i1"), ("piece", "<i4"), ("start", "<i8"), ("length", "<i8"), ("crc", "<i8")])


def pack(cut: DataFrame, capacity: int = CAPACITY, block: int = BLOCK, seed: int = 1) -> DataFrame:
    """``cut`` (id, piece, start, length, crc; lengths up to ``capacity``) with sequence_id and offset.

    Rows are dealt by a hash of their number into blocks of about ``block``, which are packed apart; a block costs at
    most one partly filled sequence more than all together.  Each block lives on several islands with other seeds; an
    island's best solution moves on to the next between the rounds, the best of all is taken.  Rows that are equal, or
    have no id, are packed as often as they come and fall into different blocks; pieces of equal length may take each
    other's places; no row gives no row.
    """
    fields = ("id", "piece", "start", "length", "crc")
    cut = stash(cut.select(*fields, F.monotonically_increasing_id().alias("row")), "pieces")
    blocks = max(1, -(-cut.count() // block))
    dealt = cut.select(
        F.coalesce("id", F.lit(0)).alias("id"), F.col("id").isNotNull().cast("byte").alias("known"), *fields[1:], "row",
        F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"),
    )

    def gather(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("row")
        rows = np.zeros(len(b), _ROW)
        for name in _ROW.names:
            rows[name] = b[name].to_numpy()
        return pd.DataFrame({"block": [b["block"].iloc[0]], "rows": [rows.tobytes()]})

    gathered = stash(dealt.groupBy("block").applyInPandas(gather, "block int, rows binary"), "blocks")
    # islands get the lengths alone
    lengths_of = F.pandas_udf(lambda blobs: blobs.map(lambda raw: np.frombuffer(raw, _ROW)["length"].astype(np.int32).tobytes()), "binary")
    every = stash(gathered.select("block", lengths_of("rows").alias("lengths")), "lengths", BLOCK_ROWS).withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))))

    def island_round(number: int):
        def run(batches):
            for b in batches:
                for at, island, raw, own, came in b[["block", "island", "lengths", "own", "came"]].itertuples(index=False):
                    lengths = np.frombuffer(raw, np.int32).tolist()
                    start = [_load(x) for x in {own, came} - {None} if x]
                    best = evolve(lengths, start, capacity, seed + at * 1000 + island * 10 + number)
                    yield pd.DataFrame([(at, island, _dump(best[0], len(lengths)), len(best[0]))], columns=["block", "island", "own", "bins"])

        return run

    # a shuffle, so that islands of a block are not one task's work; BLOCK_ROWS of them come to a worker at once
    every = every.repartition(max(1, min(blocks * ISLANDS, 4 * int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions")))), "block", "island")
    state = every.withColumns({"own": F.lit(None).cast("binary"), "came": F.lit(None).cast("binary")})
    for number in range(ROUNDS):
        solved = stash(state.mapInPandas(lean(island_round(number)), "block int, island int, own binary, bins int"), "islands", BLOCK_ROWS)
        came = solved.select("block", ((F.col("island") + 1) % ISLANDS).alias("island"), F.col("own").alias("came"))
        state = every.join(solved.select("block", "island", "own"), ["block", "island"]).join(came, ["block", "island"])
    best = solved.groupBy("block").agg(F.min(F.struct("bins", "island")).alias("best")).select("block", "best.island")
    best = solved.select("block", "island", "own").join(best, ["block", "island"], "left_semi")

    def place(batches):
        for b in batches:
            for at, raw, own in b[["block", "rows", "own"]].itertuples(index=False):
                rows, where = np.frombuffer(raw, _ROW), np.frombuffer(own, np.int32)
                order = np.argsort(where, kind="stable")
                ends = np.cumsum(rows["length"][order])
                starts = ends - rows["length"][order]
                first = np.ones(len(order), bool)
                first[1:] = where[order][1:] != where[order][:-1]
                base = np.repeat(starts[first], np.diff(np.append(np.flatnonzero(first), len(order))))
                out = pd.DataFrame({name: rows[name][order] for name in _ROW.names})
                out["known"] = out["known"] > 0
                out["sequence_id"] = (np.int64(at) << np.int64(32)) + where[order]
                out["offset"] = starts - base
                yield out

    done = gathered.join(best.select("block", "own"), "block").mapInPandas(
        place, "id long, known boolean, piece int, start long, length long, crc long, sequence_id long, offset long"
    )
    done = stash(done, "packed", BLOCK_ROWS)
    return done.select(F.when(F.col("known"), F.col("id")).alias("id"), *fields[1:], "sequence_id", "offset")
