"""Personal data by bootstrapped contextual extraction (operator 1), with SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash, text_or_empty, unstash
from .spans import contexts, let, of_kind, told, with_matches

KINDS = ("email", "ip", "card", "phone")
_LOCAL, _LABEL = "A-Za-z0-9._%+-", "A-Za-z0-9-"
#: Possessive and begun only where a run begins or the last match ended, so that long runs take linear time.
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[{_LABEL}]++(?:\.[{_LABEL}]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Characters of a word that may be an identifier; it has a digit, @ or what is written for it.  Anything else ends it, so
#: that words are found in text without spaces too.  Numbers that stand one space apart are one candidate.
_CHAR = r"[A-Za-z0-9._%+@()\[\]-]"
_AT = r"[(\[]at[)\]]"
_NUMBER = rf"(?<!{_CHAR})[+(]?[0-9][0-9().-]*+(?!{_CHAR})(?:[ ][(]?[0-9]{{2}}[0-9().-]*+(?!{_CHAR}))*+"
CANDIDATE = rf"{_NUMBER}|(?<!{_CHAR})(?:(?!{_AT})[A-Za-z._%+()\[\]-])*+(?:[0-9@]|{_AT}){_CHAR}*+"
#: Rounds of scoring at most, believed instances that a pattern needs, and the score from which it is believed.
ROUNDS, LEAST, BELIEVED = 10, 3, 0.75
#: Growth of all belief in a round, as a share, below which nothing new is expected.
SETTLED = 0.001
#: What an instance of each kind must look like to be believed.
SHAPES = {
    "email": r"^[^\s@]+(?:@|\(at\)|\[at\])[^\s@]+$",
    "ip": r"^[^0-9]*+[0-9]++(?:[.,-][0-9]++){2,}+[^0-9]*+$",
    "card": r"^\D*+(?:\d\D?+){12,19}+$",
    "phone": r"^\D*+(?:\d\D{0,2}+){7,15}+$",
}


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def value(i):
        d = F.substring(digits, n - i, F.lit(1)).cast("int") * (1 + i % 2)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, i: acc + value(i)) % 10 == 0


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _holds(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^(?:{_BYTE}\.){{3}}{_BYTE}$")
    if kind == "card":
        return F.length(_digits(m)).between(12, 19) & F.when(F.length(_digits(m)).between(12, 19), luhn(_digits(m))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def _valid(kind: str) -> Column:
    return F.filter(kind, lambda x: _holds(kind, x["match"]))


def _seen(x: Column) -> Column:
    """A base match: its place, what it is and the patterns around it."""
    return F.struct(x["start"].alias("start"), x["end"].alias("end"), F.xxhash64(F.lower(x["match"])).alias("instance"), contexts(x["before"], x["after"]).alias("patterns"))


def _bare(x: Column) -> Column:
    """A candidate without the punctuation around it; ``kinds`` has a bit for each kind that it looks like."""
    lead = F.length(F.regexp_extract(x["match"], r"^(?:[._%\[-]|\((?![0-9]+\)))*+", 0))
    # read backwards; a bracket stays if it was opened shortly before
    tail = F.length(F.regexp_extract(F.reverse(x["match"]), r"^(?:[._%+(\[-]|[)\]](?![0-9A-Za-z]{1,8}[(\[]))*+", 0))
    looks = lambda m: sum((F.when(m.rlike(SHAPES[kind]), 1 << k).otherwise(0) for k, kind in enumerate(KINDS)), F.lit(0))

    def cut(size):
        core = F.substring(x["match"], size["lead"] + 1, F.length(x["match"]) - size["lead"] - size["tail"])
        return let(core, lambda m: F.struct(
            (x["start"] + size["lead"]).alias("start"), (x["end"] - size["tail"]).alias("end"), F.xxhash64(F.lower(m)).alias("instance"), looks(m).alias("kinds"), contexts(x["before"], x["after"]).alias("patterns"),
        ))

    return let(F.struct(lead.alias("lead"), tail.alias("tail")), cut)


def _scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, row, email, ip, card, phone, word): the base matches of each kind, and the candidates."""
    rows = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), text_or_empty(text_col).alias("text"))
    digit = F.col("text").rlike("[0-9]")
    some = {"email": F.contains("text", F.lit("@")), "ip": digit, "card": digit, "phone": F.contains("text", F.lit("+"))}
    for kind in KINDS:
        rows = with_matches(rows, kind, "text", PATTERNS[kind], some[kind])
        rows = rows.withColumn(kind, F.transform(_valid(kind), _seen))
    rows = with_matches(rows, "word", "text", CANDIDATE, digit | some["email"] | F.contains("text", F.lit("(at)")) | F.contains("text", F.lit("[at]")))
    return rows.withColumn("word", F.transform("word", _bare)).drop("text")


#: Code points of a stretch in which base spans and candidates meet.
_STRETCH = 64


def _stretches(start: str, end: str) -> Column:
    return F.explode(F.sequence(F.floor(F.col(start) / _STRETCH), F.floor((F.greatest(F.col(end), F.col(start) + 1) - 1) / _STRETCH)))


def _candidates(scanned: DataFrame) -> DataFrame:
    """(row, start, end, instance, kinds, patterns): the candidates that overlap no base span."""
    words = scanned.select("row", F.explode("word").alias("x")).select("row", "x.*")
    spans = F.concat(*(F.transform(kind, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))) for kind in KINDS))
    base = scanned.select("row", F.explode(spans).alias("x")).select("row", F.col("x.start").alias("from"), F.col("x.end").alias("to"))
    base = base.withColumn("stretch", _stretches("from", "to"))
    met = words.select("row", "start", "end", _stretches("start", "end").alias("stretch")).join(base, ["row", "stretch"])
    met = met.where((F.col("from") < F.col("end")) & (F.col("start") < F.col("to"))).select("row", "start").distinct()
    return words.join(met, ["row", "start"], "left_anti")


def patterns(scanned: DataFrame, candidates: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, kind, score): the contexts that introduce a kind of identifier.

    Edges of the graph join a pattern and an instance that stands in it.  Seeds, the base matches, are believed.  A
    pattern's score is the belief in its instances, divided by the number of all that stand in it and one more; it is
    believed from BELIEVED on, with LEAST instances of the kind that are believed.  A candidate that looks like the
    kind is believed as its best such pattern is, and then supports the other patterns that it stands in, until a
    round finds no new instance and hardly adds to the belief in the others, or for ``rounds`` rounds.  Scores never fall, so neither does what is believed.
    """
    kinds = [scanned.select(F.lit(k).alias("kind"), F.explode(kind).alias("x")) for k, kind in enumerate(KINDS)]
    seeds = kinds[0].union(kinds[1]).union(kinds[2]).union(kinds[3]).select("kind", F.col("x.instance").alias("instance"), F.explode("x.patterns").alias("pattern"))
    seeds = stash(seeds.distinct(), "seeds")
    each = candidates.select("instance", "kinds", F.explode("patterns").alias("pattern"))
    fitting = each.where("kinds > 0").distinct()
    own = seeds.select("pattern", "instance").unionByName(fitting.select("pattern", "instance")).distinct()
    known = stash(own.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST).select("pattern"), "known")
    edges = stash(fitting.join(known, "pattern", "left_semi"), "edges")
    every = each.select("pattern", "instance").distinct().join(known, "pattern", "left_semi")
    every = every.unionByName(seeds.select("pattern", "instance").join(known, "pattern", "left_semi")).distinct()
    total = stash(every.groupBy("pattern").agg(F.count("*").alias("total")), "totals")
    given = seeds.groupBy("pattern", "kind").agg(F.count("*").alias("n"), F.count("*").cast("double").alias("belief"))
    found, before = None, (-1, 0.0)
    for _ in range(rounds):
        support = given
        if found is not None:
            gained = edges.join(found, "instance").groupBy("pattern", "kind").agg(F.count("*").alias("n"), F.sum("belief").alias("belief"))
            support = given.unionByName(gained).groupBy("pattern", "kind").agg(F.sum("n").alias("n"), F.sum("belief").alias("belief"))
        score = support.where(F.col("n") >= LEAST).join(total, "pattern").select("pattern", "kind", (F.col("belief") / (F.col("total") + 1)).alias("score"))
        score = stash(score.where(F.col("score") >= BELIEVED), "scores")
        looks = F.expr("kinds & shiftleft(1, kind)") > 0
        found = stash(edges.join(score, "pattern").where(looks).groupBy("instance", "kind").agg(F.max("score").alias("belief")), "found")
        now = found.agg(F.count("*"), F.coalesce(F.sum("belief"), F.lit(0.0))).first()
        if now[0] == before[0] and now[1] < before[1] * (1 + SETTLED) + SETTLED:
            break
        before = now
    unstash(seeds, known)
    return score


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base, spans, added) for each row of ``docs``.

    ``base`` and ``spans`` are arrays of (start, kind, end) in code points, the end exclusive, kind an index of
    KINDS; spans are the base ones and ``added``: candidates that stand in a believed pattern, look like its kind and
    overlap no base span.  Of several kinds the one of best score is taken, then the first.  Contexts are looked for
    in the ``spans.NEAR`` characters next to a place; candidates have any length.  A null text is empty and has none;
    rows that repeat are found each, whatever their ids; very long texts are searched whole; other columns are not
    read; an empty table gives an empty one.
    """
    scanned = stash(_scan(docs, id_col, text_col), "matches")
    candidates = stash(_candidates(scanned), "candidates")
    believed = patterns(scanned, candidates)
    looks = F.expr("kinds & shiftleft(1, kind)") > 0
    places = candidates.where("kinds > 0").select("row", "start", "end", "kinds", F.explode("patterns").alias("pattern")).join(believed, "pattern").where(looks)
    places = places.groupBy("row", "start", "end").agg(F.min_by("kind", F.struct(-F.col("score"), "kind")).alias("kind"))
    new = places.groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("new"))
    base = F.array_sort(F.concat(*(of_kind(F.col(kind), k) for k, kind in enumerate(KINDS))))
    rows = scanned.select("id", "row", base.alias("base"), *(F.size(kind).cast("long").alias(f"n_{kind}") for kind in KINDS))
    rows = rows.join(new, "row", "left").withColumn("added", F.array_sort(F.coalesce("new", F.expr("cast(array() as array<struct<start: bigint, kind: int, end: bigint>>)"))))
    return rows.select("id", *(f"n_{kind}" for kind in KINDS), "base", F.array_sort(F.concat("base", "added")).alias("spans"), "added")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, the numbers of base spans, the hash of these, all spans, and how many these are."""
    return found.select(
        F.col("id").alias("doc_id"), *(f"n_{kind}" for kind in KINDS), F.sha2(told(F.col("base"), KINDS), 256).alias("base_sha256"), told(F.col("spans"), KINDS).alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
    )
