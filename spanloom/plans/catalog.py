"""The engine's queries on the star schema, each with the statement that checks it."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import policy, texts
from ..functions.expr import reject
from ..functions.wire import range_size
from ..operators import blocks, columns, compare, grid, prefixes, reads, store, sweep, tables, tree
from . import archives
from . import mapping as m

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(text: str = "", *views: str):
    def take(f):
        QUERIES[f.__name__] = f
        if text:
            ORACLE_SQL[f.__name__] = m.sql(text, *views)
        return f

    return take


#: Blocks of a size that the tables' offsets reach, so that what is carried from block to block is checked too.
BLOCK = 1 << 14


def big(c):
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


# the store


@query("""SELECT k.key AS key, coalesce(e.kind, 'missing') AS kind
FROM (SELECT CASE WHEN p_partkey % 3 = 0 THEN '__vz__/' ELSE 'o/' END || lpad(cast(p_partkey * 11 AS varchar), 10, '0') AS key FROM part) k
LEFT JOIN (SELECT * FROM entries WHERE NOT starts_with(key, '__vz__/')) e ON k.key = e.key""", "entries")
def classify_keys(spark, d):
    key = F.concat(F.when(F.col("p_partkey") % 3 == 0, "__vz__/").otherwise("o/"), F.lpad((F.col("p_partkey") * 11).cast("string"), 10, "0"))
    return store.classify(m.load(spark, d, "part").select(key.alias("key")), m.entries(spark, d))


@query("SELECT key, kind FROM entries WHERE starts_with(key, 'o/00000001') AND NOT starts_with(key, '__vz__/')", "entries")
def list_prefix(spark, d):
    return store.list_keys(m.entries(spark, d), "o/00000001").orderBy("key")


@query("SELECT DISTINCT split_part(substr(key, 4), '/', 1) AS name, contains(substr(key, 4), '/') AS is_dir FROM objects WHERE starts_with(key, 'de/')", "objects")
def list_dir(spark, d):
    return store.list_dir(m.objects(spark, d), "de/")


@query("SELECT key, count(*) AS parts, cast(sum(length) AS bigint) AS size FROM ranges GROUP BY key", "ranges")
def concat_sizes(spark, d):
    return store.concat_sizes(m.ranges(spark, d)).where("ok").select("key", "parts", big("size").alias("size"))


_OFFSETS = 'SELECT *, cast(coalesce(sum(length) OVER (PARTITION BY key ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS "begin", cast(sum(length) OVER (PARTITION BY key) AS bigint) AS total FROM ranges'


@query('SELECT key, part, "begin" FROM (' + _OFFSETS + ")", "ranges")
def part_offsets(spark, d):
    return store.part_offsets(m.ranges(spark, d)).select("key", "part", "begin")


def _window_sql(lo, hi):
    return f"""SELECT key, part, source, "offset" + greatest(lo, "begin") - "begin" AS start, "offset" + least(hi, "begin" + length) - "begin" AS stop
    FROM (SELECT *, {lo} AS lo, {hi} AS hi FROM ({_OFFSETS})) WHERE greatest(lo, "begin") < least(hi, "begin" + length)"""


@query(_window_sql("least(20, total)", "least(70, total)"), "ranges")
def get_window(spark, d):
    return store.pieces(m.ranges(spark, d), "range", 20, 70)


@query(_window_sql("least(30, total)", "total"), "ranges")
def get_offset(spark, d):
    return store.pieces(m.ranges(spark, d), "offset", 30)


@query(_window_sql("greatest(total - 25, 0)", "total"), "ranges")
def get_suffix(spark, d):
    return store.pieces(m.ranges(spark, d), "suffix", 25)


@query("""SELECT key, CASE WHEN bad IS NULL THEN value END AS value, CASE WHEN bad IS NOT NULL THEN 'resolution: part ' || bad END AS error FROM (
SELECT key, string_agg(piece, '' ORDER BY part) AS value, min(CASE WHEN piece IS NULL OR length(piece) <> stop - start THEN part END) AS bad
FROM (SELECT w.*, substr(t.text, cast(start + 1 AS bigint), cast(stop - start AS bigint)) AS piece FROM (
  SELECT key, part, source, "offset" + greatest(5, "begin") - "begin" AS start, "offset" + least(120, "begin" + length) - "begin" AS stop FROM (
    SELECT *, coalesce(sum(length) OVER (PARTITION BY key ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "begin" FROM text_ranges)
  WHERE greatest(5, "begin") < least(120, "begin" + length)) w LEFT JOIN documents t ON t.doc_id = w.source) GROUP BY key)""", "text_ranges")
def resolve_text(spark, d):
    data = m.load(spark, d, "documents").select(F.col("doc_id").alias("source"), F.col("text").alias("data"))
    return store.resolve(store.pieces(m.text_ranges(spark, d), "range", 5, 120), data)


@query("""SELECT idx, CASE WHEN seen IS NULL THEN 'missing' WHEN size IS NOT NULL AND size <> seen THEN 'size' WHEN etag IS NOT NULL AND tag IS DISTINCT FROM etag THEN 'etag'
WHEN modified_not_after IS NOT NULL AND coalesce(mtime > modified_not_after, true) THEN 'modified' END AS error FROM (
SELECT cast(s_suppkey AS bigint) AS idx, CASE WHEN s_suppkey % 5 = 0 THEN s_suppkey % 7 END AS size, CASE WHEN s_suppkey % 3 = 0 THEN '"' || s_suppkey % 4 || '"' END AS etag, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey % 11 END AS modified_not_after,
CASE WHEN s_suppkey % 13 <> 0 THEN s_suppkey % 6 END AS seen, CASE WHEN s_suppkey % 4 > 0 THEN '"' || s_suppkey % 2 || '"' END AS tag, CASE WHEN s_suppkey % 9 > 0 THEN s_suppkey % 10 END AS mtime FROM supplier)""")
def pin_check(spark, d):
    s = F.col("s_suppkey").cast("bigint")
    quoted = lambda c: F.concat(F.lit('"'), c.cast("string"), F.lit('"'))
    t = m.load(spark, d, "supplier")
    pins = t.select(s.alias("idx"), F.when(s % 5 == 0, s % 7).alias("size"), F.when(s % 3 == 0, quoted(s % 4)).alias("etag"), F.when(s % 2 == 0, s % 11).alias("modified_not_after"))
    seen = t.where(s % 13 != 0).select(s.alias("idx"), (s % 6).alias("size"), F.when(s % 4 > 0, quoted(s % 2)).alias("etag"), F.when(s % 9 > 0, s % 10).alias("mtime"))
    return store.pin_errors(pins, seen)


@query("""SELECT key, part, CASE WHEN idx IS NULL THEN 'source' ELSE 'beyond' END AS violation FROM ranges LEFT JOIN (SELECT * FROM sources WHERE idx % 10 > 0) s ON source = idx
WHERE idx IS NULL OR "offset" + length > size""", "ranges", "sources")
def bounds_check(spark, d):
    return store.range_violations(m.ranges(spark, d), m.sources(spark, d).where("idx % 10 > 0"))


@query("""SELECT key, class, part FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY r, part) AS n FROM (
SELECT *, list_position(['request','hidden','entry','body','payload','resolution'], class) AS r FROM (
SELECT key, part, CASE WHEN length % 11 = 0 THEN 'payload' WHEN "offset" % 5 = 0 THEN 'resolution' WHEN source % 17 = 0 THEN 'entry' END AS class FROM ranges)) WHERE class IS NOT NULL) WHERE n = 1""", "ranges")
def error_precedence(spark, d):
    c = F.when(F.col("length") % 11 == 0, "payload").when(F.col("offset") % 5 == 0, "resolution").when(F.col("source") % 17 == 0, "entry")
    return store.first_error(m.ranges(spark, d).select("key", "part", c.alias("class")).where("class is not null"))


@query("""SELECT q.key AS key, q.target AS target, CASE WHEN e.kind IS NULL THEN 'missing' WHEN e.kind <> 'bytes' THEN 'not bytes' END AS error
FROM (SELECT 'p/' || p_partkey AS key, 'o/' || lpad(cast(p_partkey * 13 AS varchar), 10, '0') AS target FROM part) q LEFT JOIN entries e ON e.key = q.target""", "entries")
def key_sources(spark, d):
    t = m.load(spark, d, "part")
    refs = t.select(F.concat(F.lit("p/"), F.col("p_partkey").cast("string")).alias("key"), F.concat(F.lit("o/"), F.lpad((F.col("p_partkey") * 13).cast("string"), 10, "0")).alias("target"))
    return store.key_sources(refs, m.entries(spark, d))


@query("SELECT cast(l_linenumber AS varchar) || '/' || l_orderkey AS key, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return store.duplicates(m.load(spark, d, "lineitem").select(F.concat_ws("/", F.col("l_linenumber").cast("string"), F.col("l_orderkey").cast("string")).alias("key")))


# planning of reads

_ISLANDS = """SELECT {by}, min(start) AS start, max(stop) AS stop, count(*) AS n FROM (SELECT *, sum(f) OVER (PARTITION BY {by} ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS island FROM (
SELECT *, CASE WHEN start - max(stop) OVER (PARTITION BY {by} ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= {gap} THEN 0 ELSE 1 END AS f FROM reads)) GROUP BY {by}, island"""


@query(_ISLANDS.format(by="source", gap=256), "reads")
def coalesce_reads(spark, d):
    return reads.coalesce(m.reads(spark, d), 256, width=BLOCK)


@query("SELECT key, count(*) AS reads FROM (" + _ISLANDS.format(by="key, source", gap=4096) + ") GROUP BY key HAVING count(*) > 5", "reads")
def reads_over_cap(spark, d):
    return reads.over_cap(m.reads(spark, d), 4096, 5)


_SPANS = "spans AS (SELECT source, start, stop FROM (" + _ISLANDS.format(by="source", gap=0) + "))"


@query("WITH " + _SPANS + """, g AS (SELECT *, start - lag(stop) OVER (PARTITION BY source ORDER BY start, stop) AS gap, sum(stop - start) OVER (PARTITION BY source) AS asked FROM spans),
j AS (SELECT *, CASE WHEN gap <= 700 AND sum(gap) OVER (PARTITION BY source ORDER BY gap NULLS LAST, start, stop ROWS UNBOUNDED PRECEDING) <= 3 * asked + 512 THEN 0 ELSE 1 END AS f FROM g)
SELECT source, min(start) AS start, max(stop) AS stop FROM (SELECT *, sum(f) OVER (PARTITION BY source ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS island FROM j) GROUP BY source, island""", "reads")
def greedy_gap_merge(spark, d):
    asked = m.reads(spark, d)
    big = blocks.large(asked, ["source"])
    spans = reads.coalesce(asked, 0, width=BLOCK, big=big).select("source", "start", "stop")
    return reads.merge_smallest_gaps(spans, 700, 4, 512, BLOCK, big).select("source", "start", "stop")


@query("WITH " + _SPANS + " SELECT source, start, stop, (row_number() OVER (PARTITION BY source ORDER BY start, stop) - 1) // 100 AS request FROM spans", "reads")
def pack_requests(spark, d):
    asked = m.reads(spark, d)
    big = blocks.large(asked, ["source"])
    return reads.pack_requests(reads.coalesce(asked, 0, width=BLOCK, big=big).select("source", "start", "stop"), width=BLOCK, big=big)


_WALK = """WITH RECURSIVE spans AS (SELECT source, start, stop FROM (""" + _ISLANDS.format(by="source", gap=0) + """)),
g AS (SELECT *, coalesce(start - lag(stop) OVER w <= 200, false) AS joined, row_number() OVER w AS n FROM spans WINDOW w AS (PARTITION BY source ORDER BY start)),
t AS (SELECT source, least(greatest(ceil(sum(stop - start + CASE WHEN joined THEN gap ELSE 0 END) / 4.0), 1024), 4096) AS lim FROM (SELECT *, start - lag(stop) OVER (PARTITION BY source ORDER BY start) AS gap FROM g) GROUP BY source),
r AS (SELECT g.source, n, start AS first, stop FROM g WHERE n = 1
  UNION ALL SELECT g.source, g.n, CASE WHEN g.joined AND g.stop - r.first <= t.lim THEN r.first ELSE g.start END, g.stop FROM r JOIN g ON g.source = r.source AND g.n = r.n + 1 JOIN t ON t.source = g.source)
SELECT source, first AS start, max(stop) AS stop FROM r GROUP BY source, first"""


@query(_WALK, "reads")
def split_pieces(spark, d):
    asked = m.reads(spark, d)
    big = blocks.large(asked, ["source"])
    spans = reads.coalesce(asked, 0, width=BLOCK, big=big).select("source", "start", "stop")
    return reads.split_pieces(reads.merge_smallest_gaps(spans, 200, 1000.0, width=BLOCK, big=big), 4, 1024, 4096, big)


# a request for n ranges: by the table of modes; 8 MiB at most where requests dominate, else 4 KiB
@query("""SELECT id, n, mode, CASE mode WHEN 'packed' THEN 512 WHEN 'cold' THEN 4096 WHEN 'local' THEN greatest(cast(floor(latency * bandwidth / connections) AS bigint), 4096)
ELSE CASE WHEN n * latency >= connections / 2 THEN least(greatest(cast(floor(latency * bandwidth / (1 + connections * bandwidth / 10000000)) AS bigint), 4096), 8388608) ELSE 4096 END END AS gap,
CASE WHEN mode = 'known' AND n * latency >= connections / 2 THEN 16 ELSE 4 END::bigint AS cap FROM (
SELECT p_partkey AS id, p_partkey % 40 + 1 AS n, cast(p_size AS double) / 1024 AS latency, p_retailprice * 1024 AS bandwidth, cast(p_partkey % 8 + 1 AS double) AS connections, CASE p_partkey % 4 WHEN 0 THEN 'local' WHEN 1 THEN 'packed' WHEN 2 THEN 'cold' ELSE 'known' END AS mode FROM part)""")
def read_policy(spark, d):
    p = F.col("p_partkey")
    mode = F.when(p % 4 == 0, "local").when(p % 4 == 1, "packed").when(p % 4 == 2, "cold").otherwise("known")
    stats = m.load(spark, d, "part").select(p.alias("id"), (p % 40 + 1).alias("n"), (F.col("p_size").cast("double") / 1024).alias("latency"), (F.col("p_retailprice") * 1024).alias("bandwidth"), (p % 8 + 1).cast("double").alias("connections"), mode.alias("mode"))
    return reads.read_policy(stats).select("id", "n", "mode", "gap", "cap")


@query("""SELECT source, seq, CASE WHEN count(value) OVER w >= 4 THEN median(value) OVER w END AS median FROM (SELECT user_id AS source, event_id AS seq, value FROM events)
WINDOW w AS (PARTITION BY source ORDER BY seq ROWS BETWEEN 15 PRECEDING AND CURRENT ROW)""")
def sliding_median(spark, d):
    t = m.load(spark, d, "events").select(F.col("user_id").alias("source"), F.col("event_id").alias("seq"), "value")
    return reads.sliding_median(t, 16).select("source", "seq", "median")


@query("SELECT source % 4 AS store, source % 2 = 0 AS external, count(*) AS requests, cast(sum(stop - start) AS bigint) AS bytes FROM (" + _ISLANDS.format(by="source", gap=256) + ") GROUP BY 1, 2", "reads")
def request_stats(spark, d):
    t = reads.coalesce(m.reads(spark, d), 256, width=BLOCK)
    return t.groupBy((F.col("source") % 4).alias("store"), (F.col("source") % 2 == 0).alias("external")).agg(F.count("*").alias("requests"), F.sum(F.col("stop") - F.col("start")).alias("bytes"))


# source tables and pages


@query("SELECT source, row_number() OVER (ORDER BY k, p) - 1 AS idx FROM (SELECT source, min(key) AS k, arg_min(part, (key, part)) AS p FROM ranges GROUP BY source)", "ranges")
def source_interning(spark, d):
    return tables.by_first_use(m.ranges(spark, d))


_HOST = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"


@query(f"SELECT host, n, row_number() OVER (ORDER BY n DESC, f) - 1 AS idx FROM (SELECT {_HOST} AS host, count(*) AS n, min(page_id) AS f FROM pages GROUP BY 1)")
def url_frequency(spark, d):
    t = m.load(spark, d, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("host"), F.col("page_id").alias("pos"))
    return tables.by_use(t, "host")


_PAGES = "pg AS (SELECT page, min(key) AS first_key, max(key) AS last_key, count(*) AS n FROM (SELECT key, (row_number() OVER (ORDER BY key) - 1) // 100 AS page FROM objects) GROUP BY page)"


@query("WITH " + _PAGES + " SELECT * FROM pg", "objects")
def build_pages(spark, d):
    return tables.build_pages(m.objects(spark, d), 100)


@query("WITH " + _PAGES + ", k AS (SELECT CASE WHEN doc_id % 2 = 0 THEN key ELSE 'e' || key END AS key FROM objects) SELECT k.key, pg.page FROM k ASOF LEFT JOIN pg ON k.key >= pg.first_key", "objects")
def page_lookup(spark, d):
    o = m.objects(spark, d)
    keys = o.select(F.when(F.col("doc_id") % 2 == 0, F.col("key")).otherwise(F.concat(F.lit("e"), F.col("key"))).alias("key"))
    return tables.page_of(keys, tables.build_pages(o, 100))


@query("WITH " + _PAGES + " SELECT page, first_key FROM pg WHERE last_key >= 'en/src1' AND first_key < 'en/src2'", "objects")
def page_prefix_scan(spark, d):
    return tables.pages_with_prefix(tables.build_pages(m.objects(spark, d), 100), "en/src1").select("page", "first_key")


@query("""SELECT page, fault FROM (SELECT page, CASE WHEN length <= 0 THEN 'empty' WHEN lag(first_key) OVER (ORDER BY page) >= first_key THEN 'order' WHEN lag("offset" + length) OVER (ORDER BY page) <> "offset" THEN 'contiguity' END AS fault FROM (
SELECT c_custkey AS page, CASE WHEN c_custkey % 6 = 5 THEN 'A' ELSE lpad(cast(c_custkey AS varchar), 9, '0') END AS first_key, c_custkey * 10 + CASE WHEN c_custkey % 7 = 3 THEN 1 ELSE 0 END AS "offset", CASE WHEN c_custkey % 11 = 10 THEN 0 ELSE 10 END AS length FROM customer)) WHERE fault IS NOT NULL""")
def page_faults(spark, d):
    n = F.col("c_custkey")
    t = m.load(spark, d, "customer").select(n.alias("page"), F.when(n % 6 == 5, "A").otherwise(F.lpad(n.cast("string"), 9, "0")).alias("first_key"), (n * 10 + F.when(n % 7 == 3, 1).otherwise(0)).alias("offset"), F.when(n % 11 == 10, 0).otherwise(10).alias("length"))
    return tables.page_faults(t)


_PLACED = 'placed AS (SELECT key, size, cast(coalesce(sum(size) OVER (ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS "begin" FROM objects)'


@query("WITH " + _PLACED + ' SELECT key, size, "begin" FROM placed', "objects")
def virtual_offsets(spark, d):
    return tables.virtual_offsets(m.objects(spark, d)).select("key", "size", "begin")


@query("WITH " + _PLACED + ' SELECT e."offset" AS "offset", p.key AS key, e."offset" - p."begin" AS within FROM (SELECT event_id * 211 AS "offset" FROM events) e JOIN placed p ON e."offset" >= p."begin" AND e."offset" < p."begin" + p.size', "objects")
def offset_to_object(spark, d):
    offsets = m.load(spark, d, "events").select((F.col("event_id") * 211).alias("offset"))
    return tables.object_at(offsets, tables.virtual_offsets(m.objects(spark, d)))


# keys as paths

_PREFIXES = "SELECT key, array_to_string(s[1:n], '/') AS dir, n FROM (SELECT key, s, unnest(range(1, len(s))) AS n FROM (SELECT key, string_split(key, '/') AS s FROM objects))"


@query("SELECT DISTINCT dir FROM (" + _PREFIXES + ")", "objects")
def directories(spark, d):
    return prefixes.directories(m.objects(spark, d))


_NODES = "nodes AS (SELECT DISTINCT lang AS path FROM documents WHERE lang <> 'es' UNION SELECT DISTINCT lang || '/' || source FROM documents WHERE source IN ('src1', 'src3'))"


@query("WITH " + _NODES + ", p AS (" + _PREFIXES + ") SELECT o.key AS key, arg_max(p.dir, p.n) AS node FROM objects o LEFT JOIN (SELECT p.* FROM p JOIN nodes ON p.dir = nodes.path) p ON p.key = o.key GROUP BY o.key", "objects")
def nearest_ancestor(spark, d):
    t = m.load(spark, d, "documents")
    nodes = t.where("lang <> 'es'").select(F.col("lang").alias("path")).union(t.where("source in ('src1', 'src3')").select(F.concat_ws("/", "lang", "source")))
    return prefixes.nearest_ancestor(m.objects(spark, d), nodes)


@query("SELECT key, size FROM objects WHERE doc_id NOT IN (SELECT event_id * 3 % (SELECT max(doc_id) + 1 FROM documents) FROM events WHERE event_id * 3 % (SELECT max(doc_id) + 1 FROM documents) % 5 > 0)", "objects")
def unused_objects(spark, d):
    o = m.objects(spark, d)
    last = F.broadcast(o.agg((F.max("doc_id") + 1).alias("n")))  # one row
    used = m.load(spark, d, "events").join(last).select((F.col("event_id") * 3 % F.col("n")).alias("doc_id")).where("doc_id % 5 > 0").distinct().join(o, "doc_id").select("key")
    return prefixes.unused(o, used).select("key", "size")


@query("WITH p AS (" + _PREFIXES + ") SELECT DISTINCT dir AS path FROM p WHERE dir NOT IN (SELECT DISTINCT lang FROM documents WHERE lang <> 'fr')", "objects")
def implicit_groups(spark, d):
    nodes = m.objects(spark, d).select(F.col("key").alias("path")).union(m.load(spark, d, "documents").where("lang <> 'fr'").select("lang").distinct())
    return prefixes.implied_groups(nodes)


@query("""SELECT page_id, k = '' OR ends_with(k, '/') OR list_has_any(string_split(k, '/'), ['', '.', '..']) AS ignored FROM (
SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]*/(.*)$', 1) AS k FROM pages)""")
def ignored_objects(spark, d):
    k = F.regexp_extract("url", "^[a-z]+://[^/]*/(.*)$", 1)
    return m.load(spark, d, "pages").select("page_id", prefixes.ignored(k).alias("ignored"))


# equivalence


@query("""SELECT coalesce(a.key, b.key) AS key, CASE WHEN b.key IS NULL THEN 'only left' WHEN a.key IS NULL THEN 'only right' WHEN a.s IS NOT DISTINCT FROM b.s AND a.p IS NOT DISTINCT FROM b.p THEN 'equal' ELSE 'differs' END AS status
FROM (SELECT o_orderkey AS key, o_orderstatus AS s, o_orderpriority AS p FROM orders WHERE o_orderkey % 17 <> 0) a FULL JOIN
(SELECT o_orderkey AS key, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderstatus END AS s, o_orderpriority AS p FROM orders WHERE o_orderkey % 19 <> 0) b ON a.key = b.key""")
def equivalence_diff(spark, d):
    t = m.load(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p"))
    right = t.where("key % 19 <> 0").withColumn("s", F.when(F.col("key") % 13 != 0, F.col("s")))
    return compare.differences(t.where("key % 17 <> 0"), right, "key", ["s", "p"])


@query("""SELECT c_nationkey, c_mktsegment, 'left' AS side FROM (SELECT c_nationkey, c_mktsegment FROM customer EXCEPT ALL SELECT c_nationkey, c_mktsegment FROM customer WHERE c_custkey % 10 < 7)
UNION ALL SELECT c_nationkey, c_mktsegment, 'right' FROM (SELECT c_nationkey, c_mktsegment FROM customer WHERE c_custkey % 10 < 7 EXCEPT ALL SELECT c_nationkey, c_mktsegment FROM customer)""")
def multiset_difference(spark, d):
    t = m.load(spark, d, "customer")
    return compare.multiset_difference(t.select("c_nationkey", "c_mktsegment"), t.where("c_custkey % 10 < 7").select("c_nationkey", "c_mktsegment"))


# sweeps


@query("""SELECT space, a AS start, start - a AS len FROM (SELECT space, start, stop, coalesce(max(stop) OVER (PARTITION BY space ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM (
SELECT space, start, start + len AS stop FROM leaves WHERE len > 0 UNION ALL SELECT space, size, size FROM spaces)) WHERE start > a""", "leaves", "spaces")
def coverage_holes(spark, d):
    return sweep.holes(m.leaves(spark, d), m.spaces(spark, d), BLOCK)


@query("""SELECT space, faults FROM (SELECT s.space, coalesce(sum(CASE WHEN start <> prev THEN 1 ELSE 0 END), 0) + CASE WHEN coalesce(max(start + len), 0) <> any_value(s.size) THEN 1 ELSE 0 END AS faults
FROM spaces s LEFT JOIN (SELECT *, coalesce(lag(start + len) OVER (PARTITION BY space ORDER BY start, len), 0) AS prev FROM leaves) l ON l.space = s.space GROUP BY s.space) WHERE faults > 0""".replace("SELECT space, faults", "SELECT space, cast(faults AS bigint) AS faults", 1), "leaves", "spaces")
def partition_faults(spark, d):
    return sweep.partition_faults(m.leaves(spark, d), m.spaces(spark, d), BLOCK)


# leaves in order, with the end and the owner of the last claim; then what claims leave open
@query("""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY space ORDER BY start, id) AS n FROM leaves WHERE len > 0),
r AS (SELECT space, n, id, start, len, NULL::bigint AS target, start + len AS pos, id AS owner FROM o WHERE n = 1
  UNION ALL SELECT o.space, o.n, o.id, o.start, o.len, CASE WHEN o.start < r.pos THEN r.owner END, CASE WHEN o.start < r.pos THEN r.pos ELSE o.start + o.len END, CASE WHEN o.start < r.pos THEN r.owner ELSE o.id END FROM r JOIN o ON o.space = r.space AND o.n = r.n + 1),
c AS (SELECT space, start, start + len AS stop FROM r WHERE target IS NULL UNION ALL SELECT space, size, size FROM spaces),
h AS (SELECT space, start, coalesce(max(stop) OVER (PARTITION BY space ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM c)
SELECT space, id, CASE WHEN target IS NULL THEN 'leaf' ELSE 'alias' END AS kind, start, len, target FROM r
UNION ALL SELECT space, NULL, 'gap', a, start - a, NULL FROM h WHERE start > a UNION ALL SELECT space, id, 'leaf', start, len, NULL FROM leaves WHERE len <= 0""", "leaves", "spaces")
def finish_sweep(spark, d):
    return sweep.finish(m.leaves(spark, d), m.spaces(spark, d), BLOCK)


# trees


@query("WITH RECURSIVE p AS (SELECT id, name AS path FROM elements WHERE parent IS NULL UNION ALL SELECT e.id, p.path || '/' || e.name FROM elements e JOIN p ON e.parent = p.id) SELECT id, path FROM p", "elements")
def element_paths(spark, d):
    return tree.paths(m.elements(spark, d), 5)


@query("WITH RECURSIVE a AS (SELECT id, id AS top FROM elements UNION ALL SELECT a.id, e.parent FROM a JOIN elements e ON e.id = a.top WHERE e.parent IS NOT NULL) SELECT top AS id, count(*) AS total FROM a GROUP BY top", "elements")
def subtree_sizes(spark, d):
    return tree.subtree_sums(m.elements(spark, d).withColumn("one", F.lit(1)), 5)


_FIRST = """WITH RECURSIVE a AS (SELECT id AS top, id, start, len FROM elements UNION ALL SELECT a.top, e.id, e.start, e.len FROM a JOIN elements e ON e.parent = a.id WHERE a.len = 0),
f AS (SELECT top AS id, min(CASE WHEN len > 0 THEN start END) AS first FROM a GROUP BY top)"""


@query(_FIRST + " SELECT id, first FROM f", "elements")
def first_bytes(spark, d):
    return tree.first_bytes(m.elements(spark, d), 5)


@query(_FIRST + """, k AS (SELECT e.id, e.parent, struct_pack(g := coalesce(min(first) OVER (PARTITION BY e.parent, e.name), -1), n := e.name, f := coalesce(first, -1), i := e.id) AS step FROM elements e JOIN f ON e.id = f.id),
s AS (SELECT id, [step] AS sort FROM k WHERE parent IS NULL UNION ALL SELECT k.id, list_append(s.sort, k.step) FROM k JOIN s ON k.parent = s.id)
SELECT id, row_number() OVER (ORDER BY sort) - 1 AS pos FROM s""", "elements")
def canonical_order(spark, d):
    return blocks.numbered(tree.canonical_order(m.elements(spark, d), 5), ["sort"], "pos").select("id", "pos")


@query("SELECT id, row_number() OVER (PARTITION BY parent, name ORDER BY start, id) - 1 AS k, CASE WHEN row_number() OVER (PARTITION BY parent, name ORDER BY start, id) > 1 THEN name || '~' || (row_number() OVER (PARTITION BY parent, name ORDER BY start, id) - 1) ELSE name END AS shown FROM elements", "elements")
def sibling_names(spark, d):
    return tree.sibling_names(m.elements(spark, d)).select("id", "k", "shown")


_RUNS = """WITH e AS (SELECT o_custkey AS parent, o_orderstatus AS shape, o_orderkey AS id, o_orderkey // 3 * 16 AS start FROM orders),
x AS (SELECT *, start - lag(start) OVER w AS d FROM e WINDOW w AS (PARTITION BY parent, shape ORDER BY start, id)),
y AS (SELECT *, CASE WHEN d IS NULL OR (lag(d) OVER w IS NOT NULL AND d <> lag(d) OVER w) THEN 1 ELSE 0 END AS f FROM x WINDOW w AS (PARTITION BY parent, shape ORDER BY start, id)),
z AS (SELECT *, sum(f) OVER (PARTITION BY parent, shape ORDER BY start, id ROWS UNBOUNDED PRECEDING) AS r FROM y)"""


@query(_RUNS + ' SELECT parent, shape, min(id) AS root, count(*) AS "count", coalesce(max(CASE WHEN f = 0 THEN d END), 0) AS stride, min(start) AS start FROM z GROUP BY parent, shape, r')
def run_fold(spark, d):
    e = m.load(spark, d, "orders").select(F.col("o_custkey").alias("parent"), F.col("o_orderstatus").alias("shape"), F.col("o_orderkey").alias("id"), (F.floor(F.col("o_orderkey") / 3) * 16).cast("bigint").alias("start"))
    return tree.fold_runs(e)


@query("SELECT root, k, start + k * stride AS start FROM (SELECT o_orderkey AS root, o_orderkey * 100 AS start, o_custkey % 7 AS n, o_custkey % 11 AS stride FROM orders), range(0, 7) t(k) WHERE k < n".replace("range(0, 7) t(k)", "(SELECT unnest(range(0, 7)) AS k)"))
def run_expand(spark, d):
    t = m.load(spark, d, "orders")
    return tree.expand_runs(t.select(F.col("o_orderkey").alias("root"), (F.col("o_orderkey") * 100).alias("start"), (F.col("o_custkey") % 7).alias("count"), (F.col("o_custkey") % 11).alias("stride")))


@query("""WITH RECURSIVE a AS (SELECT p_partkey AS alias, CASE WHEN p_partkey % 10 = 9 THEN p_partkey + 1000000 ELSE p_partkey + 1 END AS target FROM part),
f AS (SELECT alias, target, 1 AS n FROM a UNION ALL SELECT f.alias, a.target, n + 1 FROM f JOIN a ON a.alias = f.target WHERE n < 64) SELECT alias, arg_max(target, n) AS target FROM f GROUP BY alias""")
def alias_chains(spark, d):
    p = F.col("p_partkey")
    return tree.follow(m.load(spark, d, "part").select(p.alias("alias"), F.when(p % 10 == 9, p + 1000000).otherwise(p + 1).alias("target")))


@query("""WITH e AS (SELECT doc_id AS id, source AS parent, CASE WHEN doc_id % 50 = 0 THEN '' WHEN doc_id % 9 = 0 THEN lang || '/' || doc_id % 5 ELSE lang || CASE WHEN doc_id % 3 = 0 THEN '' ELSE cast(doc_id AS varchar) END END AS name FROM documents)
SELECT id, CASE WHEN name = '' THEN 'empty' ELSE 'equal' END AS fault FROM (SELECT *, count(*) OVER (PARTITION BY parent, name) AS n FROM e) WHERE name = '' OR n > 1
UNION ALL SELECT e.id, 'inside' FROM e WHERE contains(name, '/') AND EXISTS (SELECT 1 FROM e s WHERE s.parent = e.parent AND s.name = split_part(e.name, '/', 1))""")
def name_faults(spark, d):
    i = F.col("doc_id")
    name = F.when(i % 50 == 0, "").when(i % 9 == 0, F.concat("lang", F.lit("/"), (i % 5).cast("string"))).otherwise(F.concat("lang", F.when(i % 3 == 0, "").otherwise(i.cast("string"))))
    return tree.name_faults(m.load(spark, d, "documents").select(i.alias("id"), F.col("source").alias("parent"), name.alias("name")))


# columns

_V = "v AS (SELECT l_orderkey AS grp, part AS j, l_partkey * 1000 + l_suppkey AS v FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS part FROM lineitem))"


def _values(spark, d):
    t = m.load(spark, d, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return t.select(F.col("l_orderkey").alias("grp"), (F.row_number().over(order) - 1).cast("bigint").alias("j"), (F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("v"))


@query("WITH " + _V + " SELECT grp, j, v - coalesce(lag(v) OVER (PARTITION BY grp ORDER BY j), 0) AS d FROM v")
def delta_encode(spark, d):
    return columns.delta_encode(_values(spark, d))


@query("WITH " + _V + " SELECT grp, j, v FROM v")
def delta_decode(spark, d):
    return columns.delta_decode(columns.delta_encode(_values(spark, d)))


_ARITH = "SELECT user_id AS grp, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS j, CASE user_id % 3 WHEN 0 THEN user_id WHEN 1 THEN (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) * 5 + user_id ELSE event_id * event_id END AS v FROM events"


@query(f"""WITH v AS ({_ARITH}), x AS (SELECT *, v - lag(v) OVER (PARTITION BY grp ORDER BY j) AS d FROM v)
SELECT grp, CASE WHEN min(v) = max(v) THEN 'constant' WHEN min(d) = max(d) THEN 'arithmetic' ELSE 'delta' END AS encoding, arg_min(v, j) AS v0, CASE WHEN min(v) <> max(v) AND min(d) = max(d) THEN min(d) END AS step FROM x GROUP BY grp""")
def arith_columns(spark, d):
    j = (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("bigint")
    t = m.load(spark, d, "events").select(F.col("user_id").alias("grp"), "event_id", j.alias("j"))
    v = F.when(F.col("grp") % 3 == 0, F.col("grp")).when(F.col("grp") % 3 == 1, F.col("j") * 5 + F.col("grp")).otherwise(F.col("event_id") * F.col("event_id"))
    return columns.encodings(t.select("grp", "j", v.alias("v")))


@query("""WITH x AS (SELECT o_custkey AS grp, o_orderkey AS j, o_orderkey * 10 AS start, o_orderkey % 4 * 3 AS len FROM orders)
SELECT grp, j, start - coalesce(last_value(CASE WHEN len > 0 THEN start + len END IGNORE NULLS) OVER (PARTITION BY grp ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gap FROM x""")
def start_gaps(spark, d):
    o = F.col("o_orderkey")
    t = m.load(spark, d, "orders").select(F.col("o_custkey").alias("grp"), o.alias("j"), (o * 10).alias("start"), (o % 4 * 3).alias("len"))
    return columns.starts_as_gaps(t).select("grp", "j", "gap")


# for each place and period the rows that repeat those a period before; then the greedy walk
@query("WITH RECURSIVE " + _V + """, u AS (SELECT grp % 50 AS grp, row_number() OVER (PARTITION BY grp % 50 ORDER BY j, v % 3) - 1 AS j, v % 3 AS v FROM v),
z AS (SELECT a.grp, a.j, p, count(*) OVER (PARTITION BY a.grp, p) + p AS n, min(CASE WHEN a.v <> b.v THEN a.j END) OVER (PARTITION BY a.grp, p ORDER BY a.j ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS stop
  FROM u a, (SELECT unnest([1, 2, 3, 4]) AS p) JOIN u b ON b.grp = a.grp AND b.j = a.j + p),
k AS (SELECT grp, j, p, 1 + (coalesce(stop, n - p) - j) // p AS r FROM z WHERE p <= (n - j) // 2),
best AS (SELECT grp, j, arg_min(p, (-r * p, p)) AS p, arg_min(r, (-r * p, p)) AS r FROM k WHERE r >= 3 GROUP BY grp, j),
w AS (SELECT DISTINCT grp, 0::bigint AS j FROM u UNION ALL SELECT w.grp, w.j + coalesce(best.r * best.p, 1) FROM w LEFT JOIN best ON best.grp = w.grp AND best.j = w.j JOIN u ON u.grp = w.grp AND u.j = w.j)
SELECT w.grp AS grp, w.j AS "at", best.p AS period, best.r AS repeats FROM w JOIN best ON best.grp = w.grp AND best.j = w.j""")
def column_runs(spark, d):
    t = _values(spark, d).withColumn("v", F.col("v") % 3).withColumn("grp", F.col("grp") % 50)
    return columns.column_runs(t.withColumn("j", (F.row_number().over(Window.partitionBy("grp").orderBy("j", "v"))).cast("bigint")))


# grids


@query("SELECT x, y, 'a/c.' || x // 64 || '.' || y // 16 AS key, x // 64 * 100 + y // 16 AS number FROM (SELECT DISTINCT x, y FROM cells)", "cells")
def chunk_index(spark, d):
    x, y = grid.chunk_of([F.col("x"), F.col("y")], [F.lit(64), F.lit(16)])
    t = m.cells(spark, d).select("x", "y").distinct()
    return t.select("x", "y", grid.chunk_key(F.lit("a"), [x, y], ".").alias("key"), grid.ravel([x, y], [F.lit(0), F.lit(100)]).alias("number"))


@query("""SELECT i AS c_x, j AS c_y, coalesce(v, -1) AS value FROM (SELECT unnest(range(0, (SELECT max(x) // 8 + 1 FROM cells))) AS i) CROSS JOIN (SELECT unnest(range(0, (SELECT max(y) // 2 + 1 FROM cells))) AS j)
LEFT JOIN (SELECT x // 8 AS a, y // 2 AS b, cast(sum(value) AS bigint) AS v FROM cells GROUP BY 1, 2) c ON a = i AND b = j""", "cells")
def grid_fill(spark, d):
    cells = m.cells(spark, d)
    arrays = cells.agg((F.max("x") + 1).alias("shape_x"), F.lit(8).alias("chunk_x"), (F.max("y") + 1).alias("shape_y"), F.lit(2).alias("chunk_y"))
    x, y = grid.chunk_of([F.col("x"), F.col("y")], [F.lit(8), F.lit(2)])
    got = cells.groupBy(x.alias("c_x"), y.alias("c_y")).agg(F.sum("value").alias("value"))
    return grid.filled_plane(arrays, got, ("x", "y"), "value", -1)


@query("SELECT event_id, event_id // 60 AS p, event_id // 12 % 5 AS t, 11 - event_id % 12 AS z FROM events")
def frame_coordinates(spark, d):
    p, t, z = grid.unravel(F.col("event_id"), [F.lit(1 << 40), F.lit(5), F.lit(12)])
    return m.load(spark, d, "events").select("event_id", p.alias("p"), t.alias("t"), (11 - z).alias("z"))


_INDEX = "CASE doc_id % 5 WHEN 0 THEN doc_id % 7 || '.' || doc_id % 9 WHEN 1 THEN '0' || doc_id % 9 || '.1' WHEN 2 THEN doc_id % 12 || '.' || doc_id % 3 WHEN 3 THEN doc_id % 4 || '' ELSE 'a.' || doc_id % 3 END"


@query(f"""SELECT doc_id, name, coalesce(regexp_full_match(name, '(0|[1-9][0-9]*)[.](0|[1-9][0-9]*)') AND try_cast(split_part(name, '.', 1) AS bigint) < 6 AND try_cast(split_part(name, '.', 2) AS bigint) < 8, false) AS ok
FROM (SELECT doc_id, {_INDEX} AS name FROM documents)""")
def canonical_chunks(spark, d):
    i = F.col("doc_id")
    text = lambda c: c.cast("string")
    name = F.when(i % 5 == 0, F.concat_ws(".", text(i % 7), text(i % 9))).when(i % 5 == 1, F.concat(F.lit("0"), text(i % 9), F.lit(".1"))).when(i % 5 == 2, F.concat_ws(".", text(i % 12), text(i % 3))).when(i % 5 == 3, text(i % 4)).otherwise(F.concat(F.lit("a."), text(i % 3)))
    t = m.load(spark, d, "documents").select("doc_id", name.alias("name"))
    return t.withColumn("ok", grid.canonical_index(F.col("name"), [F.lit(6), F.lit(8)]))


@query("""SELECT "array", shard, min(url) AS url, max("offset" + length) + 16 * 8 AS size, count(*) AS inner_chunks FROM (
SELECT o_custkey % 50 AS "array", o_orderkey // 8 AS shard, o_orderstatus AS url, o_orderkey * 7 AS "offset", o_orderkey % 100 AS length FROM orders) GROUP BY 1, 2 HAVING count(DISTINCT url) = 1""")
def shard_index(spark, d):
    o = F.col("o_orderkey")
    t = m.load(spark, d, "orders").select((F.col("o_custkey") % 50).alias("array"), o.alias("idx"), F.col("o_orderstatus").alias("url"), (o * 7).alias("offset"), (o % 100).alias("length"))
    return grid.shards(t, 8).withColumnRenamed("inner", "inner_chunks")


@query("""SELECT id, arg_min(q, (over, p, q)) AS q, arg_min(padding, (over, p, q)) AS padding FROM (SELECT *, padding > 1024 AS over, CASE WHEN padding > 1024 THEN padding ELSE 0 END AS p FROM (
SELECT id, q, (q - n % q) % q * width AS padding FROM (SELECT o_orderkey AS id, o_orderkey % 300 + 1 AS n, o_orderkey % 300 % (o_orderkey % 300 % 20 + 1) + 1 AS k, o_orderkey % 500 + 1 AS width FROM orders), (SELECT unnest(range(1, 700)) AS q) WHERE q >= k AND q <= least(2 * k, n))) GROUP BY id""")
def contiguous_cut(spark, d):
    o = F.col("o_orderkey")
    t = m.load(spark, d, "orders").select(o.alias("id"), (o % 300 + 1).alias("n"), (o % 300 % (o % 300 % 20 + 1) + 1).alias("k"), (o % 500 + 1).alias("width"))
    return grid.contiguous_cut(t)


@query("""SELECT id, k, k * w AS start, least(w, size - k * w) AS len FROM (SELECT doc_id AS id, strlen(text) AS size, greatest(ceil(strlen(text) / 1000.0), 1)::bigint AS c, ceil(strlen(text) / (greatest(ceil(strlen(text) / 1000.0), 1)))::bigint AS w FROM documents), (SELECT unnest(range(0, 300)) AS k) WHERE k < c""")
def blob_chunks(spark, d):
    return grid.blob_chunks(m.objects(spark, d).select(F.col("doc_id").alias("id"), "size"), 1000)


@query("SELECT flag, x // 250 AS band, cast(sum(value * weight) AS double) / sum(weight) AS mean FROM cells WHERE y < (SELECT max(y) * 3 // 5 FROM cells) GROUP BY 1, 2", "cells")
def weighted_subset_mean(spark, d):
    cells = m.cells(spark, d)
    bound = F.broadcast(cells.agg(F.floor(F.max("y") * 3 / 5).alias("bound")))  # one row
    return grid.weighted_mean(cells.join(bound, F.col("y") < F.col("bound")).withColumn("band", F.floor(F.col("x") / 250).cast("bigint")), ["flag", "band"])


@query("""SELECT image, first_plane + k AS plane, arg_max(first_ifd + k, (pos, k)) AS ifd FROM (
SELECT o_custkey AS image, o_orderkey AS pos, o_orderkey % 10 AS first_plane, o_orderkey % 40 AS first_ifd, least(o_orderkey % 6, 12 - o_orderkey % 10) AS n FROM orders), (SELECT unnest(range(0, 12)) AS k) WHERE k < n GROUP BY 1, 2""")
def plane_mapping(spark, d):
    o = F.col("o_orderkey")
    t = m.load(spark, d, "orders").select(F.col("o_custkey").alias("image"), o.alias("pos"), (o % 10).alias("first_plane"), (o % 40).alias("first_ifd"), (o % 6).alias("count"), F.lit(12).cast("bigint").alias("total"))
    return grid.planes(t)


@query("SELECT p_partkey AS id, min(n_nationkey) AS layer FROM part LEFT JOIN (SELECT n_nationkey, n_nationkey * 40 + 880 AS value, n_regionkey * 9 AS tolerance FROM nation) t ON p_retailprice >= value - tolerance AND p_retailprice <= value + tolerance GROUP BY p_partkey")
def layer_bands(spark, d):
    t = m.load(spark, d, "nation").select(F.col("n_nationkey").alias("ord"), (F.col("n_nationkey") * 40 + 880).alias("value"), (F.col("n_regionkey") * 9).alias("tolerance"))
    return grid.layers(m.load(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("factor")), t)


_LEVELS = "SELECT o_custkey AS image, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS level, 100000 - o_orderkey AS width, o_orderkey * 31 % 97 AS height FROM orders"


@query(f"SELECT image, level, 'size' AS fault FROM (SELECT *, width >= lag(width) OVER (PARTITION BY image ORDER BY level) OR height >= lag(height) OVER (PARTITION BY image ORDER BY level) AS bad FROM ({_LEVELS})) WHERE bad")
def level_faults(spark, d):
    o = F.col("o_orderkey")
    level = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("bigint")
    return grid.level_faults(m.load(spark, d, "orders").select(F.col("o_custkey").alias("image"), level.alias("level"), (100000 - o).alias("width"), (o * 31 % 97).alias("height")))


@query("SELECT p_brand, count(DISTINCT (p_type, p_size % 2)) AS kinds FROM part GROUP BY p_brand HAVING count(DISTINCT (p_type, p_size % 2)) > 1")
def uneven_levels(spark, d):
    return grid.uneven(m.load(spark, d, "part").withColumn("odd", F.col("p_size") % 2), ["p_brand"], ["p_type", "odd"])


# predicates, payloads, rules


_VARINT = "1" + "".join(f" + CASE WHEN {{c}} >= {1 << 7 * k} THEN 1 ELSE 0 END" for k in range(1, 10))


@query("SELECT key, part, cast(" + " + ".join(f"CASE WHEN {c} = 0 THEN 0 ELSE 1 + {_VARINT.format(c=c)} END" for c in ("source", '"offset"', "length")) + " AS bigint) AS size FROM ranges", "ranges")
def payload_size(spark, d):
    return m.ranges(spark, d).select("key", "part", range_size(F.col("source"), F.col("offset"), F.col("length")).cast("bigint").alias("size"))


_ADDRESS = "(event_id * 7919 + user_id * 65537) * 4099 % 4294967296"


# the classes by their octets; a multiplier scatters the addresses over the whole range, and every fourth lies in a special place
@query("""SELECT event_id, address, CASE WHEN a = 127 THEN 'loopback' WHEN a = 10 OR a = 172 AND b BETWEEN 16 AND 31 OR a = 192 AND b = 168 THEN 'private' WHEN a = 169 AND b = 254 THEN 'link-local'
WHEN a = 0 OR a >= 224 OR a = 100 AND b BETWEEN 64 AND 127 OR a = 192 AND b = 0 AND c IN (0, 2) OR a = 198 AND b IN (18, 19) OR a = 198 AND b = 51 AND c = 100 OR a = 203 AND b = 0 AND c = 113 THEN 'special' ELSE 'public' END AS class
FROM (SELECT *, address // 16777216 AS a, address // 65536 % 256 AS b, address // 256 % 256 AS c FROM (SELECT event_id, CASE WHEN event_id % 4 > 0 THEN (event_id * 7919 + user_id * 65537) * 4099 % 4294967296
ELSE [2130706433, 167772160, 2886729728, 2887778303, 2887778304, 3232235521, 2851995649, 1681915904, 1686110207, 3221225472, 3221225985, 3221226240, 3323068416, 3323199487, 3325256704, 3405803776, 16777215, 3758096384][event_id // 4 % 18 + 1] END AS address FROM events))""")
def cidr_class(spark, d):
    edges = F.array(*map(F.lit, (2130706433, 167772160, 2886729728, 2887778303, 2887778304, 3232235521, 2851995649, 1681915904, 1686110207, 3221225472, 3221225985, 3221226240, 3323068416, 3323199487, 3325256704, 3405803776, 16777215, 3758096384)))
    i = F.col("event_id")
    a = F.when(i % 4 > 0, (i * 7919 + F.col("user_id") * 65537) * 4099 % 4294967296).otherwise(F.get(edges, (F.floor(i / 4) % 18).cast("int")))
    return m.load(spark, d, "events").select("event_id", a.cast("bigint").alias("address")).withColumn("class", policy.address_class(F.col("address")))


_ALLOW = ["https://blog.tionble.example.com/en", "http://m.tiontion.example.com", "https://tionsh.example.net/"]


@query("SELECT page_id, (" + " OR ".join(f"(starts_with(url, '{p}') AND ({p.endswith('/')} OR substr(url, {len(p) + 1}, 1) IN ('', '/', '?', '#')))" for p in _ALLOW) + ") AND NOT regexp_matches(regexp_extract(lower(url), '^[^?#]*'), '%(2e|2f|5c)') AS allowed FROM pages")
def prefix_policy(spark, d):
    return m.load(spark, d, "pages").select("page_id", policy.allowed_by(F.col("url"), _ALLOW).alias("allowed"))


#: Hosts and their classes, by hand.
_HOSTS = {
    "127.0.0.1": "loopback", "localhost": "loopback", "a.LocalHost": "loopback", "10.1.2.3": "private", "8.8.8.8": "public", "192.168.1.1": "private", "example.com": None, "1.2.3": None, "1.2.3.400": None,
    "1.2.3.4.": "public", "01.2.3.4": None, "100.64.0.1": "special", "192.0.2.1": "special", "198.18.0.1": "special", "169.254.1.1": "link-local", "[::1]": "loopback", "[::ffff:7f00:1]": "loopback",
    "[64:ff9b::7f00:1]": "loopback", "[::ffff:10.0.0.1]": "private", "[2002:0a00:0001::]": "private", "[fe80::1%25eth0]": "link-local", "[fd00::1]": "private", "[2001:db8::1]": "special", "[2606:4700::1111]": "public",
    "[ff02::1]": "special", "[::]": "special", "[1:2:3]": None, "[1::2::3]": None, "[1:2:3:4:5:6:7:8]": "special", "[2400:2:3:4:5:6:7:8]": "public", "[12345::]": None, "[::1.2.3]": None,
}


@query("SELECT c_custkey, list_extract([" + ", ".join(f"'{h}'" for h in _HOSTS) + f"], c_custkey % {len(_HOSTS)} + 1) AS host, list_extract([" + ", ".join(f"'{c}'" if c else "NULL" for c in _HOSTS.values()) + f"], c_custkey % {len(_HOSTS)} + 1) AS class FROM customer")
def host_class(spark, d):
    hosts = F.array(*map(F.lit, _HOSTS))
    t = m.load(spark, d, "customer").select("c_custkey", F.get(hosts, (F.col("c_custkey") % len(_HOSTS)).cast("int")).alias("host"))
    return t.withColumn("class", policy.host_class(F.col("host")))


_RULES = [("https://", "cache/"), ("https://tionsh.example.net/", "t/"), ("http://m.", "mobile/")]


@query("SELECT page_id, CASE WHEN starts_with(url, 'https://tionsh.example.net/') THEN 't/' || substr(url, 28) WHEN starts_with(url, 'http://m.') THEN 'mobile/' || substr(url, 10) WHEN starts_with(url, 'https://') THEN 'cache/' || substr(url, 9) ELSE url END AS \"to\" FROM pages")
def rewrite_urls(spark, d):
    return policy.rewritten(m.load(spark, d, "pages"), _RULES).select("page_id", "to")


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'https://bucket' || p_size || '.s3.amazonaws.com/' || p_name WHEN 1 THEN 'https://b-' || p_size || '.s3.amazonaws.com/' END AS url FROM part""")
def public_urls(spark, d):
    k, size, name = F.col("p_partkey") % 6, F.col("p_size").cast("string"), F.col("p_name")
    url = (
        F.when(k == 0, F.concat(F.lit("s3://bucket"), size, F.lit("/"), name)).when(k == 1, F.concat(F.lit("S3://b-"), size)).when(k == 2, F.concat(F.lit("https://h/"), name))
        .when(k == 3, F.concat(F.lit("s3://with.dot/"), name)).when(k == 4, F.concat(F.lit("s3://Upper/"), name)).otherwise(F.concat(F.lit("s3://ends-/"), name))
    )
    return m.load(spark, d, "part").select("p_partkey", policy.public_object_url(url).alias("url"))


@query("""SELECT p_partkey, CASE WHEN p_size / cast(p_partkey % 5 AS double) > 20 OR p_partkey % 5 = 0 AND p_size > 0 THEN 'ratio of ' || p_size || ' is too large' WHEN p_size <> floor(p_size) OR p_size < 3 THEN 'size ' || p_size WHEN p_type <> 'ECONOMY' AND p_retailprice > 1500 THEN 'price' END AS reject FROM part""")
def rule_violations(spark, d):
    t = m.load(spark, d, "part").withColumn("five", F.col("p_partkey") % 5)
    rules = [
        ("!(ratio > 20)", "ratio of {p_size} is too large"), ("int(p_size, 3, 100)", "size {p_size}"),
        ("p_type == 'ECONOMY' || !(p_retailprice > 1500)", "price"),
    ]
    return t.select("p_partkey", reject(t, [("ratio", "p_size / five")], rules).alias("reject"))


# names, dates, units and numbers


@query("""SELECT p_partkey, segment, CASE WHEN odd THEN replace(replace(replace(segment, '%', '%25'), '/', '%2F'), '~', '%7E') || '~' WHEN n = '' THEN segment ELSE left(segment, length(segment) - length(n)) END AS name,
CASE WHEN odd THEN '0' WHEN n = '' THEN '18446744073709551615' ELSE n END AS idx, segment AS back FROM (SELECT *, contains(segment, '~') AS odd, regexp_extract(segment, '(0|[1-9][0-9]*)$', 1) AS n FROM (
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'c' || p_partkey WHEN 1 THEN 'a.00' || p_size WHEN 2 THEN p_type WHEN 3 THEN 'x~%' || p_size ELSE '' || p_partkey END AS segment FROM part))""")
def key_names(spark, d):
    p, text = F.col("p_partkey"), lambda c: F.col(c).cast("string")
    segment = F.when(p % 5 == 0, F.concat(F.lit("c"), text("p_partkey"))).when(p % 5 == 1, F.concat(F.lit("a.00"), text("p_size"))).when(p % 5 == 2, F.col("p_type")).when(p % 5 == 3, F.concat(F.lit("x~%"), text("p_size"))).otherwise(text("p_partkey"))
    t = m.load(spark, d, "part").select("p_partkey", segment.alias("segment")).withColumn("n", texts.key_name(F.col("segment"), F.lit(False)))
    return t.select("p_partkey", "segment", "n.name", F.col("n.idx").cast("string").alias("idx"), texts.key_segment(F.col("n.name"), F.col("n.idx")).alias("back"))


@query("""SELECT doc_id, CASE WHEN first AND text <> '' AND NOT contains(text, '/') AND text <> 'fr' THEN text ELSE replace(replace(replace(text, '%', '%25'), '/', '%2F'), '~', '%7E') || '~' END AS name,
CASE WHEN first AND text <> '' AND NOT contains(text, '/') AND text <> 'fr' THEN '18446744073709551615' ELSE cast(k AS varchar) END AS idx, text AS back FROM (
SELECT doc_id, text, row_number() OVER w - 1 AS k, row_number() OVER w = 1 AS first FROM (SELECT doc_id, source, CASE doc_id % 4 WHEN 0 THEN lang || '/%' || doc_id % 7 WHEN 1 THEN '' ELSE coalesce(lang, '') END AS text FROM documents) WINDOW w AS (PARTITION BY source, text ORDER BY doc_id))""")
def source_names(spark, d):
    i = F.col("doc_id")
    text = F.when(i % 4 == 0, F.concat("lang", F.lit("/%"), (i % 7).cast("string"))).when(i % 4 == 1, "").otherwise(F.coalesce("lang", F.lit("")))
    t = texts.source_names(m.load(spark, d, "documents").select(i.alias("pos"), F.col("source").alias("parent"), text.alias("text")), ("fr",))
    return t.select(F.col("pos").alias("doc_id"), "name", F.col("idx").cast("string").alias("idx"), texts.source_text(F.col("name"), F.col("idx")).alias("back"))


@query("""SELECT page_id, 'others/' || key || CASE WHEN page_id % 3 < 2 THEN '~' ELSE '' END AS key FROM (
SELECT page_id, page_id % 9 || '/' || CASE page_id % 3 WHEN 0 THEN 'zarr.json' WHEN 1 THEN '.zgroup~' ELSE 'zarr.json.' || page_id END AS key FROM pages)""")
def object_keys(spark, d):
    i = F.col("page_id")
    last = F.when(i % 3 == 0, "zarr.json").when(i % 3 == 1, ".zgroup~").otherwise(F.concat(F.lit("zarr.json."), i.cast("string")))
    return m.load(spark, d, "pages").select("page_id", texts.object_key(F.concat_ws("/", (i % 9).cast("string"), last), "others/").alias("key"))


@query("""SELECT o_orderkey, strftime(make_timestamp(o_orderkey * 86399000000 % 4000000000000000), '%a, %d %b %Y %H:%M:%S GMT') AS shown, o_orderkey * 86399 % 4000000000 AS seconds, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey * 86399 % 4000000000 END AS point FROM orders""")
def http_dates(spark, d):
    seconds = F.col("o_orderkey").cast("bigint") * 86399 % 4000000000
    t = m.load(spark, d, "orders").select("o_orderkey", texts.to_imf_fixdate(seconds).alias("shown"), seconds.alias("_s"))
    text = F.date_format(F.timestamp_seconds("_s"), "yyyy-MM-dd HH:mm:ss")
    point = texts.time_point(F.when(F.col("o_orderkey") % 2 == 0, text).otherwise(F.concat(text, F.lit("Z"))))
    return t.select("o_orderkey", "shown", texts.imf_fixdate(F.col("shown")).alias("seconds"), point["seconds"].alias("point"))


@query("""SELECT p_partkey, unit, p_retailprice * (size / 0.0254) AS inches, p_retailprice - p_size * p_retailprice / 2 AS place FROM (
SELECT *, list_extract(['micrometer', 'nanometer', 'foot', 'second', NULL], p_partkey % 5 + 1) AS unit, list_extract([1e-6, 1e-9, 0.3048, NULL, NULL], p_partkey % 5 + 1) AS size FROM part)""")
def unit_lengths(spark, d):
    symbols = F.array(*map(F.lit, ("um", "nm", "ft", "s", "parsec")))
    t = m.load(spark, d, "part").withColumn("unit", texts.unit(F.get(symbols, (F.col("p_partkey") % 5).cast("int"))))
    price = F.col("p_retailprice").cast("double")
    return t.select("p_partkey", "unit", texts.length_in(price, F.col("unit"), F.lit("inch")).alias("inches"), texts.centred(price, F.col("p_size"), price).alias("place"))


@query("SELECT l_orderkey, list_reduce(list_append(list(cast(l_quantity AS bigint) * 6), 0), lambda a, b: greatest_common_divisor(a, b)) AS divisor FROM lineitem GROUP BY l_orderkey")
def divisors(spark, d):
    t = m.load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_quantity").cast("bigint") * 6).alias("l"))
    return t.select("l_orderkey", texts.greatest_divisor(F.col("l")).alias("divisor"))


@query("SELECT p_partkey, upper(printf('%02x%02x%02x', cast(floor(p_size / 50.0 * 255 + 0.5) AS bigint), cast(floor(least(p_retailprice / 2000, 1) * 255 + 0.5) AS bigint), 0)) AS colour FROM part")
def colours(spark, d):
    return m.load(spark, d, "part").select("p_partkey", texts.colour(F.col("p_size") / F.lit(50.0), F.col("p_retailprice").cast("double") / 2000, F.lit(0.0)).alias("colour"))


@query("SELECT doc_id, list_reduce([0::hugeint] || list_transform(range(1, cast(least(strlen(text), 8) AS bigint) + 1), lambda i: cast('0x' || substr(hex(encode(text)), 2 * i - 1, 2) AS hugeint)), lambda a, b: a * 256 + b)::varchar AS number FROM documents WHERE text <> ''")
def byte_numbers(spark, d):
    t = m.load(spark, d, "documents").where("text <> ''").select("doc_id", F.substring(F.col("text").cast("binary"), 1, 8).alias("b"))
    return t.select("doc_id", texts.integer(F.col("b"), False).cast("string").alias("number"))


# archives


@query("""SELECT key, hex, NULL::varchar AS error FROM (SELECT 'd/' || lpad(cast(doc_id AS varchar), 9, '0') AS key, substr(hex(encode(text)), 11, 230) AS hex FROM documents WHERE text IS NOT NULL)
UNION ALL SELECT key, substr(string_agg(piece, '' ORDER BY part), 11, 230), NULL FROM (SELECT key, part, substr(hex(encode(t.text)), cast(2 * "offset" + 1 AS bigint), cast(2 * length AS bigint)) AS piece
FROM text_ranges r JOIN documents t ON t.doc_id = r.source AND t.text IS NOT NULL) GROUP BY key""", "text_ranges")
def archive_get(spark, d):
    return archives.window(spark, d, 5, 120)


@query("SELECT 'u/' || lpad(cast(user_id AS varchar), 6, '0') AS key FROM events WHERE user_id BETWEEN 10 AND 19 GROUP BY 1")
def archive_prefix(spark, d):
    return archives.under(spark, d, "u/00001")
