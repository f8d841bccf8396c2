"""The engine's operators as registered queries over the driver's tables, with DuckDB SQL for the same rows.

Logs are derived from the tables by SQL that both engines read: `mixed` lines from orders, with
every shape and kind of token, and `event` lines from events, whose clocks step backwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from braidlog.functions import lines as L
from braidlog.functions import names as N
from braidlog.functions.text import report_string
from braidlog.functions.tokens import KINDS, rendered, with_atoms, with_tokens
from braidlog.operators.clustering import cluster, exact_catalogue, slotted
from braidlog.operators.merging import checked, demultiplexed, digests, keyed, prefixed
from braidlog.operators.reports import in_order, json_lines, selected, text_lines
from braidlog.operators.scans import placed
from braidlog.plans.templates import UNKNOWN, sequenced, unprefixed
from braidlog.sources.catalogue import clusters_of, ordered, with_lines

# ---------------------------------------------------------------- derived logs

_MIXED = r"""
SELECT k AS seq, CASE WHEN k % 37 = 0 THEN concat('    at frame ', CAST(c AS STRING), ' of trace, [step]') ELSE concat(
    '2026-05-', lpad(CAST(k % 28 + 1 AS STRING), 2, '0'), 'T', lpad(CAST(k % 24 AS STRING), 2, '0'), ':', lpad(CAST(k % 60 AS STRING), 2, '0'), ':', lpad(CAST(c % 60 AS STRING), 2, '0'),
    CASE WHEN k % 3 = 0 THEN concat('.', lpad(CAST(k % 1000000 AS STRING), 6, '0'), 'Z') ELSE 'Z' END, ' ',
    CASE k % 5 WHEN 0 THEN '[net] ' WHEN 1 THEN '[validation] ' WHEN 2 THEN '[msghand] [net] ' WHEN 3 THEN '[] ' ELSE '' END,
    CASE k % 13
      WHEN 0 THEN concat('UpdateTip: new best=', sha, ' height=', CAST(k AS STRING), ' progress=0.', CAST(c AS STRING), ' cache=1.5e+10MiB')
      WHEN 1 THEN concat('received: inv (', CAST(k AS STRING), ' bytes) peer=', CAST(c AS STRING))
      WHEN 2 THEN concat('connect to 10.0.', CAST(c % 300 AS STRING), '.', CAST(k % 256 AS STRING), ':8333 from 192.168.1.', CAST(k % 300 AS STRING))
      WHEN 3 THEN concat('Selected ', substr(letters, 1, 52), '.b32.i2p:0 and ', substr(letters, 3, 52), '.b32.i2p from tried')
      WHEN 4 THEN concat('Added ', substr(letters, 1, 56), '.onion:8333 and ', substr(letters, 1, 16), '.onion, tried ', CAST(c AS STRING))
      WHEN 5 THEN concat('paid bc1', translate(substr(sha, 1, 38), 'b1', 'qz'), ', change ', translate(substr(sha, 1, 30), '0', 'z'))
      WHEN 6 THEN concat('script 0x', substr(sha, 1, 10), ' tx ', substr(sha, 1, 16), ' ok')
      WHEN 7 THEN concat('- Connect ', CAST(k AS STRING), ' transactions: ', CAST(c AS STRING), '.25ms (0.', CAST(k AS STRING), 'ms/tx, ', CAST(k % 90 AS STRING), 'h)')
      WHEN 8 THEN concat('bound 2001:db8:0:0:0:0:0:', CAST(k % 10000 AS STRING), ' via fe80::', CAST(c % 100 AS STRING), ' at 12:30:', lpad(CAST(k % 60 AS STRING), 2, '0'))
      WHEN 9 THEN concat('it''s (a/b) [x', CAST(c % 3 AS STRING), ']=y: done,')
      WHEN 10 THEN concat('offset -', CAST(c AS STRING), ' ratio +0.5 port ', CAST(60000 + k AS STRING))
      WHEN 11 THEN concat('got (peer=', CAST(c AS STRING), ') for height=', CAST(c AS STRING), 'x 7 bytes and bytes')
      ELSE concat('plain words only, nothing typed ', CASE c % 4 WHEN 0 THEN 'here' WHEN 1 THEN 'there' WHEN 2 THEN 'now' ELSE 'then' END) END) END AS line
FROM (SELECT *, translate(sha, '0189', 'ghij') AS letters FROM (SELECT o_orderkey AS k, o_custkey AS c, {sha}(CAST(o_orderkey AS STRING){bits}) AS sha FROM orders))
"""

_EVENTS = r"""
SELECT event_id, {stamp} AS stamp, concat('n', CAST(user_id % 4 AS STRING)) AS node, {date} AS date,
       concat({stamp}, 'Z [', event_type, '] user=', CAST(user_id AS STRING), ' value ', CAST(CAST(value AS DECIMAL(18, 2)) AS STRING)) AS line
FROM events
"""

MIXED = {"spark": _MIXED.format(sha="sha2", bits=", 256"), "duck": _MIXED.format(sha="sha256", bits="")}
EVENTS = {
    "spark": _EVENTS.format(stamp="date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\")", date="date_format(ts, 'yyyyMMdd')"),
    "duck": _EVENTS.format(stamp="strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')", date="strftime(ts, '%Y%m%d')"),
}


def _bound(spark: SparkSession, sf_dir: str, query: str, name: str) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(f"braidlog_{name}")
    return spark.sql(query.replace(f"FROM {name}", f"FROM braidlog_{name}"))


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, line) from orders; the exchange stands for a scan, past which no expression of the derivation is copied."""
    return _bound(spark, sf_dir, MIXED["spark"], "orders").repartition("seq")


def event_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, node, reader, line_no, line) from events, as if each node's day were a file."""
    rows = _bound(spark, sf_dir, EVENTS["spark"], "events")
    place = F.row_number().over(Window.partitionBy("date", "node").orderBy("event_id")).cast("long")
    return rows.select("date", "node", F.substring("node", 2, 9).cast("int").alias("reader"), place.alias("line_no"), F.col("line").cast("binary").alias("line"))


def _slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slotted(mixed(spark, sf_dir), "line").select(F.lit(None).cast("string").alias("node"), "category", "seq", "timestamp", "slots")


# ---------------------------------------------------------------- SQL parts

_ATOMS = r"""
flatten(list_transform(list_filter(regexp_split_to_array(content, '[ \t\n\f\r]+'), lambda w: w <> ''), lambda w:
    CASE WHEN length(w) > 1 AND regexp_matches(w, '[:,]$') THEN list_append({cut_short}, right(w, 1)) ELSE {cut} END))
"""
_CUT = r"CASE WHEN starts_with({w}, 'peer=') OR starts_with({w}, 'height=') THEN [{w}] ELSE regexp_extract_all({w}, '[^=()\[\]''/]+|[=()\[\]''/]') END"
ATOMS = _ATOMS.format(cut=_CUT.format(w="w"), cut_short=_CUT.format(w="left(w, length(w) - 1)"))

_PORT = "0*(6553[0-5]|655[0-2][0-9]|65[0-4][0-9]{2}|6[0-4][0-9]{3}|[1-5][0-9]{4}|[0-9]{1,4})"
_V4 = r"(25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})(\.(25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})){3}"
_FLOAT = r"[+-]?[0-9]+\.[0-9]+([eE][+-]?[0-9]+)?"
_NAME = "([a-z2-7]{16}|[a-z2-7]{56})"


def _kind_sql(a: str, following: str) -> str:
    full = lambda p: f"regexp_full_match({a}, '{p}')"
    groups = f"len(list_filter(string_split({a}, ':'), lambda g: g <> ''))"
    ipv6 = (
        rf"(contains({a}, ':') AND {full('[0-9A-Fa-f]{0,4}(:[0-9A-Fa-f]{0,4})*')} AND NOT contains({a}, ':::') AND length({a}) - length(replace({a}, '::', ':')) <= 1"
        rf" AND CASE WHEN contains({a}, '::') THEN {groups} <= 7 ELSE len(string_split({a}, ':')) = 8 END)"
    )
    tests = [
        ("PEER", full("peer=[+-]?[0-9]+")),
        ("HEIGHT", full("height=[0-9]+")),
        ("BYTES", f"{full('[0-9]+')} AND {following} = 'bytes'"),
        ("HASH", full("[0-9a-f]{64}")),
        ("DUR", full(f"([+-]?[0-9]+|{_FLOAT})(μs|ns|us|ms|s|m|h|d)")),
        ("IPv6", ipv6),
        ("IPv4:PORT", full(f"{_V4}:{_PORT}")),
        ("IPv4", full(_V4)),
        ("ONION:PORT", full(rf"{_NAME}\.onion:{_PORT}")),
        ("ONION", full(rf"{_NAME}\.onion")),
        ("I2P:PORT", full(rf"[a-z2-7]{{52}}\.b32\.i2p:{_PORT}")),
        ("I2P", full(r"[a-z2-7]{52}\.b32\.i2p")),
        ("BECH32", full("(bc1|tb1|bcrt1)[qpzry9x8gf2tvdw0s3jn54khce6mua7l]{6,}")),
        ("HEX", f"({full('0x[0-9A-Fa-f]+')} OR {full('[0-9A-Fa-f]{8,63}')} AND regexp_matches({a}, '[A-Fa-f]'))"),
        ("BASE58", f"({full('[1-9A-HJ-NP-Za-km-z]{26,35}')} AND regexp_matches({a}, '[A-Za-z]'))"),
        ("FLOAT", full(_FLOAT)),
        ("INT", full("[+-]?[0-9]+")),
    ]
    return "CASE " + " ".join(f"WHEN {test} THEN '{kind}'" for kind, test in tests) + " END"


_PARSED = r"""
mixed AS ({lines}),
shaped AS (
    SELECT seq, line, regexp_matches(line, '^[0-9]{{4}}-') AS stamped, regexp_extract(line, '^[^ \t\n\f\r]*') AS stamp,
           ltrim(substr(line, length(regexp_extract(line, '^[^ \t\n\f\r]*')) + 1)) AS rest
    FROM mixed
), grouped AS (
    SELECT *, regexp_matches(rest, '^\[[^\] \t\n\f\r:]*\]') AS one, ltrim(regexp_replace(rest, '^\[[^\] \t\n\f\r:]*\]', '')) AS after FROM shaped
), parsed AS (
    SELECT seq, line, CASE WHEN stamped THEN stamp END AS "timestamp",
           CASE WHEN stamped AND one AND regexp_matches(after, '^\[[^\] \t\n\f\r:]*\]') THEN regexp_extract(rest, '^\[([^\]]*)', 1) END AS thread,
           CASE WHEN stamped AND one THEN CASE WHEN regexp_matches(after, '^\[[^\] \t\n\f\r:]*\]') THEN regexp_extract(after, '^\[([^\]]*)', 1) ELSE regexp_extract(rest, '^\[([^\]]*)', 1) END END AS category,
           CASE WHEN NOT stamped THEN line WHEN one AND regexp_matches(after, '^\[[^\] \t\n\f\r:]*\]') THEN ltrim(regexp_replace(after, '^\[[^\] \t\n\f\r:]*\]', '')) WHEN one THEN after ELSE rest END AS content
    FROM grouped
)"""

PARSED = _PARSED.format(lines=MIXED["duck"])

_TOKENS = rf"""{{parsed}},
atoms AS (SELECT seq, "timestamp", category, {ATOMS} AS atoms FROM parsed),
placed AS (
    SELECT seq, generate_subscripts(atoms, 1) AS i, unnest(atoms) AS atom, atoms FROM atoms
), tokens AS (
    SELECT seq, i, atom, {_kind_sql("atom", "coalesce(atoms[i + 1], '')")} AS kind FROM placed
    WHERE NOT (atom = 'bytes' AND i > 1 AND regexp_full_match(coalesce(atoms[i - 1], ''), '[0-9]+'))
), slots AS (
    SELECT a.seq, a."timestamp", a.category, coalesce(s, []) AS slots, coalesce(t, []) AS shown
    FROM atoms a LEFT JOIN (
        SELECT seq, list(CASE WHEN kind IS NULL THEN '0' || atom ELSE '1' || lpad(CAST(list_position({list(KINDS)}, kind) - 1 AS VARCHAR), 2, '0') END ORDER BY i) AS s,
               list(CASE WHEN kind IS NULL THEN atom ELSE '<' || kind || '>' END ORDER BY i) AS t
        FROM tokens GROUP BY seq) USING (seq)
), catalogue AS (
    SELECT category, CAST(row_number() OVER (PARTITION BY category ORDER BY min(seq)) AS BIGINT) AS id, count(*) AS "count", min("timestamp") AS first_seen, max("timestamp") AS last_seen,
           array_to_string(any_value(shown), ' ') AS template
    FROM slots GROUP BY category, slots
)"""

TOKENS = _TOKENS.replace("{parsed}", PARSED)


def _tokens_of(lines: str) -> str:
    """The same over other lines (seq, line)."""
    return _TOKENS.replace("{parsed}", _PARSED.format(lines=lines))


def _fold_sql(tokens: str, depth: int, threshold: float) -> str:
    """Clustering line by line: each step of the recursion takes every leaf's next line."""
    alike = "list_transform(f.templates, lambda p: len(list_filter(range(1, t.n + 1), lambda j: p[j] = t.slots[j] OR p[j] = '2')))"
    widened = "list_transform(p, lambda x, j: CASE WHEN x = slots[j] THEN x ELSE '2' END)"
    return rf"""{tokens}, leaves AS (
        SELECT *, len(slots) AS n, concat(coalesce('1' || category, '0'), chr(1), len(slots), chr(1), array_to_string(slots[1 : {max(depth, 2) - 2}], chr(2))) AS leaf FROM slots
    ), nth AS (
        SELECT *, row_number() OVER (PARTITION BY leaf ORDER BY seq) AS i FROM leaves
    ), fold AS (
        SELECT leaf, i, n, [slots] AS templates, CAST(1 AS BIGINT) AS own FROM nth WHERE i = 1
        UNION ALL
        SELECT leaf, i, n, CASE WHEN joins THEN list_transform(templates, lambda p, k: CASE WHEN k = best THEN {widened} ELSE p END) ELSE list_append(templates, slots) END, CASE WHEN joins THEN best ELSE len(templates) + 1 END
        FROM (SELECT *, list_position(alike, list_max(alike)) AS best, n = 0 OR (list_max(alike) > 0 AND list_max(alike) / n >= {threshold}) AS joins
              FROM (SELECT f.leaf, t.i, t.n, f.templates, t.slots, {alike} AS alike FROM fold f JOIN nth t ON t.leaf = f.leaf AND t.i = f.i + 1))
    ), last AS (
        SELECT leaf, arg_max(templates, i) AS templates FROM fold GROUP BY leaf
    ), clusters AS (
        SELECT f.leaf, own, any_value(category) AS category, min(seq) AS spawn, count(*) AS "count", min("timestamp") AS first_seen, max("timestamp") AS last_seen FROM fold f JOIN nth t ON t.leaf = f.leaf AND t.i = f.i GROUP BY f.leaf, own
    )
    SELECT category, row_number() OVER (PARTITION BY category ORDER BY spawn) AS id, "count", first_seen, last_seen,
           array_to_string(list_transform(templates[own], lambda x: CASE WHEN x = '2' THEN '<*>' WHEN starts_with(x, '1') THEN '<' || {list(KINDS)}[CAST(substr(x, 2) AS INTEGER) + 1] || '>' ELSE substr(x, 2) END), ' ') AS template
    FROM clusters JOIN last USING (leaf)"""

_KEY = r"""
CASE WHEN regexp_matches({x}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}') AND (substr({x}, 20, 1) <> '.' OR length(regexp_extract(substr({x}, 21), '^[0-9]*')) BETWEEN 1 AND 9)
     THEN left({x}, 19) || '.' || rpad(CASE WHEN substr({x}, 20, 1) = '.' THEN regexp_extract(substr({x}, 21), '^[0-9]*') ELSE '' END, 9, '0') END"""


def _key_sql(x: str) -> str:
    return _KEY.format(x=x)


FILES = rf"""
ev AS ({EVENTS["duck"]}),
files AS (SELECT *, CAST(right(node, 1) AS INTEGER) AS reader, row_number() OVER (PARTITION BY date, node ORDER BY event_id) AS line_no FROM ev),
keyed AS (SELECT *, coalesce(max({_key_sql("line")}) OVER (PARTITION BY date, reader ORDER BY line_no ROWS UNBOUNDED PRECEDING), '0000-00-00T00:00:00.000000000') AS merge_key FROM files)"""

# ---------------------------------------------------------------- queries


def _queries() -> dict:
    q: dict = {}
    q.update(_name_queries())
    q.update(_line_queries())
    q.update(_token_queries())
    q.update(_merge_queries())
    q.update(_catalogue_queries())
    q.update(_state_queries())
    return q


_NAMES = "SELECT event_id, concat(CASE event_id % 7 WHEN 0 THEN 'other.log-' ELSE 'debug.log-' END, CASE event_id % 11 WHEN 0 THEN '' ELSE {date} END, '-', CASE event_id % 5 WHEN 0 THEN 'a-b.c' WHEN 1 THEN '' ELSE concat('n', CAST(user_id AS STRING)) END, CASE event_id % 13 WHEN 0 THEN '.zst' ELSE '.gz' END) AS name FROM events"


def _name_queries() -> dict:
    names = lambda s, d: _bound(s, d, _NAMES.format(date="date_format(ts, 'yyyyMMdd')"), "events")
    duck = f"WITH n AS ({_NAMES.format(date="strftime(ts, '%Y%m%d')")}), p AS (SELECT event_id, name, regexp_extract(name, '^debug\\.log-([^-]+)-(.+)\\.gz$', 1) AS date, regexp_extract(name, '^debug\\.log-([^-]+)-(.+)\\.gz$', 2) AS node FROM n WHERE regexp_matches(name, '^debug\\.log-([^-]+)-(.+)\\.gz$'))"

    def parsed(s, d):
        return names(s, d).select("event_id", "name", N.node_file(F.col("name")).alias("is")).where("is is not null").select("event_id", "name", "is.date", "is.node")

    def day(s, d):
        rows = _bound(s, d, "SELECT event_id, concat('debug.log-', {0}, '.zst') AS name FROM events".format("date_format(ts, 'yyyyMMdd')"), "events")
        return rows.select("event_id", N.day_of(F.col("name")).alias("date"))

    return {
        "file_names": (parsed, f"{duck} SELECT event_id, name, date, node FROM p"),
        "days_before": (lambda s, d: parsed(s, d).where(F.col("date") < "20240115").groupBy("date").agg(F.count_distinct("node").alias("n_nodes"), F.count("*").alias("n_files")), f"{duck} SELECT date, count(DISTINCT node) AS n_nodes, count(*) AS n_files FROM p WHERE date < '20240115' GROUP BY date"),
        "plain_nodes": (lambda s, d: parsed(s, d).groupBy(N.plain(F.col("node")).alias("plain")).agg(F.count("*").alias("n")), f"{duck} SELECT node <> '' AND NOT starts_with(node, '.') AND NOT contains(node, '/') AS plain, count(*) AS n FROM p GROUP BY 1"),
        "merged_file_date": (day, "SELECT event_id, regexp_extract('debug.log-' || strftime(ts, '%Y%m%d') || '.zst', '^debug\\.log-(.+)\\.zst$', 1) AS date FROM events"),
    }


def _line_queries() -> dict:
    odd = "SELECT seq, CASE seq % 6 WHEN 0 THEN replace(line, 'Z', '.') WHEN 1 THEN concat(' ', line) WHEN 2 THEN concat(left(line, 19), '.1234567890 x') WHEN 3 THEN concat(left(line, 19), 'xyz') ELSE line END AS line FROM ({0})"
    odd_spark = lambda s, d: _bound(s, d, odd.format(MIXED["spark"]), "orders")

    def parse(s, d):
        return L.with_parsed(mixed(s, d), "line").drop("line")

    def prefix(s, d):
        return odd_spark(s, d).select("seq", L.node_of(F.col("line")).alias("node"), L.after_node(F.col("line")).alias("rest"))

    def sniff(s, d):
        rows = mixed(s, d).select(F.concat(F.lit("f"), F.pmod("seq", F.lit(8)).cast("string")).alias("file"), F.col("seq").alias("line_no"), F.when(F.pmod("seq", F.lit(8)) < 4, F.concat(F.lit("n1 "), F.col("line"))).otherwise(F.col("line")).alias("text"))
        return unprefixed(rows).select("file", "line_no", "text")

    sniffed = f"""WITH mixed AS ({MIXED["duck"]}), l AS (SELECT 'f' || CAST(seq % 8 AS VARCHAR) AS file, seq AS line_no, CASE WHEN seq % 8 < 4 THEN 'n1 ' || line ELSE line END AS text FROM mixed),
        v AS (SELECT *, CASE WHEN {_key_sql("text")} IS NOT NULL THEN false WHEN instr(text, ' ') > 1 AND {_key_sql("substr(text, instr(text, ' ') + 1)")} IS NOT NULL THEN true END AS verdict FROM l),
        f AS (SELECT file, arg_min(verdict, line_no) AS prefixed, min(line_no) AS decided FROM v WHERE verdict IS NOT NULL GROUP BY file)
        SELECT l.file, l.line_no, CASE WHEN prefixed AND l.line_no >= decided AND instr(text, ' ') > 0 THEN substr(text, instr(text, ' ') + 1) ELSE text END AS text FROM l LEFT JOIN f USING (file)"""
    o = f"WITH o AS ({odd.format(MIXED['duck'])})"
    escaped = "SELECT doc_id, concat(text, chr(1), '\"', chr(92), chr(9)) AS t FROM documents"
    return {
        "timestamp_keys": (lambda s, d: odd_spark(s, d).select("seq", L.timestamp_key(F.col("line")).alias("key"), L.looks_stamped(F.col("line")).alias("loose")), f"{o} SELECT seq, {_key_sql('line')} AS key, regexp_matches(line, '^[0-9]{{4}}-') AS loose FROM o"),
        "parsed_lines": (parse, f'WITH {PARSED} SELECT seq, "timestamp", thread, category, content FROM parsed'),
        "node_prefixes": (prefix, f"{o} SELECT seq, CASE WHEN instr(line, ' ') > 0 THEN left(line, instr(line, ' ') - 1) END AS node, CASE WHEN instr(line, ' ') > 0 THEN substr(line, instr(line, ' ') + 1) ELSE line END AS rest FROM o"),
        "sniffed_prefixes": (sniff, sniffed),
        "decoded_lines": (
            lambda s, d: _bound(s, d, "SELECT doc_id, text FROM documents", "documents").select("doc_id", L.decoded(F.concat(F.lit(b"\x80"), F.encode("text", "UTF-8"), F.lit(b"\xff\xfe"))).alias("text")),
            "SELECT doc_id, chr(65533) || text || chr(65533) || chr(65533) AS text FROM documents",
        ),
        "json_strings": (lambda s, d: _bound(s, d, escaped, "documents").select("doc_id", report_string(F.col("t")).alias("json")), f"""SELECT doc_id, '"' || replace(replace(replace(replace(replace(t, chr(92), '\\\\'), '"', '\\"'), chr(10), '\\n'), chr(9), '\\t'), chr(1), '\\u0001') || '"' AS json FROM ({escaped})"""),
    }


def _token_queries() -> dict:
    def content(s, d):
        return L.with_parsed(mixed(s, d), "line", ("content",)).drop("line")

    def tokens(s, d):
        return with_tokens(content(s, d)).select("seq", F.explode_outer("tokens").alias("t")).where("t is not null").select("seq", "t.kind", F.col("t.text").alias("text"))

    def kind(label):
        return lambda s, d: tokens(s, d).where(F.col("kind") == label).groupBy("text").agg(F.count("*").alias("n"))

    q = {
        "atoms": (lambda s, d: with_atoms(content(s, d)).select("seq", F.posexplode_outer("atoms").alias("i", "atom")).where("i is not null").select("seq", (F.col("i") + 1).cast("long").alias("i"), "atom"), f"WITH {TOKENS} SELECT seq, CAST(i AS BIGINT) AS i, atom FROM placed"),
        "token_kinds": (lambda s, d: tokens(s, d).groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("text").alias("n_texts")), f"WITH {TOKENS} SELECT kind, count(*) AS n, count(DISTINCT atom) AS n_texts FROM tokens GROUP BY kind"),
    }
    for label in KINDS:
        if label != "IPv6:PORT":
            q["kind_" + label.lower().replace(":", "_")] = (kind(label), f"WITH {TOKENS} SELECT atom AS text, count(*) AS n FROM tokens WHERE kind = '{label}' GROUP BY atom")
    bracketed = "SELECT o_orderkey AS seq, concat('us=[2001:db8::', CAST(o_custkey % 9999 AS STRING), ']:', CAST(o_orderkey % 70000 AS STRING), ' end') AS content FROM orders"
    q["kind_ipv6_port"] = (
        lambda s, d: with_tokens(_bound(s, d, bracketed, "orders")).select("seq", F.explode_outer("tokens").alias("t")).where("t.kind = 'IPv6:PORT'").select("seq", F.col("t.text").alias("text")),
        f"SELECT seq, regexp_extract(content, '\\[.*\\]:[0-9]+') AS text FROM ({bracketed}) WHERE seq % 70000 <= 65535",
    )
    return q


def _merge_queries() -> dict:
    def order(s, d):
        whole = placed(prefixed(keyed(event_files(s, d))), ["date"], ["merge_key", "reader", "line_no"])
        return whole.select("date", (F.col("place") + 1).alias("place"), "node", "line_no", "merge_key", F.col("merged_line").cast("string").alias("merged_line"))

    def back(s, d):
        return demultiplexed(order(s, d).select("date", F.col("place").alias("line_no"), F.col("merged_line").cast("binary").alias("line")), "date")

    def counts(s, d):
        return back(s, d).groupBy("date", "node").agg(F.count("*").alias("lines"), F.sum(F.octet_length("line")).cast("long").alias("n_bytes"))

    def check(s, d):
        files = event_files(s, d)
        report = checked(files.select("date", "node").distinct(), digests(files, "date", "node"), digests(back(s, d), "date", "node"))
        return report.select("date", "node", "ok", "lines")

    def differences(s, d):
        files = event_files(s, d)
        spoilt = (F.col("line_no") == 3) & F.expr("(cast(right(date, 1) AS int) + cast(right(node, 1) AS int)) % 3 = 0")
        nth = placed(back(s, d), ["date", "node"], ["line_no"])
        read = nth.withColumn("line_no", F.col("place") + 1).withColumn("line", F.when(spoilt, F.concat("line", F.lit(b"!"))).otherwise(F.col("line")))
        return checked(files.select("date", "node").distinct(), digests(files, "date", "node"), digests(read, "date", "node")).select("date", "node", "ok", "lines")

    return {
        "merge_order": (order, f"WITH {FILES} SELECT date, row_number() OVER (PARTITION BY date ORDER BY merge_key, reader, line_no) AS place, node, line_no, merge_key, node || ' ' || line AS merged_line FROM keyed"),
        "split_counts": (counts, f"WITH {FILES} SELECT date, node, count(*) AS lines, CAST(sum(strlen(line)) AS BIGINT) AS n_bytes FROM files GROUP BY date, node"),
        "round_trip_check": (check, f"WITH {FILES}, merged AS (SELECT date, line_no, line, node || ' ' || line AS merged_line FROM files) SELECT date, left(merged_line, instr(merged_line, ' ') - 1) AS node, bool_and(substr(merged_line, instr(merged_line, ' ') + 1) = line) AS ok, count(*) AS lines FROM merged GROUP BY ALL"),
        # lines that were changed on the way show in their own file alone
        "round_trip_differences": (differences, f"WITH {FILES}, found AS (SELECT *, CASE WHEN line_no = 3 AND (CAST(right(date, 1) AS INTEGER) + CAST(right(node, 1) AS INTEGER)) % 3 = 0 THEN line || '!' ELSE line END AS back FROM files) SELECT date, node, bool_and(line = back) AS ok, count(*) AS lines FROM found GROUP BY date, node"),
        "round_trip_totals": (lambda s, d: check(s, d).agg(F.count_if("ok").alias("n_ok"), F.count("*").alias("n_files")), f"WITH {FILES} SELECT count(*) AS n_ok, count(*) AS n_files FROM (SELECT DISTINCT date, node FROM files)"),
    }


def _shown(clusters: DataFrame) -> DataFrame:
    return clusters.select("category", F.col("id").cast("long").alias("id"), F.col("count").cast("long").alias("count"), "first_seen", "last_seen", rendered(F.col("template")).alias("template"))


def _catalogue_queries() -> dict:
    def whole(s, d):
        return cluster(_slots(s, d), threshold=1.0)

    def report(**options):
        return lambda s, d: _shown(selected(whole(s, d).drop("node"), **options))

    def by_node(s, d):
        rows = slotted(_bound(s, d, EVENTS["spark"], "events"), "line").select(F.coalesce("node", F.lit(UNKNOWN)).alias("node"), "category", F.col("event_id").alias("seq"), "timestamp", "slots")
        out = cluster(rows, threshold=1.0)
        return out.select("node", "category", F.col("id").cast("long").alias("id"), F.col("count").cast("long").alias("count"), "first_seen", "last_seen", F.size("template").alias("n_slots"))

    def two_batches(threshold):
        def run(s, d):
            lines = _slots(s, d)
            half = F.col("seq") < 3000
            first = cluster(lines.where(half), threshold=threshold)
            # what a catalogue file would hold of the first batch
            loaded = clusters_of(with_lines(first.drop("node")))
            return _shown(cluster(lines.where(~half), threshold=threshold, loaded=loaded))

        return run

    def prose(s, d):
        lines = _bound(s, d, "SELECT doc_id * 100000 AS base, text FROM documents", "documents").select("base", F.posexplode(F.split("text", "\n")).alias("i", "line"))
        return slotted(lines, "line").select(F.lit(None).cast("string").alias("node"), "category", (F.col("base") + F.col("i")).alias("seq"), "timestamp", "slots")

    def numbered(rows):
        return placed(rows.withColumns({"one": F.lit(1), "at": F.monotonically_increasing_id()}), ["one"], ["at"]).drop("one", "at")

    def report_order(s, d):
        return numbered(in_order(selected(whole(s, d).drop("node"), min_count=2))).select("place", "category", F.col("id").cast("long").alias("id"))

    def state_order(s, d):
        return numbered(ordered(whole(s, d).drop("node"))).select("place", "category", F.col("id").cast("long").alias("id"))

    def file_order(s, d):
        rows = _bound(s, d, "SELECT doc_id, concat('debug.log-', lang, '-', source, '-', CAST(doc_id % 97 AS STRING)) AS file FROM documents", "documents")
        return sequenced(rows.select("file", F.col("doc_id").alias("line_no"))).select("file", "line_no", "seq")

    show = 'category, id, "count", first_seen, last_seen, template'
    ranked = f'{TOKENS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY "count" DESC, id) AS rank FROM catalogue)'
    node_slots = f"""WITH ev AS ({EVENTS["duck"]}), {_tokens_of("SELECT event_id AS seq, line FROM ev")}
        SELECT node, category, row_number() OVER (PARTITION BY node, category ORDER BY min(seq)) AS id, count(*) AS "count", min("timestamp") AS first_seen, max("timestamp") AS last_seen, CAST(len(slots) AS INTEGER) AS n_slots
        FROM slots JOIN (SELECT event_id AS seq, node FROM ev) USING (seq) GROUP BY node, category, slots"""
    documents = "SELECT doc_id * 100000 + i - 1 AS seq, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)"
    fold = lambda depth, threshold, tokens=TOKENS: "WITH RECURSIVE " + _fold_sql(tokens, depth, threshold).strip()
    return {
        "catalogue": (lambda s, d: _shown(whole(s, d)), f"WITH {TOKENS} SELECT {show} FROM catalogue"),
        "catalogue_grouped": (lambda s, d: _shown(exact_catalogue(_slots(s, d))), f"WITH {TOKENS} SELECT {show} FROM catalogue"),
        "catalogue_incremental": (two_batches(1.0), f"WITH {TOKENS} SELECT {show} FROM catalogue"),
        "catalogue_default": (lambda s, d: _shown(cluster(_slots(s, d))), fold(4, 0.5)),
        "catalogue_strict": (lambda s, d: _shown(cluster(_slots(s, d), depth=3, threshold=0.75)), fold(3, 0.75)),
        # wildcards of the first batch are loaded for the second
        "catalogue_continued": (two_batches(0.5), fold(4, 0.5)),
        "catalogue_prose": (lambda s, d: _shown(cluster(prose(s, d))), fold(4, 0.5, _tokens_of(documents))),
        "report_order": (report_order, f'WITH {ranked} SELECT row_number() OVER (ORDER BY category NULLS FIRST, rank) - 1 AS place, category, id FROM ranked WHERE "count" >= 2'),
        "state_order": (state_order, f"WITH {TOKENS} SELECT row_number() OVER (ORDER BY category NULLS FIRST, id) - 1 AS place, category, id FROM catalogue"),
        "file_order": (file_order, "WITH f AS (SELECT concat('debug.log-', lang, '-', source, '-', doc_id % 97) AS file, doc_id AS line_no FROM documents) SELECT file, line_no, ((dense_rank() OVER (ORDER BY encode(file)) - 1) << 40) + line_no AS seq FROM f"),
        "report_min_count": (report(min_count=3), f'WITH {ranked} SELECT {show} FROM ranked WHERE "count" >= 3'),
        "report_category": (report(categories=["net", ""]), f"WITH {ranked} SELECT {show} FROM ranked WHERE category IN ('net', '')"),
        "report_top": (report(top=5), f"WITH {ranked} SELECT {show} FROM ranked WHERE rank <= 5"),
        "report_text": (
            lambda s, d: text_lines(selected(whole(s, d).drop("node"), top=20)).select("category", F.col("rank").cast("long").alias("rank"), "text"),
            f"WITH {ranked} SELECT category, rank, CASE WHEN rank = 1 THEN '=== ' || coalesce(category, '(no category)') || ' ===' || chr(10) ELSE '' END || lpad(CAST(\"count\" AS VARCHAR), 6, ' ') || ' ' || template AS text FROM ranked WHERE rank <= 20",
        ),
        "report_json": (
            lambda s, d: json_lines(selected(whole(s, d).drop("node"), top=20)).select("category", F.col("rank").cast("long").alias("rank"), "text"),
            f"""WITH {ranked} SELECT category, rank, '{{"category":' || coalesce('"' || category || '"', 'null') || ',"count":' || "count" || ',"first_seen":' || coalesce('"' || first_seen || '"', 'null') || ',"template":"' || template || '"}}' AS text FROM ranked WHERE rank <= 20""",
        ),
        "per_node_catalogue": (by_node, node_slots),
    }


_STATE = """
SELECT CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat(lang, chr(8), chr(34), chr(31)) END AS category, doc_id AS id, n_chars AS count,
       CASE WHEN doc_id % 3 = 0 THEN NULL ELSE concat(source, chr(92)) END AS first_seen, source AS last_seen, concat(text, chr(12), chr(1), chr(13)) AS literal FROM documents
"""
_ESCAPED = """concat('a', chr(92), 'u00e9', chr(92), '/', chr(92), 'n', chr(92), chr(34), chr(92), 'b')"""
_STATE_TEXT = f"""
SELECT doc_id, concat('{{ "id" :', CASE doc_id % 3 WHEN 0 THEN '18446744073709551615' ELSE CAST(doc_id AS STRING) END, ',"category":', CASE doc_id % 4 WHEN 0 THEN 'null' ELSE concat(chr(34), {_ESCAPED}, lang, chr(34)) END,
       ', "count":', CAST(n_chars AS STRING), ',"first_seen":null,"last_seen":"', source, '","template":[', CASE WHEN doc_id % 5 = 0 THEN '' ELSE concat('{{"t":"L","v":"', {_ESCAPED}, '"}}, {{"t":"W","k":"PEER"}},{{"t":"S"}}') END, ' ]}}') AS text FROM documents
"""


def _state_queries() -> dict:
    def lines(s, d):
        rows = _bound(s, d, _STATE, "documents").withColumn("template", F.array(F.concat(F.lit("0"), "literal"), F.lit("103"), F.lit("2"), F.lit("117")))
        return with_lines(rows).select("id", "text")

    def rows(s, d):
        out = clusters_of(_bound(s, d, _STATE_TEXT, "documents"))
        return out.select("category", *(F.col(c).cast("string").alias(c) for c in ("id", "count")), "first_seen", "last_seen", F.size("template").alias("n_slots"), F.array_join("template", "|").alias("template"))

    short = {chr(92): "chr(92)", '"': "chr(34)", "\n": "chr(10)", "\r": "chr(13)", "\t": "chr(9)", "\b": "chr(8)", "\f": "chr(12)"}

    def escaped(x: str) -> str:
        out = x
        for c, name in short.items():
            letter = {"\n": "n", "\r": "r", "\t": "t", "\b": "b", "\f": "f"}.get(c)
            out = f"replace({out}, {name}, chr(92) || {f"'{letter}'" if letter else name})"
        for code in (1, 31):
            out = f"replace({out}, chr({code}), chr(92) || 'u{code:04x}')"
        return f"coalesce(chr(34) || {out} || chr(34), 'null')"

    whole = "chr(97) || chr(233) || '/' || chr(10) || chr(34) || chr(8)"
    return {
        "state_lines": (lines, f"""SELECT id, '{{"id":' || id || ',"category":' || {escaped("category")} || ',"count":' || "count" || ',"first_seen":' || {escaped("first_seen")} || ',"last_seen":' || {escaped("last_seen")}
            || ',"template":[{{"t":"L","v":' || {escaped("literal")} || '}},{{"t":"W","k":"FLOAT"}},{{"t":"S"}},{{"t":"W","k":"BASE58"}}]}}' AS text FROM ({_STATE})"""),
        "state_rows": (rows, f"""SELECT CASE doc_id % 4 WHEN 0 THEN NULL ELSE {whole} || lang END AS category, CASE doc_id % 3 WHEN 0 THEN '18446744073709551615' ELSE CAST(doc_id AS VARCHAR) END AS id, CAST(n_chars AS VARCHAR) AS "count",
            CAST(NULL AS VARCHAR) AS first_seen, source AS last_seen, CAST(CASE WHEN doc_id % 5 = 0 THEN 0 ELSE 3 END AS INTEGER) AS n_slots, CASE WHEN doc_id % 5 = 0 THEN '' ELSE '0' || {whole} || '|100|2' END AS template FROM documents"""),
    }


QUERIES = {name: q[0] for name, q in _queries().items()}
ORACLES = {name: q[1] for name, q in _queries().items() if q[1]}
