"""One relational plan text for Spark SQL and its DuckDB oracle.

A plan is a function of a dialect.  Table names come from the dialect
(``d.frames``), as do the few functions that the two engines name differently.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources import adapters

RAW = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


class _Dialect:
    def __init__(self):
        self.used: list[str] = []

    def __getattr__(self, name: str) -> str:
        if name not in RAW and name not in adapters.BUILD:
            raise AttributeError(name)
        if name not in self.used:
            self.used.append(name)
        return self.table(name)

    # the same text in both
    @staticmethod
    def overlap(a0, a1, b0, b1) -> str:
        return f"greatest(0e0, least({a1}, {b1}) - greatest({a0}, {b0}))"

    def iou(self, a0, a1, b0, b1) -> str:
        c = self.overlap(a0, a1, b0, b1)
        return f"(CASE WHEN {a1} > {a0} AND {b1} > {b0} THEN {c} / (({a1} - {a0}) + ({b1} - {b0}) - {c}) ELSE 0e0 END)"

    def numbered(self, name: str, source: str, bucket: str, order: str) -> str:
        """CTEs that end in ``name``: ``source`` with ``i`` (from 1) in the order of (bucket, order) and the count ``n``.

        Rows are numbered within their bucket; only one row a bucket meets in the running sum over all.
        """
        return f"""{name}_r AS (SELECT s.*, {bucket} AS bucket FROM {source} s),
    {name}_c AS (SELECT bucket, count(*) AS c FROM {name}_r GROUP BY bucket),
    {name}_o AS (SELECT bucket, CAST(sum(c) OVER (ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - c AS BIGINT) AS base, CAST(sum(c) OVER () AS BIGINT) AS n FROM {name}_c),
    {name} AS (SELECT r.*, o.base + {self.rn(f"PARTITION BY r.bucket ORDER BY {order}")} AS i, o.n FROM {name}_r r JOIN {name}_o o ON o.bucket = r.bucket)"""

    @staticmethod
    def rn(over: str) -> str:
        return f"CAST(row_number() OVER ({over}) AS BIGINT)"


class SparkDialect(_Dialect):
    all_flag = ""
    #: A closing brace, as Spark's parameterised text takes it.
    brace = "}}"

    def table(self, name):
        return "{" + name + "}"

    def floor(self, x):
        return f"floor({x})"

    def ceil(self, x):
        return f"ceil({x})"

    def sha(self, x):
        return f"sha2({x}, 256)"

    def hash_int(self, x):
        return f"CAST(conv(substr(sha2({x}, 256), 1, 15), 16, 10) AS BIGINT)"

    def pct(self, x, p):
        return f"percentile({x}, {p})"

    def pct_disc(self, x, p):
        return f"percentile_disc({p}) WITHIN GROUP (ORDER BY {x})"

    def half_even(self, x):
        return f"CAST(bround({x}) AS BIGINT)"

    def tokens(self, x):
        return rf"regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}_]+', 0)".replace("{", "{{").replace("}", "}}")

    def micros(self, x):
        return f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2000-01-01 00:00:00', {x})"

    def unnest(self, x, name):
        return f"LATERAL VIEW explode({x}) AS {name}"

    def seq(self, lo, hi):
        return f"sequence({lo}, {hi})"

    def json_int(self, x, key):
        return f"CAST(get_json_object({x}, '$.{key}') AS BIGINT)"

    def json_ok(self, x):
        return f"(try_parse_json({x}) IS NOT NULL)"

    def concat_sorted(self, x):
        return f"concat_ws(',', sort_array(collect_set({x})))"

    def size(self, x):
        return f"CAST(size({x}) AS BIGINT)"

    def pattern(self, p):
        return "'" + p + "'"

    def matches(self, x, p):
        return f"({x} RLIKE {p})"

    def join_ordered(self, key, x):
        return f"array_join(transform(array_sort(collect_list(struct({key} AS k, {x} AS x))), s -> s.x), '|')"

    def distinct_list(self, x):
        return f"array_distinct({x})"

    def intersect(self, a, b):
        return f"array_intersect({a}, {b})"


    def dot(self, a, b):
        return f"aggregate(zip_with({a}, {b}, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), 0e0, (s, x) -> s + x)"

    def at(self, x, i):
        return f"CAST({x}[{i}] AS DOUBLE)"

    def two_places(self, x):
        return f"format_string('%.2f', {x})"

    def sorted_list(self, key, x):
        return f"transform(array_sort(collect_list(struct({key} AS k, {x} AS x))), s -> s.x)"

    def repeat_list(self, x, n):
        return f"array_repeat({x}, CAST({n} AS INT))"

    def joined(self, x):
        return f"array_join({x}, ',')"

    def as_text(self, x):
        return f"transform({x}, v -> CAST(v AS STRING))"

    def string(self, x):
        return f"CAST({x} AS STRING)"

    def sorted_join(self, *names):
        """Joins with the named inputs are by sorting: Spark takes rows that an array made for as few as the rows it made them of, and would broadcast them."""
        return f"/*+ MERGE({', '.join(names)}) */ "

    def running(self, x, over, start=None):
        """``start`` and the window's sum of ``x``, added exactly as long as every summand is a number of at most 9 places.

        The sum of doubles depends on their order, so a total that is just a bound may miss it.
        """
        exact = lambda v: f"CASE WHEN CAST(try_cast({v} AS DECIMAL(28, 9)) AS DOUBLE) = {v} THEN try_cast({v} AS DECIMAL(28, 9)) END"
        fit = f"count({exact(x)}) OVER ({over}) = count({x}) OVER ({over})"
        if start is None:
            return f"CASE WHEN {fit} THEN CAST(sum({exact(x)}) OVER ({over}) AS DOUBLE) ELSE sum({x}) OVER ({over}) END"
        return f"CASE WHEN {fit} AND {exact(start)} IS NOT NULL THEN CAST({exact(start)} + sum({exact(x)}) OVER ({over}) AS DOUBLE) ELSE {start} + sum({x}) OVER ({over}) END"


class DuckDialect(_Dialect):
    all_flag = ", 'g'"
    brace = "}"

    def table(self, name):
        return name

    def floor(self, x):
        return f"CAST(floor({x}) AS BIGINT)"

    def ceil(self, x):
        return f"CAST(ceil({x}) AS BIGINT)"

    def sha(self, x):
        return f"sha256({x})"

    def hash_int(self, x):
        return f"CAST('0x' || substr(sha256({x}), 1, 15) AS BIGINT)"

    def pct(self, x, p):
        return f"quantile_cont({x}, {p})"

    def pct_disc(self, x, p):
        return f"quantile_disc({x}, {p})"

    def half_even(self, x):
        return f"CAST(round_even({x}, 0) AS BIGINT)"

    def tokens(self, x):
        return rf"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]+')"

    def micros(self, x):
        return f"(epoch_us({x}) - epoch_us(TIMESTAMP '2000-01-01 00:00:00'))"

    def unnest(self, x, name):
        return f", unnest({x}) AS _u({name})"

    def seq(self, lo, hi):
        return f"range({lo}, {hi} + 1)"

    def json_int(self, x, key):
        return f"CAST(json_extract({x}, '$.{key}') AS BIGINT)"

    def json_ok(self, x):
        return f"(json_valid({x}) AND NOT regexp_matches({x}, ',\\s*[}}\\]]'))"

    def concat_sorted(self, x):
        return f"array_to_string(list_sort(list(DISTINCT {x})), ',')"

    def size(self, x):
        return f"len({x})"

    def pattern(self, p):
        return "'" + p.replace("\\\\", "\\") + "'"

    def matches(self, x, p):
        return f"regexp_matches({x}, {p})"

    def join_ordered(self, key, x):
        return f"string_agg({x}, '|' ORDER BY {key}, {x})"

    def distinct_list(self, x):
        return f"list_distinct({x})"

    def intersect(self, a, b):
        return f"list_intersect({a}, {b})"


    def dot(self, a, b):
        return f"list_inner_product({a}::DOUBLE[], {b}::DOUBLE[])"

    def at(self, x, i):
        return f"CAST({x}[{i + 1}] AS DOUBLE)"

    def two_places(self, x):
        return f"printf('%.2f', {x})"

    def sorted_list(self, key, x):
        return f"list({x} ORDER BY {key}, {x})"

    def repeat_list(self, x, n):
        return f"list_transform(range({n}), lambda _i: {x})"

    def joined(self, x):
        return f"array_to_string({x}, ',')"

    def as_text(self, x):
        return f"list_transform({x}, lambda v: CAST(v AS VARCHAR))"

    def string(self, x):
        return f"CAST({x} AS VARCHAR)"

    def sorted_join(self, *names):
        return ""

    def running(self, x, over, start=None):
        return f"{start + ' + ' if start else ''}sum({x}) OVER ({over})"


def expand_rounds(text: str) -> str:
    """``round(x, n)`` in the same double arithmetic on both engines, which round halves of doubles differently."""
    while m := re.search(r"(?<![a-z_])round\(", text):
        depth, cut, i = 1, 0, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(text[i], 0)
            if text[i] == "," and depth == 1:
                cut = i
            i += 1
        x, n = (text[m.end() : cut], text[cut + 1 : i - 1].strip()) if cut else (text[m.end() : i - 1], "0")
        text = f"{text[: m.start()]}(floor(({x}) * 1e{n} + 5e-1) / 1e{n}){text[i:]}"
    return text


Plan = Callable[[_Dialect], str]


def build(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return adapters.BUILD[name](spark, sf_dir) if name in adapters.BUILD else adapters.table(spark, sf_dir, name)


def query(plan: Plan) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = SparkDialect()
        text = expand_rounds(plan(d))
        return spark.sql(text, **{n: build(spark, sf_dir, n) for n in d.used})

    return run


def on(spark: SparkSession, plan: Plan, tables: dict[str, DataFrame]) -> DataFrame:
    """``plan`` over given tables instead of those of a folder."""
    d = SparkDialect()
    text = expand_rounds(plan(d))
    return spark.sql(text, **{n: tables[n] for n in d.used})


def oracle(plan: Plan) -> str:
    return expand_rounds(_oracle(plan))


def _oracle(plan: Plan) -> str:
    d = DuckDialect()
    text = plan(d).strip()
    defs = adapters.ctes([n for n in d.used if n in adapters.SQL])
    if not defs:
        return text
    if text.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {', '.join(defs)}, {text[len('WITH RECURSIVE') :]}"
    return f"WITH {', '.join(defs)}, {text[4:]}" if text.upper().startswith("WITH") else f"WITH {', '.join(defs)} {text}"
