"""URL rules by longest match, then a Bloom filter cascade for listed hosts.

The cascade's first filter holds the listed keys, the second the corpus's other
keys that pass the first, the third the listed keys that pass the second, and so
on until none is left. Over the keys it was built from it answers exactly, and
a row is judged by bit tests alone, without a join.

Everything is DataFrame functions. A filter reaches the tasks as a scalar
subquery; its size is bounded by `KEYS_PER_PASS`: a longer list, or one whose first
filter is expected to let more other keys pass than that, is split by key hash into
passes with a cascade each.

Defined cases: a NULL url or one without `://` has an empty host and path, which
no rule fits and which is never listed; of two fitting rules of one length the one that is later in the
list holds; long urls are read whole; repeated rows are judged alike; an empty
table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import math
import string
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import saved

#: Fixed values of the task: action, host, path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
KEYS_PER_PASS = 1 << 22
BITS_PER_KEY = 10
PROBES = 5
#: Share of other keys that pass a filter.
PASSING = (1 - math.exp(-PROBES / BITS_PER_KEY)) ** PROBES


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(__url, instr(__url, '://') + 3)"))
    authority = F.regexp_extract(F.coalesce(rest, F.lit("")), "^[^/?#]*", 0)
    after = F.coalesce(rest, F.lit("")).substr(F.length(authority) + 1, F.lit(2147483647))
    host = F.translate(authority, string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(after, "^[^?#]*", 0)


def fits(host: Column, path: Column, rule_host: str, rule_path: str) -> Column:
    return (((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path))


def _probes(key: Column, level: int, n_bits: int) -> list[Column]:
    first, step = F.xxhash64(key, F.lit(level)), F.xxhash64(F.lit(level), key)
    # Halved before the sum, which then cannot overflow in ANSI mode.
    return [F.pmod(F.shiftright(first, 4) + F.shiftright(step, 4) * F.lit(j), F.lit(n_bits)) for j in range(PROBES)]


class BloomLevel:
    """One Bloom filter: a saved one-row table with an array of 64-bit words.

    With `most_words` a filter for many keys stays that small and lets more others pass.
    """

    def __init__(self, keys: DataFrame, n_keys: int, level: int, most_words: int | None = None):
        self.level = level
        self.n_words = max(1, math.ceil(n_keys * BITS_PER_KEY / 64))
        if most_words:
            self.n_words = min(self.n_words, most_words)
        spark = keys.sparkSession
        bits = keys.select(F.explode(F.array(*_probes(F.col("key"), level, self.n_words * 64))).alias("bit"))
        words = bits.select(F.shiftright("bit", 6).alias("word"),
                            F.expr("shiftleft(1L, CAST(bit % 64 AS INT))").alias("mask"))
        zeros = spark.range(self.n_words).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("mask"))
        words = words.unionAll(zeros).groupBy("word").agg(F.bit_or("mask").alias("mask"))
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("word", "mask"))), lambda w: w["mask"])
        self.filter = saved(words.agg(ordered.alias("words")), "bloom")

    def holds(self, key: Column) -> Column:
        words = self.filter.select("words").scalar()
        tests = [F.getbit(F.get(words, F.shiftright(bit, 6).cast("int")), (bit % 64).cast("int")) == 1
                 for bit in _probes(key, self.level, self.n_words * 64)]
        return reduce(lambda a, b: a & b, tests)


class Cascade:
    """Exact membership for the keys of (key, listed)."""

    def __init__(self, keys: DataFrame):
        held, other = keys.filter("listed").select("key"), keys.filter("NOT listed").select("key")
        self.levels: list[BloomLevel] = []
        n_held = held.count()
        while n_held:
            level = BloomLevel(held, n_held, len(self.levels))
            self.levels.append(level)
            passed = saved(other.filter(level.holds(F.col("key"))), "passed")
            held, other, n_held = passed, held, passed.count()

    def listed(self, key: Column) -> Column:
        answer = F.lit(len(self.levels) % 2 == 1)
        for i, level in reversed(list(enumerate(self.levels))):
            answer = F.when(level.holds(key), answer).otherwise(F.lit(i % 2 == 1))
        return answer


def url_verdicts(pages: DataFrame, listed, rules=RULES, id_col: str = "page_id", url: str = "url",
                 keys_per_pass: int = KEYS_PER_PASS) -> DataFrame:
    """id, host, path, rule, verdict. `listed` gives a Boolean column for a host,
    asked once for each host of the corpus, or is a table with a column `host`."""
    host, path = host_and_path(F.col("__url"))
    parsed = pages.select(F.col(id_col).alias("id"), F.col(url).alias("__url")).select(
        "id", host.alias("host"), path.alias("path"))
    hosts = parsed.filter("host <> ''").groupBy("host").agg(F.lit(1).alias("one"))
    if isinstance(listed, DataFrame):
        known = listed.select("host").distinct().withColumn("known", F.lit(True))
        hosts, is_listed = hosts.join(known, "host", "left"), F.col("known")
    else:
        is_listed = listed(F.col("host"))
    hosts = saved(hosts.select(F.col("host").alias("key"), F.coalesce(is_listed, F.lit(False)).alias("listed")), "hosts")
    n_listed = hosts.filter("listed").count()
    n_passing = (hosts.count() - n_listed) * PASSING if n_listed else 0
    n_passes = max(1, math.ceil(max(n_listed, n_passing) / keys_per_pass))

    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        hit = fits(F.col("host"), F.col("path"), h, p)
        rule, action = F.when(hit, F.lit(h + p)).otherwise(rule), F.when(hit, F.lit(act)).otherwise(action)
    ruled = parsed.select("id", "host", "path", rule.alias("rule"), action.alias("action"))

    def judged(rows: DataFrame, keys: DataFrame) -> DataFrame:
        member = (F.col("host") != "") & Cascade(keys).listed(F.col("host"))
        verdict = F.coalesce(F.col("action"), F.when(member, F.lit("block")).otherwise(F.lit("allow")))
        return rows.select("id", "host", "path", "rule", verdict.alias("verdict"))

    if n_passes == 1:
        return judged(ruled, hosts)
    part = lambda c: F.pmod(F.xxhash64(c, F.lit("pass")), F.lit(n_passes))
    return reduce(DataFrame.unionAll, [judged(ruled.filter(part("host") == i), hosts.filter(part("key") == i))
                                       for i in range(n_passes)])
