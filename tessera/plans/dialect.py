"""One declarative plan, two engines: Catalyst runs it, and DuckDB checks it.

An operator is a function of a dialect that returns SQL.  Only what the engines spell differently lives here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

SPACE = "[ \\t\\n\\r]+"


class SparkDialect:
    """Spark SQL over Parquet tables of a folder."""

    name = "spark"

    def __init__(self, folder: str):
        self.folder = folder

    def table(self, name: str) -> str:
        return f"parquet.`{self.folder}/{name}.parquet`"

    def text(self, value: str) -> str:
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def sha(self, x: str) -> str:
        return f"sha2({x}, 256)"

    def micros(self, x: str) -> str:
        return f"unix_micros(cast({x} AS timestamp))"

    def matches(self, x: str, pattern: str) -> str:
        return f"regexp_like({x}, {self.text(pattern)})"

    def extract(self, x: str, pattern: str, group: int = 1) -> str:
        return f"regexp_extract({x}, {self.text(pattern)}, {group})"

    def replace(self, x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, {self.text(pattern)}, {self.text(by.replace(chr(92), '$'))})"

    def words(self, x: str, pattern: str = SPACE) -> str:
        return f"filter(split({x}, {self.text(pattern)}, -1), w -> w <> '')"

    def lines(self, x: str) -> str:
        return f"split({x}, '\\n', -1)"

    def size(self, x: str) -> str:
        return f"size({x})"

    def all_matches(self, x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract_all({x}, {self.text(pattern)}, {group})"

    def rows(self, keep: str, array: str, source: str, where: str = "true") -> str:
        """keep, pos (from 0), item: one row for each element."""
        return f"(SELECT {keep}, cast(pos AS bigint) AS pos, item FROM (SELECT {keep}, posexplode({array}) AS (pos, item) FROM {source} WHERE {where}))"

    def json(self, x: str, path: str) -> str:
        return f"get_json_object({x}, '{path}')"

    def day(self, x: str) -> str:
        return f"cast(datediff(cast({x} AS date), date '1970-01-01') AS bigint)"

    def joined(self, x: str, order: str) -> str:
        return f"array_join(transform(array_sort(collect_list(struct({order} AS o, {x} AS x))), s -> s.x), ',')"

    def contains(self, x: str, y: str) -> str:
        return f"contains({x}, {y})"

    def listed(self, x: str, order: str, where: str = "true") -> str:
        """A group's values in order; those that are null are left out."""
        return f"transform(array_sort(collect_list(struct({order} AS o, {x} AS x)) FILTER (WHERE {where} AND {x} IS NOT NULL)), s -> s.x)"

    def glued(self, array: str, by: str) -> str:
        return f"array_join({array}, {by})"

    def whole(self, x: str) -> str:
        """A number rounded down, as an integer."""
        return f"cast(floor({x}) AS bigint)"

    def translate_hex(self, h: str) -> str:
        return f"(translate(substr({h}, 1, 1), '89abcdef01234567', '0123456789abcdef') || substr({h}, 2, 15))"


class DuckDialect(SparkDialect):
    """DuckDB over views of the same names."""

    name = "duck"

    def __init__(self):
        super().__init__("")

    def table(self, name: str) -> str:
        return name

    def text(self, value: str) -> str:
        return "'" + value.replace("'", "''") + "'"

    def sha(self, x: str) -> str:
        return f"sha256({x})"

    def micros(self, x: str) -> str:
        return f"epoch_us({x})"

    def matches(self, x: str, pattern: str) -> str:
        return f"regexp_matches({x}, {self.text(pattern)})"

    def replace(self, x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, {self.text(pattern)}, {self.text(by)}, 'g')"

    def words(self, x: str, pattern: str = SPACE) -> str:
        return f"list_filter(regexp_split_to_array({x}, {self.text(pattern)}), lambda w: w <> '')"

    def lines(self, x: str) -> str:
        return f"string_split({x}, chr(10))"

    def size(self, x: str) -> str:
        return f"len({x})"

    def rows(self, keep: str, array: str, source: str, where: str = "true") -> str:
        return f"(SELECT {keep}, unnest(range(0, len(arr))) AS pos, unnest(arr) AS item FROM (SELECT {keep}, {array} AS arr FROM {source} WHERE {where}))"

    def json(self, x: str, path: str) -> str:
        return f"json_extract_string({x}, '{path}')"

    def day(self, x: str) -> str:
        return f"cast(date_diff('day', date '1970-01-01', cast({x} AS date)) AS bigint)"

    def listed(self, x: str, order: str, where: str = "true") -> str:
        return f"coalesce(list({x} ORDER BY {order}) FILTER (WHERE {where} AND {x} IS NOT NULL), [])"

    def glued(self, array: str, by: str) -> str:
        return f"array_to_string({array}, {by})"

    def joined(self, x: str, order: str) -> str:
        return f"string_agg({x}, ',' ORDER BY {order}, {x})"


Plan = Callable[[SparkDialect], str]


class Registry:
    """Named plans; each gives a Spark query and, unless ``checked`` is false, its DuckDB twin."""

    def __init__(self):
        self.plans: dict[str, Plan] = {}
        self.frames: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def plan(self, name: str) -> Callable[[Plan], Plan]:
        def add(f: Plan) -> Plan:
            self.plans[name] = f
            return f

        return add

    def frame(self, name: str, oracle: str | None = None):
        def add(f):
            self.frames[name] = f
            if oracle:
                self.sql[name] = oracle
            return f

        return add

    def queries(self) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
        return {n: (lambda spark, d, f=f: spark.sql(f(SparkDialect(d)))) for n, f in self.plans.items()} | self.frames

    def oracles(self) -> dict[str, str]:
        return {n: f(DuckDialect()) for n, f in self.plans.items()} | self.sql


REGISTRY = Registry()
