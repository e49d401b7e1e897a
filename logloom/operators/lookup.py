"""Lookups in knowledge tables: a left join that takes the first row, in the order in which the table was loaded.

A condition is taken apart into alternatives, each of which finds candidate rows by a key: equal values, or the bucket of
a value between two range ends. Tables of up to ``GATHERED`` rows (counted once) are gathered by key and broadcast: the
events pass the lookup in one projection, without a shuffle and without being read twice. With larger tables the bound
values are made distinct, only they meet the table, and the rows found are joined back.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.net import SQL_FUNCTIONS
from ..functions.values import Value, kind_of
from ..plans.models import Const, Get, ModelError, Now, Select

ROW = "_row"
#: Bound values of one lookup.
MOST_VALUES = 5
#: Rows of a table that is gathered by key and broadcast.
GATHERED = 1 << 16
#: Alternatives that a condition is taken apart into at most; beyond, it is tested as a whole.
ALTERNATIVES = 16


class Knowledge:
    """Named tables with a row number that keeps the order of loading. ``allowed``: the only names that may be loaded."""

    def __init__(self, spark: SparkSession, allowed: set[str] | None = None):
        self.spark, self.allowed = spark, allowed
        self.tables: dict[str, DataFrame] = {}
        self._sizes: dict[str, tuple[DataFrame, int]] = {}

    def size(self, name: str) -> int:
        """Rows of a table, counted when first asked for."""
        df = self.tables[name]
        if self._sizes.get(name, (None, 0))[0] is not df:
            self._sizes[name] = (df, df.count())
        return self._sizes[name][1]

    def _check(self, name: str) -> None:
        if self.allowed is not None and name not in self.allowed:
            raise ModelError(f"table {name} is not among the allowed ones")

    def add(self, name: str, df: DataFrame, order: list[str] | None = None) -> Knowledge:
        """Registers a table. ``order``: columns that give the order of its rows; else all its columns do."""
        self._check(name)
        by = [F.col(f"`{c}`") for c in (order or df.columns)]
        # a position within the order needs no global window: comparing the ordering columns themselves is enough
        self.tables[name] = df.withColumn(ROW, F.struct(*[c.alias(f"o{i}") for i, c in enumerate(by)]))
        return self

    def load_csv(self, name: str, path: str, columns: Mapping[str, str] | None = None, schema: Mapping[str, str] | None = None, header: bool = True, delimiter: str = ",", trim: bool = True, expected: tuple[int | None, int | None] = (None, None), on_error: str = "skip") -> Knowledge:
        """Loads a CSV file (UTF-8). ``columns``: target -> source column name or SQL expression over the source columns.

        ``schema``: target -> type. ``expected``: least and most rows; too few is an error, too many a warning.
        ``on_error``: ``skip`` leaves malformed rows out, ``fail`` raises.
        """
        self._check(name)
        reader = self.spark.read.option("header", header).option("sep", delimiter).option("encoding", "UTF-8").option("mode", "DROPMALFORMED" if on_error == "skip" else "FAILFAST")
        if trim:
            reader = reader.option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
        raw = reader.csv(path)
        raw = raw.withColumn(ROW, F.struct(F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i")))
        register_sql_functions(self.spark)
        made = raw.select(*[_load_expression(e).alias(t) for t, e in (columns or {c: f"`{c}`" for c in raw.columns if c != ROW}).items()], ROW)
        for c, kind in (schema or {}).items():
            made = made.withColumn(c, F.col(c).try_cast(kind))
        n = made.count() if expected != (None, None) else None
        if n is not None and expected[0] is not None and n < expected[0]:
            raise ModelError(f"table {name} has {n} rows, at least {expected[0]} are expected")
        if n is not None and expected[1] is not None and n > expected[1]:
            import warnings

            warnings.warn(f"table {name} has {n} rows, at most {expected[1]} are expected", stacklevel=2)
        self.tables[name] = made
        return self

    def query(self, sql: str) -> DataFrame:
        """Any SQL over the tables, as views of their names."""
        for name, df in self.tables.items():
            df.drop(ROW).createOrReplaceTempView(name)
        register_sql_functions(self.spark)
        return self.spark.sql(sql)

    def values(self, name: str, column: str = "value") -> list:
        """One column of a (small) table as a list, in order of loading."""
        return [r[0] for r in self.tables[name].orderBy(ROW).select(column).collect()]


def _load_expression(text: str) -> Column:
    """A column name or nested calls of the SQL functions, as in ``ip4_int(trim_quotes(start_ip))``."""
    text = text.strip()
    head, _, rest = text.partition("(")
    if rest and head in SQL_FUNCTIONS:
        return SQL_FUNCTIONS[head](*[_load_expression(a) for a in _split(rest[:-1])])
    return F.expr(text)


def _split(text: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(text[start:i])
            start = i + 1
    return [*out, text[start:]]


def register_sql_functions(spark: SparkSession) -> None:
    """The address functions for ``spark.sql``, as temporary SQL functions where the session has none of the name."""
    octet = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    v4 = f"^{octet}([.]{octet}){{3}}$"
    part = lambda i: f"cast(split_part(trim(x), '.', {i}) as bigint)"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION ip4_int(x STRING) RETURNS BIGINT RETURN CASE WHEN trim(x) RLIKE '{v4}' THEN {part(1)} * 16777216 + {part(2)} * 65536 + {part(3)} * 256 + {part(4)} WHEN x IS NOT NULL THEN 0L END")
    spark.sql(r"""CREATE OR REPLACE TEMPORARY FUNCTION trim_quotes(x STRING) RETURNS STRING RETURN regexp_replace(trim(x), '^(?s)(?:"(.*)"|\'(.*)\')$', '$1$2')""")


def _names(e) -> list[Get]:
    if isinstance(e, Get):
        return [e]
    if isinstance(e, tuple):
        return [g for x in e for g in _names(x)]
    return []


def lookup(df: DataFrame, q: Select, knowledge: Knowledge, bind: Callable[[Get], Value | None], tag: str, other: Callable[[object], Value | None]) -> tuple[DataFrame, list[Value]]:
    """Joins the first matching row; the frame and the looked-up values, null where nothing matches."""
    if q.table not in knowledge.tables:
        raise ModelError(f"unknown table {q.table}")
    table = knowledge.tables[q.table]
    columns = [c for c in table.columns if c != ROW] if q.columns == ("*",) else list(q.columns)
    lost = [c for c in columns if c not in table.columns]
    if lost:
        raise ModelError(f"table {q.table} has no column {lost[0]}")
    gets = _names(q.where)
    if len(gets) > MOST_VALUES:
        raise ModelError(f"a lookup binds {MOST_VALUES} values at most")
    bound: list[Column] = []
    place: dict[int, int] = {}
    for g in gets:
        same = next((place[id(o)] for o in gets if id(o) in place and o == g and g.verb == "read"), None)
        if same is not None:  # one value read twice, as for the two ends of a range
            place[id(g)] = same
            continue
        v = bind(g)
        place[id(g)] = len(bound)
        bound.append((v.column if v is not None else F.lit(None).cast("string")).alias(f"{tag}_p{len(bound)}"))
    df = df.select("*", *bound)
    keys = [f"{tag}_p{i}" for i in range(len(bound))]
    right = table.select(*[F.col(f"`{c}`").alias(f"{tag}_t_{c}") for c in table.columns])
    result = F.struct(*[F.col(f"{tag}_t_{c}").alias(f"c{i}") for i, c in enumerate(columns)])
    values = [Value(F.col(f"{tag}_r.c{i}"), kind_of(table.schema[c].dataType)) for i, c in enumerate(columns)]

    def side(e, column=lambda c: F.col(f"{tag}_t_{c}")) -> tuple[Column, bool]:
        """A Spark expression and whether it reads the table; ``column`` gives the table's columns."""
        if isinstance(e, Get):
            return F.col(keys[place[id(e)]]), False
        if isinstance(e, Const):
            return (F.lit(int(e.text)) if e.kind == "digit" else F.lit(float(e.text)) if e.kind == "float" else F.lit(e.text)), False
        if isinstance(e, Now):
            return other(e).column, False
        if e[0] == "column":
            if e[1] not in table.columns:
                raise ModelError(f"table {q.table} has no column {e[1]}")
            return column(e[1]), True
        args = [side(a, column) for a in e[2]]
        if e[1] not in SQL_FUNCTIONS:
            raise ModelError(f"unknown SQL function {e[1]}")
        return SQL_FUNCTIONS[e[1]](*[a for a, _ in args]), any(t for _, t in args)

    ops = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}

    def whole(e, *column) -> Column:
        if e[0] == "and":
            return whole(e[1], *column) & whole(e[2], *column)
        if e[0] == "or":
            return whole(e[1], *column) | whole(e[2], *column)
        if e[0] == "not":
            return ~whole(e[1], *column)
        return F.coalesce(ops[e[1]](side(e[2], *column)[0], side(e[3], *column)[0]), F.lit(False))

    condition = whole(q.where)
    if not keys:
        # nothing depends on the rows: one row of the table, as constants
        first = right.where(condition).agg(F.min_by(result, F.col(f"{tag}_t_{ROW}")).alias("r")).first()["r"]
        return df, [Value(F.lit(first[i] if first is not None else None).cast(table.schema[c].dataType), v.kind) for i, (c, v) in enumerate(zip(columns, values, strict=True))]
    small = knowledge.size(q.table) <= GATHERED
    ways = [_way(atoms, side) for atoms in _alternatives(q.where)]
    if len(ways) == 1 and isinstance(ways[0], _Equal) and ways[0].alone and all(isinstance(t, tuple) and t[0] == "column" for t in ways[0].read):
        # equalities alone: the first row of each key of the table, met in one pass over the events
        named = [f"{tag}_t_{t[1]}" for t in ways[0].read]
        first = right.groupBy(*named).agg(F.min_by(result, F.col(f"{tag}_t_{ROW}")).alias(f"{tag}_r"))
        same = reduce(lambda a, b: a & b, [v == F.col(c) for c, v in zip(named, ways[0].values, strict=True)])
        return df.join(F.broadcast(first) if small else first, same, "left").drop(*named, *keys), values
    ordered = not any(isinstance(f.dataType, T.MapType) for f in right.schema)
    if small and ordered and not any(w is None for w in ways):
        row = F.struct(F.col(f"{tag}_t_{ROW}").alias("r"), *[F.col(f"{tag}_t_{c}").alias(f"c_{c}") for c in table.columns if c != ROW])
        lists = []
        for i, way in enumerate(ways):
            for j, (gathered, same, extra) in enumerate(way.gather(right, row, f"{tag}_g{i}")):
                name = f"{tag}_list{i}_{j}"
                df = df.join(F.broadcast(gathered.withColumnRenamed("rows", name)), same, "left").drop(*extra)
                lists.append(name)
        candidates = F.concat(*[F.coalesce(c, F.array().cast(df.schema[c].dataType)) for c in lists])
        found = F.array_min(F.filter(candidates, lambda x: whole(q.where, lambda c: x[f"c_{c}"])))
        df = df.withColumn(f"{tag}_r", F.transform(F.array(found), lambda x: F.when(x.isNotNull(), F.struct(*[x[f"c_{c}"].alias(f"c{i}") for i, c in enumerate(columns)])))[0])
        return df.drop(*lists, *keys), values
    distinct = df.select(*keys).distinct()
    found = reduce(DataFrame.unionByName, [distinct.join(right, condition, "inner") if way is None else way.meet(distinct, right, condition, f"{tag}_b{i}") for i, way in enumerate(ways)])
    best = found.groupBy(*keys).agg(F.min_by(result, F.col(f"{tag}_t_{ROW}")).alias(f"{tag}_r"))
    best = best.select(*[F.col(k).alias(f"{k}_") for k in keys], f"{tag}_r")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys])
    return df.join(best, same, "left").drop(*[f"{k}_" for k in keys], *keys), values


def _alternatives(e) -> list[list]:
    """The condition as alternatives of parts that all hold; the condition itself as one part where there are too many."""

    def apart(e) -> list[list]:
        if e[0] == "or":
            return apart(e[1]) + apart(e[2])
        if e[0] == "and":
            return [a + b for a in apart(e[1]) for b in apart(e[2])]
        return [[e]]

    def count(e) -> int:
        return count(e[1]) + count(e[2]) if e[0] == "or" else count(e[1]) * count(e[2]) if e[0] == "and" else 1

    return apart(e) if count(e) <= ALTERNATIVES else [[e]]


def _way(atoms: list, side) -> _Equal | _Range | None:
    """How one alternative finds candidates by a key; None where it has neither an equality nor a pair of range ends."""
    equal, low, high = [], {}, {}
    for e in atoms:
        if e[0] != "cmp":
            continue
        (a, ta), (b, tb) = side(e[2]), side(e[3])
        if ta == tb:
            continue
        t, v, own, op = (a, b, e[2], e[1]) if ta else (b, a, e[3], {"<": ">", "<=": ">=", ">": "<", ">=": "<="}.get(e[1], e[1]))
        if op == "=":
            equal.append((t, v, own))
        elif op in ("<", "<="):
            low.setdefault(str(v), (t, v))
        elif op in (">", ">="):
            high.setdefault(str(v), (t, v))
    if equal:
        t, v, own = zip(*equal, strict=True)
        return _Equal(list(t), list(v), list(own), len(equal) == len(atoms))
    both = next((k for k in low if k in high), None)
    return None if both is None else _Range(low[both][0], high[both][0], low[both][1])


@dataclass
class _Equal:
    """Candidates by equal values."""

    table: list[Column]
    values: list[Column]
    read: list
    alone: bool

    def gather(self, right: DataFrame, row: Column, tag: str) -> list[tuple[DataFrame, Column, list[str]]]:
        names = [f"{tag}_{i}" for i in range(len(self.table))]
        rows = right.groupBy(*[t.alias(n) for t, n in zip(self.table, names, strict=True)]).agg(F.collect_list(row).alias("rows"))
        return [(rows, reduce(lambda a, b: a & b, [v == F.col(n) for v, n in zip(self.values, names, strict=True)]), names)]

    def meet(self, left: DataFrame, right: DataFrame, condition: Column, tag: str) -> DataFrame:
        same = reduce(lambda a, b: a & b, [v == t for v, t in zip(self.values, self.table, strict=True)])
        return left.join(right, same & condition, "inner")


@dataclass
class _Range:
    """Candidates by the buckets of a value between two ends.

    A range lies in at most two buckets of the least power of 16 that is not less than its width. So a table has as many
    sizes of buckets as its ranges have orders of magnitude (16 for 64-bit numbers), and a value one bucket of each.
    """

    low: Column
    high: Column
    value: Column

    def _leveled(self, right: DataFrame, tag: str) -> DataFrame:
        width = (self.high - self.low).cast("double") + 1
        level = F.greatest(F.lit(0), F.ceil(F.log2(width) / 4)).cast("int")
        rows = right.where(self.low <= self.high).withColumn(f"{tag}_level", level)
        size = F.pow(F.lit(16.0), F.col(f"{tag}_level"))
        first, last = F.floor(self.low / size), F.floor(self.high / size)
        return rows.withColumn(f"{tag}_bucket", F.explode(F.array_distinct(F.array(first, last))))

    def _levels(self, rows: DataFrame, tag: str) -> list[int]:
        return sorted(r[0] for r in rows.select(f"{tag}_level").distinct().collect())

    def gather(self, right: DataFrame, row: Column, tag: str) -> list[tuple[DataFrame, Column, list[str]]]:
        rows = self._leveled(right, tag)
        out = []
        for n in self._levels(rows, tag):
            bucket = f"{tag}_bucket{n}"
            own = rows.where(F.col(f"{tag}_level") == n).groupBy(F.col(f"{tag}_bucket").alias(bucket)).agg(F.collect_list(row).alias("rows"))
            out.append((own, F.floor(self.value / F.lit(16.0**n)) == F.col(bucket), [bucket]))
        # a table without a sound range: no candidates, by a key that no value has
        return out or [(rows.groupBy(F.col(f"{tag}_bucket").alias(f"{tag}_none")).agg(F.collect_list(row).alias("rows")), F.floor(self.value / F.lit(1.0)) == F.col(f"{tag}_none"), [f"{tag}_none"])]

    def meet(self, left: DataFrame, right: DataFrame, condition: Column, tag: str) -> DataFrame:
        rows = self._leveled(right, tag)
        levels = self._levels(rows, tag)
        place = F.array(*[F.struct(F.lit(n).alias("n"), F.floor(self.value / F.lit(16.0**n)).alias("at")) for n in levels]) if levels else F.array().cast("array<struct<n:int,at:bigint>>")
        placed = left.withColumn(f"{tag}_p", F.explode(place))
        same = (F.col(f"{tag}_p.n") == F.col(f"{tag}_level")) & (F.col(f"{tag}_p.at") == F.col(f"{tag}_bucket"))
        return placed.join(rows, same & condition, "inner").drop(f"{tag}_p", f"{tag}_level", f"{tag}_bucket")


def first_row(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, by the order columns."""
    own = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(own)).where("_n = 1").drop("_n")
