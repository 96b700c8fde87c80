"""One SQL text, two engines: the few places in which Spark SQL and the checking engine (DuckDB) name things differently."""

from __future__ import annotations


class Spark:
    name = "spark"
    #: Regex flags for "^ and $ at every newline only".
    multiline = "(?md)"

    @staticmethod
    def lit(s: str) -> str:
        """A string literal without escapes."""
        return f'r"{s}"' if "'" in s else f"r'{s}'"

    def match(self, x: str, p: str) -> str:
        return f"(({x}) rlike {self.lit(p)})"

    def extract(self, x: str, p: str, g: int = 1) -> str:
        return f"regexp_extract({x}, {self.lit(p)}, {g})"

    def extract_all(self, x: str, p: str, g: int = 1) -> str:
        return f"regexp_extract_all({x}, {self.lit(p)}, {g})"

    def sub(self, x: str, p: str, r: str) -> str:
        return f"regexp_replace({x}, {self.lit(p)}, {self.lit(r)})"

    def split(self, x: str, p: str) -> str:
        return f"split({x}, {self.lit(p)})"

    def sha(self, x: str) -> str:
        return f"sha2({x}, 256)"

    def octets(self, x: str) -> str:
        return f"octet_length({x})"

    def filter(self, a: str, v: str, cond: str) -> str:
        return f"filter({a}, {v} -> {cond})"

    def each(self, a: str, v: str, e: str) -> str:
        return f"transform({a}, {v} -> {e})"

    def array(self, *x: str) -> str:
        return f"array({', '.join(x)})"

    def size(self, a: str) -> str:
        return f"size({a})"

    def slice(self, a: str, n: int | str) -> str:
        return f"slice({a}, 1, {n})"

    def cut(self, a: str, first: str, last: str) -> str:
        """Elements first..last, counted from 1; first >= 1."""
        return f"slice({a}, cast({first} as int), cast(greatest({last} - ({first}) + 1, 0) as int))"

    def distinct(self, a: str) -> str:
        return f"array_distinct({a})"

    def concat(self, *a: str) -> str:
        return f"concat({', '.join(a)})"

    def at(self, a: str, i: str) -> str:
        """Element i from 1, null outside."""
        return f"get({a}, {i} - 1)"

    def has(self, a: str, x: str) -> str:
        return f"array_contains({a}, {x})"

    def join(self, a: str, s: str) -> str:
        return f"array_join({a}, '{s}')"

    def sort(self, a: str) -> str:
        return f"array_sort({a})"

    def collect(self, x: str, order: str) -> str:
        """Values of x in the order of the expression ``order``."""
        return f"transform(array_sort(collect_list(struct({order} as o, {x} as v))), z -> z.v)"

    def collect_set(self, x: str) -> str:
        return f"array_sort(collect_set({x}))"

    def explode(self, a: str) -> str:
        return f"explode({a})"

    def text(self, x: str) -> str:
        return f"cast({x} as string)"

    def div(self, a: str, b: str) -> str:
        return f"(({a}) div ({b}))"

    def half_even(self, x: str, n: int = 0) -> str:
        return f"bround({x}, {n})"

    def sequence(self, a: str, b: str) -> str:
        """a..b, empty if b < a."""
        return f"(case when {b} < {a} then cast(array() as array<bigint>) else sequence(cast({a} as bigint), cast({b} as bigint)) end)"

    def no_texts(self) -> str:
        return "cast(array() as array<string>)"

    def seconds(self, x: str) -> str:
        return f"unix_timestamp({x})"

    # Many corpora at once: where each row says whose it is (``ByRepo``), these carry that key; here there is one corpus, and no key.

    def key(self, alias: str = "") -> str:
        """The key as the first of selected columns."""
        return ""

    def group(self, *more: str) -> str:
        """A grouping by the key and ``more``."""
        return f" group by {', '.join(more)}" if more else ""

    def same(self, a: str, b: str) -> str:
        """One more condition of a join: the keys are the same."""
        return ""

    def paired(self, a: str, b: str) -> str:
        """A join of two relations that have one row for each key."""
        return f"cross join {b}"

    def over(self, *more: str) -> str:
        """The partition of a window."""
        return f"partition by {', '.join(more)} " if more else ""

    def over_of(self, alias: str) -> str:
        """The partition of a window over a join of which ``alias`` is one side."""
        return ""

    def mine(self) -> str:
        """In a scalar subquery over rows whose key is called r (``as_r``): those of the row outside."""
        return ""

    def as_r(self) -> str:
        return ""

    def value(self, column: str, source: str, where: str = "") -> str:
        """A value of the only row (of the key) that there is."""
        return f"(select {column} from {source}{' where ' * bool(where)}{where})"

    def count(self, source: str, where: str = "") -> str:
        return f"(select count(*) from {source}{' where ' * bool(where)}{where})"

    def exists(self, source: str, where: str) -> str:
        return f"exists (select 1 from {source} where {where})"

    def on(self, a: str, b: str, *columns: str) -> str:
        """A join by columns."""
        return "on " + " and ".join(f"{a}.{c} = {b}.{c}" for c in columns)

    def keys(self) -> str:
        """What a row for each key, and nothing else, is selected from."""
        return ""

    def for_each_key(self, rows: str) -> str:
        """A few fixed rows, for each key."""
        return rows

    def first(self, columns: str, rest: str, order: str, n: int) -> str:
        """The first n rows (of each key)."""
        return f"select {columns} {rest} order by {order} limit {n}"


class ByRepo(Spark):
    """Spark SQL over many repositories: the relations of ``plans`` with a column ``repo`` first."""

    def key(self, alias: str = "") -> str:
        return f"{alias}.repo, " if alias else "repo, "

    def group(self, *more: str) -> str:
        return f" group by {', '.join(('repo', *more))}"

    def same(self, a: str, b: str) -> str:
        return f" and {a}.repo = {b}.repo"

    def paired(self, a: str, b: str) -> str:
        return f"left join {b} using (repo)"

    def over(self, *more: str) -> str:
        return f"partition by {', '.join(('repo', *more))} "

    def over_of(self, alias: str) -> str:
        return f"partition by {alias}.repo "

    def mine(self) -> str:
        return " and r = repo"

    def as_r(self) -> str:
        return "repo as r, "

    def value(self, column: str, source: str, where: str = "") -> str:
        return f"(select max(v) from (select repo as r, {column} as v from {source}{' where ' * bool(where)}{where}) q where r = repo)"

    def count(self, source: str, where: str = "") -> str:
        return f"(select count(*) from (select repo as r from {source}{' where ' * bool(where)}{where}) q where r = repo)"

    def exists(self, source: str, where: str) -> str:
        return f"{self.count(source, where)} > 0"

    def on(self, a: str, b: str, *columns: str) -> str:
        return f"using ({', '.join(('repo', *columns))})"

    def keys(self) -> str:
        return " from (select distinct repo from files) repos"

    def for_each_key(self, rows: str) -> str:
        return f"select * from (select distinct repo from files) repos cross join ({rows}) fixed"

    def first(self, columns: str, rest: str, order: str, n: int) -> str:
        return f"select {'* except (nth)' if columns == '*' else 'repo, ' + columns} from (select *, row_number() over (partition by repo order by {order}) as nth {rest}) nths where nth <= {n}"


class Duck(Spark):
    name = "duckdb"
    multiline = "(?m)"

    @staticmethod
    def lit(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def match(self, x: str, p: str) -> str:
        return f"regexp_matches({x}, {self.lit(p)})"

    def extract_all(self, x: str, p: str, g: int = 1) -> str:
        return f"regexp_extract_all({x}, {self.lit(p)}, {g})"

    def sub(self, x: str, p: str, r: str) -> str:
        return f"regexp_replace({x}, {self.lit(p)}, {self.lit(r.replace('$', chr(92)))}, 'g')"

    def split(self, x: str, p: str) -> str:
        return f"string_split_regex({x}, {self.lit(p)})"

    def sha(self, x: str) -> str:
        return f"sha256({x})"

    def octets(self, x: str) -> str:
        return f"strlen({x})"

    def filter(self, a: str, v: str, cond: str) -> str:
        return f"list_filter({a}, lambda {v}: {cond})"

    def each(self, a: str, v: str, e: str) -> str:
        return f"list_transform({a}, lambda {v}: {e})"

    def array(self, *x: str) -> str:
        return f"[{', '.join(x)}]"

    def size(self, a: str) -> str:
        return f"len({a})"

    def slice(self, a: str, n: int | str) -> str:
        return f"({a})[1:{n}]"

    def cut(self, a: str, first: str, last: str) -> str:
        return f"({a})[{first}:{last}]"

    def distinct(self, a: str) -> str:
        return f"list_filter({a}, lambda dx, di: list_position({a}, dx) = di)"

    def concat(self, *a: str) -> str:
        out = a[0]
        for x in a[1:]:
            out = f"list_concat({out}, {x})"
        return out

    def at(self, a: str, i: str) -> str:
        return f"({a})[{i}]"

    def has(self, a: str, x: str) -> str:
        return f"list_contains({a}, {x})"

    def join(self, a: str, s: str) -> str:
        return f"array_to_string({a}, '{s}')"

    def sort(self, a: str) -> str:
        return f"list_sort({a})"

    def collect(self, x: str, order: str) -> str:
        return f"list({x} order by {order})"

    def collect_set(self, x: str) -> str:
        return f"list_sort(list(distinct {x}))"

    def explode(self, a: str) -> str:
        return f"unnest({a})"

    def text(self, x: str) -> str:
        return f"cast({x} as varchar)"

    def div(self, a: str, b: str) -> str:
        return f"(({a}) // ({b}))"

    def half_even(self, x: str, n: int = 0) -> str:
        return f"round_even({x}, {n})"

    def sequence(self, a: str, b: str) -> str:
        return f"range(cast({a} as bigint), cast({b} as bigint) + 1)"

    def no_texts(self) -> str:
        return "cast([] as varchar[])"

    def seconds(self, x: str) -> str:
        return f"cast(epoch({x}) as bigint)"


SPARK, DUCK, BY_REPO = Spark(), Duck(), ByRepo()
