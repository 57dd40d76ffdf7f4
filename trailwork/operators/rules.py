"""Boolean rules over requests, given as a table: thousands of rules cost no more plan than one.

A rule's tests are literals of a field, equal or contained, compared without ASCII case. All literals are looked for at
once, in the distinct values of the fields that rules ask about: equal ones by a dictionary, contained ones by an
Aho-Corasick automaton. A request is then only the set of literals it holds, and few such sets are different. For each
different set, joins count which tests, selections and clauses it fulfils.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailwork.functions import web as W
from trailwork.functions.tables import MOST_BYTES, small, written

SCHEMA = "rule_id string, level string, category string, product string, service string, selections array<struct<name:string,field:string,contains:boolean,all:boolean,values:array<string>>>, condition array<array<struct<name:string,negated:boolean>>>"
#: The field of a keyword test, which looks at all of a request.
KEYWORDS = "keywords"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rules_table(spark: SparkSession, rules: list[dict]) -> DataFrame:
    """A table from rules written out: selections of fields and keywords, a condition of clauses of (selection, negated)."""
    rows = []
    for r in rules:
        tests = []
        for s in r["selections"]:
            tests += [(s["name"], f["field"], bool(f.get("contains")), bool(f.get("all")), f["values"]) for f in s.get("fields", [])]
            tests += [(s["name"], KEYWORDS, True, False, s["keywords"])] if s.get("keywords") else []
        source = r.get("logsource") or {}
        rows.append((r["rule_id"], r.get("level", "unknown"), *[source.get(k) for k in ("category", "product", "service")], tests, [list(map(tuple, c)) for c in r["condition"]]))
    return spark.createDataFrame(rows, SCHEMA)


def lowered(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def source_allows(source: Column) -> Column:
    """Whether a request of a log source is one that the rule (columns category, product, service) is for; empty parts ask nothing.

    Every category but webserver holds for none. A service counts for the AWS sources only.
    """
    category, product, service = (lowered(F.col(c)) for c in ("category", "product", "service"))
    made_by = lambda *names: product.isNull() | product.isin(*names)
    aws = made_by("aws") & source.startswith("aws-") & (service.isNull() | (source == F.concat(F.lit("aws-"), service)))
    web = aws | (made_by("nginx") & source.startswith("nginx")) | (made_by("apache", "apache_httpd") & source.startswith("apache"))
    unasked = category.isNull() & product.isNull() & service.isNull()
    return unasked | (F.coalesce(category == "webserver", F.lit(True)) & F.coalesce(web, F.lit(False)))


def rule_tests(rules: DataFrame, columns: list[str]) -> DataFrame:
    """(rule_id, test, name, field, contains, all, literal) of every literal; field is the column behind a name, NULL where there is none."""
    known = {k: v for k, v in W.FIELD_ALIASES.items() if v in columns} | {KEYWORDS: KEYWORDS}
    column = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])[F.lower("s.field")]
    tests = rules.select("rule_id", F.posexplode("selections").alias("test", "s"))
    literal = F.explode(F.array_distinct(F.transform("s.values", lowered)))
    return tests.select("rule_id", "test", "s.name", column.alias("field"), F.coalesce("s.contains", F.lit(False)).alias("contains"), F.coalesce("s.all", F.lit(False)).alias("all"), literal.alias("literal")).filter("literal is not null")


class Finder:
    """Literals of several fields: which of them a value equals or contains."""

    def __init__(self, literals: list[tuple[str, bool, str, int]]):
        import ahocorasick

        self.equal: dict[tuple[str, str], list[int]] = {}
        self.inside, self.always = {}, {}
        for field, contains, literal, i in literals:
            if not contains:
                self.equal.setdefault((field, literal), []).append(i)
            elif not literal:  # an empty text is in every value
                self.always.setdefault(field, []).append(i)
            else:
                self.inside.setdefault(field, ahocorasick.Automaton()).add_word(literal, i)
        for automaton in self.inside.values():
            automaton.make_automaton()

    def find(self, field: str, value: str | None) -> list[int]:
        if value is None:
            return []
        found = set(self.equal.get((field, value), ())) | set(self.always.get(field, ()))
        if field in self.inside:
            found.update(i for _, i in self.inside[field].iter(value))
        return sorted(found)


def _groups(literals: DataFrame, most: int = MOST_BYTES) -> list[list[tuple[str, bool, str, int]]]:
    """The literals in groups of at most about so many bytes each; one group unless there are very many."""
    total = literals.agg(F.sum(F.octet_length("literal") + 64).alias("n")).first().n or 0
    k = 1 + total // most
    group = lambda i: literals.filter(F.pmod(F.xxhash64("literal"), F.lit(k)) == i).select("field", "contains", "literal", "id").collect()
    return [[tuple(r) for r in group(i)] for i in range(k)]


def _held_rules(sets: DataFrame, rules: DataFrame, tests: DataFrame) -> DataFrame:
    """(held, source, rule_id) of every rule that a set of literals fulfils, whatever its log source."""
    of = ["held", "source", "rule_id"]
    wanted = tests.groupBy("rule_id", "test", "name").agg(F.first("all").alias("all"), F.count("*").alias("literals"))
    size = rules.select("rule_id", F.explode("selections").alias("s")).groupBy("rule_id", F.col("s.name").alias("name")).agg(F.count("*").alias("tests"))
    found = sets.select("held", "source", F.explode("held").alias("id")).join(small(tests.filter("id is not null").select("id", "rule_id", "test")), "id")
    met = found.groupBy(*of, "test").agg(F.count("*").alias("n")).join(small(wanted), ["rule_id", "test"]).filter("not `all` or n = literals")
    selections = met.groupBy(*of, "name").agg(F.count("*").alias("n")).join(small(size), ["rule_id", "name"]).filter("n = tests").select(*of, "name")
    terms = rules.select("rule_id", F.posexplode("condition").alias("clause", "c")).select("rule_id", "clause", F.explode(F.array_distinct("c")).alias("t")).select("rule_id", "clause", "t.name", "t.negated")
    positive = terms.groupBy("rule_id", "clause").agg(F.count_if(~F.col("negated")).alias("wanted"))
    told = selections.join(small(terms), ["rule_id", "name"]).groupBy(*of, "clause").agg(F.count_if(~F.col("negated")).alias("have"), F.count_if(F.col("negated")).alias("against"))
    judged = told.join(small(positive), ["rule_id", "clause"])
    out = judged.filter("against = 0 and have = wanted and wanted > 0").select(*of)
    only_not = positive.filter("wanted = 0").select("rule_id", "clause")
    if not only_not.isEmpty():
        # Clauses that only exclude hold for every set that nothing speaks against; the rows are the result itself.
        against = told.filter("against > 0").select(*of, "clause")
        out = out.unionByName(sets.crossJoin(small(only_not)).join(against, [*of, "clause"], "left_anti").select(*of))
    return out.distinct()


def _keyword_literals(shared: Broadcast) -> Callable[[Column], Column]:
    @F.arrow_udf("array<long>")
    def keywords(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        finder = Finder(shared.value)
        for texts in batches:
            yield pa.array([finder.find(KEYWORDS, v) for v in texts.to_pylist()], pa.list_(pa.int64()))

    return keywords.asNondeterministic()


def match_rules(events: DataFrame, rules: DataFrame) -> DataFrame:
    """One row for each (event, rule) with rule_id and level. rules: see ``SCHEMA``.

    All tests of a selection have to hold; of a test's values one, or all. A clause is an AND of selections and negated
    selections, the condition an OR of clauses. A missing field, an unknown one and a test without values never hold, their
    negation does. Where the events tell their log source, a rule that names one is tried on its requests only. What is
    collected are the literals, in groups of bounded size.
    """
    tests = rule_tests(rules, events.columns)
    literals = written(tests.filter("field is not null").select("field", "contains", "literal").distinct().withColumn("id", F.monotonically_increasing_id()), "rule-literals")
    tests = tests.join(literals, ["field", "contains", "literal"], "left")
    fields = [r.field for r in literals.select("field").distinct().collect()]  # at most the events' columns
    keys = {f: lowered(F.col(f).cast("string")) for f in fields if f != KEYWORDS}
    spark, groups = events.sparkSession, _groups(literals)
    given = F.array_compact(F.array(*[F.when(v.isNotNull(), F.struct(F.lit(f).alias("field"), v.alias("value"))) for f, v in keys.items()]))
    hits: DataFrame | None = None
    held: list[Column] = []
    for group in groups:
        shared = spark.sparkContext.broadcast(group)

        def look(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            finder = Finder(shared.value)
            for b in batches:
                found = [finder.find(f, v) for f, v in zip(b.column("field").to_pylist(), b.column("value").to_pylist(), strict=True)]
                made = pa.RecordBatch.from_arrays([b.column("field"), b.column("value"), pa.array(found, pa.list_(pa.int64()))], names=["field", "value", "ids"])
                yield made.filter(pa.array([bool(x) for x in found], pa.bool_()))

        if keys:
            values = events.select(F.explode(given).alias("x")).select("x.field", "x.value").distinct()
            part = values.mapInArrow(look, "field string, value string, ids array<long>")
            hits = part if hits is None else hits.unionByName(part)
        if KEYWORDS in fields:
            held.append(_keyword_literals(shared)(lowered(W.keyword_text(events.columns))))
    source = F.coalesce("log_source", F.lit("")) if "log_source" in events.columns else F.lit("")
    rows = events.select(F.struct("*").alias("row"), source.alias("source"), *[k.alias(f"held_{i}") for i, k in enumerate(held)], *[v.alias(f"key_{f}") for f, v in keys.items()])
    if hits is not None:
        once = written(hits.groupBy("field", "value").agg(F.flatten(F.collect_list("ids")).alias("ids")), "rule-hits")
        for f in keys:
            rows = rows.join(small(once.filter(F.col("field") == f).select(F.col("value").alias(f"key_{f}"), F.col("ids").alias(f"ids_{f}"))), f"key_{f}", "left")
    none = F.array().cast("array<long>")
    parts = [F.coalesce(f"ids_{f}", none) for f in keys] + [F.coalesce(f"held_{i}", none) for i in range(len(held))]
    rows = rows.select("row", "source", F.array_sort(F.concat(*parts)).alias("held") if parts else none.alias("held"))
    sets = rows.select("held", "source").distinct()
    gated = source_allows(F.col("source")) if "log_source" in events.columns else F.lit(True)
    meta = rules.select("rule_id", "level", "category", "product", "service")
    matched = _held_rules(sets, rules, tests).join(small(meta), "rule_id").filter(gated).groupBy("held", "source").agg(F.collect_list(F.struct("rule_id", "level")).alias("rules"))
    found = rows.join(small(written(matched, "rule-sets")), ["held", "source"]).select("row", F.explode("rules").alias("rule"))
    return found.select("row.*", "rule.rule_id", F.coalesce("rule.level", F.lit("unknown")).alias("level"))
