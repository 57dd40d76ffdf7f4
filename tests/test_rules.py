"""Rules as a table against a plain reading of them."""

import random

from pyspark.sql import functions as F

from trailwork.functions import web as W
from trailwork.operators import matching as M
from trailwork.operators import rules as R

COLUMNS = "event_id long, method string, host string, uri_path string, uri_query string, status int, user_agent string, log_source string"


def low(text):
    return "".join(c.lower() if c.isascii() else c for c in text)


def holds(event, rule):
    def test(t):
        name = W.FIELD_ALIASES.get(t["field"].lower())
        value = event.get(name) if name in event else None
        if value is None or not t["values"]:
            return False
        value = low(str(value))
        found = [low(v) in value if t.get("contains") else low(v) == value for v in t["values"]]
        return all(found) if t.get("all") else any(found)

    def selection(s):
        text = low("\n".join(str(event[c]) for c in ("method", "host", "uri") if event.get(c) is not None))
        return all(test(t) for t in s.get("fields", [])) and (not s.get("keywords") or any(low(k) in text for k in s["keywords"]))

    made = {s["name"]: selection(s) for s in rule["selections"]}
    return any(all(made.get(n, False) != negated for n, negated in clause) for clause in rule["condition"])


def some_rules(rng, n):
    fields = {"cs-method": ["get", "POST", "Head"], "uri_path": ["/A", "/a/b", "/É", "b", ""], "cs-uri-query": ["x=1", "X", "=1&"], "sc-status": ["200", "40"], "c-useragent": ["curl", "Bot/1"], "nothing": ["x"]}
    out = []
    for i in range(n):
        selections = []
        for name in "pqr"[: rng.randrange(1, 4)]:
            tests = [{"field": f, "contains": rng.random() < 0.6, "all": rng.random() < 0.3, "values": rng.sample(fields[f], rng.randrange(0 if rng.random() < 0.1 else 1, len(fields[f]) + 1))} for f in rng.sample(list(fields), rng.randrange(1, 3))]
            selections.append({"name": name, "fields": tests} | ({"keywords": rng.sample(["GET", "shop", "zz"], 2)} if rng.random() < 0.3 else {}))
        names = [s["name"] for s in selections] + ["missing"] * (rng.random() < 0.1)
        clauses = [[(n, rng.random() < 0.4) for n in rng.sample(names, rng.randrange(1, len(names) + 1))] for _ in range(rng.randrange(1, 3))]
        out.append({"rule_id": f"r{i}", "level": rng.choice(["low", "high"]), "selections": selections, "condition": clauses})
    return out


def test_rules_equal_a_plain_reading(spark):
    rng = random.Random(5)
    pick = lambda *xs: rng.choice(xs)
    rows = [(i, pick("GET", "POST", "head", None), pick("shop.example", "x", None), pick("/a", "/A/B", "/é", "/É/b", None), pick("x=1&y", "X=1", None), pick(200, 404, None), pick("Curl/8", "bot/1", None), "nginx-combined") for i in range(80)]
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    rules = some_rules(rng, 60)
    events = spark.createDataFrame(rows, COLUMNS)
    got = {(r.event_id, r.rule_id, r.level) for r in M.match_rules(events, rules).collect()}
    want = {(e[0], r["rule_id"], r["level"]) for e in rows for r in rules if holds(dict(zip(names, e, strict=True)), r)}
    assert got == want and len(want) > 300
    assert M.match_rules(events.limit(0), rules).count() == 0 and M.match_rules(events, rules[:0] or R.rules_table(spark, rules).limit(0)).count() == 0


def test_ten_thousand_rules_cost_no_more_plan(spark, monkeypatch):
    made = spark.range(10_000).select(
        F.concat(F.lit("r"), "id").alias("rule_id"), F.lit("low").alias("level"), *[F.lit(None).cast("string").alias(c) for c in ("category", "product", "service")],
        F.array(F.struct(F.lit("s").alias("name"), F.lit("uri_path").alias("field"), (F.col("id") % 2 == 0).alias("contains"), F.lit(False).alias("all"), F.array(F.concat(F.lit("/P"), F.col("id").cast("string"), F.lit("/"))).alias("values"))).alias("selections"),
        F.array(F.array(F.struct(F.lit("s").alias("name"), F.lit(False).alias("negated")))).alias("condition"),
    )
    events = spark.range(300).selectExpr("id as event_id", "concat('/p', id * 40, '/', if(id % 3 = 0, 'tail', '')) as uri_path")
    many = M.match_rules(events, made)
    # Even rules are contained: /p80/ holds rule 80; the odd ones are equal, and no path has an odd number.
    assert {(r.event_id, r.rule_id) for r in many.collect()} == {(i, f"r{i * 40}") for i in range(250)}
    size = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString())
    assert size(many) < 1.2 * size(M.match_rules(events, made.limit(10)))
    # Literals in several groups, and nothing broadcast, give the same.
    monkeypatch.setattr(R._groups, "__defaults__", (1 << 18,))
    monkeypatch.setattr(R, "small", lambda x: x)
    assert M.match_rules(events, made).count() == 250
