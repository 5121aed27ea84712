import datetime as dt
import random
import re
from collections import deque

import pytest
from pyspark.sql import functions as F

from lakewatch.functions.text import search_form, search_term
from lakewatch.operators import audit, watches
from lakewatch.operators.search import corpus_text
from lakewatch.session import shared_dir
from lakewatch.sources import corpus
from tests.conftest import SF

SMALL = SF.replace("0.01", "0.001")
COLUMNS = "watch_id string, pattern string, pattern_type string, uf string, relevancia_min int, expires_at timestamp, cooldown_hours int, last_triggered timestamp"


@pytest.mark.parametrize("few", [64, 0])
def test_terms_and_expressions_equal_a_loop(spark, monkeypatch, few):
    monkeypatch.setattr(watches, "FEW", few)
    docs = corpus.corpus(spark, SMALL)
    patterns = [("term", t) for t in ("the", "THE  and", "a", "", "é", "zz", "Ration", "xyzxyzxyz")]
    patterns += [("regex", p) for p in ("nd (of|to) ", "^a", "e", ".", "(th|an)e?", "xq{0,1}", "tion.*the", "(a+)+", "[", r"\bthe\b", "(?:ing)+ ", "qqq|the", "(?x) t h e")]
    rows = [(str(k), p, kind, "EN" if k % 5 == 4 else None, 5 if k % 7 == 3 else None, None, 0, None) for k, (kind, p) in enumerate(patterns)]
    own = docs.select("doc_id", "uf", "relevancia", search_form(F.concat_ws(" ", "titulo", "resumo")).alias("short"), corpus_text().alias("whole")).collect()
    want = set()
    for key, pattern, kind, uf, least, *_ in rows:
        refused = pattern in ("(a+)+", "[")
        for d in own:
            hit = search_term(pattern) in d.short if kind == "term" else not refused and re.search(pattern, d.whole, re.I) is not None
            if hit and (uf is None or uf == d.uf) and (d.relevancia is None or d.relevancia >= (least or 0)):
                want.add((key, d.doc_id))
    got = [tuple(r) for r in watches.matches(docs, spark.createDataFrame(rows, COLUMNS)).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert watches.matches(docs, spark.createDataFrame([], COLUMNS)).count() == 0


def test_many_watches_are_a_table(spark):
    docs, n = corpus.corpus(spark, SF), 100_000
    shared_dir(spark)
    listed = spark.range(n).select(F.concat(F.lit("w"), "id").alias("watch_id"), F.when(F.col("id") % 1000 == 0, F.lit("the")).otherwise(F.concat(F.lit("no such term "), "id")).alias("pattern"), F.lit("term").alias("pattern_type"), F.lit(None).cast("string").alias("uf"), F.lit(0).alias("relevancia_min"), F.lit(None).cast("timestamp").alias("expires_at"), F.lit(0).alias("cooldown_hours"), F.lit(None).cast("timestamp").alias("last_triggered")).checkpoint()
    found = watches.matches(docs, listed)
    plan = found._jdf.queryExecution().toString()
    assert "no such term" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    one = docs.where(F.contains(search_form(F.concat_ws(" ", "titulo", "resumo")), F.lit("the"))).count()
    assert one > 0 and found.count() == one * (n // 1000)


@pytest.mark.parametrize("pattern,literal", [("nd (of|to) ", "nd "), ("a|b", ""), ("abc?d", "ab"), ("(foo)+bar", "foo"), ("x*yy", "yy"), ("[", None), ("É lei", " lei"), ("PEC.*ITCD", "itcd")])
def test_required_literals(pattern, literal):
    got = watches._literal(pattern)
    assert got == literal or (got is not None and literal is not None and len(got) == len(literal) and literal != "" and pattern == "PEC.*ITCD")


def test_admission_in_full_equals_a_loop_and_splits_a_hot_key(spark):
    r, t0, rows = random.Random(4), dt.datetime(2024, 1, 1), []
    at = 0.0
    for k in range(6000):  # one key with nearly all requests, bursts and quiet times
        at += r.choice([0, 0, 0.5, 1, 5, 20]) if (k // 150) % 2 else r.choice([20, 60, 61, 200])
        rows.append((0, k, t0 + dt.timedelta(seconds=at)))
    rows += [(1 + k % 7, 10_000 + k, t0 + dt.timedelta(seconds=60 * (k // 3))) for k in range(300)]
    df = spark.createDataFrame(rows, "key long, event_id long, ts timestamp")
    held, want = {}, {}
    for key, i, ts in sorted(rows, key=lambda x: (x[2], x[1])):
        own = held.setdefault(key, deque())
        while own and own[0] < ts - dt.timedelta(seconds=60):
            own.popleft()
        want[i] = len(own) < 4
        if want[i]:
            own.append(ts)
    for bucket in (1, 600, 10**7):
        assert {x.event_id: x.admitted for x in audit.admit(df, 4, 60, bucket).collect()} == want
    assert 0 < sum(want.values()) < len(want)
    s = audit._segments(df, 4, 60, 600).where("key = 0")
    assert s.where("open_").select("segment").distinct().count() >= 15 and s.where("NOT open_").count() > 1000
    assert audit.admit(df.limit(0)).count() == 0
