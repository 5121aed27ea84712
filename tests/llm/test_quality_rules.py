import random
import re
from collections import Counter

from lakewatch.llm import quality_rules


def slow(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {p for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_measures_and_ledger(spark):
    r = random.Random(3)
    texts = [None, "", " \n\t", "a b c a b c", "a b", "aa a aaa aa a aaa", "é|ñ <x>\nsame\nsame\n same\n\n", "w " * 20000]
    texts += [" ".join(r.choice("abc#é") * r.randint(1, 3) for _ in range(r.randint(1, 120))) + r.choice(["", "\n", "\nx\nx"]) for _ in range(60)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, n_words string")
    rows = quality_rules.apply_policy(quality_rules.ledger(df))
    for x in rows.collect():
        n, chars, symbols, dup, repeat = slow(texts[x.doc_id])
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == (n, chars, symbols, dup, repeat)
        assert x.base_failed == (n < 50 or 100 * repeat > 50 * n) == bool(x.failures & 3)
        assert x.kept == (x.failures == 0)
    got = {a.rule: (a.n_failed, a.n_only) for a in quality_rules.ablations(rows).collect()}
    all_ = [x.failures for x in rows.collect()]
    assert got == {k: (sum(f >> i & 1 for f in all_), sum(f == 1 << i for f in all_)) for i, k in enumerate(quality_rules.RULES)}
    base = quality_rules.apply_policy(quality_rules.ledger(df), "base-1")
    assert base.where("kept = base_failed").count() == 0


def test_empty_table_and_native_plan(spark):
    df = quality_rules.apply_policy(quality_rules.ledger(spark.createDataFrame([], "doc_id long, text string")))
    assert df.count() == 0
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString() and "Arrow" not in df._jdf.queryExecution().executedPlan().toString()
