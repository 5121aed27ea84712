import hashlib
import itertools
import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from lakewatch.llm import pii, pii_model, quality_gam, secret_scan
from tests.conftest import SF

SECRETS = [
    (1, 'x password = "hunter2!" y'), (2, "token: abc"), (3, 'API-KEY="ABCDEF123"'), (4, "AKIA" + "Z9" * 8 + " é AKIAabc"), (5, "deadbeef" * 4), (6, "the token is 9f8s7df98s7df9s8"), (7, None), (8, ""), (None, "passwd:aaaaaa"),
    (9, "password: password123"), (10, "ünïcode pwd = Xk29!fjw0q2Lm"), (11, "toKen=short password=token=abcdefgh"), (12, "secret=" + "a1" * 40000),
]


def base(text):
    found = []
    for kind, pattern in (("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), ("access", "AKIA[A-Z0-9]+"), ("hex", "[0-9a-f]+")):
        for m in re.finditer(pattern, text or ""):
            if (kind == "assign" and len(m[2]) >= 6) or (kind == "access" and len(m[0]) >= 20) or (kind == "hex" and len(m[0]) >= 24):
                found.append((m.start(), ("assign", "access", "hex").index(kind), f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(found)]


def test_secrets_keep_the_base_spans(spark):
    df = spark.createDataFrame([(d, t, "x") for d, t in SECRETS], "doc_id long, text string, found string")
    texts = dict(SECRETS)
    for r in secret_scan.digest(secret_scan.find_secrets(df)).collect():
        want = base(texts[r.doc_id])
        spans = r.spans.split(",") if r.spans else []
        assert [s for s in spans if not s.startswith("guess")] == want
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s.startswith(k) for s in want) for k in ("assign", "access", "hex"))
    got = {r.doc_id: r.spans for r in secret_scan.digest(secret_scan.find_secrets(df)).collect()}
    assert "guess" in got[6] and "guess" in got[10] and "guess" not in got[9]
    assert secret_scan.find_secrets(df.limit(0)).count() == 0


def span_cost(value, i, j):
    """Least log10 guesses of one span, told from its characters alone."""
    part, low = value[i:j], value[i:j].lower()
    kinds = sum(n for n, has in ((26, any("a" <= c <= "z" for c in value)), (26, any("A" <= c <= "Z" for c in value)), (10, any(c in "0123456789" for c in value)), (33, any(not (c.isascii() and c.isalnum()) for c in value))) if has)
    found = [len(part) * math.log10(kinds)]
    rank, shift = secret_scan._ranks()[0], dict(zip("4301$@57", "aeolsast"))
    if len(part) >= 3:
        plain = "".join(shift.get(c, c) for c in low)
        for form, extra in ((low, 0), (plain, 0.3 if plain != low else 0)):
            if form in rank:
                found.append(math.log10(rank[form]) + extra + (0.3 if part != low else 0))
    for cut in ("", "-", "/", ".", "_"):
        for cut2 in ("", "-", "/", ".", "_"):
            for a in range(1, 5):
                for b in range(1, 5):
                    c = len(part) - a - b - len(cut) - len(cut2)
                    x, y, z = part[:a], part[a + len(cut) : a + len(cut) + b], part[a + len(cut) + b + len(cut2) :]
                    if c < 1 or x + cut + y + cut2 + z != part or not (x + y + z).isdigit():
                        continue
                    year = lambda t: len(t) == 4 and t[:2] in ("19", "20")
                    month, day = lambda t: len(t) <= 2 and 1 <= int(t) <= 12, lambda t: len(t) <= 2 and 1 <= int(t) <= 31
                    if year(x) and month(y) and day(z) or (year(z) or len(z) == 2) and (day(x) and month(y) or month(x) and day(y)):
                        found.append(math.log10(365 * 119))
    if len(part) == 4 and part.isdigit() and part[:2] in ("19", "20"):
        found.append(math.log10(119))
    for p in range(1, 9):
        if len(part) >= max(3, 2 * p) and len(part) % p == 0 and part == part[:p] * (len(part) // p):
            own = sum(n for n, has in ((26, any("a" <= c <= "z" for c in part)), (26, any("A" <= c <= "Z" for c in part)), (10, any(c in "0123456789" for c in part)), (33, any(not (c.isascii() and c.isalnum()) for c in part))) if has)
            found.append(p * math.log10(own) + 1)
    if len(part) >= 3:
        steps = [ord(y) - ord(x) for x, y in zip(low, low[1:])]
        if set(steps) in ({1}, {-1}) or all(x + y in secret_scan._BESIDE for x, y in zip(low, low[1:])):
            found.append(math.log10(47 * 4 * 8))
    return min(found)


def least_cost(value):
    best = [-math.log10(2)]
    for j in range(1, len(value) + 1):
        best.append(min(best[i] + math.log10(2) + span_cost(value, i, j) for i in range(j)))
    return max(0.0, best[-1])


def test_guess_cost_is_the_least_of_all_segmentations():
    values = ["password1", "qwerty12", "abcabc99", "20240131x", "zz9", "dragon!!", "P4ssword", "abcdefriend", "abcdefriend9", "2024-12-25", "119990101", "Summer2024-12-31!", "aaaaabcabcabcqwer", "12/31/1999x", "31.12.99", "zyxqwe", "x", "éé", "İx"]
    r = random.Random(6)
    values += ["".join(r.choice(["ab", "abc", "1", "2", "20", "19", "q", "we", "sun", "the", "-", "A", "é", "99", "aa", "love", "cba"]) for _ in range(r.randint(1, 8))) for _ in range(300)]
    for value in values:
        assert abs(secret_scan.guesses(value) - least_cost(value)) < 1e-9, value
    assert secret_scan.guesses("password") < 1 < 8 < secret_scan.guesses("xV9#qLp2")
    assert len({secret_scan.guesses("ab" * k) for k in (2, 50, 20_000)}) == 1


def test_guessable_values_are_no_secrets():
    for value in ("abcdefriend9", "Summer2024-12-31!", "2024-12-25", "Zusammenarbeit", "communication", "internationalization"):
        assert not any(k == "guess" for k, *_ in secret_scan.scan(f"the password is {value}")[0]), value
    for value in ("Xk!fjwqLmRtZ", "xK#vQ!pLmZrT@w", "9f8s7df98s7df9s8"):
        assert any(k == "guess" for k, *_ in secret_scan.scan(f"the password is {value}")[0]), value


def test_gradient_of_the_tagger():
    rng = np.random.default_rng(0)
    shapes = ((2, pii_model.CLASSES, 64), (2, 16, 64), (32, pii_model.TAGS), (pii_model.TAGS,), (pii_model.TAGS, pii_model.TAGS))
    m = pii_model.Model(*(rng.normal(0, 0.3, s) for s in shapes))
    seq, tags = pii_model._examples(rng, 4, 12)
    seq[1, 7:] = 0
    tags[1, 7:] = 0
    _, gradient = pii_model.loss_and_gradient(m, seq, tags)
    for p, g in zip(m.parts(), gradient):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, step = p[at], 1e-3
        p[at] = old + step
        up = pii_model.loss_and_gradient(m, seq, tags)[0]
        p[at] = old - step
        down = pii_model.loss_and_gradient(m, seq, tags)[0]
        p[at] = old
        assert abs((up - down) / (2 * step) - g[at]) < 1e-3 * max(1, abs(g[at]))


def test_tagger_on_held_out_spans():
    seq, tags = pii_model._examples(np.random.default_rng(99), 400, 64)
    got, _ = pii_model.decode(pii_model.trained(), seq)
    assert (got == tags)[seq != 0].mean() > 0.93 and (got == tags)[tags > 0].mean() > 0.9


def test_the_stored_model_is_what_training_makes():
    again, stored = pii_model.train(), pii_model.trained()
    assert all(p.shape == q.shape for p, q in zip(again.parts(), stored.parts()))
    seq, _ = pii_model._examples(np.random.default_rng(98), 200, 64)
    assert (pii_model.decode(again, seq)[0] == pii_model.decode(stored, seq)[0])[seq != 0].mean() > 0.99


def test_pii_spans(spark):
    rows = [
        (1, "mail ab.c@x.example.com, or 10.2.3.255 and 300.1.1.1"), (2, "card 4111 1111 1111 1111 or 4111111111111112"), (3, "call +1 (212) 555-0199 now"), (4, None), (5, ""), (None, "é 4111-1111-1111-1111"), (6, "call (212) 555-0187 today"),
        (7, "in 2024 there were 1,234 of 56 (7%)"), (8, "word " * 30000 + "x@y.org"), (9, "no data here"),
    ]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, spans int")
    got = {r.doc_id: r for r in pii.digest(pii.find_pii(df)).collect()}
    assert (got[1].n_email, got[1].n_ip, got[2].n_card, got[3].n_phone) == (1, 1, 1, 1)
    assert got[1].spans.startswith("email:5:23,ip:28:38") and got[3].spans == "phone:5:22"
    assert got[8].spans == "email:150000:150007" and [got[i].spans for i in (4, 5, 7, 9)] == [""] * 4
    assert got[6].n_phone == 0 and got[6].spans == "phone:5:19" and got[6].n_added == 1
    for r in got.values():
        text = dict(rows)[r.doc_id] or ""
        want = [f"{k}:{a}:{b}" for k, a, b in pii.base_spans(text)]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest() and set(want) <= set(r.spans.split(",") if r.spans else [])


def test_best_tags_equal_all_sequences():
    rng = np.random.default_rng(3)
    m = pii_model.Model(*(rng.normal(0, 0.7, s) for s in ((2, pii_model.CLASSES, 64), (2, 16, 64), (32, pii_model.TAGS), (pii_model.TAGS,), (pii_model.TAGS, pii_model.TAGS))))
    seq = rng.integers(1, pii_model.CLASSES, (3, 4)).astype(np.uint8)
    seq[2, 3:] = 0
    tags, _ = pii_model.decode(m, seq)
    scores = pii_model.emissions(m, seq)
    for b, n in enumerate((4, 4, 3)):
        value = lambda path, b=b: sum(scores[t, b, k] for t, k in enumerate(path)) + sum(m.trans[x, y] for x, y in zip(path, path[1:]))
        best = max(itertools.product(range(pii_model.TAGS), repeat=n), key=value)
        assert tuple(tags[b, :n]) == best


def plain_pii(text):
    """The fixed patterns by the contract's words, matches that fail dropped."""
    luhn = lambda d: sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0
    digits = lambda s: re.sub("[^0-9]", "", s)
    checks = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s))), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15),
    )
    return [f"{k}:{m.start()}:{m.end()}" for k, p, ok in checks for m in re.finditer(p, text) if ok(m[0])]


def test_base_spans_equal_the_plain_patterns():
    r = np.random.default_rng(8)
    parts = ["a.b@c.de", "x@y", "10.0.0.1", "256.1.1.1", "1.2.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (212) 555-0199", "+12", "00012.1.1.1", "é", " ", "-", "+", "@", ".", "7" * 20, "word"]
    for _ in range(500):
        text = "".join(parts[k] for k in r.integers(0, len(parts), int(r.integers(0, 12))))
        assert [f"{k}:{a}:{b}" for k, a, b in pii.base_spans(text)] == plain_pii(text)


def test_empty_tables_repeated_rows_and_very_long_values(spark):
    df = spark.createDataFrame([(1, "pwd: Kd92hfq1! a@b.cd", 1)] * 2 + [(2, "token=" + "aB3$" * 5000, 2)], "doc_id long, text string, spans int")
    for found, digest in ((secret_scan.find_secrets, secret_scan.digest), (pii.find_pii, pii.digest)):
        rows = [tuple(r) for r in digest(found(df)).collect()]
        assert len(rows) == 3 and len(set(rows)) == 2
        assert digest(found(df.limit(0))).count() == 0


def test_person_numbers_are_no_phones():
    spans = pii.spans_of(pii_model.trained(), ["his number is 123-45-6789 and she called (212) 555-0187 today"])[0]
    assert ("id", 14, 25, "model") in spans and ("phone", 41, 55, "model") in spans


def test_reconcile_is_the_best_choice():
    spans = [(0, 0, 10, 5.0), (1, 8, 20, 6.0), (0, 19, 30, 5.5), (2, 40, 44, 1.0), (2, 42, 50, 2.0)]
    assert pii.reconcile(spans) == [(0, 0, 10), (0, 19, 30), (2, 40, 50)]


def test_quality_model_on_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    scores = quality_gam.score(docs, quality_gam.train(docs, labels))
    held = scores.join(labels, "doc_id").where("held_out").select("score", "quality").toPandas()
    good, bad = held.score[held.quality == 1].to_numpy(), held.score[held.quality == 0].to_numpy()
    assert len(good) > 50 and (good[:, None] > bad[None, :]).mean() > 0.97
    flipped = labels.withColumn("quality", F.when(quality_gam.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted(map(tuple, scores.collect())) == sorted(map(tuple, quality_gam.score(docs, quality_gam.train(docs, flipped)).collect()))


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "a b"), (3, "x " * 50000), (3, "x"), (4, "\n\n")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality_gam.score(docs, quality_gam.train(docs, none)).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (2, 1), (3, None)], "doc_id long, quality int")
    out = quality_gam.score(docs, quality_gam.train(docs, one)).collect()
    assert len(out) == 6 and all(0 <= r.score <= 1 for r in out)


def test_features_equal_plain_counts():
    texts = ["One two.\nOne two.\n\nthree THREE one", "", "a | b !! C #1 é\tñ", "x y x y x y x", "\n \n", "Wörd 12.5% end? Yes! no"]
    raw = [t.encode() for t in texts]
    got = quality_gam.measures(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    for t, row in zip(texts, got):
        b, words = t.encode(), [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", t)]
        low = [w.lower() for w in words]
        n, w, chars = len(words), max(1, len(words)), max(1, len(b))
        size = [len(x) for x in words]
        count = lambda s: sum(b.count(c.encode()) for c in s)
        lines = [tuple(x.lower().encode().split()) for x in t.split("\n") if x.split()]
        triples = list(zip(low, low[1:], low[2:]))
        mean = sum(size) / w
        want = {
            "log_words": math.log1p(n), "word_length": mean, "word_length_sd": math.sqrt(max(0, sum(x * x for x in size) / w - mean**2)), "longest_word": max(size, default=0), "exclamations": b.count(b"!") / w, "pipes": b.count(b"|") / w,
            "upper": sum(65 <= c <= 90 for c in b) / chars, "digits": sum(48 <= c <= 57 for c in b) / chars, "words_a_line": n / (t.count("\n") + 1), "duplicate_lines": (len(lines) - len(set(lines))) / max(1, len(lines)), "distinct_words": len(set(low)) / w,
            "repeated_triples": (len(triples) - len(set(triples))) / max(1, len(triples)), "commonest_word": max((low.count(x) for x in low), default=0) / w, "short_words": sum(x <= 3 for x in size) / w, "capitalised": sum(65 <= x[0] <= 90 for x in words) / w, "words_a_stop": n / (count(".?!") + 1),
        }
        for k, v in want.items():
            assert abs(row[quality_gam.NAMES.index(k)] - v) < 1e-9, (t, k)


def test_trees_take_the_best_cuts():
    rng = np.random.default_rng(4)
    for _ in range(20):
        g, h = rng.normal(0, 1, 12), rng.uniform(0.1, 1, 12)
        gain = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + 1.0)
        c = max(range(1, 12), key=lambda c: gain(0, c) + gain(c, 12))
        tree = quality_gam._tree(g, h, leaves=2)
        assert np.allclose(tree, np.where(np.arange(12) < c, g[:c].sum() / (h[:c].sum() + 1), g[c:].sum() / (h[c:].sum() + 1)))
        gg, hh = rng.normal(0, 1, (5, 5)), rng.uniform(0.1, 1, (5, 5))
        parts = lambda x, a, b: (x[:a, :b].sum(), x[:a, b:].sum(), x[a:, :b].sum(), x[a:, b:].sum())
        best = max((sum(p * p / (q + 4) for p, q in zip(parts(gg, a, b), parts(hh, a, b))) for a in range(1, 5) for b in range(1, 5)))
        assert abs(quality_gam._pair_tree(gg, hh)[1] - best) < 1e-9


def test_scores_are_sums_of_looked_up_values():
    rng = np.random.default_rng(6)
    x, y = rng.normal(0, 1, (300, 4)), (rng.random(300) < 0.5).astype(float)
    m = quality_gam.fit(x, y)
    for row in x[:20]:
        bins = [sum(v >= c for c in cuts) for v, cuts in zip(row, m.cuts)]
        total = m.base + sum(m.tables[f][b] for f, b in enumerate(bins)) + sum(t[bins[f] * quality_gam.PAIR_BINS // quality_gam.BINS, bins[k] * quality_gam.PAIR_BINS // quality_gam.BINS] for t, (f, k) in zip(m.pair_tables, m.pairs))
        assert abs(m.score(row[None])[0] - 1 / (1 + math.exp(-total))) < 1e-12


def test_quality_columns_may_clash(spark):
    docs = spark.createDataFrame([(1, "", "x", 1), (2, "a b c", "y", 0)], "doc_id long, text string, score string, quality int")
    labels = spark.createDataFrame([(1, 0, "t"), (2, 1, "t")], "doc_id long, quality int, text string")
    assert quality_gam.score(docs, quality_gam.train(docs, labels)).columns == ["doc_id", "held_out", "score", "predicted"]
    assert quality_gam.score(docs.limit(0), quality_gam.train(docs, labels)).count() == 0


def test_features_do_not_depend_on_neighbours():
    texts = [b"One two.\nOne two.\nthree", b"", b"a | b !! C", b"x", b"\n"]
    together = quality_gam.measures(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    for i, t in enumerate(texts):
        assert np.allclose(quality_gam.measures(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0], together[i])


def test_written_at_signs_in_texts_without_digits(spark):
    far = "nothing to see in these words " * 10
    values = ("jane (at) example.org", "bo.li [at] mail.test.com", "marta (at) sefaz.net")
    rows = [(k, f"{far}write to {v} or not {far}") for k, v in enumerate(values)]
    found = {r.doc_id: [(s.kind, s.value) for s in r.found] for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {k: [("email", v)] for k, v in enumerate(values)}


def test_guess_cost_decides_for_every_value():
    guessed = lambda text: [text[a:b] for k, a, b in secret_scan.scan(text)[0] if k == "guess"]
    assert guessed('password="xK#vQ!pLmZrT@w"') == ["xK#vQ!pLmZrT@w"]  # no digit
    assert guessed("pwd = aB3$xY and secret: qZ!m#Tv") == ["aB3$xY", "qZ!m#Tv"]  # 6 and 7 characters
    prose = ("the secret is everything you keep", "password: required", "Authorization: confidential", "the token is not-found", "a secret is something", "the password is management/security")
    assert [guessed(t) for t in prose] == [[]] * len(prose)


FORMS = (
    ("email", "jane.doe@mail.example.org"), ("email", "max (at) example.de"), ("email", "ana [at] correo.es"), ("ip", "10.24.3.199"), ("card", "4012 8888 8888 1881"), ("card", "3782 822463 10005"), ("card", "4012888888881881"),
    ("phone", "+1 (212) 555-0187"), ("phone", "(212) 555-0187"), ("phone", "0171 1234567"), ("phone", "030/1234567"), ("phone", "212-555-0187"), ("phone", "+49 30 1234 5678"), ("id", "123-45-6789"),
)


def test_spans_put_into_documents_are_found(spark):
    r = random.Random(11)
    texts = [x.text for x in spark.read.parquet(f"{SF}/documents.parquet").where("length(text) > 200").orderBy("doc_id").limit(280).collect()]
    model, planted, hit, extra = pii_model.trained(), 0, 0, 0
    for k, text in enumerate(texts):
        kind, value = FORMS[k % len(FORMS)]
        words = text.split(" ")
        at = len(" ".join(words[: (cut := r.randrange(1, len(words)))])) + 1
        text = text[:at] + value + " " + " ".join(words[cut:])
        spans = pii.spans_of(model, [text])[0]
        base = {tuple(s) for s in pii.base_spans(text)}
        planted += 1
        hit += any(s[0] == kind and s[1] < at + len(value) and at < s[2] for s in spans)
        extra += sum(tuple(s[:3]) not in base and not (s[1] < at + len(value) and at < s[2]) for s in spans)
    assert hit >= 0.9 * planted and extra <= 0.02 * planted, (hit, planted, extra)
