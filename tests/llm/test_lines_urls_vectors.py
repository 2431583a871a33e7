import math
from collections import Counter

import duckdb
import numpy as np
from pyspark.sql import functions as F

from kohorta.llm import line_dedup
from kohorta.llm.line_dedup import masked, templates, without_recurring_lines
from kohorta.llm.queries import ORACLES, RULES
from kohorta.llm.topk import exact_top_k
from kohorta.llm.url_filter import judge_urls


def brute_lines(rows, similarity=0.8, depth=3, min_docs=2, min_words=4):
    """Whole leaves at once: templates in the order of frequency, then kept lines per row."""
    leaves = {}
    for doc, text in rows:
        for line in (text or "").split("\n") if doc is not None else ():
            words = masked(line)
            if len(words) >= min_words:
                leaves.setdefault((len(words), *words[:depth]), Counter())[" ".join(words)] += 1
    template, found = {}, {}
    for leaf, lines in leaves.items():
        order = sorted(lines, key=lambda x: (-lines[x], x))
        for line, t in zip(order, templates([x.split(" ") for x in order], similarity)):
            template[line] = (leaf, t)
    for doc, text in rows:
        for line in (text or "").split("\n") if doc is not None else ():
            found.setdefault(template.get(" ".join(masked(line))), set()).add(doc)
    out = []
    for doc, text in rows:
        kept, gone = [], 0
        for line in (text or "").split("\n"):
            t = template.get(" ".join(masked(line))) if doc is not None and len(masked(line)) >= min_words else None
            if t and len(found[t]) >= min_docs and min(found[t]) != doc:
                gone += 1
            else:
                kept.append(line)
        out.append((doc, text if not gone else "\n".join(kept), len((text or "").split("\n")) if text is not None else 0, gone))
    return Counter(out)


def test_lines(tricky, texts):
    got = without_recurring_lines(tricky)
    assert got.columns == [*tricky.columns, "n_lines", "n_dropped"]
    assert Counter((r[0], r[1], r[-2], r[-1]) for r in got.collect()) == brute_lines(texts)


def test_lines_with_variable_fields(spark):
    rows = [(i, f"Posted on 2024-01-{i:02d} by user {i} in the forum\nOwn text number {'abcdefgh'[i]} of {'hgfedcba'[i]}!\n\n}}")
            for i in range(8)]
    got = {r.doc_id: r.text for r in without_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == rows[0][1]
    assert all(got[i].startswith("Own text") and got[i].endswith("\n\n}") for i in range(1, 8))


def test_large_leaf_is_split(spark, monkeypatch):
    """More different lines in a leaf than a task takes: equal lines are still found by deeper keys."""
    monkeypatch.setattr(line_dedup, "LEAF_LINES", 5)
    rows = [(i, f"same first words then {'abcdefghij'[i % 10] * 3} other things {'klmnopqrst'[i % 10] * 4} end") for i in range(40)]
    got = without_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).where("n_dropped = 1").count()
    assert got == 30


def test_large_leaf_is_matched_by_similarity(spark, monkeypatch):
    """Leaves over the size of a task, with fields that are no numbers, give what whole leaves give."""
    monkeypatch.setattr(line_dedup, "LEAF_LINES", 5)
    letters, rng = "abcdefghijklmnopqrst", np.random.default_rng(2)
    lines = [f"Posted by the user {a}{b} in the forum of today" for a in letters[:6] for b in letters[:10]]
    lines += [" ".join(["It is a", *(rng.choice([*"uvwxyz"]) for _ in range(n))]) for n in (2, 5, 7, 7, 9) for _ in range(30)]
    lines += [f"Read all of {a * 2} {b * 2} {c * 2} and so on {a * 3} {b * 3}" for a, b, c in rng.choice([*letters], (40, 3))]
    rows = [(i, "\n".join([line, lines[i * 7 % len(lines)]])) for i, line in enumerate(lines)]
    got = without_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(map(tuple, got)) == brute_lines(rows)
    assert not [r for r in got if r.doc_id and "Posted by" in r.text]


def test_lines_of_nothing(nothing):
    assert without_recurring_lines(nothing).collect() == []


def test_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i % 40, None if i == 3 else [float(x) for x in rng.integers(-3, 3, rng.integers(0, 5))]
             + ([math.nan] if i == 5 else [None] if i == 6 else []), 1) for i in range(55)] + [(None, [1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    points = [(a, [math.floor(2 * x) for x in e]) for a, e, _ in rows
              if a is not None and e and None not in e and not any(map(math.isnan, e))]
    for k in (1, 3, 100):
        got = exact_top_k(df, F.col("vec_id") % 7 == 0, k, 2, 3).collect()
        want = []
        for q in sorted({a for a, _ in points if a % 7 == 0}):
            own, best = min(e for a, e in points if a == q), {}
            for a, e in points:
                if a != q:
                    best[a] = max(best.get(a, -10 ** 9), sum(x * y for x, y in zip(own, e)))
            want += [(q, n + 1, a, s) for n, (a, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k])]
        assert sorted(map(tuple, got)) == sorted(want)
    assert exact_top_k(df.where("1 = 0"), F.col("vec_id") % 7 == 0).collect() == []


def test_urls_against_sql(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM", "https://www.example.com/en/1?x=1#y", "x://a.net/fr/",
            "http://a.example.com/en/", "http://example.com/en", "ftp://É.com/ä/9", "http://h.org//a///b/c/d/e/f", "a://b://c.net/es/1",
            "http://notexample.com/en/1", "http://net/es/1"]
    urls += [f"http://hot.org/{'abc'[i % 3]}/{i}/page{'xyzuvw'[i % 6]}" for i in range(300)]
    urls += [f"http://var.org/item-{chr(97 + i % 26)}{chr(97 + i // 26)}/view" for i in range(60)]
    pages = spark.createDataFrame([(i, u, "q") for i, u in enumerate(urls)] + [(5, urls[5], "q")], "page_id long, url string, host string")
    labels = spark.createDataFrame([(i, int(i % 3 == 1), int(i % 5 == 0)) for i in range(250)] + [(1, None, 1)],
                                   "doc_id long, toxic int, quality int")
    number = pages.select("page_id", F.regexp_extract(F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1), "([0-9]+)", 1)
                          .try_cast("bigint").alias("doc_id")).where("page_id <> 11")
    marks = number.join(labels, "doc_id").select("page_id", F.expr("cast(toxic = 1 or quality = 0 as int)").alias("bad")).where(
        "bad is not null")
    got = judge_urls(pages, marks, RULES, 4, 3, 20, 2.576, 10.0, 0.5)
    con = duckdb.connect()
    p, m = pages.toPandas(), labels.toPandas()
    con.register("p", p[["page_id", "url"]])
    con.register("l", m)
    con.sql("create view pages as select * from p; create view labels as select doc_id, toxic::int toxic, quality::int quality from l")
    rules = {r.page_id: (r.host, r.path, r.rule) for r in got.collect()}
    want = {r[0]: r[1:4] for r in con.sql(ORACLES["op3_url_templates"]).fetchall()}
    assert rules == want and got.count() == len(urls) + 1
    assert rules[0] == rules[2] == ("", "", None) and rules[4] == ("www.example.com", "", None)
    assert rules[5][2] == "www.example.com/en/" and rules[7][2] == "example.com/en/" and rules[12][2] == "com/"
    hot = {r.template for r in got.where("host = 'hot.org'").collect()}
    assert any(t.startswith("/b/") for t in hot)  # every bad label is under one branch, which stays apart
    assert {r.template for r in got.where("host = 'var.org'").collect()} == {"/*/view"}


def test_urls_of_nothing(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    marks = spark.createDataFrame([], "page_id long, bad int")
    assert judge_urls(pages, marks, RULES).collect() == []
    one = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    assert [r.verdict for r in judge_urls(one, marks, RULES).collect()] == ["allow"]
