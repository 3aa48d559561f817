"""The content pick against reading every div of a page."""

import random
import re
import time

from pyspark.sql import functions as F

from bookloom.functions import html as H
from bookloom.operators import webpages as W

PIECES = ("<div>", "<div class='x'>", "</div>", "</div>", "<p>", "</p>", "<br>", " ", "\n", "text", "a few words", "笔趣阁 ad", "&nbsp;", "&amp;", "<!-- no",
          "-->", "<", "x > y", "twice", "twice", "<DIV>", "<b>", "　", "\u2003", "\r", "<!-->")


def bodies(page):
    """Every div's body, by walking on from its opening tag."""
    tag = re.compile(r"<(/?)div\b[^>]*>", re.I)
    for opening in tag.finditer(page):
        if opening.group(1):
            continue
        depth, end = 1, len(page)
        for t in tag.finditer(page, opening.end()):
            depth += -1 if t.group(1) else 1
            if depth == 0:
                end = t.start()
                break
        yield page[opening.end():end]


def test_longest_div_is_that_of_all_divs(spark):
    rng = random.Random(11)
    pages = ["".join(rng.choice(PIECES) for _ in range(rng.randint(1, 40))) for _ in range(1500)] + ["", "no div", "<div>", "<div></div>", "<div>same</div><div>same</div>"]
    every = [(i, n, b) for i, p in enumerate(pages) for n, b in enumerate(bodies(p))]
    rules = ("笔趣阁",)
    texts = spark.createDataFrame(every, "page_id long, n long, html string") \
        .select("page_id", "n", H.strip_html("html", ad_rules=rules).alias("text")).collect()
    want = dict.fromkeys(range(len(pages)), "")
    for r in sorted(texts, key=lambda r: (r.page_id, r.n)):
        if len(r.text) > len(want[r.page_id]):
            want[r.page_id] = r.text
    df = spark.createDataFrame(list(enumerate(pages)) + [(-1, None)], "page_id long, html string")
    got = {r.page_id: r.text for r in W.pick_content(df, ad_rules=rules).collect()}
    assert got.pop(-1) == ""
    assert got == want


def test_a_deeply_nested_page_is_read_once(spark):
    deep = "<div>" * 10_000 + "the only words " * 2_000 + "</div>" * 10_000
    df = spark.createDataFrame([(1, deep)], "page_id long, html string")
    began = time.time()
    text = W.pick_content(df).select(F.length("text").alias("n")).first().n
    assert text == len("the only words " * 2_000) - 1 and time.time() - began < 60


def test_texts_are_made_once(spark):
    """Each step's text is read by the steps behind it, not made anew for each of them, and rows without a page stay."""
    df = spark.createDataFrame([(0, "<div id='x'>a</div>"), (1, None), (1, None)], "page_id int, html string")
    out = W.pick_content(df)
    assert sorted(r.page_id for r in out.collect()) == [0, 1, 1]
    # the texts of the three steps and the page of the last one take scripts out
    assert out._jdf.queryExecution().executedPlan().toString().count("(script|style)") == 4
    assert df.select(H.strip_html("html").alias("text"))._jdf.queryExecution().executedPlan().toString().count("(script|style)") == 1
