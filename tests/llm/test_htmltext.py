import re

from strandline.llm import htmltext as H
from tests.conftest import SF

PAGE = (
    '<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>T</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body>'
    '<nav><ul><li><a href="/x">Menu</a></li></ul></nav><!-- ad 1 --><div class="ad">Buy now, a very long advert text that surges well above the threshold of the distribution.</div>'
    "<article><h1>Head &amp; line</h1><p><b>Bold  text<br><p>Second&nbsp;&lt;par&gt;\n with\tspace.</p><p>Hi.</p></article><footer>&copy; x</footer></body></html>"
)


def test_article_page():
    assert H.main_text(PAGE) == "Head & line\n\nBold text\n\nSecond <par> with space.\n\nHi."


def test_unmarked_page_by_distribution():
    long = "word " * 40
    page = f"<body><div class='menu'>Home</div><ul><li><a href=1>One link here</a></li><li><a href=2>Another link here</a></li></ul><p>{long}</p><p>Ok.</p><p>{long}</p><p><a href=3>A link line that is long enough to be a text of its own but is not</a></p><p><a href=4>x</a></p><p><a>y</a></p><div id='comments'>{long}</div></body>"
    assert H.main_text(page) == f"{long.strip()}\n\nOk.\n\n{long.strip()}"


def test_boilerplate_and_damage():
    for inside in ("<aside>no</aside>", "<form>no<input></form>", "<div class='cookie-notice'>no</div>", "<div role=navigation>no</div>", "<script>no", "<!-- no", "<section id=comments><article>no</article></section>"):
        assert "no" not in H.main_text(f"<article><p>Yes it is</p>{inside}").split()
    assert H.main_text("<article><h1>Cut off &am") == "Cut off &am"
    assert H.main_text("<article><p>a < b and c > d</p><p>x</artic") == "a < b and c > d\n\nx"
    assert H.main_text("<article><header><h1>Title</h1></header><p>t</p></article>") == "Title\n\nt"
    for empty in (None, "", "<html></html>", "<p></p>"):
        assert H.main_text(empty) == ""


def test_spans():
    import numpy as np

    assert H.spans(np.array([100, 0, 0, 0, 0, 300, 5, 200, 0, 0, 0])) == [(0, 1), (5, 8)]
    assert H.spans(np.array([5, 100, 0, 0, 0, 9, 0, 0, 0])) == [(0, 2)]  # a headline; a short line by itself
    assert H.spans(np.array([900, 0, 0, 0, 0, 90, 0, 0])) == [(0, 1)]  # far less text a line
    assert H.spans(np.array([0, 12, 7, 0])) == [(1, 3)]  # never above the threshold
    assert H.spans(np.zeros(0, int)) == [] and H.spans(np.zeros(3, int)) == []


def test_spans_match_brute_force():
    import random

    import numpy as np

    rng = random.Random(8)
    for _ in range(300):
        lengths = [rng.choice([0, 0, 0, 4, 30, 60, 200]) for _ in range(rng.randrange(1, 25))]
        n, sums = len(lengths), [sum(lengths[i : i + 3]) for i in range(len(lengths))]
        surge, dive = min(80, max(sums) - 1), min(10, max(lengths) - 1)
        kept = set()
        for i in range(n):
            if max(lengths) and sums[i] > surge and lengths[i] > dive:
                j = i
                while j < n and sums[j] > dive:
                    kept.add(j)
                    j += 1
                for step, k in ((-1, i - 1), (1, j)):
                    while 0 <= k < n and lengths[k] > 0:
                        kept.add(k)
                        k += step
        got = {k for a, b in H.spans(np.array(lengths), density=0) for k in range(a, b)}
        assert got == kept, lengths


def test_article_keeps_its_parts():
    assert H.main_text("<article><p title=it's>one</p><p>two</p><p title='x>y'>three</p><p>it's four</p></article>") == "one\n\ntwo\n\nthree\n\nit's four"
    kept = "<article><header class='entry-header'><h1>Head</h1></header><h2 class='section-header'>Part two</h2><p>t</p></article>"
    assert H.main_text(kept) == "Head\n\nPart two\n\nt"
    outside = "".join(f"<p>{w} outside</p>" for w in "abcd")
    assert H.main_text(f"<article><p>first</p></article>{outside}<article><p>second</p></article>") == "first\n\nsecond"
    assert H.main_text("<body><div>Short but all there is.</div></body>") == "Short but all there is."
    assert H.main_text(f"<h1>News</h1><p>{'long ' * 40}</p><p>The end.</p>") == f"News\n\n{('long ' * 40).strip()}\n\nThe end."
    split = f"<p>{'one ' * 60}</p><p><a href=1>see</a></p><p><a href=1>see</a></p><p><a href=1>see</a></p><p>{'two ' * 40}</p>"
    assert H.main_text(split) == f"{('one ' * 60).strip()}\n\n{('two ' * 40).strip()}"
    assert H.main_text("<article><p>Text</p></article><section><article class='comment'><p>me too</p></article></section>") == "Text"
    assert H.main_text("<main><ul><li><a href=1>Some link in a list</a></li></ul><h1>Head</h1><p>" + "word " * 30 + "</p></main><p>" + "other " * 40) == "Head\n\n" + ("word " * 30).strip()
    assert H.main_text("<div class='no-sidebar'><p>" + "word " * 30 + "</p></div>") == ("word " * 30).strip()
    assert H.main_text("<article><ul><li>a<li>b<ul><li>c</ul><li>d</ul><table><tr><td>e<td>f<tr><td>g</table></article>") == "\n\n".join("abcdefg")


def test_broken_pages_take_linear_time():
    import time

    n = 1 << 20
    pages = ["<a " * (n // 3) + '"', "<div>" * (n // 5), "<div>" * (n // 10) + "</p>" * (n // 8), "<p><b>" * (n // 6), "<b>" * (n // 12) + "<div></div>" * (n // 14)]
    pages += ["<script>" * (n // 8), "<!--" * (n // 4), "<a x='" * (n // 6), "</b>" * (n // 4), "<" * n, "&" * n, "<li>" * (n // 4), "<x " + " " * n, "<p class=" + "a-" * (n // 2) + ">t", "<a =" * (n // 4) + "'", "<p" + " a =" * (n // 4)]
    for page in pages:
        began = time.process_time()
        H.main_text(page)
        assert time.process_time() - began < 4, page[:20]


def test_whole_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in H.extract(pages).collect()}
    for row in pages.collect():
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", row.html, re.S)[1]
        blocks = re.split(r"</?(?:p|h1|div)>", article)
        import html as lib

        want = "\n\n".join(t for b in blocks if (t := " ".join(lib.unescape(re.sub("<[^>]*>", " " if "<br>" in b else "", b)).split())))
        assert got[row.page_id].text == want and got[row.page_id].n_chars == len(want)


def test_edges(spark):
    pages = spark.createDataFrame([(1, None, None), (None, "u", ""), (1, None, "<article>x")], "page_id long, url string, html string")
    assert sorted(str((r.page_id, r.url, r.text, r.n_chars)) for r in H.extract(pages).collect()) == sorted(["(1, None, '', 0)", "(None, 'u', '', 0)", "(1, None, 'x', 1)"])
    assert H.extract(pages.limit(0)).collect() == []
