"""Main text of pages written by hand, none of them by the training layouts: short and unmarked articles, with and without navigation and footer, and very deep ones."""

import itertools
import random

import duckdb
import pytest

from weft.llm import htmlmain

SENTENCES = [
    "The river rose overnight and covered the lower fields.", "Nobody in the village had expected it so early in the year.", "By noon the first boats were out, carrying sheep and furniture.",
    "Her grandmother remembered a flood from before the war.", "It took the council three weeks to clear the road, and longer to repair the bridge.",
    "Insurance paid for some of the damage; the rest was shared out.", "A plaque on the mill now shows how high the water came.", "Children measure themselves against it every summer.",
]
AROUND = {
    "nothing": ("", ""), "links": ('<nav><a href="/">Home</a> <a href="/a">About</a></nav>', "<footer>Copyright 2020 Example Ltd.</footer>"),
    "list": ('<nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul></nav>', "<footer><p>All rights reserved.</p></footer>"),
    "header": ("<header><h2>The Daily Example</h2></header>", "<footer><p>Contact us</p></footer>"),
}
HOLDS = ["<article>%s</article>", "<main>%s</main>", '<div class="content">%s</div>', "<div>%s</div>", "%s", '<div id="main"><div class="post">%s</div></div>', "<section>%s</section>"]
TAILS = {"": "", "figure": "<figure><img src='a.png'></figure>", "svg": "<svg><path d='x'/></svg>", "script": "<script>if (a < b) {", "pre": "<pre>x = 1</pre>"}


@pytest.fixture(scope="module", params=[0, 130])
def model(request):
    pages = duckdb.sql(f"SELECT html FROM '/root/testdata/sf0.01/pages.parquet' WHERE html IS NOT NULL ORDER BY hash(page_id) LIMIT 100 OFFSET {request.param}").fetchall()
    return htmlmain.train([p[0] for p in pages])


def test_short_and_unmarked_articles(model):
    rng, sums = random.Random(1), {}
    for (name, (before, after)), holds, n, (tail, end) in itertools.product(AROUND.items(), HOLDS, (1, 2, 3, 5, 8), TAILS.items()):
        told = [" ".join(rng.sample(SENTENCES, rng.choice((1, 2, 3)))) for _ in range(n)]
        page = f"<html><body>{before}{holds % (''.join(f'<p>{x}</p>' for x in told) + end)}{'' if tail == 'script' else after}</body></html>"
        want = {*told, *(["x = 1"] if tail == "pre" else [])}
        got = set(htmlmain.main_texts([page], model)[0].split("\n")) - {""}
        for key in (("around", name), ("in", holds), ("paragraphs", n), ("tail", tail)):
            hit, all_, kept = sums.get(key, (0, 0, 0))
            sums[key] = hit + sum(map(len, got & want)), all_ + sum(map(len, want)), kept + sum(map(len, got))
    for key, (hit, all_, kept) in sums.items():
        assert hit >= 0.97 * all_ and hit >= 0.97 * kept, (key, hit / all_, hit / kept)


def test_very_deep_pages_keep_their_text(model):
    for tag in ("div", "section"):
        page = f"<html><body>{f'<{tag}>' * 20_000}<p>{SENTENCES[0]}</p><p>{SENTENCES[1]}</p>{f'</{tag}>' * 20_000}</body></html>"
        assert htmlmain.main_texts([page], model)[0] == f"{SENTENCES[0]}\n{SENTENCES[1]}"
