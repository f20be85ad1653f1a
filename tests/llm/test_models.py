"""Katz backoff, minimum cut, toxicity, perspectives and licenses against plain versions."""

import itertools
import math
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tidemark.llm import chat, html, katz, licenses, toxicity

from .conftest import bag
from .test_word_operators import alnum, spaced

HELD = "crc32(cast(doc_id as string)) % 5 = 1"
END, START = "\n", "\n\n"


class Plain:
    """The same model with dictionaries of tuples of words."""

    def __init__(self, texts, order=2):
        self.order, self.count, self.after, self.follow = order, defaultdict(Counter), Counter(), defaultdict(list)
        for t in texts:
            words = [START] * (order - 1) + [*spaced(t), END]
            for i in range(order - 1, len(words)):
                for n in range(1, order + 1):
                    gram = tuple(words[i - n + 1 : i + 1])
                    self.count[n][gram] += 1
                    self.after[gram[:-1]] += n > 1
        self.n = sum(self.count[1].values())
        self.d = {n: self.discount(self.count[n]) for n in self.count}
        for n in range(2, order + 1):
            for gram in self.count[n]:
                self.follow[gram[:-1]].append(gram[-1])
        self.p1 = {w: self.d[1][min(c, 6)] * c / self.n for (w,), c in self.count[1].items()}
        self.unknown = 1 - sum(self.p1.values())
        self.left = {}

    @staticmethod
    def discount(counts):
        n = Counter(counts.values())
        out, common = {6: 1.0}, 6 * n[6] / n[1] if n[1] else 1.0
        for r in range(1, 6):
            d = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] and common < 1 else 0
            out[r] = d if 0 < d < 1 else (r - 0.5) / r
        return out

    def backoff(self, v):
        """c(v) or c(v) + 1, and alpha."""
        if v not in self.left:
            n, seen = len(v) + 1, self.follow[v]
            lost = sum(self.count[n][*v, x] * (1 - self.d[n][min(self.count[n][*v, x], 6)]) for x in seen)
            total = self.after[v] + (lost <= 0)
            self.left[v] = total, (lost if lost > 0 else 1) / total / (1 - sum(self.p(x, v[1:]) for x in seen))
        return self.left[v]

    def p(self, w, v):
        if not v:
            return self.p1.get(w, self.unknown)
        if not self.after[v]:
            return self.p(w, v[1:])
        total, alpha = self.backoff(v)
        c = self.count[len(v) + 1][*v, w]
        return self.d[len(v) + 1][min(c, 6)] * c / total if c else alpha * self.p(w, v[1:])


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_katz_scores(clashing, rows, order):
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    model = Plain([t for d, t, _ in rows if not held(d)], order)
    v = len(model.count[1])
    for context in [(START,) * (order - 1), *itertools.islice((x for x in model.follow if len(x) == order - 1), 20), ("never seen",) * (order - 1)]:
        seen = sum(model.p(w, context) for (w,) in model.count[1]) + model.p("never seen", context)
        assert seen == pytest.approx(1, abs=1e-9)
    # shuffled, not cached: every run of the frame may order and deal out its rows in another way
    got = katz.scores(clashing.repartition(5, F.rand()), HELD, order, block_bytes=60_000).collect()
    got.sort(key=lambda r: (repr(r.doc_id), r.n_tokens, r.score))
    expect = []
    for d, t, _ in rows:
        words = [START] * (order - 1) + [*spaced(t), END]
        own = words[order - 1 :]
        base = sum(math.log10((model.count[1][w,] + 0.5) / (model.n + 0.5 * (v + 1))) for w in own)
        score = sum(math.log10(model.p(w, tuple(words[i : i + order - 1]))) for i, w in enumerate(own))
        expect.append((d, held(d), len(own), sum(model.count[1][w,] > 0 for w in own), model.n, base, score))
    expect.sort(key=lambda r: (repr(r[0]), r[2], r[-1]))
    for r, e in zip(got, expect, strict=True):
        assert tuple(r)[:5] == e[:5]
        assert r.base_score == pytest.approx(e[5], rel=1e-9) and r.score == pytest.approx(e[6], rel=1e-9)


def test_katz_without_training_or_documents(spark, no_docs):
    assert katz.scores(no_docs).count() == 0
    one = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert [r.score for r in katz.scores(one, "true").collect()] == [0.0, 0.0]
    assert all(math.isfinite(r.score) and r.score <= 0 for r in katz.scores(one).collect())


# --- minimum cut

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body>
<header class="site-header"><h1>Site name</h1></header><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">More long menu entry about things.</a></li></ul></nav>
<!-- an <p>old</p> comment --><div class="cookie-notice">We use cookies to make this page better for you, do you agree?</div>
<div id=content><article><header><h1>A   title</h1></header><p>First&nbsp;paragraph of text,<br>with <b>bold</b> &lt;words&gt; in it.<p>Be.</p>
<aside class="ad"><p>Buy our thing now, it is very good and costs little, buy it today.</p></aside><blockquote>A quote of some length, said by someone.</blockquote><ul><li>one item</li></ul></article>
<section class="comments"><h3>Comments</h3><p>I read this whole article and I have an opinion that is long enough.</p></section></div>
<form><label>Name</label><input name=x><p>Please fill in this form and send it to us soon.</p></form><footer>&copy; 2020 Someone. All rights are reserved here.</footer></body></html>"""


def test_article_text_of_a_page():
    assert html.main_text(PAGE) == "A title\n\nFirst paragraph of text, with bold <words> in it.\n\nBe.\n\nA quote of some length, said by someone.\n\none item"
    assert html.main_text(None) == html.main_text("") == html.main_text("<nav>x</nav>") == html.main_text("<") == ""
    assert html.main_text(PAGE[: PAGE.index("<aside")]).startswith("A title\n\nFirst")


def test_generated_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").withColumn("text", F.lit(1)).withColumn("n_chars", F.lit(2))
    odd = spark.createDataFrame([(None, None, None, 1, 2), (1, "u", "", 1, 2), (1, "u", "<p>" * 3000 + "x" * 50, 1, 2)], pages.schema)
    got = {}
    for r in html.extract(pages.unionByName(odd)).collect():
        got[r.page_id, r.url] = r.text
        assert r.n_chars == len(r.text)
    assert got[None, None] == ""
    import html as h

    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.DOTALL)[1]
        parts = [" ".join(h.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", b))).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert got[r.page_id, r.url] == "\n\n".join(b for b in parts if b)
    assert html.extract(pages.limit(0)).count() == 0


def test_names_that_only_describe_are_no_boilerplate():
    head, text = "A headline", "A paragraph that is long enough to be read as the text of this page."
    whole = [head, text]
    lines = lambda inner: html.main_text(f"<html><head><title>t</title></head>{inner}</html>").split()
    body = f"<h1>{head}</h1><p>{text}</p>"
    for page in (
        f'<body><article class="post hentry category-news tag-python">{body}</article></body>', f'<body class="single has-sidebar"><article>{body}</article></body>',
        f'<body class="no-sidebar search-results">{body}</body>', f'<body><main class="site-main main-menu">{body}</main></body>', f'<body><div class="post hentry tag-privacy category-legal">{body}</div></body>',
        f'<body><div class="content with-sidebar">{body}</div></body>', f'<body><article><div class="entry-header"><h1>{head}</h1></div><p>{text}</p></article></body>',
        f'<body><div class="content"><div class="article-header"><h1>{head}</h1></div><p>{text}</p></div></body>',
    ):
        assert lines(page) == " ".join(whole).split(), page
    shut = ("sidebar", "left-sidebar", "cookie-notice", "tag-list", "tags-links", "share-buttons", "site-header", "is-hidden", "entry-footer", "comment-list")
    for name in shut:
        assert lines(f'<body><article>{body}</article><div class="{name}"><p>{text}</p></div></body>') == " ".join(whole).split(), name
    assert lines(f'<body><article hidden>{body}</article></body>') == []
    assert lines(f'<body><article>{body}<div class="entry-header share"><p>{text}</p></div></article></body>') == " ".join(whole).split()


def test_tags_are_read_as_browsers_do():
    text = "A paragraph that is long enough to be read as the text of this page."
    for tag in ('<article aria-label="hidden gems">', '<article title="a hidden path" data-x=\'class="sidebar"\'>', '<article class="article-with-sidebar">', "<article class=post data-a=b/c>", '<article title="a > b">', "<article title='x\">'>"):
        assert html.main_text(f"<body>{tag}<p>{text}</p></article></body>") == text, tag
    assert html.main_text(f'<article><p title="5" x">{text}</p></article>') == text
    assert html.main_text(f'<article><p title=5"6>{text}</p><p class="never closed>{text}</p></article>') == f"{text}\n\n{text}"
    assert html.main_text(f"<article><p>{text}</p><!-- a --!><p>{text}</p></ x><?php y ?></article>") == f"{text}\n\n{text}"
    assert html.main_text(f"<article><p>1 < 2 &amp;&amp; 3 > 2. {text}</p></article>") == f"1 < 2 && 3 > 2. {text}"


def test_names_count_as_a_whole():
    for name in ("sidebar", "left-sidebar", "primarySidebar", "cookie-notice", "tag-list", "share-buttons", "site_header", "social-media", "comment-list", "ad", "ad-box", "newsletter-signup", "main-menu"):
        assert html.bad_word(name), name
    for name in ("search-engines", "research", "sidebar-layout", "has-sidebar", "article-with-sidebar", "tag-privacy", "header-fixed", "admin", "adventure", "comment-culture", "shareholders", "content", "menus-of-paris"):
        assert not html.bad_word(name), name


FRAMES = (
    '<body class="single has-sidebar"><div id="page"><div class="site-header"><a href="/">Name</a></div><div id="primary" class="content-area"><main>{}</main></div><div id="secondary" class="widget-area sidebar"><h2>Recent</h2><p>{}</p></div></div></body>',
    '<body><table><tr><td class="nav"><a href="/a">A</a> <a href="/b">B</a></td><td><div class="story">{}</div></td><td class="sidebar"><p>{}</p></td></tr></table></body>',
    '<body><div class="overlay"><article class="post hentry tag-search">{}</article><section id="comments"><h3>Two comments</h3><ol class="comment-list"><li><article class="comment"><p>{}</p></article></li></ol></section></div></body>',
    '<body><div class="wrap"><div class="search-engines">{}</div><div class="related-posts"><p>{}</p></div><div class="footer-links"><a href=x>Imprint</a></div></div></body>',
    '<body><nav><a href=x>Home</a></nav><div>{}</div><div role="dialog" class="consent-box"><p>{}</p><button>Accept</button></div><footer><p>All rights reserved by the makers of this page.</p></footer></body>',
    '<body>{}<aside><p>{}</p></aside></body>',
)


def test_precision_and_recall_on_varied_markup():
    """Blocks of six frames filled with articles of different lengths; every frame has one part that is no content."""
    rng, right, kept, wanted = np.random.default_rng(11), 0, 0, 0
    for i in range(240):
        sentence = lambda n: " ".join(rng.choice(["river", "stone", "house", "over", "light", "seldom", "under", "walks"], n)).capitalize() + "."  # noqa: E731, B023
        parts = ["A headline of words", *[sentence(int(rng.integers(8, 60))) for _ in range(rng.integers(2, 7))]]
        other = sentence(int(rng.integers(8, 30)))
        body = f"<h1>{parts[0]}</h1>" + "".join(f"<p>{x}</p>" for x in parts[1:])
        found = html.main_text("<html>" + FRAMES[i % len(FRAMES)].format(body, other) + "</html>").split("\n\n")
        right, kept, wanted = right + len(set(found) & set(parts)), kept + len([x for x in found if x]), wanted + len(parts)
    assert right / wanted >= 0.99 and right / kept >= 0.99, (right / wanted, right / kept)


def test_parts_without_telling_names():
    """Plain containers beside an article, and lists of it; names that tell in two words or in other languages."""
    head, text = "A headline", "A paragraph that is long enough to be read as the text of this page."
    body, whole = f"<h1>{head}</h1><p>{text}</p>", f"{head}\n\n{text}"
    plain = ("We use cookies to make this site better.", "Latest: ten ways to walk by a river", "© 2024 The makers of this page")
    for notice in plain:
        assert html.main_text(f"<body><div>{notice}</div><article>{body}</article></body>") == whole, notice
        assert html.main_text(f"<body><article>{body}</article><div>{notice}</div></body>") == whole, notice
    for notice in (plain[0], plain[2], "Copyright 2024 Someone. All rights reserved.", "Sign up for our newsletter and never miss a thing."):
        assert html.main_text(f"<body><div>{body}</div><div>{notice}</div></body>") == whole, notice
    for name in ("most-read", "feedback", "comentarios", "notification", "ad-slot", "most_popular", "mostRead", "trending-list"):
        assert html.main_text(f'<body><article>{body}<div class="{name}"><p>I agree with every word of this, it is so.</p></div></article></body>') == whole, name
    for items in (["first point", "second"], [f"point {i}" for i in range(40)]):
        lines = "".join(f"<li>{x}</li>" for x in items)
        for kind in ("ul", "ol"):
            assert html.main_text(f"<body><div>{body}<{kind}>{lines}</{kind}></div></body>") == "\n\n".join([whole, *items])
            assert html.main_text(f"<body><article>{body}<{kind}>{lines}</{kind}></article></body>") == "\n\n".join([whole, *items])
        links = "".join(f'<li><a href="{x}">{x}</a></li>' for x in items)
        assert html.main_text(f"<body><div>{body}</div><div><ul>{links}</ul></div></body>") == whole
    assert html.main_text(f"<body><article><p>{text} We use cookies, all rights reserved, is what pages say.</p></article></body>").endswith("say.")
    assert html.main_text(f"<body><div>{body}<p>Section 3.</p><p>{text}</p></div></body>") == f"{whole}\n\nSection 3.\n\n{text}"


def test_costs_follow_surroundings():
    found = html.blocks("<body><div><p>Some text.</p><ul><li>a<li>b</ul></div><ul><li>c</ul><li>d</body>")
    assert [x for _, x in html.surroundings(found)] == [False, True, True, False, False]
    assert found[1].container == found[2].container and found[1].around == found[0].container and found[4].around != found[0].container
    named = html.blocks("<article><p>Some text of words.</p></article><div>b</div><h1>c</h1>")
    assert [x for x, _ in html.surroundings(named)] == [False, True, False] and html.surroundings([]) == []
    assert not any(x for x, _ in html.surroundings(html.blocks(f"<div class=text>a</div><div>{'b ' * 50}</div>")))


def test_cut_has_least_cost():
    rng = np.random.default_rng(5)
    for _ in range(150):
        n = int(rng.integers(1, 8))
        source, sink = rng.integers(0, 6, n).astype(float).tolist(), rng.integers(0, 6, n).astype(float).tolist()
        edges = [(i, j, float(rng.integers(0, 4))) for i, j in itertools.combinations(range(n), 2) if rng.random() < 0.5]
        cost = lambda keep: sum(b if k else a for a, b, k in zip(source, sink, keep, strict=True)) + sum(c for i, j, c in edges if keep[i] != keep[j])  # noqa: B023, E731
        assert cost(html.max_flow(source, sink, edges)) == pytest.approx(min(map(cost, itertools.product((False, True), repeat=n))))


# --- toxicity


def made_texts(n, seed):
    rng, out = np.random.default_rng(seed), []
    stems = ["vilot", "grumb", "snark"]
    for i in range(n):
        words = ["".join(rng.choice(["ta", "le", "mi", "on", "er", "sh"], rng.integers(1, 4))) for _ in range(rng.integers(3, 200))]
        toxic = i % 3 == 0
        if toxic:
            for _ in range(rng.integers(1, 4)):
                words[rng.integers(len(words))] = str(rng.choice(stems)) + str(rng.choice(["", "ia", "ed", "ont", "Ers"]))
        out.append((" ".join(words), int(toxic)))
    return out


def test_network_learns_stems_and_gradients_hold():
    fit = toxicity.Fit()
    model = toxicity.train(*zip(*made_texts(600, 1), strict=True), fit)
    texts, labels = zip(*made_texts(300, 2), strict=True)
    predicted = toxicity.Scorer(model).worst(pa.array(texts)) >= 0.7
    assert (predicted == np.array(labels, bool)).mean() > 0.95


def test_gradient_of_the_network():
    fit, rng = toxicity.Fit(hidden=3, inputs=2), np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in toxicity._start(fit, rng).items()}
    x, mask = rng.standard_normal((4, 3, 2, 9)), np.array([[1, 1, 1], [1, 1, 1], [1, 0, 1], [1, 0, 0]], bool)
    p, saved = toxicity._forward(w, x, mask)
    grad, dx = toxicity._backward(w, saved, mask, p * (1 - p), x.shape)
    for name, key in (("u", (0, 1, 4)), ("u", (1, 2, 7)), ("b", (1, 8)), ("wa", (1, 2)), ("va", (1,)), ("wo", (4,))):
        moved = {k: v.copy() for k, v in w.items()}
        moved[name][key] += 1e-3
        up = toxicity._forward(moved, x, mask)[0].sum()
        moved[name][key] -= 2e-3
        assert (up - toxicity._forward(moved, x, mask)[0].sum()) / 2e-3 == pytest.approx(float(grad[name][key]), rel=0.05, abs=2e-4)


def test_scorer_equals_the_trained_network():
    texts = [t for t, _ in made_texts(40, 3)] + ["", None, "one"]
    model = toxicity.train(*zip(*made_texts(120, 1), strict=True), toxicity.Fit(epochs=1, least_steps=0))
    f = toxicity.Features(pa.array(texts, pa.string()))
    row, first, size, p = toxicity.Scorer(model)(pa.array(texts, pa.string()))
    x = toxicity._inputs(model, toxicity._find(model.words, f.keys), *f.known_grams(model.grams))
    gates = np.concatenate([np.zeros((1, 6 * model.fit.hidden), np.float32), x @ model.weights["wx"]]).reshape(-1, 2, 3 * model.fit.hidden)
    numbers, mask = f.window(first, size, int(size.max()))
    assert np.allclose(p, toxicity._forward(model.weights, gates[numbers], mask)[0], atol=1e-5)
    # every word lies in a window, and neighbouring windows overlap
    for r in range(len(texts)):
        spans = [(a, a + n) for a, n, i in zip(first, size, row, strict=True) if i == r]
        assert spans[-1][1] == f.words.rows[r + 1] and all(b[0] < a[1] for a, b in itertools.pairwise(spans))


def test_toxicity_of_documents(spark, clashing, rows, no_docs, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    texts, y = toxicity.sample(clashing, labels, "crc32(cast(doc_id as string)) % 3 = 1", rows=100)
    allowed = {t for d, t, _ in rows if d is not None and zlib.crc32(str(d).encode()) % 3 != 1}
    assert set(texts) <= allowed and 0 < len(texts) <= 100
    model = toxicity.train(texts, y, toxicity.Fit(epochs=1, least_steps=0))
    got = toxicity.scores(clashing, model)
    assert got.count() == len(rows) and got.where("score is null or score < 0 or score > 1").count() == 0
    kept = toxicity.accepted(clashing, model, at=0.5)
    assert kept.columns == clashing.columns and kept.count() == got.where("score < cast(0.5 as float)").count()
    assert toxicity.scores(no_docs, model).count() == 0
    some = toxicity.sampled(clashing, labels, "crc32(cast(doc_id as string)) % 3 = 1", rows=100)
    in_a_task = toxicity.fitted(some, toxicity.Fit(epochs=1, least_steps=0))
    assert all(np.allclose(in_a_task.weights[k], v, atol=1e-4) for k, v in model.weights.items()) and (in_a_task.grams == model.grams).all()
    assert not len(toxicity.fitted(toxicity.sampled(no_docs, labels)).words)
    blank = toxicity.train([], [])
    assert toxicity.scores(clashing, blank).select("score").distinct().count() == 1


# --- perspectives


def render(turns):
    """conv, speaker, turns, text, masks of plain rows."""
    convs = defaultdict(list)
    for conv, turn, role, text in turns:
        convs[conv].append((turn is None, turn or 0, role or "", role is None, text or "", role))
    out = []
    for conv, said in convs.items():
        for speaker in {r for *_, r in said if r is not None and r != "system"} or {None}:
            text, masks = "", []
            for *_, body, role in sorted(said, key=lambda s: s[:5]):
                own = role is not None and role == speaker
                head = "system" if role == "system" else "assistant" if own else f"user name={(role or 'unknown').replace('<|', '< |')}"
                text += f"<|{head}|>\n"
                start = len(text)
                text += body.replace("<|", "< |") + "<|end|>\n"
                masks += [f"{start}:{len(text)}"] if own else []
            out.append((conv, speaker, len(said), text, ",".join(masks)))
    return sorted(out, key=repr)


def test_perspectives(spark, sf_dir):
    turns = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    turns += [(1000, i, f"p{i % 3}", f"tęxt {i} <|end|>") for i in range(600)] + [(1001, 0, "system", "only system"), (1002, None, None, None), (1002, None, "a", "x"), (1002, -300, "a", "first"), (None, 0, "a", "y"), (None, 0, "b", None), (1003, 1, "a", "same"), (1003, 1, "a", "same")]
    turns += [(1004, None, f"q{i % 2}", f"late {i}") for i in range(350)] + [(1005, 7, f"q{i % 2}", f"equal {i % 90}") for i in range(250)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("speaker", F.lit("z")).withColumn("segment", F.lit(0)).repartition(5)
    rendered = chat.digest(chat.perspectives(df))
    expect = render(turns)
    assert bag(rendered) == expect
    plan = rendered._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert chat.perspectives(df.limit(0)).count() == 0
    # the pieces joined are the whole
    whole = defaultdict(list)
    for r in chat.segments(df, span=100).collect():
        whole[r.conv_id, r.speaker].append(r)
    joined = []
    for (conv, speaker), parts in whole.items():
        parts.sort(key=lambda r: r.segment)
        assert [r.segment for r in parts] == list(range(len(parts))) and max(r.n_turns for r in parts) <= 100
        joined.append((conv, speaker, sum(r.n_turns for r in parts), "".join(r.text for r in parts), ",".join(f"{m.start}:{m.end}" for r in parts for m in r.masks)))
    assert sorted(joined, key=repr) == expect


# --- licenses

PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def test_license_phrases(clashing, rows, no_docs):
    expect = []
    for d, t, _ in rows:
        words = alnum(t)
        places = sorted((i, label) for phrase, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
        expect.append((d, len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({x for _, x in places}))))
    got = licenses.digest(licenses.scans(clashing))
    assert bag(got.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")) == sorted(expect, key=repr)
    assert got.where("score < 0 or score > 1 or (n_base > 0 and score < 1)").count() == 0
    assert licenses.scans(no_docs).count() == 0


def test_license_templates(spark):
    filler = " ".join(f"word{i}" for i in range(300))
    rows = [(i, f"{filler} {text} {filler}") for i, (_, text, _) in enumerate(licenses.TEMPLATES)]
    bsd = next(text for label, text, _ in licenses.TEMPLATES if label == "bsd")
    rows += [(100, filler + " the software license is granted"), (101, bsd.replace("permitted", "allowed")), (102, bsd.replace("source and binary", "other")), (103, bsd.replace(" or without", ""))]
    mit = licenses.TEMPLATES[0][1].split()
    rows += [(104, " ".join(mit[:50] + ["and more words that someone added here"] + mit[50:])), (105, " ".join(mit[:20]))]
    got = {r.doc_id: r for r in licenses.digest(licenses.scans(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    for i, (label, _, _) in enumerate(licenses.TEMPLATES):
        assert label in got[i].labels.split(",") and got[i].score == pytest.approx(1)
    assert got[100].labels == got[102].labels == got[105].labels == "" and got[101].labels == got[103].labels == "bsd" and 0.7 <= got[101].score < 1
    assert got[104].labels == "mit" and got[104].score > 0.8


def test_licenses_in_files_that_hold_many_index_words(spark):
    """All texts in one file, and one complete text in prose made of the words of the others."""
    texts = {label: text for label, text, _ in licenses.TEMPLATES}
    words = sorted({w for text in texts.values() for w in licenses.plain_words(text)})
    prose = lambda seed: " ".join(np.random.default_rng(seed).permutation(words * 3))
    rows = [(0, " ".join(texts.values()), ",".join(sorted(texts))), (1, " filler ".join(texts[x] for x in ("mit", "apache", "bsd")), "apache,bsd,mit")]
    rows += [(2 + i, f"{prose(i)} {text} {prose(100 + i)}", label) for i, (label, text) in enumerate(texts.items())]
    got = licenses.scans(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()
    found = {r.doc_id: {x.label: x.score for x in r.found} for r in got}
    for i, _, labels in rows:
        assert set(labels.split(",")) <= set(found[i]) and all(found[i][x] == pytest.approx(1) for x in labels.split(","))
        assert ",".join(sorted(found[i])) == labels


def test_votes_lose_nothing_against_trying_every_place():
    """Parts found through the index are those found by aligning every part at every position of edited texts."""
    index, rng = licenses.Index.build(licenses.TEMPLATES, licenses.PHRASES), np.random.default_rng(2)
    number = {h: i for i, h in enumerate(index.vocabulary.tolist())}
    for i in range(40):
        words = ["start", *licenses.plain_words(licenses.TEMPLATES[i % len(licenses.TEMPLATES)][1]), "end"]
        for _ in range(int(rng.integers(0, len(words) // 3))):
            at = int(rng.integers(len(words)))
            words[at : at + int(rng.integers(0, 3))] = ["edit"] * int(rng.integers(0, 3))
        h = licenses.split(pa.array([" ".join(words)]), licenses.ALNUM).hashes().tolist()
        here = {at: number[x] for at, x in enumerate(h) if x in number}
        plain = {}
        for p, (_, _, own) in enumerate(index.part):
            full = sum(index.weight[w] for w in own)
            plain[p] = [(b, x) for b in range(-len(own) - 9, len(words) + 9) if (x := sum(index.weight[w] for i, w in enumerate(own) if any(here.get(b + i + d) == w for d in range(-3, 4)))) >= 0.7 * full - 1e-9]
        at, word = np.array(list(here)), np.array(list(here.values()))
        line = np.full(at[-1] + 1, -1, np.int32)
        line[at] = word
        found = index.found_parts(at, word, line, 3, 0.7)
        assert {(p, b) for p, x in found.items() for b, _ in x} == {(p, b) for p, x in plain.items() for b, _ in x}
        assert all(abs(x - y) < 1e-9 for p in found for (_, x), (_, y) in zip(found[p], plain[p], strict=True))
        here_, there = (index.combined(here, x, 3, 0.7) for x in (found, plain))
        assert [x[:2] for x in here_] == [x[:2] for x in there] and all(abs(a[2] - b[2]) < 1e-9 for a, b in zip(here_, there, strict=True))


def test_a_license_repeated_thousands_of_times_takes_seconds():
    index = licenses.Index.build(licenses.TEMPLATES, licenses.PHRASES)
    mit = next(text for label, text, _ in licenses.TEMPLATES if label == "mit")
    words = licenses.split(pa.array([(mit + " ") * 2000]), licenses.ALNUM).hashes()
    entry = np.minimum(np.searchsorted(index.vocabulary, words), len(index.vocabulary) - 1)
    at = np.flatnonzero(index.vocabulary[entry] == words)
    began = time.perf_counter()
    places, found = index.scan(at, entry[at], 3, 0.7)
    assert [x[:2] for x in found] == [(0, "mit")] and time.perf_counter() - began < 30


def test_windows_of_maxima():
    rng = np.random.default_rng(0)
    for n in (1, 2, 7, 40):
        found = sorted((int(b), float(x)) for b, x in zip(rng.integers(0, 60, n), rng.random(n), strict=True))
        bases = np.unique(rng.integers(-5, 70, 30))
        want = [max((x for b, x in found if abs(b - base) <= 6), default=0.0) for base in bases]
        assert licenses._greatest_near(found, bases, 6).tolist() == want


def test_toxicity_counts_pairs_of_many_words_and_many_texts():
    """Words times texts pass 32 bits."""
    n = 60_000
    model = toxicity.train(pa.array([f"word{i}" for i in range(n)]), np.zeros(n), toxicity.Fit(min_docs=1, most_words=None, most_grams=1000))
    assert len(model.words) == n
