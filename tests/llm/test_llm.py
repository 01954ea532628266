"""Training-data operators against brute force, exact round trips and held-out accuracy on small inputs."""

import hashlib
import itertools
import math
import random
import struct
import time
import zipfile
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wardline.llm import components, html_text, lm, mixing, near_dup, packing, quality, queries, substring, vectors, warc
from wardline.llm.common import save, table

DOCS = "doc_id long, text string, lang string, source string, n_chars long, __key long, bucket string, score double"


def make(spark, texts, source=lambda i: f"s{i % 3}"):
    """Documents with extra columns whose names clash with internal ones; texts: {id: text} or pairs."""
    pairs = list(texts.items()) if isinstance(texts, dict) else texts
    rows = [(i, t, "en", source(i or 0), len(t) if t is not None else None, 1, "b", 0.5) for i, t in pairs]
    return spark.createDataFrame(rows, DOCS)


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def corpus(seed=1, n=60):
    """Texts with copies, near copies, shared passages, ties, nulls and one very long text."""
    rng = random.Random(seed)
    passage = prose(rng, 70, 10_000)
    out = {i: prose(rng, rng.randrange(1, 160), 10_000) for i in range(n)}
    for i in range(10, 16):
        out[i] = out[9]
    for i in range(20, 30):
        w = out[19 if i < 25 else 24].split()
        w[rng.randrange(len(w))] = "edited"
        out[i] = " ".join(w)
    for i in range(30, 40):
        out[i] = f"{prose(rng, i, 10_000)} {passage}\n{prose(rng, 60, 10_000)}"
    out |= {50: None, 51: "", 52: " \t\n ", 53: "One two", 54: "one TWO", 55: prose(rng, 30_000, 5000), 56: out[55] if out[55] else "x"}
    return out


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_oracle(name, same):
    same(queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_components_of_random_graphs(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + k, 101 + k) for k in range(30)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    loops = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root(x) for x in parent if x not in loops}


# ---------------------------------------------------------------- packing


def test_packing_is_whole_and_tight(spark):
    texts = corpus()
    docs = make(spark, [*texts.items(), (3, texts[3])])  # a repeated row
    got = packing.pack(docs, packing.default_tokenizer(), 256).toPandas()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    want = Counter()
    for i, t in [*texts.items(), (3, texts[3])]:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), 256)):
            part = ids[at : at + 256]
            want[(i, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert Counter(got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == want
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s["length"].sum() <= 256 and (s["length"].cumsum() - s["length"] == s["offset"]).all()
    assert got["sequence_id"].nunique() <= 1.02 * math.ceil(got["length"].sum() / 256) + 1


def test_one_sweep_matches_like_brackets(spark):
    rng = random.Random(5)
    gaps, docs = [rng.randrange(1, 30) for _ in range(40)], [rng.randrange(1, 30) for _ in range(40)]
    largest = max(docs)
    events = sorted([(-g, 0) for g in gaps] + [(-d, 1) for d in docs])
    stack, matched = [], []
    for size, kind in events:
        if kind == 0:
            stack.append(-size)
        elif stack:
            matched.append((-size, stack.pop()))
    g = spark.createDataFrame(list(enumerate(gaps)), "bin long, gap long")
    d = spark.createDataFrame(list(enumerate(docs)), "uid long, length long")
    got = packing.match(d, g, largest).collect()
    assert sorted((r.length, gaps[r.bin]) for r in got) == sorted(matched)
    assert len({r.bin for r in got}) == len(got) and len({r.uid for r in got}) == len(got)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_the_tokenizer(monkeypatch, name):
    import public_tokenizers

    monkeypatch.setattr(packing, "CACHED", 5)
    coder = packing.Encoder(public_tokenizers.path(name))
    assert coder.by_words == name.startswith("word")
    texts = ["it's 'tis don't\u2026 \u00ab\u00e9,\u00bb \u0130, y 12a3 \uff13 \u0149 \u0133 ,\u2026 e\u0301\u0301 \u0391\u03a3, <|endoftext|> \u00df \u65e5\u672c\u8a9e\u3002 \U0001f44d\U0001f3fd!", "", "A\tB\x0bC d\x1ce", "x1 x1", "Plain, (Words) \u00c9t\u00e9 a-b_c! 7"]
    want = [np.array(coder.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert list(coder.encode(texts)) == want and list(coder.encode(texts)) == want


def test_encoder_keeps_few_words_between_tasks(spark, monkeypatch):
    """What idle workers hold is bounded, and ids are the same after a cache was cut."""
    monkeypatch.setattr(packing, "KEPT", 7)
    coder = packing.Encoder(packing.default_tokenizer())
    texts = [prose(random.Random(k), 200, 10_000) + " Plain words, and others." for k in range(3)]
    before = list(coder.encode(texts))
    coder.words.old = {b"older": coder.words[b"older"]}
    for c in (coder.words, coder.runs):
        c.trim()
        assert 0 < len(c) <= 7 and not c.old
    assert next(iter(coder.words)) == b"older" and list(coder.encode(texts)) == before


def test_packing_of_nothing(spark):
    assert packing.pack(make(spark, {}), packing.default_tokenizer()).count() == 0


# ---------------------------------------------------------------- html


def page(body, title="T"):
    return f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var t='</p><p>x</p>';</script></head><body>{body}</body></html>"


def alone(html):
    return html_text.own_text(html_text.page_events(html))


PAGES = [
    (1, "<nav><a>Menu</a></nav><div class=ad>Buy</div><article><h1>A &amp; B</h1><p>one\n two<b>three</b><p>four<br>five</article><footer>f</footer>", "A & B one twothree four five"),
    (2, "<header>Top</header><main><header>Title</header><p>x &lt;b&gt; y</p><section id=comments><p>hi</p></section><form>f</form></main><aside>s</aside>", "Title x <b> y"),
    (3, "<div class='sidebar'>s</div><div class=content><p>a<p>b</div><div class='cookie-notice'>c</div>", "a b"),
    (4, "<!-- c --><article><ul><li>a<li>b</ul><!-- x --><table><tr><td>c<td>d</table><script>z</script><p hidden>h</p></article>", "a b c d"),
    (5, "plain text", "plain text"),
]


def test_main_text_of_pages(spark):
    rows = [(i, f"http://h{i}.example/{i}", page(b), "x") for i, b, _ in PAGES] + [(6, None, None, "x"), (7, "", "", "x")]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, __host string")).collect()}
    assert got == {i: t for i, _, t in PAGES} | {6: "", 7: ""}


def test_template_text_goes_without_marked_elements(spark):
    rows = [(i, f"http://same.example/{i}", page(f"<div><span>Home</span><p>Menu text of the site</p></div><div id=c><p>story {i} told at length {i}</p></div><p>Imprint</p>")) for i in range(8)]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"story {i} told at length {i}" for i in range(8)}


def test_names_drop_no_main_text():
    body = "<p>The first long paragraph of the story.</p><section id=related-work><h2 class=search>Head</h2><p>Others.</p></section><div class='comments-area'>hi</div>"
    want = "The first long paragraph of the story. Head Others."
    for tag, name in [("div", "content has-sidebar"), ("article", "post no-comments"), ("article", "notice"), ("div", "legal")]:
        assert alone(page(f"<{tag} class='{name}'>{body}</{tag}><div class='site-footer'>f</div>")) == want
    for name in ("legal-status", "social-history", "search-algorithms", "recommendations"):
        assert alone(page(f"<main><p>Long text of the page.</p><section id={name}><p>a</p></section></main>")) == "Long text of the page. a"


def test_long_articles_keep_lists_quotes_and_tables():
    body = "".join(f"<p>Paragraph {i} of a story told at some length.</p>" for i in range(40))
    body += "<ul><li>item</ul><blockquote>quote</blockquote><table><tr><td>cell</table><div><p>deep</div>"
    for around in ("<div class=content>%s</div>", "<article>teaser</article><div class=content>%s</div>", "<div class=wrap><div class=content>%s</div></div>"):
        got = alone(page(around % body))
        assert got.endswith("length. item quote cell deep") and got.startswith("Paragraph 0 of") and "teaser" not in got
    assert alone(page("<table><tr><td>a<td>b</table>")) == "a b"


def test_partly_shared_boilerplate_goes(spark):
    rows = [(i, f"http://s.example/{i}", page(f"<div><p>story {i} told at some length {i}</p></div><p>Terms of use{' apply' if i < 4 else ''}</p>")) for i in range(10)]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"story {i} told at some length {i}" for i in range(10)}


def test_advert_longer_than_the_article_goes():
    """Only the host's other pages tell that the article is the main slot."""
    short = page("<div class=x>Buy the very best of all goods today and tomorrow.</div><div class=y><p>Brief.</p></div>")
    long_ = [page(f"<div class=x>Offer {i}.</div><div class=y><p>{'A long story. ' * 20}{i}</p></div>") for i in range(6)]
    assert alone(short).startswith("Buy") and html_text.block_texts([*long_, short])[-1] == "Brief."


def brute_classes(pages):
    """Valid equivalence classes by their definition, one comparison at a time."""
    least = max(html_text.LEAST, html_text.SHARE * len(pages))
    tokens = {t for p in pages for t in p}
    vector = {t: tuple(sum(x == t for x in p) for p in pages) for t in tokens}
    groups = {v: {t for t in tokens if vector[t] == v} for v in vector.values() if sum(n > 0 for n in v) >= least}
    valid = []
    for v, members in sorted(groups.items(), key=lambda g: (-sum(n > 0 for n in g[0]), -len(g[1]), min(g[1]))):
        seen = [[x for x in p if x in members] for p in pages]
        order = next(s for s in seen if s)[: len(members)]
        if len(members) < 2 or any(s != order * (len(s) // len(order)) for s in seen):
            continue
        fits = True
        for other in valid:
            gaps = set()
            for p in pages:
                if not members & set(p) or not set(other) & set(p):
                    continue
                passed, inside, total = 0, [], sum(x in other for x in p)
                for x in p:
                    passed += x in other
                    if x in members:
                        inside.append(None if passed in (0, total) else (passed - 1) % len(other))
                        if len(inside) % len(members) == 1:
                            began = passed
                        fits &= passed == began
                gaps |= set(inside)
            fits &= len(gaps) <= 1
        if fits:
            valid.append(order)
    return valid


def test_deduction_equals_brute_force():
    rng = random.Random(3)
    for _ in range(60):
        frame = [rng.choice(["<p>%s</p>", "<ul>%s</ul>", "<div class=a>Top %s bottom</div>", "Left %s right"]) for _ in range(rng.randrange(1, 4))]
        pages = []
        for _ in range(rng.randrange(4, 9)):
            inner = "".join(f"<li>item {rng.randrange(9)} of</li>" for _ in range(rng.randrange(4)))
            parts = [f % rng.choice([inner, f"w{rng.randrange(5)} w{rng.randrange(5)}"]) for f in frame]
            if rng.random() < 0.2:
                rng.shuffle(parts)
            pages.append(html_text.page_tokens(html_text.page_events(page("".join(parts)))))
        assert [list(c) for c in html_text.Template(pages).classes] == brute_classes(pages)


HOSTILE = {
    "nested": ("<div class=a>", "words of a page"), "no end": ("<a ", ""), "late quote": ("<a ", '">'), "long name": ("<a", ' ">'), "open quotes": ('<a "', ""),
    "inline": ("<b>x", ""), "headings": ("<h1>a", ""), "named": ("<div class=menu>a", ""), "script": ("<script></script", ""), "declarations": ("<!", ""),
    "crossed": ("<p><b><table><td><i></b></p>", ""),
}


@pytest.mark.parametrize("kind", HOSTILE)
def test_html_hostile_markup_takes_linear_time(kind):
    unit, tail = HOSTILE[kind]
    took = []
    for size in (1 << 15, 1 << 18):  # eight times as much: a quadratic parser takes 64 times as long
        began = time.perf_counter()
        html_text.block_texts([unit * (size // len(unit)) + tail, "<p>a</p>", "<p>b</p>", "<p>c</p>"])
        took.append(time.perf_counter() - began)
    assert took[1] < 24 * took[0] + 0.5


def test_html_tags_that_never_end_and_long_numbers():
    assert alone('a < b <i x="1>2">c</i> <a "d') == 'a < b c <a "d'
    assert alone("<p>a<!-- <p>b") == "a" and alone("<p>1 <2 <? x> 3</p>") == "1 <2 3"
    assert alone("<p>&#" + "9" * 5000 + "; &#" + "0" * 5000 + "65;") == "\ufffd A"
    deep = "<div>" * 5000 + "<nav>menu</nav>the text" + "</div>" * 5000
    assert alone(deep) == "the text"


def test_html_odd_tables(spark):
    names = "page_id long, url string, html string, host string, row string, block string, found string, blocks int, __fixed string"
    text = page("<article><p>" + "word " * 200_000 + "</p></article>")
    rows = [(1, "http://a.example/", text), (1, "http://a.example/", text), (None, None, page("<p>x</p>")), (2, "odd", None)]
    df = spark.createDataFrame([(*r, "h", "r", "b", "f", 1, "x") for r in rows], names)
    out = html_text.main_text(df, "found").collect()
    assert sorted((r.page_id or 0, len(r.found), r.host, r.row, r.block, r.blocks, r["__fixed"]) for r in out) == [(0, 1, "h", "r", "b", 1, "x"), (1, 999_999, "h", "r", "b", 1, "x"), (1, 999_999, "h", "r", "b", 1, "x"), (2, 0, "h", "r", "b", 1, "x")]
    assert html_text.main_text(df.limit(0)).count() == 0


# ---------------------------------------------------------------- quality


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(4)
    x = [rng.normal(size=(n, 3)) for n in (1, 4, 2)]
    w, trans = rng.normal(size=3), rng.normal(size=(2, 2))
    chains = quality.Chains(x)
    p, _ = chains.marginals(w, trans)
    for f, at in zip(x, chains.first, strict=True):
        z, good = 0.0, np.zeros(len(f))
        for labels in itertools.product((0, 1), repeat=len(f)):
            s = sum((f[i] @ w) * y for i, y in enumerate(labels)) + sum(trans[a, b] for a, b in itertools.pairwise(labels))
            z += math.exp(s)
            good += math.exp(s) * np.array(labels)
        assert p[at : at + len(f), 1] == pytest.approx(good / z)


def test_quality_learns_and_handles_odd_rows(spark):
    rng = random.Random(3)
    texts = {i: "\n".join(prose(rng, 12) + "." for _ in range(rng.randrange(1, 6))) if i % 3 else "\n".join("#%$ 123 @@@ !!! " * 4 for _ in range(3)) for i in range(120)}
    docs = make(spark, [*texts.items(), (500, None), (501, ""), (None, "words"), (502, "x " * 200_000)])
    labels = spark.createDataFrame([(i, 1 if i % 3 else 0, 0) for i in texts] + [(500, None, 0), (None, 1, 0), (999, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels).toPandas()
    assert len(got) == 124 and got["score"].between(0, 1).all()
    held = got[got["held_out"] & got["doc_id"].between(0, 119)]
    assert (held["predicted"] == (held["doc_id"] % 3 > 0)).all()
    empty = quality.classify(make(spark, {}), labels)
    assert empty.count() == 0
    assert set(quality.classify(docs, labels.limit(0)).select("score").distinct().toPandas()["score"]) == {0.5}


def test_quality_on_held_out_labels(spark, sf_dir):
    got = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).where("held_out").join(table(spark, sf_dir, "labels"), "doc_id").toPandas()
    assert len(got) and (got["predicted"] == got["quality"]).mean() > 0.9


# ---------------------------------------------------------------- substring


def brute_substring(texts, length):
    words = {i: (t or "").encode().split() for i, t in texts.items()}
    first = {}
    for i in sorted(words):
        for s in range(len(words[i]) - length + 1):
            first.setdefault(tuple(words[i][s : s + length]), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for s in range(len(w) - length + 1):
            if first[tuple(w[s : s + length])] < i:
                gone[s : s + length] = [True] * length
        out[i] = [x for x, g in zip(w, gone, strict=True) if not g]
    return words, out


@pytest.mark.parametrize(("seed", "chunk"), [(1, substring.CHUNK_WORDS), (7, 400)])
def test_substring_equals_brute_force(spark, monkeypatch, seed, chunk):
    monkeypatch.setattr(substring, "CHUNK_WORDS", chunk)
    texts = corpus(seed)
    words, kept = brute_substring(texts, 50)
    docs = make(spark, [*texts.items(), (9, texts[9]), (None, texts[9])])
    got = substring.digest(docs).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        if r.doc_id is None:
            assert r.n_removed == 0
        else:
            k = kept[r.doc_id]
            assert (r.n_words, r.n_removed, r.kept_sha256) == (len(words[r.doc_id]), len(words[r.doc_id]) - len(k), hashlib.sha256(b" ".join(k)).hexdigest())
    out = {r.doc_id: r for r in substring.dedup_text(make(spark, texts)).collect()}
    assert all((out[i].text == t) if len(kept[i]) == len(words[i]) else (out[i].text.encode() == b" ".join(kept[i])) for i, t in texts.items())
    assert out[1].bucket == "b" and substring.digest(make(spark, {})).count() == 0


def test_anchors_cover_every_window():
    rng = random.Random(8)
    words = [b"%d" % rng.randrange(5) for _ in range(300)]
    h = substring.Hashes(words)
    _, lo, hi = substring.anchors(h, 300, 50, 12)
    assert lo[0] == 0 and hi[-1] == 250 and (lo[1:] == hi[:-1] + 1).all()


# ---------------------------------------------------------------- near duplicates


def brute_near(texts, n):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    parent = {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(texts, 2):
        c = len(sets[a] & sets[b])
        if c and 100 * c >= 80 * (len(sets[a]) + len(sets[b]) - c):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in texts}


@pytest.mark.parametrize("n", [4, 5])
def test_near_duplicates_equal_brute_force(spark, n):
    texts = corpus(3)
    docs = make(spark, [*texts.items(), (9, texts[9]), (None, texts[9])])
    got = near_dup.near_duplicates(docs, n=n).collect()
    want = brute_near(texts, n)
    assert len(got) == len(texts) + 2
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], r.doc_id == want[r.doc_id][1])
    assert near_dup.near_duplicates(make(spark, {})).count() == 0


@pytest.mark.parametrize("small", [near_dup.SMALL, 3])
def test_family_of_uneven_copies(spark, monkeypatch, small):
    """Copies with few and many edits, cut short and drawn out: links that miss the centre count."""
    monkeypatch.setattr(near_dup, "SMALL", small)
    rng = random.Random(11)
    base = prose(rng, 120, 10_000).split()
    texts = {}
    for i in range(150):
        w = list(base)
        for _ in range(rng.randrange(0, 8)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(40)}"
        if i % 4 == 0:
            w = w[: len(w) - rng.randrange(0, 25)]
        if i % 7 == 0:
            w += [f"x{k}" for k in range(rng.randrange(0, 25))]
        texts[i] = " ".join(w)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(make(spark, texts), n=4).collect()}
    assert got == brute_near(texts, 4)


def test_large_family_makes_no_pairs(spark, monkeypatch):
    """2000 copies of one text, half of them edited too much to be like any other: what a round
    writes follows the members, not their pairs."""
    rng = random.Random(12)
    base = prose(rng, 150, 10_000).split()
    texts = {}
    for i in range(2000):
        w = list(base)
        for _ in range(rng.randrange(0, 12)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(300)}"
        texts[i] = " ".join(w)
    rows = []
    counted = lambda f: lambda *a, **k: rows.append((out := near_dup.save(f(*a, **k))).count()) or out
    for name in ("spread", "overlaps", "within_small"):
        monkeypatch.setattr(near_dup, name, counted(getattr(near_dup, name)))
    monkeypatch.setattr(near_dup, "SMALL", 64)
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(make(spark, texts), n=4).collect()}
    sets = [near_dup.shingles(t, 4) for t in texts.values()]
    known, at = np.unique(np.concatenate(sets), return_inverse=True)
    has = np.zeros((2000, len(known)), np.float32)
    has[np.repeat(np.arange(2000), [len(s) for s in sets]), at] = 1
    common, size = has @ has.T, has.sum(axis=1)
    linked = 100 * common >= 80 * (size[:, None] + size - common)
    label = np.arange(2000)
    while (new := np.array([label[near].min() for near in linked])).tolist() != label.tolist():
        label = new
    assert [got[i] for i in range(2000)] == label.tolist() and len(set(label)) > 500
    assert max(rows) < 20 * 2000


def test_large_groups_are_settled_in_one_step(spark, monkeypatch):
    """However many copies a text has, sets are compared with centres once; what is left goes by pairs of blocks."""
    looks, overlaps = [], near_dup.overlaps
    monkeypatch.setattr(near_dup, "overlaps", lambda *a: looks.append(1) or overlaps(*a))
    for name, value in {"SMALL": 8, "BLOCK": 32, "COLUMNS": 64}.items():
        monkeypatch.setattr(near_dup, name, value, raising=False)
    rng = random.Random(13)
    base = prose(rng, 120, 10_000).split()
    texts = {}
    for i in range(300):
        w = list(base)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(300)}"
        texts[i] = " ".join(w)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(make(spark, texts), n=4).collect()}
    assert got == brute_near(texts, 4) and len({c for _, c in got.values()}) > 20
    assert len(looks) == 1


def test_bitmap_keeps_wanted_ids(spark, monkeypatch):
    """Every wanted row passes the bitmap, negative ids too, and few others do."""
    docs = spark.range(-5000, 5000).selectExpr("id AS doc_id", "'x' AS text")
    wanted = docs.where("doc_id % 7 = 3").select("doc_id")
    got = near_dup.likely(docs, wanted)
    assert got.join(wanted, "doc_id").count() == wanted.count() and got.count() < 1.1 * wanted.count()


def test_min_and_max_estimate_similarity():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 1 << 63, 1000, dtype=np.uint64))
    b = np.concatenate([a[:800], np.unique(rng.integers(0, 1 << 63, 200, dtype=np.uint64))])
    same = (near_dup.signature(a) == near_dup.signature(b)).mean()
    assert same == pytest.approx(800 / 1200, abs=0.15)


# ---------------------------------------------------------------- language model


def brute_base(texts):
    words = {i: (t or "").encode().lower().split() + [b""] for i, t in texts.items()}
    c = Counter(w for i, ws in words.items() if zlib.crc32(str(i).encode()) % 10 for w in ws)
    n, v = sum(c.values()), len(c)
    return words, c, n, {i: sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws) for i, ws in words.items()}


@pytest.mark.parametrize("tokens", [15_000, 1_000_000])
def test_lm_counts_and_base(spark, monkeypatch, tokens):
    monkeypatch.setattr(lm, "BUCKET_TOKENS", tokens)
    texts = corpus(2)
    words, c, n, base = brute_base(texts)
    got = lm.score(make(spark, texts)).collect()
    assert len(got) == len(texts)
    for r in got:
        w = words[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(x in c for x in w), n)
        assert r.base_score == pytest.approx(base[r.doc_id]) and r.score < 0
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def one_bucket(pairs):
    """A bucket of all cells of {(word, before): count}, numbered words and contexts."""
    words = sorted({w for w, _ in pairs})
    w, b, n = (np.array(x, np.int64) for x in zip(*((w, b, c) for (w, b), c in sorted(pairs.items())), strict=True))
    part = pd.DataFrame([{
        "bucket": 0, "chunk": 0, "mark": 0, "words": np.array(words, np.uint64).tobytes(), "runs": lm.small(np.unique(w, return_counts=True)[1]),
        "before": lm.narrow(b, 6), "n": lm.small(n),
    }])
    built = lm.build_bucket(part, 3)
    sums = np.frombuffer(built["sums"].iloc[1], np.int64)
    names = lm.wide(built["names"].iloc[1], 6)
    return lm.Bucket(next(built.iloc[:1].itertuples()), sums), words, names


def mixed_pairs(seed, words=12, contexts=6, cells=40):
    rng = random.Random(seed)
    return {(rng.randrange(words), rng.randrange(contexts)): rng.choice([1, 1, 1, 2, 3, 9, 40]) for _ in range(cells)}


def test_lm_probabilities_sum_to_one():
    """Over the vocabulary and the unseen word, for every restaurant, after sweeps."""
    pairs = mixed_pairs(2) | {(13, 5): 0}
    b, words, names = one_bucket(pairs)
    tables, up = b.start()
    for k in range(1, 4):
        whole = (int(up.sum()), int(b.guests(tables).sum()))
        tables, up = b.sweep(k, tables, up, b.by_room(tables), whole)
        assert (tables >= np.minimum(b.n, 1)).all() and (tables <= b.n).all() and (up <= b.guests(tables)).all()
    whole, rooms, customers = (int(up.sum()), int(b.guests(tables).sum())), b.by_room(tables), b.by_room(b.n)
    p = b.predict(tables, up, rooms, customers, whole)
    parent = b.parent(b.guests(tables), up, whole)
    (d, up_d), (s, up_s) = b.discount, lm.STRENGTH
    unseen = (up_s + up_d * whole[0]) * lm.UNSEEN / (up_s + whole[1])
    for u in range(len(names)):
        back_off = (s + d * rooms[u]) / (s + customers[u])
        known = p[b.room == u].sum() + sum(back_off * parent[w] for w in range(len(words)) if b.count[w] and w not in b.word[b.room == u])
        known -= sum(p[(b.room == u) & (b.count[b.word] == 0)])
        assert known + back_off * unseen == pytest.approx(1.0)


def test_seat_draws_from_the_joint_distribution():
    """Exact odds of each number of tables by recursion over the customers; large dishes by their mean."""
    rng = np.random.default_rng(1)
    for n, first, more, d in [(2, 0.3, 0.1, 0.6), (7, 1.5, 0.2, 0.5), (40, 4.0, 0.05, 0.8), (300, 0.8, 0.4, 0.3)]:
        odds = np.array([0.0, 1.0])
        for i in range(1, n):
            t = np.arange(len(odds))
            odds = np.append(odds * (i - d * t), 0) + np.concatenate([[0], odds * (first + more * t)])
            odds /= odds.sum()
        got = np.bincount(lm.seat(rng, np.full(40_000, n), np.full(40_000, first), np.full(40_000, more), d), minlength=len(odds)) / 40_000
        assert np.abs(got - odds).sum() < 0.08
    for first, more in [(3.0, 0.0), (8.0, 0.05)]:
        f, m, n = np.full(3000, first), np.full(3000, more), np.full(3000, 9000)
        want = lm._exact(rng.random(3000), n, f, m, 0.5, 120, np.ones(3000))
        got = lm.seat(rng, n, f, m, 0.5)
        assert got.mean() == pytest.approx(want.mean(), rel=0.04) and got.std() == pytest.approx(want.std(), rel=0.1)


def plain_sampler(pairs, discount, vocabulary, rounds, seed):
    """Textbook sampler: one customer at a time leaves its table and sits down again.  Averaged p(word | context)."""
    rng, (d, du), (s, su) = random.Random(seed), discount, lm.STRENGTH
    base = (1 - lm.UNSEEN) / vocabulary
    rooms, top = {}, {}  # tables of a dish: list of sizes

    def p_top(w):
        mine, g, t = top.get(w, []), sum(map(sum, top.values())), sum(map(len, top.values()))
        return (sum(mine) - du * len(mine) + (su + du * t) * base) / (su + g)

    def p_room(w, b):
        room = rooms.get(b, {})
        n, t, mine = sum(map(sum, room.values())), sum(map(len, room.values())), room.get(w, [])
        return (sum(mine) - d * len(mine) + (s + d * t) * p_top(w)) / (s + n)

    def sit(tables, new, discount):
        odds = [x - discount for x in tables] + [new]
        k = rng.choices(range(len(odds)), odds)[0]
        if k == len(tables):
            tables.append(0)
        tables[k] += 1
        return tables[k] == 1

    def leave(tables):
        k = rng.choices(range(len(tables)), tables)[0]
        tables[k] -= 1
        if not tables[k]:
            del tables[k]
            return True
        return False

    def add(w, b):
        room = rooms.setdefault(b, {})
        t = sum(map(len, room.values()))
        if sit(room.setdefault(w, []), (s + d * t) * p_top(w), d):
            sit(top.setdefault(w, []), (su + du * sum(map(len, top.values()))) * base, du)

    everyone = [c for c, n in pairs.items() for _ in range(n)]
    for w, b in everyone:
        add(w, b)
    sums, count = Counter(), 0
    for r in range(rounds):
        for w, b in everyone:
            if leave(rooms[b][w]):
                leave(top[w])
            add(w, b)
        if r >= rounds // 4:
            count += 1
            for w, b in pairs:
                sums[(w, b)] += p_room(w, b)
    return {c: sums[c] / count for c in pairs}


def test_lm_agrees_with_a_textbook_sampler():
    pairs = mixed_pairs(7, cells=30)
    b, words, names = one_bucket(pairs)
    total, count = np.zeros(len(b.n)), 0
    tables, up = b.start()
    for k in range(1, 400):
        whole = (int(up.sum()), int(b.guests(tables).sum()))
        tables, up = b.sweep(k, tables, up, b.by_room(tables), whole)
        if k > 50:
            whole = (int(up.sum()), int(b.guests(tables).sum()))
            total, count = total + b.predict(tables, up, b.by_room(tables), b.by_room(b.n), whole), count + 1
    want = plain_sampler(pairs, b.discount, b.vocabulary, 300, 3)
    for w, u, p in zip(b.word, b.room, total / count, strict=True):
        assert p == pytest.approx(want[(words[w], int(names[u]))], rel=0.1)


def test_lm_gives_every_previous_word_its_own_restaurant(spark, monkeypatch):
    """Each of 400 words, all equally frequent, settles the next one: no context may be pooled with another."""
    monkeypatch.setattr(lm, "BUCKET_TOKENS", 2000)
    rng = random.Random(5)
    after = {i: f"b{i * 7 % 400}" for i in range(400)}
    texts = {i: " ".join(f"a{k} {after[k]}" for k in rng.sample(range(400), 40)) for i in range(150)}
    texts |= {1000: "a1", 1001: "a1 " + after[1], 1002: "a399", 1003: "a399 " + after[399], 1004: "a399 " + after[1]}
    got = {r.doc_id: r for r in lm.score(make(spark, texts)).collect()}
    rooms = [(got[i].score - got[i].base_score) / got[i].n_tokens for i in range(150) if got[i].held_out]
    assert len(rooms) > 5 and min(rooms) > 0.9  # half of the words are near certain, the other half are as rare as their base
    assert got[1003].score > got[1004].score + 1.5


@pytest.mark.parametrize("cuts", [[(0, 6)], [(1, 3), (4, 2)], [(2, 4)]])
def test_lm_tokens_equal_split(cuts):
    import pyarrow as pa

    texts = pa.array([" A\u00c0 b\tc  ", None, "", "\u00a0x\u2003y \x1cZ", " \n", "Long " * 50])
    cut = pa.chunked_array([texts.slice(*c) for c in cuts])
    words, number, size = lm.tokens(cut)
    got = [words[i] for i in number]
    assert got == [w for t in cut.to_pylist() for w in [*(t or "").encode().lower().split(), b""]]
    assert size.tolist() == [len((t or "").encode().split()) + 1 for t in cut.to_pylist()]


def test_lm_odd_tables(spark):
    assert lm.score(make(spark, {})).count() == 0
    got = lm.score(make(spark, [(1, "a b"), (1, "a b"), (None, None), (2, "a c")])).collect()
    assert len(got) == 4 and len({r.score for r in got if r.doc_id == 1}) == 1


def test_lm_scores_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm, "BUCKET_TOKENS", 4000)
    texts = corpus(6)
    one, seven = ({r.doc_id: r.score for r in lm.score(save(make(spark, texts).repartition(n))).collect()} for n in (1, 7))
    assert one == pytest.approx(seven)


def test_lm_small_numbers():
    x = np.array([0, 1, 254, 255, 256, 10**12])
    assert lm.unsmall(lm.small(x), 6).tolist() == x.tolist() and lm.wide(lm.narrow(x, 6), 6).tolist() == x.tolist()


# ---------------------------------------------------------------- WARC


def test_warc_round_trip(spark):
    rows = [(1, "u", "same"), (2, "u2", "same"), (3, None, None), (4, "u4", ""), (5, "u5", "é\r\n\r\n" * 50_000), (2, "u2", "same"), (None, "n", "same"), (None, "m", "lone")]
    pages = spark.createDataFrame([(*r, 9) for r in rows], "page_id long, url string, html string, path int")
    from wardline.llm.common import shared_folder

    packages = warc.write_packages(pages, shared_folder(spark), package_bytes=200)
    assert packages.count() > 1
    got = warc.read_records(warc.read_index(packages)).collect()
    assert len(got) == len(rows)
    by = Counter((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in got)
    one = {h: (len((h or "").encode()), warc.digest32((h or "").encode())) for _, _, h in rows}
    want = Counter()
    for i, _, h in rows:
        first = {"same": 1, None: 3, "": 3, "lone": None}.get(h, i)
        want[(i, "response" if i == first else "revisit", None if i == first else first, *one[h])] += 1
    assert by == want
    assert {bytes(r.payload).decode() for r in got if r.record_type == "response" and r.page_id == 5} == {"é\r\n\r\n" * 50_000}
    small = warc.round_trip(spark, pages, min_bytes=5)
    assert {r.record_type for r in small.collect()} == {"response"}
    assert warc.round_trip(spark, pages.limit(0)).count() == 0


def test_zip64_directory(tmp_path):
    path = tmp_path / "x.zip"
    with zipfile.ZipFile(path, "w") as z, z.open("a", "w", force_zip64=True) as m:
        m.write(b"hello")
    plain = path.read_bytes()
    offset, size, n = (lambda e: (struct.unpack_from("<I", plain, e + 16)[0], struct.unpack_from("<I", plain, e + 12)[0], 1))(plain.rfind(warc.END))
    entry = bytearray(plain[offset : offset + size])
    struct.pack_into("<II", entry, 20, warc.MARK32, warc.MARK32)
    struct.pack_into("<I", entry, 42, warc.MARK32)
    extra = struct.pack("<HHQQQ", 1, 24, 5, 5, 0)
    struct.pack_into("<H", entry, 30, len(extra))
    entry = bytes(entry[:46]) + b"a" + extra
    end64 = warc.END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, len(entry), offset)
    locator = warc.LOCATOR64 + struct.pack("<IQI", 0, offset + len(entry), 1)
    end = warc.END + struct.pack("<HHHHIIH", 0, 0, warc.MARK16, warc.MARK16, warc.MARK32, warc.MARK32, 0)
    path.write_bytes(plain[:offset] + entry + end64 + locator + end)
    with path.open("rb") as f:
        begin, length = warc.members(f, path.stat().st_size)["a"]
        assert warc.read_at(f, begin, length) == b"hello"


# ---------------------------------------------------------------- vectors


def clusters(seed=1, dim=16):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(12):
        centre = rng.normal(size=dim)
        rows += [centre + rng.normal(size=dim) * s for s in rng.uniform(0, 0.5, 12)]
    rows += [rows[0], rows[0], 3 * rows[1], np.zeros(dim)]
    return [(i, [float(x) for x in v]) for i, v in enumerate(rows)]


def test_vector_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BUCKET", 8)
    rows = clusters()
    odd = [(900, None), (901, [1.0, None] * 8), (902, [float("nan")] * 16), (903, [1.0, 2.0]), (904, [1.0, 2.0]), (None, rows[0][1]), (905, [])]
    df = spark.createDataFrame([(*r, 5) for r in [*rows, *odd]], "vec_id long, embedding array<double>, key int")
    got = {r.vec_id: r for r in vectors.near_duplicates(df, target=0.99999).collect()}
    x = np.array([v for _, v in rows])
    norm = np.linalg.norm(x, axis=1)
    with np.errstate(invalid="ignore"):
        linked = (x @ x.T) >= 0.95 * np.outer(norm, norm)
    linked &= (norm[:, None] > 0) & (norm[None] > 0)
    np.fill_diagonal(linked, False)
    assert [got[i].n_links for i in range(len(rows))] == linked.sum(axis=1).tolist()
    reach = np.linalg.matrix_power(linked.astype(float) + np.eye(len(x)), len(x)) > 0
    assert [got[i].component_id for i in range(len(rows))] == [int(np.flatnonzero(r)[0]) for r in reach]
    assert (got[903].n_links, got[904].component_id, got[900].n_links, got[902].component_id) == (1, 903, 0, 902)
    assert vectors.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("size", [1e-200, 1.0, 1e200])
def test_vector_links_at_any_magnitude(size):
    x = np.array([[1.0, 0.0], [0.0, 1.0], [1.0, 0.1], [-1.0, 0.0]]) * size
    x[2] *= 1e3  # the cosine does not depend on length
    pairs = [(int(a), int(b)) for i, j in vectors.linked_pairs(x, np.zeros(4, int), 0, 0, 0.95) for a, b in zip(i, j, strict=True)]
    assert pairs == [(0, 2)]


def test_vector_links_at_the_production_target(spark):
    """64 dimensions, pairs just above the threshold: what the tables miss, and nothing below it."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(2500, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    cos = rng.uniform(0.9502, 0.965, 900)[:, None]
    side = rng.normal(size=(900, 64))
    side -= (side * x[:900]).sum(axis=1)[:, None] * x[:900]
    side /= np.linalg.norm(side, axis=1)[:, None]
    x = np.concatenate([x, cos * x[:900] + np.sqrt(1 - cos**2) * side])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in vectors.near_duplicates(df).collect()}
    want = ((x @ x.T) >= 0.95).sum(axis=1) - 1
    assert all(got[i] <= n for i, n in enumerate(want.tolist()))
    assert sum(got.values()) >= 0.99 * want.sum() and want.sum() >= 1800


@pytest.mark.parametrize("scale", [1, 100_003, 10**7])
def test_top_k_equals_brute_force(spark, monkeypatch, scale):
    monkeypatch.setattr(vectors, "BLOCK", 40)
    monkeypatch.setattr(vectors, "QUERIES", 3)
    rng = np.random.default_rng(6)
    x = rng.integers(-20 * scale, 20 * scale, (150, 8))
    x[30] = x[31] = x[32]
    rows = [(i, [int(v) for v in r]) for i, r in enumerate(x)] + [(200, [1, 2])]
    df = spark.createDataFrame(rows, "id long, vec array<long>")
    got = {}
    for r in vectors.exact_top_k(df, df.where("id % 20 = 0"), 7).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    for q in range(0, 150, 20):
        best = sorted(((int(x[q] @ x[i]), -i) for i in range(150) if i != q), reverse=True)[:7]
        assert got[q] == {k + 1: (-i, s) for k, (s, i) in enumerate(best)}
    assert 200 not in got and vectors.exact_top_k(df.limit(0), df.limit(0), 7).count() == 0


def test_top_k_sends_no_blocks_through_the_driver(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 40)
    monkeypatch.setattr(vectors, "QUERIES", 3)
    x = np.random.default_rng(7).integers(-20, 20, (150, 8))
    df = spark.createDataFrame([(i, [int(v) for v in r]) for i, r in enumerate(x)], "id long, vec array<long>")
    joined = vectors.exact_top_k(df, df.where("id % 20 = 0"), 7)
    assert joined.count() == 8 * 7
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


# ---------------------------------------------------------------- mixing


def test_targets_fill_like_water(spark):
    sizes = {"a": 10, "b": 1000, "c": 500, None: 3, "e": 0}
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: k % 3 + 1 for k, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(sizes.values()))
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] >= 3 * sizes[s]}
        if not over:
            target |= share
            break
        target |= {s: 3.0 * sizes[s] for s in over}
        left -= sum(3 * sizes[s] for s in over)
        open_ -= over
    assert got == pytest.approx(target)


def test_mix_reaches_targets_with_null_and_equal_ids(spark):
    """Half of the ids null, a third of the rows all alike, and columns with the names used inside."""
    rng = random.Random(6)
    pairs = [(None if i % 2 else i, prose(rng, rng.randrange(1, 30))) for i in range(200)] + [(5, "the same words again")] * 100 + [(None, "void of id")] * 30
    docs = make(spark, pairs, lambda i: f"s{i % 2}")
    for c in ("epochs", "at", "last", "s", "row", "key", "id", "print", "src", "weight", "more", "size", "copies", "target", "__end"):
        docs = docs.withColumn(c, F.lit("own"))
    results = []
    for n in (1, 7):
        out = mixing.mixed_rows(docs.repartition(n)).select("row.*", *(F.col(c).alias("mix_" + c) for c in mixing.OWN)).toPandas()
        assert len(out) == len(pairs) and (out[["size", "copies", "epochs"]] == "own").all(axis=None)
        for _, part in out.groupby("source"):
            assert abs(part["mix_taken"].sum() - part["mix_target"].iloc[0]) <= part["mix_size"].max()
        results.append(sorted(map(str, out[["doc_id", "text", "mix_taken"]].itertuples(index=False))))
    assert results[0] == results[1]
    plain = mixing.weighted_mix(docs)
    assert set(plain.columns) == set(docs.columns) | set(mixing.OWN) and plain.first()["size"] != "own"


def test_mix_takes_targets_and_repeats(spark):
    rng = random.Random(4)
    pairs = [(i, prose(rng, rng.randrange(0, 50))) for i in range(300)] + [(400, None), (None, "a b c"), (7, "x y")]
    docs = make(spark, pairs, lambda i: None if i % 11 == 0 else f"s{min(i % 7, 2)}")
    runs = [sorted(map(str, mixing.weighted_mix(docs.repartition(n), buckets=b).collect())) for n, b in ((1, 1024), (5, 1024), (3, 4))]
    assert runs[0] == runs[1] == runs[2]
    out = mixing.weighted_mix(docs).toPandas()
    assert len(out) == len(pairs) and (out["taken"] <= 3 * out["size"]).all() and (out["taken"] == out["copies"] * out["size"]).all()
    for _, s in out.groupby("source", dropna=False):
        assert abs(s["taken"].sum() - s["target"].iloc[0]) <= s["size"].max()
    assert out["source_size"].groupby(out["source"], dropna=False).nunique().eq(1).all()
    assert mixing.weighted_mix(docs.limit(0)).count() == 0


# ---------------------------------------------------------------- pipeline


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    import corpus_pipeline as P

    rng = random.Random(9)
    texts = {i: t for i, t in corpus(9).items()}
    for i in range(100, 140):
        texts[i] = "\n".join("%%% ### 12345 $$$ @@@" for _ in range(rng.randrange(3, 9)))
    for i in range(140, 180):
        texts[i] = "\n".join(prose(rng, 15, 10_000) + "." for _ in range(4))
    rows = [(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 0 if 100 <= i < 140 else 1, 0) for i in texts if i >= 100 or i < 50]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = table(spark, str(tmp_path), "documents")
    assert [n for n, _ in P.STAGES] == ["quality classifier", "near-duplicate removal", "substring removal", "mixing", "packing"]
    kept = {r.doc_id: r.text for r in P.quality_filter(spark, docs, "x" and str(tmp_path)).collect()}
    assert not any(100 <= i < 140 for i in kept) and all(i in kept for i in range(140, 180))
    stage = docs.where(F.col("doc_id").isin(list(kept)))
    near = P.near_dedup(spark, stage, str(tmp_path))
    want = {i for i, (_, c) in brute_near(kept, 5).items() if i == c}
    assert near.columns == docs.columns and {r.doc_id for r in near.collect()} == want
    _, left = brute_substring({i: kept[i] for i in want}, 50)
    cut = P.substring_dedup(spark, near, str(tmp_path))
    assert cut.columns == docs.columns and {r.doc_id: len((r.text or "").split()) for r in cut.collect()} == {i: len(w) for i, w in left.items()}
    mixed = P.mix(spark, cut, str(tmp_path))
    assert mixed.columns == docs.columns
    copies = Counter(r.doc_id for r in mixed.collect())
    assert copies and max(copies.values()) <= 3
    odd = docs.withColumn("__score", F.lit("own")).withColumn("row", F.lit("own"))
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, odd, str(tmp_path))
        assert out.columns == odd.columns and out.where("__score <> 'own' OR row <> 'own'").isEmpty()
        assert stage(spark, docs.limit(0), str(tmp_path)).isEmpty()
    packed = P.run(spark, str(tmp_path)).toPandas()
    assert Counter(packed[packed["piece"] == 0]["doc_id"].tolist()) == copies
    assert packed.groupby("sequence_id")["length"].sum().max() <= 2048


def shuffled(df):
    """Rows that the exchanges of the last plan of ``df`` wrote."""
    df.collect()
    n, nodes = 0, [df._jdf.queryExecution().executedPlan().executedPlan()]
    while nodes:
        x = nodes.pop()
        if x.nodeName() == "Exchange":
            n += x.metrics().get("shuffleRecordsWritten").get().value()
        if "QueryStage" in x.nodeName():
            nodes.append(x.plan())
        nodes += [x.children().apply(i) for i in range(x.children().size())]
    return n


def test_stages_shuffle_only_texts_that_may_change(spark, tmp_path):
    """Of 400 texts, 10 go and 10 lose a passage: the others are read, tested against a bitmap and handed on."""
    import corpus_pipeline as P

    rng = random.Random(21)
    texts = {i: prose(rng, 120, 10_000) for i in range(400)}
    for i in range(10):
        texts[390 + i] = texts[i] + " more"
        texts[380 + i] = " ".join([*texts[380 + i].split(), *texts[i].split()[:60]])
    make(spark, [*texts.items(), (None, texts[0]), (None, None)]).withColumns({"row": F.lit("own"), "part": F.lit("own"), "bits": F.lit("own")}).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        near = P.near_dedup(spark, docs, str(tmp_path))
        assert shuffled(near) < 100
        rows = near.collect()
        assert near.columns == docs.columns and sorted(r.doc_id for r in rows if r.doc_id is not None) == list(range(390)) and len(rows) == 392
        cut = P.substring_dedup(spark, docs.where("doc_id < 390 OR doc_id IS NULL"), str(tmp_path))
        assert shuffled(cut) < 100
        rows = cut.collect()
        assert cut.columns == docs.columns and len(rows) == 392 and all(r.row == r.part == r.bits == "own" for r in rows)
        assert all(r.text == (" ".join(texts[r.doc_id].split()[:120]) if 380 <= r.doc_id < 390 else texts[r.doc_id]) for r in rows if r.doc_id is not None)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
