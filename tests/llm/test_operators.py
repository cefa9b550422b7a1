"""The corpus operators on small fixtures, against brute force, the libraries or exact round trips."""

import hashlib
import html as html_lib
import random
import re
import struct
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import kernels, op1_html, op2_near, op3_language, op4_compaction, op5_quality, op6_merkle, op7_warc, op8_pieces, op9_token_files, op10_decontaminate, rans
from tessera.llm.ranges import boundaries, locate, range_of

public = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, rep string, _key string"


def words_of(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, columns with clashing names."""
    rng = random.Random(4)
    long = words_of(rng, 30_000)
    texts = [None, "", "   ", "...", "a", "one two three", long, long, words_of(rng, 60), "日本 中文", "x\x00y\r\n", "<|endoftext|> <s> ▁ é"]
    rows = [(i, x, None if i % 3 else "en", None, None, "d", "r", "k") for i, x in enumerate(texts)]
    rows += [rows[5], (None, "no key", "de", "s", 3, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_kernel_words_and_shingles():
    w = kernels.words(pa.array(["A b  c d e f", "a b", None, "", " b c d e f\n"]))
    assert [bytes(w.data[a:b]).decode() for a, b in zip(w.start, w.end)] == "a b c d e f a b b c d e f".split()
    h, doc = kernels.shingles(w, 5)
    assert doc.tolist() == [0, 0, 1, 4] and h[1] == h[3] and h[0] != h[1]


def test_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 7).alias("k"))
    bounds = boundaries(df, "k", 50)
    rows = df.union(spark.createDataFrame([(None,)], "k long")).select("k", range_of(F.col("k"), bounds).alias("r")).collect()
    assert all(r.r == locate(r.k, bounds) for r in rows)
    assert max(Counter(r.r for r in rows).values()) < 60


# 1 -----------------------------------------------------------------------------------------------------------------


def test_html_articles(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in op1_html.extract(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        parts = [" ".join(html_lib.unescape(re.sub("<[^>]+>", "", p.replace("<br>", " "))).split()) for p in re.split(r"</?(?:p|h1)>", inner)]
        assert got[r.page_id] == "\n".join(p for p in parts if p)


def test_html_structure():
    page = """<html><head><title>t</title><style>x{}</style></head><body><header>site</header><nav>menu</nav><div class="cookie-notice">cookies</div>
    <article><header><h1>Title &amp; more</h1><span class="share">share</span></header><p>One<b>two</b>  three<br>four</p><script>if (a<b) x()</script><aside>side</aside>
    <form>f</form><div class="ads">buy</div><ul><li>item</li></ul><section id="comments"><article>a comment</article></section></article><footer>foot</footer></body></html>"""
    assert op1_html.main_of(op1_html.blocks(page)) == ["Title & more", "Onetwo three four", "item"]
    assert op1_html.main_of(op1_html.blocks("<main><p>a</p><nav>b</nav></main>")) == ["a"]
    assert op1_html.blocks("text <b>only") == [("open", "text only")]
    assert op1_html.blocks("<p>a &lt;tag&gt; 1 < 2") == [("open", "a <tag> 1 < 2")]


def test_html_implied_ends_and_names():
    main = lambda x: op1_html.main_of(op1_html.blocks(f"<article>{x}</article>"))
    assert main("<p class='ad'>buy<p>real text<p>more real") == ["real text", "more real"]
    assert main("<ul><li class=share>share<li>kept item</ul>") == ["kept item"]
    assert main("<ul><li class=share>share<ul><li>x</li></ul>more</li><li>kept</li></ul>") == ["kept"]
    assert main("<p class=promo>ad<div>kept</div>") == ["kept"]
    assert main("<dl><dt class=advert>x<dd>kept<dt class=ads>y</dl>z") == ["kept", "z"]
    assert main("<table><tr><td class=sidebar>x<td>kept<tr><td>row</table>after") == ["kept", "row", "after"]
    assert main("<table><tr class=ads><td>x<tr><td>kept</table>") == ["kept"]
    assert main("<h2 class='search-algorithms'>Search</h2><p class='notice-board-history'>Boards</p>") == ["Search", "Boards"]
    assert main("<p>see <a class='related'>this other</a> page</p>") == ["see this other page"]
    assert main("<p>press <button>Go</button> now</p><p>a<span hidden>secret</span>b</p>") == ["press now", "ab"]
    assert main("<a class='related'>more</a><p>kept</p>") == ["kept"]
    for name in ("cookie-notice", "site-header", "adSlot2", "comment-list", "post-comments", "share_buttons", "ad", "relatedPosts", "user-comments", "main-nav"):
        assert op1_html.names_chrome(name), name
    for name in ("search-algorithms", "notice-board-history", "post-header", "article-header", "share-price", "advance", "related-work", "content", "comment-policy-essay", "2"):
        assert not op1_html.names_chrome(name), name


@pytest.mark.parametrize("alphabet", [2, 5, 40])
def test_suffix_array(alphabet):
    rng = np.random.default_rng(alphabet)
    page = np.sort(rng.integers(0, 9, 400))
    first = rng.integers(0, alphabet, 400)
    first[page == 3] = first[: (page == 3).sum()]
    array, common = op1_html.suffix_array(np.unique(first, return_inverse=True)[1].astype(np.int64), page)
    ends = [int(np.searchsorted(page, page[i], side="right")) for i in range(400)]
    tokens = [[(1, int(x)) for x in first[i : ends[i]]] + [(0, -int(page[i]))] for i in range(400)]
    want = sorted(range(400), key=lambda i: tokens[i])
    assert array.tolist() == want

    def same(x, y):
        return next(k for k, (p, q) in enumerate(zip(x, y)) if p != q)

    assert common[1:].tolist() == [same(tokens[a], tokens[b]) for a, b in zip(want, want[1:])]


def test_suffix_array_of_one_long_copy():
    rng = np.random.default_rng(1)
    page = np.repeat(np.arange(100), 4_000)

    def took(first):
        first, best = np.unique(first, return_inverse=True)[1].astype(np.int64), []
        for _ in range(5):
            began = time.process_time()
            common = op1_html.suffix_array(first, page)[1]
            best.append(time.process_time() - began)
        return min(best), int(common.max())

    plain = rng.permutation(len(page))
    copied = plain.copy()
    copied[:4_000] = copied[-4_000:]
    (alone, none), (with_copy, longest) = took(plain), took(copied)
    assert (none, longest) == (0, 4_000)
    # Only what is tied is looked at again: twelve more levels for one copy cost little.
    assert with_copy < 3 * alone


def covers(pages):
    """Brute force: for each host the substrings of RUN tokens, and the whole blocks, on more than half of its distinct pages."""
    hosts = {}
    for host, page in pages:
        hosts.setdefault(host, set()).add(tuple(page))
    found = {}
    for host, distinct in hosts.items():
        seen = Counter()
        for page in distinct:
            tokens = [x for b in page for x in (None, *b.split())] + ([None] if page else [])
            seen.update({tuple(tokens[i : i + op1_html.RUN]) for i in range(len(tokens) - op1_html.RUN + 1)})
            seen.update({("whole", b) for b in page})
        found[host] = {g for g, n in seen.items() if 2 * n > len(distinct) and n >= (op1_html.MAIN_PAGES if g[0] == "whole" else 2)}
    return found


@pytest.mark.parametrize("chunk", [1 << 20, 10, 150])
def test_html_cover_against_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(op1_html, "CHUNK", chunk)
    rng = random.Random(chunk)
    texts = [words_of(rng, rng.randint(1, 12), 30) for _ in range(12)]
    rows = []
    for i in range(160):
        host = rng.choice("aaaaaabbbcdefgh")  # one large host
        body = [rng.choice(texts[:3] if rng.random() < 0.6 else texts) for _ in range(rng.randint(0, 6))] + [words_of(rng, rng.randint(0, 9), 9)] * rng.randint(0, 1)
        rows.append((host, [b for b in body if b]))
    rows += rng.choices(rows, k=60)  # copies
    df = spark.createDataFrame([(i, f"http://{h}.example/{i}", "".join(f"<div>{b}</div>" for b in p)) for i, (h, p) in enumerate(rows)], "page_id long, url string, html string")
    parsed = op1_html.parsed(df.repartition(5), ["page_id"], "url", "html").cache()
    got = {r.host: set(r.grams) for r in op1_html.boilerplate(parsed).collect()}
    named = {r.page_id: r.host for r in parsed.select(F.col("c0").alias("page_id"), "host").collect()}
    want = covers(rows)
    for i, (h, p) in enumerate(rows):
        s = op1_html.Streams(pa.array([p], pa.list_(pa.string())))
        tokens = [x for b in p for x in (None, *b.split())] + ([None] if p else [])
        mine = got.get(named[i], set())
        assert [g in mine for g in s.runs.tolist()] == [tuple(tokens[j : j + op1_html.RUN]) in want[h] for j in range(max(0, len(tokens) - op1_html.RUN + 1))]
        assert [g in mine for g in s.whole.tolist()] == [("whole", b) in want[h] for b in p]


def test_html_rows_are_told_apart(spark):
    one, two, long = "only words of this very page stand here now", "quite other words of a second page stand here", " ".join(f"v{i}" for i in range(60_000))
    rows = [(None, "http://a.example/", f"<div>{one}</div>"), (None, "http://b.example/", f"<div>{two}</div>"), (3, "http://a.example/", f"<div>{two}</div>"), (3, "http://a.example/", "<p>x"), (3, "http://a.example/", f"<p>{long}</p>"), (3, None, None), (3, None, "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("old"), "host": F.lit("h"), "kinds": F.lit(1), "row": F.lit(2), "a.b": F.lit("dot")})
    got = op1_html.extract(df.repartition(3))
    assert got.columns == ["page_id", "url", "html", "host", "kinds", "row", "a.b", "text"]
    assert sorted((r.page_id or 0, r.text) for r in got.select("page_id", "text").collect()) == sorted([(0, one), (0, two), (3, two), (3, "x"), (3, long), (3, ""), (3, "")])
    assert {tuple(r) for r in got.select("host", "kinds", "row", "`a.b`").collect()} == {("h", 1, 2, "dot")}


def test_html_repeated_runs(spark, monkeypatch):
    boiler = "this site uses words of its own on each and every page"
    pages = [(i, "http://h.example/x", f"<div>{boiler}</div><div>p{i} of w{i} v{i} u{i}</div>") for i in range(6)]
    pages += [(9, "http://other.example/", f"<div>{boiler}</div>"), (10, None, None), (11, "", ""), (None, "http://h.example/", "<p>zz")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    for chunk in (1 << 20, 10):  # one array, and arrays of a page each
        monkeypatch.setattr(op1_html, "CHUNK", chunk)
        got = {r.page_id: r.text for r in op1_html.extract(df.repartition(4)).collect()}
        assert got[9] == boiler and got[10] == got[11] == "" and got[None] == "zz"
        assert all(got[i] == f"p{i} of w{i} v{i} u{i}" for i in range(6))
    assert op1_html.extract(df.where("false")).count() == 0


def test_html_blocks_common_to_articles(spark):
    share = "<p>Get our letter each week.</p>"
    body = lambda i: " ".join(f"t{i}n{j}" for j in range(30))
    pages = [(i, "http://h.example/x", f"<article><p>{body(i)}</p>{share}</article>") for i in range(6)]
    pages += [(6, "http://h.example/x", f"<article><p>{body(6)}</p><p>{body(0)}</p></article>")]  # a quote is content
    pages += [(7, "http://h.example/x", f"<article>{share}</article>")]
    pages += [(10 + i, "http://copies.example/x", f"<article><p>{body(9)}</p><p>p{i}</p></article>") for i in range(6)]  # near copies too
    pages += [(20 + i, "http://few.example/x", f"<article><p>{body(20 + i)}</p>{share}</article>") for i in range(3)]
    got = {r.page_id: r.text for r in op1_html.extract(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4)).collect()}
    assert all(got[i] == body(i) for i in range(6)) and got[6] == f"{body(6)}\n{body(0)}"
    assert got[7] == "Get our letter each week." and all(got[10 + i] == f"{body(9)}\np{i}" for i in range(6))
    assert all(got[20 + i] == f"{body(20 + i)}\nGet our letter each week." for i in range(3))


def test_html_copies_and_quotes_stay(spark, monkeypatch):
    menu = "<div>" + " ".join(f"m{j}" for j in range(12)) + "</div>"
    body = lambda i: " ".join(f"t{i}n{j}" for j in range(60))
    near = [body(0).replace("t0n30 ", f"new{i} ") for i in range(2)]
    texts = [*near, body(1), body(1), body(2), body(3), f"{body(4)} {body(2)}", body(5), body(6)]  # near and exact copies, a quote
    pages = [(i, "http://h.example/x", f"{menu}<div>{t}</div>") for i, t in enumerate(texts)]
    pages += [(20 + i, "http://pair.example/x", f"<div>{t}</div>") for i, t in enumerate(near)]  # nothing but near copies
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4)
    for chunk in (1 << 20, 10):
        monkeypatch.setattr(op1_html, "CHUNK", chunk)
        got = {r.page_id: r.text for r in op1_html.extract(df).collect()}
        assert all(got[i] == t for i, t in enumerate(texts)) and all(got[20 + i] == t for i, t in enumerate(near))


# 2 -----------------------------------------------------------------------------------------------------------------


def brute_force(rows):
    sets, reps = {}, {}
    for k, text in rows:
        w = (text or "").lower().split()
        reps[text or ""] = min(reps.get(text or "", k), k)
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    heads = sorted(reps.values())
    links, parent = Counter(), {i: i for i in heads}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in heads:
        for b in heads:
            if a < b and sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {k: (reps[t or ""], top(reps[t or ""]), links[reps[t or ""]]) for k, t in rows}


@pytest.mark.parametrize("block", [512, 8])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(op2_near, "BLOCK", block)
    rng = random.Random(9)
    rows = []
    for g in range(12):
        base = words_of(rng, 80, 5000).split()
        for _ in range(40 if g == 0 else rng.randint(1, 4)):  # one large group of near copies
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = f"new{rng.random()}"
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows) + i, rows[i][1]) for i in range(10)] + [(1000, ""), (1001, None), (1002, "a b"), (1003, "a  b"), (1004, "...")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.text_class, r.class_id, r.n_links) for r in op2_near.near_duplicates(df).collect()}
    assert got == brute_force(rows)


def test_near_duplicates_edges(spark, odd, none):
    got = op2_near.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    assert [(r.class_id, r.n_links) for r in got if r.doc_id is None] == [(None, 0)]
    assert {r.class_id for r in got if r.doc_id in (6, 7)} == {6}
    assert op2_near.near_duplicates(none).count() == 0


def test_near_duplicates_judge_each_row_by_its_text(spark):
    rng = random.Random(5)
    w = words_of(rng, 60, 5000).split()
    near = " ".join([*w[:30], "other", *w[31:]])  # 51 of 61 shingles
    other = words_of(rng, 40, 5000)
    rows = [(1, other), (1, " ".join(w)), (3, near), (None, near + " x"), (None, other), (7, "lone"), (None, "alone")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.text_class, r.class_id, r.n_links) for r in op2_near.near_duplicates(df.repartition(3)).collect()]
    want = [(1, 1, 1, 0), (1, 1, 1, 2), (3, 3, 1, 2), (None, None, 1, 2), (None, 1, 1, 0), (7, 7, 7, 0), (None, None, None, 0)]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_candidate_bitmap_loses_nothing(spark):
    rows = spark.range(5000).select(F.md5(F.col("id").cast("string")).alias("digest"), "id")
    wanted = rows.where("id % 50 = 0").select("digest")
    got = {r.id for r in op2_near.passed(rows, wanted).collect()}
    assert {i for i in range(0, 5000, 50)} <= got and len(got) < 1000


def test_near_duplicate_sql_on_repeated_ids(spark, tmp_path):
    import duckdb

    from tessera.llm import queries

    rng = random.Random(6)
    base = [words_of(rng, 30, 5000) for _ in range(4)]
    rows = [(i // 3, base[i % 4] + (f" e{i}" if i % 2 else "")) for i in range(24)] + [(2, None), (2, ""), (9, "a b")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in queries.op2_near(spark, str(tmp_path)).select("doc_id", "text_class", "class_id", "n_links").collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(con.execute(f"SELECT doc_id, text_class, class_id, n_links FROM ({queries.NEAR})").fetchall()) and any(r[3] for r in got)


def test_pruning_bound():
    need = op2_near.fewest_matches()
    assert (np.diff(need) > 0).all() and 0 < need[0] < need[-1] < 0.8 * op2_near.HASHES


# 3, 5 --------------------------------------------------------------------------------------------------------------


def test_language(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.col("doc_id") % 3 == 1
    net = op3_language.learn(docs.where(~held))
    seen = op3_language.identify(docs.where(held), net, keep=["lang"]).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert seen > 0.97
    got = {r.doc_id: (r.lang_pred, r.lang_score) for r in op3_language.identify(odd, net).collect()}
    assert all(got[i] == ("und", 0.0) for i in (0, 1, 2, 3)) and got[9][0] != "und" and all(0 <= s <= 1 for _, s in got.values())
    assert op3_language.identify(none, net).count() == 0
    assert op3_language.learn(none) is None
    assert op3_language.identify(odd, None).where("lang_pred <> 'und'").count() == 0


def test_language_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(op3_language, "ROWS_A_LANGUAGE", 20)
    rng = random.Random(3)
    rows = [(i, "the cat is on the mat " * 30 + str(i), "en") for i in range(600)] + [(None, "der hund und das haus " * 40, "de")] * 300
    rows += [(1000 + i, "le chat est sur la table " * 2000, f"l{i}") for i in range(3)]  # rare languages, long texts
    seen = {}
    monkeypatch.setattr(op3_language, "train_windows", lambda r, labels, languages: seen.update(rows=r, labels=labels, languages=languages))
    rng.shuffle(rows)
    op3_language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    n = Counter(seen["labels"])
    assert seen["languages"] == ["de", "en", "l0", "l1", "l2"] and seen["rows"].shape == (sum(n.values()), op3_language.LENGTH + 3)
    assert 10 * 3 <= n["en"] <= 20 * 4 and n["de"] == n["l0"] == 4  # one distinct row each


def test_null_ids_are_not_held_out(spark, tmp_path):
    from tessera.llm import queries

    rows = [(None, "one two three. " * 20, "en"), (None, "eins zwei drei, " * 20, "de"), (4, "and so on it goes " * 9, "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, 1, 0), (4, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name in ("op3_language", "op5_quality"):
        got = queries.queries()[name](spark, str(tmp_path)).collect()
        assert len(got) == 3 and all(r.held_out is not None and 0 <= r.score <= 1 for r in got)


def test_quality_takes_one_row_a_key(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(op5_quality, "fit", lambda x, y: seen.append((x.shape[0], y.tolist())))
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(50)] + [(2, "other"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, 1), (4, 1), (None, 1)], "doc_id long, quality int")
    op5_quality.train(docs, labels)
    assert seen == [(3, [1.0, 0.0, 1.0])]


def test_language_pair_tables_equal_plain_convolution():
    net = op3_language.train(["the cat sat on the mat and went home", "der hund und die katze gehen nach haus"] * 3, ["en", "de"] * 3)
    rows, _ = op3_language.windows(*kernels.text_bytes(pa.array(["the hund sat", "x" * 600])))
    x = rows.astype(int)
    plain = [sum(net.tables[w][j][x[:, j : j + op3_language.LENGTH]] for j in range(w)).max(axis=1) for w in op3_language.WIDTHS]
    want = np.maximum(np.concatenate(plain, axis=1) + net.shift, 0)
    assert np.allclose(op3_language.Scorer(net).features(rows), want, atol=1e-4)


def test_quality(spark, odd, none):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = op5_quality.train(docs, labels, F.col("doc_id") % 4 != 2)
    held = op5_quality.classify(docs.where("doc_id % 4 = 2"), model).join(labels, "doc_id")
    assert held.agg(F.avg((F.col("quality") == F.col("quality_pred")).cast("int"))).first()[0] > 0.95
    got = op5_quality.classify(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r.quality_score <= 1 for r in got)
    assert op5_quality.classify(none, model).count() == 0
    flat = op5_quality.train(docs, labels.where("false"))
    assert {r.quality_score for r in op5_quality.classify(odd, flat).collect()} == {0.5}


def test_quality_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = np.zeros((2000, len(op5_quality.FEATURES)))
    x[:, :2] = rng.random((2000, 2))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = op5_quality.fit(x, y)
    assert model.pairs and (((model.score(x) > 0.5) == y).mean() > 0.9)


# 4 -----------------------------------------------------------------------------------------------------------------


def test_run_planning():
    sizes = [random.Random(i).randint(1, 4 << 20) for i in range(500)]
    runs = op4_compaction.plan_runs(sizes)
    used = [i for r in runs for i in r]
    assert len(used) == len(set(used))
    assert all(sum(sizes[i] for i in r) <= 1.25 * op4_compaction.TARGET_BYTES for r in runs)
    left = [n for i, n in enumerate(sizes) if i not in set(used)] + [sum(sizes[i] for i in r) for r in runs]
    tiers = Counter(op4_compaction.tier(n) for n in left if n < op4_compaction.TARGET_BYTES)
    assert all(n < op4_compaction.FAN_IN or t >= 3 for t, n in tiers.items())
    assert op4_compaction.plan_runs([]) == [] and op4_compaction.plan_runs([1, 2, 3]) == []


def test_store(spark, odd, none, tmp_path):
    store = op4_compaction.ShardStore(spark, f"file://{tmp_path}/s")
    assert store.append(none) == 1 and store.read().count() == 0
    for _ in range(5):
        store.append(odd.repartition(3), rows=2)
    before = store.manifest()[0]
    after = store.compact()
    assert after == before + 1
    same = store.read().exceptAll(store.read(before)).count() + store.read(before).exceptAll(store.read()).count()
    assert same == 0 and store.read().count() == 5 * odd.count()
    assert len(store.manifest()[2]) < len(store.manifest(before)[2])
    store.vacuum()
    assert store.versions() == [after] and store.read().count() == 5 * odd.count()
    with pytest.raises(Exception, match="exist"):
        store._commit(after - 1, odd.schema, [])


def test_store_keeps_every_column(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(op4_compaction, "PART_SHARDS", 3)
    store = op4_compaction.ShardStore(spark, f"file://{tmp_path}/s")
    store.append(spark.createDataFrame([(1, "a"), (None, None)], "doc_id long, text string"), rows=1)
    store.append(spark.createDataFrame([(2, "b", 7.5), (2, "b", 7.5)], "doc_id long, text string, extra double"), rows=1)
    store.append(spark.createDataFrame([("c", "p")], "text string, path string"))
    store.append(spark.createDataFrame([(9,)] * 4, "doc_id long").repartition(4), rows=1)
    want = sorted(map(str, [(1, "a", None, None), (None, None, None, None), (2, "b", 7.5, None), (2, "b", 7.5, None), (None, "c", None, "p"), *[(9, None, None, None)] * 4]))
    shown = lambda v=None: sorted(str(tuple(r)) for r in store.read(v).select("doc_id", "text", "extra", "path").collect())
    assert shown() == want and store.read().columns == ["doc_id", "text", "extra", "path"]
    before = store.manifest()[0]
    assert len(store._head(before)["parts"]) > 2 and store._head(before)["parts"][: len(store._head(1)["parts"])] == store._head(1)["parts"]
    with pytest.raises(ValueError, match="doc_id"):
        store.append(spark.createDataFrame([("x",)], "doc_id string"))
    assert store.compact() == before + 1 and shown() == want == shown(before)
    # A writer that failed leaves files that no manifest lists.
    spark.range(5).write.parquet(f"file://{tmp_path}/s/data/stray")
    store._put("_stray", "x")
    store.vacuum()
    assert (tmp_path / "s/data/stray").exists() and shown() == want
    store.vacuum(grace=-5)
    assert not (tmp_path / "s/data/stray").exists() and not (tmp_path / "s/manifest/_stray").exists() and shown() == want
    listed = {s.path.removeprefix("file:") for s in store.manifest()[2]}
    assert {str(p) for p in (tmp_path / "s/data").rglob("part-*")} == listed


def test_compaction_query_rows(spark, tmp_path):
    from tessera.llm import queries

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs.repartition(12).write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op4_compaction(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.n_chars) for r in rows) == sorted((d.doc_id, d.n_chars) for d in docs.collect())
    held = Counter(r.shard_id for r in rows)
    assert all(held[r.shard_id] == r.shard_rows and 0 < r.shard_bytes <= 1.25 * op4_compaction.TARGET_BYTES and r.version == 3 for r in rows)
    assert len(held) < 4


# 6 -----------------------------------------------------------------------------------------------------------------


def test_next_and_edits(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = docs.orderBy("doc_id").collect()
    got = {r.doc_id: r.next for r in op6_merkle.with_next(docs.repartition(5), "doc_id", "text", "next").collect()}
    assert all(got[r.doc_id] == rows[(i + 1) % len(rows)].text for i, r in enumerate(rows))


def test_fingerprints(spark, odd, none):
    got = op6_merkle.fingerprints(odd, leaves="leaves").collect()
    by_text = {}
    for r in got:
        assert by_text.setdefault(r.text or "", r.fingerprint) == r.fingerprint
    assert len(set(by_text.values())) == len(by_text)
    assert op6_merkle.fingerprints(none).count() == 0 and op6_merkle.with_next(none, "doc_id", "text", "next").count() == 0
    assert op6_merkle.with_next(odd, "doc_id", "text", "next").count() == odd.count()
    text = "\n".join(f"Line number {i} is here. It has two parts." for i in range(40))
    pair = spark.createDataFrame([(text, text.replace("number 17 ", "number x "))], "a string, b string")
    pair = op6_merkle.fingerprints(op6_merkle.fingerprints(pair, "a", "fa", "la"), "b", "fb", "lb")
    r = pair.select(op6_merkle.differing(F.col("fa"), F.col("fb")).alias("d"), op6_merkle.likeness(F.col("la"), F.col("lb")).alias("n"), op6_merkle.likeness(F.col("la"), F.col("la")).alias("one")).first()
    assert r.d == [17] and 0.9 < r.n < 1 and r.one == 1


def plain_tree(text):
    """The fingerprint and the set of leaves, in plain Python."""
    node = lambda level, x: hashlib.sha256((level + x).encode()).hexdigest()[:32]
    space = "[ \\t\\n\\x0b\\f\\r]"
    word = space.replace("[", "[^")
    leaf = re.compile(f"(?:{word}*{space.replace('[', '[^').replace(']', '.!?]')}{space}+){{0,15}}{word}+{space}*|{space}+")
    lines = re.findall("[^\\n]*\\n|[^\\n]+", text or "")
    cut = [leaf.findall(x) for x in lines]
    assert "".join(x for c in cut for x in c) == (text or "")
    below = [[node("l", x) for x in c] for c in cut]
    nodes = [node("p", ",".join(b)) for b in below]
    sections = [[]]
    for n in nodes:
        sections[-1].append(n)
        if n[-1] in "08":
            sections.append([])
    sections = [",".join(s) for s in sections if s]
    above = ",".join(node("s", s) for s in sections)
    return ";".join([node("r", above), above, "/".join(sections), "/".join(",".join(b) for b in below)]), {x for b in below for x in b}


def dice(a, b):
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0


def test_merkle_query_against_brute_force(spark, tmp_path):
    from tessera.llm import queries

    rng = random.Random(7)
    texts = [None, "", "  ", "\n\n", " lead\n\ttab\r\n", "a.b! c? d", "é" * 50 + " 日本。 中", "x" * 3000, "same", "same", words_of(rng, 5000).replace("x w", "x. w", 900).replace(" ", "\n", 700)]
    texts += ["\n".join(words_of(rng, rng.randint(0, 30)) for _ in range(rng.randint(1, 40))) for _ in range(30)]
    docs = list(enumerate(texts))
    spark.createDataFrame(docs, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op6_merkle(spark, str(tmp_path)).collect()}
    assert len(got) == len(docs)
    for i, text in docs:
        text, after = text or "", texts[(i + 1) % len(texts)] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        (f, own), (g, other), (_, following) = plain_tree(text), plain_tree(edited), plain_tree(after)
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(text), hashlib.sha256(edited.encode()).hexdigest(), f, g)
        assert (r.near_edited, r.near_next) == (dice(own, other), dice(own, following))


def test_merkle_edits(spark):
    lines = [f"Paragraph number {i} is here." for i in range(60)]
    other = [*lines[:20], "put in", *lines[20:]]
    cases = {
        "same": (lines, lines, ([], [], [])),
        "changed": (lines, [*lines[:17], "else", *lines[18:]], ([17], [17], [])),
        "inserted": (lines, other, ([], [20], [])),
        "deleted": (other, lines, ([20], [], [])),
        "reversed": (lines, lines[::-1], ([], [], list(range(60)))),
        "swapped": (lines, [*lines[:5], lines[6], lines[5], *lines[7:]], ([], [], [5, 6])),
        "white space": (lines, [*lines[:9], lines[9] + " ", *lines[10:]], ([9], [9], [])),
        "blank line": (lines, [*lines[:30], "", *lines[30:]], ([], [30], [])),
    }
    rows = [(k, "\n".join(a) + "\n", "\n".join(b) + "\n") for k, (a, b, _) in cases.items()] + [("empty", "", "a\n"), ("repeat", "a\na\n", "a\n")]
    pair = spark.createDataFrame(rows, "k string, a string, b string")
    pair = op6_merkle.fingerprints(op6_merkle.fingerprints(pair, "a", "fa"), "b", "fb")
    got = {r.k: tuple(map(list, r.e)) for r in pair.select("k", op6_merkle.edits(F.col("fa"), F.col("fb")).alias("e")).collect()}
    assert {k: got[k] for k in cases} == {k: want for k, (_, _, want) in cases.items()}
    assert got["empty"] == ([], [0], []) and got["repeat"][:2] == ([], []) and got["repeat"][2]


def test_next_of_hot_and_null_keys(spark):
    rows = [(7, f"t{i}") for i in range(900)] + [(None, f"n{i}") for i in range(300)] + [(i, f"k{i}") for i in range(100, 400)] + [(7, "equal")] * 50
    df = spark.createDataFrame(rows, "k long, t string").repartition(6)
    bounds = boundaries(df, "k", 16)
    o = F.coalesce(F.col("k"), F.lit(-(1 << 63)))
    sizes = Counter(r[0] for r in df.select(range_of(o, bounds, F.pmod(F.xxhash64("t", F.rand(1)), F.lit(1 << 30)))).collect())
    assert max(sizes.values()) < 250 and len(sizes) > 10
    got = op6_merkle.with_next(df, "k", "t", "next").collect()
    assert sorted(r.t for r in got) == sorted(r.next for r in got) == sorted(t for _, t in rows)
    of = {t: k for k, t in rows}
    assert sum(of[r.t] != of[r.next] for r in got) == 2 + 300  # the steps from key to key, and around


# 7 -----------------------------------------------------------------------------------------------------------------


def test_warc(spark):
    rng = random.Random(1)
    rows = [(i, f"http://h/{i} x", f"<p>{words_of(rng, 50)}</p>") for i in range(30)] + [(40 + i, None, rows_) for i, rows_ in enumerate(["same", "same", "same", None, ""])]
    rows += [(None, "u", "same"), (30, "u", "é" * 100_000), (42, None, "same")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    archives = op7_warc.write_archives(df.repartition(3))
    got = op7_warc.read_archives(archives).collect()
    assert len(got) == len(rows)
    payload = {k: (h or "").encode() for k, _, h in rows}
    for r in got:
        data = payload[r.page_id] if r.page_id is not None else b"same"
        assert r.payload_bytes == len(data) and r.payload_digest == op7_warc.base32_sha1(data)
    of = {r.page_id: (r.record_type, r.refers_to) for r in got}
    assert of[42] == ("response", None) and of[40] == of[41] == of[None] == ("revisit", 42) and of[43] == ("revisit", 44) and of[44] == ("response", None)
    assert op7_warc.read_archives(op7_warc.write_archives(df.where("false"))).count() == 0
    ids, refers = [], set()
    for r in archives.collect():
        for head, _ in op7_warc.unpack(bytes(r.content)):
            ids.append((head["WARC-Record-ID"], head["WARC-Type"]))
            refers |= {head["WARC-Refers-To"]} if "WARC-Refers-To" in head else set()
    assert len({i for i, _ in ids}) == len(ids) == len(rows) and refers <= {i for i, t in ids if t == "response"}
    odd = df.withColumns({"record_type": F.lit("x"), "d": F.lit(1), "i": F.lit(2)})
    assert op7_warc.read_archives(op7_warc.write_archives(odd)).count() == len(rows)


def test_warc_bytes():
    records = [op7_warc.record(i, "http://x", b"payload %d" % i, None) for i in range(200)]
    data = op7_warc.pack(records)
    magic, size = struct.unpack_from("<II", data)
    assert magic == 0x184D2A5D and size > 0
    assert [b.rpartition(b"\r\n\r\n")[2] for _, b in op7_warc.unpack(data)] == [b"payload %d" % i for i in range(200)]
    with pytest.raises(ValueError):
        list(op7_warc.unpack(b"\0" * 16))


# 8 -----------------------------------------------------------------------------------------------------------------


def library_model(path, v):
    """The library's own unigram model with the same pieces and scores."""
    import sentencepiece

    raw, out, at, k = open(path, "rb").read(), bytearray(), 0, 0

    def varint(i):
        n = s = 0
        while True:
            c = raw[i]
            i += 1
            n |= (c & 127) << s
            s += 7
            if c < 128:
                return n, i

    def coded(n):
        r = bytearray()
        while n > 127:
            r.append(n & 127 | 128)
            n >>= 7
        return bytes([*r, n])

    while at < len(raw):
        tag, i = varint(at)
        n, i = varint(i)
        body = bytearray(raw[i : i + n])
        at = i + n
        if tag == 10:  # a piece: its name, then its score
            body[3 + body[1] : 7 + body[1]] = struct.pack("<f", v.scores[k])
            k += 1
        if tag == 18:  # the trainer's settings: kind BPE becomes unigram
            p = body.index(b"\x18\x02")
            body[p : p + 2] = b"\x18\x01"
        out += coded(tag) + coded(len(body)) + body
    return sentencepiece.SentencePieceProcessor(model_proto=bytes(out))


def test_pieces_like_the_library():
    path = public.path("piece_bpe_32k.model")
    v = op8_pieces.load(path)
    model = library_model(path, v)
    rng = random.Random(2)
    parts = ["a", "th", "ing", " ", "  ", "é", "ñó", "\n", "日本", "中", "#", ".", "1", "23", "Z", "▁", "<s>", "the", "of", "\t"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(2000)]
    ids, n = op8_pieces.SpanCache(op8_pieces.Viterbi(v), 100_000)(op8_pieces.spans(v, pa.array(texts)))
    total = lambda x: sum(v.scores[i] for i in x)
    at = 0
    for text, k in zip(texts, n):
        mine, want = ids[at : at + k].tolist(), model.encode(text)
        at += k
        assert mine == want or abs(total(mine) - total(want)) < 1e-3  # ties of float sums
    search = op8_pieces.Viterbi(v)
    for text in texts[:200]:
        s = text.replace("▁", " ").encode()
        assert search._alone(s) == search._together([s])[0]


def test_pieces_of_any_script():
    import time

    path = public.path("piece_bpe_32k.model")
    v = op8_pieces.load(path)
    model, rng = library_model(path, v), random.Random(3)
    ranges = {"cjk": (0x4E00, 0x9FA5), "cyrillic": (0x400, 0x45F), "thai": (0xE01, 0xE3A), "arabic": (0x621, 0x64A), "hangul": (0xAC00, 0xD7A3), "emoji": (0x1F300, 0x1F64F), "kana": (0x3041, 0x30FA)}
    texts = [" " * 700, "a" * 1500, "=" * 900 + "é", ""]
    for a, b in ranges.values():
        texts += ["".join(chr(rng.randint(a, b)) if rng.random() < p else " " for _ in range(600)) for p in (1, 0.8)]
    texts += ["".join(chr(rng.randint(*rng.choice([*ranges.values(), (32, 126)]))) for _ in range(300)) for _ in range(20)]
    total = lambda x: sum(v.scores[i] for i in x)
    ids, n = op8_pieces.SpanCache(op8_pieces.Viterbi(v), 100_000)(op8_pieces.spans(v, pa.array(texts)))
    at, search = 0, op8_pieces.Viterbi(v)
    for text, k in zip(texts, n):
        mine, want = ids[at : at + k].tolist(), model.encode(text)
        at += k
        assert mine == want or abs(total(mine) - total(want)) < 2e-3
        if text:
            # Cut or not, alone or in step: one path.
            whole = (" " + text).encode()
            assert search._alone(whole) == search._together([whole])[0]
            assert abs(total(search._alone(whole)) - total(mine)) < 1e-3

    def seconds(text):
        cache = op8_pieces.SpanCache(op8_pieces.Viterbi(v), 100_000)
        began = time.process_time()
        cache(op8_pieces.spans(v, pa.array([text])))
        return (time.process_time() - began) / len(text.encode())

    words = [words_of(rng, 1, 5000) for _ in range(20_000)]
    plain = min(seconds(" ".join(words)) for _ in range(5))
    assert min(seconds("".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(60_000))) for _ in range(5)) < 3 * plain


def test_new_pieces_are_encoded_together():
    import public_tokenizers
    from tokenizers import Tokenizer

    path, rng = public_tokenizers.path("word_bpe_49k.json"), random.Random(3)
    words = list({"".join(rng.choice("abcdefghiknorstué'") for _ in range(rng.randint(1, 14))) for _ in range(30_000)})
    library = Tokenizer.from_file(path)

    def took(run):
        best = []
        for _ in range(3):
            began = time.process_time()
            got = run()
            best.append(time.process_time() - began)
        return min(best), got

    encoders, column = [op9_token_files.Encoder(path) for _ in range(3)], pa.array(words)
    alone, want = took(lambda: [e.ids for e in library.encode_batch_fast(words, add_special_tokens=False)])
    together, (ids, total) = took(lambda: encoders.pop()(column, 1))
    assert ids.tolist() == [x for made in want for x in [*made, 1]] and total.tolist() == [len(made) + 1 for made in want]
    assert together < alone
    # Texts with the mark itself, alone and beside letters.
    odd = ["a\x01b \x01 c", "\x01", "x \x01\x01 new1piece", ""]
    ids, total = op9_token_files.Encoder(path)(pa.array(odd), 1)
    assert ids.tolist() == [x for t in odd for x in [*library.encode(t, add_special_tokens=False).ids, 1]]


def test_span_cache_compares_bytes_of_later_calls():
    cache = op8_pieces.SpanCache(lambda spans: (np.array([s[-1] for s in spans]), np.ones(len(spans), int)), 10)
    for texts in (["alpha-beta-gamma 7", "x"], ["alpha-beta-gammb 7", "y x"], ["alpha-beta-gamma 7", "x"]):
        w = kernels.words(pa.array(texts), lower=False)
        w.hash = np.array([len(x) for t in texts for x in t.split()], np.uint64) * np.uint64(3)
        assert cache(w)[0].tolist() == [ord(x[-1]) for t in texts for x in t.split()]


def test_span_cache_compares_bytes():
    w = kernels.words(pa.array(["one two one", "two three"]))
    w.hash[:] = 7  # as if all hashes met
    ids, n = op8_pieces.SpanCache(lambda spans: (np.array([len(s) for s in spans]), np.ones(len(spans), int)), 10)(w)
    assert ids.tolist() == [3, 3, 3, 3, 5] and n.tolist() == [3, 2]


def test_models_that_rewrite_texts_are_refused(tmp_path):
    raw = open(public.path("piece_bpe_32k.model"), "rb").read()
    assert op8_pieces._settings(raw)[3] and not op8_pieces._settings(raw)[4]
    at = raw.rindex(b"\x20\x00")  # field 4 of the normaliser's settings: fewer spaces
    (tmp_path / "m").write_bytes(raw[:at] + b"\x20\x01" + raw[at + 2 :])
    with pytest.raises(ValueError):
        op8_pieces.load(str(tmp_path / "m"))


def test_pieces_round_trip(spark, odd, none):
    v = op8_pieces.load(public.path("piece_bpe_32k.model"))
    got = op8_pieces.decode(op8_pieces.encode(odd, v), v).collect()
    assert len(got) == odd.count() and all(r.decoded == (r.text or "").replace("▁", " ") for r in got)
    assert op8_pieces.decode(op8_pieces.encode(none, v), v).count() == 0


# 9 -----------------------------------------------------------------------------------------------------------------


def test_rans_round_trip():
    rng = np.random.default_rng(3)
    for n in (0, 1, 63, 64, 65, rans.BLOCK, rans.BLOCK * 2 + 5):
        ids = np.minimum(rng.geometric(0.01, n), 5000).astype(np.uint32)
        coder = rans.Coder(rans.quantise(np.bincount(np.append(ids, 7), minlength=5001)))
        blocks = coder.encode(ids)
        assert (np.concatenate([np.empty(0, np.uint32), *coder.decode(blocks)]) == ids).all()
        if n > rans.BLOCK:
            part = coder.decode(blocks[:1], first=1)[0]
            assert (part == ids[rans.CHECKPOINT * rans.LANES : rans.BLOCK]).all()
            blocks[0]["words"] = blocks[0]["words"].copy()
            blocks[0]["words"][10] ^= 1
            with pytest.raises(ValueError):
                coder.decode(blocks[:1])


def test_quantise():
    for counts in ([5], [1] * 1000, [10**9, 1, 1, 0], np.r_[10**6, np.ones(100_000)]):
        f = rans.quantise(np.array(counts))
        assert f.sum() == 1 << rans.SCALE and ((f > 0) == (np.array(counts) > 0)).all()


def test_token_files(spark, odd, none):
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(odd.select(F.col("doc_id") + 1_000_000, "text"))
    root = op9_token_files.write(docs.repartition(3), path, op9_token_files.temporary(docs))
    got = {}
    for r in op9_token_files.read(spark, root, with_ids=True).collect():
        got.setdefault(r.doc_id, []).append(r)
    start = 0
    rows = sorted(docs.collect(), key=lambda r: (-1 if r.doc_id is None else r.doc_id, r.text or ""))
    for r in rows:
        ids = np.array(library.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4").tobytes()
        x = min(got[r.doc_id], key=lambda y: y.start)
        got[r.doc_id].remove(x)
        assert (x.start, x.n_tokens, x.ids_crc32, bytes(x.ids)) == (start, len(ids) // 4, zlib.crc32(ids), ids)
        start += len(ids) // 4
    empty = op9_token_files.write(none, path, op9_token_files.temporary(none))
    assert op9_token_files.read(spark, empty).count() == 0


def test_token_files_stand_alone(spark, tmp_path, monkeypatch):
    import pyarrow.parquet as pq

    rng = random.Random(12)
    monkeypatch.setattr(op9_token_files, "SEGMENT", 40_000)
    docs = [(i * 7 % 500 if i < 300 else 77, words_of(rng, rng.randint(0, 900))) for i in range(600)]  # one key on half of the rows
    df = spark.createDataFrame(docs, "doc_id long, text string")
    root = op9_token_files.write(df.repartition(5), public.path("word_bpe_49k.json"), f"file://{tmp_path}/a")
    files = sorted((tmp_path / "a" / "segments").glob("part-*"))
    order = [(r["shard"], r["place"]) for f in files for r in pq.read_table(f, columns=["shard", "place"]).to_pylist()]
    assert order == sorted(order) and len({s for s, _ in order}) > 4
    head = op9_token_files.header(spark.newSession(), root)
    assert head["n_docs"] == len(docs) and head["vocabulary_size"] == 49_408 and head["vocabulary_sha256"] == hashlib.sha256(open(public.path("word_bpe_49k.json"), "rb").read()).hexdigest()
    rows = sorted(op9_token_files.read(spark.newSession(), root, with_ids=True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted(k for k, _ in docs) and [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows[:-1])]).tolist()
    whole = np.concatenate([np.frombuffer(r.ids, "<u4") for r in rows])
    assert len(whole) == head["n_tokens"] > 4 * rans.BLOCK
    for a, b in [(0, 10), (rans.BLOCK - 5, rans.BLOCK + 70_000), (20_000, 20_001), (len(whole) - 3, len(whole)), (5, 5), (0, len(whole))]:
        got = sorted(op9_token_files.tokens(spark, root, a, b).collect(), key=lambda r: r.start)
        assert np.array_equal(np.concatenate([np.empty(0, "<u4"), *(np.frombuffer(r.ids, "<u4") for r in got)]), whole[a:b])
    seen = []
    plain = rans.Coder.decode
    monkeypatch.setattr(rans.Coder, "decode", lambda self, blocks, first=0, stop=None: seen.append(first) or plain(self, blocks, first, stop))
    coder = rans.Coder(head["freq"])
    data = pq.read_table(files[0]).column("data")[0].as_py()
    block = op9_token_files.open_segment(coder, data)[3][0]
    assert np.array_equal(coder.decode([block], 1, 20_000)[0][:100], plain(coder, [block])[0][rans.CHECKPOINT * rans.LANES :][:100]) and seen == [1]
    with pytest.raises(ValueError, match="frequency"):
        op9_token_files.open_segment(rans.Coder(np.roll(head["freq"], 1)), data)


def test_token_query_encodes_like_the_library(spark, tmp_path):
    from tokenizers import Tokenizer

    from tessera.llm import queries

    library = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    texts = ["one <|endoftext|> two", "plain text", None, "", "<|startoftext|>", "x<|ENDOFTEXT|>y", "last"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op9_token_files(spark, str(tmp_path)).collect()}
    start = 0
    for i, text in enumerate(texts):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_other_vocabularies_encode_whole_texts():
    from tokenizers import Tokenizer

    texts = ["Hello  world", "", None, "It's 5"]
    for name, cut in (("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)):
        encoder = op9_token_files.Encoder(public.path(name))
        library = Tokenizer.from_file(public.path(name))
        ids, n = encoder(pa.array(texts), 1)
        assert encoder.cut == cut
        assert ids.tolist() == [i for x in texts for i in [*library.encode(x or "", add_special_tokens=False).ids, 1]] and n.sum() == len(ids)


# 10 ----------------------------------------------------------------------------------------------------------------


def plain_alignment(x, y):
    best, above = 0, [0] * (len(y) + 1)
    for a in x:
        row = [0]
        for j, b in enumerate(y):
            row.append(max(0, above[j] + (1 if a == b else -1), above[j + 1] - 1, row[-1] - 1))
        best, above = max(best, *row), row
    return best


def test_alignment():
    rng = np.random.default_rng(5)
    x, y = rng.integers(1, 6, (50, 9)).astype(np.uint64), rng.integers(1, 6, (50, 25)).astype(np.uint64)
    assert op10_decontaminate.align(x, y)[0].tolist() == [plain_alignment(a, b) for a, b in zip(x.tolist(), y.tolist())]


def test_leaks(spark, odd, none, monkeypatch):
    rng = random.Random(8)
    items = [(i, words_of(rng, 30, 3000)) for i in range(20)] + [(50, None), (51, ""), (52, "solitary-word")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = []
    for i, text in items[:20]:
        w = text.split()
        for j in range(2, len(w), 9):
            w[j] = "changed"
        rows += [(100 + i, words_of(rng, 200, 100_000) + " " + text.upper().replace(" ", ", ") + ". " + words_of(rng, 50, 100_000)), (200 + i, words_of(rng, 40, 100_000) + " " + " ".join(w)), (300 + i, words_of(rng, 300, 100_000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (1 << 20, 100):  # one block of items, and several
        monkeypatch.setattr(op10_decontaminate, "BLOCK_WORDS", most)
        got = {(r.doc_id, r.item_id): r for r in op10_decontaminate.leaks(docs, bench).collect()}
        assert set(got) == {(b + i, i) for i in range(20) for b in (100, 200)}
        assert all(got[100 + i, i].score == 1 and (got[100 + i, i].first_word, got[100 + i, i].last_word) == (200, 229) for i in range(20))
        assert {r.doc_id for r in op10_decontaminate.decontaminate(docs, bench).collect()} == {300 + i for i in range(20)}
    assert op10_decontaminate.leaks(none, bench).count() == 0
    assert op10_decontaminate.leaks(docs, bench.where("false")).count() == 0
    assert op10_decontaminate.decontaminate(odd, bench).count() == odd.count()


def test_leaks_of_frequent_words(spark):
    rng = random.Random(3)
    items = [(i, words_of(rng, 24, 60)) for i in range(6)]  # no trigram of so few words is rare
    w = [text.split() for _, text in items]
    rows = [(i, " ".join("changed" if j % 8 == 3 else x for j, x in enumerate(w[i]))) for i in range(6)]
    for start in range(22):  # any three words changed, and a word put in after every other one: exactly THRESHOLD
        rows.append((100 + start, " ".join("changed" if start <= j < start + 3 else x for j, x in enumerate(w[0]))))
    rows.append((200, " ".join(x + (" put" if j % 2 and j < 23 else "") for j, x in enumerate(w[1]))))
    rows += [(1000 + i, words_of(rng, 80, 60)) for i in range(200)]
    got = {(r.doc_id, r.item_id): r.score for r in op10_decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    codes = {}
    coded = lambda words: [codes.setdefault(x, len(codes) + 1) for x in words]
    exact = {(k, i): plain_alignment(coded(w[i]), coded(text.split())) / 24 for k, text in rows for i in range(6)}
    assert got == {k: s for k, s in exact.items() if s >= op10_decontaminate.THRESHOLD} and len(got) >= 29


def test_leaks_against_all_pairs(spark):
    rng = random.Random(21)
    items = [(i, words_of(rng, rng.choice([1, 2, 4, 5, 6, 9, 20, 60]), 300)) for i in range(40)] + [(40, "the"), (41, None), (None, words_of(rng, 30, 300)), (5, words_of(rng, 12, 300))]
    rows = []
    for i in range(150):
        body = words_of(rng, rng.randint(0, 60), 300).split()
        for _ in range(rng.randint(0, 3)):  # edited copies, of which about half stay above the threshold
            part = [x for w in (rng.choice(items)[1] or "").split() for x in (w, "put")[: 1 + (rng.random() < 0.12)] if rng.random() > 0.12]
            body[rng.randint(0, len(body)) :] = ["new" if rng.random() < 0.1 else x for x in part] + body[:9]
        rows.append((i % 140 if i else None, " ".join(body)))
    rows += [(200 + i, rows[3][1]) for i in range(5)] + [(300, None), (301, "the " * 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r.doc_id, r.item_id, round(r.score, 6)) for r in op10_decontaminate.leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect())
    codes = {}
    coded = lambda text: [codes.setdefault(x, len(codes) + 1) for x in (text or "").lower().split()]
    want = Counter()
    for k, text in rows:
        for i, item in items:
            x = coded(item)
            if i is not None and len(x) >= 5 and (best := plain_alignment(x, coded(text))) >= max(5, len(x) / 2):
                want[k, i, round(best / len(x), 6)] += 1
    assert got == want and 30 < sum(want.values())


# pipeline and contract ---------------------------------------------------------------------------------------------


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "quality", "near_duplicates", "decontamination", "pieces"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.near_duplicates(spark, docs, SF)
    want = {c for _, c, _ in brute_force([(r.doc_id, r.text) for r in docs.collect()]).values()}
    assert {r.doc_id for r in kept.collect()} == want and kept.columns == docs.columns
    out = corpus_pipeline.run(spark, SF)
    assert 0 < out.count() < docs.count() and out.where("not round_trip").count() == 0


def test_pipeline_stages_keep_columns_and_rows_apart(spark, odd, none):
    import corpus_pipeline

    rng = random.Random(2)
    near = words_of(rng, 60, 5000)
    rows = [(5, near, "en"), (5, words_of(rng, 50, 5000), "en"), (6, near + " more", "en"), (None, words_of(rng, 40, 5000), "en"), (None, near + " else", "en"), (7, near, "en"), (8, words_of(rng, 30), None)]
    rows += [rows[6]]
    extra = {"lang_pred": F.lit("p"), "lang_score": F.lit("s"), "quality_score": F.lit("q"), "QUALITY_PRED": F.lit(7), "_leak": F.lit("l"), "_row": F.lit("r"), "a.b": F.lit("dot"), "n_pieces": F.lit("n"), "decoded": F.lit("d")}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"source": F.lit("s"), "n_chars": F.lit(1)}).withColumns(extra)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "pieces":
            assert out.schema.names == docs.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        for r in out.select(*[F.col(f"`{c}`") for c in out.columns]).collect():
            got = r.asDict()
            assert all(got.get(c, "") == v for c, v in {"lang_pred": "p", "_leak": "l", "_row": "r", "a.b": "dot", "QUALITY_PRED": 7}.items())
        if name == "near_duplicates":
            assert sorted((r.doc_id or 0, r.text) for r in out.collect()) == sorted([(0, rows[3][1]), (5, near), (5, rows[1][1]), (8, rows[6][1])])
        if name == "pieces":
            assert {r.n_pieces for r in out.collect()} != {"n"} and out.where("round_trip").count() == len(rows)
        assert stage(spark, odd, SF).count() <= odd.count() and stage(spark, none, SF).count() == 0


def test_pipeline_language_and_leaks(spark):
    import corpus_pipeline

    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    net = op3_language.learn(docs)
    kept = {r.doc_id for r in corpus_pipeline.language(spark, docs, SF).collect()}
    assert kept == {r.doc_id for r in op3_language.identify(docs, net).where(f"lang_pred <> 'und' and lang_score >= {corpus_pipeline.LEAST_LANGUAGE}").collect()}
    kept = {r.doc_id for r in corpus_pipeline.decontamination(spark, docs, SF).collect()}
    assert kept == {r.doc_id for r in docs.collect()} - {r.doc_id for r in op10_decontaminate.leaks(docs, items).collect()}


def test_pipeline_quality_is_the_classifiers(spark, tmp_path, monkeypatch):
    import corpus_pipeline

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    k = len(op5_quality.FEATURES)
    edges, tables = [np.array([4.0])] + [np.empty(0)] * (k - 1), [np.array([0.4, 2.0])] + [np.zeros(1)] * (k - 1)
    model = op5_quality.AdditiveModel(0.0, edges, tables, [])  # scores of 0.6 and 0.88
    with monkeypatch.context() as m:
        m.setattr(op5_quality, "train", lambda *_: model)
        rows = spark.createDataFrame([(1, "a short one"), (2, "word " * 500)], "doc_id long, text string")
        assert {r.doc_id: r.quality_pred for r in op5_quality.classify(rows, model).collect()} == {1: 0, 2: 1}
        assert [r.doc_id for r in corpus_pipeline.quality(spark, rows, SF).collect()] == [2]
    labels.where("false").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.quality(spark, docs, str(tmp_path)).count() == docs.count()


def test_contract_columns(spark):
    from tessera.llm import queries

    made = queries.queries()
    assert [n.split("_")[0] for n in made] == [f"op{i}" for i in range(1, 11)]
    r = made["op6_merkle"](spark, SF).where("doc_id = 0").first()
    docs = {x.doc_id: x.text for x in spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 2").collect()}
    n = len(docs[0])
    assert r.n_chars == n and r.edited_sha256 == hashlib.sha256((docs[0][: n - n // 2] + docs[1][: n // 2]).encode()).hexdigest()
