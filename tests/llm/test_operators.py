"""The training-data operators on small tables: brute force, ties, nulls, empty and long texts, repeated rows."""

import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cleargrain.llm import html_extract, langid, mixing, neardup, ngram_join, packing, quality, sharding, topk, toxicity
from cleargrain.llm.components import connected_components, roots_of

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, key string"


@pytest.fixture(scope="module")
def odd_docs(spark):
    """Nulls, blanks, ties, repeated rows, a very long text, and columns whose names clash with the operators' own."""
    rows = [
        (1, "one two three four five six", "en", "a", 1, "x", "y"), (2, None, None, None, None, None, None), (3, "", "en", "", 0, None, None),
        (4, " \t\n", "en", "a", 3, None, None), (5, "one two three four five six", "en", "b", 1, None, None), (5, "one two three four five six", "en", "b", 1, None, None),
        (None, "lonely words", None, "b", 2, None, None), (6, "wort " * 30_000, "de", "c", 1, None, None), (7, "été 中文 \x1f x", "fr", "a", 1, None, None), (8, "42 !!", "en", "a", 1, None, None),
    ]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


def rows_of(df):
    return [r.asDict() for r in df.collect()]


# ---- components


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40) if i % 10 != 9] + [(100, 100), (7, 7)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: i // 10 * 10 for i in range(40)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- 1 near duplicates


def test_near_duplicates_match_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 64))
    x = np.vstack([base, base[:20] + 0.03 * rng.standard_normal((20, 64)), np.repeat(base[:1], 30, axis=0) + 0.02 * rng.standard_normal((30, 64)), base[5:6]])
    label = [i % 3 for i in range(60)] + [i % 3 for i in range(20)] + [0] * 30 + [5 % 3]
    rows = [(i, [float(v) for v in x[i]], label[i]) for i in range(len(x))]
    rows += [(900, None, 0), (901, [0.0] * 64, 0), (902, [None] + [1.0] * 63, 0), (903, [float("nan")] * 64, 0), (904, [1.0, 2.0], 0), (905, [float(v) for v in x[0]], None)]
    got = {r["vec_id"]: r for r in rows_of(neardup.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")))}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = (u @ u.T >= 0.93) & (np.array(label)[:, None] == np.array(label))
    np.fill_diagonal(link, False)
    root = list(range(len(x)))
    for _ in range(len(x)):
        root = [min([root[i], *[root[j] for j in np.flatnonzero(link[i])]]) for i in range(len(x))]
    assert len(got) == len(rows)
    for i in range(len(x)):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (link[i].sum(), root[i], root[i] == i)
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in range(900, 906))


@pytest.mark.parametrize("dim", [24, 64])
def test_no_pair_at_the_threshold_is_missed(dim):
    code, rng = neardup.product_code(dim), np.random.default_rng(dim)
    assert code.signs.nbytes <= neardup.ROUNDS * neardup.CODES * 2 * dim
    x = rng.standard_normal((1000, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal(x.shape)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y = 0.93 * x + math.sqrt(1 - 0.93**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    assert all(len(np.intersect1d(a, b)) for a, b in zip(code.decode(x), code.decode(y)))


def test_crowded_filters_are_split(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 8)
    rng = np.random.default_rng(4)
    one = rng.standard_normal(32)
    rows = [(i, [float(v) for v in one + 0.01 * rng.standard_normal(32)], 1) for i in range(80)]
    got = rows_of(neardup.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), rows_per_task=16))
    assert {(r["n_links"], r["component_id"]) for r in got} == {(79, 0)}


def test_vectors_that_share_an_id_link_apart(spark):
    rng = np.random.default_rng(5)
    one, two = rng.standard_normal((2, 64))
    near = lambda x: [float(v) for v in x + 0.02 * rng.standard_normal(64)]
    rows = [(7, near(one), 1), (7, near(two), 1), (3, near(one), 1), (9, near(two), 1), (12, near(two), 1), (9, near(two), 2), (9, near(two), 2)]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in rows_of(neardup.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))))
    assert got == [(3, 1, 3, True), (7, 1, 3, False), (7, 2, 7, True), (9, 1, 9, True), (9, 1, 9, True), (9, 2, 7, False), (12, 2, 7, False)]


def test_near_duplicates_of_nothing(spark):
    assert neardup.link_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


# ---- 2 packing


def test_pieces_and_sequences(odd_docs):
    got = rows_of(packing.pack_documents(odd_docs))
    encoder = packing.ChunkEncoder(packing.TOKENIZER)
    for r in odd_docs.collect():
        ids = np.array([*(np.frombuffer(encoder.whole([r["text"]])[0], dtype="<u4") if r["text"] else []), 1], dtype="<u4")
        own = sorted((p for p in got if p["doc_id"] == r["doc_id"]), key=lambda p: p["start"])
        assert sum(p["length"] for p in own) == len(ids) * odd_docs.where(F.col("doc_id").eqNullSafe(F.lit(r["doc_id"]))).count()
        for p in own:
            part = ids[p["start"] : p["start"] + p["length"]]
            assert p["ids_crc32"] == zlib.crc32(part.tobytes()) and p["start"] == 4096 * p["piece"]
    by_sequence = {}
    for p in got:
        by_sequence.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by_sequence) == math.ceil(sum(p["length"] for p in got) / 4096)


def test_chunks_encode_like_the_whole():
    random.seed(2)
    encoder = packing.ChunkEncoder(packing.TOKENIZER)
    alphabet = list("abcXYZ'st 09.,!-_@\n\t") + list("éÉüßñŒłſŉİıЖΣς中あ한́\xa0​\x85\x1f\x00😀ﬁ½")
    for _ in range(500):
        text = "".join(random.choice(alphabet) for _ in range(random.randint(0, 40)))
        assert encoder.whole([text])[0] == encoder.encode(text)


def test_local_search_empties_bins():
    rng = np.random.default_rng(1)
    lengths = rng.integers(900, 1900, 600)
    start = packing.best_fit_decreasing(lengths, 4096)
    better = packing.improve([list(b) for b in start], lengths, 4096)
    assert sorted(i for b in better for i in b) == list(range(600)) and all(lengths[b].sum() <= 4096 for b in better)
    assert len(better) <= len(start) and sum(lengths[b].sum() ** 2 for b in better) >= sum(lengths[b].sum() ** 2 for b in start)


def test_rounds_pack_what_blocks_leave(spark):
    pieces = spark.range(500).selectExpr("id as doc_id", "0 as piece", "0L as start", "cast(300 + id * 37 % 900 as long) as length", "id as ids_crc32")
    got = packing.pack_pieces(pieces, block_rows=60)
    fills = [r[0] for r in got.groupBy("sequence_id").agg(F.sum("length")).select("sum(length)").collect()]
    assert got.count() == 500 and max(fills) <= 4096 and len(fills) <= 1.03 * math.ceil(sum(fills) / 4096)


def test_ids_stay_whole_beside_nulls(spark):
    big = 2**60 + 1
    docs = spark.createDataFrame([(big, "one two"), (None, "three"), (big + 2, None)], "doc_id long, text string").coalesce(1)
    lexicon = toxicity.ToxicLexicon()
    for got in (packing.pack_documents(docs), toxicity.score_toxicity(docs, lexicon), ngram_join.join_ngrams(docs), langid.identify_languages(docs, None)):
        assert {r["doc_id"] for r in got.collect()} == {big, big + 2, None}
    pages = docs.selectExpr("doc_id as page_id", "cast(null as string) as url", "text as html")
    assert {r["page_id"] for r in html_extract.extract_pages(pages).collect()} == {big, big + 2, None}
    assert packing.pack_documents(docs.limit(0)).count() == 0
    ids = packing.tokenize_pieces(docs, with_ids=True).collect()
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in ids)


# ---- 3 html


def page(i, body, foot="</article><footer>&copy; x</footer></body></html>"):
    return f"<html><head><title>t</title><script>var t='</p>';</script></head><body><nav><a href=/>menu {i}</a></nav><div class='ad'>buy {i}</div><article><h1>Head {i}</h1>{body}{foot}"


def test_extraction(spark):
    rows = [(i, "http://h.example.com/a", page(i, f"<p>A&amp;B <b>bo</b>ld {i}<br>x\n y</p><aside>side</aside><div class='comments'><p>reply</p></div><form>f</form>")) for i in range(6)]
    rows += [(10, "http://h.example.com/b", page(10, "<p>cut off", "")), (11, None, "plain &lt;text&gt;"), (12, "::bad[", None), (13, "http://one.example.org", ""), (13, "http://one.example.org", "")]
    rows += [(20 + i, "http://div.example.com", f"<body><div class=menu>m</div><div class=body><p>word {i} of a longer text</p></div><div id=footer>f</div></body>") for i in range(4)]
    got = {}
    for r in rows_of(html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string"))):
        got.setdefault(r["page_id"], []).append(r["text"])
        assert r["n_chars"] == len(r["text"])
    assert got[3] == ["Head 3 A&B bold 3 x y"] and got[10] == ["Head 10 cut off"] and got[11] == ["plain <text>"] and got[12] == [""] and got[13] == ["", ""]
    assert got[21] == ["word 1 of a longer text"]
    joined = html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), max_broadcast_bytes=0)
    assert sorted(r["text"] for r in joined.collect()) == sorted(t for ts in got.values() for t in ts)


@pytest.mark.parametrize("wrapper", ["div class='has-sidebar'", "div id=comments-open", "form action=/"])
@pytest.mark.parametrize("article", ["article", "main", "div class=body"])
def test_wrappers_do_not_take_the_article_along(spark, wrapper, article):
    close = [x.split()[0] for x in (wrapper, article)]
    text = "one long story of some twenty words that the page is about and that goes on for a while"
    rows = [
        (i, "http://w.example.com", f"<body><nav>menu</nav><{wrapper}><{article}><p>{text} {i}</p></{close[1]}><aside>side</aside><div class=comments><article>reply</article></div></{close[0]}></body>")
        for i in range(4)
    ]
    if article.startswith("div"):  # articles in comments would pass for the page's own
        rows = [(i, u, h.replace("<article>", "").replace("</article>", "")) for i, u, h in rows]
    got = html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r["page_id"], r["text"]) for r in got) == [(i, f"{text} {i}") for i in range(4)]


@pytest.mark.parametrize("n", [1, 3, 8])
@pytest.mark.parametrize("around", ["{}", "<div class=body>{}</div>", "<div class=body><section><div>{}</div></section></div>"])
def test_the_whole_article_stays(spark, n, around):
    """Headings that all pages share, alone or beside others, and elements whose names hold a listed word among others; what is named apart goes."""
    names = ["search-history", "notice-board", "reply-to-critics", "share-price", "ad-1905", "neutral"]
    rows, want = [], {}
    for i in range(n):
        told = "".join(f"<div class='{c}'><p>chapter {i} on {c}</p></div>" for c in names)
        body = f"<h1>Dish {i}</h1><h2>Ingredients</h2><p>salt and {i} eggs</p><h2>Method</h2><p>boil for {i} minutes</p><h3 class=part>Notes</h3><div class=last><h2>Serving</h2></div>{told}"
        gone = "<div class=ad>buy</div><div class='related-posts'><p>other</p></div><div class='Share shareButtons'>share it</div><aside>side</aside><div id=comments><p>reply</p></div>"
        rows.append((i, f"http://dishes{n}.example.com/{i}", f"<body><nav>menu</nav><article>{around.format(body + gone)}</article><div class='search-history'>past</div><footer>end</footer></body>"))
        want[i] = f"Dish {i} Ingredients salt and {i} eggs Method boil for {i} minutes Notes Serving " + " ".join(f"chapter {i} on {c}" for c in names)
    pages = spark.createDataFrame(rows + rows[:1], "page_id long, url string, html string")
    got = [(r["page_id"], r["text"]) for r in html_extract.extract_pages(pages).collect()]
    assert sorted(got) == sorted([*want.items(), (0, want[0])])


def test_lists_of_links_stay_unless_they_repeat(spark):
    text = "a story of a good many words with its sources below it"
    rows = [
        (i, "http://l.example.com", f"<body><nav>menu</nav><article><a name=top><div class=text><p>{text} {i}</p></div><ul class=sources><li><a href=/>source {i} alone</a></ul><ul class=tags><li><a href=/>all tags</a></ul></article></body>")
        for i in range(4)
    ]
    rows += [(9, "http://one.example.com", rows[0][2].replace("<ul class=tags><li><a href=/>all tags</a></ul>", ""))] * 2
    got = html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {(r["page_id"], r["text"]) for r in got} == {(i, f"{text} {i} source {i} alone") for i in range(4)} | {(9, f"{text} 0 source 0 alone")}


def test_texts_of_the_template_are_no_content(spark):
    """A notice and a reader comment in elements of neutral names, more words than some articles, the same on all pages."""
    story = lambda i: " ".join(f"word{i}x{k}" for k in range(12 + i))
    notice = "please note that this site moves to another address in the coming month and that all readers should take note of that"
    rows = [
        (i, "http://n.example.com", f"<body><div class=x><div><p>{story(i)}</p><p class=advert>buy {i}</p><p>Share this story<p>{story(i)} again</div><div><p>{notice}</p><span>first! {notice}</span></div></div></body>")
        for i in range(8)
    ]
    # a host of copies keeps its text
    rows += [(20 + i, "http://c.example.com", "<body><div><p>one and the same story on each page</p></div></body>") for i in range(6)]
    rows += [(30, "http://s.example.com", "<table><tr><td class=sidebar>links<td><p>a layout of tables<tr><td class=menu>more<td>goes on</table>")]
    rows += [(31, "http://d.example.com", "<div>" * 3_000 + "deep text" + "</div>" * 3_000), (32, "http://e.example.com", "<body><p>" + "long words " * 50_000)]
    odd = spark.createDataFrame([(*r, "c", [1]) for r in rows], "page_id long, url string, html string, host string, texts array<long>")
    got = {r["page_id"]: r["text"] for r in html_extract.extract_pages(odd).collect()}
    assert all(got[i] == f"{story(i)} {story(i)} again" for i in range(8))
    assert all(got[20 + i] == "one and the same story on each page" for i in range(6))
    assert got[30] == "a layout of tables goes on" and got[31] == "deep text" and got[32] == ("long words " * 50_000).strip()
    assert html_extract.extract_pages(odd.limit(0)).count() == 0
    beside = {r["page_id"]: r["text"] for r in html_extract.extract_pages(odd, max_broadcast_bytes=0).collect()}
    assert beside == got


def test_extraction_of_made_pages_is_whole(spark):
    """Pages made from known blocks: what comes out is the article's blocks and no other, whatever the page's parts are called."""
    rng = random.Random(12)
    words = [f"w{k}" for k in range(500)]
    say = lambda n: " ".join(rng.choices(words, k=n))
    rows, wanted = [], {}
    for h in range(6):
        menu, foot = say(6), say(25)
        for i in range(12):
            blocks = [say(rng.randint(5, 40)) for _ in range(rng.randint(1, 5))]
            body = "".join(f"<p>{b}</p>" if rng.random() < 0.7 else f"<ul><li>{b}</ul>" for b in blocks)
            tag = ("article", "main", "div class=c1", "div id=text", "section", "td")[h]
            html = f"<html><head><title>{say(4)}</title></head><body><div class=k><a href=/>{menu}</a></div><{tag}>{body}</{tag.split()[0]}><div class=z>{foot}</div></body></html>"
            rows.append((100 * h + i, f"http://h{h}.example.com/{i}", html))
            wanted[100 * h + i] = " ".join(blocks)
    got = {r["page_id"]: r["text"] for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    assert got == wanted


# ---- 4 sharding


def test_shards(odd_docs, spark):
    got = rows_of(sharding.shard_documents(odd_docs, 3))
    sizes = [sum(r["shard"] == k for r in got) for k in range(3)]
    assert sum(sizes) == 10 and max(sizes) - min(sizes) <= 1
    for k in range(3):
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(sizes[k]))
    assert all(r["size"] == 1 and r["text_crc32"] == 0 for r in got if r["doc_id"] in (2, 3))
    docs = spark.range(4000).selectExpr("id as doc_id", "'t' as text", "if(id % 3 = 0, 'hot', concat('s', id % 7)) as source")
    mixture = sharding.shard_documents(docs).groupBy("source", "shard").count().groupBy("source").agg(F.max("count") - F.min("count")).collect()
    assert all(r[1] <= 2 for r in mixture)
    assert sharding.shard_documents(docs.limit(0)).count() == 0


# ---- 5 language


def test_language(spark, odd_docs):
    words = {"en": "the of and that with house water", "de": "der die und nicht haus wasser über"}
    rows = [(i, " ".join(random.Random(i).choices(words[lang].split(), k=20)), lang) for i in range(80) for lang in (("en", "de")[i % 2],)]
    model = langid.fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    tests = spark.createDataFrame([(1, "the waters and houses"), (2, "wasserhaus und nichts"), (3, None), (4, "123 !!"), (5, "")], "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify_languages(tests, model).collect()}
    assert (got[1][0], got[2][0]) == ("en", "de") and got[3] == got[4] == got[5] == ("und", 0.0)
    odd = spark.createDataFrame([(1, "½ ² Ⅷ 3"), (2, "½the² water"), (3, "ª")], "doc_id long, text string")
    assert {r["doc_id"]: (r["lang_pred"], r["n_words"]) for r in langid.identify_languages(odd, model).collect() if r["doc_id"] < 3} == {1: ("und", 0), 2: ("en", 2)}
    assert langid.identify_languages(odd_docs, model).count() == 10
    assert langid.fit_languages(odd_docs.limit(0)) is None
    assert {r["lang_pred"] for r in langid.identify_languages(odd_docs, None).collect()} == {"und"}


def test_language_matches_plain_counts(spark):
    """Scores by word-first backoff, from plain Python counts over the same rows."""
    rng = random.Random(8)
    vocabulary = {"en": "the of and water house stone".split(), "de": "der und wasser haus stein".split()}
    rows = [(i, " ".join(rng.choices(vocabulary[lang], k=15)), lang) for i in range(60) for lang in (("en", "de")[i % 2],)]
    kept = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    count = {lang: [w for _, t, x in kept if x == lang for w in t.split()] for lang in ("de", "en")}

    def log_share(items, item):
        kinds = {x for xs in items.values() for x in xs}
        return [math.log((items[lang].count(item) + 0.5) / (len(items[lang]) + 0.5 * (len(kinds) + 1))) for lang in ("de", "en")] if item in kinds else None

    def score(word):
        own = log_share(count, word)
        for n in (4, 3, 2, 1):
            if own is None:
                pieces = {lang: [g for w in set(ws) for g in langid.grams(w, n)] for lang, ws in count.items()}
                found = [x for g in langid.grams(word, n) if (x := log_share(pieces, g)) is not None]
                own = [sum(x[k] for x in found) / len(found) for k in (0, 1)] if found else None
        return own or [0.0, 0.0]

    texts = {0: "the wasser waters hausen", 1: "stones stone zzz", 2: "und undstone q" + " steinhaus" * 50, 3: "xq " + "unseen" * 5_000}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in langid.identify_languages(docs, langid.fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"))).collect():
        total = [sum(score(w)[k] for w in texts[r["doc_id"]].split()) for k in (0, 1)]
        share = [math.exp((x - max(total)) / max(1.0, len(texts[r["doc_id"]].split()) / 20)) for x in total]
        assert r["lang_pred"] == ("de" if total[0] >= total[1] else "en") and abs(r["score"] - max(share) / sum(share)) < 1e-9


# ---- 6 mixing


def brute_targets(sizes):
    weights = [(5, 2, 1)[k % 3] for k in range(len(sizes))]
    target, capped = [0.0] * len(sizes), set()
    while True:
        rest = sum(sizes) - sum(3 * sizes[k] for k in capped)
        share = sum(w for k, w in enumerate(weights) if k not in capped)
        over = {k for k in range(len(sizes)) if k not in capped and rest * weights[k] / share > 3 * sizes[k]} if share else set()
        if not over:
            return [3.0 * sizes[k] if k in capped else rest * weights[k] / share for k in range(len(sizes))]
        capped |= over


def test_mix(spark, odd_docs):
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)), rng.choice(["a", "b", "b", "b", "b", "c", None])) for i in range(300)]
    got = rows_of(mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")))
    by = {s: [r for r in got if r["source"] == s] for s in ("a", "b", "c", None)}
    sizes = [sum(r["size"] for r in rs) for rs in by.values()]
    for rs, size, target in zip(by.values(), sizes, brute_targets(sizes)):
        assert all(r["source_size"] == size and abs(r["target"] - target) < 1e-6 and 0 <= r["taken"] <= 3 * r["size"] for r in rs)
        assert abs(sum(r["taken"] for r in rs) - target) <= 1
    odd = rows_of(mixing.mix_sources(odd_docs))
    assert len(odd) == 10 and sorted(map(str, odd)) == sorted(map(str, rows_of(mixing.mix_sources(odd_docs.repartition(2)))))
    assert mixing.mix_sources(odd_docs.limit(0)).count() == 0


# ---- 7 quality, 10 toxicity


def test_quality(spark, odd_docs):
    rng = random.Random(1)
    good = lambda: "The " + " ".join(rng.choices("river stone cloud walks under bright morning".split(), k=30)) + "."
    bad = lambda: " ".join(w + "%%%" for w in rng.choices("river stone cloud walks under".split(), k=30))
    docs = spark.createDataFrame([(i, bad() if i % 4 == 0 else good()) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(200)] + [(7, None, None)], "doc_id long, quality int, toxic int")
    model = quality.fit_quality(docs, labels)
    got = {r["doc_id"]: r["score"] for r in quality.score_quality(docs, model).collect()}
    assert all((got[i] >= 0.3) == (i % 4 != 0) for i in got)
    odd = quality.score_quality(odd_docs, model).collect()
    assert len(odd) == 10 and all(0 <= r["score"] <= 1 for r in odd)
    assert {r["score"] for r in quality.score_quality(odd_docs, quality.fit_quality(docs, labels.limit(0))).collect()} == {0.5}


def test_quality_votes_match_brute_force(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices("river stone cloud walk under bright tea market".split(), k=20)) + ("!" * (i % 3)), i % 2) for i in range(120)] + [(500, "", 1), (501, None, 1)]
    rows += [(600, rows[1][1], 0), (1, "same id, other text", 1)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], 0) for r in rows], "doc_id long, quality int, toxic int")
    model = quality.fit_quality(docs, labels, rank=8)
    shingler = ngram_join.Shingler()
    got = sorted((r["doc_id"], round(r["score"], 9)) for r in quality.score_quality(docs, model, k=7).collect())
    plain = []
    for i, text, _ in rows:
        v = (quality.term_weights(text, shingler).astype(float) * model.idf) @ model.components
        v = v / np.linalg.norm(v) if np.linalg.norm(v) > 1e-9 else v
        near = sorted(((float(v @ u), y) for u, y in zip(model.vectors.astype(float), model.labels)), key=lambda x: -x[0])[:7]
        total = sum(max(c, 0) for c, _ in near)
        plain.append((i, sum(max(c, 0) * y for c, y in near) / total if total > 1e-9 else model.prior))
    assert [i for i, _ in got] == sorted(i for i, _ in plain) and all(abs(a[1] - b[1]) < 1e-4 for a, b in zip(got, sorted(plain)))
    assert quality.score_quality(docs.limit(0), model).count() == 0


def test_quality_space_knows_words(spark):
    rng = random.Random(3)
    of = lambda words, k: " ".join(rng.choices(words.split(), k=k))
    rows = [(i, of("river stone cloud hill", 20) if i % 2 else of("casino bonus jackpot spin", 20), i % 2) for i in range(200)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2], 0) for r in rows], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["score"] for r in quality.score_quality(docs, quality.fit_quality(docs, labels)).collect()}
    assert all((got[i] > 0.5) == (i % 2 == 1) for i in range(200))


def test_toxicity(spark, odd_docs):
    rng = random.Random(1)
    plain = lambda: " ".join(rng.choices("river stone cloud walks under bright morning you there".split(), k=30))
    docs = [(i, plain() + (f" you {('zorgle', 'blimpf')[i % 2]} there" if i % 5 == 0 else " blue zorgle tea" if i % 7 == 1 else "")) for i in range(300)]
    docs = [(i, t if i % 5 == 0 or i % 7 != 1 else t.replace("blue zorgle tea", "calm")) for i, t in docs]
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    lexicon = toxicity.fit_toxicity(spark.createDataFrame(docs, "doc_id long, text string"), labels)
    tests = [(1, "a Z0RGLE!"), (2, "a zоrglе"), (3, "blim​pf"), (4, "zorglet"), (5, "river stone"), (6, None), (7, "")]
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(spark.createDataFrame(tests, "doc_id long, text string"), lexicon).collect()}
    assert all(got[i] >= 0.3 for i in (1, 2, 3)), (got, lexicon.weights)
    assert all(got[i] < 0.3 for i in (5, 6, 7))
    assert toxicity.score_toxicity(odd_docs, lexicon).count() == 10
    none = toxicity.fit_toxicity(odd_docs, labels.limit(0))
    assert {r["score"] for r in toxicity.score_toxicity(odd_docs, none).collect()} == {0.0}


def test_toxicity_matches_plain_matching(spark):
    """Matches by plain search for every term at every place, and densities, over odd spacing and words of any length."""
    lexicon = toxicity.ToxicLexicon({" bad ": 2.0, " badder ": 3.0, " badd": 2.5, f" {'z' * 60} ": 4.0}, frozenset({"not bad", "bad luck"}), np.array([0.0, 1.0]), np.array([0.1, 0.9]))
    machine = lexicon.matcher()
    texts = ["bad", "not   bad", "bad -- luck", "badder bad", "baddest; b4d", "z" * 60, "x" * 300 + " bad " + "y" * 300, "", "bad bad"]
    for text in texts:
        folded = toxicity.fold(text)
        places = {}
        for term, weight in lexicon.weights.items():
            for at in range(len(folded)):
                if folded.startswith(term, at):
                    places[at] = max(places.get(at, (0, "")), (weight, term))
        plain = []
        for at, (weight, term) in sorted(places.items()):
            before, after = folded[:at].split()[-1:], folded[at:].split()[:2]
            if " ".join([*before, after[0]]) not in lexicon.exceptions and " ".join(after) not in lexicon.exceptions:
                plain.append((term, weight))
        assert sorted((t, w) for t, w, *_ in lexicon.matches(machine, folded)) == sorted(plain), text
        assert lexicon.density([(t, w, "", "") for t, w in plain], folded) == (sum(w for _, w in plain) / math.log2(4 + folded.count(" ")) if plain else 0.0)


def test_terms_are_picked_like_a_plain_greedy_search():
    rng = random.Random(4)
    tox = {f" t{i} ": sorted(rng.sample(range(60), rng.randint(3, 30))) for i in range(40)}
    clean = {t: rng.choice([0, 0, 0, 1]) for t in tox}
    got = toxicity.choose_terms({t: len(m) for t, m in tox.items()}, clean, 60, 4_000, tox)
    left, picked, usable = np.ones(60), [], {t for t in tox if t in got or clean[t] <= 0.02 * len(tox[t]) + 2}
    while usable:
        gain = {t: left[tox[t]].sum() * (1 - clean[t] / (len(tox[t]) + clean[t])) for t in usable}
        best = max(gain, key=lambda t: (round(float(gain[t]), 6), len(t), t))
        if gain[best] < 1:
            break
        picked.append(best)
        left[tox[best]] *= 0.3
        usable.remove(best)
    assert list(got) == picked


def test_exception_phrases(spark):
    rows = [(i, "you zorgle now") for i in range(40)] + [(i, "hot zorgle soup today") for i in range(100, 104)] + [(i, "calm river day") for i in range(200, 2400)]
    labels = spark.createDataFrame([(i, 1, int(i < 40)) for i, _ in rows], "doc_id long, quality int, toxic int")
    lexicon = toxicity.fit_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), labels, min_docs=2)
    machine = lexicon.matcher()
    assert lexicon.matches(machine, toxicity.fold("you zorgle now"))
    assert not lexicon.exceptions or not lexicon.matches(machine, toxicity.fold("hot zorgle soup"))


# ---- 8 top k


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((300, 16))
    x[40] = x[41]
    rows = [(i, [float(v) for v in x[i]]) for i in range(300)] + [(None, [1.0] * 16), (500, None), (501, [float("inf")] * 16), (502, [None] * 16)]
    vectors = topk.quantise(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {}
    for r in topk.search_top_k(vectors, vectors.where("vec_id % 50 = 0"), chunk_rows=50, query_rows=3).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    v = np.vstack([np.floor(256 * x), np.full((1, 16), 256.0)])
    ids = [*range(300), -1]
    for q in range(0, 300, 50):
        s = v @ v[q]
        best = sorted((i for i in range(301) if i != q), key=lambda i: (-s[i], ids[i]))[:5]
        assert sorted(got[q]) == [(k + 1, None if i == 300 else ids[i], int(s[i])) for k, i in enumerate(best)]
    assert set(got) == set(range(0, 300, 50))
    groups, _, _ = topk.make_groups(vectors, 5, 50, 8, 13)
    assert groups.size.sum() == 301 and len(groups.pivots) == 8
    few = topk.quantise(spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>"))
    assert topk.search_top_k(few, few.where("vec_id = 0")).count() == 2
    assert topk.search_top_k(few.limit(0), few.limit(0)).count() == 0


def test_top_k_sends_queries_only_where_needed(spark):
    rng = np.random.default_rng(9)
    centres = 4 * rng.standard_normal((20, 16))
    x = np.repeat(centres, 20, axis=0) * rng.uniform(0.9, 1.1, (400, 1)) + 0.05 * rng.standard_normal((400, 16))
    rows = [(i, [float(v) for v in x[i]]) for i in range(400)]
    vectors = topk.quantise(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    groups, _, _ = topk.make_groups(vectors, 5, 30, 4096, 13)
    v = np.floor(256 * x)
    assert groups.wanted(v, 5).mean() < 0.5  # of all copies of queries
    got = {}
    for r in topk.search_top_k(vectors, vectors, chunk_rows=30).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q in range(400):
        s = v @ v[q]
        best = sorted((i for i in range(400) if i != q), key=lambda i: (-s[i], i))[:5]
        assert sorted(got[q]) == [(k + 1, i, int(s[i])) for k, i in enumerate(best)]


def test_top_k_of_odd_rows(spark):
    big = 2**60
    rows = [(big + 1, [1.0, 2.0]), (big + 1, [1.0, 2.0]), (None, [1.0]), (big + 3, [1.0, 2.0, 0.5]), (5, [0.0, 0.0]), (6, [])]
    docs = spark.createDataFrame([(i, x, "c", 1) for i, x in rows], "vec_id long, embedding array<double>, cell string, row int")
    vectors = topk.quantise(docs)
    got = sorted(map(tuple, topk.search_top_k(vectors, vectors.where(f"vec_id = {big + 1}"), k=3).collect()))
    assert got == sorted([(big + 1, 1, big + 1, 327680), (big + 1, 2, big + 3, 327680), (big + 1, 3, None, 65536)] * 2)
    huge = topk.quantise(spark.createDataFrame([(0, [2.0**60, 1.0]), (1, [2.0**40, 3.0]), (2, [2.0**40, 2.0]), (3, [-(2.0**60), 0.0]), (4, [2.0**62, 0.0])], "vec_id long, embedding array<double>"))
    got = {r["rank"]: (r["vec_id"], r["score"]) for r in topk.search_top_k(huge, huge.where("vec_id = 0")).collect()}
    assert got == {1: (4, 2**63 - 1), 2: (1, 2**63 - 1), 3: (2, 2**63 - 1), 4: (3, -(2**63))}


# ---- 9 n-gram join


def brute_components(texts):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in texts.items():
        w = [x for x in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in (t or "").translate(table)).split(" ") if x]
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in texts}
    links = [(a, b) for a in texts for b in texts if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in texts:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return {i: (len(sets[i]), root[i]) for i in texts}


@pytest.mark.parametrize("region_shingles", [4_000_000, 400])
def test_ngram_join_matches_brute_force(spark, region_shingles):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(400)]
    texts, passage = {}, " ".join(rng.choices(vocabulary, k=60))
    for i in range(30):
        words = rng.choices(vocabulary, k=rng.randint(1, 120))
        texts[i * 10] = " ".join(words) if i % 3 else passage + " " + " ".join(words)
        for k in range(1, rng.randint(1, 8)):
            copy = list(texts[i * 10].split())
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts[i * 10 + k] = "  ".join(copy).upper()
    texts |= {1000: None, 1001: "", 1002: "one two", 1003: "ONE\ttwo", 1004: "x " * 40_000, 1005: "é ü"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join_ngrams(docs, region_shingles=region_shingles).collect()}
    assert got == brute_components(texts)


@pytest.mark.parametrize("percent", [40, 60, 70, 75, 80, 85])
def test_windows_share_what_is_needed_in_all_orders(percent):
    for size in range(1, 10):
        for owners in itertools.product("abc", repeat=size):  # of the first set, of the second, common
            a, b = [k for k, x in enumerate(owners) if x != "b"], [k for k, x in enumerate(owners) if x != "a"]
            if a and b and 100 * owners.count("c") >= percent * size:
                met = len({*a[: ngram_join.window_size(len(a), percent)]} & {*b[: ngram_join.window_size(len(b), percent)]})
                assert met >= max(ngram_join.window_needed(len(s), percent) for s in (a, b)) > 0, (a, b)
    assert [ngram_join.window_needed(n, 80) for n in (4, 5, 6, 10, 100)] == [1, 1, 2, 3, 21]


def test_ngram_join_links_short_texts_with_a_word_added(spark):
    texts = {}
    for i in range(0, 200, 10):
        words = [f"w{i}x{k}" for k in range(13)]
        for k in range(9):  # 1 to 9 shingles
            texts[i + k] = " ".join(words[: 5 + k]) if i % 20 else " ".join(words[8 - k :])
        if i % 40 == 0:  # the pair of 4 and 5 alone
            texts = {j: t for j, t in texts.items() if j < i or j - i in (3, 4)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join_ngrams(docs).collect()}
    assert got == brute_components(texts) and got[4] == (5, 3)


def test_ngram_join_of_odd_rows(spark, odd_docs):
    got = rows_of(ngram_join.join_ngrams(odd_docs))
    assert len(got) == 10 and {r["component_id"] for r in got if r["doc_id"] in (1, 5)} == {1}
    assert ngram_join.join_ngrams(odd_docs.limit(0)).count() == 0


def test_shingles_of_many_texts_in_one_go(monkeypatch):
    rng = random.Random(4)
    texts = [" ".join(rng.choices(["a", "Bc", "d\t", "é", "ü  x"], k=rng.randint(0, 30))) for _ in range(300)] + [None, "", "  ", "x y", "x " * 3_000, "one two three four five", "\n"]
    shingle = ngram_join.Shingler()
    for size in (1, 500, 1 << 18):
        monkeypatch.setattr(ngram_join, "CHUNK_BYTES", size)
        got = []
        for flat, sizes in shingle.chunks(None if t is None else t.encode() for t in texts):
            sets = np.split(flat, np.cumsum(sizes)[:-1])
            got += zip((s.tolist() for s in sets), ngram_join.points_of(flat, sizes).tolist())
        assert got == [(shingle(t).tolist(), ngram_join.point_of(shingle(t)) if len(shingle(t)) else 0) for t in texts]
    assert list(shingle.chunks([])) == []


def family(rng, near, far):
    """Shingle sets of a text of 120 words, of near copies with one word of their own and of far ones with four: these link with nothing."""
    base = [f"w{i}" for i in range(120)]
    out = [base]
    for k, edits in enumerate([1] * near + [4] * far):
        out.append(list(base))
        for place in range(edits):
            out[-1][25 * place + rng.randrange(8, 17)] = f"x{k}y{place}"
    shingle = ngram_join.Shingler()
    return [shingle(" ".join(words)) for words in out]


@pytest.mark.parametrize("percent", [60, 80, 85])
def test_sets_past_linking_take_no_part(percent):
    rng = random.Random(percent)
    for _ in range(300):
        sets = [{*rng.sample(range(14), rng.randint(1, 10))} for _ in range(5)]
        sizes, shared = np.array([len(s) for s in sets]), np.array([len(s & set().union(*(t for t in sets if t is not s))) for s in sets])
        may = ngram_join.may_link(sizes, shared, percent)
        for a, b in itertools.permutations(range(5), 2):
            assert may[a] or 100 * len(sets[a] & sets[b]) < percent * len(sets[a] | sets[b])
    sets = family(rng, 30, 40)
    shared = [np.isin(s, np.concatenate([t for t in sets if t is not s])).sum() for s in sets]
    assert ngram_join.may_link(np.array([len(s) for s in sets]), np.array(shared), 80).tolist() == [True] * 31 + [False] * 40
    root = ngram_join.link_in_region(sets, np.ones(71, bool), 80)
    assert root.tolist() == [0] * 31 + list(range(31, 71))


def test_split_does_not_multiply_a_family(spark, monkeypatch):
    sets = family(random.Random(2), 20, 20)
    rows = [(7, i, True, bytearray(s.tobytes())) for i, s in enumerate(sets)]
    placed = spark.createDataFrame(rows, "region long, point long, home boolean, shingles binary")
    sizes, cut = [], ngram_join.cut_lineage

    def counted(df):
        out = cut(df)
        sizes.extend([out.count()] if "shingles" in out.columns else [])
        return out

    monkeypatch.setattr(ngram_join, "cut_lineage", counted)
    links = [(r["a"], r["b"]) for part in ngram_join._split_regions(placed, 2_500, 80) for r in part.collect()]
    assert max(sizes) <= 2 * len(sets)  # each point in each of some 16 cells before
    root = roots_of(len(sets), np.array([a for a, _ in links]), np.array([b for _, b in links]))
    assert root.tolist() == [0] * 21 + list(range(21, 41))


def test_words_are_runs_of_letters_in_any_script():
    text = "".join(map(chr, range(0x250))) + " ǅ İ ß Σς ½a x²y ٣a Ⅳx ªb 中文、字 𝒜𝒷" + "Ab_c3D-é"
    for t in (text, text.encode("ascii", "ignore").decode(), "", None, "12 _", "\x1ca\x85b c"):
        assert langid.words_of(t) == "".join(c if c.isalpha() else " " for c in (t or "").lower()).split()
    assert type(langid.ASCII_LETTERS) is bytes and not hasattr(langid, "LETTERS")  # one pass over bytes, no pattern


def test_quality_terms_stay_as_they_were():
    shingler = ngram_join.Shingler()
    text = "One one two, 3 three!\nOne one two, 3 three!\n\nélan vital"
    words = shingler.words(text)
    terms = np.concatenate((words, ngram_join.mix(words[:-1] * np.uint64(3) + words[1:])))
    plain = np.bincount([int(t) % quality.WORD_CELLS for t in terms], minlength=quality.WORD_CELLS) / len(terms)
    assert np.allclose(quality.term_weights(text, shingler)[: quality.WORD_CELLS] ** 2, quality.WORD_PART * plain)
    n = len(text.lower().split())
    assert quality.repeat_shares(text)[0] == 2 / n
