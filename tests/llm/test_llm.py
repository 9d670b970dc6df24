"""The training-data operators against brute force, round trips, held-out accuracy, and odd rows."""

import collections
import hashlib
import math
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from panelyard.llm import byte_bpe, chat_format, exact_dedup, html_extract, lang_id, lm_scoring, minhash_dedup, packing, quality_rules, queries, url_gbt
from panelyard.llm._common import held_out, table

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

LONG = "lorem " * 30_000
#: Nulls in any column, empty and long texts, ties, repeated rows, columns with clashing names.
ODD = [
    (1, "the cat sat on the mat and the dog ran off with all of it again", "en", "q", 1),
    (1, "the cat sat on the mat and the dog ran off with all of it again", "en", "q", 1),
    (2, "the cat sat on the mat and the dog ran off with all of it again", None, None, None),
    (3, "", "en", "q", 1),
    (4, None, None, None, None),
    (None, "no id here", "en", None, 2),
    (5, " \t\n ", "fr", "q", 3),
    (6, LONG, "en", "q", 4),
    (7, "<|turn|> \\ ### | ### 日本語 é 😀 '' \"", "de", "q", 5),
    (8, "12345 !!! ...", "en", "q", 6),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, lang string, id string, n long")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(name, same_rows):
    same_rows(queries.QUERIES[name], queries.SQL[name])


def _documents(spark, sf_dir):
    return {r["doc_id"]: r["text"] for r in table(spark, sf_dir, "documents").collect()}


def brute_components(docs, words, percent):
    """Every pair of sets that share a shingle, counted through an inverted index."""
    sets = {}
    for d, text in docs.items():
        w = (text or "").encode().lower().split()
        n = min(words, len(w))
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
    holders, common = collections.defaultdict(list), collections.Counter()
    for d, s in sets.items():
        for g in s:
            common.update((e, d) for e in holders[g])
            holders[g].append(d)
    parent = {d: d for d in sets}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for (a, b), k in common.items():
        if 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def test_op1_rules_and_trees(spark, sf_dir):
    rows = queries.op1_url_filter(spark, sf_dir).collect()
    urls = {r["page_id"]: r["url"] for r in table(spark, sf_dir, "pages").collect()}
    assert len(rows) == len(urls)
    for r in rows:
        rest = urls[r["page_id"]].split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, path = rest[:cut].lower(), rest[cut:].split("?")[0].split("#")[0]
        assert (r["host"], r["path"]) == (host, path)
        fits = [(len(rule), v, rule) for v, rule in queries.URL_RULES if (host == rule.split("/")[0] or host.endswith("." + rule.split("/")[0])) and path.startswith(rule[rule.index("/") :])]
        best = max(fits, default=None)
        assert r["rule"] == (best[2] if best else None) and r["verdict"] == (best[1] if best else "block" if r["block_score"] >= 0.5 else "allow")


def test_op1_trees_learn_held_out_labels_and_odd_urls(spark):
    rows = [(i, f"http://{'x' * (i % 9)}{i}.bad-site.biz/a/{i}?p={i}&q=1" if i % 2 else f"http://news.example.org/story/{'y' * (i % 7)}", i % 2) for i in range(400)]
    labelled = spark.createDataFrame(rows[:300], "i long, url string, label int")
    pages = spark.createDataFrame([(r[0], r[1]) for r in rows[300:]] + [(9001, None), (9002, ""), (9003, "no scheme"), (9004, "HTTP://A.B?x"), (None, "http://a.b/c")], "page_id long, url string")
    out = url_gbt.judge(pages, [], labelled=labelled).collect()
    by = {r["page_id"]: r for r in out}
    assert np.mean([by[r[0]]["verdict"] == ("block" if r[2] else "allow") for r in rows[300:]]) > 0.95
    assert [(by[k]["host"], by[k]["path"]) for k in (9001, 9002, 9003, 9004, None)] == [("", ""), ("", ""), ("", ""), ("a.b", ""), ("a.b", "/c")]
    assert url_gbt.judge(pages.limit(0), queries.URL_RULES).count() == 0
    assert {r["verdict"] for r in url_gbt.judge(pages, []).collect()} == {"allow"}


@pytest.mark.parametrize(("words", "percent", "side"), [(3, 85, 10), (5, 80, 12)])
def test_op2_equals_brute_force(spark, sf_dir, words, percent, side):
    docs = table(spark, sf_dir, "documents")
    want = brute_components(_documents(spark, sf_dir), words, percent)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash_dedup.near_duplicates(docs, words=words, percent=percent, side=side).collect()}
    assert got == want


def test_op2_families_of_unlike_copies(spark):
    """Copies of one base with different edits: some pairs reach the similarity, some do not."""
    rng = np.random.default_rng(2)
    base = [f"w{i}" for i in range(120)]
    docs = {}
    for i in range(60):
        w = list(base)
        for k in rng.integers(0, 120, rng.integers(0, 9)):
            w[k] = f"e{i}x{k}"
        docs[i] = " ".join(w)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash_dedup.near_duplicates(df, words=3, percent=85, side=10).collect()}
    assert got == brute_components(docs, 3, 85)


def test_op2_odd_rows(odd, empty):
    rows = minhash_dedup.near_duplicates(odd, words=3, percent=85).collect()
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in rows), key=str)
    assert len(got) == len(ODD) and (2, 14, 1, False) in got and (4, 0, 4, True) in got and (5, 0, 5, True) in got and (6, 1, 6, True) in got and (None, 1, None, True) in got
    assert minhash_dedup.near_duplicates(empty).count() == 0
    assert minhash_dedup.keep_one(odd).columns == odd.columns and minhash_dedup.keep_one(empty).count() == 0


def test_op3_skeleton_pages_and_odd_html(spark, sf_dir):
    import re
    from html import unescape

    pages = {r["page_id"]: r["html"] for r in table(spark, sf_dir, "pages").collect()}
    for r in queries.op3_html_extract(spark, sf_dir).collect():
        inner = re.search("<article>(.*)</article>", pages[r["page_id"]], re.S)[1]
        blocks = [" ".join(unescape(re.sub("</?(?:b|br)>", "", b)).split()) for b in re.split("</?(?:p|h1)>", inner)]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])
    tail = ("w " * 50).strip()
    cases = {
        None: "", "": "", "plain": "plain", "<nav>x</nav><footer>y</footer>": "", "<p>a &amp; b&#233;<p> c\n d": "a & bé\nc d", "<p>a < b</p>": "a < b", "<!-- <p>no</p> --><p>yes<br>no": "yes no",
        "<article><h1>T</h1><aside>no</aside><p>A</p><div class='comments'>c</div><p>B</p></article><footer>f": "T\nA\nB", "<script>a<b</script><p>k</p>": "k", "<p title='x>y'>q</p>": "q",
        "<div class='sidebar'>s<div>t</div></div><p>m</p>": "m", "<p>unclosed <b": "unclosed <b", "<form><p>f</p></form><main><p>M</p></main>": "M",
        # raw elements, ends that are missing, names that only hint, articles that are furniture
        "<article><p>a</p><svg/><p>b</p></article>": "a\nb", "<select><option>x<option>y</select><p>z</p>": "z", "<SCRIPT>q</SCRIPT><p>İ</p><SCRIPT>q</SCRIPT><p>k</p>": "İ\nk", "<iframe><p>x</p>": "x",
        "<article><p>one</p><p class='ad'>buy<p>two</p></article>": "one\ntwo", "<article><div class='ad'>unclosed<p>x</p></article>": "", "<article><p>x</p><div class='related-work'>y</div><p id='form-of-verse'>z</p></article>": "x\ny\nz",
        "<aside><article>teaser</article></aside><article><p>real</p></article>": "real", "<div class='comments'><article>c</article></div><p>t</p>": "t", "<article>a <span class='ad'>no <b>x</b></span>b</article>": "a b",
        "<table><tr><td>a<td>b<tr><td>c</table>": "a b\nc", "<article><header><h1>T</h1></header><p>u</p></article>": "T\nu", "<div class='site-footer'>f</div><p>m</p>": "m",
        # the distribution decides: lists of links are no text, in an article or before one
        f"<article><p>{tail}</p><ul><li><a>p</a><li><a>q</a><li><a>r</a></ul></article>": tail, f"<ul><li><a>Home</a></li><li><a>News</a></li><li><a>Shop</a></li></ul><div>{tail}</div>": tail,
        f"<article><p>{tail}</p><p><a>s</a></p><p>end</p></article>": f"{tail}\ns\nend", "<p>a<a href=x>b</a></p>": "ab", "<p><a href=x>b</a></p>": "b",
        f"<div>outside the article</div><article><p>{tail}</p></article><div>more outside</div>": tail,
    }
    for html, want in cases.items():
        assert html_extract.main_text(html) == want, html
    df = spark.createDataFrame([(None if i % 5 == 0 else i // 2, None, h, "clash", i) for i, h in enumerate(cases)], "page_id long, url string, html string, text string, n_chars long")
    assert sorted(r["text"] for r in html_extract.extract(df).collect()) == sorted(cases.values())
    assert html_extract.extract(df.limit(0)).count() == 0


def test_op3_without_article_keeps_the_dense_run():
    menu = "<ul>" + "<li>x</li>" * 3 + "</ul>"
    body = "".join(f"<p>{'word ' * 30}</p>" for _ in range(5))
    links = "<div><a>one</a></div><div><a>two</a></div><div><a>three</a></div>"
    page = f"{links}{menu}{links}{body}{links}<p>tail</p>"
    assert html_extract.main_text(page) == "\n".join(["word " * 29 + "word"] * 5)


@pytest.mark.parametrize("piece", ["<a ", '<a "', "<p class='", "<div>", "<div></x>", "<!--", "<iframe>", "</", "<b hidden>", "<li>", "<span class=ad><i>", "&amp;", "<article>", "<svg>x"])
def test_op3_time_grows_with_the_page(piece):
    import time

    began = time.perf_counter()
    html_extract.main_text(piece * 100_000)
    assert time.perf_counter() - began < 10


def test_op4_base_counts_and_model(spark, sf_dir):
    docs = {d: (t or "").encode().lower().split() for d, t in _documents(spark, sf_dir).items()}
    test = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in docs}
    counts = collections.Counter(w for d, ws in docs.items() if not test[d] for w in ws)
    ends = sum(not t for t in test.values())
    total, kinds = sum(counts.values()) + ends, len(counts) + 1
    rows = queries.op4_lm_scoring(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ws = docs[r["doc_id"]]
        base = sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in ws) + math.log10((ends + 1) / (total + kinds + 1))
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (test[r["doc_id"]], len(ws) + 1, sum(counts[w] > 0 for w in ws) + 1, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] < 0
    # most words are looked up by the join when few are broadcast
    again = lm_scoring.score_documents(table(spark, sf_dir, "documents"), held_out("doc_id", 7, 2), WORDS, most_words=10).collect()
    assert {r["doc_id"]: (r["n_known"], round(r["base_score"], 6)) for r in again} == {r["doc_id"]: (r["n_known"], round(r["base_score"], 6)) for r in rows}


def _model(passes=12):
    chain = np.cumsum(np.random.default_rng(0).integers(1, 3, (400, 48)), axis=1) % 40
    model = lm_scoring.SubwordModel(np.bincount(chain.ravel(), minlength=50))
    model.learn(([*chain] for _ in range(passes)), batch=32)
    return model, chain


def test_op4_windows_score_each_id_once_and_never_look_ahead():
    half = lm_scoring.HALF
    texts = [np.arange(n) for n in (1, half - 1, half, half + 1, 5 * half)]
    inputs, targets, owner = lm_scoring.windows(texts, -1)
    for k, t in enumerate(texts):
        assert [v for row in targets[owner == k] for v in row if v >= 0] == t.tolist()
    model, _ = _model(1)
    long = np.arange(200) % 40
    changed = long.copy()
    changed[130:] = (changed[130:] + 7) % 40
    inputs, targets, owner = lm_scoring.windows([long, changed], model.start)
    logs = model.net.log10_probabilities(model.net.tables(), inputs, targets)
    a, b = (logs[owner == k].ravel() for k in (0, 1))
    assert np.allclose(a[:130], b[:130]) and not np.allclose(a[130:], b[130:])


def test_op4_probabilities_sum_to_one_and_beat_unigrams():
    model, chain = _model()
    for t in (chain[3][:1], chain[3][:20]):
        total = sum(10 ** (model.score([np.append(t, k)])[0] - model.score([t])[0]) for k in range(50))
        assert total == pytest.approx(1.0, abs=1e-4)
    held = (np.cumsum(np.random.default_rng(9).integers(1, 3, (50, 40)), axis=1)) % 40
    unigram = np.log10((np.bincount(chain.ravel(), minlength=50) + 0.5) / (chain.size + 25))
    fresh = lm_scoring.SubwordModel(np.bincount(chain.ravel(), minlength=50))
    assert fresh.score(list(held)).sum() == pytest.approx(unigram[held].sum(), rel=0.02)  # the tree begins with the unigram probabilities
    assert model.score(list(held)).sum() > 0.5 * unigram[held].sum()  # one of two ids can follow: 0.30 a token, unigrams 1.6


def test_op4_gradients():
    rng = np.random.default_rng(2)
    net = lm_scoring.Attention(lm_scoring.Tree(rng.integers(0, 9, 7)), 7, dims=4)
    net.p = {k: v.astype(np.float64) + 0.1 * rng.standard_normal(v.shape) for k, v in net.p.items()}
    inputs, targets = rng.integers(0, 8, (3, 2 * lm_scoring.HALF)), rng.integers(-1, 7, (3, lm_scoring.HALF))
    bias = lambda: np.where(net.back >= 0, net.p["R"][np.maximum(net.back, 0)], -1e9)  # noqa: E731  in double precision
    net.bias = bias

    def total():
        learner = lm_scoring.Learner(net)
        return learner.gradients(inputs, targets)[0] * net.tree.lengths[targets[targets >= 0]].size

    _, found = lm_scoring.Learner(net).gradients(inputs, targets)
    for name, w in net.p.items():
        g = found[name]
        if isinstance(g, tuple):
            dense = np.zeros(w.shape)
            dense[g[0]] = g[1]
            g = dense
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in w.shape)
            before = w[at]
            w[at] = before + 1e-5
            high = total()
            w[at] = before - 1e-5
            low = total()
            w[at] = before
            assert (high - low) / 2e-5 == pytest.approx(g[at], rel=2e-3, abs=2e-4), name


def test_op4_averages_rows_by_use(spark):
    rows = [("E", [1, 3], [2.0, 1.0], [[1.0, 1.0], [4.0, 4.0]]), ("E", [3], [3.0], [[0.0, 8.0]]), ("R", [0, 1], [5.0, 5.0], [[1.0], [2.0]])]
    packed = [(n, np.array(r, np.int32).tobytes(), np.array(w, np.float32).tobytes(), np.array(v, np.float32).tobytes()) for n, r, w, v in rows]
    df = spark.createDataFrame([tuple(map(lambda x: bytearray(x) if isinstance(x, bytes) else x, p)) for p in packed], lm_scoring._CHANGES).repartition(3)
    for fan in (2, 64):
        weight, total = lm_scoring.averaged(df, fan).sums["E"]
        assert (total[[1, 3]] / weight[[1, 3], None]).tolist() == [[1.0, 1.0], [1.0, 7.0]] and weight.tolist() == [0, 2, 0, 4]


def test_op4_every_window_trains_and_more_text_helps(spark, sf_dir):
    """All training texts move the weights; the trained score beats the untrained tree (unigrams) on held-out texts."""
    rows = queries.op4_lm_scoring(spark, sf_dir).collect()
    docs = _documents(spark, sf_dir)
    ids = packing.WordIds(WORDS, plain=True)
    texts = {d: packing.words_of(t) for d, t in docs.items()}
    ids.add(set().union(*texts.values()))
    own = {d: np.append(np.frombuffer(ids.of(t), "<u4").astype(np.int64), 49407) for d, t in texts.items()}
    train = [own[r["doc_id"]] for r in rows if not r["held_out"]]
    plain = lm_scoring.SubwordModel(np.bincount(np.concatenate(train), minlength=49408))
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > plain.score([own[r["doc_id"]] for r in held]).sum() * 0.97


def test_op4_odd_rows(odd, empty):
    rows = lm_scoring.score_documents(odd, F.lit(None).cast("boolean"), WORDS).collect()
    assert len(rows) == len(ODD) and {r["n_tokens"] for r in rows if r["doc_id"] in (3, 4, 5)} == {1} and all(math.isfinite(r["score"]) for r in rows)
    assert lm_scoring.score_documents(empty, F.lit(False), WORDS).count() == 0
    assert [r["n_known"] for r in lm_scoring.score_documents(odd, F.lit(True), WORDS).collect()] == [0] * len(ODD)


def test_op4_long_words_are_looked_up_by_digest(spark):
    long = "x" * 500
    df = spark.createDataFrame([(i, f"{long} common w{i}") for i in range(20)], "doc_id long, text string")
    for most in (1, 1 << 18):
        rows = lm_scoring.score_documents(df, F.col("doc_id") == 0, WORDS, most_words=most).collect()
        assert {r["doc_id"]: r["n_known"] for r in rows} == {i: 4 - (i == 0) for i in range(20)}
        assert len({round(r["base_score"], 6) for r in rows if r["doc_id"]}) == 1


def test_op5_typed_parts_round_trip(spark):
    nasty = ["\\", "<", "\\l", "\\b", "<|turn|>user<|text|>", "\\\\l<", "", "a\\bl<"]
    turns = [(1, i, "assistant" if i % 2 else "us<er", t) for i, t in enumerate(nasty)] + [(None, None, None, None), (2, 1, "user", "same"), (2, 1, "user", "same")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    chats = chat_format.format_chats(df.withColumn("parts", chat_format.text_parts(F.col("text"))))
    out = {r["conv_id"]: r for r in chats.select("conv_id", "formatted", "loss_spans", chat_format.parse(F.col("formatted")).alias("turns"), chat_format.under_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert [(t["role"], t["text"]) for t in out[1]["turns"]] == [(r, t) for _, _, r, t in turns[: len(nasty)]]
    assert out[1]["loss"] == "".join(t for i, t in enumerate(nasty) if i % 2)
    assert [(t["role"], t["text"]) for t in out[None]["turns"]] == [("", "")] and len(out[2]["turns"]) == 2
    parts = spark.sql(
        f"""SELECT 1L AS conv_id, 1L AS turn, 'assistant' AS role, from_json('[{{"type":"text","text":"see "}},{{"type":"image","ref":"a.png","width":100,"height":56}},null,{{"type":"audio","ref":"b.wav","seconds":1.5}},
        {{"type":"document","ref":"c.pdf","pages":3}},{{"type":"odd","ref":"d"}},{{"type":"text"}}]', 'array<{chat_format.PART}>') AS parts"""
    )
    row = chat_format.format_chats(parts).first()
    assert row["formatted"] == "<|turn|>assistant<|text|>see <|image 1|><|audio 2|><|document 3|><|odd 4|><|end|>"
    assert [(a["number"], a["type"], a["ref"], a["tokens"]) for a in row["attachments"]] == [(1, "image", "a.png", 8), (2, "audio", "b.wav", 38), (3, "document", "c.pdf", 768), (4, "odd", "d", 1)]
    assert row["expanded_tokens"] == 815
    assert chat_format.format_chats(parts.limit(0)).count() == 0


def test_op6_odd_rows_and_one_of_each(odd, empty):
    rows = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_duplicates(odd).collect()), key=str)
    assert rows == sorted([(1, 2, 3, False), (1, 2, 3, False), (2, 2, 3, True), (3, 4, 2, False), (4, 4, 2, True), (None, None, 1, True), (5, 5, 1, True), (6, 6, 1, True), (7, 7, 1, True), (8, 8, 1, True)], key=str)
    assert exact_dedup.exact_duplicates(empty).count() == 0
    left = exact_dedup.keep_one(odd.filter("doc_id = 1 or doc_id = 3")).collect()
    assert sorted(r["doc_id"] for r in left) == [1, 3] and exact_dedup.keep_one(odd).columns == odd.columns


def test_op6_cuts_follow_content_and_clashes_are_told_apart(spark):
    rng = np.random.default_rng(1)
    data = rng.integers(97, 123, 200_000, dtype=np.uint8).tobytes()
    ends = exact_dedup.cut_points(data, 1024, 256, 8192)
    assert ends[-1] == len(data) and all(b - a <= 8192 for a, b in zip([0, *ends], ends, strict=False))
    moved = exact_dedup.cut_points(b"some bytes before" + data, 1024, 256, 8192)
    assert len({e + 17 for e in ends} & set(moved)) > 0.9 * len(ends)
    # rows 1 and 2 have one identifier for two contents
    clash = [(1, b"i" * 16, "s1", [b"aa"]), (2, b"i" * 16, "s2", [b"bb"]), (3, b"i" * 16, "s1", [b"aa"]), (4, b"j" * 16, "s4", [b"c"]), (5, b"j" * 16, "s4", [b"c"])]
    df = spark.createDataFrame(clash, "id long, recipe binary, text_sha256 string, parts array<binary>")
    assert [bytes(r["chunk"]) for r in exact_dedup.colliding_identifiers(df).collect()] == [b"i" * 16]
    assert {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.grouped(df).collect()} == {1: (3, 2), 2: (2, 1), 3: (3, 2), 4: (5, 2), 5: (5, 2)}


@pytest.mark.parametrize("text", ["", "x", "one two three", LONG])
def test_op7_repeated_words(spark, text):
    words = text.split()
    at = collections.defaultdict(list)
    for i in range(len(words) - 7):
        at[tuple(words[i : i + 8])].append(i)
    want = len({i + k for where in at.values() if len(where) > 1 for i in where for k in range(8)})
    row = quality_rules.quality(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row["n_words"], row["n_repeat_words"]) == (len(words), want)


def test_op7_rules_and_odd_rows(spark, odd, empty):
    prose = "This is a plain sentence with quite a few words in it, about nothing at all.\n" * 1 + "Another line follows here, and it also says something new to the reader.\nThe third one ends it."
    cases = {1: (prose, True), 2: ("| ".join(prose.split()), False), 3: (prose.upper(), False), 4: (" ".join(w + "%%%" for w in prose.split()), False), 5: (prose + "\nAll rights reserved. Click here", True), 6: ("!! ".join(prose.split()), False)}
    rows = {r["doc_id"]: r for r in quality_rules.quality(spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "doc_id long, text string")).collect()}
    assert {k: rows[k]["kept"] for k in cases} == {k: v[1] for k, v in cases.items()}
    assert rows[5]["clean_text"] == prose and rows[5]["n_lines_removed"] == 1
    assert quality_rules.quality(odd).count() == len(ODD) and quality_rules.quality(empty).count() == 0
    assert quality_rules.accepted(odd).columns == odd.columns


def test_op8_held_out_accuracy_and_odd_rows(spark, odd, empty):
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in table(spark, sf, "documents").collect()}
    rows = [r for r in queries.op8_lang_id(spark, sf).collect() if r["held_out"]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in rows]) >= 0.98 and all(0 <= r["score"] <= 1 for r in rows)
    learned = lang_id.train(odd)
    got = {(r["doc_id"], r["lang_pred"]) for r in lang_id.identify(odd, learned).collect()}
    assert {(3, "und"), (4, "und"), (5, "und"), (8, "und"), (6, "en")} <= got
    none = lang_id.train(empty)
    assert none.count() == 0 and lang_id.identify(odd, none).filter("lang_pred <> 'und'").count() == 0
    assert sorted(str(r["doc_id"]) for r in lang_id.accepted(odd, learned, 0.0).collect()) == ["1", "1", "2", "6", "7", "None"]


def _by_hand(text, space, n=3):
    """Sum of the products of rotated letter vectors, gram by gram."""
    import regex

    chars = regex.sub(r"\P{L}+", " ", f" {text.lower()} ")
    letters = {c: space.letter(ord(c)).astype(np.int64) for c in set(chars)}
    total = np.zeros(space.dims, np.int64)
    for gram, k in collections.Counter(chars[i : i + n] for i in range(len(chars) - n + 1)).items():
        total += k * np.prod([np.roll(letters[c], place) for place, c in enumerate(gram)], axis=0)
    return total


def test_op8_binding_by_hand():
    space = lang_id.Profiles(64, 2)
    for text in ("ab", "Ab, c!", "é日 ab"):
        assert np.array_equal(space.bundles([lang_id.grams(text, 2)])[0], _by_hand(text, space, 2))


def test_op8_equals_brute_force(spark, sf_dir):
    """The query's rows against prototypes and cosines made gram by gram."""
    space = lang_id.Profiles(1024, 3)
    docs = {r["doc_id"]: r for r in table(spark, sf_dir, "documents").collect()}
    bundle = {d: _by_hand(r["text"] or "", space) for d, r in docs.items()}
    learned = {}
    for d, r in docs.items():
        if zlib.crc32(str(d).encode()) % 5 and r["text"] is not None and r["lang"] is not None and any(c.isalpha() for c in r["text"]):
            learned[r["lang"]] = learned.get(r["lang"], 0) + bundle[d]
    names = sorted(learned)
    for r in queries.op8_lang_id(spark, sf_dir).collect():
        if not any(c.isalpha() for c in docs[r["doc_id"]]["text"] or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        v = bundle[r["doc_id"]]
        cosines = [v @ learned[x] / np.linalg.norm(v) / np.linalg.norm(learned[x]) for x in names]
        assert r["lang_pred"] == names[int(np.argmax(cosines))] and r["score"] == pytest.approx(max(0.0, max(cosines)), abs=1e-9)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_op8_equal_cosines_and_many_languages(spark):
    same = spark.createDataFrame([(1, "guten tag", "zz"), (2, "guten tag", "aa"), (3, "buenos dias", "mm"), (4, "123", "nn")], "doc_id long, text string, lang string")
    learned = lang_id.train(same)
    whole = {(r["doc_id"], r["lang_pred"], round(r["score"], 9)) for r in lang_id.identify(same, learned).collect()}
    assert {(1, "aa"), (2, "aa"), (3, "mm"), (4, "und")} == {x[:2] for x in whole}
    assert [s.names for s in lang_id.scorers(learned, block=2)] == [["aa", "mm"], ["zz"]]  # of a language without a letter nothing is learned
    many = spark.createDataFrame([(i, f"w{chr(97 + i % 26)}{chr(97 + i // 26)} {chr(97 + i % 7) * 3}", f"l{i:04d}") for i in range(1100)], "doc_id long, text string, lang string")
    for r in lang_id.identify(many, lang_id.train(many)).collect():
        assert r["score"] == pytest.approx(1.0) and r["lang_pred"] <= f"l{r['doc_id']:04d}"


def test_op9_equals_tiktoken(spark, odd, empty, sf_dir):
    import tiktoken

    ranks = byte_bpe.read_ranks(BYTES)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = _documents(spark, sf_dir)
    for r in queries.op9_byte_bpe(spark, sf_dir).collect():
        ids = own.encode_ordinary(docs[r["doc_id"]] or "")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256((docs[r["doc_id"]] or "").encode()).hexdigest()
    encoder = byte_bpe.Encoder(BYTES, public_tokenizers.PATTERN, most=50)
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("abcdeé12 \n$日"), rng.integers(0, 300))) for _ in range(300)] + ["a" * 700, "ab" * 350, "<|endoftext|>", "\x00"]
    assert [x.tolist() for x in encoder.encode_batch(texts)] == [own.encode_ordinary(t) for t in texts]
    for word in [b"a" * 50, b"abcabcabc" * 9, bytes(rng.integers(97, 101, 200, dtype=np.uint8))]:
        assert byte_bpe.merge(word, ranks) == own.encode_ordinary(word.decode())
    back = byte_bpe.decode(byte_bpe.encode(odd, BYTES, public_tokenizers.PATTERN), BYTES).collect()
    assert sorted((bytes(r["bytes"]) for r in back)) == sorted((t or "").encode() for _, t, *_ in ODD)
    assert byte_bpe.encode(empty, BYTES, public_tokenizers.PATTERN).count() == 0


def _check_packing(rows, docs, capacity):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    total = 0
    for d, text in docs.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        total += len(ids)
        want = [(k, a, len(ids[a : a + capacity]), zlib.crc32(ids[a : a + capacity].tobytes())) for k, a in enumerate(range(0, len(ids), capacity))]
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in by_doc[d]) == want
    for own in by_sequence.values():
        end = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == end
            end += r["length"]
        assert end <= capacity
    return len(by_sequence), total


def test_op10_pieces_places_and_fill(spark, sf_dir, odd, empty):
    used, total = _check_packing(queries.op10_packing(spark, sf_dir).collect(), _documents(spark, sf_dir), 4096)
    assert used <= -(-total // 4096) * 1.05 + 1
    extra = odd.limit(2).select((F.monotonically_increasing_id() + 50).alias("doc_id"), F.lit("a<|endoftext|>b <|STARTOFTEXT|> x<|endoftext").alias("text"), "lang", "id", "n")
    unique = odd.filter("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(extra)
    _check_packing(packing.pack(unique, WORDS, capacity=64).collect(), {r["doc_id"]: r["text"] for r in unique.collect()}, 64)
    assert packing.pack(odd, WORDS).count() >= len(ODD) and packing.pack(empty, WORDS).count() == 0


def test_op10_plan_is_close_to_the_bound():
    rng = np.random.default_rng(5)
    for low, high in ((1, 4096), (1300, 2100), (1, 700), (2049, 4096)):
        sizes = collections.Counter(rng.integers(low, high + 1, 5000).tolist())
        groups = packing.plan(dict(sizes), 4096)
        back = collections.Counter()
        for count, pattern in groups:
            assert sum(x * k for x, k in pattern) <= 4096
            for x, k in pattern:
                back[x] += k * count
        assert back == sizes
        bound = max(-(-sum(x * n for x, n in sizes.items()) // 4096), sum(n for x, n in sizes.items() if x > 2048), sum(n for x, n in sizes.items() if x > 1365) / 2)
        assert sum(c for c, _ in groups) <= bound * 1.12 + 1


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline

    docs = table(spark, sf_dir, "documents")
    columns, texts = docs.columns, _documents(spark, sf_dir)
    seen = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        seen.append({r["doc_id"]: r["text"] for r in docs.collect()})
    exact = {}
    for d, t in seen[1].items():
        exact[t] = max(d, exact.get(t, -1))
    assert set(seen[2]) == set(exact.values())
    want = brute_components(seen[2], 5, 80)
    assert set(seen[3]) == {d for d, (_, c) in want.items() if c == d}
    assert all(texts[d] == t for d, t in seen[3].items())
    _check_packing(corpus_pipeline.run(spark, sf_dir).collect(), seen[3], 4096)
