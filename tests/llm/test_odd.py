"""Odd rows, clashing names, bounds and helpers of the training-data operators and the pipeline."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelyard.llm import _common, chat_format, exact_dedup, lang_id, minhash_dedup, packing, quality_rules, queries, url_gbt

PROSE = {
    "en": "The river runs slowly past the old mill, and in the evening the workers walk home along its bank. Nobody hurries there, because the night is long and warm.",
    "de": "Der Fluss zieht langsam an der alten Mühle vorbei, und am Abend gehen die Arbeiter an seinem Ufer nach Hause. Niemand eilt dort, denn die Nacht ist lang und warm.",
}


def test_slices_are_bounded_by_rows_and_bytes():
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["a" * 10, None, "b" * 100, "", "c" * 5, "d" * 5])], names=["i", "t"])
    parts = list(_common.slices(batch, 1, 3, 20))
    assert [p.num_rows for p in parts] == [2, 1, 3] and [x for p in parts for x in p.column(0).to_pylist()] == list(range(6))
    assert list(_common.slices(batch.slice(0, 0), 1, 3)) == []


def test_free_name_and_small(spark):
    df = spark.createDataFrame([(1, "x")], "dropped_id long, _Dropped_Id string")
    assert _common.free_name(df, "dropped_id") == "__dropped_id"
    plan = lambda d: d._jdf.queryExecution().toString()
    assert "ResolvedHint" in plan(_common.small(df)) or "broadcast" in plan(_common.small(df)).lower()
    wide = spark.range(2000).select(F.repeat(F.lit("x"), 40_000).alias("t"))
    assert "broadcast" not in plan(_common.small(wide)).lower()


def test_shared_folder_is_named_on_a_cluster():
    class Conf:
        def get(self, _):
            return None

    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)  # noqa: N815
        getConf = staticmethod(Conf)  # noqa: N815

    class Session:
        sparkContext = Context()  # noqa: N815

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        _common.shared_folder(Session())


def test_op1_repeated_rows_ties_long_urls_and_clashing_columns(spark):
    rules = [("block", "a.com/x"), ("allow", "a.com/y"), ("allow", "b.a.com/x"), ("block", "com/q/"), ("allow", "com/q/")]
    urls = ["http://a.com/xy", "http://a.com/xy", "http://B.a.com/x", "http://c.com/q/1", "http://a.com/z?" + "p=1&" * 50_000, "http://" + "y" * 100_000 + ".net/" + "d/" * 5_000, None]
    df = spark.createDataFrame([(i, u, "h", "t", "l", "m") for i, u in enumerate(urls)], "page_id long, url string, host string, top string, label string, m string")
    rows = sorted(url_gbt.judge(df, rules).collect(), key=lambda r: r["page_id"])
    assert [(r["rule"], r["verdict"]) for r in rows[:4]] == [("a.com/x", "block")] * 2 + [("b.a.com/x", "allow"), ("com/q/", "block")]  # of equal rules the first
    assert [len(r["host"]) for r in rows] == [5, 5, 7, 5, 5, 100_004, 0] and rows[4]["path"] == "/z" and {r["verdict"] for r in rows} <= {"allow", "block"}


def test_op1_sample_is_exactly_bounded_though_one_url_has_half_of_the_rows(spark):
    rows = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, "http://hot.com/a").otherwise(F.concat(F.lit("http://s"), "id", F.lit(".net/b"))).alias("url"), (F.col("id") % 2).cast("double").alias("label"))
    known = url_gbt.features(rows)
    some = url_gbt.bounded_sample(known, 1000).collect()
    hot = sum(r["host"] == "hot.com" for r in some)
    assert len(some) == 1000 and 350 < hot < 650
    assert url_gbt.bounded_sample(known.limit(30), 1000).count() == 30


def test_op1_suffix_rates_do_not_see_their_own_row(spark):
    """Each domain has one row and labels are random: a rate that saw its own label would tell it, out-of-fold rates cannot."""
    rng = np.random.default_rng(0)
    label = rng.integers(0, 2, 600).tolist()
    rows = spark.createDataFrame([(f"http://d{i:03d}.com/", float(y)) for i, y in enumerate(label)], "url string, label double")
    model = url_gbt.train(url_gbt.features(rows.filter("url < 'http://d500'")))
    out = model.block_score(url_gbt.features(rows)).collect()
    assert np.std([r["block_score"] for r in out if r["url"] >= "http://d500"]) < 0.5 and len(out) == 600
    assert all(s.count() <= 500 for s in model.suffixes.values())


def test_op5_long_conversation_and_clashing_columns(spark):
    turns = spark.range(3000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.repeat(F.lit("long <| \\ text "), 20).alias("text"), F.lit("x").alias("formatted"), F.lit("y").alias("conv"), F.lit(0).alias("n"))
    chats = chat_format.format_chats(turns.withColumn("parts", chat_format.text_parts(F.col("text"))))
    row = chats.select(chat_format.parse(F.col("formatted")).alias("t"), chat_format.under_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
    want = "long <| \\ text " * 20
    assert [t["text"] for t in row["t"]] == [want] * 3000 and row["loss"] == want * 1500


def test_op2_prefix_join_shares_hot_shingles(spark, monkeypatch):
    """With shares of three sets the links are those without shares."""
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(60)]
    docs = []
    for i in range(40):
        w = list(base)
        for k in rng.integers(0, 60, 6):
            w[k] = f"e{i % 7}x{k}"
        docs.append((i, " ".join(w)))
    df = spark.createDataFrame(docs, "id long, t string")
    nodes, sets = df.select("id", F.col("id").alias("label")), minhash_dedup._sets(df, 3)
    whole = {(r.a, r.b) for r in minhash_dedup._pairs_by_prefix(nodes, sets, 60).collect()}
    monkeypatch.setattr(minhash_dedup, "_HOLDERS", 3)
    assert {(r.a, r.b) for r in minhash_dedup._pairs_by_prefix(nodes, sets, 60).collect()} == whole and whole


def test_keep_one_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "same text of six words here", "a"), (2, "same text of six words here", "b"), (None, None, "c"), (None, None, "d")], "doc_id long, text string, dropped_id string")
    docs = docs.withColumns({c: F.lit(1) for c in ("judged_id", "judged_digest", "judged_rows", "__id", "__sha", "accepted")})
    assert [r["doc_id"] for r in minhash_dedup.keep_one(docs).collect() if r["doc_id"]] == [1]
    left = exact_dedup.keep_one(docs)
    assert left.columns == docs.columns and sorted(str(r["doc_id"]) for r in left.collect()) == ["2", "None"]
    assert lang_id.accepted(docs.withColumn("lang", F.lit("en")), lang_id.train(docs.withColumn("lang", F.lit("en"))), 0.0).count() == 2


def test_op7_structural_navigation(spark):
    prose = PROSE["en"]
    text = prose + "\nHome\nNews\nAbout us\nsee www.a.com and http://b.org/x\nHome | About | Contact\nAnother whole sentence that says something stays here."
    row = quality_rules.quality(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["kept"] and row["clean_text"] == prose + "\nAnother whole sentence that says something stays here."


def test_pipeline_on_odd_repeated_and_empty_rows(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars int"
    good = [(10, PROSE["en"], "en", "s", 1), (10, PROSE["en"], "en", "s", 1), (11, PROSE["de"], "de", "s", 2), (12, PROSE["en"], "en", None, None)]
    rows = [*good, (1, None, None, None, None), (2, "", "en", "s", 0), (3, "123 !!", "en", "s", 6), (4, "word " * 50_000, "en", "s", 7), (None, PROSE["de"] + " " + PROSE["en"], "de", "s", 8)]
    for name, some in (("odd", rows), ("empty", [])):
        spark.createDataFrame(some, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert {r["doc_id"] for r in out} == ({11, 12, None} if some else set())
        if some:
            assert len(out) == 3 and sum(r["length"] for r in out) > 100


def test_queries_of_the_subpackage_are_the_ten():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{k}" for k in range(1, 11)] and packing.slots([]) == {}


def test_op3_has_no_bound_on_attributes_and_open_elements():
    from panelyard.llm import html_extract

    for n in (100, 70_000, 300_000):
        page = f'<article><p title="{"x" * n}>LEAK">ok text here</p><p class=\'{"y" * n}">\' data-a="b>c">and more</p></article>'
        assert html_extract.main_text(page) == "ok text here\nand more"
    for n in (10, 70, 1000):
        assert html_extract.main_text(f'<article><p>a <span class="ad">hidden {"<i>" * n}x</span> b</p></article>') == "a b"
        assert html_extract.main_text(f'<article><p>a <b>{"<i>" * n}x</b><span class="ad">y</span> b</p></article>') == "a x b"
    for bad in ("<a 'x ", '<a "x', "<a ><b '", "<a x", '<a "' + "'", "<i>", "<div title='" + "z" * 300):
        began = time.perf_counter()
        html_extract.main_text("<p>text " + bad * 60_000 + "'>\"> end")
        assert time.perf_counter() - began < 20, bad


def test_op3_tag_ends_equal_a_plain_scan():
    from panelyard.llm import html_extract

    rng = random.Random(2)
    for _ in range(400):
        page = "".join(rng.choices("\"'>ab ", k=rng.randint(0, 40)))
        ends = html_extract._TagEnds(page)
        for at in rng.sample(range(len(page) + 1), len(page) + 1):
            quote, want = "", -1
            for i in range(at, len(page)):
                c = page[i]
                if quote:
                    quote = "" if c == quote else quote
                elif c == ">":
                    want = i
                    break
                elif c in "\"'":
                    quote = c
            assert ends.find(at) == want, (page, at)


def test_op4_attention_takes_any_scores():
    from panelyard.llm import lm_scoring

    rng = np.random.default_rng(0)
    n, half = 7, lm_scoring.HALF
    back = np.arange(half)[:, None] + half - np.arange(2 * half)[None, :]
    inputs = rng.integers(0, n, (3, 2 * half))
    for scale in (1.0, 200.0, -200.0):
        tables = {"E": rng.standard_normal((n, 4)), "q": np.full((n, 4), scale / 2), "k": rng.uniform(0.2, 1, (n, 4)), "v": rng.standard_normal((n, 4)), "bias": np.where(back >= 0, 0.0, -1e9)}
        y, a = lm_scoring.Attention.contexts(tables, inputs)
        assert np.isfinite(y).all() and np.allclose(a.sum(axis=2), 1)
        for w in range(3):
            for i in range(0, half, 11):
                raw = [float(tables["q"][inputs[w, half + i]] @ tables["k"][inputs[w, j]]) for j in range(half + i + 1)]
                weights = np.exp(np.array(raw) - max(raw))
                weights /= weights.sum()
                want = sum(x * tables["v"][inputs[w, j]] for j, x in enumerate(weights)) + tables["E"][inputs[w, half + i]]
                assert np.allclose(y[w, i], want)


def test_op5_rows_without_a_conversation_stay_alone(spark):
    from panelyard.llm import chat_format

    turns = spark.createDataFrame([(None, 1, "user", "hi"), (None, 1, "user", "hi"), (None, 2, "assistant", "yes"), (3, 1, "assistant", "a")], "conv_id long, turn long, role string, text string")
    chats = chat_format.format_chats(turns.withColumn("parts", chat_format.text_parts(F.col("text"))))
    got = sorted((r["conv_id"] or 0, r["formatted"], [tuple(s) for s in r["loss_spans"]]) for r in chats.collect())
    one = lambda role, text: f"<|turn|>{role}<|text|>{text}<|end|>"
    start = len("<|turn|>assistant<|text|>")
    assert got == [(0, one("assistant", "yes"), [(start, start + 3)]), (0, one("user", "hi"), []), (0, one("user", "hi"), []), (3, one("assistant", "a"), [(start, start + 1)])]
    assert chat_format.format_chats(turns.limit(0).withColumn("parts", chat_format.text_parts(F.col("text")))).count() == 0


def test_op1_block_score_follows_from_the_trees(spark):
    labelled = spark.createDataFrame([(f"http://{'x' * (i % 9)}{i}.{'bad' if i % 3 else 'fine'}.{'biz' if i % 2 else 'org'}/a{'/b' * (i % 4)}?p={i}", float((i * i) % 7 > 2)) for i in range(400)], "url string, label double")
    known = url_gbt.features(labelled)
    model = url_gbt.train(known)

    def leaf(node, row):
        if node.getClass().getSimpleName() == "LeafNode":
            return node.prediction()
        split = node.split()
        return leaf(node.leftChild() if row[split.featureIndex()] <= split.threshold() else node.rightChild(), row)

    roots = [t._call_java("rootNode") for t in model.trees.trees]
    scored = model.block_score(model.with_suffixes(known).select("url", "host", "path", "top", "domain", *url_gbt.LEXICAL, *[F.col(c).alias(f"own_{c}") for c in url_gbt.SUFFIX]))
    rows = scored.limit(60).collect()
    assert len({round(r["block_score"], 6) for r in rows}) > 5
    for r in rows:
        values = [r[c] for c in url_gbt.LEXICAL] + [r[f"own_{c}"] for c in url_gbt.SUFFIX]
        margin = sum(w * leaf(root, values) for root, w in zip(roots, model.trees.treeWeights, strict=True))
        assert r["block_score"] == pytest.approx(1 / (1 + np.exp(-2 * margin)), abs=1e-9)


@pytest.mark.parametrize(("words", "percent", "more"), [(3, 85, {"side": 10, "width": 3}), (5, 80, {})])
def test_op2_recall_on_a_thousand_documents(spark, words, percent, more):
    """At the thresholds of the query and of the pipeline every link that brute force finds is found."""
    from test_llm import brute_components

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(docs, words=words, percent=percent, **more).collect()}
    want = {d: c for d, (_, c) in brute_components({r["doc_id"]: r["text"] for r in docs.collect()}, words, percent).items()}
    linked = [d for d, c in want.items() if c != d]
    assert linked and got == want


def test_op4_score_equals_a_dense_loop():
    """The text's probability, id by id: softmax over the keys a window shows, then each decision on the id's path; ids sum to 1."""
    from panelyard.llm import lm_scoring

    half, rng, n = lm_scoring.HALF, np.random.default_rng(9), 90
    model = lm_scoring.SubwordModel(rng.integers(0, 50, n), dims=5)
    net = model.net
    net.p = {k: (v + 0.2 * rng.standard_normal(v.shape)).astype(np.float32) for k, v in net.p.items()}
    p = {k: v.astype(np.float64) for k, v in net.p.items()}

    def paths(i):
        """(node, side) of an id: those at the top, and those below."""
        nodes, sides, _ = net.tree.paths(np.array([i]))
        top = [(int(node), float(s)) for node, s in zip(net.tree.top, net.tree.top_sides[i]) if s]
        return top + [(int(a), float(b)) for a, b in zip(nodes, sides)]

    def chance(context, i):
        return np.prod([1 / (1 + np.exp(-side * (context @ p["N"][node, :-1] + p["N"][node, -1]))) for node, side in paths(i)])

    for length in (1, 5, half, 2 * half + 7):
        ids = rng.integers(0, n, length)
        inputs = [model.start] * (half + 1) + ids[:-1].tolist()  # the start of a text fills the first half of its first window
        total = 0.0
        for i, target in enumerate(ids):
            here = half + i
            keys = range(i // half * half, here + 1)
            q = p["E"][inputs[here]] @ p["Q"] / np.sqrt(net.dims)
            scores = np.array([q @ (p["E"][inputs[j]] @ p["K"]) + p["R"][here - j] for j in keys])
            weights = np.exp(scores - scores.max())
            weights /= weights.sum()
            context = sum(w * (p["E"][inputs[j]] @ p["V"]) for w, j in zip(weights, keys)) + p["E"][inputs[here]]
            total += np.log10(chance(context, target))
            if i == length - 1:
                assert sum(chance(context, k) for k in range(n)) == pytest.approx(1)
        assert model.score([ids])[0] == pytest.approx(total, rel=1e-4)


def test_op4_takes_only_decisions_on_the_path():
    """What is computed for an id are the decisions on its path, not all of the top nodes."""
    from panelyard.llm import lm_scoring

    rng = np.random.default_rng(4)
    counts = (1e6 / np.arange(1, 3001)).astype(np.int64)
    net = lm_scoring.SubwordModel(counts).net
    ids = rng.choice(3000, 500, p=counts / counts.sum())
    d = net.decisions(rng.standard_normal((500, net.dims)).astype(np.float32), ids)
    high = (net.tree.top_sides[ids] != 0).sum(axis=1)
    assert d.top.shape == (500, high.max()) and high.max() < 10 and len(d.below) == net.tree.lengths[ids].sum()
    assert np.array_equal(np.sort((d.top_sides != 0).sum(axis=1)), np.sort(high))


def test_op4_lexicon_equals_the_tokenizer():
    """Ids and counts by number are those of the words, those of words without a count until the next call."""
    from test_llm import WORDS

    from panelyard.llm import lm_scoring, packing

    texts = [packing.words_of(t) for t in ("The cat, the CAT; sat!", "", "\u0301 caf\u00e9 " + "x" * 90, "the cat sat on 3.14 mats " * 3, "\u0000 \ufeff")]
    logs = {b"the": 1.5, lm_scoring._key(b"x" * 90): 0.5}
    ids = packing.WordIds(WORDS, plain=True)
    lexicon = lm_scoring.Lexicon(ids, logs)
    for words in texts * 2:
        numbers = lexicon.numbers(words)
        found, ends = lexicon.subwords(numbers)
        ids.add(set(words))
        assert found.tolist() == np.frombuffer(ids.of(words), "<u4").tolist() and len(ends) == len(words) + 1
        assert lexicon.log_counts(numbers).tolist() == [logs.get(lm_scoring._key(w), -1.0) for w in words]
        assert len(lexicon.index) <= len(logs) + len(set(words))


def test_op7_boilerplate_of_other_languages(spark):
    prose = PROSE["de"]
    notice = "Alle Rechte vorbehalten. Bitte lesen Sie die Nutzungsbedingungen."
    docs = spark.createDataFrame([(1, f"{prose}\n{notice}"), (2, prose)], "doc_id long, text string")
    german = [*quality_rules.BOILERPLATE, *quality_rules.MORE_BOILERPLATE["de"]]
    removed = lambda **more: {r["doc_id"]: r["n_lines_removed"] for r in quality_rules.quality(docs, **more).collect()}
    assert removed() == {1: 0, 2: 0} and removed(boilerplate=german) == {1: 1, 2: 0} and removed(boilerplate=()) == {1: 0, 2: 0}


def _edited(rng, base, edits, mark):
    words = list(base)
    for k in rng.choice(len(base), edits, replace=False):
        words[k] = f"{mark}x{k}"
    return " ".join(words)


def test_op2_compares_a_crowd_of_near_copies_by_way_of_its_center(spark, monkeypatch):
    """Copies with few edits are linked, some with many reach none of them: the pairs compared do not grow with the square."""
    from test_llm import brute_components

    monkeypatch.setattr(minhash_dedup, "_CROWD", 20, raising=False)
    compared, plain = [], minhash_dedup._confirmed
    monkeypatch.setattr(minhash_dedup, "_confirmed", lambda pairs, *more: compared.append(pairs.count()) or plain(pairs, *more))
    rng, base = np.random.default_rng(5), [f"w{i}" for i in range(150)]
    docs = {i: _edited(rng, base, i % 3 + 1 if i < 160 else 4 + i % 2, f"e{i}" if i % 4 else f"e{i % 7}") for i in range(220)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash_dedup.near_duplicates(df, words=5, percent=80).collect()}
    assert got == brute_components(docs, 5, 80)
    assert len({c for _, c in got.values()}) > 5 and sum(compared) < 10 * len(docs)


@pytest.mark.parametrize(("seed", "percent", "crowd"), [(1, 60, 2), (2, 80, 3), (3, 85, 8)])
def test_op2_crowds_lose_no_link(spark, monkeypatch, seed, percent, crowd):
    """Without stars before, families that overlap and share edits: components are those of brute force."""
    from test_llm import brute_components

    monkeypatch.setattr(minhash_dedup, "_CROWD", crowd)
    rng = np.random.default_rng(seed)
    bases = [[f"w{(i * k) % 97}" for i in range(50)] for k in (1, 1, 3)]
    bases[1] = bases[1][:30] + [f"v{i}" for i in range(30)]
    docs = {i: _edited(rng, bases[i % 3][: 50 - i % 11], int(rng.integers(0, 6)), f"e{rng.integers(0, 9)}") for i in range(90)}
    df = spark.createDataFrame(list(docs.items()), "id long, t string").dropDuplicates(["t"])
    docs = {r["id"]: r["t"] for r in df.collect()}
    df = spark.createDataFrame(list(docs.items()), "id long, t string")
    labels = df.select(F.col("id").alias("rep"), F.col("id").alias("label"))
    got = minhash_dedup._settled(labels, labels.withColumnRenamed("rep", "id"), minhash_dedup._sets(df, 3), percent)
    want = {d: c for d, (_, c) in brute_components(docs, 3, percent).items()}
    assert {r["rep"]: r["label"] for r in got.collect()} == want and 1 < len(set(want.values())) < len(want)
