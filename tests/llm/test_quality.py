"""Main text, fertility, toxicity, mixing, nearest vectors and the pipeline."""

import html
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from paritas.llm import fertility, hilbert_search, mixing, toxicity
from paritas.llm.common import vocabulary_path
from paritas.llm.html_density import extract_main_text, main_text

from . import fixtures

PIECES = "piece_bpe_32k.model"
SF = "/root/testdata/sf0.001"


# -- main text -----------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body>
<header><h1>Site</h1><p>Our slogan is a rather long sentence that says nothing at all.</p></header>
<nav><ul><li><a href="/a">Home</a><li><a href="/b">News of the day</a></ul></nav>
<div id="cookie-notice">We use cookies to make your visit as pleasant as it can possibly be.</div>
<div class="content"><h2>Title &amp; more</h2><p>First  paragraph with a <a href=x>link</a> and caf&eacute;.
<p>Second <b>bold</b><br>line &lt;tag&gt;<ul><li>one<li>two</ul>
<div class="ad">Buy this now, it is cheap and it is good and it is yours.</div>
<script>if (a < b) document.write("</p>")</script><p hidden>not shown at all</p>
<table><tr><td>cell<td>next</table></div>
<aside><p>Related things that are long enough to look like an article of their own.</p></aside>
<section class="comments"><p>Great post, thank you so much for writing all of this down!</p></section>
<form><label>Name</label><input></form><footer>&copy; 2020</footer></body></html>"""


def test_article_of_a_page():
    assert main_text(PAGE) == "\n".join(
        ["Title & more", "First paragraph with a link and café.", "Second bold line <tag>", "one", "two", "cell", "next"])


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("   ", ""), ("plain words", "plain words"), ("<p>open <b>tags", "open tags"),
    ("<article><p>cut &amp", "cut &"), ("<article><p>cut off</p><p cla", "cut off"), ("<!-- open comment", ""),
    ("<article>a</article><footer>b</footer>", "a"), ("<div>" * 3000 + "deep", "deep"), ("a < b", "a < b"),
    ("<nav><a>x</a></nav>", ""), ("<p>x\n\n y\t z</p>", "x y z"), ("<script>never closed", ""),
])
def test_odd_pages(page, text):
    assert main_text(page) == text


LONG_TEXT = " ".join(f"Sentence number {i} of the article goes on for quite a few words." for i in range(18))


@pytest.mark.parametrize("wrapper", [
    "<div class='content-sidebar-wrap'>", "<div class='layout has-sidebar'>", "<form id=aspnetForm>", "<div id='search-result-page'>",
    "<div class='post share-enabled'>", "<div class='article ad-free'>", "<div class='no-sidebar'><form><div class='nav-open'>"])
def test_wrappers_with_hostile_names_keep_their_article(wrapper):
    around = ("<header>Site</header>{}<h2>Title</h2><p>" + LONG_TEXT + "</p><p>" + LONG_TEXT + "</p><div class='main-sidebar'>"
              "<p>Not a part of it, though it is a sentence.</p></div><form class=search-form>Search here<input></form>"
              "<section class='comments'><p>" + LONG_TEXT * 3 + "</p></section><span class='share-count'>17</span>")
    assert main_text(around.format(wrapper)) == f"Title\n{LONG_TEXT}\n{LONG_TEXT}"


def test_many_nested_and_neighbouring_marks_take_no_long():
    deep = "<div class='ad-free'>" * 20_000 + "<p>" + LONG_TEXT
    assert main_text(deep) == LONG_TEXT
    wide = f"<p>{LONG_TEXT}</p>" + "<span class='share-count'>17</span>" * 50_000
    assert main_text(wide) == LONG_TEXT


def test_marked_parts_beside_an_article_stay_out():
    for name in ("comment-list", "site-footer", "related-posts", "cookie-notice", "social-share", "sidebar"):
        page = f"<div><h1>Title</h1><p>{LONG_TEXT}</p></div><div class='{name}'><p>{LONG_TEXT} And more.</p></div>"
        assert main_text(page) == f"Title\n{LONG_TEXT}", name


def test_cutting_a_page_anywhere_never_fails():
    for n in range(0, len(PAGE), 7):
        main_text(PAGE[:n])


def test_pages_equal_their_articles(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    expected = {}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S)
        blocks = re.split(r"</?(?:h1|p)>", re.sub(r"<[^>]*$", "", inner[1] if inner else ""))
        blocks = [" ".join(html.unescape(re.sub(r"</?b>|<br>", lambda m: " " * (m[0] == "<br>"), b)).split()) for b in blocks]
        expected[r.page_id] = "\n".join(b for b in blocks if b)
    found = extract_main_text(pages).collect()
    assert {r.page_id: r.text for r in found} == expected
    assert all(r.n_chars == len(r.text) for r in found)


def test_pages_with_nulls_and_repeats(spark):
    rows = [(1, "u", "<p>a"), (1, "u", "<p>a"), (None, None, None), (2, None, "<p>" + "long " * 50_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("mine"))
    found = [(r.page_id, r.n_chars) for r in extract_main_text(pages).collect()]
    assert sorted(found, key=str) == sorted([(1, 1), (1, 1), (None, 0), (2, 249_999)], key=str)
    assert extract_main_text(pages.limit(0)).count() == 0


# -- fertility -----------------------------------------------------------------------------------------

def brute_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    inside = {j for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, twice = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            twice += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), twice, len(inside), failed)


@pytest.mark.parametrize("table", ["awkward", "documents"])
def test_base_rules(spark, table):
    docs = fixtures.awkward(spark) if table == "awkward" else spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = fertility.fertility_verdicts(docs, vocabulary_path(PIECES)).collect()
    assert len(found) == docs.count()
    for r in found:
        assert tuple(r)[1:7] == brute_base(texts[r.doc_id])
        assert not (r.kept and r.base_failed)


def test_verdicts_follow_the_bands(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = fertility.fertility_verdicts(docs, vocabulary_path(PIECES)).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    passed = found[~found.base_failed].copy()
    passed["size"] = np.floor(np.log2(passed.n_tokens)).clip(*fertility.LENGTHS)
    texts = docs.toPandas().set_index("doc_id").text
    passed["text"] = texts.loc[passed.doc_id].values
    passed["script"] = passed.text.map(fertility.script_of)
    once_all = {level: passed.drop_duplicates([*names, "text"]) for level, names in enumerate(
        (["lang", "size"], ["script", "size"], ["script"], []))}
    for (lang, script, size), group in passed.groupby(["lang", "script", "size"]):
        own = (once_all[0][(once_all[0].lang == lang) & (once_all[0]["size"] == size)],
               once_all[1][(once_all[1].script == script) & (once_all[1]["size"] == size)],
               once_all[2][once_all[2].script == script], once_all[3])
        level = next(i for i, texts in enumerate(own) if len(texts) >= fertility.LEAST_TEXTS or i == 3)
        assert set(group.band_level) == {level}
        once = own[level]
        inside = np.ones(len(group), dtype=bool)
        for name, digits, low, high in (("chars_per_token", 3, True, True), ("token_entropy", 3, True, False),
                                        ("fallback_share", 4, False, True)):
            a, b = np.quantile(once[name].round(digits), fertility.QUANTILES)
            least = fertility.LEAST_WIDTH[name] * (a if name == "chars_per_token" else 1)
            reach = fertility.REACH * max(b - a, least)
            inside &= (~(group[name] < a - reach - 1e-12) | (not low)) & (~(group[name] > b + reach + 1e-12) | (not high))
        assert (inside.values == group.kept.values).all()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    joined = passed.merge(labels, on="doc_id")
    assert joined[joined.quality == 1].kept.mean() > 0.98 and joined[joined.quality == 0].kept.mean() < 0.3


def test_junk_of_a_rare_language_has_no_bands_of_its_own(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    junk = " ".join(f"x{i * 7919 % 99991}q#{i * 104729 % 9973}zz{i}" for i in range(200))
    rows = [(-1, junk, "xx"), (-2, junk, "xx"), (-3, junk + " end", None)]
    rare = docs.where("lang = 'en'").orderBy("doc_id").limit(20).select(
        (-100 - F.col("doc_id")).alias("doc_id"), F.col("text"), F.lit("yy").alias("lang"))
    found = {r.doc_id: r for r in fertility.fertility_verdicts(
        docs.union(spark.createDataFrame(rows, docs.schema)).union(rare), vocabulary_path(PIECES)).collect()}
    assert all(not found[i].base_failed and not found[i].kept and found[i].band_level > 0 for i in (-1, -2, -3))
    # clean texts under a rare name of a language are judged like others of their script
    same = [(found[i], found[-100 - i]) for i in found if i >= 0 and -100 - i in found]
    assert len(same) == 20 and all(b.band_level is None or b.band_level > 0 for _, b in same)
    assert sum(b.kept for _, b in same) >= sum(a.kept for a, _ in same) - 1


def test_script_of_most_letters():
    cases = {"": "latin", "abc 1": "latin", "\u00e9t\u00e9": "latin", "\u043f\u0440\u0438\u0432\u0435\u0442 ok": "cyrillic",
             "\u4f60\u597d a": "han", "\u3053\u3093\u306b\u3061\u306f \u4e16\u754c": "kana", "\u2026 12": "none", "\ud800": "none"}
    assert {t: fertility.script_of(t) for t in cases} == cases


def test_fertility_of_nothing(spark):
    assert fertility.fertility_verdicts(fixtures.empty(spark), vocabulary_path(PIECES)).count() == 0


# -- toxicity ------------------------------------------------------------------------------------------

def brute_segments(scores):
    """Maximal segments by their definition: take the best segment, then go on left and right of it."""
    if not len(scores):
        return []
    best = max(((sum(scores[i:j]), i - j, -i) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)))
    if best[0] <= 0:
        return []
    n, i = -best[1], -best[2]
    # the shortest of equally good ones is maximal in the sense of the scan
    return brute_segments(scores[:i]) + [(i, i + n, best[0])] + [
        (i + n + b, i + n + e, s) for b, e, s in brute_segments(scores[i + n:])]


@pytest.mark.parametrize("seed", range(30))
def test_segments_equal_brute_force(seed):
    rng = np.random.default_rng(seed)
    scores = np.round(rng.normal(-0.3, 1, 40), 3) + rng.random(40) * 1e-6
    found = toxicity.maximal_segments(scores)
    expected = sorted(brute_segments(scores.tolist()))
    assert [f[:2] for f in found] == [e[:2] for e in expected]
    assert np.allclose([f[2] for f in found], [e[2] for e in expected])


def test_decay_rate_solves_its_equation():
    histogram = {-0.5: 900, 1.0: 60, 2.0: 5}
    rate = toxicity.decay_rate(histogram)
    scores, counts = np.array([*histogram, 1.0, 3.0]), np.array([900, 60, 5, 0.5, 0.5])
    assert (counts / counts.sum() * np.exp(rate * scores)).sum() == pytest.approx(1, abs=1e-6)


def planted_toxicity(spark, n=200):
    texts = [fixtures.prose(i, 60) + (" you vilething1 vilething2 awfulx vilething3." if i % 5 == 0 else "") for i in range(n)]
    docs = fixtures.documents(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(n)], "doc_id long, toxic int")
    return docs, labels


def test_planted_toxic_texts_are_found(spark):
    docs, labels = planted_toxicity(spark)
    found = toxicity.toxicity_scores(docs, labels).join(labels, "doc_id").collect()
    wrong = [r for r in found if r.held_out and r.predicted != r.toxic]
    assert len(found) == 200 and not wrong
    assert all(r.passages and all(0 <= p.begin < p.end <= r.n_words for p in r.passages) for r in found if r.toxic)
    changed = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in toxicity.toxicity_scores(docs, changed).collect()}
    assert again == {r.doc_id: r.score for r in found}, "labels of held-out rows must not matter"


def test_models_of_one_session_are_kept_apart(spark):
    docs, labels = planted_toxicity(spark, 60)
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").coalesce(1)
    for n in range(12):  # a worker that is used again must not keep the scores of a broadcast that is gone
        model = spark.sparkContext.broadcast((f"model-{n}", {"vilething1": (1.0 + n, 5.0)}))
        rows = toxicity.find_passages(texts, model, 1.0).where("doc_id = 5").collect()
        best = max(toxicity.maximal_segments(toxicity.Scorer(model.value[1]).scores(
            [texts.where("doc_id = 5").first().text])[0]), key=lambda s: s[2])[2]
        assert best == pytest.approx(1 + n - toxicity.DRIFT)
        assert rows[0].evidence == pytest.approx(best - np.log(rows[0].n_words))
    opposite = labels.withColumn("toxic", 1 - F.col("toxic"))
    first = toxicity.toxicity_scores(docs, labels).where("predicted = 1").count()
    toxicity.toxicity_scores(docs, opposite).collect()
    assert toxicity.toxicity_scores(docs, labels).where("predicted = 1").count() == first == 12


def test_training_rows_of_repeated_ids(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(40)] * 2 + [(3, "text 0"), (4, None), (5, "held")],
                                 "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 0), (4, -1), (9, 1)], "doc_id long, toxic int")
    labels = labels.where(~toxicity.held_out())
    rows = toxicity.training_rows(docs, labels).collect()
    known = {r.doc_id for r in labels.collect()}
    expected = {t for i, t in [(1, f"text {i}") for i in range(40)] + [(3, "text 0"), (4, "")] if i in known}
    assert sorted(r.text for r in rows) == sorted(expected)
    assert all(r.toxic == (1 if r.doc_id == 1 else 0) for r in rows)
    assert {r.doc_id for r in toxicity.training_rows(docs, labels, most=1).collect()} < known


def test_a_later_passage_of_the_same_words_is_found():
    scorer = toxicity.Scorer({"vile": (3.0, 9.0), "awful": (3.0, 9.0)})
    passage, filler = ["vile", "awful", "vile"], ["plain"] * (2 * toxicity.REPEAT_WORDS)
    scores, = scorer.scores([" ".join(passage + filler + passage)])
    assert [(b, e) for b, e, _ in toxicity.maximal_segments(scores)] == [(0, 2), (len(filler) + 3, len(filler) + 5)]


def test_toxicity_of_awkward_rows(spark):
    _, labels = planted_toxicity(spark)
    docs = fixtures.awkward(spark)
    odd = labels.union(spark.createDataFrame([(3, None), (None, 1), (5, 1), (5, 1)], "doc_id long, toxic int"))
    found = toxicity.toxicity_scores(docs, odd).collect()
    assert len(found) == docs.count() and all(0 <= r.score <= 1 for r in found)
    assert toxicity.toxicity_scores(docs, labels.limit(0)).where("predicted = 1").count() == 0
    assert toxicity.toxicity_scores(fixtures.empty(spark), labels).count() == 0


# -- mixing --------------------------------------------------------------------------------------------

def test_exponent_meets_its_limits():
    tokens = {"a": 1000.0, "b": 100.0, "c": 10.0, None: 40.0}
    few = mixing.solve(tokens, max_passes=3.0)
    assert max(p for _, _, p in few.sources.values()) == pytest.approx(3.0, abs=1e-6)
    flat = mixing.solve(tokens, target_entropy=0.8)
    shares = {s: w for s, (w, _, _) in flat.sources.items()}
    assert mixing.entropy(shares) == pytest.approx(0.8 * np.log(4), abs=1e-6)
    cover = mixing.solve(tokens, budget="cover", max_passes=2.0)
    passes = [p for _, _, p in cover.sources.values()]
    assert min(passes) == pytest.approx(1.0) and max(passes) == pytest.approx(2.0, abs=1e-6)
    assert mixing.solve({}).sources == {} and mixing.solve({"a": 0}).sources["a"][0] == 0


def test_mix_reads_budgets(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"s{i % 7}" if i % 11 else None, 5 + i % 13) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, n long").withColumn("mine", F.lit(1))
    found = mixing.mix(docs, "n", max_passes=2.5, target_entropy=0.99)
    assert found.columns == ["doc_id", "source", "n", "mine", "mix_pass", "mix_block", "mix_weight"]
    rows_out = found.collect()
    totals = Counter()
    for _, s, n in rows:
        totals[s] += n
    plan = mixing.solve(dict(totals), max_passes=2.5, target_entropy=0.99)
    read, times = Counter(), Counter()
    for r in rows_out:
        read[r.source] += r.n
        times[r.doc_id, r.mix_pass] += 1
    assert set(times.values()) == {1}
    for source, (_, budget, passes) in plan.sources.items():
        assert budget - 0.5 <= read[source] <= budget + 18
        whole = [i for i, s, _ in rows if s == source]
        assert all((i, p) in times for i in whole for p in range(int(passes - 1e-6)))


def test_mix_keeps_every_document_when_asked_to_cover(spark):
    docs = fixtures.awkward(spark).withColumn("_t", F.length("text"))
    found = mixing.mix(docs, "_t", budget="cover", max_passes=1.5)
    assert found.where("mix_pass = 0").count() == docs.count()
    assert mixing.mix(fixtures.empty(spark).withColumn("_t", F.lit(1)), "_t").count() == 0


# -- nearest vectors -----------------------------------------------------------------------------------

def brute_nearest(rows, k, every):
    clean = {i: np.array(v, dtype=np.float64) for i, v in rows if v and all(x is not None for x in v)
             and np.isfinite(np.array(v, dtype=np.float64)).all() and any(v)}
    result = {}
    for q in clean:
        if q % every == 0:
            scores = sorted((-float((clean[i] * clean[q]).sum()), i) for i in clean if i != q)[:k]
            result[q] = [i for _, i in scores]
    return result


@pytest.mark.parametrize("kind", ["clusters", "lengths", "ties", "few"])
def test_nearest_equals_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(hilbert_search, "BLOCK", 128)
    rng = np.random.default_rng(1)
    n = 7 if kind == "few" else 900
    vectors = rng.normal(size=(n, 8))
    if kind == "clusters":
        vectors = np.repeat(rng.normal(size=(30, 8)), 30, axis=0) + 0.05 * vectors
    if kind == "lengths":
        vectors *= rng.lognormal(size=(n, 1))
    if kind == "ties":
        vectors = np.round(vectors)
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(vectors)]
    rows += [(2000, None), (2020, [0.0] * 8), (2040, [1.0] * 7 + [None]), (2060, [float("nan")] * 8), (2080, [float("inf")] * 8), (2100, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("label", F.lit(1)).withColumn("key", F.lit(1))
    found = {}
    for r in hilbert_search.nearest(df, k=10, every=20).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    assert found == brute_nearest(rows, 10, 20)


def test_nearest_of_nothing(spark):
    assert hilbert_search.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_hilbert_curve_visits_neighbours():
    cells = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    keys = hilbert_search.hilbert_keys(cells, 3)
    assert sorted(keys.tolist()) == list(range(512))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


# -- pipeline ------------------------------------------------------------------------------------------

def test_stages_take_effect_and_keep_columns(spark, tmp_path):
    docs, labels = planted_toxicity(spark, 200)
    copies = docs.where("doc_id in (1, 2)").withColumn("doc_id", F.col("doc_id") + 500)
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars").union(copies.select("doc_id", "text", "lang", "source", "n_chars"))
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    columns, at = plain.columns, plain
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == columns, name
        path = f"{tmp_path}/{name}"
        at.write.parquet(path)
        at = spark.read.parquet(path)
        ids = {r.doc_id for r in at.select("doc_id").collect()}
        if name == "toxicity":
            assert not any(i % 5 == 0 for i in ids if i < 500) and len(ids) == 162
        else:
            assert ids == {i for i in range(200) if i % 5}, name
    packed = corpus_pipeline.STAGES[-1][1](spark, at, str(tmp_path))
    assert packed.select("doc_id").distinct().count() == 160


def test_pipeline_on_the_test_table(spark):
    pieces = corpus_pipeline.run(spark, SF)
    assert pieces.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert pieces.count() > 100


def test_all_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(sum(q.startswith(f"op{n}_") for q in names) == 1 for n in range(1, 14))
