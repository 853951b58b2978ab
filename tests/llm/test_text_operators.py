"""Operators over single texts and their corpus statistics, against brute force."""

import collections
import math
import re
import zlib

import numpy as np
import pytest

from aquifer.llm import host_rules, kneser_ney, licenses, page_text, toxicity
from llm_tables import prose, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_host_measures_against_brute_force(edge_docs):
    got = {(r.doc_id, r.n_words): r for r in host_rules.judge(edge_docs).collect()}
    for r in edge_docs.collect():
        t = r.text or ""
        w = WORD.findall(t)
        windows = collections.Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
        covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i:i + 3])] > 1 for k in range(3)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        g = got[(r.doc_id, len(w))]
        assert g.word_chars == sum(map(len, w)) and g.n_symbols == sum(c in "#*$%&|<>" for c in t)
        assert g.n_dup_lines == dup and g.n_repeat_words == len(covered)
        assert g.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (g.kept and g.base_failed)


def test_host_record_decides_soft_failures(spark):
    clean = prose(9, 90)
    rows = [(i, prose(100 + i, 200).replace(" ", "#$ "), "bad") for i in range(40)]
    rows += [(100, rows[0][1], "good")] + [(200 + i, prose(i, 90), "good") for i in range(200)] + [(500, clean, "bad")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id: r.kept for r in host_rules.judge(docs).where("not base_failed").collect()}
    assert not any(kept[i] for i in range(40))  # the host breaks the rule by habit
    assert kept[100] and kept[500]  # one failure on a good host; a clean text on a bad one
    rates = {(r.domain, r.rule): r for r in host_rules.host_rates(
        host_rules.measured(docs, ["source"]), "source").collect()}
    r = rates[("bad", "symbols")]
    assert r.rate > r.shrunk > 0.4 and rates[("good", "symbols")].shrunk < 0.1


def test_host_bound_follows_from_the_prior(spark):
    """Mild failures go on the worse host (a fifth of its rows), stay on the others; gross ones go on any host."""
    def mild(i):
        return " ".join(w + "#" * (k % 4 > 0) for k, w in enumerate(prose(i, 90).split()))

    junk = prose(1, 90).replace(" ", "### ")
    rows = [(i, mild(i) if i < 40 else prose(i, 90), "worse") for i in range(200)]
    rows += [(1000 + i, mild(i) if i % 100 == 0 else prose(i, 90), f"h{i % 8}") for i in range(800)]
    rows += [(5000, junk, "h1"), (5001, None, None), (5002, prose(3, 90), "worse")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id: r.kept for r in host_rules.judge(docs, habit=None, gross=True).collect()}
    assert not any(kept[i] for i in range(40)) and all(kept[i] for i in range(40, 200)) and kept[5002]
    assert all(kept[1000 + i] for i in range(800)) and not kept[5000] and not kept[5001]
    import corpus_pipeline
    good = {r.doc_id for r in corpus_pipeline.drop_low_quality(spark, docs, "").collect()}
    assert good == {k for k, v in kept.items() if v}


def test_host_rules_empty(no_docs):
    assert host_rules.judge(no_docs).count() == 0
    assert host_rules.judge(no_docs, habit=None, gross=True).count() == 0


def brute_kneser_ney(train, texts, n):
    def tokens(t):
        return ["<s>"] * (n - 1) + [w.decode() for w in t.encode().lower().split()] + ["</s>"]

    c = {k: collections.Counter() for k in range(1, n + 1)}
    raw = collections.Counter()
    for t in train:
        x = tokens(t)
        for i in range(n - 1, len(x)):
            c[n][tuple(x[i - n + 1:i + 1])] += 1
            raw[x[i]] += 1
    for k in range(n - 1, 0, -1):
        for g in c[k + 1]:
            c[k][g[1:]] += 1
    d = {k: kneser_ney.discounts(np.array([sum(v == j for v in c[k].values()) for j in (1, 2, 3, 4)], float)) for k in c}
    context = {k: collections.defaultdict(lambda: [0, 0.0]) for k in c}
    for k in c:
        for g, v in c[k].items():
            context[k][g[:-1]][0] += v
            context[k][g[:-1]][1] += d[k][min(v, 3) - 1]

    def p(k, h, w):
        if k == 0:
            return 1 / (len(raw) + 1)
        low = p(k - 1, h[1:], w)
        if h not in context[k]:
            return low
        total, back = context[k][h]
        v = c[k][h + (w,)]
        return (v - (d[k][min(v, 3) - 1] if v else 0)) / total + back / total * low

    total = sum(raw.values())
    for t in texts:
        x = tokens(t)
        yield (len(x) - n + 1, sum(raw[w] > 0 for w in x[n - 1:]),
               sum(math.log10((raw[w] + .5) / (total + .5 * (len(raw) + 1))) for w in x[n - 1:]),
               sum(math.log10(p(n, tuple(x[i - n + 1:i]), x[i])) for i in range(n - 1, len(x))))


@pytest.mark.parametrize("order", [1, 2, 3])
def test_kneser_ney_against_brute_force(edge_docs, order):
    rows = edge_docs.collect()
    out = [zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 1 for r in rows]
    want = list(brute_kneser_ney([r.text or "" for r, o in zip(rows, out) if not o], [r.text or "" for r in rows], order))
    got = {}
    for r in kneser_ney.held_out_scores(edge_docs, order).collect():
        got.setdefault((r.doc_id, r.n_tokens), []).append(r)
    for r, o, w in zip(rows, out, want):
        g = got[(r.doc_id, w[0])].pop()
        assert g.held_out == o and g.n_known == w[1]
        assert g.base_score == pytest.approx(w[2]) and g.score == pytest.approx(w[3])


def test_kneser_ney_sums_to_one(spark):
    """Over the vocabulary and the unknown word, the probabilities after a context add up to one."""
    train = ["a b c a b d", "a b c", "c a a b"]
    vocabulary = ["a", "b", "c", "d"]
    model = kneser_ney.train(spark.createDataFrame([(t,) for t in train], "text string"), 2)
    scorer = kneser_ney.Scorer(model)
    alone = scorer([b"a"])[3][0]  # a, then the end
    after = {w: scorer([f"a {w}".encode()])[3][0] for w in [*vocabulary, "unknown"]}
    end_after = {w: scorer([w.encode()])[3][0] - next(
        s for s in [scorer([f"{w} {w}".encode()])[3][0]]) for w in vocabulary}
    assert alone < 0 and all(v < 0 for v in after.values()) and end_after
    d, total = model.discounts[1], model.total
    assert model.tokens == 16 and model.known == 5 and 0 < d[0] < 1 and total >= 5


def test_kneser_ney_empty(no_docs):
    assert kneser_ney.held_out_scores(no_docs).count() == 0


def test_arrays_hold_large_counts(tmp_path):
    keys = np.sort(np.random.default_rng(1).integers(0, 2**63, 1000).astype(np.uint64))
    values = np.random.default_rng(2).integers(0, 600, 1000).astype(np.uint64)
    kneser_ney.write_arrays(str(tmp_path / "x"), keys, [values, values // np.uint64(2)])
    a = kneser_ney.Arrays(str(tmp_path / "x"))
    assert (a.look_up(keys)[0] == values).all() and (a.look_up(keys)[1] == values // 2).all()
    assert (a.look_up(keys[1:5] + np.uint64(1))[0] == 0).all()
    for columns in ([keys, values], [keys[:0]]):
        assert all((x == y).all() for x, y in zip(kneser_ney.unpack(kneser_ney.pack(columns)), columns))


@pytest.mark.parametrize("order", [2, 3, 4])
@pytest.mark.parametrize("shards", [1, 40])
def test_kneser_ney_adds_up_across_shards(spark, order, shards):
    """Frequent words' n-grams lie in many shards, others whole in one; both give the plain model's scores."""
    rng = np.random.default_rng(order)
    texts = [" ".join(rng.choice(["the", "of", *[f"w{j}" for j in range(300)]], 40, p=[.3, .2, *[.5 / 300] * 300])) for _ in range(120)]
    texts += ["", "the", "the of", "the the the the the"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    model = kneser_ney.train(docs, order, shards=shards)
    assert len(model.heavy) == (0 if shards == 1 else 3)  # with the end
    got = sorted((r.n_tokens, r.n_known, r.base_score, r.score) for r in kneser_ney.score(docs, model, []).collect())
    assert np.array(got) == pytest.approx(np.array(sorted(brute_kneser_ney(texts, texts, order))))
    whole = kneser_ney.Scorer(model)([b"never seen", "Ünseen the".encode()])
    assert whole[3] == pytest.approx([x[3] for x in brute_kneser_ney(texts, ["never seen", "Ünseen the"], order)])


def test_model_files_and_blocks_are_small(tmp_path):
    """A key takes six bytes and its row of values one; common words are not listed in every block."""
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 2**64, 200_000, dtype=np.uint64)
    n = rng.choice([1, 1, 1, 1, 1, 1, 1, 2, 3, 400], len(keys)).astype(np.uint64)
    columns = [n, (n == 1).astype(np.uint64), (n == 2).astype(np.uint64), (n >= 3).astype(np.uint64)]
    kneser_ney.write_arrays(str(tmp_path / "x"), keys, columns)
    assert (tmp_path / "x").stat().st_size < 8 * len(keys)
    assert (kneser_ney.Arrays(str(tmp_path / "x")).look_up(keys[::-1]) == np.stack(columns)[:, ::-1]).all()

    own = np.sort(rng.integers(0, 2**64, 5000, dtype=np.uint64))
    words, sums = [rng.choice(own, 3000) for _ in range(3)], [np.ones(3000, np.uint64)]
    sizes = []
    for common in (own[:0], rng.permutation(own)[:4000]):
        sample = kneser_ney.Words(own[:0], common)
        packed = kneser_ney.pack_grams(words, sums, sample)
        sizes.append(len(packed))
        assert sorted(zip(*words)) == sorted(zip(*kneser_ney.unpack_grams(packed, 3, sample)[:3]))
    assert sizes[1] < 0.6 * sizes[0]


def test_licenses_found_exactly_and_altered(spark, edge_docs, no_docs):
    mit = licenses.TEMPLATES["MIT-permission"]
    altered = mit.replace("copy of this software", "copy of that software")
    half = " ".join(mit.split()[:30])
    filler = words(7, 900)
    rows = [(1, f"{filler}\n{mit}\n{filler}"), (2, f"{filler} {altered} end"), (3, f"{filler} {half} {filler}"), (4, filler),
            (5, "x " * 40 + "Released under the MIT License."), (5, "x " * 40 + "Released under the MIT License."), (6, None),
            (7, "Licensed under the"), (8, "LICENSED UNDER CC BY-NC 4.0.")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.license) for r in got) == [
        (1, "MIT-permission"), (2, "MIT-permission"), (5, "MIT"), (5, "MIT"), (8, "CC-BY-NC-4.0")]
    by = {r.doc_id: r for r in got}
    assert by[1].containment == 1.0 and 0.75 <= by[2].containment < 1.0 and by[5].first_word == 40
    assert licenses.scan(edge_docs).count() == 0 and licenses.scan(no_docs).count() == 0


def test_license_templates_are_found_wherever_they_stand():
    made = [licenses.Template(n, t, 0.75, 1e-3) for n, t in sorted(licenses.TEMPLATES.items())]
    hashes = licenses.WordHashes()
    for name, text in licenses.TEMPLATES.items():
        for shift in range(0, 40, 3):
            found = licenses.matches([(words(shift, shift) + " " + text + " " + words(99, 50)).encode()], made, hashes)
            assert name in {f[1] for f in found}


PAGE = """<html><head><title>T</title><script>var a="</p>";</script></head><body><header>{h}</header><nav><a href=x>{n}</a></nav>
<div class="ad box">{a}</div>{open}<h1>Title {i}</h1><p>First <b>bo</b>ld &amp; {i}.<br>two<p>next{close}
<div id="comments"><p>first!</p></div><form><input name=q>send</form><footer>&copy; {h}</footer></body></html>"""


def test_page_text_drops_all_but_the_article():
    for opening, closing in (("<article>", "</article>"), ("<main><div>", "</div></main>"), ("<div>", "</div>")):
        page = PAGE.format(h="host", n="menu", a="buy", i=7, open=opening, close=closing)
        assert page_text.main_text(page, None, 0.2) == "Title 7 First bold & 7. two next"
    for page in ("", "plain text", "<p>un<b>closed", "a < b", "<!-- x", "<p title='>'>q</p>"):
        assert page_text.main_text(page, None, 0.2) == {"plain text": "plain text", "<p>un<b>closed": "unclosed",
                                                       "a < b": "a < b", "<p title='>'>q</p>": "q"}.get(page, "")


def test_page_text_goes_on_behind_unclosed_elements():
    article = "<article><h1>T</h1><p>body</p></article>"
    for broken in ("<datalist id=d><option>a<option value=b>b</datalist>", "<option>a", "<select><option>a<option>b</select>",
                   "<select><optgroup><option>a", "<div><svg><path d=x></div>", "<svg><path d=x><text>chart</text>",
                   "<object data=x>", "<canvas>", "<noscript>off", "<math><mi>x", "<template><p>t</template>",
                   "<noscript><article>copy</article></noscript>", "<svg><title>icon</title><path/></svg>", "<svg/>",
                   "<svg><foreignObject><div>in</div></foreignObject></svg>", "<object><p>old</p></object>"):
        assert page_text.main_text(f"<html><body>{broken}{article}</body></html>", None, 0.2) == "T body", broken
    page = "<article><p>one <svg><path d=x><p>two <select><option>a<option>b</select> three<canvas>c</canvas></article>"
    assert page_text.main_text(page, None, 0.2) == "one two three"
    for raw in ("<script>x", "<style>x", "<iframe>"):
        assert page_text.main_text(article + raw + article, None, 0.2) == "T body"


def test_page_text_template_of_a_host(spark):
    """A line that every page of a host repeats in its article is template; shared articles are kept whole."""
    body = [words(i, 120) for i in range(8)]
    page = "<html><body><article><h1>{t}</h1><p>Written by our staff</p><p>{b}</p></article></body></html>"
    rows = [(i, f"https://h.example/{i}", page.format(t=f"No {i}", b=body[i])) for i in range(8)]
    same = page.format(t="Copy", b=body[0])
    rows += [(20 + i, "http://copies.example/x", same) for i in range(5)]
    rows += [(40, "http://single.example", page.format(t="One", b=body[1])), (41, None, None), (42, "bad url", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in page_text.extract(df).collect()}
    assert len(got) == len(rows)
    assert all(got[i].text == f"No {i} {body[i]}" for i in range(8))
    assert all(got[20 + i].text == f"Copy Written by our staff {body[0]}" for i in range(5))
    assert got[40].text == f"One Written by our staff {body[1]}" and got[41].text == got[42].text == ""
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert page_text.extract(df.limit(0)).count() == 0
    salted = page_text.with_template(df.selectExpr("*", "'h.example' AS host"), page_text.templates(df, 4), most_tokens=0)
    assert salted.where("size(template) > 0").count() == len(rows)


def test_page_text_template_with_odd_pages_and_two_layouts(spark):
    """Empty pages, a page built otherwise, a second layout and near copies leave a host's templates in place."""
    one = "<html><body><article><h1>{t}</h1><p>Written by our staff</p><p>{b}</p></article></body></html>"
    two = "<html><body><main><h2>{t}</h2><div>{b}</div><div><i>Reported from our bureau</i></div></main></body></html>"
    body = [words(i, 120) for i in range(20)]
    rows = [(i, f"https://h.example/{i}", (one if i < 12 else two).format(t=f"No {i}", b=body[i])) for i in range(18)]
    rows += [(30, "https://h.example/e", ""), (31, "https://h.example/n", None),
             (32, "https://h.example/o", f"<html><body><table><tr><td>{body[18]}</td></tr></table></body></html>")]
    copy = [words(50 + k, 40) for k in range(8)]  # six near copies of one article, one paragraph of each changed
    near = [[w if k != j else words(90 + j, 40) for k, w in enumerate(copy)] for j in range(6)]
    rows += [(60 + j, f"http://n.example/{j}", one.format(t=f"No {j}", b="</p><p>".join(near[j]))) for j in range(6)]
    rows += [(70 + j, f"http://n.example/x{j}", one.format(t=f"No {j}", b=body[j])) for j in range(6)]
    quoted = "</p><p>".join(["a line that many quote", "and another one"])
    rows += [(80 + i, f"http://q.example/{i}", one.format(t=f"No {i}", b=f"{body[i]}</p><p>{quoted}" if i < 5 else body[i]))
             for i in range(15)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in page_text.extract(df).collect()}
    assert all(got[i] == f"No {i} {body[i]}" for i in range(18))
    assert got[30] == got[31] == "" and got[32] == body[18]
    assert all(got[60 + j] == f"No {j} {' '.join(near[j])}" and got[70 + j] == f"No {j} {body[j]}" for j in range(6))
    assert all(got[80 + i] == f"No {i} {body[i]} a line that many quote and another one" for i in range(5))


def test_template_classes_must_be_ordered():
    runs = [page_text.Run(k, None, False, False, False, False) for k in (1, 2, 3, 1, 2, 3)]
    assert page_text.template_tokens(runs, [(1, 9, 0.0), (2, 9, 1.0), (3, 9, 2.0)]) == {1, 2, 3}
    mixed = [page_text.Run(k, None, False, False, False, False) for k in (1, 2, 2, 1)]
    assert page_text.template_tokens(mixed, [(1, 9, 0.0), (2, 9, 1.0)]) == set()


def toxic_corpus(spark, n=600):
    rows, labels = [], []
    for i in range(n):
        bad = i % 6 == 0
        text = words(i, 60, 3000).split()
        if bad:
            text[i % 50] = ("vilething", "nastything")[i % 2]
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad), i % 2))
    return (spark.createDataFrame(rows, "doc_id long, text string"),
            spark.createDataFrame(labels, "doc_id long, toxic int, quality int"))


def test_toxicity_learns_and_generalises(spark):
    docs, labels = toxic_corpus(spark)
    got = toxicity.classify(docs, labels).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.predicted == held.toxic).mean() > 0.95 and ((got.score >= 0.5) == (got.predicted == 1)).all()
    assert got.score.between(0, 1).all()


def test_toxicity_edges(spark, edge_docs, no_docs):
    docs, labels = toxic_corpus(spark, 120)
    net = toxicity.fit(docs, labels)
    rows = toxicity.score(edge_docs, net, ["doc_id"]).collect()
    assert len(rows) == edge_docs.count() and all(0 <= r.score <= 1 for r in rows)
    twos = [r.score for r in rows if r.doc_id == 2]
    assert len(twos) == 2 and twos[0] == twos[1]
    assert toxicity.classify(no_docs, labels).count() == 0
    none = toxicity.classify(docs, labels.where("toxic = 5")).collect()
    assert {r.score for r in none} == {0.5}
    long = (words(3, 450_000, 1000) + " vilething").encode()
    whole = toxicity.score_texts(net, [long], toxicity.Words())[0]
    assert whole == pytest.approx(toxicity.score_texts(net, [long], toxicity.Words(), most=10**9)[0], abs=1e-5)


def test_toxicity_thresholds_cover_all_labelled_rows(spark):
    """Rows outside the sample and texts over `longest` words count; thresholds are those of a search over all rows."""
    docs, labels = toxic_corpus(spark, 480)
    rows = [(r.doc_id, r.text if r.doc_id % 5 else f"der und die {r.text} " + words(r.doc_id, 300, 3000))
            for r in docs.collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    options = dict(sample=40, longest=200)
    net, seen = toxicity.learn(docs, labels, **options)
    assert 0 < len(seen) <= 80
    y = {r.doc_id: r.toxic for r in labels.collect()}
    left = [(i, t.encode()) for i, t in rows if i not in seen and zlib.crc32(str(i).encode()) % 5]
    z, language, sizes = toxicity.measure(net, [t for _, t in left], toxicity.Words())
    toxic = np.array([y[i] for i, _ in left])
    weight = np.ones(len(left))
    for k in (0, 1):
        short = (toxic == k) & (sizes <= 200)
        weight[short] += sum(n for v, n in seen.values() if v == k) / short.sum()
    assert (sizes > 200).sum() > 50 and len(left) > 300
    want = np.full(len(toxicity.LANGUAGES), toxicity.best_threshold(z, toxic, weight))
    for g in set(language.tolist()):
        own = language == g
        if toxic[own].sum() >= 20:
            want[g] = toxicity.best_threshold(z[own], toxic[own], weight[own])
    assert toxicity.fit(docs, labels, **options).thresholds == pytest.approx(want, abs=2 / toxicity.BINS)


def test_toxicity_threshold_is_per_language():
    z, y = np.array([3.0, 2.0, 1.0, 0.0]), np.array([1, 1, 0, 0])
    assert toxicity.best_threshold(z, y, np.ones(4)) == 1.5
    w = toxicity.Words()
    assert toxicity.LANGUAGES[toxicity.language_of(w.of("der hund und die katze".encode()))] == "de"
    assert toxicity.language_of(w.of(b"xyzzy")) == 0
