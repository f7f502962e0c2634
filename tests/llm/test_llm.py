"""The training-data operators: brute force, round trips, held-out accuracy, and odd input."""

import hashlib
import itertools
import json
import random
import zlib

import brute_katz
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chalkline.llm import bpe, components, exact_dedup, html_text, katz, license_scan, mixing, simhash, topk, toxicity, warc
from chalkline.llm.license_texts import TEMPLATES

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "long words again and again " * 4000
ODD = [
    (1, "Same text here for all", "en", "a", 1), (2, "same TEXT here for all", "en", "a", 1), (2, "same TEXT here for all", None, "a", 1), (3, None, "en", "b", None),
    (4, "", "en", None, 0), (5, LONG, "en", "c", 9), (6, "É un été à 　 Łódź 😀", "fr", "b", 3), (None, "a text without an id", "en", None, 1), (100, "same text here for all but one", None, None, 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns named like the operators' own."""
    docs = spark.createDataFrame(ODD, SCHEMA)
    names = ("digest", "row", "fp", "node", "component_id", "keep_id", "size", "target", "chunk", "kept", "rank", "score", "html")
    return docs.withColumns({n: F.lit("x") for n in names})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def as_rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


# -- op1 ----------------------------------------------------------------------------------


def test_html_article_without_its_surroundings():
    page = (
        "<!DOCTYPE html><html><head><title>T</title><script>var t='</p><p>no';</script></head><body class='with-sidebar'>"
        "<header><h1>Site name</h1></header><div id='cookie-notice'>We use cookies, and so on, and on.</div><nav><ul><li><a href=/>Home</a></li></ul></nav>"
        "<article><h1>A   head&shy;line</h1><p>First paragraph, with <b>bold</b> text &amp; signs;\n it is long enough, one would think, to count.</p>"
        "<p>Second one&nbsp;here, of a fair length as well: it has commas, stops. And more.<ul><li>a point</li></ul><div class='ad'>Buy now, buy here, buy!</div>"
        "<form><p>Your mail</p></form></article><aside>Related, things, to read.</aside><div class='comments'><p>Great article, I liked it very much, thanks.</p></div>"
        "<footer>&copy; someone</footer></body></html>"
    )
    assert html_text.main_text(page) == (
        "A head­line First paragraph, with bold text & signs; it is long enough, one would think, to count. "
        "Second one here, of a fair length as well: it has commas, stops. And more. a point"
    )


STORY = [
    "The council met on Monday, as it had said it would, and went through the whole list of repairs; nobody objected to the order.",
    "By noon, three of the bridges had been approved. The fourth, which crosses the old canal, needs another survey, the engineer said.",
    "Work begins in spring, if the weather holds, and ends before the harvest; until then, traffic goes round by the northern road.",
]


def story_page(before="", wrap="{}", after=""):
    return "<html><body>" + before + wrap.format("<h1>Bridges</h1>" + "".join(f"<p>{x}</p>" for x in STORY)) + after + "</body></html>"


WANTED = " ".join(["Bridges", *STORY])
PLAIN_BEFORE = "<div>Sign in</div><div><span>Today</span></div><div><ul><li><a href=/1>News of the town</a></li><li><a href=/2>Sport</a></li></ul></div>"
PLAIN_AFTER = "<div>Share</div><div>More like this</div><div><a href=/x>Ten old bridges and where to find them</a></div><div>All rights reserved 2024</div>"


@pytest.mark.parametrize(
    "wrap",
    [
        "<div>{}</div>", "<div class='layout has-sidebar'><article>{}</article></div>", "<form id='aspnetForm'><div>{}</div></form>", "<div id='related-notice'>{}</div>",
        "<main><header>{}</header></main>", "<div class='notice-of-motion'>{}</div>", "<table class='widget'><tr><td>{}</td></tr></table>", "<section><div/>{}</section>",
    ],
)
def test_html_pages_without_telling_names(wrap):
    assert html_text.main_text(story_page(PLAIN_BEFORE, wrap, PLAIN_AFTER)) == WANTED


def test_html_text_in_several_elements_and_headings_of_any_class():
    page = story_page(wrap="<div>{}</div><h2 class='section-header'>What next</h2><section><p>" + STORY[0] + "</p></section>")
    assert html_text.main_text(page) == WANTED + " What next " + STORY[0] or html_text.main_text(page) == WANTED + " " + STORY[0]
    assert "What next" in html_text.main_text(story_page(wrap="<article>{}<h2 class='section-header'>What next</h2><p>" + STORY[1] + "</p></article>"))
    assert html_text.main_text("<article><h1>a</h1><p>" + STORY[0] + " a &am<b>p; b</b></p></article>") == "a " + STORY[0] + " a &amp; b"
    assert html_text.main_text(story_page("<svg width=1 /><iframe src=x />", "<div>{}</div>")) == WANTED


def test_html_comments_and_notices_stay_out():
    talk = "<div class='comments'>" + "".join(f"<p>I don't agree, {x.lower()}</p>" for x in STORY[:2]) + "</div>"
    assert html_text.main_text(story_page("<div class='cookie-notice'>" + STORY[2] + "</div>", "<div>{}</div>", talk + "<footer>" + STORY[1] + "</footer>")) == WANTED
    assert html_text.main_text("<body><nav><a href=/>Home</a></nav><div class='ad'>Buy now, buy here.</div><footer>(c) us</footer></body>") == ""


def test_html_scores_decide(monkeypatch):
    """With all paths alike the boilerplate comes along: it is the ratios that keep it out."""
    page = story_page(PLAIN_BEFORE, "<div>{}</div>", PLAIN_AFTER)
    assert html_text.main_text(page) == WANTED
    monkeypatch.setattr(html_text, "path_scores", lambda blocks, scales: [1.0] * len(blocks))
    assert html_text.main_text(page) != WANTED


def test_html_odd_pages(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (None, "u", "<p>"), (3, "u", "<p>" + "word, " * 50_000), (3, "u", "plain < text")], "page_id bigint, url string, html string")
    got = html_text.extract_main_text(pages.withColumn("text", F.lit("clash"))).collect()
    assert sorted(r.n_chars for r in got) == [0, 0, 0, 12, 299_999]
    assert html_text.extract_main_text(pages.limit(0)).count() == 0


# -- op2 ----------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = (text or "").translate(brute_katz.LOWER).encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in linked:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {n: find(n) for n in nodes}


def test_simhash_against_brute_force(spark):
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(60):
        words = rnd.choices(vocab, k=rnd.randint(3, 400))
        texts.append(" ".join(words))
        for _ in range(rnd.randint(0, 4)):
            changed = list(words)
            changed[rnd.randrange(len(changed))] = rnd.choice(vocab)
            texts.append(" ".join(changed))
    rows = list(enumerate(texts, 10))
    fps = {i: plain_fingerprint(t) for i, t in rows}
    want = plain_components(fps, [(a, b) for a, b in itertools.combinations(fps, 2) if (fps[a] ^ fps[b]).bit_count() <= 4])
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id: int(r.fingerprint, 16) for r in got} == fps
    assert {r.doc_id: r.component_id for r in got} == want


def test_simhash_grid_misses_no_pair(spark):
    rnd = random.Random(6)
    base = [rnd.getrandbits(64) for _ in range(40)]
    near = [b ^ sum(1 << k for k in rnd.sample(range(64), rnd.randint(1, 5))) for b in base for _ in range(4)]
    fps = {f: i for i, f in enumerate(dict.fromkeys(base + near))}
    signed = [(f - (1 << 64) if f >> 63 else f, i) for f, i in fps.items()]
    edges = simhash.links(spark.createDataFrame(signed, "fp bigint, node bigint"))
    got = {r.node: r.component for r in components.components(edges).collect()}
    want = plain_components(fps.values(), [(fps[a], fps[b]) for a, b in itertools.combinations(fps, 2) if (a ^ b).bit_count() <= 4])
    assert {n: got.get(n, n) for n in want} == want


def distinct_texts(n, seed, words=60):
    rnd = random.Random(seed)
    return [" ".join(f"w{rnd.randrange(9000)}" for _ in range(words)) for _ in range(n)]


def test_simhash_keeps_texts_without_their_own_id(spark, odd, empty):
    """Different texts under null or repeated ids stay; a near copy goes, whatever its id."""
    texts = distinct_texts(9, 21, 300)
    rows = [(None, t) for t in texts[:4]] + [(7, t) for t in texts[4:7]] + [(1, texts[7]), (2, texts[8]), (None, texts[0]), (None, texts[1] + " more"), (3, texts[2] + " more"), (7, texts[8] + " more")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = as_rows(simhash.keep_documents(docs), "doc_id", "text")
    assert len(got) == 9 and {t.removesuffix(" more") for _, t in got} == set(texts)
    assert (3, texts[2] + " more") in got and (2, texts[8]) in got and {(7, t) for t in texts[4:7]} <= set(got)
    assert simhash.keep_documents(odd).columns == odd.columns and simhash.keep_documents(empty).count() == 0


def test_simhash_stage_finds_copies_of_similarity_four_fifths(spark):
    """Against all pairs: five-word shingles, Jaccard 0.8 or more, or op2's four bits."""
    rnd = random.Random(22)
    rows = []
    for t in distinct_texts(40, 23, 120) + distinct_texts(10, 24, 600):
        rows.append(t)
        for k in (1, 2, 3, 6):
            words = t.split()
            for at in rnd.sample(range(len(words)), k * len(words) // 120):
                words[at] = f"x{rnd.randrange(9000)}"
            rows.append(" ".join(words))
    rows = dict(enumerate(rows, 100))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows.items()}
    fps = {i: plain_fingerprint(t) for i, t in rows.items()}
    near = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) or (fps[a] ^ fps[b]).bit_count() <= 4
    want = set(plain_components(rows, [p for p in itertools.combinations(rows, 2) if near(*p)]).values())
    got = {r.doc_id for r in simhash.keep_documents(spark.createDataFrame(list(rows.items()), "doc_id bigint, text string")).collect()}
    assert got == want and len(want) < 0.6 * len(rows)


def test_simhash_odd_input(odd, empty):
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(odd).collect()}
    assert {(3, "0" * 16, 3), (4, "0" * 16, 3)} <= got
    assert {c for i, _, c in got if i in (1, 2)} == {1} and {c for i, _, c in got if i is None} == {None}
    assert simhash.near_duplicates(odd).count() == len(ODD) and simhash.near_duplicates(empty).count() == 0


# -- op3 ----------------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    rnd = random.Random(7)
    vocab = [f"word{i}" for i in range(500)]
    docs, labels = [], []
    for i in range(1200):
        words, toxic = rnd.choices(vocab, k=40), rnd.random() < 0.2
        if toxic:
            words[rnd.randrange(40)] = rnd.choice(["vile", "awful", "nasty"])
        docs.append((i, " ".join(words)))
        labels.append((i, rnd.randint(0, 1), int(toxic)))
    d, lab = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels[:800], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r.rejected for r in toxicity.score(d, lab).where("doc_id >= 800").collect()}
    assert sum(got[i] == bool(t) for i, _, t in labels[800:]) >= 390


def test_toxicity_chain_feeds_earlier_probabilities(spark):
    """Toxic texts are junk ones of one kind: the second model leans on the first one's probability, from out-of-fold predictions."""
    rnd = random.Random(17)
    docs, labels = [], []
    for i in range(900):
        junk = i % 3 == 0
        text = " ".join(rnd.choices([f"w{j}" for j in range(40)], k=15) + (rnd.choices([f"spam{j}" for j in range(60)], k=6) if junk else []))
        docs.append((i, text))
        labels.append((i, int(not junk), int(junk and rnd.random() < 0.8)))
    d, lab = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    chain = toxicity.fit_chain(d, lab, toxicity.label_categories())
    weight = chain.models[1][toxicity.SLOTS]
    assert chain.categories == ["junk", "toxic"] and weight > 0.3
    text = [np.array([], np.int32)]
    low, high = (toxicity.predict_linear(chain.models[1], text, np.array([[x]]))[0] for x in (0.0, 1.0))
    assert high > low
    again = toxicity.fit_chain(d.repartition(7), lab.union(lab.selectExpr("doc_id", "quality", "0 toxic")).repartition(3), toxicity.label_categories())
    assert all(np.array_equal(a, b) for a, b in zip(chain.models, again.models, strict=True))  # of differing labels the greater counts


def test_toxicity_fit_against_plain_newton():
    """The refit on chosen words against Newton steps on the same loss: the same probabilities."""
    rng = np.random.default_rng(5)
    rows = [np.unique(rng.integers(0, 12, 6)).astype(np.int64) for _ in range(400)]
    extra = rng.random((400, 1))
    z = np.array([(r < 4).sum() - 1.5 + 2 * e[0] for r, e in zip(rows, extra, strict=True)])
    y = (rng.random(400) < 1 / (1 + np.exp(-z))).astype(float)
    model = toxicity.fit_linear(rows, extra, y, l1=1e-6, l2=1e-3, steps=3000)
    chosen = np.flatnonzero(model[: toxicity.SLOTS])
    x = np.array([[float(c in set(r.tolist())) for c in chosen] + [e[0], 1.0] for r, e in zip(rows, extra, strict=True)])
    ridge = np.diag([1e-3] * len(chosen) + [1e-9, 1e-9])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(y) + ridge, x.T @ (p - y) / len(y) + ridge @ w)
    assert np.abs(toxicity.predict_linear(model, rows, extra) - 1 / (1 + np.exp(-x @ w))).max() < 0.01


def test_toxicity_odd_input(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 1), (5, 0, 0), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    assert toxicity.score(odd, labels).count() == len(ODD)
    assert toxicity.keep_documents(odd, labels).columns == odd.columns
    assert toxicity.score(odd, labels.limit(0)).where("rejected").count() == 0
    assert toxicity.score(empty, labels).count() == 0


# -- op4 ----------------------------------------------------------------------------------


@pytest.mark.parametrize("order", [2, 3, 4])
def test_katz_against_brute_force(spark, order):
    rnd = random.Random(8)
    vocab = [f"w{int(rnd.paretovariate(0.7))}" for _ in range(300)]
    rows = [(i, " ".join(rnd.choices(vocab, k=rnd.randint(0, 60)))) for i in range(200)] + [(300, None), (301, ""), (302, "Unheard OF")]
    rows += [(400 + i, rows[7][1]) for i in range(12)]
    want = brute_katz.scores(rows, order)
    got = {r.doc_id: r for r in katz.score_documents(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), order).collect()}
    for i, w in want.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert r.base_score == pytest.approx(w[4], abs=1e-8) and r.score == pytest.approx(w[5], abs=1e-8)


@pytest.mark.parametrize("order", [2, 3])
def test_katz_probabilities_sum_to_one(spark, order):
    """The operator's own P(w | context) over all words and the unknown one, from scores of probe texts that differ in w only."""
    rows = [(i, " ".join(random.Random(i).choices("abcdefgh", weights=(9, 7, 5, 3, 2, 1, 1, 1), k=12))) for i in range(40)]
    held = [i for i in range(10_000, 30_000) if zlib.crc32(str(i).encode()) % 7 == 2]
    words = sorted({w for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2 for w in t.split()})
    probes, asked = [], {}
    for head in ("", "a", "h", "b a", "g f", "zzz", "a zzz"):
        for w in [*words, "unseen"]:
            # P(head w </s>): all but the factor of w and of the end after it cancels against the same text cut before w
            asked[head, w] = len(probes)
            probes.append((held[len(probes)], f"{head} {w} zz1 zz2 zz3"))
    got = {r.doc_id: r.score for r in katz.score_documents(spark.createDataFrame(rows + probes, "doc_id bigint, text string"), order).collect()}
    plain = brute_katz.Model([t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2], order)
    for head in ("", "a", "h", "b a", "g f", "zzz", "a zzz"):
        total = 0.0
        for w in [*words, "unseen"]:
            text = [*["<s>"] * (order - 1), *head.split(), w, "zz1", "zz2", "zz3", "</s>"]
            at = len(head.split())
            rest = sum(np.log10(plain.p(x, tuple(text[j : j + order - 1]))) for j, x in enumerate(text[order - 1 :]) if j != at)
            total += 10 ** (got[probes[asked[head, w]][0]] - rest)
        end = plain.p("</s>", tuple([*["<s>"] * (order - 1), *head.split()][-(order - 1) :]))
        assert total + end == pytest.approx(1, abs=1e-9)


def test_katz_odd_input(odd, empty):
    got = katz.score_documents(odd).collect()
    assert len(got) == len(ODD) and all(np.isfinite(r.score) and np.isfinite(r.base_score) for r in got)
    assert katz.score_documents(empty).count() == 0


# -- op5 ----------------------------------------------------------------------------------


def test_exact_dedup_odd_input(odd, empty):
    got = as_rows(exact_dedup.exact_dedup(odd), "doc_id", "keep_id", "group_size", "kept")
    assert [r for r in got if r[0] in (1, 2)] == [(1, 2, 3, False), (2, 2, 3, False), (2, 2, 3, True)]
    assert [r for r in got if r[0] in (3, 4)] == [(3, 4, 2, False), (4, 4, 2, True)]
    assert exact_dedup.exact_dedup(empty).count() == 0
    kept = exact_dedup.keep_documents(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 2, 4, 5, 6, 100]


def test_exact_dedup_index_persists(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    batch = lambda *rows: spark.createDataFrame(rows, "doc_id bigint, text string")
    first = exact_dedup.exact_dedup(batch((1, "A"), (2, "b")), exact_dedup.DigestIndex(spark, path, 4), "first")
    assert as_rows(first, "doc_id", "kept") == [(1, True), (2, True)]
    index = exact_dedup.DigestIndex(spark, path, 4)  # opened again, as in another session
    second = exact_dedup.exact_dedup(batch((3, "a"), (4, "c"), (5, "C")), index, "second")
    assert as_rows(second, "doc_id", "keep_id", "kept") == [(3, 1, False), (4, 5, False), (5, 5, True)]
    assert index.rows().count() == 3


# -- op6 ----------------------------------------------------------------------------------


def test_bpe_as_the_library_does(spark, odd, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    theirs, ours = Tokenizer.from_file(path), bpe.automaton(path)
    rnd = random.Random(9)
    texts = ["".join(rnd.choice("aaab  etn<|>\n\t'sé中😀1") for _ in range(rnd.randint(0, 60))) for _ in range(500)]
    texts += ["x" * 3000 + "ing", "  " * 300, "<|endoftext|>hi <|endoftext|>", "DON'T we're", LONG, "\x00\x7f\u0085"]
    for t in texts:
        ids = theirs.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ours.encode(t), "<u4").tolist() == ids
        assert ours.decode(np.array(ids, "<u4").tobytes()) == theirs.decode(ids, skip_special_tokens=False)
    got = {r.doc_id: r for r in bpe.encode_decode(odd, path).collect()}
    assert got[3].n_tokens == got[4].n_tokens == 0
    assert got[6].decoded_sha256 == hashlib.sha256(ODD[6][1].encode()).hexdigest()
    assert bpe.encode_decode(empty, path).count() == 0


def test_bpe_automaton_lacks_exactly_the_wrong_arcs(tmp_path):
    """On a toy vocabulary the automaton accepts a token pair exactly if merging gives that pair."""
    alphabet = {c: i for i, c in enumerate("abc")}
    merges = [("a", "b"), ("b", "c"), ("ab", "c"), ("a", "a"), ("aa", "b")]
    vocab = dict(alphabet) | {x + y: 3 + i for i, (x, y) in enumerate(merges)}
    machine = bpe.MergeAutomaton(vocab, merges, {}, r"\S+")
    spec = {"version": "1.0", "added_tokens": [], "normalizer": None, "pre_tokenizer": None, "post_processor": None, "decoder": None, "truncation": None, "padding": None,
            "model": {"type": "BPE", "vocab": vocab, "merges": [list(m) for m in merges], "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False}}
    (tmp_path / "t.json").write_text(json.dumps(spec))
    library = Tokenizer.from_file(str(tmp_path / "t.json"))
    for n in range(1, 8):
        for word in map("".join, itertools.product("abc", repeat=n)):
            assert machine.encode_word(word.encode()) == library.encode(word).ids
    with pytest.raises(ValueError, match="byte-level"):
        bpe.automaton(str(tmp_path / "t.json"))  # no byte-level splitting in this file


# -- op7 ----------------------------------------------------------------------------------


def test_warc_round_trip_odd_pages(spark):
    big = "<p>" + "x" * 1200
    rows = [(1, "http://a.org/x", big), (2, "http://a.org/x", big), (3, None, None), (4, "https://WWW.b.org:80/p?q=1#f", "é" * 500), (5, "http://b.org/ a\tb", "é" * 499 + "y"), (None, "http://c.org", ""), (6, "u", "l" * 300_000), (6, "u", "l" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("sha1", F.lit("clash"))
    got = as_rows(warc.round_trip(pages), "page_id", "payload_bytes", "record_type", "refers_to")
    assert got == sorted(
        [(1, 1203, "revisit", 2), (2, 1203, "response", None), (3, 0, "response", None), (4, 1000, "response", None), (5, 999, "response", None), (None, 0, "response", None), (6, 300_000, "response", None), (6, 300_000, "response", None)],
        key=repr,
    )
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_revisits_of_odd_urls(spark):
    """Urls that quoting rewrites, and one page_id with two payloads."""
    urls = ["http://a.org/ä", "http://a.org/?x=a|b", "http://ä.org/{x}", 'http://a.org/<">^`\\', "http://a.org/%7C%C3%A4|", "http://a.org/a\x7fb\r\nc", None]
    rows = [(10 * i + k, u if k == 9 else f"http://b.org/{k}", f"{i}" * (1000 + i)) for i, u in enumerate(urls) for k in (1, 2, 9)]
    rows += [(500, "http://c.org/1", "y" * 2000), (500, "http://c.org/2", "z" * 3000), (401, "u", "y" * 2000), (402, "v", "z" * 3000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = as_rows(warc.round_trip(pages), "page_id", "payload_bytes", "record_type", "refers_to")
    want = [(i, len(h), "response", None) if i % 10 == 9 or i == 500 else (i, len(h), "revisit", 500 if i > 400 else i // 10 * 10 + 9) for i, _, h in rows]
    assert got == sorted(want, key=repr)


def test_warc_lookup_of_single_urls(spark, tmp_path):
    root = f"file://{tmp_path}/warc"
    pages = spark.createDataFrame([(i, f"http://h{i % 7}.org/{i}", f"body {i} " * 200) for i in range(3000)], "page_id bigint, url string, html string")
    directory = warc.build_index(warc.write_archives(pages, root), root, lines=64)
    asked = pages.where("page_id IN (0, 1499, 2999)").select(warc.url_key(F.col("url")).alias("key"), "page_id")
    got = warc.fetch(asked.unionByName(asked), root, directory).collect()
    assert sorted((r.page_id, r.payload_digest) for r in got) == sorted((i, hashlib.sha1(f"body {i} ".encode() * 200).hexdigest()) for i in (0, 1499, 2999))


# -- op8 ----------------------------------------------------------------------------------


def test_license_scan(odd, empty, spark):
    mit = TEMPLATES["MIT"].replace("hereby ", "").replace("Software", "Program")
    docs = spark.createDataFrame([(1, "Intro words. " + mit + " outro"), (2, "under the mit license it is not released"), (3, "X released under the MIT license. " * 2)], "doc_id bigint, text string")
    got = as_rows(license_scan.scan(docs), "doc_id", "license", F.round("coverage", 2).alias("c"), "start_char")
    assert got == [(1, "MIT", 0.96, 13), (3, "MIT-notice", 1.0, 2), (3, "MIT-notice", 1.0, 36)]
    assert license_scan.scan(odd).count() == 0 and license_scan.scan(empty).count() == 0


def test_license_scan_of_insertions_fragments_and_overlaps(spark):
    words_ = TEMPLATES["MIT"].split()
    inserted = " ".join(words_[:80] + [f"extra{i}" for i in range(30)] + words_[80:])
    docs = spark.createDataFrame(
        [(1, inserted), (2, "see: " + " ".join(words_[:100]) + " then other words"), (3, TEMPLATES["BSD-3-Clause"]), (4, f"{TEMPLATES['MIT']} {TEMPLATES['MIT']}"), (5, f"{TEMPLATES['ISC']} x {TEMPLATES['Zlib']}")],
        "doc_id bigint, text string",
    )
    rows = license_scan.scan(docs).collect()
    assert sorted((r.doc_id, r.license) for r in rows) == [(1, "MIT"), (2, "MIT"), (3, "BSD-3-Clause"), (4, "MIT"), (4, "MIT"), (5, "ISC"), (5, "Zlib")]
    by = {r.doc_id: r for r in rows}
    assert by[1].coverage == 1.0 and (by[1].start_char, by[1].end_char) == (0, len(inserted) - 1)
    assert by[2].matched_words == len(license_scan.words(" ".join(words_[:100]))) and by[2].start_char == 5 and by[2].end_char == 5 + len(" ".join(words_[:100]).rstrip(","))


def plain_alignment(template, doc):
    """The best local alignment over all of the document, no band: matched words."""
    best, before = (0, 0), [(0, 0)] * (len(doc) + 1)
    for w in template:
        row = [(0, 0)]
        for p, x in enumerate(doc):
            if x == w:
                v = (before[p][0] + 2, before[p][1] + 1)
                best = max(best, v)
            else:
                s, m = max(before[p + 1], row[p])
                v = (s - 1, m) if s > 1 else (0, 0)
            row.append(v)
        before = row
    return best[1]


def test_license_scan_recall_against_unbanded_alignment():
    """Changed licences in other text: nine tenths of what a full alignment finds are found, with about its coverage."""
    rnd = random.Random(8)
    index = license_scan.TemplateIndex(TEMPLATES)
    wanted = found = 0
    for name in ("MIT", "ISC", "BSD-3-Clause", "Zlib", "BSL-1.0", "Apache-2.0-header", "LGPL-2.1-header"):
        for change in (0.02, 0.05, 0.1):
            text = []
            for w in TEMPLATES[name].split():
                kind = rnd.random()
                text += [w] if kind > change else [] if kind < change / 3 else ["changed"] if kind < change / 2 else [w, "added", "words"]
            doc = " ".join([f"w{rnd.randint(1, 50)}" for _ in range(40)] + text + [f"w{rnd.randint(1, 50)}" for _ in range(40)])
            matched = plain_alignment([w.lower() for w in license_scan.words(TEMPLATES[name])], [w.lower() for w in license_scan.words(doc)])
            wanted += 1
            found += any(m[0] == name and m[4] >= 0.95 * matched for m in index.matches(doc))
    assert found >= 0.9 * wanted


def test_license_scan_finds_every_template_whole(spark):
    docs = spark.createDataFrame([(i, f"before {t} after") for i, t in enumerate(TEMPLATES.values())], "doc_id bigint, text string")
    got = {(r.doc_id, r.license) for r in license_scan.scan(docs).where("coverage = 1").collect()}
    assert {(i, n) for i, n in enumerate(TEMPLATES)} <= got


# -- op9 ----------------------------------------------------------------------------------


def test_mixing_targets_and_quotas(spark):
    rnd = random.Random(10)
    rows = [(i, "w " * rnd.randint(1, 40), rnd.choice(["a", "a", "a", "b", "c", None])) for i in range(3000)]
    got = mixing.mix_documents(spark.createDataFrame(rows, "doc_id bigint, text string, source string"))
    by = {r.target: r for r in got.groupBy("target").agg(F.sum("taken").alias("taken"), F.first("source_size").alias("n"), F.max(F.col("taken") - 2 * F.col("size")).alias("over")).collect()}
    assert all(abs(r.taken - t) <= 41 and r.over <= 0 for t, r in by.items())
    assert sum(by) == pytest.approx(min(1.5 * sum(len(t.split()) for _, t, _ in rows), 2 * sum(r.n for r in by.values())))
    again = mixing.mix_documents(spark.createDataFrame(rows[::-1], "doc_id bigint, text string, source string"))
    assert as_rows(got, "doc_id", "taken") == as_rows(again, "doc_id", "taken")


def test_mixing_targets_reshare_the_excess():
    assert mixing.targets([100, 10, 10], [3, 1, 2], 1.5, 2) == [140.0, 20.0, 20.0]
    assert mixing.targets([0, 0], [1, 1], 1.5, 2) == [0.0, 0.0] and mixing.targets([], [], 1.5, 2) == []


def test_mixing_flow_over_overlapping_sources():
    """Words that only one source can use go there, shared ones where they are missing; repeats only when needed."""
    flow = mixing.route([[0], [0, 1], [1, 2]], [10, 10, 10], [10, 10, 10], 2)
    assert flow == [[10.0], [0.0, 10.0], [0.0, 10.0]]
    assert mixing.route([[0]], [10], [15], 2) == [[15.0]]


def plain_flow(patterns, sizes, quota, cap):
    """(words routed, cost) by shortest paths over a graph with an edge per repetition, found by relaxing all edges."""
    n_p, n_s = len(patterns), len(quota)
    ends = n_p + n_s
    edges = []  # from, to, room, cost; the reverse edge follows

    def edge(a, b, room, cost):
        edges.extend(([a, b, room, cost], [b, a, 0, -cost]))

    for p, members in enumerate(patterns):
        for r in range(1, cap + 1):
            edge(ends, p, sizes[p], r)
        for s_ in members:
            edge(p, n_p + s_, 10**9, 0)
    for s_, q in enumerate(quota):
        edge(n_p + s_, ends + 1, q, 0)
    routed = cost = 0
    while True:
        dist, via = {ends: 0}, {}
        for _ in range(ends + 2):
            for k, (a, b, room, c) in enumerate(edges):
                if room > 0 and a in dist and dist[a] + c < dist.get(b, 10**9):
                    dist[b], via[b] = dist[a] + c, k
        if ends + 1 not in dist:
            return routed, cost
        path, at = [], ends + 1
        while at != ends:
            path.append(via[at])
            at = edges[via[at]][0]
        x = min(edges[k][2] for k in path)
        for k in path:
            edges[k][2] -= x
            edges[k ^ 1][2] += x
        routed, cost = routed + x, cost + x * dist[ends + 1]


def test_mixing_flow_against_plain_shortest_paths():
    rnd = random.Random(14)
    for _ in range(120):
        n_s = rnd.randint(1, 5)
        patterns = [sorted(rnd.sample(range(n_s), rnd.randint(1, n_s))) for _ in range(rnd.randint(1, 7))]
        sizes = [rnd.randint(1, 30) for _ in patterns]
        quota = [rnd.randint(0, 60) for _ in range(n_s)]
        flow = mixing.route(patterns, [float(x) for x in sizes], [float(x) for x in quota], 2)
        used = [sum(f) for f in flow]
        assert all(u <= 2 * n + 1e-6 for u, n in zip(used, sizes, strict=True))
        given = [sum(f[m.index(k)] for f, m in zip(flow, patterns, strict=True) if k in m) for k in range(n_s)]
        assert all(g <= q + 1e-6 for g, q in zip(given, quota, strict=True))
        cost = sum(min(u, n) + 2 * max(0, u - n) for u, n in zip(used, sizes, strict=True))
        assert (sum(used), cost) == pytest.approx(plain_flow(patterns, sizes, quota, 2))


def test_mixing_odd_input(odd, empty):
    got = mixing.mix_documents(odd).collect()
    assert len(got) == len(ODD) and all(r.taken <= 2 * r.size for r in got)
    assert mixing.mix_documents(empty).count() == 0
    assert mixing.repeat_documents(odd).columns == odd.columns


def test_mixing_copies_of_rows_without_their_own_id(spark):
    """Every row has its own copies, as the mix has them, under null and repeated ids too."""
    rnd = random.Random(11)
    rows = [(rnd.choice([None, 5, 6, i]), f"t{i} " + "w " * rnd.randint(1, 40), rnd.choice(["a", "a", "a", "a", "b", "c"])) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    taken = mixing.mix_documents(docs).agg(F.sum("taken").alias("n")).first().n
    assert mixing.repeat_documents(docs).agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).first().n == taken


# -- op10 ---------------------------------------------------------------------------------


def plain_search(rows, k):
    tf = {i: {} for i, _ in rows}
    for i, t in rows:
        for w in (t or "").translate(brute_katz.LOWER).encode().split():
            tf[i][w] = tf[i].get(w, 0) + 1
    length = {i: sum(x.values()) for i, x in tf.items()}
    mean, n = sum(length.values()) / len(rows), len(rows)
    df = {}
    for x in tf.values():
        for w in x:
            df[w] = df.get(w, 0) + 1
    out = {}
    for q in [i for i in tf if i % 50 == 0]:
        scores = []
        for d, x in tf.items():
            s = sum(c * np.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * x[w] * (topk.K1 + 1) / (x[w] + topk.K1 * (1 - topk.B + topk.B * length[d] / mean)) for w, c in tf[q].items() if w in x)
            if s > 0:
                scores.append((-round(s, 6), d))
        out[q] = [d for _, d in sorted(scores)[:k]]
    return out


def test_topk_against_brute_force(spark):
    rnd = random.Random(11)
    rows = [(i, " ".join(f"w{int(rnd.paretovariate(0.5))}" for _ in range(rnd.randint(0, 80)))) for i in range(600)]
    rows += [(1000 + i, rows[0][1]) for i in range(15)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    got = {}
    for r in topk.search(docs, docs.where("doc_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.doc_id)
    assert got == {q: d for q, d in plain_search(rows, topk.K).items() if d}


def test_topk_prunes_most_blocks_of_skewed_text():
    """Five topics with words of their own: the block bounds leave a query its topic, and nothing of the result is lost."""
    rnd = random.Random(5)
    rows = [(i, " ".join(f"{'abcde'[i % 5]}{int(rnd.paretovariate(0.8))}" for _ in range(rnd.randint(10, 120)))) for i in range(2000)]
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([t for _, t in rows])], names=["doc_id", "text"])
    (built,) = topk._build(iter([batch]))
    mean = sum(len(t.split()) for _, t in rows) / len(rows)
    shard = topk.Shard(built.to_pylist()[0], mean)
    df = dict(zip(shard.vocab.tolist(), shard.sizes.tolist(), strict=True))
    terms, weights, starts = [], [], [0]
    for _, text in rows[::50]:
        h, n = np.unique(np.array(topk.word_hashes(text)[:-1], np.uint64), return_counts=True)
        terms.append(h)
        weights.append([c * np.log(1 + (len(rows) - df[x] + 0.5) / (df[x] + 0.5)) for x, c in zip(h.tolist(), n.tolist(), strict=True)])
        starts.append(starts[-1] + len(h))
    got = {q: shard.ids[d].tolist() for q, _, d in shard.search(np.array(starts), np.concatenate(terms), np.concatenate(weights), np.zeros(len(terms)), 10)}
    assert [got[q] for q in range(len(terms))] == [x for x in plain_search(rows, 10).values()]
    assert shard.scored < 0.4 * shard.tested


def test_topk_searches_several_shards_and_groups(spark, monkeypatch):
    rnd = random.Random(12)
    rows = [(i, " ".join(f"w{int(rnd.paretovariate(0.5))}" for _ in range(rnd.randint(0, 60)))) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    monkeypatch.setattr(topk, "SEED_QUERIES", 3)
    monkeypatch.setattr(topk, "FOLDERS", 2)
    monkeypatch.setattr(topk, "SPREAD", 2)
    got = {}
    for r in topk.search(docs, docs.where("doc_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.doc_id)
    assert got == {q: d for q, d in plain_search(rows, topk.K).items() if d}


def test_topk_odd_input(odd, empty):
    got = topk.search(odd, odd.where("doc_id % 50 = 0")).collect()
    assert {r.query_id for r in got} == {100} and got
    assert topk.search(empty, empty).count() == 0


# -- the pipeline -------------------------------------------------------------------------


def plain_shingles(text):
    """Five-word shingles; of fewer words the whole."""
    w = text.translate(brute_katz.LOWER).encode().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()


def test_stages_keep_columns_of_any_name_and_rows_without_ids(spark):
    """Names that the stages use themselves, null and repeated ids, repeated rows: every stage decides by row."""
    texts = distinct_texts(6, 21)
    rows = [(1, texts[0]), (None, texts[1]), (None, texts[2]), (7, texts[3]), (7, texts[4]), (None, texts[1]), (2, texts[0].upper()), (None, None), (9, "")]
    names = ("_row", "_ROW_", "_kept_id", "_copies", "_copies_", "_mix_id", "_mix_row", "_text_sha", "_sha", "row", "digest", "node", "component", "id", "_id", "hash", "y0", "batch", "kept", "first", "n", "fp")
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("source", F.lit("a")).withColumns({n: F.concat(F.lit(f"{n}:"), F.coalesce("text", F.lit("-"))) for n in names})
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id bigint, quality int, toxic int")

    def check(out, kept):
        assert out.columns == docs.columns
        got = out.collect()
        assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted(kept, key=repr)
        assert all(r[n] == f"{n}:{'-' if r.text is None else r.text}" for r in got for n in names)

    check(toxicity.keep_documents(docs, labels), rows)
    exact = [(2, texts[0].upper()), (None, texts[1]), (None, texts[2]), (7, texts[3]), (7, texts[4]), (9, "")]
    check(exact_dedup.keep_documents(docs), exact)
    near = [(1, texts[0]), (None, texts[1]), (None, texts[2]), (7, texts[3]), (7, texts[4]), (9, "")]
    check(simhash.keep_documents(docs), near)
    out = mixing.repeat_documents(docs)
    assert out.columns == docs.columns and {(r.doc_id, r.text) for r in out.collect()} <= set(rows)
    for stage in (lambda d: toxicity.keep_documents(d, labels), exact_dedup.keep_documents, simhash.keep_documents, mixing.repeat_documents):
        assert stage(docs.limit(0)).count() == 0


def test_pipeline_against_brute_force(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rejected = {r.doc_id for r in toxicity.score(docs, labels).where("rejected").collect()}
    left = {r.doc_id: r.text for r in docs.collect() if r.doc_id not in rejected}
    best = {}
    for i, t in left.items():
        key = t.translate(brute_katz.LOWER)
        best[key] = max(i, best.get(key, i))
    left = {i: left[i] for i in best.values()}
    fps = {i: plain_fingerprint(t) for i, t in left.items()}
    sets = {i: plain_shingles(t) for i, t in left.items()}
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) > 0
    groups = plain_components(fps, [(a, b) for a, b in itertools.combinations(fps, 2) if (fps[a] ^ fps[b]).bit_count() <= 4 or alike(a, b)])
    left = {i: left[i] for i in set(groups.values())}
    near = docs.where(F.col("doc_id").isin(list(fps)))
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, near, sf).collect()) == sorted(left)
    got = corpus_pipeline.run(spark, sf).collect()
    theirs = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    words = {i: len(t.split()) for i, t in left.items()}
    assert {r.doc_id for r in got} <= set(left) and max(np.bincount([r.doc_id for r in got])) <= 2
    assert abs(sum(words[r.doc_id] for r in got) - 1.5 * sum(words.values())) <= 20 * max(words.values())
    for r in got:
        assert r.n_tokens == len(theirs.encode(left[r.doc_id], add_special_tokens=False).ids)
