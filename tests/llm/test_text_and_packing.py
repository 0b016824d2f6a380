"""HTML extraction, tokens, packing, token files and sampled pieces."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from millrace.llm import html_text, id_codec, packing, piece_sampling, queries, token_files
from millrace.llm.tokens import WordBpe
from tests.conftest import SF

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PARTS = [" ", "  ", "\n", " \n", "\t", "a", "the", "é", "1", "!", "　", "<|endoftext|>", "x y", "'s", "\x85", "中文", "\r\n", "▁", "<s>", "<0x41>", "\x00", "\U0001f600"]


def some_texts(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, 14))) for _ in range(n)]


def reference_ids(texts):
    return [x.ids for x in Tokenizer.from_file(BPE).encode_batch([x or "" for x in texts], add_special_tokens=False)]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<nav><ul><li><a href="/">Home</a></li></ul></nav><!-- <p>no</p> --><div class="ad">Buy now</div>
<article><header><h1>A &amp; B</h1></header><p><b>One  two<br>three.<p>F&ouml;ur</p><form><input> send</form><section id="comments"><p>First!</p></section></article>
<footer>&copy; x</footer>"""


def test_main_text_of_a_page():
    assert html_text.main_text(PAGE) == "A & B One two three. Föur"
    assert html_text.main_text(PAGE.replace("</article>", "")) == "A & B One two three. Föur"


def test_pages_without_landmarks_keep_the_long_stretch():
    page = f"<body><div id='menu'><a>Home</a> <a>About</a></div><div><h2>Head</h2><p>{'Some text here. ' * 20}</p><p>Short.</p></div><div class='sidebar'>Links and more links</div><p>tail</p></body>"
    assert html_text.main_text(page) == f"Head {'Some text here. ' * 20}Short."


def test_names_of_elements():
    story = "<p>" + "Words of the story. " * 12 + "</p>"
    page = f"""<body class="has-sidebar"><div id="main" class="with-sidebar ad-free"><div class="site-header">Site</div><article class="post"><div class="entry-header"><h1>Title</h1></div>{story}
    <div class="cookie-notice">Cookies!</div><div class="relatedPosts">More</div><div role="complementary">Aside</div><div hidden>Gone</div></article></div>"""
    assert html_text.main_text(page) == "Title " + ("Words of the story. " * 12).strip()


@pytest.mark.parametrize("first, last", [(600, 110), (1100, 210), (2000, 60)])
def test_short_stretches_beside_adverts_stay(first, last):
    page = f"<body><p>Lead</p><p>By A</p><p>May</p><p>{'a' * first}</p><div class='ad'>Buy</div><p>{'b' * last}</p></body>"
    assert html_text.main_text(page) == f"Lead By A May {'a' * first} {'b' * last}"


def test_pages_of_few_characters_stay():
    assert html_text.main_text("<body><nav>Home</nav><p>Only five and forty characters of text, here.</p></body>") == "Only five and forty characters of text, here."


@pytest.mark.parametrize(
    "inner, want",
    [
        ("<p>One.<p class='notice'>Skip<p>Two.<p>Three.", "One. Two. Three."), ("<ul><li>One.<li class='ad'>Skip <b>this</b><li>Two.</ul><p>Three.", "One. Two. Three."),
        ("<ul><li>One.<li class='ad'>Skip<ul><li>this</ul></ul><p>Two.", "One. Two."), ("<div>One.<div class='ad'><script>'</div></section>'</script>Skip<div>this</div></div>Two.</div>", "One. Two."),
        ("<section>One.<aside>Skip</section><p>Two.", "One. Two."), ("<nav><li>Skip</p><li>this</nav>One.", "One."),
    ],
)
def test_left_out_end_tags_end_what_is_skipped(inner, want):
    assert html_text.main_text(f"<body><article>{inner}</article><p>after</p></body>") == want


LONG = "Words of the story that go on for a while, as stories do. " * 3


@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_windows_decide_within_content_too(tag):
    """A run of mere links dives and parts the text; a single one amid text doesn't."""
    links = "".join(f"<p><a href=/x{k}/>More about {k}</a></p>" for k in range(5))
    page = f"<body><{tag}><p>{LONG}</p><p><a href='/s'>The source</a></p><p>{LONG}</p>{links}<p>{LONG}</p></{tag}></body>"
    assert html_text.main_text(page) == " ".join([LONG.strip(), "The source", LONG.strip(), LONG.strip()])


def test_long_text_outside_a_named_element_counts_if_it_surges():
    for n, want in ((1, False), (20, True)):
        page = f"<body><div><p>{'Outside text. ' * 4 * n}</p></div><article><p>{LONG}</p></article></body>"
        assert ("Outside" in html_text.main_text(page)) == want


@pytest.mark.parametrize("fragment", ["<p class='social-science'>A paper on society.</p>", "<div class='widget-review'>The widget works well.</div>", "<div id='ad-hoc-committee'>A committee met.</div>"])
@pytest.mark.parametrize("tag", ["article", "main"])
def test_names_that_only_hint_keep_text(tag, fragment):
    import re

    assert re.sub("<[^>]+>", "", fragment) in html_text.main_text(f"<body><{tag}><p>{LONG}</p>{fragment}<p>{LONG}</p></{tag}></body>")
    linked = re.sub(">([^<]+)<", r"><a href='/'>\1</a><", fragment, count=1)
    assert html_text.main_text(f"<body><{tag}><p>{LONG}</p>{linked}<p>{LONG}</p></{tag}></body>") == f"{LONG}{LONG}".strip()


@pytest.mark.parametrize("name", ["title", "iframe", "svg", "object", "noscript", "canvas"])
def test_elements_without_end_do_not_take_the_page_along(name):
    assert html_text.main_text(f"<body><{name}><article><p>{LONG}</p></article></body>") == LONG.strip()


def test_pages_of_another_style_equal_brute_force():
    """Pages without any content element: what was put in as text comes out, whatever furniture stands around it."""
    r = random.Random(8)
    furniture = [
        "<div class='top-bar'><a href='/'>Home</a><a href='/n'>News</a></div>", "<div id='sidebar'><h3>Popular</h3><p>Something else to read that is rather long, as teasers are.</p></div>",
        "<div class='cookie-notice'>We use cookies to make this site better for everyone who visits.</div>", "<ul class='menu'><li>One<li>Two</ul>", "<form><label>Mail</label><input></form>",
        "<div class=ad-slot>Buy this wonderful thing now, at half the price of last week's offer!</div>", "<script>var x = '<p>no</p>';</script>", "<div class='comments'><p>First! I disagree with all of it.</p></div>",
    ]
    for _ in range(60):
        want, page = [], ["<html><head><title>T</title></head><body><div class='page'>"]
        for _ in range(r.randint(1, 4)):
            page += r.choices(furniture, k=r.randint(0, 3))
            page.append("<div class='story-text'>")
            for _ in range(r.randint(1, 5)):
                text = " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(r.randint(15, 60)))
                want.append(text)
                page.append(r.choice(("<p>{}</p>", "<div>{}</div>", "<p>{}", "<blockquote><p>{}</p></blockquote>")).format(text.replace(" ", r.choice((" ", "\n  ", " <b></b>")))))
            page.append("</div>")
        page += [*r.choices(furniture, k=2), "</div></body></html>"]
        assert html_text.main_text("".join(page)) == " ".join(want)


def test_very_long_pages():
    page = "<article>" + "<p>Some text &amp; more.</p>" * 60_000 + "</article>"
    assert html_text.main_text(page) == " ".join(["Some text & more."] * 60_000)


@pytest.mark.parametrize("page", [None, "", "<p>", "<", "<script>x", "<nav>a", "&", "<p>x</p>" * 3, "<article></article>", "<a" * 500])
def test_odd_pages_do_not_fail(page):
    assert isinstance(html_text.main_text(page), str)


def test_page_rows(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "x"), (2, None, None, "x")], "page_id long, url string, html string, _html string")
    found = sorted(html_text.page_texts(pages).collect())
    assert [(r.page_id, r.text, r.n_chars) for r in found] == [(1, "A & B One two three. Föur", 25), (2, "", 0), (2, "", 0)]
    assert html_text.page_texts(pages.limit(0)).count() == 0


def test_articles_of_the_test_pages(spark):
    import html as h
    import re

    found = {r.page_id: r.text for r in queries.op3_html_extraction(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inner = re.search("<article>(.*?)</article>", r.html, re.S)[1]
        assert found[r.page_id] == " ".join(h.unescape(re.sub("<[^>]+>", lambda m: " " if m[0].strip("</>") in ("p", "h1", "br") else "", inner)).split())


@pytest.mark.parametrize("limit", [400, 20_000_000])
def test_word_cache_gives_the_library_s_ids(limit):
    r = random.Random(3)
    words = [" ".join("".join(r.choice("abcéßABſſĀ'’,.&-_1ðŁ") for _ in range(r.randint(1, 6))) for _ in range(60)) for _ in range(200)]
    texts = [*some_texts(1500), None, "y" * 300, "long " * 50, *words, *words, "a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>  c", "<|endoftext", "don't I'll we're, it's' O'x"]
    bpe = WordBpe(BPE, limit_bytes=limit)
    assert bpe.used <= limit + 1000
    assert [np.frombuffer(x, "<u4").tolist() for x in bpe.encode(texts)] == reference_ids(texts)


def test_best_fit_places():
    r, bins = random.Random(3), {}
    fit = packing.BestFit(100, 4)
    for size in [r.randint(1, 100) for _ in range(2000)]:
        at, offset = fit.place(size)
        assert bins.setdefault(at, 0) == offset
        bins[at] += size
        assert bins[at] <= 100 and fit.open <= 4
    assert sum(bins.values()) / (100 * len(bins)) > 0.85


def test_cuts():
    assert packing.cut(5, 4) == [(0, 1), (1, 4)] and packing.cut(8, 4) == [(0, 4), (4, 4)] and packing.cut(4, 4) == [(0, 4)] and packing.cut(1, 4) == [(0, 1)]


def test_packing_is_gapless_whole_and_tight(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(-1, None), (-2, ""), (-1, None), (None, "a")], "doc_id long, text string")
    docs = docs.select("doc_id", "text").union(extra)
    rows = packing.pack_documents(docs, BPE, capacity=256, open_bins=64, look_ahead=128, task_pieces=200).collect()
    ids = {}
    for i, x in zip(docs.collect(), reference_ids([r.text for r in docs.collect()]), strict=True):
        ids.setdefault(i.doc_id, []).append([*x, 0])
    assert sum(r.length for r in rows) == sum(len(x) for xs in ids.values() for x in xs)
    for r in rows:
        assert any(zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for x in ids[r.doc_id])
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in bins.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 256
    assert len(bins) <= 1.05 * sum(r.length for r in rows) / 256 + 2
    assert packing.pack_documents(docs.limit(0), BPE).count() == 0


def test_words_are_tokenised_once_whatever_marks_stand_by_them():
    bpe, calls = WordBpe(BPE), []

    class Model:
        def tokenize(self, x, f=bpe.model.tokenize):
            calls.append(x)
            return f(x)

    bpe.model = Model()
    texts = ["Go wordy, wordy. wordy wordy;\nWordy wordy!\nWordy, (wordy été, été.\nÉté", "wordy; wordy"]
    assert [np.frombuffer(x, "<u4").tolist() for x in bpe.encode(texts)] == reference_ids(texts)
    assert sum("ordy" in x for x in calls) == 2  # after a space, and after a line end


def test_ids_of_words_marks_and_line_ends_are_the_library_s(monkeypatch):
    r = random.Random(6)
    marks = [*PARTS, "word", "Été", "ſ", "Ŀa", "'re", "'", "...", ",", "(", ".\n", "\n\n", "\x1c", "\xa0", "٣", "ª"]
    texts = ["".join(r.choice(marks) for _ in range(r.randint(0, 30))) for _ in range(3000)]
    texts += [" ".join(r.choice(["word", "Été", "x"]) + r.choice(["", ",", ").", "\nWord", ".\nÉté;", "!\n", "\n\nx", "'s"]) for _ in range(200)) for _ in range(20)]
    expected = reference_ids(texts)
    for most in (4_000_000, 500, 7):  # long texts are cut between stretches
        monkeypatch.setattr("millrace.llm.tokens._AT_ONCE", most)
        bpe = WordBpe(BPE, limit_bytes=20_000)
        assert [np.frombuffer(x, "<u4").tolist() for x in bpe.encode(texts)] == expected


def test_codec_round_trips():
    r = np.random.default_rng(5)
    blocks = [r.integers(0, 1 << 16, 700), r.integers(0, 3, 500), np.tile(np.arange(9), 40), np.zeros(99, int), np.array([65535]), np.array([], int)]
    words = id_codec.encode(blocks)
    assert all(np.array_equal(a, b) for a, b in zip(blocks, id_codec.decode(words, [len(b) for b in blocks]), strict=True))
    assert len(words[2]) * 2 < 100  # a pattern of nine ids costs little
    alone = id_codec.encode([blocks[1]])
    assert np.array_equal(alone[0], words[1])  # blocks don't depend on their neighbours


def test_blocks_are_coded_in_few_steps_and_learn_from_all_their_lanes():
    assert id_codec._shape(token_files.BLOCK) == (256, 8192)
    r = np.random.default_rng(3)
    for n in (1, 2, 127, 128, 129, 383, 5000, 70_001):
        for ids in (r.integers(0, 1 << 16, n), r.zipf(1.3, n) % 50_000, np.where(r.random(n) < 0.002, r.integers(0, 1 << 16, n), 7)):
            assert np.array_equal(id_codec.decode(id_codec.encode([ids]), [n])[0], ids)
    ids = np.tile(r.permutation(50_000)[:5000], 40).astype("<u4")  # what comes again after 5000 ids
    data = token_files.to_segment([1], [ids.tobytes()])
    assert len(data) < len(ids) / 4
    assert np.array_equal(token_files.from_segment(data)[0][1], ids)


def test_ids_that_nothing_predicts_are_one_symbol():
    models = id_codec._Models(1)
    for held in ([], [np.array([7] * 900 + [65535])]):
        models.held = held
        models.renewed()
        assert len(models.sizes) == 1 << 16 and models.sizes.min() >= 1 and models.sizes.sum() <= 1 << 20
        assert np.array_equal(models.starts[1:], np.cumsum(models.sizes, dtype=np.float64)[:-1])
    assert models.sizes[7] > 900_000
    r = np.random.default_rng(8)
    ids = np.where(r.random(300_000) < 0.5, r.integers(0, 1 << 16, 300_000), r.zipf(1.2, 300_000) % 50_000)
    words = id_codec.encode([ids])
    assert np.array_equal(id_codec.decode(words, [len(ids)])[0], ids)


def test_segments_tell_damage():
    data = token_files.to_segment([1, None, 3], [np.arange(5, dtype="<u4").tobytes(), b"", np.full(300, 7, "<u4").tobytes()], block=64)
    assert [(d, len(x)) for d, x in token_files.from_segment(data)] == [(1, 5), (None, 0), (3, 300)]
    assert token_files.from_segment(token_files.to_segment([], [])) == []
    for k in range(len(data)):
        with pytest.raises(token_files.CorruptSegment):
            token_files.from_segment(data[:k] + bytes([data[k] ^ (1 << k % 8)]) + data[k + 1 :])
    for bad in (b"", b"nope" + data[4:], data[:-40], data[:10]):
        with pytest.raises(token_files.CorruptSegment):
            token_files.from_segment(bad)
    with pytest.raises(ValueError):
        token_files.to_segment([1], [np.array([1 << 16], "<u4").tobytes()])


def test_long_texts_are_coded_few_blocks_at_a_time(monkeypatch):
    monkeypatch.setattr(token_files, "LANES", 3)
    coded = []
    monkeypatch.setattr(id_codec, "encode", lambda blocks, f=id_codec.encode: coded.append(len(blocks)) or f(blocks))
    ids = np.random.default_rng(1).integers(0, 50_000, 1000).astype("<u4")
    data = token_files.to_segment([7, 8], [ids[:990].tobytes(), ids[990:].tobytes()], block=64)
    assert max(coded) == 3 and np.concatenate([x for _, x in token_files.from_segment(data)]).tolist() == ids.tolist()


def test_token_files_in_order(spark):
    rows = [(3, "a b"), (1, None), (2, "c " * 700), (3, "a b"), (None, "z")]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, part int")
    found = token_files.through_files(docs, BPE, end_id=2, segment_tokens=500).orderBy("start").collect()
    texts = {None: "z", 1: "", 2: "c " * 700, 3: "a b"}
    at = 0
    for r, key in zip(found, [None, 1, 2, 3, 3], strict=True):
        ids = [*reference_ids([texts[key]])[0], 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (key, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_files.through_files(docs.limit(0), BPE, end_id=2).count() == 0


def test_sampled_pieces_are_lossless_and_follow_the_key():
    s, texts = piece_sampling.PieceSampler(PIECES), [*some_texts(600, 2), None, "ab" * 4000]
    together = list(s.encode(range(len(texts)), texts, 5))
    small = piece_sampling.PieceSampler(PIECES, limit=50)
    for k, (text, ids) in enumerate(zip(texts, together, strict=True)):
        assert s.decode(ids) == (text or "")
        assert np.array_equal(next(small.encode([k], [text], 5)), ids)
    word = "internationalization of the representation " * 5
    drawn = {tuple(next(s.encode([k], [word], 0)).tolist()) for k in range(20)}
    assert len(drawn) > 10


def test_new_lattices_are_settled_together():
    """Running shares at every place of short and long units against a plain forward filter, scaled by logarithms."""
    import math

    s = piece_sampling.PieceSampler(PIECES)
    units = [" there", "internationalization", "日本", "q", "x" * 300, " ab" * 90]
    ends = [s._add(u) for u in units]
    assert len(s.edge_share) == 0 and s.nodes == sum(len(u) + 1 for u in units)
    s._settle()
    assert len(s.edge_start) == s.nodes and not s.new_weight
    start = [*s.edge_start, len(s.edge_share)]
    for unit, end in zip(units, ends, strict=True):
        text, base = unit.replace(" ", "▁"), end - len(unit)
        logs = [0.0]
        for j in range(1, len(text) + 1):
            into = [(logs[i] + math.log(s.ids[text[i:j]][1]), i, s.ids[text[i:j]][0]) for i in range(max(0, j - s.longest), j) if text[i:j] in s.ids]
            if text[j - 1] not in s.ids:
                raw = unit[j - 1].encode()
                into.append((logs[j - 1] + len(raw) * math.log(s.byte_weight), j - 1, None))
            most = max(w for w, _, _ in into)
            logs.append(most + math.log(sum(math.exp(w - most) for w, _, _ in into)))
            a, b = start[base + j], start[base + j + 1]
            assert [(i, p) for _, i, p in into] == [(x - base, p if p >= 0 else None) for x, p in zip(s.edge_from[a:b], s.edge_piece[a:b], strict=True)]
            shares = np.cumsum([math.exp(w - logs[j]) for w, _, _ in into])
            assert np.allclose(shares[:-1], s.edge_share[a : b - 1], rtol=1e-6) and s.edge_share[b - 1] == 2.0


def test_sampling_follows_the_lattice_s_weights():
    """Shares of drawn segmentations of a short word against all of them, listed."""
    from collections import Counter

    s = piece_sampling.PieceSampler(PIECES)

    def all_of(text):
        if not text:
            return [((), 1.0)]
        return [((i, *rest), w * p) for k in range(1, len(text) + 1) if (x := s.ids.get(text[:k])) for i, w in [x] for rest, p in all_of(text[k:])]

    want = dict(all_of("▁there"))
    whole = sum(want.values())
    drawn = Counter(tuple(x.tolist()) for x in s.encode(range(6000), ["there"] * 6000, 1))
    for ids, p in want.items():
        assert abs(drawn[ids] / 6000 - p / whole) < 0.03


def test_piece_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, None), (None, "x")], "doc_id long, text string")
    found = piece_sampling.round_trip(docs, PIECES).collect()
    assert all(r.lossless for r in found) and len({(r.n_pieces, r.ids_crc32) for r in found if r.doc_id == 1}) == 1
    encoded = piece_sampling.sampled_pieces(docs, PIECES)
    assert sorted(r.text for r in piece_sampling.decoded(encoded, PIECES).collect()) == ["", "a b", "a b", "x"]
    assert piece_sampling.round_trip(docs.limit(0), PIECES).count() == 0


def test_clashing_columns_of_packing_and_pieces(spark):
    rows = [(1, "a b", 1, 2, 3), (None, None, 1, 2, 3), (1, "a b", 9, 9, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece int, _id long, ids long")
    plain = docs.select("doc_id", "text")
    key = lambda r: tuple(str(x) for x in r)
    for made in (lambda d: packing.token_pieces(d, BPE, 8, 0), lambda d: piece_sampling.round_trip(d, PIECES)):
        assert sorted(made(docs).collect(), key=key) == sorted(made(plain).collect(), key=key)
