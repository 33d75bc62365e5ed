"""Packages, wrappers and packing: exact round trips and hand-made cases."""

import base64
import hashlib
import random
import zipfile
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from passageworks.llm import archives, packing, wrappers
from passageworks.llm.files import Ranges

P = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

PATH = P.path("word_bpe_49k.json")


def shown(rows):
    return sorted(str(tuple(r)) for r in rows)


@pytest.fixture(scope="module")
def pages(spark):
    r = random.Random(1)
    rows = [(i, f"http://h{i % 3}.org/{i}", "".join(r.choice("<p>abc é") for _ in range(r.randint(0, 3000)))) for i in range(60)]
    rows += [(105, "u\r\n é", "<p>x"), (103, "u", "<p>x"), (None, None, "<p>x"), (107, "u", None), (108, "u", ""), (109, "u", "é"), (109, "u", "é"), (None, "a", "only")]
    return rows, spark.createDataFrame([(*x, "k") for x in rows], "page_id long, url string, html string, digest string").repartition(3)


@pytest.mark.parametrize("least", [0, 5])
def test_packages_round_trip(pages, least):
    rows, df = pages
    first = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= least:
            first[h or ""] = min(i, first.get(h or "", i))
    want = []
    for i, u, h in rows:
        data = (h or "").encode()
        refers = first.get(h or "") if first.get(h or "") != i else None
        want.append((i, u, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if refers is None else "revisit", refers, (h or "") if refers is None else None))
    got = archives.round_trip(df, revisit_from=least, package_bytes=9000)
    assert shown(want) == shown(got.collect())
    assert archives.round_trip(df.limit(0)).count() == 0


def test_directories_with_zip64_fields_and_compressed_members(tmp_path):
    plain, wide = tmp_path / "a.zip", tmp_path / "b.zip"
    for path, big in ((plain, False), (wide, True)):
        with zipfile.ZipFile(path, "w") as z:
            for name in ("one", "two"):
                with z.open(zipfile.ZipInfo(name), "w", force_zip64=big) as f:
                    f.write(name.encode() * 3)
            z.comment = b"PK note"
        file = Ranges(str(path))
        found = archives.directory(file)
        assert [file.read(*archives.stored_member(file, found[n])) for n in ("one", "two")] == [b"oneoneone", b"twotwotwo"]
    # Sizes and counts that only the ZIP64 records hold.
    data = bytearray(plain.read_bytes())
    end = data.rfind(b"PK\x05\x06")
    size, start = np.frombuffer(bytes(data[end + 12 : end + 20]), "<u4").tolist()
    record = b"PK\x06\x06" + (44).to_bytes(8, "little") + bytes(12) + b"".join(x.to_bytes(8, "little") for x in (2, 2, size, start))
    locator = b"PK\x06\x07" + bytes(4) + end.to_bytes(8, "little") + (1).to_bytes(4, "little")
    data[end + 8 : end + 20] = b"\xff" * 12
    plain.write_bytes(bytes(data[:end]) + record + locator + bytes(data[end:]))
    file = Ranges(str(plain))
    assert file.read(*archives.stored_member(file, archives.directory(file)["two"])) == b"twotwotwo"
    with zipfile.ZipFile(tmp_path / "c.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("one", "x" * 100)
    file = Ranges(str(tmp_path / "c.zip"))
    with pytest.raises(ValueError, match="compressed"):
        archives.stored_member(file, archives.directory(file)["one"])
    (tmp_path / "d").write_bytes(b"no zip")
    with pytest.raises(ValueError, match="end of central"):
        archives.directory(Ranges(str(tmp_path / "d")))


PAGE = """<!DOCTYPE html><html><head><title>x</title></head><body class="no-sidebar"><header><h1>Site</h1></header>
<nav><ul><li>a<li>b</ul></nav><div id="cookie-notice">We use cookies</div><div class="post-content"><h2>A &amp; B&nbsp; c</h2>
<p>One <b>bold</b> &lt;tag&gt; x<br>y<p>Two<ul><li>l1</li><li>l2</li></ul><div class="ad">Buy</div><h2>Q</h2><p>z</p><h2>R</h2><p>w</p></div>
<script>var t="</p>";</script><!-- <p>no</p> --><div class="comments"><p>nice!</p></div><form>Email</form><footer>f"""
TEXT = "A & B c\nOne bold <tag> x y\nTwo\nl1\nl2\nQ\nz\nR\nw"


def test_main_text(spark):
    rows = [
        (1, "http://x.y/z", PAGE), (2, None, None), (3, "", "plain text only"), (4, "http://x.y/q", "<div>" * 3000 + "deep"),
        (5, "http://q/", "<p>1 < 2 &am <a href='"), (1, "http://x.y/z", PAGE),
        (6, "http://x.y/r", "<article class='post comments-open'><h1>T</h1><p>p</p><aside>s</aside><footer>by</footer></article><p>out</p>"),
        (7, "http://x.y/s", "<article>" + "".join(f"<p>{i}</p>" for i in range(2000)) + "</article>"), (None, "u", "<main>m<p>n</main>"),
    ]
    # A line that all pages of a host have is no text where there is no article.
    rows += [(10 + i, "http://same.org/a", f"<div>Welcome to all</div><p>some text {i}</p><ul><li><a href=x>more {i}</a></ul>") for i in range(4)]
    df = spark.createDataFrame([(*x, 1) for x in rows], "page_id long, url string, html string, host int").repartition(3)
    got = defaultdict(list)
    for x in wrappers.extract(df).collect():
        got[x.page_id].append(x.text)
        assert x.n_chars == len(x.text)
    assert got[1] == [TEXT, TEXT] and got[2] == [""] and got[3] == ["plain text only"] and got[4] == ["deep"]
    assert got[5] == ["1 < 2 &am"] and got[6] == ["T\np"] and got[7] == ["\n".join(map(str, range(2000)))] and got[None] == ["m\nn"]
    assert [got[10 + i] for i in range(4)] == [[f"some text {i}"] for i in range(4)]
    assert wrappers.extract(df.limit(0)).count() == 0


def test_wrappers_fold_repeats_and_mark_what_is_missing():
    one, _ = wrappers.parse("<body><h1>a</h1><p>x</p><p>y</p></body>")
    two, _ = wrappers.parse("<body><h1>a</h1><div>n</div><p>x</p></body>")
    wrappers.merge(one, two)
    body = one.kids[0]
    assert [(k.label, k.many, k.maybe) for k in body.kids] == [("h1", False, False), ("div", False, True), ("p", True, False)]
    pairs, _ = wrappers.parse("<dl><dt>a<dd>b<dt>c<dd>d<dt>e<dd>f</dl>")
    assert [(k.label, k.many) for k in pairs.kids[0].kids] == [("dt", True), ("dd", True)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(), min_size=1, max_size=4))
def test_ids_are_those_of_the_whole_text(texts):
    encoder, whole = _encoder(), _encoder().tokenizer
    ids, counts = encoder.encode(pa.array(texts, pa.string()))
    ends = np.cumsum(counts)
    for text, n, end in zip(texts, counts, ends):
        assert ids[end - n : end].tolist() == whole.encode(text, add_special_tokens=False).ids


_held = []


def _encoder():
    if not _held:
        _held.append(packing.Encoder(PATH))
    return _held[0]


def test_a_worker_remembers_a_bounded_number_of_words(monkeypatch):
    monkeypatch.setattr(packing, "MEMORY_WORDS", 40)
    r, encoder = random.Random(3), packing.Encoder(PATH)
    letters = "abcdeßÉÞžŸĲŉǅȺ"
    for i in range(6):
        words = ["the", "Été,", "x1", "İx", "ſt", "y" * 3_000, *("".join(r.choices(letters, k=5)) + r.choice(["", ".", "7"]) for _ in range(200))]
        text = " ".join(words)
        ids, counts = encoder.encode(pa.array([text, "", text]))
        assert ids.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids * 2 and counts[1] == 0
        assert max(len(encoder.known), len(encoder.parts)) <= 40
        assert max(map(len, [*encoder.known, *encoder.parts])) <= packing.REMEMBERED
        assert i < 1 or "the" in encoder.parts


def test_words_are_looked_up_over_more_than_is_written_at_once(monkeypatch):
    monkeypatch.setattr(packing, "MEMORY_WORDS", 0)
    encoder, r, asked = packing.Encoder(PATH), random.Random(4), []
    monkeypatch.setitem(packing._encoders, PATH, encoder)
    part = encoder._part
    monkeypatch.setattr(encoder, "_part", lambda p: asked.append(p) or part(p))
    words = ["".join(r.choices("abcdeéß", k=8)) + r.choice(["", "!", "7"]) for _ in range(55_000)]
    texts = [" ".join(words), "", " ".join(words[::-1]), "İ it's 12", " ".join(words[:9])]
    batch = pa.RecordBatch.from_pydict({"doc_id": [3, 1, None, 1, 2], "text": texts})
    out = list(packing._tokenize(PATH, 1)(iter([batch])))
    assert len(out) > 1 and len(asked) == len(set(asked)) and not encoder.parts
    rows = [x for b in out for x in b.to_pylist()]
    assert [x["doc_id"] for x in rows] == [3, 1, None, 1, 2]
    for x, text in zip(rows, texts):
        ids = encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(x["ids"], "<u2").tolist() == [*ids, 1] and x["n"] == len(ids) + 1
        assert x["key"] == packing.curve_keys(np.array(ids, np.uint32), np.array([len(ids)]))[0]


def test_packing(spark):
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(["alpha", "Beta,", "don't", "x1y2", "naïve."]) for _ in range(r.choice([3, 90, 4000])))) for i in range(60)]
    rows += [(500, None), (None, ""), (None, "a b"), (501, "dup dup"), (501, "dup dup"), (502, "x́ Å ΟΔΥΣΣΕΥΣ b\x1cc it's <|endoftext|>\r\n\t 12")]
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, key int").repartition(3)
    got = packing.pack(docs, PATH, limit=256).collect()
    whole = Tokenizer.from_file(PATH)
    want = sorted(str((i, [*whole.encode(t or "", add_special_tokens=False).ids, 1])) for i, t in rows)
    by_sequence = defaultdict(list)
    for x in got:
        by_sequence[x.sequence_id].append(x)
        assert zlib.crc32(np.array(x.ids, "<u4").tobytes()) == x.ids_crc32 and len(x.ids) == x.length
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    stream = []
    for number in sorted(by_sequence):
        at = 0
        for x in sorted(by_sequence[number], key=lambda x: x.offset):
            assert x.offset == at
            at += x.length
            stream.append(x)
        assert at == 256 or at & (at - 1) == 0
    texts, held = [], []
    for x in stream:
        assert x.start == len(held)
        held += x.ids
        if len(held) == x.doc_tokens:
            texts.append(str((x.doc_id, held)))
            held = []
    assert not held and sorted(texts) == want
    assert packing.pack(docs.limit(0), PATH).count() == 0
    with pytest.raises(ValueError, match="power of two"):
        packing.pack(docs, PATH, limit=100)


def test_hilbert_keys_are_a_path_through_all_points():
    for n, bits in ((2, 3), (3, 2), (4, 2)):
        points = np.stack(np.meshgrid(*[np.arange(1 << bits)] * n), -1).reshape(-1, n)
        keys = packing.hilbert_keys(points, bits)
        assert sorted(keys) == list(range(len(points)))
        assert np.abs(np.diff(points[np.argsort(keys)], axis=0)).sum(1).max() == 1


def texts_of(spark, pages):
    rows = [(i, f"https://{host}/{i}", page) for i, (host, page) in enumerate(pages)]
    got = wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return [r.text for r in sorted(got, key=lambda r: r.page_id)]


def test_unclosed_elements_whose_inside_is_skipped():
    def of(page):
        return [t for _, t, _ in wrappers.parse(page)[1]]

    assert of("<head><title>x</title><body><article><p>words</p></article>") == ["words"]
    assert of("<html><head><style>a{}</style><p>one</p><script>s</script><p>two") == ["one", "two"]
    for tag in "object canvas noscript svg select iframe math template".split():
        assert of(f"<p>one</p><{tag}><p>two</p><{tag}><p>three</p>") == ["one", "two", "three"]
        assert of(f"<p>one</p><{tag}>in</{tag}><p>two</p>") == ["one", "two"]
    assert of("<p>one</p><script>var x = '<p>two</p>';") == of("<p>one</p><style><p>two</p>") == ["one"]


def test_end_tags_of_deep_elements_close_their_own():
    def of(page):
        root, blocks = wrappers.parse(page)
        paths = {id(node): wrappers.role(path) for node, path in wrappers.slots(root)}
        return [(t, paths[id(slot.final())]) for slot, t, _ in blocks]

    many = wrappers.DEPTH + 20
    deep = "<div>" * many + "<aside><p>ad</p></aside><p>in</p>" + "</div>" * many
    got = of(f"<div id=page><article><p>one</p>{deep}<p>two</p></article><p>behind</p></div>")
    assert got == [("one", "main"), ("ad", "aside"), ("in", "main"), ("two", "main"), ("behind", "open")]
    got = of("<div>" * many + "<article><p>a</p><nav>b</nav><p>c</p></article>d" + "</div>" * many + "e")
    assert got == [("a", "main"), ("b", "aside"), ("c", "main"), ("d", "open"), ("e", "open")]


def test_copies_of_a_page_do_not_make_its_text_constant(spark):
    page = "<body><div><p>all of it</p></div></body>"
    assert texts_of(spark, [("copies", page)] * 4) == ["all of it"] * 4
    # Its own optional block stays; what three different pages share goes.
    mixed = [("mixed", "<body><h2>menu</h2><p>same</p><table><td>own</td></table></body>")] * 4
    mixed += [("mixed", f"<body><h2>menu</h2><p>text {i}</p></body>") for i in range(3)]
    assert texts_of(spark, mixed) == ["same\nown"] * 4 + [f"text {i}" for i in range(3)]


def test_headings_named_after_their_text_stay(spark):
    """Ids made of heading texts, and class words of paragraphs, are no reason to drop them."""
    page = (
        "<body><div id='comments-nav'>menu</div><article class='post'><h1 id='notice-of-change'>Title {0}</h1>"
        "<h2 id='related-work'>Related work</h2><p class='legal'>Text {0}</p><section id='comment-on-forms'><h3 id='share'>Share</h3>"
        "<p>Of {0}</p></section><div class='related'>Also {0}</div></article><div class='footer'>end</div></body>"
    )
    rows = [(i, "http://h.example/%d" % i, page.format(f"n{i}")) for i in range(4)]
    got = {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Title n{i}\nRelated work\nText n{i}\nShare\nOf n{i}" for i in range(4)}
