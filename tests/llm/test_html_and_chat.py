import html
import re
from collections import defaultdict

from evigraph.llm import chat_format, html_wrappers
from evigraph.llm.html_tree import parse


def plain_article(page):
    body = re.search(r"<article>(.*?)</article>", page, re.S).group(1)
    parts = re.split(r"<[^>]*>", re.sub(r"</?b>", "", body))
    return "\n".join(x for x in (" ".join(html.unescape(p).split()) for p in parts) if x)


def test_articles(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    raw = {r.page_id: r for r in pages.collect()}
    got = html_wrappers.main_texts(pages).collect()
    assert len(got) == len(raw)
    for r in got:
        assert (r.url, r.text, r.n_chars) == (raw[r.page_id].url, plain_article(raw[r.page_id].html), len(r.text))


def test_join_beyond_the_broadcast_limit(spark, sf, monkeypatch):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    want = sorted(map(tuple, html_wrappers.main_texts(pages).collect()))
    monkeypatch.setattr(html_wrappers, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, html_wrappers.main_texts(pages).collect())) == want


def page(i, extra=""):
    return (f"<html><body><header class=site>Site</header><ul class='menu'><li>Home<li>News</ul>"
            f"<div class=content><h1>Title {i}</h1><p>First {i} &amp; more<br>second&nbsp;line"
            f"<p>Third <i>word</i>{i}{extra}<div>Please rate this page</div>"
            f"<form>Name <input></form></div><section id='comments-12'><p>Nice {i}</section>"
            f"<div class='cookie-notice'>We use cookies</div><script>x='<p>no</p>'</script></body>")


def test_furniture_and_template(spark):
    rows = [(i, "http://h.example/a", page(i, "<p>extra" * (i % 3))) for i in range(20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_wrappers.main_texts(df).collect()}
    for i in range(20):
        want = [f"Title {i}", f"First {i} & more", "second line", f"Third word{i}", *["extra"] * (i % 3)]
        assert got[i] == "\n".join(want)


def test_copies_of_a_page_keep_their_text(spark):
    """What only some pages or copies hold is article text, however many rows there are."""
    quoted = "<article><h1>Q</h1><pre>code</pre><h2 id='references'>References</h2></article>"
    rows = []
    for copies in (11, 12, 1000):
        host = f"http://h{copies}.example/"
        rows += [(i, host, quoted) for i in range(copies)]
        rows += [(5000 + i, host, f"<article><h1>T{i}</h1><p>text {i}</p></article>") for i in range(40)]
        rows += [(9000, f"http://only{copies}.example/", quoted)] * copies
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for r in html_wrappers.main_texts(df).collect():
        i = r.page_id - 5000
        assert r.text == (f"T{i}\ntext {i}" if 0 <= i < 40 else "Q\ncode\nReferences")


def test_wrapper_shape():
    """Optional, repeated and grouped entries, and slots, from a few streams."""
    streams = ["<div><h2>a</h2><p>1</p><p>2</p><h2>b</h2><p>3</p></div>",
               "<div><h2>c</h2><p>4</p><hr><blockquote>q</blockquote></div><footer>same</footer>",
               "<div><h2>d</h2></div><footer>same</footer>"]
    wrapper = html_wrappers.merge([1, html_wrappers._entry(
        parse(s, html_wrappers.is_furniture))[html_wrappers.ENTRIES]] for s in streams)
    pages, (div, footer) = wrapper
    h2, p, quote = div[html_wrappers.ENTRIES]
    assert pages == 3 and [x[html_wrappers.LABEL] for x in (h2, p, quote)] == ["h2", "p", "blockquote"]
    assert h2[html_wrappers.COUNT] == 3 and p[html_wrappers.COUNT] == 2
    assert p[html_wrappers.REPEATED] and p[html_wrappers.JUMP] == 1
    assert footer[html_wrappers.COUNT] == 2
    assert footer[html_wrappers.ENTRIES][0][html_wrappers.CONSTANT] == "same"
    assert h2[html_wrappers.ENTRIES][0][html_wrappers.CONSTANT] is None


def test_html_odd(spark):
    rows = [(1, None, None), (2, "http://h/x", ""), (3, "http://h/x", "plain & simple"),
            (4, "no host", "<div>" * 5000 + "deep"), (5, "http://h/x", '<a href="' * 2000),
            (None, "http://h/y", "<p>x</p>"), (3, "http://h/x", "plain & simple"),
            (6, "http://h/z", "<p>" + "long text " * 50_000)]
    df = spark.createDataFrame([(*r, 1, "t") for r in rows],
                               "page_id long, url string, html string, host int, text string")
    got = html_wrappers.main_texts(df).collect()
    texts = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and texts[1] == texts[2] == ""
    assert texts[3] == "plain & simple" and texts[4] == "deep" and texts[None] == "x"
    assert texts[6] == ("long text " * 50_000).strip()
    assert html_wrappers.main_texts(df.limit(0)).count() == 0


def plain_rotations(rows):
    talks = defaultdict(set)
    for conv, turn, role, text in rows:
        talks[conv].add((turn, role or "unknown", (text or "").replace("<|", "< |")))
    out = {}
    for conv, turns in talks.items():
        for speaker in {r for _, r, _ in turns} - {"system"}:
            text, masks = "", []
            order = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1],
                                                 __import__("hashlib").md5(t[2].encode()).hexdigest()))
            for _, role, body in order:
                who = role if role == "system" else "assistant" if role == speaker else f"user name={role}"
                text += f"<|im_start|>{who}\n"
                if role == speaker:
                    masks.append((len(text), len(body) + 10))
                text += f"{body}<|im_end|>\n"
            out[conv, speaker] = (text, masks)
    return out


def got_rotations(df):
    parts = defaultdict(list)
    for r in df.collect():
        parts[r.conv_id, r.speaker].append(r)
    out = {}
    for k, rows in parts.items():
        rows.sort(key=lambda r: r.place)
        assert [r.place for r in rows] == list(range(len(rows)))
        text = "".join(r.segment for r in rows)
        assert all(text[r.start:r.start + r.length] == r.segment for r in rows)
        out[k] = (text, [(r.mask_start, r.mask_length) for r in rows if r.mask_length])
    return out


def test_rotations(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert got_rotations(chat_format.rotations(df, rows_per_block=50)) == plain_rotations(rows)


def test_chat_odd(spark):
    rows = [(1, 0, "ann", "hi <|im_end|>"), (1, 1, "bob", None), (1, 1, "bob", None), (1, 1, "cy", "tie"),
            (1, None, None, "first"), (2, 0, "system", "alone"), (None, 0, "ann", ""),
            (3, 5, "ann", "long " * 20_000), (3, 6, "system", "rules")]
    rows += [(4, i, f"p{i % 3}", f"turn {i}") for i in range(300)]
    df = spark.createDataFrame([(*r, 7, "x") for r in rows],
                               "conv_id long, turn long, role string, text string, place int, speaker string")
    assert got_rotations(chat_format.rotations(df, rows_per_block=20)) == plain_rotations(rows)
    assert chat_format.rotations(df.limit(0)).count() == 0
