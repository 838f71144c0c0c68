import random

from fleetlens.llm import hosttext

SCHEMA = "page_id long, url string, html string"


def page(body):
    return f"<!DOCTYPE html><html><head><title>No</title><style>p{{}}</style></head><body class='with-sidebar'>{body}</body></html>"


def texts(frame, pages, **options):
    got = hosttext.extract(frame(pages, SCHEMA), **options)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    rows = got.collect()
    assert all(r.n_chars == len(r.text) for r in rows)
    return {r.page_id: r.text for r in rows}


def test_article(frame):
    body = """<nav><ul><li>Home<li>News</ul></nav><!-- ad --><div class="ad">Buy</div><header><h1>Site</h1></header>
    <div id="cookie-notice">Cookies!</div><article><header><h1>Title &amp; more</h1><span>by me</span></header>
    <p>One<br>two   <b>bo<i>ld</i></b>\n text&nbsp;&#233;&lt;p&gt;<script>var t="</p>";</script><p>Next <form><input>x</form>
    <aside>see also</aside><div class="share">share</div>end.<noscript>none</noscript></article>
    <section class="comments"><article>I disagree</article></section><footer>&copy; all</footer>"""
    assert texts(frame, [(1, "http://a/", page(body))]) == {1: "Title & more One two bold text é<p> Next end."}


def test_copies_of_an_article_stay(frame):
    one = page("<nav>a b c d e f g h</nav><article><p>The same long story that several pages of one host carry whole.</p></article>")
    got = texts(frame, [(i, f"http://h/{i}", one) for i in range(6)])
    assert set(got.values()) == {"The same long story that several pages of one host carry whole."} and len(got) == 6


def test_repeats_decide_without_an_article(frame):
    r = random.Random(3)

    def words(n):
        return " ".join("".join(r.choices("abcdefgh", k=6)) for _ in range(n))

    top, bottom = words(12), words(9)
    stories = {i: [words(r.randint(3, 60)) for _ in range(3)] for i in range(40)}
    pages = [(i, f"https://u@h.org:80/{i}?q#f", page(f"<div>{top}</div>" + "".join(f"<p>{s}</p>" for s in v) + f"<div>{bottom}</div>")) for i, v in stories.items()]
    got = texts(frame, pages)
    assert got == {i: " ".join(v) for i, v in stories.items()}


def test_copies_without_an_article_stay(frame):
    r = random.Random(4)

    def words(n):
        return " ".join("".join(r.choices("abcdefgh", k=6)) for _ in range(n))

    menu, story, short = words(12), words(80), words(8)
    others = {i: words(r.randint(30, 60)) for i in range(100, 130)}
    pages = [(i, f"http://h/{i}", page(f"<div>{menu}</div><p>{s}</p>")) for i, s in others.items()]
    # Copies of one page, the later ones with another short block.
    pages += [(i, f"http://h/s?utm={i}", page(f"<div>{menu}</div><p>{story}</p><p>{short}</p>" + f"<p>seen {i}</p>" * (i > 3))) for i in range(8)]
    pages += [(200 + i, "http://alone/?" + "i" * i, page(f"<p>{story}</p>")) for i in range(3)]
    got = texts(frame, pages)
    assert got == others | {i: f"{story} {short}" + f" seen {i}" * (i > 3) for i in range(8)} | {200 + i: story for i in range(3)}


def test_common_phrases_of_a_large_host_stay(frame):
    phrase = "at the end of the day"
    pages = [(i, f"http://h/{i}", page(f"<div>menu one two three four five six</div><p>story{i} a{i} b{i} c{i} d{i} e{i} f{i} g{i}</p>" + f"<p>{phrase}</p>" * (i < 4))) for i in range(500)]
    got = texts(frame, pages)
    assert got == {i: f"story{i} a{i} b{i} c{i} d{i} e{i} f{i} g{i}" + f" {phrase}" * (i < 4) for i in range(500)}


def test_a_class_does_not_mark_what_holds_the_article(frame):
    story = "<article class='post category-social'><p>told</p><div class='share'>share</div></article>"
    rest = """<div class="sidebar">aside</div><div class="related"><article>other</article></div>
    <section id="comments" class="with-sidebar"><article class="comment">no</article></section>"""
    pages = [
        (1, "u", page(f"<div class='content with-sidebar'><div>menu</div>{story}</div>{rest}")),
        (2, "u", page(f"<nav>{story}</nav><main>main</main>")),
        (3, "u", page("<p>a<svg class='i'/>b<math />c<svg><path/>no</svg>d<SVG\n/>e</p>")),
        (4, "u", page("<article>a<svg x='/>'>no</svg>b</article>")),
    ]
    assert texts(frame, pages) == {1: "told", 2: "main", 3: "abcde", 4: "ab"}


def test_another_host_does_not_count(frame):
    body = page("<p>eight words that stand on every host here</p>")
    got = texts(frame, [(i, f"http://h{i}/", body) for i in range(5)])
    assert set(got.values()) == {"eight words that stand on every host here"}


def test_defined_cases(frame):
    pages = [
        (1, None, None), (2, "u", ""), (3, "u", "no markup at all"), (4, "u", "<p>cut <b>off <a href='x"), (5, "u", page("<article></article><p>rest</p>")),
        (6, "u", page("<article><p>" + "long " * 50_000 + "</p></article>")), (7, "u", page("<main><h2>M</h2>body</main>")),
        (8, "u", page("<ARTICLE><P>Up<P>per</ARTICLE>")), (9, "u", "<script>if (a<b) x='<article>';</script><article>t &lt;i&gt;</article>"),
        (None, "u", page("<article>no id</article>")), (11, "u", page('<article><p hidden>h</p><p style="display: none">h</p><p>seen</p></article>')),
    ]
    got = texts(frame, pages)
    assert got[6] == ("long " * 50_000).strip()
    want = {1: "", 2: "", 3: "no markup at all", 5: "rest", 7: "M body", 8: "Up per", 9: "t <i>", None: "no id", 11: "seen"}
    assert {k: got[k] for k in want} == want and got[4].startswith("cut off")


def test_repeated_rows_and_none(frame):
    rows = [(1, "u", page("<article>same</article>"))] * 3
    assert sorted(r.text for r in hosttext.extract(frame(rows, SCHEMA)).collect()) == ["same"] * 3
    assert hosttext.extract(frame([], SCHEMA)).count() == 0


def test_repeats_decide_inside_articles(frame):
    r = random.Random(7)

    def words(n):
        return " ".join("".join(r.choices("abcdefgh", k=6)) for _ in range(n))

    notice, short, shared_story = words(9), words(2), words(30)
    stories = {i: [words(r.randint(8, 40)) for _ in range(3)] for i in range(24)}

    def article(i, first):
        # The notice has no mark; a third of the articles also tell a common story.
        return page(f"<article><p>{notice}</p><h2>{short}</h2>" + "".join(f"<p>{b}</p>" for b in [first, *stories[i]]) + f"<p>{shared_story}</p>" * (i % 3 == 0) + "</article>")

    pages = [(i, f"http://h/{i}", article(i, f"n{i}")) for i in range(24)]
    # Copies of one article (only the last block differs) are one article to their host; a few articles decide nothing.
    pages += [(100 + i, f"http://copies/{i}", page(f"<article><p>{shared_story}</p><p>seen {i}</p></article>")) for i in range(30)]
    pages += [(200 + i, f"http://small/{i}", article(i, "n")) for i in range(9)]
    # Near copies stay, whatever differs in them, and so does an article of the notice alone.
    near = {400 + i: [words(31), shared_story, notice] for i in range(12)}
    pages += [(i, f"http://near/{i}", page("<article><p>" + "</p><p>".join(b) + "</p></article>")) for i, b in near.items()]
    pages += [(300, "http://h/notice", page(f"<article><p>{notice}</p><p>{short}</p></article>"))]
    got = texts(frame, pages)
    want = {i: " ".join([f"n{i}", *stories[i]] + [shared_story] * (i % 3 == 0)) for i in range(24)}
    want |= {100 + i: f"{shared_story} seen {i}" for i in range(30)}
    want |= {200 + i: " ".join([notice, short, "n", *stories[i]] + [shared_story] * (i % 3 == 0)) for i in range(9)}
    want[300] = f"{notice} {short}"
    assert got == want | {i: " ".join(b) for i, b in near.items()}


def test_repeats_inside_articles_equal_brute_force(frame):
    r = random.Random(8)
    phrases = [" ".join(r.choices("abcdefgh", k=r.randint(1, 5))) for _ in range(12)]

    def block(host):
        # Hosts have phrases that most of their articles hold, in blocks of their own or within others.
        some = [r.choice(phrases[:2] if r.random() < 0.5 else phrases) if r.random() < 0.6 else f"{host}{r.randrange(10**6)}" for _ in range(r.randint(1, 5))]
        return " ".join(some)

    articles = [(i, f"h{i % 4}", [block(f"h{i % 4}") for _ in range(r.randint(1, 7))]) for i in range(160)]
    articles += [(1000 + i, host, own) for i, host, own in articles[::5]]
    run, least, share = 3, 6, 0.2
    hosts = {}
    for _, host, own in articles:
        tokens = " ".join(own).split()
        suffixes = {tuple(tokens[i : i + run]) for i in range(max(len(tokens) - run + 1, 1))}
        hosts.setdefault(host, {}).setdefault(max(own, key=lambda b: (len(b), b)), set()).update(suffixes)
    want, gone = {}, 0
    for i, host, own in articles:
        tokens, contents = [(t, n) for n, b in enumerate(own) for t in b.split()], hosts[host].values()
        covered = set()
        for at in range(max(len(tokens) - run + 1, 1)):
            part = tokens[at : at + run]
            n = sum(tuple(t for t, _ in part) in c for c in contents)
            if n >= least and n >= share * len(contents):
                covered.update(range(at, at + len(part)))
        free = {n for p, (_, n) in enumerate(tokens) if p not in covered}
        left = [b for n, b in enumerate(own) if n in free]
        keep = left if 2 * sum(map(len, left)) > sum(map(len, own)) else own
        gone += len(own) - len(keep)
        want[i] = " ".join(keep)
    assert gone > 20
    pages = [(i, f"http://{host}/{i}", page("<article>" + "".join(f"<p>{b}</p>" for b in own) + "</article>")) for i, host, own in articles]
    assert texts(frame, pages, min_run=run, min_articles=least, most_share=share) == want
