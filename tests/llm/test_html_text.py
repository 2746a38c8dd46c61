import time

import pytest

from rivulet.llm import html_text

LONG = "The words of this text are long enough and it is with the usual small words that it goes on for a while."


@pytest.mark.parametrize(
    "page,text",
    [
        ("", ""),
        ("plain words only", "plain words only"),
        (f"<body><nav><ul><li><a href='/'>Home</a></li></ul></nav><div class='ad'>Buy it now.</div><article><h1>T &amp;amp; x</h1><p>{LONG}</p><p>Short&nbsp;&#233;.\n ok</p></article><footer>&copy; me</footer>", f"T &amp; x\n{LONG}\nShort é. ok"),
        (f"<article><p><b>Title.<br><p>{LONG}</p><div class='ad'>Buy!</div><p>So.</p></article>", f"Title.\n{LONG}\nSo."),
        (f"<div><p>{LONG}</p><p>Then <b>so</b>me.</p></div><div id=comments><p>{LONG}</p></div>", f"{LONG}\nThen some."),
        (f"<script>var t='</p>';</script><style>p{{}}</style><p>{LONG}</p><!-- <p>no</p> -->", LONG),
        (f"<body class='has-sidebar'><main><p>{LONG}</p></main><aside>{LONG}</aside><form><p>{LONG}</p></form></body>", LONG),
        (f"<p>{LONG}<p hidden>{LONG}</p><div style='display: none'>{LONG}</div>", LONG),
        (f"<p>a &lt;b&gt; {LONG}</p>", f"a <b> {LONG}"),
        (f"<table><tr><td>{LONG}<td>x y</table>", f"{LONG}\nx y"),
        (f"<article><section class='comments'><article class='comment'><p>{LONG}</p></article></section><p>{LONG} End.</p></article>", f"{LONG} End."),
        (f"<article><p>{LONG}</p><p><a href='x'>Read more of this</a></p></article>", LONG),
        ("<nav>only</nav>", ""),
        ("<p>unclosed <a href='x", "unclosed <a href='x"),
        (f"<div class='post-share'><p>{LONG} {LONG}</p></div>", f"{LONG} {LONG}"),
        (f"<div><p>{LONG}</p><div class='post-share'>Share this: <a href='x'>one</a> <a href='y'>two</a></div><div class='share'><p>{LONG}</p></div></div>", LONG),
    ],
)
def test_pages(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize("page", ["<" * 200_000, "<a b=\"" * 50_000, "<div>" * 100_000, "<!--" * 50_000, "<p>x" * 100_000, "<script>" * 20_000])
def test_broken_pages_take_linear_time(page):
    start = time.time()
    html_text.main_text(page)
    assert time.time() - start < 20


def test_table(spark):
    pages = spark.createDataFrame([(1, "u", None, "z"), (2, None, f"<p>{LONG}</p>", "z"), (2, None, f"<p>{LONG}</p>", "z")], "page_id long, url string, html string, text string")
    out = html_text.extract(pages)
    assert sorted((r.page_id, r.text, r.n_chars) for r in out.collect()) == [(1, "", 0), (2, LONG, len(LONG)), (2, LONG, len(LONG))]
    assert html_text.extract(pages.limit(0)).count() == 0


# Prose of several scripts and languages, none of them among the stop words' languages.
PROSE = {
    "ru": ["Вчера вечером жители города собрались на главной площади, чтобы обсудить новый план строительства моста.", "По словам мэра, работы начнутся весной и продлятся около двух лет, если не помешает погода."],
    "it": ["Ieri sera gli abitanti della città sono scesi nella piazza principale perché volevano discutere il nuovo ponte.", "Secondo il sindaco i lavori cominceranno in primavera e dureranno circa due anni."],
    "pl": ["Wczoraj wieczorem mieszkańcy miasta zebrali się na rynku, aby omówić nowy projekt budowy mostu przez rzekę.", "Zdaniem burmistrza prace rozpoczną się wiosną i potrwają około dwóch lat, jeśli pogoda pozwoli."],
    "zh": ["昨天晚上，市民们聚集在中心广场，讨论新桥的建设计划，许多人对工程的费用表示担心，也有人支持这个计划。", "市长说，工程将于春季开始，如果天气允许，大约需要两年时间才能完成，届时交通会更加方便。"],
    "ar": ["تجمع سكان المدينة مساء أمس في الساحة الرئيسية لمناقشة الخطة الجديدة لبناء الجسر فوق النهر.", "وقال رئيس البلدية إن الأعمال ستبدأ في الربيع وستستمر نحو عامين إذا سمح الطقس بذلك."],
    "hi": ["कल शाम शहर के निवासी नए पुल के निर्माण की योजना पर चर्चा करने के लिए मुख्य चौक पर इकट्ठा हुए।", "महापौर के अनुसार काम वसंत में शुरू होगा और मौसम ने साथ दिया तो लगभग दो साल चलेगा।"],
}


@pytest.mark.parametrize("lang", sorted(PROSE))
def test_any_language(lang):
    a, b = PROSE[lang]
    menu = "<nav><a href='/'>Home</a> <a href='/n'>News</a></nav>"
    foot = "<footer>Example Ltd. 1 Street, Town.</footer>"
    links = "<div>" + " ".join(f"<a href='/{i}'>{x}</a>" for i, x in enumerate((a + b).split())) + "</div>"
    assert html_text.main_text(f"<body>{menu}<div><p>{a}</p><p>{b}</p></div>{foot}</body>") == f"{a}\n{b}"
    assert html_text.main_text(f"<body>{menu}<div><h2>{a[:20]}</h2><p>{a}</p><p>{b}</p></div>{links}{foot}</body>") == f"{a[:20]}\n{a}\n{b}"
    assert html_text.main_text(f"<body>{menu}<div class='sidebar'><p>{a}</p></div><div><p>{b}</p></div></body>") == b


def test_a_list_of_words_is_not_prose():
    notice = "Copyright 2024 Example Incorporated. Privacy Policy. Service Terms. Contact Us. Imprint."
    assert html_text.main_text(f"<div>{notice}</div><nav>Start</nav><div><p>{LONG}</p></div>") == LONG
    words = " ".join(f"stichwort{i}" for i in range(30))
    assert html_text.main_text(f"<main><p>{LONG}</p></main><div>{words}</div>") == LONG
    assert html_text.main_text(f"<nav>Start</nav><div>{words}</div><nav>Ende</nav><div><p>{LONG}</p></div>") == LONG


@pytest.mark.parametrize("piece", ["<a b=\"", "<a b='\">", "<a '\">", "<a \"'", "<title>", "<b x='>", "<!-- ", "<![CDATA[ ", "&amp", "<p <p ", "</p", "<a href=x "])
def test_hostile_pages_take_linear_time(piece):
    for end in ("", ">", "'>", "\">"):
        start = time.time()
        html_text.main_text(piece * 60_000 + end)
        assert time.time() - start < 10


TWO = f"<h1>Head</h1><p>{LONG}</p><p>Then {LONG}</p>"
READ = f"Head\n{LONG}\nThen {LONG}"


@pytest.mark.parametrize("around", ['<form id="aspnetForm">{}</form>', '<div class="content-with-sidebar">{}</div>', '<div class="layout-sidebar">{}</div>', '<div class="page-widget">{}</div>', '<div class="page modal">{}</div>', '<form><div class="sidebar-layout"><section class="overlay">{}</section></div></form>'])
def test_what_wraps_the_whole_page_is_no_boilerplate(around):
    menu, foot = "<nav><a href='/'>Home</a></nav>", "<footer>Example Ltd.</footer>"
    assert html_text.main_text(f"<body>{menu}{around.format(TWO)}{foot}</body>") == READ
    assert html_text.main_text("<body>" + around.format(menu + TWO + foot) + "</body>") == READ
    # inside, marks go on to count
    assert html_text.main_text("<body>" + around.format(f"{TWO}<div class='sidebar'><p>{LONG}</p></div><form><p>{LONG}</p></form>") + "</body>") == READ


def test_marked_containers_beside_the_text_stay_boilerplate():
    for mark in ("sidebar", "page-widget", "cookie-notice", "sidebar-left", "ad-slot"):
        assert html_text.main_text(f"<body><div class='{mark}'><p>{LONG}</p><p>{LONG}</p></div><div>{TWO}</div></body>") == READ
    assert html_text.main_text(f"<div class='cookie-notice'><p>{LONG}</p></div>") == ""
    # comments are never the text, however much of the page they are
    assert html_text.main_text(f"<div><p>{LONG}</p></div><div class='comments'>" + f"<p>{LONG}</p>" * 30 + "</div>") == LONG
    assert html_text.main_text(f"<div style='display:none'>{TWO}</div>") == ""


def test_names_of_paragraphs():
    page = f"<article><p class='ad-free'>{LONG}</p><p class='share-price'>Up.</p><p class='no-share'>Down.</p><p class='post ad'>{LONG}</p></article>"
    assert html_text.main_text(page) == f"{LONG}\nUp.\nDown."


def test_a_teaser_is_not_the_article():
    teaser = f"<article><h3>Also</h3><p>{LONG}</p></article>"
    long = "".join(f"<p>{i}. {LONG}</p>" for i in range(6))
    read = "\n".join(f"{i}. {LONG}" for i in range(6))
    assert read in html_text.main_text(f"<body><div>{long}</div>{teaser}</body>")
    assert html_text.main_text(f"<body><article>{long}</article><div><p>{LONG}</p></div></body>") == read


def by_the_rules(found):
    """The two passes, read plainly: (structural, link share, content by words) per block, nearest decided neighbours."""
    labels = []
    for b in found:
        n = max(1, len(b.text.replace(" ", "")))
        words = [w for w in html_text._WORD.findall(b.text.lower())]
        if b.structural == 2 or b.linked > 0.5 * n:
            labels.append(-1)
        elif len(b.text) >= 70 and words:
            known = sum(w in html_text.STOP_WORDS for w in words) >= 0.08 * len(words)
            sentences = len(html_text._SENTENCE.findall(b.text))
            labels.append(1 if known or (b.linked <= 0.2 * n and sentences and len(words) >= 5 * sentences) else 0)
        else:
            labels.append(0)
    out = []
    for i, own in enumerate(labels):
        if own == 0:
            near = [j for j in range(len(labels)) if labels[j]]
            least = min((abs(i - j) for j in near), default=None)
            at = [j for j in near if abs(i - j) == least and all(not labels[k] for k in range(min(i, j) + 1, max(i, j)))]
            same = [j for j in at if found[j].container == found[i].container]
            at = same if same and len(same) < len(at) else at
            kinds = {labels[j] for j in at}
            own = 1 if not near else kinds.pop() if len(kinds) == 1 else 1 if found[i].tag in html_text.HEADINGS else -1
        out.append(own)
    return out


def test_random_pages_against_a_plain_reading():
    import random

    rng = random.Random(4)
    for _ in range(300):
        parts = []
        for _ in range(rng.randint(1, 14)):
            kind = rng.choice(["p", "p", "short", "links", "nav", "head", "div", "long"])
            parts.append({"p": f"<p>{LONG}</p>", "short": "<p>So it is.</p>", "links": "<p><a href='x'>Go there</a> now</p>", "nav": f"<nav>{LONG}</nav>", "head": "<h2>Head of it</h2>", "div": f"<div><p>Few words</p><p>{LONG}</p></div>", "long": "<p>" + "wort " * 30 + "</p>"}[kind])
        found = html_text.blocks(html_text.markup("".join(parts)))
        html_text.classify(found)
        assert [b.label for b in found] == by_the_rules(found)
