import numpy as np
import pyarrow.parquet as pq
import pytest

from growthpanel.llm import page_text

PARAGRAPHS = ["The first paragraph of the story, which is long enough to be read.", "The second one follows it, and tells a little more than the first.", "The third one ends the story, as third ones do, with a last word."]
STORY = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
FOOT = "<footer><p>&copy; someone</p></footer>"


@pytest.fixture(scope="module")
def trees():
    return page_text.learn([], layouts=200)


def blocks(html):
    return [t for _, t, _ in page_text.read_page(html).blocks]


@pytest.mark.parametrize(
    "html",
    [
        f"<html><head><title>t</title><meta charset=x><article>{STORY}</article>{FOOT}",
        f"<html><head><title>t</title><link rel=x href=y><div class=content><article>{STORY}</article></div>{FOOT}",
        f"<head><title>t<body><article>{STORY}</article>{FOOT}",
        f"<head><noscript><link href=x></head><body><article>{STORY}</article>{FOOT}",
        f"<head><noscript><style>p</style><body><article>{STORY}</article>{FOOT}",
    ],
)
def test_end_tags_that_may_be_left_out(trees, html):
    assert page_text.main_texts([html], trees) == ["\n\n".join(PARAGRAPHS)]


@pytest.mark.parametrize("tag", ["select", "svg", "iframe", "textarea", "datalist", "template", "canvas", "audio", "video"])
def test_unclosed_silent_elements_end(trees, tag):
    before = f"<html><body><div><{tag}>hidden</div><article>{STORY}</article>{FOOT}"
    assert page_text.main_texts([before], trees) == ["\n\n".join(PARAGRAPHS)]
    closed = f"<html><body><div><{tag}><div><i>hidden</i></div>hidden</{tag}></div><article>{STORY}</article>{FOOT}"
    assert page_text.main_texts([closed], trees) == ["\n\n".join(PARAGRAPHS)]
    if tag in ("select", "svg", "iframe", "textarea", "datalist"):
        inside = f"<article><p>{PARAGRAPHS[0]}<{tag}>hidden<p>{PARAGRAPHS[1]}</p><p>{PARAGRAPHS[2]}</p></article>"
        assert blocks(inside) == PARAGRAPHS


@pytest.mark.parametrize("tag", ["button", "noscript", "object", "math"])
def test_unclosed_ordinary_elements_keep_what_follows(tag):
    assert blocks(f"<article><{tag}>{STORY}</article>") == PARAGRAPHS
    assert blocks(f"<div><{tag}>x</div><article>{STORY}</article>") == ["x", *PARAGRAPHS]


def test_texts_of_elements_in_an_article_are_read():
    html = "<article><p>where <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p><noscript>shown without</noscript><object><p>instead</p></object><button>more</button></article>"
    assert blocks(html) == ["where x=2 holds", "shown without", "instead", "more"]


@pytest.mark.parametrize(
    "before",
    [
        "<!-- old <script> tag -->",
        '<a title="use <script> here"></a>',
        "<style-guide></style-guide>",
        "<script-loader></script-loader>",
        "<textarea><script></textarea>",
        "<textarea></title><!-- </textarea>",
        "<title><style></title>",
        "<!-- x --!>",
        "<!-->",
        "<!--->",
        "<script>if (a < b) { document.write('<p>no</p>') } // </style></script >",
        "<style>p > a { content: '<script>' }</style\n>",
        "<script/>var x = '<p>';</SCRIPT>",
        "<svg><title>a</title><style>b</style></svg>",
        "<iframe><article></iframe>",
    ],
)
def test_scripts_and_the_like_only_where_they_are_elements(before):
    assert blocks(f"<body>{before}<article>{STORY}</article>") == PARAGRAPHS
    assert blocks(f"<body><article>{STORY}</article>{before}<p>after</p>") == [*PARAGRAPHS, "after"]


def test_unclosed_scripts_reach_the_end():
    assert blocks(f"<article>{STORY}</article><script>a </style> <p>b</p>") == PARAGRAPHS


def test_ids_of_real_pages_keep_their_tokens():
    page = page_text.read_page('<div id="label-footer"><p>x</p></div>')
    assert not page.marks and page.groups[0] == (page_text._GROUP["footer"],)


TITLE, MENU = "The title of the story", "<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li><li><a href=/c>Sport</a></li></ul></nav>"
SIDE = '<div class="sidebar"><h3>More</h3><ul><li><a href=/1>One thing</a></li><li><a href=/2>Another thing</a></li></ul></div>'
WHOLE = f"<h1>{TITLE}</h1>{STORY}"


@pytest.fixture(scope="module")
def learned():
    """Trees learned as the query learns them."""
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist()
    return page_text.learn(pages)


@pytest.mark.parametrize(
    "html",
    [
        f'{MENU}<div class="main-column">{WHOLE}</div>{SIDE}{FOOT}',
        f'{MENU}<div id="top"><div class="story">{WHOLE}</div></div>{FOOT}',
        f'{MENU}<div class="content-with-sidebar"><div class="post-body">{WHOLE}</div>{SIDE}</div>{FOOT}',
        f"{MENU}<div>{WHOLE}</div>{SIDE}{FOOT}",
        f'{MENU}<div id="x1"><div id="x2">{WHOLE}</div></div>{SIDE}{FOOT}',
        f"{MENU}{WHOLE}{SIDE}{FOOT}",
        f"<table><tr><td>{MENU}</td><td>{WHOLE}</td></tr></table>{FOOT}",
        f"<table><tr><td><a href=/a>Home</a><br><a href=/b>News</a></td><td>{WHOLE}</td></tr><tr><td>&copy; 2020 someone</td></tr></table>",
        f"{MENU}<article><header><h1>{TITLE}</h1></header>{STORY}</article>{FOOT}",
    ],
)
def test_articles_without_a_telling_wrapper(learned, html):
    assert page_text.main_texts([f"<html><body>{html}</body></html>"], learned) == ["\n\n".join([TITLE, *PARAGRAPHS])]


def test_layouts_that_were_not_learned(learned):
    rng, right, due, found = np.random.default_rng(777), 0, 0, 0
    for _ in range(200):
        page = page_text.read_page(page_text.made_layout(rng), marked=True)
        labels, kept = page_text.made_labels(page), page_text.decode(page.parent, learned.odds(page_text.features(page)))
        for node, text, _ in page.blocks:
            right += len(text) * bool(labels[node] and kept[node])
            due += len(text) * bool(labels[node])
            found += len(text) * bool(kept[node])
    assert right / due >= 0.95 and right / found >= 0.95
