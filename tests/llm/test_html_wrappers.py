import pytest

from textloom.llm.html_blocks import parse
from textloom.llm.html_text import main_text

ARTICLE = "<h1>Title</h1><p>First paragraph of the text, long enough to count. It has two sentences.</p><p>Second paragraph, which goes on for some more words. And on.</p>"
WANT = "Title\n\nFirst paragraph of the text, long enough to count. It has two sentences.\n\nSecond paragraph, which goes on for some more words. And on."


@pytest.mark.parametrize("page", [
    f"<html><head><title>T</title><article>{ARTICLE}</article></html>", f"<head><meta charset=utf-8><title>T</title><style>p{{}}</style><script src=/a/>var a = 1;</script>{ARTICLE}",
    f"<html><head><title>T</title></head>{ARTICLE}</html>", f"<html>\n<head>\n<title>T</title>\n<link rel=x href=y>\n<body>{ARTICLE}",
])
def test_head_without_an_end(page):
    assert main_text(page) == WANT


def test_text_around_a_head():
    texts = lambda page: [b.text for b in parse(page).blocks]
    assert texts("<head><title>T</title>Text <b>here</b>.") == ["Text here."]
    assert texts("Before <head>and</head> after") == ["Before and after"]
    assert texts("<p>Before</p><head><p>within</p></head>after") == ["Before", "within", "after"]
    assert texts("<html> <head> <title>T</title> </head> <body>x") == ["x"]


NAMED = ("has-sidebar", "no-sidebar", "comments-open", "with-header", "legal-news", "single ad-free", "menu-open tag-news", "privacy-page", "search-results")


@pytest.mark.parametrize("name", NAMED)
def test_wrappers_named_like_furniture(name):
    furniture = "<nav><a href=/>Home</a></nav>", "<div class=sidebar><p>Some words about the author. They write.</p></div><section class='comments'><p>I liked this a lot. Thank you.</p></section>"
    for before, after in (("", ""), furniture):
        for page in (
            f"<html class='{name}'><body>{before}<article>{ARTICLE}</article>{after}</body></html>", f"<body class='{name}'>{before}<article>{ARTICLE}</article>{after}</body>", f"<body class='{name}'>{before}{ARTICLE}{after}</body>",
            f"<body>{before}<div id='{name}'><article>{ARTICLE}</article></div>{after}</body>", f"<body><div class='{name}'><div class='{name}'>{before}<main>{ARTICLE}</main>{after}</div></div></body>",
            f"<body>{before}<article class='{name}'>{ARTICLE}</article>{after}</body>", f"<body>{before}<div class='{name}'>{ARTICLE}</div>{after}</body>", f"<body>{before}<div class='{name}'><div role='main' class='{name}'>{ARTICLE}</div></div>{after}</body>",
        ):
            got = main_text(page)
            assert WANT[7:] in got and got == main_text(page.replace(name, "x")), page


def test_long_comments_and_teasers_stay_out():
    comment = "<li class='comment'><article class='comment-body'><p>A comment on it, at some length. With a reason, too.</p></article></li>"
    assert main_text(f"<body><article>{ARTICLE}</article><section class='comments'><ol class='comment-list'>{comment * 9}</ol></section></body>") == WANT
    assert main_text(f"<body class='comments-open'><div>{ARTICLE}</div><div class='comments-area'>{comment}</div></body>") == WANT
    assert main_text(f"<body class='has-sidebar'><div class='content'>{ARTICLE}</div><div class='sidebar'><article><p>Read more. Here.</p></article></div></body>") == WANT
    assert main_text(f"<body><article>{ARTICLE}</article><aside class='related'><article><p>Another text of ours. Read it.</p></article></aside></body>") == WANT
