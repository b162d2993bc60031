"""Blocks of Markdown, by examples in the manner of the public specification's sections."""

import random

import pytest

from loam.sources import parsers
from loam.sources.commonmark import blocks

H = lambda n, t: ("heading", t, n)
P, L, C, T = (lambda t, k=k: (k, t, None) for k in ("paragraph", "list_item", "code", "table"))

CASES = {
    # headings
    "# foo\n## foo ##\n###### foo\n####### foo": [H(1, "foo"), H(2, "foo"), H(6, "foo"), P("####### foo")],
    "#5 bolt\n\n#hashtag": [P("#5 bolt"), P("#hashtag")],
    "   ### foo\n    # bar": [H(3, "foo"), C("# bar")],
    "foo\n    # bar": [P("foo\n# bar")],
    "# foo#\n## foo \\##\n### foo ### b\n#": [H(1, "foo#"), H(2, "foo \\##"), H(3, "foo ### b"), H(1, "")],
    "Foo\nbar\n===\nFoo\n---": [H(1, "Foo\nbar"), H(2, "Foo")],
    "> Foo\n---": [P("Foo")],
    "- Foo\n---": [L("Foo")],
    "Foo\nBar\n\n---": [P("Foo\nBar")],
    "===\nfoo": [P("===\nfoo")],
    "> foo\nbar\n===": [P("foo\nbar\n===")],
    # breaks and code
    "***\n---\n___\n+++": [P("+++")],
    "- foo\n***\n- bar": [L("foo"), L("bar")],
    "    a simple\n      indented code block": [C("a simple\n  indented code block")],
    "    chunk1\n\n    chunk2\n  \n \n    chunk3\n\n": [C("chunk1\n\nchunk2\n\n\nchunk3")],
    "\tfoo\tbaz": [C("foo\tbaz")],
    "  - foo\n\n\tbar": [L("foo"), P("bar")],
    "- foo\n\n\t\tbar": [L("foo"), C("  bar")],
    ">\t\tfoo": [C("  foo")],
    "```\n<\n >\n```": [C("<\n >")],
    "````\naaa\n```\n``````": [C("aaa\n```")],
    "> ```\n> aaa\n\nbbb": [C("aaa"), P("bbb")],
    "  ```\naaa\n  aaa\naaa\n  ```": [C("aaa\naaa\naaa")],
    "``` aa ```\naaa": [P("``` aa ```\naaa")],
    "~~~ruby `x`\ndef f\n~~~~": [C("def f")],
    "```": [C("")],
    # raw HTML and definitions
    "<div>\n*foo*\n\nbar\n</div>": [P("bar")],
    "<pre>\n\nkept\n</pre>\nokay": [P("okay")],
    "<!-- a\n\nb -->\nokay": [P("okay")],
    "foo\n<a href=\"x\">\nbar": [P("foo\n<a href=\"x\">\nbar")],
    "[foo]: /url \"title\"\n\n[foo]": [P("[foo]")],
    "[foo]: /url\n[bar]: <u v> 'x'\ntext": [P("text")],
    "[foo]:\n\ntext": [P("[foo]:"), P("text")],
    # quotes
    "> # Foo\n> bar\n> baz": [H(1, "Foo"), P("bar\nbaz")],
    "> bar\nbaz\n> foo": [P("bar\nbaz\nfoo")],
    "> - foo\n- bar": [L("foo"), L("bar")],
    ">     foo\n    bar": [C("foo"), C("bar")],
    "> foo\n\n> bar": [P("foo"), P("bar")],
    "> > > foo\nbar": [P("foo\nbar")],
    ">>> foo\n> bar\n>>baz": [P("foo\nbar\nbaz")],
    ">     code\n\n>    not code": [C("code"), P("not code")],
    # list items
    "A paragraph\nwith two lines.\n\n    indented code\n\n> A block quote.": [P("A paragraph\nwith two lines."), C("indented code"), P("A block quote.")],
    "1.  A paragraph\n    with two lines.\n\n        indented code\n\n    > A block quote.": [L("A paragraph\nwith two lines."), C("indented code"), P("A block quote.")],
    "- one\n\n two": [L("one"), P("two")],
    "- one\n\n  two": [L("one"), P("two")],
    " -    one\n\n     two": [L("one"), C(" two")],
    "-one\n\n2.two": [P("-one"), P("2.two")],
    "- foo\n\n\n  bar": [L("foo"), P("bar")],
    "1234567890. not ok": [P("1234567890. not ok")],
    "-    foo\n\n  bar": [L("foo"), P("bar")],
    "-\n  foo\n-\n  ```\n  bar\n  ```\n-\n      baz": [L("foo"), C("bar"), C("baz")],
    "-\n\n  foo": [P("foo")],
    "foo\n*\n\nfoo\n1.": [P("foo\n*"), P("foo\n1.")],
    "> 1. > Blockquote\ncontinued here.": [P("Blockquote\ncontinued here.")],
    "- foo\n  - bar\n    - baz\n      - boo": [L("foo"), L("bar"), L("baz"), L("boo")],
    "10) foo\n    - bar": [L("foo"), L("bar")],
    "- - foo": [L("foo")],
    "1. - 2. foo": [L("foo")],
    "- # Foo\n- Bar\n  ---\n  baz": [H(1, "Foo"), H(2, "Bar"), P("baz")],
    "Foo\n- bar\n- baz": [P("Foo"), L("bar"), L("baz")],
    "The number is\n14.  The rest": [P("The number is\n14.  The rest")],
    "The number is\n1.  The rest": [P("The number is"), L("The rest")],
    "- a\n - b\n  - c\n   - d\n    - e": [L("a"), L("b"), L("c"), L("d\n- e")],
    "* a\n  > b\n  ```\n  c\n  ```\n* d": [L("a"), P("b"), C("c"), L("d")],
    "1. ```\n   foo\n   ```\n\n   bar": [C("foo"), P("bar")],
    "* foo\n  * bar\n\n  baz": [L("foo"), L("bar"), P("baz")],
    # tables
    "| foo | bar |\n| --- | --- |\n| baz | b\\|m |": [T("foo | bar\nbaz | b|m")],
    "| a | b |\n| - |\n| c |": [P("| a | b |\n| - |\n| c |")],
    "a | b\n-- | :-:\n1\n1 | 2 | 3\n\nend": [T("a | b\n1 | \n1 | 2"), P("end")],
    "text\n| a |\n|---|\n| 1 |\n> q": [P("text"), T("a\n1"), P("q")],
    "- | a |\n  |---|\n  | 1 |\n\n  after": [T("a\n1"), P("after")],
    "": [],
    "\n \n\t\n": [],
}


@pytest.mark.parametrize("text", list(CASES))
def test_blocks(text):
    assert list(blocks(text)) == CASES[text]
    assert list(blocks(text.replace("\n", "\r\n"))) == CASES[text]


def test_any_text_ends():
    r = random.Random(4)
    pieces = ["> ", "- ", "1. ", "    ", "\t", "```", "~~~", "#", " ", "|", "---", "|-|", "a", "é", "<div>", "<!--", "[x]: y", "\n", "\n", "\n"]
    for _ in range(3000):
        text = "".join(r.choice(pieces) for _ in range(r.randint(0, 40)))
        found = list(blocks(text))
        assert all(k in ("heading", "paragraph", "list_item", "code", "table") for k, _, _ in found)
        assert all(line.strip(" \t") in text for k, t, _ in found if k != "table" for line in t.split("\n"))


def test_deep_and_long():
    assert list(blocks("> " * 500 + "x")) == [P("x")]
    assert len(list(blocks("- a\n\n" * 20_000))) == 20_000


def test_parsed_with_titles_and_sections():
    read = parsers.parse("> # T\n\npara\n\n- a\n\n  > b\n\n| x |\n|---|\n| 1 |\n", "markdown")
    assert [(b["kind"], b["text"], b["section"]) for b in read["blocks"]] == [("heading", "T", "T"), ("paragraph", "para", "T"), ("list_item", "a", "T"), ("paragraph", "b", "T"), ("table", "x\n1", "T")]
    assert read["metadata"]["title"] == "T" and read["flags"] == ["tables_detected"]
    assert all(read["text"][b["start"] : b["end"]] == b["text"] for b in read["blocks"])
